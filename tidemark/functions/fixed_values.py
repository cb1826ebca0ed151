"""Fixed values that results depend on. They are data, listed as they are."""

# Content types that count as a page.
PAGE_CONTENT_TYPES = [
    "text/html; charset=iso-8859-1",
    "text/html; charset=ISO-8859-1",
    "text/html",
    "text/html; charset=utf-8",
    "text/html; charset=UTF-8",
    "application/json; charset=utf-8",
]

# Hosts of the production sites.
PRODUCTION_HOST = (
    r"((commons|meta|species)\.((m|mobile|wap|zero)\.)?wikimedia\.)"
    r"|(wik(tionary|isource|ibooks|ivoyage|iversity|iquote|inews|ipedia|idata)\.)"
)

# Paths (with query) below which content lives.
CONTENT_PATH = (
    r"(/zh(-(tw|cn|hant|mo|my|hans|hk|sg))?/|/sr(-(ec|el))?/"
    r"|/wiki(/|\?(cur|old)id=)|/w/|/\?title=)"
)

API_PATH = r"api.php"
APP_AGENT = "WikipediaApp"
APP_PAGE_QUERY = "sections=0"
INTERNAL_AGENT = r"^MediaWiki/1\."
SPECIAL_PAGE = r"Special:"
SEARCH_QUERY = r"index.php\?search"
SCRIPT_PATH = r"^/w/"
OK_STATUS = "200"

PROJECTS = [
    "wikipedia",
    "wiktionary",
    "wikibooks",
    "wikinews",
    "wikiquote",
    "wikisource",
    "wikiversity",
    "wikivoyage",
    "wikimedia",
    "wikidata",
]

# Language label in front of the project, an optional mobile marker between.
VARIANT_HOST = (
    r"(www\.)?(((?:(?!m\.|zero\.|wap\.|mobile\.)[^.])*)\.)?((m|zero|wap|mobile)\.)?"
    rf"({'|'.join(PROJECTS)})\.org(:80)?"
)
MOBILE_MARKERS = ["m", "zero", "wap", "mobile"]
TITLE_IN_PATH = r"^/[^/]*/(.*)"

# Hosts watched through the switch to encrypted traffic.
TRANSITION_HOST = r"(ca|en|zh|it|ug|he)\.(m\.)?wikipedia"
REQUEST_SOURCES = ["text", "mobile"]

# One request in this many is kept by the sampled jobs.
SAMPLE_ONE_IN = 64

# Hits per hour from which a client counts as a heavy user.
HEAVY_USER_HITS = 200
