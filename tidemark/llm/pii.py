"""Personal data replaced by format-preserving pseudonyms of a keyed Feistel network.

Native: column expressions only, no shuffle. Numbers and dates that are valid in their
format are permuted within it, by eight keyed rounds over the two halves of their value:
the same value has the same pseudonym in every document, two values never share one, and
with the key the step can be undone. Separators and everything around stay as they are.
Each format has a subkey derived from the key. The subkeys are literals of the plan, so who
may read plans and event logs can undo pseudonyms, but learns nothing of the key.

Formats: payment cards (13 to 19 digits, joined or in groups, that pass the Luhn check; the
pseudonym passes it as well; a card may begin and end at any group of a longer row of digits,
the longest from the left is taken, and the digits around it stay), telephone numbers of ten digits, social-security numbers, IPv4 addresses, and
calendar dates written year first. The letters before an e-mail address's @ are no number:
they are replaced by twelve letters of a keyed digest, its domain stays. Finds may stand in
parentheses, URLs, timestamps, lists and beside letters; a further digit beside one makes it
another number.

Defined cases: a null text stays null and has no finds; an empty text stays empty. What has
the form but is not valid (a failed check digit, a 30th of February) stays. Rows are
treated one by one, so ties and repeated rows change nothing. Further columns are kept;
columns named as the added ones are replaced. Long texts are read whole. An empty table
gives an empty one.
"""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.names import apart

ROUNDS = 8
FIRST_DAY, DAYS = "1900-01-01", 73_049  # to 2099-12-31
EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@[A-Za-z0-9][A-Za-z0-9-]{0,62}(?:\.[A-Za-z0-9-]{1,63}){1,4}"
PHONE = r"(?:\+1[ .-]?)?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}|(?:\+1[ .-])?[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}"
SOCIAL = r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}"
OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
ADDRESS = rf"{OCTET}(?:\.{OCTET}){{3}}"
DATE = "(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])"
GROUP = "[0-9]{1,19}(?![0-9])"
# Each format has its own bounds: a digit beside a find belongs to it, other neighbours do not
# matter. Dotted numbers of five parts and versions (v1.2.3.4) are no addresses, and the digits
# after a decimal point no card.
ALONE, ENDS = "(?<![0-9])", "(?![0-9])"
MAIL = f"(?<![A-Za-z0-9]){EMAIL}"
NUMBERS = "|".join((
    f"{ALONE}(?:{PHONE}){ENDS}", f"{ALONE}{SOCIAL}{ENDS}",
    rf"(?<![0-9]|[0-9]\.|(?<![A-Za-z])[vV]){ADDRESS}(?![0-9]|\.[0-9])", f"{ALONE}{DATE}{ENDS}"))
# Of joined digits each group is a find of its own that sees up to 19 groups from its own on, as
# far as no other format begins; which of them make a card is told by the check digit.
# Groups that have too few digits after them are finds only as parts of a run.
AHEAD = f"{GROUP}(?:[ -](?!{MAIL}|{NUMBERS}){GROUP}){{0,18}}"
ANY = (rf"{MAIL}|(?=[0-9(+])(?:{NUMBERS}|(?<![0-9]|[0-9]\.)"
       rf"(?:(?=[0-9](?:[ -]?[0-9]){{12}})|(?<=[0-9][ -]))(?=({AHEAD})){GROUP})")
KINDS = ("cards", "phones", "social", "addresses", "dates", "emails")
BEGINS, INSIDE = 1, 2
INNER = ("_found", "_sized", "_cards", "_finds", "_pieces")
ADDED = ("pseudonymised", *(f"n_{kind}" for kind in KINDS))


def _whole(form: str) -> str:
    return f"^(?:{form})$"


def subkey(key: str, tag: str) -> str:
    """The key of one format. Plans, and so event logs, hold subkeys and never the key."""
    return hmac.new(key.encode(), tag.encode(), hashlib.sha256).hexdigest()


def _keyed(sub: str, turn: Column, value: Column) -> Column:
    """60 bits of a keyed digest, as a long."""
    named = F.concat_ws(":", F.lit(sub), turn.cast("string"), value.cast("string"))
    outer = F.sha2(F.concat(F.lit(f"{sub}|"), F.sha2(named, 256)), 256)
    return F.conv(F.substring(outer, 1, 15), 16, 10).cast("long")


def permuted(value: Column, low_size: int, high_size: int, key: str, tag: str) -> Column:
    """A permutation of 0 .. low_size * high_size - 1, the two halves moved in turn."""
    sub = subkey(key, tag)
    start = F.struct(F.floor(value / F.lit(low_size)).cast("long").alias("high"),
                     (value % low_size).cast("long").alias("low"))

    def turn(halves: Column, n: Column) -> Column:
        odd = n % 2 == 1
        high = F.when(odd, (halves["high"] + _keyed(sub, n, halves["low"]) % high_size)
                      % high_size).otherwise(halves["high"])
        low = F.when(odd, halves["low"]).otherwise(
            (halves["low"] + _keyed(sub, n, halves["high"]) % low_size) % low_size)
        return F.struct(high.alias("high"), low.alias("low"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn,
                       lambda halves: halves["high"] * low_size + halves["low"])


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _spread(digits: Column, pattern: Column) -> Column:
    """The digits in the places of the pattern's digits, everything else kept."""
    def write(state: Column, letter: Column) -> Column:
        number = letter.rlike("^[0-9]$")
        return F.struct(
            F.concat(state["text"], F.when(number, F.substring(digits, state["at"], F.lit(1)))
                     .otherwise(letter)).alias("text"),
            (state["at"] + number.cast("int")).alias("at"))

    begin = F.struct(F.lit("").alias("text"), F.lit(1).alias("at"))
    return F.aggregate(F.split(pattern, ""), begin, write, lambda state: state["text"])


def _luhn_sum(digits: Column, doubled_last: bool) -> Column:
    """Sum of the digits, every second doubled, from the right."""
    def add(total: Column, place: Column) -> Column:
        digit = F.substring(digits, -place, F.lit(1)).cast("int")
        twice = digit * 2 - F.when(digit > 4, 9).otherwise(0)
        return total + F.when(place % 2 == int(doubled_last), twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)


def luhn_valid(digits: Column) -> Column:
    return _luhn_sum(digits, False) % 10 == 0


def _card_groups(ahead: Column) -> Column:
    """How many of the groups ahead make the longest valid card, null for none."""
    groups = F.split(ahead, "[ -]")

    def card(count: Column) -> Column:
        digits = F.array_join(F.slice(groups, F.lit(1), count), "")
        return F.length(digits).between(13, 19) & luhn_valid(digits)

    return F.when(F.length(_digits(ahead)) > 12, F.array_max(
        F.filter(F.sequence(F.lit(1), F.size(groups)), card)))


def _first(ahead: Column, count: Column) -> Column:
    """The first groups of those ahead, with what stands between them."""
    size = F.length(F.array_join(F.slice(F.split(ahead, "[ -]"), F.lit(1), count), " "))
    return F.substring(ahead, F.lit(1), size)


def _card(found: Column, key: str) -> Column:
    """All digits but the last are permuted, by length; the last is the check digit."""
    digits = _digits(found)
    size = F.length(digits) - 1
    body = F.substring(digits, F.lit(1), size)
    moved = F.lit(None).cast("string")
    for length in range(12, 19):
        low = 10 ** (length // 2)
        value = permuted(body.cast("long"), low, 10 ** length // low, key, f"card{length}")
        moved = F.when(size == length, F.lpad(value.cast("string"), length, "0")).otherwise(moved)
    check = (F.lit(10) - _luhn_sum(moved, True) % 10) % 10
    return _spread(F.concat(moved, check.cast("string")), found)


def _number(found: Column, length: int, key: str, tag: str) -> Column:
    """The last ``length`` digits permuted; a country code before them stays."""
    digits = _digits(found)
    low = 10 ** (length // 2)
    value = permuted(F.substring(digits, -length, length).cast("long"), low,
                     10 ** length // low, key, tag)
    head = F.substring(digits, F.lit(1), F.length(digits) - length)
    return _spread(F.concat(head, F.lpad(value.cast("string"), length, "0")), found)


def _social(found: Column, key: str) -> Column:
    """Areas 001 to 899 but for 666, groups 01 to 99 and serials 0001 to 9999 are permuted."""
    area, group, serial = (F.get(F.split(found, "-"), F.lit(n)).cast("long") for n in range(3))
    place = area - 1 - (area > 666).cast("long")
    moved = permuted(place * (99 * 9999) + (group - 1) * 9999 + serial - 1, 99 * 9999, 898,
                     key, "social")
    new = F.floor(moved / (99 * 9999)).cast("long")
    parts = ((new + 1 + (new >= 665).cast("long"), 3),
             (F.floor(moved / 9999).cast("long") % 99 + 1, 2), (moved % 9999 + 1, 4))
    return F.concat_ws("-", *[F.lpad(p.cast("string"), size, "0") for p, size in parts])


def _address(found: Column, key: str) -> Column:
    value = F.aggregate(F.split(found, r"\."), F.lit(0).cast("long"),
                        lambda total, part: total * 256 + part.cast("long"))
    moved = permuted(value, 1 << 16, 1 << 16, key, "address")
    return F.concat_ws(".", *[(F.shiftright(moved, 8 * n) % 256).cast("string")
                              for n in (3, 2, 1, 0)])


def _day(found: Column) -> Column:
    return F.datediff(F.try_to_date(found, "yyyy-MM-dd"), F.lit(FIRST_DAY).cast("date"))


def _date(found: Column, key: str) -> Column:
    """Days of two centuries are permuted; their number is 17 times 4,297."""
    low = 17
    moved = permuted(_day(found).cast("long"), low, DAYS // low, key, "date")
    return F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), moved.cast("int")),
                         "yyyy-MM-dd")


def _email(found: Column, key: str) -> Column:
    name, domain = F.substring_index(found, "@", 1), F.substring_index(found, "@", -1)
    digest = F.sha2(F.concat(F.lit(f"{subkey(key, 'email')}|"), F.lower(found)), 256)
    letters = F.translate(F.substring(digest, 1, 12), "0123456789", "ghijklmnop")
    return F.when(name != "", F.concat(letters, F.lit("@"), domain))


def kind_of(found: Column) -> Column:
    """The format other than a card that a find is valid in, null for none."""
    parts = F.split(found, r"\.")
    day = _day(found)
    return (F.when(found.rlike(_whole(EMAIL)), "emails")
            .when(found.rlike(_whole(PHONE)), "phones")
            .when(found.rlike(_whole(SOCIAL)), F.when(
                ~found.rlike("^(000|666|9..)|-00-|-0000$"), "social"))
            .when(found.rlike(_whole(ADDRESS)), F.when(
                F.forall(parts, lambda p: (p.cast("int") < 256) & ~p.rlike("^0[0-9]")),
                "addresses"))
            .when(found.rlike(_whole(DATE)), F.when((day >= 0) & (day < DAYS), "dates")))


def pseudonym(find: Column, key: str) -> Column:
    """What replaces a find (kind, text); the text itself where it is valid in no format."""
    kind, text = find["kind"], find["text"]
    return F.coalesce(
        F.when(kind == "cards", _card(text, key))
        .when(kind == "phones", _number(text, 10, key, "phone"))
        .when(kind == "social", _social(text, key))
        .when(kind == "addresses", _address(text, key))
        .when(kind == "dates", _date(text, key))
        .when(kind == "emails", _email(text, key)), text)


def _count(kind: str) -> Column:
    return F.size(F.filter("_finds", lambda find: find["kind"] == kind)).cast("long")


@apart(*INNER)
def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Adds pseudonymised (the text with pseudonyms) and a count of finds by kind."""
    base = docs.drop(*ADDED)
    full = F.coalesce(text, F.lit(""))
    found = F.arrays_zip(F.regexp_extract_all(full, F.lit(ANY), F.lit(0)).alias("text"),
                         F.regexp_extract_all(full, F.lit(ANY), F.lit(1)).alias("ahead"))
    sized = F.transform("_found", lambda f, n: F.struct(
        n.alias("at"), f["text"].alias("text"), f["ahead"].alias("ahead"),
        F.when(f["ahead"] != "", _card_groups(f["ahead"])).alias("groups")))

    def take(state: Column, f: Column) -> Column:
        """Marks of the finds from the left: a card begins here, goes on here, or neither."""
        inside = f["at"] <= state["last"]
        begins = f["groups"].isNotNull() & ~inside
        mark = F.when(begins, BEGINS).when(inside, INSIDE).otherwise(0)
        return F.struct(
            F.when(begins, f["at"] + f["groups"] - 1).otherwise(state["last"]).alias("last"),
            F.concat(state["marks"], F.array(mark)).alias("marks"))

    none = F.struct(F.lit(-1).alias("last"), F.array().cast("array<int>").alias("marks"))
    marks = F.aggregate("_sized", none, take, lambda state: state["marks"])

    def told(f: Column, mark: Column) -> Column:
        begins = mark == BEGINS
        kind = F.when(begins, "cards").when(f["ahead"] == "", kind_of(f["text"]))
        return F.struct(kind.alias("kind"), (mark == INSIDE).alias("inside"), F.when(
            begins, _first(f["ahead"], f["groups"])).otherwise(f["text"]).alias("text"))

    cut = base.withColumn("_found", found).withColumn("_sized", sized).withColumn(
        "_cards", marks).withColumn("_finds", F.zip_with("_sized", "_cards", told)).withColumn(
        "_pieces", F.split(F.col(text), ANY, -1))
    # A card's later groups went with its first one, and so did what stands before them.
    replaced = F.transform("_finds", lambda f: F.struct(
        f["inside"].alias("inside"), pseudonym(f, key).alias("moved")))
    joined = F.array_join(F.zip_with("_pieces", replaced, lambda piece, f: F.when(
        f["inside"], "").otherwise(F.concat(piece, F.coalesce(f["moved"], F.lit(""))))), "")
    counts = [_count(kind).alias(f"n_{kind}") for kind in KINDS]
    whole = F.when(F.size("_finds") == 0, F.col(text)).otherwise(joined)
    return cut.select(*base.columns, whole.alias("pseudonymised"), *counts)
