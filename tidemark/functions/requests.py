"""Column functions on hosts, paths, addresses and user agents of web requests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import fixed_values as fixed

# Defaults of ours: the lookups behind these functions are site data, so callers
# may pass their own rules.
CRAWLER_AGENT = r"(?i)(bot|crawler|spider|slurp|https?://)"
DEVICE_RULES = (
    (r"(?i)(bot\b|bot/|crawler|spider|slurp)", "Spider"),
    (r"iPhone", "iPhone"),
    (r"iPad", "iPad"),
    (r"Android", "Generic Android"),
)
OTHER_DEVICE = "Other"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def project(host: Column | str) -> Column:
    """Second label of a host from the right; NULL for a one-label host."""
    return F.try_element_at(F.split(_col(host), r"\."), F.lit(-2))


def variant(host: Column | str) -> Column:
    """Language label of a host, '' where there is none."""
    return F.regexp_extract(_col(host), fixed.VARIANT_HOST, 3)


def page_title(path: Column | str) -> Column:
    """URL-decoded text behind the first path segment; NULL on a bad escape."""
    return F.regexp_extract(F.try_url_decode(_col(path)), fixed.TITLE_IN_PATH, 1)


def client_ip(ip: Column | str, forwarded_for: Column | str) -> Column:
    """First address of the forwarding list, else the connecting address.

    Empty entries and '-' count as missing.
    """
    first = F.trim(F.try_element_at(F.split(_col(forwarded_for), ","), F.lit(1)))
    return F.coalesce(F.when(~first.isin("", "-"), first), _col(ip))


def ip_number(ip: Column | str) -> Column:
    """IPv4 address as a number; NULL where it is not four octets."""
    parts = F.split(_col(ip), r"\.")
    octets = [F.get(parts, F.lit(i)).try_cast("long") for i in range(4)]
    valid = F.size(parts) == 4
    for octet in octets:
        valid = valid & octet.between(0, 255)
    value = octets[0] * 16777216 + octets[1] * 65536 + octets[2] * 256 + octets[3]
    return F.when(valid, value)


def address_digits(ip: Column | str) -> Column:
    """Address as 32 hexadecimal digits, so that the text order is the order of addresses.

    IPv4 addresses stand in the mapped block ::ffff:0:0/96. NULL where the text is no
    address: eight groups of one to four digits, or fewer around one '::'; the last two
    groups may be written as four octets.
    """
    def groups(side: Column) -> Column:
        return F.when(F.coalesce(side, F.lit("")) == "", F.array().cast("array<string>")).otherwise(
            F.split(side, ":", -1))

    def filled(sides: Column) -> Column:
        missing = 8 - F.size(sides["one"]) - F.size(sides["two"])
        zeros = F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0)).cast("int"))
        return F.when(sides["n"] == 1, sides["one"]).when(
            (sides["n"] == 2) & (missing >= 1), F.concat(sides["one"], zeros, sides["two"]))

    def padded(given: Column) -> Column:
        valid = (F.size(given) == 8) & F.forall(given, lambda g: g.rlike("^[0-9a-fA-F]{1,4}$"))
        return F.when(valid, F.array_join(F.transform(
            given, lambda g: F.lpad(F.lower(g), 4, "0")), ""))

    def whole(text: Column, tail: Column) -> Column:
        """The text with its last four octets as two groups."""
        return F.when(tail.isNotNull(), F.concat(
            F.left(text, F.length(text) - F.length(F.substring_index(text, ":", -1))),
            F.hex(F.shiftright(tail, 16)), F.lit(":"),
            F.hex(tail.bitwiseAND(F.lit(65535))))).otherwise(text)

    def sides_of(parts: Column) -> Column:
        return F.struct(F.size(parts).alias("n"), groups(F.get(parts, F.lit(0))).alias("one"),
                        groups(F.get(parts, F.lit(1))).alias("two"))

    def read(text: Column) -> Column:
        joined = _bound(ip_number(F.substring_index(text, ":", -1)), lambda tail: whole(text, tail))
        sides = _bound(F.split(joined, "::", -1), sides_of)
        return F.when(F.instr(text, ":") > 0, _bound(_bound(sides, filled), padded)).otherwise(
            F.concat(F.lit("0" * 20 + "ffff"), F.lpad(F.lower(F.hex(ip_number(text))), 8, "0")))

    return _bound(F.lower(_col(ip)), read)


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def leading_bits(digits: Column, length: Column) -> Column:
    """The first ``length`` bits of an address of :func:`address_digits`, as a key that says
    how many they are."""
    full, rest = F.floor(length / F.lit(4)).cast("int"), length % 4
    digit = F.conv(F.substr(digits, full + 1, F.lit(1)), 16, 10).cast("int")
    mask = F.call_function("shiftleft", F.lit(15), (4 - rest).cast("int"))
    part = F.when(rest > 0, F.lower(F.hex(digit.bitwiseAND(mask)))).otherwise("")
    return F.concat(length.cast("string"), F.lit(":"), F.substr(digits, F.lit(1), full), part)


def access_method(host: Column | str, user_agent: Column | str) -> Column:
    """'mobile app', 'mobile web' or 'desktop'."""
    labels = F.split(_col(host), r"\.")
    marked = F.arrays_overlap(labels, F.array(*[F.lit(m) for m in fixed.MOBILE_MARKERS]))
    return (
        F.when(_col(user_agent).contains(fixed.APP_AGENT), "mobile app")
        .when(marked, "mobile web")
        .otherwise("desktop")
    )


def is_crawler(user_agent: Column | str, pattern: str = CRAWLER_AGENT) -> Column:
    """Whether a user agent names itself a crawler; a missing agent does not."""
    return F.coalesce(_col(user_agent), F.lit("")).rlike(pattern)


def device_family(user_agent: Column | str, rules=DEVICE_RULES) -> Column:
    """Family of the first rule whose pattern matches, else 'Other'."""
    agent = F.coalesce(_col(user_agent), F.lit(""))
    family = None
    for pattern, name in rules:
        family = (F.when if family is None else family.when)(agent.rlike(pattern), name)
    return F.lit(OTHER_DEVICE) if family is None else family.otherwise(OTHER_DEVICE)


def encoded_title(title: Column | str) -> Column:
    """Title as it appears in a form-encoded URL."""
    return F.url_encode(_col(title))


def decoded_title(title: Column | str) -> Column:
    """Inverse of :func:`encoded_title`; NULL on a bad escape."""
    return F.try_url_decode(_col(title))


def hour_of_parts(year, month, day, hour) -> Column:
    """Timestamp of the four partition numbers."""
    zero = F.lit(0)
    return F.make_timestamp(_col(year), _col(month), _col(day), _col(hour), zero, zero)


def wall_clock(moment_given) -> Column:
    """A Python datetime as a timestamp without zone, the same in every session."""
    return F.lit(moment_given.isoformat(sep=" ")).cast("timestamp_ntz")


def day_of_parts(year, month, day) -> Column:
    """Date of three partition numbers."""
    return F.make_date(_col(year), _col(month), _col(day))


def moment(text: Column | str, pattern: str = "yyyy-MM-dd HH:mm") -> Column:
    """Timestamp of a written moment; NULL where the text does not fit."""
    return F.try_to_timestamp(_col(text), F.lit(pattern))


def days_before(day: Column | str, days: int = 7) -> Column:
    """The date so many days earlier."""
    return F.date_sub(_col(day), days)


def utf8_text(raw: Column | str) -> Column:
    """Text of a binary column that holds UTF-8."""
    return F.decode(_col(raw), "UTF-8")
