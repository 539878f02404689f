"""Value conversions as Column expressions: text, numbers, addresses, lists, times, hashes, URLs and nested values."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.functions.emptiness import prune_variant_map
from logloom.functions.json_walk import flat_entries
from logloom.functions.patterns import capture

BLANKS = " \t\r\n\f\x0b"


def let(col: Column, body) -> Column:
    """`body(x)` with x bound once to `col`, so that a long expression is not repeated at each use."""
    return F.get(F.transform(F.array(col), body), F.lit(0))


def strip(col: Column) -> Column:
    """Text without surrounding white space."""
    return F.btrim(col, F.lit(BLANKS))


# ---------------------------------------------------------------- text
def text(col: Column) -> Column:
    return col.cast("string")


def lower(col: Column) -> Column:
    return F.lower(col)


def upper(col: Column) -> Column:
    return F.upper(col)


def upper_first(col: Column) -> Column:
    return F.concat(F.upper(F.substring(col, 1, 1)), col.substr(F.lit(2), F.length(col)))


def strip_quotes(col: Column) -> Column:
    """Spaces, then double quotes, then spaces removed at both ends."""
    return strip(F.btrim(strip(col), F.lit('"')))


def unquote(col: Column) -> Column:
    """One matching pair of quotes removed."""
    s = strip(col)
    first, last = F.substring(s, 1, 1), F.right(s, F.lit(1))
    return F.when((F.length(s) >= 2) & (first == last) & first.isin('"', "'"),
                  s.substr(F.lit(2), F.length(s) - 2)).otherwise(s)


def nil(col: Column) -> Column:
    """NULL for the usual ways of writing "no value"."""
    return F.when(~strip(col).isin("", "-", "null", "None"), col)


def replace_text(col: Column, old: str, new: str) -> Column:
    return F.replace(col, F.lit(old), F.lit(new)) if old else col


def basename(col: Column) -> Column:
    return F.regexp_extract(col, r"[^\\/]*\z", 0)


def dirname(col: Column) -> Column:
    return F.regexp_extract(col, r"(?s)^(.*)[\\/][^\\/]*\z", 1)


def domain(col: Column) -> Column:
    """`DOMAIN` of `DOMAIN\\user`."""
    return F.when(F.contains(col, F.lit("\\")), F.substring_index(col, "\\", 1))


def user(col: Column) -> Column:
    """`user` of `DOMAIN\\user` or `user@domain`."""
    return F.substring_index(F.substring_index(col, "\\", -1), "@", 1)


def hash_algorithm(col: Column) -> Column:
    """Name of the digest by the length of its hexadecimal text."""
    s = strip(col)
    size = F.length(s)
    return F.when(s.rlike(r"^[0-9A-Fa-f]+\z"),
                  F.when(size == 32, "MD5").when(size == 40, "SHA-1").when(size == 64, "SHA-256").when(size == 128, "SHA-512"))


# ---------------------------------------------------------------- numbers
def to_int(col: Column) -> Column:
    return strip(text(col)).try_cast("bigint")


def to_float(col: Column) -> Column:
    s = strip(text(col))
    return F.when(~s.rlike(r"(?i)^[+-]?[0-9.]+(e[+-]?[0-9]+)?[df]\z"), s.try_cast("double"))


def to_bool(col: Column) -> Column:
    return F.when(col.isNotNull(), F.lower(strip(text(col))).isin("1", "true", "yes", "sim", "on"))


# ---------------------------------------------------------------- addresses
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_V6_SHAPE = (r"^(?=(?:[^:]*:){2,8}[^:]*\z)(?!.*::.*::)(?!.*:::)(?!:[^:])(?!.*[^:]:\z)"
             r"(?:[0-9A-Fa-f]{0,4}:){2,8}[0-9A-Fa-f]{0,4}\z")


def is_ipv4(col: Column) -> Column:
    return col.rlike(rf"^{IPV4}\z")


def _dotted_tail_to_hex(col: Column) -> Column:
    """IPv6 text whose last 32 bits are dotted -> two hexadecimal groups."""
    def rewrite(s: Column) -> Column:
        octets = F.transform(F.split(F.substring_index(s, ":", -1), r"\."), lambda x: x.try_cast("int"))
        return let(octets, lambda o: F.concat(
            s.substr(F.lit(1), F.length(s) - F.length(F.substring_index(s, ":", -1))),
            F.lower(F.hex(F.get(o, F.lit(0)) * 256 + F.get(o, F.lit(1)))), F.lit(":"),
            F.lower(F.hex(F.get(o, F.lit(2)) * 256 + F.get(o, F.lit(3))))))
    return F.when(col.rlike(rf":{IPV4}\z"), let(col, rewrite)).otherwise(col)


def _v6_shaped(s: Column) -> Column:
    groups = F.size(F.filter(F.split(s, ":"), lambda g: g != ""))
    return s.rlike(_V6_SHAPE) & F.when(F.contains(s, F.lit("::")), groups <= 7).otherwise(groups == 8)


def is_ipv6(col: Column) -> Column:
    """True for a whole IPv6 address (at most one '::', one to four hexadecimal digits per group, eight groups)."""
    return F.contains(col, F.lit(":")) & let(_dotted_tail_to_hex(col), _v6_shaped)


def _v6_groups(t: Column) -> Column:
    """The eight groups of a well-formed IPv6 text, with '::' filled by zeros."""
    side = lambda p: F.filter(F.split(p, ":"), lambda g: g != "")
    left, right = side(F.substring_index(t, "::", 1)), side(F.substring_index(t, "::", -1))
    missing = F.greatest(F.lit(0), F.lit(8) - F.size(left) - F.size(right))
    return F.when(F.contains(t, F.lit("::")), F.concat(left, F.array_repeat(F.lit("0"), missing), right)).otherwise(side(t))


def _compress_v6(s: Column) -> Column:
    """Usual form of eight-group hexadecimal text: lower case, no leading zeros, the longest run of zeros as '::'."""
    strip_zeros = lambda g: F.regexp_replace(g, "^0+(?=.)", "")

    # the longest run of at least two zero groups, the first of equal length: ':0:0:…:' inside ':a:b:…:'
    runs = F.array(*[F.lit(":" + "0:" * k) for k in range(8, 1, -1)])

    def shorten(j: Column) -> Column:
        run = F.get(F.filter(runs, lambda r: F.contains(j, r)), F.lit(0))
        return F.when(run.isNull(), j).otherwise(F.concat(j.substr(F.lit(1), F.position(run, j) - 1), F.lit("::"),
                                                          j.substr(F.position(run, j) + F.length(run), F.length(j))))

    joined = let(F.lower(s), lambda t: F.concat(F.lit(":"), F.array_join(F.transform(_v6_groups(t), strip_zeros), ":"), F.lit(":")))
    return F.regexp_replace(let(joined, shorten), r"^:(?!:)|(?<!:):\z", "")


def to_ip(col: Column) -> Column:
    """Valid address in its usual form, without brackets, mask or IPv4 port; NULL when it is no address."""
    s = F.substring_index(F.btrim(strip(text(col)), F.lit("[]")), "/", 1)
    s = F.regexp_replace(s, r"^([^:]*\.[^:]*):[^:]*\z", "$1")
    v6 = lambda x: F.when(_v6_shaped(x), _compress_v6(x))
    return F.when(is_ipv4(s), s).when(F.contains(s, F.lit(":")), let(_dotted_tail_to_hex(s), v6))


def to_ips(col: Column, pattern: str = r"[,\s]+") -> Column:
    """Valid addresses in a delimited text."""
    return F.filter(F.transform(F.split(col, pattern), to_ip), lambda x: x.isNotNull())


def ipv4_number(col: Column) -> Column:
    """Dotted IPv4 text as a number; NULL for anything else."""
    part = lambda i: F.split_part(col, F.lit("."), F.lit(i)).try_cast("bigint")
    return F.when(is_ipv4(col), part(1) * 16777216 + part(2) * 65536 + part(3) * 256 + part(4))


def address_bits(col: Column) -> Column:
    """Address -> STRUCT(family, high, low): its bits from the left in two BIGINTs, IPv4 in the upper half of `high`. NULL when it is no address."""
    shift = lambda c: F.shiftleft(c, 32)

    def v6(s: Column) -> Column:
        digits = F.array_join(F.transform(_v6_groups(s), lambda g: F.lpad(g, 4, "0")), "")
        word = lambda d, i: F.conv(F.substring(d, 8 * i + 1, 8), 16, 10).cast("bigint")
        return let(digits, lambda d: F.struct(F.lit(6).alias("family"), shift(word(d, 0)).bitwiseOR(word(d, 1)).alias("high"),
                                              shift(word(d, 2)).bitwiseOR(word(d, 3)).alias("low")))

    v4 = F.struct(F.lit(4).alias("family"), shift(ipv4_number(col)).alias("high"), F.lit(0).cast("bigint").alias("low"))
    return F.when(is_ipv4(col), v4).when(F.contains(col, F.lit(":")), let(_dotted_tail_to_hex(col), lambda s: F.when(_v6_shaped(s), v6(s))))


def unmapped_bits(bits: Column) -> Column:
    """An IPv4 address written as IPv6 (::ffff:0:0/96) as IPv4."""
    mapped = (bits["family"] == 6) & (bits["high"] == 0) & (F.shiftrightunsigned(bits["low"], 32) == 0xFFFF)
    v4 = F.struct(F.lit(4).alias("family"), F.shiftleft(bits["low"], 32).alias("high"), F.lit(0).cast("bigint").alias("low"))
    return F.when(mapped, v4).otherwise(bits)


# ---------------------------------------------------------------- lists
def split_list(col: Column, sep: str = ",") -> Column:
    return F.filter(F.transform(F.split(text(col), re.escape(sep)), strip), lambda x: x != "")


def first(col: Column) -> Column:
    return F.get(col, F.lit(0))


def last(col: Column) -> Column:
    return F.when(F.size(col) > 0, F.element_at(col, -1))


def join_list(col: Column, sep: str = ", ") -> Column:
    """Array of text joined; empty members are skipped and nothing left gives NULL."""
    kept = F.filter(col, lambda x: x.isNotNull() & ~x.isin("", "-"))
    return F.when(F.size(kept) > 0, F.array_join(kept, sep))


def join_variant_list(col: Column, sep: str = ", ") -> Column:
    """Variant list joined; empty members, lists and objects are skipped."""
    items = F.try_variant_get(col, "$", "array<variant>")
    plain = F.filter(items, lambda x: ~F.schema_of_variant(x).rlike("^(OBJECT|ARRAY|VOID)"))
    return join_list(F.transform(plain, lambda x: F.try_variant_get(x, "$", "string")), sep)


# ---------------------------------------------------------------- times
def epoch_ms(col: Column) -> Column:
    return F.timestamp_millis(to_float(col).try_cast("bigint"))


def epoch_s(col: Column) -> Column:
    return F.timestamp_micros((strip(text(col)).try_cast("decimal(24,6)") * 1000000).try_cast("bigint"))


_ISO = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?)?(?:Z|[+-]\d{2}(?::?\d{2})?)?\z"
_ISO_BASIC = r"^(\d{4})(\d{2})(\d{2})(?:[T ](\d{2})(\d{2})(\d{2}))?(Z|[+-]\d{2}(?::?\d{2})?)?\z"


def to_time(col: Column) -> Column:
    """Instant from epoch milliseconds (13 digits), epoch seconds (10 digits) or ISO 8601; no zone means UTC."""
    s = strip(text(col))
    iso = F.regexp_replace(F.regexp_replace(s, ",", "."), r"(\.\d{6})\d+", "$1")
    basic = F.regexp_replace(F.regexp_replace(s, _ISO_BASIC, "$1-$2-$3 $4:$5:$6$7"), r" ::", " 00:00:00")
    return (F.when(s.rlike(r"^\d{13}\z"), F.timestamp_millis(s.try_cast("bigint")))
            .when(s.rlike(r"^\d{10}(?:\.\d+)?\z"), epoch_s(s))
            .when(s.rlike(_ISO), iso.try_cast("timestamp"))
            .when(s.rlike(_ISO_BASIC), basic.try_cast("timestamp")))


# fixed values: date directives and their Spark datetime pattern letters
STRPTIME_LETTERS = {
    "Y": "yyyy", "y": "yy", "m": "M", "d": "d", "e": "d", "H": "H", "I": "h", "M": "m", "S": "s", "f": "SSSSSS", "p": "a",
    "b": "MMM", "B": "MMMM", "j": "D", "z": "[XXX][XX][X]", "%": "%",
}


def spark_time_pattern(fmt: str) -> str:
    """Directive pattern (`%d/%b/%Y`) -> Spark datetime pattern. Weekday names are dropped, see `strptime`."""
    out = []
    for m in re.finditer(r"%(.)|([^%]+)", re.sub(r"%[aA][,.]?\s*", "", fmt)):
        if m.group(1):
            if m.group(1) not in STRPTIME_LETTERS:
                raise ValueError(f"date directive %{m.group(1)} is not supported")
            out.append(STRPTIME_LETTERS[m.group(1)])
        else:
            out.append(re.sub(r"[A-Za-z\[\]#{}']+", lambda x: "'" + x.group(0).replace("'", "''") + "'", m.group(2)))
    return "".join(out)


def strptime(col: Column, fmt: str) -> Column:
    """Instant read by an explicit directive pattern; no zone means UTC; NULL when the text does not fit."""
    s = F.regexp_replace(strip(text(col)), r"\s+", " ")
    if re.search(r"%[aA]", fmt):
        s = F.regexp_replace(s, r"\b(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*[,.]? ?", "")
    return F.try_to_timestamp(s, F.lit(spark_time_pattern(fmt))).cast("timestamp")


def iso_ms(col: Column) -> Column:
    """TIMESTAMP -> ISO 8601 UTC text with milliseconds."""
    return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


# ---------------------------------------------------------------- URLs
_URL = r"(?s)^(?:([A-Za-z][\w+.\-]*)://)?([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?\z"
_NETLOC = r"^(?:.*@)?\[?((?<=\[)[^\]]*|[^:]*)"


def url_parts(col: Column) -> Column:
    """URL text -> STRUCT(url_string, scheme, hostname, port, path, query_string); host-only and path-only texts count."""
    def parse(raw: Column) -> Column:
        return let(F.regexp_replace(raw, r"[\r\n\t]", ""), lambda clean: let(
            F.when(clean.startswith("/"), F.concat(F.lit("x://_"), clean)).otherwise(clean),
            lambda url: let(capture(url, _URL, 4), lambda p: build(raw, clean, p))))

    def build(raw: Column, clean: Column, p: Column) -> Column:
        part = lambda i: F.get(p, F.lit(i))
        port = F.regexp_extract(part(1), r":(\d{1,5})\z", 1).try_cast("int")
        host = F.lower(F.regexp_extract(part(1), _NETLOC, 1))
        scheme = F.when(F.contains(raw, F.lit("://")),
                        F.when(clean.startswith("/") | (part(0) == ""), "http").otherwise(F.lower(part(0))))
        return F.struct(
            raw.alias("url_string"), scheme.alias("scheme"),
            F.when((host != "") & (host != "_"), host).alias("hostname"),
            F.when(port <= 65535, port).alias("port"),
            F.when(part(2) != "", part(2)).alias("path"), F.when(part(3) != "", part(3)).alias("query_string"))
    return let(strip(text(col)), lambda s: F.when(s != "", parse(s)))


def url_host(col: Column) -> Column:
    return url_parts(col)["hostname"]


# ---------------------------------------------------------------- nested values
def variant_key(col: Column, key: str) -> Column:
    """Member of a variant object by its literal key, which may contain dots."""
    return F.try_variant_get(col, '$["' + key + '"]', "variant")


def pick(col: Column, key: str, value: str) -> Column:
    """First object of a variant list whose `key` equals `value` as text."""
    items = F.coalesce(F.try_variant_get(col, "$", "array<variant>"), F.array(col))
    return F.get(F.filter(items, lambda x: F.try_variant_get(x, '$["' + key + '"]', "string") == value), F.lit(0))


def _scalar_text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def flatten_variant_map(col: Column) -> Column:
    """MAP<STRING, VARIANT> with nested values -> MAP<STRING, STRING> with dotted keys, at any depth.

    Lists of plain values become one text joined by ', '; other lists use the position as key.
    """
    def one(e: Column) -> Column:
        kind = F.schema_of_variant(e["value"])
        leaf = F.array(F.struct(e["key"].alias("key"), _scalar_text(e["value"]).alias("value")))
        below = F.transform(flat_entries(e["value"]), lambda x: F.struct(F.concat(e["key"], x["key"]).alias("key"), x["value"].alias("value")))
        return F.when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), below).otherwise(leaf)
    return F.map_from_entries(F.flatten(F.transform(F.map_entries(col), one)))


def prune_variant(col: Column) -> Column:
    """Members of a variant object without empty ones, at any depth."""
    return prune_variant_map(F.try_variant_get(col, "$", "map<string,variant>"))
