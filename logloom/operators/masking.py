"""Masking of personal and network data in text, with the same replacement for the same value everywhere."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.convert import IPV4, ipv4_number, is_ipv6
from logloom.operators.joins import attach
from logloom.session import shared_folder

_WORD = r"\p{L}\p{N}_"
# what counts as sensitive, in the order of replacement; runs are taken whole and from their first character, so each pattern is linear
PATTERNS = {
    "mail": rf"(?<![{_WORD}.+-])[{_WORD}.+-]++@[{_WORD}-]++(?:\.[{_WORD}-]++)++",
    "uuid": r"(?<![0-9A-Za-z])[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}(?![0-9A-Za-z])",
    "sid": r"(?<![0-9A-Za-z])S-1-5-21(?:-[0-9]++){3}",
    "v6": r"(?<![0-9A-Za-z_:])(?=[0-9A-Fa-f]*+:[0-9A-Fa-f]*+:)[0-9A-Fa-f:]++(?![0-9A-Za-z_])",
    "v4": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])",
}
# what a text must hold for a kind to be possible at all; cheap to look for, and absent from most texts
_HINT = {"mail": "@", "uuid": "-[0-9a-fA-F]{4}-", "sid": "S-1-5-21-", "v6": ":[0-9a-fA-F]{0,4}:", "v4": r"[0-9]\.[0-9]"}
# fixed values: IPv4 networks that are not public
PRIVATE_NETS = ("0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24",
                "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4",
                "255.255.255.255/32")
NOT_PRIVATE = ("192.0.0.9", "192.0.0.10")
# text of the same outline as a replacement, to look for the next kind in
_STAND_IN = {"mail": "user0@masked.invalid", "uuid": "00000000-0000-8000-8000-000000000000", "sid": "S-1-5-21-4000000000-0-0"}
NET_PRIVATE, NET_PUBLIC = 10 << 24, 240 << 24  # replacements of private addresses lie in 10.0.0.0/8, those of public ones in 240.0.0.0/4


def _number(address: str) -> int:
    a, b, c, d = (int(x) for x in address.split("."))
    return ((a * 256 + b) * 256 + c) * 256 + d


def _private(number: Column) -> Column:
    hit = F.lit(False)
    for net in PRIVATE_NETS:
        base, _, bits = net.partition("/")
        hit = hit | number.between(_number(base), _number(base) + 2 ** (32 - int(bits)) - 1)
    return hit & ~number.isin(*[_number(a) for a in NOT_PRIVATE])


def _finds(text: Column, kind: str) -> Column:
    found = F.regexp_extract_all(text, F.lit(f"({PATTERNS[kind]})"), F.lit(1))
    return F.when(text.rlike(_HINT[kind]), found).when(text.isNotNull(), F.array().cast("array<string>"))


def find_sensitive(df: DataFrame, col: str) -> DataFrame:
    """Adds one count per kind: texts that look like an e-mail address, UUID, domain SID, IPv6 or IPv4 address."""
    return df.withColumns({f"n_{kind}": F.size(_finds(F.col(col), kind)) for kind in PATTERNS})


def _valid(kind: str, value: Column) -> Column:
    if kind == "v4":
        return value.rlike(rf"^{IPV4}\z")
    if kind == "v6":
        return is_ipv6(value)
    return F.lit(True)


def _token(kind: Column, n: Column) -> Column:
    """Replacement number n (from 1) of a kind; different numbers give different texts. Each keeps the outline of what it replaces; addresses beyond their network become plain words."""
    group = lambda bits: F.lower(F.hex(F.shiftright(n, bits).bitwiseAND(0xFFFF)))
    address = lambda net: F.array_join(F.array(*[F.shiftright(n + net, bits).bitwiseAND(255).cast("string") for bits in (24, 16, 8, 0)]), ".")
    inside = lambda net, bits, word: F.when(n < 2 ** bits, address(net)).otherwise(F.concat(F.lit(word), n.cast("string")))
    return (F.when(kind == "mail", F.concat(F.lit("user"), n.cast("string"), F.lit("@masked.invalid")))
            .when(kind == "uuid", F.concat(F.lit("00000000-0000-8000-8000-"), F.lpad(F.lower(F.hex(n)), 12, "0")))
            .when(kind == "sid", F.concat(F.lit("S-1-5-21-4000000000-"), F.floor(n / 10 ** 9).cast("string"), F.lit("-"), (n % 10 ** 9).cast("string")))
            .when(kind == "v6", F.concat_ws(":", F.lit("2001:db8:"), group(32), group(16), group(0)))
            .when(kind == "v4p", inside(NET_PRIVATE, 24, "private-address-"))
            .when(kind == "v4", inside(NET_PUBLIC, 28, "public-address-")))


def numbered(values: DataFrame) -> DataFrame:
    """Adds `n` to distinct (kind, value) rows: a dense number per kind in the order of the value's MD5.

    The digest spreads the values evenly, so each numbering task holds one of 4,096 slices and a small table of slice
    sizes supplies the offsets.
    """
    cut = values.withColumn("h", F.md5("value")).withColumn("s", F.substring("h", 1, 3))
    sizes = cut.groupBy("kind", "s").agg(F.count("*").alias("c"))
    before = Window.partitionBy("kind").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("kind", "s", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("o"))
    place = F.row_number().over(Window.partitionBy("kind", "s").orderBy("h", "value"))
    return cut.withColumn("p", place).join(offsets, ["kind", "s"]).select(*values.columns, (F.col("o") + F.col("p")).alias("n"))


HOT_COPIES = 100_000


def _staged(df: DataFrame, col: str, terms: Sequence[str]) -> DataFrame:
    words = sorted({t.strip() for t in terms if len(t.strip()) >= 3}, key=lambda t: (-len(t), t))
    text = F.col(col)
    for i, word in enumerate(words, 1):
        text = F.regexp_replace(text, "(?iu)" + re.sub(r"([\\.\[\]{}()*+?^$|#&~-])", r"\\\1", word), f"[TERM{i}]")
    return df.withColumn("__t", text)


def sensitive_values(df: DataFrame, col: str, id_col: str) -> DataFrame:
    """(id, kind, value) for every distinct valid find of a text, each kind looked for after the earlier ones are replaced."""
    kinds = list(PATTERNS)
    out = df.select(id_col, F.col(col).alias("__r"))
    for kind in kinds:
        kept = [F.col(k) for k in kinds[:kinds.index(kind)]]
        rest = F.when(F.col("__r").rlike(_HINT[kind]), F.regexp_replace("__r", PATTERNS[kind], _STAND_IN[kind])).otherwise(F.col("__r")) if kind in _STAND_IN else F.col("__r")
        out = out.select(id_col, *kept, F.array_distinct(_finds(F.col("__r"), kind)).alias(kind), rest.alias("__r"))
    each = out.select(id_col, F.explode(F.flatten(F.array(*[_tagged(k) for k in kinds]))).alias("f"))
    return each.select(id_col, "f.kind", "f.value")


def mask_tokens(values: DataFrame) -> DataFrame:
    """(kind, value, copies, token): the replacement of every distinct value."""
    counts = values.groupBy("kind", "value").agg(F.count("*").alias("copies"))
    return numbered(counts).select("kind", "value", "copies", _token(F.col("kind"), F.col("n")).alias("token"))


def mask(df: DataFrame, col: str, id_col: str, terms: Sequence[str] = (), to: str = "masked") -> DataFrame:
    """Adds the text with terms, e-mail addresses, UUIDs, SIDs, IPv6 and IPv4 addresses replaced.

    Look-alikes that are no address stay. Private and public IPv4 addresses are numbered apart. Each text is cut at its
    own finds and put together again, so a value inside a longer one is never touched. Texts are read twice: the finds are
    written to the shared folder, numbered and joined from there, and put in place in the second pass. Only the finds are
    shuffled: values with very many copies meet their token in a salted join of their own, the others in a plain one.
    """
    staged = _staged(df, col, terms)
    each = _written(sensitive_values(staged, "__t", id_col), "mask-finds")
    tokens = _written(mask_tokens(each), "mask-tokens")
    hot = tokens.filter(F.col("copies") > HOT_COPIES).select("kind", "value", "token")
    cold = tokens.filter(F.col("copies") <= HOT_COPIES).select("kind", "value", "token")
    tried = attach(each, hot, ["kind", "value"])
    found = tried.filter("token is not null").unionByName(tried.filter("token is null").drop("token").join(cold, ["kind", "value"]))
    pairs = found.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("value", "token"))).alias("__tokens"))  # finds of one text
    joined = staged.join(pairs, id_col, "left")
    for kind in PATTERNS:
        joined = joined.withColumn("__t", F.when(F.col("__tokens").isNotNull(), _put(F.col("__t"), kind)).otherwise(F.col("__t")))
    return joined.withColumn(to, F.col("__t")).drop("__t", "__tokens")


def _written(df: DataFrame, label: str) -> DataFrame:
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _tagged(kind: str) -> Column:
    """Valid finds of a kind as (kind, value); IPv4 addresses are told apart by network."""
    name = lambda v: F.when(_private(ipv4_number(v)), "v4p").otherwise("v4") if kind == "v4" else F.lit(kind)
    return F.transform(F.filter(F.col(kind), lambda v: _valid(kind, v)), lambda v: F.struct(name(v).alias("kind"), v.alias("value")))


def _put(text: Column, kind: str, token: Callable[[Column], Column] = lambda v: F.try_element_at(F.col("__tokens"), v)) -> Column:
    """Text with every find of the kind replaced by its token; finds without a token stay."""
    pieces = F.split(text, PATTERNS[kind], -1)
    tokens = F.transform(_finds(text, kind), lambda v: F.coalesce(token(v), v))
    return F.when(text.rlike(_HINT[kind]), F.array_join(F.zip_with(pieces, F.concat(tokens, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")).otherwise(text)


# ---------------------------------------------------------------- tokens that last between runs
ROUNDS = 8


def _keyed_hex(key: str, name: Column) -> Column:
    """64 hexadecimal digits that only the holder of the key can tell from a name."""
    return F.sha2(F.concat(F.lit(key), F.sha2(F.concat(F.lit(key), name), 256)), 256)


def _permuted(number: Column, key: str) -> Column:
    """One-to-one image of a number below 2^32 as 8 hexadecimal digits: a keyed Feistel network on its two halves."""
    start = F.struct(F.shiftright(number, 16).alias("l"), number.bitwiseAND(0xFFFF).alias("r"))

    def step(state: Column, i: Column) -> Column:
        mixed = F.conv(F.substring(_keyed_hex(key, F.concat_ws(":", F.lit("half"), i.cast("string"), state["r"].cast("string"))), 1, 4), 16, 10).cast("bigint")
        return F.struct(state["r"].alias("l"), state["l"].bitwiseXOR(mixed).alias("r"))
    word = lambda half: F.lpad(F.lower(F.hex(half)), 4, "0")
    return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), start, step, lambda state: F.concat(word(state["l"]), F.lit(":"), word(state["r"])))


def keyed_token(kind: str, value: Column, key: str) -> Column:
    """Replacement of a valid value of a kind: a function of key, kind and value alone.

    IPv4 addresses are permuted, so no two share a token; they become addresses of the documentation network 2001:db8::/32, those that are private and those that are public apart, because no reserved
    IPv4 network is large enough for all. The other kinds carry 92 bits or more of a keyed digest: with 10^10 values two share a token with a probability of 10^-8.
    Each token ends in a way that no later kind can take up.
    """
    if kind == "v4":
        n = ipv4_number(value)
        return F.concat(F.when(_private(n), "2001:db8:a::").otherwise("2001:db8:4::"), _permuted(n, key))
    digest = _keyed_hex(key, F.concat(F.lit(kind + ":"), value))
    part = lambda at, n: F.substring(digest, at, n)
    if kind == "mail":
        return F.concat(F.lit("user"), part(1, 24), F.lit("@masked.invalid"))
    if kind == "uuid":
        return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-8"), part(13, 3), F.lit("-8"), part(16, 3), F.lit("-"), part(19, 11), F.lit("a"))
    if kind == "sid":
        return F.concat_ws("-", F.lit("S-1-5-21"), *[(F.conv(part(at, 8), 16, 10).cast("bigint") + 10 ** 9).cast("string") for at in (1, 9, 17)])
    return F.concat(F.lit("2001:db8:"), *[F.concat(part(at, 4), F.lit(":")) for at in (1, 5, 9, 13, 17)], part(21, 3), F.lit("a"))


def mask_keyed(df: DataFrame, col: str, key: str, terms: Sequence[str] = (), to: str = "masked") -> DataFrame:
    """Adds the text with the same finds replaced as `mask`, by tokens that are the same in every run with the same key.

    Nothing is numbered, stored or shuffled: one pass over the texts. Other keys give unrelated tokens. The key is part of the query plan, so who may read plans may read it.
    Null texts stay null, texts without finds stay as they are.
    """
    out = _staged(df, col, terms)
    for kind in PATTERNS:
        token = lambda v, kind=kind: F.when(_valid(kind, v), keyed_token(kind, v, key))
        out = out.withColumn("__t", _put(F.col("__t"), kind, token))
    return out.withColumn(to, F.col("__t")).drop("__t")
