"""Joins: dimension lookups that survive hot keys, origin resolution by address range, routing and policies.

No dimension is broadcast on trust. `attach` asks the optimizer for its size bound; above the bound the small side is
copied once per salt and the large side spreads its hot keys over the salts. The bound of a table in files is the size of the
files, in which rows take a tenth of their size in memory and less, so it is kept far below what the driver may hold.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.functions.convert import address_bits, unmapped_bits
from logloom.functions.patterns import to_java

BROADCAST_BYTES = 1024 * 1024
SALTS = 16


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """True when the optimizer's upper estimate of the data size is within the limit; False when it is unknown."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= limit  # an int or a Java object, by the version of the bridge
    except AttributeError:  # a remote session does not expose the plan
        return False


def attach(df: DataFrame, dim: DataFrame, on: Sequence[str], how: str = "left", limit: int = BROADCAST_BYTES, salts: int = SALTS) -> DataFrame:
    """Equi-join of a large frame with a dimension holding at most one row per key (or a few).

    A dimension above the limit is merged: its copies are estimated by their source's files as well, so without the hint the optimizer would broadcast them.
    """
    if fits_broadcast(dim, limit):
        return df.join(F.broadcast(dim), list(on), how)
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*_spreading(df, on)), F.lit(salts)).cast("int"))
    copies = dim.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies.hint("merge"), [*on, "__salt"], how).drop("__salt")


def _spreading(df: DataFrame, keys: Sequence[str]) -> list[Column]:
    """Columns that tell rows of one key apart: all plain ones but the keys themselves."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields if f.name not in keys}
    return [F.col(f"`{n}`") for n, k in kinds.items() if k not in ("map", "variant", "struct", "array")] or [F.lit(0)]


def anti(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of `df` without a match. The other side is reduced to its distinct keys first."""
    return attach(df, other.select(*on).distinct(), on, "left_anti")


# ---------------------------------------------------------------- origin -> tenant and source
def cidr_ranges(ranges: DataFrame) -> DataFrame:
    """Adds `prefix` and the network (`family`, `high`, `low`) to a frame with a `cidr` of either family; rows that are no range are dropped."""
    out = ranges.withColumn("__bits", address_bits(F.substring_index("cidr", "/", 1)))
    longest = F.when(F.col("__bits.family") == 4, 32).when(F.col("__bits.family") == 6, 128)
    prefix = F.coalesce(F.regexp_extract("cidr", r"/(\d{1,3})\z", 1).try_cast("int"), F.when(~F.contains("cidr", F.lit("/")), longest))
    out = out.withColumn("prefix", prefix).filter(F.col("prefix").between(0, longest))
    return out.withColumns(network(F.col("__bits"), F.col("prefix"))).drop("__bits")


def network(bits: Column, prefix: Column) -> dict[str, Column]:
    """Columns of the network of an address (see `address_bits`) for a prefix length."""
    def leading(half: Column, n: Column) -> Column:
        ones = F.call_function("shiftleft", F.lit(-1).cast("bigint"), F.lit(64) - n)
        return F.when(n <= 0, F.lit(0).cast("bigint")).when(n >= 64, half).otherwise(half.bitwiseAND(ones))
    return {"family": bits["family"], "high": leading(bits["high"], prefix), "low": leading(bits["low"], prefix - 64)}


def usable_ranges(ranges: DataFrame, tenants: DataFrame, now: Column) -> DataFrame:
    """Active, unexpired ranges of active tenants."""
    live = ranges.filter(F.col("active") & (F.col("expires_at").isNull() | (F.col("expires_at") > now)))
    return live.join(tenants.filter(F.col("status") == "active").select("tenant_id"), "tenant_id", "left_semi")


def address_matches(origins: DataFrame, ranges: DataFrame, ip: str = "peer_ip") -> DataFrame:
    """Every (origin, range) pair where the range holds the address.

    An equi-join on (family, prefix length, network): each origin is expanded to its networks of the lengths in use (129 at
    the most), so no origin is compared with every range. Zones (`%eth0`) are ignored; IPv4 written as IPv6 counts as IPv4.
    """
    nets = cidr_ranges(ranges)
    wide = origins.withColumn("__bits", address_bits(F.regexp_replace(F.col(ip), "^([^%]*:[^%]*)%.+$", "$1"))).filter("__bits is not null").withColumn("__bits", unmapped_bits(F.col("__bits")))
    lengths = nets.agg(F.collect_set(F.struct("family", "prefix"))).scalar()  # at most 162 values by construction
    wide = wide.withColumn("__lengths", lengths).withColumn("__length", F.explode(F.filter("__lengths", lambda x: x["family"] == F.col("__bits.family"))))
    wide = wide.withColumn("prefix", F.col("__length.prefix")).withColumns(network(F.col("__bits"), F.col("__length.prefix"))).drop("__bits", "__lengths", "__length")
    return attach(wide, nets, ["family", "prefix", "high", "low"], "inner").drop("family", "high", "low")


KEY = 3  # characters of a lookup key


def mandatory_keys(rule: str) -> list[str]:
    """Pieces of text, lower case, that every match of a rule holds: all runs of KEY characters of its plain parts, or its longest plain part if that is shorter; [''] without any."""
    runs, now = [], ""

    def walk(parsed) -> None:
        nonlocal now
        for op, value in parsed:
            name = str(op)
            if name == "LITERAL":
                now += chr(value)
            elif name == "SUBPATTERN" and not value[1] and not value[2]:
                walk(value[3])
            elif name != "AT":  # anything else ends a run; what it may match is not looked into
                runs.append(now)
                now = ""
                if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] >= 1:
                    walk(value[2])
                    runs.append(now)
                    now = ""

    if re.compile(rule).flags & re.IGNORECASE:
        return [""]  # case pairs beyond lower case are left to the rule itself
    walk(re._parser.parse(rule))
    runs = [r.lower() for r in (*runs, now)]
    keys = sorted({r[i:i + KEY] for r in runs for i in range(len(r) - KEY + 1)})
    return keys or [max(runs, key=len)]


@F.udf(returnType=T.StructType([T.StructField("rule", T.StringType()), T.StructField("keys", T.ArrayType(T.StringType()))]), useArrow=False)
def _usable_rule(rule: str | None) -> tuple[str | None, list[str]]:
    try:
        return (to_java(rule, "U")[0], mandatory_keys(rule)) if rule else (None, [])
    except re.error:
        return None, []


def host_rules(sources: DataFrame) -> DataFrame:
    """Active syslog sources: tenant_id, source_id, match_hostname, `rule`, NULL where there is none or it is no valid expression, and `keys` (see `mandatory_keys`)."""
    live = sources.filter(F.col("active") & (F.col("transport") == "syslog"))
    return live.withColumn("__u", _usable_rule("match_hostname")).select("tenant_id", "source_id", "match_hostname", "__u.rule", "__u.keys")


def rule_matches(origins: DataFrame, rules: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`origins` (keys, tenant_id, hostname) and `__rule`, the source of each of the tenant's rules that matches the hostname.

    An equi-join on tenant and a piece of text: a rule is listed under the one of its mandatory pieces that the fewest rules share, a hostname under all its pieces of up to KEY characters. Only such
    candidates are tested. Rules without a mandatory piece are listed under '' and tested against all hostnames of their tenant.
    """
    each = rules.filter("rule is not null").select("tenant_id", F.col("source_id").alias("__rule"), "rule", F.explode("keys").alias("__key"))
    shared = each.groupBy("tenant_id", "__key").agg(F.count("*").alias("__n"))
    listed = each.join(shared, ["tenant_id", "__key"]).groupBy("tenant_id", "__rule", "rule").agg(F.min_by("__key", F.struct("__n", "__key")).alias("__key"))
    low = F.lower("hostname")
    pieces = F.concat(F.array(F.lit("")), *(_pieces(low, n) for n in range(1, KEY + 1)))
    wide = origins.withColumn("__key", F.explode(F.array_distinct(pieces)))
    return attach(wide, listed, ["tenant_id", "__key"], "inner").filter(F.expr("hostname rlike rule")).select(*keys, "__rule")


def _pieces(text: Column, n: int) -> Column:
    places = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: text.substr(i, F.lit(n)))


def resolve_origins(origins: DataFrame, ranges: DataFrame, sources: DataFrame) -> DataFrame:
    """(peer_ip, transport, hostname) -> tenant_id, source_id, for distinct origins.

    The longest range whose protocols include the transport decides the tenant. Without a source of its own, the
    tenant's syslog sources follow: lowest id whose host rule matches, else the only source without a host rule, else none. A rule that is no
    valid expression counts as none (`host_rules` shows it).
    """
    keys = ["peer_ip", "transport", "hostname"]
    owned = (address_matches(origins, ranges.withColumnRenamed("source_id", "range_source"))
             .filter(F.array_contains("protocols", F.col("transport")))
             .groupBy(*keys).agg(F.max_by(F.struct("tenant_id", "range_source"), F.struct("prefix", -F.col("range_id"))).alias("o"))
             .select(*keys, "o.tenant_id", "o.range_source"))
    rules = host_rules(sources)
    plain = (rules.filter("rule is null").groupBy("tenant_id")
             .agg(F.count("*").alias("__n"), F.min("source_id").alias("__plain"))
             .filter("__n = 1").select("tenant_id", "__plain"))
    by_host = rule_matches(owned.filter("range_source is null and hostname <> ''"), rules, keys).groupBy(*keys).agg(F.min("__rule").alias("__host_source"))
    out = attach(owned.join(by_host, keys, "left"), plain, ["tenant_id"])
    return out.select(*keys, "tenant_id", F.coalesce("range_source", "__host_source", "__plain").alias("source_id"))


def resolve_source(df: DataFrame, ranges: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds `tenant_id` and `source_id` to arriving lines (`peer_ip`, `transport`, `hostname`); unknown origins get NULL.

    Only distinct origins go through the range join, so a sender of a third of all lines costs one row there.
    """
    keys = ["peer_ip", "transport", "hostname"]
    known = resolve_origins(df.select(*keys).distinct(), ranges, sources)
    return attach(df, known, keys)


def reject_unknown(df: DataFrame, ranges: DataFrame) -> DataFrame:
    """Lines whose address and transport match no range."""
    origins = df.select("peer_ip", "transport").distinct()
    known = address_matches(origins, ranges).filter(F.array_contains("protocols", F.col("transport"))).select("peer_ip", "transport")
    return anti(df, known, ["peer_ip", "transport"])


def ip_owner_rows(df: DataFrame, ranges: DataFrame, ip: str = "peer_ip") -> DataFrame:
    """One row per distinct address and (tenant, source) that allows it, with `place`, 1 for the most specific. Nothing is gathered, so an address in any number of ranges is so many rows."""
    live = ranges.filter("active").select("cidr", "range_id", "tenant_id", "source_id")
    order = Window.partitionBy(ip).orderBy(F.col("prefix").desc(), "range_id", "tenant_id", "source_id")
    return address_matches(df.select(ip).distinct(), live, ip).select(ip, F.row_number().over(order).alias("place"), "tenant_id", "source_id")


def ip_owner(df: DataFrame, ranges: DataFrame, ip: str = "peer_ip") -> DataFrame:
    """One row per distinct address with `owners`: every (tenant, source) that allows it, most specific first."""
    live = ranges.filter("active").select("cidr", "range_id", "tenant_id", "source_id")
    order = F.struct((-F.col("prefix")).alias("rank"), "range_id", "tenant_id", "source_id")
    hits = address_matches(df.select(ip).distinct(), live, ip).groupBy(ip).agg(F.array_sort(F.collect_list(order)).alias("o"))
    return hits.select(ip, F.transform("o", lambda x: F.struct(x["tenant_id"].alias("tenant_id"), x["source_id"].alias("source_id"))).alias("owners"))


# ---------------------------------------------------------------- routing
_PROFILE = ("tenant_id", "source_id", "severity_id", "class_uid", "status")
ROUTE_PARTS = 64


def route(df: DataFrame, destinations: DataFrame) -> DataFrame:
    """One row per event and destination that takes it.

    A destination takes events of its tenant that pass its source list, and then, for parsed events, its minimum
    severity and class list; unparsed events only where it asks for them. Lists that are NULL or empty pass everything.

    The rules are tested once per destination and distinct profile of events (the five columns they read). Events then meet the lists of their profile's destinations, cut into ROUTE_PARTS parts.
    """
    live = destinations.filter("active").select(
        "tenant_id", "destination_id", F.col("source_ids").alias("__src"), F.col("min_severity_id").alias("__sev"),
        F.col("class_uids").alias("__cls"), F.col("include_unparsed").alias("__unp"))
    open_list = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    by_source = open_list("__src") | F.coalesce(F.array_contains("__src", F.col("source_id")), F.lit(False))
    by_level = F.coalesce(F.col("severity_id"), F.lit(0)) >= F.coalesce("__sev", F.lit(0))
    by_class = open_list("__cls") | F.coalesce(F.array_contains("__cls", F.col("class_uid")), F.lit(False))
    takes = by_source & F.when(F.col("status") == "unparsed", F.col("__unp")).otherwise(by_level & by_class)
    profile = F.struct(*_PROFILE).alias("__profile")  # as one value, in which NULLs are equal
    pairs = attach(df.select(*_PROFILE).distinct(), live, ["tenant_id"], "inner").filter(takes).select(profile, F.struct("destination_id").alias("__to"))
    lists = pairs.groupBy("__profile", F.pmod(F.hash("__to"), F.lit(ROUTE_PARTS)).alias("__part")).agg(F.collect_list("__to").alias("__to")).drop("__part")
    met = attach(df.withColumn("__profile", profile), lists, ["__profile"], "inner", limit=-1)
    return met.select(*[F.col(f"`{c}`") for c in df.columns], F.explode("__to").alias("__to")).select(*[F.col(f"`{c}`") for c in df.columns], "__to.destination_id")


def apply_unparsed_policy(df: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds `forward` and drops the lines their source wants dropped.

    Parsed events are forwarded (uploads only when asked to); unparsed ones only under `forward_raw`. `drop` removes
    unparsed lines that did not come from an upload.
    """
    out = attach(df, sources.select("source_id", F.col("unparsed_policy").alias("__policy")), ["source_id"])
    unparsed = F.col("status") == "unparsed"
    dropped = unparsed & (F.coalesce("__policy", F.lit("keep")) == "drop") & F.col("upload_id").isNull()
    forward = ~unparsed | (F.coalesce("__policy", F.lit("keep")) == "forward_raw")
    if "send_to_destinations" in df.columns:
        forward = forward & (F.col("upload_id").isNull() | F.coalesce("send_to_destinations", F.lit(False)))
    return out.filter(~dropped).withColumn("forward", forward).drop("__policy")


def name_context(df: DataFrame, tenants: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds the tenant and source names used by the renderers."""
    out = attach(df, tenants.select("tenant_id", F.col("name").alias("tenant")), ["tenant_id"])
    return attach(out, sources.select("source_id", F.col("name").alias("source")), ["source_id"])


def orphan_deliveries(ledger: DataFrame, events: DataFrame) -> DataFrame:
    """Finished ledger rows whose event is gone. The events' ids are hashed, so ledger rows are not sorted, and not moved where they lie by event."""
    done = ledger.filter(F.col("status").isin("sent", "failed", "dropped"))
    return done.join(events.select("event_id").hint("shuffle_hash"), "event_id", "left_anti")
