"""Counters, dashboards, coverage and reports. All of them aggregate map-side first; no group is gathered."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.operators.joins import attach


def _count(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


# ---------------------------------------------------------------- minute counters
def minute_counters(events: DataFrame | None = None, results: DataFrame | None = None, ts: str = "received_at") -> DataFrame:
    """(minute, kind, ref_id) -> a, b, c: received/parsed/unparsed per source ('s'), sent/failed/0 per destination ('d').

    Unknown sources count under 0.
    """
    parts = []
    if events is not None:
        parts.append(events.groupBy(F.date_trunc("minute", F.col(ts)).alias("minute"), F.lit("s").alias("kind"),
                                    F.coalesce("source_id", F.lit(0)).cast("bigint").alias("ref_id"))
                     .agg(F.count("*").alias("a"), _count(F.col("status") == "parsed").alias("b"),
                          _count(F.col("status") == "unparsed").alias("c")))
    if results is not None:
        parts.append(results.groupBy(F.date_trunc("minute", F.col("at")).alias("minute"), F.lit("d").alias("kind"),
                                     F.col("destination_id").cast("bigint").alias("ref_id"))
                     .agg(_count(F.col("ok")).alias("a"), _count(~F.col("ok")).alias("b"), F.lit(0).cast("bigint").alias("c")))
    return reduce(DataFrame.unionByName, parts)


def merge_counters(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("minute", "kind", "ref_id"),
                   values: Sequence[str] = ("a", "b", "c")) -> DataFrame:
    """Counters added key by key."""
    return old.unionByName(new).groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])


def minute_series(counters: DataFrame, now: Column, minutes: int = 60, kind: str = "s", ref_id: int | None = None) -> DataFrame:
    """One row per minute up to `now`, zero where nothing was counted."""
    end = F.date_trunc("minute", now)
    rows = counters.filter((F.col("kind") == kind) & (F.col("minute") > end - F.expr(f"interval {minutes} minutes")))
    if ref_id is not None:
        rows = rows.filter(F.col("ref_id") == ref_id)
    sums = rows.groupBy("minute").agg(*[F.sum(v).cast("bigint").alias(v) for v in ("a", "b", "c")])
    axis = counters.sparkSession.range(minutes).select((end - F.make_dt_interval(mins=F.col("id").cast("int"))).alias("minute"))
    return axis.join(sums, "minute", "left").select("minute", *[F.coalesce(v, F.lit(0)).cast("bigint").alias(v) for v in ("a", "b", "c")])


def tenant_series(counters: DataFrame, sources: DataFrame, tenant_id: int, now: Column, minutes: int = 60) -> DataFrame:
    """Minute series summed over the tenant's sources."""
    own = sources.filter(F.col("tenant_id") == tenant_id).select(F.col("source_id").cast("bigint").alias("ref_id"))
    return minute_series(attach(counters.filter("kind = 's'"), own, ["ref_id"], "left_semi"), now, minutes)


# ---------------------------------------------------------------- totals
def source_totals(events: DataFrame) -> DataFrame:
    return events.filter("source_id is not null").groupBy("source_id").agg(
        F.count("*").alias("events_total"), _count(F.col("status") == "parsed").alias("parsed_total"),
        _count(F.col("status") == "unparsed").alias("unparsed_total"), F.max("received_at").alias("last_event_at"))


def merge_source_totals(old: DataFrame, new: DataFrame) -> DataFrame:
    """Stored totals plus those of a new batch; the latest arrival never moves back."""
    return old.unionByName(new).groupBy("source_id").agg(
        *[F.sum(c).alias(c) for c in ("events_total", "parsed_total", "unparsed_total")], F.max("last_event_at").alias("last_event_at"))


def upload_progress(uploads: DataFrame, events: DataFrame) -> DataFrame:
    """Parsed and unparsed lines per upload; `processing` becomes `done` when every line is counted."""
    counts = events.filter("upload_id is not null").groupBy("upload_id").agg(
        _count(F.col("status") == "parsed").alias("parsed"), _count(F.col("status") == "unparsed").alias("unparsed"))
    out = attach(uploads, counts, ["upload_id"])
    out = out.withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("parsed", "unparsed")})
    done = (F.col("status") == "processing") & (F.col("parsed") + F.col("unparsed") >= F.col("lines"))
    return out.withColumn("status", F.when(done, "done").otherwise(F.col("status")))


def dashboard(events: DataFrame, now: Column, tenant_id: int | None = None) -> DataFrame:
    """One row of arrival and coverage figures for the last 5 and 60 minutes."""
    if tenant_id is not None:
        events = events.filter(F.col("tenant_id") == tenant_id)
    recent = lambda m: F.col("received_at") > now - F.expr(f"interval {m} minutes")
    is_ = lambda s: F.col("status") == s
    k = events.agg(_count(recent(5)).alias("last5"), _count(recent(60)).alias("last60"),
                   _count(is_("parsed") & recent(60)).alias("parsed60"), _count(is_("unparsed") & recent(60)).alias("unparsed60"),
                   _count(is_("unparsed")).alias("unparsed_all"), _count(is_("received")).alias("queued"), F.count("*").alias("total"))
    both = F.col("parsed60") + F.col("unparsed60")
    return k.withColumns({"events_per_s": F.round(F.col("last5") / 300.0, 2),
                          "parsed_pct": F.when(both > 0, F.round(100.0 * F.col("parsed60") / both, 1))})


def pending_by_destination(ledger: DataFrame) -> DataFrame:
    return ledger.filter("status = 'pending'").groupBy("destination_id").agg(F.count("*").alias("pending"))


def status_counts(ledger: DataFrame, destination_id: int | None = None) -> DataFrame:
    rows = ledger if destination_id is None else ledger.filter(F.col("destination_id") == destination_id)
    return rows.groupBy("destination_id", "status").agg(F.count("*").alias("n"))


def error_groups(events: DataFrame, n: int = 30, by: Sequence[str] = ("source_id",)) -> DataFrame:
    """The n most frequent errors of unparsed lines; equal counts in the order of the group."""
    groups = events.filter("status = 'unparsed'").groupBy(*by, "error").agg(F.count("*").alias("n"))
    return groups.orderBy(F.col("n").desc(), *by, "error").limit(n)


def upload_errors(events: DataFrame, upload_id: int, n: int = 8) -> DataFrame:
    return error_groups(events.filter(F.col("upload_id") == upload_id), n, by=()).select("error", "n")


def tenant_overview(tenants: DataFrame, sources: DataFrame, destinations: DataFrame, ranges: DataFrame, users: DataFrame) -> DataFrame:
    """Sources, newest event, destinations, active ranges and users of each tenant."""
    per = lambda df, name: df.filter("tenant_id is not null").groupBy("tenant_id").agg(F.count("*").alias(name))
    src = sources.groupBy("tenant_id").agg(F.count("*").alias("sources"), F.max("last_event_at").alias("last_event_at"))
    out = tenants.select("tenant_id").join(src, "tenant_id", "left")
    for part in (per(destinations, "destinations"), per(ranges.filter("active"), "ranges"), per(users, "users")):
        out = out.join(part, "tenant_id", "left")
    return out.select("tenant_id", "last_event_at", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
                                                      for c in ("sources", "destinations", "ranges", "users")])


def parser_usage(sources: DataFrame) -> DataFrame:
    return sources.groupBy("parser").agg(F.count("*").alias("sources"))


# ---------------------------------------------------------------- coverage and quality
def coverage(parsed: DataFrame, case: Column | None = None, errors: int | None = None) -> DataFrame:
    """Rows of (section, name, n, pct): the totals, every case by name, and all errors or the `errors` most frequent.

    One aggregate over the parsed rows; the sections are cut from its few groups, so the parse runs once.
    """
    ok = F.col("status") == "parsed"
    name = case if case is not None else F.coalesce("event.metadata.parser_case", "event.class_name", F.lit("-"))
    groups = parsed.groupBy(F.coalesce(ok, F.lit(False)).alias("ok"), F.when(ok, name).otherwise(F.col("error")).alias("name")).agg(F.count("*").alias("n"))
    good = F.sum(F.when(F.col("ok"), F.col("n")).otherwise(0)).alias("p")
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t"), F.coalesce(good, F.lit(0)).alias("p")).select(
        F.explode(F.array(*[F.struct(F.lit(name).alias("name"), value.alias("n"), pct.alias("pct")) for name, value, pct in (
            ("total", F.col("t"), F.lit(None).cast("double")), ("unparsed", F.col("t") - F.col("p"), F.lit(None).cast("double")),
            ("parsed", F.col("p"), F.when(F.col("t") > 0, F.round(100.0 * F.col("p") / F.col("t"), 2)).otherwise(0.0)))])).alias("x")
    ).select(F.lit("total").alias("section"), "x.*")
    part = lambda keep, section: groups.filter(keep).select(F.lit(section).alias("section"), "name", "n", F.lit(None).cast("double").alias("pct"))
    bad = part(~F.col("ok"), "error")
    bad = bad if errors is None else bad.orderBy(F.col("n").desc(), "name").limit(errors)
    return total.unionByName(part(F.col("ok"), "case")).unionByName(bad)


def quality_report(expected: DataFrame, actual: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Expected against actual field values per case.

    `expected` holds case_id, expect_error and one text column per field (NULL: not checked); `actual` holds case_id,
    error and the same fields. A field agrees when its texts agree; an expected failure passes when the case failed.
    """
    got = actual.select("case_id", F.col("error").alias("__error"), *[F.col(f).cast("string").alias(f"__got_{f}") for f in fields])
    both = expected.join(got, "case_id", "left")
    differs = lambda f: F.col(f).isNotNull() & ~F.col(f).cast("string").eqNullSafe(F.col(f"__got_{f}"))
    diffs = F.filter(F.array(*[F.when(differs(f), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    failed = F.coalesce("__error", F.lit("")) != ""
    outcome = (F.when(F.coalesce("expect_error", F.lit(False)), F.when(failed, "passed").otherwise("accepted"))
               .when(failed, "error").when(F.size("__diffs") > 0, "different").otherwise("passed"))
    return both.withColumn("__diffs", diffs).select("case_id", outcome.alias("outcome"), F.array_join("__diffs", ",").alias("differing"))


# ---------------------------------------------------------------- usage, ranges, navigation, intake
def usage_30d(usage: DataFrame, now: Column) -> DataFrame:
    """Calls, errors and successful writes per key in the last 30 days."""
    recent = usage.filter(F.col("day") > now - F.expr("interval 30 days"))
    n, bad = F.col("count"), F.col("status") >= 400
    zero = F.lit(0)
    return recent.groupBy("key_id").agg(
        F.sum(n).cast("bigint").alias("calls"), F.sum(F.when(bad, n).otherwise(zero)).cast("bigint").alias("errors"),
        F.sum(F.when(~bad & F.col("route").rlike("^(POST|PATCH|DELETE) "), n).otherwise(zero)).cast("bigint").alias("writes"))


def record_usage(calls: DataFrame) -> DataFrame:
    """Calls counted by key, day, route (120 characters) and status."""
    return calls.groupBy("key_id", F.date_trunc("day", F.col("at")).alias("day"), F.coalesce("route", F.lit("?")).alias("route"),
                         "status").agg(F.count("*").alias("count"))


PROTOCOLS = ("tls", "tcp", "udp")


def allowed_by_protocol(ranges: DataFrame, tenants: DataFrame, sources: DataFrame, now: Column) -> DataFrame:
    """Distinct ranges per protocol, only of active tenants and active sources, one row each."""
    from logloom.operators.joins import usable_ranges
    live = usable_ranges(ranges, tenants, now)
    state = attach(live, sources.select("source_id", F.col("active").alias("__on")), ["source_id"])
    kept = state.filter(F.col("source_id").isNull() | F.coalesce("__on", F.lit(False)))
    each = kept.select(F.explode("protocols").alias("protocol"), "cidr").filter(F.col("protocol").isin(*PROTOCOLS))
    return each.distinct()


def nav_counts(events: DataFrame, destinations: DataFrame, jobs: DataFrame) -> DataFrame:
    """Unparsed events, active destinations in error and finished jobs, as one row."""
    parts = [(events, F.col("status") == "unparsed", "unparsed"), (destinations, (F.col("status") == "err") & F.col("active"), "dest_err"),
             (jobs, F.col("status") == "done", "jobs_done")]
    rows = [df.agg(_count(cond).alias("n")).select(F.lit(name).alias("name"), "n") for df, cond, name in parts]
    pick = lambda name: F.max(F.when(F.col("name") == name, F.col("n"))).alias(name)
    return reduce(DataFrame.unionByName, rows).agg(*[pick(name) for _, _, name in parts])


def ingest_stats(df: DataFrame) -> DataFrame:
    """Accepted lines per transport, and truncated, rejected and rate-limited lines, as (outcome, n).

    Needs `transport`, `truncated`, `rejected`, `rate_limited`; the limit is checked before the origin.
    """
    fate = (F.when(F.col("rate_limited"), "rate_limited").when(F.col("rejected"), "rejected")
            .otherwise(F.concat(F.lit("in_"), F.col("transport"))))
    counted = df.groupBy(fate.alias("fate"), "truncated").agg(F.count("*").alias("n"))
    each = counted.select(F.explode(F.filter(F.array(F.col("fate"), F.when(F.col("truncated"), F.lit("truncated"))),
                                             lambda x: x.isNotNull())).alias("outcome"), "n")
    return each.groupBy("outcome").agg(F.sum("n").cast("bigint").alias("n"))
