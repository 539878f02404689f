"""Joins, routing, set operations, aggregates, ranking, detection and masking on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import check, fixture, micros, now, table
from logloom.operators import joins as j
from logloom.operators import metrics as m
from logloom.sources.lines import union_arrivals


def _fx(spark, sf, *names):
    return [fixture(spark, sf, n) for n in names]


# ---------------------------------------------------------------- origin resolution
_OWNED = """select a.event_id, a.tenant_id as arrived_tenant, a.peer_ip, a.transport, a.hostname, r.tenant_id, r.source_id as range_source from {arrivals} a
    join (select *, cast(split_part(split_part(cidr, '/', 1), '.', 2) as int) as b, cast(split_part(split_part(cidr, '/', 1), '.', 3) as int) as c,
          cast(split_part(cidr, '/', 2) as int) as bits from {ranges}) r
    on cast(split_part(a.peer_ip, '.', 2) as int) = r.b and (r.bits = 16 or cast(split_part(a.peer_ip, '.', 3) as int) = r.c)
    where r.active and (r.expires_at is null or r.expires_at > {now}) and r.tenant_id <> 4 and list_contains(r.protocols, a.transport)
    qualify row_number() over (partition by a.event_id order by r.bits desc, r.range_id) = 1"""


def _usable(spark, sf):
    ranges, tenants = _fx(spark, sf, "ranges", "tenants")
    return j.usable_ranges(ranges, tenants, now())


@check("jon1_resolve_source", f"""with o as ({_OWNED}), h as (select o.event_id, min(s.source_id) as host_source from o join {{sources}} s on s.tenant_id = o.tenant_id
      where o.range_source is null and s.active and s.match_hostname <> '' and regexp_matches(o.hostname, s.match_hostname) group by 1),
    p as (select tenant_id, min(source_id) as plain from {{sources}} where active and match_hostname = '' group by 1 having count(*) = 1)
    select a.event_id, o.tenant_id, coalesce(o.range_source, h.host_source, p.plain) as source_id from {{arrivals}} a left join o on a.event_id = o.event_id
    left join h on a.event_id = h.event_id left join p on o.tenant_id = p.tenant_id""")
def jon1(spark, sf):
    arrivals, sources = _fx(spark, sf, "arrivals", "sources")
    lines = arrivals.select("event_id", "peer_ip", "transport", "hostname")
    return j.resolve_source(lines, _usable(spark, sf), sources).select("event_id", "tenant_id", "source_id")


@check("jon2_host_rule", """select e.hostname, t.tenant_id, min(s.source_id) as source_id from (select distinct 'host' || (user_id % 5) as hostname from events) e,
    {tenants} t join {sources} s on s.tenant_id = t.tenant_id where s.active and s.match_hostname <> '' and regexp_matches(e.hostname, s.match_hostname) group by 1, 2""")
def jon2(spark, sf):
    """One range per tenant without a source: the host rule alone decides."""
    sources, tenants = _fx(spark, sf, "sources", "tenants")
    hosts = table(spark, sf, "events").select(F.concat(F.lit("host"), F.col("user_id") % 5).alias("hostname")).distinct()
    ranges = tenants.select("tenant_id", (F.col("tenant_id") + 1).alias("range_id"), F.lit(None).cast("int").alias("source_id"),
                            F.concat(F.lit("10."), "tenant_id", F.lit(".0.0/16")).alias("cidr"), F.array(F.lit("tcp")).alias("protocols"))
    ips = tenants.select(F.concat(F.lit("10."), "tenant_id", F.lit(".9.9")).alias("peer_ip"), F.lit("tcp").alias("transport"), F.explode(F.array(
        *[F.lit(f"host{i}") for i in range(5)])).alias("hostname"))
    origins = ips.join(hosts, "hostname")
    ruled = sources.filter("match_hostname <> ''")
    return j.resolve_origins(origins, ranges, ruled).filter("source_id is not null").select("hostname", "tenant_id", "source_id")


@check("jon3_only_plain_source", """select a.event_id, p.source_id from {arrivals} a left join (select tenant_id, min(source_id) as source_id from {sources}
    where active and match_hostname = '' group by 1 having count(*) = 1) p on p.tenant_id = cast(split_part(a.peer_ip, '.', 2) as int)""")
def jon3(spark, sf):
    """Lines without a host name under ranges without a source."""
    arrivals, sources, tenants = _fx(spark, sf, "arrivals", "sources", "tenants")
    ranges = tenants.select("tenant_id", F.col("tenant_id").alias("range_id"), F.lit(None).cast("int").alias("source_id"),
                            F.concat(F.lit("10."), "tenant_id", F.lit(".0.0/16")).alias("cidr"), F.array(*[F.lit(p) for p in m.PROTOCOLS]).alias("protocols"))
    lines = arrivals.select("event_id", "peer_ip", "transport", F.lit("").alias("hostname"))
    return j.resolve_source(lines, ranges, sources).select("event_id", "source_id")


@check("jon4_reject_unknown", f"""select event_id from {{arrivals}} where event_id not in (select event_id from ({_OWNED}))""")
def jon4(spark, sf):
    return j.reject_unknown(fixture(spark, sf, "arrivals"), _usable(spark, sf)).select("event_id")


@check("jon5_ip_owner", """with ips as (select distinct peer_ip from {arrivals}) select peer_ip, string_agg(r.tenant_id || ':' || coalesce(cast(r.source_id as varchar), '-'), ','
    order by cast(split_part(cidr, '/', 2) as int) desc, r.range_id) as owners from ips join {ranges} r on r.active
    and cast(split_part(peer_ip, '.', 2) as int) = cast(split_part(cidr, '.', 2) as int)
    and (cidr like '%/16' or cast(split_part(peer_ip, '.', 3) as int) = cast(split_part(cidr, '.', 3) as int)) group by 1""")
def jon5(spark, sf):
    arrivals, ranges = _fx(spark, sf, "arrivals", "ranges")
    out = j.ip_owner(arrivals, ranges)
    text = F.transform("owners", lambda o: F.concat(o["tenant_id"], F.lit(":"), F.coalesce(o["source_id"].cast("string"), F.lit("-"))))
    return out.select("peer_ip", F.array_join(text, ",").alias("owners"))


@check("jon5_ip_owner_rows", """with ips as (select distinct peer_ip from {arrivals}) select peer_ip, row_number() over (partition by peer_ip order by cast(split_part(cidr, '/', 2) as int) desc, r.range_id) as place, r.tenant_id, r.source_id
    from ips join {ranges} r on r.active and cast(split_part(peer_ip, '.', 2) as int) = cast(split_part(cidr, '.', 2) as int)
    and (cidr like '%/16' or cast(split_part(peer_ip, '.', 3) as int) = cast(split_part(cidr, '.', 3) as int))""")
def jon5_rows(spark, sf):
    return j.ip_owner_rows(*_fx(spark, sf, "arrivals", "ranges"))


_ROUTED = """select e.event_id, d.destination_id from {arrivals} e join {destinations} d on d.tenant_id = e.tenant_id
    where d.active and (d.source_ids is null or list_contains(d.source_ids, e.source_id)) and case when e.status = 'unparsed' then d.include_unparsed
    else e.severity_id >= d.min_severity_id and (d.class_uids is null or list_contains(d.class_uids, e.class_uid)) end"""


@check("jon6_route", f"select destination_id, count(*) as n, cast(sum(event_id) as bigint) as ids from ({_ROUTED}) group by 1")
def jon6(spark, sf):
    out = j.route(*_fx(spark, sf, "arrivals", "destinations"))
    return out.groupBy("destination_id").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@check("jon7_unparsed_policy", """select a.event_id, (a.status <> 'unparsed' or s.unparsed_policy = 'forward_raw') and (a.upload_id is null or coalesce(u.send_to_destinations, false)) as forward
    from {arrivals} a left join {sources} s on a.source_id = s.source_id left join {uploads} u on a.upload_id = u.upload_id
    where not (a.status = 'unparsed' and s.unparsed_policy = 'drop' and a.upload_id is null)""")
def jon7(spark, sf):
    arrivals, sources, uploads = _fx(spark, sf, "arrivals", "sources", "uploads")
    df = j.attach(arrivals, uploads.select("upload_id", "send_to_destinations"), ["upload_id"])
    return j.apply_unparsed_policy(df, sources).select("event_id", "forward")


@check("jon8_due_deliveries", """select l.destination_id, l.event_id from {ledger} l join events e on e.event_id = l.event_id
    join {destinations} d on d.destination_id = l.destination_id and d.active and d.destination_id % 7 <> 2 where l.status = 'pending' and l.next_attempt_at <= {now}""")
def jon8(spark, sf):
    from logloom.operators.ranking import due_deliveries
    paused = F.when(F.col("destination_id") % 7 == 2, now() + F.expr("interval 1 hour")).when(F.col("destination_id") % 7 == 3, now())
    destinations = fixture(spark, sf, "destinations").withColumn("paused_until", paused)
    return due_deliveries(fixture(spark, sf, "ledger"), table(spark, sf, "events"), now(), destinations=destinations).select("destination_id", "event_id")


@check("jon9_orphans", """select l.event_id, l.destination_id from {ledger} l where l.status in ('sent', 'failed') and l.event_id not in (select 2 * event_id from events)""")
def jon9(spark, sf):
    events = table(spark, sf, "events").withColumn("event_id", 2 * F.col("event_id"))
    return j.orphan_deliveries(fixture(spark, sf, "ledger"), events).select("event_id", "destination_id")


@check("jon10_name_context", """select a.event_id, t.name as tenant, s.name as source from {arrivals} a left join {tenants} t on a.tenant_id = t.tenant_id
    left join {sources} s on a.source_id = s.source_id""")
def jon10(spark, sf):
    return j.name_context(*_fx(spark, sf, "arrivals", "tenants", "sources")).select("event_id", "tenant", "source")


@check("jon_attach_salted", """select n.n_name as name, count(*) as n, cast(sum(event_id) as bigint) as ids from events e left join nation n on e.user_id % 30 = n.n_nationkey group by 1""")
def attach_salted(spark, sf):
    """The way taken when a dimension is too large to broadcast."""
    df = table(spark, sf, "events").withColumn("n_nationkey", (F.col("user_id") % 30).cast("int"))
    out = j.attach(df, table(spark, sf, "nation").select("n_nationkey", "n_name"), ["n_nationkey"], limit=-1)
    return out.groupBy(F.col("n_name").alias("name")).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


# ---------------------------------------------------------------- set operations
@check("set1_union_arrivals", """select transport, count(*) as n, count(upload_id) as with_upload, cast(sum(event_id) as bigint) as ids from (
    select transport, event_id, null as upload_id from {arrivals} union all select 'upload', o_orderkey, o_orderkey % 20 from orders union all select 'api', p_partkey, null from part) group by 1""")
def set1(spark, sf):
    syslog = fixture(spark, sf, "arrivals").select("event_id", "transport", "peer_ip", "raw")
    upload = table(spark, sf, "orders").select(F.col("o_orderkey").alias("event_id"), F.lit("upload").alias("transport"), (F.col("o_orderkey") % 20).alias("upload_id"))
    api = table(spark, sf, "part").select(F.col("p_partkey").alias("event_id"), F.lit("api").alias("transport"))
    return union_arrivals(syslog, upload, api).groupBy("transport").agg(F.count("*").alias("n"), F.count("upload_id").alias("with_upload"), F.sum("event_id").alias("ids"))


@check("set2_distinct_ranges", """select distinct unnest(protocols) as protocol, cidr from {ranges}""")
def set2(spark, sf):
    return fixture(spark, sf, "ranges").select(F.explode("protocols").alias("protocol"), "cidr").distinct()


@check("set3_not_seen", """select key, seq from {items} where key not in (select 'k' || event_id from events where event_id % 3 = 0)""")
def set3(spark, sf):
    seen = table(spark, sf, "events").filter("event_id % 3 = 0").select(F.concat(F.lit("k"), "event_id").alias("key"))
    return j.anti(fixture(spark, sf, "items"), seen, ["key"]).select("key", "seq")


# ---------------------------------------------------------------- aggregates
_COUNTERS = '''select epoch_us(date_trunc('minute', received_at)) as minute_us, 's' as kind, source_id as ref_id, count(*) as a, count(*) filter (where status = 'parsed') as b,
    count(*) filter (where status = 'unparsed') as c from {arrivals} group by 1, 2, 3
    union all select epoch_us(date_trunc('minute', "at")), 'd', destination_id, count(*) filter (where ok), count(*) filter (where not ok), 0 from {attempts} group by 1, 2, 3'''


def _counters(spark, sf):
    return m.minute_counters(*_fx(spark, sf, "arrivals", "attempts"))


@check("agg1_minute_counters", _COUNTERS)
def agg1(spark, sf):
    return _counters(spark, sf).select(micros("minute").alias("minute_us"), "kind", "ref_id", "a", "b", "c")


@check("agg2_merge_counters", f"""select minute_us, kind, ref_id, cast(sum(a) as bigint) as a, cast(sum(b) as bigint) as b, cast(sum(c) as bigint) as c from (select * from ({_COUNTERS})
    union all select * from ({_COUNTERS}) where kind = 's') group by 1, 2, 3""")
def agg2(spark, sf):
    new = m.minute_counters(fixture(spark, sf, "arrivals"))
    return m.merge_counters(_counters(spark, sf), new).select(micros("minute").alias("minute_us"), "kind", "ref_id", "a", "b", "c")


@check("agg3_source_totals", """select source_id, 2 * count(*) as events_total, 2 * count(*) filter (where status = 'parsed') as parsed_total,
    2 * count(*) filter (where status = 'unparsed') as unparsed_total, epoch_us(max(received_at)) as last_us from {arrivals} group by 1""")
def agg3(spark, sf):
    totals = m.source_totals(fixture(spark, sf, "arrivals"))
    return m.merge_source_totals(totals, totals).select("source_id", "events_total", "parsed_total", "unparsed_total", micros("last_event_at").alias("last_us"))


@check("agg4_upload_progress", """select u.upload_id, count(a.event_id) filter (where a.status = 'parsed') as parsed, count(a.event_id) filter (where a.status = 'unparsed') as unparsed,
    case when u.status = 'processing' and count(a.event_id) filter (where a.status <> 'received') >= u.lines then 'done' else u.status end as status
    from {uploads} u left join {arrivals} a on a.upload_id = u.upload_id group by u.upload_id, u.status, u.lines""")
def agg4(spark, sf):
    return m.upload_progress(*_fx(spark, sf, "uploads", "arrivals")).select("upload_id", "parsed", "unparsed", "status")


@check("agg5_dashboard", """select tenant, count(*) filter (where received_at > {now} - interval 5 minutes) as last5, count(*) filter (where received_at > {now} - interval 60 minutes) as last60,
    count(*) filter (where status = 'parsed' and received_at > {now} - interval 60 minutes) as parsed60,
    count(*) filter (where status = 'unparsed' and received_at > {now} - interval 60 minutes) as unparsed60, count(*) filter (where status = 'unparsed') as unparsed_all,
    count(*) filter (where status = 'received') as queued, count(*) as total, round(last5 / 300.0, 2) as events_per_s,
    case when parsed60 + unparsed60 > 0 then round(100.0 * parsed60 / (parsed60 + unparsed60), 1) end as parsed_pct
    from (select 'all' as tenant, * from {arrivals} union all select 'two', * from {arrivals} where tenant_id = 2) group by 1""")
def agg5(spark, sf):
    a = fixture(spark, sf, "arrivals")
    one = lambda name, t: m.dashboard(a, now(), t).withColumn("tenant", F.lit(name))
    return one("all", None).unionByName(one("two", 2))


_SERIES = """with axis as (select unnest(generate_series({now} - interval 59 minutes, {now}, interval 1 minute)) as minute)
    select epoch_us(x.minute) as minute_us, count(r.received_at) as a, count(r.received_at) filter (where r.status = 'parsed') as b,
    count(r.received_at) filter (where r.status = 'unparsed') as c from axis x left join (select * from {arrivals} where %s) r
    on date_trunc('minute', r.received_at) = x.minute group by 1"""


@check("agg6_minute_series", _SERIES % "source_id = 3")
def agg6(spark, sf):
    return m.minute_series(_counters(spark, sf), now(), ref_id=3).select(micros("minute").alias("minute_us"), "a", "b", "c")


@check("agg7_tenant_series", _SERIES % "source_id % 5 = 2")
def agg7(spark, sf):
    return m.tenant_series(_counters(spark, sf), fixture(spark, sf, "sources"), 2, now()).select(micros("minute").alias("minute_us"), "a", "b", "c")


@check("agg8_pending", "select destination_id, count(*) as pending from {ledger} where status = 'pending' group by 1")
def agg8(spark, sf):
    return m.pending_by_destination(fixture(spark, sf, "ledger"))


@check("agg8_status_counts", "select destination_id, status, count(*) as n from {ledger} group by 1, 2")
def agg8b(spark, sf):
    return m.status_counts(fixture(spark, sf, "ledger"))


@check("agg9_error_groups", "select source_id, error, count(*) as n from {arrivals} where status = 'unparsed' group by 1, 2 order by n desc, source_id, error limit 30")
def agg9(spark, sf):
    return m.error_groups(fixture(spark, sf, "arrivals"))


@check("agg9_upload_errors", "select error, count(*) as n from {arrivals} where status = 'unparsed' and upload_id = 3 group by 1 order by n desc, error limit 8")
def agg9b(spark, sf):
    return m.upload_errors(fixture(spark, sf, "arrivals"), 3)


@check("agg10_tenant_overview", """select t.tenant_id, (select count(*) from {sources} s where s.tenant_id = t.tenant_id) as sources,
    (select epoch_us(max(received_at)) from {arrivals} a where a.source_id % 5 = t.tenant_id) as last_us, (select count(*) from {destinations} d where d.tenant_id = t.tenant_id) as destinations,
    (select count(*) from {ranges} r where r.active and r.tenant_id = t.tenant_id) as ranges, (select count(*) from customer c where c.c_nationkey % 5 = t.tenant_id) as users from {tenants} t""")
def agg10(spark, sf):
    tenants, sources, destinations, ranges, arrivals = _fx(spark, sf, "tenants", "sources", "destinations", "ranges", "arrivals")
    heard = sources.join(m.source_totals(arrivals).select("source_id", "last_event_at"), "source_id", "left")
    users = table(spark, sf, "customer").select((F.col("c_nationkey") % 5).alias("tenant_id"))
    return m.tenant_overview(tenants, heard, destinations, ranges, users).select("tenant_id", "sources", micros("last_event_at").alias("last_us"), "destinations", "ranges", "users")


@check("agg11_parser_usage", "select parser, count(*) as sources from {sources} group by 1")
def agg11(spark, sf):
    return m.parser_usage(fixture(spark, sf, "sources"))


@check("agg12_coverage", """with t as (select count(*) as t, count(*) filter (where status = 'parsed') as p from {arrivals})
    select 'total' as section, 'total' as name, t as n, null as pct from t union all select 'total', 'parsed', p, round(100.0 * p / t, 2) from t union all select 'total', 'unparsed', t - p, null from t
    union all select 'case', 'class ' || class_uid, count(*), null from {arrivals} where status = 'parsed' group by 2
    union all select * from (select 'error', error, count(*) as n, null from {arrivals} where status <> 'parsed' group by 2)""")
def agg12(spark, sf):
    return m.coverage(fixture(spark, sf, "arrivals"), F.concat(F.lit("class "), "class_uid"))


@check("agg13_usage_30d", """select key_id, cast(sum(count) as bigint) as calls, cast(coalesce(sum(count) filter (where status >= 400), 0) as bigint) as errors,
    cast(coalesce(sum(count) filter (where status < 400 and regexp_matches(route, '^(POST|PATCH|DELETE) ')), 0) as bigint) as writes from {usage}
    where day > timestamp '2024-02-10 00:00:00' - interval 30 days group by 1""")
def agg13(spark, sf):
    return m.usage_30d(fixture(spark, sf, "usage"), F.expr("timestamp '2024-02-10 00:00:00'"))


@check("agg13_record_usage", """select key_id, epoch_us(date_trunc('day', day)) as day_us, route, status, count(*) as n from {usage} group by 1, 2, 3, 4""")
def agg13b(spark, sf):
    calls = fixture(spark, sf, "usage").select("key_id", F.col("day").alias("at"), "route", "status")
    return m.record_usage(calls).select("key_id", micros("day").alias("day_us"), "route", "status", F.col("count").alias("n"))


@check("agg14_allowed_by_protocol", """select distinct p.protocol, r.cidr from {ranges} r, unnest(r.protocols) as p(protocol) where r.active and (r.expires_at is null or r.expires_at > {now})
    and r.tenant_id <> 4 and (r.source_id is null or r.source_id in (select source_id from {sources} where active))""")
def agg14(spark, sf):
    return m.allowed_by_protocol(*_fx(spark, sf, "ranges", "tenants", "sources"), now())


@check("agg15_nav_counts", """select (select count(*) from {arrivals} where status = 'unparsed') as unparsed, (select count(*) from {destinations} where status = 'err' and active) as dest_err,
    (select count(*) from orders where o_orderstatus = 'F') as jobs_done""")
def agg15(spark, sf):
    jobs = table(spark, sf, "orders").select(F.when(F.col("o_orderstatus") == "F", "done").otherwise("open").alias("status"))
    return m.nav_counts(*_fx(spark, sf, "arrivals", "destinations"), jobs)


@check("agg16_ingest_stats", """select case when event_id % 13 = 0 then 'rate_limited' when event_id % 7 = 0 then 'rejected' else 'in_' || transport end as outcome, count(*) as n from {arrivals} group by 1
    union all select 'truncated', count(*) from {arrivals} where event_id % 11 = 0""")
def agg16(spark, sf):
    e = F.col("event_id")
    return m.ingest_stats(fixture(spark, sf, "arrivals").withColumns({"truncated": e % 11 == 0, "rejected": e % 7 == 0, "rate_limited": e % 13 == 0}))


@check("agg17_quality", """select event_id as case_id, case when event_id % 10 = 0 and event_id % 4 = 0 then 'passed' when event_id % 10 = 0 then 'accepted' when event_id % 4 = 0 then 'error'
    when event_id % 3 = 0 then 'different' else 'passed' end as outcome, case when event_id % 3 = 0 then 'user_id' else '' end as differing from events""")
def agg17(spark, sf):
    e = table(spark, sf, "events")
    i = F.col("event_id")
    expected = e.select(i.alias("case_id"), (i % 10 == 0).alias("expect_error"), F.when(i % 3 == 0, "other").otherwise(F.col("user_id").cast("string")).alias("user_id"),
                        F.when(i % 2 == 0, F.col("event_type")).alias("event_type"))
    actual = e.select(i.alias("case_id"), F.when(i % 4 == 0, "bad").otherwise("").alias("error"), "user_id", "event_type")
    return m.quality_report(expected, actual, ["user_id", "event_type"])
