"""Normalisation and dispatch on whole tables, and the flagship query."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import check, fixture, table
from checks.lines import junk, lines, mixed
from logloom.operators import extract as x
from logloom.operators import normalize as n
from logloom.plans.formats_in import BY_SLUG, FORMATS, PIPE
from logloom.session import spread


@check("nrm_access_log_minutes", """select epoch_us(date_trunc('minute', ts)) // 1000000 as minute_s,
    case event_type when 'error' then 'Failure' else 'Success' end as status, case event_type when 'error' then 'Medium' else 'Informational' end as severity,
    count(*) as lines, cast(sum(event_id % 5000) as bigint) as bytes, count(distinct '198.51.100.' || (user_id % 250 + 1)) as clients from events group by 1, 2, 3""")
def flagship(spark, sf):
    parsed = n.parse_auto(spread(lines(spark, sf, "pipe")), FORMATS)
    e = F.col("event")
    flat = parsed.filter("status = 'parsed'").select(F.date_trunc("minute", e["time"]).alias("minute"), e["status"].alias("status"), e["severity"].alias("severity"),
                                                     e["http_response"]["length"].alias("length"), e["src_endpoint"]["ip"].alias("ip"))
    return flat.groupBy(F.unix_seconds("minute").alias("minute_s"), "status", "severity").agg(
        F.count("*").alias("lines"), F.sum("length").alias("bytes"), F.countDistinct("ip").alias("clients"))


@check("nrm1_normalize", """select event_id, cast(user_id as varchar) as user_name, case when user_id % 2 = 0 then 'd' || user_id end as hostname,
    user_id % 2 = 1 as no_device, cast(event_id % 5 as int) as activity_id from events""")
def nrm1(spark, sf):
    df = table(spark, sf, "events").select("event_id", "user_id")
    host = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("d"), "user_id")).otherwise("-")
    out = n.normalize(df, {"user.name": F.col("user_id"), "device.hostname": host, "activity_id": F.col("event_id") % 5})
    return out.select("event_id", F.col("event.user.name").alias("user_name"), "event.device.hostname", F.col("event.device").isNull().alias("no_device"),
                      "event.activity_id")


@check("nrm2_cases", """select event_id, case when user_id % 3 = 0 then 'third' when event_type = 'error' then 'error' when event_type = 'click' then 'click' end as parser_case,
    case when event_type = 'error' then 'Blocked' when event_type = 'click' then 'Allowed' else 'base' end as disposition,
    case when event_type = 'error' then null else 'm' || event_id end as message,
    case when user_id % 3 = 0 then 5 else 1 end as severity_id from events""")
def nrm2(spark, sf):
    df = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    base = {"disposition": F.lit("base"), "message": F.concat(F.lit("m"), "event_id"), "severity_id": F.lit(1)}
    cases = [n.Case("error", F.col("event_type") == "error", {"disposition": F.lit("Blocked")}, unset=["message"], go_on=True),
             n.Case("third", F.col("user_id") % 3 == 0, {"severity_id": F.lit(5), "disposition": F.when(F.col("event_type") == "click", "Allowed")}),
             n.Case("click", F.col("event_type") == "click", {"disposition": F.lit("Allowed")})]
    out = n.normalize(df, base, cases)
    return out.select("event_id", "event.metadata.parser_case", "event.disposition", "event.message", "event.severity_id")


@check("nrm2_apply_cases", """select event_id, case when user_id % 3 = 0 then 'third' end as parser_case, 'u' || user_id as user_name,
    case when user_id % 3 = 0 then 'x' end as domain from events""")
def nrm2_apply(spark, sf):
    df = n.normalize(table(spark, sf, "events").select("event_id", "user_id"), {"user.name": F.concat(F.lit("u"), "user_id")})
    out = n.apply_cases(df, [n.Case("third", F.col("user_id") % 3 == 0, {"user.domain": F.lit("x")})])
    return out.select("event_id", "event.metadata.parser_case", F.col("event.user.name").alias("user_name"), "event.user.domain")


@check("nrm3_unmapped", """select o_orderkey as key, 4 as n, o_orderpriority as prio, o_orderstatus as state, 'h' || (o_custkey % 50) as v0, cast(null as varchar) as dropped from orders""")
def nrm3(spark, sf):
    df = x.extract_json(spread(lines(spark, sf, "json")), "raw", "j")
    df = df.withColumn("kv", F.create_map(F.lit("state"), F.lit("-"), F.lit("late"), F.lit("y")))
    df = n.collect_unmapped(df, ["j", "kv"], drop=["id", "open.date"])
    at = lambda k, path="$": F.try_variant_get(F.try_element_at("unmapped", F.lit(k)), path, "string")
    return df.select("key", F.size("unmapped").alias("n"), at("prio").alias("prio"), at("state").alias("state"), at("items", "$[0].value").alias("v0"), at("id").alias("dropped"))


@check("nrm4_severity", """select event_id, case event_type when 'click' then 2 when 'error' then 5 when 'view' then 0 else 6 end as severity_id,
    case event_type when 'click' then 'Low' when 'error' then 'Critical' when 'view' then 'Unknown' else 'Fatal' end as severity from events""")
def nrm4(spark, sf):
    t = F.col("event_type")
    sev = F.when(t == "click", "LOW").when(t == "error", "critical").when(t == "view", "odd")
    df = n.normalize(table(spark, sf, "events").select("event_id", "event_type"), {"severity": sev, "severity_id": F.when(sev.isNull(), 6)})
    return n.derive_severity(df).select("event_id", "event.severity_id", "event.severity")


@check("nrm5_type_uid", """select event_id, case when user_id % 2 = 0 then 7 when event_type <> 'view' then 400200 + event_id % 5 end as type_uid from events""")
def nrm5(spark, sf):
    df = n.normalize(table(spark, sf, "events").select("event_id", "user_id", "event_type"), {
        "class_uid": F.when(F.col("event_type") != "view", 4002), "activity_id": F.col("event_id") % 5, "type_uid": F.when(F.col("user_id") % 2 == 0, 7)})
    return n.derive_type_uid(df).select("event_id", "event.type_uid")


@check("nrm6_require", """select event_id, case when user_id % 3 = 0 then 'required field missing: time' when event_type = 'view' then 'required field missing: user.name' end as error
    from events""")
def nrm6(spark, sf):
    df = n.normalize(table(spark, sf, "events"), {"time": F.when(F.col("user_id") % 3 != 0, F.col("ts")),
                                                  "user.name": F.when(F.col("event_type") != "view", F.col("user_id"))})
    return n.require(df, ["time", "user.name"]).select("event_id", "error")


_MIX_COUNTS = """select 'pipe' as fixture, 'access-pipe' as slug, count(*) as n from events union all select 'kv', 'order-kv', count(*) from orders
    union all select 'cef', 'sensor-cef', count(*) from events union all select 'leef', 'shipment-leef', count(*) from lineitem
    union all select 'json', 'ticket-json', count(*) from orders union all select 'junk', '', count(*) from documents"""


@check("nrm7_detect", _MIX_COUNTS)
def nrm7(spark, sf):
    df = n.detect_format(mixed(spark, sf), FORMATS)
    return df.groupBy("fixture", F.array_join("candidates", ",").alias("slug")).agg(F.count("*").alias("n"))


@check("nrm8_parse_auto", """with f as (select 'pipe' as fixture, 'access-pipe' as parser, event_id as key, epoch_us(ts) // 1000000 * 1000 as ms, cast(event_id % 5000 as varchar) as detail from events
    union all select 'kv', 'order-kv', o_orderkey, epoch_us(o_orderdate) // 1000, cast(o_custkey as varchar) from orders
    union all select 'cef', 'sensor-cef', event_id, epoch_us(ts) // 1000, 'u' || user_id from events
    union all select 'leef', 'shipment-leef', l_orderkey, epoch_us(l_shipdate) // 1000, 'part' || l_partkey from lineitem
    union all select 'json', 'ticket-json', o_orderkey, epoch_us(o_orderdate) // 1000, 'h' || (o_custkey % 50) from orders
    union all select 'junk', cast(null as varchar), doc_id, null, 'format not recognised by any active parser' from documents)
    select fixture, parser, detail, count(*) as n, cast(sum(key) as bigint) as keys, cast(sum(ms // 1000) as bigint) as seconds from f group by 1, 2, 3""")
def nrm8(spark, sf):
    df = n.parse_auto(spread(mixed(spark, sf)), FORMATS)
    e = F.col("event")
    detail = (F.when(F.col("status") == "unparsed", F.col("error")).when(F.col("fixture") == "pipe", e["http_response"]["length"].cast("string"))
              .when(F.col("fixture") == "kv", e["user"]["name"]).when(F.col("fixture") == "cef", e["actor"]["user"]["name"])
              .when(F.col("fixture") == "leef", e["dst_endpoint"]["hostname"]).otherwise(e["device"]["hostname"]))
    flat = df.select("fixture", "parser", detail.alias("detail"), "key", F.floor(F.unix_millis(e["time"]) / 1000).alias("s"))
    return flat.groupBy("fixture", "parser", "detail").agg(F.count("*").alias("n"), F.sum("key").alias("keys"), F.sum("s").alias("seconds"))


@check("nrm8_fallback", """select event_id, case when event_id % 2 = 0 then 'strict' else 'loose' end as parser, 'parsed' as status from events where event_id % 3 <> 0
    union all select event_id, null, 'unparsed' from events where event_id % 3 = 0""")
def nrm8_fallback(spark, sf):
    """Two formats recognise every line: the first fails on odd ids and the second takes over; both fail on multiples of 3."""
    df = lines(spark, sf, "pipe")
    raw = F.concat(F.lit("id="), "event_id", F.lit(" even="), F.when(F.col("event_id") % 2 == 0, "y").otherwise("n"), F.lit(" ok="), F.when(F.col("event_id") % 3 == 0, "n").otherwise("y"))

    def kv_format(slug, pattern, priority):
        return n.LogFormat(slug, lambda r: r.startswith("id="), lambda d, r: x.extract_regex(d, r, "m", pattern), lambda: {"metadata.uid": F.col("m.id")},
                           required=("metadata.uid",), priority=priority)
    formats = [kv_format("loose", r"^id=(?P<id>\d+) .*ok=y", 20), kv_format("strict", r"^id=(?P<id>\d+) even=y ok=y", 10)]
    return n.parse_auto(df.withColumn("raw", raw), formats).select("event_id", "parser", "status")


@check("nrm9_parse_with", """select event_id, 'parsed' as status, '' as error, cast(case event_type when 'error' then 500 when 'signup' then 201 when 'click' then 304 else 200 end as int) as code
    from events union all select doc_id, 'unparsed', '', null from documents""")
def nrm9(spark, sf):
    good = lines(spark, sf, "pipe").select("event_id", "raw")
    bad = junk(spark, sf).select(F.col("doc_id").alias("event_id"), "raw")
    df = n.parse_with(good.unionByName(bad), PIPE)
    error = F.when(F.col("error").rlike("^(split|regex): "), "").otherwise(F.col("error"))
    return df.select("event_id", "status", error.alias("error"), F.col("event.http_response.code").alias("code"))


@check("nrm9_disabled", """select 'unparsed' as status, 'the parser is disabled' as error, count(*) as n from events""")
def nrm9_disabled(spark, sf):
    off = n.LogFormat(PIPE.slug, PIPE.detect, PIPE.extract, PIPE.mapping, active=False)
    return n.parse_with(lines(spark, sf, "pipe"), off).groupBy("status", "error").agg(F.count("*").alias("n"))


@check("nrm10_resolve_parser", """select coalesce(u.parser, s.parser) as fixed_parser, count(*) as n, cast(sum(a.event_id) as bigint) as ids from {arrivals} a
    left join {uploads} u on a.upload_id = u.upload_id left join {sources} s on a.source_id = s.source_id group by 1""")
def nrm10(spark, sf):
    df = n.resolve_parser(fixture(spark, sf, "arrivals"), fixture(spark, sf, "uploads"), fixture(spark, sf, "sources"))
    return df.groupBy("fixed_parser").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@check("nrm10_parse_resolved", """select case when s.parser is null or s.parser = 'access-pipe' then 'access-pipe' end as parser,
    case when s.parser = 'no-such' then 'the parser is disabled' when s.parser = 'order-kv' then 'required field missing: time' else '' end as error, count(*) as n
    from events e left join {sources} s on e.user_id % 25 = s.source_id group by 1, 2""")
def nrm10_parse(spark, sf):
    ev = table(spark, sf, "events").select("event_id", (F.col("user_id") % 25).alias("source_id"))
    df = lines(spark, sf, "pipe").join(ev, "event_id").withColumn("upload_id", F.lit(None).cast("int"))
    out = n.parse_resolved(n.resolve_parser(df, fixture(spark, sf, "uploads"), fixture(spark, sf, "sources")), FORMATS)
    return out.groupBy("parser", "error").agg(F.count("*").alias("n"))


@check("nrm11_status", """select event_id, case when event_id % 2 = 0 then 'unparsed' else 'parsed' end as status,
    case when event_id % 2 = 0 then repeat(event_type, 150) else '' end as error from events""")
def nrm11(spark, sf):
    df = table(spark, sf, "events").withColumn("error", F.when(F.col("event_id") % 2 == 0, F.repeat("event_type", F.lit(150))))
    return n.finish_status(df).select("event_id", "status", "error")


@check("nrm12_parse_lines", """select event_id, true as ok, 'access-pipe' as parser, strftime(ts, '%Y-%m-%dT%H:%M:%S.000Z') || ',,,HTTP Activity,'
    || case event_type when 'purchase' then 'Post' when 'signup' then 'Put' else 'Get' end || ',' || case event_type when 'error' then 'Medium' else 'Informational' end || ','
    || case event_type when 'error' then 'Failure' else 'Success' end || ',,198.51.100.' || (user_id % 250 + 1) || ',app' || (user_id % 5) || '.example.org,,,,https://app'
    || (user_id % 5) || '.example.org/e/' || event_id || '?t=' || event_type || ',,' || case event_type when 'purchase' then 'POST' when 'signup' then 'PUT' else 'GET' end
    || ' app' || (user_id % 5) || '.example.org/e/' || event_id || '?t=' || event_type || ' '
    || case event_type when 'error' then 500 when 'signup' then 201 when 'click' then 304 else 200 end as output from events""")
def nrm12(spark, sf):
    return n.parse_lines(spread(lines(spark, sf, "pipe")), FORMATS, out="csv").select("event_id", "ok", "parser", "output")


@check("udf_surface_output_format", """select event_id, '<' || '198.51.100.' || (user_id % 250 + 1) || '> ' || strftime(ts, '%Y-%m-%dT%H:%M:%S.000Z') as line from events""")
def own_layout(spark, sf):
    from logloom.operators.render import OutputFormat, render_rows
    own = OutputFormat("short", "template", template="<{e.src_endpoint.ip}> {e.time}")
    df = n.parse_with(spread(lines(spark, sf, "pipe")), BY_SLUG["access-pipe"])
    return render_rows(df, ["short"], F.lit("short"), custom=[own]).select("event_id", F.col("value").alias("line"))
