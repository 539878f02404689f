"""Extraction jobs on whole fixture tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import check, table
from checks.lines import lines
from logloom.operators import extract as x
from logloom.session import spread

RAW = "raw"


@check("ext1_json", """select o_orderkey as key, strftime(o_orderdate, '%Y-%m-%dT00:00:00.000Z') as opened, o_orderpriority as prio,
    o_orderstatus as state, 2 as items, '' as error from orders""")
def ext1(spark, sf):
    df = lines(spark, sf, "json").withColumn("raw", F.concat(F.lit("noise before "), "raw"))
    df = x.extract_json(df, RAW, "j", seek=True)
    get = lambda p, t="string": F.try_variant_get("j", p, t)
    return df.select("key", get('$["open.date"]').alias("opened"), get("$.prio").alias("prio"), get("$.state").alias("state"),
                     F.size(get("$.items", "array<variant>")).alias("items"), F.coalesce("error", F.lit("")).alias("error"))


@check("ext2_syslog", """select event_id, 'rfc5424' as format, cast(user_id % 24 as int) as facility,
    list_value('emergency','alert','critical','error','warning','notice','informational','debug')[event_id % 8 + 1] as severity,
    strftime(make_timestamp(epoch_us(ts) // 1000 * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' as stamp, 'host' || (user_id % 5) as hostname, 'app' as app,
    cast(event_id as varchar) as procid, 'ID' || (event_id % 9) as msgid, event_type || ' done' as msg from events""")
def ext2(spark, sf):
    df = x.extract_syslog(lines(spark, sf, "5424"), RAW, "s")
    return df.select("event_id", "s.format", "s.facility", "s.severity", F.col("s.timestamp").alias("stamp"), "s.hostname", "s.app", "s.procid",
                     "s.msgid", "s.msg")


@check("ext2_syslog_bsd", """select event_id, 'rfc3164' as format, cast(user_id % 24 as int) as facility, strftime(ts, '%Y-%m-%dT%H:%M:%S.000Z') as stamp,
    'host' || (user_id % 5) as hostname, 'app' as app, cast(event_id as varchar) as procid, event_type as msg from events""")
def ext2_bsd(spark, sf):
    raw = F.concat(F.lit("<"), (8 * (F.col("user_id") % 24)).cast("string"), F.lit(">"), F.date_format("ts", "MMM"), F.lit(" "),
                   F.lpad(F.dayofmonth("ts").cast("string"), 2, " "), F.date_format("ts", " HH:mm:ss"), F.lit(" host"), (F.col("user_id") % 5).cast("string"),
                   F.lit(" app["), F.col("event_id").cast("string"), F.lit("]: "), F.col("event_type"))
    df = x.extract_syslog(table(spark, sf, "events").withColumn("raw", raw), RAW, "s", reference_year=2024)
    return df.select("event_id", "s.format", "s.facility", F.col("s.timestamp").alias("stamp"), "s.hostname", "s.app", "s.procid", "s.msg")


@check("ext3_structured_data", """select event_id, '[m@1 t="' || event_type || '"]' as sd, event_type || ' done' as msg from events""")
def ext3(spark, sf):
    return x.extract_syslog(lines(spark, sf, "5424"), RAW, "s").select("event_id", "s.sd", "s.msg")


@check("ext4_regex", """select event_id, case event_type when 'purchase' then 'POST' when 'signup' then 'PUT' else 'GET' end as method,
    cast(event_id as varchar) as id_text, event_type as kind, cast(null as varchar) as absent from events""")
def ext4(spark, sf):
    df = x.extract_regex(lines(spark, sf, "pipe"), RAW, "r", r'"(?P<method>[A-Z]+) /e/(?P<id_text>\d+)\?t=(?P<kind>\w+)(?P<absent>&x=\w+)? HTTP')
    return df.select("event_id", "r.method", "r.id_text", "r.kind", "r.absent")


@check("ext5_split", """select event_id, '198.51.100.' || (user_id % 250 + 1) as ip, 'app' || (user_id % 5) || '.example.org' as host,
    cast(event_id % 5000 as varchar) as bytes, 'agent-' || (user_id % 7) as surplus from events""")
def ext5(spark, sf):
    names = ["time", "ip", "", "host", "request", "status", "bytes", "referrer"]
    df = x.extract_split(lines(spark, sf, "pipe"), RAW, "f", "|", names, min_fields=7)
    return df.select("event_id", "f.ip", "f.host", "f.bytes", F.btrim(F.get("f._extra", F.lit(0)), F.lit('"')).alias("surplus"))


@check("ext6_kv", """select o_orderkey as key, cast(o_custkey as varchar) as cust, o_orderstatus as status, o_orderpriority as prio,
    cast(cast(round(o_totalprice * 100) as bigint) as varchar) as cents, strftime(o_orderdate, '%Y-%m-%dT00:00:00Z') as date from orders""")
def ext6(spark, sf):
    df = x.extract_kv(spread(lines(spark, sf, "kv")), RAW, "kv")
    return df.select("key", *[F.try_element_at("kv", F.lit(k)).alias(k) for k in ("cust", "status", "prio", "cents", "date")])


@check("ext7_kv_quoted", """select p_partkey as key, cast(p_partkey as varchar) as k, p_name as name, p_brand as brand, 'say "' || p_type || '" now' as note from part""")
def ext7(spark, sf):
    df = x.extract_kv_quoted(lines(spark, sf, "kvq"), RAW, "kv")
    return df.select("key", F.try_element_at("kv", F.lit("key")).alias("k"), *[F.try_element_at("kv", F.lit(k)).alias(k) for k in ("name", "brand", "note")])


@check("ext8_cef", """select event_id, 'Acme' as device_vendor, cast(event_id as varchar) as signature_id, event_type as name,
    cast(epoch_us(ts) // 1000 as varchar) as rt, 'u' || user_id as suser, event_type as kind, 'value = ' || (props->>'$.k') as msg from events""")
def ext8(spark, sf):
    df = x.extract_cef(spread(lines(spark, sf, "cef")), RAW, "c")
    return df.select("event_id", "c.device_vendor", "c.signature_id", "c.name",
                     *[F.try_element_at("c.ext", F.lit(k)).alias(k) for k in ("rt", "suser", "kind", "msg")])


@check("ext9_leef", """select l_orderkey as key, '2.1' as product_version, strftime(l_shipdate, '%Y-%m-%dT00:00:00Z') as ship,
    l_orderkey || '-' || l_linenumber as line, cast(cast(l_quantity as int) as varchar) as qty, l_returnflag as flag from lineitem""")
def ext9(spark, sf):
    df = x.extract_leef(spread(lines(spark, sf, "leef")), RAW, "l")
    return df.select("key", "l.product_version", *[F.try_element_at("l.ext", F.lit(k)).alias(k) for k in ("ship", "line", "qty", "flag")])


@check("ext10_csv", """select c_custkey as key, cast(c_custkey as varchar) as id, c_name || ', ' || c_mktsegment as name, cast(c_nationkey as varchar) as nation from customer""")
def ext10(spark, sf):
    df = x.extract_csv(lines(spark, sf, "csv"), RAW, "c", ["id", "name", "nation"])
    return df.select("key", "c.id", "c.name", "c.nation")


@check("ext11_winxml", """select event_id, '4624' as code, 'Audit' as provider, cast(event_id as varchar) as record, 'host' || (user_id % 5) as computer,
    strftime(make_timestamp(epoch_us(ts) // 1000 * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' as created, 'u' || user_id as account,
    event_type || ' & more' as kind from events""")
def ext11(spark, sf):
    df = x.extract_winxml(spread(lines(spark, sf, "winxml")), RAW, "w")
    s, d = (lambda k: F.try_element_at("w.System", F.lit(k))), (lambda k: F.try_element_at("w.EventData", F.lit(k)))
    return df.select("event_id", s("EventID").alias("code"), s("ProviderName").alias("provider"), s("EventRecordID").alias("record"), s("Computer").alias("computer"),
                     s("TimeCreatedSystemTime").alias("created"), d("TargetUserName").alias("account"), d("Kind").alias("kind"))


@check("ext11_winxml_whole", """select event_id, 'a&b' || event_id as extra, 'x>' || user_id as mark, 'S-' || user_id as security, 'é' || event_type as "first", '00FF' as "binary", 'nested ' || event_id as deep, 'raw <' || user_id || '>' as cdata from events""")
def ext11_whole(spark, sf):
    """Children of System that no schema lists, and everything in EventData and UserData."""
    e, u = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    raw = F.concat(F.lit("<?xml version='1.0'?><!-- <x> --><Event xmlns='http://schemas.microsoft.com/win/2004/08/events/event'><System><Extra>a&amp;b"), e, F.lit("</Extra><Mark of='x>"), u, F.lit("'/><Security UserID=\"S-"), u,
                   F.lit("\"></Security></System><EventData><Data>&#233;"), "event_type", F.lit("</Data><Binary>00FF</Binary></EventData><UserData><p:Outer xmlns:p='u'><p:In>nested "), e,
                   F.lit("<p:Deeper/>tail</p:In><Last><![CDATA[raw <"), u, F.lit(">]]></Last></p:Outer></UserData></Event>"))
    df = x.extract_winxml(spread(table(spark, sf, "events")).withColumn("raw", raw), RAW, "w")
    s, d = (lambda k: F.try_element_at("w.System", F.lit(k))), (lambda k: F.try_element_at("w.EventData", F.lit(k)))
    return df.select("event_id", s("Extra").alias("extra"), s("Markof").alias("mark"), s("SecurityUserID").alias("security"), d("Data1").alias("first"), d("Binary").alias("binary"), d("In").alias("deep"), d("Last").alias("cdata"))


@check("ext12_url", r"""select page_id, regexp_extract(url, '^([a-z]+)://', 1) as scheme, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) as hostname,
    nullif(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '') as path, nullif(regexp_extract(url, '\?([^#]*)', 1), '') as query_string from pages""")
def ext12(spark, sf):
    df = x.extract_url(table(spark, sf, "pages"), F.col("url"), "u")
    return df.select("page_id", "u.scheme", "u.hostname", "u.path", "u.query_string")


@check("ext13_list", """select p_partkey, len(string_split(p_name, ' ')) as n, string_split(p_name, ' ')[1] as head, string_split(p_name, ' ')[-1] as tail from part""")
def ext13(spark, sf):
    df = table(spark, sf, "part").withColumn("raw", F.replace("p_name", F.lit(" "), F.lit(" , ,")))
    return x.extract_list(df, RAW, "l").select("p_partkey", F.size("l").cast("bigint").alias("n"), F.get("l", F.lit(0)).alias("head"), F.element_at("l", -1).alias("tail"))


@check("ext14_assign", """select event_id, case when event_type = 'error' then 'E' when user_id % 2 = 0 then 'even' end as mark from events""")
def ext14(spark, sf):
    df = x.assign(table(spark, sf, "events"), "mark", F.lit("even"), F.col("user_id") % 2 == 0)
    return x.assign(df, "mark", F.lit("E"), F.col("event_type") == "error").select("event_id", "mark")


@check("ext15_mojibake", """select doc_id, text from documents""")
def ext15(spark, sf):
    return x.fix_mojibake(lines(spark, sf, "mojibake"), "raw").select("doc_id", F.col("raw").alias("text"))


@check("ext16_merge_blocks", """select o_orderkey as key, o_orderstatus as status, 'h' || (o_custkey % 50) as cust, o_orderpriority as prio from orders""")
def ext16(spark, sf):
    df = x.extract_kv(lines(spark, sf, "kv"), RAW, "a")
    second = F.create_map(F.lit("cust"), F.concat(F.lit("h"), (F.try_element_at("a", F.lit("cust")).cast("bigint") % 50).cast("string")))
    df = df.withColumn("m", x.merge_blocks(F.col("a"), second))
    return df.select("key", *[F.try_element_at("m", F.lit(k)).alias(k) for k in ("status", "cust", "prio")])
