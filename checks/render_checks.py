"""Output layouts, exports, sources and streams on whole tables."""

from __future__ import annotations

from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from checks.base import check, fixture, ledger_by_destination, micros, table
from checks.lines import lines
from logloom.operators import render as o
from logloom.operators.normalize import normalize
from logloom.plans.formats_in import BY_SLUG
from logloom.session import shared_folder, spread
from logloom.sources import lines as src
from logloom.sources import sinks
from logloom.streaming import jobs as st
from logloom.streaming.pipeline import LedgerPipeline


def canon(spark, sf):
    """Canonical events of every class from the `flat` fixture, with context columns."""
    f = spread(fixture(spark, sf, "flat")).withColumn("at", F.timestamp_seconds("epoch_s"))
    c = F.col
    keep = f.select("event_id", "tenant", "source", "status", "raw", "error", "peer_ip", F.col("at").alias("received_at"), *[x for x in f.columns if x not in (
        "event_id", "tenant", "source", "status", "raw", "error", "peer_ip", "ts", "user_id")])
    out = normalize(keep, {
        "time": c("at"), "class_uid": c("cls"), "class_name": F.when(c("cls") == 4002, "HTTP Activity").otherwise(F.concat(F.lit("Class "), "cls")),
        "activity_id": c("act"), "severity_id": c("sev"), "status": c("st"), "disposition": c("disp"), "message": c("msg"),
        "metadata.product.vendor_name": F.lit("Ac|me"), "metadata.product.name": F.lit("Prod"), "metadata.event_code": c("code"), "src_endpoint.ip": c("sip"), "src_endpoint.port": c("sport"),
        "dst_endpoint.hostname": c("dhost"), "dst_endpoint.ip": c("dip"), "device.hostname": c("dev"), "device.uid": c("devid"), "user.name": c("usr"), "actor.user.name": c("actor"),
        "process.name": c("proc"), "file.path": c("path"), "http_request.url.url_string": c("url"), "http_request.url.scheme": F.when(c("url").isNotNull(), "https"),
        "http_request.http_method": F.when(c("cls") == 4002, "GET"), "malware": F.when(c("mal").isNotNull(), F.array(F.struct(c("mal").alias("name"), F.lit("x").alias("classification")))),
        "unmapped": F.create_map(F.lit("k"), c("k").cast("variant"), F.lit("n.o"), F.try_parse_json(F.lit('{"d":[1,2],"e":{"f":"x"}}'))),
    }, derive=True)
    return out


_TYPE = """case cls when 4002 then 'NETWORK_HTTP' when 4001 then 'NETWORK_CONNECTION' when 4003 then 'NETWORK_DNS' when 3002 then case when act = 2 then 'USER_LOGOUT' else 'USER_LOGIN' end
    when 3001 then case act when 1 then 'USER_CREATION' when 6 then 'USER_DELETION' when 3 then 'USER_CHANGE_PASSWORD' when 4 then 'USER_CHANGE_PASSWORD' else 'USER_UNCATEGORIZED' end
    when 3006 then case act when 6 then 'GROUP_CREATION' when 5 then 'GROUP_DELETION' else 'GROUP_MODIFICATION' end
    when 1007 then case act when 1 then 'PROCESS_LAUNCH' when 2 then 'PROCESS_TERMINATION' else 'PROCESS_UNCATEGORIZED' end
    when 1001 then case act when 1 then 'FILE_CREATION' when 2 then 'FILE_READ' when 3 then 'FILE_MODIFICATION' when 4 then 'FILE_DELETION' else 'FILE_UNCATEGORIZED' end
    when 2004 then case when mal is not null or path is not null then 'SCAN_FILE' else 'STATUS_UPDATE' end when 1008 then 'SYSTEM_AUDIT_LOG_UNCATEGORIZED'
    when 2002 then 'SCAN_VULN_HOST' else 'GENERIC_EVENT' end"""
# principal and target of each family, as far as the fixture fills them
_PARTIES = f"""select *, {_TYPE} as t,
    case when cls = 4002 then dev when cls = 3002 then null else dev end as p_host,
    case when cls = 3002 then sip when cls in (4002, 4001, 4003, 2002, 1008, 0) or (cls = 2004 and mal is null and path is null) then sip end as p_ip,
    case when cls = 4002 then dhost when cls = 3002 or (cls = 2004 and (mal is not null or path is not null)) then dev
      when cls in (3001, 3006, 1007, 1001) then null else dhost end as t_host,
    case when cls in (4002, 4001, 4003, 2002, 1008, 0) or (cls = 2004 and mal is null and path is null) then dip end as t_ip,
    case when cls in (4002, 1007, 1001) or (cls = 2004 and (mal is not null or path is not null)) then null else usr end as t_user,
    case when devid is not null then 'Ac|me:' || devid end as asset from {{flat}}"""
_ENOUGH = f"""select *, case when t = 'NETWORK_HTTP' then url is not null and (t_host is not null or t_ip is not null)
    when t = 'NETWORK_CONNECTION' then (p_host is not null or p_ip is not null or asset is not null or actor is not null)
      and (t_host is not null or t_ip is not null or usr is not null or path is not null or proc is not null)
    when t in ('USER_LOGIN', 'USER_LOGOUT') then usr is not null and (sip is not null or dev is not null or asset is not null)
    when t like 'USER\\_%' escape '\\' then usr is not null and (dev is not null or asset is not null or actor is not null)
    when t like 'GROUP%' then usr is not null and (dev is not null or asset is not null or actor is not null)
    when t like 'PROCESS%' then proc is not null and (dev is not null or asset is not null or actor is not null)
    when t = 'SCAN_FILE' then path is not null and (dev is not null or asset is not null)
    when t like 'FILE%' then path is not null and (dev is not null or asset is not null or actor is not null)
    when t in ('STATUS_UPDATE', 'SYSTEM_AUDIT_LOG_UNCATEGORIZED') then dev is not null or sip is not null or asset is not null else true end as enough from ({_PARTIES})""".replace("\\\\", "\\")


@check("out1_udm_type", f"select event_id, {_TYPE} as udm_type from {{flat}}")
def out1(spark, sf):
    return canon(spark, sf).select("event_id", o.udm_event_type(F.col("event")).alias("udm_type"))


@check("out2_udm", f"""select event_id, p_host, p_ip, t_host, t_ip, t_user, case when cls = 4002 and url is not null then 'HTTPS' when cls = 4002 then 'HTTP' end as app,
    case when cls = 3002 then case when st = 'Failure' then 'BLOCK' else 'ALLOW' end when disp = 'Allowed' then 'ALLOW' when disp = 'Blocked' then 'BLOCK' when disp = 'Quarantined' then 'QUARANTINE' end as action,
    case when cls in (2004, 3002, 3001, 3006, 1007, 2002) or disp is not null then list_value('UNKNOWN_SEVERITY', 'INFORMATIONAL', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL', 'CRITICAL')[sev + 1] end as severity,
    case when disp is not null or cls = 2004 then msg end as summary, strftime(to_timestamp(epoch_s) at time zone 'UTC', '%Y-%m-%dT%H:%M:%S.000Z') as stamp, cast(k as varchar) as extra_k,
    '1, 2' as extra_list, tenant from ({_PARTIES})""")
def out2(spark, sf):
    df = o.to_udm(canon(spark, sf)).withColumn("j", F.to_json("udm"))
    at = lambda p: F.get_json_object("j", "$." + p)
    u = lambda k: F.try_element_at("udm.additional", F.lit(k))
    return df.select("event_id", at("principal.hostname").alias("p_host"), at("principal.ip[0]").alias("p_ip"), at("target.hostname").alias("t_host"), at("target.ip[0]").alias("t_ip"),
                     at("target.user.userid").alias("t_user"), at("network.application_protocol").alias("app"), at("security_result[0].action[0]").alias("action"),
                     at("security_result[0].severity").alias("severity"), at("security_result[0].summary").alias("summary"), at("metadata.event_timestamp").alias("stamp"),
                     u("k").alias("extra_k"), u("n.o.d").alias("extra_list"), u("logloom.tenant").alias("tenant"))


@check("out3_udm_minimum", f"select event_id, case when enough then t else 'GENERIC_EVENT' end as udm_type, case when not enough then t end as original from ({_ENOUGH})")
def out3(spark, sf):
    return o.to_udm(canon(spark, sf)).select("event_id", "udm.metadata.event_type", F.try_element_at("udm.additional", F.lit("logloom.udm_type_original")).alias("original")).withColumnRenamed(
        "event_type", "udm_type")


@check("out4_unparsed", """select event_id, case when event_id % 3 = 0 then 'GENERIC_EVENT' end as udm_type, case when event_id % 3 = 0 then coalesce(peer_ip, 'logloom') end as observer,
    case when event_id % 3 = 0 then raw end as raw_text, case when event_id % 3 <> 0 then '[logloom:unparsed] ' || raw end as line from {flat} where status = 'unparsed'""")
def out4(spark, sf):
    df = canon(spark, sf).filter("status = 'unparsed'")
    df = o.render_rows(df, ["udm", "cef"], F.when(F.col("event_id") % 3 == 0, "udm").otherwise("cef"))
    at = lambda p: F.get_json_object("value", "$." + p)
    is_json = F.col("event_id") % 3 == 0
    return df.select("event_id", at("metadata.event_type").alias("udm_type"), at("observer.hostname").alias("observer"), at("additional.raw").alias("raw_text"),
                     F.when(~is_json, F.col("value")).alias("line"))


@check("out5_ocsf", """select event_id, '1.3.0' as version, strftime(to_timestamp(epoch_s) at time zone 'UTC', '%Y-%m-%dT%H:%M:%S.000Z') as stamp, cls as class_uid, sip, code, raw as raw_data,
    dev is null and devid is null as no_device, '2' as second from {flat}""")
def out5(spark, sf):
    df = canon(spark, sf).withColumn("j", o.to_ocsf(F.col("event"), F.col("raw")))
    at = lambda p: F.get_json_object("j", "$." + p)
    return df.select("event_id", at("metadata.version").alias("version"), at("time").alias("stamp"), at("class_uid").cast("int").alias("class_uid"), at("src_endpoint.ip").alias("sip"),
                     at("metadata.event_code").alias("code"), at("raw_data").alias("raw_data"), at("device").isNull().alias("no_device"), at("unmapped['n.o'].d[1]").alias("second"))


@check("out6_wazuh", """select event_id, sip as srcip, cast(sport as varchar) as srcport, actor as srcuser, usr as dstuser, url, tenant, source, cls as class_uid, coalesce(dev, dhost) as host,
    cast(sport as varchar) as d_port, mal as d_mal, 'x' as d_left from {flat}""")
def out6(spark, sf):
    df = canon(spark, sf)
    df = df.withColumn("j", o.to_wazuh(df, F.col("event")))
    at = lambda p: F.get_json_object("j", "$." + p)
    return df.select("event_id", *[at(k).alias(k) for k in ("srcip", "srcport", "srcuser", "dstuser", "url")], at("ll.tenant").alias("tenant"), at("ll.source").alias("source"),
                     at("ll.class_uid").cast("int").alias("class_uid"), at("ll.host").alias("host"), at("ll.details.src_endpoint_port").alias("d_port"),
                     at("ll.details.malware_0_name").alias("d_mal"), at("ll.details.unmapped_n_o_e_f").alias("d_left"))


@check("out7_details", """select event_id, 9 + (sip is not null)::int + (sport is not null)::int + (dhost is not null)::int + (dip is not null)::int + (dev is not null)::int
    + (devid is not null)::int + (usr is not null)::int + (actor is not null)::int + (proc is not null)::int + (path is not null)::int + 2 * (url is not null)::int + (cls = 4002)::int
    + 2 * (mal is not null)::int as n from {flat}""")
def out7(spark, sf):
    # always there: activity_id, type_uid, vendor, product, event code and three leftovers, plus the case-free remainder
    return canon(spark, sf).select("event_id", (F.size(o.details_map(F.col("event"))) + 1).alias("n"))


_CEF = """'CEF:0|Ac\\|me|Prod||' || code || '|' || case when cls = 4002 then 'HTTP Activity' else 'Class ' || cls end || '|' || list_value(0, 1, 3, 5, 8, 10, 10)[sev + 1] || '|rt=' || epoch_s || '000'
    || coalesce(' src=' || sip, '') || coalesce(' spt=' || sport, '') || coalesce(' shost=' || dev, '') || coalesce(' dst=' || dip, '') || coalesce(' dhost=' || dhost, '')
    || coalesce(' suser=' || actor, '') || coalesce(' duser=' || usr, '') || coalesce(' act=' || disp, '') || ' outcome=' || st || coalesce(' request=' || url, '')
    || case when cls = 4002 then ' requestMethod=GET' else '' end || coalesce(' filePath=' || path, '')
    || ' cat=' || case when cls = 4002 then 'HTTP Activity' else 'Class ' || cls end || ' msg=' || replace(msg, '=', '\\=') || coalesce(' deviceExternalId=' || devid, '')
    || ' cs1Label=tenant cs1=' || tenant""".replace("\\\\", "\\")
_LEEF = """'LEEF:2.0|Ac/me|Prod|1.0|' || code || '|^|devTime=' || epoch_s || '000^sev=' || list_value(0, 1, 3, 5, 8, 10, 0)[sev + 1] || coalesce('^src=' || sip, '') || coalesce('^srcPort=' || sport, '')
    || coalesce('^dst=' || dip, '') || coalesce('^usrName=' || coalesce(usr, actor), '') || coalesce('^identSrc=' || sip, '') || coalesce('^identHostName=' || dev, '')
    || coalesce('^action=' || disp, '') || '^cat=' || case when cls = 4002 then 'HTTP Activity' else 'Class ' || cls end || coalesce('^url=' || url, '')
    || case when cls = 4002 then '^method=GET' else '' end || coalesce('^dhost=' || dhost, '') || coalesce('^filePath=' || path, '') || '^msg=' || msg || '^tenant=' || tenant"""
_CSV = """strftime(to_timestamp(epoch_s) at time zone 'UTC', '%Y-%m-%dT%H:%M:%S.000Z') || ',' || tenant || ',' || source || ',' || case when cls = 4002 then 'HTTP Activity' else 'Class ' || cls end || ',,'
    || list_value('Unknown', 'Informational', 'Low', 'Medium', 'High', 'Critical', 'Fatal')[sev + 1] || ',' || st || ',' || coalesce(disp, '') || ',' || coalesce(sip, '') || ','
    || coalesce(dhost, dip, '') || ',' || coalesce(dev, '') || ',' || coalesce(usr, '') || ',' || coalesce(actor, '') || ',' || coalesce(url, '') || ',' || coalesce(path, '') || ',' || msg"""


@check("out8_cef", f"select event_id, {_CEF} as line from {{flat}}")
def out8(spark, sf):
    df = canon(spark, sf)
    return df.select("event_id", o.to_cef(df, F.col("event")).alias("line"))


@check("out9_leef", f"select event_id, {_LEEF} as line from {{flat}}")
def out9(spark, sf):
    df = canon(spark, sf)
    return df.select("event_id", o.to_leef(df, F.col("event")).alias("line"))


@check("out10_csv", f"select event_id, {_CSV} as line from {{flat}}")
def out10(spark, sf):
    df = canon(spark, sf)
    return df.select("event_id", o.to_csv_line(df, F.col("event")).alias("line"))


@check("out11_custom", """select event_id, 'who=' || coalesce(usr || ' what="the ', 'nobody what="the ') || st || '"' as kv, '{"a":{"b":"' || code || '"' || coalesce(',"c":"' || usr || '"', '') || '}}' as js,
    code || ';"a;' || st || '"' as csv, 'CEF:0|V|P|2|' || code || '|' || case when cls = 4002 then 'HTTP Activity' else 'Class ' || cls end || '|7|who=' || coalesce(usr, 'nobody') as cef,
    'LEEF:2.0|V|P|1.0|' || code || '|^|who=' || coalesce(usr, 'nobody') as leef from {flat}""")
def out11(spark, sf):
    df, e = canon(spark, sf), F.col("event")
    who = lambda ev: F.coalesce(ev["user"]["name"], F.lit("nobody"))
    forms = {
        "kv": o.OutputFormat("kv", "kv", lambda d, ev: {"who": who(ev), "what": F.concat(F.lit("the "), ev["status"])}),
        "js": o.OutputFormat("js", "json", lambda d, ev: {"a.b": ev["metadata"]["event_code"], "a.c": ev["user"]["name"]}),
        "csv": o.OutputFormat("csv1", "csv", lambda d, ev: {"s": F.concat(F.lit("a;"), ev["status"]), "c": ev["metadata"]["event_code"]}, columns=("c", "s"), delimiter=";"),
        "cef": o.OutputFormat("cef1", "cef", lambda d, ev: {"who": who(ev)}, header={"vendor": "V", "product": "P", "version": "2", "severity": 7}),
        "leef": o.OutputFormat("leef1", "leef", lambda d, ev: {"who": who(ev)}, header={"vendor": "V", "product": "P"}),
    }
    return df.select("event_id", *[o.render_custom(df, f, e).alias(n) for n, f in forms.items()])


@check("out12_syslog_frame", """select event_id, '<' || (8 * (event_id % 24) + list_value(6, 6, 5, 4, 3, 2, 1)[sev + 1]) || '>' || strftime(ts, '%b ') || lpad(cast(day(ts) as varchar), 2, ' ')
    || strftime(ts, ' %H:%M:%S logloom logloom: a b ') || msg as old, '<' || (8 + list_value(6, 6, 5, 4, 3, 2, 1)[sev + 1]) || '>1 ' || strftime(make_timestamp(epoch_us(ts) // 1000 * 1000), '%Y-%m-%dT%H:%M:%S.%g')
    || 'Z logloom logloom - - - a b ' || msg as modern from {flat}""")
def out12(spark, sf):
    f = fixture(spark, sf, "flat")
    body = F.concat(F.lit("a\nb "), "msg")
    return f.select("event_id", o.syslog_frame(body, F.col("ts"), "rfc3164", F.col("event_id") % 24, F.col("sev")).alias("old"),
                    o.syslog_frame(body, F.col("ts"), "rfc5424", 1, F.col("sev")).alias("modern"))


@check("out13_render", f"""select event_id, case when event_id % 4 = 3 then raw when status = 'unparsed' then '[logloom:unparsed] ' || raw when event_id % 4 = 0 then {_CEF} when event_id % 4 = 1 then {_LEEF}
    else {_CSV} end as value from {{flat}}""")
def out13(spark, sf):
    k = F.col("event_id") % 4
    fmt = F.when(k == 0, "cef").when(k == 1, "leef").when(k == 2, "csv").otherwise("raw")
    return o.render_rows(canon(spark, sf), ["cef", "leef", "csv", "raw"], fmt).select("event_id", "value")


# ---------------------------------------------------------------- sources and sinks
def _written(df, label):
    """Text files of a `value` column in the shared folder."""
    path = shared_folder(df.sparkSession, label)
    df.write.text(path)
    return path


FILE_EVENTS, FILE_DOCS = 2_000_000, 100_000  # rows of one file of lines


def _filed(df, key, rows):
    """Adds `file_no`: which of the files of about `rows` rows, in the order of the key, takes a row."""
    n = -(-df.count() // rows)
    cuts = sorted(set(df.approxQuantile(key, [i / n for i in range(1, n)], 1 / (4 * n)))) if n > 1 else []
    return df.withColumn("file_no", F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(key))) if cuts else F.lit(0))


def _written_files(df, key, label):
    """Text files of the `value` column, one for each `file_no`, each in the order of the key."""
    path = shared_folder(df.sparkSession, label)
    df.repartition("file_no").sortWithinPartitions("file_no", key).select("file_no", "value").write.partitionBy("file_no").text(path)
    return path


def _over_files(df, key):
    """`line_no` counted on from file to file, in the order of the key."""
    sizes = df.groupBy("file").agg(F.max("line_no").alias("n"), F.min(key).alias("first"))  # one row a file
    before = sizes.select("file", (F.sum("n").over(Window.orderBy("first")) - F.col("n")).alias("before"))
    return df.join(F.broadcast(before), "file").withColumn("line_no", F.col("line_no") + F.col("before"))


@check("src1_text_gzip", """select o_orderkey % 97 as bucket, count(*) as n, cast(sum(length(o_orderpriority)) as bigint) as size from orders group by 1""")
def src1(spark, sf):
    df = table(spark, sf, "orders").select(F.concat((F.col("o_orderkey") % 97).cast("string"), F.lit(" "), "o_orderpriority", F.lit("\r\n  ")).alias("value"))
    path = shared_folder(spark, "src1")
    df.write.option("compression", "gzip").text(path)
    raw = src.read_lines(spark, path)
    return raw.groupBy(F.substring_index("raw", " ", 1).cast("bigint").alias("bucket")).agg(F.count("*").alias("n"), F.sum(F.length("raw") - F.instr("raw", " ")).alias("size"))


@check("src1_numbered_splits", """select event_id, row_number() over (order by event_id) as line_no, event_type || ' ' || event_id || repeat('.', cast(event_id % 90 as int)) as raw from events""")
def src1_numbered(spark, sf):
    """A file in many splits, several files of large tables, blank lines between; numbers count the kept lines."""
    rows = table(spark, sf, "events").select("event_id", F.concat("event_type", F.lit(" "), "event_id", F.expr("repeat('.', cast(event_id % 90 as int))"), F.when(F.col("event_id") % 7 == 0, "\n \r\n").otherwise("\r")).alias("value"))
    path = _written_files(_filed(rows, "event_id", FILE_EVENTS), "event_id", "src1n")
    with _split_at(spark, 64 * 1024):
        read = shared_folder(spark, "src1n-read")
        src.read_lines(spark, path, numbered=True).write.parquet(read)
    back = spark.read.parquet(read).withColumn("event_id", F.regexp_extract("raw", r"^\w+ (\d+)", 1).cast("bigint"))
    return _over_files(back, "event_id").select("event_id", "line_no", "raw")


@contextmanager
def _split_at(spark, size: int):
    """File blocks of this size, so that small files are read by many tasks."""
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@check("src2_utf16", """select doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as digest from documents""")
def src2(spark, sf):
    """UTF-16 files in splits, both byte orders by their marks, whole contents."""
    one_line = F.concat_ws(" ", F.col("doc_id").cast("string"), F.trim(F.regexp_replace("text", r"\s+", " ")))
    docs, path = table(spark, sf, "documents").select("doc_id", one_line.alias("value")), shared_folder(spark, "src2")
    files = max(2, docs.count() // FILE_DOCS)
    for k, codec in enumerate(("UTF-16", "UTF-16LE")):  # the second is written without a mark, so its first line brings one
        rows = docs.filter(F.col("doc_id") % 2 == k).repartition(files, "doc_id").select("value")
        if k:
            rows = rows.mapInArrow(_marked, "value string")
        rows.write.mode("append").option("encoding", codec).option("quote", "").option("escapeQuotes", False).option("sep", "\x01").csv(path)
    with _split_at(spark, 256 * 1024):
        read = shared_folder(spark, "src2-read")
        src.read_lines(spark, path, encoding="utf-16").write.parquet(read)
    raw = spark.read.parquet(read)
    return raw.select(F.substring_index("raw", " ", 1).cast("bigint").alias("doc_id"), F.md5(F.regexp_replace("raw", r"^\S+ ?", "").cast("binary")).alias("digest"))


def _marked(batches):
    """Lines of a task with a byte-order mark before the first."""
    first = True
    for batch in batches:
        values = batch.column(0).to_pylist()
        if first and values:
            values[0], first = "\ufeff" + values[0], False
        yield pa.RecordBatch.from_arrays([pa.array(values, pa.string())], names=["value"])


@check("src3_raw_column_csv", "select c_custkey, c_name || ', \"' || c_mktsegment || '\"' as raw from customer")
def src3(spark, sf):
    path = shared_folder(spark, "src3")
    raw = F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"'))
    table(spark, sf, "customer").select("c_custkey", raw.alias("Raw Log")).write.option("header", True).option("escape", '"').csv(path)
    out = src.read_raw_column_csv(spark, path).select("raw")
    return out.select(F.regexp_extract("raw", r"#0*(\d+),", 1).cast("bigint").alias("c_custkey"), "raw")


@check("src4_json_array", """select doc_id, row_number() over (order by doc_id) as line_no, md5(text) as digest, lang, '' as error from documents""")
def src4(spark, sf):
    """One list in one file, several files of large tables, elements over several lines, read in many splits, whole contents."""
    docs = table(spark, sf, "documents").select("doc_id", F.concat(F.lit(' {"doc":\n  ['), F.col("doc_id").cast("string"), F.lit(', {"b": "],[{"}],\n "text": '), F.to_json(F.struct("text")).substr(F.lit(9), F.length("text") * 6 + 20), F.lit("\n")).alias("j"), "lang")
    docs = _filed(docs, "doc_id", FILE_DOCS)
    docs = docs.join(F.broadcast(docs.groupBy("file_no").agg(F.min("doc_id").alias("open"), F.max("doc_id").alias("last"))), "file_no")  # one row a file
    body = F.concat(F.regexp_replace("j", r"\}\n\z", ""), F.lit(', "lang": '), F.coalesce(F.concat(F.lit('"'), F.col("lang"), F.lit('"')), F.lit("null")), F.lit("}"))
    value = F.concat(F.when(F.col("doc_id") == F.col("open"), "\n[").otherwise(""), body, F.when(F.col("doc_id") == F.col("last"), "]\n").otherwise(","))
    path = _written_files(docs.select("doc_id", "file_no", value.alias("value")), "doc_id", "src4")
    with _split_at(spark, 128 * 1024):
        read = shared_folder(spark, "src4-read")
        src.read_json_array(spark, path).write.parquet(read)
    at = lambda p, t: F.try_variant_get("v", p, t)
    raw = spark.read.parquet(read).withColumn("v", F.parse_json("raw")).withColumn("doc_id", at("$.doc[0]", "bigint"))
    return _over_files(raw, "doc_id").select("doc_id", "line_no", F.md5(at("$.text", "string").cast("binary")).alias("digest"), at("$.lang", "string").alias("lang"), "error")


@check("src5_json_lines", "select o_orderkey, o_orderstatus as state from orders")
def src5(spark, sf):
    path = _written(lines(spark, sf, "json").select(F.col("raw").alias("value")), "src5")
    raw = src.read_json_lines(spark, path)
    return raw.select(F.get_json_object("raw", "$.id").cast("bigint").alias("o_orderkey"), F.get_json_object("raw", "$.state").alias("state"))


@check("src6_stream_lines", "select o_orderkey, o_orderstatus as state from orders")
def src6(spark, sf):
    path = _written(lines(spark, sf, "json").select(F.col("raw").alias("value")), "src6")
    raw = st.run_available(src.stream_lines(spark, path), "src6-out")
    return raw.select(F.get_json_object("raw", "$.id").cast("bigint").alias("o_orderkey"), F.get_json_object("raw", "$.state").alias("state"))


@check("src7_split_datagrams", """select event_id, case when event_id % 3 = 0 then event_type when event_id % 3 = 1 then event_type || chr(10) else 'b' end as raw from events
    union all select event_id, event_type from events where event_id % 3 = 2""")
def src7(spark, sf):
    k, t = F.col("event_id") % 3, F.col("event_type")
    payload = F.when(k == 0, t).when(k == 1, F.concat(t, F.lit("\n"))).otherwise(F.concat(t, F.lit("\nb\n\n")))
    return src.split_datagrams(table(spark, sf, "events").withColumn("payload", payload)).select("event_id", "raw")


@check("src8_stamp_arrival", """select doc_id, octet_length(encode(raw)) as size, md5(raw) as digest, false as truncated, 'tcp' as transport, 'received' as status, 1700000000 as at_s
    from (select doc_id, repeat(text, 40) || '.' as raw from documents)""")
def src8(spark, sf):
    """Long lines with line ends and NULs after them arrive whole."""
    raw = F.concat(F.repeat("text", F.lit(40)), F.lit(".\r\n\0\n"))
    df = src.stamp_arrival(table(spark, sf, "documents").select("doc_id", raw.alias("raw")), "tcp", F.timestamp_seconds(F.lit(1_700_000_000)))
    return df.select("doc_id", F.octet_length("raw").alias("size"), F.md5(F.col("raw").cast("binary")).alias("digest"), "truncated", "transport", "status", F.unix_seconds("received_at").alias("at_s"))


@check("src8_stamp_arrival_cut", """select doc_id, case when n > 1000 then 1000 else n end as size, n > 1000 as truncated from (select doc_id, octet_length(encode(regexp_replace(text, '[^ -~]', '', 'g'))) + 1 as n from documents)""")
def src8_cut(spark, sf):
    """A limit of 1,000 bytes, asked for."""
    raw = F.concat(F.regexp_replace("text", "[^ -~]", ""), F.lit("."))
    df = src.stamp_arrival(table(spark, sf, "documents").select("doc_id", raw.alias("raw")), "tcp", F.timestamp_seconds(F.lit(1_700_000_000)), max_bytes=1000)
    return df.select("doc_id", F.octet_length("raw").alias("size"), "truncated")


@check("snk1_export", f"""select value from (select {_CSV} as value, status from {{flat}}) where status = 'parsed'""")
def snk1(spark, sf):
    path = shared_folder(spark, "snk1")
    sinks.export(canon(spark, sf), "csv", path)
    back = spark.read.text(path)
    return back.filter(F.col("value") != o.csv_header())


@check("snk2_deliver", """select destination_id, case when destination_id % 10 = 9 then 'down' else 'sent' end as outcome, count(*) as n, cast(sum(event_id) as bigint) as ids
    from {ledger} where status = 'pending' group by 1, 2""")
def snk2(spark, sf):
    """A writer that keeps nothing: one destination in ten is down, the others accept."""
    def writer(destination, rows):
        if destination % 10 == 9:
            raise sinks.Rejected("down")
    due = ledger_by_destination(spark, sf).filter("status = 'pending'").select("shard", "event_id", "destination_id", F.concat(F.lit("line "), "event_id").alias("value"))
    res = sinks.deliver(due, writer, by=["shard"])
    outcome = F.when(F.col("ok"), "sent").otherwise(F.col("reason"))
    return res.groupBy("destination_id", outcome.alias("outcome")).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@check("str7_isolate_bad_rows", """select destination_id, case when event_id % 997 = 0 then 'failed' else 'sent' end as outcome, count(*) as n, cast(sum(event_id) as bigint) as ids
    from {ledger} where status = 'pending' group by 1, 2""")
def str7(spark, sf):
    """A writer that refuses every batch holding a bad row for good: each bad row fails alone, all others are sent."""
    def writer(destination, rows):
        if any(int(line.split()[1]) % 997 == 0 for line in rows):
            raise sinks.Rejected("refused", permanent=True)
    due = ledger_by_destination(spark, sf).filter("status = 'pending'").select("shard", "event_id", "destination_id", F.concat(F.lit("line "), "event_id").alias("value"))
    res = sinks.deliver(due, writer, by=["shard"])
    outcome = F.when(F.col("ok"), "sent").when(F.col("permanent"), "failed").otherwise("pending")
    return res.groupBy("destination_id", outcome.alias("outcome")).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@check("snk3_save_table", """select event_id, tenant_id, strftime(received_at, '%Y-%m-%d') as day, epoch_us(received_at) as at_us, md5(raw) as digest, status from {arrivals}""")
def snk3(spark, sf):
    path = shared_folder(spark, "snk3")
    sinks.save_table(fixture(spark, sf, "arrivals"), path)
    return spark.read.parquet(path).select("event_id", F.col("tenant_id").cast("bigint").alias("tenant_id"), F.date_format("date", "yyyy-MM-dd").alias("day"), micros("received_at").alias("at_us"),
                                           F.md5(F.col("raw").cast("binary")).alias("digest"), "status")


# ---------------------------------------------------------------- streams
def _events_stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return raw.withColumns({"received_at": F.col("ts").cast("timestamp"), "source_id": F.col("user_id") % 25,
                            "status": F.when(F.col("event_type") == "error", "unparsed").otherwise("parsed")})


@check("str1_stream_parse", """select 'parsed' as status, 'order-kv' as parser, count(*) as n, cast(sum(o_custkey) as bigint) as custs from orders""")
def str1(spark, sf):
    path = _written(lines(spark, sf, "kv").select(F.col("raw").alias("value")), "str1")
    parsed = st.stream_parse(src.stream_lines(spark, path), [BY_SLUG["order-kv"]])
    flat = parsed.select("status", "parser", F.col("event.user.name").cast("bigint").alias("cust"))
    return st.run_available(flat, "str1-out").groupBy("status", "parser").agg(F.count("*").alias("n"), F.sum("cust").alias("custs"))


@check("str2_stream_minute_counters", """select epoch_us(date_trunc('minute', ts)) as minute_us, user_id % 25 as ref_id, count(*) as a, count(*) filter (where event_type <> 'error') as b,
    count(*) filter (where event_type = 'error') as c from events group by 1, 2""")
def str2(spark, sf):
    """Minutes that the watermark has closed, over several micro-batches."""
    events = table(spark, sf, "events").select(F.col("ts").alias("received_at"), (F.col("user_id") % 25).alias("source_id"), F.when(F.col("event_type") == "error", "unparsed").otherwise("parsed").alias("status"))
    out = st.run_available(st.stream_minute_counters(_in_batches(spark, events, "received_at", "str2-in")), "str2")
    return out.select(micros("minute").alias("minute_us"), "ref_id", "a", "b", "c")


def _in_batches(spark, df, ts: str, label: str, parts: int = 4):
    """The rows as a stream of several micro-batches in the order of time; a last file, a day later and without a key, moves the watermark past them."""
    path = shared_folder(spark, label)
    cuts = df.agg(F.percentile_approx(F.unix_micros(F.col(ts)), [i / parts for i in range(1, parts)], 10000).alias("c")).first()["c"] or []
    place = F.size(F.filter(F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<bigint>"), lambda c: c < F.unix_micros(F.col(ts))))
    late = df.agg((F.max(ts) + F.expr("interval 1 day")).alias(ts))
    for i in range(parts):
        df.filter(place == i).coalesce(1).write.mode("append").parquet(path)
    late.select(*(F.col(ts) if c == ts else F.lit(None).cast(t).alias(c) for c, t in df.dtypes)).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


@check("str4_stream_drift", """with recursive m as (select date_trunc('minute', ts) as minute, user_id % 25 as ref_id, count(*) as a, count(*) filter (where event_type = 'error') as c from events where user_id % 25 > 0 group by 1, 2),
    t as (select ref_id, unnest(generate_series(minute, minute + interval 59 minutes, interval 1 minute)) as until, a, c from m),
    h as (select ref_id, until, sum(a) as received, sum(c) as unparsed from t group by 1, 2 having sum(a) >= 3 and 100.0 * sum(c) >= 20 * sum(a)),
    o as (select ref_id, min(until) as until from h group by 1 union all
      select o.ref_id, (select min(h.until) from h where h.ref_id = o.ref_id and h.until >= o.until + interval 6 hours) from o where o.until is not null)
    select epoch_us(h.until) as until_us, h.ref_id, cast(received as bigint) as received, cast(unparsed as bigint) as unparsed from o join h on h.ref_id = o.ref_id and h.until = o.until""")
def str4(spark, sf):
    """The batch rule asked at every minute, and quiet for six hours after an alert."""
    events = table(spark, sf, "events").select(F.col("ts").alias("received_at"), (F.col("user_id") % 25).alias("source_id"), F.when(F.col("event_type") == "error", "unparsed").otherwise("parsed").alias("status"))
    out = st.run_available(st.stream_drift(_in_batches(spark, events, "received_at", "str4-in"), min_lines=3), "str4")
    return out.select(micros("until").alias("until_us"), "ref_id", "received", "unparsed")


@check("win5_stream_dedupe", """select key, epoch_us(min(ts)) as first_us from (select concat(user_id % 25, '|', event_type) as key, ts from events) group by 1""")
def win5(spark, sf):
    """Over several micro-batches in the order of time, the first of each key stays; the window is longer than the data here."""
    items = table(spark, sf, "events").select(F.concat_ws("|", F.col("user_id") % 25, "event_type").alias("key"), "ts")
    first = items.groupBy("key", "ts").agg(F.count("*").alias("n")).select("key", "ts")
    out = st.run_available(st.stream_dedupe(_in_batches(spark, first.repartition(1).sortWithinPartitions("ts"), "ts", "win5-in"), keep="1000 hours"), "win5")
    return out.filter("key is not null").select("key", micros("ts").alias("first_us"))


@check("det2_stream_brute_force", """select distinct host, epoch_us(ts) as ts_us, failures from (select host, ts, count(*) over (partition by host order by ts range between interval 2 hours preceding and current row) as failures
    from {logins}) where failures >= 8""")
def det2(spark, sf):
    """The SQL of the batch rule, over several micro-batches."""
    out = st.run_available(st.stream_brute_force(_in_batches(spark, fixture(spark, sf, "logins"), "ts", "det2-in"), window_s=7200, least=8), "det2")
    return out.select("host", micros("ts").alias("ts_us"), "failures")


@check("str3_stream_silent_sources", """with e as (select user_id % 25 as source_id, ts, lag(ts) over (partition by user_id % 25 order by ts) as prev from events),
    s as (select *, sum(case when prev is null or ts >= prev + interval 120 minutes then 1 else 0 end) over (partition by source_id order by ts) as sid from e)
    select source_id, epoch_us(max(ts)) as silent_us, count(*) as events from s group by source_id, sid
    having max(ts) + interval 120 minutes <= (select max(ts) from events) - interval 10 minutes""")
def str3(spark, sf):
    heard = _events_stream(spark, sf).select("source_id", F.col("received_at").alias("ts"))
    out = st.run_available(st.stream_silent_sources(heard, 120), "str3")
    return out.select("source_id", micros("silent_since").alias("silent_us"), "events")


_PIPELINE = """e as (select event_id, ts, event_type, user_id % 25 as source_id, (user_id % 25) % 5 as tenant_id, event_id % 13 = 0 as junk, event_id % 4 as part, (user_id % 25) % 3 as policy from events),
    k as (select * from e where not (junk and policy = 2)),
    l as (select k.event_id, k.part, d.destination_id from k join {destinations} d on d.tenant_id = k.tenant_id and d.active where (not junk or policy = 1)
      and (d.source_ids is null or list_contains(d.source_ids, k.source_id))
      and case when junk then d.include_unparsed else case when event_type = 'error' then 3 else 1 end >= d.min_severity_id and (d.class_uids is null or list_contains(d.class_uids, 4002)) end),
    o as (select *, case when destination_id % 10 = 9 then 'pending' when event_id % 997 = 0 then 'failed' else 'sent' end as status, case when destination_id % 10 = 9 then 4 - part else 1 end as attempts from l)"""


@check("str_pipeline", f"""with {_PIPELINE} select 'ledger' as part, status, destination_id as ref_id, count(*) as n, cast(sum(event_id) as bigint) as ids, cast(sum(attempts) as bigint) as attempts from o group by 2, 3
    union all select 'events', case when junk then 'unparsed' else 'parsed' end, source_id, count(*), cast(sum(event_id) as bigint), 0 from k group by 2, 3
    union all select 'source minutes', '', source_id, count(*), count(*) filter (where not junk), count(*) filter (where junk) from k group by 3
    union all select 'destination minutes', '', destination_id, count(*) filter (where status = 'sent'), cast(sum(case when status = 'sent' then 0 else attempts end) as bigint), 0 from o group by 3""")
def str_pipeline(spark, sf):
    """Four files of lines in four micro-batches, the second handed over twice: parsed, routed, delivered, counted. One destination in ten is down, and some lines are refused for good."""
    rows = lines(spark, sf, "pipe").join(table(spark, sf, "events").select("event_id", "ts", (F.col("user_id") % 25).cast("bigint").alias("source_id")), "event_id")
    rows = rows.select("event_id", F.col("ts").alias("received_at"), (F.col("source_id") % 5).alias("tenant_id"), "source_id", F.when(F.col("event_id") % 13 == 0, F.concat(F.lit("broken "), "event_id")).otherwise(F.col("raw")).alias("raw"))
    path = shared_folder(spark, "pipeline-in")
    for part in range(4):
        rows.filter(F.col("event_id") % 4 == part).coalesce(1).write.mode("append").parquet(path)

    def writer(destination, batch):
        if destination % 10 == 9:
            raise sinks.Rejected("down")
        if any(int(line.split("/e/")[-1].split("broken ")[-1].split("?")[0]) % 997 == 0 for line in batch):
            raise sinks.Rejected("refused", permanent=True)

    pipe = LedgerPipeline(shared_folder(spark, "pipeline"), [BY_SLUG["access-pipe"]], fixture(spark, sf, "sources"), fixture(spark, sf, "destinations"), writer,
                          clock=lambda i: F.timestamp_seconds(F.lit(1_705_320_000 + 3600 * i)))

    def step(batch, i):
        for _ in range(2 if i == 1 else 1):
            pipe.step(batch, i)

    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    st.for_each_batch(stream, step, "pipeline-run").awaitTermination()
    none = F.lit(0).cast("bigint")
    ledger = pipe.ledger(spark).groupBy("status", F.col("destination_id").alias("ref_id")).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"), F.sum("attempts").alias("attempts"))
    events = pipe.events(spark).groupBy("status", F.col("source_id").alias("ref_id")).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"), none.alias("attempts"))
    counters = pipe.counters(spark).groupBy("kind", "ref_id").agg(F.sum("a").alias("n"), F.sum("b").alias("ids"), F.sum("c").alias("attempts"))
    shape = ["part", "status", "ref_id", "n", "ids", "attempts"]
    return (ledger.withColumn("part", F.lit("ledger")).select(shape).unionByName(events.withColumn("part", F.lit("events")).select(shape))
            .unionByName(counters.withColumn("part", F.when(F.col("kind") == "s", "source minutes").otherwise("destination minutes")).withColumn("status", F.lit("")).select(shape)))
