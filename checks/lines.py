"""Raw lines built from the driver tables, so that parsing them again can be compared with the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.base import table

_KEEP = {"pipe": "event_id", "cef": "event_id", "5424": "event_id", "winxml": "event_id", "kv": "o_orderkey as key", "json": "o_orderkey as key",
         "kvq": "p_partkey as key", "csv": "c_custkey as key", "leef": "l_orderkey as key", "mojibake": "doc_id"}

_SQL = {
    "pipe": ("events", r"""concat(date_format(ts, 'dd/MMM/yyyy:HH:mm:ss'), ' +0000 | 198.51.100.', user_id % 250 + 1, ' | - | "app', user_id % 5,
        '.example.org" | "', case event_type when 'purchase' then 'POST' when 'signup' then 'PUT' else 'GET' end, ' /e/', event_id, '?t=', event_type,
        ' HTTP/1.1" | ', case event_type when 'error' then 500 when 'signup' then 201 when 'click' then 304 else 200 end, ' | ', event_id % 5000,
        ' | "-" | "agent-', user_id % 7, '"')"""),
    "kv": ("orders", r"""concat('order=', o_orderkey, ' cust=', o_custkey, ' status="', o_orderstatus, '" prio=\'', o_orderpriority, '\' cents=',
        cast(round(o_totalprice * 100) as bigint), ' date=', date_format(o_orderdate, 'yyyy-MM-dd'), 'T00:00:00Z')"""),
    "kvq": ("part", r"""concat('[part@0 key="', p_partkey, '" name="', p_name, '" brand="', p_brand, '" note="say "', p_type, '" now"]')"""),
    "cef": ("events", r"""concat('CEF:0|Acme|Sensor|1.0|', event_id, '|', event_type, '|', event_id % 10, '|rt=', unix_millis(ts), ' src=198.51.100.', user_id % 250 + 1,
        ' suser=u', user_id, ' cs1Label=kind cs1=', event_type, ' msg=value \\= ', get_json_object(props, '$.k'))"""),
    "leef": ("lineitem", r"""concat('LEEF:2.0|Acme|Shipping|2.1|ship|^|ship=', date_format(l_shipdate, 'yyyy-MM-dd'), 'T00:00:00Z^line=', l_orderkey, '-', l_linenumber,
        '^part=', l_partkey, '^supp=', l_suppkey, '^qty=', cast(l_quantity as int), '^flag=', l_returnflag)"""),
    "json": ("orders", r"""concat('{"id":', o_orderkey, ',"open.date":"', date_format(o_orderdate, 'yyyy-MM-dd'), 'T00:00:00.000Z","items":[{"type":"host","value":"h',
        o_custkey % 50, '"},{"type":"user","value":"u', o_custkey, '"}],"prio":"', o_orderpriority, '","state":"', o_orderstatus, '"}')"""),
    "5424": ("events", r"""concat('<', 8 * (user_id % 24) + (event_id % 8), '>1 ', date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS"), 'Z host', user_id % 5, ' app ', event_id,
        ' ID', event_id % 9, ' [m@1 t="', event_type, '"] ', event_type, ' done')"""),
    "csv": ("customer", r"""concat(c_custkey, ',"', c_name, ', ', c_mktsegment, '",', c_nationkey)"""),
    "winxml": ("events", r"""concat('<Event xmlns=\'http://schemas.microsoft.com/win/2004/08/events/event\'><System><Provider Name=\'Audit\'/><EventID>4624</EventID><TimeCreated SystemTime=\'',
        date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS"), 'Z\'/><EventRecordID>', event_id, '</EventRecordID><Computer>host', user_id % 5,
        '</Computer></System><EventData><Data Name=\'TargetUserName\'>u', user_id, '</Data><Data Name=\'Kind\'>', event_type, ' &amp; more</Data></EventData></Event>')"""),
    "mojibake": ("documents", "decode(encode(text, 'UTF-8'), 'ISO-8859-1')"),
}


def lines(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Key column(s) and `raw` of one fixture."""
    source, expr = _SQL[kind]
    return table(spark, sf_dir, source).selectExpr(_KEEP[kind], f"{expr} as raw")


def junk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines no format knows: whole document texts on one line."""
    return table(spark, sf_dir, "documents").select("doc_id", F.translate("text", "\r\n", "  ").alias("raw"))


MIX = ("pipe", "kv", "cef", "leef", "json")


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All the formats and the junk in one column, with the name of the fixture beside it."""
    parts = [lines(spark, sf_dir, k).select(F.lit(k).alias("fixture"), F.col(c).cast("bigint").alias("key"), "raw")
             for k, c in ((k, _KEEP[k].split(" as ")[-1]) for k in MIX)]
    out = junk(spark, sf_dir).select(F.lit("junk").alias("fixture"), F.col("doc_id").alias("key"), "raw")
    for p in parts:
        out = out.unionByName(p)
    return out
