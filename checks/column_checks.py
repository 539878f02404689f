"""Column builders, predicates and conversions on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import check, fixture, micros, now, table
from checks.lines import lines
from logloom.functions import columns as c
from logloom.functions import convert as v
from logloom.functions import predicates as p
from logloom.functions.emptiness import prune_variant_map
from logloom.operators import extract as x
from logloom.operators.filters import search_events
from logloom.operators.normalize import precheck
from logloom.session import spread


def _json(spark, sf):
    return x.extract_json(lines(spark, sf, "json"), "raw", "j")


# ---------------------------------------------------------------- column builders
@check("exp1_field", """select o_orderkey as key, 'h' || (o_custkey % 50) as first_value, 'user' as last_kind, o_orderpriority as prio,
    cast(o_custkey as varchar) as from_map from orders""")
def exp1(spark, sf):
    df = x.extract_kv(_json(spark, sf).withColumn("m", F.create_map(F.lit("cust"), F.regexp_extract("raw", r'"u(\d+)"', 1))), "raw", "kv")
    kind = df.schema["j"].dataType
    text = lambda path: F.try_variant_get(c.field(path, kind), "$", "string")
    return df.select("key", text("j.items.0.value").alias("first_value"), text("j.items.-1.type").alias("last_kind"), text("j.prio").alias("prio"),
                     c.field("m.cust", df.schema["m"].dataType).alias("from_map"))


@check("exp2_const", "select event_id, 4002 as class_uid, 'HTTP Activity' as class_name from events")
def exp2(spark, sf):
    return table(spark, sf, "events").select("event_id", c.const(4002).alias("class_uid"), c.const("HTTP Activity").alias("class_name"))


@check("exp3_first_nonempty", """select event_id, case when user_id % 3 <> 0 then 'a' || user_id when user_id % 2 = 0 then 'b' else event_type end as value from events""")
def exp3(spark, sf):
    u = F.col("user_id")
    first = F.when(u % 3 == 0, F.lit("-")).otherwise(F.concat(F.lit("a"), u))
    return table(spark, sf, "events").select("event_id", c.first_nonempty(first, F.when(u % 2 == 0, "b").otherwise(""), F.col("event_type")).alias("value"))


@check("exp4_template", """select event_id, trim('u' || user_id || ' - ' || case when user_id % 4 = 0 then '' else event_type end) as loose,
    case when user_id % 4 <> 0 then 'u' || user_id || '/' || event_type end as strict from events""")
def exp4(spark, sf):
    parts = {"a": F.concat(F.lit("u"), "user_id"), "b.c": F.when(F.col("user_id") % 4 == 0, "-").otherwise(F.col("event_type"))}
    return table(spark, sf, "events").select("event_id", c.template("{a} - {b.c}", parts).alias("loose"), c.template("{a}/{b.c}", parts, strict=True).alias("strict"))


@check("exp5_lookup", """select event_id, case event_type when 'click' then 1 when 'error' then 2 else 0 end as by_table,
    case event_type when 'click' then 'one' else event_type end as by_default_from from events""")
def exp5(spark, sf):
    t = F.col("event_type")
    return table(spark, sf, "events").select("event_id", c.lookup(t, {"click": 1, "error": 2}, default=0).alias("by_table"),
                                             c.lookup(t, {"click": "one"}, default_from=t).alias("by_default_from"))


@check("exp6_regex_group", """select c_custkey, nullif(regexp_extract(c_name, '#0*([1-9]\\d*)', 1), '') as number from customer""".replace("\\\\", "\\"))
def exp6(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", c.regex_group(F.col("c_name"), r"#0*(?P<n>[1-9]\d*)").alias("number"))


@check("exp7_url_struct", r"""select page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) as hostname from pages""")
def exp7(spark, sf):
    return table(spark, sf, "pages").select("page_id", c.url_struct(F.col("url"))["hostname"].alias("hostname"))


# texts with '' and '-' among them
_GAPPY = "case user_id % 4 when 0 then '' when 1 then '-' when 2 then event_type end"


@check("exp8_object", f"""select event_id, user_id % 3 = 0 and event_type <> 'error' and t is null as missing, case when user_id % 3 <> 0 then user_id end as u,
    case when event_type = 'error' then 'error' end as e, t from (select *, nullif(nullif({_GAPPY}, ''), '-') as t from events)""")
def exp8(spark, sf):
    o = c.obj(u=F.when(F.col("user_id") % 3 != 0, F.col("user_id")), e=F.when(F.col("event_type") == "error", F.col("event_type")), t=F.expr(_GAPPY))
    return table(spark, sf, "events").withColumn("o", o).select("event_id", F.col("o").isNull().alias("missing"), "o.u", "o.e", "o.t")


@check("exp9_list", f"""select event_id, nullif(concat_ws(',', case when user_id % 2 = 1 then 'u' end, case when event_type = 'error' then 'e' end, nullif(nullif({_GAPPY}, ''), '-')), '') as items from events""")
def exp9(spark, sf):
    t = F.when(F.col("event_type") == "error", F.lit("e"))
    li = c.list_of(F.when(F.col("user_id") % 2 == 1, F.lit("u")), t, F.expr(_GAPPY))
    return table(spark, sf, "events").select("event_id", F.array_join(li, ",").alias("items"))


@check("exp10_default", f"""select event_id, coalesce(case when user_id % 2 = 1 then user_id end, -1) as value, coalesce(nullif(nullif({_GAPPY}, ''), '-'), 'none') as name from events""")
def exp10(spark, sf):
    return table(spark, sf, "events").select("event_id", c.with_default(F.when(F.col("user_id") % 2 == 1, F.col("user_id")), -1).alias("value"), c.with_default(F.expr(_GAPPY), "none").alias("name"))


# ---------------------------------------------------------------- predicates
_MAYBE = "case when user_id % 5 <> 0 then event_type end"


def _maybe():
    return F.when(F.col("user_id") % 5 != 0, F.col("event_type"))


def _flags(spark, sf, **conds):
    df = table(spark, sf, "events").select("event_id", *[cond.alias(n) for n, cond in conds.items()])
    return df.groupBy(*conds).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@check("prd1_compare", f"""select coalesce({_MAYBE} = 'click', false) as eq, coalesce({_MAYBE} <> 'click', false) as ne,
    coalesce({_MAYBE} in ('click', 'view'), false) as among, count(*) as n, cast(sum(event_id) as bigint) as ids from events group by 1, 2, 3""")
def prd1(spark, sf):
    m = _maybe()
    return _flags(spark, sf, eq=p.equals(m, "click"), ne=p.differs(m, "click"), among=p.within(m, ["click", "view"]))


@check("prd2_regex", f"""select coalesce(regexp_matches({_MAYBE}, 'c.i|^v', 's'), false) as hit, count(*) as n, cast(sum(event_id) as bigint) as ids from events group by 1""")
def prd2(spark, sf):
    return _flags(spark, sf, hit=p.matches(_maybe(), "c.i|^v"))


@check("prd3_parts", f"""select coalesce(starts_with({_MAYBE}, 'p'), false) as starts, coalesce(contains({_MAYBE}, 'i'), false) as has, count(*) as n,
    cast(sum(event_id) as bigint) as ids from events group by 1, 2""")
def prd3(spark, sf):
    return _flags(spark, sf, starts=p.starts_with(_maybe(), "p"), has=p.contains(_maybe(), "i"))


@check("prd4_exists", """select user_id % 5 <> 0 and user_id % 3 <> 0 as there, not (user_id % 5 <> 0 and user_id % 3 <> 0) as absent, count(*) as n,
    cast(sum(event_id) as bigint) as ids from events group by 1, 2""")
def prd4(spark, sf):
    val = F.when(F.col("user_id") % 3 == 0, "-").otherwise(_maybe())
    return _flags(spark, sf, there=p.exists(val), absent=p.exists(val, False))


@check("prd5_logic", f"""select coalesce({_MAYBE} = 'click', false) and user_id % 2 = 0 as both, coalesce({_MAYBE} = 'click', false) or user_id % 2 = 0 as either,
    not coalesce({_MAYBE} = 'click', false) as neither, count(*) as n, cast(sum(event_id) as bigint) as ids from events group by 1, 2, 3""")
def prd5(spark, sf):
    a, b = p.equals(_maybe(), "click"), F.col("user_id") % 2 == 0
    return _flags(spark, sf, both=p.all_of(a, b), either=p.any_of(a, b), neither=p.none_of(a))


@check("prd6_search_events", """select event_id, epoch_us(received_at) as at_us from {arrivals} where tenant_id = 2 and status = 'parsed'
    and received_at > {now} - interval 20000 minutes and raw ilike '%CLICK {"k"%'""")
def prd6(spark, sf):
    out = search_events(fixture(spark, sf, "arrivals"), now(), tenant_id=2, status="parsed", minutes=20000, text='CLICK {"k"')
    return out.select("event_id", micros("received_at").alias("at_us"))


def _prechecked(spark, sf, **limit):
    i = F.col("doc_id") % 4
    raw = F.when(i == 1, "  \r\n").when(i == 2, F.repeat(F.col("text"), F.lit(200))).when(i == 3, F.col("text"))
    df = precheck(table(spark, sf, "documents").select("doc_id", raw.alias("raw")), **limit)
    return df.groupBy(F.coalesce("error", F.lit("")).alias("error")).agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@check("prd7_precheck", """select case when doc_id % 4 < 2 then 'empty line' else '' end as error, count(*) as n, cast(sum(doc_id) as bigint) as ids from documents group by 1""")
def prd7(spark, sf):
    """Lines of any length pass."""
    return _prechecked(spark, sf)


@check("prd7_precheck_limit", """select case when doc_id % 4 < 2 then 'empty line' when doc_id % 4 = 2 and n * 200 > 262144 or n > 262144 then 'line above the limit of 262144 bytes' else '' end as error, count(*) as n,
    cast(sum(doc_id) as bigint) as ids from (select doc_id, octet_length(encode(text)) as n from documents) group by 1""")
def prd7_limit(spark, sf):
    """A limit in bytes, asked for."""
    return _prechecked(spark, sf, max_bytes=262_144)


# ---------------------------------------------------------------- conversions
@check("cnv1_text", """select o_orderkey, cast(o_custkey as varchar) as txt, lower(o_orderpriority) as lo, upper(o_orderpriority) as up,
    upper(left(lower(o_orderstatus) || 'x', 1)) || substr(lower(o_orderstatus) || 'x', 2) as uf from orders""")
def cnv1(spark, sf):
    mixed = F.concat(F.lower("o_orderstatus"), F.lit("x"))
    return table(spark, sf, "orders").select("o_orderkey", v.text(F.col("o_custkey")).alias("txt"), v.lower(F.col("o_orderpriority")).alias("lo"),
                                             v.upper(F.col("o_orderpriority")).alias("up"), v.upper_first(mixed).alias("uf"))


@check("cnv2_numbers", """select event_id, case when event_id % 3 <> 0 then user_id end as i, case when event_id % 3 <> 1 then user_id + 0.5 end as f,
    event_id % 4 < 2 as b from events""")
def cnv2(spark, sf):
    e, u = F.col("event_id"), F.col("user_id").cast("string")
    i = F.when(e % 3 == 0, F.concat(u, F.lit("x"))).otherwise(F.concat(F.lit(" "), u, F.lit(" ")))
    f = F.when(e % 3 == 1, F.concat(u, F.lit("d"))).otherwise(F.concat(u, F.lit(".5")))
    b = F.get(F.array(F.lit(" TRUE"), F.lit("sim"), F.lit("no"), F.lit("2")), (e % 4).cast("int"))
    return table(spark, sf, "events").select("event_id", v.to_int(i).alias("i"), v.to_float(f).alias("f"), v.to_bool(b).alias("b"))


@check("cnv3_quotes", """select p_partkey, p_name as stripped, case when p_partkey % 2 = 0 then p_name else '"' || p_name end as unquoted from part""")
def cnv3(spark, sf):
    n, q = F.col("p_name"), F.lit('"')
    return table(spark, sf, "part").select(
        "p_partkey", v.strip_quotes(F.concat(F.lit(' "" '), n, F.lit(' " '))).alias("stripped"),
        v.unquote(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" '"), n, F.lit("' "))).otherwise(F.concat(q, n))).alias("unquoted"))


@check("cnv4_nil", """select event_id, case when event_id % 5 > 3 then event_type end as value from events""")
def cnv4(spark, sf):
    words = F.array(*[F.lit(w) for w in (" ", "-", "null", " None ")])
    val = F.coalesce(F.get(words, (F.col("event_id") % 5).cast("int")), F.col("event_type"))
    return table(spark, sf, "events").select("event_id", v.nil(val).alias("value"))


@check("cnv5_ip", """select event_id, case event_id % 6 when 3 then null when 4 then null when 5 then '2001:db8::' || case when user_id = 0 then '' else format('{:x}', user_id) end
    else '10.0.' || (user_id % 256) || '.' || (event_id % 250 + 1) end as ip from events""")
def cnv5(spark, sf):
    e, u = F.col("event_id"), F.col("user_id")
    base = F.concat(F.lit("10.0."), u % 256, F.lit("."), e % 250 + 1)
    k = e % 6
    raw = (F.when(k == 0, F.concat(base, F.lit(":8080"))).when(k == 1, F.concat(F.lit(" ["), base, F.lit("] "))).when(k == 2, F.concat(base, F.lit("/24")))
           .when(k == 3, F.concat(base, F.lit(".1"))).when(k == 4, F.concat(F.lit("300."), base)).otherwise(F.concat(F.lit("2001:0DB8:0:0:0:0:0:"), F.hex(u))))
    return table(spark, sf, "events").select("event_id", v.to_ip(raw).alias("ip"))


@check("cnv6_ips", """select event_id, 2 as n, '10.1.1.' || (event_id % 250) as head from events""")
def cnv6(spark, sf):
    raw = F.concat(F.lit("10.1.1."), F.col("event_id") % 250, F.lit(", nonsense 10.2.2.2:99,,300.1.1.1"))
    ips = v.to_ips(raw)
    return table(spark, sf, "events").select("event_id", F.size(ips).alias("n"), F.get(ips, F.lit(0)).alias("head"))


@check("cnv7_lists", """select p_partkey, string_split(p_name, ' ')[1] as head, p_type as tail, string_split(p_name, ' ')[1] || ';' || p_type as joined from part""")
def cnv7(spark, sf):
    li = v.split_list(F.concat(F.substring_index("p_name", " ", 1), F.lit(" ,, "), F.lit("-, "), F.col("p_type")), ",")
    return table(spark, sf, "part").select("p_partkey", v.first(li).alias("head"), v.last(li).alias("tail"), v.join_list(li, ";").alias("joined"))


@check("cnv8_times", """select event_id, epoch_us(ts) // 1000 as ms, epoch_us(ts) // 1000000 as s, case event_id % 4 when 0 then epoch_us(ts) // 1000
    when 1 then epoch_us(ts) // 1000000 * 1000 when 2 then epoch_us(ts) // 1000 else epoch_us(date_trunc('day', ts)) // 1000 end as auto from events""")
def cnv8(spark, sf):
    ts, k = F.col("ts"), F.col("event_id") % 4
    ms, s = F.unix_millis(ts).cast("string"), F.unix_seconds(ts).cast("string")
    raw = F.when(k == 0, ms).when(k == 1, s).when(k == 2, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'123+00:00'")).otherwise(F.date_format(ts, "yyyyMMdd"))
    return table(spark, sf, "events").select("event_id", F.unix_millis(v.epoch_ms(ms)).alias("ms"), F.unix_seconds(v.epoch_s(s)).alias("s"),
                                             F.unix_millis(v.to_time(raw)).alias("auto"))


@check("cnv9_strptime", """select event_id, epoch_us(ts) // 1000000 - 10800 * (event_id % 2) as s from events""")
def cnv9(spark, sf):
    raw = F.concat(F.date_format("ts", "EEE, d  MMM yyyy HH:mm:ss "), F.when(F.col("event_id") % 2 == 0, "+0000").otherwise("+0300"))
    return table(spark, sf, "events").select("event_id", F.unix_seconds(v.strptime(raw, "%a, %d %b %Y %H:%M:%S %z")).alias("s"))


@check("cnv10_paths", """select p_partkey, p_brand || '.exe' as base, case when p_partkey % 2 = 0 then '/opt/' || p_type else 'C:\\' || p_type end as dir from part""".replace("\\\\", "\\"))
def cnv10(spark, sf):
    raw = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("/opt/"), "p_type", F.lit("/"), "p_brand", F.lit(".exe"))).otherwise(
        F.concat(F.lit("C:\\"), "p_type", F.lit("\\"), "p_brand", F.lit(".exe")))
    return table(spark, sf, "part").select("p_partkey", v.basename(raw).alias("base"), v.dirname(raw).alias("dir"))


@check("cnv11_accounts", r"""select c_custkey, case when c_custkey % 2 = 0 then c_mktsegment end as dom, 'u' || c_custkey as usr, 'h' || c_nationkey || '.example.org' as host from customer""")
def cnv11(spark, sf):
    even = F.col("c_custkey") % 2 == 0
    u = F.concat(F.lit("u"), "c_custkey")
    raw = F.when(even, F.concat("c_mktsegment", F.lit("\\"), u)).otherwise(F.concat(u, F.lit("@example.org")))
    url = F.concat(F.lit("https://H"), "c_nationkey", F.lit(".example.org:8443/x?y=1"))
    return table(spark, sf, "customer").select("c_custkey", v.domain(raw).alias("dom"), v.user(raw).alias("usr"), v.url_host(url).alias("host"))


@check("cnv12_key", """select o_orderkey as key, strftime(o_orderdate, '%Y-%m-%dT00:00:00.000Z') as opened from orders""")
def cnv12(spark, sf):
    return _json(spark, sf).select("key", F.try_variant_get(v.variant_key(F.col("j"), "open.date"), "$", "string").alias("opened"))


@check("cnv13_pick", """select o_orderkey as key, 'h' || (o_custkey % 50) as host, 'u' || o_custkey as usr, true as nothing from orders""")
def cnv13(spark, sf):
    items = v.variant_key(F.col("j"), "items")
    value = lambda kind: F.try_variant_get(v.pick(items, "type", kind), "$.value", "string")
    return _json(spark, sf).select("key", value("host").alias("host"), value("user").alias("usr"), v.pick(items, "type", "x").isNull().alias("nothing"))


@check("cnv14_hash_algorithm", """select event_id, case event_id % 5 when 0 then 'MD5' when 1 then 'SHA-1' when 2 then 'SHA-256' when 3 then 'SHA-512' end as alg from events""")
def cnv14(spark, sf):
    t, k = F.col("event_type"), F.col("event_id") % 5
    raw = F.when(k == 0, F.md5(t)).when(k == 1, F.sha1(t)).when(k == 2, F.sha2(t, 256)).when(k == 3, F.sha2(t, 512)).otherwise(F.concat(F.lit("z"), F.md5(t)))
    return table(spark, sf, "events").select("event_id", v.hash_algorithm(raw).alias("alg"))


@check("cnv15_replace", """select c_custkey, replace(c_name, '#00', '.*') as name from customer""")
def cnv15(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", v.replace_text(F.col("c_name"), "#00", ".*").alias("name"))


@check("cnv16_flatten", """select o_orderkey as key, 'host' as k0, 'h' || (o_custkey % 50) as v0, 'u' || o_custkey as v1, o_orderpriority as prio, 8 as n from orders""")
def cnv16(spark, sf):
    flat = v.flatten_variant_map(F.try_variant_get("j", "$", "map<string,variant>"))
    df = _json(spark, sf).withColumn("f", flat)
    at = lambda k: F.try_element_at("f", F.lit(k))
    return df.select("key", at("items.0.type").alias("k0"), at("items.0.value").alias("v0"), at("items.1.value").alias("v1"), at("prio").alias("prio"),
                     F.size("f").alias("n"))


_NESTED = """'{"a":{"b":{"c":{"d":{"e":{"f":{"g":{"h":{"i":[{"x":' || event_id || ',"no":"-"},{"y":[1,"two",' || user_id || ']},{"z":[[],{}]}]}}}},"s":""}}}},"t":"' || event_type || '","l":[]}'"""


def _nested(spark, sf):
    return spread(table(spark, sf, "events")).withColumn("j", F.parse_json(F.expr(_NESTED)))


@check("cnv16_flatten_deep", """select event_id, list_value('a.b.c.d.e.f.g.h.i.0.no', 'a.b.c.d.e.f.g.h.i.0.x', 'a.b.c.d.e.f.g.h.i.1.y', 'a.b.c.d.s', 't') as keys,
    '-;' || event_id || ';1, two, ' || user_id || ';;' || event_type as vals from events""")
def cnv16_deep(spark, sf):
    """Leaves eleven levels down."""
    flat = _nested(spark, sf).select("event_id", v.flatten_variant_map(F.try_variant_get("j", "$", "map<string,variant>")).alias("f"))
    keys = F.array_sort(F.map_keys("f"))
    return flat.select("event_id", keys.alias("keys"), F.array_join(F.transform(keys, lambda k: F.try_element_at("f", k)), ";").alias("vals"))


@check("cnv17_prune_deep", """select event_id, '{"a":{"b":{"c":{"d":{"e":{"f":{"g":{"h":{"i":[{"x":' || event_id || '},{"y":[1,"two",' || user_id || ']}]}}}}}}}},"t":"' || event_type || '"}' as kept from events""")
def cnv17_deep(spark, sf):
    """Empty members eleven levels down go, and what held only them."""
    return _nested(spark, sf).select("event_id", F.to_json(v.prune_variant(F.col("j"))).alias("kept"))


@check("cnv17_prune", """select event_id, 1 + (event_id % 4 = 0)::int + (event_id % 3 = 0)::int as n from events""")
def cnv17(spark, sf):
    e = F.col("event_id")
    text = F.concat(F.lit('{"keep":0,"a":'), F.when(e % 4 == 0, '"x"').otherwise('"-"'), F.lit(',"b":'), F.when(e % 3 == 0, "[0]").otherwise("[]"), F.lit(',"c":{},"d":null}'))
    df = table(spark, sf, "events").withColumn("j", F.try_parse_json(text))
    return df.select("event_id", F.size(prune_variant_map(F.try_variant_get("j", "$", "map<string,variant>"))).alias("n"))
