"""Operators that SQL cannot express, or cannot express cheaply, against plain Python on small fixtures."""

import bisect
import hashlib
import ipaddress
import json
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from logloom.functions import emptiness
from logloom.functions.json_walk import flat_entries, pruned_inside
from logloom.operators import masking, ranking
from logloom.sources import sinks

EMAIL = re.compile(r"(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)+")
UUID = re.compile(masking.PATTERNS["uuid"])
SID = re.compile(masking.PATTERNS["sid"])
V6 = re.compile(masking.PATTERNS["v6"])
V4 = re.compile(masking.PATTERNS["v4"])


def valid(text):
    try:
        return ipaddress.ip_address(text)
    except ValueError:
        return None


def finds(text):
    """(kind, value) of the finds of one text, kind by kind on what the earlier kinds leave."""
    out = set()
    for kind, rx, stand_in in (("mail", EMAIL, "user0@masked.invalid"), ("uuid", UUID, "00000000-0000-8000-8000-000000000000"),
                               ("sid", SID, "S-1-5-21-4000000000-0-0")):
        out |= {(kind, m) for m in rx.findall(text)}
        text = rx.sub(stand_in, text)
    out |= {("v6", m) for m in V6.findall(text) if valid(m)}
    return out | {("v4p" if valid(m).is_private else "v4", m) for m in V4.findall(text) if valid(m)}


def masked(texts):
    by_kind = {}
    for kind, value in set().union(*map(finds, texts)):
        by_kind.setdefault(kind, set()).add(value)
    token = {}
    for kind, values in by_kind.items():
        for n, v in enumerate(sorted(values, key=lambda v: (hashlib.md5(v.encode()).hexdigest(), v)), 1):
            token[v] = {"mail": f"user{n}@masked.invalid", "uuid": f"00000000-0000-8000-8000-{n:012x}", "sid": f"S-1-5-21-4000000000-0-{n}",
                        "v6": f"2001:db8::0:0:{n:x}", "v4p": f"10.{n // 65536}.{n // 256 % 256}.{n % 256}", "v4": f"240.{n // 65536}.{n // 256 % 256}.{n % 256}"}[kind]
    for rx in (EMAIL, UUID, SID, V6, V4):
        texts = [rx.sub(lambda m: token.get(m.group(0), m.group(0)), t) for t in texts]
    return texts


def test_mask(spark, sf):
    line = ('200.243.39.102 - u [08/Oct/2026:01:00:37 -0300] 2804:18:70ac:11bb:1899:aa87:b571:9fef fe80::1 a.b@c.com.br 10.1.2.3 127.0.0.1 41eb30d2-db7c-41db-a187-e11eda8ea728 '
            "S-1-5-21-111-222-333-1001 11.200.243.39.102 300.1.1.1 200.243.39.102")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(10_000, line), (10_001, "nothing here"), (10_002, "10.1.2.3")], "doc_id long, text string"))
    rows = {r.doc_id: r.text for r in docs.collect()}
    want = dict(zip(rows, masked(list(rows.values()))))
    got = {r.doc_id: r.masked for r in masking.mask(docs, "text", "doc_id").select("doc_id", "masked").collect()}
    assert got == want
    assert "[08/Oct/2026:01:00:37 -0300]" in got[10_000] and "300.1.1.1" in got[10_000] and "11.200.243.39.102" in got[10_000]
    for leaked in ("2804:18", "fe80::1", "a.b@c", "41eb30d2", "S-1-5-21-111", " 10.1.2.3 "):
        assert leaked not in got[10_000]


def test_mask_terms_and_hot_values(spark, monkeypatch):
    monkeypatch.setattr(masking, "HOT_COPIES", 2)
    docs = spark.createDataFrame([(i, f"acme LTDA from 8.8.{i % 2}.8 and 9.9.9.{i}") for i in range(9)], "id long, t string")
    got = [r.masked for r in masking.mask(docs, "t", "id", ["ACME LTDA", "x"]).orderBy("id").collect()]
    assert all(g.startswith("[TERM1] from 240.0.0.") for g in got) and len({g.split()[2] for g in got}) == 2 and len({g.split()[4] for g in got}) == 9


def test_mask_tokens_are_one_to_one(spark):
    n = F.col("id") + 1
    many = spark.range(70_000).unionByName(spark.range(2**24 - 5, 2**24 + 5)).unionByName(spark.range(2**28 - 5, 2**28 + 5)).unionByName(spark.range(2**32 - 5, 2**32 + 5))
    for kind in ("mail", "uuid", "sid", "v6", "v4", "v4p"):
        tokens = many.select(masking._token(F.lit(kind), n).alias("t"))
        assert tokens.distinct().count() == 70_030
    assert all(valid(r.t) for r in many.filter("id < 70000").select(masking._token(F.lit("v6"), n).alias("t")).limit(2000).collect())


def test_keyed_tokens_last_between_runs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(
        [(-1, "a.b@c.com 41eb30d2-db7c-41db-a187-e11eda8ea728.2.3.4 S-1-5-21-1-2-3::1 fe80::1 10.1.2.3 8.8.8.8."), (-2, None), (-3, ""), (-4, "300.1.1.1 12:30:01"), (-5, "8.8.8.8 a.b@c.com")], "doc_id long, text string"))
    get = lambda df, key="k": {r.doc_id: r.masked for r in masking.mask_keyed(df, "text", key).collect()}
    whole = get(docs)
    assert whole == {**get(docs.filter("doc_id % 2 = 0")), **get(docs.filter("doc_id % 2 <> 0"))}
    assert whole[-2] is None and whole[-3] == "" and whole[-4] == "300.1.1.1 12:30:01"
    parts = whole[-1].split(" ")
    assert [p.endswith(".") for p in parts] == [False] * 5 + [True] and whole[-5] == f"{parts[5][:-1]} {parts[0]}"
    assert parts[1].endswith("a.2.3.4") and valid(parts[3]) and valid(parts[4]) and valid(parts[5][:-1])
    for leaked in ("a.b@c", "41eb30d2", "S-1-5-21-1-2-3", "fe80", "10.1.2.3", "8.8.8.8"):
        assert leaked not in whole[-1]
    assert not set(get(docs.filter("doc_id = -5"), "other")[-5].split()) & set(whole[-5].split())


def test_keyed_addresses_are_permuted(spark):
    numbers = spark.range(30_000).unionByName(spark.range(2**32 - 30_000, 2**32)).unionByName(spark.range(2**16 - 7, 2**32, 2**17))
    tokens = numbers.distinct().select(masking._permuted(F.col("id"), "k").alias("t"))
    assert tokens.distinct().count() == tokens.count() and tokens.filter("t rlike '^[0-9a-f]{4}:[0-9a-f]{4}$'").count() == tokens.count()


def packed(sizes, max_n, max_b):
    out, batch, n, b = [], -1, 0, 0
    for s in sizes:
        s += ranking.ROW_OVERHEAD
        if batch < 0 or n >= max_n or b + s > max_b:
            batch, n, b = batch + 1, 0, 0
        n, b = n + 1, b + s
        out.append(batch)
    return out


def test_pack_by_bytes(spark):
    rng = random.Random(7)
    rows = [(d, i, rng.choice([10, 500, 3000])) for d in range(3) for i in range(200)]
    df = spark.createDataFrame(rows, "destination_id long, event_id long, bytes long")
    got = {(r.destination_id, r.event_id): (r.round, r.batch) for r in ranking.pack_batches(ranking.delivery_rounds(df, 150), 20, 8000).collect()}
    for d in range(3):
        sizes = [s for dd, _, s in rows if dd == d]
        want = [(0, b) for b in packed(sizes[:150], 20, 8000)] + [(1, b) for b in packed(sizes[150:], 20, 8000)]
        assert [got[(d, i)] for i in range(200)] == want


def test_ranked_with_one_hot_key(spark):
    df = spark.range(5000).select(F.col("id").alias("i"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"))
    got = ranking.ranked(df, ["k"], "i", width=64).collect()
    seen = {}
    for r in sorted(got, key=lambda r: r.i):
        seen[r.k] = seen.get(r.k, 0) + 1
        assert r.rank == seen[r.k]
    assert len(got) == 5000


def test_ranked_on_sparse_and_clustered_ids(spark):
    digest, near = F.xxhash64("id"), F.lit(2**62) + F.col("id")  # doubles cannot tell the near ones apart
    df = spark.range(6000).select(F.when(F.col("id") % 4 == 0, near).otherwise(digest).alias("i"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 > 0, F.concat(F.lit("k"), F.col("id") % 50)).otherwise("one").alias("k"))
    bounds = ranking.id_bounds(df.filter("i < 4611686018427387904"), "i", 100)
    for cuts in (bounds, ranking.id_bounds(df, "i", 100), [], ranking.id_bounds(df, "i")):
        seen, got = {}, ranking.ranked(df, ["k"], "i", bounds=cuts).collect()
        for r in sorted(got, key=lambda r: r.i):
            seen[r.k] = seen.get(r.k, 0) + 1
            assert r["rank"] == seen[r.k]
        assert len(got) == 6000
    ids = sorted(r.i for r in df.filter("i < 4611686018427387904").collect())
    at = [bisect.bisect_left(ids, b) for b in bounds]
    assert len(bounds) == -(-len(ids) // 100) - 1 and max(b - a for a, b in zip([0, *at], [*at, len(ids)])) <= 200  # no range holds more than twice its share
    empty = df.limit(0)
    assert ranking.id_bounds(empty, "i") == [] and ranking.ranked(empty, ["k"], "i", bounds=[]).count() == 0


def test_bad_rows_are_isolated():
    sent = []

    def writer(destination, lines):
        if any("bad" in line for line in lines):
            raise sinks.Rejected("refused", permanent=True)
        sent.extend(lines)
    rows = [(i, "bad" if i == 3 else f"l{i}") for i in range(6)]
    got = {i: (ok, permanent) for i, _, ok, permanent, _ in sinks.send_batch(writer, 1, rows)}
    assert got[3] == (False, True) and all(got[i] == (True, False) for i in got if i != 3) and sent == [line for _, line in rows if line != "bad"]


def test_isolation_stops_after_the_limit():
    def writer(destination, lines):
        raise sinks.Rejected("refused", permanent=True)
    got = list(sinks.send_batch(writer, 1, [(i, "x") for i in range(250)], isolate=200))
    assert len(got) == 250 and sum(not r[3] for r in got) == 50


def test_first_run_floor(spark):
    items = spark.createDataFrame([("a", 5, 1), ("b", 50, 2), ("b", 60, 3)], "key string, ts_ms long, seq long")
    seen = spark.createDataFrame([], "key string, seen_s long")
    assert [(r.key, r.ts_ms) for r in ranking.dedupe_seen(items, seen, 100, floor_ms=10).collect()] == [("b", 50)]


def test_kth_smallest(spark):
    import random
    rng = random.Random(2)
    ids = [-2**63, 2**63 - 1, 0, 0, 7] + [rng.randrange(-2**62, 2**62) for _ in range(300)] + list(range(1000, 1300))
    df = spark.createDataFrame([(i,) for i in ids] + [(None,)], "id long")
    for k in (1, 2, 5, 150, 303, 304, 450, len(ids)):
        assert ranking.kth_smallest(df, "id", k) == sorted(ids)[k - 1]
    assert ranking.kth_smallest(df, "id", len(ids) + 1) is None and ranking.kth_smallest(df, "id", 0) is None


def test_only_values_that_may_hold_empties_are_walked(spark):
    texts = ['{"a":{"b":"","c":1},"d":[{"e":null},"-"]}', '{"a":{"b":"x\\"","c":[1.50,{"d":true}]}}', '{"a":["null",{"b":"[]"}],"c":"{}","d":"[x"}', '{"a":[[]],"b":[{"c":{}}],"c":"-"}', '{}', '{"a":{"":1}}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    members = emptiness.kept_members(F.try_variant_get(F.try_parse_json("t"), "$", "map<string,variant>"))
    got = {r.id: json.loads(r.j) for r in df.select("id", F.to_json(F.transform_values(members, lambda _, v: F.to_json(v))).alias("j")).collect()}
    got = {i: {k: json.loads(v) for k, v in m.items()} for i, m in got.items()}
    assert got == {0: {"a": {"c": 1}}, 1: {"a": {"b": 'x"', "c": [1.5, {"d": True}]}}, 2: {"a": ["null", {"b": "[]"}], "c": "{}", "d": "[x"}, 3: {}, 4: {}, 5: {"a": {"": 1}}}


def _nested_value(rnd, depth):
    texts = ["", "-", "a", 'q"u', "b\\s", "x,null,y", "[]", "{}", '{"a":null,', "[null,", ":", "\n"]
    kind = rnd.random()
    if depth and kind < 0.3:
        return {rnd.choice(texts + ["k1", "k2"]): _nested_value(rnd, depth - 1) for _ in range(rnd.randint(0, 4))}
    if depth and kind < 0.55:
        return [_nested_value(rnd, depth - 1) for _ in range(rnd.randint(0, 4))]
    return rnd.choice([None, True, 1, -25, *texts])


def _without_empty(value):
    if isinstance(value, dict):
        value = {k: w for k, x in value.items() if (w := _without_empty(x)) is not None}
    elif isinstance(value, list):
        value = [w for x in value if (w := _without_empty(x)) is not None]
    return None if value in ("", "-", [], {}) or value is None else value


def _leaves(value, key=""):
    plain = lambda x: None if x is None else str(x).lower() if isinstance(x, bool) else str(x)
    if isinstance(value, dict):
        return [e for k, x in value.items() for e in _leaves(x, f"{key}.{k}")]
    if isinstance(value, list) and any(isinstance(x, dict | list) for x in value):
        return [e for i, x in enumerate(value) for e in _leaves(x, f"{key}.{i}")]
    if isinstance(value, list):
        return [(key, ", ".join(t for x in value if (t := plain(x)) is not None))] if value else []
    return [(key, plain(value))]


def test_nested_values_pruned_and_flattened(spark):
    """Texts that look like parts of JSON stay texts, and what becomes empty from the inside goes at any depth."""
    rnd = random.Random(11)
    values = [_nested_value(rnd, rnd.randint(1, 6)) for _ in range(400)]
    deep = None
    for _ in range(60):
        deep = {"a": [deep]}
    values += [deep, [1, deep], "x,null," * 20000, {"t": "\n,null," * 20000, "e": [None]}]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(values)], "i int, t string").withColumn("v", F.parse_json("t"))
    got = {r["i"]: r for r in df.select("i", F.to_json(pruned_inside(F.col("v"))).alias("kept"), flat_entries(F.col("v")).alias("flat")).collect()}
    for i, x in enumerate(values):
        want = _without_empty(x) if isinstance(x, dict | list) else x
        kept = got[i]["kept"]
        assert (None if kept is None else json.loads(kept)) == want, x
        assert Counter((e["key"], e["value"]) for e in got[i]["flat"]) == Counter(_leaves(x)), x


def test_nested_values_take_few_steps(spark):
    """One step a member, and pruning goes by sweeps of the text: no step for every token."""
    plan = lambda c: spark.range(1).select(c.alias("x"))._jdf.queryExecution().analyzed().toString()
    v = F.parse_json(F.lit('{"a":null}'))
    assert "regexp_replace" in plan(pruned_inside(v)) and "regexp_extract_all" not in plan(pruned_inside(v))
