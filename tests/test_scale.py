"""What large tables need of the plans, on small rows: who is broadcast, who is moved, how rows are dealt out, ids beyond 64 bits, several files."""

from datetime import datetime
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from checks import QUERIES, base, render_checks
from checks.base import fixture
from logloom.operators import joins as j
from logloom.operators.ledger import delivery_outcome, retention
from logloom.operators.ranking import batch_starts, kth_smallest, pack_batches, ranked
from logloom.session import spread
from logloom.sources import sinks


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_a_dimension_is_broadcast_by_its_estimate_and_else_merged(spark):
    small, facts = spark.range(10).withColumn("v", F.col("id") * 2), spark.range(1000).select((F.col("id") % 12).alias("id"), F.col("id").alias("n"))
    assert j.fits_broadcast(small) and not j.fits_broadcast(small, limit=10)
    assert "BroadcastHashJoin" in plan(j.attach(facts, small, ["id"]))
    salted = j.attach(facts, small, ["id"], limit=10)
    assert "Broadcast" not in plan(salted) and rows(salted) == rows(facts.join(small, "id", "left"))


def test_routes_of_profiles_are_routes_of_events(spark):
    events = spark.createDataFrame([(i, t, s, v, c, st) for i, (t, s, v, c, st) in enumerate(
        [(1, 1, 3, 7, "parsed"), (1, None, 3, 7, "parsed"), (1, 1, None, None, "parsed"), (1, 1, None, None, "parsed"), (1, 2, 0, 8, "unparsed"), (2, 1, 5, 7, None), (None, 1, 5, 7, "parsed")])],
        "event_id long, tenant_id int, source_id int, severity_id int, class_uid int, status string")
    dest = spark.createDataFrame([(1, 10, True, None, 0, None, True), (1, 11, True, [1], 3, [7], False), (1, 11, True, [1], 3, [7], False), (1, None, True, [], None, [8], True), (2, 12, True, None, 5, [7], None),
                                  (1, 13, False, None, 0, None, True)],
                                 "tenant_id int, destination_id long, active boolean, source_ids array<int>, min_severity_id int, class_uids array<int>, include_unparsed boolean")
    got = j.route(events, dest)
    want = [(0, 10), (0, 11), (0, 11), (1, 10), (2, 10), (3, 10), (4, 10), (4, None), (5, 12)]
    assert rows(got.select("event_id", "destination_id")) == sorted(want, key=repr) and got.columns == [*events.columns, "destination_id"]
    each = [line for line in plan(got).splitlines() if "array_contains" in line]
    assert each and all("event_id" not in line for line in each)  # rules are tested on profiles


def test_ledger_rows_are_not_moved_by_joins_with_events(spark, sf):
    ledger, events = fixture(spark, sf, "ledger"), fixture(spark, sf, "arrivals")
    now = F.lit(datetime(2024, 1, 15, 12))
    kept, after = retention(events, ledger, now)
    results = ledger.select("event_id", "destination_id", F.lit(True).alias("ok"), F.lit(False).alias("permanent"), F.lit("").alias("reason"), F.col("next_attempt_at").alias("at"))
    for df in (after, delivery_outcome(ledger, results), j.orphan_deliveries(ledger, events.withColumn("event_id", 2 * F.col("event_id")))):
        moved = [line for line in plan(df).splitlines() if "Exchange hashpartitioning" in line]
        assert moved and all("destination_id" not in line for line in moved)
        tree = plan(df)
        assert tree.count("REPARTITION_BY_NUM") >= 1


def test_ledger_by_destination_holds_the_rows_of_the_ledger(spark, sf, monkeypatch):
    monkeypatch.setattr(base, "SHARD_ROWS", 1000)
    ledger = fixture(spark, sf, "ledger")
    got = base.ledger_by_destination(spark, sf)
    assert rows(got.drop("shard")) == rows(ledger) and got.select("shard").distinct().count() > 1
    assert got.groupBy("destination_id").agg(F.count_distinct("shard").alias("n")).filter("n > 1").count() == 0


def test_rows_that_lie_by_destination_are_not_moved_by_ranks_and_packing(spark, sf):
    for name in ("win7_ranked", "win7_pack_batches"):
        tree = plan(QUERIES[name](spark, sf))
        moved = [line for line in tree.splitlines() if "Exchange hashpartitioning" in line]
        assert moved and all("destination_id" not in line for line in moved)


def test_a_round_of_several_batches_is_sent_batch_by_batch(spark, tmp_path):
    due = spark.range(2600).select((F.col("id") % 2).alias("shard"), F.col("id").alias("event_id"), (F.col("id") % 2).alias("destination_id"), F.concat(F.lit("l"), "id").alias("value"))
    with_shard = sinks.deliver(due, sinks.file_writer(str(tmp_path / "a")), by=["shard"])
    assert rows(with_shard) == rows(sinks.deliver(due.drop("shard"), sinks.file_writer(str(tmp_path / "b")))) and with_shard.count() == 2600
    names = sorted(str(f.relative_to(tmp_path / "a")) for f in (tmp_path / "a").rglob("*.txt"))
    assert names == sorted(str(f.relative_to(tmp_path / "b")) for f in (tmp_path / "b").rglob("*.txt"))
    assert names == sorted(f"destination_id={d}/{1000 * i + d}-{min(1000 * i + 998, 2598) + d}-{n}.txt" for d in (0, 1) for i, n in enumerate((500, 500, 300)))


def test_rows_of_one_row_group_are_dealt_out(spark, tmp_path):
    pq.write_table(pa.table({"a": list(range(40000)), "t": [f"text {i * 7919}" for i in range(40000)]}), tmp_path / "one.parquet", row_group_size=1 << 20)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(16 * 1024))
    try:
        df = spark.read.parquet(str(tmp_path / "one.parquet"))
        assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        sizes = [r["n"] for r in spread(df).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sum(sizes) == 40000 and max(sizes) < 40000 / spark.sparkContext.defaultParallelism * 2


def test_kth_smallest_beyond_64_bits(spark):
    ids = [Decimal(i) * 10 ** 20 - 5 * 10 ** 21 + i % 7 for i in range(100)]
    df = spark.createDataFrame([(i,) for i in ids], "id decimal(37,0)").repartition(3)
    assert [kth_smallest(df, "id", k) for k in (1, 42, 100, 101)] == [int(sorted(ids)[0]), int(sorted(ids)[41]), int(sorted(ids)[99]), None]


def _large_ids(spark, sf, tmp_path, start: int) -> str:
    spark.read.parquet(f"{sf}/supplier.parquet").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.read.parquet(f"{sf}/events.parquet").withColumn("event_id", F.col("event_id") + start).write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_sparse_ids_of_large_tables(spark, sf, tmp_path):
    start = 6_000_000
    at = _large_ids(spark, sf, tmp_path, start)
    n = spark.read.parquet(f"{at}/events.parquet").count()
    kept = [r[0] for r in QUERIES["str9_trim_sparse"](spark, at).collect()]
    assert kept == [] if n <= 1000 else len(kept) == n - max(1000, int(n * 0.3))
    ranks = QUERIES["win7_ranked_sparse"](spark, at).collect()
    want = fixture(spark, at, "ledger").filter("status = 'pending'").select("destination_id", "event_id").collect()
    by = {}
    for d, e in sorted(want):
        by.setdefault(d, []).append(e)
    assert sorted((r["destination_id"], int(r["event_id"]), r["rank"]) for r in ranks) == [(d, e ** 3 * 1009 - 7, i) for d, es in sorted(by.items()) for i, e in enumerate(es, 1)]


def test_lines_of_several_files_are_numbered_on(spark, sf, monkeypatch):
    seen = {q: rows(QUERIES[q](spark, sf)) for q in ("src1_numbered_splits", "src4_json_array")}
    files = []
    written = render_checks._written_files
    monkeypatch.setattr(render_checks, "FILE_EVENTS", 300)
    monkeypatch.setattr(render_checks, "FILE_DOCS", 60)
    monkeypatch.setattr(render_checks, "_written_files", lambda df, *a: files.append(df.select("file_no").distinct().count()) or written(df, *a))
    assert seen == {q: rows(QUERIES[q](spark, sf)) for q in seen} and len(files) == 2 and min(files) >= 3


def test_deliveries_are_moved_once_by_destination(spark, tmp_path, monkeypatch):
    spark.range(9000).select(F.col("id").alias("event_id"), (F.col("id") % 3).alias("destination_id"), F.concat(F.lit("l"), "id").alias("value")).write.parquet(str(tmp_path / "due"))
    due = spark.read.parquet(str(tmp_path / "due"))

    def writer(destination, batch):
        if destination == 2:
            raise sinks.Rejected("down")
        if any(int(line[1:]) % 997 == 0 for line in batch):
            raise sinks.Rejected("refused", permanent=True)
    tree = plan(sinks.due_batches(due))
    moved = [line for line in tree.splitlines() if "Exchange hashpartitioning" in line]
    assert len(moved) == 3 and all("hashpartitioning(destination_id" in line and "REPARTITION_BY_NUM" in line for line in moved) and "ShuffledHashJoin" in tree
    together = rows(sinks.deliver(due, writer))
    assert together == sorted(((i, i % 3, i % 3 < 2 and i % 997 > 0, i % 3 < 2 and i % 997 == 0, "down" if i % 3 == 2 else "" if i % 997 else "refused") for i in range(9000)), key=repr)
    assert sinks.destination_shards(due, 2999) is None and sinks.destination_shards(due.limit(0)) is None
    monkeypatch.setattr(sinks, "SHARD_ROWS", 2999)  # a destination with more is cut by ranges of ids
    tree = plan(sinks.due_batches(due))
    assert "SortMergeJoin" in tree and "REPARTITION_BY_NUM" not in tree and rows(sinks.deliver(due, writer)) == together


def test_rounds_within_the_byte_limit_are_cut_by_number(spark):
    sizes = {0: [5] * 7, 1: [5, 90, 5, 5, 200, 5, 5], 2: [1]}
    due = spark.createDataFrame([(d, 10 * i, 0, s) for d, each in sizes.items() for i, s in enumerate(each)], "destination_id long, event_id long, round long, bytes int")
    for n, most in ((3, 10 ** 6), (3, 147), (3, 60), (1, 10 ** 6), (100, 146)):
        want = []
        for d, each in sizes.items():
            batch, count, total = -1, n, 0
            for i, s in enumerate(each):
                if count >= n or total + s + 16 > most:
                    batch, count, total = batch + 1, 0, 0
                count, total = count + 1, total + s + 16
                want.append((d, 0, 10 * i, batch))
        assert rows(pack_batches(due, n, most)) == sorted(want, key=repr)
    assert "CASE WHEN ((__n" in plan(pack_batches(due, 3, 60))


def test_ledger_pipeline_deals_lines_out_and_drops_lines_that_ended(spark, tmp_path, monkeypatch):
    from logloom.plans.formats_in import CEF
    from logloom.streaming import pipeline
    lines = spark.createDataFrame([(i, datetime(2024, 1, 1), 1, 1, f"CEF:0|Acme|Sensor|1.0|{i}|login|5|rt=1700000000000 msg=m{i}") for i in range(40)],
                                  "event_id long, received_at timestamp, tenant_id long, source_id long, raw string").coalesce(1)
    sources = spark.createDataFrame([(1, "keep")], "source_id long, unparsed_policy string")
    destinations = spark.createDataFrame([(d, 1, True, None, 0, None, False, "raw") for d in (1, 2)],
                                         "destination_id long, tenant_id long, active boolean, source_ids array<int>, min_severity_id int, class_uids array<int>, include_unparsed boolean, format string")

    def writer(destination, batch):
        if destination == 2:
            raise sinks.Rejected("down")
    for most in (sinks.SHARD_ROWS, 1):
        monkeypatch.setattr(sinks, "SHARD_ROWS", most)
        monkeypatch.setattr(pipeline, "removed", lambda *a: None)
        folder = str(tmp_path / f"p{most}")
        pipe = pipeline.LedgerPipeline(folder, [CEF], sources, destinations, writer, clock=lambda i: F.timestamp_seconds(F.lit(1_700_000_000 + 3600 * i)))
        assert pipe._dealt(lines).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        pipe.step(lines, 0)
        got = spark.read.parquet(f"{folder}/after").select("event_id", "destination_id", "status", F.col("value").isNull().alias("gone"))
        assert rows(got) == sorted(((i, d, *(("sent", True) if d == 1 else ("pending", False))) for i in range(40) for d in (1, 2)), key=repr)
        assert rows(spark.read.parquet(f"{folder}/open/batch_id=0").select("event_id", "value")) == rows(lines.select("event_id", F.col("raw").alias("value")))


def test_rows_that_lie_by_destination_are_ranked_in_one_sort(spark, sf):
    for name in ("win7_ranked", "win7_ranked_sparse"):
        tree = plan(QUERIES[name](spark, sf))
        assert tree.count("Window [") == 1 and tree.count("+- Sort [") == 1 and "MergeJoin" not in tree
    df = spark.createDataFrame([(1, 5), (1, 900), (1, 70), (2, 3), (2, None), (None, 4)], "destination_id long, event_id long")
    assert rows(ranked(df, ["destination_id"], "event_id", width=60, by=["destination_id"])) == rows(ranked(df, ["destination_id"], "event_id", width=60)) == [(1, 5, 1), (1, 70, 2), (1, 900, 3), (2, 3, 2)]


def test_deliveries_that_lie_by_destination_are_read_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def line(i):
        seen.add(1)
        return f"l{i}"
    due = spark.range(5000).repartition(4).select((F.col("id") % 2).alias("shard"), F.col("id").alias("event_id"), (F.col("id") % 2).alias("destination_id"), line("id").alias("value"))

    def writer(destination, batch):
        if len(batch) > 500 or batch != sorted(batch, key=lambda x: int(x[1:])):
            raise sinks.Rejected("not a batch", permanent=True)
    sent = sinks.deliver(due, writer, by=["shard"])
    assert sent.filter("ok").agg(F.count("*"), F.count_distinct("event_id")).first()[:] == (5000, 5000) and seen.value == 5000


def test_batches_of_a_round_at_hand_are_those_of_the_operator(spark):
    rng = np.random.default_rng(4)
    sizes = {d: rng.integers(0, 60, rng.integers(1, 40)).tolist() for d in range(30)}
    due = spark.createDataFrame([(d, i, 0, s) for d, each in sizes.items() for i, s in enumerate(each)], "destination_id long, event_id long, round long, bytes int")
    for n, most in ((3, 10 ** 6), (7, 200), (100, 90)):
        got = [(d, 0, i, sum(a <= i for a in batch_starts(np.array(each), n, most)) - 1) for d, each in sizes.items() for i in range(len(each))]
        assert sorted(got, key=repr) == rows(pack_batches(due, n, most))
    assert batch_starts([1, None, 2], 2, 30) == [0, 2] and batch_starts(np.array([], int), 2, 30) == []
