"""Nothing is cut unless a limit is asked for."""

import json

from pyspark.sql import functions as F

from checks.render_checks import canon
from logloom.operators import normalize, render
from logloom.sources import lines, sinks

LONG = "k" * 130


def test_rendering_keeps_long_and_many_leftovers(spark, sf):
    """Keys that agree in their first 120 characters, 200 leftovers, texts and codes beyond the old limits."""
    left = {**{f"{LONG}{i}": "v" * 2500 + str(i) for i in range(2)}, **{f"n{i}": str(i) for i in range(200)}}
    unmapped = F.create_map(*(x for k, v in left.items() for x in (F.lit(k), F.lit(v).cast("variant"))))
    df = canon(spark, sf).filter("status = 'parsed'").orderBy("event_id").limit(1)
    df = df.withColumn("event", F.col("event").withField("unmapped", unmapped).withField("metadata.event_code", F.lit("c" * 100)))
    udm = render.to_udm(df).select(F.col("udm.additional").alias("a"), F.col("udm.metadata.product_event_type").alias("code")).first()
    assert {k: udm.a.get(k) for k in left} == left and udm.code == "c" * 100
    details = df.select(render.details_map(F.col("event")).alias("d")).first().d
    assert {k: details.get(f"unmapped_{k}") for k in left} == left
    short = df.select(render.details_map(F.col("event"), 150, 80, 1000).alias("d")).first().d
    assert len(short) <= 150 and max(map(len, short)) <= 80 and max(map(len, short.values())) <= 1000
    cut = render.to_udm(df, key_max=120, text_max=2000, code_max=64).select(F.col("udm.additional").alias("a"), F.col("udm.metadata.product_event_type").alias("code")).first()
    assert max(map(len, cut.a)) == 120 and max(map(len, cut.a.values())) == 2000 and cut.code == "c" * 64


def test_unparsed_line_is_whole(spark):
    df = spark.createDataFrame([("r" * 5000, "e" * 3000)], "raw string, error string")
    extra = json.loads(df.select(render.generic_udm_line(df)).first()[0])["additional"]
    assert extra["raw"] == "r" * 5000 and extra["error"] == "e" * 3000


def test_arrival_and_precheck_without_a_limit(spark):
    text = "é" * 300_000 + "end"
    df = spark.createDataFrame([(text + "\r\n",)], "raw string")
    got = lines.stamp_arrival(df, "tcp", F.current_timestamp(), max_bytes=None).first()
    assert got.raw == text and got.truncated is False
    assert normalize.precheck(df).first().error is None and df.select(normalize.precheck_error(F.col("raw"))).first()[0] is None


def test_every_row_of_a_refused_batch_is_tried(spark):
    bad, sent = {0, 3, 250, 251, 998, 999}, []

    def writer(destination, batch):
        if any(int(line) in bad for line in batch):
            raise sinks.Rejected("refused", permanent=True)
        sent.extend(batch)
    got = {i: (ok, permanent) for i, _, ok, permanent, _ in sinks.send_batch(writer, 1, [(i, str(i)) for i in range(1000)], isolate=None)}
    assert got == {i: (i not in bad, i in bad) for i in range(1000)} and len(sent) == len(set(sent)) == 994
