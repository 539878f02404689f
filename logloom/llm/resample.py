"""Quality by importance resampling: hashed n-gram models of target and raw text, and a Gumbel top-k sample.

Words and pairs of neighbouring words are hashed into buckets. Counts over all documents give the raw model, counts over the target documents the target model. A document's
log weight is the sum of its n-grams' log ratios; adding Gumbel noise and taking the k largest samples without replacement in proportion to
the weights. Noise is a hash of the document id, so reruns agree.

The k-th largest key is found exactly by four rounds of counting 16-bit digits (at most 65,536 counts a round), never by a sort in one place.

Defined cases: null or empty text has weight 0 (log). Documents with equal keys (repeated rows) are kept or left together. Without target documents all ratios are 0. An empty table gives
no rows. Null ids share one noise value. Extra columns stay in `scored`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.tables import hash_key, stored
from logloom.llm.words import Words, chunks

BUCKETS = 1 << 15
SMOOTHING = 1.0
TARGETS = 20_000  # labelled good documents, chosen by hash, that the target model is fitted on; the raw model counts all documents
FRACTION = 0.5   # of the documents that are kept
SEED = 7


def _buckets(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and document of every word and word pair."""
    pair, first = w.grams(2)
    grams = np.concatenate([w.hash, pair])
    return (grams & np.uint64(BUCKETS - 1)).astype(np.int64), np.concatenate([w.doc, w.doc[first]])


def _counts(docs: DataFrame) -> DataFrame:
    """bucket, raw, target: n-gram counts; one row per task and bucket reaches the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for part in chunks(batch):
                bucket, doc = _buckets(Words(part.column("text")))
                wanted = np.array(part.column("is_target").to_pylist(), bool)[doc]
                total[0] += np.bincount(bucket, minlength=BUCKETS)
                total[1] += np.bincount(bucket[wanted], minlength=BUCKETS)
        some = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[0][some]), pa.array(total[1][some])], names=["bucket", "raw", "target"])

    return docs.select("text", "is_target").mapInArrow(run, "bucket bigint, raw bigint, target bigint").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(docs: DataFrame) -> np.ndarray:
    """log target probability - log raw probability by bucket (a fixed number of them). `docs` has text, is_target."""
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in _counts(docs).collect():  # at most BUCKETS rows
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not target.any():
        return np.zeros(BUCKETS)
    model = lambda c: np.log((c + SMOOTHING) / (c.sum() + SMOOTHING * BUCKETS))
    return model(target) - model(raw)


def scored(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """All columns and `log_weight`."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios.astype(np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = shared.value
        for batch in batches:
            for part in chunks(batch):
                bucket, doc = _buckets(w := Words(part.column("text")))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.bincount(doc, weights=ratio[bucket], minlength=w.rows))], names=[*part.schema.names, "log_weight"])

    kinds = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{kinds}, log_weight double")


def with_targets(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`is_target`: in a sample of at most TARGETS documents labelled good and not toxic. Its size is fixed, so it is broadcast and no text is shuffled."""
    good = labels.filter("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").alias("good_id")).distinct()
    good = F.broadcast(good.orderBy(hash_key("good_id", seed=SEED), "good_id").limit(TARGETS))
    return docs.join(good, docs["doc_id"] == good["good_id"], "left").withColumn("is_target", F.col("good_id").isNotNull()).drop("good_id")


def kth_largest(keys: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest of a column of 64-bit integers, by digits."""
    if k <= 0:
        return None
    prefix, left = None, k
    for shift in (48, 32, 16, 0):
        high = F.shiftright(column, shift)  # keeps the sign, so larger digits are larger numbers
        rows = (keys if prefix is None else keys.filter(F.shiftright(column, shift + 16) == prefix)).groupBy(high.alias("digit")).count().collect()
        for r in sorted(rows, key=lambda r: -r["digit"]):
            if r["count"] >= left:
                prefix = r["digit"]
                break
            left -= r["count"]
        else:
            return None
    return prefix


def resample(docs: DataFrame, labels: DataFrame, fraction: float = FRACTION) -> DataFrame:
    """doc_id, log_weight, gumbel_key, kept."""
    marked = with_targets(docs.select("doc_id", "text"), labels)
    rows = scored(docs.select("doc_id", "text"), log_ratios(marked)).drop("text")
    noise = -F.log(-F.log((hash_key("doc_id", seed=SEED) + 0.5) / float(2**63)))
    key = F.round((F.col("log_weight") + noise) * 1e6).cast("bigint")
    rows = stored(rows.select("doc_id", "log_weight", key.alias("gumbel_key")), "resample-keys")
    limit = kth_largest(rows, "gumbel_key", round(rows.count() * fraction))
    return rows.withColumn("kept", F.col("gumbel_key") >= F.lit(limit) if limit is not None else F.lit(False))
