"""Approximate nearest neighbours by cosine: probed lists, scanned dimension by dimension with early abandoning.

Unit vectors are rotated at random, so the first columns tell about the whole distance. They fall into lists around centres fitted on a bounded sample (`sample` vectors). A query first visits the
`FIRST` share of lists with the nearest centres; its k-th best there is a bound. A list's members lie around the query's product with its centre, so it can be told how many of them are expected
beyond the bound; the lists with the least are left out as long as they sum up to less than `LOST` neighbours, the others are visited in a second pass. In a list the columns are read in
blocks; after each block a hypothesis test compares the scaled partial distance with the bound and abandons candidates that are too far with high confidence. Survivors are ranked by the
exact cosine, in double precision on the original vectors.

Equal vectors have equal scores, so for each distinct vector only its k + 1 smallest ids can be among anyone's k nearest; the rest need no scan. Large lists are cut into blocks, and so are the queries
of a list: a task holds one block of each.

Defined cases: vectors that are null, zero, hold null or non-finite components, or have another length than most take no part, nor do null ids. Of rows with the same id the least vector counts. Ties go to
the smaller id. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.tables import hash_key, stored

NEAREST = 5
SAMPLE = 20_000       # vectors the centres are fitted on
LIST_ROWS = 1024      # wanted length of a list
MOST_LISTS = 1024
FIRST = 0.1           # share of the lists that a query visits to find its bound
LOST = 0.1            # neighbours that a query may be expected to lose in the lists it leaves out
FEW = 0.1             # share of pairs alive from which on they are compared one by one
BLOCK = 4096          # candidates of a task
QUERIES = 1024        # queries of a task
COLUMNS = 16          # dimensions between two tests
DOUBT = 2.1           # width of the test
SEED = 5


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (array of double) that take part; one row per id."""
    real = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select("vec_id", "embedding").filter("vec_id is not null and embedding is not null").filter(real & F.exists("embedding", lambda x: x != 0))
    rows = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    sizes = rows.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    return rows.filter(F.size("embedding") == (sizes[0]["dim"] if sizes else 0)).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def _stack(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # first to the largest component, so squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def centres(rows: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rotation and centres (rotated), from at most SAMPLE vectors chosen by hash."""
    sample = rows.orderBy(hash_key("vec_id", seed=SEED)).limit(SAMPLE).select("embedding").toPandas()["embedding"]
    x = _unit(np.stack(sample.to_numpy()))
    rng = np.random.default_rng(SEED)
    rotation = np.linalg.qr(rng.standard_normal((x.shape[1], x.shape[1])))[0]
    x = x @ rotation
    k = max(1, min(MOST_LISTS, len(x), n // LIST_ROWS))
    middle = x[rng.choice(len(x), k, replace=False)]
    for _ in range(8):
        near = (x @ middle.T).argmax(1)
        sums = np.zeros_like(middle)
        np.add.at(sums, near, x)
        some = np.abs(sums).sum(1) > 0
        middle[some] = _unit(sums[some])
    return rotation, middle


def _with_names(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _as_lists(values: list[np.ndarray]) -> pa.Array:
    return pa.array([v.astype(np.int32) for v in values], pa.list_(pa.int32()))


def _listed(rows: DataFrame, model) -> DataFrame:
    """Each row with its nearest list and its product with that centre."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # at most MOST_LISTS centres

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotation, middle = shared.value
        for batch in batches:
            if batch.num_rows:
                product = _unit(_stack(batch.column("embedding"))) @ rotation @ middle.T
                near = product.argmax(1)
                yield _with_names({"vec_id": batch.column("vec_id"), "embedding": batch.column("embedding"), "list": pa.array(near.astype(np.int32)), "near": pa.array(product[np.arange(len(near)), near])})

    return rows.mapInArrow(run, "vec_id bigint, embedding array<double>, list int, near double")


def lists_left(product: np.ndarray, bound: np.ndarray, mean: np.ndarray, size: np.ndarray, dims: int, first: int) -> list[np.ndarray]:
    """Lists of the second pass for each query, from its products with the centres and the cosine of its k-th best."""
    order = np.argsort(-product, axis=1, kind="stable")
    centre = product * mean                                                         # where the members' products with the query lie
    spread = np.sqrt(np.maximum(1 - product ** 2, 1e-9) * np.maximum(1 - mean ** 2, 1e-9) / max(dims - 1, 1))
    beyond = size * np.frompyfunc(lambda z: 0.5 * math.erfc(z / math.sqrt(2)), 1, 1)((bound[:, None] - centre) / spread).astype(float)
    beyond[np.arange(len(product))[:, None], order[:, :first]] = -1                 # visited already
    out = []
    for row in beyond:
        by = np.argsort(row, kind="stable")
        lost = np.cumsum(np.maximum(row[by], 0))
        out.append(by[(lost > LOST) & (row[by] >= 0)])
    return out


def _asked(queries: DataFrame, model, most: int, stats: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """Each query once for each list it visits: the `most` nearest, or with `stats` and a bound those of the second pass."""
    shared = queries.sparkSession.sparkContext.broadcast((model, stats))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (rotation, middle), stats = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            product = _unit(_stack(batch.column("embedding"))) @ rotation @ middle.T
            if stats is None:
                lists = list(np.argsort(-product, axis=1, kind="stable")[:, :most])
            else:
                lists = lists_left(product, batch.column("bound").to_numpy(), *stats, rotation.shape[0], most)
            yield _with_names({"vec_id": batch.column("vec_id"), "embedding": batch.column("embedding"), "bound": batch.column("bound"), "lists": _as_lists(lists)})

    return queries.select("vec_id", "embedding", "bound").mapInArrow(run, "vec_id bigint, embedding array<double>, bound double, lists array<int>").select("vec_id", "embedding", "bound", F.explode("lists").alias("list"))


def scan(queries: np.ndarray, rows: np.ndarray, limit: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (query, row) of about the `keep` nearest rows of each query below its limit (squared distance); rotated unit vectors, candidates given up early by partial distances."""
    dims, head = rows.shape[1], min(len(rows), max(64, 2 * keep))
    whole = 2 - 2 * queries @ rows[:head].T
    if head >= keep:
        limit = np.minimum(limit, np.partition(whole, keep - 1, axis=1)[:, keep - 1] + 1e-9)
    part, live = np.zeros((len(queries), len(rows))), np.ones((len(queries), len(rows)), bool)
    z = 0
    while z < dims and live.mean() > FEW:
        a, z = z, min(dims, z + COLUMNS)
        q, r = queries[:, a:z], rows[:, a:z]
        part += (q * q).sum(1)[:, None] + (r * r).sum(1) - 2 * q @ r.T
        live &= part * (dims / z) <= (limit * (1 + DOUBT / math.sqrt(z)) ** 2)[:, None] if z < dims else part <= limit[:, None]
    q, r = np.nonzero(live)
    dist = part[q, r]
    while z < dims and len(q):
        a, z = z, min(dims, z + COLUMNS)
        dist = dist + ((rows[r, a:z] - queries[q, a:z]) ** 2).sum(1)
        ok = dist * (dims / z) <= limit[q] * (1 + DOUBT / math.sqrt(z)) ** 2 if z < dims else dist <= limit[q]
        q, r, dist = q[ok], r[ok], dist[ok]
    order = np.lexsort((r, dist, q))
    q, r = q[order], r[order]
    best = np.arange(len(q)) - np.searchsorted(q, q) < keep
    return q[best], r[best]


def _compared(asked: DataFrame, held: DataFrame, rotation: np.ndarray, nearest: int) -> DataFrame:
    """query_id, vec_id, score: the nearest members of each list for the queries that visit it. A task holds one block of a list and one of its queries."""
    sizes = held.groupBy("list").count().withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int")).drop("count")
    loads = asked.groupBy("list").count().withColumn("turns", F.ceil(F.col("count") / QUERIES).cast("int")).drop("count")
    cut = stored(sizes.join(loads, "list"), "ann-cuts")
    block, turn = F.pmod(F.xxhash64("vec_id"), "blocks").cast("int"), F.pmod(F.xxhash64("vec_id"), "turns").cast("int")
    held = held.join(cut, "list").select("vec_id", "embedding", "list", block.alias("block"), F.explode(F.expr("sequence(0, turns - 1)")).alias("turn"))
    asked = asked.join(cut, "list").select("vec_id", "embedding", "bound", "list", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), turn.alias("turn"))
    shared = held.sparkSession.sparkContext.broadcast(rotation)
    pool = 4 * nearest + 1

    def compare(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(candidates):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        ids, asked_ids = candidates["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
        exact, asked_exact = np.stack(candidates["embedding"].to_numpy()), np.stack(queries["embedding"].to_numpy())
        limit = 2 - 2 * queries["bound"].to_numpy() + 1e-9
        q, r = scan(_unit(asked_exact) @ shared.value, np.ascontiguousarray(_unit(exact) @ shared.value), limit, pool)
        other = ids[r] != asked_ids[q]
        q, r = q[other], r[other]
        score = (exact[r] * asked_exact[q]).sum(1) / (np.sqrt((exact[r] * exact[r]).sum(1)) * np.sqrt((asked_exact[q] * asked_exact[q]).sum(1)))
        order = np.lexsort((ids[r], -score, q))
        q, r, score = q[order], r[order], score[order]
        best = np.arange(len(q)) - np.searchsorted(q, q) < nearest
        return pd.DataFrame({"query_id": asked_ids[q[best]], "vec_id": ids[r[best]], "score": score[best]})

    keys = ("list", "block", "turn")
    return asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(compare, "query_id bigint, vec_id bigint, score double")


def search(vectors: DataFrame, every: int, nearest: int = NEAREST, first: float = FIRST) -> DataFrame:
    """query_id, rank, vec_id, score. Queries: rows whose vec_id is divisible by `every`; candidates: all rows but the query's own."""
    spark = vectors.sparkSession
    rows = stored(usable(vectors), "ann-rows")
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    model = centres(rows, n)
    copy = Window.partitionBy("embedding").orderBy("vec_id")
    some = rows.withColumn("copy", F.row_number().over(copy)).filter(F.col("copy") <= nearest + 1).drop("copy")  # limited before the shuffle
    held = stored(_listed(some, model), "ann-lists")
    lists = len(model[1])
    mean, size = np.zeros(lists), np.zeros(lists)
    for r in held.groupBy("list").agg(F.avg("near").alias("mean"), F.count("*").alias("n")).collect():  # one row a list
        mean[r["list"]], size[r["list"]] = r["mean"], r["n"]
    queries = rows.filter(F.col("vec_id") % every == 0)
    few = max(1, math.ceil(first * lists))
    asked = stored(_asked(queries.withColumn("bound", F.lit(-1.0)), model, few), "ann-asked")
    found = stored(_compared(asked, held, model[0], nearest), "ann-found")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    if few < lists:
        top = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= nearest).groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n"))
        bound = F.when(F.col("n") >= nearest, F.col("least")).otherwise(F.lit(-1.0))
        again = queries.join(top, queries["vec_id"] == top["query_id"], "left").select("vec_id", "embedding", F.coalesce(bound, F.lit(-1.0)).alias("bound"))
        found = found.unionByName(_compared(stored(_asked(again, model, few, (mean, size)), "ann-asked-again"), held, model[0], nearest))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")
