"""Mix sources to target weights with a multivariate-hypergeometric splitting tree.

Every document has a place in its source's permutation, the hash of its id. A source's documents fall into blocks, equal ranges of that hash. The target of a source
is so many whole passes over its blocks and a part of one more: whole blocks in permuted order, and in the block where the target lies the documents up to the nearest hash.
These block draws are exact quotas. A binary tree over the output shards splits them: each node hands its left half a multivariate-hypergeometric share of every
source's draws, so all shards get the same number of draws and, on average, the same mixture. A shard then takes disjoint stretches of each source's permuted draws and orders its
rows by hash.

Sizes are words. Only sums per source (one row each) come to the driver. Blocks are one row per source and hash range; documents stay where they are until
they meet their block's draws.

Defined cases: null text has size 0 and is drawn like any other, for nothing. Null source is a source, the last. Repeated rows (same id) share a hash and are taken or left
together. Null id hashes like a value. A table without words takes nothing. Extra columns stay in `mix`.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.tables import hash_key, set_aside, stored

WEIGHTS = (3, 1, 2)   # of the sources in code point order, repeating, null last
BUDGET = 1.5          # words of the mixture per word of input
EPOCHS = 2            # most passes over a source
BLOCK_BITS = 12       # blocks of a source: 2^12 ranges of the hash at least
SHARD_BLOCKS = 64     # and so many for each output shard, so that shards get draws enough to be alike
SHARD_WORDS = 8_000_000  # words of an output shard
SEED = 11


def sized(docs: DataFrame, *keep: str) -> DataFrame:
    """mix_key and mix_size of each document, beside `source` and the columns to keep."""
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")
    return docs.select(*keep, "source", size.alias("mix_size"), hash_key("doc_id", seed=SEED).alias("mix_key"))


def block_bits(shards: int) -> int:
    return max(BLOCK_BITS, math.ceil(math.log2(SHARD_BLOCKS * shards)))


def blocked(rows: DataFrame, shards: int) -> DataFrame:
    """`rows` with mix_block, the range of the hash that their mix_key lies in."""
    return rows.withColumn("mix_block", F.shiftright("mix_key", 63 - block_bits(shards)))


def share(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, epochs: int = EPOCHS) -> list[float]:
    """Targets in the order of the sources: weighted shares of the budget; what exceeds a source's cap goes to the others by weight."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    cap = [float(epochs * s) for s in sizes]
    capped: set[int] = set()
    left = budget * sum(sizes)
    while True:
        open_ = [i for i in range(len(sizes)) if i not in capped]
        total = sum(w[i] for i in open_)
        over = [i for i in open_ if left * w[i] / total > cap[i]]
        if not over:
            return [cap[i] if i in capped else left * w[i] / total for i in range(len(sizes))]
        capped.update(over)
        left -= sum(cap[i] for i in over)


def split(draws: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Draws of each source (columns) for each shard (rows)."""
    if shards == 1:
        return draws[None, :]
    left = shards // 2
    to_left = rng.multivariate_hypergeometric(draws, int(draws.sum()) * left // shards, method="marginals") if draws.sum() else draws
    return np.concatenate([split(to_left, left, rng), split(draws - to_left, shards - left, rng)])


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target."""
    rows = sizes.groupBy("source").agg(F.sum("mix_size").alias("n")).collect()
    rows = sorted(rows, key=lambda r: (r["source"] is None, r["source"] or ""))
    goal = share([r["n"] for r in rows])
    return sizes.sparkSession.createDataFrame([(r["source"], r["n"], t) for r, t in zip(rows, goal)], "source string, source_size bigint, target double")


def _null_safe(a: DataFrame, b: DataFrame, *keys: str):
    cond = a[keys[0]].eqNullSafe(b[keys[0]])
    for k in keys[1:]:
        cond = cond & a[k].eqNullSafe(b[k])
    return cond


def plan(sizes: DataFrame, shards: int | None = None) -> tuple[DataFrame, DataFrame, int]:
    """The draws (source, mix_block, mix_copy, mix_upto, mix_shard), the targets, and the number of shards. mix_upto is the last hash of a block that is drawn in part, else null.

    `sizes` (see `sized`) is read several times, so it should be a stored table. The number of shards follows the words of the mixture.
    """
    goal = stored(targets(sizes), "mix-targets")
    shards = shards or max(1, math.ceil((goal.agg(F.sum("target")).first()[0] or 0) / SHARD_WORDS))
    sizes = blocked(sizes, shards)
    blocks = stored(sizes.groupBy("source", "mix_block").agg(F.sum("mix_size").alias("words")), "mix-blocks")
    in_order = Window.partitionBy("source").orderBy("mix_block")
    ranked = blocks.withColumns({"before": F.sum("words").over(in_order) - F.col("words"), "place": F.row_number().over(in_order) - 1,
                                 "blocks": F.count(F.lit(1)).over(Window.partitionBy("source"))})
    ranked = ranked.join(goal, _null_safe(ranked, goal, "source")).drop(goal["source"])
    passes = F.floor(F.col("target") / F.greatest("source_size", F.lit(1))).cast("int")
    rest = F.col("target") - passes * F.col("source_size")
    state = stored(ranked.select(ranked["source"], "mix_block", "place", "blocks", "before", "words", passes.alias("passes"), rest.alias("rest")), "mix-order")
    edge = state.filter("before < rest and rest < before + words").select("source", "mix_block", "before", "rest")
    docs = sizes.join(edge, _null_safe(sizes, edge, "source", "mix_block")).select(sizes["source"], sizes["mix_block"], "mix_key", "mix_size", "before", "rest")
    docs = docs.groupBy("source", "mix_block", "mix_key", "before", "rest").agg(F.sum("mix_size").alias("n"))
    reach = F.col("before") + F.sum("n").over(Window.partitionBy("source", "mix_block").orderBy("mix_key"))
    nearest = docs.withColumn("reach", reach).withColumn("miss", F.abs(F.col("reach") - F.col("rest"))).groupBy("source", "mix_block").agg(
        F.min_by("mix_key", F.struct("miss", "mix_key")).alias("key"), F.min("miss").alias("miss"), F.first(F.col("rest") - F.col("before")).alias("none"))
    nearest = stored(nearest.select("source", "mix_block", F.when(F.col("miss") < F.col("none"), F.col("key")).otherwise(F.lit(-1)).alias("upto")), "mix-edge")
    joined = state.join(nearest, _null_safe(state, nearest, "source", "mix_block"), "left").drop(nearest["source"]).drop(nearest["mix_block"])
    partial = F.when(F.col("before") + F.col("words") <= F.col("rest"), F.lit(1)).when(F.col("upto") >= 0, F.lit(1)).otherwise(F.lit(0))
    copies = joined.withColumn("mix_copy", F.explode(F.expr("sequence(0, passes)"))).filter((F.col("mix_copy") < F.col("passes")) | (partial == 1))
    draws = copies.select("source", "mix_block", "mix_copy", "place", "blocks", F.when((F.col("mix_copy") == F.col("passes")) & F.col("upto").isNotNull(), F.col("upto")).alias("mix_upto"))
    draws = stored(draws.withColumn("turn", F.row_number().over(Window.partitionBy("source").orderBy("mix_copy", "mix_block")) - 1), "mix-draws")
    quotas = sorted(draws.groupBy("source").count().collect(), key=lambda r: (r["source"] is None, r["source"] or ""))
    spark = sizes.sparkSession
    cuts = np.zeros((0, shards + 1), np.int64)
    if quotas:
        parts = split(np.array([r["count"] for r in quotas], np.int64), shards, np.random.default_rng(SEED))
        cuts = np.concatenate([np.zeros((len(quotas), 1), np.int64), np.cumsum(parts, axis=0).T], axis=1)
    stretches = [(r["source"], i, int(row[i]), int(row[i + 1])) for r, row in zip(quotas, cuts) for i in range(shards) if row[i] < row[i + 1]]
    stretches = stored(spark.createDataFrame(stretches, "source string, mix_shard int, first bigint, stop bigint"), "mix-stretches")  # a row a source and shard
    turns = stretches.select("source", "mix_shard", F.explode(F.expr("sequence(first, stop - 1)")).alias("turn"))
    draws = draws.withColumn("turn", F.col("turn").cast("bigint"))
    placed = draws.join(turns, _null_safe(draws, turns, "source", "turn")).drop(turns["source"]).drop(turns["turn"])
    return stored(placed.select("source", "mix_block", "mix_copy", "mix_upto", "mix_shard"), "mix-plan"), goal, shards


def copies(sizes: DataFrame, draws: DataFrame, shards: int) -> DataFrame:
    """`sizes` with mix_shards: the output shards that take each document, one entry a time; empty if none does."""
    taken = F.array_sort(F.collect_list(F.struct("mix_copy", "mix_shard", "mix_upto")))  # at most EPOCHS + 1 draws of a block
    per = draws.groupBy("source", "mix_block").agg(taken.alias("draws"))
    sizes = blocked(sizes, shards)
    joined = sizes.join(per, _null_safe(sizes, per, "source", "mix_block"), "left").drop(per["source"]).drop(per["mix_block"])
    own = F.filter("draws", lambda d: d["mix_upto"].isNull() | (F.col("mix_key") <= d["mix_upto"]))
    return joined.withColumn("mix_shards", F.coalesce(F.transform(own, lambda d: d["mix_shard"]), F.array().cast("array<int>"))).drop("draws")


def mix(docs: DataFrame, shards: int | None = None) -> DataFrame:
    """The mixture: the columns of `docs`, each row as often as it is drawn, in shards, each in an order of its own."""
    draws, _, shards = plan(stored(sized(docs, "doc_id"), "mix-sizes"), shards)
    safe, restored = set_aside(docs, "mix_")
    rows = blocked(safe.withColumn("mix_key", hash_key("doc_id", seed=SEED)), shards)
    drawn = rows.join(draws, _null_safe(rows, draws, "source", "mix_block")).drop(draws["source"]).drop(draws["mix_block"]).filter("mix_upto is null or mix_key <= mix_upto")
    local = hash_key("mix_key", "mix_copy", "mix_shard", seed=SEED + 1)
    return drawn.repartitionById(shards, "mix_shard").sortWithinPartitions("mix_shard", local).transform(restored)
