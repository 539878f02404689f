"""Quality rules: fixed floors plus robust multivariate outliers (minimum covariance determinant).

Every text becomes a vector of transformed statistics. Each language and source has its own centre and scatter, estimated by
concentration steps over all its documents: keep the three quarters nearest to the present estimate, estimate anew from those. A
document whose Mahalanobis distance is beyond the cut-off is rejected.

Vectors are integers (fixed point), so all sums are exact and do not depend on the order of rows. Quantiles are exact: their values come from a
grid, so the state of a group is bounded by the grid and not by its rows. Group parameters are one row per group; Spark broadcasts that table
when its files are small and joins by key otherwise.

Defined cases: a null or empty text has no words and fails the floor. Null language or source is a value of its own. A group with fewer than
`LEAST` documents past the floors is judged by the estimate of its whole language, a language below that by the estimate of all documents. Only a table
with fewer than `LEAST` documents past the floors has no estimate and rejects nothing beyond the floors. Repeated rows are judged alike, each on its own row. Extra columns stay untouched in `apply_rules`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.tables import set_aside, stored
from logloom.llm.words import Words, chunks

WINDOW = 8          # words of a window that must not repeat
MIN_WORDS = 20
MAX_REPEAT_PCT = 30
LEAST = 50          # documents a group needs for an estimate of its own
SHARE_PCT = 75      # documents of a group an estimate is made of
STEPS = 3           # concentration steps
CUTOFF = 200.0      # squared distance after scaling to the median of a chi-square with five degrees of freedom
CHI2_MEDIAN = 4.3515
GRID = 256          # fixed point: units per 1.0 of a feature
FLOOR = (0.25, 0.03, 0.15, 0.05, 0.05)  # least standard deviation of each feature; below it, differences mean nothing

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bytes")
DIMS = 5
EVERY = "every"               # the pool of all documents
NULLS = {"ignoreNullFields": "false"}  # a null source is not the language's own pool
PAIRS = [(i, j) for i in range(DIMS) for j in range(i, DIMS)]


def _first_seen(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each (doc, value): is it an earlier value's repetition, and how often the value occurs in its document."""
    order = np.lexsort((value, doc))  # stable: equal values stay in text order
    d, v = doc[order], value[order]
    new = np.ones(len(order), bool)
    new[1:] = (d[1:] != d[:-1]) | (v[1:] != v[:-1])
    group = np.cumsum(new) - 1
    times = np.bincount(group)[group] if len(order) else np.zeros(0, np.int64)
    repeated, count = np.empty(len(order), bool), np.empty(len(order), np.int64)
    repeated[order], count[order] = ~new, times
    return repeated, count


def text_statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    w = Words(texts)
    data, offs, n = w.data, w.offs, len(w.data)
    byte_doc = np.repeat(np.arange(w.rows), np.diff(offs))
    char = ((data & 0xC0) != 0x80) & ~w.space
    ends = np.flatnonzero(data == 10)
    start = np.unique(np.concatenate([offs[:-1], ends + 1]))
    start = start[start < n]
    line_end = np.minimum(np.append(ends, n)[np.searchsorted(ends, start)], offs[np.searchsorted(offs, start, "right")])
    words_before = np.zeros(n + 1, np.int64)
    words_before[1:] = np.cumsum(~w.space)
    line = words_before[line_end] > words_before[start]
    start, line_end = start[line], line_end[line]
    line_doc = np.searchsorted(offs, start, "right") - 1
    dup, _ = _first_seen(line_doc, w.range_hash(start, line_end))
    gram, first = w.grams(WINDOW)
    _, times = _first_seen(w.doc[first], gram)
    cover = np.zeros(len(w.start) + 1, np.int64)
    np.add.at(cover, first[times > 1], 1)
    np.add.at(cover, first[times > 1] + WINDOW, -1)
    repeated = np.cumsum(cover[:-1]) > 0
    by = lambda mask, doc: np.bincount(doc[mask], minlength=w.rows).astype(np.int64)
    return {"n_words": w.count.astype(np.int64), "word_chars": by(char, byte_doc), "n_symbols": by(_SYMBOL[data], byte_doc), "n_dup_lines": by(dup, line_doc),
            "n_repeat_words": by(repeated, w.doc), "n_lines": np.bincount(line_doc, minlength=w.rows).astype(np.int64), "n_bytes": np.diff(offs)}


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of `docs` and the struct `rule_stats` of its text."""
    kind = pa.struct([(s, pa.int64()) for s in STATS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text):
                found = text_statistics(part.column(text))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.StructArray.from_arrays([pa.array(found[s]) for s in STATS], fields=list(kind))],
                                                 names=[*part.schema.names, "rule_stats"])

    fields = ", ".join(f"{s}: bigint" for s in STATS)
    wanted = ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields), f"rule_stats struct<{fields}>"])
    return docs.mapInArrow(run, wanted)


def failed_floor() -> Column:
    return F.expr(f"rule_stats.n_words < {MIN_WORDS} or 100 * rule_stats.n_repeat_words > {MAX_REPEAT_PCT} * rule_stats.n_words")


def features() -> list[Column]:
    """Log length, word length, symbols per hundred letters, repeated lines, repeated words; in grid units."""
    n, share = "greatest(rule_stats.n_words, 1)", lambda a, b: f"cast(rule_stats.{a} as double) / greatest(rule_stats.{b}, 1)"
    return [F.expr(f"cast(round({GRID} * {e}) as bigint)") for e in (
        f"ln(cast({n} as double))", f"ln(1 + cast(rule_stats.word_chars as double) / {n})", f"ln(1 + 100 * {share('n_symbols', 'word_chars')})",
        share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"))]


def _vectors(df: DataFrame) -> DataFrame:
    return df.withColumns({f"rule_x{i}": c for i, c in enumerate(features())})


def _distance(centre: str = "rule_centre", inverse: str = "rule_inverse") -> Column:
    x = [F.col(f"rule_x{i}") - F.col(centre)[i] for i in range(DIMS)]
    return sum((F.col(inverse)[k] * x[i] * x[j] * (1 if i == j else 2) for k, (i, j) in enumerate(PAIRS)), F.lit(0.0))


def _grid(d: Column) -> Column:
    """Squared distance on a logarithmic grid of 1/64: at most some thousand values, so its exact quantiles have a bounded state."""
    return F.floor(64 * F.log1p(d)).cast("bigint")


def _estimates(sums: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Centre and inverse scatter of each group from its exact sums."""
    floor = (np.array(FLOOR) * GRID) ** 2
    for part in sums:
        n = part["n"].to_numpy(float)
        mean = np.stack([part[f"s{i}"].to_numpy(float) / n for i in range(DIMS)], 1)
        scatter = np.zeros((len(n), DIMS, DIMS))
        for i, j in PAIRS:
            scatter[:, i, j] = scatter[:, j, i] = part[f"q{i}{j}"].to_numpy(float) / n - mean[:, i] * mean[:, j]
        scatter[:, range(DIMS), range(DIMS)] += floor
        inverse = np.linalg.inv(scatter)
        yield pd.DataFrame({"rule_pool": part["rule_pool"], "rule_centre": list(mean), "rule_inverse": [[m[i, j] for i, j in PAIRS] for m in inverse]})


def _same(a: str, left: DataFrame, right: DataFrame) -> Column:
    return left[a].eqNullSafe(right[a])


def fit(stats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pools of the groups (lang, source, rule_pool), and one row of parameters per pool. `stats` has lang, source, rule_stats."""
    sizes = stored(stats.groupBy("lang", "source").agg(F.count_if(~failed_floor()).alias("n"), F.to_json(F.struct("lang"), NULLS).alias("rule_lang")), "rule-sizes")
    langs = sizes.groupBy("rule_lang").agg(F.sum("n").alias("of_lang"))
    own, by_lang = F.col("n") >= LEAST, F.col("of_lang") >= LEAST
    pool = F.when(own, F.to_json(F.struct("lang", "source"), NULLS)).when(by_lang, F.col("rule_lang")).otherwise(EVERY)
    groups = stored(sizes.join(langs, "rule_lang").select("lang", "source", "rule_lang", F.lit(EVERY).alias("rule_every"), pool.alias("rule_pool")), "rule-pools")
    pools = groups.select("lang", "source", "rule_pool")
    used = groups.select(F.col("rule_pool").alias("used")).distinct()  # a wider pool is estimated from all its documents, where a group needs it
    wider = [groups.join(used, F.col(c) == F.col("used")).select("lang", "source", F.col(c).alias("rule_pool")) for c in ("rule_lang", "rule_every")]
    members = stored(pools.union(wider[0]).union(wider[1]).distinct(), "rule-members")
    rows = _pooled(_vectors(stats.filter(~failed_floor())), members).select("rule_pool", *(f"rule_x{i}" for i in range(DIMS)))
    rows = stored(rows, "rule-vectors")
    centre = rows.groupBy("rule_pool").agg(F.count(F.lit(1)).alias("rule_n"), F.array(*(F.percentile(f"rule_x{i}", 0.5) for i in range(DIMS))).alias("rule_centre"))
    spread = rows.join(centre, "rule_pool").groupBy("rule_pool", "rule_n", "rule_centre").agg(
        *(F.percentile(F.abs(F.col(f"rule_x{i}") - F.col("rule_centre")[i]), 0.5).alias(f"m{i}") for i in range(DIMS)))
    inverse = [1 / (F.pow(1.4826 * F.col(f"m{i}"), 2) + (FLOOR[i] * GRID) ** 2) if i == j else F.lit(0.0) for i, j in PAIRS]
    params = stored(spread.select("rule_pool", "rule_centre", F.array(*inverse).alias("rule_inverse")), "rule-start")
    for step in range(STEPS):
        near = rows.join(params, "rule_pool").withColumn("d", _grid(_distance()))
        limit = near.groupBy("rule_pool").agg(F.percentile("d", SHARE_PCT / 100).alias("limit"))
        kept = near.join(stored(limit, f"rule-limit{step}"), "rule_pool").filter(F.col("d") <= F.col("limit"))
        x = lambda i: F.col(f"rule_x{i}")
        sums = kept.groupBy("rule_pool").agg(F.count(F.lit(1)).alias("n"), *(F.sum(x(i)).alias(f"s{i}") for i in range(DIMS)), *(F.sum(x(i) * x(j)).alias(f"q{i}{j}") for i, j in PAIRS))
        params = stored(sums.mapInPandas(_estimates, "rule_pool string, rule_centre array<double>, rule_inverse array<double>"), f"rule-step{step}")
    scale = rows.join(params, "rule_pool").withColumn("d", _grid(_distance())).groupBy("rule_pool").agg(
        F.count(F.lit(1)).alias("rule_n"), F.greatest(F.expm1(F.percentile("d", 0.5) / 64), F.lit(0.1)).alias("rule_median"))
    params = params.join(scale, "rule_pool").filter(F.col("rule_n") >= LEAST)
    return pools, stored(params, "rule-params")


def _pooled(df: DataFrame, pools: DataFrame) -> DataFrame:
    return df.join(pools, _same("lang", df, pools) & _same("source", df, pools), "left").drop(pools["lang"]).drop(pools["source"])


def verdicts(df: DataFrame, fitted: tuple[DataFrame, DataFrame]) -> DataFrame:
    """`df` (lang, source, rule_stats, anything else) with rule_failed, rule_distance (null without an estimate) and rule_kept."""
    pools, params = fitted
    names = df.columns
    joined = _pooled(_vectors(df), pools).join(params, "rule_pool", "left")
    failed = failed_floor()
    distance = _distance() * CHI2_MEDIAN / F.col("rule_median")
    return joined.select(*(F.col(f"`{n}`") for n in names), failed.alias("rule_failed"), distance.alias("rule_distance"),
                         (~failed & (F.coalesce(distance, F.lit(0.0)) <= CUTOFF)).alias("rule_kept"))


def judge(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, lang, source, rule_stats, rule_failed, rule_distance, rule_kept."""
    stats = stored(with_statistics(docs.select("doc_id", "text", "lang", "source")).drop("text"), "rule-stats")
    return verdicts(stats, fit(stats))


def apply_rules(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with their own columns. The texts are measured twice and never shuffled unless the group table is large."""
    stats = stored(with_statistics(docs.select("text", "lang", "source")).drop("text"), "rule-stats")
    safe, restored = set_aside(docs, "rule_")
    return restored(verdicts(with_statistics(safe), fit(stats)).filter("rule_kept"))
