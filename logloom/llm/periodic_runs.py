"""Periodic runs of words, found in tiles of every period scale and stitched.

A run is a stretch of words that repeats with its smallest period q (words q apart are equal), is at least 12 words and 2 q long, and can be extended on neither side. Periods fall into octaves, 2^k up to
2^(k+1). For each octave a text is exploded into overlapping tiles of a few times that scale; each tile is solved by itself. In a tile lie boundaries, spaced so that every run has one in it;
at a boundary c two Z-functions tell how far the words after c and those q later agree, and how far the words before them do, for all q of the octave. Together they are a fragment of
the stretch in which words q apart are equal. Fragments are shuffled by document and period, and those that touch are stitched to whole stretches; of stretches in the same place the smallest period counts.

Z-functions are taken only where the word at c recurs q later. Where a few periods are left, words are compared directly, many boundaries at once; where many are, as in texts of one word, by the
linear algorithm, so no text costs more than its length times the number of octaves.

Tiles of a short text are one, the text itself. Texts above `LONG_CHARS` are exploded and then dealt out by tile, so several tasks solve one text. All words are compared by 64 bits of a hash.

Defined cases: null, empty and blank texts have no words and no runs. Words are separated by space and U+0009 to U+000D. Rows with the same id and text have the same runs; a null id takes part. Runs may overlap and
nest; all are returned. An empty table gives no rows. Extra columns stay; those called like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.tables import hash_key, own_columns, stored
from logloom.llm.words import Words, chunks, mix

LEAST = 12              # words of a run
TILE = 4096             # words between the first boundaries of two tiles, at least
LONG_CHARS = 1 << 20    # texts whose tiles are dealt out
SOLVE_WORDS = 200_000   # words of the tiles solved together
CELLS = 1 << 19         # comparisons made at a time
FEW = 64                # periods at a boundary that are compared directly
COLUMNS = ("run_spans", "run_words")
SPANS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_TILE_FIELDS = "run_key bigint, low int, high int, own bigint, own_end bigint, first bigint, words_total bigint, words binary"


def least_equal(period):
    """Equal words, q apart, that a run of period q holds at least."""
    return np.maximum(period, LEAST - period)


def spacing(octave: int) -> int:
    """Distance of the boundaries: what every run of the octave has at least in equal words."""
    return int(least_equal(np.arange(1 << octave, 2 << octave)).min())


SHARED = TILE.bit_length() - 4  # octaves up to here share one set of tiles: their periods are below a quarter of a tile


def tiles_of(n: int) -> list[tuple[int, int, int, int, int, int]]:
    """Lowest and highest octave, first own boundary and the end of the own ones, first and last word, of all tiles of a text of n words."""
    top = (n // 2).bit_length() - 1
    if n < LEAST:
        return []
    out, low = [], 0
    while low <= top:
        high = max(low, SHARED)
        stride = max(TILE, 8 << low)
        if n <= stride:
            out.append((low, top, 0, n, 0, n))
            break
        scale = 2 << high
        out += [(low, min(high, top), x, min(x + stride, n), max(0, x - scale), min(n, x + stride + 2 * scale)) for x in range(0, n, stride)]
        low = high + 1
    return out


def z_function(words: list) -> list[int]:
    """How many words from each place on agree with the first ones."""
    z, left, right = [0] * len(words), 0, 0
    for i in range(1, len(words)):
        k = min(z[i - left], right - i) if i < right else 0
        while i + k < len(words) and words[k] == words[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _agree(ids: np.ndarray, a: np.ndarray, b: np.ndarray, most: int, forward: bool) -> np.ndarray:
    """Words that agree from places a and b on (or before them), at most `most`. Far places of the array must differ."""
    out, live, done, width = np.zeros(len(a), np.int64), np.arange(len(a)), 0, 2
    while len(live) and done < most:
        w = min(width, most - done)
        view, still = sliding_window_view(ids, w), []
        for s in range(0, len(live), max(1, CELLS // w)):
            rows = live[s:s + max(1, CELLS // w)]
            x, y = (a[rows] + done, b[rows] + done) if forward else (a[rows] - done - w, b[rows] - done - w)
            same = view[x] == view[y]
            if not forward:
                same = same[:, ::-1]
            whole = same.all(1)
            out[rows] += np.where(whole, w, same.argmin(1))
            still.append(rows[whole])
        live, done, width = np.concatenate(still), done + w, min(width * 2, 1024)
    return out


def _reach(ids: np.ndarray, at: np.ndarray, period: np.ndarray, octave: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Equal words before and after each boundary `at` (sorted), at most `most`."""
    ahead = _agree(ids, at, at + period, min(8, most), True)
    near = np.flatnonzero(ahead == min(8, most))
    back = _agree(ids, at, at + period, most, False) if most <= 8 else np.zeros(len(at), np.int64)
    if most <= 8:
        return back, ahead
    # A boundary with fewer than 8 equal words after it can still be the only one of a stretch, so the words before it count for all.
    places, first, count = np.unique(at, return_index=True, return_counts=True)
    many = np.repeat(count > FEW, count)
    few = np.flatnonzero(~many)
    back[few] = _agree(ids, at[few], (at + period)[few], most, False)
    near = near[~many[near]]
    ahead[near] = _agree(ids, at[near], (at + period)[near], most, True)
    scale = 1 << octave
    for c, f, n in zip(places[count > FEW], first[count > FEW], count[count > FEW]):
        q = period[f:f + n]
        text = ids[c + scale:c + 2 * scale + most].tolist()
        ahead[f:f + n] = np.minimum(most, np.array(z_function([*ids[c:c + most].tolist(), None, *text]))[most + 1 + q - scale])
        text = ids[c + scale - most:c + 2 * scale].tolist()[::-1]
        back[f:f + n] = np.minimum(most, np.array(z_function([*ids[c - most:c].tolist()[::-1], None, *text]))[most + 1 + 2 * scale - q])
    return back, ahead


def solve(tiles: list[dict]) -> list[np.ndarray]:
    """Row of the tile, period, start and stop of the fragments; start and stop enclose the words that are equal to the word one period later."""
    words = [np.frombuffer(t["words"], np.uint64) for t in tiles]
    size = np.array([len(w) for w in words])
    field = {k: np.array([t[k] for t in tiles], np.int64) for k in ("low", "high", "own", "own_end", "first", "words_total")}
    pad = 4 << int(field["high"].max(initial=0))
    row = np.repeat(np.arange(len(tiles)), size)
    own = mix(np.concatenate(words) + mix((row + 1).astype(np.uint64)))  # words of different tiles are never equal
    edge = np.arange(2 * (pad + LEAST), dtype=np.uint64)
    ids = np.concatenate([mix(edge[::2] + np.uint64(1 << 40)), own, mix(edge[1::2] + np.uint64(1 << 41))])
    start = np.cumsum(size) - size + pad + LEAST
    found = []
    for octave in range(int(field["low"].min(initial=0)), int(field["high"].max(initial=-1)) + 1):
        scale, step = 1 << octave, spacing(octave)
        of = np.flatnonzero((field["low"] <= octave) & (octave <= field["high"]) & (field["words_total"] >= max(2 * scale, LEAST)))
        head = -(-field["own"][of] // step)
        count = np.maximum(0, -(-field["own_end"][of] // step) - head)
        tile = np.repeat(of, count)
        c = (np.arange(len(tile)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(head, count)) * step
        place = start[tile] + c - field["first"][tile]
        view = sliding_window_view(ids, scale)
        each = max(1, CELLS // scale)
        for s in range(0, len(tile), each):
            p = place[s:s + each]
            which, far = np.nonzero(view[p + scale] == ids[p][:, None])
            if not len(which):
                continue
            q = far + scale
            back, ahead = _reach(ids, p[which], q, octave, step)
            ok = back + ahead >= step
            which, q, back, ahead = which[ok] + s, q[ok], back[ok], ahead[ok]
            found.append(np.stack([tile[which], q, c[which] - back, c[which] + ahead]))
    if not found:
        return [np.zeros(0, np.int64)] * 4
    tile, q, a, z = np.concatenate(found, 1)
    order = np.lexsort((a, q, tile))
    tile, q, a, z = tile[order], q[order], a[order], z[order]
    group = np.ones(len(tile), bool)
    group[1:] = (tile[1:] != tile[:-1]) | (q[1:] != q[:-1]) | (a[1:] > z[:-1])  # fragments of a boundary hold their predecessor's end, and ends grow with starts
    first = np.flatnonzero(group)
    tile, q, a, z = tile[first], q[first], a[first], np.maximum.reduceat(z, first)
    alone = (field["own"] == 0) & (field["own_end"] == field["words_total"])  # the whole text: nothing to be stitched to
    ok = ~alone[tile] | (z - a >= least_equal(q))
    return [x[ok] for x in (tile, q, a, z)]


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, most=1_000_000):
            w = Words(part.column("text"))
            offs = np.concatenate([[0], np.cumsum(w.count)])
            keys = part.column("run_key").to_pylist()
            rows = []
            for key, n, at in zip(keys, w.count.tolist(), offs.tolist()):
                rows += [(key, low, high, own, end, a, n, w.hash[at + a:at + z].tobytes()) for low, high, own, end, a, z in tiles_of(n)]
                if sum(len(r[-1]) for r in rows[-8:]) > 8 * SOLVE_WORDS or len(rows) >= 1000:
                    yield _tile_batch(rows)
                    rows = []
            yield _tile_batch(rows)


def _tile_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[f.split()[0] for f in _TILE_FIELDS.split(", ")])


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def done(tiles):
        tile, q, a, z = solve(tiles)
        keys = np.array([t["run_key"] for t in tiles], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(keys[tile]), pa.array(q), pa.array(a), pa.array(z)], names=["run_key", "period", "start", "stop"])

    for batch in batches:
        held, words = [], 0
        for i in range(batch.num_rows):
            t = batch.slice(i, 1).to_pylist()[0]
            held.append(t)
            words += len(t["words"]) // 8
            if words >= SOLVE_WORDS:
                yield done(held)
                held, words = [], 0
        if held:
            yield done(held)


def run_key():
    return hash_key("doc_id", "text", seed=61)


def fragments(docs: DataFrame) -> DataFrame:
    """run_key, period, start, stop of the stretches found in single tiles. `docs` has run_key and text."""
    long = F.length("text") > LONG_CHARS
    rows = docs.select("run_key", "text")
    found = "run_key bigint, period bigint, start bigint, stop bigint"
    short = rows.filter(~F.coalesce(long, F.lit(False))).mapInArrow(lambda batches: _solve(_explode(batches)), found)  # one worker a task
    dealt = rows.filter(long).mapInArrow(_explode, _TILE_FIELDS).repartition(F.xxhash64("run_key", "low", "own"))
    return short.unionByName(dealt.mapInArrow(_solve, found))


def stitch(pieces: DataFrame) -> DataFrame:
    """run_key, start, length, period of all runs, from fragments of equal stretches."""
    of = Window.partitionBy("run_key", "period").orderBy("start", "stop")
    before = F.max("stop").over(of.rowsBetween(Window.unboundedPreceding, -1))
    marked = pieces.distinct().withColumn("begins", F.when(F.col("start") <= before, 0).otherwise(1))
    whole = marked.withColumn("piece", F.sum("begins").over(of.rowsBetween(Window.unboundedPreceding, 0))).groupBy("run_key", "period", "piece").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    length = F.col("stop") - F.col("start") + F.col("period")
    runs = whole.withColumn("length", length).filter(f"length >= {LEAST} and length >= 2 * period")
    return runs.groupBy("run_key", "start", "length").agg(F.min("period").alias("period"))


def _with_spans(docs: DataFrame) -> DataFrame:
    """`docs` with run_spans (sorted by start, then period; empty without runs)."""
    docs, back = own_columns(docs, "run_", COLUMNS)
    docs = docs.withColumn("run_key", run_key())
    runs = stitch(stored(fragments(docs), "run-fragments"))
    spans = runs.groupBy("run_key").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("found"))  # the runs of one text
    spans = stored(spans.select("run_key", F.transform("found", lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period"))).alias("run_spans")), "run-spans")
    spans = spans.hint("merge")  # texts meet their runs in a shuffle at every size, so a small table tells what a large one costs
    return back(docs.join(spans, "run_key", "left").withColumn("run_spans", F.coalesce("run_spans", F.array().cast(SPANS))).drop("run_key"))


def find(docs: DataFrame) -> DataFrame:
    """All columns and run_spans: start (word number), length and period of each run."""
    return _with_spans(docs)


def collapse(docs: DataFrame) -> DataFrame:
    """All columns, the text replaced by its kept words joined by one space, run_spans and run_words (words of the whole text). Words that a run contains after its first period go."""
    rows = _with_spans(docs)
    names = rows.columns
    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                w = Words(part.column("text"), hashed=False)
                base = np.concatenate([[0], np.cumsum(w.count)])
                lists = part.column("run_spans")
                row = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
                flat = lists.flatten()
                start, length, period = (flat.field(k).to_numpy() for k in range(3))
                inside = np.zeros(base[-1] + 1, np.int64)
                np.add.at(inside, base[row] + start + period, 1)
                np.add.at(inside, base[row] + start + length, -1)
                keep = np.cumsum(inside)[:-1] == 0
                raw, doc = w.data.tobytes(), w.doc[keep]
                pieces = [raw[a:z] for a, z in zip(w.start[keep].tolist(), w.end[keep].tolist())]
                cuts = np.searchsorted(doc, np.arange(part.num_rows + 1))
                texts = pa.array([b" ".join(pieces[a:z]) for a, z in zip(cuts, cuts[1:])], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*(texts if c == "text" else part.column(c) for c in names), pa.array(w.count.astype(np.int64))], names=[*names, "run_words"])

    return rows.mapInArrow(run, f"{schema}, run_words bigint")
