"""Repeated passages removed by distributed prefix doubling.

Every `SIZE`-byte string that begins at two places, in one text or in two, is repeated; all bytes under repeated strings go. Spark sorts places by pairs of ranks and gives neighbours that agree a common rank; a
place whose rank is unique is settled, and so is one whose whole pair is shared. The others go on with a longer common prefix. A rank is a 64-bit name of bytes, so the ranks of the next offset come
from a row itself and need no second lookup.

Sorting all places of a text would move many times its bytes, so places go together as long as they share their ranks:

    32 bytes    Of the places of a string the 32 bytes with the least hash are its anchor, so equal strings have equal anchors in the same place. Strings with the same anchor are neighbours and
                make one row, some 85 on average. Rank pair: the anchor, and all bytes under the row's strings.
    193 bytes   Rows that share the anchor but not all bytes are cut into 8 strings by their distance to it. Rank pair: the 193 bytes that the 8 strings share, and the 7 bytes on either side.
    200 bytes   Rows that share 193 bytes but not all become single strings, the threshold. Rank pair: the shared bytes, and the string's own ones.

In each round, of rows with the same pair one goes on for all. Sorts are by pair, then place, over ranges, so a passage in any number of texts is spread over tasks. Whether the rows at the border of a range have
a neighbour beyond it is left to the next round; after the last, the at most two rows of a range that are in doubt are compared with each other.

Equal texts are one text with a number of copies, named by 64 bits of a hash: with two copies and `SIZE` bytes everything goes.

Defined cases: null text counts as empty; texts shorter than a string lose nothing. Repeated rows are copies. Strings are compared as bytes and judged on the input; places may overlap. Removed bytes may leave part of a code
point, so what is kept is binary. A null id takes part. An empty table gives no rows. Extra columns stay; those called like a result are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.tables import own_columns, quoted, stored
from logloom.llm.words import _BYTE, _STEP, _UNSTEP, _power, chunks, mix, text_bytes

SIZE = 200              # bytes of a string
ANCHOR = 32             # bytes of an anchor
SIDE = 8                # strings of a row of the second round
SHARED = SIZE - SIDE + 1
SEGMENT = 1 << 20       # bytes worked on at a time
TASK_ROWS = 500_000     # rows of a sorted range
SALTS = 64              # parts of the copies of a text
COLUMNS = ("dup_kept", "dup_bytes", "dup_removed", "dup_spans")
WINDOW = SIZE - ANCHOR + 1


class Ranks:
    """Names of byte ranges of an array."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * _power(_STEP, max(len(data), 1))[:len(data)], out=self.sums[1:])
        self.back = _power(_UNSTEP, len(data) + 1)

    def of(self, start, stop) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.back[start])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` neighbouring values, from the running minima of blocks."""
    n = len(values) - width + 1
    whole = -(-len(values) // width) * width
    padded = np.full(whole, np.iinfo(np.uint64).max)
    padded[:len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def anchored(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Text, first string, strings, distance of the anchor from the first string, rank of the anchor, rank of all bytes, for each row of the first round."""
    at, n = 0, len(data)
    while at + SIZE <= n:
        end = min(n, at + SEGMENT + SIZE)
        ranks = Ranks(data[at:end])
        starts = np.arange(end - at - ANCHOR + 1)
        gram = ranks.of(starts, starts + ANCHOR)
        low = np.uint64(32)
        least = (sliding_least((gram >> low << low) | starts.astype(np.uint64), WINDOW) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        begin = at + np.arange(len(least))
        text = np.searchsorted(offs, begin, "right") - 1
        string = np.flatnonzero(begin + SIZE <= offs[text + 1])
        if not len(string):
            at += len(least)
            continue
        place = least[string]
        cut = np.flatnonzero((place[1:] != place[:-1]) | (string[1:] != string[:-1] + 1)) + 1
        first, last = np.append(0, cut), np.append(cut, len(string)) - 1
        following = at + len(least)
        if end < n and string[-1] == len(least) - 1 and len(first) > 1:  # the last row may go on
            following = at + string[first[-1]]
            first, last = first[:-1], last[:-1]
        a, z, anchor = string[first], string[last], place[first]
        count = z - a + 1
        whole = ranks.of(a, z + SIZE) ^ mix((anchor - a).astype(np.uint64) * np.uint64(1024) + count.astype(np.uint64))
        doc = text[a]
        yield doc, at + a - offs[doc], count, anchor - a, gram[anchor], whole
        at = following


def _rows(texts: pa.Array, keys: np.ndarray, salts: np.ndarray) -> Iterator[pa.RecordBatch]:
    data, offs = text_bytes(texts)
    for doc, at, count, anchor, gram, whole in anchored(data, offs):
        yield _batch(("one", gram), ("two", whole), ("dup_key", keys[doc]), ("at", at), ("more", count << 16 | anchor), ("dup_salt", salts[doc]))


def _batch(*columns: tuple[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v.view(np.int64) if v.dtype == np.uint64 else v.astype(np.int64)) for _, v in columns], names=[k for k, _ in columns])


def _pieces(texts: pa.Array, keys: np.ndarray, undecided: list[list[dict]]) -> Iterator[pa.RecordBatch]:
    """Rows of the second round: `more` is the first string's distance to the anchor modulo SIDE and the strings that the row stands for, as bits."""
    data, offs = text_bytes(texts)
    if not len(data):
        return
    ranks = Ranks(data)
    doc = np.repeat(np.arange(len(offs) - 1), [len(u) for u in undecided])
    at, more = (np.array([r[k] for u in undecided for r in u], np.int64) for k in ("at", "more"))
    for s in range(0, len(doc), 20_000):
        d, a, m = doc[s:s + 20_000], at[s:s + 20_000], more[s:s + 20_000]
        count, far = m >> 16, m & 0xFFFF        # distances of the strings: from far - count + 1 to far
        low, high = (far - count + 1) // SIDE, far // SIDE
        side = np.repeat(np.arange(len(d)), high - low + 1)
        block = np.arange(len(side)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1) + low[side]
        begin, end, anchor = offs[d][side], offs[d + 1][side], (offs[d] + a + far)[side]
        start = anchor - SIDE * block           # of the shared bytes
        left, right = np.zeros(len(side), np.uint64), np.zeros(len(side), np.uint64)
        for k in range(1, SIDE):                # the nearest byte is the lowest; places beyond the text stay 0 and do not count
            for value, place, ok in ((left, start - k, start - k >= begin), (right, start + SHARED + k - 1, start + SHARED + k - 1 < end)):
                byte = data[np.clip(place, 0, len(data) - 1)].astype(np.uint64) * ok
                value |= byte << np.uint64(8 * (k - 1))
                value += ok.astype(np.uint64) << np.uint64(56)  # how many there are
        distance = SIDE * block[:, None] + np.arange(SIDE)
        stands = ((distance >= (far - count + 1)[side][:, None]) & (distance <= far[side][:, None])) @ (1 << np.arange(SIDE))
        yield _batch(("one", ranks.of(start, start + SHARED) ^ mix(block.astype(np.uint64))), ("two", left), ("three", right), ("dup_key", keys[d][side]), ("at", start - begin), ("more", stands))


def _ordered(rows: DataFrame, ranks: tuple[str, ...], tasks: int) -> DataFrame:
    order = [*ranks, "dup_key", "at", "more", *(["dup_salt"] if "dup_salt" in rows.columns else [])]
    return rows.repartitionByRange(max(1, tasks), *order).sortWithinPartitions(*order)


class Neighbours:
    """A sorted range: rows that repeat another one dropped, and what rows share with others. `border` are the first and last rows of the range by the whole pair."""

    def __init__(self, batches: Iterator[pa.RecordBatch], ranks: tuple[str, ...]):
        table = pa.Table.from_batches(list(batches))
        columns = {c: table.column(c).to_numpy() for c in table.schema.names if c != "dup_salt"}
        n = table.num_rows
        change = lambda names: np.append(True, np.logical_or.reduce([columns[c][1:] != columns[c][:-1] for c in names])) if n else np.zeros(0, bool)
        own = change([*ranks, "dup_key", "at", "more"])
        self.column = {c: v[own] for c, v in columns.items()}
        columns, n = self.column, int(own.sum())
        first, pair = change(ranks[:1]), change(ranks)
        self.lead = pair                     # first of its pair
        self.copies = np.diff(np.append(np.flatnonzero(pair), n))[np.cumsum(pair) - 1] if n else np.zeros(0, np.int64)
        of = np.cumsum(first) - 1
        self.pairs = np.bincount(of, pair)[of] if n else np.zeros(0)
        self.outer = (of == 0) | (of == of[-1]) if n else np.zeros(0, bool)  # the first rank may go on in another range
        number = np.cumsum(pair) - 1
        self.border = (number == 0) | (number == number[-1]) if n else np.zeros(0, bool)

    def take(self, rows: np.ndarray, *names: str) -> list[np.ndarray]:
        return [self.column[c][rows] for c in names]


def _settle_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    near = Neighbours(batches, ("one", "two"))
    repeated, on = near.copies > 1, near.lead & ((near.pairs > 1) | near.outer)
    key, at, more = near.take(repeated, "dup_key", "at", "more")
    yield _batch(("dup_key", key), ("start", at), ("stop", at + (more >> 16) + SIZE - 1), ("more", np.full(len(key), -1)))
    key, at, more = near.take(on, "dup_key", "at", "more")
    yield _batch(("dup_key", key), ("start", at), ("stop", at), ("more", more))


def _settle_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated strings as spans (three is -1), and single strings for the last round."""
    near = Neighbours(batches, ("one", "two", "three"))
    repeated, on = near.copies > 1, near.lead & ((near.pairs > 1) | near.outer)
    key, at, more = near.take(repeated, "dup_key", "at", "more")
    for j in range(SIDE):
        here = more >> j & 1 > 0
        yield _batch(("one", key[here] * 0), ("two", key[here] * 0), ("dup_key", key[here]), ("at", at[here] - j), ("more", np.full(int(here.sum()), -1)))
    one, left, right, key, at, more = near.take(on, "one", "two", "three", "dup_key", "at", "more")
    left, right = left.view(np.uint64), right.view(np.uint64)
    for j in range(SIDE):
        here = more >> j & 1 > 0
        bits = lambda v, k: v[here] & np.uint64((1 << 8 * k) - 1)
        own = mix(mix(bits(left, j) + np.uint64(j + 1)) + bits(right, SIDE - 1 - j))
        yield _batch(("one", one[here]), ("two", own), ("dup_key", key[here]), ("at", at[here] - j), ("more", key[here] * 0))


def _settle_last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated strings, and those in doubt: `sure` is false for a border row without a neighbour in its range. A border pair with neighbours has one row that is `border` too."""
    near = Neighbours(batches, ("one", "two"))
    out = (near.copies > 1) | near.border
    columns = near.take(out, "one", "two", "dup_key", "at")
    batch = _batch(*zip(("one", "two", "dup_key", "at"), columns))
    flags = [pa.array(near.copies[out] > 1), pa.array((near.border & near.lead)[out])]
    yield pa.RecordBatch.from_arrays([*batch.columns, *flags], names=[*batch.schema.names, "sure", "border"])


def spans(docs: DataFrame) -> DataFrame:
    """dup_key, start, stop of the repeated bytes; they may overlap. `docs` has dup_key, salt, text; of equal texts only those of the least salt give rows."""
    keys = stored(docs.groupBy("dup_key").agg(F.count(F.lit(1)).alias("copies"), F.min("dup_salt").alias("dup_salt"), F.first("dup_size").alias("dup_size"))
                  .filter(f"dup_size >= {SIZE}"), "suffix-texts")
    size = keys.agg(F.sum("dup_size")).first()[0] or 0

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                yield from _rows(part.column("text"), part.column("dup_key").to_numpy(), part.column("dup_salt").to_numpy())

    schema = "one bigint, two bigint, dup_key bigint, at bigint, more bigint"
    rows = docs.filter(f"dup_size >= {SIZE}").select("text", "dup_key", "dup_salt").mapInArrow(first, schema + ", dup_salt bigint")
    tasks = math.ceil(size / 64 / TASK_ROWS)
    one = stored(_ordered(rows, ("one", "two"), tasks).mapInArrow(_settle_first, "dup_key bigint, start bigint, stop bigint, more bigint"), "suffix-one")
    found = one.filter("more = -1").select("dup_key", "start", "stop")

    asked = one.filter("more <> -1").groupBy("dup_key").agg(F.collect_set(F.struct(F.col("start").alias("at"), "more")).alias("undecided"))  # rows of one text
    asked = stored(asked.join(keys.select("dup_key", "dup_salt"), "dup_key"), "suffix-asked")

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                yield from _pieces(part.column("text"), part.column("dup_key").to_numpy(), part.column("undecided").to_pylist())

    texts = docs.select("text", "dup_key", "dup_salt").join(asked, ["dup_key", "dup_salt"])
    rows = texts.select("text", "dup_key", "undecided").mapInArrow(second, "one bigint, two bigint, three bigint, dup_key bigint, at bigint, more bigint")
    two = stored(_ordered(rows, ("one", "two", "three"), math.ceil(size / 64 / TASK_ROWS)).mapInArrow(_settle_pieces, schema), "suffix-two")
    found = found.unionByName(two.filter("more = -1").select("dup_key", F.col("at").alias("start"), (F.col("at") + SIZE).alias("stop")))

    last = two.filter("more = 0")
    tasks = math.ceil(last.count() / TASK_ROWS)
    three = stored(_ordered(last, ("one", "two"), tasks).mapInArrow(_settle_last, "one bigint, two bigint, dup_key bigint, at bigint, sure boolean, border boolean"), "suffix-three")
    borders = three.filter("border").groupBy("one", "two").agg(F.count_distinct("dup_key", "at").alias("n")).filter("n > 1").select("one", "two")  # at most two rows of a range
    doubt = three.filter("not sure").join(F.broadcast(borders), ["one", "two"], "left_semi")
    for rows in (three.filter("sure"), doubt):
        found = found.unionByName(rows.select("dup_key", F.col("at").alias("start"), (F.col("at") + SIZE).alias("stop")))
    whole = keys.filter("copies > 1").select("dup_key", F.lit(0).cast("bigint").alias("start"), "dup_size", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")).alias("dup_salt"))
    rest = found.join(keys.filter("copies = 1").select("dup_key", "dup_salt"), "dup_key").select("dup_key", "start", "stop", "dup_salt")
    return rest.unionByName(whole.withColumnRenamed("dup_size", "stop"))


def find(docs: DataFrame) -> DataFrame:
    """All columns and dup_spans: start and stop of the maximal removed runs of bytes (as pairs that may overlap, unsorted), null where nothing goes."""
    docs, back = own_columns(docs, "dup_", COLUMNS)
    names = docs.columns
    docs = docs.withColumns({"dup_key": F.xxhash64(F.coalesce("text", F.lit(""))), "dup_size": F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint"),
                             "dup_salt": F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("bigint")})
    grouped = spans(docs).groupBy("dup_key", "dup_salt").agg(F.collect_list(F.struct("start", "stop")).alias("dup_spans"))  # spans of one text
    return back(docs.join(grouped, ["dup_key", "dup_salt"], "left").select(*map(quoted, names), "dup_spans"))


def dedup(docs: DataFrame) -> DataFrame:
    """All columns, dup_kept (the bytes that stay), dup_bytes, dup_removed, and dup_spans (maximal removed runs: start, stop)."""
    rows = find(docs)
    names = rows.columns[:-1]
    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                data, offs = text_bytes(part.column("text"))
                raw, lists = data.tobytes(), part.column("dup_spans")
                size = np.diff(offs)
                row = np.repeat(np.arange(part.num_rows), lists.value_lengths().fill_null(0).to_numpy())
                flat = lists.flatten()
                start, stop = (flat.field(k).to_numpy() for k in range(2))
                edge = np.zeros(len(data) + 1, np.int64)
                np.add.at(edge, offs[row] + start, 1)
                np.add.at(edge, offs[row] + stop, -1)
                gone = np.cumsum(edge)[:-1] > 0
                shift = np.append(gone[1:], False)
                border = np.zeros(len(data) + 1, bool)
                border[offs] = True
                begins = np.flatnonzero(gone & (border[:-1] | ~np.append(False, gone[:-1])))
                ends = np.flatnonzero(gone & (border[1:] | ~shift)) + 1
                doc = np.searchsorted(offs, begins, "right") - 1
                cuts = np.searchsorted(doc, np.arange(part.num_rows + 1))
                kept, found = [], []
                for i in range(part.num_rows):
                    base, at, own, pieces = int(offs[i]), int(offs[i]), [], []
                    for b, e in zip(begins[cuts[i]:cuts[i + 1]].tolist(), ends[cuts[i]:cuts[i + 1]].tolist()):
                        pieces.append(raw[at:b])
                        own.append({"start": b - base, "stop": e - base})
                        at = e
                    kept.append(b"".join([*pieces, raw[at:int(offs[i + 1])]]))
                    found.append(own)
                removed = np.bincount(doc, ends - begins, part.num_rows).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(kept, pa.binary()), pa.array(size.astype(np.int64)), pa.array(removed), pa.array(found, kind)],
                                                 names=[*names, "dup_kept", "dup_bytes", "dup_removed", "dup_spans"])

    return rows.mapInArrow(run, f"{schema}, dup_kept binary, dup_bytes bigint, dup_removed bigint, dup_spans array<struct<start:bigint,stop:bigint>>")
