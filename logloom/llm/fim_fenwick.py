"""Fill-in-middle transformation, cut places found in a Fenwick tree over text blocks.

A text is cut into units (code points, or words with the blanks before them) and its UTF-8 bytes into blocks of `BLOCK` bytes. A Fenwick tree over the blocks holds, for each node, the units and the
code points that begin in the blocks it covers. A cut after k units is found by binary lifting: the descent takes the largest steps whose units still fit into k and adds up the code points on its
way; it ends in the block that holds the boundary, which is then looked for in that block's bytes alone. The trees of many texts are built and descended together, as numpy arrays.

Two cuts, from a hash of the id, give prefix, middle and suffix; the rest of the hash chooses the form:

    plain   the text itself: empty texts, texts that hold a marker, and one in ten
    psm     <P> prefix <S> suffix <M> middle
    spm     <S> suffix <P> prefix <M> middle

A marker cannot arise across a border, as it begins with its only `<`, so `restore` rebuilds the text from output and form alone.

Defined cases: null text counts as empty, and is plain. Null id hashes like the empty string. Repeated rows get the same cuts. Cuts may fall together or on the ends: parts are then empty. Texts of any length are cut
whole. An empty table gives no rows. Extra columns stay; those called like a result (`fim_text`, ...) are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.tables import quoted
from logloom.llm.words import SPACE, chunks, text_bytes

BLOCK = 512           # bytes of a block
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_PERCENT = 10    # of the texts that could be cut
SPM_PERCENT = 20      # of those that are cut
SALT = "1:"           # goes before the id in the hash
UNITS = ("code_point", "word")
COLUMNS = ("fim_text", "fim_form", "fim_units", "fim_prefix_chars", "fim_middle_chars")
FORMS = ("plain", "psm", "spm")


def draws(doc_id: Column) -> list[Column]:
    """Four 32-bit numbers from the id."""
    digest = F.sha2(F.concat(F.lit(SALT), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]


def begins(data: np.ndarray, offs: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes begin a unit, and which a code point. A word begins with the blanks before it; blanks at the end of a text belong to its last word."""
    points = (data & 0xC0) != 0x80
    if unit == "code_point":
        return points, points
    space = SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offs[:-1]] = True
    ends = np.flatnonzero(~space & np.append(space[1:] | first[1:-1], True)) + 1  # a unit begins where a word ends, and at the text's begin
    units = first[:-1].copy()
    if len(data):
        text = np.searchsorted(offs, ends - 1, "right") - 1
        last = np.append(text[1:] != text[:-1], True) if len(text) else np.zeros(0, bool)
        units[ends[~last]] = True  # after a text's last word nothing begins
    return units, points


class Trees:
    """Fenwick trees of many texts side by side: node i of a text, from 1, covers the blocks (i - lowest bit of i, i]."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, units: np.ndarray, points: np.ndarray):
        self.data, self.offs, self.units, self.points = data, offs, units, points
        self.blocks = -(-np.diff(offs) // BLOCK)
        self.base = np.cumsum(self.blocks) - self.blocks
        total = int(self.blocks.sum())
        text = np.repeat(np.arange(len(offs) - 1), self.blocks)
        node = np.arange(total) - self.base[text] + 1
        start = offs[text] + (node - 1) * BLOCK
        self.tree = np.zeros((total, 2), np.int64)
        for column, flags in enumerate((units, points)):
            if total:
                count = np.add.reduceat(flags, start, dtype=np.int64)
                sums = np.concatenate([[0], np.cumsum(count)])  # over all texts; a node is the difference of two of them
                here = np.arange(1, total + 1)
                self.tree[:, column] = sums[here] - sums[here - (node & -node)]

    def totals(self, column: int) -> np.ndarray:
        """Units (0) or code points (1) of each text, over the nodes that its last block's number is made of."""
        out, at = np.zeros(len(self.blocks), np.int64), self.blocks.copy()
        while (live := np.flatnonzero(at)).size:
            out[live] += self.tree[self.base[live] + at[live] - 1, column]
            at[live] -= at[live] & -at[live]
        return out

    def cut(self, text: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte place (in the whole array) and code points before the cut after k units of each text; k is at most its units."""
        at, left, before = np.zeros(len(text), np.int64), k.astype(np.int64), np.zeros(len(text), np.int64)
        step = 1 << max(0, int(self.blocks.max(initial=0)).bit_length() - 1)
        while step:
            node = at + step
            live = np.flatnonzero(node <= self.blocks[text])
            values = self.tree[self.base[text[live]] + node[live] - 1]
            fits = values[:, 0] <= left[live]  # a boundary after the last unit of a block lies in a later block
            go = live[fits]
            at[go] += step
            left[go] -= values[fits, 0]
            before[go] += values[fits, 1]
            step >>= 1
        start = self.offs[text] + at * BLOCK
        end = np.minimum(start + BLOCK, self.offs[text + 1])
        place = end.copy()
        for i in range(0, len(text), 4096):  # the block of each boundary, byte by byte
            s = slice(i, i + 4096)
            index = start[s, None] + np.arange(BLOCK)
            inside = index < end[s, None]
            index = np.minimum(index, max(len(self.data) - 1, 0))
            if not len(self.data):
                continue
            hit = (self.units[index] & inside).cumsum(1) == left[s, None] + 1  # the unit after the cut begins here
            found = hit.any(1)
            offset = np.where(found, hit.argmax(1), (end - start)[s])
            place[s] = start[s] + offset
            before[s] += (self.points[index] & inside & (np.arange(BLOCK) < offset[:, None])).sum(1)
        return place, before


def transform(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", unit: str = "code_point") -> DataFrame:
    """All columns and fim_text, fim_form, fim_units, fim_prefix_chars, fim_middle_chars (code points; null if plain)."""
    if unit not in UNITS:
        raise ValueError(f"unit is one of {UNITS}")
    kept = [c for c in docs.columns if c.lower() not in COLUMNS]
    docs = docs.select(*map(quoted, kept), F.array(*draws(quoted(doc_id))).alias("fim_text"))
    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text):
                data, offs = text_bytes(part.column(text))
                units, points = begins(data, offs, unit)
                trees = Trees(data, offs, units, points)
                n = trees.totals(0)
                h = part.column("fim_text").flatten().to_numpy().reshape(-1, 4) if part.num_rows else np.zeros((0, 4), np.int64)
                raw = data.tobytes()
                marked = np.array([any(m in raw[a:z] for m in (b"<P>", b"<S>", b"<M>")) for a, z in zip(offs, offs[1:])], bool)
                plain = (n == 0) | marked | (h[:, 2] % 100 >= 100 - PLAIN_PERCENT)
                form = np.where(plain, 0, np.where(h[:, 3] % 100 < SPM_PERCENT, 2, 1))
                one, two = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
                cut = np.flatnonzero(~plain)
                first, chars_first = trees.cut(cut, np.minimum(one, two)[cut])
                second, chars_second = trees.cut(cut, np.maximum(one, two)[cut])
                out = [raw[a:z] for a, z in zip(offs, offs[1:])]
                for i, x, y in zip(cut, first, second):
                    a, z = offs[i], offs[i + 1]
                    if form[i] == 1:
                        out[i] = b"<P>" + raw[a:x] + b"<S>" + raw[y:z] + b"<M>" + raw[x:y]
                    else:
                        out[i] = b"<S>" + raw[y:z] + b"<P>" + raw[a:x] + b"<M>" + raw[x:y]
                chars = np.zeros((2, len(n)), np.int64)
                chars[0, cut], chars[1, cut] = chars_first, chars_second - chars_first
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in part.schema.names[:-1]), pa.array(out, pa.binary()).cast(pa.string()), pa.array([FORMS[f] for f in form], pa.string()),
                                                  pa.array(n), pa.array(chars[0], mask=plain), pa.array(chars[1], mask=plain)], names=[*part.schema.names[:-1], *COLUMNS])

    return docs.mapInArrow(run, f"{schema}, fim_text string, fim_form string, fim_units bigint, fim_prefix_chars bigint, fim_middle_chars bigint")


def restored(output: Column, form: Column) -> Column:
    """The text, from output and form."""
    def after(place, width: int = 0) -> Column:
        return F.substring(output, place + width, F.length(output))

    def between(first: str, second: str) -> Column:
        start = F.locate(first, output) + len(first)
        return F.substring(output, start, F.locate(second, output) - start)

    middle = after(F.locate(MIDDLE, output), len(MIDDLE))
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def restore(formed: DataFrame) -> DataFrame:
    """All columns and fim_restored, rebuilt from fim_text and fim_form."""
    return formed.withColumn("fim_restored", restored(F.col("fim_text"), F.col("fim_form")))
