"""N-gram Jaccard join by chosen paths.

A document is the set of its five-word shingles. Every distinct set gets a signature of minimum hashes; equal coordinates of two signatures are sampled shared tokens, about as many
of them as the sets are similar. A run starts with all sets in one node. A node draws one or two coordinates, 1 / similarity on average, and a set goes to the child of each coordinate's value, so two
sets at the threshold meet in one child on average. Nodes are split until they are small; small nodes are compared by brute force. Runs are repeated until a pair at
the threshold meets with the target recall. A node that is still large at the last level is cut into blocks and each pair of blocks is a small node of its own, so no group
is gathered in one task and no pair is left out.

Comparing has two steps, both inside tasks: signatures first, with a margin of five standard deviations; sets that have a likely partner then meet with their whole shingle sets and are compared exactly.
A pair is counted in the first node the two share, so links are counted once and never listed pair by pair. A node hands on each set's number of links and the root
of its part; components of those links are the classes.

Sets are identified by 64 bits of a hash. Equal sets are one set with a number of copies, whatever their number.

Defined cases: fewer than five words are one shingle of all words. A text without words (null, empty) links to nothing and is its own class. Repeated rows are copies. Ties do not arise: links are exact. A null id
takes part; class ids are the least id of a class, null only if it has none. An empty table gives no rows. Extra columns stay in `one_of_each`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.tables import hash_key, set_aside, stored
from logloom.llm.words import Words, chunks, mix

SHINGLE = 5
SIMILARITY = 0.8
COORDINATES = 64
LIKELY = 0.55        # share of equal coordinates a pair needs to be compared exactly
NODE = 128           # sets of a small node
LEVELS = 6
RECALL = 0.999
MORE = 1 / SIMILARITY - 1   # chance of a second coordinate
COLUMNS = 1 << 16    # tokens compared at a time
FEW_PAIRS = 32       # pairs of a cell that are looked at one by one
_RNG = np.random.default_rng(88)
_MUL = _RNG.integers(0, 2**31, COORDINATES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _RNG.integers(0, 2**32, COORDINATES, dtype=np.uint32)


def runs_needed(similarity: float = SIMILARITY, levels: int = LEVELS, recall: float = RECALL) -> int:
    """Runs after which a pair has met in a node of the last level with probability `recall`."""
    lost = 0.0
    for _ in range(levels):
        apart = 1 - similarity * (1 - lost)
        lost = (1 - MORE) * apart + MORE * apart * apart
    return math.ceil(math.log(1 - recall) / math.log(lost))


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each, and how many each text has."""
    w = Words(texts)
    gram, first = w.grams(SHINGLE)
    hashes, docs = [gram], [w.doc[first]]
    for k in range(1, SHINGLE):  # short texts: one shingle of all words
        short, at = w.grams(k)
        only = w.count[w.doc[at]] == k
        hashes.append(mix(short[only] + np.uint64(k)))
        docs.append(w.doc[at][only])
    h, d = np.concatenate(hashes), np.concatenate(docs)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[new], np.bincount(d[new], minlength=w.rows)


def signatures(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Set ids and minimum hashes of the texts that have shingles."""
    some = counts[counts > 0]
    at = np.cumsum(some) - some
    ids = np.add.reduceat(mix(hashes), at).view(np.int64) if len(some) else np.zeros(0, np.int64)
    token = (hashes >> np.uint64(32)).astype(np.uint32)
    sig = np.empty((len(some), COORDINATES), np.int32)
    if len(some):
        for c in range(COORDINATES):
            sig[:, c] = np.minimum.reduceat(token * _MUL[c] + _ADD[c], at).view(np.int32)
    return ids, sig


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, set_id and signature (null without words) of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                hashes, counts = shingle_sets(part.column("text"))
                ids, sig = signatures(hashes, counts)
                place = np.where(counts > 0, np.cumsum(counts > 0) - 1, 0)
                none = counts == 0
                if len(ids):
                    set_id = pa.array(ids[place], mask=none)
                    lists = pa.FixedSizeListArray.from_arrays(pa.array(sig[place].reshape(-1)), COORDINATES).cast(pa.list_(pa.int32()))
                else:
                    set_id, lists = pa.nulls(len(none), pa.int64()), pa.nulls(len(none), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row_key"), set_id, lists], names=["doc_id", "row_key", "set_id", "signature"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", row_key().alias("row_key")).mapInArrow(run, f"doc_id {kind}, row_key bigint, set_id bigint, signature array<int>")


def row_key():
    return hash_key("doc_id", "text", seed=31)


def _draws(node, run=None):
    """Coordinates a node draws, as an array of one or two."""
    pick = lambda k: F.pmod(F.xxhash64(node, F.lit(k)), F.lit(COORDINATES)).cast("int")
    second = F.pmod(F.xxhash64(node, F.lit(0)), F.lit(1 << 20)) < int(MORE * (1 << 20))
    return F.when(second, F.array(pick(1), pick(2))).otherwise(F.array(pick(1)))


def leaves(sets: DataFrame) -> DataFrame:
    """node, set_id, n: the small nodes, and the large ones of the last level. `sets` has set_id, signature."""
    roots = F.explode(F.array(*(F.lit(-1 - r).cast("bigint") for r in range(runs_needed()))))
    front = sets.select("set_id", "signature", roots.alias("parent"))
    out = None
    for level in range(LEVELS):
        coordinate = F.explode(F.array_distinct(_draws(F.col("parent"))))
        child = front.select("set_id", "signature", "parent", coordinate.alias("c")).select("set_id", F.xxhash64("parent", "c", F.col("signature")[F.col("c")]).alias("node"))
        sized = child.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("node")))  # a node's rows pass one task; the window keeps them on disk where they are many
        child = stored(sized.filter("n > 1"), f"path-nodes-{level}")
        small = child if level == LEVELS - 1 else child.filter(f"n <= {NODE}")
        out = small if out is None else out.unionByName(small)
        large = child.filter(f"n > {NODE}").select("set_id", F.col("node").alias("parent"))
        if level == LEVELS - 1 or large.isEmpty():
            break
        front = large.join(sets.select("set_id", "signature"), "set_id")
    return out


def _blocked(rows: DataFrame) -> DataFrame:
    """`cell` and `side`: a small node is one cell; a large one has a cell for each pair of its blocks."""
    blocks = F.ceil(F.col("n") / NODE).cast("int")
    block = F.pmod(F.xxhash64("set_id", "node"), blocks).cast("int")
    rows = rows.withColumns({"blocks": blocks, "side": F.when(F.col("n") <= NODE, 0).otherwise(block)})
    rows = rows.withColumn("other", F.explode(F.expr("if(blocks <= 1, array(0), sequence(0, blocks - 1))")))
    return rows.withColumn("cell", F.xxhash64("node", F.least("side", "other"), F.greatest("side", "other"))).withColumn("alone", F.col("side") == F.col("other")).drop("blocks", "other")


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole cells of a partition sorted by cell, many at a time."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        for a in range(0, batch.num_rows, 2000):
            part = batch.slice(a, 2000)
            cell = part.column("cell").to_numpy()
            change = np.flatnonzero(cell[1:] != cell[:-1])
            if kept and kept[-1].column("cell")[-1].as_py() != cell[0]:
                yield pa.Table.from_batches(kept)
                kept = []
            if len(change):
                cut = int(change[-1]) + 1
                yield pa.Table.from_batches([*kept, part.slice(0, cut)])
                kept, part = [], part.slice(cut)
            kept.append(part)
    if kept:
        yield pa.Table.from_batches(kept)


def _matrix(column: pa.ChunkedArray, width: int | None = None, fill: int = 0) -> np.ndarray:
    arr = column.combine_chunks()
    flat, offs = arr.flatten().to_numpy(), np.concatenate([[0], np.cumsum(arr.value_lengths().to_numpy())])
    if width:
        return flat.reshape(-1, width)
    n = np.diff(offs)
    out = np.full((len(n), max(1, n.max())), fill, flat.dtype)
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(offs[:-1], n)] = flat
    return out


def likely_pairs(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of a cell that are likely similar and have no earlier node in common."""
    cell, side, alone = (table.column(c).to_numpy() for c in ("cell", "side", "alone"))
    node, ids = table.column("node").to_numpy(), table.column("set_id").to_numpy()
    sig, nodes = _matrix(table.column("signature"), COORDINATES), _matrix(table.column("nodes"), fill=np.iinfo(np.int64).max)
    left, right = [], []
    for step in range(1, len(cell)):
        a = np.flatnonzero(cell[:-step] == cell[step:])
        if not len(a):
            break
        b = a + step
        ok = (alone[a] | (side[a] != side[b])) & (ids[a] != ids[b])
        a, b = a[ok], b[ok]
        near = (sig[a] == sig[b]).sum(1) >= LIKELY * COORDINATES
        left.append(a[near])
        right.append(b[near])
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
    order = np.argsort(a, kind="stable")  # rows of a cell are neighbours, so pairs of a cell are too
    a, b = a[order], b[order]
    earlier = np.zeros(len(a), bool)
    first = np.flatnonzero(np.r_[True, cell[a[1:]] != cell[a[:-1]]]) if len(a) else a
    for p, q in zip(first, [*first[1:], len(a)]):
        x, y = a[p:q], b[p:q]
        if q - p < FEW_PAIRS:
            earlier[p:q] = ((nodes[x][:, :, None] == nodes[y][:, None, :]) & (nodes[x] < node[x][:, None])[:, :, None]).any((1, 2))
        else:
            earlier[p:q] = _share(nodes[x[0]:y.max() + 1], node[x[0]])[x - x[0], y - x[0]]
    return a[~earlier], b[~earlier]


def _share(nodes: np.ndarray, node: int) -> np.ndarray:
    """Whether two rows of a cell have a node below `node` in common, for all of them, by an incidence matrix of those nodes."""
    row, at = np.nonzero(nodes < node)
    name, column, count = np.unique(nodes[row, at], return_inverse=True, return_counts=True)
    twice = count > 1
    column, wanted = (np.cumsum(twice) - 1)[column], twice[column]
    hit = np.zeros((len(nodes), int(twice.sum())), np.float32)
    hit[row[wanted], column[wanted]] = 1
    return hit @ hit.T > 0


def _mark_likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in _cells(batches):
        a, b = likely_pairs(table)
        rows = np.unique(np.concatenate([a, b]))
        if len(rows):
            yield from table.take(pa.array(rows)).combine_chunks().to_batches()


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by incidence matrices of bounded width."""
    n = len(sets)
    token, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    out = np.zeros((n, n), np.int64)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for start in range(0, len(token), COLUMNS):
        a, b = np.searchsorted(column, [start, start + COLUMNS])
        hit = np.zeros((n, min(COLUMNS, len(token) - start)), np.float32)
        hit[row[a:b], column[a:b] - start] = 1
        out += (hit @ hit.T).astype(np.int64)
    return out


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per set and cell: links (copies counted) and the root of its part in the cell."""
    for table in _cells(batches):
        a, b = likely_pairs(table)
        if not len(a):
            continue
        cell, ids, copies = (table.column(c).to_numpy() for c in ("cell", "set_id", "copies"))
        shingles = table.column("shingles").combine_chunks()
        out_id, out_links, out_root = [], [], []
        order = np.argsort(cell[a], kind="stable")
        a, b = a[order], b[order]
        for pa_, pb in zip(np.split(a, np.flatnonzero(np.diff(cell[a])) + 1), np.split(b, np.flatnonzero(np.diff(cell[a])) + 1)):
            rows = np.unique(np.concatenate([pa_, pb]))
            sets = [np.frombuffer(shingles[int(r)].as_py(), np.uint64) for r in rows]
            both = _intersections(sets)
            i, j = np.searchsorted(rows, pa_), np.searchsorted(rows, pb)
            size = both.diagonal()
            linked = both[i, j] >= SIMILARITY * (size[i] + size[j] - both[i, j]) - 1e-9
            i, j = i[linked], j[linked]
            if not len(i):
                continue
            weight = copies[rows]
            links = np.bincount(i, weight[j], len(rows)) + np.bincount(j, weight[i], len(rows))
            root = ids[rows].copy()
            while True:  # least id of each part
                before = root.copy()
                np.minimum.at(root, i, before[j])
                np.minimum.at(root, j, before[i])
                if (root == before).all():
                    break
            some = np.unique(np.concatenate([i, j]))
            out_id.append(ids[rows][some])
            out_links.append(links[some].astype(np.int64))
            out_root.append(root[some])
        if out_id:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_id, out_links, out_root)], names=["set_id", "links", "root"])


def components(edges: DataFrame) -> DataFrame:
    """set_id, root: the least id of each connected part, by alternating large and small stars. `edges` has a, b."""
    e = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "stars")
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        e = stored(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "stars")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return e.select(F.col("a").alias("set_id"), F.col("b").alias("root"))
        seen = now


def _with_shingles(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """set_id, shingles (sorted 64-bit hashes as bytes) of the wanted sets (set_id, row_key), from one document of each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                hashes, counts = shingle_sets(part.column("text"))
                cut = np.cumsum(counts)
                raw = [hashes[z - n:z].tobytes() for n, z in zip(counts, cut)]
                yield pa.RecordBatch.from_arrays([part.column("set_id"), pa.array(raw, pa.binary())], names=["set_id", "shingles"])

    rows = docs.select("text", row_key().alias("row_key")).join(wanted, "row_key").select("set_id", "text").dropDuplicates(["set_id"])
    return rows.mapInArrow(run, "set_id bigint, shingles binary")


def join(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, row_key, set_id) and sets (set_id, copies, n_links, class_doc, class_row, root): links count documents; class_doc and class_row name its first document."""
    signs = stored(signed(docs), "path-signed")
    members = signs.select("doc_id", "row_key", "set_id")
    sets = signs.filter("set_id is not null").groupBy("set_id").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "row_key")).alias("first"),
                                                                    F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "row_key"))).alias("named"), F.first("signature").alias("signature"))
    sets = stored(sets.select("set_id", "copies", F.coalesce("named", "first").alias("first"), "signature"), "path-sets")
    leaf = stored(leaves(sets.select("set_id", "signature")), "path-leaves")
    nodes = leaf.groupBy("set_id").agg(F.array_sort(F.collect_set("node")).alias("nodes"))  # a few dozen at most: runs times branches
    rows = _blocked(leaf.distinct().join(nodes, "set_id").join(sets.select("set_id", "signature", "copies"), "set_id"))
    ready = rows.select("cell", "side", "alone", "node", "set_id", "copies", "nodes", "signature").repartition("cell").sortWithinPartitions("cell")
    likely = stored(ready.mapInArrow(_mark_likely, ready.schema), "path-likely")
    wanted = likely.select("set_id").distinct().join(sets.select("set_id", F.col("first.row_key").alias("row_key")), "set_id")
    whole = likely.join(_with_shingles(docs, wanted), "set_id").repartition("cell").sortWithinPartitions("cell")
    found = stored(whole.mapInArrow(_links, "set_id bigint, links bigint, root bigint"), "path-links")
    links = found.groupBy("set_id").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("set_id").alias("a"), F.col("root").alias("b")))
    full = sets.drop("signature").join(links, "set_id", "left").join(roots, "set_id", "left")
    full = stored(full.select("set_id", "copies", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "set_id").alias("root")), "path-linked")
    best = full.groupBy("root").agg(F.coalesce(F.min(F.when(F.col("first.doc_id").isNotNull(), F.col("first"))), F.min("first")).alias("best"))
    return members, stored(full.join(best, "root").select("set_id", "copies", "n_links", "root", F.col("best.doc_id").alias("class_doc"), F.col("best.row_key").alias("class_row")), "path-classes")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links (other documents of similarity 0.8 or more), n_copies (documents of the same set), one row per document."""
    members, sets = join(docs)
    return members.join(sets, "set_id", "left").select("doc_id", F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("class_doc")).alias("class_id"),
                                                        F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("copies", F.lit(1)).alias("n_copies"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The columns of `docs`: one document of each class (the least id), and every text without words."""
    members, sets = join(docs)
    keep = sets.select(F.col("class_row").alias("keep_key")).distinct().unionByName(members.filter("set_id is null").select(F.col("row_key").alias("keep_key")).distinct())
    safe, restored = set_aside(docs, "keep_")
    rows = safe.withColumn("keep_row_key", row_key())
    return restored(rows.join(keep, rows["keep_row_key"] == keep["keep_key"]).dropDuplicates(["keep_row_key"]))
