"""Fill-in-middle, periodic runs and repeated passages against brute force, on odd rows and through the queries."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logloom.llm import fim_fenwick, periodic_runs, queries, suffix_dedup
from logloom.llm.words import Words, text_bytes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def odd_texts():
    rng = random.Random(17)
    word = lambda k: f"w{rng.randrange(k)}"
    passage = " ".join(word(10**6) for _ in range(60))
    texts = ["", None, " \n ", "a", "é" * 900, "x" * 5000, "ab" * 700, "<P> held", "one two " * 40, " lead", passage, passage, passage + " tail " + word(99), "head " + passage,
             "日本語 🎉 " * 120, " ".join(word(3) for _ in range(300)), " ".join(word(10**6) for _ in range(20000))]
    texts += [" ".join(word(10**6) for _ in range(rng.randrange(10, 200))) + " " + passage[rng.randrange(90):][:rng.randrange(150, 300)] for _ in range(60)]
    base = texts[-1] * 3
    for _ in range(30):  # near copies
        t = list(base)
        for _ in range(rng.randrange(4)):
            t[rng.randrange(len(t))] = rng.choice("ABC")
        texts.append("".join(t))
    return [(None if i == 3 else i, t) for i, t in enumerate(texts)] + [(7, "<P> held"), (10, passage), (10, passage)]


ROWS = odd_texts()


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A folder with a documents table of odd rows."""
    path = tmp_path_factory.mktemp("odd")
    spark.createDataFrame([(*r, "x", "k", "k", "k") for r in ROWS], "doc_id bigint, text string, dup_key string, run_key string, fim_text string, salt string").repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


def by_row(rows, *fields):
    return Counter((r["doc_id"], *(r[f] for f in fields)) for r in rows)


def brute_cut(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, len(text), "plain", None, None, sha(text), sha(text)
    p, m, s = text[:a], text[a:b], text[b:]
    spm = h4 % 100 < 20
    return doc_id, len(text), "spm" if spm else "psm", a, b - a, sha(f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"), sha(text)


def test_fim_query(spark, odd, sf):
    fields = ("n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
    assert by_row(queries.op11_fim_fenwick(spark, odd).collect(), *fields) == Counter(brute_cut(*r) for r in ROWS)
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = by_row(queries.op11_fim_fenwick(spark, sf).collect(), *fields)
    assert got == Counter(brute_cut(*r) for r in rows) and {k[2] for k in got} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("unit", fim_fenwick.UNITS)
def test_fenwick_cuts(unit):
    rng = random.Random(1)
    texts = ["", None, "a", "é" * 2000, " lead and trail  ", "   ", "x" * 512, "x" * 1024] + ["".join(rng.choice("ab é中🎉\n ") for _ in range(rng.randrange(1500))) for _ in range(40)]
    data, offs = text_bytes(pa.array(texts))
    trees = fim_fenwick.Trees(data, offs, *fim_fenwick.begins(data, offs, unit))
    n, chars = trees.totals(0), trees.totals(1)
    for i, t in enumerate(texts):
        t = t or ""
        units = list(t) if unit == "code_point" else re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+(?:[\x20\x09-\x0D]+\Z)?", t) or ([t] if t else [])
        assert "".join(units) == t and n[i] == len(units) and chars[i] == len(t)
        for k in {0, len(units), len(units) // 2, rng.randrange(len(units) + 1)}:
            place, before = trees.cut(np.array([i]), np.array([k]))
            want = "".join(units[:k])
            assert before[0] == len(want) and data[offs[i]:place[0]].tobytes() == want.encode()


def test_fim_by_words(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    made = fim_fenwick.restore(fim_fenwick.transform(docs, unit="word")).collect()
    assert all(r["fim_restored"] == (r["text"] or "") for r in made) and len(made) == len(ROWS) and any(r["fim_form"] != "plain" for r in made)
    assert all(r["fim_units"] == max(bool(r["text"]), len(WORD.findall(r["text"] or ""))) and r["salt"] == "k" for r in made)
    assert fim_fenwick.transform(docs.filter("doc_id = -1")).count() == 0
    with pytest.raises(ValueError):
        fim_fenwick.transform(docs, unit="line")


def brute_runs(w):
    ids = {}
    x, out = np.array([ids.setdefault(t, len(ids)) for t in w]), {}
    for q in range(1, len(w) // 2 + 1):
        step = np.diff(np.concatenate([[0], (x[:-q] == x[q:]).astype(int), [0]]))
        for a, z in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1)):
            if z - a + q >= max(12, 2 * q):
                out.setdefault((int(a), int(z - a + q)), q)
    return sorted((a, q, n) for (a, n), q in out.items())


def brute_collapse(doc_id, text):
    w = WORD.findall(text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs, gone = brute_runs(w), set()
    for a, q, length in runs:
        gone.update(range(a + q, a + length))
    best = min(((-length, a, q) for a, q, length in runs), default=None)
    first = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return doc_id, len(runs), *first, sha("".join(f"{a},{length},{q}\n" for a, q, length in runs)), sha(" ".join(t for i, t in enumerate(w) if i not in gone))


def test_runs_query(spark, odd, sf):
    fields = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert by_row(queries.op12_periodic_runs(spark, odd).collect(), *fields) == Counter(brute_collapse(*r) for r in ROWS)
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = by_row(queries.op12_periodic_runs(spark, sf).collect(), *fields)
    assert got == Counter(brute_collapse(*r) for r in rows) and any(k[1] for k in got)


def stitched(w):
    """Runs by the operator's tiles, stitched in plain Python."""
    hashes = Words(pa.array([" ".join(w)])).hash
    tiles = [dict(run_key=1, low=lo, high=hi, own=x, own_end=e, first=a, words_total=len(w), words=hashes[a:z].tobytes()) for lo, hi, x, e, a, z in periodic_runs.tiles_of(len(w))]
    held, out = {}, {}
    for q, a, z in sorted(zip(*(x.tolist() for x in periodic_runs.solve(tiles)[1:]))) if tiles else ():
        own = held.setdefault(q, [])
        if own and a <= own[-1][1]:
            own[-1][1] = max(own[-1][1], z)
        else:
            own.append([a, z])
    for q in sorted(held):
        for a, z in held[q]:
            if z - a + q >= max(12, 2 * q):
                out.setdefault((a, z - a + q), q)
    return sorted((a, q, n) for (a, n), q in out.items())


@pytest.mark.parametrize("tile", [64, 4096])
@pytest.mark.parametrize("few", [2, 64])
def test_tiles_find_all_runs(monkeypatch, tile, few):
    monkeypatch.setattr(periodic_runs, "TILE", tile)
    monkeypatch.setattr(periodic_runs, "SHARED", tile.bit_length() - 4)
    monkeypatch.setattr(periodic_runs, "FEW", few)
    rng = random.Random(tile + few)
    a, b, tm = ["a"], ["a", "b"], ["a"]
    for _ in range(11):
        a, b = b, b + a
    for _ in range(9):
        tm += ["b" if x == "a" else "a" for x in tm]
    made = [b[:700], tm, ["x"] * 600]
    for _ in range(150):
        n = rng.randrange(400)
        w = [str(rng.randrange(rng.choice([1, 2, 2, 3, 50]))) for _ in range(n)]
        at = rng.randrange(n + 1)
        q = 1 + rng.randrange(max(1, (n - at) // 3))
        for i in range(at + q, n):
            w[i] = w[i - q]
        made.append(w)
    for w in made:
        assert stitched(w) == brute_runs(w)


def test_long_texts_are_dealt_out(spark, monkeypatch):
    """One text in several tasks gives the same runs, with their words cut out and the other columns kept."""
    rng = random.Random(5)
    w = [f"w{rng.randrange(50)}" for _ in range(1000)]
    w += w * 4 + [f"u{rng.randrange(10**6)}" for _ in range(9000)] + ["same"] * 40
    docs = spark.createDataFrame([(1, " ".join(w), "k"), (2, None, "k")], "doc_id bigint, text string, run_key string")
    plain = periodic_runs.find(docs).orderBy("doc_id").collect()
    monkeypatch.setattr(periodic_runs, "LONG_CHARS", 1000)
    assert periodic_runs.find(docs).orderBy("doc_id").collect() == plain
    assert [(s["start"], s["period"], s["length"]) for s in plain[0]["run_spans"]] == brute_runs(w) and plain[1]["run_spans"] == [] and plain[0]["run_key"] == "k"
    made = {r["doc_id"]: r for r in periodic_runs.collapse(docs).collect()}
    assert len(made[1]["text"].split()) == 1000 + 9000 + 1 and made[2]["text"] == "" and made[2]["run_words"] == 0
    assert periodic_runs.collapse(docs.filter("doc_id = 9")).count() == 0


def brute_repeats(rows, size=200):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i:i + size] for b in raw for i in range(len(b) - size + 1))
    for (doc_id, _), b in zip(rows, raw):
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if seen[b[i:i + size]] > 1:
                gone[i:i + size] = b"\1" * size
        yield doc_id, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()


@pytest.mark.parametrize("task_rows", [suffix_dedup.TASK_ROWS, 12])
def test_repeats_query(spark, odd, monkeypatch, task_rows):
    """With a dozen rows a range, most groups lie on a border."""
    monkeypatch.setattr(suffix_dedup, "TASK_ROWS", task_rows)
    fields = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert by_row(queries.op13_suffix_dedup(spark, odd).collect(), *fields) == Counter(brute_repeats(ROWS))


def test_repeats_of_the_smallest_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = by_row(queries.op13_suffix_dedup(spark, sf).collect(), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == Counter(brute_repeats(rows)) and any(k[2] for k in got)


def test_repeats_operator(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    made = suffix_dedup.dedup(docs)
    assert made.columns == [*docs.columns, *suffix_dedup.COLUMNS] and made.filter("salt = 'k' and dup_key = 'x'").count() == len(ROWS)
    for r in made.collect():
        raw = (r["text"] or "").encode()
        gone = sum(s["stop"] - s["start"] for s in r["dup_spans"])
        assert r["dup_removed"] == gone and len(r["dup_kept"]) == len(raw) - gone
    assert suffix_dedup.dedup(docs.filter("doc_id = -1")).count() == 0
    assert suffix_dedup.dedup(docs.withColumn("text", F.lit(None).cast("string"))).filter("dup_removed > 0").count() == 0


def test_anchors_partition_the_strings(monkeypatch):
    """Every string has one anchor, whatever the segments; equal strings have it in the same place."""
    rng = random.Random(3)
    text = "".join(rng.choice("ab") for _ in range(3000)) + "a" * 900 + "abc" * 300
    data, offs = text_bytes(pa.array([text, "", text[100:900]]))
    for segment in (1 << 20, 700):
        monkeypatch.setattr(suffix_dedup, "SEGMENT", segment)
        owner = {}
        for part in suffix_dedup.anchored(data, offs):
            for doc, at, count, anchor, *_ in zip(*part):
                for i in range(at, at + count):
                    assert (doc, i) not in owner and 0 <= at + anchor - i <= 200 - 32
                    owner[doc, i] = at + anchor - i
        assert set(owner) == {(0, i) for i in range(len(text) - 199)} | {(2, i) for i in range(601)}
        assert all(owner[2, i] == owner[0, i + 100] for i in range(601))
