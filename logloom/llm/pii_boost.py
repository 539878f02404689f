"""Personal data by candidate gradient boosting.

Base matchers find the plain forms (mail, address, card, phone). High-recall generators propose further spans, which overlap each other and the base ones: mails with spelled signs, addresses with guarded dots, and
all runs of digits with separators as card or phone. Boosted trees score each proposal by format and context; a kind's limit selects those that are added.

The trees learn from all documents. A base span is certain whatever its context, so it is told again in other forms in its own place: a mail spelled out, an address with guarded dots, a card with
separators that the base form does not know, a phone without its plus or country. These are the positives. Negatives are the same retellings with the certainty taken away (a number above 255, a check digit
that fails, a sentence between the parts of a mail, bare digits), and the proposals that the texts hold without being base spans. Proposals that
may be real by what they say (spelled mails, parts up to 255, right check digits, phone groups) are left out there. A third of the documents is kept for calibration: a kind's limit is the least score at which the lower confidence bound of the precision reaches `PRECISION`; without enough cases no
score does, and nothing is added. Proposals from the limit on that meet no base span are added. Base spans always stay.

Examples with the same features are one row with their number, so what is learned from grows with the kinds of format and context, not with the documents. Trees are grown from sums of whole numbers, which are
the same however the rows are dealt out: on the driver up to HELD rows, and beyond by one job a level over the written rows, so that no process holds them all.

Texts without a digit, an at sign, or the word `at` and a dot (plain or spelled) cannot hold a span and are not decoded.

Defined cases: null text counts as empty. Repeated rows are scanned each. Overlapping additions: the higher score stays, then the earlier. Without positives a kind adds nothing. Positions are code
points, ends exclusive. Extra columns stay.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.tables import hash_key, stored
from logloom.llm.words import chunks, text_bytes

KINDS = ("email", "ip", "card", "phone")
HELD = 50_000              # different examples from which trees are grown on the driver; more are left where they lie
SCALE = 1 << 20            # parts of one in which gradients are summed
PRECISION = 0.98           # lower bound of the precision above a limit
CONFIDENCE = 1.645         # of that bound, in standard deviations: 95 %
ROUNDS, DEPTH, RATE, BINS = 40, 3, 0.2, 24
CONTEXT = 24               # characters before a proposal that count as its context

_AT = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits is always matched from its first digit, so the look-behind only saves time.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SPELLED = re.compile(r"(?<![\w.+-])[\w.+-]{1,64}\s?(?:@|\(at\)|\[at\]|\bat\b)\s?[\w-]{1,64}(?:\s?(?:\.|\(dot\)|\[dot\]|\bdot\b)\s?[\w-]{1,64}){1,6}", re.I)
_AT_FORM = re.compile(r"\s?(?:@|\(at\)|\[at\]|\bat\b)\s?", re.I)
_SPELT = re.compile(r"[(\[]at[)\]]|\bdot\b", re.I)
_DOT_FORM = re.compile(r"\s?(?:\(dot\)|\[dot\]|\bdot\b)\s?", re.I)
_DOTTED = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\s?[\[({]?(?:\.|\bdot\b)[\])}]?\s?[0-9]{1,3}){3}(?![0-9])", re.I)
_DIGITS = re.compile(r"\+?\(?[0-9][0-9 ().+/_-]{5,30}[0-9]")
_LOCAL_PHONE = re.compile(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$")
_CUES = ("mail", "phone", "tel", "call", "fax", "mobile", "card", "visa", "pay", "account", "ip", "host", "addr", "server", "order", "id", "no.", "version")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join([c for c in s if "0" <= c <= "9"])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the plain forms, sorted; leftmost and non-overlapping within a kind."""
    out, free = [], 0
    for m in _AT.finditer(text):  # the part after the at sign decides; the part before it reaches back over its letters
        start = m.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            out.append((start, 0, m.end()))
            free = m.end()
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def proposals(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of everything that might be personal data."""
    out = [(m.start(), 0, m.end()) for m in _SPELLED.finditer(text)] + [(m.start(), 1, m.end()) for m in _DOTTED.finditer(text)]
    for m in _DIGITS.finditer(text):
        n = len(_digits(m[0]))
        if 12 <= n <= 19:
            out.append((m.start(), 2, m.end()))
        if 7 <= n <= 15:
            out.append((m.start(), 3, m.end()))
    return out


def retold(s: str, kind: int) -> list[tuple[str, bool]]:
    """Other forms of a base span, and forms that look like them but are none."""
    if kind == 0:
        name, host = s.split("@", 1)
        spelled = lambda at, dot: name + at + host.replace(".", dot)
        return [(spelled(at, dot), True) for at, dot in ((" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot "), (" (at) ", "."), ("[at]", "."))] + [(spelled(" at ", ". "), False)]
    if kind == 1:
        parts = [str(int(p)) for p in s.split(".")]
        wrong = [str(256 + int(parts[0])), *parts[1:]]
        return [(dot.join(p), p is parts) for dot in ("[.]", "(.)", " . ", " dot ") for p in (parts, wrong)]
    digits = _digits(s)
    if kind == 2:
        wrong = digits[:-1] + str((int(digits[-1]) + 1) % 10)
        fours = lambda d: [d[i:i + 4] for i in range(0, len(d), 4)]
        return [(sep.join(fours(d)), d is digits) for sep in (".", "/", "_") for d in (digits, wrong)]
    if len(digits) < 10:
        return [(s[1:], True)]
    a, b, c = digits[-10:-7], digits[-7:-4], digits[-4:]
    return [(s[1:], True), (f"({a}) {b}-{c}", True), (f"{a}-{b}-{c}", True), (f"{a}.{b}.{c}", True), (f"{a} {b} {c}", True), (a + b + c, False), (a + b + "/" + c, False)]


def _one_form(s: str, kind: int) -> str:
    """A proposal without what sets its kind's base form apart: one sign for every at and spelled dot, one for the separators of an address or card, no plus. Blanks beside a plain dot stay."""
    if kind == 0:
        return _DOT_FORM.sub(".", _AT_FORM.sub("@", s, count=1))
    return re.sub(r"[^0-9]+", " ", s).strip() if kind in (1, 2) else s.lstrip("+")


def features(text: str, span: tuple[int, int, int]) -> list[float]:
    """Format and context of a proposal."""
    start, kind, end = span
    s, before, after = text[start:end], text[max(0, start - CONTEXT):start].lower(), text[end:end + 8]
    core = s = _one_form(s, kind)
    d = _digits(s)
    groups = [len(g) for g in re.findall(r"[0-9]+", s)] or [0]
    row = [kind, len(core), len(d), len(groups), groups[0], groups[-1], max(groups), min(groups), sum(c.isspace() for c in s), s.count("."), s.count("-"), s.count("("), s.count("/"), s.count("@"),
           sum(c.isalpha() for c in s), float(kind == 2 and luhn(d)), float(kind == 1 and all(int(g) <= 255 for g in s.split())), float(all(g <= 3 for g in groups)), float(before[-1:].isalnum()), float(after[:1].isalnum()),
           float(before[-1:] in (":", "=", "#")), float(after[:1] in (".", "-", "/") and after[1:2].isdigit()), float(len(set(d)) <= 2)]
    return row + [float(cue in before) for cue in _CUES]


class Boosted:
    """Boosted trees for one yes-or-no question: quantile bins, depth-wise splits, logistic loss."""

    def __init__(self, edges: list[np.ndarray], start: float):
        self.edges, self.start, self.trees = edges, start, []

    def fit(self, total: Callable[[Boosted, list], np.ndarray]) -> Boosted:
        """Grows the trees; `total(self, tree)` adds up `sums` over all examples."""
        for _ in range(ROUNDS):
            tree = []
            for depth in range(DEPTH):
                size = 1 << depth
                gl, hl = total(self, tree).cumsum(3) / SCALE
                gt, ht = gl[:, :, -1:], hl[:, :, -1:]
                gain = gl ** 2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt ** 2 / (ht + 1)
                gain[:, :, -1] = 0
                best = gain.reshape(size, -1).argmax(1)
                feature, cut = best // BINS, best % BINS
                tree.append((feature, cut))
            at = np.arange(size)
            split = lambda left, all_: np.stack([left[at, feature, cut], all_[:, 0, 0] - left[at, feature, cut]], 1).ravel()
            self.trees.append((tree, RATE * split(gl, gt) / (split(hl, ht) + 1)))
        return self

    def sums(self, x: np.ndarray, hit: np.ndarray, n: np.ndarray, tree: list) -> np.ndarray:
        """First and second derivatives of the loss by node of a tree that is being grown, feature and bin, of examples that come n times, in whole SCALE-th parts."""
        b = self._bins(x)
        f, size, p = b.shape[1], 1 << len(tree), 1 / (1 + np.exp(-self._score(b)))
        cell = ((self._node(b, tree)[:, None] * f + np.arange(f)) * BINS + b).ravel()
        add = lambda v: np.bincount(cell, np.repeat(np.rint(n * v * SCALE), f), size * f * BINS)
        return np.stack([add(hit - p), add(p * (1 - p))]).reshape(2, size, f, BINS).astype(np.int64)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds."""
        return self._score(self._bins(x))

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T)], 1)

    def _score(self, b: np.ndarray) -> np.ndarray:
        score = np.full(len(b), self.start)
        for tree, leaf in self.trees:
            score += leaf[self._node(b, tree)]
        return score

    def _node(self, b: np.ndarray, tree: list) -> np.ndarray:
        node, rows = np.zeros(len(b), np.int64), np.arange(len(b))
        for feature, cut in tree:
            node = node * 2 + (b[rows, feature[node]] > cut[node])
        return node


def _may_hold(texts: pa.Array) -> np.ndarray:
    """Rows with a digit, an at sign, or the word `at` and a dot, plain or spelled."""
    data, offs = text_bytes(texts)
    hit = np.concatenate([[0], np.cumsum(((data >= 48) & (data <= 57)) | (data == 64))])
    dot = pc.or_(pc.match_substring(texts, "."), pc.match_substring(texts, "dot", ignore_case=True))
    spelled = pc.and_(dot, pc.match_substring_regex(texts, r"\bat\b", ignore_case=True))
    return (hit[offs[1:]] > hit[offs[:-1]]) | pc.fill_null(spelled, False).to_numpy(zero_copy_only=False)


def _doubtful(s: str, kind: int) -> bool:
    """Whether a proposal that is no base span may still be personal data by what it says."""
    if kind == 0:
        return "@" not in s and _SPELT.search(s) is not None
    if kind == 1:
        return all(int(g) <= 255 for g in re.findall("[0-9]+", s))
    return luhn(_digits(s)) if kind == 2 else _LOCAL_PHONE.search(s) is not None


def examples(text: str) -> Iterator[tuple[list[float], bool]]:
    """Features and truth of the proposals of a text and of its base spans told again."""
    base = base_spans(text)
    for span in proposals(text):
        if not _doubtful(text[span[0]:span[2]], span[1]) and not any(span[0] < e and s < span[2] for s, _, e in base):
            yield features(text, span), False
    for s, k, e in base:
        before, after = text[max(0, s - 80):s], text[e:e + 80]
        for form, hit in retold(text[s:e], k):
            own = (len(before), k, len(before) + len(form))
            told = before + form + after
            for span in proposals(told):
                if span == own:
                    yield features(told, span), hit
                elif own[0] <= span[0] and span[2] <= own[2] and span[1] != k:
                    yield features(told, span), False


def least_precision(hits, n):
    """Lower confidence bound of hits / n (Wilson), of numbers, arrays or columns."""
    z, p = CONFIDENCE ** 2, hits / n
    return (p + z / (2 * n) - CONFIDENCE * (p * (1 - p) / n + z / (4 * n * n)) ** 0.5) / (1 + z / n)


def counted_examples(docs: DataFrame, text: str = "text") -> DataFrame:
    """The different examples of all documents: features `x`, `hit`, `part` (whole documents are kept for calibration) and their number `n`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            may = batch.filter(pa.array(_may_hold(batch.column("text"))))
            found = Counter((tuple(map(int, x)), hit, part) for t, part in zip(may.column("text").to_pylist(), may.column("part").to_pylist()) for x, hit in examples(t))
            x, hit, part = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.int32())), pa.array(hit, pa.bool_()), pa.array(part, pa.bool_()), pa.array(found.values(), pa.int64())], names=["x", "hit", "part", "n"])

    told = docs.select(F.col(text).alias("text")).withColumn("part", hash_key("text", seed=4) % 3 == 0).mapInArrow(run, "x array<int>, hit boolean, part boolean, n bigint")
    return told.groupBy("x", "hit", "part").agg(F.sum("n").alias("n"))


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.stack(batch.column("x").to_numpy(zero_copy_only=False)).astype(float), batch.column("hit").to_numpy(zero_copy_only=False).astype(float), batch.column("n").to_numpy(zero_copy_only=False)


def quantile_edges(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Inner bounds of BINS - 1 parts of as many values, linear between values, of ascending values that come n times."""
    upto = np.cumsum(n)
    place = np.linspace(0, 1, BINS)[1:-1] * (upto[-1] - 1)
    low = np.floor(place).astype(np.int64)
    a, b = (values[np.searchsorted(upto, np.minimum(i, upto[-1] - 1), "right")] for i in (low, low + 1))
    return np.unique(a + (b - a) * (place - low))


def train(docs: DataFrame, text: str = "text"):
    """Trees, and the least score by kind, from all documents; None where nothing can be learned or calibrated."""
    found = stored(counted_examples(docs, text), "pii-examples")
    learned = found.filter("not part")
    count = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    n, hits, kept, kept_hits, rows = found.agg(count(~F.col("part")), count(~F.col("part") & F.col("hit")), count(F.col("part")), count(F.col("part") & F.col("hit")), F.count_if(~F.col("part"))).first()
    if not n or not kept or not hits + kept_hits:
        return None
    width = len(features("", (0, 0, 0)))
    values = learned.select("n", F.posexplode("x").alias("feature", "value")).groupBy("feature", "value").agg(F.sum("n").alias("n")).orderBy("feature", "value").toPandas()  # a feature has few hundred values
    by = [values[values["feature"] == i] for i in range(width)]
    model = Boosted([quantile_edges(v["value"].to_numpy(float), v["n"].to_numpy()) for v in by], float(np.log((hits + 1) / (n - hits + 1))))

    def total(model: Boosted, tree: list) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = sum(model.sums(*_arrays(batch), tree) for batch in batches if batch.num_rows)
            if not isinstance(own, int):
                yield pa.RecordBatch.from_arrays([pa.array([own.ravel()], pa.list_(pa.int64()))], names=["sums"])
        return np.sum([r["sums"] for r in learned.mapInArrow(run, "sums array<bigint>").collect()], 0).reshape(2, 1 << len(tree), width, BINS)  # one row a task

    if rows <= HELD:
        held = _arrays(learned.toArrow().combine_chunks().to_batches()[0])
        model.fit(lambda model, tree: model.sums(*held, tree))
    else:
        model.fit(total)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, hit, n = _arrays(batch)
                yield pa.RecordBatch.from_arrays([pa.array(x[:, 0].astype(np.int32)), pa.array(model.score(x)), pa.array((hit * n).astype(np.int64)), pa.array(n)], names=["kind", "score", "hits", "n"])

    scores = found.filter("part").mapInArrow(scored, "kind int, score double, hits bigint, n bigint").groupBy("kind", "score").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n"))  # of equal scores all are taken or none
    down = Window.partitionBy("kind").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    precise = scores.select("kind", "score", least_precision(F.sum("hits").over(down), F.sum("n").over(down)).alias("precise")).filter(F.col("precise") >= PRECISION)
    limits = {r["kind"]: r["score"] for r in precise.groupBy("kind").agg(F.min("score").alias("score")).collect()}
    return model, {k: limits.get(k, np.inf) for k in range(len(KINDS))}


def find(docs: DataFrame, model, text: str = "text") -> DataFrame:
    """All columns and pii_spans, sorted: start, kind (place in KINDS), stop, base, score (1 for base spans)."""
    docs = docs.drop("pii_spans")  # an input column of this name is replaced
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32()), ("base", pa.bool_()), ("score", pa.float64())])

    def spans(texts: list[str]) -> list[list[tuple]]:
        found = [[(s, k, e, True, 1.0) for s, k, e in base_spans(t)] for t in texts]
        if shared.value is None:
            return found
        trees, limits = shared.value
        asked = [(i, span) for i, t in enumerate(texts) for span in proposals(t) if not any(span[0] < b[2] and b[0] < span[2] for b in found[i])]
        if asked:
            odds = trees.score(np.array([features(texts[i], span) for i, span in asked]))
            for p, odd, (i, (s, k, e)) in sorted(zip(1 / (1 + np.exp(-odds)), odds, asked), key=lambda z: (-z[0], z[2])):
                if odd >= limits[k] and not any(s < b[2] and b[0] < e for b in found[i]):
                    found[i].append((s, k, e, False, float(p)))
        return [sorted(f) for f in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text):
                may = _may_hold(part.column(text))
                got = iter(spans(part.column(text).filter(pa.array(may)).to_pylist()))
                rows = [[dict(zip(("start", "kind", "stop", "base", "score"), s)) for s in next(got)] if m else [] for m in may]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rows, pa.list_(kind))], names=[*part.schema.names, "pii_spans"])

    kinds = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{kinds}, pii_spans array<struct<start:int,kind:int,stop:int,base:boolean,score:double>>")


def redact(docs: DataFrame, model, text: str = "text") -> DataFrame:
    """The columns of `docs` with `[KIND]` in place of every span; of overlapping spans the first one's kind counts."""
    col = F.col(text)

    def step(acc, s):
        mark = F.concat(F.lit("["), F.upper(F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)), F.lit("]"))
        fresh = F.concat(acc["out"], F.substring(col, acc["at"] + 1, s["start"] - acc["at"]), mark)
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.when(s["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate("pii_spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substring(col, a["at"] + 1, F.length(col))))
    return find(docs, model, text).withColumn(text, F.when(F.size("pii_spans") > 0, clean).otherwise(col)).drop("pii_spans")


def joined(spans):
    """kind:start:stop of each span, comma-joined."""
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["stop"].cast("string"))), ",")
