"""Language identification by segmentation-marginalised unigrams.

A language is a probability for each piece of a fixed public vocabulary. The probability of a word is the sum over all its segmentations into pieces, by the forward algorithm;
a text's score is the sum over its words. Piece probabilities come from expected counts (forward-backward) over the distinct words of each language in the training texts,
starting from the counts of all pieces found in the words.

Words are runs of letters, lower case, with a word-begin mark; runs are cut every 40 letters, so any text is scored whole. A letter without a piece is a piece of its own with the
floor probability. Training uses a bounded sample of labelled documents, chosen by hash: about `sample` per language.

Defined cases: null text, or text without a letter, is `und` with score 0. Languages that are null are not learned. Without any labelled text everything is `und`. Ties go to the first
language in code point order. Repeated rows are scored each. Extra columns stay.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.bpe_rounds import tokenizer_path
from logloom.llm.tables import hash_key, stored
from logloom.llm.words import mix

VOCABULARY = "piece_bpe_32k.model"
SAMPLE = 3000        # labelled training documents per language
ROUNDS = 2           # re-estimations
LONGEST = 40         # letters of a word; longer runs are cut
FLOOR = 1e-9         # probability of a letter or piece never met
CACHE_WORDS = 300_000
STRETCH = 2.0 ** 15  # factor for each letter in the forward and backward sums: 40 letters at the floor stay above, 40 at certainty below what a double holds
SCALE = 1e6          # expected counts are summed as integers, so their order does not matter
_LETTERS = regex.compile(r"\p{L}+")
_LATIN = regex.compile(r"[a-zß-öø-ÿ]+")


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case, each at most LONGEST letters."""
    low = text.lower()
    try:
        low.encode("latin-1")
        found = (_LATIN if not ("ª" in low or "µ" in low or "º" in low) else _LETTERS).findall(low)
    except UnicodeEncodeError:
        found = _LETTERS.findall(low)
    if len(low) > LONGEST and max(map(len, found), default=0) > LONGEST:
        found = [w[i:i + LONGEST] for w in found for i in range(0, len(w), LONGEST)]
    return found


_FACTOR = np.uint64(0xD6E8FEB86659FD93)  # odd; hashes are sums of signs times its powers


def _signs(text: str) -> np.ndarray:
    """A 64-bit value for each code point."""
    return mix(np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1))


class Lattice:
    """All pieces at all places of many words. For each length, the hashes of all beginnings of pieces, so that a place is followed only as long as some piece goes on."""

    def __init__(self, pieces: list[str]):
        self.most = max(map(len, pieces), default=1)
        self.tables = []
        signs = _signs("".join(pieces))
        start = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        value, rest = np.zeros(len(pieces), np.uint64), np.arange(len(pieces))
        size = np.diff(start)
        for n in range(1, self.most + 1):
            rest = rest[size[rest] >= n]
            value[rest] += signs[start[rest] + n - 1] * self._power(n - 1)
            known = np.unique(value[rest])
            piece = np.full(len(known), -1, np.int32)
            whole = rest[size[rest] == n]
            piece[np.searchsorted(known, value[whole])] = whole
            self.tables.append((known, piece))

    @staticmethod
    def _power(n: int) -> np.uint64:
        return np.uint64(pow(int(_FACTOR), n, 2**64))

    def edges(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """word, from, to, piece of every edge, by end place; -1 stands for a single letter that is no piece."""
        signs = _signs("▁" + "▁".join(words))
        size = np.array([len(w) + 1 for w in words])
        stop = np.cumsum(size)
        word = np.repeat(np.arange(len(words)), size)
        begin, live, value, out = (stop - size)[word], np.arange(len(signs)), np.zeros(len(signs), np.uint64), []
        for n, (known, piece) in enumerate(self.tables, 1):
            live = live[live + n <= stop[word[live]]]
            value[live] += signs[live + n - 1] * self._power(n - 1)
            at = np.minimum(np.searchsorted(known, value[live]), len(known) - 1)
            ok = known[at] == value[live] if len(known) else np.zeros(len(live), bool)
            found = np.where(ok, piece[at], -1) if len(known) else np.full(len(live), -1)
            edge = np.ones(len(live), bool) if n == 1 else found >= 0
            out.append((live[edge], np.full(int(edge.sum()), n), found[edge]))
            live = live[ok]
        place, n, p = (np.concatenate(c) for c in zip(*out))
        order = np.lexsort((place, place - begin[place] + n))
        place, n, p = place[order], n[order], p[order]
        i = place - begin[place]
        return word[place], i, i + n, p

    def forward(self, words: list[str], prob: np.ndarray) -> np.ndarray:
        """Log probability of each word in each language; prob is pieces + 1 (the floor, last) by languages."""
        k, i, j, p = self.edges(words)
        alpha = self._alpha(words, k, i, j, self._weights(i, j, p, prob))
        end = np.array([len(w) + 1 for w in words])
        return np.log(alpha[np.arange(len(words)), end]) - (end * np.log(STRETCH))[:, None]

    @staticmethod
    def _weights(i, j, p, prob) -> np.ndarray:
        """Probability of each edge, times STRETCH for each letter. A power of two, so nothing is rounded."""
        weight = prob[p]
        weight *= (STRETCH ** (j - i))[:, None]
        return weight

    def _alpha(self, words, k, i, j, weight) -> np.ndarray:
        longest = max(map(len, words)) + 2
        alpha = np.zeros((len(words), longest, weight.shape[1]))
        alpha[:, 0] = 1
        cuts = np.searchsorted(j, np.arange(longest + 1))
        for at in range(1, longest):
            s = slice(cuts[at], cuts[at + 1])
            np.add.at(alpha[:, at], k[s], alpha[k[s], i[s]] * weight[s])
        return alpha

    def expected(self, words: list[str], counts: np.ndarray, prob: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in each language; counts is words by languages."""
        k, i, j, p = self.edges(words)
        weight = self._weights(i, j, p, prob)  # the factors cancel against the total
        alpha = self._alpha(words, k, i, j, weight)
        beta = np.zeros_like(alpha)
        end = np.array([len(w) + 1 for w in words])
        beta[np.arange(len(words)), end] = 1
        order = np.argsort(-i, kind="stable")
        down = -i[order]
        for at in range(alpha.shape[1] - 1, -1, -1):
            o = order[np.searchsorted(down, -at):np.searchsorted(down, -at, "right")]
            np.add.at(beta[:, at], k[o], beta[k[o], j[o]] * weight[o])
        total = alpha[np.arange(len(words)), end]
        use = alpha[k, i] * weight * beta[k, j] / total[k] * counts[k]
        out = np.zeros(prob.shape)
        np.add.at(out, p, use)
        return out


def vocabulary(name: str = VOCABULARY) -> list[str]:
    """Pieces of a public vocabulary in lower case: those that are letters, with or without the word-begin mark."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(name))
    texts = (model.id_to_piece(i).lower() for i in range(model.get_piece_size()))
    return sorted({t for t in texts if t == "▁" or (t[1:] if t[0] == "▁" else t).isalpha()})


def _probabilities(counts: np.ndarray) -> np.ndarray:
    """Pieces by languages with a floor, and the floor itself as the last row."""
    total = np.maximum(counts.sum(0), 1.0)
    return np.concatenate([np.maximum(counts / total, FLOOR), np.full((1, counts.shape[1]), FLOOR)])


def train(labelled: DataFrame, sample: int = SAMPLE, rounds: int = ROUNDS, vocab: str = VOCABULARY) -> tuple[list[str], np.ndarray]:
    """Languages and piece probabilities (vocabulary by languages: all that comes to the driver). `labelled` has doc_id, text, lang."""
    spark = labelled.sparkSession
    labelled = labelled.filter("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    pieces = vocabulary(vocab)
    if not langs:
        return [], np.zeros((len(pieces) + 1, 0))
    place = {lang: i for i, lang in enumerate(langs)}
    part = F.create_map(*(x for lang in langs for x in (F.lit(lang), F.lit(min(1.0, sample / sizes[lang])))))[F.col("lang")]
    chosen = labelled.filter(hash_key("doc_id", "text", seed=5) < part * float(2**63))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: dict[str, Counter] = {}
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                total.setdefault(lang, Counter()).update(words_of(text))
            rows = [(lang, w, n) for lang, c in total.items() for w, n in c.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows)], names=["lang", "word", "n"])

    table = chosen.select("text", "lang").mapInArrow(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    table = stored(table.repartition(spark.sparkContext.defaultParallelism), "lang-words")
    lattice = spark.sparkContext.broadcast(Lattice(pieces))  # as large as the vocabulary
    prob = np.ones((len(pieces) + 1, len(langs)))  # at first every segmentation counts alike
    for step in range(rounds + 1):
        shared = spark.sparkContext.broadcast((prob, step == 0))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            prob, flat = shared.value
            total = np.zeros(prob.shape)
            for batch in batches:
                words, lang, n = batch.column("word").to_pylist(), batch.column("lang").to_pylist(), batch.column("n").to_numpy()
                for a in range(0, len(words), 2000):
                    some = words[a:a + 2000]
                    counts = np.zeros((len(some), prob.shape[1]))
                    counts[np.arange(len(some)), [place[x] for x in lang[a:a + 2000]]] = n[a:a + 2000]
                    if flat:  # occurrences of each piece anywhere, weighed by its length
                        k, i, j, p = lattice.value.edges(some)
                        np.add.at(total, p, counts[k] * (j - i)[:, None])
                    else:
                        total += lattice.value.expected(some, counts, prob)
            p, g = np.nonzero(total[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(g), pa.array(np.rint(total[p, g] * SCALE).astype(np.int64))], names=["piece", "lang", "n"])

        counts = np.zeros((len(pieces), len(langs)))
        for r in table.mapInArrow(run, "piece bigint, lang bigint, n bigint").groupBy("piece", "lang").agg(F.sum("n").alias("n")).collect():
            counts[r["piece"], r["lang"]] = r["n"] / SCALE
        prob = _probabilities(counts)
    return langs, prob


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", vocab: str = VOCABULARY) -> DataFrame:
    """All columns, lang_pred and score (posterior of the language under equal priors, per word evidence averaged over ten words)."""
    docs = docs.drop("lang_pred", "score")  # input columns of these names are replaced
    shared = docs.sparkSession.sparkContext.broadcast((model[0], model[1], Lattice(vocabulary(vocab))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, prob, lattice = shared.value
        known, table = {}, np.zeros((0, len(langs)))
        for batch in batches:
            preds, scores = [], []
            texts = batch.column(text).to_pylist()
            for a in range(0, len(texts), 500):
                split = [words_of(t) if t else [] for t in texts[a:a + 500]]
                new = list(set().union(*split).difference(known)) if langs else []
                if len(known) > CACHE_WORDS and new:
                    known, table, new = {}, np.zeros((0, len(langs))), list(set().union(*split))
                if new:
                    new.sort(key=len)
                    rows = [lattice.forward(new[b:b + 2000], prob) for b in range(0, len(new), 2000)]
                    known.update(zip(new, range(len(table), len(table) + len(new))))
                    table = np.concatenate([table, *rows])
                for words in split:
                    if not words or not langs:
                        preds.append("und")
                        scores.append(0.0)
                        continue
                    total = table[list(map(known.__getitem__, words))].sum(0)
                    best = int(total.argmax())
                    even = (total - total[best]) * min(1.0, 10 / len(words))
                    preds.append(langs[best])
                    scores.append(float(1 / np.exp(even).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(preds, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    kinds = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{kinds}, lang_pred string, score double")
