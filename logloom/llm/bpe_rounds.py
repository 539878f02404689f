"""BPE encoding and decoding in batched merge rounds.

The distinct words of a slice of texts become one flat array of symbols. In each round every word merges its lowest-ranked pair, all words at once: pair
keys are looked up by binary search among the sorted keys of the merge table. Words that are done leave the array. A bounded cache keeps the
ids of words met before in the same task.

The tokenizer file is read by path on every executor (`public_tokenizers.path(name)` or a path of your own); its merges, vocabulary and special tokens decide the ids.
It must be a BPE with a word end suffix, byte-level letters, NFC, lower case and white space dropped. Decoding joins token texts by spaces.

Defined cases: null text counts as empty and gives no ids. Special tokens written in a text become their ids. Repeated rows are encoded each. Words of any length are
encoded whole. Extra columns stay.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from logloom.llm.words import chunks

TOKENIZER = "word_bpe_49k.json"
CACHE_WORDS = 400_000
SLICE_BYTES = 2_000_000
BLOCK_SYMBOLS = 400_000  # symbols merged together
# Fixed values of the tokenizer: contractions, letters, single digits, other runs. White space stands between them.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"


def byte_letters() -> list[str]:
    """The letter each byte is written as: itself where printable in Latin-1, else the next code point from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Bpe:
    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.token = [""] * self.size
        for text, i in [*vocab.items(), *self.special.items()]:
            self.token[i] = text
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made  # rank: place in the merge table
        self.find = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.newer = regex.compile("[" + "".join(c for c in map(chr, range(0x500, 0x20000)) if unicodedata.category(c) == "Cn") + "]")
        young = self.newer.pattern
        self.find_old = regex.compile(PATTERN.replace(r"\p{L}+|\p{N}|", rf"(?:(?!{young})\p{{L}})+|(?!{young})\p{{N}}|").replace(
            r"[^\s\p{L}\p{N}]+", rf"(?:[^\s\p{{L}}\p{{N}}]|{young})+")).findall
        self.token_bytes = [t.encode("utf-8") + b" " for t in self.token]
        self.token_len = np.array([len(t) for t in self.token_bytes], np.int64)
        self.token_at = np.cumsum(self.token_len) - self.token_len
        self.token_data = np.frombuffer(b"".join(self.token_bytes), np.uint8)
        self.forget()

    def forget(self) -> None:
        """An empty cache: the special tokens are its first words."""
        self.known: dict[str, int] = {}
        self.flat = np.array(list(self.special.values()), np.uint32)
        self.lens = np.ones(len(self.special), np.int64)

    def words(self, text: str) -> list[str]:
        if text.isascii():
            return self.find(text.lower())
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # letter by letter: no final sigma
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            if self.newer.search(text):  # letters younger than the tokenizer's Unicode tables are no letters to it
                return self.find_old(text)
        return self.find(text)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each has. One round: rank all pairs, take each word's lowest, join it wherever it stands, from the left."""
        raw = [w.encode("utf-8") for w in words]
        lens = np.array([len(r) for r in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbol, word = self.inner[data], np.repeat(np.arange(len(raw)), lens)
        ends = np.cumsum(lens) - 1
        symbol[ends] = self.last[data[ends]]
        done_word, done_symbol = [], []
        none = len(self.keys)
        while len(symbol):
            inside = word[:-1] == word[1:]
            key = symbol[:-1] * self.size + symbol[1:]
            at = np.minimum(np.searchsorted(self.keys, key), none - 1)
            rank = np.full(len(symbol), none, np.int64)
            rank[:-1] = np.where(inside & (self.keys[at] == key), self.rank[at], none)
            first = np.flatnonzero(np.concatenate([[True], ~inside]))
            count = np.diff(np.append(first, len(symbol)))
            lowest = np.repeat(np.minimum.reduceat(rank, first), count)
            over = lowest == none
            if over.any():
                done_word.append(word[over])
                done_symbol.append(symbol[over])
                live = ~over
                symbol, word, rank, lowest = symbol[live], word[live], rank[live], lowest[live]
                if not len(symbol):
                    break
            place = np.flatnonzero(rank == lowest)
            run = np.ones(len(place), bool)  # in a run of overlapping hits every second one is joined
            run[1:] = place[1:] != place[:-1] + 1
            start = np.maximum.accumulate(np.where(run, place, 0))
            place = place[(place - start) % 2 == 0]
            symbol[place] = self.made[rank[place]]
            keep = np.ones(len(symbol), bool)
            keep[place + 1] = False
            symbol, word = symbol[keep], word[keep]
        word, symbol = np.concatenate(done_word), np.concatenate(done_symbol)
        order = np.argsort(word, kind="stable")
        return symbol[order].astype(np.uint32), np.bincount(word, minlength=len(raw))

    def learn(self, words: list[str]) -> None:
        """Add words to the cache, in blocks of bounded size."""
        flat, lens, block, size = [self.flat], [self.lens], [], 0
        for w in [*words, None]:
            if block and (w is None or size + len(w) > BLOCK_SYMBOLS):
                ids, count = self.merge(block)
                flat.append(ids)
                lens.append(count)
                block, size = [], 0
            if w is not None:
                block.append(w)
                size += len(w)
        at = len(self.lens)
        self.known.update(zip(words, range(at, at + len(words))))
        self.flat, self.lens = np.concatenate(flat), np.concatenate(lens)

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's begin (one more entry than texts)."""
        if len(self.known) > CACHE_WORDS:
            self.forget()
        place = {s: k for k, s in enumerate(self.special)}
        split = [self._pieces(t) for t in texts]
        new = set().union(*(words for pieces in split for words in pieces if not isinstance(words, str)))
        new.difference_update(self.known)
        if new:
            self.learn(list(new))
        get, row, ends = self.known.__getitem__, [], []
        for pieces in split:
            for words in pieces:
                if isinstance(words, str):
                    row.append(place[words])
                else:
                    row.extend(map(get, words))
            ends.append(len(row))
        word = np.array(row, np.int64)
        ids, offs = _gather(self.flat, np.cumsum(self.lens) - self.lens, self.lens, word)
        return ids, offs[np.array([0, *ends])]

    def _pieces(self, text: str) -> list:
        """Lists of words, and between them the special tokens as text."""
        if self.cut is None or not any(s in text for s in self.special):
            return [self.words(text)]
        return [p if k % 2 else self.words(p) for k, p in enumerate(self.cut(text))]

    def decode_batch(self, ids: np.ndarray, offs: np.ndarray) -> list[memoryview]:
        """UTF-8 of each row's token texts, joined by spaces; unknown ids are left out."""
        known = (ids >= 0) & (ids < self.size)
        if not known.all():
            offs = np.concatenate([[0], np.cumsum(known)])[offs]
            ids = ids[known]
        data, at = _gather(self.token_data, self.token_at, self.token_len, ids)
        at, data = at[offs], data.data
        return [data[a:max(a, z - 1)] for a, z in zip(at[:-1], at[1:])]


def _gather(flat: np.ndarray, at: np.ndarray, lens: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches `which` of a flat array, one after the other, and where each begins (one more entry)."""
    n = lens[which]
    offs = np.zeros(len(which) + 1, np.int64)
    np.cumsum(n, out=offs[1:])
    return flat[np.repeat(at[which] - offs[:-1], n) + np.arange(offs[-1])], offs


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def tokenizer_path(name: str) -> str:
    """A path stays; a bare name is looked up among the public tokenizers of the machine the task runs on."""
    if "/" in name:
        return name
    import public_tokenizers
    return str(public_tokenizers.path(name))


def _schema(df: DataFrame, added: str) -> str:
    return ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields), added])


def _mapped(docs: DataFrame, text: str, added: str, columns, tokenizer: str) -> DataFrame:
    """`columns` makes the added columns of a slice from the tokenizer, the ids and where each text's ids begin."""
    names = [a.split(" ")[0] for a in added.split(", ")]
    docs = docs.drop(*names)  # input columns of these names are replaced

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer_path(tokenizer))
        for batch in batches:
            for part in chunks(batch, text, SLICE_BYTES):
                found = columns(bpe, *bpe.encode_batch([t or "" for t in part.column(text).to_pylist()]))
                yield pa.RecordBatch.from_arrays([*part.columns, *found], names=[*part.schema.names, *names])
        bpe.forget()  # a worker outlives its task, and so would the cache

    return docs.mapInArrow(run, _schema(docs, added))


def encode(docs: DataFrame, text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """All columns and `bpe_ids`."""
    def columns(bpe: Bpe, ids: np.ndarray, offs: np.ndarray) -> list[pa.Array]:
        return [pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(ids.astype(np.int32)))]

    return _mapped(docs, text, "bpe_ids array<int>", columns, tokenizer)


def decode(tokens: DataFrame, ids: str = "bpe_ids", tokenizer: str = TOKENIZER) -> DataFrame:
    """All columns and `bpe_text`, the text of the ids; null ids give an empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer_path(tokenizer))
        for batch in batches:
            lists = [np.array(i or [], np.int64) for i in batch.column(ids).to_pylist()]
            offs = np.concatenate([[0], np.cumsum([len(i) for i in lists])]).astype(np.int64)
            texts = [str(t, "utf-8") for t in bpe.decode_batch(np.concatenate([np.zeros(0, np.int64), *lists]), offs)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "bpe_text"])

    return tokens.mapInArrow(run, _schema(tokens, "bpe_text string"))


def digests(docs: DataFrame, text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """All columns and n_tokens, ids_sha256, decoded_sha256: encodes and decodes without handing the ids to Spark."""
    def columns(bpe: Bpe, ids: np.ndarray, offs: np.ndarray) -> list[pa.Array]:
        raw = ids.astype("<u4").view(np.uint8).data
        return [pa.array(np.diff(offs)), pa.array([hashlib.sha256(raw[4 * a:4 * z]).hexdigest() for a, z in zip(offs[:-1], offs[1:])], pa.string()),
                pa.array([hashlib.sha256(t).hexdigest() for t in bpe.decode_batch(ids, offs)], pa.string())]

    return _mapped(docs, text, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", columns, tokenizer)
