"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

The symbols of many distinct words lie in one flat array. In each round every word merges its
lowest-rank pair, at all places, left to right; ranks come from a binary search over sorted pair
keys and are looked up again only beside a merge. Words seen before come from a bounded cache.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import pieces, table

#: How the byte-level scheme splits a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
NONE = np.int64(1) << 40
CACHED_WORDS = 300_000
BATCH_CHARS = 1_000_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The scheme's letter for each byte: itself where printable, else the next from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in own}
    rest = (b for b in range(256) if chr(b) not in letters)
    return letters | {chr(256 + i): b for i, b in enumerate(list(rest))}


class Vocabulary:
    """What a tokenizer file holds, as arrays: small, fixed by the file, and sent with the tasks."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens = [b""] * self.size
        for word, i in vocab.items():
            self.tokens[i] = bytes(letters[c] for c in word) if all(c in letters for c in word) else word.encode()
        for word, i in self.special.items():
            self.tokens[i] = word.encode()
        self.byte_id = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.byte_id[b] = vocab[c]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)  # by rank
        self.name = hashlib.sha256(path.encode() + keys.tobytes()).hexdigest()

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NONE)

    def merge(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and each word's number of ids."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        done_word, done_sym = [], []
        rank = np.full(len(sym), NONE)  # of the pair that starts at each symbol
        pair = np.flatnonzero(word[:-1] == word[1:])
        rank[pair] = self.ranks(sym[pair], sym[pair + 1])
        while len(sym):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, first)
            length = np.diff(np.r_[first, len(sym)])
            if (over := least >= NONE).any():
                gone = np.repeat(over, length)
                done_word.append(word[gone])
                done_sym.append(sym[gone])
                sym, word, rank = sym[~gone], word[~gone], rank[~gone]
                least, length = least[~over], length[~over]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(least, length))
            # Of a run of overlapping places (a a a), every second one stays.
            fresh = np.r_[True, (np.diff(at) != 1) | (word[at[1:]] != word[at[:-1]])]
            start = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - start) % 2 == 0]
            sym[at] = self.made[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            sym, word, rank = sym[keep], word[keep], rank[keep]
            at = moved[at]
            touched = np.unique(np.r_[at, at[at > 0] - 1])
            rank[touched] = NONE
            touched = touched[touched + 1 < len(sym)]
            touched = touched[word[touched] == word[touched + 1]]
            rank[touched] = self.ranks(sym[touched], sym[touched + 1])
        if not done_word:
            return np.zeros(0, np.int64), sizes
        word, sym = np.concatenate(done_word), np.concatenate(done_sym)
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=len(words))


class Coder:
    """Encodes and decodes texts; keeps the ids of up to ``CACHED_WORDS`` words."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.split = regex.compile(WORDS)
        special = sorted(vocabulary.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.token_size = np.fromiter(map(len, vocabulary.tokens), np.int64, vocabulary.size)
        self.token_start = np.cumsum(self.token_size) - self.token_size
        self.token_bytes = np.frombuffer(b"".join(vocabulary.tokens), np.uint8)
        self.forget()

    def forget(self) -> None:
        self.cache: dict[str, int] = {s: i for i, s in enumerate(self.v.special)}
        ids = list(self.v.special.values())
        self.text, self.count = list(map(str, ids)), np.ones(len(ids), np.int64)
        self.start, self.flat = np.arange(len(ids)), np.array(ids, np.int64)

    def words(self, text: str) -> list[str]:
        if self.special is None or not self.special.search(text):
            return self.split.findall(text)
        out = []
        for part in self.special.split(text):
            out += [part] if part in self.v.special else self.split.findall(part)
        return out

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.cache]
        if not new:
            return
        ids, count = self.v.merge([w.encode() for w in new])
        self.cache.update(zip(new, range(len(self.text), len(self.text) + len(new)), strict=True))
        start = np.cumsum(count) - count
        texts, cuts = list(map(str, ids.tolist())), start.tolist()
        self.text += [",".join(texts[a : a + n]) for a, n in zip(cuts, count.tolist(), strict=True)]
        self.start = np.r_[self.start, start + len(self.flat)]
        self.count = np.r_[self.count, count]
        self.flat = np.r_[self.flat, ids]

    def encode(self, texts: Sequence[str]) -> Iterator[tuple[np.ndarray, str]]:
        """For each text its ids, and the ids in decimal joined by commas."""
        at = 0
        while at < len(texts):
            n, chars = 0, 0
            while at + n < len(texts) and (not n or chars < BATCH_CHARS):
                chars += len(texts[at + n])
                n += 1
            split = [self.words(t) for t in texts[at : at + n]]
            if len(self.cache) > CACHED_WORDS:
                self.forget()
            self.learn(set().union(*split))
            for words in split:
                known = [self.cache[w] for w in words]
                yield self.ids(np.array(known, np.int64)), ",".join([self.text[i] for i in known])
            at += n

    def ids(self, known: np.ndarray) -> np.ndarray:
        count = self.count[known]
        return self.flat[np.repeat(self.start[known] - (np.cumsum(count) - count), count) + np.arange(count.sum())]

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids, special tokens included; broken UTF-8 becomes U+FFFD."""
        size = self.token_size[ids]
        at = np.repeat(self.token_start[ids] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return self.token_bytes[at].tobytes().decode("utf-8", "replace")


_coders: dict[str, Coder] = {}


def coder(vocabulary: Vocabulary) -> Coder:
    """One for each Python worker."""
    if vocabulary.name not in _coders:
        _coders[vocabulary.name] = Coder(vocabulary)
    return _coders[vocabulary.name]


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, and with ``with_ids``
    also the ids and the decoded text.

    Null and empty texts have no tokens; a special token's own string in a text becomes that token;
    repeated rows and null ids are rows like any other; no rows give none; other columns are not
    read. Memory holds one batch of rows, about ``BATCH_CHARS`` characters of words and the cache.
    """
    vocabulary = Vocabulary(path or default_path())
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if with_ids else [])]
    types = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(), "ids": pa.list_(pa.int64()), "decoded": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(vocabulary)
        for batch in pieces(batches):
            texts, out = [t or "" for t in batch.column("text").to_pylist()], {n: [] for n in names[1:]}
            for ids, text in c.encode(texts):
                back = c.decode(ids)
                row = [len(ids), hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), ids, back]
                for name, value in zip(out, row, strict=False):
                    out[name].append(value)
            columns = [pa.array(v, types[n]) for n, v in out.items()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=names)

    kind = dict(docs.dtypes)[id_col]
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text").mapInArrow(
        run, schema + (", ids array<long>, decoded string" if with_ids else "")
    )


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"))
