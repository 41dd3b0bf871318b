"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the average of the embeddings of its hashed byte n-grams; a linear softmax names the
language. Both are trained by stochastic gradient descent in numpy on a bounded sample of labelled
rows. Scores are calibrated by a temperature, and a text whose calibrated score is lower than
nearly all right answers on held-back rows, or that has no letter, is rejected.

As the classifier is linear in the average, its two layers fold into one table of logits per
bucket for prediction, so that a text costs one lookup for each of its n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pieces, table

BUCKETS = 1 << 16
SIZES = (2, 3, 4)
DIMENSIONS = 16
ROWS_PER_LANGUAGE = 500
BYTES_PER_LANGUAGE = 8 << 20
MOST_LANGUAGES = 256
BATCH_BYTES = 1 << 18
UNKNOWN = "und"

_FOLD = np.full(256, 32, np.uint8)  # ASCII other than letters is white space
_FOLD[97:123] = range(97, 123)
_FOLD[65:91] = range(97, 123)
_FOLD[128:] = range(128, 256)
_LETTER = regex.compile(r"\p{L}")


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``(buckets, texts' numbers)`` of the n-grams of all texts. An n-gram lies in one text, and
    white space runs count as one space."""
    joined = _FOLD[np.frombuffer(b"".join(b" " + t + b" " for t in texts), np.uint8)]
    of = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])
    keep = np.r_[True, (joined[1:] != 32) | (joined[:-1] != 32) | (of[1:] != of[:-1])]
    joined, of = joined[keep].astype(np.uint32), of[keep]
    found, owner = [], []
    h = joined
    for n in range(2, max(SIZES) + 1):
        h = h[:-1] * np.uint32(0x01000193) ^ joined[n - 1 :]
        if n in SIZES:
            inside = of[n - 1 :] == of[: len(h)]
            mixed = (h ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            found.append(((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0xC2B2AE35) >> np.uint32(16))[inside])
            owner.append(of[: len(h)][inside])
    return np.concatenate(found), np.concatenate(owner)


def batches_of(texts: list[str | None]) -> Iterator[list[bytes]]:
    own: list[bytes] = []
    size = 0
    for t in texts:
        own.append((t or "").encode())
        size += len(own[-1])
        if size >= BATCH_BYTES:
            yield own
            own, size = [], 0
    if own:
        yield own


@dataclass
class Model:
    languages: list[str]
    logits: np.ndarray  # of each bucket, BUCKETS x languages
    temperature: float
    least_score: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Calibrated probabilities, texts x languages."""
        bucket, of = features(texts)
        n = np.maximum(np.bincount(of, minlength=len(texts)), 1)
        z = np.stack([np.bincount(of, self.logits[:, k][bucket], len(texts)) / n for k in range(len(self.languages))], 1)
        return softmax(z / self.temperature)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """For each text its language, its score and whether it is rejected."""
        out: list[tuple[str, float, bool]] = []
        for own in batches_of(texts):
            p = self.scores(own)
            best = p.argmax(1)
            for raw, k, s in zip(own, best.tolist(), p[np.arange(len(own)), best].tolist(), strict=True):
                letters = bool(_LETTER.search(raw.decode()))
                out.append((self.languages[k], s, s < self.least_score) if letters else (UNKNOWN, 0.0, True))
        return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(texts: list[str], labels: list[str], epochs: int = 6, rate: float = 2.0, seed: int = 7, keep_right: float = 0.995) -> Model:
    """Fits on four fifths of the rows and calibrates on the rest: the temperature by likelihood,
    and the least score so that ``keep_right`` of the right answers stay. An embedding's gradient
    is weighted by 50 times its n-gram's share of the text, 1 at most."""
    languages = sorted(set(labels))
    target = np.array([languages.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    rows = [np.unique(features([t.encode()])[0], return_counts=True) for t in texts]
    rows = [(b, (n / max(n.sum(), 1)).astype(np.float32)) for b, n in rows]
    held = rng.random(len(rows)) < 0.2
    if held.all() or not held.any():
        held[:] = False
    emb = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    out = np.zeros((DIMENSIONS, len(languages)), np.float32)
    order = np.flatnonzero(~held)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(order):
            bucket, share = rows[i]
            if not len(bucket):
                continue
            x = share @ emb[bucket]
            z = x @ out
            e = np.exp(z - z.max())
            g = e / e.sum()
            g[target[i]] -= 1
            back = out @ g
            out -= step * np.outer(x, g)
            # Shares are small: bounded, so that each embedding moves by a useful amount.
            emb[bucket] -= step * np.outer(np.minimum(share * 50, 1), back)
    logits = emb @ out
    check = np.flatnonzero(held) if held.any() else order
    z = np.stack([rows[i][1] @ logits[rows[i][0]] if len(rows[i][0]) else np.zeros(len(languages)) for i in check])
    fits = [(-np.log(softmax(z / t)[np.arange(len(check)), target[check]] + 1e-9).mean(), t) for t in np.geomspace(0.005, 20, 80)]
    temperature = float(min(fits)[1])
    p = softmax(z / temperature)
    right = p.max(1)[p.argmax(1) == target[check]]
    least = float(min(0.5, np.quantile(right, 1 - keep_right))) if len(right) else 0.0
    return Model(languages, logits, temperature, least)


def labelled(docs: DataFrame, id_col: str, text_col: str, label_col: str, rows_per_language: int, bytes_per_language: int, most_languages: int) -> DataFrame:
    """A bounded sample: of every label about ``rows_per_language`` rows by a hash of id and text,
    and of these whole texts up to ``bytes_per_language``. Longer texts come last, the shortest
    first; so a label with none but longer ones has that one. More than ``most_languages`` labels
    are an error, as the model holds a column for each."""
    draw = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(1_000_003))
    counts = docs.groupBy(label_col).count().limit(most_languages + 1).collect()
    if len(counts) > most_languages:
        raise ValueError(f"more than {most_languages} labels to learn; raise most_languages")
    part = F.lit(None).cast("double")
    for label, n in counts:
        part = F.when(F.col(label_col) == label, F.lit(1_000_003 * rows_per_language / n)).otherwise(part)
    rows = docs.select(F.col(text_col).alias("text"), F.col(label_col).alias("label"), draw.alias("draw"), part.alias("part"), F.octet_length(text_col).alias("size"))
    order = Window.partitionBy("label").orderBy(F.greatest(F.col("size"), F.lit(bytes_per_language)), "draw", "text")
    some = rows.where("draw < part").select("text", "label", "draw", F.row_number().over(order).alias("at"), F.sum("size").over(order).alias("sum"))
    some = some.where((F.col("at") == 1) | ((F.col("at") <= 2 * rows_per_language) & (F.col("sum") <= bytes_per_language)))
    return some.orderBy("draw", "label", "text").select("text", "label")


def fit(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "lang",
    rows_per_language: int = ROWS_PER_LANGUAGE,
    bytes_per_language: int = BYTES_PER_LANGUAGE,
    most_languages: int = MOST_LANGUAGES,
) -> Model | None:
    """Learns from rows with a label and a letter; None where there are none."""
    usable = docs.where(F.col(label_col).isNotNull() & F.coalesce(F.col(text_col), F.lit("")).rlike(r"\p{L}"))
    rows = labelled(usable, id_col, text_col, label_col, rows_per_language, bytes_per_language, most_languages).collect()
    return train([r.text for r in rows], [r.label for r in rows]) if rows else None


def learnable(id_col: str = "doc_id"):
    """Rows to learn from: crc32 of the id as text, mod 3, is not 1."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 3 != 1


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows and columns with lang_pred, score and rejected, from the text alone, which
    may be a field of a struct (``row.text``).

    Null and empty texts and texts without a letter are ``und`` with score 0 and rejected, and so
    is every text if there was nothing to learn from. Repeated rows are judged alike; no rows give
    none. Input columns named like the three new ones are replaced.
    """
    docs = docs.drop("lang_pred", "score", "rejected")
    names = [*docs.columns, "lang_pred", "score", "rejected"]
    outer, *inner = text_col.split(".") if text_col not in docs.columns else [text_col]
    at = docs.columns.index(outer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            column = batch.column(at)
            for name in inner:
                column = pc.struct_field(column, name)
            texts = column.to_pylist()
            found = model.predict(texts) if model else [(UNKNOWN, 0.0, True)] * len(texts)
            lang, score, rejected = zip(*found, strict=True) if found else ((), (), ())
            new = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=names)

    schema = ", ".join(f"`{n}` {k}" for n, k in docs.dtypes)
    return docs.mapInArrow(run, f"{schema}, lang_pred string, score double, rejected boolean")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(learnable()))
    return identify(docs.select("doc_id", "text"), model).select(
        "doc_id", (~learnable()).alias("held_out"), "lang_pred", "score", "rejected"
    )
