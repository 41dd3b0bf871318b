"""Rows that are awkward on purpose: nulls in any column, empty and very long texts, ties, repeated
rows, and extra columns whose names clash with those of the operators."""

import random

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars int, score double, kept boolean, rejected boolean, rank int, "
    "row string, key long, node long, digest string, component_id long, secret_spans string, lang_pred string, __key string, spans string, start long, sequence_id long"
)
EXTRA = (None, None, None, None, "r", 1, 2, "d", 3, "s", "l", "k", "sp", 4, 5)
TEXTS = [
    None, "", " ", "\n\t", "a", "hello world", "Hello  world", "hello world", "hello\tworld ", "été à l'œuvre", "12345 !!!", "漢字かな交じり文", "\U0001f600 x",
    "password=abcdef1234 and token: 'zzzzzz9'", "x" * 30_000, "word " * 4_000, "ab\x00cd ef\x1cgh", "<|endoftext|> tail",
]


def rows(n: int = 40, seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = []
    for i in range(n):
        text = TEXTS[i] if i < len(TEXTS) else " ".join(rng.choice(words) for _ in range(rng.randint(1, 120)))
        out.append((i, text, rng.choice(["en", "fr", None]), rng.choice(["hot", "hot", None, "b"]), None if text is None else len(text), *EXTRA))
    long = " ".join(rng.choice(words) for _ in range(200))
    out += [(1000 + j, long + f" tail {j}", "en", "hot", 9, *EXTRA) for j in range(8)]  # near copies
    out += [(2000 + j, long, "en", "hot", 9, *EXTRA) for j in range(8)]  # copies
    out += [out[5], out[5], (None, "no id", "en", None, None, *EXTRA), (None, None, None, None, None, *EXTRA)]
    return out


def docs(spark, n: int = 40):
    return spark.createDataFrame(rows(n), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
