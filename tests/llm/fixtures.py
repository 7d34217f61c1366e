"""Small tables with the cases every operator must take: nulls, empty and very long texts, ties, repeated rows,
no rows, and extra columns whose names clash with those that operators use inside."""

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, row string, size string, fp string, n string, block string, h string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed, words, letters="etaoinshr"):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(200)]
    return " ".join(rng.choice(vocabulary) for _ in range(words)).capitalize() + "."


def hard_rows():
    texts = [
        prose(1, 30), prose(1, 30), prose(2, 300), prose(3, 4), None, "", " \t\n\x0b\x0c\r ", "12 34 !!! ---",
        prose(4, 30_000), "One two", "ONE TWO", "é è ñ ß Ça l'été d'août", "日本語のテキスト です", "a<|endoftext|>b c",
        "x\x1cy z\x1fw", "don't I'll 've   sep nbsp", "Aé" * 3000, prose(2, 300) + " tail",
    ]
    rows = [(i + 1, t, "en" if i % 2 else "fr", [None, "a", "b", "c"][i % 4], len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[0], (None, prose(5, 40), None, "a", 1), (None, None, "en", None, None), (100, prose(6, 12), "", "", 3)]
    return [r + ("x",) * 7 for r in rows]


def hard_docs(spark):
    return spark.createDataFrame(hard_rows(), DOCS).repartition(3)


def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def key(x):
    return (x is None, x if x is not None else 0)
