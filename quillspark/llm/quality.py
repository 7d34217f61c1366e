"""Quality classifier: similarity-weighted votes of the nearest labelled documents in a latent space.

A document is a bag of *shape* terms: its characters become classes (lower case, upper case, digit, space,
line end, each punctuation mark), runs of one class become symbols with a bucketed length, and terms are
pairs of neighbouring symbols, plus whether a word repeats the one before. Terms are weighted by the square root
of their share and by inverse document frequency, and a truncated SVD of the labelled sample gives the
latent space. The labelled vectors are a bounded, broadcast matrix; every document takes its cosine to
all of them in blocks, and its nearest ones vote.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import bounded_batches, fresh_name, remainder

#: Labelled documents of each class in the sample at most: the matrix has 2 x this many rows.
SAMPLE_PER_CLASS = 1000
DIMENSIONS = 48
NEIGHBOURS = 25
#: Votes weigh cosine to this power.
SHARPNESS = 8
THRESHOLD = 0.3
BLOCK_ROWS = 512

# Character classes: code points below 128 that are neither letters, digits nor white space keep a class of their own.
LOWER, UPPER, DIGIT, SPACE, LINE, FIRST_MARK = range(6)
MARKS = [c for c in range(33, 127) if not chr(c).isalnum()]
CLASSES = FIRST_MARK + len(MARKS) + 1  # the last: other characters
RUNS = 4  # buckets of a run's length: 1, 2-3, 4-7, longer
SYMBOLS = CLASSES * RUNS
TERMS = SYMBOLS * SYMBOLS + 2  # the last two: words that repeat the one before, and other words


def class_table() -> np.ndarray:
    """Code point -> class."""
    t = np.full(0x110000, CLASSES - 1, dtype=np.uint8)
    for i in range(0x3000):
        c = chr(i)
        if c.isalpha():
            t[i] = UPPER if c.isupper() else LOWER
        elif c.isdigit():
            t[i] = DIGIT
        elif c.isspace():
            t[i] = LINE if c in "\n\r" else SPACE
    t[0x3000:0x3001] = SPACE
    t[0x3400:0xD7A4] = t[0x20000:0x32000] = LOWER
    for k, c in enumerate(MARKS):
        t[c] = FIRST_MARK + k
    return t


def terms(text: str, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers of a whole text, rising, and their counts; none for a null or empty one."""
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = classes[np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)]
    at = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
    run = np.diff(np.r_[at, len(c)])
    symbols = c[at].astype(np.int64) * RUNS + (run > 1) + (run > 3) + (run > 7)
    # ends of the text count as line ends
    symbols = np.r_[LINE * RUNS, symbols, LINE * RUNS]
    found, count = np.unique(symbols[:-1] * SYMBOLS + symbols[1:], return_counts=True)
    words = text.split()
    again = sum(map(str.__eq__, words, words[1:]))
    return np.r_[found, TERMS - 2, TERMS - 1], np.r_[count, again, len(words) - again]


def fit(samples: list[tuple[np.ndarray, np.ndarray, int]], dimensions: int = DIMENSIONS) -> dict | None:
    """Latent space and labelled vectors from (terms, counts, label) of the sample; None for no sample."""
    samples = [s for s in samples if len(s[0])]
    if not samples:
        return None
    kept, df = np.unique(np.concatenate([t[c > 0] for t, c, _ in samples]), return_counts=True)
    idf = np.log((1.0 + len(samples)) / (1.0 + df)) + 0.1
    column = np.full(TERMS, -1, dtype=np.int32)
    column[kept] = np.arange(len(kept))
    x = np.stack([weights(t, c, column, idf) for t, c, _ in samples])
    gram = x.T @ x if x.shape[1] <= x.shape[0] else x @ x.T
    values, vectors = np.linalg.eigh(gram)
    top = np.argsort(-values)[:dimensions]
    top = top[values[top] > 1e-9 * max(values.max(), 1e-300)]
    basis = vectors[:, top] if x.shape[1] <= x.shape[0] else x.T @ vectors[:, top] / np.sqrt(values[top])
    return {"column": column, "idf": idf, "basis": basis, "vectors": unit(x @ basis),
            "labels": np.array([label for _, _, label in samples], dtype=np.float64)}


def weights(t: np.ndarray, c: np.ndarray, column: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit-length vector of a document: square root of each term's share, times its inverse document frequency."""
    row = np.zeros(len(idf))
    at = column[t]
    ok = at >= 0
    row[at[ok]] = np.sqrt(c[ok] / max(c[:-2].sum(), 1)) * idf[at[ok]]
    norm = np.sqrt(row @ row)
    return row / norm if norm > 0 else row


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def vote(z: np.ndarray, model: dict, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Share of label 1 among the nearest labelled vectors, weighted by cosine; 0 where no cosine is above 0."""
    cosine = np.maximum(z @ model["vectors"].T, 0.0)
    k = min(neighbours, cosine.shape[1])
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    w = np.take_along_axis(cosine, near, axis=1) ** SHARPNESS
    total = w.sum(axis=1)
    return np.clip(np.divide((w * model["labels"][near]).sum(axis=1), total, out=np.zeros(len(z)), where=total > 0), 0.0, 1.0)


def score_texts(texts: list[str | None], model: dict | None, classes: np.ndarray) -> np.ndarray:
    scores = np.zeros(len(texts))
    if model is None:
        return scores
    for at in range(0, len(texts), BLOCK_ROWS):
        block = texts[at : at + BLOCK_ROWS]
        x = np.stack([weights(*terms(t, classes), model["column"], model["idf"]) if t else np.zeros(len(model["idf"])) for t in block])
        scores[at : at + len(block)] = vote(unit(x @ model["basis"]), model)
    return scores


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(terms, counts, quality) of ``per_class`` different labelled texts of each class that are not held out, all if there are
    fewer, in the order of a hash of the text: labels of absent or empty documents and copies take no place.

    Hashes of the texts meet the labels; the smallest ones of each class, at most ``per_class``, are broadcast to pick
    their texts, so no text is shuffled. Terms are made in tasks, the driver gets 2 x ``per_class`` bags."""
    usable = labels.where("quality in (0, 1)").where(~held_out(labels)).select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).where("length(text) > 0")
    met = texts.select("doc_id", "h").join(usable, "doc_id").select("h", "quality").distinct()
    order = [F.xxhash64("h", F.lit("sample")), "h"]
    chosen = met.where("quality = 0").orderBy(*order).limit(per_class).unionAll(met.where("quality = 1").orderBy(*order).limit(per_class))

    def bags(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classes = class_table()
        for part in parts:
            both = [terms(t, classes) for t in part["text"]]
            yield pd.DataFrame({"h": part["h"], "quality": part["quality"], "t": [b[0] for b in both], "c": [b[1] for b in both]})

    rows = texts.select("text", "h").join(F.broadcast(chosen), "h").groupBy("h", "quality").agg(F.first("text").alias("text"))
    found = rows.mapInPandas(bags, "h long, quality int, t array<long>, c array<long>").collect()
    return [(np.array(r["t"], np.int64), np.array(r["c"], np.int64), r["quality"]) for r in sorted(found, key=lambda r: (r["quality"], r["h"]))]


def held_out(df: DataFrame):
    return remainder(F.col("doc_id"), 5) == 0


def scorer(docs: DataFrame, labels: DataFrame):
    """Column function ``text -> score`` learned from the labelled documents that are not held out."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shipped = spark.sparkContext.broadcast({"model": fit(labelled_sample(docs, labels))})  # a few MB at most

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model, classes = shipped.value["model"], class_table()
        for texts in parts:
            yield pd.Series(score_texts(texts.tolist(), model, classes))

    return score


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 from 0.3).

    Learns from ``labels`` (doc_id, quality) of rows that are not held out; other qualities than 0 and 1
    and null are left out. Scores come from the text alone. Null and empty texts, and all texts if nothing
    is labelled, score 0. Ties between neighbours at the last place may fall either way but are the same
    in every run. Repeated rows come back as often as they go in; an empty table gives no rows.
    """
    r = docs.select("doc_id", held_out(docs).alias("held_out"), scorer(docs, labels)("text").alias("score"))
    return r.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those predicted to be of label 0. All columns come back as they were."""
    name = fresh_name(docs, "quality")
    r = docs.withColumn(name, scorer(docs, labels)("text"))
    return r.where(F.col(name) >= THRESHOLD).drop(name)
