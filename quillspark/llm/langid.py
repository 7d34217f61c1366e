"""Language identification by cross-parsing entropy.

For each language a suffix automaton of sample text knows every substring of that sample. A text is
parsed greedily into the longest phrases that occur in the sample; the fewer phrases a language needs, the
closer it is. A phrase costs log2 of the sample's length in bits, so phrases are normalised to bits per
character and languages with smaller samples are not at an advantage.

The greedy parse is a walk through a complete automaton: where a transition is missing, a phrase ends and
the walk goes on from the start state. These tables are dense arrays, so numpy walks through many texts
at once, one character of each per step.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import bounded_batches, fresh_name, remainder

#: Characters of sample text, over all languages together and for one at most: they bound the model.
SAMPLE_CHARS = 320_000
LANGUAGE_CHARS = 60_000
#: Texts are walked through in parallel blocks of this many characters; a phrase ends where a block does.
BLOCK = 4096
#: Bits per character by which another language loses a factor of e in the score.
SHARPNESS = 0.25
UNKNOWN = "und"
GAP, OTHER = 0, 1  # classes of characters: not a letter, a letter that no sample has
#: Letters of the samples with a class of their own. Further ones are spelled by their rank with three digits of this base, each
#: digit in classes of its own, so that letters of large scripts stay apart in an alphabet of at most 250 classes.
COMMON, BASE, DIGITS = 92, 52, 3
SPELLED = 255


@dataclass
class Model:
    languages: list[str]
    bits: list[float]  # of a phrase
    classes: np.ndarray  # code point -> class, or SPELLED
    ranks: np.ndarray | None  # code point -> rank of a spelled letter; None if there are none
    width: int
    tables: list[np.ndarray]  # state * width + class -> 2 * next state + (1 if a phrase ends before it)


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings, by state; state 0 is the start."""
    step: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in symbols:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and c not in step[at]:
            step[at][c] = new
            at = link[at]
        if at >= 0:
            to = step[at][c]
            if length[to] == length[at] + 1:
                link[new] = to
            else:
                twin = len(step)
                step.append(dict(step[to]))
                length.append(length[at] + 1)
                link.append(link[to])
                link[to] = link[new] = twin
                while at >= 0 and step[at].get(c) == to:
                    step[at][c] = twin
                    at = link[at]
        last = new
    return step


def parse_table(symbols: list[int], width: int) -> np.ndarray:
    """The automaton made complete for greedy parsing (see ``Model.tables``)."""
    step = suffix_automaton(symbols)
    start = np.ones(width, dtype=np.int64)  # a symbol that the sample lacks: a phrase of its own
    for c, to in step[0].items():
        start[c] = 2 * to + 1
    table = np.tile(start, (len(step), 1))
    for state, out in enumerate(step):
        for c, to in out.items():
            table[state, c] = 2 * to
    return table.astype(np.int32).ravel()


def classify(text: str, classes: np.ndarray, ranks: np.ndarray | None) -> np.ndarray:
    """Classes of the lower-cased characters; a run of characters that are no letters is one gap."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), dtype=np.uint32)
    c = classes[points]
    if ranks is not None and (spelled := c == SPELLED).any():
        rank = np.repeat(ranks[points], np.where(spelled, DIGITS, 1))
        c = np.repeat(c, np.where(spelled, DIGITS, 1))
        at = np.flatnonzero(c == SPELLED).reshape(-1, DIGITS)
        for d in range(DIGITS):
            c[at[:, d]] = OTHER + 1 + COMMON + d * BASE + rank[at[:, d]] // BASE ** (DIGITS - 1 - d) % BASE
    return c[np.r_[True, (c[1:] != GAP) | (c[:-1] != GAP)]] if len(c) else c


def letter_classes(samples: list[str]) -> tuple[np.ndarray, np.ndarray | None, int]:
    """Class of each code point, ranks of the spelled letters, and the number of classes: gap, unknown letter, one for each of the
    most frequent letters of the samples, and the digits of the others if there are any."""
    counts = Counter(c for s in samples for c in s.lower() if c.isalpha())
    seen = [c for c, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))]
    classes = np.zeros(0x110000, dtype=np.uint8)
    classes[[i for i in range(0x110000) if chr(i).isalpha()]] = OTHER
    for k, c in enumerate(seen[:COMMON]):
        classes[ord(c)] = OTHER + 1 + k
    if len(seen) <= COMMON:
        return classes, None, OTHER + 1 + len(seen)
    ranks = np.zeros(0x110000, dtype=np.int32)
    for k, c in enumerate(seen[COMMON : COMMON + BASE**DIGITS]):  # more than Unicode has letters
        classes[ord(c)], ranks[ord(c)] = SPELLED, k
    return classes, ranks, OTHER + 1 + COMMON + BASE * DIGITS


def fit(samples: dict[str, list[str]]) -> Model:
    """Model of the sample texts of each language; a language without any letter is left out."""
    classes, ranks, width = letter_classes([t for texts in samples.values() for t in texts])
    model = Model([], [], classes, ranks, width, [])
    for lang in sorted(samples):
        symbols = classify(" ".join(samples[lang]), classes, ranks)
        if (symbols != GAP).any():
            model.languages.append(lang)
            model.bits.append(float(np.log2(len(symbols) + 1)))
            model.tables.append(parse_table(symbols.tolist(), width))
    return model


def phrase_counts(symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, table: np.ndarray, width: int) -> np.ndarray:
    """Phrases that each block (of given start and length, not empty) needs."""
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    state = np.zeros(len(starts), dtype=np.int64)
    count = np.ones(len(starts), dtype=np.int64)  # the last phrase ends with the block
    active = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), side="left")
    for t, n in enumerate(active):
        code = table[state[:n] * width + symbols[starts[:n] + t]]
        count[:n] += code & 1
        state[:n] = code >> 1
    # a text whose first letter is unknown to the sample ended an empty phrase: not worth telling apart
    out = np.empty_like(count)
    out[order] = count
    return out


def score_texts(texts: list[str | None], model: Model) -> tuple[list[str], list[float], list[float]]:
    """Language, score in 0..1 and bits per character of the best language, for whole texts."""
    symbols = [classify(t or "", model.classes, model.ranks) for t in texts]
    letters = np.array([(s != GAP).any() for s in symbols], dtype=bool)
    size = np.array([len(s) for s in symbols], dtype=np.int64)
    if not model.languages or not letters.any():
        return [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
    flat, first = np.concatenate(symbols), np.cumsum(size) - size
    blocks = -(-size // BLOCK)
    owner = np.repeat(np.arange(len(texts)), blocks)
    inner = (np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * BLOCK
    lengths = np.minimum(BLOCK, size[owner] - inner)
    bits = np.empty((len(texts), len(model.languages)))
    for k, table in enumerate(model.tables):
        phrases = np.bincount(owner, phrase_counts(flat, first[owner] + inner, lengths, table, model.width), len(texts))
        bits[:, k] = phrases * model.bits[k] / np.maximum(size, 1)
    best = bits.argmin(axis=1)
    low = bits[np.arange(len(texts)), best]
    score = 1.0 / np.exp((low[:, None] - bits) / SHARPNESS).sum(axis=1)
    langs = [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters)]
    return langs, np.where(letters, score, 0.0).tolist(), np.where(letters, low, 0.0).tolist()


def sample_texts(labelled: DataFrame, sample_chars: int = SAMPLE_CHARS, language_chars: int = LANGUAGE_CHARS) -> dict[str, list[str]]:
    """Texts of each language (columns ``lang``, ``text``) until the language's share of the bound is
    met, in the order of a hash of the text; the last one is cut where the share ends. Copies hash alike and count
    once, so a text that fills a third of the table is one text of the sample, and a text that is longer than the share
    weighs no more than the share. Expects a modest number of languages.
    """
    rows = labelled.where("lang is not null and length(text) > 0").select("lang", "text", F.xxhash64("text").alias("h"))
    # the hash as an unsigned number has 1 to 64 significant bits: texts below 2 ** bits, for the least that meets the share
    bits = F.length(F.bin(F.col("h").bitwiseXOR(F.lit(-(2**63)))))
    sizes = rows.groupBy("lang", "h").agg(F.min(F.least(F.length("text"), F.lit(language_chars))).alias("n"))
    found = sorted(tuple(r) for r in sizes.groupBy("lang", bits.alias("bits")).agg(F.sum("n").alias("n")).collect())
    if not found:
        return {}
    bound = min(language_chars, sample_chars // len({lang for lang, *_ in found}))
    met: dict[str, int] = {}
    most: dict[str, int] = {}
    for lang, b, n in found:
        if met.get(lang, 0) < bound:
            met[lang], most[lang] = met.get(lang, 0) + n, b
    chosen = rows.where(bits <= F.create_map(*[F.lit(x) for of in most.items() for x in of])[F.col("lang")])
    chosen = chosen.select("lang", "h", F.substring("text", 1, bound).alias("text"))
    samples: dict[str, list[str]] = {}
    taken: dict[str, int] = {}
    for r in chosen.groupBy("lang", "h").agg(F.min("text").alias("text")).orderBy("h", "lang").toLocalIterator():
        if (at := taken.get(r["lang"], 0)) < bound:
            text = r["text"][: bound - at]
            taken[r["lang"]] = at + len(text)
            samples.setdefault(r["lang"], []).append(text)
    return samples


def detector(labelled: DataFrame, sample_chars: int = SAMPLE_CHARS, language_chars: int = LANGUAGE_CHARS):
    """Column function ``text -> struct(lang_pred, score, bits)`` learned from ``labelled``."""
    spark = labelled.sparkSession
    bounded_batches(spark)
    model = fit(sample_texts(labelled, sample_chars, language_chars))
    shipped = spark.sparkContext.broadcast(vars(model))  # at most about 3 * sample_chars * letters * 4 bytes

    @F.pandas_udf("lang_pred string, score double, bits double")
    def detect(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = Model(**shipped.value)
        for texts in parts:
            langs, score, bits = score_texts(texts.tolist(), m)
            yield pd.DataFrame({"lang_pred": langs, "score": score, "bits": bits})

    return detect


def held_out(doc_id: Column) -> Column:
    return remainder(doc_id, 4) == 2


def language_id(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, bits.

    Learns from rows that are not held out and have a lang; predicts from the text alone. A null text,
    one without letters, or a table without any label gives ``und`` and score 0. Ties go to the language
    that sorts first. Repeated rows come back as often as they go in; an empty table gives no rows.
    """
    detect = detector(docs.where(~held_out(F.col("doc_id"))).select("lang", "text"))
    r = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), detect("text").alias("r"))
    return r.select("doc_id", "held_out", "r.lang_pred", "r.score", "r.bits")


def keep_identified(docs: DataFrame, max_bits: float) -> DataFrame:
    """``docs`` without those that no learned language explains: ``und``, or more than ``max_bits`` bits a
    character. All columns come back as they were."""
    name = fresh_name(docs, "language")
    detect = detector(docs.where(~held_out(F.col("doc_id"))).select("lang", "text"))
    r = docs.withColumn(name, detect("text"))
    return r.where((F.col(name)["lang_pred"] != UNKNOWN) & (F.col(name)["bits"] <= max_bits)).drop(name)
