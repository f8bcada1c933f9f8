"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.scratch import discard, id_type, map_arrow, narrowed, stored

#: Hash buckets of n-grams, and the lengths of n-grams counted.
BUCKETS = 1 << 15
LENGTHS = (1, 2, 3)
#: Characters scored together.
CHUNK = 2_000_000
#: Added to each count.
SMOOTHING = 0.5

#: Languages at most: the matrix that is broadcast has ``BUCKETS`` numbers (256 KB) for each.
LANGUAGES = 256

_WORDLY = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether a character's category is a letter's (L...); numbers such as ½ or Ⅷ are none."""
    return any(m.group().isalpha() for m in _WORDLY.finditer(text))


def grams(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Buckets of all n-grams of the small-letter texts, an array for each length.

    An n-gram begins at each character; zeros follow the last ones.  The two
    zeros that stand after each text begin none (bucket ``BUCKETS``), so that no
    n-gram sees two texts.  The returned offsets say where each text begins.
    """
    small = [t.lower() for t in texts]
    offsets = np.cumsum([0, *(len(t) + 2 for t in small)])
    code = np.frombuffer("".join(t + "\0\0" for t in small).encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.concatenate([code, np.zeros(max(LENGTHS), np.uint32)])
    n, out, h = offsets[-1], [], np.zeros(offsets[-1], np.uint32)
    ends = offsets[1:, None] - np.array([2, 1])
    for i in range(max(LENGTHS)):
        h = (h ^ code[i : n + i]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        if i + 1 in LENGTHS:
            out.append((h >> np.uint32(7)) & np.uint32(BUCKETS - 1))
            out[-1][ends] = BUCKETS
    return out, offsets


def _chunks(texts: list) -> Iterator[list[int]]:
    """Indices of texts, in runs of about ``CHUNK`` characters."""
    run, size = [], 0
    for i, t in enumerate(texts):
        run.append(i)
        size += len(t or "")
        if size >= CHUNK:
            yield run
            run, size = [], 0
    if run:
        yield run


def train_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, bucket, n) over all rows that have both; bucket -1 counts documents."""
    base = docs.select(docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang")).where("text is not null and lang is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            texts, langs = b.column("text").to_pylist(), b.column("lang").to_pylist()
            for lang in set(langs):
                total = sums.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
                total[-1] += len(own)
                for run in _chunks(own):
                    for g in grams([own[i] for i in run])[0]:
                        total[:-1] += np.bincount(g, minlength=BUCKETS + 1)[:-1]
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(np.where(at == BUCKETS, -1, at).astype(np.int32)), pa.array(total[at])], ["lang", "bucket", "n"])

    parts = map_arrow(base, count, [("lang", "string"), ("bucket", "int"), ("n", "long")])
    return parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def identify_language(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Predict each text's language after learning from ``train`` (text, lang).

    Every training row is counted, on the executors; counts come to the driver
    by (language, bucket), at most ``BUCKETS`` for each of at most ``LANGUAGES``
    languages; more are a ValueError before anything is collected.  The matrix
    of log probabilities (languages by buckets) is broadcast; texts are scored
    in batches: look-ups by bucket, summed by text.

    Returns doc_id, lang_pred, score (the class's posterior probability).  A
    null text, or one without a letter, is ``und`` with score 0; so is every
    text if nothing could be learned.  Equal posteriors: the language that
    sorts first.  A row's result doesn't depend on the rows next to it.
    """
    spark, base = docs.sparkSession, narrowed(docs, id_col, text_col)
    counted = stored(train_counts(train), "language-counts")
    if counted.where("bucket < 0").count() > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    rows = counted.collect()
    discard(counted)
    langs = sorted({r[0] for r in rows})
    counts, seen = np.zeros((len(langs), BUCKETS)), np.zeros(len(langs))
    at = {x: i for i, x in enumerate(langs)}
    for lang, bucket, n in rows:
        if bucket < 0:
            seen[at[lang]] = n
        else:
            counts[at[lang], bucket] = n
    logs = np.log((counts + SMOOTHING) / (counts.sum(1, keepdims=True) + SMOOTHING * BUCKETS))
    logs = np.hstack([logs, np.zeros((len(langs), 1))])
    sent = spark.sparkContext.broadcast((langs, logs, np.log(seen / max(1, seen.sum()))))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, logs, prior = sent.value
        for b in batches:
            texts = b.column("text").to_pylist()
            named, sure = ["und"] * len(texts), [0.0] * len(texts)
            told = [i for i, t in enumerate(texts) if langs and t and has_letter(t)]
            for run in _chunks([texts[i] for i in told]):
                own = [told[i] for i in run]
                found, offsets = grams([texts[i] for i in own])
                sums = np.stack([sum(np.add.reduceat(log[g], offsets[:-1]) for g in found) + p for log, p in zip(logs, prior, strict=True)], 1)
                best = sums.argmax(1)
                posterior = 1 / np.exp(sums - sums.max(1, keepdims=True)).sum(1)
                for i, k, p in zip(own, best.tolist(), posterior.tolist(), strict=True):
                    named[i], sure[i] = langs[k], p
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(named, pa.string()), pa.array(sure, pa.float64())], ["doc_id", "lang_pred", "score"])

    return map_arrow(base, score, [("doc_id", id_type(base)), ("lang_pred", "string"), ("score", "double")])
