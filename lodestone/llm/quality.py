"""Document quality: random-indexing word vectors and a small network over their mean."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.scratch import discard, id_type, map_arrow, narrowed, stored

#: Hash buckets of words, dimensions of their vectors, non-zero entries of an index vector.
BUCKETS, DIMENSIONS, ENTRIES = 1 << 15, 32, 4
#: Words to each side that a word's context vector sums.
REACH = 2
#: Labelled documents that the model is fitted on: at most so many, half of each class.
SAMPLE = 4000
HIDDEN, EPOCHS, SEED = 24, 400, 20
#: Numbers that describe a document: its mean word vector, and seven that `features` adds.
FEATURES = DIMENSIONS + 7
#: Tasks that read the sample; what they send to the driver is bounded by their number and the sample's.
TRAIN_TASKS = 8
#: Words whose contexts are summed together, and buckets in one range of sums.
TOGETHER, RANGE = 250_000, 1024
#: Words whose buckets a worker keeps, and their characters at most.
KEPT_WORDS, LONGEST_KEPT = 400_000, 64

_WORD = re.compile(r"\w+|[^\w\s]+")


class _Buckets(dict):
    def __missing__(self, word: str) -> int:
        n = zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS
        if len(word) <= LONGEST_KEPT:
            if len(self) > KEPT_WORDS:
                self.clear()
            self[word] = n
        return n


_BUCKETS = _Buckets()


def words_of(text: str) -> np.ndarray:
    """Buckets of a text's words and marks, in order."""
    found = _WORD.findall(text)
    return np.fromiter(map(_BUCKETS.__getitem__, found), np.int64, len(found))


def index_entries() -> tuple[np.ndarray, np.ndarray]:
    """(dimension, sign) of the few entries of each bucket's index vector, from the seed alone."""
    rng = np.random.default_rng(SEED)
    return rng.integers(0, DIMENSIONS, (BUCKETS, ENTRIES)), rng.choice([-1.0, 1.0], (BUCKETS, ENTRIES))


def index_vectors() -> np.ndarray:
    """Each bucket's sparse ternary vector."""
    at, sign = index_entries()
    out = np.zeros((BUCKETS, DIMENSIONS))
    np.add.at(out, (np.repeat(np.arange(BUCKETS), ENTRIES), at.ravel()), sign.ravel())
    return out


def context_sums(texts: list[np.ndarray]) -> np.ndarray:
    """For each bucket, the sum of the index vectors of its neighbours in the texts (whole numbers)."""
    (at, sign), out = index_entries(), np.zeros(BUCKETS * DIMENSIONS, np.int64)
    gap = np.full(REACH, -1)  # so that no word is the neighbour of another text's
    ids = np.concatenate([x for t in texts for x in (t, gap)]) if texts else gap
    for step in range(1, REACH + 1):
        both = (ids[step:] >= 0) & (ids[:-step] >= 0)
        right, left = ids[step:][both], ids[:-step][both]
        for word, near in ((right, left), (left, right)):
            for e in range(ENTRIES):
                out += np.bincount(word * DIMENSIONS + at[near, e], sign[near, e], minlength=len(out)).astype(np.int64)
    return out.reshape(BUCKETS, DIMENSIONS)


def corpus_contexts(texts: DataFrame) -> np.ndarray:
    """The context sums of all texts: summed in each task, then on the executors by ranges of buckets."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, n = np.zeros((BUCKETS, DIMENSIONS), np.int64), [], 0
        for b in batches:
            for t in b.column("text").to_pylist():
                words = words_of(t)
                for i in range(0, len(words), TOGETHER):  # a long text in pieces that share their borders
                    held.append(words[max(0, i - REACH) : i + TOGETHER])
                    if i:
                        total -= context_sums([words[max(0, i - REACH) : i]])
                    n += len(held[-1])
                    if n > TOGETHER:
                        total += context_sums(held)
                        held, n = [], 0
        total += context_sums(held)
        for k in range(0, BUCKETS, RANGE):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([total[k : k + RANGE].tobytes()], pa.binary())], ["first", "sums"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for b in batches:
            for k, part in zip(b.column("first").to_pylist(), b.column("sums").to_pylist(), strict=True):
                more = np.frombuffer(part, np.int64)
                totals[k] = totals[k] + more if k in totals else more
        for k, total in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["first", "sums"])

    fields = [("first", "int"), ("sums", "binary")]
    out = np.zeros((BUCKETS, DIMENSIONS), np.int64)
    for r in map_arrow(map_arrow(texts.select("text"), own, fields).repartition("first"), summed, fields).collect():  # 8 MB
        out[r["first"] : r["first"] + RANGE] = np.frombuffer(r["sums"], np.int64).reshape(-1, DIMENSIONS)
    return out


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """Each bucket's index vector and its context, scaled to length 1."""
    out = index_vectors() + sums
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-6)).astype(np.float32)


def features(text: str, vectors: np.ndarray) -> np.ndarray:
    """The mean of a text's word vectors, and what the mean loses: repetition, case, marks, length."""
    ids = words_of(text)
    n = max(1, len(ids))
    pooled = np.zeros(DIMENSIONS, np.float64)
    for i in range(0, len(ids), 100_000):
        pooled += vectors[ids[i : i + 100_000]].sum(0, dtype=np.float64)
    return np.concatenate(
        [
            pooled / n,
            [
                np.log1p(len(ids)) / 10,
                np.count_nonzero(np.bincount(ids)) / n,
                (ids[1:] == ids[:-1]).sum() / n,
                _capitals(text),
                len(text) / n / 10,
                text.count("\n") / n,
                float(len(ids) == 0),
            ],
        ]
    )


def _capitals(text: str) -> float:
    """The share of characters that small letters would change."""
    a, b = text.encode("utf-32-le", "surrogatepass"), text.lower().encode("utf-32-le", "surrogatepass")
    if len(a) != len(b) or not a:
        return sum(map(str.isupper, text)) / max(1, len(text))
    return float((np.frombuffer(a, np.uint32) != np.frombuffer(b, np.uint32)).mean())


@dataclass
class Model:
    """Standardisation, two layers and a temperature; ``constant`` where nothing could be fitted."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0
    constant: float | None = None

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, aside: np.ndarray) -> Model:
    """Gradient descent (Adam) on the rows not set ``aside``; the temperature from those."""
    empty = Model(*(np.zeros(0) for _ in range(5)), 0.0, 1.0, float((weight * y).sum() / weight.sum()) if len(y) else 0.5)
    fitted = ~aside
    if len(set(y[fitted].tolist())) < 2:
        return empty
    rng, mean, scale = np.random.default_rng(SEED), x[fitted].mean(0), x[fitted].std(0) + 1e-3
    m = Model(mean, scale, rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), 0.0)
    z, t, w = (x[fitted] - mean) / scale, y[fitted], weight[fitted] / weight[fitted].sum()
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (m.w1, m.b1, m.w2, np.zeros(1))]
    for step in range(1, EPOCHS + 1):
        h = np.tanh(z @ m.w1 + m.b1)
        error = w * (1 / (1 + np.exp(-np.clip(h @ m.w2 + m.b2, -60, 60))) - t)
        back = np.outer(error, m.w2) * (1 - h * h)
        grads = [z.T @ back + 1e-4 * m.w1, back.sum(0), h.T @ error + 1e-4 * m.w2, np.array([error.sum()])]
        moves = []
        for (a, b), g in zip(state, grads, strict=True):
            a[:] = 0.9 * a + 0.1 * g
            b[:] = 0.999 * b + 0.001 * g * g
            moves.append(0.02 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8))
        m.w1, m.b1, m.w2, m.b2 = m.w1 - moves[0], m.b1 - moves[1], m.w2 - moves[2], m.b2 - float(moves[3][0])
    if len(set(y[aside].tolist())) == 2:
        logit, t, w = m.logits(x[aside]), y[aside], weight[aside]
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 121))
        loss = [(w * (np.logaddexp(0, logit / g) - t * logit / g)).sum() for g in grid]
        m.temperature = float(grid[int(np.argmin(loss))])
    return m


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[np.ndarray, Model]:
    """Word vectors from all documents, and a model fitted on at most ``sample`` labelled ones.

    The sample is, of each class, the ids with the smallest hashes, the same for
    every layout of the tables; of rows that repeat an id, the one with the
    least text.  Whole texts are read, on the executors: sums of contexts (of a
    fixed size) and the sample's features come to the driver, no texts.  Rows
    are weighted back to the classes' shares among all labels.  Null ids and
    null texts aren't learned from.
    """
    known = labels.select(labels[id_col].alias("doc_id"), labels[label_col].cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"))
    shares = {r[0]: r[1] for r in known.groupBy("y").count().collect()}
    mark = F.xxhash64(F.col("doc_id").cast("string"))
    picked = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(mark, "doc_id").limit(sample // 2)
        picked = part if picked is None else picked.unionByName(part)
    base = narrowed(docs, id_col, text_col).where("text is not null")
    rows = base.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))  # `sample` ids at most
    rows = stored(rows.select("text", "y", F.pmod(mark, F.lit(5)).alias("fold")).repartition(TRAIN_TASKS), "labelled")
    vectors = word_vectors(corpus_contexts(base))
    sent = docs.sparkSession.sparkContext.broadcast(vectors)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [features(t, sent.value).tolist() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), b.column("y"), b.column("fold")], ["x", "y", "fold"])

    known_rows = sorted(map_arrow(rows, described, [("x", "array<double>"), ("y", "int"), ("fold", "long")]).collect(), key=lambda r: (r["fold"], r["y"], r["x"]))
    discard(rows)
    x = np.array([r["x"] for r in known_rows]).reshape(len(known_rows), FEATURES)
    y = np.array([r["y"] for r in known_rows], float)
    share = {k: shares[k] / max(1, (y == k).sum()) for k in shares}
    weight = np.array([share[k] for k in y.astype(int)])
    return vectors, fit(x, y, weight, np.array([r["fold"] == 0 for r in known_rows], bool))


def score_rows(docs: DataFrame, vectors: np.ndarray, model: Model, text_col: str = "text") -> DataFrame:
    """(row, score): each row as it is, in a struct, and the probability that its text has label 1.

    Null texts are scored as empty ones, which have features of their own.
    """
    base = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[text_col].cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast((vectors, model))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, model = sent.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("row"), _scores(b, vectors, model)], ["row", "score"])

    return map_arrow(base, scan, [("row", base.schema["row"].dataType), ("score", "double")])


def score_quality(docs: DataFrame, vectors: np.ndarray, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every document."""
    base = narrowed(docs, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast((vectors, model))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, model = sent.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), _scores(b, vectors, model)], ["doc_id", "score"])

    return map_arrow(base, scan, [("doc_id", id_type(base)), ("score", "double")])


def _scores(b: pa.RecordBatch, vectors: np.ndarray, model: Model) -> pa.Array:
    x = np.array([features(t or "", vectors) for t in b.column("text").to_pylist()]).reshape(b.num_rows, FEATURES)
    return pa.array(model.probabilities(x))
