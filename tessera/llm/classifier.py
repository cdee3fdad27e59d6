"""Text quality by ordinal cumulative-link regression.

Grades 0 < 1 < ... < K share one weight for each hashed feature of the text, and ordered
thresholds part them: P(grade > k) = sigmoid(score - threshold_k). The model is
fitted on a bounded sample of labelled documents and gives every document its expected
grade and the probability of its upper grades, by which documents are selected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import as_id, slices

BITS = 18
PER_WORD = 4
SAMPLE = 6000  # labelled documents that the model is fitted on, at most
STEPS, RATE, PENALTY = 150, 0.1, 1e-4
LEAST_DOCS, LEAST_Z = 5, 4.5
ACCEPT = 0.4  # least probability of the highest grade
SHAPES = [(re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"\d+"), b"0")]


PLAIN = re.compile(rb"A?a?[.,;:!?]?")


def _hash(feature: bytes) -> int:
    return xxhash.xxh3_64_intdigest(feature) & (1 << BITS) - 1


class Features:
    """Hashed features of a text: its words, their beginnings, and their shapes."""

    def __init__(self, most: int = 300_000):
        self.most = most
        self._forget()

    def _forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.table = np.zeros((1 << 14, PER_WORD), np.int32)
        self.odd = np.zeros(1 << 14, bool)

    def _learn(self, word: bytes) -> int:
        n = len(self.number)
        if n == len(self.table):
            self.table = np.concatenate((self.table, np.zeros_like(self.table)))
            self.odd = np.concatenate((self.odd, np.zeros_like(self.odd)))
        shape = word
        for pattern, mark in SHAPES:
            shape = pattern.sub(mark, shape)
        low = word.lower().strip(b".,;:!?\"'()")
        self.table[n] = [_hash(k) for k in (b"w" + low, b"4" + low[:4], b"6" + low[:6], b"s" + shape)]
        self.odd[n] = PLAIN.fullmatch(shape) is None
        self.number[word] = n
        return n

    def of(self, text: str | None) -> np.ndarray:
        """The distinct features of a text; none if it is null or has no words."""
        words = (text or "").encode().split()
        if not words:
            return np.empty(0, np.int32)
        if len(self.number) > self.most:
            self._forget()
        get, learn = self.number.get, self._learn
        rows = np.fromiter([n if (n := get(w)) is not None else learn(w) for w in words], np.int64, len(words))
        distinct = np.unique(rows)
        size = min(len(words).bit_length(), 12)
        fresh, odd = 10 * len(distinct) // len(words), int(10 * self.odd[rows].mean())
        again = int(10 * (rows[1:] == rows[:-1]).mean()) if len(rows) > 1 else 0
        return np.unique(np.append(self.table[distinct], [_hash(b"fresh %d %d" % (size, fresh)), _hash(b"odd %d" % odd), _hash(b"again %d" % again)]))


class Model:
    """Weights of the features and the thresholds between grades."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def scores(self, features: list[np.ndarray]) -> np.ndarray:
        return np.array([self.weights[f].sum(dtype=np.float64) for f in features])

    def tails(self, features: list[np.ndarray]) -> np.ndarray:
        """P(grade > k) for each k, a row for each text."""
        return 1 / (1 + np.exp(-(self.scores(features)[:, None] - self.thresholds[None, :])))


def _telling(flat: np.ndarray, grade: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Features whose documents' grades differ from the sample's by LEAST_Z standard errors or more."""
    size = 1 << BITS
    count = np.bincount(flat, minlength=size)
    out = np.zeros(size, bool)
    for g, p in enumerate(share):
        if 0 < p < 1:
            of = np.bincount(flat[grade == g], minlength=size)
            out |= np.abs(of - count * p) >= LEAST_Z * np.sqrt(np.maximum(count * p * (1 - p), 1))
    return out & (count >= LEAST_DOCS)


def objective(params: np.ndarray, size: int, flat: np.ndarray, row: np.ndarray, grades: np.ndarray, levels: int) -> tuple[float, np.ndarray]:
    """(mean of -log P(grade) and the penalty, its gradient) of ``size`` weights, the first threshold, and the logs of the gaps to the next ones.

    ``flat`` and ``row`` list the features of all examples and the example of each.
    """
    w, first, gaps = params[:size], params[size], params[size + 1 :]
    weight = 1 / max(1, len(grades))
    thresholds = first + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))
    score = np.bincount(row, w[flat], len(grades))
    edges = np.concatenate(([-np.inf], thresholds, [np.inf]))
    upper, lower = score - edges[grades], score - edges[grades + 1]
    p, q = 1 / (1 + np.exp(-np.clip(upper, -50, 50))), 1 / (1 + np.exp(-np.clip(lower, -50, 50)))
    p, q = np.where(grades == 0, 1.0, p), np.where(grades == levels - 1, 0.0, q)
    chance = np.maximum(p - q, 1e-9)
    dp, dq = p * (1 - p) / chance, q * (1 - q) / chance
    to_weights = np.bincount(flat, -weight * (dp - dq)[row], size) + PENALTY * w
    by_threshold = np.zeros(levels - 1)
    inner = grades > 0
    np.add.at(by_threshold, grades[inner] - 1, weight * dp[inner])
    inner = grades < levels - 1
    np.add.at(by_threshold, grades[inner], -weight * dq[inner])
    tail = np.cumsum(by_threshold[::-1])[::-1]
    loss = -weight * np.log(chance).sum() + PENALTY * (w * w).sum() / 2
    return float(loss), np.concatenate((to_weights, [tail[0]], tail[1:] * np.exp(gaps)))


def fit(features: list[np.ndarray], grades: np.ndarray, levels: int) -> Model:
    """Maximum likelihood with an L2 penalty, by Adam over all examples.

    Thresholds are a first one plus exponentials, so they stay in order. Only features that
    tell grades apart by themselves have weights, so that other words stay neutral.
    """
    n = np.array([len(f) for f in features], np.int64)
    flat = np.concatenate(features) if len(features) else np.empty(0, np.int64)
    row = np.repeat(np.arange(len(n)), n)
    telling = _telling(flat, grades[row], np.bincount(grades, minlength=levels) / max(1, len(n)))
    row, flat = row[telling[flat]], flat[telling[flat]]
    used, flat = np.unique(flat, return_inverse=True)
    params = np.concatenate((np.zeros(len(used)), [1.0 - levels], np.zeros(max(0, levels - 2))))
    m, v = np.zeros_like(params), np.zeros_like(params)
    size = len(used)
    for t in range(1, STEPS + 1):
        _, gradient = objective(params, size, flat, row, grades, levels)
        m = 0.9 * m + 0.1 * gradient
        v = 0.999 * v + 0.001 * gradient**2
        params = params - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = params[:size]
    gaps = params[size + 1 :]
    return Model(weights, params[size] + np.concatenate(([0.0], np.cumsum(np.exp(gaps)))))


def grade(quality: Column, toxic: Column) -> Column:
    """0: toxic, 1: of low quality, 2: good; null if both are unknown."""
    return F.when(toxic == 1, 0).when(quality == 0, 1).when(quality.isNotNull(), 2)


def train(docs: DataFrame, grades: DataFrame, levels: int = 3, *, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Fit a model on the documents of ``grades`` (doc_id, grade).

    At most ``sample`` labelled documents are used, those whose doc_id hashes lowest; the
    whole text of each is. A doc_id that repeats has its lowest grade, and of its texts the least. Null grades
    and ids, and labels without a document, are left out. Without any label left the model has no
    weights and accepts all. The fit runs in one task on the features of the sample.
    """
    known = grades.select(F.col("doc_id").cast("long").alias("id"), F.col("grade").cast("int").alias("grade")).where(f"id is not null and grade between 0 and {levels - 1}")
    chosen = known.groupBy("id").agg(F.min("grade").alias("grade")).orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(as_id(docs, id_col).alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    feature_schema = pa.schema([("grade", pa.int32()), ("features", pa.list_(pa.int32()))])
    model_schema = pa.schema([("used", pa.binary()), ("weights", pa.binary()), ("thresholds", pa.binary())])

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in slices(batches, "text"):
            rows = [features.of(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("grade"), pa.array(rows, pa.list_(pa.int32()))], schema=feature_schema)

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, marks = [], []
        for batch in batches:
            lists = batch.column("features")
            ends = lists.offsets.to_numpy()
            flat = lists.values.to_numpy()
            rows += [flat[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]
            marks.append(batch.column("grade").to_numpy())
        model = fit(rows, np.concatenate(marks).astype(np.int64) if marks else np.empty(0, np.int64), levels)
        used = np.flatnonzero(model.weights).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (used, model.weights[used], model.thresholds)], schema=model_schema)

    # of bounded size by ``sample``
    labelled = texts.join(F.broadcast(chosen), "id").groupBy("id", "grade").agg(F.min("text").alias("text"))
    labelled = labelled.select("grade", "text").mapInArrow(featurise, "grade int, features array<int>")
    row = labelled.repartition(1).mapInArrow(fitted, "used binary, weights binary, thresholds binary").first()
    weights = np.zeros(1 << BITS, np.float32)
    if row is None:
        return fit([], np.empty(0, np.int64), levels)
    weights[np.frombuffer(row["used"], np.int32)] = np.frombuffer(row["weights"], np.float32)
    return Model(weights, np.frombuffer(row["thresholds"], np.float64))


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, expected_grade, tail), a row for each row of ``docs``.

    ``tail`` is the probability of the highest grade. A null or empty text has no features,
    so it gets what the thresholds alone give. Rows are independent, so repeated
    or null ids don't matter. Other columns are not read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("expected_grade", pa.float64()), ("tail", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in slices(batches, "text"):
            tails = model.tails([features.of(t) for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(tails.sum(1)), pa.array(tails[:, -1].copy())], schema=schema)

    texts = docs.select(as_id(docs, id_col).alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id bigint, expected_grade double, tail double")


def select(docs: DataFrame, model: Model, *, text_col: str = "text", accept: float = ACCEPT) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose probability of the highest grade is ``accept`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in slices(batches, text_col):
            tails = model.tails([features.of(t) for t in batch.column(text_col).to_pylist()])
            yield batch.filter(pa.array(tails[:, -1] >= accept))

    return docs.mapInArrow(run, docs.schema)
