"""Quality scores: kernel ridge regression on document statistics, calibrated.

Whole texts become ``len(STATISTICS)`` numbers. Random Fourier features, cos(Wz + b) of the
standardised numbers z, approximate a Gaussian kernel. Each task of the sample sums its part of the
normal equations; the sums (``FEATURES`` squared, whatever the rows) meet on the driver, which solves
for ridge weights. Rows kept from that fit give an isotonic curve from raw scores to probabilities.

The model learns from a bounded sample of labelled rows (``labelled.SAMPLE_ROWS``) that leaves out
held-out ids; everything else is scored, whole text by whole text.

Edge cases: null and empty texts are scored by their statistics, all 0; texts of any length are read
whole; a null doc_id is kept, its held_out is null; repeated rows get the same score each; rows of equal
raw score share one probability; extra columns are ignored (score() and keep() hand them on); an empty table of documents gives an empty
result; without labels of both kinds every score is the share of label 1, or 0.5 without labels.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.llm import labelled, scratch
from inkwell.llm.batches import held_out, slices, texts

STATISTICS = ("lower", "upper", "digit", "space", "newline", "stop", "bracket", "symbol", "other", "log_words", "word_mean", "word_sd", "distinct", "top", "repeats", "marked", "shouted", "lines", "line_distinct", "line_end", "pairs")
FEATURES = 320
RIDGE = 1e-3
#: Inverse width of the kernel, in units of one over the root of the number of statistics.
BANDWIDTH = 0.5
#: Standard deviations beyond which a statistic counts no further, so that no text is far from all that was learnt from.
REACH = 4.0
SEED = 20_240_501
#: A document of predicted quality has at least this score.
THRESHOLD = 0.3
#: Tasks that sum normal equations; each sends FEATURES squared numbers.
SUM_TASKS = 8

_CLASS = np.full(256, 8, np.uint8)
for _i, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\x0b\x0c", "\n", ".,;:?'-", "()[]{}<>/\"", "!#$%&*+=@\\^_`|~")):
    for _c in _chars:
        _CLASS[ord(_c)] = _i
_SYMBOLS = frozenset("!#$%&*+=@\\^_`|~")


def statistics(text: str) -> list[float]:
    """The numbers of a whole text, named in STATISTICS."""
    data = text.encode()
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    kinds = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=9)[:9] / len(data)
    sizes = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    marked = sum(c for w, c in counts.items() if w[-1] in _SYMBOLS)
    shouted = sum(c for w, c in counts.items() if len(w) > 1 and w.isupper())
    lines = [x for x in text.split("\n") if x.strip()]
    pairs = len(set(zip(words, words[1:], strict=False))) / (n - 1) if n > 1 else 1.0
    return [
        *kinds.tolist(), float(np.log1p(n)), min(float(sizes.mean()), 40.0), min(float(sizes.std()), 40.0), len(counts) / n, max(counts.values()) / n,
        sum(map(eq, words, words[1:])) / n, marked / n, shouted / n, float(np.log1p(len(lines))), len(set(lines)) / len(lines), sum(x.rstrip()[-1] in ".!?:" for x in lines) / len(lines), pairs,
    ]


def _matrix(given: list[str]) -> np.ndarray:
    return np.array([statistics(t) for t in given], np.float64).reshape(-1, len(STATISTICS))


class Model:
    """Standardisation, random features, ridge weights and the calibration curve."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        d = len(STATISTICS)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(0, BANDWIDTH / np.sqrt(d), (d, FEATURES))
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros(FEATURES + 1)
        self.curve = (np.array([0.0, 1.0]), np.array([0.5, 0.5]))

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -REACH, REACH)
        return np.hstack([np.cos(z @ self.w + self.b) * np.sqrt(2 / FEATURES), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        # The curve is flat in places; a hundredth of the raw score keeps the order there.
        return np.clip(0.99 * np.interp(raw, *self.curve) + 0.01 / (1 + np.exp(-8 * (raw - 0.5))), 0, 1)


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the ends of the pools by raw score, and their shares of label 1. Equal raw scores are one pool."""
    scores, place = np.unique(raw, return_inverse=True)
    pools: list[list[float]] = []  # sum, count, first and last raw score
    for r, v, n in zip(scores.tolist(), np.bincount(place, y).tolist(), np.bincount(place).tolist(), strict=True):
        pools.append([v, n, r, r])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s, n, _, last = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + n, pools[-1][2], last]
    xs = np.array([x for p in pools for x in (p[2], p[3])])
    ys = np.array([p[0] / p[1] for p in pools for _ in (0, 1)])
    xs, first = np.unique(xs, return_index=True)
    return xs, ys[first]


def _sums(model: Model | None):
    """Sums over a task's rows: of x and its square first, then, given a model, of the normal equations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(STATISTICS) if model is None else FEATURES + 1
        a, b, n = np.zeros((d, d)) if model else np.zeros(d), np.zeros(d), 0
        for batch in slices(batches):
            x, y = _matrix(texts(batch["text"])), np.array(batch["y"].to_pylist(), np.float64)
            if model is None:
                a, b = a + (x**2).sum(0), b + x.sum(0)
            else:
                phi = model.features(x)
                a, b = a + phi.T @ phi, b + phi.T @ y
            n += len(y)
        yield pa.RecordBatch.from_pydict({"a": [a.tobytes()], "b": [b.tobytes()], "n": [n]})

    return run


def fit(sample: DataFrame) -> Model:
    """A model from (text, y, part): parts 1 to 3 for the weights, part 0 for the calibration."""
    shown = sample.groupBy("y").count().collect()
    counts = {r["y"]: r["count"] for r in shown}
    if len(counts) < 2:
        model = Model(np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)))
        share = float(next(iter(counts))) if counts else 0.5
        model.curve = (np.array([0.0, 1.0]), np.array([share, share]))
        return model
    learn = sample.where("part > 0").repartition(SUM_TASKS)
    rows = learn.mapInArrow(_sums(None), "a binary, b binary, n bigint").collect()
    n = max(1, sum(r["n"] for r in rows))
    mean = sum(np.frombuffer(r["b"]) for r in rows) / n
    scale = np.sqrt(np.maximum(sum(np.frombuffer(r["a"]) for r in rows) / n - mean**2, 1e-8))
    model = Model(mean, np.maximum(scale, 1e-3))
    rows = learn.mapInArrow(_sums(model), "a binary, b binary, n bigint").collect()
    a = sum(np.frombuffer(r["a"]) for r in rows).reshape(FEATURES + 1, -1)
    model.weights = np.linalg.solve(a + RIDGE * np.eye(FEATURES + 1), sum(np.frombuffer(r["b"]) for r in rows))

    def raws(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_pydict({"raw": model.raw(_matrix(texts(b["text"]))), "y": b["y"]})

    kept = sample.where("part = 0").mapInArrow(raws, "raw double, y int").collect()
    if kept:
        model.curve = isotonic(np.array([r["raw"] for r in kept]), np.array([float(r["y"]) for r in kept]))
    return model


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from a bounded sample of the labelled documents that aren't held out."""
    sample = labelled.sample(docs, labels, "quality")
    model = fit(sample)
    scratch.drop(sample)
    return model


def score(docs: DataFrame, model: Model, name: str = "quality_score") -> DataFrame:
    """docs with a column ``name`` (in place of one that has this name), whatever other columns there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield b.append_column(name, pa.array(model.score(_matrix(texts(b["text"]))), pa.float64()))

    plain = docs.drop(name)
    return plain.mapInArrow(run, T.StructType([*plain.schema.fields, T.StructField(name, T.DoubleType())]))


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier doesn't reject, with the columns of docs."""
    model = learn(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield b.filter(pa.array(model.score(_matrix(texts(b["text"]))) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op1: all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            scores = model.score(_matrix(texts(b["text"])))
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array([held_out(i) for i in b["doc_id"].to_pylist()], pa.bool_()), pa.array(scores, pa.float64()), pa.array((scores >= THRESHOLD).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    return docs.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")
