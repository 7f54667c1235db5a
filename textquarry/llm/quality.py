"""Quality by regularised quadratic discriminant analysis over transformed statistics of a document.

Each class has a mean and a covariance, shrunk towards the pooled covariance and towards a multiple of the identity; the
Cholesky factor of each is computed once. A document's score is the posterior of the log-density difference. The classes'
statistics are sums over all labelled rows outside the held-out fold, built by Spark.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, fold, materialise, text_bytes, text_slices, words_of

#: Shrinkage of each class's covariance to the pooled one, and of that to the identity times its mean variance.
TO_POOLED, TO_IDENTITY = 0.1, 0.01
FEATURES = ("length", "words", "word_length", "upper", "digit", "symbol", "stop", "other_punctuation", "newline", "distinct", "top_word", "repeats", "marked", "bytes_beyond_ascii")
SMALL = 0.002


def byte_class(chars: bytes) -> np.ndarray:
    out = np.zeros(256)
    out[list(chars)] = 1
    return out


CLASSES = np.stack(
    [
        byte_class(bytes(range(65, 91))),
        byte_class(bytes(range(48, 58))),
        byte_class(b"#$%&*+<=>@\\^_`{|}~[]/"),
        byte_class(b".,;:"),
        byte_class(b"!?\"'()-"),
        byte_class(b"\n"),
        byte_class(bytes(range(128, 256))),
        byte_class(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))),
    ],
    axis=1,
)
ENDS = frozenset(b"#$%&*|!")


def statistics(text: bytes) -> list[float]:
    """The statistics named in FEATURES: logarithms of sizes and of shares with a floor, so that they are closer to normal."""
    words = words_of(text)
    n = len(words)
    size = max(len(text), 1)
    upper, digit, symbol, stop, other, newline, high, letters = (np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ CLASSES).tolist()
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    repeats = sum(map(bytes.__eq__, words[1:], words[:-1])) if n > 1 else 0
    marked = sum(w[-1] in ENDS for w in words)
    share = lambda x, of: float(np.log(x / max(of, 1) + SMALL))
    return [
        float(np.log1p(len(text))),
        float(np.log1p(n)),
        float(np.log(len(text) / max(n, 1) + 1)),
        share(upper, letters),
        share(digit, size),
        share(symbol, size),
        share(stop, size),
        share(other, size),
        share(newline, size),
        # distinct words against what texts of the length have: the share alone falls with the length
        float(np.log((len(counts) + 1) / (n + 1) ** 0.8)),
        share(max(counts.values(), default=0), n),
        share(repeats, n),
        share(marked, n),
        share(high, size),
    ]


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, x) of every whole text; null as empty."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in text_slices(whole, 1)):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([statistics(t) for t in text_bytes(batch.column(1))], pa.list_(pa.float64()))], names=["doc_id", "x"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, x array<double>")


class Model:
    """Means, inverse Cholesky factors, log determinants and log priors of the classes 0 and 1."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]], to_pooled: float = TO_POOLED, to_identity: float = TO_IDENTITY):
        d = len(FEATURES)
        total = sum(m[0] for m in moments.values())
        self.prior = (moments.get(1, (0.0,))[0] + 0.5) / (total + 1)
        self.classes = None
        if len(moments) < 2:
            return
        means = {y: s / n for y, (n, s, _) in moments.items()}
        covs = {y: ss / n - np.outer(means[y], means[y]) for y, (n, _, ss) in moments.items()}
        pooled = sum(moments[y][0] * covs[y] for y in covs) / total
        self.unit = np.sqrt(np.maximum(np.diag(pooled), 1e-9))
        self.classes = []
        for y in (0, 1):
            c = ((1 - to_pooled) * covs[y] + to_pooled * pooled) / np.outer(self.unit, self.unit)
            c = (1 - to_identity) * c + to_identity * max(np.trace(c) / d, 1e-6) * np.eye(d)
            factor = np.linalg.cholesky(c)
            self.classes.append((means[y], np.linalg.inv(factor), 2 * float(np.log(np.diag(factor)).sum()), float(np.log(moments[y][0] / total))))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Posterior of class 1."""
        if self.classes is None or not len(x):
            return np.full(len(x), self.prior)
        log = []
        for mean, inverse, log_det, prior in self.classes:
            z = ((x - mean) / self.unit) @ inverse.T
            log.append(prior - 0.5 * (log_det + (z * z).sum(axis=1)))
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))


def learn(rows: DataFrame, labels: DataFrame, column: str = "quality") -> Model:
    """A model of rows (doc_id, x) whose label is 0 or 1 and whose id is outside the held-out fold."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").where(fold() != 0)
    d = len(FEATURES)
    sums = [F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(d)] + [F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"s{i}_{j}") for i in range(d) for j in range(i, d)]
    moments = {}
    for r in rows.join(known, "doc_id").groupBy("y").agg(F.count("*").alias("n"), *sums).collect():  # a row a class
        ss = np.zeros((d, d))
        for i in range(d):
            for j in range(i, d):
                ss[i, j] = ss[j, i] = r[f"s{i}_{j}"]
        moments[r.y] = (float(r.n), np.array([r[f"s{i}"] for i in range(d)]), ss)
    return Model(moments)


def score_documents(docs: DataFrame, labels: DataFrame, column: str = "quality", threshold: float = 0.3) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted. Null texts count as empty, and an empty text has a score of its
    own statistics; texts may be of any length and are read whole; repeated rows, and rows of one id, are scored each by its
    text, and each counts where its id is learned from; a null id is scored, not learned from; labels that are null or
    neither 0 nor 1 are not learned from; without labels of both classes the score is the share of 1; an empty table gives
    no rows; further columns, of any name, are ignored."""
    rows = materialise(features(docs), "features")
    shipped = docs.sparkSession.sparkContext.broadcast(learn(rows, labels, column))  # two matrices

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).flatten(), np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shipped.value.score(x), pa.float64())], names=["doc_id", "score"])

    return arrow_map(rows, run, "doc_id long, score double").select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
