"""Toxicity by averaged subword embeddings under a softmax.

A word is the mean of the embeddings of itself and of its character n-grams; a document the mean of its words; a linear
softmax reads it. Embeddings and softmax are trained together, so an unseen misspelling gets most of the vector of the
word that it comes from. As everything above the embeddings is linear, a trained model is one number a word, and a
document's logit their mean.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordMemo, arrow_map, fold, kept_in_worker, split_words, spread_sample, text_bytes, text_slices

BUCKETS = 1 << 17
DIMENSIONS = 8
SHORTEST, LONGEST = 3, 5
#: Labelled documents of each class that are trained on, about, by smallest hash of the id; four times as many rows are
#: the bound of both, where ids are repeated.
SAMPLE_PER_CLASS = 1500
EPOCHS, BATCH, RATE, SEED = 6, 32, 0.05, 7
#: Parts of the sample. As many models are trained, each without one part, on which it is calibrated, and averaged.
FOLDS = 4
#: Documents' rates of telling words are hundredths; this brings them to the order of one.
SCALE = 20.0
#: Bytes that a worker's memory of words may take, and bytes of text that it cuts at a time.
MEMO_BYTES, SLICE_BYTES = 48 << 20, 1 << 21
# bytes that stand in words: letters, digits, the apostrophe and all beyond ASCII; others part them
IN_WORD = bytes(b if chr(b).isalnum() or b == 39 or b >= 128 else 32 for b in range(256))

NOT_IN_WORD = r"[^a-z0-9'\x{80}-\x{10FFFF}]+"


def words(text: bytes) -> list[bytes]:
    return text.lower().translate(IN_WORD).split()


def subwords(vocabulary: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of every word and of its n-grams of bytes, with its edges marked; and the words' number of them."""
    flat = np.frombuffer(b"".join(b"<" + w + b">" for w in vocabulary), np.uint8).astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in vocabulary], np.int64)
    word = np.repeat(np.arange(len(vocabulary)), lengths)
    ends = np.cumsum(lengths)
    left = ends[word] - np.arange(len(flat))  # bytes from here to the word's end
    buckets, owners = [], []
    h = np.zeros(len(flat), np.uint64)
    for n in range(1, LONGEST + 1):
        size = len(flat) - n + 1
        if size <= 0:
            break
        h = h[:size] * np.uint64(0x100000001B3) + flat[n - 1 :] + np.uint64(1)
        if n >= SHORTEST:
            ok = left[:size] >= n
            mixed = (h[ok] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
            buckets.append((mixed % np.uint64(BUCKETS)).astype(np.int32))
            owners.append(word[:size][ok])
    from xxhash import xxh32_intdigest

    buckets.append(np.array([xxh32_intdigest(w) % BUCKETS for w in vocabulary], np.int32))
    owners.append(np.arange(len(vocabulary)))
    owner, bucket = np.concatenate(owners), np.concatenate(buckets)
    order = np.argsort(owner, kind="stable")
    return bucket[order], np.bincount(owner, minlength=len(vocabulary))


def document_matrix(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets and weights of each document: mean over its words of the mean over their subwords, times SCALE."""
    out = []
    for text in texts:
        own, counts = np.unique(np.array(words(text) or [b""], object), return_counts=True)
        bucket, sizes = subwords(own.tolist())
        weight = np.repeat(counts / (counts.sum() * sizes), sizes)
        distinct, at = np.unique(bucket, return_inverse=True)
        out.append((distinct, (SCALE * np.bincount(at, weight)).astype(np.float32)))
    return out


class Model:
    """values[bucket]: what the bucket's embedding adds to the logit of toxic; scale and bias calibrate the mean."""

    def __init__(self, values: np.ndarray, scale: float, bias: float):
        self.values, self.scale, self.bias = values.astype(np.float32), scale, bias

    def word_values(self, vocabulary: list[bytes]) -> np.ndarray:
        bucket, sizes = subwords(vocabulary)
        return np.add.reduceat(self.values[bucket], np.cumsum(sizes) - sizes) / sizes

    def score(self, means: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * means + self.bias, -30, 30)))


def train(texts: list[bytes], toxic: np.ndarray, class_weight: np.ndarray, seed: int = SEED) -> Model:
    return train_rows(document_matrix(texts), toxic, class_weight, seed)


def gradients(e: np.ndarray, w: np.ndarray, bias: np.ndarray, bucket: np.ndarray, weight: np.ndarray, sizes: list[int], toxic: np.ndarray) -> tuple:
    """Mean cross-entropy of some documents, given as buckets and weights in a row, and its gradients by the embeddings of
    the buckets that they touch (with these), the softmax's weights and its bias."""
    n = len(sizes)
    starts = np.cumsum([0, *sizes])[:-1]
    hidden = np.add.reduceat(e[bucket] * weight[:, None], starts, axis=0)
    logits = hidden @ w + bias
    logits -= logits.max(axis=1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=1, keepdims=True)
    loss = -float(np.log(p[np.arange(n), toxic]).mean())
    p[np.arange(n), toxic] -= 1
    p /= n
    back = p @ w.T
    doc = np.repeat(np.arange(n), sizes)
    touched, inverse = np.unique(bucket, return_inverse=True)
    grad = np.stack([np.bincount(inverse, weight * back[doc, d], len(touched)) for d in range(e.shape[1])], axis=1).astype(e.dtype)
    return loss, touched, grad, hidden.T @ p, p.sum(axis=0)


def fitted_values(rows: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Adam over mini-batches on embeddings and softmax together; what each bucket's embedding adds to the logit of toxic."""
    e, w = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32), rng.normal(0, 0.5, (DIMENSIONS, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (e, w, bias)]
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            bucket = np.concatenate([rows[i][0] for i in pick])
            weight = np.concatenate([rows[i][1] for i in pick])
            _, touched, grad, by_w, by_bias = gradients(e, w, bias, bucket, weight, [len(rows[i][0]) for i in pick], toxic[pick])
            step += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for k, (value, g, index) in enumerate(((e, grad, touched), (w, by_w, slice(None)), (bias, by_bias, slice(None)))):
                m, v = state[k]
                m[index] = 0.9 * m[index] + 0.1 * g
                v[index] = 0.99 * v[index] + 0.01 * g * g
                value[index] -= rate * (m[index] / (1 - 0.9**step)) / (np.sqrt(v[index] / (1 - 0.99**step)) + 1e-6)
    return e @ (w[:, 1] - w[:, 0])


def train_rows(rows: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, class_weight: np.ndarray, seed: int = SEED) -> Model:
    """Models of FOLDS parts of the rows, each trained on the others, averaged at equal spread of their means on their own
    part; then a one-dimensional calibration of these means to the classes' weights."""
    rng = np.random.default_rng(seed)
    part = np.empty(len(rows), np.int64)
    part[rng.permutation(len(rows))] = np.arange(len(rows)) % FOLDS
    values, means = np.zeros(BUCKETS), np.zeros(len(rows))
    for k in range(FOLDS):
        fit, apart = np.flatnonzero(part != k), np.flatnonzero(part == k)
        if len(set(toxic[fit].tolist())) < 2 or not len(apart):
            fit = apart = np.arange(len(rows))
        own = fitted_values([rows[i] for i in fit], toxic[fit], rng)
        got = np.array([float(own[rows[i][0]] @ rows[i][1]) / SCALE for i in apart])
        spread = max(float(got.std()), 1e-9)
        values += own / spread / FOLDS
        means[apart] = got / spread
    # two-parameter logistic regression on the means, by Newton steps; classes count as often as in the table
    unit = max(float(means.std()), 1e-9)
    x = np.stack([means / unit, np.ones(len(means))], axis=1)
    theta, known, sample = np.zeros(2), toxic, class_weight[toxic]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        g = x.T @ (sample * (p - known)) + 1e-3 * theta
        h = (x * (sample * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        theta -= np.clip(np.linalg.solve(h, g), -2, 2)
    return Model(values, float(theta[0] / unit), float(theta[1]))


def learn(docs: DataFrame, labels: DataFrame, column: str = "toxic", per_class: int = SAMPLE_PER_CLASS) -> Model:
    """A model from a bounded sample of the labelled rows outside the held-out fold; without both classes, a constant."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").where(fold() != 0)
    counts = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    if len(counts) < 2:
        share = 0.01 if not counts else 0.99 if 1 in counts else 0.01
        return Model(np.zeros(BUCKETS), 0.0, float(np.log(share / (1 - share))))
    # about two classes x per_class ids
    sample = spread_sample(known, "y", counts, per_class).select("doc_id", "y")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    # buckets and weights go to the driver, not texts, and rows of repeated ids are bounded as well
    order = [F.xxhash64("doc_id", "text"), "doc_id", "y"]
    picked = arrow_map(texts.orderBy(*order).limit(4 * per_class).select("text", "y"), sampled, "bucket array<int>, weight array<float>, y int").toArrow()
    y = picked.column("y").to_numpy().astype(np.int64)
    seen = np.bincount(y, minlength=2)
    if not seen.all():
        share = min(max(counts[1] / sum(counts.values()), 0.01), 0.99)
        return Model(np.zeros(BUCKETS), 0.0, float(np.log(share / (1 - share))))
    weight = np.array([counts[0], counts[1]]) / seen
    rows = [(b.values.to_numpy(), w.values.to_numpy()) for b, w in zip(picked.column("bucket"), picked.column("weight"), strict=True)]
    return train_rows(rows, y, weight / weight.mean())


def sampled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in text_slices(whole, 0, SLICE_BYTES)):
        rows = document_matrix(text_bytes(batch.column(0)))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.float32())), batch.column(1)], names=["bucket", "weight", "y"])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of the whole text; a text without words has the score of the bias alone."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # a float a bucket
    name = uuid.uuid4().hex

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        memo = kept_in_worker(name, lambda: WordMemo(lambda v: [x.tobytes() for x in m.word_values(v).astype(np.float32)], MEMO_BYTES))
        for batch in (part for whole in batches for part in text_slices(whole, 1, SLICE_BYTES)):
            spaced = pc.replace_substring_regex(pc.ascii_lower(pc.fill_null(batch.column(1), "")), pattern=NOT_IN_WORD, replacement=" ")
            bounds, index, distinct = split_words(spaced)
            values = np.frombuffer(b"".join(memo.get(distinct)), np.float32).astype(np.float64)
            sums = np.r_[0.0, np.cumsum(values[index])]
            means = np.diff(sums[bounds]) / np.maximum(np.diff(bounds), 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(m.score(means), pa.float64())], names=["doc_id", "score"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, score double")


def score_documents(docs: DataFrame, labels: DataFrame, column: str = "toxic", threshold: float = 0.5) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted. Null texts count as empty, and an empty text has the score of
    the bias alone; texts may be of any length, and are cut into words whole; repeated rows, and rows of one id, are scored
    each by its text; a null id is scored, not learned from; labels that are null or neither 0 nor 1 are not learned from,
    and an id with both labels counts for both; an empty table gives no rows; further columns, of any name, are ignored."""
    scored = predict(docs, learn(docs, labels, column))
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
