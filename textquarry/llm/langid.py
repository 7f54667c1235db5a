"""Language identification as inference over a mixture of languages.

Each language has smoothed counts of byte trigrams, learned from labelled texts. Every word of a document gets a
likelihood in each language from its trigrams; expectation-maximisation then estimates in what proportions the languages
make up the document. Sets of its strongest languages are fitted so, of one, two and more, as long as the likelihood less a
penalty for each language rises; the last set is chosen, and its largest proportion names the document.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, fold, text_slices, text_strings

BUCKETS = 1 << 16
#: Labelled texts of each language that are learned from, about, by smallest hash of the id. A bound: more change little.
SAMPLE_PER_LANGUAGE = 600
ROUNDS = 8
#: Likelihoods (words x languages) that a worker has at a time, a text of more alone.
LIKELIHOODS = 1 << 19
UNDETERMINED = "und"
LETTER = re.compile(r"[^\W\d_]").search
# bytes that stand in words: a-z and all beyond ASCII; others become a space
IN_WORD = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram around every byte of a word, and where each word's begin (positions in the former)."""
    raw = np.frombuffer(b" " + text.lower().encode().translate(IN_WORD) + b" ", np.uint8)
    b = raw.astype(np.uint32)
    bucket = ((b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))) >> np.uint32(16)
    inside = raw[1:-1] != 32
    begins = inside & (raw[:-2] == 32)
    return bucket[inside], np.flatnonzero(begins[inside])


def has_letter(text: str) -> bool:
    """Whether any character is a letter; most texts are decided by their first."""
    found = LETTER(text)
    return found is not None and (found.group().isalpha() or any(map(str.isalpha, text)))


class Model:
    """Languages and the log-likelihood of each trigram bucket in each of them."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        smooth = counts + 0.1
        self.log = np.log(smooth / smooth.sum(axis=1, keepdims=True)).astype(np.float32).T.copy() if languages else np.zeros((BUCKETS, 0), np.float32)

    def likelihoods(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words x languages likelihoods scaled by each word's best, the log of that scale, and words in each text."""
        grams, begins, sizes, at = [], [], [], 0
        for t in texts:
            g, s = trigrams(t)
            grams.append(g)
            begins.append(s + at)
            sizes.append(len(s))
            at += len(g)
        starts = np.concatenate(begins) if begins else np.zeros(0, np.int64)
        if not len(starts):
            return np.zeros((0, len(self.languages)), np.float32), np.zeros(0, np.float32), np.array(sizes, np.int64)
        log = np.add.reduceat(self.log[np.concatenate(grams)], starts, axis=0)
        top = log.max(axis=1)
        return np.exp(log - top[:, None]), top, np.array(sizes, np.int64)


def fit(like: np.ndarray, starts: np.ndarray, doc: np.ndarray, sizes: np.ndarray, allowed: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """EM for all texts at once: proportions over the allowed languages, and the log-likelihood of each text."""
    share = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        weight = like * share[doc]
        weight /= np.maximum(weight.sum(axis=1, keepdims=True), 1e-30)
        share = np.add.reduceat(weight, starts, axis=0) / sizes[:, None]
    mixed = np.log(np.maximum((like * share[doc]).sum(axis=1), 1e-30))
    return share, np.add.reduceat(mixed, starts)


def fit_sets(like: np.ndarray, sizes: np.ndarray, penalty: float) -> np.ndarray:
    """Proportions of the languages in each text by its chosen set, 0 outside of it. sizes: words of each text, none 0."""
    count, rows = like.shape[1], np.arange(len(sizes))

    def fitted(at: np.ndarray, allowed: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
        """Of some texts."""
        n = sizes[at]
        starts = np.r_[0, np.cumsum(n)[:-1]]
        mine = like if len(at) == len(sizes) else like[np.repeat(np.isin(rows, at), sizes)]
        return fit(mine, starts, np.repeat(np.arange(len(at)), n), n.astype(np.float32), allowed, rounds)

    whole, _ = fitted(rows, np.ones((len(rows), count), np.float32))
    order = np.argsort(-whole, axis=1, kind="stable")
    best, chosen = np.full(len(rows), -np.inf), np.zeros((len(rows), count), np.float32)
    rising, k = rows, 1
    while len(rising) and k <= count:
        allowed = np.zeros((len(rising), count), np.float32)
        np.put_along_axis(allowed, order[rising, :k], 1, axis=1)
        share, log = fitted(rising, allowed, ROUNDS if k > 1 else 0)
        value = log - penalty * k * np.log(sizes[rising] + 1)
        better = value > best[rising]
        rising = rising[better]
        best[rising], chosen[rising] = value[better], share[better]
        k += 1
    return chosen


def identify(model: Model, texts: list[str], penalty: float = 2.0) -> tuple[list[str], np.ndarray, list[list[tuple[str, float]]]]:
    """Language, score and the chosen languages with their proportions of each text."""
    like, _, sizes = model.likelihoods(texts)
    names, scores, sets = [UNDETERMINED] * len(texts), np.zeros(len(texts)), [[] for _ in texts]
    rows = np.flatnonzero((sizes > 0) & np.array([has_letter(t) for t in texts], bool)) if texts else np.zeros(0, int)
    if not len(rows) or not model.languages:
        return names, scores, sets
    if len(rows) < (sizes > 0).sum():
        keep = np.repeat(np.isin(np.arange(len(texts)), rows), sizes)
        like = like[keep]
    chosen = fit_sets(like, sizes[rows], penalty)
    top = chosen.argmax(axis=1)
    for r, t, p in zip(rows.tolist(), top.tolist(), chosen, strict=True):
        names[r], scores[r] = model.languages[t], min(1.0, float(p[t]))
        sets[r] = sorted(((model.languages[j], float(p[j])) for j in np.flatnonzero(p > 0)), key=lambda x: -x[1])
    return names, scores, sets


def learn(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Trigram counts of a bounded sample of each language's rows outside the held-out fold; every label is a language, so
    the model has BUCKETS numbers for each."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null and doc_id is not null").where(fold() != 0)
    sizes = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}  # a row a language
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((0, BUCKETS)))
    scale = 1 << 40
    limits = docs.sparkSession.createDataFrame([(x, min(scale, -(-scale * per_language // n))) for x, n in sizes.items()], "lang string, most long")
    # a row a language; about so many languages x per_language ids go on
    texts = known.join(F.broadcast(limits), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < F.col("most")).select("lang", "text")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), text_strings(batch.column(1)), strict=True):
                found, n = np.unique(trigrams(text)[0], return_counts=True)
                total.setdefault(lang, np.zeros(BUCKETS, np.int64))[found] += n
        for lang, n in total.items():
            met = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(met), pa.string()), pa.array(met, pa.int32()), pa.array(n[met], pa.int64())], names=["lang", "bucket", "n"])

    # sparse rows, BUCKETS a language at most
    met = arrow_map(texts, count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(languages), BUCKETS))
    place = {x: k for k, x in enumerate(languages)}
    counts[[place[x] for x in met.column("lang").to_pylist()], met.column("bucket").to_numpy()] = met.column("n").to_numpy()
    return Model(languages, counts)


def text_runs(model: Model, texts: list[str]) -> Iterator[tuple[int, int]]:
    """Begin and end of runs of texts whose likelihoods are about LIKELIHOODS, at six characters a word."""
    most, at = 6 * LIKELIHOODS // max(len(model.languages), 1), 0
    while at < len(texts):
        end, load = at, 0
        while end < len(texts) and (end == at or load + len(texts[end]) <= most):
            load += len(texts[end])
            end += 1
        yield at, end
        at = end


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, languages): und with score 0 for a null text or one without a letter."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # languages x buckets, whatever the data

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in text_slices(whole, 1)):
            texts = text_strings(batch.column(1))
            for at, end in text_runs(shipped.value, texts):
                names, scores, sets = identify(shipped.value, texts[at:end])
                found = pa.array([[{"lang": k, "share": v} for k, v in s] for s in sets], pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), pa.array(names, pa.string()), pa.array(scores, pa.float64()), found], names=["doc_id", "lang_pred", "score", "languages"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, lang_pred string, score double, languages array<struct<lang: string, share: double>>")


def identify_documents(docs: DataFrame) -> DataFrame:
    """Learn from docs, then one row a document: doc_id, held_out, lang_pred, score, languages. A null text, an empty one and
    one without a letter are und with score 0; texts may be of any length and are read whole; repeated rows, and rows of one
    id, are scored each by its text; null ids are scored, not learned from; of languages that fit alike (ties) the first in
    order of their names is taken; an empty table gives no rows, and one without a label to learn from und throughout;
    further columns, of any name, are ignored."""
    return predict(docs, learn(docs)).select("doc_id", (fold() == 0).alias("held_out"), "lang_pred", "score", "languages")


def keep_identified(docs: DataFrame, least: float = 0.35) -> DataFrame:
    """docs without those that have no language: no letter, or no language that makes up `least` of the words. So null and
    empty texts go; repeated rows, and rows of null ids, stay or go by their texts, of any length; an empty table stays empty;
    columns of any name stay as they are. Without a label to learn from nothing has a language, and every row goes."""
    model = learn(docs)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    text_at = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in text_slices(whole, text_at)):
            texts = text_strings(batch.column(text_at))
            for at, end in text_runs(shipped.value, texts):
                names, scores, _ = identify(shipped.value, texts[at:end])
                ok = [n != UNDETERMINED and s >= least for n, s in zip(names, scores, strict=True)]
                yield batch.slice(at, end - at).filter(pa.array(ok, pa.bool_()))

    return arrow_map(docs, run, docs.schema)
