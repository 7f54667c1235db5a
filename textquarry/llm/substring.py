r"""Exact substring dedup over windows of words.

Every window of `width` words gets a Rabin-Karp hash of 64 bits, the polynomial of its words' hashes, and 16 more bits of a
second polynomial; windows are equal if both are. All starts are hashed at once by doubling. A task keeps the first
occurrence of each window among its own, so a passage or copy met a million times is shipped once a task, and what
repeats in the task is shipped as intervals. Hashes travel in blocks of byte planes, dealt evenly by the hash; each
bucket of hashes finds the first occurrence over the corpus and reports all others, which merge into maximal intervals of
words to remove. Only texts that have such an interval are moved to meet it.

A row is known by its doc_id and, where rows share that, by the hash of its text; so rows of one id and different texts are
documents of their own, in order of that hash, and rows equal in both are one document.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import arrow_map, bloom_filter, even_keys, free_name, grouped, id_array, in_filter, materialise, null_ids, pack, parted, partitions, runs, spark_long_hash, text_bytes, text_slices, unpack, words_of

WIDTH = 20
BASE, CHECK_BASE = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1
#: Words whose windows a task sorts at a time, and windows of a bucket that are compared at a time.
CHUNK_WORDS, COMPARED = 1 << 18, 1 << 20
#: Repeated windows that a task holds before it reports them.
HELD_REPEATS = 1 << 21
#: Bits of the filters of repeated ids and of documents with intervals: fixed, however large the corpus; fuller filters only
#: make more rows carry a key, and more texts move.
FILTER_BITS = 1 << 23
#: Buckets of hashes for each partition, and bytes of text that a task splits at a time.
BUCKETS_EACH, SLICE_BYTES = 1, 1 << 21


def polynomial(words: np.ndarray, width: int, base: int) -> np.ndarray:
    """Sum of word x base^(place from the end), mod 2^64, mixed, of words[i:i+width] for every i that has so many."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total, covered, block, size = None, 0, words, 1
    need = width
    while need:
        if need & 1:
            part = block[covered : covered + n]
            total = part.copy() if total is None else total * np.uint64(pow(base, size, 1 << 64)) + part
            covered += size
        need >>= 1
        if need:
            block = block[:-size] * np.uint64(pow(base, size, 1 << 64)) + block[size:]
            size *= 2
    h = total ^ (total >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """The hash of every window."""
    return polynomial(words, width, BASE)


def window_checks(words: np.ndarray, width: int) -> np.ndarray:
    """16 bits of a second polynomial of every window."""
    return (polynomial(words, width, CHECK_BASE) >> np.uint64(48)).astype(np.uint16)


def row_key(text: bytes) -> int:
    """What tells rows of one doc_id apart: a hash of the text that is never 0."""
    return xxh64_intdigest(text, 11) | 1


def later_ones(h: np.ndarray, g: np.ndarray, doc: np.ndarray, key: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows are equal in (h, g) and ordered by (doc, key, start): the index of the first of each, in order of h, and the
    indices of those that come after one. A window that is there twice, of a repeated row, counts once."""
    order = np.argsort(h, kind="stable")
    if not len(order):
        return order, order
    same = h[order][1:] == h[order][:-1]
    several = np.r_[same, False] | np.r_[False, same]
    rest = order[several]
    rest = rest[np.lexsort((start[rest], key[rest], doc[rest], g[rest], h[rest]))]
    if not len(rest):
        return order, rest
    opens = np.r_[True, (h[rest][1:] != h[rest][:-1]) | (g[rest][1:] != g[rest][:-1])]
    lead = rest[np.maximum.accumulate(np.where(opens, np.arange(len(rest)), 0))]
    later = rest[(doc[rest] != doc[lead]) | (key[rest] != key[lead]) | (start[rest] != start[lead])]
    first = np.ones(len(h), bool)
    first[rest[~opens]] = False
    return order[first[order]], later


def merged(doc: np.ndarray, key: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """The intervals [start, end) of each (doc, key) as maximal ones, in order; what touches is one."""
    order = np.lexsort((start, key, doc))
    doc, key, start, end = doc[order], key[order], start[order], end[order]
    if not len(doc):
        return doc, key, start, end
    new = np.r_[True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])]
    # ends so far within a document: documents are set apart by more than any text is long
    apart = np.cumsum(new).astype(np.int64) << np.int64(33)
    reach = np.maximum.accumulate(end.astype(np.int64) + apart)
    opens = new | np.r_[True, start[1:].astype(np.int64) + apart[1:] > reach[:-1]]
    s = np.flatnonzero(opens)
    e = np.r_[s[1:], len(doc)] - 1
    return doc[s], key[s], start[s], (reach[e] - apart[e]).astype(end.dtype)


def keyed(docs: DataFrame) -> bytes:
    """A filter of the doc_ids that several rows have (null too): their rows carry the hash of their text."""
    ids = docs.groupBy(F.coalesce(F.col("doc_id").cast("long"), F.lit(np.iinfo(np.int64).min)).alias("id")).agg(F.count("*").alias("n")).where("n > 1")
    return bloom_filter(ids.select(F.xxhash64("id")), FILTER_BITS)


def row_keys(ids: np.ndarray, texts: list[bytes], repeated: bytes) -> np.ndarray:
    """0 for rows whose id no other row has; else their text's key."""
    out = np.zeros(len(ids), np.uint64)
    for k in np.flatnonzero(in_filter(spark_long_hash(ids), repeated)).tolist():
        out[k] = row_key(texts[k])
    return out


def pair_hash(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A hash of (doc, key)."""
    h = (doc.astype(np.uint64) ^ key * np.uint64(CHECK_BASE)) * np.uint64(BASE)
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


def dealt(h: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the keys a hash belongs to, by its leading bits."""
    return keys[((h >> np.uint64(32)) * np.uint64(len(keys)) >> np.uint64(32)).astype(np.int64)]


def blocks_by(bucket: np.ndarray, known: bool, packed, *arrays: np.ndarray) -> Iterator[tuple[int, bool, bytes]]:
    """Rows of each bucket, packed."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    for s, e in zip(*runs(bucket), strict=True):
        yield int(bucket[s]), known, packed(*(a[order[s:e]] for a in arrays))


def pack_windows(docs: np.ndarray, keys: np.ndarray):
    """Windows of rows of a chunk, in which they are numbers: a block has the rows that it needs once, then their places."""

    def packed(h: np.ndarray, g: np.ndarray, row: np.ndarray, start: np.ndarray) -> bytes:
        own, place = np.unique(row, return_inverse=True)
        table = pack(d=docs[own], k=keys[own])
        return struct.pack("<I", len(table)) + table + pack(h=h, g=g, r=place.astype(np.uint32), s=start)

    return packed


def unpack_windows(data: bytes) -> list[np.ndarray]:
    """(hash, check, doc, key, start) of a block."""
    size = struct.unpack_from("<I", data)[0]
    doc, key = unpack(data[4 : 4 + size], np.int64, np.uint64)
    h, g, row, start = unpack(data[4 + size :], np.uint64, np.uint16, np.uint32, np.uint32)
    return [h, g, doc[row], key[row], start]


def pack_intervals(doc: np.ndarray, key: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    return pack(d=doc, k=key, s=start, e=end)


BLOCK = "bucket int, known boolean, data binary"


def block_batch(rows: list[tuple[int, bool, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "known", "data"])


def window_blocks(docs: DataFrame, width: int, keys: np.ndarray, repeated, chunk_words: int = CHUNK_WORDS, hash_bits: int = 64) -> DataFrame:
    """(bucket, known, data): packed (hash, check, doc, key, start) of windows, and, known, packed intervals (doc, key, start,
    end) of windows that repeat others of their task."""

    def flush(rows: list[tuple[int, int, np.ndarray]]) -> Iterator[tuple[int, bool, bytes]]:
        n = np.array([len(w) - width + 1 for _, _, w in rows])
        # over all texts in a row; windows that reach into the next text are left out
        flat = np.concatenate([w for _, _, w in rows])
        ends = np.cumsum([len(w) for _, _, w in rows])
        start = np.arange(int(n.sum()), dtype=np.int64) - np.repeat(np.cumsum(n) - n, n)
        whole = start + np.repeat(np.r_[0, ends[:-1]], n)
        h, g = window_hashes(flat, width)[whole], window_checks(flat, width)[whole]
        if hash_bits < 64:
            h = h >> np.uint64(64 - hash_bits) << np.uint64(64 - hash_bits)
        start = start.astype(np.uint32)
        docs_, keys_ = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.uint64)
        row = np.repeat(np.arange(len(rows)), n)
        doc, key = docs_[row], keys_[row]
        first, later = later_ones(h, g, doc, key, start)
        yield from blocks_by(dealt(h[first], keys), False, pack_windows(docs_, keys_), h[first], g[first], row[first], start[first])
        if len(later):
            found = merged(doc[later], key[later], start[later], start[later] + np.uint32(width))
            yield from blocks_by(dealt(pair_hash(*found[:2]), keys), True, pack_intervals, *found)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, np.ndarray]] = []
        load = 0
        for batch in (part for whole in batches for part in text_slices(whole, 1, SLICE_BYTES)):
            ids, texts = id_array(batch.column(0)), text_bytes(batch.column(1))
            for i, k, t in zip(ids.tolist(), row_keys(ids, texts, repeated.value).tolist(), texts, strict=True):
                w = words_of(t)
                if len(w) >= width:
                    rows.append((i, k, np.fromiter(map(xxh64_intdigest, w, repeat(7)), np.uint64, len(w))))
                    load += len(w)
                if load >= chunk_words:
                    yield block_batch(list(flush(rows)))
                    rows, load = [], 0
        if rows:
            yield block_batch(list(flush(rows)))

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, BLOCK)


INTERVAL_TYPES = (np.int64, np.uint64, np.uint32, np.uint32)


def repeated_intervals(docs: DataFrame, width: int = WIDTH, repeated=None, chunk_words: int = CHUNK_WORDS, compared: int = COMPARED, hash_bits: int = 64) -> DataFrame:
    """(doc_id, row_key, starts, ends): maximal word intervals covered by windows that also start earlier (smaller doc_id,
    null smallest; of one id, smaller key; or the same document, earlier). Documents without such a window are absent.
    `repeated`: the broadcast filter of keyed(), where the caller has it."""
    n = partitions(docs.sparkSession)
    repeated = repeated or docs.sparkSession.sparkContext.broadcast(keyed(docs))
    keys = even_keys(n, BUCKETS_EACH)

    def found(packed: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
        """Repeats of a bucket, of which about `compared` windows are unpacked at a time: a range of the hash's lower bits,
        as its leading bits are alike. A packed window takes eight bytes at least."""
        passes = max(1, -(-sum(map(len, packed)) // (8 * compared)))
        for p in range(passes):
            parts = []
            for block in packed:
                arrays = unpack_windows(block)
                if passes > 1:
                    pick = ((arrays[0] & np.uint64(0xFFFFFFFF)) * np.uint64(passes) >> np.uint64(32)) == np.uint64(p)
                    arrays = [a[pick] for a in arrays]
                parts.append(arrays)
            h, g, doc, key, start = (np.concatenate([x[j] for x in parts]) for j in range(5))
            later = later_ones(h, g, doc, key, start)[1]
            if len(later):
                yield merged(doc[later], key[later], start[later], start[later] + np.uint32(width))

    def repeats(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def out() -> pa.RecordBatch:
            doc, key, start, end = merged(*(np.concatenate([x[j] for x in held]) for j in range(4)))
            return block_batch(list(blocks_by(dealt(pair_hash(doc, key), keys), True, pack_intervals, doc, key, start, end)))

        for _, rows in grouped(batches):
            held += [tuple(unpack(r[2], *INTERVAL_TYPES)) for r in rows if r[1]]
            if fresh := [r[2] for r in rows if not r[1]]:
                held += found(fresh)
            # a task reports what it has found once, or whenever it holds this much
            if sum(len(x[0]) for x in held) >= HELD_REPEATS:
                yield out()
                held = []
        if held:
            yield out()

    def intervals(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches):
            parts = [unpack(r[2], *INTERVAL_TYPES) for r in rows]
            doc, key, start, end = merged(*(np.concatenate([p[j] for p in parts]) for j in range(4)))
            new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])])
            offsets = pa.array(np.r_[new, len(doc)], pa.int32())
            yield pa.RecordBatch.from_arrays([null_ids(doc[new]), pa.array(key[new].view(np.int64)), pa.ListArray.from_arrays(offsets, pa.array(start.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(end.astype(np.int32)))], names=["doc_id", "row_key", "starts", "ends"])

    blocks = window_blocks(docs, width, keys, repeated, chunk_words, hash_bits).repartition(n, "bucket").sortWithinPartitions("bucket")
    reported = arrow_map(blocks, repeats, BLOCK)
    return arrow_map(reported.repartition(n, "bucket").sortWithinPartitions("bucket"), intervals, "doc_id long, row_key long, starts array<int>, ends array<int>")


def with_intervals(docs: DataFrame, width: int = WIDTH, then=None, schema: str | None = None, **options) -> tuple[DataFrame, DataFrame, str, str]:
    """The rows of docs without a word to remove (as `then` makes them); those with some, beside their intervals; and the names
    of the two columns that hold these. A fixed-size filter parts them, so that only texts with intervals (and the few that
    the filter takes for such) are moved; of the moved ones, those without have null intervals."""
    context = docs.sparkSession.sparkContext
    repeated = context.broadcast(keyed(docs))  # FILTER_BITS
    found = materialise(repeated_intervals(docs, width, repeated, **options), "intervals")
    of_intervals = lambda batch: pair_hash(id_array(batch.column(0)), batch.column(1).to_numpy().view(np.uint64))
    touched = context.broadcast(bloom_filter(found.select("doc_id", "row_key"), FILTER_BITS, of_intervals))
    id_at, text_at = docs.columns.index("doc_id"), docs.columns.index("text")
    starts, ends, own, key = (free_name(docs, x) for x in ("starts", "ends", "interval_doc", "row_key"))

    def of_rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        ids = id_array(batch.column(id_at).cast(pa.int64()))
        keys = row_keys(ids, text_bytes(batch.column(text_at)), repeated.value)
        return pair_hash(ids, keys), keys

    clean, moved = parted(docs, of_rows, touched, key, then, schema)
    # by shuffle at any size, so that plans do not change with the size; keys part the rows of one id
    met = moved.join(found.toDF(own, f"{own}_key", starts, ends).hint("merge"), moved["doc_id"].cast("long").eqNullSafe(F.col(own)) & (F.col(key) == F.col(f"{own}_key")), "left")
    return clean, met.drop(own, f"{own}_key", key), starts, ends


def kept_words(words: list[bytes], starts: list[int] | None, ends: list[int] | None) -> list[bytes]:
    if not starts:
        return words
    out, at = [], 0
    for s, e in zip(starts, ends, strict=True):
        out += words[at:s]
        at = max(at, e)
    return out + words[at:]


def substring_digest(docs: DataFrame, width: int = WIDTH, **options) -> DataFrame:
    """One row a document: doc_id, n_words, n_removed, kept_sha256. Null and empty texts have no words; texts may be of any
    length; an empty table gives no rows; further columns, of any name, are ignored. Equal windows (ties) go by the order of
    doc_id, null first, then of the text's hash, then of the start; rows equal in id and text are one document and get
    equal results, and rows of one id with different texts are documents of their own."""

    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        total, gone, sha = [], [], []
        none = [None] * len(batch)
        starts, ends = (batch.column(2).to_pylist(), batch.column(3).to_pylist()) if batch.num_columns > 2 else (none, none)
        for t, s, e in zip(text_bytes(batch.column(1)), starts, ends, strict=True):
            words = words_of(t)
            kept = kept_words(words, s, e)
            total.append(len(words))
            gone.append(len(words) - len(kept))
            sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    clean, met, starts, ends = with_intervals(source, width, digest, schema, **options)
    return clean.union(arrow_map(met.select("doc_id", "text", starts, ends), lambda batches: (digest(part) for whole in batches for part in text_slices(whole, 1)), schema))


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs with the repeated words cut out of text, kept words joined by one space, and n_chars set to the new length
    where that column is there. Texts without a repeated window stay as they are, to the byte, null and empty ones too; other
    columns, of any name, as well. Texts may be of any length; an empty table stays empty; order among equal windows and
    rows of one id are as in substring_digest."""
    source = docs.withColumn("text", F.col("text").cast("string"))
    clean, met, starts, ends = with_intervals(source, width)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index("text")
            texts = batch.column(k).to_pylist()
            for i, (s, e) in enumerate(zip(batch.column(starts).to_pylist(), batch.column(ends).to_pylist(), strict=True)):
                if s:
                    texts[i] = b" ".join(kept_words(words_of(texts[i].encode()), s, e)).decode()
            yield batch.set_column(k, batch.schema.field(k), pa.array(texts, batch.schema.field(k).type))

    out = arrow_map(met, run, met.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(starts).isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return clean.select(docs.columns).union(out.select(docs.columns))
