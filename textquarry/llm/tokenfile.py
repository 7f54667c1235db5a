"""Token-id files of directly addressable codes.

An id is cut into chunks of eight bits. Level k holds the k-th chunk of every id that has one, and a bitmap that tells
which of them goes on to the next level; a directory of ranks, one a block of 512 bits, turns a place in one level into
its place in the next in constant time. So any token is read without decoding its neighbours. A file is a sequence of
segments, each a row with its ids, its documents and the place of its first token, in ascending doc_id order.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WordMemo, arrow_map, gather, id_array, kept_in_worker, null_ids, partitions, shared_dir, split_words, text_slices

MAGIC = b"TQDAC1\0\0"
BLOCK = 512
SEGMENT_TOKENS = 1 << 20
#: Bytes that a worker's memory of words and their ids may take; it starts anew beyond that.
MEMO_BYTES = 192 << 20
END_ID = 2
#: Pieces that the library encodes in one call.
ENCODED = 4096
#: Text that a worker splits at a time; arrays over its words are several times as large.
SLICE_BYTES = 1 << 22


def dac_encode(ids: np.ndarray) -> bytes:
    """Levels of (bytes, continuation bitmap, rank directory) of unsigned ids."""
    out, rest = [], np.ascontiguousarray(ids)
    out.append(struct.pack("<Q", len(rest)))
    while len(rest):
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        padded = np.zeros(-(-len(rest) // BLOCK) * BLOCK, np.uint8)
        padded[: len(rest)] = more
        ones = padded.reshape(-1, BLOCK).sum(axis=1, dtype=np.uint64)
        ranks = np.r_[np.uint64(0), np.cumsum(ones)[:-1]].astype(np.uint32)
        out += [struct.pack("<Q", len(rest)), (rest & 255).astype(np.uint8).tobytes(), bits.tobytes(), ranks.tobytes()]
        rest = rest[more] >> 8
    return b"".join([*out, struct.pack("<Q", 0)])


class Dac:
    """Reader of dac_encode's bytes."""

    def __init__(self, data: bytes):
        self.length = struct.unpack_from("<Q", data, 0)[0]
        self.levels, at = [], 8
        while n := struct.unpack_from("<Q", data, at)[0]:
            at += 8
            low = np.frombuffer(data, np.uint8, n, at)
            bits = np.frombuffer(data, np.uint8, -(-n // 8), at := at + n)
            ranks = np.frombuffer(data, np.uint32, -(-n // BLOCK), at := at + len(bits))
            at += ranks.nbytes
            self.levels.append((low, bits, ranks))

    def __len__(self) -> int:
        return self.length

    def __getitem__(self, i: int) -> int:
        """The i-th id, by one look a level."""
        if not 0 <= i < self.length:
            raise IndexError(i)
        value, shift = 0, 0
        for low, bits, ranks in self.levels:
            value |= int(low[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK
            inside = np.unpackbits(bits[block * BLOCK // 8 : (i >> 3) + 1], bitorder="little")[: i - block * BLOCK]
            i, shift = int(ranks[block]) + int(inside.sum()), shift + 8
        return value

    def all(self) -> np.ndarray:
        """Every id."""
        ids, where = np.zeros(self.length, np.uint64), None
        for level, (low, bits, _) in enumerate(self.levels):
            part = low.astype(np.uint64) << np.uint64(8 * level)
            more = np.flatnonzero(np.unpackbits(bits, count=len(low), bitorder="little"))
            if where is None:
                ids, where = part, more
            else:
                ids[where] |= part
                where = where[more]
        return ids


class WordEncoder:
    """Ids of texts by the tokenizers library. Its ids of a white-space-free piece do not depend on the neighbours, as
    white space is dropped and no token spans it; so each distinct piece is encoded once and remembered. Pieces are fewer
    with A-Z lower-cased, as the library does, and cut between a letter and a comma or full stop, where tokens always end."""

    def __init__(self, json_text: str, memo_bytes: int = MEMO_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(json_text)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.memo = WordMemo(self.resolve, memo_bytes)

    def resolve(self, words: list[bytes]) -> list[bytes]:
        """Ids of different pieces: many at a time as one text with spaces between, cut where the tokens' places say."""
        out: list[bytes] = []
        for at in range(0, len(words), ENCODED):
            pieces = [w.decode() for w in words[at : at + ENCODED]]
            found = self.tokenizer.encode(" ".join(pieces), add_special_tokens=False)
            sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
            starts = np.cumsum(sizes + 1) - sizes - 1
            places = np.array([a for a, _ in found.offsets], np.int64)
            ends = np.searchsorted(places, starts + sizes) * self.kind.itemsize
            raw = np.array(found.ids, self.kind).tobytes()
            out += [raw[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)]
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a string column in a row, and their number in each."""
        texts = pc.fill_null(texts, "")
        cut = pc.replace_substring_regex(pc.ascii_lower(texts), pattern="([a-z])([,.])", replacement=r"\1 \2")
        special = pc.match_substring(texts, "<|")  # lower-casing could make a special token of it
        bounds, index, distinct = split_words(pc.if_else(special, texts, cut))
        got = self.memo.get(distinct)
        sizes = np.fromiter(map(len, got), np.int64, len(got)) // self.kind.itemsize
        ids, lengths = gather(np.r_[0, np.cumsum(sizes)], np.frombuffer(b"".join(got), self.kind), index)
        return ids, np.diff(np.r_[0, np.cumsum(lengths)][bounds])


def with_end(ids: np.ndarray, lengths: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    return np.insert(ids, np.cumsum(lengths), end_id), lengths + 1


def segment_payload(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    return b"".join([MAGIC, struct.pack("<Q", len(doc_ids)), doc_ids.astype("<i8").tobytes(), lengths.astype("<u8").tobytes(), dac_encode(ids)])


def read_payload(data: bytes) -> tuple[np.ndarray, np.ndarray, Dac]:
    if data[:8] != MAGIC:
        raise ValueError("not a token segment")
    n = struct.unpack_from("<Q", data, 8)[0]
    return np.frombuffer(data, "<i8", n, 16), np.frombuffer(data, "<u8", n, 16 + 8 * n).astype(np.int64), Dac(data[16 + 16 * n :])


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Encode every text and write segments to the folder `path`, through Spark's writer, so that any store will do.

    Documents lie in ascending doc_id order, null first, rows of one id in the order of their texts' hashes; so a range of
    rows may end within an id, however many rows that has. Rows equal in both are equal. A null or empty text has the end id
    alone; texts may be of any length: a longer one than a segment is a segment of its own. An empty table gives an empty
    folder of segments; further columns, of any name, are ignored.
    """

    with open(tokenizer_path, encoding="utf-8") as file:
        shipped = docs.sparkSession.sparkContext.broadcast(file.read())  # of the size of its vocabulary
    name = uuid.uuid4().hex

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, number, count, at = kept_in_worker(name, lambda: WordEncoder(shipped.value)), TaskContext.get().partitionId(), 0, 0
        kept: list[tuple] = []

        def segment() -> pa.RecordBatch:
            doc_ids, lengths, ids = (np.concatenate([k[j] for k in kept]) for j in range(3))
            payload = segment_payload(doc_ids, lengths, ids)
            return pa.RecordBatch.from_pylist([{"part": number, "segment": count, "first_doc": int(doc_ids[0]), "local_start": at, "n_tokens": len(ids), "payload": payload}], schema=schema)

        schema = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("first_doc", pa.int64()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("payload", pa.binary())])
        for batch in (part for whole in rows for part in text_slices(whole, 1, SLICE_BYTES)):
            ids, lengths = with_end(*encoder.encode(batch.column(1)), end_id)
            kept.append((id_array(batch.column(0)), lengths, ids))
            if sum(len(k[2]) for k in kept) >= segment_tokens:
                yield segment()
                at, count, kept = at + sum(len(k[2]) for k in kept), count + 1, []
        if kept:
            yield segment()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    ordered = source.withColumn("tie", F.xxhash64("text")).repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    arrow_map(ordered.select("doc_id", "text"), run, "part int, segment int, first_doc long, local_start long, n_tokens long, payload binary").write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row a document, from the files: doc_id, start, n_tokens, ids_crc32; of an empty folder none."""
    segments = spark.read.schema("part int, segment int, first_doc long, local_start long, n_tokens long, payload binary").parquet(path)
    # a row a written partition: as few as there were tasks
    totals = segments.groupBy("part").agg(F.min("first_doc").alias("first_doc"), F.sum("n_tokens").alias("n"))
    before = Window.orderBy("first_doc", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    # a row a written partition on the right: the segments stay where they are
    placed = segments.join(F.broadcast(offsets), "part").select((F.col("offset") + F.col("local_start")).alias("start"), "payload")

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for start, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                doc_ids, lengths, dac = read_payload(payload.as_py())
                ids, ends = dac.all().astype("<u4"), np.cumsum(lengths)
                crcs = [zlib.crc32(ids[e - n : e]) for e, n in zip(ends, lengths, strict=True)]
                yield pa.RecordBatch.from_arrays([null_ids(doc_ids), pa.array(start + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return arrow_map(placed, run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_range(spark: SparkSession, path: str, start: int, stop: int) -> list[int]:
    """Ids from place `start` to `stop` of the whole sequence, read from the segments that hold them alone."""
    segments = spark.read.parquet(path)
    totals = segments.groupBy("part").agg(F.min("first_doc").alias("first_doc"), F.sum("n_tokens").alias("n"))
    before = Window.orderBy("first_doc", "part").rowsBetween(Window.unboundedPreceding, -1)
    at = segments.join(totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")), "part").withColumn("start", F.col("offset") + F.col("local_start"))
    out = []
    for row in at.where((F.col("start") < stop) & (F.col("start") + F.col("n_tokens") > start)).orderBy("start").select("start", "payload").toLocalIterator():
        dac = read_payload(bytes(row.payload))[2]
        out += [dac[i] for i in range(max(start - row.start, 0), min(stop - row.start, len(dac)))]
    return out


def token_digest(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write the files to the shared folder and read them back: doc_id, start, n_tokens, ids_crc32, one row a document. Nulls,
    empty and long texts, rows of one id or none, repeated rows, empty tables and further columns are as in
    write_token_files: each row is a document of its own."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(docs, path, tokenizer_path)
    return read_token_files(spark, path)
