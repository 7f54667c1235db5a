"""Shared helpers of the training-data operators: sessions, tables, word splitting, binary columns."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def return_freed_memory() -> None:
    """Make blocks of four megabytes and more go back to the system when they are freed. glibc would raise that limit with every
    such block, and Arrow's own pool keep them, so that each worker process would hold its largest hour for good."""
    with contextlib.suppress(OSError, AttributeError):  # another C library keeps its own ways
        ctypes.CDLL("libc.so.6").mallopt(-3, 1 << 22)
    pa.set_memory_pool(pa.system_memory_pool())


return_freed_memory()

#: Rows whose doc_id has this crc32 remainder are held out from every fit.
HOLDOUT_MOD = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """The path of a public tokenizer's vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the checkpoint folder that the session was given.

    Where neither is set, a session in one process gets a temporary folder, as tests do; on a cluster that is an error.
    """
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        if not spark.sparkContext._jsc.sc().isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="textquarry-"))
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
    return current.get().rstrip("/")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialise() wrote, once all that reads them is written itself."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def fold(column: str = "doc_id"):
    """crc32 of the id's decimal text, modulo HOLDOUT_MOD (null ids: fold of the empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % HOLDOUT_MOD


def spread_sample(rows: DataFrame, column: str, sizes: dict, per_value: int) -> DataFrame:
    """Rows of about `per_value` different ids for each value of a column (all, where there are fewer): those whose id's
    hash lies below the share that is wanted. A filter, so nothing is shuffled and no value's rows meet in one task."""
    scale = 1 << 40
    share = F.pmod(F.xxhash64("doc_id"), F.lit(scale))
    limit = F.lit(0).cast("long")
    for value, n in sizes.items():
        limit = F.when(F.col(column) == value, F.lit(min(scale, -(-scale * per_value // n)))).otherwise(limit)
    return rows.where(share < limit)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def text_strings(column: pa.Array | pa.ChunkedArray) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


def words_of(text: bytes) -> list[bytes]:
    r"""Maximal runs of bytes other than \x20 and \x09-\x0D; bytes.split() separates at exactly these."""
    return text.split()


#: Bytes that go to a worker at a time, where the session has not set its own: Spark's default of 64 MB would be held several
#: times over in every task.
BATCH_BYTES, BYTES_OF_SPARK = "4194304b", "67108864b"


def bound_batches(df: DataFrame) -> None:
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, BYTES_OF_SPARK) == BYTES_OF_SPARK:
        conf.set(key, BATCH_BYTES)


def arrow_map(df: DataFrame, fn: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow over batches of bounded bytes."""
    bound_batches(df)
    return df.mapInArrow(fn, schema)


def id_array(column: pa.Array) -> np.ndarray:
    """int64 ids; null is the smallest value, so that it sorts first."""
    return column.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False).astype(np.int64)


def null_ids(ids: np.ndarray) -> pa.Array:
    """The inverse of id_array."""
    return pa.array(ids, pa.int64(), mask=ids == np.iinfo(np.int64).min)


def pack(**arrays: np.ndarray) -> bytes:
    """Arrays of one length as zstd-compressed byte planes: like bytes lie together, so high ones cost little."""
    import zstandard

    planes = []
    for a in arrays.values():
        a = np.ascontiguousarray(a)
        planes.append(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(data: bytes, *dtypes: type) -> list[np.ndarray]:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    width = sum(np.dtype(d).itemsize for d in dtypes)
    n, at, out = len(raw) // width, 0, []
    for d in dtypes:
        k = np.dtype(d).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * k].reshape(k, n).T).view(d).reshape(n))
        at += n * k
    return out


def byte_strings(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column without nulls: cut from its buffer, which is faster than value by value."""
    if not len(column):
        return []
    _, offsets, data = column.cast(pa.binary()).buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    raw = b"" if data is None else data.to_pybytes()
    return [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Words of all texts of a string column, as words_of has them: where each text's begin in the row of words (with the
    end), the number of each word among the different ones, and these."""
    lists = pc.ascii_split_whitespace(texts)
    coded = lists.flatten().dictionary_encode()
    index, distinct = coded.indices.to_numpy(), byte_strings(coded.dictionary)
    bounds = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
    if b"" in distinct:  # at edges of texts
        keep = index != distinct.index(b"")
        bounds, index = np.r_[0, np.cumsum(keep)][bounds], index[keep]
    return bounds, index, distinct


def spark_hash(values: np.ndarray) -> np.ndarray:
    """Spark's hash of int columns (Murmur3, 32 bits, seed 42), by which repartition() deals rows out."""
    rotated = lambda x, r: x << np.uint32(r) | x >> np.uint32(32 - r)
    k = rotated(values.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
    h = rotated(np.uint32(42) ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(4)
    h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
    h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
    return (h ^ h >> np.uint32(16)).view(np.int32)


def spark_long_hash(values: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of a column of longs that are not null, as uint64."""
    from xxhash import xxh64_intdigest

    return np.fromiter((xxh64_intdigest(v.tobytes(), 42) for v in values.astype("<i8")), np.uint64, len(values))


def even_keys(n: int, each: int) -> np.ndarray:
    """Int keys that repartition(n, key) deals out `each` to a partition, so that buckets numbered by them are spread evenly."""
    keys = np.arange(n * each * 4 + 256, dtype=np.int32)
    while True:
        part = spark_hash(keys).astype(np.int64) % n
        order = np.argsort(part, kind="stable")
        starts, ends = runs(part[order])
        if len(starts) == n and (ends - starts).min() >= each:
            return np.concatenate([keys[order[s : s + each]] for s in starts.tolist()])
        keys = np.arange(len(keys) * 2, dtype=np.int32)


def filter_places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a Bloom filter that a 64-bit hash sets."""
    return (h % np.uint64(bits)).astype(np.int64), ((h >> np.uint64(32)) % np.uint64(bits - 1)).astype(np.int64)


def bloom_filter(rows: DataFrame, bits: int, of: Callable[[pa.RecordBatch], np.ndarray] | None = None) -> bytes:
    """A Bloom filter of 64-bit hashes, those that `of` gives for a batch of rows, or the only column, as longs: of fixed
    size, however many they are; too many only make it pass more. Tasks and partial aggregates merge the words of bits; the
    driver gets bits / 32 rows at most."""
    hashes = of or (lambda batch: batch.column(0).to_numpy().astype(np.int64).view(np.uint64))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(bits // 32, np.uint32)
        for batch in batches:
            for place in filter_places(hashes(batch), bits):
                np.bitwise_or.at(words, place >> 5, np.uint32(1) << (place & 31).astype(np.uint32))
        at = np.flatnonzero(words)
        for s in range(0, len(at), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(at[s : s + (1 << 16)], pa.int32()), pa.array(words[at[s : s + (1 << 16)]].astype(np.int64))], names=["at", "bits"])

    out = np.zeros(bits // 32, "<u4")
    table = arrow_map(rows, run, "at int, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out[table.column("at").to_numpy()] = table.column("bits").to_numpy()
    return out.tobytes()


def in_filter(h: np.ndarray, data: bytes) -> np.ndarray:
    """Which of some uint64 hashes a filter passes."""
    bits = np.frombuffer(data, np.uint8)
    a, b = filter_places(h, len(bits) * 8)
    return (bits[a >> 3] >> (a & 7) & 1 > 0) & (bits[b >> 3] >> (b & 7) & 1 > 0)


def text_slices(batch: pa.RecordBatch, column: int, size: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about `size` bytes of text; a longer text is a slice of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(batch):
        done = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, done + size, side="right")))
        yield batch.slice(at, end - at)
        at = end


def runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal values."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]])
    return starts, np.r_[starts[1:], len(sorted_keys)]


def gather(offsets: np.ndarray, flat: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated lists flat[offsets[i]:offsets[i+1]] for i of index, and their lengths."""
    lengths = (offsets[1:] - offsets[:-1])[index]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    position = np.arange(total, dtype=np.int64) + np.repeat(offsets[:-1][index] - (ends - lengths), lengths)
    return flat[position], lengths


def grouped(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of batches sorted by their first column, one list for each value of it."""
    key, rows = None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns, strict=True):
            if row[0] != key and rows:
                yield key, rows
                rows = []
            key = row[0]
            rows.append(row)
    if rows:
        yield key, rows


_KEPT: dict[str, object] = {}


def kept_in_worker(key: str, make: Callable[[], object], most: int = 1):
    """What make() gives, built once in a worker process for all tasks that it runs with this key; `most` are kept, so that what
    one operator remembers goes when the next one begins."""
    if key not in _KEPT:
        while len(_KEPT) >= most:
            del _KEPT[next(iter(_KEPT))]
        _KEPT[key] = make()
    return _KEPT[key]


def parted(docs: DataFrame, hashes: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]], passed, column: str, then: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, schema: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of docs that a broadcast filter does not pass, as they are or as `then` makes them in the same pass (with that
    schema); and those that it passes, with one more column of longs. hashes(batch) gives what is looked up and that column.
    So what meets another table by a shuffle is only what the filter passes: what is in it, and the few that it takes for such."""
    text_at = docs.columns.index("text")

    def part(wanted: bool):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (part for whole in batches for part in text_slices(whole, text_at)):
                looked_up, values = hashes(batch)
                pick = pa.array(in_filter(looked_up, passed.value) == wanted, pa.bool_())
                arrays = [c.filter(pick) for c in batch.columns]
                if wanted:
                    arrays.append(pa.array(values.view(np.int64)).filter(pick))
                out = pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, *[column] * wanted])
                yield out if wanted or then is None else then(out)

        return run

    own = docs.schema
    return arrow_map(docs, part(False), schema or own), arrow_map(docs, part(True), type(own)(list(own.fields)).add(column, "long"))


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column has it."""
    while name in df.columns:
        name = "_" + name
    return name


class WordMemo:
    """What a worker remembers of words: resolve(words) gives bytes for each. It begins anew when the words, their bytes and
    what Python needs to keep both come to more than `limit` bytes."""

    #: Bytes that a dictionary entry and the headers of its two byte strings take.
    ENTRY = 170

    def __init__(self, resolve: Callable[[list], list[bytes]], limit: int):
        self.resolve, self.limit, self.known, self.size = resolve, limit, {}, 0

    def get(self, words: list) -> list[bytes]:
        """The bytes of each of some different words."""
        if self.size > self.limit:
            self.known, self.size = {}, 0
        missing = [w for w in words if w not in self.known]
        if missing:
            found = self.resolve(missing)
            self.size += self.ENTRY * len(missing) + sum(map(len, missing)) + sum(map(len, found))
            self.known.update(zip(missing, found, strict=True))
        return list(map(self.known.__getitem__, words))


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Connected components of an undirected graph of long node ids: rows (node, root), root = smallest node.

    Contraction: every node hooks to its smallest neighbour, pointer jumping flattens the trees, and the edges are
    relabelled by roots and made distinct. Local minima alone survive a round, so at most half of the linked nodes do.
    Every step is a join or a pre-aggregated groupBy on written tables, which go as soon as the next is written; nothing but
    counts reaches the driver.
    """
    e = materialise(edges.select(F.col(left).cast("long").alias("a"), F.col(right).cast("long").alias("b")).where("a <> b").distinct(), "edges")
    labels: DataFrame | None = None
    while not e.isEmpty():
        both = e.union(e.select("b", "a"))
        parents = materialise(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")), "parents")
        while True:
            up = parents.select(F.col("node").alias("root"), F.col("root").alias("above"))
            old, parents = parents, materialise(parents.select("node", "root").join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), (F.col("above") != F.col("root")).alias("moved")), "parents")
            discard(old)
            if parents.where("moved").isEmpty():
                break
        if labels is None:
            labels = parents
        else:
            top = parents.select(F.col("node").alias("root"), F.col("root").alias("above"))
            old, labels = labels, materialise(labels.select("node", "root").join(top, "root", "left").select("node", F.coalesce("above", "root").alias("root")), "labels")
            discard(old)
        to_a, to_b = parents.select(F.col("node").alias("a"), F.col("root").alias("ra")), parents.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        halfway = materialise(e.join(to_a, "a").select("ra", "b"), "edges")
        old, e = e, materialise(halfway.join(to_b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        discard(old, halfway)
        if labels is not parents:
            discard(parents)
    discard(e)
    if labels is None:
        return edges.sparkSession.createDataFrame([], "node long, root long")
    return labels.select("node", "root")
