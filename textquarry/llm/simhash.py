"""Near-duplicate documents by SimHash with deletion-variant signatures.

A fingerprint is cut into few segments, so few that one segment of two linked fingerprints differs by one bit at most
(distance < 2 x segments). Each segment is indexed under every variant with one bit wiped out; two segments share a
variant exactly if they differ by at most that bit. An equality join on (segment, wiped bit, variant), done as one
shuffle and a sorted scan, brings candidates together, and their whole fingerprints are compared. Equal fingerprints
are merged before. A bucket gives a spanning forest of its links, not all pairs. Buckets over `bucket_limit` are not
compared but dealt again: their members are keyed by one-wildcard variants of the halves of the other bits, level by
level, until a bucket can hold no more than `bucket_limit` different fingerprints; no link is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import arrow_map, bloom_filter, components, discard, even_keys, free_name, grouped, id_array, in_filter, materialise, pack, parted, partitions, runs, spark_long_hash, text_bytes, text_slices, unpack, words_of

SEED = 42
#: Fingerprints that are compared with each other within one bucket; larger buckets are dealt again.
BUCKET_LIMIT = 4096
#: Texts that share a leading shingle and are all paired with each other; of more, some at a time are paired with all.
PAIRED = 8
#: The fewest parity bits of a set, and pairs of one text that one task checks at a time.
PARITY_BITS, CHECKED = 256, 256
#: Shingles that a task sorts at a time, and of a bucket that are compared at a time; buckets of hashes for each partition.
CHUNK_SHINGLES, COMPARED, BUCKETS_EACH = 1 << 19, 1 << 21, 1
#: Parity bits, in bytes, that a member takes along into a crowded bucket, and members whose bits are all compared with each other.
CARRIED, SQUARE = 256, 4096
#: Pairs of a crowded bucket that are held until those that are not the closest of a label go.
WEIGHED = 1 << 20
#: Pairs that a task holds, to drop those that it has found before, until it reports them.
HELD_PAIRS = 1 << 19
#: Bits of the filters of texts that are looked at again; fixed, however many: fuller ones only pass more texts.
FILTER_BITS = 1 << 23


def shingle_hashes(text: bytes, size: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of every shingle of `size` words of the text with A-Z lower-cased; the whole sequence if it is shorter."""
    words = words_of(text.lower())
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        return np.array([xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    return np.fromiter(map(xxh64_intdigest, shingles, repeat(seed)), np.uint64, len(words) - size + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """64 bits, each 1 if set in over half of the hashes; 0 for none."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long. Null and empty texts have fingerprint 0."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in text_slices(whole, 1)):
            got = np.array([fingerprint(shingle_hashes(t, shingle)) for t in text_bytes(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got.view(np.int64))], names=["doc_id", "fp"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, fp long")


def forest(values: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges (indices) of a spanning forest of the links among the values; each edge is itself a link."""
    left = np.arange(len(values))
    edges: list[tuple[int, int]] = []
    while len(left):
        frontier, left = [int(left[0])], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            near = np.bitwise_count(values[left] ^ values[at]) <= distance
            found = left[near]
            edges.extend((at, int(x)) for x in found)
            frontier.extend(found.tolist())
            left = left[~near]
    return edges


def link_buckets(distance: int, limit: int):
    """Scan rows (key, fp) sorted by key; give (a, b, key): a link, or b null for a member of a bucket over the limit."""

    def compare(keys: np.ndarray, values: np.ndarray) -> tuple[list, list]:
        starts, ends = runs(keys)
        size = ends - starts
        a, b = [], []
        pairs = starts[size == 2]
        if len(pairs):
            x, y = values[pairs], values[pairs + 1]
            ok = np.bitwise_count(x ^ y) <= distance
            a.append(x[ok])
            b.append(y[ok])
        for s, e in zip(starts[size > 2], ends[size > 2], strict=True):
            found = forest(values[s:e], distance)
            if found:
                index = np.array(found)
                a.append(values[s:e][index[:, 0]])
                b.append(values[s:e][index[:, 1]])
        return a, b

    def out(a: np.ndarray, b: np.ndarray | None, keys: np.ndarray | None) -> pa.RecordBatch:
        n = len(a)
        return pa.RecordBatch.from_arrays(
            [pa.array(a.view(np.int64)), pa.nulls(n, pa.int64()) if b is None else pa.array(b.view(np.int64)), pa.nulls(n, pa.string()) if keys is None else pa.array(keys, pa.string())],
            names=["a", "b", "key"],
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values, hot = np.zeros(0, object), np.zeros(0, np.uint64), None

        for batch in batches:
            k, v = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            if not len(k):
                continue
            if len(keys):
                k, v = np.concatenate([keys, k]), np.concatenate([values, v])
            if hot is not None:
                n = int(np.searchsorted(k != hot, True)) if k[0] == hot else 0
                if n:
                    yield out(v[:n], None, k[:n].astype(str))
                    k, v = k[n:], v[n:]
                if not len(k):
                    keys, values = k, v
                    continue
                hot = None
            starts, ends = runs(k)
            last, keep = starts[-1], np.ones(len(k), bool)
            keep[last:] = False
            for s, e in zip(starts[ends - starts > limit], ends[ends - starts > limit], strict=True):
                yield out(v[s:e], None, k[s:e].astype(str))
                keep[s:e] = False
                hot = k[s] if e == len(k) else None
            a, b = compare(k[keep], v[keep])
            if a:
                yield out(np.concatenate(a), np.concatenate(b), None)
            keys, values = (k[:0], v[:0]) if hot is not None else (k[last:], v[last:])
        a, b = compare(keys, values)
        if a:
            yield out(np.concatenate(a), np.concatenate(b), None)

    return run


def link_fingerprints(fps: DataFrame, distance: int = 3, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Links (a, b) among different longs of column fp, enough to connect whatever is reachable by links.

    Every given pair differs in `distance` bits or fewer; distance may be 3 at most, as two segments of 32 bits are cut.
    """
    if not 0 <= distance <= 3:
        raise ValueError("two segments serve distances from 0 to 3")
    n = partitions(fps.sparkSession)
    piece = F.expr("shiftrightunsigned(fp, cast((j div 32) * 32 as int)) & 4294967295L")
    wiped = piece.bitwiseAND(F.expr("~shiftleft(1L, pmod(j, 32))"))
    index = fps.select("fp").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(63)))).select(F.shiftleft(F.col("j").cast("long"), 32).bitwiseOR(wiped).alias("key"), "fp")

    def compared(rows: DataFrame, limit: int) -> DataFrame:
        return materialise(arrow_map(rows.repartition(n, "key").sortWithinPartitions("key"), link_buckets(distance, limit), "a long, b long, key string"), "links")

    found = compared(index, bucket_limit)
    links = found.where("b is not null").select("a", "b")
    # what is left to compare lies in bits lo to lo + span of a bucket's members; one half of them differs by a bit at most
    hot = found.where("b is null").select(F.col("a").alias("fp"), F.when(F.shiftright(F.col("key").cast("long"), 32) < 32, 32).otherwise(0).alias("lo"), "key")
    for half in (16, 8):
        if hot.isEmpty():
            break
        cells = hot.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(half - 1))))
        cell = F.expr(f"shiftrightunsigned(fp, lo + side * {half}) & {(1 << half) - 1}L & ~shiftleft(1L, bit)")
        deeper = cells.select(F.concat_ws(":", (F.col("lo") + F.when(F.col("side") == 0, half).otherwise(0)).cast("string"), "key", F.col("side").cast("string"), F.col("bit").cast("string"), cell.cast("string")).alias("key"), "fp")
        found = compared(deeper, bucket_limit if half > 8 else 1 << 62)
        links = links.union(found.where("b is not null").select("a", "b"))
        hot = found.where("b is null").select(F.col("a").alias("fp"), F.substring_index("key", ":", 1).cast("int").alias("lo"), "key")
    return links


def near_duplicate_components(docs: DataFrame, shingle: int = 3, distance: int = 3, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links, the document's own included.

    Null and empty texts have fingerprint 0 and link like any other. Repeated rows are rows of one component each. Rows
    with a null doc_id take part; they never give a component its id unless all of its ids are null. Empty tables give
    an empty result; further columns are ignored.
    """
    fps = materialise(fingerprints(docs, shingle), "fingerprints")
    nodes = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    roots = components(link_fingerprints(nodes, distance, bucket_limit))
    joined = materialise(nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root")), "nodes")
    smallest = materialise(joined.groupBy("root").agg(F.min("first_id").alias("component_id")), "roots")
    named = materialise(joined.join(smallest, "root").select("fp", "component_id"), "named")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def text_node(text: bytes) -> int:
    """XXH64 of the lower-cased words as a signed long: texts of equal words are one node."""
    return xxh64_intdigest(b" ".join(words_of(text.lower())), 1) - (1 << 63)


def parity_bits(hashes: np.ndarray) -> bytes:
    """Two to four bits a hash, a power of two, each the parity of the hashes that fall on it: of two sets no more of them
    differ than sets do in members."""
    bits = max(PARITY_BITS, 1 << (2 * len(hashes) - 1).bit_length() if len(hashes) else 0)
    odd = np.bincount((hashes % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def bits_apart(x: bytes, y: bytes) -> int:
    """How many parity bits differ; those of a larger set are folded until there are as many as of the other."""
    a, b = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum(dtype=np.int64))


def carried_parity(parity: bytes) -> bytes:
    """Parity bits folded to CARRIED bytes at most: still no more of them differ than sets do in members."""
    bits = np.frombuffer(parity, np.uint8)
    return np.bitwise_xor.reduce(bits.reshape(-1, min(len(bits), CARRIED)), axis=0).tobytes()


class Parities:
    """Carried parity bits of a bucket's members, compared many at a time."""

    def __init__(self, data: list[bytes]):
        self.width = np.array([len(x) >> 3 for x in data], np.int64)
        widest = int(self.width.max())
        self.bits = np.frombuffer(b"".join(x.ljust(widest << 3, b"\0") for x in data), np.uint64).reshape(-1, widest)

    def apart(self, p: int, at: np.ndarray) -> np.ndarray:
        """How many bits of members `at` differ from those of member p; of two lengths the longer is folded."""
        out = np.zeros(len(at), np.int64)
        for w in np.unique(self.width[at]).tolist():
            pick = np.flatnonzero(self.width[at] == w)
            least = min(w, int(self.width[p]))
            own = np.bitwise_xor.reduce(self.bits[p, : self.width[p]].reshape(-1, least), axis=0)
            others = np.bitwise_xor.reduce(self.bits[at[pick], :w].reshape(len(pick), -1, least), axis=1)
            out[pick] = np.bitwise_count(others ^ own).sum(axis=1, dtype=np.int64)
        return out


def pack_set(hashes: np.ndarray) -> bytes:
    """A set of shingles by the leading 48 bits of their hashes, as packed steps from one to the next."""
    return pack(step=np.diff(np.unique(hashes >> np.uint64(16)), prepend=np.uint64(0)))


def unpack_set(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64)[0], dtype=np.uint64)


def common_shingles(docs: DataFrame, shingle: int, sample: int = 10_000, most: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of several of about `sample` documents, the `most` commonest at most, sorted, with their counts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in text_bytes(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_hashes(t, shingle)).view(np.int64))], names=["shingle"])

    scale = 1 << 40
    share = min(scale, scale * sample // max(1, docs.count()))
    texts = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < share).select(F.col("text").cast("string").alias("text"))
    counted = arrow_map(texts, run, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where("n > 2")
    rows = counted.orderBy(F.desc("n"), "shingle").limit(most).toPandas()
    h, n = rows["shingle"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def leading(hashes: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """So many of a set's shingles, the rarest first, that any set of that Jaccard similarity shares one of its own leading ones."""
    if not len(hashes):
        return hashes
    known, counts = common
    rank = np.zeros(len(hashes), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        rank = np.where(known[at] == hashes, counts[at], 0)
    return hashes[np.lexsort((hashes, rank))][: len(hashes) - math.ceil(similarity * len(hashes) - 1e-9) + 1]


SKETCH = pa.schema([("bucket", pa.int32()), ("data", pa.binary()), ("doc_id", pa.int64()), ("node", pa.int64()), ("size", pa.int64()), ("parity", pa.binary()), ("fp", pa.int64())])


def sketches(docs: DataFrame, shingle: int, similarity: float, keys: np.ndarray, printed: int | None = None) -> DataFrame:
    """Rows of two kinds: (doc_id, node, size, parity, fp) of each text, its node, the size and parity bits of its set of
    shingles, and its fingerprint of `printed`-word shingles (null if None); and (bucket, data), packed (shingle, node, size,
    place) of leading shingles, place their rank in the order. A task ships a text's leading shingles once."""
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, shingle))

    def block(parts: list[tuple[np.ndarray, int, int]]) -> pa.RecordBatch:
        sizes = [len(x) for x, _, _ in parts]
        h, node, size = np.concatenate([x for x, _, _ in parts]), np.repeat(np.array([x for _, x, _ in parts], np.int64), sizes), np.repeat(np.array([x for _, _, x in parts], np.uint32), sizes)
        place = np.concatenate([np.arange(n, dtype=np.uint32) for n in sizes])
        order = np.argsort(h)
        h, node, size, place = h[order], node[order], size[order], place[order]
        bucket = keys[((h >> np.uint64(32)) * np.uint64(len(keys)) >> np.uint64(32)).astype(np.int64)]
        bounds = list(zip(*runs(bucket), strict=True))
        data = [pack(h=h[s:e], node=node[s:e], size=size[s:e], place=place[s:e]) for s, e in bounds]
        n = len(data)
        return pa.RecordBatch.from_arrays([pa.array(bucket[[s for s, _ in bounds]], pa.int32()), pa.array(data, pa.binary()), *(pa.nulls(n, SKETCH.field(k).type) for k in range(2, 7))], schema=SKETCH)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, int, int]] = []
        seen: set[int] = set()
        load = 0
        for batch in (part for whole in batches for part in text_slices(whole, 1)):
            nodes, sizes, parities, prints = [], [], [], []
            for t in text_bytes(batch.column(1)):
                hashes = np.unique(shingle_hashes(t, shingle))
                nodes.append(text_node(t))
                sizes.append(len(hashes))
                parities.append(parity_bits(hashes))
                prints.append(0 if printed is None else fingerprint(shingle_hashes(t, printed)))
                if nodes[-1] not in seen and len(hashes):
                    seen.add(nodes[-1])
                    parts.append((leading(hashes, common.value, similarity), nodes[-1], len(hashes)))
                    load += len(parts[-1][0])
                if load >= CHUNK_SHINGLES:
                    yield block(parts)
                    parts, seen, load = [], set(), 0
            n = len(batch)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), batch.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(parities, pa.binary()), pa.nulls(n, pa.int64()) if printed is None else pa.array(np.array(prints, np.uint64).view(np.int64))], schema=SKETCH)
        if parts:
            yield block(parts)

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "bucket int, data binary, doc_id long, node long, size long, parity binary, fp long")


def whole_buckets(batches: Iterable[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns, of longs or else of objects, of rows sorted by the first, cut only where that changes."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not len(batch):
            continue
        columns = [c.to_numpy(zero_copy_only=pa.types.is_int64(c.type)) for c in batch.columns]
        cut = int(np.searchsorted(columns[0], columns[0][-1]))
        if held and (cut or held[-1][0][-1] != columns[0][0]):
            held.append([c[:cut] for c in columns])
            yield [np.concatenate(parts) for parts in zip(*held, strict=True)]
            held = []
        elif cut:
            yield [c[:cut] for c in columns]
        held.append([c[cut:] for c in columns])
    if held:
        yield [np.concatenate(parts) for parts in zip(*held, strict=True)]


def packed_buckets(compared: int = COMPARED):
    """From rows (bucket, data) sorted by bucket: columns (shingle, node, size, place, label) of shingles that several texts lead
    with, sorted by the shingle. Of a large bucket a range of the shingles at a time is unpacked."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        for _, rows in grouped(batches):
            data = [r[1] for r in rows]
            passes = max(1, -(-sum(map(len, data)) // (8 * compared)))
            for p in range(passes):
                parts = [unpack(d, np.uint64, np.int64, np.uint32, np.uint32) for d in data]
                if passes > 1:
                    parts = [[a[(x[0] & np.uint64(0xFFFFFFFF)) * np.uint64(passes) >> np.uint64(32) == np.uint64(p)] for a in x] for x in parts]
                h, node, size, place = (np.concatenate([x[j] for x in parts]) for j in range(4))
                order = np.argsort(h, kind="stable")
                same = h[order][1:] == h[order][:-1]
                order = order[np.r_[same, False] | np.r_[False, same]] if len(order) else order
                order = order[np.lexsort((node[order], h[order]))]
                h, node, size, place = h[order], node[order], size[order], place[order]
                # the same text in blocks of several tasks
                own = np.r_[True, (h[1:] != h[:-1]) | (node[1:] != node[:-1])] if len(h) else np.zeros(0, bool)
                if own.any():
                    yield [h[own].view(np.int64), node[own], size[own].astype(np.int64), place[own].astype(np.int64), node[own]]

    return run


def closest(l: np.ndarray, x: np.ndarray, y: np.ndarray, far: np.ndarray, most: int) -> np.ndarray:
    """Which pairs (x, y) are among the `most` of least `far` that their member x's label has, or their member y's."""
    which, labels = np.tile(np.arange(len(x)), 2), np.concatenate([l[x], l[y]])
    order = np.lexsort((which, np.tile(far, 2), labels))
    starts, ends = runs(labels[order])
    nth = np.arange(len(order)) - np.repeat(starts, ends - starts)
    out = np.zeros(len(x), bool)
    out[which[order[nth < most]]] = True
    return out


def pair_buckets(buckets, pivots: int, limit: int, similarity: float):
    """Scan columns (key, node, size, place, label) and perhaps parity bits, sorted by key; give (a, b, size, place, key): a pair
    to check, or b null for a member that stays in its bucket.

    Pairs of one label need no check, nor do those that could not be similar if this is the first shingle that they share in
    the common order: then all that they share lies at its place and after, in either set. (Pairs that share an earlier one
    meet there.) Where members carry parity bits, pairs that these rule out are not given either, and each label gives the
    `pivots` pairs with another label whose parity bits differ least: the likeliest links, and as one link connects two labels,
    a number that grows with the labels, not with the pairs of their members. Members stay that have a pair which was not
    given. Without parity bits, buckets with few pairs to check give them all. In others
    `pivots` members are paired with the rest: with `pivots` members of each other label. A pivot leaves once no label has
    more; the others stay if labels differ. Pivots are of the smallest labels, and of these the least by number, which is a
    hash: so crowded buckets of the same texts have the same pivots, and a task reports their pairs once.
    """

    def fits(n: np.ndarray, i: np.ndarray, m: np.ndarray, j: np.ndarray) -> np.ndarray:
        shared = similarity / (1 + similarity) * (n + m) - 1e-6
        return (np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-6) & (np.minimum(n - i, m - j) >= shared)

    def near(bits: Parities, n: np.ndarray, p: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of members `at` that the parity bits let be similar to member p, and the share of them that differs."""
        if not len(at):
            return at, np.zeros(len(at))
        far = bits.apart(p, at) / (n[at] + n[p])
        ok = far <= (1 - similarity) / (1 + similarity) + 1e-9
        return at[ok], far[ok]

    def few(v: np.ndarray, n: np.ndarray, i: np.ndarray, l: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Every pair of members that is to be checked, or None if there are too many."""
        if len(v) > 32 * limit:
            return None
        x, y = np.nonzero(np.triu((l[:, None] != l) & fits(n[:, None], i[:, None], n, i), 1))
        return (v[x], v[y]) if len(x) <= limit * len(v) else None

    def likeliest(bits: Parities, n: np.ndarray, i: np.ndarray, l: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs (x, y) of members, the closest of each label's, and which members have others that are to be checked. Members lie
        label by label; of more than SQUARE the first are compared with all, as many as come to half a square's pairs."""
        last = int(np.count_nonzero(l != l[-1]))
        first = last if len(l) <= SQUARE else min(last, max(pivots, SQUARE * SQUARE // (2 * len(l))))
        stays = np.arange(len(l)) >= (first if first < last else len(l))
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        load, most = 0, WEIGHED

        def chosen() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            x, y, far = (np.concatenate(part) for part in zip(*held, strict=True))
            pick = closest(l, x, y, far, pivots)
            stays[x[~pick]] = stays[y[~pick]] = True
            return x[pick], y[pick], far[pick]

        for p in range(first):
            rest = slice(p + 1, None)
            at, far = near(bits, n, p, p + 1 + np.flatnonzero((l[rest] != l[p]) & fits(n[rest], i[rest], n[p], i[p])))
            held.append((np.full(len(at), p), at, far))
            load += len(at)
            if load >= most:
                held = [chosen()]
                load = len(held[0][0])
                most = max(WEIGHED, 2 * load)
        x, y, _ = chosen()
        return x, y, stays

    def out(a: np.ndarray, b: np.ndarray | None, *rest: np.ndarray) -> pa.RecordBatch:
        empty = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a), empty if b is None else pa.array(b), *([pa.array(x) for x in rest] or [empty] * 3)], names=["a", "b", "size", "place", "key"])

    def once(held: list[np.ndarray]) -> np.ndarray:
        both = np.concatenate(held)
        order = np.lexsort((both[:, 1], both[:, 0]))
        both = both[order]
        return both[np.r_[True, (both[1:] != both[:-1]).any(axis=1)]]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def keep(x: np.ndarray, y: np.ndarray) -> None:
            if len(x):
                held.append(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1))

        for key, node, size, place, label, *parity in buckets(batches):
            starts, ends = runs(key)
            small = np.repeat(ends - starts <= limit, ends - starts)
            k, v, n, i, l = key[small], node[small], size[small], place[small], label[small]
            for apart in range(1, limit):
                same = k[:-apart] == k[apart:]
                if not same.any():
                    break
                at = np.flatnonzero(same & (l[:-apart] != l[apart:]) & fits(n[:-apart], i[:-apart], n[apart:], i[apart:]))
                keep(v[at], v[at + apart])
            for s, e in zip(starts[ends - starts > limit], ends[ends - starts > limit], strict=True):
                _, which, members = np.unique(label[s:e], return_inverse=True, return_counts=True)
                if len(members) == 1:
                    continue
                order = np.lexsort((node[s:e], which, members[which])) + s
                v, n, i, l = node[order], size[order], place[order], label[order]
                if parity:
                    x, y, stays = likeliest(Parities(parity[0][order].tolist()), n, i, l)
                    keep(v[x], v[y])
                    if len(np.unique(l[stays])) > 1:
                        yield out(v[stays], None, n[stays], i[stays], np.full(int(stays.sum()), key[s]))
                    continue
                pairs = few(v, n, i, l)
                if pairs is not None:
                    keep(*pairs)
                    continue
                stays = np.ones(len(v), bool)
                for p in range(min(pivots, len(v))):
                    at = p + 1 + np.flatnonzero((l[p + 1 :] != l[p]) & fits(n[p + 1 :], i[p + 1 :], n[p], i[p]))
                    # labels lie side by side: so many of each
                    begins, ends_ = runs(l[at])
                    nth = np.arange(len(at)) - np.repeat(begins, ends_ - begins)
                    stays[p] = bool((nth >= pivots).any())
                    at = at[nth < pivots]
                    keep(v[at], np.full(len(at), v[p]))
                if len(np.unique(l[stays])) > 1:
                    yield out(v[stays], None, n[stays], i[stays], np.full(int(stays.sum()), key[s]))
            if sum(map(len, held)) >= HELD_PAIRS:
                held = [once(held)]
                if len(held[0]) >= HELD_PAIRS // 2:
                    yield out(held[0][:, 0].copy(), held[0][:, 1].copy())
                    held = []
        if held:
            both = once(held)
            yield out(both[:, 0].copy(), both[:, 1].copy())

    return run


def similar_pairs(docs: DataFrame, texts: DataFrame, pairs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose sets of `shingle`-word shingles have that Jaccard similarity at least.

    texts has (node, first_id, size, parity, label); pairs of one label are left out, as they need no check. Shingle sets, by 48
    bits a shingle, are made and shipped only for pairs that parity bits do not rule out; a fixed-size filter keeps the texts of
    all others where they are.
    """
    spark = docs.sparkSession

    def possible(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = np.array([bits_apart(x, y) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)], np.int64)
            total = batch.column("m").to_numpy() + batch.column("n").to_numpy()
            ok = apart <= total * ((1 - similarity) / (1 + similarity)) + 1e-6
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in text_slices(whole, 1)):
            there = in_filter(spark_long_hash(id_array(batch.column(0))), wanted.value)
            texts = text_bytes(batch.column(1).filter(pa.array(there, pa.bool_())))
            if texts:
                yield pa.RecordBatch.from_arrays([pa.array([text_node(t) for t in texts], pa.int64()), pa.array([pack_set(shingle_hashes(t, shingle)) for t in texts], pa.binary())], names=["node", "shingles"])

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (a, part, b, shingles) sorted by them: a's own set, of which b is null, then those of its partners."""
        own: np.ndarray = np.zeros(0, np.uint64)
        for batch in batches:
            a, b = [], []
            for x, y, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                hashes = unpack_set(data)
                if y is None:
                    own = hashes
                    continue
                both = len(np.intersect1d(own, hashes, assume_unique=True))
                if both >= similarity * (len(own) + len(hashes) - both):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    n = partitions(spark)
    one = materialise(pairs.distinct().join(texts.select(F.col("node").alias("a"), F.col("size").alias("m"), F.col("parity").alias("x"), F.col("label").alias("l")), "a"), "pairs")
    both = one.join(texts.select(F.col("node").alias("b"), F.col("size").alias("n"), F.col("parity").alias("y"), F.col("label").alias("k")), "b").where("k <> l").select("a", "b", "m", "n", "x", "y")
    pairs = materialise(arrow_map(both, possible, "a long, b long"), "pairs")
    named = materialise(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "named")
    wanted = spark.sparkContext.broadcast(bloom_filter(texts.join(named, "node", "left_semi").select(F.xxhash64("first_id")), FILTER_BITS))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    of = materialise(arrow_map(source, sets, "node long, shingles binary").join(named, "node", "left_semi").dropDuplicates(["node"]), "shingles")
    # a text of many pairs is split: its own set goes once to each CHECKED of its partners, and a partner's set once a pair
    parts = materialise(pairs.groupBy("a").agg(F.ceil(F.count("*") / CHECKED).cast("int").alias("parts")), "parts")
    dealt = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"), "b")
    partners = dealt.join(of.select(F.col("node").alias("b"), "shingles"), "b").select("a", "part", "b", "shingles")
    own = parts.join(of.select(F.col("node").alias("a"), "shingles"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "shingles")
    rows = partners.union(own).repartition(n, "a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    found = materialise(arrow_map(rows, compare, "a long, b long"), "similar")
    discard(one, pairs, named, of, parts)
    return found


def fingerprint_links(texts: DataFrame, distance: int) -> DataFrame:
    """(a, b): each text's node and the smallest node of those that its fingerprint reaches, over links of `distance` bits or
    fewer, where that is another; texts has (node, fp)."""
    nodes = materialise(texts.groupBy("fp").agg(F.min("node").alias("b")), "nodes")
    roots = materialise(components(link_fingerprints(nodes, distance)), "roots")
    joined = materialise(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "b", F.coalesce("root", "fp").alias("root")), "nodes")
    smallest = joined.groupBy("root").agg(F.min("b").alias("b"))
    of = materialise(joined.select("fp", "root").join(smallest, "root").select("fp", "b"), "smallest")
    links = materialise(texts.select(F.col("node").alias("a"), "fp").join(of, "fp").where("a <> b").select("a", "b"), "similar")
    discard(nodes, roots, joined, of)
    return links


def near_duplicate_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, bucket_limit: int = PAIRED, compared: int = COMPARED, printed: int | None = None, distance: int = 3) -> DataFrame:
    """(doc_id, group_id, node, root) of near duplicates; group_id is the smallest doc_id of the group, node a hash of the words,
    root the group's smallest node, which tells groups of one smallest id apart.

    Two texts link if the Jaccard similarity of their sets of five-word shingles is 0.8 or more. Such sets share one of their
    leading shingles in any common order, here the rarest first; so pairs of texts that share one are all there are to
    check. In a bucket over `bucket_limit` some members at a time are checked against all others, until every pair of
    members is checked, ruled out by parity bits or connected by links that were.

    With `printed`, SimHash comes first: texts link as well if their fingerprints of `printed`-word shingles, repeats included,
    differ in `distance` bits or fewer, as in near_duplicate_components. What these links connect is not compared again in
    crowded buckets.

    Texts of equal words are one; null and empty texts have equal words, none. Texts may be of any length. Rows of one id and
    different words are texts of their own; of rows equal in both there is one row here. Rows of a null doc_id stay alone
    (group_id null, one row for all of one text). An empty table gives no rows; further columns are ignored.
    """

    def carry(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(carried_parity, batch.column(1).to_pylist()), pa.binary())], names=["node", "parity"])

    known = docs.where("doc_id is not null")
    n = partitions(docs.sparkSession)
    sketched = materialise(sketches(known, shingle, similarity, even_keys(n, BUCKETS_EACH), printed), "sketches")
    rows = sketched.where("bucket is null")
    texts = materialise(rows.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.min("size").alias("size"), F.min("parity").alias("parity"), F.min("fp").alias("fp")), "texts")
    blocks = sketched.where("bucket is not null").select("bucket", "data").repartition(n, "bucket").sortWithinPartitions("bucket")
    pair = "a long, b long, size long, place long, key long"
    found = materialise(arrow_map(blocks, pair_buckets(packed_buckets(compared), 1, bucket_limit, similarity), pair), "found")
    roots, carried, pivots, written = None, None, 1, [sketched, texts]
    if printed is None:
        texts = texts.withColumn("label", F.col("node"))
    else:
        printed_alike = fingerprint_links(texts.select("node", "fp"), distance)
        roots = printed_alike.toDF("node", "root")
        texts = materialise(texts.drop("fp").join(roots, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root"), "texts")
        written += [printed_alike, texts]
    while True:
        new = similar_pairs(known, texts, found.where("b is not null").select("a", "b"), shingle, similarity)
        # what is connected already is a link a text, by however many it was found
        roots = materialise(components(new if roots is None else new.union(roots.select("node", "root"))), "roots")
        written += [new, roots]
        stay = found.where("b is null")
        if stay.isEmpty():
            break
        if carried is None:
            crowded = texts.join(stay.select(F.col("a").alias("node")).distinct(), "node", "left_semi").select("node", "parity")
            carried = materialise(arrow_map(crowded, carry, "node long, parity binary"), "carried")
            written.append(carried)
        pivots *= 4
        left = stay.select("key", F.col("a").alias("node"), "size", "place").join(carried, "node").join(roots, "node", "left").select("key", "node", "size", "place", F.coalesce("root", "node").alias("label"), "parity")
        old, found = found, materialise(arrow_map(left.repartition(n, "key").sortWithinPartitions("key"), pair_buckets(whole_buckets, pivots, bucket_limit, similarity), pair), "found")
        discard(old)
    named = materialise(rows.select("doc_id", "node").distinct().join(roots, "node", "left").select("doc_id", "node", F.coalesce("root", "node").alias("root")), "named")
    discard(found, *written)
    smallest = named.groupBy("root").agg(F.min("doc_id").alias("group_id"))
    alone = docs.where("doc_id is null").select(*[F.lit(None).cast("long")] * 4).limit(1)
    return named.join(smallest, "root").select("doc_id", "group_id", "node", "root").union(alone)


def drop_near_duplicates(docs: DataFrame, printed: int | None = 3, **options) -> DataFrame:
    """docs without all but one row of each group of near duplicates (see near_duplicate_groups), by SimHash fingerprints and,
    for what these do not reach, by the similarity of sets: the row of the smallest doc_id stays, of such rows that of the
    smallest node. Rows of a null doc_id stay. Null and empty texts are copies of each other. Texts may be of any length; an
    empty table stays empty; columns of any name stay as they are.

    A fixed-size filter lets most rows that stay pass where they are; only what goes, and what it takes for such, is moved.
    """
    known = docs.where("doc_id is not null")
    node, gone_id, gone_node = (free_name(docs, x) for x in ("node", "gone_id", "gone_node"))
    groups = materialise(near_duplicate_groups(docs, printed=printed, **options).where("doc_id is not null"), "groups")
    stay = groups.where("doc_id = group_id").groupBy("root", F.col("group_id").alias("doc_id")).agg(F.min("node").alias("node"))
    gone = materialise(groups.join(stay, ["doc_id", "node"], "left_anti").select("doc_id", "node"), "gone")
    # rows equal in id and words: one of them stays
    repeated = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    context = docs.sparkSession.sparkContext
    looked_up = context.broadcast(bloom_filter(gone.select("doc_id").union(repeated).select(F.xxhash64("doc_id")), FILTER_BITS))
    id_at, text_at = docs.columns.index("doc_id"), docs.columns.index("text")

    def of_rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        h = spark_long_hash(id_array(batch.column(id_at).cast(pa.int64())))
        nodes = np.zeros(len(batch), np.int64)
        texts = batch.column(text_at).cast(pa.string())
        for k in np.flatnonzero(in_filter(h, looked_up.value)).tolist():
            nodes[k] = text_node((texts[k].as_py() or "").encode())
        return h, nodes

    clean, seen = parted(known, of_rows, looked_up, node)
    kept = seen.join(gone.toDF(gone_id, gone_node), (F.col("doc_id").cast("long") == F.col(gone_id)) & (F.col(node) == F.col(gone_node)), "left_anti").dropDuplicates(["doc_id", node])
    discard(groups)
    return docs.where("doc_id is null").union(clean).union(kept.select(docs.columns))
