"""Approximate nearest neighbours by inner product over several shifted Hilbert curves.

Every curve rotates the vectors by an orthogonal matrix of its own, keeps a few coordinates, shifts and quantises them,
and orders the points along the Hilbert curve of that grid. Spark range-partitions the points by key; their ranks cut each
curve into tiles of equal size. A query's candidates are the points of the tiles around its own on every curve, merged and
ranked by exact inner products. Vectors of unequal length are lifted to one sphere first, so that a large inner product is
a small distance. Equal vectors are one point that carries its smallest ids.

A point's vector is moved once, to its home, the tile that it has on the first curve; curves ship numbers alone. A query
goes once to each home that holds a candidate of any curve, and is compared with all points there, so it never costs more
than a look at every point.

How many tiles are needed depends on the data. A fixed number of queries is answered exactly, and the window is made so
wide that it would have found the wished share of their neighbours: narrow where the vectors have clusters, up to whole
curves where they point in all directions alike.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, materialise, partitions

CURVES, GRID_DIMENSIONS, GRID_BITS, SEED = 6, 8, 7, 11
TILE_POINTS = 2048
#: Queries that are answered exactly to set the window, and the share of their neighbours that it must hold.
CALIBRATION_QUERIES, WISHED_RECALL = 128, 0.97
#: Queries that are compared with a tile's points at a time, in one task.
QUERY_BLOCK = 4096


def hilbert_keys(grid: np.ndarray, bits: int) -> np.ndarray:
    """Place of each grid point (rows of unsigned coordinates below 2^bits) along the Hilbert curve.

    The coordinates are transposed to the curve's own axes from the highest bit down: where a coordinate has the bit, the
    low bits of the first are inverted, else they are exchanged with the first's; a Gray decoding follows.
    """
    x = grid.astype(np.uint64).T.copy()
    d = len(x)
    for level in range(bits - 1, 0, -1):
        top, low = np.uint64(1 << level), np.uint64((1 << level) - 1)
        for i in range(d):
            has = (x[i] & top) > 0
            swap = np.where(has, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(has, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.uint64)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[d - 1] >> np.uint64(level)) & np.uint64(1), np.uint64((1 << level) - 1), np.uint64(0))
    x ^= flip
    key = np.zeros(x.shape[1], np.uint64)
    for level in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << np.uint64(1) | (x[i] >> np.uint64(level)) & np.uint64(1)
    return key


class Curve:
    """One ordering: rotation, shift and grid, from the curve's number alone."""

    def __init__(self, number: int, dimension: int, spread: float):
        rng = np.random.default_rng([SEED, number])
        kept = min(GRID_DIMENSIONS, dimension)
        self.axes = np.linalg.qr(rng.normal(size=(dimension, dimension)))[0][:, :kept]
        self.shift = rng.uniform(0, 1, kept)
        self.spread = max(spread, 1e-300)

    def keys(self, points: np.ndarray) -> np.ndarray:
        cells = 1 << GRID_BITS
        at = ((points @ self.axes) / self.spread * (cells / 8) + self.shift + cells / 2).astype(np.int64)
        return hilbert_keys(np.clip(at, 0, cells - 1), GRID_BITS).astype(np.int64)


def lifted(v: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with one more coordinate that brings all to the length of the longest."""
    rest = np.sqrt(np.maximum(longest**2 - (v * v).sum(axis=1), 0))
    return np.concatenate([v, rest[:, None]], axis=1)


def matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dimension)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part: ids and components not null, finite, not all zero."""
    v = F.col("embedding").cast("array<double>")
    ok = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    return ok.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0))


def points(rows: DataFrame, smallest: int) -> DataFrame:
    """(node, v, ids): one row for each different vector, node its smallest id, ids its `smallest` smallest ids in order.

    Tasks merge their own rows before the shuffle, so a vector that is met a million times is one row a task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best: dict[bytes, list[int]] = {}
            d = len(batch.column(1)[0]) if len(batch) else 0
            flat = np.asarray(batch.column(1).flatten(), np.float64).reshape(-1, d) + 0.0 if d else np.zeros((0, 0))
            for i, v in zip(batch.column(0).to_pylist(), flat, strict=True):
                best.setdefault(v.tobytes(), []).append(i)
            yield pa.RecordBatch.from_arrays([pa.array(best.keys(), pa.binary()), pa.array([sorted(x)[:smallest] for x in best.values()], pa.list_(pa.int64()))], names=["v", "ids"])

    part = arrow_map(rows, run, "v binary, ids array<long>")
    merged = part.groupBy("v").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, smallest).alias("ids"))
    return merged.select(F.col("ids")[0].alias("node"), "v", "ids")


def ranked(nodes: DataFrame, dimension: int, longest: float, curves: int) -> DataFrame:
    """(curve, node, rank) of every point on every curve."""
    spread = longest / np.sqrt(dimension + 1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = [Curve(c, dimension + 1, spread) for c in range(curves)]
        for batch in batches:
            x = lifted(matrix(batch.column(1), dimension), longest)
            for c, order in enumerate(orders):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), c), pa.int32()), pa.array(order.keys(x)), batch.column(0)], names=["curve", "key", "node"])

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            n = len(batch)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.full(n, part), pa.int32()), pa.array(np.arange(at, at + n), pa.int64())], names=["curve", "node", "part", "at"])
            at += n

    keyed = materialise(arrow_map(nodes.select("node", "v"), run, "curve int, key long, node long"), "keys")
    ordered = keyed.repartitionByRange(partitions(nodes.sparkSession), "curve", "key", "node").sortWithinPartitions("curve", "key", "node")
    placed = materialise(arrow_map(ordered, place, "curve int, node long, part int, at long"), "places")
    # a row for each written partition and curve
    held = placed.groupBy("part", "curve").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select("part", "curve", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("offset"))
    return materialise(placed.join(offsets, ["part", "curve"]).select("curve", "node", (F.col("at") + F.col("offset")).alias("rank")), "ranks")


def best_of(q: np.ndarray, x: np.ndarray, ids: list[list[int]], k: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each query, the k best of the points' ids by (product, smaller id): ids and exact products."""
    near = min(len(x), k + 8)
    products = q @ x.T
    pick = np.argpartition(-products, near - 1, axis=1)[:, :near] if near < len(x) else np.broadcast_to(np.arange(len(x)), products.shape)
    values = (x[pick] * q[:, None, :]).sum(axis=2)
    if all(len(i) == 1 for i in ids):
        flat = np.array([i[0] for i in ids], np.int64)[pick]
        order = np.lexsort((flat, -values), axis=1)[:, :k]
        return list(np.take_along_axis(flat, order, 1)), list(np.take_along_axis(values, order, 1))
    found, scores = [], []
    for points, value in zip(pick, values, strict=True):
        flat = np.array([j for p in points for j in ids[p]], np.int64)
        value = np.repeat(value, [len(ids[p]) for p in points])
        order = np.lexsort((flat, -value))[:k]
        found.append(flat[order])
        scores.append(value[order])
    return found, scores


def window_tiles(nodes: DataFrame, ranks: DataFrame, queries: DataFrame, dimension: int, k: int, curves: int, tile: int) -> int:
    """Tiles on either side that a query must look at: what holds WISHED_RECALL of the exact neighbours of some queries."""
    some = queries.orderBy(F.xxhash64("node"), "node").limit(CALIBRATION_QUERIES).select("node", "v").collect()
    if not some:
        return 0
    q = np.stack([np.frombuffer(r.v, np.float64) for r in some])
    shipped = nodes.sparkSession.sparkContext.broadcast(q)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, node = matrix(batch.column(1), dimension), batch.column(0).to_numpy()
            if not len(x):
                continue
            products = shipped.value @ x.T
            near = min(len(x), k)
            pick = np.argpartition(-products, near - 1, axis=1)[:, :near]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(pick)), near), pa.int32()), pa.array(node[pick].ravel()), pa.array(np.take_along_axis(products, pick, 1).ravel())], names=["query", "node", "score"])

    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "node"))
    found = arrow_map(nodes.select("node", "v"), run, "query int, node long, score double").withColumn("nth", nth).where(F.col("nth") <= k).select("query", "node").collect()
    # CALIBRATION_QUERIES x (k + 1) ids at most
    wanted = nodes.sparkSession.createDataFrame([(int(x),) for x in {r.node for r in found} | {r.node for r in some}], "node long")
    tile_of = {(r.curve, r.node): r.tile for r in ranks.join(F.broadcast(wanted), "node", "left_semi").select("curve", "node", F.floor(F.col("rank") / tile).alias("tile")).collect()}
    away = [min(abs(tile_of[c, r.node] - tile_of[c, some[r.query].node]) for c in range(curves)) for r in found]
    return int(np.quantile(away, WISHED_RECALL, method="higher"))


def homes_of_queries(asked: DataFrame, ranks: DataFrame, reach: int, tile: int) -> DataFrame:
    """(node, home): the tiles of the first curve that hold a candidate of a query, of the `reach` tiles on either side of its own
    on any curve."""
    where = ranks.select("curve", "node", F.floor(F.col("rank") / tile).cast("int").alias("tile"))
    home = where.where("curve = 0").select("node", F.col("tile").alias("home"))
    # a row a tile, with the homes of its points; then with those of the tiles around it
    held = where.join(home, "node").groupBy("curve", "tile").agg(F.collect_set("home").alias("homes"))
    last = held.groupBy("curve").agg(F.max("tile").alias("last"))
    centres = F.sequence(F.greatest(F.lit(0), F.col("tile") - reach), F.least("last", F.col("tile") + reach))
    near = held.join(F.broadcast(last), "curve").select("curve", F.explode(centres).alias("tile"), "homes")
    around = near.groupBy("curve", "tile").agg(F.array_distinct(F.flatten(F.collect_list("homes"))).alias("homes"))
    of_queries = where.join(asked.select("node"), "node").join(around, ["curve", "tile"])
    return of_queries.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("homes"))).alias("homes")).select("node", F.explode("homes").alias("home"))


def search(vectors: DataFrame, every: int = 20, k: int = 20, curves: int = CURVES, tile: int = TILE_POINTS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector whose id is divisible by `every`, its k nearest found among all
    others of its length, by largest inner product in double precision, ties to the smaller id.

    Vectors null, zero, holding null or non-finite components, or of a null id take no part; vectors of several lengths are
    searched length by length, as products exist within one only. Rows of one id and one vector count as one; rows of one
    id and different vectors are queries and candidates each, and a query does not find its own id. Long vectors cost in
    proportion. An empty table gives no rows; further columns, of any name, are ignored.
    """
    rows = materialise(usable(vectors).dropDuplicates(["vec_id", "v"]), "vectors")
    facts = rows.groupBy(F.size("v").alias("d")).agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).alias("longest"))
    out = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for r in facts.orderBy("d").collect():  # a row a length
        out = out.union(search_length(rows.where(F.size("v") == r.d), r.d, r.longest, every, k, curves, tile))
    return out


def search_length(rows: DataFrame, d: int, longest: float, every: int, k: int, curves: int, tile: int) -> DataFrame:
    """search() among vectors of one length; rows has different (vec_id, v)."""
    nodes = materialise(points(rows, k + 1), "points")
    own = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    asked = materialise(points(own, 1).select("v").join(nodes.select("node", "v"), "v"), "queries")
    ranks = ranked(nodes, d, longest, curves)
    reach = window_tiles(nodes, ranks, asked, d, k, curves, tile)
    looks = materialise(homes_of_queries(asked, ranks, reach, tile), "looks")
    blocks = materialise(looks.groupBy("home").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks")), "blocks")
    home = ranks.where("curve = 0").select("node", F.floor(F.col("rank") / tile).cast("int").alias("home"))
    # a tile's points once for each block of its queries
    data = nodes.join(home, "node").join(blocks, "home").select(F.col("home").alias("in_home"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("in_block"), "v", "ids")
    queries = looks.join(blocks, "home").join(asked, "node").select("home", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"), "node", "v")
    schema = pa.schema([("node", pa.int64()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64()))])

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return schema.empty_table()
        q, x = (np.frombuffer(b"".join(t.column("v").to_pylist()), np.float64).reshape(-1, d) for t in (left, right))
        ids, found = right.column("ids").to_pylist(), ([], [])
        for at in range(0, len(q), 256):
            for all_of, part in zip(found, best_of(q[at : at + 256], x, ids, k + 1), strict=True):
                all_of += part
        return pa.table([left.column("node"), pa.array(found[0], schema.field("ids").type), pa.array(found[1], schema.field("scores").type)], schema=schema)

    partial = queries.groupBy("home", "block").cogroup(data.groupBy("in_home", "in_block")).applyInArrow(compare, "node long, ids array<long>, scores array<double>")
    # a query's lists from its homes, k + 1 from each, hold different points
    ordered = partial.select("node", F.arrays_zip(F.transform("scores", lambda x: -x).alias("less"), F.col("ids").alias("id")).alias("found"))
    best = ordered.groupBy("node").agg(F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k + 1).alias("found"))
    best = materialise(best, "best")

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.asarray(batch.column(1).flatten(), np.float64).reshape(-1, d) + 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tobytes() for v in flat], pa.binary())], names=["query_id", "v"])

    # each query id takes its vector's list without itself
    named = materialise(arrow_map(own.select(F.col("vec_id").alias("query_id"), "v"), packed, "query_id long, v binary"), "own").join(asked, "v").select("query_id", "node")
    lists = named.join(best, "node").select("query_id", F.filter("found", lambda x: x["id"] != F.col("query_id")).alias("found"))
    listed = lists.select("query_id", F.posexplode(F.slice("found", 1, k)).alias("at", "one"))
    return listed.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("one.id").alias("vec_id"), (F.lit(0.0) - F.col("one.less")).alias("score"))


def recall(found: DataFrame, vectors: DataFrame, every: int = 20, k: int = 20) -> float:
    """Share of the exact k nearest of a small table that `found` has; for tests and measurements."""
    rows = usable(vectors).dropDuplicates(["vec_id", "v"]).toPandas().sort_values("vec_id")
    got = found.groupBy("query_id").agg(F.collect_set("vec_id").alias("ids")).toPandas().set_index("query_id")["ids"].to_dict()
    hit = total = 0
    for _, alike in rows.groupby(rows["v"].map(len)):
        x, ids = np.stack(alike["v"].to_list()), alike["vec_id"].to_numpy()
        for i in np.flatnonzero(ids % every == 0):
            s = (x * x[i]).sum(axis=1)
            order = np.lexsort((ids, -s))
            true = ids[order[order != i]][:k].tolist()
            hit, total = hit + len(set(true) & set(got.get(ids[i], []))), total + len(true)
    return hit / max(total, 1)
