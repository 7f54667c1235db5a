"""Benchmark decontamination by template canonicalisation.

Words become templates: numbers, names (capitalised words inside a sentence, and first words of sentences that are such
elsewhere in the text) and units after numbers turn into typed placeholders, other words into their lower-case letters
without edge punctuation. Windows of templates of documents and benchmark items meet in a hash join. Matches of one
document and item on one diagonal form a passage, and passages on near diagonals one copy; its slots must fit: each value
of the item's slots stands for one value of the document's, and each of these for one of the item's. So copies are found,
and questions with other numbers or names, while windows that agree by accident are not.

Items that differ in the values of their slots alone are one class, in which the smallest id stands for all.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import WordMemo, arrow_map, bloom_filter, in_filter, kept_in_worker, materialise, split_words, text_slices
from .substring import window_hashes

#: Words in a window; literal words that it must hold to match by placeholders; the share of literal words that one window
#: of a passage must have; words of a matched passage from which a document counts as contaminated, and the share of a
#: shorter item's windows.
WINDOW, LEAST_LITERAL, LITERAL_SHARE, PASSAGE_WORDS, SHARE = 8, 2, 0.6, 13, 0.5
#: Items of fewer words are not looked for.
LEAST_WORDS = 4
#: Bits of the filter of benchmark windows that documents are tried against before the join; its size is fixed.
FILTER_BITS = 1 << 23
#: Bytes that a worker's memory of words may take, and bytes of text that it cuts at a time.
MEMO_BYTES, SLICE_BYTES = 48 << 20, 1 << 21
NUMBER, NAME, UNIT = 1, 2, 3
KINDS = {NUMBER: xxh64_intdigest(b"<number>", 3), NAME: xxh64_intdigest(b"<name>", 3), UNIT: xxh64_intdigest(b"<unit>", 3)}
UNITS = frozenset("mm cm m km kg g mg lb oz l ml inch inches foot feet mile miles meter meters metre metres kilometer kilometers gram grams pound pounds liter liters litre litres second seconds minute minutes hour hours day days week weeks month months year years dollar dollars cent cents euro euros percent degree degrees mph kmh".split())
IS_NUMBER = re.compile(r"[$€£+-]?\d[\d.,:/]*%?$").match
EDGE = re.compile(r"^[\W_]+|[\W_]+$").sub
TEMPLATE = np.dtype([("hash", "<u8"), ("kind", "u1"), ("ends", "u1")])


def template(word: bytes) -> bytes:
    """A word's literal hash, what else it may be (number, name, unit after a number), and whether a sentence ends."""
    text = word.decode()
    core = EDGE("", text)
    kind = NUMBER if IS_NUMBER(core or text) else NAME if core[:1].isupper() else UNIT if core.lower() in UNITS else 0
    ends = text.rstrip("\"')]}»”")[-1:] in ".!?:;"
    return np.array([(xxh64_intdigest((core or text).lower().encode(), 3), kind, ends)], TEMPLATE).tobytes()


def template_kinds(rows: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Placeholder kinds (0: literal) of the words of texts in a row, text k from bounds[k] to bounds[k + 1]: with first
    words of sentences names if they are capitalised inside a sentence of their text too, and with all capitalised ones names."""
    n = len(rows)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(0, np.uint8)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    first = np.r_[True, rows["ends"][:-1] > 0]
    first[bounds[:-1][bounds[:-1] < n]] = True
    after = np.r_[False, rows["kind"][:-1] == NUMBER]
    after[bounds[:-1][bounds[:-1] < n]] = False
    named = rows["kind"].copy()
    named[(named == UNIT) & ~after] = 0
    is_name = named == NAME
    # of a text, the names inside sentences
    own = rows["hash"] ^ (text.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    lone = np.flatnonzero(is_name & first)
    typed = named.copy()
    typed[lone[~np.isin(own[lone], own[is_name & ~first])]] = 0
    return typed, named


def template_hashes(rows: np.ndarray, kind: np.ndarray) -> np.ndarray:
    out = rows["hash"].copy()
    for k, h in KINDS.items():
        out[kind == k] = h
    return out


def templates(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Template hash and placeholder kind (0: literal) of the words of one text."""
    kind = template_kinds(rows, np.array([0, len(rows)]))[0]
    return template_hashes(rows, kind), kind


def within(marks: np.ndarray, width: int) -> np.ndarray:
    """How many of marks[i:i+width] are set, for every i that has so many."""
    total = np.r_[0, np.cumsum(marks)]
    return total[width:] - total[:-width]


def pattern_hash(hashes: np.ndarray, kinds: np.ndarray, values: list[str]) -> int:
    """What items of one class have in common: their words, and where slots hold the same value."""
    number: dict[str, int] = {}
    form = [f"{int(h)}" if not k else f"<{k}.{number.setdefault(v, len(number))}>" for h, k, v in zip(hashes, kinds, values, strict=True)]
    return xxh64_intdigest(" ".join(form).encode(), 5)


WINDOWS = pa.schema([("key", pa.int64()), ("pattern", pa.int64()), ("width", pa.int32()), ("hash", pa.int64()), ("at", pa.int32()), ("n_windows", pa.int32()), ("anchor", pa.bool_()), ("verbatim", pa.bool_()), ("slots", pa.list_(pa.string()))])


def windows(table: DataFrame, key: str, widths: list[int] | None, shipped=None) -> DataFrame:
    """(key, pattern, width, hash, at, n_windows, anchor, verbatim, slots) of windows; widths None: of items, WINDOW or the
    whole of a shorter text, with the pattern that their class shares. With a shipped filter, of those that it passes alone.

    Every window is there by its lower-cased words (verbatim, no slots), and by its template if that has placeholders and
    LEAST_LITERAL literal words, with sentences' first words as words or known names, and as names. Slots are the values
    under placeholders, by place; an anchor has LITERAL_SHARE of literal words.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = kept_in_worker("templates", lambda: WordMemo(lambda v: [template(w) for w in v], MEMO_BYTES))
        for batch in (part for whole in batches for part in text_slices(whole, 1, SLICE_BYTES)):
            bounds, index, distinct = split_words(pc.fill_null(batch.column(1), ""))
            records = np.frombuffer(b"".join(memo.get(distinct)), TEMPLATE)[index]
            typed, named = template_kinds(records, bounds)
            sizes, keys = np.diff(bounds), batch.column(0).to_pylist()
            value = lambda i, kinds: f"{kinds[i]}:{EDGE('', distinct[index[i]].decode()).lower()}"  # noqa: E731, B023
            pattern = np.zeros(len(batch), np.int64)
            if widths is None:
                hashes = template_hashes(records, typed)
                for k, (s, e) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                    h = pattern_hash(hashes[s:e], typed[s:e], [value(i, typed) if typed[i] else "" for i in range(s, e)])
                    pattern[k] = np.uint64(h).astype(np.int64)
            rows = []
            for width in range(1, WINDOW + 1) if widths is None else widths:
                if width < LEAST_WORDS or len(records) < width:
                    continue
                # texts whose windows have this width; of items, those that are as short as that
                fit = np.minimum(sizes, WINDOW) == width if widths is None else sizes >= width
                if not fit.any():
                    continue
                count = np.where(fit, sizes - width + 1, 0)
                text = np.repeat(np.arange(len(sizes)), count)
                place = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
                flat = bounds[:-1][text] + place
                least = math.ceil(LITERAL_SHARE * width)
                for kinds in (None, typed, named):
                    if kinds is named and not (named != typed).any():
                        continue
                    found = window_hashes(records["hash"].copy() if kinds is None else template_hashes(records, kinds), width)[flat]
                    literal = within((typed if kinds is None else kinds) == 0, width)[flat]
                    ok = np.ones(len(flat), bool)
                    if kinds is not None:
                        ok = (literal >= min(LEAST_LITERAL, least)) & (literal < width)
                        if kinds is named:
                            ok &= within(named != typed, width)[flat] > 0
                    if shipped is not None:
                        ok &= in_filter(found, shipped.value)
                    for p in np.flatnonzero(ok).tolist():
                        i = int(flat[p])
                        slots = [] if kinds is None else [value(j, kinds) for j in range(i, i + width) if kinds[j]]
                        t = int(text[p])
                        rows.append({"key": keys[t], "pattern": int(pattern[t]), "width": width, "hash": int(found[p].astype(np.int64)), "at": int(place[p]), "n_windows": int(count[t]), "anchor": bool(literal[p] >= least), "verbatim": kinds is None, "slots": slots})
            yield pa.RecordBatch.from_pylist(rows, schema=WINDOWS)

    return arrow_map(table.select(F.col(key).cast("long").alias("key"), F.col("text").cast("string").alias("text")), run, "key long, pattern long, width int, hash long, at int, n_windows int, anchor boolean, verbatim boolean, slots array<string>")


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, items, width, hash, at, n_windows, anchor, verbatim, slots): of each class of items, under its smallest id, the
    windows of that item by placeholders and the different windows of all of them as they stand."""
    every = materialise(windows(benchmark.where("item_id is not null"), "item_id", None), "items")
    classes = every.groupBy("pattern", "n_windows").agg(F.min("key").alias("item_id"), F.count_distinct("key").alias("items"))
    # by shuffle or broadcast as Spark finds: the benchmark's own rows on both sides
    joined = every.join(classes, ["pattern", "n_windows"])
    kept = joined.where("verbatim or key = item_id").select("item_id", "items", "width", "hash", "at", "n_windows", "anchor", "verbatim", "slots")
    return materialise(kept.dropDuplicates(["item_id", "width", "hash", "at", "verbatim"]), "classes")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and class of items that it holds: doc_id, item_id (the class's smallest), items (how many the
    class has), matched_windows, item_windows, coverage and exact (it stands as one of the items does).

    A passage counts if its slots fit, both ways, and it is 13 words or more, or half of the item's windows. Passages whose
    diagonals lie closer together than half the item are parts of one copy: their slots must fit together, else none of
    them counts; of passages that take the same places the longest counts. Null and empty texts hold nothing; texts may be of any length; items of fewer than four words are not
    looked for; passages without a window of enough literal words are found as they stand alone; rows with a null id are
    left out; repeated rows, and rows of one id, count as one document. Ties cannot arise; empty tables give no rows;
    further columns, of any name, are ignored.
    """
    spark = docs.sparkSession
    items = item_windows(benchmark)
    # a whole item shorter than a window is a window of its own length: at most WINDOW different ones
    widths = sorted(r.width for r in items.select("width").distinct().collect())
    shipped = spark.sparkContext.broadcast(bloom_filter(items.select("hash"), FILTER_BITS))
    hits = windows(docs.where("doc_id is not null"), "doc_id", widths, shipped).select(F.col("key").alias("doc_id"), "width", "hash", F.col("at").alias("doc_at"), F.col("slots").alias("doc_slots"))
    pairs = hits.join(items, ["width", "hash"])
    # verbatim windows form passages of their own, which need no slots, and are part of those of templates too
    both = F.explode(F.when(F.col("verbatim"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False))))
    filled = pairs.select("doc_id", "item_id", "items", "width", "n_windows", "at", "anchor", both.alias("verbatim"), (F.col("doc_at") - F.col("at")).alias("diagonal"), F.arrays_zip(F.col("slots").alias("item"), F.col("doc_slots").alias("doc")).alias("slots"))
    key = ["doc_id", "item_id", "items", "n_windows", "width", "verbatim"]
    passages = filled.groupBy(*key, "diagonal").agg(F.collect_set("at").alias("at"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"), F.max("anchor").alias("anchor"))
    # passages of one copy: their diagonals follow each other at less than half the item's length
    along = Window.partitionBy(*key).orderBy("diagonal")
    far = F.col("diagonal") - F.lag("diagonal").over(along) >= F.greatest((F.col("n_windows") + F.col("width") - 1) / 2, F.lit(1))
    numbered = passages.withColumn("far", F.coalesce(far, F.lit(True)).cast("int")).withColumn("copy", F.sum("far").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    # the longest passage is the copy's main one; others belong to it if they take other places of the item and of the document
    main = F.first(F.struct("at", "diagonal")).over(Window.partitionBy(*key, "copy").orderBy(F.desc(F.size("at")), "diagonal"))
    places = lambda at, diagonal: F.transform(at, lambda x: x + diagonal)
    beside = ~F.arrays_overlap("at", "main.at") & ~F.arrays_overlap(places(F.col("at"), F.col("diagonal")), places(F.col("main.at"), F.col("main.diagonal")))
    parts = numbered.withColumn("main", main).where((F.col("diagonal") == F.col("main.diagonal")) | beside)
    long_enough = (F.array_max("at") - F.array_min("at") + F.col("width") >= PASSAGE_WORDS) & (F.size("at") >= PASSAGE_WORDS - F.col("width") + 1)
    copies = parts.groupBy(*key, "copy").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"), F.array_distinct(F.flatten(F.collect_list("slots"))).alias("slots"), F.max(long_enough).alias("long_enough"), F.max("anchor").alias("anchor"))
    of = lambda side: F.size(F.array_distinct(F.transform("slots", lambda s: s[side])))
    fits = (F.size("slots") == of("item")) & (F.size("slots") == of("doc"))
    covered = copies.where(fits & (F.col("verbatim") | F.col("anchor"))).select("doc_id", "item_id", "items", F.size("at").alias("matched_windows"), F.col("n_windows").alias("item_windows"), (F.size("at") / F.col("n_windows")).alias("coverage"), "long_enough", F.col("verbatim").alias("exact"))
    counted = covered.where(F.col("long_enough") | (F.col("coverage") >= SHARE))
    best = counted.groupBy("doc_id", "item_id", "items").agg(F.max(F.struct("coverage", "matched_windows", "item_windows")).alias("best"), F.max("exact").alias("exact"))
    return best.select("doc_id", "item_id", F.col("items").cast("long").alias("items"), "best.matched_windows", "best.item_windows", "best.coverage", "exact")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold an item, as contaminated() finds them: all rows of such an id go; rows with a null id,
    null and empty texts stay; repeated rows stay or go together; columns of any name stay as they are."""
    gone = materialise(contaminated(docs, benchmark).select("doc_id").distinct(), "contaminated")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
