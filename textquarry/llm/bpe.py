"""Byte-level BPE encoding and decoding with a minimal acyclic transducer as lexicon.

Frequent words of the corpus, of one id or several, are compiled with their ids into a minimal automaton that shares
suffixes, beside the vocabulary's own words; the words accepted before a path number the word, and the number leads to its
ids. The automaton is a few flat arrays in one file, which a worker maps into memory. Every word is looked for in it first;
many walk it at a time, one byte a step. Words that it lacks are merged exactly, by rank, and a worker remembers what it
has merged, up to a bound.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import struct
import tempfile
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordMemo, arrow_map, kept_in_worker, text_slices, text_strings

#: Bytes that a worker's memory of merged words may take; it starts anew beyond that.
MEMO_BYTES = 48 << 20
#: The lexicon's frequent words are the commonest of all documents, so many at most: a bound that results do not depend on, as
#: all other words are merged. A task reports its counts when it has so many times as many different words.
FREQUENT_WORDS, HELD_WORDS = 30_000, 4
#: Characters of texts that are encoded at a time.
GROUP = 1 << 20
#: Words of more symbols are merged with a heap.
LONG_WORD = 48
NO_RANK = 1 << 40

# Fixed values of the word pattern: what counts as white space in it.
WHITE_SPACE = r"\t-\r \x85\xa0  -     　"


def word_pattern(letters: str, numbers: str) -> str:
    """The pre-tokenizer's pattern over given classes of letters and numbers."""
    s = WHITE_SPACE
    return rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{s}{letters}{numbers}]+|[{s}]+(?![^{s}])|[{s}]+"


def latin_classes(limit: int) -> tuple[str, str]:
    """Regex classes of the letters and numbers below a code point."""
    of = {kind: "".join(rf"\u{c:04x}" for c in range(limit) if unicodedata.category(chr(c))[0] == kind) for kind in "LN"}
    return of["L"], of["N"]


LATIN_END = 0x250


class WordSplitter:
    """Words of a text; texts of Latin letters alone take a faster engine with the same classes spelled out."""

    def __init__(self) -> None:
        import regex

        self.latin = re.compile(word_pattern(*latin_classes(LATIN_END))).findall
        self.any = regex.compile(word_pattern(r"\p{L}", r"\p{N}")).findall
        self.beyond = re.compile(rf"[^\x00-\u{LATIN_END - 1:04x}]").search

    def __call__(self, text: str) -> list[str]:
        return self.any(text) if self.beyond(text) else self.latin(text)


def byte_symbols() -> list[str]:
    """The character by which byte-level vocabularies write each byte: itself if it prints, else one past 255 in turn."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(rest)) for b in range(256)]


class Merges:
    """Merge ranks over ids, and the bytes of every id."""

    def __init__(self, spec: dict):
        model = spec["model"]
        back = {c: b for b, c in enumerate(byte_symbols())}
        size = max([*model["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_bytes = [b""] * size
        for text, i in model["vocab"].items():
            self.token_bytes[i] = text.encode() if text in self.special else bytes(back[c] for c in text)
        for text, i in self.special.items():
            self.token_bytes[i] = text.encode()
        self.token_set = set(self.token_bytes)
        self.byte_ids = [model["vocab"][c] for c in byte_symbols()]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs[model["vocab"][a], model["vocab"][b]] = (rank, model["vocab"][a + b])
        keys = np.array([a << 32 | b for a, b in self.pairs] or [0], np.uint64)
        found = np.array([rank for rank, _ in self.pairs.values()] or [NO_RANK], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], found[order]
        self.merged = np.zeros(len(model["merges"]) + 1, np.uint32)
        for rank, new in self.pairs.values():
            self.merged[rank] = new
        self.byte_table = np.array(self.byte_ids, np.uint32)

    def merge(self, word: bytes) -> list[int]:
        """Ids of a word: the pair of lowest rank, leftmost first, is merged until none is left."""
        ids, pairs = [self.byte_ids[b] for b in word], self.pairs
        if len(ids) > LONG_WORD:
            return self.merge_long(ids)
        while len(ids) > 1:
            best, at = None, -1
            for i in range(len(ids) - 1):
                found = pairs.get((ids[i], ids[i + 1]))
                if found is not None and (best is None or found < best):
                    best, at = found, i
            if best is None:
                break
            ids[at : at + 2] = [best[1]]
        return ids

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """Ids of many words, as bytes: all words of one length go through their merges side by side."""
        out: list[bytes] = [b""] * len(words)
        by_length: dict[int, list[int]] = {}
        for k, word in enumerate(words):
            by_length.setdefault(len(word), []).append(k)
        for length, all_places in by_length.items():
            if length > LONG_WORD:
                for k in all_places:
                    out[k] = np.array(self.merge(words[k]), np.uint32).tobytes()
                continue
            for at in range(0, len(all_places), 1 << 15):
                places = all_places[at : at + (1 << 15)]
                ids = self.byte_table[np.frombuffer(b"".join(words[k] for k in places), np.uint8).reshape(-1, length)]
                ranks = self.ranks(ids[:, :-1], ids[:, 1:])
                size, rows = np.full(len(ids), length), np.arange(len(ids))
                columns = np.arange(length)
                while length > 1 and len(rows):
                    j = ranks[rows].argmin(axis=1)
                    best = ranks[rows, j]
                    rows, j, best = (x[best < NO_RANK] for x in (rows, j, best))
                    if not len(rows):
                        break
                    old, shift = ids[rows], columns[None, :] + (columns[None, :] > j[:, None])
                    shift[:, -1] = np.minimum(shift[:, -1], length - 1)
                    new = np.take_along_axis(old, shift, 1)
                    here = np.arange(len(rows))
                    new[here, j] = self.merged[best]
                    size[rows] -= 1
                    moved = columns[None, : length - 1] + (columns[None, : length - 1] > j[:, None])
                    moved_ranks = np.where(moved < length - 1, np.take_along_axis(ranks[rows], np.minimum(moved, length - 2), 1), NO_RANK)
                    right = j + 1 < size[rows]
                    moved_ranks[here, np.minimum(j, length - 2)] = np.where(j < length - 1, NO_RANK, moved_ranks[here, np.minimum(j, length - 2)])
                    moved_ranks[here[right], j[right]] = self.ranks(new[here[right], j[right]], new[here[right], j[right] + 1])
                    left = j > 0
                    moved_ranks[here[left], j[left] - 1] = self.ranks(new[here[left], j[left] - 1], new[here[left], j[left]])
                    ids[rows], ranks[rows] = new, moved_ranks
                for k, row, n in zip(places, ids, size.tolist(), strict=True):
                    out[k] = row[:n].tobytes()
        return out

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, NO_RANK for those that do not merge."""
        key = a.astype(np.uint64) << np.uint64(32) | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NO_RANK)

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over a linked list, for words of any length."""
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(*found, i) for i in range(n - 1) if (found := self.pairs.get((ids[i], ids[i + 1])))]
        heap = [(rank, i, new) for rank, new, i in heap]
        heapq.heapify(heap)
        while heap:
            rank, i, new = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or self.pairs.get((ids[i], ids[j])) != (rank, new):
                continue
            ids[i], alive[j], after[i] = new, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] < n and (found := self.pairs.get((ids[left], ids[after[left]]))):
                    heapq.heappush(heap, (found[0], left, found[1]))
        return [x for x, keep in zip(ids, alive, strict=True) if keep]


def build_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """A file of the minimal acyclic transducer of the words and their ids.

    Words are added in order; when a branch is left, its states are merged with equal ones (same finality, same
    transitions), so suffixes are shared. Transitions are stored by (state, byte) with their targets and the number of
    words that come before theirs, so a path's sum is the word's place in order, and that leads to its ids.
    """
    final: list[bool] = [False]
    edges: list[dict[int, int]] = [{}]
    register: dict[tuple, int] = {}
    path: list[tuple[int, int]] = []

    def settle(depth: int) -> None:
        while len(path) > depth:
            parent, byte = path.pop()
            child = edges[parent][byte]
            key = (final[child], tuple(edges[child].items()))
            edges[parent][byte] = register.setdefault(key, child)

    ordered, previous = sorted(words), b""
    for word in ordered:
        common = len(os.path.commonprefix([word, previous]))
        settle(common)
        state = edges[path[-1][0]][path[-1][1]] if path else 0
        for byte in word[common:]:
            edges.append({})
            final.append(False)
            edges[state][byte] = len(edges) - 1
            path.append((state, byte))
            state = len(edges) - 1
        final[state] = True
        previous = word
    settle(0)

    number, order, below = {0: 0}, [0], {}
    for state in order:
        for target in edges[state].values():
            if target not in number:
                number[target] = len(order)
                order.append(target)

    def count(top: int) -> int:
        stack = [top]
        while stack:
            state = stack[-1]
            todo = [t for t in edges[state].values() if t not in below]
            if todo:
                stack += todo
            else:
                below[state] = final[state] + sum(below[t] for t in edges[state].values())
                stack.pop()
        return below[top]

    count(0)
    keys, targets, skips = [], [], []
    for state in order:
        passed = int(final[state])
        for byte in sorted(edges[state]):
            target = edges[state][byte]
            keys.append(number[state] << 8 | byte)
            targets.append(number[target])
            skips.append(passed)
            passed += below[target]
    sizes = [len(words[w]) for w in ordered]
    arrays = [np.array(keys, "<u4"), np.array(targets, "<u4"), np.array(skips, "<u4"), np.array([final[s] for s in order], "u1"), np.cumsum([0, *sizes]).astype("<u4"), np.array([i for w in ordered for i in words[w]], "<u4")]
    return struct.pack("<6Q", *map(len, arrays)) + b"".join(a.tobytes() for a in arrays)


class Lexicon:
    """A lexicon file, mapped into memory."""

    def __init__(self, path: str):
        sizes = struct.unpack("<6Q", open(path, "rb").read(48))
        at, out = 48, []
        for n, kind in zip(sizes, ("<u4", "<u4", "<u4", "u1", "<u4", "<u4"), strict=True):
            out.append(np.memmap(path, kind, "r", at, (n,)) if n else np.zeros(0, kind))
            at += n * np.dtype(kind).itemsize
        self.keys, self.targets, self.skips, self.final, self.offsets, self.ids = out

    def find(self, words: list[bytes]) -> np.ndarray:
        """The place of each word in the lexicon's order, or -1."""
        lengths = np.array([len(w) for w in words], np.int64)
        starts = np.cumsum(lengths) - lengths
        flat = np.frombuffer(b"".join(words), np.uint8)
        state, place, here = np.zeros(len(words), np.uint32), np.zeros(len(words), np.int64), np.arange(len(words))
        found = np.full(len(words), -1, np.int64)
        step = 0
        while len(here):
            ended = lengths[here] == step
            done = here[ended & (self.final[state[here]] > 0)] if len(self.final) else here[:0]
            found[done] = place[done]
            here = here[~ended]
            if not len(here) or not len(self.keys):
                break
            key = state[here] << np.uint32(8) | flat[starts[here] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there = self.keys[at] == key
            here, at = here[there], at[there]
            state[here] = self.targets[at]
            place[here] += self.skips[at]
            step += 1
        return found

    def ids_of(self, place: int) -> np.ndarray:
        return self.ids[self.offsets[place] : self.offsets[place + 1]]


def lexicon_words(merges: Merges, extra: Iterable[bytes] = ()) -> dict[bytes, list[int]]:
    """The words of the lexicon: every vocabulary entry that is one word of its own, and further frequent words with all of
    their ids. The former's number does not grow with the corpus; the latter's is bounded by the caller."""
    out = {}
    for word in [*merges.token_bytes, *extra]:
        if word and word not in out and len(word) <= LONG_WORD:
            ids = merges.merge(word)
            if len(ids) == 1 or word not in merges.token_set:
                out[word] = ids
    return out


def frequent_words(docs: DataFrame, documents: int | None = None, most: int = FREQUENT_WORDS) -> list[bytes]:
    """The commonest words of docs, counted over all texts: those met three times and more, `most` of them, ties by the word.
    With `documents`, of about so many documents only, chosen by a hash of their id. Tasks hold few words at a time and report
    their counts whenever they have more, so none is lost."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, found = WordSplitter(), Counter()

        def counts() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for t in text_strings(batch.column(0)):
                found.update([w for w in split(t) if len(w) <= LONG_WORD])
                if len(found) > HELD_WORDS * most:
                    yield counts()
                    found.clear()
        yield counts()

    texts = docs
    if documents is not None:
        scale = 1 << 40
        texts = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < min(scale, scale * documents // max(1, docs.count())))
    counted = arrow_map(texts.select(F.col("text").cast("string").alias("text")), count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 2")
    return [r.word.encode() for r in counted.orderBy(F.desc("n"), "word").limit(most).collect()]


def mapped_lexicon(data: bytes) -> Lexicon:
    """The lexicon of a file's bytes, mapped into memory; the file has no name any more once it is mapped, so none is left."""
    with tempfile.NamedTemporaryFile(prefix="lexicon-") as file:
        file.write(data)
        file.flush()
        return Lexicon(file.name)


class Encoder:
    """Texts to ids and back."""

    def __init__(self, merges: Merges, lexicon: Lexicon, memo_bytes: int = MEMO_BYTES):
        self.merges, self.lexicon, self.split = merges, lexicon, WordSplitter()
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(merges.special, key=len, reverse=True))) + ")") if merges.special else None
        self.memo = WordMemo(merges.merge_many, memo_bytes)
        self.ids, self.ends = lexicon.ids.tobytes(), (lexicon.offsets.astype(np.int64) * 4).tolist()

    def words(self, text: str) -> list[str]:
        """Words of a text; a special token's content is one word, marked by a character that no text can hold."""
        if self.specials is None or not self.specials.search(text):
            return self.split(text)
        out: list[str] = []
        for k, piece in enumerate(self.specials.split(text)):
            out += ["\ud800" + piece] if k % 2 else self.split(piece)
        return out

    def resolve(self, words: list[str]) -> dict[str, bytes]:
        """Ids of different words, as bytes: from the automaton, or merged."""
        out = {w: np.uint32(self.merges.special[w[1:]]).tobytes() for w in words if w[0] == "\ud800"}
        plain = [w for w in words if w not in out] if out else words
        raw = [w.encode() for w in plain]
        unseen, ends, ids = [], self.ends, self.ids
        for k, place in enumerate(self.lexicon.find(raw).tolist()):
            if place >= 0:
                out[plain[k]] = ids[ends[place] : ends[place + 1]]
            else:
                unseen.append(k)
        if unseen:
            out.update(zip([plain[k] for k in unseen], self.memo.get([raw[k] for k in unseen]), strict=True))
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts: each different word of them is looked for once."""
        words = [self.words(t) for t in texts]
        known = self.resolve(list(set().union(*words))).__getitem__
        return [np.frombuffer(b"".join(map(known, w)), np.uint32) for w in words]

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; bytes that are no UTF-8 become the replacement character."""
        return b"".join(map(self.merges.token_bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


def shipped_encoder(docs: DataFrame, tokenizer_path: str, extra: Iterable[bytes] | None = None, memo_bytes: int = MEMO_BYTES):
    """A function that gives a worker its Encoder, with the frequent words of docs in its lexicon, or `extra` in their place;
    what is broadcast has the size of the vocabulary and of these words, which are bounded."""
    with open(tokenizer_path, encoding="utf-8") as file:
        text = file.read()
    lexicon = build_lexicon(lexicon_words(Merges(json.loads(text)), frequent_words(docs) if extra is None else extra))
    shipped = docs.sparkSession.sparkContext.broadcast((text, lexicon))

    name = uuid.uuid4().hex

    def make() -> Encoder:
        spec, data = shipped.value
        return Encoder(Merges(json.loads(spec)), mapped_lexicon(data), memo_bytes)

    def kept() -> Encoder:
        return kept_in_worker(name, make)

    return kept


def text_groups(texts: list[str], size: int = GROUP) -> Iterator[list[str]]:
    """Texts in turn, about `size` characters at a time."""
    group, load = [], 0
    for t in texts:
        group.append(t)
        load += len(t)
        if load >= size:
            yield group
            group, load = [], 0
    if group:
        yield group


def encode_documents(docs: DataFrame, tokenizer_path: str, extra: Iterable[bytes] | None = None) -> DataFrame:
    """(doc_id, ids, decoded): ids of the whole text and what they decode to; rows and texts as in encode_digest."""
    make = shipped_encoder(docs, tokenizer_path, extra)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make()
        for batch in (part for whole in batches for part in text_slices(whole, 1)):
            at = 0
            for group in text_groups(text_strings(batch.column(1))):
                ids = encoder.encode(group)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(group)), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array([encoder.decode(x) for x in ids], pa.string())], names=["doc_id", "ids", "decoded"])
                at += len(group)

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, ids array<int>, decoded string")


def encode_digest(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row a document: doc_id, n_tokens, ids_sha256, decoded_sha256. Repeated rows, and rows of one id or of none, give a
    row each; an empty table gives none; null and empty texts have no tokens; texts may be of any length, and words too: those
    of many bytes are merged with a heap. Pairs of equal rank (ties) merge leftmost first. Further columns, of any name, are
    ignored."""
    make = shipped_encoder(docs, tokenizer_path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make()
        for batch in (part for whole in batches for part in text_slices(whole, 1)):
            at = 0
            for group in text_groups(text_strings(batch.column(1))):
                ids = encoder.encode(group)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(group)),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
                        pa.array([hashlib.sha256(encoder.decode(x).encode()).hexdigest() for x in ids], pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
                at += len(group)

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
