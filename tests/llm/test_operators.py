"""The ten operators against brute force, exact round trips or held-out accuracy, and on awkward rows."""

from __future__ import annotations

import hashlib
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from textquarry.llm import ann, bpe, decontam, langid, pipeline, quality, sharding, simhash, substring, tokenfile, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
DATA = "/root/testdata/sf0.1"
needs_data = pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


VOCABULARY = [a + b for a in ("re", "sta", "on", "mi", "qua", "le") for b in ("tion", "ver", "dle", "sh", "po", "net", "x")]


def corpus() -> list[tuple]:
    """Plain texts, exact and near copies, shared passages, and null, blank, short, long and non-ASCII ones."""
    rng = random.Random(5)
    texts = [sentence(rng, rng.randint(30, 120)) for _ in range(30)]
    shared = sentence(rng, 40)
    texts += [texts[0], texts[0], texts[1].upper(), texts[2] + " more", shared + " " + texts[3], texts[4] + "\n" + shared + "\tend"]
    texts += [None, "", " \n\t ", "one", "one two", "Œuvre café ñandú 日本 🙂", sentence(rng, 25) * 2, "same " * 60, "<|endoftext|> x", sentence(rng, 20000)]
    return [(i * 3, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(4).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def awkward(spark):
    """Repeated rows, a null id, an id of two texts, null languages, and columns that clash with names used inside."""
    rows = [(1, "a b c d e f", None), (1, "a b c d e f", None), (None, "a b c d e f", "en"), (None, None, None), (2, None, "en"), (2, "g h i", "en"), (3, "", "en")]
    extra = ["fp", "key", "starts", "ends", "vslot", "score", "hash", "bucket", "node", "group_id"]
    return spark.createDataFrame([(i, t, l, "s", None, *["x"] * len(extra)) for i, t, l in rows], SCHEMA + "".join(f", {c} string" for c in extra))


def brute_fingerprint(text: str | None) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def brute_components(prints: dict[int, int], distance: int = 3) -> dict[int, int]:
    parent = {i: i for i in prints}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(prints)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= distance:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("limit", [simhash.BUCKET_LIMIT, 2])
def test_simhash_components(docs, limit):
    prints = {i: brute_fingerprint(t) for i, t, *_ in corpus()}
    got = simhash.near_duplicate_components(docs, bucket_limit=limit).collect()
    assert {r.doc_id: r.fp & (1 << 64) - 1 for r in got} == prints
    assert {r.doc_id: r.component_id for r in got} == brute_components(prints)


def test_simhash_links_of_a_dense_ball(spark):
    """Many fingerprints a few bits apart fill buckets beyond the limit; components stay exact."""
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(3)]
    values = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(120)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "fp long")
    want = brute_components({i: v for i, v in enumerate(values)})
    for limit in (4, 4096):
        links = [(r.a, r.b) for r in simhash.link_fingerprints(frame, 3, limit).collect()]
        assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 3 for a, b in links)
        parent = {v: v for v in signed}

        def find(v, parent=parent):
            while parent[v] != v:
                v = parent[v]
            return v

        for a, b in links:
            parent[find(a)] = find(b)
        groups = {frozenset(i for i, v in enumerate(signed) if find(v) == r) for r in {find(v) for v in signed}}
        assert groups == {frozenset(i for i in want if want[i] == r) for r in set(want.values())}


def test_simhash_stage_keeps_one_of_each_group(docs):
    kept = {r.doc_id for r in simhash.drop_near_duplicates(docs).select("doc_id").collect()}
    texts = {i: t for i, t, *_ in corpus()}
    gone = set(texts) - kept
    assert {90, 93, 96, 99} <= gone  # exact, exact, other case, one word more
    assert all(i in kept for i in range(0, 90, 3))


def shingle_set(text: str, size: int = 5) -> set:
    words = text.lower().split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def edited(rng: random.Random, text: str, edits: int) -> str:
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def brute_similar_components(texts: dict[int, str]) -> tuple[dict[int, int], list[float]]:
    sets = {i: shingle_set(t) for i, t in texts.items()}
    root, linked = {i: i for i in texts}, []
    for b in sorted(texts):
        for a in (i for i in texts if i < b):
            both = len(sets[a] & sets[b])
            j = both / (len(sets[a]) + len(sets[b]) - both)
            if j >= 0.8:
                linked.append(j)
                x, y = sorted((root[a], root[b]))
                root = {i: x if r == y else r for i, r in root.items()}
    return root, linked


def test_near_duplicate_groups_reach_every_pair_of_the_similarity(spark):
    """Pairs of all similarities from under 0.8 to 1 against brute force."""
    rng = random.Random(12)
    base = [sentence(rng, rng.randint(120, 300)) for _ in range(60)]
    texts = dict(enumerate(base + [edited(rng, t, 1 + i % 8) for i, t in enumerate(base)]))
    want, linked = brute_similar_components(texts)
    assert all(sum(lo <= j < lo + 0.05 for j in linked) >= 3 for lo in (0.8, 0.85, 0.9, 0.95)) and len(linked) < 60
    got = simhash.near_duplicate_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: r.group_id for r in got} == want


@pytest.mark.parametrize("options", [{}, {"bucket_limit": 3}])
def test_near_duplicate_groups_of_crowded_buckets(spark, options):
    """Copies of one text that are similar to some of the others only, in buckets beyond the limit, against brute force."""
    rng = random.Random(13)
    base = sentence(rng, 400)
    texts = {0: base}
    for i in range(1, 90):
        texts[i] = edited(rng, base if i % 3 else texts[rng.randrange(i)], rng.randint(6, 14))
    want, _ = brute_similar_components(texts)
    assert 5 < len(set(want.values())) < 85
    got = simhash.near_duplicate_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), **options).collect()
    assert {r.doc_id: r.group_id for r in got} == want


def test_pipeline_drops_what_fingerprints_or_sets_link(spark):
    """Pairs that only fingerprints link, that only sets link, and that both do, against brute force over both."""
    rng = random.Random(14)
    base = [sentence(rng, rng.randint(100, 200)) for _ in range(30)]
    texts = dict(enumerate(base + [edited(rng, t, 1 + i % 6) for i, t in enumerate(base)]))
    texts |= {100 + i: ("same " if i % 2 else "other ") * 40 + sentence(rng, 20) for i in range(6)}
    texts[110] = edited(rng, texts[100], 1)
    similar, _ = brute_similar_components(texts)
    linked = brute_components({i: brute_fingerprint(t) for i, t in texts.items()})
    assert set(linked.values()) - set(similar.values()) and set(similar.values()) - set(linked.values())
    root = dict(similar)
    for i in texts:
        x, y = sorted((root[i], root[linked[i]]))
        root = {k: x if r == y else r for k, r in root.items()}
    kept = pipeline.near_dedup(spark, spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "")
    assert {r.doc_id for r in kept.collect()} == set(root.values())


def test_toxicity_learns_and_generalises():
    rng = random.Random(3)
    bad = ["idiot", "moron", "worthless"]
    texts, y = [], []
    for k in range(240):
        words = sentence(rng, 60).split()
        if k % 2:
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(bad)
        texts.append(" ".join(words).encode())
        y.append(k % 2)
    model = toxicity.train(texts, np.array(y), np.array([1.0, 1.0]))
    v = dict(zip(["idiot", "idiiot", "moronn", "station"], model.word_values([b"idiot", b"idiiot", b"moronn", b"station"]), strict=True))
    assert v["idiot"] > v["idiiot"] > v["station"] and v["moronn"] > v["station"]


@needs_data
def test_toxicity_held_out(spark):
    read = lambda t: spark.read.parquet(f"{DATA}/{t}.parquet")
    got = toxicity.score_documents(read("documents").join(read("labels"), "doc_id", "left_semi"), read("labels")).where("held_out").join(read("labels"), "doc_id").select("score", "toxic", "predicted").toPandas()
    order = got.score.rank()
    pos = got.toxic == 1
    auc = (order[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    assert auc > 0.9
    assert ((got.score >= 0.5) == (got.predicted == 1)).all()


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 16)).astype(np.float32)
    x[50] = x[60] = x[40]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(400, None), (401, [0.0] * 16), (402, [float("nan")] * 16), (403, [None] * 16), (404, [1.0] * 3), (None, [1.0] * 16), (40, x[40].tolist())]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    found = ann.search(frame, curves=3, tile=64).cache()
    assert ann.recall(found, frame) >= 0.9
    table = found.toPandas()
    for query, group in table.groupby("query_id"):
        group = group.sort_values("rank")
        assert group["rank"].tolist() == list(range(1, 21)) and query not in set(group.vec_id)
        pairs = list(zip(-group.score, group.vec_id, strict=True))
        assert pairs == sorted(pairs)
        exact = [float((x[query].astype(float) * x[j].astype(float)).sum()) for j in group.vec_id]
        assert np.allclose(exact, group.score, rtol=0, atol=1e-12)
    assert {50, 60} <= set(table[table.query_id == 40].vec_id) and not set(table.vec_id) & {400, 401, 402, 403, 404}
    few = ann.search(frame.where("vec_id < 5")).toPandas()
    assert few.groupby("query_id").size().to_dict() == {0: 4}
    assert ann.search(frame.where("vec_id > 1000")).count() == 0


def test_hilbert_neighbours_are_adjacent():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = ann.hilbert_keys(grid, 3)
    assert sorted(keys.tolist()) == list(range(512))
    path = grid[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_bpe_round_trip(docs):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in bpe.encode_digest(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()}
    for i, t, *_ in corpus():
        ids = tok.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_lexicon_is_minimal_and_exact(tmp_path):
    words = {w: [k, k + 1] for k, w in enumerate([b"station", b"nation", b"stations", b"ration", b"on", b"\xff\x00"])}
    path = tmp_path / "lexicon"
    path.write_bytes(bpe.build_lexicon(words))
    lex = bpe.Lexicon(str(path))
    for w, place in zip(sorted(words), lex.find(sorted(words)).tolist(), strict=True):
        assert lex.ids_of(place).tolist() == words[w]
    assert lex.find([b"", b"stat", b"stationss", b"x"]).tolist() == [-1] * 4
    assert len(lex.final) < sum(map(len, words))
    assert bpe.Lexicon(str(path)).find([]).tolist() == []


def test_sharding(docs, spark):
    got = sharding.shard_documents(docs, shards=5, slots=256).toPandas()
    texts = {i: (t or "").encode() for i, t, *_ in corpus()}
    for r in got.itertuples():
        assert r.size == len(texts[r.doc_id]) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id]) and r.law == "key"
        assert r.grown_shard in (r.shard, 5)
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    alone = sharding.shard_documents(docs.where("doc_id = 9"), shards=5, slots=256).first()
    assert alone.shard == got.set_index("doc_id").shard[9]
    m = sharding.slot_map(5, 256)
    assert max(np.bincount(m)) - min(np.bincount(m)) <= 1
    heavy = {s: 1 + 100 * (s == 7) for s in range(256)}
    moved = sharding.rebalanced(m, heavy, 5)
    loads = [sum(heavy[s] for s in range(256) if moved[s] == k) for k in range(5)]
    before = [sum(heavy[s] for s in range(256) if m[s] == k) for k in range(5)]
    assert max(loads) - min(loads) < max(before) - min(before)


def test_language(spark):
    rng = random.Random(2)
    make = {"xx": ("thing", "and", "thetion", "wher"), "yy": ("ung", "schen", "keit", "über")}
    rows = [(i, " ".join(rng.choice(make[l]) for _ in range(30)), l) for i, l in enumerate(["xx", "yy"] * 40)]
    mixed = " ".join(["thing and thetion wher"] * 5 + ["ung schen keit"] * 15)
    rows += [(100, None, None), (101, "", None), (102, "12 !? 3", None), (103, mixed, None), (104, "über keit ung", None), (105, "½ ²", None)]
    got = {r.doc_id: r for r in langid.identify_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].lang_pred == l for i, _, l in rows[:80])
    assert [got[i].lang_pred for i in (100, 101, 102, 104, 105)] == ["und", "und", "und", "yy", "und"]
    assert got[103].lang_pred == "yy" and {x.lang for x in got[103].languages} == {"xx", "yy"} and 0.5 < got[103].score < 0.9
    assert all(0 <= r.score <= 1 for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())


def test_decontamination(spark):
    rng = random.Random(4)
    item = "Anna has 12 apples and gives 5 of them to Bob before the long walk home. How many apples are left for Anna now?"
    other = "Carla has 31 apples and gives 7 of them to Dirk before the long walk home. How many apples are left for Carla now?"
    broken = "Carla has 31 apples and gives 7 of them to Dirk before the long walk home. How many apples are left for Ernst now?"
    bench = spark.createDataFrame([(0, item), (1, "alpha beta gamma delta epsilon"), (2, None), (3, "a b")], "item_id long, text string")
    fill = lambda: sentence(rng, 40)
    rows = [(1, fill() + " " + item + " " + fill()), (2, fill() + ". " + other), (3, fill()), (4, None), (5, ""), (6, "alpha beta gamma delta epsilon"), (7, "a b"), (None, item)]
    got = {(r.doc_id, r.item_id): r for r in decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert set(got) == {(1, 0), (2, 0), (6, 1)}
    assert got[1, 0].exact and not got[2, 0].exact
    left = decontam.drop_contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert {r.doc_id for r in left} == {3, 4, 5, 7, None}
    h = [decontam.templates(np.frombuffer(b"".join(map(decontam.template, t.encode().split())), decontam.TEMPLATE))[0].tolist() for t in (item, other, broken)]
    assert h[0][1:] == h[1][1:] == h[2][1:]  # a sentence's first word may be any word, so it stays one
    # slots that contradict each other do not count where the passage has both
    assert decontam.contaminated(spark.createDataFrame([(1, broken)], "doc_id long, text string"), bench).count() == 0


def test_decontamination_finds_verbatim_items_of_names_numbers_and_capitals(spark):
    rng = random.Random(14)
    items = [
        "What is 12 + 35 - 7 + 18 * 4 - 6 + 90 / 5 + 11 ?",
        "WHICH OF THE FOLLOWING PLANETS HAS THE LARGEST NUMBER OF KNOWN MOONS IN ALL OF THE SYSTEM ?",
        "Alice paid Bob $12, Carol paid Dave $15, Erin paid Frank $18, Grace paid Heidi $21, Ivan paid Judy $24.",
        "In 1815 Napoleon fought Wellington at Waterloo, Blücher joined Wellington and Ney led Napoleon's Guard.",
    ]
    docs = [(i, sentence(rng, 30) + " " + t + " " + sentence(rng, 30)) for i, t in enumerate(items)] + [(9, sentence(rng, 80))]
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(i, i) for i in range(4)}
    assert all(r.exact and r.coverage == 1 for r in got)


def test_decontamination_takes_a_short_items_first_word_either_way(spark):
    rng = random.Random(15)
    items = [(0, "Name the capital of northern Peru"), (1, "Explain how rivers form deltas")]
    docs = [(i, sentence(rng, 20) + " " + t + " " + sentence(rng, 20)) for i, t in items] + [(5, sentence(rng, 50))]
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(0, 0), (1, 1)}


def test_quality(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(200):
        good = i % 2
        t = sentence(rng, 50) + "."
        rows.append((i, t if good else " ".join(w + "$$$" for w in t.split())))
        labels.append((i, good))
    rows += [(500, None), (501, ""), (None, "x")]
    docs, y = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality.score_documents(docs, y).toPandas()
    known = got[got.doc_id < 200]
    assert ((known.predicted == 1) == (known.doc_id % 2 == 1)).all()
    assert got.score.between(0, 1).all() and len(got) == 203
    assert quality.score_documents(docs, y.where("quality = 7")).toPandas().score.nunique() == 1


def test_dac():
    rng = np.random.default_rng(0)
    for ids in (np.zeros(0, np.uint64), np.array([0, 255, 256, 65535, 65536, 2**40], np.uint64), rng.integers(0, 50000, 5000).astype(np.uint64)):
        d = tokenfile.Dac(tokenfile.dac_encode(ids))
        assert (d.all() == ids).all() and len(d) == len(ids)
        assert [d[i] for i in range(0, len(ids), 7)] == ids[::7].tolist()
    with pytest.raises(IndexError):
        tokenfile.Dac(tokenfile.dac_encode(np.zeros(1, np.uint64)))[1]


def test_token_files(docs, spark, tmp_path):
    path = str(tmp_path / "tokens")
    name = public_tokenizers.path("word_bpe_49k.json")
    tokenfile.write_token_files(docs, path, name, segment_tokens=5000)
    tok, at, whole = Tokenizer.from_file(name), 0, []
    got = {r.doc_id: r for r in tokenfile.read_token_files(spark, path).collect()}
    for i, t, *_ in sorted(corpus()):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
        whole += ids
    assert tokenfile.token_range(spark, path, 4990, 5010) == whole[4990:5010]


def brute_substring(rows, width=20):
    seen, out = {}, {}
    texts = {i: (t or "").encode().split() for i, t, *_ in rows}
    for i in sorted(texts):
        w, gone = texts[i], set()
        for s in range(len(w) - width + 1):
            key = tuple(w[s : s + width])
            if key in seen:
                gone.update(range(s, s + width))
            seen.setdefault(key, (i, s))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def test_substring(docs):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.substring_digest(docs).collect()}
    assert got == brute_substring(corpus())
    small = substring.repeated_intervals(docs, chunk_words=50).collect()
    assert sum(e - s for r in small for s, e in zip(r.starts, r.ends, strict=True)) == sum(x[1] for x in got.values())
    cut = {r.doc_id: r for r in substring.remove_repeats(docs).collect()}
    for i, t, *_ in corpus():
        assert cut[i].text == t if not got[i][1] else hashlib.sha256(cut[i].text.encode()).hexdigest() == got[i][2] and cut[i].n_chars == len(cut[i].text)


def test_window_hashes_are_of_the_window_alone():
    w = np.array([xxhash.xxh64_intdigest(str(k % 7), 7) for k in range(60)], np.uint64)
    for width in (1, 2, 7, 8, 20, 60, 61):
        h = substring.window_hashes(w, width)
        assert len(h) == max(0, 60 - width + 1)
        assert all((h[i] == h[j]) == (w[i : i + width].tolist() == w[j : j + width].tolist()) for i in range(0, len(h), 3) for j in range(len(h)))


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    byte, word = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
    for out in (simhash.near_duplicate_components(empty), toxicity.score_documents(empty, labels), bpe.encode_digest(empty, byte), sharding.shard_documents(empty), langid.identify_documents(empty), decontam.contaminated(empty, bench), quality.score_documents(empty, labels), tokenfile.token_digest(empty, word), substring.substring_digest(empty), simhash.drop_near_duplicates(empty), substring.remove_repeats(empty), langid.keep_identified(empty), decontam.drop_contaminated(empty, bench)):
        assert out.count() == 0


def test_awkward_rows(spark, awkward):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(0, "a b c d e f"), (None, "g h i")], "item_id long, text string")
    byte, word = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
    n = awkward.count()
    for out in (simhash.near_duplicate_components(awkward), toxicity.score_documents(awkward, labels), bpe.encode_digest(awkward, byte), sharding.shard_documents(awkward), langid.identify_documents(awkward), quality.score_documents(awkward, labels), tokenfile.token_digest(awkward, word), substring.substring_digest(awkward)):
        assert len(out.collect()) == n
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(awkward, bench).collect()} == {(1, 0)}
    for stage in (simhash.drop_near_duplicates, substring.remove_repeats, langid.keep_identified, lambda d: decontam.drop_contaminated(d, bench)):
        out = stage(awkward)
        assert out.columns == awkward.columns and len(out.collect()) <= n
