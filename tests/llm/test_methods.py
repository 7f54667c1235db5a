"""The operators' methods against brute-force versions, planted hard cases, and rows that are long, repeated or clash in name."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash

import corpus_pipeline
from textquarry.llm import ann, bpe, common, decontam, langid, quality, simhash, substring, tokenfile, toxicity

from .test_operators import SCHEMA, brute_substring, corpus, sentence


# --- substring dedup ---------------------------------------------------------------------------------------------------


def removed(spark, rows, **options):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(((r.doc_id, r.n_words, r.n_removed) for r in substring.substring_digest(frame, **options).collect()), key=str)


def test_rows_of_one_id_and_different_texts_are_documents_of_their_own(spark):
    rng = random.Random(21)
    a, b, c = sentence(rng, 60), sentence(rng, 50), sentence(rng, 40)
    got = removed(spark, [(7, a), (7, b), (3, a + " " + c), (None, a), (None, c), (9, b), (7, b)])
    # null ids come first; 7's second text, whole and unique before 9, loses nothing; rows equal in id and text are one document
    assert got == sorted([(None, 60, 0), (None, 40, 0), (3, 100, 100), (7, 60, 60), (7, 50, 0), (7, 50, 0), (9, 50, 50)], key=str)


def test_windows_of_equal_hash_are_told_apart_by_the_check(spark):
    """Hashes cut to 24 bits collide; in ranges of few windows at a time as well."""
    frame = spark.createDataFrame(corpus(), SCHEMA)
    want = {i: x[1] for i, x in brute_substring(corpus()).items()}
    words = [xxhash.xxh64_intdigest(w, 7) for w in (sentence(random.Random(1), 20000)).encode().split()]
    cut = substring.window_hashes(np.array(words, np.uint64), 20) >> np.uint64(44)
    assert len(np.unique(cut)) < len(cut)  # 20 bits collide surely
    for options in ({"hash_bits": 24}, {"hash_bits": 24, "compared": 64, "chunk_words": 200}):
        assert {r.doc_id: r.n_removed for r in substring.substring_digest(frame, **options).collect()} == want


def test_intervals_merge_where_they_touch():
    doc, key = np.array([1, 1, 1, 2, 1]), np.array([0, 0, 0, 0, 5], np.uint64)
    got = substring.merged(doc, key, np.array([0, 5, 30, 5, 8], np.uint32), np.array([20, 25, 50, 25, 28], np.uint32))
    assert list(zip(*(x.tolist() for x in got), strict=True)) == [(1, 0, 0, 25), (1, 0, 30, 50), (1, 5, 8, 28), (2, 0, 5, 25)]


# --- decontamination -----------------------------------------------------------------------------------------------------


def found(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()}


def test_slots_must_fit_both_ways_and_over_the_whole_copy(spark):
    item = "Anna gave Bob 7 of her 20 apples before the long walk home. How many apples did Anna have left after that walk with Bob today?"
    same = "Carla gave Dirk 3 of her 41 apples before the long walk home. How many apples did Carla have left after that walk with Dirk today?"
    merged = same.replace("Dirk", "Carla")  # two of the item's names are one here
    split = same.replace("did Carla", "did Ernst")  # one of them is two
    inserted = "Carla gave Dirk 3 of her 41 apples before the long walk home yesterday evening. How many apples did Ernst have left after that walk with Dirk today?"
    assert found(spark, [item, same, merged, split, inserted], [item]) == {(0, 0), (1, 0)}
    both = same + " " + same.replace("Carla", "Emma").replace("Dirk", "Frank")  # two copies with names of their own
    assert found(spark, [both], [item]) == {(0, 0)}


def test_items_of_one_template_are_one_class(spark):
    names = [f"Zed{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)]
    template = "Today {a} bought 12 red apples and gave 5 of them to {b} before the long walk home. How many apples are left for {a} now?"
    items = [template.format(a=names[2 * k], b=names[2 * k + 1]) for k in range(30)]
    docs = [template.format(a=names[(7 * k) % 60], b=names[(11 * k + 1) % 60]) for k in range(1, 20)]
    frame, bench = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = decontam.contaminated(frame, bench).collect()
    assert len(rows) == len(docs) and {r.item_id for r in rows} == {0} and {r["items"] for r in rows} == {30}


def brute_contaminated(texts: list[str], items: list[str]) -> set[tuple[int, int]]:
    """Verbatim passages alone, by nested loops over lower-cased words without edge punctuation."""
    cut = lambda t: [decontam.EDGE("", w).lower() or w.lower() for w in t.split()]
    out = set()
    for i, t in enumerate(texts):
        for j, item in enumerate(items):
            a, b, width = cut(t), cut(item), min(decontam.WINDOW, len(cut(item)))
            if width < decontam.LEAST_WORDS:
                continue
            copies: dict[int, set[int]] = {}
            for p in range(len(a) - width + 1):
                for q in range(len(b) - width + 1):
                    if a[p : p + width] == b[q : q + width]:
                        copies.setdefault(p - q, set()).add(q)
            n = len(b) - width + 1
            every = set().union(*copies.values()) if copies else set()
            long = any(len(q) >= decontam.PASSAGE_WORDS - width + 1 for q in copies.values())
            if long or len(every) >= decontam.SHARE * n:
                out.add((i, j))
    return out


def test_verbatim_passages_against_nested_loops(spark):
    rng = random.Random(22)
    items = [sentence(rng, rng.randint(4, 40)) for _ in range(12)]
    texts = []
    for k in range(60):
        words = items[k % 12].split()
        n = rng.randint(1, len(words))
        at = rng.randint(0, len(words) - n)
        texts.append(" ".join([*sentence(rng, rng.randint(0, 30)).split(), *words[at : at + n], *sentence(rng, rng.randint(0, 30)).split()]))
    assert found(spark, texts, items) == brute_contaminated(texts, items)


# --- near duplicates ------------------------------------------------------------------------------------------------------


def test_an_unrelated_document_of_a_smaller_id_loses_no_link(spark):
    """Two near copies among documents that share their commonest shingle with a third, which is similar to neither."""
    rng = random.Random(23)
    phrase, text = sentence(rng, 5), sentence(rng, 200)
    rows = [(1, (phrase + " " + sentence(rng, 3) + " ") * 12), (2, (phrase + " ") * 30 + text), (3, (phrase + " ") * 30 + text + " more")]
    rows += [(10 + k, phrase + " " + sentence(rng, 60)) for k in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for options in ({}, {"bucket_limit": 2}, {"compared": 16}):
        groups = {r.doc_id: r.group_id for r in simhash.near_duplicate_groups(frame, **options).collect()}
        assert groups[3] == 2 and all(g == i for i, g in groups.items() if i != 3)


def test_pairs_to_check_do_not_grow_with_the_square_of_a_crowded_bucket(spark, monkeypatch):
    """Texts that share a passage, two of them near copies: few pairs are given to be checked, and these two are linked."""
    rng = random.Random(25)
    phrase, checked, similar_pairs = sentence(rng, 85), [], simhash.similar_pairs
    texts = {i: f"{phrase} {sentence(rng, 35)}" for i in range(150)}
    texts[150] = texts[149] + " more"

    def counted(docs, known, pairs, *rest):
        checked.append(pairs.distinct().count())
        return similar_pairs(docs, known, pairs, *rest)

    monkeypatch.setattr(simhash, "similar_pairs", counted)
    monkeypatch.setattr(simhash, "common_shingles", lambda docs, shingle: (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    got = simhash.near_duplicate_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {r.doc_id: r.group_id for r in got.collect()} == {i: min(i, 149) for i in texts}
    assert 150 <= sum(checked) < 8 * len(texts)


@pytest.mark.parametrize("square", [simhash.SQUARE, 64])
def test_a_crowded_bucket_gives_few_pairs_a_label_and_loses_none(monkeypatch, square):
    """Near copies of one text in one bucket, some alone and most of one label: a scan gives a number of pairs that grows with the
    labels, and scans of more pairs each give every pair that is similar, unless it is connected."""
    monkeypatch.setattr(simhash, "SQUARE", square)
    rng = np.random.default_rng(27)
    base, sets = rng.integers(0, 1 << 63, 150, np.uint64), []
    for _ in range(300):
        own = base.copy()
        edits = rng.choice(150, rng.integers(3, 18), replace=False)
        own[edits] = rng.integers(0, 1 << 63, len(edits), np.uint64)
        sets.append(np.unique(own))
    n = len(sets)
    similar = {(a, b) for a in range(n) for b in range(a + 1, n) if len(both := np.intersect1d(sets[a], sets[b])) >= 0.8 * (len(sets[a]) + len(sets[b]) - len(both))}
    parities = [simhash.carried_parity(simhash.parity_bits(x)) for x in sets]
    label, members, pivots, given = np.minimum(np.arange(n), 12), np.arange(n), 4, []
    assert len(similar) > 8 * n
    while len(members):
        columns = [np.zeros(len(members), np.int64), members, np.array([len(sets[m]) for m in members]), np.zeros(len(members), np.int64), label[members], np.array([parities[m] for m in members], object)]
        scan = simhash.pair_buckets(lambda _, c=columns: iter([c]), pivots, simhash.PAIRED, 0.8)
        rows = [r for batch in scan([]) for r in batch.to_pylist()]
        pairs = [(r["a"], r["b"]) for r in rows if r["b"] is not None]
        assert len(pairs) <= pivots * len(set(label[members].tolist()))
        given.append(len(pairs))
        for a, b in similar.intersection(pairs):
            label[label == label[b]] = label[a]
        members, pivots = np.array([r["a"] for r in rows if r["b"] is None], np.int64), pivots * 4
    assert all(label[a] == label[b] for a, b in similar) and sum(given) < n
    want = np.minimum(np.arange(n), 12)
    for a, b in similar:
        want[want == want[b]] = want[a]
    assert len({*zip(label.tolist(), want.tolist(), strict=True)}) == len(set(want.tolist())) == len(set(label.tolist()))


def test_parity_bits_rule_out_no_pair_of_the_similarity():
    rng = np.random.default_rng(26)
    for n in (3, 100, 127, 129, 600, 3000, 40000):
        own = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
        others = [np.unique(np.r_[own[: rng.integers(0, len(own) + 1)], rng.integers(0, 1 << 63, rng.integers(0, n), np.uint64)]) for _ in range(40)]
        bits = simhash.Parities([simhash.carried_parity(simhash.parity_bits(x)) for x in (own, *others)])
        apart = bits.apart(0, np.arange(1, 41))
        assert all(a <= len(np.setxor1d(own, x)) for a, x in zip(apart, others, strict=True))
        assert bits.bits.shape[1] * 8 <= simhash.CARRIED


def test_rows_of_one_id_with_different_texts_stay(spark):
    rng = random.Random(24)
    a, b = sentence(rng, 80), sentence(rng, 80)
    frame = spark.createDataFrame([(1, a, "x"), (1, b, "x"), (1, b, "y"), (2, a + " z", "x"), (None, a, "x"), (None, a, "x")], "doc_id long, text string, node string")
    kept = sorted(((r.doc_id, r.text == a) for r in simhash.drop_near_duplicates(frame).collect()), key=str)
    assert kept == sorted([(1, True), (1, False), (None, True), (None, True)], key=str)


# --- toxicity -------------------------------------------------------------------------------------------------------------


def test_gradients_against_finite_differences():
    rng = np.random.default_rng(1)
    e, w, bias = rng.normal(size=(30, 4)), rng.normal(size=(4, 2)), rng.normal(size=2)
    bucket, weight, sizes, toxic = np.array([0, 3, 7, 3, 9, 9, 29]), rng.uniform(size=7), [3, 2, 2], np.array([1, 0, 1])
    loss, touched, by_e, by_w, by_bias = toxicity.gradients(e, w, bias, bucket, weight, sizes, toxic)
    step = 1e-6

    def moved(table, at):
        other = table.copy()
        other[at] += step
        return other

    for k, b in enumerate(touched):
        for d in range(4):
            assert by_e[k, d] == pytest.approx((toxicity.gradients(moved(e, (b, d)), w, bias, bucket, weight, sizes, toxic)[0] - loss) / step, abs=1e-4)
    for d in range(4):
        for c in range(2):
            assert by_w[d, c] == pytest.approx((toxicity.gradients(e, moved(w, (d, c)), bias, bucket, weight, sizes, toxic)[0] - loss) / step, abs=1e-4)
    assert by_bias[0] == pytest.approx((toxicity.gradients(e, w, moved(bias, 0), bucket, weight, sizes, toxic)[0] - loss) / step, abs=1e-4)


def test_scores_against_a_forward_pass_word_by_word(spark):
    rng = np.random.default_rng(2)
    model = toxicity.Model(rng.normal(size=toxicity.BUCKETS), 3.0, -0.5)
    texts = ["Plain words, here. AND here's one more", "", None, "x" * 5000 + " café", " ".join(["word"] * 30000) + " odd"]
    got = {r.doc_id: r.score for r in toxicity.predict(spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)], "doc_id long, text string, score double"), model).collect()}
    for i, t in enumerate(texts):
        means = []
        for w in toxicity.words((t or "").encode()):
            marked = b"<" + w + b">"
            buckets = [xxhash.xxh32_intdigest(w) % toxicity.BUCKETS]
            for n in range(toxicity.SHORTEST, toxicity.LONGEST + 1):
                for s in range(len(marked) - n + 1):
                    h = 0
                    for byte in marked[s : s + n]:
                        h = (h * 0x100000001B3 + byte + 1) % 2**64
                    buckets.append((h * 0x9E3779B97F4A7C15 % 2**64 >> 40) % toxicity.BUCKETS)
            means.append(sum(float(model.values[b]) for b in buckets) / len(buckets))
        mean = sum(means) / len(means) if means else 0.0
        assert got[i] == pytest.approx(1 / (1 + math.exp(-(3.0 * mean - 0.5))), abs=1e-5)


# --- language ---------------------------------------------------------------------------------------------------------------


def loop_em(like, allowed, rounds=langid.ROUNDS):
    share = [a / sum(allowed) for a in allowed]
    for _ in range(rounds):
        total = [0.0] * len(share)
        for word in like:
            mixed = sum(p * s for p, s in zip(word, share, strict=True))
            for k, (p, s) in enumerate(zip(word, share, strict=True)):
                total[k] += p * s / mixed
        share = [t / len(like) for t in total]
    return share, sum(math.log(sum(p * s for p, s in zip(word, share, strict=True))) for word in like)


def test_mixtures_against_plain_loops():
    rng = np.random.default_rng(3)
    sizes = np.array([5, 1, 40])
    like = rng.uniform(0.01, 1, (46, 6)).astype(np.float32)
    starts, doc = np.array([0, 5, 6]), np.repeat(np.arange(3), sizes)
    allowed = np.array([[1, 1, 0, 0, 1, 0], [0, 1, 0, 0, 0, 0], [1, 1, 1, 1, 1, 1]], np.float32)
    share, log = langid.fit(like, starts, doc, sizes.astype(np.float32), allowed)
    for k in range(3):
        want, value = loop_em(like[doc == k].tolist(), allowed[k].tolist())
        assert np.allclose(share[k], want, atol=1e-4) and log[k] == pytest.approx(value, abs=1e-2)


def test_sets_grow_while_the_penalised_likelihood_rises():
    """A text of four languages has all four; one of one language it alone, against loops over growing sets."""
    like = np.full((400, 7), 1e-4, np.float32)
    for k in range(400):
        like[k, k % 4] = 1.0
    both = np.concatenate([like, np.where(np.arange(7) == 5, 1.0, 1e-4).astype(np.float32) * np.ones((30, 7), np.float32)])
    chosen = langid.fit_sets(both, np.array([400, 30]), 2.0)
    assert np.allclose(chosen[0], [0.25] * 4 + [0] * 3, atol=1e-3) and np.allclose(chosen[1], np.arange(7) == 5, atol=1e-6)


def test_more_languages_than_sixty_four(spark):
    rng = random.Random(25)
    rows, letters = [], "abcdefghijklmnopqrstuvwxyz"
    words = {k: ["".join(rng.choice(letters) for _ in range(6)) for _ in range(5)] for k in range(70)}
    for k in range(70):
        rows += [(100 * k + j, " ".join(rng.choice(words[k]) for _ in range(25)), f"l{k:02d}") for j in range(4)]
    got = {r.doc_id: r.lang_pred for r in langid.identify_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert sum(got[i] == lang for i, _, lang in rows) >= 0.97 * len(rows) and len(set(got.values())) == 70


# --- quality ----------------------------------------------------------------------------------------------------------------


def test_scores_against_dense_gaussian_densities():
    rng = np.random.default_rng(4)
    d = len(quality.FEATURES)
    x = {y: rng.normal(y, 1, (60 + 40 * y, d)) @ rng.normal(size=(d, d)) for y in (0, 1)}
    model = quality.Model({y: (float(len(v)), v.sum(axis=0), v.T @ v) for y, v in x.items()})
    covs = {y: np.cov(v.T, bias=True) for y, v in x.items()}
    pooled = (60 * covs[0] + 100 * covs[1]) / 160
    unit = np.sqrt(np.diag(pooled))
    points, log = rng.normal(size=(20, d)), []
    for y in (0, 1):
        c = ((1 - quality.TO_POOLED) * covs[y] + quality.TO_POOLED * pooled) / np.outer(unit, unit)
        c = (1 - quality.TO_IDENTITY) * c + quality.TO_IDENTITY * np.trace(c) / d * np.eye(d)
        z = (points - x[y].mean(axis=0)) / unit
        log.append(np.log(len(x[y]) / 160) - 0.5 * np.log(np.linalg.det(c)) - 0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(c), z))
    assert np.allclose(model.score(points), 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50))), atol=1e-9)


# --- nearest neighbours --------------------------------------------------------------------------------------------------------


def test_clustered_vectors_are_compared_with_a_part_of_all(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 12)) * 6
    x = (centres[np.arange(2400) % 40] + rng.normal(size=(2400, 12)) * 0.2).astype(np.float32)
    # 404 has the one length of its own, 2401 and 2402 clash with no id
    frame = spark.createDataFrame([(i, v.tolist(), "x", 0) for i, v in enumerate(x)] + [(2440, [1.0, 2.0], "y", 0), (2460, [2.0, 1.0], "y", 0)], "vec_id long, embedding array<float>, node string, rank int").repartition(4)
    found = ann.search(frame, tile=64).cache()
    assert ann.recall(found, frame) >= 0.9
    assert {(r.query_id, r.vec_id) for r in found.where("query_id > 2400").collect()} == {(2440, 2460), (2460, 2440)}
    rows = ann.usable(frame.where("vec_id < 2400")).dropDuplicates(["vec_id", "v"])
    nodes = ann.points(rows, 21).cache()
    longest = float(np.linalg.norm(x.astype(float), axis=1).max())
    ranks = ann.ranked(nodes, 12, longest, ann.CURVES).cache()
    asked = nodes.where("node % 20 = 0")
    reach = ann.window_tiles(nodes, ranks, asked, 12, 20, ann.CURVES, 64)
    looks = ann.homes_of_queries(asked, ranks, reach, 64).count()
    assert looks < 0.7 * asked.count() * math.ceil(2400 / 64)


# --- tokens -------------------------------------------------------------------------------------------------------------------


def test_frequent_words_of_several_ids_are_in_the_automaton(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(i, "zqxvorp blimfang the zqxvorp " * 3) for i in range(20)], "doc_id long, text string")
    words = bpe.frequent_words(docs, 100, 50)
    assert {b" zqxvorp", b" blimfang", b" the"} <= set(words) and len(words) <= 50
    encoder = bpe.shipped_encoder(docs, path)()
    places = encoder.lexicon.find([b" zqxvorp", b" blimfang"])
    assert (places >= 0).all() and all(len(encoder.lexicon.ids_of(p)) > 1 for p in places.tolist())
    encoder.encode(["zqxvorp zqxvorp blimfang"])
    assert b" zqxvorp" not in encoder.memo.known  # answered by the automaton, not remembered


def test_frequent_words_are_counted_over_all_documents(spark):
    """Words met three times in all, in documents far apart, also where tasks report their counts in many parts."""
    texts = [f"{k % 10_000} {k % 50}" for k in range(30_000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    counted = Counter(w for t in texts for w in bpe.WordSplitter()(t))
    ranked = sorted(counted, key=lambda w: (-counted[w], w))
    assert min(counted.values()) == 3 and len(ranked) > 10_000
    for most in (bpe.FREQUENT_WORDS, 70):
        assert bpe.frequent_words(docs, most=most) == [w.encode() for w in ranked[:most]]


def test_memory_of_words_is_bounded():
    memo = common.WordMemo(lambda v: [w * 2 for w in v], 100_000)
    for k in range(50):
        assert memo.get([b"%d-%d" % (k, j) for j in range(100)])[7] == b"%d-7" % k * 2
        assert memo.size <= 100_000 + 100 * 200


def test_token_files_of_one_id(spark, tmp_path):
    rng = random.Random(26)
    texts = [sentence(rng, 30) for _ in range(40)] + ["long " * 20000]
    path = str(tmp_path / "tokens")
    tokenfile.write_token_files(spark.createDataFrame([(None if k % 2 else 5, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3), path, public_tokenizers.path("word_bpe_49k.json"), segment_tokens=100)
    rows = sorted(tokenfile.read_token_files(spark, path).collect(), key=lambda r: r.start)
    assert len(rows) == 41 and [r.doc_id for r in rows] == [None] * 20 + [5] * 21
    assert [r.start for r in rows] == np.cumsum([0, *[r.n_tokens for r in rows]])[:-1].tolist()


def test_even_keys_and_hashes_are_those_of_spark(spark):
    from pyspark.sql import functions as F

    assert [r.h for r in spark.range(50).select(F.hash(F.col("id").cast("int")).alias("h")).collect()] == common.spark_hash(np.arange(50)).tolist()
    ids = np.array([0, -1, 7, 2**62], np.int64)
    got = [r.h & (1 << 64) - 1 for r in spark.createDataFrame([(int(i),) for i in ids], "id long").select(F.xxhash64("id").alias("h")).collect()]
    assert got == common.spark_long_hash(ids).tolist()
    keys = common.even_keys(13, 4)
    assert np.bincount(common.spark_hash(keys).astype(np.int64) % 13).tolist() == [4] * 13


# --- awkward rows ---------------------------------------------------------------------------------------------------------------


def test_very_long_texts(spark):
    long = sentence(random.Random(27), 200_000)
    docs = spark.createDataFrame([(1, long, "xx"), (2, "short text here", "xx"), (6, "x" * 300_000, "yy")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (6, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.score_documents(docs, labels).count() == langid.identify_documents(docs).count() == quality.score_documents(docs, labels).count() == 3
    item = " ".join(long.split()[150_000:150_030])
    assert {r.doc_id for r in decontam.contaminated(docs, spark.createDataFrame([(0, item)], "item_id long, text string")).collect()} == {1}


def test_vectors_awkward_and_empty(spark):
    schema = "vec_id long, embedding array<float>, v string, ids string, home string, score string"
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 1.0]), (20, [1.0, 1.0]), (3, [1.0, 0.0]), (None, [1.0, 0.0]), (40, None), (60, [])]
    got = ann.search(spark.createDataFrame([(i, v, "x", "x", "x", "x") for i, v in rows], schema)).collect()
    assert {r.query_id for r in got} == {0, 20} and all(r.vec_id != r.query_id for r in got)
    assert ann.search(spark.createDataFrame([], schema)).count() == 0


def test_pipeline_of_awkward_rows(spark, tmp_path):
    extra = "fp string, node string, starts string, row_key string, size string"
    rng = random.Random(28)
    a, b = sentence(rng, 60), sentence(rng, 60)
    rows = [(1, a), (1, a), (2, a), (3, b), (None, b), (None, b), (4, None), (5, ""), (3, a + " x")]
    for name, given in (("some", rows), ("none", [])):
        folder = tmp_path / name
        spark.createDataFrame([(i, t, "en", "s", None, *"vwxyz") for i, t in given], f"{SCHEMA}, {extra}").write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(0, sentence(rng, 20)), (None, a)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        got = sorted((str(r.doc_id) for r in corpus_pipeline.run(spark, str(folder)).collect()))
        assert got == (["1", "3", "None", "None"] if given else [])


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Context:
        def __init__(self, folder):
            self.folder = folder
            self._jsc = self

        def sc(self):
            return self

        def isLocal(self):
            return False

        def getCheckpointDir(self):
            return type("Option", (), {"isDefined": lambda _: False})()

        def getConf(self):
            return {"spark.checkpoint.dir": self.folder}

    class Session:
        conf = type("Conf", (), {"get": lambda self, key, default=None: default})()

        def __init__(self, folder):
            self.sparkContext = Context(folder)

    assert common.shared_dir(Session("hdfs:///shared/")) == "hdfs:///shared"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session(None))
