"""The pipeline's stages, one after the other, against what brute force leaves."""

from __future__ import annotations

import hashlib
import random

import corpus_pipeline

from .test_operators import sentence


def test_stages_keep_clean_documents_and_drop_the_rest(spark, tmp_path):
    rng = random.Random(9)
    item = sentence(rng, 30)
    clean = {i: sentence(rng, 80) for i in range(20)}
    rows = dict(clean)
    rows[30] = clean[3]  # exact copy
    rows[31] = clean[4] + " more"  # near copy
    rows[32] = sentence(rng, 40) + " " + item + " " + sentence(rng, 40)  # leak
    shared = " ".join(clean[5].split()[10:60])
    rows[33] = sentence(rng, 50) + " " + shared + " " + sentence(rng, 50)  # passage of another document
    rows[34], rows[35] = None, "?! 12"  # no language
    folder = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(out) == set(clean) | {33}
    for i, t in clean.items():
        assert out[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    words = rows[33].split()
    assert out[33].decoded_sha256 == hashlib.sha256(" ".join(words[:50] + words[100:]).encode()).hexdigest()


def test_stage_list():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "simhash near-dedup", "substring dedup", "benchmark decontamination", "bpe encoding and decoding"]
    assert "pipeline" in corpus_pipeline.queries()
