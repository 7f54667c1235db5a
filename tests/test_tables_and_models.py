"""Ingest, cleaning, models, rollups, streams and the registry."""

from __future__ import annotations

import math
import os
import shutil
import subprocess
import sys

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from textquarry.operators import modeling
from textquarry.plans import registry
from textquarry.sources import tables
from textquarry.streaming import features as streams

DATA = "/root/testdata/sf0.001"


def test_read_submissions(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Question,Response 1,response_2,Rating\nq1,"hello, you",again,Helpful\nq2,,only,Nope\nq3,x,y,Neutral\n')
    (tmp_path / "b.csv").write_text("Prompt,Response,Rating\np1,text,7\np2,,0\np3,z,\n")
    got = sorted(tables.read_submissions(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]).select("file_id", "user_id", "question", "text", "rating").collect())
    assert [tuple(r) for r in got] == [(0, 0, "q1", "hello, you again", 4.0), (0, 2, "q3", "x y", 3.0), (1, 0, "p1", "text", 5.0), (1, 1, "p2", "", 1.0)]
    with pytest.raises(FileNotFoundError):
        tables.read_submissions(spark, [str(tmp_path / "none.csv")])


def test_submission_errors(spark):
    with pytest.raises(ValueError, match="response"):
        tables.submission(spark.createDataFrame([("x", "Helpful")], "a string, Rating string"))
    with pytest.raises(ValueError, match="Rating"):
        tables.submission(spark.createDataFrame([("x",)], "response string"))
    strict = tables.submission(spark.createDataFrame([("x", "What")], "response string, Rating string"), strict=True)
    with pytest.raises(Exception, match="unknown rating label"):
        strict.collect()
    twice = tables.submission(spark.createDataFrame([("x", "x", "Helpful")], "response string, response2 string, Rating string"), distinct_columns=True)
    assert twice.first().text == "x"


def test_sinks_and_ordinals(spark, tmp_path):
    df = spark.range(100).withColumn("x", F.col("id") * 1.005)
    numbered = tables.with_ordinal(df.repartition(7), ["id"], "n").collect()
    assert all(r.n == r.id for r in numbered)
    for kind, name in (("csv", "out.csv"), ("parquet", "out")):
        tables.write(tables.round_columns(df, {"x": 2}), str(tmp_path / name), kind)
        assert tables.read_master(spark, str(tmp_path / name), ["id", "x"]).count() == 100
    with pytest.raises(ValueError):
        tables.read_master(spark, str(tmp_path / "out"), ["missing"])


def test_cleaning(spark):
    df = spark.createDataFrame([(1, math.nan), (2, math.inf), (3, None), (4, 2.5)], "id long, x double")
    assert {r.id: r.x for r in modeling.clean(df, ["x"]).collect()} == {1: 0, 2: 0, 3: 0, 4: 2.5}
    assert {r.id: r.x for r in modeling.clean(df, ["x"], keep_infinite=True).collect()} == {1: 0, 2: math.inf, 3: 0, 4: 2.5}
    assert {r.x for r in modeling.non_finite_to_max(df, "x").collect()} == {2.5}
    assert {r.x for r in modeling.non_finite_to_max(df.where("id < 3"), "x").collect()} == {1e6}
    assert modeling.coerce(spark.createDataFrame([("1",), ("x",), (None,)], "s string"), ["s"]).count() == 1
    assert modeling.toggled(df, {"f": ["x"]}, {"f": False}).agg(F.max("x")).first()[0] == 0


def rated(spark, users=30, files=5, effect=1.0, seed=0):
    rng = np.random.default_rng(seed)
    u = rng.normal(0, effect, users)
    rows = []
    for i in range(users):
        for f in range(files):
            a, b = rng.normal(size=2)
            rows.append((i, f, float(3 + 0.5 * a + u[i] * 0.5 + 0.1 * rng.normal()), float(a), float(b)))
    return modeling.with_split(spark.createDataFrame(rows, "user_id long, file_id long, rating double, a double, b double"), ["user_id", "file_id"]).cache()


def test_split_is_stable(spark):
    df = rated(spark)
    again = modeling.with_split(df.drop("split").repartition(9), ["user_id", "file_id"])
    assert df.join(again.withColumnRenamed("split", "s2"), ["user_id", "file_id"]).where("split <> s2").count() == 0
    assert 0.1 < df.where("split = 'test'").count() / df.count() < 0.3


def test_mixed_model_matches_dense_algebra(spark):
    df = rated(spark)
    model = modeling.MixedModel(["a", "b"]).fit(df)
    p = df.toPandas()
    x = np.c_[np.ones(len(p)), p.a, p.b]
    z = (p.user_id.to_numpy()[:, None] == np.arange(30)).astype(float)
    w = np.linalg.inv(np.eye(len(p)) + model.theta * z @ z.T)
    beta = np.linalg.solve(x.T @ w @ x, x.T @ w @ p.rating)
    assert np.allclose(beta, model.beta, atol=1e-6)

    def reml(theta):
        v = np.eye(len(p)) + theta * z @ z.T
        w = np.linalg.inv(v)
        b = np.linalg.solve(x.T @ w @ x, x.T @ w @ p.rating)
        r = p.rating - x @ b
        return (len(p) - 3) * np.log(r @ w @ r / (len(p) - 3)) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(x.T @ w @ x)[1]

    assert all(reml(model.theta) <= reml(model.theta * k) + 1e-6 for k in (0.8, 1.25))
    out = model.predict(df).toPandas()
    assert ((out.rating - out.pred_conditional) ** 2).mean() < 0.3 * ((out.rating - out.pred_fe_only) ** 2).mean()
    new = model.predict(df.limit(1).withColumn("user_id", F.lit(999).cast("long"))).first()
    assert new.pred_fe_only == new.pred_conditional


def test_forest_rollup_and_sweep(spark):
    df = rated(spark)
    model = modeling.forest(df, ["a", "b"], trees=15, depth=6)
    out = modeling.predict(model, df, ["a", "b"]).cache()
    assert out.agg(F.min("pred_rating") >= 1, F.max("pred_rating") <= 5).first()[0]
    e = {r.split: r for r in modeling.evaluate(out, ["split"]).collect()}
    assert e["train"].mse < 0.5
    users = modeling.per_user(out, places=2).toPandas()
    assert len(users) == 30 and users.n_rows.sum() == df.count()
    summary, predictions = modeling.combo_sweep(df, {"one": ["a", "none"], "all": ["__ALL__"], "nothing": ["zzz"]}, trees=3)
    assert {r.combo: r.n_features for r in summary.collect()} == {"one": 1, "all": 2} and set(predictions) == {"one", "all"}


def test_components_and_scaling(spark):
    df = rated(spark).withColumn("block", F.array("a", "b", F.col("a") + F.col("b")))
    out = modeling.with_components(df, "block", most=2).toPandas()
    assert all(len(x) == 2 for x in out.pca)
    z = modeling.standardise(df, ["a"]).where("split = 'train'").agg(F.avg("a_z"), F.stddev_pop("a_z")).first()
    assert z[0] == pytest.approx(0, abs=1e-9) and z[1] == pytest.approx(1)


def test_streams(spark, tmp_path):
    batch = spark.createDataFrame([("One two. Three!", 1), ("", 2)], "text string, id int")
    batch.write.parquet(str(tmp_path / "in"))
    stream = streams.feature_stream(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")))
    q = stream.select("id", "n_words").writeStream.format("memory").queryName("features").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.id: r.n_words for r in spark.sql("SELECT * FROM features").collect()} == {1: 3, 2: 0}
    events = spark.createDataFrame([(1, 2.0, "2024-01-01 00:10:00"), (1, 4.0, "2024-01-01 00:20:00")], "user_id long, value double, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert streams.windowed_rollup(events).first().mean_value == 3.0


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "events"):
        path = f"{DATA}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    ours, theirs = registry.queries()[name](spark, DATA).toPandas(), con.sql(registry.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)

    def values(df):
        return sorted((tuple(None if x is None or x != x else round(x, 4) if isinstance(x, float) else x for x in r) for r in df[sorted(df.columns)].astype(object).where(df.notna(), None).values.tolist()), key=str)

    assert values(ours) == values(theirs)


def test_entry_point_without_optional_operators():
    import __spark_entry__

    assert set(registry.queries()) <= set(__spark_entry__.queries()) and set(registry.oracle_sql()) <= set(__spark_entry__.oracle_sql())


def test_nothing_else_needs_the_optional_operators(tmp_path):
    """In a copy without their folders the entry point imports and has every other query."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = tmp_path / "repo"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    assert not (copy / "textquarry" / "llm").exists()
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, capture_output=True, text=True, check=True)
    assert done.stdout.split() == [str(len(registry.queries())), str(len(registry.oracle_sql()))]


def test_combos_name_what_is_missing(spark):
    df = rated(spark)
    with pytest.raises(ValueError, match="none"):
        modeling.combo_sweep(df, {"one": ["a", "none"]}, trees=2, strict=True)
    summary, _ = modeling.combo_sweep(df, {"one": ["a"]}, trees=2, extra=["b"], strict=True)
    assert summary.first().n_features == 2


def test_components_rebuild_the_block(spark):
    """As many components as dimensions are a rotation of the scaled block: distances between rows stay, and columns are
    uncorrelated over the rows that they were fitted on."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 5)) @ rng.normal(size=(5, 5))
    df = modeling.with_split(spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(x)], "user_id long, file_id long, block array<double>"), ["user_id", "file_id"])
    out = modeling.with_components(df, "block", most=5).toPandas().sort_values("user_id")
    train = (out.split == "train").to_numpy()
    scaled = (x - x[train].mean(axis=0)) / x[train].std(axis=0, ddof=1)
    got = np.stack(out.pca.to_list())
    assert np.allclose(((scaled[:, None] - scaled[None]) ** 2).sum(-1), ((got[:, None] - got[None]) ** 2).sum(-1), atol=1e-6)
    cov = np.cov(got[train].T)
    assert np.allclose(cov - np.diag(np.diag(cov)), 0, atol=1e-6) and (np.diff(np.diag(cov)) <= 1e-9).all()


def test_output_places(spark):
    df = spark.createDataFrame([(1, 0, 4.123456, 1.23456789, 2.345678, 0.123456)], "user_id long, file_id long, rating double, perplexity double, pred_rating double, proportion_top10 double")
    assert tables.places_of(df, "perplexity") == {"perplexity": 3, "pred_rating": 2, "proportion_top10": 4}
    assert tables.places_of(df) == {"perplexity": 4, "pred_rating": 2, "proportion_top10": 4}
