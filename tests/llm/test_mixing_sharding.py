import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from quillframe.llm import mixing, sharding
from quillframe.llm.mixing import op2_poisson_mix, poisson_cdf, poisson_count, poisson_mix, source_rates
from quillframe.llm.sharding import hilbert_index, hilbert_shards, text_cuts

SCHEMA = "doc_id long, source string, n long, h string, copy_no string"


def docs(spark, n):
    rows = [(i if i % 50 else None, ["a", "a", "a", "b", None][i % 5], i % 97, "x", "c") for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def test_inverse_poisson(spark):
    df = spark.createDataFrame([(r, u) for r in (0.3, 1.0, 7.5, 300.0) for u in (0.0001, 0.5, 0.9, 0.99999)], "r double, u double")
    got = df.select("r", "u", poisson_count(poisson_cdf(F.col("r")), F.col("u")).alias("k")).collect()
    for r, u, k in got:
        below = sum(math.exp(-r + i * math.log(r) - math.lgamma(i + 1)) for i in range(k))
        assert below <= u + 1e-9 and below + math.exp(-r + k * math.log(r) - math.lgamma(k + 1)) > u - 1e-9


def test_mix(spark):
    df = docs(spark, 5000)
    targets = {"a": 1.0, "b": 3.0}
    rates = {r["source"]: r["rate"] for r in source_rates(df, targets)[0].collect()}
    assert abs(rates["a"] - 0.25 * 5000 / 3000) < 1e-9 and abs(rates["b"] - 0.75 * 5000 / 1000) < 1e-9 and rates[None] == 0
    out = poisson_mix(df, targets)
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert set(n) == {"a", "b"} and abs(n["b"] / n["a"] - 3) < 0.4
    assert out.columns == ["doc_id", "source", "n", "h", "copy_no", "n_copies", "shuffle_key"]
    keys = [r[0] for r in out.select("shuffle_key").collect()]
    assert keys == sorted(keys)
    again = sorted(map(str, poisson_mix(df.repartition(7), targets).collect()))
    assert again == sorted(map(str, out.collect()))
    assert poisson_mix(df.limit(0), targets).count() == 0
    kept = poisson_mix(df, targets, added=("c1", "c2", "c3"))
    assert kept.columns == [*df.columns, "c1", "c2", "c3"] and kept.filter("copy_no <> 'c'").isEmpty()


def test_mix_rates_above_one_draw(spark):
    df = spark.createDataFrame([(i, "rare" if i < 3 else "one" if i == 3 else "many", 0, "x", "c") for i in range(30000)], SCHEMA)
    rates = {r["source"]: r["rate"] for r in source_rates(df, None)[0].collect()}
    assert abs(rates["one"] - 10000) < 1e-6 and abs(rates["rare"] - 10000 / 3) < 1e-6
    out = poisson_mix(df)
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert all(abs(n[s] - 10000) < 5 * math.sqrt(10000) for s in ("one", "rare", "many"))  # five deviations
    per = out.filter("source <> 'many'").groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("copy_no").alias("d"), F.min("copy_no").alias("lo"), F.max("copy_no").alias("hi"), F.max("n_copies").alias("k"), F.min("n_copies").alias("j")).collect()
    assert len(per) == 4 and all((r["n"], r["lo"], r["hi"], r["j"]) == (r["k"], 0, r["k"] - 1, r["k"]) and r["d"] == r["n"] for r in per)
    assert len({r["n"] for r in per}) == 4 and poisson_mix(df.repartition(5)).count() == sum(n.values())


def test_split_draws_keep_the_variance(spark):
    df = spark.createDataFrame([(i, "a", 0, "x", "c") for i in range(400)], SCHEMA)
    counts = [r["n_copies"] for r in poisson_mix(df, total_factor=1500.0).filter("copy_no = 0").collect()]
    assert len(counts) == 400 and abs(np.mean(counts) - 1500) < 10 and 1000 < np.var(counts) < 2100


def test_query_mixes_whole_documents(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i}", "en", f"s{i % 3}", 6) for i in range(60)], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    out = op2_poisson_mix(spark, str(tmp_path))
    assert out.columns == [*df.columns, "copy_no", "n_copies", "shuffle_key"]
    assert not out.isEmpty() and out.filter("text is distinct from concat('text ', doc_id)").isEmpty()


def test_curve_is_a_path():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        points = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        order = hilbert_index(points, bits)
        assert sorted(order) == list(range(len(points)))
        steps = np.abs(np.diff(points[np.argsort(order)], axis=0)).sum(axis=1)
        assert (steps == 1).all()


def test_shards(spark):
    df = docs(spark, 1003)
    out = hilbert_shards(df, ["source", "n"], 24, bits=3, sub_cells=8)
    assert out.columns == [*df.columns, "hilbert", "shard", "slot"]
    rows = out.collect()
    assert len(rows) == 1003
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    assert set(by) == set(range(24)) and {len(x) for x in by.values()} <= {41, 42}
    for part in by.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
    ordered = sorted(rows, key=lambda r: (r["shard"], r["slot"]))
    assert [r["hilbert"] for r in ordered] == sorted(r["hilbert"] for r in rows)
    key = lambda r: (str(r["doc_id"]), r["shard"], r["slot"], r["n"])
    again = hilbert_shards(df.repartition(5), ["source", "n"], 24, bits=3, sub_cells=8).collect()
    assert sorted(map(key, again)) == sorted(map(key, rows))
    assert hilbert_shards(df.limit(0), ["source", "n"], 24).count() == 0
    few = hilbert_shards(df.limit(3), ["source", "n"], 24).collect()
    assert len({r["shard"] for r in few}) == 3 and {r["slot"] for r in few} == {0}


def test_many_sources_join_by_shuffle(spark, monkeypatch):
    rows = [(i, f"t{i}", None if i % 7 == 0 else f"s{i % 7}") for i in range(700)] + [(10_000, "rare", "rare")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    few = sorted(map(tuple, mixing.poisson_mix(df).collect()), key=str)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 3)
    assert sorted(map(tuple, mixing.poisson_mix(df).collect()), key=str) == few


def test_text_cuts_see_whole_strings(spark):
    rows = [("",)] + [(f"a_long_shared_stem_{i % 16:02d}",) for i in range(1600)] + [(None,)]
    df = spark.createDataFrame(rows, "s string")
    cuts = text_cuts(df, "s", 16, parts=5)
    assert cuts == [f"a_long_shared_stem_{i:02d}" for i in range(15)]
    assert text_cuts(df.filter("s is null"), "s", 4) == []


def test_places_of_a_large_grid_are_computed(spark, monkeypatch):
    df = docs(spark, 300)
    table = sorted((r["n"], r["hilbert"]) for r in hilbert_shards(df, ["source", "n"], 3, bits=3).collect())
    monkeypatch.setattr(sharding, "TABLE_BITS", 0)
    assert sorted((r["n"], r["hilbert"]) for r in hilbert_shards(df, ["source", "n"], 3, bits=3).collect()) == table
