import random

import corpus_pipeline as cp
from quillframe.llm import queries


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    sounds = {"en": ["the", "ing", "wh", "tion"], "de": ["sch", "ung", "der", "ö"]}
    make = lambda lang, n: " ".join("".join(rng.choice(sounds[lang]) for _ in range(4)) for _ in range(n))
    rows = [(i, make(lang, rng.randint(20, 90)), lang, f"s{i % 3}", 1, "x") for i, lang in enumerate(["en", "de"] * 60)]
    item = rows[0][1].split()[:12]
    rows += [
        (500, rows[5][1] + " tail", "de", "s0", 1, "x"), (501, rows[5][1], "de", "s0", 1, "x"), (502, None, None, None, None, None), (503, "123 456", "en", "s1", 1, "x"),
        (504, make("en", 30) + " " + " ".join(item), "en", "s1", 1, "x"), (None, make("de", 40), "de", None, None, None), (7, rows[7][1], "de", "s1", 1, "x"), (8, make("de", 50), "de", "s2", 1, "x"),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for name, stage in cp.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "sharding":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in docs.select("doc_id").collect()))
        assert docs.filter("score <> 'x'").isEmpty()
    ids = seen
    assert set(range(120)) <= set(ids[0]) and not {502, 503} & set(ids[0]) and -1 in seen[0]
    assert set(ids[0]) - set(ids[1]) == {500, 501} and ids[1].count(7) == 1 and ids[1].count(8) == 2
    assert set(ids[1]) - set(ids[2]) == {0, 504}
    assert set(ids[3]) <= set(ids[2]) and ids[4] == ids[3]
    assert docs.select("shard").distinct().count() == cp.N_SHARDS
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in cp.run(spark, str(tmp_path)).select("doc_id").collect()) == seen[-1]


def test_stages_on_an_empty_table(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_every_operator_has_a_query():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)]
    assert set(queries.oracle_sql()) <= set(names)
