import random

import corpus_pipeline

from placekit.llm.common import may_be_in


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(1)
    vocabulary = {"aa": [f"ka{i}lo" for i in range(300)], "bb": [f"xq{i}wz" for i in range(300)]}
    text = lambda lang, n: " ".join(rng.choice(vocabulary[lang]) for _ in range(n))
    items = [(i, text("aa", 30)) for i in range(3)]
    rows = [(i, text(k := rng.choice(["aa", "bb"]), rng.randrange(20, 200)), k, rng.choice(["s0", "s0", "s1", None]), 0) for i in range(300)]
    rows += [(1000, rows[0][1], rows[0][2], "s1", 0), (1001, rows[1][1] + " more", rows[1][2], "s1", 0), (1002, text("aa", 20) + " " + items[1][1] + " " + text("aa", 20), "aa", "s0", 0),
             (1003, "12 34", None, "s0", 0), (1004, None, None, "s0", 0), (2, rows[2][1], rows[2][2], "s0", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        columns, docs = docs.columns, spark.read.parquet(f"{tmp_path}/{i}")
        seen.append(sorted(r.doc_id for r in docs.select("doc_id").collect()))
        assert i == 4 or docs.columns == columns
    everything = sorted(r[0] for r in rows)
    assert set(everything) - set(seen[0]) == {1003, 1004} and len(seen[0]) == len(everything) - 2
    assert set(seen[0]) - set(seen[1]) == {1000, 1001} and seen[1].count(2) == 1
    assert set(seen[1]) - set(seen[2]) == {1002}
    assert 0.8 * len(seen[2]) < len(seen[3]) < 1.2 * len(seen[2])
    assert seen[4] == seen[3]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen[4])


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_bitmap_loses_no_row(spark):
    rows = spark.range(5000).withColumnRenamed("id", "k")
    got = {r.k for r in may_be_in(rows, rows.where("k % 7 = 0"), "k").collect()}
    assert {k for k in range(5000) if k % 7 == 0} <= got and len(got) < 1000


