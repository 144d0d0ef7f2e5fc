from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from stratalake.llm import decontaminate, mixing, ngram_join


def test_stages_on_a_small_folder(spark, docs, tmp_path):
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, docs.where("doc_id = 3").first().text)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    before = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = before.columns
    for name, stage in P.STAGES[:4]:
        after = stage(spark, before, str(tmp_path))
        assert after.columns == columns
        ids, kept = [r.doc_id for r in before.select("doc_id").collect()], [r.doc_id for r in after.select("doc_id").collect()]
        assert set(kept) <= set(ids)
        if name == "benchmark_decontamination":
            assert 3 in ids and 3 not in kept
        path = f"{tmp_path}/{name}"
        after.write.parquet(path)
        before = spark.read.parquet(path)
    assert before.count() > 0
    assert P.STAGES[4][1](spark, before, str(tmp_path)).count() > 0
    assert decontaminate.leaks(before, spark.read.parquet(f"{tmp_path}/benchmark.parquet")).count() == 0


def test_run_gives_packed_rows(spark, docs, tmp_path):
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "no such text")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).where("n_tokens > 0").count() > 0


def test_mix_takes_documents_to_the_nearest_whole(spark, docs):
    """Copies of each document against the words that the mix takes of it; columns of any name stay."""
    before = docs.where("doc_id IS NOT NULL").withColumn("taken", F.concat(F.lit("t"), F.col("doc_id"))).withColumn("target", F.lit("mine"))
    got = P.mix(spark, before, "").collect()
    assert P.mix(spark, before, "").columns == before.columns
    wanted = {r.doc_id: (2 * r.taken + r.size) // (2 * r.size) if r.size else 0 for r in mixing.op9_query(before.select("doc_id", "text", "source")).collect()}
    assert Counter(r.doc_id for r in got) == {d: n for d, n in wanted.items() if n}
    assert all(r.taken == f"t{r.doc_id}" and r.target == "mine" and r.size == r.doc_id * 7 for r in got if r.doc_id < 60)


def test_empty_tables(spark, empty, tmp_path):
    """Every stage keeps the columns of an empty table; there are no packed rows."""
    spark.createDataFrame([(1, "no such text")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in P.STAGES[:4]:
        after = stage(spark, empty, str(tmp_path))
        assert after.columns == empty.columns and after.count() == 0, name
    assert P.pack(spark, empty, str(tmp_path)).count() == 0


@pytest.mark.parametrize("n,percent", [(5, 80)])
def test_near_duplicates_use_five_words(n, percent, spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(ngram_join, "keep_one_per_group", lambda docs, **s: seen.update(s) or docs)
    P.drop_near_duplicates(spark, None, "")
    assert seen == {"n": n, "percent": percent}
