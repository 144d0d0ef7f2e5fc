from pyspark.sql import functions as F

from stratalake.llm import token_counts as T


def brute(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(T.tokenizer_path("byte_bpe_50k.json"))
    return [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]


def test_equals_the_library(docs, rows):
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in T.op10_query(docs).collect())
    n = brute([r[1] for r in rows])
    assert got == sorted((-1 if r[0] is None else r[0], len((r[1] or "").encode()), k, k > 512) for r, k in zip(rows, n, strict=True))


def test_special_strings_and_odd_blanks(spark):
    texts = ["a<|endoftext|>b", "x  y z\u0085", "\x1c\x1d", "日本語 😀", "I'll can't 's", " \n\n  x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.n_tokens for r in T.token_counts(df).orderBy("doc_id").collect()] == brute(texts)


def test_cache_is_used_and_appended(spark, tmp_path):
    cache = f"{tmp_path}/cache"
    first = spark.createDataFrame([(1, "one two"), (2, "one two"), (3, None)], "doc_id long, text string")
    T.token_counts(first, cache=cache).collect()
    assert spark.read.parquet(cache).count() == 2
    # a stored count is taken as it is, so a false one shows that nothing is encoded again
    bad = spark.read.parquet(cache).withColumn("n_tokens", F.lit(99).cast("long"))
    bad.write.parquet(f"{tmp_path}/false")
    second = spark.createDataFrame([(1, "one two"), (4, "three")], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in T.token_counts(second, cache=f"{tmp_path}/false").collect()}
    assert got[1] == 99 and got[4] == brute(["three"])[0]
    assert spark.read.parquet(f"{tmp_path}/false").count() == 3


def test_other_tokenizer_and_empty(spark, empty):
    df = spark.createDataFrame([(1, "plain words")], "doc_id long, text string")
    assert T.token_counts(df, "piece_bpe_32k.model").first().n_tokens > 0
    assert T.op10_query(empty).collect() == []


def test_unreadable_cache_is_an_error(spark, tmp_path):
    import pytest

    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part.parquet").write_text("no parquet")
    with pytest.raises(Exception, match="(?i)parquet"):
        T.token_counts(spark.createDataFrame([(1, "a")], "doc_id long, text string"), cache=f"{tmp_path}/broken").collect()


def test_very_long_text_and_clashing_names(spark):
    texts = ["long words " * 300_000, None, "a", "a"]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, digest string, n_tokens int")
    assert [r.n_tokens for r in T.op10_query(df).orderBy("doc_id").collect()] == brute(texts)
