"""Partitions of shuffles follow the size of the input."""

from stratalake import storage


def test_partitions_follow_the_input(spark, tmp_path, monkeypatch):
    for name, rows in (("customer", 4000), ("documents", 100_000)):
        spark.range(rows).selectExpr("id", "uuid() AS text").write.parquet(str(tmp_path / f"{name}.parquet"))
    before, name = spark.conf.get("spark.sql.shuffle.partitions"), "spark.sql.shuffle.partitions"
    try:
        assert storage.deal_by_size(spark, str(tmp_path)) == int(before)
        size = sum(f.stat().st_size for f in (tmp_path / "customer.parquet").glob("part-*"))
        monkeypatch.setattr(storage, "PARTITION_BYTES", size // 20)
        assert 20 <= storage.deal_by_size(spark, str(tmp_path)) <= 22
        assert 20 <= int(spark.conf.get(name)) <= 22
        monkeypatch.undo()
        assert storage.deal_by_size(spark, str(tmp_path)) == int(before)
        spark.conf.set(name, "9")
        assert storage.deal_by_size(spark, str(tmp_path)) == 9
    finally:
        spark.conf.set(name, before)
