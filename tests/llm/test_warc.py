import pytest
from pyspark.sql import functions as F

from stratalake.llm import warc

PAGES = [(1, "http://a/", "same"), (2, "http://b/", "same"), (9, "http://c/", "same"), (3, None, None), (4, "u", ""), (5, "http://d/", "own \r\n\r\n text é"), (6, "x\r\ny", "big " * 100_000), (6, "x\r\ny", "other"), (None, "n", "same"), (7, "z", "twin"), (7, "z", "twin"), (None, "p", "nobody's"), (None, "q", "nobody's"), (None, None, "nobody's")]


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    uri = f"file://{tmp_path_factory.mktemp('warc')}/w"
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(2)
    return uri, warc.write_bundles(pages, uri)


def test_read_back(written):
    uri, index = written
    got = warc.read_records(index, uri).collect()
    assert len(got) == len(PAGES)
    by_payload = {}
    for page, _, html in PAGES:
        by_payload.setdefault(html or "", []).append(-1 if page is None else page)
    expected = sorted((-1 if page is None else page, len((html or "").encode()), warc.payload_digest((html or "").encode()), max(by_payload[html or ""])) for page, _, html in PAGES)
    number = lambda page: -1 if page is None else page
    assert sorted((number(r.page_id), r.payload_bytes, r.payload_digest, number(r.page_id if r.record_type == "response" else r.refers_to)) for r in got) == expected
    assert all(r.refers_to is None for r in got if r.record_type == "response")
    assert sum(r.record_type == "response" for r in got) == len(by_payload)


def test_frames_stand_alone(written, spark):
    import zstandard

    uri, index = written
    for r in index.collect():
        fs, path = warc._filesystem(f"{uri}/bundles/{r.bundle}")
        f = fs.open_input_file(path)
        start, size, full = warc.seek_table(f)[r.frame]
        f.seek(start)
        frame = zstandard.ZstdDecompressor().decompress(f.read(size), max_output_size=full)
        assert frame[r.offset :].startswith(b"WARC/1.1\r\n") and frame[r.offset : r.offset + r.length].endswith(b"\r\n\r\n")


def test_whole_bundle_is_one_zstandard_stream(written):
    import zstandard

    uri, index = written
    fs, path = warc._filesystem(f"{uri}/bundles/{index.first().bundle}")
    text = zstandard.ZstdDecompressor().stream_reader(fs.open_input_file(path).read(), read_across_frames=True).read()
    assert text.count(b"WARC/1.1\r\n") >= 1


def test_larger_bound_and_empty(spark, tmp_path):
    pages = spark.createDataFrame([(1, "a", "xx"), (2, "b", "xx")], "page_id long, url string, html string")
    index = warc.write_bundles(pages, f"{tmp_path}/a", revisit_from=3)
    assert {r.record_type for r in warc.read_records(index, f"{tmp_path}/a").collect()} == {"response"}
    assert warc.op5_query(pages.limit(0)).collect() == []


def test_revisits_are_resolved_by_the_index(written):
    """Each Refers-To names a record of the index; it is a response with the revisit's digest."""
    uri, index = written
    places = {(r.page_id, r.row_key): r for r in index.collect()}
    assert len(places) == len(PAGES)
    read = {}
    for key, r in places.items():
        import zstandard

        fs, path = warc._filesystem(f"{uri}/bundles/{r.bundle}")
        f = fs.open_input_file(path)
        start, size, full = warc.seek_table(f)[r.frame]
        f.seek(start)
        frame = zstandard.ZstdDecompressor().decompress(f.read(size), max_output_size=full)
        read[key] = warc.parse(frame[r.offset : r.offset + r.length])
    for key, (fields, payload) in read.items():
        assert warc.page_and_key(fields["WARC-Record-ID"]) == key
        assert {"WARC-Date", "WARC-Target-URI", "Content-Type", "Content-Length"} <= fields.keys() and fields["WARC-Target-URI"]
        if fields["WARC-Type"] == "revisit":
            there, body = read[warc.page_and_key(fields["WARC-Refers-To"])]
            assert there["WARC-Type"] == "response" and there["WARC-Payload-Digest"] == fields["WARC-Payload-Digest"]
            assert warc.payload_digest(body) == fields["WARC-Payload-Digest"].removeprefix("sha1:") and len(body) == int(fields["X-Payload-Length"])


def test_groups_that_are_not_broadcast(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3).withColumn("digest", F.lit(1)).withColumn("salt", F.lit("s"))
    both = []
    for k, bound in (("a", 200_000), ("b", 0)):
        index = warc.write_bundles(pages, f"{tmp_path}/{k}", broadcast_groups=bound)
        both.append(sorted(map(str, warc.read_records(index, f"{tmp_path}/{k}").drop("row_key").collect())))
    assert both[0] == both[1]


def test_very_long_payload(spark, tmp_path):
    pages = spark.createDataFrame([(1, "a", "long " * 2_000_000), (2, "b", "long " * 2_000_000), (3, "c", "x")], "page_id long, url string, html string")
    got = warc.read_records(warc.write_bundles(pages, f"{tmp_path}/l"), f"{tmp_path}/l").collect()
    assert sorted((r.page_id, r.payload_bytes, r.refers_to) for r in got) == [(1, 10_000_000, 2), (2, 10_000_000, None), (3, 1, None)]
