import base64
import gzip
import hashlib
import io

import pytest

from evalloom.llm import warc

SCHEMA = "page_id long, url string, html string, payload string, offset long"


class Sized(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def test_stream_splits_records_over_blocks(monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 7)
    payloads = [b"", b"a\r\n\r\nWARC/1.1\r\n", b"x" * 5000]
    raw = [warc.record(i, "http://a/\r\nb", p, 9, False, "1970-01-01T00:00:00Z") for i, p in enumerate(payloads)]
    assert list(warc.records_in(Sized(gzip.compress(b"".join(raw))))) == raw
    assert list(warc.records_in(Sized(b"".join(map(gzip.compress, raw))))) == raw
    assert warc.parse(raw[1])[1].endswith(payloads[1])
    with pytest.raises(ValueError):
        list(warc.records_in(Sized(gzip.compress(raw[2][:-3]))))


def test_round_trip_matches_brute_force(spark, tmp_path):
    htmls = [None, "", "<p>a</p>", "<p>a</p>", "é" * 3000, "\r\n\r\n", "<p>a</p>", "%0A"]
    rows = [(i, f"http://h/{i}" if i % 2 else None, h, "p", 1) for i, h in enumerate(htmls)] + [(None, "u%0A\n", "<p>a</p>", "p", 1), (6, "again", "<p>a</p>", "p", 1)]
    got = warc.archive_pages(spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path / "w")).collect()
    last = {}
    for i, _, h, *_ in rows:
        if i is not None:
            last[h or ""] = max(i, last.get(h or "", -1))
    want = []
    for i, u, h, *_ in rows:
        body = (h or "").encode()
        keep = i is None or i == last[h or ""]
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if keep else "revisit", None if keep else last[h or ""], u, True))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    members = sorted((tmp_path / "w" / "members").glob("*.warc.gz"))
    assert members and not list((tmp_path / "w" / "mono").glob("*.gz"))
    for m in members:
        data = m.read_bytes()
        for line in (m.parent / f"{m.name}.idx").read_text().splitlines():
            offset, length, _ = map(int, line.split())
            assert gzip.decompress(data[offset : offset + length]).startswith(b"WARC/1.1")


def test_small_payloads_are_not_revisits(spark, tmp_path):
    rows = [(1, "u", "ab", "p", 1), (2, "u", "ab", "p", 1)]
    got = warc.archive_pages(spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path / "w"), min_bytes=3).collect()
    assert {r.record_type for r in got} == {"response"}


def test_empty_table(spark, tmp_path):
    assert warc.archive_pages(spark, spark.createDataFrame([], SCHEMA), str(tmp_path / "w")).collect() == []


def test_archives_roll_and_each_has_a_task(spark, tmp_path, monkeypatch):
    rows = [(i, f"u{i}", f"{i}" * 3000, "p", 1) for i in range(60)]
    made = []
    original = warc.staged
    monkeypatch.setattr(warc, "staged", lambda df, name: (made.append((name, df.rdd.getNumPartitions())), original(df, name))[1])
    got = warc.archive_pages(spark, spark.createDataFrame(rows, SCHEMA).repartition(2), str(tmp_path / "w"), roll_bytes=20_000)
    assert sorted(r.page_id for r in got.collect()) == list(range(60)) and all(r.verified for r in got.collect())
    archives = len(list((tmp_path / "w" / "members").glob("*.warc.gz")))
    assert archives > 5 and dict(made)["warc-index"] == archives


def test_folders_without_a_scheme_go_to_the_default_file_system(spark):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    try:
        for default, want in (("hdfs://name:8020", "hdfs://name:8020/a/b"), ("hdfs://name:8020/", "hdfs://name:8020/a/b"), ("file:///", "file:///a/b")):
            conf.set("fs.defaultFS", default)
            assert warc.qualified(spark, "/a/b") == want
        assert warc.qualified(spark, "s3a://bucket/x") == "s3a://bucket/x" and warc.qualified(spark, "file:/x") == "file:/x"
    finally:
        conf.set("fs.defaultFS", before)
    assert warc.store_uri("s3a://bucket/x") == "s3://bucket/x" and warc.store_uri("hdfs://n:1/x") == "hdfs://n:1/x" and warc.store_uri("file:///x") == "file:///x"


@pytest.mark.parametrize("most", [0, 1000])
def test_payloads_are_not_shuffled_to_find_equal_ones(spark, most):
    rows = spark.createDataFrame([(i, f"u{i}", f"{i % 7}" * 50 if i % 2 else None, "p", 1) for i in range(90)] + [(None, "u", "1" * 50, "p", 1)], SCHEMA)
    made = warc.plan_records(rows, max_broadcast=most)
    got = {r.page_id: (r.refers_to, r.revisit) for r in made.collect()}
    last = {k: max(i for i in range(90) if (i % 7 if i % 2 else None) == k) for k in [None, *range(7)]}
    want = {i: (None, False) if last[i % 7 if i % 2 else None] == i else (last[i % 7 if i % 2 else None], True) for i in range(90)}
    assert got == want | {None: (None, False)}
    if most:
        assert "Exchange hashpartitioning" not in made._jdf.queryExecution().executedPlan().toString()
