"""WARC archives and the capture index against plain Python."""

import gzip
import random
import zlib

import pytest
from pyspark.sql import functions as F

from graphloom.llm import warc
from graphloom.llm.common import stored
from graphloom.sources.files import store_of

SCHEMA = "page_id long, url string, html string, payload string, offset long"


def pages(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(400):
        url = f"http://{rnd.choice('abc')}.example.com/{rnd.randrange(40)}" if i % 3 else "https://User@HOT.Example.org:80/p?q=1#f"
        html = f"<p>{rnd.randrange(60)} é\r\n\r\n</p>" if i % 5 else f"{i}"
        rows.append((i, url, html))
    rows += [(400, None, None), (401, "no address", ""), (402, "http://x/ a\n%0A", "y" * 5_000_000), (403, "http://h", "<p>1 é\r\n\r\n</p>"), (None, "http://n/", "only here"), (None, "http://n/", "399"), (7, "http://d/", "twice"), (7, "http://d/", "twice")]
    rnd.shuffle(rows)
    return spark.createDataFrame([(*r, "other", 3) for r in rows], SCHEMA).repartition(3)


def expected(rows):
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        refers = None if first.get(html or "", i) == i else first[html or ""]
        out.append((i, len(data), warc.digest(data), "revisit" if refers is not None else "response", refers))
    return sorted(out, key=repr)


def test_round_trip(spark, tmp_path):
    docs = pages(spark)
    rows = [(r.page_id, r.url, r.html) for r in docs.collect()]
    captures = warc.write_archives(warc.with_revisits(docs), f"{tmp_path}/a", file_bytes=4000)
    index = warc.build_index(captures, f"{tmp_path}/i", block_lines=5, shard_captures=20)
    assert index.shards.count() > 5
    assert index.shards.filter("first_key = 'org,example,hot)/p?q=1' and last_key = first_key").count() >= 2  # one key fills whole shards
    found = stored(warc.lookup(index, docs.select(warc.url_key(F.col("url")).alias("url_key"))), "found")
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, captures.collect()), key=repr)
    got = warc.read_records(found, f"{tmp_path}/a").collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == expected(rows)
    assert sorted(((r.page_id, r.url, bytes(r.payload).decode()) for r in got if r.record_type == "response"), key=repr) == sorted(
        ((i, u, h or "") for i, u, h in rows if (i, warc.digest((h or "").encode())) in {(r.page_id, r.payload_digest) for r in got if r.record_type == "response"}), key=repr
    )
    one = warc.lookup(index, spark.createDataFrame([("com,example,a)/3",), ("com,example,a)/absent",), ("zzz",), ("",)], "url_key string")).collect()
    assert len(one) == sum(u == "http://a.example.com/3" for _, u, _ in rows)


def test_archives_are_plain_gzip_members(spark, tmp_path):
    captures = warc.write_archives(warc.with_revisits(pages(spark)), f"{tmp_path}/a").collect()
    for r in captures[:20]:
        data = open(f"{tmp_path}/a/{r.file}", "rb").read()
        assert zlib.decompress(data[r.offset : r.offset + r.length], 31).startswith(b"WARC/1.1\r\nWARC-Type: ")
        assert gzip.decompress(data).count(b"WARC/1.1\r\n") == sum(c.file == r.file for c in captures)


def test_url_key(spark):
    cases = {
        "http://M.Example.org:8080/A/b?x=1#top": "org,example,m)/A/b?x=1", "https://u:p@h.net": "net,h)/", "no address": ")no address", None: ")/", "http://h.net?q": "net,h)?q", "ftp+x://a.b/#": "b,a)/",
    }
    df = spark.createDataFrame([(u,) for u in cases], "u string").select("u", warc.url_key(F.col("u")).alias("k"))
    assert {r.u: r.k for r in df.collect()} == cases


def test_least_bytes_and_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([(2, "a", ""), (1, "b", ""), (3, "c", "long"), (4, "d", "long")], "page_id long, url string, html string")
    assert {r.page_id: r.refers_to for r in warc.with_revisits(docs, least_bytes=1).collect()} == {1: None, 2: None, 3: None, 4: 3}
    none = docs.filter("page_id < 0")
    captures = warc.write_archives(warc.with_revisits(none), f"{tmp_path}/a")
    index = warc.build_index(captures, f"{tmp_path}/i")
    found = stored(warc.lookup(index, none.select(warc.url_key(F.col("url")).alias("url_key"))), "none")
    assert warc.read_records(found, f"{tmp_path}/a").count() == 0
    assert warc.lookup(index, spark.createDataFrame([("x",)], "url_key string")).count() == 0


def test_a_damaged_record_is_an_error():
    whole = warc.record(1, "http://a/", b"payload", None, "2020-01-01T00:00:00Z")
    assert warc.parse(whole)[6] == b"payload"
    with pytest.raises(ValueError, match="damaged"):
        warc.parse(whole.replace(b"payload", b"pay1oad"))


def test_attempts_that_failed_leave_nothing_that_is_read(spark, tmp_path):
    rows = warc.with_revisits(pages(spark))
    store, base = store_of(f"{tmp_path}/a")
    store.create_dir(base)
    with store.open_output_stream(f"{base}/pages-of-a-lost-attempt.warc.gz", compression=None) as f:
        f.write(b"half a reco")
    captures = warc.write_archives(rows, f"{tmp_path}/a")
    assert warc.read_records(captures, f"{tmp_path}/a").count() == captures.count() == rows.count()
