import hashlib
import zlib
from collections import defaultdict

import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from scriptloom.llm import warc as W

SCHEMA = "page_id long, url string, html string, n int, file string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, 1, "x") for i, u, h in rows], SCHEMA)


BIG = "é" * 60
ROWS = [
    (5, "http://a.example.com/x?q=1#top", BIG), (2, "https://b.example.com:8080/", BIG), (9, None, BIG),
    (1, "http://a.example.com/x?q=1", "short"), (3, "http://A.example.com/x?q=1", "short"), (4, "http://c/\r\nWARC/1.1", None),
    (6, "nothing like a url", ""), (None, "http://u@d.example/", BIG), (7, "http://e/", "WARC/1.1\r\n\r\n" + "z" * 200_000),
    (8, "http://e/", BIG[:-50] + "x" * 99),
]


def expected(rows):
    first = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 100 and i is not None:
            first[b] = min(first.get(b, i), i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        f = first.get(b)
        revisit = f is not None and f != i
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", f if revisit else None))
    return sorted(map(str, out))


def test_round_trip(spark):
    got = W.archive_round_trip(pages(spark, ROWS)).collect()
    assert sorted(str(tuple(r)) for r in got) == expected(ROWS)
    twice = [*ROWS, ROWS[0], ROWS[1]]
    assert sorted(str(tuple(r)) for r in W.archive_round_trip(pages(spark, twice)).collect()) == expected(twice)
    assert W.archive_round_trip(pages(spark, [])).collect() == []


def test_index_finds_every_capture_of_a_key(spark, tmp_path):
    rows = [(i, f"http://h{i % 40}.example.com/p", f"text {i}" * 30) for i in range(400)]
    rows += [(1000 + i, "http://hot.example.com/", f"body {i}") for i in range(150)]
    path = f"file://{tmp_path}/w"
    captures = W.write_archives(pages(spark, rows), path)
    files = W.write_index(captures, path, block_lines=7)
    index = W.CaptureIndex(files, path)
    want = defaultdict(list)
    for r in captures.collect():
        want[r["key"]].append(r["page_id"])
    for key, ids in want.items():
        assert sorted(x[1] for x in index.find(key)) == sorted(ids)
    for key in ("", "com,example,h1)", "com,example,h1)/p0", "zz", "com,example,hot)/x"):
        assert list(index.find(key)) == []
    bodies = W.read_records(captures.where(F.col("key") == "com,example,h3)/p"), path, payloads=True).collect()
    assert {r["page_id"]: r["payload"].decode() for r in bodies} == {i: f"text {i}" * 30 for i in range(3, 400, 40)}


def test_archives_are_plain_members(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    W.write_archives(pages(spark, ROWS), path).collect()
    n = 0
    for info in pafs.LocalFileSystem().get_file_info(pafs.FileSelector(f"{tmp_path}/w")):
        data = open(info.path, "rb").read()
        while data:
            member = zlib.decompressobj(31)
            assert member.decompress(data).startswith(b"WARC/1.1\r\n")
            data, n = member.unused_data, n + 1
    assert n == len(ROWS)


def test_damage_is_noticed():
    whole = W._record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None)
    assert W.parse_record(whole)["payload"] == b"payload"
    with pytest.raises(ValueError):
        W.parse_record(whole.replace(b"payload\r\n", b"pAyload\r\n"))


def test_keys(spark):
    urls = ["http://User@WWW.Example.com:80/a/B?c#d", "https://x.org", "ftp://h", "no scheme/p", None, "//h.i/j"]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(W.url_key(F.col("u")).alias("k")).collect()
    assert [r["k"] for r in got] == ["com,example,www)/a/B?c", "org,x)", "h)", "no scheme)/p", "", "i,h)/j"]


def test_schemes_and_addresses(spark):
    with pytest.raises(ValueError, match="cannot be written"):
        W.opened("nothing://bucket/x")
    try:
        kind = W.opened("s3a://bucket/x")[0].type_name
    except OSError:  # no network to look the bucket up
        kind = "s3"
    assert kind == "s3"
    urls = ["http://[::1]:80/a", "https://u@[2001:db8::2]/b?c#d", "http://a.b:8080/c"]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(W.url_key(F.col("u")).alias("k")).collect()
    assert [r["k"] for r in got] == ["[::1])/a", "[2001:db8::2])/b?c", "b,a)/c"]
