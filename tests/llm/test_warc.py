import base64
import glob
import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F
from tabwatch.llm import warc as X

SCHEMA = "page_id long, url string, html string, record string, type string, chunk int, data string"


def table(spark, rows):
    return spark.createDataFrame([(i, u, h, "r", "t", 1, "d") for i, u, h in rows], SCHEMA).repartition(3)


def sha1(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def plainly(rows, min_bytes=0):
    """Type and reference of every row from a plain dictionary, repeated rows in any order."""
    top = {}
    for i, _, h in rows:
        top[h or ""] = max(top.get(h or "", -1), -1 if i is None else i)
    out, used = [], set()
    for i, _, h in rows:
        h = h or ""
        size, key = len(h.encode()), (h, i)
        first = size < min_bytes or ((-1 if i is None else i) == top[h] and key not in used)
        used.add(key)
        out.append((i, size, sha1(h), "response" if first else "revisit", None if first or top[h] == -1 else top[h]))
    return sorted(out, key=repr)


ROWS = [
    (1, "http://a/1", None), (2, "http://a/2", ""), (3, None, "x"), (4, "http://a b\r\nWARC-Type: evil", "same é"), (5, "http://é/ü: x", "same é"), (9, "u", "same é"), (9, "u", "same é"),
    (10, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n"), (11, "u", "a\r\n\r\nWARC/1.1\r\n" * 40), (12, "u", "\r\n\r\n" * 50), (13, "u", "é" * 5000), (14, "u", "\r\n\r\nWARC/1.1"), (15, "u", "\n\r\n"),
    (None, "u", "no id"), (None, "u", "no id"), (None, "u", "x"), (16, "u", "😀" * 40_000), (17, "u", "0" * 64), (18, "u", "1" * 65),
]


@pytest.mark.parametrize("size", [7, 64, 1000, X.CHUNK_BYTES])
def test_archives_read_back_equal(spark, size):
    got = X.digests(X.round_trip(table(spark, ROWS), size=size)).collect()
    assert sorted(map(tuple, got), key=repr) == plainly(ROWS)


def test_payload_bytes_come_back_whole(spark, tmp_dir):
    path = os.path.join(tmp_dir, "w")
    X.write(table(spark, ROWS), path, size=100)
    segments = X.read(spark, path).where("type <> 'revisit'").orderBy("origin", "segment").collect()
    whole, sizes = {}, set()
    for s in segments:
        whole[s.origin] = whole.get(s.origin, b"") + s.payload
        sizes.add(len(s.payload))
    assert sorted(whole.values()) == sorted({(h or "").encode() for _, _, h in ROWS}) and max(sizes) <= 100
    assert {s.type for s in segments} == {"response", "continuation"}
    urls = {s.url for s in segments if s.type == "response"}
    assert "http://é/ü: x" in urls or "http://a%20b%0D%0AWARC-Type:%20evil" in urls or "u" in urls


def test_files_are_read_in_any_splits(spark, tmp_dir):
    path = os.path.join(tmp_dir, "w")
    rng = random.Random(5)
    rows = [(i, "u", "".join(rng.choice(["\r\n", "\r\n\r\n", "WARC/1.1\r\n", "WA", "é", "<p>"]) for _ in range(rng.randrange(60)))) for i in range(60)]
    X.write(table(spark, rows).coalesce(1), path, size=50)
    want = plainly(rows)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for split in (397, 3000, 1 << 20):
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            spark.conf.set("spark.sql.files.openCostInBytes", 1)
            assert sorted(map(tuple, X.digests(X.payloads(X.read(spark, path))).collect()), key=repr) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_small_payloads_are_all_responses(spark):
    got = X.digests(X.round_trip(table(spark, ROWS), min_bytes=8)).collect()
    assert sorted(map(tuple, got), key=repr) == plainly(ROWS, min_bytes=8)


def test_a_hot_payload(spark):
    rows = spark.range(6000).selectExpr("id as page_id", "'u' as url", "if(id % 3 = 0, 'hot', concat('p', id)) as html")
    got = X.digests(X.round_trip(rows))
    assert got.where("page_id % 3 = 0 and page_id < 5997 and record_type = 'revisit' and refers_to = 5997").count() == 1999
    assert got.where("record_type = 'response' and refers_to is null").count() == 4001


def test_running_digests_of_chunks(spark):
    rows = X.chunks(table(spark, [(1, "u", "ab" * 500)]), size=300).orderBy("chunk").collect()
    assert [(r.chunk, r.end, r.last) for r in rows] == [(0, 300, False), (1, 600, False), (2, 900, False), (3, 1000, True)]
    assert [r.sha1 for r in rows] == [sha1(("ab" * 500)[: r.end]) for r in rows]


def test_damage_is_an_error(spark, tmp_dir):
    def damaged(name, old, new):
        path = os.path.join(tmp_dir, name)
        X.write(table(spark, [(1, "u", "abcdef" * 10)]).coalesce(1), path, size=20)
        [file] = [f for f in glob.glob(path + "/*.txt") if os.path.getsize(f)]
        data = open(file, "rb").read()
        assert old in data
        out = os.path.join(tmp_dir, name + "_new")
        os.mkdir(out)
        with open(os.path.join(out, "a.txt"), "wb") as f:
            f.write(data.replace(old, new, 1))
        X.payloads(X.read(spark, out)).collect()

    for name, old, new in (("digest", b"abc", b"abd"), ("gap", b"WARC-Segment-Number: 2", b"WARC-Segment-Number: 9"), ("length", b"Content-Length: 20", b"Content-Length: 2000")):
        with pytest.raises(Exception, match="payload of|does not follow|block shorter"):
            damaged(name, old, new)


def test_empty_table(spark):
    assert X.digests(X.round_trip(table(spark, ROWS).limit(0))).count() == 0
    assert X.verdicts(X.chunks(table(spark, ROWS).limit(0))).where(F.lit(True)).count() == 0
