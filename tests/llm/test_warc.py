"""Archives written and read back, split at every byte, damaged, and holding archives themselves."""

import gzip
import hashlib
import random
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewell.llm import warc
from tracewell.llm.warc import DamagedArchive, Members, op13_warc, parse_records, read_warc, write_warc


def record(i, body, level=6, kind="response"):
    data = warc.render({"id": str(i), "uri": f"http://x/{i}", "type": kind, "refers_to": None, "digest": None, "length": len(body), "payload": body}, "d")
    return warc.gzip_member(data, level)


def members(data):
    return Members(pa.BufferReader(data), len(data))


def split_read(data, size):
    out = []
    for a in range(0, len(data), size):
        out += members(data).owned(a, min(len(data), a + size))
    return out


def test_each_record_is_owned_once_wherever_the_splits_are():
    rng = random.Random(1)
    bodies = [bytes(rng.choices(b"ab <>", k=rng.choice([0, 3, 200, 3000]))) for _ in range(12)]
    data = b"".join(record(i, b) for i, b in enumerate(bodies))
    whole = split_read(data, len(data))
    assert [next(parse_records(d))["payload"] for _, d in whole] == bodies
    for size in [1, 2, 3, 7, 50, 333, 1000, len(data) - 1]:
        assert split_read(data, size) == whole, size


def test_magic_and_archives_inside_payloads():
    inner = b"".join(record(100 + i, b"inner %d" % i) for i in range(3))
    bodies = [b"a" * 50, warc.MAGIC * 40, b"pre" + inner + b"post", gzip.compress(b"no record"), b"z"]
    data = b"".join(record(i, b, level=0) for i, b in enumerate(bodies))  # level 0 stores payloads as they are
    whole = split_read(data, len(data))
    assert [next(parse_records(d))["payload"] for _, d in whole] == bodies
    for size in [97, 150, 211, 400, 1000]:
        assert split_read(data, size) == whole, size


def test_damage_is_reported_not_skipped():
    parts = [record(i, b"x%d" % i * 300) for i in range(6)]
    for broken in (b"".join([*parts[:3], b"garbage", *parts[3:]]), b"".join(parts)[:-9]):
        for size in [40, 90, len(broken)]:
            with pytest.raises(DamagedArchive):
                split_read(broken, size)
    flipped = bytearray(b"".join(parts))
    flipped[len(parts[0]) + len(parts[1]) // 2] ^= 255
    with pytest.raises(DamagedArchive):
        split_read(bytes(flipped), 70)


def test_member_with_many_records_and_foreign_digests():
    plain = b"".join(zlib.decompress(record(i, b"p%d" % i), 31) for i in range(3))
    assert [r["payload"] for r in parse_records(plain)] == [b"p0", b"p1", b"p2"]
    other = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Payload-Digest: md5:ABCD\r\nContent-Length: 4\r\n\r\nbody\r\n\r\n"
    (r,) = parse_records(other)
    assert (r["type"], r["payload"], r["length"], r["digest"], r["record_id"]) == ("resource", b"body", 4, "abcd", None)


LONG = "é" * 600
ROWS = [
    (1, "http://a", LONG), (2, "http://b", LONG), (3, None, LONG), (4, "http://d d\r\nX: y", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""),
    (None, "u", LONG), (None, "u", "z" * 1000), (8, "u", "y" * 1000), (8, "u", "y" * 1000), (9, "u", "y" * 1000), (10, "u", "w" * 999), (11, "u", "w" * 999),
    (12, "u", "line\r\n\r\nline\x00" * 9000),
]


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumns({c: F.lit(7) for c in ("digest", "length", "keep", "again", "payload", "type")})
    write_warc(df.repartition(3), str(tmp_path / "w"))
    (tmp_path / "w" / "part-of-a-failed-attempt.warc.gz").write_bytes(b"half")
    for split in [64 << 20, 301]:
        got = read_warc(spark, str(tmp_path / "w"), split).withColumn("row", warc.row_ids("record_id")).filter("type <> 'warcinfo'").collect()
        assert len(got) == len(ROWS)
        for i, url, body in ROWS:
            same = [b for a, _, b in ROWS if b == body and a is not None]
            data = (body or "").encode()
            keep = max((a for a, _, b in ROWS if b == body and a is not None), default=None) if len(data) >= 1000 and same else None
            refers = keep if keep is not None and i != keep else None
            mine = [r for r in got if r["row"] == (None if i is None else str(i)) and r["length"] == len(data) and r["digest"] == hashlib.sha1(data).hexdigest()]
            assert mine and all(r["type"] == ("response" if refers is None else "revisit") for r in mine), (i, mine)
            assert all((bytes(r["payload"]) == data) if refers is None else r["payload"] is None and warc.row_id(r["refers_to"]) == str(refers) for r in mine)
    assert {r["uri"] for r in got} == {"http://a", "http://b", None, "http://d%20d%0D%0AX:%20y", "u"}
    write_warc(df.limit(0), str(tmp_path / "empty"))
    assert read_warc(spark, str(tmp_path / "empty")).count() == 0


def test_ids_that_need_quoting(spark, tmp_path):
    ids = ["a b+c%", "", "ü/<x>", "urn:x-no-id"]
    df = spark.createDataFrame([(i, "u", i) for i in ids] + [(None, "u", "n")], "page_id string, url string, html string")
    write_warc(df, f"file://{tmp_path}/w")
    got = read_warc(spark, f"file://{tmp_path}/w").filter("type = 'response'").select(warc.row_ids("record_id").alias("i"), F.col("payload").cast("string").alias("p"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(i, i) for i in ids] + [(None, "n")], key=str)


def test_query(spark):
    d = "/root/testdata/sf0.001"
    got = {r["page_id"]: r for r in op13_warc(spark, d).collect()}
    rows = spark.read.parquet(f"{d}/pages.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        data = (r["html"] or "").encode()
        g = got[r["page_id"]]
        keep = max(x["page_id"] for x in rows if x["html"] == r["html"])
        revisit = len(data) >= 1000 and keep != r["page_id"]
        assert (g["payload_bytes"], g["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest())
        assert (g["record_type"], g["refers_to"]) == (("revisit", keep) if revisit else ("response", None))
