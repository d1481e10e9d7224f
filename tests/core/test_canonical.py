"""Golden cases and idempotence of canonical forms."""

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tracewell.functions import canonical as C
from tracewell.sources import records as S


def column(spark, values):
    return spark.createDataFrame([(v,) for v in values], "x string")


def forms(df):
    return {r["x"]: (r["canonical"], r["error"]) for r in df.collect()}


def test_addresses(spark):
    got = forms(C.canonicalise_ip(column(spark, ["2001:0db8:0000:0000:0000:0000:0000:0001", "10.0.0.0/8", "2001:db8::/32", "300.1.2.3", "172.16.0.0/40", "fe80::1%eth0", "01.2.3.4", None, "::ffff:192.0.2.1"]), "x"))
    assert got["2001:0db8:0000:0000:0000:0000:0000:0001"][0] == "2001:db8::1"
    assert got["10.0.0.0/8"][0] == "10.0.0.0/8" and got["2001:db8::/32"][0] == "2001:db8::/32"
    for bad in ("300.1.2.3", "172.16.0.0/40", "fe80::1%eth0", "01.2.3.4", None):
        assert got[bad] == (None, "invalid_ip")
    assert got["::ffff:192.0.2.1"][0] == "::ffff:192.0.2.1"


def test_domains_and_mail(spark):
    got = forms(C.canonicalise_domain(column(spark, ["example.com.", "  Example.com  ", "münchen.de", "", "a_b.c"]), "x"))
    assert got["example.com."][0] == got["  Example.com  "][0] == "example.com"
    assert got["münchen.de"][0] == "xn--mnchen-3ya.de" and got[""][1] == "invalid_domain" and got["a_b.c"][0] == "a_b.c"
    got = forms(C.canonicalise_email(column(spark, ["Ada.L@Mail.Example.NET", "no at sign", "@example.com", "user@", "a@b@C.d"]), "x"))
    assert got["Ada.L@Mail.Example.NET"][0] == "Ada.L@mail.example.net" and got["a@b@C.d"][0] == "a@b@c.d"
    assert all(got[x][1] == "invalid_email" for x in ("no at sign", "@example.com", "user@"))


def test_hashes_and_times(spark):
    got = forms(C.canonicalise_hash(column(spark, ["A" * 32, "b" * 40, "abc123", "zz-9"]), "x"))
    assert got["A" * 32][0] == "a" * 32 and got["abc123"][1] == "invalid_hash" and got["zz-9"][1] == "invalid_hash"
    got = forms(C.canonicalise_timestamp(column(spark, ["1705318200", "2024-01-15 10:30:00", "2024-01-15T10:30:00.9+02:00", "12/25/2024 00:00:00", "03/04/2024 00:00:00", "in a while"]), "x"))
    assert got["1705318200"][0] == "2024-01-15T11:30:00Z" and got["2024-01-15 10:30:00"][0] == "2024-01-15T10:30:00Z"
    assert got["2024-01-15T10:30:00.9+02:00"][0] == "2024-01-15T08:30:00Z"
    assert got["12/25/2024 00:00:00"][0] == "2024-12-25T00:00:00Z" and got["03/04/2024 00:00:00"][0] == "2024-04-03T00:00:00Z"
    assert got["in a while"] == (None, "invalid_timestamp")
    got = forms(C.canonicalise_timestamp(column(spark, ["2023-07-04T05:06:07", "2023-07-04"]), "x"))
    assert got["2023-07-04T05:06:07"][0] == "2023-07-04T05:06:07Z" and got["2023-07-04"] == (None, "invalid_timestamp")


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=12), min_size=1, max_size=20))
def test_forms_are_stable(spark, values):
    for job in (C.canonicalise_domain, C.canonicalise_email, C.canonicalise_hash, C.canonicalise_ip):
        once = job(column(spark, values), "x").select(F.col("canonical").alias("x")).filter("x is not null")
        for r in job(once, "x").collect():
            assert r["canonical"] == r["x"]


def test_golden_records(spark):
    lines = ['{"field_type":"domain","value":"Example.COM"}', '["domain", "Example.COM"]', "email,user@EXAMPLE.COM", '"ip, 192.0.2.1 "', '{"v":"x"}', "  ", '{"broken', '[1,2]', '{"type":"a","field":"b","val":"c","raw":"d"}', '{bad,json']
    rows = S.parse_kv_lines(spark.createDataFrame([(x,) for x in lines], "line string")).collect()
    got = {r["line"]: (r["field_type"], r["raw"], r["error"]) for r in rows}
    assert len(rows) == 9
    assert got[lines[0]] == got[lines[1]] == ("domain", "Example.COM", None)
    assert got[lines[2]] == ("email", "user@EXAMPLE.COM", None) and got[lines[3]] == ("ip", "192.0.2.1", None)
    assert got[lines[4]][2] == "missing_member" and got[lines[6]][2] == "not_a_record" and got[lines[7]][2] == "missing_member"
    assert got[lines[8]] == ("a", "c", None) and got[lines[9]][2] == "broken_json"
    light = C.canonicalise_light(spark.createDataFrame([("hash", " 9F8E7D "), ("domain", "A.b."), ("ip", " 1.2.3.4\t"), ("hash", "_é1_")], "field_type string, raw string"))
    assert [r["canonical"] for r in light.collect()] == ["9f8e7d", "a.b", "1.2.3.4", "é1"]


@pytest.mark.parametrize(
    "head, hint, kind",
    [(b"\x1f\x8b\x08\x00\x00", None, "gzip"), (b"PK\x03\x04\x00", None, "zip"), (b'{"q":1}\n{"r":2}\n', None, "ndjson"), (b'{"q":1, "r":2}\n', None, "json"),
     (b"h,k\n7,8\n", None, "csv"), (b"h\tk\n7\t8\n", None, "tsv"), (b"plain bytes", "csv", "csv"), (b"plain bytes", "ndjson", "ndjson"),
     (b"\xff\x00\x01\x02\x03\x04\x05\x06", None, "binary"), (b"no marks here\nnor there\n", None, "text"), (b"", None, "text"),
     (b"one line\nthen, another", None, "text"), ("é".encode() * 20, None, "binary"), (b'{"a":1\n{"b":2}', None, "ndjson"), (b'{"a":1}\n\n', None, "ndjson"),
     (b"plain bytes", "JSONL", "ndjson"), (b"plain bytes", "gz", "gzip"), (b"plain bytes", "text", "text"), (b"a,b", "nonsense", "csv")],
)
def test_kinds(spark, head, hint, kind):
    df = spark.createDataFrame([("p", head, hint)], "path string, content binary, hint string")
    assert S.classify_dumps(df).first()["kind"] == kind


def test_zip_and_csv_files(spark, tmp_path):
    import zipfile

    (tmp_path / "z").mkdir()
    for i in range(3):
        with zipfile.ZipFile(tmp_path / "z" / f"{i}.zip", "w") as z:
            z.writestr("a", f'{{"type":"n","v":"{i}"}}\nbad\n')
            z.writestr("b", "n,ignored")
    rows = S.read_kv_zip(spark, str(tmp_path / "z"), "ndjson").collect()
    assert sorted(r["raw"] for r in rows if not r["error"]) == ["0", "1", "2"] and len(rows) == 6
    (tmp_path / "c.csv").write_text("field_type,value\ndomain,Example.COM\n a , \"b,c\" ,extra\nlonely\n")
    got = {r["field_type"]: (r["raw"], r["error"]) for r in S.read_kv_csv(spark, str(tmp_path / "c.csv")).collect()}
    assert got == {"domain": ("Example.COM", None), "a": ("b,c", None), "lonely": (None, "ragged_row")}


def test_sanitised_names(spark):
    df = spark.createDataFrame([("Du-mp Node; 7", {"a b": "1", "a-b": "2", "9x": "3", "": "4"}), ("?!", {}), ("42nd", {})], "label string, props map<string,string>")
    rows = C.sanitise_names(df, "label", "props").collect()
    assert rows[0]["label"] == "DumpNode7" and rows[0]["props"] == {"a_b": "2", "9x": "3", "prop": "4"}
    assert rows[1]["label"] == "FieldValue" and rows[2]["label"] == "42nd"


def test_forms_of_records(spark):
    lines = ['{"type":" Domain ","value":" X "}', '[" E-Mail ", " y "]', '" Ip , z "', "HASH , w ", '{"type":"a","value":"' + "b" * 50 + '"}', ",x", '{"type":"a","value":1}']
    got = {r["line"]: (r["field_type"], r["raw"], r["error"]) for r in S.parse_kv_lines(spark.createDataFrame([(x,) for x in lines], "line string"), max_line=60).collect()}
    assert [got[x][:2] for x in lines[:4]] == [("domain", "X"), ("e-mail", "y"), ("ip", "z"), ("hash", "w")]
    assert got[lines[4]] == (None, None, "line_too_long") and got[lines[5]] == ("", "x", None) and got[lines[6]][2] == "missing_member"


def test_dumps_by_their_kind(spark, tmp_path):
    import gzip
    import zipfile

    (tmp_path / "d" / "sub").mkdir(parents=True)
    put = lambda name, data: (tmp_path / "d" / name).write_bytes(data)
    put("a", b'{"type":"N","v":"1"}\n{"type":"N","v":"2"}\nnot a record\n')
    put("b", b'kind,value\r\nn,"3,4"\r\nlonely\r\n')
    put("c", b"kind\tvalue\nn\t5\n")
    put("sub/d.gz", gzip.compress(b"kind,value\nn,6\n"))
    put("e.gz", gzip.compress(b"kind,value\n")[:-9])
    put("f", bytes(range(128, 256)))
    put("g.txt", "prose".encode())
    put("empty", b"")
    with zipfile.ZipFile(tmp_path / "d" / "h", "w") as z:
        z.writestr("x/", "")
        z.writestr("x/y", '["n","7"]\n{}\n')
    with zipfile.ZipFile(tmp_path / "d" / "i", "w"):
        pass
    put("j.csv", b"kind;value\nn;8\n")
    path = f"file:{tmp_path}/d/j.csv"
    rows = S.read_dumps(spark, str(tmp_path / "d"), {path: "CSV"}).collect()
    got = sorted((r["path"].rsplit("/", 1)[1], r["kind"], r["raw"] or "", r["error"] or "") for r in rows)
    assert got == [
        ("a", "json", "", "not_a_record"), ("a", "json", "1", ""), ("a", "json", "2", ""), ("b", "csv", "", "ragged_row"), ("b", "csv", "3,4", ""), ("c", "tsv", "5", ""),
        ("d.gz", "csv", "6", ""), ("e.gz", "text", "", "broken_archive"), ("f", "binary", "", "unsupported_format"),
        ("g.txt", "text", "", "unsupported_format"), ("h", "ndjson", "", "missing_member"), ("h", "ndjson", "7", ""), ("i", "text", "", "empty_archive"), ("j.csv", "csv", "", "ragged_row"),
    ]
    assert {r["raw"] for r in S.read_kv_gzip(spark, str(tmp_path / "d" / "sub")).collect()} == {"6"}


def test_broken_archives_are_records(spark):
    files = spark.createDataFrame([(b"PK no archive",), (b"PK\x05\x06" + bytes(18),), (None,)], "content binary")
    for kind in ("ndjson", "csv"):
        assert sorted(r["error"] for r in S.read_kv_zip_content(files, kind).collect()) == ["broken_archive", "broken_archive", "empty_archive"]


def test_profile_keeps_rows_apart(spark):
    files = spark.createDataFrame([("p", b"a,b\n1"), ("p", b"\x80" * 40)], "path string, content binary")
    got = sorted((r["kind"], r["bytes"], r["preview"]) for r in S.profile_dumps(files).collect())
    assert got == [("binary", 40, "80" * 32), ("csv", 5, "a,b\n1")]


def test_profile_of_long_dumps(spark):
    """Lines beyond 64 KB are shown as they are, a kind is that of the whole dump, and all bytes of a binary one are shown where asked for."""
    line = "é" * 10 + "a" * 70_000
    dumps = {"text": f"{line}\n{line}\n".encode(), "json": b'{"a":1}\n' * 10_000 + b"no record", "binary": b"a" * 70_000 + b"\x80" * 70_000, "csv": ("ab" * 40_000 + ",c\n" * 9).encode()}
    files = spark.createDataFrame(list(dumps.items()), "path string, content binary")
    got = {r["path"]: r for r in S.profile_dumps(files, preview_bytes=None).collect()}
    assert {p: (r["kind"], r["bytes"]) for p, r in got.items()} == {p: (p, len(c)) for p, c in dumps.items()}
    assert got["binary"]["preview"] == dumps["binary"].hex()
    assert all(got[p]["preview"] == "\n".join(dumps[p].decode().split("\n")[:8]) for p in ("text", "json", "csv"))
