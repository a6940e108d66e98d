import hashlib
import io
import random
import zipfile
import zlib

import pytest

from millrace.llm.wacz import ZipReader, ZipWriter, open_fs, read_package, read_packages, round_trip, write_packages


def reader(data):
    return ZipReader(len(data), lambda at, n: data[at : at + n])


@pytest.mark.parametrize("wide", [False, True])
def test_members_agree_with_the_standard_library(wide):
    rng = random.Random(4)
    parts = {f"dir/é{i}": rng.randbytes(rng.choice([0, 1, 100, 70_000])) for i in range(9)}
    out = io.BytesIO()
    z = ZipWriter(out, zip64=wide)
    for name, data in parts.items():
        z.begin(name)
        z.write(data[: len(data) // 2])
        z.write(data[len(data) // 2 :])
        z.end()
    z.close()
    data = out.getvalue()
    with zipfile.ZipFile(io.BytesIO(data)) as std:
        assert {n: std.read(n) for n in std.namelist()} == parts
        assert std.testzip() is None
    ours = reader(data)
    assert {n: ours.whole(n) for n in ours.members} == parts
    assert ours.range("dir/é3", 0, 0) == b""


def test_foreign_archives():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.comment = b"PK\x05\x06 in a comment"
        with z.open("big", "w", force_zip64=True) as f:
            f.write(b"x" * 5000)
        z.mkdir("folder")
    ours = reader(out.getvalue())
    assert ours.whole("big") == b"x" * 5000 and list(ours.members) == ["big"]
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", "b" * 100)
    with pytest.raises(ValueError, match="compressed"):
        reader(packed.getvalue())
    for broken in (b"", b"no zip", out.getvalue()[:-30]):
        with pytest.raises(ValueError):
            reader(broken)


def brute(rows):
    first = {}
    for number, _, html in rows:
        data = (html or "").encode()
        first[data] = max(first.get(data, number), number)
    out = []
    for number, _, html in rows:
        data = (html or "").encode()
        revisit = len(data) >= 1000 and first[data] != number
        out.append((number, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", first[data] if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    rng = random.Random(9)
    texts = ["", None, "small", "é" * 500, "é" * 499 + "x", "\r\n\r\n" + "y" * 2000, "z" * 300_000, "WARC/1.1\r\n\r\n" * 200]
    rows = [(i, rng.choice(["http://a/ b\r\n", None, "https://é.example/"]), rng.choice(texts)) for i in range(300)] + [(300, "u", "once" * 400), (301, "u", "z" * 300_000), (301, "u", "z" * 300_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows] + [(None, "u", "small", "x"), (None, "u", "once" * 400, "x")], "page_id long, url string, html string, digest string").repartition(7)
    nameless = [(None, len(t), hashlib.sha1(t.encode()).hexdigest(), kind, to) for t, kind, to in (("small", "response", None), ("once" * 400, "revisit", 300))]
    got = round_trip(df).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(brute(rows) + nameless, key=str)


def test_payloads_and_small_packages(spark, tmp_path):
    df = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i}</p>" * 50) for i in range(200)], "page_id long, url string, html string").coalesce(2)
    packages = write_packages(df, f"file://{tmp_path}/out", most=2000)
    assert packages.count() > 5 and packages.agg({"records": "sum"}).first()[0] == 200
    got = {r.page_id: (r.url, bytes(r.payload).decode()) for r in read_packages(packages).collect()}
    assert got == {i: (f"http://h/{i}", f"<p>{i}</p>" * 50) for i in range(200)}
    uri = packages.first().package
    path = open_fs(uri)[1]
    assert [n for n, _, _ in read_package(uri, run=1)] == [n for n, _, _ in read_package(uri)]
    data = bytearray(open(path, "rb").read())
    data[200] ^= 0xFF
    open(path, "wb").write(data)
    with pytest.raises((ValueError, zlib.error)):
        list(read_package(uri))


def test_empty_table(spark):
    assert round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
