"""WARC archives: round trip, determinism, rolling, commit, odd rows."""

import glob
import gzip
import hashlib
import io
import os
import random

import numpy as np
import pytest

from potentia.llm import warc

COLS = "page_id long, url string, html string, record_type string, file int, place string, mark int"


def odd(seed=1):
    rng = random.Random(seed)
    big = ["é" * 600, "<html>" + "x y " * 400, "z" * 999, "z" * 1000, "long " * 200_000]
    rows = [(i, f"http://h/{i}\r\nX: 1 é" if i % 7 == 0 else f"http://h/{i}", rng.choice([*big, "", "tiny", None, f"own {i} " * 200]))
            for i in range(200)]
    rows += rows[:30]  # repeated rows
    rows += [(None, None, big[0]), (None, None, "alone " * 300), (None, "u", None), (None, "u", "alone " * 300)]
    rows += [(5, "again", big[0]), (-3, None, big[1])]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, "p", 0) for r in rows], COLS)


def expected(rows):
    top = {}
    for page, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 1000 and page is not None:
            top[data] = max(top.get(data, page), page)
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        to = top.get(data)
        again = to is not None and to != page
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", to if again else None))
    return sorted(out, key=repr)


def read(spark, folder, **kw):
    return warc.read_archives(spark, folder, **kw).collect()


def triples(rows):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=repr)


def files(archives):
    return {(r["name"], r["sha256"], r["records"]) for r in archives.manifest.collect()}


def test_round_trip_of_odd_rows(spark, tmp_path):
    rows = odd()
    a = warc.write_archives(frame(spark, rows), str(tmp_path / "a"))
    got = read(spark, a.folder, with_payload=True)
    assert triples(got) == expected(rows)
    texts = sorted(hashlib.sha1(r.payload).hexdigest() for r in got if r.record_type == "response")
    assert texts == sorted(x[2] for x in expected(rows) if x[3] == "response")
    ids = [r.record_id for r in got]
    assert len(set(ids)) == len(ids)
    responses = {r.page_id for r in got if r.record_type == "response"}
    assert {r.refers_to for r in got if r.refers_to is not None} <= responses
    assert not any("\n" in r.target_uri or " " in r.target_uri for r in got)


def test_same_files_for_any_partitioning(spark, tmp_path):
    df = frame(spark, odd())
    kw = dict(shard_bytes=200_000, roll_bytes=2_000)
    a = warc.write_archives(df.coalesce(1), str(tmp_path / "a"), **kw)
    b = warc.write_archives(df.repartition(11), str(tmp_path / "b"), **kw)
    assert files(a) == files(b)
    names = [n for n, _, _ in files(a)]
    assert len({n.split("-")[1] for n in names}) > 3 and any(not n.endswith("-00000.warc.gz") for n in names)
    assert triples(read(spark, b.folder)) == expected(odd())
    for r in a.manifest.collect():  # rolled at the first record past the size
        size = os.path.getsize(f"{a.folder}/{r['name']}")
        assert size == r["bytes"]
    assert not os.path.exists(f"{a.folder}/_temporary")


def test_files_are_plain_gzip(spark, tmp_path):
    a = warc.write_archives(frame(spark, odd()[:40]), str(tmp_path / "a"), shard_bytes=1 << 30)
    (path,) = glob.glob(f"{a.folder}/*.warc.gz")
    whole = gzip.decompress(open(path, "rb").read())
    assert whole.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and whole.count(b"\r\n\r\nWARC/1.1\r\n") == 40


def test_only_the_manifest_counts(spark, tmp_path):
    a = warc.write_archives(frame(spark, odd()[:40]), str(tmp_path / "a"))
    (path,) = glob.glob(f"{a.folder}/*.warc.gz")
    data = open(path, "rb").read()
    with open(f"{a.folder}/pages-00099-00000.warc.gz", "wb") as f:  # another attempt's file
        f.write(data)
    assert len(read(spark, a.folder)) == 40
    with open(path, "wb") as f:
        f.write(data[:-10])
    with pytest.raises(Exception, match="manifest lists"):
        read(spark, a.folder)


def test_damage_is_found():
    member = warc.page_record(1, 0, "http://a", b"x" * 50, None, "2020-01-01T00:00:00Z")
    ((_, plain),) = warc.members(io.BytesIO(member))
    fields, block = warc.parse(plain)
    assert fields["WARC-Type"] == "response" and bytes(block).endswith(b"x" * 50)
    with pytest.raises(ValueError, match="damaged"):
        warc.parse(plain.replace(b"xxxx", b"xyxx"))
    with pytest.raises(ValueError, match="ends early"):
        list(warc.members(io.BytesIO(member[:-9])))
    two = list(warc.members(io.BytesIO(member + member), chunk=7))
    assert [o for o, _ in two] == [0, len(member)] and two[0][1] == plain


def test_no_rows(spark, tmp_path):
    a = warc.write_archives(frame(spark, []), str(tmp_path / "a"))
    assert read(spark, a.folder) == []


def test_bounds_share_the_bytes(spark):
    rng = np.random.default_rng(0)
    rows = [(int(p), int(b)) for p, b in zip(rng.permutation(20_000) * 7, rng.integers(1, 2000, 20_000))]
    df = spark.createDataFrame(rows, "place long, bytes long")
    bounds, share = warc.shard_bounds(df, 1_000_000, 1 << 16)
    place, size = np.array(rows).T
    held = np.bincount(np.searchsorted(bounds, place, "right"), weights=size)
    assert share == 1_000_000 and held.max() < 1.6 * share and len(held) < 2 * size.sum() / share
    assert len(warc.shard_bounds(df, 1, 4)[0]) <= 8
