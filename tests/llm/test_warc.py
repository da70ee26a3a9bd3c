"""WARC: round trip against brute force, salvage of damaged files, edge rows."""

import base64
import gzip
import hashlib
import io
import random

from martspark.llm.warc import (
    Salvager,
    archived,
    encode_record,
    read_gaps,
    read_warc,
    write_warc,
)


def brute_force(pages, min_bytes=0):
    out = []
    for page_id, _, html in pages:
        payload = (html or "").encode()
        same = [i for i, _, h in pages if (h or "").encode() == payload and i is not None]
        leader = max(same, default=None)
        revisit = len(payload) >= min_bytes and leader is not None and page_id != leader
        out.append((page_id, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(),
                    "revisit" if revisit else "response", leader if revisit else None))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


EDGE = [(1, "u", "<p>a"), (2, "u\r\nX: y", "<p>a"), (3, None, None), (4, "%0D", ""), (None, "n", ""), (5, "u", "é" * 400_000),
        (9, "u", "WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n"), (2, "again", "<p>a"), (None, "m", "only"), (None, "m", "only")]


def test_edge_rows_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*p, 1, "x") for p in EDGE],
                                  "page_id long, url string, html string, leader long, payload string")
    assert result(archived(pages)) == brute_force(EDGE)
    path = str(tmp_path / "w")
    manifest = write_warc(pages, path, min_bytes=5)
    records = read_warc(spark, path + "/archives", manifest)
    assert result(records) == brute_force(EDGE, 5)
    assert {(r.url, bytes(r.payload).decode()) for r in records.filter("record_type = 'response'").collect()} <= {
        (u, h or "") for _, u, h in EDGE}
    assert read_gaps(spark, path + "/archives", manifest).count() == 0


def test_pages_and_empty_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    assert result(archived(pages)) == brute_force(rows)
    assert archived(pages.limit(0)).count() == 0


def scan(data):
    records, gaps = [], []
    for what, start, n, *rest in Salvager(io.BytesIO(bytes(data))):
        if what == "record":
            records.append((start, n, rest[1]))
        else:
            gaps.append((start, n))
    return records, gaps


def test_salvage_recovers_every_whole_record():
    rng = random.Random(2)
    payloads = [bytes(rng.choices(b"abc <>\r\n", k=rng.randint(0, 3000))) for _ in range(40)]
    members = [encode_record(k, "u", p, None, False) for k, p in enumerate(payloads)]
    members = [gzip.decompress(m) if k % 5 == 4 else m for k, m in enumerate(members)]  # some not compressed
    starts = [sum(map(len, members[:k])) for k in range(len(members) + 1)]
    clean = b"".join(members)
    assert scan(clean) == ([(s, len(m), p) for s, m, p in zip(starts, members, payloads)], [])
    for trial in range(60):
        data = bytearray(clean)
        at = rng.randrange(len(data))
        hit = next(k for k in range(len(members)) if starts[k] <= at < starts[k + 1])
        data[at] ^= 1 << rng.randrange(8)
        records, gaps = scan(data)
        others = [(s, len(m), p) for k, (s, m, p) in enumerate(zip(starts, members, payloads)) if k != hit]
        assert [r for r in records if r[0] != starts[hit]] == others, trial  # a flip in an unchecked header may pass
        assert gaps in ([], [(starts[hit], len(members[hit]))])
    cut = clean[:starts[7]] + b"junk \x1f\x8b\x08 more WARC/1.0 junk" + clean[starts[9]:starts[12] + 30]
    records, gaps = scan(cut)
    assert [p for _, _, p in records] == payloads[:7] + payloads[9:12] and len(gaps) == 2
    assert scan(b"") == ([], []) and scan(b"nothing here") == ([], [(0, 12)])


def test_long_urls_and_many_tasks(spark, tmp_path):
    """A header of any length comes back, and archives are read by tasks of their own."""
    pages = spark.createDataFrame([(k, f"u{k}" + "x%" * 40_000 * (k % 7 == 0), f"<p>{k}") for k in range(60)],
                                  "page_id long, url string, html string").repartition(6)
    path = str(tmp_path / "w")
    manifest = write_warc(pages, path)
    assert manifest.count() == 6
    records = read_warc(spark, path + "/archives", manifest, whole=True)
    assert {r.url for r in records.collect()} == {r.url for r in pages.collect()}
    from pyspark.sql import functions as F
    assert records.select(F.spark_partition_id().alias("p")).distinct().count() >= 4


def test_a_lost_record_fails_a_whole_read(spark, tmp_path):
    import pytest

    pages = spark.createDataFrame([(k, "u", f"<p>{k}") for k in range(20)], "page_id long, url string, html string").coalesce(1)
    path = str(tmp_path / "w")
    manifest = write_warc(pages, path)
    name = f"{path}/archives/{manifest.first().file}"
    data = bytearray(open(name, "rb").read())
    data[-6] ^= 255  # in the checksum of the last member
    open(name, "wb").write(data)
    assert read_warc(spark, path + "/archives", manifest).count() == 19
    assert read_gaps(spark, path + "/archives", manifest).count() == 1
    with pytest.raises(Exception, match="19 of 20 records"):
        read_warc(spark, path + "/archives", manifest, whole=True).count()
