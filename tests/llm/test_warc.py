import base64
import hashlib
import os

import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from staylens.llm import warc
from staylens.llm.common import shared_dir

PAGES = [(i, f"http://h/{i}", h) for i, h in enumerate(["<p>a</p>", "<p>a</p>", None, "", "é" * 5000, "<p>a</p>", "WARC/1.0\r\nx\r\n\r\nWARC/1.0", "\x1f\x8b\x08 odd"])]
PAGES += [(7, "http://h/7", "\x1f\x8b\x08 odd"), (None, None, "<p>a</p>"), (None, "u\r\nv", "alone")]


def _sum(h):
    return base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()


def _brute(least):
    first = {}
    for i, _, h in PAGES:
        if i is not None:
            first[h or ""] = max(i, first.get(h or "", i))
    out = []
    for i, _, h in PAGES:
        f = first.get(h or "")
        back = i is not None and i < f and len((h or "").encode()) >= least
        out.append((i, len((h or "").encode()), _sum(h), "revisit" if back else "response", f if back else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 1])
def test_round_trip_equals_brute_force(spark, least):
    pages = spark.createDataFrame([(*p, 1) for p in PAGES], "page_id long, url string, html string, payload_bytes int")
    rows = warc.round_trip(pages, least).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=str) == _brute(least)
    assert warc.round_trip(pages.limit(0)).count() == 0


@pytest.mark.parametrize("zipped", [True, False])
def test_salvage_goes_on_after_damage(zipped):
    records = [warc.record(i, f"http://h/{i}", "response", warc.digest(p), len(p), p) for i in range(6) for p in [b"page %d " % i * 50]]
    parts = [warc._zip(r) if zipped else r for r in records]
    parts[1] = parts[1][: len(parts[1]) // 2]
    parts[3] = parts[3][:40] + b"\0\0\0" + parts[3][43:]
    data = b"".join(parts[:5]) + parts[5][:-9]
    found = list(warc.salvage(data))
    assert [f[3]["warc-record-id"] for f in found if f[0] == "record"] == ["<urn:page:0>", "<urn:page:2>", "<urn:page:4>"]
    cover = sorted((f[1], f[2]) for f in found)
    assert cover[0][0] == 0 and cover[-1][1] == len(data)
    assert all(a[1] == b[0] for a, b in zip(cover, cover[1:], strict=False))
    assert sum(f[0] == "gap" for f in found) == 3


def test_gaps_are_told_by_file(spark):
    folder = shared_dir(spark)
    pages = spark.createDataFrame([(i, "u", "text %d" % i) for i in range(20)], "page_id long, url string, html string").coalesce(1)
    (path,) = [r.path for r in warc.write_archives(pages, folder).collect() if r.n_records == 20] or [None]
    if path is None:
        paths = [r.path for r in warc.write_archives(pages.repartition(1), folder).collect()]
        path = max(paths, key=os.path.getsize)
    data = bytearray(open(path, "rb").read())
    data[data.find(b"\x1f\x8b\x08", len(data) // 2) + 64] ^= 255  # in what the member's checksum covers, not in its header
    fs, base = pafs.FileSystem.from_uri(folder)
    with fs.open_output_stream(f"{base}/broken.warc.gz", compression=None) as f:
        f.write(bytes(data))
    files = warc.list_files(spark, folder).filter(F.col("path").endswith("broken.warc.gz"))
    rows = warc.read_archives(folder, files).collect()
    assert sum(r.gap is not None for r in rows) == 1
    assert all(r.gap is not None or bytes(r.payload).startswith(b"text") for r in rows)


def _records(n, size=50):
    return [warc.record(i, f"http://h/{i}", "response", warc.digest(p), len(p), p) for i in range(n) for p in [b"page %d " % i * size]]


def _names(found):
    return [f[3]["warc-record-id"][10:-1] for f in found if f[0] == "record"]


def test_a_member_of_many_records_is_read_inside():
    records = _records(5)
    records[2] = records[2][:-20] + b"\0" + records[2][-19:]
    found = list(warc.salvage(warc._zip(b"".join(records))))
    assert _names(found) == ["0", "1", "3", "4"]
    (gap,) = [f for f in found if f[0] == "gap"]
    assert f"unpacked bytes {len(records[0] + records[1])} to {len(b''.join(records[:3]))}" in gap[3]


def test_of_a_member_cut_off_what_unpacks_is_kept():
    records, noise = _records(40), b"".join(hash_ for i in range(40) for hash_ in [hashlib.sha512(b"%d" % i).digest()])
    body = b"".join(r + b"" for r in records[:20]) + warc.record(99, "u", "response", warc.digest(noise), len(noise), noise) + b"".join(records[20:])
    packed = warc._zip(body)
    for data in (packed[: len(packed) // 2], packed[: len(packed) // 2] + b"\0" * 40 + packed[len(packed) // 2 + 40 :]):
        found = list(warc.salvage(data + warc._zip(records[0]) + records[1]))
        names = _names(found)
        assert names[:10] == [str(i) for i in range(10)] and names[-2:] == ["0", "1"]
        assert [f[1] for f in found if f[0] == "gap"] == [0]


def test_long_members_are_read_piece_by_piece():
    records = _records(60, 500)
    packed = warc._zip(b"".join(records))
    to, wrong, rows, inside = warc._member(packed, 0, most_held=1000)
    assert (to, wrong) == (len(packed), "") and [h["warc-record-id"][10:-1] for h, _ in rows] == [str(i) for i in range(60)] and not inside.gaps


def test_a_plain_file_with_a_damaged_start_and_gzip_in_a_payload():
    records = [warc.record(i, "u", "response", warc.digest(p), len(p), p) for i, p in enumerate([b"a", warc._zip(b"no record") + b"x", b"c", b"d"])]
    data = b"\0\0\0" + records[0][3:] + b"".join(records[1:3]) + warc._zip(records[3])
    found = list(warc.salvage(data))
    assert _names(found) == ["1", "2", "3"]
    assert [(f[1], f[2]) for f in found if f[0] == "gap"] == [(0, len(records[0]))]


def test_long_headers_are_read_and_a_gap_fails_the_query(spark, tmp_path, monkeypatch):
    from staylens.llm import queries

    rows = [(1, "http://h/" + "é " * 60_000, "<p>a</p>"), (2, "u", "<p>b</p>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert {r.page_id for r in queries.op6_warc(spark, str(tmp_path)).collect()} == {1, 2}
    kinds = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, gap string, file string, start long, `end` long, url string"
    lost = spark.createDataFrame([(None, None, None, None, None, "member is cut off", "f", 0, 9, None)], kinds)
    monkeypatch.setattr(queries.warc, "round_trip", lambda pages: lost)
    with pytest.raises(Exception, match="lost bytes in f 0 member is cut off"):
        queries.op6_warc(spark, str(tmp_path)).collect()


def test_many_copied_payloads_are_joined_in_parts(spark):
    rows = [(i, "u", f"text {i % 7}" if i % 3 else None) for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    told = []
    for most in (1000, 0):
        folder = shared_dir(spark)
        files = spark.createDataFrame(warc.write_archives(pages, folder, most_sent=most).collect())
        told.append(sorted((r.record_name, r.record_type, r.refers_to or "") for r in warc.read_archives(folder, files).collect()))
    assert told[0] == told[1] and sum(x[1] == "response" for x in told[0]) == 8
