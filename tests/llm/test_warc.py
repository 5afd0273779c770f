"""WARC archives: exact round trips, revisits against brute force, and salvage."""

import base64
import gzip
import hashlib
import os
import random
import re

import pyarrow.parquet as pq
import pytest

from docweave.functions.session import shared_folder
from docweave.llm import queries, warc


def b32(x):
    return base64.b32encode(hashlib.sha1(x).digest()).decode()


def brute(rows, least=0):
    """(page_id, bytes, digest, type, refers_to) of each row (page_id, url, html)."""
    top = {}
    for page, url, html in rows:
        data = (html or "").encode()
        key = (page is not None, page or 0)
        if len(data) >= least and (data not in top or key > top[data]):
            top[data] = key
    left = set(top)
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        key = (page is not None, page or 0)
        if len(data) < least:
            out.append((page, len(data), b32(data), "response", None))
        elif key == top[data] and data in left:
            left.discard(data)
            out.append((page, len(data), b32(data), "response", None))
        else:
            out.append((page, len(data), b32(data), "revisit", top[data][1] if top[data][0] else None))
    return sorted(out, key=repr)


def written(spark, rows, name, **how):
    folder = f"{shared_folder(spark)}/{name}"
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, payload string, refers string").repartition(3)
    warc.write_archives(frame, folder, **how)
    return folder


def read(spark, folder, **how):
    return warc.read_archives(spark, folder, **how)


def told(spark, folder):
    found = read(spark, folder).where("gap is null")
    rows = found.select(warc.page_of(found.record_id), "payload_bytes", "payload_digest", "record_type", warc.page_of(found.refers_to)).collect()
    return sorted((tuple(r) for r in rows), key=repr)


LONG = "é<p>" * 300_000
ROWS = [(1, "http://a/", "same"), (2, "http://b/", "same"), (3, None, "same"), (4, "x\r\nWARC-Type: fake\r\n\r\n", ""), (5, "", None), (6, "u", None), (7, "u", LONG), (8, "v", LONG), (9, "w", "WARC/1.1\r\nWARC-Type: response\r\n\r\n"), (10, "z", "zz"), (10, "z", "zz"), (10, "z", "zz"), (10, "y", "zz"), (None, "n", "alone"), (None, "n", "alone"), (None, "n", "same"), (-3, "m", "minus"), (0, "m", "zero")]


def test_revisits(spark):
    folder = written(spark, ROWS, "revisits")
    assert told(spark, folder) == brute(ROWS)
    assert told(spark, written(spark, ROWS, "least", least=5)) == brute(ROWS, 5)
    left = {f for f in os.listdir(folder.removeprefix("file://"))}
    assert left and all(f.endswith(".warc.gz") for f in left)
    payloads = {r.record_id: bytes(r.payload) for r in read(spark, folder, payloads=True).where("record_type = 'response'").collect()}
    assert sorted(payloads.values()) == sorted({(h or "").encode() for _, _, h in ROWS})


def test_many_archives_and_copies(spark, monkeypatch):
    monkeypatch.setattr(warc, "COPIES", 7)
    rows = [(i, f"u{i}", "t" * (i % 50)) for i in range(400)] + [(1000, "hot", "h")] * 60
    folder = written(spark, rows, "many", archive_bytes=2000)
    assert len(os.listdir(folder.removeprefix("file://"))) > 20
    assert told(spark, folder) == brute(rows)


def test_no_rows(spark):
    folder = written(spark, [], "no-pages")
    os.makedirs(folder.removeprefix("file://"), exist_ok=True)
    assert told(spark, folder) == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["page_id"], r["url"], r["html"]) for r in pq.read_table(f"{sf}/pages.parquet").to_pylist()]
    assert sorted((tuple(r) for r in queries.op11_warc(spark, sf).collect()), key=repr) == brute(rows)


# salvage


def plain(n, body=None):
    return warc.record("response", f"<urn:page:{n}:k>", [("Content-Type", "application/http; msgtype=response")], warc.http_head(3) + (body or f"b{n:02d}".encode()))


def seen(data):
    """Numbers of the records read, and (offset, length) of the gaps."""
    found = list(warc.walk(data))
    for a, b in zip(found, found[1:], strict=False):
        assert b.offset in (a.offset, a.offset + a.length)
    assert (found[0].offset, found[-1].offset + found[-1].length) == (0, len(data)) if found else not data
    number = lambda x: (re.findall(r"page:(\d+):", x.fields["warc-record-id"]) or ["-1"])[0]
    return [int(number(x)) for x in found if not x.gap], [(x.offset, x.length) for x in found if x.gap]


@pytest.mark.parametrize("packed", [True, False])
def test_whole(packed):
    parts = [gzip.compress(plain(i)) if packed else plain(i) for i in range(5)]
    assert seen(b"".join(parts)) == ([0, 1, 2, 3, 4], [])
    assert seen(b"") == ([], [])
    assert [x.gap for x in warc.walk(b"".join([parts[0], gzip.compress(b""), parts[1]]))] == [None, None]


def test_every_flipped_byte_of_a_member():
    parts = [gzip.compress(plain(i)) for i in range(3)]
    at = len(parts[0])
    for i in range(len(parts[1])):
        data = bytearray(b"".join(parts))
        data[at + i] ^= 0x55
        ids, gaps = seen(bytes(data))
        # time, flags and the system byte of a gzip header carry no check of their own
        assert ids in ([0, 2], [0, 1, 2]) and gaps in ([(at, len(parts[1]))], []) and (len(ids) == 3) == (not gaps)


def test_every_flipped_byte_of_a_record():
    parts = [plain(i) for i in range(3)]
    at = len(parts[0])
    for i in range(len(parts[1])):
        data = bytearray(b"".join(parts))
        data[at + i] ^= 0x01
        ids, gaps = seen(bytes(data))
        assert ids[0] == 0 and ids[-1] == 2 and sum(n for _, n in gaps) in (0, len(parts[1]))


def test_cuts_garbage_and_lengths():
    parts = [gzip.compress(plain(i)) for i in range(4)]
    junk = random.Random(5).randbytes(3000) + warc.MAGIC + b"junk" + b"WARC/1.1\r\nno header"
    assert seen(parts[0] + junk + parts[1]) == ([0, 1], [(len(parts[0]), len(junk))])
    cut = parts[1][: len(parts[1]) // 2]
    assert seen(parts[0] + cut + parts[2]) == ([0, 2], [(len(parts[0]), len(cut))])
    assert seen(parts[0] + cut) == ([0], [(len(parts[0]), len(cut))])
    assert seen(junk) == ([], [(0, len(junk))])
    wrong = plain(1).replace(b"Content-Length: ", b"Content-Length: 9", 2)
    assert seen(plain(0) + wrong + plain(2)) == ([0, 2], [(len(plain(0)), len(wrong))])
    assert seen(parts[0] + plain(1) + parts[2]) == ([0, 1, 2], [])
    # several records in a member, the middle one broken: the member is kept, its gap told
    found = list(warc.walk(gzip.compress(plain(0) + wrong + plain(2))))
    assert [x.gap is None for x in found] == [True, False, True] and "bytes from" in found[1].gap
    # a version line within a payload begins no record while the record around it is whole
    assert seen(plain(0, plain(7)) + plain(1)) == ([0, 1], [])


def test_salvage_through_spark(spark):
    folder = written(spark, [(i, f"u{i}", f"page {i}") for i in range(60)], "broken")
    path = folder.removeprefix("file://")
    name = sorted(f for f in os.listdir(path))[0]
    with open(f"{path}/{name}", "rb") as f:
        data = bytearray(f.read())
    before = [x for x in warc.walk(bytes(data))]
    hurt = before[2]
    data[hurt.offset + 40 : hurt.offset + 60] = b"\0" * 20
    with open(f"{path}/{name}", "wb") as f:
        f.write(data)
    with open(f"{path}/zz-empty.warc.gz", "wb"):
        pass
    rows = read(spark, folder).collect()
    assert len([r for r in rows if r.gap is None]) == 59
    assert [(r.offset, r.length, r.gap, r.record_id) for r in rows if r.gap] == [(hurt.offset, hurt.length, "member", None)]


def test_a_task_that_runs_twice_writes_once(spark, tmp_path):
    """Only the files in the messages that Spark hands over are published."""
    writer = warc.ArchiveWriter(f"file://{tmp_path}", 1, 1)
    os.makedirs(tmp_path / writer.staging)
    for name in ("won", "lost"):
        (tmp_path / writer.staging / name).write_text(name)
    message = warc.Moves([(f"{writer.staging}/won", "a/part.txt")])
    writer.commit([message, None])
    writer.commit([message, None])
    assert [str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file()] == ["a/part.txt"]
