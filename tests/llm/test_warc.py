"""WARC archives: well-formed to a plain reader, whole after a round trip, and read by ranges of the records asked for."""

import gzip
import hashlib
import zlib
from collections import Counter

import pyarrow.fs
import pytest
from pyspark.sql import functions as F

from compare import same
from strandline.llm import warc
from strandline.llm.queries import LLM_SQL, op13_warc

PAGES = "page_id bigint, url string, html string"
LONG = "<p>é long page</p>\r\n\r\n" * 60


def plain(pages):
    """Rows of the contract."""
    groups = {}
    for p, _, h in pages:
        groups.setdefault(h or "", []).append(p)
    out = []
    for h, ids in groups.items():
        data = h.encode()
        ids = sorted(ids, key=lambda p: (p is not None, p or 0), reverse=True)
        for k, p in enumerate(ids):
            revisit = k > 0 and len(data) >= 1000
            out.append((p, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", ids[0] if revisit else None))
    return Counter(out)


CASES = {
    "copies": [(i, f"http://a/{i}", LONG) for i in range(5)] + [(9, "u", "x" * 999), (10, "u", "x" * 999), (11, "u", "x" * 1000), (12, "u", "x" * 1000)],
    "odd": [(1, None, None), (2, "", ""), (None, "http://a b\r\nX: y/é", LONG), (None, None, LONG), (4, "u", "\r\n\r\n"), (5, "u", LONG + "!" * 300_000), (6, "u", "WARC/1.1\r\n\r\n" * 100)],
    "repeated": [(7, "b", LONG), (7, "b", LONG), (7, "a", LONG), (7, None, LONG), (3, "c", LONG), (8, "z", "s"), (8, "z", "s")],
    "only nulls": [(None, None, LONG), (None, None, LONG)],
    "empty": [],
}


@pytest.mark.parametrize("case", CASES)
def test_round_trip(spark, case):
    df = spark.createDataFrame([(*p, "x", 1) for p in CASES[case]], PAGES + ", payload string, size bigint")  # further columns, clashing names
    got = warc.round_trip(df)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert Counter(map(tuple, got.collect())) == plain(CASES[case])


def test_archives_are_plain_warc(spark):
    """A reader that knows no index finds the same records one after another, with payloads, digests and references that hold."""
    pages = CASES["copies"] + CASES["odd"] + CASES["repeated"]
    index = warc.archive(spark.createDataFrame(pages, PAGES), "2024-01-02T03:04:05Z", roll=2000).collect()
    paths = {r.path for r in index}
    assert len(paths) > 3 and len(index) == len(pages)
    seen, kept, refers = 0, {}, []
    for path in paths:
        files, name = pyarrow.fs.FileSystem.from_uri(path)
        raw = files.open_input_file(name).read()
        mine = sorted((r for r in index if r.path == path), key=lambda r: r.offset)
        assert [r.offset for r in mine] == [0, *[r.offset + r.length for r in mine[:-1]]] and mine[-1].offset + mine[-1].length == len(raw)
        whole = b"".join(zlib.decompress(raw[r.offset : r.offset + r.length], 31) for r in mine)
        assert whole == gzip.decompress(raw)
        while whole:
            head, _, rest = whole.partition(b"\r\n\r\n")
            lines = head.decode("ascii").split("\r\n")
            fields = dict(x.split(": ", 1) for x in lines[1:])
            n = int(fields["Content-Length"])
            block, whole = rest[:n], rest[n:]
            assert lines[0] == "WARC/1.1" and whole.startswith(b"\r\n\r\n") and fields["WARC-Date"] == "2024-01-02T03:04:05Z" and fields["WARC-Target-URI"].isprintable()
            whole = whole[4:]
            http, _, payload = block.partition(b"\r\n\r\n")
            digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
            if fields["WARC-Type"] == "response":
                assert hashlib.sha1(payload).hexdigest() == digest and f"Content-Length: {len(payload)}".encode() in http
                assert fields["WARC-Record-ID"] not in kept
                kept[fields["WARC-Record-ID"]] = digest
            else:
                assert not payload
                refers.append((fields["WARC-Refers-To"], digest))
            seen += 1
    assert seen == len(pages) and refers and all(kept[x] == d for x, d in refers)


def test_reads_of_selected_records(spark):
    pages = [(i, f"http://h/{i}", f"page {i} " * 50) for i in range(200)]
    index = warc.archive(spark.createDataFrame(pages, PAGES).coalesce(1))
    chosen = index.where("page_id % 50 < 3")
    found = {r.page_id: r.payload.decode() for r in warc.read(chosen, gap=0).collect()}
    assert found == {i: h for i, _, h in pages if i % 50 < 3}
    got = warc.ranges(chosen, gap=0).collect()
    order = [r.page_id for r in index.orderBy("path", "offset").collect()]
    runs = sum(1 for a, b in zip([None, *order], order, strict=False) if b % 50 < 3 and not (a is not None and a % 50 < 3))
    assert len(got) == runs + index.select("path").distinct().count() - 1
    assert sum(r.stop - r.start for r in got) == chosen.agg(F.sum("length")).first()[0]
    assert warc.ranges(index, gap=0, most=1000).count() > 5 and warc.ranges(index.where("false")).count() == 0
    assert warc.read(index.union(index)).count() == 200


def test_query_against_sql(spark, sf):
    same(op13_warc(spark, sf), LLM_SQL["op13_warc"], sf)
