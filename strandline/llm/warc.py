"""WARC archives of pages: written with an index of every record, read back by coalesced byte ranges of the records asked for.

Each record is a gzip member of its own. The index (path, offset, length, url, digest and more) is written with the archives and is
what reading begins with: selected records are sorted by place, neighbours become one range, and a range is one seek and one read.
Of equal payloads one is kept as a response; the others are revisit records that refer to it.
"""

from __future__ import annotations

import hashlib
import time
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.llm.batches import small_batches
from strandline.llm.hot import spread_join
from strandline.llm.store import new_folder, written

#: Payloads of so many bytes are stored once.
LEAST = 1000
#: Bytes at which a new archive begins, bytes between two records that are read over, and bytes of a range at most (or one record).
ROLL, GAP, RANGE = 256 << 20, 64 << 10, 8 << 20
# Header texts of the format.
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "path string, offset bigint, length bigint, url string, digest string, record_type string, page_id bigint, refers_to bigint"
RECORDS = "page_id bigint, url string, record_type string, refers_to bigint, date string, size bigint, digest string, payload binary"


def target(url: str | None, page_id: int | None) -> str:
    """The address as it may stand in a header line: anything but visible ASCII is percent-encoded. None without an address."""
    return urllib.parse.quote(url, safe="!#$%&'()*+,/:;=?@[]~|{}^`\"<>\\") if url else f"urn:page:{'' if page_id is None else page_id}"


def record(identity: str, page_id: int | None, url: str | None, size: int, digest: str, date: str, payload: bytes | None, refers: tuple[str, int | None] | None = None) -> bytes:
    """A response with its payload, or a revisit of the record ``refers`` (identity, page_id), whose block is the HTTP head alone."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (payload or b"")
    head = {"WARC-Type": "revisit" if refers else "response", "WARC-Record-ID": f"<urn:uuid:{identity}>", "WARC-Date": date, "WARC-Target-URI": target(url, page_id), "WARC-Payload-Digest": f"sha1:{digest}"}
    if refers:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:uuid:{refers[0]}>"}
        if refers[1] is not None:
            head["Refers-To-Page-ID"] = refers[1]
    if page_id is not None:
        head["Page-ID"] = page_id
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": len(block)}
    return "".join([f"{VERSION}\r\n", *[f"{k}: {v}\r\n" for k, v in head.items()], "\r\n"]).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    size = int(fields["Content-Length"])
    if first != VERSION or rest[size:] != b"\r\n\r\n":
        raise ValueError("not a whole record")
    return fields, rest[:size]


def described(pages: DataFrame) -> DataFrame:
    """page_id, url, html (null: empty), size in UTF-8 bytes, SHA-1, and a key that equal payloads of LEAST bytes share."""
    out = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    out = out.withColumns({"size": F.octet_length("html").cast("bigint"), "digest": F.sha1(F.col("html").cast("binary"))})
    # Small payloads join nothing; numbers keep a frequent one from being one key.
    alone = F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string"))
    return out.withColumn("key", F.when(F.col("size") >= LEAST, F.sha2(F.col("html").cast("binary"), 256)).otherwise(alone))


def decided(pages: DataFrame) -> DataFrame:
    """described() with record_type and refers_to; the html of a revisit is null. Payloads are compared by length, SHA-1 and SHA-256.

    The largest page_id of equal payloads is the response (a null one is the smallest). Of several such rows it is one with the
    smallest url, and the others revisit it.
    """
    rows = described(pages)
    same = rows.where(F.col("size") >= LEAST).groupBy("key", "page_id").agg(F.count("*").alias("c"), F.min("url").alias("url"))
    groups = same.groupBy("key").agg(F.max(F.struct("page_id", "c", "url")).alias("kept"), F.sum("c").alias("n")).where("n > 1")
    groups = written(groups, "warc-groups")
    first = F.col("page_id").eqNullSafe(F.col("kept.page_id"))

    def typed(df: DataFrame, response: Column) -> DataFrame:
        return df.select(
            "page_id", "url", F.when(response, F.col("html")).alias("html"), "size", "digest", "key",
            F.when(response, "response").otherwise("revisit").alias("record_type"), F.when(~response, F.col("kept.page_id")).alias("refers_to"),
        )

    joined = spread_join(rows, groups, ["key"], "n", pages.count(), "left")
    tied = first & (F.col("kept.c") > 1)
    out = typed(joined.where(~F.coalesce(tied, F.lit(False))), F.col("kept").isNull() | first)
    if groups.where("kept.c > 1").isEmpty():
        return out
    # Equal rows are counted, not told apart.
    repeated = rows.join(groups.where("kept.c > 1"), "key").where(first)
    counted = repeated.groupBy("key", "page_id", "url").agg(*[F.first(c).alias(c) for c in ("html", "size", "digest", "kept")], F.count("*").alias("copies"))
    each = counted.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.unionByName(typed(each, (F.col("k") == 1) & F.col("url").eqNullSafe(F.col("kept.url"))))


def _writer(folder: str, date: str, roll: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pyarrow.fs.FileSystem.from_uri(folder)
        # Each attempt has files of its own, and the index names those of the attempt that counted.
        name, number, out, at = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", 0, None, 0
        for batch in batches:
            index = []
            for page_id, url, html, size, digest, key, kind, refers_to in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if out is not None and at >= roll:
                    out.close()
                    out = None
                if out is None:
                    files.create_dir(root, recursive=True)
                    path, at, number = f"{name}-{number:04d}.warc.gz", 0, number + 1
                    out = files.open_output_stream(f"{root}/{path}", compression=None)
                shared = str(uuid.UUID(hex=key[:32], version=4)) if size >= LEAST else None
                revisit = kind == "revisit"
                own = str(uuid.uuid5(uuid.NAMESPACE_URL, f"{path}#{at}")) if revisit or not shared else shared
                data = record(own, page_id, url, size, digest, date, None if revisit else html.encode(), (shared, refers_to) if revisit else None)
                packed = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = packed.compress(data) + packed.flush()
                out.write(member)
                index.append((f"{folder}/{path}", at, len(member), url, digest, kind, page_id, refers_to))
                at += len(member)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], _names(INDEX)) if index else _none(INDEX)
        if out is not None:
            out.close()

    return run


def _names(schema: str) -> list[str]:
    return [c.split(" ")[0] for c in schema.split(", ")]


def _none(schema: str) -> pa.RecordBatch:
    types = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([], types[c.split(" ")[1]]) for c in schema.split(", ")], _names(schema))


def archive(pages: DataFrame, date: str | None = None, roll: int = ROLL) -> DataFrame:
    """Writes all pages as WARC files to a new folder of the shared one and returns the index, a row a record.

    date: of the records, ISO 8601 in UTC; now, if None. An archive is closed once it has ``roll`` bytes.
    """
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    rows = decided(pages).select("page_id", "url", "html", "size", "digest", "key", "record_type", "refers_to")
    with small_batches(spark):
        return written(rows.mapInArrow(_writer(folder, date or time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), roll), INDEX), "warc-index")


def ranges(index: DataFrame, gap: int = GAP, most: int = RANGE) -> DataFrame:
    """path, start, stop and records (offset, length) of what is read at once: selected records of an archive, at most ``gap`` bytes apart.

    A range has about ``most`` bytes, or one longer record; archives have a bounded size, so the sort of one is bounded too.
    """
    w = W.partitionBy("path").orderBy("offset")
    before, cell = F.lag(F.col("offset") + F.col("length")).over(w), F.floor(F.col("offset") / F.lit(most))
    begins = before.isNull() | (F.col("offset") - before > gap) | (cell != F.lag(cell).over(w))
    runs = index.select("path", "offset", "length").distinct().withColumn("begins", begins.cast("int"))
    runs = runs.withColumn("run", F.sum("begins").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy("path", "run").agg(
        F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("stop"), F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("records")
    ).drop("run")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start, stop, records in zip(*[batch.column(c).to_pylist() for c in ("path", "start", "stop", "records")], strict=True):
            files, name = pyarrow.fs.FileSystem.from_uri(path)
            with files.open_input_file(name) as f:
                f.seek(start)
                data = f.read(stop - start)
            rows = []
            for r in records:
                fields, block = parse(zlib.decompress(data[r["offset"] - start : r["offset"] - start + r["length"]], 31))
                http, _, payload = block.partition(b"\r\n\r\n")
                size = int(http.decode().rpartition("Content-Length: ")[2])
                number = {k: int(fields[k]) if k in fields else None for k in ("Page-ID", "Refers-To-Page-ID")}
                kind = fields["WARC-Type"]
                rows.append((number["Page-ID"], fields["WARC-Target-URI"], kind, number["Refers-To-Page-ID"], fields["WARC-Date"], size, fields["WARC-Payload-Digest"].removeprefix("sha1:"), payload if kind == "response" else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()), strict=True)], _names(RECORDS))


def read(index: DataFrame, gap: int = GAP, most: int = RANGE) -> DataFrame:
    """The records of the index's rows, from the archives: page_id, url, type, refers_to, date, size and SHA-1 as declared, and payload (null in a revisit).

    Take a part of the index to read a part of the records; no other bytes are read but gaps of up to ``gap`` bytes.
    """
    # Rows of ranges are small and what they name is not, so their number of tasks does not follow from their size.
    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ranges(index, gap, most).repartition(tasks, "path", "start").mapInArrow(_read, RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, written to archives and read back from them.

    A null html is an empty payload. Rows of one page_id are records of their own; a null page_id is the smallest. A null or empty
    url becomes urn:page:page_id, and control characters, blanks and letters beyond ASCII are percent-encoded in the header line.
    Further columns are left out, and an empty table gives an empty result.
    """
    found = read(archive(pages.select("page_id", "url", "html")))
    digest = F.coalesce(F.sha1("payload"), F.col("digest"))
    return found.select("page_id", F.coalesce(F.octet_length("payload").cast("bigint"), F.col("size")).alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")


#: round_trip over pages as SQL.
SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
r AS (
  SELECT page_id, html, octet_length(encode(html)) AS n, row_number() OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST) AS k, max(page_id) OVER (PARTITION BY html) AS top
  FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN n >= {LEAST} AND k > 1 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= {LEAST} AND k > 1 THEN top END AS refers_to
FROM r
"""
