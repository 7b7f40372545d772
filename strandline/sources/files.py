"""Listing, identity and manifests of recording files. File content never enters a listing's plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline import schemas
from strandline.functions.expr import base_name, relative_to

# Fixed value: the file name format.
NAME = r"(?i)^S(\d+)_E(\d+)_A(\d+)\.mat\z"
# The end of an archive's name, the status of an archive, and the marks of the ZIP format as hexadecimal digits.
ARCHIVE = r"(?i)(?:^|_)s(\d+)\.zip\z"
PASSED, FAILED = "zip_test_pass", "zip_test_fail"
END, ENTRY, LOCAL = "504B0506", "504B0102", "504B0304"


def parse_identity(files: DataFrame, path: str = "path", strict: bool = True) -> DataFrame:
    """Adds file, subject, exercise, acquisition. Strict: a name that does not match fails the job; else it has NULLs."""
    name = base_name(F.col(path))

    def group(i: int) -> Column:
        return F.regexp_extract(name, NAME, i).try_cast("int")

    out = files.withColumns({"file": name, "subject": group(1), "exercise": group(2), "acquisition": group(3)})
    if not strict:
        return out
    bad = F.raise_error(F.concat(F.lit("not a recording name: "), F.coalesce(F.col(path), F.lit("null")))).cast("int")
    return out.withColumn("subject", F.when(F.col("acquisition").isNull() | F.col("subject").isNull() | F.col("exercise").isNull(), bad).otherwise(F.col("subject")))


def rejected_names(files: DataFrame, path: str = "path") -> DataFrame:
    return parse_identity(files, path, strict=False).where("subject is null or exercise is null or acquisition is null")


def select_subjects(files: DataFrame, subjects: tuple[int, ...] | None) -> DataFrame:
    """None keeps all; an empty selection keeps nothing."""
    return files if subjects is None else files.where(F.col("subject").isin(list(subjects)) if subjects else F.lit(False))


def list_files(spark: SparkSession, root: str) -> DataFrame:
    read = spark.read.format("binaryFile").option("pathGlobFilter", "*.mat").option("recursiveFileLookup", "true").load(root)
    return read.select("path", F.col("length").alias("file_bytes"))


def discover(spark: SparkSession, root: str, subjects: tuple[int, ...] | None = None) -> DataFrame:
    """Recording files under a root with identity, in (subject, exercise, acquisition, path) order."""
    return discovered(list_files(spark, root), subjects).withColumn("relative_path", relative_to(F.regexp_replace("path", "^file:/+", "/"), root))


def discovered(files: DataFrame, subjects: tuple[int, ...] | None = None) -> DataFrame:
    """The same for any DataFrame with a path column."""
    return select_subjects(parse_identity(files), subjects).orderBy("subject", "exercise", "acquisition", "path")


def _number(content: Column, at: Column, size: int) -> Column:
    """The unsigned little-endian number of some bytes at a position from 0."""
    digits = F.hex(F.substring(content, (at + 1).cast("int"), F.lit(size)))
    return F.conv(F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))]), 16, 10).cast("bigint")


def _mark(content: Column, at: Column) -> Column:
    return F.hex(F.substring(content, (at + 1).cast("int"), F.lit(4)))


def archive_checked(archives: DataFrame) -> DataFrame:
    """Adds status to rows with content: PASSED for a ZIP archive of sound structure, else FAILED.

    The end record must close the file, the directory must lie right before it and hold as many entries as it says, and each entry
    must have a local header, and its data, before the directory. Nothing is unpacked, so a changed byte inside a file's data is not
    seen. Archives with 64-bit records are not read and fail.
    """
    content, size, end, start = F.col("content"), F.octet_length("content").cast("bigint"), F.col("_end"), F.col("_start")

    def ends(at: Column) -> Column:
        return (_mark(content, at) == END) & (_number(content, at + 20, 2) == size - at - 22)

    # Without a comment, which is the rule, the record is the last 22 bytes; a comment has 65,535 bytes at most.
    places = F.filter(F.sequence(F.greatest(size - 22 - 65535, F.lit(0)), size - 22), ends)
    last = F.when(size < 22, F.lit(None)).when(ends(size - 22), size - 22).otherwise(F.try_element_at(places, F.lit(-1)))
    # One step a projection: an expression that many others use is computed once.
    found = archives.withColumn("_end", last).withColumns({"_entries": _number(content, end + 10, 2), "_length": _number(content, end + 12, 4), "_start": _number(content, end + 16, 4)})

    def walk(at: Column, _: Column) -> Column:
        local = _number(content, at + 42, 4)
        sound = (at >= 0) & (_mark(content, at) == ENTRY) & (_mark(content, local) == LOCAL) & (local + 30 + _number(content, at + 20, 4) <= start)
        return F.when(sound, at + 46 + _number(content, at + 28, 2) + _number(content, at + 30, 2) + _number(content, at + 32, 2)).otherwise(F.lit(-1).cast("bigint"))

    steps = F.when(F.col("_entries") > 0, F.sequence(F.lit(1).cast("bigint"), F.col("_entries"))).otherwise(F.array().cast("array<bigint>"))
    sound = (start + F.col("_length") == end) & (F.aggregate(steps, start, walk) == end)
    return found.withColumn("status", F.when(F.coalesce(sound, F.lit(False)), PASSED).otherwise(FAILED)).drop("_end", "_entries", "_length", "_start")


def archive_manifest(spark: SparkSession, root: str, glob: str = "*.zip", base_url: str = "") -> DataFrame:
    """subject, url, bytes, sha256 and status of each archive, and its path; content is dropped as soon as it is hashed and checked.

    subject: the digits before the name's end, two at least, as in ``..._s01.zip``; NULL where there are none.
    """
    read = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(root)
    digits = F.regexp_extract(base_name(F.col("path")), ARCHIVE, 1)
    subject = F.when(digits != "", F.lpad(digits, F.greatest(F.length(digits), F.lit(2)), F.lit("0")))
    return archive_checked(read.select("path", "length", "content")).select(
        subject.alias("subject"), F.concat(F.lit(base_url), base_name(F.col("path"))).alias("url"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), "status", "path"
    )


def read_manifests(spark: SparkSession, directory: str) -> DataFrame:
    return spark.read.option("sep", "\t").schema(schemas.MANIFEST).csv(directory).orderBy("subject")


def extracted_manifest(spark: SparkSession, root: str) -> DataFrame:
    return discover(spark, root).select("relative_path", "file_bytes")


def content_manifest(table: DataFrame, subject: str, content: str) -> DataFrame:
    """subject, bytes and SHA-256 of each row's content, for content that is already in a table."""
    return table.select(
        F.col(subject).alias("subject"),
        F.octet_length(content).cast("bigint").alias("bytes"),
        F.sha2(F.col(content).cast("binary"), 256).alias("sha256"),
    )


def completeness(files: DataFrame, expected_files: int) -> DataFrame:
    """Files per subject against the number expected."""
    counts = files.groupBy("subject").agg(F.count("*").alias("file_count"), F.sum("bytes").alias("total_bytes"))
    return counts.withColumn("complete", F.col("file_count") == expected_files)


def collection_totals(files: DataFrame, expected_subjects: int, expected_files: int) -> DataFrame:
    """One row: subjects, files, bytes, and whether both counts are as expected."""
    per = files.groupBy("subject").agg(F.count("*").alias("n"), F.sum("bytes").alias("b"))
    out = per.agg(F.count("*").alias("subject_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("file_count"), F.coalesce(F.sum("b"), F.lit(0)).alias("total_bytes"))
    return out.withColumn("complete", (F.col("subject_count") == expected_subjects) & (F.col("file_count") == expected_files))
