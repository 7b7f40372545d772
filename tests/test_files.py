"""Listing, names, manifests and sinks on a real folder."""

import csv
import hashlib
import json
import re

import pytest
from pyspark.sql import functions as F

from strandline.operators.rollup import report_lines
from strandline.plans import bindings, queries
from strandline.plans.audit import audit_dataset
from strandline.sources import files, layout, sinks
from strandline.sources.stage import written
from strandline.sources.variables import missing_variables


@pytest.fixture()
def root(tmp_path):
    for i, name in enumerate(("DB/s2/S2_E1_A1.mat", "DB/s1/s1_e2_a1.mat", "DB/s10/S10_E1_A1.mat", "other/S1_E1_A1.mat")):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x" * (i + 1))
    (tmp_path / "DB/s1/S1_E3_A1.MAT").write_bytes(b"skipped: the listing minds case")
    (tmp_path / "a.zip").write_bytes(b"archive")
    return str(tmp_path)


def test_discover(spark, root):
    rows = files.discover(spark, root).collect()
    assert [(r.subject, r.exercise, r.acquisition, r.file_bytes) for r in rows] == [(1, 1, 1, 4), (1, 2, 1, 2), (2, 1, 1, 1), (10, 1, 1, 3)]
    assert rows[0].relative_path == "other/S1_E1_A1.mat"
    assert files.discover(spark, root, (2,)).count() == 1 and files.discover(spark, root, ()).count() == 0
    assert [r.relative_path for r in files.extracted_manifest(spark, root).collect()][-1] == "DB/s10/S10_E1_A1.mat"


def test_names(spark):
    names = ["S1_E2_A3.mat", "d/s10_e1_a1.MAT", "S1_E2_A3.mat\n", "S1_E2.mat", "xS1_E2_A3.mat", "S99999999999_E1_A1.mat"]
    df = spark.createDataFrame([(n,) for n in names], "path string")
    got = {r.path: (r.subject, r.exercise, r.acquisition) for r in files.parse_identity(df, strict=False).collect()}
    assert got[names[0]] == (1, 2, 3) and got[names[1]] == (10, 1, 1)
    assert files.rejected_names(df).count() == 4
    with pytest.raises(Exception, match="not a recording name"):
        files.parse_identity(df).collect()
    assert files.discovered(df.limit(2)).count() == 2


def test_manifests(spark, root, tmp_path):
    row = files.archive_manifest(spark, root).first()
    assert (row.bytes, row.sha256, row.subject, row.status) == (7, hashlib.sha256(b"archive").hexdigest(), None, "zip_test_fail")
    m = tmp_path / "manifests"
    m.mkdir()
    (m / "2.tsv").write_text("s2\tu\t5\tab\tok\n")
    (m / "1.tsv").write_text("s1\tu\t6\tcd\tok\n")
    assert [(r.subject, r.bytes) for r in files.read_manifests(spark, str(m)).collect()] == [("s1", 6), ("s2", 5)]
    df = spark.createDataFrame([("a", 3), ("a", 4), ("b", 5)], "subject string, bytes bigint")
    assert {(r.subject, r.complete) for r in files.completeness(df, 2).collect()} == {("a", True), ("b", False)}
    assert files.collection_totals(df, 2, 3).first().complete and files.collection_totals(df.limit(0), 2, 3).first().total_bytes == 0


def test_archive_structure(spark, tmp_path):
    """Made-up archives, sound and damaged: subject, url, bytes, digest and status of each."""
    import io
    import zipfile

    def made(count, comment=b"", kind=zipfile.ZIP_DEFLATED):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", kind) as z:
            for i in range(count):
                z.writestr(f"DB2_s1/S1_E{i}_A1.mat", f"data {i} " * 50)
            z.comment = comment
        return out.getvalue()

    whole = made(3)
    end = whole.rindex(b"PK\x05\x06")
    cases = {
        "DB2_s1": (whole, True), "DB2_s02": (made(1, b"a comment PK\x05\x06 in it"), True), "DB2_s3": (made(0), True), "DB2_s40": (made(300, b"x" * 60_000, zipfile.ZIP_STORED), True),
        "DB2_s5": (whole[:-1], False), "DB2_s6": (whole[: len(whole) // 2], False), "DB2_s7": (whole + b"x", False), "DB2_s8": (b"P", False), "DB2_s9": (b"PK\x05\x06" + bytes(18), True),
        "DB2_s10": (whole[:end] + whole[end : end + 10] + b"\x04\x00" + whole[end + 12 :], False), "DB2_s11": (whole[50:], False), "DB2_s12": (b"XX" + whole[2:], False),
    }
    for name, (data, _) in cases.items():
        (tmp_path / f"{name}.zip").write_bytes(data)
    rows = {r.url.removeprefix("http://x/"): r for r in files.archive_manifest(spark, str(tmp_path), base_url="http://x/").collect()}
    assert set(rows) == {f"{n}.zip" for n in cases}
    for name, (data, sound) in cases.items():
        row = rows[f"{name}.zip"]
        assert (row.status == "zip_test_pass") == sound, name
        assert row.bytes == len(data) and row.sha256 == hashlib.sha256(data).hexdigest() and int(row.subject) == int(name[5:]) and len(row.subject) == 2
    assert files.archive_manifest(spark, str(tmp_path)).drop("path").columns == ["subject", "url", "bytes", "sha256", "status"]


def test_missing_variables(spark):
    recordings = spark.createDataFrame([("a",), ("b",), ("c",)], "recording_id string")
    have = [("a", v) for v in ("emg", "stimulus", "restimulus", "repetition", "rerepetition", "subject", "exercise")] + [("b", "exercise"), ("b", "emg"), ("b", "odd")]
    got = {r.recording_id: r.missing for r in missing_variables(recordings, spark.createDataFrame(have, "recording_id string, variable string")).collect()}
    assert got == {"b": "subject, stimulus, restimulus, repetition, rerepetition", "c": "subject, exercise, emg, stimulus, restimulus, repetition, rerepetition"}


def test_sinks(spark, sf, tmp_path):
    summary = queries._audit(spark, sf, "dataset_summary").persist()
    sinks.write_summary(summary, str(tmp_path / "summary"), "/data")
    text = "".join(p.read_text() for p in (tmp_path / "summary").glob("*.json"))
    keys = list(json.loads(text))
    # The keys of the summary.
    assert keys == sorted(
        "audit_status generated_utc data_root label_source sampling_rate_hz expected_channels max_tail_mismatch_samples max_tail_mismatch_milliseconds subjects_requested subject_count "
        "expected_file_count observed_file_count successfully_loaded_file_count trial_segment_count channel_record_count total_emg_samples total_recording_hours generator_window_count "
        "classifier_window_count nonfinite_emg_values constant_channels potential_saturation_channels stimulus_restimulus_disagreement_samples repetition_rerepetition_disagreement_samples "
        "aligned_file_count emg_tail_samples_removed label_tail_samples_removed error_count warning_count generator_window classifier_window".split()
    )
    assert json.loads(text)["generator_window"] == {"length_samples": 4, "step_samples": 2}
    sinks.write_report(report_lines(sinks.stamped(summary, "/data")), str(tmp_path / "report"))
    lines = "".join(p.read_text() for p in (tmp_path / "report").glob("*.txt")).splitlines()
    assert lines[:3] == ["DATA AUDIT", "==========", "Status: FAIL"] and len(lines) == 33
    assert lines[3].startswith("Generated (UTC): 20") and lines[3].endswith("+00:00") and lines[4:7] == ["Source directory: /data", "Primary labels: refined", "Terminal alignment limit: 2 samples (1.000 ms)"]
    assert [x for x in lines if not x or x.isupper()] == ["DATA AUDIT", "", "DATA ACCOUNTING", "", "WINDOW ACCOUNTING", "", "QUALITY SCREEN", ""]
    sinks.write_table(queries.trial_inventory(spark, sf), str(tmp_path / "t"), "csv", None)
    back = spark.read.option("header", True).csv(str(tmp_path / "t"))
    assert back.columns[:3] == ["subject", "exercise", "file"] and back.count() > 0
    sinks.write_table(queries.trial_inventory(spark, sf), str(tmp_path / "p"), partition_by="subject")
    assert spark.read.parquet(str(tmp_path / "p")).count() == back.count()


def test_written_audit(spark, sf, tmp_path):
    """Totals observed while tables are written are those of the lazy summary, and files read by name are in order."""
    e = bindings.events(spark, sf)
    expected = bindings.event_pairs(spark, sf)
    results = audit_dataset(e.raw, e.recordings, expected, e.params, e.catalogue, e.scalars, keep=written)
    want = results["dataset_summary"].first().asDict(recursive=True)
    del results["dataset_summary"]  # is not asked for again
    summary = sinks.write_audit(results, expected, e.recordings, e.params, str(tmp_path), "/data", "csv")
    assert summary.first().asDict(recursive=True) == want
    assert (tmp_path / "audit_summary").is_dir() and (tmp_path / "report").is_dir()

    def rows(name):
        out = []
        for p in sorted((tmp_path / name).glob("part-*.csv")):
            with open(p, newline="") as f:
                out += list(csv.DictReader(f))
        return out

    people = [int(r["subject"]) for r in rows("participant_summary")]
    assert people == sorted(people) and len(people) == want["subject_count"]
    found = rows("issues")
    kind = {"missing_file": 0, "duplicate_file": 1}
    keys = [(kind.get(r["category"], 2), int(r["subject"]), int(r["exercise"]), r["file"]) for r in found]
    assert keys == sorted(keys) and len({k[0] for k in keys}) == 3 and len(found) == want["error_count"] + want["warning_count"]
    files_ = [(int(r["subject"]), int(r["exercise"]), int(r["acquisition"]), r["relative_path"]) for r in rows("file_inventory")]
    assert files_ == sorted(files_) and len(files_) == want["successfully_loaded_file_count"]


def test_ordered_sink_uses_many_files(spark, tmp_path):
    """Several files, each a range, in the order of their names; ties and NULLs included."""
    df = spark.range(20_000).select((F.col("id") * 7919 % 5000).alias("a"), F.when(F.col("id") % 10 > 0, F.col("id")).alias("b"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_table(df, str(tmp_path / "t"), "csv", order=["a", "b"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted((tmp_path / "t").glob("part-*.csv"))
    got = [(int(r["a"]), int(r["b"] or -1)) for p in parts for r in csv.DictReader(p.read_text().splitlines())]
    assert len(parts) == 8 and got == sorted(got) and len(got) == 20_000


def test_stored_layout_needs_no_shuffle_of_samples(spark, sf):
    """Over a table bucketed by recording, no exchange of the audit moves samples or values, whatever the result."""
    e = bindings.events(spark, sf)
    spark.sql("DROP TABLE IF EXISTS stored_samples")
    stored = layout.store_samples(e.raw, "stored_samples", 8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        results = audit_dataset(stored, e.recordings.persist(), bindings.event_pairs(spark, sf), e.params, e.catalogue, e.scalars)
        seen = 0
        for name, df in results.items():
            plan = df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
            scans = [b for b in plan.split("\n\n") if re.match(r"\(\d+\) Scan", b.strip()) and "stored_samples" in b]
            assert scans and all("Bucketed: true" in b for b in scans), name
            for block in plan.split("\n\n"):
                if re.match(r"\(\d+\) Exchange", block.strip()):
                    seen += 1
                    moved = re.search(r"Input \[\d+\]: \[(.*)\]", block).group(1)
                    assert not re.search(r"\b(sample_index|emg|x|prev|start_sample|part_start)#", moved) or "segment_index" in moved, (name, block)
        assert seen
        assert results["issues"].count() == audit_dataset(e.raw, e.recordings, bindings.event_pairs(spark, sf), e.params, e.catalogue, e.scalars, results=("issues",))["issues"].count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS stored_samples")


def test_plans_have_no_python_and_prune(spark, sf):
    e = bindings.events(spark, sf)
    whole = audit_dataset(e.raw, e.recordings, bindings.event_pairs(spark, sf), e.params, e.catalogue, e.scalars)  # lazy: nothing is written
    lazy = {name: (lambda spark, sf, df=df: df) for name, df in whole.items()}  # these stand for the queries of their names
    for name, query in ({n: q for n, q in queries.QUERIES.items() if n != "audit_report_lines"} | lazy).items():  # the report is made of dataset_summary
        plan = query(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan
    e = bindings.events(spark, sf)
    plan = queries.trial_inventory(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "event_id" in plan and e.samples is not None
