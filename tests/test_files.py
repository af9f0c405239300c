import json

import pytest
from penduline.plans import config
from penduline.sources import recordings, sinks


def test_files_are_copied_once(spark, tmp_path):
    for name, content in (("a", b"x" * 3_000_000), ("b", b"b"), ("c", b"c")):
        (tmp_path / name).write_bytes(content)
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "b").write_bytes(b"b")
    (tmp_path / "out" / "c").write_bytes(b"other")
    pairs = spark.createDataFrame([(str(tmp_path / n), str(tmp_path / "out" / n)) for n in ("a", "b", "c", "d")] + [(None, "x")], "source string, target string")
    got = {(r.source or "none").rsplit("/", 1)[-1]: r for r in sinks.copy_files(pairs).collect()}
    assert {k: r.state for k, r in got.items()} == {"a": "copied", "b": "there_already", "c": "target_differs", "d": "source_missing", "none": "source_missing"}
    assert got["a"].size_bytes == 3_000_000 and got["a"].sha256 == sinks.file_sha256(tmp_path / "out" / "a") and (tmp_path / "out" / "c").read_bytes() == b"other"
    assert {r.state for r in sinks.copy_files(pairs.where("source LIKE '%a'")).collect()} == {"there_already"}
    assert sinks.copy_files(pairs.where("false")).count() == 0


def test_candidates(spark, tmp_path):
    rows = spark.createDataFrame([("b", 2, None), ("a", 1, 0.5)], "case_id string, frame int, confidence double")
    sinks.write_candidates(rows, str(tmp_path / "c"))
    assert [r.case_id for r in spark.read.option("header", True).csv(str(tmp_path / "c" / "csv")).orderBy("case_id").collect()] == ["a", "b"]
    assert {json.loads(r[0])["frame"] for r in spark.read.text(str(tmp_path / "c" / "json")).collect()} == {1, 2}


def test_probes_by_a_reader(spark, tmp_path):
    for name, text in (("good", "25 126 640 480"), ("zero", "0 5 1 1"), ("bad", "?"), ("none", "")):
        (tmp_path / name).write_text(text)

    def reader(content):
        if not content:
            return None
        fps, n, w, h = content.decode().split()
        return float(fps), int(n), int(w), int(h)

    got = {r.path.rsplit("/", 1)[-1]: (r.code, r.frame_count, r.last_frame_time) for r in recordings.probe(spark, str(tmp_path), reader).collect()}
    assert got == {"good": (None, 126, 5.0), "zero": ("invalid_video_metadata", 5, None), "bad": ("video_open_failed", None, None)}
    assert {r.code for r in recordings.probe(spark, str(tmp_path)).collect()} == {"video_open_failed"}

    def decoder(content):
        if content == b"?":
            raise ValueError("no recording")
        return (bytes([k]) for k in range(130 if content else 0))

    pictures = recordings.frames(spark, str(tmp_path), decoder).collect()
    of = lambda name: [r for r in pictures if r.path.endswith("/" + name)]
    assert [bytes(r.content) for r in sorted(of("good"), key=lambda r: r.frame)] == [bytes([k]) for k in range(130)]
    assert of("none") == [] and [(r.frame, r.content) for r in of("bad")] == [(-1, None)]


def test_bundles_and_profiles(tmp_path):
    bundle = {"schema_version": "2.0", "baseline_id": "b", "plugin": "p", "capabilities": {}, "components": {"task_builder": {}, "trainer": {}, "predictor": {}}}
    sinks.write_document(tmp_path / "b.json", bundle)
    assert config.load_bundle(tmp_path / "b.json")["folder"] == str(tmp_path)
    sinks.write_document(tmp_path / "bad.json", {**bundle, "schema_version": "1.0", "components": {"trainer": {}, "predictor": {}, "data_adapter": {}}})
    with pytest.raises(ValueError, match="no component task_builder; data_adapter is no component of its own; schema_version"):
        config.load_bundle(tmp_path / "bad.json")
    profile = {"schema_version": "1.0", "profile_id": "x", "scenes": {"s": {"base_prompt": "A", "parameter_clauses": [{"name": "l", "template": "{value} m", "precision": 2}]}}}
    sinks.write_document(tmp_path / "p" / "x.json", profile)
    assert list(config.load_profiles(tmp_path / "p")) == ["x"]
    sinks.write_document(tmp_path / "p" / "y.json", profile)
    with pytest.raises(ValueError, match="x is there already"):
        config.load_profiles(tmp_path / "p")
    clauses = [{"name": "l", "template": "none"}, {"name": "l", "precision": -1}]
    assert config.clause_faults({"profile_id": "", "scenes": {"s": {"base_prompt": " ", "parameter_clauses": clauses}}}) == [
        "no profile_id", "s: no base_prompt", "s: clauses without a name of their own", "s/l: no place for the value", "s/l: no precision"]
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError, match="no prompt profiles"):
        config.load_profiles(tmp_path / "none")
