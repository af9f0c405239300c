import json

from penduline.operators import shred


def _rows(spark, bodies):
    return spark.createDataFrame([(k, b, "x") for k, b in enumerate(bodies)], "record_id bigint, body string, tag string")


CASE = {
    "case_id": "c", "physical_parameters": {"r": {"value": "0.1", "unit": "m", "readings": [None, {"value": 1.0}]}, "n": None, "bare": 2.5},
    "input_views": [{"view": "i2v", "crops": [{"box": [1, 2, 3, 4]}, None, {"box": []}]}, None, {"view": "t2v"}],
    "assets": {"first_frame": "f.png", "reference_video": {"path": "v.mp4", "renditions": [{"height": 240}]}, "mask": None},
    "provenance": {"generator": {"steps": [None, {"op": "paint", "inputs": [{"frame": 1}, None, {"frame": 2}]}, {"op": "cut"}]}},
}
PATHS = {
    ("quantity", "r"), ("reading", "r/1"), ("quantity", "bare"), ("view", "i2v"), ("crop", "i2v/0"), ("crop", "i2v/2"), ("view", "t2v"), ("asset", "first_frame"),
    ("asset", "reference_video"), ("rendition", "reference_video/0"), ("step", "1"), ("step", "2"), ("step_input", "1/0"), ("step_input", "1/2"),
}


def test_wrappings_and_paths(spark):
    text = json.dumps(CASE)
    wrapped = [text, json.dumps(text), json.dumps(json.dumps(text)), json.dumps([CASE]), json.dumps({"sent_by": "x", "record": CASE}), "﻿" + text, json.dumps({"record": text}), "  " + text + "\n"]
    bad = [None, "", "  ", text[:-1], "{}", "[]", "null", "3", '"x"', '{"case_id": NaN}', "[" * 100_000, json.dumps({"other": {"a": 1}})]
    got = shred.found(_rows(spark, wrapped + bad)).collect()
    for k in range(len(wrapped)):
        assert {(r.child_table, r.item_path) for r in got if r.record_id == k} == PATHS, k
    assert not [r for r in got if r.record_id >= len(wrapped)]


def test_children_point_to_parents_and_round_trip(spark, tmp_path):
    rows = _rows(spark, [json.dumps(CASE), json.dumps(CASE)])
    shred.write_tables(rows, str(tmp_path / "t"))
    tables = {tag: {(r.record_id, r.item_path) for r in shred.read_table(spark, str(tmp_path / "t"), tag).collect()} for tag in shred.SCHEMAS}
    for tag in shred.SCHEMAS:
        for r in shred.read_table(spark, str(tmp_path / "t"), tag).collect():
            assert r.parent_tag is None or (r.record_id, r.parent_path) in tables[r.parent_tag]
    quantity = {r.item_path: (r.value, r.unit) for r in shred.read_table(spark, str(tmp_path / "t"), "quantity").where("record_id = 0").collect()}
    assert quantity == {"r": ("0.1", "m"), "bare": ("2.5", None)}


def test_unexpected_shapes(spark):
    odd = {"case_id": None, "physical_parameters": "x", "input_views": [3, {"crops": "no"}], "assets": [{"role": "a", "renditions": [1]}], "provenance": [1]}
    got = {(r.child_table, r.item_path) for r in shred.found(_rows(spark, [json.dumps(odd)])).collect()}
    assert got == {("view", "0"), ("view", "1"), ("asset", "a"), ("rendition", "a/0")}
    assert shred.found(_rows(spark, [])).count() == 0
