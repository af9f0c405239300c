import json
import zipfile

import pytest
from penduline.functions import media, text
from penduline.operators import etl, lineage, splits
from penduline.plans import config, runs
from penduline.sources import archives, documents, sinks
from penduline.streaming import rescoring
from pyspark.sql import functions as F


def _cases(spark, n):
    return spark.createDataFrame([("s" if k % 3 else "t", f"c{k:03d}") for k in range(n)], "scene_id string, case_id string")


@pytest.mark.parametrize("make", [splits.view_b_hashed, splits.view_b_shuffled])
def test_groups_are_complete_and_balanced(spark, make):
    cases = _cases(spark, 50)
    rows = make(cases, 4, 42).collect()
    assert sorted((r.scene_id, r.case_id) for r in rows) == sorted((r.scene_id, r.case_id) for r in cases.collect())
    for s in ("s", "t"):
        sizes = [sum(r.scene_id == s and r.grp == f"group_{g}" for r in rows) for g in range(1, 5)]
        assert max(sizes) - min(sizes) <= 1
    assert {tuple(r) for r in make(cases.repartition(7), 4, 42).collect()} == {tuple(r) for r in rows}
    with pytest.raises(ValueError, match="at least 1"):
        make(cases, 0, 1)


def test_shards_and_oversampling(spark):
    cases = _cases(spark, 50)
    ids = sorted(r.case_id for r in cases.collect())
    got = {r.case_id: r.shard for r in splits.strided(cases, "case_id", 7).collect()}
    assert got == {i: k % 7 for k, i in enumerate(ids)}
    rows = splits.oversample(cases, "scene_id", "case_id").collect()
    per = {s: sorted(r.case_id for r in cases.collect() if r.scene_id == s) for s in ("s", "t")}
    largest = max(map(len, per.values()))
    assert sorted((r.scene_id, r.slot, r.case_id) for r in rows) == sorted((s, k, ids[k % len(ids)]) for s, ids in per.items() for k in range(largest))


def test_tasks_and_runs(spark, tmp_path):
    with pytest.raises(ValueError, match="exactly one training seed"):
        config.Task("t", "finetune_eval", "generic", (42,))
    members = spark.createDataFrame([("a", "s", "train"), ("b", "s", "test_id"), ("c", "s", "test_ood1"), ("d", "u", "test_id"), ("e", "h", "train")], "case_id string, scene_id string, grp string")
    tasks = [config.Task("t", "finetune_eval", c, (42, 42, 7), (1,), ("s", "u"), held_out_scenes=("h",)) for c in config.CONDITIONINGS]
    plans = [runs.plan(t, members) for t in tasks]
    assert plans[0].count() == 2 * 4 and tasks[0].fingerprint() != tasks[1].fingerprint()
    runs.check_matrix(tasks, plans)
    with pytest.raises(ValueError, match="must agree"):
        runs.check_matrix(tasks, [plans[0], plans[1].limit(3)])
    jobs = plans[0]
    cases = members.select("case_id", "scene_id")
    predictions = jobs.where("case_id <> 'd'").select("job_id", F.lit(True).alias("complete"), F.lit(0.5).alias("score")).unionByName(spark.createDataFrame([("stray", True, 1.0)], "job_id string, complete boolean, score double"))
    run = runs.freeze(str(tmp_path / "run"), jobs, cases, predictions)
    first, second = runs.evaluate(spark, run).first(), runs.evaluate(spark, run).first()
    assert first == second and (first.scenes, first.scored_scenes, first.score, first.coverage, first.observed_mean_score) == (2, 1, None, 0.75, 0.5)
    assert [r.job_id for r in run.table(spark, "orphans").collect()] == ["stray"]
    with pytest.raises(Exception, match="(?i)exist"):
        runs.freeze(str(tmp_path / "run"), jobs, cases, predictions)
    assert {r.kind for r in runs.operations(jobs, True).collect()} == {"train", "infer", "evaluate"}
    assert "| s | test_id | 2 | 2 |" in sinks.report("r", {"task": "t"}, run.table(spark, "breakdown"))


def test_rescoring_follows_a_stream(spark, tmp_path):
    jobs = spark.createDataFrame([("a", "c", "test_id"), ("b", "c", "test_id")], "job_id string, case_id string, evaluation_partition string")
    cases = spark.createDataFrame([("c", "s")], "case_id string, scene_id string")
    batch = spark.createDataFrame([("a", True, 0.25)], "job_id string, complete boolean, score double")
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    for score, job in ((None, None), (0.75, "b")):
        if job:
            spark.createDataFrame([(job, True, score)], batch.schema).write.mode("append").parquet(str(tmp_path / "in"))
        rescoring.rescore(stream, jobs, cases, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    r = spark.read.parquet(str(tmp_path / "out" / "breakdown")).first()
    assert (r.expected_jobs, r.evaluated_jobs, r.score) == (2, 2, 0.5)


def test_documents(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"scene_id": "a", "ood1_factors": ["b"]}\n\n[1]\n{broken\n{"scene_id": null}\n')
    rows, faults = documents.read_jsonl(spark, str(tmp_path / "x.jsonl"), "scene_id string, ood1_factors array<string>")
    assert sorted(str(r.scene_id) for r in rows.collect()) == ["None", "a"] and sorted(r.text for r in faults.collect()) == ["[1]", "{broken"]
    for name, value in {"a": {"scene_id": "a"}, "b": {"scene_id": "a"}, "c": {"other": 1}}.items():
        sinks.write_document(tmp_path / "cat" / f"{name}.json", value)
    rows, faults = documents.read_catalogue(spark, str(tmp_path / "cat"), "scene_id string", "scene_id")
    assert rows.count() == 2 and sorted(r.code for r in faults.collect()) == ["duplicate_key", "missing_key"]
    scalars = spark.createDataFrame([(1, 5.0, 0), (1, 4.0, 1), (2, float("nan"), 0), (3, 1.0, 2)], "step int, value double, file_order int")
    assert sorted(tuple(r) for r in documents.latest_scalars(scalars).collect()) == [(1, 4.0), (3, 1.0)]
    with pytest.raises(ValueError, match="no rows"):
        sinks.write_csv(rows.where("false"), str(tmp_path / "csv"))
    sinks.write_jsonl(spark.createDataFrame([(2, None)], "b int, a string"), str(tmp_path / "out"))
    assert json.loads(spark.read.text(str(tmp_path / "out")).first()[0]) == {"a": None, "b": 2}


def test_archives(spark, tmp_path):
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(tmp_path / "book.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>fps</t></si></sst>')
        z.writestr("xl/worksheets/s.xml", f'<worksheet xmlns="{main}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1"><v>24</v></c></row><row r="3"><c r="A3" t="inlineStr"><is><t>mode</t></is></c></row></sheetData></worksheet>')
    archives.register(spark)
    rows = spark.read.format("xlsx_rows").option("sheet", "S").load(str(tmp_path / "*.xlsx"))
    assert sorted((r.row, r.cells) for r in rows.collect()) == [(1, {"A": "fps", "B": "24"}), (3, {"A": "mode"})]
    assert etl.settings(rows).first().settings == {"fps": "24", "mode": None}
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("IMG_1.MOV", b"abc")
        z.writestr("IMG_2.MOV.drivedownload", b"ab")
    got = spark.read.format("zip_members").option("content", "true").load(str(tmp_path / "a.zip")).orderBy("member").collect()
    assert [(r.member, r.size_bytes, r.partial, r.content) for r in got] == [("IMG_1.MOV", 3, False, bytearray(b"abc")), ("IMG_2.MOV.drivedownload", 2, True, None)]


def test_lineage_and_text(spark):
    assert lineage.canonical({"b": 1, "a": ["ü", None]}) == '{"a":["ü",null],"b":1}'
    sealed = lineage.seal({"x": 1})
    lineage.verify(sealed)
    with pytest.raises(ValueError, match="does not match"):
        lineage.verify({**sealed, "x": 2})
    df = spark.createDataFrame([('{"b": 1,  "a": 2}',), ('{"a":2,"b":1}',), ("{",), (None,)], "j string")
    a, b, c, d = (r[0] for r in df.select(lineage.canonical_sha256("j")).collect())
    assert a == b == lineage.digest({"a": 2, "b": 1}) and c is None and d is None
    row = spark.createDataFrame([("img 17.MOV", "12cm", "30度/秒", "../../x/y", "a/../../b")], "s string, c string, v string, p string, q string").select(
        text.picture_stem(F.col("s")), text.centimetres(F.col("c")), text.degrees_per_second(F.col("v")), text.dataset_relative(F.col("p")), text.stays_inside(F.col("q")), text.fixed_digits(F.lit(2.675), F.lit(2)), text.fixed_digits(F.lit(0.25), F.lit(1)),
        media.fraction(F.lit("30000/1001")), media.fraction(F.lit("0/0")), media.frame_count(F.lit(8.0), F.lit(1.0), 24.0, 121, 5), media.frame_count(F.lit(0.1), F.lit(1.0), 24.0, 121, 5), F.size(media.fixed_timeline(5.0, 16.0))).first()
    assert tuple(row)[:7] == ("IMG_0017", 12, 30.0, "x/y", False, "2.67", "0.2")
    assert row[7] == pytest.approx(29.97, abs=1e-3) and tuple(row)[8:] == (None, 121, None, 81)
