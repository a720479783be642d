import json
from datetime import datetime

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import Observation
from pyspark.sql import functions as F

from stackquarry.operators import resources
from stackquarry.sources import files, scans, snapshots

TEMPLATE = {
    "Resources": {
        "L1": {"Type": "AWS::Lambda::Function", "Properties": {"FunctionName": "f"}},
        "L2": {"Type": "AWS::Lambda::Function", "Properties": {"FunctionName": {"Ref": "P"}}},
        "L3": {"Type": "AWS::Lambda::Function", "Properties": {"FunctionName": 5}},
        "B": {"Type": "AWS::S3::Bucket"},
        "G": {"Type": "AWS::ApiGateway::RestApi", "Properties": {"Name": "api"}},
        "T": {"Type": "AWS::DynamoDB::Table", "Properties": {"TableName": "t"}},
        "X": {"Type": 5},
        "Y": "text",
        "Z": None,
        "R": {"Type": "AWS::IAM::Role", "Properties": {"Name": "r"}},
    },
    "Outputs": {"Url": {"Value": "u"}},
}


@pytest.fixture
def templates(spark):
    docs = spark.createDataFrame(
        [("p", "s", json.dumps(TEMPLATE)), ("p", "empty", "{}"), ("p", "bad", "[1")],
        "project STRING, stack STRING, doc STRING",
    )
    return resources.decode_templates(docs)


def test_resources(templates):
    entries = resources.resource_entries(templates)
    by_type = {r.type: r.n for r in resources.resources_by_type(entries).collect()}
    assert by_type == {
        "AWS::Lambda::Function": 3, "AWS::S3::Bucket": 1, "AWS::ApiGateway::RestApi": 1,
        "AWS::DynamoDB::Table": 1, "AWS::IAM::Role": 1,
    }
    labels = {r.logical_id: r.label for r in resources.key_resources(entries).collect()}
    assert labels == {
        "L1": "Lambda: f (L1)", "L2": "Lambda: L2", "L3": "Lambda: L3", "B": "S3 Bucket: B",
        "G": "API Gateway: api (G)", "T": "DynamoDB Table: t (T)",
    }
    totals = {r.stack: (r.resource_total, r.output_total) for r in resources.stack_totals(templates).collect()}
    assert totals == {"s": (10, 1), "empty": (0, 0), "bad": (0, 0)}
    assert [r.output_name for r in resources.stack_outputs(templates).collect()] == ["Url"]


def project(root, name, manifest=None, **templates):
    folder = root / name / "cdk.out"
    folder.mkdir(parents=True)
    if manifest is not None:
        (folder / "manifest.json").write_text(manifest)
    for file, text in templates.items():
        (folder / f"{file}.json").write_text(text)


def stacks(**named):
    return json.dumps(
        {
            "artifacts": {
                stack: {"type": kind, "properties": {"templateFile": file}} for stack, (kind, file) in named.items()
            }
        }
    )


def test_scan_folders(spark, tmp_path):
    root = tmp_path / "my projects"
    stack = "aws:cloudformation:stack"
    project(root, "good+one", stacks(A=(stack, "A.json"), T=("cdk:tree", "tree.json")), A=json.dumps(TEMPLATE))
    project(root, "two", stacks(B=(stack, "B.json"), C=(stack, "gone.json")), B="{}")
    project(root, "broken", '{"artifacts":')
    project(root, "mistyped", '{"artifacts":{"A":{"type":5}}}')
    project(root, "none", stacks(T=("cdk:tree", "tree.json")))
    project(root, "unbuilt", None, tree="{}")
    project(root, "badtemplate", stacks(A=(stack, "A.json")), A="[1, 2]")
    names = ["good+one", "two", "broken", "mistyped", "none", "unbuilt", "badtemplate", "absent"]
    projects = spark.createDataFrame([(f"{root}/{n}",) for n in names], "project STRING")
    path = str(root)
    manifests, templates = scans.manifest_texts(spark, path), scans.template_texts(spark, path)
    outcome = scans.scan_outcomes(projects, scans.build_files(spark, path), manifests, templates)
    got = {(r.project.rsplit("/", 1)[1], r.stack): r for r in outcome.collect()}
    codes = {k: r.error_code for k, r in got.items()}
    assert codes == {
        ("good+one", "A"): None,
        ("two", "B"): None,
        ("two", "C"): "template_unreadable",
        ("broken", None): "manifest_unparsable",
        ("mistyped", None): "manifest_unparsable",
        ("none", None): "no_stack",
        ("unbuilt", None): "manifest_unreadable",
        ("badtemplate", "A"): "template_unparsable",
        ("absent", None): "no_build_output",
    }
    assert json.loads(got["good+one", "A"].doc) == TEMPLATE
    assert got["two", "C"].error == "could not read template file gone.json"
    first = scans.first_stacks(scans.stack_artifacts(manifests)).collect()
    assert {r.project.rsplit("/", 1)[1]: r.stack for r in first} == {"good+one": "A", "two": "B", "badtemplate": "A"}
    found = scans.scan_resources(spark, path)
    assert found.filter("project LIKE '%good+one'").count() == 10
    summary = resources.scan_summary(outcome.filter("error IS NULL").select("project", "stack", "doc"))
    assert summary.filter("section = 'type'").count() == 5


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "snap")
    rows = [("p", "2024-01-01 00:00:00", "a"), ("p", "2024-01-02 00:00:00", "b"), ("p", "2024-01-02 00:00:00", "c"), ("2024", "2023-05-05 01:02:03", "d")]
    df = spark.createDataFrame(rows, "project STRING, scan_ts STRING, logical_id STRING").withColumn(
        "scan_ts", F.to_timestamp("scan_ts")
    )
    snapshots.save_snapshot(df, path)
    back = snapshots.load_snapshot(spark, path)
    assert sorted((r.project, r.logical_id) for r in back.collect()) == [("2024", "d"), ("p", "b"), ("p", "c")]
    assert "dynamicpruning" in back._jdf.queryExecution().toString()
    earlier = snapshots.load_snapshot(spark, path, datetime(2024, 1, 1, 12))
    assert sorted(r.logical_id for r in earlier.collect()) == ["a", "d"]
    asked = spark.createDataFrame([("p",), ("z",)], "project STRING")
    assert [r.project for r in snapshots.missing_snapshots(asked, back).collect()] == ["z"]


def test_metadata_and_pairs(spark, tmp_path):
    from stackquarry.operators import pairs

    root = str(tmp_path / "data")
    listed = spark.createDataFrame([("f", "arn:f"), ("g", "arn:g")], "FunctionName STRING, FunctionArn STRING")
    seen, written = Observation("seen"), Observation("written")
    raw = files.write_metadata(pairs.collect_rows(listed), root, "20240101T000000Z", seen)
    assert seen.get["records"] == 2
    assert files.read_metadata(spark, raw, multi_line=False).count() == 2
    array = tmp_path / "array"
    array.mkdir()
    (array / "x.json").write_text('[{"Type":"Lambda","FunctionName":"h","Arn":"a"},{"Type":"Table","FunctionName":"t","Arn":"b"}]')
    metadata = files.read_metadata(spark, raw, multi_line=False).unionByName(files.read_metadata(spark, str(array)))
    out = files.write_pairs(pairs.make_pairs(metadata), root, "20240101T000000Z", written)
    assert written.get["records"] == 3
    rows = files.load_pairs(spark, out).collect()
    assert sorted(r.prompt for r in rows) == [f"What triggers the {n} Lambda?" for n in "fgh"]
    texts = pairs.truncate_text(pairs.pair_text(files.load_pairs(spark, out)), 3).collect()
    assert all(r.tokens == ["What", "triggers", "the"] for r in texts)


def test_load_pairs_faults(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        (tmp_path / "empty").mkdir()
        files.load_pairs(spark, str(tmp_path / "empty"))
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "a.jsonl").write_text('{"prompt":"p","completion":"c"}\n{"prompt":"p","completion":""}\n')
    assert files.load_pairs(spark, str(bad)).count() == 1
    (bad / "b.jsonl").write_text("{nonsense\n")
    with pytest.raises(Exception):
        files.load_pairs(spark, str(bad)).collect()
    with pytest.raises((FileNotFoundError, AnalysisException)):
        files.load_pairs(spark, str(tmp_path / "absent"))


def test_results(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame(
        [("q1", '{"a":"<&>"}', None, True), ("q2", None, None, True), ("q3", None, "bad", False)],
        "query STRING, data STRING, error STRING, success BOOLEAN",
    )
    files.write_results(df, path)
    got = {d["query"]: d for d in (json.loads(r.value) for r in spark.read.text(path).collect())}
    assert got == {
        "q1": {"query": "q1", "data": {"a": "<&>"}, "success": True},
        "q2": {"query": "q2", "data": None, "success": True},
        "q3": {"query": "q3", "data": None, "error": "bad", "success": False},
    }


def test_meminfo_and_chunks(spark, tmp_path):
    dumps = tmp_path / "hosts"
    dumps.mkdir()
    (dumps / "a").write_text("MemFree: 1 kB\nMemTotal:        8000000 kB\n")
    (dumps / "b").write_text("MemFree: 1 kB\n")
    (dumps / "c").write_text("MemTotal: many kB\n")
    rows = {r.path.rsplit("/", 1)[1]: (r.ram_gb, r.error) for r in files.read_meminfo(spark, str(dumps)).collect()}
    assert rows["a"] == (7, None)
    assert rows["b"][1].startswith("could not find") and rows["c"][1].startswith("could not parse")
    (tmp_path / "chunks.json").write_text('{"req_id":"r","chunk_idx":1,"response":"x"}\n')
    assert files.read_chunks(spark, str(tmp_path / "chunks.json")).first().chunk_idx == 1
