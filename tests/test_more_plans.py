"""Manifests, schemas, registries, flows, the runner and the stream."""

import json

import pytest
from pyspark.sql import functions as F

from weftline import model
from weftline.functions import text as T
from weftline.operators import mining, sets
from weftline.plans import colours, docs, evidence, routes, runner, style
from weftline.sources import files
from weftline.streaming import census

DIGEST = "0123456789abcdef" * 4


def _image(value):
    import numpy as np

    return bytearray(evidence.encode_png(np.full((2, 3, 4), value, dtype=np.uint8)))


def _captures(spark, *ids):
    return spark.createDataFrame([(i, f"{i}.png", _image(9), f"{i}.json", bytearray(b"{}"), [], [], [], [], False) for i in ids], "scenarioId string, pngPath string, png binary, metaPath string, meta binary, consoleErrors array<string>, pageErrors array<string>, networkFailures array<string>, axeViolationIds array<string>, overflow boolean")


def _run(**kw):
    return {"runId": "tokenize-x", "phase": "before", "batchId": "B0001"} | dict.fromkeys(model.FINGERPRINTS, DIGEST) | kw


def test_manifest(spark):
    expected = spark.createDataFrame([("a",), ("b",)], "id string")
    head, rows = evidence.build_manifest(_captures(spark, "b", "a"), expected, _run())
    got = rows.collect()
    assert [(r["scenarioId"], r["width"], r["height"]) for r in got] == [("a", 3, 2), ("b", 3, 2)]
    assert head["requestedScenarioIds"] == ["a", "b"] and evidence.bound(head)
    disk = _captures(spark, "b", "a").select(F.col("pngPath").alias("path"), F.col("png").alias("content"))
    assert evidence.manifest_faults(rows, disk).isEmpty()
    for captures, own in ((_captures(spark, "a"), _run()), (_captures(spark, "a", "a", "b"), _run()), (_captures(spark, "a", "b"), _run(phase="now")), (_captures(spark, "a", "b"), _run(sourceFingerprint="x"))):
        with pytest.raises(evidence.ContractError):
            evidence.build_manifest(captures, expected, own)
    with pytest.raises(evidence.ContractError, match="unreadable"):
        evidence.build_manifest(_captures(spark, "a", "b").withColumn("png", F.lit(b"no").cast("binary")), expected, _run())


def test_run_names():
    assert evidence.run_faults("tokenize-a", "final", None) == []
    assert evidence.run_faults("other", "later", "B1") == ["run", "phase", "batch"]
    assert evidence.run_faults("tokenize-a", "after", None) == ["no-batch"]


def test_lists_and_schema(spark):
    rows = spark.createDataFrame([(["a", "b"],), ([],), (None,), (["a", "a"],), ([" a"],), (["a", None],)], "x array<string>")
    assert [r[0] for r in rows.select(evidence.list_faults(F.col("x"))).collect()] == [None, "empty", "empty", "repeated", "blank-or-untrimmed", "blank-or-untrimmed"]
    schema = {"type": "object", "required": ["id"], "additionalProperties": False, "properties": {"id": {"type": "string", "pattern": "^x"}, "n": {"type": ["integer", "null"], "minimum": 1}, "list": {"type": "array", "minItems": 1, "items": {"enum": ["a"]}}}}
    assert evidence.schema_faults({"id": "x1", "n": None, "list": ["a"]}, schema) == []
    assert evidence.schema_faults({"n": 0, "list": ["b"], "more": 1}, schema) == ["/id: missing", "/more: unexpected", "/list/0: not one of ['a']", "/n: too small"]
    assert evidence.schema_faults({"id": "y", "n": True, "list": []}, schema) == ["/id: pattern", "/list: fewer than 1", "/n: not integer or null"]


def test_snapshots(spark):
    names, projects = spark.createDataFrame([("home_page",), ("x",)], "name string"), spark.createDataFrame([("desktop",), ("mobile-sm",)], "project string")
    committed = spark.createDataFrame([("home-page-desktop-linux.png",)], "file string")
    assert [tuple(r) for r in evidence.with_snapshot(names, projects, committed).collect()] == [("home_page", "desktop")]


def test_registry_parts(spark):
    declared = spark.createDataFrame([("/", []), ("/w/:id", []), ("/n/:key", []), ("/r/:token", [])], "pattern string, guards array<string>")
    fixtures = spark.createDataFrame([("/w/:id", "w1", "w", {"id": "7"}, "checked-in")], "pattern string, fixture string, name string, params map<string,string>, source string")
    contexts, skips = routes.registry(declared, fixtures)
    counts = routes.registry_counts(contexts, skips, declared).first().asDict()
    assert counts["declared"] == 4 and counts["materialised"] == 2 and counts["gaps"] == 1 and counts["out_of_scope"] == 1 and counts["exact"] and not counts["fixtures_complete"]
    ready = spark.createDataFrame([("/", "main", "visible")], "pattern string, witness string, assertion string")
    reads = spark.createDataFrame([("/", "POST", "/api/search")], "pattern string, method string, path string")
    shown = routes.scenarios(contexts, ready, reads, spark.createDataFrame([], "pattern string, selector string")).where("pattern = '/'").first()
    assert shown["assertions"] == ["loaded", "visible"] and [tuple(x) for x in shown["reads"]] == [("POST", "/api/search")]
    assert routes.foreign_fixtures(contexts, fixtures).isEmpty()
    assert routes.foreign_fixtures(contexts, fixtures.withColumn("pattern", F.lit("/other"))).first()["fixture"] == "w1"


def test_affected(spark):
    own = spark.createDataFrame([("/", ["src/home.jsx"], []), ("/w", ["src/w.jsx"], [])], "pattern string, modules array<string>, guards array<string>")
    edges = spark.createDataFrame([("src/home.jsx", "src/button.jsx"), ("src/main.jsx", "src/home.jsx"), ("src/main.jsx", "src/w.jsx")], "src string, dst string")
    paths = spark.createDataFrame([(p,) for p in ("src/home.jsx", "src/w.jsx", "src/button.jsx", "src/main.jsx")], "path string")
    changed = spark.createDataFrame([("src/button.jsx",)], "file string")
    none = spark.createDataFrame([], "importer string, specifier string")
    empty = spark.createDataFrame([], "pattern string, fixture string, name string, params map<string,string>, source string")
    got = routes.affected(own, edges, changed, none, paths, empty)
    assert [r["pattern"] for r in got["contexts"].collect()] == ["/"]
    assert got["outcome"].first()["coverage_complete"]


def test_elements_paths_and_requests(spark):
    rows = spark.createDataFrame([(1, "<AdminRequired><Page/></AdminRequired>"), (2, "<Lost/>"), (3, "null")], "node int, expression string")
    imports = spark.createDataFrame([("Page", "./page"), ("AdminRequired", "./guard")], "local string, specifier string")
    got = {r["node"]: (r["modules"], r["guards"], r["unresolved"]) for r in routes.element_modules(rows, imports).collect()}
    assert got == {1: (["./page"], ["AdminRequired"], []), 2: ([], [], ["Lost"]), 3: ([], [], [])}
    paths = spark.createDataFrame([("/a/b/c.jsx",), ("x\\y.js",), ("/other/z",)], "p string").select(routes.portable(F.col("p"), "/a/b"))
    assert [r[0] for r in paths.collect()] == ["c.jsx", "x/y.js", "/other/z"]
    fixtures = spark.createDataFrame([([("GET", "/api/a", 200)],)], "responses array<struct<method: string, path: string, status: int>>")
    asked = spark.createDataFrame([(1, "GET", "/api/a?x=1"), (2, "GET", "/api/ab"), (3, "POST", "/api/a")], "id int, method string, url_path string")
    assert {r["id"]: r["status"] for r in routes.matching_fixtures(asked, fixtures).collect()} == {1: 200, 2: None, 3: None}


def test_exemptions_keys_and_order(spark):
    paths = spark.createDataFrame([("docs/adr/1.md",), ("a/archive/b.md",), ("docs/log.md",), ("src/a.jsx",), (".snyk",)], "p string")
    got = paths.select(docs.archived(F.col("p")), docs.historical(F.col("p")), docs.checked_extension(F.col("p"), (".md", ".py"))).collect()
    assert [tuple(r) for r in got] == [(False, True, True), (True, True, True), (False, True, True), (False, False, False), (False, False, True)]
    key = spark.createDataFrame([("home__dark__desktop",), ("home",)], "k string").select(T.pair_key(F.col("k")).alias("x")).select("x.*").collect()
    assert [tuple(r) for r in key] == [("home", "dark", "desktop"), ("home", None, None)]
    names = spark.createDataFrame([("A",), ("b",), ("a",), ("_z",)], "n string")
    assert [r["n"] for r in names.orderBy(T.by_locale(F.col("n"))).collect()] == ["_z", "a", "A", "b"]
    rows = sets.numbered(spark.createDataFrame([("x",), ("x",), ("y",)], "k string"), ["k"]).collect()
    assert sorted((r["k"], r["nth"]) for r in rows) == [("x", 1), ("x", 2), ("y", 1)]


def test_semantic_clusters(spark):
    rows = [(i, "flex gap-2", "div", []) for i in range(49)] + [(90, "bg-card rounded border", "div", []), (91, "border rounded bg-card", "div", []), (92, "px-2 text-sm", "button", ["icon"])]
    got = {r["surface"]: r for r in mining.semantic_clusters(spark.createDataFrame(rows, "entity int, classes string, tag string, roles array<string>")).collect()}
    assert (got["structural"]["confidence"], got["structural"]["split"], got["structural"]["entities"]) == (53, "classHash", 49)
    assert (got["card-or-panel"]["confidence"], got["card-or-panel"]["decision"], got["card-or-panel"]["entities"]) == (78, "style_token_candidate", 2)
    assert got["interactive-control"]["decision"] == "review_required"


def test_palette(spark):
    tokens = spark.createDataFrame([("dark", "white", "var(--lost)"), ("dark", "page", "#abc")], "theme string, name string, value string")
    got = {r["name"]: r["rgb"] for r in colours.named_colours(tokens).collect()}
    assert got["white"] is None and tuple(got["page"]) == (170, 187, 204) and tuple(got["slate-950"]) == (2, 6, 23) and got["transparent"] is None and len(got) == 59


def test_fixture_registry_and_flows(spark, tmp_path):
    good = {"schemaVersion": "1", "readOnly": True, "fixtures": [{"id": "a", "routePattern": "/a", "routeParams": {}, "contractSources": ["src/a.ts"], "responses": [{"method": "GET", "path": "/api/a", "status": 200, "body": "{}"}]}]}
    (tmp_path / "good.json").write_text(json.dumps(good))
    assert files.fixture_registry(spark, str(tmp_path / "good.json")).first()["id"] == "a"
    (tmp_path / "bad.json").write_text(json.dumps(good | {"readOnly": False}))
    with pytest.raises(ValueError, match="read-only"):
        files.fixture_registry(spark, str(tmp_path / "bad.json"))
    flows = spark.createDataFrame([("a", '{"id": "f-1", "name": "F", "steps": []}'), ("b", '{"id": "f 1", "name": "F", "steps": []}'), ("c", '{"id": "f", "name": " ", "steps": []}'), ("d", "no")], "path string, text string")
    assert [r["id"] for r in files.valid_flows(flows).collect()] == ["f-1"]


def test_runner(spark, tmp_path):
    root, calls = f"file://{tmp_path}/run", []

    def make(name, fail=False):
        def work(spark, rows):
            calls.append(name)
            if fail and calls.count(name) == 1:
                raise RuntimeError("lost")
            return spark.range(3 if not rows else rows["a"].count())

        return work

    phases = [("a", [], make("a")), ("b", ["a"], make("b", True)), ("c", ["b"], make("c"))]
    assert runner.run(spark, root, phases) == {"a": "done", "b": "failed", "c": "blocked"}
    assert runner.run(spark, root, phases) == {"a": "done", "b": "done", "c": "done"}
    assert calls == ["a", "b", "b", "c"]
    assert runner.run(spark, root, phases) == {"a": "done", "b": "done", "c": "done"} and len(calls) == 4
    assert [r["state"] for r in runner.journal(spark, root).where("phase = 'b'").collect()] == ["begun", "failed", "begun", "done"]
    with pytest.raises(ValueError, match="needs"):
        runner.run(spark, root, [("x", ["y"], make("x"))])


def test_stream_counts_the_newest_versions(spark, tmp_path):
    arriving = f"file://{tmp_path}/in"
    kind = "path string, version bigint, text string"

    def put(*rows):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(arriving)

    def now():
        stream = spark.readStream.schema(kind).parquet(arriving)
        census.run(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/state")
        return {r["dim"]: r["value"] for r in census.totals(spark.read.parquet(f"file://{tmp_path}/out")).collect()}

    put(("a", 1, "bg-gray-100\nz-[5]\nbg-gray-50 ds-allow: x"), ("b", 1, "text-[13px]"), (None, 1, "z-[5]"))
    first = now()
    assert (first["color-gray"], first["zindex"], first["typography-px"], first["TOTAL"]) == (1, 1, 1, 3)
    put(("a", 3, "z-[5]\nz-[6]"), ("a", 2, "bg-gray-100"), ("b", 2, None))
    second = now()
    assert (second["color-gray"], second["zindex"], second["typography-px"], second["TOTAL"]) == (0, 2, 0, 2)
    put(("a", 1, "z-[1]\nz-[2]\nz-[3]"))
    assert now() == second
    whole = spark.createDataFrame([("a", "z-[5]\nz-[6]")], "path string, text string")
    assert {r["dim"]: r["value"] for r in style.hardcode_counts(whole).collect()} == second
