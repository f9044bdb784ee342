import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.plans import evidence as E


def png(w, h, f):
    return E.encode_png(np.array([[f(x, y) for x in range(w)] for y in range(h)], np.uint8))


PLAIN = (10, 20, 30, 255)
SIGNALS = "scenarioId string, content binary, consoleErrors array<string>, pageErrors array<string>, networkFailures array<string>, axeViolationIds array<string>, overflow boolean"


def captures(spark, rows):
    return spark.createDataFrame([(i, c, *s) for i, c, *s in rows], SIGNALS)


def cap(i, content, console=(), axe=(), overflow=False):
    return (i, content, list(console), [], [], list(axe), overflow)


def test_pixels_golden():
    a = E.decode_png(png(3, 2, lambda x, y: PLAIN))
    b = E.decode_png(png(3, 2, lambda x, y: (210, 20, 30, 255) if (x, y) == (1, 0) else PLAIN))
    r = E.compare_pixels(a, b, heat=True)
    assert (r["status"], r["exact"], r["perceptual"], r["max_delta"], r["bounds"]) == ("changed", 1, 1, 200, {"x": 1, "y": 0, "width": 1, "height": 1}) and r["exact_ratio"] == pytest.approx(1 / 6)
    assert E.decode_png(r["heatmap"])[0, 1].tolist() == [255, 0, 0, 255]
    zero = lambda w: E.decode_png(png(w, 2, lambda x, y: (0, 0, 0, 0)))
    r = E.compare_pixels(zero(2), zero(3))
    assert (r["exact"], r["perceptual"], r["bounds"]) == (2, 2, {"x": 2, "y": 0, "width": 1, "height": 2})
    assert E.compare_pixels(a, a)["status"] == "identical"


def test_broken_images():
    good = png(2, 2, lambda x, y: PLAIN)
    assert E.decode_png(good) is not None
    for bad in (b"", good[:-5], good[:30] + b"x" + good[31:], b"GIF" + good[3:]):
        assert E.decode_png(bad) is None


def test_comparison_golden(spark):
    same, other = png(3, 2, lambda x, y: PLAIN), png(3, 2, lambda x, y: (11, 20, 30, 255) if x == y == 0 else PLAIN)
    before = captures(spark, [cap("settings/default", same), cap("settings/hover", same)])
    after = captures(spark, [cap("settings/default", same), cap("settings/hover", other)])
    run = lambda *p: {r.scenarioId: (r.verdict, r.reasons) for r in E.compare(before, after, E.policy(before, *p)).collect()}
    assert run("preserve") == {"settings/default": ("pass", []), "settings/hover": ("fail", ["exact-changed-pixels-exceeded", "exact-changed-pixel-ratio-exceeded"])}
    assert run("change")["settings/default"] == ("fail", ["expected-change-not-observed-by-pixel-count", "expected-change-not-observed-by-pixel-ratio"])
    mixed = E.compare(before, after, E.policy(before, "mixed", ["settings/hover"], ["settings/default"]))
    assert tuple(E.comparison_verdict(mixed).first()) == (2, "pass", "review")
    assert E.comparison_verdict(mixed.limit(0)).first().verdict == "fail"
    worse = captures(spark, [cap("settings/default", same, console=["x", "x"]), cap("settings/hover", same, overflow=True)])
    base = captures(spark, [cap("settings/default", same, console=["x"]), cap("settings/hover", same)])
    got = {r.scenarioId: r for r in E.compare(base, worse, E.policy(base, "preserve")).collect()}
    assert all(r.reasons == ["new-runtime-or-accessibility-error"] for r in got.values()) and got["settings/default"].added.consoleErrors == ["x"] and got["settings/default"].counts.consoleErrors == 1
    with pytest.raises(E.ContractError):
        E.compare(before, after.limit(1), E.policy(before, "preserve"))
    for bad in (("preserve", ["a"]), ("mixed", ["settings/hover"], []), ("mixed", ["settings/hover"], ["settings/hover"]), ("odd",)):
        with pytest.raises(E.ContractError):
            E.policy(before, *bad)


def test_manifest_verification(spark):
    c = png(3, 2, lambda x, y: PLAIN)
    files = spark.createDataFrame([("a.png", c), ("b.png", c + b"x")], "path string, content binary")
    sha = spark.range(1).select(F.sha2(F.lit(c), 256)).first()[0]
    m = spark.createDataFrame([("a", "a.png", sha, len(c), 3, 2), ("b", "b.png", sha, len(c), 3, 2), ("c", "../c.png", sha, 1, 1, 1), ("d", "a.png", sha, len(c), 4, 2)], "scenarioId string, pngPath string, sha256 string, bytes int, width int, height int")
    assert {r.scenarioId: r.faults for r in E.manifest_faults(m, files).collect()} == {"b": ["sha256", "bytes"], "c": ["outside", "missing"], "d": ["dimensions"]}


def test_capture_metadata(spark):
    good = cap("route/settings::theme/dark::project/desktop", b"")
    bad = [("x", b"", None, [], [], [], None), (" y", b"", [None], [], [], [], True), ("x", b"", [], [], [], [], False)]
    got = sorted(map(tuple, E.capture_faults(captures(spark, [good, *bad])).collect()))
    assert got == [(" y", "consoleErrors-not-strings"), (" y", "invalid-id"), ("x", "consoleErrors-not-strings"), ("x", "duplicate-id"), ("x", "duplicate-id"), ("x", "overflow-not-boolean")]


def test_bindings_and_waivers():
    a = dict.fromkeys(("runId", "batchId", "fixtureRegistryFingerprint"), "1")
    b = a | {"fixtureRegistryFingerprint": "2"}
    w = {"field": "fixtureRegistryFingerprint", "before": "1", "after": "2", "owner": "o", "reason": "r", "scope": "s", "evidence": "e", "review": "v"}
    assert len(E.binding_faults(a, b)) == 1 and E.binding_faults(a, b, [w]) == []
    for bad in (w | {"after": "3"}, w | {"owner": " "}, w | {"field": "runId"}):
        with pytest.raises(E.ContractError):
            E.binding_faults(a, b, [bad])


def test_matrix_and_selection(spark):
    s = spark.createDataFrame([("home/default",), ("x/default",)], "scenario string")
    dims = {"theme": ["dark", "light"], "project": ["desktop", "tablet", "mobile"]}
    assert E.matrix(s, dims).count() == 12
    assert [r.id for r in E.select(s, dims, {"theme": ["dark"], "project": ["tablet"]}, ["x/default"]).collect()] == ["x/default::theme/dark::project/tablet"]
    for bad in (({"theme": ["blue"]}, None), ({}, ["gone"]), ({}, [])):
        with pytest.raises(E.ContractError):
            E.select(s, dims, *bad)
    stem = spark.createDataFrame([("a/b c",), ("///",)], "x string").select(E.stem(F.col("x"))).collect()
    assert stem[0][0].startswith("a_b_c-") and len(stem[0][0]) == 22 and stem[1][0].startswith("capture-")


def test_review(spark):
    ref = ["a" * 64, "b" * 64]
    need = spark.createDataFrame([("s", ref)], "scenarioId string, refs array<string>")
    entry = lambda *rows: spark.createDataFrame(list(rows), "scenarioId string, verdict string, observation string, requiredAction string, evidenceRefs array<string>")
    good = ("s", "expected", "fine", "", ref)
    assert E.review_faults(entry(good), need).count() == 0 and E.review_verdict(entry(good)).first().verdict == "pass"
    assert {r.fault for r in E.review_faults(entry(("s", "expected", " ", "", ref)), need).collect()} == {"blank-observation"}
    assert {r.fault for r in E.review_faults(entry(good, good), need).collect()} == {"duplicate_produced"}
    assert {r.fault for r in E.review_faults(entry(("s", "ambiguous", "x", "", ref[:1])), need).collect()} == {"blank-action", "lacks-evidence", "too-few-refs"}
    assert E.review_verdict(entry(good, ("t", "ambiguous", "x", "y", ref))).first().verdict == "requires-human" and E.review_verdict(entry()).first().verdict == "fail"


def test_composition_reports_and_sources(spark):
    parts = spark.createDataFrame([("p1", "k", "a"), ("p2", "k", "b")], "part string, identity string, scenarioId string")
    whole = parts.select("scenarioId")
    assert E.compose(parts, whole).count() == 2
    for bad in (parts.where("part = 'p1'"), parts.unionAll(parts), parts.withColumn("identity", F.col("part"))):
        with pytest.raises(E.ContractError):
            E.compose(bad, whole)
    b = spark.createDataFrame([("k", "1", ["e"]), ("l", None, [])], "key string, hash string, errors array<string>")
    a = spark.createDataFrame([("k", "1", ["e", "e"]), ("l", None, ["n"])], "key string, hash string, errors array<string>")
    assert sorted(map(tuple, E.report_gate(b, a).collect())) == [("changed", 1, 1), ("same", 1, 0)]
    assert E.redacted_difference('a\n<p className="x"/>\n\n\nb', 'a\n<p className="y"/>\n\nb', [r'className="[^"]*"']) is None
    assert E.redacted_difference("a\nb", "a\nc", [])[0] == 2
    d = spark.createDataFrame([('{"b": 1, "a": [2, {"y": 1, "x": 2}]}',), ('{"a":[2,{"x":2,"y":1}],"b":1}',), ("no",)], "j string").select(E.canonical_digest(F.col("j")).alias("h"))
    h = [r.h for r in d.collect()]
    assert h[0] == h[1] and h[2] is None
    stop = E.stop_gate(spark.createDataFrame([(5, None), (None, 7)], "modified int, folder_modified int"), spark.createDataFrame([(8, True), (9, False)], "modified int, valid boolean"))
    assert stop.first().exit_code == 0
    o = spark.createDataFrame([("p", "x", 1441.0, 1440), ("p", "y", 1500.0, 1440), ("q", "z", 1440.5, 1440)], "page string, element string, right double, width int")
    assert [tuple(r) for r in E.worst_overflow(o).collect()] == [("p", "y", 60.0)]
