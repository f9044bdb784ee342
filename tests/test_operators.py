import random

import pytest
from pyspark.sql import functions as F

from weftline import model
from weftline.operators import cluster, gates, graphs, mining, naming, sets


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_exact_coverage_golden(spark):
    data = [("expected", x) for x in ("a", "a", " bad", "missing")] + [("produced", x) for x in ("a", "extra", "extra", "")]
    r = sets.coverage(spark.createDataFrame(data, "side string, id string")).first()
    assert (r.expected_count, r.actual_count, r.exact) == (4, 4, False)
    assert (r.missing, r.extra, r.duplicate_expected, r.duplicate_produced, r.invalid_expected, r.invalid_produced) == (["missing"], ["extra"], ["a"], ["extra"], [" bad"], [""])
    good = spark.createDataFrame([("expected", "x"), ("produced", "x")], "side string, id string")
    assert sets.coverage(good).first().exact
    assert not sets.coverage(good.where("side = 'expected'")).first().exact and not sets.coverage(good.limit(0)).first().exact


def test_pairing_and_drift(spark):
    b = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None), ("d", "1")], "path string, sha256 string")
    a = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None), ("e", "1")], "path string, sha256 string")
    assert rows(sets.pairing(b, a, "path", "sha256")) == [("a", "same"), ("b", "changed"), ("c", "changed"), ("d", "only_before"), ("e", "only_after")]
    assert rows(sets.drift(b.where("path != 'c'"), a.where("path != 'c'"))) == [("b", "changed"), ("d", "missing"), ("e", "extra")]


def test_multiset_difference_and_partitions(spark):
    f = lambda xs: spark.createDataFrame([(x,) for x in xs], "id string")
    assert rows(sets.added(f("aabc"), f("ac"))) == [("a",), ("b",)]
    assert rows(sets.partition_faults(f("abcd"), f("ab"), f("bcx"))) == [("b", "overlap"), ("d", "uncovered"), ("x", "unknown")]
    p = lambda xs: spark.createDataFrame([(x,) for x in xs], "pattern string")
    assert rows(sets.declared(p("a"), p("b"), p("ab"))) == [] and rows(sets.declared(p("a"), p("z"), p("ab"))) == [("b", "uncovered"), ("z", "unknown")]


def test_ratchet(spark):
    now = spark.createDataFrame([("same", 3), ("worse", 5), ("better", 1), ("new", 2), ("share", 400)], "dim string, value bigint")
    base = spark.createDataFrame([("same", 3, "lower"), ("worse", 4, "lower"), ("better", 2, "lower"), ("gone", 1, "lower"), ("share", 500, "higher")], "dim string, value bigint, direction string")
    got = {r.dim: r.status for r in gates.ratchet(now, base).collect()}
    assert got == {"same": "same", "worse": "up", "better": "down", "new": "up", "gone": "down", "share": "up"}
    assert {r.dim: r.status for r in gates.ratchet(now, base, unknown="current").collect()}["new"] == "same"
    v = gates.verdict(gates.ratchet(now, base)).first()
    assert not v.passed and v.exit_code == 1 and v.regressed == ["new", "share", "worse"]
    assert gates.verdict(gates.ratchet(now.where("dim = 'same'"), base.where("dim = 'same'")), decrease=True).first().exit_code == 1
    assert gates.verdict(gates.ratchet(now.limit(0), base.limit(0))).first().passed
    assert gates.without_baseline(now, closed=True).first().exit_code == 1 and gates.without_baseline(now, closed=False).first().exit_code == 0


def test_permille_is_half_even_and_guarded(spark):
    got = spark.createDataFrame([(1, 2000), (3, 2000), (0, 0), (1, 3)], "p bigint, w bigint").select(gates.permille(F.col("p"), F.col("w")).alias("x"))
    assert [r.x for r in got.collect()] == [0, 2, 0, 333]


def test_reach_on_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    assert rows(graphs.reach(graphs.reverse(edges), spark.createDataFrame([("d",)], "node string"))) == [("a", 3), ("b", 2), ("c", 1), ("d", 0)]
    with pytest.raises(RuntimeError):
        graphs.reach(edges, spark.createDataFrame([("a",)], "node string"), most=1)


def test_components_against_union_find(spark):
    r = random.Random(3)
    pairs = [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(k, k + 1) for k in range(100, 140)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in pairs:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    assert dict(rows(graphs.components(spark.createDataFrame(pairs, "a int, b int")))) == {x: find(x) for x in root}


def test_aliases(spark):
    data = [("dark", "a", "var(--b)"), ("dark", "b", "#112233"), ("dark", "x", "var(--y)"), ("dark", "y", "var(--x)"), ("dark", "m", "var(--none)"), ("light", "b", "#ffffff"), ("light", "own", "var(--a)")]
    got = {(r.theme, r.name): (r.value, r.status) for r in graphs.resolve_aliases(spark.createDataFrame(data, "theme string, name string, value string")).collect()}
    assert got["dark", "a"] == ("#112233", "resolved") and got["light", "a"] == ("#ffffff", "resolved") and got["light", "own"] == ("#ffffff", "resolved")
    assert got["dark", "x"] == (None, "cycle") and got["dark", "m"] == (None, "missing") and ("dark", "own") not in got


def test_cascade_first_and_last(spark):
    d = spark.createDataFrame([("t", "n", "1", 0, 0), ("t", "n", "2", 1, 0), ("t", "n", "3", 1, 5)], "theme string, name string, value string, file_ord int, pos int")
    assert graphs.cascade(d).first().value == "3" and graphs.cascade(d, last=False).first().value == "1"


def test_naming_law_fixture(spark):
    classes = {"text-content-primary": {"consumed-class", "grammar-owner"}, "text-blergh-quux": {"grammar-owner"}, "text-ink-primary": {"grammar-owner"}, "text-copy-strong": {"grammar-owner"}, "text-page-background-color": {"prefix-property"}, "bg-page-background-color": set(), "bg-nav-item-background-color": set(), "text-white": set()}
    source = spark.createDataFrame([(f"src/f{i}.jsx", f"// text-surface-ignored in prose\nx = '{c}'") for i, c in enumerate(classes)], "path string, text string")
    owners = spark.createDataFrame([(o,) for o in model.OWNERS], "owner string")
    css = spark.createDataFrame([("c.css", "a{}\n--surface-x: 1;\n --surface-x: 2;\n--page: 3;")], "path string, text string")
    tokens = spark.createDataFrame([("semantic", "dark", 0, "surface"), ("semantic", "light", 1, "label"), ("primitive", "dark", 0, "content"), ("semantic", "dark", 0, "page")], "tier string, theme string, theme_ord int, grp string")
    found = naming.naming_law(source, css, tokens, owners).collect()
    by = {c: {r.kind for r in found if r.path == f"src/f{i}.jsx" and r.line == 2} for i, c in enumerate(classes)}
    assert by == classes
    assert [(r.name, r.line) for r in found if r.kind == "custom-property"] == [("--surface-x", 2)]
    assert [r.name for r in found if r.kind == "group-in-source"] == ["surface"]
    assert [r for r in found if r.kind == "grammar-owner" and r.line == 1] == []


def test_parse_and_application(spark):
    assert naming.parse_name("data-table.header.background-color.hover") == {"owner": "data-table", "variant": None, "anatomy": "header", "property": "background-color", "state": "hover", "outside": None}
    assert naming.parse_name("ink-primary")["outside"] == "ink"
    uses = spark.createDataFrame([("page.background-color", "bg", None, "page"), ("page.background-color", "text", None, "page"), ("button.background-color.hover", "bg", "hover", "card"), ("mystery", "bg", None, "x")], "name string, prefix string, state_prefix string, component string")
    assert [r.score for r in naming.application_scores(uses).collect()] == [100.0, 40.0, 92.5, None]


def test_fusion_worked_example(spark):
    pair = spark.createDataFrame([(1.0, "k", "k", "ab", "ab", 0.3, 0.8, "div", "div", None, None, 10, 2)], "delta_e double, contract1 string, contract2 string, component1 string, component2 string, strength1 double, strength2 double, tag1 string, tag2 string, role1 string, role2 string, uses1 int, uses2 int")
    r = naming.fusion_scores(pair).first()
    # 40 + 25 + 15 * similarity + 10 * 0.3 + 10; with a similarity of 0.64 that is 87.6.
    assert r.confidence == pytest.approx(78 + 15) and r.absorb
    assert naming.decide(naming.fusion_scores(pair)).first().decision == "fuse"


def test_converge_keeps_uses_and_is_idempotent(spark):
    r = random.Random(2)
    c = spark.createDataFrame([(i, f"n{i % 3}", f"c{i % 3}", "comp", 0.9, "div", "x", r.randint(1, 50)) for i in range(20)], "id int, name string, contract string, component string, strength double, tag string, role string, uses int")
    d = spark.createDataFrame([(i, j, 0.5 if (i + j) % 4 else 9.0) for i in range(20) for j in range(i + 1, 20)], "id1 int, id2 int, delta_e double")
    done, turns = cluster.converge(c, d)
    assert done.agg(F.sum("uses")).first()[0] == c.agg(F.sum("uses")).first()[0] and done.count() < 20 and turns >= 3
    again, turns = cluster.converge(done, d)
    assert turns == 2 and rows(again) == rows(done)


def test_mining(spark):
    words = spark.createDataFrame([(1, "a b c a b"), (2, "a b"), (3, "")], "id int, t string")
    got = {r.gram: (r.occ, r.docs, r.chars, r.savings) for r in mining.savings(words, F.split("t", " "), key="id", occurrences=3).collect()}
    assert got == {"a b": (3, 2, 3, -21)}
    d = spark.createDataFrame([("TabTabTab", "Tab"), ("", "x"), ("x", "x"), ("night", "nacht")], "a string, b string").select(mining.dice(F.col("a"), F.col("b")).alias("d"))
    assert [r.d for r in d.collect()] == pytest.approx([0.4, 0.0, 1.0, 0.25])
    b = spark.createDataFrame([(1, ["x", "y"]), (2, ["x", "y", "z"]), (3, ["y", "z"]), (4, ["q"])], "k int, xs array<string>")
    assert rows(mining.subsets(b, key="k", items="xs")) == [(1, 2, 1), (3, 2, 1)]
    c = spark.createDataFrame([("a", 6), ("b", 3), ("c", 3)], "key string, n int")
    assert [(r.key, r["rank"], round(r.share, 4)) for r in mining.concentration(c, key="key", n="n").orderBy("rank").collect()] == [("a", 1, 0.5), ("b", 2, 0.75), ("c", 3, 1.0)]
    u = spark.createDataFrame([("1", "a b c d", False), ("2", "b a d c", False), ("3", "z", False), ("4", "z", False), ("5", "w", False), ("6", "q", True)], "key string, classes string, lawful boolean")
    from weftline.plans.style import class_partition

    assert rows(class_partition(u)) == [("A", 1, 6), ("B1", 2, 6), ("B2", 2, 6), ("C", 1, 6)]


def test_owner_from_context(spark):
    o = spark.createDataFrame([("a", "button", "x", "nav"), ("b", "div", None, "nav"), ("c", "p", None, None)], "token string, tag string, role string, container string")
    r = spark.createDataFrame([("button", None, None, "button"), (None, None, "nav", "sidebar"), ("button", "x", "nav", "nav-item")], "tag string, role string, container string, owner string")
    assert {x.token: x.owner for x in cluster.owners_by_context(o, r).collect()} == {"a": "nav-item", "b": "sidebar", "c": None}
    with pytest.raises(RuntimeError):
        cluster.preflight({"css": True, "compiler": False})


def test_subsets_of_wide_and_narrow_bundles_against_brute_force(spark):
    """Bundles on both sides of the listing limit, equal ones, and cores of one item."""
    r = random.Random(4)
    rows = [(k, r.sample(range(24), r.choice([1, 2, 3, 5, 12, 13, 16, 20]))) for k in range(120)]
    rows += [(200 + k, rows[k][1][: len(rows[k][1]) // 2 + 1]) for k in range(60)] + [(300, rows[0][1] * 2), (301, None)]
    got = mining.subsets(spark.createDataFrame(rows, "k bigint, xs array<int>"), key="k", items="xs", least=1)
    own = [(k, set(xs)) for k, xs in rows if xs]
    want = sorted((a, b, len(y) - len(x)) for a, x in own for b, y in own if x < y)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 50
