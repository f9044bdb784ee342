import pytest
from pyspark.sql import functions as F

from weftline.plans import colours, docs, routes, style


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def source(spark):
    files = {
        "src/a.jsx": 'import X from "components/lib/X";\n<div className="text-gray-500 hover:bg-ink p-[3px] rounded-lg bg-theme-bg-x">\n<b size={16} className={`gap-2 ${on ? "hover:x" : ""} "md:p`}/>\n<i className="border-border-soft rounded hover: z-50"/>\n</div>',
        "src/b.js": "<p className='fixed z-10 bg-panel rounded text-theme-y/50'>#fff</p>\nrgba(0,0,0,0.5) shadow\n// ds-allow: #123456\nbg-white bg-white/10 ease-[var(--e)] z-[3]",
        "src/c.tsx": "<Icon size={64} /> <q className={cn('hover:bg-primary')}/>",
        "legacy/d.jsx": "<a className='bg-red-500'/>",
    }
    return spark.createDataFrame(list(files.items()), "path string, text string")


def test_hardcode(spark, source):
    got = {r.dim: r.value for r in style.hardcode_counts(source, allow=spark.createDataFrame([("legacy/*",)], "pattern string")).collect()}
    assert got == {"color-gray": 1, "color-hex": 1, "color-named": 0, "color-wb": 1, "motion": 0, "radius-shadow": 0, "spacing-rhythm": 1, "typography-px": 0, "zindex": 3, "TOTAL": 7}
    listed = style.hardcode_lines(source)
    assert listed.where("dim = 'color-named'").first().path == "legacy/d.jsx"
    assert {r.dim: r["count"] for r in listed.groupBy("dim").count().collect()}["zindex"] == got["zindex"]


def test_cohesion(source):
    got = {r.dim: r.value for r in style.cohesion(source).collect()}
    assert got == {"hover-neutral-tones": 1, "icon-sizes": 1, "surface-tokens": 1, "container-border": 1, "broken-token": 2}


def test_variety(source):
    got = {r.dim: r.value for r in style.variety(source).collect()}
    assert got == {"hover-tones": 1, "icon-sizes": 1, "radius-scales": 2, "panel-surfaces": 1, "legacy-vocab": 2, "shared-coverage": 500}


def test_ghosts(spark, source):
    used = style.used_classes(source)
    assert {r.name: r.path for r in used.collect()}["rounded-lg"] == "src/a.jsx"
    css = spark.createDataFrame([(r".text-gray-500{} .hover\:bg-ink:hover{} .\!gap-2{} .p-\[3px\]{}",)], "text string")
    ghosts = {r.name for r in style.ghost_classes(used, css).collect()}
    assert "rounded-lg" in ghosts and not ghosts & {"text-gray-500", "hover:bg-ink", "gap-2", "p-[3px]"}


def test_dead(spark):
    src = spark.createDataFrame([("a.jsx", '<a className="bg-theme-gone text-theme-here bg-solid/50 text-no-such bg-tre-mor text-tre-mor border-b-2"/>')], "path string, text string")
    c = spark.createDataFrame([("theme-here", "x"), ("solid", "#fff"), ("pair", "var(--pair)")], "name string, value string")
    css = spark.createDataFrame([("--pair: 1; .text-tre-mor{}",)], "text string")
    pairs = spark.createDataFrame([("pair",), ("lost",)], "name string")
    got = rows(style.dead_classes(src, c, spark.createDataFrame([], "name string"), css, pairs))
    assert got == [("a", "theme-gone"), ("b", "solid"), ("c", "lost"), ("d", "no-such"), ("d", "tre-mor")]


def test_usage_and_areas(spark):
    src = spark.createDataFrame([("pages/X/Y/z.jsx", '<ul className="gap-2"><li className="card">a</li>\n<li className={dyn}/></ul>'), ("components/K/k.jsx", '<Card className="card big"/>')], "path string, text string")
    e = {(r.tag, r.line): (r.classes, r.parent_tag, r.parent_classes) for r in style.elements(src).collect()}
    assert e["li", 1] == ("card", "ul", "gap-2") and e["li", 2] == ("<dynamic>", "ul", "gap-2") and e["Card", 1] == ("card big", None, None)
    u = {r.variant: r for r in style.usage(src, [("card", r"\bcard\b"), ("big", "big")]).collect()}
    assert u["card"].n == 2 and u["card"].parent_gap == 1 and u["card"].tags == {"li": 1, "Card": 1}
    assert {a.area for a in u["card"].areas} == {"pages/X/Y", "components/K"}
    assert not style.scanned_share(src.limit(1), src).first().ok and style.scanned_share(src, src).first().ok and not style.scanned_share(src.limit(0), src.limit(0)).first().ok


def decl(spark, data):
    return spark.createDataFrame([(t, n, v, 0, i) for i, (t, n, v) in enumerate(data)], "theme string, name string, value string, file_ord int, pos int")


def test_contract(spark):
    data = [("dark", "primary", "#000000"), ("dark", "primary-foreground", "#ffffff"), ("light", "primary", "#eeeeee"), ("dark", "info", "#ffffff"), ("dark", "info-foreground", "#000000"), ("dark", "success", "rebeccapurple"), ("dark", "success-foreground", "#ffffff"), ("dark", "muted", "#000"), ("dark", "info-fill", "var(--info)")]
    got = colours.contract(decl(spark, data))
    v = {(r.theme, r.pair): r.verdict for r in got.collect()}
    assert v["dark", "primary"] == "ok" and v["light", "primary"] == "violates" and v["dark", "info"] == "violates" and v["dark", "success"] == "skipped" and v["dark", "warning"] == "missing" and v["dark", "info-fill"] == "ok"
    assert colours.contract_outcome(got).first().exit_code == 1
    assert colours.contract_outcome(got.where("verdict = 'missing'")).first().exit_code == 1
    assert colours.contract_outcome(got.where("verdict in ('ok', 'skipped')")).first().exit_code == 2 and colours.contract_outcome(got.where("verdict = 'ok'")).first().exit_code == 0


def test_pairs_at_use(spark):
    c = spark.createDataFrame([("dark", "white", (255, 255, 255)), ("dark", "black", (0, 0, 0)), ("light", "white", (255, 255, 255)), ("light", "black", (0, 0, 0)), ("dark", "canvas", (255, 255, 255))], "theme string, name string, rgb struct<r: int, g: int, b: int>")
    p = spark.createDataFrame([("text-white", "bg-black", False, "canvas"), ("text-white", "bg-white", False, "canvas"), ("text-white", "bg-black/25", False, "canvas"), ("text-x", "bg-black", False, "canvas")], "text string, bg string, non_text boolean, under string")
    got = colours.evaluate(p, c)
    r = {(x.text, x.bg, x.theme): (x.ratio, x.passed, x.note) for x in got.collect()}
    assert r["text-white", "bg-black", "dark"] == (21.0, True, None) and r["text-white", "bg-white", "dark"] == (1.0, False, None)
    assert r["text-white", "bg-black/25", "light"] == (None, None, "unresolved-under") and r["text-white", "bg-black/25", "dark"][1] is False
    assert r["text-x", "bg-black", "dark"] == (None, None, "unresolved")
    o = {(x.text, x.bg): (x.ok, x.fails) for x in colours.evaluated_outcome(got).collect()}
    assert o["text-white", "bg-black"] == (True, []) and o["text-x", "bg-black"] == (False, []) and o["text-white", "bg-black/25"] == (False, ["dark", "light"])


def test_declared_pairs(spark):
    d = decl(spark, [(":root", "a", "#000"), (":root", "b", "#fff"), (":root", "b-rgb", "255 255 255"), ("light", "b", "#000000"), ("light", "c", "var(--c)")])
    pairs = spark.createDataFrame([("ring", "a", "b", 3.0), ("bad", "a", "c", 3.0)], "label string, fg string, bg string, least double")
    got = colours.declared_pairs(d, pairs, spark.createDataFrame([("b", "b-rgb")], "hex string, rgb string"))
    r = {(x.what, x.theme): x.category for x in got.collect()}
    assert r["ring", ":root"] == "ok" and r["ring", "light"] == "regression" and r["bad", "light"] == "error" and r["b = b-rgb", ":root"] == "ok" and r["b = b-rgb", "light"] == "regression"
    assert colours.declared_outcome(got).first().exit_code == 2 and colours.declared_outcome(got.where("category != 'error'")).first().exit_code == 1


def test_token_differences(spark):
    t = spark.createDataFrame([("a", "x", (10, 10, 10)), ("b", "x", (10, 10, 11)), ("c", "x", (200, 0, 0)), ("a", "y", (0, 0, 0)), ("b", "y", (255, 255, 255))], "name string, theme string, rgb struct<r: int, g: int, b: int>")
    p = {(r.a, r.b, r.theme): r.pattern for r in colours.differences(t).collect()}
    assert p["a", "b", "x"] == "one" and p["a", "c", "x"] == "none"


def test_links_and_citations(spark):
    d = spark.createDataFrame([("docs/a.md", "[x](b.md) [y](gone.md#s) [z](/docs/b.md) [u](https://x) [p]({x}.md) [s](my%20file.md)\n```\n[f](nope.md)\n```\nsee src/old.js here"), ("docs/log.md", "src/old.js")], "path string, text string")
    paths = spark.createDataFrame([("docs/a.md",), ("docs/b.md",), ("docs/my file.md",), ("docs/log.md",), ("src/new.js",)], "path string")
    gone = spark.createDataFrame([("src/old.js", "src/new.js")], "old string, new string")
    assert rows(docs.broken_links(d, paths)) == [("broken-link", "docs/a.md", 1, "gone.md")]
    found = docs.integrity(d, gone, paths)
    assert sorted((r.check, r.line, r.term) for r in found.collect()) == [("broken-link", 1, "gone.md"), ("stale-citation", 5, "src/old.js")]


def test_wiki(spark):
    d = spark.createDataFrame([("index.md", "[a](notes/a.md) and `plans` [o](_arquivo/x.md)"), ("notes/a.md", "---\nupdated: never\n---\n</content>"), ("notes/Bad_Name.md", "x"), ("log.md", "## [2026-01-02] k · v\n## [2026-01-03] k · v\n## [sem-data] k · v\n## [2026-05-05] k · v\n## nope"), ("x/log.md", "nothing")], "path string, text string")
    files = d.select("path").union(spark.createDataFrame([("case/plans/deep/y.json",), ("lost/z.json",)], "path string"))
    got = {(r.rule, r.path) for r in docs.wiki(d, files).collect()}
    assert got == {("orphan", "notes/Bad_Name.md"), ("orphan", "lost/z.json"), ("name", "notes/Bad_Name.md"), ("stray-tag", "notes/a.md"), ("archived-link", "index.md"), ("updated", "notes/a.md"), ("log-form", "log.md"), ("log-order", "log.md"), ("log-empty", "x/log.md")}
    ch = spark.createDataFrame([("A", "docs/new.md"), ("M", "docs/log.md"), ("M", "docs/old.md"), ("A", "src/x.md")], "status string, path string")
    assert rows(docs.change_policy(ch)) == [("docs/new.md", "index-not-updated")]
    corpus = spark.createDataFrame([("tools/notes/ and docs/",)], "corpus string")
    assert [r.path for r in docs.strays(spark.createDataFrame([("tools/notes/a.md",), ("other/b.md",), ("docs/c.md",), ("README.md",)], "path string"), corpus).collect()] == ["other/b.md"]


def test_clarification(spark):
    m = spark.createDataFrame([(1, "Você prefere A ou B?"), (2, "> você prefere A ou B?"), (3, "Contexto: x. Você prefere A ou B?"), (4, None)], "id int, text string")
    got = {r.id: (r.signals, r.missing, r.blocked) for r in docs.clarifications(m, [("choice", r"voce prefere[^.!]{0,160}\?")], [("context", "contexto:")]).collect()}
    assert got[1] == (["choice"], ["context"], True) and got[2][2] is False and got[3] == (["choice"], [], False)


def test_route_columns(spark):
    d = spark.createDataFrame([("/a/:id/b/:x", {"id": "p q/ü!", "x": "1"}), ("/", {}), ("/t/:session_token", {})], "p string, m map<string,string>")
    got = [tuple(r) for r in d.select(routes.parameters(F.col("p")), routes.slug(F.col("p")), routes.concrete(F.col("p"), F.col("m")), routes.sensitive(F.col("p"))).collect()]
    assert got[0] == (["id", "x"], "a_id_b_x", "/a/p%20q%2F%C3%BC!/b/1", False) and got[1][1] == "home" and got[2][3] is True
    f = spark.createDataFrame([(p,) for p in ("tailwind.config.js", "src/index.css", "src/a.jsx", "tokens/color.json", "src/themes/x.css", "fonts/a.woff2", "README.md")], "p string").select("p", routes.fanout(F.col("p")).alias("r"), routes.candidate(F.col("p")).alias("c"))
    assert {r.p: (r.r, r.c) for r in f.collect()} == {"tailwind.config.js": (["tailwind-config"], True), "src/index.css": (["global-css"], True), "src/a.jsx": ([], True), "tokens/color.json": (["token-consumer"], True), "src/themes/x.css": (["theme"], True), "fonts/a.woff2": (["font"], True), "README.md": ([], False)}


def test_imports_and_impact(spark):
    files = {"src/main.jsx": 'import A from "@/pages/A";\nimport("./pages/B.jsx")', "src/pages/A/index.jsx": 'import { u } from "../../lib/u"; import "pkg"; import x from "./nope"', "src/pages/B.jsx": "import '../b.css' // import './no'", "src/lib/u.js": "export const u = require('./v')", "src/lib/v.ts": "", "src/b.css": '@import "./c.css";', "src/c.css": "", "src/lonely.js": ""}
    s = spark.createDataFrame(list(files.items()), "path string, text string")
    edges, lost = routes.import_edges(s)
    assert set(rows(edges)) == {("src/main.jsx", "src/pages/A/index.jsx"), ("src/main.jsx", "src/pages/B.jsx"), ("src/pages/A/index.jsx", "src/lib/u.js"), ("src/pages/B.jsx", "src/b.css"), ("src/lib/u.js", "src/lib/v.ts"), ("src/b.css", "src/c.css")}
    assert rows(lost) == [("src/pages/A/index.jsx", "./nope")]
    table = spark.createDataFrame([("/a", ["src/pages/A/index.jsx"]), ("/b", ["src/pages/B.jsx"])], "pattern string, modules array<string>")
    ch = lambda *xs: spark.createDataFrame([(x,) for x in xs], "file string")
    report, hit = routes.analyse(table, edges, ch("src/lib/v.ts", "src/lonely.js", "src/deleted.js", "notes.txt"), lost, s.union(spark.createDataFrame([("notes.txt", "")], "path string, text string")))
    assert {r.file: (r.status, r.routes) for r in report.collect()} == {"src/lib/v.ts": ("present", ["/a"]), "src/lonely.js": ("uncovered", []), "src/deleted.js": ("deleted", []), "notes.txt": ("unsupported", [])}
    assert rows(hit) == [("/a", 2, "import")]
    done = routes.complete(report, table, lost).first()
    assert not done.complete and routes.exit_code(done) == 4
    report, hit = routes.analyse(table, edges, ch("src/c.css"), lost, s)
    assert rows(hit) == [("/b", 2, "import")] and routes.complete(report, table, lost).first().complete
    report, hit = routes.analyse(table, edges, ch("src/main.jsx"), lost, s)
    assert rows(hit) == [("/a", 0, "shared-layout"), ("/b", 0, "shared-layout")]
    assert routes.exit_code(routes.complete(report.limit(0), table, lost).first()) == 3


def test_tree_and_registry(spark):
    nodes = spark.createDataFrame([(1, None, "/", "L", ["L"], ["PrivateRoute"]), (2, 1, "w/:id", "W", ["W"], []), (3, 2, "*", "N", ["N"], ["AdminRoute"]), (4, None, "*", "X", ["X"], []), (5, 1, "/abs/", "A", ["A"], [])], "node int, parent int, path string, module string, modules array<string>, guards array<string>")
    t = {r.pattern: r for r in routes.tree(nodes).collect()}
    assert set(t) == {"/", "/w/:id", "/w/:id/*", "*", "/abs"} and t["/w/:id/*"].modules == ["L", "N", "W"] and t["/w/:id/*"].guards == ["AdminRoute", "PrivateRoute"]
    r = spark.createDataFrame([("/", []), ("/w/:id", ["PrivateRoute"]), ("/x/:token", []), ("/y/:k", []), ("*", [])], "pattern string, guards array<string>")
    f = spark.createDataFrame([("/w/:id", "f1", "one", {"id": "1"}, "checked-in"), ("/w/:id", "f2", "env", {"id": "2"}, "environment"), ("/y/:k", "f3", "bad", {"z": "1"}, "environment")], "pattern string, fixture string, name string, params map<string,string>, source string")
    contexts, skips = routes.registry(r, f)
    assert sorted((c.name, c.path, c.fixture, c.role) for c in contexts.collect()) == [("home", "/", "anonymous-static-v1", "anonymous"), ("not_found", "/__visual-404__", "anonymous-not-found-v1", "anonymous"), ("one", "/w/1", "f1", "authenticated")]
    assert sorted((s.pattern, s.reason, s.missing) for s in skips.collect()) == [("/x/:token", "sensitive-ephemeral-fixture", ["token"]), ("/y/:k", "invalid-fixture", ["k"])]
    assert rows(routes.registry_faults(contexts, skips, r)) == []
    assert rows(routes.registry_faults(contexts.unionAll(contexts.where("name = 'one'")), skips.limit(0), r)) != []


def test_network_fixtures(spark):
    d = spark.createDataFrame([("a", ["src/x"], [("GET", "/api/x", 200)]), ("a", ["../x"], [("POST", "/api/:y?q", 300)]), ("b", [], [("GET", "/api/z", 200), ("GET", "/api/z", 204)])], "id string, contractSources array<string>, responses array<struct<method: string, path: string, status: int>>")
    assert rows(routes.fixture_faults(d)) == [("a", "duplicate-id"), ("a", "not-read-only"), ("a", "path-not-concrete"), ("a", "source-outside"), ("a", "status"), ("b", "duplicate-response")]
