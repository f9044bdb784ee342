import subprocess

import pytest

from weftline.sources import config, files, git, sinks


@pytest.fixture
def tree(tmp_path):
    for path, text in {"a.jsx": "x", "d/b.tsx": "y", "node_modules/c.jsx": "z", "d/e+f g.css": ":root { --a: 1; /* --b: 2; */ } [t] { --a: var(--c) }", "index.md": "top", "d/index.md": "deep", "d/x.png": "p", "d/x.meta.json": "{}", "d/y.png": "p", "d/z.meta.json": "{}"}.items():
        (tmp_path / "t" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / path).write_text(text)
    return str(tmp_path / "t")


def test_trees(spark, tree):
    assert sorted(r.path for r in files.texts(spark, tree, (".jsx", ".tsx"), skip_dirs=("node_modules",)).collect()) == ["a.jsx", "d/b.tsx"]
    assert sorted(r.path for r in files.texts(spark, tree, (".jsx",), deny=("node_",)).collect()) == ["a.jsx"]
    assert files.texts(spark, tree + "/none").count() == 0
    inv = files.inventory(spark, tree)
    assert "d/e+f g.css" in {r.path for r in inv.collect()}
    assert len(files.fingerprint(inv)) == 64
    with pytest.raises(ValueError):
        files.fingerprint(inv.limit(0))
    assert {r.stem: r.status for r in files.captures(inv).collect()} == {"d/x": "ok", "d/y": "missing-metadata", "d/z": "orphan"}
    assert files.index_corpus(files.texts(spark, tree, (".md",))).first().corpus == "deep\ntop\ntop"


def test_style_sheets(spark, tree):
    d = files.declarations(files.style_sheets(spark, [tree + "/d/e+f g.css", tree + "/gone.css"]), {"dark": ":root", "light": r"\[t\]"})
    assert sorted((r.theme, r.name, r.value) for r in d.collect()) == [("dark", "a", "1"), ("light", "a", "var(--c)")]
    c = spark.createDataFrame([("server", "small"), ("dist", "bb"), ("dist", "cccc")], "kind string, text string")
    assert files.emitted_css(c) == "cccc" and files.emitted_css(c.limit(1)) is None


def test_documents(spark):
    t = files.token_document(spark, {"$m": 1, "semantic": {"$d": 1, "dark": {"surface": {"$root": {"$value": "#fff"}, "deep": {"$value": "#000"}}}, "light": {"surface": {}}}})
    assert sorted((r.theme, r.theme_ord, r.grp, "/".join(r.path), r.value) for r in t.collect()) == [("dark", 0, "surface", "surface/$root", "#fff"), ("dark", 0, "surface", "surface/deep", "#000"), ("light", 1, "surface", "surface", None)]
    doc = spark.createDataFrame([("`no` ### 4.1 Owners `page` `nav-item` `X` ### 4.2 `no`",)], "text string")
    assert sorted(r.owner for r in files.vocabulary(doc, "### 4.1 Owners", "### 4.2").collect()) == ["nav-item", "page"]
    with pytest.raises(Exception, match="no heading"):
        files.vocabulary(doc, "### 9", "### 4.2").collect()
    assert files.flatten({"a": {"b": 1, "c": {"d": 2}}}) == {"a-b": "1", "a-c-d": "2"}
    allow = files.allowlist(spark.createDataFrame([("# c",), ("a/* # x",), ("",)], "value string"))
    assert [r.pattern for r in allow.collect()] == ["a/*"]
    lines = spark.createDataFrame([(1, '{"role":"user","content":"q"}'), (2, "broken"), (3, '{"message":{"role":"assistant","content":"[{\\"type\\":\\"text\\",\\"text\\":\\"a\\"},{\\"type\\":\\"tool\\"}]"}}'), (4, '{"role":"assistant","content":"b"}')], "line int, value string")
    assert [(r.line, r.text) for r in files.transcript_tail(lines).orderBy("line").collect()] == [(3, "a"), (4, "b")] and files.transcript_tail(lines, most=1).count() == 1


def test_config():
    c = config.load("A=1 # x\nB='${A} #'\nC=\"${A}-${E}\"\n# D=4\nexport F = ${C}", {"E": "env"})
    assert c == {"A": "1", "B": "${A} #", "C": "1-env", "F": "1-env"}
    own = config.Config(c | {"L": "a, b,,", "N": "x", "Y": "Yes"}, {"Z": "z"})
    assert own.csv("L") == ["a", "b"] and own.integer("N", 7) == 7 and own.boolean("Y") and own.get("Z") == "z" and own.get("Q", "d") == "d"
    assert config.allowed_environment({"A": "1", "S": "2"}, ("A",)) == {"A": "1"}


def test_sinks(spark, tmp_path):
    counts = spark.createDataFrame([("b", 2), ("a", 1)], "dim string, value bigint")
    for form in ("json", "text"):
        sinks.write_baseline(counts, str(tmp_path / form), form=form)
        assert sorted(map(tuple, sinks.read_baseline(spark, str(tmp_path / form)).collect())) == [("a", 1), ("b", 2)]
    assert sinks.read_baseline(spark, str(tmp_path / "none")) is None
    sinks.promote(counts, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    with pytest.raises(FileExistsError):
        sinks.promote(counts, str(tmp_path / "out"))
    with pytest.raises(ValueError):
        sinks.promote(counts, str(tmp_path / "bad"), check=lambda df: False)
    assert not list(tmp_path.glob("*staging*"))
    assert sinks.stale(counts, counts.where("dim = 'a'")).count() == 1
    table, code = sinks.outcome(counts.orderBy("dim"), {"exit_code": 1}, most=1)
    assert code == 1 and table.endswith("...")
    src = spark.createDataFrame([("x.jsx", '<a className="q p"/><b className="p"/>')], "path string, text string")
    r = sinks.codemod(src, {"p q": "Box"}).first()
    assert (r.after, r.sites) == ('<a className={Box}/><b className="p"/>', 1)
    back = sinks.reverse_codemod(src.select("path").crossJoin(spark.createDataFrame([(r.after,)], "text string")), {"Box": "p q"}).first()
    assert back.after == '<a className="p q"/><b className="p"/>' and back.sites == 1
    f = lambda *xs: spark.createDataFrame(list(xs), "name string, n int")
    assert [tuple(x) for x in sinks.tally_faults(f(("a", 1), ("b", 2)), f(("a", 1), ("b", 3))).collect()] == [("b", 2, 3)]
    assert "## k" in sinks.report(spark.createDataFrame([("k", "same")], "key string, state string"), "T")


def test_git_feeds(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=x", "-c", "user.email=x@x", *a], check=True, capture_output=True)
    run("init", "-q")
    for n in ("old.md", "gone.md", "same.md"):
        (tmp_path / n).write_text(f"{n} has a text long enough to be followed\n" * 5)
    run("add", "-A")
    run("commit", "-qm", "a")
    (tmp_path / "old.md").rename(tmp_path / "new name.md")
    (tmp_path / "gone.md").unlink()
    (tmp_path / "extra.md").write_text("x")
    run("add", "new name.md", "old.md")
    run("rm", "-q", "--cached", "gone.md")
    got = {(r.status, r.old, r.new) for r in git.feed(spark, str(tmp_path), "worktree").collect()}
    assert got == {("R", "old.md", "new name.md"), ("D", "gone.md", None), ("A", None, "extra.md")}
    assert {r.new for r in git.feed(spark, str(tmp_path)).collect()} == {"new name.md", "same.md"}
    assert git.feed(spark, str(tmp_path), "show", path="none.md").first().content is None
    assert git.feed(spark, str(tmp_path), "show", path="same.md").first().content.startswith("same.md has")
