"""Gates over documents: links, stale citations, wiki rules, decision messages."""

from __future__ import annotations

import posixpath

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators.sets import first_by, union


def fenced(lines: DataFrame) -> DataFrame:
    """lines (path, line, content) with ``code``: within a fence, its markers included."""
    mark = F.col("content").rlike(r"^\s*(```|~~~)")
    upto = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("code", mark | (F.sum(mark.cast("int")).over(upto) % 2 == 1))


def _resolved(folder: str, target: str) -> list[str]:
    """The path a link can mean: from its folder, or from the root."""
    return [posixpath.normpath(posixpath.join(folder, target)).lstrip("/"), posixpath.normpath(target.lstrip("/"))]


def link_targets(docs: DataFrame) -> DataFrame:
    """(path, line, target, c1, c2) of Markdown links outside code: no fragments, no URLs, no placeholders; percent signs decoded, plus signs kept."""
    own = fenced(T.lines(docs)).where(~F.col("code"))
    raw = own.select("path", "line", F.explode(F.regexp_extract_all("content", F.lit(r"\]\(\s*([^)\s]+)"), F.lit(1))).alias("raw"))
    target = F.split("raw", "#")[0]
    kept = raw.withColumn("target", target).where((F.col("target") != "") & ~F.col("target").rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:|[{}<>*]|^//"))
    decoded = kept.withColumn("decoded", F.coalesce(F.try_url_decode(F.regexp_replace("target", r"\+", "%2B")), F.col("target")))

    def both(paths: pa.Array, targets: pa.Array) -> pa.Array:
        return pa.array([_resolved(posixpath.dirname(p), t) for p, t in zip(paths.to_pylist(), targets.to_pylist(), strict=True)], pa.list_(pa.string()))

    return decoded.withColumn("cs", F.arrow_udf(both, "array<string>")("path", "decoded")).select("path", "line", "target", F.col("cs")[0].alias("c1"), F.col("cs")[1].alias("c2"))


def broken_links(docs: DataFrame, paths: DataFrame) -> DataFrame:
    """(check, path, line, target) of links to nothing among the known paths (path) and their folders."""
    links = link_targets(docs).withColumn("id", F.struct("path", "line", "target"))
    known = paths.select(F.col("path").alias("c"))
    parts = F.split("path", "/")
    folders = paths.where(F.col("path").contains("/")).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("c"))
    hit = links.select("id", F.explode(F.array("c1", "c2")).alias("c")).join(known.unionAll(folders).distinct(), "c", "left_semi").select("id").distinct()
    return links.join(hit, "id", "left_anti").select(F.lit("broken-link").alias("check"), "path", "line", "target").distinct()


def stale_citations(docs: DataFrame, gone: DataFrame, paths: DataFrame, *, exempt: str = r"(^|/)(_arquivo|archive|log\.md)") -> DataFrame:
    """(check, path, line, old, new, snippet) of lines that cite a removed or renamed path (old, new), once for each line and path.

    A line's own path-like words are looked up among the removed ones, so that the join is by equality; citations that still resolve to
    a known path don't count.
    """
    words = T.lines(docs.where(~F.col("path").rlike(exempt))).select("path", "line", "content", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"[A-Za-z0-9_@.][A-Za-z0-9_@./-]*[A-Za-z0-9_]"), F.lit(0)))).alias("old"))
    hits = words.withColumn("old", F.regexp_replace("old", r"^(\./|\.\./)+", "")).join(gone, "old").join(paths.select(F.col("path").alias("old")), "old", "left_anti")
    return hits.select(F.lit("stale-citation").alias("check"), "path", "line", "old", "new", T.snippet(F.col("content")).alias("snippet")).dropDuplicates(["path", "line", "old"])


def integrity(docs: DataFrame, gone: DataFrame, paths: DataFrame) -> DataFrame:
    """All findings, each (path, line, term) once, citations before links."""
    every = union(stale_citations(docs, gone, paths).withColumn("ord", F.lit(0)), broken_links(docs, paths).withColumn("ord", F.lit(1)))
    return first_by(every.withColumn("term", F.coalesce("old", "target")), ["path", "line", "term"], F.col("ord")).drop("ord")


_GENERIC = ("_arquivo", "assets", "docs", "images", "img", "reports", "sources")
_STRUCTURAL = r"(^|/)(index|log|SCHEMA|README)\.md$"


def orphans(files: DataFrame, corpus: DataFrame) -> DataFrame:
    """(rule, severity, path) of files that no index mentions, by path or name, nor covers by one of their folders but the generic ones.
    corpus: the one row of all indexes' text."""
    own = files.select("path").distinct().where(~F.col("path").rlike(_STRUCTURAL)).crossJoin(corpus)
    name = F.element_at(F.split("path", "/"), -1)
    parts = F.split("path", "/")
    folders = F.when(F.size(parts) > 2, F.transform(F.sequence(F.lit(2), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).otherwise(F.array().cast("array<string>"))

    def covers(a):
        leaf = F.element_at(F.split(a, "/"), -1)
        return ~leaf.isin(*_GENERIC) & (F.col("corpus").contains(a) | F.col("corpus").contains(F.concat(leaf, F.lit("/"))) | F.col("corpus").contains(F.concat(F.lit("`"), leaf, F.lit("`"))))

    there = F.col("corpus").contains(F.col("path")) | F.col("corpus").contains(name) | F.exists(folders, covers)
    return own.where(~there).select(F.lit("orphan").alias("rule"), F.lit("FAIL").alias("severity"), "path")


def log_faults(docs: DataFrame) -> DataFrame:
    """(rule, severity, path, line, detail) of logs: headings off the form, dates out of order; an undated entry starts anew."""
    logs = docs.where(F.col("path").rlike(r"(^|/)log\.md$"))
    heads = T.lines(logs).where(F.col("content").startswith("## "))
    ok = F.col("content").rlike(r"^## \[(\d{4}-\d{2}-\d{2}|sem-data)\] [^·]+ · .+")
    form = heads.where(~ok).select(F.lit("log-form").alias("rule"), F.lit("FAIL").alias("severity"), "path", "line", F.col("content").alias("detail"))
    date = F.regexp_extract("content", r"^## \[([^\]]+)\]", 1)
    undated = date == "sem-data"
    by = Window.partitionBy("path").orderBy("line")
    # Entries after an undated one form a part of their own.
    dated = heads.where(ok).withColumn("date", date).withColumn("part", F.sum(undated.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0))).where("date != 'sem-data'")
    before = F.lag("date").over(Window.partitionBy("path", "part").orderBy("line"))
    order = dated.withColumn("before", before).where("date > before").select(F.lit("log-order").alias("rule"), F.lit("FAIL").alias("severity"), "path", "line", F.concat_ws(" after ", "date", "before").alias("detail"))
    empty = logs.select("path").distinct().join(heads.select("path"), "path", "left_anti").select(F.lit("log-empty").alias("rule"), F.lit("FAIL").alias("severity"), "path")
    return union(form, order, empty)


def wiki(docs: DataFrame, files: DataFrame, *, strict: bool = False) -> DataFrame:
    """(rule, severity, path, line, detail) of all wiki rules (R12, F21, F32, X18). docs: (path, text) of Markdown; files: (path) of everything."""
    from weftline.sources.files import index_corpus

    names = files.select("path").distinct().where(~T.shape_name(F.element_at(F.split("path", "/"), -1))).select(F.lit("name").alias("rule"), F.lit("FAIL" if strict else "WARN").alias("severity"), "path")
    tags = T.lines(docs).where(F.col("content").rlike(r"^\s*</(?:content|invoke|antml:[a-z]+)>\s*$")).select(F.lit("stray-tag").alias("rule"), F.lit("FAIL").alias("severity"), "path", "line", F.col("content").alias("detail"))
    live = T.matches(docs.where(F.col("path").rlike(r"(^|/)index\.md$")), "text", r"\]\(([^)]+)\)", 1, name="detail").where(F.split("detail", "#")[0].contains("_arquivo/")).select(F.lit("archived-link").alias("rule"), F.lit("WARN").alias("severity"), "path", "detail")
    front = docs.where(T.updated(F.col("text")) == "").select(F.lit("updated").alias("rule"), F.lit("FAIL").alias("severity"), "path")
    return union(orphans(files, index_corpus(docs)), log_faults(docs), names, tags, live, front)


def change_policy(changes: DataFrame, *, root: str = "docs/") -> DataFrame:
    """(path, rule) of added, removed or renamed documents in a change set (status, path) without a changed log or index."""
    own = changes.where(F.col("path").startswith(root))
    flags = own.agg(F.coalesce(F.bool_or(F.col("path").rlike(r"(^|/)log\.md$")), F.lit(False)).alias("log"), F.coalesce(F.bool_or(F.col("path").rlike(r"(^|/)index\.md$")), F.lit(False)).alias("index"))
    bad = own.where(F.col("status").rlike("^[ADR]") & F.col("path").endswith(".md") & ~F.col("path").rlike(_STRUCTURAL)).crossJoin(flags)
    lacking = F.array_compact(F.array(F.when(~F.col("log"), F.lit("log-not-updated")), F.when(~F.col("index"), F.lit("index-not-updated"))))
    return bad.select("path", F.explode(lacking).alias("rule"))


def strays(files: DataFrame, corpus: DataFrame, *, root: str = "docs/") -> DataFrame:
    """(rule, severity, path) of Markdown outside the wiki that no index mentions exactly or by a folder with a slash."""
    out = files.select("path").distinct().where(F.col("path").endswith(".md") & ~F.col("path").startswith(root) & ~F.col("path").rlike(r"^[A-Z_]+\.md$|(^|/)(README|SKILL|CLAUDE|AGENTS)\.md$|(^|/)(node_modules|vendor|dist|build|out|target|__pycache__|fixtures)/"))
    parts = F.split("path", "/")
    folders = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.lit("/")))).otherwise(F.array().cast("array<string>"))
    own = out.crossJoin(corpus)
    return own.where(~(F.col("corpus").contains(F.col("path")) | F.exists(folders, lambda a: F.col("corpus").contains(a)))).select(F.lit("stray").alias("rule"), F.lit("WARN").alias("severity"), "path")


def clarifications(messages: DataFrame, signals: list[tuple[str, str]], required: list[tuple[str, str]], *, asks: str = "choice") -> DataFrame:
    """(id, signals, missing, blocked): what each message (id, text) signals, and which required elements of a decision block it lacks (R14,
    F22, F23). Patterns read text without accents, code and quotes, in lower case; a message that asks for a choice and lacks some is blocked."""
    bare = T.folded(T.without_code(F.col("text")))
    own = messages.withColumn("_b", bare)
    seen = F.array_compact(F.array(*(F.when(F.col("_b").rlike(rx), F.lit(k)) for k, rx in signals)))
    lacks = F.array_compact(F.array(*(F.when(~F.col("_b").rlike(rx), F.lit(k)) for k, rx in required)))
    return own.select("id", seen.alias("signals"), lacks.alias("missing")).withColumn("blocked", F.array_contains("signals", asks) & (F.size("missing") > 0))


def archived(path: Column, fronts: tuple[str, ...] = (), inside: tuple[str, ...] = ("/_arquivo/", "/archive/")) -> Column:
    """Whether a path is archaeology, where not even links need to lead anywhere."""
    own = F.translate(path, "\\", "/")
    tests = [own.startswith(f) for f in fronts] + [own.contains(t) for t in inside]
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def historical(path: Column, **kw) -> Column:
    """Whether a path is a dated record, in which old names are legitimate but links must hold."""
    own = F.translate(path, "\\", "/")
    return archived(path, **kw) | own.rlike(r"^docs/(adr|auditorias|qa-evidence)/") | own.rlike(r"(^|/)log\.md$")


def checked_extension(path: Column, extensions: tuple[str, ...]) -> Column:
    """Whether a file's extension is looked at; .snyk has none of its own but is."""
    base = F.element_at(F.split(path, "/"), -1)
    suffix = F.regexp_extract(base, r"^.+(\.[^.]*)$", 1)
    return base.endswith(".snyk") | suffix.isin(*extensions)
