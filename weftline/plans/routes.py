"""Routes, imports and the visual registry."""

from __future__ import annotations

import posixpath
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import blank_comments
from weftline.operators.graphs import impact, inherited, reach_each, reverse
from weftline.operators.sets import declared

EXTENSIONS = (".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".css", ".scss", ".sass", ".less", ".json")
_DESIGN = r"(?i)\.([cm]?[jt]sx?|css|scss|sass|less|json|svg|png|jpe?g|webp|gif|woff2?|ttf|otf)$"


def parameters(pattern: Column, *, ordered: bool = True) -> Column:
    """The parameters of a route pattern: in order and once each, or as they stand (P20)."""
    own = F.regexp_extract_all(pattern, F.lit(":([A-Za-z0-9_]+)"), F.lit(1))
    return F.array_sort(F.array_distinct(own)) if ordered else own


def sensitive(pattern: Column) -> Column:
    """Whether a parameter's name is one of those whose values can't be kept."""
    return F.exists(parameters(pattern), lambda p: p.rlike("(?i)(^|_)(code|credential|password|secret|session|token)($|_)"))


def slug(path: Column) -> Column:
    """A route's name from its path."""
    own = F.regexp_replace(F.regexp_replace(path, "^/", ""), ":([A-Za-z0-9_]+)", "$1")
    own = F.regexp_replace(F.regexp_replace(F.replace(own, F.lit("*"), F.lit("wildcard")), "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(path == "/", "home").otherwise(F.lower(own))


def encoded(value: Column) -> Column:
    """A value as a URL's part, blanks as %20, and signs as browsers leave them."""
    own = F.replace(F.url_encode(value), F.lit("+"), F.lit("%20"))
    for sign, code in (("!", "%21"), ("'", "%27"), ("(", "%28"), (")", "%29"), ("~", "%7E")):
        own = F.replace(own, F.lit(code), F.lit(sign))
    return own


def concrete(pattern: Column, params: Column) -> Column:
    """A pattern with its parameters' values, segment by segment."""
    segment = lambda s: F.when(s.startswith(":"), encoded(F.element_at(params, F.substring(s, 2, 1 << 20)))).otherwise(s)
    return F.array_join(F.transform(F.split(pattern, "/"), segment), "/")


def auth_role(guards: Column) -> Column:
    """The role that the strictest guard asks for."""
    out = F.lit("anonymous")
    for guard, role in (("PrivateRoute", "authenticated"), ("SingleUserRoute", "single-user"), ("ManagerRoute", "manager"), ("AdminRoute", "admin")):
        out = F.when(F.array_contains(guards, guard), role).otherwise(out)
    return out


def fanout(path: Column) -> Column:
    """Why a change of a file touches every route, in order; empty if it doesn't."""
    config = path.rlike(r"^tailwind\.config\.|^(postcss|vite)\.config\.|^jsconfig\.json$|^tsconfig(\.[^.]+)?\.json$|^components\.json$")
    rules = (
        F.when(config, F.when(path.startswith("tailwind"), "tailwind-config").otherwise("shared-layout")),
        F.when(path.rlike(r"(?i)^tokens/|(^|/)(design-)?tokens?(/|\.|-)"), "token-consumer"),
        F.when(path.rlike(r"(?i)^src/index\.css$|^src/styles/(generated/|globals?\.|themes?/)"), "global-css"),
        F.when(path.rlike(r"(?i)(^|/)themes?(/|\.|-)"), "theme"),
        F.when(path.rlike(r"(?i)\.(woff2?|ttf|otf)$"), "font"),
    )
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*rules))))


def candidate(path: Column) -> Column:
    """Whether a changed file is looked at (F16)."""
    return (path.startswith("src/") & path.rlike(_DESIGN)) | (F.size(fanout(path)) > 0)


def stable_url(url: Column) -> Column:
    """Origin and path."""
    return F.concat(F.try_parse_url(url, F.lit("PROTOCOL")), F.lit("://"), F.try_parse_url(url, F.lit("AUTHORITY")), F.coalesce(F.nullif(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.lit("/")))


_MODULE = re.compile(r"(?:^|[\s;}])(?:import|export)\s(?:[^'\"`;]*?\sfrom\s*)?[\"']([^\"']+)[\"']|(?:^|[\s;}])import\s*[\"']([^\"']+)[\"']|\b(?:import|require)\s*\(\s*[\"']([^\"']+)[\"']", re.M)
_CSS = re.compile(r"@(?:import|use|forward)\s+(?:url\(\s*)?[\"']?([^\"')\s;]+)", re.M)
_BIND = re.compile(r"import\s+(?:([A-Za-z_$][\w$]*)\s*,?\s*)?(?:\{([^}]*)\}|\*\s+as\s+([A-Za-z_$][\w$]*))?\s*from\s*[\"']([^\"']+)[\"']")
_LAZY = re.compile(r"const\s+([A-Za-z_$][\w$]*)\s*=\s*(?:React\.)?lazy\(\s*\(\)\s*=>\s*import\(\s*[\"']([^\"']+)[\"']")


def specifiers(path: str, text: str) -> list[str]:
    """What a module or style sheet imports."""
    bare = blank_comments(text)
    found = _CSS.findall(bare) if re.search(r"\.(css|scss|sass|less)$", path) else [next(x for x in m if x) for m in _MODULE.findall(bare)]
    return sorted(set(found))


def bindings(text: str) -> dict[str, str]:
    """Local names and what they are imported from, lazy ones too."""
    out: dict[str, str] = {}
    for default, named, star, spec in _BIND.findall(blank_comments(text)):
        for name in [default, star, *(re.split(r"\sas\s", x.strip())[-1].strip() for x in named.split(","))]:
            if name:
                out[name] = spec
    return out | dict(_LAZY.findall(blank_comments(text)))


def resolution_base(importer: str, spec: str, aliases: dict[str, str]) -> str | None:
    """The path that a specifier names, without what may be left out (G02): the longest alias, else relative. Packages name none."""
    alias = max((a for a in aliases if spec == a or spec.startswith(a)), key=len, default=None)
    if alias is not None:
        base = aliases[alias] + spec[len(alias) :]
    elif spec.startswith((".", "/")):
        base = posixpath.join(posixpath.dirname(importer), spec) if spec.startswith(".") else spec.lstrip("/")
    else:
        return None
    return posixpath.normpath(base.split("?")[0])


#: What a specifier may leave out, in order: nothing, extensions, index files.
_LEFT_OUT = ("", *EXTENSIONS, *(f"/index{e}" for e in EXTENSIONS))


def resolution_candidates(importer: str, spec: str, aliases: dict[str, str]) -> list[str]:
    """The paths that a specifier can mean, in order."""
    base = resolution_base(importer, spec, aliases)
    return [] if base is None else [base + e for e in _LEFT_OUT]


def import_edges(source: DataFrame, aliases: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges (src, dst) of the import graph, and unresolved local imports (importer, specifier) (G03). source: (path, text).

    Files list the few bases that could mean them, rather than each specifier all its candidates.
    """
    own_aliases = aliases or {"@/": "src/"}
    kind = "array<struct<spec: string, base: string>>"
    shape = pa.list_(pa.struct([("spec", pa.string()), ("base", pa.string())]))

    def run(paths: pa.Array, texts: pa.Array) -> pa.Array:
        return pa.array([[{"spec": s, "base": resolution_base(p, s, own_aliases)} for s in specifiers(p, t or "")] for p, t in zip(paths.to_pylist(), texts.to_pylist(), strict=True)], shape)

    code = source.where(F.col("path").rlike(r"(?i)\.([cm]?[jt]sx?|css|scss|sass|less)$"))
    specs = code.select(F.col("path").alias("src"), F.explode(F.arrow_udf(run, kind)("path", "text")).alias("x")).select("src", F.col("x.spec").alias("specifier"), "x.base").where("base is not null")
    cut = lambda e: F.expr(f"left(path, length(path) - {len(e)})")
    named = F.array_compact(F.array(*(F.when(F.col("path").endswith(e), F.struct(F.lit(i).alias("ord"), cut(e).alias("base"))) for i, e in enumerate(_LEFT_OUT))))
    files = source.select("path", F.explode(named).alias("x")).groupBy("x.base").agg(F.min_by("path", "x.ord").alias("dst"))
    best = specs.join(files, "base", "left")
    return best.where("dst is not null").select("src", "dst").distinct(), best.where("dst is null").select(F.col("src").alias("importer"), "specifier")


def merged(definitions: DataFrame) -> DataFrame:
    """Routes by pattern (A11): sorted unions of modules and guards, definitions in order, the last own module. definitions: (ord, pattern, module, modules, guards)."""
    return definitions.groupBy("pattern").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("modules")))).alias("modules"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("guards")))).alias("guards"), F.max_by("module", "ord").alias("module"), F.count("*").alias("definitions"))


def kind(pattern: Column) -> Column:
    return F.when(pattern.contains("*"), "wildcard").when(F.size(parameters(pattern)) > 0, "dynamic").otherwise("static")


def analyse(routes: DataFrame, edges: DataFrame, changed: DataFrame, unresolved: DataFrame, files: DataFrame, *, router: str = "src/main.jsx") -> tuple[DataFrame, DataFrame]:
    """Changed files (file, status, reasons, routes) and affected routes (pattern, hops, reason).

    routes: (pattern, modules); changed: (file); unresolved: (importer, specifier); files: (path) that exist. A deleted file is reported
    and not followed. status: deleted, unsupported, global, uncovered or present.
    """
    own = changed.select("file").distinct().join(files.select(F.col("path").alias("file"), F.lit(True).alias("there")).distinct(), "file", "left").withColumn("reasons", fanout(F.col("file")))
    own = own.withColumn("reasons", F.when((F.size("reasons") == 0) & (F.col("file") == router), F.array(F.lit("shared-layout"))).otherwise(F.col("reasons")))
    status = F.when(F.col("there").isNull(), "deleted").when(~F.col("file").rlike(_DESIGN), "unsupported").when(F.size("reasons") > 0, "global").otherwise("local")
    own = own.withColumn("status", status).drop("there")
    modules = routes.select("pattern", F.explode("modules").alias("node"))
    near = reach_each(reverse(edges), own.where("status = 'local'").select(F.col("file").alias("node"))).withColumnRenamed("start", "file")
    parts = modules.join(near, "node").groupBy("file", "pattern").agg(F.min("hops").alias("hops"))
    listed = parts.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("hops", "pattern"))), lambda x: x["pattern"]).alias("routes"))
    every = routes.agg(F.array_sort(F.collect_set("pattern")).alias("all"))
    report = own.join(listed, "file", "left").crossJoin(every)
    report = report.select("file", F.when((F.col("status") == "local") & F.col("routes").isNull(), "uncovered").when(F.col("status") == "local", "present").otherwise(F.col("status")).alias("status"), "reasons", F.when(F.col("status") == "global", F.col("all")).otherwise(F.coalesce("routes", F.array().cast("array<string>"))).alias("routes"))
    reasons = own.where("status = 'global'").select(F.col("file").alias("node"), F.explode("reasons").alias("reason"))
    starts = own.where("status in ('local', 'global')").select(F.col("file").alias("node"))
    return report, impact(routes, edges, starts, reasons)


def complete(report: DataFrame, routes: DataFrame, unresolved: DataFrame, declaration_errors: int = 0) -> DataFrame:
    """One row: whether the impact of a change set is known in full; seven conditions."""
    bad = unresolved.join(report.select(F.col("file").alias("importer")), "importer", "left_semi").agg(F.count("*").alias("imports"))
    gaps = routes.agg(F.count_if(F.size("modules") == 0).alias("modules"))
    own = report.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "deleted").alias("deleted"), F.count_if(F.col("status") == "unsupported").alias("unsupported"), F.count_if(F.col("status") == "uncovered").alias("uncovered"))
    return own.crossJoin(bad).crossJoin(gaps).withColumn("complete", (F.col("n") > 0) & (F.col("deleted") + F.col("unsupported") + F.col("uncovered") + F.col("imports") + F.col("modules") == 0) & F.lit(declaration_errors == 0))


def exit_code(done: dict) -> int:
    """3 without changed files, 4 where the impact isn't known in full, else 0."""
    return 3 if not done["n"] else 0 if done["complete"] else 4


def registry(routes: DataFrame, fixtures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contexts (name, pattern, path, params, fixture, role, kind) and skips (pattern, reason, missing) of routes (pattern, guards).

    fixtures: (pattern, fixture, name, params map, source) where checked-in ones go before the environment's. A wildcard gives the not-found
    page, a sensitive parameter skips the route, a fixture must have just the route's parameters, and names and paths must be unique.
    """
    own = routes.select("pattern", auth_role(F.col("guards")).alias("role"), kind(F.col("pattern")).alias("kind"), parameters(F.col("pattern")).alias("needs"))
    none = F.create_map().cast("map<string,string>")
    wild = own.where("kind = 'wildcard'").select(F.lit("not_found").alias("name"), "pattern", F.lit("/__visual-404__").alias("path"), none.alias("params"), F.lit("anonymous-not-found-v1").alias("fixture"), "role", "kind")
    rest = own.where("kind != 'wildcard'").withColumn("secret", sensitive(F.col("pattern")))
    static = rest.where("not secret and kind = 'static'").select(slug(F.col("pattern")).alias("name"), "pattern", F.col("pattern").alias("path"), none.alias("params"), F.when(F.col("role") == "anonymous", "anonymous-static-v1").otherwise(F.concat("role", F.lit("-session-v1"))).alias("fixture"), "role", "kind")
    order = F.when(F.col("source") == "checked-in", 0).otherwise(1)
    ranked = fixtures.withColumn("rank", order)
    chosen = ranked.join(ranked.groupBy("pattern").agg(F.min("rank").alias("rank")), ["pattern", "rank"])
    dynamic = rest.where("not secret and kind = 'dynamic'").join(chosen, "pattern", "left")
    fits = F.coalesce(F.array_sort(F.map_keys("params")) == F.col("needs"), F.lit(False))
    made = dynamic.where(fits).select("name", "pattern", concrete(F.col("pattern"), F.col("params")).alias("path"), "params", "fixture", "role", "kind")
    lacking = dynamic.where(~fits).select("pattern", F.when(F.col("fixture").isNull(), "missing-read-only-fixture").otherwise("invalid-fixture").alias("reason"), F.array_except("needs", F.coalesce(F.map_keys("params"), F.array().cast("array<string>"))).alias("missing"))
    skips = rest.where("secret").select("pattern", F.lit("sensitive-ephemeral-fixture").alias("reason"), F.col("needs").alias("missing")).unionByName(lacking)
    return wild.unionByName(static).unionByName(made), skips


def registry_faults(contexts: DataFrame, skips: DataFrame, routes: DataFrame) -> DataFrame:
    """(what, fault) of a registry: repeated names or paths, patterns neither made nor skipped, or unknown."""
    repeated = [contexts.groupBy(c).count().where("count > 1").select(F.col(c).alias("what"), F.lit(f"duplicate-{c}").alias("fault")) for c in ("name", "path")]
    return repeated[0].unionByName(repeated[1]).unionByName(declared(contexts, skips, routes).select(F.col("pattern").alias("what"), "fault"))


def fixture_faults(fixtures: DataFrame) -> DataFrame:
    """(id, fault) of a network-fixture registry (F26, F31): repeated ids, not GET, path not concrete under /api/, status not 2xx, a method and path
    twice, sources outside the root. fixtures: (id, contractSources, responses array of (method, path, status))."""
    own = fixtures.select("id", "contractSources", F.explode_outer("responses").alias("r"))
    rules = F.array_compact(F.array(F.when(F.col("r").isNull(), F.lit("no-response")), F.when(F.col("r.method") != "GET", F.lit("not-read-only")), F.when(~F.col("r.path").rlike("^/api/[^?:*#]+$"), F.lit("path-not-concrete")), F.when(~F.col("r.status").between(200, 299), F.lit("status")), F.when(F.exists("contractSources", lambda p: p.startswith("/") | F.array_contains(F.split(p, "/"), "..")), F.lit("source-outside"))))
    each = own.select("id", F.explode(rules).alias("fault")).distinct()
    twice = fixtures.groupBy("id").count().where("count > 1").select("id", F.lit("duplicate-id").alias("fault"))
    answers = own.where("r is not null").groupBy("id", "r.method", "r.path").count().where("count > 1").select("id", F.lit("duplicate-response").alias("fault"))
    return each.union(twice).union(answers.distinct())


def unmatched_requests(requests: DataFrame, allowed: DataFrame) -> DataFrame:
    """Requests (route, method, path) that change something and aren't among the allowed reads."""
    return requests.where(~F.upper("method").isin("GET", "HEAD", "OPTIONS")).join(allowed, ["route", "method", "path"], "left_anti")


def discovered(requested: DataFrame, first: DataFrame) -> DataFrame:
    """(field, value, source): the requested value where it was verified, else the first found."""
    own = requested.where("verified").select("field", F.col("value").alias("r")).join(first.select("field", F.col("value").alias("f")), "field", "full")
    return own.select("field", F.coalesce("r", "f").alias("value"), F.when(F.col("r").isNotNull(), "requested").otherwise("first").alias("source"))


def tree(nodes: DataFrame) -> DataFrame:
    """Routes of a nested tree, merged by pattern (G06, A11). nodes: (node, parent, path, module, modules, guards)."""
    down = inherited(nodes.select("node", "parent", "path", "modules", "guards"))
    return merged(down.join(nodes.select("node", "module"), "node").select(F.col("node").alias("ord"), "pattern", "module", "modules", "guards"))


def scenarios(contexts: DataFrame, readiness: DataFrame, transports: DataFrame, errors: DataFrame) -> DataFrame:
    """A scenario for each context (J16): its id, route, what shows that it is ready, reads that are sent as writes, and the error that is
    expected to show. readiness: (pattern, witness, assertion); transports: (pattern, method, path); errors: (pattern, selector)."""
    reads = transports.groupBy("pattern").agg(F.array_sort(F.collect_set(F.struct("method", "path"))).alias("reads"))
    own = contexts.join(readiness, "pattern", "left").join(reads, "pattern", "left").join(errors, "pattern", "left")
    none = F.array().cast("array<struct<method: string, path: string>>")
    return own.select(F.concat("name", F.lit("/default")).alias("scenarioId"), F.col("path").alias("route"), "pattern", "params", "fixture", "role", "witness", F.array_compact(F.array(F.lit("loaded"), F.col("assertion"))).alias("assertions"), F.coalesce("reads", none).alias("reads"), F.col("selector").alias("expectedError"), F.lit("preserve").alias("expectedVisualEffect"), F.lit(True).alias("readOnly"))


def registry_counts(contexts: DataFrame, skips: DataFrame, routes: DataFrame) -> DataFrame:
    """One row of counters (A16): declared, materialised, skipped, without a fixture, out of scope on purpose; whether fixtures are complete and
    the declarations exactly covered."""
    gaps = F.count_if(F.col("reason") == "missing-read-only-fixture")
    own = skips.agg(F.count("*").alias("skipped"), gaps.alias("gaps"))
    faults = declared(contexts, skips, routes).agg(F.count("*").alias("faults"))
    every = routes.agg(F.count("*").alias("declared")).crossJoin(contexts.agg(F.count("*").alias("materialised"))).crossJoin(own).crossJoin(faults)
    return every.select("declared", "materialised", "skipped", "gaps", (F.col("skipped") - F.col("gaps")).alias("out_of_scope"), (F.col("gaps") == 0).alias("fixtures_complete"), (F.col("faults") == 0).alias("exact"))


def affected(routes: DataFrame, edges: DataFrame, changed: DataFrame, unresolved: DataFrame, files: DataFrame, fixtures: DataFrame, **kw) -> dict[str, DataFrame]:
    """What a change set touches (G08): the changed files' report, affected routes, their contexts and skips, and one row that says
    whether all of it is known. routes also have ``guards``."""
    report, hit = analyse(routes, edges, changed, unresolved, files, **kw)
    own = routes.join(hit.select("pattern").distinct(), "pattern", "left_semi").select("pattern", "guards")
    contexts, skips = registry(own, fixtures)
    counts = registry_counts(contexts, skips, own)
    done = complete(report, routes, unresolved)
    whole = done.crossJoin(counts.select("fixtures_complete", "exact")).withColumn("coverage_complete", F.col("complete") & F.col("exact") & F.col("fixtures_complete"))
    return {"report": report, "routes": hit, "contexts": contexts, "skips": skips, "outcome": whole}


def element_modules(elements: DataFrame, imports: DataFrame, *, guards: str = "(Guard|Required|Protected|Only)$") -> DataFrame:
    """(node, modules, guards, unresolved) of routes' element expressions (P31). elements: (node, expression); imports: (local, specifier).

    Capitalised tags and identifiers of an expression are components: those whose name is a guard's protect the others, those
    that aren't imported are unresolved.
    """
    names = F.array_distinct(F.regexp_extract_all("expression", F.lit(r"(?:<|\{|\(|,|^)\s*([A-Z][A-Za-z0-9_$]*)"), F.lit(1)))
    each = elements.select("node", F.explode_outer(names).alias("local")).join(imports, "local", "left")
    guard = F.col("local").rlike(guards)
    lists = lambda c, v: F.array_sort(F.array_distinct(F.collect_list(F.when(c, v))))
    return each.groupBy("node").agg(lists(~guard & F.col("specifier").isNotNull(), F.col("specifier")).alias("modules"), lists(guard, F.col("local")).alias("guards"), lists(F.col("specifier").isNull() & F.col("local").isNotNull() & ~guard, F.col("local")).alias("unresolved"))


def portable(path: Column, root: str) -> Column:
    """A path below a root as it is written elsewhere: relative, with forward slashes; others as they are."""
    own = F.translate(path, "\\", "/")
    front = root.replace("\\", "/").rstrip("/") + "/"
    return F.when(own.startswith(front), F.substring(own, len(front) + 1, 1 << 20)).otherwise(own)


def matching_fixtures(requests: DataFrame, fixtures: DataFrame) -> DataFrame:
    """requests (id, method, url_path) with the status of the registered response for just that path, whatever its query."""
    answers = fixtures.select(F.explode("responses").alias("r")).select(F.col("r.method").alias("method"), F.col("r.path").alias("bare"), F.col("r.status").alias("status")).distinct()
    return requests.withColumn("bare", F.element_at(F.split("url_path", r"\?", 2), 1)).join(answers, ["method", "bare"], "left").drop("bare")


def foreign_fixtures(contexts: DataFrame, fixtures: DataFrame) -> DataFrame:
    """(name, fixture) of contexts whose checked-in fixture belongs to another pattern, or to none."""
    own = fixtures.where("source = 'checked-in'").select("pattern", "fixture")
    versioned = contexts.where("kind = 'dynamic'").select("name", "pattern", "fixture")
    return versioned.join(fixtures.where("source != 'checked-in'").select("pattern", "fixture"), ["pattern", "fixture"], "left_anti").join(own, ["pattern", "fixture"], "left_anti").select("name", "fixture")
