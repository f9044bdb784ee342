"""Gates, graphs, colours and document rules over the shared tables, each through the engine's own operator, with the SQL that says the same.

Keys are operators' ids. Every query reads its whole tables. Sources, style sheets and declarations are made of the tables' columns, alike in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline import model
from weftline.functions import colour
from weftline.functions import text as T
from weftline.operators import cluster, gates, graphs, mining, naming, sets
from weftline.plans import docs as D
from weftline.plans import evidence, routes, style
from weftline.plans.tables import query, table
from weftline.sources import files

_HUES = ("red", "lime", "teal", "rose")
#: A source file for each part: (path, text), the same expression in both engines' dialects.
_SOURCE_SQL = """
    SELECT 'src/pages/p' || p_partkey || '.jsx' AS path, concat_ws(chr(10),
        '<a className="bg-gray-' || (p_size % 9 + 1) || '00 p-[' || p_size || 'px]">',
        'color: #' || lpad(lower(hex((p_partkey * 7919) % 16777216)), 6, '0'),
        CASE WHEN p_size % 7 = 0 THEN 'text-red-500 ds-allow: known' ELSE 'text-' || CASE p_size % 4 WHEN 0 THEN 'red' WHEN 1 THEN 'lime' WHEN 2 THEN 'teal' ELSE 'rose' END || '-400 z-' || p_size END,
        'duration-[' || p_size || 'ms] ' || CASE WHEN p_partkey % 3 = 0 THEN 'var(--d)' ELSE 'rounded-[4px]' END,
        'text-[' || (p_size % 20) || 'px] bg-white', p_name) AS text FROM part"""


def _source(spark: SparkSession, sf: str) -> DataFrame:
    size, s = F.col("p_size"), F.col("p_size").cast("string")
    hue = F.element_at(F.array(*map(F.lit, _HUES)), (size % 4 + 1).cast("int"))
    lines = (
        F.concat(F.lit('<a className="bg-gray-'), (size % 9 + 1).cast("string"), F.lit("00 p-["), s, F.lit('px]">')),
        F.concat(F.lit("color: #"), F.lower(F.lpad(F.hex((F.col("p_partkey") * 7919) % 16777216), 6, "0"))),
        F.when(size % 7 == 0, "text-red-500 ds-allow: known").otherwise(F.concat(F.lit("text-"), hue, F.lit("-400 z-"), s)),
        F.concat(F.lit("duration-["), s, F.lit("ms] "), F.when(F.col("p_partkey") % 3 == 0, "var(--d)").otherwise("rounded-[4px]")),
        F.concat(F.lit("text-["), (size % 20).cast("string"), F.lit("px] bg-white")),
        F.col("p_name"),
    )
    return table(spark, sf, "part").select(F.concat(F.lit("src/pages/p"), F.col("p_partkey").cast("string"), F.lit(".jsx")).alias("path"), F.concat_ws("\n", *lines).alias("text"))


def _dimension_sql() -> str:
    each = [f"SELECT '{d}' AS dim, count(*) FILTER (regexp_matches(content, '{rx}')" + (f" AND NOT regexp_matches(content, '{out}')" if out else "") + ") AS value FROM kept" for d, rx, out in model.HARDCODE]
    return f"""source AS ({_SOURCE_SQL}), kept AS (SELECT content FROM (SELECT unnest(string_split(text, chr(10))) AS content FROM source) WHERE NOT contains(content, 'ds-allow:')),
        dims AS ({" UNION ALL ".join(each)})"""


@query(f"WITH {_dimension_sql()} SELECT dim, value FROM dims UNION ALL SELECT 'TOTAL', CAST(sum(value) AS BIGINT) FROM dims")
def F12_dimension_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The nine dimensions of hard-coded style, with their total."""
    return style.hardcode_counts(_source(spark, sf))


@query(f"""
    WITH {_dimension_sql()}, base AS (SELECT * FROM (VALUES ('color-gray', 10), ('motion', 1000000), ('zindex', 0), ('gone', 4)) t(dim, b)), j AS (
        SELECT coalesce(dims.dim, base.dim) AS dim, coalesce(value, 0) AS current, CAST(coalesce(b, 0) AS BIGINT) AS baseline FROM dims FULL JOIN base ON dims.dim = base.dim)
    SELECT *, CASE WHEN current > baseline THEN 'up' WHEN current < baseline THEN 'down' ELSE 'same' END AS status FROM j""")
def R04_hardcode_ratchet(spark: SparkSession, sf: str) -> DataFrame:
    base = spark.createDataFrame([("color-gray", 10), ("motion", 1_000_000), ("zindex", 0), ("gone", 4)], "dim string, value bigint")
    return gates.ratchet(style.hardcode_counts(_source(spark, sf)).where("dim != 'TOTAL'"), base)


@query(f"""
    WITH source AS ({_SOURCE_SQL}), allowed AS (SELECT * FROM source WHERE NOT (path LIKE '%p1%.jsx' OR path LIKE 'src/%7.jsx'))
    SELECT path, line, content FROM (SELECT path, unnest(string_split(text, chr(10))) AS content, unnest(range(1, 1 + len(string_split(text, chr(10))))) AS line FROM allowed)
    WHERE NOT contains(content, 'ds-allow:') AND regexp_matches(content, '{model.HARDCODE[8][1]}') AND NOT regexp_matches(content, '{model.HARDCODE[8][2]}')""")
def K09_counted_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The lines behind one dimension's count, but for those of allowed paths."""
    allow = spark.createDataFrame([("*p1*.jsx",), ("src/*7.jsx",)], "pattern string")
    return style.hardcode_lines(_source(spark, sf), allow=allow).where("dim = 'zindex'").select("path", F.col("line").cast("bigint").alias("line"), "content")


@query("""
    WITH c AS (SELECT p_partkey, (p_size % 21) / 20.0::DOUBLE AS l, (p_partkey % 37) / 100.0::DOUBLE AS ch, CAST((p_partkey * 7) % 360 AS DOUBLE) AS h FROM part),
    k AS (SELECT p_partkey, l, ch * cos(radians(h)) AS a, ch * sin(radians(h)) AS b FROM c),
    m AS (SELECT p_partkey, pow(l + 0.3963377774::DOUBLE * a + 0.2158037573::DOUBLE * b, 3) AS x, pow(l - 0.1055613458::DOUBLE * a - 0.0638541728::DOUBLE * b, 3) AS y, pow(l - 0.0894841775::DOUBLE * a - 1.2914855480::DOUBLE * b, 3) AS z FROM k),
    n AS (SELECT p_partkey, unnest([4.0767416621::DOUBLE * x - 3.3077115913::DOUBLE * y + 0.2309699292::DOUBLE * z, -1.2684380046::DOUBLE * x + 2.6097574011::DOUBLE * y - 0.3413193965::DOUBLE * z, -0.0041960863::DOUBLE * x - 0.7034186147::DOUBLE * y + 1.7076147010::DOUBLE * z]) AS v, unnest([1, 2, 3]) AS i FROM m),
    s AS (SELECT p_partkey, i, CAST(round_even(255 * CASE WHEN g <= 0.0031308 THEN 12.92 * g ELSE 1.055 * pow(g, 1 / 2.4::DOUBLE) - 0.055 END, 0) AS INT) AS q FROM (SELECT *, greatest(0, least(1, v)) AS g FROM n))
    SELECT p_partkey, '#' || string_agg(printf('%02x', q), '' ORDER BY i) AS hex FROM s GROUP BY p_partkey""")
def X03_oklch(spark: SparkSession, sf: str) -> DataFrame:
    shown = F.format_string("oklch(%.2f %.2f %d)", (F.col("p_size") % 21) / F.lit(20.0), (F.col("p_partkey") % 37) / F.lit(100.0), (F.col("p_partkey") * 7) % 360)
    return table(spark, sf, "part").select("p_partkey", colour.oklch_rgb(shown).alias("rgb")).select("p_partkey", colour.to_hex(F.col("rgb")).alias("hex"))


@query("""
    WITH c AS (SELECT p_partkey, [p_partkey % 256, (p_partkey * 7) % 256, p_size * 5] AS t, (p_size % 11) / 10.0::DOUBLE AS a FROM part)
    SELECT p_partkey, '#' || array_to_string([printf('%02x', CAST(round_even(t[i] * a + u * (1 - a), 0) AS INT)) FOR u, i IN [17, 34, 250]], '') AS hex FROM c""")
def X06_composite(spark: SparkSession, sf: str) -> DataFrame:
    """A translucent colour over another, channel by channel."""
    top = colour.rgb(F.col("p_partkey") % 256, (F.col("p_partkey") * 7) % 256, F.col("p_size") * 5)
    return table(spark, sf, "part").select("p_partkey", colour.to_hex(colour.over(top, (F.col("p_size") % 11) / F.lit(10.0), colour.rgb(F.lit(17), F.lit(34), F.lit(250)))).alias("hex"))


@query("""
    SELECT p_partkey, CAST(floor(0.25 * (0.2126::DOUBLE * (p_partkey % 256) + 0.7152::DOUBLE * ((p_partkey * 7) % 256) + 0.0722::DOUBLE * (p_size * 5)) + 0.5) AS INT) AS grey FROM part""")
def X20_heat(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", colour.heat(colour.rgb(F.col("p_partkey") % 256, (F.col("p_partkey") * 7) % 256, F.col("p_size") * 5)).alias("grey"))


@query("""
    WITH RECURSIVE d AS (
        SELECT 'dark' AS theme, 'c' || c_custkey AS name, CASE WHEN c_custkey % 5 = 0 THEN '#' || c_custkey ELSE 'var(--c' || (c_custkey - 1) || ')' END AS value FROM customer
        UNION ALL SELECT 'light', 'c' || c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'light' || c_custkey ELSE 'var(--c' || (c_custkey + 3) || ')' END FROM customer WHERE c_custkey % 4 = 0),
    t AS (SELECT th.theme, n.name, coalesce(o.value, b.value) AS value FROM (SELECT DISTINCT theme FROM d) th CROSS JOIN (SELECT DISTINCT name FROM d) n LEFT JOIN d o ON o.theme = th.theme AND o.name = n.name LEFT JOIN d b ON b.theme = 'dark' AND b.name = n.name),
    r(theme, name, value, target, seen) AS (
        SELECT theme, name, value, nullif(regexp_extract(value, '^var\\(--(.*)\\)$', 1), ''), [name] FROM t
        UNION ALL SELECT r.theme, r.name, t.value, nullif(regexp_extract(t.value, '^var\\(--(.*)\\)$', 1), ''), list_append(r.seen, r.target) FROM r LEFT JOIN t ON t.theme = r.theme AND t.name = r.target WHERE r.target IS NOT NULL AND NOT list_contains(r.seen, r.target))
    SELECT theme, name, CASE WHEN target IS NULL THEN value END AS value, CASE WHEN target IS NOT NULL THEN 'cycle' WHEN value IS NULL THEN 'missing' ELSE 'resolved' END AS status
    FROM r WHERE target IS NULL OR list_contains(seen, target)""".replace("\\\\", "\\"))
def G01_alias_chains(spark: SparkSession, sf: str) -> DataFrame:
    """Names that stand for names, in two themes of which one falls back to the other."""
    key = F.col("c_custkey")
    name = F.concat(F.lit("c"), key.cast("string"))
    to = lambda k: F.concat(F.lit("var(--c"), k.cast("string"), F.lit(")"))
    own = table(spark, sf, "customer")
    dark = own.select(F.lit("dark").alias("theme"), name.alias("name"), F.when(key % 5 == 0, F.concat(F.lit("#"), key.cast("string"))).otherwise(to(key - 1)).alias("value"))
    light = own.where("c_custkey % 4 = 0").select(F.lit("light").alias("theme"), name.alias("name"), F.when(key % 10 == 0, F.concat(F.lit("light"), key.cast("string"))).otherwise(to(key + 3)).alias("value"))
    return graphs.resolve_aliases(dark.union(light))


@query("""
    WITH f AS (SELECT DISTINCT o_custkey AS k FROM orders), i AS (SELECT DISTINCT o_custkey AS k, o_orderkey % 1600 AS t FROM orders)
    SELECT 'src/m' || i.k || '.js' AS src, 'src/m' || i.t || '.js' AS dst FROM i JOIN f ON i.t = f.k""")
def G03_import_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Modules that import others by relative and aliased specifiers, with and without an extension, resolved to files."""
    return routes.import_edges(_modules(spark, sf))[0]


def _modules(spark: SparkSession, sf: str) -> DataFrame:
    """A module for each customer with orders; each order imports one, in one of three ways."""
    target, way = (F.col("o_orderkey") % 1600).cast("string"), F.col("o_orderkey") % 3
    spec = F.when(way == 0, F.concat(F.lit("./m"), target)).when(way == 1, F.concat(F.lit("@/m"), target, F.lit(".js"))).otherwise(F.concat(F.lit("../src/m"), target))
    line = F.concat(F.lit("import { x } from '"), spec, F.lit("';"))
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set(line)), "\n").alias("text")).select(F.concat(F.lit("src/m"), F.col("o_custkey").cast("string"), F.lit(".js")).alias("path"), "text")


@query("""
    WITH f AS (SELECT DISTINCT o_custkey AS k FROM orders), i AS (SELECT DISTINCT o_custkey AS k, o_orderkey % 1600 AS t FROM orders)
    SELECT DISTINCT 'src/m' || i.k || '.js' AS importer, t FROM i WHERE t NOT IN (SELECT k FROM f)""")
def J17_unresolved_imports(spark: SparkSession, sf: str) -> DataFrame:
    """Local imports that name no file."""
    lost = routes.import_edges(_modules(spark, sf))[1]
    return lost.select("importer", F.regexp_extract("specifier", r"m(\d+)", 1).cast("bigint").alias("t")).distinct()


@query("""
    WITH RECURSIVE e AS (SELECT DISTINCT o_orderkey % 1500 AS s, o_custkey AS d FROM orders),
    r(node, hops) AS (SELECT c_custkey, 0 FROM customer WHERE c_acctbal < -900 UNION SELECT e.d, hops + 1 FROM r JOIN e ON r.node = e.s WHERE hops < 40),
    near AS (SELECT node, min(hops) AS hops FROM r GROUP BY node)
    SELECT '/n/' || n_name AS pattern, CAST(min(hops) AS INT) AS hops, 'import' AS reason FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN near ON near.node = c_custkey GROUP BY 1""")
def J13_route_impact(spark: SparkSession, sf: str) -> DataFrame:
    """The routes that changed modules reach backwards through imports, with the least number of hops."""
    own = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    pages = own.groupBy(F.concat(F.lit("/n/"), F.col("n_name")).alias("pattern")).agg(F.collect_list(F.col("c_custkey").cast("bigint")).alias("modules"))
    edges = table(spark, sf, "orders").select(F.col("o_custkey").cast("bigint").alias("src"), (F.col("o_orderkey") % 1500).cast("bigint").alias("dst"))
    return graphs.impact(pages, edges, table(spark, sf, "customer").where("c_acctbal < -900").select(F.col("c_custkey").cast("bigint").alias("node"))).withColumn("hops", F.col("hops").cast("int"))


@query("""
    WITH RECURSIVE t AS (SELECT p_partkey AS node, CASE WHEN p_partkey > 1 THEN p_partkey // 6 END AS parent, CASE WHEN p_partkey % 5 = 0 THEN ':id' || p_partkey ELSE 's' || p_partkey END AS path FROM part),
    r(node, pattern) AS (SELECT node, '/' || path FROM t WHERE parent IS NULL UNION ALL SELECT t.node, r.pattern || '/' || t.path FROM r JOIN t ON t.parent = r.node)
    SELECT node, pattern, len(string_split(pattern, '/')) - 1 AS modules, list_sort(list_distinct(regexp_extract_all(pattern, ':([A-Za-z0-9_]+)', 1))) AS params FROM r""")
def G06_route_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Paths composed down a tree of routes, with the modules inherited and the parameters."""
    key = F.col("p_partkey").cast("bigint")
    nodes = table(spark, sf, "part").select(key.alias("node"), F.when(key > 1, F.expr("cast(p_partkey as bigint) div 6")).alias("parent"), F.concat(F.when(key % 5 == 0, ":id").otherwise("s"), key.cast("string")).alias("path"), F.array(F.concat(F.lit("m"), key.cast("string"))).alias("modules"), F.array().cast("array<string>").alias("guards"))
    return graphs.inherited(nodes).select("node", "pattern", F.size("modules").cast("bigint").alias("modules"), routes.parameters(F.col("pattern")).alias("params"))


@query(f"""
    WITH used AS (SELECT 'bg-' || lower(regexp_extract(p_name, '^[A-Za-z]+', 0)) || '-' || p_size AS name, 'p' || p_partkey AS path FROM part), first AS (SELECT name, min(path) AS path FROM used GROUP BY name),
    css AS (SELECT DISTINCT 'bg-' || lower(regexp_extract(p_name, '^[A-Za-z]+', 0)) || '-' || (p_size * 2) AS s FROM part WHERE p_partkey % 2 = 0)
    SELECT * FROM first WHERE NOT EXISTS (SELECT 1 FROM css WHERE starts_with(s, name))""")
def J05_ghost_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Used names for which the emitted style sheet has no selector."""
    part = table(spark, sf, "part")
    head = F.concat(F.lit("bg-"), F.lower(F.regexp_extract("p_name", "^[A-Za-z]+", 0)), F.lit("-"))
    used = part.groupBy(F.concat(head, F.col("p_size").cast("string")).alias("name")).agg(F.min(F.concat(F.lit("p"), F.col("p_partkey").cast("string"))).alias("path"))
    css = part.where("p_partkey % 2 = 0").select(F.concat(F.lit("."), head, (F.col("p_size") * 2).cast("string"), F.lit(" { color: red }")).alias("text"))
    return style.ghost_classes(used, css)


@query(r"""
    WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS xs FROM documents WHERE text IS NOT NULL), u AS (SELECT doc_id, unnest(range(1, len(xs) + 1)) AS line, unnest(xs) AS content FROM l)
    SELECT doc_id AS path, count(*) AS lines, count(*) FILTER (regexp_matches(content, '^\s*$')) AS blank FROM u GROUP BY 1""")
def P01_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines and blank lines of each document: split on line ends only, so that a last one counts."""
    own = T.lines(table(spark, sf, "documents").withColumnRenamed("doc_id", "path"))
    return own.groupBy("path").agg(F.count("*").alias("lines"), F.count_if(F.col("content").rlike(r"^\s*$")).alias("blank"))


@query("""
    WITH x AS (SELECT conv_id AS path, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS line, CASE WHEN role = 'user' THEN '```' ELSE text END AS content FROM conversations),
    m AS (SELECT *, regexp_matches(content, '^\\s*(```|~~~)') AS mark FROM x)
    SELECT path, line, mark OR sum(mark::INT) OVER (PARTITION BY path ORDER BY line ROWS UNBOUNDED PRECEDING) % 2 = 1 AS code FROM m""".replace("\\\\", "\\"))
def W01_running_parity(spark: SparkSession, sf: str) -> DataFrame:
    """Which lines lie within a fence."""
    own = sets.numbered(table(spark, sf, "conversations"), ["conv_id"], F.col("turn"), F.col("role"), F.col("text"))
    return D.fenced(own.select(F.col("conv_id").alias("path"), F.col("nth").cast("bigint").alias("line"), F.when(F.col("role") == "user", "```").otherwise(F.col("text")).alias("content"))).select("path", "line", "code")


@query("""
    WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line, CASE WHEN event_id % 11 = 0 THEN 'sem-data' ELSE strftime(ts + INTERVAL (event_id % 3) DAY, '%Y-%m-%d') END AS d FROM events),
    p AS (SELECT *, sum((d = 'sem-data')::INT) OVER (PARTITION BY user_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS part FROM e),
    b AS (SELECT *, lag(d) OVER (PARTITION BY user_id, part ORDER BY line) AS before FROM p WHERE d <> 'sem-data')
    SELECT user_id, CAST(line AS INT) AS line, d || ' after ' || before AS detail FROM b WHERE d > before""")
def W02_lag_order(spark: SparkSession, sf: str) -> DataFrame:
    """Dates out of order in logs, one log for each user; an undated entry starts anew."""
    day = F.date_format(F.col("ts") + F.make_interval(days=(F.col("event_id") % 3).cast("int")), "yyyy-MM-dd")
    head = F.concat(F.lit("## ["), F.when(F.col("event_id") % 11 == 0, "sem-data").otherwise(day), F.lit("] x · y"))
    logs = table(spark, sf, "events").groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", head.alias("h")))), lambda x: x["h"]), "\n").alias("text"))
    found = D.log_faults(logs.select(F.concat(F.col("user_id").cast("string"), F.lit("/log.md")).alias("path"), "text"))
    return found.where("rule = 'log-order'").select(F.regexp_extract("path", r"^(\d+)/", 1).cast("bigint").alias("user_id"), F.col("line").cast("int").alias("line"), "detail")


@query("""
    SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS nth FROM events""")
def W03_occurrence_number(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    return sets.numbered(own, ["user_id", "event_type"], F.col("event_id")).withColumn("nth", F.col("nth").cast("bigint"))


@query("""
    SELECT line, text FROM (SELECT event_id AS line, event_type || ' ' || user_id AS text, row_number() OVER (ORDER BY event_id DESC) AS back, event_id % 5 AS k FROM events) WHERE back <= 400 AND k IN (0, 1)""")
def S24_tail_by_role(spark: SparkSession, sf: str) -> DataFrame:
    """What a role said in a transcript's last lines, in two shapes; broken lines and other roles are passed over."""
    said = F.concat("event_type", F.lit(" "), F.col("user_id").cast("string"))
    k = F.col("event_id") % 5
    value = F.when(k == 0, F.to_json(F.struct(F.lit("assistant").alias("role"), said.alias("content")))).when(k == 1, F.to_json(F.struct(F.struct(F.lit("assistant").alias("role"), said.alias("content")).alias("message")))).when(k == 2, "{broken").otherwise(F.to_json(F.struct(F.lit("user").alias("role"), said.alias("content"))))
    return files.transcript_tail(table(spark, sf, "events").select(F.col("event_id").alias("line"), value.alias("value")))


@query("""
    SELECT count(DISTINCT l.doc_id) AS scanned, (SELECT count(DISTINCT doc_id) FROM documents) AS eligible, count(DISTINCT l.doc_id) / (SELECT count(DISTINCT doc_id) FROM documents) >= 0.8 AS ok FROM labels l SEMI JOIN documents d ON l.doc_id = d.doc_id""")
def D21_scanned_share(spark: SparkSession, sf: str) -> DataFrame:
    return style.scanned_share(table(spark, sf, "labels").select(F.col("doc_id").alias("path")), table(spark, sf, "documents").select(F.col("doc_id").alias("path")))


@query("""
    SELECT r_name AS scenario, t AS theme, p AS project, r_name || '::theme/' || t || '::project/' || p AS id FROM region, (VALUES ('dark'), ('light')) a(t), (VALUES ('desktop'), ('mobile'), ('tablet')) b(p)""")
def J24_matrix_cross(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.matrix(table(spark, sf, "region").select(F.col("r_name").alias("scenario")), {"theme": ["dark", "light"], "project": ["desktop", "mobile", "tablet"]})


@query("""
    WITH f AS (SELECT DISTINCT doc_id AS d FROM documents), m AS (SELECT DISTINCT doc_id AS l FROM labels)
    SELECT 'shots/' || coalesce(d, l) AS stem, CASE WHEN l IS NULL THEN 'missing-metadata' WHEN d IS NULL THEN 'orphan' ELSE 'ok' END AS status FROM f FULL JOIN m ON d = l""")
def J10_pair_by_stem(spark: SparkSession, sf: str) -> DataFrame:
    """Images and their metadata by the stem of their names."""
    path = lambda name, end: table(spark, sf, name).select(F.concat(F.lit("shots/"), F.col("doc_id").cast("string"), F.lit(end)).alias("path")).distinct()
    return files.captures(path("documents", ".png").union(path("labels", ".meta.json"))).select("stem", "status")


@query("""
    WITH m AS (SELECT conv_id, turn, lower(text) AS t FROM conversations), s AS (
        SELECT conv_id, turn, list_filter([CASE WHEN regexp_matches(t, 'which|choose|prefer') THEN 'choice' END, CASE WHEN contains(t, '?') THEN 'question' END], lambda x: x IS NOT NULL) AS signals,
            list_filter([CASE WHEN NOT regexp_matches(t, 'because|why') THEN 'reason' END, CASE WHEN NOT regexp_matches(t, 'option|either') THEN 'options' END], lambda x: x IS NOT NULL) AS missing FROM m)
    SELECT conv_id || ':' || turn AS id, array_to_string(signals, ',') AS signals, array_to_string(missing, ',') AS missing, list_contains(signals, 'choice') AND len(missing) > 0 AS blocked FROM s""")
def F22_signals(spark: SparkSession, sf: str) -> DataFrame:
    """What messages signal, what a decision block lacks, and whether that stops."""
    own = table(spark, sf, "conversations").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "text")
    got = D.clarifications(own, [("choice", "which|choose|prefer"), ("question", r"\?")], [("reason", "because|why"), ("options", "option|either")])
    return got.select("id", F.array_join("signals", ",").alias("signals"), F.array_join("missing", ",").alias("missing"), "blocked")


@query("""
    WITH o AS (SELECT l_returnflag AS tag, l_linestatus AS role, l_shipmode AS property, l_suppkey AS t FROM (SELECT *, CASE WHEN l_quantity < 25 THEN 'AIR' ELSE 'SHIP' END AS l_shipmode FROM lineitem))
    SELECT tag, role, property, count(*) AS uses, len(list_distinct(list(t))) AS tokens FROM o GROUP BY ALL""")
def D03_clusters(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("tag"), F.col("l_linestatus").alias("role"), F.when(F.col("l_quantity") < 25, "AIR").otherwise("SHIP").alias("property"), F.col("l_suppkey").alias("token"))
    return cluster.clusters(own, ("tag", "role", "property")).select("tag", "role", "property", "uses", F.size("tokens").cast("bigint").alias("tokens"))


@query("""
    SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'card' WHEN l_linestatus = 'O' THEN 'field' WHEN l_returnflag = 'R' THEN 'badge' END AS owner FROM lineitem""")
def D18_owner_by_context(spark: SparkSession, sf: str) -> DataFrame:
    """Owners from a table of rules with wildcards; of those that hold the one with most given parts wins, then the last by name."""
    rules = spark.createDataFrame([("R", None, None, "badge"), ("R", "F", None, "card"), (None, "O", None, "field")], "tag string, role string, container string, owner string")
    own = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("tag"), F.col("l_linestatus").alias("role"), F.lit("div").alias("container"))
    return cluster.owners_by_context(own, rules).select("l_orderkey", "l_linenumber", "owner")


@query("""
    WITH n AS (SELECT DISTINCT lower(replace(p_type, ' ', '.')) AS name FROM part UNION SELECT lower(string_split(p_type, ' ')[1]) FROM part),
    w AS (SELECT name, string_split(name, '.') AS ps FROM n), c AS (SELECT name, ps[i] AS word, array_to_string(list_concat(ps[:i - 1], ps[i + 1:]), '.') AS shorter FROM (SELECT name, ps, unnest(range(1, len(ps) + 1)) AS i FROM w))
    SELECT c.name, word, n.name IS NOT NULL AS collides FROM c LEFT JOIN n ON n.name = shorter""")
def D12_removal(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a name without one of its words is another's."""
    own = table(spark, sf, "part").select(F.explode(F.array(F.lower(F.translate("p_type", " ", ".")), F.lower(F.element_at(F.split("p_type", " "), 1)))).alias("name"))
    return naming.removable(own)


@query("""
    WITH u AS (SELECT l_orderkey AS key, string_agg(CAST(l_suppkey % 5 AS VARCHAR), ' ' ORDER BY l_suppkey % 5) AS classes, bool_or(l_returnflag = 'R') AS lawful FROM lineitem GROUP BY 1),
    t AS (SELECT *, count(*) OVER (PARTITION BY classes) AS times, len(string_split(classes, ' ')) AS n FROM u)
    SELECT CASE WHEN lawful THEN 'A' WHEN times >= 2 AND n >= 4 THEN 'B1' WHEN times >= 2 THEN 'B2' ELSE 'C' END AS part, count(*) AS n, (SELECT count(*) FROM u) AS total FROM t GROUP BY 1""")
def D22_class_partition(spark: SparkSession, sf: str) -> DataFrame:
    """Class uses in law, repeated bundles, repeated single utilities, and the rest."""
    own = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.array_join(F.array_sort(F.collect_list((F.col("l_suppkey") % 5).cast("string"))), " ").alias("classes"), F.bool_or(F.col("l_returnflag") == "R").alias("lawful"))
    return style.class_partition(own)


@query("""
    WITH b AS (SELECT o_custkey AS key, list_sort(list_distinct(list(o_orderpriority))) AS e, sum(o_orderkey) AS h FROM orders WHERE o_orderdate < TIMESTAMP '1995-01-01' GROUP BY 1),
    a AS (SELECT o_custkey AS key, list_sort(list_distinct(list(o_orderpriority))) AS e, sum(o_orderkey) AS h FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY 1)
    SELECT CASE WHEN a.key IS NULL THEN 'only_before' WHEN b.key IS NULL THEN 'only_after' WHEN a.h = b.h THEN 'same' ELSE 'changed' END AS state, count(*) AS n, count(*) FILTER (len(list_filter(coalesce(a.e, []), lambda x: NOT list_contains(coalesce(b.e, []), x))) > 0) AS new_errors
    FROM b FULL JOIN a ON a.key = b.key GROUP BY 1""")
def R21_report_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of two reports by state, and those with errors that weren't there before."""
    side = lambda c: table(spark, sf, "orders").where(c).groupBy(F.col("o_custkey").alias("key")).agg(F.sum("o_orderkey").cast("string").alias("hash"), F.collect_set("o_orderpriority").alias("errors"))
    return evidence.report_gate(side("o_orderdate < timestamp'1995-01-01'"), side("o_orderdate >= timestamp'1996-01-01'"))


@query("""
    WITH d AS (SELECT 'p' || (p_size % 7) AS pattern, p_partkey AS ord, 'm' || (p_partkey % 3) AS m, 'g' || (p_partkey % 2) AS g FROM part)
    SELECT pattern, list_sort(list_distinct(list(m))) AS modules, list_sort(list_distinct(list(g))) AS guards, max_by(m, ord) AS module, count(*) AS definitions FROM d GROUP BY 1""")
def A11_merge_by_pattern(spark: SparkSession, sf: str) -> DataFrame:
    """Routes by pattern: sorted unions, and the last own module."""
    key = F.col("p_partkey")
    name = lambda front, k: F.concat(F.lit(front), k.cast("string"))
    own = table(spark, sf, "part").select(key.alias("ord"), name("p", F.col("p_size") % 7).alias("pattern"), name("m", key % 3).alias("module"), F.array(name("m", key % 3)).alias("modules"), F.array(name("g", key % 2)).alias("guards"))
    return routes.merged(own)


@query("""
    SELECT 'c' || (o_custkey % 50) AS pattern, 'uncovered' AS fault FROM orders GROUP BY 1 HAVING NOT bool_or(o_orderstatus = 'P' OR o_totalprice > 300000)
    UNION ALL SELECT 'stray', 'unknown'""")
def U08_declared_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """Contexts and skips together against what is declared."""
    own = table(spark, sf, "orders").select(F.concat(F.lit("c"), (F.col("o_custkey") % 50).cast("string")).alias("pattern"), "o_orderstatus", "o_totalprice")
    return sets.declared(own.where("o_orderstatus = 'P'").select("pattern").union(spark.createDataFrame([("stray",)], "pattern string")), own.where("o_totalprice > 300000").select("pattern"), own.select("pattern"))


@query("""
    WITH d AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'dark' ELSE 'light' END AS theme, o_custkey % 200 AS name, o_orderkey AS value, o_orderdate AS file_ord, o_orderkey AS pos FROM orders)
    SELECT theme, name, value FROM (SELECT *, row_number() OVER (PARTITION BY theme, name ORDER BY file_ord DESC, pos DESC) AS n FROM d) WHERE n = 1""")
def W06_last_write_wins(spark: SparkSession, sf: str) -> DataFrame:
    """The declaration that wins in a cascade."""
    own = table(spark, sf, "orders").select(F.when(F.col("o_orderstatus") == "F", "dark").otherwise("light").alias("theme"), (F.col("o_custkey") % 200).alias("name"), F.col("o_orderkey").alias("value"), F.col("o_orderdate").alias("file_ord"), F.col("o_orderkey").alias("pos"))
    return graphs.cascade(own)


@query("""
    WITH v AS (SELECT 'quality' AS kind FROM labels WHERE quality = 0 UNION ALL SELECT 'toxic' FROM labels WHERE toxic = 1 UNION ALL SELECT 'unknown' FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id))
    SELECT kind, count(*) AS n FROM v GROUP BY 1""")
def A01_count_by_kind(spark: SparkSession, sf: str) -> DataFrame:
    """Violations of several checks in one stream, counted by kind."""
    labels = table(spark, sf, "labels")
    name = F.col("doc_id").cast("string")
    lost = labels.join(table(spark, sf, "documents").select("doc_id"), "doc_id", "left_anti")
    found = sets.union(naming.violations("quality", labels.where("quality = 0"), name=name), naming.violations("toxic", labels.where("toxic = 1"), name=name), naming.violations("unknown", lost, name=name))
    return mining.top(found.groupBy("kind").agg(F.count("*").alias("n")), ["kind"], 1, F.desc("n")).select("kind", "n")
