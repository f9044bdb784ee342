"""The engine's operators over the shared tables, each with the SQL that says the same.

Keys are operators' ids. Every query reads its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import colour, text
from weftline.operators import gates, graphs, mining, naming, sets

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(r"""
    WITH hits AS (
        SELECT 'class' AS dim, unnest(regexp_extract_all(html, 'class="([^"]*)"', 1)) AS v FROM pages
        UNION ALL SELECT 'href', unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) FROM pages
        UNION ALL SELECT 'tag', unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) FROM pages),
    now AS (SELECT dim, count(*) AS c FROM hits GROUP BY dim),
    base AS (SELECT * FROM (VALUES ('class', 100), ('href', 1000000000), ('style', 3)) t(dim, b))
    SELECT coalesce(now.dim, base.dim) AS dim, coalesce(c, 0) AS current, CAST(coalesce(b, 0) AS BIGINT) AS baseline,
        CASE WHEN coalesce(c, 0) > coalesce(b, 0) THEN 'up' WHEN coalesce(c, 0) < coalesce(b, 0) THEN 'down' ELSE 'same' END AS status
    FROM now FULL JOIN base ON now.dim = base.dim""")
def R01_occurrence_ratchet(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    forms = [("class", 'class="([^"]*)"'), ("href", 'href="([^"]*)"'), ("tag", "<([a-z][a-z0-9]*)")]
    # One pass: each page gives its counts, which are summed by dimension.
    counts = F.array(*(F.struct(F.lit(d).alias("dim"), text.count_of(F.col("html"), rx).cast("bigint").alias("n")) for d, rx in forms))
    now = pages.select(F.explode(counts).alias("x")).groupBy("x.dim").agg(F.sum("x.n").alias("value")).where("value > 0")
    base = spark.createDataFrame([("class", 100), ("href", 1_000_000_000), ("style", 3)], "dim string, value bigint")
    return gates.ratchet(now, base)


@query(r"""
    WITH hits AS (SELECT unnest(regexp_extract_all(html, 'class="([^"]*)"', 1)) AS name FROM pages)
    SELECT name, count(*) AS n FROM hits GROUP BY name""")
def P02_tag_class_census(spark: SparkSession, sf: str) -> DataFrame:
    return text.matches(table(spark, sf, "pages").select("html"), "html", 'class="([^"]*)"', 1).groupBy("name").agg(F.count("*").alias("n"))


@query("""
    SELECT 'brand' AS axis, count(DISTINCT p_brand) AS value FROM part
    UNION ALL SELECT 'type', count(DISTINCT p_type) FROM part
    UNION ALL SELECT 'small-name', count(DISTINCT p_name) FROM part WHERE p_size < 28
    UNION ALL SELECT 'tag', count(DISTINCT t) FROM (SELECT unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS t FROM pages)""")
def A02_distinct_values_per_axis(spark: SparkSession, sf: str) -> DataFrame:
    """Different values of each axis; the small ones' sizes only below the cut."""
    part = table(spark, sf, "part")
    tags = table(spark, sf, "pages").select(F.lit("tag").alias("axis"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), F.lit(1)))).alias("v"))
    axes = (("brand", F.col("p_brand")), ("type", F.col("p_type")), ("small-name", F.when(F.col("p_size") < 28, F.col("p_name"))))
    own = part.select(F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), v.alias("v")) for a, v in axes))).alias("x")).select("x.*")
    return own.union(tags).groupBy("axis").agg(F.countDistinct("v").alias("value"))


@query("""
    SELECT event_type, user_id, n, place FROM (
        SELECT event_type, user_id, n, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) AS place FROM (
            SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL)) WHERE place <= 6""")
def A08_variant_topk(spark: SparkSession, sf: str) -> DataFrame:
    counts = table(spark, sf, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    return mining.top(counts, ["event_type"], 6, F.desc("n"), F.col("user_id"))


@query("""
    SELECT source, CAST(round_even(1000.0 * count(l.doc_id) / count(*), 0) AS BIGINT) AS permille
    FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id GROUP BY source""")
def A05_permille_coverage(spark: SparkSession, sf: str) -> DataFrame:
    rated = table(spark, sf, "labels").select("doc_id", F.lit(1).alias("r")).distinct()
    own = table(spark, sf, "documents").select("doc_id", "source").join(rated, "doc_id", "left").groupBy("source").agg(F.count("r").alias("part"), F.count("*").alias("whole"))
    return own.select("source", gates.permille(F.col("part"), F.col("whole")).alias("permille"))


@query("SELECT DISTINCT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def J01_dead_anti(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "lang").distinct().join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@query("""
    SELECT p_partkey, p_name FROM part SEMI JOIN lineitem ON p_partkey = l_partkey AND l_quantity >= 49""")
def J02_inner_without_channel(spark: SparkSession, sf: str) -> DataFrame:
    used = table(spark, sf, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf, "part").select("p_partkey", "p_name").join(used, "p_partkey", "left_semi")


@query("""
    SELECT o_orderkey, count(*) AS uses FROM orders JOIN lineitem ON o_orderkey = l_orderkey
    GROUP BY o_orderkey HAVING NOT bool_and(l_shipdate > o_orderdate + INTERVAL 60 DAY)""")
def J03_ghost_not_all(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of which not all uses hold."""
    uses = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate").join(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey")
    own = uses.groupBy("o_orderkey").agg(F.count("*").alias("uses"), F.bool_and(F.col("l_shipdate") > F.col("o_orderdate") + F.expr("INTERVAL 60 DAY")).alias("all"))
    return own.where("not all").drop("all")


@query("""
    SELECT p_partkey, owner FROM (SELECT p_partkey, lower(replace(p_type, ' ', '-')) AS name FROM part)
    LEFT JOIN LATERAL (SELECT max_by(o, length(o)) AS owner FROM (VALUES ('standard'), ('standard-anodized'), ('small'), ('small-plated-tin'), ('medium'), ('large-brushed'), ('economy'), ('promo-burnished')) v(o)
        WHERE name = o OR starts_with(name, o || '-')) ON true""")
def J06_longest_prefix(spark: SparkSession, sf: str) -> DataFrame:
    owners = spark.createDataFrame([(o,) for o in ("standard", "standard-anodized", "small", "small-plated-tin", "medium", "large-brushed", "economy", "promo-burnished")], "owner string")
    names = table(spark, sf, "part").select("p_partkey", F.lower(F.translate("p_type", " ", "-")).alias("name"))
    return naming.longest_owner(names, owners).select("p_partkey", "owner")


@query("""
    WITH b AS (SELECT o_custkey AS key, max(o_orderpriority) AS v FROM orders WHERE o_orderdate < TIMESTAMP '1995-01-01' GROUP BY 1),
    a AS (SELECT o_custkey AS key, max(o_orderpriority) AS v FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY 1)
    SELECT coalesce(a.key, b.key) AS key, CASE WHEN b.key IS NULL THEN 'only_after' WHEN a.key IS NULL THEN 'only_before' WHEN a.v = b.v THEN 'same' ELSE 'changed' END AS state
    FROM b FULL JOIN a ON a.key = b.key""")
def J08_full_outer_states(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    side = lambda c: orders.where(c).groupBy(F.col("o_custkey").alias("key")).agg(F.max("o_orderpriority").alias("v"))
    return sets.pairing(side("o_orderdate < timestamp'1995-01-01'"), side("o_orderdate >= timestamp'1995-01-01'"), "key", "v")


@query("""
    WITH k AS (SELECT o_orderkey AS id, 1 AS e, 0 AS p FROM orders UNION ALL SELECT l_orderkey, 0, 1 FROM lineitem WHERE l_returnflag <> 'R'),
    s AS (SELECT id, sum(e) AS e, sum(p) AS p FROM k GROUP BY id)
    SELECT count(*) FILTER (e > 0 AND p = 0) AS missing, count(*) FILTER (p > 0 AND e = 0) AS extra, count(*) FILTER (e > 1) AS duplicate_expected, count(*) FILTER (p > 1) AS duplicate_produced FROM s""")
def U01_exact_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return sets.coverage_counts(table(spark, sf, "orders").select(F.col("o_orderkey").alias("k")), table(spark, sf, "lineitem").where("l_returnflag != 'R'").select(F.col("l_orderkey").alias("k")), "k")


@query("""
    SELECT user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-15'
    EXCEPT ALL SELECT user_id, event_type FROM events WHERE ts < TIMESTAMP '2024-01-15'""")
def U04_multiset_added(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    pick = lambda c: events.where(c).select("user_id", "event_type")
    return sets.added(pick("ts >= timestamp'2024-01-15'"), pick("ts < timestamp'2024-01-15'"))


@query("""
    SELECT o_orderkey AS id, CASE WHEN n = 0 THEN 'uncovered' ELSE 'overlap' END AS fault FROM (
        SELECT o_orderkey, (o_totalprice < 100000)::INT + (o_totalprice > 90000 AND o_orderstatus <> 'P')::INT AS n FROM orders) WHERE n <> 1
    UNION ALL SELECT -1, 'unknown'""")
def U06_partition_faults(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice", "o_orderstatus")
    stray = spark.createDataFrame([(-1,)], "id bigint")
    return sets.partition_faults(own.select("id"), own.where("o_totalprice < 100000").select("id").union(stray), own.where("o_totalprice > 90000 and o_orderstatus != 'P'").select("id"))


@query("""
    WITH now AS (SELECT c_mktsegment AS dim, count(*) AS c FROM customer GROUP BY 1),
    base AS (SELECT * FROM (VALUES ('AUTOMOBILE', 10, 'lower'), ('BUILDING', 1000000000, 'higher'), ('FURNITURE', 1, 'higher'), ('SPACE', 4, 'lower')) t(dim, b, direction)),
    j AS (SELECT coalesce(now.dim, base.dim) AS dim, coalesce(c, 0) AS current, CAST(coalesce(b, coalesce(c, 0)) AS BIGINT) AS baseline, coalesce(direction, 'lower') AS direction FROM now FULL JOIN base ON now.dim = base.dim)
    SELECT dim, current, baseline, CASE WHEN current = baseline THEN 'same' WHEN (current > baseline) = (direction = 'lower') THEN 'up' ELSE 'down' END AS status FROM j""")
def R03_direction(spark: SparkSession, sf: str) -> DataFrame:
    now = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("dim")).agg(F.count("*").alias("value"))
    base = spark.createDataFrame([("AUTOMOBILE", 10, "lower"), ("BUILDING", 1_000_000_000, "higher"), ("FURNITURE", 1, "higher"), ("SPACE", 4, "lower")], "dim string, value bigint, direction string")
    return gates.ratchet(now, base, unknown="current")


@query("""
    WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS s, o_orderkey % 1500 AS d FROM orders),
    r(node, hops) AS (SELECT c_custkey, 0 FROM customer WHERE c_nationkey = 3 UNION SELECT CAST(e.d AS BIGINT), hops + 1 FROM r JOIN e ON r.node = e.s WHERE hops < 60)
    SELECT node, min(hops) AS hops FROM r GROUP BY node""")
def G05_reachability(spark: SparkSession, sf: str) -> DataFrame:
    edges = table(spark, sf, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") % 1500).alias("dst"))
    return graphs.reach(edges, table(spark, sf, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("node")))


@query("""
    WITH RECURSIVE e AS (SELECT DISTINCT o_orderkey AS a, o_custkey + 10000000000 AS b FROM orders),
    u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    r(id, x) AS (SELECT a, a FROM u UNION SELECT u.b, r.x FROM r JOIN u ON r.id = u.a)
    SELECT id, min(x) AS root FROM r GROUP BY id""")
def G05_components(spark: SparkSession, sf: str) -> DataFrame:
    """Orders that a customer connects, by the least of them."""
    pairs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("a"), (F.col("o_custkey").cast("bigint") + 10_000_000_000).alias("b"))
    return graphs.components(pairs)


@query("""
    WITH w AS (SELECT item_id, list_filter(string_split_regex(trim(text), '\\s+'), lambda x: x <> '') AS ws FROM benchmark),
    g AS (SELECT item_id, array_to_string(ws[i:i + n - 1], ' ') AS gram FROM (SELECT item_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, (SELECT unnest(range(2, 13)) AS n) WHERE len(ws) >= n))
    SELECT gram, count(*) AS occ, count(DISTINCT item_id) AS docs, length(gram) AS chars, count(*) * (length(gram) - 10) AS savings FROM g GROUP BY gram HAVING count(*) >= 3""".replace("\\\\", "\\"))
def D19_ngram_savings(spark: SparkSession, sf: str) -> DataFrame:
    words = F.filter(F.split(F.trim("text"), r"\s+"), lambda x: x != "")
    return mining.savings(table(spark, sf, "benchmark"), words, key="item_id")


@query("""
    WITH b AS (SELECT l_orderkey AS k, list_distinct(list(l_suppkey % 20)) AS xs FROM lineitem GROUP BY 1),
    o AS (SELECT k, xs FROM b WHERE len(xs) >= 4)
    SELECT c.k AS core, w.k AS whole, len(w.xs) - len(c.xs) AS extras FROM o c JOIN o w ON c.k <> w.k AND len(c.xs) < len(w.xs) AND list_has_all(w.xs, c.xs)""")
def D24_subset_bundles(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_set((F.col("l_suppkey") % 20).cast("bigint")).alias("xs"))
    return mining.subsets(own, key="k", items="xs", least=4)


@query("""
    WITH d AS (SELECT trim(p_name) AS t, list_filter(string_split_regex(trim(p_name), '\\s+'), lambda x: x <> '') AS ws FROM part)
    SELECT count(DISTINCT sha256(t)) AS orders, count(DISTINCT sha256(array_to_string(list_sort(ws), ' '))) AS multisets, count(DISTINCT sha256(array_to_string(list_sort(list_distinct(ws)), ' '))) AS sets FROM d""".replace("\\\\", "\\"))
def D25_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "part").select(*mining.fingerprints(F.col("p_name")))
    return own.agg(F.countDistinct("order_key").alias("orders"), F.countDistinct("multiset_key").alias("multisets"), F.countDistinct("set_key").alias("sets"))


@query("""
    WITH n AS (SELECT n_name AS a FROM nation), g AS (SELECT a, [a[i:i + 1] FOR i IN range(1, length(a))] AS bs FROM n)
    SELECT x.a, y.a AS b, CASE WHEN x.a = y.a THEN 1.0 ELSE 2.0 * coalesce(list_sum([least(len(list_filter(x.bs, lambda z: z = t)), len(list_filter(y.bs, lambda z: z = t))) FOR t IN list_distinct(x.bs)]), 0) / (len(x.bs) + len(y.bs)) END AS dice
    FROM g x, g y""")
def D29_dice(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "nation").select("n_name")
    own = names.select(F.col("n_name").alias("a")).crossJoin(names.select(F.col("n_name").alias("b")))
    return own.select("a", "b", mining.dice(F.col("a"), F.col("b")).alias("dice"))


@query("""
    SELECT c_mktsegment, c_custkey, place FROM (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256(c_custkey::VARCHAR), c_custkey) AS place FROM customer) WHERE place <= 10""")
def D31_stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    return mining.stratified(table(spark, sf, "customer").select("c_mktsegment", "c_custkey"), "c_mktsegment", "c_custkey", 10)


@query("""
    WITH c AS (SELECT l_partkey AS key, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT key, n, row_number() OVER w AS rank, sum(n) OVER w / sum(n) OVER () AS share FROM c WINDOW w AS (ORDER BY n DESC, key ROWS UNBOUNDED PRECEDING)""")
def D33_concentration(spark: SparkSession, sf: str) -> DataFrame:
    return mining.concentration(table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("key")).agg(F.count("*").alias("n")), key="key", n="n")


@query("""
    WITH c AS (SELECT p_partkey, (p_partkey * 7919) % 16777216 AS v FROM part),
    ch AS (SELECT p_partkey, printf('#%06x', v) AS hex, (v >> 16) / 255.0 AS r, ((v >> 8) & 255) / 255.0 AS g, (v & 255) / 255.0 AS b FROM c),
    l AS (SELECT p_partkey, hex, 0.2126::DOUBLE * CASE WHEN r <= 0.04045 THEN r / 12.92 ELSE pow((r + 0.055) / 1.055, 2.4) END + 0.7152::DOUBLE * CASE WHEN g <= 0.04045 THEN g / 12.92 ELSE pow((g + 0.055) / 1.055, 2.4) END + 0.0722::DOUBLE * CASE WHEN b <= 0.04045 THEN b / 12.92 ELSE pow((b + 0.055) / 1.055, 2.4) END AS y FROM ch)
    SELECT p_partkey, hex, round(1.05 / (y + 0.05), 4) AS ratio FROM l""")
def X05_contrast(spark: SparkSession, sf: str) -> DataFrame:
    """Colours from keys against white: hex to rgb, luminance, ratio."""
    shown = F.concat(F.lit("#"), F.lower(F.lpad(F.hex((F.col("p_partkey") * 7919) % 16777216), 6, "0")))
    own = table(spark, sf, "part").select("p_partkey", shown.alias("hex"))
    return own.select("p_partkey", "hex", F.round(colour.contrast(colour.hex_rgb(F.col("hex")), colour.hex_rgb(F.lit("#ffffff"))), 4).alias("ratio"))


@query(r"""
    WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages),
    k AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS path FROM pages)
    SELECT href, count(*) AS n, count(DISTINCT page_id) AS pages FROM l WHERE href <> '' AND NOT EXISTS (SELECT 1 FROM k WHERE k.path = regexp_replace(href, '[?#].*$', '')) GROUP BY href""")
def J19_broken_links(spark: SparkSession, sf: str) -> DataFrame:
    """Link targets that are no page's path."""
    pages = table(spark, sf, "pages")
    links = text.matches(pages.select("page_id", "html"), "html", 'href="([^"]*)"', 1, name="href").where("href != ''").groupBy("href").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("pages")).withColumn("path", F.regexp_replace("href", "[?#].*$", ""))
    known = pages.select(F.regexp_extract("url", "^[a-z]+://[^/]+(/[^?#]*)", 1).alias("path")).distinct()
    return links.join(known, "path", "left_anti").select("href", "n", "pages")


_NAMES = (("page.background-color", 100), ("page.color", 100), ("button.primary.background-color", 100), ("button.primary.background-color.hover", 100), ("button.secondary.border-color", 100), ("button.destructive.text", 100), ("field.placeholder", 100), ("data-table.header.background-color", 100), ("divider.border-color", 100), ("focus-ring.outline-color", 100), ("surface-hover", 35), ("static-white", 35), ("border-default", 35))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', {s}, {str(s < 70).lower()})" for n, s in _NAMES) + ") t(name, score, review)")
def D10_name_score(spark: SparkSession, sf: str) -> DataFrame:
    """The law's canonical names and the reviewed ones, with their known scores."""
    return naming.name_scores(spark.createDataFrame([(n,) for n, _ in _NAMES], "name string"))


@query("""
    SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey < b.p_partkey""")
def D15_equal_values(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "part").select(F.col("p_partkey").alias("name"), F.col("p_brand").alias("light"), F.col("p_type").alias("dark"))
    return mining.equal_values(own)


@query("""
    WITH c AS (SELECT DISTINCT c_custkey AS key FROM customer), r AS (SELECT DISTINCT o_custkey + 10 AS key FROM orders)
    SELECT coalesce(c.key, r.key) AS key, CASE WHEN c.key IS NULL THEN 'stop' ELSE 'record' END AS action FROM c FULL JOIN r ON c.key = r.key WHERE c.key IS NULL OR r.key IS NULL""")
def D32_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    return mining.reconcile(table(spark, sf, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf, "orders").select((F.col("o_custkey") + 10).alias("k")), "k")


@query("""
    WITH n AS (SELECT p_partkey AS name FROM part), a AS (SELECT l_partkey AS name, count(*) AS c FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_partkey AS name, count(*) AS c FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45 GROUP BY 1), d AS (SELECT l_partkey AS name, count(*) AS c FROM lineitem WHERE l_quantity < 2 GROUP BY 1)
    SELECT n.name, coalesce(a.c, 0) AS by_class, coalesce(b.c, 0) AS by_variable, coalesce(d.c, 0) AS by_alias, coalesce(a.c, 0) + coalesce(b.c, 0) + coalesce(d.c, 0) = 0 AS dead FROM n LEFT JOIN a USING (name) LEFT JOIN b USING (name) LEFT JOIN d USING (name)""")
def D14_consumption(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").withColumn("name", F.col("l_partkey"))
    return mining.consumption(lines.where("l_returnflag = 'A'"), lines.where("l_returnflag = 'R' and l_quantity > 45"), lines.where("l_quantity < 2"), table(spark, sf, "part").select(F.col("p_partkey").alias("name")))


@query("""
    SELECT r_name, CASE max(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'P' THEN 2 ELSE 3 END) WHEN 1 THEN 'F' WHEN 2 THEN 'P' ELSE 'O' END AS status
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def A13_severest_verdict(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "orders").select("o_custkey", F.col("o_orderstatus").alias("status"))
    own = own.join(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "nation").select("n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region").select("r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey"))
    return gates.severest(own, ["r_name"], "status", ("F", "P", "O"))


@query("SELECT l_partkey, count(*) AS count FROM lineitem GROUP BY l_partkey HAVING count(*) > 1")
def A10_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return sets.duplicates(table(spark, sf, "lineitem"), "l_partkey")
