"""Text, document and set operators over the shared tables, each with the SQL that says the same.

Keys are operators' ids. Every query reads its whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import text
from weftline.operators import mining, sets
from weftline.plans import routes
from weftline.plans.tables import query, table
from weftline.sources import files
from weftline.sources.sinks import tally_faults


@query(r"""
    WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)
    SELECT page_id, string_split(href, '#')[1] AS target, count(*) AS n FROM h
    WHERE NOT regexp_matches(href, '^[a-z][a-z0-9+.-]*:') AND string_split(href, '#')[1] <> '' GROUP BY ALL""")
def P11_links(spark: SparkSession, sf: str) -> DataFrame:
    """Link targets without fragments and other schemes, with their number on each page."""
    own = text.matches(table(spark, sf, "pages").select("page_id", "html"), "html", 'href="([^"]*)"', 1, name="href").where(~F.col("href").rlike("^[a-z][a-z0-9+.-]*:"))
    return own.select("page_id", F.element_at(F.split("href", "#"), 1).alias("target")).where("target != ''").groupBy("page_id", "target").agg(F.count("*").alias("n"))


@query(r"""
    SELECT regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), ''), '/') AS stable, count(*) AS n FROM pages GROUP BY 1""")
def P27_stable_url(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(routes.stable_url(F.col("url")).alias("stable")).groupBy("stable").agg(F.count("*").alias("n"))


@query(r"""
    SELECT substr(trim(regexp_replace(string_split(text, chr(10))[1], 'https?://[^\s]+', '', 'g')), 1, 160) AS signature, count(*) AS n FROM conversations GROUP BY 1""")
def P25_error_signature(spark: SparkSession, sf: str) -> DataFrame:
    """What conversations begin with, as errors are told apart: the first line without URLs, cut."""
    return table(spark, sf, "conversations").select(text.signature(F.col("text")).alias("signature")).groupBy("signature").agg(F.count("*").alias("n"))


@query(r"""
    SELECT c_custkey, list_sort(list_distinct(regexp_extract_all('/c/:' || lower(c_mktsegment) || '/n/:nation' || c_nationkey || '/:id', ':([A-Za-z0-9_]+)', 1))) AS params FROM customer""")
def P20_route_parameters(spark: SparkSession, sf: str) -> DataFrame:
    pattern = F.concat(F.lit("/c/:"), F.lower("c_mktsegment"), F.lit("/n/:nation"), F.col("c_nationkey").cast("string"), F.lit("/:id"))
    return table(spark, sf, "customer").select("c_custkey", routes.parameters(pattern).alias("params"))


@query(r"""
    SELECT page_id, CASE WHEN p[1] = 'fr' AND len(p) >= 2 THEN array_to_string(p[1:2], '/') ELSE p[1] END AS area FROM (
        SELECT page_id, list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/'), lambda x: x <> '') AS p FROM pages)""")
def P09_area_of_path(spark: SparkSession, sf: str) -> DataFrame:
    """The area of a page's path: one language's pages with two parts, others with one."""
    path = F.regexp_extract("url", "^[a-z]+://[^/?#]+([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return table(spark, sf, "pages").select("page_id", parts.alias("p")).select("page_id", F.when((F.get("p", F.lit(0)) == "fr") & (F.size("p") >= 2), F.array_join(F.slice("p", 1, 2), "/")).otherwise(F.get("p", F.lit(0))).alias("area"))


@query("""
    SELECT url, count(*) AS n FROM pages WHERE NOT EXISTS (SELECT 1 FROM (VALUES ('%m.%'), ('%/de/%.html'), ('%blog.%example.net/es/%')) g(p) WHERE url LIKE p) GROUP BY url""")
def F13_glob_allowlist(spark: SparkSession, sf: str) -> DataFrame:
    """Paths that no glob of an allow-list covers; a star crosses slashes."""
    globs = spark.createDataFrame([("*m.*",), ("*/de/*.html",), ("*blog.*example.net/es/*",)], "pattern string").select(files.glob_regex(F.col("pattern")).alias("rx"))
    own = table(spark, sf, "pages").select("url")
    return own.join(globs, F.expr("url rlike rx"), "left_anti").groupBy("url").agg(F.count("*").alias("n"))


@query(r"""
    SELECT conv_id, turn, length(text) > 0 AND length(text) <= 512 AND trim(text) = text AND NOT regexp_matches(text, '[\x00-\x1f\x7f]') AS valid FROM conversations""")
def F19_valid_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", text.is_scenario(F.col("text")).alias("valid"))


@query("""
    SELECT CASE WHEN n_chars < 200 THEN 'short' WHEN text LIKE '%!!%' THEN 'shouting' WHEN lang <> 'en' THEN 'foreign' ELSE 'plain' END AS part, count(*) AS n, (SELECT count(*) FROM documents) AS total FROM documents GROUP BY 1""")
def D23_terminal_disposition(spark: SparkSession, sf: str) -> DataFrame:
    return mining.dispositions(table(spark, sf, "documents"), [("short", F.col("n_chars") < 200), ("shouting", F.col("text").contains("!!")), ("foreign", F.col("lang") != "en")], "plain")


@query("""
    SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY user_id""")
def A09_state_histogram(spark: SparkSession, sf: str) -> DataFrame:
    kinds = ("click", "purchase", "view")
    return table(spark, sf, "events").groupBy("user_id").agg(*(F.count_if(F.col("event_type") == k).alias(k) for k in kinds))


@query("""
    SELECT name, min_by(page_id, url) AS page_id, min(url) AS url FROM (SELECT unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS name, page_id, url FROM pages) GROUP BY name""")
def A07_first_location(spark: SparkSession, sf: str) -> DataFrame:
    """Where each name comes first in the order of paths."""
    own = table(spark, sf, "pages").select("page_id", "url", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), F.lit(1)))).alias("name"))
    return own.groupBy("name").agg(F.min(F.struct("url", "page_id")).alias("x")).select("name", "x.page_id", "x.url")


@query("""
    SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') > 0 AS returned, count(*) FILTER (l_discount > 0.05) - count(*) FILTER (l_tax > 0.05) AS delta FROM lineitem GROUP BY 1""")
def A14_deltas(spark: SparkSession, sf: str) -> DataFrame:
    """Differences of two counts for each key, and whether a severe kind came at all."""
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg((F.count_if(F.col("l_returnflag") == "R") > 0).alias("returned"), (F.count_if(F.col("l_discount") > 0.05) - F.count_if(F.col("l_tax") > 0.05)).alias("delta"))


@query("""
    WITH f AS (SELECT l_suppkey AS name, count(*) AS found FROM lineitem GROUP BY 1), e AS (SELECT ps AS name, 600 AS expected FROM (SELECT s_suppkey AS ps FROM supplier))
    SELECT coalesce(f.name, e.name) AS name, coalesce(found, 0) AS found, CAST(coalesce(expected, 0) AS BIGINT) AS expected FROM f FULL JOIN e ON f.name = e.name WHERE coalesce(found, 0) <> coalesce(expected, 0)""")
def A15_tally_faults(spark: SparkSession, sf: str) -> DataFrame:
    found = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("name")).agg(F.count("*").alias("n"))
    return tally_faults(found, table(spark, sf, "supplier").select(F.col("s_suppkey").alias("name"), F.lit(600).cast("bigint").alias("n")))


@query("""
    SELECT n_nationkey, coalesce(CASE WHEN r_regionkey > 2 THEN n_name END, r_name) AS shown FROM nation JOIN region ON n_regionkey = r_regionkey""")
def J07_own_else_base(spark: SparkSession, sf: str) -> DataFrame:
    """A value of one's own, else the base's."""
    own = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return own.select("n_nationkey", F.coalesce(F.when(F.col("r_regionkey") > 2, F.col("n_name")), F.col("r_name")).alias("shown"))


@query("""
    SELECT c_nationkey, c_mktsegment, count(*) AS n, CASE WHEN reason IS NULL THEN 'unwaived' ELSE 'waived' END AS state FROM customer
    LEFT JOIN (VALUES (3, 'BUILDING', 'moved'), (7, 'MACHINERY', 'agreed')) w(k, s, reason) ON c_nationkey = k AND c_mktsegment = s GROUP BY ALL""")
def J12_waivers(spark: SparkSession, sf: str) -> DataFrame:
    """Differences matched with waivers on all their fields; what isn't matched is unwaived."""
    waivers = spark.createDataFrame([(3, "BUILDING", "moved"), (7, "MACHINERY", "agreed")], "c_nationkey int, c_mktsegment string, reason string")
    own = table(spark, sf, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    return own.join(waivers, ["c_nationkey", "c_mktsegment"], "left").select("c_nationkey", "c_mktsegment", "n", F.when(F.col("reason").isNull(), "unwaived").otherwise("waived").alias("state"))


@query("""
    WITH p AS (SELECT conv_id, list_distinct(list(role)) AS roles FROM conversations GROUP BY 1)
    SELECT conv_id, list_sort(list_filter(['assistant', 'system', 'user'], lambda x: NOT list_contains(roles, x))) AS missing, list_sort(list_filter(roles, lambda x: NOT list_contains(['assistant', 'system', 'user'], x))) AS unexpected FROM p""")
def J15_missing_and_unexpected(spark: SparkSession, sf: str) -> DataFrame:
    """Set differences both ways between what a group has and what it must have."""
    must = F.array(*map(F.lit, ("assistant", "system", "user")))
    own = table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("roles"))
    return own.select("conv_id", F.array_sort(F.array_except(must, "roles")).alias("missing"), F.array_sort(F.array_except("roles", must)).alias("unexpected"))


@query("""
    SELECT coalesce(b.k, a.k) AS path, CASE WHEN b.k IS NULL THEN 'extra' WHEN a.k IS NULL THEN 'missing' ELSE 'changed' END AS change
    FROM (SELECT c_custkey AS k, sha256(c_mktsegment) AS h FROM customer) b FULL JOIN (SELECT o_custkey AS k, sha256(min(o_orderpriority)) AS h FROM orders GROUP BY 1) a ON a.k = b.k
    WHERE b.h IS NULL OR a.h IS NULL OR b.h <> a.h""")
def U02_inventory_drift(spark: SparkSession, sf: str) -> DataFrame:
    before = table(spark, sf, "customer").select(F.col("c_custkey").alias("path"), F.sha2("c_mktsegment", 256).alias("sha256"))
    after = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("path")).agg(F.sha2(F.min("o_orderpriority"), 256).alias("sha256"))
    return sets.drift(before, after)


@query("""
    SELECT user_id, event_type, CAST(minute(ts) AS INT) AS minute FROM events WHERE ts >= TIMESTAMP '2024-01-15' EXCEPT SELECT user_id, event_type, CAST(minute(ts) AS INT) FROM events WHERE ts < TIMESTAMP '2024-01-15'""")
def U05_set_difference(spark: SparkSession, sf: str) -> DataFrame:
    """Unlike the multiset difference, each new pair once."""
    events = table(spark, sf, "events")
    pick = lambda c: events.where(c).select("user_id", "event_type", F.minute("ts").alias("minute"))
    return pick("ts >= timestamp'2024-01-15'").subtract(pick("ts < timestamp'2024-01-15'"))


@query("""
    SELECT l_orderkey, l_suppkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber, l_partkey) AS n FROM lineitem) WHERE n = 1""")
def U10_first_finding(spark: SparkSession, sf: str) -> DataFrame:
    """The first of all findings with one key, in the checks' order."""
    own = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_partkey")
    return sets.first_by(own, ["l_orderkey", "l_suppkey"], F.col("l_linenumber"), F.col("l_partkey")).drop("l_partkey")


@query(r"""
    SELECT doc_id, regexp_replace(text, '\n[ \t]*(\n[ \t]*)+\n', chr(10) || chr(10), 'g') = text AS single, len(list_filter(list_zip(ls[1:len(ls) - 1], ls[2:]), lambda x: trim(x[1]) = '' AND trim(x[2]) = '')) AS runs
    FROM (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents)""")
def W04_blank_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a text has no two blank lines together, and how many such neighbours it has."""
    ls = F.split("text", "\n")
    own = table(spark, sf, "documents").select("doc_id", "text", ls.alias("ls"))
    runs = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.size("ls") - 1, F.lit(1))), lambda i: (F.size("ls") > 1) & (F.trim(F.get("ls", i - 1)) == "") & (F.trim(F.coalesce(F.get("ls", i), F.lit("x"))) == "")))
    return own.select("doc_id", (F.regexp_replace("text", r"\n[ \t]*(\n[ \t]*)+\n", "\n\n") == F.col("text")).alias("single"), runs.cast("bigint").alias("runs"))


@query("""
    WITH l AS (SELECT conv_id, turn, role, text FROM conversations), b AS (SELECT conv_id, turn, min(text) AS x FROM l WHERE role = 'user' GROUP BY ALL), a AS (SELECT conv_id, turn - 1 AS turn, min(text) AS y FROM l WHERE role <> 'user' GROUP BY ALL)
    SELECT coalesce(b.conv_id, a.conv_id) AS conv_id, min(coalesce(b.turn, a.turn)) AS line FROM b FULL JOIN a ON b.conv_id = a.conv_id AND b.turn = a.turn WHERE x IS DISTINCT FROM y GROUP BY 1""")
def W05_first_difference(spark: SparkSession, sf: str) -> DataFrame:
    """The first line in which two texts differ: what users say against what follows."""
    own = table(spark, sf, "conversations")
    before = own.where("role = 'user'").groupBy("conv_id", "turn").agg(F.min("text").alias("x"))
    after = own.where("role != 'user'").groupBy("conv_id", (F.col("turn") - 1).alias("turn")).agg(F.min("text").alias("y"))
    return before.join(after, ["conv_id", "turn"], "full").where(~F.col("x").eqNullSafe(F.col("y"))).groupBy("conv_id").agg(F.min("turn").alias("line"))


@query("""
    SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS place FROM orders""")
def O01_order_within(spark: SparkSession, sf: str) -> DataFrame:
    """Places by number, then by name."""
    return table(spark, sf, "orders").select("o_orderkey", F.row_number().over(Window.partitionBy("o_orderstatus").orderBy("o_totalprice", "o_orderkey")).cast("bigint").alias("place"))


@query("""
    SELECT p_partkey, list_sort(list_transform(regexp_extract_all(p_name || ' ' || p_partkey || ' ' || (p_partkey * 7) % 1000, '[0-9]+'), lambda x: x::BIGINT)) AS numbers FROM part""")
def O04_numeric_order(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers in texts, in the order of their values."""
    shown = F.concat_ws(" ", F.col("p_name"), F.col("p_partkey").cast("string"), ((F.col("p_partkey") * 7) % 1000).cast("string"))
    return table(spark, sf, "part").select("p_partkey", F.array_sort(F.transform(F.regexp_extract_all(shown, F.lit("[0-9]+"), F.lit(0)), lambda x: x.cast("bigint"))).alias("numbers"))


@query("SELECT lower(sha256(text)) AS digest, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1")
def X10_content_digest(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


@query(r"""
    SELECT p_partkey, array_to_string(list_sort(string_split_regex(trim(p_name), '\s+')), ' ') AS key, regexp_replace(p_type || ':' || p_name || '/50%', '([:/.\[\]%#!])', '\\\1', 'g') AS selector FROM part""")
def X14_class_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Order-free keys that keep repeats, and names as CSS selectors."""
    return table(spark, sf, "part").select("p_partkey", text.sorted_key(F.col("p_name")).alias("key"), text.selector(F.concat("p_type", F.lit(":"), "p_name", F.lit("/50%"))).alias("selector"))
