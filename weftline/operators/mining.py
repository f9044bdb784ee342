"""Mining of class lists and names: n-grams, fingerprints, partitions, bundles, similarity, samples, concentration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import set_key, sorted_key


def ngrams(words: Column, least: int, most: int) -> Column:
    """All runs of ``least`` to ``most`` words of an array, joined by blanks."""
    none = F.array().cast("array<string>")

    def of(n: int) -> Column:
        return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(none)

    return F.concat(*(of(n) for n in range(least, most + 1)))


def savings(docs: DataFrame, words: Column, *, key: str, least: int = 2, most: int = 12, occurrences: int = 3) -> DataFrame:
    """(gram, occ, docs, chars, savings) of the word n-grams that come often enough: occ * (chars - 10)."""
    grams = docs.select(key, F.explode(ngrams(words, least, most)).alias("gram"))
    own = grams.groupBy("gram").agg(F.count("*").alias("occ"), F.countDistinct(key).alias("docs")).where(F.col("occ") >= occurrences)
    chars = F.length("gram")
    return own.select("gram", "occ", "docs", chars.alias("chars"), (F.col("occ") * (chars - 10)).alias("savings"))


def fingerprints(classes: Column) -> list[Column]:
    """Hashes of a class list as it stands, as a multiset and as a set."""
    return [F.sha2(F.trim(classes), 256).alias("order_key"), F.sha2(sorted_key(classes), 256).alias("multiset_key"), F.sha2(set_key(classes), 256).alias("set_key")]


def bigrams(name: Column) -> Column:
    """A name's pairs of neighbouring characters."""
    return F.when(F.length(name) > 1, F.transform(F.sequence(F.lit(1), F.length(name) - 1), lambda i: F.substring(name, i, 2))).otherwise(F.array().cast("array<string>"))


def dice(one: Column, other: Column) -> Column:
    """Dice similarity of two names over their multisets of bigrams; 0 if either has none, 1 for two equal short ones."""
    a, b = bigrams(one), bigrams(other)
    times = lambda x, of: F.size(F.filter(of, lambda y: y == x))
    common = F.aggregate(F.array_distinct(a), F.lit(0), lambda s, x: s + F.least(times(x, a), times(x, b)))
    total = F.size(a) + F.size(b)
    return F.when(one == other, 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(2.0 * common / F.nullif(total, F.lit(0)))


def dispositions(df: DataFrame, rules: list[tuple[str, Column]], rest: str) -> DataFrame:
    """(part, n, total): rows by the first rule that holds; the parts add up to all rows by construction."""
    case = rules and F.when(rules[0][1], rules[0][0])
    for name, rule in rules[1:]:
        case = case.when(rule, name)
    own = df.select((case.otherwise(rest) if rules else F.lit(rest)).alias("part")).groupBy("part").agg(F.count("*").alias("n"))
    return own.withColumn("total", F.sum("n").over(Window.partitionBy()))


#: Members of a group that travel in one row.
_BLOCK = 256


def _blocks(members: DataFrame, keys: list[str], member: str, listed: str) -> DataFrame:
    """(keys, block, listed): each group's members in their order, ``_BLOCK`` a row; members that are null are left out."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(member))
    own = members.where(F.col(member).isNotNull()).withColumn("block", F.floor((place - 1) / _BLOCK).cast("int"))
    return own.groupBy(*keys, "block").agg(F.collect_list(member).alias(listed))


def _spread(blocks: DataFrame) -> DataFrame:
    """Rows that become very many are dealt out to all cores; by their bytes, few tasks would do."""
    spark = blocks.sparkSession
    return blocks.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))


#: Items up to which a bundle's subsets are listed (4,095 at most).
_LISTED = 12


def subsets(bundles: DataFrame, *, key: str, items: str, least: int = 2) -> DataFrame:
    """(core, whole, extras): pairs of bundles of which one's items are all among the other's, and fewer.

    Equal bundles count once until the end. A bundle lists its subsets, which meet the bundles that are equal to them: every meeting is a pair.
    Bundles of more than ``_LISTED`` items are met through the core's two rarest items and compared.
    """
    own = bundles.select(F.col(key).alias("k"), F.array_sort(F.array_distinct(items)).alias("xs")).where(F.size("xs") >= least)
    kinds = own.select("xs").distinct()
    bits = F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), F.size("xs")) - 2)
    masks = F.filter(bits, lambda m: F.bit_count(m) >= least)
    chosen = F.transform(masks, lambda m: F.filter(F.col("xs"), lambda x, i: F.call_function("shiftright", m, i).bitwiseAND(F.lit(1)) == 1))
    listed = kinds.where((F.size("xs") <= _LISTED) & (F.size("xs") > least)).select(F.col("xs").alias("wx"), F.explode(chosen).alias("cx"))
    narrow = listed.join(kinds.select(F.col("xs").alias("cx")), "cx", "left_semi")
    wide = kinds.where(F.size("xs") > _LISTED)
    counts = kinds.select(F.explode("xs").alias("x")).groupBy("x").agg(F.count("*").alias("n"))
    ranked = kinds.select("xs", F.explode("xs").alias("x")).join(counts, "x").groupBy("xs").agg(F.slice(F.array_sort(F.collect_list(F.struct("n", "x"))), 1, 2).alias("r"))
    cores = ranked.select(F.col("xs").alias("cx"), F.array_sort(F.transform("r", lambda r: r["x"])).alias("meet"))
    pairs = F.flatten(F.transform("xs", lambda a, i: F.transform(F.slice(F.col("xs"), i + 2, F.size("xs")), lambda b: F.array(a, b))))
    met = wide.select(F.col("xs").alias("wx"), F.explode(F.concat(pairs, F.transform("xs", lambda x: F.array(x)))).alias("meet")).join(cores, "meet")
    wider = met.where((F.size("cx") < F.size("wx")) & (F.size(F.array_except("cx", "wx")) == 0)).select("wx", "cx")
    found = narrow.select("wx", "cx").union(wider)
    whole = found.join(own.select(F.col("k").alias("whole"), F.col("xs").alias("wx")), "wx")
    return whole.join(own.select(F.col("k").alias("core"), F.col("xs").alias("cx")), "cx").select("core", "whole", (F.size("wx") - F.size("cx")).alias("extras"))


def concentration(counts: DataFrame, *, key: str, n: str) -> DataFrame:
    """(key, n, rank, share): running share of the total, most frequent first.

    Ranks and running sums over all keys are taken on the distinct counts, of which there are few, not on the keys.
    """
    levels = counts.groupBy(F.col(n).alias("n")).agg(F.count("*").alias("keys"))
    order = Window.orderBy(F.desc("n"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    tops = levels.select("n", F.coalesce(F.sum("keys").over(before), F.lit(0)).alias("ranked"), F.coalesce(F.sum(F.col("n") * F.col("keys")).over(before), F.lit(0)).alias("had"), F.sum(F.col("n") * F.col("keys")).over(Window.partitionBy()).alias("total"))
    within = F.row_number().over(Window.partitionBy(F.col("c.n")).orderBy(F.col("c.key")))
    own = counts.select(F.col(key).alias("key"), F.col(n).alias("n")).alias("c").join(tops.alias("t"), F.col("c.n") == F.col("t.n"))
    return own.select("key", F.col("c.n").alias("n"), within.alias("w"), "ranked", "had", "total").select("key", "n", (F.col("ranked") + F.col("w")).alias("rank"), ((F.col("had") + F.col("w") * F.col("n")) / F.col("total")).alias("share"))


def stratified(df: DataFrame, stratum: str, key: str, each: int, total: int | None = None) -> DataFrame:
    """``each`` rows of each stratum in the order of the key's hash, ``total`` at most."""
    order = Window.partitionBy(stratum).orderBy(F.sha2(F.col(key).cast("string"), 256), key)
    own = df.withColumn("place", F.row_number().over(order)).where(F.col("place") <= each)
    return own if total is None else own.orderBy("place", stratum).limit(total)


def top(df: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of each group."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= k)


def equal_values(tokens: DataFrame, *, name: str = "name", values: tuple[str, ...] = ("light", "dark")) -> DataFrame:
    """(a, b): pairs of names with equal values in all themes (D15). Blocks of a group's names meet, each two of them once."""
    own = tokens.select(F.col(name).alias("n"), *values).where(" and ".join(f"`{v}` is not null" for v in values))
    blocks = _blocks(own, list(values), "n", "ns")
    a, b = blocks.select(*values, F.col("block").alias("i"), F.col("ns").alias("a")), blocks.select(*values, F.col("block").alias("j"), F.col("ns").alias("b"))
    met = a.join(b, list(values)).where("i < j or i = j and size(a) > 1").select("a", "b")
    return _spread(met).select(F.explode("a").alias("a"), "b").select("a", F.explode("b").alias("b")).where("a < b")


def reconcile(census: DataFrame, rendered: DataFrame, key: str) -> DataFrame:
    """(key, action) where two sources differ: stop for what is rendered but not counted, record for the reverse."""
    own = census.select(F.col(key).alias("key"), F.lit(1).alias("c")).distinct().join(rendered.select(F.col(key).alias("key"), F.lit(1).alias("r")).distinct(), "key", "full")
    return own.where("c is null or r is null").select("key", F.when(F.col("c").isNull(), "stop").otherwise("record").alias("action"))


def consumption(classes: DataFrame, variables: DataFrame, aliases: DataFrame, names: DataFrame) -> DataFrame:
    """(name, by_class, by_variable, by_alias, dead) of all names: used by none of the three ways is dead."""
    ways = [("by_class", classes), ("by_variable", variables), ("by_alias", aliases)]
    own = names.select("name").distinct()
    for column, df in ways:
        own = own.join(df.groupBy("name").agg(F.count("*").alias(column)), "name", "left").withColumn(column, F.coalesce(column, F.lit(0)))
    return own.withColumn("dead", F.col("by_class") + F.col("by_variable") + F.col("by_alias") == 0)


_LAYOUT = r"^(flex|grid|block|inline|hidden|relative|absolute|items|justify|content|self|gap|space|w|h|min|max|overflow|[mp][xytrbl]?)(-|$)"


def semantic_clusters(entities: DataFrame) -> DataFrame:
    """(cluster, surface, decision, confidence, entities, tags, split, blockers) of entities (entity, classes, tag, roles array) that carry the same
    classes in any order (D20).

    A cluster's surface comes from its tags and classes; blockers are classes of mere layout and the absence of roles within;
    it is to be split where tags differ or it is large. Each blocker and split lowers confidence; only a panel without doubt is a candidate.
    """
    words = F.split(F.trim("classes"), r"\s+")
    key = F.array_join(F.array_sort(F.array_distinct(words)), " ")
    own = entities.select("entity", "tag", F.coalesce("roles", F.array().cast("array<string>")).alias("roles"), key.alias("key"))
    each = own.groupBy("key").agg(F.count("*").alias("entities"), F.array_sort(F.collect_set("tag")).alias("tags"), F.max(F.size("roles")).alias("roles"))
    bare = F.forall(F.split("key", " "), lambda w: w.rlike(_LAYOUT))
    control = F.exists("tags", lambda t: t.isin("a", "button", "input", "select", "textarea"))
    panel = F.col("key").rlike(r"(^| )rounded") & F.col("key").rlike(r"(^| )(border|shadow)") & F.col("key").rlike(r"(^| )bg-")
    surface = F.when(control, "interactive-control").when(panel, "card-or-panel").otherwise("structural")
    blockers = F.array_compact(F.array(F.when(bare | (surface == "structural"), F.lit("generic-structural-classes")), F.when(F.col("roles") == 0, F.lit("no-semantic-child-roles"))))
    split = F.when(F.size("tags") > 1, "tag").when(F.col("entities") > 20, "classHash")
    lost = F.when(split.isNull(), 0).when(F.col("entities") > 40, 11).otherwise(5)
    rows = each.select(F.concat(F.lit("cluster:"), F.substring(F.sha2("key", 256), 1, 16)).alias("cluster"), surface.alias("surface"), "entities", "tags", split.alias("split"), blockers.alias("blockers"), (92 - 14 * F.size(blockers) - lost).cast("int").alias("confidence"))
    decision = F.when((F.col("surface") == "card-or-panel") & (F.col("confidence") >= 70), "style_token_candidate").otherwise("review_required")
    return rows.withColumn("decision", decision)
