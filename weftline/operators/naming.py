"""The naming law: banned words, owners, declared properties, name scores, application scores, contracts."""

from __future__ import annotations

from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline import model
from weftline.functions.text import comments_blanked, lines
from weftline.operators.mining import dice

_VARIANT = r"(?:[a-z-]+:)*"


def _any(words: tuple[str, ...]) -> str:
    return "|".join(words)


def violations(kind: str, df: DataFrame, *, name: Column, detail: Column | None = None) -> DataFrame:
    """Rows in the layout that all checks share."""
    has = set(df.columns)
    return df.select(F.lit(kind).alias("kind"), name.alias("name"), *(F.col(c) if c in has else F.lit(None).cast(t).alias(c) for c, t in (("path", "string"), ("line", "int"), ("locator", "string"))), (F.lit(None).cast("string") if detail is None else detail).alias("detail"))


def banned_classes(source: DataFrame) -> DataFrame:
    """Utility classes that carry a banned word, in .jsx and .tsx lines."""
    rx = rf"\b{_VARIANT}((?:{_any(model.PREFIXES_BANNED)})-(?:{_any(model.BANNED)})-[a-z0-9-]+)"
    own = lines(source.where(F.col("path").rlike(r"\.[jt]sx$")))
    return violations("consumed-class", own.withColumn("n", F.explode(F.regexp_extract_all("content", F.lit(rx), F.lit(1)))), name=F.col("n"))


def banned_properties(css: DataFrame) -> DataFrame:
    """Custom properties with a banned word, where each first stands."""
    own = lines(css).withColumn("n", F.regexp_extract("content", rf"^\s*--([a-z-]*(?:{_any(model.BANNED)})[a-z0-9-]*)\s*:", 1)).where("n != ''")
    first = own.groupBy("path", "n").agg(F.min("line").alias("line"))
    return violations("custom-property", first, name=F.concat(F.lit("--"), F.col("n")))


def banned_groups(tokens: DataFrame) -> DataFrame:
    """Groups with a banned word in the first eligible theme of each tier but the primitive one.

    tokens: (tier, theme, theme_ord, grp) as the document's loader gives it, metadata keys left out.
    """
    first = tokens.where("tier != 'primitive'").withColumn("f", F.min("theme_ord").over(Window.partitionBy("tier"))).where("theme_ord = f")
    bad = first.where(F.exists(F.array(*map(F.lit, model.BANNED)), lambda w: F.col("grp").contains(w))).select("tier", "theme", "grp").distinct()
    return violations("group-in-source", bad.withColumn("locator", F.concat_ws(".", "tier", "theme", "grp")), name=F.col("grp"))


def _code_lines(source: DataFrame) -> DataFrame:
    own = source.where(F.col("path").rlike(r"\.[jt]sx?$")).select("path", comments_blanked(F.col("text")).alias("text"))
    return lines(own).withColumn("content", F.regexp_replace("content", r"\r$", ""))


def longest_owner(names: DataFrame, owners: DataFrame, *, name: str = "name") -> DataFrame:
    """names with ``owner``, the longest of the vocabulary (a small frame of ``owner``) that the name is or begins with up
    to a hyphen; else null (J06). The candidates are the name's own beginnings, so the join is by equality."""
    parts = F.split(name, "-")
    starts = names.select(name).distinct().select(name, F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "-"))).alias("owner"))
    found = starts.join(owners.select("owner").distinct(), "owner").groupBy(name).agg(F.max_by("owner", F.length("owner")).alias("owner"))
    return names.join(found, name, "left")


def foreign_owners(source: DataFrame, owners: DataFrame) -> DataFrame:
    """Names whose beginning isn't an owner of the closed vocabulary (F04); pigments and keywords are exempt."""
    rx = rf"\b{_VARIANT}(?:{_any(model.PREFIXES_OWNER)})-([a-z][a-z0-9-]*)"
    own = _code_lines(source).withColumn("name", F.explode(F.regexp_extract_all("content", F.lit(rx), F.lit(1))))
    bad = longest_owner(own, owners).where(F.col("owner").isNull() & ~F.split("name", "-")[0].isin(*model.EXEMPT))
    return violations("grammar-owner", bad, name=F.col("name"))


def contradicting_prefixes(source: DataFrame) -> DataFrame:
    """Classes whose prefix paints another property than their name declares."""
    rx = rf"\b{_VARIANT}((?:{_any(tuple(model.PREFIX_PROPERTY))})-[a-z][a-z0-9-]*)"
    own = _code_lines(source).withColumn("n", F.explode(F.regexp_extract_all("content", F.lit(rx), F.lit(1))))
    own = own.withColumn("prefix", F.split("n", "-")[0]).withColumn("rest", F.expr("substring(n, length(prefix) + 2)"))
    asks = F.create_map(*(F.lit(x) for kv in model.PREFIX_PROPERTY.items() for x in kv))[F.col("prefix")]
    says = F.coalesce(*(F.when(F.col("rest").endswith(p) | F.col("rest").contains(f"-{p}-"), F.lit(p)) for p in model.PROPERTY_ORDER))
    bad = own.withColumn("asks", asks).withColumn("says", says).where("says is not null and says != asks")
    return violations("prefix-property", bad, name=F.col("n"), detail=F.concat_ws(" ", F.lit("prefix asks for"), "asks", F.lit("- name says"), "says"))


def naming_law(source: DataFrame, css: DataFrame, tokens: DataFrame, owners: DataFrame) -> DataFrame:
    """All violations of the law (R01's input); A01 counts them by kind."""
    from weftline.operators.sets import union

    return union(banned_classes(source), banned_properties(css), banned_groups(tokens), foreign_owners(source, owners), contradicting_prefixes(source))


@cache
def _terms() -> list[tuple[str, str]]:
    slots = (("owner", model.OWNERS), ("variant", model.VARIANTS), ("anatomy", model.ANATOMY), ("property", model.PROPERTIES), ("state", model.STATES))
    return [(t, s) for s, terms in slots for t in terms]


def parse_name(name: str) -> dict[str, str | None]:
    """Slots of a name, read from the left, each time the longest term that fits a slot still open; the rest is ``outside``.

    Slots come in the order entity, variant, anatomy, property, state; hyphens and points separate alike.
    """
    words = name.replace(".", "-").split("-")
    order = ("owner", "variant", "anatomy", "property", "state")
    out: dict[str, str | None] = dict.fromkeys((*order, "outside"))
    rest, i, open_ = [], 0, 0
    while i < len(words):
        fits = [(t.count("-") + 1, -order.index(s), t, s) for t, s in _terms() if order.index(s) >= open_ and out[s] is None and words[i : i + t.count("-") + 1] == t.split("-")]
        if fits:
            n, _, term, slot = max(fits)
            out[slot], open_ = term, order.index(slot) + 1
            i += n
        else:
            rest.append(words[i])
            i += 1
    out["outside"] = "-".join(rest) or None
    return out


_PARSED = pa.struct([(k, pa.string()) for k in ("owner", "variant", "anatomy", "property", "state", "outside")])


def parsed(name: Column) -> Column:
    """The slots of a name as a struct."""
    each = F.arrow_udf(lambda names: pa.array([None if n is None else parse_name(n) for n in names.to_pylist()], _PARSED), "struct<owner: string, variant: string, anatomy: string, property: string, state: string, outside: string>")
    return each(name)


def name_scores(names: DataFrame, *, name: str = "name") -> DataFrame:
    """(name, score, review): points of each name against the law, and whether it is below the cut.

    A word is redundant if its anatomy implies the property, or a written default. A state has its base if the name without it
    is there too, or belongs to a paint property that a resting name may leave out; with no state it holds.
    """
    pts = model.NAME_POINTS
    own = names.select(name).distinct().withColumn("p", parsed(F.col(name)))
    p = F.col("p")
    words = F.split(F.translate(name, ".", "-"), "-")
    pigments = tuple(w for w in model.EXEMPT if w not in ("none", "auto", "inherit", "current", "transparent"))
    context = F.arrays_overlap(words, F.array(*(F.lit(w) for w in (*model.CONTEXT_WORDS, "ui", *pigments))))
    implied = F.create_map(*(F.lit(x) for kv in model.IMPLIED.items() for x in kv))
    paint = p["property"].isin("background-color", "border-color", "box-shadow", "color", "fill", "outline-color", "stroke")
    redundant = F.coalesce((implied[p["anatomy"]] == p["property"]) & p["owner"].isNotNull(), F.lit(False)) | F.coalesce((p["state"] == "default") & p["owner"].isNotNull(), F.lit(False))
    coherent = F.coalesce(~paint | (implied[p["anatomy"]] == p["property"]), F.lit(True))
    score = F.when(p["owner"].isNotNull(), pts["owner"]).otherwise(0) + F.when(~context, pts["no_context"]).otherwise(0) + F.when(~redundant, pts["no_redundant"]).otherwise(0) + F.when(coherent, pts["coherent"]).otherwise(0) + F.lit(pts["state_has_base"]) + F.when(p["outside"].isNull(), pts["nothing_outside"]).otherwise(0)
    return own.select(name, score.cast("int").alias("score"), (score < model.NAME_CUT).alias("review"))


def application_scores(uses: DataFrame) -> DataFrame:
    """uses with ``score``: how a use (name, prefix, state_prefix, component) fits its name, null where the name says neither owner nor property."""
    own = uses.withColumn("p", parsed(F.col("name")))
    p = F.col("p")
    paints = F.create_map(*(F.lit(x) for kv in model.PREFIX_PROPERTY.items() for x in kv))[F.col("prefix")]
    implied = F.create_map(*(F.lit(x) for kv in model.IMPLIED.items() for x in kv))[p["anatomy"]]
    fits = F.coalesce(F.coalesce(p["property"], implied) == paints, F.lit(True))
    same_state = p["state"].eqNullSafe(F.col("state_prefix"))
    owner = F.when(F.coalesce(p["owner"] == F.col("component"), F.lit(True)), 15.0).otherwise(7.5)
    score = F.when(fits, 60.0).otherwise(0.0) + F.when(same_state, 25.0).otherwise(0.0) + owner
    return own.withColumn("score", F.when(p["owner"].isNotNull() | p["property"].isNotNull(), score)).drop("p")


def derive(clusters: DataFrame) -> DataFrame:
    """clusters with ``name`` from their axes and ``route``: named, queue (no owner) or gap (no slot of the law)."""
    name = F.concat_ws(".", "owner", "variant", "anatomy", "property", F.when(F.col("state") != "default", F.col("state")))
    route = F.when(F.col("owner").isNull(), "queue").when(F.col("property").isNull() & F.col("anatomy").isNull(), "gap").otherwise("named")
    return clusters.withColumn("route", route).withColumn("name", F.when(F.col("route") == "named", name))


def removable(names: DataFrame, *, name: str = "name") -> DataFrame:
    """(name, word, collides): for each word of each name, whether the name without it is another's."""
    parts = F.split(name, r"\.")
    own = names.select(name).distinct()
    cut = own.select(name, F.posexplode(parts).alias("i", "word"), parts.alias("ps")).withColumn("shorter", F.array_join(F.concat(F.slice("ps", F.lit(1), F.col("i")), F.expr("slice(ps, i + 2, size(ps))")), "."))
    return cut.join(own.select(F.col(name).alias("shorter"), F.lit(True).alias("hit")), "shorter", "left").select(name, "word", F.coalesce("hit", F.lit(False)).alias("collides"))


def fusion_scores(pairs: DataFrame) -> DataFrame:
    """pairs with ``confidence`` 0 to 100 and ``absorb``.

    Columns of both sides, with 1 and 2 at the end: contract, component, strength (of the owner's signal), tag, role, uses; and delta_e.
    """
    w = model.FUSION
    near = F.col("delta_e") <= model.IMPERCEPTIBLE
    score = F.when(near, w["colour"]).otherwise(0.0) + F.when(F.col("contract1") == F.col("contract2"), w["contract"]).otherwise(0.0) + w["component"] * dice(F.col("component1"), F.col("component2")) + w["owner"] * F.least("strength1", "strength2") + F.when((F.col("tag1") == F.col("tag2")) & F.col("role1").eqNullSafe(F.col("role2")), w["function"]).otherwise(0.0)
    small, large = F.least("uses1", "uses2"), F.greatest("uses1", "uses2")
    return pairs.withColumn("confidence", score).withColumn("absorb", near & (small <= model.OUTLIER_USES) & (small <= model.OUTLIER_SHARE * large))


def decide(scored: DataFrame, *, uncertainty: float = 30.0) -> DataFrame:
    """scored with ``decision``: fuse, absorb or queue; the cut is on uncertainty, 100 less confidence."""
    return scored.withColumn("risk", 100 - F.col("confidence")).withColumn("decision", F.when(F.col("risk") <= uncertainty, "fuse").when(F.col("absorb"), "absorb").otherwise("queue"))
