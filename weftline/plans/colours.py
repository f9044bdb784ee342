"""Colour gates: the pair contract, pairs at their point of use, declared pairs and mirrored tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline import model
from weftline.functions import colour as C
from weftline.functions.text import utility
from weftline.operators.graphs import cascade, resolve_aliases

_TONES = ("destructive", "info", "premium", "primary", "success", "surface-selected", "warning")
_WHITE = ("destructive", "info", "premium", "primary", "success")
_SOFT = ("destructive", "info", "premium", "success", "warning")


def contract(declarations: DataFrame, *, base: str = "dark") -> DataFrame:
    """(theme, pair, kind, ratio, verdict) of the contract's pairs in every theme (R07, J25): ok, violates, skipped where a colour can't be
    resolved, or missing where a name isn't declared. declarations: (theme, name, value, file_ord, pos), of which the first counts.
    """
    spark = declarations.sparkSession
    colours = resolve_aliases(cascade(declarations, last=False), base=base).select("theme", "name", C.parse(F.col("value")).alias("rgb"), F.lower("value").alias("value"))
    rows = [(t, t, f"{t}-foreground", "label", 4.5, t in _WHITE) for t in _TONES] + [(f"{t}-soft", f"{t}-soft", f"{t}-soft-foreground", "soft", 4.5, False) for t in _SOFT] + [(f"{t}-fill", f"{t}-fill", "muted", "fill", 3.0, False) for t in _SOFT]
    pairs = spark.createDataFrame(rows, "pair string, one string, other string, kind string, least double, white boolean")
    grid = declarations.select("theme").distinct().crossJoin(pairs)
    side = lambda k: colours.select("theme", F.col("name").alias(k), F.col("rgb").alias(f"{k}_rgb"), F.lit(True).alias(f"{k}_there"))
    own = grid.join(side("one"), ["theme", "one"], "left").join(side("other"), ["theme", "other"], "left")
    ratio = C.contrast(F.col("one_rgb"), F.col("other_rgb"))
    white = ~F.col("white") | C.to_hex(F.col("other_rgb")).isin(*model.WHITES)
    verdict = F.when(F.col("one_there").isNull() | F.col("other_there").isNull(), "missing").when(ratio.isNull(), "skipped").when((ratio >= F.col("least")) & white, "ok").otherwise("violates")
    return own.select("theme", "pair", "kind", ratio.alias("ratio"), verdict.alias("verdict"))


def contract_outcome(rows: DataFrame) -> DataFrame:
    """One row: 1 for violations or where nothing was evaluated, 2 where pairs were skipped, else 0. Fills don't count as evaluated."""
    own = rows.agg(F.count_if(F.col("verdict") == "violates").alias("violations"), F.count_if((F.col("kind") != "fill") & (F.col("verdict") != "missing")).alias("evaluated"), F.count_if((F.col("kind") != "fill") & (F.col("verdict") == "skipped")).alias("skipped"))
    return own.withColumn("exit_code", F.when((F.col("violations") > 0) | (F.col("evaluated") == 0), 1).when(F.col("skipped") > 0, 2).otherwise(0))


def evaluate(pairs: DataFrame, colours: DataFrame) -> DataFrame:
    """(text, bg, theme, ratio, passed, note) of text on a background in each theme (R08, X06). pairs: (text, bg, non_text, under) of utility classes;
    colours: (theme, name, rgb), of tokens before palette.

    A translucent background is laid on ``under``; if that isn't known the pair fails with null. Otherwise unknown colours give null, which
    is no pass and no failure. Ratios are rounded before they are compared.
    """
    own = pairs.withColumn("t", utility(F.col("text"))).withColumn("b", utility(F.col("bg"))).crossJoin(colours.select("theme").distinct())
    side = lambda k, key: colours.select(F.col("theme"), F.col("name").alias(key), F.col("rgb").alias(k))
    own = own.withColumn("tn", F.col("t.body")).withColumn("bn", F.col("b.body"))
    own = own.join(side("trgb", "tn"), ["theme", "tn"], "left").join(side("brgb", "bn"), ["theme", "bn"], "left").join(side("urgb", "under"), ["theme", "under"], "left")
    clear = F.col("b.alpha") < 1
    lost = clear & F.col("brgb").isNotNull() & F.col("urgb").isNull()
    under = F.when(clear, C.over(F.col("brgb"), F.col("b.alpha"), F.col("urgb"))).otherwise(F.col("brgb"))
    top = F.when(F.col("t.alpha") < 1, C.over(F.col("trgb"), F.col("t.alpha"), under)).otherwise(F.col("trgb"))
    ratio = C.contrast(top, under, digits=2)
    least = F.when(F.col("non_text"), model.CONTRAST_OTHER).otherwise(model.CONTRAST_TEXT)
    note = F.when(lost, "unresolved-under").when(ratio.isNull(), "unresolved")
    return own.select("text", "bg", "theme", ratio.alias("ratio"), (ratio >= least).alias("passed"), note.alias("note"))


def evaluated_outcome(rows: DataFrame) -> DataFrame:
    """(text, bg, ok, fails): a pair holds if no theme fails and at least one was resolved."""
    bad = (F.col("note") == "unresolved-under") | ~F.col("passed")
    own = rows.groupBy("text", "bg").agg(F.array_sort(F.collect_list(F.when(bad, F.col("theme")))).alias("fails"), F.count("ratio").alias("resolved"))
    return own.select("text", "bg", ((F.size("fails") == 0) & (F.col("resolved") > 0)).alias("ok"), "fails")


def declared_pairs(declarations: DataFrame, pairs: DataFrame, mirrors: DataFrame, *, base: str = ":root") -> DataFrame:
    """(what, theme, category, detail) of declared pairs (label, fg, bg, least) and mirrored tokens (hex, rgb) (R09): ok, regression, or error where
    a token is missing, in a cycle, or no colour. The last declaration counts, and the older luminance threshold."""
    values = resolve_aliases(cascade(declarations), base=base).select("theme", "name", "status", "value", C.parse(F.col("value")).alias("rgb"))
    channels = F.transform(F.filter(F.split(F.trim("value"), r"[\s,]+"), lambda x: x != ""), lambda x: x.try_cast("int"))
    values = values.withColumn("bare", F.when(F.size(channels) == 3, C.rgb(channels[0], channels[1], channels[2])))
    themes = declarations.select("theme").distinct()
    side = lambda k, key, v: values.select("theme", F.col("name").alias(key), F.col(v).alias(k))
    p = pairs.crossJoin(themes).join(side("f", "fg", "rgb"), ["theme", "fg"], "left").join(side("b", "bg", "rgb"), ["theme", "bg"], "left").withColumn("ratio", C.contrast(F.col("f"), F.col("b"), linear=C.LINEAR_OLD))
    first = p.select(F.col("label").alias("what"), "theme", F.when(F.col("ratio").isNull(), "error").when(F.col("ratio") >= F.col("least"), "ok").otherwise("regression").alias("category"), F.round("ratio", 2).cast("string").alias("detail"))
    m = mirrors.crossJoin(themes).join(side("h", "hex", "rgb"), ["theme", "hex"], "left").join(side("r", "rgb", "bare"), ["theme", "rgb"], "left")
    second = m.select(F.concat_ws(" = ", "hex", "rgb").alias("what"), "theme", F.when(F.col("h").isNull() | F.col("r").isNull(), "error").when(F.col("h") == F.col("r"), "ok").otherwise("regression").alias("category"), C.to_hex(F.col("h")).alias("detail"))
    return first.unionByName(second)


def declared_outcome(rows: DataFrame) -> DataFrame:
    """One row: 2 if anything couldn't be evaluated, else 1 for regressions, else 0."""
    return rows.agg(F.when(F.count_if(F.col("category") == "error") > 0, 2).when(F.count_if(F.col("category") == "regression") > 0, 1).otherwise(0).alias("exit_code"))


def differences(tokens: DataFrame, *, name: str = "name") -> DataFrame:
    """(a, b, theme, delta_e, pattern) of token pairs in each theme, and whether they are alike in all themes, in one, or nowhere.
    tokens: (name, theme, rgb)."""
    own = tokens.select(F.col(name).alias("n"), "theme", C.lab(F.col("rgb")).alias("lab")).where("lab is not null")
    a, b = own.select(F.col("n").alias("a"), "theme", F.col("lab").alias("x")), own.select(F.col("n").alias("b"), "theme", F.col("lab").alias("y"))
    pairs = a.join(b, "theme").where("a < b").withColumn("delta_e", C.delta_e(F.col("x"), F.col("y")))
    from pyspark.sql import Window

    w = Window.partitionBy("a", "b")
    near: Column = F.count_if(F.col("delta_e") < model.IMPERCEPTIBLE).over(w)
    return pairs.select("a", "b", "theme", "delta_e", F.when(near == F.count("*").over(w), "all").when(near > 0, "one").otherwise("none").alias("pattern"))


#: Neutral ramps of the utility palette, from stop 50 to 950.
RAMPS = {
    "stone": "fafaf9 f5f5f4 e7e5e4 d6d3d1 a8a29e 78716c 57534e 44403c 292524 1c1917 0c0a09",
    "neutral": "fafafa f5f5f5 e5e5e5 d4d4d4 a3a3a3 737373 525252 404040 262626 171717 0a0a0a",
    "zinc": "fafafa f4f4f5 e4e4e7 d4d4d8 a1a1aa 71717a 52525b 3f3f46 27272a 18181b 09090b",
    "gray": "f9fafb f3f4f6 e5e7eb d1d5db 9ca3af 6b7280 4b5563 374151 1f2937 111827 030712",
    "slate": "f8fafc f1f5f9 e2e8f0 cbd5e1 94a3b8 64748b 475569 334155 1e293b 0f172a 020617",
}


def palette(spark: SparkSession) -> DataFrame:
    """(name, value) of the palette's neutral colours, white and black; transparent has no value."""
    stops = (50, *range(100, 1000, 100), 950)
    rows = [(f"{family}-{stop}", f"#{value}") for family, ramp in RAMPS.items() for stop, value in zip(stops, ramp.split(), strict=True)]
    return spark.createDataFrame([*rows, ("white", "#ffffff"), ("black", "#000000"), ("transparent", None)], "name string, value string")


def named_colours(tokens: DataFrame) -> DataFrame:
    """(theme, name, rgb) of all names that a class can paint with: the tokens (theme, name, value) that the style sheets declare, then the palette
    in every theme (H20). A token hides a palette colour of its name, even where its own value can't be resolved."""
    basic = tokens.select("theme").distinct().crossJoin(palette(tokens.sparkSession)).join(tokens.select("theme", "name"), ["theme", "name"], "left_anti")
    return tokens.select("theme", "name", "value").unionByName(basic.select("theme", "name", "value")).select("theme", "name", C.parse(F.col("value")).alias("rgb"))
