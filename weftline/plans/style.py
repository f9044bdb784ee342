"""Gates over a source tree: hard-coded style, cohesion, variety, dead and ghost classes, usage."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline import model
from weftline.functions import text as T
from weftline.operators import gates, mining
from weftline.operators.sets import union
from weftline.sources.files import glob_regex

_PREFIX = r"(?:bg|text|border|ring|divide|fill|stroke|from|via|to)"


def hardcode_lines(source: DataFrame, *, allow: DataFrame | None = None, brand: str | None = None) -> DataFrame:
    """(dim, path, line, content): the lines that each dimension of hard-coded style counts.

    Lines with the inline escape, of allowed paths (globs in which * crosses slashes), and with a brand's pattern don't count.
    """
    own = T.lines(_watched(source, allow)).where(_counts(F.col("content"), brand))
    hits = [F.when(_hit(F.col("content"), rx, out), F.lit(d)) for d, rx, out in model.HARDCODE]
    return own.select(F.explode(F.array_compact(F.array(*hits))).alias("dim"), "path", "line", "content")


def _watched(source: DataFrame, allow: DataFrame | None) -> DataFrame:
    """The files that no glob allows. Globs are a short list, written by hand; they become one pattern, so that no join is needed."""
    globs = [] if allow is None else [r["rx"] for r in allow.select(glob_regex(F.col("pattern")).alias("rx")).distinct().collect()]
    return source.where(~F.col("path").rlike("|".join(f"(?:{rx})" for rx in sorted(globs)))) if globs else source


def _counts(content: Column, brand: str | None) -> Column:
    own = ~content.contains("ds-allow:")
    return own & ~content.rlike(f"(?i){brand}") if brand else own


def _hit(content: Column, rx: str, out: str | None) -> Column:
    return content.rlike(rx) & ~content.rlike(out) if out else content.rlike(rx)


def hardcode_counts(source: DataFrame, *, allow: DataFrame | None = None, brand: str | None = None) -> DataFrame:
    """(dim, value) with zeros and the total (A06): how many lines ``hardcode_lines`` lists, counted within each file. A file without any match isn't cut into lines."""
    counted = lambda rx, out: F.size(F.filter(F.split("text", "\n"), lambda x: _counts(x, brand) & _hit(x, rx, out))).cast("bigint")
    each = [F.coalesce(F.sum(F.when(F.col("text").rlike(rx), counted(rx, out))), F.lit(0)).alias(d) for d, rx, out in model.HARDCODE]
    row = _watched(source, allow).agg(*each)
    return gates.with_total(row.select(F.explode(F.array(*(F.struct(F.lit(d).alias("dim"), F.col(f"`{d}`").alias("value")) for d, _, _ in model.HARDCODE))).alias("x")).select("x.*"))


_ROLES = "accent|code-hover|delete-hover|destructive|disable-hover|error|info|premium|primary|selected|success|transparent|warning"
_STATE = "active|dark|disabled|focus|group-hover|hover|lg|light|md|peer|sm|xl"


def cohesion(source: DataFrame) -> DataFrame:
    """(dim, value) of the five axes (A02, A03, F06 to F09), over .jsx and .tsx files."""
    own = source.where(F.col("path").rlike(r"\.[jt]sx$"))
    every = lambda rx: F.regexp_extract_all("text", F.lit(rx), F.lit(0))
    values = own.select(
        F.explode(
            F.concat(
                F.transform(F.filter(F.transform(every(r"hover:bg-[a-z][a-z0-9-]*(?:/\d+)?"), lambda x: F.substring(x, 10, 1 << 20)), lambda x: ~F.split(x, "/")[0].rlike(_ROLES)), lambda x: F.struct(F.lit("hover-neutral-tones").alias("dim"), x.alias("v"))),
                F.transform(F.filter(F.transform(every(r"size=\{\d+\}"), lambda x: F.regexp_extract(x, r"\d+", 0).cast("bigint")), lambda n: n < 28), lambda n: F.struct(F.lit("icon-sizes").alias("dim"), n.cast("string").alias("v"))),
                F.transform(every(r"(?<![a-z:-])bg-(?:surface-[a-z-]+|theme-bg-[a-z-]+|(?:app|sidebar|chatarea|popover|prompt)-bg)"), lambda x: F.struct(F.lit("surface-tokens").alias("dim"), x.alias("v"))),
            )
        ).alias("x")
    ).select("x.*")
    distinct = values.groupBy("dim").agg(F.countDistinct("v").alias("value"))
    content = F.col("content")
    bordered = content.contains("rounded") & ~content.rlike("<input|<textarea|<select|placeholder:") & ~content.rlike(r"\bborder-[tblrxy]\b|\bborder-[tblrxy]-") & content.rlike(r"\bborder-(?:border|theme)-[a-z-]+\b")
    borders = T.lines(own).agg(F.count_if(bordered).alias("value")).select(F.lit("container-border").alias("dim"), "value")
    broken = own.agg(F.coalesce(F.sum(F.regexp_count("text", F.lit(r"\[var\(--color-[a-z0-9-]+\)\]"))), F.lit(0)).alias("n")).union(broken_literals(own))
    tokens = broken.agg(F.sum("n").alias("value")).select(F.lit("broken-token").alias("dim"), "value")
    names = source.sparkSession.createDataFrame([("hover-neutral-tones",), ("icon-sizes",), ("surface-tokens",)], "dim string")
    return names.join(distinct, "dim", "left").select("dim", F.coalesce("value", F.lit(0)).alias("value")).unionByName(borders).unionByName(tokens)


def broken_literals(own: DataFrame) -> DataFrame:
    """One row: variants with nothing behind them, and quotes in the static parts of templates, within className literals."""
    each = own.select(F.explode(T.literals(F.col("text"))).alias("x")).select("x.body", "x.template", T.segments(F.col("x.body")).alias("parts"))
    bare = F.regexp_count("body", F.lit(rf"\b(?:{_STATE}):(?=\s|$)"))
    quotes = F.when(F.col("template"), F.aggregate(F.transform("parts", lambda p: F.regexp_count(p, F.lit('"[a-z-]+:'))), F.lit(0), lambda a, b: a + b)).otherwise(0)
    return each.agg(F.coalesce(F.sum(bare + quotes), F.lit(0)).alias("n"))


_SIDES = "(?:t|b|l|r|s|e|tl|tr|bl|br|ss|se|es|ee)"


def variety_occurrences(source: DataFrame) -> DataFrame:
    """(dim, path, value): everything that the variety gate counts, in one pass over blocks and files."""
    own = source.where(F.col("path").rlike(r"\.jsx?$"))
    sizes = own.select("path", F.explode(F.regexp_extract_all("text", F.lit(r'\bsize=\{?\s*"?(\d{1,3})"?\s*\}?'), F.lit(1))).alias("value")).select(F.lit("icon-sizes").alias("dim"), "path", "value")
    blk = F.col("blk")
    panel = (blk.contains("absolute") | blk.contains("fixed")) & (blk.contains("z-") | blk.contains("shadow")) & ~blk.contains("inset-0")
    found = lambda rx, g: F.regexp_extract_all(blk, F.lit(rx), F.lit(g))
    tag = lambda dim, xs: F.transform(xs, lambda x: F.struct(F.lit(dim).alias("dim"), x.alias("value")))
    rounded = F.transform(found(rf"(?<![\w-])rounded(?:-{_SIDES})?(?:-([a-z0-9][\w.\[\]%#-]*))?(?![\w-])", 1), lambda x: F.coalesce(F.nullif(x, F.lit("")), F.lit("DEFAULT")))
    kinds = F.concat(
        tag("hover-tones", found(r"(?<![\w-])(?:light:|dark:|group-hover:)?hover:bg-([a-z0-9][\w./\[\]%#-]*)", 1)),
        tag("radius-scales", rounded),
        tag("legacy-vocab", found(rf"(?<![\w-]){_PREFIX}-theme-[a-z0-9-]+", 0)),
        tag("panel-surfaces", F.when(panel, found(r"(?<![\w-])bg-([a-z0-9][\w./\[\]%#-]*)", 1)).otherwise(F.array().cast("array<string>"))),
    )
    blocks = own.select("path", F.explode(T.blocks(F.col("text"))).alias("blk")).select("path", F.explode(kinds).alias("x")).select("x.dim", "path", "x.value")
    return sizes.unionByName(blocks)


def variety(source: DataFrame) -> DataFrame:
    """(dim, value): distinct values, but legacy words as often as they come, and the share of .jsx files that use the library, in
    thousandths, which is better higher (A02 to A05)."""
    seen = variety_occurrences(source).groupBy("dim").agg(F.when(F.first("dim") == "legacy-vocab", F.count("*")).otherwise(F.countDistinct("value")).alias("n"))
    names = source.sparkSession.createDataFrame([(d,) for d in ("hover-tones", "icon-sizes", "legacy-vocab", "panel-surfaces", "radius-scales")], "dim string")
    share = source.where(F.col("path").endswith(".jsx")).agg(F.count_if(F.col("text").contains("components/lib/")).alias("p"), F.count("*").alias("w")).select(F.lit("shared-coverage").alias("dim"), gates.permille(F.col("p"), F.col("w")).alias("value"))
    return names.join(seen, "dim", "left").select("dim", F.coalesce("n", F.lit(0)).alias("value")).unionByName(share)


def used_classes(source: DataFrame) -> DataFrame:
    """(name, path): the classes in blocks, with the file in which each comes first: .jsx files before .js, by path."""
    own = source.where(F.col("path").rlike(r"\.jsx?$")).select("path", F.explode(T.blocks(F.col("text"))).alias("b"))
    rx = r"(?<![\w:/.-])((?:[a-z][a-z0-9]*:)*[a-z][a-z0-9]*(?:-[a-z0-9.%\[\]#/_-]+)+)(?![\w-])"
    names = own.select("path", F.explode(F.regexp_extract_all(T.without_interpolation(F.col("b")), F.lit(rx), F.lit(1))).alias("name"))
    kept = names.where(~F.col("name").rlike(r"^(data-|aria-|https?:|w-full$|h-full$)|[${}`]|\.(jsx?|css|png|svg|json)$"))
    order = F.concat(F.when(F.col("path").endswith(".jsx"), "0").otherwise("1"), "path")
    return kept.groupBy("name").agg(F.min_by("path", order).alias("path"))


def ghost_classes(used: DataFrame, css: DataFrame) -> DataFrame:
    """(name, path) of used classes for which the emitted CSS (text) has no selector (J05): also not the important forms.

    The style sheet's selectors are taken out once, so that the join is by equality; a name counts as there if a selector begins with it.
    """
    selectors = css.select(F.explode(F.regexp_extract_all("text", F.lit(r"\.((?:\\.|[A-Za-z0-9_-])+)"), F.lit(1))).alias("s")).distinct()
    plain = selectors.select(F.regexp_replace("s", r"\\(.)", "$1").alias("form"))
    heads = plain.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("form")), lambda k: F.substring(F.col("form"), F.lit(1), k))).alias("form")).distinct()
    bare = F.col("name")
    forms = F.array_distinct(F.array(bare, F.concat(F.lit("!"), bare), F.when(bare.contains(":"), F.regexp_replace(bare, r"^(.*):", "$1:!")).otherwise(bare)))
    there = used.select("name", F.explode(forms).alias("form")).join(heads, "form", "left_semi").select("name").distinct()
    return used.join(there, "name", "left_anti")


def dead_classes(source: DataFrame, colours: DataFrame, scales: DataFrame, css: DataFrame, pairs: DataFrame) -> DataFrame:
    """(vector, name): four kinds of dead class (R06). colours: (name, value) of the configuration; scales: its other (name); css: (text) written by
    hand; pairs: the contract's (name).

    a: theme names that the configuration lacks (J01). b: names used with an alpha whose value has no channel for it (J02). c: pairs
    that the CSS lacks or that the configuration doesn't point to (J04). d: names found nowhere, unless every use of theirs is a literal class (J03).
    """
    own = source.where(F.col("path").rlike(r"\.jsx?$"))
    every = lambda rx, g: F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(rx), F.lit(g)))).alias("name")
    known = colours.select("name").distinct()
    a = own.select(every(rf"(?<![\w-]){_PREFIX}-(theme-[a-z0-9-]+)(?![\w-])", 1)).distinct().join(known, "name", "left_anti").select(F.lit("a").alias("vector"), "name")
    alpha = own.select(every(rf"(?<![\w-]){_PREFIX}-([a-z0-9-]+)/\d+(?![\w-])", 1)).distinct()
    b = alpha.join(colours, "name").where(~F.col("value").contains("<alpha-value>") & ~F.col("name").rlike("^(white|black|transparent)")).select(F.lit("b").alias("vector"), "name")
    names_in_css = css.select(F.explode(F.regexp_extract_all("text", F.lit(r"--([A-Za-z0-9_-]+)\s*:"), F.lit(1))).alias("name")).distinct().withColumn("css", F.lit(True))
    points = F.coalesce(F.instr("value", F.concat(F.lit("--"), F.col("name"), F.lit("-rgb"))) > 0, F.lit(False)) | F.coalesce(F.instr("value", F.concat(F.lit("--"), F.col("name"), F.lit(")"))) > 0, F.lit(False))
    c = pairs.select("name").join(names_in_css, "name", "left").join(colours, "name", "left").where(F.col("css").isNull() | ~points).select(F.lit("c").alias("vector"), "name")
    blocks = own.where(~F.col("path").contains("styles/generated")).select(F.explode(T.blocks(F.col("text"), 4000)).alias("b"))
    uses = blocks.select(F.explode(F.regexp_extract_all("b", F.lit(rf"(?<![\w-])({_PREFIX}-[a-z][a-z0-9]*(?:-[a-z0-9]+)+)(?![\w-])"), F.lit(1))).alias("use")).distinct().withColumn("name", F.regexp_replace("use", "^[a-z]+-", ""))
    builtin = "auto|balance|black|bottom|center|clip|current|dashed|dotted|double|ellipsis|end|hidden|inherit|justify|left|none|nowrap|opacity|pretty|right|solid|start|top|transparent|white|wrap"
    strange = uses.join(known, "name", "left_anti").join(scales.select("name"), "name", "left_anti").where(~F.col("name").rlike(rf"^(?:{builtin})-|^[btlrxyse]-|-\d\d\d?$|^theme-|^(?:spacing|separate|collapse)-"))
    literal = css.select(F.explode(F.regexp_extract_all("text", F.lit(rf"\.(?:[a-z-]+\\?:)*({_PREFIX}-[a-z0-9-]+)"), F.lit(1))).alias("use")).distinct().withColumn("lit", F.lit(True))
    d = strange.join(literal, "use", "left").groupBy("name").agg(F.bool_and(F.col("lit").isNotNull()).alias("all")).where("not all").select(F.lit("d").alias("vector"), "name")
    return union(a, b, c, d)


def area(path: Column) -> Column:
    """The area of a file: pages with two folders, components with one, else the first part."""
    parts = F.split(path, "/")
    return F.when(path.startswith("pages/") & (F.size(parts) > 3), F.array_join(F.slice(parts, 1, 3), "/")).when((path.startswith("pages/") | path.startswith("components/")) & (F.size(parts) > 2), F.array_join(F.slice(parts, 1, 2), "/")).otherwise(parts[0])


def elements(source: DataFrame) -> DataFrame:
    """(path, tag, line, classes, parent_tag, parent_classes) of a source's JSX elements, found by a tolerant scan of its tags."""
    shape = pa.struct([(k, pa.int32() if k == "line" else pa.string()) for k in ("tag", "line", "classes", "parent_tag", "parent_classes")])
    token = re.compile(r"<(/?)([A-Za-z][\w.]*)((?:[^<>\"'{}]|\"[^\"]*\"|'[^']*'|\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\})*?)(/?)>")
    attr = re.compile(r"\bclass(?:Name)?\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|(\{))")

    def scan(text: str) -> list[dict]:
        stack: list[tuple[str, str | None]] = []
        out = []
        for m in token.finditer(text):
            if m[1]:
                while stack and stack.pop()[0] != m[2]:
                    pass
                continue
            a = attr.search(m[3])
            classes = None if a is None else "<dynamic>" if a[3] else a[1] if a[1] is not None else a[2]
            up = stack[-1] if stack else (None, None)
            out.append({"tag": m[2], "line": text.count("\n", 0, m.start()) + 1, "classes": classes, "parent_tag": up[0], "parent_classes": up[1]})
            if not m[4]:
                stack.append((m[2], classes))
        return out

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else scan(t) for t in texts.to_pylist()], pa.list_(shape))

    kind = "array<struct<tag: string, line: int, classes: string, parent_tag: string, parent_classes: string>>"
    return source.select("path", F.explode(F.arrow_udf(run, kind)("text")).alias("x")).select("path", "x.*")


def usage(source: DataFrame, presets: list[tuple[str, str]]) -> DataFrame:
    """(variant, n, parent_gap, areas, tags): elements by the first preset whose pattern their classes match."""
    case = F.lit("other")
    for name, rx in reversed(presets):
        case = F.when(F.col("classes").rlike(rx), name).otherwise(case)
    own = elements(source).where("classes is not null").withColumn("variant", case).withColumn("area", area(F.col("path")))
    gap = F.coalesce(F.col("parent_classes").rlike(r"(^|\s)gap-"), F.lit(False))
    areas = mining.top(own.groupBy("variant", "area").agg(F.count("*").alias("n")), ["variant"], 6, F.desc("n"), F.col("area")).groupBy("variant").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "area", "n"))), lambda x: F.struct(x["area"].alias("area"), x["n"].alias("n"))).alias("areas"))
    tags = own.groupBy("variant", "tag").agg(F.count("*").alias("n")).groupBy("variant").agg(F.map_from_entries(F.collect_list(F.struct("tag", "n"))).alias("tags"))
    return own.groupBy("variant").agg(F.count("*").alias("n"), F.count_if(gap).alias("parent_gap")).join(areas, "variant").join(tags, "variant")


def scanned_share(scanned: DataFrame, eligible: DataFrame, least: float = 0.8) -> DataFrame:
    """One row: how many of the eligible files were scanned, and whether that is enough (D21); no eligible file isn't."""
    own = eligible.select("path").distinct().join(scanned.select("path", F.lit(1).alias("s")).distinct(), "path", "left").agg(F.count("s").alias("scanned"), F.count("*").alias("eligible"))
    return own.withColumn("ok", F.coalesce(F.col("scanned") / F.nullif("eligible", F.lit(0)) >= least, F.lit(False)))


def class_partition(uses: DataFrame) -> DataFrame:
    """(part, n, total) of class uses (key, classes, lawful): A in law, B1 repeated bundles, B2 single utilities that repeat, C the rest.

    An entity is a bundle of four classes at least that comes twice at least."""
    size = F.size(F.split(F.trim("classes"), r"\s+"))
    own = uses.withColumn("times", F.count("*").over(Window.partitionBy(T.sorted_key(F.col("classes")))))
    return mining.dispositions(own, [("A", F.col("lawful")), ("B1", (F.col("times") >= 2) & (size >= 4)), ("B2", F.col("times") >= 2)], "C")
