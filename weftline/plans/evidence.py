"""Before and after captures: matrix, manifests, pixels, comparison, review, composition."""

from __future__ import annotations

import hashlib
import json
import re
import struct
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline import model
from weftline.functions.text import is_digest, is_scenario
from weftline.operators.sets import coverage, first_by, partition_faults, union


class ContractError(ValueError):
    """Evidence that doesn't bind, cover or verify; fails closed."""


def matrix(scenarios: DataFrame, dims: dict[str, list[str]]) -> DataFrame:
    """(id, scenario, a column for each dimension) of every combination."""
    own = scenarios.select("scenario").distinct()
    for name, values in dims.items():
        if not values or len(set(values)) != len(values):
            raise ContractError(f"{name}: empty or repeated values")
        own = own.crossJoin(own.sparkSession.createDataFrame([(v,) for v in values], f"`{name}` string"))
    return own.withColumn("id", F.concat_ws("::", "scenario", *(F.concat(F.lit(f"{n}/"), F.col(n)) for n in dims)))


def select(scenarios: DataFrame, dims: dict[str, list[str]], wanted: dict[str, list[str]], ids: list[str] | None = None) -> DataFrame:
    """The part of the matrix that was asked for (R15); unknown values or ids, repeats and an empty part are errors."""
    for name, values in wanted.items():
        if name not in dims or set(values) - set(dims[name]) or len(set(values)) != len(values):
            raise ContractError(f"unknown or repeated {name}: {values}")
    own = matrix(scenarios, {k: wanted.get(k, v) for k, v in dims.items()})
    if ids is not None:
        asked = own.sparkSession.createDataFrame([(i,) for i in ids], "scenario string")
        lost = [r[0] for r in asked.join(scenarios, "scenario", "left_anti").collect()]
        if lost or len(set(ids)) != len(ids):
            raise ContractError(f"unknown or repeated scenarios: {lost}")
        own = own.join(asked, "scenario", "left_semi")
    if own.isEmpty():
        raise ContractError("nothing was selected")
    return own


def stem(scenario: Column, readable: int = 96, digest: int = 16) -> Column:
    """A file name for a scenario: its readable signs and a piece of its hash."""
    plain = F.regexp_replace(F.regexp_replace(scenario, r"[^a-zA-Z0-9._-]+", "_"), "^_+|_+$", "")
    return F.concat(F.coalesce(F.nullif(F.substring(plain, 1, readable), F.lit("")), F.lit("capture")), F.lit("-"), F.substring(F.sha2(scenario, 256), 1, digest))


def canonical_json(text: str) -> str:
    """JSON with all keys in order and nothing between."""
    return json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def canonical_digest(column: Column) -> Column:
    """SHA-256 of canonical JSON (X10, X12); null for what is no JSON."""

    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            try:
                out.append(None if t is None else hashlib.sha256(canonical_json(t).encode()).hexdigest())
            except ValueError:
                out.append(None)
        return pa.array(out, pa.string())

    return F.arrow_udf(run, "string")(column)


def decode_png(content: bytes) -> np.ndarray | None:
    """The RGBA pixels (height, width, 4) of an 8-bit image without interlace; None unless checksums, order of chunks, length of data
    and filters all hold (P30, F27)."""
    if content[:8] != b"\x89PNG\r\n\x1a\n":
        return None
    at, head, data, ended = 8, None, b"", False
    while at + 12 <= len(content):
        n, kind = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + n]
        if len(body) != n or at + 12 + n > len(content) or zlib.crc32(kind + body) != struct.unpack(">I", content[at + 8 + n : at + 12 + n])[0]:
            return None
        if (head is None) != (kind == b"IHDR"):
            return None
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body) if n == 13 else None
            if head is None:
                return None
        elif kind == b"IDAT":
            data += body
        elif kind == b"IEND":
            ended = True
            break
        at += 12 + n
    if not ended or head is None or not data:
        return None
    width, height, depth, colour, compression, filters, interlace = head
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if not width or not height or width * height > 1 << 28 or depth != 8 or channels is None or compression or filters or interlace:
        return None
    try:
        raw = zlib.decompress(data)
    except zlib.error:
        return None
    row = width * channels
    if len(raw) != height * (row + 1):
        return None
    lines = np.frombuffer(raw, np.uint8).reshape(height, row + 1)
    if (lines[:, 0] > 4).any():
        return None
    out = np.zeros((height, row), np.uint8)
    before = np.zeros(row, np.int64)
    for y in range(height):
        kind, line = lines[y, 0], lines[y, 1:].astype(np.int64)
        if kind == 2:
            line = (line + before) & 255
        elif kind == 1:
            line = np.cumsum(line.reshape(-1, channels), axis=0).ravel() & 255
        elif kind in (3, 4):
            for k in range(row):
                a = line[k - channels] if k >= channels else 0
                b, c = before[k], before[k - channels] if k >= channels else 0
                if kind == 3:
                    line[k] = (line[k] + (a + b) // 2) & 255
                else:
                    p = a + b - c
                    da, db, dc = abs(p - a), abs(p - b), abs(p - c)
                    line[k] = (line[k] + (a if da <= db and da <= dc else b if db <= dc else c)) & 255
        out[y] = line
        before = line
    px = out.reshape(height, width, channels)
    if channels == 1:
        return np.concatenate([px, px, px, np.full_like(px, 255)], 2)
    if channels == 2:
        return np.concatenate([px[:, :, :1]] * 3 + [px[:, :, 1:]], 2)
    return np.concatenate([px, np.full((height, width, 1), 255, np.uint8)], 2) if channels == 3 else px


def encode_png(px: np.ndarray) -> bytes:
    """RGBA pixels as an image."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines = np.concatenate([np.zeros((px.shape[0], 1), np.uint8), px.astype(np.uint8).reshape(px.shape[0], -1)], 1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", px.shape[1], px.shape[0], 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def compare_pixels(before: np.ndarray, after: np.ndarray, threshold: float = 0.1, heat: bool = False) -> dict:
    """Exact and perceptual differences of two images (A12, X21, U09, K04). Pixels that one side lacks count as changed in both counts, with
    their own values as differences. The perceptual count weighs YIQ distances against a share of the largest, and counts antialiasing too."""
    h, w = max(before.shape[0], after.shape[0]), max(before.shape[1], after.shape[1])
    ih, iw = min(before.shape[0], after.shape[0]), min(before.shape[1], after.shape[1])
    delta = np.zeros((h, w), np.int64)
    outside = np.ones((h, w), bool)
    outside[:ih, :iw] = False
    for px in (before, after):
        view = outside[: px.shape[0], : px.shape[1]]
        part = delta[: px.shape[0], : px.shape[1]]
        part[view] = np.maximum(part[view], px[view].max(axis=1) if view.any() else 0)
    inner_a, inner_b = before[:ih, :iw].astype(np.int64), after[:ih, :iw].astype(np.int64)
    delta[:ih, :iw] = np.abs(inner_a - inner_b).max(axis=2) if ih and iw else 0
    changed = outside | (delta > 0)

    def flat(px: np.ndarray) -> np.ndarray:
        alpha = px[:, :, 3:] / 255.0
        return 255 + (px[:, :, :3] - 255) * alpha

    d = flat(inner_a) - flat(inner_b)
    y = d @ np.array([0.29889531, 0.58662247, 0.11448223])
    i = d @ np.array([0.59597799, -0.27417610, -0.32180189])
    q = d @ np.array([0.21147017, -0.52261711, 0.31114694])
    perceptual = int((0.5053 * y * y + 0.299 * i * i + 0.1957 * q * q > 35215 * threshold * threshold).sum()) + int(outside.sum())
    n = int(changed.sum())
    ys, xs = np.nonzero(changed)
    out = {"status": "changed" if n else "identical", "exact": n, "exact_ratio": n / (h * w), "perceptual": perceptual, "perceptual_ratio": perceptual / (h * w), "max_delta": int(delta.max()), "bounds": None, "heatmap": None}
    if n:
        out["bounds"] = {"x": int(xs.min()), "y": int(ys.min()), "width": int(xs.max() - xs.min() + 1), "height": int(ys.max() - ys.min() + 1)}
        if heat:
            px = np.full((h, w, 4), 255, np.uint8)
            base = np.zeros((h, w))
            base[: after.shape[0], : after.shape[1]] = after[:, :, :3] @ np.array([0.2126, 0.7152, 0.0722])
            px[:, :, :3] = np.floor(0.25 * base + 0.5)[:, :, None]
            px[changed] = (255, 0, 0, 255)
            out["heatmap"] = encode_png(px)
    return out


_PIXEL = "struct<status: string, exact: bigint, exact_ratio: double, perceptual: bigint, perceptual_ratio: double, max_delta: int, bounds: struct<x: int, y: int, width: int, height: int>, heatmap: binary>"


def pixels(before: Column, after: Column, *, threshold: float = 0.1, heat: bool = False) -> Column:
    """``compare_pixels`` of two columns of images; null where either can't be read."""
    bounds = pa.struct([(k, pa.int32()) for k in ("x", "y", "width", "height")])
    kind = pa.struct([("status", pa.string()), ("exact", pa.int64()), ("exact_ratio", pa.float64()), ("perceptual", pa.int64()), ("perceptual_ratio", pa.float64()), ("max_delta", pa.int32()), ("bounds", bounds), ("heatmap", pa.binary())])

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for i in range(len(a)):
            x, y = (None if v[i].as_py() is None else decode_png(v[i].as_py()) for v in (a, b))
            out.append(None if x is None or y is None else compare_pixels(x, y, threshold, heat))
        return pa.array(out, kind)

    return F.arrow_udf(run, _PIXEL)(before, after)


_SIGNALS = ("consoleErrors", "pageErrors", "networkFailures", "axeViolationIds")


def _added(before: Column, after: Column) -> Column:
    """Values of after beyond before's, with multiplicity (U04 within rows)."""
    times = lambda x, of: F.size(F.filter(of, lambda y: y == x))
    more = F.transform(F.array_distinct(after), lambda x: F.array_repeat(x, F.greatest(F.lit(0), times(x, after) - times(x, before))))
    return F.flatten(more)


def capture_faults(captures: DataFrame) -> DataFrame:
    """(scenarioId, fault) of capture metadata that isn't as it must be (F29): lists without nulls, overflow known, a valid id, once each."""
    rules = [F.when(F.col(c).isNull() | F.exists(c, lambda x: x.isNull()), F.lit(f"{c}-not-strings")) for c in _SIGNALS]
    rules += [F.when(F.col("overflow").isNull(), F.lit("overflow-not-boolean")), F.when(~is_scenario(F.col("scenarioId")), F.lit("invalid-id"))]
    rules += [F.when(F.col("_times") > 1, F.lit("duplicate-id"))]
    counted = captures.withColumn("_times", F.count("*").over(Window.partitionBy("scenarioId")))
    return counted.select("scenarioId", F.explode(F.array_compact(F.array(*rules))).alias("fault"))


def manifest_faults(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(scenarioId, faults) of captures that don't match what is on disk (J11, F28, F31): path outside, file missing, hash or size or dimensions differing.

    manifest: (scenarioId, pngPath, sha256, bytes, width, height); files: (path, content).
    """
    disk = files.select(F.col("path").alias("pngPath"), F.sha2("content", 256).alias("h"), F.length("content").alias("n"), F.conv(F.hex(F.substring("content", 17, 4)), 16, 10).cast("int").alias("w"), F.conv(F.hex(F.substring("content", 21, 4)), 16, 10).cast("int").alias("t"))
    own = manifest.join(disk, "pngPath", "left")
    outside = F.col("pngPath").startswith("/") | F.array_contains(F.split("pngPath", "/"), "..")
    gone = F.col("h").isNull()
    checks = [F.when(outside, F.lit("outside")), F.when(gone, F.lit("missing")), F.when(~gone & (F.col("h") != F.col("sha256")), F.lit("sha256")), F.when(~gone & (F.col("n") != F.col("bytes")), F.lit("bytes")), F.when(~gone & ((F.col("w") != F.col("width")) | (F.col("t") != F.col("height"))), F.lit("dimensions"))]
    return own.select("scenarioId", F.array_compact(F.array(*checks)).alias("faults")).where(F.size("faults") > 0)


def binding_faults(before: dict, after: dict, waivers: list[dict] = ()) -> list[dict]:
    """Bindings that differ without a waiver for just that pair (J12); a waiver for a binding that can't be waived, for another pair, or with a
    blank field is an error. Bindings are a handful of values of two manifests."""
    differing = [{"field": f, "before": before.get(f), "after": after.get(f)} for f in model.IMMUTABLE if before.get(f) != after.get(f)]
    left = list(differing)
    for w in waivers:
        if any(not str(w.get(k) or "").strip() for k in ("field", "before", "after", "owner", "reason", "scope", "evidence", "review")):
            raise ContractError(f"a waiver lacks a field: {w}")
        hit = [d for d in differing if d["field"] == w["field"]]
        if w["field"] not in model.WAIVABLE:
            raise ContractError(f"{w['field']} can't be waived")
        if hit and (hit[0]["before"], hit[0]["after"]) != (w["before"], w["after"]):
            raise ContractError("the waiver is for another pair")
        left = [d for d in left if d not in hit]
    return left


def bound(manifest: dict) -> bool:
    """Whether all seven fingerprints are whole digests."""
    return all(isinstance(manifest.get(f), str) and len(manifest[f]) == 64 and not set(manifest[f]) - set("0123456789abcdef") for f in model.FINGERPRINTS)


def policy(ids: DataFrame, effect: str, changed: list[str] = (), unchanged: list[str] = ()) -> DataFrame:
    """(scenarioId, expected) from a policy that must partition the matrix."""
    spark = ids.sparkSession
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "id string")
    every = ids.select(F.col("scenarioId").alias("id")).distinct()
    if effect == "preserve":
        if changed:
            raise ContractError("a preserve policy can't declare changed scenarios")
        c, u = frame([]), frame(unchanged) if unchanged else every
    elif effect == "change":
        c = frame(changed) if changed else every
        u = frame(unchanged) if unchanged else every.subtract(c)
    elif effect == "mixed":
        if not changed or not unchanged:
            raise ContractError("a mixed policy needs changed and unchanged scenarios")
        c, u = frame(changed), frame(unchanged)
    else:
        raise ContractError(f"unknown effect {effect}")
    bad = partition_faults(every, c, u).take(5)
    if bad:
        raise ContractError(f"the policy doesn't partition the matrix: {bad}")
    return c.select(F.col("id").alias("scenarioId"), F.lit("change").alias("expected")).union(u.select("id", F.lit("preserve")))


def compare(before: DataFrame, after: DataFrame, expected: DataFrame, *, thresholds: dict | None = None, heat: bool = False) -> DataFrame:
    """A row for each scenario with its pixels, added signals, verdict and reasons.

    before, after: captures with content and signals; the sets of ids must be the same. New errors fail first; preserve allows up to its
    maxima; change needs more than its minima.
    """
    sides = before.select(F.lit("expected").alias("side"), F.col("scenarioId").alias("id")).union(after.select(F.lit("produced"), "scenarioId"))
    cover = coverage(sides).first()
    if not cover["exact"]:
        raise ContractError(f"before and after aren't the exact same matrix: {cover.asDict()}")
    t = {"preserveMaxExactChangedPixels": 0, "preserveMaxExactChangedPixelRatio": 0, "changeMinExactChangedPixels": 0, "changeMinExactChangedPixelRatio": 0, "pixelmatchThreshold": 0.1} | (thresholds or {})
    if any(isinstance(v, bool) or not isinstance(v, (int, float)) or not 0 <= v < float("inf") for v in t.values()):
        raise ContractError(f"thresholds must be finite and not negative: {t}")
    b = before.select("scenarioId", F.struct("content", "overflow", *_SIGNALS).alias("b"))
    a = after.select("scenarioId", F.struct("content", "overflow", *_SIGNALS).alias("a"))
    own = b.join(a, "scenarioId").join(expected, "scenarioId").withColumn("pixel", pixels(F.col("b.content"), F.col("a.content"), threshold=float(t["pixelmatchThreshold"]), heat=heat))
    own = own.withColumn("added", F.struct(*(_added(F.col(f"b.{s}"), F.col(f"a.{s}")).alias(s) for s in _SIGNALS))).withColumn("counts", F.struct(*((F.size(f"a.{s}") - F.size(f"b.{s}")).alias(s) for s in _SIGNALS), (F.col("a.overflow").cast("int") - F.col("b.overflow").cast("int")).alias("overflow")))
    worse = reduce(lambda x, y: x | y, (F.size(F.col(f"added.{s}")) > 0 for s in _SIGNALS), ~F.col("b.overflow") & F.col("a.overflow"))
    n, r = F.col("pixel.exact"), F.col("pixel.exact_ratio")
    keep = F.array_compact(F.array(F.when(n > t["preserveMaxExactChangedPixels"], F.lit("exact-changed-pixels-exceeded")), F.when(r > t["preserveMaxExactChangedPixelRatio"], F.lit("exact-changed-pixel-ratio-exceeded"))))
    change = F.array_compact(F.array(F.when(n <= t["changeMinExactChangedPixels"], F.lit("expected-change-not-observed-by-pixel-count")), F.when(r <= t["changeMinExactChangedPixelRatio"], F.lit("expected-change-not-observed-by-pixel-ratio"))))
    reasons = F.when(n.isNull(), F.array(F.lit("unreadable-capture"))).when(worse, F.array(F.lit("new-runtime-or-accessibility-error"))).when(F.col("expected") == "preserve", keep).otherwise(change)
    return own.select("scenarioId", "expected", "pixel", "added", "counts", reasons.alias("reasons")).withColumn("verdict", F.when(F.size("reasons") > 0, "fail").otherwise("pass"))


def comparison_verdict(pairs: DataFrame) -> DataFrame:
    """One row: the deterministic verdict, and the whole's: fail, or review until someone looked."""
    own = pairs.agg(F.count("*").alias("pairs"), F.coalesce(F.bool_or(F.col("verdict") == "fail"), F.lit(True)).alias("bad"))
    return own.select("pairs", F.when(F.col("bad"), "fail").otherwise("pass").alias("deterministic"), F.when(F.col("bad"), "fail").otherwise("review").alias("verdict"))


def review_faults(entries: DataFrame, required: DataFrame) -> DataFrame:
    """(scenarioId, fault) of a review (R18, J23). entries: (scenarioId, verdict, observation, requiredAction, evidenceRefs array of sha256);
    required: (scenarioId, refs)."""
    side = entries.select(F.lit("produced").alias("side"), F.col("scenarioId").alias("id")).union(required.select(F.lit("expected"), "scenarioId"))
    cover = coverage(side).select(F.explode(F.array(*(F.struct(F.col(c).alias("ids"), F.lit(c).alias("fault")) for c in ("missing", "extra", "duplicate_produced", "invalid_produced")))).alias("x")).select(F.explode("x.ids").alias("scenarioId"), F.col("x.fault"))
    own = entries.join(required, "scenarioId")
    checks = [F.when(~F.coalesce(F.col("verdict").isin("expected", "unexpected", "ambiguous"), F.lit(False)), F.lit("unknown-verdict")), F.when(F.coalesce(F.trim("observation"), F.lit("")) == "", F.lit("blank-observation")), F.when((F.col("verdict") != "expected") & (F.coalesce(F.trim("requiredAction"), F.lit("")) == ""), F.lit("blank-action")), F.when(F.size(F.array_except("refs", "evidenceRefs")) > 0, F.lit("lacks-evidence")), F.when(F.size("evidenceRefs") < 2, F.lit("too-few-refs")), F.when(F.exists("evidenceRefs", lambda x: ~is_digest(x)), F.lit("no-digest"))]
    return union(cover, own.select("scenarioId", F.explode(F.array_compact(F.array(*checks))).alias("fault")))


def review_verdict(entries: DataFrame) -> DataFrame:
    """One row: fail for anything unexpected, requires-human for anything ambiguous, else pass; no entry is a fail."""
    v = F.col("verdict")
    return entries.agg(F.when((F.count("*") == 0) | (F.count_if(v == "unexpected") > 0), "fail").when(F.count_if(v == "ambiguous") > 0, "requires-human").otherwise("pass").alias("verdict"))


def compose(parts: DataFrame, whole: DataFrame) -> DataFrame:
    """The captures of two parts at least (part, identity, scenarioId, ...) that share one identity and partition the matrix."""
    seen = parts.agg(F.countDistinct("part").alias("n"), F.countDistinct("identity").alias("i")).first()
    if seen["n"] < 2 or seen["i"] != 1:
        raise ContractError(f"{seen['n']} parts with {seen['i']} identities")
    if bad := partition_faults(whole.select(F.col("scenarioId").alias("id")).distinct(), parts.select(F.col("scenarioId").alias("id"))).take(5):
        raise ContractError(f"the parts don't make up the matrix: {bad}")
    return parts.drop("part", "identity")


def report_gate(before: DataFrame, after: DataFrame) -> DataFrame:
    """(state, n, new_errors): older reports (key, hash, errors): pairs by state, and those with errors that weren't there before, as sets of
    signatures (R21, U05, A09)."""
    b, a = before.select("key", F.struct("hash", "errors").alias("b")), after.select("key", F.struct("hash", "errors").alias("a"))
    own = b.join(a, "key", "full")
    state = F.when(F.col("a").isNull(), "only_before").when(F.col("b").isNull(), "only_after").when(F.col("a.hash") == F.col("b.hash"), "same").otherwise("changed")
    new = F.size(F.array_except(F.coalesce("a.errors", F.array().cast("array<string>")), F.coalesce("b.errors", F.array().cast("array<string>")))) > 0
    return own.groupBy(state.alias("state")).agg(F.count("*").alias("n"), F.count_if(new).alias("new_errors"))


def redacted_difference(before: str, after: str, permitted: list[str]) -> tuple[int, str, str] | None:
    """The first line (number, before, after) that differs between two sources once the permitted patterns are blanked and runs of blank
    lines made one (R20, W04, W05); None if they are the same."""
    import itertools
    import re

    def bare(s: str) -> list[str]:
        for rx in permitted:
            s = re.sub(rx, "", s, flags=re.M | re.S)
        out: list[str] = []
        for line in s.split("\n"):
            if line.strip() or not out or out[-1].strip():
                out.append(line if line.strip() else "")
        return out

    pairs = itertools.zip_longest(bare(before), bare(after), fillvalue="<end>")
    return next(((k, a, b) for k, (a, b) in enumerate(pairs, 1) if a != b), None)


def stop_gate(changes: DataFrame, manifests: DataFrame) -> DataFrame:
    """One row: whether some valid manifest (modified, valid) is no older than the newest change (modified, folder_modified where the file is gone)."""
    newest = changes.agg(F.max(F.coalesce("modified", "folder_modified")).alias("newest"))
    good = manifests.where("valid").agg(F.max("modified").alias("shown"))
    return newest.crossJoin(good).withColumn("exit_code", F.when(F.col("newest").isNull() | F.coalesce(F.col("shown") >= F.col("newest"), F.lit(False)), 0).otherwise(2))


def worst_overflow(rects: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """(page, element, over): the element that exceeds its page's width most, if by more than the tolerance."""
    own = rects.withColumn("over", F.col("right") - F.col("width")).where(F.col("over") > tolerance)
    return first_by(own, ["page"], F.desc("over"), F.col("element")).select("page", "element", "over")


def run_faults(run: str, phase: str, batch: str | None) -> list[str]:
    """What is wrong with a run's names (F30): the run's form, the phase, the batch's form, and a batch where the phase needs one."""
    faults = []
    if not re.fullmatch(r"tokenize-[a-zA-Z0-9._-]+", run or ""):
        faults.append("run")
    if phase not in ("global-before", "before", "after", "final"):
        faults.append("phase")
    if batch and not re.fullmatch(r"B[0-9]{4,}", batch):
        faults.append("batch")
    if phase in ("before", "after") and not batch:
        faults.append("no-batch")
    return faults


def list_faults(values: Column) -> Column:
    """Why a list isn't one of different, trimmed, non-blank texts (H03, H08): null where it is."""
    bad = F.exists(values, lambda x: x.isNull() | (x == "") | (F.trim(x) != x))
    return F.when(values.isNull() | (F.size(values) == 0), "empty").when(bad, "blank-or-untrimmed").when(F.size(F.array_distinct(values)) < F.size(values), "repeated")


def build_manifest(captures: DataFrame, expected: DataFrame, run: dict) -> tuple[dict, DataFrame]:
    """A manifest's head and its captures in the order of their ids (R16, H12, K03). captures: (scenarioId, pngPath, png binary, metaPath, meta
    binary, the signals, overflow); expected: (id); run: runId, batchId, phase, generatedAt and the seven fingerprints.

    Names out of form, missing fingerprints, captures with faults or unreadable images, and coverage that isn't exact are errors.
    """
    if faults := run_faults(run.get("runId"), run.get("phase"), run.get("batchId")):
        raise ContractError(f"the run's names are wrong: {faults}")
    if not bound(run):
        raise ContractError("a fingerprint is no whole digest")
    sides = expected.select(F.lit("expected").alias("side"), F.col("id").cast("string").alias("id")).union(captures.select(F.lit("produced"), "scenarioId"))
    covered = coverage(sides).first().asDict(recursive=True)
    if not covered["exact"]:
        raise ContractError(f"coverage isn't exact: {covered}")
    valid = F.arrow_udf(lambda xs: pa.array([x.as_py() is not None and decode_png(x.as_py()) is not None for x in xs]), "boolean")
    faults = capture_faults(captures).select("scenarioId", "fault").union(captures.where(~valid("png")).select("scenarioId", F.lit("unreadable-image")))
    if wrong := [tuple(r) for r in faults.limit(20).collect()]:
        raise ContractError(f"captures have faults: {wrong}")
    number = lambda at: F.conv(F.hex(F.substring("png", at, 4)), 16, 10).cast("int")
    rows = captures.select("scenarioId", "pngPath", F.length("png").cast("bigint").alias("bytes"), number(17).alias("width"), number(21).alias("height"), F.sha2("png", 256).alias("sha256"), "metaPath", F.sha2("meta", 256).alias("metaSha256"), *_SIGNALS, "overflow").orderBy("scenarioId")
    ids = [r["scenarioId"] for r in rows.select("scenarioId").collect()]
    digest = hashlib.sha256(canonical_json(json.dumps(sorted(ids))).encode()).hexdigest()
    return run | {"artifactType": "evidence-manifest", "schemaVersion": "2.0.0", "matrixFingerprint": digest, "requestedScenarioIds": sorted(ids), "producedScenarioIds": sorted(ids), "coverage": covered, "exactCoverage": True}, rows


def schema_faults(document: object, schema: dict, at: str = "") -> list[str]:
    """Where a document isn't what a closed schema says (X24): type, required, properties without others, items, enum, pattern, least and most."""
    kinds = {"object": dict, "array": list, "string": str, "boolean": bool, "integer": int, "number": (int, float), "null": type(None)}
    wanted = schema.get("type")
    wanted = [wanted] if isinstance(wanted, str) else wanted
    fits = lambda k: isinstance(document, kinds[k]) and not (k in ("integer", "number") and isinstance(document, bool))
    if wanted and not any(map(fits, wanted)):
        return [f"{at or '/'}: not {' or '.join(wanted)}"]
    faults = []
    if "enum" in schema and document not in schema["enum"]:
        faults.append(f"{at or '/'}: not one of {schema['enum']}")
    if isinstance(document, dict):
        own = schema.get("properties", {})
        faults += [f"{at}/{k}: missing" for k in schema.get("required", ()) if k not in document]
        if schema.get("additionalProperties") is False:
            faults += [f"{at}/{k}: unexpected" for k in sorted(set(document) - set(own))]
        for k in sorted(set(own) & set(document)):
            faults += schema_faults(document[k], own[k], f"{at}/{k}")
    elif isinstance(document, list):
        if len(document) < schema.get("minItems", 0):
            faults.append(f"{at or '/'}: fewer than {schema['minItems']}")
        for i, x in enumerate(document):
            faults += schema_faults(x, schema.get("items", {}), f"{at}/{i}")
    elif isinstance(document, str):
        if "pattern" in schema and not re.search(schema["pattern"], document):
            faults.append(f"{at or '/'}: pattern")
        if len(document) < schema.get("minLength", 0):
            faults.append(f"{at or '/'}: too short")
    elif isinstance(document, (int, float)) and not isinstance(document, bool) and document < schema.get("minimum", document):
        faults.append(f"{at or '/'}: too small")
    return faults


def with_snapshot(routes: DataFrame, projects: DataFrame, files: DataFrame) -> DataFrame:
    """(name, project) for which an image has been committed (F33); those without are skipped, never written. files: (file) named
    <name>-<project>-<system>."""
    grid = routes.select("name").crossJoin(projects.select("project")).withColumn("stem", F.concat(F.translate("name", "_", "-"), F.lit("-"), "project", F.lit("-")))
    return grid.join(files.select("file"), F.expr("startswith(file, stem)"), "left_semi").select("name", "project")
