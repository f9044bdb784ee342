"""Utility classes that say the same: canonical forms by level of risk, and the cascade's projection.

A family's utilities set some of its sides to a value. Where all the tokens of a family (of one variant) agree with each
other, they can be written shorter; what that depends on is its level: ``A`` nothing, ``B0`` nothing, as all four sides get
one value, but through axes; ``B`` on axes lying as in horizontal writing; ``V`` on the root's font size, for pixels
written as steps. A name is never changed where two tokens of a family set one side to different values: that is for
``projection``, which says what the cascade leaves on each side, the narrower utility winning.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BOX, _CORNERS = ("t", "r", "b", "l"), ("tl", "tr", "br", "bl")


def _box(short: str, x: str, y: str, sides: tuple[str, ...]) -> dict[str, tuple[str, ...]]:
    return {short: _BOX, x: ("r", "l"), y: ("t", "b")} | {s: (k,) for s, k in zip(sides, _BOX, strict=True)}


#: Family: the sides that each of its utilities sets.
FAMILIES: dict[str, dict[str, tuple[str, ...]]] = {f: _box(f, f"{f}x", f"{f}y", tuple(f"{f}{k}" for k in _BOX)) for f in ("m", "p", "scroll-m", "scroll-p")}
FAMILIES |= {
    "inset": _box("inset", "inset-x", "inset-y", ("top", "right", "bottom", "left")),
    "border": _box("border", "border-x", "border-y", tuple(f"border-{k}" for k in _BOX)),
    "rounded": {"rounded": _CORNERS, "rounded-t": ("tl", "tr"), "rounded-r": ("tr", "br"), "rounded-b": ("br", "bl"), "rounded-l": ("tl", "bl")} | {f"rounded-{k}": (k,) for k in _CORNERS},
    "gap": {"gap": ("x", "y"), "gap-x": ("x",), "gap-y": ("y",)},
    "size": {"size": ("w", "h"), "w": ("w",), "h": ("h",)},
    "overflow": {"overflow": ("x", "y"), "overflow-x": ("x",), "overflow-y": ("y",)},
    "overscroll": {"overscroll": ("x", "y"), "overscroll-x": ("x",), "overscroll-y": ("y",)},
}
_OF = {u: (f, sides) for f, own in FAMILIES.items() for u, sides in own.items()}
_NAMES = sorted(_OF, key=len, reverse=True)
_WIDTH = re.compile(r"^(|\d+|\[[\d.]+(px|rem)\])$")
LEVELS = ("none", "A", "B0", "B", "V")
RISK = {"none": "none", "A": "none", "B0": "none", "B": "axis-mapping-sensitive", "V": "value-anchor-change"}


def split(token: str) -> tuple[str, str, tuple[str, ...], str] | None:
    """(variants and sign, family, sides, value) of a utility of one of the families, else None."""
    head, colon, body = token.rpartition(":") if "[" not in token else (*token[: token.index("[")].rpartition(":")[:2], "")
    if "[" in token:
        body = token[len(head) + len(colon) :]
    front = head + colon
    if body.startswith("-"):
        front, body = front + "-", body[1:]
    for name in _NAMES:
        if body == name or body.startswith(f"{name}-"):
            family, sides = _OF[name]
            value = body[len(name) + 1 :]
            bare = family in ("border", "rounded")
            if (not value and not bare) or (family == "border" and not _WIDTH.match(value)):
                return None
            return front, family, sides, value
    return None


def _join(front: str, name: str, value: str) -> str:
    return f"{front}{name}-{value}" if value else f"{front}{name}"


def _steps(token: str, spacing: float = 4.0) -> str:
    """A value in pixels as a step of the scale, where it is a whole half-step."""
    own = split(token)
    hit = re.fullmatch(r"\[(\d+(?:\.\d+)?)px\]", own[3]) if own and own[1] in ("m", "p", "scroll-m", "scroll-p", "inset", "gap", "size") else None
    if not hit or (float(hit[1]) / spacing * 2) % 1:
        return token
    return token.replace(f"[{hit[1]}px]", f"{float(hit[1]) / spacing:g}")


def canonical(classes: str, level: str = "A") -> tuple[str, str]:
    """A class list in its shortest form that needs no more than ``level``, and the level that was needed.

    Words keep the place of the first one that they came from; what isn't in a family stays as it is, once.
    """
    allowed = LEVELS.index(level)
    words, needed = classes.split(), "none"

    def need(k: str) -> None:
        nonlocal needed
        needed = max(needed, k, key=LEVELS.index)

    if allowed >= LEVELS.index("V"):
        steps = [_steps(w) for w in words]
        if steps != words:
            need("V")
        words = steps
    once = list(dict.fromkeys(words))
    if len(once) < len(words):
        need("A")
    groups: dict[tuple[str, str], list[str]] = {}
    for w in once:
        if own := split(w):
            groups.setdefault(own[:2], []).append(w)
    put: dict[str, list[str]] = {}
    for (front, family), tokens in groups.items():
        parsed = [split(t)[2:] for t in tokens]
        sides: dict[str, set[str]] = {}
        for own, value in parsed:
            for s in own:
                sides.setdefault(s, set()).add(value)
        if len(tokens) < 2 or any(len(v) > 1 for v in sides.values()):
            continue
        value_of = {s: next(iter(v)) for s, v in sides.items()}
        names = FAMILIES[family]
        whole = next(iter(names.values()))
        axes = [own for own in names.values() if len(own) == 2 and len(whole) == 4]
        box = len(whole) == 4 and family != "rounded"
        used = {own for own, _ in parsed}
        out, left, kind = [], dict(value_of), "A"
        if set(left) == set(whole) and len(set(left.values())) == 1:
            if whole not in used and box and any(own in used for own in axes):
                kind = "B0"
            if allowed >= LEVELS.index(kind):
                out, left = [_join(front, next(iter(names)), left[whole[0]])], {}
        if left:
            kind = "A"
            for own in axes:
                if all(s in left for s in own) and len({left[s] for s in own}) == 1:
                    step = "B" if box and own not in used else "A"
                    if allowed >= LEVELS.index(step):
                        kind = max(kind, step, key=LEVELS.index)
                        out.append(_join(front, next(n for n, o in names.items() if o == own), left[own[0]]))
                        for s in own:
                            del left[s]
            out += [_join(front, next(n for n, o in names.items() if o == (s,)), v) for s, v in left.items()]
        if len(out) < len(tokens):
            need(kind)
            put |= {tokens[0]: out} | {t: [] for t in tokens[1:]}
    done = [x for w in once for x in put.get(w, [w])]
    return " ".join(done), needed


def projection(classes: str) -> dict[str, str]:
    """What the cascade leaves on each side: 'variant family side' -> value (D27). Of utilities for the same sides the last
    wins, the order that a style sheet gives them being unknown; words of no family map to themselves."""
    out: dict[str, tuple[int, str]] = {}
    for w in classes.split():
        own = split(w)
        if own is None:
            out[w] = (0, w)
            continue
        front, family, sides, value = own
        sign, front = ("-", front[:-1]) if front.endswith("-") else ("", front)
        for s in sides:
            key = f"{front}{family}.{s}"
            if key not in out or len(sides) <= out[key][0]:
                out[key] = (len(sides), sign + value)
    return {k: v for k, (_, v) in sorted(out.items())}


_CANON = pa.struct([("classes", pa.string()), ("level", pa.string()), ("risk", pa.string())])


def canonicalised(classes: Column, level: str = "A") -> Column:
    """``canonical`` of a column as struct<classes, level, risk>; null for null."""

    def each(texts: pa.Array) -> pa.Array:
        found = [None if t is None else canonical(t, level) for t in texts.to_pylist()]
        return pa.array([None if x is None else {"classes": x[0], "level": x[1], "risk": RISK[x[1]]} for x in found], _CANON)

    return F.arrow_udf(each, "struct<classes: string, level: string, risk: string>")(classes)


def projected(classes: Column) -> Column:
    """``projection`` of a column as a map in the order of its keys; two lists with equal maps look alike."""
    each = F.arrow_udf(lambda texts: pa.array([None if t is None else list(projection(t).items()) for t in texts.to_pylist()], pa.map_(pa.string(), pa.string())), "map<string, string>")
    return each(classes)


def axis_safe(scopes: DataFrame, edges: DataFrame) -> DataFrame:
    """(file, safe): whether no writing mode turns the axes in a file (D28). scopes: (file, writing_mode, only_intrinsic), a row
    for each rotated or plain subtree; edges: (src, dst) of imports. A rotated subtree that holds components makes
    the files that its file imports, and theirs, unsafe too."""
    from weftline.operators.graphs import reach

    turned = scopes.where("writing_mode is not null and writing_mode != 'horizontal-tb'")
    spread = reach(edges, turned.where("not only_intrinsic").select(F.col("file").alias("node")))
    unsafe = turned.select("file").union(spread.select("node")).distinct().withColumn("safe", F.lit(False))
    every = scopes.select("file").union(edges.select("src")).union(edges.select("dst")).distinct()
    return every.join(unsafe, "file", "left").select("file", F.coalesce("safe", F.lit(True)).alias("safe"))
