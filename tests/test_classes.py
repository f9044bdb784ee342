"""Canonical class lists and the cascade's projection."""

import pytest

from weftline.operators import classes as C


@pytest.mark.parametrize(
    ("given", "plain", "axes"),
    [
        ("", "", ""),
        ("p-2 p-2", "p-2", "p-2"),
        ("w-4 h-4", "size-4", "size-4"),
        ("px-2 py-2", "px-2 py-2", "p-2"),
        ("pl-2 pr-2", "pl-2 pr-2", "px-2"),
        ("p-4 px-2", "p-4 px-2", "p-4 px-2"),
        ("mt-1 mr-1 mb-1 ml-1", "m-1", "m-1"),
        ("gap-x-4 gap-y-4", "gap-4", "gap-4"),
        ("mt-1 mb-2", "mt-1 mb-2", "mt-1 mb-2"),
        ("border border-b", "border", "border"),
        ("left-0 right-0", "left-0 right-0", "inset-x-0"),
        ("border-t border-b", "border-t border-b", "border-y"),
        ("hover:pl-2 pr-2", "hover:pl-2 pr-2", "hover:pl-2 pr-2"),
        ("mt-1 mr-2 mb-1 ml-2", "mt-1 mr-2 mb-1 ml-2", "mx-2 my-1"),
        ("rounded-tl-md rounded-tr-md", "rounded-t-md", "rounded-t-md"),
        ("overflow-x-auto overflow-y-auto flex", "overflow-auto flex", "overflow-auto flex"),
        ("border-t-red-500 border-b-red-500", "border-t-red-500 border-b-red-500", "border-t-red-500 border-b-red-500"),
    ],
)
def test_canonical(given, plain, axes):
    assert C.canonical(given, "A")[0] == plain
    assert sorted(C.canonical(given, "B")[0].split()) == sorted(axes.split())


def test_levels():
    assert C.canonical("px-2 py-2", "B0") == ("p-2", "B0")
    assert C.canonical("pl-2 pr-2", "B0") == ("pl-2 pr-2", "none")
    assert C.canonical("mt-[16px]", "V") == ("mt-4", "V")
    assert C.canonical("mt-[15px]", "V") == ("mt-[15px]", "none")
    once, _ = C.canonical("mt-1 mb-1 flex w-2 h-2", "B")
    assert C.canonical(once, "B") == (once, "none")


def test_projection():
    assert C.projection("p-2 px-1") == C.projection("py-2 px-1")
    assert C.projection("px-1 p-2") == C.projection("p-2 px-1")
    assert C.projection("gap-2 px-2 mb-3") == C.projection("px-2 gap-2 mb-3")
    assert C.projection("p-2") != C.projection("p-2 px-1")
    assert C.projection("-mt-2") != C.projection("mt-2")


def test_columns(spark):
    rows = spark.createDataFrame([("w-4 h-4",), (None,), ("pl-2 pr-2",)], "c string").select(C.canonicalised(C.F.col("c"), "B").alias("x"), C.projected(C.F.col("c")).alias("m")).collect()
    assert (rows[0]["x"]["classes"], rows[0]["x"]["risk"]) == ("size-4", "none")
    assert rows[1]["x"] is None and rows[1]["m"] is None
    assert rows[2]["x"]["risk"] == "axis-mapping-sensitive"


def test_axis_safe(spark):
    scopes = spark.createDataFrame([("a", None, True), ("b", "vertical-rl", True), ("c", "vertical-rl", False), ("e", "horizontal-tb", False)], "file string, writing_mode string, only_intrinsic boolean")
    edges = spark.createDataFrame([("b", "a"), ("c", "d"), ("d", "e")], "src string, dst string")
    assert {r["file"]: r["safe"] for r in C.axis_safe(scopes, edges).collect()} == {"a": True, "b": False, "c": False, "d": False, "e": False}
