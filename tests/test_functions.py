import pytest
from pyspark.sql import functions as F

from weftline.functions import colour as C
from weftline.functions import text as T


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("a", "b", "ratio"), [("#ffffff", "#000", 21.0), ("#abc", "#aabbcc", 1.0), ("rgb(255, 255, 255)", "#000000", 21.0), ("oklch(100% 0 0)", "#000", 21.0)])
def test_contrast(spark, a, b, ratio):
    assert one(spark, C.contrast(C.parse(F.col("a")), C.parse(F.col("b"))), a=a, b=b) == pytest.approx(ratio, abs=1e-6)


def test_colours(spark):
    assert one(spark, C.to_hex(C.parse(F.col("a"))), a="#AbC") == "#aabbcc"
    assert one(spark, C.parse(F.col("a")), a="red") is None and one(spark, C.parse(F.col("a")), a=None) is None
    assert one(spark, C.to_hex(C.over(C.hex_rgb(F.lit("#000000")), F.lit(0.5), C.hex_rgb(F.col("a")))), a="#ffffff") == "#808080"
    assert one(spark, C.luminance(C.hex_rgb(F.col("a")), C.LINEAR_OLD), a="#0a0a0a") == pytest.approx(one(spark, C.luminance(C.hex_rgb(F.col("a"))), a="#0a0a0a"), rel=1e-3)
    assert one(spark, C.heat(C.hex_rgb(F.col("a"))), a="#ffffff") == 64


@pytest.mark.parametrize(("x", "y", "want"), [((50.0, 2.6772, -79.7751), (50.0, 0.0, -82.7485), 2.0425), ((50.0, -1.3802, -84.2814), (50.0, 0.0, -82.7485), 1.0), ((50.0, 2.5, 0.0), (58.0, 24.0, 15.0), 19.4535), ((60.2574, -34.0099, 36.2677), (60.4626, -34.1751, 39.4387), 1.2644), ((2.0776, 0.0795, -1.1350), (0.9033, -0.0636, -0.5514), 0.9082)])
def test_colour_difference_against_published_pairs(spark, x, y, want):
    lab = "struct<l: double, a: double, b: double>"
    got = spark.createDataFrame([(x, y)], f"x {lab}, y {lab}").select(C.delta_e(F.col("x"), F.col("y")).alias("d")).first()["d"]
    assert got == pytest.approx(want, abs=1e-4)


def test_keys_and_shapes(spark):
    assert one(spark, T.sorted_key(F.col("a")), a=" px-2  gap-2 mb-3 ") == one(spark, T.sorted_key(F.col("a")), a="gap-2 px-2 mb-3")
    assert one(spark, T.sorted_key(F.col("a")), a="p-2 p-2") != one(spark, T.sorted_key(F.col("a")), a="p-2")
    assert one(spark, T.set_key(F.col("a")), a="p-2 p-2") == "p-2"
    assert one(spark, T.selector(F.col("a")), a="hover:w-1/2") == "hover\\:w-1\\/2"
    assert one(spark, T.signature(F.col("a")), a="bad https://x.y/z thing\nmore") == "bad  thing"
    for a, ok in (("a::b", True), (" a", False), ("", False), ("x" * 513, False), ("🙂" * 256, True), ("🙂" * 257, False), ("a\x07", False), (None, False)):
        assert one(spark, T.is_scenario(F.col("a")), a=a) is ok
    for a, ok in (("a-b.md", True), ("2026-01-02-x.md", True), ("x-2026-01-02.md", False), ("Abc.md", False), ("README.md", True), ("0001-x.md", True)):
        assert one(spark, T.shape_name(F.col("a")), a=a) is ok
    assert one(spark, T.utility(F.col("a")), a="hover:bg-ink/25").asDict() == {"body": "ink", "alpha": 0.25}
    assert one(spark, T.utility(F.col("a")), a="bg-ink/x")["alpha"] == 1.0
    assert one(spark, T.positive(F.col("a")), a="012") is None and one(spark, T.positive(F.col("a")), a="12") == 12
    assert one(spark, T.csv(F.col("a")), a=" x, ,y ") == ["x", "y"]
    assert one(spark, T.updated(F.col("a")), a="---\nupdated: 2026-01-02\n---\n") == "2026-01-02" and one(spark, T.updated(F.col("a")), a="---\nupdated: soon\n---\n") == "" and one(spark, T.updated(F.col("a")), a="x") is None
    assert one(spark, T.is_iso_time(F.col("a")), a="2026-01-02T03:04:05Z") and not one(spark, T.is_iso_time(F.col("a")), a="2026-13-02")


def test_scanners():
    text = "a /* x\ny */ b // c\nhttps://z d"
    assert T.blank_comments(text) == "a     \n     b     \nhttps://z d" and len(T.blank_comments(text)) == len(text)
    assert T.fold("Ação ÉÑ") == "acao en"
    assert T.class_blocks("<a className=\"x y\"/><b className={f({a: 'p'}) + \"q\"}/>") == ["x y", "f({a: 'p'}) + \"q\""]
    assert T.class_blocks('className={cn("a")}') == ['cn("a")'] and T.class_blocks("className={" + "x" * 7000 + "}") == []
    assert T.static_segments("a ${b ? 'x}' : `n ${c} }`} d ${/* } */ e} f") == ["a ", " d ", " f"]
    assert T.static_segments("plain \\${x}") == ["plain \\${x}"]
