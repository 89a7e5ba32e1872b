"""Cleaning and quality functions on literal texts."""

import math

import pytest
from pyspark.sql import functions as F

from weirflow.functions import quality as Q
from weirflow.functions import text as T
from weirflow.functions import vectors as V


def apply(spark, f, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("t"))).collect()]


def test_html(spark):
    got = apply(spark, T.clean_html, ["<p>a</p>b", "<script>x\n</script>y<STYLE>z", "&amp;lt;b&gt;", "a&nbsp;&#39;b&#x27;&copy;", "a　\x1c\x85b", None, ""])
    assert got == ["a b", "y z", "<b>", "a b&#x27;", "a b", "", ""]


def test_links_and_ads(spark):
    got = apply(spark, T.clean_urls, ["see HTTP://a.b/c now", "mail x@y.z ok", "前 点击这里下载 后", "a 专享价 b", "限时大优惠 c", None])
    assert got == ["see now", "mail ok", "前 后", "b", "c", ""]


def test_text_normalisation(spark):
    clean = lambda c: T.clean_text(c, 1, 20)
    assert apply(spark, clean, ["é", "a\x00b\x7f", "a\r\n\t b   c", "....!!!!????", "x" * 20, "x" * 21, None, "  "]) == ["é", "ab", "a\n b c", "...!!??", "x" * 20, "", "", ""]


@pytest.mark.parametrize("n, kept", [(9, False), (10, True), (100_000, True), (100_001, False)])
def test_length_bounds(spark, n, kept):
    assert (apply(spark, lambda c: T.length_gate(c, 10, 100_000), ["x" * n])[0] != "") == kept


def test_formats(spark):
    rows = spark.createDataFrame([(999,), (1500,), (2_000_000,), (3_100_000_000,)], "n bigint")
    assert [r[0] for r in rows.select(T.format_count(F.col("n"))).collect()] == ["999", "1.5K", "2.0M", "3.1B"]
    assert spark.range(1).select(T.format_clock(F.lit(125.9))).first()[0] == "02:05"


def test_quality(spark):
    assert apply(spark, lambda c: Q.keeps(c, "english"), ["The quick brown fox jumps.", "1234567890 abc", "aaaa", None, "中文中文中文中文中文中文"]) == [True, False, False, False, False]
    assert apply(spark, Q.detect, ["中文 a", "abc 中", "", "中a"]) == ["chinese", "english", "mixed", "mixed"]
    assert apply(spark, lambda c: F.round(Q.share(c, Q.PUNCT), 3), ["aé中1_!、", "", None]) == [0.286, 0.0, 0.0]
    assert apply(spark, Q.distinct_chars, ["aA b", "", None]) == [3, 0, 0]
    assert apply(spark, Q.not_blank, [" 　", "x", None]) == [False, True, False]


def test_vectors(spark):
    row = spark.createDataFrame([([3.0, -4.0, 0.0, 0.0],)], "v array<float>")
    got = row.select(V.l2_norm(F.col("v")), V.fp8_scale(F.col("v")), V.softmax(F.col("v")), V.rotate(F.col("v"), F.array(F.lit(math.pi / 2), F.lit(0.0))), V.top_k_gate(F.col("v"), 2, "softmax"), V.cross_entropy(F.col("v"), F.lit(0))).first()
    assert got[0] == 5 and abs(got[1] - 4 / 448) < 1e-12 and abs(sum(got[2]) - 1) < 1e-9
    assert [round(x, 6) for x in got[3]] == [4.0, 3.0, 0.0, 0.0]
    assert [g["expert"] for g in got[4]] == [0, 2]
    assert abs(got[5] - (math.log(sum(map(math.exp, (3, -4, 0, 0)))) - 3)) < 1e-9
    back = row.select(V.rotate(V.rotate(F.col("v"), V.rope_angles(F.lit(7), 4)), V.rope_angles(F.lit(7), 4), inverse=True)).first()[0]
    assert [round(x, 6) for x in back] == [3.0, -4.0, 0.0, 0.0]
    w = spark.range(1).select(V.mixing_weights(F.array(*[F.lit(0.1 * i) for i in range(8)]), 2).alias("w")).first()["w"]
    assert abs(sum(w["pre"]) - 1) < 1e-9 and all(abs(sum(r) - 1) < 1e-9 for r in w["comb"])
    y = spark.range(1).select(V.expand_streams(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))), F.array(F.lit(0.5), F.lit(0.25)), F.array(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0)))).alias("y")).first()["y"]
    assert y == [[1.5, 1.0], [0.25, 1.5]]
