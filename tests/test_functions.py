import pytest
from pyspark.sql import functions as F

from cohortlens.functions import hashing, text, vectors


def values(spark, fn, items):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, x string")
    return [r[1] for r in df.select("i", fn(F.col("x")).alias("v")).orderBy("i").collect()]


def test_age_band(spark):
    got = values(spark, text.age_band, ["", "abc", "nan", "inf", "55.9", "-5.5", "0", "60", "1d", " 42 ", "1e2", None])
    assert got == ["", "", "", "", "50-59", "-10--1", "0-9", "60-69", "", "40-49", "100-109", ""]


def test_keys_and_slugs(spark):
    assert values(spark, text.norm_key, ["  A \t b\nC ", "Anonymous", ""]) == ["a b c", "anonymous", ""]
    assert values(spark, text.slug, ["Hospital Clínic, BCN!", "__x__", "a" * 80]) == ["Hospital_Cl_nic_BCN", "x", "a" * 60]
    assert values(spark, text.strip, ["\t a b \n", " x "]) == ["a b", "x"]


def test_url_extension(spark):
    urls = ["http://h/a.JPG?x=1", "http://h/a.jpeg", "http://h/a", "http://h/a.gif", "http://h/.png", "http://h/a..png", "http://h.org"]
    assert values(spark, text.url_extension, urls) == [".jpg", ".jpeg", ".jpg", None, ".jpg", ".png", None]


def test_labels_details_names(spark):
    assert values(spark, text.label_of, ["Benign", "MALIGNANT", "Indeterminate", ""]) == ["benign", "malignant", None, None]
    assert values(spark, lambda c: text.joined_detail(c, F.lit("")), ["x", ""]) == ["x", ""]
    assert values(spark, text.is_safe_name, ["a-b_1.jpg", "a b", "é", ""]) == [True, False, False, False]
    assert values(spark, text.fraction_of, ["frac0.3"]) == [0.3]
    assert values(spark, text.path_number, ["run2/step_1_30/ckpt"]) == [30]


def test_dhash_and_hamming(spark):
    grid = [float(x) for x in (1, 2, 1, 5, 5, 6, 9, 8, 7)]
    df = spark.createDataFrame([(grid,)], "g array<double>").select(hashing.dhash_bits(F.col("g"), 3, 3).alias("bits"))
    assert df.first().bits == "100100"
    rows = spark.createDataFrame([("1" * 256, "1" * 250 + "0" * 6)], "a string, b string")
    d = hashing.hamming(hashing.words(F.col("a"), 256), hashing.words(F.col("b"), 256))
    got = rows.select(d.alias("d"), hashing.dhash_hex(F.col("b"), 256).alias("h")).first()
    assert got.d == 6 and got.h == "f" * 62 + "c0"


def test_vector_norms(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 5.0])], "a array<double>, b array<double>")
    r = df.select(vectors.rel_l2(F.col("a"), F.col("b")).alias("r"), vectors.max_abs_diff(F.col("a"), F.col("b")).alias("m")).first()
    assert r.r == pytest.approx(10 ** 0.5 / 5) and r.m == 3.0


def test_cells_are_stripped_like_texts(spark):
    cells = ["", " ", "a", " a", "a ", "\ta b\n", "é", "é ", " x", "x　", "x\x1f", "\x85", "a b", "!~", "~", "\x7fa", "a\U0001f600", " \U0001f600 ", None]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    got = df.select("c", text.strip(F.col("c")).alias("a"), text.strip_cell(F.col("c")).alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got]
