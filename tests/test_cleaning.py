import pytest
from pyspark.sql import functions as F

from tabstat.functions.predicates import literal_for
from tabstat.operators import cleaning as cl
from tabstat.operators import columns as co
from tabstat.operators import contingency as ct
from tabstat.operators import describe as ds
from tabstat.operators import derive as dv
from tabstat.operators import hypothesis as hy
from tabstat.operators import reshape as rs


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=lambda t: tuple((x is None, x) for x in t))


@pytest.fixture
def nulls(spark):
    return spark.createDataFrame([(1, 1.0, "a"), (2, None, None), (3, 3.0, "b"), (4, 5.0, "b"), (5, None, "a")], "key bigint, x double, c string")


def test_not_equal_is_true_for_missing(nulls):
    got = co.flag(co.flag(nulls, "c", "!=", "a", "ne"), "x", "<=", "3", "le")
    assert rows(got, "key", "ne", "le") == [(1, 0, 1), (2, 1, 0), (3, 1, 1), (4, 1, 0), (5, 0, 0)]


def test_unknown_operator_means_equal(nulls):
    assert rows(co.flag(nulls, "x", "~", "3", "f"), "key", "f")[2] == (3, 1)


def test_literals_follow_the_column_type(nulls):
    assert literal_for(nulls, "x", "3") == 3 and literal_for(nulls, "x", "3.5") == 3.5
    assert literal_for(nulls, "x", "abc") == "abc" and literal_for(nulls, "c", "3") == "3"
    assert literal_for(nulls.withColumn("b", F.lit(True)), "b", "True") is True


def test_imputation(nulls):
    assert [r[1] for r in rows(cl.impute(nulls, ["x"], "mean"), "key", "x")] == [1.0, 3.0, 3.0, 5.0, 3.0]
    assert [r[1] for r in rows(cl.impute(nulls, ["x"], "median"), "key", "x")] == [1.0, 3.0, 3.0, 5.0, 3.0]
    assert [r[1] for r in rows(cl.impute(nulls, ["c", "x"], "mode"), "key", "c")] == ["a", "a", "b", "b", "a"]
    assert [r[1] for r in rows(cl.impute(nulls, ["x"], "mode"), "key", "x")] == [1.0, 1.0, 3.0, 5.0, 1.0]


def test_column_without_values_is_left_alone(spark):
    df = spark.createDataFrame([(1, None, None), (2, None, None)], "key bigint, x double, c string")
    for how in ("mean", "median", "mode"):
        assert rows(cl.impute(df, ["x"], how), "key", "x") == [(1, None), (2, None)]
    assert rows(cl.impute(df, ["c"], "mode"), "key", "c") == [(1, None), (2, None)]
    assert ds.describe(df, ["x"]).first()["count"] == 0


def test_interpolation_fills_both_ends(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([None, 2.0, None, None, 8.0, None])], "key bigint, x double")
    assert [r[1] for r in rows(cl.interpolate(df, ["x"], "key"), "key", "x")] == [2.0, 2.0, 4.0, 6.0, 8.0, 8.0]


def test_interpolation_across_ranges_and_series(spark):
    """One series with most rows, one with a null key, one empty: same as plain arithmetic."""
    n = 3000
    df = spark.range(n).select("id", F.when(F.col("id") % 3 < 2, "hot").when(F.col("id") % 30 == 2, None).otherwise("cold").alias("s"),
                               F.when(F.col("id") % 97 == 5, F.col("id") * 1.0).alias("x"))
    got = {(r["s"], r["id"]): r["x"] for r in cl.interpolate(df, ["x"], "id", ["s"]).collect()}
    series = {}
    for r in df.orderBy("id").collect():
        series.setdefault(r["s"], []).append((r["id"], r["x"]))
    for s, vs in series.items():
        known = [(i, x) for i, (_, x) in enumerate(vs) if x is not None]
        for i, (k, _) in enumerate(vs):
            if not known:
                assert got[(s, k)] is None
                continue
            lo = [p for p in known if p[0] <= i]
            hi = [p for p in known if p[0] >= i]
            a, b = (lo[-1] if lo else hi[0]), (hi[0] if hi else lo[-1])
            want = a[1] if a[0] == b[0] else a[1] + (b[1] - a[1]) * (i - a[0]) / (b[0] - a[0])
            assert got[(s, k)] == pytest.approx(want)


def test_constant_columns(spark):
    df = spark.createDataFrame([(1, 4.0), (2, 4.0), (3, None)], "key bigint, x double")
    assert rows(cl.zscore(df, ["x"]), "key", "x_z") == [(1, 0.0), (2, 0.0), (3, 0.0)]
    assert rows(cl.minmax(df, ["x"]), "key", "x_minmax") == [(1, 0.0), (2, 0.0), (3, 0.0)]
    assert ds.histogram(df, ["x"]).select("bin", "n").collect() == [(0, 2)]


def test_scaling_properties(spark):
    df = spark.range(500).select("id", (F.sin("id") * 7 + F.col("id") % 11).alias("x"))
    z = cl.zscore(df, ["x"]).agg(F.avg("x_z"), F.stddev_samp("x_z")).first()
    assert z[0] == pytest.approx(0, abs=1e-9) and z[1] == pytest.approx(1)
    m = cl.minmax(df, ["x"]).agg(F.min("x_minmax"), F.max("x_minmax")).first()
    assert tuple(m) == (0.0, 1.0)


def test_outliers_use_the_input_bounds_of_all_columns(spark):
    df = spark.createDataFrame([(i, float(i), float(i)) for i in range(20)] + [(20, 500.0, 3.0), (21, 4.0, -400.0), (22, None, None)], "key bigint, a double, b double")
    kept = {r[0] for r in rows(cl.handle_outliers(df, ["a", "b"], "remove"), "key")}
    assert kept == set(range(20)) | {22}
    w = cl.handle_outliers(df, ["a"], "winsorize").agg(F.max("a")).first()[0]
    lo, hi = cl.iqr_bounds(df, ["a"]).select("lower", "upper").first()
    assert w == hi
    assert cl.handle_outliers(df, ["a"], "median").where("key = 20").first()["a"] == df.agg(F.median("a")).first()[0]
    assert cl.detect_outliers(df.withColumn("c", F.lit("x")), "c").count() == 0


def test_negative_values(spark):
    df = spark.createDataFrame([(1, -3.0), (2, 3.0)], "key bigint, x double")
    assert rows(cl.log1p_clip(df, ["x"]), "key", "x_log")[0] == (1, 0.0)
    for kind in ("log", "sqrt"):
        with pytest.raises(ValueError):
            dv.transform(df, "x", kind)


def test_tied_bins_drop_edges_and_keep_null(spark):
    df = spark.createDataFrame([(i, 1.0) for i in range(8)] + [(8, 2.0), (9, 3.0), (10, None)], "key bigint, x double")
    got = dv.quantile_bins(df, "x", 4, "b")
    assert {r["b"] for r in got.where("x = 1").collect()} == {0}
    assert got.where("key = 10").first()["b"] is None
    assert got.where("b_lo >= b_hi").count() == 0


def test_casts(spark):
    df = spark.createDataFrame([("3.7",), ("x",), ("",), ("TRUE",), ("no",), (None,), ("2024-01-31",)], "raw string")
    assert co.cast_column(df, "raw", "float").where("raw IS NOT NULL").count() == 1
    assert co.cast_column(df, "raw", "int").schema["raw"].dataType.simpleString() == "string"
    ints = spark.createDataFrame([("3",), ("y",)], "raw string")
    assert rows(co.cast_column(ints, "raw", "int"), "raw") == [(3,), (None,)]
    assert co.cast_boolean(df, "raw").where("raw").count() == 1 and co.cast_boolean(df, "raw").where("NOT raw").count() == 1
    assert co.cast_column(df, "raw", "datetime", "%Y-%m-%d").where("raw IS NOT NULL").count() == 1


def test_low_cardinality_limit(spark):
    df = spark.range(1000).select((F.col("id") % 11).alias("c"), (F.col("id") % 10).cast("string").alias("d"), F.col("id"))
    assert co.low_cardinality(df) == ["d"] and co.low_cardinality(df, 11) == ["c", "d"]


def test_binary_columns(spark):
    df = spark.createDataFrame([(0, 1, 0, "a"), (1, 1, 2, "b"), (None, 1, 1, "c")], "p int, q int, r int, s string")
    assert co.binary_columns(df) == ["p"]


def test_names_are_guarded(nulls):
    with pytest.raises(ValueError):
        co.duplicate_column(nulls, "x", "c")
    with pytest.raises(ValueError):
        dv.named_levels(nulls, "c", {"a": "A"})
    with pytest.raises(ValueError):
        dv.dummies(nulls, "c", max_levels=1)


def test_dummies_of_null_rows_are_zero(nulls):
    got = dv.dummies(nulls, "c", drop_first=False)
    assert rows(got, "key", "c_a", "c_b")[1] == (2, 0, 0)
    assert got.where("c IS NOT NULL").agg(F.min(F.col("c_a") + F.col("c_b")), F.max(F.col("c_a") + F.col("c_b"))).first() == (1, 1)


def test_empty_cell_gets_half_and_all_levels(spark):
    df = spark.createDataFrame([("x", "u")] * 6 + [("x", "v")] * 4 + [("y", "u")] * 5 + [(None, "v")] * 2, "a string, b string")
    got = {(r["a"], r["b"]): r for r in ct.standardized_residuals(df, "a", "b").collect()}
    assert len(got) == 6 and got[("y", "v")]["observed"] == 0 and (ct.MISSING_LEVEL, "u") in got
    # 0.5 added to each of the six cells
    e = 11 * 7.5 / 20
    assert got[("x", "v")]["residual"] == pytest.approx((4.5 - e) / (e * (1 - 11 / 20) * (1 - 7.5 / 20)) ** 0.5)


def test_single_level_table(spark):
    df = spark.createDataFrame([("x", "u"), ("x", "v")], "a string, b string")
    assert tuple(ct.chi_square(df, "a", "b").first()) == (0.0, 0, 1.0)


def test_one_group_and_three_groups(spark):
    df = spark.createDataFrame([("g", float(i)) for i in range(5)], "g string, y double")
    row = hy.levene(df, "y", ["g"]).first()
    assert row["p_value"] == 1.0 and row["statistic"] is None
    with pytest.raises(Exception):
        hy.t_two(df, "y", "g", True).collect()


def test_too_many_levels_raise_instead_of_being_cut(spark):
    df = spark.range(30).select(F.col("id").cast("string").alias("a"), (F.col("id") % 7).alias("b"))
    with pytest.raises(Exception, match="more than 5 levels"):
        ct.crosstab(df, "a", "b", max_levels=5).collect()
    with pytest.raises(Exception, match="more than 5 levels"):
        rs.value_pairs(df, "a", 5).collect()


def test_small_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 4.0)], "g string, x double")
    row = ds.within_variance(df, ["x"], "g").first()
    assert row["mean_group_variance"] == 2.0
