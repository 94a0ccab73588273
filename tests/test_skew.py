"""Hot keys, ties and copies: the same results as plain computations."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabstat.operators import correlation as cr
from tabstat.operators import density as dn
from tabstat.operators import neighbours as nb
from tabstat.operators import supervised as sv
from tabstat.plans.graph import connected_components
from tabstat.plans.order_stats import attach_by_value, quantile_table


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(7)
    n = 6000
    x = np.where(rng.random(n) < 0.4, 5.0, np.round(rng.normal(5, 2, n), 3))
    pdf = pd.DataFrame({"id": np.arange(n), "x": x, "y": np.round(x + rng.normal(0, 1, n), 1),
                        "g": np.where(rng.random(n) < 0.6, "hot", rng.integers(0, 200, n).astype(str))})
    pdf.loc[::17, "x"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x"))).persist()
    return df, pdf


def test_quantiles_with_ties_and_a_hot_group(skewed):
    df, pdf = skewed
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {(r["g"], r["variable"]): r for r in quantile_table(df, ["x", "y"], probs, ["g"]).collect()}
    for g, part in pdf.groupby("g"):
        for c in ("x", "y"):
            v = part[c].dropna()
            if len(v):
                row = got[(g, c)]
                assert row["n"] == len(v) and np.allclose([row[f"q_{i}"] for i in range(len(probs))], v.quantile(probs))


def test_beyond_the_broadcast_limit_a_shuffle_join_gives_the_same(skewed, monkeypatch):
    """With every size check failing, grouped quantiles, Levene and box summaries take their other way."""
    from tabstat.operators import describe as ds
    from tabstat.operators import hypothesis as hy
    from tabstat.plans import order_stats
    df, pdf = skewed

    def run():
        q = quantile_table(df, ["x", "y"], [0.25, 0.5], ["g"]).orderBy("g", "variable").collect()
        return q, hy.levene(df, "y", ["g"]).first(), ds.box_summary(df, ["x"], ["g"]).orderBy("g").collect()

    small = run()
    for module in (order_stats, hy, ds):
        monkeypatch.setattr(module, "settle", lambda table: None)
    large = run()
    assert small[0] == large[0] and small[2] == large[2]
    assert large[1]["statistic"] == pytest.approx(small[1]["statistic"]) and large[1]["n"] == len(pdf)


def test_quantile_intervals_on_a_long_column(spark):
    """More rows than the sketch keeps: intervals from the sketch, exact values from the counts."""
    x = (F.pmod(F.xxhash64("id"), F.lit(100_003)) / 7.0)
    df = spark.range(0, 200_000, 1, 24).select(F.exp(x / 3000).alias("x")).repartitionByRange(12, "x")
    probs = [0.0, 0.001, 0.25, 0.5, 0.501, 0.99, 1.0]
    got = quantile_table(df, ["x"], probs).first()
    want = df.agg(F.percentile("x", probs)).first()[0]
    assert np.allclose([got[f"q_{i}"] for i in range(len(probs))], want, rtol=1e-12)


def test_spearman_with_a_value_in_a_third_of_the_rows(skewed):
    df, pdf = skewed
    ok = pdf.dropna()
    r = cr.correlate(df, ["x", "y"], "spearman").first()
    assert r["n"] == len(ok) and r["r"] == pytest.approx(np.corrcoef(ok.x.rank(), ok.y.rank())[0, 1])
    hot = ok[ok.g == "hot"]
    by_group = {r["g"]: r["r"] for r in cr.correlate(df, ["x", "y"], "spearman", ["g"]).collect()}
    assert by_group["hot"] == pytest.approx(np.corrcoef(hot.x.rank(), hot.y.rank())[0, 1])


def test_attach_matches_a_plain_join(skewed, spark):
    df, _ = skewed
    table = df.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("m")).where("g <> '7'")
    a = attach_by_value(df, table, "g", "n", [], spread="id", total=6000).select("id", "m").orderBy("id").collect()
    assert a == df.join(table, "g", "left").select("id", "m").orderBy("id").collect()


def test_roc_with_tied_scores(skewed):
    df, pdf = skewed
    ok = pdf.dropna()
    label = ok.y > 5.5
    r = ok.x.rank()
    want = (r[label].sum() - label.sum() * (label.sum() + 1) / 2) / (label.sum() * (~label).sum())
    got = sv.auc(df.withColumn("hit", F.col("y") > 5.5), "hit", "x", True).first()
    assert got["auc"] == pytest.approx(want)
    curve = sv.roc(df.withColumn("hit", F.col("y") > 5.5), "hit", "x", True).toPandas()
    assert len(curve) == ok.x.nunique() and curve.tpr.is_monotonic_increasing and curve.iloc[-1].tpr == 1


def test_stratified_split_is_exact_and_disjoint(skewed):
    df, pdf = skewed
    train, test = sv.split(df, 0.25, 1, "id", "g")
    n = test.groupBy("g").count().toPandas().set_index("g")["count"]
    assert abs(n["hot"] - 0.25 * (pdf.g == "hot").sum()) <= 1
    assert train.count() + test.count() == len(pdf) and train.join(test, "id").count() == 0
    assert sv.split(df, 0.25, 1, "id", "g")[1].select("id").exceptAll(test.select("id")).count() == 0


def test_neighbours_with_many_copies_of_one_point(spark):
    rng = np.random.default_rng(2)
    p = np.vstack([np.tile([[1.0, 1.0, 1.0]], (700, 1)), rng.normal(0, 1, (1300, 3))])
    train = spark.createDataFrame(pd.DataFrame(p, columns=list("abc")).assign(id=np.arange(2000), y=np.arange(2000) % 7))
    q = np.vstack([np.tile([[1.0, 1.0, 1.01]], (40, 1)), rng.normal(0, 2, (200, 3))])
    test = spark.createDataFrame(pd.DataFrame(q, columns=list("abc")).assign(id=np.arange(240) + 10_000))
    near = nb.nearest(train, test, list("abc"), "id", 6, block=150).toPandas()
    assert (near.groupby("id").size() == 6).all() and near.id.nunique() == 240
    d = np.sqrt(((q[:, None, :] - p[None]) ** 2).sum(axis=2))
    for i, part in near.sort_values("position").groupby("id"):
        order = np.lexsort((np.arange(2000), d[i - 10_000]))[:6]
        assert np.allclose(part.distance, d[i - 10_000][order]) and list(part.neighbour) == list(order)


def test_fewer_rows_than_neighbours(spark):
    train = spark.createDataFrame([(1, 0.0, 1.0), (2, 1.0, 3.0)], "id bigint, a double, y double")
    test = spark.createDataFrame([(9, 0.4)], "id bigint, a double")
    assert nb.knn(train, test, ["a"], "y", "id", 5).first()["prediction"] == 2.0


def brute_density(p, eps, m):
    d = np.sqrt(((p[:, None, :] - p[None]) ** 2).sum(axis=2)) <= eps
    core = d.sum(axis=1) >= m
    label = np.full(len(p), -1)
    for i in np.nonzero(core)[0]:
        if label[i] == -1:
            stack, label[i] = [i], i
            while stack:
                for k in np.nonzero(d[stack.pop()] & core)[0]:
                    if label[k] == -1:
                        label[k] = i
                        stack.append(k)
    for i in np.nonzero(~core)[0]:
        near = label[np.nonzero(d[i] & core)[0]]
        label[i] = near.min() if len(near) else -1
    return core, label


@pytest.mark.parametrize("dims,eps,m", [(1, 0.05, 4), (2, 0.35, 6), (3, 0.6, 5), (4, 0.8, 5)])
def test_density_clusters_against_all_pairs(spark, dims, eps, m):
    rng = np.random.default_rng(dims)
    p = np.vstack([np.tile(rng.normal(0, 1, (1, dims)), (150, 1)), rng.normal(0, 0.4, (120, dims)), rng.normal(3, 0.3, (100, dims)), rng.uniform(-4, 6, (130, dims))])
    cols = [f"c{i}" for i in range(dims)]
    df = spark.createDataFrame(pd.DataFrame(p, columns=cols).assign(id=np.arange(len(p))))
    got = dn.density_clusters(df, cols, "id", eps, m).orderBy("id").toPandas()
    core, label = brute_density(p, eps, m)
    assert list(got.core) == list(core) and list(got.cluster) == list(label)


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(0, 200)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    df = spark.createDataFrame(chain + star + [(5000, 5000)], "u bigint, v bigint")
    got = {r["u"]: r["component"] for r in connected_components(df).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[1000 + i] == 1000 for i in range(300)) and 5000 not in got
