import math

import pytest
from pyspark.sql import functions as F

from tabstat.functions import quantile_points as qp
from tabstat.functions import tails


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


@pytest.mark.parametrize("t,dof", [(2.228, 10), (0.3, 4), (5.0, 2), (1.96, 1e6), (0.0, 7), (-2.5, 33)])
def test_t_agrees_with_the_library_in_the_jvm(spark, t, dof):
    law = spark._jvm.org.apache.commons.math3.distribution.TDistribution(float(dof))
    assert value(spark, tails.t_two_sided(F.lit(t), F.lit(dof))) == pytest.approx(2 * (1 - law.cumulativeProbability(abs(t))), rel=1e-8)


@pytest.mark.parametrize("f,a,b", [(3.098, 3, 20), (1.0, 2, 59994), (0.2, 5, 5)])
def test_f(spark, f, a, b):
    law = spark._jvm.org.apache.commons.math3.distribution.FDistribution(float(a), float(b))
    assert value(spark, tails.f_upper(F.lit(f), F.lit(a), F.lit(b))) == pytest.approx(1 - law.cumulativeProbability(f), rel=1e-8)


@pytest.mark.parametrize("x,k", [(5.991, 2), (3.841, 1), (30.0, 12)])
def test_chi_square(spark, x, k):
    law = spark._jvm.org.apache.commons.math3.distribution.ChiSquaredDistribution(float(k))
    assert value(spark, tails.chi2_upper(F.lit(x), F.lit(k))) == pytest.approx(1 - law.cumulativeProbability(x), rel=1e-8)


def test_normal_and_missing(spark):
    assert value(spark, tails.normal_cdf(F.lit(1.96))) == pytest.approx(0.9750021, abs=1e-7)
    assert value(spark, tails.normal_two_sided(F.lit(1.959963985))) == pytest.approx(0.05, abs=1e-9)
    assert value(spark, tails.t_two_sided(F.lit(None).cast("double"), F.lit(3))) is None
    assert value(spark, tails.chi2_upper(F.lit(0.0), F.lit(0))) == 1.0


@pytest.mark.parametrize("p,dof,want", [(0.975, 10, 2.228139), (0.975, 2, 4.302653), (0.995, 30, 2.749996), (0.975, 60000, 1.960003), (0.975, 1, 12.7062)])
def test_t_quantile(p, dof, want):
    assert qp.t_quantile(p, dof) == pytest.approx(want, abs=2e-5)


# 5 percent points of the studentized range, printed tables
@pytest.mark.parametrize("k,dof,want", [(3, 10, 3.877), (5, 20, 4.232), (2, 5, 3.635), (10, 60, 4.646), (4, 120, 3.685), (3, 1e7, 3.314)])
def test_studentized_range(k, dof, want):
    assert qp.studentized_range_quantile(0.95, k, dof) == pytest.approx(want, abs=2e-3)
    assert qp.studentized_range_sf(want, k, dof) == pytest.approx(0.05, abs=3e-4)


def test_two_means_equal_a_t_test():
    q = 3.0
    assert qp.studentized_range_sf(q, 2, 12) == pytest.approx(2 * qp.t_upper_area(q / math.sqrt(2), 12), abs=1e-6)
