"""Verdict labels from numbers. The cut points are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# skewness beyond +-0.5 counts as asymmetric, excess kurtosis beyond +-1 as flat or peaked
SKEW_CUT = 0.5
KURTOSIS_CUT = 1.0
# a level above 90 percent dominates; more than 20 levels is high cardinality
DOMINANT_PCT = 90.0
MANY_LEVELS = 20
# row share below 50 percent is balanced, from 90 percent concentrated
BALANCED_PCT = 50.0
SIGNIFICANCE = 0.05
# Bayes factor cut points
BAYES_CUTS = (1 / 100, 1 / 30, 1 / 10, 1 / 3, 1, 3, 10, 30, 100)
BAYES_WORDS = ("extreme", "very strong", "strong", "moderate", "weak")
# share of the posterior inside the equivalence region
ROPE_INSIDE = 0.95
ROPE_OUTSIDE = 0.05


def skew_label(skew: Column) -> Column:
    return (F.when(F.abs(skew) < SKEW_CUT, "symmetric")
             .when(skew >= SKEW_CUT, "right-skewed").when(skew <= -SKEW_CUT, "left-skewed"))


def kurtosis_label(kurt: Column) -> Column:
    return (F.when(kurt < -KURTOSIS_CUT, "platykurtic").when(kurt <= KURTOSIS_CUT, "mesokurtic")
             .when(kurt > KURTOSIS_CUT, "leptokurtic"))


def category_label(n_levels: Column, dominant_pct: Column) -> Column:
    return (F.when(n_levels == 1, "constant").when(dominant_pct > DOMINANT_PCT, "dominated")
             .when(n_levels > MANY_LEVELS, "high cardinality").otherwise("balanced"))


def concentration_label(max_share: Column) -> Column:
    return (F.when(max_share >= DOMINANT_PCT, "concentrated").when(max_share < BALANCED_PCT, "balanced")
             .otherwise("moderate"))


def significance_label(p: Column) -> Column:
    return F.when(p < SIGNIFICANCE, "significant").otherwise("not significant")


def bayes_factor_label(bf: Column) -> Column:
    """Evidence wording: strict bounds below 1, closed upper bounds above 1."""
    label = None
    for cut, word in zip(BAYES_CUTS[:5], BAYES_WORDS):
        text = f"{word} for null"
        label = F.when(bf < cut, text) if label is None else label.when(bf < cut, text)
    label = label.when(bf == 1, "none")
    for cut, word in zip(BAYES_CUTS[5:], BAYES_WORDS[:0:-1]):
        label = label.when(bf <= cut, f"{word} for alternative")
    return label.otherwise(f"{BAYES_WORDS[0]} for alternative")


def rope_label(share: Column) -> Column:
    return (F.when(share > ROPE_INSIDE, "irrelevant").when(share < ROPE_OUTSIDE, "relevant")
             .otherwise("uncertain"))
