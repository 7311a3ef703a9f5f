import itertools

import pytest

from martlet.constants import (LABEL_CHURNED, LABEL_CORE_VALUE, LABEL_LOYAL,
                               LABEL_POTENTIAL, LABEL_REGULAR)
from martlet.functions.segments import segment_label, segment_label_py, weighted_score

# one case per rule, and one on either side of each bound (0.5, 0.3, 0.3)
CASES = [
    ((0.51, 2.0, 2.0), LABEL_CHURNED),        # recency decides before all else
    ((0.5, -1.0, -1.0), LABEL_REGULAR),       # the bound itself is not above it
    ((-0.01, 0.0, 0.31), LABEL_CORE_VALUE),
    ((0.0, 0.0, 0.31), LABEL_POTENTIAL),      # core value needs R below zero
    ((0.2, 0.31, 0.3), LABEL_LOYAL),
    ((0.2, 0.3, 0.3), LABEL_REGULAR),
    ((0.2, 0.9, 0.31), LABEL_REGULAR),        # much spent and R above zero: no rule
    ((0.0, 0.01, -2.0), LABEL_POTENTIAL),
    ((-1.0, 0.0, 0.0), LABEL_REGULAR),
]


@pytest.mark.parametrize("center,expected", CASES)
def test_rule(center, expected):
    assert segment_label_py(center) == expected


def test_column_rule_equals_centre_rule_on_a_grid(spark):
    values = (-1.0, -0.01, 0.0, 0.3, 0.31, 0.5, 0.51)
    grid = list(itertools.product(values, repeat=3))
    df = spark.createDataFrame(grid, "R double, F double, M double").coalesce(1)
    assert [r.l for r in df.select(segment_label().alias("l")).collect()] == [segment_label_py(c) for c in grid]


def test_given_thresholds(spark):
    df = spark.createDataFrame([(0.9, 0.4, 0.2)], "R double, F double, M double")
    th = {"high_r": 1.0, "high_f": 0.35}
    assert df.select(segment_label(thresholds=th).alias("l")).first().l == segment_label_py((0.9, 0.4, 0.2), th) == LABEL_LOYAL
    assert segment_label_py((0.9, 0.4, 0.2)) == LABEL_CHURNED


def test_weighted_score(spark):
    df = spark.createDataFrame([(2.0, -1.0, 0.5)], "R double, F double, M double")
    assert df.select(weighted_score().alias("s")).first().s == pytest.approx(-0.45)
    assert df.select(weighted_score(weights={"R": 1.0}).alias("s")).first().s == pytest.approx(1.95)
