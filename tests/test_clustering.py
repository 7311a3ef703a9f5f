"""Silhouette, Lloyd steps and the fixpoint check against plain versions."""

import random

import pytest

from martlet.functions.segments import segment_label_py
from martlet.operators import clustering, rfm

SCHEMA = "user_id int, cluster int, R_z double, F_z double, M_z double"


def make(rng, n, k):
    return [(i, c, *[rng.gauss(3 * c, 1) for _ in range(3)]) for i in range(n) for c in [rng.randrange(k)]]


def square(p, q):
    return sum((a - b) ** 2 for a, b in zip(p[2:], q[2:]))


def plain_silhouettes(rows):
    out = {}
    for p in rows:
        by = {}
        for q in rows:
            by.setdefault(q[1], []).append(square(p, q))
        own, others = by.pop(p[1]), [sum(v) / len(v) for v in by.values()]
        if not others:
            out[p[0]] = None
        elif len(own) == 1:
            out[p[0]] = 0.0
        else:
            a, b = sum(own) / (len(own) - 1), min(others)
            out[p[0]] = (b - a) / max(a, b) if max(a, b) else 0.0
    return out


@pytest.mark.parametrize("n, k", [(60, 3), (40, 5), (9, 6), (12, 1)])
def test_silhouette_by_definition(spark, n, k):
    rows = make(random.Random(n), n, k)
    got = {r.user_id: r.silhouette for r in clustering.silhouettes(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = plain_silhouettes(rows)
    assert got.keys() == want.keys()
    assert all((got[i] is None) == (want[i] is None) and (want[i] is None or got[i] == pytest.approx(want[i], abs=1e-9)) for i in want)


def test_silhouette_equals_the_evaluator(spark):
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import VectorAssembler
    points = spark.createDataFrame(make(random.Random(7), 300, 4), SCHEMA)
    vec = VectorAssembler(inputCols=list(clustering.AXES), outputCol="features").transform(points)
    score = ClusteringEvaluator(predictionCol="cluster", featuresCol="features", distanceMeasure="squaredEuclidean").evaluate(vec)
    assert clustering.silhouette(points) == pytest.approx(score, abs=1e-9)
    rows = {r.cluster_id: r for r in clustering.silhouette_by_cluster(points).collect()}
    assert rows[-1].user_count == 300 and rows[-1].silhouette == pytest.approx(score, abs=1e-6)
    assert sum(r.user_count * r.silhouette for c, r in rows.items() if c >= 0) == pytest.approx(300 * score, abs=1e-3)


def test_equal_points_have_silhouette_zero(spark):
    points = spark.createDataFrame([(i, i % 2, 1.0, 1.0, 1.0) for i in range(6)], SCHEMA)
    assert clustering.silhouette(points) == 0.0


def test_no_points(spark):
    points = spark.createDataFrame([], SCHEMA)
    assert clustering.silhouette(points) is None and clustering.silhouette_by_cluster(points).count() == 0


def test_lloyd_by_hand(spark):
    zs = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 2.0, 0.0, 0.0), (3, 10.0, 0.0, 0.0), (4, 12.0, 0.0, 0.0)],
                               "user_id int, R_z double, F_z double, M_z double")
    got = [tuple(r) for r in clustering.lloyd(zs, [(0, 0, 0), (3, 0, 0), (99, 0, 0)], 3).orderBy("cluster_id").collect()]
    # 2 is nearer to the second centre at first; the third never gets a point and stays
    assert got == [(0, 2, 1.0, 0.0, 0.0), (1, 2, 11.0, 0.0, 0.0), (2, 0, 99.0, 0.0, 0.0)]


def _checks(df):
    return {r.check: (r.cases, r.violations) for r in df.collect()}


def test_fixpoint_finds_each_kind_of_violation(spark):
    centers = [(0.0, 0.0, 0.0), (10.0, 0.0, 0.0)]
    labels = {i: segment_label_py(c) for i, c in enumerate(centers)}
    good = [(1, 0, -1.0, 0.0, 0.0), (2, 0, 1.0, 0.0, 0.0), (3, 1, 9.0, 0.0, 0.0), (4, 1, 11.0, 0.0, 0.0)]
    check = lambda rows, c=centers, lab=labels: _checks(
        clustering.fixpoint(spark.createDataFrame(rows, SCHEMA), c, lab, 1e-6))
    assert check(good) == {"members": (4, 0), "nearest": (4, 0), "centre": (4, 0), "label": (4, 0)}
    moved = check([good[0], (2, 1, 1.0, 0.0, 0.0), *good[2:]])
    assert moved["nearest"] == (4, 1) and moved["centre"][1] == 2
    assert check(good, lab={0: labels[0], 1: "other"})["label"] == (4, 1)
    assert check(good, c=[(0.0, 0.0, 0.0), (10.5, 0.0, 0.0)])["centre"] == (4, 1)


def test_a_fit_is_a_fixpoint(spark):
    rng = random.Random(1)
    base = spark.createDataFrame([(i, rng.randrange(30), rng.randrange(1, 9), 100 * rng.random()) for i in range(200)],
                                 "user_id int, R int, F long, M double")
    seg = rfm.segment_users(base)
    points = clustering.z_points(seg.clustered)
    assert set(_checks(clustering.fixpoint(points, seg.centers, seg.labels, 1e-2)).values()) == {(200, 0)}
    assert clustering.silhouette(points) == pytest.approx(seg.best_score, abs=1e-9)
