"""Checks of a clustering as DataFrame aggregates.

Points are z-scored buyers (``R_z, F_z, M_z``) with a ``cluster``; clusters are
few, points are not. Everything here is one aggregate per cluster and one pass
over the points beside it: the clusters' sums reach the points as one row.

* ``silhouette``: with squared Euclidean distances the mean distance from a
  point to a cluster follows from the cluster's count, sum and sum of squares,
  so no pair of points is formed.
* ``lloyd_step`` / ``lloyd``: new centres as the means of the nearest points.
* ``fixpoint``: whether an assignment is one that k-means stops at, as rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.segments import segment_label_py
from .rfm import assign_centers

AXES = ("R_z", "F_z", "M_z")


def _sums(points: DataFrame) -> DataFrame:
    """Per cluster: count, sum and sum of squared lengths."""
    square = sum((F.col(a) * F.col(a) for a in AXES), F.lit(0.0))
    return points.groupBy("cluster").agg(
        F.count("*").alias("n"), *[F.sum(a).alias(f"s{a}") for a in AXES], F.sum(square).alias("q"))


def _as_row(clusters: DataFrame) -> Column:
    """A few rows as one array in every row of another table."""
    return clusters.agg(F.collect_list(F.struct(*clusters.columns)).alias("c")).scalar()


def silhouettes(points: DataFrame) -> DataFrame:
    """``points`` with ``silhouette``: (b - a) / max(a, b), where a is the mean
    squared distance to the other points of the own cluster and b the least
    mean distance to another cluster; 0 in a cluster of one, NULL if there is
    no other cluster."""
    square = " + ".join(f"{a} * {a}" for a in AXES)
    dot = " + ".join(f"{a} * c.s{a}" for a in AXES)
    total = f"(c.n * ({square}) + c.q - 2 * ({dot}))"        # of the squared distances to a cluster's points
    own = f"element_at(transform(filter(_c, c -> c.cluster = cluster), c -> struct(c.n AS n, {total} AS t)), 1)"
    other = f"array_min(transform(filter(_c, c -> c.cluster <> cluster), c -> {total} / c.n))"
    return (points.withColumn("_c", _as_row(_sums(points)))
            .withColumn("_own", F.expr(own)).withColumn("_b", F.expr(other))
            .withColumn("_a", F.expr("CASE WHEN _own.n > 1 THEN _own.t / (_own.n - 1) END"))
            .withColumn("silhouette", F.expr(
                "CASE WHEN _b IS NULL THEN NULL WHEN _own.n = 1 THEN 0.0D "
                "ELSE coalesce((_b - _a) / nullif(greatest(_a, _b), 0.0D), 0.0D) END"))
            .drop("_c", "_own", "_a", "_b"))


def silhouette_by_cluster(points: DataFrame, digits: int = 6) -> DataFrame:
    """(cluster_id, user_count, silhouette): the mean per cluster, and of all
    points under cluster -1."""
    scored = silhouettes(points).select("cluster", "silhouette")
    sums = scored.groupBy("cluster").agg(F.count("*").alias("user_count"), F.sum("silhouette").alias("_s"))
    both = sums.select(F.explode(F.array(F.col("cluster").cast("int"), F.lit(-1))).alias("cluster_id"), "user_count", "_s")
    return both.groupBy("cluster_id").agg(
        F.sum("user_count").alias("user_count"),
        F.round(F.sum("_s") / F.sum(F.when(F.col("_s").isNotNull(), F.col("user_count"))), digits).alias("silhouette"))


def silhouette(points: DataFrame) -> float | None:
    """The mean silhouette of all points (one row on the driver)."""
    return silhouettes(points).agg(F.avg("silhouette")).first()[0]


def lloyd_step(zs: DataFrame, centers) -> DataFrame:
    """(cluster, n, R_z, F_z, M_z): the means of the points nearest to each
    centre; a centre without points is left out."""
    return assign_centers(zs, centers).groupBy("cluster").agg(F.count("*").alias("n"), *[F.avg(a).alias(a) for a in AXES])


def z_points(clustered: DataFrame) -> DataFrame:
    """(user_id, cluster, R_z, F_z, M_z) of the rows of a fitted segmentation."""
    from pyspark.ml.functions import vector_to_array
    z = vector_to_array("features")
    return clustered.select("user_id", "cluster", *[z[i].alias(a) for i, a in enumerate(AXES)])


def lloyd(zs: DataFrame, centers, steps: int) -> DataFrame:
    """The centres after ``steps`` steps from given ones; one without points
    stays where it is. Only centres, a few numbers, come to the driver between
    the steps; ``zs`` is read once per step."""
    now = [tuple(map(float, c)) for c in centers]
    last: dict[int, int] = {}
    for _ in range(steps):
        found = {r.cluster: r for r in lloyd_step(zs, now).collect()}
        now = [tuple(found[i][a] for a in AXES) if i in found else c for i, c in enumerate(now)]
        last = {i: r.n for i, r in found.items()}
    rows = [(i, last.get(i, 0), *map(float, c)) for i, c in enumerate(now)]
    return zs.sparkSession.createDataFrame(rows, "cluster_id int, user_count long, R_z double, F_z double, M_z double")


def fixpoint(points: DataFrame, centers, labels: dict, tolerance: float, thresholds: dict | None = None) -> DataFrame:
    """(check, cases, violations) of an assignment to ``centers``; cases are
    the points, violations are points or, in the last two, clusters:

    * ``members``: every point is in a cluster of the model;
    * ``nearest``: points that another centre is nearer to;
    * ``centre``: clusters whose centre is farther than ``tolerance`` from the
      mean of its members;
    * ``label``: clusters whose label is not the rule's for that mean.
    """
    known = [F.lit(i) for i in range(len(centers))]
    near = assign_centers(points.withColumnRenamed("cluster", "_given"), centers)
    seen = near.agg(F.count("*").alias("cases"), F.count_if(~F.coalesce(F.col("_given").isin(*known), F.lit(False))).alias("stray"),
                    F.count_if(F.col("_given") != F.col("cluster")).alias("far"))
    means = points.groupBy("cluster").agg(F.count("*").alias("n"), *[F.avg(a).alias(a) for a in AXES]).collect()  # few rows
    off = sum(max(abs(m[a] - c) for a, c in zip(AXES, centers[m.cluster])) > tolerance for m in means)
    wrong = sum(labels[m.cluster] != segment_label_py([m[a] for a in AXES], thresholds) for m in means)
    n = sum(m.n for m in means)
    clusters = points.sparkSession.createDataFrame(
        [("centre", n, off), ("label", n, wrong)], "check string, cases long, violations long")
    return seen.select(F.inline(F.array(
        F.struct(F.lit("members").alias("check"), F.col("cases"), F.col("stray").alias("violations")),
        F.struct(F.lit("nearest").alias("check"), F.col("cases"), F.col("far").alias("violations"))))).unionByName(clusters)
