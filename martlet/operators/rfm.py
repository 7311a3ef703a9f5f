"""RFM features and KMeans customer segments.

rfm_base       per buyer: R = days from the cut-off to the last purchase,
               F = distinct orders, M = spend. Spark plans the distinct count
               as a two-level aggregate keyed first on (user, order). Over
               events that were not shuffled by user before (``priced_events``
               or a written table) the exchange on the user carries partial
               aggregates only, so a hot buyer is spread over tasks.
rfm_zscores    (x - mean) / sample std; mean and std come from one
               scalar subquery; a zero std gives 0.0 (as StandardScaler).
segment_users  VectorAssembler -> StandardScaler -> KMeans for k in 3..5,
               best silhouette wins (first on ties), centres labelled by the
               ordered rule, label attached per user. Only the k <= 5 centres
               reach the driver.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (DEFAULT_THRESHOLDS, DEFAULT_WEIGHTS, KMEANS_K_RANGE,
                         KMEANS_SEED, LABEL_UNMAPPED, TYPE_BUY)
from ..functions.dates import check_range, parse_date
from ..functions.segments import segment_label, segment_label_py, weighted_score


def cutoff_value(events: DataFrame) -> Column:
    """Last event date of the windowed log, as a scalar subquery."""
    return events.select(F.max("date")).scalar()


def rfm_base(wide: DataFrame, cutoff) -> DataFrame:
    """``cutoff``: a date / 'YYYY-MM-DD' or a Column (e.g. ``cutoff_value``)."""
    cut = cutoff if isinstance(cutoff, Column) else F.lit(parse_date(cutoff))
    return (wide.filter(F.col("type") == TYPE_BUY).groupBy("user_id").agg(
        F.datediff(cut, F.max("date")).alias("R"),
        F.count_distinct("order_id").alias("F"),
        F.sum("price").cast("double").alias("M"),
    ))


def rfm_zscores(base: DataFrame, digits: int | None = 4) -> DataFrame:
    """R, F, M with their z-scores (sample std; 0.0 when the std is 0)."""
    stats = base.select(F.struct(
        *[F.avg(c).alias(f"mean_{c}") for c in "RFM"],
        *[F.stddev_samp(c).alias(f"std_{c}") for c in "RFM"],
    )).scalar()

    def z(c: str) -> Column:
        v = (F.col(c) - stats[f"mean_{c}"]) / F.nullif(stats[f"std_{c}"], F.lit(0.0))
        v = F.coalesce(v, F.lit(0.0))
        return (F.round(v, digits) if digits is not None else v).alias(f"{c}_z")
    return base.select("user_id", "R", "F", "M", z("R"), z("F"), z("M"))


def segment_rule(zs: DataFrame, thresholds: dict | None = None) -> DataFrame:
    """The centre rule applied per user on z-scores."""
    return zs.select("user_id", segment_label("R_z", "F_z", "M_z", thresholds).alias("rule_label"))


def rfm_score(zs: DataFrame, weights: dict | None = None, digits: int = 4) -> DataFrame:
    """Weighted score of each user's z-scores."""
    return zs.select("user_id", F.round(weighted_score("R_z", "F_z", "M_z", weights), digits).alias("score"))


@dataclass
class Segments:
    user_rfm: DataFrame            # (user_id, rfm_label)
    clustered: DataFrame           # base + features + cluster
    sweep: list                    # [(k, silhouette)]
    best_k: int
    best_score: float
    centers: list                  # z-score centres of the chosen model
    labels: dict                   # cluster id -> label
    kmeans_model: object = None
    scaler_model: object = None
    scores: dict = field(default_factory=dict)  # cluster id -> weighted score


def segment_users(base: DataFrame, ks=KMEANS_K_RANGE, seed: int = KMEANS_SEED,
                  thresholds: dict | None = None, weights: dict | None = None,
                  parallelism: int = 3, rows_per_partition: int = 1_000_000) -> Segments:
    """Standardise, sweep k, keep the best silhouette, label clusters and users."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    th = {**DEFAULT_THRESHOLDS, **(thresholds or {})}
    wt = {**DEFAULT_WEIGHTS, **(weights or {})}
    vec = VectorAssembler(inputCols=["R", "F", "M"], outputCol="features_raw").transform(
        base.select("user_id", F.col("R").cast("double").alias("R"),
                    F.col("F").cast("double").alias("F"), F.col("M").cast("double").alias("M")))
    # The per-buyer features are cached for the iterative fits only and
    # released at the end; results are planned from the lineage. The number of
    # partitions follows the row count (~rows_per_partition rows per task), and
    # rows are hash-placed and sorted by user id: seeded KMeans initialisation
    # depends on that layout, so segments are the same whatever the upstream
    # partitioning or cluster settings.
    cached = []

    def hold(df):
        cached.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return cached[-1]

    try:
        held = hold(vec)
        n_rows = held.count()
        # enough distinct buyers for k clusters? stops at the largest k
        n_distinct = held.select("R", "F", "M").distinct().limit(max(ks)).count()
        parts = max(1, -(-n_rows // rows_per_partition))
        scaler = StandardScaler(inputCol="features_raw", outputCol="features", withMean=True, withStd=True).fit(held)
        scaled = hold(scaler.transform(held.repartition(parts, "user_id").sortWithinPartitions("user_id")))
        scaled.count()
        evaluator = ClusteringEvaluator(predictionCol="cluster", featuresCol="features",
                                        metricName="silhouette", distanceMeasure="squaredEuclidean")

        def fit(k):
            if k > n_distinct:  # fewer distinct buyers than clusters: no fit
                return k, float("nan"), None
            model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(scaled)
            if sum(size > 0 for size in model.summary.clusterSizes) < 2:
                return k, float("nan"), model   # one cluster: no silhouette
            return k, float(evaluator.evaluate(model.transform(scaled))), model

        # The fits are independent Spark jobs over the same cached features, so
        # they run concurrently (as CrossValidator's ``parallelism`` does). A
        # failed fit raises.
        with ThreadPoolExecutor(max_workers=max(1, min(parallelism, len(ks)))) as pool:
            fits = list(pool.map(fit, ks))
    finally:
        for df in cached:
            df.unpersist()
    scaled = scaler.transform(vec)
    best = (None, -1.0, None)
    sweep = []
    for k, score, model in fits:  # in k order: the first of equal scores wins
        sweep.append((k, score))
        if model is not None and score == score and score > best[1]:
            best = (k, score, model)
    if best[2] is None:
        # No k separated the data (fewer than two distinct buyers, or every
        # fit degenerate): keep the first fitted model, else one cluster at
        # the standardised mean.
        fitted = [(k, sc, m) for k, sc, m in fits if m is not None]
        if fitted:
            best = fitted[0]
        else:
            centers = [[0.0, 0.0, 0.0]]
            labels = {0: segment_label_py(centers[0], th)}
            clustered = scaled.withColumn("cluster", F.lit(0))
            user_rfm = clustered.select("user_id", F.lit(labels[0]).alias("rfm_label"))
            return Segments(user_rfm=user_rfm, clustered=clustered, sweep=sweep, best_k=1,
                            best_score=float("nan"), centers=centers, labels=labels,
                            kmeans_model=None, scaler_model=scaler,
                            scores={0: 0.0})
    best_k, best_score, model = best
    centers = [list(map(float, c)) for c in model.clusterCenters()]
    labels = {i: segment_label_py(c, th) for i, c in enumerate(centers)}
    scores = {i: wt["R"] * c[0] + wt["F"] * c[1] + wt["M"] * c[2] for i, c in enumerate(centers)}
    clustered = model.transform(scaled)
    mapping = F.create_map(*[x for i, lab in labels.items() for x in (F.lit(i), F.lit(lab))])
    user_rfm = clustered.select(
        "user_id", F.coalesce(mapping[F.col("cluster")], F.lit(LABEL_UNMAPPED)).alias("rfm_label"))
    return Segments(user_rfm=user_rfm, clustered=clustered, sweep=sweep, best_k=best_k,
                    best_score=best_score, centers=centers, labels=labels,
                    kmeans_model=model, scaler_model=scaler, scores=scores)


def sweep_frame(spark, seg: Segments) -> DataFrame:
    """The sweep as a DataFrame: (k, silhouette, chosen)."""
    rows = [(int(k), float(s), int(k) == seg.best_k) for k, s in seg.sweep]
    return spark.createDataFrame(rows, "k int, silhouette double, chosen boolean")


def assign_centers(zs: DataFrame, centers: list) -> DataFrame:
    """``cluster`` = the nearest of some given centres in z-score space (ties:
    the first). ``zs`` comes from ``rfm_zscores``."""
    def distance(c):
        return sum(((F.col(f"{n}_z") - F.lit(float(v))) * (F.col(f"{n}_z") - F.lit(float(v)))
                    for n, v in zip("RFM", c)), F.lit(0.0))
    nearest = F.array_min(F.array(*[F.struct(distance(c).alias("d"), F.lit(i).alias("i"))
                                    for i, c in enumerate(centers)]))
    return zs.withColumn("cluster", nearest["i"])


def profile_clusters(clustered: DataFrame, labels: dict) -> DataFrame:
    """Mean raw R/F/M (2 decimals), size and label per cluster, largest first."""
    mapping = F.create_map(*[x for i, lab in labels.items() for x in (F.lit(i), F.lit(lab))])
    return (clustered.groupBy("cluster").agg(
        F.round(F.avg("R"), 2).alias("r_mean"),
        F.round(F.avg("F"), 2).alias("f_mean"),
        F.round(F.avg("M"), 2).alias("m_mean"),
        F.count("user_id").alias("user_count"))
        .select(F.col("cluster").alias("cluster_id"),
                F.coalesce(mapping[F.col("cluster")], F.lit(LABEL_UNMAPPED)).alias("label"),
                "r_mean", "f_mean", "m_mean", "user_count")
        .orderBy(F.col("user_count").desc(), "cluster_id"))


def cluster_profiles(seg: Segments) -> DataFrame:
    """Profiles of the fitted clusters."""
    return profile_clusters(seg.clustered, seg.labels)


def buyer_days(facts: DataFrame) -> DataFrame:
    """Distinct (user_id, date) of the purchases: at most one row per day of a
    buyer, however many purchases."""
    return facts.select("user_id", "date").distinct()


def rfm_distribution(facts: DataFrame, user_rfm: DataFrame, start, end) -> DataFrame:
    """Distinct buyers in the range per segment label. ``facts`` may be the
    facts or their ``buyer_days``.

    Facts are first reduced to distinct buyers (partial aggregation, so a hot
    buyer is one row per task), then joined 1:1 with the segment table; the
    count of joined rows is then the exact distinct-user count. Over marts
    bucketed by ``user_id`` neither step needs an exchange.
    """
    lo, hi = check_range(start, end)
    buyers = (facts.filter(F.col("date").between(F.lit(lo), F.lit(hi)))
              .select("user_id").distinct())
    return (buyers.join(user_rfm, "user_id").groupBy("rfm_label")
            .agg(F.count(F.lit(1)).alias("cnt")))


def segment_rows(dist: DataFrame) -> DataFrame:
    """Chart rows (name, value, share_pct) of a segment distribution; the
    distribution has one row per label (at most six), so the share window
    runs on a handful of rows."""
    from pyspark.sql import Window
    total = F.sum("cnt").over(Window.partitionBy(F.lit(1)))
    return dist.select(F.coalesce(F.col("rfm_label"), F.lit(LABEL_UNMAPPED)).alias("name"),
                       F.col("cnt").alias("value"),
                       F.round(F.col("cnt") / F.nullif(total, F.lit(0)) * 100, 2).alias("share_pct"))


def save_models(seg: Segments, path: str) -> None:
    """Persist the chosen KMeans model and the scaler (overwrite)."""
    if seg.kmeans_model is not None:
        seg.kmeans_model.write().overwrite().save(path)
    seg.scaler_model.write().overwrite().save(path + "_scaler")
