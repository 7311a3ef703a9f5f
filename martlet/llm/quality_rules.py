"""Quality rules: base counts and robust multivariate outliers (DataFrame only).

Method: per (language, source) a minimum-covariance-determinant estimate of
the centre and scatter of transformed text statistics; documents beyond a
Mahalanobis cut-off are rejected.

* Statistics come from one scan of the texts and stay inside the row (arrays
  and higher-order functions), so texts are never shuffled.
* Statistics are transformed to integers in units of ``1/SCALE``. All sums are
  then exact BIGINT sums: estimates do not depend on task order, and a
  recomputed partition gives the same bits.
* Concentration steps are grouped aggregates over the slim statistics table.
  Each group keeps the smallest set of distance bins that holds at least
  ``SUPPORT`` of its rows (a half by default) and re-estimates from them.
  Groups are only ever aggregated with map-side partial sums: a source with a
  third of all rows costs one row per task.
* Scatter is regularised by a least variance per statistic, so constant
  statistics (most clean groups have no repeated line) stay invertible. Each
  floor is small enough for its statistic to cross any cut-off alone.
* The cut-off is a robust tail quantile of each group's own distances, over all
  of its base-passing rows.

Edge cases: NULL text has no words; NULL language or source is a group of its
own; the groups of a language with fewer than ``MIN_GROUP`` base-passing rows
are pooled, and where the pool is smaller too it is judged by an estimate over
all rows of the language; where those are fewer as well there is no estimate
and the base rules alone decide; an empty table gives an empty result. Repeated rows
are judged alike.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialise, packed, table

WS = "[\\x20\\x09-\\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

SCALE = 256          # integer units per unit of a transformed statistic
SUPPORT = 0.5        # least share of rows in the concentrated set
STEPS = 4            # concentration steps
MIN_GROUP = 50       # fewer rows: no estimate
BINS_PER_OCTAVE = 16  # resolution of the distance bins
#: Least standard deviations, in transformed units (see ``_transformed``).
#: Repeated lines and windows reach log(301) within the base rules, which is
#: nine floors.
FLOORS = {"t_len": 0.30, "t_word": 0.12, "t_sym": 0.50, "t_dup": 0.62, "t_rep": 0.62, "t_rich": 0.20}
#: Bounds of the squared distance beyond which a document is rejected. At
#: least the 0.999 quantile of chi-squared with six degrees of freedom; at
#: most nine standard deviations in one statistic, so that a group with much
#: junk cannot raise it at will.
LEAST_CUTOFF = 22.46
CUTOFF = 80.0
TAIL = 3.09          # normal quantile of 0.999
DIMS = list(FLOORS)


def text_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Append ``n_words, n_distinct, word_chars, n_symbols, n_dup_lines,
    n_repeat_words`` (BIGINT) to the rows of ``df``, from the whole ``text``."""
    names = [c for c in df.columns]
    t = F.coalesce(F.col(text), F.lit(""))
    stripped = F.btrim(t, F.lit(BLANKS))
    words = F.when(stripped == "", F.array().cast("array<string>")).otherwise(F.split(stripped, WS))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    squeezed = reduce(lambda x, b: F.replace(x, F.lit(b), F.lit("")), BLANKS, t)
    # Each select below names what the next one uses more than once: Spark
    # then evaluates it once a row instead of inlining it at every use.
    step = df.select(
        *names,
        F.length(squeezed).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
        F.transform(words, lambda w: F.xxhash64(w)).alias("_w1"))
    step = step.select(
        *names, "word_chars", "n_symbols", "_w1",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_w1").cast("long").alias("n_words"),
        F.size(F.array_distinct("_w1")).cast("long").alias("n_distinct"))
    done = [*names, "n_words", "n_distinct", "word_chars", "n_symbols", "n_dup_lines"]
    # hashes of 2, 4 and 8 consecutive words, each from two of the level below
    width = 1
    while width < WINDOW:
        w = F.col(f"_w{width}")
        step = step.select(*done, F.zip_with(
            w, F.slice(w, F.lit(1 + width), F.greatest(F.size(w), F.lit(0))),
            lambda x, y: F.xxhash64(x, y)).alias(f"_w{2 * width}"))
        width *= 2
    step = step.select(*done, F.when(F.col("n_words") >= WINDOW, F.slice(
        f"_w{WINDOW}", F.lit(1), (F.col("n_words") - (WINDOW - 1)).cast("int"))).alias("_windows"))
    return step.select(*done, F.coalesce(_covered(F.col("_windows")), F.lit(0)).cast("long").alias("n_repeat_words"))


def _covered(windows: Column) -> Column:
    """Words inside windows that occur twice or more in the row's text."""
    m = F.size(windows)
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeated = F.transform(
        F.array(pairs),
        lambda s: F.sort_array(F.transform(F.filter(
            s, lambda x, j: ((j > 0) & (F.get(s, j - 1)["h"] == x["h"]))
            | ((j < F.size(s) - 1) & (F.get(s, j + 1)["h"] == x["h"]))), lambda x: x["i"])))
    gaps = F.transform(repeated, lambda p: F.aggregate(
        F.transform(p, lambda x, j: F.when(j == 0, WINDOW).otherwise(
            F.least(F.lit(WINDOW), x - F.get(p, j - 1)))),
        F.lit(0), lambda a, x: a + x))
    return F.when(m > F.size(F.array_distinct(windows)), gaps[0])


def base_failed() -> Column:
    return ((F.col("n_words") < MIN_WORDS)
            | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def _transformed() -> dict[str, Column]:
    """Integer statistics in units of 1/SCALE: log length, log mean word
    length, log rates per thousand words, and log words per distinct word."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    rate = lambda c: F.log1p(1000.0 * F.col(c) / n)
    raw = {"t_len": F.log1p(n.cast("double")),
           "t_word": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
           "t_sym": rate("n_symbols"), "t_dup": rate("n_dup_lines"), "t_rep": rate("n_repeat_words"),
           "t_rich": F.log(n / F.greatest(F.col("n_distinct"), F.lit(1)))}
    return {k: F.round(v * SCALE).cast("long") for k, v in raw.items()}


GROUP = ["g_lang", "g_source", "g_pooled"]


def _join_groups(left: DataFrame, right: DataFrame, how: str, *also: str) -> DataFrame:
    """Join on the group (NULL equals NULL) and any further columns."""
    keys = [*GROUP, *also]
    r = right.withColumnsRenamed({k: f"r_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"r_{k}")) for k in keys])
    out = left.join(r, on, how)
    return out if how == "left_semi" else out.drop(*[f"r_{k}" for k in keys])


def _start(stats: DataFrame) -> DataFrame:
    """Per group: exact coordinate medians and MAD-like spreads from counts of
    the integer values (a deterministic, high-breakdown start)."""
    cells = (stats.select(*GROUP, F.explode(F.array(*[
        F.struct(F.lit(d).alias("dim"), F.col(d).alias("v")) for d in DIMS])).alias("c"))
        .groupBy(*GROUP, "c.dim", "c.v").agg(F.count("*").alias("n")))

    def middle(counts: DataFrame, value: str, out: str) -> DataFrame:
        w = Window.partitionBy(*GROUP, "dim").orderBy(value)
        total = F.sum("n").over(Window.partitionBy(*GROUP, "dim"))
        return (counts.withColumn("upto", F.sum("n").over(w)).withColumn("total", total)
                .where(2 * F.col("upto") >= F.col("total"))
                .groupBy(*GROUP, "dim").agg(F.min(value).alias(out)))

    med = middle(cells, "v", "med")
    dev = (_join_groups(cells, med, "inner", "dim")
           .select(*GROUP, "dim", "med", "n", F.abs(F.col("v") - F.col("med")).alias("v"))
           .groupBy(*GROUP, "dim", "med", "v").agg(F.sum("n").alias("n")))
    w = Window.partitionBy(*GROUP, "dim").orderBy("v")
    dev = (dev.withColumn("upto", F.sum("n").over(w))
           .withColumn("total", F.sum("n").over(Window.partitionBy(*GROUP, "dim")))
           .where(2 * F.col("upto") >= F.col("total"))
           .groupBy(*GROUP, "dim").agg(F.min("med").alias("med"), F.min("v").alias("mad")))
    one = lambda d, c: F.max(F.when(F.col("dim") == d, F.col(c)))
    wide = dev.groupBy(*GROUP).agg(*[one(d, "med").cast("double").alias(f"m_{d}") for d in DIMS],
                                   *[(1.4826 * one(d, "mad")).alias(f"s_{d}") for d in DIMS])
    cov = {}
    for i, a in enumerate(DIMS):
        for b in DIMS[:i + 1]:
            cov[a, b] = F.col(f"s_{a}") * F.col(f"s_{a}") if a == b else F.lit(0.0)
    return _factored(wide, cov)


def _factored(groups: DataFrame, cov: dict[tuple[str, str], Column]) -> DataFrame:
    """Cholesky factor of the floored scatter, as columns ``l_<a>_<b>``."""
    out = groups
    for i, a in enumerate(DIMS):
        floor = (FLOORS[a] * SCALE) ** 2
        for j, b in enumerate(DIMS[:i + 1]):
            done = [F.col(f"l_{a}_{c}") * F.col(f"l_{b}_{c}") for c in DIMS[:j]]
            rest = cov[a, b] - reduce(lambda x, y: x + y, done, F.lit(0.0))
            value = (F.sqrt(F.greatest(rest, F.lit(floor))) if a == b
                     else rest / F.col(f"l_{b}_{b}"))
            out = out.withColumn(f"l_{a}_{b}", value)
    return out.select(*GROUP, *[f"m_{d}" for d in DIMS],
                      *[f"l_{a}_{b}" for i, a in enumerate(DIMS) for b in DIMS[:i + 1]])


def _with_distance(rows: DataFrame, groups: DataFrame, how: str = "inner") -> DataFrame:
    """``d2`` = squared Mahalanobis distance by forward substitution.

    Equi-join on the group; with no hint, Spark broadcasts the group table
    only below its byte threshold, else AQE splits a hot source."""
    out = _join_groups(rows, groups, how)
    for i, a in enumerate(DIMS):
        used = [F.col(f"l_{a}_{b}") * F.col(f"z_{b}") for b in DIMS[:i]]
        rest = F.col(a) - F.col(f"m_{a}") - reduce(lambda x, y: x + y, used, F.lit(0.0))
        out = out.withColumn(f"z_{a}", rest / F.col(f"l_{a}_{a}"))
    d2 = reduce(lambda x, y: x + y, [F.col(f"z_{d}") * F.col(f"z_{d}") for d in DIMS])
    return out.select(*rows.columns, d2.alias("d2"), *[c for c in ("cut",) if c in groups.columns])


def _bin() -> Column:
    return F.floor(F.log2(F.greatest(F.col("d2"), F.lit(2.0 ** -10))) * BINS_PER_OCTAVE).cast("int")


def _concentrate(stats: DataFrame, groups: DataFrame) -> DataFrame:
    """One concentration step: estimates from each group's nearest half."""
    near = _with_distance(stats, groups).withColumn("bin", _bin())
    sums = [F.count("*").alias("n"), *[F.sum(d).alias(f"s_{d}") for d in DIMS],
            *[F.sum(F.col(a) * F.col(b)).alias(f"p_{a}_{b}") for i, a in enumerate(DIMS) for b in DIMS[:i + 1]]]
    bins = near.groupBy(*GROUP, "bin").agg(*sums)
    w = Window.partitionBy(*GROUP)
    before = F.coalesce(F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = (bins.withColumn("before", before).withColumn("total", F.sum("n").over(w))
            .where(F.col("before") < SUPPORT * F.col("total")))
    total = (kept.groupBy(*GROUP).agg(*[F.sum(c).alias(c) for c in bins.columns if c not in (*GROUP, "bin")])
             .where(F.col("n") >= SUPPORT * MIN_GROUP))
    n = F.col("n")
    cov = {(a, b): F.col(f"p_{a}_{b}") / n - (F.col(f"s_{a}") / n) * (F.col(f"s_{b}") / n)
           for i, a in enumerate(DIMS) for b in DIMS[:i + 1]}
    # a half of a normal sample is too narrow: the usual consistency factor
    # 0.5 / P(chi2_8 <= median of chi2_6) for six statistics
    factor = 1.8
    return _factored(total.withColumns({f"m_{d}": F.col(f"s_{d}") / n for d in DIMS}),
                     {k: factor * v for k, v in cov.items()})


def _with_cutoff(stats: DataFrame, groups: DataFrame) -> DataFrame:
    """Append ``cut``: cube roots of chi-squared distances are close to normal,
    and the 0.999 quantile of that normal follows from their median and upper
    quartile, which junk of up to a quarter of the rows hardly moves."""
    bins = (_with_distance(stats, groups).groupBy(*GROUP, _bin().alias("bin")).agg(F.count("*").alias("n")))
    w = Window.partitionBy(*GROUP)
    upto, total = F.sum("n").over(w.orderBy("bin")), F.sum("n").over(w)
    root = F.pow(F.lit(2.0), (F.col("bin") + 0.5) / (3 * BINS_PER_OCTAVE))
    cut = (bins.select(*GROUP, root.alias("root"), upto.alias("upto"), total.alias("total")).groupBy(*GROUP)
           .agg(F.min(F.when(2 * F.col("upto") >= F.col("total"), F.col("root"))).alias("half"),
                F.min(F.when(4 * F.col("upto") >= 3 * F.col("total"), F.col("root"))).alias("upper")))
    tail = F.pow(F.col("half") + TAIL / 0.6745 * (F.col("upper") - F.col("half")), F.lit(3.0))
    cut = cut.select(*GROUP, F.greatest(F.lit(LEAST_CUTOFF), F.least(F.lit(CUTOFF), tail)).alias("cut"))
    return _join_groups(groups, cut, "inner")


def grouped(stats: DataFrame) -> DataFrame:
    """Add ``g_pooled``; small (language, source) groups join their language's
    pool (``g_source`` NULL). The size table has a row per group."""
    small = (stats.where(~base_failed()).groupBy("g_lang", "g_source").agg(F.count("*").alias("g_n"))
             .withColumnsRenamed({"g_lang": "r_lang", "g_source": "r_source"}))
    pooled = F.coalesce(F.col("g_n"), F.lit(0)) < MIN_GROUP
    return (stats.join(small, F.col("g_lang").eqNullSafe(F.col("r_lang"))
                       & F.col("g_source").eqNullSafe(F.col("r_source")), "left")
            .withColumn("g_pooled", pooled)
            .withColumn("g_source", F.when(~pooled, F.col("g_source")))
            .drop("r_lang", "r_source", "g_n"))


def _widened(slim: DataFrame) -> DataFrame:
    """Pools of fewer than ``MIN_GROUP`` rows also get the rows of their
    language's large groups, which stay in those as well."""
    few = materialise(slim.groupBy("g_lang").agg(F.count_if("g_pooled").alias("pooled"), F.count("*").alias("n"))
                      .where((F.col("pooled") > 0) & (F.col("pooled") < MIN_GROUP) & (F.col("n") > F.col("pooled")))
                      .select(F.col("g_lang").alias("few_lang")), "mcd-few")
    if few.isEmpty():
        return slim
    more = (slim.where(~F.col("g_pooled")).join(few, F.col("g_lang").eqNullSafe(F.col("few_lang")), "left_semi")
            .withColumn("g_source", F.lit(None).cast(slim.schema["g_source"].dataType)).withColumn("g_pooled", F.lit(True)))
    out = materialise(slim.unionByName(more), "mcd-rows")
    discard(slim)
    return out


def fit(stats: DataFrame) -> DataFrame:
    """Centre, Cholesky factor and cut-off per group, from the rows that pass the base
    rules. ``stats`` comes from :func:`grouped` over a written table; a slim
    copy (integers only) is written once and read once per step."""
    slim = _widened(materialise(stats.where(~base_failed()).select(
        *GROUP, *[c.alias(k) for k, c in _transformed().items()]), "mcd-rows"))
    groups = materialise(_start(slim), "mcd-start")
    for _ in range(STEPS):
        previous, groups = groups, materialise(_concentrate(slim, groups), "mcd-step")
        discard(previous)
    previous, groups = groups, materialise(_with_cutoff(slim, groups), "mcd-cutoff")
    discard(previous)
    discard(slim)
    return groups


def judge(stats: DataFrame, groups: DataFrame) -> DataFrame:
    """Append ``base_failed, d2, kept`` (d2 NULL where a group has no estimate)."""
    rows = stats.withColumns(_transformed())
    out = _with_distance(rows, groups, "left").withColumn("base_failed", base_failed())
    far = F.coalesce(F.col("d2") > F.col("cut"), F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & ~far).drop("cut")


def quality_rules(docs: DataFrame, text: str = "text", lang: str = "lang",
                  source: str = "source", keep: tuple[str, ...] | None = None) -> DataFrame:
    """Judge every row: ``row`` (struct of ``keep``, default all columns),
    the five counts, ``base_failed``, ``d2`` and ``kept``."""
    chosen = docs.select(F.struct(*(keep or ["*"])).alias("row"), F.col(text).alias("text"),
                         F.col(lang).alias("g_lang"), F.col(source).alias("g_source"))
    stats = grouped(materialise(text_statistics(chosen).drop("text"), "quality-stats"))
    return judge(stats, fit(stats))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    return quality_rules(docs, keep=("doc_id",)).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "d2")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the rules reject go."""
    return quality_rules(docs).where("kept").select("row.*")
