"""DuckDB twins of the registered queries (correctness oracle).

Each entry is one self-contained statement over the pre-registered views
(``events part customer orders lineitem`` ...). The CTE fragments below
re-state the fixture mapping and each operator independently in plain SQL
(the cohort oracle joins against cohort sizes, the head-share oracle ranks
items with ``row_number``), so agreement is a real cross-check.
"""

from __future__ import annotations

from .constants import (CATEGORY_PREFIX, DEFAULT_THRESHOLDS, DEFAULT_WEIGHTS,
                        FUNNEL_STAGE_NAMES, ITEM_PREFIX, LABEL_CHURNED,
                        LABEL_CORE_VALUE, LABEL_LOYAL, LABEL_POTENTIAL,
                        LABEL_REGULAR, UNKNOWN_AGE_GROUP, UNKNOWN_CHANNEL)
from .functions.dates import comparison_windows
from .functions.segments import segment_label_py
from . import registry as R


def D(x: str) -> str:
    """Epoch seconds -> UTC date, independent of DuckDB's TimeZone."""
    return f"CAST(TIMESTAMP '1970-01-01 00:00:00' + to_seconds({x}) AS DATE)"


def lit(d) -> str:
    return f"DATE '{d}'"


_ITEM = ("((user_id * 13 + TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) % 4) "
         "% (SELECT max(p_partkey) + 1 FROM part))")

LOG = f"""log AS (
  SELECT CAST(user_id AS INTEGER) AS user_id,
         CAST({_ITEM} AS INTEGER) AS item_id,
         CAST({_ITEM} % 25 AS INTEGER) AS category_id,
         CASE event_type WHEN 'view' THEN 'pv' WHEN 'click' THEN 'cart' WHEN 'purchase' THEN 'buy'
              ELSE event_type END AS type,
         CAST(floor(epoch(ts)) AS BIGINT) AS ts
  FROM events)"""

# The broken lines, and what each kind has wrong with it.
RAW = f"""raw AS (
  SELECT kind, u, i, c, t, s, CASE kind
    WHEN 0 THEN concat_ws(',', u, i, c, t) WHEN 1 THEN concat_ws(',', u, i, c, t, s, '9')
    WHEN 2 THEN concat_ws(',', 'abc', i, c, t, s) WHEN 3 THEN concat_ws(',', u, i, c, t, 'noon')
    WHEN 4 THEN concat_ws(',', u, '', c, t, s) WHEN 5 THEN concat_ws(',', u, i, c, '', s)
    WHEN 6 THEN concat_ws(',', '99999999999', i, c, t, s) WHEN 7 THEN concat_ws(',', u, i, c, '"' || t || '"', s)
    WHEN 8 THEN concat_ws(',', u, i, '', t, s) WHEN 9 THEN concat_ws(',', u, i, 'x', t, s)
    WHEN 10 THEN concat_ws(',', u, 'z', c, t, '') WHEN 11 THEN concat_ws(',', ' ' || u || ' ', i, c, ' ' || t || ' ', s)
    WHEN 12 THEN concat_ws(',', u, i, c, '"' || t, s) WHEN 13 THEN ',,,,'
    ELSE concat_ws(',', u, i, c, t, s) END AS line,
    CASE WHEN kind IN (0, 1, 12) THEN 'fields' WHEN kind IN (2, 6) THEN 'user_id' WHEN kind = 3 THEN 'ts' WHEN kind = 4 THEN 'item_id'
         WHEN kind = 5 THEN 'type' WHEN kind = 9 THEN 'category_id' WHEN kind = 10 THEN 'item_id,ts'
         WHEN kind = 13 THEN 'user_id,item_id,type,ts' END AS reason
  FROM (SELECT event_id % 50 AS kind, CAST(user_id AS INTEGER) AS u, CAST({_ITEM} AS INTEGER) AS i,
               CAST({_ITEM} % 25 AS INTEGER) AS c,
               CASE event_type WHEN 'view' THEN 'pv' WHEN 'click' THEN 'cart' WHEN 'purchase' THEN 'buy'
                    ELSE event_type END AS t, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events))"""

ITEMS = """items AS (
  SELECT CAST(p_partkey AS INTEGER) AS item_id, CAST(p_size AS INTEGER) AS category_id,
         CAST(CASE WHEN p_partkey % 10 <> 9 THEN p_retailprice END AS DECIMAL(10,2)) AS price
  FROM part)"""

USERS = """users AS (
  SELECT CAST(c_custkey AS INTEGER) AS user_id,
         CASE WHEN c_custkey % 11 = 10 THEN NULL
              WHEN c_nationkey < 6 THEN '18-24' WHEN c_nationkey < 13 THEN '25-34'
              WHEN c_nationkey < 19 THEN '35-45' WHEN c_nationkey < 24 THEN '46+' END AS age_group,
         CASE WHEN c_custkey % 11 <> 10 THEN c_mktsegment END AS channel
  FROM customer)"""

EV = f"""ev AS (
  SELECT user_id, item_id, category_id, type, ts, {D('ts')} AS date,
         concat_ws('_', user_id, ts, item_id) AS order_id
  FROM log WHERE {D('ts')} BETWEEN DATE '2024-01-01' AND DATE '2024-01-31')"""

JOINED = """joined AS (
  SELECT ev.*, i.price, u.age_group, u.channel
  FROM ev LEFT JOIN items i ON ev.item_id = i.item_id LEFT JOIN users u ON ev.user_id = u.user_id)"""

WIDE = f"""wide AS (
  SELECT user_id, item_id, category_id, type, ts, date, order_id, price,
         COALESCE(channel, '{UNKNOWN_CHANNEL}') AS channel, COALESCE(age_group, '{UNKNOWN_AGE_GROUP}') AS age_group
  FROM joined WHERE price IS NOT NULL)"""

BUY = """buy AS (
  SELECT date, user_id, order_id, item_id, category_id, price, channel, age_group
  FROM wide WHERE type = 'buy')"""

TOUCH = """touch AS (
  SELECT user_id, item_id,
         min(CASE WHEN type = 'pv' THEN ts END) AS first_pv,
         min(CASE WHEN type = 'cart' THEN ts END) AS first_cart,
         min(CASE WHEN type = 'buy' THEN ts END) AS first_buy
  FROM wide GROUP BY user_id, item_id)"""

_DATES = f"""{D('first_pv')} AS pv_date,
         {D('first_cart')} AS cart_date, {D('first_buy')} AS buy_date"""

SFLAGS = f"""sflags AS (
  SELECT user_id, item_id,
         CASE WHEN first_pv IS NOT NULL THEN 1 ELSE 0 END AS has_pv,
         CASE WHEN first_pv IS NOT NULL AND first_cart IS NOT NULL AND first_cart >= first_pv THEN 1 ELSE 0 END AS has_cart,
         CASE WHEN first_pv IS NOT NULL AND first_cart IS NOT NULL AND first_cart >= first_pv
                   AND first_buy IS NOT NULL AND first_buy >= first_cart THEN 1 ELSE 0 END AS has_buy,
         {_DATES}
  FROM touch)"""

LFLAGS = f"""lflags AS (
  SELECT user_id, item_id,
         CASE WHEN first_pv IS NOT NULL THEN 1 ELSE 0 END AS has_pv,
         CASE WHEN first_cart IS NOT NULL THEN 1 ELSE 0 END AS has_cart,
         CASE WHEN first_buy IS NOT NULL THEN 1 ELSE 0 END AS has_buy,
         {_DATES}
  FROM touch)"""


def stages(flags: str, name: str) -> str:
    return f"""{name} AS (
  SELECT user_id, pv_date AS date, 1 AS has_pv, 0 AS has_cart, 0 AS has_buy FROM {flags} WHERE has_pv = 1
  UNION ALL SELECT user_id, cart_date, 0, 1, 0 FROM {flags} WHERE has_cart = 1
  UNION ALL SELECT user_id, buy_date, 0, 0, 1 FROM {flags} WHERE has_buy = 1)"""


def mart(stage_cte: str, name: str) -> str:
    return f"""{name} AS (
  SELECT user_id, date, max(has_pv) AS has_pv, max(has_cart) AS has_cart, max(has_buy) AS has_buy
  FROM {stage_cte} GROUP BY user_id, date)"""


SMART = ",\n".join([stages("sflags", "sev"), mart("sev", "smart")])
LMART = ",\n".join([stages("lflags", "lev"), mart("lev", "lmart")])

COHORT = """coh AS (SELECT user_id, min(date) AS cohort_date FROM wide GROUP BY user_id),
sizes AS (SELECT cohort_date, count(*) AS cohort_users FROM coh GROUP BY cohort_date),
act AS (SELECT DISTINCT user_id, date FROM wide),
cells AS (
  SELECT c.cohort_date, CAST(a.date - c.cohort_date AS INTEGER) AS day_diff, count(*) AS active_users
  FROM act a JOIN coh c ON a.user_id = c.user_id
  WHERE a.date - c.cohort_date BETWEEN 0 AND 7 GROUP BY 1, 2),
cm AS (SELECT cells.cohort_date, day_diff, active_users, cohort_users
       FROM cells JOIN sizes ON cells.cohort_date = sizes.cohort_date)"""

RFM = """cut AS (SELECT max(date) AS cutoff FROM ev),
rb AS (
  SELECT user_id, CAST((SELECT cutoff FROM cut) - max(date) AS INTEGER) AS R,
         count(DISTINCT order_id) AS F, CAST(sum(price) AS DOUBLE) AS M
  FROM wide WHERE type = 'buy' GROUP BY user_id),
st AS (SELECT avg(R) AS mr, avg(F) AS mf, avg(M) AS mm,
              stddev_samp(R) AS sr, stddev_samp(F) AS sf, stddev_samp(M) AS sm FROM rb),
zs AS (
  SELECT user_id, R, F, M,
         COALESCE((R - mr) / NULLIF(sr, 0.0), 0.0) AS R_z,
         COALESCE((F - mf) / NULLIF(sf, 0.0), 0.0) AS F_z,
         COALESCE((M - mm) / NULLIF(sm, 0.0), 0.0) AS M_z
  FROM rb, st)"""

FACTS = """facts AS (
  SELECT CAST(o.o_orderdate AS DATE) AS date, CAST(o.o_custkey AS INTEGER) AS user_id,
         CAST(l.l_orderkey AS VARCHAR) AS order_id, CAST(l.l_partkey AS INTEGER) AS item_id,
         CAST(p.p_size AS INTEGER) AS category_id, CAST(l.l_extendedprice AS DECIMAL(10,2)) AS price,
         o.o_orderpriority AS channel, c.c_mktsegment AS age_group
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
       JOIN part p ON l.l_partkey = p.p_partkey JOIN customer c ON o.o_custkey = c.c_custkey)"""

PIPE = [LOG, ITEMS, USERS, EV, JOINED, WIDE]


def edge(select_sql: str) -> str:
    """Row-level price as DOUBLE, as the registered Spark output presents it."""
    return f"SELECT * REPLACE (CAST(price AS DOUBLE) AS price) FROM ({select_sql})"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def week(d: str) -> str:
    return (f"CAST(year({d}) AS VARCHAR) || '-' || "
            f"lpad(CAST(CAST(floor((dayofyear({d}) + 6 - (isodow({d}) - 1)) / 7) AS INTEGER) AS VARCHAR), 2, '0')")


def label(d: str, period: str) -> str:
    return {"day": f"strftime({d}, '%Y-%m-%d')", "month": f"strftime({d}, '%Y-%m')", "week": week(d)}[period]


def rng(start, end, col: str = "date") -> str:
    return f"{col} BETWEEN {lit(start)} AND {lit(end)}"


def trend_sql(src: str, start, end, period: str) -> str:
    return (f"SELECT {label('date', period)} AS dt, CAST(sum(price) AS DOUBLE) AS sales, "
            f"count(DISTINCT order_id) AS orders FROM {src} WHERE {rng(start, end)} GROUP BY 1 ORDER BY 1")


def top_sql(src: str, start, end, key: str, prefix: str, lab: str, k: int = 10) -> str:
    return f"""SELECT CAST(row_number() OVER (ORDER BY s DESC, {key} ASC NULLS LAST) AS INTEGER) AS rank, {key},
       '{prefix}' || CAST({key} AS VARCHAR) AS {lab}, CAST(s AS DOUBLE) AS sales
FROM (SELECT {key}, sum(price) AS s FROM {src} WHERE {rng(start, end)} GROUP BY {key}
      ORDER BY s DESC, {key} ASC NULLS LAST LIMIT {k})"""


def growth_select(src: str, start, end, period: str) -> str:
    w = comparison_windows(start, end, period)
    cur, prev, ly = rng(*w["current"]), rng(*w["previous"]), rng(*w["last_year"])
    return f"""SELECT '{period}' AS period,
       {lit(w['previous'][0])} AS prev_start, {lit(w['previous'][1])} AS prev_end,
       {lit(w['last_year'][0])} AS ly_start, {lit(w['last_year'][1])} AS ly_end,
       total_sales, total_orders, prev_sales, ly_sales,
       round((total_sales - prev_sales) / NULLIF(prev_sales, 0.0) * 100, 2) AS qoq_rate,
       round((total_sales - ly_sales) / NULLIF(ly_sales, 0.0) * 100, 2) AS yoy_rate
FROM (SELECT round(COALESCE(CAST(sum(CASE WHEN {cur} THEN price END) AS DOUBLE), 0.0), 2) AS total_sales,
             count(DISTINCT CASE WHEN {cur} THEN order_id END) AS total_orders,
             CAST(sum(CASE WHEN {prev} THEN price END) AS DOUBLE) AS prev_sales,
             CAST(sum(CASE WHEN {ly} THEN price END) AS DOUBLE) AS ly_sales
      FROM {src} WHERE ({cur}) OR ({prev}) OR ({ly}))"""


def kpi_select(src: str, mart_cte: str, start, end, period: str) -> str:
    from .constants import PERIOD_LABELS
    return f"""SELECT total_sales, total_orders,
       (SELECT CAST(COALESCE(sum(has_buy), 0) AS BIGINT) FROM {mart_cte} WHERE {rng(start, end)}) AS paying_users,
       (SELECT count(DISTINCT CASE WHEN has_buy = 1 THEN user_id END) FROM {mart_cte} WHERE {rng(start, end)}) AS distinct_paying_users,
       COALESCE(round(total_sales / NULLIF(CAST(total_orders AS DOUBLE), 0.0), 2), 0.0) AS avg_order_value,
       qoq_rate, yoy_rate, '{PERIOD_LABELS[period]}' AS period_label
FROM ({growth_select(src, start, end, period)})"""


def breakdown_sql(src: str, start, end, k: int = 10) -> str:
    return f"""SELECT dimension, name, CAST(s AS DOUBLE) AS sales, rank FROM (
  SELECT dimension, name, s, CAST(row_number() OVER (PARTITION BY dimension
           ORDER BY s DESC, category_id ASC NULLS LAST, name ASC NULLS LAST) AS INTEGER) AS rank
  FROM (SELECT CASE WHEN GROUPING(category_id) = 0 THEN 'category'
                    WHEN GROUPING(channel) = 0 THEN 'channel' ELSE 'age_group' END AS dimension,
               CASE WHEN GROUPING(category_id) = 0 THEN '{CATEGORY_PREFIX}' || CAST(category_id AS VARCHAR)
                    WHEN GROUPING(channel) = 0 THEN channel ELSE age_group END AS name,
               category_id, sum(price) AS s
        FROM {src} WHERE {rng(start, end)}
        GROUP BY GROUPING SETS ((category_id), (channel), (age_group))))
WHERE dimension <> 'category' OR rank <= {k}"""


def rule_sql() -> str:
    th = DEFAULT_THRESHOLDS
    return f"""SELECT user_id, CASE WHEN R_z > {th['high_r']} THEN '{LABEL_CHURNED}'
    WHEN M_z > {th['high_m']} AND R_z < 0 THEN '{LABEL_CORE_VALUE}'
    WHEN F_z > {th['high_f']} AND M_z <= {th['high_m']} THEN '{LABEL_LOYAL}'
    WHEN R_z <= 0 AND (F_z > 0 OR M_z > 0) THEN '{LABEL_POTENTIAL}'
    ELSE '{LABEL_REGULAR}' END AS rule_label FROM zs"""


def bundle_sql(start, end, period: str) -> str:
    n1, n2, n3 = FUNNEL_STAGE_NAMES
    core = kpi_select("buy", "smart", start, end, period)
    return with_(*PIPE, BUY, TOUCH, SFLAGS, SMART, COHORT, RFM) + f"""
, core AS ({core}),
trend AS ({trend_sql('buy', start, end, period)}),
ft AS (SELECT CAST(COALESCE(sum(has_pv), 0) AS BIGINT) AS pv, CAST(COALESCE(sum(has_cart), 0) AS BIGINT) AS cart,
              CAST(COALESCE(sum(has_buy), 0) AS BIGINT) AS buy FROM smart WHERE {rng(start, end)}),
top AS ({top_sql('buy', start, end, 'item_id', ITEM_PREFIX, 'item_label')}),
dims AS ({breakdown_sql('buy', start, end)})
SELECT 'core' AS section, 'total_sales' AS name, CAST(total_sales AS DOUBLE) AS value FROM core
UNION ALL SELECT 'core', 'total_orders', CAST(total_orders AS DOUBLE) FROM core
UNION ALL SELECT 'core', 'paying_users', CAST(paying_users AS DOUBLE) FROM core
UNION ALL SELECT 'core', 'avg_order_value', CAST(avg_order_value AS DOUBLE) FROM core
UNION ALL SELECT 'core', 'qoq_rate', CAST(qoq_rate AS DOUBLE) FROM core
UNION ALL SELECT 'core', 'yoy_rate', CAST(yoy_rate AS DOUBLE) FROM core
UNION ALL SELECT 'trend_sales', dt, sales FROM trend
UNION ALL SELECT 'trend_orders', dt, CAST(orders AS DOUBLE) FROM trend
UNION ALL SELECT 'funnel', '{n1}', CAST(pv AS DOUBLE) FROM ft
UNION ALL SELECT 'funnel', '{n2}', CAST(cart AS DOUBLE) FROM ft
UNION ALL SELECT 'funnel', '{n3}', CAST(buy AS DOUBLE) FROM ft
UNION ALL SELECT 'rankings', item_label, sales FROM top
UNION ALL SELECT dimension, name, sales FROM dims
UNION ALL SELECT 'period', period_label, 1.0 FROM core
UNION ALL SELECT 'date_range', 'min_date', CAST(min(date) - DATE '1970-01-01' AS DOUBLE) FROM buy
UNION ALL SELECT 'date_range', 'max_date', CAST(max(date) - DATE '1970-01-01' AS DOUBLE) FROM buy
UNION ALL SELECT 'rfm', rule_label, CAST(count(DISTINCT buy.user_id) AS DOUBLE)
          FROM buy JOIN ({rule_sql()}) seg ON buy.user_id = seg.user_id WHERE {rng(start, end)} GROUP BY 2
UNION ALL SELECT 'retention', strftime(cohort_date, '%Y-%m-%d') || ':' || CAST(day_diff AS VARCHAR),
          CAST(round(active_users / greatest(cohort_users, 1) * 100, 2) AS DOUBLE)
          FROM cm WHERE {rng(start, end, 'cohort_date')}"""


def centers_sql() -> str:
    """Profiles of the buyers nearest to each fixed centre, written out."""
    distance = " UNION ALL ".join(
        f"SELECT user_id, R, F, M, {i} AS i, '{segment_label_py(c)}' AS label, "
        + " + ".join(f"(({n}_z - ({v})) * ({n}_z - ({v})))" for n, v in zip("RFM", c)) + " AS d FROM zs"
        for i, c in enumerate(R.CENTERS))
    return f""", near AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY d, i) AS rn FROM ({distance}))
SELECT i AS cluster_id, label, round(avg(R), 2) AS r_mean, round(avg(F), 2) AS f_mean, round(avg(M), 2) AS m_mean,
       count(*) AS user_count FROM near WHERE rn = 1 GROUP BY i, label"""


def _nearest(centers: str) -> str:
    """Points with the nearest row (i, r, f, m) of ``centers``; ties: the first."""
    d = " + ".join(f"({n}_z - c.{n.lower()}) * ({n}_z - c.{n.lower()})" for n in "RFM")
    return (f"SELECT user_id, R_z, F_z, M_z, i FROM (SELECT zs.*, c.i, row_number() OVER (PARTITION BY user_id "
            f"ORDER BY {d}, c.i) AS rn FROM zs, {centers} c) WHERE rn = 1")


_START = ("c0 AS (SELECT * FROM (VALUES "
          + ", ".join(f"({i}, CAST({r} AS DOUBLE), CAST({f} AS DOUBLE), CAST({m} AS DOUBLE))"
                      for i, (r, f, m) in enumerate(R.CENTERS)) + ") AS v(i, r, f, m))")


def silhouette_sql() -> str:
    """By definition: the distances of all pairs of points."""
    return f""", {_START}, pts AS ({_nearest('c0')}),
pair AS (SELECT a.user_id, a.i AS own, b.i AS other, count(*) AS n,
                sum((a.R_z - b.R_z) * (a.R_z - b.R_z) + (a.F_z - b.F_z) * (a.F_z - b.F_z) + (a.M_z - b.M_z) * (a.M_z - b.M_z)) AS d
         FROM pts a, pts b GROUP BY 1, 2, 3),
ab AS (SELECT user_id, own, max(CASE WHEN own = other THEN n END) AS n, max(CASE WHEN own = other AND n > 1 THEN d / (n - 1) END) AS a,
              min(CASE WHEN own <> other THEN d / n END) AS b FROM pair GROUP BY 1, 2),
s AS (SELECT own, CASE WHEN b IS NULL THEN NULL WHEN n = 1 THEN 0.0
                       ELSE COALESCE((b - a) / NULLIF(greatest(a, b), 0.0), 0.0) END AS s FROM ab)
SELECT own AS cluster_id, count(*) AS user_count, round(avg(s), 6) AS silhouette FROM s GROUP BY own
UNION ALL SELECT -1, count(*), round(avg(s), 6) FROM s HAVING count(*) > 0"""


def lloyd_sql(steps: int) -> str:
    """Every step written out."""
    ctes = [_START]
    for k in range(steps):
        ctes.append(f"a{k} AS ({_nearest(f'c{k}')})")
        ctes.append(f"c{k + 1} AS (SELECT c.i, " + ", ".join(
            f"COALESCE((SELECT avg({n}_z) FROM a{k} WHERE a{k}.i = c.i), c.{n.lower()}) AS {n.lower()}" for n in "RFM")
            + f" FROM c{k} c)")
    last = steps - 1
    return f""", {", ".join(ctes)}
SELECT c.i AS cluster_id, (SELECT count(*) FROM a{last} WHERE a{last}.i = c.i) AS user_count,
       round(r, 6) AS R_z, round(f, 6) AS F_z, round(m, 6) AS M_z FROM c{steps} c"""


def oracle_sql() -> dict[str, str]:
    """DuckDB statement per registered key (rows-only keys omitted)."""
    ls, le = R.LOG_START, R.LOG_END
    ss, se = R.SPAN_START, R.SPAN_END
    ms, me = R.MONTH_START, R.MONTH_END
    n1, n2, n3 = FUNNEL_STAGE_NAMES
    pipe = with_(*PIPE)
    sm = with_(*PIPE, TOUCH, SFLAGS, SMART)
    lm = with_(*PIPE, TOUCH, LFLAGS, LMART)
    facts = with_(FACTS)
    totals = ("SELECT CAST(COALESCE(sum(has_pv), 0) AS BIGINT) AS pv, CAST(COALESCE(sum(has_cart), 0) AS BIGINT) AS cart, "
              "CAST(COALESCE(sum(has_buy), 0) AS BIGINT) AS buy, "
              "count(DISTINCT CASE WHEN has_buy = 1 THEN user_id END) AS distinct_buyers "
              f"FROM {{m}} WHERE {rng(ls, le)}")
    nulls = ("SELECT count(*) FILTER (WHERE price IS NULL) AS missing_price, "
             "count(*) FILTER (WHERE channel IS NULL) AS missing_channel, "
             "count(*) FILTER (WHERE age_group IS NULL) AS missing_age_group FROM joined")
    retention = ("SELECT day_diff, strftime(cohort_date, '%Y-%m-%d') AS cohort_date, "
                 "round(active_users / greatest(cohort_users, 1) * 100, 2) AS retention_pct "
                 f"FROM cm WHERE {rng(ls, le, 'cohort_date')}")
    rule = rule_sql()
    metrics_cte = f"""m AS (SELECT
  (SELECT count(*) FROM log) AS raw_rows, (SELECT count(*) FROM items) AS item_rows,
  (SELECT count(*) FROM log WHERE user_id IS NULL OR item_id IS NULL OR type IS NULL OR ts IS NULL) AS malformed_rows,
  (SELECT count(*) FROM users) AS user_rows,
  (SELECT count(*) FROM items WHERE price IS NULL) AS unpriced_items,
  (SELECT count(*) FROM users WHERE channel IS NULL) AS users_without_channel,
  (SELECT count(*) FROM users WHERE age_group IS NULL) AS users_without_age_group,
  (SELECT count(*) FILTER (WHERE price IS NULL) FROM joined) AS missing_price,
  (SELECT count(*) FILTER (WHERE channel IS NULL) FROM joined) AS missing_channel,
  (SELECT count(*) FILTER (WHERE age_group IS NULL) FROM joined) AS missing_age_group,
  (SELECT count(*) FROM wide) AS clean_rows,
  (SELECT count(*) FROM (SELECT item_id FROM items GROUP BY item_id HAVING count(*) > 1)) AS duplicate_item_keys,
  (SELECT count(*) FROM (SELECT user_id FROM users GROUP BY user_id HAVING count(*) > 1)) AS duplicate_user_keys,
  (SELECT count(*) FROM buy) AS buy_fact_rows)"""
    metric_names = ["raw_rows", "malformed_rows", "item_rows", "user_rows", "missing_price", "missing_channel",
                    "missing_age_group", "clean_rows", "duplicate_item_keys", "duplicate_user_keys",
                    "unpriced_items", "users_without_channel", "users_without_age_group", "buy_fact_rows"]
    metrics = " UNION ALL ".join(f"SELECT '{n}' AS metric, CAST({n} AS DOUBLE) AS value FROM m"
                                 for n in metric_names)
    metrics += (" UNION ALL SELECT 'drop_rate_pct', CAST(round((1 - clean_rows / greatest(raw_rows, 1)) * 100, 2) "
                "AS DOUBLE) FROM m")
    warn = [("missing_price", "{n} rows without price were dropped; they are kept in the rejects table"),
            ("missing_channel", "{n} rows without channel were filled with the unknown-channel text"),
            ("missing_age_group", "{n} rows without age band were filled with the unknown-age text")]
    warnings = " UNION ALL ".join(
        f"SELECT '{m}' AS metric, {m} AS n, replace('{t}', '{{n}}', CAST({m} AS VARCHAR)) AS message "
        f"FROM ({nulls}) WHERE {m} > 0" for m, t in warn)
    counts = " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS rows FROM {t}" for n, t in [
        ("raw_log", "log"), ("items", "items"), ("users", "users"), ("clean", "wide"), ("buy_fact", "buy"),
        ("user_rfm", "rb"), ("cohort_matrix", "cm"), ("user_funnel_mart", "smart"),
        ("user_funnel_loose_mart", "lmart")])
    hourly = ("SELECT CAST(h.range AS INTEGER) AS hour, COALESCE(c.events, 0) AS events FROM range(24) h "
              "LEFT JOIN (SELECT CAST(floor(((ts + 28800) % 86400) / 3600) AS INTEGER) AS hour, count(*) AS events "
              "FROM log GROUP BY 1) c ON CAST(h.range AS INTEGER) = c.hour ORDER BY 1")
    pareto = """, pi AS (SELECT item_id, count(*) AS c FROM log GROUP BY item_id),
n AS (SELECT count(*) AS n_items, CAST(sum(c) AS BIGINT) AS total FROM pi),
r AS (SELECT c, row_number() OVER (ORDER BY c DESC) AS rn FROM pi)
SELECT n_items, CAST(floor(n_items * CAST(0.2 AS DOUBLE)) AS BIGINT) AS head_items,
       CAST(COALESCE((SELECT sum(c) FROM r WHERE rn <= floor(n_items * CAST(0.2 AS DOUBLE))), 0) AS BIGINT) AS head_events,
       total AS total_events,
       round(COALESCE((SELECT sum(c) FROM r WHERE rn <= floor(n_items * CAST(0.2 AS DOUBLE))), 0)
             / NULLIF(total, 0) * 100, 4) AS head_share_pct
FROM n"""
    safe = """SELECT event_id,
  COALESCE(CASE WHEN regexp_full_match(trim(k), '[+-]?[0-9]+') THEN TRY_CAST(trim(k) AS INTEGER) END, 0) AS k_int,
  COALESCE(TRY_CAST(k AS DOUBLE), 0.0) AS k_double,
  COALESCE(TRY_CAST(event_type AS DOUBLE), 0.0) AS type_double,
  COALESCE(CAST(trunc(value) AS INTEGER), 0) AS value_int,
  COALESCE(CASE WHEN regexp_full_match(trim(CAST(value AS VARCHAR)), '[+-]?[0-9]+')
                THEN TRY_CAST(trim(CAST(value AS VARCHAR)) AS INTEGER) END, 0) AS value_text_int,
  TRY_CAST(CAST(value AS VARCHAR) AS DOUBLE) AS value_text_double
FROM (SELECT *, regexp_extract(props, '"k":\\s*([^}]*)\\}', 1) AS k FROM events)"""
    flag_cols = "user_id, item_id, has_pv, has_cart, has_buy, pv_date, cart_date, buy_date"
    q = {
        "scan_behavior": with_(LOG) + "SELECT * FROM log",
        "scan_items": with_(ITEMS) + edge("SELECT * FROM items"),
        "scan_users": with_(USERS) + "SELECT * FROM users",
        "scan_behavior_csv": with_(LOG) + "SELECT * FROM log",
        "scan_items_csv": with_(ITEMS) + edge("SELECT * FROM items"),
        "scan_users_csv": with_(USERS) + "SELECT * FROM users",
        "csv_clean_rows": with_(RAW) + ("SELECT u AS user_id, i AS item_id, CASE WHEN kind <> 8 THEN c END AS category_id, t AS type, "
                                        "s AS ts FROM raw WHERE reason IS NULL"),
        "csv_dead_letters": with_(RAW) + "SELECT line, reason FROM raw WHERE reason IS NOT NULL",
        "csv_line_counts": with_(RAW) + "SELECT COALESCE(reason, '') AS reason, count(*) AS lines FROM raw GROUP BY 1",
        "clean_events": with_(LOG, EV) + "SELECT * FROM ev",
        "wide_events": pipe + edge("SELECT * FROM wide"),
        "rejected_events": pipe + edge("SELECT * FROM joined WHERE price IS NULL"),
        "buy_fact": with_(*PIPE, BUY) + edge("SELECT * FROM buy"),
        "data_cutoff": with_(LOG, EV) + "SELECT max(date) AS cutoff_date FROM ev",
        "dq_counts": with_(*PIPE, BUY, TOUCH, SFLAGS, LFLAGS, SMART, LMART, COHORT, RFM) + counts,
        "dq_nulls": pipe + nulls,
        "dq_drop_rate": pipe + ("SELECT raw_rows, clean_rows, round((1 - clean_rows / greatest(raw_rows, 1)) * 100, 2) "
                                "AS drop_rate_pct FROM (SELECT (SELECT count(*) FROM log) AS raw_rows, "
                                "(SELECT count(*) FROM wide) AS clean_rows)"),
        "dq_metrics": with_(*PIPE, BUY, metrics_cte) + metrics,
        "dq_warnings": pipe + warnings,
        "first_touch": with_(*PIPE, TOUCH) + "SELECT * FROM touch",
        "funnel_flags_strict": with_(*PIPE, TOUCH, SFLAGS) + f"SELECT {flag_cols} FROM sflags",
        "funnel_flags_loose": with_(*PIPE, TOUCH, LFLAGS) + f"SELECT {flag_cols} FROM lflags",
        "funnel_events": with_(*PIPE, TOUCH, SFLAGS, stages("sflags", "sev")) + "SELECT * FROM sev",
        "funnel_strict": sm + "SELECT * FROM smart",
        "funnel_loose": lm + "SELECT * FROM lmart",
        "funnel_strict_incremental": sm + "SELECT * FROM smart",
        "funnel_loose_incremental": lm + "SELECT * FROM lmart",
        "funnel_totals": sm + totals.format(m="smart"),
        "funnel_totals_loose": lm + totals.format(m="lmart"),
        "funnel_long": sm + f""", t AS ({totals.format(m='smart')})
SELECT 1 AS stage, '{n1}' AS name, pv AS value FROM t UNION ALL SELECT 2, '{n2}', cart FROM t
UNION ALL SELECT 3, '{n3}', buy FROM t""",
        "user_cohorts": pipe + "SELECT user_id, min(date) AS cohort_date FROM wide GROUP BY user_id",
        "cohort_sizes": pipe + ("SELECT cohort_date, count(*) AS cohort_users FROM "
                                "(SELECT user_id, min(date) AS cohort_date FROM wide GROUP BY user_id) GROUP BY 1"),
        "cohort_matrix": with_(*PIPE, COHORT) + "SELECT * FROM cm",
        "cohort_read": with_(*PIPE, COHORT) + f"SELECT * FROM cm WHERE {rng(ls, le, 'cohort_date')} ORDER BY 1, 2",
        "retention_rates": with_(*PIPE, COHORT) + retention,
        "retention_grid": with_(*PIPE, COHORT) + (
            "SELECT CAST(dense_rank() OVER (ORDER BY cohort_date) - 1 AS INTEGER) AS row_idx, cohort_date, day_diff, "
            "round(active_users / greatest(cohort_users, 1) * 100, 2) AS retention_pct FROM cm"),
        "retention_wide": with_(*PIPE, COHORT) + "SELECT cohort_date, " + ", ".join(
            f"max(CASE WHEN day_diff = {k} THEN round(active_users / greatest(cohort_users, 1) * 100, 2) END) "
            f'AS "{k}"' for k in range(8)) + " FROM cm GROUP BY cohort_date",
        "last_cohorts": with_(*PIPE, COHORT) + ("SELECT cohort_date, day_diff, active_users, cohort_users FROM "
                                                "(SELECT *, dense_rank() OVER (ORDER BY cohort_date DESC) AS r FROM cm) "
                                                f"WHERE r <= {R.LAST_COHORTS}"),
        "rfm_base": with_(*PIPE, RFM) + "SELECT * FROM rb",
        "rfm_zscores": with_(*PIPE, RFM) + ("SELECT user_id, R, F, M, round(R_z, 4) AS R_z, round(F_z, 4) AS F_z, "
                                            "round(M_z, 4) AS M_z FROM zs"),
        "segment_rule": with_(*PIPE, RFM) + rule,
        "rfm_score": with_(*PIPE, RFM) + (
            f"SELECT user_id, round({DEFAULT_WEIGHTS['R']} * R_z + {DEFAULT_WEIGHTS['F']} * F_z "
            f"+ {DEFAULT_WEIGHTS['M']} * M_z, 4) AS score FROM zs"),
        "core_metrics": facts + (f"SELECT COALESCE(CAST(sum(price) AS DOUBLE), 0.0) AS total_sales, "
                                 f"count(DISTINCT order_id) AS total_orders FROM facts WHERE {rng(ss, se)}"),
        "trend_day": facts + trend_sql("facts", ss, se, "day"),
        "trend_default_range": with_(*PIPE, BUY) + (
            f"SELECT {label('date', 'day')} AS dt, CAST(sum(price) AS DOUBLE) AS sales, count(DISTINCT order_id) AS orders "
            f"FROM buy WHERE date >= (SELECT max(date) FROM buy) - {R.TREND_DAYS} GROUP BY 1 ORDER BY 1"),
        "trend_week": facts + trend_sql("facts", ss, se, "week"),
        "trend_month": facts + trend_sql("facts", ss, se, "month"),
        "comparison_sales": facts + f"SELECT CAST(sum(price) AS DOUBLE) AS sales FROM facts WHERE {rng(*R.PREV_MONTH)}",
        "top_items": facts + top_sql("facts", ss, se, "item_id", ITEM_PREFIX, "item_label"),
        "top_categories": facts + top_sql("facts", ss, se, "category_id", CATEGORY_PREFIX, "category_label"),
        "sales_by_channel": facts + (f"SELECT channel, CAST(sum(price) AS DOUBLE) AS sales FROM facts "
                                     f"WHERE {rng(ss, se)} GROUP BY channel ORDER BY sum(price) DESC, channel"),
        "sales_by_age_group": facts + (f"SELECT age_group, CAST(sum(price) AS DOUBLE) AS sales FROM facts "
                                       f"WHERE {rng(ss, se)} GROUP BY age_group ORDER BY sum(price) DESC, age_group"),
        "date_range": facts + ("SELECT COALESCE(min(date), current_date) AS min_date, "
                               "COALESCE(max(date), current_date) AS max_date FROM facts"),
        "default_range": facts + ("SELECT CAST(max_date - INTERVAL 30 DAY AS DATE) AS start_date, max_date AS end_date "
                                  "FROM (SELECT COALESCE(max(date), current_date) AS max_date FROM facts)"),
        "growth_day": facts + growth_select("facts", ms, me, "day"),
        "growth_week": facts + growth_select("facts", ms, me, "week"),
        "growth_month": facts + growth_select("facts", ms, me, "month"),
        "dimension_breakdown": facts + breakdown_sql("facts", ss, se),
        "dimension_share": facts + f"""SELECT dimension, name, sales, rank,
  round(sales / NULLIF((SELECT CAST(sum(price) AS DOUBLE) FROM facts WHERE {rng(ss, se)}), 0.0) * 100, 2) AS share_pct
FROM ({breakdown_sql('facts', ss, se)})""",
        "kpi_summary": with_(*PIPE, BUY, TOUCH, SFLAGS, SMART) + kpi_select("buy", "smart", *R.KPI_RANGE, "day"),
        "dashboard_bundle": bundle_sql(ls, le, "week"),
        "daily_drilldown": bundle_sql(R.DRILL_DAY, R.DRILL_DAY, "day"),
        "sales_cells": facts + ("SELECT date, item_id, category_id, channel, age_group, CAST(sum(price) AS DOUBLE) AS sales, "
                                "count(*) AS n_rows FROM facts GROUP BY ALL"),
        "set_trend_day": facts + trend_sql("facts", ss, se, "day"),
        "set_trend_week": facts + trend_sql("facts", ss, se, "week"),
        "set_trend_month": facts + trend_sql("facts", ss, se, "month"),
        "set_core_metrics": facts + (f"SELECT COALESCE(CAST(sum(price) AS DOUBLE), 0.0) AS total_sales, "
                                     f"count(DISTINCT order_id) AS total_orders FROM facts WHERE {rng(ss, se)}"),
        "set_growth_month": facts + growth_select("facts", ms, me, "month"),
        "set_rfm_distribution": with_(*PIPE, BUY, RFM) + f""", seg AS ({rule})
SELECT rule_label AS rfm_label, count(DISTINCT buy.user_id) AS cnt
FROM buy JOIN seg ON buy.user_id = seg.user_id WHERE {rng(ls, le)} GROUP BY 1""",
        "cube_slices": facts + f""", top AS ({top_sql('facts', ss, se, 'item_id', ITEM_PREFIX, 'item_label')}),
dims AS ({breakdown_sql('facts', ss, se)})
SELECT 'rankings' AS section, item_label AS name, sales AS value FROM top
UNION ALL SELECT dimension, name, sales FROM dims""",
        "daily_volume": with_(LOG) + f"SELECT {D('ts')} AS date, count(*) AS events FROM log GROUP BY 1 ORDER BY 1",
        "hourly_volume": with_(LOG) + hourly,
        "pareto_share": "WITH " + LOG + pareto,
        "stage_conversion": with_(LOG) + """SELECT pv, cart, buy,
  round(cart / greatest(pv, 1) * 100, 2) AS pv_to_cart_pct,
  round(buy / greatest(cart, 1) * 100, 2) AS cart_to_buy_pct,
  round(buy / greatest(pv, 1) * 100, 2) AS pv_to_buy_pct
FROM (SELECT count(*) FILTER (WHERE type IN ('pv', 'cart', 'buy')) AS pv,
             count(*) FILTER (WHERE type IN ('cart', 'buy')) AS cart,
             count(*) FILTER (WHERE type = 'buy') AS buy FROM log)""",
        "events_by_time": with_(LOG) + "SELECT * FROM log ORDER BY ts, user_id, item_id, type",
        "safe_cast": safe,
        "adhoc_sql": facts.replace("facts AS", "buy_fact AS") + R.ADHOC_STATEMENT,
        "publish_roundtrip": with_(*PIPE, BUY) + edge("SELECT * FROM buy"),
        "publish_funnel_strict": sm + "SELECT * FROM smart",
        "publish_funnel_loose": lm + "SELECT * FROM lmart",
        "publish_cohort_matrix": with_(*PIPE, COHORT) + "SELECT * FROM cm",
        "publish_user_rfm": with_(*PIPE, RFM) + rule.replace("rule_label", "rfm_label"),
        "rfm_distribution_rule": with_(*PIPE, BUY, RFM) + f""", seg AS ({rule})
SELECT rule_label AS rfm_label, count(DISTINCT buy.user_id) AS cnt
FROM buy JOIN seg ON buy.user_id = seg.user_id WHERE {rng(ls, le)} GROUP BY 1""",
        "rfm_distribution_bucketed": with_(*PIPE, BUY, RFM) + f""", seg AS ({rule})
SELECT rule_label AS rfm_label, count(DISTINCT buy.user_id) AS cnt
FROM buy JOIN seg ON buy.user_id = seg.user_id WHERE {rng(ls, le)} GROUP BY 1""",
        "cluster_profiles_fixed": with_(*PIPE, RFM) + centers_sql(),
        "silhouette_fixed": with_(*PIPE, RFM) + silhouette_sql(),
        "lloyd_fixed": with_(*PIPE, RFM) + lloyd_sql(R.LLOYD_STEPS),
        "kmeans_fixpoint": with_(*PIPE, RFM) + " UNION ALL ".join(
            f"SELECT '{c}' AS check, (SELECT count(*) FROM rb) AS cases, CAST(0 AS BIGINT) AS violations"
            for c in ("members", "nearest", "centre", "label")),
        "dq_log_append": with_(*PIPE, BUY, metrics_cte) + f""", w AS ({warnings})
SELECT d.run_day, (SELECT CAST(count(*) AS INTEGER) FROM w) AS n_warnings, x.metric, x.value
FROM ({metrics}) x, (VALUES {", ".join(f"('{t:%Y-%m-%d}')" for t in R.LOG_RUNS)}) AS d(run_day)""",
        "stream_buy_fact": with_(*PIPE, BUY) + edge("SELECT * FROM buy"),
        "stream_daily_volume": with_(LOG, ITEMS) + f"""SELECT {D('ts')} AS date, count(*) AS events,
  count(*) FILTER (WHERE type = 'buy') AS buys,
  CAST(sum(CASE WHEN type = 'buy' THEN i.price END) AS DOUBLE) AS buy_sales
FROM log LEFT JOIN items i ON log.item_id = i.item_id GROUP BY 1""",
    }
    return q
