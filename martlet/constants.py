"""Fixed values the outputs depend on.

FIXED VALUES — results match only with these labels, fill texts, thresholds,
weights and horizons.
"""

# Fill texts for missing user attributes (channel, age band).
UNKNOWN_CHANNEL = "未知渠道"
UNKNOWN_AGE_GROUP = "未知"

# Customer segment labels, in rule order, plus the unmapped-cluster label.
LABEL_CHURNED = "流失/沉睡客户"
LABEL_CORE_VALUE = "核心高价值客户"
LABEL_LOYAL = "高频忠诚客户"
LABEL_POTENTIAL = "潜力发展客户"
LABEL_REGULAR = "一般维持客户"
LABEL_UNMAPPED = "未知群体"

# Segment thresholds on z-scored cluster centres.
DEFAULT_THRESHOLDS = {"high_r": 0.5, "high_m": 0.3, "high_f": 0.3}

# Weights of the printed centre score.
DEFAULT_WEIGHTS = {"R": -0.2, "F": 0.3, "M": 0.5}

# Funnel stage display names, in stage order.
FUNNEL_STAGE_NAMES = ("浏览 (PV)", "意向 (加购)", "购买 (成交)")

# Ranking label prefixes for items and categories.
ITEM_PREFIX = "商品"
CATEGORY_PREFIX = "品类"

# Period whitelist and labels.
PERIOD_LABELS = {"day": "日", "week": "周", "month": "月"}

# Retention horizon (days after the cohort day), ranking size, look-back,
# number of most recent cohorts in the retention view.
RETENTION_HORIZON_DAYS = 7
TOP_K = 10
DEFAULT_LOOKBACK_DAYS = 30
LAST_COHORTS = 10

# KMeans sweep.
KMEANS_K_RANGE = (3, 4, 5)
KMEANS_SEED = 42

# Behaviour types.
TYPE_PV, TYPE_CART, TYPE_BUY = "pv", "cart", "buy"

# Log profiling: share of items counted as the "head", and the fixed clock
# offset (hours) used for the hour-of-day histogram.
PARETO_HEAD_FRACTION = 0.2
PROFILE_HOUR_OFFSET = 8
