from fleetlens.functions.arrays import count_upto
from fleetlens.functions.labels import (
    city_label,
    file_key,
    host_name,
    host_part,
    is_pair,
    joined_label,
    short_label,
    user_name,
)
from fleetlens.functions.measures import (
    HEALTH_CATEGORIES,
    health_category,
    mean_score,
    percent_change,
    percentage,
    score_sums,
)
from fleetlens.functions.rows import latest_per
from fleetlens.functions.times import day_start, in_range, is_workday, moment

__all__ = [
    "HEALTH_CATEGORIES",
    "city_label",
    "count_upto",
    "day_start",
    "file_key",
    "health_category",
    "host_name",
    "host_part",
    "in_range",
    "is_pair",
    "is_workday",
    "joined_label",
    "latest_per",
    "mean_score",
    "moment",
    "percent_change",
    "percentage",
    "score_sums",
    "short_label",
    "user_name",
]
