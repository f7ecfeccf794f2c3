"""Parameters shared by the registered queries and their SQL."""

from __future__ import annotations

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
# Every pair of event types, written in order.
PAIRS = [f"{a}:{b}" for i, a in enumerate(EVENT_TYPES) for b in EVENT_TYPES[i + 1 :]]

COHORT_FROM, COHORT_TO = "2024-01-10", "2024-01-13"
MONTH_FROM, MONTH_TO = "2024-01-01", "2024-01-31"
ITEMS_FROM, ITEMS_TO = "1995-01-01", "1999-12-31"
COMPARE_FROM, COMPARE_TO = "1995-01-01", "2024-01-20"
AS_OF = "2024-01-30 12:00:00"
SNAPSHOT_AS_OF = "2024-01-28"
ENRICHED_RANGE = ("1996-01-01", "2024-01-20")
ENRICHED_SENSORS = ["error", "view", "signup", "1-URGENT", "5-LOW"]
# Encloses the ranges of all derived sensors.
ORDERS_FROM, ORDERS_TO = "1994-12-01", "2001-12-31"
WRITTEN_PAIRS = ["view:click", "click:error"]
COMPARED = (8, 46)
LOW = 5.0
EVENT_SIGMAS = 1.0
ORDER_SIGMAS = 3.0
# A window of two years, moved by thirty days.
WINDOW_FROM, WINDOW_TO = "1995-01-01", "1996-12-31"
MOVED_FROM, MOVED_TO = "1995-01-31", "1997-01-30"
SHARED = 5
