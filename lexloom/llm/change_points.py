"""Penalised change points: every key's daily series cut into segments of even spread.

Rows are summed by key and day before anything meets (combined map-side, so a
hot key brings each task's days, not its rows); a key's days then meet in one
applyInPandas group, which is as long as the calendar and not as the table.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm.common import by_value

#: Cells (end days x starts) whose costs are held at once.
CELLS = 1 << 18
SEGMENT = "segment_no int, first_day long, n_days long, total long, spread long, cost long, n_segments long, best_cost long"


def segment_costs(n: np.ndarray, s: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(V, cost) of segments of n days, sum s and sum of squares q: V = 1 + floor((n q - s s) / (n n)), cost = n floor(1000 ln V)."""
    spread = 1 + (n * q - s * s) // (n * n)
    return spread, n * np.floor(1000 * np.log(spread.astype(float))).astype(np.int64)


def best_cuts(values: np.ndarray, least: int, penalty: int) -> tuple[list[int], np.ndarray, np.ndarray, int]:
    """(ends, spreads, costs, best cost) of the segments of at least `least` values whose costs and cuts cost least.

    best[j] is that of the first j values, with the number of segments as its
    lowest digits, so that one minimum takes the least cost, then the fewest
    segments; argmin takes the earliest start of the last segment, and the
    backpointers carry that to all segments, from the last one backwards.
    Prefix sums that don't fit into 64 bits are Python's integers.
    """
    n = len(values)
    wide = n * int(np.abs(values.astype(float)).max()) ** 2 * n >= 2**62
    values = values.astype(object) if wide else values.astype(np.int64)
    zero = np.zeros(1, values.dtype)
    sums, squares = np.concatenate((zero, np.cumsum(values))), np.concatenate((zero, np.cumsum(values * values)))
    if n < 2 * least:
        ends = [n]
    else:
        far = np.int64(2**62)
        best, back = np.full(n + 1, far), np.zeros(n + 1, np.int64)
        best[0] = 0
        starts = np.concatenate(([0], np.arange(least, n - least + 1)))
        rows = max(1, CELLS // len(starts))
        for first in range(least, n + 1, rows):
            end = np.arange(first, min(n + 1, first + rows))
            m = end[:, None] - starts[None, : max(1, end[-1] - 2 * least + 2)]
            at = starts[: m.shape[1]]
            valid = m >= least  # starts too late for an end count as nothing here, and are cut off below
            s, q = (np.where(valid, x[end][:, None] - x[at], 0) for x in (sums, squares))
            cost = segment_costs(np.where(valid, m, 1), s, q)[1]
            cost += np.where(at > 0, penalty, 0)
            cost *= n + 1
            cost += 1
            for j, row in zip(end.tolist(), cost):
                k = max(1, j - 2 * least + 2)  # start 0, then least, least + 1, ..., j - least
                total = best[at[:k]] + row[:k]
                i = int(total.argmin())
                best[j], back[j] = total[i], at[i]
        ends, j = [], n
        while j:
            ends.append(j)
            j = int(back[j])
        ends.reverse()
    edges = np.array([0, *ends])
    spread, cost = segment_costs(np.diff(edges), np.diff(sums[edges]), np.diff(squares[edges]))
    return ends, spread, cost, int(cost.sum()) + penalty * (len(ends) - 1)


def _segments(key: str, least: int, penalty: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def run(group: tuple, days: pd.DataFrame) -> pd.DataFrame:
        day, total = days["_day"].to_numpy(np.int64), days["_total"].to_numpy(np.int64)
        first = int(day.min())
        series = np.zeros(int(day.max()) - first + 1, np.int64)
        series[day - first] = total
        ends, spread, cost, best = best_cuts(series, least, penalty)
        edges = np.array([0, *ends])
        sums = np.concatenate(([0], np.cumsum(series)))
        n = len(ends)
        out = {
            key: pd.Series([None if pd.isna(group[0]) else group[0]] * n, dtype=object), "segment_no": np.arange(1, n + 1, dtype=np.int32), "first_day": first + edges[:-1], "n_days": np.diff(edges),
            "total": np.diff(sums[edges]), "spread": spread.astype(np.int64), "cost": cost, "n_segments": np.full(n, n), "best_cost": np.full(n, best),
        }
        return pd.DataFrame(out)

    return run


def change_points(rows: DataFrame, key: str = "vendor_id", value: str = "quantity", when: str = "shipped_at", least: int = 14, penalty: int = 40000) -> DataFrame:
    """key, segment_no, first_day (since 1970), n_days, total, spread, cost, n_segments and best_cost of every segment of every key.

    A key's series is the sum of `value` (an integer) by day of `when`, from its
    first to its last day with rows, days between counting 0.  It is cut where
    the segments' costs and `penalty` a cut add up to the least: ties go to the
    fewest segments, then to the earliest starts, compared from the last segment
    backwards.  Segments have at least `least` days; a series shorter than that
    is one.  Rows of null value or time aren't taken, repeated ones all are; a
    null key is a series of its own; negative values count as such.  An empty
    table gives no rows, other columns play no part, whatever their names.  Sums
    of a day and of a segment must fit into 64 bits, squares needn't.  Work is
    the square of a series' days, in blocks of bounded memory: 50 years of days
    take a task some seconds.
    """
    taken = rows.where(F.col(value).isNotNull() & F.col(when).isNotNull())
    days = taken.groupBy(F.col(key), F.unix_date(F.col(when).cast("date")).alias("_day")).agg(F.sum(F.col(value).cast("long")).alias("_total"))
    schema = T.StructType([T.StructField(key, rows.schema[key].dataType), *T.StructType.fromDDL(SEGMENT).fields])
    return days.groupBy(key).applyInPandas(_segments(key, least, penalty), schema)


by_value(__name__)
