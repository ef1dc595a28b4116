"""Filter predicates with the null and NaN guards every template carries."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A search for proposals "in voting" covers these statuses.
VOTING_STATUSES = ["Deciding", "DecisionDepositPlaced", "Submitted", "ConfirmStarted", "ConfirmAborted"]

# Fixed value: the proposal type assumed when the caller names none.
DEFAULT_PROPOSAL_TYPE = "ReferendumV2"


def guarded(df: DataFrame, *columns: str) -> DataFrame:
    """Keep rows where every named column has a value."""
    return df.where(reduce(Column.__and__, [F.col(c).isNotNull() for c in columns]))


def is_number(column: str) -> Column:
    """Neither null nor NaN."""
    return F.col(column).isNotNull() & ~F.isnan(column)


def contains_ci(pattern: str, *columns: str) -> Column:
    """Case-insensitive substring in any of the columns."""
    escaped = pattern.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return reduce(Column.__or__, [F.col(c).isNotNull() & F.col(c).ilike(f"%{escaped}%") for c in columns])


def ntz(moment: dt.datetime | dt.date) -> Column:
    """A timestamp literal without time zone, so that comparisons reach the Parquet scan uncast."""
    if not isinstance(moment, dt.datetime):
        moment = dt.datetime(moment.year, moment.month, moment.day)
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def in_month(column: str, year: int, month: int) -> Column:
    """Month bucket as a half-open range, which prunes row groups where a truncated column would not."""
    start = dt.date(year, month, 1)
    end = dt.date(year + month // 12, month % 12 + 1, 1)
    return (F.col(column) >= ntz(start)) & (F.col(column) < ntz(end))


def between(column: str, start: dt.date, end: dt.date) -> Column:
    return (F.col(column) >= ntz(start)) & (F.col(column) <= ntz(end))


def of_type(proposal_type: str | None = None, column: str = "proposal_type") -> Column:
    """Type filter that falls back to the default type."""
    return F.col(column) == F.lit(proposal_type or DEFAULT_PROPOSAL_TYPE)


def all_of(*conditions: Column | None) -> Column:
    """AND over the conditions that were given; true when none was."""
    return reduce(Column.__and__, [c for c in conditions if c is not None], F.lit(True))
