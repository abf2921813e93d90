"""Which days a scan covers."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve_days(dates: Sequence[str] = (), since: str | None = None, until: str | None = None, last: int | None = None, today: dt.date | None = None) -> list[dt.date]:
    """Explicit dates, else a range, else the last ``last`` days, else today (UTC)."""
    today = today or dt.datetime.now(dt.timezone.utc).date()
    if dates:
        return sorted({dt.date.fromisoformat(x) for x in dates})
    if since:
        first, end = dt.date.fromisoformat(since), dt.date.fromisoformat(until) if until else today
        return [first + dt.timedelta(days=n) for n in range((end - first).days + 1)]
    return sorted(today - dt.timedelta(days=n) for n in range(max(1, last or 1)))


def in_days(df: DataFrame, at: str, days: Sequence[dt.date]) -> DataFrame:
    """Rows of the given days. The outer range is a plain comparison and reaches the scan; gaps are filtered on top."""
    if not days:
        return df.limit(0)
    kind = dict(df.dtypes)[at]
    moment = lambda day: F.lit(day.isoformat()).cast(kind)
    rows = df.where((F.col(at) >= moment(days[0])) & (F.col(at) < moment(days[-1] + dt.timedelta(days=1))))
    contiguous = (days[-1] - days[0]).days + 1 == len(days)
    return rows if contiguous else rows.where(F.to_date(at).isin(list(days)))
