"""Reading a source backwards in windows that are halved where a page is full."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: how often a window is halved before the walk gives up.
MOST_HALVINGS = 5
WINDOWS = "account string, window long, start date, end date, width int, halvings int, n long, complete boolean"


class _Walk:
    """One account's windows from ``today`` backwards; days come from the newest on, each with its rows."""

    def __init__(self, account: str, start: pd.Timestamp, today: pd.Timestamp, width: int, page: int):
        self.account, self.start, self.width, self.page = account, start, width, page
        self.end, self.days, self.out, self.over = today, deque(), [], today < start

    def day(self, day: pd.Timestamp, n: int) -> None:
        """Windows that begin after ``day`` have all their rows."""
        while not self.over and day < self._first(self.width):
            self._window()
        self.days.append((day, n))

    def finish(self) -> list[tuple]:
        while not self.over:
            self._window()
        return self.out

    def _first(self, width: int) -> pd.Timestamp:
        return max(self.start, self.end - pd.Timedelta(days=width - 1))

    def _window(self) -> None:
        width, halvings = self.width, 0
        while (n := sum(k for day, k in self.days if self._first(width) <= day <= self.end)) >= self.page and halvings < MOST_HALVINGS:
            width, halvings = max(1, width // 2), halvings + 1
        first = self._first(width)
        complete = n < self.page
        self.out.append((self.account, len(self.out), first.date(), self.end.date(), width, halvings, n, complete))
        self.over = not complete or first <= self.start
        self.end = first - pd.Timedelta(days=1)
        while self.days and self.days[0][0] > self.end:
            self.days.popleft()


def _walks(frames: Iterator[pd.DataFrame], start: pd.Timestamp, today: pd.Timestamp, width: int, page: int) -> Iterator[pd.DataFrame]:
    """Rows (account, day, n) come account by account, the newest day first; a task holds a window's days."""
    names = [c.split()[0] for c in WINDOWS.split(", ")]
    walk: _Walk | None = None
    for frame in frames:
        out: list[tuple] = []
        for account, day, n in zip(frame["account"], pd.to_datetime(frame["day"]), frame["n"], strict=True):
            if walk is None or account != walk.account:
                out += walk.finish() if walk else []
                walk = _Walk(account, start, today, width, page)
            walk.day(day, int(n))
        yield pd.DataFrame(out, columns=names)
    if walk:
        yield pd.DataFrame(walk.finish(), columns=names)


def walked(accounts: DataFrame, bookings: DataFrame, start: str, today: str, width: int = 30, page: int = 500, strict: bool = True) -> DataFrame:
    """The windows in which each account of ``accounts`` (account) is read back from ``today`` to ``start``: account, window (0 is the newest), start, end, width, halvings, n, complete.

    A window is as wide as asked for, and halved, at most MOST_HALVINGS times, while ``bookings`` (account, day) of it fill
    a ``page``; the next one ends on the day before and is as wide as asked for again. Where a page is still full after
    that, the walk is over: with ``strict`` that is an error, else the account's last window is not complete. Bookings
    are counted by account and day first, so a walk goes over days, not rows. Rows of other days or without one are not read.
    """
    a, b = F.to_date(F.lit(start)), F.to_date(F.lit(today))
    names = accounts.select(F.col("account").cast("string").alias("account")).where("account is not null").distinct()
    read = bookings.select(F.col("account").cast("string").alias("account"), "day", F.lit(1).alias("n")).where(F.col("day").between(a, b)).join(names, "account", "left_semi")
    # a day without bookings makes an account known that has none; the sum comes after the union, so that the rows of an account are dealt together
    days = read.unionByName(names.select("account", b.alias("day"), F.lit(0).alias("n"))).groupBy("account", "day").agg(F.sum("n").alias("n"))
    ordered = days.repartition("account").sortWithinPartitions("account", F.desc("day"))
    windows = ordered.select("account", "day", "n").mapInPandas(partial(_walks, start=pd.Timestamp(start), today=pd.Timestamp(today), width=width, page=page), WINDOWS)
    if not strict:
        return windows
    full = F.raise_error(F.concat(F.lit("a page is full after all halvings: "), "account", F.lit(" "), F.col("start").cast("string"))).cast("boolean")
    return windows.withColumn("complete", F.when(F.col("complete"), F.lit(True)).otherwise(full))


def read_back(windows: DataFrame, bookings: DataFrame) -> DataFrame:
    """``bookings`` (account, day, ...) of the complete windows, each with the window it came in: by account and day, of which a window has its width at most."""
    days = windows.where("complete").select("account", "window", F.explode(F.sequence("start", "end")).alias("day"))
    return bookings.join(days, ["account", "day"])
