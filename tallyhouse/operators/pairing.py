"""Which ledger rows belong together: transfers between own accounts, top-ups, collective debits, card settlements."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tallyhouse.functions.numbers import cents
from tallyhouse.functions.text import uuid5
from tallyhouse.operators.ordering import dealt
from tallyhouse.sources.folders import stored

#: Days between the sides of a pair; days that a settlement may precede its cycle; candidates that a collective debit may have.
WITHIN, BEFORE, MOST_CANDIDATES = 2, 3, 18


def link_id(kind: Column, parent: Column, child: Column, prefix: str = "link") -> Column:
    """The stable id of a link: the version 5 UUID of ``prefix:kind:parent:child`` in the namespace of URLs. ``prefix`` is that of the ids which are stored."""
    return uuid5(F.concat_ws(":", F.lit(prefix), kind, parent, child))


def _spans(frames: Iterator[pd.DataFrame], within: int) -> Iterator[pd.DataFrame]:
    """Which credits of a day meet which debits, as runs of places: rows (cents, day, credits, debits) come amount by amount and day by day, and a day's credits take the first debits that are left."""
    columns = ["cents", "credit_day", "credit_from", "debit_day", "debit_from", "n"]
    amount: int | None = None
    waiting: deque = deque()  # days whose credits have not chosen yet
    debits: deque = deque()  # [day, first place that is free, how many are]
    out: list[tuple] = []

    def settle(until) -> None:
        while waiting and (until is None or (until - waiting[0][0]).days > within):
            day, left = waiting.popleft()
            while debits and (day - debits[0][0]).days > within:
                debits.popleft()
            place = 1
            for d in debits:
                if not left or (d[0] - day).days > within:
                    break
                if n := min(left, d[2]):
                    out.append((amount, day, place, d[0], d[1], n))
                    place, left, d[1], d[2] = place + n, left - n, d[1] + n, d[2] - n

    for frame in frames:
        for c, day, n_credits, n_debits in zip(frame["cents"], frame["day"], frame["credits"], frame["debits"], strict=True):
            if c != amount:
                settle(None)
                amount = c
                debits.clear()
            settle(day)
            if n_debits:
                debits.append([day, 1, int(n_debits)])
            if n_credits:
                waiting.append((day, int(n_credits)))
        yield pd.DataFrame(out, columns=columns)
        out = []
    settle(None)
    yield pd.DataFrame(out, columns=columns)


def matched(rows: DataFrame, within: int = WITHIN) -> DataFrame:
    """Pairs (credit_id, debit_id) of ``rows`` (id, amount, booking_date): equal cents, opposite signs, at most ``within`` days apart.

    Credits choose in the order (booking_date, id); each takes the first debit in that order that is free. All credits of
    one amount and day have the same choice, so the days' numbers of rows decide it: they alone are gone through in order,
    a row an amount and day. Rows are then numbered within amount, day and sign, across tasks, and meet by their number;
    an amount that a third of the rows share is dealt like any other.
    """
    keys = ["cents", "day", "credit"]
    own = rows.where("amount <> 0 and booking_date is not null").select("id", F.abs(cents(F.col("amount"))).alias("cents"), F.col("booking_date").alias("day"), (F.col("amount") > 0).alias("credit"))
    placed, parts = dealt(own, keys, ["id"])
    days = parts.groupBy("cents", "day").agg(F.sum(F.when(F.col("credit"), F.col("_rows"))).alias("credits"), F.sum(F.when(~F.col("credit"), F.col("_rows"))).alias("debits")).fillna(0)
    ordered = days.repartition("cents").sortWithinPartitions("cents", "day")
    spans = stored(ordered.mapInPandas(partial(_spans, within=within), "cents long, credit_day date, credit_from long, debit_day date, debit_from long, n long"), "spans")
    side = lambda c: F.struct(F.lit(c == "credit").alias("credit"), F.col(f"{c}_day").alias("day"), F.col(f"{c}_from").alias("from"))
    sides = spans.select("cents", "credit_day", "debit_day", F.col("n").alias("wanted"), F.explode(F.array(side("credit"), side("debit"))).alias("s")).select("cents", "credit_day", "debit_day", "wanted", "s.*")
    plan = parts.join(sides, keys).where((F.col("from") <= F.col("_before") + F.col("_rows")) & (F.col("from") + F.col("wanted") > F.col("_before") + 1))
    number = F.col("_before") + F.col("_line") - F.col("_first") + 1 - F.col("from")
    met = placed.join(plan, [*keys, "_part"]).withColumn("number", number).where((F.col("number") >= 0) & (F.col("number") < F.col("wanted")))
    of = lambda credit: F.max(F.when(F.col("credit") == F.lit(credit), F.col("id")))
    return met.groupBy("cents", "credit_day", "debit_day", "number").agg(of(True).alias("credit_id"), of(False).alias("debit_id")).select("credit_id", "debit_id")


def internal_transfers(ledger: DataFrame, own_ibans: list[str]) -> DataFrame:
    """Pairs of rows that move money between own accounts. Without own numbers any account number on both sides will do."""
    if own_ibans:
        eligible = F.col("sender_iban").isin(own_ibans) | F.col("recipient_iban").isin(own_ibans)
    else:
        eligible = F.col("sender_iban").isNotNull() | F.col("recipient_iban").isNotNull()
    return matched(ledger.where(eligible))


def top_ups(ledger: DataFrame, is_wallet: Column, is_bank: Column) -> DataFrame:
    """Pairs of a wallet's credit and the bank's debit that paid for it."""
    return matched(ledger.where((is_wallet & (F.col("amount") > 0)) | (is_bank & (F.col("amount") < 0))))


def _sums(values: list[int]) -> dict[int, tuple[int, int]]:
    """Of each sum of some of ``values``: how many subsets have it, and one of them as bits."""
    sums = {0: (1, 0)}
    for k, v in enumerate(values):
        for s, (n, bits) in list(sums.items()):
            m, own = sums.get(s + v, (0, 0))
            sums[s + v] = m + n, own or bits | 1 << k
    return sums


def only_subset(target: int, values: list[int]) -> list[int] | None:
    """Places of the one subset of ``values`` that sums to ``target``; None if there is none or more than one. Zeros belong to none. Sums of the halves meet, so that few are ever formed."""
    places = [k for k, v in enumerate(values) if v]
    half = len(places) // 2
    left, right = (_sums([values[k] for k in part]) for part in (places[:half], places[half:]))
    ways, bits = -(target == 0), 0
    for s, (n, own) in left.items():
        if met := right.get(target - s):
            ways += n * met[0]
            bits = own | met[1] << half if own or met[1] else bits
            if ways > 1:
                return None
    return [places[k] for k in range(len(places)) if bits >> k & 1] if ways == 1 else None


def _solved(frames: Iterator[pd.DataFrame], within: int) -> Iterator[pd.DataFrame]:
    """Rows come island by island in order of day, details before the parents whose window they end; a task holds the details of one window."""
    own: tuple | None = None
    free: deque = deque()  # (day, id, cents), none of them used
    for frame in frames:
        links = []
        for account, island, parent, day, i, c in zip(frame["account"], frame["island"], frame["parent"], frame["day"], frame["id"], frame["cents"], strict=True):
            if (account, island) != own:
                own = account, island
                free.clear()
            if not parent:
                free.append((day, i, int(c)))
                continue
            while free and (day - free[0][0]).days > within:
                free.popleft()
            if not 0 < len(free) <= MOST_CANDIDATES:
                continue
            candidates = list(free)
            if subset := only_subset(int(c), [x[2] for x in candidates]):
                links += [(i, candidates[k][1]) for k in subset]
                free = deque(x for k, x in enumerate(candidates) if k not in subset)
        yield pd.DataFrame(links, columns=["parent_id", "child_id"])


def collective_debits(parents: DataFrame, children: DataFrame, account: str, within: int = WITHIN, tasks: int | None = None) -> DataFrame:
    """Links (parent_id, child_id): a debit that is the sum of exactly one set of an account's detail rows within ``within`` days.

    Parents of an account go in the order (booking_date, id), and a detail row is used once. One with more than
    MOST_CANDIDATES details left in its window is left alone; details of no amount count nowhere. Runs of days whose
    windows do not touch cannot compete, so accounts are dealt over ``tasks`` (the session's shuffle partitions, if None)
    by account and run of days. Rows without an account, day or amount take no part.
    """
    key = F.col(account).alias("account")
    p = parents.select("id", key, F.col("booking_date").alias("day"), cents(F.col("amount")).alias("cents")).dropna(subset=["account", "day", "cents"])
    c = children.select("id", key, F.col("booking_date").alias("day"), cents(F.col("amount")).alias("cents")).where("cents <> 0").dropna(subset=["account", "day"])
    by_day = W.Window.partitionBy("account").orderBy("day")
    apart = F.coalesce(F.datediff("day", F.lag("day").over(by_day)) > 2 * within, F.lit(True)).cast("int")
    days = p.select("account", "day").distinct().withColumn("island", F.sum(apart).over(by_day))  # a row an account and day
    reach = days.select("account", "island", F.explode(F.sequence(F.date_sub("day", within), F.date_add("day", within))).alias("day")).distinct()
    # a parent comes when its window is complete
    rows = p.join(days, ["account", "day"]).select("account", "island", F.lit(True).alias("parent"), F.date_add("day", within).alias("due"), "day", "id", "cents")
    rows = rows.unionByName(c.join(reach, ["account", "day"]).select("account", "island", F.lit(False).alias("parent"), F.col("day").alias("due"), "day", "id", "cents"))
    dealt = rows.repartition(tasks or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "account", "island").sortWithinPartitions("account", "island", "due", "parent", "day", "id")
    kinds = parents.schema["id"].dataType.simpleString(), children.schema["id"].dataType.simpleString()
    return dealt.mapInPandas(partial(_solved, within=within), f"parent_id {kinds[0]}, child_id {kinds[1]}")


def card_cycles(ledger: DataFrame) -> DataFrame:
    """Net, first and last day of each month of card rows."""
    return ledger.groupBy(F.trunc("booking_date", "MM").alias("cycle")).agg(F.sum(cents(F.col("amount"))).alias("net_cents"), F.min("booking_date").alias("first"), F.max("booking_date").alias("last"), F.count("*").alias("n"))


def _paid(frames: Iterator[pd.DataFrame], before: int) -> Iterator[pd.DataFrame]:
    """Rows come amount by amount, cycles first and then debits in order; what a task holds is one amount's cycles, of which there is one a month."""
    amount: int | None = None
    cycles: list[tuple] = []
    for frame in frames:
        out = []
        for c, debit, day, cycle, n in zip(frame["cents"], frame["debit_id"], frame["day"], frame["cycle"], frame["n"], strict=True):
            if c != amount:
                amount, cycles = c, []
            if pd.isna(debit):
                cycles.append((cycle, day, n))
                continue
            fit = [x for x in cycles if (x[1] - day).days <= before]
            if len(fit) == 1:
                cycles.remove(fit[0])
                out.append((debit, fit[0][0], c, int(fit[0][2])))
        yield pd.DataFrame(out, columns=["debit_id", "cycle", "cents", "n"])


def settlements(cycles: DataFrame, debits: DataFrame, before: int = BEFORE) -> DataFrame:
    """Debits that pay a cycle (debit_id, cycle, cents, n): as many cents as the cycle has on balance, of either sign, and not more than ``before`` days before it began.

    Debits go in the order (booking_date, id); a cycle is paid once, and a debit with several unpaid cycles pays none.
    Only debits whose amount some cycle has are dealt, by that amount.
    """
    d = debits.where("amount < 0 and booking_date is not null").select((-cents(F.col("amount"))).alias("cents"), F.col("id").alias("debit_id"), F.col("booking_date").alias("day"), F.lit(None).cast("date").alias("cycle"), F.lit(None).cast("long").alias("n"))
    c = cycles.select(F.abs("net_cents").alias("cents"), F.lit(None).cast(d.schema["debit_id"].dataType).alias("debit_id"), F.col("first").alias("day"), "cycle", "n")
    rows = c.unionByName(d.join(c.select("cents").distinct(), "cents", "left_semi"))
    dealt = rows.repartition("cents").sortWithinPartitions("cents", F.col("debit_id").isNotNull(), "day", "debit_id", "cycle")
    return dealt.select("cents", "debit_id", "day", "cycle", "n").mapInPandas(partial(_paid, before=before), f"debit_id {d.schema['debit_id'].dataType.simpleString()}, cycle date, cents long, n long")
