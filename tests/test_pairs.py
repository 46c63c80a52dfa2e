"""Pairs, sums and settlements whose outcome depends on what was used before, and amounts that most rows share."""

import random
from datetime import date, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from tallyhouse.operators import ordering, pairing

DAY = date(2026, 1, 1)
SCHEMA = "id string, account string, booking_date date, amount decimal(14,2)"


def rows(spark, *found, account="x"):
    return spark.createDataFrame([(i, account, DAY + timedelta(d), Decimal(str(a))) for i, d, a in found], SCHEMA)


def links(spark, parents, children):
    return sorted(map(tuple, pairing.collective_debits(rows(spark, *parents), rows(spark, *children), "account").collect()))


def test_used_details_are_no_candidates(spark):
    """20 details; the first debit takes four of them, so that the second has 16 left and is solved."""
    first = [(f"a{k}", 0, -(1000 + k)) for k in range(4)]
    more = [(f"b{k:02d}", 2, -(2**k) / 100) for k in range(16)]
    got = links(spark, [("p1", -1, sum(a for *_, a in first)), ("p2", 1, -2.07)], first + more)
    assert got == sorted([("p1", f"a{k}") for k in range(4)] + [("p2", f"b{k:02d}") for k in (0, 1, 2, 3, 6, 7)])
    assert links(spark, [("p2", 1, -2.07)], first + more) == []  # 20 are too many


def test_details_of_no_amount(spark):
    assert links(spark, [("p", 0, -3)], [("a", 0, -1), ("b", 0, -2), ("z", 0, 0)] + [(f"z{k}", 1, 0) for k in range(30)]) == [("p", "a"), ("p", "b")]


def test_twin_debits_and_accounts(spark):
    """The second of two equal debits finds nothing left; other accounts and rows without one do not matter."""
    parents = rows(spark, ("p", 0, -3), ("q", 0, -3)).union(rows(spark, ("r", 0, -3), account="y")).union(rows(spark, ("n", 0, -3), account=None))
    children = rows(spark, ("a", 0, -1), ("b", 1, -2)).union(rows(spark, ("c", 2, -3), account="y")).union(rows(spark, ("d", 0, -3), account=None))
    assert sorted(map(tuple, pairing.collective_debits(parents, children, "account", tasks=3).collect())) == [("p", "a"), ("p", "b"), ("r", "c")]


def test_sums_equal_a_plain_search(spark):
    r = random.Random(2)
    children = sorted([(f"c{k:03d}", r.randrange(60), r.choice([-1, -2, -3, -4, 1, 0])) for k in range(120)], key=lambda x: (x[1], x[0]))
    parents = sorted([(f"p{k:02d}", r.randrange(60), -r.randrange(1, 12)) for k in range(50)], key=lambda x: (x[1], x[0]))
    used, want = set(), []
    for p, day, amount in parents:
        free = [c for c in children if c[0] not in used and abs(c[1] - day) <= 2 and c[2]]
        if len(free) > 18:
            continue
        sets = [[c[0] for k, c in enumerate(free) if m >> k & 1] for m in range(1, 1 << len(free)) if sum(c[2] for k, c in enumerate(free) if m >> k & 1) == amount]
        if len(sets) == 1:
            used.update(sets[0])
            want += [(p, c) for c in sets[0]]
    assert want and links(spark, parents, children) == sorted(want)


def cycles(spark, *found):
    kept = [(DAY.replace(month=m), net * 100, DAY.replace(month=m, day=2), 3) for m, net in found]
    return spark.createDataFrame(kept, "cycle date, net_cents long, first date, n long")


def paid(spark, months, debits):
    found = pairing.settlements(cycles(spark, *months), rows(spark, *debits))
    return sorted((r["debit_id"], r["cycle"].month) for r in found.collect())


def test_equal_cycles_are_paid_in_turn(spark):
    assert paid(spark, [(1, -100), (2, -100)], [("a", 20, -100), ("b", 60, -100), ("c", 61, -100)]) == [("a", 1), ("b", 2)]
    assert paid(spark, [(1, -100), (2, -100)], [("a", 60, -100), ("b", 61, -100)]) == []  # both are open: which one?


def test_a_cycle_of_either_sign(spark):
    assert paid(spark, [(1, 100), (2, -70), (3, 0)], [("a", 40, -100), ("b", 41, -70), ("c", 90, 70)]) == [("a", 1), ("b", 2)]


def test_an_amount_of_most_rows_is_dealt_over_tasks(spark):
    """Small partitions are not put together here, so that the table counts as a large one."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        _most_rows(spark)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def _most_rows(spark):
    r = random.Random(7)
    found = [(f"{k:05d}", r.randrange(3), r.choice([5, -5])) for k in range(4000)] + [(f"x{k}", 0, 7 * (-1) ** k) for k in range(50)]
    table = rows(spark, *found)
    placed, _ = ordering.dealt(table.select("id", F.abs("amount").alias("cents"), F.col("booking_date").alias("day"), (F.col("amount") > 0).alias("credit")), ["cents", "day", "credit"], ["id"])
    assert max(x["count"] for x in placed.groupBy("_part").count().collect()) <= 0.5 * len(found)
    debits = sorted(((d, i) for i, d, a in found if a < 0), key=lambda x: x)
    amount, used, want = {i: a for i, _, a in found}, set(), []
    for d, i in sorted((d, i) for i, d, a in found if a > 0):
        hit = next((j for e, j in debits if j not in used and abs(d - e) <= 2 and amount[j] == -amount[i]), None)
        if hit:
            used.add(hit)
            want.append((i, hit))
    assert sorted(map(tuple, pairing.matched(table).collect())) == sorted(want)
