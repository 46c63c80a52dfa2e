"""What is learned about ledger rows: rules, recurring payments, outliers, refunds, remembered examples."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tallyhouse.sources.folders import stored
from tallyhouse.functions.numbers import cents
from tallyhouse.functions.text import haystack

#: Fixed values, in order: words that a refund's text has all of, its category, whether it is settled without a look.
REFUND_WORDS = [
    ("techniker krankenk", "gesundheit", True),
    ("krankenkasse", "gesundheit", True),
    ("aok", "gesundheit", True),
    ("barmer", "gesundheit", True),
    ("apotheke", "gesundheit", True),
    ("zahnarzt", "gesundheit", True),
    ("booking.com", "reisen", True),
    ("airbnb", "reisen", True),
    ("lufthansa", "reisen", True),
    ("deutsche bahn", "reisen", True),
    ("zalando", "kleidung", True),
    ("about you", "kleidung", True),
    ("splitwise", "restaurant-cafe", False),
    ("paypal friends", "restaurant-cafe", False),
    ("amazon", "kleidung", False),
    ("retoure", "kleidung", False),
    ("rückerstattung", "kleidung", False),
    ("spesen", "reisen", False),
    ("reisekosten", "reisen", False),
    ("finanzamt", None, True),
    ("cashback", None, True),
    ("zinsen", None, True),
    ("dividende", None, True),
    ("steuer", None, False),
    ("bonus", None, False),
]


def native_pattern(pattern: str) -> str | None:
    """A rule's pattern as Spark's engine reads it; None where that engine, or the one that rules are written for, does not compile it."""
    from py4j.protocol import Py4JJavaError

    try:
        re.compile(pattern)
        found = "(?iu)" + re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern.replace("(?P<", "(?<"))
        SparkSession.active()._jvm.java.util.regex.Pattern.compile(found)
    except (re.error, Py4JJavaError):
        return None
    return found


def valid_rules(rules: list[tuple[str, str, int]]) -> list[tuple[str, str, int]]:
    """(pattern for Spark's engine, category, priority) of the rules whose patterns compile, highest priority first, then in the order given."""
    kept = [(native_pattern(pattern), category, priority) for pattern, category, priority in rules]
    return sorted([rule for rule in kept if rule[0] is not None], key=lambda r: -r[2])


def rule_category(rules: list[tuple[str, str, int]]) -> Column:
    """The category of the first rule that a row's text matches, null if none: one expression, no join. For rules by the thousand see ``rulebook``."""
    text = haystack(F.col("sender"), F.col("recipient"), F.col("description"))
    return F.coalesce(*[F.when(text.rlike(p), c) for p, c, _ in valid_rules(rules)], F.lit(None).cast("string"))


def apply_rules(ledger: DataFrame, rules: list[tuple[str, str, int]]) -> DataFrame:
    """Fills missing categories only."""
    return ledger.withColumn("matched", rule_category(rules)).withColumn("category_id", F.coalesce("category_id", "matched"))


def recurring(ledger: DataFrame, months: int = 3, tolerance_percent: int = 10) -> tuple[DataFrame, DataFrame]:
    """(patterns, flags): runs of at least ``months`` consecutive months with one counterpart whose amounts deviate little.

    Deviation is that of the population, compared exactly in cents: n sum(x^2) - sum(x)^2 <= (t sum(x))^2. Runs are islands of months: a month less its rank is constant in a run.
    """
    rows = ledger.withColumn("counterpart", F.coalesce(F.nullif("recipient", F.lit("")), F.nullif("sender", F.lit("")))).where("counterpart is not null and booking_date is not null")
    rows = rows.withColumns({"m": (F.year("booking_date") * 12 + F.month("booking_date")).cast("bigint"), "x": F.abs(cents(F.col("amount"))).cast("decimal(38,0)")})
    by_month = rows.groupBy("counterpart", "m").agg(F.sum("x").alias("sx"), F.sum((F.col("x") * F.col("x")).cast("decimal(38,0)")).alias("sxx"), F.count("*").alias("n"))
    island = by_month.withColumn("island", F.col("m") - F.row_number().over(W.Window.partitionBy("counterpart").orderBy("m")))
    runs = island.groupBy("counterpart", "island").agg(F.min("m").alias("first"), F.max("m").alias("last"), F.count("*").alias("months"), F.sum("n").alias("n"), F.sum("sx").cast("decimal(38,0)").alias("sx"), F.sum("sxx").cast("decimal(38,0)").alias("sxx"))
    runs = runs.where((F.col("months") >= months) & (F.col("sx") > 0))
    sx, n = F.col("sx").cast("double"), F.col("n").cast("double")
    deviation = n * F.col("sxx").cast("double") - sx * sx
    runs = runs.where(deviation <= (tolerance_percent / 100) ** 2 * sx * sx)
    patterns = runs.select("counterpart", "first", "last", F.col("months").cast("bigint").alias("months"), F.col("n").cast("bigint").alias("n"), F.round(sx / n / 100, 2).alias("avg_amount"))
    patterns = stored(patterns, "patterns")  # few as a rule: of known size, they go to the rows
    flags = rows.join(patterns.select("counterpart", "first", "last"), "counterpart").where("m between first and last").select("id", "counterpart", F.col("first").alias("pattern_start"))
    return patterns, flags


#: Ranges that a median's rows are counted in; a group's median lies in one or two of them.
RANGES = 1024


def medians(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, median: the exact median of each group, the mean of the middle two.

    Values are counted in RANGES ranges between the least and the largest of their group; then again in those ranges that hold a middle value, until each is a single value.
    Every count is combined before the shuffle and no task holds a group.
    """
    x = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("x"))
    groups = x.groupBy(*keys).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    # the places of the middle values, from 0: one for an odd size
    asked = F.explode(F.array_distinct(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)))).alias("asked")
    found = stored(groups.select(*keys, asked, "lo", "hi").withColumn("left", F.col("asked")), "medians")
    open_ = found.where("lo < hi")
    done = [found.where("lo = hi").select(*keys, "lo")]
    while open_.take(1):
        same = reduce(lambda p, q: p & q, [F.col(f"x.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys])
        inside = x.alias("x").join(open_.alias("f"), same & F.col("x.x").between(F.col("f.lo"), F.col("f.hi")))
        place = F.least(F.lit(RANGES - 1), F.floor((F.col("x.x") - F.col("f.lo")) / (F.col("f.hi") - F.col("f.lo")) * RANGES)).cast("int")
        counted = inside.groupBy(*[F.col(f"f.{k}").alias(k) for k in keys], "asked", "left", place.alias("r")).agg(F.count("*").alias("n"), F.min("x.x").alias("lo"), F.max("x.x").alias("hi"))
        in_order = W.Window.partitionBy(*keys, "asked").orderBy("r")  # RANGES rows a group at most
        before = counted.withColumn("before", F.sum("n").over(in_order) - F.col("n")).where("before <= left and left < before + n")
        found = stored(before.select(*keys, "asked", (F.col("left") - F.col("before")).alias("left"), "lo", "hi"), "medians")
        done.append(found.where("lo = hi").select(*keys, "lo"))
        open_ = found.where("lo < hi")
    return reduce(DataFrame.union, done).groupBy(*keys).agg((F.sum("lo") / F.count("*")).alias("median"))


def outliers(rows: DataFrame, group: str, value: str, least: int = 3, threshold: float = 3.5) -> DataFrame:
    """Rows whose modified z-score in their group exceeds the threshold, with the score; a null group is one too.

    0.6745 (x - median) / MAD, or (x - median) / (1.253314 mean deviation) where MAD is 0. A group may hold most of the rows.
    """
    joined = lambda a, b: a.join(b.withColumnRenamed(group, "_g"), F.col(group).eqNullSafe(F.col("_g"))).drop("_g")
    # the medians count these two columns again and again
    x = stored(rows.select(group, F.col(value).cast("double").alias("x")), "measured")
    middle = stored(joined(x.groupBy(group).agg(F.count("x").alias("size")), medians(x, [group], "x")), "middles")
    away = joined(x, middle).select(group, F.abs(F.col("x") - F.col("median")).alias("away"))
    measures = joined(joined(middle, away.groupBy(group).agg(F.avg("away").alias("mean_away"))), medians(away, [group], "away").withColumnRenamed("median", "mad"))
    x = joined(rows.withColumn("x", F.col(value).cast("double")), stored(measures, "measures"))
    z = F.when(F.col("mad") > 0, 0.6745 * (F.col("x") - F.col("median")) / F.col("mad")).when(F.col("mean_away") > 0, (F.col("x") - F.col("median")) / (1.253314 * F.col("mean_away"))).otherwise(0.0)
    return x.withColumn("z", z).where((F.col("size") >= least) & (F.abs("z") > threshold)).drop("x", "size", "median", "mad", "mean_away")


def refund_suggestion(ledger: DataFrame) -> DataFrame:
    """Adds the first table entry whose words the row's text has all of: refund_word, suggested_category, auto; nulls if none."""
    text = F.lower(F.concat_ws(" ", F.nullif("sender", F.lit("")), F.nullif("recipient", F.lit("")), F.nullif("description", F.lit(""))))
    hits = [F.when(reduce(lambda a, b: a & b, [F.contains(text, F.lit(w)) for w in words.split()]), F.struct(F.lit(words).alias("word"), F.lit(category).cast("string").alias("category"), F.lit(auto).alias("auto"))) for words, category, auto in REFUND_WORDS]
    return ledger.withColumn("hit", F.coalesce(*hits)).withColumns({"refund_word": F.col("hit.word"), "suggested_category": F.col("hit.category"), "auto": F.col("hit.auto")}).drop("hit")


def refund_candidates(ledger: DataFrame, catch_all: str) -> DataFrame:
    """Credits in the catch-all income category that nobody has decided on."""
    return ledger.where((F.col("category_id") == catch_all) & ~F.col("is_refund") & (F.col("amount") > 0) & ~F.col("internal_transfer") & F.col("refund_audit_decided_at").isNull())


def _grams(text: Column, n: int) -> Column:
    """The distinct runs of ``n`` characters of a text that has as many."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda k: F.substring(text, k, F.lit(n))))


def containing(longer: DataFrame, shorter: DataFrame, n: int = 4) -> DataFrame:
    """Distinct pairs (longer, shorter) of texts (columns of these names) of which the first contains the second, both of ``n`` characters at least.

    The longer ones are listed by each run of n characters; a shorter one is looked up by that of its runs which fewest
    of them have, and then compared. One that has a run which none has is not looked up at all.
    """
    a, b = (df.select(c).where(F.length(c) >= n).distinct() for df, c in ((longer, "longer"), (shorter, "shorter")))
    listed = a.select("longer", F.explode(_grams(F.col("longer"), n)).alias("gram"))
    sizes = listed.groupBy("gram").agg(F.count("*").alias("size"))
    asked = b.select("shorter", F.explode(_grams(F.col("shorter"), n)).alias("gram")).join(sizes, "gram", "left")
    rarest = asked.groupBy("shorter").agg(F.min(F.struct(F.coalesce("size", F.lit(0)).alias("size"), "gram")).alias("r")).where("r.size > 0")
    return rarest.select("shorter", "r.gram").join(listed, "gram").where(F.contains("longer", "shorter")).select("longer", "shorter")


def memory_examples(history: DataFrame, keys: DataFrame, most: int = 20, least_key: int = 4) -> DataFrame:
    """Categorised rows whose counterpart contains one of ``keys`` (a column key) or is contained in it: the newest of each (counterpart, category), the newest ``most`` of those.

    Keys and names of fewer than ``least_key`` characters take no part. The newest row of each (counterpart, category)
    comes first, then distinct names and keys meet by runs of ``least_key`` characters, in either direction.
    """
    name = F.lower(F.coalesce(F.nullif("recipient", F.lit("")), F.nullif("sender", F.lit(""))))
    rows = history.where("category_id is not null").withColumn("counterpart", name).where("counterpart is not null")
    newest = rows.groupBy("counterpart", "category_id").agg(F.min_by(F.struct("id", "booking_date"), F.struct((-F.unix_date("booking_date")).alias("d"), "id")).alias("r"))
    names, key = newest.select("counterpart").distinct(), keys.select(F.lower("key").alias("key"))
    within = containing(names.toDF("longer"), key.toDF("shorter"), least_key).select(F.col("longer").alias("counterpart"))
    around = containing(key.toDF("longer"), names.toDF("shorter"), least_key).select(F.col("shorter").alias("counterpart"))
    return newest.join(within.union(around).distinct(), "counterpart", "left_semi").select("r.id", "counterpart", "category_id", "r.booking_date").orderBy(F.desc("booking_date"), "id").limit(most)


def decided(ledger: DataFrame, catch_all: str, at: str) -> DataFrame:
    """``ledger`` after the clear cases of refund_candidates were decided at ``at``: a refund takes the suggested category, an income stays as it is, and neither comes up again."""
    found = refund_suggestion(refund_candidates(ledger, catch_all)).where("auto").select("id", F.col("suggested_category").alias("_category"), F.lit(True).alias("_hit"))
    hit, refund = F.coalesce("_hit", F.lit(False)), F.col("_category").isNotNull()
    both = ledger.join(found, "id", "left")
    new = {"category_id": F.coalesce("_category", "category_id"), "is_refund": F.col("is_refund") | (hit & refund), "refund_audit_decided_at": F.when(hit, F.to_timestamp(F.lit(at))).otherwise(F.col("refund_audit_decided_at"))}
    return both.select([new.get(c, F.col(c)).alias(c) for c in ledger.columns])
