"""What users and jobs change: patches, deletions, reports and the books that runs keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.operators.versions import upsert


def patched(ledger: DataFrame, patches: DataFrame) -> DataFrame:
    """``ledger`` (with refund_audit_decided_at) after ``patches`` (id, set_category, category_id, is_refund, internal_transfer, decided, at), one a row.

    set_category tells a category that is set to null from one that is left alone; other nulls change nothing. A row made a refund is decided at ``at`` unless ``decided`` says so itself; false takes the decision back.
    """
    p = patches.select(F.col("id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in ("set_category", "category_id", "is_refund", "internal_transfer", "decided", "at")])
    both = ledger.join(p, F.col("id") == F.col("_id"), "left")
    decided = F.when(F.col("_decided"), F.col("_at")).when(~F.col("_decided"), F.lit(None).cast("timestamp")).when(F.col("_is_refund"), F.col("_at")).otherwise(F.col("refund_audit_decided_at"))
    new = {"category_id": F.when(F.col("_set_category"), F.col("_category_id")).otherwise(F.col("category_id")), "is_refund": F.coalesce("_is_refund", "is_refund"), "internal_transfer": F.coalesce("_internal_transfer", "internal_transfer"), "refund_audit_decided_at": decided}
    return both.select([new.get(c, F.col(c)).alias(c) for c in ledger.columns])


def retagged(tags: DataFrame, patches: DataFrame) -> DataFrame:
    """``tags`` (id, tag) after ``patches`` (id, tags): a list replaces all tags of its row, an empty one too; null leaves them."""
    given = patches.where("tags is not null")
    return tags.join(given.select("id"), "id", "left_anti").unionByName(given.select("id", F.explode(F.array_distinct("tags")).alias("tag")))


def without_category(ledger: DataFrame, budgets: DataFrame, category: str) -> tuple[DataFrame, DataFrame]:
    """(ledger, budgets) after a category was deleted: its rows have none, its budget is gone."""
    return ledger.withColumn("category_id", F.when(F.col("category_id") == category, F.lit(None)).otherwise(F.col("category_id"))), budgets.where(F.col("category_id") != category)


def without_tag(tags: DataFrame, tag: str) -> DataFrame:
    return tags.where(F.col("tag") != tag)


def report_saved(reports: DataFrame, new: DataFrame) -> DataFrame:
    """``reports`` with ``new`` ones in the place of those of their type and period."""
    keys = ["report_type", "period_start", "period_end"]
    return reports.join(new.select(keys), keys, "left_anti").unionByName(new)


def run_events(runs: DataFrame, events: DataFrame) -> DataFrame:
    """The book of runs after ``events`` (run_id, kind, at, source, rows, error): started, beat and finished ones; a finish with an error is a failure. A beat after the finish changes nothing. Of finishes at one time one with an error counts, of these the one with the last error and most rows."""
    seen = events.groupBy("run_id").agg(
        F.max("source").alias("source"), F.min(F.when(F.col("kind") == "started", F.col("at"))).alias("started_at"), F.max(F.when(F.col("kind") == "beat", F.col("at"))).alias("heartbeat_at"),
        F.max(F.when(F.col("kind") == "finished", F.struct("at", "error", "rows"))).alias("end"))
    status = F.when(F.col("end").isNull(), "running").when(F.col("end.error").isNotNull(), "failed").otherwise("completed")
    rows = seen.select("run_id", "source", status.alias("status"), "started_at", F.col("end.at").alias("finished_at"), F.when(F.col("end").isNull() | (F.col("heartbeat_at") <= F.col("end.at")), F.col("heartbeat_at")).alias("heartbeat_at"), F.col("end.rows").alias("rows"), F.col("end.error").alias("error"))
    return upsert(runs, rows, ["run_id"])


def recurring_stored(stored: DataFrame, patterns: DataFrame, flags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(patterns, id -> pattern_id): every run of patterns is added under an id of its counterpart and first month, and its rows point to it."""
    named = patterns.withColumn("pattern_id", F.xxhash64("counterpart", "first"))
    return stored.unionByName(named.join(stored.select("pattern_id"), "pattern_id", "left_anti").select(stored.columns)), flags.select("id", F.xxhash64("counterpart", "pattern_start").alias("pattern_id"))


def depots_saved(stored: DataFrame, payloads: DataFrame) -> DataFrame:
    """Depots (depot_id, client_id, depot_type, currency) after ``payloads`` (seq, raw): the type is nested or plain, payloads without an id are left out, the last of each id counts."""
    at = lambda *paths: F.coalesce(*[F.nullif(F.get_json_object("raw", p), F.lit("")) for p in paths])
    kind = F.when(F.startswith(F.coalesce(at("$.depotType"), F.lit("")), F.lit("{")), at("$.depotType.text")).otherwise(at("$.depotType"))
    rows = payloads.select("seq", at("$.depotId", "$.depot_id").alias("depot_id"), at("$.clientId").alias("client_id"), kind.alias("depot_type"), F.coalesce(at("$.currency"), F.lit("EUR")).alias("currency")).where("depot_id is not null")
    last = rows.groupBy("depot_id").agg(F.max_by(F.struct("client_id", "depot_type", "currency"), "seq").alias("d")).select("depot_id", "d.*")
    return upsert(stored, last, ["depot_id"])


def errors_grouped(errors: DataFrame) -> DataFrame:
    """message, agents: errors (agent, message) as users are told of them, equal ones together."""
    from tallyhouse.functions.text import error_class

    return errors.groupBy(error_class(F.col("message")).alias("message")).agg(F.array_join(F.array_sort(F.collect_set("agent")), ", ").alias("agents"), F.count("*").alias("n"))



def metric_list(json: Column) -> Column:
    """Metrics as a list of key and value, whether they were stored so or as one object."""
    entries = F.map_entries(F.from_json(json, "map<string,string>"))
    return F.when(F.startswith(F.trim(json), F.lit("{")), entries).otherwise(F.from_json(json, "array<struct<key:string,value:string>>"))
