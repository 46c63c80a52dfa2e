"""Stored tables, kept over three batches, against the same batches decided at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.numbers import money
from tallyhouse.operators import incremental
from tallyhouse.plans.analysis import _VERSIONS, _arrivals
from tallyhouse.plans.registry import query
from tallyhouse.sources.folders import fresh_folder
from tallyhouse.sources.store import Store
from tallyhouse.sources.tables import Tables, with_


@query(with_("ledger", **_VERSIONS) + "SELECT * FROM v")
def stored_versions(t: Tables) -> DataFrame:
    """All arrivals in three batches, each of which repeats some of the one before; the last comes twice."""
    rows, store = _arrivals(t), Store(t.spark, fresh_folder(t.spark, "store"), 16)
    last = rows.agg(F.max("arrival")).first()[0]
    for k, (begin, end) in enumerate([(0, 0.4), (0.2, 0.7), (0.6, 1)]):
        incremental.insert_versions(store, rows.where(F.col("arrival").between(int(begin * last), int(end * last))), f"batch {k}")
    incremental.insert_versions(store, rows.where(F.col("arrival") > 0.6 * last), "again")
    return store.read("versions")


_LATEST = "CASE WHEN okey % 5 = 0 THEN 3 WHEN okey % 3 = 0 THEN 2 ELSE 1 END"


@query(with_("ledger") + f"SELECT id, CAST(amount * {_LATEST} AS DECIMAL(18,2)) AS amount, CASE WHEN okey % 2 = 0 AND category_id IS NOT NULL THEN category_id WHEN okey % 3 = 0 THEN 'second' WHEN okey % 5 = 0 THEN 'third' END AS category_id, CAST(booking_date + CASE WHEN okey % 2 = 0 THEN 1 WHEN okey % 3 = 0 THEN 2 ELSE 3 END AS DATE) AS booking_date FROM ledger WHERE okey % 2 = 0 OR okey % 3 = 0 OR okey % 5 = 0")
def stored_ledger(t: Tables) -> DataFrame:
    """Three batches that meet in many rows: the newest amount, the first category, the first day."""
    store = Store(t.spark, fresh_folder(t.spark, "store"), 16)
    for k, (every, category) in enumerate([(2, F.col("category_id")), (3, F.lit("second")), (5, F.lit("third"))], 1):
        rows = t.ledger().where(F.col("okey") % every == 0).select("id", money(F.col("amount") * k).alias("amount"), category.alias("category_id"), F.date_add("booking_date", k).alias("booking_date"))
        incremental.upsert(store, "ledger", rows, ["id"], f"batch {k}", fixed=["booking_date"], keep_set=["category_id"])
    return store.read("ledger")


_EVIDENCE = dict(
    a="SELECT 's' || id AS evidence_id, okey, CASE WHEN okey % 5 <> 0 THEN 'r' || id END AS ref, CAST(amount AS DECIMAL(18,2)) AS amount FROM ledger WHERE okey % 2 = 0",
    b="SELECT l.id, l.okey, l.amount, coalesce(x.evidence_id, y.evidence_id, CASE WHEN okey_own THEN 's' ELSE 'n' END || l.id) AS evidence_id FROM (SELECT *, okey % 8 = 0 AS okey_own FROM ledger WHERE okey % 3 = 0) l LEFT JOIN a x ON x.evidence_id = CASE WHEN okey_own THEN 's' ELSE 'n' END || l.id LEFT JOIN a y ON y.ref = CASE WHEN l.okey % 5 <> 0 THEN 'r' || l.id END",
    ab="SELECT coalesce(b.evidence_id, a.evidence_id) AS evidence_id, CASE WHEN b.id IS NOT NULL THEN CASE WHEN b.okey % 5 <> 0 THEN 'r' || b.id END ELSE a.ref END AS ref, coalesce(CAST(b.amount * 2 AS DECIMAL(18,2)), a.amount) AS amount FROM a FULL JOIN b USING (evidence_id)",
    c="SELECT l.id, l.okey, l.amount, coalesce(y.evidence_id, 'm' || l.id) AS evidence_id FROM (SELECT * FROM ledger WHERE okey % 7 = 0) l LEFT JOIN ab y ON y.ref = CASE WHEN l.okey % 5 <> 0 THEN 'r' || l.id END",
)


@query(with_("ledger", **_EVIDENCE) + "SELECT coalesce(c.evidence_id, ab.evidence_id) AS evidence_id, CASE WHEN c.id IS NOT NULL THEN CASE WHEN c.okey % 5 <> 0 THEN 'r' || c.id END ELSE ab.ref END AS order_ref_hash, coalesce(CAST(c.amount * 3 AS DECIMAL(18,2)), ab.amount) AS total_amount FROM ab FULL JOIN c USING (evidence_id)")
def stored_evidence(t: Tables) -> DataFrame:
    """Three batches of drafts; later ones come under other ids and are known by their reference, where they have one."""
    store = Store(t.spark, fresh_folder(t.spark, "store"), 16)
    own = [F.lit("s"), F.when(F.col("okey") % 8 == 0, "s").otherwise("n"), F.lit("m")]
    for k, every in enumerate((2, 3, 7)):
        drafts = t.ledger().where(F.col("okey") % every == 0).select(F.concat(own[k], "id").alias("evidence_id"), F.lit("gmail").alias("source"), F.when(F.col("okey") % 5 != 0, F.concat(F.lit("r"), "id")).alias("order_ref_hash"), F.lit("invoice").alias("evidence_type"), money(F.col("amount") * (k + 1)).alias("total_amount"), "okey")
        incremental.upsert_evidence(store, drafts, "okey", f"batch {k}")
    return store.read("evidence").select("evidence_id", "order_ref_hash", "total_amount")
