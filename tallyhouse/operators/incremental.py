"""Versions, the ledger and evidence in a store: a batch reads and writes the buckets of its own keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.operators import evidence as E
from tallyhouse.operators import versions as V
from tallyhouse.sources.folders import stored
from tallyhouse.sources.store import Change, Store

CHAIN = ["source", "external_id"]
REFERENCE = ["source", "order_ref_hash", "evidence_type"]


def insert_versions(store: Store, incoming: DataFrame, batch: str) -> None:
    """``versions``, by (source, external_id), with what of ``incoming`` (source, external_id, content_hash, arrival) is new.

    A hash counts once, whoever brings it, so that hashes have a table of their own, which only grows; the chains of an
    external id lie in one bucket. Rows of a hash that is known touch nothing.
    """
    if batch in store.manifest()["names"]:
        return
    known = store.read("hashes", store.touched(incoming, ["content_hash"]))
    fresh = V.versions(incoming if known is None else incoming.join(known, "content_hash", "left_anti"))
    fresh = stored(fresh, "fresh")
    touched = store.touched(fresh, CHAIN)
    before = store.read("versions", touched)
    after = fresh if before is None else V.extended(before, fresh)
    store.commit(batch, {"versions": Change(after, CHAIN, touched), "hashes": Change(fresh.select("content_hash"), ["content_hash"])} if touched else {})


def upsert(store: Store, table: str, incoming: DataFrame, keys: list[str], batch: str, fixed: list[str] = (), keep_set: list[str] = ()) -> None:
    """``table`` after ``incoming`` was put in by ``keys`` (see ``versions.upsert``): only the buckets of its keys are read, and of these only those that have changed count anew."""
    if batch in store.manifest()["names"]:
        return
    touched = store.touched(incoming, keys)
    before = store.read(table, touched)
    after = incoming if before is None else V.upsert(before, incoming.select(before.columns), keys, fixed, keep_set)
    store.commit(batch, {table: Change(after, keys, touched)} if touched else {})


def upsert_evidence(store: Store, drafts: DataFrame, order: str, batch: str) -> None:
    """``evidence``, by its id, after ``drafts`` were put in (see ``evidence.upsert_evidence``). Which ids ever had a reference is a table of its own, ``references``; it tells which further buckets to read."""
    if batch in store.manifest()["names"]:
        return
    named = drafts.where("order_ref_hash is not null")
    references = store.read("references", store.touched(named, REFERENCE))
    ids = drafts.select("evidence_id")
    if references is not None:
        ids = ids.union(references.join(named.select(REFERENCE).distinct(), REFERENCE, "left_semi").select("evidence_id"))
    touched = store.touched(ids, ["evidence_id"])
    columns = [c for c in drafts.columns if c != order]
    before = store.read("evidence", touched)
    before = drafts.select(columns).where("false") if before is None else before
    after = stored(E.upsert_evidence(before, drafts, order), "evidence")
    new = after.where("order_ref_hash is not null").select(*REFERENCE, "evidence_id")
    if references is not None:
        new = new.join(store.read("references", store.touched(new, REFERENCE)), [*REFERENCE, "evidence_id"], "left_anti")
    store.commit(batch, {"evidence": Change(after, ["evidence_id"], store.touched(after, ["evidence_id"])), "references": Change(new, REFERENCE)} if touched else {})
