"""Version chains over several runs of a stream."""

from tallyhouse.operators import versions
from tallyhouse.sources.folders import fresh_folder
from tallyhouse.sources.store import Store
from tallyhouse.streaming import chains, ingest

SCHEMA = "source string, external_id string, content_hash string, arrival int"
FILES = [[("s", "x", "h1", 2), ("s", "x", "h0", 1), ("s", "y", "g1", 3), ("t", "x", "k1", 4)], [("s", "x", "h1", 5), ("s", "x", "h2", 6), (None, "z", "n1", 7), ("s", "x", "h0", 8)], [("s", "y", "g2", 9), ("s", "x", "h3", 10), (None, "z", "n2", 11), ("s", "x", "h3", 12)]]
NAMES = ["source", "external_id", "content_hash", "arrival", "version", "superseded_by"]


def test_chains_over_runs(spark):
    """Files come one by one, in two runs of the stream; the second goes on from the first one's state."""
    path, arriving = fresh_folder(spark, "chains"), fresh_folder(spark, "arriving")
    for k, rows in enumerate(FILES):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(arriving)
        if k:
            got = chains.chained(ingest.opened(spark, arriving, 1), path)
    want = versions.versions(spark.createDataFrame([r for rows in FILES for r in rows], SCHEMA))
    kept = lambda df: sorted((tuple(r) for r in df.select(NAMES).collect()), key=str)
    assert kept(got) == kept(want)


def test_rows_without_an_id_are_no_chain(spark):
    arriving = fresh_folder(spark, "arriving")
    spark.createDataFrame([("s", None, "h1", 1), ("s", "x", None, 2), ("s", "x", "h2", 3)], SCHEMA).write.parquet(arriving)
    assert [tuple(r) for r in chains.chained(ingest.opened(spark, arriving), fresh_folder(spark, "chains")).select(NAMES).collect()] == [("s", "x", "h2", 3, 1, None)]


def test_stored_chains(spark):
    arriving, store = fresh_folder(spark, "arriving"), Store(spark, fresh_folder(spark, "store"), 4)
    for k, rows in enumerate(FILES):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(arriving)
        if k != 1:
            chains.kept(ingest.opened(spark, arriving, 1), store)
    want = versions.versions(spark.createDataFrame([r for rows in FILES for r in rows], SCHEMA))
    assert sorted(map(tuple, store.read("versions").select(NAMES).collect()), key=str) == sorted(map(tuple, want.select(NAMES).collect()), key=str)
