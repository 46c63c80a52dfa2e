"""A content-addressed store of token ids.

Documents' id streams are cut where a rolling hash of the last ids says so; each distinct chunk is stored once under
its digest; a recipe per document lists its chunks in order. Merkle trees make reading verifiable: a document's root is over its chunks
with their lengths and positions, a shard's over its documents in order, the store's over its shards. Layout below the store's folder, all Parquet:

- ``chunks``: digest, seq, after, n, doc_id, tie and, on one row of each digest, ``payload`` (ids, little-endian unsigned);
- ``recipes/shard=k``: in ascending doc_id: pos, doc_id, tie, before (ids of the shard before it), n_tokens, chunks (digest, length and ids after it, in order), root;
- ``manifest``: shard, start, n_docs, n_tokens, root;
- ``whole``: n_shards, n_docs, n_tokens, root.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tallyhouse.llm.shards import with_shards
from tallyhouse.llm.storage import small_batches
from tallyhouse.llm.wordids import word_ids

#: A cut falls where this many low bits of the rolling hash are zero; no chunk is shorter than LEAST or longer than MOST ids.
CUT_BITS, LEAST, MOST, REACH = 8, 64, 2048, 16
#: Roots that one node list of a tree holds: larger sets are cut into runs of so many, and a tree is built over the runs' roots.
RUN_OF_ROOTS = 4096
WHOLE = "n_shards long, n_docs long, n_tokens long, root string"
#: Fixed value: the reversed CRC-32 polynomial.
CRC_POLYNOMIAL = 0xEDB88320


def _gear() -> np.ndarray:
    x = (np.arange(1 << 16, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return ((x * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)).astype(np.uint32)


GEAR = _gear()
assert REACH & (REACH - 1) == 0


def marks(ids: np.ndarray) -> np.ndarray:
    """Ends at which the rolling hash of the REACH ids before has its low bits zero. What stands before a document does not matter to it: its first LEAST ids, more than REACH, are never cut."""
    rolled, reach = GEAR[ids & 0xFFFF], 1
    while reach < min(REACH, len(ids)):  # sums over twice as many ids from two sums
        rolled[reach:] += rolled[:-reach] << np.uint32(reach)
        reach *= 2
    return np.flatnonzero(rolled >> np.uint32(32 - CUT_BITS - 8) & np.uint32((1 << CUT_BITS) - 1) == 0) + 1


def cut_points(n: int, at: list[int]) -> list[int]:
    """Ends of the chunks of a document of ``n`` ids with marks ``at``: they depend on the ids near them alone, save for the length limits."""
    cuts, last = [], 0
    for m in [*at, n]:
        if m - last < LEAST and m < n:
            continue
        while m - last > MOST:
            last += MOST
            cuts.append(last)
        if m == n or m - last >= LEAST:
            if m > last:
                cuts.append(m)
            last = m
    return cuts


def _tie(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, rows_per_shard: int = 20_000) -> str | None:
    """Encode ``docs`` (doc_id, text) with the word-end vocabulary ``tokenizer``, append ``end_id`` to each and write the store.

    A null text is empty: its one id is the end id. Rows that repeat a doc_id are documents of their own, in the order of a
    hash of their text; identical rows follow one another. A null doc_id comes first. Columns other than the two are ignored. An empty table writes an empty store.
    Returns the root of the whole, None if there are no documents.
    Ids travel once, dealt by digest; a chunk that many documents share sends its ids from each task once.
    """
    spark = docs.sparkSession
    small_batches(spark)

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(tokenizer)
        width = np.dtype(encoder.dtype).itemsize
        sent: set[bytes] = set()
        for batch in batches:
            out: list[tuple] = []
            end_mark = np.asarray([end_id], encoder.dtype).tobytes()
            texts = batch.column(1).to_pylist()
            streams = [encoder.encode(text) + end_mark for text in texts]
            starts = np.cumsum([0] + [len(x) // width for x in streams])
            found = marks(np.frombuffer(b"".join(streams), encoder.dtype))
            bounds = np.searchsorted(found, starts, side="right").tolist()
            for doc, text, raw, start, lo, hi in zip(batch.column(0).to_pylist(), texts, streams, starts.tolist(), bounds[:-1], bounds[1:], strict=False):
                tie, at, n = _tie(text or ""), 0, len(raw) // width
                for seq, end in enumerate(cut_points(n, (found[lo:hi] - start).tolist())):
                    payload = raw[at * width : end * width]
                    digest = hashlib.blake2b(payload, digest_size=16).digest()
                    fresh = digest not in sent
                    if fresh:
                        if len(sent) >= 200_000:
                            sent.clear()
                        sent.add(digest)
                    out.append((doc, tie, seq, n - end, end - at, digest, payload if fresh else None))
                    at = end
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "tie", "seq", "after", "n", "digest", "payload"])

    schema = "doc_id long, tie long, seq int, after long, n int, digest binary, payload binary"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(chunked, schema)

    # Copies of a chunk without ids go anywhere; those with ids meet, at most one from each task and memo.
    with_ids = rows.withColumn("deal", F.when(F.col("payload").isNull(), F.xxhash64("doc_id", "tie", "seq")).otherwise(F.xxhash64("digest")))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = W.Window.partitionBy("deal", "digest").orderBy(F.col("payload").isNull())
    (
        with_ids.repartition(n, "deal")
        .withColumn("payload", F.when(F.row_number().over(met) == 1, F.col("payload"))).drop("deal")
        .write.option("compression", "zstd").option("parquet.enable.dictionary#payload", "false").option("parquet.enable.dictionary#digest", "false").parquet(f"{path}/chunks")
    )
    _write_recipes(spark, path, rows_per_shard)
    found = spark.read.parquet(f"{path}/whole").select("root").first()
    return found and found["root"]


def merkle(leaves: Column) -> Column:
    """The root of a binary tree over an array of hashes in order: a node hashes two, and one left over goes up as it is."""
    def joined(a: Column) -> Column:
        at = F.sequence(F.lit(0), F.floor((F.size(a) - 1) / 2).cast("int"))
        return F.transform(at, lambda i: F.when(2 * i + 1 < F.size(a), F.sha2(F.concat(F.lit("n"), F.get(a, 2 * i), F.get(a, 2 * i + 1)), 256)).otherwise(F.get(a, 2 * i)))

    levels = F.sequence(F.lit(1), F.ceil(F.log2(F.size(leaves))).cast("int"))
    return F.get(F.when(F.size(leaves) > 1, F.aggregate(levels, leaves, lambda a, _: joined(a))).otherwise(leaves), 0)


def _with_root(recipes: DataFrame, name: str) -> DataFrame:
    """``recipes`` with a document's root: over its chunks, each with its place, its length and the ids after it, and over what else its recipe says."""
    leaves = F.transform("chunks", lambda c, k: F.sha2(F.concat_ws("|", F.lit("c"), k, c["n"], c["after"], F.hex(c["digest"])), 256))
    root = F.sha2(F.concat_ws("|", F.lit("d"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "tie", "before", "n_tokens", F.size("chunks"), merkle(F.col("leaves"))), 256)
    return recipes.withColumn("leaves", leaves).withColumn(name, root).drop("leaves")


def _rooted(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys, root: of each group's column root in the order of ``order``, numbers from 0 or 1 on."""
    ordered = lambda by: merkle(F.transform(F.sort_array(F.collect_list(F.struct(by, "root"))), lambda r: r["root"])).alias("root")
    runs = rows.withColumn("run", F.floor(F.col(order) / RUN_OF_ROOTS)).groupBy(*keys, "run").agg(ordered(order))
    return runs.groupBy(*keys).agg(ordered("run"))


def _whole(manifest: DataFrame) -> dict:
    """n_shards, n_docs, n_tokens and root over the rows of a manifest."""
    leaf = F.sha2(F.concat_ws("|", F.lit("s"), "shard", "start", "n_docs", "n_tokens", "root"), 256)
    sums = manifest.agg(F.count("*").alias("n_shards"), F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).first()
    return sums.asDict() | _rooted(manifest.select("shard", leaf.alias("root")), [], "shard").first().asDict()


def _write_recipes(spark: SparkSession, path: str, rows_per_shard: int) -> None:
    chunks = spark.read.parquet(f"{path}/chunks")
    # Rows of a doc_id and text that repeat have the same chunks; they are told apart by how often each comes.
    listed = (
        chunks.groupBy("doc_id", "tie", "seq", "digest", "n", "after").agg(F.count("*").alias("copies"))
        .groupBy("doc_id", "tie").agg(F.sort_array(F.collect_list(F.struct("seq", "digest", "n", "after"))).alias("chunks"), F.max("copies").alias("copies"))
        .select("doc_id", "tie", F.transform("chunks", lambda c: F.struct(c["digest"].alias("digest"), c["n"].alias("n"), c["after"].alias("after"))).alias("chunks"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
        .withColumn("n_tokens", F.get("chunks", 0)["n"] + F.get("chunks", 0)["after"])
    )
    in_order = W.Window.partitionBy("shard").orderBy(F.col("doc_id").asc_nulls_first(), "tie", "copy")
    firsts = chunks.where("seq = 0").select("doc_id")  # one of each document, whose last id at least is in a chunk
    placed = with_shards(listed, "doc_id", rows_per_shard, firsts)[0].withColumns({"pos": F.row_number().over(in_order), "before": F.coalesce(F.sum("n_tokens").over(in_order.rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0).cast("long"))})
    _with_root(placed, "root").drop("copy").write.option("compression", "zstd").partitionBy("shard").parquet(f"{path}/recipes")
    if not listed_any(spark, path):
        spark.createDataFrame([], "shard long, start long, n_docs long, n_tokens long, root string").write.parquet(f"{path}/manifest")
        spark.createDataFrame([], WHOLE).write.parquet(f"{path}/whole")
        return
    recipes = spark.read.parquet(f"{path}/recipes").select(F.col("shard").cast("long").alias("shard"), "pos", "n_tokens", "root")
    totals = recipes.groupBy("shard").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).join(_rooted(recipes, ["shard"], "pos"), "shard")
    # A row a shard: the running sum over them is small work for one task.
    totals.withColumn("start", F.coalesce(F.sum("n_tokens").over(W.Window.orderBy("shard").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0).cast("long"))).write.parquet(f"{path}/manifest")
    spark.createDataFrame([_whole(spark.read.parquet(f"{path}/manifest"))], WHOLE).write.parquet(f"{path}/whole")


def listed_any(spark: SparkSession, path: str) -> bool:
    """Whether the store has any document."""
    return bool(spark.read.parquet(f"{path}/chunks").take(1))


def crc_shift(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """CRC-32 values as they count once ``n_bytes`` more bytes follow: times x to the 8 n, modulo the polynomial."""
    out, left = crc.astype(np.uint32), n_bytes.astype(np.int64)
    for k in range(int(left.max()).bit_length() if left.size else 0):
        use = np.flatnonzero(left >> k & 1)
        c, t = out[use], _byte_shift(k)
        out[use] = t[0][c & 255] ^ t[1][c >> 8 & 255] ^ t[2][c >> 16 & 255] ^ t[3][c >> 24]
    return out


@lru_cache(maxsize=None)
def _byte_shift(k: int) -> np.ndarray:
    """For each of the four bytes of a checksum, what its values become when 2 to the ``k`` bytes follow."""
    power = np.uint32(1 << 30)  # x
    for _ in range(k + 3):
        power = _times(np.array([power], np.uint32), power)[0]
    return np.stack([_times(np.arange(256, dtype=np.uint32) << np.uint32(8 * b), power) for b in range(4)])


def _times(a: np.ndarray, b: np.uint32) -> np.ndarray:
    """Products of reflected polynomials over GF(2), modulo the CRC polynomial."""
    total, a = np.zeros_like(a), a.copy()
    for k in range(31, -1, -1):
        if int(b) >> k & 1:
            total ^= a
        a = (a >> np.uint32(1)) ^ np.where(a & np.uint32(1), np.uint32(CRC_POLYNOMIAL), np.uint32(0)).astype(np.uint32)
    return total


def _sound_shards(spark: SparkSession, path: str, root: str | None) -> DataFrame:
    """shard, start, sound: whether the shard's recipes have the manifest's root and sums, and the manifest that of the whole and, if given, ``root``."""
    manifest = spark.read.parquet(f"{path}/manifest")
    recipes = spark.read.parquet(f"{path}/recipes").select(F.col("shard").cast("long").alias("shard"), "pos", "n_tokens", "root")
    now = recipes.groupBy("shard").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens")).join(_rooted(recipes, ["shard"], "pos").withColumnRenamed("root", "now"), "shard")
    said = spark.read.parquet(f"{path}/whole").collect()  # one row
    whole = len(said) == 1 and said[0].asDict() == _whole(manifest) and root in (None, said[0]["root"]) and not manifest.join(now, "shard", "left_anti").take(1)
    same = (F.col("root") == F.col("now")) & (F.col("n_docs") == F.col("docs")) & (F.col("n_tokens") == F.col("tokens"))
    return now.join(manifest, "shard", "left").select("shard", F.coalesce("start", F.lit(0).cast("long")).alias("shard_start"), (F.coalesce(same, F.lit(False)) & F.lit(whole)).alias("shard_sound"))


def read_back(spark: SparkSession, path: str, width: int = 2, root: str | None = None) -> DataFrame:
    """Read every chunk and recipe of a store: doc_id, start, n_tokens, ids_crc32 of the ids as 32-bit integers, verified.

    Each stored chunk is read in whole and its digest recomputed; ids_crc32 combines the chunks' checksums in the recipe's order.
    ``verified`` is false where a chunk is missing, altered or of another length; where a recipe does not have its root (reordered, cut, lengthened, changed); for all
    documents of a shard whose recipes do not have the manifest's root or sums (a recipe with a new root, a lost or added document); and for all documents if the manifest
    has not the root of the whole, lists a shard that is gone, or the whole has not ``root``, which ``write_store`` returned. ``width``: bytes a stored id. An empty store gives no rows.
    """
    small_batches(spark)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = batch.column("payload").to_pylist()
            ids = [np.frombuffer(p, f"<u{width}").astype("<u4") if len(p) % width == 0 else np.zeros(0, "<u4") for p in payloads]
            yield pa.RecordBatch.from_arrays([
                batch.column("digest"), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array([len(x) for x in ids], pa.int32()),
                pa.array([hashlib.blake2b(p, digest_size=16).digest() == d for p, d in zip(payloads, batch.column("digest").to_pylist(), strict=True)]),
            ], names=["digest", "crc", "stored", "sound"])

    if not listed_any(spark, path):
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long, verified boolean")
    chunks = spark.read.schema("digest binary, payload binary").parquet(f"{path}/chunks")
    stored = chunks.where(F.col("payload").isNotNull()).mapInArrow(summed, "digest binary, crc long, stored int, sound boolean").groupBy("digest").agg(F.min("crc").alias("crc"), F.min("stored").alias("stored"), F.min("sound").alias("sound"))
    recipes = spark.read.parquet(f"{path}/recipes").withColumn("shard", F.col("shard").cast("long")).join(_sound_shards(spark, path, root), "shard")
    # once a document: an expression beside explode would be computed for every chunk
    recipes = _with_root(recipes, "now").withColumn("whole", F.col("shard_sound") & (F.col("now") == F.col("root")))
    parts = recipes.select("doc_id", (F.col("shard_start") + F.col("before")).alias("start"), "shard", "pos", "n_tokens", "whole", F.explode_outer("chunks").alias("c")).select("doc_id", "start", "shard", "pos", "n_tokens", "whole", "c.*")

    def shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = batch.column("crc").to_numpy(zero_copy_only=False).astype(np.uint32)
            after = batch.column("after").to_numpy(zero_copy_only=False) * 4
            yield batch.set_column(batch.schema.get_field_index("crc"), "crc", pa.array(crc_shift(crc, after).astype(np.int64)))

    sound = F.col("whole") & F.coalesce(F.col("sound") & (F.col("stored") == F.col("n")), F.lit(False))
    found = parts.join(stored, "digest", "left").select("shard", "pos", "doc_id", "start", "n_tokens", F.coalesce("after", F.lit(0).cast("long")).alias("after"), F.coalesce("crc", F.lit(0).cast("long")).alias("crc"), sound.alias("sound"))
    return (
        found.mapInArrow(shifted, found.schema)
        .groupBy("shard", "pos", "doc_id", "start", "n_tokens").agg(F.bit_xor("crc").alias("ids_crc32"), F.bool_and("sound").alias("verified")).drop("shard", "pos")
    )


def read_ids(spark: SparkSession, path: str, doc_ids: DataFrame | None = None) -> DataFrame:
    """Rebuild documents from recipes and chunks: doc_id, start and the ids as stored bytes. ``doc_ids`` keeps to those documents."""
    recipes = spark.read.parquet(f"{path}/recipes").withColumn("shard", F.col("shard").cast("long")).join(spark.read.parquet(f"{path}/manifest").select("shard", F.col("start").alias("shard_start")), "shard")
    if doc_ids is not None:
        recipes = recipes.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
    parts = recipes.select("shard", "pos", "doc_id", (F.col("shard_start") + F.col("before")).alias("start"), F.posexplode("chunks").alias("seq", "c")).select("shard", "pos", "doc_id", "start", "seq", "c.digest")
    stored = spark.read.parquet(f"{path}/chunks").where(F.col("payload").isNotNull()).select("digest", "payload").dropDuplicates(["digest"])
    return parts.join(stored, "digest").groupBy("shard", "pos", "doc_id", "start").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", F.hex("payload").alias("h")))), lambda c: c["h"]), "").alias("h")).select("doc_id", "start", F.unhex("h").alias("ids"))
