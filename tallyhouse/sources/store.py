"""Tables that stay between batches: Parquet in buckets of a key, and a manifest that names the folders which count.

A batch writes the buckets of its own keys only, into a folder of its own, and then puts a new manifest in place by one
rename; whoever reads follows one manifest and so sees all of a batch or nothing of it. Buckets in which nothing has
changed keep their files, and a batch that comes again under its name is passed over. There is one writer at a time.
"""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folders that a bucket which only grows may have before it is written anew as one; names of batches that a manifest remembers.
MOST_FOLDERS, MOST_NAMES = 8, 1000


class Change(NamedTuple):
    """New rows of a table's buckets by ``keys``: those of ``buckets`` are replaced, or ``rows`` are added where this is None."""

    rows: DataFrame
    keys: list[str]
    buckets: list[int] | None = None


class Store:
    """Tables below ``path``; a table has ``buckets`` buckets for ever, so that a bucket of the largest still fits a few tasks."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _files(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _listed(self, path: str) -> list[str]:
        place, files = self._files(path)
        return [f.getPath().getName() for f in files.listStatus(place)] if files.exists(place) else []

    def manifest(self) -> dict:
        """Of each table its schema and, by bucket, the folders and what their rows add up to; the number and names of the batches so far."""
        found = sorted(n for n in self._listed(f"{self.path}/manifest") if n.endswith(".json") and not n.startswith((".", "_")))
        if not found:
            return {"number": 0, "names": [], "tables": {}}
        place, files = self._files(f"{self.path}/manifest/{found[-1]}")
        stream = files.open(place)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _put(self, manifest: dict) -> None:
        draft, files = self._files(f"{self.path}/manifest/.{uuid.uuid4().hex}")
        place, _ = self._files(f"{self.path}/manifest/{manifest['number']:09d}.json")
        stream = files.create(draft, False)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        if files.exists(place) or not files.rename(draft, place):
            files.delete(draft, False)
            raise RuntimeError(f"another writer has made batch {manifest['number']}")

    def bucket(self, keys: list[str]) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame, keys: list[str]) -> list[int]:
        """The buckets that ``rows`` have keys in; as many as there are buckets at most."""
        return sorted(r[0] for r in rows.select(self.bucket(keys)).distinct().collect())

    def read(self, table: str, buckets: list[int] | None = None) -> DataFrame | None:
        """A table as the newest manifest has it, or some of its buckets; None if nothing was ever written to it."""
        found = self.manifest()["tables"].get(table)
        if not found:
            return None
        schema = T.StructType.fromJson(found["schema"])
        wanted = found["buckets"] if buckets is None else {str(b): found["buckets"].get(str(b), {}) for b in buckets}
        paths = [f"{self.path}/{table}/{folder}/bucket={b}" for b, x in wanted.items() for folder in x.get("folders", [])]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _written(self, table: str, rows: DataFrame, keys: list[str]) -> tuple[str, dict[str, list]]:
        """The folder that ``rows`` went to, and of each bucket how many there are and what their hashes add up to."""
        folder, columns = uuid.uuid4().hex, rows.columns
        dealt = rows.withColumn("bucket", self.bucket(keys)).hint("rebalance", "bucket")
        dealt.write.partitionBy("bucket").parquet(f"{self.path}/{table}/{folder}")
        whole = T.StructType([*rows.schema.fields, T.StructField("bucket", T.IntegerType())])
        h = F.xxhash64(*columns)
        sums = self.spark.read.schema(whole).parquet(f"{self.path}/{table}/{folder}").groupBy("bucket").agg(F.count("*"), F.sum(h.cast("decimal(38,0)")).cast("string"), F.bit_xor(h))
        return folder, {str(r[0]): list(r)[1:] for r in sums.collect()}  # a row a bucket

    def commit(self, name: str, changes: dict[str, Change]) -> bool:
        """Make all ``changes`` at once; False, and nothing is done, if a batch of this name was made before."""
        manifest = self.manifest()
        if name in manifest["names"]:
            return False
        for table, change in changes.items():
            now = manifest["tables"].setdefault(table, {"schema": json.loads(change.rows.schema.json()), "buckets": {}})["buckets"]
            rows, replaced = change.rows, change.buckets
            if replaced is None:
                replaced = [int(b) for b, x in now.items() if len(x["folders"]) >= MOST_FOLDERS]
                if replaced := [b for b in self.touched(rows, change.keys) if b in replaced]:
                    rows = rows.unionByName(self.read(table, replaced))
            folder, sums = self._written(table, rows, change.keys)
            for b in {*map(str, replaced), *sums}:
                old, found = now.get(b), sums.get(b)
                if int(b) not in replaced and old:
                    now[b] = {"folders": [*old["folders"], folder], "sums": None}
                elif not old or not old["sums"] or old["sums"] != found:
                    now[b] = {"folders": [folder] if found else [], "sums": found}
        self._put({"number": manifest["number"] + 1, "names": [*manifest["names"], name][-MOST_NAMES:], "tables": manifest["tables"]})
        return True

    def vacuum(self) -> int:
        """Delete the folders that the newest manifest does not name, and say how many; not while readers of older ones are at work."""
        gone = 0
        for table, x in self.manifest()["tables"].items():
            named = {(f, int(b)) for b, y in x["buckets"].items() for f in y["folders"]}
            for folder in self._listed(f"{self.path}/{table}"):
                for part in self._listed(f"{self.path}/{table}/{folder}"):
                    if part.startswith("bucket=") and (folder, int(part[7:])) not in named:
                        place, files = self._files(f"{self.path}/{table}/{folder}/{part}")
                        files.delete(place, True)
                        gone += 1
        return gone
