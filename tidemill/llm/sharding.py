"""Size-tiered sharding: small immutable shards, merged by size into target-sized files under a versioned manifest.

Layout below the store's folder: ``data/<run>/part-*.parquet`` and ``manifest/v<number>.json``.  A run is a folder of shards that one job
wrote; it never changes.  A version's manifest lists its runs, each with its number of files, bytes and rows: one entry for an arrival
or a merge, however many files it has.  A version becomes visible by one rename that fails if the number is taken (file
systems with an atomic rename are needed, HDFS say; on object stores without one, one writer at a time); a writer that loses
the race reads the newer version and tries again, and runs of a writer that dies are never listed.

Merging takes the runs whose shards are of one size tier (powers of ``fanout``), if they have ``fanout`` shards or a target's bytes, and rewrites them
as shards of about ``target`` bytes.  All tiers of a round are one Spark job: a task reads neighbouring shards whole and writes them as
one file, without a shuffle.  Tasks that are lost are run again by Spark; a failed merge leaves the old version in force; a
merge whose runs another writer has merged meanwhile is given up and planned anew.  The driver handles runs and versions, never file
names: Spark lists a run's folder, in parallel if there are many.

Rows are stored whole, with all columns, nulls, repeats and long texts; an empty append commits a version without new rows.  ``read`` adds the
columns ``shard``, ``shard_rows`` and ``shard_bytes``; columns of the table that have one of these names are read as ``<name>_``.
DataFrame operations and Hadoop's file system on the driver only.
"""

from __future__ import annotations

import json
import math
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .store import delete, filesystem

TARGET, FANOUT, SHARD_ROWS = 64 << 20, 4, 1024
SMALLEST = 65536.0  # bytes; smaller shards are of tier 0
FULL = 0.6  # of the target: runs whose shards have so much on average are not merged again
#: Up to so many shards their counts are broadcast to the rows (some 100 bytes a shard); beyond it rows and counts are shuffled by shard.
BROADCAST_SHARDS = 100_000
ADDED = ("shard", "shard_rows", "shard_bytes")


class ShardStore:
    def __init__(self, spark: SparkSession, path: str, target: int = TARGET, fanout: int = FANOUT, shard_rows: int = SHARD_ROWS):
        self.spark, self.path, self.target, self.fanout, self.shard_rows = spark, path.rstrip("/"), target, fanout, shard_rows

    # Manifest

    def version(self) -> int:
        """The newest committed version, 0 for a new store."""
        fs, folder = filesystem(self.spark, f"{self.path}/manifest")
        if not fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return max((int(x[1:-5]) for x in names if x.startswith("v") and x.endswith(".json")), default=0)

    def runs(self, version: int | None = None) -> list[dict]:
        """The runs of a version: ``run, files, bytes, rows``."""
        version = self.version() if version is None else version
        if not version:
            return []
        fs, p = filesystem(self.spark, f"{self.path}/manifest/v{version}.json")
        stream = fs.open(p)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["runs"]
        finally:
            stream.close()

    def _publish(self, number: int, runs: list[dict]) -> bool:
        """Make a version visible; False if its number is taken."""
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        fs, draft = filesystem(self.spark, f"{self.path}/manifest/draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps({"version": number, "runs": runs}).encode()))
        out.close()
        to = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest/v{number}.json")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(draft, to, gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception:
            fs.delete(draft, False)
            if fs.exists(to):
                return False
            raise
        return True

    def _commit(self, added: list[dict], gone: set[str] = frozenset()) -> int | None:
        """Add runs to the newest version and take others out, atomically; None if another writer took one of those out first."""
        while True:
            base = self.version()
            old = self.runs(base)
            if not gone <= {r["run"] for r in old}:
                return None
            if self._publish(base + 1, [r for r in old if r["run"] not in gone] + added):
                return base + 1

    def _folder(self, run: str) -> str:
        return f"{self.path}/data/{run}"

    def _rows(self, runs: list[dict], schema: StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[self._folder(r["run"]) for r in runs])

    def _written(self, run: str, schema: StructType) -> list[dict]:
        """The manifest's entry of a run that has been written; none if it has no rows."""
        content = filesystem(self.spark, self._folder(run))
        total = content[0].getContentSummary(content[1])
        rows = self.spark.read.schema(schema).parquet(self._folder(run)).count()  # from the footers
        files = total.getFileCount() - 1  # Spark's mark of success
        return [{"run": run, "files": files, "bytes": total.getLength(), "rows": rows}] if rows else []

    # Data

    def append(self, df: DataFrame) -> int:
        """Write an arrival as small shards and commit them."""
        run = uuid.uuid4().hex
        df.write.option("maxRecordsPerFile", self.shard_rows).option("compression", "zstd").parquet(self._folder(run))
        return self._commit(self._written(run, df.schema))

    def tier(self, run: dict) -> int:
        """By the mean size of its shards."""
        return max(0, math.floor(math.log(max(run["bytes"] / max(run["files"], 1), 1) / SMALLEST, self.fanout)))

    def plan(self) -> list[list[dict]]:
        """Groups of runs to merge, one for a tier."""
        tiers: dict[int, list[dict]] = {}
        for r in self.runs():
            if r["bytes"] < FULL * self.target * r["files"]:
                tiers.setdefault(self.tier(r), []).append(r)
        groups = []
        for _, own in sorted(tiers.items()):
            files, held = sum(r["files"] for r in own), sum(r["bytes"] for r in own)
            if files > math.ceil(held / self.target) and (files >= self.fanout or held >= self.target):
                groups.append(own)
        return groups

    def merged(self, group: list[dict], schema: StructType) -> DataFrame:
        """The rows of a group, in as many partitions as shards are wanted: each holds whole input shards or parts of them."""
        shards = math.ceil(sum(r["bytes"] for r in group) / self.target)
        return self._rows(group, schema).coalesce(shards)

    def compact(self, schema: StructType) -> int:
        """Merge until no tier has enough; returns the version."""
        while groups := self.plan():
            run, every = uuid.uuid4().hex, [r for g in groups for r in g]
            # A partition that Spark made larger than a shard is cut by rows.
            most = math.ceil(1.25 * self.target * sum(r["rows"] for r in every) / sum(r["bytes"] for r in every))
            rows = reduce(DataFrame.unionByName, [self.merged(g, schema) for g in groups])
            rows.write.option("maxRecordsPerFile", most).option("compression", "zstd").parquet(self._folder(run))
            new = self._written(run, schema)
            fewer = sum(r["files"] for r in new) < sum(r["files"] for r in every)
            if not fewer or self._commit(new, {r["run"] for r in every}) is None:
                delete(self.spark, self._folder(run))
                if not fewer:  # what there is cannot be packed any better
                    break
        return self.version()

    def vacuum(self) -> None:
        """Delete runs that the newest version does not list."""
        fs, folder = filesystem(self.spark, f"{self.path}/data")
        if not fs.exists(folder):
            return
        live = {r["run"] for r in self.runs()}
        for s in fs.listStatus(folder):
            if s.getPath().getName() not in live:
                fs.delete(s.getPath(), True)

    def read(self, schema: StructType, version: int | None = None) -> DataFrame:
        """The rows of a version, with each one's ``shard``, ``shard_rows`` and ``shard_bytes``."""
        runs = self.runs(version)
        named = [F.col(f"`{f.name}`").alias(f"{f.name}_" if f.name in ADDED else f.name) for f in schema]
        if not runs:
            empty = self.spark.createDataFrame([], schema)
            return empty.select(*named, F.lit("").alias("shard"), F.lit(0).cast("long").alias("shard_rows"), F.lit(0).cast("long").alias("shard_bytes"))
        file = F.substring_index("_metadata.file_path", "/", -1)
        rows = self._rows(runs, schema)
        counted = rows.select(file.alias("__file")).groupBy("__file").agg(F.count("*").alias("shard_rows"))
        if sum(r["files"] for r in runs) <= BROADCAST_SHARDS:
            counted = F.broadcast(counted)
        held = rows.select(*named, file.alias("__file"), F.col("_metadata.file_size").alias("shard_bytes"))
        shards = ["shard", "shard_rows", "shard_bytes"]
        return held.join(counted, "__file").withColumnRenamed("__file", "shard").select(*[c for c in held.columns if c not in ("__file", "shard_bytes")], *shards)
