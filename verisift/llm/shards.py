"""Versioned shards with size-tiered compaction."""

from __future__ import annotations

import json
import math
import uuid

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _fs, scratch, table

TARGET_BYTES = 64 << 20
#: Shards of sizes within this factor are of one tier; so many of them, or half a target file, are merged.
FAN_IN = 4
#: The smallest tier holds all shards up to this size.
LEAST_BYTES = 1 << 20
ROW_GROUP_BYTES = 32 << 20
ARRIVALS = 8

_MERGED = "gid long, path string, rows long, bytes long"


class Conflict(RuntimeError):
    """Another writer removed a shard that this commit was to replace."""


class ShardStore:
    """A table of immutable Parquet shards below root. What belongs to it is what its newest manifest lists.

    root/data holds shards, root/manifests one JSON file for each version. A manifest is written under another name
    and renamed without overwriting: of two writers of a version one fails, reads the newer manifest and tries the
    next version. Readers keep the version that they have read, until vacuum() drops what old versions list alone.
    """

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN, least_bytes: int = LEAST_BYTES):
        self.spark, self.root = spark, root.rstrip("/")
        self.target_bytes, self.fan_in, self.least_bytes = target_bytes, fan_in, least_bytes

    def _ls(self, path: str, deep: bool = False) -> list[tuple[str, int]]:
        fs, p = _fs(self.spark, path)
        if not fs.exists(p):
            return []
        top, found = fs.makeQualified(p).toString().rstrip("/"), []
        files = fs.listFiles(p, deep)
        while files.hasNext():
            f = files.next()
            found.append((f.getPath().toString()[len(top) + 1 :], f.getLen()))
        return found

    def versions(self) -> list[int]:
        return sorted(int(n[1:-5]) for n, _ in self._ls(f"{self.root}/manifests") if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """The newest manifest, or that of a version; an empty one before the first commit."""
        known = self.versions()
        if version is None and not known:
            return {"version": 0, "schema": None, "shards": []}
        text = self.spark.read.text(f"{self.root}/manifests/v{known[-1] if version is None else version:010d}.json", wholetext=True)
        return json.loads(text.first()[0])

    def commit(self, add: list[dict], remove: list[str] = (), schema: str | None = None) -> int:
        """Atomically adds and removes shards; returns the new version. Raises Conflict if one to remove is gone."""
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        while True:
            old = self.manifest()
            gone = set(remove)
            if not gone <= {s["path"] for s in old["shards"]}:
                raise Conflict("a shard to be replaced is no longer in the manifest")
            shards = [s for s in old["shards"] if s["path"] not in gone] + add
            new = {"version": old["version"] + 1, "schema": schema or old["schema"], "shards": shards}
            fs, temp = _fs(self.spark, f"{self.root}/manifests/.{uuid.uuid4().hex}")
            out = fs.create(temp, True)
            out.write(bytearray(json.dumps(new).encode()))
            out.close()
            final = jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifests/v{new['version']:010d}.json")
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(temp.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
            try:
                context.rename(fs.makeQualified(temp), fs.makeQualified(final), gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
            except Exception as e:
                fs.delete(temp, False)
                if "FileAlreadyExists" not in str(e):
                    raise
                continue
            return new["version"]

    def append(self, df: DataFrame, arrival=None) -> list[int]:
        """Writes df as small shards and commits them; with arrival, a column of integers, one commit for each value.

        Shards are what the tasks of df write: nothing is shuffled.
        """
        name = f"data/{uuid.uuid4().hex}"
        schema = df.schema.json()
        if arrival is not None:
            df = df.withColumn("__arrival", arrival)
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy("__arrival") if arrival is not None else writer).parquet(f"{self.root}/{name}")
        batches: dict[str, list] = {}
        for path, size in sorted(self._ls(f"{self.root}/{name}", deep=True)):
            if path.endswith(".parquet"):
                batches.setdefault(path.rpartition("/")[0], []).append({"path": f"{name}/{path}", "bytes": size})
        return [self.commit(shards, schema=schema) for _, shards in sorted(batches.items())] or [self.commit([], schema=schema)]

    def tier(self, size: int) -> int:
        return max(0, math.floor(math.log(max(size, 1) / self.least_bytes, self.fan_in)) + 1)

    def plan(self) -> list[list[dict]]:
        """Runs of shards of one tier, in order of arrival, to be merged into a file each."""
        tiers: dict[int, list[dict]] = {}
        for s in self.manifest()["shards"]:
            if s["bytes"] < self.target_bytes / 2:
                tiers.setdefault(self.tier(s["bytes"]), []).append(s)
        runs = []
        for _, shards in sorted(tiers.items()):
            run, size = [], 0
            for s in [*shards, None]:
                if s is None or size + s["bytes"] > self.target_bytes:
                    if len(run) >= self.fan_in or len(run) > 1 and size >= self.target_bytes / 2:
                        runs.append(run)
                    run, size = [], 0
                if s is not None:
                    run.append(s)
                    size += s["bytes"]
        return runs

    def compact(self) -> int:
        """Merges until no tier has a run left; returns the number of shards replaced.

        Every run is a task that streams row groups from its shards into a new file; runs hold a target file at
        most. The file has a name of the task's attempt, and only what the commit lists counts.
        """
        replaced = 0
        while runs := self.plan():
            root = self.root

            def merge(batches):
                filesystem, base = pafs.FileSystem.from_uri(root)
                for batch in batches:
                    for gid, paths in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                        name = f"data/{uuid.uuid4().hex}.parquet"
                        yield _merged(filesystem, base, gid, paths, name)

            groups = self.spark.createDataFrame([(i, [s["path"] for s in run]) for i, run in enumerate(runs)], "gid long, paths array<string>")
            done = groups.repartitionByRange(len(runs), "gid").mapInArrow(merge, _MERGED).collect()  # a row for each new file
            self.commit([{"path": r["path"], "bytes": r["bytes"], "rows": r["rows"]} for r in sorted(done)], [s["path"] for run in runs for s in run])
            replaced += sum(map(len, runs))
        return replaced

    def read(self, version: int | None = None) -> DataFrame:
        from pyspark.sql.types import StructType

        m = self.manifest(version)
        if m["schema"] is None:
            raise FileNotFoundError(f"{self.root} has no manifest")
        schema = StructType.fromJson(json.loads(m["schema"]))
        if not m["shards"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{s['path']}" for s in m["shards"]])

    def vacuum(self) -> int:
        """Deletes data files that the newest manifest does not list; for times when no one reads older versions."""
        keep = {s["path"] for s in self.manifest()["shards"]}
        gone = 0
        for path, _ in self._ls(f"{self.root}/data", deep=True):
            if path.endswith(".parquet") and f"data/{path}" not in keep:
                fs, p = _fs(self.spark, f"{self.root}/data/{path}")
                gone += bool(fs.delete(p, False))
        return gone


def _merged(filesystem, base: str, gid: int, paths: list[str], name: str) -> pa.RecordBatch:
    writer, held, size, rows = None, [], 0, 0

    def flush():
        nonlocal held, size
        if held:
            writer.write_table(pa.Table.from_batches(held), row_group_size=1 << 30)
        held, size = [], 0

    with filesystem.open_output_stream(f"{base}/{name}") as out:
        for path in paths:
            with filesystem.open_input_file(f"{base}/{path}") as f:
                shard = pq.ParquetFile(f)
                for batch in shard.iter_batches(1024):
                    if writer is None:
                        writer = pq.ParquetWriter(out, batch.schema, compression="zstd")
                    held.append(batch)
                    size, rows = size + batch.nbytes, rows + batch.num_rows
                    if size >= ROW_GROUP_BYTES:
                        flush()
                if writer is None:  # only empty shards so far
                    writer = pq.ParquetWriter(out, shard.schema_arrow, compression="zstd")
        flush()
        writer.close()
        length = out.tell()
    return pa.RecordBatch.from_arrays([pa.array([gid], pa.int64()), pa.array([name]), pa.array([rows], pa.int64()), pa.array([length], pa.int64())], names=["gid", "path", "rows", "bytes"])


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents through the store: appended in ARRIVALS arrivals, compacted, and read back."""
    docs = table(spark, sf_dir, "documents")
    store = ShardStore(spark, scratch(spark, "shards"))
    store.append(docs, F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS)))
    store.compact()
    store.vacuum()
    return store.read().select("doc_id", "lang", "source", "n_chars", F.octet_length("text").alias("n_bytes"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


SQL = "SELECT doc_id, lang, source, n_chars, strlen(text) AS n_bytes, md5(text) AS text_md5 FROM documents"
