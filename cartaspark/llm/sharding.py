"""A table of immutable shards with size-tiered compaction and a versioned manifest.

* ``append`` writes arriving rows as one *run*, a folder of small immutable shards, and commits a
  manifest that lists it.  The arrival is read once, by as many tasks as its plan has.  The bytes that
  were written, not the number of those tasks, set how many shards it gets: one for each
  ``target_bytes / fanout``.  Only where the tasks left more, or left some above the target, the shards
  are packed once more, without a shuffle, before the run is committed.
* ``compact`` puts runs into tiers of similar size (a factor of ``fanout`` wide).  A tier with at least
  ``fanout`` runs is merged: one Spark job reads their shards and packs them, without a shuffle, into
  shards of about ``target_bytes``, which are one run again.  Runs whose shards have reached half the
  target on average are never rewritten, so a row is written about log_fanout(target / arrival) times.
  A merge that does not lower the number of shards is thrown away, so compaction always ends.
* A commit writes ``manifest/<version>.json`` under a temporary name and renames it without
  overwriting; of two writers of one version one fails and tries again on top of the other's.  That
  rename is atomic on HDFS and local disks; on object stores whose rename is a copy only one writer at a
  time is safe.  Any number of writers may append; of compactions only one may run, and one whose runs
  another has merged meanwhile gives up its own.  The manifest has one entry for each run, however many
  shards and rows that holds.
* Readers use the newest manifest.  Runs that the newest ``keep_versions`` manifests do not name any
  more are deleted by the commit that retires them; ``vacuum`` also deletes what failed jobs left.

A job that loses executors is retried by Spark; one that fails leaves a folder that no manifest names.
Row counts before and after a merge must agree or nothing is committed.  Any columns and nulls are
kept as they are; repeated rows are kept; an empty append commits a version without a new run.
"""

from __future__ import annotations

import json
import math
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from .shared import hadoop_fs


class CommitConflict(RuntimeError):
    """Another writer has committed this version."""


class ShardedTable:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 256 << 20, fanout: int = 4, first_tier_bytes: int = 1 << 20, keep_versions: int = 2, tries: int = 100):
        self.spark, self.root, self.target, self.fanout, self.first, self.keep, self.tries = spark, root.rstrip("/"), target_bytes, fanout, first_tier_bytes, max(1, keep_versions), tries

    # manifest

    def _versions(self) -> list[int]:
        fs, at = hadoop_fs(self.spark, f"{self.root}/manifest")
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def version(self) -> int:
        """The newest committed version; 0 if there is none."""
        return max(self._versions(), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, or the newest."""
        for _ in range(self.tries):
            wanted = self.version() if version is None else version
            found = self._manifest(wanted)
            if found:
                return found
            if version is not None:
                break
        raise ValueError(f"no version {wanted}")

    def _manifest(self, version: int) -> dict | None:
        """The manifest of a version; None if it is not there, as another writer may have retired it."""
        if not version:
            return {"version": 0, "schema": None, "runs": []}
        fs, at = hadoop_fs(self.spark, f"{self.root}/manifest/{version:010d}.json")
        try:
            stream = fs.open(at)
        except Py4JJavaError as error:
            if "FileNotFound" in str(error.java_exception):
                return None
            raise
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, schema: str | None, add: list[dict], remove: set[str] = frozenset()) -> dict | None:
        """Commit a change on top of the newest version, again if another writer was first; None if a run to remove has gone."""
        for _ in range(self.tries):
            base = self.manifest()
            if not remove <= {r["run"] for r in base["runs"]}:
                return None
            try:
                return self._commit(base["version"], schema or base["schema"], [*(r for r in base["runs"] if r["run"] not in remove), *add])
            except CommitConflict:
                continue
        raise CommitConflict(f"{self.tries} tries, and always another writer was first")

    def _commit(self, base: int, schema: str, runs: list[dict]) -> dict:
        made = {"version": base + 1, "schema": schema, "runs": sorted(runs, key=lambda r: r["run"])}
        jvm = self.spark.sparkContext._jvm
        fs, temporary = hadoop_fs(self.spark, f"{self.root}/manifest/.{uuid.uuid4().hex}.tmp")
        stream = fs.create(temporary, False)
        stream.write(bytearray(json.dumps(made).encode()))
        stream.close()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest/{base + 1:010d}.json")
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(temporary, path, how)
        except Exception as error:
            fs.delete(temporary, False)
            if "FileAlreadyExists" in str(error):
                raise CommitConflict(f"version {base + 1} exists") from error
            raise
        self._retire(made["version"])
        return made

    def _retire(self, newest: int) -> None:
        """Delete manifests older than the newest `keep_versions` and the runs that only they name."""
        versions = [v for v in self._versions() if v <= newest]
        old, live = versions[: -self.keep], versions[-self.keep :]
        kept, past = [self._manifest(v) for v in live], [self._manifest(v) for v in old]
        if not old or not all(kept):  # a later writer is already at it
            return
        named = {r["run"] for m in kept for r in m["runs"]}
        for version, manifest in zip(old, past, strict=True):
            gone = [r["run"] for r in manifest["runs"] if r["run"] not in named] if manifest else []
            for path in (*(f"data/{run}" for run in gone), f"manifest/{version:010d}.json"):
                fs, at = hadoop_fs(self.spark, f"{self.root}/{path}")
                fs.delete(at, True)

    # writing

    def _write(self, df: DataFrame) -> dict | None:
        """Write one run and return its entry; None, and no folder, without rows."""
        run = uuid.uuid4().hex
        folder = f"{self.root}/data/{run}"
        df.write.option("compression", "zstd").parquet(folder)
        fs, at = hadoop_fs(self.spark, folder)
        files, size, n = fs.listFiles(at, True), 0, 0
        while files.hasNext():
            one = files.next()
            if one.getPath().getName().endswith(".parquet"):
                size, n = size + one.getLen(), n + 1
        rows = self.spark.read.schema(df.schema).parquet(folder).count() if n else 0  # reads the footers alone
        if not rows:
            fs.delete(at, True)
            return None
        return {"run": run, "shards": n, "bytes": size, "rows": rows}

    def _drop(self, run: dict) -> None:
        fs, at = hadoop_fs(self.spark, f"{self.root}/data/{run['run']}")
        fs.delete(at, True)

    def append(self, df: DataFrame) -> dict:
        """Write arriving rows as a run of small shards and commit it."""
        schema = df.schema.json()
        run = self._write(df)
        if run:
            shards = math.ceil(run["bytes"] * self.fanout / self.target)
            if run["shards"] > shards or run["bytes"] > run["shards"] * self.target:
                staged, run = run, self._pack(schema, [run], max(1, self.target // self.fanout))
                self._drop(staged)
        return self._publish(schema, [run] if run else [])

    # compaction

    def tier(self, size: int) -> int:
        """0 up to the first tier's size; then one for each factor of `fanout`."""
        return 0 if size <= self.first else 1 + int(math.log(size / self.first, self.fanout))

    def plan(self, runs: list[dict]) -> list[list[dict]]:
        """Groups of runs to merge: full tiers of runs below the target whose shards would become fewer."""
        tiers: dict[int, list[dict]] = {}
        for run in runs:
            if run["bytes"] < run["shards"] * self.target // 2:
                tiers.setdefault(self.tier(run["bytes"]), []).append(run)
        full = [sorted(v, key=lambda r: r["run"]) for _, v in sorted(tiers.items()) if len(v) >= self.fanout]
        return [v for v in full if math.ceil(sum(r["bytes"] for r in v) / self.target) < sum(r["shards"] for r in v)]

    def compact_once(self) -> bool:
        """Merge every full tier once, a commit for each; False if no merge lowered the number of shards."""
        base, changed = self.manifest(), False
        for group in self.plan(base["runs"]):
            made = self._pack(base["schema"], group, self.target)
            if made["shards"] < sum(r["shards"] for r in group) and self._publish(None, [made], {r["run"] for r in group}):
                changed = True
            else:
                self._drop(made)
        return changed

    def _pack(self, schema: str, group: list[dict], shard_bytes: int) -> dict:
        """Read the shards of runs in splits of a size, each of which becomes one shard of a new run."""
        size, own = sum(r["bytes"] for r in group), self.spark.newSession()
        for key, value in (("maxPartitionBytes", shard_bytes), ("openCostInBytes", 0), ("minPartitionNum", max(1, size // shard_bytes))):
            own.conf.set(f"spark.sql.files.{key}", str(value))
        packed = own.read.schema(_schema(schema)).parquet(*[f"{self.root}/data/{r['run']}" for r in group])
        # never more tasks than shards of that size, whatever the session says about splits
        made = self._write(packed.coalesce(max(1, math.ceil(size / shard_bytes))))
        if (made["rows"] if made else 0) != sum(r["rows"] for r in group):
            raise RuntimeError("packing changed the number of rows")
        return made

    def compact(self) -> dict:
        """Merge until no tier is full; every round lowers the number of shards."""
        while self.compact_once():
            pass
        return self.manifest()

    def vacuum(self) -> int:
        """Delete data that no kept manifest names, such as what failed jobs left; returns how many folders.  Not while another writer is at work."""
        live = {r["run"] for v in self._versions() for r in self.manifest(v)["runs"]}
        fs, at = hadoop_fs(self.spark, f"{self.root}/data")
        if not fs.exists(at):
            return 0
        gone = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName() not in live]
        for path in gone:
            fs.delete(path, True)
        return len(gone)

    # reading

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version (the newest by default)."""
        at = self.manifest(version)
        if not at["schema"]:
            raise ValueError("nothing has been appended")
        schema = _schema(at["schema"])
        paths = [f"{self.root}/data/{r['run']}" for r in at["runs"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)


def _schema(text: str) -> StructType:
    return StructType.fromJson(json.loads(text))
