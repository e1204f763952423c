"""Operator 8 [native]. Sharding by size-tiered compaction: DataFrame writes and reads only.

A store is a folder of immutable Parquet shards and of manifests ``manifest-<version>.json``, each of which lists the
shards of one version with their bytes, rows and tier. ``append`` writes arrivals as small shards, as many as Spark has
write tasks, without a shuffle. ``compact`` puts the shards in tiers by size (each tier ``FANOUT`` times the one below);
a tier that holds ``FANOUT`` shards or more below the target is read and written again as target-sized files. The merge
coalesces the scan, so it moves nothing between executors and a task holds one file. Shards of the target size stay.

A commit writes the new manifest beside the old ones and renames it to the next version without overwriting, so one of
two writers wins. The other one rebases: it takes the winner's manifest, adds its own shards and tries again; a merge whose
shards the winner has replaced is dropped and planned anew. The rename is atomic where the file system's is (HDFS); on
local folders and object stores without one, use one writer. Readers take the newest manifest, so they see all rows of a
version or none. ``vacuum`` deletes data that no kept manifest names once it is older than ``grace`` seconds, within which
a writer must commit what it has written, and left-over temporary manifests of that age. Lost executors only repeat write
tasks, whose files Spark commits once.

Manifests hold one line of figures a shard, so their size follows the number of files, not the rows. Null values, empty
and very long texts and repeated rows are stored as they are; an empty arrival, as of an empty table, adds no shard;
columns may have any names.
"""

from __future__ import annotations

import json
import math
import time
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .common import clear_name, fresh_dir, table

TARGET = 128 << 20
FANOUT = 4
ARRIVALS = 4
GRACE = 24 * 3600
TRIES = 20
BROADCAST = 10_000  # shards of a manifest that a read may broadcast, some 100 bytes each


def _place(path: str) -> str:
    """A path without its scheme, which differs between Hadoop's and Spark's spellings."""
    return path.split(":", 1)[-1].lstrip("/")


def _own_file():
    """``_place`` of the file of a row: Spark gives it percent-encoded (a plus sign stays as it is)."""
    return F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^[^:]*:/*", "")


class Store:
    def __init__(self, spark: SparkSession, path: str, target: int = TARGET, fanout: int = FANOUT):
        self.spark, self.path, self.target, self.fanout = spark, path.rstrip("/"), target, fanout
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path(self.path).getFileSystem(self.conf)
        self.fs.mkdirs(self._path(self.path))

    def _path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path(self.path))]
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """The newest manifest, or that of ``version``; version 0 has no shards."""
        known = self.versions()
        if version is None:
            version = known[-1] if known else 0
        if not version:
            return {"version": 0, "shards": []}
        rows = self.spark.read.text(f"{self.path}/manifest-{version:08d}.json", wholetext=True).collect()
        return json.loads(rows[0][0])

    def commit(self, base: dict, shards: list[dict]) -> dict:
        """Makes ``shards`` the version after ``base``; fails if another writer has made it."""
        if max(self.versions(), default=0) > base["version"]:
            raise RuntimeError(f"version {base['version'] + 1} was committed by another writer")
        new = {"version": base["version"] + 1, "shards": sorted(shards, key=lambda s: s["path"])}
        temp, final = f"{self.path}/.{uuid.uuid4().hex}.tmp", f"{self.path}/manifest-{new['version']:08d}.json"
        out = self.fs.create(self._path(temp), False)
        out.write(bytearray(json.dumps(new, indent=1).encode()))
        out.close()
        rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.NONE
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.path).toUri() if ":" in self.path else self.fs.getUri(), self.conf).rename(self._path(temp), self._path(final), how)
        except Exception as e:
            self.fs.delete(self._path(temp), False)
            raise RuntimeError(f"version {new['version']} was committed by another writer") from e
        return new

    def publish(self, new: list[dict], gone: set[str] = frozenset()) -> dict | None:
        """Commits ``new`` shards in place of those ``gone`` on the newest version; None if another writer has replaced these."""
        for _ in range(TRIES):
            base = self.manifest()
            paths = {s["path"] for s in base["shards"]}
            if not gone <= paths:
                return None
            try:
                return self.commit(base, [s for s in base["shards"] if s["path"] not in gone] + new)
            except RuntimeError:
                time.sleep(0.05)
        raise RuntimeError(f"other writers won {TRIES} times")

    def tier(self, size: int) -> int:
        """0 for shards below target / fanout^3; the tier of target-sized files is 4."""
        least = self.target / self.fanout**3
        return 0 if size < least else min(4, 1 + int(math.log(size / least, self.fanout) + 1e-9))

    def _described(self, folder: str) -> list[dict]:
        """One record of each Parquet file below ``folder``; rows are counted from the files' footers."""
        sizes: dict[str, int] = {}
        files = self.fs.listFiles(self._path(folder), True)
        while files.hasNext():
            f = files.next()
            if f.getPath().getName().startswith("part-"):
                sizes[f.getPath().toString()] = f.getLen()
        if not sizes:
            return []
        counts = {r[0]: r[1] for r in self.spark.read.parquet(*sizes).groupBy(_own_file()).count().collect()}
        own = [{"path": p, "bytes": n, "rows": counts.get(_place(p), 0), "tier": self.tier(n)} for p, n in sizes.items()]
        return [s for s in own if s["rows"]]

    def append(self, rows: DataFrame, arrival: str | None = None) -> dict:
        """Writes ``rows`` as new shards and commits them; with ``arrival``, a column, each of its values apart. Nothing is
        committed unless the new shards hold as many rows as were written."""
        folder = f"{self.path}/data-{uuid.uuid4().hex}"
        written = Observation()
        out = rows.observe(written, F.count(F.lit(1)).alias("n")).write.option("compression", "zstd")
        (out.partitionBy(arrival) if arrival else out).parquet(folder)
        new = self._described(folder)
        if (n := sum(s["rows"] for s in new)) != written.get["n"]:
            raise RuntimeError(f"{written.get['n']} rows were written and {n} found; nothing was committed")
        return self.publish(new)

    def plan(self, manifest: dict) -> list[list[dict]]:
        """Groups of similarly sized shards that are due for a merge, smallest tier first."""
        tiers: dict[int, list[dict]] = {}
        for s in manifest["shards"]:
            if s["bytes"] < self.target / 2:
                tiers.setdefault(s["tier"], []).append(s)
        return [g for _, g in sorted(tiers.items()) if len(g) >= self.fanout]

    def compact(self) -> dict:
        """Merges due tiers until none is due; each merge is one commit. What another writer has merged meanwhile is left."""
        now = self.manifest()
        while groups := self.plan(now):
            group = groups[0]
            files = max(1, round(sum(s["bytes"] for s in group) / self.target))
            folder = f"{self.path}/data-{uuid.uuid4().hex}"
            rows = self.spark.read.parquet(*[s["path"] for s in group])
            rows.coalesce(files).write.option("compression", "zstd").parquet(folder)
            gone = {s["path"] for s in group}
            new = self._described(folder)
            if sum(s["rows"] for s in new) != sum(s["rows"] for s in group):
                raise RuntimeError("a merge changed the number of rows; nothing was committed")
            now = self.publish(new, gone) or self.manifest()
        return now

    def vacuum(self, keep: int = 1, grace: float = GRACE) -> None:
        """Deletes older manifests than the newest ``keep``, and data and temporary manifests that none of these names and
        that are older than ``grace`` seconds. 0 is safe only without other writers."""
        before = time.time() * 1000 - 1000 * grace
        known = self.versions()
        named = {s["path"] for v in known[-keep:] for s in self.manifest(v)["shards"]}
        for s in self.fs.listStatus(self._path(self.path)):
            p = s.getPath()
            if p.getName().startswith("data-"):
                files, live = self.fs.listFiles(p, True), False
                while files.hasNext():
                    f = files.next()
                    if f.getPath().toString() in named or f.getModificationTime() > before:
                        live = True
                    elif f.getPath().getName().startswith("part-"):
                        self.fs.delete(f.getPath(), False)
                if not live and s.getModificationTime() <= before:
                    self.fs.delete(p, True)
            elif p.getName().endswith(".tmp") and s.getModificationTime() <= before:
                self.fs.delete(p, False)
        for v in known[:-keep]:
            p = self._path(f"{self.path}/manifest-{v:08d}.json")
            if self.fs.getFileStatus(p).getModificationTime() <= before:  # younger ones still stop writers that began on them
                self.fs.delete(p, False)

    def read(self, version: int | None = None) -> DataFrame | None:
        """All rows of a version with ``shard`` (its file's path in the store), ``tier``, ``shard_bytes``, ``shard_rows`` and ``version``
        (names are lengthened where the rows have such columns); None for a version without shards."""
        m = self.manifest(version)
        if not m["shards"]:
            return None
        rows = self.spark.read.parquet(*[s["path"] for s in m["shards"]])
        own = {c: clear_name(rows, c) for c in ("shard", "tier", "shard_bytes", "shard_rows", "version")}
        home = len(_place(self.fs.makeQualified(self._path(self.path)).toString())) + 1
        at = clear_name(rows, "shard_place")
        known = self.spark.createDataFrame([(_place(s["path"]), _place(s["path"])[home:], s["tier"], s["bytes"], s["rows"], m["version"]) for s in m["shards"]], f"`{at}` string, `{own['shard']}` string, `{own['tier']}` int, `{own['shard_bytes']}` long, `{own['shard_rows']}` long, `{own['version']}` int")
        if len(m["shards"]) <= BROADCAST:
            known = F.broadcast(known)
        return rows.withColumn(at, _own_file()).join(known, at).select(*rows.columns, *own.values())


def op8_tiered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document read back from the compacted store: its shard and the hash of its text. The table arrives in
    ``ARRIVALS`` batches one after the other, by a hash of doc_id; each is appended and due tiers are merged."""
    docs = table(spark, sf_dir, "documents")
    store = Store(spark, fresh_dir(spark, "shards"))
    for k in range(ARRIVALS):
        store.append(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS)) == k))
        store.compact()
    store.vacuum(grace=0)  # this query's own folder
    rows = store.read()
    sha = F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")
    if rows is None:
        return docs.select("doc_id", sha, *(F.lit(None).cast(t).alias(c) for c, t in (("shard", "string"), ("tier", "int"), ("shard_bytes", "bigint"), ("shard_rows", "bigint"), ("version", "int"))))
    own = ("shard", "tier", "shard_bytes", "shard_rows", "version")
    return rows.select("doc_id", sha, *(F.col(f"`{c}`").alias(n) for c, n in zip(rows.columns[-len(own) :], own)))  # the store's columns come last
