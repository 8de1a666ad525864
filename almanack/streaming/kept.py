"""A keyed table that streams keep up to date: buckets that split as it grows, changes as deltas.

Rows lie in buckets by a hash of their key. There are as many buckets as the rows call for, and
the table grows by *linear hashing*: buckets split one after the other, in order, so a key's
bucket follows from the number of buckets alone and a growing table is never dealt anew. A
batch writes only the rows that it changes, as a delta of their buckets. Reading takes the
newest row of each key, in those buckets that have deltas. A few buckets a batch, those with the
largest deltas first, are written anew without them.

Every version has a manifest, renamed into place last. A replayed batch overwrites its own
files and nothing else; readers follow complete manifests.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from almanack.session import durable

#: Rows a bucket holds on average before the next one splits.
BUCKET_ROWS = 50_000
#: A bucket is due when its deltas are so many, or hold this share of its rows.
MOST_DELTAS = 8
DELTA_SHARE = 0.5
#: One in so many buckets, one at least, is split and one written anew in a batch.
SHARE_A_BATCH = 32
#: Up to so many keys of a batch are broadcast to the buckets it touches.
FEW_KEYS = 500_000


class KeptTable:
    """``keys`` name a row; ``schema`` is the layout of the rows."""

    def __init__(self, spark: SparkSession, root: str, schema: str, keys: Sequence[str], bucket_rows: int = BUCKET_ROWS):
        self.spark, self.root, self.schema, self.keys, self.bucket_rows = spark, root, schema, list(keys), bucket_rows
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        self._files = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(os.path.join(self.root, *parts))

    def _names(self, *parts: str) -> list[str]:
        folder = self._path(*parts)
        return [f.getPath().getName() for f in self._files.listStatus(folder)] if self._files.exists(folder) else []

    def bucket(self, count: int) -> Column:
        """A key's bucket when there are ``count``: those before the split pointer are dealt by the next power of two."""
        whole = 1 << (count.bit_length() - 1)
        h = F.xxhash64(*self.keys)
        fine = F.pmod(h, F.lit(2 * whole))
        return F.when(fine < count, fine).otherwise(F.pmod(h, F.lit(whole))).cast("int")

    # ---- versions -----------------------------------------------------------------------------

    def versions(self) -> list[int]:
        return sorted(int(n) for n in self._names("manifests") if n.isdigit())

    def latest(self) -> int:
        """The newest complete version, -1 if there is none."""
        return max(self.versions(), default=-1)

    def manifest(self, version: int) -> dict:
        """``count`` of buckets, and of each bucket its ``base`` folder, ``rows``, ``deltas`` and ``changed`` rows in them."""
        if version < 0:
            return {"count": 1, "buckets": {}}
        stream = self._files.open(self._path("manifests", str(version)))
        try:
            found = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        return found | {"buckets": {int(k): v for k, v in found["buckets"].items()}}

    def _publish(self, version: int, manifest: dict) -> None:
        target, draft = self._path("manifests", str(version)), self._path("manifests", f"_{version}")
        out = self._files.create(draft, True)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        if self._files.exists(target):
            self._files.delete(target, False)
        self._files.rename(draft, target)

    def expire(self, keep: int = 2) -> list[str]:
        """Remove the manifests before the newest ``keep``, and folders of rows that none of those names."""
        old, kept = self.versions()[:-keep], self.versions()[-keep:]
        named = {f for v in kept for b in self.manifest(v)["buckets"].values() for f in (b["base"], *b["deltas"])}
        for v in old:
            self._files.delete(self._path("manifests", str(v)), False)
        gone = []
        for v in self._names("rows"):
            for kind in self._names("rows", v):
                folders = [f"rows/{v}/{kind}/{b}" for b in self._names("rows", v, kind) if "=" in b]
                gone += [f for f in folders if f not in named and int(v) <= max(kept, default=-1)]
        for f in gone:
            self._files.delete(self._path(f), True)
        return gone

    # ---- reading ------------------------------------------------------------------------------

    def _rows(self, manifest: dict, buckets: Sequence[int] | None = None) -> DataFrame:
        held = [b for k, b in manifest["buckets"].items() if buckets is None or k in buckets]
        load = lambda folders: self.spark.read.schema(f"{self.schema}, _version int").parquet(*(os.path.join(self.root, f) for f in folders))
        plain = [b["base"] for b in held if b["base"] and not b["deltas"]]
        mixed = [f for b in held if b["deltas"] for f in (b["base"], *b["deltas"]) if f]
        parts = []
        if plain:
            parts.append(load(plain).drop("_version"))
        if mixed:
            newest = Window.partitionBy(*self.keys).orderBy(F.desc("_version"))
            # rows without a whole key can't be changed, so none of them is older than another
            whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in self.keys])
            rows = load(mixed)
            first = rows.where(whole).withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")
            parts.append(first.unionByName(rows.where(~whole)).drop("_version"))
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return reduce(DataFrame.unionByName, parts)

    def read(self, version: int | None = None, buckets: Sequence[int] | None = None) -> DataFrame:
        """All rows of a version (the newest if none is named), or those of some buckets."""
        return self._rows(self.manifest(self.latest() if version is None else version), buckets)

    # ---- writing ------------------------------------------------------------------------------

    def _store(self, version: int, kind: str, rows: DataFrame, count: int) -> dict[int, tuple[str, int]]:
        """(folder, rows) of every bucket that ``rows`` have; a bucket's rows aren't brought into one task."""
        folder = f"rows/{version}/{kind}"
        path = os.path.join(self.root, folder)
        marked = rows.withColumns({"_version": F.lit(version), "_bucket": self.bucket(count)})
        marked.write.mode("overwrite").partitionBy("_bucket").parquet(path)
        if not any("=" in n for n in self._names(folder)):
            return {}
        sizes = self.spark.read.parquet(path).groupBy("_bucket").count().collect()  # a row per bucket
        return {r["_bucket"]: (f"{folder}/_bucket={r['_bucket']}", r["count"]) for r in sizes}

    def write(self, version: int, rows: DataFrame) -> None:
        """Make ``rows`` the whole content of the table, in as many buckets as they call for."""
        rows = durable(rows)  # counted, then written: both must see the same rows
        count = max(1, -(-rows.count() // self.bucket_rows))
        stored = self._store(version, "base", rows, count)
        self._publish(version, {"count": count, "buckets": {k: {"base": f, "rows": n, "deltas": [], "changed": 0} for k, (f, n) in stored.items()}})

    def apply(self, version: int, batch: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Write the version that ``merge(old rows of the batch's keys, batch)`` gives.

        A batch with half as many keys as the table has rows makes the table anew; any other adds
        deltas with the rows that differ from before.
        """
        before = self.manifest(version - 1)
        total = sum(b["rows"] + b["changed"] for b in before["buckets"].values())
        named = batch.select(*self.keys).distinct().withColumn("_b", self.bucket(before["count"]))
        touched = {r["_b"]: r["n"] for r in named.groupBy("_b").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per bucket
        keys = sum(touched.values())
        if 2 * keys >= total:
            self.write(version, merge(self._rows(before), batch))
            return
        own = named.drop("_b")
        old = durable(self._rows(before, list(touched)).join(F.broadcast(own) if keys <= FEW_KEYS else own, self.keys, "left_semi"))
        merged = merge(old, batch)
        fields = [c for c in merged.columns if c not in self.keys]
        was = old.select(*self.keys, F.struct(*fields).alias("_was"))
        now = merged.join(was, self.keys, "left").where(F.col("_was").isNull() | ~F.struct(*fields).eqNullSafe(F.col("_was"))).drop("_was")
        after = {"count": before["count"], "buckets": {k: dict(b) for k, b in before["buckets"].items()}}
        for k, (folder, n) in self._store(version, "delta", now, before["count"]).items():
            b = after["buckets"].setdefault(k, {"base": None, "rows": 0, "deltas": [], "changed": 0})
            b["deltas"], b["changed"] = [*b["deltas"], folder], b["changed"] + n
        self._publish(version, self._tidied(version, after))

    def _tidied(self, version: int, manifest: dict) -> dict:
        """``manifest`` after the next splits and the most urgent rewrites, a few buckets in all."""
        count, buckets = manifest["count"], manifest["buckets"]
        few = max(1, count // SHARE_A_BATCH)
        total = sum(b["rows"] + b["changed"] for b in buckets.values())
        whole = 1 << (count.bit_length() - 1)
        more = min(few, max(0, -(-total // self.bucket_rows) - count), 2 * whole - count)
        split = list(range(count - whole, count - whole + more))
        due = [k for k, b in buckets.items() if k not in split and (len(b["deltas"]) > MOST_DELTAS or b["changed"] > DELTA_SHARE * max(b["rows"], self.bucket_rows))]
        due = sorted(due, key=lambda k: -len(buckets[k]["deltas"]))[:few]
        again = [k for k in split + due if k in buckets]
        if not again and not more:
            return manifest
        kept = {k: b for k, b in buckets.items() if k not in again}
        if again:
            stored = self._store(version, "base", self._rows(manifest, again), count + more)
            kept |= {k: {"base": f, "rows": n, "deltas": [], "changed": 0} for k, (f, n) in stored.items()}
        return {"count": count + more, "buckets": kept}
