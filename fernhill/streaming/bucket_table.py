"""A table in key buckets that batches change: a batch rewrites the buckets it touches and commits by one rename."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


class BucketTable:
    """Rows of ``schema`` below ``root``, in ``buckets`` by a hash of ``key``.

    ``manifest/<batch>`` is a JSON file that names the folder of each bucket that has rows; the one of the
    highest number is the table. A batch writes new folders for the buckets that its keys fall into and
    then a manifest, by a rename that fails if the number is taken; the other buckets keep their files.
    Rows are rebalanced by bucket, which splits a large bucket over files. So a reader sees all of a batch or nothing, a lost job leaves folders that nothing names, and a batch
    that comes again after its commit changes nothing. Folders that none of the last ``keep`` manifests
    names go after each commit. The driver holds one path for each bucket.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, key: str, buckets: int = 16, keep: int = 2):
        self.spark, self.root, self.schema, self.key, self.buckets, self.keep = spark, root.rstrip("/"), schema, key, buckets, keep
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        at = self._path(f"{self.root}/manifest")
        names = [x.getPath().getName() for x in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n) for n in names if n.isdigit())

    def _manifest(self, version: int) -> dict[int, str]:
        stream = self._fs.open(self._path(f"{self.root}/manifest/{version}"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return {int(b): path for b, path in json.loads(text).items()}

    def folders(self) -> dict[int, str]:
        """The folder of each bucket, below ``root``."""
        versions = self._versions()
        return self._manifest(versions[-1]) if versions else {}

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.root}/{f}" for f in folders))

    def read(self) -> DataFrame:
        """All rows as of the last commit."""
        return self._read(list(self.folders().values()))

    def bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def apply(self, batch: DataFrame, number: int, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Commit ``merge(rows of the touched buckets, batch)`` as version ``number``; the buckets that were rewritten.

        ``merge`` must leave a row's bucket as it is. A version that is there already, or a later one, means that this batch came before.
        """
        versions = self._versions()
        if versions and versions[-1] >= number:
            return []
        batch = batch.select(*self.schema.names)
        touched = sorted(r[0] for r in batch.select(self.bucket()).distinct().collect())
        folders = self.folders()
        if touched:
            old = self._read([folders[b] for b in touched if b in folders])
            data = f"data/{number}-{uuid.uuid4().hex}"
            rows = merge(old, batch).select(*self.schema.names).withColumn("__bucket", self.bucket())
            rows.hint("rebalance", F.col("__bucket")).write.partitionBy("__bucket").parquet(f"{self.root}/{data}")
            made = {x.getPath().getName() for x in self._fs.listStatus(self._path(f"{self.root}/{data}"))}
            folders = {b: f for b, f in folders.items() if b not in touched} | {b: f"{data}/__bucket={b}" for b in touched if f"__bucket={b}" in made}
        self._commit(number, folders)
        return touched

    def _commit(self, number: int, folders: dict[int, str]) -> None:
        draft, final = (self._path(f"{self.root}/{x}") for x in (f"draft-{uuid.uuid4().hex}", f"manifest/{number}"))
        stream = self._fs.create(draft, False)
        stream.write(bytearray(json.dumps(folders, sort_keys=True).encode()))
        stream.close()
        self._fs.mkdirs(final.getParent())
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            raise RuntimeError(f"version {number} of {self.root} was committed by another writer")
        self._compact()

    def _compact(self) -> None:
        """Drop manifests but the last ``keep``, and the folders that only they named."""
        versions = self._versions()
        named = {f for v in versions[-self.keep :] for f in self._manifest(v).values()}
        for v in versions[: -self.keep]:
            for folder in self._manifest(v).values():
                if folder not in named:
                    self._fs.delete(self._path(f"{self.root}/{folder}"), True)
            self._fs.delete(self._path(f"{self.root}/manifest/{v}"), False)
