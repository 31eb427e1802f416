"""Committed, versioned tables.

Every build writes to a fresh folder under ``root/data``; a numbered manifest
under ``root/_manifests`` then names that folder, the fingerprint of the inputs
and what else the builder wants to keep. A table is what its last whole manifest
says, so a build that dies half-way is never seen, and a reader keeps its folder
while others publish new ones. A manifest is created only if its number is
free: of two sessions that publish at once, the second takes the next number.

All file access goes through Hadoop's file system, so the root may be on any
storage that Spark writes to.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from typing import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def fingerprint(df: DataFrame, *parameters) -> str:
    """Hash of the files behind ``df`` (path, size, time of change) and of the
    parameters of what is built from them."""
    spark = df.sparkSession
    seen = []
    for f in sorted(df.inputFiles()):
        fs, p = _fs(spark, f)
        st = fs.getFileStatus(p)
        seen.append([f, st.getLen(), st.getModificationTime()])
    return hashlib.sha256(json.dumps([seen, [str(x) for x in parameters]]).encode()).hexdigest()


class VersionedTable:
    def __init__(self, spark: SparkSession, root: str, fmt: str = "parquet", **options):
        self.spark, self.root, self.fmt, self.options = spark, root.rstrip("/"), fmt, options

    def manifests(self) -> list[tuple[int, dict]]:
        """(number, content) of the whole manifests, last first."""
        fs, folder = _fs(self.spark, f"{self.root}/_manifests")
        if not fs.exists(folder):
            return []
        out = []
        for st in fs.listStatus(folder):
            name = st.getPath().getName()
            if not name.endswith(".json") or not name[:-5].isdigit():
                continue
            stream = fs.open(st.getPath())
            try:
                text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            try:
                content = json.loads(text)
            except ValueError:
                continue  # its writer died
            out.append((int(name[:-5]), content))
        return sorted(out, key=lambda m: -m[0])

    def current(self) -> dict | None:
        found = self.manifests()
        return found[0][1] if found else None

    def read(self, manifest: dict | None = None) -> DataFrame | None:
        """The table of a manifest (the current one), or None."""
        m = manifest or self.current()
        if m is None:
            return None
        return self.spark.read.format(self.fmt).options(**self.options).schema(
            T.StructType.fromJson(m["schema"])).load(m["path"])

    def publish(self, df: DataFrame, mark: str | None = None, **info) -> DataFrame:
        """Write ``df`` to a fresh folder and make it the current version."""
        path = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.format(self.fmt).options(**self.options).save(path)
        manifest = {"path": path, "fingerprint": mark, "schema": df.schema.jsonValue(), "info": info}
        found = self.manifests()
        number = found[0][0] + 1 if found else 1
        while True:
            fs, p = _fs(self.spark, f"{self.root}/_manifests/{number:08d}.json")
            try:
                out = fs.create(p, False)
                break
            except Py4JJavaError:
                if not fs.exists(p):
                    raise
                number += 1  # taken meanwhile
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        return self.read(manifest)

    def get(self, mark: str, build: Callable[[DataFrame | None], DataFrame], force_rebuild: bool = False) -> DataFrame:
        """The current version if it was built from inputs with this fingerprint;
        else what ``build`` makes of the previous version (None: there is none, or
        all is to be built anew)."""
        m = None if force_rebuild else self.current()
        if m and m["fingerprint"] == mark:
            return self.read(m)
        return self.publish(build(self.read(m) if m else None), mark)
