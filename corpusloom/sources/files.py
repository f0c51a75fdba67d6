"""Reading files as a corpus, and writing versioned snapshots."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.corpus import git_blob_sha1, vcs_internal


def discover_repos(paths: DataFrame) -> DataFrame:
    """repo: folders that hold a .git folder or file, from a listing (path). What lies inside .git holds no repository."""
    inside = paths.filter(F.rlike("path", F.lit(r"(?s)^(.*/)?\.git(/.*)?$")))
    above = F.regexp_extract("path", r"(?s)^((?:(?!\.git(?:/|$))[^/]*/)*)\.git(?:/.*)?$", 1)
    return inside.select(F.regexp_replace(above, "(?<=.)/$", "").alias("repo")).distinct()


def read_files(spark: SparkSession, root: str, repo: str, tracked: DataFrame | None = None) -> DataFrame:
    """repo, rel_path, abs_path, blob_sha, content of text files below a folder: no NUL bytes, no version-control
    internals, a byte-order mark taken off. blob_sha is of the bytes as they lie there. tracked (rel_path, mode): only regular files that it lists."""
    data = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    below = F.regexp_replace(F.col("path"), "^[a-z]+:/+", "/")
    rel = F.substring_index(below, root.split(":", 1)[-1].rstrip("/") + "/", -1)
    rows = data.select(rel.alias("rel_path"), below.alias("abs_path"), "content").filter(~F.contains(F.col("content"), F.unhex(F.lit("00"))))
    rows = rows.filter(~vcs_internal(F.col("rel_path")))
    if tracked is not None:
        rows = rows.join(tracked.filter(F.col("mode").isin("100644", "100755")).select("rel_path"), "rel_path", "left_semi")
    text = F.decode("content", "UTF-8")
    rows = rows.select(F.lit(repo).alias("repo"), "rel_path", "abs_path", git_blob_sha1(F.col("content")).alias("blob_sha"), F.regexp_replace(text, "^﻿", "").alias("content"))
    return rows


class Snapshots:
    """Versioned table directories. A snapshot is written whole, its manifest last; CURRENT names the one in force."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _write(self, path: str, text: str) -> None:
        p, fs = self._fs(path)
        out = fs.create(p, True)
        out.write(bytearray(text.encode()))
        out.close()

    def _read(self, path: str) -> str | None:
        p, fs = self._fs(path)
        if not fs.exists(p):
            return None
        found = fs.open(p)
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(found, "UTF-8")
        found.close()
        return text

    def commit(self, tables: dict[str, DataFrame], at: str | None = None) -> str:
        """Write tables as a new snapshot; returns its id. It is not in force before set_current()."""
        own = at or uuid.uuid4().hex
        if self._read(f"{self.root}/{own}/MANIFEST") is not None:
            raise ValueError(f"snapshot {own} is there already")
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.root}/{own}/{name}")
        self._write(f"{self.root}/{own}/MANIFEST", json.dumps({"id": own, "tables": sorted(tables)}))
        return own

    def set_current(self, own: str) -> None:
        if self._read(f"{self.root}/{own}/MANIFEST") is None:
            raise ValueError(f"snapshot {own} was never finished")
        self._write(f"{self.root}/CURRENT", own)

    def current(self) -> str | None:
        return self._read(f"{self.root}/CURRENT")

    def load(self, name: str, own: str | None = None) -> DataFrame:
        own = own or self.current()
        if name not in json.loads(self._read(f"{self.root}/{own}/MANIFEST") or '{"tables": []}')["tables"]:
            raise ValueError(f"snapshot {own} has no table {name}")
        return self.spark.read.parquet(f"{self.root}/{own}/{name}")

    def ids(self) -> list[str]:
        """Finished snapshots, sorted."""
        p, fs = self._fs(self.root)
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory() and self._read(f"{self.root}/{s.getPath().getName()}/MANIFEST")) if fs.exists(p) else []
