"""Tables in the shared folder: they cut lineage, survive lost executors and are deleted when nothing reads them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A relation is broadcast only when its measured size is at most this.
BROADCAST_BYTES = 32 << 20


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``. A temporary one only where none is set and the master is local: on a cluster no other executor would see it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='tessella-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


class Scratch:
    """A folder of written tables, under one name."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        self.n = 0

    def path(self, name: str = "") -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}{name and '-' + name}"

    def write(self, df: DataFrame, name: str = "") -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch = path
        return out

    def _fs(self, path: str):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def bytes(self, df: DataFrame) -> int:
        """Size on disk of a table that ``write`` returned."""
        at, fs = self._fs(df._scratch)
        return fs.getContentSummary(at).getLength()

    def drop(self, *dfs: DataFrame) -> None:
        """Deletes tables that no result reads any more."""
        for df in dfs:
            at, fs = self._fs(df._scratch)
            fs.delete(at, True)

    def settle(self, df: DataFrame, name: str = "result") -> DataFrame:
        """Writes a result and deletes every other table of this folder, so that only the result takes disk."""
        out = self.write(df, name)
        root, fs = self._fs(self.root)
        for found in fs.listStatus(root):
            if found.getPath().getName() != out._scratch.rpartition("/")[2]:
                fs.delete(found.getPath(), True)
        return out

    def small(self, df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
        """A written table, hinted for broadcast where its measured size allows; else joins shuffle."""
        at_rest = self.write(df)
        out = at_rest
        # compressed columns may be several times larger as rows
        if self.bytes(at_rest) * 8 <= limit:
            out = F.broadcast(at_rest)
            out._scratch = at_rest._scratch
        return out
