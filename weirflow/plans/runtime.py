"""Session plumbing shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data directory; the path may be in any store Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master, where
    driver and executors are one process, may fall back to a temporary folder.
    """
    sc = spark.sparkContext
    known = sc.getCheckpointDir()
    if known:
        return known
    named = spark.conf.get("spark.checkpoint.dir", "")
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="weirflow-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared checkpoint folder and drop its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


#: Bytes of a Parquet row group, which each writing task holds in memory.
ROW_GROUP = 32 << 20
#: While tables are written: shuffle files go as soon as the writing ends, and Arrow batches stay small, since texts may be long.
SPARING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


@contextmanager
def sparing(spark: SparkSession) -> Iterator[None]:
    """Settings of this session that spare disk and memory, put back afterwards."""
    before = {k: spark.conf.get(k, None) for k in SPARING}
    for k, v in SPARING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Scratch:
    """Tables of one run in the shared folder: each is computed once, read back without lineage, and removed when no longer needed.

    The shuffle files behind a table are removed as soon as it is written.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder, self.made = spark, f"{checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame, narrow: bool = False) -> DataFrame:
        """``df`` as a table; a narrow one is written by no more tasks than run at once, so loops do not leave thousands of small files."""
        if narrow:
            df = df.coalesce(max(2, self.spark.sparkContext.defaultParallelism))
        path, self.made = f"{self.folder}/{self.made}", self.made + 1
        with sparing(self.spark):
            df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Removes tables that nothing will read again."""
        for t in tables:
            self._remove(t.scratch_path)

    def close(self) -> None:
        self._remove(self.folder)

    def _remove(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers that do not have it on their path."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    out = os.path.realpath(tempfile.mkdtemp(prefix="weirflow-src-"))
    target = os.path.join(out, "weirflow_src.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(target)
    _SHIPPED[sc.applicationId] = target
