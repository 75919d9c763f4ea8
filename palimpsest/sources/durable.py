"""Intermediate tables in the folder all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None
#: Folders made in this process; only these are ever deleted.
_made: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where it is unset (tests) a folder of this process."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="palimpsest-")
        atexit.register(shutil.rmtree, _own_dir, True)
    return f"file://{_own_dir}"


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/palimpsest-core/{name}-{uuid.uuid4().hex}"
    _made.add(path)
    return path


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _made.discard(folder)


class Written:
    """Tables written on the way to a result; ``drop`` deletes them once their last reader has been written itself."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back: cuts lineage and survives lost executors."""
        path = fresh_path(self.spark, name)
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, keep: int = 0) -> None:
        """Delete all tables but the last ``keep``."""
        cut = len(self.paths) - keep
        for path in self.paths[:cut]:
            delete(self.spark, path)
        self.paths = self.paths[cut:]
