"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession


#: Spark's setting (not in all versions) that deletes a plan's shuffle files once the plan has run.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class WorkFolder:
    """Tables under ``spark.checkpoint.dir``; on one machine without that setting, under the temporary folder.

    On a cluster the setting must be there: other machines would miss a local folder's files.

    A written table cuts lineage: a lost executor costs a reread, not a recomputation. Results
    read some of the tables; :func:`clear` deletes all that this process has made, once results
    are written.
    """

    made: ClassVar[list[WorkFolder]] = []

    def __init__(self, spark: SparkSession, name: str):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "local")):
                raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
            base = f"file://{tempfile.gettempdir()}/terralume-work"
        self.spark = spark
        self.path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.made.append(self)

    def put(self, name: str, df: DataFrame, options: dict[str, str] | None = None) -> DataFrame:
        """Write (with the writer's ``options``) and read again; shuffle files of the writing plan, which nothing reads any more, are deleted."""
        path, conf = f"{self.path}/{name}", self.spark.conf
        was = _value(self.spark, CLEAN)
        if was is not None:
            conf.set(CLEAN, "true")
        try:
            df.write.option("compression", "zstd").options(**(options or {})).parquet(path)
        finally:
            if was is not None:
                conf.set(CLEAN, was)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no later plan reads."""
        for name in names:
            _delete(self.spark, f"{self.path}/{name}")


def _value(spark: SparkSession, name: str) -> str | None:
    """A setting's value, its default where it is not set; None where this version has none (``get`` with a default of None hides Spark's own)."""
    try:
        return spark.conf.get(name)
    except Exception:
        return None


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def clear(spark: SparkSession) -> int:
    """Delete all work folders of this process; returns how many. No earlier result can be read any more."""
    folders, WorkFolder.made[:] = WorkFolder.made[:], []
    for f in folders:
        _delete(spark, f.path)
    return len(folders)
