"""Cutting lineage through the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only on one machine a temporary one takes its place."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="graphloom-"))
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def temporary(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. It is deleted when the application ends, or by ``release``."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    fs, p = _file_system(spark, path)
    fs.deleteOnExit(p)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(spark: SparkSession) -> None:
    """Delete every table that was written for this application so far; frames still reading them become invalid."""
    for path in _written.pop(spark.sparkContext.applicationId, []):
        fs, p = _file_system(spark, path)
        fs.delete(p, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, and safe from lost executors."""
    path = temporary(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of the files that are read, and rows, to a partition of a join.
PART_BYTES, PART_ROWS = 16 << 20, 500_000


def _parts(spark: SparkSession, wanted: int) -> int:
    """At least one for each core and, but where the input asks for more, no more than the session's shuffles have."""
    return max(1, wanted, min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def parts(df: DataFrame) -> int:
    """Partitions for a join of ``df``, in proportion to what its plan reads. Shuffles that are given a number aren't merged by their compressed size."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    # what isn't read from files has no size, or one beyond all bounds
    known = [x for x in sizes if x < 1 << 60]
    wanted = max(-(-sum(known) // PART_BYTES), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) if len(known) < len(sizes) else 1)
    return _parts(df.sparkSession, min(wanted, 4096))


def parts_of_rows(df: DataFrame) -> int:
    """As ``parts``, for a table that ``cut`` wrote."""
    return _parts(df.sparkSession, -(-df.count() // PART_ROWS))
