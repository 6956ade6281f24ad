"""Session settings and small helpers shared by every module."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings that results depend on; sizes and parallelism are left to the cluster.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
#: Rows of an Arrow batch: rows here are whole texts, of which Spark's default of 10,000 takes much memory on both sides.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2500"
#: Bytes of an Arrow batch: however long its texts are, a batch takes no more, but for one row that is longer by itself.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"
_scratch: list[list[DataFrame]] = []


def local_session(cores: str = "*", partitions: int = 8, **extra: str) -> SparkSession:
    """A local session for tests and benches; on a cluster, bring your own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tallyloom")
    for k, v in {**DEFAULTS, "spark.sql.shuffle.partitions": str(partitions), "spark.ui.enabled": "false", **extra}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def left_by(rows: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` left joined with ``small`` by ``on``. Rows that lack a part of the key meet nothing; a shuffle would bring
    all of them to one task, so they are dealt out by what else they hold."""
    lacks = F.exists(F.array(*[F.col(f"`{x}`").isNull() for x in on]), lambda x: x)
    content = F.xxhash64(*[F.col(f"`{x}`") for x in rows.columns])
    dealt = rows.withColumn("__dealt", F.when(lacks, content).otherwise(F.lit(0).cast("long")))
    # always 0, but no literal: the planner would leave a literal out of the shuffle's key
    zero = F.pmod(F.xxhash64(*[F.col(f"`{x}`") for x in on]), F.lit(1))
    return dealt.join(small.withColumn("__dealt", zero), [*on, "__dealt"], "left").drop("__dealt")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or one set here where that is unset (local tests)."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        found = sc.getCheckpointDir()
        if not found:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="tallyloom-shared-"))
            found = sc.getCheckpointDir()
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: what follows plans from there, with its size and columns known, and a
    lost executor costs no more than that. The table goes by ``free``, else with the driver's JVM."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tallyloom-{spark.sparkContext.applicationId}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out.written = path
    if _scratch:
        _scratch[-1].append(out)
    return out


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Frees, at its end, the tables that ``cut`` wrote within; what is taken out of the list it gives stays."""
    made: list[DataFrame] = []
    _scratch.append(made)
    try:
        yield made
    finally:
        _scratch.pop()
        free(*made)


def free(*tables: DataFrame) -> None:
    """Remove tables that ``cut`` wrote and that nothing reads any more."""
    for t in tables:
        p = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.written)
        fs = p.getFileSystem(t.sparkSession._jsc.hadoopConfiguration())
        fs.delete(p, True)
        fs.cancelDeleteOnExit(p)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once a session, and let batches hold fewer rows and bytes
    unless the session says how many.

    Workers then import it even if the repository is not on their path.
    """
    name, default, rows = BATCH_ROWS
    if spark.conf.get(name, default) == default:
        spark.conf.set(name, rows)
    name, size = BATCH_BYTES
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, size)
    sc = spark.sparkContext
    if getattr(sc, "_tallyloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, str(f.relative_to(root.parent)))
    folder = tempfile.mkdtemp(prefix="tallyloom-")  # on the driver only; Spark serves it to the executors
    path = os.path.join(folder, "tallyloom_pkg.zip")
    Path(path).write_bytes(data.getvalue())
    sc.addPyFile(path)
    sc._tallyloom_shipped = True
