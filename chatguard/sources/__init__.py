"""Reading and writing of events, audit lines, labels and reports."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatguard import schemas


_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only a session on this machine alone may do without: it gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _OWN.get(spark.sparkContext.applicationId) or "file://" + tempfile.mkdtemp(prefix="chatguard-")
        _OWN[spark.sparkContext.applicationId] = folder
    return folder.rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back, for a result that is used more than once."""
    path = f"{shared_folder(df.sparkSession)}/chatguard/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_events(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Raw chat events from JSON lines; fields that are missing are null."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(schemas.EVENT).json(path)


def read_audit(spark: SparkSession, path: str, since: str | None = None, before: str | None = None) -> DataFrame:
    """Audit lines from JSON lines; blank and malformed lines are skipped, a missing path gives no rows.

    since, before: days (yyyy-mm-dd) of a table that was written in batches; other days are not read.
    """
    try:
        rows = spark.read.schema(schemas.AUDIT).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schemas.AUDIT)
    known = [f.name for f in spark.createDataFrame([], schemas.AUDIT).schema]
    for day, test in ((since, ">="), (before, "<")):
        rows = rows.filter(f"day {test} date '{day}'") if day else rows
    return rows.select(*known)


def write_audit(audit: DataFrame, path: str, format: str = "json", batch: str | None = None) -> None:
    """Write text-free lines; a text column is refused.

    With a batch the lines lie by day of t (UTC) and batch, and a batch that is written again replaces its own lines,
    so a run that failed half-way or ran twice leaves one set of them. Days can be read and removed one by one.
    Without a batch the lines are appended.
    """
    if "text" in audit.columns:
        raise ValueError("audit lines hold no text")
    if batch is None:
        audit.write.mode("append").format(format).save(path)
        return
    # The day is worked out from the seconds alone, whatever the session's time zone is.
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.coalesce(F.col("t"), F.lit(0.0)) / 86400).cast("int"))
    dated = audit.withColumns({"day": day, "batch": F.lit(batch)})
    dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").format(format).save(path)


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """Labelled messages from a JSON array."""
    return spark.read.schema(schemas.LABELLED).option("multiLine", True).json(path)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CASE).json(path)


def write_report(report: DataFrame, path: str, format: str = "parquet") -> None:
    """A summary as one small table."""
    report.coalesce(1).write.mode("overwrite").option("header", True).format(format).save(path)

