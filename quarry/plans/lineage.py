"""The folder that the cluster shares, and cutting lineage for loops in it."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from quarry.plans import folders

_own: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a session of one machine gets a temporary one of its own;
    on a cluster that would be another folder on each machine, so there it is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="quarry-")
        named = _own[app]
    return named.rstrip("/")


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder that goes when the session ends."""
    path = f"{shared_folder(spark)}/quarry/{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                folders.delete(spark, path)
        except Exception:  # noqa: BLE001  the session has ended: the folder's owner removes what is left
            return


def cut(df: DataFrame) -> DataFrame:
    """Writes df as Parquet to the shared folder, once, and reads it back."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, rows: int = 1024, size: int = 8 << 20) -> None:
    """Bounds the Arrow batches that the session's Python stages get, where they are larger."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = re.fullmatch(r"(\d+)[bB]?", spark.conf.get(name, None) or "")
        if not now or not 0 < int(now[1]) <= most:
            spark.conf.set(name, str(most))
