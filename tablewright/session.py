"""Session helpers: a tuned local session, and tables that cut lineage."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tablewright", cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Local session used by tests and the bench; on a cluster the caller supplies its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


_SCRATCH: list[str] = []
_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, so that they need no copy of it on their path."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="ship-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as bundle:
        for source in sorted(root.rglob("*.py")):
            bundle.write(source, source.relative_to(root.parent))
    context.addPyFile(str(target))
    _SHIPPED.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """Folder named by spark.checkpoint.dir.

    A local session without that setting (tests) gets one scratch folder. On a cluster a missing
    setting is an error: a machine-local folder would not survive executor loss.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        if not _SCRATCH:
            _SCRATCH.append(tempfile.mkdtemp(prefix="run-", dir="/tmp"))
        folder = _SCRATCH[0]
    return folder.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage: write the frame once as Parquet in the shared folder and read it back.

    Unlike an eager checkpoint it is computed once, and later reads prune columns and push filters.
    """
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions_hint(spark: SparkSession) -> int:
    """Number of range buckets worth using: the session's shuffle width."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
