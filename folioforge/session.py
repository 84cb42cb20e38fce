"""Session settings and the one place where lineage is cut."""
from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings the operators are planned for; a cluster's own settings win.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once for each application.

    Functions of the package are sent by name; without this, workers that don't share the driver's
    path could not import them.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="folioforge-code-")) / "folioforge.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(str(path))
    _SHIPPED.add(sc.applicationId)


def local_session(name: str = "folioforge", cores: int | str = 8, **conf: str) -> SparkSession:
    """A local session for tests and the benchmark."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for k, v in {**DEFAULTS, "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                 "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false", **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only a session with a local master may do without the setting: it gets a folder of its own.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if d:
        return d.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    d = tempfile.mkdtemp(prefix="folioforge-")
    spark.conf.set("spark.checkpoint.dir", "file://" + d)
    return "file://" + d


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and return the table read back.

    Cuts lineage, survives the loss of any executor, keeps column pruning (parquet).
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{_own_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/folioforge-{spark.sparkContext.applicationId}"


def cleanup(spark: SparkSession) -> None:
    """Remove the tables this application wrote; for the end of a job, as earlier results read them."""
    p = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
