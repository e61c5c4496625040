"""Input tables and shared intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_shipped: set[str] = set()
#: Tables that are written in the functions under way that clear up behind themselves, the innermost last.
_scratch: list[list[str]] = []


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own where it is unset and all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="loomgraph-"))


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage of iterations and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/loomgraph/{label}-{uuid.uuid4().hex}"
    if _scratch:
        _scratch[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, label: str, **more: Column) -> tuple[DataFrame, dict[str, int]]:
    """written() with its number of rows (n) and other aggregates, which the writing job itself observes."""
    seen = Observation()
    out = written(df.observe(seen, F.count(F.lit(1)).alias("n"), *[x.alias(name) for name, x in more.items()]), label)
    return out, {x: 0 for x in ("n", *more)} | {k: v or 0 for k, v in seen.get.items()}


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt out by a key of many values to as many tasks as the session's shuffles have, and no fewer than there are cores: for rows that are small beside the work on each."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), key)


def tidy(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """fn with its result as a table, and without the tables that were written on the way."""

    @wraps(fn)
    def run(*args, **kwargs) -> DataFrame:
        mine: list[str] = []
        _scratch.append(mine)
        spark = None
        try:
            out = fn(*args, **kwargs)
            spark = out.sparkSession
            _scratch.pop()
            kept = written(out, fn.__name__.strip("_"))
            _scratch.append(mine)
            return kept
        finally:
            _scratch.pop()
            for name in mine if spark else ():
                path = spark._jvm.org.apache.hadoop.fs.Path(name)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    return run


def dropped(df: DataFrame) -> None:
    """Remove the files of a table made by written() that nothing will read again."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/loomgraph/" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Send the package's source to the executors once per application, so that Python workers import it wherever they run. Whatever hands a function to them calls this first."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    to = os.path.join(tempfile.mkdtemp(prefix="loomgraph-src-"), "loomgraph_model.zip")
    with zipfile.ZipFile(to, "w") as z:
        for at, _, names in os.walk(package):
            for name in names:
                full = os.path.join(at, name)
                if name.endswith(".py"):
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    spark.sparkContext.addPyFile(to)
    _shipped.add(app)
