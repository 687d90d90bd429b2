"""Session helpers shared by all operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables in ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only a local session that names none gets a temporary folder of its own; on a cluster a missing setting is an error,
    because a folder of one machine would be lost with it.
    """
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="lectern-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that later steps neither repeat it nor hang on its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def large_rows(spark: SparkSession) -> None:
    """Let Parquet look at the size of what it holds after every row, unless the session says otherwise. By itself it looks after
    100 rows and, if those are small, after 10,000 more: with rows of 3 MB, a task holds several times 300 MB or 30 GB. A look
    takes much less time than a large row."""
    for k in ("page", "block"):
        for m in ("min", "max"):
            if spark.conf.get(name := f"parquet.{k}.size.row.check.{m}", None) is None:
                spark.conf.set(name, "1")


def need_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python, once per application."""
    import os
    import zipfile
    from pathlib import Path

    sc = spark.sparkContext
    root = Path(__file__).resolve().parents[1]
    if getattr(sc, "_lectern_shipped", False) or not root.is_dir():
        return
    at = os.path.join(tempfile.mkdtemp(prefix="lectern-py-"), "lectern-py.zip")
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(at)
    sc._lectern_shipped = True


def send_file(spark: SparkSession, path: str):
    """Send a small file of the driver to all executors, once per application; gives a function of no arguments that returns
    its path where it is called."""
    import os

    sc = spark.sparkContext
    sent = sc.__dict__.setdefault("_lectern_sent", {})
    name = sent.get(path)
    if name is None:
        name = os.path.basename(path)
        if name in sent.values():
            raise ValueError(f"another file named {name} was sent before")
        sc.addFile(path)
        sent[path] = name

    def local() -> str:
        from pyspark import SparkFiles

        return SparkFiles.get(name)

    return local


def task_count(spark: SparkSession) -> int:
    """As many tasks as the session shuffles to, and no fewer than it has cores."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(df: DataFrame) -> DataFrame:
    """Rows over :func:`task_count` tasks: for steps in Python after a small shuffle, which would otherwise follow the number of
    bytes and leave cores idle."""
    return df.repartition(task_count(df.sparkSession))
