"""Session helpers: local test sessions and reliable places to cut lineage."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.util import inheritable_thread_target

T = TypeVar("T")
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_cleaning, _cleaning_lock = [0], threading.Lock()


def local_session(cores: int | str = 8, app: str = "tickloom", memory: str = "8g") -> SparkSession:
    """A session for tests and the bench. A cluster brings its own session and settings."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local-mode session may fall back to a temporary folder: on a cluster a
    machine-local folder would be lost with its executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not configured:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):  # local-cluster has executors of its own
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="tickloom-")
        spark.conf.set("spark.checkpoint.dir", configured)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is planned inside leaves no shuffle files when it has run; else they stay until the driver collects its
    garbage, and the disk holds those of all steps at once. A step that needs them again computes them again."""
    with _cleaning_lock:
        _cleaning[0] += 1
        if _cleaning[0] == 1:
            _cleaning[1:] = [spark.conf.get(SHUFFLE_CLEANUP, None)]
            spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        with _cleaning_lock:
            _cleaning[0] -= 1
            if not _cleaning[0] and _cleaning[1] is None:
                spark.conf.unset(SHUFFLE_CLEANUP)
            elif not _cleaning[0]:
                spark.conf.set(SHUFFLE_CLEANUP, _cleaning[1])


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in reliable storage so that later stages never recompute it."""
    shared_dir(df.sparkSession)
    with shuffles_dropped(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a plan of its own


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again.

    For loops: a checkpointed frame hands on the constraints of its plan, which grow with
    every round until planning takes all the time; a table that is read knows none.
    """
    path = scratch_path(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared directory for a written table."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def side_by_side(spark: SparkSession, jobs: Sequence[Callable[[], T]], threads: int) -> list[T]:
    """The results of independent jobs, up to ``threads`` at a time, each in a scheduler pool of its own.

    With ``spark.scheduler.mode=FAIR`` the pools share the executors; else a job fills what the others leave idle.
    """

    def one(number: int) -> T:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"side-{number}")
        return jobs[number]()

    if threads <= 1 or len(jobs) <= 1:
        return [job() for job in jobs]
    with ThreadPoolExecutor(min(threads, len(jobs))) as pool:
        waiting = [pool.submit(inheritable_thread_target(spark)(one), number) for number in range(len(jobs))]
        return [w.result() for w in waiting]
