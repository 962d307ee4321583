"""Tables written to the folder that driver and executors share, to cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where no folder is set and driver and executors are on one machine, as in tests.
OWN_CHECKPOINT_DIR = "/tmp/seshat-checkpoints"


#: Rows of keys that are sent to all tasks at most, some tens of MB; more meet wide rows in a shuffle.
FEW_KEYS = 500_000


def few(keys: DataFrame, rows: int | None = None, limit: int = FEW_KEYS) -> DataFrame:
    """``keys``, to be broadcast if they are at most ``limit`` rows, so that the rows they are looked up for stay where they
    are. ``rows`` is their number, if it is known; else they are counted, so they should be a written table."""
    return F.broadcast(keys) if (keys.count() if rows is None else rows) <= limit else keys


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, or the context's checkpoint folder.

    Where neither is set, OWN_CHECKPOINT_DIR on a local master; on any other it is an error, as executors would write to
    folders of their own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = OWN_CHECKPOINT_DIR
    return folder.rstrip("/")


class Staging:
    """A folder of written tables for one run of an operator.

    ``write`` runs a plan once and returns a scan of its rows. The files outlive a lost executor, and
    Spark knows their size, so that later joins broadcast them only below autoBroadcastJoinThreshold.
    ``drop`` deletes a table that no later plan reads; ``drop_all`` all of a session, when its results have been read.
    """

    _written: list[Staging] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self._written.append(self)
        self.root = f"{shared_folder(spark)}/seshat-{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    @classmethod
    def drop_all(cls, spark: SparkSession) -> None:
        """Deletes all that operators have left in this session, tables that their results read included."""
        for staged in [s for s in cls._written if s.spark is spark]:
            staged.drop("")
            cls._written.remove(staged)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
