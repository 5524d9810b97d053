"""Sessions and the shared folder for intermediate tables."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from wikiloom.sources import snapshots


def build_session(master: str | None = None, partitions: int | None = None) -> SparkSession:
    builder = SparkSession.builder.appName("wikiloom")
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one run in the cluster's shared checkpoint folder.

    A local session without that setting gets a temporary folder; on a cluster the setting is
    required, since executors do not see each other's disks.
    """
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        shared = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class WorkFolder:
    """Tables a job writes once and reads several times, in shared storage.

    A written table cuts the lineage: what several later steps need is computed once, and losing
    an executor costs no more than reading it again.
    """

    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")

    @classmethod
    def scratch(cls, spark: SparkSession, name: str) -> WorkFolder:
        return cls(scratch_folder(spark, name))

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.mode("overwrite").parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def part(self, name: str) -> WorkFolder:
        return WorkFolder(f"{self.folder}/{name}")


class LedgerFolder(WorkFolder):
    """A work folder with a ledger: what a run has written is not written again when the run is repeated.

    The folder belongs to one run, with the same inputs each time. A step is entered when its table
    is complete, with the number of its rows, which is observed while they are written. The ledger
    is a folder of small files, one for each step.
    """

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__(folder)
        self.spark = spark
        self.used: set[str] = set()
        self.files = snapshots.Files(spark, folder)

    def _entry(self, name: str) -> str:
        return f"{self.folder}/ledger/{name}.json"

    def entry(self, name: str) -> dict | None:
        """What the ledger knows of a finished step."""
        return json.loads(self.files.read(self._entry(name))) if self.files.exists(self._entry(name)) else None

    def enter(self, name: str, **facts: int) -> None:
        self.files.publish(self._entry(name), json.dumps(facts))

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        if name in self.used:
            raise ValueError(f"two steps of a run are called {name}")
        self.used.add(name)
        if self.entry(name) is None:
            rows = Observation(f"rows-{uuid.uuid4().hex}")
            df.observe(rows, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{self.folder}/{name}")
            self.enter(name, **rows.get)
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def part(self, name: str) -> LedgerFolder:
        return LedgerFolder(self.spark, f"{self.folder}/{name}")


def keep(work: WorkFolder | None, df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of the work folder, or as it is without one."""
    return df if work is None else work.keep(df, name)
