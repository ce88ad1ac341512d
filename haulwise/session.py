"""Session set-up and the lineage helpers shared by the iterative operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

# Runtime settings every job of this package relies on. All can be changed on a live session.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join side even when the aggregate above then needs one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Keep streaming state off the heap.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # A batch uploads the state it changed; whole snapshots follow in the background.
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def build_session(app_name: str = "haulwise", master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """Create (or reuse) a session; cluster sizing stays with spark-submit."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    return apply_runtime_conf(builder.getOrCreate())


def apply_runtime_conf(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder for written intermediate tables: the one the cluster names, or a temporary one in local mode only."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    own = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The next round of a loop then starts from files that outlive any executor, and Catalyst sees their true size,
    so its own broadcast decision rests on a measured number.
    """
    return cut_and_measure(df)[0]


def cut_and_measure(df: DataFrame, **figures: Column) -> tuple[DataFrame, dict]:
    """``cut_lineage`` that also returns aggregate figures, taken while the rows are written instead of by a second job."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    if figures:
        observation = Observation()
        df.observe(observation, *[column.alias(name) for name, column in figures.items()]).write.parquet(path)
        measured = observation.get
    else:
        df.write.parquet(path)
        measured = {}
    return spark.read.schema(df.schema).parquet(path), measured


def cut_in_buckets(df: DataFrame, buckets: int, *keys: str, distinct: bool = False) -> DataFrame:
    """``cut_lineage`` into hash buckets of ``keys``, one sorted file each.

    A join on just these keys then moves its other side only. With ``distinct`` equal rows, which share a bucket, are dropped there. The catalogue entry that carries the bucketing is dropped at
    once; the frame keeps what it has read from it, and the files lie in the shared folder.
    """
    spark = df.sparkSession
    name = f"buckets_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}"
    dealt = df.repartition(buckets, *keys)
    dealt = dealt.dropDuplicates() if distinct else dealt
    dealt.write.bucketBy(buckets, *keys).sortBy(*keys).format("parquet").option("path", path).saveAsTable(name)
    stored = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return stored


@contextmanager
def joined_by_fewer_keys(spark: SparkSession) -> Iterator[None]:
    """Joins inside leave tables where they are that are dealt by some of the keys only."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class BucketLog:
    """A bucketed table in the shared folder that grows by one set of files a round; ``rows`` reads it with its buckets.

    ``add`` takes a frame that is dealt into the same buckets already, or deals it. Use as a context manager: the catalogue entry
    is dropped at the end, frames read before keep their files.
    """

    def __init__(self, spark: SparkSession, buckets: int, key: str, *sort: str) -> None:
        self._spark, self._buckets, self._key, self._sort = spark, buckets, key, sort
        self._name = f"buckets_{uuid.uuid4().hex}"
        self._path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{self._name}"

    def __enter__(self) -> BucketLog:
        return self

    def __exit__(self, *_) -> None:
        self._spark.sql(f"DROP TABLE IF EXISTS {self._name}")

    def add(self, df: DataFrame, deal: bool = False) -> int:
        """Append the rows and return how many there were."""
        observation = Observation()
        dealt = df.repartition(self._buckets, self._key) if deal else df
        dealt.observe(observation, F.count(F.lit(1)).alias("n")).write.mode("append").bucketBy(self._buckets, self._key).sortBy(
            self._key, *self._sort
        ).format("parquet").option("path", self._path).option("compression", "zstd").saveAsTable(self._name)
        self._spark.catalog.refreshTable(self._name)
        return observation.get["n"]

    def rows(self) -> DataFrame:
        return self._spark.table(self._name)
