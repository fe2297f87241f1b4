"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

# settings that may change while a session runs
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    # windows collect rows that are already sorted by series: a sort-based aggregate passes over them, while
    # the hash-based one gives up after 128 groups and sorts everything again
    "spark.sql.execution.useObjectHashAggregateExec": "false",
    # rows that go to Python are texts or long vectors: ten thousand of them are too much to hold at once
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}
DEFAULTS = {
    **RUNTIME,
    # recording the Python call site of every column slows the building of plans; turn on to debug
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # checkpoints are dropped when the DataFrame that owns them is no longer used
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app: str = "wattline", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session built elsewhere."""
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; only a local master may fall back to a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not named:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
            named = tempfile.mkdtemp(prefix="wattline-")
        context.setCheckpointDir(named)
    return named or context.getCheckpointDir()


_STORED: list[str] = []
_PLACES: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: for tables that several later
    passes scan, each needing other columns.  :func:`clear_stored` removes them at the end of a run."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    _STORED.append(path)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    _PLACES[back] = path
    return back


def _delete(spark: SparkSession, place: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    return bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))


def discard(df: DataFrame) -> None:
    """Delete a table that :func:`stored` returned and that nothing will read again."""
    place = _PLACES.pop(df, None)
    if place in _STORED:
        _STORED.remove(place)
        _delete(df.sparkSession, place)


def clear_stored(spark: SparkSession) -> int:
    """Delete the tables that :func:`stored` wrote in this process; returns how many."""
    removed = 0
    while _STORED:
        removed += _delete(spark, _STORED.pop())
    return removed


def frozen(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so that later reads all see the same rows and partitions."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
