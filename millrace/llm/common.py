"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts and bytes per Arrow batch. They bound a Python worker's memory when texts are long.
BATCH_ROWS = 256
BATCH_BYTES = 16 << 20
#: Bytes of a file that are worth a task of their own.
SPREAD_BYTES = 1 << 20

_OWN: dict[str, str] = {}
#: Folders that written() has made, for each settled() that is under way.
_MADE: list[list[str]] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table that the reader would give to fewer tasks than there are cores, dealt out to as many as its
    size is worth. A large table has tasks enough and stays as it is; results are the same either way."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    read = re.match(r"\d+", spark.conf.get("spark.sql.files.maxPartitionBytes"))
    unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(spark.conf.get("spark.sql.files.maxPartitionBytes").lower()[len(read[0]) : len(read[0]) + 1], 1)
    tasks, worth = -(-size // (int(read[0]) * unit)), min(spark.sparkContext.defaultParallelism, -(-size // SPREAD_BYTES))
    return df.repartition(worth) if tasks < worth else df


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows and BATCH_BYTES bytes (a larger limit that the session
    has is lowered, a smaller one stays), so that a batch of long texts stays small; and this package
    sent to the executors, which need not have it installed. The limits are read when a plan is made,
    which is after this call, so they stay set."""
    ship(spark)
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        now = re.match(r"-?\d+$", spark.conf.get(name, None) or "")
        if not now or not 0 < int(now[0]) <= most:
            spark.conf.set(name, str(most))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application."""
    sc = spark.sparkContext
    if _OWN.get("shipped") == sc.applicationId:
        return
    top = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="millrace-")) / f"{top.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(str(target))
    _OWN["shipped"] = sc.applicationId


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir as the session
    has it. Only where that is unset (single-machine tests) a temporary folder is made."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_dir:
        return set_dir.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = "file://" + tempfile.mkdtemp(prefix="millrace-")
    return _OWN["dir"]


def written(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: lineage is cut, nothing
    is kept on one executor only, and the plan above sees true sizes. What the executors have shuffled for
    it goes with it, as nothing reads that again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    for made in _MADE[-1:]:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> DataFrame:
    """What make() returns, written; all else that written() has made meanwhile goes."""
    _MADE.append([])
    out = None
    try:
        out = written(make(), label)
    finally:
        made = _MADE.pop()
        keep = made[-1:] if out is not None else []
        _delete(spark, set(made) - set(keep))
        for outer in _MADE[-1:]:
            outer += keep
    return out


def release(spark: SparkSession) -> None:
    """Have Spark drop the shuffle files of plans that nobody holds any more. It does so when the driver collects
    garbage, by itself only every half hour."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_written(spark: SparkSession, *frames: DataFrame) -> None:
    """Remove the files of frames that written() made and nobody reads any more. What a lazy result
    still reads cannot go; that stays in the shared folder until the caller clears it."""
    _delete(spark, {f.rsplit("/", 1)[0] for df in frames for f in df.inputFiles()})


def _delete(spark: SparkSession, folders: Iterable[str]) -> None:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; null ids count as remainder 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % n, F.lit(0)).cast("int")


def text_struct(fn: Callable[[], Callable[[list], dict]], schema: pa.Schema, ddl: str) -> Callable[[Column], Column]:
    """A vectorised struct-valued expression over a text column.

    fn() runs once per task and returns what maps a list of texts to columns. The expression
    is marked non-deterministic only so that the optimizer never evaluates it twice.
    """
    kind = pa.struct(list(schema))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        score = fn()
        for batch in batches:
            texts = batch.to_pylist()
            cols = score(texts)
            yield pa.StructArray.from_arrays([pa.array(cols[f.name], type=f.type) for f in schema], fields=list(kind))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, returnType=ddl).asNondeterministic()


def free_name(df: DataFrame, label: str) -> str:
    """A column name that the frame does not have yet, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    name = f"__millrace_{label}"
    while name.lower() in taken:
        name += "_"
    return name


def salts_seen(salt: str) -> Column:
    """Aggregate: the salts (under 64) that a key's rows have, as bits of a long."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col(salt)))


def salts_of(bits: str, salts: int) -> Column:
    """Those salts as an array: a key needs a copy for each of them, and so never more than it has rows."""
    return F.filter(F.sequence(F.lit(0), F.lit(salts - 1)), lambda i: F.col(bits).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) != 0)


_SPAN = 1 << 40


def sampled(rows: DataFrame, limit: int, *key: str) -> DataFrame:
    """A bounded, repeatable sample: at most `limit` distinct keys, those of the least hash. The bound on
    the hash follows from the number of rows, so that tasks send about `limit` keys together, and
    nothing depends on the order of tasks. Adds the column `order_`, the hash."""
    total = rows.count()
    hashed = rows.withColumn("order_", F.pmod(F.xxhash64(*key, F.lit(7)), F.lit(_SPAN)))
    if total > limit:
        hashed = hashed.filter(F.col("order_") < int(_SPAN * min(1.0, 1.2 * limit / total)))
    return hashed


def labelled_texts(docs: DataFrame, labels: DataFrame, column: str, limit: int) -> DataFrame:
    """(id, y, text) of at most `limit` labelled ids, the bounded sample that a classifier is fitted
    on. Ids may be of any type. An id labelled twice counts as positive if either row is; one with several texts
    gives the text of the least hash, so a hot id never gathers."""
    known = labels.filter(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("id"), (F.col(column) > 0).cast("double").alias("y"))
    chosen = sampled(known, limit, "id").groupBy("order_", "id").agg(F.max("y").alias("y")).orderBy("order_", "id").limit(limit).select("id", "y")
    # at most `limit` rows of an id and a number: a proven bound
    joined = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(chosen), "id")
    one = joined.groupBy("id").agg(F.max("y").alias("y"), F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    return one.select("id", "y", "t.text")
