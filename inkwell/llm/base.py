"""What the operators of this package share: reading, shared-folder tables, and small expression helpers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.sources.tables import spread

#: White space between words, fixed by the contract of the word-based operators: space and 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; documents are dealt over all cores where a few files would leave most of them idle."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name == "documents" else rows


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir or the context's checkpoint folder names it.

    Without one a run of a single machine takes a temporary folder; on a cluster that would be another disk on every machine, so
    there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="inkwell-checkpoint-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/inkwell-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def deleted(*tables: DataFrame) -> None:
    """Deletes tables that `stored` wrote and nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file).getParent()
            if folder.getName().startswith("inkwell-"):
                folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def released(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes tables, and lets Spark delete the shuffle files of finished steps."""
    deleted(*tables)
    returned(spark)


def returned(spark: SparkSession) -> None:
    """Collects garbage in the driver's Python and JVM, and gives what both hold of freed native memory back to the system.

    What a step took at its peak would otherwise stay with the allocators and stand beside the peaks of all later steps. Where
    an allocator or a JVM has no call for that, it keeps its memory.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
    spark.sparkContext._jvm.System.gc()
    with contextlib.suppress(Py4JError):
        _trim(spark)


def _trim(spark: SparkSession) -> str:
    """The JVM's own malloc_trim, a diagnostic command since JDK 17.0.9: its report. By reflection, since py4j cannot call the server's hidden class."""
    jvm, new_array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    values = new_array(jvm.Object, 4)
    values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    return invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)


#: Bytes of rows that go to Python at once; one row more than fits.
BATCH_BYTES, _BYTES = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def mapped(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """rows.mapInArrow with batches of bounded bytes.

    By default a batch is 10,000 rows or 64 MB, and stands in the executor and in the worker of each of its tasks, in buffers that
    grow by doubling. The bound is a setting of the session, which holds when the plan is made, so it stays;
    results do not depend on it, and a smaller number of bytes is left as it is.
    """
    conf = rows.sparkSession.conf
    own = re.fullmatch(r"([0-9]+)b?", conf.get(_BYTES))
    if own is None or int(own[1]) > BATCH_BYTES:
        conf.set(_BYTES, str(BATCH_BYTES))
    return rows.mapInArrow(run, schema)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for each row, however often body refers to it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


#: Rows up to which a table of known size is broadcast.
SMALL = 200_000


def bounded(small: DataFrame) -> DataFrame:
    """small, marked for broadcast where a count of it allows that; beyond, its joins shuffle."""
    return F.broadcast(small) if small.limit(SMALL + 1).count() <= SMALL else small
