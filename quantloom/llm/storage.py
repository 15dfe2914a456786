"""Stage tables in the folder that all executors share.

Lineage is cut with Parquet tables below ``spark.checkpoint.dir``: they survive
lost executors, are compressed, and later readers prune their columns.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_own: dict[str, str] = {}
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where unset, a temporary folder in local mode, and on a cluster the warehouse if it lies in a shared store."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            _own[app] = tempfile.mkdtemp(prefix="quantloom-")
            atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        else:
            where = spark.conf.get("spark.sql.warehouse.dir", "")
            if not where or where.startswith("file:") or "://" not in where:
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            _own[app] = where.rstrip("/") + "/_stages"
    return _own[app]


#: Rows and bytes of whole texts that go to a Python worker at once, so that two workers fit beside an executor's heap.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
#: Characters that an operator's function is given at once; a longer text comes alone.
AT_ONCE = 1 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS rows and BATCH_BYTES bytes; never raised, and left so, as plans run later."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        found = spark.conf.get(key).removesuffix("b")
        if not found.isdigit() or not 0 < int(found) <= most:
            spark.conf.set(key, most)


def map_texts(docs: DataFrame, keep: Sequence[str], text_col: str, added: StructType, f: Callable[[list[str | None]], Sequence[Sequence]]) -> DataFrame:
    """``keep`` of every row, untouched whatever its types, and the columns ``added`` that ``f`` makes of the texts.

    ``f`` gets the texts of some neighbouring rows, about AT_ONCE characters together, and returns a sequence for each added column.
    """
    small_batches(docs.sparkSession)
    inner = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)), F.col(f"`{text_col}`").cast("string").alias("text"))  # no two names alike
    schema = StructType([*docs.select(*(F.col(f"`{c}`") for c in keep)).schema.fields, *added.fields])
    arrow = to_arrow_schema(schema)
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(n).to_pylist()
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end] or "") <= AT_ONCE):
                    size += len(texts[end] or "")
                    end += 1
                made = f(texts[at:end])
                fields = list(arrow)
                columns = [b.column(i).slice(at, end - at) for i in range(n)]
                columns += [pa.array(x, type=fields[n + k].type) for k, x in enumerate(made)]
                yield pa.RecordBatch.from_arrays([c.cast(t.type) if c.type != t.type else c for c, t in zip(columns, fields, strict=True)], names=arrow.names)
                at = end

    return inner.mapInArrow(run, schema)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; readers see one fixed result."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bits for each value that ``marked`` looks for, as a power of two, and the power of two of all bits, at least and at most: the table has a row for 64 bits.
PER_VALUE, LEAST_BITS, MOST_BITS = 4, 12, 24


def marked(rows: DataFrame, key: str, wanted: DataFrame, flag: str) -> DataFrame:
    """``rows`` and ``flag``, true wherever the hash ``key`` is one of ``wanted``'s, and for some others; null nowhere.

    A bit table of ``wanted``'s keys is broadcast, at most 2**18 longs, so that what is surely not wanted need not be shuffled. With very many
    keys it marks more of the others. ``wanted`` is a stage table: it is read twice.
    """
    size = 1 << min(MOST_BITS, max(LEAST_BITS, wanted.count().bit_length() + PER_VALUE))
    slot = F.pmod(F.col(key), F.lit(size)).cast("long")
    bit = F.expr("shiftleft(1L, cast(_slot & 63 as int))")
    table = wanted.select(slot.alias("_slot")).groupBy(F.shiftright("_slot", 6).alias("_at")).agg(F.bit_or(bit).alias("_bits"))
    found = rows.withColumn("_slot", slot).join(F.broadcast(table), F.shiftright("_slot", 6) == F.col("_at"), "left")
    return found.withColumn(flag, F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))).drop("_slot", "_at", "_bits")


def written() -> list[str]:
    """Stage tables of this process, oldest first."""
    return list(_written)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete stage tables. Call only when nothing that reads them is still to run."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
        if p in _written:
            _written.remove(p)
