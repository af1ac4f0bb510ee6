"""What the corpus operators share: tables, shared storage, batches of texts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: ASCII white space; a word is a longest run of anything else.
WORD = r"[^\x20\x09-\x0D]+"
#: Texts are worked on in groups of about this many bytes, whatever the size of Arrow's batches.
GROUP_BYTES = 1 << 20
SLICE_BYTES = 4 << 20
#: Rows of an intermediate table's file at least, of narrow rows and of such as hold sketches or sets.
NARROW_ROWS, WIDE_ROWS = 1 << 17, 1 << 13


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is named, a temporary one will do only if all run on this machine."""
    sc = spark.sparkContext
    place = sc._jsc.sc().getCheckpointDir()
    if place.isDefined():
        return place.get()
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="palimpsest-")
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def saved(df: DataFrame, name: str, rows: int | None = None, each: int = NARROW_ROWS) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again, which cuts its lineage: what was
    written survives any executor. It goes when the application ends.

    Where it is known that there are about ``rows`` rows at most, they go to a file for ``each`` of them at most, whatever the number of
    partitions: on a local folder Hadoop starts a process of the executor, which for a moment counts as large as the executor itself, for
    every file."""
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // each)))
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def beside(df: DataFrame, work: str, keep: list[str], outputs: str) -> tuple[DataFrame, str]:
    """Column ``work`` of ``df`` first, under a name of its own, then ``keep``; and the schema of ``keep`` with ``outputs`` behind. A
    column of ``keep`` that is named like an output (in any case) gives way to it."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import StructType

    taken = {f.name.lower() for f in StructType.fromDDL(outputs)}
    fields = [f for f in df.select(*keep).schema if f.name.lower() not in taken]
    quoted = lambda name: "`" + name.replace("`", "``") + "`"
    own = "_work"
    while own in df.columns:
        own += "_"
    schema = ", ".join([*[f"{quoted(f.name)} {f.dataType.simpleString()}" for f in fields], outputs])
    return df.select(F.col(work).alias(own), *[F.col(quoted(f.name)) for f in fields]), schema


def groups_of(texts: list, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of texts of about ``limit`` characters; one long text is a run by itself."""
    start = size = 0
    for k, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield start, k
            start, size = k, 0
        size += len(text)
    if len(texts) > start:
        yield start, len(texts)


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list | None]], schema: str) -> DataFrame:
    """``mapInArrow`` with one state a task: ``make`` returns a function from a batch to columns (or None). Arrow's batches
    are worked on in slices of about ``SLICE_BYTES``, so that a worker holds little more than one batch."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        work = make()
        for batch in batches:
            step = max(1, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes))
            for start in range(0, batch.num_rows, step):
                columns = work(batch.slice(start, step))
                if columns is not None:
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, kind)], schema=kind)

    return df.mapInArrow(run, schema)
