"""What the corpus operators share: reading tables, splitting rows, and writing intermediate tables.

Every operator selects the columns it needs first, so that extra columns, whatever their names, neither reach
the work nor clash with a column that is added.
"""

from __future__ import annotations

import functools
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(ids: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``. A null id counts as the empty string."""
    return F.crc32(F.coalesce(ids.cast("string"), F.lit("")).cast("binary")) % divisor


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a temporary folder serves
    a local master; on a cluster that would be another folder on each machine, so there it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset; set it to a folder that the driver and all executors share")
        folder = _local_folder()
    return folder.rstrip("/")


@functools.cache
def _local_folder() -> str:
    return f"file://{tempfile.mkdtemp(prefix='workpulse-')}"


@contextmanager
def small_batches(spark: SparkSession, n: int = 16 << 20) -> Iterator[None]:
    """Arrow batches of about ``n`` bytes between executors and their Python workers for what runs inside, so that long
    texts don't fill either; the session's own setting holds again afterwards."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(n))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def byte_slices(batch: pa.RecordBatch, rows: int = 512, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows that hold about ``size`` bytes of text at most, or one row."""
    sizes = np.zeros(batch.num_rows, dtype=np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        elif pa.types.is_list(column.type) and pa.types.is_string(column.type.value_type):
            ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
            before = np.cumsum(np.append(0, pc.fill_null(pc.binary_length(column.flatten()), 0).to_numpy(zero_copy_only=False)))
            sizes += np.diff(before[ends], prepend=0)
    at, ends = 0, np.cumsum(sizes)
    while at < batch.num_rows:
        before = ends[at] - sizes[at]
        stop = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size, side="right"))))
        yield batch.slice(at, stop - at)
        at = stop


def texts_of(batch: pa.RecordBatch, column: int) -> Iterator[str | None]:
    """A column's texts, few of them as Python objects at a time."""
    for part in byte_slices(batch.select([column])):
        yield from part.column(0).to_pylist()


_KEPT: dict[str, object] = {}


def once(token: str, build: Callable[[], object]):
    """What ``build`` makes, made once by a worker process and kept for its next tasks until another token comes."""
    if token not in _KEPT:
        forget()
        _KEPT[token] = build()
    return _KEPT[token]


def forget() -> None:
    """Drops what ``once`` keeps, and gives back memory that Arrow holds unused. Workers serve the tasks of one operator
    after another: each of them begins with this, so that a worker holds one operator's state and not all of theirs."""
    _KEPT.clear()
    pa.default_memory_pool().release_unused()


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder (``options`` are the writer's), and read again.

    The lineage ends here: a lost executor costs a read of this table, not the work before it, and rows whose
    computation isn't repeatable (ids given by a task) are fixed by the write.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_written(df: DataFrame) -> None:
    """Deletes the files of a table from ``written`` that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(conf).delete(path, True)


def bounded_sample(rows: DataFrame, key: str, n: int) -> DataFrame:
    """At most ``n`` rows, those with the smallest hashes of ``key``: the same ones whatever the partitions.

    Where there are many more rows, a threshold on the hash leaves a few more than ``n`` before they are sorted, so
    tasks send the driver no more than that together.
    """
    total = rows.count()
    place = F.shiftrightunsigned(F.xxhash64(key, F.lit("sample")), 12) / F.lit(float(1 << 52))
    if total > 2 * n:
        rows = rows.where(place < 1.4 * n / total)
    return rows.orderBy(place, *rows.columns).limit(n)


def rows_out(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def map_rows(
    df: DataFrame, schema: str, start: Callable[[], Callable[..., tuple]], arrow: pa.Schema
) -> DataFrame:
    """One output row for each input row: ``start()`` runs once a task and returns the function of a row's values.

    Batches are cut into slices of few rows and bytes, so a task holds little as Python objects at a time.
    """

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = start()
        for batch in batches:
            for part in byte_slices(batch):
                values = [column.to_pylist() for column in part.columns]
                yield rows_out([each(*row) for row in zip(*values)], arrow)

    return df.mapInArrow(mapped, schema)


def map_whole_rows(
    df: DataFrame, text_col: str, start: Callable[[], Callable[[list[str | None]], tuple[list[bool], dict[str, list]]]]
) -> DataFrame:
    """Rows of ``df``, all columns, filtered and edited by their texts alone: the function that ``start()`` returns
    gives which rows stay, and new values of the columns that change. Nothing is shuffled."""
    schema = df.schema
    at_text = df.columns.index(text_col)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = start()
        for batch in batches:
            for part in byte_slices(batch):
                keep, changed = judge(part.column(at_text).to_pylist())
                for name, values in changed.items():
                    i = part.schema.get_field_index(name)
                    part = part.set_column(i, part.schema.field(i), pa.array(values, part.schema.field(i).type))
                yield part.filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(mapped, schema)


def ranges(starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after another."""
    sizes = stops - starts
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    before = np.cumsum(sizes) - sizes
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, sizes)


def tokenizer_path(path: str | None) -> str:
    """``path``, or the public word tokenizer of this machine."""
    if path and os.path.exists(path):
        return path
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
