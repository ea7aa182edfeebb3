"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

#: Stands for a null identifier inside the operators: it ranks after every real one.
NO_ID = (1 << 63) - 1

#: ASCII white space, the only separators of words: space and \t \n \v \f \r.
WHITE = b" \t\n\x0b\x0c\r"
IS_WHITE = np.zeros(256, bool)
IS_WHITE[list(WHITE)] = True


def read(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns id (long, NO_ID for null) and text (null as empty), after `keep` as _0, _1 ...; other columns go.

    A row whose identifier is NO_ID itself counts as one without.
    """
    return docs.select(
        *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(keep)],
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )


def real_id(col: str = "id"):
    """The identifier as the caller knows it: NO_ID is null again."""
    return F.when(F.col(col) != F.lit(NO_ID), F.col(col))


def with_fields(schema: StructType, **added: str) -> StructType:
    """A copy of a schema (a frame's own one is shared) with more fields, by name and type."""
    return StructType([*schema.fields, *(StructField(n, _parse_datatype_string(t)) for n, t in added.items())])


def groups_for(text_bytes: int | None, mb: float, least: int = 1) -> int:
    return max(least, -(-int(text_bytes or 0) // int(mb * 1e6)))


def text_bytes(rows: DataFrame) -> int:
    return rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir. Only a local session, as in tests, may do without; it gets a temporary one."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="shared"))
    return sc.getCheckpointDir()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a written table, wherever Spark's file systems have it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def let_go(spark: SparkSession) -> None:
    """Shuffles and checkpoints that nothing refers to any more go now; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def giving_back(run: Callable) -> Callable:
    """A mapInArrow function that, once through, gives freed memory back to the machine: workers live on for later stages."""

    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # glibc only
            ctypes.CDLL(None).malloc_trim(0)

    return whole


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def utf8(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows, from 0) and the bytes of a string or binary column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if len(col) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    _, ends, data = col.buffers()
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    ends = np.frombuffer(ends, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return ends - ends[0], data[ends[0] : ends[-1]]


def chunks(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows [a, b) of up to `most` bytes together; a longer row comes alone and whole."""
    a, n = 0, len(ends) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + most, "right")) - 1)
        yield a, b
        a = b


def words_of(buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the words of all rows; a row's end also ends a word."""
    inside = np.zeros(len(buf) + 1, bool)
    inside[:-1] = ~IS_WHITE[buf]
    before = np.empty(len(buf) + 1, bool)
    before[0] = False
    before[1:] = inside[:-1]
    first = np.zeros(len(buf) + 1, bool)
    first[ends] = True
    starts = np.flatnonzero(inside & (~before | first))
    stops = np.flatnonzero(before & (~inside | first))
    return starts, stops, np.searchsorted(ends, starts, "right") - 1


def _gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all spans, one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def interned(buf: np.ndarray, starts: np.ndarray, stops: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """A number for each span buf[start:stop], the same for equal bytes only. hashed: their hashes, which may collide."""
    _, first, number = np.unique(hashed, return_index=True, return_inverse=True)
    sizes = stops - starts
    own = np.flatnonzero(first[number] != np.arange(len(number)))
    other = first[number[own]]
    same = np.array_equal(sizes[own], sizes[other]) and np.array_equal(buf[_gather(starts[own], sizes[own])], buf[_gather(starts[other], sizes[other])])
    if same:
        return number
    raw, numbers = buf.tobytes(), {}
    return np.array([numbers.setdefault(raw[i:j], len(numbers)) for i, j in zip(starts.tolist(), stops.tolist(), strict=True)], np.int64)


def pair_numbers(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each pair of numbers, dense from 0."""
    return np.unique(a.astype(np.int64) * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]
