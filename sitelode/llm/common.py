"""Shared helpers: text as byte arrays, words and their hashes, checkpoints, driver-side samples."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Texts are worked on in blocks of about this many bytes, whatever an Arrow batch holds; one longer text is one block.
BLOCK_BYTES = 1 << 20

# Bits of the filter on keys of rows.
FILTER_BITS = 26

_MULTIPLIER = 0x9E3779B97F4A7C15


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of the session; a local one of our own only where a local session names none."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
            folder = tempfile.mkdtemp(prefix="sitelode-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder below the shared one."""
    return f"{checkpoint_folder(spark)}/{label}-{uuid.uuid4().hex}"


def checkpointed(rows: DataFrame) -> DataFrame:
    """``rows`` written to the shared checkpoint folder of the session, and read from there from now on."""
    checkpoint_folder(rows.sparkSession)
    return rows.checkpoint()


def quoted(name: str) -> str:
    """A column's name as one part, whatever it holds."""
    return "`" + name.replace("`", "``") + "`"


def split_by(rows: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose 64-bit ``key`` may be among the only column of ``keys``, and those whose isn't.

    A bitmap of fixed size tells, 64 bits a row: at most 2^20 rows of two numbers, which are broadcast. A false positive
    costs only a row that is shuffled later on.
    """

    def place(of: Column) -> tuple[Column, Column]:
        low = of.bitwiseAND((1 << FILTER_BITS) - 1)
        return F.shiftright(low, 6).alias("_word"), F.call_function("shiftleft", F.lit(1).cast("long"), of.bitwiseAND(63).cast("int")).alias("_bit")

    (own,) = keys.columns
    bits = F.broadcast(keys.select(*place(F.col(quoted(own)))).groupBy("_word").agg(F.bit_or("_bit").alias("_bits")))
    known = rows.select("*", *place(key)).join(bits, "_word", "left").withColumn("_maybe", F.coalesce(F.col("_bits").bitwiseAND(F.col("_bit")) != 0, F.lit(False)))
    names = [quoted(c) for c in rows.columns]
    return known.where("_maybe").select(*names), known.where("NOT _maybe").select(*names)


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts


def sampled(rows: DataFrame, order: str, most: int) -> DataFrame:
    """At most ``most`` rows of different values in ``order``, a column of 64-bit hashes: those of the smallest hashes.

    A fixed choice: it depends neither on partitions nor on how often a value is repeated. Of many rows only those below
    a bound on the hash are told apart and sorted. The bound is a guess from the estimated number of different hashes,
    and rises until enough lie below it.
    """
    column, low, high = F.col(order), -(2**63), 2**63 - 1
    different = rows.agg(F.approx_count_distinct(order)).first()[0]
    bound = min(high, low + int(1.25 * most / max(1, different) * 2**64))
    while bound < high and rows.where(column <= bound).select(order).distinct().count() < most:
        bound = min(high, low + 4 * (bound - low))
    # The last hash that is taken, from hashes alone, so that whole rows meet in no one task.
    last = rows.where(column <= bound).select(order).distinct().orderBy(order).limit(most).agg(F.max(order)).first()[0]
    return rows.where(column <= (low if last is None else last)).dropDuplicates([order])


def sampled_each(rows: DataFrame, group: str, order: str, most: int) -> DataFrame:
    """The same for each value of the column ``group``: at most ``most`` rows of different hashes, the smallest ones.

    Bounds are a small table with a row per value, which rise until enough hashes lie below them in every group.
    """
    spread = 2.0**64
    bounds = rows.groupBy(group).agg((F.least(F.lit(1.0), 1.25 * most / F.approx_count_distinct(order)) * spread - spread / 2).alias("bound"))
    # Doubles that stand for the greatest hashes reach beyond them.
    below = F.col(order).cast("double") <= F.col("bound")
    while True:
        bounds = rows.sparkSession.createDataFrame(bounds.toArrow()) if bounds.limit(1).count() else bounds
        near = rows.join(bounds, group).where(below)
        few = near.groupBy(group).agg(F.countDistinct(order).alias("n"), F.max("bound").alias("bound")).where((F.col("n") < most) & (F.col("bound") < spread / 2))
        if not few.limit(1).count():
            break
        risen = F.least(F.lit(spread / 2), 4 * F.col("bound") + 1.5 * spread)
        bounds = bounds.join(few.select(group, F.lit(True).alias("few")), group, "left").select(group, F.when(F.col("few"), risen).otherwise(F.col("bound")).alias("bound"))
    place = F.row_number().over(Window.partitionBy(group).orderBy(order))
    # Groups are of little more than ``most`` rows by now.
    return near.drop("bound").dropDuplicates([group, order]).withColumn("place", place).where(F.col("place") <= most).drop("place")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array, and where each text begins (one more than there are texts); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    first, last = int(bounds[0]), int(bounds[-1])
    body = np.frombuffer(data, np.uint8)[first:last] if data is not None and last > first else np.zeros(0, np.uint8)
    return body, bounds - first


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``column`` in blocks of whole texts: the first row, the bytes, the bounds in them."""
    data, bounds = utf8(column)
    row, rows = 0, len(bounds) - 1
    while row < rows:
        stop = max(row + 1, int(np.searchsorted(bounds, bounds[row] + most, "right")) - 1)
        yield row, data[bounds[row] : bounds[stop]], bounds[row : stop + 1] - bounds[row]
        row = stop


def byte_table(*ranges: tuple[int, int], inverse: bool = False) -> np.ndarray:
    """A truth value for each byte: in one of the (closed) ranges, or in none of them."""
    out = np.zeros(256, bool)
    for first, last in ranges:
        out[first : last + 1] = True
    return ~out if inverse else out


# Bytes of words that white space parts, and lower-casing of A-Z.
NOT_BLANK = byte_table((0x20, 0x20), (0x09, 0x0D), inverse=True)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, bounds: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of each text's first word (one more than there are texts)."""
    inside = letters[data]
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(bounds), np.int64)
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    edges = bounds[:-1][bounds[:-1] < len(data)]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    lasts = bounds[1:][bounds[1:] > 0] - 1
    after[lasts] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit depends on all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: int = _MULTIPLIER) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_TABLE = {"powers": powers(256)}


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    longest = int(lengths.max())
    if longest > len(_TABLE["powers"]):
        _TABLE["powers"] = powers(2 * longest)
    firsts = np.cumsum(lengths) - lengths
    within = np.arange(int(lengths.sum())) - np.repeat(firsts, lengths)
    letters = data[within + np.repeat(starts, lengths)]
    sums = np.add.reduceat((letters.astype(np.uint64) + np.uint64(1)) * _TABLE["powers"][within], firsts)
    return mixed(sums + lengths.astype(np.uint64))


def runs(n: np.ndarray) -> np.ndarray:
    """0 .. n[0]-1, 0 .. n[1]-1, and so on."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
