"""Exact top-k inner products: vectors by falling length, partial sums in a rotated space, Cauchy-Schwarz bounds.

Candidates lie in order of length over the partitions. A rotation by the singular vectors of all candidates puts most of
a product into its first sums; the lengths of what is left bound the rest, and a query passes over every candidate whose
bound is below its k-th best. Queries come in blocks of fixed size, each block over all candidates; before that, the
longest candidates give every query a first k-th best. What is left is scored in whole numbers.

Cases: a vector that is null, or holds null or a number that isn't finite, takes no part; nor does a row without an id;
vectors of fewer components count as if zeros followed; a row is a query and a candidate of its own, also where it
repeats another or shares its id, and only the row itself is no candidate of its query; ties go to the smaller id; a
score beyond 64 bits counts as the greatest or least number of them; a query with fewer candidates than k gets them
all, and an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelode.llm.common import checkpointed, table

K = 5
# Queries of a block; candidates that give the first bounds; candidates whose bounds are looked at together.
QUERIES_PER_BLOCK = 4096
LONGEST = 2048
STEP = 512
# Pairs whose vectors are gathered together.
PIECE = 1 << 14
# Rotated components that are summed first.
PARTS = (8, 24)
# Whole numbers and sums below these are exact in doubles, and in 64-bit integers.
EXACT = float(1 << 53)
LONG = float(1 << 62)
GREATEST = (1 << 63) - 1
# Bounds are raised by this share of the lengths for what floating point may lose.
SLACK = 1e-9


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def integer_vectors(rows: DataFrame, id_column: str, vector_column: str, scale: int) -> DataFrame:
    """``vec_id, vector`` of the rows that take part: whole numbers as doubles, which beyond 2^53 all doubles are."""

    def whole(x: Column) -> Column:
        scaled = F.lit(float(scale)) * x.cast("double")
        return F.when(F.abs(scaled) < EXACT, F.floor(scaled).cast("double")).otherwise(scaled)

    taken = rows.where(F.col(id_column).isNotNull() & usable(F.col(vector_column)))
    return taken.select(F.col(id_column).alias("vec_id"), F.transform(F.col(vector_column), whole).alias("vector"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """One row of floats per list; zeros follow a short one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), width))
    at = np.repeat(np.arange(len(sizes)), sizes)
    out[at, np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """Right singular vectors of all candidates, by their matrix of products: one small matrix per task is added up."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = matrix(batch.column(0), width)
            total += x.T @ x
        cells = np.arange(width * width)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total.ravel())], names=["cell", "value"])

    found = vectors.select("vector").mapInArrow(products, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    gram = np.zeros(width * width)
    gram[found.column("cell").to_numpy()] = found.column("value").to_numpy()
    gram = gram.reshape(width, width)
    return np.linalg.eigh((gram + gram.T) / 2)[1][:, ::-1].copy()


class Block:
    """Queries of a block: rotated vectors, lengths of what follows each part, and each one's k-th best so far."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, turn: np.ndarray, k: int):
        self.rows, self.ids, self.vectors, self.k = rows, ids, vectors, k
        self.rotated = vectors @ turn
        self.lengths, self.rests = lengths(self.rotated)
        self.best = np.full(len(ids), -np.inf)

    def top(self, ids: np.ndarray, scores: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Places of the k greatest of each query, ties by smaller id."""
        order = np.lexsort((ids, -scores, query))
        first = np.searchsorted(query[order], query[order])
        return order[np.arange(len(order)) - first < self.k]


def lengths(rotated: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The length of each row, and of its components after each part."""
    return np.linalg.norm(rotated, axis=1), [np.linalg.norm(rotated[:, p:], axis=1) for p in PARTS]


def products(queries: np.ndarray, some: np.ndarray, candidates: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Products of the pairs i, j, exactly; ``most`` bounds each one's size.

    Many pairs are taken from all, few are done in pieces. Doubles, 64-bit integers and Python's are used as the bounds
    ask for; beyond 64 bits the result is at their end.
    """
    out = np.empty(len(i), np.int64)
    plain = most < EXACT
    if plain.all() and 8 * len(i) > len(some) * len(candidates):
        return (queries[some] @ candidates.T)[i, j].astype(np.int64)
    for kind, chosen in ((np.float64, plain), (np.int64, ~plain & (most < LONG)), (object, most >= LONG)):
        at = np.flatnonzero(chosen)
        for k in range(0, len(at), PIECE):
            piece = at[k : k + PIECE]
            left, right = queries[some[i[piece]]], candidates[j[piece]]
            if kind is object:
                sums = (sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for x, y in zip(left.tolist(), right.tolist(), strict=True))
                out[piece] = [max(-GREATEST, min(GREATEST, x)) for x in sums]
            else:
                out[piece] = np.einsum("ij,ij->i", left.astype(kind), right.astype(kind))
    return out


def scan(block: Block, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, candidate and score of what may be among a query's k best; ``block.best`` rises.

    The candidates are of falling length.
    """
    rotated = vectors @ turn
    length, rest = lengths(rotated)
    query, place, score = (np.zeros(0, np.int64) for _ in range(3))
    for low in range(0, len(ids), STEP):
        here = slice(low, low + STEP)
        slack = SLACK * (block.lengths * length[low] + 1)
        some = np.flatnonzero(block.lengths * length[low] + slack >= block.best)
        if not len(some):
            if (block.lengths * length[low] + slack < block.best).all():
                break  # candidates only get shorter
            continue
        partial, done, alive = np.zeros((len(some), len(length[here]))), 0, None
        for part, rest_q, rest_c in zip(PARTS, block.rests, rest, strict=True):
            partial += block.rotated[some, done:part] @ rotated[here, done:part].T
            done = part
            alive = partial + np.outer(rest_q[some], rest_c[here]) + slack[some, None] >= block.best[some, None]
            keep = alive.any(axis=1)
            some, partial, alive = some[keep], partial[keep], alive[keep]
        i, j = np.nonzero(alive & (block.rows[some][:, None] != rows[here][None, :]))
        if not len(i):
            continue
        exact = products(block.vectors, some, vectors[here], i, j, 1.001 * block.lengths[some[i]] * length[here][j])
        query, place, score = np.concatenate([query, some[i]]), np.concatenate([place, low + j]), np.concatenate([score, exact])
        kept = block.top(ids[place], score, query)
        query, place, score = query[kept], place[kept], score[kept]
        full = np.bincount(query, minlength=len(block.ids)) >= block.k
        least = np.full(len(block.ids), np.inf)
        np.minimum.at(least, query, score.astype(np.float64))
        block.best = np.where(full, np.maximum(block.best, least), block.best)
    return query, ids[place], score


def searched(candidates: DataFrame, block: Block, turn: np.ndarray, width: int) -> DataFrame:
    """``query, query_id, vec_id, score``: at most k rows for each query and task."""
    context = candidates.sparkSession.sparkContext
    sent = context.broadcast((block.rows, block.ids, block.vectors, block.best, turn))
    k = block.k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, ids, vectors, best, turn = sent.value
        own = Block(rows, ids, vectors, turn, k)
        own.best = best.copy()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            held.append(scan(own, batch.column("row").to_numpy(), batch.column("vec_id").to_numpy(), matrix(batch.column("vector"), width), turn))
        if held:
            query, vec, score = (np.concatenate(c) for c in zip(*held, strict=True))
            kept = own.top(vec, score, query)
            yield pa.RecordBatch.from_pydict({"query": rows[query[kept]], "query_id": ids[query[kept]], "vec_id": vec[kept], "score": score[kept]})

    return candidates.select("row", "vec_id", "vector").mapInArrow(run, "query long, query_id long, vec_id long, score long")


def top_products(rows: DataFrame, every: int, k: int = K, scale: int = 256, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k greatest products of each row whose id is divisible by ``every``."""
    spark = rows.sparkSession
    vectors = integer_vectors(rows, id_column, vector_column, scale)
    length = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    # By range of length, so that each task has candidates of falling length.
    ordered = vectors.withColumn("square", length).repartitionByRange(F.desc("square"), "vec_id").sortWithinPartitions(F.desc("square"), "vec_id")
    # Written with the number, so that a row keeps it.
    candidates = checkpointed(ordered.withColumn("row", F.monotonically_increasing_id()))
    width = candidates.agg(F.max(F.size("vector"))).first()[0] or 0
    schema = "query_id long, rank int, vec_id long, score long"
    if not width:
        return spark.createDataFrame([], schema)
    turn = rotation(candidates, width)
    longest = candidates.orderBy(F.desc("square"), "vec_id").limit(LONGEST).select("row", "vec_id", "vector").toArrow()
    longest_rows, longest_ids, longest_vectors = longest.column("row").to_numpy(), longest.column("vec_id").to_numpy(), matrix(longest.column("vector"), width)
    asked = F.col("vec_id") % every == 0
    n = candidates.where(asked).count()
    blocks = -(-n // QUERIES_PER_BLOCK)
    found = []
    for b in range(blocks):
        # Blocks are of bounded size on the driver, one at a time.
        some = candidates.where(asked & (F.pmod(F.xxhash64("row"), F.lit(blocks)) == b)).select("row", "vec_id", "vector").orderBy("row").toArrow()
        if not len(some):
            continue
        block = Block(some.column("row").to_numpy(), some.column("vec_id").to_numpy(), matrix(some.column("vector"), width), turn, k)
        scan(block, longest_rows, longest_ids, longest_vectors, turn)
        found.append(searched(candidates, block, turn, width))
    if not found:
        return spark.createDataFrame([], schema)
    # Tasks have at most k rows of a query; the best k of these are the best.
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id"))), 1, k)
    ranked = reduce(DataFrame.unionByName, found).groupBy("query", "query_id").agg(best.alias("best")).select("query_id", F.posexplode("best").alias("place", "one"))
    return ranked.select("query_id", (F.col("place") + 1).alias("rank"), "one.vec_id", (-F.col("one.less")).alias("score"))


def op3_topk(spark: SparkSession, folder: str) -> DataFrame:
    return top_products(table(spark, folder, "embeddings"), every=50)


SQL_TOPK = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS vector FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(coalesce(list_inner_product(list_resize(q.vector, greatest(len(q.vector), len(c.vector)), 0), list_resize(c.vector, greatest(len(q.vector), len(c.vector)), 0)), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
"""

QUERIES = {"op3_topk": op3_topk}
SQL = {"op3_topk": SQL_TOPK}
