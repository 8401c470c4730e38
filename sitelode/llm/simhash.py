"""SimHash near-duplicates: fingerprints within a Hamming radius, found by vantage-point trees.

A tree over a bounded sample parts the fingerprints into shards. Each fingerprint lives in one shard and visits those
that its ball overlaps, by the triangle bound; a shard compares by rings around two vantage points of its own, and gives
its local components as stars, so a group of copies costs as many rows as it has members. Components that meet in a
fingerprint are joined by smallest labels, on Spark.

Cases: null, empty and blank texts have fingerprint zero and link like any other; equal fingerprints are one node however
many rows have them; repeated rows each get their row; a null doc_id is in its group but never names it, unless the
group has no other; an empty table gives no row; columns other than the two named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelode.llm.common import blocks, checkpointed, quoted, sampled, split_by, table

SHINGLE = 4
SEED = 42
RADIUS = 4
# A shard doubles when the fingerprints quadruple: more shards would mean more visits, which grow faster than the input.
# Distinct fingerprints of a shard where there are as many; of a block of a crowded shard; of the sample that places the
# boundaries.
SHARD = 8192
BLOCK = 65_536
SAMPLE = 20_000
MAX_DEPTH = 14
# Pairs compared at once.
PAIRS = 1 << 21


def majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half the hashes."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    set_in = np.add.reduce(bits, axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_in > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint_of(text: bytes) -> int:
    found = text.lower().split()
    if not found:
        return 0
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    lengths = np.fromiter(map(len, found), np.int64, len(found)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends + 1 - lengths
    last = max(0, len(found) - SHINGLE)
    pairs = zip(starts[: last + 1].tolist(), ends[min(SHINGLE, len(found)) - 1 :].tolist(), strict=True)
    return majority(np.fromiter((digest(joined[a:b], SEED) for a, b in pairs), np.uint64, last + 1))


def fingerprint(text: Column) -> Column:
    """The 64-bit fingerprint of a text, as a signed long."""

    def run(column: pa.Array) -> pa.Array:
        out = np.zeros(len(column), np.int64)
        for row, data, bounds in blocks(column):
            raw, at = data.tobytes(), bounds.tolist()
            out[row : row + len(at) - 1] = [fingerprint_of(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        return pa.array(out)

    return F.arrow_udf(run, "long")(text.cast("string"))


class Tree:
    """A binary vantage-point tree: below ``bound`` of a node's vantage point is left, the rest right."""

    def __init__(self, sample: np.ndarray, depth: int, radius: int):
        self.depth, self.radius = depth, radius
        self.vantage = np.zeros(1 << depth, np.uint64)
        self.bound = np.zeros(1 << depth, np.int64)
        parts = {1: sample}
        for node in range(1, 1 << depth):
            part = parts.pop(node)
            best = None
            # Of a few candidates, the one whose boundary the fewest balls overlap.
            for vantage in part[:: max(1, len(part) // 8)][:8]:
                far = np.bitwise_count(part ^ vantage).astype(np.int64)
                bound = max(1, int(np.median(far)))
                share = max(np.mean(far < bound), np.mean(far >= bound))
                cost = np.mean(np.abs(far - bound + 0.5) <= radius) + max(0.0, share - 0.6)
                if best is None or cost < best[0]:
                    best = (cost, vantage, bound, far)
            if best:
                _, self.vantage[node], self.bound[node], far = best
                parts[2 * node], parts[2 * node + 1] = part[far < best[2]], part[far >= best[2]]
            else:
                parts[2 * node] = parts[2 * node + 1] = part

    def shards(self, points: np.ndarray, visits: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of ``points``, shards, and whether it is home there; visits are to shards after the home."""
        rows = np.arange(len(points))
        node, home = np.ones(len(points), np.int64), np.ones(len(points), bool)
        for _ in range(self.depth):
            far = np.bitwise_count(points[rows] ^ self.vantage[node]).astype(np.int64)
            left = far < self.bound[node]
            if not visits:
                node = 2 * node + ~left
                continue
            # A pair with homes in two shards is found by the one whose home comes first.
            to_left = np.where(home, left, far - self.radius < self.bound[node])
            to_right = far + self.radius >= self.bound[node]
            rows, home = np.concatenate([rows[to_left], rows[to_right]]), np.concatenate([home[to_left], (home & ~left)[to_right]])
            node = np.concatenate([2 * node[to_left], 2 * node[to_right] + 1])
        return rows, node - (1 << self.depth), home


def joined(parent: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Unites the pairs in ``parent``; a root is the smallest of its component."""
    while len(left):
        for side in (0, 1):
            at = (left, right)[side]
            while True:
                up = parent[at]
                if np.array_equal(up, at):
                    break
                at = up
            left, right = (at, right) if side == 0 else (left, at)
        apart = left != right
        left, right = left[apart], right[apart]
        np.minimum.at(parent, np.maximum(left, right), np.minimum(left, right))


def components(points: np.ndarray, home: np.ndarray, radius: int) -> np.ndarray:
    """The root of each point, by links of which one end at least is at home here.

    Rings of equal distance to two vantage points hold the points; only rings within the radius are compared.
    """
    parent = np.arange(len(points))
    homes = np.flatnonzero(home)
    if not len(homes):
        return parent
    first = points[homes[0]]
    second = points[homes[int(np.argmin(np.abs(np.bitwise_count(points[homes] ^ first).astype(int) - 32)))]]
    a, b = (np.bitwise_count(points ^ v).astype(np.int64) for v in (first, second))
    ring = 65 * a + b
    order = homes[np.argsort(ring[homes], kind="stable")]
    rings, held = ring[order], points[order]
    cells = np.argsort(ring, kind="stable")
    edges = np.flatnonzero(np.diff(ring[cells], prepend=-1))
    for begin, end in zip(edges, [*edges[1:], len(cells)], strict=True):
        askers = cells[begin:end]
        x, y = int(a[askers[0]]), int(b[askers[0]])
        near = range(max(0, x - radius), min(64, x + radius) + 1)
        spans = [np.searchsorted(rings, [65 * i + max(0, y - radius), 65 * i + min(64, y + radius) + 1]) for i in near]
        found = np.concatenate([np.arange(lo, hi) for lo, hi in spans])
        if not len(found):
            continue
        others, at = held[found], order[found]
        step = max(1, PAIRS // len(found))
        for k in range(0, len(askers), step):
            some = askers[k : k + step]
            close = np.bitwise_count(points[some][:, None] ^ others[None, :]) <= radius
            close &= at[None, :] != some[:, None]
            i, j = np.nonzero(close)
            joined(parent, some[i], at[j])
    while not np.array_equal(parent, parent[parent]):
        parent = parent[parent]
    return parent


def stars(prints: DataFrame, radius: int, shard: int, block: int) -> DataFrame:
    """``fp, shard, block, root``: the members of every shard's components of two or more; ``prints`` has distinct ``fp``."""
    n = prints.count()
    depth = 0 if n <= shard else min(MAX_DEPTH, 1 + round(np.log2(n / shard) / 2))
    sample = np.array([r[0] for r in sampled(prints.select("fp", F.xxhash64("fp").alias("order")), "order", SAMPLE).orderBy("order").collect()], np.int64).view(np.uint64)
    tree = Tree(sample, depth, radius)  # at most 2^MAX_DEPTH nodes of 16 bytes

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, at, _ = tree.shards(batch.column(0).to_numpy().view(np.uint64), visits=False)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32))], names=["shard"])

    # At most 2^depth counts come to the driver. A crowded shard is cut into blocks that are compared with each other.
    sizes = {r["shard"]: r["count"] for r in prints.select("fp").mapInArrow(homes, "shard int").groupBy("shard").count().collect()}
    parts = np.array([max(1, round(sizes.get(i, 0) / block)) for i in range(1 << depth)])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column(0).to_numpy()
            for k in range(0, len(points), 4096):
                some = points[k : k + 4096]
                rows, at, home = tree.shards(some.view(np.uint64), visits=True)
                own = (some.view(np.uint64)[rows] % np.uint64(65521)).astype(np.int64) % parts[at]
                n = np.where(home, parts[at] - own, parts[at])
                block = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(np.where(home, own, 0), n)
                at, rows, first = np.repeat(at, n), np.repeat(rows, n), np.repeat(np.where(home, own, -1), n) == block
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at.astype(np.int32)), pa.array(block.astype(np.int32)), pa.array(some[rows]), pa.array(first)],
                    names=["shard", "block", "fp", "home"],
                )

    def linked(group: pa.Table) -> pa.Table:
        points = group.column("fp").to_numpy()
        root = components(points.view(np.uint64), group.column("home").to_numpy(zero_copy_only=False), radius)
        kept = np.bincount(root, minlength=len(points))[root] > 1
        out = group.select(["fp", "shard", "block"]).filter(pa.array(kept))
        return out.append_column("root", pa.array(points[root][kept], pa.int64()))

    spread = prints.select("fp").mapInArrow(dealt, "shard int, block int, fp long, home boolean")
    return spread.groupBy("shard", "block").applyInArrow(linked, "fp long, shard int, block int, root long")


def smallest_labels(members: DataFrame) -> DataFrame:
    """``fp, label``: one label for all nodes whose stars (``shard, block, root``) are joined by common members."""
    star = ["shard", "block", "root"]
    members = checkpointed(members)
    labels = members.groupBy("fp").agg(F.min("root").alias("label"))
    while True:
        reached = members.join(labels, "fp").groupBy(*star).agg(F.min("label").alias("label"))
        lower = members.join(reached, star).groupBy("fp").agg(F.min("label").alias("lower"))
        # A label is a node too, and may know of a smaller one.
        known = lower.join(labels.withColumnsRenamed({"fp": "lower", "label": "above"}), "lower", "left")
        new = known.select("fp", F.least("lower", F.coalesce("above", "lower")).alias("new"))
        step = checkpointed(labels.join(new, "fp").select("fp", F.col("new").alias("label"), (F.col("new") != F.col("label")).alias("moved")))
        labels = step.select("fp", "label")
        if not step.where("moved").limit(1).count():
            return labels


def hashed_prints(documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``doc_id, hash, fp``: the hash tells apart rows that share an id but not a text."""
    text = F.col(text_column)
    return checkpointed(documents.select(F.col(id_column).alias("doc_id"), F.xxhash64(text).alias("hash"), fingerprint(text).alias("fp")))


def component_labels(prints: DataFrame, radius: int = RADIUS, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """``fp, label, component_id`` of every distinct fingerprint; ``label`` is one fingerprint of the component."""
    nodes = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = smallest_labels(stars(nodes, radius, shard, block))
    labelled = nodes.join(labels, "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    named = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    return labelled.select("fp", "label").join(named, "label")


def groups(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", radius: int = RADIUS, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """``doc_id, fp, component_id`` of every row."""
    prints = hashed_prints(documents, id_column, text_column)
    return prints.join(component_labels(prints, radius, shard, block), "fp").select("doc_id", "fp", "component_id")


def one_of_each(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents without near-duplicates: of each component the row of the smallest id, then text hash, then values."""
    prints = hashed_prints(documents, id_column, text_column)
    labelled = prints.join(component_labels(prints).select("fp", "label"), "fp")
    # A null id comes last.
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "hash"))
    kept = labelled.groupBy("label").agg(first.alias("first")).select("first.doc_id", "first.hash", F.lit(True).alias("kept"))
    rows = prints.groupBy("doc_id", "hash").count()
    same = F.expr("a.doc_id <=> b.doc_id AND a.hash = b.hash")
    # Ids and texts that go, and those that stay, but once; all others stay as they are, and aren't shuffled.
    touched = rows.alias("a").join(kept.alias("b"), same, "left").select("a.doc_id", "a.hash", "kept", "count").where("kept IS NULL OR count > 1")
    touched = checkpointed(touched)
    text = F.xxhash64(documents[text_column])
    maybe, others = split_by(documents.withColumn("_hash", text), F.col("_hash"), touched.select("hash"))

    def among(keys: DataFrame, how: str) -> DataFrame:
        return maybe.join(keys, keys["doc_id"].eqNullSafe(maybe[id_column]) & (keys["hash"] == maybe["_hash"]), how)

    repeated = among(touched.where("kept"), "left_semi")
    names = [F.col(quoted(c)) for c in documents.columns]
    # Of repeated rows the first by the text of all values, as not every type has an order.
    least = repeated.groupBy(repeated[id_column], "_hash").agg(F.min_by(F.struct(*names), F.to_json(F.struct(*names))).alias("row")).select("row.*")
    return others.unionByName(among(touched, "left_anti")).drop("_hash").unionByName(least)


def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = groups(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op8_simhash": op8_simhash}
SQL: dict[str, str] = {}
