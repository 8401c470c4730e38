"""A trie of all prefixes of conversations, built and summed by van Emde Boas recursion over its depth.

Sequences are cut at half depth. What stands before the cut gets a name, and the two halves, the upper trie and the
forest of lower tries below the named cuts, are cut again in the same way, all of one size at once. Blocks of ``CHUNK``
turns are of bounded size, so the recursion inside them runs in a task; above that each level is a Spark step over what
is longer. Equal prefixes have equal names, so that the nodes are the different names. Totals go upwards the same way:
when the tries of a level are complete, the total of each root of a lower trie is grafted onto all nodes above it in its
upper trie, whose names are those of a member's prefixes, and so on with twice the depth. With that a turn is joined
once per level, however long its conversation is.

Names are 128 bits of SHA-256 of what they name. Turns are numbered over a range-partitioned sort, so that no
conversation needs one task; names of very many members or children (a thousandth of all, so at most a thousand names)
are joined by broadcast. Only the digest of a node's ids is one chain, as SHA-256 is, and takes them in long pieces.

Cases: rows without conv_id take no part; null turns come first, turns of equal number in the order of their hash; null
roles and texts are empty; an empty text is a turn of no words; repeated rows are turns of their own; a conversation that
ends up without turns is a member of the root; an empty table has no node; columns not named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelode.llm.common import checkpointed, table

# Turns of a block whose recursion runs in one task; a power of two.
CHUNK = 1024
NAME_BYTES = 16
ROOT = bytes(NAME_BYTES)
# A key that more than this share of all rows have is joined by broadcast; there are fewer of them than its inverse.
HOT_SHARE = 1e-3
# Ids that are put into one piece of text before a digest takes them.
PIECE_IDS = 8192


def named(*parts: Column) -> Column:
    """A name of fixed length for some bytes."""
    return F.unhex(F.substring(F.sha2(F.concat(*parts), 256), 1, 2 * NAME_BYTES))


def joined(left: bytes, right: bytes) -> bytes:
    """The same for two names, in a task."""
    return hashlib.sha256(left + right).digest()[:NAME_BYTES]


def symbols(conversations: DataFrame, id_column: str, turn_column: str, role_column: str, text_column: str) -> DataFrame:
    """``conv, turn, symbol, words``: a turn's name and the number of words of its text; texts go no further."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_column, text_column))
    symbol = named(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    n_words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    known = conversations.where(F.col(id_column).isNotNull())
    return known.select(F.col(id_column).cast("long").alias("conv"), F.col(turn_column).alias("turn"), symbol.alias("symbol"), n_words.alias("words"))


def numbered(turns: DataFrame) -> DataFrame:
    """``conv, place, symbol, words``: the turns of each conversation, numbered from 0.

    Turns are sorted over all partitions. Each partition counts on from what those before it have of its first
    conversation, which takes one row per partition on the driver.
    """
    order = ["conv", "turn", "symbol"]
    ordered = checkpointed(turns.repartitionByRange(*order).sortWithinPartitions(*order)).select("conv", "symbol", "words")

    def ends_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last, n_first, n_last = None, None, 0, 0
        for batch in batches:
            conv = batch.column(0).to_numpy()
            if not len(conv):
                continue
            first = int(conv[0]) if first is None else first
            n_first += int(np.searchsorted(conv, first, "right"))
            n_last = int(len(conv) - np.searchsorted(conv, conv[-1])) + (n_last if last == conv[-1] else 0)
            last = int(conv[-1])
        if first is not None:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pylist([{"part": part, "first": first, "n_first": n_first, "last": last, "n_last": n_last}])

    edges = ordered.select("conv").mapInArrow(ends_of, "part long, first long, n_first long, last long, n_last long").orderBy("part").collect()
    carried, conv, held = {}, None, 0
    for edge in edges:
        carried[edge["part"]] = held if edge["first"] == conv else 0
        held = edge["n_last"] + (carried[edge["part"]] if edge["first"] == edge["last"] else 0)
        conv = edge["last"]

    def count_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, carried.get(TaskContext.get().partitionId(), 0)
        for batch in batches:
            conv = batch.column(0).to_numpy()
            if not len(conv):
                continue
            begins = np.flatnonzero(np.diff(conv, prepend=conv[0] - 1))
            place = np.arange(len(conv)) - np.repeat(begins, np.diff(np.append(begins, len(conv))))
            if last is None or conv[0] == last:
                place[: int(np.searchsorted(conv, conv[0], "right"))] += seen
            last, seen = conv[-1], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(place), *batch.columns[1:]], names=["conv", "place", "symbol", "words"])

    return checkpointed(ordered.mapInArrow(count_on, "conv long, place long, symbol binary, words long"))


def looked_up(rows: DataFrame, found: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``found`` (one row per ``key``), or nulls; ``hot`` has the few keys of many rows."""
    marked = rows.join(F.broadcast(hot.select(key, F.lit(True).alias("is_hot"))), key, "left")
    few = F.broadcast(found.join(F.broadcast(hot.select(key)), key, "left_semi"))
    often = marked.where("is_hot").join(few, key, "left")
    return often.unionByName(marked.where("is_hot is null").join(found, key, "left")).drop("is_hot")


def with_leads(turns: DataFrame, lead: Column, donor: Column) -> DataFrame:
    """``conv, place, symbol, words`` of conversations rebuilt: each takes the first ``lead`` turns of its donor in place of its own.

    ``lead`` is a small number, ``donor`` a conversation, both by ``conv``; a donor of fewer turns gives them all.
    """
    each = turns.where("place = 0").select("conv", lead.alias("lead"), donor.alias("donor"))
    asked = each.where("lead > 0")
    longest = asked.agg(F.max("lead")).first()[0] or 0
    heads = turns.where(F.col("place") < longest).select(F.col("conv").alias("donor"), "place", "symbol", "words")
    taken = asked.join(heads, "donor").where("place < lead").select("conv", "place", "symbol", "words")
    # Where fewer came than were asked for, what follows moves up.
    short = asked.join(taken.groupBy("conv").count(), "conv", "left").select("conv", (F.col("lead") - F.coalesce("count", F.lit(0))).alias("up")).where("up > 0")
    sizes = turns.groupBy("conv").count()
    own = looked_up(turns.where(F.col("place") >= lead), short, "conv", sizes.where(F.col("count") > turns.count() * HOT_SHARE))
    return taken.unionByName(own.withColumn("place", F.col("place") - F.coalesce("up", F.lit(0))).drop("up"))


def prefix_names(turns: list[bytes], size: int) -> tuple[list[bytes], bytes | None]:
    """The names of the first 1, 2, ... turns of a block of at most ``size``, and that of the whole block if it is full."""
    blocks = [turns]
    while len(blocks[-1]) > 1:
        some = blocks[-1]
        blocks.append([joined(some[i], some[i + 1]) for i in range(0, len(some) - 1, 2)])
    out = [b""] * len(turns)

    def fill(low: int, level: int, root: bytes) -> None:
        """Prefixes that end inside the block of 2^level turns from ``low``; its last one is the caller's."""
        if level == 0 or low >= len(turns):
            return
        half = 1 << (level - 1)
        fill(low, level - 1, root)
        if low + half <= len(turns):
            cut = out[low + half - 1] = joined(root, blocks[level - 1][low >> (level - 1)])
            fill(low + half, level - 1, cut)

    levels = size.bit_length() - 1
    fill(0, levels, b"")
    whole = blocks[levels][0] if len(turns) == size else None
    if whole is not None:
        out[-1] = whole
    return out, whole


def blocks_of(turns: DataFrame, chunk: int) -> DataFrame:
    """``conv, chunk, names, words, whole`` of each block of ``chunk`` turns."""
    bits = chunk.bit_length() - 1
    listed = F.sort_array(F.collect_list(F.struct("place", "symbol", "words")))
    held = turns.groupBy("conv", F.shiftright("place", bits).alias("chunk")).agg(listed.alias("turns"))
    rows = held.select("conv", "chunk", F.col("turns.symbol").alias("symbols"), F.col("turns.words").alias("words"))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [prefix_names(turns, chunk) for turns in batch.column("symbols").to_pylist()]
            names = pa.array([n for n, _ in found], pa.list_(pa.binary()))
            whole = pa.array([w for _, w in found], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv", "chunk")), names, batch.column("words"), whole], names=["conv", "chunk", "names", "words", "whole"])

    return checkpointed(rows.mapInArrow(name, "conv long, chunk long, names array<binary>, words array<bigint>, whole binary"))


def cuts(blocks: DataFrame) -> DataFrame:
    """``conv, chunk, start``: the name of the prefix before each block but the first; the recursion above the blocks."""
    levels = [blocks.where("whole IS NOT NULL").select("conv", F.col("chunk").alias("j"), "whole")]
    most = levels[0].agg(F.max("j")).first()[0]
    full = -1 if most is None else int(most)
    while (full + 1) >> len(levels):
        parts = [F.max(F.when(F.col("j") % 2 == side, F.col("whole"))).alias(name) for side, name in enumerate(("left", "right"))]
        pairs = levels[-1].groupBy("conv", F.shiftright("j", 1).alias("j")).agg(*parts).where("left IS NOT NULL AND right IS NOT NULL")
        levels.append(checkpointed(pairs.select("conv", "j", named(F.col("left"), F.col("right")).alias("whole"))))
    found = levels[-1].limit(0).select("conv", F.col("j").alias("chunk"), F.col("whole").alias("start"))
    for level in range(len(levels) - 1, -1, -1):
        # The left blocks of this level; what stands before them has been named by a level above.
        left = levels[level].where("j % 2 = 0").select("conv", F.shiftleft("j", level).alias("chunk"), "whole")
        before = F.when(F.col("chunk") == 0, F.lit(ROOT)).otherwise(F.col("start"))
        fresh = left.join(found, ["conv", "chunk"], "left").select("conv", (F.col("chunk") + (1 << level)).alias("chunk"), named(before, F.col("whole")).alias("start"))
        found = checkpointed(found.unionByName(fresh)) if full >= 0 else found
    return found


def paths(turns: DataFrame, chunk: int) -> DataFrame:
    """``conv, depth, name, parent, words``: each conversation's nodes below the root."""
    blocks = blocks_of(turns, chunk)
    start = cuts(blocks)
    after = start.select("conv", (F.col("chunk") - 1).alias("chunk"), F.col("start").alias("after"))
    known = blocks.join(start, ["conv", "chunk"], "left").join(after, ["conv", "chunk"], "left")
    known = known.select("conv", "chunk", "words", "names", F.coalesce("start", F.lit(ROOT)).alias("start"), "after")
    listed = F.transform("names", lambda n: named(F.col("start"), n))
    # The name of a full block's last prefix is the cut after it.
    listed = F.when(F.col("after").isNull(), listed).otherwise(F.concat(F.slice(listed, 1, chunk - 1), F.array("after")))
    both = known.select("conv", "chunk", "words", F.concat(F.array("start"), listed).alias("names"))
    steps = F.posexplode(F.arrays_zip(F.slice("names", F.lit(1), F.size("words")).alias("parent"), F.slice("names", F.lit(2), F.size("words")).alias("name"), "words"))
    flat = both.select("conv", "chunk", steps.alias("at", "step"))
    return checkpointed(flat.select("conv", (F.col("chunk") * chunk + F.col("at") + 1).alias("depth"), "step.name", "step.parent", "step.words"))


def grafted(totals: DataFrame, path: DataFrame, deepest: int, columns: list[str], chunk: int) -> DataFrame:
    """``totals`` (name, conv, depth and ``columns``) with each node's columns summed over its subtree.

    After step ``level`` a node has the sum over its trie down to the end of the block of 2^(level + 1) depths it is in.
    """
    level = 0
    while 1 << level <= deepest:
        half = 1 << level
        span = min(half, chunk)
        roots = totals.where((F.col("depth").bitwiseAND(2 * half - 1)) == half)
        reach = F.sequence(F.col("depth") - half, F.col("depth") - span, F.lit(span).cast("long"))
        sent = roots.select("conv", F.explode(reach).alias("low"), *columns)
        above = path.where(F.col("depth").bitwiseAND(half) == 0).select("conv", (F.col("depth") - F.col("depth") % span).alias("low"), "name")
        sums = sent.join(above, ["conv", "low"]).groupBy("name").agg(*(F.sum(c).alias(f"more_{c}") for c in columns))
        risen = totals.join(sums, "name", "left")
        totals = checkpointed(risen.select("name", "conv", "depth", *((F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in columns)))
        level += 1
    return totals


def id_digests(ends: DataFrame) -> DataFrame:
    """``name, ends_sha256``: the digest of the ids (``conv``) of each name, ascending and comma-joined."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            begins = [i for i in range(len(ids)) if i == 0 or names[i] != names[i - 1]]
            cut = [(a, min(a + PIECE_IDS, b)) for low, b in zip(begins, [*begins[1:], len(ids)], strict=True) for a in range(low, b, PIECE_IDS)]
            columns = [names[a] for a, _ in cut], [ids[a] for a, _ in cut], [",".join(map(str, ids[a:b])) for a, b in cut]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.int64(), pa.string()), strict=True)], names=["name", "first", "piece"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, chain = None, None
        for batch in batches:
            out = []
            for n, piece in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if n != name:
                    if chain is not None:
                        out.append((name, chain.hexdigest()))
                    name, chain = n, hashlib.sha256(piece.encode())
                else:
                    chain.update(b"," + piece.encode())
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in out], pa.binary()), pa.array([d for _, d in out], pa.string())], names=["name", "ends_sha256"])
        if chain is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([chain.hexdigest()])], names=["name", "ends_sha256"])

    ordered = ends.select("name", "conv").repartitionByRange("name", "conv").sortWithinPartitions("name", "conv")
    listed = ordered.mapInArrow(pieces, "name binary, first long, piece string")
    return listed.repartition("name").sortWithinPartitions("name", "first").mapInArrow(digest, "name binary, ends_sha256 string")


def prefix_trie(turns: DataFrame, members: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per node, root included, with its subtree's totals.

    ``turns``: ``conv, place, symbol, words``, numbered from 0; ``members``: every ``conv``, those without turns too.
    """
    if chunk & (chunk - 1):
        raise ValueError("chunk has to be a power of two")
    path = paths(turns, chunk)
    root = members.agg(F.count("*").alias("n_convs"), F.min("conv").alias("conv")).where("n_convs > 0")
    root = root.select(F.lit(ROOT).alias("name"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("words"), "n_convs", "conv")
    nodes = path.groupBy("name", "parent", "depth", "words").agg(F.count("*").alias("n_convs"), F.min("conv").alias("conv"))
    nodes = checkpointed(nodes.unionByName(root))
    n, deepest = nodes.agg(F.count("*"), F.max("depth")).first()
    children = checkpointed(nodes.where("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("n_children")))
    leaf = F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long")
    nodes = nodes.join(children.withColumnRenamed("parent", "name"), "name", "left")
    nodes = checkpointed(nodes.withColumns({"n_leaves": leaf, "saved_tokens": (F.col("n_convs") - 1) * F.col("words"), "n_children": F.coalesce("n_children", F.lit(0))}))
    sums = ["n_leaves", "saved_tokens"]
    # A conversation's way starts at the root.
    ways = path.select("conv", "depth", "name").unionByName(path.where("depth = 1").select("conv", F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("name")))
    totals = grafted(nodes.select("name", "conv", "depth", *sums), ways, deepest or 0, sums, chunk)
    parents = nodes.select(F.col("name").alias("parent"), F.col("conv").alias("parent_conv"))
    crowded = children.where(F.col("n_children") > n * HOT_SHARE)
    last = path.groupBy("conv").agg(F.max_by("name", "depth").alias("name"))
    ends = id_digests(members.join(last, "conv", "left").select("conv", F.coalesce("name", F.lit(ROOT)).alias("name")))
    done = looked_up(nodes.drop(*sums), parents, "parent", crowded).join(totals.select("name", *sums), "name").join(ends, "name", "left")
    return done.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    conversations = table(spark, folder, "conversations")
    turns = numbered(symbols(conversations, "conv_id", "turn", "role", "text"))
    lead = F.crc32(F.col("conv").cast("string").cast("binary")) % 4
    rebuilt = with_leads(turns, lead, F.col("conv") - F.col("conv") % 20)
    trie = prefix_trie(rebuilt, turns.where("place = 0").select("conv"))
    return trie.select(F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


SQL_TRIE = r"""
WITH a AS (
  SELECT conv_id AS c, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS s,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL
), t AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, s) - 1 AS i, s, words FROM a
), u AS (
  SELECT c, [ord(x) FOR x IN string_split(CAST(c AS VARCHAR), '')] AS codes FROM (SELECT DISTINCT c FROM t)
), v AS (
  SELECT c, xor(list_reduce([CAST(4294967295 AS BIGINT)] || codes,
    lambda a, x : list_reduce([xor(a, CAST(x AS BIGINT))] || [CAST(0 AS BIGINT) FOR k IN range(8)], lambda b, k : xor(b >> 1, 3988292384 * (b & 1)))), 4294967295) % 4 AS h
  FROM u
), taken AS (SELECT v.c, i, s, words FROM v JOIN t ON t.c = v.c - v.c % 20 AND i < h),
got AS (SELECT c, count(*) AS got FROM taken GROUP BY c),
r AS (
  SELECT * FROM taken UNION ALL
  SELECT c, i - h + coalesce(got, 0), s, words FROM t JOIN v USING (c) LEFT JOIN got USING (c) WHERE i >= h
), p AS (
  SELECT c, i + 1 AS d, words, sha256(string_agg(s, '') OVER (PARTITION BY c ORDER BY i)) AS name FROM r
  UNION ALL SELECT c, 0, 0, '' FROM v
), w AS (SELECT *, lag(name) OVER (PARTITION BY c ORDER BY d) AS parent, d = max(d) OVER (PARTITION BY c) AS ending FROM p),
n AS (
  SELECT name, min(parent) AS parent, min(c) AS c, min(d) AS d, count(*) AS n_convs, min(words) AS words,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ending), '')) AS ends_sha256
  FROM w GROUP BY name
), k AS (SELECT parent AS name, count(*) AS n_children FROM n GROUP BY parent),
up AS (
  SELECT p.name, sum(CASE WHEN n_children IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * n.words) AS saved
  FROM n LEFT JOIN k USING (name) JOIN p ON p.c = n.c AND p.d <= n.d GROUP BY p.name
)
SELECT n.c AS conv_id, n.d AS depth, q.c AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children,
  CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n LEFT JOIN k USING (name) JOIN up USING (name) LEFT JOIN n q ON q.name = n.parent
"""

QUERIES = {"op13_prefix_trie": op13_prefix_trie}
SQL = {"op13_prefix_trie": SQL_TRIE}
