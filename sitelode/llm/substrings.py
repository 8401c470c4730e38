"""Passages of many words that stand in two places or more, found by suffix automata and cut out.

Every window of ``WINDOW`` words has an anchor, its word group of smallest hash. Neighbouring windows of one anchor are
a stretch. Equal windows have equal anchors, so a shard of anchors that occur twice holds all stretches that can share a
window: it builds an automaton of its distinct stretches, with how often each occurs, and streams them through it for
matching statistics. A window whose state ends in two places or more is repeated; overlapping ones merge to spans.

Broadcasting every automaton to every document would be quadratic: stretches go to the automaton of their anchor.
An anchor with very many different stretches around it is cut into its single windows first, so no group is unbounded.

Cases: a null, empty or short text has no window; repeated rows repeat each other; a null doc_id is a document too; an
empty table gives no row; columns other than the two named are not read. Words are compared by a 64-bit hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelode.llm.common import NOT_BLANK, blocks, checkpointed, mixed, powers, runs, split_by, table, word_hashes, words

WINDOW = 35
GRAM = 8
# More different stretches around one anchor than this are cut into windows.
CROWDED = 2000
# Windows looked at together, which leaves this many bits of a hash for the choice of anchors.
PLACES = 24

_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)


def stretches(hashes: np.ndarray, firsts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, content hash, first word and number of windows of each stretch of some texts' words."""
    found = []
    piece = (1 << PLACES) - window
    for low in range(0, max(1, len(hashes)), piece):
        found.append(_stretches(hashes[low : low + piece + window - 1], np.clip(firsts - low, 0, piece + window - 1), window, low))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _stretches(hashes: np.ndarray, firsts: np.ndarray, window: int, low: int) -> tuple[np.ndarray, ...]:
    none = np.zeros(0, np.int64)
    gram = min(GRAM, window)
    width = window - gram + 1  # groups in a window
    n = len(hashes)
    if n < window:
        return none.astype(np.uint64), none.astype(np.uint64), none, none
    group = np.zeros(n - gram + 1, np.uint64)
    for i, power in enumerate(powers(gram)):
        group += hashes[i : i + len(group)] * power
    group = mixed(group)
    place = np.uint64((1 << PLACES) - 1)
    # The leftmost group of the smallest hash: the place is in the low bits.
    least = (group & ~place) | np.arange(len(group), dtype=np.uint64)
    span = 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    chosen = (least & place).astype(np.int64)
    text = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    inside = np.flatnonzero(text[: len(chosen)] == text[window - 1 :])
    if not len(inside):
        return none.astype(np.uint64), none.astype(np.uint64), none, none
    chosen = chosen[inside]
    begins = np.flatnonzero((np.diff(chosen, prepend=-1) != 0) | (np.diff(inside, prepend=-2) != 1))
    start, count = inside[begins], np.diff(np.append(begins, len(inside)))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers(n, _BASE))])
    content = (sums[start + count + window - 1] - sums[start]) * powers(n, _INVERSE)[start]
    return group[chosen[begins]], mixed(content + count.astype(np.uint64)), start + low, count


def keyed(documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``who, text``: the id, which may be null, and a hash that tells apart texts of one id."""
    text = F.col(text_column).cast("string")
    who = F.struct(F.col(id_column).alias("doc_id"), F.xxhash64(text).alias("key"))
    return documents.select(who.alias("who"), text.alias("text"))


def occurrences(documents: DataFrame, window: int) -> DataFrame:
    """``who, anchor, content, start, n`` of all stretches."""
    schema = T.StructType(
        [documents.schema["who"]]
        + [T.StructField(c, k) for c, k in (("anchor", T.LongType()), ("content", T.LongType()), ("start", T.IntegerType()), ("n", T.IntegerType()))]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, bounds in blocks(batch.column(1)):
                starts, ends, firsts = words(data, bounds, NOT_BLANK)
                anchor, content, start, n = stretches(word_hashes(data, starts, ends), firsts, window)
                text = np.searchsorted(firsts, start, "right") - 1
                at = pa.array(row + text)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(at),
                        pa.array(anchor.view(np.int64)),
                        pa.array(content.view(np.int64)),
                        pa.array((start - firsts[text]).astype(np.int32)),
                        pa.array(n.astype(np.int32)),
                    ],
                    names=schema.names,
                )

    return documents.mapInArrow(cut, schema)


def contents(documents: DataFrame, chosen: DataFrame, window: int) -> DataFrame:
    """``anchor, content, n, times, symbols`` of chosen stretches: the hashes of their words, from one document with them."""
    listed = chosen.groupBy("who").agg(F.collect_set(F.struct("anchor", "content", "start", "n", "times")).alias("found"))
    # Rows of one ``who`` hold one text.
    texts = split_by(documents, F.col("who.key"), chosen.select("who.key"))[0].groupBy("who").agg(F.first("text").alias("text"))
    rows = texts.join(listed, "who").select("text", "found")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, bounds in blocks(batch.column(0)):
                starts, ends, firsts = words(data, bounds, NOT_BLANK)
                raw = word_hashes(data, starts, ends).tobytes()
                found = batch.column(1).slice(row, len(bounds) - 1)
                flat = found.flatten()
                start = flat.field("start").to_numpy() + np.repeat(firsts[:-1], found.value_lengths().to_numpy())
                size = flat.field("n").to_numpy() + window - 1
                symbols = [raw[8 * a : 8 * (a + b)] for a, b in zip(start.tolist(), size.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*(flat.field(c) for c in ("anchor", "content", "n", "times")), pa.array(symbols, pa.binary())],
                    names=["anchor", "content", "n", "times", "symbols"],
                )

    return rows.mapInArrow(read, "anchor long, content long, n int, times long, symbols binary")


class Automaton:
    """A suffix automaton of several sequences; ``ends`` counts the places a state's words end at."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.ends = [-1], [0], [0]

    def state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(0)
        return len(self.length) - 1

    def split(self, before: int, symbol: int, target: int) -> int:
        """The state of ``before`` followed by ``symbol`` alone, parted from the longer words of ``target``."""
        short = self.state(self.length[before] + 1, self.link[target], self.next[target].copy())
        self.link[target] = short
        while before >= 0 and self.next[before].get(symbol) == target:
            self.next[before][symbol] = short
            before = self.link[before]
        return short

    def add(self, symbols: list[int], times: int) -> None:
        following, link, length, ends = self.next, self.link, self.length, self.ends
        last = 0
        for symbol in symbols:
            target = following[last].get(symbol)
            if target is not None:
                last = target if length[target] == length[last] + 1 else self.split(last, symbol, target)
            else:
                fresh = self.state(length[last] + 1, 0, {})
                before = last
                while before >= 0 and symbol not in following[before]:
                    following[before][symbol] = fresh
                    before = link[before]
                if before >= 0:
                    target = following[before][symbol]
                    link[fresh] = target if length[target] == length[before] + 1 else self.split(before, symbol, target)
                last = fresh
            ends[last] += times

    def finish(self) -> None:
        """Places of a word are places of its ends: counts go from long states to short."""
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            self.ends[self.link[state]] += self.ends[state]

    def repeated(self, symbols: list[int], window: int) -> int:
        """Bit j is set if the window that starts at j ends in two places or more."""
        following, link, length, ends = self.next, self.link, self.length, self.ends
        mask, state = 0, 0
        for i, symbol in enumerate(symbols):
            state = following[state][symbol]
            while length[link[state]] >= window:
                state = link[state]
            if i >= window - 1 and ends[state] >= 2:
                mask |= 1 << (i - window + 1)
        return mask


def matched(distinct: DataFrame, window: int) -> DataFrame:
    """``anchor, content, mask``: repeated windows of each distinct stretch, by the automaton of its anchor."""

    def of_anchor(found: list[tuple[int, int, bytes]]) -> Iterator[tuple[int, int]]:
        automaton = Automaton()
        read = {content: np.frombuffer(raw, np.int64).tolist() for content, _, raw in found}
        for content, times, _ in found:
            automaton.add(read[content], times)
        automaton.finish()
        for content, symbols in read.items():
            yield content, automaton.repeated(symbols, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, held = None, {}
        out: list[tuple[int, int, int]] = []

        def close() -> None:
            if held:
                out.extend((anchor, content, mask) for content, mask in of_anchor([(c, t, s) for c, (t, s) in held.items()]) if mask)

        def batch_of_out() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["anchor", "content", "mask"])

        for batch in batches:
            for a, c, t, s in zip(*(batch.column(n).to_pylist() for n in ("anchor", "content", "times", "symbols")), strict=True):
                if a != anchor:
                    close()
                    anchor, held = a, {}
                held[c] = (t, s)
            yield batch_of_out()
            out.clear()
        close()
        yield batch_of_out()

    rows = distinct.select("anchor", "content", "times", "symbols")
    return rows.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "anchor long, content long, mask long")


def single_windows(distinct: DataFrame, window: int) -> DataFrame:
    """``anchor, content, place, times, own, symbols``: stretches cut into windows; ``own`` is the window's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_numpy()
            raw = batch.column("symbols").to_pylist()
            symbols = [s[8 * i : 8 * (i + window)] for s, k in zip(raw, n.tolist(), strict=True) for i in range(k)]
            grid = np.frombuffer(b"".join(symbols), np.uint64).reshape(-1, window)
            own = mixed((grid * powers(window, _BASE)).sum(axis=1, dtype=np.uint64))
            at = pa.array(np.repeat(np.arange(len(n)), n))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(at) for c in ("anchor", "content", "times")), pa.array(runs(n).astype(np.int32)), pa.array(own.view(np.int64)), pa.array(symbols, pa.binary())],
                names=["anchor", "content", "times", "place", "own", "symbols"],
            )

    return distinct.mapInArrow(run, "anchor long, content long, times long, place int, own long, symbols binary")


def repeated_windows(documents: DataFrame, window: int, crowded: int) -> DataFrame:
    """``who, found``: for each document with repeated windows, their first words as (start, mask)."""
    every = occurrences(documents, window)
    twice = checkpointed(every.select("anchor").groupBy("anchor").count().where("count > 1").select("anchor"))
    kept = checkpointed(every.join(twice, "anchor", "left_semi"))
    one = F.min(F.struct("who", "start", "n")).alias("one")
    distinct = checkpointed(kept.groupBy("anchor", "content").agg(F.count("*").alias("times"), one).select("anchor", "content", "times", "one.*"))
    many = checkpointed(distinct.groupBy("anchor").count().where(F.col("count") > crowded).select("anchor"))
    masks = matched(contents(documents, distinct.join(many, "anchor", "left_anti"), window), window)
    if many.limit(1).count():
        cut = checkpointed(single_windows(contents(documents, distinct.join(many, "anchor", "left_semi"), window), window))
        # Equal windows are one stretch of a single window; its hash stands for its anchor.
        merged = cut.groupBy("own").agg(F.sum("times").alias("times"), F.min("symbols").alias("symbols"))
        again = matched(merged.select(F.col("own").alias("anchor"), F.lit(0).cast("long").alias("content"), "times", "symbols"), window)
        hit = cut.join(again.select(F.col("anchor").alias("own")), "own", "left_semi")
        masks = masks.unionByName(hit.groupBy("anchor", "content").agg(F.bit_or(F.expr("shiftleft(1L, place)")).alias("mask")))
    found = kept.join(masks, ["anchor", "content"]).groupBy("who").agg(F.collect_set(F.struct("start", "mask")).alias("found"))
    return checkpointed(found)


def covered(found: list[dict[str, int]], n: int, window: int) -> np.ndarray:
    """Which of ``n`` words stand in a repeated window."""
    edges = np.zeros(n + 1, np.int64)
    if found:
        start = np.array([f["start"] for f in found], np.int64)
        masks = np.array([f["mask"] for f in found], np.int64)
        which, bit = np.nonzero((masks[:, None] >> np.arange(63)) & 1)
        np.add.at(edges, start[which] + bit, 1)
        np.add.at(edges, start[which] + bit + window, -1)
    return np.cumsum(edges[:n]) > 0


def cut_repeats(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW, crowded: int = CROWDED) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, spans`` of each row; ``spans`` are ranges of removed words.

    ``window`` is at most 69 words, so that the windows of a stretch fit the bits of a long.
    """
    if window - min(GRAM, window) + 1 > 62:
        raise ValueError("a window has at most 69 words")
    rows = keyed(documents, id_column, text_column)
    found = repeated_windows(rows, window, crowded)
    # Only texts that may have repeats are shuffled to their spans.
    maybe, others = split_by(rows, F.col("who.key"), found.select("who.key"))
    with_found = maybe.join(found, "who", "left").select("who.doc_id", "text", "found")
    without = others.select("who.doc_id", "text", F.lit(None).cast(found.schema["found"].dataType).alias("found"))
    schema = T.StructType(
        [with_found.schema["doc_id"]]
        + [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]
        + [T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))]
    )
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, bounds in blocks(batch.column(1)):
                raw, at = data.tobytes(), bounds.tolist()
                out = []
                for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
                    text = raw[a:b].split()
                    spans, removed, hits = [], 0, batch.column(2)[row + i].as_py()
                    if hits:
                        gone = covered(hits, len(text), window)
                        edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
                        spans = [{"start": int(x), "end": int(y)} for x, y in edges.reshape(-1, 2)]
                        removed = int(gone.sum())
                        kept = [w for w, g in zip(text, gone.tolist(), strict=True) if not g]
                    else:
                        kept = text
                    out.append((len(text), removed, hashlib.sha256(b" ".join(kept)).hexdigest(), spans))
                n, removed, digest, spans = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(out)), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest), pa.array(spans, span_type)],
                    names=schema.names,
                )

    return with_found.unionByName(without).mapInArrow(cut, schema)


def op4_substrings(spark: SparkSession, folder: str) -> DataFrame:
    return cut_repeats(table(spark, folder, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL_SUBSTRINGS = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
h AS (SELECT r, [md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) FOR i IN range(1, len(w) - {WINDOW - 2})] AS hs FROM d WHERE len(w) >= {WINDOW}),
u AS (SELECT r, unnest(hs) AS h, unnest(range(1, len(hs) + 1)) AS i FROM h),
twice AS (SELECT h FROM u GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, i + k AS j FROM (SELECT r, i FROM u SEMI JOIN twice USING (h)), (SELECT unnest(range(0, {WINDOW})) AS k)),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY j) AS kept, count(*) AS n
  FROM (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d) ANTI JOIN gone USING (r, j) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

QUERIES = {"op4_substrings": op4_substrings}
SQL = {"op4_substrings": SQL_SUBSTRINGS}
