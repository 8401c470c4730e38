"""Benchmark passages found in documents by an FM-index per shard of documents.

A shard is some documents of a task. Their words become numbers of the benchmark's words; stretches that hold another
word, or are shorter than the shortest window, can't hold a window and are left out of the index, which is built of
``SHARD`` words at most: more words, also of one text, are cut into pieces that overlap by a window. All windows are
searched backwards at once through a wavelet matrix of the transformed text, found by sampled suffix positions, and
merged. The benchmark comes in parts of bounded size, one at a time on the driver and in a task.

Cases: a null text has no words; an item without words has no window, a null item_id is searched for but not named;
repeated items count once; an empty benchmark hits nothing; an empty table gives no row; columns other than those named
are not read. Words are compared by a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelode.llm.common import LOWER, blocks, byte_table, runs, table, word_hashes, words

WINDOW = 10
# Benchmark text that is searched for at once; a larger benchmark is dealt into parts of about this size by item.
PART_BYTES = 4 << 20
# Words that an index is built of, at most.
SHARD = 1 << 18
# Every so many-th suffix position is kept.
STEP = 8
# Word characters after A-Z were lower-cased: digits, letters, and all beyond ASCII.
WORD = byte_table((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F), inverse=True)


def hashed_words(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By block: the first row, starts and ends (in their texts) and hashes of words, the first word of each text."""
    for row, data, bounds in blocks(column):
        lower = LOWER[data]
        starts, ends, firsts = words(lower, bounds, WORD)
        begin = np.repeat(bounds[:-1], np.diff(firsts))
        yield row, starts - begin, ends - begin, word_hashes(lower, starts, ends), firsts


class Phrases:
    """The distinct windows of some items, as numbers of their distinct words."""

    def __init__(self, ids: list[str | None], texts: list[str | None], window: int):
        per_item = [h[a:b] for _, _, _, h, firsts in hashed_words(pa.array(texts, pa.string())) for a, b in zip(firsts[:-1], firsts[1:], strict=True)]
        flat = np.concatenate([*per_item, np.zeros(0, np.uint64)])
        self.words = np.unique(flat)
        self.filter = np.zeros(1 << 16, bool)
        self.filter[(self.words & np.uint64(0xFFFF)).astype(np.int64)] = True
        found: dict[tuple[int, ...], set[int]] = {}
        self.ids = ids
        for item, hashes in enumerate(per_item):
            numbers = (np.searchsorted(self.words, hashes) + 1).tolist()
            for start in range(max(1, len(numbers) - window + 1) if numbers else 0):
                found.setdefault(tuple(numbers[start : start + window]), set()).add(item)
        self.length = np.array([len(p) for p in found], np.int64)
        self.symbols = np.zeros((len(found), window), np.int64)  # the last symbol in the last column
        for i, phrase in enumerate(found):
            self.symbols[i, window - len(phrase) :] = phrase
        self.items = [sorted(x) for x in found.values()]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word from 1, or 0."""
        out = np.zeros(len(hashes), np.int64)
        maybe = np.flatnonzero(self.filter[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.words, hashes[maybe]), len(self.words) - 1)
        hit = self.words[at] == hashes[maybe]
        out[maybe[hit]] = at[hit] + 1
        return out


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order, by doubling; each zero counts as a symbol of its own."""
    n = len(text)
    zeros = np.flatnonzero(text == 0)
    keys = text + len(zeros)
    keys[zeros] = np.arange(len(zeros))
    rank = np.unique(keys, return_inverse=True)[1]
    step = 1
    while True:
        behind = np.zeros(n, np.int64)
        behind[: n - step] = rank[step:] + 1
        keys = rank * (n + 1) + behind
        order = np.argsort(keys, kind="stable")
        fresh = np.empty(n, bool)
        fresh[0] = False
        np.not_equal(keys[order][1:], keys[order][:-1], out=fresh[1:])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh)
        if rank[order[-1]] == n - 1:
            return order
        step *= 2


class Index:
    """An FM-index of numbers; 0 parts the stretches, stands at the end and is never searched."""

    def __init__(self, text: np.ndarray, greatest: int, step: int = STEP):
        order = suffix_order(text)
        self.last = text[order - 1]
        counts = np.bincount(text, minlength=greatest + 1)
        self.before = np.concatenate([[0], np.cumsum(counts)])
        self.levels = []
        rest = self.last
        for level in reversed(range(max(1, int(greatest).bit_length()))):
            bit = (rest >> level) & 1
            zeros = np.concatenate([[0], np.cumsum(1 - bit)])
            self.levels.append((level, zeros, int(zeros[-1])))
            rest = np.concatenate([rest[bit == 0], rest[bit == 1]])
        # The first place of a stretch is kept too: the way back ends there.
        kept = (order % step == 0) | (self.last == 0)
        self.sample = np.where(kept, order, -1)

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often each symbol is among the first ``row`` of the transformed text."""
        first = np.zeros_like(row)
        for level, zeros, split in self.levels:
            one = ((symbol >> level) & 1).astype(bool)
            row0, first0 = zeros[row], zeros[first]
            row = np.where(one, split + row - row0, row0)
            first = np.where(one, split + first - first0, first0)
        return row - first

    def search(self, symbols: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases that occur, and their range of rows; a phrase is its last ``length`` columns."""
        who = np.arange(len(symbols))
        low, high = np.zeros(len(who), np.int64), np.full(len(who), len(self.last))
        for back in range(1, symbols.shape[1] + 1):
            here = back <= length[who]
            symbol = symbols[who, -back]
            low = np.where(here, self.before[symbol] + self.rank(symbol, low), low)
            high = np.where(here, self.before[symbol] + self.rank(symbol, high), high)
            alive = low < high
            who, low, high = who[alive], low[alive], high[alive]
        return who, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The place in the text of each row."""
        out, left, back = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        while len(left):
            at = self.sample[rows]
            known = at >= 0
            out[left[known]] = at[known] + back
            left, rows = left[~known], rows[~known]
            symbol = self.last[rows]
            rows = self.before[symbol] + self.rank(symbol, rows)
            back += 1
        return out


def loaded(part: Broadcast | Phrases) -> Phrases:
    """A part of the benchmark, read from the executor's disk, and held by nothing else."""
    if isinstance(part, Phrases):
        return part
    fresh = object.__new__(type(part))
    fresh.__dict__.update(part.__dict__)
    return fresh.value


class Hits:
    """What is found in some texts: by text the hit words and the items."""

    def __init__(self, n: int):
        self.words: list[list[np.ndarray]] = [[] for _ in range(n)]
        self.items: list[set[str]] = [set() for _ in range(n)]

    def add(self, some: np.ndarray, phrases: Phrases) -> None:
        """Searches a piece: rows are symbols, texts, words, start and end bytes; a stretch ends at a zero."""
        symbol, row, word, start, end = some
        index = Index(symbol, len(phrases.words))
        who, low, high = index.search(phrases.symbols, phrases.length)
        if not len(who):
            return
        times = high - low
        phrase = np.repeat(who, times)
        at = index.locate(np.repeat(low, times) + runs(times))
        cover = np.zeros(len(symbol) + 1, np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + phrases.length[phrase], -1)
        hit = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
        for text, number in np.unique(np.stack([row[at], phrase], axis=1), axis=0).tolist():
            self.items[text].update(str(phrases.ids[k]) for k in phrases.items[number] if phrases.ids[k] is not None)
        edges = np.flatnonzero(np.diff(row[hit], prepend=-2))
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(hit)], strict=True):
            here = hit[a:b]
            self.words[row[here[0]]].append(np.stack([word[here], start[here], end[here]]))

    def spans(self, text: int) -> tuple[int, list[tuple[int, int]]]:
        """How many words of a text are hit, and the byte spans of hit words that follow on each other."""
        if not self.words[text]:
            return 0, []
        word, first = np.unique(np.concatenate([w[0] for w in self.words[text]]), return_index=True)
        start, end = (np.concatenate([w[k] for w in self.words[text]])[first] for k in (1, 2))
        begins = np.flatnonzero(np.diff(word, prepend=-2) != 1)
        closes = np.append(begins[1:], len(word)) - 1
        return len(word), list(zip(start[begins].tolist(), end[closes].tolist(), strict=True))


def known_stretches(phrases: Phrases, row: int, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Symbols, texts, words, start and end bytes of a block's stretches of known words; a zero closes each."""
    text = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    symbol = phrases.numbers(hashes)
    known = np.flatnonzero(symbol)
    begins = np.ones(len(known), bool)
    begins[1:] = (np.diff(known) != 1) | (text[known[1:]] != text[known[:-1]])
    edges = np.flatnonzero(begins)
    lengths = np.diff(np.append(edges, len(known)))
    long = lengths >= phrases.length.min()
    known, lengths = known[np.repeat(long, lengths)], lengths[long]
    place = np.arange(len(known)) + np.repeat(np.arange(len(lengths)), lengths)
    out = np.zeros((5, len(known) + len(lengths)), np.int64)
    out[1] = -1
    out[:, place] = symbol[known], row + text[known], known - firsts[text[known]], starts[known], ends[known]
    return out


def search_shard(column: pa.Array, parts: list[Broadcast | Phrases], shard: int = 0) -> tuple[np.ndarray, list[int], list[set[str]], list[list[tuple[int, int]]]]:
    """Of each text: number of words, of hit words, ids of items found, byte spans of hit words (merged)."""
    shard = shard or SHARD
    n_words, hits = np.zeros(len(column), np.int64), Hits(len(column))
    for row, _, _, _, firsts in hashed_words(column) if not parts else ():
        n_words[row : row + len(firsts) - 1] = np.diff(firsts)
    for part in parts:
        phrases, gathered, size = loaded(part), [], 0
        overlap = phrases.symbols.shape[1] - 1

        def search(pieces: list[np.ndarray], phrases: Phrases = phrases, overlap: int = overlap) -> None:
            whole = np.concatenate(pieces, axis=1)
            for low in range(0, whole.shape[1], shard):
                # A window lies whole in one of two pieces that overlap; a zero ends the piece.
                hits.add(np.concatenate([whole[:, low : low + shard + overlap], [[0], [-1], [0], [0], [0]]], axis=1), phrases)

        for row, starts, ends, hashes, firsts in hashed_words(column):
            n_words[row : row + len(firsts) - 1] = np.diff(firsts)
            gathered.append(known_stretches(phrases, row, starts, ends, hashes, firsts))
            size += gathered[-1].shape[1]
            if size >= shard:
                search(gathered)
                gathered, size = [], 0
        if size:
            search(gathered)
    found = [hits.spans(i) for i in range(len(column))]
    return n_words, [n for n, _ in found], hits.items, [spans for _, spans in found]


def phrase_parts(benchmark: DataFrame, id_column: str, text_column: str, window: int) -> list[Broadcast]:
    """The benchmark's windows, a part at a time on the driver; a part is about PART_BYTES of text or one item."""
    context = benchmark.sparkSession.sparkContext
    items = benchmark.select(F.col(id_column).cast("string").alias("id"), F.col(text_column).cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + size // PART_BYTES
    parts = []
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).distinct().orderBy("id", "text").collect()
        phrases = Phrases([r["id"] for r in rows], [r["text"] for r in rows], window)
        if len(phrases.length):
            parts.append(context.broadcast(phrases))
    return parts


def search(text: Column, parts: list[Broadcast], cut: bool = False) -> Column:
    """``n_words, n_hit, items (sorted ids), spans (code points of the merged hits)`` of each text, or the text without them."""

    def run(column: pa.Array) -> pa.Array:
        n_words, hits, items, spans = search_shard(column, parts)
        marked, kept = [], []
        for i, found in enumerate(spans):
            raw = column[i].as_py().encode() if found else b""
            marked.append([{"start": len(raw[:a].decode()), "end": len(raw[:b].decode())} for a, b in found])
            if cut:
                edges = [0, *(x for span in found for x in span), len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)).decode() if found else column[i].as_py())
        if cut:
            return pa.array(kept, pa.string())
        return pa.StructArray.from_arrays(
            [
                pa.array(n_words),
                pa.array(hits, pa.int64()),
                pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                pa.array(marked, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
            ],
            names=["n_words", "n_hit", "items", "spans"],
        )

    kind = "string" if cut else "n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>"
    return F.arrow_udf(run, kind)(text.cast("string"))


def contamination(documents: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW) -> DataFrame:
    """``doc_id`` and a struct ``found`` for each document, see ``search``."""
    parts = phrase_parts(benchmark, "item_id", "text", window)
    return documents.select(F.col(id_column).alias("doc_id"), search(F.col(text_column), parts).alias("found"))


def decontaminated(documents: DataFrame, benchmark: DataFrame, text_column: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents with the benchmark's passages cut out of their texts."""
    parts = phrase_parts(benchmark, "item_id", "text", window)
    return documents.withColumn(text_column, search(F.col(text_column), parts, cut=True))


def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "found.n_words",
        "found.n_hit",
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
        (F.col("found.n_hit") > 0).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL_DECONTAMINATION = f"""
WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
items AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS size,
  unnest([array_to_string(w[i:i + {WINDOW - 1}], ' ') FOR i IN range(1, greatest(2, len(w) - {WINDOW - 2}))]) AS text FROM b WHERE len(w) > 0),
d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
windows AS (SELECT r, size, [array_to_string(w[i:i + size - 1], ' ') FOR i IN range(1, len(w) - size + 2)] AS ts
  FROM d, (SELECT DISTINCT size FROM items)),
found AS (SELECT r, i, size, item_id FROM (SELECT r, size, unnest(ts) AS text, unnest(range(1, len(ts) + 1)) AS i FROM windows) JOIN items USING (size, text)),
hit AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + size)) AS j FROM found) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM found WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""

QUERIES = {"op6_decontamination": op6_decontamination}
SQL = {"op6_decontamination": SQL_DECONTAMINATION}
