"""Quality of texts: a generalised additive model with pairwise interactions.

Shallow trees, boosted in turn over the features, add up to one lookup table per feature; then pairs of features that
explain most of what is left get tables of two dimensions. A score is a sum of table entries. The model is fitted on the
driver to the features of a bounded sample of labelled rows; features and scores are local to a row and read whole texts.

Cases: a null text counts as empty and is scored like one; if there is no label to learn from, every score is 0.5;
repeated rows get equal rows, and several labels of one id count as their greatest; a null doc_id has no label; an empty
table gives no row; columns other than those named are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelode.llm.common import NOT_BLANK, blocks, byte_table, fold, mixed, sampled, table, word_hashes, words

# Labelled rows learned from, at most.
SAMPLE = 20_000
BINS = 32
PAIR_BINS = 8
ROUNDS = 120
PAIR_ROUNDS = 60
PAIRS = 6
RATE = 0.15
LEAST_ROWS = 5
GOOD = 0.5

# Classes of bytes, one each; the last are bytes beyond ASCII.
CLASSES = ("upper", "lower", "digit", "blank", "line", "stop", "bang", "bar", "symbol", "other", "beyond")
FEATURES = (
    *CLASSES, "length", "words", "word_length", "short_words", "long_words", "distinct", "commonest", "again", "marked_words", "line_words", "lines_again",
)

_CLASS = np.full(256, CLASSES.index("other"), np.uint8)
_CLASS[128:] = CLASSES.index("beyond")
for _name, _bytes in (
    ("upper", range(65, 91)), ("lower", range(97, 123)), ("digit", range(48, 58)), ("blank", b" \t"), ("line", b"\r\n"),
    ("stop", b".,;:?"), ("bang", b"!"), ("bar", b"|"), ("symbol", b"#$%&*@^~<>=+\\/_"),
):
    _CLASS[list(_bytes)] = CLASSES.index(_name)
_NO_BREAK = byte_table((10, 10), inverse=True)


def shares_of_groups(text: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How many different hashes each text has, and how often its commonest."""
    keys = np.sort(mixed(hashes ^ mixed(text.astype(np.uint64) + np.uint64(1))) & ~np.uint64((1 << 20) - 1) | text.astype(np.uint64) & np.uint64((1 << 20) - 1))
    begins = np.flatnonzero(np.diff(keys, prepend=~keys[:1]) != 0)
    owner = (keys[begins] & np.uint64((1 << 20) - 1)).astype(np.int64)
    most = np.zeros(n)
    np.maximum.at(most, owner, np.diff(np.append(begins, len(keys))))
    return np.bincount(owner, minlength=n), most


def features_of(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row per text of a block, a column per feature."""
    n = len(bounds) - 1
    size = np.diff(bounds)
    text_of_byte = np.repeat(np.arange(n), size)
    counts = np.bincount(text_of_byte * len(CLASSES) + _CLASS[data], minlength=n * len(CLASSES)).reshape(n, -1)
    starts, ends, firsts = words(data, bounds, NOT_BLANK)
    n_words = np.diff(firsts)
    text = np.repeat(np.arange(n), n_words)
    length = ends - starts
    hashes = word_hashes(data, starts, ends)
    per_word = np.maximum(1, n_words)

    def share(mask: np.ndarray) -> np.ndarray:
        return np.bincount(text[mask], minlength=n) / per_word

    same = np.zeros(len(hashes), bool)
    if len(hashes):
        same[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
    distinct, commonest = shares_of_groups(text, hashes, n) if len(hashes) else (np.zeros(n), np.zeros(n))
    final = _CLASS[data[ends - 1]] if len(ends) else np.zeros(0, np.uint8)
    line_starts, line_ends, line_firsts = words(data, bounds, _NO_BREAK)
    n_lines = np.diff(line_firsts)
    line_text = np.repeat(np.arange(n), n_lines)
    different = shares_of_groups(line_text, word_hashes(data, line_starts, line_ends), n)[0] if len(line_starts) else np.zeros(n)
    columns = [
        *(counts / np.maximum(1, size)[:, None]).T,
        np.log1p(size),
        np.log1p(n_words),
        np.bincount(text, length, minlength=n) / per_word,
        share(length <= 3),
        share(length >= 16),
        distinct / per_word,
        commonest / per_word,
        share(same),
        share((final != CLASSES.index("lower")) & (final != CLASSES.index("upper")) & (final != CLASSES.index("stop"))),
        n_words / np.maximum(1, n_lines),
        1 - different / np.maximum(1, n_lines),
    ]
    return np.stack(columns, axis=1).astype(np.float32)


def feature_array(text: Column) -> Column:
    def run(column: pa.Array) -> pa.Array:
        found = [features_of(data, bounds) for _, data, bounds in blocks(column)]
        flat = np.concatenate([*found, np.zeros((0, len(FEATURES)), np.float32)])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * len(FEATURES), pa.int32()), pa.array(flat.ravel()))

    return F.arrow_udf(run, "array<float>")(text.cast("string"))


@dataclass
class Additive:
    """Tables by feature and by pair of features; ``cuts`` are the bins' upper bounds."""

    base: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: np.ndarray = field(default_factory=lambda: np.zeros((0, BINS)))
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.cuts)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1."""
        total = np.full(len(x), self.base)
        if self.cuts and len(x):
            bins = self.binned(x)
            for j, values in enumerate(self.tables):
                total += values[bins[:, j]]
            for (i, j), values in zip(self.pairs, self.pair_tables, strict=True):
                total += values[bins[:, i] * PAIR_BINS // BINS, bins[:, j] * PAIR_BINS // BINS]
        return 1 / (1 + np.exp(-total))


def gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def tree_1d(g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int = 2) -> np.ndarray:
    """What a tree of this depth adds to each bin, by sums of gradients and of second derivatives."""
    cg, ch, cn = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    total_g, total_h, total_n = g.sum(), h.sum(), n.sum()
    if depth and len(g) > 1:
        better = gain(cg, ch) + gain(total_g - cg, total_h - ch) - gain(total_g, total_h)
        better[(cn < LEAST_ROWS) | (total_n - cn < LEAST_ROWS)] = -1
        at = int(np.argmax(better)) + 1
        if better[at - 1] > 1e-9:
            return np.concatenate([tree_1d(g[:at], h[:at], n[:at], depth - 1), tree_1d(g[at:], h[at:], n[at:], depth - 1)])
    return np.full(len(g), total_g / (total_h + 1.0))


def tree_2d(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """One cut along each axis: four values and what they gain; every pair of cuts is tried."""
    sums = [np.pad(np.cumsum(np.cumsum(a, 0), 1), ((1, 0), (1, 0))) for a in (g, h, n)]
    size = g.shape[0]
    inner = np.arange(1, size)

    def quarters(s: np.ndarray) -> np.ndarray:
        a = s[inner][:, inner]
        top, left, total = s[inner, size][:, None], s[size, inner][None, :], s[size, size]
        return np.stack([a, top - a, left - a, total - top - left + a])

    qg, qh, qn = map(quarters, sums)
    better = np.where(qn >= LEAST_ROWS, gain(qg, qh), 0).sum(0) - gain(g.sum(), h.sum())
    i, j = np.unravel_index(int(np.argmax(better)), better.shape)
    value = np.where(qn[:, i, j] >= LEAST_ROWS, qg[:, i, j] / (qh[:, i, j] + 1.0), 0.0)
    out = np.empty_like(g)
    i, j = i + 1, j + 1
    out[:i, :j], out[:i, j:], out[i:, :j], out[i:, j:] = value
    return out, float(better.max())


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    """Cyclic boosting by feature, then by the pairs that gain most."""
    if not len(y):
        return Additive()
    share = np.clip(y.mean(), 0.01, 0.99)
    model = Additive(base=float(np.log(share / (1 - share))))
    for j in range(x.shape[1]):
        model.cuts.append(np.unique(np.quantile(x[:, j], np.arange(1, BINS) / BINS).astype(np.float32)))
    model.tables = np.zeros((x.shape[1], BINS))
    bins = model.binned(x)
    total = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    rows = [np.bincount(bins[:, j], minlength=BINS) for j in range(x.shape[1])]
    for _ in range(ROUNDS):
        for j in range(x.shape[1]):
            g, h = slopes()
            step = RATE * tree_1d(np.bincount(bins[:, j], g, BINS), np.bincount(bins[:, j], h, BINS), rows[j])
            model.tables[j] += step
            total += step[bins[:, j]]
    coarse = bins * PAIR_BINS // BINS
    flat = {(i, j): coarse[:, i] * PAIR_BINS + coarse[:, j] for i in range(x.shape[1]) for j in range(i)}

    def grids(cell: np.ndarray) -> list[np.ndarray]:
        return [np.bincount(cell, w, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS) for w in (*slopes(), None)]

    ranked = sorted(flat, key=lambda pair: -tree_2d(*grids(flat[pair]))[1])
    model.pairs = ranked[:PAIRS]
    model.pair_tables = [np.zeros((PAIR_BINS, PAIR_BINS)) for _ in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for values, pair in zip(model.pair_tables, model.pairs, strict=True):
            step = RATE * tree_2d(*grids(flat[pair]))[0]
            values += step
            total += step.ravel()[flat[pair]]
    return model


def quality(text: Column, model: Additive) -> Column:
    """The score of a text; the model is a few kilobytes."""

    def run(column: pa.Array) -> pa.Array:
        found = [model.score(features_of(data, bounds)) for _, data, bounds in blocks(column)]
        return pa.array(np.concatenate([*found, np.zeros(0)]))

    return F.arrow_udf(run, "double")(text.cast("string"))


def labelled(
    documents: DataFrame, labels: DataFrame, label: str, held_out: Column, most: int, only: int | None = None, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``doc_id, text, label`` of at most ``most`` ids that have a label (``only`` this one) and aren't held out."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    if only is not None:
        marks = marks.where(F.col("label") == only)
    ids = documents.where(~held_out).select(F.col(id_column).alias("doc_id")).distinct().join(marks, "doc_id")
    chosen = sampled(ids.withColumn("order", F.xxhash64("doc_id")), "order", most).select("doc_id", "label")
    rows = documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    # At most ``most`` ids and labels are broadcast.
    return rows.join(F.broadcast(chosen), "doc_id")


def learned(documents: DataFrame, labels: DataFrame, held_out: Column, most: int = SAMPLE) -> Additive:
    rows = labelled(documents, labels, "quality", held_out, most).select(feature_array(F.col("text")).alias("x"), "label").toArrow()
    # The rows' order is no order to rely on.
    x = rows.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
    y = rows.column("label").to_numpy().astype(np.float64)
    order = np.lexsort((y, *x.T))
    return fit(x[order], y[order])


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    documents, held_out = table(spark, folder, "documents"), fold("doc_id", 3) == 1
    model = learned(documents, table(spark, folder, "labels"), held_out)
    scored = documents.select("doc_id", held_out.alias("held_out"), quality(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= GOOD).cast("int"))


QUERIES = {"op9_quality": op9_quality}
SQL: dict[str, str] = {}
