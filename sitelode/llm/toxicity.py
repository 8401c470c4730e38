"""Toxicity of texts: a bidirectional gated recurrent network with attention pooling over overlapping windows of words.

A word enters as the embedding of the word itself and of its first letters, if enough learned texts have them, and the
mean embedding of its hashed character groups. The network is trained in numpy on the driver, on a bounded sample of labelled texts: a toxic text
needs one toxic window, so the windows learned from are those that score highest in their text. A text's score is the
greatest of its windows, and every window of the whole text is scored.

Cases: a null, empty or blank text is one window of padding; if there is no label to learn from, or only one kind,
every score is the share of toxic labels, or 0; repeated rows get equal rows, several labels of one id count as their
greatest; a null doc_id has no label; an empty table gives no row; columns other than those named are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelode.llm.common import LOWER, blocks, byte_table, fold, runs, table, word_hashes, words
from sitelode.llm.quality import labelled
from sitelode.llm.simhash import RADIUS, components, fingerprint

# Labelled texts learned from, at most, toxic ones and others, each with all its windows; scoring has no such bound.
SAMPLE = 1200
# Words of a window; the next one starts half a window later.
LENGTH = 24
STEP = 12
HIDDEN = 8
WORD_WIDTH = 8
STEM_WIDTH = 6
CHAR_WIDTH = 4
CHAR_BITS = 13
# A stem is the first letters of a word, in bytes.
STEM = 4
# A word, stem or character group has an embedding of its own if texts that have it are toxic more or less often than
# others by so many standard deviations; all others share row 0, so that chance doesn't learn single texts by heart.
# Texts count as independent, so near copies are taken out of the sample first.
DEVIATIONS = 4.5
LEAST_TEXTS = 4
MOST_ROWS = 8192
ROUNDS = 10
RATE = 0.02
TOXIC = 0.7
# Windows scored together.
BATCH = 1024

# A-Z lower-cased; letters, digits, the apostrophe and all beyond ASCII.
WORD = byte_table((0x00, 0x26), (0x28, 0x2F), (0x3A, 0x60), (0x7B, 0x7F), inverse=True)


@dataclass
class Read:
    """The words of some texts: their hashes and those of their stems, their spans, each byte's character group (the
    byte before, the byte itself and two more of its word), and the first word of each text."""

    groups: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    stems: np.ndarray
    firsts: np.ndarray


def char_groups(data: np.ndarray) -> np.ndarray:
    clean = np.where(WORD[data], data, np.uint8(32)).astype(np.uint32)
    padded = np.concatenate([np.full(1, 32, np.uint32), clean, np.full(2, 32, np.uint32)])
    after = padded[2:-1]
    last = np.where(after == 32, np.uint32(32), padded[3:])
    key = (padded[:-3] * np.uint32(0x9E3779B1)) ^ (clean * np.uint32(0x85EBCA6B)) ^ (after * np.uint32(0xC2B2AE35)) ^ (last * np.uint32(0x165667B1))
    key ^= key >> np.uint32(13)
    return (key * np.uint32(0x27D4EB2F) >> np.uint32(32 - CHAR_BITS)).astype(np.int32)


def read(data: np.ndarray, bounds: np.ndarray) -> Read:
    lower = LOWER[data]
    starts, ends, firsts = words(lower, bounds, WORD)
    stems = word_hashes(lower, starts, np.minimum(ends, starts + STEM))
    return Read(char_groups(lower), starts, ends, word_hashes(lower, starts, ends), stems, firsts)


def windows(firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and text of each window; a text of no words has one, too."""
    n = np.diff(firsts)
    count = np.maximum(1, -(-(n - LENGTH) // STEP) + 1)
    text = np.repeat(np.arange(len(n)), count)
    within = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    return firsts[text] + STEP * within, text


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def looked_up(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The row of each hash from 1, or 0."""
    if not len(known):
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, at + 1, 0)


class Network:
    """The weights by name, and the hashes of the words and stems that have an embedding (row 0 is all others')."""

    def __init__(self, weights: dict[str, np.ndarray], known: np.ndarray, stems: np.ndarray):
        self.w, self.known, self.stems = weights, known, stems

    @classmethod
    def fresh(cls, known: np.ndarray, stems: np.ndarray, rng: np.random.Generator) -> Network:
        width = WORD_WIDTH + STEM_WIDTH + CHAR_WIDTH

        def some(*shape: int, scale: float | None = None) -> np.ndarray:
            return (rng.standard_normal(shape) * (scale or shape[0] ** -0.5)).astype(np.float32)

        weights = {
            "words": some(len(known) + 1, WORD_WIDTH, scale=0.1),
            "stems": some(len(stems) + 1, STEM_WIDTH, scale=0.1),
            "chars": some(1 << CHAR_BITS, CHAR_WIDTH, scale=0.1),
        }
        weights["words"][0] = weights["stems"][0] = 0
        for d in "fb":
            weights |= {f"in_{d}": some(width, 3 * HIDDEN), f"bias_{d}": np.zeros(3 * HIDDEN, np.float32), f"on_{d}": some(HIDDEN, 3 * HIDDEN)}
        weights |= {"attend": some(2 * HIDDEN, 1)[:, 0], "out": some(2 * HIDDEN, 1)[:, 0], "bias": np.full(1, -1.0, np.float32)}
        return cls(weights, known, stems)

    def inputs(self, some: Read) -> np.ndarray:
        """What each word enters as; the last row is padding."""
        out = np.zeros((len(some.hashes) + 1, WORD_WIDTH + STEM_WIDTH + CHAR_WIDTH), np.float32)
        if len(some.hashes):
            out[:-1, :WORD_WIDTH] = self.w["words"][looked_up(self.known, some.hashes)]
            out[:-1, WORD_WIDTH:-CHAR_WIDTH] = self.w["stems"][looked_up(self.stems, some.stems)]
            edges = np.stack([some.starts, some.ends], axis=1).ravel()
            groups = self.w["chars"][np.append(some.groups, 0)]
            out[:-1, -CHAR_WIDTH:] = np.add.reduceat(groups, edges, axis=0)[::2] / (some.ends - some.starts)[:, None]
        return out

    def entered(self, inputs: np.ndarray) -> dict[str, np.ndarray]:
        """What each word adds to the gates, by direction."""
        return {d: inputs @ self.w[f"in_{d}"] + self.w[f"bias_{d}"] for d in "fb"}

    def run(self, entered: dict[str, np.ndarray], at: np.ndarray, real: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """The logit of each window; ``at`` has its words (step by window), ``real`` which are no padding."""
        states = []
        for d in "fb":
            on, h = self.w[f"on_{d}"], np.zeros((at.shape[1], HIDDEN), np.float32)
            order = range(LENGTH) if d == "f" else range(LENGTH - 1, -1, -1)
            all_h: list[np.ndarray] = [h] * LENGTH
            trace = []
            for t in order:
                x, g = entered[d][at[t]], h @ on
                gates = sigmoid(x[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
                z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
                new = np.tanh(x[:, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
                if keep is not None:
                    trace.append((t, h, z, r, new, g[:, 2 * HIDDEN :]))
                h = new + z * (h - new)
                all_h[t] = h
            states.append(np.stack(all_h))
            if keep is not None:
                keep[d] = trace
        both = np.concatenate(states, axis=2)
        weight = np.where(real, both @ self.w["attend"], np.float32(-30))
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = (weight[:, :, None] * both).sum(axis=0)
        if keep is not None:
            keep |= {"both": both, "weight": weight, "pooled": pooled}
        return pooled @ self.w["out"] + self.w["bias"]

    def slopes(self, some: Read, inputs: np.ndarray, at: np.ndarray, real: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean log loss."""
        keep: dict = {}
        logit = self.run(self.entered(inputs), at, real, keep)
        w, out = self.w, {}
        d_logit = ((sigmoid(logit) - label) / len(label)).astype(np.float32)
        both, weight, pooled = keep["both"], keep["weight"], keep["pooled"]
        out["out"], out["bias"] = pooled.T @ d_logit, d_logit.sum(keepdims=True)
        d_pooled = d_logit[:, None] * w["out"]
        d_weight = (both * d_pooled).sum(axis=2)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0)) * real
        out["attend"] = np.einsum("tb,tbh->h", d_score, both)
        d_both = weight[:, :, None] * d_pooled + d_score[:, :, None] * w["attend"]
        d_inputs = np.zeros_like(inputs)
        for k, d in enumerate("fb"):
            on, into = w[f"on_{d}"], w[f"in_{d}"]
            d_on, d_entered = np.zeros_like(on), np.zeros((len(inputs), 3 * HIDDEN), np.float32)
            d_h, d_bias = np.zeros((at.shape[1], HIDDEN), np.float32), np.zeros(3 * HIDDEN, np.float32)
            for t, before, z, r, new, g in reversed(keep[d]):
                d_h = d_h + d_both[t, :, k * HIDDEN : (k + 1) * HIDDEN]
                d_new = d_h * (1 - z) * (1 - new * new)
                d_z = d_h * (before - new) * z * (1 - z)
                d_r = d_new * g * r * (1 - r)
                d_x = np.concatenate([d_z, d_r, d_new], axis=1)
                d_g = np.concatenate([d_z, d_r, d_new * r], axis=1)
                d_entered[at[t]] = d_x  # a word is in one window of a batch, and padding enters as zeros
                d_bias += d_x.sum(axis=0)
                d_on += before.T @ d_g
                d_h = d_h * z + d_g @ on.T
            d_entered[-1] = 0
            out[f"on_{d}"], out[f"in_{d}"], out[f"bias_{d}"] = d_on, inputs.T @ d_entered, d_bias
            d_inputs += d_entered @ into.T
        for name in ("words", "stems", "chars"):
            out[name] = np.zeros_like(w[name])
        used = np.flatnonzero(np.abs(d_inputs[:-1]).sum(axis=1))
        np.add.at(out["words"], looked_up(self.known, some.hashes[used]), d_inputs[used, :WORD_WIDTH])
        np.add.at(out["stems"], looked_up(self.stems, some.stems[used]), d_inputs[used, WORD_WIDTH:-CHAR_WIDTH])
        out["words"][0] = out["stems"][0] = 0
        lengths = (some.ends - some.starts)[used]
        groups = some.groups[np.repeat(some.starts[used], lengths) + runs(lengths)]
        np.add.at(out["chars"], groups, np.repeat(d_inputs[used, -CHAR_WIDTH:] / lengths[:, None], lengths, axis=0))
        return out

    def logits(self, some: Read, first: np.ndarray, text: np.ndarray) -> np.ndarray:
        """The logit of each window of some texts."""
        entered, out = self.entered(self.inputs(some)), np.empty(len(first), np.float32)
        for k in range(0, len(first), BATCH):
            out[k : k + BATCH] = self.run(entered, *places(some, first[k : k + BATCH], text[k : k + BATCH]))
        return out

    def logits_apart(self, some: Read, first: np.ndarray, text: np.ndarray) -> np.ndarray:
        """The same for windows far apart; only their own words are put in, some windows at a time."""
        out = np.empty(len(first), np.float32)
        for k in range(0, len(first), BATCH):
            piece = narrowed(some, first[k : k + BATCH], text[k : k + BATCH])
            out[k : k + BATCH] = self.logits(piece, piece.firsts[:-1], np.arange(len(piece.firsts) - 1))
        return out


def places(some: Read, first: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of each window, step by window, and which are no padding."""
    at = first[None, :] + np.arange(LENGTH)[:, None]
    real = at < some.firsts[text + 1][None, :]
    return np.where(real, at, len(some.hashes)), real


def greatest(values: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    return np.maximum.reduceat(values, np.searchsorted(text, np.arange(n))) if n else values


def once_a_text(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's different values, and the text of each; a text at a time, as that takes little memory."""
    found = [np.unique(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return np.concatenate(found), np.repeat(np.arange(len(found), dtype=np.int32), [len(f) for f in found])


def choose(values: np.ndarray, bounds: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values that stand out in toxic texts or in others, and how much likelier each is in a toxic one (log odds)."""
    hashes, text = once_a_text(values, bounds)
    found, number, count = np.unique(hashes, return_inverse=True, return_counts=True)
    bad = np.bincount(number, label[text], len(found))
    total, share = label.sum(), label.mean()
    odds = np.log((bad + 0.5) / (total + 1)) - np.log((count - bad + 0.5) / (len(label) - total + 1))
    off = np.abs(bad - count * share) / np.sqrt(count * share * (1 - share))
    kept = np.flatnonzero((count >= LEAST_TEXTS) & (off >= DEVIATIONS))
    kept = np.sort(kept[np.lexsort((found[kept], -off[kept]))[:MOST_ROWS]])
    return found[kept], odds[kept]


def train(texts: list[str], label: np.ndarray, seed: int = 11) -> Network | float:
    """A network, or the share of toxic labels where there aren't both kinds; equal texts count once."""
    own = np.sort(list({t: i for i, t in reversed(list(enumerate(texts)))}.values())) if len(texts) else np.zeros(0, np.int64)
    texts, label = [texts[i] for i in own], label[own]
    if not len(label) or label.min() == label.max():
        return float(label.mean()) if len(label) else 0.0
    rng = np.random.default_rng(seed)
    raw = [t.encode() for t in texts]
    bounds = np.cumsum([0, *map(len, raw)])
    some = read(np.frombuffer(b"".join(raw), np.uint8), bounds)
    del raw
    known, word_odds = choose(some.hashes, some.firsts, label)
    stems, stem_odds = choose(some.stems, some.firsts, label)
    # The groups of a text's bytes; those between words are no word's.
    chars, _ = choose(some.groups, bounds, label)
    net = Network.fresh(known, stems, rng)
    # Rows of other character groups stay zero.
    held = np.zeros((1 << CHAR_BITS, 1), np.float32)
    held[chars.astype(np.int64)] = 1
    net.w["chars"] *= held
    first, text = windows(some.firsts)
    # The first choice of windows is by the likeliest word or stem in them.
    odds = np.maximum(np.append(0.0, word_odds)[looked_up(known, some.hashes)], np.append(0.0, stem_odds)[looked_up(stems, some.stems)])
    odds, score = np.append(odds, -9.0), np.empty(len(first))
    for k in range(0, len(first), BATCH):
        at, _ = places(some, first[k : k + BATCH], text[k : k + BATCH])
        score[k : k + BATCH] = odds[at].max(axis=0)
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.w.items()}
    beat = 0
    for turn in range(ROUNDS):
        best = score + 1e-6 * rng.random(len(score))
        top = greatest(best, text, len(label))[text] == best
        # Of toxic texts the likeliest window; of others that one, all that score too high, and a random share.
        clean = label[text] == 0
        hard = clean & (score > -2) & (turn > 0)
        chosen = np.flatnonzero(top | hard | (clean & (rng.random(len(text)) < 0.05)))
        goal = label[text[chosen]].astype(np.float32)
        often = np.where(goal == 1, max(1, round(0.5 * (goal == 0).sum() / max(1, goal.sum()))), 1)
        chosen = np.repeat(chosen, np.minimum(often, 8))
        order = rng.permutation(chosen)
        for k in range(0, len(order), 256):
            batch = order[k : k + 256]
            inputs = net.inputs(piece := narrowed(some, first[batch], text[batch]))
            place, real = places(piece, piece.firsts[:-1], np.arange(len(batch)))
            slopes = net.slopes(piece, inputs, place, real, label[text[batch]].astype(np.float32))
            beat += 1
            slopes["chars"] *= held
            for name, slope in slopes.items():
                mean, square = moments[name]
                mean += 0.1 * (slope - mean)
                square += 0.001 * (slope * slope - square)
                rate = RATE * (1 - 0.9 * turn / ROUNDS)
                net.w[name] -= rate * (mean / (1 - 0.9**beat)) / (np.sqrt(square / (1 - 0.999**beat)) + 1e-7)
        score = net.logits_apart(some, first, text)
    return net


def narrowed(some: Read, first: np.ndarray, text: np.ndarray) -> Read:
    """The words of some windows only, each window a text."""
    n = np.minimum(LENGTH, some.firsts[text + 1] - first)
    at = np.repeat(first, n) + runs(n)
    lengths = some.ends[at] - some.starts[at]
    ends = np.cumsum(lengths)
    groups = some.groups[np.repeat(some.starts[at], lengths) + runs(lengths)]
    return Read(groups, ends - lengths, ends, some.hashes[at], some.stems[at], np.concatenate([[0], np.cumsum(n)]))


def toxicity(text: Column, net: Network | float) -> Column:
    """The score of a text, from 0 to 1."""
    context = SparkSession.getActiveSession().sparkContext
    arrays = None if isinstance(net, float) else context.broadcast((net.w, net.known, net.stems))  # less than a megabyte
    constant = net if isinstance(net, float) else 0.0

    def run(column: pa.Array) -> pa.Array:
        out = np.full(len(column), constant)
        if arrays is not None:
            own = Network(*arrays.value)
            for row, data, bounds in blocks(column):
                some = read(data, bounds)
                first, words_of = windows(some.firsts)
                score = sigmoid(own.logits(some, first, words_of).astype(np.float64))
                out[row : row + len(bounds) - 1] = greatest(score, words_of, len(bounds) - 1)
        return pa.array(out)

    return F.arrow_udf(run, "double")(text.cast("string"))


def far_apart(prints: np.ndarray) -> np.ndarray:
    """The first of each component of fingerprints that link, as near copies do."""
    parent = components(prints, np.ones(len(prints), bool), RADIUS)
    return np.unique(parent, return_index=True)[1]


def learned(documents: DataFrame, labels: DataFrame, held_out: Column, most: int = SAMPLE) -> Network | float:
    """Trained on at most ``most`` texts of either label, one row of each id, and one of those that are near copies."""
    rows = []
    for value in (0, 1):
        found = labelled(documents, labels, "toxic", held_out, most, value)
        text = F.coalesce("text", F.lit(""))
        # Of an id that is repeated one text is sent to the driver.
        once = found.groupBy("doc_id", "label").agg(F.min_by(text, F.xxhash64(text)).alias("text"))
        rows += sorted(once.select("doc_id", "text", "label", fingerprint(F.col("text")).alias("fp")).collect(), key=lambda r: (str(r["doc_id"]), r["text"]))
    label = np.array([r["label"] for r in rows], np.int64)
    prints = np.array([r["fp"] for r in rows], np.int64).view(np.uint64)
    kept = np.concatenate([at[far_apart(prints[at])] for at in (np.flatnonzero(label == value) for value in (0, 1))]) if len(rows) else np.zeros(0, np.int64)
    texts = [rows[i]["text"] for i in kept]
    del rows
    return train(texts, label[kept])


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents, held_out = table(spark, folder, "documents"), fold("doc_id", 3) == 1
    net = learned(documents, table(spark, folder, "labels"), held_out)
    scored = documents.select("doc_id", held_out.alias("held_out"), toxicity(F.col("text"), net).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= TOXIC).cast("int"))


QUERIES = {"op7_toxicity": op7_toxicity}
SQL: dict[str, str] = {}
