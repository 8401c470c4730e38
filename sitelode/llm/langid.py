"""Language of texts: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

The model is trained on the driver by stochastic gradient descent on a bounded sample, drawn for each language from its
different texts; the driver gets their counts of subwords, which have a bound however long a text is. Scoring is local
to a row and reads whole texts. Averaging and the last layer commute, so a subword is one row of a table.

Cases: of languages of equal score the first by name is given; rows repeated any number of times are learned from once; a null text or one without a letter is ``und`` with score 0; so is every text if there was nothing to learn from;
repeated rows get equal rows; a null doc_id is learned from and predicted like others; an empty table gives no row;
columns other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelode.llm.common import LOWER, blocks, fold, sampled_each, table

# Documents of each language learned from, at most; the size of an embedding; buckets of each subword length.
SAMPLE = 750
WIDTH = 16
LENGTHS = (2, 3, 4)
BUCKET_BITS = 15
# Bytes whose subwords are looked at together.
STEP_BYTES = 1 << 17
EPOCHS = 6
RATE = 40.0
# Accepted predictions are to be right this often.
PRECISION = 0.99
UNKNOWN = "und"

_MULTIPLIERS = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F)


def subwords(data: np.ndarray) -> np.ndarray:
    """Rows of the table for each byte (column) and subword length (row); at the end they reach into zeros."""
    padded = np.concatenate([LOWER[data], np.zeros(max(LENGTHS), np.uint8)]).astype(np.uint32)
    n = len(data)
    out = np.empty((len(LENGTHS), n), np.int32)
    key = np.zeros(n, np.uint32)
    for i in range(max(LENGTHS)):
        key = (key + padded[i : i + n] + np.uint32(1)) * np.uint32(_MULTIPLIERS[i])
        key ^= key >> np.uint32(15)
        if i + 1 in LENGTHS:
            row = LENGTHS.index(i + 1)
            out[row] = (key * np.uint32(0x2C1B3C6D) >> np.uint32(32 - BUCKET_BITS)).astype(np.int32) + (row << BUCKET_BITS)
    return out


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # subword by language or, where those are many, by embedding
    last: np.ndarray | None  # from embedding to language
    bias: np.ndarray
    heat: float
    accepted: float

    def logits(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """One row per text of a block."""
        sums = np.zeros((len(bounds) - 1, self.table.shape[1]), np.float64)
        for low in range(0, len(data), STEP_BYTES):
            high = min(low + STEP_BYTES, len(data))
            # The bytes after the piece complete its last subwords.
            rows = subwords(data[low : high + max(LENGTHS)])[:, : high - low]
            first, last = np.searchsorted(bounds, [low, high - 1], "right") - 1
            edges = np.clip(bounds[first : last + 1], low, high) - low
            some = np.flatnonzero(np.diff(np.append(edges, high - low)))
            for found in rows:
                sums[first + some] += np.add.reduceat(self.table[found], edges[some], axis=0)
        mean = sums / np.maximum(1, np.diff(bounds))[:, None] / len(LENGTHS)
        return (mean if self.last is None else mean @ self.last) + self.bias


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def examples(text: str, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Subwords and their shares of a text as a whole and of two short pieces of it."""
    rng = np.random.default_rng(seed)
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    pieces = [raw]
    for _ in range(2):
        start = int(rng.integers(0, max(1, len(raw) - 20)))
        pieces.append(raw[start : start + int(rng.integers(10, 120))])
    found = [np.unique(subwords(piece), return_counts=True) for piece in pieces if len(piece)]
    return [(rows, (count / count.sum()).astype(np.float32)) for rows, count in found]


def train(found: list[tuple[np.ndarray, np.ndarray]], of: np.ndarray, langs: list[str], seed: int = 7) -> Model | None:
    """A model of the languages in ``langs``, the languages of some texts; ``found`` are their examples, ``of`` the text of each."""
    names = sorted(set(langs))
    if not names:
        return None
    rng = np.random.default_rng(seed)
    label = np.searchsorted(names, langs)[of]
    table = (rng.standard_normal((len(LENGTHS) << BUCKET_BITS, WIDTH)) * 0.1).astype(np.float32)
    last, bias = (rng.standard_normal((WIDTH, len(names))) * 0.3).astype(np.float32), np.zeros(len(names), np.float32)
    # Every tenth text is kept back, to calibrate on.
    back = of % 10 == 9
    learn = np.flatnonzero(~back)
    batch = 16
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(learn)
        for k in range(0, len(order), batch):
            some = order[k : k + batch]
            rows = np.concatenate([found[i][0] for i in some])
            share = np.concatenate([found[i][1] for i in some])
            sizes = np.array([len(found[i][0]) for i in some])
            edges = np.cumsum(sizes) - sizes
            mean = np.add.reduceat(table[rows] * share[:, None], edges, axis=0)
            error = softmax(mean @ last + bias)
            error[np.arange(len(some)), label[some]] -= 1
            error /= len(some)
            back_to = error @ last.T
            last -= 0.02 * rate * (mean.T @ error)
            bias -= 0.002 * rate * error.sum(axis=0)
            np.subtract.at(table, rows, rate * share[:, None] * np.repeat(back_to, sizes, axis=0))
    model = Model(names, table, last, bias.astype(np.float64), 1.0, 0.0)
    if len(names) <= WIDTH:
        model.table, model.last = (table @ last).astype(np.float32), None
    held = [found[i] for i in np.flatnonzero(back)]
    if held:
        calibrate(model, held, label[back])
    return model


def calibrate(model: Model, held: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray) -> None:
    """The softmax temperature of least loss, and the score from which on predictions are right often enough."""
    mean = np.stack([model.table[rows].T.astype(np.float64) @ share for rows, share in held])
    logits = (mean if model.last is None else mean @ model.last) + model.bias
    losses = {h: -np.mean(np.log(softmax(logits * h)[np.arange(len(label)), label] + 1e-12)) for h in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0)}
    model.heat = min(losses, key=losses.__getitem__)
    odds = softmax(logits * model.heat)
    score, right = odds.max(axis=1), odds.argmax(axis=1) == label
    order = np.argsort(-score)
    precise = np.cumsum(right[order]) >= PRECISION * np.arange(1, len(order) + 1)
    model.accepted = float(score[order][np.flatnonzero(precise)[-1]]) if precise.any() else 1.0


def has_letter(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    out = np.zeros(len(bounds) - 1, bool)
    lower = LOWER[data]
    plain = np.concatenate([[0], np.cumsum((lower >= 97) & (lower <= 122))])
    out[:] = plain[bounds[1:]] > plain[bounds[:-1]]
    for i in np.flatnonzero(~out):
        out[i] = any(c.isalpha() for c in data[bounds[i] : bounds[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


def identify(text: Column, model: Model | None) -> Column:
    """``lang_pred, score, rejected`` of a text."""
    context = None if model is None else SparkSession.getActiveSession().sparkContext
    arrays = context.broadcast((model.table, model.last, model.bias)) if context else None
    rest = (model.langs, model.heat, model.accepted) if model else ([], 1.0, 0.0)

    def run(column: pa.Array) -> pa.Array:
        langs, heat, accepted = rest
        best, score = np.full(len(column), -1), np.zeros(len(column))
        if arrays is not None:
            weights, last, bias = arrays.value
            own = Model(langs, weights, last, bias, heat, accepted)
            for row, data, bounds in blocks(column):
                odds = softmax(own.logits(data, bounds) * heat)
                known = has_letter(data, bounds)
                best[row : row + len(known)] = np.where(known, odds.argmax(axis=1), -1)
                score[row : row + len(known)] = np.where(known, odds.max(axis=1), 0.0)
        names = np.array([*langs, UNKNOWN], object)
        return pa.StructArray.from_arrays([pa.array(names[best], pa.string()), pa.array(score), pa.array(score < accepted)], names=["lang_pred", "score", "rejected"])

    return F.arrow_udf(run, "lang_pred string, score double, rejected boolean")(text.cast("string"))


def learned(documents: DataFrame, held_out: Column, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", most: int = SAMPLE) -> Model | None:
    """A model trained on at most ``most`` different documents of each language that are not held out."""
    text = F.col(text_column).cast("string")
    rows = documents.where(~held_out & F.col(lang_column).isNotNull() & (F.length(text) > 0))
    kept = rows.select(text.alias("text"), F.col(lang_column).cast("string").alias("lang"), F.xxhash64(F.col(id_column), text).alias("order"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            orders, langs = batch.column("order").to_pylist(), batch.column("lang").to_pylist()
            for value, order, lang in zip(batch.column("text").to_pylist(), orders, langs, strict=True):
                some = examples(value, order % 2**64)
                yield pa.RecordBatch.from_pydict({"order": [order] * len(some), "lang": [lang] * len(some), "rows": [r.astype(np.int32).tobytes() for r, _ in some], "shares": [s.tobytes() for _, s in some]})

    drawn = sampled_each(kept, "lang", "order", most)
    got = sorted(drawn.mapInArrow(count, "order long, lang string, rows binary, shares binary").toArrow().to_pylist(), key=lambda r: (r["order"], r["lang"], -len(r["rows"]), r["rows"]))
    texts = list(dict.fromkeys((r["order"], r["lang"]) for r in got))
    place = {text: i for i, text in enumerate(texts)}
    found = [(np.frombuffer(r["rows"], np.int32), np.frombuffer(r["shares"], np.float32)) for r in got]
    return train(found, np.array([place[r["order"], r["lang"]] for r in got], np.int64), [lang for _, lang in texts])


def op10_langid(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    held_out = fold("doc_id", 4) == 2
    model = learned(documents, held_out)
    return documents.select("doc_id", held_out.alias("held_out"), identify(F.col("text"), model).alias("found")).select("doc_id", "held_out", "found.*")


QUERIES = {"op10_langid": op10_langid}
SQL: dict[str, str] = {}
