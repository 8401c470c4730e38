"""Periodic runs of words, found in a grammar: Re-Pair over word ids, runs at each rule's boundary, all its places.

Texts are taken in blocks. A word of a run of ``TIMES`` periods stands at least ``TIMES`` times in it, so a word that a
text has less often parts the text into stretches, and so on inside them; most prose is gone after that, and no run is.
Re-Pair then replaces pairs of neighbouring symbols that stand twice or more by new symbols, in rounds: those more
frequent than the pairs that overlap them first, all over the block. What is left of a stretch is paired up in a
balanced way. Every run lies across the boundary of the lowest symbol it lies in: for each rule, once, the squares that
end or begin at its boundary give candidate periods, and common extensions to both sides, by hashes and doubling steps,
the intervals. They are moved to every place at which the rule stands, and those inside another of their period go.

Words are compared by a 64-bit hash, stretches of words by two 31-bit ones of fixed bases.

Cases: a null or empty text has no words; a null doc_id counts as the empty text where its hash is asked for; repeated
rows get equal rows; a text of any length is one block at least; an empty table gives no row; columns other than the two
named are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from sitelode.llm.common import NOT_BLANK, blocks, mixed, runs, table, word_hashes, words

# A run has so many periods, and so many words, at least.
TIMES = 4
LEAST = 6
# Candidate periods that are looked at together.
PIECE = 1 << 20

_PRIMES = ((1 << 31) - 1, (1 << 31) - 19)
_BASES = (1_103_515_245, 1_664_525)


@dataclass
class Rules:
    """The rules of a grammar, by number: how long the left part and the whole are, a place of the whole, and all its places."""

    left: np.ndarray
    length: np.ndarray
    place: np.ndarray
    used: np.ndarray
    at: np.ndarray


def recurring(ids: np.ndarray, part: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray]:
    """Places of words, and the stretch of each: without stretches of under ``least`` words or words rarer than ``times`` in theirs."""
    place, base = np.arange(len(ids)), int(ids.max(initial=0)) + 1
    while len(place):
        # A stretch is what follows on without a gap in its part.
        begins = np.flatnonzero((np.diff(place, prepend=-2) != 1) | (np.diff(part, prepend=-1) != 0))
        size = np.diff(np.append(begins, len(place)))
        part = np.repeat(np.arange(len(begins)), size)
        long = np.repeat(size >= least, size)
        _, which, count = np.unique(part * base + ids[place], return_inverse=True, return_counts=True)
        kept = long & (count[which] >= times)
        if kept.all():
            break
        place, part = place[kept], part[kept]
    return place, part


def re_pair(symbols: np.ndarray, part: np.ndarray) -> Rules:
    """A grammar of all stretches; ``symbols`` has a number for each word, ``part`` its stretch."""
    symbols, part, at = symbols.astype(np.int64), part.astype(np.int64), np.arange(len(symbols))
    most = int(symbols.max(initial=-1)) + 1
    n_words = most
    length = [np.ones(n_words, np.int64)]
    left, place, used, places = [], [], [], []

    def replace(chosen: np.ndarray, numbers: np.ndarray) -> None:
        """The pairs that begin at the ``chosen`` places become symbols of these numbers."""
        nonlocal symbols, part, at
        used.append(numbers)
        places.append(at[chosen])
        symbols[chosen] = numbers
        kept = np.ones(len(symbols), bool)
        kept[chosen + 1] = False
        symbols, part, at = symbols[kept], part[kept], at[kept]

    def add(chosen: np.ndarray) -> None:
        """New rules, one for each chosen pair's place."""
        both = all_lengths()
        left.append(both[symbols[chosen]])
        length.append(both[symbols[chosen]] + both[symbols[chosen + 1]])
        place.append(at[chosen])

    def all_lengths() -> np.ndarray:
        if len(length) > 1:
            length[:] = [np.concatenate(length)]
        return length[0]

    known: dict[int, int] = {}
    while len(symbols) > 1:
        pair = np.where(part[1:] == part[:-1], symbols[:-1] << 31 | symbols[1:], -1)
        found, which, count = np.unique(pair, return_inverse=True, return_counts=True)
        # The more frequent pairs first; a hash decides between others.
        order = np.lexsort((mixed(found.astype(np.uint64)), count))
        rank = np.empty(len(found), np.int64)
        rank[order] = np.arange(1, len(found) + 1)
        rank[(count < 2) | (found < 0)] = 0
        rank = rank[which]
        # Pairs in a row that are equal overlap: every other one is taken.
        begins = np.flatnonzero(np.diff(rank, prepend=-1))
        size = np.diff(np.append(begins, len(rank)))
        of = rank[begins]
        greater = (of > np.append(0, of[:-1])) & (of > np.append(of[1:], 0))
        chosen = np.flatnonzero(np.repeat(greater, size) & (runs(size) % 2 == 0))
        if not len(chosen):
            break
        kinds, first, number = np.unique(pair[chosen], return_index=True, return_inverse=True)
        fresh = np.array([k not in known for k in kinds.tolist()])
        for k in kinds[fresh].tolist():
            known[k] = most
            most += 1
        add(chosen[first[fresh]])
        replace(chosen, np.array([known[k] for k in kinds.tolist()], np.int64)[number])
    # No pair stands twice now: a balanced tree over what is left.
    while len(symbols) > 1:
        begins = np.flatnonzero(np.diff(part, prepend=-1))
        within = runs(np.diff(np.append(begins, len(part))))
        chosen = np.flatnonzero((part[1:] == part[:-1]) & (within[:-1] % 2 == 0))
        if not len(chosen):
            break
        add(chosen)
        replace(chosen, np.arange(most, most + len(chosen)))
        most += len(chosen)
    none = np.zeros(0, np.int64)
    joined = [np.concatenate(c) if c else none for c in (left, place, used, places)]
    return Rules(joined[0], all_lengths()[n_words:], joined[1], joined[2] - n_words, joined[3])


class Hashes:
    """Hashes of all stretches of a sequence of numbers."""

    def __init__(self, symbols: np.ndarray):
        self.sums, self.powers = [], []
        for prime, base in zip(_PRIMES, _BASES, strict=True):
            power, square = np.ones(len(symbols) + 1, np.int64), base
            bit = 1
            while bit <= len(symbols):
                # Powers of exponents up to 2 * bit, from those up to bit.
                more = power[bit : 2 * bit]
                more[:] = power[: len(more)] * square % prime
                square, bit = square * square % prime, 2 * bit
            # Random-looking values below 2^30, so that sums of products of many stay in 64 bits.
            value = (mixed(symbols.astype(np.uint64) + np.uint64(prime)) >> np.uint64(34)).astype(np.int64)
            terms = value * power[:-1] % prime
            self.sums.append(np.concatenate([np.zeros(1, np.int64), np.cumsum(terms)]))
            self.powers.append(power)

    def equal(self, a: np.ndarray, q: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the ``n`` symbols from ``a`` equal those from ``a + q``."""
        same = np.ones(len(a), bool)
        for sums, power, prime in zip(self.sums, self.powers, _PRIMES, strict=True):
            first, second = (sums[a + n] - sums[a]) % prime, (sums[a + q + n] - sums[a + q]) % prime
            same &= first * power[q] % prime == second
        return same

    def forward(self, a: np.ndarray, q: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many symbols from ``a`` on equal those ``q`` further, up to ``most``."""
        done = np.zeros(len(a), np.int64)
        for bit in range(int(most.max(initial=0)).bit_length() - 1, -1, -1):
            step = np.minimum(1 << bit, most - done)
            done += np.where(self.equal(a + done, q, step), step, 0)
        return done

    def backward(self, a: np.ndarray, q: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many symbols before ``a`` equal those ``q`` further, up to ``most``."""
        done = np.zeros(len(a), np.int64)
        for bit in range(int(most.max(initial=0)).bit_length() - 1, -1, -1):
            step = np.minimum(1 << bit, most - done)
            done += np.where(self.equal(a - done - step, q, step), step, 0)
        return done


def crossing(rules: Rules, hashes: Hashes, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rule, start and end (from the rule's start) and period of the runs across each rule's boundary, inside the rule.

    A run of four periods has two of them on one side of the boundary: a square ends or begins there.
    """
    most = np.where(rules.length >= least, rules.length // times, 0)
    out = [], [], [], []
    ends = np.cumsum(most)
    low = 0
    while low < len(most):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + PIECE, "right")))
        rule = np.repeat(np.arange(low, high), most[low:high])
        q = runs(most[low:high]) + 1
        start, middle, end = rules.place[rule], rules.place[rule] + rules.left[rule], rules.place[rule] + rules.length[rule]
        right = np.flatnonzero(middle + 2 * q <= end)
        left = np.flatnonzero(middle - 2 * q >= start)
        right = right[hashes.equal(middle[right], q[right], q[right])]
        left = left[hashes.equal(middle[left] - 2 * q[left], q[left], q[left])]
        # Two squares of one period may be of different runs. From a pair of words, q apart, inside a square: on to both sides.
        some = np.concatenate([left, right])
        rule, q, start, middle, end = rule[some], q[some], start[some], middle[some], end[some]
        origin = middle - np.where(np.arange(len(some)) < len(left), q, 0)
        last = origin + q + hashes.forward(origin, q, end - q - origin)
        first = origin - hashes.backward(origin, q, origin - start)
        size = last - first
        kept = np.flatnonzero((size >= np.maximum(least, times * q)) & (first < middle) & (last > middle))
        # Of several periods of one interval the smallest.
        order = kept[np.lexsort((q[kept], last[kept], first[kept], rule[kept]))]
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(rule[order]) != 0) | (np.diff(first[order]) != 0) | (np.diff(last[order]) != 0)
        order = order[new]
        for column, values in zip(out, (rule[order], first[order] - start[order], last[order] - start[order], q[order]), strict=True):
            column.append(values)
        low = high
    return tuple(np.concatenate(c) if c else np.zeros(0, np.int64) for c in out)


def found_runs(symbols: np.ndarray, text: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of all runs of some texts, by start and period; ``symbols`` are the words' numbers, ``text`` their texts."""
    none = np.zeros(0, np.int64)
    place, part = recurring(symbols, text, least, times)
    if not len(place):
        return none, none, none
    _, dense = np.unique(symbols[place], return_inverse=True)
    rules = re_pair(dense, part)
    rule, start, end, period = crossing(rules, Hashes(dense), least, times)
    # Every place at which a rule with runs stands.
    order = np.argsort(rules.used, kind="stable")
    first, last = np.searchsorted(rules.used[order], rule), np.searchsorted(rules.used[order], rule, "right")
    n = last - first
    which = np.repeat(np.arange(len(rule)), n)
    at = rules.at[order[np.repeat(first, n) + runs(n)]]
    start, end, period = at + start[which], at + end[which], period[which]
    # Intervals of one period and stretch inside one another are of one run; its whole is there, at its lowest symbol.
    stretch = part[start]
    order = np.lexsort((-end, start, stretch, period))
    start, end, period, stretch = start[order], end[order], period[order], stretch[order]
    group = np.cumsum((np.diff(period, prepend=-1) != 0) | (np.diff(stretch, prepend=-1) != 0)) * (len(dense) + 1)
    reached = np.maximum.accumulate(end + group) if len(end) else end
    kept = np.ones(len(end), bool)
    kept[1:] = (end + group)[1:] > reached[:-1]
    start, end, period = start[kept], end[kept], period[kept]
    # Places in a stretch follow on each other.
    start, end = place[start], place[end - 1] + 1
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def repeated_tails(n: int, doc_id: int | None, every: int = 10) -> np.ndarray | None:
    """Which word each word becomes in texts that get a periodic tail: those whose id's hash is divisible by ``every``."""
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if h % every or not n:
        return None
    g = h // every
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + np.arange(n - a) % p
    return at


def periodic_runs(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", tails: bool = False) -> DataFrame:
    """``doc_id, n_words, runs, n_kept, collapsed_sha256`` of each row.

    ``runs`` are ``start, length, period`` in words, by start and period. The digest is of the text in which each run is
    cut down to its first period, words joined by one space. With ``tails``, texts get periodic tails first.
    """
    rows = documents.select(documents[id_column].alias("doc_id"), documents[text_column].cast("string").alias("text"))
    run_type = T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")])
    schema = T.StructType(
        [rows.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(run_type, False))]
        + [T.StructField("n_kept", T.LongType()), T.StructField("collapsed_sha256", T.StringType())]
    )
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for row, data, bounds in blocks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(bounds) - 1), *of_block(ids[row:], data, bounds)], names=schema.names)

    def of_block(ids: list, data: np.ndarray, bounds: np.ndarray) -> list[pa.Array]:
        starts, ends, firsts = words(data, bounds, NOT_BLANK)
        n = np.diff(firsts)
        changed = {}
        if tails:
            changed = {i: at for i in range(len(n)) if (at := repeated_tails(int(n[i]), ids[i])) is not None}
            source = np.arange(len(starts))
            for i, at in changed.items():
                source[firsts[i] : firsts[i + 1]] = firsts[i] + at
            starts, ends = starts[source], ends[source]
        text = np.repeat(np.arange(len(n)), n)
        _, symbols = np.unique(word_hashes(data, starts, ends), return_inverse=True)
        start, end, period = found_runs(symbols, text)
        # What follows the first period of a run goes.
        edges = np.zeros(len(starts) + 1, np.int64)
        np.add.at(edges, start + period, 1)
        np.add.at(edges, end, -1)
        kept = np.cumsum(edges[:-1]) == 0
        raw = data.tobytes()
        digests = []
        of_text = text[start]
        touched = set(of_text.tolist()) | changed.keys()
        for i in range(len(n)):
            if i in touched:
                here = firsts[i] + np.flatnonzero(kept[firsts[i] : firsts[i + 1]])
                left = [raw[a:b] for a, b in zip(starts[here].tolist(), ends[here].tolist(), strict=True)]
            else:
                left = raw[bounds[i] : bounds[i + 1]].split()
            digests.append(hashlib.sha256(b" ".join(left)).hexdigest())
        sums = np.concatenate([[0], np.cumsum(kept)])
        found = pa.StructArray.from_arrays([pa.array(start - firsts[of_text]), pa.array(end - start), pa.array(period)], fields=list(kind.value_type))
        offsets = np.searchsorted(of_text, np.arange(len(n) + 1)).astype(np.int32)
        return [pa.array(n), pa.ListArray.from_arrays(pa.array(offsets), found, type=kind), pa.array(sums[firsts[1:]] - sums[firsts[:-1]]), pa.array(digests, pa.string())]

    return rows.mapInArrow(find, schema)


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs(table(spark, folder, "documents"), tails=True)
    # The greatest by length; of equal ones that with the smallest start, then period.
    best = "aggregate(runs, cast(null AS struct<start:bigint,length:bigint,period:bigint>), (a, r) -> CASE WHEN a IS NULL OR r.length > a.length THEN r ELSE a END)"
    listed = r"array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')"
    best_of = found.selectExpr("doc_id", "n_words", "cast(size(runs) AS bigint) AS n_runs", f"{best} AS best", f"sha2({listed}, 256) AS runs_sha256", "collapsed_sha256")
    milli = "1000 * best.length div best.period AS exponent_milli"
    return best_of.selectExpr("doc_id", "n_runs", "best.start", "best.length", "best.period", milli, "runs_sha256", "collapsed_sha256", "n_words")


QUERIES = {"op12_periodic_runs": op12_periodic_runs}
SQL: dict[str, str] = {}
