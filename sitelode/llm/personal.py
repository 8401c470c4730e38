"""Personal data in texts: four fixed patterns, and what a character network with a CRF finds besides.

A bidirectional LSTM over characters gives each one a score per tag (outside, or the first or a further character of an
email address, an IP address, a card or a phone number); a CRF's transitions join them to the best sequence of tags. It
is trained in numpy, on the driver, on windows from a bounded sample of texts, labelled by the patterns. In copies of
these windows the spans are spelled as people write them to escape patterns ("name (at) host [dot] org", "(743)
555-3824", "10[.]0[.]0[.]7"), so that the network learns spans the patterns miss. Whole texts are read in windows that
half overlap. A window without a digit, an at sign or the word "at" between blanks or brackets can hold no such span and is
not run. Spans cut off by a window's edge are left to its neighbour, which holds them whole; of all windows' spans of a text, those
of the greatest total score that don't overlap are taken, by dynamic programming. A span also has to be well formed
when its spelling is undone, and to overlap no base span.

Cases: a null text counts as empty and has no span; without labelled windows to learn from there are base spans only;
a text of any length is read whole; equal scores go to the earlier span; repeated rows get equal rows, an empty table
gives no row; columns other than those named are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelode.llm.common import sampled, table

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
NUMBERS = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Texts that windows are taken from, windows with and without spans from each of them, and windows learned from by kind
# (those without any count as one), at most; nothing else has a bound.
SAMPLE = 8000
PER_TEXT = 3
PER_KIND = 800
# Characters of a window; the next one starts half a window later.
LENGTH = 128
STEP = LENGTH // 2
HIDDEN = 16
ROUNDS = 8
RATE = 0.03
# Windows of a training step, and windows decoded together.
GROUP = 128
BATCH = 512
# Texts whose characters are looked at together.
TEXT_BLOCK = 1 << 20
# Classes of characters: printable ASCII, control characters and blanks, letters and others beyond ASCII, padding.
BLANK, LETTER, OTHER, PADDING = 96, 97, 98, 99
TAGS = 1 + 2 * len(KINDS)
NEVER = np.float32(-1e4)


def luhn(digits: str) -> bool:
    doubled = [int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Start, kind (a number) and end of what the patterns find, by start and kind."""
    found = []
    last = 0
    for m in DOMAIN.finditer(text):
        # The local part is what can be one before the sign, after the last address.
        start = m.start()
        while start > last and LOCAL.match(text, start - 1, start):
            start -= 1
        if start < m.start():
            found.append((start, 0, last := m.end()))
    for m in NUMBERS.finditer(text):
        parts = m[0].split(".")
        at = m.start()
        for i in range(0, len(parts) - 3, 4):
            some = parts[i : i + 4]
            end = at + sum(map(len, some)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in some):
                found.append((at, 1, end))
            at = end + 1
    for m in CARD.finditer(text):
        if 12 <= len(digits := digits_of(m[0])) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return sorted(found)


AT = re.compile(r"\s*[(\[{<]\s*(?:at|@)\s*[)\]}>]\s*|\s+at\s+|\s*@\s*", re.I)
DOT = re.compile(r"\s*[(\[{<]\s*(?:dot|\.)\s*[)\]}>]\s*|\s+dot\s+|\s*\.\s*", re.I)
ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")


def well_formed(text: str, kind: int) -> bool:
    """Whether a found span is of its kind when its spelling is undone."""
    if kind == 0:
        return bool(ADDRESS.fullmatch(DOT.sub(".", AT.sub("@", text))))
    if kind == 1:
        parts = DOT.sub(".", text).split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    digits = digits_of(text)
    if kind == 2:
        return 12 <= len(digits) <= 19 and luhn(digits) and not any(c.isalpha() for c in text)
    return 9 <= len(digits) <= 15 and len(re.split(r"[^0-9]+", text.strip("+() "))) >= 3 and not any(c.isalpha() for c in text)


def classes(points: np.ndarray) -> np.ndarray:
    """The class of each code point."""
    out = np.full(len(points), OTHER, np.uint8)
    # Letters beyond ASCII: Latin to Armenian and so on up to the general punctuation, then CJK and beyond.
    out[((points >= 0xC0) & (points < 0x2000)) | ((points >= 0x3040) & (points < 0xE000))] = LETTER
    plain = points < 127
    out[plain] = np.where(points[plain] < 33, BLANK, points[plain] - 31).astype(np.uint8)
    return out


def triggers(found: np.ndarray) -> np.ndarray:
    """Characters (as classes) without one of which no span is looked for: digits, at signs, the "a" of an "at" alone."""
    out = ((found >= ord("0") - 31) & (found <= ord("9") - 31)) | (found == ord("@") - 31)
    a, t = (np.isin(found, [ord(c) - 31 for c in both]) for both in ("aA", "tT"))
    before = np.isin(found, [BLANK, *(ord(c) - 31 for c in "([{<")])
    after = np.isin(found, [BLANK, *(ord(c) - 31 for c in ")]}>")])
    out[1:-2] |= before[:-3] & a[1:-2] & t[2:-1] & after[3:]
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def allowed() -> tuple[np.ndarray, np.ndarray]:
    """Which tag may follow which, and which may come first: a further character follows its own kind only."""
    move, first = np.ones((TAGS, TAGS), bool), np.ones(TAGS, bool)
    for k in range(len(KINDS)):
        further = 2 + 2 * k
        move[:, further] = False
        move[[further - 1, further], further] = True
        first[further] = False
    return move, first


class Tagger:
    """The network's weights by name."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> Tagger:
        def some(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) * 0.2).astype(np.float32)

        weights = {}
        for d in "fb":
            weights |= {f"in_{d}": some(PADDING + 1, 4 * HIDDEN), f"on_{d}": some(HIDDEN, 4 * HIDDEN)}
            # Forget gates begin open.
            weights[f"in_{d}"][:, HIDDEN : 2 * HIDDEN] += 1
        weights |= {"out": some(2 * HIDDEN, TAGS), "bias": np.zeros(TAGS, np.float32), "move": np.zeros((TAGS, TAGS), np.float32), "first": np.zeros(TAGS, np.float32)}
        return cls(weights)

    def transitions(self) -> tuple[np.ndarray, np.ndarray]:
        move, first = allowed()
        return np.where(move, self.w["move"], NEVER), np.where(first, self.w["first"], NEVER)

    def emissions(self, chars: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """The score of each tag: step, window, tag; ``chars`` are classes by step and window. Padding is outside."""
        steps, n = chars.shape
        both = np.empty((steps, n, 2 * HIDDEN), np.float32)
        for side, d in enumerate("fb"):
            into, on = self.w[f"in_{d}"], self.w[f"on_{d}"]
            h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
            trace = []
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                x = into[chars[t]] + h @ on
                gates = sigmoid(x[:, : 3 * HIDDEN])
                new = np.tanh(x[:, 3 * HIDDEN :])
                before, old = h, c
                c = gates[:, HIDDEN : 2 * HIDDEN] * c + gates[:, :HIDDEN] * new
                bent = np.tanh(c)
                h = gates[:, 2 * HIDDEN :] * bent
                both[t, :, side * HIDDEN : (side + 1) * HIDDEN] = h
                if keep is not None:
                    trace.append((t, before, old, gates, new, bent))
            if keep is not None:
                keep[d] = trace
        if keep is not None:
            keep["both"] = both
        scores = both @ self.w["out"] + self.w["bias"]
        scores[:, :, 1:][chars == PADDING] = NEVER
        return scores

    def slopes(self, chars: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The mean negative log likelihood of the tags of some windows, and its gradients."""
        keep: dict = {}
        scores = self.emissions(chars, keep).astype(np.float64)
        move, first = (x.astype(np.float64) for x in self.transitions())
        steps, n, _ = scores.shape
        ahead, behind = np.empty_like(scores), np.zeros_like(scores)
        ahead[0] = first + scores[0]
        for t in range(1, steps):
            ahead[t] = log_sum(ahead[t - 1][:, :, None] + move, 1) + scores[t]
        for t in range(steps - 2, -1, -1):
            behind[t] = log_sum(move + (scores[t + 1] + behind[t + 1])[:, None, :], 2)
        total = log_sum(ahead[-1], 1)
        at = np.arange(n)
        gold = first[tags[0]] + scores[0, at, tags[0]]
        d_scores, d_move = np.exp(ahead + behind - total[:, None]), np.zeros_like(move)
        for t in range(1, steps):
            gold += move[tags[t - 1], tags[t]] + scores[t, at, tags[t]]
            d_move += np.exp(ahead[t - 1][:, :, None] + move + (scores[t] + behind[t])[:, None, :] - total[:, None, None]).sum(axis=0)
        np.add.at(d_move, (tags[:-1].ravel(), tags[1:].ravel()), -1)
        np.add.at(d_scores, (np.repeat(np.arange(steps), n), np.tile(at, steps), tags.ravel()), -1)
        out = {"move": d_move / n, "first": d_scores[0].sum(axis=0) / n}
        may_move, may_first = allowed()
        out["move"][~may_move] = 0
        out["first"][~may_first] = 0
        d_scores[chars == PADDING] = 0
        d_scores = (d_scores / n).astype(np.float32)
        both = keep["both"]
        out["out"] = np.tensordot(both, d_scores, ((0, 1), (0, 1)))
        out["bias"] = d_scores.sum(axis=(0, 1))
        d_both = d_scores @ self.w["out"].T
        for side, d in enumerate("fb"):
            into, on = self.w[f"in_{d}"], self.w[f"on_{d}"]
            d_in, d_on = np.zeros_like(into), np.zeros_like(on)
            d_h, d_c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
            for t, before, old, gates, new, bent in reversed(keep[d]):
                d_h = d_h + d_both[t, :, side * HIDDEN : (side + 1) * HIDDEN]
                put, kept, shown = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
                d_c = d_c + d_h * shown * (1 - bent * bent)
                d_gates = np.concatenate([d_c * new, d_c * old, d_h * bent], axis=1) * gates * (1 - gates)
                d_x = np.concatenate([d_gates, d_c * put * (1 - new * new)], axis=1)
                np.add.at(d_in, chars[t], d_x)
                d_on += before.T @ d_x
                d_h, d_c = d_x @ on.T, d_c * kept
            out[f"in_{d}"], out[f"on_{d}"] = d_in, d_on
        return float((total - gold).mean()), out

    def decoded(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best tags by step and window, and what each step adds to their score over staying outside."""
        scores = self.emissions(chars)
        move, first = (x.astype(np.float32) for x in self.transitions())
        steps, n, _ = scores.shape
        best, back = first + scores[0], np.empty((steps, n, TAGS), np.int8)
        for t in range(1, steps):
            ways = best[:, :, None] + move
            back[t] = ways.argmax(axis=1)
            best = ways.max(axis=1) + scores[t]
        tags = np.empty((steps, n), np.int64)
        tags[-1] = best.argmax(axis=1)
        at = np.arange(n)
        for t in range(steps - 1, 0, -1):
            tags[t - 1] = back[t, at, tags[t]]
        gain = np.take_along_axis(scores, tags[:, :, None], 2)[:, :, 0] - scores[:, :, 0]
        gain[1:] += move[tags[:-1], tags[1:]] - move[0, 0]
        return tags, gain


def train(chars: np.ndarray, tags: np.ndarray, seed: int = 13) -> Tagger:
    """``chars`` and ``tags`` by window and step."""
    rng = np.random.default_rng(seed)
    net = Tagger.fresh(rng)
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.w.items()}
    beat = 0
    for turn in range(ROUNDS):
        order = rng.permutation(len(chars))
        for k in range(0, len(order), GROUP):
            some = order[k : k + GROUP]
            _, slopes = net.slopes(chars[some].T, tags[some].T)
            beat += 1
            norm = np.sqrt(sum(float((s * s).sum()) for s in slopes.values()))
            for name, slope in slopes.items():
                slope = (slope * min(1.0, 5 / (norm + 1e-9))).astype(np.float32)
                mean, square = moments[name]
                mean += 0.1 * (slope - mean)
                square += 0.001 * (slope * slope - square)
                net.w[name] -= RATE * (1 - 0.9 * turn / ROUNDS) * (mean / (1 - 0.9**beat)) / (np.sqrt(square / (1 - 0.999**beat)) + 1e-7)
    return net


def respelled(text: str, kind: int, rng: np.random.Generator) -> str:
    """A span as it is written to escape patterns, or for people's eyes."""

    def one(*ways: str) -> str:
        return ways[rng.integers(len(ways))]

    if kind == 0:
        local, _, domain = text.rpartition("@")
        at = one(" at ", " (at) ", "(at)", " [at] ", "[at]", " AT ", " @ ", "@")
        return local + at + domain.replace(".", one(" dot ", "(dot)", " (dot) ", "[dot]", " [dot] ", "[.]", " DOT ", "."))
    if kind == 1:
        return text.replace(".", one("[.]", "(.)", " . ", "[dot]", " dot "))
    digits = digits_of(text)
    if kind == 2:
        return one(".", " - ", "/", "  ", "_").join(digits[i : i + 4] for i in range(0, len(digits), 4))
    a, b, c = digits[-10:-7], digits[-7:-4], digits[-4:]
    return one(f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"001 {a} {b} {c}", f"1-{a}-{b}-{c}", f"{a}/{b}-{c}")


def window_of(text: str, spans: list[tuple[int, int, int]], respell: bool, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Classes and tags of a window's characters."""
    pieces, tags, last = [], [], 0
    for start, kind, end in spans:
        if start < last:
            continue
        written = respelled(text[start:end], kind, rng) if respell else text[start:end]
        pieces += [text[last:start], written]
        tags += [0] * (start - last) + [1 + 2 * kind] + [2 + 2 * kind] * (len(written) - 1)
        last = end
    whole = "".join([*pieces, text[last:]])[:LENGTH]
    tags = (tags + [0] * LENGTH)[:LENGTH]
    found = classes(np.frombuffer(whole.encode("utf-32-le", "replace"), np.uint32))
    return np.pad(found, (0, LENGTH - len(found)), constant_values=PADDING), np.array(tags, np.int64)


def labelled_windows(documents: DataFrame, text_column: str, most: int, seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """Classes and tags of windows to learn from, with base spans and without; each span both as it is and respelled."""
    text = F.col(text_column).cast("string")
    likely = documents.where(text.rlike(r"[0-9@]")).select(text.alias("text")).withColumn("hash", F.xxhash64("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column(0).to_pylist():
                # Chosen by a hash of place and text, not by place.
                mark, n, spans = crc32(value[:1000].encode("utf-8", "replace")), len(value), base_spans(value)
                chosen = sorted(spans, key=lambda s: crc32(f"{mark}:{s[0]}".encode()))[:PER_TEXT]
                starts = [(max(0, s[0] - (mark + i) % STEP), s[1]) for i, s in enumerate(chosen) if s[2] - s[0] <= STEP]
                found = classes(np.frombuffer(value.encode("utf-32-le", "replace"), np.uint32))
                marked = np.flatnonzero(triggers(found)) if n > 3 else np.zeros(0, np.int64)
                for i in range(PER_TEXT):
                    if len(marked):
                        starts.append((max(0, int(marked[(mark + 7919 * i) % len(marked)]) - (mark >> i) % LENGTH), -1))
                starts.append((mark % max(1, n - LENGTH), -1))
                for start, kind in starts:
                    inside = [(max(0, a - start), k, min(b, start + LENGTH) - start) for a, k, b in spans if a < start + LENGTH and b > start]
                    out.append((mark ^ crc32(str(start).encode()), -1 if kind < 0 and not inside else max(kind, *(k for _, k, _ in inside)), value[start : start + LENGTH], inside))
            mark, kind, value, inside = zip(*out, strict=True) if out else ((), (), (), ())
            spans = [[{"start": a, "kind": k, "end": b} for a, k, b in some] for some in inside]
            kinds = pa.int64(), pa.int32(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
            columns = [pa.array(c, k) for c, k in zip((mark, kind, value, spans), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["mark", "kind", "text", "spans"])

    drawn = sampled(likely, "hash", most).select("text")
    cuts = drawn.mapInArrow(cut, "mark long, kind int, text string, spans array<struct<start:int,kind:int,end:int>>")
    rows = sorted(cuts.collect(), key=lambda r: (r["mark"], r["text"]))
    rng = np.random.default_rng(seed)
    taken, chars, tags = dict.fromkeys(range(-1, len(KINDS)), 0), [], []
    for row in rows:
        if taken[row["kind"]] < (2 if row["kind"] < 0 else 1) * PER_KIND:
            taken[row["kind"]] += 1
            spans = [(s["start"], s["kind"], s["end"]) for s in row["spans"]]
            for respell in (False, True) if spans else (False,):
                found = window_of(row["text"], spans, respell, rng)
                chars.append(found[0])
                tags.append(found[1])
    if not any(taken[k] for k in range(len(KINDS))):
        return np.zeros((0, LENGTH), np.uint8), np.zeros((0, LENGTH), np.int64)
    return np.array(chars), np.array(tags)


def learned(documents: DataFrame, text_column: str = "text", most: int = SAMPLE) -> Tagger | None:
    chars, tags = labelled_windows(documents, text_column, most)
    return train(chars, tags) if len(chars) else None


def window_spans(net: Tagger, found: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, int, float]]:
    """Text, start, kind, end and score of the spans of all windows of some texts, whose characters' classes are ``found``."""
    size = np.diff(bounds)
    count = np.where(size > 0, np.maximum(1, -(-(size - LENGTH) // STEP) + 1), 0)
    text = np.repeat(np.arange(len(size)), count)
    start = bounds[text] + STEP * (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count))
    end = np.minimum(start + LENGTH, bounds[text + 1])
    sums = np.concatenate([[0], np.cumsum(triggers(found))]) if len(found) > 3 else np.zeros(len(found) + 1, np.int64)
    hit = np.flatnonzero(sums[end] > sums[start])
    text, start, end = text[hit], start[hit], end[hit]
    padded = np.append(found, np.uint8(PADDING))
    for k in range(0, len(start), BATCH):
        at = start[k : k + BATCH] + np.arange(LENGTH)[:, None]
        tags, gain = net.decoded(padded[np.where(at < end[k : k + BATCH], at, len(found))])
        tags, gain = tags.T, np.cumsum(gain.T, axis=1)
        for i in np.flatnonzero(tags.any(axis=1)).tolist():
            row, which = tags[i], k + i
            firsts = np.flatnonzero((row % 2 == 1) & (row > 0))
            for a in firsts.tolist():
                rest = np.flatnonzero(row[a + 1 :] != row[a] + 1)
                b = a + 1 + (int(rest[0]) if len(rest) else LENGTH - a - 1)
                low, high = int(start[which]) + a, int(start[which]) + b
                # A window's edge inside the text cuts spans off; the next window has them whole.
                if (a == 0 and low > bounds[text[which]]) or (b == LENGTH and high < bounds[text[which] + 1]):
                    continue
                score = float(gain[i, b - 1] - (gain[i, a - 1] if a else 0))
                yield int(text[which]), low, (int(row[a]) - 1) // 2, high, score


def best_apart(spans: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int]]:
    """Of spans (start, kind, end, score) those of the greatest total score that don't overlap."""
    merged: dict[tuple[int, int, int], float] = {}
    for start, kind, end, score in spans:
        merged[start, kind, end] = max(score, merged.get((start, kind, end), score))
    order = sorted(((s[2], s[0], s[1], score) for s, score in merged.items() if score > 0))
    ends = [o[0] for o in order]
    total, taken = [0.0], []
    for i, (_, start, _, score) in enumerate(order):
        before = int(np.searchsorted(ends[:i], start, "right"))
        taken.append(before if total[before] + score > total[i] else -1)
        total.append(max(total[i], total[before] + score))
    out, i = [], len(order)
    while i:
        if taken[i - 1] < 0:
            i -= 1
        else:
            end, start, kind, _ = order[i - 1]
            out.append((start, kind, end))
            i = taken[i - 1]
    return out[::-1]


def all_spans(texts: list[str], net: Tagger | None) -> list[list[tuple[int, int, int]]]:
    """Base spans and the network's, of each text, by start and kind."""
    out = [base_spans(t) for t in texts]
    base = [len(o) for o in out]
    row = 0
    while net is not None and row < len(texts):
        stop, size = row, 0
        while stop < len(texts) and (stop == row or size + len(texts[stop]) <= TEXT_BLOCK):
            size += len(texts[stop])
            stop += 1
        raw = "".join(texts[row:stop]).encode("utf-32-le", "replace")
        bounds = np.cumsum([0, *(len(t) for t in texts[row:stop])])
        found: dict[int, list[tuple[int, int, int, float]]] = {}
        for text, start, kind, end, score in window_spans(net, classes(np.frombuffer(raw, np.uint32)), bounds):
            low = int(bounds[text])
            if well_formed(texts[row + text][start - low : end - low], kind):
                found.setdefault(row + text, []).append((start - low, kind, end - low, score))
        for text, spans in found.items():
            known = out[text][: base[text]]
            out[text] = sorted(known + [s for s in best_apart(spans) if all(s[2] <= a or s[0] >= b for a, _, b in known)])
        row = stop
    return out


def personal(text: Column, net: Tagger | None) -> Column:
    """An array of ``start, kind, end, base`` for each text; ``base`` tells what the patterns find from what the network adds."""
    sent = None if net is None else SparkSession.getActiveSession().sparkContext.broadcast(net.w)  # some 70 kilobytes

    def run(column: pa.Array) -> pa.Array:
        own = None if sent is None else Tagger(sent.value)
        texts = [t or "" for t in column.to_pylist()]
        out = []
        for value, spans in zip(texts, all_spans(texts, own), strict=True):
            known = set(base_spans(value)) if spans else ()
            out.append([{"start": s[0], "kind": KINDS[s[1]], "end": s[2], "base": s in known} for s in spans])
        return pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64()), ("base", pa.bool_())])))

    return F.arrow_udf(run, "array<struct<start:bigint,kind:string,end:bigint,base:boolean>>")(text.cast("string"))


def op11_personal(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    found = documents.select("doc_id", personal(F.col("text"), learned(documents)).alias("found"))
    base = F.filter("found", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def listed(some: Column) -> Column:
        return F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    added = F.size(F.filter("found", lambda s: ~s["base"])).cast("long")
    return found.select("doc_id", *map(count, KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"), added.alias("n_added"))


QUERIES = {"op11_personal": op11_personal}
SQL: dict[str, str] = {}
