"""Many literal patterns at once: which of a table's tokens each text holds, in one pass over the text."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bytes of tokens that one automaton is built of; a larger table is dealt to several, each with a pass of its own.
PART_BYTES = 8 << 20
# Stretches of texts whose tokens a worker keeps, and the longest that it does.
KEPT_STRETCHES = 100_000
KEPT_SIGNS = 64


class Automaton:
    """Aho and Corasick's automaton: a trie of the tokens, with links from each state to its longest suffix in the trie."""

    def __init__(self, tokens: list[str]) -> None:
        # Stretches of signs that tokens hold: no token lies across the signs between them.
        signs = "".join(map(re.escape, sorted(set().union(*tokens))))
        self.stretches = re.compile(f"[{signs}]+" if signs else r"(?!)")
        self.known: dict[str, list[str]] = {}
        self.next: list[dict[str, int]] = [{}]
        self.token: list[str | None] = [None]
        for token in tokens:
            state = 0
            for sign in token:
                following = self.next[state].get(sign)
                if following is None:
                    following = self.next[state][sign] = len(self.next)
                    self.next.append({})
                    self.token.append(None)
                state = following
            self.token[state] = token
        # Level by level: the link of a state is that of its parent, followed by its sign.
        self.link, self.ends = [0] * len(self.next), [0] * len(self.next)
        level = list(self.next[0].values())
        while level:
            below = []
            for state in level:
                # The next shorter suffix that is a token itself.
                link = self.link[state]
                self.ends[state] = link if self.token[link] is not None else self.ends[link]
                for sign, following in self.next[state].items():
                    while link and sign not in self.next[link]:
                        link = self.link[link]
                    self.link[following] = self.next[link].get(sign, 0)
                    link = self.link[state]
                    below.append(following)
            level = below

    def held(self, text: str) -> list[str]:
        """The tokens in a text, in the order in which their first occurrences end; of those that end at one place the longest first.

        Repeated stretches are walked once, and short ones also once for many texts.
        """
        out: dict[str, None] = {}
        for stretch in dict.fromkeys(self.stretches.findall(text)):
            found = self.known.get(stretch)
            if found is None:
                found = self.walked(stretch)
                if len(stretch) <= KEPT_SIGNS:
                    if len(self.known) >= KEPT_STRETCHES:
                        self.known.clear()
                    self.known[stretch] = found
            out.update(dict.fromkeys(found))
        return list(out)

    def walked(self, text: str) -> list[str]:
        """The same, sign by sign."""
        following, link, token, ends = self.next, self.link, self.token, self.ends
        seen: set[int] = set()
        out, state = [], 0
        for sign in text:
            while state and sign not in following[state]:
                state = link[state]
            state = following[state].get(sign, 0)
            at = state if token[state] is not None else ends[state]
            # Shorter tokens of a state seen before have been seen, too.
            while at and at not in seen:
                seen.add(at)
                out.append(token[at])
                at = ends[at]
        return out


# The last automaton of this worker, with the tokens it was built of: tasks that follow use it again.
_BUILT: list[tuple[list[str], Automaton]] = []


def _automaton(tokens: list[str]) -> Automaton:
    if not _BUILT or _BUILT[0][0] != tokens:
        _BUILT.clear()
        _BUILT.append((tokens, Automaton(tokens)))
    return _BUILT[0][1]


def _finder(tokens: Broadcast, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(tokens.value)
        for batch in batches:
            at, out = [], []
            for i, value in enumerate(batch.column(len(names)).to_pylist()):
                held = automaton.held(value)
                out += held
                at += [i] * len(held)
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(rows) for k in range(len(names))), pa.array(out, pa.string())], names=[*names, "token"])

    return find


def held_tokens(texts: DataFrame, tokens: DataFrame, keys: Sequence[str], text: str = "html", token: str = "token", part_bytes: int = PART_BYTES) -> DataFrame:
    """``keys, token``: each token of the table that a text holds, once, whatever stands around or inside it.

    A token within another counts by itself; repeated tokens are one; an empty token is held by every text; null tokens
    and texts have no part. A text is read once, and once more for each further ``part_bytes`` of tokens.
    """
    different = tokens.select(F.col(token).cast("string").alias("token")).where("token IS NOT NULL").distinct()
    # The table of tokens may be dear to make.
    different.persist()
    n_bytes, has_empty = different.agg(F.sum(F.octet_length("token")), F.max(F.col("token") == "")).first()
    parts = -(-(n_bytes or 0) // part_bytes)
    rows = texts.where(F.col(text).isNotNull())
    schema = T.StructType([*(texts.schema[k] for k in keys), T.StructField("token", T.StringType())])
    found = [rows.select(*keys, F.lit("").alias("token"))] if has_empty else []
    for part in range(parts):
        some = different.where((F.col("token") != "") & (F.pmod(F.xxhash64("token"), F.lit(parts)) == part))
        # At most about ``part_bytes`` of tokens.
        sent = texts.sparkSession.sparkContext.broadcast(sorted(r["token"] for r in some.collect()))
        found.append(rows.select(*keys, F.col(text).cast("string").alias("_text")).mapInArrow(_finder(sent, list(keys)), schema))
    different.unpersist()
    return reduce(DataFrame.unionByName, found) if found else texts.sparkSession.createDataFrame([], schema)
