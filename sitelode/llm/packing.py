"""Documents packed into token sequences: first-fit decreasing over a tournament tree, in randomised groups.

Cases: a null or empty text is the end token alone; repeated rows are documents of their own; an empty table gives no
piece; a text of any length is cut into full sequences and one rest; columns other than the two named are not read, so
their names can't clash.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelode.llm.common import blocks, checkpointed, mixed, table

SIZE = 4096
END = 2
GROUP_PIECES = 2048
# Token ids of short words are kept in a worker, up to this many words (some 200 bytes each).
KEPT_WORDS = 700_000
KEPT_BYTES = 48
# Neither letters, digits nor white space, and not the apostrophe, which the vocabulary's pattern treats apart.
# Letters below this are lower-cased to letters and change with no mark behind them, but for one.
LATIN_END, DOTTED = "\u0250", "\u0130"
MARKS = r""".,;:!?%&$#*|()[]{}-_=+/\"<>@^~`"""


class WordTokens:
    """Token ids of texts, word by word: no token of this vocabulary spans white space, so a word's ids are fixed.

    A word of Latin letters and then marks is encoded as the letters and the marks: the pattern parts them anyway. Many
    words of letters are encoded as one text; the last token of each carries the vocabulary's end of word. Other scripts
    and the dotted capital I, which lower-cases to a letter and a mark, are left to the tokenizer with what follows them.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}
        self.plain: dict[str, bytes] = {}

    def encoded(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn_plain(self, fresh: list[str]) -> None:
        """Words of letters only."""
        for k in range(0, len(fresh), 200):
            some = fresh[k : k + 200]
            (raw,) = self.encoded([" ".join(some)])
            ends = 4 * (np.flatnonzero(self.last[np.frombuffer(raw, "<u4")]) + 1)
            if len(ends) == len(some):
                self.plain.update((w, raw[a:b]) for w, a, b in zip(some, [0, *ends.tolist()], ends.tolist(), strict=False))
            else:
                self.plain.update(zip(some, self.encoded(some), strict=True))

    def learn(self, fresh: list[bytes]) -> dict[bytes, bytes]:
        whole, parted = [], []
        for raw in fresh:
            word = raw.decode("utf-8", "replace")
            letters = word.rstrip(MARKS)
            if letters.isalpha() and max(letters) < LATIN_END and DOTTED not in letters:
                parted.append((raw, letters.lower() if letters.isascii() else letters, word[len(letters) :]))
            else:
                whole.append((raw, word))
        out = dict(zip((raw for raw, _ in whole), self.encoded([word for _, word in whole]), strict=True))
        tails = list({tail for _, _, tail in parted})
        of_tail = dict(zip(tails, self.encoded(tails), strict=True))
        if len(self.plain) > KEPT_WORDS:
            self.plain.clear()
        self.learn_plain(list({letters for _, letters, _ in parted}.difference(self.plain)))
        out.update((raw, self.plain[letters] + of_tail[tail]) for raw, letters, tail in parted)
        return out

    def ids(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit numbers."""
        split = [text.split() for text in texts]
        fresh = set().union(*split).difference(self.known)
        if len(self.known) + len(fresh) > KEPT_WORDS:
            self.known.clear()
            fresh = set().union(*split)
        learnt = self.learn(list(fresh))
        self.known.update((w, x) for w, x in learnt.items() if len(w) <= KEPT_BYTES)
        long = {w: x for w, x in learnt.items() if len(w) > KEPT_BYTES}
        get = (lambda w: self.known.get(w) or long.get(w, b"")) if long else self.known.__getitem__
        for text in split:
            yield b"".join(map(get, text))


# The coder of this worker: the words it knows serve the tasks that follow.
_CODERS: dict[str, WordTokens] = {}


def worker_coder(path: str) -> WordTokens:
    if path not in _CODERS:
        _CODERS.clear()
        _CODERS[path] = WordTokens(path)
    return _CODERS[path]


def token_pieces(documents: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", size: int = SIZE, end: int = END) -> DataFrame:
    """Each document's tokens and the end token, cut at multiples of ``size``; ``lot`` is a random number of the piece.

    ``lot`` is drawn from the piece's place in its task, so that repeated rows get different ones.
    """
    rows = documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    schema = T.StructType(
        [T.StructField("doc_id", rows.schema["doc_id"].dataType)]
        + [T.StructField(name, T.LongType()) for name in ("start", "length", "ids_crc32", "doc_tokens", "lot")]
    )
    last = np.asarray([end], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, task, seen = worker_coder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for row, data, bounds in blocks(batch.column(1)):
                raw = data.tobytes()
                at, numbers = [], []
                for i, ids in enumerate(coder.ids([raw[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)])):
                    ids += last
                    total = len(ids) // 4
                    for start in range(0, total, size):
                        length = min(size, total - start)
                        at.append(row + i)
                        numbers.append((start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), total))
                columns = np.asarray(numbers, np.int64).reshape(-1, 4).T
                lot = mixed(np.arange(seen, seen + len(at), dtype=np.uint64) + (np.uint64(task) << np.uint64(40)))
                seen += len(at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c) for c in columns), pa.array((lot >> np.uint64(1)).astype(np.int64))],
                    names=schema.names,
                )

    return rows.mapInArrow(cut, schema)


def first_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset there of each length; the lengths are in falling order.

    The leaves of the tree are what is left in each bin, every node the greatest below it: the first bin with room is
    found from the root down.
    """
    n = len(lengths)
    leaves = 1 << max(0, n - 1).bit_length()
    tree = [size] * (2 * leaves)
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    for i, length in enumerate(lengths.tolist()):
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] < length:
                node += 1
        left = tree[node]
        bins[i], offsets[i] = node - leaves, size - left
        tree[node] = left - length
        while node > 1:
            node //= 2
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
    return bins, offsets


def pack(pieces: DataFrame, size: int = SIZE, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Each piece with its sequence and its offset there; groups of about ``group_pieces`` random pieces are packed alone.

    ``sequence_tokens`` is what the sequence holds, ``padded_tokens`` its length with padding: ``size``, or no padding
    where it holds a power of two.
    """
    pieces = checkpointed(pieces)
    groups = max(1, round(pieces.count() / group_pieces))
    kept = [c for c in pieces.columns if c != "lot"]
    added = [T.StructField(c, T.LongType()) for c in ("sequence_id", "offset", "sequence_tokens", "padded_tokens")]
    schema = T.StructType([pieces.schema[c] for c in kept] + added)

    def packed(group: pa.Table) -> pa.Table:
        number = group.column("group")[0].as_py()
        length = group.column("length").to_numpy()
        order = np.lexsort((group.column("lot").to_numpy(), -length))
        bins, offsets = first_fit_decreasing(length[order], size)
        held = np.bincount(bins, length[order]).astype(np.int64)
        padded = np.where((held & (held - 1)) == 0, held, size)
        columns = [np.int64(number << 32) + bins, offsets, held[bins], padded[bins]]
        out = group.select(kept).take(pa.array(order))
        return pa.table([*out.columns, *(pa.array(c) for c in columns)], names=schema.names)

    dealt = pieces.withColumn("group", F.col("lot") % groups)
    return dealt.groupBy("group").applyInArrow(packed, schema)


def pack_documents(documents: DataFrame, path: str) -> DataFrame:
    return pack(token_pieces(documents, path))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents"), tokenizer_path())


QUERIES = {"op2_packing": op2_packing}
SQL: dict[str, str] = {}
