"""Secrets in texts: three fixed patterns, and values after credential words that would take many guesses.

A value's guess cost is the least, over all ways to cut it into known words, dates, repeats, sequences, keyboard walks
and brute force, of the product of the parts' guesses: dynamic programming over cut points. Values that cost at least
``BITS`` are secrets, besides what the patterns find. That holds for values of letters only, too: common words cost
little, while a rare or foreign word of eight letters or more, or a passage without blanks, counts as a secret there.

Cases: a null text counts as empty and has no span; a value of any length is priced whole, in linear time, as blocks
that are repeated have at most ``BLOCK`` characters; repeated rows get equal rows, an empty table gives no row; columns
other than the one named are not read.
"""

from __future__ import annotations

import re
from math import log2

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelode.llm.common import table

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
# Credential words beyond those of the assign pattern, and how a value may follow one.
CONTEXT = re.compile(
    r"""(?i:(?<![A-Za-z])(?:password|passwd|passphrase|passcode|pwd|pass|secret|token|credentials?|auth|bearer|private_?key|access_?key|client_?secret|api_?key|pin))"""
    r"""(?:["']?[\x20\t]*(?:[:=]|=>|->)[\x20\t]*|\x20+(?i:is)\x20+|(?i:(?<=bearer))[\x20\t]+)["']?([^\s"'<>,;|]{6,})""",
    re.ASCII,
)
# What it takes, in bits, for a value to be a secret.
BITS = 34.0
# A repeated block has so many characters at most.
BLOCK = 32
# Words that people build passwords of, commonest first; a guesser tries them in this order.
WORDS = (
    "password admin login welcome user test guest root master secret token example dragon monkey letmein shadow sunshine princess football baseball "
    "hello love summer winter spring autumn january february march april june july august september october november december monday tuesday friday "
    "your here none null true false default change changeme placeholder sample value string text key name company server home "
    # Words of common prose, which may follow a credential word, too.
    "required optional invalid incorrect correct wrong missing empty expired valid unknown unset undefined hidden visible stored saved encrypted "
    "decrypted hashed salted protected disabled enabled generated provided supplied needed accepted rejected denied allowed forbidden public "
    "private secure insecure strong weak short long random unique temporary temporarily permanent permanently personal shared sensitive confidential known forgotten "
    "changed updated reset revoked rotated removed deleted created issued used unused reused exposed leaked stolen compromised validated verified "
    "checked tested authentication authenticated authenticate authorization authorized authorize unauthorized credential credentials certificate "
    "certificates account accounts administrator username identity session sessions service services servers client clients application "
    "applications browser device devices computer network website domain email address addresses number numbers letter letters character "
    "characters digit digits symbol symbols phrase sentence paragraph section chapter document documents documentation information content "
    "message messages database table tables record records field fields column columns header headers footer request requests response responses "
    "parameter parameters argument arguments variable variables function functions method methods object objects class classes module modules "
    "package packages library libraries program programs system systems software hardware machine environment production development staging "
    "testing configuration configure configured setting settings option options property properties attribute attributes element elements format "
    "length size type types input output result results error errors warning warnings failure success successful successfully status state active "
    "inactive available unavailable supported unsupported implemented deprecated obsolete current previous following different another other "
    "others something anything everything nothing someone anyone everyone nobody always never sometimes usually often already still again before "
    "after during between against without within through because therefore however although whether either neither several many more most less "
    "least some every each these those that this there where which while what when whose they their them then than have having been being would "
    "could should might must shall will also only even just very much such same both into onto from with about above below under over upon until "
    "since though please remember enter choose select typed click press submit confirm continue cancel return follow include includes included "
    "contain contains contained exclude excluded replace replaced remove changes update create delete insert store save load read write send "
    "receive received sent show shown display displayed hide print copy paste open close closed start started stop stopped begin finish finished "
    "complete completed incomplete pending waiting ready possible impossible necessary unnecessary important recommended suggested preferred "
    "expected unexpected specified unspecified defined described mentioned explained discussed considered assumed called named given taken made "
    "done found lost kept left held told said asked answered written spoken heard seen looked watched thought believed understood learned taught "
    "tried failed passed broken fixed solved simple simply easy easily difficult hard complex complicated general generally special specific "
    "specifically particular particularly certain certainly probably perhaps maybe actually really exactly nearly almost enough entirely "
    "completely totally partially automatically manually regularly frequently immediately eventually finally originally previously currently "
    "recently typically normally commonly good better best great small large larger largest little high higher highest lower lowest first second "
    "third last next early late later latest today tomorrow yesterday week weeks month months year years hour hours minute minutes seconds time "
    "times date dates moment morning evening night person people member members owner owners manager employee employees customer customers "
    "companies organization department government country countries city cities world school university student students teacher teachers family "
    "friend friends father mother brother sister child children water fire earth light dark black white green blue yellow orange purple brown "
    "house garden street window door kitchen chair music book books story stories history science language languages english spanish french "
    "german article articles page pages paper papers picture pictures plain plaintext base encoded decoded encoding strings integer boolean float "
    "array list dictionary tuple literal constant pointer examples samples dummy redacted masked omitted everywhere anywhere nowhere somewhere "
    "horse battery staple cookie cookies cloud access control security policy policies permission permissions privilege privileges role roles "
    "group groups"
).split()
RANK = {word: i + 1 for i, word in enumerate(WORDS)}
LONGEST = max(map(len, WORDS))
ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("013457@$!", "oleastasi")
DATE = re.compile(r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d|(?:19|20)\d\d")
# Whenever one part ends and another begins, a guesser has to try that as well.
CUT = 1.0


def neighbours() -> set[tuple[str, str]]:
    """Keys next to each other: in a row, or above and below."""
    out = set()
    for y, row in enumerate(ROWS):
        for x, key in enumerate(row):
            near = [row[x + 1 : x + 2]] + [ROWS[y + 1][z : z + 1] for z in (x - 1, x) if y + 1 < len(ROWS) and z >= 0]
            out |= {pair for other in near if other for pair in ((key, other), (other, key))}
    return out


NEAR = neighbours()


def alphabet(value: str) -> int:
    """How many characters a brute-force guesser would try for each place."""
    sizes = ((10, str.isdigit), (26, str.islower), (26, str.isupper))
    return max(10, sum(size for size, test in sizes if any(map(test, value))) + (33 if any(not c.isalnum() for c in value) else 0))


def patterned(value: str) -> dict[int, list[tuple[int, float]]]:
    """By end: parts (start, bits) that are a word, a date, a repeat, a sequence or a keyboard walk."""
    found: dict[int, list[tuple[int, float]]] = {}

    def add(start: int, end: int, guesses: float) -> None:
        found.setdefault(end, []).append((start, log2(guesses)))

    lower, n = value.lower(), len(value)
    plain = lower.translate(LEET)
    for start in range(n):
        for end in range(start + 3, min(n, start + LONGEST) + 1):
            rank = RANK.get(lower[start:end]) or 4 * RANK.get(plain[start:end], 0)
            if rank:
                part = value[start:end]
                # Three ways of capitals are tried: none, the first, all.
                cased = 1 if part.islower() else 2 if part[1:].islower() or part.isupper() else 2 ** len(part)
                add(start, end, 2.0 * rank * cased)
    for match in DATE.finditer(value):
        add(*match.span(), 365.0 * 130 if len(match[0]) > 4 else 130.0)
    # Runs in which each character follows from the one before by one rule.
    for rule, guesses in (
        (lambda a, b: a == b, 12.0),
        (lambda a, b: ord(b) - ord(a) == 1 and a.isalnum(), 26.0),
        (lambda a, b: ord(a) - ord(b) == 1 and a.isalnum(), 52.0),
        (lambda a, b: (a.lower(), b.lower()) in NEAR, 0.0),
    ):
        start = 0
        for i in range(1, n + 1):
            if i == n or not rule(value[i - 1], value[i]):
                for end in range(start + 3, i + 1):
                    # A walk turns anywhere: each further key is one of about four neighbours at every other step.
                    add(start, end, guesses * (end - start) if guesses else 47.0 * 2.0 ** (end - start - 1))
                start = i
    # A block said again, any number of times: "abcabcabc".
    for size in range(2, min(BLOCK, n // 2) + 1):
        same = 0
        for i in range(size, n):
            same = same + 1 if value[i] == value[i - size] else 0
            if times := same // size:
                add(i + 1 - times * size, i + 1, 4.0 * times)
    return found


def guess_bits(value: str) -> float:
    """The least bits of guesses for a value."""
    per_place, parts = log2(alphabet(value)), patterned(value)
    # least[i]: the first i characters; a brute-force stretch goes on at no cut.
    least, brute = [0.0], [CUT]
    for end in range(1, len(value) + 1):
        best = brute[end - 1] + per_place
        open_brute = best
        for start, bits in parts.get(end, ()):
            best = min(best, least[start] + bits + CUT)
        least.append(best)
        brute.append(min(open_brute, best + CUT))
    return least[-1]


def spans(text: str) -> list[tuple[int, str, int]]:
    """Start, kind and end (code points) of all secrets: by start, then kind in the order of ``KINDS``."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    m = CONTEXT.search(text)
    while m:
        value = m[1].rstrip(".)]}:!?")
        secret = len(value) >= 6 and guess_bits(value) >= BITS
        if secret:
            found.append((m.start(1), 3, m.start(1) + len(value)))
        # A value that is none may be a credential word itself ("auth: Bearer ..."); only short ones cost so little.
        m = CONTEXT.search(text, m.end() if secret else m.start(1))
    return [(start, KINDS[kind], end) for start, kind, end in sorted(found)]


def secrets(text: Column) -> Column:
    """An array of ``start, kind, end`` for each text."""

    def run(column: pa.Array) -> pa.Array:
        found = [[{"start": s, "kind": k, "end": e} for s, k, e in spans(column[i].as_py() or "")] for i in range(len(column))]
        return pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())])))

    return F.arrow_udf(run, "array<struct<start:bigint,kind:string,end:bigint>>")(text.cast("string"))


def masked(text: Column) -> Column:
    """The text with ``[kind]`` in place of each secret; overlapping ones are one, named by the first."""

    def run(column: pa.Array) -> pa.Array:
        out = []
        for i in range(len(column)):
            value = column[i].as_py()
            found = spans(value or "")
            if found:
                pieces, last = [], 0
                for start, kind, end in found:
                    if start >= last:
                        pieces += [value[last:start], f"[{kind}]"]
                    last = max(last, end)
                value = "".join([*pieces, value[last:]])
            out.append(value)
        return pa.array(out, pa.string())

    return F.arrow_udf(run, "string")(text.cast("string"))


def op5_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = table(spark, folder, "documents").select("doc_id", secrets(F.col("text")).alias("found"))

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def listed(some: Column) -> Column:
        return F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("found", lambda s: s["kind"] != KINDS[3])
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"), count("guess"))


QUERIES = {"op5_secrets": op5_secrets}
SQL: dict[str, str] = {}
