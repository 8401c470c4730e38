"""Every numbered query against its plain version, over a given table, odd rows and no rows."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import plain
import pyarrow as pa
import pytest
from conftest import DATA

from sitelode.llm.queries import QUERIES, SQL


@pytest.fixture(scope="module", params=["given", "odd", "empty"])
def folder(request, tmp_path_factory):
    if request.param == "given":
        return DATA
    return plain.odd_tables(tmp_path_factory.mktemp(request.param), empty=request.param == "empty")


def result(spark, folder, name, columns=None):
    found = next(q for n, q in QUERIES.items() if n.startswith(name + "_"))(spark, folder)
    return Counter(tuple(r) for r in (found.select(*columns.split()) if columns else found).collect())


def test_warc(spark, folder):
    got = result(spark, folder, "op1", "page_id payload_bytes payload_digest record_type refers_to")
    assert got == Counter(plain.archived(plain.rows(folder, "pages")))


def test_archives_of_others(spark, tmp_path):
    """Name servers' records, missing and odd headers, line feeds alone, damaged lines, two archives in one file, a record cut off."""
    import gzip

    from sitelode.llm.warc import converted, read_warc

    long = b"<p>" + b"x" * 1200
    blocks = [
        ("dns:example.org", "text/dns", b"20240101000000\nexample.org. 300 IN A 10.0.0.1\n"),
        ("http://a/ b", "text/html", b"HTTP/1.0 200 OK\r\nServer:nginx\r\nno colon\r\n\r\n" + long),
        ("http://b/", "text/html", b"HTTP/1.1 200 OK\nContent-Length: 9\nX-Page-Id:7\n\n" + long),
        ("http://c/", "text/html", long),
        ("http://d/", "text/html", b"HTTP/1.1 204 No Content\r\n"),
        ("ftp://e/f", "application/zip", b"PK\x03\x04\r\n\r\nHTTP/1.1\n"),
        ("http://f/", "text/html", b""),
    ]
    one = b"filedesc://x.arc 0.0.0.0 19961104 text/plain 73\n1 0 Other\nURL IP-address Archive-date Content-type Archive-length\nmore"
    one = one.replace(b" 73\n", b" %d\n" % len(one.split(b"\n", 1)[1])) + b"\n"
    dates = ["20240102030405", "19961104", "0", "199611", "20240102030405", "20240102030405", "20240102030405"]
    old = one + b"".join(f"{u} 0.0.0.0 {d} {k} {len(c)}\n".encode() + c + b"\n" for (u, k, c), d in zip(blocks, dates, strict=True))
    two = b"1 0 Other\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"
    two = b"filedesc://y.arc 0.0.0.0 20240101000000 text/plain %d\n" % len(two) + two + b"\nthis is no header\n"
    cut = two + f"http://g/ 0.0.0.0 20240101000000 text/html 200 - - 0 y.arc {len(long)}\n".encode() + long + b"\nhttp://h/ 0.0.0.0 20240101000000 text/html 200 - - 9 y.arc 5000\nHTTP/1.1 200 OK\r\n\r\n" + long
    arcs = tmp_path / "arcs"
    arcs.mkdir()
    (arcs / "part-0.gz").write_bytes(gzip.compress(old) + gzip.compress(cut))
    got = read_warc(spark, converted(spark, str(arcs), str(tmp_path / "warcs"))).collect()
    by_uri = {r.target_uri: r for r in got}
    assert len(got) == 9 and {u: r.record_type for u, r in by_uri.items()} == {
        "dns:example.org": "resource", "http://a/ b": "revisit", "http://b/": "response", "http://c/": "resource", "http://d/": "response",
        "ftp://e/f": "resource", "http://f/": "resource", "http://g/": "resource", "http://h/": "response",
    }
    assert by_uri["http://a/ b"].refers_to == 7 and by_uri["http://a/ b"].refers_to_id == by_uri["http://b/"].record_id
    assert [by_uri[u].payload_bytes for u in ("dns:example.org", "http://a/ b", "http://b/", "http://d/", "ftp://e/f", "http://f/")] == [len(blocks[0][2]), 1203, 1203, 0, len(blocks[5][2]), 0]
    assert [by_uri[u].warc_date for u in ("dns:example.org", "http://a/ b", "http://b/", "http://c/")] == ["2024-01-02T03:04:05Z", "1996-11-04T00:00:00Z", "1970-01-01T00:00:00Z", "1996-11-01T00:00:00Z"]
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "warcs").glob("part-*"))
    assert raw.count(b"WARC-Truncated: unspecified") == 1 and b"Content-Type: text/dns" in raw


def test_archives_are_converted_in_groups_and_not_shuffled(spark, tmp_path, monkeypatch):
    from sitelode.llm import warc

    monkeypatch.setattr(warc, "REVISITS", 2)
    monkeypatch.setattr(warc, "WAVE", 2)
    pages = spark.range(60).selectExpr("id AS page_id", "'u' AS url", "repeat(cast(id % 5 AS string), 2000) AS html").repartition(12)
    seen = []
    monkeypatch.setattr(warc, "written", lambda records, folder, end, real=warc.written: (seen.append(records._jdf.queryExecution().optimizedPlan().toString()), real(records, folder, end))[1])
    arcs = warc.arc_archives(pages, str(tmp_path / "a"))
    found = warc.read_warc(spark, warc.converted(spark, arcs, str(tmp_path / "w"))).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in found) == sorted((i, *(("response", None) if i >= 55 else ("revisit", 55 + i % 5))) for i in range(60))
    assert len(seen) > 5 and all("strategy=broadcast" in plan for plan in seen[1:])
    # Version 2 names the offset of each record.
    content = [c for f in sorted((tmp_path / "a").glob("part-*")) if (c := __import__("gzip").decompress(f.read_bytes())).split(b"\n")[1].startswith(b"2 ")]
    assert content
    for raw in content:
        for at in [i for i in range(len(raw)) if raw.startswith(b"\nu 0.0.0.0", i)]:
            assert int(raw[at + 1 :].split(b"\n", 1)[0].split(b" ")[7]) == at + 1


def test_packing(spark, folder):
    from tokenizers import Tokenizer

    from sitelode.llm.packing import tokenizer_path

    tokenizer = Tokenizer.from_file(tokenizer_path())
    documents = plain.rows(folder, "documents")
    want = Counter()
    for d in documents:
        ids = np.array([*tokenizer.encode(d["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        want.update((d["doc_id"], a, min(4096, len(ids) - a), zlib.crc32(ids[a : a + 4096].tobytes()), len(ids)) for a in range(0, len(ids), 4096))
    pieces = list(result(spark, folder, "op2", "doc_id start length ids_crc32 doc_tokens sequence_id offset sequence_tokens padded_tokens").elements())
    assert Counter(p[:5] for p in pieces) == want
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p[5]].append(p)
    waste = 0
    for held in sequences.values():
        at = 0
        for p in sorted(held, key=lambda p: p[6]):
            assert p[6] == at
            at += p[2]
        assert at == held[0][7] <= 4096
        waste += held[0][8] - at
    # First-fit decreasing leaves at most one sequence of a group half empty.
    assert sum(h[0][7] <= 2048 for h in sequences.values()) <= 1
    assert waste <= 4096 + 0.1 * sum(p[2] for p in pieces)


def token_texts(n, seed):
    """Words of letters that change with case, marks, digits, scripts and spellings of special tokens, in odd order."""
    rng = np.random.default_rng(seed)
    parts = ["TATİLİ", "İ", "i̇", "ſ", "ß", "ẞ", "ǅ", "ŉ", "É", "e\u0301", "ñ", "Σ", "क़", "가", "각", "日本", "ｶﾞ", "ﬁ", "Å", "don't", "we'LL", "'S", "x1y2", "١٢", "½", "<|endoftext|>", "<|", "|>", "\u00a0", "\u2028", "\x1c", "\ufffd", "🙂"]
    parts += list(".,;:!?%&$#*|()[]{}-_=+/<>@^~`\"'") + ["abc", "Word", "THE", "zzz"] + [" ", "\n", "\t"] * 4
    return ["".join(rng.choice(parts, rng.integers(1, 14))) for _ in range(n)]


def test_word_tokens_equal_the_tokenizer():
    from tokenizers import Tokenizer

    from sitelode.llm.packing import WordTokens, tokenizer_path

    tokenizer, coder = Tokenizer.from_file(tokenizer_path()), WordTokens(tokenizer_path())
    texts = ["TATİLİ.", "İ,", "İstanbul'da", *token_texts(10_000, 12)]
    for text, ids in zip(texts, coder.ids([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_topk(spark, folder):
    assert result(spark, folder, "op3") == Counter(plain.top(plain.rows(folder, "embeddings")))


@pytest.mark.parametrize("size", [2e7, 3e9, 1e15, 3.4e38])
def test_topk_of_large_components(spark, size):
    from sitelode.llm.topk import top_products

    rng = np.random.default_rng(13)
    rows = [(i, [float(np.float32(x)) for x in rng.choice([-1, 1, 0.5, 1e-7, 1 / 3], 6) * rng.choice([size, 1.0, size / 7])]) for i in range(120)]
    found = top_products(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 10, 7)
    want = plain.top([{"vec_id": i, "embedding": v} for i, v in rows], 10, 7)
    assert Counter(tuple(r) for r in found.collect()) == Counter(want)


def test_substrings(spark, folder):
    assert result(spark, folder, "op4") == Counter(plain.repeats(plain.rows(folder, "documents")))


def test_substrings_of_crowded_anchors(spark, tmp_path):
    from sitelode.llm.substrings import cut_repeats

    folder = plain.odd_tables(tmp_path)
    found = cut_repeats(spark.read.parquet(f"{folder}/documents.parquet"), window=9, crowded=1).drop("spans")
    assert Counter(tuple(r) for r in found.collect()) == Counter(plain.repeats(plain.rows(folder, "documents"), 9))


def test_secrets(spark, folder):
    assert result(spark, folder, "op5", "doc_id n_assign n_access n_hex base_sha256") == Counter(plain.fixed_secrets(plain.rows(folder, "documents")))


def test_guesses():
    from sitelode.llm.secrets import BITS, guess_bits, spans

    weak = ["password123", "qwertyuiop", "2019-05-12", "aaaaaaaaaaaa", "letmein2020", "abcdefgh1234", "P4ssw0rd1"]
    assert all(guess_bits(w) < BITS for w in weak)
    assert all(guess_bits(s) >= BITS for s in ("xK9#mQ2$vL5p", "ae93e1051f", "wJalrXUtnFEMI/K7MDENG" * 10))
    # A word costs no more than its letters by brute force, a repeat no more than saying it anew.
    assert guess_bits("dragon") < guess_bits("nogadr")
    assert guess_bits("xk9mxk9m") < guess_bits("xk9mq2vl")
    text = "é pwd = xK9mQ2vL5pR8, the token is qwerty12 and pass: 20190512"
    assert [(k, text[a:b]) for a, k, b in spans(text)] == [("guess", "xK9mQ2vL5pR8")]


def test_guess_costs_are_the_least():
    """Against all ways to cut short values into parts; the price of a part doesn't depend on where it stands."""
    from math import log2

    from sitelode.llm.secrets import CUT, alphabet, guess_bits, patterned

    rng = np.random.default_rng(15)
    pieces = ["password", "2019-05-12", "abcd", "qwert", "aaaa", "x9", "K", "#7f", "abab", "dragon", "zq"]
    for _ in range(300):
        value = "".join(rng.choice(pieces, rng.integers(1, 4)))[: int(rng.integers(1, 15))]
        parts, place = patterned(value), log2(alphabet(value))
        known = {(start, end): min(b for s, b in parts[end] if s == start) for end in parts for start in {s for s, _ in parts[end]}}
        best = np.inf
        for mask in range(1 << (len(value) - 1)):
            cuts = [0, *(i + 1 for i in range(len(value) - 1) if mask >> i & 1), len(value)]
            best = min(best, sum(min(known.get((a, b), np.inf), place * (b - a)) + CUT for a, b in zip(cuts, cuts[1:], strict=False)))
        assert abs(guess_bits(value) - best) < 1e-9, value


def test_long_values_are_priced_whole():
    from sitelode.llm.secrets import BITS, guess_bits

    word, noise = "password", "xK9#mQ2$vL5pT7&w"
    assert guess_bits("z" * 60 + word + "z" * 60) < guess_bits("z" * 60 + noise[:8] + "z" * 60)
    # The same wherever the part stands, also across the sixty-fourth character.
    prices = {round(guess_bits("z" * n + "!" + word + "!" + "z" * (200 - n)), 2) for n in (54, 57, 60, 63, 70)}
    assert max(prices) - min(prices) < 1
    assert guess_bits("ab" * 500) < BITS < guess_bits(noise * 2000)
    assert guess_bits("abcdefghij" * 3000) < guess_bits("abcdefghij" + noise)


@pytest.mark.parametrize("before", ["pwd=", "passphrase: ", "private_key=", "access_key => ", "auth: ", "The passcode is ", "Authorization: Bearer ", "auth: Bearer ", "bearer token: ", "pass: token="])
@pytest.mark.parametrize("value", ["XkqZvBnmRtLpWqHd", "qzjvkxwbfhgtmrnplcsdqzjxvkwbhfgtmrnplcsd", "xK9mQ2vL5pR8"])
def test_letters_and_bearers_are_scored(before, value):
    from sitelode.llm.secrets import spans

    text = f"é {before}{value}, and more"
    # A value may have the credential word before it in it ("pass: token=...").
    assert any(k == "guess" and text[a:b].endswith(value) for a, k, b in spans(text))


def test_prose_is_no_secret():
    from sitelode.llm.secrets import spans

    for word in "required incorrect authentication everything certificates temporarily unauthorized credentials dragonmonkey".split():
        assert not spans(f"The passphrase is {word}. auth: {word}, bearer {word}")


def test_secrets_are_masked(spark):
    from pyspark.sql import functions as F

    from sitelode.llm.secrets import masked

    found = spark.createDataFrame([(plain.SECRET,), (None,), ("clean",)], "text string").select(masked(F.col("text"))).collect()
    assert found[1][0] is None and found[2][0] == "clean"
    assert "hunter2" not in found[0][0] and "0123456789" not in found[0][0] and "xK9m" not in found[0][0] and "é" in found[0][0]


def test_decontamination(spark, folder):
    assert result(spark, folder, "op6") == Counter(plain.leaks(plain.rows(folder, "documents"), plain.rows(folder, "benchmark")))


def test_decontamination_in_parts(spark, tmp_path, monkeypatch):
    from sitelode.llm import decontamination

    monkeypatch.setattr(decontamination, "PART_BYTES", 100)
    folder = plain.odd_tables(tmp_path)
    assert result(spark, folder, "op6") == Counter(plain.leaks(plain.rows(folder, "documents"), plain.rows(folder, "benchmark")))


@pytest.mark.parametrize("shard", [1, 7, 50])
def test_decontamination_of_small_shards(spark, tmp_path, monkeypatch, shard):
    """Windows across the ends of pieces, and adjacent hits of two pieces, which are one span."""
    from sitelode.llm import decontamination

    monkeypatch.setattr(decontamination, "SHARD", shard)
    folder = plain.odd_tables(tmp_path)
    assert result(spark, folder, "op6") == Counter(plain.leaks(plain.rows(folder, "documents"), plain.rows(folder, "benchmark")))
    words = [f"b{i}" for i in range(40)]
    phrases = decontamination.Phrases(["x", "y"], [" ".join(words[:25]), " ".join(words[25:])], 10)
    texts = pa.array(["Zz " + "  ".join(words) + ". zz", None, "", " ".join(words[:9]), " ".join(words[20:30])])
    n_words, hits, items, spans = decontamination.search_shard(texts, [phrases])
    assert n_words.tolist() == [42, 0, 0, 9, 10] and hits == [40, 0, 0, 0, 0] and items[0] == {"x", "y"}
    assert spans[0] == [(3, 3 + len("  ".join(words)))] and not any(spans[1:])


def test_an_index_is_of_bounded_size():
    """A text of benchmark words only, far longer than an index may be."""
    import tracemalloc

    from sitelode.llm import decontamination

    rng = np.random.default_rng(14)
    words = [f"w{i}" for i in range(300)]
    phrases = decontamination.Phrases(["x"], [" ".join(rng.choice(words, 3000))], 10)
    texts = pa.array([" ".join(rng.choice(words, 1_200_000))])
    tracemalloc.start()
    decontamination.search_shard(texts, [phrases])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400 << 20


def test_passages_are_cut(spark, tmp_path):
    from sitelode.llm.decontamination import decontaminated

    folder = plain.odd_tables(tmp_path)
    found = decontaminated(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet"))
    cut = [{"doc_id": r["doc_id"], "text": r["text"]} for r in found.collect()]
    assert [r["text"] for r in cut if r["text"] and r["text"].startswith("before")] == ["before "]
    assert None in [r["text"] for r in cut]


@pytest.mark.parametrize(("shard", "block"), [(8192, 65_536), (4, 3)])
def test_simhash(spark, folder, shard, block):
    from sitelode.llm.simhash import groups

    found = groups(spark.read.parquet(f"{folder}/documents.parquet"), shard=shard, block=block)
    got = Counter((r["doc_id"], f"{r['fp'] % 2**64:016x}", r["component_id"]) for r in found.collect())
    assert got == Counter(plain.groups(plain.rows(folder, "documents")))
    if shard == 8192:
        assert result(spark, folder, "op8") == got


def test_one_of_each(spark, folder):
    from sitelode.llm.simhash import one_of_each

    documents = spark.read.parquet(f"{folder}/documents.parquet")
    kept = one_of_each(documents)
    assert kept.columns == documents.columns
    want = plain.groups(plain.rows(folder, "documents"))
    found = [r.asDict() for r in kept.collect()]
    again = plain.groups(found)
    # One row of each group, and no two of them linked.
    assert len(found) == len({(p[2], p[1]) for p in again}) and len({p[2] for p in again}) >= len(found) - 2
    assert {p[2] for p in want} - {None} <= {r["doc_id"] for r in found}


def test_one_of_each_of_odd_columns(spark):
    """Maps, names with dots and blanks, names that the operator uses itself; repeated rows that differ elsewhere."""
    from pyspark.sql import functions as F

    from sitelode.llm.simhash import one_of_each

    rows = [(1, "a b c d e", {"x": 1}), (1, "a b c d e", {"x": 1}), (1, "a b c d e", {"x": 0}), (2, "a b c d e", {}), (3, "other words stand here now", None), (None, "a b c d e", None)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>").withColumns({"a.b": F.lit(1), "c d`e": F.lit(2), "hash": F.lit(3), "key": F.lit(4), "row": F.lit(5), "count": F.lit(6)})
    kept = one_of_each(documents)
    assert kept.columns == documents.columns
    assert sorted((r["doc_id"], r["m"], r["a.b"]) for r in kept.collect()) == [(1, {"x": 0}, 1), (3, None, 1)]
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan


@pytest.mark.parametrize(("name", "label", "cut", "parts", "held"), [("op7", "toxic", 0.7, 3, 1), ("op9", "quality", 0.5, 3, 1)])
def test_scores(spark, folder, name, label, cut, parts, held):
    got = result(spark, folder, name, "doc_id held_out score predicted")
    assert Counter(g[0] for g in got.elements()) == Counter(d["doc_id"] for d in plain.rows(folder, "documents"))
    for doc_id, held_out, score, predicted in got:
        assert held_out == (plain.fold(doc_id, parts) == held)
        assert 0 <= score <= 1 and predicted == (score >= cut)
    if folder == DATA:
        mark = {x["doc_id"]: x[label] for x in plain.rows(folder, "labels")}
        right = [p == mark[i] for i, h, _, p in got if i in mark]
        assert np.mean(right) > 0.85


@pytest.mark.parametrize(("name", "label", "accuracy", "recall"), [("op7", "toxic", 0.94, 0.7), ("op9", "quality", 0.94, 0.7)])
def test_held_out_labels(spark, name, label, accuracy, recall):
    """Rows that nothing was learned from, of both kinds: a constant passes neither."""
    larger = DATA.replace("0.001", "0.01")
    mark = {x["doc_id"]: x[label] for x in plain.rows(larger, "labels")}
    got = [(mark[i], p) for i, held_out, p in result(spark, larger, name, "doc_id held_out predicted").elements() if held_out and i in mark]
    assert len(got) > 100 and np.mean([y == p for y, p in got]) > accuracy
    assert all(np.mean([y == p for y, p in got if y == value]) > recall for value in (0, 1))


def test_langid(spark, folder):
    got = list(result(spark, folder, "op10", "doc_id held_out lang_pred score").elements())
    documents = plain.rows(folder, "documents")
    assert Counter(g[0] for g in got) == Counter(d["doc_id"] for d in documents)
    langs = {d["lang"] for d in documents if d["lang"] is not None and plain.fold(d["doc_id"], 4) != 2}
    for doc_id, held_out, lang, score in got:
        assert held_out == (plain.fold(doc_id, 4) == 2) and lang in langs | {"und"} and 0 <= score <= 1
    without = Counter(d["doc_id"] for d in documents if not any(c.isalpha() for c in d["text"] or ""))
    assert Counter(g[0] for g in got if g[2] == "und") == (without if langs else Counter(d["doc_id"] for d in documents))
    if folder == DATA:
        true = {d["doc_id"]: d["lang"] for d in documents}
        assert np.mean([g[2] == true[g[0]] for g in got if g[1]]) > 0.95


def test_trie(spark, folder):
    assert result(spark, folder, "op13") == Counter(plain.trie(plain.rebuilt(plain.rows(folder, "conversations"))))


@pytest.mark.parametrize("chunk", [1, 2, 8])
def test_trie_of_small_blocks(spark, tmp_path, monkeypatch, chunk):
    """Conversations of many blocks, every level of the recursion above them, and names that count as crowded."""
    from pyspark.sql import functions as F

    from sitelode.llm import trie

    monkeypatch.setattr(trie, "HOT_SHARE", 0.05)
    monkeypatch.setattr(trie, "PIECE_IDS", 2)
    sequences = plain.rebuilt(plain.rows(plain.odd_tables(tmp_path), "conversations"))
    turns = spark.createDataFrame([(c, i, *t) for c, turns in sequences.items() for i, t in enumerate(turns)], "c long, i long, role string, text string")
    numbered = trie.numbered(trie.symbols(turns, "c", "i", "role", "text"))
    nodes = trie.prefix_trie(numbered, spark.createDataFrame([(c,) for c in sequences], "conv long"), chunk)
    columns = ["conv", "depth", "parent_conv", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert Counter(tuple(r) for r in nodes.select(columns).collect()) == Counter(plain.trie(sequences))
    shifted = numbered.withColumn("conv", F.lit(7).cast("long")).where("place < 0")
    assert trie.prefix_trie(shifted, shifted.select("conv"), chunk).count() == 0


def test_turns_are_numbered_across_partitions(spark):
    from sitelode.llm import trie

    rows = spark.range(5000).selectExpr("CASE WHEN id < 4000 THEN 1L ELSE id % 7 END AS conv", "id AS turn", "cast('s' AS binary) AS symbol", "id AS words")
    found = trie.numbered(rows.repartition(6)).collect()
    by_conv = defaultdict(list)
    for r in sorted(found, key=lambda r: (r["conv"], r["words"])):
        by_conv[r["conv"]].append(r["place"])
    assert len(found) == 5000 and all(places == list(range(len(places))) for places in by_conv.values())


def test_periodic(spark, folder):
    assert result(spark, folder, "op12", "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256") == Counter(plain.periodic(plain.rows(folder, "documents")))


def test_runs_of_odd_sequences():
    """Small alphabets, nested periods, powers of powers, the sequence without cubes that defeats hashes modulo 2^64."""
    from sitelode.llm.periodic import found_runs

    rng = np.random.default_rng(6)
    block = "abcabcabcabcd" * 5 + "aaaa" + "ab" * 9 + "a" * 50
    texts = [list(rng.integers(0, k, n)) for k in (1, 2, 3) for n in (0, 1, 5, 6, 7, 40, 300)]
    texts += [[ord(c) for c in block * k] for k in (1, 4)] + [[bin(i).count("1") % 2 for i in range(4096)]]
    texts += [list(np.tile(rng.integers(0, 3, p), k)) + list(rng.integers(0, 3, 9)) for p in (1, 2, 5, 17, 60) for k in (3, 4, 7)]
    for some in [*([t] for t in texts), texts]:
        symbols = np.array([x for t in some for x in t], np.int64)
        text = np.repeat(np.arange(len(some)), [len(t) for t in some])
        firsts = np.cumsum([0, *map(len, some)])
        start, end, period = found_runs(symbols, text)
        got = [(int(a - firsts[text[a]]), int(b - a), int(q), int(text[a])) for a, b, q in zip(start, end, period, strict=True)]
        assert got == [(*r, i) for i, t in enumerate(some) for r in plain.runs_of([int(x) for x in t])]


def test_rules_derive_the_words():
    """Each place of a rule holds the same words, and pairs of one rule stand twice until the balanced rest."""
    from sitelode.llm.periodic import re_pair

    rng = np.random.default_rng(7)
    symbols, part = rng.integers(0, 4, 500), np.repeat([0, 1, 2], [200, 1, 299])
    rules = re_pair(symbols, part)
    for number, at in zip(rules.used, rules.at, strict=True):
        length, place = rules.length[number], rules.place[number]
        assert (symbols[at : at + length] == symbols[place : place + length]).all() and 0 < rules.left[number] < length
        assert part[at] == part[at + length - 1]
    # One symbol is left of each stretch.
    assert len(rules.used) == len(symbols) - 3


def test_personal(spark, folder):
    got = list(result(spark, folder, "op11", "doc_id n_email n_ip n_card n_phone base_sha256 spans n_added").elements())
    documents = plain.rows(folder, "documents")
    assert Counter(g[:6] for g in got) == Counter(plain.personal(documents))
    # What is added stands between base spans, which all stay.
    want = Counter()
    for d in documents:
        want.update((d["doc_id"], f"{('email', 'ip', 'card', 'phone')[k]}:{a}:{b}") for a, k, b in plain.personal_spans(d["text"] or ""))
    listed = Counter((g[0], s) for g in got for s in g[6].split(",") if s)
    assert not want - listed and sum((listed - want).values()) == sum(g[7] for g in got)


def test_base_patterns_on_odd_texts():
    from sitelode.llm.personal import base_spans

    rng = np.random.default_rng(8)
    signs = list("aB0123456789..@@++--  ()%_é\n")
    for _ in range(4000):
        text = "".join(rng.choice(signs, rng.integers(0, 60)))
        assert base_spans(text) == plain.personal_spans(text), text
    for text in ["a@b.c@d.e@f.g", "1.2.3.4.5.6.7.8.9", "0000000001.2.3.4", "+1 2345678901234567", "4111-1111 1111-1111 1", "1" * 4000 + ".1.1.1"]:
        assert base_spans(text) == plain.personal_spans(text), text


def test_tags_are_the_best_sequence():
    """Decoding against all sequences, likelihoods against their sum, gradients against differences."""
    from itertools import product

    from sitelode.llm import personal

    rng = np.random.default_rng(9)
    net = personal.Tagger.fresh(rng)
    net.w = {k: rng.standard_normal(v.shape) * 0.5 for k, v in net.w.items()}
    chars = rng.integers(1, 99, (4, 3))
    scores, (move, first) = net.emissions(chars), net.transitions()
    tags, gain = net.decoded(chars)
    for w in range(3):
        ways = {way: first[way[0]] + sum(scores[t, w, x] for t, x in enumerate(way)) + sum(move[a, b] for a, b in zip(way, way[1:], strict=False)) for way in product(range(personal.TAGS), repeat=4)}
        best = max(ways, key=ways.get)
        assert tuple(tags[:, w]) == best
        assert abs(gain[:, w].sum() + first[best[0]] - first[0] - (ways[best] - ways[0, 0, 0, 0])) < 1e-3 + abs(first[best[0]] - first[0])
        total = np.logaddexp.reduce(list(ways.values()))
        loss, _ = net.slopes(chars[:, w : w + 1], tags[:, w : w + 1])
        assert abs(loss - (total - ways[best])) < 1e-3
    gold = np.array([[0, 1, 5], [0, 2, 0], [3, 2, 7], [4, 0, 8]])
    _, slopes = net.slopes(chars, gold)
    for name, slope in slopes.items():
        place = np.unravel_index(int(np.argmax(np.abs(slope))), slope.shape)
        kept = net.w[name][place]
        net.w[name][place] = kept + 1e-3
        high, _ = net.slopes(chars, gold)
        net.w[name][place] = kept - 1e-3
        low, _ = net.slopes(chars, gold)
        net.w[name][place] = kept
        assert abs((high - low) / 2e-3 - slope[place]) < 0.02 * abs(slope[place]) + 1e-3, name


def test_spans_apart_are_the_best_choice():
    from itertools import combinations

    from sitelode.llm.personal import best_apart

    rng = np.random.default_rng(10)
    for _ in range(200):
        spans = [(int(a), int(k), int(a + n), float(s)) for a, k, n, s in zip(rng.integers(0, 20, 7), rng.integers(0, 4, 7), rng.integers(1, 8, 7), rng.integers(-3, 9, 7), strict=True)]
        score = {}
        for s in spans:
            score[s[:3]] = max(s[3], score.get(s[:3], s[3]))
        got = best_apart(spans)
        assert all(a[2] <= b[0] for a, b in zip(got, got[1:], strict=False))
        apart = (c for n in range(8) for c in combinations(sorted(score), n) if all(a[2] <= b[0] for a, b in zip(c, c[1:], strict=False)))
        assert sum(score[g] for g in got) == max(sum(score[s] for s in c) for c in apart)


def test_respelled_spans_are_found():
    """Held-out texts: what is spelled to escape the patterns is found whole, wherever it stands; clean texts have none."""
    from sitelode.llm import personal

    rng = np.random.default_rng(11)
    letters, filler = list("abcdefghijklmnopqrstuvwxyz"), [x for d in plain.rows(DATA, "documents")[:100] for x in (d["text"] or "").split() if x.isalpha()]

    def word(low=3, high=9):
        return "".join(rng.choice(letters, rng.integers(low, high)))

    def card():
        digits = "".join(map(str, rng.integers(0, 10, 15)))
        return next(digits + str(k) for k in range(10) if plain.luhn(digits + str(k)))

    def value(kind):
        a, b, c = (int(x) for x in rng.integers((200, 200, 1000), (999, 999, 9999)))
        return [f"{word()}.{word()}@{word()}.{word(2, 4)}", ".".join(map(str, rng.integers(0, 256, 4))), card(), f"+1 ({a}) {b}-{c}"][kind]

    def texts(n, respell):
        for i in range(n):
            kind = i % 4
            span = personal.respelled(value(kind), kind, rng) if respell else value(kind)
            before = " ".join(rng.choice(filler, rng.integers(0, 40)))
            yield f"{before} {span} " + " ".join(rng.choice(filler, 20)), (len(before) + 1, kind, len(before) + 1 + len(span))

    learnt = [personal.window_of(t[max(0, s[0] - 40) :], [(min(40, s[0]), s[1], s[2] - s[0] + min(40, s[0]))], respell, rng) for t, s in texts(800, False) for respell in (False, True)]
    learnt += [personal.window_of(" ".join([*rng.choice(filler, 12), str(rng.integers(0, 10 ** int(rng.integers(1, 9))))]), [], False, rng) for _ in range(400)]
    net = personal.train(np.array([c for c, _ in learnt]), np.array([t for _, t in learnt]))
    held = list(texts(200, True))
    found = personal.all_spans([t for t, _ in held], net)
    # A respelled address may hold a shorter base span, which stays instead.
    assert np.mean([s in f for (_, s), f in zip(held, found, strict=True)]) > 0.85
    clean = [" ".join(rng.choice(filler, 60)) + f" {n} {n / 100} 2024-05-{n % 28 + 1:02d} 12:{n % 60:02d} v1.{n}.3 " for n in range(100)]
    assert personal.all_spans(clean, net) == [plain.personal_spans(t) for t in clean]


def test_samples_depend_on_no_repeats(spark):
    """A row repeated very often changes nothing; each group gives as many as asked for, or all it has."""
    from pyspark.sql import functions as F

    from sitelode.llm.common import sampled, sampled_each

    rows = spark.range(4000).selectExpr("id", "CASE WHEN id % 1000 = 0 THEN 'rare' ELSE concat('l', id % 3) END AS lang", "xxhash64(id) AS order")
    often = rows.unionByName(rows.where("id = 7").withColumn("copies", F.explode(F.sequence(F.lit(1), F.lit(300_000)))).drop("copies"))
    for some in (rows, often):
        assert {r["id"] for r in sampled(some, "order", 500).collect()} == {r["id"] for r in rows.orderBy("order").limit(500).collect()}
        found = defaultdict(set)
        for r in sampled_each(some, "lang", "order", 200).collect():
            found[r["lang"]].add(r["id"])
        for lang in ("rare", "l0", "l1", "l2"):
            assert found[lang] == {r["id"] for r in rows.where(F.col("lang") == lang).orderBy("order").limit(200).collect()}
    assert sampled(rows.limit(0), "order", 5).count() == sampled_each(rows.limit(0), "lang", "order", 5).count() == 0


def test_every_language_is_learned(spark):
    """Also one of very few documents, beside a row repeated more often than all others together."""
    from pyspark.sql import functions as F

    from sitelode.llm.langid import identify, learned

    documents = spark.read.parquet(f"{DATA}/documents.parquet").where("lang IS NOT NULL").select("doc_id", "text", "lang")
    rare = spark.createDataFrame([(-i, f"здравствуй мир {i} это текст", "ru") for i in range(1, 9)], "doc_id long, text string, lang string")
    one = documents.where("length(text) > 0").limit(1).withColumn("copies", F.explode(F.sequence(F.lit(1), F.lit(20_000)))).drop("copies")
    model = learned(documents.unionByName(rare).unionByName(one), F.lit(False))
    assert model.langs == sorted({r["lang"] for r in documents.select("lang").distinct().collect()} | {"ru"})
    found = rare.select(identify(F.col("text"), model)["lang_pred"].alias("l")).collect()
    assert [r["l"] for r in found] == ["ru"] * 8


def test_network_slopes():
    """Gradients against differences."""
    from sitelode.llm import toxicity

    rng = np.random.default_rng(3)
    texts = [b"one two three four idiot", b"a b c d e f g h i j k l m n o p q r s t u v w x y z one two"]
    some = toxicity.read(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    net = toxicity.Network.fresh(np.unique(some.hashes[:4]), np.unique(some.stems[:4]), rng)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    at, real = toxicity.places(some, some.firsts[:-1], np.arange(2))
    label = np.array([1.0, 0.0])

    def loss():
        logit = net.run(net.entered(net.inputs(some).astype(np.float64)), at, real)
        return np.mean(np.log1p(np.exp(-logit * (2 * label - 1))))

    slopes = net.slopes(some, net.inputs(some), at, real, label)
    for name, slope in slopes.items():
        place = np.unravel_index(int(np.argmax(np.abs(slope))), slope.shape)
        kept = net.w[name][place]
        net.w[name][place] = kept + 1e-2
        high = loss()
        net.w[name][place] = kept - 1e-2
        low = loss()
        net.w[name][place] = kept
        assert abs((high - low) / 2e-2 - slope[place]) < 0.05 * abs(slope[place]) + 1e-4, name


def test_training_sees_every_window(monkeypatch):
    from sitelode.llm import toxicity

    rng = np.random.default_rng(4)
    plainly = np.array([a + b + c for a in "bdfgklmn" for b in "aeiou" for c in "nrst"])
    clean = [" ".join(rng.choice(plainly, n)) for n in [450_000] + [60] * 40]
    # The passage lies far behind the first window of its text.
    toxic = [" ".join([*rng.choice(plainly, 300), "vile", "scum", *rng.choice(plainly, 200)]) for _ in range(40)]
    bad = toxicity.read(np.frombuffer(b"vile", np.uint8), np.array([0, 4])).hashes[0]
    slopes, apart, learned, seen = toxicity.Network.slopes, toxicity.Network.logits_apart, [], []

    def watched(net, some, inputs, at, real, label):
        learned.extend(bad in some.hashes[a:b] for a, b, y in zip(some.firsts[:-1], some.firsts[1:], label, strict=True) if y)
        return slopes(net, some, inputs, at, real, label)

    monkeypatch.setattr(toxicity, "ROUNDS", 1)
    monkeypatch.setattr(toxicity.Network, "slopes", watched)
    monkeypatch.setattr(toxicity.Network, "logits_apart", lambda net, some, first, text: (seen.append(len(first)), apart(net, some, first, text))[1])
    toxicity.train(toxic + clean, np.repeat([1, 0], [len(toxic), len(clean)]))
    assert learned and all(learned)
    assert seen == [sum(max(1, -(-(len(t.split()) - toxicity.LENGTH) // toxicity.STEP) + 1) for t in toxic + clean)]


def test_automaton_counts():
    from sitelode.llm.substrings import Automaton

    rng = np.random.default_rng(5)
    for _ in range(20):
        texts = {tuple(rng.integers(0, 3, rng.integers(4, 15)).tolist()): int(rng.integers(1, 3)) for _ in range(4)}
        automaton = Automaton()
        for text, times in texts.items():
            automaton.add(list(text), times)
        automaton.finish()
        seen = Counter()
        for text, times in texts.items():
            seen.update({k: times * c for k, c in Counter(text[i : i + 4] for i in range(len(text) - 3)).items()})
        for text in texts:
            mask = automaton.repeated(list(text), 4)
            assert [mask >> i & 1 for i in range(len(text) - 3)] == [int(seen[text[i : i + 4]] > 1) for i in range(len(text) - 3)]


@pytest.mark.parametrize("name", ["op3_topk", "op13_prefix_trie"])
def test_sql_on_odd_tables(spark, tmp_path, name):
    from oracle import connect, differences

    odd = plain.odd_tables(tmp_path)
    assert differences(QUERIES[name](spark, odd), connect(odd), SQL[name]) == []


def test_sql(spark, oracle):
    from oracle import differences

    for name, sql in SQL.items():
        assert differences(QUERIES[name](spark, DATA), oracle, sql) == []


def test_packing_coder_serves_a_whole_worker():
    from sitelode.llm import packing

    path = packing.tokenizer_path()
    coder = packing.worker_coder(path)
    (ids,) = coder.ids([b"some words, again some"])
    assert packing.worker_coder(path) is coder and b"again" in coder.known
    assert ids == next(packing.WordTokens(path).ids([b"some words, again some"]))
