"""Operators that meet a table of any size: tokens, replacements, authors; nested JSON-LD; totals of a writing job."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sitelode.operators import attribution, jsonld
from sitelode.operators import rewrite as rw
from sitelode.operators import tokens
from sitelode.operators.tokens import Automaton, held_tokens
from sitelode.sources import records


def test_automaton_finds_all_tokens():
    rng = random.Random(1)
    for _ in range(300):
        tokens = sorted({"".join(rng.choices("abc", k=rng.randint(1, 5))) for _ in range(rng.randint(1, 12))})
        text = "".join(rng.choices("abcd", k=40))
        held = Automaton(tokens).held(text)
        assert Counter(held) == Counter(t for t in tokens if t in text)
        ends = [text.index(t) + len(t) for t in held]
        assert ends == sorted(ends)
        assert all(len(a) > len(b) for a, b, x, y in zip(held, held[1:], ends, ends[1:], strict=False) if x == y)


def test_automaton_walks_a_stretch_once(monkeypatch):
    """Also with signs that mean something in patterns; a worker builds an automaton once."""
    walked = []
    plain = Automaton.walked
    monkeypatch.setattr(Automaton, "walked", lambda self, text: walked.append(text) or plain(self, text))
    automaton = Automaton(["ab", "b", "^-]", "\\"])
    texts = ["ab x ab\nbb ^-] ab", "ab", "\\", "", "bab" * 30, "bab" * 30]
    assert [automaton.held(t) for t in texts] == [["ab", "b", "^-]"], ["ab", "b"], ["\\"], [], ["b", "ab"], ["b", "ab"]]
    assert walked == ["ab", "bb", "^-]", "\\", "bab" * 30, "bab" * 30]
    assert tokens._automaton(["a", "b"]) is tokens._automaton(["a", "b"]) is not tokens._automaton(["a"])


@pytest.mark.parametrize("part_bytes", [8 << 20, 20_000])
def test_ten_thousand_tokens_in_one_pass(spark, part_bytes):
    tokens = spark.range(10_000).select(F.concat(F.lit("t"), "id").alias("token")).union(spark.createDataFrame([("t1",), (None,), ("",), ("é",)], "token string"))
    pages = spark.createDataFrame([(1, "xt123y t9999. é"), (2, None), (3, ""), (4, "none"), (5, "t0" * 50)], "page_id long, html string")
    found = held_tokens(pages, tokens, ["page_id"], part_bytes=part_bytes)
    want = {(1, t) for t in ("t1", "t12", "t123", "t9", "t99", "t999", "t9999", "é", "")} | {(p, "") for p in (3, 4, 5)} | {(5, "t0")}
    assert Counter(map(tuple, found.collect())) == Counter(want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == (1 if part_bytes > 100_000 else -(-48_902 // part_bytes)) and "Join" not in plan
    assert held_tokens(pages, tokens.limit(0), ["page_id"]).count() == 0


def test_replacements_from_a_table_of_a_million_keys(spark):
    """Unknown keys stay, the least of several values counts, a key is on nearly every page, and text is shuffled once at most."""
    values = spark.range(1_000_000).selectExpr("concat('k', id) AS key", "concat('v$', id) AS value").union(spark.createDataFrame([("k1", "a"), ("k2", None), (None, "n")], "key string, value string"))
    html = ["<k1><k2>", "<none>", None, "no keys", "<k999999> <k1> <K1>", ""]
    pages = spark.createDataFrame(list(enumerate(html)), "page_id long, html string").union(spark.range(10, 3000).selectExpr("id", "'<k1>' AS html"))
    out = rw.replace_by_table(pages, values, "page_id", "<(\\w+)>", 1, lambda match, value: F.concat(F.lit("["), value, F.lit("]")))
    got = {r.page_id: (r.html_new, r.ledger[0].status, r.ledger[0].n_repl) for r in out.collect()}
    assert len(got) == 2996 and all(got[i] == ("[a]", "updated", 1) for i in range(10, 3000))
    assert [got[i] for i in range(6)] == [("[a][v$2]", "updated", 2), ("<none>", "no_match", 0), (None, "unchanged", 0), ("no keys", "no_match", 0), ("[v$999999] [a] <K1>", "updated", 2), ("", "no_match", 0)]
    text = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert len(text) == 2  # pairs with the table, and the pages with their values


def test_authors_from_a_table(spark):
    titled = spark.createDataFrame([(1, " A &amp; B "), (2, "“C”"), (3, "D"), (4, None), (5, "")], "id long, title string")
    authors = spark.createDataFrame([("A & B", "Zed"), ("A &amp; B", "Ann"), ('"C"', None), ('&ldquo;C"', "Bo"), (None, "Nobody"), ("D ", None)], "title string, author string")
    got = {r.id: r.author for r in attribution.with_authors(titled, authors, "Cy").collect()}
    assert got == {1: "Ann", 2: "Bo", 3: "Cy", 4: "Cy", 5: "Cy"}


def test_nodes_of_nested_json_ld(spark):
    def block(*texts):
        return "".join(jsonld.OPEN_TAG + t + jsonld.CLOSE_TAG for t in texts)

    pages = [
        (1, block('{"@type":"A","x":1}', '[{"@type":["B","C"]},{"y":2},3,null]')),
        (2, block('{"@context":"c","@graph":[{"@type":"D"},{"@type":[]},"s"]}', '{"@type":"F","@graph":[{"@type":"G"}]}', '{"@type":', "5", "null", "[]", '{"@graph":{"@type":"H"}}')),
        (3, "no blocks"),
        (4, None),
    ]
    found = jsonld.json_nodes(spark.createDataFrame(pages, "page_id long, html string"), ["page_id"])
    got = Counter((r.page_id, r.pos, r.node, r.type) for r in found.collect())
    want = [(1, 0, 0, "A"), (1, 1, 0, "B"), (1, 1, 0, "C"), (1, 1, 1, None), (2, 0, 0, "D"), (2, 0, 1, None), (2, 1, 0, "F"), (2, 1, 1, "G")]
    assert got == Counter([*want, *((2, pos, None, None) for pos in (2, 3, 4, 5)), (2, 6, 0, None)])
    assert {r.json for r in found.where("pos = 2 AND page_id = 2").collect()} == {'{"@type":'}


def test_totals_come_from_the_writing_job(spark, tmp_path):
    """The fold runs once: a counter in it moves as many times as there are pages and rules."""
    pages = spark.createDataFrame([(i, "old" * (i % 3) + ("done" if i == 4 else "")) for i in range(30)] + [(99, None)], "page_id long, html string")
    rules = [rw.ReplaceText(name="r", old="old", new="new"), rw.ReplaceText(name="same", old="n", new="n"), rw.Insert(name="g", text="x", anchors=["new"], guard="done")]
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(html):
        calls.add(1)
        return html

    source = pages.withColumn("html", counted.asNondeterministic()("html"))
    rewritten, totals = rw.observed_totals(rw.rewrite_pages(source, rules), [r.name for r in rules])
    records.write_changed(rewritten, str(tmp_path / "changed"))
    got = {tuple(r) for r in totals().collect()}
    assert calls.value == 31
    assert got == {tuple(r) for r in rw.ledger_totals(rw.rewrite_pages(pages, rules)).collect()} and any(r[1] == "unchanged" for r in got)
    assert spark.read.parquet(str(tmp_path / "changed")).count() == 20
