"""The pipeline's stages, each against its own input."""

from __future__ import annotations

import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import plain
from conftest import DATA
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sitelode.llm import secrets, toxicity
from sitelode.llm.common import fold
from sitelode.llm.packing import tokenizer_path


# Enough toxic documents to learn from.
LARGER = DATA.replace("0.001", "0.01")


def stages(spark, folder, out):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for place, (name, stage) in enumerate(corpus_pipeline.STAGES):
        found = stage(spark, docs, folder)
        assert place == len(corpus_pipeline.STAGES) - 1 or found.columns == columns
        found.write.parquet(f"{out}/{name}")
        yield name, docs, (docs := spark.read.parquet(f"{out}/{name}"))


def test_stages(spark, tmp_path):
    found = {name: (before, after) for name, before, after in stages(spark, LARGER, tmp_path)}
    rows = {name: [r.asDict() for r in after.collect()] for name, (_, after) in found.items()}
    every = [r.asDict() for r in found["toxicity"][0].collect()]
    # Toxic documents go, and the others stay as they are.
    mark = {x["doc_id"]: x["toxic"] for x in plain.rows(LARGER, "labels")}
    stayed = {r["doc_id"] for r in rows["toxicity"]}
    toxic, clean = ({i for i, m in mark.items() if m == value} for value in (1, 0))
    assert len(toxic - stayed) >= 0.7 * len(toxic) and len(clean & stayed) >= 0.95 * len(clean) and len(stayed) >= 0.7 * len(every)
    net = toxicity.learned(found["toxicity"][0], spark.read.parquet(f"{LARGER}/labels.parquet"), fold("doc_id", 3) == 1)
    scores = {r["doc_id"]: r["s"] for r in found["toxicity"][0].select("doc_id", toxicity.toxicity(F.col("text"), net).alias("s")).collect()}
    assert stayed == {i for i, s in scores.items() if s < toxicity.TOXIC}
    assert all(r in every for r in rows["toxicity"])
    # Of each component the smallest id stays, as it is.
    assert {r["doc_id"] for r in rows["simhash"]} == {g[2] for g in plain.groups(rows["toxicity"])} != stayed
    assert all(r in rows["toxicity"] for r in rows["simhash"])
    # The benchmark's passages are cut out, and nothing else.
    benchmark = plain.rows(LARGER, "benchmark")
    assert any(x[2] for x in plain.leaks(rows["simhash"], benchmark))
    assert {r["doc_id"]: r["text"] for r in rows["decontamination"]} == dict(plain.without_leaks(rows["simhash"], benchmark))
    # Secrets are replaced by a mark each, and no pattern finds any.
    assert any(sum(x[1:4]) for x in plain.fixed_secrets(rows["decontamination"]))
    assert sum(sum(x[1:4]) for x in plain.fixed_secrets(rows["secrets"])) == 0
    masked = {r["doc_id"]: r["text"] for r in rows["secrets"]}
    for r in rows["decontamination"]:
        text, last, kept = r["text"], 0, []
        for start, kind, end in secrets.spans(text):
            kept += [text[last:start], f"[{kind}]"] if start >= last else []
            last = max(last, end)
        assert masked.pop(r["doc_id"]) == "".join([*kept, text[last:]])
    assert not masked and all(r["n_chars"] == len(r["text"]) for r in rows["secrets"])
    # The pieces hold all tokens, once.
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for r in rows["secrets"]:
        ids = np.array([*tokenizer.encode(r["text"], add_special_tokens=False).ids, 2], "<u4")
        want.update((r["doc_id"], a, min(4096, len(ids) - a), zlib.crc32(ids[a : a + 4096].tobytes())) for a in range(0, len(ids), 4096))
    assert Counter((p["doc_id"], p["start"], p["length"], p["ids_crc32"]) for p in rows["packing"]) == want


def test_odd_and_empty_tables(spark, tmp_path):
    for empty in (False, True):
        folder = tmp_path / f"t{empty}"
        folder.mkdir()
        plain.odd_tables(folder, empty)
        for name, _, after in stages(spark, folder, tmp_path / f"out{empty}"):
            assert (after.count() == 0) == empty, name


def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0
