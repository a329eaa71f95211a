"""General interfaces: redaction, mixing, chat grammar, stripping, components, the pipeline's stages."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weftline.llm import chat, lines, mixing, quality, secrets
from weftline.llm.common import shared_dir, table
from weftline.llm.components import components
from weftline.llm.jaccard import keep_first

from .conftest import DOCS, rows
from .test_queries import brute_components, check_packing


def test_components_like_union_find(spark):
    r = random.Random(1)
    edges = [(r.randint(0, 80), r.randint(0, 80)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 240)] + [(7, 7)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: top(n) for e in edges for n in e if e[0] != e[1]}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_chat_grammar(spark):
    texts = ["plain", "</s>", "[INST] x [/INST]", "\\", "\\l\\b\\e", "<s>", "a </s", "", "<s+>"]
    rows_ = [(i, t, role, x) for i, x in enumerate(texts) for t, role in enumerate(["user", "assistant"])]
    for r in chat.format_chats(spark.createDataFrame(rows_, "conv_id long, turn long, role string, text string")).collect():
        assert [(p.role, p.text) for p in r.parsed] == [(t.role, t.text) for t in r.turns]
        assert r.level == int(any(c in texts[r.conv_id] for c in chat.CONTROLS))
        assert sum(r.formatted.count(c) for c in chat.CONTROLS) == 1 + 3 * len(r.turns)  # the template's alone
        for p in r.parsed:
            raw = r.formatted[p.start : p.start + p.length]
            assert raw == p.text or r.level
    bad = spark.createDataFrame([("[INST]a[/INST]b</s>",), ("<s>[INST]a b</s>",), ("<s>[INST]a[/INST]b",)], "x string")
    assert [r[0] for r in bad.select(chat.parse(F.col("x"))).collect()] == [None] * 3


def test_quality_keeps_clean_and_carries_columns(spark, hard):
    out = quality.quality(table(spark, hard, "documents"))
    assert {"doc_id", "source", "size", "kept", "n_words"} <= set(out.columns) and len(out.columns) == len(set(out.columns))
    kept = {r.doc_id for r in out.where("kept").collect()}
    assert {1, 4, 5, 20} <= kept and not kept & {6, 7, 8, 9, 12, 23}


def test_redaction(spark):
    text = 'a token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" b'
    docs = spark.createDataFrame([(1, text, "s"), (2, "no secret here", "s"), (3, None, "s")] + [(10 + i, 'password: "example1234abc"', f"o{i}") for i in range(5)], "doc_id long, text string, source string").withColumn("n_chars", F.length("text").cast("long"))
    got = {r.doc_id: r for r in secrets.redact_secrets(spark, docs, "").collect()}
    assert got[1].text == 'a token = "[SECRET]" b' and got[1].n_chars == len(got[1].text)
    assert got[2].text == "no secret here" and got[3].text is None
    assert got[12].text == 'password: "example1234abc"'  # many owners: an example


def test_mixing(spark):
    rows_ = [(i, "w " * (1 + i % 40), s) for k, s in enumerate(["a", "b", "c", "d", None]) for i in range(k * 1000, k * 1000 + 300)]
    out = mixing.mix_plan(spark.createDataFrame(rows_, "doc_id long, text string, source string"))
    a, b = out.orderBy("doc_id").collect(), out.orderBy("doc_id").collect()
    assert a == b
    by = {}
    for r in a:
        assert 0 <= r.copies <= 3
        t = by.setdefault(r.source, [r.target, 0, r.source_size])
        t[1] += r.copies * r.size
    total = sum(t[2] for t in by.values())
    assert sum(t[0] for t in by.values()) == pytest.approx(total)
    for target, taken, size in by.values():
        assert abs(taken - target) <= 0.02 * target and target <= 3 * size + 1e-6
    assert by["a"][0] == pytest.approx(total * 5 / 15)
    assert mixing.emit(out).count() == sum(r.copies for r in a)


def test_targets_stop_at_three_times(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 100), ("c", 1000), ("d", 0)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    # a (weight 5), b (2) and d (5) stop at 30, 300 and 0; c (1) has the rest
    assert got == {"a": 30.0, "b": 300.0, "c": 780.0, "d": 0.0}


def test_lines_strip(spark):
    base = "one two three four five six seven eight nine."
    docs = [(2, base + "\nother line of the text that is long enough here"), (1, "x\n" + base + "\ny"), (3, "Start of it all is a sentence of words. " + base + " End.")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = lines.repeated(df).join(df, "doc_id").select("doc_id", lines.strip(F.col("text"), F.col("removed")).alias("t"))
    got = {r.doc_id: r.t for r in out.collect()}
    assert got[1] == docs[1][1] and got[2] == "other line of the text that is long enough here"
    assert got[3].endswith("End.") and "seven" in got[3]  # its last word has no full stop of its own: another unit


def test_keep_first(spark, hard):
    docs = table(spark, hard, "documents")
    out = keep_first(spark, docs, hard)
    assert out.columns == docs.columns
    got = [r.doc_id for r in out.collect()]
    comp = brute_components([(r[0], r[1]) for r in rows() if r[0] is not None], 5, 4, 5)
    assert sorted(x for x in got if x is not None) == sorted({c for _, c in comp.values()}) and got.count(None) == 2


def test_pipeline(spark, hard, empty):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "secret scans", "source mixing", "packing"]
    assert corpus_pipeline.run(spark, empty).collect() == []
    docs = table(spark, hard, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, docs, hard)
        assert new.columns == docs.columns, name
        docs = spark.createDataFrame(new.collect(), DOCS)
    want = [(r.doc_id, r.text) for r in docs.collect()]
    assert {1, 4, 20} & {i for i, _ in want} and 2 not in {i for i, _ in want}
    check_packing(corpus_pipeline.run(spark, hard).collect(), want)


def test_shared_folder_is_the_sessions(spark):
    assert shared_dir(spark) == spark.sparkContext.getCheckpointDir()
