"""The pipeline and each of its stages against brute force, on odd rows and on generated documents."""

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from arborstat.llm import rule_classifier
from arborstat.llm.rule_classifier import held_out, statistics, with_statistics

from .common import SCHEMA, frame, generated, near_components, odd_rows, repeated_rows, without_repeats

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)
DOCUMENTS = list(corpus_pipeline.COLUMNS)


def plain(text):
    return (text or "").translate({ord(c): None for c in " \t\n\x0b\x0c\r"})


def clashing(df):
    """Further columns with the names of results."""
    return df.selectExpr("*", *(f"'x' as {c}" for c in ("digest", "content", "component_id", "kept", "lines", "start", "length", "group", "_file")))


def stage(spark, name, rows):
    out = STAGES[name](spark, clashing(frame(spark, rows)), SF)
    if name != "packing":
        assert out.columns == DOCUMENTS
    return [tuple(r) for r in out.collect()]


def texts(rows):
    return sorted((str(r[0]), r[1] or "") for r in rows)


ROWS = [odd_rows(), repeated_rows(), [*odd_rows(), *((100 + r[0], *r[1:]) for r in generated(60))], []]


def fitted(spark):
    docs, labels = ({r.doc_id: r for r in spark.read.parquet(f"{SF}/{t}.parquet").collect()} for t in ("documents", "labels"))
    learnt = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where(~held_out(F.col("doc_id")) & F.col("quality").isNotNull()).collect()}
    order = sorted(k for k in learnt if k in docs)
    return rule_classifier.fit(np.array([statistics(docs[k].text) for k in order]), np.array([float(labels[k].quality) for k in order]))


def scored(model, text):
    """The model's score, rule by rule."""
    x = statistics(text)
    return 1 / (1 + np.exp(-model.start - sum(w for rule, w in zip(model.rules, model.weights, strict=True) if all((x[s] > v) == above for s, above, v in rule))))


@pytest.mark.parametrize("rows", ROWS)
def test_quality(spark, rows):
    model = fitted(spark)
    want = [r[:5] for r in rows if scored(model, r[1]) >= corpus_pipeline.KEEP_SCORE]
    assert texts(stage(spark, "quality_classifier", rows)) == texts(want)


@pytest.mark.parametrize("rows", ROWS)
def test_exact_copies(spark, rows):
    best = {}
    for r in rows:
        key = (-len(r[1] or ""), r[0] is None, r[0] or 0)
        if plain(r[1]) not in best or key < best[plain(r[1])][0]:
            best[plain(r[1])] = key, r[:5]
    assert texts(stage(spark, "exact_dedup", rows)) == texts(r for _, r in best.values())


@pytest.mark.parametrize("rows", ROWS)
def test_near_copies(spark, rows):
    named = {}
    for r in rows:
        if r[0] is not None:
            named[r[0]] = r[1]
    labels = near_components(list(named.items()), 5, 80)
    want = [r for r in rows if r[0] is None or labels[r[0]][1] == r[0]]
    assert texts(stage(spark, "near_dedup", rows)) == texts(want)


@pytest.mark.parametrize("rows", ROWS)
def test_passages(spark, rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    cut = without_repeats([(n, r[1]) for n, r in enumerate(order)], corpus_pipeline.PASSAGE_BYTES)
    left = [(r[0], cut[n][0].decode("utf-8", "ignore")) for n, r in enumerate(order) if not cut[n][1] or cut[n][0].decode("utf-8", "ignore").strip(" ")]
    got = stage(spark, "suffix_dedup", rows)
    assert texts(got) == texts(left) and all(r[4] == len(r[1]) for r in got)


@pytest.mark.parametrize("rows", ROWS)
def test_packing(spark, rows):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = stage(spark, "packing", rows)
    want = sorted(len(library.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows)
    assert sum(r[2] for r in got) == sum(want) and sorted(r[4] for r in got if r[1] == 0) == want


def test_whole_pipeline(spark):
    """On the whole documents of the smallest scale: each stage's brute force on all that the one before kept."""
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select(*DOCUMENTS).collect()]
    model = fitted(spark)
    rows = [r for r in rows if scored(model, r[1]) >= corpus_pipeline.KEEP_SCORE]
    best = {}
    for r in sorted(rows, key=lambda r: (-len(r[1] or ""), r[0])):
        best.setdefault(plain(r[1]), r)
    rows = sorted(best.values())
    labels = near_components([r[:2] for r in rows], 5, 80)
    rows = [r for r in rows if labels[r[0]][1] == r[0]]
    cut = without_repeats([r[:2] for r in rows], corpus_pipeline.PASSAGE_BYTES)
    left = {r[0]: cut[r[0]][0].decode("utf-8", "ignore") for r in rows if not cut[r[0]][1] or cut[r[0]][0].strip(b" ")}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: r.doc_tokens for r in got} == {d: len(library.encode(t, add_special_tokens=False).ids) + 1 for d, t in left.items()}
    used = {}
    for r in got:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in used.values():
        assert [o for o, _ in sorted(pieces)] == [sum(n for _, n in sorted(pieces)[:k]) for k in range(len(pieces))] and sum(n for _, n in pieces) <= 4096


def test_a_kept_column_with_the_name_of_a_result(spark):
    df = spark.createDataFrame(odd_rows(), SCHEMA).withColumn("lines", F.lit(1))
    with pytest.raises(ValueError):
        with_statistics(df, keep=("lines",))
