"""The pipeline against plain Python, stage by stage, on the smallest tables."""

import os
import re
import sys

import pytest

from tests.llm.common import words
from tests.llm.test_scans import SECRETS
from tests.llm.test_texts import brute_classes
from waymark.llm import pieces, stages, toxicity
from waymark.session import cut_lineage, read_table

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import corpus_pipeline  # noqa: E402


def redacted(text):
    spans = sorted((m.start(), m.end()) for _, p, ok in SECRETS for m in p.finditer(text) if ok(m))
    out, at = [], 0
    for s, e in spans:
        if s >= at:
            out += [text[at:s], "[SECRET]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def test_run_equals_brute_force(spark, folder):
    import sentencepiece

    docs = read_table(spark, folder, "documents")
    scores = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(docs, read_table(spark, folder, "labels"), keep=["doc_id"]).collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if scores[r["doc_id"]] == 0]
    heads = dict(brute_classes(rows)[0])
    rows = [(i, t) for i, t in rows if heads[i] == i]
    items = [" ".join(words(r["text"])) for r in read_table(spark, folder, "benchmark").collect()]
    clean = [(i, t) for i, t in rows if not any(f" {x} " in f" {' '.join(words(t))} " for x in items if x)]
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    want = {i: library.encode(redacted(t or "")) for i, t in clean}
    got = {r["doc_id"]: list(r["ids"]) for r in corpus_pipeline.run(spark, folder).collect()}
    assert got == want and len(want) < docs.count()


def test_stages_keep_columns_and_take_awkward_rows(spark, folder):
    schema = "doc_id long, text string, lang string, source string, n_chars long, _key string, base string"
    rows = [(1, None, None, None, None, None, None), (None, "", "en", "s", 0, "k", "b"), (2, "token = 'abcdefabcdefabcdef'", "en", "s", 28, "k", "b"), (2, "token = 'abcdefabcdefabcdef'", "en", "s", 28, "k", "b"), (3, "x " * 20_000, "en", "s", 40_000, "k", "b")]
    docs = spark.createDataFrame(rows, schema)
    for given in (docs, docs.limit(0)):
        kept = given
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = cut_lineage(stage(spark, kept, folder))
            assert kept.columns == docs.columns
        last = corpus_pipeline.STAGES[-1][1](spark, kept, folder).collect()
        assert len(last) == kept.count() == (3 if given is docs else 0)  # the null and the empty text are copies
        texts = {r["doc_id"]: r for r in kept.collect()}
        if given is docs:
            assert re.sub("[a-f]{18}", "", texts[2]["text"]) == texts[2]["text"] and texts[2]["n_chars"] == len(texts[2]["text"])


def test_stage_list():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "pieces"]
    assert corpus_pipeline.STAGES[0][1] is stages.drop_toxic
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("name", ["op2_toxicity", "op6_minhash", "op8_embeddings", "op9_pieces", "op10_shards"])
def test_queries_give_a_row_for_each_row(spark, folder, name):
    from waymark.llm import queries

    table = "embeddings" if name == "op8_embeddings" else "documents"
    got = queries.QUERIES[name](spark, folder)
    if name == "op10_shards":
        assert got.where("NOT stored").count() == 0 and got.count() > 0
    else:
        assert got.count() == read_table(spark, folder, table).count()
