"""The pipeline, stage by stage, against brute-force versions of each stage's decisions on that stage's own input."""

import brute
import corpus_pipeline
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from cohortlens.llm import byte_bpe, decontaminate, queries
from cohortlens.llm.common import saved

SF = "/root/testdata/sf0.001"


def test_stages(spark, documents):
    base = documents.select("doc_id", "text", "lang", "source", "n_chars", "spans")
    inputs, docs = [], base
    for _, stage in corpus_pipeline.STAGES:
        inputs.append(docs)
        docs = saved(stage(spark, docs, SF))
    assert all(x.columns == base.columns for x in inputs)
    rows = [[tuple(r) for r in x.collect()] for x in inputs]
    texts = [{r[0]: r[1] for r in x} for x in rows]

    # quality: nothing that the base rules reject stays, and rejected rows are gone whole
    counts = {i: brute.quality_base(t) for i, t in texts[0].items()}
    failed = {i for i, c in counts.items() if c[0] < 20 or 100 * c[4] > 30 * c[0]}
    assert failed and not failed & set(texts[1]) and len(texts[1]) > 0.7 * (len(texts[0]) - len(failed))
    assert all(texts[1][i] == texts[0][i] for i in texts[1])
    # line dedup: the same rows, with some lines gone and n_chars following
    assert sorted(map(str, texts[2])) == sorted(map(str, texts[1]))
    for r in rows[2]:
        before, after = texts[1][r[0]].split("\n"), r[1].split("\n")
        assert len(after) <= len(before) and set(after) <= set(before) and r[4] == len(r[1])
    # near duplicates: the smallest id of each component, once
    named = [(i, t) for i, t in texts[2].items() if i is not None]
    keep = {i for i, (_, c) in brute.components(named).items() if i == c}
    assert sorted(r[0] for r in rows[3] if r[0] is not None) == sorted(keep)
    # benchmark passages
    items = [decontaminate.item_words(t.encode()) for _, t in queries.table(spark, SF, "benchmark").collect()]

    def leaks(text):
        w = decontaminate.item_words(text.encode())
        return any(set(x) & set(w) and brute.word_edit_distance(x, w) <= decontaminate.edits(len(x)) for x in items)

    short = {i: t for i, t in texts[3].items() if len(t) < 2000}
    assert {i for i in short if i in texts[4]} == {i for i, t in short.items() if not leaks(t)}
    # encoding
    known = tiktoken.Encoding("known", pat_str=public_tokenizers.PATTERN, special_tokens={},
                              mergeable_ranks=byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    out = docs.collect()
    assert sorted(map(str, (r["doc_id"] for r in out))) == sorted(map(str, texts[4]))
    assert all(r["round_trip"] and r["ids"] == known.encode_ordinary(texts[4][r["doc_id"]]) for r in out)


def test_run_and_empty_table(spark, documents):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "byte-level BPE"]
    docs = documents.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
    out = corpus_pipeline.run(spark, SF)
    assert out.where(~F.col("round_trip")).count() == 0 and out.count() > 100
