"""The pipeline stage by stage against plain versions of what each stage must keep or make."""

import collections

import corpus_pipeline
import numpy as np
import pytest
from test_operators import BPE, WORD, brute_near, check_packing, frame
from tokenizers import Tokenizer

from tapeline.llm import apportion, crf, gbdt
from tapeline.llm.common import prepare
from tapeline.session import cut


@pytest.fixture(scope="module")
def steps(spark, sf):
    prepare(spark)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(cut(stage(spark, out[-1], sf), name))
    return [x.toPandas() for x in out]


def test_columns_and_order(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "personal_data", "mix", "packing"]
    assert all(list(x.columns) == corpus_pipeline.COLUMNS for x in steps[:-1])


def test_quality_keeps_what_the_classifier_does(spark, sf, steps):
    docs, kept = steps[0], steps[1]
    model = gbdt.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    want = docs[model.scores(gbdt.features(docs["text"])) >= 0.3]
    assert sorted(kept["doc_id"]) == sorted(want["doc_id"]) and 0 < len(kept) <= len(docs)


def test_one_document_of_each_group_stays(steps):
    before, after = steps[1], steps[2]
    want = {i for i, (_, _, kept) in brute_near(list(zip(before["doc_id"], before["text"])), 5, 80).items() if kept}
    assert set(after["doc_id"]) == want and len(after) == len(want) < len(before)


def test_no_pattern_is_left(steps):
    before, after = steps[2].set_index("doc_id"), steps[3].set_index("doc_id")
    assert set(before.index) == set(after.index)
    for i, r in after.iterrows():
        base = crf.pattern_spans(before.text[i])
        assert not [x for x in crf.pattern_spans(r.text) if x[0] in ("email", "ip")] and r.n_chars == len(r.text)
        assert base or r.text.count("[") >= before.text[i].count("[")
        for kind, s, e in base:
            assert before.text[i][s:e] not in r.text


def test_mix_has_the_words_of_its_plan(spark, steps):
    before, after = steps[3], steps[4]
    rows = [(int(r.doc_id), r.text, r.lang, r.source) for r in before.itertuples()]
    plan = apportion.plan(frame(spark, rows)).toPandas()
    got = collections.Counter()
    for r in after.itertuples():
        got[r.doc_id] += len(WORD.findall(r.text))
    assert got == {k: v for k, v in zip(plan["doc_id"], plan["taken"]) if v}
    for _, t in plan.groupby("source"):
        assert abs(t["taken"].sum() - t["target"].iloc[0]) <= 2 * apportion.UNIT


def test_packing_holds_every_token_of_the_mix(steps):
    mix, packed = steps[4], steps[5]
    tok = Tokenizer.from_file(BPE)
    n = sum(len(tok.encode(t, add_special_tokens=False).ids) + 1 for t in mix["text"])
    assert packed["length"].sum() == n
    assert check_packing(list(packed.itertuples()), corpus_pipeline.CAPACITY) <= -(-n // corpus_pipeline.CAPACITY) + 2
    assert packed["sequence_id"].notna().all() and np.isin(packed["doc_id"], mix["doc_id"]).all()


def test_run_writes_between_stages(spark, sf):
    """The pipeline as a whole: every token of the mix is packed, gapless, and reading the result again gives the same rows."""
    out = corpus_pipeline.run(spark, sf)
    rows = out.select("sequence_id", "offset", "length", "doc_id", "piece").collect()
    assert rows and all(r.sequence_id is not None for r in rows)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= corpus_pipeline.CAPACITY
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, out.select("sequence_id", "offset", "length", "doc_id", "piece").collect()), key=str)
