"""The pipeline's stages against plain decisions on their own input."""

from __future__ import annotations

import corpus_pipeline
import test_text_ops as plain
from lossledger.llm import packing, quality_classifier, quality_rules
from lossledger.llm.common import Scratch, table

SF = "/root/testdata/sf0.001"


def test_each_stage_on_its_own_input(spark):
    scratch = Scratch(spark, "test-pipeline")
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    names, inputs = [n for n, _ in corpus_pipeline.STAGES], [docs]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        inputs.append(scratch.store(stage(spark, inputs[-1], SF), f"s{number}"))
    assert len(names) == 5
    assert all(d.columns == docs.columns for d in inputs[:-1])
    rows = [[tuple(r) for r in d.select(docs.columns).collect()] for d in inputs[:-1]]

    good = {r.doc_id for r in quality_classifier.classify(inputs[0], labels).collect() if r.predicted}
    assert {r[0] for r in rows[1]} == good
    # The stage judges its own input by what all labelled documents teach.
    passing = {r.doc_id for r in quality_rules.quality_rules(docs, labels).collect() if r.kept} & good
    assert {r[0] for r in rows[2]} == passing
    firsts = {i for i, _, c in plain.plain_components(rows[2]) if i == c}
    assert {r[0] for r in rows[3]} == firsts
    want = {i: n - gone for i, n, gone, _, _ in plain.plain_bytes(rows[3])}
    # Cuts inside a code point lose its rest.
    assert all(want[r[0]] - 3 * 40 <= len(r[1].encode()) <= want[r[0]] for r in rows[4])
    assert all(r[4] == len(r[1]) for r in rows[4] if want[r[0]] < dict((x[0], len(x[1].encode())) for x in rows[3])[r[0]])
    plain.packed_whole(inputs[5], rows[4], packing.CAPACITY)


def test_run_is_the_stages_in_order(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and {"doc_id", "shard", "bin", "offset", "length"} <= set(out.columns)
