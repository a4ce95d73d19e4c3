"""Quality rules in the pipeline and on odd line ends."""

from __future__ import annotations

import corpus_pipeline
import numpy as np
import pyarrow as pa
import test_text_ops as plain
from lossledger.llm import quality_classifier, quality_rules
from lossledger.llm.common import table
from lossledger.llm.features import text_features

SF = "/root/testdata/sf0.001"


def test_a_document_has_one_verdict_in_the_pipeline_and_alone(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    alone = {r.doc_id for r in quality_rules.quality_rules(docs, labels).where("kept").collect()}
    survivors = corpus_pipeline.quality_stage(spark, docs, SF)
    left = {r.doc_id for r in survivors.collect()}
    staged = {r.doc_id for r in corpus_pipeline.rules_stage(spark, survivors, SF).collect()}
    assert staged == left & alone


def test_lines_of_a_text_do_not_depend_on_the_texts_before_it():
    texts = ["ab", "\nx\nx", "", "\n", None, "\n\ny\n\ny\ny", "z\n", "\nz\nz\n", "\n\n", "", "a b\nc\na b"]
    want = [plain.plain_counts(t)[3] for t in texts]
    assert want == [0, 1, 0, 0, 0, 2, 0, 1, 0, 0, 1]
    assert quality_rules.rule_counts(pa.array(texts))["n_dup_lines"].tolist() == want
    assert [int(quality_rules.rule_counts(pa.array([t], pa.string()))["n_dup_lines"][0]) for t in texts] == want


def test_leading_directions_hold_as_much_as_the_exact_ones():
    rnd = np.random.default_rng(3)
    for rows, columns in ((300, 120), (20, 90), (1, 5)):
        x = (rnd.standard_normal((rows, columns)) * np.geomspace(1, 0.05, columns)).astype(np.float32)
        got = quality_classifier.leading_directions(x, 48)
        kept = min(48, columns)
        assert got.shape == (columns, kept) and np.allclose(got.T @ got, np.eye(kept), atol=1e-4)
        exact = np.sort(np.linalg.svd(x.astype(np.float64), compute_uv=False))[::-1][:kept]
        assert np.square(x @ got).sum() > 0.99999 * np.square(exact).sum()


def test_vote_is_the_plain_one(spark):
    """Scores against a loop over all labelled vectors, one text at a time."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = quality_classifier.fit(docs, labels)
    texts = [r.text for r in docs.orderBy("doc_id").limit(60).collect()] + ["", None, "a", "!!! ### !!!"]
    got = model.scores(pa.array(texts, pa.string()))
    mine = model.project(text_features(pa.array(texts, pa.string()), quality_classifier.DIMS, with_shapes=True))
    nearness = mine @ model.vectors.T
    for vector, near, score in zip(mine.tolist(), nearness, got.tolist(), strict=True):
        # The cosines by plain sums; the vote on them as rounded, since copies tie at the last place.
        plainly = [sum(a * b for a, b in zip(vector, v, strict=True)) for v in model.vectors.tolist()]
        assert max(abs(a - b) for a, b in zip(plainly, near.tolist(), strict=True)) < 1e-5
        rounded = [round(s, 6) for s in near.astype(float).tolist()]
        edge = sorted(rounded, reverse=True)[quality_classifier.NEIGHBOURS - 1]
        votes = [(max(s, 0.0), y) for s, y in zip(rounded, model.labels.tolist(), strict=True) if s >= edge]
        total = sum(s for s, _ in votes)
        want = sum(s * y for s, y in votes) / total if total > 1e-9 else model.prior
        assert abs(score - want) < 1e-9
