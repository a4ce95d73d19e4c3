"""Learned partitions on rows that the router did not learn from."""

from __future__ import annotations

import numpy as np
from lossledger.llm import learned_partitions


def test_recall_on_unseen_rows():
    x = np.random.default_rng(5).standard_normal((16_384, 16))
    router = learned_partitions.fit(x[:2048], len(x))
    assert router.parts == 16
    asked = np.arange(2048, len(x), 28)
    truth = learned_partitions.neighbours(x[asked], x, 20, asked)
    place = np.argsort(router.order(x[asked]), axis=1)
    when = np.take_along_axis(place, router.order(x)[:, 0][truth], axis=1)
    assert (when < router.visits).mean() >= learned_partitions.TARGET


def test_queries_with_few_results_visit_the_other_parts(spark, monkeypatch):
    x = np.random.default_rng(6).standard_normal((300, 4))
    x[:, 0] = np.where(np.arange(300) % 60 == 0, 1.0, -1.0)  # five rows in a part of their own
    router = learned_partitions.Router(np.eye(4)[:, :1], np.zeros(1), np.array([[1.0, -1.0]]), np.array([-0.01, 0.0]), 1)
    monkeypatch.setattr(learned_partitions, "fit", lambda *_: router)
    rows = [(i, [float(v) for v in x[i]], 1) for i in range(300)]
    got = {}
    for r in learned_partitions.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert all([n for n, _ in sorted(found)] == list(range(1, 21)) for found in got.values()) and len(got) == 15
    s = x @ x[60]
    assert [i for _, i in sorted(got[60])] == [i for i in np.argsort(-s) if i != 60][:20]
