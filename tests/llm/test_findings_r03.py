"""What the reviewer of round 3 found in the corpus operators."""

import numpy as np

from vistaspark.llm import chaining, anisotropic


def test_neighbours_in_a_crowd_closer_than_the_codes_tell(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 64))
    crowd = rng.random(len(x)) < 0.5
    x[crowd] = rng.normal(size=64) * 3 + 1e-4 * rng.normal(size=(crowd.sum(), 64))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found: dict[int, set] = {}
    for r in anisotropic.nearest_neighbours(vectors, vectors.filter("vec_id % 50 = 0")).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    units, hits = x / np.linalg.norm(x, axis=1, keepdims=True), 0
    for q in range(0, len(x), 50):
        score = units @ units[q]
        score[q] = -np.inf
        hits += len(found[q] & set(np.argsort(-score, kind="stable")[:5].tolist()))
    assert hits >= 0.97 * 5 * (len(x) // 50)


def test_two_texts_share_a_passage_of_which_others_hold_less(spark):
    """every seed of the passage has first holders and neighbours that hold too little of it."""
    word = iter(f"w{i}" for i in range(1_000_000))
    some = lambda n: [next(word) for _ in range(n)]
    passage = some(60)
    rows = [(i, " ".join(some(30) + passage + some(30))) for i in range(2)]
    for start in range(0, 60, 10):
        rows += [(100 + len(rows) + i, " ".join(some(20) + passage[start : start + 20] + some(20))) for i in range(30)]
    found = chaining.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["other_id"]) for r in found} == {(0, 1), (1, 0)}
    assert all(r["end_word"] - r["start_word"] >= 60 for r in found)


def test_holders_of_a_passage_meet_in_blocks(spark, monkeypatch):
    """the pairs of two kinds of holders are the same, however the places of a seed are dealt."""
    word = iter(f"v{i}" for i in range(1_000_000))
    some = lambda n: [next(word) for _ in range(n)]
    passage = some(80)
    rows = [(i, " ".join(some(9) + passage[:42] + some(9))) for i in range(40)]
    rows += [(40 + i, " ".join(some(9) + passage + some(9))) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = set(chaining.repeated_passages(docs).collect())
    linked = {r["doc_id"] for r in whole}
    assert linked == set(range(40, 46))
    monkeypatch.setattr(chaining, "MEETING", 3)
    assert set(chaining.repeated_passages(docs).collect()) == whole
