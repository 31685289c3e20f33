"""Candidates of the n-gram join by the places of common tokens, and what the driver keeps of a job of many tables."""

import numpy as np

from harborscan.llm import common, ngram_join


def test_partnered_against_all_pairs():
    rng = np.random.default_rng(3)
    for _ in range(300):
        k = int(rng.integers(1, 14))
        meta = np.column_stack([np.arange(k), rng.integers(1, 60, k), rng.integers(0, 251, k)]).astype(np.int64)
        w, r = ngram_join.reaches(meta)
        naive = [any(a != b and w[a] <= r[b] and w[b] <= r[a] for b in range(k)) for a in range(k)]
        assert ngram_join.partnered(w, r).tolist() == naive


def test_similar_sets_are_candidates_and_late_tokens_make_none():
    """Postings of sets that share 3/4 or more always give their pair; one common token behind the first seventh gives none."""
    rng = np.random.default_rng(5)
    sketch = rng.integers(0, 4, ngram_join.SKETCH).astype(np.uint8)

    def posted(*sets):
        tokens = [ngram_join.prefix(s, sketch) for s in sets]
        meta = [np.column_stack([np.full(len(t), k), np.full(len(t), len(s)), ngram_join.places(len(s))]) for k, (s, t) in enumerate(zip(sets, tokens, strict=True))]
        return np.concatenate(tokens), np.concatenate(meta).astype(np.int64)

    for _ in range(400):
        n = int(rng.integers(1, 200))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        cut, more = rng.permutation(a)[rng.integers(0, n // 5 + 1) :], rng.integers(0, 2**63, rng.integers(0, n // 5 + 1)).astype(np.uint64)
        b = np.unique(np.concatenate([cut, more]))
        common_tokens = len(np.intersect1d(a, b))
        for small in (8, 1):
            pairs, _ = ngram_join._lists_of(*posted(a, b), small)
            if 4 * common_tokens >= 3 * (len(a) + len(b) - common_tokens):
                assert {frozenset(p) for p in pairs.tolist()} == {frozenset((0, 1))}

    meta = np.array([[1, 100, 200], [2, 100, 10]], np.int64)
    assert not len(ngram_join._lists_of(np.zeros(2, np.uint64), meta, 8)[0])
    assert not len(ngram_join._lists_of(np.zeros(2, np.uint64), meta, 1)[0])


def test_plans_are_released_with_each_table(spark, tmp_path, monkeypatch):
    released = []
    monkeypatch.setattr(common, "release", released.append)
    monkeypatch.setattr(common, "scratch", lambda spark, what: str(tmp_path / what))
    tables = common.Tables(spark)
    assert tables.put("some", spark.range(3)).count() == 3
    assert released == [spark]
