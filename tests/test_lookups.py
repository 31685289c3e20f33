"""Lookups in stages against a walk over the batches."""

import datetime
import random

import pytest

from harborscan.operators import lookups

KEYS = "ecosystem string, name string, version string"
NOW = "2024-01-03 00:00:00"


def walked(pending, answers, p):
    """state, incomplete and fetched advisories of each pending key, and requests used."""
    seen, out, batches, details, ended = set(), {}, 0, 0, False
    for i in range(0, len(pending), p["batch_size"]):
        part = pending[i : i + p["batch_size"]]
        if ended or batches >= p["batch_requests"] or batches + details >= p["total_requests"]:
            ended = True
            out |= {k: ("NO_DATA", False, ()) for k in part}
            continue
        batches += 1
        if any(answers.get(k, ((), False))[1] for k in part):
            out |= {k: ("QUERY_FAILED", False, ()) for k in part}
            continue
        for a in sorted({a for k in part for a in answers.get(k, ((), False))[0]} - seen):
            if details >= p["detail_requests"] or batches + details >= p["total_requests"]:
                ended = True
                break
            seen.add(a)
            details += 1
        for k in part:
            ids = set(answers.get(k, ((), False))[0])
            out[k] = ("MATCHED" if ids else "NO_MATCH", not ids <= seen, tuple(sorted(ids & seen)))
    return out, (batches, details, batches + details, ended)


@pytest.mark.parametrize("limits", [(4, 10, 50, 60), (4, 3, 50, 60), (4, 10, 7, 60), (4, 10, 50, 9), (3, 2, 1, 3), (50, 1, 0, 1)])
def test_states_and_requests(spark, limits):
    rng, p = random.Random(sum(limits)), dict(zip(("batch_size", "batch_requests", "detail_requests", "total_requests"), limits))
    keys = [(rng.choice(["PyPI", "npm", "Maven"]), f"n{i}", "1") for i in range(40)]
    cached = {k: (rng.randint(0, 40), rng.choice(["MATCHED", "NO_MATCH"])) for k in keys if rng.random() < 0.4}
    answers = {k: (tuple(f"A{rng.randint(0, 20)}" for _ in range(rng.randint(0, 3))), rng.random() < 0.03) for k in keys if rng.random() < 0.9}
    at = datetime.datetime(2024, 1, 3)
    cache = spark.createDataFrame([(*k, at - datetime.timedelta(hours=h), s) for k, (h, s) in cached.items()], KEYS + ", fetched_at timestamp, status string")
    df = spark.createDataFrame(keys + keys[:3], KEYS)
    first = lookups.staged(df, cache, NOW, 86400)
    want = {k: "UNSUPPORTED_ECOSYSTEM" if k[0] == "Maven" else cached[k][1] if k in cached and cached[k][0] <= 24 else "PENDING" for k in keys}
    assert {(r.ecosystem, r.name, r.version): r.state for r in first.collect()} == want
    offline = {k: want[k] if want[k] != "PENDING" else "STALE_" + cached[k][1] if k in cached else "OFFLINE_NO_CACHE" for k in keys}
    assert {(r.ecosystem, r.name, r.version): r.state for r in lookups.staged(df, cache, NOW, 86400, True).collect()} == offline
    told = spark.createDataFrame([(*k, list(ids), e) for k, (ids, e) in answers.items()], KEYS + ", advisory_ids array<string>, error boolean")
    rows, used = walked(sorted(k for k in keys if want[k] == "PENDING"), answers, p)
    got = lookups.answered(first, told, **p)
    assert {(r.ecosystem, r.name, r.version): (r.state, r.incomplete, tuple(r.advisory_ids)) for r in got.where("batch IS NOT NULL").collect()} == rows
    assert tuple(lookups.requests(first, told, **p).first()) == used
    kept = {(r.ecosystem, r.name, r.version): r.status for r in lookups.retained(cache, got, NOW).collect()}
    assert kept == {k: s for k, (_, s) in cached.items()} | {k: s for k, (s, cut, _) in rows.items() if s in ("MATCHED", "NO_MATCH") and not cut}
