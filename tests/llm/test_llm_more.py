"""Edge cases of the training-data operators: nulls, repeated rows, clashing columns, empty tables, long texts, ties."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from harborscan.llm import byte_bpe, decontamination, ngram_join, revisits, toxicity
from harborscan.llm.common import table


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def naive_components(rows):
    """component of each row by the definition, over all pairs."""
    sets = [ngram_join.shingles(t.encode() if t else None) for _, t in rows]
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                group[top(i)] = top(j)
    out = []
    for i in range(len(rows)):
        ids = [rows[j][0] for j in range(len(rows)) if top(j) == top(i) and rows[j][0] is not None]
        out.append((rows[i][0], len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def copies():
    """Texts with exact and near copies, long ones, null and repeated doc_ids, and a passage that many share."""
    rng = random.Random(11)
    passage, rows = words(rng, 30), []
    for g in range(25):
        base = words(rng, rng.choice([4, 6, 40, 200, 1500])).split()
        for k in range(rng.choice([1, 2, 3, 14])):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                t[rng.randrange(len(t))] = rng.choice(["x", "y", "zz"])
            rows.append((None if rng.random() < 0.15 else rng.randrange(60), " ".join(t)))
        rows.append((1000 + g, words(rng, 20) + " " + passage))
    return [*rows, (5, None), (6, ""), (7, " \n "), (None, None), (8, "One two three"), (9, "one  TWO three")]


def test_ngram_join_against_all_pairs(spark, copies):
    df = spark.createDataFrame([(i, t, "n", "b") for i, t in copies], "doc_id long, text string, node string, hub string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_components(df).collect()), key=str)
    assert got == naive_components(copies)


def test_ngram_join_of_long_lists(spark, monkeypatch):
    """Near copies in one chain: every two neighbours are similar, the ends are not; lists are long and need several rounds."""
    rng = random.Random(3)
    base, rows = words(rng, 120).split(), []
    for k in range(60):
        base[(2 * k) % 120] = f"w{k}"
        rows.append((k, " ".join(base)))
    monkeypatch.setattr(ngram_join, "LIST_SHARE", 7)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_components(df).collect()) == sorted(naive_components(rows))


def test_signatures_are_bounds():
    rng = np.random.default_rng(2)
    for n, m in ((3, 5), (300, 310), (2000, 900), (6000, 5900)):
        common = rng.integers(0, 2**63, min(n, m) - 2).astype(np.uint64)
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 2**63, k - len(common)).astype(np.uint64)])) for k in (n, m))
        assert ngram_join.differing(ngram_join.signature(a), ngram_join.signature(b)) <= len(np.setxor1d(a, b))


def test_similar_sets_share_every_prefix():
    rng = np.random.default_rng(4)
    for _ in range(200):
        n = int(rng.integers(4, 400))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: int(len(a) * 0.88)], rng.integers(0, 2**63, n // 12).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 75 * (len(a) + len(b) - both):
            assert ngram_join.share_all_orders(ngram_join.further_prefixes(a), ngram_join.further_prefixes(b))


def test_ngram_join_of_nothing(spark):
    assert ngram_join.ngram_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.fixture(scope="module")
def tiktoken_own():
    import tiktoken

    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_odd_texts(spark, tiktoken_own):
    ranks, enc = tiktoken_own
    rng = random.Random(9)
    texts = ["", "a", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "日本語のテキスト", "\x00\x01\x00", "x​y", "é" * 40, "😀😀😀", " \n\n  \t ", "'s 't DON'T", "qzxj" * 30, "".join(rng.choice("abcdefghijklmnopqrstuvwxyzäéß") for _ in range(300))]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x250), rng.randrange(0x4E00, 0x4F00)])) for _ in range(50)) for _ in range(30)]
    rows = [*enumerate(texts), (3, "again"), (None, "no id"), (None, None)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, words string, ends int")
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.tokens(df, ranks, public_tokenizers.PATTERN).collect()), key=str)
    want = []
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_byte_bpe_without_frequent_words(spark, tiktoken_own, monkeypatch):
    ranks, enc = tiktoken_own
    monkeypatch.setattr(byte_bpe, "FREQUENT_WORDS", 1)
    df = spark.createDataFrame([(1, "some words, some words, and others"), (2, "words")], "doc_id long, text string")
    assert {r.doc_id: list(r.ids) for r in byte_bpe.encode(df, ranks, public_tokenizers.PATTERN).collect()} == {1: enc.encode_ordinary("some words, some words, and others"), 2: enc.encode_ordinary("words")}


def test_byte_bpe_large_vocabularies_are_refused():
    with pytest.raises(ValueError):
        byte_bpe.pair_table({bytes([b]): b for b in range(256)} | {b"ab": 1 << 17})


def test_decontamination_in_blocks(spark):
    """Several blocks of items, repeated and null ids, short items: equal to a scan of all windows."""
    rng = random.Random(5)
    items = [(k % 40, words(rng, rng.choice([1, 4, 10, 25]))) for k in range(60)] + [(None, "a b c"), (7, None), (8, "  ")]
    docs = [(d if d % 9 else None, words(rng, 10) + " " + (rng.choice(items)[1] or "") + " " + words(rng, 5)) for d in range(80)] + [(3, None), (3, "")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")

    def naive(text):
        w, hit, found = decontamination.words(text.encode() if text else None), set(), set()
        for item, t in items:
            v = decontamination.words(t.encode()) if t and item is not None else []
            m = min(10, len(v))
            for s in range(len(v) - m + 1 if m else 0):
                for i in range(len(w) - m + 1):
                    if w[i : i + m] == v[s : s + m]:
                        hit.update(range(i, i + m))
                        found.add(item)
        return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)

    want = sorted(((i, *naive(t)) for i, t in docs), key=str)
    for size in (1 << 20, 600):
        rows = decontamination.contamination(d, b, block_bytes=size).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows), key=str) == want


def test_revisits_of_odd_urls(spark):
    from pyspark.sql import functions as F

    urls = {"HTTP://WWW.Ex.org:80/A/../b/./c/?b=2&utm_source=x&A=1#f": "ex.org/b/c?A=1&b=2", "https://ex.org:443": "ex.org", "http://ex.org/p?ref=1&id=5": "ex.org/p?id=5", "http://ex.org/P?q=A": "ex.org/P?q=A", "http://ex.org:8080/": "ex.org:8080", None: None}
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(revisits.canonical(F.col("u"))).collect()] == list(urls.values())
    log = spark.createDataFrame([(None, "a", 5, True), (1, "a", 1, False), (2, "a", 10**12, False), (3, None, 4, True)], "page_id long, canonical string, time long, revisit boolean")
    log = log.withColumns({f: F.lit(7 if f == "modified" else None).cast("long" if f in ("modified", "content_length") else "string") for f in revisits.FIELDS})
    assert {(r.page_id, r.response_id, r.status) for r in revisits.resolved(log).collect()} == {(None, 1, "resolved"), (3, None, "no_earlier_response")}


def test_toxicity_kernel_against_definition():
    """The kernel of words by tables equals the sum over all subsequences by definition."""
    from itertools import combinations

    def naive(a, b):
        def features(w):
            w, out = "." + w, {}
            for k, reach in ((3, 4), (4, 5)):
                for i in range(len(w)):
                    for rest in combinations(range(1, reach + 1), k - 1):
                        if i + rest[-1] < len(w):
                            key = "".join(w[i + o] for o in (0, *rest))
                            weight = toxicity.DECAY ** (rest[-1] - k + 1)
                            out.setdefault("all", []).append(weight * weight)
                            if "." not in key:
                                out[key] = out.get(key, 0.0) + weight
            norm = np.sqrt(max(sum(out.pop("all", [0.0])), 1e-9))
            return {k: v / norm for k, v in out.items()}

        x, y = features(a), features(b)
        return sum(v * y.get(k, 0.0) for k, v in x.items())

    names = ["grubber", "grub", "g.r.u.b", "other", "abc", "grxubber"]
    got = toxicity._kernel(names, names)
    assert all(abs(got[i][j] - naive(a, b)) < 1e-9 for i, a in enumerate(names) for j, b in enumerate(names))


def test_toxicity_rows(spark):
    rng = random.Random(8)
    docs = [(i, words(rng, 30) + (" zuckerwort " if i % 2 else "")) for i in range(300)]
    d = spark.createDataFrame([(i, t, i % 2) for i, t in docs] + [(1, None, 0), (None, "zuckerwort zuckerwort", 0), (2, "", 1), (2, "x" * 5000, 1)], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in docs] + [(None, 1), (4, None)], "doc_id long, toxic int")
    rows = toxicity.toxicity(d, labels).collect()
    assert len(rows) == 304 and all(0 <= r.score <= 1 for r in rows)
    assert [r.predicted for r in rows if r.doc_id is None] == [1] and {r.predicted for r in rows if r.doc_id is not None and r.doc_id % 2} <= {0, 1}
    assert sum(r.predicted == r.doc_id % 2 for r in rows if r.doc_id is not None) >= 295


def test_pipeline_runs(spark, small):
    """run() is the stages one after another, each on what the one before kept."""
    rows = corpus_pipeline.run(spark, small).collect()
    docs = table(spark, small, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small)
    kept = {r.doc_id for r in docs.select("doc_id").collect()}
    assert {r.doc_id for r in rows} == kept and 0 < len(rows) < table(spark, small, "documents").count()


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_pipeline_stages_take_empty_tables(spark, small, k):
    docs = table(spark, small, "documents")
    got = corpus_pipeline.STAGES[k][1](spark, docs.limit(0), small)
    assert got.count() == 0 and (k == len(corpus_pipeline.STAGES) - 1 or got.columns == docs.columns)


def test_one_of_each_rows_without_and_with_repeated_ids(spark):
    """Equal rows of one doc_id are one; rows without a doc_id go beside a copy that has one, else one of them stays."""
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(1, text(1)), (1, text(1)), (2, text(1)), (None, text(1)), (None, text(2)), (None, text(2)), (3, text(3)), (3, text(4)), (4, ""), (4, None), (4, ""), (None, ""), (None, None), (5, text(5))]
    docs = spark.createDataFrame([(d, t, n, "x") for n, (d, t) in enumerate(rows)], "doc_id int, text string, bucket int, `extra` string")
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(1, text(1)), (None, text(2)), (3, text(3)), (3, text(4)), (4, ""), (4, None), (None, ""), (None, None), (5, text(5))], key=str)


def test_ngram_scratch_tables_go_with_their_phase(spark, tmp_path, monkeypatch):
    """Of a run's tables only those that its result reads are left."""
    from harborscan.llm import common

    monkeypatch.setattr(common, "scratch", lambda spark, what: str(tmp_path / f"{what}-{len(list(tmp_path.iterdir()))}-{random.random()}"))
    docs = spark.createDataFrame([(i, " ".join(f"g{i // 12}w{j + (i % 3)}" for j in range(60))) for i in range(60)], "doc_id long, text string")
    rows = ngram_join.ngram_components(docs)
    left = {p.name.split("-")[0].rstrip("0123456789") for p in tmp_path.iterdir() if p.is_dir()}
    assert left == {"members", "stars"}  # all documents, and the last round of components
    assert {r.component_id for r in rows.collect()} == {0, 12, 24, 36, 48}
