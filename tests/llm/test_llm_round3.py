"""The prefix trie, importance resampling and licence scans against brute force, with their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from harborscan.llm import license_scan, prefix_trie, resampling
from harborscan.llm.common import table


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Prefix trie.


def naive_trie(rows):
    """Nodes by the definition. rows: conv_id, turn, role, text; turns of one conversation differ or repeat as a whole."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = Counter(n[:-1] for n in members if n)
    leaves, saved = Counter(), Counter()
    for n, m in members.items():
        for d in range(len(n) + 1):
            saved[n[:d]] += (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0
            leaves[n[:d]] += children[n] == 0
    out = []
    for n, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(n))
        out.append((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), children[n], leaves[n], saved[n], sha(ends)))
    return sorted(out, key=str)


def conversations(seed, n, longest=6):
    rng, rows = random.Random(seed), []
    said = ["", "a b", "hello  there you", "x\ty\nz", "été où"]
    for c in rng.sample(range(3 * n), n):
        for turn in range(rng.randint(1, longest)):
            rows.append((c, None if turn == 0 and rng.random() < 0.2 else turn, rng.choice(["user", "system", None]), rng.choice([*said, None])))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def nodes_of(spark, rows, width=None, parts=3):
    df = spark.createDataFrame([(*r, "k", 7) for r in rows], SCHEMA + ", part string, depth int").repartition(parts)
    return sorted((tuple(r[c] for c in COLUMNS) for r in prefix_trie.trie(df, width).collect()), key=str)


@pytest.mark.parametrize("width", [None, 32])
def test_trie_against_brute_force(spark, width, monkeypatch):
    """The narrow sketch proves almost nothing: the exact groups then give the same nodes."""
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    rows = conversations(5, 120) + [(None, 1, "user", "lost"), (7, 0, "user", "same")] * 2
    rows += [(1000 + c, t, "user", f"copy {t}") for c in range(40) for t in range(3)]
    assert nodes_of(spark, rows, width) == naive_trie(rows)


def test_trie_of_one_long_conversation(spark):
    """A conversation that is nearly all of the rows is dealt to several ranges; its sums go on from range to range."""
    rows = [(21, t, "user", f"w {t % 3}") for t in range(700)] + [(41, t, "user", f"w {t % 3}") for t in range(650)] + conversations(6, 10)
    assert nodes_of(spark, rows) == naive_trie(rows)


def test_trie_of_little(spark):
    assert nodes_of(spark, []) == [] == nodes_of(spark, [(None, 0, "user", "x")])
    short = next(c for c in range(21, 400) if zlib.crc32(str(c).encode()) % 4 == 3 and c % 20)
    rows = [(short, 0, None, None)]
    assert nodes_of(spark, rows) == naive_trie(rows) == [(short, 0, None, 1, 0, 1, 0, sha(str(short)))]


def test_trie_query_against_brute_force(spark, small):
    rows = [tuple(r) for r in table(spark, small, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = prefix_trie.trie(table(spark, small, "conversations"))
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=str) == naive_trie(rows)


# Importance resampling.

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def naive_features(text):
    w = WORD.findall((text or "").translate(FOLD))
    return w, [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def naive_resampling(docs, target, percent=5):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = Counter(), Counter()
    cut = [(i, *naive_features(x)) for i, x in docs]
    for _, _, fs in cut:
        s.update(map(bucket, fs))
    for x in target:
        t.update(map(bucket, naive_features(x)[1]))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000))))
    rows = []
    for i, w, fs in cut:
        weight = sum(gain(bucket(f)) for f in fs)
        h = int(sha(f"42:{'' if i is None else i}")[:8], 16)
        rows.append([i, len(w), len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    long = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2], r[3]))
    drawn = len(long) * percent // 100
    return sorted([(*r, k + 1 if k < drawn else None) for k, r in enumerate(long)] + [(*r, None) for r in rows if r[1] < 20], key=str)


def resampled(spark, docs, target, **options):
    df = spark.createDataFrame([(t, i, "r", 1.5) for i, t in docs], "text string, doc_id long, rank string, part double").repartition(3)
    to = spark.createDataFrame([(None, t) for t in target], "item_id long, text string")
    return sorted((tuple(r) for r in resampling.resampled(df, to, **options).select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()), key=str)


def test_resampling_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(resampling, "PIECE", 64)
    rng = random.Random(2)
    word = lambda: rng.choice(["The", "été", "漢字", "x" * 300, "a1", "É", "of", "sea", "𝄞b"])
    texts = ["".join(word() + rng.choice([" ", "  ", "\n", "-", "\x7f, "]) for _ in range(rng.randint(0, 60))) for _ in range(120)]
    docs = list(enumerate(texts)) + [(3, texts[3]), (3, texts[4]), (None, texts[5]), (None, None), (500, None), (501, " \n"), (502, "-one"), (503, "y" * 5000)]
    target = [texts[7], texts[8] + " sea of", None, ""]
    assert resampled(spark, docs, target, percent=30) == naive_resampling(docs, target, 30)
    assert resampled(spark, docs, [], percent=30) == naive_resampling(docs, [], 30)
    assert resampled(spark, [], target) == []


def test_resampling_of_a_long_text(spark):
    text = "Word " * 200_000 + "z" * 100_000
    assert resampled(spark, [(1, text)], ["word word"]) == naive_resampling([(1, text)], ["word word"])


def test_resampling_query_and_draw(spark, small):
    docs, target = table(spark, small, "documents"), table(spark, small, "benchmark")
    got = sorted((tuple(r) for r in resampling.resampled(docs, target).select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()), key=str)
    want = naive_resampling([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()])
    assert got == want
    drawn = resampling.drawn_documents(docs, target)
    assert drawn.columns == docs.columns and sorted(r.doc_id for r in drawn.collect()) == sorted(r[0] for r in want if r[5])


# Licence scans.


def naive_base(text):
    w = WORD.findall((text or "").translate(FOLD))
    places = [(i, label) for p, label in license_scan.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def scanned(spark, docs):
    df = spark.createDataFrame([(i, t, "l", 2) for i, t in docs], "doc_id long, text string, labels string, score int").repartition(2)
    return license_scan.licensed(df).collect()


def test_license_base_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(license_scan, "PIECE", 50)
    rng = random.Random(4)
    parts = ["CC", "by", "cc by", "General Public License", "ALL rights", "reserved", "all\nrights-reserved.", "é", "x", "general", "public"]
    texts = [rng.choice([" ", "\n", "--"]).join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(200)]
    docs = list(enumerate([*texts, None, "", " .", "CC BY CC BY cc-by", "ccby", "cc byte"])) + [(None, "cc by"), (1, texts[1]), (1, texts[1])]
    got = sorted((str(r.doc_id), r.n_words, r.n_base, str(r.first_word), str(r.last_word), r.base_labels) for r in scanned(spark, docs))
    want = sorted((str(i), n, k, str(a), str(b), labels) for i, (n, k, a, b, labels) in ((i, naive_base(t)) for i, t in docs))
    assert got == want
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) for r in scanned(spark, docs))


FILLER = "some words that belong to the file itself and to no notice "


def test_every_notice_is_found_where_it_stands(spark):
    docs = [(i, FILLER * 3 + text + " " + FILLER) for i, (_, text, _) in enumerate(license_scan.NOTICES)]
    for r in scanned(spark, docs):
        label, text, _ = license_scan.NOTICES[r.doc_id]
        own = [n for n in r.notices if n.label == label and n.first == 36]
        assert own and max(n.score for n in own) == pytest.approx(1.0), label
        assert label in r.labels.split(",") and r.score == pytest.approx(1.0)


def test_notices_with_words_between_and_without_key_phrases(spark):
    label, text, _ = license_scan.NOTICES[0]
    broken = text.replace("associated", "the associated").replace("the rights", "any and all of the rights")
    scattered = " ".join(w + " " + FILLER for w in text.split())
    no_phrase = text.replace("free of charge", "for a fee")
    far = "Apache " + FILLER * 5 + "License, Version 2.0"
    got = {r.doc_id: r for r in scanned(spark, [(0, broken), (1, scattered), (2, no_phrase), (3, far), (4, FILLER * 50), (5, text + FILLER * 9 + text)])}
    assert got[0].labels == "mit" and [n.first <= 3 for n in got[0].notices] == [True]
    assert got[1].labels == got[2].labels == got[3].labels == got[4].labels == "" and got[4].score == 0
    assert [n.first for n in got[5].notices if n.label == "mit"] == [0, len(WORD.findall(text + FILLER * 9))]


def test_one_licence_of_several_words_alike(spark):
    line = "This work is licensed under the GNU General Public License, version {}."
    got = {r.doc_id: r.labels for r in scanned(spark, [(2, line.format(2)), (3, line.format(3)), (4, "Licensed under CC BY-NC 4.0."), (5, "All rights reserved."), (6, "Released under the MIT License.")])}
    assert got == {2: "gpl,gpl-2.0", 3: "gpl,gpl-3.0", 4: "cc-by,cc-by-nc-4.0", 5: "reserved", 6: "mit"}


def test_license_of_a_long_text(spark):
    text = FILLER * 100_000 + license_scan.NOTICES[4][1] + " all rights reserved"
    (r,) = scanned(spark, [(1, text)])
    assert r.base_labels == "reserved" and r.labels == "bsd,reserved" and r.n_words == len(text.replace("/", " ").split())
