"""Each operator against a brute-force version, on small tables with the defined edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from harborscan.llm import byte_bpe, decontamination, html_text, ngram_join, quality_rules, revisits, secret_scan, token_counts, token_store, toxicity

SCHEMA = "doc_id long, text string, lang string, n_words string, node string"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(300)]
    out = [" ".join(rng.choices(words, k=rng.randint(1, 150))) + rng.choice(["", "\n", ".\nEnd"]) for _ in range(60)]
    base = " ".join(rng.choices(words, k=120))
    for _ in range(25):  # near copies
        w = base.split()
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append(" ".join(w))
    passage = " ".join(rng.choices(words, k=60))
    out += [passage + " " + " ".join(rng.choices(words, k=rng.randint(5, 40))) for _ in range(15)]
    return out + [base, base, base.upper(), "a b c", "a b c", "", "   ", "one", "x" * 3000, " ".join(words * 40)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en" if i % 3 else None, "clash", "clash") for i, t in enumerate(texts)] + [(9999, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_decontamination(spark, docs, texts, empty):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    items = [(1, " ".join(texts[0].split()[:30])), (2, texts[85]), (3, "one"), (10, "a-b.c"), (4, None), (None, texts[1]), (5, "  "), (2, texts[3])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for item, t in items:
        w = split(t)
        if item is None or not w:
            continue
        for i in range(max(1, len(w) - 9)):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(item)
    for size in (1 << 20, 64):  # one block of items, and many
        got = {r.doc_id: r for r in decontamination.contamination(docs, bench, block_bytes=size).collect()}
        assert len(got) == len(texts) + 1
        for i, t in [*enumerate(texts), (9999, None)]:
            w, hit, owners = split(t), set(), set()
            for n in {len(x) for x in windows}:
                for k in range(len(w) - n + 1):
                    if (p := tuple(w[k : k + n])) in windows:
                        hit |= set(range(k, k + n))
                        owners |= windows[p]
            digest = hashlib.sha256(",".join(sorted(map(str, owners))).encode()).hexdigest()
            assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].items_sha256, got[i].contaminated) == (len(w), len(hit), len(owners), digest, bool(hit))
    assert decontamination.contamination(empty, bench).count() == 0
    assert decontamination.contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    clean = decontamination.clean_documents(docs, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {i for i, r in got.items() if not r.contaminated}


def test_quality_statistics(spark, docs, texts, empty):
    got = {r.doc_id: r for r in quality_rules.statistics(docs).collect()}
    for i, t in [*enumerate(texts), (9999, "")]:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        rep = {k + d for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for d in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep))
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (None, 1), (3, None), (777, 1)], "doc_id long, quality int")
    out = quality_rules.quality(docs, labels)
    assert out.count() == len(texts) + 1 and out.where("kept AND base_failed").count() == 0
    assert quality_rules.quality(empty, labels).count() == 0


def test_exact_binomial(spark):
    from math import comb

    from pyspark.sql import functions as F

    cases = [(0, 50), (1, 100), (3, 400), (0, 0), (40, 100)]
    df = spark.createDataFrame(cases, "k long, n long")
    for (k, n), r in zip(cases, df.select(quality_rules.binomial_tail(F.col("k"), F.col("n"), 0.02)).collect(), strict=True):
        want = sum(comb(n, j) * 0.02**j * 0.98 ** (n - j) for j in range(k + 1)) if n and k <= n * 0.02 else 1.0
        assert abs(r[0] - want) < 1e-9


def test_thresholds_limit_false_rejection(spark):
    rows = [(i, 100.0 if i % 50 == 0 else 0.1, i) for i in range(5000)]
    from pyspark.sql import functions as F

    scored = spark.createDataFrame([(i, "en", 100, 0, s) for i, s, _ in rows], "doc_id long, stratum string, n_words long, n_repeat_words long, x double")
    labels = spark.createDataFrame([(i, 1) for i, _, _ in rows], "doc_id long, quality int")
    cut = quality_rules.thresholds(scored, labels, risk=0.05, cutoffs={"x": [0.05, 1.0, 200.0]}).collect()
    assert [(r.rule, r.cutoff, r.n_rejected) for r in cut] == [("x", 1.0, 100)]


def test_thresholds_of_every_stratum(spark):
    from pyspark.sql import functions as F

    scored = spark.range(300 * 700).select("id", F.concat(F.lit("l"), (F.col("id") % 300).cast("string")).alias("stratum"), F.lit(100).alias("n_words"), F.lit(0).alias("n_repeat_words"), F.lit(0.1).alias("x")).withColumnRenamed("id", "doc_id")
    cut = quality_rules.thresholds(scored, scored.select("doc_id", F.lit(1).alias("quality")), cutoffs={"x": [0.05, 1.0]}).collect()
    assert len({r.stratum for r in cut}) == 300 and {r.cutoff for r in cut} == {1.0}


def test_token_store(spark, docs, texts, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    got = {r.doc_id: r for r in token_store.stored_tokens(docs, path).collect()}
    at = 0
    for i, t in [*enumerate(texts), (9999, "")]:
        ids = [*tok.encode(t, add_special_tokens=False).ids, 1]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_store.stored_tokens(empty, path).count() == 0


def test_token_store_odd_texts(spark):
    """Special tokens, marks, letters of other alphabets, repeated and null doc_ids: as the tokenizer gives them."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    odd = ["a<|endoftext|>.", "x <|startoftext|> Y", "it's DON'T İstanbul ΣΑΣ café é ́a Å", "a\tb c\r\nd", "(a1b2) 3.14 -- dogs' end.%%% ñÑ.", "x" * 5000]
    rows = [*enumerate(odd), (3, "again"), (None, "no id"), (None, None)]
    got = token_store.stored_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path).orderBy("start").collect()
    want = {(i, tuple([*tok.encode(t or "", add_special_tokens=False).ids, 1])) for i, t in rows}
    assert {(r.doc_id, r.n_tokens, r.ids_crc32) for r in got} == {(i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want}
    assert [r.doc_id for r in got] == [None, None, 0, 1, 2, 3, 3, 4, 5] and [r.start for r in got] == [sum(r.n_tokens for r in got[:k]) for k in range(9)]


@pytest.mark.parametrize("width", [1, 7, 8, 13, 16, 17])
def test_packing(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 1001).astype(np.uint32)
    segment = token_store.pack(ids, width, 100)
    assert (token_store.unpack(segment) == ids).all() and (token_store.unpack(segment, 99, 301) == ids[99:301]).all() and len(token_store.unpack(segment, 5, 5)) == 0
    assert len(token_store.unpack(token_store.pack(ids[:0], width))) == 0
    with pytest.raises(ValueError):
        token_store.pack(np.array([1 << width]), width)


def test_byte_bpe(spark, docs, texts, empty):
    import tiktoken

    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    pieces = byte_bpe.pieces_of(ranks)
    odd = ["it's 12 don't\t\n\n  x", "日本語テキスト", "𝒳 ñandú \u00a0 é", "aaaaaaaa abababab", "\x00\x7f"]
    extra = spark.createDataFrame([(20_000 + i, t, None, None, None) for i, t in enumerate(odd)], SCHEMA)
    rows = byte_bpe.encode(docs.unionAll(extra), ranks, public_tokenizers.PATTERN).collect()
    assert len(rows) == len(texts) + 1 + len(odd)
    for r in rows:
        text = bytes(r.text or b"")
        assert r.ids == enc.encode_ordinary(text.decode()) and byte_bpe.decode(r.ids, pieces) == text
    assert byte_bpe.tokens(empty, ranks, public_tokenizers.PATTERN).count() == 0


BASE = [re.compile(rb"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), re.compile(rb"AKIA[A-Z0-9]+"), re.compile(rb"[0-9a-f]+")]


def test_secret_scan_equals_search():
    rng, scan = random.Random(3), secret_scan.Scanner()
    parts = [b"password", b"token", b"=", b":", b" ", b'"', b"secret", b"api_key", b"AKIA", b"ABCDEF0123456789", b"0123456789abcdefabcdef01", b"a", b"Z9", b"\xc3\xa9", b"\n", b"TOKEN", b"passwd"]
    for _ in range(5000):
        d = b"".join(rng.choices(parts, k=rng.randint(1, 14)))
        want = [(m.start(), m.end(), k) for k, p in enumerate(BASE) for m in p.finditer(d) if (len(m[2]) >= 6 if k == 0 else len(m[0]) >= (20 if k == 1 else 24))]
        assert [x for x in scan.scan(d) if x[2] < 3] == sorted(want, key=lambda x: (x[0], x[2]))


def test_secrets_in_code_points_and_masks(spark, empty):
    rows = [(1, "é password = abcdef1 x"), (2, None), (3, "ghp_" + "a1B2" * 9), (4, "clean")]
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r for r in secret_scan.secrets(docs).collect()}
    assert (got[1].spans, got[1].n_assign, got[2].spans, got[3].spans) == ("assign:2:20", 1, "", "forge_token:0:40")
    masked = {r.doc_id: (r.text, r.n_chars) for r in secret_scan.masked_documents(docs).collect()}
    assert masked == {1: ("é <assign> x", 12), 2: (None, 0), 3: ("<forge_token>", 13), 4: ("clean", 5)}
    assert secret_scan.secrets(empty).count() == 0


def test_token_counts(spark, docs, texts, empty):
    scores = {"▁": -1.0, "a": -2.0, "b": -2.0, "ab": -3.0, "▁a": -2.5, "▁ab": -3.2, "cde": -4.0, "é": -5.0}

    def best(word):
        table = [(0.0, 0)] + [None] * len(word)
        for j in range(1, len(word) + 1):
            n = len(word[j - 1].encode())
            options = [(table[j - 1][0] + token_counts.UNKNOWN * n, table[j - 1][1] - n)]
            options += [(table[i][0] + scores[word[i:j]], table[i][1] - 1) for i in range(j) if word[i:j] in scores]
            table[j] = max(options)
        return -table[-1][1]

    got = {r.doc_id: r.n_tokens for r in token_counts.counted(docs, scores).collect()}
    assert got == {i: sum(best("▁" + w) for w in (t or "").split()) for i, t in [*enumerate(texts), (9999, None)]}
    assert token_counts.counted(empty, scores).count() == 0


def test_revisits(spark, empty):
    rng = random.Random(1)
    rows = [(i, rng.choice(["u", "u", "u", "v", None]), rng.randint(0, 40), rng.random() < 0.4, rng.choice(["x", "y", None]), rng.randint(0, 1), "t", 1, None) for i in range(300)]
    log = spark.createDataFrame(rows, "page_id long, canonical string, time long, revisit boolean, etag string, modified long, content_type string, content_length long, cache_control string")
    for buckets in (1, 7, 1000):
        got = {r.page_id: (r.response_id, r.status) for r in revisits.resolved(log, buckets).collect()}
        assert len(got) == sum(r[3] for r in rows)
        for r in rows:
            if r[3]:
                before = [x for x in rows if not x[3] and r[1] is not None and x[1] == r[1] and x[2] < r[2]]
                x = max(before, key=lambda x: (x[2], x[0]), default=None)
                same = x and (r[4] == x[4] if r[4] and x[4] else r[5] == x[5])
                assert got[r[0]] == (x and x[0], "no_earlier_response" if x is None else "resolved" if same else "validator_mismatch")
    assert revisits.resolved(log.limit(0)).count() == 0


PAGE = """<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><nav><ul><li><a href=a>One</a></li><li><a>Two</a></li></ul></nav>
<!-- x --><div class="ad">Buy now.</div><header>Top</header><article><h1>Title &amp; more</h1><p><b>First   block,<br>same block.<p>Second &lt;block&gt;.</p><aside>no</aside></article>
<div id="comments">Bad comment</div><form>f</form><footer>Foot</footer></body></html>"""


def test_html(spark):
    assert html_text.main_text(PAGE) == "Title & more\nFirst block, same block.\nSecond <block>."
    plain = "<body><div class='menu'><a>x</a></div><div><p>" + "A long sentence of the text, with marks. " * 5 + "</p><p>" + "More of it here, as long again. " * 5 + "</p></div><div><span>ok</span></div></body>"
    assert html_text.main_text(plain).count("\n") == 1 and "ok" not in html_text.main_text(plain)
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "v", "")], "page_id long, url string, html string")
    assert {r.page_id: r.n_chars for r in html_text.extracted(pages).collect()} == {1: len(html_text.main_text(PAGE)), 2: 0, 3: 0}


def test_html_keeps_inline_words():
    said = "The <a href=a>red</a> fox and the <a href=b>blue</a> bird met <a href=c>grey</a> cats near <a href=d>old</a> walls."
    want = "The red fox and the blue bird met grey cats near old walls."
    refs = "".join(f"<li><a href=r{k}>Source {k}</a></li>" for k in range(5))
    article = f"<body><article><p>{said}</p><p>A second paragraph, long enough.</p><ol>{refs}</ol></article></body>"
    assert html_text.main_text(article) == "\n".join([want, "A second paragraph, long enough.", *(f"Source {k}" for k in range(5))])
    long = "A long sentence of the text, with <b>bold</b>, <em>set</em> and <code>x</code> words and a <a href=z>link</a>. " * 3
    plain = f"<body><ul><li><a>One</a></li><li><a>Two</a></li><li><a>Three</a></li></ul><div><p>{said}</p><p>{long}</p></div></body>"
    assert html_text.main_text(plain) == want + "\n" + " ".join(re.sub("<[^>]*>", "", long).split())


def test_html_article_is_a_prior():
    body = "A long sentence of the body, with marks, in a plain element. " * 4
    text = " ".join(body.split())
    teaser = f"<body><div><p>{body}</p><p>{body}</p></div><article><p>Read the other one too.</p></article><div><span>ok</span></div></body>"
    assert html_text.main_text(teaser) == f"{text}\n{text}\nRead the other one too."
    main = f"<body><div><h2>Title</h2></div><main><p>{body}</p><ul><li>one</li><li>two</li></ul></main><div><span>Buy this now.</span></div></body>"
    assert html_text.main_text(main) == f"Title\n{text}\none\ntwo"


def test_toxicity_held_out(spark, empty):
    rng = random.Random(2)
    syllables = ["ta", "re", "no", "li", "sa", "mu", "ko", "de"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    rows, marks = [], []
    for i in range(900):
        toxic = i % 4 == 0
        w = [word() for _ in range(rng.randint(20, 80))]
        if toxic:
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(["grubworm", "dunceling", "vilecur", "blotfish"])
        rows.append((i, " ".join(w)))
        marks.append((i, int(toxic)))
    docs = spark.createDataFrame([*rows, (5000, None), (5001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([*marks, (None, 1), (6000, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(got) == 902 and all(0 <= r.score <= 1 for r in got.values()) and got[5000].predicted == got[5001].predicted == 0
    held = [(got[i].predicted, y) for i, y in marks if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _ in marks)
    assert sum(p == y for p, y in held) / len(held) > 0.97
    model = toxicity.fit(docs, labels)
    gaps = model.scores([b"ta re grub-worm no dunce.ling li", b"ta re no li sa"])
    assert gaps[0] > gaps[1]
    assert toxicity.toxicity(empty, labels).count() == 0
    assert all(r.score < 1e-6 for r in toxicity.toxicity(docs, labels.limit(0)).collect())


def test_toxicity_one_insult_decides_and_repeats_do_not():
    rng = random.Random(2)
    syllables = ["ta", "re", "no", "li", "sa", "mu", "ko", "de"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    clean = lambda: [word() for _ in range(rng.randint(20, 80))]
    texts = []
    for i in range(600):
        w = clean()
        if i % 4 == 0:
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(["grubworm", "dunceling", "vilecur", "blotfish"])
        texts.append((" ".join(w), int(i % 4 == 0)))
    model = toxicity.fit_texts(texts)
    score = lambda w: model.scores([" ".join(w).encode()])[0]
    for insult in ("grubworm", "vilecur", "blotfish", "grub-worm"):  # one of them only, in a long and in a short text
        assert score([*clean(), insult, *clean()]) >= toxicity.THRESHOLD
        assert score(["no", "ta", insult]) >= toxicity.THRESHOLD
    for _ in range(20):
        w = clean()
        rare = max(w, key=lambda x: model.values([x])[0])
        assert score(w) == score([*w, *[rare, rare.upper()] * 3]) < toxicity.THRESHOLD


def components_by_force(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("short", [2, 8])
def test_ngram_join(spark, docs, texts, empty, short, monkeypatch):
    monkeypatch.setattr(ngram_join, "SMALL_LIST", short)
    want = components_by_force([*enumerate(texts), (9999, None)])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(docs).collect()}
    assert got == want
    if short == 8:
        kept = ngram_join.one_of_each(docs)
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in want.values()})
        assert ngram_join.ngram_components(empty).count() == 0


def naive_ratios(page):
    """The fused ratios by their definition, on path names, each prefix summed anew."""
    import math

    names = []
    for parent, tag, _ in page.paths:
        names.append((*names[parent], tag) if parent >= 0 else ())
    blocks = {}
    for text, path, block, link in page.nodes:
        t, n = blocks.get((block, names[path]), ("", 0))
        blocks[block, names[path]] = (t + text, n + len(text.strip()) * link)
    blocks = {k: v for k, v in blocks.items() if v[0].strip()}
    out = {}
    for name in {p for _, p in blocks}:
        total = weight = 0.0
        for step in range(html_text.REACH):
            up = name[: len(name) - step]
            if step > len(name) or (step and (not up or up[-1] in ("html", "body"))):
                break
            below = [t for (_, p), (t, _) in blocks.items() if (p == name if not step else p[: len(up)] == up)]
            mean = sum(len(t.strip()) for t in below) / len(below)
            marks = sum(len(html_text._PUNCTUATION.findall(t)) for t in below) / len(below)
            total += html_text.STEP**step * math.log(mean * (1 + marks))
            weight += html_text.STEP**step
        own = [v for (_, p), v in blocks.items() if p == name]
        share = min(1.0, sum(n for _, n in own) / sum(len(t.strip()) for t, _ in own))
        prior = html_text.PRIOR if {"article", "main"} & set(name) else 1 - (1 - html_text.LINKS) * share
        out[name] = math.exp(total / weight) * prior
    return names, out


def test_html_ratios_against_definition(small):
    import random

    import pyarrow.parquet as pq

    rng = random.Random(5)
    made = ["".join(rng.choice(["<div>", "</div>", "<p>", "<ul>", "<li>", "</ul>", "<a>", "</a>", "<article>", "</article>", "<b>", "Some words, and more. ", "x ", "</p>"]) for _ in range(60)) for _ in range(60)]
    for html in [*made, *pq.read_table(f"{small}/pages.parquet").column("html").to_pylist()]:
        page = html_text.Page(html)
        got = html_text.fused_ratios(page, page.units())
        names, want = naive_ratios(page)
        assert {names[p] for p in got} == set(want) and all(abs(f - want[names[p]]) < 1e-6 * want[names[p]] for p, f in got.items())


def test_html_threshold_decides():
    text = "The real text is long, and it has sentences. It goes on, as texts do; so it is kept. " * 5
    teaser = f"<article><p>Teaser one.</p></article><div><p>{text}</p><p>{text}</p></div>"
    assert html_text.main_text(teaser).count("The real text") == 10 and "Teaser" in html_text.main_text(teaser, 0.0) and "Teaser" not in html_text.main_text(teaser)
    links = "<article><p>Some <a>four</a> words <a>in</a> running <a>text</a> with <a>links</a> inside it, really.</p><ul><li><a>one</a></li><li>two</li></ul></article><div><ul><li><a>Home</a></li><li><a>More</a></li></ul></div>"
    assert html_text.main_text(links) == "Some four words in running text with links inside it, really.\none\ntwo"
    bare = "<div><p>No article here, but a paragraph with a good length, and commas; yes.</p><h2>Head</h2><p>Another paragraph that is long enough, surely.</p></div><ul><li><a>Home</a></li><li><a>About</a></li></ul>"
    assert html_text.main_text(bare) == "No article here, but a paragraph with a good length, and commas; yes.\nHead\nAnother paragraph that is long enough, surely."


@pytest.mark.parametrize("html", ["<a '" * 8000, "<b>" * 16000 + "x", "<div>" * 16000 + "x", "<b>" * 8000 + "<p>x" * 8000, "<li><p>" * 9000])
def test_html_hostile_pages_are_quick(html):
    import time

    start = time.process_time()
    html_text.main_text(html)
    assert time.process_time() - start < 3


def test_html_tables(spark):
    rows = spark.createDataFrame([(1, "u", None, "x"), (2, "u", "", "x"), (2, "u", "", "x"), (3, None, "<article><p>A text, really.</p></article>", "x")], "page_id long, url string, html string, text string")
    got = [(r.page_id, r.url, r.text, r.n_chars) for r in html_text.extracted(rows).orderBy("page_id").collect()]
    assert got == [(1, "u", "", 0), (2, "u", "", 0), (2, "u", "", 0), (3, None, "A text, really.", 15)]
    assert html_text.extracted(rows.limit(0)).count() == 0
