"""What workers keep between tasks, and the cutting of Latin texts."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex

from harborscan.llm import byte_bpe, common, ngram_join, toxicity


def test_a_finished_task_gives_its_memory_back(spark, monkeypatch):
    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))

    class Frame:  # hands out the function that Spark would run
        sparkSession, schema = spark, None

        def mapInArrow(self, run, schema):
            return run

    run = common.map_arrow(Frame(), lambda batches: ({"id": b.column(0)} for b in batches), "id long")
    rows = run(iter([pa.record_batch({"id": pa.array([1, 2], pa.int64())})]))
    assert next(rows).num_rows == 2 and not given
    assert not list(rows) and given == [1]


def test_tasks_forget_words(spark):
    model = toxicity.Model(np.zeros(toxicity.TABLE, np.float32), -1.0, 1.0, 0.0)
    first = model.scores([b"some words here", None])
    assert model.known
    model.forget()
    assert "known" not in model.__dict__ and model.scores([b"some words here", None]) == first

    ended = []
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")

    class Frame:
        sparkSession, schema = spark, docs.schema

        def mapInArrow(self, run, schema):
            return run

    run = common.filter_arrow(Frame(), lambda texts: [t is None for t in texts], done=lambda: ended.append(1))
    batch = pa.record_batch({"doc_id": pa.array([1, 2], pa.int64()), "text": pa.array(["a b", None])})
    assert [x.column(0).to_pylist() for x in run(iter([batch]))] == [[2]] and ended == [1]


def test_only_shared_postings_are_unpacked():
    rng = np.random.default_rng(5)
    tokens = np.concatenate([rng.integers(0, 1 << 40, 5000, dtype=np.uint64), np.repeat(np.array([7, 1 << 39], np.uint64), [2, 12])])
    nodes, sizes, places = rng.integers(-(1 << 60), 1 << 60, len(tokens)), rng.integers(50, 60, len(tokens)), rng.integers(0, 50, len(tokens))

    def packed(a: int, b: int) -> list[bytes]:
        return [np.ascontiguousarray(tokens[a:b].view(np.uint8).reshape(-1, 8)[:, :5]).tobytes(), nodes[a:b].astype(np.int64).tobytes(), sizes[a:b].astype(np.uint16).tobytes(), places[a:b].astype(np.uint8).tobytes()]

    got, meta = ngram_join._shared([packed(0, 3000), packed(3000, 5001), packed(5001, len(tokens))])
    assert sorted(got.tolist()) == [7] * 2 + [1 << 39] * 12
    whole = ngram_join._lists_of(tokens, np.column_stack([nodes, sizes, places]), 8)
    part = ngram_join._lists_of(got, meta, 8)
    assert np.array_equal(whole[0], part[0]) and [x.tolist() for x in whole[1]] == [x.tolist() for x in part[1]] and len(part[1]) == 1
    assert not len(ngram_join._shared([packed(0, 5000)])[0])


def test_latin_texts_are_cut_as_others():
    cut, every = byte_bpe.splitter(public_tokenizers.PATTERN), regex.compile(public_tokenizers.PATTERN).findall
    assert byte_bpe.plain_pattern(public_tokenizers.PATTERN)
    for c in range(0x260):
        for t in (f"a {chr(c)}{chr(c)} b", f" {chr(c)}", f"  {chr(c)}1"):
            assert cut(t) == every(t), (c, t)
    r = random.Random(1)
    for _ in range(5000):
        t = "".join(r.choice("ab cd'sre\t\n  \x1c\x1d\x85\xa0²½12_-é'llßÄɏ中٣") for _ in range(r.randrange(30)))
        assert cut(t) == every(t), t
    for other in (r"\w+|\d", r"(?i:'s)|\p{L}+", r"\p{Lu}+", r"[a-z]+", r"[\S]", r"(?=a)a"):  # left to regex
        assert byte_bpe.plain_pattern(other) is None
