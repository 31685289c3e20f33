"""Byte-level BPE: higher-order functions fold ranked merges over the byte arrays of distinct words.

A task cuts its texts into pre-tokens and numbers the distinct ones. A word of the vocabulary is its one id; others are
cut at every two bytes that no vocabulary piece holds side by side, since no merge ever crosses such a place, and the
distinct parts go to Spark as byte arrays (each byte with the one after it). Spark folds each part: ``aggregate``
merges, one step at a time, the leftmost adjacent pair of the lowest rank until no pair has one. The state is one array
of longs, each a part with the rank of its pair: rank, place and id in one number, so that ``array_min`` finds the next
merge. The rank map is a literal: an array in which a pair of ids has one place, found by a multiplier that another
literal array gives, so that a lookup is arithmetic. The next operator of the same task, which sees the batches in the
same order, keeps the encoded words by number, puts texts together, and decodes by concatenating the ids' binary pieces.
No row is shuffled, nothing grows with the corpus, and a lost task is simply run again.

Texts of Latin characters are cut by ``re``, the pattern's classes spelt out; all others by ``regex``.

The most frequent words of a bounded sample are folded once, before, and sent to all tasks. That saves work and touches
no result: a word that is not among them is folded by the task that meets it.

Defined cases: null is the empty text, which has no tokens; repeated documents each give a row; a vocabulary of more
than 2 ** 17 ids is an error. A part of n bytes takes time in proportion to n times its merges.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from array import array
from collections import Counter
from collections.abc import Callable
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from harborscan.llm.common import documents, map_arrow, release, stored

#: Words that a task numbers before it starts anew.
MAX_WORDS = 400_000
#: Documents of the sample, and its words that are folded before.
SAMPLE_DOCUMENTS, FREQUENT_WORDS = 16_000, 240_000
_ID, _PLACE = 17, 26
_NO_RANK = (1 << _ID) - 1
_SHIFT = _ID + _PLACE
#: Bits of the places of pairs and of the multipliers, and how far the products are shifted.
_SLOTS, _CHOICES, _DOWN = 18, 15, 16
_CHOOSER = 40503 * 4001
#: Texts of characters below this one are cut by ``re``.
_PLAIN = 0x250


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _spelt(classes: str) -> str:
    """The characters below _PLAIN of \\p{L}, \\p{N} and \\s, as ranges for a set of ``re``."""
    of = regex.compile(f"[{classes}]")
    hit = np.array([bool(of.match(chr(c))) for c in range(_PLAIN)] + [False])
    edges = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0))
    return "".join(f"\\u{a:04x}-\\u{b - 1:04x}" for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()))


def plain_pattern(pattern: str) -> str | None:
    """The pattern for ``re``, on texts of characters below _PLAIN, its classes spelt out; None if it holds anything that
    the two modules may take differently."""
    out, inside = [], False
    for token in regex.findall(r"\\p\{[LN]\}|\\.|\(\?.|.", pattern, regex.S):
        if token in (r"\p{L}", r"\p{N}", r"\s"):
            out.append(_spelt(token) if inside else f"[{_spelt(token)}]")
        elif token == r"\S" and not inside:
            out.append(f"[^{_spelt(chr(92) + 's')}]")
        elif len(token) == 1 and token != "\\" or token in ("(?!", "(?:"):
            if token == "[" and inside or token in "&|~-" and inside:
                return None
            inside = token == "[" or inside and token != "]"
            out.append(token)
        else:
            return None
    return "".join(out)


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """All matches of the pattern in a text. ``re`` is faster, and takes the texts that it cuts in the same way."""
    every, plain = regex.compile(pattern).findall, plain_pattern(pattern)
    if plain is None:
        return every
    fast, other = re.compile(plain).findall, re.compile(f"[^\0-{chr(_PLAIN - 1)}]").search
    return lambda text: fast(text) if text.isascii() or not other(text) else every(text)


def pair_code(a: int, b: int) -> int:
    return (a + 1) << _ID | b


def pair_table(ranks: dict[bytes, int]) -> tuple[array, array]:
    """(slots, multipliers): a pair of ids that merges stands, as its code << 17 | merged id, at the slot that its code
    times one multiplier gives; the multiplier stands where the code times a fixed number says."""
    if max(ranks.values(), default=0) >= _NO_RANK:
        raise ValueError(f"ids must be below {_NO_RANK}")
    sharing: dict[int, list[tuple[int, int]]] = {}
    for piece, rank in ranks.items():
        for cut in range(1, len(piece)):
            a, b = ranks.get(piece[:cut]), ranks.get(piece[cut:])
            if a is not None and b is not None:
                code = pair_code(a, b)
                sharing.setdefault(code * _CHOOSER >> 20 & ((1 << _CHOICES) - 1), []).append((code, rank))
    size = _SLOTS
    while sum(map(len, sharing.values())) * 2 > 1 << size:
        size += 1
    slots, multipliers = array("q", bytes(8 << size)), array("q", [1]) * (1 << _CHOICES)
    for where, pairs in sorted(sharing.items(), key=lambda x: (-len(x[1]), x[0])):
        for m in range((1 << 20) + 1, 1 << 21, 2):
            at = [code * m >> _DOWN & ((1 << size) - 1) for code, _ in pairs]
            if len(set(at)) == len(at) and not any(map(slots.__getitem__, at)):
                break
        else:
            raise ValueError("no table found")
        multipliers[where] = m
        for k, (code, rank) in zip(at, pairs, strict=True):
            slots[k] = code << _ID | rank
    return slots, multipliers


def first_table(ranks: dict[bytes, int]) -> array:
    """For a byte and the one after it (256 * first + second; 65536 + first at the end): the pair's rank << 43 | the byte's id."""
    single = [ranks[bytes([b])] for b in range(256)]
    pairs = [ranks.get(bytes([x, y]), _NO_RANK) << _SHIFT | single[x] for x in range(256) for y in range(256)]
    return array("q", pairs + [_NO_RANK << _SHIFT | i for i in single])


def together(ranks: dict[bytes, int]) -> np.ndarray:
    """Which bytes (256 * first + second) stand side by side in some vocabulary piece."""
    out = np.zeros(65536, bool)
    for piece in ranks:
        x = np.frombuffer(piece, np.uint8).astype(np.int64)
        out[x[:-1] * 256 + x[1:]] = True
    return out


def literal(tables: list[array]) -> Column:
    """The tables as one JSON literal. It is read once for each batch: a literal of arrays would be spelt out anew in every
    text of the plan that the driver makes."""
    return F.from_json(F.lit("[" + ",".join("[" + ",".join(map(str, t)) + "]" for t in tables) + "]"), "array<array<bigint>>")


def bind(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold_merges(part: Column, slots: Column, multipliers: Column, first: Column, size: int) -> Column:
    """The token ids of one part of a pre-token, given as the array of its bytes, each with the one after it."""

    def ranked(code: Column) -> Column:
        """The id that a pair of ids merges into, _NO_RANK for others: the slot's number without the pair's code is
        below _NO_RANK only if the pair stands there."""
        m = F.get(multipliers, F.shiftright(code * _CHOOSER, 20).bitwiseAND((1 << _CHOICES) - 1).cast("int"))
        found = F.get(slots, F.shiftright(code * m, _DOWN).bitwiseAND(size - 1).cast("int"))
        return F.shiftleft(F.least(found.bitwiseXOR(F.shiftleft(code, _ID)), F.lit(_NO_RANK).cast("long")), _SHIFT)

    one = 1 << _ID

    def step(state: Column, low: Column) -> Column:
        def at(k: Column) -> Column:  # k: place of the pair, from 1; its parts are k - 1 and k, from 0
            new = F.shiftright(low, _SHIFT)
            before = F.get(state, k - 2)
            codes = F.array(F.shiftleft(before.bitwiseAND(_NO_RANK), _ID) + new + one, F.shiftleft(new, _ID) + F.get(state, k + 1).bitwiseAND(_NO_RANK) + one)
            made = F.zip_with(F.transform(codes, ranked), F.array(before.bitwiseAND((1 << _SHIFT) - 1), low.bitwiseAND(((1 << _PLACE) - 1) << _ID) + new), lambda r, x: r + x)
            rest = F.slice(state, k + 2, F.size(state))
            return F.when(k > 1, F.concat(F.slice(state, F.lit(1), k - 2), made, rest)).otherwise(F.concat(F.slice(made, 2, 1), rest))

        return bind(F.array_position(state, low).cast("int"), at)

    start = F.transform(part, lambda p, i: F.get(first, p) + F.shiftleft(i.cast("long"), _ID))
    none = F.lit(_NO_RANK << _SHIFT).cast("long")
    merged = F.aggregate(F.sequence(F.lit(2), F.size(part)), start, lambda s, _: bind(F.array_min(s), lambda low: F.when(low < none, step(s, low)).otherwise(s)), lambda s: F.transform(s, lambda x: x.bitwiseAND(_NO_RANK).cast("int")))
    return F.when(F.size(part) < 2, F.transform(start, lambda x: x.bitwiseAND(_NO_RANK).cast("int"))).otherwise(merged)


def _gather(codes: np.ndarray, offsets: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The runs values[offsets[c]:offsets[c + 1]] for each code c, one after another."""
    length = offsets[codes + 1] - offsets[codes]
    ends = np.cumsum(length)
    return values[np.repeat(offsets[codes] - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)]


class _Parts:
    """Cuts words into the parts that merges never leave, and numbers the distinct parts."""

    def __init__(self, ranks: dict[bytes, int], beside: np.ndarray):
        self.ranks, self.beside, self.numbers = ranks, beside, {}

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ends, codes): for each word its one id as -1 - id, or the numbers of its parts; (ends, bytes with the next)
        of the parts that are new."""
        known, numbers, begin = self.ranks, self.numbers, len(self.numbers)
        whole = [known.get(w) for w in words]
        others = [w for w, i in zip(words, whole, strict=True) if i is None]
        blob = b"".join(others)
        flat = np.frombuffer(blob, np.uint8).astype(np.int32)
        word_ends = np.cumsum([len(w) for w in others], dtype=np.int64) if others else np.zeros(0, np.int64)
        pairs = flat.copy()
        pairs[:-1] = flat[:-1] * 256 + flat[1:]
        last = np.zeros(len(flat), bool)
        if len(flat):
            last[:-1] = ~self.beside[pairs[:-1]]
            last[word_ends - 1] = True
        ends = np.flatnonzero(last) + 1
        cuts = [0, *ends.tolist()]
        codes = np.array([numbers.setdefault(blob[x:y], len(numbers)) for x, y in zip(cuts, cuts[1:])], np.int64)
        fresh, at = np.unique(codes, return_index=True)
        at = at[fresh >= begin]
        pairs[ends - 1] = 65536 + flat[ends - 1]
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
        length = ends[at] - starts[at]
        part_ends = np.concatenate([[0], np.cumsum(length)])
        new = pairs[np.repeat(starts[at] - part_ends[:-1], length) + np.arange(part_ends[-1])]
        per = np.diff(np.searchsorted(ends, word_ends, side="right"), prepend=0)
        count = np.ones(len(words), np.int64)
        lone = np.array([i is not None for i in whole], bool)
        count[~lone] = per
        out = np.zeros(int(count.sum()), np.int64)
        spread = np.repeat(lone, count)
        out[spread] = [-1 - i for i in whole if i is not None]
        out[~spread] = codes
        return np.concatenate([[0], np.cumsum(count)]), out, part_ends, new


class _Words:
    """Encoded words by number: those sent to all tasks, then those of this task."""

    def __init__(self, offsets: np.ndarray, ids: np.ndarray):
        self.offsets, self.ids = offsets, ids
        self.part_offsets, self.part_ids = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def add(self, ends: np.ndarray, codes: np.ndarray, parts: pa.ListArray) -> None:
        if len(parts):
            o = parts.offsets.to_numpy().astype(np.int64)
            self.part_offsets = np.concatenate([self.part_offsets, o[1:] - o[0] + len(self.part_ids)])
            self.part_ids = np.concatenate([self.part_ids, parts.values.to_numpy()[o[0] : o[-1]]])
        if len(ends) > 1:
            lone = codes < 0
            length = np.ones(len(codes), np.int64)
            length[~lone] = np.diff(self.part_offsets)[codes[~lone]]
            ids = np.zeros(int(length.sum()), np.int32)
            spread = np.repeat(lone, length)
            ids[spread] = -1 - codes[lone]
            ids[~spread] = _gather(codes[~lone], self.part_offsets, self.part_ids)
            self.offsets = np.concatenate([self.offsets, np.concatenate([[0], np.cumsum(length)])[ends[1:]] + len(self.ids)])
            self.ids = np.concatenate([self.ids, ids])

    def text(self, codes: bytes) -> np.ndarray:
        return _gather(np.frombuffer(codes, np.int32), self.offsets, self.ids)


_NUMBERED: dict[str, dict[str, int]] = {}


def _numbered(words: bytes, mark: str) -> dict[str, int]:
    """The numbers of the words sent to all tasks, made once in a worker."""
    if mark not in _NUMBERED:
        _NUMBERED.clear()
        _NUMBERED[mark] = {w: k for k, w in enumerate(words.decode().split("\0")[:-1])}
    return _NUMBERED[mark].copy()


class Vocabulary:
    """What the fold and the tasks need of a rank file: of fixed size, sent once."""

    def __init__(self, spark, ranks: dict[bytes, int]):
        slots, multipliers = pair_table(ranks)
        self.size = len(slots)
        self.tables = literal([slots, multipliers, first_table(ranks)])
        self.known = spark.sparkContext.broadcast((ranks, together(ranks)))

    def folded(self, parts: Column) -> Column:
        """Each of an array of parts as its ids."""

        def with_tables(tables: Column) -> Column:
            slots, multipliers, first = (F.get(tables, F.lit(k)) for k in range(3))
            return F.transform(parts, lambda p: fold_merges(p, slots, multipliers, first, self.size))

        return bind(self.tables, with_tables)


def frequent(docs: DataFrame, vocabulary: Vocabulary, pattern: str) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The most frequent words of about SAMPLE_DOCUMENTS documents, and their ids: (words with a NUL after each, offsets, ids)."""
    n = docs.count()
    some = documents(docs).sample(min(1.0, SAMPLE_DOCUMENTS / max(n, 1)), seed=11)

    def count(batches):
        split = splitter(pattern)
        for b in batches:
            times = Counter()
            for t in b.column(1).to_pylist():
                times.update(split(t.decode()) if t else ())
            often = [(w, c) for w, c in times.items() if c > 1 and len(w) <= 64 and "\0" not in w]
            yield {"word": [w for w, _ in often], "c": [c for _, c in often]}

    top = map_arrow(some, count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "word").limit(FREQUENT_WORDS).select("word")
    top = stored(top.repartition(8), "words")  # the plan with the vocabulary in it has one stage only
    release(docs.sparkSession)
    known = vocabulary.known

    def cut(batches):
        for b in batches:
            words = b.column(0).to_pylist()
            ends, codes, part_ends, parts = _Parts(*known.value).of([w.encode() for w in words])
            lists = pa.ListArray.from_arrays(pa.array(part_ends.astype(np.int32)), pa.array(parts.astype(np.int32)))
            yield {"words": [words], "ends": [ends.tolist()], "codes": [codes.tolist()], "parts": pa.ListArray.from_arrays(pa.array([0, len(lists)], pa.int32()), lists)}

    def join(batches):
        for b in batches:
            for k in range(b.num_rows):
                w = _Words(np.zeros(1, np.int64), np.zeros(0, np.int32))
                w.add(np.array(b.column(1)[k].as_py(), np.int64), np.array(b.column(2)[k].as_py(), np.int64), b.column(3)[k].values)
                yield {"words": ["".join([x + "\0" for x in b.column(0)[k].as_py()]).encode()], "offsets": [w.offsets.astype("<i4").tobytes()], "ids": [w.ids.astype("<i4").tobytes()]}

    rows = map_arrow(top, cut, "words array<string>, ends array<long>, codes array<long>, parts array<array<int>>").select("words", "ends", "codes", vocabulary.folded(F.col("parts")).alias("parts"))
    words, offsets, ids = [], [np.zeros(1, np.int64)], [np.zeros(0, np.int32)]
    for r in map_arrow(rows, join, "words binary, offsets binary, ids binary").toLocalIterator():
        offsets.append(np.frombuffer(r.offsets, "<i4")[1:].astype(np.int64) + offsets[-1][-1])
        words.append(bytes(r.words))
        ids.append(np.frombuffer(r.ids, "<i4"))
    return b"".join(words), np.concatenate(offsets).astype(np.int32), np.concatenate(ids)


def _encoded(docs: DataFrame, ranks: dict[bytes, int], pattern: str, finish, schema: str, with_text: bool) -> DataFrame:
    """finish(doc_ids, ids of each document, texts) for each batch of documents."""
    spark = docs.sparkSession
    vocabulary = Vocabulary(spark, ranks)
    known = vocabulary.known
    sent, mark = spark.sparkContext.broadcast(frequent(docs, vocabulary, pattern)), uuid.uuid4().hex  # at most FREQUENT_WORDS words of 64 letters
    release(spark)  # the plan of the frequent words, before a second one with the vocabulary in it

    def cut(batches):
        split, numbers, parts = splitter(pattern), None, None
        for b in batches:
            fresh = numbers is None or len(numbers) > FREQUENT_WORDS + MAX_WORDS
            if fresh:
                numbers, parts = _numbered(sent.value[0], mark), _Parts(*known.value)
            begin = len(numbers)
            texts = b.column(1).to_pylist()
            codes = [np.array([numbers.setdefault(w, len(numbers)) for w in split(t.decode())] if t else [], np.int32).tobytes() for t in texts]
            ends, spelt, part_ends, new = parts.of([w.encode() for w in islice(numbers, begin, None)])
            lists = pa.ListArray.from_arrays(pa.array(part_ends.astype(np.int32)), pa.array(new.astype(np.int32)))
            yield {
                "fresh": [fresh], "doc_ids": [b.column(0).to_pylist()], "codes": [codes], "texts": [texts if with_text else []], "ends": [ends.astype("<i8").tobytes()],
                "spelt": [spelt.astype("<i8").tobytes()], "parts": pa.ListArray.from_arrays(pa.array([0, len(lists)], pa.int32()), lists),
            }

    def join(batches):
        words = None
        for b in batches:
            for k in range(b.num_rows):
                if b.column(0)[k].as_py():
                    words = _Words(sent.value[1].astype(np.int64), sent.value[2])
                words.add(np.frombuffer(b.column(4)[k].as_py(), "<i8"), np.frombuffer(b.column(5)[k].as_py(), "<i8"), b.column(6)[k].values)
                yield finish(b.column(1)[k].as_py(), [words.text(c) for c in b.column(2)[k].as_py()], b.column(3)[k].as_py())

    cut_up = map_arrow(documents(docs), cut, "fresh boolean, doc_ids array<long>, codes array<binary>, texts array<binary>, ends binary, spelt binary, parts array<array<int>>")
    folded = cut_up.select("fresh", "doc_ids", "codes", "texts", "ends", "spelt", vocabulary.folded(F.col("parts")).alias("parts"))
    return map_arrow(folded, join, schema)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id, ids (array<int>) and text (binary) of every document."""

    def finish(doc_ids, ids, texts):
        ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
        return {"doc_id": doc_ids, "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)]))), "text": texts}

    return _encoded(docs, ranks, pattern, finish, "doc_id long, ids array<int>, text binary", True)


def pieces_of(ranks: dict[bytes, int]) -> list[bytes]:
    out = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        out[rank] = piece
    return out


def decode(ids: list[int], pieces: list[bytes]) -> bytes:
    return b"".join([pieces[i] for i in ids])


def tokens(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256 and decoded_sha256 (of the bytes decoded from the ids)."""
    pieces = docs.sparkSession.sparkContext.broadcast(pieces_of(ranks))  # fixed by the vocabulary

    names: list[str] = []

    def finish(doc_ids, ids, _):
        lists = [x.tolist() for x in ids]
        names[:] = names or map(str, range(len(pieces.value)))
        return {
            "doc_id": doc_ids, "n_tokens": [len(x) for x in lists],
            "ids_sha256": [hashlib.sha256(" ".join([names[i] for i in x]).encode()).hexdigest() for x in lists],
            "decoded_sha256": [hashlib.sha256(decode(x, pieces.value)).hexdigest() for x in lists],
        }

    return _encoded(docs, ranks, pattern, finish, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", False)
