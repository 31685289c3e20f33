"""Benchmark decontamination: Wu-Manber search for windows of benchmark words in every document.

Symbols are words, so a block is two consecutive words. For each window length there is a shift table (how far the
search may jump when the block under its end is met), buckets keyed by the suffix block and then by the first block, and
a direct comparison of all words. Documents are never shuffled.

Tables are of bounded size: the benchmark is dealt once into blocks of about BLOCK_BYTES of text, and each block's tables
(one array of all its words, whole numbers for blocks and places: about 70 bytes a byte of text) are built on the driver,
sent and dropped before the next; each further block is one more pass chained in the same stage.

Defined cases: null or wordless text has no words and no hits; items that are null, wordless or without id give no
windows; an item id that repeats counts once; repeated documents, and documents without a doc_id, each give a row.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_right
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, functions as F

from harborscan.llm.common import documents, filter_arrow, map_arrow, scratch

WINDOW = 10
BLOCK_BYTES = 2 << 20
#: Lower-cases A-Z; all that is no word byte (0-9, a-z, 0x80 and above) becomes a space.
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_WORD_BYTES).split() if text else []


class WuManber:
    """The tables for one set of items: [(item_id, text)]."""

    def __init__(self, items: Iterable[tuple[int, bytes]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.text, self.owners, self.starts = array("I"), array("q"), array("Q")
        places: dict[int, array] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)]
            if ids:
                start = len(self.text)
                self.starts.append(start)
                self.owners.append(item)
                self.text.extend(ids)
                places.setdefault(min(window, len(ids)), array("Q")).extend(range(start, start + max(1, len(ids) - window + 1)))
        self.lengths = [(m, *self._tables(m, at)) for m, at in sorted(places.items())]

    def _tables(self, m: int, places: array) -> tuple[dict[int, int], dict[int, dict[int, array]]]:
        """The shift of each block of the windows of m words at these places, and the windows by suffix and first block."""
        shift: dict[int, int] = {}
        buckets: dict[int, dict[int, array]] = {}
        size, text, seen = min(2, m), self.text, {}
        for p in places:
            name = text[p : p + m].tobytes()
            first = seen.setdefault(name, p)
            if first == p:
                for end in range(size, m + 1):
                    block = self._block(p + end - size, size)
                    if shift.get(block, m) > m - end:
                        shift[block] = m - end
            found = buckets.setdefault(self._block(p + m - size, size), {}).setdefault(self._block(p, size), array("Q"))
            found.append(p)
        return shift, buckets

    def _block(self, at: int, size: int) -> int:
        return self.text[at] if size == 1 else self.text[at] << 32 | self.text[at + 1]

    def search(self, text: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Word spans [start, end) of all occurrences, and the items that own them."""
        spans, found, known, n = [], set(), self.vocabulary.get, len(text)
        for m, shift, buckets in self.lengths:
            size = min(2, m)
            i = m - 1
            while i < n:
                last = known(text[i])
                if last is None:  # no window holds this word: the next one starts after it
                    i += m
                    continue
                if size == 1:
                    block = last
                else:
                    before = known(text[i - 1])
                    if before is None:
                        i += m - 1
                        continue
                    block = before << 32 | last
                jump = shift.get(block, m - size + 1)
                if jump:
                    i += jump
                    continue
                start = i - m + 1
                ids = [known(w) for w in text[start : i + 1]]
                if None not in ids:
                    first = ids[0] if size == 1 else ids[0] << 32 | ids[1]
                    here = array("I", ids)
                    for p in buckets.get(block, {}).get(first, ()):
                        if self.text[p : p + m] == here:
                            spans.append((start, i + 1))
                            found.add(self.owners[bisect_right(self.starts, p) - 1])
                i += 1
        return spans, found


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[Iterator[tuple[int, bytes]]]:
    """The items in blocks of bounded size, one after another. They are dealt into folders once, so that each block reads
    its own only."""
    items = benchmark.select(F.col("item_id").cast("long").alias("i"), F.col("text").cast("string").cast("binary").alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    if n > 1:
        path = scratch(benchmark.sparkSession, "benchmark")
        items.withColumn("block", F.pmod(F.xxhash64("i", "t"), F.lit(n))).repartition("block").write.partitionBy("block").parquet(path)
        items = benchmark.sparkSession.read.parquet(path)
    for k in range(n):
        yield ((r[0], bytes(r[1])) for r in (items.where(F.col("block") == k) if n > 1 else items).select("i", "t").toLocalIterator())


def covered(spans: list[tuple[int, int]]) -> int:
    """Words in the union of the spans."""
    total, reach = 0, 0
    for start, end in sorted(spans):
        total += max(0, end - max(start, reach))
        reach = max(reach, end)
    return total


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, text, spans (flat starts and ends, in words) and items (array) of every document."""
    spark = docs.sparkSession
    out = documents(docs).withColumns({"spans": F.array().cast("array<int>"), "items": F.array().cast("array<long>")})
    for block in item_blocks(benchmark, block_bytes):
        tables = spark.sparkContext.broadcast(WuManber(block, window))

        def each(batches, tables=tables):
            for b in batches:
                spans, items = b.column(2).to_pylist(), b.column(3).to_pylist()
                for k, text in enumerate(b.column(1).to_pylist()):
                    found, owners = tables.value.search(words(text))
                    if found:
                        spans[k] = spans[k] + [x for span in found for x in span]
                        items[k] = sorted({*items[k], *owners})
                yield {"doc_id": b.column(0), "text": b.column(1), "spans": spans, "items": items}

        out = map_arrow(out, each, "doc_id long, text binary, spans array<int>, items array<long>")
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""

    def each(batches):
        for b in batches:
            hits = [covered(list(zip(s[::2], s[1::2], strict=True))) for s in b.column(2).to_pylist()]
            items = b.column(3).to_pylist()
            yield {
                "doc_id": b.column(0),
                "n_words": [len(words(t)) for t in b.column(1).to_pylist()],
                "n_hit": hits,
                "n_items": [len(x) for x in items],
                "items_sha256": [hashlib.sha256(",".join(sorted(map(str, x))).encode()).hexdigest() for x in items],
                "contaminated": [h > 0 for h in hits],
            }

    return map_arrow(scan(docs, benchmark, window, block_bytes), each, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents, all their columns, that hold no window of any item."""
    spark, out = docs.sparkSession, docs
    for block in item_blocks(benchmark, block_bytes):
        tables = spark.sparkContext.broadcast(WuManber(block, window))
        out = filter_arrow(out, lambda texts, tables=tables: [not tables.value.search(words(t))[0] for t in texts])
    return out
