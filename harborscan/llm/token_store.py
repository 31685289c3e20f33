"""Token ids in fixed-width bit packing: every id takes the fewest bits that the vocabulary needs.

A segment is one binary value: a header, the byte offset of each block, and blocks of BLOCK_IDS ids packed with the
lowest bit first. numpy unpacks a block at once; any id is reached through its block's offset. Documents follow each
other in ascending doc_id order (equal ids by their packed tokens, null first) and a segment ends with a document, so
that it is the unit of reading back in parallel.

Writing: tokens are made and packed without a shuffle and stored; the packed rows, about a quarter of the text, are
dealt by ranges of doc_id, sorted within a range, and laid out as segments. Only one total per range is gathered to find
where each range starts. Spark's own writer commits the files, so lost executors cost a repeated task and nothing else.

Defined cases: null is the empty text, which has the end id only; repeated documents each give a row.
"""

from __future__ import annotations

import re
import struct
from array import array
from string import punctuation

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from harborscan.llm.common import documents, map_arrow, scratch, stored

MAGIC = b"FWB1"
BLOCK_IDS = 4096
#: A segment is closed once it has as many ids.
SEGMENT_IDS = 1 << 18
#: Chunks of text, and words without their marks, whose ids a worker remembers.
CACHE_CHUNKS, CACHE_STEMS = 300_000, 400_000


def width_of(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def _pack_bits(ids: np.ndarray, width: int) -> bytes:
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype(np.uint32)[:, None] >> np.arange(width, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def _unpack_bits(data, count: int, width: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", count).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=count * width, bitorder="little").reshape(count, width)
    return bits.astype(np.uint32) @ (np.uint32(1) << np.arange(width, dtype=np.uint32))


def pack(ids: np.ndarray, width: int, block: int = BLOCK_IDS) -> bytes:
    """A segment of ids."""
    if len(ids) and int(ids.max()) >> width:
        raise ValueError(f"an id does not fit in {width} bits")
    blocks = [_pack_bits(ids[i : i + block], width) for i in range(0, len(ids), block)]
    offsets = np.cumsum([0, *map(len, blocks)]).astype("<u8")
    return MAGIC + struct.pack("<BIQ", width, block, len(ids)) + offsets.tobytes() + b"".join(blocks)


def unpack(segment: bytes, start: int = 0, end: int | None = None) -> np.ndarray:
    """The ids [start, end) of a segment; only the blocks that hold them are read."""
    if segment[:4] != MAGIC:
        raise ValueError("not a segment of packed ids")
    width, block, count = struct.unpack_from("<BIQ", segment, 4)
    end = count if end is None else min(end, count)
    if start >= end:
        return np.zeros(0, np.uint32)
    first, last = start // block, (end - 1) // block
    offsets = np.frombuffer(segment, "<u8", -(-count // block) + 1, 17)
    body = memoryview(segment)[17 + 8 * len(offsets) :]
    parts = [_unpack_bits(body[offsets[k] : offsets[k + 1]], min(block, count - k * block), width) for k in range(first, last + 1)]
    return np.concatenate(parts)[start - first * block : end - first * block]


#: A byte's character in byte-level vocabularies: itself where it is printable, else the next free one from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SPELLING = {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(_PRINTABLE)))}
#: Letters that are composed already, with a plain lower case.
_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-įĲ-ňŊ-ž]+").fullmatch


class ChunkEncoder:
    """The tokenizer over texts cut at spaces and line ends, where this vocabulary's tokens end too; chunks are remembered.

    A chunk of Latin letters and closing ASCII marks goes to the tokenizer's model at once, in the vocabulary's spelling of
    bytes: the normaliser only lower-cases it and the splitter only parts letters from marks. Whether that holds is tried
    on a few words when the file is loaded; all other chunks, those with a special token in them included, go through the
    whole tokenizer.
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_file(path), np.array([end_id], "<u4").tobytes()
        self.model = self.tokenizer.model
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.spaced = [t for t in added if " " in t or "\n" in t]
        self.direct = all(self._letters(w.lower()) == self._whole([w])[0] for w in ("a", "The", "Wonderful", "qzxJv", "internationalization", "Élève", "Straße", "ŽIŽEK", "ñandú"))
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.stems: dict[str, bytes] = {}

    def _letters(self, word: str) -> bytes:
        spelt = word if word.isascii() else word.encode().decode("latin-1").translate(_SPELLING)
        return array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: list[str]) -> None:
        known, stems, others = self.known, self.stems, []
        for c in chunks:
            stem = c.rstrip(punctuation)
            if self.direct and stem.isalpha() and (stem.isascii() or _LATIN(stem)):
                marks = c[len(stem) :]
                low = stem.lower()
                ids = stems.get(low)
                if ids is None:
                    ids = stems[low] = self._letters(low)
                if marks:
                    if marks not in stems:
                        stems[marks] = self._whole([marks])[0]
                    ids += stems[marks]
                known[c] = ids
            else:
                others.append(c)
        for k in range(0, len(others), 20_000):
            some = others[k : k + 20_000]
            known.update(zip(some, self._whole(some), strict=True))

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """For each text its ids and the end id, as little-endian 32-bit integers."""
        plain = [t.decode() if t else "" for t in texts]
        if self.spaced:  # a special token with a space in it may cross chunks
            return [x + self.end for x in self._whole(plain)]
        cut = [t.replace("\n", " ").split(" ") for t in plain]
        if len(self.known) > CACHE_CHUNKS:  # the elder half goes, but for what is met again
            self.known, self.older = {}, self.known
            if len(self.stems) > CACHE_STEMS:
                self.stems = {}
        names = set().union(*cut)
        names.discard("")
        fresh = []
        for c in names - self.known.keys():
            ids = self.older.get(c)
            if ids is None:
                fresh.append(c)
            else:
                self.known[c] = ids
        self._learn(fresh)
        self.known[""] = b""
        get = self.known.__getitem__
        return [b"".join(map(get, x)) + self.end for x in cut]


_encoders: dict[tuple[str, int], ChunkEncoder] = {}


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, width: int) -> DataFrame:
    """doc_id, n and the packed ids of every document, in the order of docs."""

    def each(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        key = (tokenizer, end_id)
        coder = _encoders.setdefault(key, _encoders.get(key) or ChunkEncoder(tokenizer, end_id))
        for b in batches:
            ids = [np.frombuffer(x, "<u4") for x in coder.encode(b.column(1).to_pylist())]
            yield {"doc_id": b.column(0), "n": [len(x) for x in ids], "packed": [_pack_bits(x, width) for x in ids]}

    return map_arrow(documents(docs), each, "doc_id long, n int, packed binary")


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, vocabulary: int) -> None:
    """Write the token store of docs: segments of packed ids with the documents in them."""
    width = width_of(vocabulary)
    rows = stored(tokenized(docs, tokenizer, end_id, width), "tokens", "zstd")
    dealt = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "packed")

    def lay(batches):
        from pyspark import TaskContext

        shard, number, at, ids, names, lengths, held = TaskContext.get().partitionId(), 0, 0, [], [], [], 0

        def segment():
            return {"shard": [shard], "segment": [number], "shard_start": [at], "doc_ids": [names], "lengths": [lengths], "data": [pack(np.concatenate(ids), width)]}

        for b in batches:
            for doc, n, packed in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                ids.append(_unpack_bits(packed, n, width))
                names.append(doc)
                lengths.append(n)
                held += n
                if held >= SEGMENT_IDS:
                    yield segment()
                    number, at, ids, names, lengths, held = number + 1, at + held, [], [], [], 0
        if names:
            yield segment()

    map_arrow(dealt, lay, "shard long, segment long, shard_start long, doc_ids array<long>, lengths array<int>, data binary").write.option("compression", "zstd").parquet(path)


def shard_starts(store: DataFrame) -> DataFrame:
    """shard and the number of ids before it: one row a range, so the running sum is over few rows."""
    per = store.select("shard", "shard_start", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"), F.try_element_at("doc_ids", F.lit(1)).alias("first"), F.col("segment"))
    totals = per.groupBy("shard").agg(F.sum("n").alias("n"), F.min_by("first", "segment").alias("first"))
    before = Window.orderBy(F.asc_nulls_first("first")).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (binary, little-endian 32 bits) of every document of a store."""
    store = spark.read.parquet(path)
    # One row for each range of the writer's shuffle: as many as its partitions, so small enough to send everywhere.
    rows = store.join(F.broadcast(shard_starts(store)), "shard").select("before", "shard_start", "doc_ids", "lengths", "data")

    def each(batches):
        for b in batches:
            for before, at, names, lengths, data in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                cuts = np.cumsum([0, *lengths])
                ids = unpack(data)
                yield {"doc_id": names, "start": (before + at + cuts[:-1]).tolist(), "n_tokens": lengths, "ids": [ids[s:e].astype("<u4").tobytes() for s, e in zip(cuts[:-1], cuts[1:], strict=True)]}

    return map_arrow(rows, each, "doc_id long, start long, n_tokens long, ids binary")


def stored_tokens(docs: DataFrame, tokenizer: str, end_id: int = 1, vocabulary: int = 49408) -> DataFrame:
    """One row per document, from the files written: doc_id, start, n_tokens, ids_crc32."""
    path = scratch(docs.sparkSession, "token-store")
    write_tokens(docs, path, tokenizer, end_id, vocabulary)
    return read_tokens(docs.sparkSession, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
