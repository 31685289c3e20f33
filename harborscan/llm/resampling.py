"""Importance resampling towards a target: documents whose word runs are likelier in the target texts are likelier drawn.

Words come from an untrained Regex Split of the tokenizers library over ASCII-lowered text, with their offsets. Windows of
one to three consecutive offset pairs are the features; a feature's CRC-32 follows from the CRCs of the text up to the two
offsets alone, so no feature is ever cut out. Each document's buckets are stored once (two bytes a feature): the histogram
and, when the gains are known, the documents' weights are read from that table, and texts are tokenised a single time.

The histogram, the gains and the list of gains that is sent to all tasks have one entry a bucket (BUCKETS, a parameter of at
most 65,536), whatever the number of documents. The draw is exact: scores are dealt into ranges, only the totals of ranges
are summed in one place, and places are counted within each range.

Defined cases: null or wordless text has no features and weight 0; a null doc_id is noised as the empty text; equal rows
each give a row and take neighbouring places; target texts that are null count nothing; without documents there are no
rows; without target texts, gains come from the documents alone. Texts of any length are read in pieces of PIECE bytes, cut
between words; the two words after a piece complete its last windows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F
from tokenizers import Regex, pre_tokenizers

from harborscan.llm.common import documents, map_arrow, stored

BUCKETS, RUN, MIN_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, 42
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PIECE = 1 << 16
#: Windows of up to so many bytes are summed from prefixes; longer ones directly.
SHORT = 256
#: Lower-cases A-Z; what is no word byte (0-9, a-z, 0x80 and above) becomes a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _shifts() -> np.ndarray:
    """[n][k][b]: what the CRC of a prefix whose k-th byte is b becomes when n bytes follow it (CRCs are linear)."""
    one = np.zeros((4, 256), np.uint32)
    table = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
    for k in range(4):
        v = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
        one[k] = table[v & 255] ^ (v >> np.uint32(8))
    out = np.zeros((SHORT + 1, 4, 256), np.uint32)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(SHORT):
        out[n + 1] = _moved(one[None], np.zeros(1024, np.int64), out[n].ravel()).reshape(4, 256)
    return out


def _moved(shifts: np.ndarray, n: np.ndarray, crc: np.ndarray) -> np.ndarray:
    flat, at = shifts.reshape(-1), n * 1024
    out = flat[at + (crc & 255)]
    for k in (1, 2, 3):
        out = out ^ flat[at + 256 * k + ((crc >> np.uint32(8 * k)) & 255)]
    return out


class Features:
    """CRC-32 of all runs of one to ``run`` words of a text."""

    def __init__(self, run: int = RUN):
        self.run, self.shifts = run, _shifts()
        self.split = pre_tokenizers.Split(Regex(WORD), "removed", invert=True)

    def of(self, text: bytes | None) -> Iterator[tuple[int, list[np.ndarray]]]:
        """For each piece of the text, the number of words that begin in it and the CRCs of the runs that do."""
        whole = b" ".join(text.translate(_FOLD).split()) if text and len(text) <= PIECE else _spaced(text or b"")
        at = 0
        while at < len(whole):
            end = _word_end(whole, at + PIECE)
            after = end
            for _ in range(self.run - 1):
                after = _word_end(whole, after + 1)
            yield self._piece(whole[at:after], end - at)
            at = end + 1

    def _piece(self, text: bytes, own: int) -> tuple[int, list[np.ndarray]]:
        """text has one space between words; the first ``own`` bytes are this piece's, the rest are the next words."""
        characters = text.decode()
        ends = np.array([e for _, (_, e) in self.split.pre_tokenize_str(characters)], np.int64)
        if len(characters) != len(text):
            wide = np.frombuffer(characters.encode("utf-32-le"), np.uint32)
            ends = np.cumsum(1 + (wide > 0x7F) + (wide > 0x7FF) + (wide > 0xFFFF))[ends - 1]
        starts = np.concatenate([[0], ends[:-1] + 1])
        mine = int(np.searchsorted(starts, own))
        places = ends.tolist()
        until = np.fromiter(accumulate((text[a:b] for a, b in zip([0, *places[:-1]], places)), lambda crc, part: zlib.crc32(part, crc), initial=0), np.uint32, len(places) + 1)
        space = np.uint32(zlib.crc32(b" "))
        before = np.concatenate([[np.uint32(0)], _moved(self.shifts, np.ones(len(places) - 1, np.int64), until[1:-1]) ^ space]).astype(np.uint32)
        out = []
        for k in range(min(self.run, len(places))):
            n = min(mine, len(places) - k)
            size = ends[k : k + n] - starts[:n]
            crc = until[k + 1 : k + n + 1] ^ _moved(self.shifts, np.minimum(size, SHORT), before[:n])
            for i in np.flatnonzero(size > SHORT).tolist():
                crc[i] = zlib.crc32(text[starts[i] : ends[k + i]])
            out.append(crc)
        return mine, out


def _spaced(text: bytes) -> bytes:
    """Words with one space between them, a megabyte at a time."""
    text, parts = text.translate(_FOLD), []
    at = 0
    while at < len(text):
        end = text.find(b" ", at + (1 << 20))
        end = len(text) if end < 0 else end
        part = b" ".join(text[at:end].split())
        if part:
            parts.append(part)
        at = end
    return b" ".join(parts)


def _word_end(text: bytes, at: int) -> int:
    end = text.find(b" ", min(at, len(text)))
    return len(text) if end < 0 else end


def bucketed(texts: DataFrame, buckets: int = BUCKETS, run: int = RUN) -> DataFrame:
    """doc_id, n_words, n_features and buckets (two bytes each, little-endian) of rows (doc_id, text)."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets: 1 to 65,536")

    def each(batches):
        features = Features(run)
        for batch in batches:
            ids, packed, n_words, n_features = batch.column(0), [], [], []
            for text in batch.column(1).to_pylist():
                words, parts = 0, []
                for mine, crcs in features.of(text):
                    words += mine
                    parts += [(c % buckets).astype("<u2") for c in crcs]
                n_words.append(words)
                n_features.append(sum(map(len, parts)))
                packed.append(b"".join(p.tobytes() for p in parts))
            yield {"doc_id": ids, "n_words": n_words, "n_features": n_features, "buckets": packed}

    return map_arrow(texts, each, "doc_id long, n_words long, n_features long, buckets binary")


def histogram(features: DataFrame, name: str, buckets: int = BUCKETS) -> DataFrame:
    """bucket and its number of features, from one row a bucket and task."""

    def each(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                total += np.bincount(np.frombuffer(packed, "<u2"), minlength=buckets)
        some = np.flatnonzero(total)
        yield {"bucket": some.tolist(), "n": total[some].tolist()}

    return map_arrow(features.select("buckets"), each, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias(name))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain: thousandths of the smoothed log ratio of the bucket's shares in the target and in the corpus."""
    spark = corpus.sparkSession
    both = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(histogram(corpus, "s", buckets), "bucket", "left").join(histogram(target, "t", buckets), "bucket", "left").fillna(0)
    whole = Window.partitionBy(F.lit(0))  # one row a bucket
    s, t, b = F.col("s").cast("double"), F.col("t").cast("double"), F.lit(float(buckets))
    totals = [F.sum(c).over(whole).cast("double") + b for c in ("s", "t")]
    return both.select("bucket", F.floor(F.lit(1000.0) * F.log((t + 1) * totals[0] / ((s + 1) * totals[1]))).cast("long").alias("gain"))


def weights(features: DataFrame, gained: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """features with the sum of their buckets' gains as weight."""
    by_bucket = np.zeros(buckets, np.int64)
    for row in gained.collect():  # one row a bucket
        by_bucket[row.bucket] = row.gain

    def each(batches):
        for batch in batches:
            sums = [int(by_bucket[np.frombuffer(p, "<u2")].sum()) for p in batch.column(3).to_pylist()]
            yield {"doc_id": batch.column(0), "n_words": batch.column(1), "n_features": batch.column(2), "weight": sums}

    return map_arrow(features.select("doc_id", "n_words", "n_features", "buckets"), each, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel variate that follows from the seed and the doc_id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), ).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def _places(scored: DataFrame, draw: int) -> DataFrame:
    """scored with rank: the place by score, then doc_id, of the first ``draw``; null for the others."""
    order = [F.col("score").desc(), F.col("doc_id").asc(), F.col("n_features").asc(), F.col("weight").asc()]
    ranged = stored(scored.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "draw")
    totals = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a range
    placed = ranged.join(F.broadcast(totals.select("part", before.alias("before"))), "part")
    near = placed.where(F.col("before") < draw)
    place = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(*order))
    drawn = near.withColumn("rank", place).withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    return drawn.unionByName(placed.where(F.col("before") >= draw).withColumn("rank", F.lit(None).cast("long"))).drop("part", "before")


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, run: int = RUN, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every document.

    The highest scores (weight plus noise) among documents of at least ``min_words`` words are drawn, ``percent`` in a
    hundred of them; rank counts them from 1 and is null for the rest.
    """
    features = stored(bucketed(documents(docs), buckets, run), "features", "zstd")
    wanted = bucketed(target.select(F.lit(0).cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")), buckets, run)
    scored = stored(weights(features, gains(features, wanted, buckets), buckets).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored")
    enough = F.col("n_words") >= min_words
    draw = percent * scored.where(enough).count() // 100
    rest = scored.where(~enough).withColumn("rank", F.lit(None).cast("long"))
    return _places(scored.where(enough), draw).unionByName(rest)


def drawn_documents(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of docs whose doc_id is drawn, all columns as they are."""
    ids = resampled(docs, target, **options).where("rank IS NOT NULL").select(F.col("doc_id").alias("__drawn")).distinct()
    return docs.join(ids, F.col("doc_id").cast("long").eqNullSafe(F.col("__drawn")), "left_semi")
