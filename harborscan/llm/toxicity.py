"""Toxicity: a support vector machine over a subsequence string kernel, with Nystroem landmarks.

The kernel of two words sums, over all character subsequences of three or four letters that both hold within a short
span, the product of their weights; a weight falls by DECAY for each character skipped, so that gapped and inserted
characters cost little. It is divided by both words' lengths in the same sense. Words of a bounded sample of labelled
documents, cut out of their sentences, are the training instances: an insult makes a document toxic, so the instances of
toxic documents are found by rounds (first by how much more often toxic documents hold a word, then by the machine's own
choice), against random and hardest words of clean documents. Landmarks span the space in which the linear machine is
fitted; since its function is a sum over landmarks, it folds into one weight for each subsequence, and a whole text is
scored with table lookups over all its characters. A document's score is the logistic of a soft maximum of its two
highest distinct words, letters' case apart, in fitting and in use alike: repeating a word adds nothing.

Fitting takes at most SAMPLE labelled documents and SAMPLE_BYTES of text a class, by hash order of doc_id, near copies
left out, inside one task; the model is a table of fixed size, which is broadcast. Labels, language, source and doc_id
are no inputs of a score.

Defined cases: null and empty texts have the score of a text without words; a document with several labels is toxic if
any says so; null labels are left out; without labels of both classes every document scores 0; repeated documents each
give a row.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from heapq import nlargest
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from harborscan.llm.common import documents, filter_arrow, map_arrow

THRESHOLD = 0.7
SAMPLE = 2000
#: Text bytes of each class in the sample; one document of over a sixteenth of that is no training row.
SAMPLE_BYTES = 16 << 20
DECAY = 0.5
LANDMARKS = 320
ROUNDS = 5
#: Of the soft maximum over a text's two highest words.
SHARPNESS = 4
#: Words whose value a task remembers.
CACHE_WORDS = 500_000
_NONE = -1.0
#: Shorter words hold too few subsequences to tell anything, and count as clean.
MIN_LETTERS = 4
#: Offsets of the letters after the first, and their weights.
PATTERNS = [(c, DECAY ** (c[-1] - k + 1)) for k, reach in ((3, 4), (4, 5)) for c in combinations(range(1, reach + 1), k - 1)]
_REACH = 6


def _classes() -> np.ndarray:
    """Code point -> class: 0 white space, 1-26 letters without accents, 27 digits, 28 other letters, 29 marks."""
    out = np.full(0x2000, 29, np.int32)
    for c in range(len(out)):
        ch = chr(c)
        base = unicodedata.normalize("NFKD", ch)[0].lower()
        out[c] = 0 if ch.isspace() else ord(base) - 96 if "a" <= base <= "z" else 27 if ch.isdigit() else 28 if ch.isalpha() else 29
    return out


_CLASS = _classes()


def characters(text: bytes | None) -> np.ndarray:
    points = np.frombuffer((text or b"").decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    return np.where(points < len(_CLASS), _CLASS[np.minimum(points, len(_CLASS) - 1)], np.where(points < 0x2010, 29, 28)).astype(np.int32)


def _marked(words: list[str]) -> np.ndarray:
    """The characters of the words, each on a line; one that is cut or empty still counts as a word."""
    return characters("\n".join([f".{w}" for w in words]).encode())


class Layout:
    """Words of a text, and where each pattern fits inside one."""

    def __init__(self, chars: np.ndarray):
        self.chars = np.concatenate([chars, np.zeros(_REACH, np.int32)])
        n = len(chars)
        solid = self.chars[:n] > 0
        edge = np.flatnonzero(np.diff(np.concatenate([[0], solid.view(np.int8), [0]])))
        self.starts, self.ends = edge[::2], edge[1::2]
        self.left = np.repeat(self.ends, self.ends - self.starts)
        self.at = np.flatnonzero(solid)
        self.left = np.minimum(self.left - self.at, _REACH)
        self.first = np.concatenate([[0], np.cumsum(self.ends - self.starts)[:-1]]) if len(self.starts) else np.zeros(0, np.int64)
        self.letter = (self.chars > 0) & (self.chars != 29)

    def subsequences(self):
        """(places among self.at, index into the tables, weight) of each pattern."""
        for offsets, weight in PATTERNS:
            fits = np.flatnonzero(self.left > offsets[-1])
            at = self.at[fits]
            key = self.chars[at]
            good = self.letter[at]
            for o in offsets:
                key = key * 32 + self.chars[at + o]
                good = good & self.letter[at + o]
            yield fits[good], key[good] + (32**3 if len(offsets) == 3 else 0), weight

    def norms(self) -> np.ndarray:
        """Each word's length in the kernel: by how many patterns fit."""
        per = np.array([sum(w * w for o, w in PATTERNS if o[-1] < d) for d in range(_REACH + 1)])
        return np.sqrt(np.maximum(np.add.reduceat(per[self.left], self.first), 1e-9)) if len(self.first) else np.zeros(0)


TABLE = 32**3 + 32**4


def combined(top: list[float]) -> float:
    """A soft maximum of a text's two highest distinct words: the highest alone can decide, a second one adds to it."""
    return top[0] + math.log1p(math.exp(SHARPNESS * (top[1] - top[0]))) / SHARPNESS


class Model:
    """One weight for each subsequence, the machine's offset, and the logistic's two numbers."""

    def __init__(self, weights: np.ndarray, offset: float, slope: float, shift: float):
        self.weights, self.offset, self.slope, self.shift = weights, offset, slope, shift

    def words(self, layout: Layout) -> np.ndarray:
        if not len(layout.starts):
            return np.zeros(0)
        score = np.zeros(len(layout.at))
        for places, keys, weight in layout.subsequences():
            score[places] += weight * self.weights[keys]
        return np.add.reduceat(score, layout.first) / layout.norms() + self.offset

    def values(self, names: list[str]) -> list[float]:
        """The machine's function of each word."""
        layout = Layout(_marked(names))
        long = layout.ends - layout.starts > MIN_LETTERS  # one more: the mark before each word
        return np.where(long, np.clip(self.words(layout), -2, 2), _NONE).tolist()

    def scores(self, texts: list[bytes | None]) -> list[float]:
        """Each text's score; distinct words are valued once and remembered."""
        known = self.__dict__.setdefault("known", {})
        cut = [set(t.decode("utf-8", "replace").lower().split()) if t else set() for t in texts]
        new = [w for w in set().union(*cut) if w not in known]
        if len(known) + len(new) > CACHE_WORDS:
            known.clear()
            new = list(set().union(*cut))
        for k in range(0, len(new), 50_000):
            some = new[k : k + 50_000]
            known.update(zip(some, self.values(some), strict=True))
        return [self.probability(nlargest(2, map(known.__getitem__, x))) for x in cut]

    def forget(self) -> None:
        """Drop the remembered words: the model outlives the task that met them."""
        self.__dict__.pop("known", None)

    def probability(self, top: list[float]) -> float:
        top = (top + [_NONE, _NONE])[:2]
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.slope * combined(top) + self.shift))))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "known"}


def _features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, key, value) of all subsequences of words; each word's vector has the kernel's length."""
    layout = Layout(_marked(words))
    owner = np.repeat(np.arange(len(layout.starts)), layout.ends - layout.starts)
    norms, rows, keys, values = layout.norms(), [], [], []
    for places, key, weight in layout.subsequences():
        rows.append(owner[places])
        keys.append(key)
        values.append(weight / norms[owner[places]])
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(values)


def _kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    r, k, v = _features(landmarks)
    names, column = np.unique(k, return_inverse=True)
    dense = np.zeros((len(names), len(landmarks)))
    np.add.at(dense, (column, r), v)
    out = np.zeros((len(words), len(landmarks)))
    for at in range(0, len(words), 250):
        r, k, v = _features(words[at : at + 250])
        place = np.minimum(np.searchsorted(names, k), len(names) - 1)
        hit = names[place] == k
        order = np.argsort(r[hit], kind="stable")
        rows, parts = r[hit][order], dense[place[hit][order]] * v[hit][order][:, None]
        if len(rows):
            begin = np.flatnonzero(np.diff(rows, prepend=-1))
            out[at + rows[begin]] = np.add.reduceat(parts, begin, axis=0)
    return out


def _svm(z: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Squared-hinge machine by Newton steps; the last column of z is the constant."""
    w = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-3

    def loss(w: np.ndarray) -> float:
        slack = np.maximum(0, 1 - y * (z @ w))
        return float(penalty @ (w * w) + cost @ (slack * slack))

    now = loss(w)
    for _ in range(60):
        active = y * (z @ w) < 1
        za = z[active] * cost[active][:, None]
        step = np.linalg.solve(za.T @ z[active] + np.diag(penalty), za.T @ y[active]) - w
        size = 1.0
        while size > 1e-4 and loss(w + size * step) >= now:
            size /= 2
        if size <= 1e-4:
            break
        w = w + size * step
        now = loss(w)
    return w


def _altered(word: str, rng: np.random.Generator) -> str:
    """The word with one or more inserted characters."""
    if len(word) < 4:
        return word
    if rng.random() < 0.3:
        return str(rng.choice(list(".-*_"))).join(word)
    cut = int(rng.integers(1, len(word)))
    return word[:cut] + str(rng.choice(list(".-*_xz0"))) + word[cut:]


def _without_copies(texts: list[tuple[str, int]]) -> list[tuple[frozenset[str], int]]:
    """Words of each text that is no near copy of an earlier one: by four smallest hashes of three-word runs."""
    seen, out, same = set(), [], {}
    for text, label in texts:
        words = text.lower().split()
        runs = {" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))}
        marks = [(k, min((xxhash.xxh64_intdigest(r, k) for r in runs), default=0)) for k in range(4)]
        if sum(m in seen for m in marks) < 2:
            out.append((frozenset(same.setdefault(w, w) for w in words), label))
        seen.update(marks)
    return out


def fit_texts(texts: list[tuple[str, int]], seed: int = 7) -> Model:
    """A model from (text, 0 or 1)."""
    rng = np.random.default_rng(seed)
    docs = _without_copies(texts)
    toxic, clean = [w for w, t in docs if t], [w for w, t in docs if not t]
    if not toxic or not clean:
        return Model(np.zeros(TABLE, np.float32), _NONE, 0.0, -50.0)
    in_toxic, in_clean = Counter(w for d in toxic for w in d), Counter(w for d in clean for w in d)
    n1, n0 = len(toxic), len(clean)

    def lead(w: str) -> float:
        p1, p0 = in_toxic[w] / n1, in_clean[w] / n0
        p = (in_toxic[w] + in_clean[w] + 1) / (n1 + n0 + 2)
        return (p1 - p0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))

    least = max(2, n1 // 100)  # a word that fewer toxic documents hold may be there by chance
    candidates = sorted((w for w, n in in_toxic.items() if n >= least and len(w) > 3 and in_clean[w] / n0 < 0.1 * n / n1), key=lambda w: (-lead(w), w))
    positives = candidates[:400] or sorted(in_toxic)[:50]
    plain = sorted(in_clean, key=lambda w: (xxhash.xxh64_intdigest(w), w))
    negatives = plain[:6000]
    every_clean = plain[:60_000]
    model = None
    for _ in range(ROUNDS):
        extra = [_altered(w, rng) for w in positives]
        words = positives + extra + negatives
        y = np.array([1.0] * (len(positives) + len(extra)) + [-1.0] * len(negatives))
        cost = np.where(y > 0, 0.5 * len(y) / (y > 0).sum(), 0.5 * len(y) / (y < 0).sum())
        marks = positives[: LANDMARKS // 2] + negatives[-LANDMARKS // 4 :] + negatives[: LANDMARKS // 4]
        own = _kernel(marks, marks)
        values, vectors = np.linalg.eigh(own)
        good = values > 1e-6 * values[-1]
        root = vectors[:, good] / np.sqrt(values[good])
        z = np.hstack([_kernel(words, marks) @ root, np.ones((len(words), 1))])
        w = _svm(z, y, cost)
        alpha = root @ w[:-1]
        r, k, v = _features(marks)
        weights = np.zeros(TABLE, np.float32)
        np.add.at(weights, k, (v * alpha[r]).astype(np.float32))
        model = Model(weights, float(w[-1]), 1.0, 0.0)
        chosen: Counter[str] = Counter()
        for d in toxic:
            names = sorted(d)
            f = model.words(Layout(_marked(names)))
            for i in np.argsort(-f)[:3]:
                if f[i] > 0 and in_toxic[names[i]] >= least and in_clean[names[i]] / n0 < 0.1 * in_toxic[names[i]] / n1:
                    chosen[names[i]] += 1
        f = model.words(Layout(_marked(every_clean)))
        hard = [every_clean[i] for i in np.argsort(-f)[:3000]]
        kept = [w for w, _ in chosen.most_common(1500)]
        positives = kept or positives
        negatives = list(dict.fromkeys(plain[:4000] + hard))
    value = {}
    names = sorted({w for d, _ in docs for w in d})
    for k in range(0, len(names), 50_000):
        value.update(zip(names[k : k + 50_000], model.values(names[k : k + 50_000]), strict=True))
    margins = np.array([combined((nlargest(2, map(value.__getitem__, d)) + [_NONE, _NONE])[:2]) for d, _ in docs])
    labels = np.array([t for _, t in docs], float)
    weight = np.where(labels > 0, 0.5 / max(labels.sum(), 1), 0.5 / max((1 - labels).sum(), 1)) * len(labels) * 0.5 + 0.5
    a, b = 3.0, 0.0
    for _ in range(200):  # logistic on the margins; where they separate the classes, its prior holds the slope near 3
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g, h = weight * (p - labels), weight * p * (1 - p) + 1e-6
        hess = np.array([[h @ (margins * margins) + 1, h @ margins], [h @ margins, h.sum() + 0.1]])
        step = np.clip(np.linalg.solve(hess, [g @ margins + (a - 3), g.sum() + 0.1 * b]), -0.5, 0.5)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    model.slope, model.shift = float(a), float(b)
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fitted in one task on at most ``sample`` documents of each class whose checksum is not the held-out one.

    The sample is bounded in bytes too, so that the task's memory is; the driver gets the finished model only.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    marks = marks.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = marks.where("toxic = 1").orderBy(*order).limit(sample).unionAll(marks.where("toxic = 0").orderBy(*order).limit(sample))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")
    # A doc_id on many rows counts once, with its smallest text: partial sums keep the shuffle small.
    rows = rows.where(F.octet_length("text") <= SAMPLE_BYTES // 16).groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    so_far = F.sum(F.octet_length("text")).over(Window.partitionBy("toxic").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    bounded = rows.withColumn("so_far", so_far).where(F.col("so_far") <= SAMPLE_BYTES).select("doc_id", "toxic", "text")

    def each(batches):
        held = sorted((i, t, int(y)) for b in batches for i, y, t in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True))
        m = fit_texts([(t, y) for _, t, y in held])
        yield {"weights": [m.weights.tobytes()], "offset": [m.offset], "slope": [m.slope], "shift": [m.shift]}

    got = map_arrow(bounded.coalesce(1), each, "weights binary, offset double, slope double, shift double").first()
    return Model(np.frombuffer(got.weights, np.float32), got.offset, got.slope, got.shift) if got else fit_texts([])


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))

    def each(batches):
        for b in batches:
            yield {"doc_id": b.column(0), "score": model.value.scores(b.column(1).to_pylist())}
        model.value.forget()

    scored = map_arrow(documents(docs), each, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents, all their columns, that score below the threshold."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))
    return filter_arrow(docs, lambda texts: [x < THRESHOLD for x in model.value.scores(texts)], done=lambda: model.value.forget())
