"""N-gram Jaccard join: prefix filters under several global token orders, intersected before verification.

A document's set is its distinct five-word shingles, hashed to 64 bits. Equal sets are one node, named by a 128-bit
digest of the set, so exact copies never meet as pairs. Two sets of similarity t or more share a token among the first
n - ceil(t n) + 1 tokens of each, whatever the global order:

* The first order puts rare tokens first, by a sketch of fixed size over all documents: it counts the tokens that repeat
  within a batch of a task, so that only what may be frequent travels. Each prefix token is a posting; postings are
  packed into arrays for each token range and batch of documents, and dealt by range. A posting names its node by 64
  bits: nodes that share them are candidates alike. It also tells where the token stands in its node's order: two sets
  have no more in common than follows from their first common token on, so pairs that only later tokens join are none.
* The further orders are plain hash orders. Each node carries its prefixes under them, 16 bits a token. A candidate
  pair whose prefixes share none under one of the orders goes before any text is read: the filters are intersected.

Sizes filter too, and so does a signature of at least one bit a token, each the parity of a node's tokens there: sets
differ in at least as many tokens as signatures in bits. Halves of a long signature, one upon the other, are a short one.

Tokens whose lists hold the same nodes give one list. In a list of up to SMALL_LIST nodes all pairs are candidates; of a
longer one, pairs with a hub (the node with most shared tokens) first. Links found join nodes into components, and
lists whose nodes are in one component are done. Of the candidates left by the filters, each node's partner with the
most candidates comes first; the others only if that has not joined them. In each further round some nodes outside a list's largest component are
hubs and meet the whole list, which is dealt in shares of LIST_SHARE nodes; then they leave it. Once no node outside the
largest component is left, every candidate pair has been verified or lies within a component. So a group of copies costs
about one verification a member, and no link between components is lost. Verification gathers the texts of candidates by
hub and compares their whole sets.

Components come from large-star and small-star rounds on tables in the shared folder.

Defined cases: null, empty and wordless texts have the empty set, are linked with nothing, and are their own component;
a text of fewer than five words has its whole sequence as one shingle; rows that repeat a doc_id are joined by their own
texts; rows with a null doc_id are linked like all others (their texts are kept beside their sets, since no key leads to
them), and their component_id is null where no row of the component has a doc_id.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from harborscan.llm.common import Tables, documents, map_arrow, small_batches

SHINGLE = 5
#: Similarity as a fraction of whole numbers: intersection * SIMILAR[1] >= union * SIMILAR[0].
SIMILAR = (3, 4)
#: Counters of the frequency sketch, the slices in which tasks hand it on, and the tokens of a task's batch.
SKETCH, SLICES, SKETCH_TOKENS = 1 << 24, 32, 2_000_000
SIGNATURE_BITS = 512
#: Salts of the further orders.
ORDERS = (0x5851F42D, 0x14057B7E)
SMALL_LIST = 8
#: Postings a token range has on average.
RANGE_POSTINGS = 1_000_000
BATCH_POSTINGS = 300_000
#: Members that are compared with one hub in one group, nodes of a list that are compared with its hubs in one group,
#: rows of pairs or of a list that are handed on at once.
HUB_SHARE, LIST_SHARE, LIST_ROWS = 2000, 2000, 8192
#: Sizes in postings stop here.
MOST_SIZE = 65535
#: Bits of the map that says which keys are wanted: 4 MB whatever the input; full maps let more rows through.
WANTED_BITS = 1 << 25
#: Names that a task remembers as seen.
SEEN_NAMES = 300_000

_WORDS: dict[bytes, int] = {}
#: Odd factors of the words of a shingle, by place.
_MULTIPLIERS = [(0x9E3779B97F4A7C15 * (2 * j + 1)) % 2**64 | 1 for j in range(1, SHINGLE + 1)]


def _word_hash(word: bytes) -> int:
    found = _WORDS.get(word)
    if found is None:
        if len(_WORDS) > 150_000:
            _WORDS.clear()
        found = _WORDS[word] = xxhash.xxh64_intdigest(word)
    return found


def _mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = x ^ np.uint64(salt)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None) -> np.ndarray:
    """The sorted distinct hashes of the five-word shingles of a text (A-Z lower-cased, words between ASCII white space)."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    known = _WORDS.get
    ids = np.array([known(w) or _word_hash(w) for w in words], np.uint64)
    k = min(SHINGLE, len(ids))
    n = len(ids) - k + 1
    out = np.full(n, k, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out += ids[j : j + n] * np.uint64(_MULTIPLIERS[j])
    return np.unique(_mix(out))


def digest(tokens: np.ndarray) -> bytes:
    """A node's name: 128 bits of the set, the last never 0; the empty set's is empty."""
    if not len(tokens):
        return b""
    d = xxhash.xxh3_128_digest(tokens.tobytes())
    return d[:-1] + bytes([d[-1] | 1])


def short(name: bytes) -> int | None:
    return int.from_bytes(name[:8], "little", signed=True) if name else None


def prefix_length(n: int) -> int:
    return n - -(-n * SIMILAR[0] // SIMILAR[1]) + 1 if n else 0


def _smallest(keys: np.ndarray, count: int) -> np.ndarray:
    return np.argpartition(keys, count - 1)[:count] if count < len(keys) else np.arange(len(keys))


def signature(tokens: np.ndarray) -> bytes:
    """Parities of the tokens at as many bits as the set needs: a power of two, one bit a token or more."""
    bits = max(SIGNATURE_BITS, 1 << (len(tokens) - 1).bit_length())
    odd = np.bincount(((tokens >> np.uint64(24)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def folded(sign: np.ndarray, size: int) -> np.ndarray:
    """A signature at ``size`` words of 64 bits."""
    return np.bitwise_xor.reduce(sign.reshape(-1, size), axis=0)


def differing(a: bytes, b: bytes) -> int:
    """In how many bits two signatures differ, at the shorter one's length."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    size = min(len(x), len(y))
    return int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum())


def further_prefixes(tokens: np.ndarray) -> bytes:
    """The prefixes under the further orders, one after another: 16 bits of each token's key, sorted."""
    n = prefix_length(len(tokens))
    keys = [_mix(tokens, salt) for salt in ORDERS]
    return b"".join([np.sort(((np.partition(k, n - 1)[:n] if n < len(k) else k) & np.uint64(0xFFFF)).astype("<u2")).tobytes() for k in keys])


def share_all_orders(a: bytes, b: bytes) -> bool:
    """Whether two nodes' prefixes have a token in common under every further order (equal 16 bits count as one)."""
    x, y = np.frombuffer(a, "<u2").reshape(len(ORDERS), -1), np.frombuffer(b, "<u2").reshape(len(ORDERS), -1)
    return all((p[np.minimum(np.searchsorted(p, q), len(p) - 1)] == q).any() for p, q in zip(x, y, strict=True))


def sets(docs: DataFrame, tables: Tables) -> tuple[DataFrame, np.ndarray]:
    """doc_id, node, short and n of every document (stored), and the frequency sketch of all documents.

    The first row of a node in a task also has its signature and further prefixes, and its text if it has no doc_id.
    Only tokens that repeat within SKETCH_TOKENS tokens of a task add to the sketch. Counters stop at 65535 and are
    kept in sixteenths of powers of two: the sketch only orders tokens, and does not touch what is found.
    """
    empty = {"doc_id": [None] * SLICES, "node": [None] * SLICES, "short": [None] * SLICES, "n": [None] * SLICES, "signature": [None] * SLICES, "sign": [None] * SLICES, "orders": [None] * SLICES, "text": [None] * SLICES}

    def repeated(held: list[np.ndarray]) -> dict:
        tokens, times = np.unique(np.concatenate(held), return_counts=True)
        often = times > 1
        slots, order = (tokens[often] & np.uint64(SKETCH - 1)).astype("<u4"), None
        order = np.argsort(slots, kind="stable")
        slots, times = slots[order], np.minimum(times[often][order], 65535).astype("<u2")
        ends = np.searchsorted(slots, np.arange(1, SLICES + 1, dtype=np.uint64) * (SKETCH // SLICES))
        starts = [0, *ends[:-1]]
        return {**empty, "slice": list(range(SLICES)), "sketch": [slots[a:b].tobytes() + times[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]}

    def each(batches):
        held, size, seen = [], 0, set()
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            got = [shingles(t) for t in texts]
            names = [digest(s) for s in got]
            fresh = []
            for name in names:
                fresh.append(bool(name) and name not in seen)
                seen.add(name)
            signs = [signature(s) if f else None for s, f in zip(got, fresh, strict=True)]
            yield {
                "doc_id": b.column(0), "node": names, "short": [short(x) for x in names], "n": [len(s) for s in got],
                "signature": signs, "sign": [folded(np.frombuffer(x, np.uint64), SIGNATURE_BITS // 64).tobytes() if x and len(x) * 8 > SIGNATURE_BITS else None for x in signs],
                "orders": [further_prefixes(s) if f else None for s, f in zip(got, fresh, strict=True)],
                "text": [t if f and i is None else None for i, t, f in zip(ids, texts, fresh, strict=True)],
                "slice": [None] * len(got), "sketch": [None] * len(got),
            }
            if len(seen) > SEEN_NAMES:
                seen.clear()
            held += got
            size += sum(map(len, got))
            if size >= SKETCH_TOKENS:
                yield repeated(held)
                held, size = [], 0
        if held:
            yield repeated(held)
        _WORDS.clear()

    both = tables.put("sets", map_arrow(documents(docs), each, "doc_id long, node binary, short long, n long, signature binary, sign binary, orders binary, text binary, slice int, sketch binary"))
    scaled = np.minimum(np.rint(16 * np.log2(np.arange(65536) + 1.0)), 255).astype(np.uint8)
    width = SKETCH // SLICES

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n = len(x) // 6
                part = np.bincount(np.frombuffer(x, "<u4", n).astype(np.int64) - k * width, np.frombuffer(x, "<u2", n, 4 * n), minlength=width)
                total[k] = total[k] + part if k in total else part
        for k, x in total.items():
            yield {"slice": [k], "sketch": [scaled[np.minimum(x, 65535).astype(np.int64)].tobytes()]}

    parts = both.where("sketch IS NOT NULL AND octet_length(sketch) > 0").select("slice", "sketch")
    merged = np.zeros((SLICES, width), np.uint8)
    for row in map_arrow(parts.repartition(SLICES, "slice"), add, "slice int, sketch binary").toLocalIterator():
        merged[row[0]] = np.frombuffer(row[1], np.uint8)
    return both.where("slice IS NULL").drop("slice", "sketch"), merged.ravel()


def _rarity(tokens: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """Sort keys, rare tokens first; equal counts by a hash."""
    counts = sketch[(tokens & np.uint64(SKETCH - 1)).astype(np.int64)]
    return (counts.astype(np.uint64) << np.uint64(56)) | (_mix(tokens) >> np.uint64(8))


def prefix(tokens: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """The first tokens of a set in their order."""
    keys = _rarity(tokens, sketch)
    first = _smallest(keys, prefix_length(len(tokens)))
    return tokens[first[np.argsort(keys[first])]]


def places(n: int) -> np.ndarray:
    """Where each prefix token of a set of n stands, in thousandths of n, rounded down; 0 where n is not kept whole."""
    return (np.arange(prefix_length(n)) * (1000 if n < MOST_SIZE else 0) // n).astype(np.uint8)


def postings(docs: DataFrame, sketch, ranges: int) -> DataFrame:
    """For each token range and batch of documents: five bytes of each token, its node, its size (two bytes) and its place
    in that node (one byte).

    Tokens are cut to 40 bits besides their range, sizes stop at MOST_SIZE: both only let more candidates through.
    """

    def flush(held: list):
        length = [len(h[0]) for h in held]
        tokens = np.concatenate([h[0] for h in held])
        nodes = np.repeat(np.array([short(h[1]) for h in held], np.int64), length)
        sizes = np.repeat(np.minimum([h[2] for h in held], MOST_SIZE).astype(np.uint16), length)
        stands = np.concatenate([places(h[2]) for h in held])
        where = ((tokens >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
        order = np.argsort(where, kind="stable")
        cuts = np.flatnonzero(np.diff(where[order].astype(np.int64), prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
            part = order[a:b]
            yield {"range": [int(where[part[0]])], "tokens": [np.ascontiguousarray(tokens[part].view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()], "nodes": [nodes[part].tobytes()], "sizes": [sizes[part].tobytes()], "places": [stands[part].tobytes()]}

    def each(batches):
        held, size, seen = [], 0, set()
        for b in batches:
            for text in b.column(1).to_pylist():
                s = shingles(text)
                name = digest(s)
                if not len(s) or name in seen:
                    continue
                if len(seen) > SEEN_NAMES:
                    seen.clear()
                seen.add(name)
                first = prefix(s, sketch.value)
                held.append((first, name, len(s)))
                size += len(first)
                if size >= BATCH_POSTINGS:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)
        _WORDS.clear()

    return map_arrow(documents(docs), each, "range int, tokens binary, nodes binary, sizes binary, places binary")


def reaches(meta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows (node, size, place) of one token: weight and reach. Two of them may be similar with this as their first
    common token if neither's weight is beyond the other's reach.

    What two sets have in common is no more than either has from that token on, and must be SIMILAR[0] / (SIMILAR[0] +
    SIMILAR[1]) of both sizes.
    """
    weight = 1000 * SIMILAR[0] * meta[:, 1]
    return weight, (SIMILAR[0] + SIMILAR[1]) * meta[:, 1] * (1000 - meta[:, 2]) - weight


def partnered(weight: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Which rows of one token may be similar to another one of them."""
    order = np.argsort(weight, kind="stable")
    w, r = weight[order], reach[order]
    best = np.maximum.accumulate(r)
    second = np.concatenate([[-1], np.maximum.accumulate(np.minimum(r[1:], best[:-1]))])
    upto = np.searchsorted(w, r, side="right") - 1  # the last that the row reaches
    other = np.where((np.arange(len(w)) <= upto) & (r == best[upto]), second[upto], best[upto])
    out = np.zeros(len(w), bool)
    out[order] = (upto >= 0) & (other >= w)
    return out


def _pairs_of(meta: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Candidate pairs (node, node) of several lists of one length: rows has a list's rows of meta in each line."""
    weight, reach = reaches(meta)
    out = [np.zeros((0, 2), np.int64)]
    for i in range(rows.shape[1]):
        for j in range(i + 1, rows.shape[1]):
            a, b = rows[:, i], rows[:, j]
            ok = (weight[a] <= reach[b]) & (weight[b] <= reach[a])
            out.append(np.column_stack([meta[a[ok], 0], meta[b[ok], 0]]))
    return np.concatenate(out)


def _lists_of(tokens: np.ndarray, meta: np.ndarray, small: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct candidate pairs of the lists of up to ``small`` nodes (node, size, place) with a common token and of each
    longer list's hub, and the nodes of the longer lists, the hub first."""
    order = np.lexsort((meta[:, 2], meta[:, 0], tokens))
    tokens, meta = tokens[order], meta[order]
    fresh = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (meta[1:, 0] != meta[:-1, 0])])
    tokens, meta = tokens[fresh], meta[fresh]
    start = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    length = np.diff(np.append(start, len(tokens)))
    pairs = [np.zeros((0, 2), np.int64), *(_pairs_of(meta, start[length == n][:, None] + np.arange(n)) for n in range(2, small + 1))]
    distinct: dict[bytes, np.ndarray] = {}
    for a, n in zip(start[length > small], length[length > small], strict=True):
        rows = meta[a : a + n]
        known = distinct.setdefault(rows[:, 0].tobytes(), rows)
        if known is not rows:  # the same nodes at another token: the first place counts
            known[:, 2] = np.minimum(known[:, 2], rows[:, 2])
    long, weight = [], Counter()
    for rows in distinct.values():
        rows = rows[partnered(*reaches(rows))]
        if len(rows) > small:
            long.append(rows)
            weight.update(rows[:, 0].tolist())
        elif len(rows) > 1:
            pairs.append(_pairs_of(rows, np.arange(len(rows))[None]))
    out = []
    for rows in long:
        names = rows[:, 0].tolist()
        hub = max(range(len(names)), key=[weight[x] for x in names].__getitem__)
        w, r = reaches(rows)
        ok = (w <= r[hub]) & (w[hub] <= r)
        ok[hub] = False
        pairs.append(np.column_stack([np.full(ok.sum(), rows[hub, 0]), rows[ok, 0]]))
        out.append(np.concatenate([rows[hub : hub + 1, 0], np.delete(rows[:, 0], hub)]))
    return np.unique(np.concatenate(pairs), axis=0), out


def _shared(parts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The postings (token; node, size, place) of one range whose token stands in several of them: most stand in one only,
    and nothing else of those is unpacked."""
    cut = np.concatenate([np.frombuffer(x[0], np.uint8).reshape(-1, 5) for x in parts])
    tokens = np.zeros(len(cut), np.uint64)
    tokens.view(np.uint8).reshape(-1, 8)[:, :5] = cut
    del cut
    order = np.argsort(tokens)
    same = np.diff(tokens[order]) == 0
    several = np.zeros(len(tokens), bool)
    several[order[1:][same]] = several[order[:-1][same]] = True
    del order, same
    columns = (np.concatenate([np.frombuffer(x[k], kind) for x in parts])[several].astype(np.int64) for k, kind in ((1, np.int64), (2, np.uint16), (3, np.uint8)))
    return tokens[several], np.column_stack(list(columns))


def lists(dealt: DataFrame) -> DataFrame:
    """What nodes that share a prefix token have to be compared, named by 64 bits. Rows of candidate pairs (hub, member):
    all of short lists, the hub's of long ones. Rows of long lists (id, short): their other nodes. A task holds its ranges,
    of bounded size."""
    small = SMALL_LIST

    def each(batches):
        held = defaultdict(list)
        for b in batches:
            for r, *x in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                held[r].append(x)
        for r in list(held):
            tokens, meta = _shared(held.pop(r))
            if not len(tokens):
                continue
            pairs, long = _lists_of(tokens, meta, small)
            for k in range(0, len(pairs), LIST_ROWS):
                p = pairs[k : k + LIST_ROWS]
                yield {"hub": pa.array(p[:, 0]), "member": pa.array(p[:, 1]), "id": pa.nulls(len(p), pa.int64()), "short": pa.nulls(len(p), pa.int64())}
            if long:
                idents = np.repeat(np.array([xxhash.xxh3_64_intdigest(np.sort(x).tobytes()) >> 1 for x in long], np.int64), [len(x) - 1 for x in long])
                names = np.concatenate([x[1:] for x in long])  # the hub's pairs are among the candidates
                for k in range(0, len(names), LIST_ROWS):
                    x = names[k : k + LIST_ROWS]
                    yield {"hub": pa.nulls(len(x), pa.int64()), "member": pa.nulls(len(x), pa.int64()), "id": pa.array(idents[k : k + LIST_ROWS]), "short": pa.array(x)}

    return map_arrow(dealt, each, "hub long, member long, id long, short long")


def only_wanted(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows whose key may be among the wanted ones (a column of the same name), told by a broadcast map of
    WANTED_BITS bits: most others never reach a shuffle. A join must follow."""
    place = F.pmod(F.xxhash64(key), F.lit(WANTED_BITS)) + 1
    bits = wanted.select(place.alias("k")).groupBy(F.bitmap_bucket_number("k").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("k")).alias("__bits"))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring(F.col("__bits"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return rows.join(F.broadcast(bits), F.bitmap_bucket_number(place) == F.col("__bucket")).where(F.getbit(byte, at % 8) == 1).drop("__bucket", "__bits")


def _close(hub: tuple, sizes: np.ndarray, signatures: np.ndarray) -> np.ndarray:
    """Which nodes may be similar to the hub (size, signature), by sizes and by the bits in which signatures differ."""
    size, sign = hub
    ok = np.minimum(sizes, size) * SIMILAR[1] >= np.maximum(sizes, size) * SIMILAR[0]
    differ = np.bitwise_count(signatures ^ sign).sum(axis=1).astype(np.int64)
    # intersection >= t union means: differing tokens <= (1 - t) / (1 + t) of both sizes.
    return ok & (differ * (SIMILAR[1] + SIMILAR[0]) <= (sizes + size) * (SIMILAR[1] - SIMILAR[0]))


def _signs(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, SIGNATURE_BITS // 64)


def screened(pairs: DataFrame, named: DataFrame, by: str) -> DataFrame:
    """The pairs (hub, member) whose sizes, signatures and prefixes under every further order allow similarity, by whole
    names. ``by``: the column of named (node or short) that names them in pairs."""
    n = named.select(F.col(by).alias("by"), "node", "n", "signature", "orders")
    both = pairs.join(n.toDF("hub", "hub_node", "hn", "hs", "ho"), "hub").join(n.toDF("member", "member_node", "mn", "ms", "mo"), "member").where("hub_node <> member_node").select("hub_node", "member_node", "hn", "mn", "hs", "ms", "ho", "mo")

    def similar(n: int, m: int, hs: bytes, ms: bytes, ho: bytes, mo: bytes) -> bool:
        # intersection >= t union means: differing tokens <= (1 - t) / (1 + t) of both sizes.
        close = min(n, m) * SIMILAR[1] >= max(n, m) * SIMILAR[0] and share_all_orders(ho, mo)
        return close and differing(hs, ms) * (SIMILAR[1] + SIMILAR[0]) <= (n + m) * (SIMILAR[1] - SIMILAR[0])

    def each(batches):
        for b in batches:
            ok = pa.array([similar(*x) for x in zip(*(b.column(k).to_pylist() for k in range(2, 8)), strict=True)], pa.bool_())
            yield {"hub": b.column(0).filter(ok), "member": b.column(1).filter(ok)}

    return map_arrow(both, each, "hub binary, member binary")


def nearest(pairs: DataFrame) -> DataFrame:
    """Of candidate pairs, each node with its partner of the most candidates: hub, member. At most one pair a node, and
    in a group that shares a hub enough to join all of it."""
    both = pairs.select(F.col("hub").alias("a"), F.col("member").alias("b")).unionAll(pairs.select("member", "hub")).distinct()
    wanted = both.groupBy("a").agg(F.count("*").alias("c")).select(F.col("a").alias("b"), "c")
    return both.join(wanted, "b").groupBy("a").agg(F.max(F.struct("c", "b")).alias("m")).select(F.col("m.b").alias("hub"), F.col("a").alias("member"))


def unjoined(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The candidate pairs whose nodes are in different components."""
    a, b = roots.toDF("hub", "hub_root"), roots.toDF("member", "member_root")
    told = pairs.join(a, "hub", "left").join(b, "member", "left")
    return told.where(F.coalesce("hub_root", "hub") != F.coalesce("member_root", "member")).select("hub", "member")


def next_candidates(left: DataFrame, roots: DataFrame, hubs: int, tables: Tables) -> DataFrame:
    """Of lists (id, node, size, signature) whose nodes lie in several components: about ``hubs`` nodes outside a list's
    largest component, by hash, with their candidates in other components (hub, member), and the rows that stay for
    later rounds (id, node)."""
    known = left.join(roots, "node", "left").select("id", "node", "size", F.coalesce("root", "node").alias("root"), "signature")
    parts = known.groupBy("id", "root").agg(F.count("*").alias("c"))
    shape = parts.groupBy("id").agg(F.sum("c").alias("rows"), F.max(F.struct("c", "root")).alias("most"), F.count("*").alias("parts")).where("parts > 1")
    shape = tables.put("shape", shape.select("id", "rows", F.col("most.root").alias("most"), (F.col("rows") - F.col("most.c")).alias("outside")))
    told = known.join(shape, "id").withColumn("is_hub", (F.col("root") != F.col("most")) & (F.pmod(F.xxhash64("node", F.lit(hubs)), F.greatest("outside", F.lit(1))) < hubs))
    shares = F.ceil(F.col("rows") / LIST_SHARE).cast("int")
    columns = ["id", "node", "size", "root", "signature"]
    members = told.select(*columns, "is_hub", F.pmod(F.xxhash64("node"), shares).cast("int").alias("share"), F.lit(1).alias("side"), "outside")
    heads = told.where("is_hub").select(*columns, "is_hub", F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"), F.lit(0).alias("side"), "outside")
    grouped = heads.unionByName(members).repartition("id", "share").sortWithinPartitions("id", "share", "side")

    def one(ident: int, part: dict):
        head, rest = part["side"] == 0, part["side"] == 1
        names, sizes, parts, signs = part["node"][rest], part["size"][rest], part["root"][rest], part["sign"][rest]
        is_hub = part["hub"][rest]
        pairs = []
        for name, size, root, sign in zip(part["node"][head], part["size"][head], part["root"][head], part["sign"][head], strict=True):
            other = np.flatnonzero((parts != root) & (~is_hub | (names > name)))
            near = other[_close((size, sign), sizes[other], signs[other])]
            pairs += [(name, x) for x in names[near].tolist()]
        # A list all of whose outside nodes are hubs now is done.
        stay = names[~is_hub].tolist() if part["outside"][0] > hubs else []
        return {"hub": [a for a, _ in pairs] + [None] * len(stay), "member": [b for _, b in pairs] + [None] * len(stay), "id": [None] * len(pairs) + [ident] * len(stay), "node": [None] * len(pairs) + stay}

    def each(batches):
        now, held = None, []

        def whole():
            return one(now[0], {k: np.concatenate([x[k] for x in held]) for k in held[0]})

        for b in batches:
            if not b.num_rows:
                continue
            part = {"node": np.array(b.column(1).to_pylist(), "S16"), "size": b.column(2).to_numpy(), "root": np.array(b.column(3).to_pylist(), "S16"), "sign": _signs(b.column(4)), "hub": b.column(5).to_numpy(zero_copy_only=False), "side": b.column(7).to_numpy(), "outside": b.column(8).to_numpy()}
            ids, share = b.column(0).to_numpy(), b.column(6).to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(ids) != 0) | (np.diff(share) != 0)) + 1), len(ids)]
            for a, z in zip(cuts, cuts[1:]):
                key = (int(ids[a]), int(share[a]))
                if key != now and held:
                    yield whole()
                    held = []
                now = key
                held.append({k: x[a:z] for k, x in part.items()})
        if held:
            yield whole()

    return map_arrow(grouped, each, "hub binary, member binary, id long, node binary")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (hub, member) whose whole sets are similar: a, b. texts: node, text of every node in pairs.

    Members are dealt by hub, a hub's in shares of about HUB_SHARE, each share with the hub's text first.
    """
    sizes = pairs.groupBy("hub").agg(F.count("*").alias("c"))
    shared = pairs.join(sizes, "hub").select("hub", "member", F.pmod(F.xxhash64("member"), F.ceil(F.col("c") / HUB_SHARE)).cast("int").alias("share"))
    members = shared.join(texts.withColumnRenamed("node", "member"), "member").select("hub", "share", "member", "text")
    hubs = shared.select("hub", "share").distinct().join(texts.withColumnRenamed("node", "hub"), "hub").select("hub", "share", F.lit(None).cast("binary").alias("member"), "text")
    rows = members.unionByName(hubs).repartition("hub", "share").sortWithinPartitions("hub", "share", F.asc_nulls_first("member"))

    def each(batches):
        base, name = np.zeros(0, np.uint64), None
        for b in batches:
            found = []
            for hub, _, member, text in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                s = shingles(text)
                if digest(s) != (hub if member is None else member):
                    continue  # another row of the same doc_id
                if member is None:
                    base, name = s, hub
                elif name == hub:
                    common = int((base[np.minimum(np.searchsorted(base, s), len(base) - 1)] == s).sum())
                    if common * SIMILAR[1] >= (len(base) + len(s) - common) * SIMILAR[0]:
                        found.append((hub, member))
            yield {"a": [x[0] for x in found], "b": [x[1] for x in found]}
        _WORDS.clear()

    return map_arrow(rows, each, "a binary, b binary")


def _mark(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(links: DataFrame, tables: Tables, name: str) -> DataFrame:
    """node, root (the smallest name of its component) by large-star and small-star rounds, for links a, b; written as the
    table ``name``."""
    edges = tables.put("edges", links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = _mark(edges)
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        next_edges = tables.put("stars", small)
        tables.drop("edges")
        tables.paths["edges"] = tables.paths.pop("stars")
        edges, now = next_edges, _mark(next_edges)
        if now == before:
            tables.paths[name] = tables.paths.pop("edges")
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def linked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node, n of every document; node, root of every linked node)."""
    spark, tables = docs.sparkSession, Tables(docs.sparkSession)
    members, counts = sets(docs, tables)
    sketch = spark.sparkContext.broadcast(counts)  # 16 MB, whatever the input
    del counts
    total = members.agg(F.sum(F.floor(F.col("n") / 4) + 1)).first()[0] or 0
    ranges = int(max(spark.sparkContext.defaultParallelism, -(-total // RANGE_POSTINGS)))
    found = tables.put("lists", lists(postings(docs, sketch, ranges).repartition(ranges, "range")))
    sketch.destroy()
    first = tables.put("first", found.where("id IS NULL").select("hub", "member").distinct())
    waiting = tables.put("left", found.where("id IS NOT NULL").select("id", "short").distinct())
    tables.drop("lists")
    # One row for each node that any round may compare, and its text, dealt once by joins that are the same at every size.
    # The inner join keeps its place: a semi join would be pushed below the map, and deal all rows.
    ends = tables.put("ends", first.select(F.col("hub").alias("short")).unionAll(first.select("member")).unionAll(waiting.select("short")).distinct())
    rows = only_wanted(members.where("signature IS NOT NULL"), "short", ends).join(ends.hint("merge"), "short")
    named = tables.put("named", rows.groupBy("node").agg(*(f(c).alias(c) for c, f in (("doc_id", F.min), ("short", F.max), ("n", F.max), ("signature", F.max), ("sign", F.max), ("orders", F.max), ("text", F.max)))))
    members = tables.put("members", members.select("doc_id", "node", "n"))
    tables.drop("sets", "ends")
    pairs = tables.put("pairs", screened(first, named, "short"))
    tables.drop("first")
    left = waiting.join(named.select("short", "node"), "short").select("id", "node")
    used = pairs.select(F.col("hub").alias("node")).unionAll(pairs.select("member")).unionAll(left.select("node")).distinct()
    wanted = named.where("doc_id IS NOT NULL").select("node", "doc_id").join(used, "node", "left_semi")
    keyed = only_wanted(documents(docs), "doc_id", wanted).join(wanted.hint("merge"), "doc_id").select("node", "text")
    texts = tables.put("texts", keyed.unionAll(named.where("doc_id IS NULL").select("node", "text")), "zstd")
    roots, now, hubs = None, "left", 64

    def joined(pairs: DataFrame, roots: DataFrame | None, name: str) -> DataFrame:
        """The components after pairs are verified. What earlier rounds linked stands in their roots."""
        more = tables.put("links", verified(pairs, texts))
        if roots is not None:
            more = more.unionAll(roots.toDF("a", "b"))
        roots = components(more, tables, name)
        tables.drop("links")
        return roots

    roots = joined(nearest(pairs), None, "roots")
    rest = tables.put("rest", unjoined(pairs, roots))
    tables.drop("pairs")
    pairs, k = rest, 0
    while True:
        if not pairs.isEmpty():
            old = "roots" if not k else f"roots{k}"
            k += 1
            roots = joined(pairs, roots, f"roots{k}")
            tables.drop(old)
        tables.drop("rest")
        if left.isEmpty():
            tables.drop(now, "named", "texts")
            return members, roots  # each list's candidates are verified, or within a component
        signed = left.join(named.select("node", F.col("n").alias("size"), F.coalesce("sign", "signature").alias("signature")), "node")
        step = tables.put(f"round{hubs}", next_candidates(signed, roots, hubs, tables))
        tables.drop(now, "shape")
        now = f"round{hubs}"
        pairs = tables.put("rest", screened(step.where("hub IS NOT NULL").select("hub", "member").distinct(), named, "node"))
        left = step.where("hub IS NULL").select("id", "node")
        hubs *= 16


def _lowest(members: DataFrame, roots: DataFrame) -> DataFrame:
    """node, root and component_id (the smallest doc_id of the component, null if it has none) of every node with words."""
    first = members.where("octet_length(node) > 0").groupBy("node").agg(F.min("doc_id").alias("low")).join(roots, "node", "left").select("node", "low", F.coalesce("root", "node").alias("root"))
    return first.join(first.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("node", "root", "component_id")


def _components(members: DataFrame, lowest: DataFrame) -> DataFrame:
    return members.join(lowest.drop("root"), "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def ngram_components(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    members, roots = linked(docs)
    return _components(members, _lowest(members, roots))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents, all their columns, of which one of each component stays.

    That is the one with the smallest doc_id. Of rows that repeat a doc_id, those with equal texts are one. Rows with a
    null doc_id go where their component has a doc_id; of a component that has none, any one row stays. Texts without
    words are linked with nothing: such rows stay, but for repeated ones of one doc_id with equal texts.
    """
    members, roots = linked(docs)
    lowest = _lowest(members, roots)
    gone = _components(members, lowest).where("doc_id <> component_id").select(F.col("doc_id").alias("__key")).distinct()
    again = members.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__key")).agg(F.count("*").alias("c")).where("c > 1").select("__key")
    key = F.col("doc_id").cast("long")
    keyed = docs.where(key.isNotNull()).withColumn("__key", key)
    single = keyed.join(gone.unionAll(again), "__key", "left_anti").select(docs.columns)
    # Few rows: those of repeated doc_ids, then those without one, by the digest of their shingles.
    again = again.join(gone, "__key", "left_anti")
    repeated = only_wanted(keyed, "__key", again).join(again, "__key", "left_semi").withColumn("__text", F.sha2(F.col("text").cast("string").cast("binary"), 256))
    repeated = repeated.dropDuplicates(["__key", "__text"]).select(docs.columns)
    without = docs.where(key.isNull())

    def named(batches):
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).cast(pa.binary()).to_pylist()
            yield b.append_column("__node", pa.array([digest(shingles(t)) for t in texts], pa.binary()))

    small_batches(docs.sparkSession)
    unnamed = without.mapInArrow(named, T.StructType([*docs.schema.fields, T.StructField("__node", T.BinaryType())]))
    worded = unnamed.where("octet_length(__node) > 0").join(lowest.where("component_id IS NULL").select(F.col("node").alias("__node"), F.col("root").alias("__root")), "__node")
    alone = worded.dropDuplicates(["__root"]).drop("__node", "__root").unionByName(unnamed.where("octet_length(__node) = 0").drop("__node"))
    return single.unionByName(repeated).unionByName(alone)
