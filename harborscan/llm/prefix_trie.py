"""A trie of conversation prefixes: which first turns conversations share, and how many words that sharing saves.

Every turn becomes a digest at once, so texts are never shuffled. A prefix is named by its depth and the exclusive or of
its turns' hashes, each of which holds the turn's place: a running aggregate, which ranges of rows can work out apart from
each other. Turns are dealt into ranges by (conv_id, turn), so a conversation that holds a third of all rows is many tasks'
work; what ranges hand on is one row each.

A count-min sketch of all prefixes screens them. Its estimates are never too low, so an estimate of one proves that a single
conversation has the prefix, and with it all longer ones of that conversation: those nodes are emitted as they are. Only
prefixes that may be shared are grouped exactly. The sketch is one bit for each cell (whether it counts two or more), of
ROWS rows and at most MAX_WIDTH cells each, hence a bounded table to send; it grows with the number of prefixes up to that
bound, and beyond it more prefixes are grouped exactly, with the same result.

Sums over subtrees need no walk down the trie: a node's saving is credited to its smallest member at the node's depth, each
member adds up its credits from the end to each of its prefixes, and the members of a prefix are summed.

Defined cases: turns without a conv_id belong to no conversation and are left out; null roles and texts are empty; turns of
equal number go by the digest of role and text; repeated rows are turns of their own; without conversations there are no
nodes, not even a root. Remainders of negative conv_ids are SQL's. Columns beyond conv_id, turn, role and text play no part.
The identifiers of conversations that end at one node are joined in ascending chunks, and hashed as a stream.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from harborscan.llm.common import map_arrow, stored

GROUP, LENT = 20, 4
#: Rows of the sketch, and the least and most cells in a row (powers of two). A bit each is sent: 24 MB at most.
ROWS, MIN_WIDTH, MAX_WIDTH = 3, 1 << 16, 1 << 26
#: Identifiers in one chunk of those that end at a node.
CHUNK = 8192
WORD = r"[^\x20\x09-\x0D]+"
_NODE = ["depth", "x", "y"]


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, mark (digest of role and text) and n_words."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    whole = F.concat(F.octet_length(role).cast("string").cast("binary"), F.lit(":").cast("binary"), role.cast("binary"), text.cast("binary"))
    mark = F.unhex(F.substring(F.sha2(whole, 256), 1, 32))
    rows = conversations.where(F.col("conv_id").isNotNull())
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), mark.alias("mark"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))


def _hash(which: int, place: Column, mark: Column) -> Column:
    return F.xxhash64(F.lit(which), place.cast("long"), mark)


def prefixes(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, x, y, px, py, words, n_turns: every prefix of every rebuilt conversation, the empty one included.

    x and y name the prefix, px and py the one before it; words are those of its last turn, n_turns of the conversation.
    """
    digests = stored(turns(conversations), "digests")  # ranges are sampled from these, so that texts are read once
    ranged = stored(digests.repartitionByRange("conv_id", "turn", "mark").withColumn("part", F.spark_partition_id()), "turns")
    counts = ranged.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    by_part = Window.partitionBy("conv_id").orderBy("part")
    earlier = F.coalesce(F.sum("n").over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = counts.select("conv_id", "part", earlier.alias("before"), F.sum("n").over(Window.partitionBy("conv_id")).alias("n_own"))
    within = Window.partitionBy("part", "conv_id").orderBy("turn", "mark")
    placed = stored(ranged.withColumn("k", F.row_number().over(within)).join(spans, ["part", "conv_id"]).withColumn("k", F.col("k") + F.col("before")).drop("turn", "before"), "placed")

    lenders = placed.where((F.col("conv_id") % GROUP == 0) & (F.col("k") < LENT)).groupBy(F.col("conv_id").alias("lender")).agg(F.array_sort(F.collect_list(F.struct("k", "mark", "words"))).alias("first"))
    lent = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % LENT).cast("int")
    known = counts.groupBy("conv_id").agg(F.sum("n").alias("n_own")).withColumn("h", lent).withColumn("lender", F.col("conv_id") - F.col("conv_id") % GROUP)
    none = F.array().cast("array<struct<k:long,mark:binary,words:long>>")
    heads = known.join(lenders, "lender", "left").withColumn("first", F.slice(F.coalesce(F.col("first").cast("array<struct<k:long,mark:binary,words:long>>"), none), F.lit(1), F.col("h")))
    folded = lambda which, upto: F.aggregate(F.slice("first", F.lit(1), upto), F.lit(0).cast("long"), lambda acc, t: acc.bitwiseXOR(_hash(which, t["k"], t["mark"])))
    heads = heads.select("conv_id", "h", "first", F.size("first").alias("n_lent"), (F.size("first") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).alias("n_turns"))
    heads = stored(heads.withColumns({"hx": folded(1, F.size("first")), "hy": folded(2, F.size("first"))}), "heads")

    depths = heads.select("conv_id", "n_turns", "first", F.explode(F.sequence(F.lit(0), F.col("n_lent"))).alias("d"))
    before = F.greatest(F.col("d") - 1, F.lit(0))
    short = depths.select(
        "conv_id", F.col("d").cast("long").alias("depth"), folded(1, F.col("d")).alias("x"), folded(2, F.col("d")).alias("y"), folded(1, before).alias("px"), folded(2, before).alias("py"),
        F.when(F.col("d") == 0, F.lit(0).cast("long")).otherwise(F.get("first", before)["words"]).alias("words"), F.col("n_turns").cast("long").alias("n_turns"),
    )
    return short.unionByName(_own(placed, counts, heads))


def _own(placed: DataFrame, counts: DataFrame, heads: DataFrame) -> DataFrame:
    """The prefixes that end with a conversation's own turns, after those that it was lent."""
    spread = counts.select("conv_id", "part").join(heads.select("conv_id", "h", "n_lent", "n_turns", "hx", "hy"), "conv_id")
    own = placed.join(spread, ["part", "conv_id"]).where(F.col("k") > F.col("h")).withColumn("depth", F.col("n_lent") + F.col("k") - F.col("h"))
    own = own.withColumns({"tx": _hash(1, F.col("depth"), F.col("mark")), "ty": _hash(2, F.col("depth"), F.col("mark"))})
    so_far = Window.partitionBy("part", "conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("part", "conv_id")
    own = own.withColumns({"x": F.bit_xor("tx").over(so_far), "y": F.bit_xor("ty").over(so_far), "last": F.col("depth") == F.max("depth").over(whole)})
    own = stored(own.select("part", "conv_id", "depth", "tx", "ty", F.col("x").bitwiseXOR(F.col("hx")).alias("x"), F.col("y").bitwiseXOR(F.col("hy")).alias("y"), "hx", "hy", "words", "n_turns", "last"), "own")
    # What a part's last row of a conversation has, later parts of that conversation begin with: one row a part at most.
    ends = own.where("last AND depth < n_turns").select("conv_id", "part", F.col("x").bitwiseXOR(F.col("hx")).alias("ex"), F.col("y").bitwiseXOR(F.col("hy")).alias("ey"))
    parts = counts.select("conv_id", "part").join(F.broadcast(ends.select("conv_id").distinct()), "conv_id").join(ends, ["conv_id", "part"], "left")
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select("conv_id", "part", F.bit_xor("ex").over(earlier).alias("cx"), F.bit_xor("ey").over(earlier).alias("cy")).where("cx IS NOT NULL")
    rows = own.join(F.broadcast(carried), ["conv_id", "part"], "left")
    x, y = (F.col(a).bitwiseXOR(F.coalesce(F.col(b), F.lit(0).cast("long"))) for a, b in (("x", "cx"), ("y", "cy")))
    return rows.select("conv_id", F.col("depth").cast("long").alias("depth"), x.alias("x"), y.alias("y"), x.bitwiseXOR(F.col("tx")).alias("px"), y.bitwiseXOR(F.col("ty")).alias("py"), "words", F.col("n_turns").cast("long").alias("n_turns"))


def _cells(names: list[Column], width: int) -> list[Column]:
    """The prefix's cell in each row of the sketch, rows one after another, counted from 1."""
    return [F.pmod(F.xxhash64(F.lit(r), *(n.cast("long") for n in names)), F.lit(width)) + (r * width + 1) for r in range(ROWS)]


def sketch(rows: DataFrame, width: int) -> np.ndarray:
    """One bit a cell: whether the count-min sketch of the rows' prefixes counts two or more there."""
    cells = rows.select(F.explode(F.array(*_cells([F.col(c) for c in _NODE], width))).alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    packed = cells.groupBy(F.bitmap_bucket_number("cell").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bits")).collect()  # of bounded size: ROWS * width / 8 bytes
    out = np.zeros(ROWS * width // 8 + (1 << 13), np.uint8)
    for r in packed:  # block 1 begins with cell 1
        at = (r.block - 1) * 4096
        out[at : at + len(r.bits)] |= np.frombuffer(r.bits, np.uint8)
    return out


def width_for(n: int, least: int = MIN_WIDTH, most: int = MAX_WIDTH) -> int:
    return min(max(least, 1 << (8 * max(n, 1) - 1).bit_length()), most)


def screened(rows: DataFrame, width: int | None = None) -> DataFrame:
    """rows with alone (the sketch proves that no other conversation has the prefix) and head (not so the one before)."""
    width = width or width_for(rows.where("depth > 0").count())
    sent = rows.sparkSession.sparkContext.broadcast(sketch(rows.where("depth > 0"), width))
    columns = rows.columns
    n = len(columns)
    names = [F.col(c) for c in _NODE], [F.col("depth") - 1, F.col("px"), F.col("py")]
    with_cells = rows.select("*", *(c.alias(f"__{i}_{r}") for i, of in enumerate(names) for r, c in enumerate(_cells(of, width))))
    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", alone boolean, head boolean"

    def each(batches):
        bits = sent.value
        for batch in batches:
            once = []
            for i in (0, 1):
                single = np.zeros(batch.num_rows, bool)
                for r in range(ROWS):
                    bit = batch.column(n + i * ROWS + r).to_numpy() - 1  # bitmaps count from 1
                    single |= (bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 0
                once.append(single)
            depth = batch.column(1).to_numpy()
            before = once[1] & (depth > 1)
            yield {name: batch.column(i) for i, name in enumerate(columns)} | {"alone": (depth > 0) & (once[0] | before), "head": ~before}

    return map_arrow(with_cells, each, schema)


def _ends(exact: DataFrame) -> DataFrame:
    """depth, x, y, ends_sha256 of the nodes at which conversations end."""
    final = exact.where("depth = n_turns").select(*_NODE, "conv_id").repartitionByRange("x", "y", "depth", "conv_id").sortWithinPartitions("x", "y", "depth", "conv_id")

    def chunks(batches):
        """Ascending identifiers of one node, joined; a chunk ends with its node, its rows or its batch."""
        for batch in batches:
            keys = np.column_stack([batch.column(i).to_numpy() for i in range(3)])
            ids = batch.column(3).to_numpy()
            if len(ids):
                cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
                starts = sorted({0, *cuts.tolist(), *range(0, len(ids), CHUNK)})
                spans = list(zip(starts, [*starts[1:], len(ids)]))
                yield {"depth": [int(keys[a, 0]) for a, _ in spans], "x": [int(keys[a, 1]) for a, _ in spans], "y": [int(keys[a, 2]) for a, _ in spans], "first": [int(ids[a]) for a, _ in spans], "ids": [",".join(map(str, ids[a:b].tolist())) for a, b in spans]}

    joined = map_arrow(final, chunks, "depth long, x long, y long, first long, ids string")
    dealt = joined.repartition("x", "y", "depth").sortWithinPartitions("x", "y", "depth", "first")

    def hashed(batches):
        node, digest = None, None
        for batch in batches:
            out = []
            for depth, x, y, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4))):
                if node == (depth, x, y):
                    digest.update(b",")
                else:
                    if node:
                        out.append((*node, digest.hexdigest()))
                    node, digest = (depth, x, y), hashlib.sha256()
                digest.update(ids.encode())
            yield dict(zip(("depth", "x", "y", "ends_sha256"), map(list, zip(*out)))) if out else {"depth": [], "x": [], "y": [], "ends_sha256": []}
        if node:
            yield {"depth": [node[0]], "x": [node[1]], "y": [node[2]], "ends_sha256": [digest.hexdigest()]}

    return map_arrow(dealt, hashed, "depth long, x long, y long, ends_sha256 string")


def trie(conversations: DataFrame, width: int | None = None) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows = stored(screened(stored(prefixes(conversations), "prefixes"), width), "screened")
    alone, exact = rows.where("alone"), rows.where("NOT alone")
    grouped = exact.groupBy(*_NODE).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("words").alias("words"), F.max("px").alias("px"), F.max("py").alias("py"))
    nodes = stored(grouped, "nodes")

    below = nodes.where("depth > 0").select("depth", "px", "py").unionAll(alone.where("head").select("depth", "px", "py"))
    children = below.groupBy((F.col("depth") - 1).alias("depth"), F.col("px").alias("x"), F.col("py").alias("y")).agg(F.count("*").alias("n_children"))
    nodes = stored(nodes.join(children, _NODE, "left").fillna(0, ["n_children"]), "counted")

    # Credits of a conversation: the savings of the nodes it is the smallest member of, and the leaf that it ends.
    zero, no_key = F.lit(0).cast("long"), F.lit(None).cast("long")
    credits = nodes.where("n_convs > 1 OR n_children = 0").select("conv_id", "depth", no_key.alias("x"), no_key.alias("y"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    credits = credits.unionAll(alone.where("depth = n_turns").select("conv_id", "depth", no_key, no_key, zero, zero + 1))
    both = credits.unionAll(exact.select("conv_id", *_NODE, zero, zero))
    onward = Window.partitionBy("conv_id").orderBy(F.col("depth").desc()).rangeBetween(Window.unboundedPreceding, 0)
    own = both.withColumns({"saved": F.sum("saved").over(onward), "leaf": F.sum("leaf").over(onward)}).where("x IS NOT NULL")
    sums = own.groupBy(*_NODE).agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    shared = nodes.join(sums, _NODE).join(_ends(exact), _NODE, "left")

    nothing = hashlib.sha256(b"").hexdigest()
    shared = shared.select("conv_id", "depth", "px", "py", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))
    last = F.col("depth") == F.col("n_turns")
    ending = F.when(last, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(nothing)
    tails = alone.select("conv_id", "depth", "px", "py", (zero + 1).alias("n_convs"), (~last).cast("long").alias("n_children"), (zero + 1).alias("n_leaves"), zero.alias("saved_tokens"), ending.alias("ends_sha256"), "head")
    # Only what hangs on a node that may be shared looks for its parent; a proven tail is its own parent.
    hanging = shared.unionAll(tails.where("head").drop("head"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("parent"))
    found = hanging.join(parents, ["depth", "px", "py"], "left").withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id")))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return found.select(*columns).unionAll(tails.where("NOT head").withColumn("parent_conv_id", F.col("conv_id")).select(*columns))


ORACLE = r"""
WITH RECURSIVE t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS k FROM conversations WHERE conv_id IS NOT NULL),
crc(i, v) AS (SELECT i, i::UBIGINT FROM range(256) r(i)), bits(i, v, n) AS (SELECT i, v, 0 FROM crc UNION ALL SELECT i, xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END), n + 1 FROM bits WHERE n < 8),
tab AS (SELECT list(v ORDER BY i) AS tab FROM bits WHERE n = 8),
c AS (SELECT DISTINCT conv_id, conv_id::VARCHAR AS s FROM t),
h AS (SELECT conv_id, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(s, ''), lambda x: ascii(x)::UBIGINT)), lambda a, b: xor(a >> 8, tab[1 + (xor(a, b) & 255)::BIGINT])), 4294967295::UBIGINT) % 4 AS h FROM c, tab),
r AS (SELECT h.conv_id, t.k AS k, t.role, t.text FROM h JOIN t ON t.conv_id = h.conv_id - h.conv_id % 20 AND t.k <= h.h UNION ALL SELECT h.conv_id, h.h + t.k, t.role, t.text FROM h JOIN t ON t.conv_id = h.conv_id AND t.k > h.h),
seq AS (SELECT h.conv_id, coalesce(list({'r': role, 't': text} ORDER BY k) FILTER (WHERE k IS NOT NULL), []) AS s FROM h LEFT JOIN r USING (conv_id) GROUP BY h.conv_id),
p AS (SELECT conv_id, d, s[1:d] AS pre, len(s) AS n FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM seq)),
n AS (SELECT pre, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE d = n), '') AS ends, CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(pre[d].t, '[^\x20\x09-\x0D]+')) END AS words FROM p GROUP BY pre, d),
kids AS (SELECT pre[1:d - 1] AS pre, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids ON kids.pre = n.pre),
up AS (SELECT pre[1:u] AS pre, n_convs, words, n_children FROM (SELECT *, unnest(range(0, d + 1)) AS u FROM m)),
sums AS (SELECT pre, sum((n_convs - 1) * words)::BIGINT AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM up GROUP BY pre)
SELECT m.conv_id, m.d::BIGINT AS depth, CASE WHEN m.d > 0 THEN q.conv_id END AS parent_conv_id, m.n_convs, m.n_children, sums.n_leaves, sums.saved_tokens, sha256(m.ends) AS ends_sha256
FROM m JOIN sums ON sums.pre = m.pre LEFT JOIN m q ON m.d > 0 AND q.pre = m.pre[1:m.d - 1]
"""
