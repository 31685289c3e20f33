"""Token counts by dynamic programming that words share through a trie.

Words (cut at white space, each after the mark for a space) go into a trie. A node's forward score is the best sum of
piece scores over all ways to cut the characters from the root to it, and comes from its ancestors' scores: it is
computed when the node is made, once for all words with that beginning. A word's terminal holds its number of tokens, and
a text's count is the sum over its words. The trie lives in the worker, is filled by the batches it sees, and starts
anew when it has MAX_NODES nodes, so memory is bounded and counts do not depend on how rows are dealt.

Piece scores: the public vocabulary's pieces in their order, as the logarithm of Zipf's law, -log(rank + 1). Characters
without a piece cost UNKNOWN a byte and count one token a byte. Among equal scores the fewest tokens hold.

Defined cases: null and empty texts have no tokens; repeated documents each give a row.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from harborscan.llm.common import documents, map_arrow

MAX_NODES = 1_500_000
UNKNOWN = -30.0
SPACE = "▁"


def load_scores(path: str) -> dict[str, float]:
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return {p: -math.log(rank + 2) for rank, p in enumerate(pieces)}


class Trie:
    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.clear()

    def clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        #: Of each node: (forward score, minus the number of tokens).
        self.best: list[tuple[float, int]] = [(0.0, 0)]
        self.terminal: dict[str, int] = {}

    def insert(self, word: str) -> int:
        """The word's number of tokens."""
        if len(self.best) > MAX_NODES:
            self.clear()
        node, path, child, best, scores = 0, [0], self.child, self.best, self.scores
        for depth, ch in enumerate(word, 1):
            nxt = child.get((node, ch))
            if nxt is None:
                nxt = child[node, ch] = len(best)
                n_bytes = len(ch.encode())
                before = best[node]
                top = (before[0] + UNKNOWN * n_bytes, before[1] - n_bytes)
                for start in range(max(0, depth - self.longest), depth):
                    score = scores.get(word[start:depth])
                    if score is not None:
                        b = best[path[start]]
                        here = (b[0] + score, b[1] - 1)
                        if here > top:
                            top = here
                best.append(top)
            node = nxt
            path.append(node)
        self.terminal[word] = count = -best[node][1]
        return count

    def count(self, words: list[str]) -> int:
        known = self.terminal.get
        return sum((n if (n := known(w)) is not None else self.insert(w)) for w in words)


def counted(docs: DataFrame, scores: dict[str, float]) -> DataFrame:
    """One row per document: doc_id, n_words, n_tokens."""
    spread = docs.sparkSession.sparkContext.broadcast(scores)  # fixed by the vocabulary

    def each(batches):
        trie = Trie(spread.value)
        for b in batches:
            words = [[SPACE + w for w in t.decode().split()] if t else [] for t in b.column(1).to_pylist()]
            yield {"doc_id": b.column(0), "n_words": [len(w) for w in words], "n_tokens": [trie.count(w) for w in words]}

    return map_arrow(documents(docs), each, "doc_id long, n_words long, n_tokens long")
