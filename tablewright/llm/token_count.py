"""Token counts by greedy longest match in linear time.

The vocabulary is a trie over bytes.  A node's failure link leads to the node reached after the longest
pieces have been taken off its front, and its popped count says how many pieces that were.  Both are
closed over all 256 bytes beforehand, so a byte costs one table look-up: next node and pieces popped.
No piece is ever built.  All words of a batch advance together, one byte a step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.common import slices, small_batches, table, utf8
from tablewright.llm.pieces import MODEL_PATH, SPACE, parse_model, read_model

#: Bytes of text whose words advance together.
STEP_BYTES = 2 << 20


class Automaton:
    """Greedy longest match over byte strings.  Every single byte counts as a piece, so no word fails."""

    def __init__(self, pieces: list[bytes]):
        children: list[dict[int, int]] = [{}]
        final = [False]
        for piece in [bytes([b]) for b in range(256)] + pieces:
            node = 0
            for b in piece:
                nxt = children[node].get(b)
                if nxt is None:
                    nxt = children[node][b] = len(children)
                    children.append({})
                    final.append(False)
                node = nxt
            final[node] = True
        n = len(children)
        self.next = np.zeros((n, 256), np.int32)
        self.popped = np.zeros((n, 256), np.uint8)
        self.last = np.zeros(n, np.int32)
        link, pops = np.zeros(n, np.int32), np.zeros(n, np.int32)
        for b, child in children[0].items():
            self.next[0, b] = child
            pops[child], self.last[child] = 1, 1
        level = list(children[0].values())
        while level:
            below = []
            for v in level:
                to = link[v]
                self.next[v] = self.next[to]
                self.popped[v] = self.popped[to] + np.uint8(pops[v])
                for b, child in children[v].items():
                    if final[child]:
                        link[child], pops[child] = 0, 1
                    else:
                        link[child], pops[child] = self.next[v, b], self.popped[v, b]
                    self.last[child] = pops[child] + self.last[link[child]]
                    below.append(child)
                for b, child in children[v].items():
                    self.next[v, b], self.popped[v, b] = child, 0
            level = below
        self.next, self.popped = self.next.ravel(), self.popped.ravel()

    def start(self, prefix: bytes) -> tuple[int, int]:
        """Node and pieces popped after `prefix`."""
        node = count = 0
        for b in prefix:
            at = node * 256 + b
            count += int(self.popped[at])
            node = int(self.next[at])
        return node, count

    def counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, prefix: bytes) -> np.ndarray:
        """Pieces of prefix + data[start:end] for each word."""
        node, popped = self.start(prefix)
        lengths = ends - starts
        order = np.argsort(-lengths, kind="stable")
        at = starts[order]
        nodes = np.full(len(order), node, np.int32)
        out = np.full(len(order), popped, np.int32)
        longest = int(lengths[order[0]]) if len(order) else 0
        alive = np.searchsorted(-lengths[order], -np.arange(longest), side="left")
        for t in range(longest):
            m = alive[t]
            cell = nodes[:m] * np.int32(256) + data[at[:m] + t]
            out[:m] += self.popped[cell]
            nodes[:m] = self.next[cell]
        out += self.last[nodes]
        result = np.empty_like(out)
        result[order] = out
        return result


_AUTOMATA: dict[int, Automaton] = {}


def _automaton(model: bytes) -> Automaton:
    key = hash(model)
    if key not in _AUTOMATA:
        _AUTOMATA.clear()
        _AUTOMATA[key] = Automaton([p.encode() for p in parse_model(model).ids])
    return _AUTOMATA[key]


def count_batch(automaton: Automaton, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words and pieces of each text."""
    words, tokens = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for a, b in slices(np.array([len(t) for t in texts]), STEP_BYTES):
        data = np.frombuffer(b" ".join(texts[a:b]) + b" ", np.uint8)
        blank = (data == 32) | ((data >= 9) & (data <= 13))
        edge = np.flatnonzero(np.diff(blank.astype(np.int8), prepend=1))
        if not len(edge):
            continue
        starts, ends = edge[0::2], edge[1::2]
        lengths = np.array([len(t) + 1 for t in texts[a:b]])
        doc = np.searchsorted(np.cumsum(lengths), starts, side="right")
        counts = automaton.counts(data, starts, ends, SPACE.encode())
        words[a:b] = np.bincount(doc, minlength=b - a)
        tokens[a:b] = np.bincount(doc, weights=counts, minlength=b - a).astype(np.int64)
    return words, tokens


def token_counts(text: Column, model: bytes) -> Column:
    """Struct of n_words and n_tokens for a text.

    A word is a run without ASCII white space; its pieces are those that greedy longest match cuts from
    the space mark and the word, a character outside the vocabulary counting its UTF-8 bytes.  Null and
    empty texts have 0 of both.  The text is used as it is, whatever its length.
    """

    @F.pandas_udf("n_words long, n_tokens long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = _automaton(model)
        for texts in batches:
            words, tokens = count_batch(automaton, utf8(texts))
            yield pd.DataFrame({"n_words": words, "n_tokens": tokens})

    return count(text)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    counted = token_counts(F.col("text"), read_model(MODEL_PATH))
    return table(spark, sf_dir, "documents").select("doc_id", counted.alias("c")).select("doc_id", "c.n_words", "c.n_tokens")


QUERIES = {"op6_token_counts": op6_token_counts}
SQL: dict[str, str] = {}
