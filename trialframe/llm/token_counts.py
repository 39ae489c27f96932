"""Unigram token counts by dynamic programming that shared prefixes share.

A unigram vocabulary scores a segmentation by the sum of its pieces' scores; a text has as many
tokens as its best segmentation. Pre-tokens (words behind a word mark) are inserted in a trie. The
best score of a prefix depends on nothing behind it, so it is computed once for each trie node,
whichever words pass through it, and the node where a word ends stores the word's count. The new
words of a batch are inserted together, and all nodes of one depth are scored at once.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialframe.llm.tokens import groups
from trialframe.llm.workers import bound_batches, parts

MARK = "▁"
#: Trie nodes and counted pre-tokens a worker keeps; what is full is dropped and grown again, which changes no count.
NODES = 400_000
#: Pre-tokens longer than this many characters are scored alike, but one by one, and not kept.
KEPT_LENGTH = 64
#: Above every code point.
CODES = 1 << 21


def unigram_vocabulary(path: str) -> dict[str, float]:
    """Pieces of a SentencePiece file, which lists them by falling frequency, with Zipf log-probabilities.

    Control and byte pieces are left out: a character without a piece costs one token per UTF-8 byte.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    total = math.fsum(1 / (i + 1) for i in pieces)
    out: dict[str, float] = {}
    for i in pieces:
        out.setdefault(model.id_to_piece(i), -math.log((i + 1) * total))
    return out


class SharedTrie:
    """Counts of pre-tokens under a vocabulary. ``visited`` is how many nodes were ever scored."""

    def __init__(self, vocabulary: dict[str, float], nodes: int = NODES) -> None:
        self.limit, self.visited = nodes, 0
        # the vocabulary as a trie of dicts; the empty key holds a piece's score
        self.pieces: dict = {}
        for piece, score in vocabulary.items():
            at = self.pieces
            for c in piece:
                at = at.setdefault(c, {})
            at[""] = score
        self._flatten()
        self.unknown = min(vocabulary.values(), default=0.0) - 10.0
        self.clear()

    def _flatten(self) -> None:
        """The vocabulary's trie as arrays: sorted (state, character) keys, the states behind them, states' scores."""
        keys, scores, queue = [], [self.pieces.get("", np.nan)], [(0, self.pieces)]
        for state, at in queue:
            for c, child in at.items():
                if c:
                    keys.append((state * CODES + ord(c), len(scores)))
                    queue.append((len(scores), child))
                    scores.append(child.get("", np.nan))
        keys.sort()
        self.keys = np.array([k for k, _ in keys] + [1 << 62], np.int64)
        self.next = np.array([n for _, n in keys] + [0], np.int64)
        self.scores = np.array(scores)

    def _follow(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The states behind ``states``, -1 where no piece goes on with that character."""
        key = states * CODES + codes
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.next[at], -1)

    def grow(self, words: list[str]) -> np.ndarray:
        """Token counts of sorted distinct ``words``, whose trie is scored one depth at a time."""
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + len(MARK)
        codes = np.frombuffer("".join([MARK + w for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        out = np.zeros(len(words), np.int64)
        live, at = np.arange(len(words)), np.zeros(len(words), np.int64)  # words that go on, and their nodes
        best, count = np.zeros(1), np.zeros(1, np.int64)
        # open matches in the order of their nodes: how many, and each one's start score and count and its state
        many, m_best, m_count, m_state = np.ones(1, np.int64), np.zeros(1), np.zeros(1, np.int64), np.zeros(1, np.int64)
        for depth in range(int(lengths.max(initial=0))):
            on = lengths[live] > depth
            live, at = live[on], at[on]
            code = codes[starts[live] + depth]
            first = np.r_[True, (at[1:] != at[:-1]) | (code[1:] != code[:-1])]
            parent, char = at[first], code[first]
            at = np.cumsum(first) - 1
            n = len(parent)
            self.visited += n
            # every match of a node, carried to each of its children
            fan = many[parent]
            child = np.repeat(np.arange(n), fan)
            source = np.arange(len(child)) + np.repeat((np.cumsum(many) - many)[parent] - (np.cumsum(fan) - fan), fan)
            state = self._follow(m_state[source], char[child])
            kept = state >= 0
            child, source, state = child[kept], source[kept], state[kept]
            m_best, m_count = m_best[source], m_count[source]
            cost = 1 + (char >= 0x80) + (char >= 0x800) + (char >= 0x10000)
            plain, plain_count = best[parent] + self.unknown * cost, count[parent] + cost
            score = m_best + self.scores[state]
            ends = ~np.isnan(score)
            best = plain.copy()
            np.maximum.at(best, child[ends], score[ends])
            count = np.where(best == plain, plain_count, np.iinfo(np.int64).max)
            ties = ends & (score == best[child])
            np.minimum.at(count, child[ties], m_count[ties] + 1)
            done = lengths[live] == depth + 1
            out[live[done]] = count[at[done]]
            # a match that starts behind each node goes last among the node's own
            held = np.bincount(child, minlength=n)
            places, last = np.arange(len(child)) + child, np.cumsum(held) + np.arange(n)
            many = held + 1
            m_best, m_count, m_state = (self._merged(places, a, last, b) for a, b in ((m_best, best), (m_count, count), (state, np.zeros(n, np.int64))))
        return out

    @staticmethod
    def _merged(places: np.ndarray, a: np.ndarray, last: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.empty(len(a) + len(b), b.dtype)
        out[places], out[last] = a, b
        return out

    def clear(self) -> None:
        self.size = 0
        # a node: children, best score, token count, open matches (start's score and count, place in the pieces)
        self.root = ({}, 0.0, 0, [(0.0, 0, self.pieces)])
        self.terminal: dict[str, int] = {}

    def step(self, node: tuple, c: str) -> tuple:
        """Score the prefix that ``c`` extends, from the matches still open before it."""
        self.visited += 1
        cost = len(c.encode("utf-8", "surrogatepass"))
        best, count = node[1] + self.unknown * cost, node[2] + cost
        open_ = []
        for score, tokens, at in node[3]:
            nxt = at.get(c)
            if nxt is not None:
                open_.append((score, tokens, nxt))
                s = nxt.get("")
                if s is not None and (score + s > best or score + s == best and tokens + 1 < count):
                    best, count = score + s, tokens + 1
        open_.append((best, count, self.pieces))
        return ({}, best, count, open_)

    def count(self, word: str) -> int:
        """Tokens of one pre-token."""
        known = self.terminal.get(word)
        if known is not None:
            return known
        keep = len(word) <= KEPT_LENGTH
        node = self.root
        for c in MARK + word:
            child = node[0].get(c) if keep else None
            if child is None:
                child = self.step(node, c)
                if keep:
                    node[0][c] = child
                    self.size += 1
            node = child
        if keep:
            self.terminal[word] = node[2]
        return node[2]

    def counts(self, texts: list[list[str]]) -> list[int]:
        """Tokens of each text, given as its pre-tokens."""
        if self.size > self.limit or len(self.terminal) > self.limit:
            self.clear()
        terminal = self.terminal
        new = sorted(w for w in set().union(*texts) if w not in terminal and len(w) <= KEPT_LENGTH)
        terminal.update(zip(new, self.grow(new).tolist(), strict=True))
        out = []
        for words in texts:
            n = 0
            for w in words:
                k = terminal.get(w)
                n += self.count(w) if k is None else k
            out.append(n)
        return out


@functools.lru_cache(maxsize=1)
def _trie(path: str) -> SharedTrie:
    return SharedTrie(unigram_vocabulary(path))


def token_counts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_pretokens, n_tokens) per row of ``docs``, in one pass without a shuffle.

    Pre-tokens are what Unicode white space separates. Null and empty texts have 0 tokens; ties
    between segmentations go to the fewer tokens; repeated rows and null ids are counted like any others, an
    empty table gives no rows, and other columns are not read. ``vocabulary_path`` must exist on every worker.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _trie(vocabulary_path)
        for part in parts(batches, 1):
            lengths, counts = [], []
            for texts in groups(part.column(1).to_pylist()):
                words = [t.split() for t in texts]
                lengths += map(len, words)
                counts += trie.counts(words)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lengths, pa.int64()), pa.array(counts, pa.int64())], names=["doc_id", "n_pretokens", "n_tokens"])

    bound_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(scan, "doc_id long, n_pretokens long, n_tokens long")
