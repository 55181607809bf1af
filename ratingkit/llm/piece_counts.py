"""Word-piece lengths by a linear longest-match automaton.

The vocabulary is a trie.  Every node has a failure link to the node that holds what is left once the
longest pieces that fit have been taken from its string, and the *number* of those pieces.  Reading a
word follows trie edges and, where none fits, failure links, and adds the numbers up: the greedy
longest-match length in time linear in the word, without building a piece.

Texts are split into words as byte-level vocabularies split them (see ``bpe``; code points from U+10000
on count as symbols), and each distinct word is read once per worker.

Defined cases: null and empty texts have no words and no pieces; a word that the pieces cannot spell
counts as one piece (unknown); repeated rows are counted each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import PROBED, _BYTE_LETTERS, load_tokenizer, probe_classes, split_points
from .common import byte_view, narrow, pieces, prepare, word_hashes

CACHE_ENTRIES = 2_000_000


class PieceAutomaton:
    """``initial`` pieces may begin a word, ``continuing`` ones (default: the same) go on with it."""

    def __init__(self, initial: Iterable[bytes], continuing: Iterable[bytes] | None = None):
        self.edges: list[dict[int, int]] = [{}]
        ends = self._insert(0, initial)
        self.inner = 0
        if continuing is not None:
            self.inner = len(self.edges)
            self.edges.append({})
            ends |= self._insert(self.inner, continuing)
        n = len(self.edges)
        self.fail, self.popped = [-1] * n, [0] * n
        queue = list(dict.fromkeys((0, self.inner)))
        for u in queue:                                   # breadth first: parents before children
            for c, v in self.edges[u].items():
                if v in ends:
                    self.fail[v], self.popped[v] = self.inner, 1
                else:
                    z, n_popped = self.fail[u], self.popped[u]
                    while z >= 0 and c not in self.edges[z]:
                        n_popped += self.popped[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.popped[v] = self.edges[z][c], n_popped
                queue.append(v)

    def _insert(self, root: int, words: Iterable[bytes]) -> set[int]:
        ends = set()
        for w in words:
            u = root
            for c in w:
                v = self.edges[u].get(c)
                if v is None:
                    v = self.edges[u][c] = len(self.edges)
                    self.edges.append({})
                u = v
            if w:
                ends.add(u)
        return ends

    def length(self, word: bytes) -> int:
        """Number of greedy longest-match pieces of ``word``; 1 if they cannot spell it, 0 if it is empty."""
        edges, fail, popped = self.edges, self.fail, self.popped
        u = n = 0
        for c in word:
            while (v := edges[u].get(c)) is None:
                if fail[u] < 0:
                    return 1
                n += popped[u]
                u = fail[u]
            u = v
        while u != self.inner:
            if fail[u] < 0:
                return 1 if word else 0
            n += popped[u]
            u = fail[u]
        return n


def byte_vocabulary(tokenizer_path: str) -> list[bytes]:
    """Pieces of a byte-level vocabulary as bytes, without the special ones."""
    t = load_tokenizer(tokenizer_path)
    letters = {chr(b): b for b in range(256) if b not in _BYTE_LETTERS} | {v: k for k, v in _BYTE_LETTERS.items()}
    special = {x.content for x in t.get_added_tokens_decoder().values()}
    return [bytes(letters[c] for c in w) for w in t.get_vocab() if w not in special]


class PieceCounter:
    """Counts of whole texts; remembers the words it has read."""

    def __init__(self, automaton: PieceAutomaton, classes: np.ndarray):
        self.automaton, self.classes = automaton, classes
        self.hashes, self.lengths = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def count(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words and pieces of each text."""
        joined = "".join(texts)
        bounds = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))))
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        # code points beyond the probed plane count as symbols
        starts = split_points(np.minimum(points, PROBED - 1), bounds, self.classes)
        ends = np.append(starts[1:], len(points)) if len(starts) else starts
        distinct, sample, inverse = np.unique(word_hashes(points, starts, ends), return_index=True,
                                              return_inverse=True)
        if len(self.hashes) > CACHE_ENTRIES:
            self.hashes, self.lengths = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.searchsorted(self.hashes, distinct)
        known = at < len(self.hashes)
        known[known] &= self.hashes[at[known]] == distinct[known]
        if not known.all():
            read, miss = self.automaton.length, sample[~known]
            new = np.fromiter((read(joined[a:b].encode("utf-8", "surrogatepass")) for a, b in
                               zip(starts[miss].tolist(), ends[miss].tolist())), np.int64, len(miss))
            self.hashes = np.insert(self.hashes, at[~known], distinct[~known])
            self.lengths = np.insert(self.lengths, at[~known], new)
            at = np.searchsorted(self.hashes, distinct)
        each = self.lengths[at][inverse] if len(distinct) else np.zeros(0, np.int64)
        upto = np.searchsorted(starts, bounds)
        total = np.concatenate(([0], np.cumsum(each)))
        return np.diff(upto), np.diff(total[upto])


_COUNTERS: dict[str, PieceCounter] = {}


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_pieces."""
    spark = docs.sparkSession
    prepare(spark)
    own = narrow(docs, id_col, text_col)
    classes = spark.sparkContext.broadcast(probe_classes(load_tokenizer(tokenizer_path)))

    def run(batches):
        if tokenizer_path not in _COUNTERS:
            _COUNTERS[tokenizer_path] = PieceCounter(PieceAutomaton(byte_vocabulary(tokenizer_path)), classes.value)
        counter = _COUNTERS[tokenizer_path]
        for batch in batches:
            texts = batch.column("text").fill_null("").to_pylist()
            for i, j in pieces(byte_view(batch.column("text"))[1]):
                words, n = counter.count(texts[i:j])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(words, pa.int64()),
                                                  pa.array(n, pa.int64())], ["doc_id", "n_words", "n_pieces"])
    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, n_words long, n_pieces long")
