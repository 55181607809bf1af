"""Byte-level BPE of whole texts at corpus scale, with the tokenizers library.

The library splits a text into pre-tokens and encodes each on its own.  Most pre-tokens recur, so
the split is done here on arrays of code points, and the library's model encodes each distinct
pre-token once per worker.  Ids are those of ``Tokenizer.encode`` of the whole text, with the strings of
special tokens as ordinary text.

The split follows the pre-tokenizer's pattern
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``; classes of code points
are read off the library itself.  Texts with code points beyond the probed plane go to the library
whole.
"""

from __future__ import annotations

import numpy as np

from .common import gather_ranges, word_hashes

LETTER, NUMBER, OTHER, SPACE, UNKNOWN = range(5)
PROBED = 0x10000
# Distinct pre-tokens a worker remembers (about 50 bytes each) before it starts afresh.
CACHE_ENTRIES = 1_000_000


def load_tokenizer(path: str):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def probe_classes(tokenizer) -> np.ndarray:
    """Class of each code point below ``PROBED``, from how the pre-tokenizer splits next to it."""
    out = np.full(PROBED, UNKNOWN, np.uint8)
    points = [c for c in range(PROBED) if not 0xD800 <= c < 0xE000]
    split = tokenizer.pre_tokenizer.pre_tokenize_str
    for k in range(0, len(points), 8192):
        part = points[k:k + 8192]
        for c in part:
            out[c] = SPACE
        for mark, kind in (("!", OTHER), ("1", NUMBER), ("x", LETTER)):
            text = "\n".join(mark + chr(c) for c in part)
            owner = np.zeros(len(text), np.int64)
            for n, (_, (a, b)) in enumerate(split(text)):
                owner[a:b] = n
            at = 3 * np.arange(len(part))
            out[np.array(part)[owner[at] == owner[at + 1]]] = kind
    return out


def split_points(points: np.ndarray, bounds: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where pre-tokens start; ``bounds`` are the text boundaries in ``points``."""
    n = len(points)
    kind = classes[points]
    run = np.ones(n, bool)
    run[1:] = kind[1:] != kind[:-1]
    run[bounds[:-1][bounds[:-1] < n]] = True
    at = np.flatnonzero(run)
    last = np.append(at[1:], n) - 1                       # last point of each run
    k = kind[at]
    final = np.isin(last + 1, bounds)                     # run ends its text
    joins = np.zeros(len(at), bool)                       # the space before belongs to the run
    joins[1:] = (points[last[:-1]] == 32) & ~final[:-1] & (k[1:] != SPACE)
    start = np.zeros(n + 1, bool)
    start[at[~joins]] = True
    start[last[(k == SPACE) & ~final]] = True             # the last white space stands alone or joins
    # contractions: a lone apostrophe that begins a pre-token, and its letters
    quote = at[(points[at] == 39) & (last == at) & ~joins & ~final]
    if len(quote):
        wide = np.append(points, np.zeros(3, points.dtype))
        end_of = bounds[np.searchsorted(bounds, quote, side="right")]
        a, b = wide[quote + 1], wide[quote + 2]
        one = np.isin(a, np.array([115, 116, 109, 100], points.dtype))              # s t m d
        two = ((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)       # re ve ll
        two &= quote + 2 < end_of
        size = np.where(one, 2, np.where(two, 3, 0))
        quote, size, end_of = quote[size > 0], size[size > 0], end_of[size > 0]
        start[quote + 1] = False
        after = quote + size
        inside = after < end_of
        inside[inside] &= kind[after[inside]] == LETTER
        start[after[inside]] = True
    return np.flatnonzero(start[:n])


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself where it prints, else the
    next one from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(256 + k) for k, b in enumerate(rest)}


_BYTE_LETTERS = _byte_letters()


class Encoder:
    """Encodes batches of texts; one per Python worker, with its memory of pre-tokens."""

    def __init__(self, path: str, classes: np.ndarray):
        self.tokenizer, self.classes = load_tokenizer(path), classes
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.first, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        model, table = self.tokenizer.model, _BYTE_LETTERS
        got = [[k.id for k in model.tokenize(w.encode().decode("latin-1").translate(table))] for w in words]
        count = np.fromiter(map(len, got), np.int64, len(got))
        total = int(count.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.flat[self.used:self.used + total] = [i for ids in got for i in ids]
        first = self.used + np.cumsum(count) - count
        self.used += total
        new = len(self.first) + np.arange(len(hashes))
        self.first, self.count = np.concatenate((self.first, first)), np.concatenate((self.count, count))
        at = np.searchsorted(self.hashes, hashes)
        self.hashes, self.entry = np.insert(self.hashes, at, hashes), np.insert(self.entry, at, new)

    def encode(self, texts: list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array and the offsets of each; ``end`` is added to every text."""
        joined = "".join(texts)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        if len(points) and points.max() >= PROBED:
            far = np.unique(np.searchsorted(bounds, np.flatnonzero(points >= PROBED), side="right") - 1)
            return self._encode_mixed(texts, far, end)
        starts = split_points(points, bounds, self.classes)
        ends = np.append(starts[1:], len(points)) if len(starts) else starts
        hashes = word_hashes(points, starts, ends)
        if len(self.hashes) > CACHE_ENTRIES:
            self._forget()
        distinct, sample, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, distinct)
        known = at < len(self.hashes)
        known[known] &= self.hashes[at[known]] == distinct[known]
        if not known.all():
            miss = sample[~known]
            self._learn(distinct[~known], [joined[a:b] for a, b in zip(starts[miss].tolist(), ends[miss].tolist())])
            at = np.searchsorted(self.hashes, distinct)
        entry = self.entry[at] if len(distinct) else np.zeros(0, np.int64)
        entry = entry[inverse]
        return self._collect(entry, np.searchsorted(starts, bounds), end)

    def _collect(self, entry: np.ndarray, token_bounds: np.ndarray, end: int | None):
        count = self.count[entry]
        upto = np.concatenate(([0], np.cumsum(count)))[token_bounds]
        ids = self.flat[gather_ranges(self.first[entry], count)]
        if end is None:
            return ids, upto
        n = len(token_bounds) - 1
        out = np.full(len(ids) + n, end, np.uint32)
        out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(upto))] = ids
        return out, upto + np.arange(n + 1)

    def _encode_mixed(self, texts: list[str], far: np.ndarray, end: int | None):
        tail = [] if end is None else [end]
        whole = dict(zip(far.tolist(), (e.ids for e in self.tokenizer.encode_batch_fast(
            [texts[k] for k in far], add_special_tokens=False))))
        ids, off = self.encode(["" if k in whole else t for k, t in enumerate(texts)], end)
        rows = [np.array(whole[k] + tail, np.uint32) if k in whole else ids[off[k]:off[k + 1]]
                for k in range(len(texts))]
        return np.concatenate(rows), np.concatenate(([0], np.cumsum([len(r) for r in rows])))


_ENCODERS: dict[str, Encoder] = {}


def worker_encoder(path: str, classes: np.ndarray) -> Encoder:
    """The worker's encoder of this vocabulary; tasks that share a worker share what it remembers."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, classes)
    return _ENCODERS[path]
