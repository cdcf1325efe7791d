"""Token ids of whole texts by a public tokenizer, many texts at a time.

The tokenizer cuts texts into pieces (a run of letters, one number sign, a run of other marks; white space drops out) and encodes each piece
on its own. A worker keeps the ids of pieces it has met; only new ones go to the library. Texts in Latin-1 without an apostrophe (which makes
pieces of another kind) or a special token are cut in numpy, many at a time, and pieces are told apart by a 64-bit hash. All other texts are
cut at white space, which the tokenizer never joins across. The caches are emptied when full, which changes no result. A worker keeps them
for as long as it lives, beside whatever other stages do, so pieces told apart by hash stand in sorted arrays (about 30 bytes each).
"""

from array import array
from itertools import chain

import numpy as np

CHUNK_CACHE = 1_000_000
#: Pieces that one chunk kept as a string counts for in the cache: an entry of a dictionary takes some times the memory.
NAMED = 4
#: Characters of texts cut at a time, if a single text isn't longer; words that go to the library in one string.
CUT, TOGETHER = 1 << 20, 8192
#: Characters that Python's split() takes for white space and the tokenizer's pattern doesn't.
ODD_SPACE = "\x1c\x1d\x1e\x1f"
#: Marks that are one piece of their own behind a word.
MARKS = ".,!?*$%&#|;:"


#: Kind of a Latin-1 character: 0 white space of the pattern, 1 letter, 2 number, 3 other.
_KIND = np.array([0 if c in "\t\n\x0b\x0c\r \x85\xa0" else 1 if c.isalpha() else 2 if c.isnumeric() else 3 for c in map(chr, range(256))], np.uint8)
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(n, base):
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Pieces:
    """Where the pieces of some joined Latin-1 texts begin and end, and a hash of each."""

    up, down = _powers(1, _BASE), _powers(1, pow(_BASE, -1, 2**64))

    def __init__(self, raw):
        a = np.frombuffer(raw, np.uint8)
        kind = np.zeros(len(a) + 2, np.uint8)
        kind[1:-1] = _KIND[a]
        mid = kind[1:-1]
        inside, single = mid != 0, mid == 2
        self.start = np.flatnonzero(inside & ((mid != kind[:-2]) | single))
        self.end = np.flatnonzero(inside & ((mid != kind[2:]) | single)) + 1
        if len(a) >= len(_Pieces.up):
            _Pieces.up, _Pieces.down = _powers(2 * len(a) + 1, _BASE), _powers(2 * len(a) + 1, pow(_BASE, -1, 2**64))
        total = np.zeros(len(a) + 1, np.uint64)
        np.cumsum((a.astype(np.uint64) + np.uint64(1)) * self.up[: len(a)], out=total[1:])
        key = (total[self.end] - total[self.start]) * self.down[self.start]
        key ^= (self.end - self.start).astype(np.uint64) << np.uint64(52)
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        self.key = key ^ (key >> np.uint64(32))


class ChunkTokenizer:
    """``end_id`` (or None) is put behind every text."""

    def __init__(self, path, end_id=None, cache=CHUNK_CACHE):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.end_id = end_id
        self.cache = cache
        self.ends = np.zeros(self.tok.get_vocab_size(), bool)
        self.ends[[i for t, i in self.tok.get_vocab().items() if t.endswith("</w>")]] = True
        self._empty()

    def _empty(self):
        self.index = {}
        self.keys, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat = array("I")
        self.starts = array("q", [0])

    def _encode(self, words):
        return [e.ids for e in self.tok.encode_batch_fast(words, add_special_tokens=False)]

    def _add(self, words, ids, lens, named=True):
        """ids: of all words in a row."""
        if named:
            base = len(self.starts) - 1
            self.index.update(zip(words, range(base, base + len(words))))
        self.starts.frombytes((len(self.flat) + np.cumsum(lens, dtype=np.int64)).tobytes())
        self.flat.frombytes(np.ascontiguousarray(ids, np.uint32).tobytes())

    def _add_pieces(self, words, named=False):
        """Words that are one piece each, in one string: a piece's last id carries the word end."""
        for k in range(0, len(words), TOGETHER):
            part = words[k : k + TOGETHER]
            ids = np.array(self.tok.encode(" ".join(part), add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(self.ends[ids])
            if len(ends) == len(part):
                self._add(part, ids, np.diff(ends, prepend=-1), named)
            else:
                self._add_any(part, named)

    def _add_any(self, words, named=True):
        got = self._encode(words)
        self._add(words, np.fromiter(chain.from_iterable(got), np.uint32), [len(x) for x in got], named)

    def _learn(self, new):
        """A chunk of letters with marks behind it is its word's ids and the marks' ids."""
        pieces, odd, cores, tails, both = set(), [], [], [], []
        for w in new:
            if w.isalpha():
                pieces.add(w)
                continue
            core = w.rstrip(MARKS)
            if core.isalpha() or not core:
                if core:
                    both.append(w)
                    cores.append(core)
                    tails.append(w[len(core) :])
                    pieces.add(core)
                    pieces.add(tails[-1])
                else:
                    pieces.add(w)
            else:
                odd.append(w)
        if pieces := list(pieces - self.index.keys()):
            self._add_pieces(pieces, named=True)
        if odd:
            self._add_any(odd)
        if both:
            at = np.array([[self.index[x] for x in cores], [self.index[x] for x in tails]]).T.ravel()
            starts, flat = np.frombuffer(self.starts, np.int64), np.frombuffer(self.flat, np.uint32)
            ids, lens = _gather(flat, starts[at], starts[at + 1] - starts[at])
            del starts, flat
            self._add(both, ids, lens.reshape(-1, 2).sum(1))

    def encode(self, texts):
        """Returns (flat uint32 ids, offsets of the texts in them, one more than texts). A null text has no ids of its own."""
        if NAMED * len(self.index) + len(self.keys) > self.cache:
            self._empty()
        plain, other = [], []
        for k, t in enumerate(texts):
            raw = None
            if t and "'" not in t and "<|" not in t:
                try:  # in Latin-1 lower case is the tokenizer's own, so one form serves all
                    raw = t.lower().encode("latin-1")
                except UnicodeEncodeError:
                    pass
            if raw is not None:
                plain.append((k, raw))
            elif t:
                other.append((k, t))
        got = [self._plain(part) for part in _groups([r for _, r in plain])]
        at, n_words = (np.concatenate([x[i] for x in got]) if got else np.zeros(0, np.int64) for i in (0, 1))
        at2, n_words2 = self._chunks([t for _, t in other])
        starts = np.frombuffer(self.starts, np.int64)
        flat = np.frombuffer(self.flat, np.uint32) if len(self.flat) else np.zeros(0, np.uint32)
        lens = np.zeros(len(texts), np.int64)
        got = []
        for rows, words, counts in ((plain, at, n_words), (other, at2, n_words2)):
            ids, each = _gather(flat, starts[words], starts[words + 1] - starts[words])
            per = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(counts)])]
            lens[[k for k, _ in rows]] = np.diff(per)
            got.append((rows, ids, per))
        del starts, flat
        tail = self.end_id is not None
        offsets = np.concatenate([[0], np.cumsum(lens + tail)]).astype(np.int64)
        out = np.full(offsets[-1], self.end_id if tail else 0, np.uint32)
        for rows, ids, per in got:
            for (k, _), lo, hi in zip(rows, per[:-1].tolist(), per[1:].tolist()):
                out[offsets[k] : offsets[k] + hi - lo] = ids[lo:hi]
        return out, offsets

    def _plain(self, raws):
        """Piece numbers of Latin-1 texts in lower case, and how many each text has."""
        raw = b" ".join(raws)
        p = _Pieces(raw)
        keys, first, at = np.unique(p.key, return_index=True, return_inverse=True)
        spot = np.searchsorted(self.keys, keys)
        near = np.minimum(spot, max(0, len(self.keys) - 1))
        number = np.where(self.keys[near] == keys, self.numbers[near], -1) if len(self.keys) else np.full(len(keys), -1, np.int64)
        if (new := np.flatnonzero(number < 0)).size:
            words = [raw[s:e].decode("latin-1") for s, e in zip(p.start[first[new]].tolist(), p.end[first[new]].tolist())]
            base = len(self.starts) - 1
            self._add_pieces(words)
            number[new] = np.arange(base, base + len(words))
            self.keys, self.numbers = np.insert(self.keys, spot[new], keys[new]), np.insert(self.numbers, spot[new], number[new])
        begin = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raws])]).astype(np.int64)
        return number[at], np.diff(np.searchsorted(p.start, begin))

    def _chunks(self, texts):
        """The same for any texts, by chunks between white space."""
        rows, whole = [], [t for t in texts if any(c in t for c in ODD_SPACE)]
        for t in texts:
            rows.append([t] if any(c in t for c in ODD_SPACE) else t.split())
        new = set().union(*rows) - self.index.keys()
        if new:
            self._learn([w for w in new if w not in whole])
            if odd := [w for w in new if w in whole]:
                self._add_any(odd)
        n_words = np.fromiter(map(len, rows), np.int64, len(rows))
        return np.fromiter(map(self.index.__getitem__, chain.from_iterable(rows)), np.int64, int(n_words.sum())), n_words


def _groups(raws):
    """Texts in a row, CUT characters at most together; a longer one alone."""
    part, n = [], 0
    for r in raws:
        if part and n + len(r) > CUT:
            yield part
            part, n = [], 0
        part.append(r)
        n += len(r) + 1
    if part:
        yield part


def _gather(flat, starts, lens):
    """flat[s : s + n] for each (s, n), in a row."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.uint32), lens
    first = np.cumsum(lens) - lens
    return flat[np.repeat(starts - first, lens) + np.arange(total)], lens


_LOADED = {}


def tokenizer(path, end_id=None):
    """One per worker process."""
    key = (path, end_id)
    if key not in _LOADED:
        _LOADED[key] = ChunkTokenizer(path, end_id)
    return _LOADED[key]
