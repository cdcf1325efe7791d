"""Two tokenizers' tokens of one text, aligned where both end at the same byte.

Each text gets the byte offsets at which its A tokens end and those at which its B tokens end. The shorter list drives: every one of its ends
gallops through the longer list (steps of 1, 2, 4 ..., then a binary search in the last step), from the place where the search of an earlier
end stopped. Ends found in both lists cut the tokens into groups; the differences of their ranks are the groups' token counts. The A and the B
token at a common end are linked, and the number of links of each id pair over the whole corpus says how usual a link is.

A is a byte-level BPE that takes words with the space before them, B a piece model with byte fallback that puts a space in front. Neither joins
over a space or line end between two other marks (the B vocabulary is checked for it), so a text is cut there and a worker keeps the ids of
chunks it has met. Texts are worked on in windows of whole chunks, so memory follows the window, but for one value per text (four bytes a link).

How it runs: one pass over the texts writes, per block of about four million links, the texts' figures, their links as numbers of the block's
distinct pairs, and those pairs with their counts. Counts are summed over blocks by pair; each block gets back the totals of its own pairs. The
rows moved are a block's distinct pairs, never links.

Defined results: texts that are null, empty, or not given back byte for byte by either tokenizer have no tokens and zeros, and an empty digest.
Strings of special tokens are plain text. Rows with the same or no id stay rows of their own and count by themselves; only doc_id and text are
read. No rows give no rows.
"""

import hashlib
import re
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import functions as F

from ..session import cut
from .tokens import _gather

#: Chunks in a window, links in a block, chunks whose ids a worker keeps, characters of a text that are cut at once, new chunks encoded as one text.
WINDOW, BLOCK, CACHE, SLICE, JOINED = 200_000, 4_000_000, 600_000, 1 << 20, 2_000
#: Ends of the driving list between two anchors, level by level.
STRIDES = (1024, 64, 4, 1)
SPACE = "▁"
#: Where a text may be cut: before a space or line end with another mark on both sides.
SEAM = re.compile(r"(?<=\S)(?=[ \n]\S)")


def gallop(ends, x, at):
    """Where each x stands in the sorted ``ends`` (the first not below it), searched from ``at`` on, which mustn't lie behind it."""
    last = len(ends) - 1
    low, high = at.copy(), np.minimum(at, last)
    open_ = np.flatnonzero(ends[high] < x)
    step = 1
    while open_.size:
        low[open_] = high[open_] + 1
        high[open_] = np.minimum(high[open_] + step, last)
        step *= 2
        open_ = open_[(ends[high[open_]] < x[open_]) & (low[open_] <= last)]
    open_ = np.flatnonzero(low < high)
    while open_.size:
        mid = (low[open_] + high[open_]) >> 1
        less = ends[mid] < x[open_]
        low[open_] = np.where(less, mid + 1, low[open_])
        high[open_] = np.where(less, high[open_], mid)
        open_ = open_[low[open_] < high[open_]]
    return low


def common(a, b):
    """Ranks in both sorted lists of the values they share."""
    if len(b) < len(a):
        return common(b, a)[::-1]
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, wide = np.zeros(1, np.int64), len(a)
    for stride in STRIDES:
        x = a[::stride]
        at = gallop(b, x, at[np.arange(len(x)) * stride // wide])
        wide = stride
    hit = np.flatnonzero(b[np.minimum(at, len(b) - 1)] == a)
    return hit, at[hit]


def _byte_level():
    """Characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokenizers:
    """Ids of chunks by both vocabularies, kept while they fit the cache."""

    def __init__(self, path_a, path_b, cache=CACHE):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.cache = cache
        back = _byte_level()
        vocab = self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            self.bytes_a[i] = bytes(back[c] for c in piece) if all(c in back for c in piece) else piece.encode()
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        # a chunk's ids don't depend on its neighbours only if no piece reaches over its edge
        whole = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size()) if not self.b.is_byte(i)]
        self.local = not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in whole)
        self.len_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.len_b = np.array([len(x) for x in self.bytes_b], np.int64)
        n = len(str(max(len(self.bytes_a), len(self.bytes_b)))) + 1
        self.shown = np.array([f"{i}{mark}" for size, marks in ((len(self.bytes_a), ",|"), (len(self.bytes_b), ",;")) for mark in marks for i in range(size)], f"S{n}")
        self._empty()

    def _piece(self, i):
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if self.b.is_byte(i) else piece.replace(SPACE, " ").encode()

    def _empty(self):
        self.index = {}
        self.n = 0
        self.flat = [[np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]]
        self.lens = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
        self.right = [np.zeros(0, bool)]
        self.starts = [np.zeros(1, np.int64), np.zeros(1, np.int64)]

    def _learn(self, keys):
        """Keys: a chunk without its space, a chunk that begins with a line end, or (chunk,) for any other."""
        odd = [k for k in keys if type(k) is tuple]
        plain = sorted((k for k in keys if type(k) is str), key=lambda k: k[0] == "\n")  # the first one begins with a space, if one does
        parts = [plain[s : s + JOINED] for s in range(0, len(plain), JOINED)]
        text = ["".join(k if k[0] == "\n" else " " + k for k in p) for p in parts]
        for part, ids in zip(parts, zip(self._encode_a(text), self._encode_b(text), text)):
            if not self._add_joined(part, *ids):
                odd += part
        if odd:
            full = [k[0] if type(k) is tuple else k if k[:1] == "\n" else " " + k for k in odd]
            each = list(zip(self._encode_a(full), self._encode_b(full)))
            self._add(odd, each, [self._same(a, b, f.encode()) for (a, b), f in zip(each, full)])

    def _encode_a(self, full):
        return [e.ids for e in self.a.encode_batch_fast(full, add_special_tokens=False)]

    def _encode_b(self, full):
        """The space put before a text that begins with a line end is a token of its own."""
        ids = self.b.encode([f[1:] if f[:1] == " " else f for f in full], num_threads=1)
        return [x if f[:1] == " " else x[1:] for f, x in zip(full, ids)]

    def _same(self, a, b, raw):
        return b"".join(map(self.bytes_a.__getitem__, a)) == raw == b"".join(map(self.bytes_b.__getitem__, b))

    def _add_joined(self, keys, a, b, text):
        """Ids of chunks that were encoded as one text: told apart by the bytes they cover."""
        raw = text.encode()
        if not self._same(a, b, raw):
            return False
        ends = np.cumsum([len(k.encode()) + (k[0] != "\n") for k in keys])
        cut = [np.searchsorted(np.cumsum(size[ids]), ends) + 1 for size, ids in ((self.len_a, a), (self.len_b, b))]
        self._put(keys, [np.array(a, np.uint32), np.array(b, np.uint32)], [np.diff(c, prepend=0) for c in cut], np.ones(len(keys), bool))
        return True

    def _add(self, keys, each, right):
        lens = [np.fromiter((len(x[k]) for x in each), np.int64, len(each)) for k in (0, 1)]
        self._put(keys, [np.fromiter(chain.from_iterable(x[k] for x in each), np.uint32, int(lens[k].sum())) for k in (0, 1)], lens, np.array(right, bool))

    def _put(self, keys, ids, lens, right):
        self.index.update(zip(keys, range(self.n, self.n + len(keys))))
        self.n += len(keys)
        for store, new in ((self.flat[0], ids[0]), (self.flat[1], ids[1]), (self.lens[0], lens[0]), (self.lens[1], lens[1]), (self.right, right)):
            store.append(new)

    def settle(self):
        """Join what was put since the last time."""
        if len(self.right) > 1:
            self.flat = [[np.concatenate(x)] for x in self.flat]
            self.lens = [[np.concatenate(x)] for x in self.lens]
            self.right = [np.concatenate(self.right)]
            self.starts = [np.concatenate([[0], np.cumsum(x[0])]) for x in self.lens]

    def _keys(self, text, first):
        """A part of a text between two seams as keys. ``first``: it begins the text, so it has the space put in front."""
        if not self.local:
            return [(" " + text,)]
        body = text if first else text[1:]
        if (first or text[0] == " ") and " ".join(body.split()) == body.replace("\n", " ") and body:
            return body.replace("\n", " \n").split(" ")
        out = []
        for c in SEAM.split(" " + text if first else text):
            plain = len(c) > 1 and not c[1].isspace() and not c[-1].isspace()
            out.append(c[1:] if plain and c[0] == " " else c if plain and c[0] == "\n" else (c,))
        return out

    def parts(self, text):
        """A text as lists of keys, each of a stretch of about SLICE characters that ends at a seam."""
        if len(text) <= SLICE or not self.local:
            yield self._keys(text, True)
            return
        at = 0
        while at < len(text):
            seam = SEAM.search(text, min(at + SLICE, len(text)))
            to = seam.start() if seam else len(text)
            yield self._keys(text[at:to], not at)
            at = to

    def numbers(self, rows):
        """Chunk numbers of each list of keys."""
        out = [np.fromiter(map(self.index.get, keys, repeat(-1)), np.int64, len(keys)) for keys in rows]
        missing = [np.flatnonzero(x < 0) for x in out]
        if new := {keys[i] for keys, at in zip(rows, missing) for i in at.tolist()}:
            self._learn(list(new))
            for keys, x, at in zip(rows, out, missing):
                x[at] = [self.index[keys[i]] for i in at.tolist()]
        return out

    def ids(self, side, numbers):
        """Ids of some chunks in a row, and how many each has."""
        s = self.starts[side]
        return _gather(self.flat[side][0], s[numbers], s[numbers + 1] - s[numbers])


class _Text:
    """Running figures of one text."""

    __slots__ = ("n_a", "n_b", "n_groups", "digest", "bad", "links")

    def __init__(self):
        self.n_a = self.n_b = self.n_groups = 0
        self.digest, self.bad, self.links = hashlib.sha256(), False, []

    def figures(self):
        if self.bad or not self.n_a:
            return 0, 0, 0, "", np.zeros(0, np.int64)
        return self.n_a, self.n_b, self.n_groups, self.digest.hexdigest(), np.concatenate(self.links)


def _window(tok, texts, numbers):
    """Align stretches of whole chunks, each with the text it belongs to, in one go, and add to the texts' figures."""
    if not numbers:
        return
    counts = np.array([len(x) for x in numbers])
    (a, per_a), (b, per_b) = (tok.ids(side, np.concatenate(numbers)) for side in (0, 1))
    edge = np.concatenate([[0], np.cumsum(counts)])
    a_to, b_to = (np.concatenate([[0], np.cumsum(per)])[edge] for per in (per_a, per_b))
    at_a, at_b = common(np.cumsum(tok.len_a[a]), np.cumsum(tok.len_b[b]))
    end_a, end_b = at_a + 1, at_b + 1
    in_a, in_b = np.diff(end_a, prepend=0), np.diff(end_b, prepend=0)  # tokens of each group: differences of ranks
    show_a, show_b = a.astype(np.int64), b.astype(np.int64) + 2 * len(tok.bytes_a)
    show_a[at_a] += len(tok.bytes_a)
    show_b[at_b] += len(tok.bytes_b)
    row = np.empty(len(a) + len(b), np.int64)
    row[np.arange(len(a)) + np.repeat(end_b - in_b, in_a)] = show_a
    row[np.arange(len(b)) + np.repeat(end_a, in_b)] = show_b
    shown = tok.shown[row]
    links = (a[at_a].astype(np.int64) << 32) | b[at_b]
    group_to = np.searchsorted(end_a, a_to[1:], side="right").tolist()
    g = 0
    for text, to, k in zip(texts, group_to, range(len(texts))):
        text.n_a += int(a_to[k + 1] - a_to[k])
        text.n_b += int(b_to[k + 1] - b_to[k])
        part = shown[a_to[k] + b_to[k] : a_to[k + 1] + b_to[k + 1]].tobytes().translate(None, b"\0")
        text.digest.update((b";" if text.n_groups else b"") + part[:-1])
        text.n_groups += to - g
        text.links.append(links[g:to])
        g = to


_LOADED = {}


def _tokenizers(path_a, path_b):
    key = (path_a, path_b)
    if key not in _LOADED:
        _LOADED[key] = Tokenizers(path_a, path_b)
    return _LOADED[key]


def align_texts(tok, texts):
    """Figures of each text: (n_a, n_b, n_groups, digest of the groups, links as a << 32 | b)."""
    out = [_Text() for _ in texts]
    waiting, size = [], 0

    def flush():
        if len(tok.index) > tok.cache:
            tok._empty()
        numbers = tok.numbers([keys for _, keys in waiting])
        tok.settle()
        for (own, _), mine in zip(waiting, numbers):
            own.bad |= not tok.right[0][mine].all()
        good = [(own, mine) for (own, _), mine in zip(waiting, numbers) if not own.bad]
        _window(tok, [own for own, _ in good], [mine for _, mine in good])
        waiting.clear()

    for text, own in zip(texts, out):
        for keys in tok.parts(text) if text else ():
            waiting.append((own, keys))
            size += len(keys)
            if size >= WINDOW:
                flush()
                size = 0
    flush()
    return [t.figures() for t in out]


FIGURES = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
SCHEMA = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, pair long, n long"


def _blocks(docs, path_a, path_b, block):
    """Rows of SCHEMA: one per text (links: numbers of the block's pairs, pair null), and one per distinct pair of each block."""

    def close(number, rows, links):
        whole = np.concatenate([np.zeros(0, np.int64), *links])
        pairs, codes, counts = np.unique(whole, return_inverse=True, return_counts=True)
        codes = codes.astype("<i4")
        at, out = 0, []
        for r, x in zip(rows, links):
            out.append((number, *r, codes[at : at + len(x)].tobytes()))
            at += len(x)
        texts = pd.DataFrame(out, columns=["block", "doc_id", *FIGURES, "links"])
        texts["doc_id"] = texts["doc_id"].astype("Int64")
        # rows of texts go out in small frames, so that an Arrow batch stays small
        for s in range(0, len(texts), 256):
            yield texts[s : s + 256].assign(pair=pd.array([None] * len(texts[s : s + 256]), "Int64"), n=pd.array([None] * len(texts[s : s + 256]), "Int64"))
        for s in range(0, len(pairs), 100_000):
            t = pd.DataFrame({"block": number, "pair": pairs[s : s + 100_000], "n": counts[s : s + 100_000]})
            none = pd.array([None] * len(t), "Int64")
            yield t.assign(doc_id=none, n_a=none, n_b=none, n_groups=none, n_links=none, groups_sha256=None, links=None)[texts.columns.tolist() + ["pair", "n"]]

    def run(batches):
        tok = _tokenizers(path_a, path_b)
        number = TaskContext.get().partitionId() << 24
        rows, links, size = [], [], 0
        for b in batches:
            for doc, (n_a, n_b, n_groups, digest, own) in zip(b["doc_id"], align_texts(tok, b["text"])):
                rows.append((doc, n_a, n_b, n_groups, len(own), digest))
                links.append(own)
                size += len(own)
                if size >= block:
                    yield from close(number, rows, links)
                    number, rows, links, size = number + 1, [], [], 0
        if rows:
            yield from close(number, rows, links)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInPandas(run, SCHEMA)


def pair_counts(written):
    """(pair, total, best): links of each id pair over the corpus, and whether no pair of its B id has more. One B id has at most as many
    pairs as A has ids."""
    totals = written.filter("pair IS NOT NULL").groupBy("pair").agg(F.sum("n").alias("total")).withColumn("b", F.col("pair").bitwiseAND((1 << 32) - 1))
    most = totals.groupBy("b").agg(F.max("total").alias("most"))
    return totals.join(most, "b").select("pair", "total", (F.col("total") == F.col("most")).alias("best"))


def align(docs, path_a, path_b, block=BLOCK):
    """One row per row of ``docs`` (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    written = cut(_blocks(docs, path_a, path_b, block), "aligned")
    known = written.filter("pair IS NOT NULL").select("block", "pair").join(pair_counts(written), "pair").select(F.col("block").alias("of"), "pair", "total", "best")
    texts = written.filter("pair IS NULL").select("block", "doc_id", *FIGURES, "links")

    def weigh(texts, known):
        known = known.sort_values("pair")
        total, best = known["total"].to_numpy(), known["best"].to_numpy()
        codes = [np.frombuffer(x, "<i4") for x in texts["links"]]
        t = texts[["doc_id", *FIGURES]].copy()
        t["doc_id"] = t["doc_id"].astype("Int64")
        t["n_best"] = [int(best[c].sum()) for c in codes]
        t["count_sum"] = [int(total[c].sum()) for c in codes]
        return t

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    return texts.groupBy("block").cogroup(known.groupBy("of")).applyInPandas(weigh, schema)
