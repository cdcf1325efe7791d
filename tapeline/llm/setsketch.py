"""Near-duplicate documents by SetSketch registers.

A document's register i is the smallest of exponential values that hash i gives its shingles, truncated to a power of BASE. Two registers are
equal with a probability a little above the Jaccard similarity, and the register-wise maximum of two sketches is the sketch of the union.

1. Equal word sequences collapse to one representative (the smallest id).
2. Bands of registers make buckets. In each bucket the member that shares most buckets is the centre; every other member is compared with it.
3. Members still apart from their bucket's largest component are compared with one more member of it, another one in each band.
4. What is still apart is compared pair by pair inside blocks of a bucket, in memory: first by registers, then, for members with a pair that
   the likelihood of the registers allows, by full sets. A block gives its links, no more than it has members.
5. Every link is confirmed on the full sets of both documents, and components are taken over confirmed links only.

Full sets are made for documents that need them only. Their texts are found by a broadcast of at most 2^FILTER_BITS hash values, then joined.

A linked pair of similarity 0.8 shares no band with probability (1 - 0.8^5)^32 = 3e-6 at most, and fails the likelihood test with about 1e-6.

Defined results: doc_id names a text; a null, empty or white-space text has no shingles, n_shingles 0, and is linked with nothing; a row without doc_id takes no
part (component_id null, kept true); rows that repeat an id with equal text get equal results; an empty table gives an empty result. Only
doc_id and text are read, so other columns can have any name.
"""

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import functions as F

from ..session import cut
from .graph import components

REGISTERS, BAND, BASE, SHIFT = 160, 5, 1.1, 10
#: Bound of the broadcast that finds texts by hashed id.
FILTER_BITS = 20
#: Logarithm by which the best similarity at or over the threshold may be less likely than the best one of all.
SLACK = 11.0
#: Rows of one bucket compared in one task.
BLOCK = 512
_RNG = np.random.default_rng(20_240_607)
_MUL = _RNG.integers(0, 2**31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _RNG.integers(0, 2**32, REGISTERS, dtype=np.uint32)
_STEP = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


class _Hashes(dict):
    def __missing__(self, word):
        if len(self) > 300_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_WORDS = _Hashes()


def _mixed(x):
    x = (x ^ (x >> np.uint64(31))) * _STEP[0]
    x = (x ^ (x >> np.uint64(29))) * _STEP[1]
    return x ^ (x >> np.uint64(32))


def lower_words(text):
    """Words as bytes; lower() of bytes changes A-Z only."""
    return (text or "").encode("utf-8").lower().split()


def word_shingles(ws, size):
    """Sorted distinct 64-bit hashes of the shingles of lower-cased words; with fewer words than ``size``, of the whole sequence."""
    if not ws:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, ws), np.uint64, len(ws))
    n = min(size, len(ws))
    acc = np.full(len(ws) - n + 1, n, np.uint64)
    for k in range(n):
        acc = _mixed(acc * _STEP[2] + h[k : len(h) - n + 1 + k])
    return np.unique(acc)


def registers(hashes):
    """The sketch of a set of 64-bit hashes: REGISTERS bytes; zeros for an empty set."""
    if not len(hashes):
        return np.zeros(REGISTERS, np.uint8)
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 2**32 - 1, np.uint32)
    for k in range(0, len(x), 1024):
        part = x[k : k + 1024, None] * _MUL
        part += _ADD
        np.minimum(least, part.min(0), out=least)
    value = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32)
    return np.clip(np.floor(SHIFT - np.log(value) / np.log(BASE)), 0, 255).astype(np.uint8)


def merged(a, b):
    """The sketch of the union of two sets."""
    return np.maximum(a, b)


_GRID = np.linspace(0, 1, 101)


def _log_likelihood(up, down, share, j):
    """Of similarity ``j``: up and down registers that differ either way, the rest equal; share: the first set's part of both sizes."""
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    pu, pd_ = p(share - (1 - share) * j), p(1 - share - share * j)
    return up * np.log(np.maximum(pu, 1e-9)) + down * np.log(np.maximum(pd_, 1e-9)) + (REGISTERS - up - down) * np.log(np.maximum(1 - pu - pd_, 1e-9))


def similarity(a, b, na, nb):
    """Most likely Jaccard similarity of sketch pairs (rows of a and b) given the set sizes, on a grid of hundredths."""
    up, down = (a > b).sum(-1).astype(float), (a < b).sum(-1).astype(float)
    share = na / np.maximum(1, na + nb)
    most = np.minimum(na, nb) / np.maximum(1, np.maximum(na, nb))
    ll = np.stack([np.where(g <= most + 1e-9, _log_likelihood(up, down, share, g), -np.inf) for g in _GRID])
    return _GRID[ll.argmax(0)]


def may_link(a, b, na, nb, percent):
    """Whether sizes and registers leave the pair a chance to reach ``percent``."""
    na, nb = np.asarray(na, float), np.asarray(nb, float)
    ok = 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
    k = np.flatnonzero(ok)
    if not len(k):
        return ok
    up, down = (a[k] > b[k]).sum(-1).astype(float), (a[k] < b[k]).sum(-1).astype(float)
    share = na[k] / (na[k] + nb[k])
    most = np.minimum(na[k], nb[k]) / np.maximum(na[k], nb[k])
    best, over = np.full(len(k), -np.inf), np.full(len(k), -np.inf)
    for g in np.unique(np.concatenate([_GRID[30::2], [percent / 100]])):
        ll = np.where(g <= most + 1e-9, _log_likelihood(up, down, share, g), -np.inf)
        best = np.maximum(best, ll)
        over = np.maximum(over, ll) if g >= percent / 100 - 1e-9 else over
    ok[k] = over >= best - SLACK
    return ok


def sketched(docs, size):
    """(doc_id, digest of the word sequence, n, sketch) of every document."""

    def rows(batches):
        for b in batches:
            out = []
            for t in b["text"]:
                ws = lower_words(t)
                h = word_shingles(ws, size)
                out.append((hashlib.md5(b" ".join(ws)).digest(), len(h), registers(h).tobytes()))
            got = pd.DataFrame(out, columns=["digest", "n", "sketch"])
            got.insert(0, "doc_id", b["doc_id"].to_numpy())
            yield got

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    return own.mapInPandas(rows, "doc_id long, digest binary, n long, sketch binary")


def _block_pairs(t, keys, chunk=50_000):
    """Row numbers (p, q) of members of different components in the blocks of ``t`` (rows sorted by block), some at a time."""
    if not len(t):
        return
    key = t[keys].to_numpy()
    start = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1])
    size = np.diff(np.append(start, len(t)))
    after = np.repeat(start + size, size) - np.arange(len(t)) - 1  # rows behind each row in its block
    ends = np.cumsum(after)
    root, block = t["root"].to_numpy(), t["block"].to_numpy()
    mixed = key[:, 1] != key[:, 2]
    for lo in range(0, int(ends[-1]), chunk):
        at = np.arange(lo, min(lo + chunk, int(ends[-1])))
        p = np.searchsorted(ends, at, side="right")
        q = p + 1 + at - (ends[p] - after[p])
        ok = (root[p] != root[q]) & (~mixed[p] | (block[p] != block[q]))
        yield p[ok], q[ok]


def _hopeful(t, keys, percent):
    """The rows of ``t`` with a partner in their block, of another component, that they may link with."""
    s = np.frombuffer(b"".join(t["sketch"]), np.uint8).reshape(-1, REGISTERS)
    n, found = t["n"].to_numpy(), np.zeros(len(t), bool)
    for p, q in _block_pairs(t, keys):
        ok = may_link(s[p], s[q], n[p], n[q], percent)
        found[p[ok]] = True
        found[q[ok]] = True
    return t.loc[found, [*keys, "block", "rep", "root"]]


def _block_links(t, percent):
    """Links between the components of one block, by full sets: each member meets all others by its shingles' lists; no link within what is
    already one component here."""
    sets = [np.frombuffer(h, np.uint64) for h in t["hashes"]]
    rep, root, n = t["rep"].to_numpy(), t["root"].to_numpy(), np.array([len(x) for x in sets])
    names, of = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.repeat(np.arange(len(sets)), n)
    order = np.argsort(of, kind="stable")
    lists, first = own[order], np.searchsorted(of[order], np.arange(len(names) + 1))
    at = np.concatenate([[0], np.cumsum(n)])
    up = {r: r for r in set(root.tolist())}

    def top(r):
        while up[r] != r:
            up[r] = r = up[up[r]]
        return r

    out = []
    names, k_of = np.unique(root, return_inverse=True)
    for k in np.flatnonzero(k_of != np.bincount(k_of).argmax()):  # one side of a link is outside the largest component
        lo, hi = first[of[at[k] : at[k + 1]]], first[of[at[k] : at[k + 1]] + 1]
        many = hi - lo
        pos = np.repeat(lo - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
        both = np.bincount(lists[pos], minlength=len(sets))
        for m in np.flatnonzero((both * 100 >= percent * (n[k] + n - both)) & (root != root[k])):
            a, b = top(int(root[k])), top(int(root[m]))
            if a != b:
                up[a] = b
                out.append((min(rep[k], rep[m]), max(rep[k], rep[m])))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _by_block(batches, keys):
    """Whole blocks of sorted rows, as many as a batch completes."""
    carry = None
    for t in batches:
        t = t if carry is None else pd.concat([carry, t], ignore_index=True)
        fresh = (t[keys].to_numpy()[1:] != t[keys].to_numpy()[:-1]).any(1)
        whole = int(np.flatnonzero(fresh)[-1]) + 1 if fresh.any() else 0
        carry = t.iloc[whole:]
        if whole:
            yield t.iloc[:whole].reset_index(drop=True)
    if carry is not None and len(carry):
        yield carry.reset_index(drop=True)


class _Sets:
    """Full shingle sets by representative, made once for those asked for."""

    def __init__(self, docs, size):
        self.texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text"))
        self.size, self.made = size, None

    def of(self, reps):
        need = reps.distinct() if self.made is None else reps.distinct().join(self.made.select("rep"), "rep", "left_anti")
        need = cut(need, "needed")
        mark = F.pmod(F.xxhash64("rep"), F.lit(1 << FILTER_BITS))
        near = self.texts.withColumn("mark", mark).join(F.broadcast(need.select(mark.alias("mark")).distinct()), "mark", "left_semi").drop("mark")
        size = self.size

        def hashed(batches):
            for b in batches:
                yield pd.DataFrame({"rep": b["rep"], "hashes": [word_shingles(lower_words(t), size).tobytes() for t in b["text"]]})

        new = cut(near.join(need, "rep", "left_semi").dropDuplicates(["rep"]).mapInPandas(hashed, "rep long, hashes binary"), "sets")
        self.made = new if self.made is None else self.made.unionByName(new)
        return self.made


def _confirmed(pairs, sets, sketches, percent):
    """The pairs (a, b) whose full sets reach the threshold; written."""
    a, b = (sketches.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "ab")

    def allowed(batches):
        for t in batches:
            if len(t):
                s = [np.frombuffer(b"".join(t[c]), np.uint8).reshape(-1, REGISTERS) for c in ("sa", "sb")]
                yield t.loc[may_link(*s, t["na"], t["nb"], percent), ["a", "b"]]

    def linked(batches):
        for t in batches:
            keep = []
            for x, y in zip(t["ha"], t["hb"]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                x, y = (x, y) if len(x) < len(y) else (y, x)
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0
                keep.append(bool(both) and 100 * both >= percent * (len(x) + len(y) - both))
            yield t.loc[np.array(keep, bool), ["a", "b"]]

    ready = pairs.join(a, "a").join(b, "b").filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    good = cut(ready.select("a", "b", "na", "nb", "sa", "sb").mapInPandas(allowed, "a long, b long"), "hopeful")
    full = sets.of(good.select(F.explode(F.array("a", "b")).alias("rep")))
    sa, sb = (full.select(F.col("rep").alias(x), F.col("hashes").alias(f"h{x}")) for x in "ab")
    return cut(good.join(sa, "a").join(sb, "b").select("a", "b", "ha", "hb").mapInPandas(linked, "a long, b long"), "links")


def _pair(x, y):
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def near_duplicates(docs, size=5, percent=80):
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``; ``size`` words a shingle, linked from ``percent`` hundredths on."""
    every = cut(sketched(docs, size), "sketches")
    first = every.filter("n > 0").groupBy("digest").agg(F.min(F.struct("doc_id", "n", "sketch")).alias("x"))
    reps = cut(first.select("digest", F.col("x.doc_id").alias("rep"), "x.n", "x.sketch"), "reps")
    bands = F.transform(F.sequence(F.lit(0), F.lit(REGISTERS // BAND - 1)), lambda k: F.xxhash64(k, F.substring("sketch", k * BAND + 1, F.lit(BAND))))
    rows = reps.select("rep", F.explode(bands).alias("bucket")).repartition("bucket")
    size_of = rows.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1")
    buckets = cut(rows.join(size_of, "bucket"), "buckets")
    sketches = cut(reps.join(buckets.select("rep").distinct(), "rep", "left_semi").select("rep", "n", "sketch"), "candidates")
    sets = _Sets(docs, size)

    weight = buckets.groupBy("rep").agg(F.sum("members").alias("weight"))
    centre = buckets.join(weight, "rep").groupBy("bucket").agg(F.max(F.struct("weight", -F.col("rep"))).alias("x"))
    centre = centre.select("bucket", (-F.col("x.col2")).alias("centre"))
    tried = cut(buckets.join(centre, "bucket").filter("rep <> centre").select(*_pair("rep", "centre")).distinct(), "pairs")
    links = _confirmed(tried, sets, sketches, percent)
    roots = cut(components(links.toDF("u", "v")), "roots")

    def labelled():
        """Buckets that still hold several components; the one pair of a bucket of two has been tried."""
        own = buckets.filter("members > 2").join(roots.withColumnRenamed("u", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
        several = own.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("bucket")
        return cut(own.join(several, "bucket"), "apart")

    def joined(new):
        """Roots after more links."""
        to = roots.withColumnRenamed("root", "r")
        ends = new.join(to.select(F.col("u").alias("a"), F.col("r").alias("ra")), "a", "left").join(to.select(F.col("u").alias("b"), F.col("r").alias("rb")), "b", "left")
        over = components(ends.select(F.coalesce("ra", "a").alias("u"), F.coalesce("rb", "b").alias("v")))
        old = roots.join(over.select(F.col("u").alias("root"), F.col("root").alias("top")), "root", "left").select("u", F.coalesce("top", "root").alias("root"))
        return cut(old.unionByName(over.join(roots, "u", "left_anti")), "roots")

    apart = labelled()
    crowd = apart.groupBy("bucket", "root").agg(F.count("*").alias("k"), F.max_by("rep", F.xxhash64("rep", "bucket")).alias("one"))
    crowd = crowd.groupBy("bucket").agg(F.max(F.struct("k", -F.col("root"), "one")).alias("x"))
    crowd = crowd.select("bucket", (-F.col("x.col2")).alias("main"), F.col("x.one").alias("one"))
    more = apart.join(crowd, "bucket").filter("root <> main").select(*_pair("rep", "one")).distinct()
    roots = joined(_confirmed(more.join(tried, ["a", "b"], "left_anti"), sets, sketches, percent))

    keys = ["bucket", "i", "j"]
    apart = labelled()
    own = apart.withColumn("blocks", F.ceil(F.col("members") / F.lit(BLOCK)).cast("int")).withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(sketches, "rep")
    dealt = dealt.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "root", "n", "sketch")

    def hopeful(batches):
        for t in _by_block(batches, keys):
            yield _hopeful(t, keys, percent)

    def exact(batches):
        for t in _by_block(batches, keys):
            for _, block in t.groupby(keys, sort=False):
                yield _block_links(block, percent)

    found = dealt.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(hopeful, "bucket long, i int, j int, block int, rep long, root long")
    found = cut(found, "hopeful")
    full = found.join(sets.of(found.select("rep")), "rep").select(*keys, "rep", "root", "hashes")
    roots = joined(cut(full.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(exact, "a long, b long"), "links"))

    found = every.select("doc_id", "digest", "n").join(reps.select("digest", "rep"), "digest", "left").join(roots.withColumnRenamed("u", "rep"), "rep", "left")
    found = found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "rep", "doc_id").alias("component_id"))
    found = found.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    lost = docs.filter("doc_id is null").select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return found.unionByName(lost)
