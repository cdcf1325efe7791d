"""Words of titles in packed columns: how rare each is, and the keys at which titles meet.

Titles lie in blocks, a row each: (g, size, levels, ids, ns, words, heads, hs): how many words, most heads of a title, and binary columns of
8 bytes a value (``ns`` and ``hs``: 4, words and heads of each title).
Words are 64-bit hashes of (word, day), in order within a title and written as steps. What a block has to say about a word or a key goes to a part, by the first bits of its hash, in one row.
"""

import math

import numpy as np

#: Words of a block, at least one title.
BLOCK = 1 << 19
#: Titles up to this many words have a length class of their own; longer ones share a class with titles up to STEP times as long.
EXACT, STEP = 12, 1.35
BLOCKS = "g bigint, size bigint, levels int, ids binary, ns binary, words binary, heads binary, hs binary"
SEEN = "part int, g bigint, u binary, f binary"
RARITY = "g bigint, part int, q binary"
ENTRIES = "part int, key binary, id binary, n binary, at binary"
PREFIXES = "ids binary, ns binary, words binary, ones binary, kept binary, heads binary, hs binary"
MET = "key bigint, id bigint, n bigint, at int, rank bigint, rep bigint"
#: Pairs that a task looks at together.
PAIRS = 1 << 20


def planes(a, width):
    """The low ``width`` bytes of whole numbers, plane by plane: high ones are mostly alike and compress."""
    return np.ascontiguousarray(np.asarray(a).astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def whole(buf, width):
    out = np.zeros((len(buf) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(buf, np.uint8).reshape(width, -1).T
    return out.view("<i8").ravel()


def steps(x, width):
    """Whole numbers in order as differences: the high bytes are zeros."""
    x = np.asarray(x).view("<u8")
    return planes(np.diff(x, prepend=x[:1] * 0).view("<i8"), width)


def walked(buf, width):
    return np.cumsum(whole(buf, width).view("<u8"), dtype=np.uint64)


def _batch(rows, schema):
    import pyarrow as pa

    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.RecordBatch.from_pylist(rows, pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")]))


def pack(batches):
    """Blocks of titles (id, words, heads)."""
    from pyspark import TaskContext

    task, made, held, size = TaskContext.get().partitionId(), 0, [], 0

    def block():
        ids, words, heads = zip(*held)
        lens = lambda x: np.array([len(w) for w in x], "<i4").tobytes()
        join = lambda x: np.concatenate(x).astype("<i8").tobytes()
        return _batch([{"g": task << 32 | made, "size": size, "levels": max(map(len, heads)), "ids": np.array(ids, "<i8").tobytes(), "ns": lens(words), "words": steps(np.concatenate([np.sort(w.view("<u8")) for w in words]), 8), "heads": join(heads), "hs": lens(heads)}], BLOCKS)

    for b in batches:
        lists = [[c.values.to_numpy(zero_copy_only=False)[i:j] for i, j in zip(o, o[1:])] for c in (b["words"], b["heads"]) for o in [c.offsets.to_numpy()]]
        for row in zip(b["id"].to_pylist(), *lists):
            held.append(row)
            size += len(row[1])
            if size >= BLOCK:
                yield block()
                made, held, size = made + 1, [], 0
    if held:
        yield block()


def unpack(row):
    """ids, number of words of each, words, heads, number of heads of each."""
    ids, ns, heads, hs = (np.frombuffer(row[c], t) for c, t in (("ids", "<i8"), ("ns", "<i4"), ("heads", "<u8"), ("hs", "<i4")))
    return ids, ns, walked(row["words"], 8), heads, hs


def _spans(x, bits):
    """(part, first, end) of sorted unsigned numbers that begin with the same ``bits`` bits."""
    ends = np.searchsorted(x >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    return [(p, a, b) for p, (a, b) in enumerate(zip(ends, ends[1:])) if b > a]


def seen(bits):
    """Each block's words and in how many of its titles they are, by part."""

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                u, f = np.unique(unpack(row)[2], return_counts=True)
                yield _batch([{"part": p, "g": row["g"], "u": steps(u[i:j], 8), "f": planes(f[i:j], 4)} for p, i, j in _spans(u, bits)], SEEN)

    return run


def rarity(table):
    """For a part: a byte for each word that a block has named, 0 if one title has it, higher the more titles have it."""
    import pyarrow as pa

    rows = table.to_pylist()
    u = [walked(r["u"], 8) for r in rows]
    _, at = np.unique(np.concatenate(u), return_inverse=True)
    total = np.bincount(at, np.concatenate([whole(r["f"], 4) for r in rows]))
    q = np.minimum(255, np.where(total > 1, 1 + np.floor(8 * np.log2(np.maximum(total, 1))), 0)).astype(np.uint8)[at]
    ends = np.cumsum([0, *map(len, u)])
    return pa.Table.from_batches([_batch([{"g": r["g"], "part": r["part"], "q": q[i:j].tobytes()} for r, i, j in zip(rows, ends, ends[1:])], RARITY)])


def least_shared(n, m, jac):
    """Words that titles of n and m different words must share."""
    return np.ceil(jac / (1 + jac) * (n + m) - 1e-9)


def _length_class(n):
    return np.where(n <= EXACT, n, EXACT + np.floor(np.log(np.maximum(n, 1) / EXACT) / math.log(STEP))).astype(np.int64)


def _class_floor(c):
    """A number of words that no title of the class is below."""
    return np.where(c <= EXACT, c, np.floor(EXACT * np.power(STEP, np.maximum(c, EXACT) - EXACT) - 1e-6))


def _mix(h, a, b):
    """64 bits of a hash and two small numbers."""
    x = h ^ (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _each(counts):
    """(which, how manieth) for each of counts[0] + counts[1] + ... things."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)


def prefixes(jac):
    """Blocks with only those words of a title that can be keys: rarest first, without those of one title only, as many as the shortest match leaves."""

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                _, ns, words, _, _ = unpack(row)
                n = ns.astype(np.int64)
                _, inv = np.unique(words, return_inverse=True)
                q = np.frombuffer(b"".join(x["q"] for x in sorted(row["rarity"], key=lambda x: x["part"])), np.uint8)[inv]
                title = np.repeat(np.arange(len(n)), n)
                ones = np.bincount(title[q == 0], minlength=len(n))
                room = n - least_shared(n, np.ceil(n * jac - 1e-9), jac).astype(np.int64) + 1
                kept = np.maximum(np.minimum(room, n) - ones, 0)
                words = words[np.lexsort((words, q, title))]
                which, i = _each(kept)
                words = words[(np.cumsum(n) - n + ones)[which] + i]
                yield _batch([{c: row[c] for c in ("ids", "ns", "heads", "hs")} | {"words": words.tobytes(), "ones": ones.astype("<i4").tobytes(), "kept": kept.astype("<i4").tobytes()}], PREFIXES)

    return run


def entries(row, jac, levels):
    """(key, title, at) of a block. A key is a word with the length classes of both titles; a title has one for each class it can match and each
    place where the rest of it, rarest words first, is still long enough; ``at`` is that place. Words of one title only come first and meet nothing.
    Other keys (``at`` -1) are beginnings of 20, 40, 80, ... characters: of two titles one can only begin the other if they agree on the longest
    of these that both have, so it goes with both titles' numbers of beginnings."""
    n, ones, kept, h = (np.frombuffer(row[c], "<i4").astype(np.int64) for c in ("ns", "ones", "kept", "hs"))
    words, heads = (np.frombuffer(row[c], "<u8") for c in ("words", "heads"))
    low = np.ceil(n * jac - 1e-9)
    first = _length_class(low)
    t, i = _each(_length_class(np.floor(n / jac + 1e-9)) - first + 1)
    c, own = first[t] + i, _length_class(n)
    room = n[t] - least_shared(n[t], np.maximum(_class_floor(c), low[t]), jac).astype(np.int64) + 1
    e, i = _each(np.maximum(np.minimum(room, n[t]) - ones[t], 0))
    t, c = t[e], c[e]
    key = _mix(words[(np.cumsum(kept) - kept)[t] + i], np.minimum(own[t], c), np.maximum(own[t], c))
    ht, hl = _each(np.where(h > 0, levels, 0))
    mine = h[ht] - 1
    head = _mix(heads[(np.cumsum(h) - h)[ht] + np.minimum(mine, hl)], np.minimum(mine, hl) + (1 << 20), np.maximum(mine, hl) + (1 << 20))
    return np.concatenate([key, head]), np.concatenate([t, ht]), np.concatenate([ones[t] + i, np.full(len(ht), -1)])


def sent(bits, jac, levels):
    """Entries of each block by part."""

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                ids, ns = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["ns"], "<i4")
                key, t, at = entries(row, jac, levels)
                o = np.argsort(key)
                key, t, at = key[o], t[o], at[o]
                short = key << np.uint64(bits) >> np.uint64(32)
                for p, i, j in _spans(key, bits):
                    x = t[i:j]
                    yield _batch([{"part": p, "key": steps(short[i:j], 4), "id": planes(ids[x], 8), "n": planes(ns[x], 4), "at": planes(at[i:j] + 1, 4)}], ENTRIES)

    return run


def can_match(n, at, m, rep_at, jac):
    """Of pairs met at a key: at a beginning (-1), or lengths fit and both have enough words from there on."""
    need = least_shared(n, m, jac)
    word = (at >= 0) & (rep_at >= 0) & (n >= jac * m - 1e-9) & (m >= jac * n - 1e-9) & (n - at >= need) & (m - rep_at >= need)
    return word | (at < 0) & (rep_at < 0)


def meet(jac, first):
    """For a part: pairs (id, rep, ``at`` null at a beginning) of each title with the ``first`` titles before it by id at a key that can match, and
    the entries behind those with their place in the key, where there are more. 32 bits and the part tell keys apart; two that fall together bring
    pairs that don't match."""

    def run(table):
        import pyarrow as pa

        part = table["part"][0].as_py()
        key = np.concatenate([walked(x, 4) for x in table["key"].to_pylist()]).view("<i8")
        ids, n, at = (np.concatenate([whole(x, w) for x in table[c].to_pylist()]) for c, w in (("id", 8), ("n", 4), ("at", 4)))
        o = np.lexsort((at, ids, key))
        key, ids, n, at = key[o], ids[o], n[o], at[o] - 1
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(new, len(key)))
        begin, size = np.repeat(new, size), np.repeat(size, size)
        rank = np.arange(len(key)) - begin
        counts = np.minimum(rank, first)
        total, found, i = np.cumsum(counts), [np.zeros((0, 3), np.int64)], 0
        while i < len(key):
            j = max(i + 1, int(np.searchsorted(total, total[i] - counts[i] + PAIRS, "right")))
            e, k = _each(counts[i:j])
            e += i
            r = begin[e] + k
            ok = (ids[e] != ids[r]) & can_match(n[e], at[e], n[r], at[r], jac)
            e, r = e[ok], r[ok]
            found, i = [*found, np.stack([ids[e], ids[r], np.minimum(at[e], 0)], 1)], j
        pairs = np.concatenate(found)
        pairs = pairs[np.lexsort(pairs.T)]
        pairs = pairs[np.concatenate([[True], (pairs[1:] != pairs[:-1]).any(1)])] if len(pairs) else pairs
        more = (size > first + 1) & (rank >= first)
        key, ids, n, at, rank = (x[more] for x in (key | part << 32, ids, n, at, rank))
        null = lambda m, t: pa.nulls(m, t)
        places = lambda x: pa.array(x.astype(np.int32), mask=x < 0)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        columns = [[null(len(pairs), kinds[0]), pairs[:, 0], null(len(pairs), kinds[2]), places(pairs[:, 2]), null(len(pairs), kinds[4]), pairs[:, 1]], [key, ids, n, places(at), rank, null(len(key), kinds[5])]]
        return pa.concat_tables([pa.table([pa.array(x) if isinstance(x, np.ndarray) else x for x in c], [x.split()[0] for x in MET.split(", ")]) for c in columns])

    return run


def signatures(batches):
    """(id, n, sig) of titles: a bit is whether an odd number of the title's words fall on it; 4 bits a word or more."""
    import pyarrow as pa

    for b in batches:
        for row in b.to_pylist():
            ids, ns, words = unpack(row)[:3]
            sigs = []
            for w, n in zip(np.split(words, np.cumsum(ns)[:-1]), ns.tolist()):
                bits = 1 << max(7, (4 * n - 1).bit_length())
                sigs.append(np.packbits(np.bincount((w & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes())
            yield pa.record_batch({"id": ids, "n": ns.astype(np.int64), "sig": pa.array(sigs, pa.binary())})


def apart(a, b):
    """A number of words that only one of two titles has, at least: bits that differ, after the longer signature is folded to the shorter one's length."""
    if len(a) > len(b):
        a, b = b, a
    x, y, size = int.from_bytes(a, "little"), int.from_bytes(b, "little"), 8 * len(b)
    while size > 8 * len(a):
        size //= 2
        y = (y >> size) ^ (y & (1 << size) - 1)
    return (x ^ y).bit_count()


def near(jac):
    """Pairs (id, rep, n, sig, n_rep, sig_rep) that may share enough words: all that do, and few others."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            n, m = (b[c].to_numpy() for c in ("n", "n_rep"))
            most = (n + m - 2 * least_shared(n, m, jac)).tolist()
            ok = pa.array([apart(x.as_py(), y.as_py()) <= d for x, y, d in zip(b["sig"], b["sig_rep"], most)], pa.bool_())
            yield b.select(["id", "rep"]).filter(ok)

    return run
