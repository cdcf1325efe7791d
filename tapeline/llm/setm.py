"""Frequent phrases by set-oriented mining over sorted occurrence relations, and the collocations among them.

Relation R_1 holds (address, word) of every occurrence in a block of texts, sorted by address; words of one piece stand at adjacent addresses and
pieces are a place apart, so an address is piece and position in one. Level by level:

    R'_k+1 = merge-join of R_k with R_1 at address + k        in the block's task, both sides sorted
    C_k+1  = group-count of R'_k+1 over all blocks            a block's distinct groups with their counts go to parts of a hash of the group
    R_k+1  = semi-join of R'_k+1 with the frequent groups     a part sends each block the numbers of its frequent groups

A group is (number of the frequent group it extends, number of the word), two exact integers. Relations are written in buckets of blocks (a row
per block, integers packed) and stay where they are; a level shuffles a block's distinct groups once and the numbers of the frequent ones back.
The number of parts follows the number of words, so a part stays below PART groups. Groups of an infrequent part never arise.

Everything is per language. Defined results: a null text has no words, a null language is ``und``. Repeated rows count each time. Long texts are
taken in slices, a text longer than a block makes a longer block (four bytes a word). Other columns are not read. No rows, or none frequent, give
no rows.
"""

import uuid
from collections import defaultdict
from itertools import count

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import run_dir

#: Words in a block, bytes of a text that are split at once, rows in a frame that leaves a task, groups that one task counts at most.
BLOCK, SLICE, FRAME, PART = 3_000_000, 1 << 22, 100_000, 1_000_000
# Upper-case A-Z become lower case, the marks and line ends between pieces one byte that no UTF-8 text holds, tabs spaces.
BREAK = b"\xff"
MARKS = b".,;:!?\x0a\x0b\x0c\x0d"
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + MARKS + b"\t", b"abcdefghijklmnopqrstuvwxyz" + BREAK * len(MARKS) + b" ")

RELATION = "block long, level int, address binary, items binary, numbers binary"
WORDS = RELATION + ", item long, lang string, word string, n long"
GROUPS = RELATION + ", part long, heads binary, tails binary, counts binary"
COUNTED = "head long, tail long, number long, a long, block long, items binary, numbers binary"


def pack(x):
    """Integers as compressed byte planes."""
    import zstandard

    x = np.ascontiguousarray(x, "<i8" if x.dtype.itemsize == 8 else "<i4")
    size = x.dtype.itemsize
    return bytes([size]) + zstandard.ZstdCompressor(level=3).compress(x.view(np.uint8).reshape(-1, size).T.tobytes())


def unpack(raw):
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), np.uint8)
    return np.ascontiguousarray(planes.reshape(raw[0], -1).T).view("<i8" if raw[0] == 8 else "<i4").ravel()


def _frame(schema, **columns):
    """Rows of a schema; columns left out are null."""
    names = [c.split() for c in schema.split(", ")]
    t = pd.DataFrame(columns)
    for name, kind in names:
        if name not in t:
            t[name] = None if kind in ("binary", "string") else pd.array([None] * len(t), "Int64")
    return t[[name for name, _ in names]]


def _relation(schema, block, level, address, items, numbers):
    packed = pack(np.diff(address, prepend=0).astype(np.int32)), pack(items.astype(np.int32)), pack(numbers.astype(np.int64))
    return _frame(schema, block=[block], level=[level], address=[packed[0]], items=[packed[1]], numbers=[packed[2]])


def _part_of(head, tail, parts):
    """Which part of all groups counts a group: a mixed hash of both numbers."""
    h = head.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + tail.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(29))) % np.uint64(parts)).astype(np.int64)


def _dealt(block, head, tail, n, parts):
    """A block's groups packed by the part that counts them. Items are their places in the block's own order."""
    part = _part_of(head, tail, parts)
    order = np.argsort(part, kind="stable")
    edge = np.searchsorted(part[order], np.arange(parts + 1))
    own = [(k, order[edge[k] : edge[k + 1]]) for k in np.unique(part).tolist()]
    cuts = lambda x: [pack(x[at]) for _, at in own]
    rises = lambda x: [pack(np.diff(x[at], prepend=0).astype(x.dtype)) for _, at in own]
    items = rises(np.arange(len(n), dtype=np.int32))
    return _frame(GROUPS, block=np.full(len(own), block), part=[k for k, _ in own], items=items, heads=rises(head), tails=cuts(tail), counts=cuts(n.astype(np.int32)))


def _count(least):
    """Group-count and semi-join of one part: its frequent groups with numbers, and for each block the items that are frequent."""

    def merged(rows):
        heads, tails, counts = ([unpack(x) for x in rows[c]] for c in ("heads", "tails", "counts"))
        heads = [np.cumsum(x) for x in heads]
        items = np.concatenate([np.cumsum(unpack(x), dtype=np.int64) for x in rows["items"]])
        edge = np.concatenate([[0], np.cumsum([len(x) for x in heads])])
        head, tail, n = (np.concatenate(x).astype(np.int64) for x in (heads, tails, counts))
        order = np.lexsort((tail, head))
        head, tail = head[order], tail[order]
        first = np.append(True, (head[1:] != head[:-1]) | (tail[1:] != tail[:-1]))
        starts = np.flatnonzero(first)
        a = np.add.reduceat(n[order], starts)
        kept = np.flatnonzero(a >= least)
        number = np.full(len(starts), -1, np.int64)
        number[kept] = (int(rows["part"].iloc[0]) << 32) + np.arange(len(kept))
        of = np.empty(len(order), np.int64)
        of[order] = number[np.cumsum(first) - 1]
        out = [_frame(COUNTED, head=head[starts[kept]], tail=tail[starts[kept]], number=number[kept], a=a[kept])]
        back = []
        for block, lo, hi in zip(rows["block"].tolist(), edge[:-1].tolist(), edge[1:].tolist()):
            hit = np.flatnonzero(of[lo:hi] >= 0)
            if len(hit):
                back.append((block, pack(np.diff(items[lo:hi][hit], prepend=0).astype(np.int32)), pack(of[lo:hi][hit])))
        if back:
            block, item, own = zip(*back)
            out.append(_frame(COUNTED, block=list(block), items=list(item), numbers=list(own)))
        return pd.concat(out, ignore_index=True)

    return merged


class _Block:
    """Occurrences of one block while texts come in. Number 0 is the gap between pieces."""

    def __init__(self):
        self.next = count(1)
        self.words, self.parts, self.size = {}, [], 0

    def add(self, lang, texts):
        if lang not in self.words:
            self.words[lang] = defaultdict(self.next.__next__, {BREAK: 0})
        number = self.words[lang].__getitem__
        raw = BREAK.join(texts).translate(FOLD)
        at = 0
        while at < len(raw):
            to = raw.find(b" ", at + SLICE) if len(raw) - at > SLICE else len(raw)
            to = len(raw) if to < 0 else to
            tokens = raw[at:to].replace(BREAK, b" " + BREAK + b" ").split()
            self.parts.append(np.fromiter(map(number, tokens), np.int32, len(tokens)))
            self.size += len(tokens)
            at = to
        self.parts.append(np.zeros(1, np.int32))

    def frames(self, block):
        x = np.concatenate(self.parts)
        address = np.flatnonzero(x)
        items = x[address]
        yield _relation(WORDS, block, 0, address, items, np.zeros(0, np.int64))
        n = np.bincount(items)
        for lang, words in self.words.items():
            own = [(w, i) for w, i in words.items() if i]
            for s in range(0, len(own), FRAME):
                part = own[s : s + FRAME]
                item = np.array([i for _, i in part], np.int64)
                yield _frame(WORDS, block=np.full(len(item), block), item=item, lang=lang, word=[w.decode() for w, _ in part], n=n[item])


def _occurrences(docs, block_size):
    def run(batches):
        number, block = TaskContext.get().partitionId() << 24, _Block()
        for b in batches:
            by = {}
            for lang, text in zip(b["lang"], b["text"]):
                if text:
                    by.setdefault(lang, []).append(text.encode())
            for lang, texts in by.items():
                block.add(lang, texts)
                if block.size >= block_size:
                    yield from block.frames(number)
                    number, block = number + 1, _Block()
        if block.size:
            yield from block.frames(number)

    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).mapInPandas(run, WORDS)


def merge_join(address, k, words):
    """Places in R_k and in R_1 of the occurrences that R_1 goes on with: both are sorted, so each meets its next in one pass."""
    at = np.searchsorted(words, address + k)
    hit = np.flatnonzero(words[np.minimum(at, len(words) - 1)] == address + k) if len(words) else np.zeros(0, np.int64)
    return hit, at[hit]


def _groups(k, left, words):
    """R'_k+1 of a block: addresses, local numbers of their groups, and the groups as (place in R_k's numbers, place in R_1's)."""
    (address, items, _), (word_at, word_items, word_numbers) = left, words
    hit, at = merge_join(address, k, word_at)
    key = items[hit].astype(np.int64) * max(1, len(word_numbers)) + word_items[at]
    found, own, n = np.unique(key, return_inverse=True, return_counts=True)
    return address[hit], own, (found // max(1, len(word_numbers)), found % max(1, len(word_numbers)), n)


def _semi_join(address, items, known):
    """Occurrences of frequent groups, numbered anew. ``known``: the block's frequent items and their numbers, as rows or packed."""
    if "items" in known:
        parts = [(np.cumsum(unpack(i), dtype=np.int64), unpack(n)) for i, n in zip(known["items"], known["numbers"])]
        item, number = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*parts) if parts else ((), ())))
    else:
        item, number = known["item"].to_numpy(np.int64), known["number"].to_numpy(np.int64)
    order = np.argsort(item)
    item, number = item[order], number[order]
    at = np.searchsorted(item, items)
    hit = np.flatnonzero(item[np.minimum(at, len(item) - 1)] == items) if len(item) else np.zeros(0, np.int64)
    order = np.argsort(number)  # local numbers rise with the groups' own, so that groups come out in order and pack well
    local = np.empty(len(order), np.int64)
    local[order] = np.arange(len(order))
    return address[hit], local[at[hit]], number[order]


def _level(k, parts, last):
    """A block's step from level k to k + 1: R_k (written unless it is the last) and its groups. The block's row has R_0, or R_1 and R_k-1."""

    def step(relation, known):
        row = relation.iloc[0]
        read = lambda end: (np.cumsum(unpack(row["address" + end]), dtype=np.int64), unpack(row["items" + end]), unpack(row["numbers" + end]))
        if k == 1:
            own = words = _semi_join(*read("")[:2], known)
        else:
            words = read("")
            address, items, _ = _groups(k - 1, read("_before") if k > 2 else words, words)
            own = _semi_join(address, items, known)
        _, _, (head, tail, n) = _groups(k, own, words)
        out = _dealt(int(row["block"]), own[2][head], words[2][tail], n, parts)
        return out if last else pd.concat([_relation(GROUPS, int(row["block"]), k, *own), out], ignore_index=True)

    return step


class _Tables:
    """Written tables of one run, by name; each may be dropped when nothing reads it any more."""

    def __init__(self, spark):
        self.spark, self.paths, self.names = spark, {}, {}

    def cut(self, df, name):
        self.paths[name] = run_dir(self.spark, f"setm-{name}")
        df.write.option("compression", "zstd").parquet(self.paths[name])
        return self.spark.read.schema(df.schema).parquet(self.paths[name])

    def by_block(self, df, name):
        """Written in buckets of blocks, so that what is joined to a block moves and the block doesn't."""
        self.paths[name], self.names[name] = run_dir(self.spark, f"setm-{name}"), f"setm_{name}_{uuid.uuid4().hex}"
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.option("compression", "zstd").option("path", self.paths[name]).bucketBy(n, "block").saveAsTable(self.names[name])
        return self.spark.table(self.names[name])

    def drop(self, *names):
        for name in names:
            if name in self.names:
                self.spark.sql(f"DROP TABLE {self.names.pop(name)}")
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def frequent_phrases(docs, least=30, longest=4, block_size=BLOCK, part_size=PART):
    """``docs`` (lang, text) to two written tables: (lang, n) of all words, and (lang, phrase, k, a) of the phrases of up to ``longest`` words
    that occur ``least`` times or more."""
    spark = docs.sparkSession
    tables = _Tables(spark)
    rows = tables.by_block(_occurrences(docs, block_size), "r0")
    counted = tables.cut(rows.filter("level IS NULL").groupBy("lang", "word").agg(F.sum("n").alias("a")), "words")
    totals = tables.cut(counted.groupBy("lang").agg(F.sum("a").alias("n")), "totals")
    parts = max(1, -(-(totals.agg(F.sum("n")).first()[0] or 0) // part_size))
    named = counted.filter(F.col("a") >= least).select("lang", F.col("word").alias("phrase"), F.lit(1).alias("k"), "a", F.monotonically_increasing_id().alias("number"))
    words = named = tables.cut(named, "c1")
    own = rows.filter("level IS NULL").select("block", "item", "lang", "word").join(named.select("lang", F.col("phrase").alias("word"), "number"), ["lang", "word"])
    own = own.select(F.col("block").alias("of"), "item", "number")
    relation = rows.filter("level = 0").select("block", "address", "items", "numbers")
    levels, first = [named.select("lang", "phrase", "k", "a")], None
    for k in range(1, longest):
        step = relation.groupBy("block").cogroup(own.groupBy("of")).applyInPandas(_level(k, parts, k + 1 == longest), GROUPS)
        rows = tables.by_block(step, f"r{k}")
        if k == 1:
            tables.drop("r0", "words")
            first = rows.filter("level = 1").select("block", "address", "items", "numbers")
            relation = first
        else:
            here = rows.filter(F.col("level") == k).select("block", *[F.col(c).alias(c + "_before") for c in ("address", "items", "numbers")])
            relation = first.join(here, "block")
        counts = rows.filter("part IS NOT NULL").select("block", "part", "items", "heads", "tails", "counts").groupBy("part").applyInPandas(_count(least), COUNTED)
        counts = tables.cut(counts, f"f{k + 1}")
        own = counts.filter("block IS NOT NULL").select(F.col("block").alias("of"), "items", "numbers")
        head = named.select(F.col("number").alias("head"), "lang", F.col("phrase").alias("start"))
        tail = words.select(F.col("number").alias("tail"), F.col("phrase").alias("word"))
        found = counts.filter("block IS NULL").select("head", "tail", "number", "a").join(head, "head").join(tail, "tail")
        named = tables.cut(found.select("lang", F.concat_ws(" ", "start", "word").alias("phrase"), F.lit(k + 1).alias("k"), "a", "number"), f"c{k + 1}")
        levels.append(named.select("lang", "phrase", "k", "a"))
        if k > 1:
            tables.drop(f"f{k}")
    tables.drop(*[n for n in tables.paths if n[0] in "rf"])
    found = levels[0]
    for x in levels[1:]:
        found = found.unionByName(x)
    return totals, found


def cut_score():
    """floor(2000000 a / (l + r)) of columns a, l, r, exact where products pass 64 bits."""
    wide = lambda c: f"CAST({c} AS decimal(20,0))"
    return F.expr(f"CAST((CAST(2000000 AS decimal(7,0)) * {wide('a')}) div ({wide('l')} + {wide('r')}) AS bigint)")


def collocations(docs, least=30, longest=4, top=2000, cover=80, block_size=BLOCK):
    """The ``top`` phrases of each language by how closely their parts hold together: lang, rank, phrase, a, l, r, n, score.

    A phrase occurs a times, the two parts of a cut l and r times, and the cut scores floor(2000000 a / (l + r)); the lowest cut counts. Phrases
    that lie in a longer frequent one with at least ``cover`` percent of their own count are left out. It is enough to look one word further: a
    longer phrase is no more frequent than what lies between.
    """
    totals, found = frequent_phrases(docs, least, longest, block_size)
    words = F.split("phrase", " ")
    part = lambda a, n: F.array_join(F.slice("_words", a, n), " ")
    longer = found.filter("k > 2").withColumn("_words", words)
    inside = longer.select("lang", F.explode(F.array(part(F.lit(1), F.col("k") - 1), part(F.lit(2), F.col("k") - 1))).alias("phrase"), F.col("a").alias("above"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("above").alias("above"))
    cuts = found.filter("k > 1").withColumn("_words", words).withColumn("at", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.select("lang", "phrase", "k", "a", "at", part(F.lit(1), F.col("at")).alias("first"), part(F.col("at") + 1, F.col("k") - F.col("at")).alias("rest"))
    cuts = cuts.join(found.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l")), ["lang", "first"])
    cuts = cuts.join(found.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r")), ["lang", "rest"])
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    best = cuts.withColumn("score", cut_score()).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "at", "l", "r")).alias("cut"))
    kept = best.join(inside, ["lang", "phrase"], "left").filter(F.col("above").isNull() | (wide("above") * 100 < wide("a") * cover))
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return kept.withColumn("rank", place.cast("long")).filter(F.col("rank") <= top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
