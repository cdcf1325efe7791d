"""Top-k, gated choice, Pareto sets, set operations and near-duplicate titles."""

import functools
import math

from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import cut, discard, tidy
from . import packed, spread


def top_k(df, k, *order):
    return df.orderBy(*order).limit(k)


def best_by(df, keys, score, tie):
    """Row with the highest score per key (an aggregate, so a hot key is combined before the shuffle)."""
    row = F.struct(*[c for c in df.columns if c not in keys])
    return df.groupBy(*keys).agg(F.max_by(row, F.struct(score, *tie)).alias("_r")).select(*keys, "_r.*")


def gated_best(df, keys, n_col, score_col, min_n, tie):
    """Best score among rows with enough trades; among all rows when none has."""
    return best_by(df, keys, F.struct((F.col(n_col) >= min_n).cast("int").alias("ok"), F.col(score_col).alias("s")), tie)


def top_then_validate(train, valid, keys, score, k):
    """Top k by training score, joined to their validation results."""
    top = train.orderBy(F.desc(score), *keys).limit(k).select(*keys, F.col(score).alias("train_score"))
    return top.join(valid, keys, "left")


def bucket_best(df, rate, value, edges, tie):
    """Best row per rate bucket [edge, next edge)."""
    b = F.lit(None).cast("double")
    for lo in edges[:-1]:
        b = F.when(F.col(rate) >= lo, F.lit(float(lo))).otherwise(b)
    d = df.withColumn("bucket", F.when(F.col(rate) < edges[-1], b)).filter("bucket IS NOT NULL")
    return best_by(d, ["bucket"], F.col(value), tie)


def pareto(df, a, b):
    """Non-dominated rows on two higher-is-better columns; NULL rows are out. Rows collapse to distinct values of
    ``a`` first; the running maximum over higher values is two-level."""
    d = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    m = d.groupBy(a).agg(F.max(b).alias("_m")).withColumn("_all", F.lit(0)).withColumn("_neg", -F.col(a))
    m = spread.even_blocks(m, "_all", "_neg", "_blk")
    r = spread.running(m, "_all", "_blk", "_neg", exclusive=True, _above=("max", "_m")).select(a, "_m", "_above")
    j = d.join(r, a)
    dominated = (F.col("_above") >= F.col(b)) | (F.col("_m") > F.col(b))
    return j.filter(~F.coalesce(dominated, F.lit(False))).drop("_m", "_above")


def distinct_top(df, dup_key, k, order):
    """Best row per duplicate key, then the top k."""
    row = F.struct(*[c for c in df.columns if c != dup_key])
    one = df.groupBy(dup_key).agg(F.max_by(row, F.struct(*order)).alias("_r")).select(dup_key, "_r.*")
    return one.orderBy(*[F.desc(c) for c in order]).limit(k)


def screen(df, train, hold):
    """Candidate flag on training conditions and pass flag on hold-out conditions, given as {column: floor}."""
    ok = lambda conds: F.coalesce(F.expr(" AND ".join(f"{c} >= {v}" for c, v in conds.items())), F.lit(False))
    return df.withColumn("is_candidate", ok(train)).withColumn("holdout_pass", F.col("is_candidate") & ok(hold))


def union_dedup(a, b, keys):
    """Union of two event tables, one row per key (first table wins)."""
    u = a.withColumn("_p", F.lit(0)).unionByName(b.withColumn("_p", F.lit(1)))
    row = F.struct(*[c for c in a.columns if c not in keys])
    return u.groupBy(*keys).agg(F.min_by(row, "_p").alias("_r")).select(*keys, "_r.*")


def only_in(a, b, keys):
    return a.select(*keys).exceptAll(b.select(*keys))


# ---------------------------------------------------------------- near-duplicate titles

#: Earlier titles of a key that a title is compared with at first; each further step takes GROWTH times as many.
GROWTH = 16


def _blocks(titles):
    """Titles (id, day, k) as packed blocks: different words and beginnings of 20, 40, 80, ... characters, all as 64-bit hashes with the day."""
    words = F.transform(F.array_distinct(F.split("k", " ")), lambda t: F.xxhash64(t, "day"))  # tokens hold no blank
    heads = F.expr("CASE WHEN length(k) >= 20 THEN transform(sequence(0, CAST(floor(log2(length(k) / 20)) AS INT)), j -> xxhash64(substring(k, 1, shiftleft(20, j)), day)) ELSE CAST(array() AS ARRAY<BIGINT>) END")
    return cut(titles.select("id", words.alias("words"), heads.alias("heads")).mapInArrow(packed.pack, packed.BLOCKS), "blocks")


def _met(blocks, jac, first):
    """(id, rep, at): of each title the ``first`` titles before it at its keys; and (key, id, n, at, rank): keys that have more (``packed.meet``).

    Two titles that match share so many words that the first one they share, in order of rarity, stands early in both. How rare words are is found
    from the blocks' own counts; each block gets a byte for each of its words back.
    """
    whole = blocks.agg(F.sum("size").alias("size"), F.max("levels").alias("levels")).first()
    bits = max(5, ((whole["size"] or 0) >> 20).bit_length())
    rare = cut(blocks.mapInArrow(packed.seen(bits), packed.SEEN).groupBy("part").applyInArrow(packed.rarity, packed.RARITY), "rarity")
    each = blocks.join(rare.groupBy("g").agg(F.collect_list(F.struct("part", "q")).alias("rarity")), "g")
    kept = cut(each.mapInArrow(packed.prefixes(jac), packed.PREFIXES), "prefixes")
    discard(rare)
    discard(blocks)
    met = cut(kept.mapInArrow(packed.sent(bits + 1, jac, whole["levels"] or 0), packed.ENTRIES).groupBy("part").applyInArrow(packed.meet(jac, first), packed.MET), "keys")
    discard(kept)
    return met.filter("rep IS NOT NULL").select("id", "rep", "at"), met.filter("rep IS NULL").drop("rep")


def _can_match(jac):
    """Of a pair met at a key: lengths fit, and both have enough words from there on."""
    need = F.ceil(jac / (1 + jac) * (F.col("n") + F.col("m")) - 1e-9)
    word = (F.col("n") >= jac * F.col("m") - 1e-9) & (F.col("m") >= jac * F.col("n") - 1e-9) & (F.col("n") - F.col("at") >= need) & (F.col("m") - F.col("rep_at") >= need)
    return (F.col("id") != F.col("rep")) & (F.col("at").isNull() | word)


def _matching(pairs, signed, titles, jac):
    """Pairs (id, rep) whose titles do match, of pairs met (id, rep, at) at a word or, without ``at``, at a beginning.

    Titles are compared whole. Of pairs met at a word only those go there that signatures (``packed.apart``) leave open.
    """
    met = cut(pairs.groupBy("id", "rep").agg(F.max(F.col("at").isNotNull()).alias("word"), F.max(F.col("at").isNull()).alias("head")), "met")
    other = lambda df: df.select(F.col("id").alias("rep"), *[F.col(c).alias(f"{c}_rep") for c in df.columns if c != "id"])
    sized = signed.count()
    part = lambda df, rows: [df.filter(F.pmod(F.xxhash64("id", "rep"), F.lit(k)) == i) for k in [math.ceil(df.count() / max(1, rows)) or 1] for i in range(k)]
    flags = lambda df, same: df.select("id", "rep", F.lit(same).alias("same"), F.lit(not same).alias("alike"))
    pairs = [cut(flags(met.filter("head"), False), "pairs")]  # same: their words may be; alike: one may begin the other
    for some in part(met.filter("word"), 4 * sized):  # what moves at once follows the titles, not the pairs
        near = some.join(signed, "id").join(other(signed), "rep").select("id", "rep", "n", "sig", "n_rep", "sig_rep").mapInArrow(packed.near(jac), "id bigint, rep bigint")
        pairs.append(cut(flags(near, True), "pairs"))
    words = lambda c: F.array_distinct(F.split(c, " "))
    shared = F.size(F.array_intersect(words("k"), words("k_rep")))
    same = shared >= jac * (F.size(words("k")) + F.size(words("k_rep")) - shared)
    begun = (F.length("k") >= 20) & (F.length("k_rep") >= 20) & (F.col("k").startswith(F.col("k_rep")) | F.col("k_rep").startswith(F.col("k")))
    out = []
    for some in part(functools.reduce(lambda a, b: a.unionByName(b), pairs), sized):
        ids = cut(some.select("id").unionByName(some.select(F.col("rep").alias("id"))).distinct(), "ids")  # only their titles are moved
        named = titles.join(ids, "id", "left_semi")
        both = some.join(named, "id").join(other(named), "rep").filter("day = day_rep")
        out.append(cut(both.filter(F.when(F.col("same"), same).otherwise(begun)).select("id", "rep"), "edges"))
    return functools.reduce(lambda a, b: a.unionByName(b), out).distinct()


def near_duplicates(items, jac=0.6, growth=GROWTH):
    """Greedy grouping of similar titles per day: in (time, id) order each title joins the earliest representative it
    resembles (word-set Jaccard >= jac, or one a prefix of the other with >= 20 characters), else it starts a group.

    ``items``: (id, day, source, title). Equal titles of a day collapse first (by SHA-256). Titles meet at keys (``packed.entries``) and each is compared with the
    titles before it at its keys, earliest first: ``growth`` of them, then ``growth`` times as many, and so on. A title that matches an undecided
    one waits for it, so a crowd of near copies meets its first member and nothing else; a title that has met all before it and matches no
    representative is one. Who is one is thus the lexicographically first independent set of the matches, found in few rounds without listing them.
    """
    with tidy(items.sparkSession):
        return _grouped(items, jac, growth)


def _grouped(items, jac, growth):
    it = items.withColumn("_t", tx.tokens(tx.strip_outlet(F.col("title")))).select("day", "id", "source", F.array_join("_t", " ").alias("k"))
    it = cut(it, "words")  # tokenised once
    digest = F.unhex(F.sha2("k", 256)).alias("h")
    named = cut(it.select("day", "id", "source", (F.col("k") == "").alias("blank"), digest).filter("blank IS NOT NULL"), "named")
    firsts = cut(named.filter("NOT blank").groupBy("day", "h").agg(F.min("id").alias("id")), "firsts")
    whole = "id IS NOT NULL AND day IS NOT NULL"
    uniq = it.filter("k <> ''").select("day", "id", "k", digest).groupBy("day", "h").agg(F.min("id").alias("id"), F.first("k").alias("k"))
    titles = cut(uniq.filter(whole).select("day", "id", "k"), "titles")
    discard(it)
    blocks = _blocks(titles)
    signed = cut(blocks.mapInArrow(packed.signatures, "id bigint, n bigint, sig binary"), "texts")
    pairs, keys = _met(blocks, jac, growth)
    edges = cut(_matching(pairs, signed, titles, jac), "edges")
    met = keys.select("key", F.col("rank").alias("seen"), F.col("id").alias("rep"), F.col("n").alias("m"), F.col("at").alias("rep_at"))
    since = lambda c: F.floor(growth * (F.pow(F.lit(float(growth)), c) - 1) / (growth - 1)) if growth > 1 else c

    # 0 undecided, 1 representative, 2 duplicate; c: steps made; top: the most titles before it at a key, if more than one step's; wait: it matches an undecided one
    def settled(state):
        status = edges.join(state.select(F.col("id").alias("rep"), F.col("s").alias("rs")), "rep").groupBy("id").agg(
            F.max((F.col("rs") == 1).cast("int")).alias("dup"), F.max((F.col("rs") == 0).cast("int")).alias("open"))
        t = state.join(status, "id", "left").withColumn("wait", F.coalesce(F.col("open") == 1, F.lit(False)))
        new = F.when(F.col("s") != 0, F.col("s")).when(F.col("dup") == 1, 2).when(~F.col("wait") & (since(F.col("c")) >= F.col("top")), 1).otherwise(0)
        return cut(t.select("id", new.alias("s"), "c", "top", "wait"), "state")

    top = keys.groupBy("id").agg(F.max("rank").alias("top"))
    state = settled(signed.select("id").join(top, "id", "left").select("id", F.lit(0).alias("s"), F.lit(1).alias("c"), F.coalesce("top", F.lit(0)).alias("top")))
    while True:
        moves = (F.col("s") == 0) & ~F.col("wait") & (since(F.col("c")) < F.col("top"))
        left = state.agg(F.sum((F.col("s") == 0).cast("int")).alias("left"), F.sum(moves.cast("int")).alias("moves")).first()
        if not left["left"]:
            break
        if left["moves"]:
            go = state.filter(moves).select("id", since(F.col("c")).cast("bigint").alias("lo"), since(F.col("c") + 1).cast("bigint").alias("hi"))
            probe = keys.join(go, "id").withColumn("hi", F.least("hi", "rank")).filter("lo < hi").withColumn("seen", F.explode(F.sequence("lo", F.col("hi") - 1)))
            pairs = probe.join(met, ["key", "seen"]).filter(_can_match(jac)).select("id", "rep", "at")
            pairs = pairs.join(state.filter("s < 2").select(F.col("id").alias("rep")), "rep", "left_semi")
            edges = edges.unionByName(cut(_matching(pairs, signed, titles, jac), "edges"))
        state = settled(state.withColumn("c", F.col("c") + moves.cast("int")))

    # a duplicate goes to its earliest matching representative; one that it has not met yet may stand before the one it has
    reps = state.filter("s = 1").select(F.col("id").alias("rep"))
    best = edges.join(reps, "rep", "left_semi").groupBy("id").agg(F.min("rep").alias("best"))
    late = state.filter("s = 2").select("id", since(F.col("c")).cast("bigint").alias("lo")).join(best, "id")
    more = keys.join(late, "id").join(met.join(reps, "rep", "left_semi"), "key").filter((F.col("seen") >= F.col("lo")) & (F.col("rep") < F.col("best")) & _can_match(jac))
    more = _matching(more.select("id", "rep", "at"), signed, titles, jac)
    to = best.withColumnRenamed("best", "rep").unionByName(more).groupBy("id").agg(F.min("rep").alias("rep"))
    owner = firsts.withColumnRenamed("id", "node").join(to.withColumnRenamed("id", "node"), "node", "left").select("day", "h", F.coalesce("rep", "node").alias("rep"))
    owner = cut(owner, "owner")
    discard(keys)
    discard(signed)
    discard(titles)
    named_g = named.filter("NOT blank").join(owner, ["day", "h"]).select("day", "id", "source", "rep")
    blank = named.filter("blank").select("day", "id", "source", F.col("id").alias("rep"))
    allg = named_g.unionByName(blank)
    dup = F.when(F.col("id") != F.col("rep"), F.col("source"))
    return allg.groupBy("day", "rep").agg((F.count(F.lit(1)) - 1).alias("dup_n"), F.array_join(F.array_sort(F.collect_set(dup)), ",").alias("dup_sources"))
