"""Collocations against counting every phrase in memory."""

import collections
import random
import re

import numpy as np
import pytest

from tapeline.llm import setm

ODD = "doc_id long, text string, lang string, a int, l string, number long, block int"


def plain(rows, least, longest, top):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    cand = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    inside = {}
    for (lang, w), a in cand.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                s = (lang, w[i : i + k])
                inside[s] = max(inside.get(s, 0), a)
    best = collections.defaultdict(list)
    for (lang, w), a in cand.items():
        if 100 * inside.get((lang, w), 0) >= 80 * a:
            continue
        score, k = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
        best[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i, p.decode(), -a, x, y, n[lang], -s) for lang, v in best.items() for i, (s, a, p, x, y) in enumerate(sorted(v)[:top], 1))


def rows_of(n, seed=2):
    rnd = random.Random(seed)
    words = ["New", "york", "city", "the", "of", "é", "x\xa0y", "\x00", "\x1c", "a-b", "日本", "<s>", "\xff"]
    text = lambda: "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", " ! "]) for _ in range(rnd.randrange(40)))
    out = [(rnd.choice([None, "", " ", "...", text(), text(), text(), "new york city hall " * rnd.randrange(4)]), rnd.choice([None, "und", "en", "de", ""])) for _ in range(n)]
    return out + out[: n // 5] + [("stop. stop. " * 50 + "go go go go go go", "en"), ("y " * 3000, "long")]


@pytest.mark.parametrize("block,part", [(40, 7), (10_000_000, 4_000_000)])
def test_collocations_equal_counting(spark, block, part, monkeypatch):
    monkeypatch.setattr(setm, "SLICE", 64)
    rows = rows_of(150)
    df = spark.createDataFrame([(i, t, g, 1, "x", 2, 3) for i, (t, g) in enumerate(rows)], ODD).repartition(3)
    monkeypatch.setattr(setm.frequent_phrases, "__defaults__", (30, 4, block, part))
    for least, longest, top in ((2, 4, 2000), (5, 3, 4)):
        got = setm.collocations(df, least, longest, top, block_size=block)
        cols = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(tuple(r) for r in got.select(*cols).collect()) == plain(rows, least, longest, top)


def test_nothing_frequent_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a b c", "en", 1, "x", 2, 3), (2, None, None, 1, "x", 2, 3)], ODD)
    assert setm.collocations(df, least=2).count() == 0
    assert setm.collocations(df.filter("doc_id > 5"), least=2).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    rows = [(9 * 10**18, 9 * 10**18 + 7, 9 * 10**18 + 11), (10**18 + 1, 10**18 + 3, 9 * 10**18), (30, 30, 30), (31, 44, 10**9)]
    got = spark.createDataFrame(rows, "a long, l long, r long").select("a", "l", "r", setm.cut_score().alias("s")).collect()
    assert all(x.s == 2_000_000 * x.a // (x.l + x.r) for x in got) and len(got) == 4


def test_packed_integers():
    rng = np.random.default_rng(0)
    for x in (np.zeros(0, np.int32), rng.integers(-(2**31), 2**31, 1000).astype(np.int32), rng.integers(-(2**62), 2**62, 1000), np.arange(5)):
        assert (setm.unpack(setm.pack(x)) == x).all()


def test_merge_join_meets_adjacent_places():
    r2, r1 = np.array([3, 5, 9, 20]), np.array([3, 4, 5, 6, 7, 9, 10, 22])
    left, right = setm.merge_join(r2, 2, r1)
    assert [(r2[i], r1[j]) for i, j in zip(left, right)] == [(3, 5), (5, 7), (20, 22)]
