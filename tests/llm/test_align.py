"""Cross-tokenizer alignment against whole-text encoding and plain set intersection."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from tapeline.llm import align as A

PATHS = [public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
BITS = ["a", "Hello", "wörld", " ", "  ", "\n", "\n\n", "\t", "<|endoftext|>", "<s>", "</s>", "▁", "😀", "日本", "'s", "don't", "123", "\x1c", "\xa0", "\x00", "\r",
        "...", "é", "́", "<0x0A>", "x" * 30, " the", " of", " ", "﻿", "​"]


@pytest.fixture(scope="module")
def tok():
    return A.Tokenizers(*PATHS)


def plain(tok, text):
    """Tokens of the whole text, common ends by sets."""
    none = (0, 0, 0, "", [])
    if not text:
        return none
    raw = (" " + text).encode()
    a, b = tok.a.encode(" " + text, add_special_tokens=False).ids, tok.b.encode(text)
    parts = [tok.bytes_a[i] for i in a], [tok.bytes_b[i] for i in b]
    if any(b"".join(x) != raw for x in parts):
        return none
    ends = [np.cumsum([len(p) for p in x]).tolist() for x in parts]
    groups, links, i, j = [], [], 0, 0
    for e in sorted(set(ends[0]) & set(ends[1])):
        i2, j2 = ends[0].index(e) + 1, ends[1].index(e) + 1
        groups.append(",".join(map(str, a[i:i2])) + "|" + ",".join(map(str, b[j:j2])))
        links.append((a[i2 - 1] << 32) | b[j2 - 1])
        i, j = i2, j2
    return len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest(), links


def odd_texts(n, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(BITS) for _ in range(rnd.randrange(1, 25))) for _ in range(n)] + [None, "", " ", "\n", "the end"] + ["the cat of the house"] * 5


@pytest.mark.parametrize("cache", [A.CACHE, 50])
def test_texts_by_chunks_equal_whole_texts(monkeypatch, cache):
    tok = A.Tokenizers(*PATHS, cache=cache)
    monkeypatch.setattr(A, "WINDOW", 97)
    monkeypatch.setattr(A, "JOINED", 7)
    texts = odd_texts(1500)
    for text, got in zip(texts, A.align_texts(tok, texts)):
        want = plain(tok, text)
        assert (*got[:4], got[4].tolist()) == want, text


def test_long_text_in_slices(tok, monkeypatch):
    text = " ".join(x for x in odd_texts(3000, 2) if x and "▁" not in x)
    want = plain(tok, text)
    assert want[0] > 10_000
    monkeypatch.setattr(A, "SLICE", 1000)
    monkeypatch.setattr(A, "WINDOW", 500)
    assert len(list(tok.parts(text))) > 20
    (got,) = A.align_texts(tok, [text])
    assert (*got[:4], got[4].tolist()) == want


def test_gallop_and_common():
    rng = np.random.default_rng(3)
    for n, m in [(0, 5), (1, 1), (5, 4000), (4000, 5), (3000, 3500)]:
        a, b = (np.sort(rng.choice(10_000, k, replace=False)) for k in (n, m))
        if m:
            at = A.gallop(b, a, np.zeros(n, np.int64))
            assert at.tolist() == np.searchsorted(b, a).tolist()
        i, j = A.common(a, b)
        assert a[i].tolist() == b[j].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def test_counts_over_the_corpus(spark, tok):
    texts = odd_texts(120)
    rows = [(i if i % 7 else None, t, 5, 1) for i, t in enumerate(texts)] + [(3, "the cat", 5, 1), (3, "the cat", 5, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, block int, pair int").repartition(5)
    figures = [plain(tok, r[1]) for r in rows]
    total = collections.Counter(x for f in figures for x in f[4])
    most = collections.defaultdict(int)
    for x, n in total.items():
        most[x & 0xFFFFFFFF] = max(most[x & 0xFFFFFFFF], n)
    want = collections.Counter(
        (r[0], f[0], f[1], f[2], len(f[4]), sum(total[x] == most[x & 0xFFFFFFFF] for x in f[4]), sum(total[x] for x in f[4]), f[3]) for r, f in zip(rows, figures))
    cols = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    for block in (20, A.BLOCK):
        got = A.align(df, *PATHS, block=block)
        assert collections.Counter(tuple(r) for r in got.select(*cols).collect()) == want


def test_empty_table(spark):
    assert A.align(spark.createDataFrame([], "doc_id long, text string"), *PATHS).count() == 0


def test_pieces_that_reach_over_seams_are_not_cut(tok):
    whole = A.Tokenizers(*PATHS)
    whole.local = False
    texts = odd_texts(60)
    for x, y in zip(A.align_texts(tok, texts), A.align_texts(whole, texts)):
        assert x[:4] == y[:4] and x[4].tolist() == y[4].tolist()
