"""Personal data in whole texts: exact patterns, and a linear-chain conditional random field that adds what they don't match.

The field labels the words around digits and @ signs (no kind is without either) by shape: collapsed character classes, digit counts, lengths,
a few cue words, and the same of the neighbours. It is trained on a small labelled table of sentences made by rule, with Adam on the exact
log-likelihood, and decoded by Viterbi over batches of chains. Pattern spans stay as they are; a span of the field that touches one is left out.

Time grows with the length of a text, long digit runs and many addresses included.

Defined results: a null or empty text has no spans (counts 0, the digest of an empty string); equal rows get equal results; an empty table
gives an empty result. Other columns are kept; those named like added ones are replaced.
"""

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

KINDS = ["email", "ip", "card", "phone", "secret"]
LABELS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
#: Hash slots of word features; characters of context taken on each side of a digit or @.
SLOTS, CONTEXT = 4096, 40

# The exact patterns. A digit run is entered at its start only: what fails there fails inside it too.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_CUE = re.compile(r"[0-9@]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_STRIP = ".,;:!?\"'<>[]{}"
_CUES = frozenset("phone tel call fax mobile email mail contact ip host server card visa password passwd pwd token key secret api = :".split())


def _digits(s):
    return [int(c) for c in s if "0" <= c <= "9"]


def luhn(digits):
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(odd) + sum(2 * d - 9 * (d > 4) for d in even)) % 10 == 0


def pattern_spans(text):
    """(kind, start, end) of the exact patterns, by kind and start, in code points."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        i = at
        while i > done and text[i - 1] in _LOCAL:
            i -= 1
        m = _DOMAIN.match(text, at + 1) if i < at else None
        if m:
            out.append(("email", i, m.end()))
            done = m.end()
        at = text.find("@", done if m else at + 1)
    if _CUE.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m.group())) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return out


def _shape(word):
    out, last = [], ""
    for c in word[:40]:
        s = "d" if "0" <= c <= "9" else "x" if c.islower() else "X" if c.isupper() else c if c.isascii() else "o"
        if s != last:
            out.append(s)
        last = s
    return "".join(out)


def _slot(name, value):
    return int.from_bytes(hashlib.blake2b(f"{name}:{value}".encode(), digest_size=4).digest(), "little") % SLOTS


_OWN = {}


def _own(word):
    """Slots of a word's own features."""
    got = _OWN.get(word)
    if got is None:
        if len(_OWN) > 100_000:
            _OWN.clear()
        core = word.strip(_STRIP)
        n = sum("0" <= c <= "9" for c in word)
        hexa = n > 2 and len(core) > 11 and bool(re.search(r"[0-9a-f]{12,}$", core))
        low = core.lower()
        cue = low if low in _CUES else word if word in _CUES else "cue=" if re.match(r"(password|passwd|pwd|token|secret|api_?key|key)[=:]", low) else ""
        shape = _shape(core) if n or "@" in word else "plain" if core.isalpha() else "mark"
        values = (shape, min(n, 20), min(len(core), 24) // 3, hexa, cue, core.count("."), core.count("-"))
        _OWN[word] = got = [_slot(k, v) for k, v in enumerate(values)]
    return got


#: Own features, and the neighbours' shape, digit count, hex run and cue.
_NEAR = [(-2, 0), (-2, 4), (-1, 0), (-1, 1), (-1, 4), (1, 0), (1, 1), (2, 0)]


def slots(words):
    """(words, features) slots of one chain."""
    own = np.array([_own(w) for w in words], np.int64)
    cols = [own]
    for shift, k in _NEAR:
        col = np.full(len(words), 7, np.int64)
        src = own[max(0, shift) : len(words) + min(0, shift), k]
        col[max(0, -shift) : len(words) - max(0, shift)] = (src * 31 + 17 * (shift + 3) + k) % SLOTS
        cols.append(col[:, None])
    return np.concatenate(cols, 1)


class Field:
    """``emit`` (slot, label), ``trans`` (label before, label), ``begin`` (label)."""

    def __init__(self):
        n = len(LABELS)
        self.emit, self.trans, self.begin = np.zeros((SLOTS, n)), np.zeros((n, n)), np.zeros(n)
        # an inside label follows its own kind only
        self.ban = np.array([[-1e4 if b[0] == "I" and a[2:] != b[2:] else 0.0 for b in LABELS] for a in LABELS])
        self.ban0 = np.array([-1e4 if b[0] == "I" else 0.0 for b in LABELS])

    def scores(self, x):
        return self.emit[x].sum(-2)

    def viterbi(self, emissions, lengths):
        """Best labels of padded chains (chains, steps, labels)."""
        n, steps, k = emissions.shape
        trans = self.trans + self.ban
        best = self.begin + self.ban0 + emissions[:, 0]
        back = np.zeros((n, steps, k), np.int8)
        for t in range(1, steps):
            over = best[:, :, None] + trans
            back[:, t] = over.argmax(1)
            best = np.where((t < lengths)[:, None], over.max(1) + emissions[:, t], best)
        out = np.zeros((n, steps), np.int8)
        label = best.argmax(1).astype(np.int8)
        for t in range(steps - 1, -1, -1):
            inside = t < lengths
            out[inside, t] = label[inside]
            if t:
                label = np.where(inside, back[np.arange(n), t, label], label)
        return out

    def decode(self, chains, cells=200_000):
        """Labels of each chain of words; chains of like length are padded together."""
        out = [None] * len(chains)
        order = sorted(range(len(chains)), key=lambda i: len(chains[i]))
        k = 0
        while k < len(order):
            m = k + 1
            while m < len(order) and len(chains[order[m]]) * (m + 1 - k) <= cells:
                m += 1
            part = order[k:m]
            lengths = np.array([len(chains[i]) for i in part])
            e = np.zeros((len(part), lengths.max(), len(LABELS)))
            for row, i in enumerate(part):
                e[row, : lengths[row]] = self.scores(slots(chains[i]))
            got = self.viterbi(e, lengths)
            for row, i in enumerate(part):
                out[i] = got[row, : lengths[row]]
            k = m
        return out


def _gradient(f, x, y, mask):
    """Gradient of the mean log-likelihood of padded chains, by forward and backward sums."""
    n, steps, _ = x.shape
    e = f.scores(x)
    trans = f.trans + f.ban
    lse = lambda v, ax: np.log(np.exp(v - v.max(ax, keepdims=True)).sum(ax)) + v.max(ax)
    alpha, beta = np.zeros_like(e), np.zeros_like(e)
    alpha[:, 0] = f.begin + f.ban0 + e[:, 0]
    for t in range(1, steps):
        new = lse(alpha[:, t - 1, :, None] + trans, 1) + e[:, t]
        alpha[:, t] = np.where(mask[:, t, None], new, alpha[:, t - 1])
    for t in range(steps - 2, -1, -1):
        new = lse(trans + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        beta[:, t] = np.where(mask[:, t + 1, None], new, 0)
    z = lse(alpha[:, -1], 1)
    node = np.exp(alpha + beta - z[:, None, None]) * mask[:, :, None]
    hot = np.eye(len(LABELS))[y] * mask[:, :, None]
    diff = hot - node
    at, part = x[mask].ravel(), np.repeat(diff[mask], x.shape[2], 0)
    g_emit = np.stack([np.bincount(at, part[:, k], SLOTS) for k in range(len(LABELS))], 1)
    edge = np.exp(alpha[:, :-1, :, None] + trans + (e + beta)[:, 1:, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
    seen = np.einsum("nta,ntb->ab", hot[:, :-1] * mask[:, 1:, None], hot[:, 1:])
    return g_emit / n, (seen - edge.sum((0, 1))) / n, diff[:, 0].sum(0) / n


def train(sentences, steps=40, rate=0.2, decay=1e-3):
    """``sentences``: lists of (word, label)."""
    f = Field()
    width = max(map(len, sentences))
    x = np.full((len(sentences), width, 7 + len(_NEAR)), 7, np.int64)
    y = np.zeros((len(sentences), width), np.int64)
    mask = np.zeros((len(sentences), width), bool)
    for i, s in enumerate(sentences):
        x[i, : len(s)] = slots([w for w, _ in s])
        y[i, : len(s)] = [LABELS.index(label) for _, label in s]
        mask[i, : len(s)] = True
    state = [np.zeros_like(p) for p in (f.emit, f.trans, f.begin) for _ in "mv"]
    for k in range(1, steps + 1):
        for j, (p, g) in enumerate(zip((f.emit, f.trans, f.begin), _gradient(f, x, y, mask))):
            g = g - decay * p
            m, v = state[2 * j], state[2 * j + 1]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return f


def labelled_table(n=320, seed=3):
    """Small labelled table by rule: made-up words around values of each kind in several spellings, and numbers that are none of them."""
    r = np.random.default_rng(seed)
    pick = lambda *a: a[r.integers(len(a))]
    num = lambda k: "".join(str(d) for d in r.integers(0, 10, k))
    low = lambda k: "".join(chr(97 + c) for c in r.integers(0, 26, k))
    hexa = lambda k: "".join("0123456789abcdef"[c] for c in r.integers(0, 16, k))

    def filler():
        w = low(r.integers(1, 11))
        w = w.capitalize() if r.random() < 0.15 else w
        return w + pick("", "", "", "", ".", ",")

    def value():
        kind = pick("email", "ip", "card", "phone", "phone", "secret", "none", "none")
        if kind == "email":
            return kind, [], pick(f"{low(5)}.{num(2)}@{low(5)}{num(1)}.{low(6)}.com", f"{low(6)}@{low(5)}.org", f"{low(4)}_{low(3)}+{num(1)}@{low(4)}.co")
        if kind == "ip":
            return kind, [], ".".join(str(x) for x in r.integers(1, 256, 4)) + pick("", "", ":" + num(4))
        if kind == "card":
            d = num(16)
            return kind, [], pick(d, f"{d[:4]} {d[4:8]} {d[8:12]} {d[12:]}", f"{d[:4]}-{d[4:8]}-{d[8:12]}-{d[12:]}")
        if kind == "phone":
            a, b, c = num(3), num(3), num(4)
            return kind, pick([], ["phone"], ["call"], ["tel"]), pick(f"+{num(1)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{num(2)} {a} {b} {c}", f"{a}.{b}.{c}")
        if kind == "secret":
            return kind, pick(["token", "="], ["password", "="], ["key", ":"], []), pick('"' + hexa(40) + '"', hexa(32))
        if r.random() < 0.3:
            return None, [], "password=" + hexa(18)
        return None, pick([], ["page"], ["in"], ["version"]), pick(num(1), num(2), num(3), "20" + num(2), f"{num(1)}.{num(1)}", f"{num(2)},{num(3)}", f"{num(4)}-{num(2)}-{num(2)}", low(2) + num(2), num(6), f"{num(2)}:{num(2)}", num(1) + "%")

    out = []
    for _ in range(n):
        s = []
        for _ in range(r.integers(1, 3)):
            kind, before, v = value()
            s += [(filler(), "O") for _ in range(r.integers(1, 5))] + [(w, "O") for w in before]
            if kind == "secret" and not before:
                v = pick("password=", "token=", "secret=") + v.strip('"')
            if v.startswith("password="):
                kind = "secret"
            ws = v.split()
            ws[-1] += pick("", "", "", ".", ",")
            s += [(w, "O" if kind is None else f"{'B' if k == 0 else 'I'}-{kind}") for k, w in enumerate(ws)]
        out.append(s + [(filler(), "O") for _ in range(r.integers(1, 4))])
    return out


def zones(text):
    """Chains of (word, start) around digits and @ signs."""
    out, end, m = [], -1, _CUE.search(text)
    while m:
        lo = m.start()
        hi = lo
        while (m := _CUE.search(text, hi + 1)) and m.start() - hi <= 2 * CONTEXT:
            hi = m.start()
        lo, hi = max(end + 1, lo - CONTEXT), min(len(text), hi + CONTEXT)
        while lo > end + 1 and lo > 0 and not text[lo - 1].isspace():
            lo -= 1
        while hi < len(text) and not text[hi].isspace():
            hi += 1
        out.append([(w.group(), w.start()) for w in _WORD.finditer(text, lo, hi)])
        end = hi
        m = _CUE.search(text, hi)
    return [z for z in out if z]


def _plausible(kind, value):
    digits = _digits(value)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "ip":
        return all(int(p) < 256 for p in re.findall(r"[0-9]{1,9}", value)[:4])
    return 7 <= len(digits) <= 15 if kind == "phone" else "@" in value if kind == "email" else bool(digits)


def _runs(zone, labels, text):
    """Plausible spans of labelled runs, without marks at the ends; of name=value the value. Where a run as a whole is none, its words are tried."""
    out, k = [], 0
    while k < len(zone):
        label = LABELS[labels[k]]
        m = k + 1
        if label[0] == "B":
            while m < len(zone) and LABELS[labels[m]] == "I" + label[1:]:
                m += 1
            for part in [zone[k:m]] + [[w] for w in zone[k:m]] * (m - k > 1):
                start, end = part[0][1], part[-1][1] + len(part[-1][0].rstrip(_STRIP))
                if label == "B-secret" and "=" in part[0][0]:
                    start += part[0][0].rfind("=", 0, len(part[0][0].rstrip("="))) + 1
                while start < end and text[start] in _STRIP:
                    start += 1
                if start < end and _plausible(label[2:], text[start:end]):
                    out.append((label[2:], start, end))
                    if part == zone[k:m]:
                        break
        k = m
    return out


def all_spans(texts, field):
    """Per text: its pattern spans and all spans, by kind and start."""
    base = [pattern_spans(t) for t in texts]
    chains = [(i, z) for i, t in enumerate(texts) for z in zones(t)]
    more = [[] for _ in texts]
    starts = [sorted(a for _, a, _ in b) for b in base]
    reach = [list(accumulate((e for _, _, e in sorted(b, key=lambda x: x[1])), max)) for b in base]
    for (i, z), labels in zip(chains, field.decode([[w for w, _ in z] for _, z in chains])):
        for kind, s, e in _runs(z, labels, texts[i]):
            before = bisect_left(starts[i], e)  # pattern spans that begin before this one ends
            if not before or reach[i][before - 1] <= s:
                more[i].append((kind, s, e))
    key = lambda x: (KINDS.index(x[0]), x[1])
    return base, [sorted(b + m, key=key) for b, m in zip(base, more)]


def said(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redacted(text, spans):
    """``text`` with each span replaced by its kind in brackets."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
            at = e
    return "".join(out) + text[at:] if out else text


def with_spans(docs, field, clean=False):
    """``docs`` with ``pii``: counts of the patterns, the digest of their spans, all spans, and the text without them if ``clean``."""

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string" + (", text string" if clean else ""))
    def find(texts: pd.Series) -> pd.DataFrame:
        own = [t or "" for t in texts]
        rows = []
        for t, b, spans in zip(own, *all_spans(own, field)):
            kinds = [k for k, _, _ in b]
            row = [*(kinds.count(k) for k in KINDS[:4]), hashlib.sha256(said(b).encode()).hexdigest(), said(spans)]
            rows.append(row + [redacted(t, spans)] * clean)
        return pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"] + ["text"] * clean)

    return docs.withColumn("pii", find(F.col("text").cast("string")))
