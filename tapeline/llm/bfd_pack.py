"""Token ids packed into fixed-length sequences, best fit decreasing, written as binary matrices.

A task reads documents, turns them into pieces (cut only where longer than a sequence) and packs WINDOW pieces at a time, longest first, each
into the open sequence with the least room that holds it. The rooms are leaves of a segment tree that counts open sequences, so a search
takes a logarithm of the capacity. Ids don't move between tasks: a row of the output is one sequence.

A row: sequence_id; doc_ids, pieces, starts (of the piece in its document's ids) in order of place; cu_seqlens (0 and the end of each piece);
ids: the sequence's little-endian unsigned 32-bit ids, padded to the capacity with the pad id; positions: little-endian unsigned 16- or
32-bit places that start from 0 in each piece, and in the padding. Rows stacked are the id matrix.

Defined results: a null or empty text is its end id alone, or a piece of no ids without one; repeated rows and null ids are packed each; an
empty table gives no sequences. Only doc_id and text are read. sequence_id depends on how rows are dealt over tasks, not on reruns.
"""

import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import functions as F

from ..session import run_dir
from .pieces import cut_points
from .tokens import tokenizer

#: Pieces packed together, and sequences in one batch of output.
WINDOW, OUT_ROWS = 4096, 64
SCHEMA = "sequence_id long, doc_ids array<long>, pieces array<int>, starts array<long>, cu_seqlens array<int>, ids binary, positions binary"


class Rooms:
    """Segment tree over rooms 0 to cap that counts the open sequences with each."""

    def __init__(self, cap):
        self.size = 1 << cap.bit_length()
        self.count = [0] * (2 * self.size)
        self.held = [[] for _ in range(cap + 1)]

    def _add(self, room, by):
        k = room + self.size
        while k:
            self.count[k] += by
            k >>= 1

    def push(self, room, name):
        self.held[room].append(name)
        self._add(room, 1)

    def pop_least(self, length):
        """(room, name) of the open sequence with the least room of at least ``length``; None if there is none."""
        k, count = length + self.size, self.count
        while not count[k]:
            while k & 1:  # a right child: nothing further right under its parent
                k >>= 1
            if k == 0:
                return None
            k += 1
        while k < self.size:
            k = 2 * k if count[2 * k] else 2 * k + 1
        room = k - self.size
        self._add(room, -1)
        return room, self.held[room].pop()


def best_fit_decreasing(lengths, cap):
    """Sequence of each length; lengths in 0 .. cap."""
    rooms, out, n = Rooms(cap), [0] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        got = rooms.pop_least(lengths[i])
        if got is None:
            got, n = (cap, n), n + 1
        out[i] = got[1]
        rooms.push(got[0] - lengths[i], got[1])
    return out


def packed(docs, path, cap, end_id=0, pad_id=0, window=WINDOW):
    """Rows of SCHEMA for documents (doc_id, text)."""
    place = "<u2" if cap <= 65536 else "<u4"

    def laid_out(held, first):
        if not held:
            return
        of = np.array(best_fit_decreasing([len(x[3]) for x in held], cap))
        order = np.argsort(of, kind="stable")
        ends = np.flatnonzero(np.diff(of[order], append=-1)) + 1
        rows, lo = [], 0
        for hi in ends.tolist():
            own = [held[i] for i in order[lo:hi]]
            lens = [len(x[3]) for x in own]
            ids, at = np.full(cap, pad_id, "<u4"), np.zeros(cap, place)
            cu = np.concatenate([[0], np.cumsum(lens)])
            for x, s, n in zip(own, cu.tolist(), lens):
                ids[s : s + n] = x[3]
                at[s : s + n] = np.arange(n)
            at[cu[-1] :] = np.arange(cap - cu[-1])
            rows.append((first + int(of[order[lo]]), [x[0] for x in own], [x[1] for x in own], [x[2] for x in own], cu.tolist(), ids.tobytes(), at.tobytes()))
            lo = hi
            if len(rows) == OUT_ROWS:
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    def rows(batches):
        tok = tokenizer(path, end_id)
        first, held = TaskContext.get().partitionId() << 40, []
        for b in batches:
            ids, offsets = tok.encode(b["text"])
            docs_of = [None if pd.isna(x) else int(x) for x in b["doc_id"]]
            for doc, lo, hi in zip(docs_of, offsets[:-1].tolist(), offsets[1:].tolist()):
                held += [(doc, k, int(s), ids[lo + s : lo + s + n]) for k, (s, n) in enumerate(zip(*cut_points(hi - lo, cap)))]
            while len(held) >= window:
                yield from laid_out(held[:window], first)
                held, first = held[window:], first + window
        yield from laid_out(held, first)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInPandas(rows, SCHEMA)


def write(docs, path, cap, to, **how):
    """The packed sequences as Parquet files in folder ``to``."""
    packed(docs, path, cap, **how).write.option("compression", "zstd").parquet(to)
    return docs.sparkSession.read.schema(SCHEMA).parquet(to)


def matrix(sequences, column="ids", kind="<u4"):
    """A few rows on the driver as one numpy matrix."""
    got = [np.frombuffer(r[0], kind) for r in sequences.orderBy("sequence_id").select(column).collect()]
    return np.stack(got) if got else np.zeros((0, 0), kind)


def described(sequences):
    """Per piece of packed sequences: doc_id, piece, start, length, crc32 of its ids, sequence_id, offset, first and last position; and of the
    sequence n_pieces and crc32 of the whole padded row."""

    def rows(batches):
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                width = len(r.positions) // (len(r.ids) // 4)
                ids, at, row = np.frombuffer(r.ids, "<u4"), np.frombuffer(r.positions, f"<u{width}"), zlib.crc32(r.ids)
                for d, p, s, lo, hi in zip(r.doc_ids, r.pieces, r.starts, r.cu_seqlens[:-1], r.cu_seqlens[1:]):
                    ends = (int(at[lo]), int(at[hi - 1])) if hi > lo else (0, 0)
                    out.append((None if d is None or pd.isna(d) else int(d), p, s, hi - lo, zlib.crc32(ids[lo:hi].tobytes()), r.sequence_id, lo, *ends, len(r.pieces), row))
            t = pd.DataFrame(out, columns="doc_id piece start length ids_crc32 sequence_id offset first_position last_position n_pieces row_crc32".split())
            t["doc_id"] = t["doc_id"].astype("Int64")
            yield t

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, first_position long, last_position long, n_pieces int, row_crc32 long"
    return sequences.mapInPandas(rows, schema)


def packed_files(docs, path, cap, **how):
    """Sequences written below the shared folder, and what the files hold."""
    return described(write(docs, path, cap, run_dir(docs.sparkSession, "packed-ids"), **how))
