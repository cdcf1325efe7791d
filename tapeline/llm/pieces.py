"""Documents as pieces of token ids: one document's ids and an end id, cut only where longer than a sequence."""

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from .tokens import tokenizer

SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_points(n, cap):
    """Starts and lengths of the pieces of n ids."""
    starts = np.arange(0, max(n, 1), cap)
    return starts, np.minimum(cap, n - starts)


def token_pieces(docs, path, cap, end_id=0, with_ids=False):
    """Rows of SCHEMA (and ``ids``, little-endian unsigned 32-bit, where wanted) of every document. A null text counts as empty; with an end
    id it is one piece, without one a piece of length 0. Only doc_id and text are read."""

    def rows(batches):
        tok = tokenizer(path, end_id)
        for b in batches:
            ids, offsets = tok.encode(b["text"])
            out = []
            for doc, lo, hi in zip(b["doc_id"], offsets[:-1].tolist(), offsets[1:].tolist()):
                for k, (s, n) in enumerate(zip(*cut_points(hi - lo, cap))):
                    raw = ids[lo + s : lo + s + n].astype("<u4").tobytes()
                    out.append((doc, k, s, n, zlib.crc32(raw)) + ((raw,) if with_ids else ()))
            t = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)
            t["doc_id"] = t["doc_id"].astype("Int64")
            yield t

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInPandas(rows, SCHEMA + (", ids binary" if with_ids else ""))
