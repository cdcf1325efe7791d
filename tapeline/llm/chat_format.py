r"""Conversations as one training text each, with a loss mask, and the way back. Spark expressions only.

The rows of a conversation are collected as structs and sorted by turn. Neighbours of one role form a block with one header:

    ### User: first text<part/>second text</turn>
    ### Assistant: answer</turn>

so that a block's parts are still told apart. Inside texts and role names the control strings and the escape sign are replaced by codes of two
characters (``\0`` for the sign itself), which no text can imitate. The mask is a list of spans in code points, one per assistant text, so
headers and marks are never learnt.

Defined results: a null text is empty, a null role is the role of no letters; rows without conversation id are one conversation of null id.
Turns sort with null first; rows of one turn sort by role and text; repeated rows stay. Roles other than the four named ones are written as they
are behind ``=``. Other columns are not read. No rows give no rows. A conversation is one value of the result, so it may hold at most what one
value can (2 GB); all steps are linear in its length but for span positions, which are summed over blocks of 512 pieces and then over blocks.
"""

from pyspark.sql import functions as F

# The template's marks, their codes, and the role names it prints.
HEAD, COLON, PART, END = "### ", ": ", "<part/>", "</turn>\n"
CODES = [("\\", "\\0"), ("###", "\\1"), ("</turn>", "\\2"), ("<part/>", "\\3"), (":", "\\4")]
ROLES = {"system": "System", "user": "User", "assistant": "Assistant", "tool": "Tool"}
#: Pieces in a block of the position sums.
BLOCK = 512


def _let(value, body):
    """Evaluate ``value`` once and use it in ``body`` (a lambda's argument is never computed again, a plain column may be)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def escaped(text, codes=tuple(CODES[:4])):
    for mark, code in codes:
        text = F.replace(text, F.lit(mark), F.lit(code))
    return text


def unescaped(text, codes=tuple(CODES[:4])):
    for mark, code in reversed(codes):
        text = F.replace(text, F.lit(code), F.lit(mark))
    return text


def _shown(role):
    out = F.concat(F.lit("="), escaped(role, CODES))
    for name, shown in ROLES.items():
        out = F.when(role == name, F.lit(shown)).otherwise(out)
    return out


def _read_role(shown):
    out = unescaped(F.substr(shown, F.lit(2)), CODES)
    for name, word in ROLES.items():
        out = F.when(shown == word, F.lit(name)).otherwise(out)
    return out


def _runs(rows):
    """(role, parts) of each stretch of rows of one role."""

    def cut(starts):
        return F.transform(starts, lambda s, k: F.struct(
            F.get(rows, s - 1)["role"].alias("role"),
            F.transform(F.slice(rows, s, F.coalesce(F.get(starts, k + 1), F.size(rows) + 1) - s), lambda r: escaped(r["text"])).alias("parts")))

    return _let(F.filter(F.sequence(F.lit(1), F.size(rows)), lambda i: (i == 1) | (F.get(rows, i - 1)["role"] != F.get(rows, i - 2)["role"])), cut)


def _pieces(runs, learnt):
    """(text, loss) in the order they are written."""
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))

    def block(r):
        head = piece(F.concat(F.lit(HEAD), _shown(r["role"]), F.lit(COLON)), F.lit(False))
        body = F.flatten(F.transform(r["parts"], lambda p, k: F.array(
            piece(F.when(k == 0, F.lit("")).otherwise(F.lit(PART)), F.lit(False)), piece(p, r["role"] == learnt))))
        return F.concat(F.array(head), body, F.array(piece(F.lit(END), F.lit(False))))

    return F.flatten(F.transform(runs, block))


def _spans(pieces):
    none = F.expr("CAST(array() AS array<struct<start:bigint,length:bigint>>)")

    def step(acc, p):
        n = F.length(p["text"]).cast("long")
        span = F.array(F.struct(acc["at"].alias("start"), n.alias("length")))
        return F.struct((acc["at"] + n).alias("at"), F.when(p["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    def placed(blocks):
        sizes = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda n, p: n + F.length(p["text"])))
        starts = F.aggregate(sizes, F.array(F.lit(0).cast("long")), lambda at, n: F.concat(at, F.array(F.element_at(at, -1) + n)))
        return _let(starts, lambda at: F.flatten(F.transform(blocks, lambda b, i: F.aggregate(
            b, F.struct(F.get(at, i).alias("at"), none.alias("spans")), step, lambda acc: acc["spans"]))))

    return _let(F.transform(F.sequence(F.lit(1), F.size(pieces), F.lit(BLOCK)), lambda b: F.slice(pieces, b, BLOCK)), placed)


def formatted(turns, learnt="assistant"):
    """``turns`` (conv_id, turn, role, text) to one row per conversation: conv_id, formatted, loss (array of start, length in code points)."""
    row = F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    whole = turns.select("conv_id", row.alias("row")).groupBy("conv_id").agg(F.collect_list("row").alias("rows"))
    out = _let(F.sort_array("rows"), lambda rows: _let(_pieces(_runs(rows), learnt), lambda pieces: F.struct(
        F.array_join(F.transform(pieces, lambda p: p["text"]), "").alias("formatted"), _spans(pieces).alias("loss"))))
    return whole.select("conv_id", out.alias("_out")).select("conv_id", "_out.formatted", "_out.loss")


def read_back(texts):
    """``formatted``'s rows with ``turns`` (array of role, text, as they were before formatting) and ``loss_text`` (what the mask covers, unescaped)."""

    def turns_of(block):
        head = F.substring_index(block, COLON, 1)
        return _let(head, lambda h: F.transform(
            F.split(F.substr(block, F.length(h) + 1 + len(COLON)), PART),
            lambda p: F.struct(_read_role(F.substr(h, F.lit(1 + len(HEAD)))).alias("role"), unescaped(p).alias("text"))))

    turns = _let(F.split("formatted", END), lambda b: F.flatten(F.transform(F.slice(b, 1, F.size(b) - 1), turns_of)))
    # four bytes a code point: a span is cut out by its place, without counting characters from the start of the text
    learnt = _let(F.encode("formatted", "UTF-32"), lambda wide: F.array_join(F.transform("loss", lambda s: unescaped(F.decode(
        F.substr(wide, (4 * s["start"] + 1).cast("int"), (4 * s["length"]).cast("int")), "UTF-32"))), ""))
    return texts.withColumn("turns", turns).withColumn("loss_text", learnt)
