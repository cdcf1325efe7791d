"""Hash-ordered randomness: the same draw on every partitioning and in any engine that has md5."""

from pyspark.sql import functions as F


def draw_key(seed, *parts):
    """Hex digest of seed:part:part..., used as a random sort key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]))


def draws(df, n, seed, *parts, name="rep"):
    """Rows repeated for ``n`` repetitions, each with ``draw_key(seed, name, *parts)`` as ``_h``.

    Repetitions times rows is what a draw costs, so only two strings are joined there: a repetition's is a literal, a row's is made once.
    """
    heads = F.split(F.lit(",".join(f"{seed}:{i}" for i in range(n))), ",")
    tails = [F.coalesce(F.concat(F.lit(":"), F.col(p).cast("string")), F.lit("")) for p in parts]  # nulls leave nothing, as in concat_ws
    rows = df.withColumn("_tail", F.concat(*tails)).select("*", F.posexplode(heads).alias(name, "_head"))
    return rows.withColumn("_h", F.md5(F.concat("_head", "_tail"))).drop("_head", "_tail")


def draw_int(seed, n, *parts):
    """Uniform integer in [0, n) from the first 12 hex digits of the digest."""
    return F.pmod(F.conv(F.substring(draw_key(seed, *parts), 1, 12), 16, 10).cast("bigint"), n)


def event_id(source, key):
    """First 16 hex digits of sha256('source|key')."""
    return F.substring(F.sha2(F.concat_ws("|", source, key), 256), 1, 16)
