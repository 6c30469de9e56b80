"""Stable hashes, selection ids, the linear congruential stream."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha_text(*parts: Column | str) -> Column:
    """sha256 of the parts joined by ``|``."""
    cols = [F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.sha2(F.concat_ws("|", *cols), 256)


def stable_int(*parts: Column | str) -> Column:
    """The first 8 bytes of the hash as an unsigned number (DECIMAL(20,0))."""
    return F.conv(F.substring(sha_text(*parts), 1, 16), 16, 10).cast("decimal(20,0)")


def selection_id(prefix: str, split: Column, content: Column, rank: Column, digits: int = 12) -> Column:
    """prefix_split_content_rank, the hashes cut to their first digits."""
    return F.concat_ws("_", F.lit(prefix), split, F.substring(content, 1, digits), F.substring(rank, 1, digits))


def lcg(seed: Column, n: int) -> Column:
    """n unit values of x -> 1664525 x + 1013904223 mod 2^32."""
    m = 1 << 32
    state = F.struct(F.pmod(seed.cast("long"), F.lit(m)).alias("x"), F.array().cast("array<double>").alias("out"))

    def step(s: Column, _: Column) -> Column:
        x = F.pmod(s.x * 1664525 + 1013904223, F.lit(m))
        return F.struct(x.alias("x"), F.concat(s.out, F.array(x / m)).alias("out"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(n)), state, step, lambda s: s.out)
