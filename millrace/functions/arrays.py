"""Functions on arrays of steps and values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def last_n(a: Column, n: int) -> Column:
    return F.slice(a, F.greatest(F.lit(1), F.size(a) - n + 1), n)


def loss_mask(loss: Column, attention: Column, trainable: Column) -> Column:
    """Element products, all zero where not trainable."""
    return F.zip_with(loss, attention, lambda x, y: F.when(trainable, x * y).otherwise(0))


def center_aggregate(a: Column, center: float = 500.0) -> Column:
    """Relative moves around a centre, added up."""
    return center + F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - center))


def drag_phases(kinds: Column, move: str = "move_to", down: str = "mouse_down", up: str = "mouse_up") -> tuple[Column, Column, Column]:
    """(moves before the press, moves while held, whether the drag is well formed).

    Well formed: one press, later one release that ends the sequence, and at
    least one move and nothing else in either phase; else the counts are null.
    """
    i, j, n = F.array_position(kinds, down), F.array_position(kinds, up), F.size(kinds)
    others = F.size(F.filter(kinds, lambda k: k != move))
    good = F.coalesce((i > 1) & (j > i + 1) & (j == n) & (others == 2), F.lit(False))
    return F.when(good, i - 1), F.when(good, j - i - 1), good


def reorder(order: Column, target: Column, rank: Column, count: int) -> Column:
    """The first rank - 1 other elements, filled up from 0..count-1, then the target."""
    rank = F.greatest(F.lit(1), F.least(F.lit(count), rank)).cast("int")
    wrong = F.filter(order, lambda x: x != target)
    rest = F.filter(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")), lambda x: (x != target) & ~F.array_contains(wrong, x))
    return F.concat(F.slice(F.concat(wrong, rest), 1, rank - 1), F.array(target))


def monotone_fractions(n: Column, start: float = 0.0) -> Column:
    """n offsets from ``start`` to 1; one alone is 1."""
    return F.when(n <= 1, F.array(F.lit(1.0))).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)).cast("int") - 1), lambda i: F.lit(start) + (1 - start) * i / F.greatest(n - 1, F.lit(1))))


def max_run(a: Column) -> Column:
    """Length of the longest run of equal neighbours."""
    nothing = F.get(F.slice(a, 1, 1), 1)
    zero = F.struct(F.lit(0).alias("best"), F.lit(0).alias("run"), nothing.alias("last"))

    def step(s: Column, x: Column) -> Column:
        run = F.when((s.run > 0) & (s.last == x), s.run + 1).otherwise(1)
        return F.struct(F.greatest(s.best, run).alias("best"), run.alias("run"), x.alias("last"))

    return F.aggregate(a, zero, step, lambda s: s.best)


def order_prefix(order: Column, target: Column) -> Column:
    """The order up to and with the target; empty without it."""
    return F.slice(order, 1, F.array_position(order, target).cast("int"))


def repeats(kinds: Column) -> Column:
    """The last action equals the one before, or the last four alternate A-B-A-B."""
    n = F.size(kinds)
    at = lambda i: F.get(kinds, n - i)
    same = (n >= 2) & (at(1) == at(2))
    swing = (n >= 4) & (at(1) == at(3)) & (at(2) == at(4)) & (at(1) != at(2))
    return F.coalesce(same | swing, F.lit(False))
