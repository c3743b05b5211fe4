"""Exact order statistics by narrowing, without sorting or moving the table.

A mergeable sketch (``percentile_approx``: its rank error is known) brackets each
wanted rank by two values; one pass counts the rows below and inside every
bracket, and the few values inside are counted and merged. Should a bracket still
hold many distinct values, it is narrowed by another sketch of its inside. Every
pass reads only the columns concerned and sends a few numbers to the driver, so
the number of passes grows with the logarithm of the table, and counts certify
that each rank lies in its bracket.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rank error of a sketch is 1 / ACCURACY of the rows it saw.
ACCURACY = 2_000
#: Brackets are merged once they hold so few rows together.
MERGED = 20_000


@dataclass
class _Bracket:
    """A wanted quantile of a column: the values from ``low`` to ``high`` hold its two neighbouring ranks."""

    column: str
    q: float
    low: float | None = None   # None: open
    high: float | None = None
    below: int = 0
    inside: int = 0
    ranks: tuple[int, int] = (0, 0)
    stuck: bool = False  # a value that many rows share keeps it from getting narrower: few distinct values are left

    def value(self) -> Column:
        return F.col(self.column).cast("double")

    def holds(self) -> Column:
        """Whether a row's value lies in the bracket; null and NaN never do."""
        keep = self.value().isNotNull() & ~F.isnan(self.value())
        if self.low is not None:
            keep = keep & (self.value() >= F.lit(self.low))
        if self.high is not None:
            keep = keep & (self.value() <= F.lit(self.high))
        return keep

    def shares(self) -> list[float]:
        """Shares of the rows inside between which both ranks lie, with the sketch's error."""
        error = 2 / ACCURACY
        lo, hi = ((r - self.below) / max(1, self.inside) for r in self.ranks)
        return [max(0.0, lo - error), min(1.0, hi + error + 1 / max(1, self.inside))]


def table_statistics(df: DataFrame, spec: dict[str, list[float]], extra: dict[str, Column] | None = None) -> tuple[dict, dict]:
    """Quantiles ``{(column, q): value}`` as pandas interpolates them, and further aggregates ``{name: value}``.

    Null and NaN are no values; a column without values has quantile None. The
    aggregates of ``extra`` are part of the first pass.
    """
    known = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in spec}
    error = 2 / ACCURACY
    first = df.agg(
        *[F.count(known[c]).alias(f"n{i}") for i, c in enumerate(spec)],
        *[F.percentile_approx(known[c], F.array(*[F.lit(min(1.0, max(0.0, q + e))) for q in qs for e in (-error, error)]), F.lit(ACCURACY)).alias(f"p{i}")
          for i, (c, qs) in enumerate(spec.items()) if qs],
        *[x.alias(f"x{i}") for i, x in enumerate((extra or {}).values())]).first()
    out = {(c, q): None for c, qs in spec.items() for q in qs}
    wait = []
    for i, (c, qs) in enumerate(spec.items()):
        n = int(first[f"n{i}"])
        for j, q in enumerate(qs):
            if n:
                pos = q * (n - 1)
                b = _Bracket(c, q, inside=n, ranks=(math.floor(pos), math.ceil(pos)))
                if n > MERGED // max(1, len(out)):  # else all values are few enough to be merged
                    b.low, b.high = first[f"p{i}"][2 * j : 2 * j + 2]
                wait.append(b)
    size = {(b.column, b.q): b.inside for b in wait}
    while wait:
        cut = [b for b in wait if b.low is not None or b.high is not None]
        if cut:
            seen = df.agg(*[x for i, b in enumerate(cut) for x in (
                F.count(F.when(b.value() < F.lit(b.low), 1) if b.low is not None else F.lit(None)).alias(f"b{i}"),
                F.count(F.when(b.holds(), 1)).alias(f"m{i}"))]).first()
            for i, b in enumerate(cut):
                b.below, b.inside = int(seen[f"b{i}"]), int(seen[f"m{i}"])
                if b.ranks[0] < b.below:  # the sketch missed: look on that side
                    b.low, b.high, b.below, b.inside = None, b.low, 0, b.below
                elif b.ranks[1] >= b.below + b.inside:
                    b.low, b.high = (b.high if b.ranks[0] >= b.below + b.inside else b.low), None
                    b.inside = size[b.column, b.q] - b.below
                elif b.low == b.high:
                    out[b.column, b.q] = b.low
        wait = [b for b in wait if out[b.column, b.q] is None]
        # Merged in one pass once all fit; until then all that hold many rows are narrowed together, not one bracket a pass.
        large = [b for b in wait if not b.stuck and b.inside > MERGED // len(wait)]
        few = wait if sum(b.inside for b in wait if not b.stuck) <= MERGED else []
        if few:
            pairs = F.filter(F.array(*[F.when(b.holds(), F.struct(F.lit(i).alias("i"), b.value().alias("v"))) for i, b in enumerate(few)]),
                             lambda x: x.isNotNull())
            merged: dict[int, list] = {}
            for i, v, c in df.select(F.explode(pairs).alias("x")).groupBy("x.i", "x.v").count().collect():  # at most MERGED rows
                merged.setdefault(i, []).append((v, c))
            for i, b in enumerate(few):
                at, ends = b.below, []
                for v, c in sorted(merged[i]):
                    at += c
                    ends.append((at, v))
                lo, hi = (next(v for end, v in ends if end > r) for r in b.ranks)
                pos = b.q * (size[b.column, b.q] - 1)
                out[b.column, b.q] = lo + (hi - lo) * (pos - math.floor(pos))
        wait = [b for b in wait if out[b.column, b.q] is None]
        if wait and not few:  # narrow what still holds many rows
            row = df.agg(*[F.percentile_approx(F.when(b.holds(), b.value()), F.array(*map(F.lit, b.shares())), F.lit(ACCURACY)).alias(f"p{i}")
                           for i, b in enumerate(large)]).first()
            for i, b in enumerate(large):
                b.stuck = (b.low, b.high) == tuple(row[f"p{i}"])
                b.low, b.high = row[f"p{i}"]
    return out, {name: first[f"x{i}"] for i, name in enumerate(extra or {})}


def sort_number(df: DataFrame, name: str) -> Column:
    """A column as a number that sorts alike: dates as days, times as microseconds (zone-free for zone-less times)."""
    kind, c = df.schema[name].dataType, F.col(name)
    if isinstance(kind, T.DateType):
        return F.unix_date(c)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(kind, T.TimestampNTZType):
        seconds = F.unix_date(c.cast("date")).cast("long") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60
        return seconds * 1_000_000 + (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("long")
    if isinstance(kind, T.NumericType):
        return c
    raise TypeError(f"no rank selection on {name}: {kind.simpleString()}")


def nth(df: DataFrame, column: str, rank: int, total: int) -> tuple:
    """The value at 0-based ``rank`` of a numeric column in ascending order, the rows before it and the rows that share it.

    ``total`` is the row count. Nulls sort first, NaN last. A sketch of known rank
    error gives two values around the rank and one pass counts the rows before, at
    and between them, until few rows are left to be counted by value; the part that
    holds the rank never includes the two values again, so every round narrows it.
    """
    c = F.col(column)
    rows, below, inside = df.select(column), 0, total
    if inside > MERGED:
        nulls = rows.where(c.isNull()).count()
        if rank < nulls:
            return None, 0, nulls
        rows, below, inside = rows.where(c.isNotNull()), nulls, total - nulls
    while inside > MERGED:
        share, error = (rank - below + 0.5) / inside, 2 / ACCURACY
        ends = F.array(F.lit(max(0.0, share - error)), F.lit(min(1.0, share + error)))
        a, b = rows.agg(F.percentile_approx(c, ends, F.lit(ACCURACY))).first()[0]
        less, at_a, between, at_b = rows.agg(
            F.count_if(c < F.lit(a)), F.count_if(c == F.lit(a)), F.count_if((c > F.lit(a)) & (c < F.lit(b))),
            F.count_if((c == F.lit(b)) & (c > F.lit(a)))).first()
        more = inside - less - at_a - between - at_b
        for keep, n, value in ((c < F.lit(a), less, None), (None, at_a, a), ((c > F.lit(a)) & (c < F.lit(b)), between, None),
                               (None, at_b, b), (c > F.lit(b), more, None)):
            if rank < below + n:
                break
            below += n
        if keep is None:
            return value, below, n
        if n == inside:  # whole numbers too large for the sketch to tell apart: few different ones are left
            break
        rows, inside = rows.where(keep), n
    for value, n in rows.groupBy(c.alias("v")).count().orderBy("v").collect():  # at most MERGED rows
        if rank < below + n:
            return value, below, n
        below += n
    raise IndexError(f"rank {rank} of {total} rows")
