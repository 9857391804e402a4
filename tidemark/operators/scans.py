"""Running sums, counts and maxima within groups that may be longer than a task should hold.

``Parts`` cuts a table into ordered parts: where no group is long each group is one part and plain windows do
all; else rows are cut into ranges of (group, order), stored once, and a scan has two levels. Within a
(group, part) a window runs as usual; what lies before comes from one row for each (group, part), scanned over the parts
of its group. This works for every associative operation, so for sums, counts, least and greatest values.
A group of any length is then spread over as many tasks as it has ranges.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from tidemark.storage import in_ranges

#: Rows of one group that a single task orders.
LONG = 1 << 20
#: Tables that Catalyst estimates at no more bytes than this have no long group; larger ones are counted.
SMALL = 64 << 20

PART = "__part"
_COMBINE = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}
_REDUCE = {"sum": F.sum, "count": lambda c: F.count(c), "max": F.max, "min": F.min}


def estimated_bytes(table: DataFrame) -> int:
    """Catalyst's estimate of the table's size, without running anything."""
    return int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def has_long_group(table: DataFrame, by: list[str], limit: int = LONG, small: int = SMALL) -> bool:
    if estimated_bytes(table) <= small:
        return False
    longest = table.groupBy(*by).count().agg(F.max("count")).first()[0]
    return (longest or 0) > limit


@dataclass
class Parts:
    """A table in ordered parts: ``df`` has the column ``__part``, which grows with ``order`` inside each group of ``by``."""

    df: DataFrame
    by: list[str]
    order: list
    whole: bool

    @classmethod
    def of(cls, table: DataFrame, by: list[str], order: list, spread: bool | None = None) -> Parts:
        """``spread`` says whether groups are cut into ranges; if it is None the table is looked at."""
        spread = has_long_group(table, by) if spread is None else spread
        df = in_ranges(table, [*by, *order]) if spread else table.withColumn(PART, F.lit(0))
        return cls(df, list(by), list(order), not spread)

    def with_df(self, df: DataFrame, more: tuple[str, ...] = ()) -> Parts:
        """The same parts after rows were added columns, left out or multiplied; ``more`` columns split the groups further."""
        return Parts(df, [*self.by, *more], self.order, self.whole)

    @property
    def inside(self) -> WindowSpec:
        return Window.partitionBy(*self.by, PART).orderBy(*self.order)

    def scan(self, inclusive: bool = True, **columns: tuple[str, Column | str]) -> Parts:
        """Add columns: for each ``name=(operation, value)`` the operation over all rows of the group up to this one.

        Without ``inclusive`` the row itself is left out; there is null (a count or sum: 0) before the first row.
        """
        rows = self.inside.rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
        zero = {"count": F.lit(0), "sum": F.lit(0)}
        own = {name: _REDUCE[op](value).over(rows) for name, (op, value) in columns.items()}
        if self.whole:
            return self.with_df(self.df.withColumns({n: F.coalesce(c, zero[columns[n][0]]) if columns[n][0] in zero else c for n, c in own.items()}))
        earlier = Window.partitionBy(*self.by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
        totals = self.df.groupBy(*self.by, PART).agg(*[_REDUCE[op](value).alias(f"__{name}") for name, (op, value) in columns.items()])
        carried = totals.select(*self.by, PART, *[_COMBINE[op](f"__{name}").over(earlier).alias(f"__{name}") for name, (op, _) in columns.items()])
        df = _join(self.df, carried, [*self.by, PART])

        def combined(name: str, op: str) -> Column:
            mine, before = own[name], F.col(f"__{name}")
            if op in zero:
                return F.coalesce(mine, zero[op]) + F.coalesce(before, zero[op])
            return (F.greatest if op == "max" else F.least)(mine, before)  # these skip nulls

        df = df.withColumns({name: combined(name, op) for name, (op, _) in columns.items()})
        return self.with_df(df.drop(*[f"__{name}" for name in columns]))

    def totals(self, **columns: tuple[str, Column | str]) -> Parts:
        """Add columns with the operation over the whole group."""
        if self.whole:
            group = Window.partitionBy(*self.by)
            return self.with_df(self.df.withColumns({n: _REDUCE[op](value).over(group) for n, (op, value) in columns.items()}))
        part = self.df.groupBy(*self.by, PART).agg(*[_REDUCE[op](value).alias(f"__{n}") for n, (op, value) in columns.items()])
        group = Window.partitionBy(*self.by)
        spread = part.select(*self.by, PART, *[_COMBINE[op](f"__{n}").over(group).alias(n) for n, (op, _) in columns.items()])
        return self.with_df(_join(self.df, spread, [*self.by, PART]))

    def blocks(self, index: str, size: int, halo: int) -> tuple[DataFrame, WindowSpec, Column]:
        """Rows by blocks of ``size`` consecutive numbers ``index``, each with ``halo`` rows of its neighbours.

        Returns the rows, a window over a block in order, and whether a row is the block's own. Where groups are whole
        there are no blocks, and all rows are their own.
        """
        if self.whole:
            return self.df, Window.partitionBy(*self.by).orderBy(*self.order), F.lit(True)
        own = F.floor(F.col(index) / size)
        first, last = F.greatest(F.lit(0), F.floor((F.col(index) - halo) / size)), F.floor((F.col(index) + halo) / size)
        spread = self.df.withColumns({"__own": own, "__block": F.explode(F.sequence(first, last))})
        return spread, Window.partitionBy(*self.by, "__block").orderBy(*self.order), F.col("__own") == F.col("__block")


def _join(df: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """Both sides by their keys, of which a null is a value like others."""
    right = small.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *[c for c in small.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    return df.join(right, same, "left").drop(*[f"__k_{k}" for k in keys])
