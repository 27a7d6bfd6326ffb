"""Pages far into an ordered table without merging the pages before them.

Paging by offset makes every task offer as many rows as all pages up to the wanted one. Here a page is found by its
place in the order instead: either right after the last row of the page before (``page_after``), or after the nearest
entry of an index of positions (``position_index``, ``page_at``). Both are a filter on the ordering keys, which reaches
the scan below joins, and a top-k of a bounded number of rows.

Keys have to order the rows totally, so the last one is an id; null has a place in the order like any other value.
"""

from __future__ import annotations

from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from shelfline.operators.catalog import PAGE_SIZE
from shelfline.operators.chunks import numbered
from shelfline.session import scratch_dir

#: Rows between two entries of the index: what a page may have to skip.
STEP = 1024


class Key(NamedTuple):
    """One column of an ordering."""

    name: str
    descending: bool = False
    nulls_first: bool = True

    def order(self) -> Column:
        column = F.col(self.name)
        if self.descending:
            return column.desc_nulls_first() if self.nulls_first else column.desc_nulls_last()
        return column.asc_nulls_first() if self.nulls_first else column.asc_nulls_last()

    def beyond(self, value: Any) -> Column:
        """Rows that this key places after a value."""
        column = F.col(self.name)
        if value is None:
            return column.isNotNull() if self.nulls_first else F.lit(False)
        later = column < F.lit(value) if self.descending else column > F.lit(value)
        return F.coalesce(later, F.lit(False)) if self.nulls_first else F.coalesce(later, F.lit(True))


def base_keys() -> list[Key]:
    """Active first, then by name; the id makes the order total."""
    return [Key("is_active", descending=True, nulls_first=False), Key("name"), Key("id")]


def orders(keys: list[Key]) -> list[Column]:
    return [k.order() for k in keys]


def beyond(keys: list[Key], last: Row, inclusive: bool = False) -> Column:
    """Rows after ``last`` in the order of all keys, or from it on."""
    found = F.lit(inclusive)
    for key in reversed(keys):
        value = last[key.name]
        found = key.beyond(value) | (F.col(key.name).eqNullSafe(F.lit(value)) & found)
    return found


def page_after(df: DataFrame, keys: list[Key], last: Row | None = None, size: int = PAGE_SIZE) -> DataFrame:
    """The page that follows the row ``last``, or the first one."""
    rest = df if last is None else df.filter(beyond(keys, last))
    return rest.orderBy(*orders(keys)).limit(size)


def position_index(df: DataFrame, keys: list[Key], step: int = STEP) -> DataFrame:
    """The keys of every ``step``-th row with its ``position`` (from 0), stored; only key columns are sorted."""
    names = [k.name for k in keys]
    entries = numbered(df.select(*names), orders(keys)).filter(F.col("position") % step == 0).drop("total")
    path = scratch_dir(df.sparkSession, "positions")
    entries.write.parquet(path)
    return df.sparkSession.read.schema(entries.schema).parquet(path)


def page_at(df: DataFrame, keys: list[Key], index: DataFrame, number: int, size: int = PAGE_SIZE, step: int = STEP) -> DataFrame:
    """Page ``number`` (from 1); one index row reaches the driver, at most ``step + size`` rows of a task are merged."""
    first = (number - 1) * size
    entry = index.filter(F.col("position") == first // step * step).first()
    if entry is None:
        return df.limit(0)
    rest = df.filter(beyond(keys, entry, inclusive=True))
    skipped = first % step
    return rest.orderBy(*orders(keys)).limit(skipped + size).offset(skipped)
