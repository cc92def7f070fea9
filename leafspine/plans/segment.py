"""Window folds over ordered rows of a document: everything sequential here is one pass over (doc, pos).

All windows are partitioned by the document and ordered by a unique position, so a pipeline of them costs one
exchange on the document's id.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

UNBOUNDED, BEFORE = Window.unboundedPreceding, -1


def ordered(doc: str = "doc_id", pos: str = "pos") -> WindowSpec:
    return Window.partitionBy(doc).orderBy(pos)


def upto(doc: str = "doc_id", pos: str = "pos") -> WindowSpec:
    """All rows of the document up to this one."""
    return ordered(doc, pos).rowsBetween(UNBOUNDED, 0)


def earlier(doc: str = "doc_id", pos: str = "pos") -> WindowSpec:
    """All rows of the document before this one."""
    return ordered(doc, pos).rowsBetween(UNBOUNDED, BEFORE)


def later(first: int, last: int, doc: str = "doc_id", pos: str = "pos") -> WindowSpec:
    return ordered(doc, pos).rowsBetween(first, last)


def last_known(value: Column, over: WindowSpec) -> Column:
    """The last value that isn't null."""
    return F.last(value, ignorenulls=True).over(over)


def first_known(value: Column, over: WindowSpec) -> Column:
    return F.first(value, ignorenulls=True).over(over)


def running_segment(boundary: Column, doc: str = "doc_id", pos: str = "pos") -> Column:
    """0 before the first boundary, then the number of boundaries so far."""
    return F.sum(boundary.cast("long")).over(upto(doc, pos))


def in_order(value: Column, pos: str = "pos") -> Column:
    """An aggregate: the values of a group by position, nulls left out."""
    return F.transform(F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(F.col(pos).alias("p"), value.alias("v"))))), lambda x: x["v"])


def joined(value: Column, by: str, pos: str = "pos") -> Column:
    return F.array_join(in_order(value, pos), by)
