"""Navigation over the tree as window columns of one table.

``nodes``: doc_id, node_id, parent_id (null or the root's id at the top), node_type, dfs_order, depth,
child_ordinal, text, question_number.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import NAVIGABLE
from ..functions.text import clip


def label(width: int = 48) -> Column:
    """Question number and text in one clipped line; the id where there is neither."""
    number = F.when(F.col("question_number").isNotNull(), F.concat(F.col("question_number").cast("string"), F.lit(". "))).otherwise("")
    body = F.concat(number, clip(F.coalesce("text", F.lit("")), 1 << 20))
    body = F.when(F.length(body) > width, F.concat(F.substring(body, 1, width - 1), F.lit("…"))).otherwise(body)
    return F.when(body == "", F.col("node_id")).otherwise(body)


def index(nodes: DataFrame) -> DataFrame:
    """Adds label, is_nav, nav_order (navigable nodes only), sibling_index, sibling_count, prev_sibling,
    next_sibling, first_child, prev_same, next_same. Siblings are the navigable ones if there are any."""
    is_nav = F.col("node_type").isin(*NAVIGABLE)
    rows = nodes.withColumn("is_nav", is_nav).withColumn("label", label())
    doc = Window.partitionBy("doc_id").orderBy("dfs_order")
    rows = rows.withColumn("nav_order", F.when(F.col("is_nav"), F.sum(F.col("is_nav").cast("int")).over(doc.rowsBetween(Window.unboundedPreceding, 0)) - 1))
    family = Window.partitionBy("doc_id", "parent_id")
    rows = rows.withColumn("among", F.col("is_nav") | ~F.max("is_nav").over(family))
    row = Window.partitionBy("doc_id", "parent_id", "among").orderBy("child_ordinal", "dfs_order")
    only = lambda c: F.when(F.col("among") & F.col("parent_id").isNotNull(), c)
    rows = rows.withColumns({
        "sibling_index": F.coalesce(only(F.row_number().over(row) - 1), F.lit(0)),
        "sibling_count": F.when(F.col("parent_id").isNull(), 1).otherwise(F.sum(F.col("among").cast("int")).over(family)),
        "prev_sibling": only(F.lag("node_id").over(row)), "next_sibling": only(F.lead("node_id").over(row)),
    })
    same = Window.partitionBy("doc_id", "node_type").orderBy("dfs_order")
    rows = rows.withColumn("prev_same", F.when(F.col("is_nav"), F.lag("node_id").over(same))).withColumn("next_same", F.when(F.col("is_nav"), F.lead("node_id").over(same)))
    # a node and its children meet under its id: each row goes there as itself and as a child
    both = F.filter(F.array(F.struct(F.col("node_id").alias("at"), F.lit(False).alias("child")), F.struct(F.col("parent_id").alias("at"), F.lit(True).alias("child"))), lambda x: x["at"].isNotNull())
    rows = rows.withColumn("x", F.explode(both)).select("*", "x.at", "x.child").drop("x")
    child = F.when(F.col("child"), F.struct((~F.col("is_nav")).alias("other"), "child_ordinal", "node_id"))
    rows = rows.withColumn("first_child", F.min(child).over(Window.partitionBy("doc_id", "at"))["node_id"])
    return rows.where(~F.col("child")).drop("among", "at", "child")


def step_of_type(nodes: DataFrame, node_type: str, forward: bool = True) -> DataFrame:
    """doc_id, node_id, target: the next (or previous) node of a type from every node. From a node that isn't
    navigable the search begins before all of them."""
    order = Window.partitionBy("doc_id").orderBy("dfs_order")
    hit = F.when(F.col("node_type") == node_type, F.col("node_id"))
    frame = order.rowsBetween(1, Window.unboundedFollowing) if forward else order.rowsBetween(Window.unboundedPreceding, -1)
    near = F.first(hit, ignorenulls=True).over(frame) if forward else F.last(hit, ignorenulls=True).over(frame)
    every = Window.partitionBy("doc_id").orderBy("dfs_order").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    outside = F.first(hit, ignorenulls=True).over(every) if forward else F.lit(None).cast("string")
    return nodes.select("doc_id", "node_id", F.when(F.col("node_type").isin(*NAVIGABLE), near).otherwise(outside).alias("target"))


def breadcrumb(nodes: DataFrame, levels: int = 4) -> DataFrame:
    """doc_id, node_id, crumbs: ancestors' ids below the root, topmost first. Nodes of the tree builder have them
    as ``ancestors``; in others, of at most ``levels`` levels, so many self-joins reach the top."""
    if "ancestors" in nodes.columns:
        return nodes.select("doc_id", "node_id", F.coalesce("ancestors", F.array().cast("array<string>")).alias("crumbs"))
    up = nodes.where(F.col("node_type") != "ExamDocument").select("doc_id", F.col("node_id").alias("a"), F.col("parent_id").alias("p"))
    rows = nodes.select("doc_id", "node_id", F.col("parent_id").alias("p0"))
    for i in range(levels - 1):
        rows = rows.join(up.select("doc_id", F.col("a").alias(f"p{i}"), F.col("p").alias(f"p{i + 1}"), F.lit(True).alias(f"k{i}")), ["doc_id", f"p{i}"], "left")
    crumbs = F.array_compact(F.array(*(F.when(F.col(f"k{i}"), F.col(f"p{i}")) for i in reversed(range(levels - 1)))))
    return rows.select("doc_id", "node_id", crumbs.alias("crumbs"))


def find_by_block(nodes: DataFrame) -> DataFrame:
    """doc_id, block_id, node_id: the most specific node of each block: navigable, then deepest, then first.
    ``nodes`` with block_ids."""
    flat = nodes.select("doc_id", F.explode("block_ids").alias("block_id"), "node_id", "depth", "dfs_order", F.col("node_type").isin(*NAVIGABLE).alias("is_nav"))
    order = Window.partitionBy("doc_id", "block_id").orderBy(F.col("is_nav").desc(), F.col("depth").desc(), "dfs_order")
    return flat.withColumn("nth", F.row_number().over(order)).where("nth = 1").select("doc_id", "block_id", "node_id")


def locations(nodes: DataFrame) -> DataFrame:
    """doc_id, node_id, node_type, label, depth, parent_id, child_ids, sibling_index, sibling_count, page_number,
    question_number, summary: what a user is told about each place. ``nodes``: an index, with page_number and
    ancestors. Children are the navigable ones if there are any; the summary names the ancestors' types."""
    both = F.filter(F.array(F.struct(F.col("node_id").alias("at"), F.lit(False).alias("child")), F.struct(F.col("parent_id").alias("at"), F.lit(True).alias("child"))), lambda x: x["at"].isNotNull())
    rows = nodes.withColumn("x", F.explode(both)).select("*", "x.at", "x.child").drop("x")
    kids = F.array_sort(F.collect_list(F.when(F.col("child"), F.struct("child_ordinal", "node_id", "is_nav"))).over(Window.partitionBy("doc_id", "at")))
    rows = rows.withColumn("kids", kids).where(~F.col("child"))
    ids = lambda xs: F.transform(xs, lambda x: x["node_id"])
    own = F.filter("kids", lambda x: x["is_nav"])
    above = F.when(F.coalesce(F.size("ancestors"), F.lit(0)) <= 0, "").when(F.size("ancestors") == 2, "PassageGroup > Question > ").when(F.col("ancestors")[0].startswith("passage-group-"), "PassageGroup > ").otherwise("Question > ")
    return rows.select("doc_id", "node_id", "node_type", "label", "depth", "parent_id", F.when(F.size(own) > 0, ids(own)).otherwise(ids(F.col("kids"))).alias("child_ids"), "sibling_index", F.greatest("sibling_count", F.lit(1)).alias("sibling_count"), "page_number", "question_number", F.concat(above, "node_type", F.lit(": "), "label").alias("summary"))


@dataclass
class Cursor:
    """A place in one document's index; every move is a point lookup in the table."""

    table: DataFrame
    doc_id: object
    at: str | None = None
    origin: str | None = None

    def __post_init__(self) -> None:
        self.reset()

    def _row(self, condition: Column):
        return self.table.where((F.col("doc_id") == self.doc_id) & condition).orderBy("dfs_order").first()

    def location(self):
        return self._row(F.col("node_id") == self.at) if self.at is not None else None

    def go(self, node_id: str | None):
        """The node's row, or None if it isn't there; the place then stays."""
        row = self._row(F.col("node_id") == node_id) if node_id is not None else None
        self.at = row["node_id"] if row else self.at
        return row

    def go_block(self, block_id: str):
        """The most specific node that holds the block (``table`` with block_ids)."""
        row = find_by_block(self.table.where(F.col("doc_id") == self.doc_id)).where(F.col("block_id") == block_id).first()
        return self.go(row["node_id"]) if row else None

    def reset(self):
        row = self._row(F.col("is_nav")) or self._row(F.lit(True))
        return self.go(row["node_id"] if row else None)

    def _move(self, column: str):
        row = self.location()
        return self.go(row[column]) if row else None

    def parent(self):
        return self._move("parent_id")

    def first_child(self):
        return self._move("first_child")

    def next_sibling(self):
        return self._move("next_sibling")

    def prev_sibling(self):
        return self._move("prev_sibling")

    def step(self, node_type: str, forward: bool = True):
        rows = step_of_type(self.table.where(F.col("doc_id") == self.doc_id), node_type, forward)
        row = rows.where(F.col("node_id") == self.at).first()
        return self.go(row["target"]) if row else None

    def mark_origin(self) -> None:
        self.origin = self.at

    def go_origin(self):
        return self.go(self.origin)
