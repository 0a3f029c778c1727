"""Tagged blocks to the tree of passage groups, questions and choices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tags
from ..functions.text import clip, strip

FLUSH = ["Header", "Footer", "EndNotice"]
ROOT = "exam-root"


def assign(blocks: DataFrame) -> DataFrame:
    """Node type and parent of every block with text.

    ``blocks``: doc_id, page_number, reading_order, id, text, tag. A passage group or a flush tag opens a new
    epoch, in which the group and the latest question are the ones in force; one shuffle on doc_id.
    """
    doc = Window.partitionBy("doc_id").orderBy("page_number", "reading_order", "id").rowsBetween(Window.unboundedPreceding, 0)
    tag = F.col("tag")
    opens = tag.isin("PassageGroup", *FLUSH)
    rows = blocks.where(F.coalesce(strip(F.col("text")), F.lit("")) != "")
    rows = rows.withColumn("epoch", F.sum(F.coalesce(opens, F.lit(False)).cast("int")).over(doc)).withColumn("pos", F.row_number().over(doc))
    rows = rows.withColumn("group_no", F.when(tag == "PassageGroup", F.sum(F.when(tag == "PassageGroup", 1).otherwise(0)).over(doc)))
    inside = Window.partitionBy("doc_id", "epoch").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    node = F.when(tag == "PassageGroup", F.concat(F.lit("passage-group-"), F.col("group_no").cast("string"))).otherwise(F.col("id"))
    rows = rows.withColumn("node_id", node)
    rows = rows.withColumn("group_id", F.max(F.when(tag == "PassageGroup", F.col("node_id"))).over(inside))
    question = F.last(F.when(tag == "Question", F.struct("node_id", "pos")), ignorenulls=True).over(inside)
    rows = rows.withColumn("question", question).withColumn("question_id", F.col("question.node_id"))
    body = tag.isNull()
    q, g = F.col("question_id"), F.col("group_id")
    nth = F.sum(body.cast("int")).over(Window.partitionBy("doc_id", "epoch", "question_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    kind = (
        F.when(tag.isin("PassageGroup", "Question", "Footnote", "ExampleBox", *FLUSH), tag)
        .when(tag == "Choice", F.when(q.isNull(), "Unknown").otherwise("Choice"))
        .when(q.isNotNull(), F.when(nth == 1, "Prompt").otherwise("Paragraph"))
        .when(g.isNotNull(), "Passage")
        .otherwise("Unknown")
    )
    parent = (
        F.when(tag.isin("PassageGroup", *FLUSH), F.lit(ROOT))
        .when(tag.isin("Question", "Footnote"), F.coalesce(g, F.lit(ROOT)))
        .when(tag == "Choice", F.coalesce(q, F.lit(ROOT)))
        .otherwise(F.coalesce(q, g, F.lit(ROOT)))
    )
    confidence = F.when(F.col("node_type") == "Unknown", 0.0).when(F.col("node_type").isin(*FLUSH), 0.9).otherwise(0.85)
    number = F.when(F.col("node_type") == "Question", tags.question_number(F.col("text")))
    rng = lambda i: F.when(F.col("node_type") == "PassageGroup", F.nullif(F.regexp_extract("text", r"\[\s*([0-9]{1,2})\s*[~\-–—]\s*([0-9]{1,2})\s*\]", i), F.lit("")).cast("int"))
    # a parent is the root, the group or the question in force, so ancestors and their places are known here; a
    # group takes its place among the root's children when it is closed
    closed = F.max("pos").over(Window.partitionBy("doc_id", "epoch")) + 0.5
    own = F.when(F.col("node_type") == "PassageGroup", closed).otherwise(F.col("pos").cast("double"))
    asks, under = F.col("parent_id") == q, F.col("parent_id") == g
    above = F.array_compact(F.array(F.when(asks & g.isNotNull(), F.struct(g.alias("id"), closed.alias("place"))), F.when(asks, F.struct(q.alias("id"), F.col("question.pos").cast("double").alias("place"))).when(under, F.struct(g.alias("id"), closed.alias("place")))))
    rows = rows.withColumn("node_type", kind).withColumn("parent_id", parent).withColumn("above", F.when(F.col("parent_id") == ROOT, F.slice(above, 1, 0)).otherwise(above)).withColumn("place", own)
    rows = rows.withColumn("ancestors", F.transform("above", lambda x: x["id"])).withColumn("path", F.concat(F.transform("above", lambda x: x["place"]), F.array("place")))
    return rows.select("doc_id", "ancestors", "path", "id", "node_id", "node_type", "parent_id", "page_number", "text", confidence.alias("confidence"), number.alias("question_number"), rng(1).alias("start_question"), rng(2).alias("end_question"))


def tree(nodes: DataFrame) -> DataFrame:
    """Adds child_ordinal, depth and dfs_order to assigned nodes. A group takes its place among the root's
    children when it is closed, so what is put at the root while it is open comes before it."""
    rows = nodes.withColumn("depth", F.size("path"))
    rows = rows.withColumn("dfs_order", F.row_number().over(Window.partitionBy("doc_id").orderBy("path", "node_id")))
    family = Window.partitionBy("doc_id", "parent_id").orderBy(F.element_at("path", -1), "node_id")
    return rows.withColumn("child_ordinal", F.row_number().over(family) - 1).drop("path")


def with_root(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Adds a root row (depth and dfs_order 0) for each of ``docs`` (doc_id, source_path)."""
    root = docs.select("doc_id", F.lit(ROOT).alias("node_id"), F.lit("ExamDocument").alias("node_type"), F.col("source_path").alias("text"), F.lit(1.0).alias("confidence"), F.lit(0).alias("depth"), F.lit(0).alias("dfs_order"), F.lit(0).alias("child_ordinal"))
    return nodes.unionByName(root, allowMissingColumns=True)


def relations(nodes: DataFrame) -> DataFrame:
    """doc_id, relation_type, source_id, target_id: questions inside a group refer to it."""
    inside = (F.col("node_type") == "Question") & (F.col("parent_id") != ROOT)
    return nodes.where(inside).select("doc_id", F.lit("refers_to_passage").alias("relation_type"), F.col("node_id").alias("source_id"), F.col("parent_id").alias("target_id"))


def counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("doc_id", "node_type").agg(F.count("*").alias("n"))


def summary(nodes: DataFrame) -> DataFrame:
    """doc_id, summary: counts as one line."""
    n = lambda *t: F.count_if(F.col("node_type").isin(*t))
    related = F.count_if((F.col("node_type") == "Question") & (F.col("parent_id") != ROOT))
    names = ["PassageGroup", "Passage", "Question", "Choice", "ExampleBox"]
    return nodes.groupBy("doc_id").agg(F.concat_ws(" · ", *(F.concat(F.lit(f"{t} "), n(t).cast("string")) for t in names), F.concat(F.lit("relations "), related.cast("string")), F.concat(F.lit("unclassified "), n("Unknown").cast("string"))).alias("summary"))


def warnings(nodes: DataFrame) -> DataFrame:
    """doc_id, nth, warning: blocks without a place, questions with some but not five choices, questions
    outside a group; in that order."""
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    lost = nodes.where("node_type = 'Unknown'").groupBy("doc_id").agg(F.count("*").alias("n")).select("doc_id", F.lit(0).alias("part"), F.lit(0).alias("at"), text("unclassified blocks: ", F.col("n")).alias("warning"))
    choices = nodes.where("node_type = 'Choice'").groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("n")).where("n <> 5")
    odd = nodes.where("node_type = 'Question'").join(choices, ["doc_id", "node_id"]).select("doc_id", F.lit(1).alias("part"), F.col("dfs_order").alias("at"), text("question ", F.col("node_id"), ": expected 5 choices, found ", F.col("n")).alias("warning"))
    orphans = nodes.where((F.col("node_type") == "Question") & (F.col("parent_id") == ROOT)).groupBy("doc_id").agg(F.count("*").alias("n")).select("doc_id", F.lit(2).alias("part"), F.lit(0).alias("at"), text("questions outside PassageGroup: ", F.col("n")).alias("warning"))
    every = lost.unionByName(odd).unionByName(orphans)
    return every.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("part", "at", "warning")) - 1).alias("nth"), "warning")


def tree_text(nodes: DataFrame, most: int = 400, width: int = 48, relations_most: int = 50) -> DataFrame:
    """doc_id, tree: the indented tree of at most ``most`` nodes, and at most ``relations_most`` relations."""
    body = clip(F.coalesce("text", F.lit("")), width)
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), "node_type", F.when(F.col("question_number").isNotNull(), F.concat(F.lit(" #"), F.col("question_number").cast("string"))).otherwise(""), F.lit(" ("), "node_id", F.lit(")"), F.when(body != "", F.concat(F.lit(" — "), body)).otherwise(""))
    order = Window.partitionBy("doc_id").orderBy("dfs_order")
    related = (F.col("node_type") == "Question") & (F.col("parent_id") != ROOT)
    rows = nodes.withColumns({"line": line, "nth": F.row_number().over(order), "related": related}).withColumn("rel", F.sum(F.col("related").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    tie = F.concat(F.lit("  refers_to_passage: "), "node_id", F.lit(" → "), "parent_id")
    kept = lambda ok, n, x: F.array_sort(F.collect_list(F.when(ok & (F.col(n) <= (most if n == "nth" else relations_most)), F.struct(F.col(n).alias("n"), x.alias("line")))))
    per = rows.groupBy("doc_id").agg(kept(F.lit(True), "nth", F.col("line")).alias("lines"), F.count("*").alias("n"), kept(F.col("related"), "rel", tie).alias("ties"), F.count_if("related").alias("m"))
    text = lambda xs: F.transform(xs, lambda x: x["line"])
    none = F.array().cast("array<string>")
    cut = F.when(F.col("n") >= most, F.array(F.lit(f"… (truncated at {most} nodes)"))).otherwise(none)
    more = F.when(F.col("m") > relations_most, F.array(F.concat(F.lit("  … 외 "), (F.col("m") - relations_most).cast("string"), F.lit("건")))).otherwise(none)
    ties = F.when(F.col("m") > 0, F.concat(F.array(F.lit("relations:")), text("ties"), more)).otherwise(none)
    return per.select("doc_id", F.array_join(F.concat(text("lines"), cut, ties), "\n").alias("tree"))


def all_unknown(blocks: DataFrame) -> DataFrame:
    """The stand-in builder: every block, in list order, unknown at the root."""
    order = Window.partitionBy("doc_id").orderBy("page_number", "reading_order", "id")
    return blocks.select("doc_id", F.col("id").alias("node_id"), F.lit("Unknown").alias("node_type"), F.lit(ROOT).alias("parent_id"), "text", F.lit(0.0).alias("confidence"), (F.row_number().over(order) - 1).alias("child_ordinal"))
