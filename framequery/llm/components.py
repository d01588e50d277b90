"""Connected components of a table of links, by hooking to the least neighbour, pointer jumping and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framequery.llm.common import dropped, written


def _roots(links: DataFrame) -> DataFrame:
    """(node, comp): the least node around each node, itself included, then that node's own, and so on to the end. Hooks
    never lead to a greater node, and a chain of them halves in each step."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    hooks = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("comp"))
    hooks = written(hooks, "hooks", few=True)
    while True:
        own = hooks.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        step = written(hooks.select("node", "comp").join(own.hint("merge"), "comp").select("node", F.col("next").alias("comp"), (F.col("next") != F.col("comp")).alias("moved")), "hooks", few=True)
        dropped(hooks)
        hooks = step
        if not hooks.where("moved").limit(1).count():
            return hooks


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of the links (a, b): comp is the least node that it reaches.

    Every round takes the links to the ends of the hooks; those within one end are done and leave, so that all rounds
    together read little more than the first one. All tables are written to the shared folder.
    """
    links = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "links", few=True)
    labels = None
    while True:
        roots = _roots(links)
        if labels is None:
            labels = roots.select("node", "comp")
        else:
            labels = written(renamed(labels, roots), "labels", few=True)
        left = links
        for end in ("a", "b"):
            left = left.join(roots.select(F.col("node").alias(end), F.col("comp").alias(f"at_{end}")).hint("merge"), end)
        left = written(left.select(F.least("at_a", "at_b").alias("a"), F.greatest("at_a", "at_b").alias("b")).where("a <> b").distinct(), "links", few=True)
        dropped(links)
        links = left
        if not links.limit(1).count():
            return labels


def renamed(labels: DataFrame, more: DataFrame) -> DataFrame:
    """labels (node, comp) with each comp taken to its own in more (node, comp), if it is there."""
    further = more.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
    return labels.join(further.hint("merge"), "comp", "left").select("node", F.coalesce("next", "comp").alias("comp"))


def extended(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels (node, comp) after further links (a, b), which need not lie between nodes that have a label; only these
    links are worked on, between the components that there are."""
    for end in ("a", "b"):
        own = labels.select(F.col("node").alias(end), F.col("comp").alias("comp"))
        links = links.join(own.hint("merge"), end, "left").withColumn(end, F.coalesce("comp", end)).drop("comp")
    more = components(links)
    new = more.join(labels.select("node").hint("merge"), "node", "left_anti")
    return written(renamed(labels, more).unionByName(new.select("node", "comp")), "labels", few=True)
