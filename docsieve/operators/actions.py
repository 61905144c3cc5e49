"""Chains of actions behind additional-action triggers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize

#: Action types that are refused, and how far a chain is followed.
DANGEROUS = ("GoToE", "GoToR", "ImportData", "JavaScript", "Launch", "SubmitForm")
MAX_DEPTH = 25


def dangerous_actions(actions: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """doc_id, subtypes: sorted dangerous types reached from any trigger within max_depth steps.

    actions: doc_id, action_id, parent_id (null for what a trigger starts), subtype. The chains are followed level by level from the
    actions that the level before reached first, so cycles end, and so does the work where nothing new is reached.
    """
    node = ["doc_id", "action_id", "subtype"]
    rows = materialize(actions.select(*node, "parent_id"))
    seen = front = materialize(rows.where("parent_id is null").select(*node).distinct())
    below = rows.where("parent_id is not null")
    for _ in range(max_depth):
        parents = front.select("doc_id", F.col("action_id").alias("parent_id")).distinct()
        front = materialize(below.join(parents, ["doc_id", "parent_id"], "left_semi").select(*node).subtract(seen))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return (seen.where(F.col("subtype").isin(*DANGEROUS)).groupBy("doc_id")
            .agg(F.array_sort(F.collect_set("subtype")).alias("subtypes")))


def dangerous(subtypes) -> F.Column:
    """The dangerous ones of an array of action types, sorted."""
    return F.array_sort(F.array_distinct(F.filter(subtypes, lambda x: x.isin(*DANGEROUS))))


def error(subtypes) -> F.Column:
    return F.when(F.size(subtypes) > 0, F.concat(
        F.lit("Document rejected: an additional-actions (/AA) trigger references disallowed action type(s) ("),
        F.array_join(subtypes, ", "), F.lit(").")))
