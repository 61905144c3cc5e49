"""All saves of incrementally updated documents at once, from the tables that each save added.

A file that was saved n times holds n tables of objects, each naming what that save changed. As rows (document, save, object) they are
a versioned table: an object is, at a save, what the last save up to it says. So counts of all saves come from windows and one walk
through each page tree that differs from the one before, and every object is read once, not once for each save.

changes: doc_id, save, object, alive (false where a save frees it), a row for each object that a save names.
nodes: doc_id, save, object, leaves (pages that the object itself is or holds), kids (objects below): page tree objects in the version of
that save.
saves: doc_id, save, root (the catalog's object).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import graphs


def object_counts(changes: DataFrame, saves: DataFrame) -> DataFrame:
    """(doc_id, save, object_count): how many objects are alive at each save."""
    own = Window.partitionBy("doc_id", "object").orderBy("save")
    now = F.col("alive").cast("int")
    step = changes.select("doc_id", "save", (now - F.coalesce(F.lag(now).over(own), F.lit(0))).alias("step"))
    per = step.groupBy("doc_id", "save").agg(F.sum("step").alias("step"))
    so_far = F.sum(F.coalesce("step", F.lit(0))).over(Window.partitionBy("doc_id").orderBy("save"))
    return saves.select("doc_id", "save").join(per, ["doc_id", "save"], "left").select("doc_id", "save", so_far.cast("int").alias("object_count"))


def page_counts(nodes: DataFrame, saves: DataFrame) -> DataFrame:
    """(doc_id, save, page_count): pages that the catalog of each save leads to."""
    by_save = Window.partitionBy("doc_id").orderBy("save")
    versions = nodes.select("*", F.lead("save").over(Window.partitionBy("doc_id", "object").orderBy("save")).alias("until"))
    touched = nodes.select("doc_id", "save").distinct().withColumn("touched", F.lit(True))
    marked = saves.select("doc_id", "save", "root").join(touched, ["doc_id", "save"], "left")
    other = ~F.col("root").eqNullSafe(F.lag("root").over(by_save))
    marked = marked.withColumn("epoch", F.when(F.coalesce("touched", F.lit(False)) | other | F.lag("save").over(by_save).isNull(), F.col("save")))
    marked = marked.withColumn("epoch", F.last("epoch", True).over(by_save))
    # the tree of each epoch: every node in the version that is in force
    epochs = marked.where("epoch = save").select("doc_id", "epoch", "root")
    inside = (F.col("save") <= F.col("epoch")) & (F.col("until").isNull() | (F.col("epoch") < F.col("until")))
    there = versions.join(epochs.drop("root"), "doc_id").where(inside).select("doc_id", "epoch", "object", "leaves", "kids")
    links = there.select("doc_id", "epoch", F.col("object").alias("source"), F.explode("kids").alias("target")).unionByName(
        epochs.select("doc_id", "epoch", F.lit(None).cast("long").alias("source"), F.col("root").alias("target")))
    seen = graphs.reach(links, ["doc_id", "epoch"]).select("doc_id", "epoch", F.col("node").alias("object"))
    pages = seen.join(there.select("doc_id", "epoch", "object", "leaves"), ["doc_id", "epoch", "object"]).groupBy("doc_id", "epoch").agg(F.sum("leaves").alias("n"))
    return marked.select("doc_id", "save", "epoch").join(pages, ["doc_id", "epoch"], "left").select(
        "doc_id", "save", F.coalesce("n", F.lit(0)).cast("int").alias("page_count"))
