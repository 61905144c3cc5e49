"""What each filter of a chain removes in every order, from one CUBE over failure flags.

Every document gets one flag a filter: whether it fails. Documents with equal flags and part are counted together, and GROUP BY CUBE
over the flags and the part gives, for every subset of filters, the documents that fail none of them: the row whose selected flags
are all false. A step of an order goes from one subset to a larger one, so its counts are differences of two such rows, joined by
part and subset. Nothing is filtered twice, and the table is read once whatever the number of orders.

Copies (filter E) are found without bringing a text's copies together: rows are counted by the text's SHA-256, part and labels, with
the smallest id of each group, before any group is compared with the others of its text. A text of a third of all rows is a few rows.

Defined results: a null text is empty (no words: fails A, passes B and C); a null part is the empty string; each row counts by
itself, repeated rows included; a row with a null id is no copy, and nothing is its copy; equal ids with equal texts aren't copies of
each other; an id counts as good or toxic where any of its label rows says 1, null ids never; texts of any length are taken whole;
columns other than those named are left out, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, integer_ids, materialize, table

#: Filters in the order of their bits in a subset.
NAMES = "ABCDE"
_ALL = (1 << len(NAMES)) - 1
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_failures(text: Column, words: Column) -> dict[str, Column]:
    """Filters that look at one text: `words` is the array of its words."""
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def failure_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, A to E, n, good, toxic): documents counted by their part and failure flags."""
    integer_ids(docs, id_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", SPACE), ""))
    flags = text_failures(F.col("text"), F.col("words"))
    rows = rows.select("id", "part", F.unhex(F.sha2("text", 256)).alias("hash"), *(c.alias(k) for k, c in flags.items()))
    rows = rows.groupBy("hash", "id", "part", *flags).agg(F.count("*").alias("n"))
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    no = F.lit(False)
    rows = rows.join(marks, "id", "left").select(*rows.columns, F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
    # a row for each text, part and labels: the group's smallest id, and how many rows have it
    kinds = ["part", "good", "toxic", *flags]
    groups = rows.groupBy("hash", *kinds).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("loose"),
        F.min("id").alias("least"), F.min_by("n", "id").alias("n_least"))
    own = F.when(F.col("least") == F.min("least").over(Window.partitionBy("hash")), F.col("n_least")).otherwise(0)
    # of each group, the rows that are no copies and those that are
    groups = groups.withColumn("own", F.col("loose") + own)
    both = F.explode(F.array(F.struct(F.lit(False).alias("E"), F.col("own").alias("n")), F.struct(F.lit(True).alias("E"), (F.col("n") - F.col("own")).alias("n"))))
    split = groups.select("part", "good", "toxic", *flags, both.alias("x")).select("part", "good", "toxic", *flags, "x.E", "x.n").where("n > 0")
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return split.groupBy("part", *NAMES).agg(F.sum("n").alias("n"), count(F.col("good")).alias("good"), count(F.col("toxic")).alias("toxic"))


def survivors(counts: DataFrame) -> DataFrame:
    """(part, subset, n, good, toxic) of failure_counts: documents that fail no filter of a subset; every subset, zeros included.

    subset has the bit of each filter in it, A's the lowest.
    """
    chosen = sum((F.when(F.grouping(k) == 0, F.lit(1 << i)).otherwise(0) for i, k in enumerate(NAMES)), F.lit(0))
    cube = counts.cube("part", *NAMES).agg(F.grouping("part").alias("over_parts"), chosen.alias("subset"), *(F.sum(c).alias(c) for c in ("n", "good", "toxic")))
    passing = " and ".join(f"not coalesce({k}, false)" for k in NAMES)
    cube = cube.where(f"over_parts = 0 and {passing}").select("part", "subset", "n", "good", "toxic")
    every = counts.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit(_ALL))).alias("subset"))
    zero = F.lit(0).cast("long")
    return every.join(cube, ["part", "subset"], "left").select("part", "subset", *(F.coalesce(c, zero).alias(c) for c in ("n", "good", "toxic")))


def steps(spark: SparkSession) -> DataFrame:
    """(filter_order, step, filter, before, after) of all orders: the subsets before and after a step; 600 rows, whatever the data."""
    rows = []
    for order in permutations(NAMES):
        before = 0
        for k, name in enumerate(order, 1):
            bit = 1 << NAMES.index(name)
            rows.append(("".join(order), k, bit, before, before | bit))
            before |= bit
    return spark.createDataFrame(rows, "filter_order string, step int, filter int, before int, after int")


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row a part, order and step: part, filter_order, step and COUNTS.

    kept: documents of the part left after this step; removed: those that go here; redundant: those that fail this filter but went
    earlier; unique_fails: those that fail this filter alone; good_lost, toxic_lost: labelled documents that go here; shapley: what
    this filter removes, summed over all orders.
    """
    left = materialize(survivors(materialize(failure_counts(docs, labels, id_col, text_col, part_col))))
    of = lambda a: left.select("part", F.col("subset").alias(f"{a}_set"), *(F.col(c).alias(f"{a}_{c}") for c in ("n", "good", "toxic")))
    bits = F.explode(F.array(*(F.lit(1 << i) for i in range(len(NAMES)))))
    # what a filter alone lets through, and what all others together do
    single = (left.where("subset = 0").select("part", F.col("n").alias("total"), bits.alias("filter"))
              .join(left.select("part", F.col("subset").alias("filter"), F.col("n").alias("passing")), ["part", "filter"])
              .join(left.select("part", (F.lit(_ALL) - F.col("subset")).alias("filter"), F.col("n").alias("past_others")), ["part", "filter"])
              .join(left.where(f"subset = {_ALL}").select("part", F.col("n").alias("past_all")), "part"))
    out = (of("b").join(F.broadcast(steps(docs.sparkSession)), F.col("b_set") == F.col("before")).join(
        of("a").withColumnRenamed("part", "a_part"), (F.col("part") == F.col("a_part")) & (F.col("after") == F.col("a_set"))).join(single, ["part", "filter"]))
    removed = F.col("b_n") - F.col("a_n")
    return out.select(
        "part", "filter_order", "step", F.col("a_n").alias("kept"), removed.alias("removed"),
        (F.col("total") - F.col("passing") - removed).alias("redundant"), (F.col("past_others") - F.col("past_all")).alias("unique_fails"),
        (F.col("b_good") - F.col("a_good")).alias("good_lost"), (F.col("b_toxic") - F.col("a_toxic")).alias("toxic_lost"),
        F.sum(removed).over(Window.partitionBy("part", "filter")).alias("shapley"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Filters every order as it stands, one row a document and step; no cube.
ORACLE = r"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[ 	-
]+'), lambda x: x <> '') AS words
  FROM documents),
m AS (SELECT t, min(doc_id) AS least FROM w GROUP BY t),
g AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
d AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         (len(words) < 200)::INT AS a, (100 * len(list_distinct(words)) < 50 * len(words))::INT AS b,
         (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT AS c,
         regexp_matches(t, '[#$%&*|]')::INT AS d, coalesce(w.doc_id > least, false)::INT AS e
  FROM w JOIN m USING (t) LEFT JOIN g USING (doc_id)),
f AS (
  SELECT part, a || '' || b || c || d || e AS bits, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
  FROM d GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT p.x || q.x || r.x || s.x || u.x AS filter_order FROM l p, l q, l r, l s, l u
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, u.x])) = 5),
k AS (SELECT filter_order, unnest(range(1, 6))::INT AS step FROM o),
z AS (
  SELECT *, filter_order[step] AS name, list_bool_or(list_transform(range(1, step), lambda i: bits[ascii(filter_order[i]) - 64] = '1')) AS gone,
         bits[ascii(filter_order[step]) - 64] = '1' AS fails
  FROM k, f),
r AS (
  SELECT part, filter_order, step, any_value(name) AS name,
         coalesce(sum(n) FILTER (WHERE NOT coalesce(gone, false) AND NOT fails), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (WHERE NOT coalesce(gone, false) AND fails), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (WHERE coalesce(gone, false) AND fails), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (WHERE fails AND length(replace(bits, '0', '')) = 1), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (WHERE NOT coalesce(gone, false) AND fails), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (WHERE NOT coalesce(gone, false) AND fails), 0)::BIGINT AS toxic_lost
  FROM z GROUP BY part, filter_order, step)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, name))::BIGINT AS shapley
FROM r
"""
