"""Queries over versions and graphs: saves of documents and object graphs, derived from rows by integer arithmetic, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graphs, saves
from ..settings import Settings


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def save_object_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' days as the saves of documents: each names some of twenty objects, and frees those whose last event has a number divisible by 3."""
    day = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) div 86400000000").cast("int")
    changes = (_t(spark, sf_dir, "events").groupBy(F.col("user_id").alias("doc_id"), day.alias("save"), (F.col("event_id") % 20).alias("object"))
               .agg((F.max("event_id") % 3 != 0).alias("alive")))
    return saves.object_counts(changes, changes.select("doc_id", "save").distinct())


def save_page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' orders as page trees of four saves: order i has 2i and 2i + 1 below; the second save and the fourth change some of them."""
    i = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long")
    rows = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), "o_orderkey", i.alias("object"))
    two = F.array(2 * F.col("object"), 2 * F.col("object") + 1)
    version = lambda save, when, leaves, kids: rows.where(when).select("doc_id", F.lit(save).alias("save"), "object", F.lit(leaves).alias("leaves"), kids.alias("kids"))
    nodes = (version(0, "true", 0, two).withColumn("leaves", F.when(F.col("object") % 2 == 0, 1).otherwise(0))
             .unionByName(version(1, "o_orderkey % 4 = 0", 1, F.slice(two, 1, 1))).unionByName(version(3, "o_orderkey % 4 = 1", 2, F.slice(two, 1, 0))))
    all_saves = rows.select("doc_id").distinct().select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("save"), F.lit(1).cast("long").alias("root"))
    return saves.page_counts(nodes, all_saves)


_GRAPH = Settings(max_pdf_objects=14, strict=True, max_pdf_nest_depth=4)


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers' orders as objects with links in circles; the first is the root."""
    own = Window.partitionBy("o_custkey")
    rows = _t(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("doc_id"), (F.row_number().over(own.orderBy("o_orderkey")) - 1).cast("long").alias("object"), F.count("*").over(own).alias("n"))
    k, n = F.col("object"), F.col("n")
    links = rows.select("doc_id", k.alias("source"), F.explode(F.array((k * 7 + 3) % n, (k * k + 1) % (n + 2))).alias("target"))
    roots = rows.where("object = 0").select("doc_id", F.lit(None).cast("long").alias("source"), k.alias("target"))
    return rows.select("doc_id", "object"), links.unionByName(roots)


def object_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.report(*_graph(spark, sf_dir), _GRAPH)[0]


def unreachable_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.report(*_graph(spark, sf_dir), _GRAPH)[1]


QUERIES = {f.__name__: f for f in (save_object_counts, save_page_counts, object_reach, unreachable_objects)}

_REACH = f"""
o AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
s AS (SELECT * FROM o WHERE n <= {_GRAPH.max_pdf_objects}),
l AS (SELECT doc_id, k AS a, (k * 7 + 3) % n AS b FROM s UNION SELECT doc_id, k, (k * k + 1) % (n + 2) FROM s),
r(doc_id, k, d) AS (SELECT doc_id, 0::BIGINT, 0 FROM s WHERE k = 0
  UNION SELECT l.doc_id, l.b, d + 1 FROM r JOIN l ON l.doc_id = r.doc_id AND l.a = r.k WHERE d < 20),
m AS (SELECT s.doc_id, s.k, min(d) AS d FROM r JOIN s USING (doc_id, k) GROUP BY ALL)"""

ORACLES = {
    "save_object_counts": """
        WITH c AS (SELECT user_id AS doc_id, (epoch_us(ts) // 86400000000)::INT AS save, event_id % 20 AS object, max(event_id) % 3 <> 0 AS alive FROM events GROUP BY ALL),
        u AS (SELECT *, lead(save) OVER (PARTITION BY doc_id, object ORDER BY save) AS until FROM c),
        s AS (SELECT DISTINCT doc_id, save FROM c)
        SELECT s.doc_id, s.save, count(u.object)::INT AS object_count FROM s
        LEFT JOIN u ON u.doc_id = s.doc_id AND u.alive AND u.save <= s.save AND (u.until IS NULL OR s.save < u.until) GROUP BY ALL""",
    "save_page_counts": """
        WITH RECURSIVE o AS (SELECT o_custkey AS doc_id, o_orderkey % 4 AS m, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
        s AS (SELECT unnest([0, 1, 2, 3]) AS save),
        n AS (SELECT doc_id, save, i, CASE WHEN save = 3 AND m = 1 THEN 2 WHEN save >= 1 AND m = 0 THEN 1 ELSE (i % 2 = 0)::INT END AS leaves,
                     CASE WHEN save = 3 AND m = 1 THEN 0 WHEN save >= 1 AND m = 0 THEN 1 ELSE 2 END AS kids FROM o, s),
        r(doc_id, save, i) AS (SELECT doc_id, save, i FROM n WHERE i = 1
          UNION SELECT k.doc_id, k.save, k.i FROM r JOIN n p USING (doc_id, save, i) JOIN n k ON k.doc_id = p.doc_id AND k.save = p.save AND k.i >= 2 * p.i AND k.i < 2 * p.i + p.kids)
        SELECT doc_id, save, sum(leaves)::INT AS page_count FROM r JOIN n USING (doc_id, save, i) GROUP BY ALL""",
    "object_reach": f"""
        WITH RECURSIVE {_REACH}
        SELECT doc_id, t.n AS n_objects, CASE WHEN t.n <= {_GRAPH.max_pdf_objects} THEN coalesce(x.n, 0) END AS n_reachable, x.d::BIGINT AS max_depth,
               CASE WHEN t.n > {_GRAPH.max_pdf_objects} THEN '{graphs.ERROR_OBJECTS}' WHEN x.d > {_GRAPH.max_pdf_nest_depth} THEN '{graphs.ERROR_DEPTH}' END AS error
        FROM (SELECT doc_id, count(*) AS n FROM o GROUP BY 1) t LEFT JOIN (SELECT doc_id, count(*) AS n, max(d) AS d FROM m GROUP BY 1) x USING (doc_id)""",
    "unreachable_objects": f"WITH RECURSIVE {_REACH} SELECT doc_id, k AS object FROM s ANTI JOIN m USING (doc_id, k)",
}
