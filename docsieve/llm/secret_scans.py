"""Secret scans over a ledger of content-addressed versions.

Every version of a document is addressed by the SHA-256 of its content. A rule has a version of its own. Only pairs of a blob and a
rule version that the ledger doesn't hold are scanned, each blob once however many paths and versions hold it, and the findings are
joined back to all of them. The ledger is a Parquet table of (blob, scanned, n_findings, findings): a row says which rules a run
tried on a blob, and what they found. A run appends what it scanned; of the ledger it reads the keys, to know what is unseen, and
the findings of the few rows that have any. Texts whose pairs are all known aren't shuffled: a bitmap of the unseen blobs, of at
most 2**filter_bits bits, holds them back before; past that size it lets more through, and the exact join after it decides.

Defined results: a null text is an empty blob for secret_scan and stays null in redact; each row is a path of its own, null ids and
repeated rows included; texts of any length are scanned whole; columns other than the id, the text and those named in `versions`
are left out (redact keeps all); an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap, exists, in_bitmap, materialize, shared_dir, table, tidy


@dataclass(frozen=True)
class Rule:
    """A kind of secret: where group `group` of the pattern has `least` code points or more. A changed rule gets a new version."""

    kind: str
    pattern: re.Pattern
    group: int = 0
    least: int = 0
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}:{self.version}"


#: The base kinds.
BASE = (
    Rule("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
    Rule("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    Rule("hex", re.compile(r"[0-9a-f]{16,}"), 0, 16),
)
#: Kinds that the method adds: formats that are secrets by themselves.
MORE = (
    Rule("pem", re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----")),
    Rule("jwt", re.compile(r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", re.A)),
    Rule("github", re.compile(r"\bgh[pousr]_[A-Za-z0-9]{36,}", re.A)),
    Rule("slack", re.compile(r"\bxox[abprs]-[A-Za-z0-9-]{10,}", re.A)),
    Rule("google", re.compile(r"\bAIza[A-Za-z0-9_-]{35}", re.A)),
)
RULES = BASE + MORE
#: A text without any of these can hold no finding of RULES; "eyJ" and the like are the fixed heads of the formats above.
SCREEN = re.compile(r"pass(?:word|wd)|secret|token|api_?key|AKIA|[0-9a-f]{16}|PRIVATE KEY-----|eyJ|gh[pousr]_|xox[abprs]-|AIza", re.I | re.A)

FINDINGS = "array<struct<kind:string,start:int,end:int>>"
_LEDGER = "blob string, scanned array<string>, n_findings int, findings array<struct<rule:string,start:int,end:int>>"


def scan(text: str, rules: tuple[Rule, ...] = RULES) -> list[dict]:
    """The findings of these rules; code points, end exclusive."""
    if rules and all(r in RULES for r in rules) and not SCREEN.search(text):
        return []
    return [{"rule": r.name, "start": m.start(), "end": m.end()} for r in rules for m in r.pattern.finditer(text) if m.end(r.group) - m.start(r.group) >= r.least]


def _versions(docs: DataFrame, id_col: str, text_col: str, more: tuple[str, ...]) -> DataFrame:
    """The address of every version, written once, so that texts aren't hashed again for each use."""
    return materialize(docs.select(F.col(id_col).alias("_path"), *(F.col(c).alias(f"_v_{c}") for c in more), F.sha2(F.col(text_col), 256).alias("blob")))


def update_ledger(docs: DataFrame, ledger: str, text_col: str = "text", rules: tuple[Rule, ...] = RULES, blobs: DataFrame | None = None,
                  filter_bits: int = 27) -> None:
    """Scan the unseen pairs of the texts of docs and append them to the ledger; null texts have no blob. blobs: their addresses, if known."""
    spark = docs.sparkSession
    texts = docs.where(F.col(text_col).isNotNull()).select(F.sha2(F.col(text_col), 256).alias("blob"), F.col(text_col).alias("text"))
    want = F.array(*(F.lit(r.name) for r in rules))
    if not exists(spark, ledger):
        todo = texts.dropDuplicates(["blob"]).withColumn("need", want)
    else:
        mine = (texts if blobs is None else blobs.where("blob is not null")).select("blob").distinct()
        seen = spark.read.schema(_LEDGER).parquet(ledger).select("blob", "scanned").join(mine, "blob", "left_semi")
        have = seen.groupBy("blob").agg(F.flatten(F.collect_list("scanned")).alias("have"))  # a row for each run that scanned it
        need = F.array_except(want, F.coalesce("have", F.array().cast("array<string>")))
        unseen = materialize(mine.join(have, "blob", "left").select("blob", need.alias("need")).where(F.size("need") > 0))
        bits = bitmap(unseen.select(F.xxhash64("blob").alias("key")), min(filter_bits, max(16, (16 * unseen.count()).bit_length())))
        shared = spark.sparkContext.broadcast(bits)

        def hold_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array(in_bitmap(shared.value, b.column(2).to_numpy().view("uint64"))))

        some = texts.withColumn("key", F.xxhash64("blob")).mapInArrow(hold_back, "blob string, text string, key long")
        # combined by blob before the join, so a blob of very many paths is one row
        todo = some.dropDuplicates(["blob"]).select("blob", "text").join(unseen, "blob")
    by_name = {r.name: r for r in rules}
    kinds = [pa.list_(pa.string()), pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, chosen = None, ()
        for b in batches:
            found = []
            for text, names in zip(b.column(1), b.column(2).to_pylist()):
                if names != last:
                    last, chosen = names, tuple(by_name[n] for n in names)
                found.append(scan(text.as_py(), chosen))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2).cast(kinds[0]), pa.array([len(f) for f in found], pa.int32()), pa.array(found, kinds[1])],
                                             ["blob", "scanned", "n_findings", "findings"])

    with tidy(spark):
        todo.select("blob", "text", "need").mapInArrow(run, _LEDGER).write.mode("append").parquet(ledger)


def _known(spark: SparkSession, ledger: str, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, findings) of the blobs that have any under these rule versions; kinds in the order of the rules where starts are equal."""
    names = F.array(*(F.lit(r.name) for r in rules))
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    rows = spark.read.schema(_LEDGER).parquet(ledger).where("n_findings > 0")
    placed = F.transform(F.filter("findings", lambda x: F.array_contains(names, x["rule"])),
                         lambda x: F.struct(x["start"].alias("start"), F.array_position(names, x["rule"]).alias("k"), x["end"].alias("end")))
    whole = rows.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(placed)))).alias("f")).where(F.size("f") > 0)
    # written, so that a blob of very many paths can be split in the join with them: no aggregation lies between
    return materialize(whole.select("blob", F.transform("f", lambda x: F.struct(
        F.element_at(kinds, x["k"].cast("int")).alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("findings")))


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger: str | None = None, rules: tuple[Rule, ...] = RULES,
                versions: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of docs: id, the columns in `versions`, blob, findings (kind, start, end; by start, then kind).

    ledger: folder of the ledger table, in storage that all executors reach. Without one, a new ledger serves for this run.
    """
    ledger = ledger or shared_dir(docs.sparkSession)
    docs = docs.select(*dict.fromkeys((id_col, *versions)), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    paths = _versions(docs, id_col, "_text", versions)
    update_ledger(docs, ledger, "_text", rules, paths)
    out = paths.join(_known(docs.sparkSession, ledger, rules), "blob", "left")
    return out.select(F.col("_path").alias(id_col), *(F.col(f"_v_{c}").alias(c) for c in versions), "blob", F.coalesce("findings", F.array().cast(FINDINGS)).alias("findings"))


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with every span that secret_scan finds replaced by `mark`; texts without findings stay as they are."""
    ledger = ledger or shared_dir(docs.sparkSession)
    update_ledger(docs, ledger, text_col, rules)
    blob, found = "_secret_blob", "_secret_findings"
    joined = docs.withColumn(blob, F.sha2(F.col(text_col), 256)).join(
        _known(docs.sparkSession, ledger, rules).select(F.col("blob").alias(blob), F.col("findings").alias(found)), blob, "left")
    t, whole = F.col(text_col), F.lit(1 << 30)
    done = F.aggregate(
        found, F.struct(F.lit("").alias("out"), F.lit(0).alias("end")),
        lambda acc, x: F.struct(
            F.when(x["start"] < acc["end"], acc["out"]).otherwise(
                F.concat(acc["out"], F.substring(t, acc["end"] + 1, x["start"] - acc["end"]), F.lit(mark))).alias("out"),
            F.greatest(acc["end"], x["end"]).alias("end")))
    text = F.concat(done["out"], F.substring(t, done["end"] + 1, whole))
    return joined.withColumn(text_col, F.when(F.col(found).isNull(), F.col(text_col)).otherwise(text)).select(*docs.columns)


def _digest(found: Column | str) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two loads of one ledger, as a growing collection makes them: the older half of the ids first, then the whole table.

    The second load scans only what the first one hasn't seen; the result comes from the ledger and has all rows.
    """
    docs, ledger = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), shared_dir(spark)
    middle = docs.agg(F.percentile_approx("doc_id", 0.5)).first()[0]
    update_ledger(docs.where(F.col("doc_id") <= F.lit(middle)), ledger)
    out = secret_scan(docs, ledger=ledger)
    base = [r.kind for r in BASE]
    count = lambda k: F.size(F.filter("findings", lambda x: x["kind"] == k)).cast("long")
    return out.select("doc_id", *(count(k).alias(f"n_{k}") for k in base),
                      F.sha2(_digest(F.filter("findings", lambda x: x["kind"].isin(base))), 256).alias("base_sha256"),
                      _digest(F.col("findings")).alias("spans"))


ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
p(kind, k, re, least) AS (VALUES
  ('assign', 0, '(?i:(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+))', 12),
  ('access', 1, 'AKIA[A-Z0-9]+', 18), ('hex', 2, '[0-9a-f]+', 16),
  ('pem', 3, '-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----', 0),
  ('jwt', 4, '\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}', 0),
  ('github', 5, '\bgh[pousr]_[A-Za-z0-9]{36,}', 0), ('slack', 6, '\bxox[abprs]-[A-Za-z0-9-]{10,}', 0),
  ('google', 7, '\bAIza[A-Za-z0-9_-]{35}', 0)),
m AS (SELECT rid, kind, k, re, least, regexp_extract_all(t, re) AS f, string_split_regex(t, re) AS g FROM d, p),
u AS (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM m WHERE len(f) > 0),
s AS (
  SELECT rid, kind, k, f[i] AS x, (coalesce(list_sum(list_transform(g[1:i], lambda y: length(y))), 0)
         + coalesce(list_sum(list_transform(f[1:i - 1], lambda y: length(y))), 0))::BIGINT AS a
  FROM u WHERE length(CASE WHEN k = 0 THEN regexp_extract(f[i], re, 2) ELSE f[i] END) >= least),
c AS (SELECT rid, kind, k, a, concat_ws(':', kind, a, a + length(x)) AS span FROM s),
q AS (SELECT rid, count_if(k = 0) AS n0, count_if(k = 1) AS n1, count_if(k = 2) AS n2,
             coalesce(string_agg(span, ',' ORDER BY a, k) FILTER (WHERE k < 3), '') AS base, string_agg(span, ',' ORDER BY a, k) AS spans
      FROM c GROUP BY rid)
SELECT doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access, coalesce(n2, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN q USING (rid)
"""
