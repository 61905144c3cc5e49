"""Quality rules as a short-circuit cascade of Column expressions.

Each rule rejects a document on one or two measured quantities. The cost and the selectivity of every rule are estimated on a
bounded sample, and the rules are then ordered by rejections per cost, so that cheap rules that reject much run first. A measure
is computed inside a CASE, only for the rows that no earlier rule rejects; so the order decides what is computed, never a verdict.
Measures that the caller asks for are computed for all rows.

Defined results: a null or empty text has no words and fails `few_words`; ids are not read, so null and repeated ones are kept as
they are; repeated rows are judged one by one; texts of any length are measured whole; other columns pass through, and one with
the name of a column that is added is replaced; an empty table gives none.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, table, words_col

GRAM = 8


@dataclass(frozen=True)
class Rule:
    """A document is rejected where `reject` holds; `needs` are the measures it reads."""

    name: str
    reject: str
    needs: tuple[str, ...]


#: The two base rules, then those of the cascade's own.
BASE = (
    Rule("few_words", "n_words < 20", ("n_words",)),
    Rule("repeated_words", "100 * n_repeat_words > 30 * n_words", ("n_words", "n_repeat_words")),
)
RULES = (
    *BASE,
    Rule("long_words", "word_chars > 12 * n_words", ("n_words", "word_chars")),
    Rule("short_words", "word_chars < 2 * n_words", ("n_words", "word_chars")),
    Rule("symbols", "10 * n_symbols > n_words", ("n_words", "n_symbols")),
    Rule("duplicate_lines", "10 * n_dup_lines > 3 * n_lines", ("n_lines", "n_dup_lines")),
    Rule("capitals", "2 * n_upper > word_chars", ("word_chars", "n_upper")),
    Rule("no_letters", "2 * n_letters < word_chars", ("word_chars", "n_letters")),
)


def _covered(starts: Column, n: int = GRAM) -> Column:
    """Words covered by windows of n words at these ascending starts."""
    last = F.size(starts)
    inner = F.aggregate(
        F.sequence(F.lit(1), last - 1), F.lit(0).cast("long"),
        lambda acc, j: acc + F.least(F.lit(n), F.element_at(starts, j + 1) - F.element_at(starts, j)).cast("long"))
    return F.when(last == 0, F.lit(0).cast("long")).when(last == 1, F.lit(n).cast("long")).otherwise(inner + n)


def _repeated(words: Column, n_words: Column) -> dict[str, Column]:
    """Helper columns of n_repeat_words: 64-bit hashes of all windows; only texts in which one occurs twice are looked at further."""
    s = F.col("_q_sorted")
    same = lambda j, k: F.get(s, j)["h"] == F.get(s, k)["h"]
    return {
        "_q_grams": F.when(n_words >= GRAM, F.transform(F.sequence(F.lit(1), F.size(words) - (GRAM - 1)), lambda i: F.xxhash64(F.slice(words, i, GRAM)))),
        "_q_sorted": F.when(F.size(F.array_distinct("_q_grams")) < F.size("_q_grams"),
                            F.array_sort(F.transform("_q_grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
        "_q_starts": F.array_sort(F.transform(
            F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: F.coalesce(same(j, j + 1), F.lit(False)) | F.when(j > 0, same(j, j - 1)).otherwise(False)),
            lambda j: F.get(s, j)["i"])),
    }


#: What each measure reads of other measures and helper columns; all else comes from the text.
READS = {"_q_words": (), "n_words": ("_q_words",), "word_chars": ("_q_words",), "n_symbols": (), "n_upper": (), "n_letters": (), "_q_lines": (),
         "n_lines": ("_q_lines",), "n_dup_lines": ("_q_lines",), "_q_grams": ("_q_words", "n_words"), "_q_sorted": ("_q_grams",), "_q_starts": ("_q_sorted",),
         "n_repeat_words": ("_q_starts",)}


def _measures() -> dict[str, Column]:
    """Each measure over `_q_text` and the columns that it reads."""
    t, words, lines = F.coalesce(F.col("_q_text"), F.lit("")), F.col("_q_words"), F.col("_q_lines")
    without = lambda pattern: (F.length(t) - F.length(F.regexp_replace(t, pattern, ""))).cast("long")
    return {
        "_q_words": words_col(F.col("_q_text")),
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": without(r"[#*$%&|<>]+"),
        "n_upper": without(r"[A-Z]+"),
        "n_letters": F.length(F.regexp_replace(t, r"\P{L}+", "")).cast("long"),
        "_q_lines": F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        **_repeated(words, F.col("n_words")),
        "n_repeat_words": F.when(F.col("_q_sorted").isNull(), F.lit(0).cast("long")).otherwise(_covered(F.col("_q_starts"))),
    }


def _with_needs(names: set[str] | tuple[str, ...]) -> list[str]:
    """The measures and all that they read, each after what it reads."""
    out: list[str] = []

    def add(name: str) -> None:
        for need in READS[name]:
            add(need)
        if name not in out:
            out.append(name)

    for name in sorted(names):
        add(name)
    return out


#: Nanoseconds that a measure takes for each code point, word and line of a text, timed once over whole texts of `documents`.
#: What it costs a corpus is estimated from the code points, words and lines of the sample; only ratios matter.
COST = {"_q_words": (128, 0, 0), "n_words": (0, 0, 0), "word_chars": (11, 0, 0), "n_symbols": (95, 0, 0), "n_upper": (86, 0, 0), "n_letters": (139, 0, 0),
        "_q_lines": (43, 0, 0), "n_lines": (0, 0, 0), "n_dup_lines": (0, 0, 200), "_q_grams": (0, 2090, 0), "_q_sorted": (0, 430, 0), "_q_starts": (0, 200, 0),
        "n_repeat_words": (0, 100, 0)}


def measure(df: DataFrame, names: set[str] | tuple[str, ...]) -> DataFrame:
    """df (with the text as _q_text) with these measures, and what they read."""
    measures = _measures()
    for name in _with_needs(names):
        df = df.withColumn(name, measures[name])
    return df


def order_rules(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = 1024,
                computed: tuple[str, ...] = ()) -> list[Rule]:
    """The rules by rejections per cost, both estimated on about `sample_rows` rows of docs.

    One job gives, for each set of rules that reject a row, how many rows there are and their code points, words and lines. Rules
    are then chosen one by one: of the rows that the rules before it leave, the one that rejects most for the cost of the measures
    that aren't there yet. `computed`: measures that all rows get anyway. Equal tables in equal files give equal orders.
    """
    n = docs.count()
    if not n or not rules:
        return list(rules)
    rows = docs.select(F.col(text).alias("_q_text")).where(F.rand(11) * n < sample_rows)
    rows = measure(rows, {x for r in rules for x in r.needs} | {"n_words", "n_lines"})
    mask = sum((F.when(F.expr(r.reject), F.lit(1 << k)).otherwise(F.lit(0)) for k, r in enumerate(rules)), F.lit(0))
    groups = rows.groupBy(mask.alias("mask")).agg(  # at most 2 ** len(rules) rows
        F.count("*").alias("rows"), F.sum(F.coalesce(F.length("_q_text"), F.lit(0))).alias("chars"), F.sum("n_words").alias("words"), F.sum("n_lines").alias("lines")).collect()
    order, there = [], set(_with_needs(computed))
    while len(order) < len(rules):
        units = [sum(g[c] for g in groups) for c in ("chars", "words", "lines")]

        def worth(k: int) -> float:
            new = set(_with_needs(rules[k].needs)) - there
            cost = 1.0 + sum(a * b for m in new for a, b in zip(COST[m], units))
            return (0.5 + sum(g["rows"] for g in groups if g["mask"] >> k & 1)) / cost

        best = max((k for k in range(len(rules)) if rules[k] not in order), key=worth)
        order.append(rules[best])
        there |= set(_with_needs(rules[best].needs))
        groups = [g for g in groups if not g["mask"] >> best & 1]
    return order


def some_files(docs: DataFrame, most: int = 8) -> DataFrame:
    """The rows of at most `most` files of a Parquet table, chosen by their names' hashes; of what is no such table, all rows."""
    files = sorted(docs.inputFiles(), key=lambda f: (zlib.crc32(f.rsplit("/", 1)[-1].encode()), f))[:most]
    return docs.sparkSession.read.schema(docs.schema).parquet(*files) if files else docs


def quality_rules(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None, columns: tuple[str, ...] = (), sample: DataFrame | None = None) -> DataFrame:
    """docs with `failed_rule` (the first rule in cascade order that rejects, or null), `kept`, and the measures in `columns`.

    sample: rows to estimate the order of the rules on, where docs itself shouldn't be read for that.
    """
    order = order_rules(docs if sample is None else sample, text, computed=columns) if rules is None else rules
    keep = [c for c in docs.columns if c not in ("failed_rule", "kept", *columns)]
    # the row travels as one struct, so that its columns and the measures can have equal names
    df = docs.select(F.struct(*(F.col(c) for c in keep)).alias("_q_row"), F.col(text).alias("_q_text"))
    df, there, failed, measures = measure(df, columns), set(_with_needs(columns)), F.lit(None).cast("string"), _measures()
    for k, r in enumerate(order):
        for name in _with_needs(r.needs):
            if name not in there:  # only for rows that no rule before this one rejects
                df = df.withColumn(name, F.when(failed.isNull(), measures[name]))
                there.add(name)
        df = df.withColumn(f"_q_failed_{k}", F.when(failed.isNotNull(), failed).when(F.expr(r.reject), F.lit(r.name)))
        failed = F.col(f"_q_failed_{k}")
    return df.select(*(F.col("_q_row")[c].alias(c) for c in keep), *columns, failed.alias("failed_rule"), failed.isNull().alias("kept"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality_rules(docs, columns=("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), sample=some_files(docs))
    base = F.expr(" or ".join(f"({r.reject})" for r in BASE))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      base.alias("base_failed"), (F.col("kept") & ~base).alias("kept"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS rid,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (
  SELECT rid, i, array_to_string(list_slice(w, i, i + 7), ' ') AS gram
  FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
r AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, gram) > 1),
c AS (SELECT rid, sum(least(8, coalesce(nx - i, 8))) AS n FROM
        (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nx FROM r) GROUP BY rid),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper,
         length(regexp_replace(t, '\P{L}', '', 'g')) AS n_letters,
         len(l) AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN c USING (rid)),
b AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR word_chars > 12 * n_words OR word_chars < 2 * n_words OR 10 * n_symbols > n_words
            OR 10 * n_dup_lines > 3 * n_lines OR 2 * n_upper > word_chars OR 2 * n_letters < word_chars) AS kept
FROM b
"""
