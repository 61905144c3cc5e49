"""Registered queries of the document operators over the driver's tables, with their SQL.

The tables hold no PDFs, so rectangles, components, words and actions are derived from rows by integer arithmetic that both
engines do alike. `dangerous_actions`, `channel_median` and `flat_image` are checked here alone: files go through the walk of `sources.pdf`,
the median of `functions.pixels` and the judgement of `operators.audit`, which state the same rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bytes_ops as b
from ..functions import geometry as g
from ..operators import actions, audit, jobs, raster, revisions, tiles, vector
from ..settings import Settings
from . import file_queries, history_queries


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- relations derived from rows --------------------------------------------------------------------------------------------


def _orders_as_drawings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    x0, y0 = (k * 37) % 600, (k * 53) % 780
    tenth = ((k * 7) % 10) / F.lit(10.0)
    return _t(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("doc_id"), (k % 3).cast("int").alias("page_number"), k.alias("seq"),
        g.rect(x0, y0, x0 + 1 + (k * 11) % 400, y0 + 1 + (k * 13) % 500).alias("rect"), F.array(tenth, tenth, tenth).alias("fill"),
        (((k * 3) % 21) / F.lit(20.0)).alias("fill_opacity"))


def _pages_of(drawings: DataFrame) -> DataFrame:
    page = g.rect(*map(F.lit, (0, 0, 612, 792)))
    return drawings.select("doc_id", "page_number").distinct().withColumn("page_rect", page)


def _orders_as_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    i = lambda c: c.cast("int")
    return _t(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("doc_id"), k.alias("seq"), i((k * 37) % 1000).alias("x"), i((k * 53) % 800).alias("y"),
        i(1 + (k * 11) % 600).alias("w"), i(1 + (k * 13) % 500).alias("h"), F.lit(1000).alias("img_w"), F.lit(800).alias("img_h"),
        ((k * 7) % 100).cast("double").alias("mean_intensity"))


def _document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("page_number"), "text")


def _words_of(pages: DataFrame) -> DataFrame:
    """The words of pages' texts, ten a line."""
    n = F.col("word_seq")
    x0, y0 = (n % 10) * 60, F.floor(n / 10) * 12
    return pages.select("*", F.posexplode(F.split("text", " ")).alias("word_seq", "word")).drop("text").withColumn("rect", g.rect(x0, y0, x0 + 55, y0 + 10))


def _document_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of three sources: a vector box for each document, an image for every second, an annotation for every fifth."""
    d = F.col("doc_id")
    docs = _t(spark, sf_dir, "documents").select("doc_id")
    box = lambda dx, dy: g.rect((d * 37 + dx) % 400, (d * 53 + dy) % 500, (d * 37 + dx) % 400 + 150, (d * 53 + dy) % 500 + 80)
    one = lambda source, when, dx, dy: docs.where(when).select(
        "doc_id", F.lit(0).alias("page_number"), F.lit(0).alias("seq"), box(dx, dy).alias("rect"), F.lit(source).alias("source"))
    return (one(audit.VECTOR, F.lit(True), 0, 0).unionByName(one(audit.IMAGE, d % 2 == 0, 100, 50))
            .unionByName(one(audit.ANNOTATION, d % 5 == 0, 0, 0)))


def _document_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))


# ---- A: guards, kinds, tokens, actions ----------------------------------------------------------------------------------------

LIMIT = 2000


def size_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    length = F.octet_length(F.encode("text", "UTF-8"))
    return _t(spark, sf_dir, "documents").select(
        "doc_id", length.cast("long").alias("length"), b.size_error(length, Settings(max_upload_bytes=LIMIT)).alias("error"))


def magic_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 6
    case = F
    for i, (prefix, _) in enumerate(b.MAGIC):
        case = case.when(k == i, F.lit(prefix))
    content = F.unhex(F.concat(case.otherwise("00255044462D"), F.hex("p_name")))
    return _t(spark, sf_dir, "part").select("p_partkey", b.kind_of(content).alias("kind"))


_PAGE_TOKENS = ("<script", "<nav", "href=", "/Launch", "</p>", r"/JS\b", r"cookie\b", "zzz")


def token_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.when(F.col("page_id") % 3 == 0, F.concat("html", F.lit("/JS("))).when(F.col("page_id") % 3 == 1, F.concat("html", F.lit("/JSON"))).otherwise(F.col("html"))
    hits = b.forbidden_tokens(b.latin1(F.encode(page, "UTF-8")), _PAGE_TOKENS)
    return _t(spark, sf_dir, "pages").select("page_id", F.array_join(hits, ",").alias("tokens"), b.token_error(hits).alias("error"))


def action_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    names = F.array(*map(F.lit, ("GoTo", "JavaScript", "Named", "Launch", "URI", "SubmitForm", "Thread")))
    rows = _t(spark, sf_dir, "orders").select(
        (k % 11).alias("doc_id"), k.alias("action_id"), F.when(k >= 22, F.floor(k / 22) * 11 + k % 11).alias("parent_id"),
        F.element_at(names, ((k * 5) % 7 + 1).cast("int")).alias("subtype"))
    found = actions.dangerous_actions(rows)
    return found.select("doc_id", F.array_join("subtypes", ",").alias("subtypes"), actions.error(F.col("subtypes")).alias("error"))


# ---- B: vector borders ----------------------------------------------------------------------------------------------------------


def border_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _orders_as_drawings(spark, sf_dir)
    return vector.border_shapes(d, _pages_of(d)).select(
        "doc_id", "page_number", "seq", F.col("rect.x0").alias("x0"), F.col("rect.y0").alias("y0"), F.col("rect.x1").alias("x1"),
        F.col("rect.y1").alias("y1"), "opacity", "reason")


def pages_flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _orders_as_drawings(spark, sf_dir)
    return vector.pages_flagged(vector.border_shapes(d, _pages_of(d)))


def background_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _orders_as_drawings(spark, sf_dir)
    p = _pages_of(d)
    return vector.background_colors(vector.border_shapes(d, p), d, p).select("doc_id", "page_number", F.col("background")[0].alias("gray"))


def winding_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygons of five points from each order, some with a second one inside, and how they wind around the centre of a page."""
    k = F.col("o_orderkey")
    point = lambda i: [((k * (37 + i)) % 612).cast("double"), ((k * (53 + 7 * i)) % 792).cast("double")]
    corner = [point(i) for i in range(5)]
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", (k % 2 == 0).alias("even_odd"), F.array(*(v for i in range(5) for v in (*corner[i], *corner[(i + 1) % 5]))).alias("path"))
    turns = g.winding(F.col("path"), F.lit(306.0), F.lit(396.0))
    return rows.select("o_orderkey", turns.alias("winding"), g.inside(F.col("path"), F.col("even_odd"), F.lit(306.0), F.lit(396.0)).alias("covers"))


# ---- C: raster borders ----------------------------------------------------------------------------------------------------------


def raster_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _orders_as_components(spark, sf_dir)
    side = raster.side_of(*(F.col(x) for x in ("x", "y", "w", "h", "img_w", "img_h")))
    return c.groupBy(side.alias("side")).agg(F.count("*").alias("n"))


def raster_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.border_components(_orders_as_components(spark, sf_dir)).select("doc_id", "seq", "side", "x", "y", "w", "h")


def raster_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.merge_by_side(raster.border_components(_orders_as_components(spark, sf_dir)))


def tile_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as masks of eight columns, a pixel for each positive number, cut into four tiles that share lines; boxes of the components."""
    rows = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", F.floor(F.size("embedding") / 8).cast("int").alias("height"))
    corner = F.explode(F.array(*(F.struct(F.lit(2 * a + b).alias("tile"), F.lit(4 * a).alias("y"), F.lit(4 * b).alias("x")) for a in (0, 1) for b in (0, 1))))
    cut = rows.select("*", corner.alias("t")).select("doc_id", "embedding", "height", "t.*")
    size = {"rows": F.when(F.col("y") > 0, F.col("height") - 4).otherwise(5), "columns": F.when(F.col("x") > 0, 4).otherwise(5), "width": F.lit(8)}
    bit = lambda i: F.when(F.get("embedding", (F.col("y") + F.floor(i / F.col("columns"))) * 8 + F.col("x") + i % F.col("columns")) > 0, "01").otherwise("00")
    cut = cut.withColumns({k: v.cast("int") for k, v in size.items()})
    mask = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.col("rows") * F.col("columns") - 1), bit), ""))
    return tiles.boxes(cut.select("doc_id", "tile", "y", "x", "height", "width", "rows", "columns", mask.alias("mask")), outer=False)


def channel_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.channel_median(_t(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity")


# ---- D: redaction audit ---------------------------------------------------------------------------------------------------------


def area_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _orders_as_drawings(spark, sf_dir)
    page = g.rect(*map(F.lit, (0, 0, 612, 792)))
    return d.select("seq", g.area_qualifies(F.col("rect"), page, 0.05, 0.3).alias("qualifies"))


def audit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _orders_as_drawings(spark, sf_dir)
    return audit.vector_candidates(d, _pages_of(d)).select("doc_id", "page_number", "seq", "source")


def flat_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variance and mean of samples, as of an image's pixels, and the verdict of the flat-colour rule with scaled limits."""
    samples = _t(spark, sf_dir, "embeddings").select("vec_id", F.explode("embedding").alias("v"))
    per = samples.groupBy("vec_id").agg(F.var_pop(F.col("v").cast("double")).alias("variance"), F.avg(F.col("v").cast("double")).alias("mean"))
    return per.select("vec_id", F.round(F.col("variance") * 1_000_000).cast("long").alias("variance_millionths"),
                      ((F.round(F.col("variance") * 1_000_000) <= 15_000) & (F.round(F.col("mean") * 1_000_000) <= 5_000)).alias("flat"))


def text_under_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _document_boxes(spark, sf_dir).where(F.col("source") == audit.VECTOR)
    return audit.text_under(boxes, _document_pages(spark, sf_dir), _words_of).select("doc_id", "word_count", "char_count")


_DEDUPE = (60.0, 60.0, 300.0, 300.0)


def tolerance_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _orders_as_drawings(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "rect"))).alias("items"))
    kept = g.tolerance_dedupe(F.col("items"), _DEDUPE, f"struct<seq:bigint,rect:{g.RECT}>")
    return items.select("doc_id", F.array_join(F.transform(kept, lambda x: x["seq"].cast("string")), ",").alias("kept"))


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.findings(_document_boxes(spark, sf_dir), _document_pages(spark, sf_dir), spread=_words_of)


def audit_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).select("doc_id", "page_number", "source", "risk_level", "underlying_word_count", "underlying_char_count", "note")


def audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _t(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("page_number"))
    return audit.report(_found(spark, sf_dir), pages)


# ---- E: revisions ---------------------------------------------------------------------------------------------------------------


def _bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full stops of the texts stand for the boundaries of files."""
    files = _document_bytes(spark, sf_dir)
    return files.select("doc_id", F.octet_length("content").cast("long").alias("length"), b.boundary_offsets(b.latin1(F.col("content")), r"\.").alias("offsets"))


def revision_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisions.revisions(_bounds(spark, sf_dir), Settings(forensics_max_revisions_reported=200))


def _parsed(revs: DataFrame) -> DataFrame:
    i = F.col("revision_index")
    return revs.withColumns({"openable": (F.col("doc_id") + i) % 3 != 0, "page_count": ((F.col("doc_id") * 7 + i) % 9).cast("int")})


def revision_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = _bounds(spark, sf_dir)
    return revisions.report(_parsed(revisions.revisions(bounds)), bounds)


def prefix_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    revs = revisions.revisions(_bounds(spark, sf_dir))
    return revs.join(_document_bytes(spark, sf_dir), "doc_id").select(
        "doc_id", "revision_index", F.md5(F.substring("content", F.lit(1), F.col("boundary_end_offset").cast("int"))).alias("digest"))


# ---- F, G: jobs and payloads ----------------------------------------------------------------------------------------------------


def job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = jobs.latest(_t(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")
    state = F.element_at(F.array(*map(F.lit, ("PENDING", "STARTED", "SUCCESS", "FAILURE", "RETRY", "SUCCESS"))), (F.col("user_id") % 6 + 1).cast("int"))
    return last.select("user_id", "event_type", jobs.status_of(state, F.col("user_id") % 4 == 0).alias("status"))


def _now(events: DataFrame) -> DataFrame:
    return events.agg(F.max("ts").alias("now"))


def ttl_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _t(spark, sf_dir, "events")
    return jobs.alive(ev.crossJoin(F.broadcast(_now(ev))), "ts", F.col("now"), Settings(job_ttl_seconds=86_400)).select("event_id", "user_id")


def one_time_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of users who read none."""
    ev = _t(spark, sf_dir, "events")
    return jobs.unread(ev.select("event_id", "user_id"), ev.where("event_type = 'purchase'"), "user_id")


_LIMITS = Settings(processing_timeout_seconds=150_000, processing_grace_seconds=60_000, job_ttl_seconds=400_000)


def job_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as the events of their jobs, four a user and week; limits of days instead of seconds."""
    ev = _t(spark, sf_dir, "events").withColumn("us", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"))  # whatever the zone
    job = F.concat_ws("-", "user_id", F.expr("us div 604800000000"), F.col("event_id") % 4)
    kind = F.element_at(F.array(*map(F.lit, jobs.KINDS)), (F.floor(F.col("event_id") / 4) % 5 + 1).cast("int"))
    out = jobs.lifecycle(ev.select(job.alias("job_id"), F.timestamp_micros("us").alias("at"), kind.alias("kind"), F.col("event_type").alias("error")), settings=_LIMITS)
    return out.select("job_id", "state", F.unix_micros("since").alias("since"), "error", jobs.reported(F.col("state")).alias("status"))


def payload_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = b.base64_plain(F.encode("text", "UTF-8"))
    return _t(spark, sf_dir, "documents").select(
        "doc_id", F.md5(coded).alias("digest"), F.length(coded).cast("long").alias("n"),
        (F.unbase64(coded) == F.encode("text", "UTF-8")).alias("same"))


def document_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first error of each file, in the order of the guards, and the number of its boundaries."""
    files = _document_bytes(spark, sf_dir)
    text = b.latin1(F.col("content"))
    hits = b.forbidden_tokens(text, ("zz", r"the\b", "Licensed"))
    error = F.coalesce(b.size_error(F.octet_length("content"), Settings(max_upload_bytes=20_000)), b.token_error(hits))
    return files.select("doc_id", error.alias("error"), F.size(b.boundary_offsets(text, r"\.")).cast("int").alias("boundaries"))


QUERIES = {f.__name__: f for f in (
    document_screen, size_guard, magic_sniff, token_scan, action_chain, border_shapes, pages_flagged, background_color, winding_number, raster_sides,
    raster_bars, raster_merge, tile_components, channel_median, area_gate, audit_vectors, flat_image, text_under_box, tolerance_dedupe, audit_findings,
    audit_report, revision_offsets, revision_report, prefix_slice, job_status, ttl_filter, one_time_read, job_lifecycle, payload_roundtrip)} | file_queries.QUERIES | history_queries.QUERIES

# ---- SQL ------------------------------------------------------------------------------------------------------------------------

_DRAWINGS = """
d AS (SELECT o_custkey AS doc_id, (o_orderkey % 3)::INT AS page_number, o_orderkey AS seq, (o_orderkey * 37) % 600 AS x0,
             (o_orderkey * 53) % 780 AS y0, (o_orderkey * 37) % 600 + 1 + (o_orderkey * 11) % 400 AS x1,
             (o_orderkey * 53) % 780 + 1 + (o_orderkey * 13) % 500 AS y1, ((o_orderkey * 7) % 10) / 10.0::DOUBLE AS gray,
             ((o_orderkey * 3) % 21) / 20.0::DOUBLE AS opacity FROM orders)"""
_SHAPES = f"""{_DRAWINGS},
s AS (SELECT * FROM d WHERE opacity >= 0.85 AND 0.299::DOUBLE * gray + 0.587::DOUBLE * gray + 0.114::DOUBLE * gray <= 0.25
      AND (x0 <= 612 * 0.12 OR x1 >= 612 - 612 * 0.12 OR y0 <= 792 * 0.12 OR y1 >= 792 - 792 * 0.12)
      AND (100 * (x1 - x0) >= 55 * 612 OR 100 * (y1 - y0) >= 55 * 792))"""
_COMPONENTS = """
c AS (SELECT o_custkey AS doc_id, o_orderkey AS seq, ((o_orderkey * 37) % 1000)::INT AS x, ((o_orderkey * 53) % 800)::INT AS y,
             (1 + (o_orderkey * 11) % 600)::INT AS w, (1 + (o_orderkey * 13) % 500)::INT AS h, (o_orderkey * 7) % 100 AS m FROM orders),
e AS (SELECT *, CASE WHEN x <= 30 THEN 'left' WHEN x + w >= 970 THEN 'right' WHEN y <= 24 THEN 'top' WHEN y + h >= 776 THEN 'bottom'
                     ELSE 'interior' END AS side FROM c),
f AS (SELECT * FROM e WHERE side <> 'interior' AND m <= 60 AND CASE WHEN side IN ('left', 'right') THEN 2 * h >= 800 AND 100 * w <= 22 * 1000
                     ELSE 2 * w >= 1000 AND 100 * h <= 22 * 800 END)"""
_WORDS = """
w AS (SELECT doc_id, n, word, (n % 10) * 60 AS x0, (n // 10) * 12 AS y0 FROM (
        SELECT doc_id, unnest(string_split(text, ' ')) AS word, unnest(range(0, len(string_split(text, ' ')))) AS n FROM documents)),
b AS (SELECT doc_id, 'vector_fill' AS source, (doc_id * 37) % 400 AS x0, (doc_id * 53) % 500 AS y0 FROM documents
      UNION ALL SELECT doc_id, 'image_overlay', (doc_id * 37 + 100) % 400, (doc_id * 53 + 50) % 500 FROM documents WHERE doc_id % 2 = 0
      UNION ALL SELECT doc_id, 'unapplied_redact_annotation', (doc_id * 37) % 400, (doc_id * 53) % 500 FROM documents WHERE doc_id % 5 = 0),
u AS (SELECT b.doc_id, b.source, count(w.n) AS words, coalesce(length(string_agg(word, ' ' ORDER BY n)), 0) AS chars
      FROM b LEFT JOIN w ON b.doc_id = w.doc_id AND b.x0 < w.x0 + 55 AND b.x0 + 150 > w.x0 AND b.y0 < w.y0 + 10 AND b.y0 + 80 > w.y0
      GROUP BY b.doc_id, b.source)"""
_q = lambda s: s.replace("'", "''")
_FINDINGS = f"""{_WORDS},
f AS (SELECT doc_id, 0 AS page_number, source,
        CASE WHEN source = 'unapplied_redact_annotation' OR chars > 0 THEN 'critical' ELSE 'clear' END AS risk_level,
        CASE WHEN source = 'unapplied_redact_annotation' OR chars > 0 THEN words ELSE 0 END::INT AS underlying_word_count,
        CASE WHEN source = 'unapplied_redact_annotation' OR chars > 0 THEN chars ELSE 0 END::INT AS underlying_char_count,
        CASE WHEN source = 'unapplied_redact_annotation' THEN '{_q(audit.NOTE_ANNOTATION)}' WHEN chars > 0 THEN '{_q(audit.NOTE_CRITICAL)}'
             ELSE '{_q(audit.NOTE_CLEAR)}' END AS note FROM u)"""
_BOUNDS = """
x AS (SELECT doc_id, octet_length(encode(text)) AS length, string_split(text, '.') AS parts FROM documents),
p AS (SELECT doc_id, length, unnest(parts[1:len(parts) - 1]) AS part, unnest(range(1, len(parts))) AS i FROM x WHERE len(parts) > 1),
r AS (SELECT doc_id, length, i::INT AS i, sum(octet_length(encode(part)) + 1) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS pos FROM p
      QUALIFY i <= 200)"""

ORACLES = {
    "document_screen": r"""
        SELECT doc_id, CASE WHEN n = 0 THEN 'Empty file.' WHEN n > 20000 THEN 'File exceeds maximum allowed size of 20000 bytes.'
                 WHEN len(h) > 0 THEN 'Document rejected: contains disallowed active content (' || array_to_string(h, ', ') || ').' END AS error,
               least(len(string_split(text, '.')) - 1, 200)::INT AS boundaries
        FROM (SELECT doc_id, text, octet_length(encode(text)) AS n, list_sort(list_filter([
                CASE WHEN contains(text, 'zz') THEN 'zz' END, CASE WHEN regexp_matches(text, 'the\b') THEN 'the\b' END,
                CASE WHEN contains(text, 'Licensed') THEN 'Licensed' END], lambda x: x IS NOT NULL)) AS h FROM documents)""",
    "size_guard": f"""
        SELECT doc_id, octet_length(encode(text))::BIGINT AS length, CASE WHEN text = '' THEN 'Empty file.'
               WHEN octet_length(encode(text)) > {LIMIT} THEN 'File exceeds maximum allowed size of {LIMIT} bytes.' END AS error FROM documents""",
    "magic_sniff": "SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN 'pdf' WHEN p_partkey % 6 < 5 THEN 'raster_image' END AS kind FROM part",
    "token_scan": r"""
        SELECT page_id, array_to_string(h, ',') AS tokens, CASE WHEN len(h) > 0 THEN 'Document rejected: contains disallowed active content ('
               || array_to_string(h, ', ') || ').' END AS error
        FROM (SELECT page_id, list_sort(list_filter([
                CASE WHEN contains(html, '<script') THEN '<script' END, CASE WHEN contains(html, '<nav') THEN '<nav' END,
                CASE WHEN contains(html, 'href=') THEN 'href=' END, CASE WHEN contains(html, '/Launch') THEN '/Launch' END,
                CASE WHEN contains(html, '</p>') THEN '</p>' END, CASE WHEN regexp_matches(html, '/JS\b') THEN '/JS\b' END,
                CASE WHEN regexp_matches(html, 'cookie\b') THEN 'cookie\b' END, CASE WHEN contains(html, 'zzz') THEN 'zzz' END],
                lambda x: x IS NOT NULL)) AS h
              FROM (SELECT page_id, html || CASE page_id % 3 WHEN 0 THEN '/JS(' WHEN 1 THEN '/JSON' ELSE '' END AS html FROM pages))""",
    "action_chain": """
        WITH RECURSIVE a AS (
          SELECT o_orderkey % 11 AS doc_id, o_orderkey AS id, CASE WHEN o_orderkey >= 22 THEN (o_orderkey // 22) * 11 + o_orderkey % 11 END AS parent,
                 (['GoTo', 'JavaScript', 'Named', 'Launch', 'URI', 'SubmitForm', 'Thread'])[(o_orderkey * 5) % 7 + 1] AS subtype FROM orders),
        c(doc_id, id, subtype, depth) AS (
          SELECT doc_id, id, subtype, 0 FROM a WHERE parent IS NULL
          UNION ALL SELECT a.doc_id, a.id, a.subtype, depth + 1 FROM c JOIN a ON a.doc_id = c.doc_id AND a.parent = c.id WHERE depth < 25),
        s AS (SELECT doc_id, string_agg(DISTINCT subtype, ',' ORDER BY subtype) AS t FROM c
              WHERE subtype IN ('JavaScript', 'Launch', 'SubmitForm', 'ImportData', 'GoToR', 'GoToE') GROUP BY doc_id)
        SELECT doc_id, t AS subtypes, 'Document rejected: an additional-actions (/AA) trigger references disallowed action type(s) ('
               || replace(t, ',', ', ') || ').' AS error FROM s""",
    "border_shapes": f"""WITH {_SHAPES} SELECT doc_id, page_number, seq, x0::DOUBLE AS x0, y0::DOUBLE AS y0, x1::DOUBLE AS x1, y1::DOUBLE AS y1,
        opacity, '{vector.REASON}' AS reason FROM s""",
    "pages_flagged": f"WITH {_SHAPES} SELECT doc_id, count(DISTINCT page_number) AS pages_flagged FROM s GROUP BY doc_id",
    "background_color": f"""WITH {_SHAPES},
        p AS (SELECT doc_id, page_number, bool_or(x0 <= 306 AND 306 < x1 AND y0 <= 396 AND 396 < y1) AS hidden FROM s GROUP BY 1, 2),
        t AS (SELECT doc_id, page_number, arg_max(gray, seq) AS gray FROM d WHERE x0 <= 306 AND 306 < x1 AND y0 <= 396 AND 396 < y1 GROUP BY 1, 2)
        SELECT p.doc_id, p.page_number, CASE WHEN hidden THEN 1.0 ELSE coalesce(gray, 1.0) END::DOUBLE AS gray FROM p LEFT JOIN t USING (doc_id, page_number)""",
    "winding_number": """
        WITH p AS (SELECT o_orderkey, unnest([0, 1, 2, 3, 4]) AS i FROM orders),
        s AS (SELECT o_orderkey, (o_orderkey * (37 + i)) % 612 AS x0, (o_orderkey * (53 + 7 * i)) % 792 AS y0,
                     (o_orderkey * (37 + (i + 1) % 5)) % 612 AS x1, (o_orderkey * (53 + 7 * ((i + 1) % 5))) % 792 AS y1 FROM p),
        w AS (SELECT o_orderkey, sum(CASE WHEN y0 <= 396 AND 396 < y1 AND 306 < x0 + (396 - y0)::DOUBLE * (x1 - x0) / (y1 - y0) THEN 1
                     WHEN y1 <= 396 AND 396 < y0 AND 306 < x0 + (396 - y0)::DOUBLE * (x1 - x0) / (y1 - y0) THEN -1 ELSE 0 END)::INT AS winding FROM s GROUP BY 1)
        SELECT o_orderkey, winding, CASE WHEN o_orderkey % 2 = 0 THEN winding % 2 <> 0 ELSE winding <> 0 END AS covers FROM w""",
    "raster_sides": f"WITH {_COMPONENTS} SELECT side, count(*) AS n FROM e GROUP BY side",
    "raster_bars": f"WITH {_COMPONENTS} SELECT doc_id, seq, side, x, y, w, h FROM f",
    "raster_merge": f"""WITH {_COMPONENTS}
        SELECT doc_id, CASE WHEN side = 'right' THEN min(x) ELSE 0 END::INT AS x, CASE WHEN side = 'bottom' THEN min(y) ELSE 0 END::INT AS y,
               CASE side WHEN 'left' THEN max(x + w) WHEN 'right' THEN 1000 - min(x) ELSE 1000 END::INT AS w,
               CASE side WHEN 'top' THEN max(y + h) WHEN 'bottom' THEN 800 - min(y) ELSE 800 END::INT AS h, side, avg(m) AS mean_intensity,
               list_position(['left', 'right', 'top', 'bottom'], side)::INT AS side_order FROM f GROUP BY doc_id, side""",
    "tile_components": """
        WITH RECURSIVE c AS (SELECT vec_id AS doc_id, i // 8 AS y, i % 8 AS x FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(0, len(embedding))) AS i FROM embeddings) WHERE v > 0),
        r(doc_id, y, x, v, u) AS (SELECT doc_id, y, x, y, x FROM c
          UNION SELECT r.doc_id, r.y, r.x, c.y, c.x FROM r JOIN c ON c.doc_id = r.doc_id AND abs(c.y - r.v) <= 1 AND abs(c.x - r.u) <= 1),
        f AS (SELECT doc_id, y, x, min(v * 8 + u) AS part FROM r GROUP BY ALL)
        SELECT doc_id, min(x)::INT AS x, min(y)::INT AS y, (max(x) - min(x) + 1)::INT AS w, (max(y) - min(y) + 1)::INT AS h FROM f GROUP BY doc_id, part""",
    "channel_median": "SELECT l_returnflag, l_linestatus, floor(median(l_quantity))::BIGINT AS median FROM lineitem GROUP BY 1, 2",
    "area_gate": f"""WITH {_DRAWINGS} SELECT seq, 100 * (x1 - x0) * (y1 - y0) BETWEEN 5 * 612 * 792 AND 30 * 612 * 792 AS qualifies FROM d""",
    "audit_vectors": f"""WITH {_DRAWINGS} SELECT doc_id, page_number, seq, 'vector_fill' AS source FROM d
        WHERE (opacity = 0 OR opacity >= 0.85) AND 0.299::DOUBLE * gray + 0.587::DOUBLE * gray + 0.114::DOUBLE * gray <= 0.3
          AND 10000 * (x1 - x0) * (y1 - y0) BETWEEN 8::BIGINT * 612 * 792 AND 8500::BIGINT * 612 * 792""",
    "flat_image": """
        SELECT vec_id, round(v * 1000000)::BIGINT AS variance_millionths, round(v * 1000000) <= 15000 AND round(m * 1000000) <= 5000 AS flat
        FROM (SELECT vec_id, var_pop(x::DOUBLE) AS v, avg(x::DOUBLE) AS m FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) GROUP BY vec_id)""",
    "text_under_box": f"""WITH {_WORDS} SELECT doc_id, words::INT AS word_count, chars::INT AS char_count FROM u WHERE source = 'vector_fill'""",
    "tolerance_dedupe": f"""WITH RECURSIVE {_DRAWINGS},
        n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS i FROM d),
        k(doc_id, i, kept) AS (
          SELECT doc_id, 0::BIGINT, []::STRUCT(seq BIGINT, x0 BIGINT, y0 BIGINT, x1 BIGINT, y1 BIGINT)[] FROM n WHERE i = 1
          UNION ALL
          SELECT k.doc_id, n.i, CASE WHEN len(list_filter(k.kept, lambda z: abs(z.x0 - n.x0) < 60 AND abs(z.y0 - n.y0) < 60 AND abs(z.x1 - n.x1) < 300
                   AND abs(z.y1 - n.y1) < 300)) > 0 THEN k.kept
                 ELSE list_append(k.kept, {{'seq': n.seq, 'x0': n.x0, 'y0': n.y0, 'x1': n.x1, 'y1': n.y1}}) END
          FROM k JOIN n ON n.doc_id = k.doc_id AND n.i = k.i + 1)
        SELECT doc_id, array_to_string(list_transform(arg_max(kept, i), lambda z: z.seq::VARCHAR), ',') AS kept FROM k GROUP BY doc_id""",
    "audit_findings": f"WITH {_FINDINGS} SELECT * FROM f",
    "audit_report": f"""WITH {_FINDINGS},
        c AS (SELECT doc_id, count(*) AS n, count_if(risk_level = 'critical') AS bad FROM f GROUP BY doc_id)
        SELECT doc_id, n::INT AS total_boxes_found, bad::INT AS critical_count, (n - bad)::INT AS clear_count, 0::INT AS unknown_count, 1::INT AS pages_audited,
          CASE WHEN bad > 0 THEN replace('{_q(audit.SUMMARY_CRITICAL)}', '%d', bad::VARCHAR) WHEN n > 0 THEN replace('{_q(audit.SUMMARY_CLEAR)}', '%d', n::VARCHAR)
               ELSE '{_q(audit.SUMMARY_NONE)}' END AS summary FROM c""",
    "revision_offsets": f"""WITH {_BOUNDS} SELECT doc_id, i AS revision_index, pos AS boundary_end_offset, pos AS size_bytes, pos >= length - 1 AS is_current FROM r""",
    "revision_report": f"""WITH {_BOUNDS},
        v AS (SELECT *, (doc_id + i) % 3 <> 0 AS opens, ((doc_id * 7 + i) % 9)::INT AS pages, pos >= length - 1 AS cur FROM r WHERE i <= 50),
        s AS (SELECT doc_id, count(*) AS n, count_if(opens) AS o, count_if(opens AND NOT cur) AS prior, arg_max(pages, i) FILTER (WHERE opens AND cur) AS pages
              FROM v GROUP BY doc_id),
        t AS (SELECT doc_id, count(*) AS found FROM r GROUP BY doc_id)
        SELECT documents.doc_id, coalesce(n, 0)::INT AS total_revisions_found, pages AS pages_in_current_revision,
          CASE WHEN prior > 0 THEN replace('{_q(revisions.SUMMARY_PRIOR)}', '%d', prior::VARCHAR) WHEN coalesce(o, 0) <= 1 THEN '{_q(revisions.SUMMARY_NONE)}'
               ELSE replace('{_q(revisions.SUMMARY_UNPARSED)}', '%d', o::VARCHAR) END AS summary,
          coalesce(found, 0) >= 200 OR coalesce(n, 0) >= 50 AS truncated
        FROM documents LEFT JOIN s USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "prefix_slice": f"""WITH {_BOUNDS},
        o AS (SELECT doc_id, i, sum(length(part) + 1) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS chars FROM p QUALIFY i <= 50)
        SELECT doc_id, i::INT AS revision_index, md5(substr(text, 1, chars)) AS digest FROM o JOIN documents USING (doc_id)""",
    "job_status": """
        SELECT user_id, arg_max(event_type, row(ts, event_id)) AS event_type, CASE user_id % 6 WHEN 1 THEN 'processing' WHEN 3 THEN 'failed'
               WHEN 2 THEN CASE WHEN user_id % 4 = 0 THEN 'failed' ELSE 'complete' END WHEN 5 THEN CASE WHEN user_id % 4 = 0 THEN 'failed' ELSE 'complete' END
               ELSE 'queued' END AS status FROM events GROUP BY user_id""",
    "ttl_filter": "SELECT event_id, user_id FROM events WHERE ts + INTERVAL 86400 SECOND > (SELECT max(ts) FROM events)",
    "one_time_read": "SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND user_id IS NOT NULL)",
    "job_lifecycle": f"""
        WITH e AS (SELECT user_id || '-' || (epoch_us(ts) // 604800000000) || '-' || event_id % 4 AS job_id, epoch_us(ts) AS t,
                          (['submit', 'start', 'fail', 'finish', 'read'])[event_id // 4 % 5 + 1] AS kind, event_type AS error FROM events),
        q AS (SELECT job_id, min(t) AS submitted FROM e WHERE kind = 'submit' GROUP BY 1),
        s AS (SELECT job_id, min(t) AS started FROM e JOIN q USING (job_id) WHERE kind = 'start' AND t >= submitted GROUP BY 1),
        d AS (SELECT job_id, min(t) AS ended, arg_min(kind, row(t, kind)) AS how, arg_min(error, row(t, kind)) AS error FROM e JOIN s USING (job_id)
              WHERE kind IN ('finish', 'fail') AND t >= started GROUP BY 1),
        l AS (SELECT *, started + {_LIMITS.processing_timeout_seconds}000000 AS soft, started + {_LIMITS.processing_timeout_seconds + _LIMITS.processing_grace_seconds}000000 AS hard,
                     (SELECT max(t) FROM e) AS now FROM q LEFT JOIN s USING (job_id) LEFT JOIN d USING (job_id)),
        x AS (SELECT *, CASE WHEN ended < hard THEN ended WHEN hard <= now THEN hard END AS done,
                     CASE WHEN ended < soft AND how = 'finish' THEN 'complete' ELSE 'failed' END AS outcome,
                     CASE WHEN ended < soft THEN error WHEN ended < hard THEN '{jobs.ERROR_LIMIT}' ELSE '{jobs.ERROR_INTERNAL}' END AS why FROM l),
        r AS (SELECT job_id, min(t) AS read FROM e JOIN x USING (job_id)
              WHERE kind = 'read' AND outcome = 'complete' AND t >= done AND t < done + {_LIMITS.job_ttl_seconds}000000 GROUP BY 1),
        y AS (SELECT *, CASE WHEN read IS NOT NULL THEN 'read' WHEN done + {_LIMITS.job_ttl_seconds}000000 <= now THEN 'expired' WHEN done IS NOT NULL THEN outcome
                     WHEN soft <= now THEN 'stopping' WHEN started IS NOT NULL THEN 'processing' ELSE 'queued' END AS state FROM x LEFT JOIN r USING (job_id))
        SELECT job_id, state, CASE state WHEN 'read' THEN read WHEN 'expired' THEN done + {_LIMITS.job_ttl_seconds}000000 WHEN 'stopping' THEN soft
                 WHEN 'processing' THEN started WHEN 'queued' THEN submitted ELSE done END AS since, CASE WHEN state = 'failed' THEN why END AS error,
               CASE WHEN state IN ('processing', 'complete', 'failed') THEN state WHEN state = 'stopping' THEN 'processing' ELSE 'queued' END AS status FROM y""",
    "payload_roundtrip": "SELECT doc_id, md5(base64(encode(text))) AS digest, length(base64(encode(text)))::BIGINT AS n, true AS same FROM documents",
} | file_queries.ORACLES | history_queries.ORACLES
