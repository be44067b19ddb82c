"""Queries about retries, sums over pages, sections, files and states."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import quality as Q
from ..operators import attempts, noise, overlap, pages, results, structure
from ..operators import layout as L
from ..sources import adapters as A
from ..sources import readers
from ..sources.adapters import table
from ..streaming import tasks
from . import sql as S
from .layout import _BOX
from .text import _GB, _HC, _PT, _ST, _headings, blocks

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(S.with_ctes("""SELECT doc_id, page_num, seq, CASE WHEN up THEN 'heading' ELSE t END AS block_type, CASE WHEN up THEN 3 WHEN t = 'heading' THEN 1 ELSE 0 END::INTEGER AS heading_level FROM (SELECT *, NOT bool_or(t = 'heading') OVER (PARTITION BY doc_id) AND t = 'subclause' AND length(x) <= 80 AS up
  FROM (SELECT doc_id, page_num, seq, (seq % 20 + 1) || '. ' || text AS x, CASE WHEN doc_id % 4 = 0 AND seq = 0 THEN 'heading' WHEN seq % 3 = 0 THEN 'subclause' ELSE 'text' END AS t FROM b))"""))
def promote_numbered(spark, sf_dir):
    """Lines numbered, every third one a subclause; every fourth document has a heading."""
    kind = F.when((F.col("doc_id") % 4 == 0) & (F.col("seq") == 0), "heading").when(F.col("seq") % 3 == 0, "subclause").otherwise("text")
    b = blocks(spark, sf_dir).withColumns({"text": F.concat((F.col("seq") % 20 + 1).cast("string"), F.lit(". "), F.col("text")), "block_type": kind, "heading_level": F.when(kind == "heading", 1).otherwise(0)})
    return structure.promoted(b).select("doc_id", "page_num", "seq", "block_type", "heading_level")


KOREAN = (("plain text", 0.0), ("ㅂㅎ ㄱㅡㅁ", 0.7), ("가1나", 0.225))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{t}', {v}::DOUBLE)" for t, v in KOREAN) + ") v(text, score)")
def korean_garbled(spark, sf_dir):
    """Scores worked out by hand."""
    return spark.createDataFrame([(t,) for t, _ in KOREAN], "text string").select("text", F.round(Q.korean_garbled(F.col("text")), 6).alias("score"))


_MIN = f"least({S.area('bx.')}, {S.area('b.')})"


@query(S.with_ctes(f"SELECT doc_id, page_num, ord FROM bx WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.seq % 2 = 1 AND b.doc_id = bx.doc_id AND b.page_num = bx.page_num AND {_MIN} > 0 AND {S.cross('bx.', 'b.')} / {_MIN} > 0.01)"))
def ocr_beside_text(spark, sf_dir):
    b = blocks(spark, sf_dir)
    return overlap.beside(A.layout_boxes(b).withColumn("seq", F.col("ord")), b.where("seq % 2 = 1"), 0.01).select("doc_id", "page_num", "ord")


@query(S.with_ctes(f"SELECT doc_id, page_num, substr(md5(printf('%d|%.1f|%.1f|%.1f|%.1f', page_num, x0, y0, x1, y1)), 1, 12) AS block_id, {_BOX} AS block_type, confidence, label AS original_label FROM bx"))
def layout_normalized(spark, sf_dir):
    return L.normalized(A.layout_boxes(blocks(spark, sf_dir))).select("doc_id", "page_num", "block_id", "block_type", "confidence", "original_label")


_SEC = """sc AS (SELECT doc_id, y0, row_number() OVER (PARTITION BY doc_id ORDER BY page_num, seq) AS ord FROM hc WHERE block_type = 'heading'), it AS (SELECT doc_id, page_num * 10 + seq % 10 AS item, (20 + 85 * (seq % 10) + 82)::DOUBLE AS y0 FROM b WHERE seq % 10 = 5)"""


@query(S.with_ctes("SELECT it.doc_id, item::INTEGER AS item, coalesce(arg_max(ord, struct_pack(y := sc.y0, o := -ord)) FILTER (sc.y0 <= it.y0), max(ord), 0)::INTEGER AS section_ord FROM it LEFT JOIN sc ON it.doc_id = sc.doc_id GROUP BY ALL", _HC, _SEC))
def sections_of_images(spark, sf_dir):
    h = _headings(spark, sf_dir).where("block_type = 'heading'")
    s = h.select("doc_id", "y0", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_num", "seq")).alias("ord"))
    i = blocks(spark, sf_dir).where("seq % 10 = 5").select("doc_id", (F.col("page_num") * 10 + F.col("seq") % 10).alias("item"), (20 + 85 * (F.col("seq") % 10) + 82).cast("double").alias("y0"))
    return results.in_sections(i, s).select("doc_id", "item", F.coalesce("section_ord", F.lit(0)).alias("section_ord"))


_RES = f"""pq AS (SELECT doc_id, page_num, count(*) FILTER (s < 0.6 OR confidence < 0.6 OR g > 0.2) AS retried, round(avg(s), 9) AS q, count(*) FILTER (noise = 'header') AS h, count(*) FILTER (noise = 'footer') AS f, count(*) FILTER (noise = 'page_number') AS p, count(*) FILTER (noise = 'watermark') AS w FROM (SELECT *, {_GB} AS g, greatest(0.0, least(1.0, confidence * (1 - {_GB}))) AS s FROM nc) GROUP BY ALL),
pr AS (SELECT pq.*, page_type = 'noise' AS toc, page_type = 'scanned' AS ocr FROM pq JOIN (SELECT doc_id, page_num, page_type FROM pt) USING (doc_id, page_num))"""


@query(S.with_ctes("SELECT doc_id, count(*) FILTER (NOT toc) AS parsed_pages, count(*) FILTER (toc) AS toc_pages, coalesce(sum(h) FILTER (NOT toc), 0)::BIGINT AS headers, coalesce(sum(f) FILTER (NOT toc), 0)::BIGINT AS footers, coalesce(sum(p) FILTER (NOT toc), 0)::BIGINT AS page_numbers, coalesce(sum(w) FILTER (NOT toc), 0)::BIGINT AS watermarks, coalesce(bool_or(ocr) FILTER (NOT toc), false) AS ocr_used, coalesce(sum(retried) FILTER (NOT toc), 0)::BIGINT AS blocks_retried, coalesce(round(round(avg(q) FILTER (NOT toc AND q < 1), 9), 4), 1.0) AS avg_block_quality FROM pr GROUP BY doc_id", _PT, _RES))
def aggregate_results(spark, sf_dir):
    b = blocks(spark, sf_dir)
    marked = Q.block_scores(noise.classified(b, noise.learned(b)).withColumn("block_type", F.lit("text")))
    per = marked.groupBy("doc_id", "page_num").agg(*(F.count_if(F.col("noise") == k).alias(f"n_{k}") for k in results.NOISE), F.count_if("needs_retry").alias("blocks_retried"), F.round(F.avg("block_score"), 9).alias("avg_block_quality"))
    kinds = pages.typed(A.pages(b), b).select("doc_id", "page_num", (F.col("page_type") == "noise").alias("is_toc"), (F.col("page_type") == "scanned").alias("ocr_used"))
    return results.aggregated(per.join(kinds, ["doc_id", "page_num"]))


@query(S.with_ctes("SELECT fallback, count(*) AS n FROM (SELECT CASE WHEN g > 0.5 OR length(text) < 5 THEN 'vlm' WHEN g > 0.2 THEN 'ocr' ELSE 'none' END AS fallback FROM (SELECT *, " + _GB + " AS g, greatest(0.0, least(1.0, confidence * (1 - " + _GB + "))) AS s FROM b) WHERE s < 0.6 OR confidence < 0.6 OR g > 0.2) GROUP BY fallback"))
def retry_candidates(spark, sf_dir):
    b = Q.block_scores(blocks(spark, sf_dir).withColumn("block_type", F.lit("text")))
    return b.where("needs_retry").groupBy("fallback").agg(F.count(F.lit(1)).alias("n"))


@query(S.with_ctes("SELECT doc_id, page_num FROM pt JOIN st USING (doc_id, page_num) WHERE page_type IN ('scanned', 'mixed') OR layout_needed", _PT, _ST))
def layout_gate(spark, sf_dir):
    b = blocks(spark, sf_dir)
    p = pages.typed(A.pages(b), b).select("doc_id", "page_num", "page_type").join(pages.strategies(A.pages(b), b).select("doc_id", "page_num", "layout_needed"), ["doc_id", "page_num"])
    return L.needs_detection(p).select("doc_id", "page_num")


@query("SELECT user_id AS doc_id, arg_min(event_id, struct_pack(o := -coalesce(CASE WHEN event_type <> 'error' THEN round(value, 1) END, -1), e := event_id)) AS attempt FROM events GROUP BY user_id")
def best_attempt(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("attempt"), F.when(F.col("event_type") != "error", F.round("value", 1)).alias("overall"))
    return attempts.best(e, ("doc_id",)).select("doc_id", "attempt")


@query("SELECT user_id AS name, event_id, up FROM (SELECT user_id, event_id, event_type <> 'error' AS up, lag(event_type <> 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NULL OR b <> up")
def state_transitions(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("name"), F.struct("ts", "event_id").alias("ts"), (F.col("event_type") != "error").alias("up"))
    return tasks.transitions(e).select("name", "ts.event_id", "up")


@query("SELECT 'r' || r_regionkey || '.csv' AS path, '## r' || r_regionkey || '.csv' || chr(10) || chr(10) || '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS markdown, count(*) AS \"rows\", 2::BIGINT AS cols, false AS truncated FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey")
def csv_to_markdown(spark, sf_dir):
    """A delimited file of nations for each region."""
    n = table(spark, sf_dir, "nation")
    line = F.concat_ws(",", F.col("n_nationkey").cast("string"), F.col("n_name"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("l")))), lambda x: x["l"]), "\n")
    f = n.groupBy("n_regionkey").agg(F.concat(F.lit("key,name\n"), body).cast("binary").alias("content")).select(F.format_string("r%d.csv", "n_regionkey").alias("path"), "content")
    return readers.csv_files(f)
