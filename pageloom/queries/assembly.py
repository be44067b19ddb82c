"""Queries over whole pages and documents: assembly with tables and images, chunk records, folded chunks, rows of signals, job tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import quality as Q
from ..functions import text as X
from ..operators import chunks as C
from ..operators import classify, overlap, pages, render, structure, word_grid
from ..operators import tables as T
from ..plans import parse
from ..ports import lines_of
from ..sources import adapters as A
from ..sources import readers
from ..sources.adapters import table
from ..streaming import jobs, tasks
from . import sql as S
from .documents import _DOC, _JOBS, _PACK, _PATH, _POST, _TOK, _flat, _jobs, _recursive, _source
from .layout import _IM
from .tables import _CELLS, _tables
from .text import _HC, _MERGE, _headings, _hierarchy_sql, _legal_sql, _paragraphs, blocks

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Chunk records: the JSON of each chunk by title, parsed again, with the names and order of its keys.
_RECORD = "chunk_id string, text string, block_ids array<string>, page_numbers array<int>, heading_path array<string>, chunk_type string, token_count int, metadata map<string,string>"


@query(_recursive(f"""SELECT doc_id, printf('doc%d-%04d', doc_id, chunk) AS chunk_id, 'chunk_id,text,block_ids,page_numbers,heading_path,chunk_type,token_count,metadata' AS keys, text, block_ids, page_numbers, heading_path, 'by_title' AS chunk_type, {_TOK}::INTEGER AS token_count, 0 AS n_metadata
  FROM (SELECT doc_id, chunk, CASE WHEN len(any_value(path)) > 0 THEN array_to_string(any_value(path), ' > ') || chr(10) || chr(10) ELSE '' END || string_agg(text, chr(10) ORDER BY rn) AS text, string_agg(block_id, ',' ORDER BY rn) AS block_ids, array_to_string(list_sort(list(DISTINCT page_num)), ',') AS page_numbers, array_to_string(any_value(path), ' > ') AS heading_path
  FROM o JOIN rec USING (doc_id, rn) JOIN (SELECT doc_id, page_num, seq, block_id FROM hh) USING (doc_id, page_num, seq) GROUP BY ALL)""", _HC, _hierarchy_sql("hc"), _PATH, _PACK))
def chunk_jsonl(spark, sf_dir):
    j = C.as_json(C.by_title(structure.hierarchy(_headings(spark, sf_dir)), _source()))
    r = j.select("doc_id", F.array_join(F.json_object_keys("json"), ",").alias("keys"), F.from_json("json", _RECORD).alias("r")).select("doc_id", "keys", "r.*")
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return r.select("doc_id", "chunk_id", "keys", "text", text("block_ids"), text("page_numbers"), F.array_join("heading_path", " > ").alias("heading_path"), "chunk_type", "token_count", F.size("metadata").alias("n_metadata"))


_FOLD = f"""gg AS (SELECT doc_id, grp, row_number() OVER (PARTITION BY doc_id ORDER BY grp) AS gi, greatest(1, length(string_agg(text, ' ' ORDER BY page_num, seq)) // 2) AS tk, any_value(path) AS path FROM s0 GROUP BY doc_id, grp),
fr AS (SELECT doc_id, gi, grp, 0 AS into_, path AS cur FROM gg WHERE gi = 1 UNION ALL
  SELECT doc_id, gi, grp, CASE WHEN m THEN into_ ELSE into_ + 1 END, CASE WHEN m THEN path[1:n] ELSE path END FROM (SELECT g.doc_id, g.gi, g.grp, g.path, r.into_, least(len(g.path), len(r.cur)) AS n, g.tk < 200 AND g.path[1:least(len(g.path), len(r.cur))] = r.cur[1:least(len(g.path), len(r.cur))] AS m FROM fr r JOIN gg g ON g.doc_id = r.doc_id AND g.gi = r.gi + 1)),
fp AS (SELECT doc_id, into_, arg_max(cur, gi) AS path FROM fr GROUP BY doc_id, into_),
src AS (SELECT s0.doc_id, page_num, seq, text, fp.path AS path, fr.into_ AS grp FROM s0 JOIN fr ON fr.doc_id = s0.doc_id AND fr.grp = s0.grp JOIN fp ON fp.doc_id = fr.doc_id AND fp.into_ = fr.into_)"""


@query(_recursive(f"SELECT doc_id, printf('doc%d-%04d', doc_id, chunk) AS chunk_id, text, page_numbers, {_TOK}::INTEGER AS token_count, heading_path FROM (SELECT doc_id, chunk, CASE WHEN len(any_value(path)) > 0 THEN array_to_string(any_value(path), ' > ') || chr(10) || chr(10) ELSE '' END || string_agg(text, chr(10) ORDER BY rn) AS text, array_to_string(list_sort(list(DISTINCT page_num)), ',') AS page_numbers, array_to_string(any_value(path), ' > ') AS heading_path FROM o JOIN rec USING (doc_id, rn) GROUP BY ALL)", _HC, _PATH.replace("src AS (", "s0 AS ("), _FOLD, _PACK))
def chunks_by_title_combined(spark, sf_dir):
    """Groups under 200 tokens go into a group before them above, below or of the same headings."""
    return _flat(C.chunked(_headings(spark, sf_dir), _source(), "by_title", combine_under_n=200))


# Pages with their tables (orders, by customer and page) and images.
_INSIDE = f"EXISTS (SELECT 1 FROM tb WHERE tb.doc_id = p.doc_id AND tb.page_num = p.page_num AND {S.cross('p.', 'tb.')} > 0 AND {S.area('p.')} > 0 AND {S.cross('p.', 'tb.')} / {S.area('p.')} > 0.3)"
_REP = f"(regexp_replace({S.strip('text')}, '  +', ' ', 'g'))"
_ELEMENTS = f"""tl AS (SELECT table_id, "row" * 2 AS o, '| ' || string_agg(text, ' | ' ORDER BY col) || ' |' AS l FROM ce GROUP BY ALL UNION ALL SELECT table_id, 1, '| --- | --- | --- | --- |' FROM tb),
tm AS (SELECT table_id, string_agg(l, chr(10) ORDER BY o) || CASE WHEN any_value(needs_review) THEN chr(10) || '> **Table may have issues - manual review recommended**' || chr(10) ELSE '' END AS markdown FROM tl JOIN tb USING (table_id) GROUP BY table_id),
ib AS (SELECT *, substr(md5(printf('img|%d|%d|%.1f|%.1f', img, page_num, x0, y0)), 1, 12) AS block_id FROM im),
el AS (SELECT doc_id, page_num, y0, 0 AS kind, seq::BIGINT AS n, CASE WHEN block_type = 'heading' AND heading_level > 0 THEN chr(10) || repeat('#', least(heading_level, 6)) || ' ' || {_REP} || chr(10) ELSE {_REP} END AS md FROM (SELECT * FROM mg p WHERE text <> '' AND NOT {_INSIDE})
  UNION ALL SELECT doc_id, page_num, y0, 1, table_id, chr(10) || markdown || chr(10) FROM tb JOIN tm USING (table_id)
  UNION ALL SELECT doc_id, page_num, y0, 2, img, chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'Read from image ' || img ELSE '![image-' || page_num || '-' || block_id || '](placeholder://image/' || block_id || '?page=' || page_num || ')' END || chr(10) FROM ib)"""


def _images(b):
    i = b.where("seq % 10 = 5").select("doc_id", "page_num", F.col("seq").alias("img"), F.lit(100.0).alias("x0"), (20 + 85 * (F.col("seq") % 10) + 82).cast("double").alias("y0"), F.lit(300.0).alias("x1"), (20 + 85 * (F.col("seq") % 10) + 84).cast("double").alias("y1"), "height")
    return i.withColumn("alt_text", F.when(F.col("doc_id") % 2 == 0, F.format_string("Read from image %d", "img")))


@query(S.with_ctes("SELECT doc_id, page_num, string_agg(md, chr(10) ORDER BY y0, kind, n) AS markdown FROM el GROUP BY ALL", _HC, _MERGE, _CELLS, _IM, _ELEMENTS))
def page_assembly(spark, sf_dir):
    """Text outside tables, tables and images of a page from top to bottom; captions are left out."""
    t, c = _tables(spark, sf_dir)
    i = overlap.distinct_images(_images(blocks(spark, sf_dir))).withColumn("caption", F.lit(None).cast("string"))
    return parse.assembled(_paragraphs(spark, sf_dir), None, t, c, i)


@query()
def whole_plan(spark, sf_dir):
    """The whole plan over documents with layout boxes, tables and images; its parts have SQL of their own, tests hold it against worked cases."""
    b = blocks(spark, sf_dir)
    t, c = _tables(spark, sf_dir)
    p = parse.parse_blocks(b, A.pages(b), tables=t, cells=c, images=_images(b), boxes=A.layout_boxes(b), cut=parse.checkpointed)
    n = p.tree.groupBy("doc_id").agg(*(F.count_if(F.col("node_type") == k).alias(f"n_{k}") for k in ("section", "paragraph", "table", "form", "figure")))
    return n.join(p.markdown.select("doc_id", F.length("markdown").alias("n_chars"), F.md5("markdown").alias("markdown_md5")), "doc_id", "left")


@query(S.with_ctes("SELECT doc_id, markdown FROM dm", "md AS (SELECT doc_id, page_num, raw_text AS markdown FROM pg)", _POST, _DOC))
def post_process(spark, sf_dir):
    """Pages' raw text put together and cleaned."""
    return render.post_processed(A.pages(blocks(spark, sf_dir)).select("doc_id", "page_num", F.col("raw_text").alias("markdown")))


_SIGNALS = ("font_deviation", "font_weight", "bbox_height_ratio", "vertical_gap", "text_length", "has_numbering", "layout_label", "ends_without_period", "width_ratio", "data_bearing")


@query(S.with_ctes("SELECT doc_id, page_num, seq, " + ", ".join(f"round(s_{k}::DOUBLE, 6) AS {k}" for k in _SIGNALS) + " FROM f2", _HC))
def heading_signals(spark, sf_dir):
    b = blocks(spark, sf_dir)
    s = classify.with_page_figures(b).join(pages.font_stats(b).select("doc_id", "avg_font_size"), "doc_id")
    return s.select("doc_id", "page_num", "seq", *(F.round(v.cast("double"), 6).alias(k) for k, v in classify.signals(F.col("avg_font_size"), F.lit(None).cast("string")).items()))


_PUA = "CASE WHEN doc_id % 3 = 0 THEN regexp_replace(text, '[aeiou]', chr(57344), 'g') WHEN doc_id % 3 = 1 THEN regexp_replace(text, '[e]', chr(57344), 'g') ELSE text END"
_VISIBLE = S.count("x", f"[^{S.WS}]")


@query(f"SELECT doc_id, {_VISIBLE} > 0 AND ((length(x) - length(replace(x, chr(57344), ''))) / {_VISIBLE}::DOUBLE >= 0.3 OR {S.readable('x')} < 0.3) AS garbled FROM (SELECT doc_id, {_PUA} AS x FROM documents)")
def pua_garbled(spark, sf_dir):
    """Texts in which glyphs without a meaning stand for all vowels, for one, or for none."""
    d = table(spark, sf_dir, "documents")
    glyph = lambda p: F.regexp_replace("text", p, "\ue000")
    x = F.when(F.col("doc_id") % 3 == 0, glyph("[aeiou]")).when(F.col("doc_id") % 3 == 1, glyph("[e]")).otherwise(F.col("text"))
    return d.select("doc_id", Q.is_undecodable(x).alias("garbled"))


_PREFIX = ("제1편 ", "제2장 ", "제3절 ", "제3조(목적) ", "① ", "가) ", "2.1 ", "1. ", "나. ", "")
_PREFIXED = "(CASE seq % 10 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(_PREFIX)) + f" END || {S.strip('text')})"


@query(S.with_ctes(f"SELECT doc_id, page_num, seq, {_legal_sql('x', 'size', 'is_bold').replace(chr(92) + 'b', '(?:[ ]|$)')} AS block_type FROM (SELECT *, {_PREFIXED} AS x FROM f0)", _HC))
def profile_legal(spark, sf_dir):
    """Lines of the documents behind the marks of Korean terms of insurance, which the test tables don't hold."""
    b = blocks(spark, sf_dir)
    x = F.concat(F.element_at(F.array(*map(F.lit, _PREFIX)), F.col("seq") % 10 + 1), X.strip(F.col("text")))
    j = b.join(pages.font_stats(b).select("doc_id", "avg_font_size"), "doc_id")
    return j.select("doc_id", "page_num", "seq", classify.legal_type(x, F.col("size"), F.col("is_bold"), F.col("avg_font_size")).alias("block_type"))


@query("SELECT 'd' || doc_id || '.txt' AS path, text AS markdown, length(text) - length(replace(text, chr(10), '')) + 1 AS \"rows\", 1::BIGINT AS cols, false AS truncated FROM documents")
def text_passthrough(spark, sf_dir):
    """Every document as a text file, every third one with a byte order mark, which is part of what is read."""
    d = table(spark, sf_dir, "documents").select(F.format_string("d%d.txt", "doc_id").alias("path"), F.encode("text", "UTF-8").alias("content"))
    return readers.text_files(d)


_WIDE = "fc AS (SELECT table_id, \"row\", col, CASE WHEN col = 0 AND table_id % 5 = 0 THEN repeat(text || ' words of a paragraph ', 5) ELSE text END AS text FROM ce WHERE col < 2)"


@query(f"""WITH {_CELLS}, {_WIDE}, ff AS (SELECT table_id, count(*) FILTER (length(trim(text)) > 0) AS f, count(*) FILTER (length(trim(text)) > 80) AS lg FROM fc GROUP BY table_id) SELECT table_id, f > 0 AND lg > 0 AND lg >= f * 0.3 AS is_layout FROM tb JOIN ff USING (table_id)""")
def layout_tables(spark, sf_dir):
    """Tables cut to two columns; every fifth holds paragraphs in the first, and is a frame."""
    t, c = _tables(spark, sf_dir)
    long_ = F.repeat(F.concat("text", F.lit(" words of a paragraph ")), F.lit(5))
    c = c.where("col < 2").withColumn("text", F.when((F.col("col") == 0) & (F.col("table_id") % 5 == 0), long_).otherwise(F.col("text")))
    return T.layout_like(t.withColumn("cols", F.lit(2)), c)


@query(f"""WITH {_CELLS} SELECT table_id AS doc_id, 1 AS page_num, "row", col, text FROM ce WHERE text <> ''""")
def tables_from_lines(spark, sf_dir):
    """Orders drawn as ruled tables: their words and lines give the cells back."""
    t, c = _tables(spark, sf_dir)
    at = c.where("text <> ''").select(F.col("table_id").alias("doc_id"), F.lit(1).alias("page_num"), "text", (60.0 + 100 * F.col("col")).alias("x0"), (120.0 + 100 * F.col("col")).alias("x1"), (104.0 + 20 * F.col("row")).alias("top"), (116.0 + 20 * F.col("row")).alias("bottom"))
    edges = lambda n: F.explode(F.sequence(F.lit(0), n))
    size = t.select(F.col("table_id").alias("doc_id"), F.lit(1).alias("page_num"), "rows", "cols")
    up = size.select("doc_id", "page_num", "rows", edges(F.col("cols")).alias("k")).select("doc_id", "page_num", (50.0 + 100 * F.col("k")).alias("x0"), F.lit(100.0).alias("y0"), (50.5 + 100 * F.col("k")).alias("x1"), (100.0 + 20 * F.col("rows")).alias("y1"))
    across = size.select("doc_id", "page_num", "cols", edges(F.col("rows")).alias("k")).select("doc_id", "page_num", F.lit(50.0).alias("x0"), (100.0 + 20 * F.col("k")).alias("y0"), (50.0 + 100 * F.col("cols")).alias("x1"), (100.5 + 20 * F.col("k")).alias("y1"))
    return T.from_lines(at, up.unionByName(across))[1].select("doc_id", "page_num", "row", "col", "text")


@query()
def word_grids(spark, sf_dir):
    """Parts as itineraries without lines, a size a page; what is read depends on rows above, tests hold it against worked cases."""
    p = table(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("doc_id"), F.lit(1).alias("page_num"), F.array(F.lit("ICN"), F.col("p_partkey").cast("string"), F.lit("ECONOMY"), F.col("p_brand")).alias("w"), F.row_number().over(A.Window.partitionBy("p_size").orderBy("p_partkey")).alias("row"))
    head = p.select("doc_id", "page_num", F.array(*map(F.lit, ("CITY", "DATE", "CLASS", "STATUS"))).alias("w"), F.lit(0).alias("row")).distinct()
    w = head.unionByName(p).select("doc_id", "page_num", "row", F.posexplode("w").alias("k", "text"))
    return word_grid.rebuilt(w.select("doc_id", "page_num", "text", (50.0 + 130 * F.col("k")).alias("x0"), (110.0 + 130 * F.col("k")).alias("x1"), (100.0 + 14 * F.col("row")).alias("top"), (110.0 + 14 * F.col("row")).alias("bottom")))


@query(S.with_ctes("SELECT doc_id, page_num, count(*) FILTER (wide >= 2) AS n_tables FROM (SELECT doc_id, page_num, seq // 3 AS k, count(*) FILTER (len(regexp_extract_all(text, '[^ ]+')) >= 3) AS wide FROM b GROUP BY ALL) GROUP BY ALL"))
def table_estimate(spark, sf_dir):
    """Three lines make a text block, a word is a span."""
    spans = blocks(spark, sf_dir).select("doc_id", "page_num", F.floor(F.col("seq") / 3).alias("block"), F.col("seq").alias("line"), F.posexplode(F.regexp_extract_all("text", F.lit("[^ ]+"), 0)).alias("span", "t"))
    return T.estimated(spans)


@query(f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS seq, {S.strip('text')} AS text FROM raw WHERE {S.strip('text')} <> ''".replace("FROM raw", "FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents)"))
def vision_lines(spark, sf_dir):
    """Texts taken as what a model read from whole pages."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page_num"), "text", *(F.lit(v).alias(k) for k, v in (("x0", 0.0), ("y0", 0.0), ("x1", 595.0), ("y1", 880.0))))
    return lines_of(d).select("doc_id", F.col("seq").cast("long").alias("seq"), "text")


@query(f"WITH {_JOBS} SELECT job_id, CASE WHEN status = 'queued' AND row_number() OVER (PARTITION BY status ORDER BY ts, job_id) <= 5 THEN 'processing' ELSE status END AS status FROM jb")
def job_claim(spark, sf_dir):
    """The five oldest queued jobs are taken."""
    return jobs.claimed(_jobs(spark, sf_dir), F.current_timestamp(), 5).select("job_id", "status")


@query(f"WITH {_JOBS} SELECT job_id, status FROM jb WHERE status IN ('queued', 'processing')")
def jobs_under_way(spark, sf_dir):
    return jobs.listed(_jobs(spark, sf_dir), active=True).select("job_id", "status")


@query(f"WITH {_JOBS} SELECT depth, 8 AS \"limit\", depth < 8 AS accepted, CASE WHEN depth >= 8 THEN 5 END AS retry_after FROM (SELECT count(*) FILTER (status IN ('queued', 'processing')) AS depth FROM jb)")
def queue_accepts(spark, sf_dir):
    return jobs.accepts(_jobs(spark, sf_dir), 4)


@query("""SELECT task_id, min(ts) AS start, max(ts) + INTERVAL 10 MINUTE AS "end", count(*) AS n_events, 20::BIGINT AS n_beats FROM (SELECT *, sum(nw) OVER (PARTITION BY task_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT user_id AS task_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 10 MINUTE, true)::INT AS nw FROM events)) GROUP BY task_id, k""")
def task_sessions(spark, sf_dir):
    """A task's events up to a pause of ten minutes, which twenty heartbeats fill."""
    return tasks.sessions(A.task_events(table(spark, sf_dir, "events")))
