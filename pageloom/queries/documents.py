"""Queries about chunks, Markdown, trees, metrics, tasks and jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunks as C
from ..operators import metrics, pages, render, structure
from ..sources import adapters as A
from ..sources.adapters import table
from ..streaming import jobs, tasks
from . import sql as S
from .text import _BROKEN, _HC, _MERGE, _PT, _headings, _paragraphs, blocks

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _source():
    return F.format_string("doc%d", F.col("doc_id"))


def _flat(chunks):
    """Lists as text, so that engines can be compared."""
    out = chunks.drop("block_ids", "chunk_type", "metadata").withColumn("page_numbers", F.array_join(F.transform("page_numbers", lambda x: x.cast("string")), ","))
    return out.withColumn("heading_path", F.array_join("heading_path", " > ")) if "heading_path" in chunks.columns else out


_TOK = "greatest(1, length(text) // 2)"


@query(S.with_ctes(f"SELECT doc_id, printf('doc%d-%04d', doc_id, rn) AS chunk_id, text, page_num::VARCHAR AS page_numbers, {_TOK}::INTEGER AS token_count FROM (SELECT doc_id, page_num, raw_text AS text, row_number() OVER (PARTITION BY doc_id ORDER BY page_num) - 1 AS rn FROM pg)"))
def chunks_by_page(spark, sf_dir):
    return _flat(C.by_page(blocks(spark, sf_dir), _source()))


_PACK = f"""o AS (SELECT *, {_TOK} AS tk, row_number() OVER (PARTITION BY doc_id ORDER BY page_num, seq) AS rn FROM src),
rec AS (SELECT doc_id, rn, grp, tk AS held, 0 AS chunk FROM o WHERE rn = 1 UNION ALL SELECT o.doc_id, o.rn, o.grp, CASE WHEN o.grp <> rec.grp OR rec.held + o.tk > 500 THEN o.tk ELSE rec.held + o.tk END, rec.chunk + (o.grp <> rec.grp OR rec.held + o.tk > 500)::INT FROM rec JOIN o ON o.doc_id = rec.doc_id AND o.rn = rec.rn + 1)"""


def _recursive(select: str, *more: str) -> str:
    return S.with_ctes(select, *more).replace("WITH ", "WITH RECURSIVE ", 1)


@query(_recursive(f"SELECT doc_id, printf('doc%d-%04d', doc_id, chunk) AS chunk_id, text, page_numbers, {_TOK}::INTEGER AS token_count FROM (SELECT doc_id, chunk, string_agg(text, chr(10) ORDER BY rn) AS text, array_to_string(list_sort(list(DISTINCT page_num)), ',') AS page_numbers FROM o JOIN rec USING (doc_id, rn) GROUP BY ALL)", "src AS (SELECT doc_id, page_num, seq, text, 0 AS grp FROM b)", _PACK))
def chunks_fixed(spark, sf_dir):
    return _flat(C.fixed(blocks(spark, sf_dir), _source()))


@query(ORACLES["chunks_fixed"])
def chunks_semantic_fallback(spark, sf_dir):
    """Without a tokenizer the semantic strategy packs by size."""
    return _flat(C.chunked(blocks(spark, sf_dir), _source(), "semantic"))


_PATH = f"""hl AS (SELECT *, CASE WHEN block_type = 'heading' THEN greatest(heading_level, 1) END AS lv FROM hc),
pp AS (SELECT c.doc_id, c.page_num, c.seq, c.text, coalesce((SELECT list({S.strip("p.text")} ORDER BY p.lv) FROM hl p WHERE p.doc_id = c.doc_id AND p.page_num = c.page_num AND p.lv IS NOT NULL AND p.seq <= c.seq
  AND NOT EXISTS (SELECT 1 FROM hl q WHERE q.doc_id = c.doc_id AND q.page_num = c.page_num AND q.seq > p.seq AND q.seq <= c.seq AND q.lv <= p.lv)), []) AS path FROM hl c),
src AS (SELECT doc_id, page_num, seq, text, path, sum(nw) OVER (PARTITION BY doc_id ORDER BY page_num, seq) AS grp FROM (SELECT *, coalesce(lag(path) OVER (PARTITION BY doc_id ORDER BY page_num, seq) <> path, true)::INT AS nw FROM pp))"""


@query(_recursive(f"SELECT doc_id, printf('doc%d-%04d', doc_id, chunk) AS chunk_id, text, page_numbers, {_TOK}::INTEGER AS token_count, heading_path FROM (SELECT doc_id, chunk, CASE WHEN len(any_value(path)) > 0 THEN array_to_string(any_value(path), ' > ') || chr(10) || chr(10) ELSE '' END || string_agg(text, chr(10) ORDER BY rn) AS text, array_to_string(list_sort(list(DISTINCT page_num)), ',') AS page_numbers, array_to_string(any_value(path), ' > ') AS heading_path FROM o JOIN rec USING (doc_id, rn) GROUP BY ALL)", _HC, _PATH, _PACK))
def chunks_by_title(spark, sf_dir):
    return _flat(C.by_title(_headings(spark, sf_dir), _source()))


@query("SELECT conv_id AS doc_id, count(*) AS n_chunks, sum(greatest(1, length(text) // 2))::BIGINT AS tokens FROM conversations WHERE regexp_matches(text, '\\S') GROUP BY conv_id")
def conversation_chunks(spark, sf_dir):
    b = A.conversation_blocks(table(spark, sf_dir, "conversations"))
    return C.by_page(b, _source()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("token_count").alias("tokens"))


_REP = f"(regexp_replace({S.strip('text')}, '  +', ' ', 'g'))"
_MD = f"""md0 AS (SELECT doc_id, page_num, y0, seq, CASE WHEN block_type = 'heading' AND heading_level > 0 THEN chr(10) || repeat('#', least(heading_level, 6)) || ' ' || {_REP} || chr(10) ELSE {_REP} END AS md FROM mg WHERE text <> ''),
md AS (SELECT doc_id, page_num, string_agg(md, chr(10) ORDER BY y0, seq) AS markdown FROM md0 GROUP BY ALL)"""


def _page_markdown(spark, sf_dir):
    return render.page_markdown(_paragraphs(spark, sf_dir))


@query(S.with_ctes("SELECT doc_id, page_num, markdown FROM md", _HC, _MERGE, _MD))
def page_markdown(spark, sf_dir):
    return _page_markdown(spark, sf_dir)


_POST = _BROKEN.replace("l0 AS (SELECT doc_id, n AS line_no, text AS line,", "pl AS (SELECT doc_id, n AS n, regexp_extract(text, '^\\s*') || regexp_replace(regexp_replace(text, '^\\s*', ''), ' {2,}', ' ', 'g') AS text FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS text, unnest(range(len(string_split(t, chr(10))))) AS n FROM (SELECT doc_id, string_agg(markdown, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY page_num) AS t FROM md WHERE " + S.strip("markdown") + " <> '' GROUP BY doc_id))),\nl0 AS (SELECT doc_id, n AS line_no, text AS line,").replace("AS nx FROM raw)", "AS nx FROM pl)")
_DOC = f"""dm0 AS (SELECT doc_id, string_agg(CASE WHEN takes THEN left(line, length(line) - length(s)) || s || CASE WHEN regexp_matches(s, '[가-힣]$') AND regexp_matches(nx, '^[가-힣]') THEN '' ELSE ' ' END || nx ELSE line END, chr(10) ORDER BY line_no) AS t FROM l4 WHERE NOT taken GROUP BY doc_id),
dm1 AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '\\n{{4,}}', chr(10) || chr(10) || chr(10), 'g'), '\\n*\\n---\\n\\n*', chr(10) || chr(10) || '---' || chr(10) || chr(10), 'g'), '(?:\\n---\\n\\s*){{2,}}', chr(10) || chr(10) || '---' || chr(10) || chr(10), 'g') AS t FROM dm0),
dm AS (SELECT doc_id, {S.strip("array_to_string(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '\\s+$', '')), chr(10))")} AS markdown FROM dm1)"""


@query(S.with_ctes("SELECT doc_id, markdown FROM dm", _HC, _MERGE, _MD, _POST, _DOC))
def document_markdown(spark, sf_dir):
    return render.post_processed(_page_markdown(spark, sf_dir))


@query(S.with_ctes("""SELECT doc_id, concat_ws(chr(10), '---', 'source: "doc' || doc_id || '"', 'source_type: "digital_pdf"', 'pages: ' || n_pages, 'parsed_at: "2024-01-01T00:00:00+09:00"', 'engine_version: "1"', 'ocr_used: false', 'tables_extracted: 0', 'tables_need_review: 0', 'noise_removed:', '  headers: ' || h, '  footers: ' || f, '  page_numbers: ' || p, '  toc_pages: 0', '---') AS front_matter
  FROM (SELECT doc_id, count(*) FILTER (noise = 'header') AS h, count(*) FILTER (noise = 'footer') AS f, count(*) FILTER (noise = 'page_number') AS p FROM nc GROUP BY doc_id) JOIN np USING (doc_id)"""))
def front_matter(spark, sf_dir):
    from ..operators import noise

    b = blocks(spark, sf_dir)
    st = noise.stats(noise.classified(b, noise.learned(b)))
    m = st.join(b.groupBy("doc_id").agg(F.count_distinct("page_num").alias("pages")), "doc_id").select("doc_id", _source().alias("source"), F.lit("digital_pdf").alias("source_type"), "pages", F.lit("2024-01-01T00:00:00+09:00").alias("parsed_at"), F.lit("1").alias("engine_version"), F.lit(False).alias("ocr_used"), F.lit(0).alias("tables_extracted"), F.lit(0).alias("tables_need_review"), F.col("n_header").alias("headers"), F.col("n_footer").alias("footers"), F.col("n_page_number").alias("page_numbers"), F.lit(0).alias("toc_pages"))
    return render.front_matter(m)


_TREE = f"""tq AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_num, seq)::INTEGER AS ord, CASE WHEN block_type = 'heading' AND heading_level > 0 THEN heading_level END AS level, {S.strip("text")} AS text, substr(md5(text || '|0'), 1, 12) AS node_id FROM mg WHERE text <> ''),
tr0 AS (SELECT c.*, (SELECT max(p.ord) FROM tq p WHERE p.doc_id = c.doc_id AND p.ord < c.ord AND p.level IS NOT NULL AND (c.level IS NULL OR p.level < c.level)) AS parent_ord FROM tq c)"""


@query(S.with_ctes("SELECT doc_id, ord, node_id, coalesce(parent_ord, 0)::INTEGER AS parent_ord, CASE WHEN level IS NULL THEN 'paragraph' ELSE 'section' END AS node_type, coalesce(level, 0)::INTEGER AS level, text FROM tr0", _HC, _MERGE, _TREE))
def ast_edges(spark, sf_dir):
    return render.tree(_paragraphs(spark, sf_dir)).na.fill(0, ["parent_ord", "level"])


@query(S.with_ctes(f"SELECT doc_id, {S.strip(chr(114) + 'egexp_replace(t, ' + S.q(chr(92) + 'n{4,}') + ', chr(10) || chr(10) || chr(10), ' + S.q('g') + ')')} AS markdown FROM (SELECT doc_id, string_agg(CASE WHEN level IS NULL THEN text ELSE chr(10) || repeat('#', least(level, 6)) || ' ' || text || chr(10) END, chr(10) ORDER BY ord) AS t FROM tr0 GROUP BY doc_id)", _HC, _MERGE, _TREE))
def ast_render(spark, sf_dir):
    return render.tree_markdown(render.tree(_paragraphs(spark, sf_dir)))


_CONF = """SELECT doc_id, page_num, round(round(greatest(0.0, least(1.0, CASE WHEN dg THEN o * 0.2 + d * 0.3 + s * 0.5 ELSE o * 0.5 + d * 0.2 + s * 0.3 END)), 9), 3) AS overall, round(round(o, 9), 3) AS ocr_confidence, round(round(d, 9), 3) AS text_density, round(round(s, 9), 3) AS structure_ratio FROM (
  SELECT doc_id, page_num, any_value(page_type) = 'digital' AS dg, CASE WHEN any_value(page_type) = 'digital' THEN 1.0::DOUBLE ELSE avg(confidence) END AS o, least(1.0::DOUBLE, sum(length(text)) / (595.0 * 880.0) / 0.006::DOUBLE) AS d, least(1.0::DOUBLE, avg((block_type = 'heading')::INT) / 0.2::DOUBLE) AS s FROM hc JOIN (SELECT doc_id, page_num, page_type FROM pt) USING (doc_id, page_num) GROUP BY ALL)"""


@query(S.with_ctes(_CONF, _HC, _PT))
def page_confidence(spark, sf_dir):
    b = blocks(spark, sf_dir)
    return metrics.page_confidence(_headings(spark, sf_dir), pages.typed(A.pages(b), b))


_STATS = f"""ms AS (SELECT doc_id, string_agg(markdown, chr(10) ORDER BY page_num) AS markdown FROM md GROUP BY doc_id),
sx AS (SELECT doc_id, total_pages, text_blocks, len(list_filter(ls, lambda x: regexp_matches(x, '^#{{1,6}}\\s')))::BIGINT AS heading_count, round((len(ls) - len(fl)) / len(ls)::DOUBLE, 3) AS empty_line_ratio, round(coalesce(list_sum(list_transform(fl, lambda x: length(x))) / nullif(len(fl), 0)::DOUBLE, 0.0), 1) AS avg_line_length, 0::BIGINT AS tables_found, 0::BIGINT AS tables_need_review
  FROM (SELECT doc_id, string_split(markdown, chr(10)) AS ls, list_filter(string_split(markdown, chr(10)), lambda x: {S.strip("x")} <> '') AS fl FROM ms) JOIN (SELECT doc_id, count(DISTINCT page_num) AS total_pages, count(*) AS text_blocks FROM mg WHERE text <> '' GROUP BY doc_id) USING (doc_id))"""


def _stats(spark, sf_dir):
    p = _paragraphs(spark, sf_dir)
    md = render.page_markdown(p).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_num", "markdown"))), lambda x: x["markdown"]), "\n").alias("markdown"))
    return metrics.parse_stats(p, md)


@query(S.with_ctes("SELECT * FROM sx", _HC, _MERGE, _MD, _STATS))
def parse_stats(spark, sf_dir):
    return _stats(spark, sf_dir)


@query(S.with_ctes("SELECT doc_id, 'NO_HEADINGS' AS code, 'warning' AS severity FROM sx WHERE heading_count = 0 UNION ALL SELECT doc_id, 'HIGH_EMPTY_RATIO', 'warning' FROM sx WHERE empty_line_ratio > 0.5", _HC, _MERGE, _MD, _STATS))
def anomalies(spark, sf_dir):
    return metrics.anomalies(_stats(spark, sf_dir))


def _cer(items):
    t = X.strip(F.regexp_replace("text", r"\s+", " "))
    b = items.select("item_id", t.alias("t")).where("length(t) > 0")
    return b.select("item_id", F.round(metrics.error_rate(F.concat(F.substring("t", 1, 200), F.lit("x")), F.col("t")), 6).alias("cer"))


@query("SELECT item_id, round(levenshtein(left(t, 200) || 'x', t) / length(t)::DOUBLE, 6) AS cer FROM (SELECT item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM benchmark WHERE NOT regexp_matches(text, '[^\\x00-\\x7F]')) WHERE length(t) > 0")
def cer(spark, sf_dir):
    """ASCII items only, as in its SQL: DuckDB's distance counts bytes. cer_every_item has all items."""
    return _cer(table(spark, sf_dir, "benchmark").where(~F.col("text").rlike(r"[^\x00-\x7F]")))


@query()
def cer_every_item(spark, sf_dir):
    """Without SQL, as DuckDB's distance counts bytes; a test holds it against brute force on code points."""
    return _cer(table(spark, sf_dir, "benchmark"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(replace(regexp_replace(replace(text, ' e', ' •e'), '(\S)[ \t]*(•)', '\1' || chr(10) || '\2', 'g'), chr(0), ''), '(?m)^[●•][\x{200b}\s]*', '- ', 'g'), '(?m)^[○◦][\x{200b}\s]*', '  - ', 'g') AS text FROM documents WHERE NOT regexp_matches(text, '[●○◦•]')")
def bullets(spark, sf_dir):
    """Bullets put before some words of the texts."""
    return table(spark, sf_dir, "documents").where(~F.col("text").rlike("[●○◦•]")).select("doc_id", X.bullets(F.replace("text", F.lit(" e"), F.lit(" •e"))).alias("text"))


@query(r"SELECT p_partkey, chr(10) || '②' || ' ' || p_name || ' (' || p_brand || ')' AS text FROM part")
def ocr_correct(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.ocr_corrected(F.concat(F.lit("(2) "), F.col("p_name"), F.lit(" ("), F.col("p_brand"))).alias("text"))


_EV = """ev AS (SELECT user_id AS task_id, event_id, ts, CASE event_type WHEN 'click' THEN 'page_progress' WHEN 'view' THEN 'page_result' WHEN 'signup' THEN 'stage' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' END AS event, json_extract_string(props, '$.k')::INTEGER AS page FROM events),
es AS (SELECT task_id, coalesce(max(page) FILTER (event = 'page_progress'), 0) AS completed_pages, count(*) FILTER (event = 'page_result') AS n_results, count(*) AS n_events, max(ts) AS last_ts, arg_max(event, struct_pack(t := ts, e := event_id)) AS last_event, arg_max(event, struct_pack(t := ts, e := event_id)) FILTER (event IN ('done', 'error')) AS fin FROM ev GROUP BY task_id)"""
_STATE = f"WITH {_EV} SELECT task_id, coalesce(fin, 'running') AS status, completed_pages, (CASE WHEN fin = 'done' THEN 100 ELSE 15 + floor(completed_pages / 100.0::DOUBLE * 70) END)::INTEGER AS pct, n_results, n_events, last_event, last_ts FROM es"


@query(_STATE)
def task_state(spark, sf_dir):
    return tasks.state(A.task_events(table(spark, sf_dir, "events")))


@query(_STATE)
def stream_task_state(spark, sf_dir):
    """The same fold over a stream of the events' files."""
    import uuid

    from pyspark.errors import AnalysisException

    schema = table(spark, sf_dir, "events").schema
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")

        root = "file://" + tempfile.mkdtemp(prefix="pageloom-")
    at = f"{root.rstrip('/')}/{uuid.uuid4().hex}"
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    try:
        stream = reader.option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet")
    except AnalysisException:
        stream = reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return tasks.streamed_state(A.task_events(stream), f"{at}/state", f"{at}/progress")


@query("WITH e AS (SELECT json_extract_string(props, '$.k')::INTEGER AS page, event_id FROM events WHERE event_type = 'click') SELECT event_id, (15 + floor(page / 100.0::DOUBLE * 70))::INTEGER AS pct FROM e")
def task_progress_pct(spark, sf_dir):
    e = A.task_events(table(spark, sf_dir, "events")).where("event = 'page_progress'")
    return e.select("event_id", tasks.percent(F.col("page"), F.lit(100)).alias("pct"))


def _jobs(spark, sf_dir):
    """Events as jobs: the kind of event gives the status, the user the content."""
    status = F.create_map(*[F.lit(x) for x in ("click", "queued", "view", "processing", "purchase", "done", "error", "failed")])
    return table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("job_id"), F.element_at(status, F.col("event_type")).alias("status"), F.lit("text/csv").alias("mime"), F.md5(F.col("user_id").cast("string")).alias("content_hash"), F.lit(0).alias("attempts"), F.col("ts").alias("created_at"), F.col("ts").alias("updated_at")).where("status IS NOT NULL")


_JOBS = "jb AS (SELECT event_id::VARCHAR AS job_id, CASE event_type WHEN 'click' THEN 'queued' WHEN 'view' THEN 'processing' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' END AS status, md5(user_id::VARCHAR) AS content_hash, ts FROM events WHERE event_type IN ('click', 'view', 'purchase', 'error'))"


@query(f"WITH {_JOBS} SELECT s AS status, count(status) AS n FROM (VALUES ('queued'), ('processing'), ('done'), ('failed')) v(s) LEFT JOIN jb ON status = s GROUP BY s")
def queue_counts(spark, sf_dir):
    return jobs.counts(_jobs(spark, sf_dir))


@query(f"WITH {_JOBS} SELECT content_hash, arg_max(job_id, struct_pack(t := ts, j := job_id)) AS job_id FROM jb WHERE status IN ('queued', 'processing') GROUP BY content_hash")
def active_job_by_hash(spark, sf_dir):
    return jobs.active_by_content(_jobs(spark, sf_dir)).select("content_hash", "job_id")


@query(f"WITH {_JOBS}, nw AS (SELECT * FROM jb WHERE status = 'queued'), ol AS (SELECT DISTINCT content_hash FROM jb WHERE status = 'processing' AND job_id::BIGINT % 2 = 0) SELECT arg_min(job_id, struct_pack(t := ts, j := job_id)) AS job_id, content_hash FROM nw WHERE content_hash NOT IN (SELECT content_hash FROM ol) GROUP BY content_hash")
def job_dedup(spark, sf_dir):
    j = _jobs(spark, sf_dir)
    return jobs.admitted(j.where("status = 'queued'"), j.where("status = 'processing' AND cast(job_id AS bigint) % 2 = 0")).select("job_id", "content_hash")


@query(f"WITH {_JOBS} SELECT job_id FROM jb WHERE status IN ('done', 'failed') AND ts < (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def ttl_expired(spark, sf_dir):
    last = table(spark, sf_dir, "events").agg(F.max("ts")).first()[0]
    return jobs.expired(_jobs(spark, sf_dir), F.lit(last), 7 * 24 * 3600).select("job_id")
