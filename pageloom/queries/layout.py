"""Queries that join text blocks with layout boxes, images and table regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layout as L
from ..operators.layout import BOX_TYPES, CAPTION, LABEL_TYPES, ROUTES
from ..sources import adapters as A
from . import sql as S
from .text import _HC, _headings, blocks

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_BEST = f"""bb AS (SELECT doc_id, page_num, seq, m.label AS label, m.confidence AS box_confidence, m.ord AS ord, m.iou AS iou FROM (SELECT b.doc_id, b.page_num, b.seq, arg_max(struct_pack(label := bx.label, confidence := bx.confidence, ord := bx.ord, iou := {S.iou("b.", "bx.")}), struct_pack(i := {S.iou("b.", "bx.")}, o := -bx.ord)) AS m
  FROM b JOIN bx ON b.doc_id = bx.doc_id AND b.page_num = bx.page_num AND {S.iou("b.", "bx.")} >= 0.3 GROUP BY ALL))"""
_case = lambda c, d: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {v if isinstance(v, int) else repr(v)}" for k, v in d.items()) + " END"
_KIND = _case(f"lower({S.strip('label')})", {k: v[0] for k, v in LABEL_TYPES.items()})
_LEVEL = _case(f"lower({S.strip('label')})", {k: v[1] for k, v in LABEL_TYPES.items()})


@query(S.with_ctes(f"SELECT hc.doc_id, hc.page_num, hc.seq, label, coalesce({_KIND}, block_type) AS block_type, coalesce(CASE WHEN {_KIND} = 'heading' AND heading_level > 0 THEN heading_level ELSE {_LEVEL} END, heading_level)::INTEGER AS heading_level FROM hc LEFT JOIN bb USING (doc_id, page_num, seq)", _HC, _BEST))
def layout_label(spark, sf_dir):
    b = blocks(spark, sf_dir)
    return L.labelled(_headings(spark, sf_dir), A.layout_boxes(b)).select("doc_id", "page_num", "seq", "label", "block_type", "heading_level")


_BOX = f"coalesce({_case('label', BOX_TYPES)}, 'unknown')"
_MERGED = f"""lm AS (SELECT hc.doc_id, hc.page_num, hc.seq, ord, text, CASE WHEN label IS NOT NULL AND box_confidence > confidence THEN {_BOX} ELSE block_type END AS block_type, greatest(confidence, box_confidence) AS confidence, CASE WHEN label IS NOT NULL THEN 'text+layout' ELSE 'text' END AS source
  FROM hc LEFT JOIN bb USING (doc_id, page_num, seq) UNION ALL SELECT doc_id, page_num, NULL, ord, '', {_BOX}, confidence, 'layout' FROM bx WHERE NOT EXISTS (SELECT 1 FROM bb WHERE bb.doc_id = bx.doc_id AND bb.page_num = bx.page_num AND bb.ord = bx.ord))"""


def _merged(spark, sf_dir):
    return L.merged(_headings(spark, sf_dir), A.layout_boxes(blocks(spark, sf_dir)))


@query(S.with_ctes("SELECT doc_id, page_num, coalesce(seq, -1)::INTEGER AS seq, coalesce(ord, -1)::INTEGER AS ord, text, block_type, confidence, source FROM lm", _HC, _BEST, _MERGED))
def layout_merge(spark, sf_dir):
    return _merged(spark, sf_dir).na.fill(-1, ["seq", "ord"])


_ROUTE = "CASE " + " ".join(f"WHEN block_type = '{k}' AND confidence >= {lo} AND confidence < {hi} THEN '{a}'" for k, lo, hi, a, _ in sorted(ROUTES, key=lambda r: -r[4])) + " ELSE 'fallback' END"


@query(S.with_ctes(f"SELECT block_type, {_ROUTE} AS action, count(*) AS n FROM lm GROUP BY ALL", _HC, _BEST, _MERGED))
def route_blocks(spark, sf_dir):
    return L.routed(_merged(spark, sf_dir)).groupBy("block_type", "action").agg(F.count(F.lit(1)).alias("n"))


_IM = "im AS (SELECT doc_id, page_num, seq AS img, 100.0::DOUBLE AS x0, (20 + 85 * (seq % 10) + 82)::DOUBLE AS y0, 300.0::DOUBLE AS x1, (20 + 85 * (seq % 10) + 84)::DOUBLE AS y1 FROM b WHERE seq % 10 = 5)"
_GAP = "CASE WHEN b.y0 >= im.y1 THEN b.y0 - im.y1 WHEN im.y0 >= b.y1 THEN im.y0 - b.y1 ELSE 0.0 END"
_SCORE = f"((100.0 - {_GAP}) / 100.0 + CASE WHEN regexp_matches(b.text, {S.q(CAPTION)}) THEN 10.0 ELSE 0.0 END + CASE WHEN bb.label = 'Caption' THEN 20.0 ELSE 0.0 END)"


@query(S.with_ctes(f"""SELECT doc_id, page_num, img, CASE WHEN m.s >= 1.0 THEN {S.strip("m.t")} END AS caption FROM im LEFT JOIN (SELECT im.doc_id, im.page_num, im.img, arg_max(struct_pack(t := b.text, s := {_SCORE}), struct_pack(s := {_SCORE}, o := -b.seq)) AS m
  FROM im JOIN b ON im.doc_id = b.doc_id AND im.page_num = b.page_num AND {_GAP} <= 100.0 LEFT JOIN bb ON b.doc_id = bb.doc_id AND b.page_num = bb.page_num AND b.seq = bb.seq GROUP BY ALL) USING (doc_id, page_num, img)""", _BEST, _IM))
def caption_match(spark, sf_dir):
    b = blocks(spark, sf_dir)
    lab = b.join(L.best_box(b, A.layout_boxes(b)).select("doc_id", "page_num", "seq", "label"), ["doc_id", "page_num", "seq"], "left")
    im = b.where("seq % 10 = 5").select("doc_id", "page_num", F.col("seq").alias("img"), F.lit(100.0).alias("x0"), (20 + 85 * (F.col("seq") % 10) + 82).cast("double").alias("y0"), F.lit(300.0).alias("x1"), (20 + 85 * (F.col("seq") % 10) + 84).cast("double").alias("y1"))
    return L.captions(im, lab).select("doc_id", "page_num", "img", "caption")


@query(S.with_ctes(f"SELECT doc_id, page_num, count(*) AS n FROM b WHERE NOT EXISTS (SELECT 1 FROM bx WHERE bx.label = 'List' AND bx.doc_id = b.doc_id AND bx.page_num = b.page_num AND {S.cross('b.', 'bx.')} > 0 AND {S.area('b.')} > 0 AND {S.cross('b.', 'bx.')} / {S.area('b.')} > 0.3) GROUP BY ALL"))
def text_outside_tables(spark, sf_dir):
    b = blocks(spark, sf_dir)
    return L.outside(b, A.layout_boxes(b).where("label = 'List'")).groupBy("doc_id", "page_num").agg(F.count(F.lit(1)).alias("n"))


@query(S.with_ctes(f"SELECT doc_id, page_num, ord, label FROM bx WHERE NOT EXISTS (SELECT 1 FROM bx t WHERE t.label = 'Title' AND t.doc_id = bx.doc_id AND t.page_num = bx.page_num AND {S.iou('bx.', 't.')} > 0.3)"))
def table_hints_uncovered(spark, sf_dir):
    x = A.layout_boxes(blocks(spark, sf_dir))
    return L.uncovered(x, x.where("label = 'Title'")).select("doc_id", "page_num", "ord", "label")


_COLS = """cg AS (SELECT doc_id, page_num, list(struct_pack(a := r, b := x0) ORDER BY r) AS cuts FROM (SELECT DISTINCT doc_id, page_num, r, x0 FROM (SELECT *, max(x1) OVER (PARTITION BY doc_id, page_num ORDER BY x0, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM b) WHERE x0 > r + 2 AND x0 - r >= width * 0.05) GROUP BY ALL),
cp AS (SELECT doc_id, page_num, count(*) AS n, any_value(width) AS width, list((x0 + x1) / 2) AS centers FROM b GROUP BY ALL),
cs AS (SELECT doc_id, page_num, n, width, len(cuts) AS nc, list_filter(list_transform(range(0, len(cuts) + 1), lambda i: struct_pack(s := CASE WHEN i = 0 THEN 0.0::DOUBLE ELSE cuts[i].b END, e := CASE WHEN i = len(cuts) THEN width ELSE cuts[i + 1].a END)), lambda c: c.e > c.s AND len(list_filter(centers, lambda z: z >= c.s AND z <= c.e)) >= 3) AS sp FROM cp JOIN cg USING (doc_id, page_num)),
cl AS (SELECT doc_id, page_num, coalesce(CASE WHEN cp.n >= 6 AND len(sp) > 1 AND len(sp) <= 4 THEN len(sp) END, 1)::INTEGER AS n_columns, sp FROM cp LEFT JOIN cs USING (doc_id, page_num))"""


@query(S.with_ctes("SELECT doc_id, page_num, n_columns FROM cl", _COLS))
def columns_detect(spark, sf_dir):
    return L.columns(blocks(spark, sf_dir)).select("doc_id", "page_num", "n_columns")


_FAR = "list_transform(sp, lambda c: abs((x0 + x1) / 2 - (c.s + c.e) / 2))"


@query(S.with_ctes(f"""SELECT doc_id, page_num, seq, col AS "column", row_number() OVER (PARTITION BY doc_id, page_num ORDER BY col, CASE WHEN n_columns > 1 THEN y0 END, CASE WHEN n_columns > 1 THEN x0 END, seq)::INTEGER AS read_order FROM (SELECT b.*, n_columns, CASE WHEN n_columns > 1 THEN list_position({_FAR}, list_min({_FAR})) - 1 ELSE 0 END::INTEGER AS col FROM b JOIN cl USING (doc_id, page_num))""", _COLS))
def columns_reorder(spark, sf_dir):
    b = blocks(spark, sf_dir)
    return L.in_column_order(b, L.columns(b)).select("doc_id", "page_num", "seq", "column", "read_order")


@query()
def reading_order_layout(spark, sf_dir):
    """Each choice depends on those before; tests hold it against a plain model."""
    b = blocks(spark, sf_dir)
    return L.in_layout_order(b, A.layout_boxes(b))
