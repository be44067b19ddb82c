"""Queries about tables: orders with their line items, and two-column forms."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import metrics, tables as T
from ..operators.tables import ENTRY, LEADER, PRESETS
from ..sources import adapters as A
from ..sources.adapters import table
from . import sql as S

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_CELLS = """lr AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS "row" FROM lineitem),
lc AS (SELECT l_orderkey AS table_id, "row", [CASE WHEN l_partkey % 7 = 0 THEN '' ELSE l_partkey::VARCHAR END, l_quantity::INT::VARCHAR, l_returnflag, floor(l_extendedprice)::BIGINT::VARCHAR] AS c FROM lr UNION ALL SELECT DISTINCT l_orderkey, 0, ['part', 'qty', 'flag', 'price'] FROM lineitem),
ce AS (SELECT table_id, "row"::INTEGER AS "row", unnest(range(4))::INTEGER AS col, unnest(c) AS text FROM lc),
tz AS (SELECT table_id, max("row") + 1 AS "rows", max(col) + 1 AS cols FROM ce GROUP BY table_id),
tb AS (SELECT table_id, doc_id, page_num, "rows", cols, 50.0::DOUBLE AS x0, y0, 545.0::DOUBLE AS x1, y0 + 200 AS y1, 880.0::DOUBLE AS height, 595.0::DOUBLE AS width, k = 2 AS needs_review FROM tz JOIN (SELECT o_orderkey AS table_id, o_custkey::BIGINT AS doc_id, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INTEGER AS page_num, o_orderkey % 3 AS k, CASE o_orderkey % 3 WHEN 0 THEN 600.0 WHEN 1 THEN 20.0 ELSE 300.0 END::DOUBLE AS y0 FROM orders) USING (table_id))"""


def _tables(spark, sf_dir):
    cells = A.cells(A.spread(table(spark, sf_dir, "lineitem")))
    return A.tables(cells, table(spark, sf_dir, "orders")), cells


def _score_sql(w):
    return f"""SELECT tb.table_id, round(f / n * {w[0]} + ev / "rows" * {w[1]} + lg / n * {w[2]}, 6) AS score FROM tb JOIN (SELECT table_id, sum(n)::DOUBLE AS n, sum(f)::DOUBLE AS f, sum(lg)::DOUBLE AS lg, sum((n = 4)::INT)::DOUBLE AS ev FROM (SELECT table_id, "row", count(*) AS n, count(*) FILTER (text <> '') AS f, count(*) FILTER (length(text) > 1) AS lg FROM ce GROUP BY ALL) GROUP BY table_id) USING (table_id)"""


for _name, _w in PRESETS.items():

    def _query(spark, sf_dir, name=_name):
        return T.scores(*_tables(spark, sf_dir), name)

    _query.__name__ = f"table_score_{_name}"
    query(f"WITH {_CELLS} {_score_sql(_w)}")(_query)


_LEAD = """CASE WHEN l_suppkey % 11 = 0 THEN 'entry ..... ' || l_suppkey ELSE 'entry ' || l_suppkey END"""


@query(f"""WITH lr AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS "row" FROM lineitem), t AS (SELECT l_orderkey AS table_id, "row", {_LEAD} AS text FROM lr),
k AS (SELECT table_id, row_number() OVER (PARTITION BY table_id ORDER BY "row") - 1 AS "row", text, count(*) OVER (PARTITION BY table_id) AS n FROM t WHERE NOT (regexp_matches(text, {S.q(ENTRY)}) OR regexp_matches(text, {S.q(LEADER)})))
SELECT table_id, "row"::INTEGER AS "row", text FROM k WHERE n >= 2""")
def table_leader_dots(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    key = F.col("l_suppkey").cast("string")
    cells = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("table_id"), (F.row_number().over(w) - 1).alias("row"), F.lit(0).alias("col"), F.when(F.col("l_suppkey") % 11 == 0, F.concat(F.lit("entry ..... "), key)).otherwise(F.concat(F.lit("entry "), key)).alias("text"))
    tables = cells.groupBy("table_id").agg((F.max("row") + 1).alias("rows"))
    return T.without_leader_rows(tables, cells)[1].select("table_id", "row", "text")


_FIG = "fg AS (SELECT table_id, count(*) AS n, count(*) FILTER (text <> '') AS f, count(*) FILTER (length(text) > 80) AS lg, sum(length(text)) AS ch FROM ce GROUP BY table_id)"
_AREA = "(x1 - x0) * (y1 - y0) / (width * height)"


@query(f"""WITH {_CELLS}, {_FIG} SELECT table_id, "rows" FROM tb JOIN fg USING (table_id) WHERE NOT ({_AREA} >= 0.8 OR cols >= 10 OR (ch / n::DOUBLE < 3 AND "rows" > 2) OR ({_AREA} >= 0.4 AND (lg >= 2 OR lg / f::DOUBLE >= 0.3)) OR (cols = 1 AND "rows" >= 2))""")
def layout_table_filter(spark, sf_dir):
    return T.genuine(*_tables(spark, sf_dir)).select("table_id", "rows")


@query(f"""WITH {_CELLS}, g AS (SELECT table_id, "row", '| ' || string_agg(text, ' | ' ORDER BY col) || ' |' AS l FROM ce GROUP BY ALL), l AS (SELECT table_id, "row" * 2 AS o, l FROM g UNION ALL SELECT table_id, 1, '| --- | --- | --- | --- |' FROM tb)
SELECT table_id, string_agg(l, chr(10) ORDER BY o) || CASE WHEN any_value(needs_review) THEN chr(10) || '> **Table may have issues - manual review recommended**' || chr(10) ELSE '' END AS markdown FROM l JOIN tb USING (table_id) GROUP BY table_id""")
def table_markdown(spark, sf_dir):
    return T.markdown(*_tables(spark, sf_dir)).select("table_id", "markdown")


@query(f"""WITH {_CELLS}, {_FIG}, gr AS (SELECT table_id, sum(length(text)) FILTER (NOT (text = '' OR regexp_matches(text, '^[\\s·…]+$'))) AS c, avg((text = '' OR regexp_matches(text, '^[\\s·…]+$'))::INT) AS e FROM ce GROUP BY table_id) SELECT table_id, coalesce(c, 0) <= 50 AND e > 0.75 AS is_junk FROM gr JOIN tb USING (table_id)""")
def junk_tables(spark, sf_dir):
    return T.markdown(*_tables(spark, sf_dir)).select("table_id", "is_junk")


@query(f"""WITH {_CELLS}, h AS (SELECT table_id, md5(coalesce(string_agg(text, '|' ORDER BY text COLLATE "C") FILTER (text <> ''), '')) AS content_hash FROM ce GROUP BY table_id) SELECT table_id, content_hash FROM h JOIN tb USING (table_id) QUALIFY row_number() OVER (PARTITION BY doc_id, page_num, content_hash ORDER BY table_id) = 1""".replace(' COLLATE "C"', ""))
def table_dedup(spark, sf_dir):
    return T.first_of_content(*_tables(spark, sf_dir)).select("table_id", "content_hash")


_JOIN = """tn AS (SELECT *, count(*) OVER (PARTITION BY doc_id, page_num) AS n, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY y0, table_id) AS i FROM tb),
ta AS (SELECT a.doc_id, a.page_num, a.table_id AS into_, a.n, a."rows" AS ar, f.table_id AS nx, coalesce(a.cols = f.cols AND a.y1 >= a.height * 0.8 AND f.y0 <= f.height * 0.2, false) AS fits FROM (SELECT * FROM tn WHERE i = n) a LEFT JOIN (SELECT * FROM tn WHERE i = 1) f ON a.doc_id = f.doc_id AND f.page_num = a.page_num + 1),
tr AS (SELECT *, sum(nw) OVER (PARTITION BY doc_id ORDER BY page_num) AS run FROM (SELECT *, (NOT coalesce(lag(fits) OVER w, false) OR n > 1 OR lag(page_num) OVER w <> page_num - 1)::INT AS nw FROM ta WINDOW w AS (PARTITION BY doc_id ORDER BY page_num))),
tk AS (SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY page_num) AS k FROM tr)"""


@query(re.sub(r"\b(\w+) AS \(SELECT", r"\1 AS MATERIALIZED (SELECT", f"""WITH {_CELLS}, {_JOIN}, m AS (SELECT nx AS table_id, into_, ar - 1 AS off FROM tk WHERE fits AND k % 2 = 1) SELECT coalesce(into_, ce.table_id) AS table_id, ("row" + coalesce(off, 0))::INTEGER AS "row", col, text FROM ce LEFT JOIN m USING (table_id) WHERE off IS NULL OR "row" >= 1"""))
def cross_page_tables(spark, sf_dir):
    """Every order's table has the same header row, which goes where a table continues."""
    t, c = _tables(spark, sf_dir)
    return T.joined_cells(c, T.across_pages(t, c))


def _forms(spark, sf_dir):
    """Nations with their regions, ten a table."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    base = n.select(F.floor(F.col("n_nationkey") / 10).cast("long").alias("table_id"), (F.col("n_nationkey") % 10).cast("int").alias("row"), F.array("n_name", "r_name").alias("c"))
    cells = base.select("table_id", "row", F.posexplode("c").alias("col", "text"))
    tables = cells.groupBy("table_id").agg((F.max("row") + 1).alias("rows"), F.lit(2).alias("cols")).withColumn("needs_review", F.lit(False))
    return tables, cells


_FORM = """n AS (SELECT n_nationkey // 10 AS table_id, n_nationkey % 10 AS "row", n_name AS a, r_name AS b FROM nation JOIN region ON n_regionkey = r_regionkey),
fm AS (SELECT table_id, count(*) FILTER (length(a) BETWEEN 2 AND 30 AND length(b) > 0 AND (regexp_matches(a, '[:：]$') OR (length(a) <= 15 AND length(b) > length(a)))) AS hits, max("row") + 1 AS "rows" FROM n GROUP BY table_id)"""


@query(f"WITH {_FORM} SELECT table_id::BIGINT AS table_id, \"rows\" >= 2 AND hits >= \"rows\" * 0.6 AS is_form FROM fm")
def form_tables(spark, sf_dir):
    return T.form_like(*_forms(spark, sf_dir))


@query(f"""WITH {_FORM} SELECT table_id::BIGINT AS table_id, CASE WHEN any_value(hits) >= any_value("rows") * 0.6 THEN string_agg('**' || a || '**: ' || b, chr(10) || chr(10) ORDER BY "row")
  ELSE string_agg(CASE WHEN "row" = 0 THEN '| ' || a || ' | ' || b || ' |' || chr(10) || '| --- | --- |' ELSE '| ' || a || ' | ' || b || ' |' END, chr(10) ORDER BY "row") END AS markdown FROM n JOIN fm USING (table_id) GROUP BY table_id""")
def form_markdown(spark, sf_dir):
    return T.markdown(*_forms(spark, sf_dir)).select("table_id", "markdown")


@query(f"""WITH {_CELLS} SELECT table_id, "row", col, text FROM ce""")
def markdown_table_parse(spark, sf_dir):
    """Tables written as Markdown and read again give the same cells."""
    t, c = _tables(spark, sf_dir)
    md = T.markdown(t.withColumn("needs_review", F.lit(False)), c)
    return T.from_markdown(md.select(F.col("table_id").alias("id"), F.col("markdown").alias("text"))).withColumnRenamed("id", "table_id")


@query(f"""WITH {_CELLS}, h AS (SELECT DISTINCT table_id, "row", col, CASE WHEN (table_id + "row" + col) % 5 = 0 THEN 'x' ELSE lower(text) END AS t FROM ce), r AS (SELECT DISTINCT table_id, "row", col, lower(text) AS t FROM ce),
j AS (SELECT coalesce(h.table_id, r.table_id) AS table_id, count(h.t) AS h, count(r.t) AS r, count(*) FILTER (h.t IS NOT NULL AND r.t IS NOT NULL) AS b FROM h FULL JOIN r ON h.table_id = r.table_id AND h."row" = r."row" AND h.col = r.col AND h.t = r.t GROUP BY 1)
SELECT table_id, round(b / h::DOUBLE, 4) AS "precision", round(b / r::DOUBLE, 4) AS recall, round(CASE WHEN b > 0 THEN 2 * (b / h::DOUBLE) * (b / r::DOUBLE) / (b / h::DOUBLE + b / r::DOUBLE) ELSE 0 END, 4) AS f1 FROM j""")
def table_f1(spark, sf_dir):
    """Cells with planted errors against the true ones."""
    c = A.cells(table(spark, sf_dir, "lineitem"))
    return metrics.table_f1(c.withColumn("text", F.when((F.col("table_id") + F.col("row") + F.col("col")) % 5 == 0, "x").otherwise(F.col("text"))), c)


@query(r"SELECT p_partkey, trim(regexp_replace(regexp_replace('(cid:' || p_size || ') ' || p_name || chr(10) || p_type || '  ' || p_brand || '····', '\(cid:\s*\d+\s*\)', '', 'g'), '\s+', ' ', 'g'), ' ·') AS cell FROM part")
def cell_clean(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", X.clean_cell(F.concat(F.lit("(cid:"), F.col("p_size").cast("string"), F.lit(") "), F.col("p_name"), F.lit("\n"), F.col("p_type"), F.lit("  "), F.col("p_brand"), F.lit("····"))).alias("cell"))
