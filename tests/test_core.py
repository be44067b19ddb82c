"""The document operators against small cases and plain models."""

import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from pageloom.functions import codec, geometry, quality, text
from pageloom.operators import chunks, classify, layout, metrics, noise, pages, render, structure, tables
from pageloom.queries import registry
from pageloom.sources import adapters
from pageloom.streaming import jobs, tasks

BLOCK = "doc_id long, page_num int, seq int, text string, x0 double, y0 double, x1 double, y1 double, size double, is_bold boolean, confidence double, width double, height double"


def block(seq, text="line of text", x0=50.0, y0=None, x1=545.0, h=12.0, size=10.0, bold=False, page=1, doc=1, conf=1.0):
    y = 100.0 + 15 * seq if y0 is None else y0
    return (doc, page, seq, text, x0, y, x1, y + h, size, bold, conf, 600.0, 800.0)


def one(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").repartition(1)
    return [r.v for r in df.select("i", expr(F.col("t")).alias("v")).orderBy("i").collect()]


def test_page_numbers(spark):
    assert one(spark, ["42", "- 5 -", "Page 12", "3/20", "제3쪽", "상태 OK", "제1조 (목적)", "이 약관에서 사용하는 용어", "page 3 of 9"], text.is_page_number) == [True] * 6 + [False, False, True]
    assert one(spark, ["상품명 31", "31 무배당 프로미라이프", "42", "제1조 목적", "a   b"], text.normalized) == ["상품명", "무배당 프로미라이프", "", "제1조 목적", "a b"]


def test_text_repairs(spark):
    assert one(spark, ["a ●b", "●x\n○ y", "• z"], text.bullets) == ["a\n- b", "- x\n  - y", "- z"]
    assert one(spark, ["a(cid:12) b\n c···· d", "상태 OK", " x   y "], text.clean_cell) == ["a b c d", "", "x y"]
    assert one(spark, ["(3) 웰", "임 (", "(25) x", "plain"], text.ocr_corrected) == ["\n③ 월", "입 ()", "\n(25)  x", "plain"]
    assert one(spark, ["", "a", "123456789"], text.tokens) == [1, 1, 4]
    fine = "전화 번호"
    assert codec.repaired(fine.encode().decode("latin1")) == fine and codec.repaired("café Müller") == "café Müller"
    assert one(spark, [fine.encode().decode("latin1"), "naïve  text", "(cid:3)x"], codec.repair) == [fine, "naïve text", "x"]


def test_quality(spark):
    assert one(spark, ["", "Hi"], quality.language_consistency) == [1.0, 1.0]
    score = one(spark, ["A clean sentence in plain letters."], lambda c: quality.composite(quality.signals(c)))[0]
    assert score == pytest.approx(0.94)
    assert one(spark, ["ab", "words", " "], quality.is_undecodable) == [True, False, False]
    korean = one(spark, ["보험금을 지급합니다", "ㅂㅎ ㄱㅡㅁ ㅈㅣ", "plain", "1가2나3다 라4마 5바"], quality.korean_garbled)
    assert korean[0] < 0.3 and korean[1] >= 0.3 and korean[2] == 0 and korean[3] >= 0.3
    got = spark.createDataFrame([("(cid:1)(cid:2)(cid:3)(cid:4)(cid:5) text here",), ("fine text in it",)], "t string").select(*(v.alias(k) for k, v in quality.gate(F.col("t")).items())).collect()
    assert got[0].needs_repair and got[0].repair_method == "confidence_downgrade" and got[1].repair_method == "none"


def test_geometry(spark):
    df = spark.createDataFrame([(0.0, 0.0, 100.0, 100.0, 50.0, 50.0, 150.0, 150.0), (0.0, 0.0, 1.0, 1.0, 0.0, 0.0, 1.0, 1.0), (0.0, 0.0, 1.0, 1.0, 2.0, 2.0, 3.0, 3.0), (1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)], "x0 double, y0 double, x1 double, y1 double, b_x0 double, b_y0 double, b_x1 double, b_y1 double")
    assert [r.v for r in df.select(geometry.iou(geometry.box(), geometry.box("b_")).alias("v")).collect()] == [pytest.approx(2500 / 17500), 1.0, 0.0, 0.0]


def test_hierarchy_is_a_stack(spark):
    r = random.Random(1)
    rows = []
    for page in range(1, 30):
        for seq in range(r.randint(1, 25)):
            level = r.choice([0, 0, 1, 2, 3, 4, 5, 6])
            rows.append((*block(seq, f"t{page}.{seq}", page=page), "heading" if level else "text", level))
    df = spark.createDataFrame(rows, BLOCK + ", block_type string, heading_level int")
    got = {(x.page_num, x.seq): (x.block_id, x.parent_id) for x in structure.hierarchy(df).collect()}
    stack, page = [], 0
    for x in rows:
        if x[1] != page:
            stack, page = [], x[1]
        level = x[-1]
        if level:
            while stack and stack[-1][0] >= level:
                stack.pop()
        own, parent = got[x[1], x[2]]
        assert parent == (stack[-1][1] if stack else None) and len(own) == 12
        if level:
            stack.append((level, own))


def test_broken_lines_pairwise(spark):
    r = random.Random(4)
    lines = [(d, i, r.choice(["word goes on", "ends here.", "# head", "", "  next one", "more text"])) for d in range(20) for i in range(25)]
    got = {}
    for x in structure.merged_broken_lines(spark.createDataFrame(lines, "doc_id long, line_no int, line string")).orderBy("doc_id", "line_no").collect():
        got.setdefault(x.doc_id, []).append(x.line)
    for d in range(20):
        own, want, i = [x[2] for x in lines if x[0] == d], [], 0
        can = lambda a, b: bool(a.strip()) and not a.strip().startswith("#") and a.strip()[-1] != "." and bool(b.strip()) and not b.strip().startswith("#")
        while i < len(own):
            if i + 1 < len(own) and can(own[i], own[i + 1]):
                lead = own[i][: len(own[i]) - len(own[i].strip())]
                want.append(lead + own[i].strip() + " " + own[i + 1].strip())
                i += 2
            else:
                want.append(own[i])
                i += 1
        assert got[d] == want


def test_line_merge(spark):
    cases = {
        1: ([("first part", {}), ("second part", {})], 1), 2: ([("first", {}), ("제1조 목적 ", {})], 2), 3: ([("first", {}), ("① x", {})], 2), 4: ([("first", {}), ("x", {"y0": 300.0})], 2),
        5: ([("first", {}), ("x", {"x0": 80.0})], 2), 6: ([("first", {}), ("x", {"size": 14.0})], 2), 7: ([("open (", {}), ("제1조 x) ", {})], 1), 8: ([("a,", {}), ("b", {"x0": 90.0})], 1), 9: ([("보험", {}), ("금액", {})], 1),
    }
    rows = [(*block(i, t, doc=d, **k), "text", 0) for d, (bs, _) in cases.items() for i, (t, k) in enumerate(bs)]
    df = spark.createDataFrame(rows, BLOCK + ", block_type string, heading_level int")
    stats = spark.createDataFrame([(d, 10.0, 3.0) for d in cases], "doc_id long, avg_font_size double, avg_line_gap double")
    got = {}
    for x in structure.merged_lines(df, stats).collect():
        got.setdefault(x.doc_id, []).append(x.text)
    assert {d: len(v) for d, v in got.items()} == {d: n for d, (_, n) in cases.items()}
    assert got[1] == ["first part second part"] and got[7] == ["open (제1조 x)"] and got[9] == ["보험금액"]


def test_profiles(spark):
    rows = [("제1편 총칙", "heading", 1), ("제2장 보험", "heading", 2), ("제3조(목적) ", "heading", 4), ("① 회사는", "clause", 0), ("가) 항목", "item", 0), ("2.1 제목", "heading", 4), ("1. 보험금", "subclause", 0), ("나. 보험", "subclause", 0), ("그냥 글", "text", 0)]
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(rows)], "i int, t string").repartition(1).orderBy("i")
    got = [(r.k.block_type, r.k.heading_level) for r in df.select(classify.korean_legal(F.col("t"), F.lit(10.0), F.lit(False), F.lit(10.0)).alias("k")).collect()]
    assert got == [(k, v) for _, k, v in rows]
    eng = spark.createDataFrame([("Chapter 3 Intro",), ("1.2.3 Deep",), ("Figure 2 shows",), ("- item",), ("plain",)], "t string").select(classify.english_academic(F.col("t"), F.lit(10.0), F.lit(False), F.lit(10.0)).alias("k")).collect()
    assert [(r.k.block_type, r.k.heading_level) for r in eng] == [("heading", 1), ("heading", 4), ("item", 0), ("item", 0), ("text", 0)]
    assert classify.profile("nothing") is classify.korean_legal


def test_cover_and_columns(spark):
    cover = [block(i, "Title", x0=200.0, x1=400.0, size=18.0) for i in range(3)]
    other = [block(i, "Title", x0=200.0, x1=400.0, size=10.0, page=2) for i in range(3)]
    b = spark.createDataFrame(cover + other, BLOCK)
    assert [r.page_num for r in pages.page_stats(b).where(pages.is_cover()).collect()] == [1]
    two = [block(i, "t", x0=50.0, x1=250.0) for i in range(5)] + [block(10 + i, "t", x0=350.0, x1=550.0, y0=100.0 + 15 * i) for i in range(5)]
    c = layout.columns(spark.createDataFrame(two, BLOCK))
    assert [r.n_columns for r in c.collect()] == [2]
    order = [r.seq for r in layout.in_column_order(spark.createDataFrame(two[::-1], BLOCK), c).orderBy("read_order").collect()]
    assert order == [0, 1, 2, 3, 4, 10, 11, 12, 13, 14]
    assert [r.n_columns for r in layout.columns(spark.createDataFrame(two[:2], BLOCK)).collect()] == [1]


def test_captions_and_routes(spark):
    img = spark.createDataFrame([(1, 1, 7, 100.0, 100.0, 300.0, 200.0)], "doc_id long, page_num int, img int, x0 double, y0 double, x1 double, y1 double")
    near = spark.createDataFrame([block(0, "그림 1: 흐름도", y0=210.0), block(1, "other", y0=600.0)], BLOCK)
    assert layout.captions(img, near).first().caption == "그림 1: 흐름도"
    assert layout.captions(img, spark.createDataFrame([block(1, "other", y0=500.0)], BLOCK)).first().caption is None
    rows = spark.createDataFrame([("table", 0.9), ("table", 0.5), ("text", 0.4), ("text", 1.0), ("chart", 0.1), ("strange", 1.0)], "block_type string, confidence double")
    assert [r.action for r in layout.routed(rows).collect()] == ["table_reader", "vlm_crop", "fallback", "markdown", "vlm_chart", "fallback"]


def test_layout_order_is_greedy(spark):
    b = [block(i, "t", y0=20.0 * i, h=15.0) for i in range(6)]
    x = spark.createDataFrame([(1, 1, 0, 50.0, 60.0, 545.0, 76.0), (1, 1, 1, 50.0, 61.0, 545.0, 77.0), (1, 1, 2, 50.0, 0.0, 545.0, 14.0)], "doc_id long, page_num int, ord int, x0 double, y0 double, x1 double, y1 double")
    got = [r.seq for r in layout.in_layout_order(spark.createDataFrame(b, BLOCK), x).orderBy("read_order").collect()]
    assert got == [3, 0, 1, 2, 4, 5]


TABLE = "table_id long, doc_id long, page_num int, rows int, cols int, x0 double, y0 double, x1 double, y1 double, height double, width double, needs_review boolean"


def _cells(spark, grids):
    return spark.createDataFrame([(t, r, c, v) for t, g in grids.items() for r, row in enumerate(g) for c, v in enumerate(row)], "table_id long, row int, col int, text string")


def test_tables(spark):
    grids = {1: [["A", "B"], ["1", "2"]], 2: [["A", "B", "C"], ["1", "2"]], 3: [["Name", "Value"], ["A", "1"]], 4: [["이름:", "홍길동"], ["주소:", "서울시"]]}
    t = spark.createDataFrame([(i, 1, 1, 2, max(map(len, g)), 0.0, 0.0, 100.0, 50.0, 800.0, 600.0, False) for i, g in grids.items()] + [(9, 1, 1, 0, 0, 0.0, 0.0, 1.0, 1.0, 800.0, 600.0, True)], TABLE)
    c = _cells(spark, grids)
    s = {r.table_id: r.score for r in tables.scores(t, c).collect()}
    assert s[1] == 0.75 and s[2] == 0.575 and s[9] == 0.0
    md = {r.table_id: r.markdown for r in tables.markdown(t, c).collect()}
    assert md[3] == "| Name | Value |\n| --- | --- |\n| A | 1 |" and md[4] == "**이름**: 홍길동\n\n**주소**: 서울시" and "failed" in md[9]
    back = {(r.id, r.row, r.col): r.text for r in tables.from_markdown(spark.createDataFrame([(3, md[3])], "id long, text string")).collect()}
    assert back == {(3, 0, 0): "Name", (3, 0, 1): "Value", (3, 1, 0): "A", (3, 1, 1): "1"}


def test_merged_cells(spark):
    t = spark.createDataFrame([(1, 1, 1, 2, 3, 0.0, 0.0, 1.0, 1.0, 800.0, 600.0, False)], TABLE)
    c = spark.createDataFrame([(1, 0, 0, "wide", 1, 2), (1, 0, 2, "c|d", 2, 1), (1, 1, 0, "x", 1, 1)], "table_id long, row int, col int, text string, rowspan int, colspan int")
    assert {r.row: r.texts for r in tables.grid(t, c).collect()} == {0: ["wide", "wide", "c\\|d"], 1: ["x", "", "c\\|d"]}


def test_tables_across_pages(spark):
    grids = {i: [["H", "K"], [str(i), "v"], ["w", "z"]][: 3 if i < 3 else 2] for i in range(1, 5)}
    low, top = (600.0, 790.0), (10.0, 790.0)
    t = spark.createDataFrame([(i, 1, i, len(g), 2, 0.0, (low if i == 1 else top)[0], 100.0, (low if i == 1 else top)[1], 800.0, 600.0, False) for i, g in grids.items()], TABLE)
    j = tables.across_pages(t, _cells(spark, grids))
    assert sorted((r.table_id, r.into, r.row_offset) for r in j.collect()) == [(2, 1, 2), (4, 3, 1)]
    out = tables.joined_cells(_cells(spark, grids), j)
    assert {r.table_id: r.n for r in out.groupBy("table_id").agg((F.max("row") + 1).alias("n")).collect()} == {1: 5, 3: 3}


def test_chunks(spark):
    b = [(*block(i, "x" * n), "text", 0) for i, n in enumerate([6, 8, 4, 18])]
    df = spark.createDataFrame(b, BLOCK + ", block_type string, heading_level int")
    got = [(r.chunk_id, r.token_count) for r in chunks.fixed(df, F.lit("s"), 6).orderBy("chunk_id").collect()]
    assert got == [("s-0000", 3), ("s-0001", 6), ("s-0002", 9)]
    h = [(*block(0, "Top"), "heading", 1), (*block(1, "body"), "text", 0), (*block(2, "Sub"), "heading", 2), (*block(3, "more"), "text", 0), (*block(4, "Next"), "heading", 1)]
    got = chunks.by_title(spark.createDataFrame(h, BLOCK + ", block_type string, heading_level int"), F.lit("d")).orderBy("chunk_id").collect()
    assert [(r.text, r.heading_path) for r in got] == [("Top\n\nTop\nbody", ["Top"]), ("Top > Sub\n\nSub\nmore", ["Top", "Sub"]), ("Next\n\nNext", ["Next"])]
    with pytest.raises(ValueError, match="unknown strategy"):
        chunks.chunked(df, F.lit("s"), "other")
    text_ = json.loads(chunks.as_json(chunks.by_page(df, F.lit("s"))).first().json)
    assert text_["chunk_id"] == "s-0000" and text_["page_numbers"] == [1]


def test_tree(spark):
    h = [(*block(0, "A"), "heading", 1), (*block(1, "b"), "text", 0), (*block(0, "C", page=2), "heading", 2), (*block(1, "d", page=2), "text", 0), (*block(2, "E", page=2), "heading", 1), (*block(3, "1", page=2), "page_number", 0)]
    n = render.tree(spark.createDataFrame(h, BLOCK + ", block_type string, heading_level int"))
    assert [(r.text, r.parent_ord) for r in n.orderBy("ord").collect()] == [("A", None), ("b", 1), ("C", 1), ("d", 3), ("E", None)]
    assert render.tree_markdown(n).first().markdown == "# A\n\nb\n\n## C\n\nd\n\n# E"


def test_error_rates(spark):
    df = spark.createDataFrame([("abcd", "abce"), ("", ""), ("something", ""), ("가나다", "가나라")], "h string, r string")
    assert [r.v for r in df.select(metrics.error_rate(F.col("h"), F.col("r")).alias("v")).collect()] == [0.25, 0.0, 1.0, pytest.approx(1 / 3)]
    f = metrics.table_f1(_cells(spark, {1: [["a", "b"], ["c", "x"]]}), _cells(spark, {1: [["a", "b"], ["c", "d"]]})).first()
    assert (f.precision, f.recall, f.f1) == (0.75, 0.75, 0.75)


def test_jobs(spark):
    import datetime

    at = datetime.datetime(2024, 1, 1, 12)
    j = spark.createDataFrame([("a", "queued", "csv", "h1", 0, at, at), ("b", "done", "csv", "h2", 0, at, at), ("c", "processing", "csv", "h1", 0, at + datetime.timedelta(1), at)], "job_id string, status string, mime string, content_hash string, attempts int, created_at timestamp, updated_at timestamp")
    assert {r.status: r.n for r in jobs.counts(j).collect()} == {"queued": 1, "processing": 1, "done": 1, "failed": 0}
    assert [r.job_id for r in jobs.active_by_content(j).collect()] == ["c"]
    new = spark.createDataFrame([("x", "queued", "csv", "h1", 0, at, at), ("y", "queued", "csv", "h2", 0, at, at), ("z", "queued", "csv", "h2", 0, at, at)], j.schema)
    assert [r.job_id for r in jobs.admitted(new, j).collect()] == ["y"]
    once = jobs.recovered(j)
    assert once.where("status = 'queued'").count() == 2 and jobs.recovered(once).exceptAll(once).isEmpty()
    done = jobs.finished(j, spark.createDataFrame([("c", False, at)], "job_id string, ok boolean, at timestamp"))
    assert {r.job_id: (r.status, r.attempts) for r in done.collect()}["c"] == ("failed", 1)
    assert [r.job_id for r in jobs.expired(j, F.lit(at + datetime.timedelta(hours=2))).collect()] == ["b"]
    assert one(spark, ["[page] 3/9", "[2/7] profile", "other"], lambda c: tasks.parsed_line(c)["event"]) == ["page_progress", "stage", None]


SF = "/root/testdata/sf0.001"


def test_cer_every_item(spark, tmp_path):
    """Accented and other letters get a row each, and one edit a letter."""
    texts = ["plain words", "été à l’école", "größer  als\ndie Straße", "¿dónde está?" * 30, "가나다 라", "long enough " * 25, " ", None]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            above, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
        return row[-1]

    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    one = [(i, " ".join(t.split())) for i, t in enumerate(texts) if t and t.strip()]
    want = {i: pytest.approx(distance(t[:200] + "x", t) / len(t), abs=1e-6) for i, t in one}
    assert {r.item_id: r.cer for r in registry.QUERIES["cer_every_item"](spark, str(tmp_path)).collect()} == want
    ascii_only = {r.item_id for r in registry.QUERIES["cer"](spark, str(tmp_path)).collect()}
    assert ascii_only == {0, 5}


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "orders", "lineitem", "part", "events", "documents", "benchmark", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, SF), con.sql(registry.ORACLES[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    key = lambda rows, names: sorted(repr([round(v, 6) if isinstance(v, float) else v for _, v in sorted(zip(names, r))]) for r in rows)
    assert key([tuple(r) for r in got.collect()], got.columns) == key(want.fetchall(), want.columns)
