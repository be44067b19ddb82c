"""Overlaps, results of documents, similarity, tokenizers, sinks, PDF lines."""

import pytest
from pyspark.sql import functions as F

from pageloom.functions import codec, similarity
from pageloom.operators import overlap, results, tables, tokenized
from pageloom.sources import pdf, sinks
from pageloom.streaming import tasks

BOX = "doc_id long, page_num int, seq int, x0 double, y0 double, x1 double, y1 double"


def test_overlap(spark):
    known = spark.createDataFrame([(1, 1, 0, 0.0, 0.0, 10.0, 10.0)], BOX)
    found = spark.createDataFrame([(1, 1, 1, 2.0, 2.0, 9.0, 9.0), (1, 1, 2, 9.0, 9.0, 20.0, 20.0), (1, 2, 3, 0.0, 0.0, 10.0, 10.0)], BOX)
    assert sorted(r.seq for r in overlap.beside(found, known).collect()) == [2, 3]
    im = spark.createDataFrame([(1, 1, i, x, 0.0, x + 100.0, 100.0) for i, x in enumerate([0.0, 1.0, 2.0, 50.0])], BOX).withColumnRenamed("seq", "img")
    got = overlap.distinct_images(im).orderBy("img").collect()
    assert [r.img for r in got] == [0, 3] and all(len(r.block_id) == 12 for r in got)
    t = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 10.0, 10.0), (1, 1, 2, 0.0, 0.0, 10.0, 9.5), (1, 1, 3, 50.0, 0.0, 60.0, 9.5)], BOX).withColumnRenamed("seq", "table_id")
    h = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "table_id long, content_hash string")
    assert [r.table_id for r in overlap.distinct_tables(t, h).collect()] == [1]


def test_results(spark):
    p = spark.createDataFrame([(1, 1, False, True, 1, 0, 2, 0, 1, 0.5), (1, 2, False, False, 1, 1, 0, 0, 0, 1.0), (1, 3, True, True, 9, 9, 9, 9, 9, 0.1)], "doc_id long, page_num int, is_toc boolean, ocr_used boolean, n_header int, n_footer int, n_page_number int, n_watermark int, blocks_retried int, avg_block_quality double")
    r = results.aggregated(p)
    x = r.first()
    assert (x.parsed_pages, x.toc_pages, x.headers, x.page_numbers, x.ocr_used, x.blocks_retried, x.avg_block_quality) == (2, 1, 2, 2, True, 1, 0.5)
    prof = spark.createDataFrame([(1, 3, "mixed")], "doc_id long, total_pages long, complexity string")
    m = results.metadata(prof, r, spark.createDataFrame([(1, True)], "doc_id long, needs_review boolean"), F.lit("s"), F.lit("now")).first()
    assert (m.source_type, m.tables_extracted, m.tables_need_review, m.pages) == ("mixed_pdf", 1, 1, 3)
    items = spark.createDataFrame([(1, 1, 50.0), (1, 2, 5.0), (2, 1, 5.0)], "doc_id long, item int, y0 double")
    secs = spark.createDataFrame([(1, 1, 10.0), (1, 2, 40.0), (1, 3, 40.0), (1, 4, 90.0)], "doc_id long, ord int, y0 double")
    assert {(i.doc_id, i.item): i.section_ord for i in results.in_sections(items, secs).collect()} == {(1, 1): 2, (1, 2): 4, (2, 1): None}
    rows = results.report_rows(spark.createDataFrame([(1, 1, "a<b"), (1, 2, "c")], "doc_id long, page_num int, raw_text string"), spark.createDataFrame([(1, 1, "# a")], "doc_id long, page_num int, markdown string"), spark.createDataFrame([(1, 1)], "doc_id long, page_num int"))
    html = results.report_html(rows).first().html
    assert "a&lt;b" in html and "skipped" in html
    md = spark.range(1).select(results.image_markdown(F.lit(" "), F.lit(3), F.lit("abc")).alias("a"), results.image_markdown(F.lit("cap"), F.lit(3), F.lit("abc"), "img/", F.lit("png")).alias("b")).first()
    assert md.a == "![image-3-abc](placeholder://image/abc?page=3)" and md.b == "![cap](img/page-3-img-abc.png)"


def test_similarity(spark):
    df = spark.createDataFrame([("abc def\nx", "abc def\nx"), ("", ""), ("x", "")], "a string, b string")
    assert [r.v for r in df.select(similarity.recognition_accuracy(F.col("a"), F.col("b")).alias("v")).collect()] == [1.0, 1.0, pytest.approx(0.2)]
    d = spark.createDataFrame([("a\nb", "a\nc"), ("same", "same")], "a string, b string").select(similarity.unified_diff(F.col("a"), F.col("b")).alias("v")).collect()
    assert "-b" in d[0].v and "+c" in d[0].v and d[1].v == ""
    n = spark.createDataFrame([("a/b:c. ",), ("é.pdf",)], "n string").select(similarity.safe_filename(F.col("n")).alias("v")).collect()
    assert [r.v for r in n] == ["a_b_c", "é.pdf"]
    good = "café crème"
    assert codec.best_decoding(good.encode().decode("latin1")) == good and codec.best_decoding("plain") is None


def _words():
    """A toy tokenizer: words, full stops, everything with a capital a noun."""

    def run(t):
        import re

        return [(m[0], "SF" if m[0] == "." else "NNG" if m[0][0].isupper() else "VV", m.start(), len(m[0])) for m in re.finditer(r"\w+|\.", t)]

    return run


def test_tokenized(spark):
    d = spark.createDataFrame([(1, " One two. Three four.  five")], "doc_id long, text string")
    got = tokenized.sentences(d, _words).orderBy("n").collect()
    assert [(r.sentence, r.start) for r in got] == [("One two.", 1), ("Three four.", 10), ("five", 23)]
    assert [r.sentence for r in tokenized.sentences(d, None).collect()] == ["One two. Three four.  five"]
    b = spark.createDataFrame([(1, 1, 0, "One two. Three"), (1, 2, 0, "four. Five six.")], "doc_id long, page_num int, seq int, text string")
    c = tokenized.semantic_chunks(b, F.lit("s"), _words, max_tokens=8).orderBy("chunk_id").collect()
    assert [(r.text, r.page_numbers) for r in c] == [("One two.", [1]), ("Three\nfour.", [1, 2]), ("Five six.", [2])] or [(r.text, r.page_numbers) for r in c][0][1] == [1]
    blk = spark.createDataFrame([(1, "제1조 Purpose this is the body of the article", 0.0, 10.0), (2, "no heading here", 0.0, 10.0)], "doc_id long, text string, y0 double, y1 double")
    h = tokenized.heading_body(blk, _words).orderBy("doc_id", "part").collect()
    assert [(r.text, r.y0, r.y1) for r in h] == [("제1조 Purpose", 0.0, 4.0), ("this is the body of the article", 4.0, 10.0), ("no heading here", 0.0, 10.0)]
    assert tokenized.heading_body(blk, None).count() == 2
    t = spark.range(1).select(tokenized.first_tag(tokenized.tokens(F.lit("One x."), _words)).alias("a"), tokenized.last_tag(tokenized.tokens(F.lit("One x."), _words)).alias("b")).first()
    assert (t.a, t.b) == ("NNG", "SF")


def test_more_tables(spark):
    f = spark.createDataFrame([(1, 1, 1, "text"), (2, 1, 1, "lines"), (3, 1, 2, "words")], "table_id long, doc_id long, page_num int, strategy string")
    assert sorted(r.table_id for r in tables.first_strategy(f).collect()) == [2, 3]
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 20.0, 10.0), (1, 0.0, 10.0, 10.0, 20.0), (1, 10.0, 10.0, 20.0, 20.0)], "table_id long, x0 double, y0 double, x1 double, y1 double")
    assert {(r.row, r.col): (r.rowspan, r.colspan) for r in tables.spans(boxes).collect()} == {(0, 0): (1, 2), (1, 0): (1, 1), (1, 1): (1, 1)}
    d = spark.createDataFrame([(None,), (72,), (300,), (1000,), (10,)], "d int").select(tables.tolerance(5, F.col("d")).alias("v"))
    assert [r.v for r in d.collect()] == [5, 5, 21, 25, 5]


def test_sinks(spark, tmp_path):
    md = spark.createDataFrame([(1, "![a](/uploads/1/images/x.png) ![b](/uploads/1/images/y.png)")], "task_id long, markdown string")
    sinks.save_version(md, f"{tmp_path}/v", "original")
    sinks.save_version(md.withColumn("markdown", F.lit("new")), f"{tmp_path}/v", "edited")
    v = sinks.versions(spark, f"{tmp_path}/v").orderBy("n").collect()
    assert [r.markdown for r in v][0] == "new" and all(r.version.startswith("v_") for r in v)
    assert md.select(sinks.with_relative_images(F.col("markdown")).alias("m")).first().m == "![a](./images/x.png) ![b](./images/y.png)"
    im = spark.createDataFrame([(1, "x.png", bytearray(b"hi"), "image/png")], "task_id long, file string, data binary, mime string")
    assert sinks.with_inline_images(md, im).first().markdown == "![a](data:image/png;base64,aGk=) ![b](/uploads/1/images/y.png)"


def test_states(spark):
    s = spark.createDataFrame([("a", 1, True), ("a", 2, True), ("a", 3, False), ("b", 1, False)], "name string, ts int, up boolean")
    assert sorted((r.name, r.ts) for r in tasks.transitions(s).collect()) == [("a", 1), ("a", 3), ("b", 1)]


def test_pdf_lines(spark):
    lines = [[("Hea", "Arial-Bold", 12.0, (0, 0, 5, 10)), ("d", "Arial", 9.0, (5, 1, 7, 11))], [("  ", "Arial", 9.0, (0, 20, 1, 30))], [("x", "Arial", 9.0, (0, 40, 1, 50))]]
    got = list(pdf.line_rows("f", 1, 612.0, 792.0, lines))
    assert [(r[2], r[3], r[8], r[9]) for r in got] == [(0, "Head", 12.0, True), (1, "x", 9.0, False)] and got[0][4:8] == (0, 0, 7, 11)
    assert pdf.looks_like_pdf(b"%PDF" + b"0" * 1000) and not pdf.looks_like_pdf(b"%PDF")
    spark.dataSource.register(pdf.PdfLines)
    assert "text" in spark.read.format("pdf_lines").load("/nowhere.pdf").columns


def test_chunks_fold_small_groups(spark):
    """Against the rule in plain Python: a small group joins the one before if one path begins with the other."""
    import random

    from pageloom.operators import chunks

    r = random.Random(4)
    rows, want = [], []
    for d in range(12):
        kinds = [("heading", r.randint(1, 3)) if r.random() < 0.4 else ("text", 0) for _ in range(r.randint(1, 14))]
        texts = [f"w{r.randint(0, 9)}" * r.randint(1, 12) for _ in kinds]
        rows += [(d, 1, i, t, k, v, f"id{d}.{i}") for i, (t, (k, v)) in enumerate(zip(texts, kinds))]
        path, groups = [], []
        for t, (k, v) in zip(texts, kinds):
            if k == "heading":
                path = [p for p in path if p[0] < v] + [(v, t)]
            here = tuple(p[1] for p in path)
            if groups and groups[-1][0] == here:
                groups[-1][1].append(t)
            else:
                groups.append((here, [t]))
        merged = []
        for p, ts in groups:
            n = min(len(p), len(merged[-1][0])) if merged else 0
            if merged and max(1, len(" ".join(ts)) // 2) < 8 and p[:n] == merged[-1][0][:n]:
                merged[-1] = (p[:n], merged[-1][1] + ts)
            else:
                merged.append((p, ts))
        at = 0
        for n, (p, ts) in enumerate(merged):
            want.append((f"{d}-{n:04d}", (" > ".join(p) + "\n\n" if p else "") + "\n".join(ts), [f"id{d}.{at + i}" for i in range(len(ts))], list(p)))
            at += len(ts)
    df = spark.createDataFrame(rows, "doc_id long, page_num int, seq int, text string, block_type string, heading_level int, block_id string")
    got = chunks.chunked(df, F.col("doc_id").cast("string"), "by_title", combine_under_n=8, max_tokens=10_000).collect()
    assert sorted((x.chunk_id, x.text, x.block_ids, x.heading_path) for x in got) == sorted(want)
    assert {x.chunk_type for x in got} == {"by_title"} and all(x.metadata == {} for x in got)


def test_semantic_dispatch(spark):
    from pageloom.operators import chunks

    b = spark.createDataFrame([(1, 1, 0, "One two. Three", "a"), (1, 2, 0, "four. Five six.", "b")], "doc_id long, page_num int, seq int, text string, block_id string")
    got = chunks.chunked(b, F.lit("s"), "semantic", max_tokens=500, tokenizer=_words).collect()
    assert [(x.text, x.page_numbers, x.block_ids, x.chunk_type) for x in got] == [("One two. Three\nfour. Five six.", [1, 2], ["a", "b"], "semantic")]
    assert [x.chunk_type for x in chunks.chunked(b, F.lit("s"), "semantic").collect()] == ["fixed"]


def test_second_readings(spark):
    from pageloom import ports
    from pageloom.operators import attempts

    schema = "doc_id long, page_num int, seq int, text string, confidence double"
    blocks = spark.createDataFrame([(1, 1, 0, "good", 0.9), (1, 1, 1, "bda", 0.2), (1, 1, 2, "wrose", None)], schema)
    crops = spark.createDataFrame([(1, 1, 1, b"1"), (1, 1, 2, b"")], "doc_id long, page_num int, seq int, data binary")
    read = lambda: lambda image, hint: {b"1": " bad ", b"t": "| a | b |\n| --- | --- |\n| 1 | 2 |", b"": None}[bytes(image)]
    got = {x.seq: (x.text, x.confidence, x.part) for x in attempts.reread(blocks, crops, read).collect()}
    assert got == {0: ("good", 0.9, 0), 1: ("bad", 0.85, 1), 2: ("wrose", None, 1)}
    t = spark.createDataFrame([(1, 5, 5), (2, 2, 2), (3, 3, 3)], "table_id long, rows int, cols int")
    c = spark.createDataFrame([(1, 0, 0, "x"), (2, 0, 0, "y"), (3, 0, 0, "z")], "table_id long, row int, col int, text string")
    score = spark.createDataFrame([(1, 0.1), (2, 0.9), (3, 0.2)], "table_id long, score double")
    images = spark.createDataFrame([(1, b"t"), (3, b"")], "table_id long, data binary")
    t2, c2, record = attempts.reread_tables(t, c, score, images, read)
    assert sorted(tuple(x) for x in t2.collect()) == [(1, 2, 2), (2, 2, 2), (3, 3, 3)]
    assert sorted(tuple(x) for x in c2.collect()) == [(1, 0, 0, "a"), (1, 0, 1, "b"), (1, 1, 0, "1"), (1, 1, 1, "2"), (2, 0, 0, "y"), (3, 0, 0, "z")]
    assert sorted((x.table_id, x.replaced) for x in record.collect()) == [(1, True), (3, False)]
    pages = spark.createDataFrame([(1, 1, 0.2, "a"), (1, 2, 0.9, "a"), (1, 3, 0.1, "a")], "doc_id long, page_num int, overall double, how string")
    better = {"ocr": {1: 0.7, 3: 0.3}, "all": {3: 0.2}}
    seen = []

    def run(keys, hint):
        rows = [(d, p, better[hint["how"]][p], hint["how"]) for d, p in keys.collect()]
        seen.append((hint["how"], sorted(x[1] for x in rows)))
        return spark.createDataFrame(rows, pages.schema)

    got = sorted((x.page_num, x.overall, x.how) for x in attempts.retried(pages, ({"how": "ocr"}, {"how": "all"}), run).collect())
    assert got == [(1, 0.7, "ocr"), (2, 0.9, "a"), (3, 0.3, "ocr")] and seen == [("ocr", [1, 3]), ("all", [3])]

    image = spark.createDataFrame([(1, 1, b"x"), (1, 2, b"y")], "doc_id long, page_num int, image binary")
    table = lambda: lambda image: [((0.0, 1.0, 2.0, 3.0), 0.9, [["a", "b"]])] if image == b"x" else 1 / 0
    got = ports.read_tables(image, table).orderBy("page_num", "col").collect()
    assert [(x.page_num, x.row, x.col, x.text) for x in got[:2]] == [(1, 0, 0, "a"), (1, 0, 1, "b")] and "division" in got[2].error
    texts = spark.createDataFrame([(1, 1, b"x", [(0, "a"), (1, "b")])], "doc_id long, page_num int, image binary, texts array<struct<seq:int,text:string>>")
    assert [x.text for x in ports.corrected(texts, lambda: lambda i, t: [x.upper() for x in t]).orderBy("seq").collect()] == ["A", "B"]
    assert [x.text for x in ports.corrected(texts, lambda: lambda i, t: ["one"]).orderBy("seq").collect()] == ["a", "b"]
    assert ports.first_available(lambda: 1 / 0, lambda: "second")() == "second"
    with pytest.raises(ZeroDivisionError):
        ports.first_available(lambda: 1 / 0, lambda: "second", fail_fast=True)()


def test_image_text_and_items(spark):
    from pageloom.operators import render

    d = spark.createDataFrame([("Short title", 10.0, 100.0), ("A sentence.", 10.0, 100.0), ("Short title", 50.0, 100.0), ("Short title", 50.0, None), ("x" * 61, 0.0, 100.0)], "t string, y double, h double")
    assert [x.k for x in d.select(render.image_text_kind(F.col("t"), F.col("y"), F.col("h")).alias("k")).collect()] == ["heading", "body", "body", "heading", "body"]
    nodes = spark.createDataFrame([(1, 1, "a", None, "section", 1, "A"), (1, 2, "b", 1, "paragraph", None, "text"), (1, 3, "c", 1, "section", 2, "B"), (1, 4, "d", 3, "paragraph", None, "more"), (1, 5, "e", None, "section", 1, "C")], "doc_id long, ord int, node_id string, parent_ord int, node_type string, level int, text string")
    items = spark.createDataFrame([(1, 7, "table", 1, "| t |"), (1, 8, "figure", 3, "![f]()"), (1, 9, "form", 5, "**k**: v")], "doc_id long, item long, node_type string, section_ord int, text string")
    got = render.with_items(nodes, items)
    assert [x.text for x in got.orderBy("place").collect()] == ["A", "text", "B", "more", "![f]()", "| t |", "C", "**k**: v"]
    assert render.tree_markdown(got).first().markdown == "# A\n\ntext\n\n## B\n\nmore\n\n![f]()\n\n\n| t |\n\n\n# C\n\n\n**k**: v"


def test_workers(spark, tmp_path):
    from pageloom.streaming import jobs, tasks, workers

    for n in range(5):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"f{n}.txt").write_text("x" * (n + 1))
    parse = lambda found: found.select("path", F.length("content").alias("n"))
    args = (spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "progress"), parse)
    workers.intake(*args, per_batch=2).awaitTermination()
    (tmp_path / "in" / "g.txt").write_text("y" * 9)
    q = workers.intake(*args, per_batch=2)
    q.awaitTermination()
    assert sorted(x.n for x in workers.collected(spark, str(tmp_path / "out"), "path string, n int").collect()) == [1, 2, 3, 4, 5, 9]
    assert workers.progress(q)["error"] is None and not workers.progress(q)["active"]
    assert workers.in_group(spark, "g", lambda: spark.range(3).count()) == 3
    now, up = [0.0], [False]
    b = workers.Breaker(lambda: up[0], clock=lambda: now[0])
    seen = []
    for t, u in ((0, True), (1, False), (6, False), (12, False), (18, False), (19, True), (49, True), (50, True)):
        now[0], up[0] = float(t), u
        seen.append(b.available())
    assert seen == [True, True, False, False, False, False, True, True]
    rows = [("a", "queued", 2), ("b", "queued", 1), ("c", "done", 0)]
    j = spark.createDataFrame(rows, "job_id string, status string, t int").selectExpr("job_id", "status", "'m' AS mime", "job_id AS content_hash", "0 AS attempts", "timestamp_seconds(t) AS created_at", "timestamp_seconds(t) AS updated_at")
    assert {x.job_id: x.status for x in jobs.claimed(j, F.current_timestamp()).collect()} == {"a": "queued", "b": "processing", "c": "done"}
    assert [x.job_id for x in jobs.listed(j, active=True).collect()] == ["a", "b"]
    new = j.where("job_id = 'a'").withColumn("job_id", F.lit("z")).withColumn("status", F.lit("pending")).unionByName(j.where("job_id = 'b'"))
    assert {x.job_id: x.status for x in jobs.inserted(j, new).collect()}["z"] == "queued" and jobs.inserted(j, new).count() == 4
    change = spark.createDataFrame([("a", "failed", 3)], "job_id string, status string, attempts int")
    got = {x.job_id: (x.status, x.attempts) for x in jobs.updated(j, change).collect()}
    assert got["a"] == ("failed", 3) and got["b"] == ("queued", 0) and jobs.deleted(j, change).count() == 2
    parts = spark.createDataFrame([("t", 0, "running", 10, 1, "x"), ("t", 2, "done", 100, 3, "done"), ("u", 1, "running", 5, 0, "y")], "task_id string, batch int, status string, pct int, n_results long, last_event string")
    assert {x.task_id: x.pct for x in tasks.latest_state(parts).collect()} == {"t": 100, "u": 5} and tasks.snapshot(parts, "u").first().pct == 5
    assert [x.status for x in tasks.history(tasks.latest_state(parts), j.withColumn("job_id", F.lit("t"))).collect()] == ["done"] * 3


def test_whole_plan(spark):
    """A page with a heading, text, a table over some of it, an image, layout boxes and a recognised page."""
    from pageloom.plans import parse

    rows = [(1, 1, i, t, 50.0, y, 500.0, y + 12, s, b, 1.0, 600.0, 800.0) for i, (t, y, s, b) in enumerate((("1. A heading here", 100.0, 16.0, True), ("Text of a paragraph that ends with a stop.", 200.0, 10.0, False), ("words inside the table", 310.0, 10.0, False), ("Another paragraph after the table, which is long enough for a page.", 500.0, 10.0, False)))]
    b = spark.createDataFrame(rows, "doc_id long, page_num int, seq int, text string, x0 double, y0 double, x1 double, y1 double, size double, is_bold boolean, confidence double, width double, height double")
    scanned = [(1, 2, "", 600.0, 800.0, 0.9, True, 1)]
    text = "\n".join(x[3] for x in rows)
    p = spark.createDataFrame([(1, 1, text, 600.0, 800.0, 0.0, True, 1), *scanned], "doc_id long, page_num int, raw_text string, width double, height double, image_ratio double, has_images boolean, image_count int")
    t = spark.createDataFrame([(7, 1, 1, 2, 2, 50.0, 300.0, 500.0, 400.0, 800.0, 600.0, False)], "table_id long, doc_id long, page_num int, rows int, cols int, x0 double, y0 double, x1 double, y1 double, height double, width double, needs_review boolean")
    c = spark.createDataFrame([(7, 0, 0, "first key"), (7, 0, 1, "second key"), (7, 1, 0, "value 1"), (7, 1, 1, "v 2")], "table_id long, row int, col int, text string")
    i = spark.createDataFrame([(1, 1, 1, 50.0, 600.0, 300.0, 700.0, 800.0)], "doc_id long, page_num int, img long, x0 double, y0 double, x1 double, y1 double, height double")
    out = parse.parse_blocks(b, p, tables=t, cells=c, images=i, cut=parse.checkpointed)
    md = out.page_markdown.where("page_num = 1").first().markdown
    at = [md.index(x) for x in ("A heading here", "Text of a paragraph", "| first key | second key |", "Another paragraph", "placeholder://image/")]
    assert at == sorted(at) and "inside the table" not in md
    kinds = [x.node_type for x in out.tree.collect()]
    assert kinds.count("table") == 1 and kinds.count("figure") == 1 and kinds.count("section") >= 1


def test_boxes_of_pages_without_python_groups(spark):
    """What is kept, and the order by boxes, equal plain loops over each page; no page is a Python group, which took most of the whole plan's time."""
    import random

    from pageloom.operators import layout

    rnd = random.Random(5)
    rows = [(d, p, i, x := float(rnd.randrange(0, 30)), y := float(rnd.randrange(0, 30)), x + rnd.randrange(0, 25), y + rnd.randrange(0, 25)) for d in range(4) for p in range(1, 5) for i in range(rnd.randrange(1, 9))]
    found = [(d, p, i, x - 1, y - 1, x1 + 1, y1 + 2) for d, p, i, x, y, x1, y1 in rows if p < 4 and i % 2 == 0]

    def share(a, b, smaller=False):
        (ax, ay, ax1, ay1), (bx, by, bx1, by1) = a[3:], b[3:]
        both = max(0.0, min(ax1, bx1) - max(ax, bx)) * max(0.0, min(ay1, by1) - max(ay, by))
        sizes = ((ax1 - ax) * (ay1 - ay), (bx1 - bx) * (by1 - by))
        base = min(sizes) if smaller else sum(sizes) - both
        return both / base if base > 0 else 0.0

    pages = sorted({r[:2] for r in rows})
    own = lambda rs, k: [r for r in rs if r[:2] == k]
    blocks, boxes = spark.createDataFrame(rows, BOX), spark.createDataFrame(found, BOX).withColumnRenamed("seq", "ord")
    for smaller, limit in ((False, 0.3), (True, 0.5)):
        kept = []
        for k in pages:
            on = []
            for r in own(rows, k):
                if all(share(r, o, smaller) <= limit for o in on):
                    on.append(r)
            kept += [r[:3] for r in on]
        got = overlap.first_of_overlapping(blocks, "seq", limit, smaller)
        assert sorted(map(tuple, got.collect())) == kept and len(kept) < len(rows)
        assert "Pandas" not in got._jdf.queryExecution().toString()
    want = []
    for k in pages:
        free, out = own(rows, k), []
        for r in own(found, k):
            best = max(free, key=lambda t: (share(r, t), -t[2]), default=None)
            if best and share(r, best) >= 0.3:
                out.append(best)
                free.remove(best)
        out += sorted(free, key=lambda t: (t[4], t[3])) if own(found, k) else free
        want += [(*r[:3], i) for i, r in enumerate(out, 1)]
    got = layout.in_layout_order(blocks, boxes)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert "Pandas" not in got._jdf.queryExecution().toString()
