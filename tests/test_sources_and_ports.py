"""Readers, ports, images, attempts, word grids, and the plan as a whole."""

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from pageloom import __main__, ports
from pageloom.operators import attempts, images, word_grid
from pageloom.plans import parse
from pageloom.sources import adapters, readers


def test_csv(spark, tmp_path):
    assert readers.csv_table(b"name,age,city\nA,1,x|y\nB,2")[0] == "| name | age | city |\n| --- | --- | --- |\n| A | 1 | x\\|y |\n| B | 2 |  |"
    assert readers.csv_table(b"name;age\nA;1\nB;2\n")[1:] == (2, 2, False) and readers.csv_table(b"") == ("", 0, 0, False)
    assert readers.csv_table(b"a,b\n" + b"1,2\n" * 5, max_rows=3)[1:] == (3, 2, True)
    (tmp_path / "t.csv").write_text("a,b\n1,2\n")
    r = readers.read(spark, f"{tmp_path}/t.csv").first()
    assert r.markdown.startswith("## t.csv\n\n| a | b |") and r.rows == 1
    with pytest.raises(ValueError, match="no reader"):
        readers.read(spark, "x.pdf")


def _book(rows):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="One"/><sheet name="Empty"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>head</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{rows}</sheetData></worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {ns}><sheetData/></worksheet>")
    return out.getvalue()


def test_workbook():
    book = _book('<row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>x</t></is></c></row><row><c r="A2"/></row><row><c r="B3"><v>5</v></c></row>')
    assert readers.workbook_tables(book) == ("## One\n\n| head | Column_2 | x |\n| --- | --- | --- |\n|  | 5 |  |", 1, 3, False)


def test_text_and_mime(spark):
    assert readers.decoded("한글".encode("cp949")) == "한글" and readers.decoded(b"\xff\xfea") == "\ufffd\ufffda"
    df = spark.createDataFrame([("a", "text/csv", bytearray(b"x,y\n1,2")), ("b", "text/plain", bytearray(b"one\ntwo"))], "path string, mime string, content binary")
    assert {r.path: (r.rows, r.cols) for r in readers.read_by_mime(df).collect()} == {"a": (1, 2), "b": (2, 1)}


def test_html_table(spark):
    html = '<table><tr><th rowspan="2">A</th><th colspan="2">B</th></tr><tr><td>c</td><td>d</td></tr></table>'
    assert readers.html_cells(html) == [(0, 0, "A", 2, 1), (0, 1, "B", 1, 2), (1, 1, "c", 1, 1), (1, 2, "d", 1, 1)]
    assert readers.html_cells("<tr><td>one</td></tr>") == []
    assert readers.html_tables(spark.createDataFrame([(1, html), (2, None)], "table_id long, html string")).count() == 4


def test_ports(spark):
    pages = spark.createDataFrame([(1, 1, bytearray(b"ok")), (1, 2, bytearray(b"bad"))], "doc_id long, page_num int, image binary")
    assert ports.recognized(pages).count() == 0 and ports.detected(pages).count() == 0

    def build():
        def engine(image):
            if bytes(image) == b"bad":
                raise RuntimeError("broken")
            return [("word", [(1.0, 2.0), (9.0, 2.0), (9.0, 5.0), (1.0, 5.0)], None), ("  ", [(0.0, 0.0)], 0.5)]

        return engine

    got = {r.page_num: r for r in ports.recognized(pages, build).collect()}
    assert (got[1].text, got[1].x1, got[1].size, got[1].confidence) == ("word", 9.0, 0.0, 1.0) and "broken" in got[2].error
    boxes = ports.detected(pages, lambda: lambda image: [("section_header", (0.0, 0.0, 1.0, 1.0), None), ("strange", (0.0, 0.0, 1.0, 1.0), 0.5), ("", None, 1.0)])
    assert [(r.label, r.confidence) for r in boxes.where("page_num = 1").orderBy("ord").collect()] == [("Section-header", 0.0), ("Text", 0.5)]


def test_images(spark):
    page = np.full((400, 300), 255, np.uint8)
    for y in range(20, 380, 40):
        page[y : y + 20, 30:270] = 0
    tilted = np.full((400, 300), 255, np.uint8)
    for y in range(20, 380, 40):
        for x in range(30, 270):
            s = int(round((x - 150) * np.tan(np.radians(3))))
            tilted[max(0, y + s) : y + s + 20, x] = 0
    rows = [(1, bytearray(page.tobytes()), 300, 400, 1), (2, bytearray(np.full((60, 60, 3), 128, np.uint8).tobytes()), 60, 60, 3), (3, bytearray(tilted.tobytes()), 300, 400, 1)]
    got = {r.img: r for r in images.decisions(images.diagnosed(spark.createDataFrame(rows, "img long, data binary, width int, height int, channels int"))).collect()}
    assert got[1].dpi == 120 and got[1].skew == 0 and got[1].contrast == 1.0 and got[1].needs_upscale
    assert got[2].dpi == -1 and got[2].needs_contrast and not got[2].is_clean and got[3].needs_deskew


def test_attempts(spark):
    a = spark.createDataFrame([(1, 1, 0, 0.4), (1, 1, 1, 0.6), (1, 1, 2, 0.6), (1, 2, 0, None), (1, 2, 1, 0.1)], "doc_id long, page_num int, attempt int, overall double")
    assert {r.page_num: r.attempt for r in attempts.best(a).collect()} == {1: 1, 2: 1}
    v = spark.createDataFrame([(0, 10, 0.1, 0.1), (100, 50, 0.5, 0.9), (100, 100, 0.5, 0.6), (100, 130, 0.5, 0.5), (100, 100, 0.5, 0.5)], "a int, b int, c double, d double")
    assert [r.v.reason for r in v.select(attempts.preprocessing_verdict(*map(F.col, "abcd")).alias("v")).collect()] == ["rescued_empty", "char_loss", "confidence", "char_gain", "original"]
    b = spark.createDataFrame([(1, 1, 0, "old", 0.4), (1, 1, 1, "keep", 0.9)], "doc_id long, page_num int, seq int, text string, block_score double")
    r = spark.createDataFrame([(1, 1, 0, 0, "worse", 0.3), (1, 1, 0, 1, "new", 0.5), (1, 1, 0, 2, "newer", 0.9), (1, 1, 1, 0, "same", 0.9)], "doc_id long, page_num int, seq int, attempt int, text string, score double")
    assert {x.seq: x.text for x in attempts.replaced(b, r).collect()} == {0: "new", 1: "keep"}


def test_word_grid(spark):
    lines = [("CITY", "DATE", "FLIGHT"), ("SEOUL ICN", "01JAN", "OZ545"), ("PRAGUE PRG", "02JAN", "KE123"), ("Remarks", "", "")]
    words = [(1, 1, t, 50.0 + 150 * c, 90.0 + 150 * c, 100.0 + 20 * r + c, 110.0 + 20 * r) for r, row in enumerate(lines) for c, t in enumerate(row) if t]
    got = {(x.row, x.col): x.text for x in word_grid.rebuilt(spark.createDataFrame(words, "doc_id long, page_num int, text string, x0 double, x1 double, top double, bottom double")).collect()}
    assert got == {(r, c): t for r, row in enumerate(lines[:3]) for c, t in enumerate(row)}
    plain = [(1, 1, "nothing", 0.0, 1.0, 0.0, 1.0)]
    assert word_grid.rebuilt(spark.createDataFrame(plain, "doc_id long, page_num int, text string, x0 double, x1 double, top double, bottom double")).count() == 0


def test_plan(spark, tmp_path):
    text = "\n".join(["Chapter 1 Start", "some words of a longer paragraph that goes on for a while and ends here.", "more words of it follow."] * 4)
    spark.createDataFrame([(1, text), (2, "short"), (3, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/d.parquet")
    p = parse.parse_documents(spark.read.parquet(f"{tmp_path}/d.parquet"))
    assert p.markdown.where("doc_id = 1").first().markdown.startswith("# Chapter 1 Start") and p.tree.where("node_type = 'section'").count() > 0
    assert p.stats.where("doc_id = 1").first().heading_count > 0 and p.confidence.count() == p.pages.where("page_type <> 'noise'").count()
    assert parse.chunk_document(p, "fixed").count() > 0
    assert __main__.main([f"{tmp_path}/d.parquet", "-o", f"{tmp_path}/out", "--format", "chunks", "--stats"]) == 0
    assert spark.read.text(f"{tmp_path}/out").count() > 0 and spark.read.json(f"{tmp_path}/out-stats").count() > 0


def test_conversations(spark):
    c = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "hello")], "conv_id long, turn long, role string, text string")
    assert [(r.page_num, r.block_type) for r in adapters.conversation_blocks(c).orderBy("page_num").collect()] == [(1, "heading"), (2, "text")]
