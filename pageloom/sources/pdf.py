"""Lines and pages of PDF files by a Python data source, where a PDF library is installed.

``spark.dataSource.register(PdfLines)`` and ``spark.read.format("pdf_lines").load(folder)`` give a row a
line in the order of the file; one partition a file. Without the library reading raises ImportError.
"""

from __future__ import annotations

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, page_num int, seq int, text string, x0 double, y0 double, x1 double, y1 double, size double, is_bold boolean, confidence double, width double, height double"
MIN_BYTES, MAGIC = 1000, b"%PDF"


def looks_like_pdf(content: bytes) -> bool:
    return len(content) >= MIN_BYTES and content.startswith(MAGIC)


def line_rows(path: str, page_num: int, width: float, height: float, lines):
    """Rows of a page's lines, each a list of (text, font, size, box); the font of a line is that of its longest text."""
    seq = 0
    for spans in lines:
        text = "".join(s[0] for s in spans)
        if not text.strip():
            continue
        _, font, size, _ = max(spans, key=lambda s: len(s[0]))
        boxes = [s[3] for s in spans]
        yield (path, page_num, seq, text, min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes), float(size), "bold" in font.lower(), 1.0, width, height)
        seq += 1


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options.get("path", "")

    def partitions(self):
        import glob
        import os

        found = sorted(glob.glob(os.path.join(self.path, "*.pdf"))) if os.path.isdir(self.path) else [self.path]
        return [InputPartition(p) for p in found]

    def read(self, partition):
        import fitz

        with fitz.open(partition.value) as doc:
            for n, page in enumerate(doc, 1):
                lines = [[(s["text"], s["font"], s["size"], s["bbox"]) for s in line["spans"]] for b in page.get_text("dict")["blocks"] if b["type"] == 0 for line in b["lines"] if line["spans"]]
                yield from line_rows(partition.value, n, page.rect.width, page.rect.height, lines)


class PdfLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pdf_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)
