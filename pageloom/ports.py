"""Places for models: recognition of text, layout detection, vision-language correction, tokenizers, page sources.

A port is a function that builds an engine; it is called once in each Python worker, so that models are
loaded where they run. Without one, the null engines keep everything as it is. Failures become rows
with an error, not failed jobs. Filters belong before a port: Spark doesn't push them through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

BLOCKS = "doc_id long, page_num int, seq int, text string, x0 double, y0 double, x1 double, y1 double, size double, is_bold boolean, confidence double, error string"
BOXES = "doc_id long, page_num int, ord int, label string, confidence double, x0 double, y0 double, x1 double, y1 double, error string"
TOKENS = "array<struct<form:string,tag:string,start:int,length:int>>"


class Recognizer(Protocol):
    def __call__(self, image: bytes) -> list[tuple[str, list[tuple[float, float]], float]]:
        """Texts with polygons and confidences."""


class Detector(Protocol):
    def __call__(self, image: bytes) -> list[tuple[str, tuple[float, float, float, float], float]]:
        """Labels with boxes and confidences, in reading order."""


class Describer(Protocol):
    def __call__(self, image: bytes, hint: str) -> str | None:
        """A text for an image."""


def no_recognizer() -> Recognizer:
    return lambda image: []


def no_detector() -> Detector:
    return lambda image: []


def no_describer() -> Describer:
    return lambda image, hint: None


class TableReader(Protocol):
    def __call__(self, image: bytes) -> list[tuple[tuple[float, float, float, float], float, list[list[str]]]]:
        """Boxes, confidences and rows of cell texts of the tables in an image."""


class Corrector(Protocol):
    def __call__(self, image: bytes, texts: list[str]) -> list[str]:
        """A page's texts, corrected: as many as were given."""


def no_table_reader() -> TableReader:
    return lambda image: []


def no_corrector() -> Corrector:
    return lambda image, texts: texts


def first_available(*builders: Callable, fail_fast: bool = False) -> Callable:
    """A builder that gives the engine of the first builder that works; with ``fail_fast`` only the first one is tried."""

    def build():
        for b in builders[: 1 if fail_fast else None]:
            try:
                return b()
            except Exception:  # noqa: BLE001  a backend that can't be loaded is passed over
                if fail_fast:
                    raise
        raise RuntimeError("no engine could be built")

    return build


@lru_cache(8)
def _engine(build: Callable):
    return build()


#: Canonical layout labels; others become Text. Fixed values.
LABELS = {"title": "Title", "section-header": "Section-header", "text": "Text", "table": "Table", "figure": "Figure", "picture": "Figure", "caption": "Caption", "list-item": "List-item", "list": "List", "page-header": "Page-Header", "page-footer": "Page-Footer", "footnote": "Footnote", "formula": "Formula"}


def recognized(pages: DataFrame, build: Callable[[], Recognizer] = no_recognizer) -> DataFrame:
    """Blocks of page images (doc_id, page_num, image): polygons become boxes, the font size is 0, blank texts go."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine, names = _engine(build), [c.split()[0] for c in BLOCKS.split(", ")]
        for b in batches:
            out = []
            for d, p, image in zip(b["doc_id"], b["page_num"], b["image"]):
                try:
                    found = [f for f in engine(image) if f[0] and f[0].strip()]
                except Exception as e:  # noqa: BLE001  an engine's failure is data
                    out.append((d, p, None, None, None, None, None, None, None, None, None, str(e)[:500]))
                    continue
                for i, (text, polygon, confidence) in enumerate(found):
                    xs, ys = zip(*polygon)
                    out.append((d, p, i, text, min(xs), min(ys), max(xs), max(ys), 0.0, False, 1.0 if confidence is None else confidence, None))
            yield pd.DataFrame(out, columns=names).astype({"seq": "Int64", "is_bold": "boolean"})

    return pages.select("doc_id", "page_num", "image").mapInPandas(rows, BLOCKS)


def detected(pages: DataFrame, build: Callable[[], Detector] = no_detector) -> DataFrame:
    """Layout boxes of page images with canonical labels."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine, names = _engine(build), [c.split()[0] for c in BOXES.split(", ")]
        for b in batches:
            out = []
            for d, p, image in zip(b["doc_id"], b["page_num"], b["image"]):
                try:
                    found = engine(image)
                except Exception as e:  # noqa: BLE001
                    out.append((d, p, None, None, None, None, None, None, None, str(e)[:500]))
                    continue
                for i, (label, box, confidence) in enumerate(f for f in found if f[0] and f[1]):
                    out.append((d, p, i, LABELS.get(label.lower().replace("_", "-"), "Text"), confidence or 0.0, *box, None))
            yield pd.DataFrame(out, columns=names).astype({"ord": "Int64"})

    return pages.select("doc_id", "page_num", "image").mapInPandas(rows, BOXES)


TABLE_CELLS = "doc_id long, page_num int, n int, x0 double, y0 double, x1 double, y1 double, confidence double, row int, col int, text string, error string"


def read_tables(pages: DataFrame, build: Callable[[], TableReader] = no_table_reader) -> DataFrame:
    """Cells of the tables in page images (doc_id, page_num, image), with their table's number, box and confidence."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine, names = _engine(build), [c.split()[0] for c in TABLE_CELLS.split(", ")]
        for b in batches:
            out = []
            for d, p, image in zip(b["doc_id"], b["page_num"], b["image"]):
                try:
                    for n, (box, confidence, grid) in enumerate(engine(image)):
                        out += [(d, p, n, *box, confidence, r, c, t, None) for r, row in enumerate(grid) for c, t in enumerate(row)]
                except Exception as e:  # noqa: BLE001
                    out.append((d, p, *[None] * 9, str(e)[:500]))
            yield pd.DataFrame(out, columns=names).astype({"n": "Int64", "row": "Int64", "col": "Int64"})

    return pages.select("doc_id", "page_num", "image").mapInPandas(rows, TABLE_CELLS)


def corrected(pages: DataFrame, build: Callable[[], Corrector] = no_corrector) -> DataFrame:
    """doc_id, page_num, seq, text of pages (doc_id, page_num, image, texts: array of seq and text); a failure or another number of texts leaves a page as it is."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = _engine(build)
        for b in batches:
            out = []
            for d, p, image, own in zip(b["doc_id"], b["page_num"], b["image"], b["texts"]):
                old = [x["text"] for x in own]
                try:
                    new = list(engine(image, old))
                except Exception:  # noqa: BLE001
                    new = old
                out += [(d, p, x["seq"], t) for x, t in zip(own, new if len(new) == len(old) else old)]
            yield pd.DataFrame(out, columns=["doc_id", "page_num", "seq", "text"])

    return pages.select("doc_id", "page_num", "image", "texts").mapInPandas(rows, "doc_id long, page_num int, seq int, text string")


def lines_of(read: DataFrame) -> DataFrame:
    """Blocks of texts that a model read from images (doc_id, page_num, text, box): one for each line that isn't blank, over the whole image, of size 10."""
    from pyspark.sql import functions as F

    from .functions import text as X

    lines = F.filter(F.transform(F.split("text", "\n"), X.strip), lambda x: x != "")
    return read.select("doc_id", "page_num", F.posexplode(lines).alias("seq", "text"), "x0", "y0", "x1", "y1", F.lit(10.0).alias("size"), F.lit(False).alias("is_bold"))


def described(images: DataFrame, build: Callable[[], Describer] = no_describer) -> DataFrame:
    """images (img, data, caption) with alt_text where the engine gives one; a failure leaves the row as it is."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = _engine(build)
        for b in batches:
            texts = []
            for data, hint in zip(b["data"], b["caption"]):
                try:
                    texts.append(engine(data, hint or "") if data is not None else None)
                except Exception:  # noqa: BLE001
                    texts.append(None)
            yield b.assign(alt_text=texts)[["img", "alt_text"]]

    got = images.select("img", "data", "caption").mapInPandas(rows, "img long, alt_text string")
    return images.join(got, "img", "left")
