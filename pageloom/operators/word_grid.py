"""Tables without lines, rebuilt from words (doc_id, page_num, text, x0, x1, top, bottom) of itineraries."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame

# What shows an itinerary, its column heads, its end; tolerances in points.
SIGNS = re.compile(r"[A-Z]{2}\s*\d{2,4}|TERMINAL|ECONOMY|BUSINESS|FIRST|BOARDING\s*PASS|GATE|SEAT|좌석|ICN|GMP|PUS|CJU|NRT|HND|PEK|PVG|SIN|BKK|PRG|CDG|LHR|FRA|JFK|LAX|편명|항공편|출발|도착|탑승", re.I)
HEADS = re.compile(r"도시|공항|일자|시각|터미널|클래스|비행시간|상태|CITY|AIRPORT|DATE|TIME|CLASS|STATUS|FLIGHT", re.I)
END = re.compile(r"항공권\s*정보|Ticket\s*Information|항공사\s*공지|Airline\s*Notice|드리는\s*말씀|Remarks|제한사항|Restriction", re.I)
MIN_SIGNS, MIN_HEADS, MIN_COLS, ROW_TOLERANCE, MIN_GAP, NEAR, PAD = 3, 3, 3, 3.0, 0.02, 25.0, 5.0


def row_numbers(words: pd.DataFrame) -> pd.DataFrame:
    """Words from top to bottom with their row: a row holds what is within the tolerance of its first word, so that drift doesn't join rows."""
    w = words.sort_values(["top", "x0"], kind="stable").reset_index(drop=True)
    rows, anchor, n = [], None, -1
    for top in w["top"]:
        if anchor is None or abs(top - anchor) > ROW_TOLERANCE:
            anchor, n = top, n + 1
        rows.append(n)
    return w.assign(row=rows)


def boundaries(w: pd.DataFrame, width: float) -> list[float]:
    """Column boundaries: means of the clusters of gap middles that enough rows show."""
    w = w.sort_values(["row", "x0"], kind="stable")
    gap = w["x0"] - w.groupby("row")["x1"].shift()
    mid = ((w["x0"] + w.groupby("row")["x1"].shift()) / 2)[gap >= width * MIN_GAP]
    mids = pd.DataFrame({"row": w["row"], "m": mid}).dropna().drop_duplicates().sort_values("m")
    if mids.empty:
        return []
    cluster = (mids["m"].diff() > NEAR).cumsum()
    size = mids.groupby(cluster)["m"].agg(["size", "mean"])
    many = int((w.groupby("row").size() >= 2).sum())
    return size.loc[size["size"] >= max(0.2 * many, 2), "mean"].tolist()


def grid(words: pd.DataFrame, width: float) -> list[list[str]]:
    """The table's rows of cell texts, or none."""
    if len(SIGNS.findall(" ".join(words["text"]))) < MIN_SIGNS:
        return []
    w = row_numbers(words)
    text = w.groupby("row")["text"].agg(" ".join)
    top = w.groupby("row")["top"].min()
    heads = [r for r, t in text.items() if len(HEADS.findall(t)) >= MIN_HEADS]
    keep = list(text.index)
    if heads:
        end = next((r for r in text.index if r > heads[-1] and END.search(text[r])), len(text))
        inside = [r for r in text.index if r < end and top[r] >= top[heads[0]] - PAD]
        keep = inside if len(inside) >= 2 else keep
    w = w[w["row"].isin(keep)]
    cuts = boundaries(w, width)
    if len(cuts) + 1 < MIN_COLS:
        return []
    w = w.assign(col=[sum((a + b) / 2 > c for c in cuts) for a, b in zip(w["x0"], w["x1"])])
    cells = w.groupby(["row", "col"])["text"].agg(" ".join).unstack(fill_value="").reindex(columns=range(len(cuts) + 1), fill_value="")
    rows = [[x.strip() for x in r] for r in cells.to_numpy().tolist()]
    rows = [r for r in rows if any(r)]
    return rows if len(rows) >= 2 else []


def rebuilt(words: DataFrame, width: float = 595.0) -> DataFrame:
    """doc_id, page_num, row, col, text: one table a page at most. Rows depend on those above, so that a page is one pandas group."""

    def page(key, w):
        out = [(*key, r, c, t) for r, row in enumerate(grid(w, width)) for c, t in enumerate(row)]
        return pd.DataFrame(out, columns=["doc_id", "page_num", "row", "col", "text"])

    return words.groupBy("doc_id", "page_num").applyInPandas(page, "doc_id long, page_num int, row int, col int, text string")
