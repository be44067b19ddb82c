"""What a tokenizer makes possible: sentences, semantic chunks, headings split from bodies. Without one, texts stay as they are.

A tokenizer is a function (see ports) from a text to (form, tag, start, length).
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..ports import TOKENS, _engine
from .chunks import _has_ids, _kind, chunk_id, packer

ENDS = ("EF", "SF")  # tags that end a sentence
PREFIX = re.compile(r"^(?:제\s*\d+\s*[편장절관조](?:의\s*\d+)?(?:\s*[(（][^)）]*[)）])?|\d+(?:\.\d+)*\.?|[가-하]\.)\s*")
HEAD, BODY = (5, 35), 10  # characters of a heading, least of a body


def tokens(c: Column, build: Callable | None) -> Column:
    """array<struct<form,tag,start,length>>; empty without a tokenizer or where it fails."""
    if build is None:
        return F.array().cast(TOKENS)

    @F.pandas_udf(TOKENS)
    def run(texts: pd.Series) -> pd.Series:
        engine, out = _engine(build), []
        for t in texts:
            try:
                out.append([dict(zip(("form", "tag", "start", "length"), x)) for x in engine(t or "")])
            except Exception:  # noqa: BLE001  a tokenizer's failure leaves the text whole
                out.append([])
        return pd.Series(out)

    return run(c)


def first_tag(toks: Column) -> Column:
    return F.try_element_at(toks, F.lit(1))["tag"]


def last_tag(toks: Column) -> Column:
    return F.try_element_at(toks, F.lit(-1))["tag"]


def sentences(texts: DataFrame, build: Callable | None) -> DataFrame:
    """doc_id, n, sentence, start, end of texts (doc_id, text): spans up to each token that ends a sentence, white space around them left out."""
    t = texts.withColumn("_t", tokens(F.col("text"), build))
    ends = F.transform(F.filter("_t", lambda x: x["tag"].isin(*ENDS)), lambda x: x["start"] + x["length"])
    cuts = F.array_distinct(F.concat(F.array(F.lit(0)), ends, F.array(F.length("text"))))
    spans = F.transform(F.slice(cuts, F.lit(2), F.greatest(F.size(cuts) - 1, F.lit(0))), lambda e, i: F.struct(F.element_at(cuts, i + 1).alias("a"), e.alias("b")))
    s = t.select("doc_id", "text", F.posexplode(spans).alias("n", "s"))
    raw = F.substring("text", F.col("s.a") + 1, F.col("s.b") - F.col("s.a"))
    lead = F.length(raw) - F.length(F.regexp_replace(raw, f"^[{X.WS}]+", ""))
    out = s.select("doc_id", "n", X.strip(raw).alias("sentence"), (F.col("s.a") + lead).alias("start"))
    return out.where("sentence <> ''").withColumn("end", F.col("start") + F.length("sentence"))


def semantic_chunks(blocks: DataFrame, source: Column, build: Callable, max_tokens: int = 500) -> DataFrame:
    """Sentences of a document packed up to a number of tokens, with the pages of the blocks they overlap."""
    b = blocks.where(X.strip(F.col("text")) != "").select("doc_id", "page_num", "seq", "text", *_has_ids(blocks))
    ids = F.col("block_id") if _has_ids(blocks) else F.lit(None).cast("string")
    b = b.withColumn("block_id", ids)
    d = b.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_num", "seq", "text", "block_id"))).alias("r"))
    spans = F.aggregate("r", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<page_num:int,block_id:string,a:int,b:int>>").alias("s")), lambda acc, x: F.struct((acc["at"] + F.length(x["text"]) + 1).alias("at"), F.concat(acc["s"], F.array(F.struct(x["page_num"].alias("page_num"), x["block_id"].alias("block_id"), acc["at"].alias("a"), (acc["at"] + F.length(x["text"])).alias("b")))).alias("s")))["s"]
    d = d.select("doc_id", F.array_join(F.transform("r", lambda x: x["text"]), "\n").alias("text"), spans.alias("spans"))
    s = sentences(d.select("doc_id", "text"), build)
    g = s.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", "sentence", "start", "end"))).alias("r"))
    g = g.withColumn("k", packer(max_tokens)(F.transform("r", lambda x: X.tokens(x["sentence"])), F.transform("r", lambda x: F.lit(0))))
    e = g.select("doc_id", F.explode(F.arrays_zip("r", "k")).alias("z"))
    c = e.groupBy("doc_id", F.col("z.k").alias("chunk")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("z.r.n"), F.col("z.r.sentence")))), lambda x: x["sentence"]), " ").alias("text"), F.min("z.r.start").alias("a"), F.max("z.r.end").alias("b"))
    j = c.join(d.select("doc_id", "spans"), "doc_id").withColumn("_source", source)
    inside = F.filter("spans", lambda x: (x["b"] > F.col("a")) & (x["a"] < F.col("b")))
    pages, block_ids = F.array_sort(F.array_distinct(F.transform(inside, lambda x: x["page_num"]))), F.array_compact(F.transform(inside, lambda x: x["block_id"]))
    return j.select("doc_id", chunk_id(F.col("_source"), F.col("chunk")).alias("chunk_id"), "text", pages.alias("page_numbers"), X.tokens(F.col("text")).alias("token_count"), block_ids.alias("block_ids"), *_kind("semantic"))


def split_point(text: str, toks: list[tuple[str, str, int, int]]) -> int:
    """Where a heading ends and its body begins, or 0: after the token that speaks most for it, the earliest on ties."""
    m = PREFIX.match(text)
    if not m or m.end() == 0:
        return 0
    best, at = 0, 0
    for i, (_, tag, start, length) in enumerate(toks):
        cut = m.end() + start + length
        if not HEAD[0] <= cut <= HEAD[1] or len(text) - cut < BODY:
            continue
        follows = toks[i + 1][1] if i + 1 < len(toks) else ""
        score = 3 * tag.startswith("NN") + 2 * (tag == "ETN") + follows.startswith("NN") + (cut < len(text) - cut)
        if score > best:
            best, at = score, cut
    return at


def heading_body(blocks: DataFrame, build: Callable | None) -> DataFrame:
    """Blocks with those cut in two that hold a heading and its body, the box at two fifths of its height; part numbers the pieces."""
    if build is None:
        return blocks.withColumn("part", F.lit(0))

    @F.pandas_udf("int")
    def cut(texts: pd.Series) -> pd.Series:
        engine, out = _engine(build), []
        for t in texts:
            m = PREFIX.match(t or "")
            try:
                out.append(split_point(t, engine(t[m.end() :])) if m else 0)
            except Exception:  # noqa: BLE001
                out.append(0)
        return pd.Series(out)

    b = blocks.withColumn("_c", cut(X.strip(F.col("text")))).withColumn("part", F.explode(F.when(F.col("_c") > 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    t, two, mid = X.strip(F.col("text")), F.col("_c") > 0, F.col("y0") + 0.4 * (F.col("y1") - F.col("y0"))
    piece = F.when(~two, F.col("text")).when(F.col("part") == 0, X.strip(F.substring(t, F.lit(1), F.col("_c")))).otherwise(X.strip(F.substring(t, F.col("_c") + 1, F.length(t))))
    return b.withColumns({"text": piece, "_y0": F.when(two & (F.col("part") == 1), mid).otherwise(F.col("y0")), "_y1": F.when(two & (F.col("part") == 0), mid).otherwise(F.col("y1"))}).withColumns({"y0": F.col("_y0"), "y1": F.col("_y1")}).drop("_c", "_y0", "_y1")
