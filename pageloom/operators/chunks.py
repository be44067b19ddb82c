"""Chunks for retrieval: by page, by fixed size, by title."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.config import DEFAULT

ORDER = ("page_num", "seq")


def chunk_id(source: Column, number: Column) -> Column:
    return F.format_string("%s-%04d", source, number)


def by_page(blocks: DataFrame, source: Column) -> DataFrame:
    """One chunk a page with text; the number in the id counts pages without text too."""
    t = F.when(X.strip(F.col("text")) != "", F.col("text"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", t.alias("t")))), lambda x: x["t"]), "\n")
    p = blocks.withColumn("_source", source).groupBy("doc_id", "page_num").agg(text.alias("text"), _ids(blocks), F.first("_source").alias("_source"))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_num")) - 1
    out = p.withColumn("chunk_id", chunk_id(F.col("_source"), n)).where(X.strip(F.col("text")) != "")
    return out.select("doc_id", "chunk_id", "text", F.array("page_num").alias("page_numbers"), X.tokens(F.col("text")).alias("token_count"), "block_ids", *_kind("by_page"))


def _ids(blocks: DataFrame) -> Column:
    """block_ids of a group: those of its blocks with text and an id, in order; none where blocks have no ids."""
    if "block_id" not in blocks.columns:
        return F.first(F.array().cast("array<string>")).alias("block_ids")
    own = F.when(X.strip(F.col("text")) != "", F.col("block_id"))
    return F.array_compact(F.transform(F.array_sort(F.collect_list(F.struct(*ORDER, own.alias("id")))), lambda x: x["id"])).alias("block_ids")


def _kind(name: str) -> list[Column]:
    return [F.lit(name).alias("chunk_type"), F.create_map().cast("map<string,string>").alias("metadata")]


def packer(limit: int):
    """Numbers of chunks for a document's blocks in order: a block that would pass the limit starts a chunk, and so does a new group.

    The running total depends on where the last chunk began, which no window can say; Arrow batches of whole documents.
    """

    @F.pandas_udf("array<int>")
    def pack(tokens: pd.Series, groups: pd.Series) -> pd.Series:
        out = []
        for ts, gs in zip(tokens, groups):
            held, number, before, mine = 0, 0, None, []
            for i, (t, g) in enumerate(zip(ts, gs)):
                if i and (g != before or held + t > limit):
                    number, held = number + 1, 0
                held, before = held + t, g
                mine.append(number)
            out.append(mine)
        return pd.Series(out)

    return pack


def _packed(blocks: DataFrame, limit: int) -> DataFrame:
    """Adds chunk to blocks with text and a column group."""
    b = blocks.where(X.strip(F.col("text")) != "")
    cols = [c for c in b.columns if c != "doc_id"]
    row = F.struct(*ORDER, *(c for c in cols if c not in ORDER))
    d = b.groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("r"))
    d = d.withColumn("k", packer(limit)(F.transform("r", lambda x: X.tokens(x["text"])), F.transform("r", lambda x: x["group"].cast("int"))))
    return d.select("doc_id", F.explode(F.arrays_zip("r", "k")).alias("z")).select("doc_id", "z.r.*", F.col("z.k").alias("chunk"))


def _chunks(packed: DataFrame, source: Column, kind: str, prefix: Column | None = None) -> DataFrame:
    inside = F.struct(*ORDER, "text")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(inside)), lambda x: x["text"]), "\n")
    g = packed.withColumn("_source", source).groupBy("doc_id", "chunk").agg(text.alias("text"), F.array_sort(F.collect_set("page_num")).alias("page_numbers"), F.first("_source").alias("_source"), _ids(packed), *([F.first("path").alias("heading_path")] if prefix is not None else []))
    if prefix is not None:
        head = F.array_join("heading_path", " > ")
        g = g.withColumn("text", F.when(head != "", F.concat(head, F.lit("\n\n"), F.col("text"))).otherwise(F.col("text")))
    return g.select("doc_id", chunk_id(F.col("_source"), F.col("chunk")).alias("chunk_id"), "text", "page_numbers", X.tokens(F.col("text")).alias("token_count"), *(["heading_path"] if prefix is not None else []), "block_ids", *_kind(kind))


def fixed(blocks: DataFrame, source: Column, max_tokens: int = DEFAULT.max_tokens) -> DataFrame:
    """Blocks packed in order up to a number of tokens; a larger block is a chunk of its own."""
    return _chunks(_packed(blocks.select("doc_id", *ORDER, "text", *_has_ids(blocks)).withColumn("group", F.lit(0)), max_tokens), source, "fixed")


def _has_ids(blocks: DataFrame) -> list[str]:
    return ["block_id"] if "block_id" in blocks.columns else []


def with_path(blocks: DataFrame) -> DataFrame:
    """Adds path: the headings above a block on its page, a heading's own included."""
    w = Window.partitionBy("doc_id", "page_num").orderBy("seq")
    heading = F.col("block_type") == "heading"
    level = F.when(heading, F.when(F.col("heading_level") > 0, F.col("heading_level")).otherwise(1))
    at = F.struct(F.col("seq").alias("at"), X.strip(F.col("text")).alias("t"))
    b = blocks.withColumn("_lv", level)
    b = b.withColumns({f"_l{k}": F.last(F.when(F.col("_lv") == k, at), ignorenulls=True).over(w) for k in range(1, 7)})
    steps, newest = [], F.lit(-1)
    for k in range(1, 7):
        here = F.col(f"_l{k}")
        steps.append(F.when(here["at"] > newest, here["t"]))
        newest = F.greatest(newest, here["at"])
    return b.withColumn("path", F.array_compact(F.array(*steps))).drop("_lv", *(f"_l{k}" for k in range(1, 7)))


def folder(least: int):
    """For a document's groups in order (tokens, path): the group that each goes into, and that group's path.

    A group under the limit goes into the one before if one path begins with the other; the shorter path stays. What the
    one before is called depends on what went into it, so that a document is one row of an Arrow batch.
    """

    @F.pandas_udf("array<struct<into:int,path:array<string>>>")
    def fold(tokens: pd.Series, paths: pd.Series) -> pd.Series:
        out = []
        for ts, ps in zip(tokens, paths):
            kept: list[tuple] = []
            into = []
            for t, p in zip(ts, map(tuple, ps)):
                n = min(len(p), len(kept[-1])) if kept else 0
                if kept and t < least and p[:n] == kept[-1][:n]:
                    kept[-1] = p[:n]
                else:
                    kept.append(p)
                into.append(len(kept) - 1)
            out.append([{"into": i, "path": list(kept[i])} for i in into])
        return pd.Series(out)

    return fold


def by_title(blocks: DataFrame, source: Column, max_tokens: int = DEFAULT.max_tokens, combine_under_n: int = 0) -> DataFrame:
    """Blocks under the same headings, packed up to a number of tokens, after their path of headings; groups under ``combine_under_n`` tokens go into the one before, if that is above, below or the same."""
    b = with_path(blocks.where(X.strip(F.col("text")) != "")).select("doc_id", *ORDER, "text", "path", *_has_ids(blocks))
    w = Window.partitionBy("doc_id").orderBy(*ORDER)
    new = F.lag("path").over(w).isNull() | (F.lag("path").over(w) != F.col("path"))
    b = b.withColumn("_new", new.cast("int")).withColumn("group", F.sum("_new").over(w)).drop("_new")
    if combine_under_n > 0:
        whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*ORDER, "text"))), lambda x: x["text"]), " ")
        g = b.groupBy("doc_id", "group").agg(X.tokens(whole).alias("n"), F.first("path").alias("path"))
        d = g.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("group", "n", "path"))).alias("g"))
        d = d.withColumn("f", folder(combine_under_n)(F.transform("g", lambda x: x["n"]), F.transform("g", lambda x: x["path"])))
        to = d.select("doc_id", F.explode(F.arrays_zip("g", "f")).alias("z")).select("doc_id", F.col("z.g.group").alias("group"), F.col("z.f.into").alias("_into"), F.col("z.f.path").alias("_path"))
        b = b.join(to, ["doc_id", "group"]).withColumns({"group": F.col("_into"), "path": F.col("_path")}).drop("_into", "_path")
    return _chunks(_packed(b, max_tokens), source, "by_title", F.col("path"))


def semantic(blocks: DataFrame, source: Column, max_tokens: int = DEFAULT.max_tokens, tokenizer=None) -> DataFrame:
    """Sentences packed up to a number of tokens; as fixed without a tokenizer, which finds the sentences."""
    if tokenizer is None:
        return fixed(blocks, source, max_tokens)
    from . import tokenized

    return tokenized.semantic_chunks(blocks, source, tokenizer, max_tokens)


STRATEGIES = {"by_page": by_page, "fixed": fixed, "by_title": by_title, "semantic": semantic}
KEYS = ("chunk_id", "text", "block_ids", "page_numbers", "heading_path", "chunk_type", "token_count", "metadata")


def chunked(blocks: DataFrame, source: Column, strategy: str = "by_title", **options) -> DataFrame:
    """Chunks by a named strategy: doc_id and the columns of ``KEYS``, heading_path only by title."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; known are {', '.join(STRATEGIES)}")
    return STRATEGIES[strategy](blocks, source, **options)


def as_json(chunks: DataFrame) -> DataFrame:
    """One JSON object a chunk: all of ``KEYS`` in this order; an empty list or object where a strategy gives none."""
    empty = {"heading_path": F.array().cast("array<string>"), "block_ids": F.array().cast("array<string>"), "metadata": F.create_map().cast("map<string,string>")}
    cols = [(F.col(k) if k in chunks.columns else empty.get(k, F.lit(None).cast("string"))).alias(k) for k in KEYS]
    return chunks.select("doc_id", "chunk_id", F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("json"))
