"""python -m pageloom DOCUMENTS -o OUT [--format markdown|chunks] [--strategy ...] [--max-tokens N] [--stats]"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators import chunks
from .plans import parse
from .plans.config import Config


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="pageloom", description="Parse a Parquet table of documents (doc_id, text).")
    p.add_argument("documents")
    p.add_argument("-o", "--output", required=True)
    p.add_argument("--format", choices=("markdown", "chunks"), default="markdown")
    p.add_argument("--strategy", choices=tuple(chunks.STRATEGIES), default="by_title")
    p.add_argument("--max-tokens", type=int, default=500)
    p.add_argument("--header-ratio", type=float, default=Config.header_ratio)
    p.add_argument("--footer-ratio", type=float, default=Config.footer_ratio)
    p.add_argument("--stats", action="store_true", help="also write figures of the documents")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("pageloom").getOrCreate()
    parsed = parse.parse_documents(spark.read.parquet(a.documents), Config(header_ratio=a.header_ratio, footer_ratio=a.footer_ratio))
    if a.format == "markdown":
        parsed.markdown.write.mode("overwrite").parquet(a.output)
    else:
        options = {} if a.strategy == "by_page" else {"max_tokens": a.max_tokens}
        chunks.as_json(parse.chunk_document(parsed, a.strategy, **options)).select("json").write.mode("overwrite").text(a.output)
    if a.stats:
        parsed.stats.write.mode("overwrite").json(f"{a.output.rstrip('/')}-stats")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
