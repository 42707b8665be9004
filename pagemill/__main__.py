"""Command line over a folder of PDF files.

    python -m pagemill inspect FOLDER [--search PHRASE] [--pages 1-3,7] [--blocks N] [--tables] [--low]
    python -m pagemill slice FOLDER --query TEXT [--k N] [--passages] [--anchors] [--no-references] [--out PATH]
    python -m pagemill files FOLDER
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import RetrievalConfig
from .operators import chunking, fusion, inspection, lexical
from .plans import search as P
from .sources import pages as sources
from .sources import sinks
from .sources.pdf import PdfPages


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="pagemill")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("inspect", "slice", "files"):
        one = commands.add_parser(name)
        one.add_argument("folder")
        one.add_argument("--extractor", default="auto")
        if name == "inspect":
            one.add_argument("--search")
            one.add_argument("--pages")
            one.add_argument("--blocks", type=int)
            one.add_argument("--tables", action="store_true")
            one.add_argument("--low", action="store_true")
        if name == "slice":
            one.add_argument("--query", required=True)
            one.add_argument("--k", type=int)
            one.add_argument("--passages", action="store_true")
            one.add_argument("--anchors", action="store_true")
            one.add_argument("--no-references", action="store_true")
            one.add_argument("--out")
    return parser.parse_args(given)


def read(spark: SparkSession, files: DataFrame, extractor: str, view: str = "pages") -> DataFrame:
    """A view of the files' contents, their names as doc_id; a scan's list of files is bounded."""
    spark.dataSource.register(PdfPages)
    paths = ",".join(r["path"] for r in files.select("path").collect())
    found = spark.read.format("pdf_pages").option("path", paths).option("extractor", extractor).option("view", view).load()
    return found.withColumn("doc_id", F.regexp_extract("path", "([^/]*)$", 1)).drop("path")


def inspected(args: argparse.Namespace, pages: DataFrame, tables: DataFrame, status: DataFrame) -> list[str]:
    """The lines of a report on the files."""
    out = []
    if args.search:
        out += [f"{r['doc_id']} p{r['page']}: {r['context']}" for r in inspection.phrase_search(pages, args.search).orderBy("doc_id", "page").toLocalIterator()]
    elif args.pages:
        out += [r["text"] for r in inspection.range_text(pages, args.pages).orderBy("doc_id").toLocalIterator()]
    elif args.blocks:
        out += [f"===== {r['doc_id']} {r['name']} =====\n{r['text']}" for r in inspection.map_blocks(pages, args.blocks).orderBy("doc_id", "block").toLocalIterator()]
    elif args.tables:
        out += [f"{r['doc_id']} p{r['page']} table {r['table_no']}: " + " | ".join(r["cells"]) for r in tables.orderBy("doc_id", "page", "table_no", "row_no").toLocalIterator()]
    elif args.low:
        out += [f"{r['doc_id']}: {r['n']} page(s) of little text, maybe scans: {r['pages']}" for r in inspection.low_text_pages(pages).orderBy("doc_id").toLocalIterator()]
    else:
        out += [f"{r['doc_id']}: {r['n_pages']} pages" if r["ok"] else f"{r['doc_id']}: can't be read ({r['error']})" for r in status.orderBy("doc_id").toLocalIterator()]
        out += [f"{r['doc_id']} p{r['page']}: {r['length']} characters" + ("  <- little text" if r["low"] else "") for r in inspection.page_info(pages).orderBy("doc_id", "page").toLocalIterator()]
    return out


def sliced(spark: SparkSession, args: argparse.Namespace, pages: DataFrame) -> tuple[DataFrame, str]:
    """The slice (query_id, text) and the coverage report of a question."""
    config = RetrievalConfig.of(spark, **({"k": args.k} if args.k else {}))
    questions = lexical.local(spark, [(1, args.query, config.k)], "query_id long, text string, k int")
    follow = not args.no_references
    if args.passages:
        passages = lexical.kept(chunking.passages(pages, config).select("doc_id", "passage_id", "page", "text"))
        scored = lexical.kept(P.hybrid(passages, questions, None, config))
        top = fusion.top_pages(fusion.page_scores(scored), config.k).select("query_id", "doc_id", "page")
        text = P.passage_slice(pages, passages, scored, config, args.anchors, follow)
    else:
        top = fusion.top_pages(lexical.bm25(pages, ["doc_id", "page"], questions, config), config.k).select("query_id", "doc_id", "page")
        text = P.slice_text(pages, top, config, follow, args.anchors)
    missing = lexical.missing_terms(pages, ["doc_id", "page"], questions, config)
    return text, P.coverage(questions, top, P.selected_pages(pages, top, config, follow), missing, config).first()["report"]


def main(given: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = arguments(given)
    spark = spark or SparkSession.builder.appName("pagemill").getOrCreate()
    files = sources.scan_files(spark, [args.folder])
    if args.command == "files":
        row = sinks.inventory(files).first()
        print(f"{row['n']} file(s)", *row["names"], sep="\n")
        return 0
    pages = lexical.kept(read(spark, files, args.extractor))
    try:
        if args.command == "inspect":
            print("\n".join(inspected(args, pages, read(spark, files, args.extractor, "tables"), read(spark, files, args.extractor, "status"))))
            return 0
        text, report = sliced(spark, args, pages)
        print(report, file=sys.stderr)
        row = text.first()
        if args.out:
            sinks.write_text(text, args.out)
        else:
            print(row["text"] if row else "")
        return 0 if row else 1
    finally:
        lexical.release()


if __name__ == "__main__":
    sys.exit(main())
