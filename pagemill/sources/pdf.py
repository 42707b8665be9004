"""PDF pages as a Python data source; the extractors are optional.

    spark.dataSource.register(PdfPages)
    spark.read.format("pdf_pages").option("extractor", "auto").load("/folder/a.pdf,/folder/b.pdf")

One partition for each file; a page that can't be read is empty but stays, so
that numbers are exact. With view=outline the rows are (path, pos, title), with
view=tables (path, page, table_no, row_no, cells), with view=status (path, ok,
n_pages, error). A file that can't be read has no rows and is told by the
status view; onError=fail raises instead. failOnMissing=true raises at once
for paths that don't exist.
"""

from __future__ import annotations

import importlib.util
import os

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .pdf_file import PdfFile

VIEWS = {
    "pages": "path string, page int, text string", "outline": "path string, pos int, title string", "tables": "path string, page int, table_no int, row_no int, cells array<string>",
    "status": "path string, ok boolean, n_pages int, error string",
}
EXTRACTORS = {"pdfium": "pypdfium2", "pypdf": "pypdf"}


def extractor_name(wanted: str = "auto") -> str:
    """The extractor that is asked for; with auto pdfium if it is there, else pypdf, else the built-in one (pdf_file.py)."""
    if wanted in ("pypdf", "builtin"):
        return wanted
    return next((name for name, module in EXTRACTORS.items() if importlib.util.find_spec(module)), "builtin")


def builtin(path: str) -> PdfFile:
    with open(path, "rb") as f:
        return PdfFile(f.read())


def text_of_pages(path: str, extractor: str) -> list[str]:
    if extractor == "builtin":
        file = builtin(path)
        return [_safe(lambda page=page: file.text(page)) for page in file.pages()]
    if extractor == "pdfium":
        import pypdfium2

        document = pypdfium2.PdfDocument(path)
        try:
            return [_safe(lambda i=i: document[i].get_textpage().get_text_range()) for i in range(len(document))]
        finally:
            document.close()
    import pypdf

    return [_safe(page.extract_text) for page in pypdf.PdfReader(path).pages]


def outline_titles(path: str, extractor: str = "auto") -> list[str]:
    """Titles of the first level of bookmarks; none if they can't be read."""
    try:
        if extractor == "builtin" or importlib.util.find_spec("pypdf") is None:
            return builtin(path).titles()
        import pypdf

        return [str(x.title) for x in pypdf.PdfReader(path).outline if getattr(x, "title", None)]
    except Exception:
        return []


def table_rows(path: str):
    """(page, table_no, row_no, cells) of the tables that the optional table extractor finds; without it, of lines with bars between cells."""
    if importlib.util.find_spec("pdfplumber") is None:
        for number, text in enumerate(text_of_pages(path, extractor_name()), start=1):
            yield from ((number, *row) for row in barred_rows(text))
        return
    import pdfplumber

    with pdfplumber.open(path) as document:
        for number, page in enumerate(document.pages, start=1):
            for table_no, table in enumerate(page.extract_tables() or [], start=1):
                for row_no, row in enumerate(table, start=1):
                    yield number, table_no, row_no, [x or "" for x in row]


def barred_rows(text: str):
    """(table_no, row_no, cells) of the runs of lines that have a bar."""
    table, row, inside = 0, 0, False
    for line in text.split("\n"):
        table, row, inside = (table + (not inside), row + 1 if inside else 1, True) if "|" in line else (table, row, False)
        if inside:
            yield table, row, [x.strip() for x in line.strip().removeprefix("|").removesuffix("|").split("|")]


def _safe(read) -> str:
    try:
        return read() or ""
    except Exception:
        return ""


class PdfPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pdf_pages"

    def schema(self) -> str:
        return VIEWS[self.options.get("view", "pages")]

    def reader(self, schema) -> DataSourceReader:
        return PdfReader(dict(self.options))


class PdfReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = [p.strip() for p in options["path"].split(",") if p.strip()]
        self.view = options.get("view", "pages")
        self.extractor = extractor_name(options.get("extractor", "auto"))
        self.fail = options.get("onerror", options.get("onError", "skip")) == "fail"
        if str(options.get("failonmissing", options.get("failOnMissing", "false"))).lower() == "true":
            missing = [p for p in self.paths if not os.path.exists(p)]
            if missing:
                raise FileNotFoundError(f"no such file: {', '.join(missing)}")

    def partitions(self):
        return [InputPartition(p) for p in self.paths]

    def read(self, partition):
        path = partition.value
        try:
            rows = list(self._rows(path))
        except Exception as e:  # extractors raise errors of any kind on broken files
            if self.fail:
                raise
            rows = [(path, False, None, f"{type(e).__name__}: {e}")] if self.view == "status" else []
        yield from rows

    def _rows(self, path: str):
        if self.view == "tables":
            for row in table_rows(path):
                yield (path, *row)
        elif self.view == "outline":
            for i, title in enumerate(outline_titles(path, self.extractor)):
                yield path, i, title
        elif self.view == "status":
            yield path, True, len(text_of_pages(path, self.extractor)), None
        else:
            for i, text in enumerate(text_of_pages(path, self.extractor)):
                yield path, i + 1, text
