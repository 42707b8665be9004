"""Writers: slices, page blocks, tables, lists of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..operators import inspection


def write_text(slices: DataFrame, path: str, column: str = "text") -> None:
    """One text record for each row; line ends within it stay."""
    slices.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def write_blocks(pages: DataFrame, path: str, n: int = DEFAULT.map_block) -> None:
    """Page blocks in a folder for each block number, to be worked on one by one."""
    inspection.map_blocks(pages, n).write.mode("overwrite").partitionBy("block").json(path)


def write_tables(pages: DataFrame, path: str) -> None:
    """The rows of tables as CSV in a folder for each page and table, in order of the rows; the widest table gives the columns."""
    rows = inspection.table_rows(pages).withColumn("c", F.split("cells", "\t"))
    width = rows.agg(F.max(F.size("c")).alias("n")).first()["n"] or 0
    cells = [F.get("c", F.lit(i)).alias(f"c{i + 1}") for i in range(width)]
    out = rows.select("doc_id", "page", "table_no", "row_no", *cells)
    out.repartition("doc_id", "page", "table_no").sortWithinPartitions("doc_id", "page", "table_no", "row_no").write.mode("overwrite").partitionBy("doc_id", "page", "table_no").csv(path, header=True)


def inventory(files: DataFrame, names: int = 25) -> DataFrame:
    """(n, names): how many files there are, and the first names in the order of their paths, sorted."""
    first = files.orderBy("path").limit(names).agg(F.sort_array(F.collect_list("name")).alias("names"))
    n = files.count()
    return first.select(F.lit(n).cast("long").alias("n"), "names")
