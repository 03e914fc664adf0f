"""Page sources: tables, pages, chunks and document heads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def pages_of_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, page, text): one page a line, from 1."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(text, "\n")).alias("pos", "text")).select("doc_id", (F.col("pos") + 1).alias("page"), "text")


def page_files(spark: SparkSession, paths: str | list[str], suffix: str = ".pdf") -> DataFrame:
    """(place, filename, path, content) of files with the suffix in any case, for a parser to read. paths may hold glob
    patterns; place counts the files from 1: pattern by pattern, sorted by path inside each, each file once."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    name = F.element_at(F.split("path", "/"), -1)
    files = None
    for i, pattern in enumerate(paths):
        own = spark.read.format("binaryFile").load(pattern).select(F.lit(i).alias("argument"), name.alias("filename"), "path", "content").where(is_wanted_file(F.col("filename"), suffix))
        files = own if files is None else files.unionByName(own)
    # Names are few against what the files hold: only they are put in order.
    order = files.groupBy("path").agg(F.min("argument").alias("argument"))
    order = order.withColumn("place", F.row_number().over(Window.orderBy("argument", "path")))
    return files.join(order, ["path", "argument"]).select("place", "filename", "path", "content")


def extract_pages(files: DataFrame, parser, max_pages: int | None = None) -> DataFrame:
    """Pages of document files. parser(bytes) yields, in order, (text or None, tables as lists of rows of
    cells); a page that it can't read gives an empty text."""

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                for number, (text, tables) in enumerate(parser(r.content), 1):
                    if max_pages and number > max_pages:
                        break
                    rows.append((r.filename, number, text or "", tables or []))
            import pandas as pd

            yield pd.DataFrame(rows, columns=["filename", "page", "text", "tables"])

    read = files.select("filename", "content").mapInPandas(run, "filename string, page int, text string, tables array<array<array<string>>>")
    return read.withColumn("tables_text", rendered_tables(F.col("tables"))).drop("tables")


def is_wanted_file(name: Column, suffix: str = ".pdf") -> Column:
    return F.lower(name).endswith(suffix)


def rendered_table(rows: Column) -> Column:
    """TABLE: and one line for each row with a cell that isn't blank; null for a table without such."""
    kept = F.filter(rows, lambda r: F.exists(r, lambda c: F.coalesce(c, F.lit("")).rlike(r"\S")))
    cell = lambda c: F.replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", ""), F.lit("\n"), F.lit(" "))
    lines = F.transform(kept, lambda r: F.array_join(F.transform(r, cell), " | "))
    return F.when(F.size(kept) > 0, F.concat(F.lit("TABLE:\n"), F.array_join(lines, "\n")))


def rendered_tables(tables: Column) -> Column:
    return F.array_join(F.filter(F.transform(tables, rendered_table), lambda t: t.isNotNull()), "\n")


def combined(text: Column, tables_text: Column) -> Column:
    return F.concat(F.coalesce(text, F.lit("")), F.when(F.coalesce(tables_text, F.lit("")) != "", F.concat(F.lit("\n"), tables_text)).otherwise(""))


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(r"(?U)\S")


def chunks(pages: DataFrame, pages_per_chunk: int = 10) -> DataFrame:
    """(doc_id, chunk, start_page, end_page, text) of pages (doc_id, page, combined). Blank pages are left
    out, all-blank chunks too (numbers keep the gap)."""
    body = F.concat(F.lit("[[page "), F.col("page"), F.lit("]]\n"), F.col("combined"))
    grouped = pages.where(~is_blank(F.col("combined"))).groupBy("doc_id", F.floor((F.col("page") - 1) / pages_per_chunk).cast("int").alias("chunk"))
    ordered = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", body.alias("body")))), lambda s: s["body"]), "\n\n")
    return grouped.agg(F.min("page").alias("start_page"), F.max("page").alias("end_page"), ordered.alias("text"))


def doc_heads(pages: DataFrame, n: int = 3, limit: int = 6000) -> DataFrame:
    """(doc_id, head): the first n pages, cut at limit characters."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("page", "combined"))), lambda s: s["combined"])
    return pages.where(F.col("page") <= n).groupBy("doc_id").agg(F.substring(F.array_join(ordered, "\n\n"), 1, limit).alias("head"))
