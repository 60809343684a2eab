"""Text of PDF pages (already extracted): cleaning, Markdown, dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean_page(c: Column) -> Column:
    c = F.regexp_replace(c, r"\n\s*\n\s*\n", "\n\n")
    c = F.regexp_replace(c, r" +", " ")
    c = F.regexp_replace(c, "[\\x00�]", "")
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def page_markdown(c: Column) -> Column:
    def line(raw):
        x = F.trim(raw)
        upper = x.rlike(r"\p{Lu}") & ~x.rlike(r"\p{Ll}")
        head = (F.length(x) < 100) & upper & (F.size(F.split(x, r"\s+")) < 10)
        return F.when(x == "", "").when(head, F.concat(F.lit("## "), F.initcap(F.lower(x)))).otherwise(x)

    return F.array_join(F.transform(F.split(c, "\n"), line), "\n")


def pdf_date(c: Column) -> Column:
    digits = F.regexp_extract(F.regexp_replace(c, "^D:", ""), r"^(\d{14})", 1)
    return F.try_to_timestamp(F.nullif(digits, F.lit("")), F.lit("yyyyMMddHHmmss"))


def document_text(pages: DataFrame, doc: str, page_no: str, text: str) -> DataFrame:
    """Pages joined by a blank line in page order; a document is one text value by definition."""
    return pages.groupBy(doc).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(page_no, text))), lambda x: x[text]), "\n\n")
        .alias("text"), F.count(F.lit(1)).alias("n_pages"))
