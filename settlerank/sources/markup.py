"""Row and cell extraction from stored markup pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _plain(cell):
    return F.trim(F.regexp_replace(cell, "<[^>]+>", ""))


def table_rows(pages: DataFrame, html: str = "html", row_tag: str = "tr", cell_tag: str = "td",
               id_pattern: str = r"(\d{6,12})", keep: tuple[str, ...] = ()) -> DataFrame:
    """One record per markup row with at least two cells.

    ``first_text`` is the text of the first cell and ``last_id`` the last match of the pattern in the
    part of the second cell before a line break; null when nothing matches.
    """
    rows = pages.select(*keep, F.posexplode(
        F.regexp_extract_all(html, F.lit(f"(?s)<{row_tag}>(.*?)</{row_tag}>"), 1)).alias("row_no", "row_html"))
    cells = rows.withColumn(
        "cells", F.regexp_extract_all("row_html", F.lit(f"(?s)<{cell_tag}>(.*?)</{cell_tag}>"), 1))
    second = _plain(F.element_at(F.split(F.element_at("cells", 2), "<br"), 1))
    return cells.where(F.size("cells") >= 2).select(
        *keep, "row_no", _plain(F.element_at("cells", 1)).alias("first_text"),
        F.try_element_at(F.regexp_extract_all(second, F.lit(id_pattern), 1), F.lit(-1)).alias("last_id"))
