"""From lines of any shape to clean dishes: input columns, choice of the parser, repair and removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.operators import cleanup, parse

BOX = ("bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2")
PARSERS = ("v1", "v2", "v3", "cascade")
DEFAULT = "v3"


def normalize_lines(lines: DataFrame) -> DataFrame:
    """Lines with all columns that the parsers take.

    Text comes from ``text``, or where that column is missing from ``line_text``; boxes that are not known are null. Pages
    without ids are one page, whose id is the empty string. Order can't be guessed from a distributed table: ``line_order``
    is required.
    """
    have = set(lines.columns)
    if "line_order" not in have or not have & {"text", "line_text"}:
        raise ValueError("lines need line_order and text (or line_text)")
    text = F.col("text") if "text" in have else F.col("line_text")
    ids: list[Column] = [(F.coalesce(F.col(k).cast("string"), F.lit("")) if k in have else F.lit("")).alias(k) for k in parse.KEY]
    boxes = [(F.col(c) if c in have else F.lit(None)).cast("double").alias(c) for c in BOX]
    return lines.select(*ids, F.col("line_order").cast("int").alias("line_order"), F.coalesce(text.cast("string"), F.lit("")).alias("text"), *boxes)


def parser_for(name: str | None, roles: DataFrame | None) -> str:
    """The parser that runs: an unknown name falls back to ``v3``, and the cascade without roles of lines to ``v2``."""
    if name == "cascade" and roles is None:
        return "v2"
    return name if name in PARSERS else DEFAULT


def parse_menu(lines: DataFrame, parser: str | None = DEFAULT, roles: DataFrame | None = None) -> DataFrame:
    """Dishes of every page after repair and removal.

    roles: menu_id, page_id, line_order, text, label, score of lines; the cascade chooses by them, and removal uses them
    with every parser.
    """
    rows, chosen = normalize_lines(lines), parser_for(parser, roles)
    items = parse.cascade(rows, roles) if chosen == "cascade" else parse.parse_pages(rows, chosen)
    return cleanup.clean_items(items, roles, tuple(parse.KEY))
