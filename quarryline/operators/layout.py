"""Structure of extracted tables: header rows, header paths, units, and rows as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from .tables import filled_down

MOST_HEADER_ROWS, NUMERIC_SHARE = 5, 0.6
#: Units that a header may name.
HEADER_UNIT = r"(?i)(?:\(|（|/)(%|℃|°C|K|d|h|min|s|mg/L|g/L|mg/g|g/kg|ppm|pH)(?:\)|）)?"


def header_rows(cells: DataFrame) -> DataFrame:
    """table_id, header_rows of cells(table_id, row, column, text): rows before the first (not the top) of numbers, five at most."""
    text = strip(F.coalesce("text", F.lit("")))
    lines = cells.groupBy("table_id", "row").agg(F.count_if(text != "").alias("n"), F.count_if(text.rlike(r"\d")).alias("digits"))
    data = (F.col("row") > 0) & (F.col("row") < MOST_HEADER_ROWS) & (F.col("n") > 0) & (F.col("digits") >= NUMERIC_SHARE * F.col("n"))
    return lines.groupBy("table_id").agg(F.least(F.coalesce(F.min(F.when(data, F.col("row"))), F.lit(MOST_HEADER_ROWS)), F.max("row") + 1).alias("header_rows"))


def header_paths(cells: DataFrame) -> DataFrame:
    """table_id, column, path, unit: a column's header texts from the top, repeats left out, gaps filled from above."""
    heads = cells.join(header_rows(cells), "table_id").filter(F.col("row") < F.col("header_rows"))
    named = heads.withColumn("text", F.nullif(strip(F.coalesce("text", F.lit(""))), F.lit("")))
    full = filled_down(named, "text", ["table_id", "column"], "row")
    ordered = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("row", "text")))), lambda r: r["text"]))
    paths = full.groupBy("table_id", "column").agg(ordered.alias("path"))
    return paths.withColumn("unit", F.nullif(F.regexp_extract(F.array_join("path", " / "), HEADER_UNIT, 1), F.lit("")))


def row_texts(cells: DataFrame) -> DataFrame:
    """table_id, row, text: "header: value" segments of each row below the header; blank cells are skipped."""
    body = cells.join(header_rows(cells), "table_id").filter(F.col("row") >= F.col("header_rows")).join(header_paths(cells).select("table_id", "column", F.array_join("path", " / ").alias("head")), ["table_id", "column"], "left")
    value = strip(F.coalesce("text", F.lit("")))
    segment = F.when(value != "", F.concat_ws(": ", F.nullif("head", F.lit("")), value))
    return body.groupBy("table_id", "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(segment.isNotNull(), F.struct("column", segment.alias("s"))))), lambda r: r["s"]), " | ").alias("text"))


def merged_cells(boxes: DataFrame) -> DataFrame:
    """table_id, row, column, row_span, column_span of cells(table_id, row, column, box) that share a box with others."""
    key = F.transform("box", lambda v: F.round(v, 3))
    found = boxes.filter(F.col("box").isNotNull()).groupBy("table_id", key.alias("box")).agg(F.min("row").alias("row"), F.min("column").alias("column"), (F.max("row") - F.min("row") + 1).alias("row_span"), (F.max("column") - F.min("column") + 1).alias("column_span"))
    return found.filter("row_span > 1 or column_span > 1").drop("box")


def scaled(boxes: DataFrame, image: tuple[float, float], page: tuple[float, float]) -> DataFrame:
    """boxes(x0, y0, x1, y1) from image pixels to page points, three decimals."""
    fx, fy = page[0] / image[0], page[1] / image[1]
    return boxes.withColumns({c: F.bround(F.col(c) * (fx if c[0] == "x" else fy), 3) for c in ("x0", "y0", "x1", "y1")})


#: A label that is a value, with or without its deviation and unit; bounds of the classes as shares of the figure.
VALUE_LABEL = r"(?i)^[-+]?\d+(?:\.\d+)?(?:\s*(?:±|\+/-)\s*\d+(?:\.\d+)?)?\s*(?:%|℃|°C|K|d|h|min|s|mg/L|g/L|ppm|pH)?$"
DIRECT_LEFT, DIRECT_BOTTOM, X_TOP, Y_RIGHT, LEGEND_LEFT = 0.12, 0.82, 0.72, 0.22, 0.6


def label_classes(text: Column, x: Column, y: Column, width: Column, height: Column) -> Column:
    """The sorted classes of a figure's label by its upper left corner: direct (a value off the axes), x_axis, y_axis, legend.

    A label may have several or none; a legend is right of the middle and no axis label.
    """
    value = strip(text).rlike(VALUE_LABEL)
    x_axis, y_axis = (y >= height * X_TOP) & ~value, (x <= width * Y_RIGHT) & ~value
    classes = {"direct": value & (x > width * DIRECT_LEFT) & (y < height * DIRECT_BOTTOM), "legend": (x >= width * LEGEND_LEFT) & ~x_axis & ~y_axis, "x_axis": x_axis, "y_axis": y_axis}
    return F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in classes.items())))


def rounded(c: Column, places: int = 3) -> Column:
    """A coordinate; halves go to the even neighbour."""
    return F.bround(c, places)


def numbered_blanks(rows: DataFrame, by: str, order: str) -> DataFrame:
    """A sequence number that counts blank rows too; blanks are dropped afterwards."""
    w = Window.partitionBy(by).orderBy(order)
    return rows.withColumn("sequence_no", F.row_number().over(w)).filter(F.length(strip(F.coalesce("text", F.lit("")))) > 0)
