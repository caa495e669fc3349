"""The HTML contact sheet, one DataFrame row per table row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandcut.operators.ordering import as_list, running_position

# Fixed values of the sheet: cells per row, image size and the colour per type.
SHEET_WIDTH = 41
IMAGE_SIZE = (32, 96)
TYPE_COLOURS = {
    "c00": "rgb(57, 133, 71)",
    "c01": "yellow",
    "c02": "rgb(145, 243, 118)",
    "c03": "rgb(71, 237, 124)",
    "c04": "rgb(240, 66, 8)",
    "c05": "rgb(108, 126, 243)",
    "c06": "rgb(125, 16, 234)",
    "c07": "rgb(240, 5, 181)",
    "c08": "rgb(140, 63, 80)",
    "c09": "rgba(140, 151, 72, 0.432)",
    "c10": "rgba(202, 13, 244, 0.846)",
}


def sheet_head() -> str:
    styles = " ".join(f"#{name} {{background-color: {colour};}}" for name, colour in TYPE_COLOURS.items())
    return f"<!DOCTYPE html><html><head><style>td {{text-align: center;}} {styles}</style></head><body><table>"


SHEET_FOOT = "</table></body></html>"


def sheet_layout(df: DataFrame, part: str | Sequence[str], order: str, width: int = SHEET_WIDTH, **options) -> DataFrame:
    """Add ``row_no`` and ``col_no``: ``width`` items to a row, in order."""
    placed = running_position(df, part, order, "__at", **options)
    at = F.col("__at")
    return placed.withColumns({"row_no": F.floor(at / width), "col_no": at % width}).drop("__at")


def contact_sheet(
    laid_out: DataFrame, part: str | Sequence[str], idx_text: str, type_text: str, image: str
) -> DataFrame:
    """HTML of each sheet row: the types, the indexes less their first digit, the images.

    A sheet stays many rows, each as long as the sheet is wide; the sink puts
    them in order between head and foot.
    """
    keys = [*as_list(part), "row_no"]
    cells = laid_out.groupBy(*keys).agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    "col_no",
                    F.col(idx_text).alias("i"),
                    F.col(type_text).alias("t"),
                    F.col(image).alias("p"),
                )
            )
        ).alias("__cells")
    )
    width, height = IMAGE_SIZE
    types = F.transform("__cells", lambda c: F.concat(F.lit('<td id="c'), c["t"], F.lit('">'), c["t"], F.lit("</td>")))
    indexes = F.transform("__cells", lambda c: F.concat(F.lit("<td>"), F.substring(c["i"], 2, 1 << 30), F.lit("</td>")))
    images = F.transform(
        "__cells",
        lambda c: F.concat(
            F.lit('<td><img src="'), c["p"], F.lit(f'" width="{width}" height="{height}"></td>')
        ),
    )
    rows = [F.concat(F.lit("<tr>"), F.array_join(x, ""), F.lit("</tr>")) for x in (types, indexes, images)]
    return cells.select(*keys, F.concat(*rows).alias("html"))


def sheet_document(sheet: DataFrame, dirs: DataFrame, directory: str) -> DataFrame:
    """Sheet rows plus one head and one foot line per directory, ordered by ``line_no``.

    ``dirs`` lists all directories, so that one without any slice still gets a
    sheet. ``line_no`` is -1 for the head; the foot sorts after every row.
    """
    foot = (1 << 62)
    body = sheet.select(directory, F.col("row_no").cast("bigint").alias("line_no"), "html")
    ends = dirs.select(directory).distinct().select(
        directory,
        F.explode(
            F.array(
                F.struct(F.lit(-1).cast("bigint").alias("line_no"), F.lit(sheet_head()).alias("html")),
                F.struct(F.lit(foot).cast("bigint").alias("line_no"), F.lit(SHEET_FOOT).alias("html")),
            )
        ).alias("__e"),
    )
    return body.unionByName(ends.select(directory, "__e.line_no", "__e.html"))
