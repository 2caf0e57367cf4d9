"""Page layout: text blocks, tables and images of a page become one text in reading order.

Inputs are DataFrames keyed by (doc_id, page): text_blocks with seq, x0, y0, x1, y1, text, block_type; tables with
table_number, x0, y0, x1, y1, text or cells; images with seq, x0, y0, x1, y1, ext, width, height, size_bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import admitted, markdown
from ..functions.text import squeeze, strip

KEY = ["doc_id", "page"]
# The order of kinds at one place of a page, and the share of overlap that makes a block part of a table.
PRIORITY = {"text": 0, "table": 1, "image": 2}
OVERLAP = 0.3


def text_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks of type 0 that are not blank, their text squeezed."""
    return blocks.where("block_type = 0").withColumn("text", squeeze(F.col("text"))).where("text <> ''")


def table_segments(tables: DataFrame) -> DataFrame:
    """Admitted tables, rendered, with their numbers of rows and columns."""
    cells = F.col("cells")
    shape = {"row_count": F.size(cells), "col_count": F.array_max(F.transform(cells, F.size))}
    return tables.where(admitted(cells)).withColumns({"text": markdown(cells), **shape}).drop("cells")


def distinct_images(images: DataFrame) -> DataFrame:
    """Images without repeats (box to 0.1, size, format, bytes), numbered in order within their page."""
    rows = images.withColumn("ext", F.lower(F.coalesce(F.nullif("ext", F.lit("")), F.lit("png"))))
    key = [F.bround(c, 1) for c in ("x0", "y0", "x1", "y1")] + [F.col(c) for c in ("width", "height", "ext", "size_bytes")]
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*KEY, *key).orderBy("seq"))).where("_n = 1").drop("_n")
    return first.withColumn("image_number", F.row_number().over(Window.partitionBy(*KEY).orderBy("seq")))


def placeholder() -> Column:
    place = F.format_string("%.1f,%.1f,%.1f,%.1f", "x0", "y0", "x1", "y1")
    return F.format_string("[Image %d: format=%s, size=%dx%d, bbox=(%s)]", "image_number", "ext", "width", "height", place)


def public_metadata(images: DataFrame) -> DataFrame:
    """What may be shown of images: everything but their bytes; parts that are missing are null."""
    names = ("image_number", "ext", "width", "height", "xres", "yres", "colorspace", "bpc", "size_bytes")
    own = [F.col(c) if c in images.columns else F.lit(None).cast("int").alias(c) for c in names]
    return images.select(*KEY, *own, F.array("x0", "y0", "x1", "y1").alias("bbox"))


def _area(p: str) -> Column:
    return F.greatest((F.col(f"{p}x1") - F.col(f"{p}x0")) * (F.col(f"{p}y1") - F.col(f"{p}y0")), F.lit(1.0))


def overlap_ratio(left: str = "", right: str = "t_") -> Column:
    """Shared area over the smaller area (1.0 at least); 0 for boxes that do not overlap."""
    side = lambda c: (F.least(F.col(f"{left}{c}1"), F.col(f"{right}{c}1")), F.greatest(F.col(f"{left}{c}0"), F.col(f"{right}{c}0")))
    (hx, lx), (hy, ly) = side("x"), side("y")
    shared = (hx - lx) * (hy - ly)
    return F.when((hx <= lx) | (hy <= ly), 0.0).otherwise(shared / F.least(_area(left), _area(right)))


def contains(box: str, x: Column, y: Column) -> Column:
    return x.between(F.col(f"{box}x0"), F.col(f"{box}x1")) & y.between(F.col(f"{box}y0"), F.col(f"{box}y1"))


def outside_tables(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """Blocks whose centre is in no table of their page and that overlap none by OVERLAP or more: an anti-join on the page."""
    boxes = tables.select(*[F.col(c).alias(f"t_{c}") for c in (*KEY, "x0", "y0", "x1", "y1")])
    centre = contains("t_", (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2)
    same = (F.col("doc_id") == F.col("t_doc_id")) & (F.col("page") == F.col("t_page"))
    return blocks.join(boxes, same & (centre | (overlap_ratio() >= OVERLAP)), "left_anti")


def mode(tables: Column, images: Column) -> Column:
    return F.when((tables > 0) & (images > 0), "pymupdf_table_image_aware").when(tables > 0, "pymupdf_table_aware").when(images > 0, "pymupdf_image_aware").otherwise("pymupdf_sorted_text")


def merged(blocks: DataFrame, tables: DataFrame, images: DataFrame) -> DataFrame:
    """(doc_id, page, text, text_block_count, table_count, image_count, extraction_mode) of every page with a segment.

    tables have a text; images are numbered (see distinct_images). Counts of text blocks include those in tables.
    """
    cleaned = text_blocks(blocks)
    part = lambda df, kind, seq, text, n: df.select(*KEY, "y0", "x0", F.lit(PRIORITY[kind]).alias("kind"), F.col(seq).cast("long").alias("seq"), text.alias("text"), F.lit(n).alias("n"))
    shown = outside_tables(cleaned, tables)
    rows = part(shown, "text", "seq", F.col("text"), None).union(part(tables, "table", "table_number", F.col("text"), "table")).union(part(images, "image", "image_number", placeholder(), "image"))
    rows = rows.union(cleaned.select(*KEY, F.lit(None), F.lit(None), F.lit(None), F.lit(None), F.lit(None), F.lit("block")))
    order = F.sort_array(F.collect_list(F.when(strip(F.col("text")) != "", F.struct("y0", "x0", "kind", "seq", strip(F.col("text")).alias("text")))))
    count = lambda n: F.count(F.when(F.col("n") == n, 1)).cast("int")
    out = rows.groupBy(*KEY).agg(order.alias("held"), count("block").alias("text_block_count"), count("table").alias("table_count"), count("image").alias("image_count"))
    text = F.array_join(F.transform("held", lambda s: s["text"]), "\n\n")
    return out.select(*KEY, text.alias("text"), "text_block_count", "table_count", "image_count", mode(F.col("table_count"), F.col("image_count")).alias("extraction_mode"))


def assembled(pages: DataFrame, blocks: DataFrame, tables: DataFrame, images: DataFrame, with_tables: bool = True, with_images: bool = True) -> DataFrame:
    """Pages (doc_id, page, plain_text) with their merged text, or the plain text where nothing is merged.

    Counts are those of the segments used; text_block_count is null on pages that keep their plain text.
    """
    plain = pages.select(*KEY, "plain_text")
    if not with_tables and not with_images:
        return plain.select(*KEY, F.col("plain_text").alias("text"), F.lit(None).cast("int").alias("text_block_count"), F.lit(0).alias("table_count"), F.lit(0).alias("image_count"), F.lit("pymupdf_sorted_text").alias("extraction_mode"))
    found = merged(blocks, tables if with_tables else tables.where("false"), images if with_images else images.where("false")).where("table_count + image_count > 0")
    rows = plain.join(found, KEY, "left")
    text = F.coalesce(F.nullif("text", F.lit("")), "plain_text")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select(*KEY, text.alias("text"), "text_block_count", zero("table_count"), zero("image_count"), F.coalesce("extraction_mode", F.lit("pymupdf_sorted_text")).alias("extraction_mode"))
