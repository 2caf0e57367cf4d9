"""Queries over the supplied tables, one for each operator or group of operators, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..deploy import ship
from ..functions import options, tables, text
from ..operators import address, assistant, chunking, layout, names, numbering, rsa
from ..sources import catalog, docx, files

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (read) -> DataFrame, read giving a table by name, with its SQL."""

    def add(f):
        name = f.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))

        _QUERIES[name] = run
        if sql:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


#: Rows of a task whose rows are costly.
SPREAD = 2000


def spread(rows: DataFrame, each: int = SPREAD) -> DataFrame:
    """``rows`` dealt evenly over tasks of about ``each`` rows: tables of small rows are one split of a file, however much work each row is."""
    return rows.repartition(max(1, -(-rows.count() // each)))


def _pages(read) -> DataFrame:
    return read("documents").select("doc_id", F.lit(1).alias("page_number"), "text")


# Chunking

_WINDOWS = """
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents),
k AS (SELECT doc_id, w, unnest(range(0, 1 + CAST(greatest(ceil((len(w) - {size}) / {step}.0), 0) AS BIGINT))) AS k FROM w WHERE len(w) > 0),
c AS (SELECT doc_id, k, w[k * {step} + 1 : k * {step} + {size}] AS p FROM k)
SELECT doc_id, CAST(k + 1 AS INTEGER) AS chunk_id, 1 AS page_number, '1' AS page_range, CAST(len(p) AS INTEGER) AS word_count,
       array_to_string(p, ' ') AS content FROM c
"""


@query(_WINDOWS.format(size=400, step=350))
def chunk_fixed_size(read):
    return chunking.chunk(_pages(read), "fixed_size", {"chunk_size": 400, "overlap": 50}, single_page=True)


@query(_WINDOWS.format(size=200, step=200))
def chunk_fixed_size_no_overlap(read):
    return chunking.chunk(_pages(read), "fixed_size", {"chunk_size": 200, "overlap": 0}, single_page=True)


@query("SELECT doc_id, 1 AS chunk_id, 1 AS page_number, '1' AS page_range, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS INTEGER) AS word_count, text AS content FROM documents")
def chunk_by_page(read):
    return chunking.chunk(_pages(read), "by_page", single_page=True)


_SENTENCES = """
WITH RECURSIVE b AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\\n\\s*\\n+')) AS b, generate_subscripts(regexp_split_to_array(text, '\\n\\s*\\n+'), 1) AS i FROM documents),
s AS (SELECT doc_id, i, unnest(l) AS s, generate_subscripts(l, 1) AS j FROM (SELECT doc_id, i, string_split(regexp_replace(regexp_replace(b, '([。！？；])', '\\1' || chr(1), 'g'), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS l FROM b)),
t AS (SELECT doc_id, trim(s, E' \\t\\n\\r\\x0b\\x0c') AS s, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS n FROM s WHERE trim(s, E' \\t\\n\\r\\x0b\\x0c') <> ''),
r AS (
  SELECT doc_id, n, s, 1 AS g, length(s) AS l FROM t WHERE n = 1
  UNION ALL
  SELECT t.doc_id, t.n, t.s, CASE WHEN r.l + 1 + length(t.s) > 1200 THEN r.g + 1 ELSE r.g END,
         CASE WHEN r.l + 1 + length(t.s) > 1200 THEN length(t.s) ELSE r.l + 1 + length(t.s) END
  FROM r JOIN t ON t.doc_id = r.doc_id AND t.n = r.n + 1
),
c AS (SELECT doc_id, CAST(g AS INTEGER) AS chunk_id, string_agg(s, ' ' ORDER BY n) AS content FROM r GROUP BY doc_id, g)
"""


@query(_SENTENCES + "SELECT doc_id, chunk_id, 1 AS page_number, '1' AS page_range, CAST(len(list_filter(regexp_split_to_array(content, '\\s+'), lambda x: x <> '')) AS INTEGER) AS word_count, content FROM c")
def chunk_sentence(read):
    return chunking.chunk(_pages(read), "sentence", {"max_chars": 1200}, single_page=True)


@query(_SENTENCES + "SELECT lang, count(*) AS docs, CAST(count(*) AS BIGINT) AS total_pages, CAST(sum(coalesce(n, 0)) AS BIGINT) AS total_chunks FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id) USING (doc_id) GROUP BY lang")
def chunk_totals_by_lang(read):
    pages = _pages(read)
    held = chunking.counts(pages, "sentence")
    return held.join(read("documents").select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.count("*").alias("docs"), F.sum("total_pages").alias("total_pages"), F.sum("total_chunks").alias("total_chunks"))


@query("""
WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM conversations),
k AS (SELECT conv_id, turn, w, unnest(range(0, 1 + CAST(greatest(ceil((len(w) - 20) / 15.0), 0) AS BIGINT))) AS k FROM w WHERE len(w) > 0)
SELECT conv_id AS doc_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) AS INTEGER) AS chunk_id, CAST(turn AS INTEGER) AS page_number,
       CAST(turn AS VARCHAR) AS page_range, CAST(len(w[k * 15 + 1 : k * 15 + 20]) AS INTEGER) AS word_count, array_to_string(w[k * 15 + 1 : k * 15 + 20], ' ') AS content FROM k
""")
def chunk_many_pages(read):
    """Turns as the pages of a conversation: chunk ids run over pages."""
    pages = read("conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page_number"), "text")
    return chunking.chunk(pages, "fixed_size", {"chunk_size": 20, "overlap": 5})


@query("SELECT conv_id, string_agg(trim(text), E'\\n\\n' ORDER BY turn) AS preview FROM conversations WHERE trim(text) <> '' GROUP BY conv_id HAVING length(string_agg(trim(text), E'\\n\\n' ORDER BY turn)) <= 4000 UNION ALL SELECT conv_id, left(string_agg(trim(text), E'\\n\\n' ORDER BY turn), 4000) || E'\\n\\n...' FROM conversations WHERE trim(text) <> '' GROUP BY conv_id HAVING length(string_agg(trim(text), E'\\n\\n' ORDER BY turn)) > 4000")
def document_preview(read):
    held = read("conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("held"))
    return held.select("conv_id", text.preview(F.transform("held", lambda x: x["text"])).alias("preview"))


# Text


@query("SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS squeezed, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS INTEGER) AS word_count FROM documents")
def squeeze_text(read):
    return read("documents").select("doc_id", text.squeeze(F.col("text")).alias("squeezed"), text.word_count(F.col("text")).cast("int").alias("word_count"))


@query("""
WITH t AS (SELECT p_partkey, '| ' || p_name || '  |' || chr(9) || p_brand || ' |' || chr(10) || '  ' || chr(10) || chr(10) || ' note   of ' || p_type || chr(10) AS t FROM part)
SELECT p_partkey, '| ' || regexp_replace(p_name, '[ \\t]+', ' ', 'g') || ' | ' || p_brand || ' |' || chr(10) || chr(10) || 'note of ' || trim(regexp_replace(p_type, '\\s+', ' ', 'g')) AS cleaned FROM part
""")
def clean_text(read):
    raw = F.concat(F.lit("| "), "p_name", F.lit("  |\t"), "p_brand", F.lit(" |\n  \n\n note   of "), "p_type", F.lit("\n"))
    return read("part").select("p_partkey", text.clean_extracted(raw).alias("cleaned"))


_FILE = "regexp_extract(rtrim(url, '/'), '([^/]*)$', 1)"


@query(f"SELECT page_id, coalesce(nullif(rtrim(trim(regexp_replace({_FILE}, '[<>:\"/\\\\|?*\\x00-\\x1f]', '_', 'g')), '. '), ''), 'upload.bin') AS name FROM pages")
def safe_filename(read):
    return read("pages").select("page_id", text.safe_filename(F.col("url"), "upload.bin").alias("name"))


@query("SELECT doc_id, CASE WHEN n_chars < 1024 THEN n_chars || ' B' WHEN n_chars < 1048576 THEN printf('%.1f KB', floor(n_chars * 10 / 1024.0 + 0.5) / 10) ELSE printf('%.2f MB', floor(n_chars * 100 / 1048576.0 + 0.5) / 100) END AS size FROM documents")
def file_size(read):
    return read("documents").select("doc_id", text.file_size(F.col("n_chars")).alias("size"))


@query("""
WITH d AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'a.PDF' WHEN 1 THEN 'b.docx' WHEN 2 THEN 'c.doc' WHEN 3 THEN 'd' ELSE 'e.txt' END AS name,
  CASE doc_id % 3 WHEN 0 THEN 'Application/PDF; q=1' WHEN 1 THEN NULL ELSE 'text/plain' END AS type FROM documents),
t AS (SELECT doc_id, CASE WHEN name = 'a.PDF' THEN 'pdf' WHEN name = 'b.docx' THEN 'docx' WHEN name = 'c.doc' THEN 'doc' WHEN type LIKE 'Application/PDF%' THEN 'pdf' END AS kind,
  CASE doc_id % 4 WHEN 0 THEN ' Sentence ' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE 'AUTO' END AS asked,
  CASE doc_id % 7 WHEN 0 THEN 'fitz' WHEN 1 THEN 'Text' WHEN 2 THEN '' WHEN 3 THEN 'plain' WHEN 4 THEN 'default' WHEN 5 THEN 'pypdf' ELSE 'other' END AS method FROM d)
SELECT doc_id, kind AS document_type,
  CASE doc_id % 4 WHEN 0 THEN 'sentence' WHEN 3 THEN 'auto' ELSE CASE kind WHEN 'docx' THEN 'sentence' ELSE 'by_page' END END AS strategy,
  CASE doc_id % 7 WHEN 0 THEN 'pymupdf' WHEN 1 THEN CASE WHEN kind = 'pdf' THEN 'pymupdf' ELSE 'text' END WHEN 2 THEN 'auto' WHEN 3 THEN CASE WHEN kind = 'pdf' THEN 'pymupdf' ELSE 'text' END WHEN 4 THEN 'auto' WHEN 5 THEN 'pypdf' ELSE 'other' END AS method,
  kind = 'doc' AS refused FROM t
""")
def resolve_options(read):
    n = F.col("doc_id")
    pick = lambda k, *v: F.get(F.array(*[F.lit(x).cast("string") for x in v]), (n % k).cast("int"))
    rows = read("documents").select(n, options.document_type(pick(5, "a.PDF", "b.docx", "c.doc", "d", "e.txt"), pick(3, "Application/PDF; q=1", None, "text/plain")).alias("kind"), pick(4, " Sentence ", "", None, "AUTO").alias("asked"), pick(7, "fitz", "Text", "", "plain", "default", "pypdf", "other").alias("asked_method"))
    return rows.select("doc_id", F.col("kind").alias("document_type"), options.chunking_strategy(F.col("asked"), F.col("kind")).alias("strategy"), options.loading_method(F.col("asked_method"), F.col("kind")).alias("method"), (F.col("kind") == "doc").alias("refused"))


@query("""
WITH d AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Clean, no-images' WHEN 1 THEN 'LEGACY|clean+clean' WHEN 2 THEN 'text-only/' || lang ELSE '' END AS raw FROM documents)
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'clean,no_images' WHEN 1 THEN 'legacy,clean' WHEN 2 THEN 'text_only,' || lang ELSE '' END AS flags,
  doc_id % 4 IN (0, 1) AS clean, doc_id % 4 NOT IN (1, 2) AS tables, doc_id % 4 NOT IN (0, 2) AS images
FROM d JOIN documents USING (doc_id)
""")
def strategy_flags(read):
    n = F.col("doc_id") % 4
    raw = F.when(n == 0, "Clean, no-images").when(n == 1, "LEGACY|clean+clean").when(n == 2, F.concat(F.lit("text-only/"), "lang")).otherwise("")
    rows = read("documents").select("doc_id", options.flags(raw).alias("f"))
    e = options.flag_effects(F.col("f"))
    return rows.select("doc_id", F.array_join("f", ",").alias("flags"), e["clean"].alias("clean"), e["tables"].alias("tables"), e["images"].alias("images"))


@query("""
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN CAST(100 + doc_id AS INTEGER) ELSE 1200 END AS max_chars, doc_id % 5 = 0 AS given FROM documents
""")
def chunking_options(read):
    n = F.col("doc_id")
    raw = F.when(n % 5 == 0, F.format_string(' {"max_chars": %d}', 100 + n)).when(n % 5 == 1, "[object Object]").when(n % 5 == 2, "[1, 2]").when(n % 5 == 3, "{bad").otherwise(None)
    rows = read("documents").select(n, options.chunking_options(raw).alias("o"))
    return rows.select("doc_id", options.int_option(F.col("o"), "max_chars", 1200).alias("max_chars"), F.col("o").isNotNull().alias("given"))


@query("SELECT min(event_id) AS seq, CAST(user_id AS VARCHAR) AS id, arg_max(event_type, event_id) AS label FROM events GROUP BY user_id")
def merged_options(read):
    return options.merged_options(read("events").select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("id"), F.col("event_type").alias("label")))


# Tables and layout


@query("""
SELECT n_nationkey, '|' || n_name || '|Col2|key|' || chr(10) || '|---|---|---|' || chr(10) || '|' || n_nationkey || '||a b|' || chr(10) || '|x|||' AS markdown, true AS is_table FROM nation
""")
def table_markdown(read):
    cell = lambda *x: F.array(*[F.lit(v).cast("string") if not hasattr(v, "cast") else v for v in x])
    cells = F.array(cell(F.col("n_name"), None, " key "), cell(F.col("n_nationkey").cast("string"), "  ", "a  b"), cell("", " ", None), cell("x"))
    return read("nation").select("n_nationkey", tables.markdown(cells).alias("markdown"), tables.looks_like_table(cells).alias("is_table"))


_BOXES = """
WITH b AS (SELECT user_id AS doc_id, CAST(event_id % 4 AS INTEGER) AS page, event_id AS seq, (event_id * 37 % 50) * 10.0 AS x0, (event_id * 13 % 7) * 40.0 AS y0,
  (event_id * 37 % 50) * 10.0 + 100 AS x1, (event_id * 13 % 7) * 40.0 + 30 AS y1, event_type AS text, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS block_type FROM events),
t AS (SELECT user_id AS doc_id, CAST(event_id % 4 AS INTEGER) AS page, event_id AS table_number, 100.0 AS x0, 60.0 AS y0, 100.0 + event_id % 300 AS x1, 150.0 AS y1, '|' || event_type || '|' AS text FROM events WHERE event_id % 50 = 7),
k AS (SELECT b.* FROM b WHERE block_type = 0 AND NOT EXISTS (SELECT 1 FROM t WHERE t.doc_id = b.doc_id AND t.page = b.page AND (
  ((b.x0 + b.x1) / 2 BETWEEN t.x0 AND t.x1 AND (b.y0 + b.y1) / 2 BETWEEN t.y0 AND t.y1)
  OR (CASE WHEN least(b.x1, t.x1) <= greatest(b.x0, t.x0) OR least(b.y1, t.y1) <= greatest(b.y0, t.y0) THEN 0
      ELSE (least(b.x1, t.x1) - greatest(b.x0, t.x0)) * (least(b.y1, t.y1) - greatest(b.y0, t.y0))
           / least(greatest(1, (b.x1 - b.x0) * (b.y1 - b.y0)), greatest(1, (t.x1 - t.x0) * (t.y1 - t.y0))) END) >= 0.3)))
"""


def _boxes(read) -> tuple[DataFrame, DataFrame]:
    n = F.col("event_id")
    at = [F.col("user_id").alias("doc_id"), (n % 4).cast("int").alias("page")]
    x, y = ((n * 37) % 50 * 10).cast("double"), ((n * 13) % 7 * 40).cast("double")
    blocks = read("events").select(*at, n.alias("seq"), x.alias("x0"), y.alias("y0"), (x + 100).alias("x1"), (y + 30).alias("y1"), F.col("event_type").alias("text"), F.when(n % 3 == 0, 1).otherwise(0).alias("block_type"))
    found = read("events").where("event_id % 50 = 7").select(*at, n.alias("table_number"), F.lit(100.0).alias("x0"), F.lit(60.0).alias("y0"), (100.0 + n % 300).cast("double").alias("x1"), F.lit(150.0).alias("y1"), F.concat(F.lit("|"), "event_type", F.lit("|")).alias("text"))
    return blocks, found


@query(_BOXES + "SELECT doc_id, seq, text FROM k")
def layout_overlap_anti(read):
    blocks, found = _boxes(read)
    return layout.outside_tables(layout.text_blocks(blocks), found).select("doc_id", "seq", "text")


@query(_BOXES + """,
i AS (SELECT doc_id, page, seq, x0, y0 + 5 AS y0, x1, y1, row_number() OVER (PARTITION BY doc_id, page ORDER BY seq) AS n FROM b WHERE block_type = 1),
s AS (SELECT doc_id, page, y0, x0, 0 AS kind, seq, text FROM k UNION ALL SELECT doc_id, page, y0, x0, 1, table_number, text FROM t
  UNION ALL SELECT doc_id, page, y0, x0, 2, n, printf('[Image %d: format=png, size=10x20, bbox=(%.1f,%.1f,%.1f,%.1f)]', n, x0, y0, x1, y1) FROM i)
SELECT doc_id, page, string_agg(text, chr(10) || chr(10) ORDER BY y0, x0, kind, seq) AS text,
  CAST((SELECT count(*) FROM b WHERE b.doc_id = s.doc_id AND b.page = s.page AND block_type = 0) AS INTEGER) AS text_block_count,
  CAST(count(*) FILTER (kind = 1) AS INTEGER) AS table_count, CAST(count(*) FILTER (kind = 2) AS INTEGER) AS image_count,
  CASE WHEN count(*) FILTER (kind = 1) > 0 AND count(*) FILTER (kind = 2) > 0 THEN 'pymupdf_table_image_aware' WHEN count(*) FILTER (kind = 1) > 0 THEN 'pymupdf_table_aware'
       WHEN count(*) FILTER (kind = 2) > 0 THEN 'pymupdf_image_aware' ELSE 'pymupdf_sorted_text' END AS extraction_mode
FROM s GROUP BY doc_id, page
""")
def layout_merge(read):
    blocks, found = _boxes(read)
    images = blocks.where("block_type = 1").select("doc_id", "page", "seq", "x0", (F.col("y0") + 5).alias("y0"), "x1", "y1", F.lit("PNG").alias("ext"), F.lit(10).alias("width"), F.lit(20).alias("height"), F.col("seq").cast("long").alias("size_bytes"))
    return layout.merged(blocks, found, layout.distinct_images(images))


@query("""
WITH b AS (SELECT l_partkey % 50 AS doc_id, CAST(l_suppkey % 3 AS INTEGER) AS page, l_orderkey * 10 + l_linenumber AS seq, CAST(l_quantity AS DOUBLE) AS x0 FROM lineitem),
f AS (SELECT doc_id, page, min(seq) AS seq, x0 FROM b GROUP BY doc_id, page, x0)
SELECT doc_id, page, seq, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY seq) AS INTEGER) AS image_number FROM f
""")
def image_dedupe(read):
    rows = read("lineitem").select((F.col("l_partkey") % 50).alias("doc_id"), (F.col("l_suppkey") % 3).cast("int").alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_quantity").cast("double").alias("x0"))
    rows = rows.select("*", F.lit(0.0).alias("y0"), F.lit(1.04).alias("x1"), F.lit(1.0).alias("y1"), F.lit("png").alias("ext"), F.lit(1).alias("width"), F.lit(1).alias("height"), F.lit(5).alias("size_bytes"))
    return layout.distinct_images(rows).select("doc_id", "page", "seq", "image_number")


# List numbers

_LEVELS = """
WITH p AS (SELECT event_id // 20 AS doc_id, event_id AS para_no, 1 AS num_id, CAST(event_id * 31 % 7 % 3 AS INTEGER) AS ilvl, event_type FROM events),
r AS (SELECT *, CASE ilvl WHEN 0 THEN 0 WHEN 1 THEN count(*) FILTER (ilvl < 1) OVER w ELSE count(*) FILTER (ilvl < 2) OVER w END AS reset FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY para_no)),
v AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, ilvl, reset ORDER BY para_no) AS INTEGER) AS value FROM r)
"""


def _paragraphs(read) -> DataFrame:
    kinds = F.array(F.lit("decimal"), F.lit("lowerLetter"), F.lit("upperRoman"))
    n = F.col("event_id")
    rows = read("events").select(F.floor(n / 20).alias("doc_id"), n.alias("para_no"), F.lit(1).alias("num_id"), (n * 31 % 7 % 3).cast("int").alias("ilvl"), F.lit(1).alias("start"), F.col("event_type").alias("text"))
    return rows.withColumns({"num_fmt": F.get(kinds, "ilvl"), "lvl_text": F.concat(F.lit("%"), (F.col("ilvl") + 1).cast("string"), F.lit(")"))})


@query(_LEVELS + "SELECT doc_id, para_no, ilvl, value FROM v")
def list_counters(read):
    return numbering.values(_paragraphs(read)).select("doc_id", "para_no", "ilvl", "value")


@query(_LEVELS + """SELECT doc_id, para_no, CASE ilvl WHEN 0 THEN CAST(value AS VARCHAR) WHEN 1 THEN chr(96 + value) ELSE ['I','II','III','IV','V','VI','VII','VIII','IX','X','XI','XII','XIII','XIV','XV','XVI','XVII','XVIII','XIX','XX'][value] END || ')' AS prefix,
CASE ilvl WHEN 0 THEN CAST(value AS VARCHAR) WHEN 1 THEN chr(96 + value) ELSE ['I','II','III','IV','V','VI','VII','VIII','IX','X','XI','XII','XIII','XIV','XV','XVI','XVII','XVIII','XIX','XX'][value] END || ') ' || event_type AS text FROM v""")
def docx_number_prefix(read):
    rows = _paragraphs(read)
    levels = rows.sparkSession.createDataFrame([(1, 0, 1, "decimal"), (1, 1, 1, "lowerLetter"), (1, 2, 1, "upperRoman")], "num_id int, ilvl int, start int, num_fmt string")
    return numbering.prefixed(rows, levels)


@query("""
WITH RECURSIVE a AS (SELECT n_nationkey AS id, n_nationkey AS n, '' AS s FROM (SELECT n_nationkey + 1 + n_nationkey * 40 AS n_nationkey FROM nation)
  UNION ALL SELECT id, (n - 1) // 26, chr(CAST(65 + (n - 1) % 26 AS INTEGER)) || s FROM a WHERE n > 0)
SELECT CAST(id AS BIGINT) AS id, s AS letters FROM a WHERE n = 0
""")
def number_letters(read):
    n = F.col("n_nationkey") + 1 + F.col("n_nationkey") * 40
    return read("nation").select(n.cast("long").alias("id"), text.letters(n).alias("letters"))


# Names


def _talks(read) -> DataFrame:
    """Conversations in which parts and regions are called like people."""
    line = F.concat(F.lit("Agent Smith: This is "), F.initcap("p_name"), F.lit("\r\n\n  contact "), F.initcap("p_name"), F.lit(" now\nthanks"))
    return spread(read("part").select("p_partkey", "p_name"), 10_000).select(F.col("p_partkey").alias("conv_id"), line.alias("text"))


@query("""
WITH n AS (SELECT p_partkey, [upper(left(x, 1)) || lower(x[2:]) FOR x IN string_split(p_name, ' ')] AS w FROM part),
m AS (SELECT p_partkey, array_to_string(w[1:3], ' ') AS intro, array_to_string(list_concat(w, ['Now'])[1:3], ' ') AS contact FROM n),
h AS (SELECT p_partkey, 'Agent Smith' AS name, 4 AS s, false AS i FROM m UNION ALL SELECT p_partkey, intro, 5, true FROM m UNION ALL SELECT p_partkey, contact, 3, false FROM m)
SELECT p_partkey AS conv_id, name, CAST(count(*) AS INTEGER) AS count, CAST(sum(s) AS INTEGER) AS score,
  CASE WHEN sum(s) >= 8 OR count(*) >= 3 OR bool_or(i) THEN '高' WHEN sum(s) >= 5 OR count(*) >= 2 THEN '中' ELSE '低' END AS confidence FROM h GROUP BY p_partkey, name
""")
def names_rule_based(read):
    return names.extract(_talks(read)).select("conv_id", "name", "count", "score", "confidence")


@query("SELECT p_partkey AS conv_id, 3 AS total_lines, CAST(length('Agent Smith: This is ') + length(p_name) + 2 + length('  contact ') + length(p_name) + length(' now') + 1 + length('thanks') AS INTEGER) AS total_characters FROM part")
def names_totals(read):
    return names.totals(_talks(read))


# Model answers


@query("SELECT c_custkey AS call_id, 0 AS pos, c_name AS name, CASE c_custkey % 4 WHEN 0 THEN '高' WHEN 1 THEN '中' WHEN 2 THEN '未知' ELSE 'sure' END AS confidence FROM customer WHERE c_custkey % 3 <> 2")
def ai_names_parse(read):
    n = F.col("c_custkey")
    level = F.when(n % 4 == 0, '"HIGH "').when(n % 4 == 1, '"medium"').when(n % 4 == 2, "null").otherwise('"sure"')
    body = F.concat(F.lit('{"names":[{"name":"'), "c_name", F.lit('","confidence":'), level, F.lit("},{\"name\":\"  \"}]}"))
    answer = F.when(n % 3 == 0, body).when(n % 3 == 1, F.concat(F.lit("So:\n```JSON\n"), body, F.lit("\n``` done"))).otherwise('{"names": 3}')
    return assistant.names(read("customer").select(n.alias("call_id"), answer.alias("answer"))).select("call_id", "pos", "name", "confidence")


@query("SELECT user_id AS callId, arg_max(event_type, event_id) AS content FROM events GROUP BY user_id")
def call_store(read):
    return assistant.latest(read("events").select(F.col("user_id").alias("callId"), F.col("event_type").alias("content"), F.col("event_id").alias("at")))


@query("SELECT conv_id, turn, CASE WHEN trim(text) = '' THEN 'content is required' END AS error, CASE WHEN trim(text) = '' THEN 400 ELSE 200 END AS status FROM conversations")
def ai_request_check(read):
    rows = read("conversations").withColumn("error", assistant.request_error(F.lit("c"), F.col("text"), F.lit(True)))
    return rows.select("conv_id", "turn", "error", assistant.status(F.col("error"), F.lit("value")).alias("status"))


# Addresses


@query("""
WITH d AS (SELECT c_custkey AS call_id, c_custkey % 9 + 1 AS b, c_custkey % 4 + 1 AS r FROM customer)
SELECT call_id, CASE WHEN r < 4 THEN 1 ELSE 0 END AS match_count, CASE WHEN r < 4 THEN CAST(r - 1 AS INTEGER) ELSE -1 END AS matched_index FROM d
""")
def address_unique_match(read):
    """Each customer speaks an address with its building in Chinese numerals; three candidates differ in the room."""
    n = F.col("c_custkey")
    digit = lambda x: F.substring(F.lit("零一二三四五六七八九"), x.cast("int") + 1, F.lit(1))
    spoken = F.concat(F.lit("保利香槟"), digit(n % 9 + 1), F.lit("号楼30"), (n % 4 + 1).cast("string"))
    known = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda r: F.concat(F.lit("福建省漳州市云霄县保利香槟"), (n % 9 + 1).cast("string"), F.lit("栋30"), r.cast("string"), F.lit("室")))
    return address.unique_match(read("customer").select(n.alias("call_id"), spoken.alias("spoken"), known.alias("address_list"))).select("call_id", "match_count", "matched_index")


@query("""
WITH t AS (SELECT c_custkey AS call_id, c_custkey % 9 + 1 AS b, c_custkey % 4 AS r, unnest([0, 1, 2, 3]) AS turn FROM customer),
o AS (SELECT *, turn >= 2 AND r < 3 AS found, '我记录的地址信息是：' || CASE turn WHEN 0 THEN '云霄县，请您再说一下具体的小区或村镇名称。' ELSE '云霄县保利香槟，请您再说一下具体的楼栋号、单元号及门牌号。' END AS asked FROM t)
SELECT call_id, CAST(turn AS INTEGER) AS turn, CASE turn WHEN 0 THEN '云霄县' WHEN 1 THEN '保利香槟' WHEN 2 THEN b || '号楼30' || (r + 1) ELSE '是的' END AS user_input,
  CAST(CASE WHEN found THEN r ELSE -1 END AS INTEGER) AS matched_index, CAST(CASE WHEN found THEN 1 ELSE 3 END AS INTEGER) AS match_count,
  found AND turn = 3 AS is_completed, false AS is_extract_failed, CASE WHEN found THEN '' ELSE asked END AS reply,
  CASE WHEN found AND turn = 2 THEN '请问您说的是福建省漳州市云霄县保利香槟' || b || '栋30' || (r + 1) || '室吗？' WHEN found THEN '' ELSE asked END AS ai_context_reply,
  CASE WHEN NOT found THEN 'matching' WHEN turn = 2 THEN 'confirming' ELSE 'completed' END AS state,
  CASE WHEN turn = 0 THEN '云霄县' WHEN NOT found THEN '云霄县保利香槟' WHEN turn = 2 THEN '__NO_MERGE__:云霄县保利香槟' || b || '号楼30' || (r + 1) ELSE '' END AS last_unmatched_address,
  '' AS last_unmatched_fragment, CAST(CASE WHEN turn = 0 THEN 1 WHEN r = 3 AND turn >= 2 THEN turn - 1 ELSE 0 END AS INTEGER) AS similar_no_match_count
FROM o
""")
def address_dialogue(read):
    """Four turns of each customer's call: a county, a place, a building with its room, a yes."""
    n = F.col("c_custkey")
    known = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda r: F.concat(F.lit("福建省漳州市云霄县保利香槟"), (n % 9 + 1).cast("string"), F.lit("栋30"), r.cast("string"), F.lit("室")))
    said = F.array(F.lit("云霄县"), F.lit("保利香槟"), F.concat((n % 9 + 1).cast("string"), F.lit("号楼30"), (n % 4 + 1).cast("string")), F.lit("是的"))
    rows = spread(read("customer").select("c_custkey")).select(n.alias("call_id"), known.alias("address_list"), F.posexplode(said).alias("turn", "user_input"))
    return address.turns(rows)


# Sources


@query("""
SELECT doc_id, string_agg(s, chr(10) || chr(10) ORDER BY i) AS text, CAST(count(*) AS INTEGER) AS paragraph_count FROM (
  SELECT doc_id, trim(regexp_replace(unnest(string_split(text, chr(10))), '\\s+', ' ', 'g')) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
WHERE s <> '' GROUP BY doc_id
""")
def docx_pages(read):
    """Each document as a DOCX file, read back."""

    def build(batches):
        import pyarrow as pa

        for batch in batches:
            made = [docx.build(x.as_py().split("\n")) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["path", "content"])

    made = read("documents").select(F.col("doc_id").cast("string").alias("path"), "text").mapInArrow(build, "path string, content binary")
    return docx.read(made).where("text <> ''").select(F.col("path").cast("long").alias("doc_id"), "text", "paragraph_count")


@query("SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN 'pdf' WHEN 2 THEN 'doc' END AS document_type, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN '' WHEN 3 THEN text END AS text, CASE WHEN doc_id % 4 <> 2 THEN 'text' END AS method, doc_id % 4 = 2 AS refused FROM documents")
def load_files(read):
    """Documents as text files with a broken byte, PDFs without an extractor, and files of a type that is refused."""
    n = F.col("doc_id") % 4
    ext = F.when(n == 1, ".pdf").when(n == 2, ".doc").otherwise(".txt")
    content = F.concat(F.encode("text", "UTF-8"), F.when(n == 3, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit(""))))
    rows = read("documents").select(F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), ext).alias("path"), content.alias("content"))
    out = files.load(rows)
    return out.select(F.regexp_extract("path", r"(\d+)\.", 1).cast("long").alias("doc_id"), "document_type", "text", "method", F.col("error").isNotNull().alias("refused"))


@query("SELECT doc_id, text FROM documents")
def decode_text(read):
    broken = F.concat(F.unhex(F.lit("FF")), F.encode("text", "UTF-8"), F.unhex(F.lit("C3")))
    return read("documents").select("doc_id", files.decoded(F.when(F.col("doc_id") % 2 == 0, broken).otherwise(F.encode("text", "UTF-8"))).alias("text"))


_CATALOG = """
SELECT CASE WHEN doc_id % 3 = 0 THEN 'd' || doc_id % 50 ELSE 'load_' || doc_id % 50 END AS run_id, doc_id, n_chars, source, lang, 'd' || doc_id % 50 || '.json' AS name FROM documents
"""


def _catalog(read) -> DataFrame:
    n = F.col("doc_id")
    name = F.concat(F.lit("d"), (n % 50).cast("string"))
    meta = F.struct(F.col("lang").alias("document_type"), n.alias("total_chunks"), F.lit(1).cast("long").alias("total_pages"), F.lit("text").alias("loading_method"), F.lit(None).cast("string").alias("loading_strategy"), F.lit("by_page").alias("chunking_strategy"), F.col("source").alias("timestamp"))
    return read("documents").select(F.concat(F.lit("/c/"), name, F.lit(".json")).alias("path"), F.timestamp_seconds(n).alias("modified"), F.col("n_chars").alias("size_bytes"), F.when(n % 3 > 0, F.concat(F.lit("load_"), (n % 50).cast("string"))).alias("run_id"), F.when(n % 2 == 0, F.lit("")).otherwise(F.concat(name, F.lit(".txt"))).alias("filename"), meta.alias("metadata"), F.array().cast("array<string>").alias("chunks"))


@query(f"SELECT run_id, source AS created_at, CASE WHEN doc_id % 2 = 0 THEN name ELSE replace(name, '.json', '.txt') END AS filename, CAST(NULL AS VARCHAR) AS content_type, lang AS document_type, '/c/' || name AS json_path, n_chars AS size_bytes, doc_id AS total_chunks, CAST(1 AS BIGINT) AS total_pages, 'text' AS loading_method, CAST(NULL AS VARCHAR) AS loading_strategy, 'by_page' AS chunking_strategy FROM ({_CATALOG})")
def catalog_list(read):
    return catalog.listed(_catalog(read))


@query(f"SELECT run_id, '/c/' || name AS path, n_chars AS size_bytes FROM ({_CATALOG}) WHERE run_id = 'load_7' ORDER BY doc_id DESC LIMIT 1")
def catalog_get(read):
    return catalog.get(_catalog(read), "load_7").select("run_id", F.col("files")[0]["path"].alias("path"), F.col("files")[0]["size_bytes"].alias("size_bytes"))


@query("SELECT r_regionkey, r_name FROM region")
def rsa_recover(read):
    """Region names in two blocks under a key, recovered with its counterpart."""
    p, q = 2**521 - 1, 2**607 - 1
    n, e = p * q, 65537
    d, size = pow(e, -1, (p - 1) * (q - 1)), (n.bit_length() + 7) // 8

    @F.pandas_udf("string")
    def seal(names: pd.Series) -> pd.Series:
        import base64

        return names.map(lambda x: base64.b64encode(rsa.encrypt_bytes(x.encode(), n, d, lambda k: b"\1" * k, 4)).decode())

    sealed = read("region").select("r_regionkey", seal("r_name").alias("cipher"))
    return sealed.select("r_regionkey", rsa.recovered(F.col("cipher"), n, e, size).alias("r_name"))


@query("""
WITH RECURSIVE s AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey > 0 THEN n_nationkey // 2 END AS p, CASE WHEN n_nationkey % 5 = 0 THEN n_regionkey END AS v FROM nation),
r AS (SELECT id, p, v FROM s UNION ALL SELECT r.id, s.p, s.v FROM r JOIN s ON s.id = r.p WHERE r.v IS NULL)
SELECT CAST(id AS VARCHAR) AS style_id, CAST(max(v) AS INTEGER) AS num_id FROM r GROUP BY id
""")
def style_inheritance(read):
    n = F.col("n_nationkey")
    styles = read("nation").select(n.cast("string").alias("style_id"), F.when(n > 0, F.floor(n / 2).cast("string")).alias("based_on"), F.when(n % 5 == 0, F.col("n_regionkey")).cast("int").alias("num_id"), F.lit(None).cast("int").alias("ilvl"))
    return numbering.resolved_styles(styles).select("style_id", "num_id")


@query("SELECT conv_id, turn, CAST(length(text) + 14 AS BIGINT) AS added FROM conversations")
def ai_prompt(read):
    text_ = assistant.prompt(F.col("text"))
    fixed = len(assistant.PROMPT) + len("\n\n对话文本：\n") + len("\n\n请只返回 JSON。")
    return read("conversations").select("conv_id", "turn", (F.length(text_) - fixed + 14).cast("long").alias("added"))


@query("SELECT p_partkey AS conv_id, 'speaker' AS first_source, 'Agent Smith: This is ' || array_to_string([upper(left(x, 1)) || lower(x[2:]) FOR x IN string_split(p_name, ' ')], ' ') AS excerpt FROM part")
def names_evidence(read):
    found = names.extract(_talks(read)).where("name = 'Agent Smith'")
    top = names.top_evidence(F.col("matches"))
    return found.select("conv_id", F.col("sources")[0].alias("first_source"), top[0]["excerpt"].alias("excerpt"))


@query("SELECT strategy AS id, CAST(n AS INTEGER) AS fields FROM (VALUES ('auto', 0), ('by_page', 0), ('sentence', 1), ('fixed_size', 2)) t(strategy, n)")
def chunking_config(read):
    return options.config(read("region").sparkSession).select("id", F.size("fields").alias("fields"))


from . import details, speech  # noqa: E402,F401  register further queries
