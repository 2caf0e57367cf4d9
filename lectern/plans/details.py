"""Further queries over the supplied tables: files and the catalog on disk, forms, identifiers, list formats, model calls."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import options, table_functions, tables, text
from ..operators import assistant, chunking, layout, names, rsa, table_finder
from ..sources import asset_source, catalog, docx, files
from ..streaming import arrivals, dialogue
from .registry import _SQL, _WINDOWS, _boxes, query, spread


def _folder(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir that goes with the session; a local one only for a local master."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: written files need a folder that all executors share")
    folder = f"{(base or 'file://' + tempfile.mkdtemp(prefix='lectern-files-')).rstrip('/')}/lectern-{uuid.uuid4().hex}"
    place = context._jvm.org.apache.hadoop.fs.Path(folder)
    system = place.getFileSystem(context._jsc.hadoopConfiguration())
    system.mkdirs(place)
    system.deleteOnExit(place)
    return folder


def _kind(key: str, *values):
    """The value of ``values`` whose place is the row's ``key`` modulo their number."""
    return F.get(F.array(*[F.lit(v).cast("string") if not hasattr(v, "cast") else v for v in values]), (F.col(key) % len(values)).cast("int"))


# Files and the catalog


@query("SELECT n_nationkey, n_name || chr(10) AS text, 'text' AS method, CAST(1 AS INTEGER) AS page, true AS is_text FROM nation")
def upload_files(read):
    """Each nation as a text file on disk, loaded from there."""
    rows = read("nation")
    folder = _folder(rows.sparkSession)
    rows.select("n_name", "n_nationkey").write.partitionBy("n_nationkey").mode("overwrite").text(folder + "/in")
    found = files.load(files.uploads(rows.sparkSession, folder + "/in", "*.txt").select("path", "content"))
    return found.select(F.regexp_extract("path", r"n_nationkey=(\d+)/", 1).cast("int").alias("n_nationkey"), "text", "method", "page", (F.col("document_type").isNull() & F.col("error").isNull()).alias("is_text"))


def _saved(read) -> tuple[SparkSession, str]:
    """A catalog of one document a nation, its name and region as chunks of one word."""
    pages = read("nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), F.lit(1).alias("page_number"), F.concat("n_name", F.lit(" of "), F.col("n_regionkey").cast("string")).alias("text"))
    chunks = chunking.chunk(pages, "fixed_size", {"chunk_size": 1, "overlap": 0}, single_page=True)
    n = F.col("n_nationkey").cast("string")
    settings = read("nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), F.concat(F.lit("load_"), n).alias("run_id"), F.concat(F.lit("n"), n, F.lit(".txt")).alias("filename"), F.lit("fixed_size").alias("chunking_strategy"))
    folder = _folder(pages.sparkSession) + "/catalog"
    catalog.save(catalog.documents(chunks, chunking.totals(pages, chunks), settings), folder)
    return pages.sparkSession, folder


_WORDS = "CAST(len(list_filter(regexp_split_to_array(n_name, '\\s+'), lambda x: x <> '')) + 2 AS BIGINT)"


@query(f"SELECT 'load_' || n_nationkey AS run_id, 'n' || n_nationkey || '.txt' AS filename, {_WORDS} AS total_chunks, CAST(1 AS BIGINT) AS total_pages, 'fixed_size' AS chunking_strategy, CAST(n_regionkey AS VARCHAR) AS last_chunk FROM nation")
def catalog_saved(read):
    """Documents written as files of a catalog, and what a scan of its folder finds."""
    found = catalog.scan(*_saved(read))
    last = found.select("run_id", F.element_at("chunks", -1)["content"].alias("last_chunk"))
    return catalog.listed(found).select("run_id", "filename", "total_chunks", "total_pages", "chunking_strategy").join(last, "run_id")


@query("SELECT 'load_' || n_nationkey AS run_id, 'n' || n_nationkey || '.json' AS name FROM nation WHERE n_nationkey <> 3")
def catalog_deleted(read):
    """A catalog after one document is deleted, and one that it does not have."""
    spark, folder = _saved(read)
    assert catalog.delete(spark, folder, "load_3") and not catalog.delete(spark, folder, "load_none")
    return catalog.scan(spark, folder).select("run_id", catalog.file_name(F.col("path")).alias("name"))


@query("SELECT 'assets/r' || s_suppkey % 7 || '/n' || s_suppkey || '_p1_img1.jpg' AS path, strlen(s_name || '/' || s_suppkey)::BIGINT AS size_bytes, sha256(s_name || '/' || s_suppkey) AS digest FROM supplier WHERE s_suppkey % 5 <> 0")
def assets_written(read):
    """Images of suppliers, four of five with bytes, written as files and read back by the data source."""
    rows, n = read("supplier"), F.col("s_suppkey").cast("string")
    data = F.concat("s_name", F.lit("/"), n).cast("binary")
    images = rows.select(F.concat(F.lit("r"), (F.col("s_suppkey") % 7).cast("string")).alias("run_id"), F.concat(F.lit("n"), n, F.lit(".pdf")).alias("filename"), F.lit(1).alias("page"), F.lit(1).alias("image_number"), F.lit("JPG").alias("ext"), F.when(F.col("s_suppkey") % 5 != 0, data).alias("bytes"))
    root = _folder(rows.sparkSession)
    catalog.save_assets(images, root)
    asset_source.register(rows.sparkSession)
    return rows.sparkSession.read.format("lectern_assets").load(root).select("path", "size_bytes", F.sha2("bytes", 256).alias("digest"))


@query("SELECT 's_suppkey=' || s_suppkey AS part, CAST(1 AS BIGINT) AS total_pages, CAST(len(list_filter(regexp_split_to_array(s_name || ' is  one of ' || s_suppkey, '\\s+'), lambda x: x <> '')) AS BIGINT) AS words FROM supplier")
def files_arriving(read):
    """Each supplier's text as a file that a stream takes into a catalog; what the catalog then has."""
    rows = read("supplier")
    spark, folder = rows.sparkSession, _folder(rows.sparkSession)
    texts = rows.select(F.concat("s_name", F.lit(" is  one of "), F.col("s_suppkey").cast("string")).alias("value"), "s_suppkey")
    files.write_folders(spread(texts, 200), folder + "/in", "s_suppkey")
    name = F.concat(F.regexp_extract("path", r"(s_suppkey=\d+)/", 1), F.lit(".txt"))
    with files.few_listing_tasks(spark):
        stream = dialogue.arriving_files(spark, folder + "/in/*", "*.txt")
        arrivals.to_catalog(stream, folder + "/catalog", folder + "/check", chunking_strategy="fixed_size", options={"chunk_size": 3, "overlap": 0}, name=name).awaitTermination()
    words = F.aggregate("chunks", F.lit(0).cast("long"), lambda a, c: a + c["metadata"]["word_count"])
    return catalog.scan(spark, folder + "/catalog").select(F.regexp_replace("filename", r"\.txt$", "").alias("part"), F.col("metadata.total_pages").alias("total_pages"), words.alias("words"))


# A list whose first level counts in decimals and whose second in letters behind them.
_LIST = (
    '<w:abstractNum w:abstractNumId="1"><w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="decimal"/><w:lvlText w:val="%1."/></w:lvl>'
    '<w:lvl w:ilvl="1"><w:start w:val="1"/><w:numFmt w:val="lowerLetter"/><w:lvlText w:val="%1.%2)"/></w:lvl></w:abstractNum>'
    '<w:num w:numId="3"><w:abstractNumId w:val="1"/></w:num>'
)


@query("SELECT p_partkey, '1. ' || p_name || chr(10) || chr(10) || '1.a) ' || p_type || chr(10) || chr(10) || '2. ' || p_brand || chr(10) || chr(10) || '|Name|Col2|' || chr(10) || '|---|---|' || chr(10) || '|' || p_type || '|' || p_size || '|' AS text, CAST(3 AS INTEGER) AS paragraph_count, CAST(1 AS INTEGER) AS table_count FROM part")
def docx_lists_and_tables(read):
    """Each part as a DOCX file with a list of two levels and a table, read back."""

    def build(batches):
        import pyarrow as pa

        for batch in batches:
            made = [docx.build([r["p_name"], r["p_type"], r["p_brand"]], [[["Name", ""], [r["p_type"], str(r["p_size"])]]], {0: (3, 0), 1: (3, 1), 2: (3, 0)}, _LIST) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["path", "content"])

    made = spread(read("part").select(F.col("p_partkey").cast("string").alias("path"), "p_name", "p_type", "p_brand", "p_size")).mapInArrow(build, "path string, content binary")
    return docx.read(made).select(F.col("path").cast("long").alias("p_partkey"), "text", "paragraph_count", "table_count")


# A list whose first level begins at five and whose second is replaced by Roman numerals from two on; every paragraph is in it by
# the style that its default style is based on.
_OVERRIDES = _LIST + (
    '<w:num w:numId="4"><w:abstractNumId w:val="1"/><w:lvlOverride w:ilvl="0"><w:startOverride w:val="5"/></w:lvlOverride>'
    '<w:lvlOverride w:ilvl="1"><w:lvl w:ilvl="1"><w:start w:val="2"/><w:numFmt w:val="upperRoman"/><w:lvlText w:val="(%2)"/></w:lvl></w:lvlOverride></w:num>'
)
_STYLES = (
    '<w:style w:type="paragraph" w:styleId="Base"><w:pPr><w:numPr><w:numId w:val="4"/></w:numPr></w:pPr></w:style>'
    '<w:style w:type="paragraph" w:default="1" w:styleId="Own"><w:basedOn w:val="Base"/></w:style>'
)


@query("SELECT p_partkey, '5. ' || p_name || chr(10) || chr(10) || '(II) ' || p_type || chr(10) || chr(10) || '(III) ' || p_brand || chr(10) || chr(10) || '6. ' || p_name || chr(10) || chr(10) || '1. ' || p_type AS text, CAST(5 AS INTEGER) AS paragraph_count FROM part")
def docx_overrides(read):
    """Each part as a DOCX file whose list overrides a start and a level, is inherited by style, and stands beside another list of the same definition."""

    def build(batches):
        import pyarrow as pa

        for batch in batches:
            made = [docx.build([r["p_name"], r["p_type"], r["p_brand"], r["p_name"], r["p_type"]], None, {1: (4, 1), 2: (4, 1), 4: (3, 0)}, _OVERRIDES, _STYLES) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["path", "content"])

    made = spread(read("part").select(F.col("p_partkey").cast("string").alias("path"), "p_name", "p_type", "p_brand")).mapInArrow(build, "path string, content binary")
    return docx.read(made).select(F.col("path").cast("long").alias("p_partkey"), "text", "paragraph_count")


# Tables and pages


def _cells():
    row = lambda *x: F.array(*[F.lit(v).cast("string") if not hasattr(v, "cast") else v for v in x])
    name, brand, kind = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    shapes = F.array(F.array(row(name, brand), row(kind, "x")), F.array(row(name), row(brand)), F.array(row(name, brand)), F.array(row(name, ""), row(brand, kind), row(None, None)))
    return F.get(shapes, (F.col("p_partkey") % 4).cast("int"))


@query("SELECT p_partkey, p_partkey % 4 = 0 AS is_table, p_partkey % 4 = 0 AS is_admitted FROM part")
def table_admission(read):
    """Tables, a column, a row, and rows with too few filled cells."""
    rows = read("part").select("p_partkey", _cells().alias("cells"))
    return rows.select("p_partkey", tables.looks_like_table(F.col("cells")).alias("is_table"), tables.admitted(F.col("cells")).alias("is_admitted"))


@query("SELECT p_partkey, '|' || p_name || '|' || p_brand || '|' || chr(10) || '|---|---|' || chr(10) || '|' || p_type || '|x|' AS text, CAST(2 AS INTEGER) AS row_count, CAST(2 AS INTEGER) AS col_count FROM part WHERE p_partkey % 4 = 0")
def table_segments(read):
    return layout.table_segments(read("part").select("p_partkey", _cells().alias("cells"))).select("p_partkey", "text", "row_count", "col_count")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_brand END AS cell FROM part")
def table_two_passes(read):
    """The second finder's tables, where the first has found none or has not run."""
    none = F.array().cast("array<string>")
    first = F.when(F.col("p_partkey") % 3 == 0, F.array("p_name")).when(F.col("p_partkey") % 3 == 1, none)
    return read("part").select("p_partkey", tables.coalesced(first, F.array("p_brand"))[0].alias("cell"))


@query("""
SELECT l_orderkey, l_linenumber, l_orderkey AS doc_id, CAST(1 AS INTEGER) AS page, CAST(l_linenumber AS INTEGER) AS image_number, CASE WHEN l_returnflag = 'A' THEN 'png' ELSE 'jpg' END AS ext, CAST(NULL AS INTEGER) AS xres,
  l_quantity AS left_edge, l_quantity + 10 AS right_edge FROM lineitem
""")
def image_metadata(read):
    rows = read("lineitem").select("l_orderkey", "l_linenumber", F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.col("l_linenumber").cast("int").alias("image_number"), F.when(F.col("l_returnflag") == "A", "png").otherwise("jpg").alias("ext"), F.col("l_quantity").alias("x0"), F.lit(0.0).alias("y0"), (F.col("l_quantity") + 10).alias("x1"), F.lit(5.0).alias("y1"), F.lit(b"raw").alias("bytes"))
    shown = layout.public_metadata(rows)
    return shown.select(F.col("doc_id").alias("l_orderkey"), F.col("image_number").alias("l_linenumber"), "doc_id", "page", "image_number", "ext", "xres", F.col("bbox")[0].alias("left_edge"), F.col("bbox")[2].alias("right_edge"))


@query(f"""
SELECT p.doc_id, CAST(p.page AS INTEGER) AS page, coalesce(nullif(m.text, ''), 'plain ' || p.page) AS text, m.text_block_count, coalesce(m.table_count, 0) AS table_count, CAST(0 AS INTEGER) AS image_count,
  CASE WHEN m.table_count > 0 THEN 'pymupdf_table_aware' ELSE 'pymupdf_sorted_text' END AS extraction_mode
FROM (SELECT DISTINCT user_id AS doc_id, event_id % 4 AS page FROM events) p
LEFT JOIN (SELECT doc_id, page, regexp_replace(text, '\\n*\\[Image [^\\]]*\\]', '', 'g').trim(chr(10)) AS text, text_block_count, table_count FROM ({_SQL["layout_merge"]}) WHERE table_count > 0) m ON m.doc_id = p.doc_id AND m.page = p.page
""")
def page_assembly(read):
    """Pages with tables are merged, others keep their plain text; images are left out by the strategy."""
    blocks, found = _boxes(read)
    pages = blocks.select("doc_id", "page").distinct().withColumn("plain_text", F.concat(F.lit("plain "), F.col("page").cast("string")))
    images = layout.distinct_images(blocks.where("block_type = 1").select("doc_id", "page", "seq", "x0", "y0", "x1", "y1", F.lit("png").alias("ext"), F.lit(10).alias("width"), F.lit(20).alias("height"), F.col("seq").alias("size_bytes")))
    return layout.assembled(pages, blocks, found, images, with_images=False)


# Forms and identifiers


@query("""
SELECT doc_id, CASE WHEN doc_id % 5 = 0 OR doc_id % 3 = 0 THEN 'pdf' WHEN doc_id % 5 = 1 THEN 'docx' ELSE 'other' END AS kind FROM documents
""")
def client_type(read):
    """A doc is no type of the upload form; the content type is asked with the extension."""
    return read("documents").select("doc_id", options.client_type(_kind("doc_id", "a.PDF", "b.docx", "c.doc", "d", None), _kind("doc_id", "application/pdf", None, "text/plain")).alias("kind"))


@query("""
SELECT o_orderkey, 'load_' || strftime(o_orderdate, '%Y%m%dT%H%M%SZ') || '_' || printf('%08x', o_orderkey) AS run_id, 'name_' || (o_orderkey * 1000) || '_' || lower(o_orderstatus) AS call_id FROM orders
""")
def identifiers(read):
    n = F.col("o_orderkey")
    token = F.lpad(F.lower(F.hex(n)), 8, "0")
    return read("orders").select("o_orderkey", options.run_id(F.col("o_orderdate"), token).alias("run_id"), assistant.call_id(n * 1000, F.lower("o_orderstatus")).alias("call_id"))


@query("SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN '2024/3/' || (s_suppkey % 28 + 1) || ' 06:07:08' WHEN 1 THEN s_name END AS shown, CAST(CASE s_suppkey % 4 WHEN 0 THEN s_nationkey WHEN 3 THEN -5 ELSE 7 END AS INTEGER) AS parsed FROM supplier")
def values_or_defaults(read):
    """Times as shown, other text echoed; integers, or a default."""
    n = F.col("s_suppkey")
    time = F.format_string("2024-03-%02d 06:07:08", n % 28 + 1)
    return read("supplier").select("s_suppkey", text.shown_time(_kind("s_suppkey", time, F.col("s_name"), None)).alias("shown"), text.int_or(_kind("s_suppkey", F.col("s_nationkey").cast("string"), "x", None, "-5"), 7).alias("parsed"))


@query("""
WITH r AS (SELECT s_suppkey, CAST(s_suppkey % 20 + 1 AS INTEGER) AS n FROM supplier)
SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN ['i','ii','iii','iv','v','vi','vii','viii','ix','x','xi','xii','xiii','xiv','xv','xvi','xvii','xviii','xix','xx'][n] WHEN 3 THEN chr(64 + n) ELSE CAST(n AS VARCHAR) END AS number FROM r
""")
def list_formats(read):
    """Roman numerals, letters, and formats that are shown as decimals."""
    return read("supplier").select("s_suppkey", text.list_number((F.col("s_suppkey") % 20 + 1).cast("int"), _kind("s_suppkey", " lowerRoman", "none", "unheard", "UPPERLETTER")).alias("number"))


# Names, model calls and encryption


@query("""
WITH t AS (SELECT n_nationkey AS conv_id, substr('张王李赵陈', CAST(n_nationkey % 5 AS INTEGER) + 1, 1) || '小明' AS a FROM nation)
SELECT conv_id, a AS name, CAST(2 AS INTEGER) AS count, '高' AS confidence, 'speaker,self_intro' AS sources FROM t UNION ALL SELECT conv_id, '周大为', 1, '低', 'contact' FROM t
""")
def names_chinese(read):
    """A speaker who says their name, and a person to be called."""
    who = F.concat(F.substring(F.lit("张王李赵陈"), (F.col("n_nationkey") % 5).cast("int") + 1, F.lit(1)), F.lit("小明"))
    talk = F.concat(who, F.lit("：你好，我是"), who, F.lit("。\n请联系周大为。"))
    found = names.extract(read("nation").select(F.col("n_nationkey").alias("conv_id"), talk.alias("text")))
    return found.select("conv_id", "name", "count", "confidence", F.array_join("sources", ",").alias("sources"))


def _answer(content: str):
    """Stands for a model: it fails, has nothing to say, or repeats the content in two parts."""
    if content == "fail":
        raise RuntimeError("no model")
    return "" if content == "nothing" else [content[:4] + " ", {"text": content[4:]}, None]


@query("""
SELECT c_name AS "callId", CASE WHEN c_custkey % 4 = 0 THEN left(c_mktsegment, 4) || chr(10) || substr(c_mktsegment, 5) END AS answer,
  CASE c_custkey % 4 WHEN 1 THEN 'content is required' WHEN 2 THEN 'no model' WHEN 3 THEN 'AI returned an empty answer' END AS error,
  CAST(CASE c_custkey % 4 WHEN 0 THEN 200 WHEN 1 THEN 400 WHEN 2 THEN 502 ELSE 500 END AS INTEGER) AS status FROM customer
""")
def ai_ask(read):
    rows = read("customer").select(F.col("c_name").alias("callId"), _kind("c_custkey", F.col("c_mktsegment"), "  ", " fail ", "nothing").alias("content"))
    return assistant.ask(rows, _answer)


@query("SELECT c_custkey, CASE c_custkey % 2 WHEN 0 THEN c_name ELSE c_mktsegment || chr(10) || 'end' END AS answer FROM customer")
def ai_answer_text(read):
    parts = F.array(F.lit("  "), F.concat(F.lit(" "), "c_mktsegment"), F.lit(None).cast("string"), F.lit("end\n"))
    return read("customer").select("c_custkey", assistant.answer_text(F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" "), "c_name", F.lit("\n"))), parts).alias("answer"))


@query("SELECT s_suppkey, repeat(s_name || ' é ', 10) AS text FROM supplier")
def rsa_round_trip(read) -> DataFrame:
    """Texts of several segments encrypted with a public key and recovered with its counterpart."""
    p, q = 2**521 - 1, 2**607 - 1
    n, e = p * q, 65537
    sealed = rsa.encrypted(F.repeat(F.concat("s_name", F.lit(" é ")), F.lit(10)), n, e)
    return spread(read("supplier").select("s_suppkey", "s_name"), 500).select("s_suppkey", sealed.alias("sealed")).select("s_suppkey", rsa.recovered(F.col("sealed"), n, pow(e, -1, (p - 1) * (q - 1)), (n.bit_length() + 7) // 8, (p, q)).alias("text"))


# Table functions


@query(_WINDOWS.format(size=90, step=60))
def udtf_fixed_size(read):
    """The chunker as a table function of SQL."""
    docs = read("documents")
    table_functions.register(docs.sparkSession)
    return docs.sparkSession.sql("SELECT * FROM chunk_fixed_size(TABLE(SELECT doc_id, 1 AS page_number, text FROM {docs}), chunk_size => 90, overlap => 30)", docs=docs)


@query(_SQL["chunk_sentence"])
def udtf_sentence(read):
    docs = read("documents")
    table_functions.register(docs.sparkSession)
    return docs.sparkSession.sql("SELECT * FROM chunk_sentence(TABLE(SELECT doc_id, 1 AS page_number, text FROM {docs}))", docs=docs)


# Tables by the places of words


@query("""
SELECT p_partkey, CAST(1 AS INTEGER) AS table_number, CASE WHEN p_partkey % 4 = 0 THEN '|ruled|x|' || chr(10) || '|---|---|' || chr(10) || '|' || p_brand || '|y|'
  ELSE '|Part name|Kind|Size|' || chr(10) || '|---|---|---|' || chr(10) || '|' || p_name || '|' || p_type || '|' || p_size || '|' || chr(10) || '|' || p_brand || '||x|' END AS markdown,
  CASE WHEN p_partkey % 4 = 0 THEN 0.0::DOUBLE ELSE 10.0::DOUBLE END AS x0 FROM part
""")
def tables_by_words(read):
    """Each part as a page of words: a sentence and a table without rules; a fourth of the pages has a ruled table, which goes before."""
    rows = spread(read("part").select(F.col("p_partkey").alias("doc_id"), F.lit(1).alias("page"), "p_name", "p_type", "p_brand", F.col("p_size").cast("string").alias("size")), 10_000)
    lines = [((10, 10), F.lit("A sentence of some words")), ((10, 40), F.lit("Part name")), ((300, 41), F.lit("Kind")), ((600, 39), F.lit("Size")), ((10, 60), F.col("p_name")), ((300, 60), F.col("p_type")), ((600, 60), F.col("size")), ((10, 80), F.col("p_brand")), ((600, 81), F.lit("x"))]
    held = rows.select("doc_id", "page", F.explode(F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"), F.split(t, " ").alias("words")) for (x, y), t in lines])).alias("at"))
    held = held.select("doc_id", "page", "at.x", "at.y", "at.words", F.posexplode("at.words").alias("k", "text"))
    left = F.col("x") + 5 * F.aggregate(F.slice("words", F.lit(1), F.col("k")), F.lit(0), lambda n, w: n + F.length(w) + 1)
    words = held.select("doc_id", "page", left.alias("x0"), F.col("y").alias("y0"), (left + 5 * F.length("text")).alias("x1"), (F.col("y") + 10).alias("y1"), "text")
    row = lambda *x: F.array(*x)
    ruled = rows.where("doc_id % 4 = 0").select("doc_id", "page", F.lit(1).alias("table_number"), *[F.lit(0.0).alias(c) for c in ("x0", "y0", "x1", "y1")], F.array(row(F.lit("ruled"), F.lit("x")), row(F.col("p_brand"), F.lit("y"))).alias("cells"))
    return table_finder.detected(ruled, words).select(F.col("doc_id").alias("p_partkey"), "table_number", tables.markdown(F.col("cells")).alias("markdown"), "x0")


# Forms, ranks, configuration, fallbacks


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 4 = 3 THEN ['max_chars must be an integer'] ELSE list_filter([
  CASE WHEN l_linenumber % 2 = 0 AND l_partkey % 200 < 100 THEN 'max_chars must be at least 100' END, CASE WHEN l_linenumber % 2 = 1 AND l_orderkey % 5 < 1 THEN 'chunk_size must be positive' END,
  CASE WHEN l_linenumber % 2 = 1 AND (l_suppkey % 7 - 1 < 0 OR l_suppkey % 7 - 1 >= l_orderkey % 5) THEN 'overlap must be from 0 to chunk_size - 1' END], lambda x: x IS NOT NULL) END AS errors FROM lineitem
""")
def chunking_forms(read):
    """Each line item as an upload form with the numbers of its row."""
    line = F.col("l_linenumber")
    strategy = F.when(line % 2 == 0, "sentence").otherwise("fixed_size")
    most = F.when(line % 4 == 3, "1.5").otherwise((F.col("l_partkey") % 200).cast("string"))
    errors = options.chunking_errors(strategy, most, F.concat(F.lit(" "), (F.col("l_orderkey") % 5).cast("string")), (F.col("l_suppkey") % 7 - 1).cast("string"))
    return read("lineitem").select("l_orderkey", "l_linenumber", errors.alias("errors"))


@query("""
WITH d AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'by_page' WHEN 1 THEN 'sentence' ELSE 'fixed_size' END AS id FROM documents)
SELECT id, CAST(count(*) AS BIGINT) AS documents, CAST(CASE id WHEN 'by_page' THEN 0 WHEN 'sentence' THEN 1 ELSE 2 END AS INTEGER) AS fields, CASE id WHEN 'sentence' THEN 1200 WHEN 'fixed_size' THEN 400 END AS first_default FROM d GROUP BY id
""")
def configured_documents(read):
    """The chunking configuration of the documents' strategies: a PDF's and a DOCX file's defaults, and one that was asked for."""
    docs = read("documents")
    kind = F.when(F.col("doc_id") % 3 == 0, "pdf").when(F.col("doc_id") % 3 == 1, "docx")
    asked = F.when(F.col("doc_id") % 3 == 2, " Fixed_Size ").otherwise("")
    used = docs.select(options.chunking_strategy(asked, kind).alias("id")).groupBy("id").agg(F.count("*").alias("documents"))
    return used.join(options.config(docs.sparkSession), "id").select("id", "documents", F.size("fields").alias("fields"), F.get("fields", F.lit(0))["default"].alias("first_default"))


@query("""
WITH t AS (SELECT p_partkey AS conv_id, array_to_string([upper(left(x, 1)) || lower(x[2:]) FOR x IN string_split(p_name, ' ')], ' ') AS name FROM part),
n AS (SELECT conv_id, 'Zoe Adams' AS name, 9 AS score, 2 AS count, '英文自述' AS label FROM t UNION ALL SELECT conv_id, 'Abe Stone', 4, 1, '说话人' FROM t UNION ALL SELECT conv_id, name, 4, 1, '说话人' FROM t WHERE name <> 'Abe Stone')
SELECT conv_id, name, score, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, count DESC, name) AS INTEGER) AS place FROM n
""")
def names_ranked(read):
    """Names of each part's conversation by score, and names of one score in their collation's order."""
    line = F.concat(F.lit("Zoe Adams: This is Zoe Adams\nAbe Stone: yes\n"), F.initcap("p_name"), F.lit(": no"))
    found = names.places(names.extract(spread(read("part").select("p_partkey", "p_name"), 10_000).select(F.col("p_partkey").alias("conv_id"), line.alias("text"))))
    return found.select("conv_id", "name", "score", "place")


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 2 THEN '' ELSE 'page of ' || n_name END AS text, CASE n_nationkey % 3 WHEN 0 THEN 'pymupdf' WHEN 1 THEN 'pypdf' ELSE 'text' END AS method FROM nation")
def pdf_fallbacks(read):
    """Each nation as a PDF file that the first extractor reads, one that only the second does, and one that none does."""

    def first(content: bytes) -> list[str]:
        if content[:1] != b"0":
            raise ValueError("not mine")
        return ["page of " + content[1:].decode()]

    def second(content: bytes) -> list[str]:
        return ["page of " + content[1:].decode()] if content[:1] == b"1" else 1 / 0

    rows = read("nation").select(F.concat(F.lit("/in/n"), F.col("n_nationkey").cast("string"), F.lit(".pdf")).alias("path"), F.concat((F.col("n_nationkey") % 3).cast("string"), F.col("n_name")).cast("binary").alias("content"))
    found = files.load(rows, extractors={"pymupdf": first, "pypdf": second})
    return found.select(F.regexp_extract("path", r"n(\d+)\.pdf", 1).cast("int").alias("n_nationkey"), "text", "method")
