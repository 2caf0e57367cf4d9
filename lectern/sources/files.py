"""Files as rows, and their pages: format dispatch, text decoding, PDF extractors with fallbacks.

PDF libraries are not part of the engine. An extractor is a function from bytes to a list of page texts, given by
the caller; where none is given or all fail, a PDF is one page with empty text, and the method says "text".
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.options import accepted, document_type, flag_effects, flags, loading_method
from ..functions.text import clean_extracted, safe_filename
from . import docx

PAGE = "path string, page int, text string, method string"

#: What Spark escapes in the names of partitions.
ESCAPED = str.maketrans({c: f"%{ord(c):02X}" for c in [*map(chr, range(1, 32)), *"\"#%'*/:=?\\\x7f{[]^"]})


#: How many tasks list folders at most; Spark's default is one a folder, up to 10,000.
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextmanager
def few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """Meanwhile many folders of a file each are listed by four tasks a core, not one a folder; streams that start in it keep that."""
    before = spark.conf.get(LISTING, None)
    spark.conf.set(LISTING, 4 * spark.sparkContext.defaultParallelism)
    try:
        yield
    finally:
        spark.conf.set(LISTING, before) if before else spark.conf.unset(LISTING)


def write_folders(rows: DataFrame, path: str, name: str) -> None:
    """Write ``rows`` (value string, and ``name``) as text, one folder a name, as Spark's writer does with dynamic overwriting: of a name that comes its folder is replaced, others are left.

    On local and shared folders (file:) Hadoop starts two processes a file to set its permissions and those of its checksums, and moves every folder on
    the driver. There the tasks write the files themselves, first beside the folders and then, when all are written, in their place. Other file systems, and
    names beyond ASCII, which a JVM may spell in its own way, are left to Spark's writer.
    """
    spark = rows.sparkSession
    rows = rows.select("value", F.nullif(F.col(name).cast("string"), F.lit("")).alias(name))
    with_spark = lambda some: some.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(name).text(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    uri = system.makeQualified(place).toUri()
    if uri.getScheme() != "file":
        return with_spark(rows)
    root, job = uri.getPath(), uuid.uuid4().hex
    staging = f"{root}/.lectern-{job}"

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task, number = uuid.uuid4().hex, TaskContext.get().partitionId()
        os.makedirs(f"{staging}/{task}")
        names, others, out, last = [], 0, None, None
        try:
            for batch in batches:
                for value, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if key and not key.isascii():
                        others += 1
                        continue
                    if out is None or key != last:
                        if out:
                            out.close()
                        out, last = open(f"{staging}/{task}/{len(names)}", "wb"), key
                        names.append(f"{name}={key.translate(ESCAPED) if key else '__HIVE_DEFAULT_PARTITION__'}")
                    out.write((value or "").encode() + b"\n")
        finally:
            if out:
                out.close()
        with open(f"{staging}/{task}/list", "w") as file:
            json.dump(names, file)
        yield pa.RecordBatch.from_arrays([pa.array([task]), pa.array([number], pa.int32()), pa.array([others], pa.int64())], names=["task", "number", "others"])

    def move(batches):
        for batch in batches:
            for task, number in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with open(f"{staging}/{task}/list") as file:
                    names = json.load(file)
                for k, folder in enumerate(names):
                    source, new = f"{staging}/{task}/{k}", f"part-{number:05d}-{job}.c000.txt"
                    if not os.path.exists(source):  # moved when this task ran before
                        continue
                    os.makedirs(f"{root}/{folder}", exist_ok=True)
                    os.rename(source, f"{root}/{folder}/{new}")
                    for old in os.listdir(f"{root}/{folder}"):
                        if job not in old:  # another task of this job may see the same ones
                            with suppress(FileNotFoundError):
                                os.remove(f"{root}/{folder}/{old}")
            yield batch

    system.mkdirs(place)
    try:
        ended = rows.sortWithinPartitions(name).mapInArrow(write, "task string, number int, others long").collect()
        if ended:
            spark.createDataFrame([(x.task, x.number) for x in ended], "task string, number int").repartition(len(ended)).mapInArrow(move, "task string, number int").collect()
    finally:
        system.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{place}/.lectern-{job}"), True)
    if any(x.others for x in ended):
        with_spark(rows.where(~F.col(name).rlike(r"^[\x00-\x7F]*$")))


def few_tasks(rows: DataFrame) -> DataFrame:
    """``rows`` read by four tasks a core at most; Spark counts 4 MB for each file that it opens, so small files are dealt 32 to a task."""
    return rows.coalesce(4 * rows.sparkSession.sparkContext.defaultParallelism)


def uploads(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, modificationTime, length, content), one row a file."""
    reader = spark.read.format("binaryFile")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def decoded(content: Column) -> Column:
    """UTF-8 text with invalid bytes dropped; valid bytes stay in the JVM, others go through a pandas UDF."""
    @F.pandas_udf("string")
    def drop_invalid(x: pd.Series) -> pd.Series:
        return x.map(lambda b: None if b is None else bytes(b).decode("utf-8", errors="ignore"))

    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(drop_invalid(content))


def extractor_chain(method: Column, kind: Column) -> Column:
    """The extractors to try in order, "text" last."""
    method = F.when(method.isin("", "auto"), F.when(kind == "pdf", "pymupdf").otherwise("text")).otherwise(method)
    both = lambda *x: F.array(*map(F.lit, x))
    return (
        F.when(method == "pymupdf", both("pymupdf", "pypdf", "text"))
        .when(method == "pypdf", both("pypdf", "pymupdf", "text"))
        .when(method == "text", both("text"))
        .when(kind == "pdf", both("pymupdf", "pypdf", "text"))
        .otherwise(both("text"))
    )


def pdf_pages(files: DataFrame, extractors: dict[str, Callable[[bytes], list[str]]] | None = None) -> DataFrame:
    """Pages (PAGE) of ``files`` (path, content, kind, chain) by the first extractor of the chain that works."""
    extractors = extractors or {}

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = []
            for path, content, kind, chain in zip(*(frame[x] for x in ("path", "content", "kind", "chain"))):
                texts, used = None, "text"
                for name in chain:
                    if name == "text":
                        texts = [""] if kind == "pdf" else [bytes(content).decode("utf-8", errors="ignore")]
                    elif name in extractors:
                        try:
                            texts, used = list(extractors[name](bytes(content))), name
                        except Exception:
                            continue
                    if texts is not None:
                        break
                rows += [(path, k, text, used) for k, text in enumerate(texts or [], 1)]
            yield pd.DataFrame(rows, columns=["path", "page", "text", "method"]).astype({"page": "int32"})

    return files.select("path", "content", "kind", "chain").mapInPandas(run, PAGE)


def load(files: DataFrame, method: str | None = "auto", strategy: str | None = None, content_type: str | None = None, extractors: dict | None = None) -> DataFrame:
    """(path, filename, document_type, page, text, method, error) of ``files`` (path, content).

    Types that cannot be loaded keep one row with an error and no page.
    """
    rows = files.withColumn("filename", safe_filename(F.col("path"), "upload.bin"))
    rows = rows.withColumn("kind", document_type(F.col("filename"), F.lit(content_type)))
    rows = rows.withColumns({"chain": extractor_chain(loading_method(F.lit(method), F.col("kind")), F.col("kind")), "error": accepted(F.col("kind"))})
    names = rows.select("path", "filename", F.col("kind").alias("document_type"), "error")
    good = rows.where("error is null")
    word = docx.read(good.where("kind = 'docx'")).select("path", "page", "text", F.lit("python-docx").alias("method"), F.col("error").alias("failed"))
    other = pdf_pages(good.where("kind is null or kind <> 'docx'"), extractors).withColumn("failed", F.lit(None).cast("string"))
    pages = word.union(other)
    effects = flag_effects(flags(F.lit(strategy)))
    text = F.when(effects["clean"], clean_extracted(F.col("text"))).otherwise(F.col("text"))
    out = names.join(pages, "path", "left")
    return out.select("path", "filename", "document_type", "page", text.alias("text"), "method", F.coalesce("error", "failed").alias("error"))
