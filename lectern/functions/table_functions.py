"""Chunkers as table functions of SQL: ``SELECT * FROM chunk_sentence(TABLE(pages), max_chars => 600)``.

The table has doc_id, page_number and text (other columns are left out). Spark brings the pages of a document together,
in their order, so chunk ids run over them; a partition's function keeps nothing but its counter from page to page. They give what
:mod:`lectern.operators.chunking` gives, and are for SQL that has no DataFrame at hand: the column expressions there need no shuffle for
documents of one page and stay in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf
from pyspark.sql.types import IntegerType, StringType, StructType

#: White space as :data:`lectern.functions.text.SPACE` has it.
_SPACE = r"[\s\x1c-\x1f]"
_BLOCK, _END = re.compile(r"\n\s*\n+"), re.compile(r"(?<=[。！？；])|(?<=[.!?])\s+")


def windows(text: str, size: int, overlap: int) -> Iterator[tuple[str, int]]:
    """Windows of ``size`` words that share ``overlap``, with their words counted; the first that reaches the end is the last."""
    size = max(1, size)
    step = size - min(max(0, overlap), size - 1)
    words = [x for x in re.split(f"{_SPACE}+", text) if x]
    for at in range(0, len(words), step):
        part = words[at : at + size]
        yield " ".join(part), len(part)
        if at + size >= len(words):
            return


def packed(text: str, max_chars: int) -> Iterator[tuple[str, int]]:
    """Sentences joined by a space up to max(100, ``max_chars``) characters; a longer sentence stays whole."""
    most, held, size = max(100, max_chars), [], 0
    for block in _BLOCK.split(text):
        for x in _END.split(block):
            x = re.sub(f"^{_SPACE}+|{_SPACE}+$", "", x)
            if not x:
                continue
            if held and size + 1 + len(x) > most:
                yield " ".join(held), sum(len([w for w in re.split(f"{_SPACE}+", y) if w]) for y in held)
                held, size = [], 0
            size += len(x) + bool(held)
            held.append(x)
    if held:
        yield " ".join(held), sum(len([w for w in re.split(f"{_SPACE}+", y) if w]) for y in held)


def _number(given: dict, name: str, default: int) -> int:
    value = given.get(name)
    if value is not None and not value.isConstantExpression:
        raise ValueError(f"{name} has to be a constant")
    return default if value is None or value.value is None else int(value.value)


class _Chunker:
    """What the functions have in common; ``cut`` makes (content, words) of a text."""

    #: Names and defaults of the arguments besides the table.
    numbers: dict[str, int] = {}

    def __init__(self):
        self.chunk_id = 0

    @classmethod
    def analyzed(cls, pages: AnalyzeArgument, given: dict) -> AnalyzeResult:
        if not pages.isTable:
            raise ValueError("the first argument has to be a table, as TABLE(pages)")
        kinds = {f.name: f.dataType for f in pages.dataType.fields}
        missing = [c for c in ("doc_id", "page_number", "text") if c not in kinds]
        if missing:
            raise ValueError("the table of pages lacks " + ", ".join(missing))
        for name, default in cls.numbers.items():
            _number(given, name, default)
        schema = StructType().add("doc_id", kinds["doc_id"]).add("chunk_id", IntegerType()).add("page_number", kinds["page_number"])
        schema = schema.add("page_range", StringType()).add("word_count", IntegerType()).add("content", StringType())
        return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn("doc_id")], orderBy=[OrderingColumn("page_number")])

    def rows(self, page, *numbers) -> Iterator[tuple]:
        values = [default if n is None else int(n) for n, default in zip([*numbers, *[None] * len(self.numbers)], self.numbers.values())]
        for content, n in self.cut(page["text"] or "", *values):
            self.chunk_id += 1
            yield page["doc_id"], self.chunk_id, page["page_number"], None if page["page_number"] is None else str(page["page_number"]), n, content


class FixedSize(_Chunker):
    numbers = {"chunk_size": 400, "overlap": 50}
    cut = staticmethod(windows)

    @staticmethod
    def analyze(pages: AnalyzeArgument, chunk_size: AnalyzeArgument = None, overlap: AnalyzeArgument = None) -> AnalyzeResult:
        return FixedSize.analyzed(pages, {"chunk_size": chunk_size, "overlap": overlap})

    def eval(self, pages, chunk_size=None, overlap=None):
        yield from self.rows(pages, chunk_size, overlap)


class Sentence(_Chunker):
    numbers = {"max_chars": 1200}
    cut = staticmethod(packed)

    @staticmethod
    def analyze(pages: AnalyzeArgument, max_chars: AnalyzeArgument = None) -> AnalyzeResult:
        return Sentence.analyzed(pages, {"max_chars": max_chars})

    def eval(self, pages, max_chars=None):
        yield from self.rows(pages, max_chars)


class ByPage(_Chunker):
    @staticmethod
    def cut(text: str) -> Iterator[tuple[str, int]]:
        yield text, len([w for w in re.split(f"{_SPACE}+", text) if w])

    @staticmethod
    def analyze(pages: AnalyzeArgument) -> AnalyzeResult:
        return _Chunker.analyzed(pages, {})

    def eval(self, pages):
        yield from self.rows(pages)


def register(spark: SparkSession) -> None:
    """Make chunk_fixed_size, chunk_sentence and chunk_by_page known to the session's SQL."""
    from ..deploy import ship

    ship(spark)
    for name, function in (("chunk_fixed_size", FixedSize), ("chunk_sentence", Sentence), ("chunk_by_page", ByPage)):
        spark.udtf.register(name, udtf(function))
