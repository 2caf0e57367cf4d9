"""Token counts of whole texts: batch encoding in Arrow functions that give lengths only.

Texts are cut into stretches of bounded size at safe boundaries, places where no token, no normalisation and no
special string of the tokenizer reaches across; the counts of the stretches add up to the text's. Stretches are
gathered into batches of about equal bytes. Within a batch, what lies between two safe boundaries is a part;
every part that the task has not met is encoded once, in library calls of about equal bytes, and only its
length is kept, in a table of bounded size. A text without any safe boundary goes to the library whole.

Safe boundaries, by what the tokenizer's file declares:

* tokenizers files that split by patterns, normalise white space and drop it: at any space, which belongs to no token;
* tokenizers files with byte-level words and no normaliser: before a space with a visible ASCII character behind it, which
  then begins a word together with its space;
* sentencepiece models whose pieces cannot cross white-space marks: at the marks (see :mod:`pieces`);
* any other file: none, every text goes to the library whole.

Defined results: a null text counts as empty; an empty text has 0 bytes and 0 tokens; a null id stays null; repeated
rows give repeated rows; texts of any length are counted whole; other columns are never read.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens above which a text is over the limit.
LIMIT = 2048
#: Bytes of a stretch, of a batch of stretches and of the new parts of one library call; entries of a task's table of lengths.
STRETCH, BATCH, CALL, ENTRIES = 1_000_000, 4_000_000, 500_000, 600_000
_loaded: dict[str, "Counter"] = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Counter:
    """Lengths of texts (UTF-8) by one tokenizer; ``safe`` finds a safe boundary, ``parts`` cuts a text at all of them."""

    safe: re.Pattern | None = None

    def __init__(self, entries: int = ENTRIES):
        self.entries, self.known = entries, {}

    def parts(self, text: bytes) -> list:
        return [text]

    def lengths(self, parts: list) -> list[int]:
        """The library's lengths of ``parts``."""
        raise NotImplementedError

    def learn(self, lists: list[list]) -> None:
        """Enter the parts that the table lacks, in calls of about CALL bytes."""
        if len(self.known) > self.entries:
            self.known = {}
        new = set().union(*lists).difference(self.known)
        call, held = [], 0
        for x in new:
            call.append(x)
            held += len(x)
            if held >= CALL:
                self.known.update(zip(call, self.lengths(call)))
                call, held = [], 0
        if call:
            self.known.update(zip(call, self.lengths(call)))

    def count(self, texts: list[bytes]) -> list[int]:
        lists = [self.parts(x) for x in texts]
        self.learn(lists)
        get = self.known.__getitem__
        return [sum(map(get, x)) for x in lists]


class Whole(Counter):
    """A tokenizers file of which nothing is known: no safe boundaries."""

    def __init__(self, path: str, entries: int = ENTRIES):
        super().__init__(entries)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on every core already
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()

    def lengths(self, parts):
        return [len(x) for x in self.model.encode_batch_fast([x.decode() for x in parts], add_special_tokens=False)]

    def count(self, texts):
        return self.lengths(texts)


class Dropped(Whole):
    """White space separates tokens and is dropped."""

    safe = re.compile(rb" ")
    count = Counter.count

    def parts(self, text):
        return text.split(b" ")


class Prefixed(Whole):
    """A space belongs to the word behind it."""

    safe = re.compile(rb" (?=[!-~])")
    count = Counter.count

    def parts(self, text):
        first, *rest = self.safe.split(text)
        return [first, *[b" " + x for x in rest]]


class Marked(Counter):
    """A sentencepiece model; parts are marked words without their mark."""

    safe = re.compile(rb"(?<=[A-Za-z]) (?=[A-Za-z])")

    def __init__(self, path: str, entries: int = ENTRIES):
        super().__init__(entries)
        from . import pieces

        self.model, self.chunks = pieces.load(path), pieces.chunks

    def parts(self, text):
        return self.chunks(text.decode())

    def lengths(self, parts):
        # An empty part is a mark at a text's end, which the library gives one piece; it encodes an empty text as nothing.
        return [len(x) if y else 1 for x, y in zip(self.model.encode(parts, num_threads=1), parts)]


def kind(path: str) -> type[Counter]:
    """How the file at ``path`` lets texts be cut."""
    if path.endswith(".model"):
        return Marked
    with open(path, encoding="utf-8") as file:
        what = json.load(file)
    if any(re.search(r"\s", x["content"]) or x["lstrip"] or x["rstrip"] or x["single_word"] for x in what.get("added_tokens") or []):
        return Whole
    words, rules = what.get("pre_tokenizer") or {}, what.get("normalizer")
    split = (words.get("pretokenizers") or [{}])[0]
    if split.get("type") == "Split" and split["behavior"] == "Removed" and split["invert"] and rules and {x["type"] for x in rules.get("normalizers", [rules])} <= {"NFC", "Replace", "Lowercase"} and all(x.get("pattern") == {"Regex": r"\s+"} and x.get("content") == " " for x in rules.get("normalizers", [rules]) if x["type"] == "Replace"):
        # Spaces must match the pattern nowhere: neither named in it nor let in by a class that excludes other things only.
        pattern = split["pattern"].get("Regex", " ")
        if " " not in pattern and "." not in pattern and "\\s" not in re.sub(r"\[\^[^\]]*\\s[^\]]*\]", "", pattern) and all("\\s" in x for x in re.findall(r"\[\^[^\]]*\]", pattern)):
            return Dropped
    if words.get("type") == "ByteLevel" and words.get("use_regex", True) and not words.get("add_prefix_space") and rules is None:
        return Prefixed
    return Whole


def load(path: str) -> Counter:
    """The counter of a file, made once a worker process."""
    if path not in _loaded:
        _loaded[path] = kind(path)(path)
    return _loaded[path]


def stretches(text: bytes, safe: re.Pattern | None, most: int = STRETCH) -> Iterator[bytes]:
    """``text`` cut at the first safe boundary behind each ``most`` bytes; the space at a cut stays only where the tokens behind it hold it."""
    at = 0
    while safe is not None and len(text) - at > most and (cut := safe.search(text, at + most)):
        yield text[at : cut.start()]
        at = cut.start() if safe is Prefixed.safe else cut.end()
    yield text[at:]


def batches(texts, safe: re.Pattern | None, stretch: int = STRETCH, most: int = BATCH) -> Iterator[tuple[list[int], list[bytes]]]:
    """(row numbers, stretches) of about ``most`` bytes each; a row with a long text has several stretches."""
    rows, held, size = [], [], 0
    for i, text in enumerate(texts):
        for x in stretches(text, safe, stretch):
            if held and size + len(x) > most:
                yield rows, held
                rows, held, size = [], [], 0
            rows.append(i)
            held.append(x)
            size += len(x)
    if held:
        yield rows, held


def counts(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every row by the tokenizer file at ``path``, without begin, end or added special tokens."""
    import pyarrow as pa

    path = path or tokenizer_path()
    kinds = dict(docs.dtypes)

    def run(frames):
        import numpy as np

        counter = load(path)
        for frame in frames:
            texts = frame.column(1).cast(pa.binary())
            n = np.zeros(len(texts), np.int64)
            for rows, held in batches((x.as_buffer().to_pybytes() for x in texts), counter.safe):
                np.add.at(n, rows, counter.count(held))
            size = np.diff(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([frame.column(0), pa.array(size), pa.array(n), pa.array(n > limit)], names=[key, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(key, F.coalesce(text, F.lit("")).alias(text)).mapInArrow(run, f"`{key}` {kinds[key]}, n_bytes long, n_tokens long, over_limit boolean")


def op13_token_counts(spark, sf_dir):
    from .common import table

    return counts(table(spark, sf_dir, "documents"))
