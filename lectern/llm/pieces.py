"""SentencePiece encoding and decoding through a distinct-chunk table.

A piece of the model never holds a whitespace mark after another character (checked when the model is
loaded), so no merge crosses from a word into the marks before the next one. A text is therefore the
concatenation of marked words (a run of marks and the characters up to the next mark), each of which has one
segmentation. Every task keeps a table from marked word to ids, segments the words that a batch adds to it
in one library call, and joins ids back by the words' positions. The table is emptied at a fixed number of
entries, which bounds memory and changes no result.

Defined results: a null text counts as empty; an empty text gives the begin and end ids alone; repeated rows
give repeated rows; long texts are encoded whole; other columns are never read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

#: Entries of a task's chunk table.
TABLE_ENTRIES = 500_000
_models: dict[str, object] = {}


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load(path: str):
    """The model, loaded once a worker process, after checking that its pieces cannot cross marks."""
    if path not in _models:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if any(re.search("[^▁]▁", model.id_to_piece(i)) for i in range(model.get_piece_size())):
            raise ValueError("pieces of this model cross whitespace marks")
        if model.is_unknown(model.piece_to_id("▁")):
            raise ValueError("the whitespace mark is no piece of this model")
        _models[path] = model
    return _models[path]


def chunks(text: str) -> list[str]:
    """The marked words of ``text``, each without its first mark; marks are spaces here."""
    text = text.replace("▁", " ")
    if not text:
        return []
    if "  " in text or text[0] == " " or text[-1] == " ":
        return [x[1:] for x in re.findall(" +[^ ]*", " " + text)]
    return text.split(" ")


class ChunkTable:
    """Ids (little-endian unsigned 32-bit) of each distinct marked word."""

    def __init__(self, model, entries: int = TABLE_ENTRIES):
        import numpy as np

        self.model, self.entries = model, entries
        # A single mark at a text's end; the library encodes an empty text as nothing.
        self.mark = {"": np.array([model.piece_to_id("▁")], "<u4").tobytes()}
        self.ids = dict(self.mark)

    def add(self, lists: list[list[str]]) -> None:
        import numpy as np

        if len(self.ids) > self.entries:
            self.ids = dict(self.mark)
        known = self.ids
        missing = list({x for words in lists for x in words if x not in known})
        for i in range(0, len(missing), 20_000):
            part = missing[i : i + 20_000]
            for word, ids in zip(part, self.model.encode(part, num_threads=1)):
                known[word] = np.array(ids, "<u4").tobytes()

    def join(self, words: list[str]) -> bytes:
        return b"".join(map(self.ids.__getitem__, words))


def _groups(texts: list[str | None], most: int = 4_000_000) -> Iterator[list[str]]:
    """Runs of texts of about ``most`` characters at most, or one longer text."""
    part: list[str] = []
    held = 0
    for text in texts:
        text = text or ""
        if part and held + len(text) > most:
            yield part
            part, held = [], 0
        part.append(text)
        held += len(text)
    if part:
        yield part


def _encoded(batches: Iterator, path: str) -> Iterator:
    """For each group of rows: their keys and the id bytes with begin and end ids."""
    import numpy as np

    model = load(path)
    chunk_table = ChunkTable(model)
    begin, end = (np.array([x], "<u4").tobytes() for x in (model.bos_id(), model.eos_id()))
    for batch in batches:
        keys, at = batch.column(0), 0
        for texts in _groups(batch.column(1).to_pylist()):
            lists = [chunks(x) for x in texts]
            chunk_table.add(lists)
            yield keys.slice(at, len(texts)), [begin + chunk_table.join(x) + end for x in lists], model
            at += len(texts)


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids): the ids of every text, with begin and end ids."""
    import pyarrow as pa

    path = path or model_path()

    def run(batches):
        import numpy as np

        for keys, rows, _ in _encoded(batches, path):
            yield pa.RecordBatch.from_arrays([keys, pa.array([np.frombuffer(x, "<i4") for x in rows], pa.list_(pa.int32()))], names=[key, "ids"])

    return docs.select(key, text).mapInArrow(run, f"{key} long, ids array<int>")


def decode(encoded: DataFrame, key: str = "doc_id", path: str | None = None) -> DataFrame:
    """(key, text): what the library's decode makes of each list of ids; null for null."""
    import pyarrow as pa

    path = path or model_path()

    def run(batches):
        for batch in batches:
            texts = [None if ids is None else load(path).decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return encoded.select(key, "ids").mapInArrow(run, f"{key} long, text string")


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of every row, encoded and decoded in one pass."""
    import pyarrow as pa

    path = path or model_path()

    def run(batches):
        import numpy as np

        for keys, rows, model in _encoded(batches, path):
            out = [keys, [len(x) // 4 for x in rows], [hashlib.sha256(x).hexdigest() for x in rows], [hashlib.sha256(model.decode(np.frombuffer(x, "<u4").tolist()).encode()).hexdigest() for x in rows]]
            yield pa.RecordBatch.from_arrays([out[0], pa.array(out[1], pa.int64()), pa.array(out[2]), pa.array(out[3])], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(key, text).mapInArrow(run, f"{key} long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_sentencepiece(spark, sf_dir):
    from .common import table

    return digests(table(spark, sf_dir, "documents"))
