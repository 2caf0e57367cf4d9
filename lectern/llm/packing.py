"""Packing of token sequences by non-negative least squares.

A document becomes pieces: as many full windows as it fills, and a rest. Each task gathers documents up to a
fixed number of tokens; over the histogram of its rests it enumerates shallow combinations (one to three
lengths that fill a window exactly), solves min ||A x - h|| with x >= 0 for how often each is used, rounds x
down to what the histogram holds, and packs the residual greedily, cutting a piece where it overruns its
window. What does not fill a window waits for the task's next gathering, so a task leaves one sequence at
most that is not full. Nothing is shuffled; sequence ids hold the partition number in their upper bits, so a
task that runs again gives the same rows.

Defined results: a null text counts as empty; an empty text is the end id alone; repeated rows are packed
each for itself; a text of any length is cut, never dropped; other columns are never read.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

from pyspark.sql import DataFrame

WINDOW, END_ID = 2048, 1
#: Tokens that a task gathers before it packs them, and entries of its word table.
GATHER, TABLE_ENTRIES = 6_000_000, 600_000
#: Texts whose words are looked up together; batches are bounded by bytes.
TOGETHER = 2048
_loaded: dict[str, object] = {}


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def load(path: str):
    if path not in _loaded:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _loaded[path] = WordTable(Tokenizer.from_file(path))
    return _loaded[path]


class WordTable:
    """Ids of texts by this tokenizer, word by word.

    White space only separates words for it and it lower-cases them, so a text's ids are those of its words.
    Letters A-Z are lower-cased before the look-up, and punctuation after a word in ASCII is a word of its own
    for the tokenizer too. Texts that hold a marker of a special token go to the tokenizer whole. Words are looked up once for each
    different one of the texts that are encoded together; their ids are laid out by numpy.
    """

    def __init__(self, tokenizer, entries: int = TABLE_ENTRIES):
        self.tokenizer, self.entries, self.ids = tokenizer, entries, {b"": b""}
        self.tail = re.compile(rb"([a-z]+)([^a-z'\x80-\xff]+)")

    def _raw(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def add(self, words: list[bytes]) -> None:
        known = self.ids
        if len(known) > self.entries:
            self.ids = known = {b"": b""}
        missing = [x for x in words if x not in known]
        parts = {x: m.groups() for x in missing if (m := self.tail.fullmatch(x))}
        needed = list(dict.fromkeys(y for x in missing for y in parts.get(x, (x,)) if y not in known))
        for i in range(0, len(needed), 20_000):
            part = needed[i : i + 20_000]
            for word, found in zip(part, self.tokenizer.encode_batch_fast([x.decode() for x in part], add_special_tokens=False)):
                known[word] = array("I", found.ids).tobytes()
        for x, (a, b) in parts.items():
            known[x] = known[a] + known[b]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        whole = ["<|" in x for x in texts]
        lists = pc.split_pattern(pa.array([b"" if w else x.encode().lower().replace(b"\n", b" ") for x, w in zip(texts, whole)], pa.large_binary()), b" ")
        words = lists.flatten().dictionary_encode()
        different, index = words.dictionary.to_pylist(), words.indices.to_numpy()
        self.add(different)
        found = [self.ids[x] for x in different]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        starts = np.cumsum(sizes) - sizes
        n = sizes[index]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = np.frombuffer(b"".join(found), np.uint32)[np.repeat(starts[index] - ends[:-1], n) + np.arange(ends[-1])]
        bounds = ends[lists.offsets.to_numpy()].tolist()
        return [self._raw(x) if w else ids[a:b].tobytes() for x, w, a, b in zip(texts, whole, bounds, bounds[1:])]


def combinations(lengths, counts, window: int = WINDOW, wide: int = 48):
    """Combinations of two or three of ``lengths`` whose sum is ``window``, as an array of shape (n, 3); 0 is no length.

    Triples take two lengths among the ``wide`` most frequent ones.
    """
    import numpy as np

    there = np.zeros(window + 1, bool)
    there[lengths] = True
    a = lengths[(2 * lengths <= window) & there[window - lengths]]
    pairs = np.stack([a, window - a, np.zeros_like(a)], 1)
    top = np.sort(lengths[np.argsort(-counts, kind="stable")[:wide]])
    x, y = (v.ravel() for v in np.meshgrid(top, top, indexing="ij"))
    z = window - x - y
    good = (x <= y) & (z > 0)
    x, y, z = x[good], y[good], z[good]
    good = there[z]
    triples = np.sort(np.stack([x[good], y[good], z[good]], 1), 1)
    return np.unique(np.concatenate([pairs, triples]), axis=0) if len(triples) else pairs


def solve(combos, histogram, rounds: int = 60):
    """x >= 0 that lessens ||A x - histogram||, A's columns being ``combos``: accelerated projected gradient."""
    import numpy as np

    size = len(histogram)
    weight = (combos > 0).astype(float)

    def forward(x):
        return sum(np.bincount(combos[:, k], x * weight[:, k], size) for k in range(combos.shape[1]))

    target = histogram.astype(float).copy()
    target[0] = 0
    share = forward(np.ones(len(combos)))
    step = 1 / max(1.0, combos.shape[1] * share.max())
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        gap = forward(y) - target
        then = np.maximum(0, y - step * sum(gap[combos[:, k]] * weight[:, k] for k in range(combos.shape[1])))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = then + (t - 1) / t2 * (then - x)
        x, t = then, t2
    return x


def plan(rests, window: int = WINDOW):
    """Pack ``rests`` (lengths, each under ``window``).

    Returns (sequences, open): a sequence is a list of (index, start, length) that fills the window; open is
    the same for the last one, which does not.
    """
    import numpy as np

    rests = np.asarray(rests, np.int64)
    if not len(rests):
        return [], []
    histogram = np.bincount(rests, minlength=window + 1)
    order = np.argsort(rests, kind="stable")
    ends = np.cumsum(histogram)
    by_length = {int(v): order[ends[v] - histogram[v] : ends[v]].tolist() for v in np.flatnonzero(histogram)}
    lengths = np.array(sorted(by_length), np.int64)
    combos = combinations(lengths, histogram[lengths], window)
    sequences: list[list[tuple[int, int, int]]] = []
    if len(combos):
        x = solve(combos, histogram)
        for row in np.argsort(-x, kind="stable"):
            times = int(x[row] + 0.5)
            if not times:
                break
            use = [int(v) for v in combos[row] if v]
            for _ in range(times):
                if any(len(by_length[v]) < use.count(v) for v in use):
                    break
                sequences.append([(by_length[v].pop(), 0, v) for v in use])
    left = sorted(((v, i) for v, items in by_length.items() for i in items), reverse=True)
    now: list[tuple[int, int, int]] = []
    room = window
    for length, i in left:
        start = 0
        while length:
            take = min(length, room)
            now.append((i, start, take))
            start, length, room = start + take, length - take, room - take
            if not room:
                sequences.append(now)
                now, room = [], window
    return sequences, now


def _rows(batches: Iterator, path: str, window: int, end: int, gather: int) -> Iterator[list[tuple]]:
    """Lists of (key, start, length, crc32, tokens, sequence, offset)."""
    from pyspark import TaskContext

    context = TaskContext.get()
    first = (context.partitionId() if context else 0) << 32
    words, sequence = load(path), 0
    last = array("I", [end]).tobytes()
    held: list[tuple] = []  # (key, tokens, start, ids) of rests
    out: list[tuple] = []
    gathered = 0

    def place(key, tokens, start, ids, at):
        return key, start, len(ids) // 4, zlib.crc32(ids), tokens, first + sequence, at

    def pack(final: bool):
        nonlocal sequence, held
        sequences, rest = plan([len(x[3]) // 4 for x in held], window)
        for pieces in sequences + ([rest] if final and rest else []):
            at = 0
            for i, start, length in pieces:
                key, tokens, base, ids = held[i]
                out.append(place(key, tokens, base + start, ids[4 * start : 4 * (start + length)], at))
                at += length
            sequence += 1
        held = [(held[i][0], held[i][1], held[i][2] + start, held[i][3][4 * start : 4 * (start + length)]) for i, start, length in rest]

    for batch in batches:
        keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for i in range(0, len(keys), TOGETHER):
            for key, ids in zip(keys[i : i + TOGETHER], words.encode([x or "" for x in texts[i : i + TOGETHER]])):
                ids += last
                tokens = len(ids) // 4
                full = tokens - tokens % window
                for start in range(0, full, window):
                    out.append(place(key, tokens, start, ids[4 * start : 4 * (start + window)], 0))
                    sequence += 1
                if full < tokens:
                    held.append((key, tokens, full, ids[4 * full :]))
                    gathered += tokens - full
            if gathered >= gather:
                pack(False)
                gathered = sum(len(x[3]) // 4 for x in held)
            if len(out) > 20_000:
                yield out
                out = []
    pack(True)
    yield out


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, window: int = WINDOW, end: int = END_ID, gather: int = GATHER) -> DataFrame:
    """One row a piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path = path or tokenizer_path()

    def run(batches):
        import pyarrow as pa

        names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        for rows in _rows(batches, path, window, end, gather):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows) if rows else [[]] * 7)], names=names)

    return docs.select(key, text).mapInArrow(run, f"{key} long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op5_packing(spark, sf_dir):
    from .common import table

    return pack(table(spark, sf_dir, "documents"))
