"""Exact Jaccard join of word-shingle sets by PartEnum signatures.

Sets with I / U >= 0.8 differ in at most (a + b) / 9 elements. Sizes fall in bands; within the scheme of a band
the feature domain (shingles by their hash) is partitioned in two levels, three second-level partitions in each
first-level one, and every subset of two of the three is a signature. If two sets differ in at most D elements,
any D // 2 + 1 first-level partitions hold one where they differ in one element at most, so two of its three
parts are equal. A set gives the signatures of the first ``published`` partitions only, as many as its own size
needs, larger sets at least as many as smaller ones; a set near the upper end of its band takes part in the next
band too. Two empty parts say nothing: a set with fewer than D // 2 + 1 partitions whose subsets all hold an
element gives the signatures of all partitions and those of the next of a few domain partitions, and after the last
those of empty subsets, so no link is lost (SCHEMES).

Signatures are sorted by partition and read as a stream. Each comes with the one that its set gave before. A group of up to SMALL sets
gives all its pairs but those that have this one in common too: they met there, so a pair is not given again by each of its signatures. A
larger one gives pairs with its first member only, and its membership; once these are settled, its members that
are not in one component yet are compared in bounded cells by their parities (of counts in buckets, which
differ in no more bits than the sets in elements). Every candidate is settled by the exact intersection. Sets that are
equal are linked through their digest and give signatures once a task, so groups of copies stay linear.

Defined results: a null, empty or blank text has an empty set and links with nothing; rows that repeat a
doc_id belong to one document, linked as any of its rows is; a null doc_id has a null component; texts are
read whole; other columns are never read.
"""

from __future__ import annotations

import hashlib
import math
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles
from .common import components, drop, save, table

#: Ratio of the bands' upper sizes, standard deviations of spare partitions, domain partitions; sets of a group that give all pairs.
BAND, SPARE, SCHEMES, SMALL = 1.5, 1.5, 4, 8
#: Members of a cell, rows of a pack of groups, rows that a task holds at a time.
CELL, PACK, SLICE = 1024, 4096, 512


def bands(size: int) -> list[tuple[int, int]]:
    """(upper size, least size of a partner band's set) of the bands in which a set of ``size`` takes part; none if only equal sets can link with it."""
    if size < 4:
        return []
    before, upper = 3, 5
    while upper < size:
        before, upper = upper, max(upper + 1, int(upper * BAND))
    after = max(upper + 1, int(upper * BAND))
    return [(upper, before), (after, upper)] if 5 * size // 4 > upper else [(upper, before)]


def most_apart(size: int, upper: int) -> int:
    """D: in how many elements a set of ``size`` and a linked one of at most ``upper`` can differ."""
    return (size + min(upper, 5 * size // 4)) // 9


@cache
def filled(mean: float) -> float:
    """The share of first-level partitions of ``mean`` elements with two or three of their three parts in use."""
    none = math.exp(-max(mean, 0.5) / 3)
    return (1 - none) ** 2 * (1 + 2 * none)


def wanted(size: int, upper: int, partitions: int) -> int:
    """First-level partitions of which D // 2 + 1 are filled almost surely."""
    least, share = most_apart(size, upper) // 2 + 1, filled(round(size / partitions, 1))
    return int((least + SPARE * math.sqrt(least * (1 - share))) / share) + 1


@cache
def scheme(upper: int, before: int) -> tuple[int, int, tuple[int, ...]]:
    """(first-level partitions, least size, how many of them a set of each size from the least one gives)."""
    partitions = 0
    trial = most_apart(upper, upper) // 2 + 1
    while trial > partitions and partitions < max(1, upper // 4):
        partitions = trial
        trial = min(max(partitions, wanted(upper, upper, partitions)), max(partitions, upper // 4))
    least = min(4 * (before + 1) // 5, upper)
    given, out = 0, []
    for size in range(least, upper + 1):
        given = max(given, min(partitions, wanted(size, upper, partitions)))
        out.append(given)
    return partitions, least, tuple(out)


def signatures(found):
    """The signatures of the sorted set ``found``."""
    import numpy as np

    out = []
    for upper, before in bands(len(found)):
        partitions, least, given = scheme(upper, before)
        give = given[len(found) - least]
        for k in range(SCHEMES):
            h = found if not k else np.sort(shingles.mix(found + np.uint64(k)))
            part = ((h >> np.uint64(32)) * np.uint64(3 * partitions)) >> np.uint64(32)
            edges = np.searchsorted(part, np.arange(3 * partitions + 1, dtype=np.uint64))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(shingles.mix(h ^ np.uint64(0xA5A5A5A5)), dtype=np.uint64)])
            sums = (sums[edges[1:]] - sums[edges[:-1]]).reshape(partitions, 3)
            counts = (edges[1:] - edges[:-1]).reshape(partitions, 3)
            full = (counts > 0).sum(1) >= 2
            enough = 2 * int(full[:give].sum()) > most_apart(len(found), upper)
            rows = give if enough else partitions
            sums, counts = (x[:rows].sum(1, dtype=x.dtype)[:, None] - x[:rows] for x in (sums, counts))
            name = np.uint64((upper * SCHEMES + k) << 24) + np.arange(3 * rows, dtype=np.uint64).reshape(rows, 3)
            keys = shingles.mix(sums ^ shingles.mix(name + np.uint64(1)))
            out.append(keys[counts > 0] if enough or k < SCHEMES - 1 else keys.ravel())
            if enough:
                break
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def parity_size(n: int) -> int:
    """Bits of the parity of a set of ``n``: so many that few elements share one."""
    return max(64, 1 << (2 * n - 1).bit_length())


def parity(found):
    """Which of parity_size buckets hold an odd number of the set's shingles, one bit each.

    Two sets' parities differ in at most as many bits as the sets in elements.
    """
    import numpy as np

    size = parity_size(len(found))
    odd = np.bincount((found & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def folded(bits, width: int):
    """Rows of parities (64-bit words), folded to ``width`` words."""
    while bits.shape[-1] > width:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def can_link(sizes_a, sizes_b, bits_a, bits_b):
    """Whether sets can link, by their sizes and parities (rows of 64-bit words): true for every pair that does."""
    import numpy as np

    width = min(bits_a.shape[-1], bits_b.shape[-1])
    apart = np.bitwise_count(folded(bits_a, width) ^ folded(bits_b, width)).sum(-1, dtype=np.int64)
    return (9 * apart <= sizes_a + sizes_b) & (5 * np.minimum(sizes_a, sizes_b) >= 4 * np.maximum(sizes_a, sizes_b))


def slices(batches, rows: int = SLICE):
    """The batches in stretches of at most ``rows``."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def profiles(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, digest, bits) of every row; the last two, the digest and the parity of the set, are null for empty sets."""
    import pyarrow as pa

    def run(batches):
        for batch in slices(batches):
            sets = [shingles.shingle_set(x.as_py()) for x in batch.column(1)]
            digests = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets]
            bits = [parity(x).tobytes() if len(x) else None for x in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(bits, pa.binary())], names=["doc_id", "n_shingles", "digest", "bits"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, digest binary, bits binary")


def signature_rows(docs: DataFrame) -> DataFrame:
    """(signature, before, doc_id), before being the set's signature before this one, or 0; a set that a task has met gives none again."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        met = set()
        keys, last, ids, held = [], [], [], 0

        def flush():
            return pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(x).view(np.int64)) for x in (keys, last)), pa.array(np.concatenate(ids))], names=["signature", "before", "doc_id"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = shingles.shingle_set(text.as_py())
                if doc is None or not len(found):
                    continue
                digest = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
                if digest in met:
                    continue
                met.add(digest)
                given = signatures(found)
                own, at = np.unique(given, return_index=True)
                keys.append(own)
                last.append(np.concatenate([np.zeros(1, np.uint64), given])[at])
                ids.append(np.full(len(own), doc, np.int64))
                held += len(own)
                if held > 200_000:
                    yield flush()
                    keys, last, ids, held = [], [], [], 0
        if keys:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, "signature long, before long, doc_id long")


def grouped(rows: DataFrame) -> DataFrame:
    """From (signature, before, doc_id): rows (g null, a, b) of pairs to settle, and (g, a, b) of members of large groups, b being the group's first."""
    import numpy as np
    import pyarrow as pa

    def emit(keys, before, docs, last: bool, seen: set):
        """Rows of the groups that are complete; the place where the last, open one begins."""
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        ends = np.concatenate([starts[1:], [len(keys)]])
        upto = len(keys) if last or not len(starts) else int(starts[-1])
        pairs, members = [], []
        size = ends - starts
        good = (ends <= upto) & (size > 1)
        for n in range(2, SMALL + 1):
            at = starts[good & (size == n)]
            for i in range(n - 1 if len(at) else 0):
                for j in range(i + 1, n):
                    new = (before[at + i] != before[at + j]) | (before[at + i] == 0)
                    pairs.append(np.stack([docs[at + i], docs[at + j]], 1)[new])
        for s, e in zip(starts[good & (size > SMALL)], ends[good & (size > SMALL)]):
            own, new = docs[s:e], (before[s:e] != before[s]) | (before[s:e] == 0)
            if not new.any():
                continue  # all of them are in the large group of the signature before
            name = hashlib.blake2b(own.tobytes(), digest_size=8).digest()
            if name in seen:
                continue
            seen.add(name)
            pairs.append(np.stack([np.full(len(own) - 1, own[0]), own[1:]], 1)[new[1:]])
            members.append(np.stack([np.full(len(own), int.from_bytes(name, "little", signed=True)), own, np.full(len(own), own[0])], 1))
        return pairs, members, upto

    def run(batches):
        seen: set[bytes] = set()
        keys, before, docs = (np.zeros(0, np.int64) for _ in range(3))
        waiting, held = [], 0
        for batch in _with_end(batches):
            if batch is not None:
                keys = np.concatenate([keys, batch.column(0).to_numpy(zero_copy_only=False)])
                before = np.concatenate([before, batch.column(1).to_numpy(zero_copy_only=False)])
                docs = np.concatenate([docs, batch.column(2).to_numpy(zero_copy_only=False)])
            pairs, members, upto = emit(keys, before, docs, batch is None, seen)
            keys, before, docs = keys[upto:], before[upto:], docs[upto:]
            waiting += pairs
            held += sum(map(len, pairs))
            if waiting and (batch is None or held > 500_000):
                found = np.unique(np.concatenate(waiting), axis=0)
                found = found[found[:, 0] != found[:, 1]]
                waiting, held = [found], 0
                if batch is not None and len(found) < 250_000:
                    continue
                waiting = []
                yield pa.RecordBatch.from_arrays([pa.nulls(len(found), pa.int64()), pa.array(found[:, 0]), pa.array(found[:, 1])], names=["g", "a", "b"])
            if members:
                found = np.concatenate(members)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, k]) for k in range(3)], names=["g", "a", "b"])

    return rows.repartition("signature").sortWithinPartitions("signature", "doc_id").mapInArrow(run, "g long, a long, b long")


def _with_end(batches):
    yield from batches
    yield None


def sifted(pairs: DataFrame, info: DataFrame) -> DataFrame:
    """The distinct pairs (a, b) of ``pairs`` that can link by their sizes and parities."""
    import numpy as np
    import pyarrow as pa

    def sift(batches):
        for batch in slices(batches, 4096):
            a, b = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 4))
            x, y = (batch.column(k).to_pylist() for k in (3, 5))
            kinds = np.array([len(v) for v in x]) * (1 << 32) + np.array([len(v) for v in y])
            good = np.zeros(batch.num_rows, bool)
            for kind in np.unique(kinds):
                at = np.flatnonzero(kinds == kind)
                words = [np.frombuffer(b"".join([v[i] for i in at]), np.uint64).reshape(len(at), -1) for v in (x, y)]
                good[at] = can_link(a[at], b[at], *words)
            yield batch.filter(pa.array(good)).select([0, 1])

    side = lambda x: info.select(F.col("doc_id").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("bits").alias(f"s{x}"))
    pairs = pairs.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "sa", "nb", "sb")
    return save(pairs.mapInArrow(sift, "a long, b long").distinct(), "pairs")


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of ``pairs`` whose whole sets link."""
    import numpy as np
    import pyarrow as pa

    def sets(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles.shingle_set(x.as_py()).tobytes() for x in batch.column(1)], pa.binary())], names=["doc_id", "found"])

    def verify(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                good.append(100 * both >= 80 * (len(x) + len(y) - both))
            yield batch.filter(pa.array(good, pa.bool_())).select([0, 1])

    ids = save(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")  # a table, so that Spark knows its size
    held = save(docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").mapInArrow(sets, "doc_id long, found binary"), "sets")
    side = lambda x: held.select(F.col("doc_id").alias(x), F.col("found").alias(f"f{x}"))
    out = save(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "fa", "fb").mapInArrow(verify, "a long, b long").distinct(), "links")
    drop(out.sparkSession, held, ids)
    return out


def settled(pairs: DataFrame, links: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) that, with ``links``, join what the candidates ``pairs`` (saved) join.

    Each document is compared with its first partner; then only pairs of different components are left.
    """
    first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = links.union(verified(first, docs))
    rest = apart(pairs.join(first, ["a", "b"], "left_anti"), components(links))
    return save(links.union(verified(rest, docs)), "links")


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    side = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}"))
    joined = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return joined.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def cells(members: DataFrame) -> DataFrame:
    """Members (g, first, doc_id, root) of groups that are not one component yet, dealt into cells (first, pack, i, j).

    Groups with one first member have many pairs in common; they share a pack of about PACK rows, where a pair
    is compared for all of them. A group of more than CELL members is dealt into several cells, with i <= j.
    """
    open_ = members.groupBy("g").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.ceil(F.count("*") / CELL).cast("int").alias("blocks")).where("lo <> hi").select("g", "blocks")
    rows = members.join(open_, "g")
    packs = rows.groupBy("first").agg(F.ceil(F.count("*") / PACK).cast("int").alias("packs"))
    rows = rows.join(packs, "first").withColumns({"own": F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"), "pack": F.pmod(F.xxhash64("g"), F.col("packs")).cast("int")})
    cell = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, F.col("own")).alias("i"), F.greatest(x, F.col("own")).alias("j")))
    return rows.select("first", "pack", "g", "doc_id", "root", "own", F.explode(cell).alias("cell")).select("first", "pack", "g", "doc_id", "root", "own", "cell.i", "cell.j")


def across(rows: DataFrame) -> DataFrame:
    """The pairs (a, b) of each group within a cell that are in two components and can link by sizes and parities."""
    import numpy as np
    import pandas as pd

    def run(key, frame):
        frame = frame.sort_values("g", kind="stable")
        groups, size, root, own, ids = (frame[x].to_numpy() for x in ("g", "n_shingles", "root", "own", "doc_id"))
        width = min(map(len, frame["bits"])) // 8  # the sets of a group are of one band
        bits = np.stack([folded(np.frombuffer(x, np.uint64), width) for x in frame["bits"]])
        starts = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
        out = [np.zeros((0, 2), np.int64)]
        for s, e in zip(starts, [*starts[1:], len(groups)]):
            names, count = np.unique(root[s:e], return_counts=True)
            most = names[np.argmax(count)]
            for k in s + np.flatnonzero(root[s:e] != most):
                good = (root[s:e] != root[k]) & can_link(size[k], size[s:e], bits[k], bits[s:e])
                if key[2] != key[3]:
                    good &= own[s:e] != own[k]
                if good.any():
                    other = ids[s:e][good]
                    out.append(np.stack([np.minimum(other, ids[k]), np.maximum(other, ids[k])], 1))
            if len(out) > 1000:
                out = [np.unique(np.concatenate(out), axis=0)]
        return pd.DataFrame(np.unique(np.concatenate(out), axis=0), columns=["a", "b"])

    return rows.groupBy("first", "pack", "i", "j").applyInPandas(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text)."""
    held = save(profiles(docs), "profiles")
    info = held.where("n_shingles > 0 and doc_id is not null").dropDuplicates(["doc_id", "digest"])
    groups = save(grouped(signature_rows(docs)), "groups")
    least = info.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n")
    links = save(info.select("doc_id", "digest").join(least, "digest").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")), "equal")
    links = settled(sifted(groups.where("g is null"), info), links, docs)
    members = groups.where("g is not null").select("g", F.col("b").alias("first"), F.col("a").alias("doc_id")).distinct()
    members = members.join(components(links).withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    rest = cells(save(members, "members")).join(info.select("doc_id", "n_shingles", "bits"), "doc_id")
    links = links.union(verified(save(across(rest), "across"), docs))
    roots = components(links)
    out = held.select("doc_id", "n_shingles").join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))


def op6_jaccard(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)
), r AS (
  SELECT doc_id, doc_id AS root FROM documents
  UNION
  SELECT l.b, r.root FROM r JOIN l ON r.doc_id = l.a
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c AS component_id
FROM documents d JOIN (SELECT doc_id, min(root) AS c FROM r GROUP BY doc_id) USING (doc_id) LEFT JOIN n USING (doc_id)
"""
