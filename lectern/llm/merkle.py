"""Merkle manifest of a dataset, by supersteps of messages over RDDs.

Every row is a leaf; the leaves of a group (``lang``) hang in a binary tree by ascending key, and the groups' subroots in a
tree above them. A vertex is a subtree of up to 2^HEIGHT children. In an upward superstep every child messages
its parent (group, position // 2^HEIGHT); a parent is complete when its messages have met, hashes them level
by level, is written, and forwards its digest in the next superstep. In the reverse supersteps a vertex that
has received the siblings on the way from itself to the root adds those within its own subtree for each
child and messages the children, down to the leaves, which fold their own digest with the siblings and compare with the root.
Supersteps number log(rows) / HEIGHT each way; every message is of bounded size, and no vertex has more than
2^HEIGHT children, so a group of any size is spread evenly. HEIGHT = 1 is the plain form: one level a superstep.

Positions come from one range sort by (group, key, leaf digest), written once; only the first and the last group of
every partition, with their sizes, go to the driver.

Defined results: nulls are written as ``-`` in a leaf; a null group is a group of its own, before all others; null keys
stand first in their group and are never tampered with; rows that repeat a key are ordered by their digests, and rows that are equal throughout are leaves each for
itself, whose proofs may be told apart by position only; the root of one row is its leaf, with the hash of no siblings as proof; an
empty table gives no rows; texts of any length are hashed by the JVM and never shuffled; other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

HEIGHT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A node that hangs in a tree: the tree (a group; named is false for the null group), what it is ordered by, its digests.
NODE = ("named", "grp", "key", "label", "leaf", "forged")
PLACED = "pid int, run int, here long, named boolean, grp string, key long, label string, leaf binary, forged binary"
VERTEX = "named boolean, grp string, block long, children array<struct<leaf: binary, key: long, label: string, forged: binary>>, digest binary"
RESULT = "key long, leaf string, subroot string, proof_sha256 string, folded_root string"
#: A step of a path is a byte for where the sibling stands and the sibling's digest (none: zero bytes).
LEFT, RIGHT, NONE, STEP = 0, 1, 2, 33


def combined(*parts: bytes) -> bytes:
    """SHA-256 over the hex texts of digests."""
    return hashlib.sha256("".join([x.hex() for x in parts]).encode()).digest()


def leaf_digest(values: list[Column]) -> Column:
    """SHA-256 (binary) over the fields: ``-`` for null, else their length in bytes, a colon and the value."""
    text = [x.cast("string") for x in values]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in text]), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """The nodes of ``documents``; forged is the digest after tampering, where a row is tampered with and that changes it."""
    longer = F.col("n_chars").cast("decimal(20,0)") + 1
    chosen = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    forged = F.when(chosen, leaf_digest([longer if c == "n_chars" else F.col(c) for c in FIELDS]))
    values = (F.col("lang").isNotNull(), F.coalesce("lang", F.lit("")), F.col("doc_id").cast("long"), F.lit(None).cast("string"), leaf_digest([F.col(c) for c in FIELDS]), forged)
    return docs.select(*[x.alias(c) for x, c in zip(values, NODE)])


def placed(rows: DataFrame) -> tuple[DataFrame, dict, int]:
    """The nodes ``rows`` in order, written (PLACED) with the place ``here`` of each within its partition's run of its tree; how many nodes
    of a partition's first run stand before it; and the size of the largest tree."""
    import pyarrow as pa

    def number(batches):
        from pyspark import TaskContext

        pid, run, now, here = TaskContext.get().partitionId(), -1, None, 0
        for b in batches:
            runs, places = [], []
            for tree in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                run, here = (run, here + 1) if tree == now else (run + 1, 0)
                now = tree
                runs.append(run)
                places.append(here)
            yield pa.RecordBatch.from_arrays([pa.array([pid] * len(runs), pa.int32()), pa.array(runs, pa.int32()), pa.array(places, pa.int64()), *b.columns], names=["pid", "run", "here", *NODE])

    order = ["named", "grp", F.col("key").asc_nulls_first(), F.col("label").asc_nulls_first(), "leaf", "tie"]
    whole = rows.withColumn("tie", F.monotonically_increasing_id())  # nodes that are equal throughout can still be dealt out
    out = common.save(whole.repartitionByRange(*order).sortWithinPartitions(*order).select(*NODE).mapInArrow(number, PLACED), "placed")
    runs = out.groupBy("pid", "run").agg(F.first("named").alias("named"), F.first("grp").alias("grp"), (F.max("here") + 1).alias("n"))
    ends = runs.groupBy("pid").agg(F.min(F.struct("run", "named", "grp", "n")).alias("first"), F.max(F.struct("run", "named", "grp", "n")).alias("last"), F.max("n").alias("most"))
    before, tree, standing, most = {}, None, 0, 0
    for r in sorted(ends.collect(), key=lambda r: r["pid"]):  # a row for each partition
        before[r["pid"]] = standing if tuple(r["first"][1:3]) == tree else 0
        most = max(most, r["most"], r["first"]["n"] + before[r["pid"]])
        tree, standing = tuple(r["last"][1:3]), r["last"]["n"] + (before[r["pid"]] if r["last"]["run"] == 0 else 0)
    return out, before, most


def levels(nodes: list[bytes], height: int | None) -> list[list[bytes]]:
    """``nodes`` and the levels above them: ``height`` levels, or (None) up to a single node."""
    out = [nodes]
    while height is None and len(out[-1]) > 1 or height is not None and len(out) <= height:
        now = out[-1]
        out.append([combined(*now[i : i + 2]) for i in range(0, len(now), 2)])
    return out


def within(block: int, nodes: list[bytes], height: int) -> list[list[bytes]]:
    """The levels of a vertex. The first block of a tree goes up to a single node, which takes fewer levels if the tree is small; where
    there are further blocks the first one is full, so its levels are ``height`` too."""
    return levels(nodes, height if block else None)


def siblings(within_: list[list[bytes]], i: int) -> bytes:
    """The path of child ``i`` up to its vertex's own digest."""
    out = []
    for row in within_[:-1]:
        other = i ^ 1
        out.append(bytes([RIGHT if other > i else LEFT]) + row[other] if other < len(row) else bytes([NONE]) + bytes(STEP - 1))
        i >>= 1
    return b"".join(out)


def steps(path: bytes) -> Iterator[tuple[int, bytes]]:
    for k in range(0, len(path), STEP):
        yield path[k], path[k + 1 : k + STEP]


def fold(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf's digest and its siblings give."""
    for where, other in steps(path):
        leaf = combined(other, leaf) if where == LEFT else combined(leaf, other) if where == RIGHT else combined(leaf)
    return leaf


def tree(rows: DataFrame, height: int = HEIGHT) -> list[DataFrame]:
    """The written vertices (VERTEX) of each upward superstep over the nodes ``rows``; the last step has one vertex a tree, block 0."""
    spark = rows.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    nodes, before, most = placed(rows)
    offset = spark.sparkContext.broadcast(before)

    def leaf_message(r):
        at = r["here"] + (offset.value[r["pid"]] if r["run"] == 0 else 0)
        return (r["named"], r["grp"], at >> height), (at, bytes(r["leaf"]), r["key"], r["label"], r["forged"] and bytes(r["forged"]))

    def message(r):
        return (r["named"], r["grp"], r["block"] >> height), (r["block"], bytes(r["digest"]), None, None, None)

    def complete(vertex):
        (named, group, block), found = vertex
        found = sorted(found, key=lambda x: x[0])
        return named, group, block, [x[1:] for x in found], within(block, [x[1] for x in found], height)[-1][0]

    out = []
    sent = nodes.rdd.map(leaf_message)
    while True:
        vertices = spark.createDataFrame(sent.groupByKey(tasks).map(complete), VERTEX, verifySchema=False)
        out.append(common.save(vertices, "vertices"))
        most = (most + 2**height - 1) >> height
        if most <= 1:
            return out
        sent = out[-1].rdd.map(message)


def told(vertices: DataFrame, paths, height: int):
    """A downward superstep: each vertex gives its children their paths. ``paths``: an RDD of ((named, grp, block), (path, note)); the result
    has ((named, grp, position), (path, note), child) for every child."""
    tasks = int(vertices.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def tell(met):
        (named, group, block), (nodes, (path, note)) = met
        rows = within(block, [bytes(x[0]) for x in nodes], height)
        for i, child in enumerate(nodes):
            yield (named, group, (block << height) + i), (siblings(rows, i) + path, note), child

    return vertices.rdd.map(lambda r: ((r["named"], r["grp"], r["block"]), r["children"])).join(paths, tasks).flatMap(tell)


def manifest(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of ``documents``."""
    spark = docs.sparkSession
    common.ship(spark)
    trees = tree(leaves(docs), height)
    subroots = trees[-1].select(F.lit(True).alias("named"), F.lit("").alias("grp"), F.col("named").cast("long").alias("key"), F.col("grp").alias("label"), F.col("digest").alias("leaf"), F.lit(None).cast("binary").alias("forged"))
    above = tree(subroots, height)
    top = above[-1].select("named", "grp", "block", "digest").take(1)
    root = bytes(top[0]["digest"]) if top else b""
    paths = spark.sparkContext.parallelize([((True, "", 0), (b"", b""))], 1)
    for step in reversed(above):
        found = told(step, paths, height)
        paths = found.map(lambda x: x[:2])
    # The children of the last step are the subroots: each is told to the one vertex of its own tree.
    paths = found.map(lambda x: ((bool(x[2]["key"]), x[2]["label"], 0), (x[1][0], bytes(x[2]["leaf"]))))
    for step in reversed(trees):
        found = told(step, paths, height)
        paths = found.map(lambda x: x[:2])

    def verify(x):
        _, (path, subroot), child = x
        leaf = bytes(child["leaf"])
        proof = combined(*[other for where, other in steps(path) if where != NONE])
        return child["key"], leaf.hex(), subroot.hex(), proof.hex(), fold(bytes(child["forged"]) if child["forged"] else leaf, path).hex()

    rows = spark.createDataFrame(found.map(verify), RESULT, verifySchema=False)
    return rows.select(F.col("key").alias("doc_id"), "leaf", "subroot", F.lit(root.hex()).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root.hex()).alias("verified"))


def op12_merkle(spark, sf_dir):
    return manifest(common.table(spark, sf_dir, "documents"))


#: Unsigned CRC-32 of the decimal doc_id, bit by bit.
CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda y, k: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)), 4294967295)"""


def _leaf_sql(n_chars: str) -> str:
    fields = [f"coalesce(strlen(({x})::VARCHAR)::VARCHAR || ':' || ({x})::VARCHAR, '-')" for x in ("doc_id", "source", "lang", n_chars, "text")]
    return f"sha256({' || '.join(fields)})"


def _climb_sql(name: str, start: str) -> str:
    """All levels of the trees of ``start`` (lang, i, h): (lang, level, i, n, h)."""
    return f"""{name} AS (
  SELECT lang, 0 AS level, i, (count(*) OVER (PARTITION BY lang))::BIGINT AS n, h FROM {start}
  UNION ALL
  SELECT lang, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY lang, level, i // 2, n)"""


ORACLE = f"""
WITH RECURSIVE leaf AS (
  SELECT doc_id, lang, {_leaf_sql('n_chars')} AS h, CASE WHEN {CRC} % 7 = 0 THEN {_leaf_sql('n_chars::HUGEINT + 1')} ELSE {_leaf_sql('n_chars')} END AS said FROM documents),
node AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM leaf),
{_climb_sql('up', 'node')},
subroot AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i FROM up WHERE n = 1),
single AS (SELECT 1 AS lang, i, h FROM subroot),
{_climb_sql('top', 'single')},
whole AS (SELECT h FROM top WHERE n = 1),
low AS (
  SELECT a.doc_id, a.lang, a.i, up.level, CASE WHEN s.h IS NULL THEN '-' WHEN s.i > up.i THEN 'R' || s.h ELSE 'L' || s.h END AS step
  FROM node a JOIN up ON up.lang IS NOT DISTINCT FROM a.lang AND up.i = a.i >> up.level AND up.n > 1
  LEFT JOIN up s ON s.lang IS NOT DISTINCT FROM up.lang AND s.level = up.level AND s.i = xor(up.i, 1)),
high AS (
  SELECT a.lang, top.level, CASE WHEN s.h IS NULL THEN '-' WHEN s.i > top.i THEN 'R' || s.h ELSE 'L' || s.h END AS step
  FROM subroot a JOIN top ON top.i = a.i >> top.level AND top.n > 1 LEFT JOIN top s ON s.level = top.level AND s.i = xor(top.i, 1)),
paths AS (
  SELECT a.doc_id, a.h, a.said, r.h AS subroot,
    coalesce((SELECT list(step ORDER BY level) FROM low WHERE low.lang IS NOT DISTINCT FROM a.lang AND low.i = a.i), [])
    || coalesce((SELECT list(step ORDER BY level) FROM high WHERE high.lang IS NOT DISTINCT FROM a.lang), []) AS path
  FROM node a JOIN subroot r ON r.lang IS NOT DISTINCT FROM a.lang),
folded AS (
  SELECT *, list_reduce(list_prepend(said, path), lambda x, s: CASE s[1] WHEN 'L' THEN sha256(s[2:] || x) WHEN 'R' THEN sha256(x || s[2:]) ELSE sha256(x) END) AS back FROM paths)
SELECT doc_id, folded.h AS leaf, subroot, whole.h AS root, sha256(coalesce(array_to_string(list_transform(list_filter(path, lambda s: s <> '-'), lambda s: s[2:]), ''), '')) AS proof_sha256,
  back AS folded_root, back = whole.h AS verified
FROM folded, whole
"""
