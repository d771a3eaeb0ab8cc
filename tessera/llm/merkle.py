"""Merkle manifest of a dataset, and proofs for its rows, by an associative monoid of sparse forests.

A row's leaf is the digest of its fields. The leaves of a group (a source), in the order of their keys, make a tree of
runs of ARITY nodes; the groups' roots, in the order of the groups, make one more tree. All sizes are known beforehand, so
a run's number of siblings follows from its level and index.

A forest holds the nodes that still wait for siblings, by tree, level and index. Two forests merge by union; where all
siblings of a run are there, their parent takes their place, and the root of a whole tree becomes a leaf of the tree of
groups. A stretch of neighbouring rows leaves only a few nodes at each level, whatever its length.

1. Rows are digested by Spark's own functions and dealt by range into parts of about PART_ROWS rows, equal keys and
   repeated rows included (a row number breaks ties), so that a hot group is spread over many parts.
2. Each part makes a forest of its rows; treeReduce merges those of neighbouring parts into the root.
3. Prefix and suffix scans of the same monoid give each part what lies before and behind it. With that and its own rows a
   part has every sibling on every path of its rows.

Only counts of parts, and the forests of about the square root of all parts, come to the driver.

Null fields have a digest of their own. A null group comes first, as does a null key. Rows with an equal key go by their
leaf; repeated rows get equal leaves at neighbouring places. Empty texts and long ones are digested whole. A lone row is
its own root, with no sibling. Empty tables give an empty result. Extra columns are not read.
"""

from __future__ import annotations

import pickle
from collections import Counter
from functools import reduce
from hashlib import sha256
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import written

ARITY = 3
#: Rows of a part, about.
PART_ROWS = 50_000
#: The tree over the groups; the others are numbered from 0 in the order of their groups.
TOP = -1
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PLACES = "part long, tree long, at long, first_size long, last_size long, trees long"


def digest(*parts: bytes) -> bytes:
    return sha256(b"".join(parts)).hexdigest().encode()


class Forest:
    """Nodes by (tree, level) and index, and the sizes (leaves) of the trees that have nodes, and of the tree of groups."""

    def __init__(self, nodes: dict[tuple[int, int], dict[int, bytes]], sizes: dict[int, int]):
        self.nodes, self.sizes = nodes, sizes

    def grown(self, keep: bool = False) -> Forest:
        """Whole runs become their parents, from the leaves up; ``keep`` leaves the children there too."""
        for tree in sorted({t for t, _ in self.nodes if t != TOP}):
            self.grow(tree, keep)
            root = self.nodes.get((tree, self.height(tree)), {})
            if 0 in root:
                self.nodes.setdefault((TOP, 0), {})[tree] = root[0] if keep else root.pop(0)
        self.grow(TOP, keep)
        if not keep:
            self.nodes = {k: n for k, n in self.nodes.items() if n}
            left = {t for t, _ in self.nodes} | {TOP}
            self.sizes = {t: n for t, n in self.sizes.items() if t in left}
        return self

    def height(self, tree: int) -> int:
        size, level = self.sizes[tree], 0
        while size > 1:
            size, level = -(-size // ARITY), level + 1
        return level

    def grow(self, tree: int, keep: bool) -> None:
        size, level = self.sizes[tree], 0
        while size > 1:
            here = self.nodes.get((tree, level))
            if here:
                parents = {}
                for run, n in Counter(i // ARITY for i in here).items():
                    if n == min(ARITY, size - ARITY * run):
                        members = range(ARITY * run, ARITY * run + n)
                        parents[run] = digest(*[here[i] if keep else here.pop(i) for i in members])
                if parents:
                    self.nodes.setdefault((tree, level + 1), {}).update(parents)
            size, level = -(-size // ARITY), level + 1

    def merged(self, other: Forest, keep: bool = False) -> Forest:
        nodes = {k: dict(n) for k, n in self.nodes.items()}
        for k, n in other.nodes.items():
            nodes.setdefault(k, {}).update(n)
        return Forest(nodes, self.sizes | other.sizes).grown(keep)

    def root(self) -> bytes:
        return self.nodes[TOP, self.height(TOP)][0]

    def packed(self) -> bytes:
        return pickle.dumps((self.nodes, self.sizes))

    @staticmethod
    def of(packed: bytes) -> Forest:
        return Forest(*pickle.loads(packed))


class Paths:
    """Siblings on the way from leaves to the root of a forest that was grown with ``keep``."""

    def __init__(self, forest: Forest):
        self.forest, self.known = forest, {}

    def of(self, tree: int, index: int, level: int = 0, size: int | None = None) -> tuple[tuple[bytes, bytes], ...]:
        """(what stands before the node, what stands behind it) in each run, from the leaf up."""
        size = self.forest.sizes[tree] if size is None else size
        if size == 1:
            return () if tree == TOP else self.of(TOP, tree)
        if (at := (tree, level, index)) not in self.known:
            here, run = self.forest.nodes[tree, level], index // ARITY
            before = b"".join(here[i] for i in range(ARITY * run, index))
            behind = b"".join(here[i] for i in range(index + 1, min(ARITY * run + ARITY, size)))
            self.known[at] = ((before, behind), *self.of(tree, run, level + 1, -(-size // ARITY)))
        return self.known[at]


def folded(leaf: bytes, path: tuple[tuple[bytes, bytes], ...]) -> bytes:
    """The root that follows from a leaf and its siblings."""
    return reduce(lambda node, siblings: digest(siblings[0], node, siblings[1]), path, leaf)


# Leaves.


def encoded(c: Column) -> Column:
    value = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(c) for c in fields]).cast("binary"), 256)


def leaves(df: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", group: str = "source", tampered: dict[str, Column] | None = None) -> DataFrame:
    """key, has_group, group, leaf, other (the leaf with the columns of ``tampered`` instead; null where that is null) and nth."""
    own = {c: F.col(f"`{c}`") for c in fields}
    # A field that is tampered with by a null keeps its value.
    other = leaf([F.coalesce((tampered or {}).get(c, F.lit(None).cast("string")), x.cast("string")) for c, x in own.items()])
    changed = reduce(lambda a, b: a | b, [c.isNotNull() for c in (tampered or {}).values()], F.lit(False))
    return df.select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{group}`").isNotNull().alias("has_group"), F.col(f"`{group}`").cast("string").alias("group"),
        leaf(list(own.values())).alias("leaf"), F.when(changed, other).alias("other"), F.monotonically_increasing_id().alias("nth"),
    )


# Places: a row's tree and index follow from its part's first tree and index and its order within the part.


def places(parts: list) -> list[tuple[int, int, int, int, int, int]]:
    """Rows of PLACES from those of ``counted``, in the order of parts: numbers alone, a row for each part."""
    made, sizes, tree, at, last = [], Counter(), -1, 0, None
    for p in parts:
        tree, at = (tree, at) if p["first"] == last else (tree + 1, 0)
        end = tree + p["groups"] - 1
        made.append((p["part"], tree, at, end))
        sizes[tree] += p["n_first"]
        if end > tree:
            sizes[end] += p["n_last"]
        at, tree, last = at + p["n_first"] if end == tree else p["n_last"], end, p["last"]
    return [(part, first, at, sizes[first], sizes[end], tree + 1) for part, first, at, end in made]


def counted(dealt: DataFrame) -> DataFrame:
    """For each part: its number of groups, and digests and rows of its first and last one."""
    segments = dealt.groupBy("part", "has_group", "group").agg(F.count("*").alias("n"))
    edge = F.struct("has_group", "group", "n")
    ends = segments.groupBy("part").agg(F.min(edge).alias("a"), F.max(edge).alias("z"), F.count("*").alias("groups"))
    name = lambda e: F.sha2(F.concat(F.col(f"{e}.has_group").cast("string"), F.coalesce(F.col(f"{e}.group").cast("string"), F.lit(""))), 256)
    return ends.select("part", "groups", name("a").alias("first"), name("z").alias("last"), F.col("a.n").alias("n_first"), F.col("z.n").alias("n_last"))


def in_order(rows: pa.Table) -> list[tuple]:
    """(has_group, group, has_key, key, leaf, other) of a part's rows, sorted."""
    columns = [rows.column(c).to_pylist() for c in ("group", "key", "leaf", "other")]
    own = [(g is not None, "" if g is None else g, k is not None, 0 if k is None else k, leaf, other or "") for g, k, leaf, other in zip(*columns, strict=True)]
    return sorted(own)


def own_forest(rows: list[tuple], place: dict) -> tuple[Forest, list[tuple[int, int]]]:
    """The leaves of a part's sorted rows as a forest that hasn't grown, and each row's tree and index."""
    nodes, at, tree, index, group = {}, [], place["tree"], place["at"], None
    for r in rows:
        if group is not None and r[:2] != group:
            tree, index = tree + 1, 0
        group = r[:2]
        nodes.setdefault((tree, 0), {})[index] = r[4].encode()
        at.append((tree, index))
        index += 1
    # Trees that are neither the first nor the last of the part lie within it as a whole.
    sizes = {t: len(n) for (t, _), n in nodes.items()} | {tree: place["last_size"], place["tree"]: place["first_size"], TOP: place["trees"]}
    return Forest(nodes, sizes), at


def fragments(dealt: DataFrame, info: DataFrame) -> DataFrame:
    """part and forest: what is left of each part's rows once whole runs have become their parents."""

    def run(rows: pa.Table, place: pa.Table) -> pa.Table:
        forest, _ = own_forest(in_order(rows), place.to_pylist()[0])
        return pa.table({"part": place.column("part"), "forest": pa.array([forest.grown().packed()], pa.binary())})

    return dealt.groupBy("part").cogroup(info.groupBy("part")).applyInArrow(run, "part long, forest binary")


def merged(packed: list[bytes]) -> bytes:
    return reduce(Forest.merged, map(Forest.of, packed)).packed()


def running(packed: list[bytes], start: bytes | None) -> list[bytes | None]:
    """For each forest all before it, ``start`` included."""
    found = [start]
    for p in packed[:-1]:
        found.append(p if found[-1] is None else merged([found[-1], p]))
    return found


def around(packed: list[bytes], before: bytes | None = None, behind: bytes | None = None) -> list[tuple[bytes | None, bytes | None]]:
    """Exclusive prefix and suffix scans."""
    return list(zip(running(packed, before), running(packed[::-1], behind)[::-1], strict=True))


def scanned(made: DataFrame, totals: list) -> DataFrame:
    """part, before and behind: forests of all parts before and behind it; ``totals`` has the forests of stretches of parts."""
    spark, names = made.sparkSession, [t["stretch"] for t in totals]
    outer = spark.createDataFrame([(n, b, e) for n, (b, e) in zip(names, around([t["forest"] for t in totals]), strict=True)], "stretch long, before binary, behind binary")

    def run(own: pa.Table, given: pa.Table) -> pa.Table:
        own, given = own.sort_by("part"), given.to_pylist()[0]
        pairs = around(own.column("forest").to_pylist(), given["before"], given["behind"])
        return pa.table({"part": own.column("part"), "before": pa.array([p[0] for p in pairs], pa.binary()), "behind": pa.array([p[1] for p in pairs], pa.binary())})

    return made.groupBy("stretch").cogroup(outer.groupBy("stretch")).applyInArrow(run, "part long, before binary, behind binary")


SIBLINGS = T.ArrayType(T.StructType([T.StructField("before", T.StringType()), T.StructField("behind", T.StringType())]))


def manifest(df: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", group: str = "source", tampered: dict[str, Column] | None = None, siblings: bool = False) -> DataFrame:
    """key, group, tree, place, leaf, subroot, root, proof_sha256, folded_root and verified of each row.

    ``folded_root`` follows from ``other`` (the leaf with the columns of ``tampered``, where these aren't null) or else from
    the leaf, and the siblings. ``siblings`` adds those, concatenated by side, from the leaf up.
    """
    spark, kind = df.sparkSession, df.schema[key].dataType
    rows = written(leaves(df, fields, key, group, tampered))
    n = rows.count()
    out = T.StructType([
        T.StructField("key", kind), T.StructField("group", T.StringType()), T.StructField("tree", T.LongType()), T.StructField("place", T.LongType()),
        *[T.StructField(c, T.StringType()) for c in ("leaf", "subroot", "proof_sha256", "folded_root")], T.StructField("siblings", SIBLINGS),
    ])
    if not n:
        return finished(spark.createDataFrame([], out), "", siblings)
    parts = max(-(-n // PART_ROWS), min(spark.sparkContext.defaultParallelism, -(-n // 1000)))
    dealt = written(rows.repartitionByRange(parts, "has_group", "group", "key", "leaf", "nth").drop("nth").withColumn("part", F.spark_partition_id().cast("long")))
    info = spark.createDataFrame(places(sorted(counted(dealt).collect(), key=lambda r: r["part"])), PLACES)
    stretch = (F.col("part") / F.lit(isqrt(parts) + 1)).cast("long").alias("stretch")
    made = written(fragments(dealt, info).withColumn("stretch", stretch))
    neighbours = made.repartitionByRange(isqrt(parts) + 1, "stretch").sortWithinPartitions("part").select("forest")
    root = Forest.of(neighbours.rdd.map(lambda r: bytes(r[0])).treeReduce(lambda a, b: merged([a, b]))).root().decode()
    totals = made.groupBy("stretch").applyInArrow(lambda t: pa.table({"stretch": t.column("stretch")[:1], "forest": pa.array([merged(t.sort_by("part").column("forest").to_pylist())], pa.binary())}), "stretch long, forest binary")
    sides = scanned(made, sorted(totals.collect(), key=lambda r: r["stretch"]))

    def prove(own: pa.Table, place: pa.Table) -> pa.Table:
        place, ordered = place.to_pylist()[0], in_order(own)
        forest, at = own_forest(ordered, place)
        for side in ("before", "behind"):
            if place[side] is not None:
                other = Forest.of(place[side])
                for k, nodes in other.nodes.items():
                    forest.nodes.setdefault(k, {}).update(nodes)
                forest.sizes |= other.sizes
        paths = Paths(forest.grown(keep=True))
        subroots, made = forest.nodes[TOP, 0], []
        for r, (tree, index) in zip(ordered, at, strict=True):
            path = paths.of(tree, index)
            proof = sha256(b"".join(x for pair in path for x in pair)).hexdigest()
            kept = [{"before": a.decode(), "behind": b.decode()} for a, b in path] if siblings else None
            made.append((r[3] if r[2] else None, r[1] if r[0] else None, tree, index, r[4], subroots[tree].decode(), proof, folded((r[5] or r[4]).encode(), path).decode(), kept))
        types = [own.schema.field("key").type, pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 4, pa.list_(pa.struct([("before", pa.string()), ("behind", pa.string())]))]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)], names=out.fieldNames())

    proved = dealt.groupBy("part").cogroup(info.join(sides, "part").groupBy("part")).applyInArrow(prove, out)
    return finished(proved, root, siblings)


def finished(proved: DataFrame, root: str, siblings: bool) -> DataFrame:
    found = proved.withColumns({"root": F.lit(root), "verified": F.col("folded_root") == F.lit(root)})
    return found if siblings else found.drop("siblings")


def tamper_lines(key: str = "doc_id", text: str = "text") -> dict[str, Column]:
    """Line feeds are deleted from the texts of rows whose key has an even CRC."""
    even = F.crc32(F.col(key).cast("string").cast("binary")) % 2 == 0
    return {text: F.when(even, F.translate(text, "\n", ""))}


def check_documents(df: DataFrame) -> DataFrame:
    """The columns of op11."""
    found = manifest(df, tampered=tamper_lines()).withColumnRenamed("key", "doc_id")
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
