"""Operator 3: SimHash near-duplicates with BK-trees.

Equal fingerprints are one node. Nodes are dealt to shards by bits that linked fingerprints must share: with 64 bits in
B blocks and at most 3 bits differing, some B - 3 blocks are equal. A shard holds one BK-tree, whose children are keyed by their integer
Hamming distance to the parent; a search follows only edges within the radius. A tree has at most SHARD nodes; where more
share their bits, they make several trees, and each node searches the trees before its own.

The whole corpus's trees have no size bound, so trees aren't broadcast to all tasks: each tree and the nodes that
search it are sent to one task, trees first, and that task keeps one tree at a time. Bits that more than SHARD nodes share are
cut again (see refined_keys()), so that a hot shard becomes many; where nodes still make several trees, each
tree goes to several tasks, among which its searches are dealt. A tree's found links are kept as
a forest: a node links to one node of each component that it touches, so a group of n near copies gives about n
links and not its square.
"""

from __future__ import annotations

from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

BITS, RADIUS, SHINGLE, SEED = 64, 3, 3, 42
#: Nodes of one tree at most.
SHARD = 1 << 15


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """``doc_id, fp, row``: the fingerprint as a signed long. A text without words has zero; a null text has no words."""
    common.small_batches(docs.sparkSession)

    def encode(batches):
        from functools import partial

        import numpy as np
        import xxhash

        hashed = partial(xxhash.xxh64_intdigest, seed=SEED)
        for b in batches:
            fps = []
            for t in b.column(1).to_pylist():
                w = t.encode().lower().split()
                if not w:
                    fps.append(0)
                    continue
                shingles = map(b" ".join, zip(*[w[i:] for i in range(SHINGLE)], strict=False)) if len(w) >= SHINGLE else [b" ".join(w)]
                h = np.fromiter(map(hashed, shingles), dtype="<u8")
                ones = np.zeros(BITS, "i8")
                for at in range(0, len(h), 65536):
                    ones += np.unpackbits(h[at : at + 65536].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="i8")
                fps.append(int(np.packbits(ones * 2 > len(h), bitorder="little").view("<i8")[0]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64()), b.column(2)], ["doc_id", "fp", "row"])

    row = F.col(row_col) if row_col else F.lit(None)
    d = docs.select(F.col(id_col).alias("doc_id"), common.text_of(text_col).alias("text"), row.cast("long").alias("row"))
    return d.mapInArrow(encode, "doc_id long, fp long, row long")


def blocks_for(n: int) -> int:
    """Blocks into which the bits are cut, so that about a hundred of n random fingerprints at most share a shard's bits."""
    return 4 if n < 1 << 22 else 5 if n < 1 << 31 else 6


def shard_masks(blocks: int) -> list[int]:
    """The bits of each choice of blocks - RADIUS blocks."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    return [sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen) for chosen in combinations(range(blocks), blocks - RADIUS)]


def refined_masks(masks: list[int]) -> list[int]:
    """RADIUS + 1 masks for each: its bits, and one part of all others. Fingerprints that share a mask's bits and link also share one part."""
    out = []
    for mask in masks:
        rest = [i for i in range(BITS) if not mask >> i & 1]
        edges = [len(rest) * i // (RADIUS + 1) for i in range(RADIUS + 2)]
        out.extend(mask | sum(1 << i for i in rest[s:e]) for s, e in zip(edges[:-1], edges[1:], strict=True))
    return out


def shard_keys(fp: Column, masks: list[int], at: list[int] | None = None) -> Column:
    """``choice, key`` of a fingerprint's shards: the numbers of masks (those ``at``, or all), and its bits there."""
    signed = lambda m: m - (1 << BITS) if m >> (BITS - 1) else m
    return F.array(*[F.struct(F.lit(k).alias("choice"), fp.bitwiseAND(F.lit(signed(masks[k]))).alias("key")) for k in (range(len(masks)) if at is None else at)])


def refined_keys(keyed: DataFrame, masks: list[int]) -> tuple[DataFrame, list[int]]:
    """The rows ``fp, choice, key`` under finer masks, and these."""
    finer = refined_masks(masks)
    parts = RADIUS + 1
    keys = F.element_at(F.array(*[shard_keys(F.col("fp"), finer, range(k * parts, k * parts + parts)) for k in range(len(masks))]), F.col("choice") + 1)
    return keyed.select("fp", F.explode(keys).alias("k")).select("fp", "k.choice", "k.key"), finer


class BKTree:
    """A BK-tree of at most SHARD integers, and the forest of the links found so far."""

    def __init__(self, radius: int):
        self.radius, self.values, self.children, self.parent, self.parts = radius, [], [], [], 0

    def root(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def search(self, x: int) -> dict[int, int]:
        """Component -> one node of it within the radius of x. It ends when all components are found."""
        values, children, r, got, stack = self.values, self.children, self.radius, {}, [0] if self.values else []
        while stack:
            i = stack.pop()
            d = (values[i] ^ x).bit_count()
            if d <= r:
                got.setdefault(self.root(i), i)
                if len(got) == self.parts:
                    break
            # the nearest edge last, so that it is followed first
            stack.extend(c for _, c in sorted(((abs(e - d), c) for e, c in children[i].items() if -r <= e - d <= r), reverse=True))
        return got

    def join(self, roots: list[int]) -> None:
        for i in roots[1:]:
            self.parent[i] = roots[0]
        self.parts -= max(0, len(roots) - 1)

    def insert(self, x: int) -> list[int]:
        """Adds x; returns the values to which it now links."""
        near = self.search(x)
        new = len(self.values)
        if new:
            i = 0
            while True:
                d = (self.values[i] ^ x).bit_count()
                c = self.children[i].get(d)
                if c is None:
                    self.children[i][d] = new
                    break
                i = c
        self.values.append(x)
        self.children.append({})
        self.parent.append(new)
        self.parts += 1
        self.join([*near, new])
        return [self.values[i] for i in near.values()]

    def touch(self, x: int) -> list[int]:
        """The values to which x, which isn't in the tree, links; their components are one from now on."""
        near = self.search(x)
        self.join([*near])
        return [self.values[i] for i in near.values()]


def shards(nodes: DataFrame, shard: int = SHARD, refinements: int = 2) -> DataFrame:
    """``fp, level, choice, key, n``: each node's shards that hold others too, with their sizes; few have more than ``shard`` nodes."""
    masks = shard_masks(blocks_for(nodes.count()))
    keyed = nodes.select("fp", F.explode(shard_keys(F.col("fp"), masks)).alias("k")).select("fp", "k.choice", "k.key")
    out = None
    for level in range(refinements + 1):
        keyed = common.materialize(keyed)
        sizes = common.materialize(keyed.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
        sized = common.spread_join(keyed, sizes, ["choice", "key"], sizes).withColumn("level", F.lit(level))
        last = level == refinements or sizes.where(F.col("n") > shard).isEmpty()
        fine = sized if last else sized.where(F.col("n") <= shard)
        out = fine if out is None else out.unionByName(fine)
        if last:
            return out.select("fp", "level", "choice", "key", "n")
        keyed, masks = refined_keys(sized.where(F.col("n") > shard), masks)


def to_trees(rows: DataFrame, keys: list[str], node: str, shard: int = SHARD) -> DataFrame:
    """``rows`` (n: how many have the same ``keys``) with ``tree, copy, probe``, dealt to tasks: each tree's own rows first, then those that search it."""
    trees = F.ceil(F.col("n") / shard).cast("int")
    rows = rows.withColumn("own", F.pmod(F.xxhash64(node), trees).cast("int"))
    # a tree's searches are about as many as its nodes times the trees after it: so many tasks get the tree, and each a part of them
    copies = trees - F.col("tree")
    probe = F.col("own") != F.col("tree")
    rows = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), "own")))
    copy = F.when(probe, F.array(F.pmod(F.xxhash64(node, F.lit(1)), copies).cast("int"))).otherwise(F.sequence(F.lit(0), copies - 1))
    rows = rows.withColumn("copy", F.explode(copy)).withColumn("probe", probe).drop("own")
    place = [*keys, "tree", "copy"]
    return rows.repartition(*place).sortWithinPartitions(*place, "probe", node)


def links(nodes: DataFrame, radius: int = RADIUS, shard: int = SHARD, refinements: int = 2) -> DataFrame:
    """``a, b``: links between different fingerprints (column fp) that connect all within the radius. ``nodes`` is read several times."""
    common.small_batches(nodes.sparkSession)
    place = ["level", "choice", "key", "tree", "copy"]
    rows = to_trees(shards(nodes, shard, refinements), place[:3], "fp", shard).select(*place, "probe", "fp")

    def find(batches):
        tree, at = None, None
        for b in batches:
            out_a, out_b = [], []
            *here, probe, fp = (c.to_pylist() for c in b.columns)
            for now, is_probe, x in zip(zip(*here, strict=True), probe, fp, strict=True):
                if now != at:
                    tree, at = BKTree(radius), now
                u = x & 0xFFFFFFFFFFFFFFFF
                for y in tree.touch(u) if is_probe else tree.insert(u):
                    if is_probe or not now[-1]:  # the first copy of a tree tells its own links
                        out_a.append(x)
                        out_b.append(y - (1 << 64) if y >> 63 else y)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return rows.mapInArrow(find, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """``doc_id, fp, row, component_id, group`` for each row: the smallest id that links reach, its own included.

    ``group`` is one fingerprint of the component, and ``row`` what row_col holds. Texts without words (null, empty, white
    space) have fingerprint zero and link like any other. Repeated rows are in one component; null ids count for no
    component's smallest id. Other columns aren't read. An empty table gives an empty result.
    """
    rows = common.materialize(fingerprints(docs, id_col, text_col, row_col))
    nodes = common.materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    roots = components(links(nodes.select("fp")))
    known = roots.join(nodes, roots["node"] == nodes["fp"]).select("fp", "root", "least")
    smallest = known.groupBy("root").agg(F.min("least").alias("component_id"))
    grouped = known.select("fp", "root").join(smallest, "root")
    of_fp = nodes.join(grouped, "fp", "left").select("fp", F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("root", "fp").alias("group"))
    return common.spread_join(rows, common.materialize(of_fp), ["fp"], nodes).select("doc_id", "fp", "row", "component_id", "group")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without near-duplicates: the smallest id of each group stays (a null id only if there is no other)."""
    d = common.with_row(docs)
    rows = near_duplicates(d, id_col, text_col, "__row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    keep = rows.groupBy("group").agg(first.alias("first")).select(F.col("first.row").alias("__row"))
    return d.join(keep, "__row", "left_semi").select(*docs.columns)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_duplicates(common.read(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
