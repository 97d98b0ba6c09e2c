"""Near copies by the similarity of texts: SimHash fingerprints in BK-trees, then the exact Jaccard similarity of word shingle sets.

Texts of one shingle set are one node. As for operator 3, nodes are dealt to shards by keys that similar ones share, a shard holds one BK-tree of
fingerprints, and a tree's links are kept as a forest. At this radius no bits are surely shared, so a shard's key is a band of a MinHash signature: of two sets with
Jaccard similarity 0.8, a band of 5 has equal minima with probability 0.33, and none of 40 bands has with probability 1.3e-7. Fingerprints have 256 bits, of which such
sets differ in 39 with a standard error of 5.7: more than RADIUS with a computed probability of 5e-9. Sets of up to FEW shingles are searched for at any distance.

What a forest joins is a group: every similar pair is inside one, while not all in a group are similar. So each group goes to one task with its shingle sets (as 64-bit hashes), once each,
and only exact similarity links. Where a group is more than a task should hold, it is dealt to blocks, which some of its nodes, the pivots, all visit: they join the blocks of a
family of copies. If a group isn't one family then, the nodes outside its largest family meet all blocks. No row is made for a pair that isn't a link.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, simhash
from .components import components

SHINGLE, LEAST, SEED = 5, 0.8, 42
BANDS, BAND = 40, 5
#: Bits of a fingerprint (words of 64), and those in which two may differ to go on: 5.8 standard errors above what sets of similarity LEAST differ in.
WORDS, RADIUS = 4, 72
#: The estimate doesn't hold for sets of so few shingles.
FEW = 5
#: Nodes outside the components found so far, from which on a search compares them one by one.
REST = 128
#: Shingles that a task holds of a block, and pairs that a task checks, about.
HELD, CHECKED = 1 << 20, 1 << 12
#: Nodes of a block.
MEMBERS = 1 << 10
#: Nodes of a group, about, that visit all its blocks.
PIVOTS = 8
#: Shingles hashed at a time.
STRIDE = 1 << 13


def shingle_hashes(text: str, shingle: int = SHINGLE):
    """The distinct hashes of the text's shingles, ascending; a text of fewer words is one shingle, one without words has none."""
    import numpy as np
    import xxhash

    w = text.encode().lower().split()
    shingles = map(b" ".join, zip(*[w[i:] for i in range(shingle)], strict=False)) if len(w) >= shingle else [b" ".join(w)] if w else []
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, seed=SEED) for s in shingles), dtype="<u8"))


def fingerprint(h) -> bytes:
    """The SimHash of a set of hashes: a bit is 1 if set in over half of them, mixed anew for each word."""
    import numpy as np

    seeds = np.random.default_rng(SEED + 1).integers(0, 2**64, WORDS, dtype="u8")
    ones = np.zeros(64 * WORDS, "i8")
    for at in range(0, len(h), STRIDE):
        z = h[at : at + STRIDE, None] ^ seeds
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        ones += np.unpackbits((z ^ (z >> np.uint64(31))).view("u1"), axis=1).sum(axis=0, dtype="i8")
    return np.packbits(ones * 2 > len(h)).tobytes()


def signatures(docs: DataFrame, id_col: str, text_col: str, row_col: str, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, row, k1, k2, n, bands, fp``: two hashes of the shingle set, its size, a hash of each band's minima, and the fingerprint."""
    common.small_batches(docs.sparkSession)

    def encode(batches):
        import numpy as np
        import xxhash

        rng = np.random.default_rng(SEED)
        add, times = rng.integers(0, 2**64, (BANDS * BAND, 1), dtype="u8"), rng.integers(0, 2**63, (BANDS * BAND, 1), dtype="u8") * np.uint64(2) + np.uint64(1)
        for b in batches:
            k1, k2, n, bands, fp = [], [], [], [], []
            for t in b.column(1).to_pylist():
                h = shingle_hashes(t, shingle)
                least = np.full(BANDS * BAND, 2**64 - 1, "u8")
                for at in range(0, len(h), STRIDE):
                    part = h[at : at + STRIDE]
                    for i in range(0, len(least), BAND):
                        least[i : i + BAND] = np.minimum(least[i : i + BAND], ((part ^ add[i : i + BAND]) * times[i : i + BAND]).min(axis=1))
                data = least.astype("<u8").tobytes()
                fp.append(fingerprint(h))
                k1.append(xxhash.xxh64_intdigest(h.tobytes(), seed=1))
                k2.append(xxhash.xxh64_intdigest(h.tobytes(), seed=2))
                n.append(len(h))
                bands.append([xxhash.xxh64_intdigest(data[i : i + 8 * BAND], seed=i) for i in range(0, len(data), 8 * BAND)])
            signed = lambda x: pa.array(np.array(x, "u8").view("i8"))
            bands = pa.array(list(np.array(bands, "u8").view("i8").reshape(-1, BANDS)), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), signed(k1), signed(k2), pa.array(n, pa.int64()), bands, pa.array(fp, pa.binary())], ["doc_id", "row", "k1", "k2", "n", "bands", "fp"])

    d = docs.select(F.col(id_col).alias("doc_id"), common.text_of(text_col).alias("text"), F.col(row_col).cast("long").alias("row"))
    return d.mapInArrow(encode, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, row long, k1 long, k2 long, n long, bands array<long>, fp binary")


def shingle_sets(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` with ``shingles``, the set of the column text, in its place at the end."""
    common.small_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c != "text"]

    def encode(batches):
        for b in batches:
            sets = [shingle_hashes(t, shingle).view("i8") for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(sets, pa.list_(pa.int64()))], [*rest, "shingles"])

    d = docs.select(common.text_of("text").alias("text"), *rest)
    return d.mapInArrow(encode, ", ".join([f"{c} {d.schema[c].dataType.simpleString()}" for c in rest] + ["shingles array<long>"]))


def similar(pairs: DataFrame, sets: DataFrame, least: float = LEAST, held: int = HELD, checked: int = CHECKED) -> DataFrame:
    """The ``a, b`` of ``pairs`` (written; a <> b) whose sets (node, shingles; written) are similar enough."""
    spark = pairs.sparkSession
    common.small_batches(spark)
    group = common.materialize(components(pairs))  # node, root: pairs of different roots share no text
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("met"))
    sized = group.join(sets.select("node", F.size("shingles").alias("n")), "node").join(ends, "node")
    need = F.greatest(F.sum("n") / held, F.sqrt(F.sum("met") / checked))
    blocks = common.materialize(sized.groupBy("root").agg(F.ceil(need).cast("int").alias("blocks"), F.count(F.lit(1)).alias("n")))
    placed = common.materialize(common.spread_join(group, blocks.drop("n"), ["root"], blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.greatest("blocks", F.lit(1))).cast("int")))
    side = lambda n: placed.select(F.col("node").alias(n), "root", F.col("block").alias(f"{n}_block"))
    met = common.materialize(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")))
    asked = common.materialize(common.spread_join(pairs.select("a", "b"), side("a"), ["a"], met))
    met = common.materialize(asked.groupBy("b").agg(F.count(F.lit(1)).alias("n")))
    asked = common.spread_join(asked, side("b").drop("root"), ["b"], met)
    none, place = F.lit(None).cast("array<bigint>"), ["root", "lo", "hi"]
    asked = asked.select("root", F.least("a_block", "b_block").alias("lo"), F.greatest("a_block", "b_block").alias("hi"), F.lit(True).alias("pair"), "a", "b", none.alias("shingles"))
    told = sets.join(placed, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.greatest("blocks", F.lit(1)) - 1)))
    told = told.select("root", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), F.lit(False).alias("pair"), F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), "shingles")
    rows = told.unionByName(asked).repartition(*place).sortWithinPartitions(*place, "pair")

    def check(batches):
        import numpy as np

        at, known = None, {}
        for batch in batches:
            out_a, out_b = [], []
            root, lo, hi, pair, a, b = (c.to_pylist() for c in batch.columns[:6])
            for i, here in enumerate(zip(root, lo, hi, strict=True)):
                if here != at:
                    at, known = here, {}
                if not pair[i]:
                    known[a[i]] = batch.column(6)[i].values.to_numpy(zero_copy_only=False).copy()
                    continue
                x, y = known[a[i]], known[b[i]]
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both >= least * (len(x) + len(y) - both):
                    out_a.append(a[i])
                    out_b.append(b[i])
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return rows.mapInArrow(check, "a long, b long")


class WideTree(simhash.BKTree):
    """A BK-tree for a radius at which few edges can be left out: once few values are outside the components found, it looks at these alone."""

    def __init__(self, radius: int):
        super().__init__(radius)
        self.members = {}  # of each component

    def search(self, x: int) -> dict[int, int]:
        values, children, r, got, stack, rest = self.values, self.children, self.radius, {}, [0] if self.values else [], len(self.values)
        while stack:
            i = stack.pop()
            d = (values[i] ^ x).bit_count()
            if d <= r and (c := self.root(i)) not in got:
                got[c] = i
                rest -= len(self.members[c])
                if rest <= REST:
                    break
            stack.extend(c for _, c in sorted(((abs(e - d), c) for e, c in children[i].items() if -r <= e - d <= r), reverse=True))
        else:
            return got
        if rest:
            for c, nodes in self.members.items():
                if c not in got and (near := next((i for i in nodes if (values[i] ^ x).bit_count() <= r), None)) is not None:
                    got[c] = near
        return got

    def join(self, roots: list[int]) -> None:
        nodes = {c: self.members.pop(c, [c]) for c in roots}
        roots = sorted(roots, key=lambda c: -len(nodes[c]))
        super().join(roots)
        if roots:
            self.members[roots[0]] = nodes[roots[0]]
            for c in roots[1:]:
                self.members[roots[0]].extend(nodes[c])


def candidates(members: DataFrame, radius: int = RADIUS, shard: int = simhash.SHARD) -> DataFrame:
    """``a, b``: a forest that connects all ``members`` (key, node, n_shingles, fp; n: how many have the key) of one key whose fingerprints are within the radius."""
    common.small_batches(members.sparkSession)
    rows = simhash.to_trees(members, ["key"], "node", shard).select("key", "tree", "copy", "probe", "node", "n_shingles", "fp")

    def find(batches):
        tree, at, known, joined = None, None, {}, {}

        def root(i):
            while (p := joined.setdefault(i, i)) != i:
                joined[i] = i = joined.setdefault(p, p)
            return i

        for b in batches:
            out_a, out_b = [], []
            *here, probe, node, n, fp = (c.to_pylist() for c in b.columns)
            for now, is_probe, x, size, f in zip(zip(*here, strict=True), probe, node, n, fp, strict=True):
                if now != at:
                    tree, at, known = WideTree(radius), now, {}
                    if len(joined) > 1 << 18:
                        joined.clear()
                u = int.from_bytes(f, "big")
                tree.radius = radius if size > FEW else 64 * WORDS
                near = tree.touch(u) if is_probe else [u] if u in known else tree.insert(u)
                if not is_probe:
                    known.setdefault(u, x)
                for y in near if is_probe or not now[-1] else []:  # the first copy of a tree tells its own links
                    y = known[y]
                    if (p := root(x)) != (q := root(y)):  # of all trees of this task one forest
                        joined[p] = q
                        out_a.append(x)
                        out_b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return rows.mapInArrow(find, "a long, b long")


def checked_links(rows: DataFrame, least: float = LEAST, radius: int = RADIUS) -> DataFrame:
    """``a, b``: links between rows of one (root, block, other) and different labels that connect all similar ones.

    ``rows``: node, n, label, fp, text, and ``places``, an array of (root, block, other, asks). Those that ask meet those that don't; if all ask, all meet.
    """
    common.small_batches(rows.sparkSession)
    place = ["root", "block", "other"]
    d = shingle_sets(rows.select("text", "node", "n", "label", "fp", "places")).withColumn("p", F.explode("places"))
    d = d.select(*[f"p.{c}" for c in [*place, "asks"]], "node", "n", "label", "fp", "shingles").repartition(*place).sortWithinPartitions(*place, "node")

    def compare(batches):
        import numpy as np

        def linked(rows):
            asks, node, n, label = (np.array(c) for c in list(zip(*rows, strict=True))[:4])
            fp = np.frombuffer(b"".join(r[4] for r in rows), "u8").reshape(len(rows), -1)
            told = np.flatnonzero(~asks)
            for i in np.flatnonzero(asks):
                j = told if len(told) else np.arange(i + 1, len(rows))
                j = j[(label[j] != label[i]) & (np.minimum(n[j], n[i]) >= least * np.maximum(n[j], n[i]))]
                apart = np.bitwise_count(fp[j] ^ fp[i]).sum(axis=1, dtype="i8")
                apart[np.maximum(n[j], n[i]) <= FEW] = 0
                for k in j[np.argsort(apart, kind="stable")[: (apart <= radius).sum()]]:
                    if label[k] != label[i]:
                        both = len(np.intersect1d(rows[i][5], rows[k][5], assume_unique=True))
                        if both >= least * (n[i] + n[k] - both):
                            label[label == label[k]] = label[i]
                            yield int(node[i]), int(node[k])

        def out(found):
            a, b = zip(*found, strict=True) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        at, rows = None, []
        for batch in batches:
            shingles = batch.column(8)
            for i, (root, block, other, *row) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:8]), strict=True)):
                if (root, block, other) != at:
                    if len(rows) > 1:
                        yield out(list(linked(rows)))
                    at, rows = (root, block, other), []
                rows.append((*row, shingles[i].values.to_numpy(zero_copy_only=False).copy()))
        if len(rows) > 1:
            yield out(list(linked(rows)))

    return d.mapInArrow(compare, "a long, b long")


def groups(members: DataFrame, nodes: DataFrame, texts: DataFrame, least: float = LEAST, held: int = HELD, block: int = MEMBERS) -> DataFrame:
    """``node, root`` of the nodes that links of similar sets reach. ``members`` (key, node; n: how many have the key), ``nodes`` (node, n, fp) and ``texts`` (node, text) are written."""
    roots = components(candidates(members.join(nodes.select("node", F.col("n").alias("n_shingles"), "fp"), "node")))
    placed = common.materialize(roots.join(nodes, "node"))
    need = F.greatest(F.sum("n") / held, F.count(F.lit(1)) / block)
    blocks = common.materialize(placed.groupBy("root").agg(F.ceil(need).cast("int").alias("blocks"), F.count(F.lit(1)).alias("met")))
    several = blocks.where("blocks > 1")
    numbers = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    at = lambda b, o, asks: F.struct("root", b.alias("block"), o.alias("other"), F.lit(asks).alias("asks"))
    own = F.pmod(F.xxhash64("node"), "blocks").cast("int")

    pivot = F.pmod(F.xxhash64("node", F.lit(1)), "met") < PIVOTS
    visits = F.transform(F.when(pivot, numbers("blocks")).otherwise(F.array(own)), lambda b: at(b, F.lit(0), True))
    rows = common.spread_join(placed, blocks, ["root"], blocks, "met").select("node", "n", F.col("node").alias("label"), "fp", visits.alias("places"))
    found = common.materialize(checked_links(texts.join(rows, "node"), least))
    roots = common.materialize(components(found))
    if several.isEmpty():
        return roots

    named = common.spread_join(placed, several, ["root"], blocks, "met").join(roots.withColumnRenamed("root", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = common.materialize(named)
    families = named.groupBy("root", "label").agg(F.count(F.lit(1)).alias("size"))
    families = families.groupBy("root").agg(F.max(F.struct("size", "label")).alias("largest"), F.sum("size").alias("size")).where("size > largest.size")
    out = F.col("size") - F.col("largest.size")
    families = common.materialize(families.select("root", F.col("largest.label").alias("largest"), F.col("size"), out.alias("out")))
    if families.isEmpty():
        return roots
    open_ones = common.spread_join(named, families, ["root"], families, "size")
    open_ones = open_ones.withColumn("out_blocks", F.ceil(F.greatest(F.col("out") / block, F.col("out") * F.col("blocks") / F.col("met"))).cast("int"))
    other = F.pmod(F.xxhash64("node", F.lit(2)), "out_blocks").cast("int")
    asked = F.when(F.col("label") != F.col("largest"), F.transform(numbers("blocks"), lambda b: at(b, other, True))).otherwise(F.array().cast("array<struct<root:bigint,block:int,other:int,asks:boolean>>"))
    rows = open_ones.select("node", "n", "label", "fp", F.concat(F.transform(numbers("out_blocks"), lambda o: at(own, o, False)), asked).alias("places"))
    rest = common.materialize(checked_links(texts.join(rows, "node"), least))
    return components(found.unionByName(rest))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """The rows of ``docs``, all columns, without near copies: the smallest id of each group stays (a null id only if there is no other).

    A group is what links of similar texts reach. Texts without words (null, empty, white space) are one group.
    """
    d = common.with_row(docs)
    rows = common.materialize(signatures(d, id_col, text_col, "__row", shingle))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    nodes = common.materialize(rows.groupBy("k1", "k2").agg(first.alias("first")).select(F.col("first.row").alias("node"), "first"))
    single = common.materialize(rows.where("n > 0").join(nodes.select(F.col("node").alias("row")), "row", "left_semi").select(F.col("row").alias("node"), "n", "fp", "bands"))
    keyed = common.materialize(single.select("node", F.explode("bands").alias("key")))
    met = common.materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    members = common.materialize(common.spread_join(keyed, met, ["key"], met))
    common.discard(docs.sparkSession, keyed, met)
    roots = groups(members, single.drop("bands"), d.select(F.col("__row").alias("node"), F.col(text_col).alias("text")), least)
    grouped = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("group")).agg(F.min("first").alias("first"))
    return d.join(grouped.select(F.col("first.row").alias("__row")), "__row", "left_semi").select(*docs.columns)
