"""Operator 4: exact substring removal by a difference cover and blockwise sorting.

Only equality over ``length`` bytes matters, so suffixes are compared to that depth and a rank is a class of equal strings.

1. A difference cover D of period V picks about 6 % of all positions: for any two positions i and j some shift below V
   takes both to picked ones. So two equal strings of ``length`` bytes have picked positions, at one shift, that begin equal
   strings of ``length`` - V + 1 bytes. Picked positions are dealt to buckets by these strings' hashes, and a task sorts one
   bucket at a time; classes of two or more are the cover's ranks that matter.
2. Only a suffix that begins up to V - 1 bytes before such a class's member can tie over the whole length. These suffixes
   are looked at in blocks of up to STEP neighbours, from the picked position backwards. The bytes that all strings of a block have in common must recur
   for any of them to recur; if the bytes that any of them has recur, all do. So blocks are sorted by their common bytes, and
   those that tie by all their bytes: two or more of these are settled, and one of each kind goes on where a tie has several.
3. What goes on, some edges of repeats, is dealt to buckets by a 128-bit hash of all ``length`` bytes, suffix for suffix, and sorted
   one bucket at a time. Ties there are repeated strings.
4. Each text with repeats gets the union of its repeated strings. Copies of one text count as one text in 1 to 3,
   and lose all their bytes.

A passage of over 50 words is often shorter than ``length``, so it can repeat across documents and lose nothing. find_passages() reports
such passages by the same method over words: a difference cover of the word positions, classes of the strings that begin there, and
the windows of PASSAGE words around classes that several texts have.

Buckets travel as packed arrays, a row for each bucket and flush. Before that, a map task settles what it can: of equal
strings within a flush one goes on, so a string that a third of all texts have adds a row for each flush and not for each text.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LENGTH = 400
#: A perfect difference set (fixed values): each difference but 0 modulo V occurs once.
V = 273
COVER = (1, 2, 4, 8, 16, 32, 64, 91, 117, 128, 137, 182, 195, 205, 234, 239, 256)
#: Positions that a map task holds before it sends them, and bytes of text for each bucket.
FLUSH, BUCKET_BYTES, LEAST_BUCKETS = 1 << 19, 4 << 20, 64
#: Picked positions hashed at a time, and bytes of the texts that are handled together.
PART, SLICE = 1 << 17, 2 << 20
#: Bytes hashed at a time, so that one very long text needs no more memory than this.
STRIDE = 1 << 17
PACKED = "bucket int, settled boolean, h binary, g binary, f binary, doc binary, pos binary, known binary"
#: Suffixes of a block.
STEP = 32
#: Words of a passage, and a perfect difference set (fixed values) for their positions.
PASSAGE, WORD_V = 51, 31
WORD_COVER = (1, 5, 11, 24, 25, 27)
#: Up to so many keys (16 MB) tell by a broadcast which texts have members of classes; beyond, by a join.
BROADCAST_KEYS = 1 << 21


class Hasher:
    """Hashes of strings at given places of a text, as 64-bit polynomial sums; ``seed`` gives an independent one."""

    def __init__(self, seed: int, reach: int):
        import numpy as np

        rng = np.random.default_rng(seed)
        self.table, self.reach = rng.integers(0, 2**64, 256, dtype="u8"), reach
        m = int(rng.integers(0, 2**62)) * 8 + 5
        self.up, self.down = self._powers(m, STRIDE + reach), self._powers(pow(m, -1, 2**64), STRIDE + reach)

    @staticmethod
    def _powers(m: int, n: int):
        import numpy as np

        p = np.full(n, m % 2**64, "u8")
        p[0] = 1
        return np.cumprod(p, dtype="u8")

    def at(self, b, starts, size: int):
        """The hash of the ``size`` items at each of the ascending ``starts`` of b, bytes or 64-bit numbers; ``size`` is at most ``reach``."""
        import numpy as np

        out = np.zeros(len(starts), "u8")
        edges = np.searchsorted(starts, np.arange(0, len(b) + STRIDE, STRIDE))
        for k, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if i < j:
                x = b[k * STRIDE : (k + 1) * STRIDE + size]
                x = self.table[x] if x.dtype == "u1" else x
                sums = np.concatenate((np.zeros(1, "u8"), np.cumsum(x * self.up[: len(x)], dtype="u8")))
                p = starts[i:j] - k * STRIDE
                out[i:j] = (sums[p + size] - sums[p]) * self.down[p]
        return out


class WordHasher:
    """A hash of each word of a text: a polynomial of its bytes, mixed. White space of any kind and length only separates words."""

    def __init__(self, seed: int):
        import numpy as np

        rng = np.random.default_rng(seed)
        self.table = rng.integers(0, 2**64, 256, dtype="u8")
        self.space = np.zeros(256, bool)
        self.space[[ord(c) for c in common.SPACE_CHARS]] = True
        self.table[self.space] = 0
        m = int(rng.integers(0, 2**62)) * 8 + 5
        self.low, self.high = Hasher._powers(m, STRIDE), Hasher._powers(pow(m, STRIDE, 2**64), STRIDE)

    def __call__(self, b, at):
        """The hashes of the words of b, texts one after the other that begin at ``at[:-1]``; and the first word of each text, and their number."""
        import numpy as np

        word = ~self.space[b]
        first = word.copy()
        first[1:] &= ~word[:-1]
        begin = at[:-1][at[:-1] < len(b)]
        first[begin] = word[begin]
        starts = np.flatnonzero(first)
        out = np.zeros(len(starts), "u8")
        edges = np.searchsorted(starts, np.arange(0, len(b) + STRIDE, STRIDE))
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            if i < j:
                s, e = starts[i], starts[j] if j < len(starts) else len(b)
                begin = starts[i:j] - s
                sizes = np.diff(np.append(begin, e - s))
                k = np.arange(e - s) - np.repeat(begin, sizes)
                if sizes.max() <= STRIDE:
                    x = self.table[b[s:e]] * self.low[k]
                else:
                    x = self.table[b[s:e]] * self.low[k % STRIDE] * self.high[k // STRIDE]
                out[i:j] = np.add.reduceat(x, begin)
        return mixed(out), np.searchsorted(starts, at)


class Sender:
    """Gathers (hash, second hash, kind, document, position), settles repeats among them, and packs the rest by bucket."""

    def __init__(self, buckets: int, task: int, across: bool = False):
        self.buckets, self.task, self.across, self.rows, self.n = buckets, task, across, [], 0

    def add(self, h, g, f, doc, pos) -> None:
        if len(h):
            self.rows.append((h, g, f, doc.astype("i8"), pos.astype("i8")))
            self.n += len(h)

    def flush(self) -> list[tuple]:
        import numpy as np

        if not self.n:
            return []
        h, g, f, doc, pos = (np.concatenate(c) for c in zip(*self.rows, strict=True))
        self.rows, self.n = [], 0
        first, many, every = classes(h, g, f, doc, pos, self.across)
        out = []
        if len(every):
            self.task += 1
            out.append((self.task % self.buckets, True, b"", b"", b"", doc[every].tobytes(), pos[every].tobytes(), b""))
        h, g, f, doc, pos = h[first], g[first], f[first], doc[first], pos[first]
        bucket = ((h >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)).astype("i4")
        order = np.argsort(bucket, kind="stable")
        columns, bucket = [c[order] for c in (h, g, f, doc, pos, many)], bucket[order]
        which, start = np.unique(bucket, return_index=True)
        for k, s, e in zip(which.tolist(), start, [*start[1:], len(bucket)], strict=True):
            out.append((k, False, *[c[s:e].tobytes() for c in columns]))
        return out


def classes(h, g, f, doc, pos, across: bool = False):
    """Of equal (h, g, f): the index of one member each, whether others differ from it in (doc, pos), and all members of those that do.

    With ``across`` only other documents count; of a class that one document has alone, all members go on and not one.
    """
    import numpy as np

    order = np.argsort(h, kind="stable")
    s = h[order]
    near = np.zeros(len(s) + 1, bool)
    near[1:-1] = s[1:] == s[:-1]
    tied = order[near[1:] | near[:-1]]  # the rows whose h isn't alone
    alone = np.ones(len(h), bool)
    alone[tied] = False
    tied = tied[np.lexsort((pos[tied], doc[tied], f[tied], g[tied], h[tied]))]
    equal = lambda c: c[tied][1:] == c[tied][:-1]
    same = equal(h) & equal(g) & equal(f)
    some = min(1, len(tied))
    new_class = np.concatenate((np.ones(some, bool), ~same))
    again = np.concatenate((np.zeros(some, bool), same & equal(doc) & equal(pos)))
    k = np.cumsum(new_class) - 1
    counted = new_class | np.concatenate((np.zeros(some, bool), ~equal(doc))) if across else ~again
    size = np.bincount(k[counted], minlength=int(k[-1]) + 1 if some else 0)
    heads = new_class | (~again & (size[k] == 1)) if across and some else new_class
    first = np.concatenate((np.nonzero(alone)[0], tied[heads]))
    many = np.concatenate((np.zeros(int(alone.sum()), bool), size[k[heads]] > 1))
    order = np.argsort(first, kind="stable")
    return first[order], many[order], tied[~again & (size[k] > 1)] if some else tied


def repeated(rows: DataFrame, produce, buckets: int, across: bool = False) -> DataFrame:
    """``doc, pos, check`` (some twice): members of ties in (h, g, f) at different places, and, with ``check``, one of each f of a tie in (h, g) with several.

    produce() turns a batch into calls of Sender.add(). With ``across``, places differ only if their documents do.
    """

    def send(batches):
        from pyspark import TaskContext

        sender, work = Sender(buckets, TaskContext.get().partitionId(), across), produce()

        def packed(out):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.bool_(), *[pa.binary()] * 6), strict=True)], names)

        for b in batches:
            for part in slices(b):
                for _ in work(part, sender):
                    if sender.n >= FLUSH:
                        yield packed(sender.flush())
        if out := sender.flush():
            yield packed(out)

    names = [x.split()[0] for x in PACKED.split(", ")]
    sent = rows.mapInArrow(send, PACKED).repartition(buckets, "bucket").sortWithinPartitions("bucket")

    def settle(batches):
        import numpy as np

        def found(doc, pos, check):
            return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(pos), pa.array(np.full(len(doc), check))], ["doc", "pos", "check"])

        def one(held):
            h, g, f, doc, pos, known = (np.frombuffer(b"".join(c), t) for c, t in zip(zip(*held, strict=True), ("u8", "u8", "u8", "i8", "i8", "?"), strict=True))
            first, _, every = classes(h, g, f, doc, pos, across)
            # a task has settled what it knows to have an equal
            yield found(doc[every[~known[every]]], pos[every[~known[every]]], False)
            first = first[np.lexsort((f[first], g[first], h[first]))]
            same = (h[first][1:] == h[first][:-1]) & (g[first][1:] == g[first][:-1])
            several = np.zeros(len(first), bool)
            several[1:] |= same
            several[:-1] |= same
            yield found(doc[first[several]], pos[first[several]], True)

        held, at = [], None
        for b in batches:
            for bucket, settled, *columns in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if bucket != at and held:
                    yield from one(held)
                    held = []
                at = bucket
                if settled:
                    yield found(np.frombuffer(columns[3], "i8"), np.frombuffer(columns[4], "i8"), False)
                else:
                    held.append(columns)
        if held:
            yield from one(held)

    return sent.mapInArrow(settle, "doc long, pos long, check boolean")


def flat(texts):
    """The bytes of an Arrow column of texts without nulls, one after the other, and where each begins and the last ends."""
    import numpy as np

    kind = "i8" if pa.types.is_large_string(texts.type) else "i4"
    _, offsets, data = texts.buffers()
    if offsets is None or not len(texts):
        return np.zeros(0, "u1"), np.zeros(len(texts) + 1, "i8")
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype("i8")
    b = np.frombuffer(data, "u1") if data else np.zeros(0, "u1")
    return b[at[0] : at[-1]], at - at[0]


def slices(batch, texts: int = 1):
    """Parts of a batch whose texts have about SLICE bytes, or one text that has more."""
    import numpy as np

    _, at = flat(batch.column(texts))
    start = 0
    while start < len(at) - 1:
        end = max(start + 1, int(np.searchsorted(at, at[start] + SLICE, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def flat_lists(lists):
    """The numbers of an Arrow column of lists without nulls, and the row of each."""
    import numpy as np

    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy(zero_copy_only=False).astype("i8"), np.repeat(np.arange(len(lists)), sizes)


def _picked(n, period: int, cover, size: int):
    """(text, place), in parts: the picked places of texts of ``n`` items each that begin ``size`` items."""
    import numpy as np

    grid = (np.arange(0, int(n.max(initial=0)) + 1, period)[:, None] + np.array(cover)).ravel()
    count = np.searchsorted(grid, n - size, "right")
    end = np.cumsum(count)
    for s in range(0, int(end[-1]) if len(end) else 0, PART):
        k = np.arange(s, min(s + PART, end[-1]))
        text = np.searchsorted(end, k, "right")
        yield text, grid[k - (end - count)[text]]


def _cover_positions(length: int):
    """For a batch with columns key and text: the picked positions, and hashes of the bytes that a shift leaves."""

    def produce():
        import numpy as np

        size = length - V + 1
        hasher = Hasher(1, size)

        def work(batch, sender):
            keys, (b, at) = batch.column(0).to_numpy(), flat(batch.column(1))
            for text, p in _picked(np.diff(at), V, COVER, size):
                zero = np.zeros(len(p), "u8")
                sender.add(hasher.at(b, at[text] + p, size), zero, zero, keys[text], p)
                yield

        return work

    return produce


def block_kinds(length: int) -> list[tuple[int, int]]:
    """Kinds of blocks, as (shift of its last suffix from the picked position, suffixes); all but the last have STEP."""
    return [(d, min(STEP, V - d)) for d in range(0, V, STEP)]


def mixed(x):
    """A bijection of 64-bit numbers that spreads every bit over all."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def own_kinds(uid, last):
    """A kind for each block of text ``uid`` (one, or one a block): all bits of uid and of the block's last suffix count, at any number of partitions."""
    import numpy as np

    return mixed(mixed(np.broadcast_to(np.asarray(uid), len(last)).astype("u8")) + last.astype("u8"))


def _blocks(length: int):
    """For a batch with columns uid, text and at: blocks of suffixes by the hashes of their common bytes (h, g) and of all their bytes (f).

    A block is named by its last suffix, twice, plus its width's place among the widths. Blocks that hold any suffix of the text count.
    """

    def produce():
        import numpy as np

        one, two, three = (Hasher(k, length + STEP) for k in (2, 3, 4))
        widths = sorted({w for _, w in block_kinds(length)}, reverse=True)

        def work(batch, sender):
            uid, (b, begin) = batch.column(0).to_numpy(), flat(batch.column(1))
            at, text = flat_lists(batch.column(2))
            n = np.diff(begin)
            for kind, width in enumerate(widths):
                shifts = np.array([d for d, w in block_kinds(length) if w == width])
                last, of = (at[:, None] - shifts).ravel(), np.repeat(text, len(shifts))
                fits = (last >= 0) & (last - width + 1 < n[of] - length + 1)
                place, first = np.unique(last[fits] + begin[of[fits]], return_index=True)
                last, of = last[fits][first], of[fits][first]
                size, most, start = length - width + 1, length + width - 1, last - width + 1
                whole = (start >= 0) & (start + most <= n[of])
                # blocks that reach over an end of the text are of no kind but their own
                f = own_kinds(uid[of], last)
                f[whole] = three.at(b, place[whole] - width + 1, most)
                sender.add(one.at(b, place, size), two.at(b, place, size), f, uid[of], last * 2 + kind)
                yield

        return work

    return produce


def suffixes_of(blocks, length: int):
    """The suffixes of blocks, as repeated() names them (twice the last suffix, plus the kind); some before the text's start."""
    import numpy as np

    blocks = np.unique(np.asarray(blocks, "i8"))
    widths = sorted({w for _, w in block_kinds(length)}, reverse=True)
    parts = [(blocks[blocks % 2 == k] // 2)[:, None] - np.arange(w) for k, w in enumerate(widths)]
    return np.unique(np.concatenate([p.ravel() for p in parts]))


def _suffixes(length: int):
    """For a batch with columns uid, text and edges (blocks that go on): their suffixes, by two hashes."""

    def produce():
        import numpy as np

        one, two = Hasher(5, length), Hasher(6, length)
        widths = sorted({w for _, w in block_kinds(length)}, reverse=True)

        def work(batch, sender):
            uid, (b, begin) = batch.column(0).to_numpy(), flat(batch.column(1))
            edges, text = flat_lists(batch.column(2))
            p = [((edges[edges % 2 == k] // 2)[:, None] - np.arange(w)).ravel() for k, w in enumerate(widths)]
            p, of = np.concatenate(p), np.concatenate([np.repeat(text[edges % 2 == k], w) for k, w in enumerate(widths)])
            fits = (p >= 0) & (p <= np.diff(begin)[of] - length)
            place, first = np.unique(p[fits] + begin[of[fits]], return_index=True)
            p, of = p[fits][first], of[fits][first]
            for s in range(0, len(p), PART):
                k = slice(s, s + PART)
                sender.add(one.at(b, place[k], length), two.at(b, place[k], length), np.zeros(len(p[k]), "u8"), uid[of[k]], p[k])
                yield

        return work

    return produce


def find_repeats(docs: DataFrame, text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``k1, k2, text, blocks, starts``: each text (once, by its keys) that has repeated strings, and where these begin.

    They begin at each suffix of ``blocks`` (see suffixes_of()), and at ``starts``. Null and empty texts, and texts under ``length``, have none;
    repeated rows are one text, whose copies don't count here; ids and other columns aren't read; an empty table gives an empty result.
    """
    if length < V + 32:
        raise ValueError(f"length must be {V + 32} at least")
    spark = docs.sparkSession
    common.small_batches(spark)
    text = common.text_of(text_col)
    long = docs.select(F.xxhash64(text).alias("k1"), F.xxhash64(text, F.lit(1)).alias("k2"), text.alias("text")).where(F.octet_length("text") >= length)
    total = long.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    buckets = max(LEAST_BUCKETS, -(-total // BUCKET_BYTES))
    picked = repeated(long.select("k1", "text"), _cover_positions(length), buckets)
    picked = common.materialize(picked.groupBy(F.col("doc").alias("k1")).agg(F.collect_set("pos").alias("at")))  # positions of one text
    keys = picked.select("k1")
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
    some = long.join(keys, "k1", "left_semi").dropDuplicates(["k1", "k2"])
    some = common.materialize(some.join(picked, "k1").withColumn("uid", F.monotonically_increasing_id()))
    common.discard(spark, picked)
    blocks = common.materialize(repeated(some.select("uid", "text", "at"), _blocks(length), buckets))
    # the blocks of one text
    of_text = blocks.groupBy(F.col("doc").alias("uid")).agg(F.collect_list(F.when(F.col("check"), F.col("pos"))).alias("edges"), F.collect_list(F.when(~F.col("check"), F.col("pos"))).alias("blocks"))
    of_text = common.materialize(of_text)
    common.discard(spark, blocks)
    edges = of_text.where(F.size("edges") > 0).select("uid", "edges")
    tied = common.materialize(repeated(some.select("uid", "text").join(edges, "uid").select("uid", "text", "edges"), _suffixes(length), buckets))
    starts = tied.groupBy(F.col("doc").alias("uid")).agg(F.collect_list("pos").alias("starts"))
    none = F.array().cast("array<bigint>")
    found = of_text.select("uid", "blocks").join(starts, "uid", "left").withColumn("starts", F.coalesce("starts", none))
    return some.select("uid", "k1", "k2", "text").join(found.where((F.size("blocks") > 0) | (F.size("starts") > 0)), "uid").drop("uid")


def cut(repeats: DataFrame, length: int = LENGTH) -> DataFrame:
    """``k1, k2, n_removed, n_spans, spans, kept_sha256`` and ``kept``, the bytes that remain, for the rows of find_repeats().

    A row none of whose places lies in its text gives no row. A very long text is cut in one piece; no rows give none.
    """

    def run(batches):
        import numpy as np

        for b in batches:
            out = []
            for k1, k2, text, blocks, starts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data = text.encode()
                p = np.union1d(suffixes_of(blocks, length), np.asarray(starts, "i8"))
                p = p[(p >= 0) & (p <= len(data) - length)]
                if not len(p):
                    continue
                gap = np.nonzero(p[1:] > p[:-1] + length)[0]
                begin, end = p[np.concatenate(([0], gap + 1))], p[np.concatenate((gap, [len(p) - 1]))] + length
                kept = b"".join(data[s:e] for s, e in zip([0, *end], [*begin, len(data)], strict=True))
                out.append((k1, k2, int((end - begin).sum()), len(begin), [{"start": int(s), "end": int(e)} for s, e in zip(begin, end, strict=True)], hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            types = [pa.int64()] * 4 + [pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["k1", "k2", "n_removed", "n_spans", "spans", "kept_sha256", "kept"])

    return repeats.select("k1", "k2", "text", "blocks", "starts").mapInArrow(run, "k1 long, k2 long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept_sha256 string, kept binary")


def _word_positions(passage: int):
    """For a batch with columns key and text: the picked words, and hashes of the words that a shift leaves of a passage."""

    def produce():
        import numpy as np

        size = passage - WORD_V + 1
        words, hasher = WordHasher(7), Hasher(8, size)

        def work(batch, sender):
            keys, (b, at) = batch.column(0).to_numpy(), flat(batch.column(1))
            w, begin = words(b, at)
            n = np.diff(begin)
            for text, p in _picked(np.where(n >= passage, n, 0), WORD_V, WORD_COVER, size):
                zero = np.zeros(len(p), "u8")
                sender.add(hasher.at(w, begin[text] + p, size), zero, zero, keys[text], p)
                yield

        return work

    return produce


def _word_windows(passage: int):
    """For a batch with columns uid, text and at (picked words that recur): the windows that hold them, by two hashes."""

    def produce():
        import numpy as np

        words, one, two = WordHasher(7), Hasher(9, passage), Hasher(10, passage)

        def work(batch, sender):
            uid, (b, at) = batch.column(0).to_numpy(), flat(batch.column(1))
            w, begin = words(b, at)
            p, text = flat_lists(batch.column(2))
            p, of = (p[:, None] - np.arange(WORD_V)).ravel(), np.repeat(text, WORD_V)
            fits = (p >= 0) & (p <= np.diff(begin)[of] - passage)
            place, first = np.unique(p[fits] + begin[of[fits]], return_index=True)
            p, of = p[fits][first], of[fits][first]
            for s in range(0, len(p), PART):
                k = slice(s, s + PART)
                sender.add(one.at(w, place[k], passage), two.at(w, place[k], passage), np.zeros(len(p[k]), "u8"), uid[of[k]], p[k])
                yield

        return work

    return produce


def find_passages(docs: DataFrame, text_col: str = "text", passage: int = PASSAGE) -> DataFrame:
    """``k1, k2, n_passage_words``: for each text (once, by its keys) that has any, its words in passages of ``passage`` words that another text has too.

    Words are compared as they are, and white space isn't. Copies of one text count as one text; a null text is empty.
    """
    if passage < WORD_V:
        raise ValueError(f"passage must be {WORD_V} at least")
    spark = docs.sparkSession
    common.small_batches(spark)
    text = common.text_of(text_col)
    long = docs.select(F.xxhash64(text).alias("k1"), F.xxhash64(text, F.lit(1)).alias("k2"), text.alias("text")).where(F.octet_length("text") >= 2 * passage - 1)
    total = long.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    buckets = max(LEAST_BUCKETS, -(-total // (2 * BUCKET_BYTES)))
    picked = repeated(long.select("k1", "text"), _word_positions(passage), buckets, across=True)
    picked = common.materialize(picked.groupBy(F.col("doc").alias("k1")).agg(F.collect_set("pos").alias("at")))
    keys = picked.select("k1")
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
    some = long.join(keys, "k1", "left_semi").dropDuplicates(["k1", "k2"])
    some = common.materialize(some.join(picked, "k1").withColumn("uid", F.monotonically_increasing_id()))
    common.discard(spark, picked)
    starts = repeated(some.select("uid", "text", "at"), _word_windows(passage), buckets, across=True)
    starts = starts.where(~F.col("check")).groupBy(F.col("doc").alias("uid")).agg(F.sort_array(F.collect_set("pos")).alias("at"))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    step = lambda a, p: F.struct((a["n"] + p + passage - F.greatest(p, a["end"])).alias("n"), (p + passage).alias("end"))
    n = starts.select("uid", F.aggregate("at", zero, step)["n"].alias("n_passage_words"))
    return some.select("uid", "k1", "k2").join(n, "uid").drop("uid")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, passage: int = PASSAGE) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passage_words`` for each row.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else. ``n_passage_words`` counts the words in passages
    of ``passage`` words that another document has too, of whatever bytes; they aren't removed for it. Repeated rows repeat each other's
    strings and passages; a null text is empty; texts shorter than ``length`` lose nothing. Ids may be null; other columns aren't read; an
    empty table gives an empty result.
    """
    text = common.text_of(text_col)
    least = min(length, 2 * passage - 1)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("k1"), F.xxhash64(text, F.lit(1)).alias("k2"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("sha"))
    copies = rows.where(F.col("n_bytes") >= least).groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.max("n_bytes").alias("n_bytes")).where("n > 1")
    copies = common.materialize(copies)
    whole = copies.where(F.col("n_bytes") >= length).select("k1", "k2", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256"))
    parts = cut(find_repeats(docs, text_col, length), length).drop("spans", "kept").join(copies.select("k1", "k2"), ["k1", "k2"], "left_anti")
    removed = common.materialize(parts.unionByName(whole))
    copied = docs.select(F.xxhash64(text).alias("k1"), F.xxhash64(text, F.lit(1)).alias("k2"), text.alias("text")).join(copies.select("k1", "k2"), ["k1", "k2"], "left_semi")
    copied = copied.groupBy("k1", "k2").agg(F.max(common.n_words(F.col("text"))).alias("n_passage_words")).where(F.col("n_passage_words") >= passage)
    passages = find_passages(docs, text_col, passage).join(copies.select("k1", "k2"), ["k1", "k2"], "left_anti").unionByName(copied)
    found = common.materialize(removed.join(passages, ["k1", "k2"], "full"))
    counted = copies.select("k1", "k2", "n")
    zero = F.lit(0).cast("long")
    d = common.spread_join(rows, found, ["k1", "k2"], counted, how="left")
    return d.select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), F.coalesce("n_passage_words", zero).alias("n_passage_words"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(common.read(spark, sf_dir, "documents"))
