"""SimHash near-dedup: majority fingerprints, a binary trie joined with itself within a Hamming budget, components."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import join_skewed, saved, shipped, table
from tessera.llm.graph import components

BITS = 64


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The majority bits of the shingles' XXH64 (seed 42); 0 without words."""
    parts = (text or "").encode().lower().split()  # bytes: lower() is A-Z only, split() takes U+0020 and U+0009-000D
    if not parts:
        return 0
    joined, n = b" ".join(parts), max(1, len(parts) - shingle + 1)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    starts = np.concatenate(([0], np.cumsum(sizes)))
    ends = (starts[min(shingle, len(parts)):] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends)), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        block = hashes[at:at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long): one row a row of docs; null and wordless texts have fp 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.int64())], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return shipped(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, fp long")


def _blocks(budget: int) -> list[tuple[int, int]]:
    """budget + 1 runs of bits (first, length), none within another: two fingerprints within the budget share one of them.

    A run has 20 bits at most, so that there are no more than a million nodes a run.
    """
    cuts = [BITS * i // (budget + 1) for i in range(budget + 2)]
    return [(a, min(20, b - a)) for a, b in zip(cuts, cuts[1:])]


def _settle(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least label reachable over the links (a, b), for each item."""
    while len(a):
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            break
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def trie_links(keys: np.ndarray, starts: np.ndarray, depth: np.ndarray, halves: np.ndarray, budget: int, leaf: int = 64, most: int = 1 << 18) -> np.ndarray:
    """For each key the first position of its component under links within `budget` bits.

    keys: sorted within each group; starts: where groups begin, with the end; depth: the bits that all keys of a group
    (or of each of its two halves) share; halves: where a group's second half begins if only links between the halves are
    sought, else -1. A node of the trie is a range of keys that share their first bits. Pairs of nodes go down together;
    a pair's error grows where their next bits differ, and a pair over budget is pruned, as is one whose keys are all in
    one component already. The budget is raised bit by bit, so that dense groups melt before the wide search.
    """
    label = np.arange(len(keys))
    top = np.uint64(BITS - 1)
    for within in range(1, budget + 1):
        turn = np.concatenate(([0], np.cumsum(label[1:] != label[:-1]))) if len(keys) else label
        lo, hi, mid = starts[:-1], starts[1:], halves
        two = mid >= 0
        error = np.zeros(len(lo), np.int64)
        if two.any():
            error[two] = np.bitwise_count((keys[lo[two]] ^ keys[mid[two]]) >> (np.uint64(BITS) - depth[two].astype(np.uint64)))
        first = (lo, np.where(two, mid, hi), np.where(two, mid, lo), hi, error, depth.astype(np.int64))
        stack, links = [first], []
        while stack:
            al, ah, bl, bh, e, d = stack.pop()
            if len(al) > most:
                half = len(al) // 2
                stack += [tuple(x[:half] for x in (al, ah, bl, bh, e, d)), tuple(x[half:] for x in (al, ah, bl, bh, e, d))]
                continue
            same = al == bl
            done = (turn[ah - 1] == turn[al]) & (turn[bh - 1] == turn[bl]) & (label[al] == label[bl])
            live = (e <= within) & ~done & ~(same & (ah - al < 2))
            al, ah, bl, bh, e, d, same = (x[live] for x in (al, ah, bl, bh, e, d, same))
            small = ((ah - al) * (bh - bl) <= leaf) | (d >= BITS)
            if small.any():
                x, y, n = al[small], bl[small], (ah - al)[small] * (bh - bl)[small]
                wide = np.repeat((bh - bl)[small], n)
                k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                i, j = np.repeat(x, n) + k // wide, np.repeat(y, n) + k % wide
                near = np.bitwise_count(keys[i] ^ keys[j]) <= within
                near &= i != j
                links.append((i[near], j[near]))
            al, ah, bl, bh, e, d, same = (x[~small] for x in (al, ah, bl, bh, e, d, same))
            if not len(al):
                continue
            shift = (top - d.astype(np.uint64))
            am = _middle(keys, al, ah, shift)
            bm = np.where(same, am, _middle(keys, bl, bh, shift))
            cross = ~same
            parts = [(al, am, bl, bm, e), (am, ah, bm, bh, e), (al, am, bm, bh, e + 1), (am[cross], ah[cross], bl[cross], bm[cross], e[cross] + 1)]
            level = [d, d, d, d[cross]]
            new = [np.concatenate(x) for x in zip(*parts)] + [np.concatenate(level) + 1]
            full = (new[0] < new[1]) & (new[2] < new[3])
            stack.append(tuple(x[full] for x in new))
        if links:
            label = _settle(label, np.concatenate([x for x, _ in links]), np.concatenate([y for _, y in links]))
    return label


def _middle(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Where the bit at `shift` turns to 1 in each sorted range."""
    lo, hi = lo.copy(), hi.copy()
    one = np.uint64(1)
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) // 2
        bit = (keys[np.minimum(mid, len(keys) - 1)] >> shift) & one
        up = open_ & (bit == 0)
        lo = np.where(up, mid + 1, lo)
        hi = np.where(open_ & ~up, mid, hi)


def _turned(fp: np.ndarray, by: np.ndarray) -> np.ndarray:
    by = by.astype(np.uint64) % np.uint64(BITS)
    return np.where(by == 0, fp, (fp << by) | (fp >> ((np.uint64(BITS) - by) % np.uint64(BITS))))


def _begun(cells: DataFrame, blocks: list[tuple[int, int]]) -> DataFrame:
    """cells with key, the fingerprint turned so that its block is in front, and begin, where that block is."""
    begin = F.get(F.array(*(F.lit(a) for a, _ in blocks)), F.col("block"))
    return cells.withColumn("begin", begin).withColumn("key", F.expr("shiftleft(fp, begin) | shiftrightunsigned(fp, (64 - begin) % 64)"))


def _children(cells: DataFrame, blocks: list[tuple[int, int]], budget: int, step: int) -> DataFrame:
    """cells (fp, block, depth, a, b), each row once for each pair of nodes `step` bits deeper that holds it and is within the budget.

    A cell is a pair of nodes of the block's trie by their paths a <= b; a row is in it if its own path is one of them. A
    pair is sought in the first block that it shares, so each block before that holds an error: one of the budget is kept
    back for each of those that the path hasn't reached yet.
    """
    wide = _begun(cells, blocks).withColumn("width", F.least(F.lit(step), BITS - F.col("depth")).cast("int")).withColumn("deep", F.col("depth") + F.col("width"))
    unseen = reduce(add, (((F.lit(j) < F.col("block")) & (F.col("deep") <= BITS - F.col("begin") + a)).cast("int") for j, (a, _) in enumerate(blocks)))
    wide = wide.withColumn("own", F.expr("shiftrightunsigned(key, 64 - depth)")).withColumn("x", F.expr("shiftrightunsigned(key, 64 - deep) & (shiftleft(1L, width) - 1)"))
    left = budget - unseen - F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.expr("shiftleft(1L, width) - 1")), lambda y: F.bit_count(F.col("x").bitwiseXOR(y)) <= F.col("left"))
    pair = lambda x, y: F.struct((F.expr("shiftleft(a, width)") + x).alias("a"), (F.expr("shiftleft(b, width)") + y).alias("b"))
    same, on_a = F.col("a") == F.col("b"), F.col("own") == F.col("a")
    pairs = F.transform(others, lambda y: F.when(same, pair(F.least("x", y), F.greatest("x", y))).when(on_a, pair(F.col("x"), y)).otherwise(pair(y, F.col("x"))))
    return wide.withColumn("left", left).select("fp", "block", F.col("deep").alias("depth"), F.explode(pairs).alias("pair")).select("fp", "block", "depth", "pair.a", "pair.b")


def links(prints: DataFrame, budget: int = 4, bucket_limit: int = 200_000, step: int = 3, rows_at_once: int = 100_000) -> DataFrame:
    """(u, v) over distinct fingerprints (fp): edges that join each pair within `budget` bits, but not each pair as an edge.

    The trie is dealt out by the nodes at the end of one of budget + 1 blocks of bits, each block once turned to the
    front: two fingerprints within the budget share a block, and their paths meet in a node of the first such. Pairs of
    nodes with over bucket_limit fingerprints (or a 40,000th of all rows, which bounds their number) go down `step` bits
    at a time, each with the errors that it has spent, and a pair over its budget is pruned; so do pairs of which one
    node is empty. The others, small ones, are walked to the end in one task each by trie_links().
    """
    blocks = _blocks(budget)
    bits = F.col("fp")
    first = F.array(*(F.struct(F.lit(i).alias("block"), F.lit(n).alias("depth"), F.shiftrightunsigned(_turn(bits, a), BITS - n).alias("a")) for i, (a, n) in enumerate(blocks)))
    cells = prints.select("fp", F.explode(first).alias("x")).select("fp", "x.block", "x.depth", "x.a", F.col("x.a").alias("b"))
    cell = ["block", "depth", "a", "b"]
    ready = []
    while True:
        on_a = F.expr("shiftrightunsigned(key, 64 - depth) = a")
        sizes = saved(_begun(cells, blocks).groupBy(*cell).agg(F.count("*").alias("n"), F.count_if(on_a).alias("na")).filter(F.col("n") > 1))
        total = sizes.agg(F.sum("n")).first()[0] or 0
        limit = max(bucket_limit, total // 40_000)
        large = sizes.filter((F.col("n") > limit) & (F.col("depth") < BITS)).withColumn("empty", (F.col("a") != F.col("b")) & ((F.col("na") == 0) | (F.col("na") == F.col("n")))).select(*cell, "empty")
        if large.isEmpty():
            ready.append(cells)
            break
        marked = cells.join(F.broadcast(large), cell, "left")
        ready.append(marked.filter("empty is null").drop("empty"))
        cells = saved(_children(marked.filter("not empty").drop("empty"), blocks, budget, step))
    dealt = reduce(DataFrame.unionByName, ready).repartition(*cell).sortWithinPartitions(*cell)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0
        for batch in batches:
            held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]))
            n += batch.num_rows
            if n >= rows_at_once:
                block = np.concatenate(held, axis=1)
                change = np.flatnonzero((block[1:, 1:] != block[1:, :-1]).any(axis=0))
                cut = int(change[-1]) + 1 if len(change) else 0
                if cut:
                    yield from _joined(block[:, :cut], blocks, budget)
                held, n = [block[:, cut:]], block.shape[1] - cut
        if n:
            yield from _joined(np.concatenate(held, axis=1), blocks, budget)

    return shipped(dealt).select("fp", *cell).mapInArrow(run, "u long, v long")


def _turn(bits, by: int):
    """bits turned left, as a column."""
    by %= BITS
    return bits if not by else F.shiftleft(bits, by).bitwiseOR(F.shiftrightunsigned(bits, BITS - by))


def _joined(rows: np.ndarray, blocks: list[tuple[int, int]], budget: int) -> Iterator[pa.RecordBatch]:
    """Links within cells; rows: fp, block, depth, a and b, cell by cell."""
    fp, block, depth, a, b = rows
    key = _turned(fp.view(np.uint64), np.array([x for x, _ in blocks])[block])
    order = np.lexsort((key, b, a, depth, block))
    key, fp, block, depth, a, b = (x[order] for x in (key, fp, block, depth, a, b))
    edge = np.flatnonzero(np.concatenate(([True], (block[1:] != block[:-1]) | (depth[1:] != depth[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
    ends = np.concatenate((edge[1:], [len(key)]))
    path = (key >> (np.uint64(BITS) - depth.astype(np.uint64))).view(np.int64)
    in_b = np.add.reduceat((path == b) & (a != b), edge)  # keys are in order, so those of b follow those of a
    two = a[edge] != b[edge]
    halves = np.where(two, ends - in_b, -1)
    keep = ~two | ((halves > edge) & (halves < ends))
    keep &= ends - edge > 1
    if not keep.any():
        return
    take = np.concatenate([np.arange(x, y) for x, y in zip(edge[keep], ends[keep])])
    moved = np.concatenate(([0], np.cumsum(ends[keep] - edge[keep])))
    halves = np.where(halves[keep] < 0, -1, halves[keep] - edge[keep] + moved[:-1])
    label = trie_links(key[take], moved, depth[edge[keep]], halves, budget)
    tied = label != np.arange(len(take))
    u, v = fp[take][tied], fp[take][label[tied]]
    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def simhash_components(docs: DataFrame, shingle: int = 4, budget: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component): one row a row of docs; component is the smallest id reachable over links within `budget` bits.

    Null, empty and wordless texts have the fingerprint 0 and link like any other. A null id has a fingerprint, links, and
    gives no component its name: component is null where no row of it has an id. Rows of one id are told apart by their
    fingerprints only. Fewer words than a shingle: the whole sequence is the shingle. Empty input: empty output. Copies
    are one fingerprint before the join, and groups are spanning edges, so no group is spelt out as pairs.
    """
    rows = saved(fingerprints(docs, shingle, id_col, text_col))
    prints = saved(rows.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")))
    root = components(links(prints.select("fp"), budget))
    named = prints.join(root, prints.fp == root.node, "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    named = saved(named)
    groups = named.groupBy("root").agg(F.min("first").alias("component"), F.count("*").alias("prints"))
    named = join_skewed(named, saved(groups.filter("prints > 1")), ["root"], "prints", ["component"], F.xxhash64("fp")).withColumn("component", F.coalesce("component", "first"))
    return join_skewed(rows, named.select("fp", "n", "component"), ["fp"], "n", ["component"], F.xxhash64("id"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
