"""Near copies by the Jaccard similarity of word shingles: SimHash links and MinHash bands find candidates, sets decide, components group."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import simhash
from tessera.llm.common import folder, join_skewed, saved, shipped
from tessera.llm.graph import components
from tessera.sources.saved import remove

#: Candidates share one of BANDS bands of ROWS minima: a pair at 0.8 is missed with (1 - 0.8**5)**25 = 0.00005, one at 0.9 never.
BANDS, ROWS = 25, 5
_BY = np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def shingles(text: str | None, shingle: int = 5) -> np.ndarray:
    """The distinct XXH64 of the runs of `shingle` words, sorted; of the whole sequence if there are fewer words."""
    parts = (text or "").encode().lower().split()  # bytes: lower() is A-Z only, split() takes U+0020 and U+0009-000D
    if not parts:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(parts), max(1, len(parts) - shingle + 1)
    starts = np.concatenate(([0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)))
    ends = (starts[min(shingle, len(parts)):] - 1).tolist()
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends)), np.uint64, n))


def signature(found: np.ndarray) -> tuple[list[int], bytes, int]:
    """Of a set of hashes: a number for each band of minima, with the band in it; a byte of each minimum; the majority bits."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(found), 1024):
        block = found[at:at + 1024]
        np.minimum(least, (block[:, None] * _BY).min(axis=0), out=least)
        ones += np.unpackbits(block.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    raw = least.tobytes()
    numbers = [xxhash.xxh64_intdigest(raw[8 * ROWS * i:8 * ROWS * (i + 1)], i) for i in range(BANDS)]
    return numbers, least.astype(np.uint8).tobytes(), int.from_bytes(np.packbits(2 * ones > len(found)).tobytes(), "big")


def _signed(values) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64), pa.int64())


class _Tables:
    """Intermediate tables of one call, as Parquet in the folder that all executors share: small there, and of known size to the planner. close() removes them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.at, self.n = spark, f"{folder(spark)}/near-copies-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.parquet(f"{self.at}/{self.n}")
        return self.spark.read.schema(df.schema).parquet(f"{self.at}/{self.n}")

    def close(self) -> None:
        remove(self.spark, self.at)


def _similar(tables: _Tables, pairs: DataFrame, sets: DataFrame, least: float, salt: int = 1000) -> DataFrame:
    """Of pairs (u, v) of keys, those whose sets (key, found) have the similarity `least` at least.

    Each v goes, with its set, to its u; where u has many, to one of several places, each with a copy of u's set. There sets pass one by one.
    """
    pairs = tables.keep(pairs.filter("u <> v").distinct())
    held = tables.keep(pairs.groupBy("u").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / salt)))
    members = join_skewed(pairs, held, ["u"], "n", ["parts"], F.col("v")).withColumn("salt", F.pmod(F.xxhash64("v"), F.col("parts")))
    members = members.join(sets, F.col("v") == F.col("key")).select("u", "salt", "v", "found")
    centres = held.join(sets, F.col("u") == F.col("key")).select("u", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("salt"), F.lit(None).cast("long").alias("v"), "found")
    ordered = members.unionByName(centres).repartition("u", "salt").sortWithinPartitions("u", "salt", F.col("v").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = np.zeros(0, np.uint64)
        for b in batches:
            near = []
            for v, found in zip(b.column(2), b.column(3)):
                found = np.frombuffer(found.as_py(), np.uint64)
                if not v.is_valid:
                    centre = found
                    near.append(False)
                    continue
                both = len(np.intersect1d(centre, found, assume_unique=True))
                near.append(both >= least * (len(centre) + len(found) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2)], names=["u", "v"]).filter(pa.array(near, pa.bool_()))

    return tables.keep(shipped(ordered).mapInArrow(run, "u long, v long"))


def _melted(tables: _Tables, keys: DataFrame, links: DataFrame) -> DataFrame:
    """(key, root): the smallest key of each key's group over the links."""
    root = components(links)
    return tables.keep(keys.select("key").join(root, F.col("key") == F.col("node"), "left").select("key", F.coalesce("root", "key").alias("root")))


def _shared(tables: _Tables, keys: DataFrame) -> DataFrame:
    """(band, key, n): the keys that aren't alone in a bucket."""
    spread = keys.select("key", "n", F.explode("bands").alias("band"))
    buckets = tables.keep(spread.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1"))
    return tables.keep(join_skewed(spread, buckets, ["band"], "size", [], F.col("key"), inner=True).select("band", "key", "n"))


def _mixed(tables: _Tables, shared: DataFrame, melted: DataFrame) -> DataFrame:
    """(band, key, n, root, low, high, size, mass): the keys of buckets that hold several groups, with the smallest and the largest key of the bucket, its keys and the sum of their n."""
    placed = tables.keep(shared.select("band", "key", "n").join(melted, "key").select("band", "key", "n", "root"))
    one = F.struct("key", "n", "root")
    buckets = placed.groupBy("band").agg(F.min(one).alias("low"), F.max(one).alias("high"), F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("size"), F.sum("n").alias("mass"))
    buckets = tables.keep(buckets.filter("a <> b").select("band", "low", "high", "size", "mass"))
    return tables.keep(join_skewed(placed, buckets, ["band"], "size", ["low", "high", "size", "mass"], F.col("key"), inner=True))


def _within(rows: DataFrame, least: float, salt: int) -> DataFrame:
    """(u, v) of rows (band, size, mass, key, n, root, sig, bands, found): links of keys of one bucket and of two groups.

    A large bucket is cut, by a hash, into parts of about `salt` keys and at most a million shingles; each pair of parts is one
    task's product, and the sets are checked there, so no pair but a link is ever a row. A pair is checked in the first bucket
    that it shares, and where its groups aren't linked yet. Signatures go first: of 125 minima, a pair at 0.8 shares under two thirds with a chance of 0.00005.
    """
    parts = F.greatest(F.ceil(F.col("size") / salt), F.ceil(F.col("mass") / 1_000_000))
    own = F.pmod(F.xxhash64("key"), parts)
    dealt = rows.withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    dealt = dealt.select("band", F.least("own", "with").alias("p"), F.greatest("own", "with").alias("q"), "own", "key", "n", "root", "sig", "bands", "found")

    def run(t: pa.Table) -> pa.Table:
        own, key, n, root = (t.column(c).to_numpy() for c in ("own", "key", "n", "root"))
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)
        bands, found = np.stack(t.column("bands").to_numpy()), t.column("found")
        band, p, q = (t.column(c)[0].as_py() for c in ("band", "p", "q"))
        a, b = np.flatnonzero(own == p), np.flatnonzero(own == q)
        _, group = np.unique(root, return_inverse=True)
        held: dict[int, np.ndarray] = {}
        read = lambda i: held[i] if i in held else held.setdefault(i, np.frombuffer(found[i].as_py(), np.uint64))
        links = []
        for i in a.tolist():
            some = b[(group[b] != group[i]) & (np.minimum(n[b], n[i]) >= least * np.maximum(n[b], n[i])) & ((p != q) | (key[b] > key[i]))]
            some = some[(sig[some] == sig[i]).sum(axis=1) >= 0.66 * BANDS * ROWS]
            same = bands[some] == bands[i]
            some = some[bands[i][same.argmax(axis=1)] == band]
            for j in some.tolist():
                if group[i] != group[j]:
                    both = len(np.intersect1d(read(i), read(j), assume_unique=True))
                    if both >= least * (n[i] + n[j] - both) - 1e-9:
                        links.append((min(key[i], key[j]), max(key[i], key[j])))
                        group[group == group[j]] = group[i]
        return pa.table({"u": pa.array([x for x, _ in links], pa.int64()), "v": pa.array([x for _, x in links], pa.int64())})

    return shipped(dealt).groupBy("band", "p", "q").applyInArrow(run, "u long, v long")


def keep_one(docs: DataFrame, shingle: int = 5, least: float = 0.8, budget: int = 4, id_col: str = "doc_id", text_col: str = "text", salt: int = 2000) -> DataFrame:
    """docs with one document of each group of near copies, the one of the smallest id.

    Two texts are linked if their sets of word shingles have the Jaccard similarity `least` at least; groups are components
    of links. Texts without a word are copies of each other. Rows without an id pass and link nothing. Of rows of the same
    id in one group, the one whose text has the smallest hash stays, and one of those alike in id and text; in several groups, one of each.

    Equal sets are one key. Candidates come in turns, and each is checked on the sets: SimHash fingerprints within
    `budget` bits, by the trie join; in each bucket of a MinHash band that still holds several groups, the keys against the
    smallest one, then in those that still do against the largest one; and last, where buckets still do, the keys against
    those of the other groups, by their signatures. A pair is missed only if the bands or the signatures miss it (at 0.8 with a
    chance of 0.00005 each). Rows alike in id and text
    are made one before they are dealt out, so no join gathers copies with their texts.
    """
    tables = _Tables(docs.sparkSession)
    try:
        stay = _staying(tables, docs, shingle, least, budget, id_col, text_col, salt)
        stay = saved(stay)
    finally:
        tables.close()
    given = docs.filter(F.col(id_col).isNotNull())
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    one = given.select(F.col(f"`{id_col}`").alias("_tz_id"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("_tz_th"), row.alias("_tz_row")).groupBy("_tz_id", "_tz_th").agg(F.first("_tz_row").alias("_tz_row"))
    some = one.join(stay.select(F.col("id").alias("_tz_id"), F.col("th").alias("_tz_th")), ["_tz_id", "_tz_th"])
    return some.select(*(F.col("_tz_row")[c].alias(c) for c in docs.columns)).unionByName(docs.filter(F.col(id_col).isNull()))


def _staying(tables: _Tables, docs: DataFrame, shingle: int, least: float, budget: int, id_col: str, text_col: str, salt: int) -> DataFrame:
    """(id, th): of each group the smallest id, with the hash of its text."""
    keyed = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = keyed.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                found = [shingles(t.as_py(), shingle) for t in b.column(2)]
                signs = [signature(x) for x in found]
                sizes = pa.array(np.arange(len(found) + 1) * BANDS, pa.int32())
                columns = [_signed([xxhash.xxh64_intdigest(x.tobytes()) for x in found]), pa.array([len(x) for x in found], pa.int64()), pa.ListArray.from_arrays(sizes, _signed([h for x in signs for h in x[0]])), pa.array([x[1] for x in signs], pa.binary()), _signed([x[2] for x in signs])]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names=["id", "th", "key", "n", "bands", "sig", "fp"])

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t.as_py(), shingle).tobytes() for t in b.column(1)], pa.binary())], names=["key", "found"])

    hashed = keyed.select("id", F.xxhash64("text").alias("th"), "text").groupBy("id", "th").agg(F.first("text").alias("text"))
    rows = shipped(hashed).mapInArrow(run, f"id {kind}, th long, key long, n long, bands array<long>, sig binary, fp long")
    # one row a key; equal sets need no bands of their own
    keys = tables.keep(rows.groupBy("key").agg(F.min(F.struct("id", "th")).alias("of"), *(F.first(c).alias(c) for c in ("n", "bands", "sig", "fp"))))

    alike = lambda a, b: F.least(a, b) >= least * F.greatest(a, b)  # noqa: E731 - else no similarity of `least`
    prints = tables.keep(keys.groupBy("fp").agg(F.min(F.struct("key", "n")).alias("c"), F.count("*").alias("size")))
    same = join_skewed(keys.select("key", "n", "fp"), prints.filter("size > 1"), ["fp"], "size", ["c"], F.col("key"), inner=True).select(F.col("c.key").alias("u"), F.col("key").alias("v"), F.col("c.n").alias("n1"), F.col("n").alias("n2"))
    print_of = lambda side: prints.select(F.col("fp").alias(side), F.col("c").alias(f"c{side}"))
    near = simhash.links(prints.select("fp"), budget).join(print_of("u"), "u").join(print_of("v"), "v").select(F.col("cu.key").alias("u"), F.col("cv.key").alias("v"), F.col("cu.n").alias("n1"), F.col("cv.n").alias("n2"))
    first, shared = tables.keep(same.unionByName(near).filter(alike(F.col("n1"), F.col("n2"))).select("u", "v").distinct()), _shared(tables, keys)

    # the sets of all keys that can be in a pair, worked out once from a text of each
    used = first.select(F.explode(F.array("u", "v")).alias("key")).union(shared.select("key")).distinct().join(keys.select("key", "of"), "key")
    texts = used.select("key", F.col("of.id").alias("id"), F.col("of.th").alias("th"))
    sets = tables.keep(shipped(hashed.join(texts, ["id", "th"]).select("key", "text")).mapInArrow(full, "key long, found binary"))

    links = _similar(tables, first, sets, least)
    melted = _melted(tables, keys, links)
    for centre in ("low", "high"):
        shared = _mixed(tables, shared, melted)
        c = F.col(centre)
        met = shared.filter((F.col("root") != c["root"]) & alike(F.col("n"), c["n"])).select(c["key"].alias("u"), F.col("key").alias("v"))
        links = links.unionByName(_similar(tables, met, sets, least))
        melted = _melted(tables, keys, links)
    rest = _mixed(tables, shared, melted).filter("size > 2").select("band", "size", "mass", "key", "n", "root")
    if not rest.isEmpty():
        more = tables.keep(_within(rest.join(keys.select("key", "sig", "bands"), "key").join(sets, "key"), least, salt))
        melted = _melted(tables, keys, links.unionByName(more))
    return melted.join(keys.select("key", "of"), "key").groupBy("root").agg(F.min("of").alias("of")).select("of.id", "of.th")
