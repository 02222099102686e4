"""Cross-tokenizer alignment: DuckDB joins token intervals per Arrow batch; partial counts of id pairs are merged in Spark."""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections import Counter
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from tokenizers import Tokenizer

from tessera.llm.bpe import byte_characters
from tessera.llm.common import packed, row_and, saved, shipped, table, unpacked

#: A space with no white space beside it: both tokenizers begin a token there whatever stands before and after.
CUT = re.compile(r"(?<=\S) (?=\S)")
LOOSE = re.compile(r"\s\s")
#: Text of one batch, and pieces of text that are remembered (shorter ones only).
BATCH_CHARS, KNOWN, KNOWN_CHARS = 4_000_000, 250_000, 64


def pieces(text: str) -> list[str]:
    """The text cut at its lone spaces, which are left out."""
    return CUT.split(text) if LOOSE.search(text) or text[0].isspace() or text[-1].isspace() else text.split(" ")


class Tokenizers:
    """Both tokenizers, and for each of their ids the bytes that it stands for."""

    def __init__(self, byte_level: str, sentence: str):
        with open(byte_level, encoding="utf-8") as f:
            raw = f.read()
        self.a = Tokenizer.from_str(raw)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=sentence)
        names = self.a.get_vocab()
        back = {c: i for i, c in enumerate(byte_characters())}
        self.bytes_a: list[bytes] = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.bytes_a[i] = bytes(back[c] for c in name) if all(c in back for c in name) else name.encode()
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            name = self.b.id_to_piece(i)
            self.bytes_b.append(bytes([int(name[1:-1], 16)]) if self.b.is_byte(i) else name.replace("▁", " ").encode())
        spec = json.loads(raw)
        split = spec["pre_tokenizer"]
        if split["type"] != "ByteLevel" or not split.get("use_regex", True) or split["add_prefix_space"] or spec.get("normalizer"):
            raise ValueError("not a byte-level tokenizer that begins a token at each lone space")
        if any("▁" in self.b.id_to_piece(i).lstrip("▁") for i in range(self.b.get_piece_size())):
            raise ValueError("a piece goes over a space")
        self.size_a, self.size_b = (np.array([len(x) for x in xs], np.int64) for xs in (self.bytes_a, self.bytes_b))

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        return [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)], self.b.encode(texts, num_threads=1)


#: Tokens stand in new_a and new_b (i, piece, id, e) in order; e, the end, is a place in one run of bytes, so pieces never meet.
#: A link is a stretch between two neighbouring ends of either side: of the token that ends with it, and of the first on the
#: other side that ends there or later. Where both end, a group does; a group's number is how many ended before.
LINKS = """
CREATE OR REPLACE TEMP TABLE ab AS SELECT a.i, a.piece, a.id AS a, b.id AS b, a.e = b.e AS even FROM new_a a ASOF JOIN new_b b ON a.e <= b.e;
CREATE OR REPLACE TEMP TABLE ba AS SELECT b.i, b.piece, a.id AS a, b.id AS b, a.e = b.e AS even FROM new_b b ASOF JOIN new_a a ON b.e <= a.e;
CREATE OR REPLACE TEMP TABLE fresh AS SELECT piece, a, b, count(*) AS n FROM (SELECT piece, a, b FROM ab UNION ALL SELECT piece, a, b FROM ba WHERE NOT even) GROUP BY ALL
"""
GROUPS = "SELECT piece, {0} AS id, sum(CAST(even AS INT)) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) - CAST(even AS INT) AS k FROM {1} ORDER BY i"
PAIRS = """
CREATE OR REPLACE TEMP TABLE held AS SELECT doc, a, b, CAST(sum(m * n) AS BIGINT) AS m FROM places JOIN (SELECT * FROM links UNION ALL SELECT * FROM fresh) USING (piece) GROUP BY ALL;
CREATE OR REPLACE TEMP TABLE pairs AS SELECT a, b, n, row_number() OVER (ORDER BY a, b) - 1 AS p FROM (SELECT a, b, count(*) AS n FROM held GROUP BY a, b);
"""
SIGNS = ("", ",", ";", "|")


class Aligner:
    """A worker's tokenizers, and what it remembers of short pieces of text: their number; of a number the counts, the groups and, in DuckDB, the links."""

    def __init__(self, both: Tokenizers):
        self.both = both
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "700MB", "temp_directory": ""})
        size = max(len(both.bytes_a), len(both.bytes_b))
        self.names = [sign + str(i) for sign in SIGNS for i in range(size)]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.once: set[int] = set()
        self.counts = np.zeros((0, 3), np.int64)  # tokens of A, of B, groups; of a piece that can't be aligned -1
        self.told: list[str] = []
        self.db.execute("CREATE OR REPLACE TABLE links (piece INT, a INT, b INT, n BIGINT)")

    def _tokens(self, new: list[str]) -> tuple[list[tuple[list[int], list[int], list[int]]], set[int]]:
        """Runs of pieces with the ids of A and B for all of a run; and the pieces whose bytes differ, in no run."""
        runs, bad = [], set()
        loose = [i for i, w in enumerate(new) if not w or w[0].isspace() or w[-1].isspace()]
        clean = sorted(set(range(len(new))).difference(loose))
        rows, at = [[i] for i in loose], 0
        while at < len(clean):  # pieces stand together in texts of some length
            to, size = at, 0
            while to < len(clean) and (to == at or size < 20_000):
                size += len(new[clean[to]]) + 1
                to += 1
            rows.append(clean[at:to])
            at = to
        while rows:
            texts = [" ".join(new[i] for i in row) for row in rows]
            again = []
            for row, text, a, b in zip(rows, texts, *self.both.encode(texts)):
                raw = b" " + text.encode()
                # A is byte-level and changes no text: its bytes can't differ but in number
                if self.both.size_a[a].sum() == len(raw) and b"".join(map(self.both.bytes_b.__getitem__, b)) == raw:
                    runs.append((row, a, b))
                elif len(row) == 1:
                    bad.add(row[0])
                else:
                    again += [row[: len(row) // 2], row[len(row) // 2:]]
            rows = again
        return runs, bad

    def learn(self, new: list[str]) -> None:
        """Numbers the new pieces of text from len(self.told) on; their links are in the table fresh."""
        first = len(self.told)
        runs, bad = self._tokens(new)
        order = np.array([i for row, _, _ in runs for i in row], np.int64)
        ends = np.cumsum([len(new[i].encode()) + 1 for i in order.tolist()])
        counts = np.full((len(new), 3), -1, np.int64)
        for side, (name, sizes) in enumerate((("new_a", self.both.size_a), ("new_b", self.both.size_b))):
            flat = np.fromiter((x for run in runs for x in run[1 + side]), np.int32)
            e = np.cumsum(sizes[flat])
            piece = order[np.searchsorted(ends, e)]
            counts[order, side] = np.bincount(piece, minlength=len(new))[order]
            self.db.register("given", pa.table({"i": np.arange(len(flat)), "piece": (piece + first).astype(np.int32), "id": flat, "e": e}))
            self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")
        self.db.execute(LINKS)
        told = [""] * len(new)
        if len(order):
            a, b = (self.db.execute(GROUPS.format(c, t)).fetchnumpy() for c, t in (("a", "ab"), ("b", "ba")))
            k = [np.asarray(x["k"]).astype(np.int64) for x in (a, b)]
            before = [np.searchsorted(k[1], k[0]), np.searchsorted(k[0], k[1], side="right")]  # tokens of the other side that stand before
            code = np.zeros(len(k[0]) + len(k[1]), np.int64)
            size = len(self.names) // len(SIGNS)
            begins = [np.diff(x, prepend=-1) > 0 for x in k]
            opens = np.diff(a["piece"], prepend=-1) != 0
            code[np.arange(len(k[0])) + before[0]] = a["id"] + size * np.where(opens, 0, np.where(begins[0], 2, 1))
            code[np.arange(len(k[1])) + before[1]] = b["id"] + size * np.where(begins[1], 3, 1)
            names = list(map(self.names.__getitem__, code.tolist()))
            cuts = np.cumsum(counts[order, 0] + counts[order, 1]).tolist()
            for i, x, y in zip(order.tolist(), [0, *cuts], cuts):
                told[i] = "".join(names[x:y])
            of = a["piece"][begins[0]] - first
            counts[order, 2] = np.bincount(of, minlength=len(new))[order]
        self.counts = np.concatenate([self.counts, counts])
        self.told += told

    def align(self, texts: list[str | None]) -> tuple[list[tuple], list[np.ndarray], pa.Table]:
        """For each text (n_a, n_b, n_groups, groups) and its links (place of a pair, how often), and the pairs (a, b, n: in how many texts) in order."""
        cut = [pieces(t) if t else [] for t in texts]
        if len(self.told) > KNOWN:
            self.forget()
        often = Counter(w for row in cut for w in row if w not in self.known)
        # what is remembered comes first: short pieces met twice, in this batch or in an earlier one (by their hash, for the time being)
        twice = {w for w, n in often.items() if (n > 1 or hash(w) in self.once) and len(w) <= KNOWN_CHARS}
        rest = [w for w in often if w not in twice]
        fresh, stays = [*twice, *rest], len(self.told) + len(twice)
        if len(self.once) > 2 * KNOWN:
            self.once.clear()
        self.once.update(map(hash, rest))
        self.known.update((w, len(self.told) + i) for i, w in enumerate(fresh))
        self.learn(fresh)
        out, docs, ids, times = [], [], [], []
        for d, row in enumerate(cut):
            of = np.fromiter(map(self.known.__getitem__, row), np.int64, len(row))
            own = self.counts[of]
            if not len(of) or own.min() < 0:
                out.append((0, 0, 0, ""))
                continue
            out.append((*own.sum(axis=0).tolist(), hashlib.sha256(";".join(map(self.told.__getitem__, of.tolist())).encode()).hexdigest()))
            some, many = np.unique(of, return_counts=True)
            docs.append(np.full(len(some), d))
            ids.append(some)
            times.append(many)
        join = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.int64)
        self.db.register("places", pa.table({"doc": join(docs), "piece": join(ids), "m": join(times)}))
        self.db.execute(PAIRS)
        self.db.unregister("places")
        held = self.db.execute("SELECT doc, p, m FROM held JOIN pairs USING (a, b) ORDER BY doc, p").fetchnumpy()
        pairs = self.db.sql("SELECT a, b, n FROM pairs ORDER BY p").to_arrow_table()
        cuts = np.searchsorted(held["doc"], np.arange(len(texts) + 1))
        links = [np.stack([held["p"][x:y], held["m"][x:y]]) for x, y in zip(cuts, cuts[1:])]
        self.db.execute("INSERT INTO links SELECT * FROM fresh WHERE piece < ?", [stays])
        del self.told[stays:]
        self.counts = self.counts[:stays]
        for w in rest:
            del self.known[w]
        return out, links, pairs


@functools.lru_cache(maxsize=2)
def _aligner(byte_level: str, sentence: str) -> Aligner:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return Aligner(Tokenizers(SparkFiles.get(byte_level), SparkFiles.get(sentence)))


def _pack(x: np.ndarray) -> bytes:
    """Ascending places as steps, and how often, without what is easily said shorter."""
    steps = np.concatenate([np.diff(x[0], prepend=0), x[1]]).astype("<u4")
    return pa.compress(steps.tobytes(), codec="zstd", asbytes=True)


def _unpack(raw: bytes, n: int) -> np.ndarray:
    x = np.frombuffer(pa.decompress(raw, decompressed_size=8 * n, codec="zstd", asbytes=True), "<u4").astype(np.int64).reshape(2, n)
    return np.stack([np.cumsum(x[0]), x[1]])


def _slices(b: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about BATCH_CHARS."""
    sizes, at = [len(x.as_py() or "") for x in b.column(column)], 0
    while at < b.num_rows:
        to, size = at, 0
        while to < b.num_rows and (to == at or size + sizes[to] <= BATCH_CHARS):
            size += sizes[to]
            to += 1
        yield b.slice(at, to - at)
        at = to


def align(docs: DataFrame, byte_level: str, sentence: str, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, pairs): docs without the text, with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256; and (a, b, n, best).

    byte_level (A): a byte-level tokenizer's JSON; sentence (B): a sentencepiece model that adds a space. Both are paths on
    the driver and go to the executors as Spark files. A text is encoded as space + text by A, as text by B. Two tokens are
    linked if their byte ranges overlap; places where both end a token cut the text into groups, written a1,a2|b1;a3|b2,b3.
    pairs: every pair of ids that some text links, in how many texts (n), and whether no pair of its A id is in more (best).
    n_best and count_sum go over a text's links, each as often as it occurs.

    Null and empty texts, and texts whose tokens don't spell space + text byte by byte (one that holds U+2581), have no
    tokens: zeros and ''. Rows alike count as documents of their own. Columns of the names made here are replaced, others
    pass. Empty input: both tables empty. Texts are whole at any length: a lone space between two other signs begins a
    token in both, so what stands between such spaces is aligned once and remembered (KNOWN pieces, of KNOWN_CHARS at
    most, a worker), in DuckDB; a text without any is one piece. A batch's pairs are counted in DuckDB, so a pair comes
    to the shuffles once a batch, and no pair is a hot key. Counts come back to the batches the same way. No table of pairs
    is broadcast or collected.
    """
    context = docs.sparkSession.sparkContext
    for path in (byte_level, sentence):
        context.addFile(path)
    files = [p.rsplit("/", 1)[-1] for p in (byte_level, sentence)]
    base = packed(docs, text_col, beside=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number = _aligner(*files), TaskContext.get().partitionId() << 32
        for whole in batches:
            for b in _slices(whole, 1):
                found, links, pairs = aligner.align(b.column(1).to_pylist())
                n = b.num_rows
                ints = lambda values: pa.array([*values, None], pa.int64())
                columns = [
                    pa.concat_arrays([b.column(0), pa.nulls(1, b.column(0).type)]), pa.array([number] * (n + 1), pa.int64()),
                    *(ints(x[i] for x in found) for i in range(3)), ints(int(x[1].sum()) for x in links), pa.array([*(x[3] for x in found), None], pa.string()),
                    ints(x.shape[1] for x in links), pa.array([*map(_pack, links), None], pa.binary()),
                    *(pa.array([*[None] * n, pairs.column(c).to_numpy()], pa.list_(pa.int64())) for c in ("a", "b", "n")),
                ]
                number += 1
                yield pa.RecordBatch.from_arrays(columns, names=["_tz_row", "batch", "n_a", "n_b", "n_groups", "n_links", "sha", "size", "links", "a", "b", "n"])

    row = StructField("_tz_row", base.schema["_tz_row"].dataType, True)  # the row of a batch's pairs has none
    schema = StructType([row, *row_and(base, "batch long, n_a long, n_b long, n_groups long, n_links long, sha string, size long, links binary, a array<long>, b array<long>, n array<long>").fields[1:]])
    made = saved(shipped(base).mapInArrow(run, schema))
    some = made.filter("a is not null").select("batch", F.explode(F.arrays_zip("a", "b", "n")).alias("x")).select("batch", "x.*")
    counts = saved(some.groupBy("a", "b").agg(F.sum("n").alias("n")))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    pairs = counts.join(most, "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))
    back = some.select(F.col("batch").alias("of"), "a", "b").join(pairs, ["a", "b"])

    def count(docs_: pa.Table, pairs_: pa.Table) -> pa.Table:
        t = pairs_.sort_by([("a", "ascending"), ("b", "ascending")])
        n, best = t.column("n").to_numpy(), t.column("best").to_numpy().astype(np.int64)
        sums = []
        for raw, size in zip(docs_.column("links"), docs_.column("size")):
            at, m = _unpack(raw.as_py(), size.as_py())
            sums.append((int((m * best[at]).sum()), int((m * n[at]).sum())))
        out = docs_.select(["_tz_row", "n_a", "n_b", "n_groups", "n_links", "sha"])
        for i, name in enumerate(("n_best", "count_sum")):
            out = out.append_column(name, pa.array([x[i] for x in sums], pa.int64()))
        return out

    own = made.filter("a is null").drop("a", "b", "n")
    done = own.groupBy("batch").cogroup(back.groupBy("of")).applyInArrow(count, StructType([row, *StructType.fromDDL("n_a long, n_b long, n_groups long, n_links long, sha string, n_best long, count_sum long").fields]))
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    return unpacked(done, docs, text_col, **{c: F.col(c) for c in names}, groups_sha256=F.col("sha")), pairs


def op12_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))[0]
