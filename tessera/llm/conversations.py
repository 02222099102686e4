"""Conversation structure repair: a DuckDB recursion in hash-partitioned batches takes all conversations on by one turn, with the cheapest edits to each state of a grammar."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tessera.llm.common import WHITE, placed, saved, shipped, table

#: The grammar (s?(ua)+)? by role initials: states 0 (nothing yet), 1 (after s), 2 (after u), 3 (after a); it may end in 0 and 3.
MOVES = [(0, "s", 1), (0, "u", 2), (1, "u", 2), (2, "a", 3), (3, "u", 2)]
LAST = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
#: A kept s is written L within this module, where letters alone must say the state; both stand between I and R, and never beside each other at one row.
KEPT = {"s": "L"}
#: What edits cost; a truncated row that stays costs CUT more.
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1


def inserts(state: int) -> list[tuple[int, str, int]]:
    """(state, letters, cost): where insertions lead, itself included; going in a circle is never cheapest."""
    out, seen, now = [(state, "", 0)], {state}, state
    while step := next((m for m in MOVES if m[0] == now and m[1] in ROLES), None):
        now = step[2]
        if now in seen:
            break
        seen.add(now)
        out.append((now, out[-1][1] + "I", out[-1][2] + INSERT))
    return out


def steps() -> list[tuple[int, str | None, int, str, int, bool]]:
    """(state, initial that the row must have, next state, letters, cost, whether the row stays): some insertions, then one edit of the row."""
    out = []
    for state in range(4):
        for mid, letters, cost in inserts(state):
            out.append((state, None, mid, letters + "D", cost + DELETE, False))
            for at, initial, to in MOVES:
                if at == mid:
                    out.append((state, initial, to, letters + KEPT.get(initial, "K"), cost + KEEP, True))
                    if initial in ROLES:
                        out.append((state, None, to, letters + "R", cost + REROLE, True))
    return out


def _listed(rows: list[tuple]) -> str:
    say = lambda x: "NULL" if x is None else repr(x) if isinstance(x, str) else str(x)
    return "(VALUES " + ", ".join("(" + ", ".join(map(say, r)) + ")" for r in rows) + ")"


#: rows_ (piece, k, initial, fault, opens): pieces of conversations, turn by turn. A piece that doesn't open its conversation begins in any state.
WALK = f"""
WITH RECURSIVE steps(state, need, next, letters, cost, stays) AS {_listed(steps())},
walk(piece, k, start, state, best) AS (
    SELECT piece, 0, s.start, s.start, {{'cost': 0::BIGINT, 'audit': ''}} FROM rows_ JOIN (SELECT unnest(range(4))::INT AS start) s ON s.start = 0 OR NOT opens WHERE k = 0
    UNION ALL
    SELECT w.piece, w.k + 1, w.start, t.next, min({{'cost': w.best.cost + t.cost + CASE WHEN t.stays AND r.fault = 't' THEN {CUT} ELSE 0 END, 'audit': w.best.audit || t.letters}})
    FROM walk w JOIN rows_ r ON r.piece = w.piece AND r.k = w.k JOIN steps t ON t.state = w.state AND (t.need IS NULL OR t.need = r.initial) AND NOT (t.stays AND r.fault IN ('b', 'd'))
    GROUP BY ALL)
SELECT piece, start, state, best.cost AS cost, best.audit AS audit FROM walk JOIN (SELECT piece, max(k) + 1 AS k FROM rows_ GROUP BY piece) USING (piece, k) ORDER BY piece, start, state
"""
INSIDE = """
SELECT piece, count(*) FILTER (k > 0 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, arg_min(initial, k) AS first, arg_max(initial, k) AS last
FROM (SELECT *, lag(initial) OVER (PARTITION BY piece ORDER BY k) AS before FROM rows_) GROUP BY piece ORDER BY piece
"""
#: ways (conv, place, start, state, cost, audit, illegal, first, last): what the pieces of each conversation come to, piece by piece.
CHAIN = f"""
WITH RECURSIVE ends(state, letters, cost) AS {_listed([(s, letters, cost) for s in range(4) for to, letters, cost in inserts(s) if to in LAST])},
numbered AS (SELECT *, dense_rank() OVER (PARTITION BY conv ORDER BY place) - 1 AS k FROM ways),
walk(conv, k, state, best) AS (
    SELECT DISTINCT conv, 0, 0, {{'cost': 0::BIGINT, 'audit': ''}} FROM ways
    UNION ALL
    SELECT w.conv, w.k + 1, n.state, min({{'cost': w.best.cost + n.cost, 'audit': w.best.audit || n.audit}}) FROM walk w JOIN numbered n ON n.conv = w.conv AND n.k = w.k AND n.start = w.state GROUP BY ALL),
whole AS (SELECT conv, max(k) + 1 AS k FROM numbered GROUP BY conv),
best AS (SELECT conv, min({{'cost': best.cost + e.cost, 'audit': best.audit || e.letters}}) AS best FROM walk JOIN whole USING (conv, k) JOIN ends e USING (state) GROUP BY conv),
borders AS (
    SELECT conv, CAST(sum(illegal + CASE WHEN before || first NOT IN ('su', 'ua', 'au') THEN 1 ELSE 0 END) AS BIGINT) AS illegal
    FROM (SELECT *, lag(last) OVER (PARTITION BY conv ORDER BY k) AS before FROM (SELECT DISTINCT conv, k, illegal, first, last FROM numbered)) GROUP BY conv)
SELECT conv, illegal, best.cost AS cost, best.audit AS audit FROM best JOIN borders USING (conv) ORDER BY conv
"""


def _asked(query: str, name: str, rows: pa.Table) -> pa.Table:
    with duckdb.connect(config={"threads": 1, "memory_limit": "700MB", "temp_directory": ""}) as db:
        db.register("given", rows)
        db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        return db.sql(query).to_arrow_table()


def _pieces(t: pa.Table) -> pa.Table:
    """The ways through the pieces of a batch of rows (c, place, w, initial, fault, opens)."""
    t = t.sort_by("place")
    w, opens = t.column("w").to_numpy(), t.column("opens").to_numpy(zero_copy_only=False)
    begins = np.flatnonzero(opens | (np.diff(w, prepend=-1) != 0))
    piece = np.cumsum(np.isin(np.arange(len(w)), begins)) - 1
    rows = pa.table({"piece": piece.astype(np.int32), "k": (np.arange(len(w)) - begins[piece]).astype(np.int32), "initial": t.column("initial"), "fault": t.column("fault"), "opens": opens})
    ways, inside = _asked(WALK, "rows_", rows), _asked(INSIDE, "rows_", rows)
    of = ways.column("piece").to_numpy()
    told = {c: inside.column(c).take(pa.array(of)) for c in ("illegal", "first", "last")}
    return pa.table({"c": t.column("c").take(pa.array(begins[of])), "place": t.column("place").take(pa.array(begins[of])), "opens": opens[begins[of]], **{c: ways.column(c) for c in ("start", "state", "cost", "audit")}, **told})


def _chained(t: pa.Table) -> pa.Table:
    """The cheapest edits of each conversation of a batch of ways; `begin` is its first place."""
    t = t.sort_by("place")
    first = np.flatnonzero(t.column("opens").to_numpy(zero_copy_only=False))
    place = t.column("place").to_numpy()
    # conversations don't overlap, so a piece belongs to the last one that opened
    begin = place[first]
    conv = np.searchsorted(begin, place, side="right") - 1
    begins, index = np.unique(begin, return_index=True)
    ways = t.drop(["c", "opens"]).append_column("conv", pa.array(np.searchsorted(begins, begin[conv])))
    done = _asked(CHAIN, "ways", ways)
    of = done.column("conv").to_numpy()
    return pa.table({"c": t.column("c").take(pa.array(first[index][of])), "begin": begins[of], **{c: done.column(c) for c in ("illegal", "cost", "audit")}})


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (c, begin, audit): (c, begin, place, sub, role) of every row that stays or is put in; role is null where it is kept, sub below 9 where it is put in."""
    for b in batches:
        for row in range(b.num_rows):
            begin, audit = b.column(1)[row].as_py(), b.column(2)[row].as_py()
            place, sub, state = begin, 0, 0
            for cut in range(0, len(audit), 4096):
                out: list[tuple[int, int, str | None]] = []
                for letter in audit[cut:cut + 4096]:
                    if letter != "D":  # kept or put in: the state says as what, but for a kept first row, which is L or u
                        initial = "s" if letter == "L" else "a" if state == 2 else "u"
                        out.append((place, sub if letter == "I" else 9, ROLES[initial] if letter in "IR" else None))
                        state = {"s": 1, "u": 2, "a": 3}[initial]
                    place, sub = (place, sub + 1) if letter == "I" else (place + 1, 0)
                columns = [b.column(0).take(pa.array([row] * len(out), pa.int64())), pa.array([begin] * len(out), pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int64(), pa.int32(), pa.string())))], names=["c", "begin", "place", "sub", "role"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (c, begin, line) in order: (c, sha) of each conversation's lines, joined by newlines; a conversation of any length passes through in pieces."""
    now, of, state = None, None, hashlib.sha256()
    for b in batches:
        done = []
        for i, (begin, line) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
            if begin != now:
                if now is not None:
                    done.append((of, state.hexdigest()))
                now, of, state = begin, b.column(0).slice(i, 1), hashlib.sha256(line.encode())
            else:
                state.update(b"\n" + line.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([x[0] for x in done]), pa.array([x[1] for x in done])], names=["c", "sha"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([of, pa.array([state.hexdigest()])], names=["c", "sha"])


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", piece: int = 512, batch: int = 8192) -> tuple[DataFrame, DataFrame]:
    """(verdicts, repaired): a row a conversation, and the rows of the repaired conversations.

    verdicts: the conversation's id, gaps, blank, duplicate, truncated, illegal, cost, audit. repaired: its id, place and sub
    (which order it), turn (null where put in), role, text.

    A conversation's rows go by turn (nulls first); rows of one turn by role and a hash of role and text, so in the same order each
    time. A row's first fault counts: blank (nothing but white space), duplicate (role and text are those of an earlier row),
    truncated (its last other sign is none of . ! ?). The cheapest edits make the role initials s?(ua)+ or nothing: Keep, Rerole
    (user or assistant), Delete (of blank and duplicate rows always), Insert (an empty user or assistant turn). audit: their
    initials in order; of equally cheap ones the least by ASCII. gaps: turns missing between the least and the largest, 0
    where all are null. illegal: neighbours whose role initials are none of su, ua, au. Null role and text count as one
    space, a null id as an id. Conversations without rows aren't there. Empty input: empty tables.

    Rows, without their texts, are numbered in order over range partitions (identical ones told apart by chance); what is done
    by row is joined on these places, so no key is hot. A conversation's rows within one run of `piece` places are a piece;
    pieces are dealt by hash into batches of about `batch` rows, in each of which a DuckDB recursion takes all pieces on by one
    turn, from every state that they can begin in. A second recursion goes from piece to piece of a conversation. So one
    of a third of all rows is spread over tasks too; only its outcome (a letter a row) stands in one row. Texts meet their rows once,
    the copies of a row being one there.
    """
    blank = F.lit(" ")
    base = rows.select(F.col(f"`{conv_col}`").alias("c"), F.col(f"`{turn_col}`").cast("long").alias("turn"), F.coalesce(F.col(f"`{role_col}`").cast("string"), blank).alias("role"), F.coalesce(F.col(f"`{text_col}`").cast("string"), blank).alias("text"))
    base = base.withColumn("h1", F.xxhash64("role", "text")).withColumn("h2", F.xxhash64(F.lit(1), "text", "role"))
    bare = F.rtrim("text", F.lit(WHITE))
    fault = F.when(bare == "", "b").when(F.substring(bare, -1, 1).isin(".", "!", "?"), "").otherwise("t")
    slim = base.select("c", "turn", "role", "h1", "h2", fault.alias("fault"), F.rand(7).alias("chance"))
    n = rows.count()
    s = placed(slim, ["c", "turn", "role", "h1", "h2", "chance"], rows=n).drop("chance")
    kind = s.schema["c"].dataType
    schema = lambda ddl: StructType([StructField("c", kind), *StructType.fromDDL(ddl).fields])

    firsts = s.groupBy("c", "h1", "h2").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("is_first"))
    opening = s.groupBy("c").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("opens"))
    marked = s.join(firsts, "place", "left").join(opening, "place", "left").withColumn("opens", F.coalesce("opens", F.lit(False)))
    marked = marked.withColumn("fault", F.when((F.col("fault") != "b") & F.col("is_first").isNull(), "d").otherwise(F.col("fault")))
    marked = saved(marked.select("c", "turn", "place", F.substring("role", 1, 1).alias("initial"), "fault", "opens", F.floor(F.col("place") / piece).alias("w")))
    many = max(1, -(-n // batch))
    dealt = marked.select("c", "place", "w", "initial", "fault", "opens", F.pmod(F.xxhash64("c", "w"), F.lit(many)).alias("batch"))
    ways = shipped(dealt).groupBy("batch").applyInArrow(lambda t: _pieces(t.drop(["batch"])), schema("place long, opens boolean, start int, state int, cost long, audit string, illegal long, first string, last string"))
    ways = ways.withColumn("batch", F.pmod(F.xxhash64("c"), F.lit(many)))
    chained = saved(ways.groupBy("batch").applyInArrow(lambda t: _chained(t.drop(["batch"])), schema("begin long, illegal long, cost long, audit string")))

    count = lambda k: F.count_if(F.col("fault") == k)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0))
    stats = marked.groupBy("c").agg(gaps.alias("gaps"), count("b").alias("blank"), count("d").alias("duplicate"), count("t").alias("truncated"))
    told = chained.select("c", "illegal", "cost", F.translate("audit", "L", "K").alias("audit"))
    verdicts = stats.unionByName(told, allowMissingColumns=True).groupBy("c").agg(*(F.max(c).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")))

    edits = saved(chained.select("c", "begin", "audit").mapInArrow(_edits, schema("begin long, place long, sub int, role string")))
    stay = edits.filter("sub = 9").withColumnRenamed("role", "new").drop("c").join(s.select("c", "turn", "role", "h1", "h2", "place"), "place")
    texts = base.select(F.col("c").alias("c0"), F.col("turn").alias("turn0"), F.col("h1").alias("a"), F.col("h2").alias("b"), "text").dropDuplicates(["c0", "turn0", "a", "b"])
    met = stay.join(texts, F.col("c").eqNullSafe(F.col("c0")) & F.col("turn").eqNullSafe(F.col("turn0")) & (F.col("h1") == F.col("a")) & (F.col("h2") == F.col("b")))
    met = met.select("c", "begin", "place", "sub", "turn", F.coalesce("new", "role").alias("role"), "text")
    put = edits.filter("sub < 9").select("c", "begin", "place", "sub", F.lit(None).cast("long").alias("turn"), "role", F.lit("").alias("text"))
    named = lambda df: df.withColumnRenamed("c", conv_col)
    return named(verdicts), named(met.unionByName(put))


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with faults put in, by the crc32 of conv_id:turn modulo 20; null role and text become one space."""
    space = F.lit(" ")
    part = lambda c: F.coalesce(F.col(c).cast("string"), space)
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    role, text = F.when(kind == 4, "user").otherwise(part("role")), F.when(kind == 1, "").when(kind == 2, F.translate(part("text"), ".!?", "")).otherwise(part("text"))
    out = conversations.filter(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(1).alias("times"))
    return out.withColumn("times", F.explode(F.array_repeat(F.lit(0), F.col("times")))).drop("times")


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    verdicts, repaired = repair(damaged(given))
    line = repaired.select(F.col("conv_id").alias("c"), "begin", F.concat("role", F.lit(":"), "text").alias("line"), "place", "sub")
    ordered = line.repartition("begin").sortWithinPartitions("begin", "place", "sub").select("c", "begin", "line")
    digests = shipped(ordered).mapInArrow(_digests, StructType([StructField("c", line.schema["c"].dataType), *StructType.fromDDL("sha string").fields])).withColumnRenamed("c", "conv_id")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    all_ = given.select("conv_id").unionByName(verdicts, allowMissingColumns=True).unionByName(digests, allowMissingColumns=True)
    some = all_.groupBy("conv_id").agg(*(F.coalesce(F.max(c), F.lit(0)).alias(c) for c in numbers), F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.max("sha").alias("sha"))
    return some.select("conv_id", *numbers, "audit", F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


#: One recursion over whole conversations, which carries the repaired text as well.
ORACLE = r"""
WITH RECURSIVE keyed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS s FROM conversations),
folded AS (
    SELECT *, xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(1, length(s) + 1), lambda i: CAST(ascii(s[i:i]) AS BIGINT))),
        lambda c, x: list_reduce(list_concat([xor(c, x)], range(8)), lambda v, m: xor(v // 2, (v % 2) * 3988292384)))) % 20 AS kind FROM keyed),
damaged AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
        unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM folded WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS k, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth FROM damaged),
faulty AS (
    SELECT *, substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS before, CASE
        WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 'truncated' ELSE '' END AS fault
    FROM placed),
moves(state, initial, next) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
put(state, next, audit, said, cost) AS (VALUES
    (0, 0, '', '', 0), (1, 1, '', '', 0), (2, 2, '', '', 0), (3, 3, '', '', 0), (0, 2, 'I', 'user:' || chr(10), 2), (1, 2, 'I', 'user:' || chr(10), 2), (3, 2, 'I', 'user:' || chr(10), 2),
    (2, 3, 'I', 'assistant:' || chr(10), 2), (0, 3, 'II', 'user:' || chr(10) || 'assistant:' || chr(10), 4), (1, 3, 'II', 'user:' || chr(10) || 'assistant:' || chr(10), 4)),
ways AS (
    SELECT f.conv_id, f.k, p.state, p.next AS mid, p.audit AS put, p.said AS before, p.cost, f.role, f.text, f.initial, f.fault FROM faulty f, put p),
choices AS (
    SELECT conv_id, k, state, mid AS next, cost + 3 AS cost, put || 'D' AS audit, before AS said FROM ways
    UNION ALL
    SELECT w.conv_id, w.k, w.state, m.next, w.cost + CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END, put || 'K', before || role || ':' || text || chr(10)
    FROM ways w JOIN moves m ON m.state = w.mid AND m.initial = w.initial WHERE fault NOT IN ('blank', 'duplicate')
    UNION ALL
    SELECT w.conv_id, w.k, w.state, m.next, w.cost + 2 + CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END, put || 'R', before || CASE m.initial WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text || chr(10)
    FROM ways w JOIN moves m ON m.state = w.mid AND m.initial IN ('u', 'a') WHERE fault NOT IN ('blank', 'duplicate')),
walk(conv_id, k, state, best) AS (
    SELECT DISTINCT conv_id, CAST(1 AS BIGINT), 0, {'cost': 0, 'audit': '', 'said': ''} FROM faulty
    UNION ALL
    SELECT w.conv_id, w.k + 1, c.next, min({'cost': w.best.cost + c.cost, 'audit': w.best.audit || c.audit, 'said': w.best.said || c.said})
    FROM walk w JOIN choices c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.k = w.k AND c.state = w.state GROUP BY ALL),
stats AS (
    SELECT conv_id, max(k) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
        count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (k > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id),
ended AS (
    SELECT w.conv_id, min({'cost': w.best.cost + p.cost, 'audit': w.best.audit || p.audit, 'said': w.best.said || p.said}) AS best
    FROM walk w JOIN stats s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND w.k = s.n + 1 JOIN put p ON p.state = w.state AND p.next IN (0, 3) GROUP BY w.conv_id)
SELECT g.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
    CAST(coalesce(e.best.cost, 0) AS BIGINT) AS cost, coalesce(e.best.audit, '') AS audit, sha256(coalesce(left(e.best.said, greatest(0, length(e.best.said) - 1)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) g LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM g.conv_id
"""
