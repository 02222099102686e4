import functools
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import conversations as C

WHITE = " \t\n\x0b\x0c\r"


def brute(rows):
    """The contract by exhaustive search, over rows (role, text) in order."""
    seen, faults = set(), []
    for role, text in rows:
        bare = text.rstrip(WHITE)
        faults.append("b" if not bare else "d" if (role, text) in seen else "" if bare[-1] in ".!?" else "t")
        seen.add((role, text))
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}

    @functools.lru_cache(maxsize=None)
    def best(i, last, put):
        """(cost, audit, lines) of the rest; `put` insertions may still stand here."""
        ways = []
        if i == len(rows) and last in ("", "a"):
            ways.append((0, "", ()))
        if put:
            for x in follow[last].replace("s", ""):
                c, a, o = best(i, x, put - 1)
                ways.append((c + 2, "I" + a, (C.ROLES[x] + ":",) + o))
        if i < len(rows):
            (role, text), fault = rows[i], faults[i]
            c, a, o = best(i + 1, last, 3)
            ways.append((c + 3, "D" + a, o))
            if fault not in ("b", "d"):
                more = fault == "t"
                if role[:1] and role[:1] in follow[last]:
                    c, a, o = best(i + 1, role[0], 3)
                    ways.append((c + more, "K" + a, (f"{role}:{text}",) + o))
                for x in follow[last].replace("s", ""):
                    c, a, o = best(i + 1, x, 3)
                    ways.append((c + 2 + more, "R" + a, (f"{C.ROLES[x]}:{text}",) + o))
        return min(ways, key=lambda w: w[:2], default=(10**9, "", ()))

    cost, audit, lines = best(0, "", 3)
    illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest() if lines else hashlib.sha256().hexdigest()


def told(verdicts, repaired):
    lines = {}
    for r in sorted(repaired.collect(), key=lambda r: (r.begin, r.place, r.sub)):
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    return {r.conv_id: (r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, hashlib.sha256("\n".join(lines.get(r.conv_id, [])).encode()).hexdigest()) for r in verdicts.collect()}


@pytest.mark.parametrize("piece", [512, 3])
def test_against_exhaustive_search(spark, piece):
    r = random.Random(5)
    roles, texts = ["user", "assistant", "system", "tool", "", "user", "assistant", None], ["Hi.", "So", "", " \t", "What?", "Yes!\n", None, "é…"]
    rows = [(c if c else None, t, r.choice(roles), r.choice(texts) if r.random() < 0.6 else f"{c} {t}.") for c in range(120) for t in range(r.randint(0, 11))]
    df = spark.createDataFrame(rows, "conv_id int, turn long, role string, text string").withColumn("c", F.lit(1)).withColumn("place", F.lit("x"))
    got = told(*C.repair(df, piece=piece, batch=40))
    want = {}
    for c, _, role, text in rows:
        want.setdefault(c, []).append((" " if role is None else role, " " if text is None else text))
    assert got == {c: brute(tuple(x)) for c, x in want.items()}


def test_one_conversation_holds_most_rows(spark):
    rows = [(7, t, ["user", "assistant"][t % 2 ^ (t % 50 == 0)], f"{t // 3 if t % 10 == 0 else t}.") for t in range(3000)] + [(c, 0, "user", "x.") for c in range(20, 60)]
    verdicts, repaired = C.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), piece=64, batch=256)
    got = told(verdicts, repaired)
    # the exhaustive search is too deep for this one: legality and cost by the audit itself
    v = verdicts.filter("conv_id = 7").first()
    assert len(v.audit.replace("I", "")) == 3000 and got[20][5] == "KI" and got[20][4] == 2
    assert v.cost == 3 * v.audit.count("D") + 2 * v.audit.count("R") + 2 * v.audit.count("I") and v.gaps == 0
    roles = [r.role[0] for r in sorted(repaired.filter("conv_id = 7").collect(), key=lambda r: (r.place, r.sub))]
    assert roles == ["u", "a"] * (len(roles) // 2)
    whole = told(*C.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    assert whole == got


def test_rows_of_one_turn_nulls_and_repeats(spark):
    rows = [(1, None, "user", "a."), (1, 0, "assistant", "b."), (1, 0, "assistant", "b."), (1, 5, "user", "c."), (1, 5, "assistant", "d."), (2, None, None, None), (2, None, None, None)] + [(3, 1, "user", "q.")] * 50
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    a, b = ({r.conv_id: r for r in C.repair(d)[0].collect()} for d in (df, df.repartition(7)))
    assert a == b and (a[1].gaps, a[1].duplicate, a[2].gaps, a[2].blank, a[2].audit, a[3].duplicate) == (4, 1, 0, 2, "DD", 49)


def test_empty(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert [d.count() for d in C.repair(empty)] == [0, 0]


def test_damage(spark):
    import zlib

    rows = [(c, t, "assistant", "a. b! c?") for c in range(40) for t in (None, *range(9))] + [(None, 3, None, None)]
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        row = (c, t, "user" if kind == 4 else role or " ", "" if kind == 1 else (text or " ").translate({ord(x): None for x in ".!?"}) if kind == 2 else text or " ")
        want += [] if kind == 0 else [row] * (2 if kind == 3 else 1)
    got = [tuple(r) for r in C.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_every_conversation_is_told(spark, sf):
    out = C.op11_conversations(spark, sf)
    given = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id").distinct().count()
    assert out.count() == given and out.filter("audit = ''").filter(f"repaired_sha256 <> '{hashlib.sha256().hexdigest()}'").isEmpty()
