import hashlib
from collections import defaultdict

import duckdb

from tessera.llm.line_dedup import ORACLE, line_dedup, op1_line_dedup

WHITE = " \t\n\x0b\x0c\r"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=40, docs=5):
    holders = defaultdict(set)
    for i, t in rows:
        if i is not None:
            for x in (t or "").split("\n"):
                k = x.strip(WHITE).translate(FOLD)
                if len(k) >= least:
                    holders[k].add(i)
    shared = {k: max(v) for k, v in holders.items() if len(v) >= docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if i is None or shared.get(x.strip(WHITE).translate(FOLD), i) == i]
        out.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out, key=repr)


def test_odd_rows_against_brute_force(odd_docs):
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup(odd_docs).collect()]
    want = brute([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert sorted(got, key=repr) == want
    assert sum(r[2] for r in want) > 0


def test_columns_stay_and_are_replaced(odd_docs, no_docs):
    out = line_dedup(odd_docs)
    assert out.columns == [*odd_docs.columns, "n_dropped"] and dict(out.dtypes)["n_lines"] == "bigint"
    assert {r["odd name"] for r in out.collect()} == {"o"}
    assert line_dedup(no_docs).count() == 0


def test_thresholds_and_keeper(spark):
    line = "a" * 40
    df = spark.createDataFrame([(i, f"{line}\n{i}\n{line}") for i in range(5)] + [(9, "b" * 39), (10, "b" * 39)] + [(20 + i, "c" * 39) for i in range(9)], "doc_id long, text string")
    got = {r.doc_id: (r.n_dropped, r.text) for r in line_dedup(df).collect()}
    assert got[4] == (0, f"{line}\n4\n{line}") and got[0] == (2, "0") and got[20] == (0, "c" * 39)


def test_a_hot_line_in_most_rows(spark):
    line = "this line is in every document of the table, whatever else is"
    df = spark.range(3000).selectExpr("id AS doc_id", f"concat('own ', id, '\n{line}') AS text")
    out = line_dedup(df)
    assert out.filter("n_dropped = 1").count() == 2999 and out.filter("doc_id = 2999 and n_dropped = 0").count() == 1


def test_repeated_rows_meet_nowhere(spark):
    """Half of all rows are one document, with a line that few others hold, or that many do."""
    own, shared = "a line that only the repeated document holds, in each of its rows", "a line that each document of this table holds, whatever its id is"
    df = spark.range(4000).selectExpr("if(id % 2 = 0, 7, id) AS doc_id", f"if(id % 2 = 0, '{own}\n{shared}', concat('own ', id, '\n{shared}')) AS text")
    got = line_dedup(df, many=100).groupBy("doc_id", "n_dropped", "text").count().collect()
    by = {(r.doc_id, r.n_dropped, r.text): r["count"] for r in got}
    assert by[7, 1, own] == 2000 and by[3999, 0, f"own 3999\n{shared}"] == 1 and by[9, 1, "own 9"] == 1 and sum(by.values()) == 4000


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = sorted(con.execute(f"SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM ({ORACLE})").fetchall())
    got = sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in op1_line_dedup(spark, sf).collect())
    assert got == want


def test_plan_has_no_python(odd_docs):
    plan = line_dedup(odd_docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert hashlib.sha256(b"").hexdigest() in {r.h for r in line_dedup(odd_docs).selectExpr("sha2(text, 256) AS h").collect()}
