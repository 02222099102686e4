"""Line dedup: lines that many documents share are dropped everywhere but in one document. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import WHITE, ascii_lower, join_skewed, packed, saved, table, unpacked

ORACLE = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT doc_id, pos, line,
             translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, k.pos, k.line, g.key IS NOT NULL AND k.doc_id <> g.keeper AS gone FROM k LEFT JOIN g USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, many: int = 1000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the kept text in text_col, and n_lines and n_dropped.

    A line's key is the line without white space at its ends and with A-Z lower-cased. A key of at least min_chars code
    points that at least min_docs documents hold loses its lines, except in the largest id that holds it.

    Null or empty text: one empty line, kept, and the text ''. A row without an id is no document: its text is kept whole
    and counts for no key. Rows that share an id are one document for counting; each row keeps its own text. Repeats
    within a document count once. Empty input: empty output. Other columns pass; n_lines and n_dropped replace any of
    those names.

    Keys travel as two 64-bit hashes, so two lines are taken for one another with a chance of 2^-128 a pair. The
    count is a two-step aggregate (by key and id, then by key), so a line that a third of all rows hold meets in no task;
    nor do the lines of one document that stands in many rows (`many` at least, to be looked at), nor these rows.
    """
    text = F.coalesce(F.col(f"_tz_{text_col}"), F.lit(""))
    base = packed(docs, id_col, text_col, beside=text_col).select("_tz_row", F.col(f"_tz_{id_col}").alias("_tz_id"), text.alias("_tz_text"))
    base = base.withColumn("_tz_hash", F.xxhash64("_tz_text"))

    lines = base.filter(F.col("_tz_id").isNotNull()).select("_tz_id", "_tz_hash", F.posexplode(F.split("_tz_text", "\n")).alias("_tz_pos", "_tz_line"))
    lines = lines.select("_tz_id", "_tz_hash", "_tz_pos", F.btrim("_tz_line", F.lit(WHITE)).alias("_tz_line")).filter(F.char_length("_tz_line") >= min_chars)
    lines = lines.withColumn("_tz_line", ascii_lower(F.col("_tz_line")))
    keyed = lines.select("_tz_id", "_tz_hash", "_tz_pos", F.xxhash64("_tz_line").alias("_tz_h1"), F.xxhash64(F.lit(1), "_tz_line").alias("_tz_h2"))

    shared = keyed.groupBy("_tz_h1", "_tz_h2").agg(F.count_distinct("_tz_id").alias("_tz_n"), F.max("_tz_id").alias("_tz_keeper"), F.count("*").alias("_tz_rows"))
    shared = shared.filter((F.col("_tz_n") >= min_docs) | (F.col("_tz_rows") >= many)).withColumn("_tz_keeper", F.when(F.col("_tz_n") >= min_docs, F.col("_tz_keeper")))
    met = join_skewed(keyed, saved(shared), ["_tz_h1", "_tz_h2"], "_tz_rows", ["_tz_keeper"], F.xxhash64("_tz_id", "_tz_pos"))
    gone = met.filter(F.col("_tz_keeper") != F.col("_tz_id")).groupBy("_tz_id", "_tz_hash").agg(F.collect_set("_tz_pos").alias("_tz_gone"))

    # rows alike in id and text meet nowhere: they are counted first, and many of them are a hot key
    repeats = base.filter(F.col("_tz_id").isNotNull()).groupBy("_tz_id", "_tz_hash").agg(F.count("*").alias("_tz_rows")).filter("_tz_rows > 1")
    found = saved(gone.join(repeats, ["_tz_id", "_tz_hash"], "full").withColumn("_tz_rows", F.coalesce("_tz_rows", F.lit(1))))
    out = join_skewed(base, found, ["_tz_id", "_tz_hash"], "_tz_rows", ["_tz_gone"]).withColumn("_tz_lines", F.split("_tz_text", "\n"))
    out = out.withColumn("_tz_stay", F.when(F.col("_tz_gone").isNotNull(), F.array_except(F.sequence(F.lit(0), F.size("_tz_lines") - 1), "_tz_gone")))
    kept = F.when(F.col("_tz_stay").isNull(), F.col("_tz_text")).otherwise(F.array_join(F.transform("_tz_stay", lambda p: F.get("_tz_lines", p)), "\n"))
    dropped = F.when(F.col("_tz_stay").isNull(), F.lit(0)).otherwise(F.size("_tz_lines") - F.size("_tz_stay"))
    return unpacked(out, docs, **{text_col: kept, "n_lines": F.size("_tz_lines").cast("long"), "n_dropped": dropped.cast("long")})


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
