"""Queries of the general problems 1, 2 and 6, over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import eager, parse, profile
from ..shared import table

#: Every text column of output_record; those without a form are profiled without malformed counts.
ALL_SPECS = profile.OUTCOME_SPECS + tuple(
    profile.ColumnSpec(c)
    for c in ("id", "sourceurl", "pageurl", "docordataseturl", "wasurlchecked", "wasdocumentordatasetaccessible", "wasdirectlink", "couldretry", "filepath", "error")
)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return profile.found(table(spark, d, "output_record"))


def p1_profile(spark: SparkSession, d: str) -> DataFrame:
    return profile.profile(table(spark, d, "output_record"), ALL_SPECS)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return parse.failed(parse.read_lines(table(spark, d, "sample_input_raw"))).select("line_no", "reason")


def p2_valid(spark: SparkSession, d: str) -> DataFrame:
    return parse.valid(parse.read_lines(table(spark, d, "sample_input_raw")))


def p2_errors(spark: SparkSession, d: str) -> DataFrame:
    """Located errors per file and reason."""
    bad = parse.failed(parse.read_lines(table(spark, d, "sample_input_raw")))
    return bad.groupBy("file_name", "reason").agg(F.count(F.lit(1)).alias("n_lines"), F.min("line_no").alias("first_line"))


def p2_files(spark: SparkSession, d: str) -> DataFrame:
    """Records per file and reason (NULL: valid) when the raw files, rebuilt in parts of 1000 line numbers, are read as such:
    blank lines are no records there, and a quoted field may span lines."""
    t = table(spark, d, "sample_input_raw").select("file_name", "line_format", "line_no", "line", F.floor(F.col("line_no") / 1000).alias("block"))
    first = t.groupBy("file_name").agg(F.min("block").alias("first"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: F.concat(F.coalesce(x["line"], F.lit("")), F.lit("\n")))
    parts = t.groupBy("file_name", F.col("line_format").alias("file_format"), "block").agg(F.array_join(lines, "").alias("content"))
    parts = parts.join(first, "file_name").withColumn("part_no", F.col("block") - F.col("first"))
    return parse.read_parts(parts).groupBy("file_name", "reason").agg(F.count(F.lit(1)).alias("n_records"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    # combined counts are never negative; asking for them keeps the join of the states in the plan
    return p6_hot(spark, d).filter("joined_n >= 0").select("field_name", "key_value")


def p6_hot(spark: SparkSession, d: str) -> DataFrame:
    """All totals of the hot values."""
    return _named(eager.hot(table(spark, d, "output_record"), table(spark, d, "sample_input"), table(spark, d, "earlier_key")))


def _named(t: DataFrame) -> DataFrame:
    return t.select("field_name", "key_value", F.col("n").alias("n_rows"), "found_n", "found_share", "total_size", F.col("right_n").alias("n_requests"), "joined_n", "joined_total_size")


def p6_totals(spark: SparkSession, d: str) -> DataFrame:
    return _named(eager.totals(table(spark, d, "output_record"), table(spark, d, "sample_input"), table(spark, d, "earlier_key")))


def p6_by_provider(spark: SparkSession, d: str) -> DataFrame:
    """Rows that a join of outcomes and requests on the url would have, rolled up per provider."""
    left = eager.compact(table(spark, d, "output_record").select(F.col("sourceurl").alias("url"), F.expr("wasdocumentordatasetaccessible = 'true'").alias("ok")), ["url"], counts={"ok_n": F.col("ok")})
    right = eager.compact(table(spark, d, "sample_input").select("url", F.coalesce("provider", F.lit("(none)")).alias("provider")), ["url", "provider"])
    l, r = left.alias("l"), right.alias("r")
    joined = l.join(r, F.col("l.url") == F.col("r.url")).select("r.provider", (F.col("l.n") * F.col("r.n")).alias("joined_rows"), (F.col("l.ok_n") * F.col("r.n")).alias("joined_ok"))
    return eager.roll_up(joined, ["provider"], ["joined_rows", "joined_ok"])


QUERIES = {f.__name__: f for f in (p1_found, p1_profile, p2_found, p2_valid, p2_errors, p2_files, p6_found, p6_hot, p6_totals, p6_by_provider)}

_SIZE = "regexp_full_match(filesize, '[1-9][0-9]{0,8}') AND TRY_CAST(filesize AS BIGINT) <= 536870912"

_FORMS = {
    "wasurlvalid": "v IN ('true', 'false')", "filehash": "regexp_full_match(v, '[0-9a-f]{32}')", "filesize": _SIZE.replace("filesize", "v"),
    "mimetype": "(v = 'unspecified' OR regexp_full_match(v, '[a-z0-9.+-]+/[a-z0-9.+-]+')) AND length(v) <= 255",
}
_CELLS = " UNION ALL ".join(f"SELECT load_id, '{s.name}' AS column_name, nullif({s.name}, 'null') AS v FROM output_record" for s in ALL_SPECS)
_OK = "CASE column_name " + " ".join(f"WHEN '{c}' THEN {f}" for c, f in _FORMS.items()) + " ELSE true END"
_RANKS = {"min_value": "1", "q25": "ceil((n_rows - n_missing) * 0.25)", "q50": "ceil((n_rows - n_missing) * 0.5)", "q75": "ceil((n_rows - n_missing) * 0.75)", "max_value": "n_rows - n_missing"}

_TOTALS = f"""
WITH v AS (SELECT 'sourceurl' AS field_name, sourceurl AS key_value, * FROM output_record UNION ALL SELECT 'docordataseturl', docordataseturl, * FROM output_record),
t AS (SELECT field_name, key_value, count(*) AS n_rows,
  count(*) FILTER (wasdocumentordatasetaccessible = 'true' AND docordataseturl LIKE 'http%') AS found_n,
  coalesce(sum(CASE WHEN {_SIZE} THEN TRY_CAST(filesize AS BIGINT) END), 0)::BIGINT AS total_size
  FROM v WHERE key_value IS NOT NULL AND key_value <> 'null' GROUP BY ALL),
r AS (SELECT field_name, key_value, count(*) AS n FROM (SELECT 'sourceurl' AS field_name, url AS key_value FROM sample_input
  UNION ALL SELECT 'docordataseturl', key_value FROM earlier_key WHERE key_kind = 'url') GROUP BY ALL)
SELECT field_name, key_value, n_rows, found_n, found_n / n_rows AS found_share, total_size, coalesce(r.n, 0) AS n_requests,
  n_rows * coalesce(r.n, 0) AS joined_n, total_size * coalesce(r.n, 0) AS joined_total_size
FROM t LEFT JOIN r USING (field_name, key_value)"""

SQL = {
    "p1_profile": f"""WITH cell AS ({_CELLS}),
f AS (SELECT *, v IS NULL AS gone, v IS NOT NULL AND NOT ({_OK}) AS broken FROM cell),
g AS (SELECT column_name, load_id, v, gone, CASE WHEN column_name = 'filesize' AND NOT gone AND NOT broken THEN v::DOUBLE END AS num, count(*) AS c, sum(broken::INT)::BIGINT AS b FROM f GROUP BY ALL),
w AS (SELECT *, sum(c) OVER (PARTITION BY column_name, load_id ORDER BY gone DESC, num NULLS FIRST, v NULLS FIRST)::BIGINT AS cl, sum(c) OVER (PARTITION BY column_name ORDER BY gone DESC, num NULLS FIRST, v NULLS FIRST)::BIGINT AS ca,
  sum(c) OVER (PARTITION BY column_name, gone, num, v)::BIGINT AS vc, sum(c) OVER (PARTITION BY column_name, load_id)::BIGINT AS nl, sum(c) OVER (PARTITION BY column_name)::BIGINT AS na FROM g),
k AS (SELECT *, greatest(abs(cl / nl - (ca - cl) / nullif(na - nl, 0)), abs((cl - c) / nl - (ca - vc - cl + c) / nullif(na - nl, 0))) AS ks FROM w),
p AS (SELECT column_name, load_id, max(nl) AS n_rows, coalesce(sum(c) FILTER (gone), 0)::BIGINT AS n_missing, count(*) FILTER (NOT gone) AS n_distinct, sum(b)::BIGINT AS n_malformed, min(num) AS min_number, max(num) AS max_number, max(ks) AS ks_distance FROM k GROUP BY ALL)
SELECT p.column_name, p.load_id, n_rows, n_missing, n_missing / n_rows AS missing_rate, n_distinct, min_number, max_number, n_malformed, ks_distance,
  {', '.join(f"(max(v) FILTER (NOT gone AND cl - c < n_missing + {r} AND n_missing + {r} <= cl)) AS {n}" for n, r in _RANKS.items())}
FROM p JOIN k ON k.column_name = p.column_name AND k.load_id IS NOT DISTINCT FROM p.load_id GROUP BY ALL""",
    "p1_found": f"""
WITH cell AS (
  SELECT record_id, load_id, 'wasurlvalid' AS column_name, nullif(wasurlvalid, 'null') AS v FROM output_record
  UNION ALL SELECT record_id, load_id, 'filehash', nullif(filehash, 'null') FROM output_record
  UNION ALL SELECT record_id, load_id, 'filesize', nullif(filesize, 'null') FROM output_record
  UNION ALL SELECT record_id, load_id, 'mimetype', nullif(mimetype, 'null') FROM output_record),
bad AS (
  SELECT record_id, load_id, column_name FROM cell WHERE v IS NOT NULL AND NOT CASE column_name
    WHEN 'wasurlvalid' THEN v IN ('true', 'false')
    WHEN 'filehash' THEN regexp_full_match(v, '[0-9a-f]{{32}}')
    WHEN 'filesize' THEN {_SIZE.replace('filesize', 'v')}
    ELSE (v = 'unspecified' OR regexp_full_match(v, '[a-z0-9.+-]+/[a-z0-9.+-]+')) AND length(v) <= 255 END),
klass AS (
  SELECT load_id, column_name, CASE WHEN v IS NULL THEN 'missing' WHEN column_name = 'filehash' THEN 'v' WHEN column_name = 'filesize' THEN 'v' || length(v) ELSE 'v' || v END AS k FROM cell),
per AS (SELECT load_id, column_name, k, count(*) AS n FROM klass GROUP BY ALL),
tot AS (SELECT column_name, k, sum(n) AS n FROM per GROUP BY ALL),
loads AS (SELECT load_id, count(*) AS n FROM output_record GROUP BY ALL),
al AS (SELECT count(*) AS n FROM output_record)
SELECT 'violation' AS finding, load_id, column_name, record_id FROM bad
UNION ALL
SELECT DISTINCT 'shift', l.load_id, t.column_name, 0 FROM tot t CROSS JOIN loads l CROSS JOIN al a
LEFT JOIN per p ON p.load_id = l.load_id AND p.column_name = t.column_name AND p.k = t.k
WHERE a.n > l.n AND abs(coalesce(p.n, 0)::HUGEINT * (a.n - l.n) - (t.n - coalesce(p.n, 0))::HUGEINT * l.n) * 100 > 15 * l.n::HUGEINT * (a.n - l.n)""",
    "p6_found": """
WITH v AS (SELECT 'sourceurl' AS field_name, sourceurl AS key_value FROM output_record UNION ALL SELECT 'docordataseturl', docordataseturl FROM output_record)
SELECT field_name, key_value FROM v WHERE key_value IS NOT NULL AND key_value <> 'null'
GROUP BY ALL HAVING count(*) * 100 > (SELECT count(*) FROM output_record)""",
    "p6_hot": f"SELECT * FROM ({_TOTALS}) WHERE n_rows * 100 > (SELECT count(*) FROM output_record)",
    "p6_totals": _TOTALS,
    "p6_by_provider": """
SELECT coalesce(provider, '(none)') AS provider, count(*) AS joined_rows, count(*) FILTER (wasdocumentordatasetaccessible = 'true') AS joined_ok
FROM output_record o JOIN sample_input s ON s.url = o.sourceurl GROUP BY ALL""",
}
