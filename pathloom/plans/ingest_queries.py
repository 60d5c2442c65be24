"""Registered queries of the ingest and reader operators, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import plain_key
from ..operators import ingest, ranking
from ..runtime import table
from ..sources import datasets, readers

_KEY = "trim(regexp_replace(query, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'), ' ')"
_OK = "regexp_matches(coalesce(query, ''), '\\S') AND regexp_matches(coalesce(gt_ans, ''), '\\S')"
_ACCEPTED = f"a AS (SELECT raw_id, query, gt_ans, query_metadata.level AS level, query_id, {_KEY} AS key FROM raw_question WHERE {_OK} AND query_metadata.level BETWEEN 1 AND 5 AND query4test IS FALSE)"
_ONE = "m AS (SELECT * FROM manifest QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY prepared_at DESC, global_index DESC) = 1)"
_HASH = "sha256('[42,\"' || sample_id || '\"]')"


def _accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.accepted(ingest.raw_rows(table(spark, sf_dir, "raw_question")))


def _one_per_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.first_by(table(spark, sf_dir, "manifest"), ["sample_id"], F.struct("prepared_at", "global_index"), last=True, keep=["sample_id", "difficulty", "split"])


def ingest_rejects(spark, sf_dir):
    return ingest.reject_counts(ingest.raw_rows(table(spark, sf_dir, "raw_question")))


def _dedup(spark, sf_dir, last):
    return ingest.unique_questions(_accepted(spark, sf_dir), plain_key(F.col("query")), last).select("raw_id", "key", "gt_ans", "level", "query_id")


def ingest_dedup_first(spark, sf_dir):
    return _dedup(spark, sf_dir, False)


def ingest_dedup_last(spark, sf_dir):
    return _dedup(spark, sf_dir, True)


def ingest_conflicts(spark, sf_dir):
    return ingest.answer_conflicts(_accepted(spark, sf_dir), plain_key(F.col("query")))


def ingest_id_conflicts(spark, sf_dir):
    return ingest.id_conflicts(_accepted(spark, sf_dir), plain_key(F.col("query")))


def ingest_hash_split(spark, sf_dir):
    rows = _one_per_sample(spark, sf_dir).select("sample_id", "difficulty")
    return ingest.hash_split(rows).select("sample_id", "difficulty", "position", "global_index", "split")


def ingest_hash_topn(spark, sf_dir):
    return ingest.hash_top(_one_per_sample(spark, sf_dir).select("sample_id", "difficulty"), 100)


def ingest_exclude_run(spark, sf_dir):
    return ingest.excluded(_one_per_sample(spark, sf_dir).select("sample_id", "difficulty", "split"), table(spark, sf_dir, "search_record"))


def ingest_leakage_overlap(spark, sf_dir):
    held = table(spark, sf_dir, "universal_record").select("sample_id", "split").distinct()
    train = F.col("split") == "train"
    return ingest.overlap(held, table(spark, sf_dir, "search_record").filter(train | (F.substring("sample_id", 1, 1) < "4")))  # some held-out records are said to be in train


def ingest_picked(spark, sf_dir):
    rows = ingest.hash_split(_one_per_sample(spark, sf_dir).select("sample_id", "difficulty"))
    return ingest.picked(rows, "global_index", [5, 0, 17, 5]).select("pick", "sample_id", "global_index")


def ingest_one_per_difficulty(spark, sf_dir):
    return ingest.one_per_difficulty(_one_per_sample(spark, sf_dir).select("sample_id", "difficulty"))


def ingest_manifest(spark, sf_dir):
    return ingest.prepare(table(spark, sf_dir, "raw_question"))


def ingest_latest_manifest(spark, sf_dir):
    return ingest.latest_manifest(table(spark, sf_dir, "manifest"), "sample_id", "global_index", "split", "difficulty", "source_query_id")


def manifest_violations(spark, sf_dir):
    return ingest.manifest_violations(table(spark, sf_dir, "manifest"))


def source_strict_lines(spark, sf_dir):
    return readers.checked_lines(table(spark, sf_dir, "raw_line"), "payload", ["line_id"]).select("line_id", "error")


def source_unified(spark, sf_dir):
    raw, line = table(spark, sf_dir, "raw_question"), table(spark, sf_dir, "raw_line")
    ok = readers.checked_lines(line, "payload", ["line_id"]).filter("error is null")
    js = ok.select(F.from_json("payload", "query string, gt_ans string, query_metadata struct<level:int,topic:string>, query_id string").alias("j"))
    columns = ["query", "ref_ans", "level", "topic", "source_id"]
    return readers.unified(
        {
            "raw_question": (raw, {"query": F.col("query"), "ref_ans": F.col("gt_ans"), "level": F.col("query_metadata.level").cast("string"), "source_id": F.col("query_id")}),
            "raw_line": (js, {"query": F.col("j.query"), "ref_ans": F.col("j.gt_ans"), "level": F.col("j.query_metadata.level").cast("string"), "topic": F.col("j.query_metadata.topic"), "source_id": F.col("j.query_id")}),
        },
        columns,
    )


def source_filter_spec(spark, sf_dir):
    _, filters = readers.parse_dataset("questions;level=[2,4];ref_ans=int;sample=0.25")
    rows = table(spark, sf_dir, "raw_question").select("raw_id", F.col("query_metadata.level").alias("level"), F.col("gt_ans").alias("ref_ans"))
    return readers.filtered(rows, filters, "raw_id")


def source_datasets(spark, sf_dir):
    """All families, each with the raw questions under its publisher's column names."""
    raw = table(spark, sf_dir, "raw_question")
    n, level = F.col("raw_id").cast("string"), F.col("query_metadata.level")
    text = lambda x: F.concat(F.lit(x), n)
    parts = {
        "math/train": raw.select(F.col("query").alias("problem"), F.concat(F.lit("So it is \\boxed{"), n, F.lit("}.")).alias("solution"), F.concat(F.lit("Level "), level.cast("string")).alias("level"), F.lit("Number Theory").alias("type")),
        "gsm8k/train": raw.select(F.col("query").alias("question"), F.concat(F.lit("Add.\n#### "), n).alias("answer")),
        "pooled-math/train": raw, "gsm8k-fix/test;ref_ans=int": raw.withColumn("query_metadata", F.struct(level.alias("n_step"))),
        "mwpbench/test": raw.select(F.col("query").alias("question"), F.col("gt_ans").alias("answer"), text("set.part.").alias("data_source"), F.lit("topic.algebra").alias("data_topic")),
        "deepmind-mathematics": raw.select(F.col("query").alias("question"), F.col("gt_ans").alias("answer")),
        "olympiadbench": raw.select(F.col("query").alias("question"), F.lit("Numerical").alias("answer_type"), F.lit(False).alias("is_multiple_answer"), F.lit("").alias("unit"), F.array("gt_ans").alias("final_answer"), F.lit("0.01").alias("error"), F.lit("Geometry").alias("subfield")),
        "theoremqa": raw.select(F.col("query").alias("Question"), F.col("raw_id").alias("Answer")),
        "odyssey-math;level=[2,3]": raw.select(F.col("query").alias("question"), F.col("gt_ans").alias("answer"), F.lit("algebra").alias("label"), level.alias("level")),
        "aops": raw.select(F.col("query").alias("problem"), F.col("gt_ans").alias("answer"), text("thread/").alias("link")),
    }
    return datasets.load(parts).drop("max_n_trials", "min_n_corrects")


def source_inventory(spark, sf_dir):
    return readers.file_inventory(spark, sf_dir, "*.parquet")


QUERIES = (
    ingest_rejects, ingest_dedup_first, ingest_dedup_last, ingest_conflicts, ingest_id_conflicts, ingest_hash_split, ingest_hash_topn, ingest_exclude_run, ingest_leakage_overlap, ingest_picked,
    ingest_one_per_difficulty, ingest_manifest, ingest_latest_manifest, manifest_violations, source_strict_lines, source_unified, source_filter_spec, source_datasets, source_inventory,
)

_DEDUP = "WITH {a} SELECT raw_id, key, gt_ans, level, query_id FROM a QUALIFY row_number() OVER (PARTITION BY key ORDER BY raw_id {dir}) = 1"
SQL = {
    "ingest_rejects": f"""
        SELECT CASE WHEN NOT ({_OK}) THEN 'missing_text' WHEN NOT coalesce(query_metadata.level BETWEEN 1 AND 5, FALSE) THEN 'bad_level'
                    WHEN query4test IS DISTINCT FROM FALSE THEN 'test_source' ELSE 'accepted' END AS reason, count(*) AS n FROM raw_question GROUP BY 1""",
    "ingest_dedup_first": _DEDUP.format(a=_ACCEPTED, dir=""),
    "ingest_dedup_last": _DEDUP.format(a=_ACCEPTED, dir="DESC"),
    "ingest_conflicts": f"WITH {_ACCEPTED} SELECT key, count(*) AS n_rows, count(DISTINCT (gt_ans, level)) AS n_variants FROM a GROUP BY key HAVING count(DISTINCT (gt_ans, level)) > 1",
    "ingest_id_conflicts": f"WITH {_ACCEPTED} SELECT query_id, count(*) AS n_rows, count(DISTINCT key) AS n_questions FROM a WHERE query_id <> '' GROUP BY 1 HAVING count(DISTINCT key) > 1",
    "ingest_hash_split": f"""
        WITH {_ONE}, r AS (SELECT sample_id, difficulty, row_number() OVER (PARTITION BY difficulty ORDER BY {_HASH}) - 1 AS position, count(*) OVER (PARTITION BY difficulty) AS n FROM m)
        SELECT sample_id, difficulty, position, row_number() OVER (ORDER BY difficulty, position) - 1 AS global_index,
               CASE WHEN position < floor(n * 0.625) THEN 'train' WHEN position < floor(n * 0.625) + floor(n * 0.125) THEN 'validation' ELSE 'test' END AS split FROM r""",
    "ingest_hash_topn": f"WITH {_ONE} SELECT sample_id, difficulty, {_HASH} AS hash FROM m ORDER BY hash LIMIT 100",
    "ingest_exclude_run": f"WITH {_ONE} SELECT sample_id, difficulty, split FROM m WHERE sample_id NOT IN (SELECT sample_id FROM search_record WHERE sample_id IS NOT NULL)",
    "ingest_leakage_overlap": "SELECT DISTINCT sample_id, split FROM universal_record WHERE sample_id IN (SELECT sample_id FROM search_record WHERE split = 'train' OR sample_id[1] < '4')",
    "ingest_picked": f"""
        WITH {_ONE}, r AS (SELECT sample_id, row_number() OVER (ORDER BY difficulty, {_HASH}) - 1 AS global_index FROM m)
        SELECT pick::INTEGER AS pick, sample_id, global_index FROM (VALUES (0, 5), (1, 0), (2, 17), (3, 5)) v(pick, global_index) JOIN r USING (global_index)""",
    "ingest_one_per_difficulty": f"""
        WITH {_ONE} SELECT sample_id, difficulty FROM m
        QUALIFY row_number() OVER (PARTITION BY difficulty ORDER BY sha256('[42,' || difficulty || ',"' || sample_id || '"]')) = 1""",
    "ingest_latest_manifest": """
        SELECT sample_id, global_index, split, difficulty, source_query_id FROM manifest
        QUALIFY row_number() OVER (PARTITION BY sample_id, global_index ORDER BY prepared_at DESC, source_query_id DESC) = 1""",
    "manifest_violations": """
        WITH p AS (SELECT difficulty, count(DISTINCT position) AS n, min(position) AS lo, max(position) AS hi, max(position) FILTER (split = 'train') AS t,
                          min(position) FILTER (split = 'validation') AS v0, max(position) FILTER (split = 'validation') AS v1, min(position) FILTER (split = 'test') AS e FROM manifest GROUP BY 1),
             w AS (SELECT count(DISTINCT global_index) AS n, min(global_index) AS lo, max(global_index) AS hi FROM manifest)
        SELECT 'duplicate_sample' AS rule, sample_id AS value, count(*) AS n FROM manifest WHERE sample_id IS NOT NULL GROUP BY 2 HAVING count(*) > 1
        UNION ALL SELECT 'duplicate_question', sha256(question), count(*) FROM manifest WHERE question IS NOT NULL GROUP BY question HAVING count(*) > 1
        UNION ALL SELECT 'duplicate_source', source_query_id, count(*) FROM manifest WHERE source_query_id IS NOT NULL GROUP BY 2 HAVING count(*) > 1
        UNION ALL SELECT 'missing_answer', coalesce(split, ''), count(*) FROM manifest WHERE coalesce(trim(gt_ans), '') = '' GROUP BY 2
        UNION ALL SELECT 'bad_difficulty', coalesce(difficulty::VARCHAR, ''), count(*) FROM manifest WHERE NOT coalesce(difficulty BETWEEN 1 AND 5, FALSE) GROUP BY 2
        UNION ALL SELECT 'bad_split', coalesce(split, ''), count(*) FROM manifest WHERE NOT coalesce(split IN ('train', 'validation', 'test'), FALSE) GROUP BY 2
        UNION ALL SELECT 'position_gap', coalesce(difficulty::VARCHAR, ''), n FROM p WHERE lo <> 0 OR hi <> n - 1
        UNION ALL SELECT 'index_gap', hi::VARCHAR, n FROM w WHERE n > 0 AND (lo <> 0 OR hi <> n - 1)
        UNION ALL SELECT 'split_order', coalesce(difficulty::VARCHAR, ''), n FROM p WHERE t > v0 OR v1 > e OR t > e""",
    "source_strict_lines": """
        SELECT line_id, CASE WHEN trim(coalesce(payload, ''), ' \t\n\r') = '' THEN 'blank' WHEN NOT json_valid(payload) THEN 'damaged' WHEN json_type(payload) <> 'OBJECT' THEN 'no object'
            WHEN len(list_distinct(json_keys(payload))) < len(json_keys(payload)) THEN 'duplicate key' END AS error FROM raw_line""",
    "source_unified": """
        SELECT 'raw_question' AS dataset, query, gt_ans AS ref_ans, query_metadata.level::VARCHAR AS level, NULL::VARCHAR AS topic, query_id AS source_id FROM raw_question
        UNION ALL SELECT 'raw_line', payload->>'$.query', payload->>'$.gt_ans', payload->>'$.query_metadata.level', payload->>'$.query_metadata.topic', payload->>'$.query_id'
        FROM raw_line WHERE json_valid(payload) AND payload <> ''""",
    "source_datasets": """
        WITH q AS (SELECT query, gt_ans, raw_id::VARCHAR AS n, query_metadata.level AS level FROM raw_question)
        SELECT 'math/train' AS dataset, query, n AS ref_ans, level::VARCHAR AS level, 'NumberTheory' AS domain, NULL::VARCHAR AS source, NULL::INTEGER AS n_step, NULL::DOUBLE AS abs_tol, NULL::VARCHAR AS source_id FROM q
        UNION ALL SELECT 'gsm8k/train', query, n, NULL, NULL, NULL, NULL, NULL, NULL FROM q
        UNION ALL SELECT 'pooled-math/train', query, gt_ans, NULL, NULL, NULL, NULL, NULL, NULL FROM q
        UNION ALL SELECT 'gsm8k-fix/test', query, gt_ans, NULL, NULL, NULL, level, NULL, NULL FROM q WHERE coalesce(try_cast(gt_ans AS DOUBLE) = floor(try_cast(gt_ans AS DOUBLE)), FALSE)
        UNION ALL SELECT 'mwpbench/test', query, gt_ans, NULL, 'algebra', n, NULL, NULL, NULL FROM q
        UNION ALL SELECT 'deepmind-mathematics', query, gt_ans, NULL, NULL, NULL, NULL, NULL, NULL FROM q
        UNION ALL SELECT 'olympiadbench', 'The following is an open-ended problem from an International Math competition. The answer of The problem should be a numerical value. Please calculate the answer according to the given requirements and the information provided. Please use LaTeX format to represent the variables and formulas used in the solution process and results. Please end your solution with "So the final answer is ' || chr(92) || 'boxed{answer}." and give the result explicitly.' || chr(10) || query,
            gt_ans, NULL, 'Geometry', NULL, NULL, 0.01, NULL FROM q
        UNION ALL SELECT 'theoremqa', query, n, NULL, NULL, NULL, NULL, NULL, NULL FROM q
        UNION ALL SELECT 'odyssey-math', query, gt_ans, level::VARCHAR, 'algebra', NULL, NULL, NULL, NULL FROM q WHERE level IN (2, 3)
        UNION ALL SELECT 'aops', query, gt_ans, NULL, NULL, NULL, NULL, NULL, 'thread/' || n FROM q""",
    "source_filter_spec": """
        SELECT raw_id, query_metadata.level AS level, gt_ans AS ref_ans FROM raw_question
        WHERE query_metadata.level IN (2, 4) AND coalesce(try_cast(gt_ans AS DOUBLE) = floor(try_cast(gt_ans AS DOUBLE)), FALSE)
          AND ('0x' || substr(sha256('42|' || raw_id), 1, 13))::BIGINT < (0.25 * 4503599627370496)::BIGINT""",
}
