"""Inputs with rules broken on purpose, so that the registered checks have something to find; each with the same change in SQL.

What is changed follows from the first digit of an id. The SQL parts are the bodies of CTEs
over the tables, or over ``s`` (latest search records) and ``m`` (latest manifest rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NEVER = [0, 1, 2]


def _first(column: str) -> Column:
    return F.substring(column, 1, 1)


def search_records(records: DataFrame) -> DataFrame:
    """Search records that lack their first valid path (digit 0) or have a path nobody evaluated among the wrong ones (1), or another config (2)."""
    d = _first("sample_id")
    changed = {
        "final_valid_transitions": F.when(d == "0", F.slice("final_valid_transitions", F.lit(2), F.greatest(F.size("final_valid_transitions"), F.lit(1)))).otherwise(F.col("final_valid_transitions")),
        "final_invalid_transitions": F.when(d == "1", F.concat("final_invalid_transitions", F.array(F.array(*map(F.lit, _NEVER))))).otherwise(F.col("final_invalid_transitions")),
        "config_id": F.when(d == "2", F.lit("another")).otherwise(F.col("config_id")),
    }
    return records.withColumns({k: v for k, v in changed.items() if k in records.columns})


SEARCH_SQL = """sb AS (SELECT * REPLACE (CASE WHEN sample_id[1] = '0' THEN final_valid_transitions[2:] ELSE final_valid_transitions END AS final_valid_transitions,
    CASE WHEN sample_id[1] = '1' THEN list_append(final_invalid_transitions, [0, 1, 2]::INTEGER[]) ELSE final_invalid_transitions END AS final_invalid_transitions,
    CASE WHEN sample_id[1] = '2' THEN 'another' ELSE config_id END AS config_id) FROM s)"""


def manifest(rows: DataFrame) -> DataFrame:
    """Manifest rows with another question (digit 0), difficulty (1) or answer (2), and some that are gone (3)."""
    d = _first("sample_id")
    changed = {"question": F.when(d == "0", F.concat("question", F.lit("?"))).otherwise(F.col("question")), "difficulty": F.when(d == "1", F.col("difficulty") + 1).otherwise(F.col("difficulty")), "gt_ans": F.when(d != "2", F.col("gt_ans"))}
    return rows.filter(d != "3").withColumns({k: v for k, v in changed.items() if k in rows.columns})


MANIFEST_SQL = """mb AS (SELECT * REPLACE (CASE WHEN sample_id[1] = '0' THEN question || '?' ELSE question END AS question, CASE WHEN sample_id[1] = '1' THEN difficulty + 1 ELSE difficulty END AS difficulty,
    CASE WHEN sample_id[1] <> '2' THEN gt_ans END AS gt_ans) FROM m WHERE sample_id[1] <> '3')"""


def universal_records(records: DataFrame) -> DataFrame:
    """Held-out records of another split (digit 0) or status (1), without baseline (2), with an unknown candidate (3), without one (4), with odd scores (5), failed for no reason (6)."""
    d, scores = _first("sample_id"), F.col("scores")
    first = F.array_min(F.map_keys(scores))
    return records.withColumns({
        "split": F.when(d == "0", "train").otherwise(F.col("split")), "baseline_score": F.when(d != "2", F.col("baseline_score")),
        "failure_reason": F.when(d == "6", "").otherwise(F.col("failure_reason")), "status": F.when(d == "1", "lost").when(d == "6", "failed").otherwise(F.col("status")),
        "scores": F.when(d == "3", F.map_concat(scores, F.create_map(F.lit("none such"), F.lit(1.0)))).when(d == "4", F.map_filter(scores, lambda k, _: k != first)).when(d == "5", F.transform_values(scores, lambda _, v: v + 0.5)).otherwise(scores),
    })


UNIVERSAL_SQL = """ub AS (SELECT * REPLACE (CASE WHEN sample_id[1] = '0' THEN 'train' ELSE split END AS split, CASE WHEN sample_id[1] <> '2' THEN baseline_score END AS baseline_score,
    CASE WHEN sample_id[1] = '6' THEN '' ELSE failure_reason END AS failure_reason, CASE sample_id[1] WHEN '1' THEN 'lost' WHEN '6' THEN 'failed' ELSE status END AS status,
    CASE CASE WHEN scores IS NOT NULL THEN sample_id[1] END WHEN '3' THEN map_concat(scores, MAP {'none such': 1.0::DOUBLE}) WHEN '4' THEN map_from_entries(list_filter(map_entries(scores), lambda e: e.key <> list_min(map_keys(scores))))
        WHEN '5' THEN map_from_entries(list_transform(map_entries(scores), lambda e: {'key': e.key, 'value': e.value + 0.5})) ELSE scores END AS scores) FROM universal_record)"""


def candidates(rows: DataFrame) -> DataFrame:
    """Candidates of another length (digit 0), without source (1), with their path turned round (2), or listed twice under another id (3)."""
    d = _first("candidate_id")
    changed = rows.withColumns({
        "length": F.when(d == "0", F.col("length") + 1).otherwise(F.col("length")), "sources": F.when(d == "1", F.array().cast("array<string>")).otherwise(F.col("sources")),
        "path": F.when(d == "2", F.reverse("path")).otherwise(F.col("path")),
    })
    return changed.union(changed.filter(d == "3").withColumn("candidate_id", F.concat("candidate_id", F.lit("x"))))


CANDIDATE_SQL = """c0 AS (SELECT * REPLACE (CASE WHEN candidate_id[1] = '0' THEN length + 1 ELSE length END AS length, CASE WHEN candidate_id[1] = '1' THEN [] ELSE sources END AS sources,
    CASE WHEN candidate_id[1] = '2' THEN list_reverse(path) ELSE path END AS path) FROM candidate),
    cb AS (SELECT * FROM c0 UNION ALL SELECT * REPLACE (candidate_id || 'x' AS candidate_id) FROM c0 WHERE candidate_id[1] = '3')"""


def one_edit(rows: DataFrame, depth: int) -> DataFrame:
    """Candidates with the full path but for one layer, which is skipped or run twice; the layer follows from the id."""
    layer = F.pmod(F.conv(F.substring("candidate_id", 1, 4), 16, 10).cast("bigint"), F.lit(depth)).cast("int")
    path = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(depth - 1)), lambda x: F.when(x != layer, F.array(x)).when(_first("candidate_id") < "8", F.array().cast("array<int>")).otherwise(F.array(x, x))))
    return rows.withColumn("path", path).withColumn("length", F.size("path"))


ONE_EDIT_SQL = """candidate_1 AS (SELECT * REPLACE (flatten(list_transform(range(0, 28), lambda x: CASE WHEN x <> ('0x' || candidate_id[1:4])::BIGINT % 28 THEN [x] WHEN candidate_id[1] < '8' THEN [] ELSE [x, x] END)) AS path) FROM candidate)"""

#: The canonical segmentation of the paths ``p``(path) as a search over layers: fewest segments, fewest skips, most repeats, larger segments first.
#: The position in a path follows from the layers done, so a cell is a number of layers.
PARSE_SQL = """
    cut AS (SELECT path, a::INTEGER AS a, z::INTEGER AS z, path[len(list_filter(path, lambda x: x < a)) + 1 : len(list_filter(path, lambda x: x < a + z))] AS part
            FROM p, range(0, 28) r(a), range(1, 5) q(z) WHERE a + z <= 28),
    seg AS (SELECT path, a, z, CASE WHEN len(part) = 0 THEN 0 WHEN part = range(a, a + z)::INTEGER[] THEN 1 ELSE 2 END AS op FROM cut
            WHERE len(part) = 0 OR part = range(a, a + z)::INTEGER[] OR part = (range(a, a + z) || range(a, a + z))::INTEGER[]),
    walk AS (SELECT path, 0 AS layer, {'k': 0, 's': 0, 'r': 0, 'z': []::INTEGER[], 'o': []::INTEGER[]} AS best FROM p
             UNION ALL
             SELECT seg.path, seg.a + seg.z AS layer, min({'k': best.k + 1, 's': best.s + (op = 0)::INTEGER, 'r': best.r - (op = 2)::INTEGER, 'z': list_append(best.z, -z), 'o': list_append(best.o, op)}) AS best
             FROM walk JOIN seg ON walk.path = seg.path AND walk.layer = seg.a GROUP BY 1, 2),
    best AS (SELECT path, min(best) AS b FROM walk WHERE layer = 28 AND len(path) = len(list_filter(path, lambda x: x BETWEEN 0 AND 27)) GROUP BY path),
    starts AS (SELECT path, b.o AS ops, list_transform(b.z, lambda z: -z) AS sizes, list_transform(range(1, len(b.z) + 1), lambda i: (-coalesce(list_sum(b.z[1:i - 1]), 0))::INTEGER) AS starts FROM best),
    parse AS (SELECT path, ops, sizes, starts, list_transform(range(0, 28), lambda l: (l > 0 AND list_contains(starts, l))::INTEGER) AS seg_flip,
                     list_transform(range(0, 28), lambda l: coalesce(ops[list_position(starts, l)], -100)) AS op_labels,
                     list_transform(range(0, 28), lambda l: ops[len(list_filter(starts, lambda x: x <= l))]) AS layer_ops FROM starts)"""
