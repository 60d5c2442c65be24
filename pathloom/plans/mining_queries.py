"""Registered queries of candidate mining, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.paths import json_ints
from ..operators import mining, records
from .record_queries import _S


def _search(spark, sf_dir):
    return records.search_records(spark, sf_dir, "sample_id", "difficulty", "split", "final_valid_transitions", "final_invalid_transitions")


def _lift(spark, sf_dir):
    return mining.layer_lift(mining.layer_weights(_search(spark, sf_dir)))


def mine_layer_weights(spark, sf_dir):
    return mining.layer_weights(_search(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


def mine_layer_lift(spark, sf_dir):
    out = _lift(spark, sf_dir)
    return out.withColumns({c: F.round(c, 6) for c in ("valid_weight", "invalid_weight", "valid_fraction", "invalid_fraction", "log_propensity_lift")})


def mine_hypotheses(spark, sf_dir):
    out = mining.hypotheses(_lift(spark, sf_dir))
    return out.select("action", "layer", F.round("worst", 6).alias("worst"), F.round("macro", 6).alias("macro"), F.round("all_train", 6).alias("all_train"))


def mine_rank(spark, sf_dir):
    return mining.hypotheses(_lift(spark, sf_dir)).filter("rank_within_action <= 10").select("action", "layer", "rank_within_action")


def mine_exact_support(spark, sf_dir):
    e = mining.exact_paths(mining.path_evidence(_search(spark, sf_dir)))
    return e.select(json_ints(F.col("path")).alias("path"), "valid_support", "observed_support", F.round("accuracy", 6).alias("accuracy"))


def mine_exact_top(spark, sf_dir):
    e = mining.exact_paths(mining.path_evidence(_search(spark, sf_dir)))
    return e.orderBy(*mining.exact_order()).limit(20).select(json_ints(F.col("path")).alias("path"), "valid_support", F.round("accuracy", 6).alias("accuracy"))


def mine_consensus_prefix(spark, sf_dir):
    return mining.consensus(_lift(spark, sf_dir)).select("grp", "budget", json_ints(F.col("path")).alias("path"))


def mine_candidates(spark, sf_dir):
    c = mining.candidates(_search(spark, sf_dir))
    support = F.array_join(F.transform(F.array_sort(F.map_entries("train_valid_support_by_difficulty")), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), ",")
    return c.select(
        "candidate_id", json_ints(F.col("path")).alias("path"), F.array_join("sources", "|").alias("sources"), "length", F.round("depth_ratio", 6).alias("depth_ratio"), "train_valid_support", "train_observed_support",
        F.round("train_observed_accuracy", 6).alias("train_observed_accuracy"), support.alias("train_valid_support_by_difficulty"),
    )


def mine_heatmap(spark, sf_dir):
    h = mining.heatmap(_lift(spark, sf_dir), "skip")
    return h.select("grp", *[F.round(F.col(str(i)), 6).alias(f"l{i}") for i in range(records.DEPTH)])


QUERIES = (mine_layer_weights, mine_layer_lift, mine_hypotheses, mine_rank, mine_exact_support, mine_exact_top, mine_consensus_prefix, mine_candidates, mine_heatmap)

_OBS = f"""{_S}, t AS (SELECT sample_id, difficulty, coalesce(final_valid_transitions, []) AS v, coalesce(final_invalid_transitions, []) AS i FROM s WHERE split = 'train'),
    obs AS (SELECT sample_id, difficulty, 'valid' AS outcome, unnest(v) AS path, 1.0::DOUBLE / greatest(len(v), 1) AS weight FROM t
            UNION ALL SELECT sample_id, difficulty, 'invalid', unnest(i), 1.0::DOUBLE / greatest(len(i), 1) FROM t)"""
_CELL = f"""{_OBS}, cell AS (SELECT difficulty, outcome, path, weight, unnest(range(0, 28)) AS layer FROM obs),
    act AS (SELECT difficulty, outcome, weight, layer, CASE len(list_filter(path, lambda x: x = layer)) WHEN 0 THEN 'skip' WHEN 1 THEN 'keep' ELSE 'loop' END AS action FROM cell
            WHERE list_max(list_transform(list_distinct(path), lambda d: len(list_filter(path, lambda x: x = d)))) <= 2 AND list_min(path) >= 0 AND list_max(path) < 28),
    w AS (SELECT difficulty::VARCHAR AS grp, outcome, layer, action, sum(weight) AS weight FROM act GROUP BY ALL UNION ALL SELECT 'all', outcome, layer, action, sum(weight) FROM act GROUP BY ALL)"""
_LIFT = f"""{_CELL}, dense AS (SELECT grp, layer, action FROM (SELECT DISTINCT grp FROM w), range(0, 28) r(layer), (VALUES ('skip'), ('keep'), ('loop')) a(action)),
    wide AS (SELECT d.grp, d.layer, d.action, coalesce(sum(weight) FILTER (outcome = 'valid'), 0) AS valid_weight, coalesce(sum(weight) FILTER (outcome = 'invalid'), 0) AS invalid_weight
             FROM dense d LEFT JOIN w ON d.grp = w.grp AND d.layer = w.layer AND d.action = w.action GROUP BY ALL),
    frac AS (SELECT *, CASE WHEN sum(valid_weight) OVER p > 0 THEN valid_weight / sum(valid_weight) OVER p ELSE 0 END AS valid_fraction,
                    CASE WHEN sum(invalid_weight) OVER p > 0 THEN invalid_weight / sum(invalid_weight) OVER p ELSE 0 END AS invalid_fraction FROM wide WINDOW p AS (PARTITION BY grp, layer)),
    lift AS (SELECT *, ln((valid_fraction + 0.01) / (invalid_fraction + 0.01)) AS log_propensity_lift FROM frac),
    gain AS (SELECT grp, layer, action, log_propensity_lift - max(log_propensity_lift) FILTER (action = 'keep') OVER (PARTITION BY grp, layer) AS gain FROM lift QUALIFY action <> 'keep'),
    hyp AS (SELECT action, layer, min(gain) FILTER (grp <> 'all') AS worst, avg(gain) FILTER (grp <> 'all') AS macro, max(gain) FILTER (grp = 'all') AS all_train FROM gain GROUP BY 1, 2)"""
_EX = """ex AS (SELECT path, count(DISTINCT sample_id) FILTER (outcome = 'valid') AS valid_support, count(DISTINCT sample_id) AS observed_support FROM obs
    WHERE path <> range(0, 28)::INTEGER[] GROUP BY 1 HAVING count(*) FILTER (outcome = 'valid') > 0)"""
_EXACT = f"{_OBS}, {_EX}"
_CONSENSUS = """best AS (SELECT grp, layer, arg_max(action, (gain, action)) AS action, max(gain) AS gain FROM gain GROUP BY 1, 2 HAVING max(gain) > 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY gain DESC, layer, action) AS n FROM best),
    b AS (SELECT DISTINCT grp, n AS budget FROM r WHERE n <= 4),
    p AS (SELECT b.grp, b.budget, l.layer, coalesce(max(r.action), 'keep') AS action FROM b CROSS JOIN range(0, 28) l(layer) LEFT JOIN r ON r.grp = b.grp AND r.n <= b.budget AND r.layer = l.layer GROUP BY ALL),
    q AS (SELECT grp, budget, flatten(list(CASE action WHEN 'skip' THEN [] WHEN 'keep' THEN [layer] ELSE [layer, layer] END ORDER BY layer))::INTEGER[] AS path FROM p GROUP BY 1, 2)"""
_P = "'[' || array_to_string({}, ',') || ']'"
SQL = {
    "mine_layer_weights": f"WITH {_CELL} SELECT grp, outcome, layer::INTEGER AS layer, action, round(weight, 6) AS weight FROM w",
    "mine_layer_lift": f"""WITH {_LIFT} SELECT grp, layer::INTEGER AS layer, action, round(valid_weight, 6) AS valid_weight, round(invalid_weight, 6) AS invalid_weight,
        round(valid_fraction, 6) AS valid_fraction, round(invalid_fraction, 6) AS invalid_fraction, round(log_propensity_lift, 6) AS log_propensity_lift FROM lift""",
    "mine_hypotheses": f"WITH {_LIFT} SELECT action, layer::INTEGER AS layer, round(worst, 6) AS worst, round(macro, 6) AS macro, round(all_train, 6) AS all_train FROM hyp",
    "mine_rank": f"WITH {_LIFT} SELECT action, layer::INTEGER AS layer, row_number() OVER (PARTITION BY action ORDER BY worst DESC, macro DESC, layer)::INTEGER AS rank_within_action FROM hyp QUALIFY rank_within_action <= 10",
    "mine_exact_support": f"WITH {_EXACT} SELECT {_P.format('path')} AS path, valid_support, observed_support, round(valid_support / observed_support, 6) AS accuracy FROM ex",
    "mine_exact_top": f"WITH {_EXACT} SELECT {_P.format('path')} AS path, valid_support, round(valid_support / observed_support, 6) AS accuracy FROM ex ORDER BY valid_support DESC, valid_support / observed_support DESC, len(ex.path), ex.path LIMIT 20",
    "mine_consensus_prefix": f"WITH {_LIFT}, {_CONSENSUS} SELECT grp, budget::INTEGER AS budget, {_P.format('path')} AS path FROM q WHERE len(path) BETWEEN 1 AND 32",
    "mine_candidates": f"""
        WITH {_LIFT}, {_CONSENSUS}, {_EX}, o AS (SELECT *, row_number() OVER (ORDER BY valid_support DESC, valid_support / observed_support DESC, len(ex.path), ex.path) AS place FROM ex),
          ranked AS (SELECT action, layer, row_number() OVER (PARTITION BY action ORDER BY worst DESC, macro DESC, layer) AS n FROM hyp),
          pool AS (
            SELECT flatten(list_transform(range(0, 28), lambda i: CASE WHEN i <> layer THEN [i] WHEN action = 'skip' THEN [] ELSE [i, i] END))::INTEGER[] AS path, 'single_' || action || '_layer_' || layer AS source, 0 AS stage, action AS a, n AS b FROM ranked
            UNION ALL SELECT path, 'consensus_' || grp || '_top' || budget, 1, CASE grp WHEN 'all' THEN '~' ELSE grp END, budget FROM q WHERE len(path) BETWEEN 1 AND 32
            UNION ALL SELECT path, 'exact_train_support', 2, '', 0 FROM ex WHERE valid_support >= 2),
          short AS (SELECT 96 - count(DISTINCT path) AS n FROM pool),
          new AS (SELECT place FROM o WHERE path NOT IN (SELECT path FROM pool) QUALIFY row_number() OVER (ORDER BY place) <= (SELECT n FROM short)),
          filled AS (SELECT * FROM pool UNION ALL SELECT path, 'exact_train_fallback', 3, '', 0 FROM o
                     WHERE (SELECT n FROM short) > 0 AND ((SELECT count(*) FROM new) < (SELECT n FROM short) OR place <= (SELECT max(place) FROM new))),
          named AS (SELECT path, string_agg(source, '|' ORDER BY stage, a, b, source) AS sources FROM (SELECT DISTINCT * FROM filled) GROUP BY 1),
          ev AS (SELECT path, count(DISTINCT sample_id) FILTER (outcome = 'valid') AS vs, count(DISTINCT sample_id) AS os FROM obs GROUP BY 1),
          bd AS (SELECT path, string_agg(difficulty || ':' || k, ',' ORDER BY difficulty) AS bd FROM (SELECT path, difficulty, count(*) AS k FROM obs WHERE outcome = 'valid' GROUP BY 1, 2) GROUP BY 1),
          c AS (SELECT substr(sha256({_P.format('named.path')}), 1, 16) AS candidate_id, named.path AS path, sources, coalesce(vs, 0) AS vs, coalesce(os, 0) AS os, vs / os AS acc, coalesce(bd, '') AS bd FROM named LEFT JOIN ev USING (path) LEFT JOIN bd USING (path))
        SELECT candidate_id, {_P.format('path')} AS path, sources, len(path)::INTEGER AS length, round(len(path) / 28, 6) AS depth_ratio, vs AS train_valid_support, os AS train_observed_support, round(acc, 6) AS train_observed_accuracy,
               bd AS train_valid_support_by_difficulty FROM c
        ORDER BY CASE WHEN contains('|' || sources, '|single_') THEN 0 WHEN contains('|' || sources, '|consensus_') THEN 1 ELSE 2 END, vs DESC, CASE WHEN coalesce(acc, 0) = 0 THEN -1 ELSE acc END DESC, len(c.path), candidate_id LIMIT 96""",
    "mine_heatmap": f"WITH {_LIFT} SELECT grp, " + ", ".join(f"round(max(valid_fraction) FILTER (layer = {i}), 6) AS l{i}" for i in range(28)) + " FROM lift WHERE action = 'skip' GROUP BY grp",
}
