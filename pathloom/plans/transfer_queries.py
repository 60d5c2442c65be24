"""Registered queries of transfer metrics and vector geometry, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geometry, reports, transfer
from ..operators.records import DEPTH
from ..runtime import table
from . import broken


def _scores(spark, sf_dir):
    return transfer.long_scores(transfer.held_out(table(spark, sf_dir, "universal_record")))


def _candidates(spark, sf_dir):
    return table(spark, sf_dir, "candidate")


def transfer_metrics(spark, sf_dir):
    return transfer.metrics(transfer.shared_difficulties(_scores(spark, sf_dir)))


def transfer_by_difficulty(spark, sf_dir):
    return transfer.rounded(transfer.by_difficulty(_scores(spark, sf_dir)), "baseline_accuracy", "program_accuracy", "gain").drop("baseline_sum", "program_sum")


def transfer_select(spark, sf_dir):
    return transfer.selected(transfer.metrics(_scores(spark, sf_dir)), _candidates(spark, sf_dir))


def transfer_select_by_difficulty(spark, sf_dir):
    return transfer.selected_by_difficulty(transfer.by_difficulty(_scores(spark, sf_dir)), _candidates(spark, sf_dir))


def _chosen_scores(spark, sf_dir):
    s = _scores(spark, sf_dir)
    return s.join(F.broadcast(transfer.selected(transfer.metrics(s), _candidates(spark, sf_dir)).select("candidate_id")), "candidate_id", "left_semi")


def transfer_bootstrap(spark, sf_dir):
    return transfer.bootstrap(_chosen_scores(spark, sf_dir), 200)


def transfer_bootstrap_counts(spark, sf_dir):
    return transfer.bootstrap_counts(_chosen_scores(spark, sf_dir))


def transfer_verdict(spark, sf_dir):
    s = _scores(spark, sf_dir)
    return transfer.verdict(transfer.selected(transfer.metrics(s), _candidates(spark, sf_dir)), transfer.bootstrap(_chosen_scores(spark, sf_dir), 200))


def transfer_single_layer(spark, sf_dir):
    return transfer.single_layer_transfer(transfer.metrics(_scores(spark, sf_dir)), broken.one_edit(_candidates(spark, sf_dir), DEPTH))


def split_counts_pivot(spark, sf_dir):
    return transfer.split_counts(transfer.held_out(table(spark, sf_dir, "universal_record")))


def outcome_transitions(spark, sf_dir):
    return transfer.outcome_transitions(_scores(spark, sf_dir))


def geometry_groups(spark, sf_dir):
    return transfer.group_accuracy(_scores(spark, sf_dir))


def _vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    return e.select("vec_id", "label", F.col("embedding").alias("vec"), F.slice("embedding", 1, 32).alias("first"), F.slice("embedding", 33, 32).alias("second"))


def _asked(df):
    return df.filter(F.col("vec_id") % 20 == 0)


def geometry_knn(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return geometry.nearest(v, _asked(v), 10)


def geometry_knn_index(spark, sf_dir):
    """How many of the exact neighbours the index finds; these vectors have no groups, so most lists are looked into."""
    v = _vectors(spark, sf_dir)
    got, exact = geometry.nearest_indexed(v, _asked(v), 10, probes=0.7), geometry.nearest(v, _asked(v), 10)
    hit = got.join(exact.select("query_id", "neighbor_id", F.lit(1).alias("hit")), ["query_id", "neighbor_id"], "left")
    return hit.groupBy("query_id").agg(F.count(F.lit(1)).alias("found"), F.count("hit").alias("exact"))


def geometry_mutual_knn(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    a, b = (geometry.nearest(v, _asked(v), 10, vec_col=c) for c in ("first", "second"))
    return geometry.mutual_overlap(a, b, 10)


def geometry_cka(spark, sf_dir):
    return geometry.linear_cka(_vectors(spark, sf_dir), "first", "second")


def geometry_norm(spark, sf_dir):
    return geometry.mean_norms(_vectors(spark, sf_dir), "label", "vec")


def geometry_plane(spark, sf_dir):
    return geometry.principal_plane(_vectors(spark, sf_dir), "vec_id", "vec")


def geometry_pooled(spark, sf_dir):
    p = geometry.pooled(_vectors(spark, sf_dir), "label", "vec_id", "vec")
    return p.select("label", F.round(geometry.norm(F.col("vec")), 5).alias("norm"), F.size("vec").alias("dim"))


def geometry_last(spark, sf_dir):
    p = geometry.pooled(_vectors(spark, sf_dir), "label", "vec_id", "vec", how="last")
    return p.select("label", F.round(geometry.norm(F.col("vec")), 5).alias("norm"), F.size("vec").alias("dim"))


def transfer_programs(spark, sf_dir):
    return reports.capture_programs(_scores(spark, sf_dir), _candidates(spark, sf_dir)).select("program_id", "source", "length", "place")


def geometry_layerwise(spark, sf_dir):
    """Two stand-in programs whose slots are quarters of the vectors; the second one's slots are in another order."""
    e = table(spark, sf_dir, "embeddings").filter("embedding is not null")
    slots = F.explode(F.array(*[F.struct(F.lit(p).alias("program_id"), F.lit(s).alias("slot"), F.slice("embedding", 1 + 16 * part, 16).alias("vec")) for p, order in (("baseline", (0, 1, 2, 3)), ("turned", (3, 1, 0, 2))) for s, part in enumerate(order)]))
    v = e.select(F.col("vec_id").cast("string").alias("sample_id"), slots.alias("x")).select("x.program_id", "x.slot", "sample_id", "x.vec")
    return reports.layerwise_overlap(reports.slot_neighbours(v, 10), 10)


QUERIES = (
    transfer_programs, geometry_layerwise, transfer_metrics, transfer_by_difficulty, transfer_select, transfer_select_by_difficulty, transfer_bootstrap, transfer_bootstrap_counts, transfer_verdict, transfer_single_layer, split_counts_pivot, outcome_transitions,
    geometry_groups, geometry_knn, geometry_knn_index, geometry_mutual_knn, geometry_cka, geometry_norm, geometry_plane, geometry_pooled, geometry_last,
)

_U = """u AS (SELECT * FROM universal_record WHERE status = 'complete' QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY record_digest) = 1),
    sc AS (SELECT sample_id, split, difficulty, baseline_score AS base, e.key AS candidate_id, e.value AS score FROM (SELECT *, unnest(map_entries(scores)) AS e FROM u))"""
_D = f"""{_U}, d AS (SELECT candidate_id, split, difficulty, count(*) AS questions, sum(base) AS bs, sum(score) AS ps, count(*) FILTER (base = 0 AND score = 1) AS wrong_to_correct,
    count(*) FILTER (base = 1 AND score = 0) AS correct_to_wrong, (sum(score) - sum(base)) / count(*) AS gain FROM sc GROUP BY 1, 2, 3),
    met AS (SELECT candidate_id, split, sum(questions)::BIGINT AS questions, round(sum(bs) / sum(questions), 6) AS baseline_accuracy, round(sum(ps) / sum(questions), 6) AS program_accuracy,
                   round((sum(ps) - sum(bs)) / sum(questions), 6) AS gain, sum(wrong_to_correct)::BIGINT AS wrong_to_correct, sum(correct_to_wrong)::BIGINT AS correct_to_wrong,
                   (sum(wrong_to_correct) - sum(correct_to_wrong))::BIGINT AS net_corrections, round(avg(gain), 6) AS macro_gain, round(min(gain), 6) AS worst_group_gain FROM d GROUP BY 1, 2)"""
_SEL = f"""{_D}, ml AS (SELECT met.*, length FROM met JOIN candidate USING (candidate_id)),
    best AS (SELECT candidate_id FROM ml WHERE split = 'validation' ORDER BY worst_group_gain DESC, macro_gain DESC, program_accuracy DESC, length, candidate_id DESC LIMIT 1)"""
_W = ", ".join(f"max({c}) FILTER (split = '{s}') AS {s}_{c}" for s in ("validation", "test") for c in ("gain", "macro_gain", "worst_group_gain", "program_accuracy"))
_BOOT = f"""{_SEL}, n AS (SELECT split, candidate_id, count(*) AS n, count(*) FILTER (score < base) AS worse, count(*) FILTER (score > base) AS better FROM sc WHERE candidate_id IN (SELECT candidate_id FROM best) GROUP BY 1, 2),
    dr AS (SELECT split, candidate_id, n, worse, better, b, unnest(range(0, n)) AS i FROM (SELECT *, unnest(range(0, 200)) AS b FROM n)),
    v AS (SELECT split, candidate_id, b, n, worse, better, ('0x' || substr(sha256('42|' || split || '|' || b || '|' || i), 1, 13))::BIGINT % n AS pick FROM dr),
    mn AS (SELECT split, candidate_id, b, sum(CASE WHEN pick < worse THEN -1 WHEN pick >= n - better THEN 1 ELSE 0 END) / count(*) AS m FROM v GROUP BY 1, 2, 3),
    ci AS (SELECT split, candidate_id, round(list_sort(list(m))[5], 6) AS gain_low, round(list_sort(list(m))[195], 6) AS gain_high FROM mn GROUP BY 1, 2)"""
_VEC = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS vec, (embedding::DOUBLE[])[1:32] AS first, (embedding::DOUBLE[])[33:64] AS second FROM embeddings WHERE embedding IS NOT NULL)"
_KNN = """SELECT q.vec_id AS query_id, b.vec_id AS neighbor_id, round(list_cosine_similarity(q.{c}, b.{c}), 6) AS similarity FROM v q JOIN v b ON q.vec_id <> b.vec_id WHERE q.vec_id % 20 = 0
          QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.{c}, b.{c}), 6) DESC, b.vec_id) <= 10"""
SQL = {
    "transfer_metrics": f"WITH {_D} SELECT * FROM met",
    "transfer_by_difficulty": f"WITH {_D} SELECT candidate_id, split, difficulty, questions, wrong_to_correct, correct_to_wrong, round(bs / questions, 6) AS baseline_accuracy, round(ps / questions, 6) AS program_accuracy, round(gain, 6) AS gain FROM d",
    "transfer_select": f"WITH {_SEL} SELECT candidate_id, length, {_W} FROM ml WHERE candidate_id IN (SELECT candidate_id FROM best) GROUP BY 1, 2",
    "transfer_select_by_difficulty": f"""
        WITH {_D}, r AS (SELECT difficulty, candidate_id, split, round(gain, 6) AS gain, round(ps / questions, 6) AS acc, length FROM d JOIN candidate USING (candidate_id)),
          b AS (SELECT difficulty, candidate_id, gain AS validation_gain FROM r WHERE split = 'validation' QUALIFY row_number() OVER (PARTITION BY difficulty ORDER BY gain DESC, acc DESC, length, candidate_id DESC) = 1)
        SELECT b.difficulty, b.candidate_id, validation_gain, r.gain AS test_gain FROM b LEFT JOIN r ON r.difficulty = b.difficulty AND r.candidate_id = b.candidate_id AND r.split = 'test'""",
    "transfer_bootstrap": f"WITH {_BOOT} SELECT * FROM ci",
    "transfer_verdict": f"""
        WITH {_BOOT}, w AS (SELECT candidate_id, {_W} FROM ml WHERE candidate_id IN (SELECT candidate_id FROM best) GROUP BY 1)
        SELECT candidate_id, validation_gain > 0 AND validation_worst_group_gain >= 0 AS validation_robust,
               validation_gain > 0 AND validation_worst_group_gain >= 0 AND test_gain > 0 AND test_worst_group_gain >= 0 AS held_out_robust,
               gain_low > 0 AS test_interval_excludes_zero FROM w LEFT JOIN (SELECT * FROM ci WHERE split = 'test') USING (candidate_id)""",
    "transfer_single_layer": f"""
        WITH {_D}, {broken.ONE_EDIT_SQL}, e AS (SELECT candidate_id, list_filter(list_transform(range(0, 28), lambda l: {{'layer': l, 'n': len(list_filter(path, lambda x: x = l))}}), lambda z: z.n <> 1) AS e FROM candidate_1),
          o AS (SELECT candidate_id, e[1].layer::INTEGER AS layer, CASE e[1].n WHEN 0 THEN 'skip' ELSE 'loop' END AS action FROM e WHERE len(e) = 1),
          w AS (SELECT candidate_id, max(worst_group_gain) FILTER (split = 'validation') AS validation_worst_group_gain, max(macro_gain) FILTER (split = 'validation') AS validation_macro_gain,
                       max(gain) FILTER (split = 'test') AS test_gain, max(worst_group_gain) FILTER (split = 'test') AS test_worst_group_gain FROM met GROUP BY 1)
        SELECT o.candidate_id, layer, action, validation_worst_group_gain, validation_macro_gain, test_gain, test_worst_group_gain,
               row_number() OVER (ORDER BY validation_worst_group_gain DESC, validation_macro_gain DESC, action, layer, candidate_id)::INTEGER AS rank FROM o JOIN w USING (candidate_id)""",
    "transfer_programs": f"""
        WITH {_SEL}, pd AS (SELECT d.*, length, round(d.gain, 6) AS g, round(ps / questions, 6) AS acc FROM d JOIN candidate USING (candidate_id) WHERE split = 'validation'),
          per AS (SELECT difficulty, candidate_id FROM pd QUALIFY row_number() OVER (PARTITION BY difficulty ORDER BY g DESC, acc DESC, length, candidate_id DESC) = 1),
          src AS (SELECT candidate_id, 0 AS stage, 0 AS n, 'universal_validation_selected' AS source FROM best UNION ALL SELECT candidate_id, 1, difficulty, 'difficulty_' || difficulty || '_validation_selected' FROM per
                  UNION ALL SELECT candidate_id, 2, 0, 'validation_ranked_fill' FROM met WHERE split = 'validation'),
          one AS (SELECT * FROM src QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY stage, n, source) = 1),
          o AS (SELECT one.*, ml.length, row_number() OVER (ORDER BY stage, n, worst_group_gain DESC, macro_gain DESC, ml.length, candidate_id) AS place FROM one JOIN ml USING (candidate_id) WHERE ml.split = 'validation')
        SELECT 'baseline' AS program_id, 'full_depth' AS source, 28 AS length, 0 AS place UNION ALL SELECT candidate_id, source, length::INTEGER, place::INTEGER FROM o WHERE place <= 7""",
    "split_counts_pivot": f"WITH {_U} SELECT split, " + ", ".join(f"count(*) FILTER (difficulty = {d}) AS d{d}" for d in range(1, 6)) + " FROM u GROUP BY 1",
    "outcome_transitions": f"""WITH {_U} SELECT candidate_id, CASE base WHEN 1 THEN 'correct' WHEN 0 THEN 'wrong' END AS from_outcome, CASE score WHEN 1 THEN 'correct' WHEN 0 THEN 'wrong' END AS to_outcome, count(*) AS n
        FROM sc WHERE base IN (0, 1) AND score IN (0, 1) GROUP BY 1, 2, 3""",
    "geometry_groups": f"""
        WITH {_U} SELECT CASE WHEN difficulty IS NOT NULL THEN 'difficulty' ELSE 'split' END AS kind, coalesce(difficulty::VARCHAR, split) AS value, candidate_id, count(*) AS questions,
               round(avg(score), 6) AS accuracy, round(avg(score) - avg(base), 6) AS accuracy_gain FROM sc GROUP BY GROUPING SETS ((candidate_id, difficulty), (candidate_id, split))""",
    "geometry_knn": f"WITH {_VEC}, k AS ({_KNN.format(c='vec')}) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, neighbor_id)::INTEGER AS rank FROM k",
    "geometry_mutual_knn": f"""WITH {_VEC}, a AS ({_KNN.format(c='first')}), b AS ({_KNN.format(c='second')}), c AS (SELECT query_id, count(*) AS n FROM a JOIN b USING (query_id, neighbor_id) GROUP BY 1)
        SELECT q.query_id, round(coalesce(n, 0) / 10, 6) AS overlap FROM (SELECT DISTINCT query_id FROM a) q LEFT JOIN c USING (query_id)""",
    "geometry_layerwise": """
        WITH a AS (SELECT vec_id::VARCHAR AS id, embedding AS e FROM embeddings WHERE embedding IS NOT NULL QUALIFY row_number() OVER (ORDER BY sha256('[42,"' || vec_id || '"]')) <= 500),
          x AS (SELECT id, part, e[part * 16 + 1 : part * 16 + 16]::DOUBLE[] AS v FROM a, range(0, 4) r(part)),
          u AS (SELECT id, part, list_transform(v, lambda y: y / greatest(sqrt(list_inner_product(v, v)), 1e-12)) AS v FROM x),
          nn AS (SELECT p.id, p.part, q.id AS near FROM u p JOIN u q ON p.part = q.part AND p.id <> q.id
                 QUALIFY row_number() OVER (PARTITION BY p.id, p.part ORDER BY round(list_inner_product(p.v, q.v), 6) DESC, q.id) <= 10),
          s(program_id, slot, part) AS (VALUES ('baseline', 0, 0), ('baseline', 1, 1), ('baseline', 2, 2), ('baseline', 3, 3), ('turned', 0, 3), ('turned', 1, 1), ('turned', 2, 0), ('turned', 3, 2)),
          pairs AS (SELECT s.program_id, s.slot, b.slot AS base_slot, p.id, count(q.near) AS n FROM s JOIN s b ON b.program_id = 'baseline' JOIN nn p ON p.part = s.part LEFT JOIN nn q ON q.part = b.part AND q.id = p.id AND q.near = p.near GROUP BY ALL)
        SELECT program_id, slot::INTEGER AS slot, base_slot::INTEGER AS base_slot, round(avg(n / 10), 6) AS overlap FROM pairs GROUP BY ALL""",
    "geometry_norm": f"WITH {_VEC} SELECT label, count(*) AS n, round(avg(sqrt(list_inner_product(vec, vec))), 5) AS mean_norm FROM v GROUP BY 1",
    "geometry_pooled": f"""WITH {_VEC}, x AS (SELECT label, i, avg(vec[i]) AS m FROM v, range(1, 65) r(i) GROUP BY 1, 2) SELECT label, round(sqrt(sum(m * m)), 5) AS norm, count(*)::INTEGER AS dim FROM x GROUP BY 1""",
    "geometry_last": f"WITH {_VEC} SELECT label, round(sqrt(list_inner_product(vec, vec)), 5) AS norm, len(vec)::INTEGER AS dim FROM v QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) = 1",
    "geometry_cka": f"""
        WITH {_VEC}, long AS (SELECT vec_id, unnest(range(1, 33)) AS i, first, second FROM v), x AS (SELECT vec_id, i, first[i] - avg(first[i]) OVER (PARTITION BY i) AS a, second[i] - avg(second[i]) OVER (PARTITION BY i) AS b FROM long),
          mm AS (SELECT p.i AS i, q.i AS j, sum(p.a * q.a) AS aa, sum(p.b * q.b) AS bb, sum(p.a * q.b) AS ab FROM x p JOIN x q USING (vec_id) GROUP BY 1, 2)
        SELECT (SELECT count(*) FROM v) AS n, round(sum(ab * ab) / (sqrt(sum(aa * aa)) * sqrt(sum(bb * bb))), 6) AS cka FROM mm""",
}
