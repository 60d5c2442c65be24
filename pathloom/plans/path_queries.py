"""Registered queries of the path algebra, pairing, decoding and search, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths as px
from ..functions.grammar import parsed
from ..operators import lookup, mining, pairing, records, search, traces
from ..runtime import table
from .broken import PARSE_SQL
from .record_queries import _S

_D = records.DEPTH
_J = px.json_ints


def _candidates(spark, sf_dir):
    return table(spark, sf_dir, "candidate").select("candidate_id", "path", "length")


def _search_paths(spark, sf_dir):
    return traces.evaluation_trace(records.search_records(spark, sf_dir, "sample_id", "evaluations")).select("path").distinct()


def path_layer_actions(spark, sf_dir):
    return _search_paths(spark, sf_dir).withColumnRenamed("path", "p").select(_J(F.col("p")).alias("path"), F.array_join(px.layer_actions(F.col("p"), _D), ",").alias("actions"))


def path_from_actions(spark, sf_dir):
    back = px.actions_path(px.layer_actions(F.col("p"), _D))
    return _search_paths(spark, sf_dir).withColumnRenamed("path", "p").select(_J(F.col("p")).alias("path"), F.coalesce(_J(back), F.lit("none")).alias("layer_path"))


def path_counts(spark, sf_dir):
    return _search_paths(spark, sf_dir).withColumnRenamed("path", "p").select(_J(F.col("p")).alias("path"), F.array_join(px.layer_counts(F.col("p"), _D).cast("array<string>"), ",").alias("counts"))


def path_digest_id(spark, sf_dir):
    return _candidates(spark, sf_dir).select("candidate_id", px.path_id(F.col("path")).alias("computed_id"))


def path_seeds(spark, sf_dir):
    return table(spark, sf_dir, "manifest").select("sample_id").distinct().select("sample_id", px.seed_number(42, F.col("sample_id")).alias("seed"))


def path_edits(spark, sf_dir):
    e = _candidates(spark, sf_dir).select("candidate_id", F.explode(px.local_edits(F.col("path"), 4, 1, records.MAX_LENGTH)).alias("p"))
    return e.select("candidate_id", _J(F.col("p")).alias("edited"))


def _sample_pairs(spark, sf_dir):
    """Pairs of the paths evaluated for one question, whatever their lengths."""
    t = traces.evaluation_trace(records.search_records(spark, sf_dir, "sample_id", "evaluations")).select("sample_id", "evaluation_index", "path")
    other = t.select("sample_id", F.col("evaluation_index").alias("other_index"), F.col("path").alias("other"))
    return t.join(other, "sample_id").filter("evaluation_index < other_index")


def path_levenshtein(spark, sf_dir):
    return _sample_pairs(spark, sf_dir).select("sample_id", "evaluation_index", "other_index", px.edit_distance(F.col("path"), F.col("other")).alias("distance"))


def path_canonical_parse(spark, sf_dir):
    return parsed(_search_paths(spark, sf_dir), _D).select(_J(F.col("path")).alias("path"), "representable", *(_J(F.col(c)).alias(c) for c in ("seg_flip", "op_labels", "layer_ops")))


def path_representable(spark, sf_dir):
    p = parsed(_search_paths(spark, sf_dir), _D)
    return p.groupBy("representable", px.in_vocabulary(F.col("path"), _D).alias("in_vocabulary")).agg(F.count(F.lit(1)).alias("n"))


def path_round_trip(spark, sf_dir):
    p = parsed(_search_paths(spark, sf_dir), _D).filter("representable")
    name = lambda o: F.when(o == 0, "skip").when(o == 1, "keep").otherwise("repeat")
    acts = F.transform("segments", lambda s: F.struct(name(s["op"]).alias("action"), (s["end"] - s["start"]).alias("size"), F.when(s["op"] == 2, 1).otherwise(0).alias("count")))
    rows = p.select("path", acts.alias("a"))
    return rows.select(_J(F.col("path")).alias("path"), _J(px.decode_actions(F.col("a"))).alias("decoded"), px.actions_length(F.col("a")).alias("length"))


def path_distance_triple(spark, sf_dir):
    p = _sample_pairs(spark, sf_dir)
    ops = parsed(_search_paths(spark, sf_dir), _D).filter("representable").select("path", F.col("layer_ops").alias("ops"))
    both = p.join(ops, "path").join(ops.select(F.col("path").alias("other"), F.col("ops").alias("other_ops")), "other")
    triple = px.operation_distance(F.col("ops"), F.col("other_ops")), px.edit_distance(F.col("path"), F.col("other")), F.abs(F.size("path") - F.size("other"))
    return both.select("sample_id", "evaluation_index", "other_index", *(d.alias(n) for d, n in zip(triple, ("operation_distance", "edit_distance", "length_difference"), strict=True)))


def _labelled(spark, sf_dir):
    """Distinct training paths per difficulty: correct if ever valid, with an order number from their content id."""
    obs = mining.observations(records.search_records(spark, sf_dir, "sample_id", "difficulty", "split", "final_valid_transitions", "final_invalid_transitions"))
    rows = obs.groupBy("difficulty", "path").agg(F.bool_or(F.col("outcome") == "valid").alias("correct"))
    pid = px.path_id(F.col("path"))
    return rows.select("difficulty", pid.alias("candidate_id"), "path", F.size("path").alias("length"), F.conv(F.substring(pid, 1, 7), 16, 10).cast("int").alias("evaluation_index"), "correct")


def pair_extremes(spark, sf_dir):
    e = pairing.extremes(_labelled(spark, sf_dir).filter("correct"), "difficulty", 5)
    return e.select("difficulty", "candidate_id", "length", "role", "rank")


def _assigned(spark, sf_dir):
    rows = _labelled(spark, sf_dir)
    ops = parsed(rows, _D).filter("representable").select("path", F.col("layer_ops").alias("ops"))
    known = rows.join(ops, "path")  # before the extremes are chosen, so that each pick can be paired
    chosen = pairing.extremes(known.filter("correct"), "difficulty", 5)
    return pairing.assigned(pairing.distances(chosen, known.filter("not correct"), "difficulty"), "difficulty")


def pair_assignment(spark, sf_dir):
    return _assigned(spark, sf_dir)


def pair_figure_rows(spark, sf_dir):
    return pairing.figure_rows(_assigned(spark, sf_dir), "difficulty")


def _logits(spark, sf_dir):
    """Stand-in for predictor outputs: slices of the embedding vectors."""
    v = F.col("v")
    e = table(spark, sf_dir, "embeddings").filter("embedding is not null").select(F.col("vec_id").cast("string").alias("sample_id"), F.col("embedding").cast("array<double>").alias("v"))
    return e.select("sample_id", F.transform(F.slice(v, 1, _D), lambda x: x * 3).alias("seg"), F.transform(F.sequence(F.lit(1), F.lit(_D)), lambda i: F.array(F.get(v, i), F.get(v, i + 16), F.get(v, i + 32))).alias("ops"))


def beam_decode(spark, sf_dir):
    b = lookup.beam_search(_logits(spark, sf_dir))
    return b.select("sample_id", "rank", F.round("score", 6).alias("score"), _J(px.decode_actions(F.col("actions"))).alias("path"))


def beam_rerank(spark, sf_dir):
    b = lookup.beam_search(_logits(spark, sf_dir)).withColumn("length", px.actions_length(F.col("actions")))
    from pyspark.sql import Window

    w = Window.partitionBy("sample_id").orderBy(F.desc(F.round(F.col("score") - 0.1 * F.col("length"), 9)), "rank")
    return b.withColumn("new_rank", F.row_number().over(w)).filter("new_rank <= 2").select("sample_id", "new_rank", "rank", "length")


def search_replay(spark, sf_dir):
    s = records.search_records(spark, sf_dir, "sample_id", "split", "evaluations")
    known = traces.evaluation_trace(s).select("sample_id", "path", "score")
    out = search.search_questions(s.select("sample_id", "split"), known, simulations=6)
    return out.select("sample_id", "split", "status", "initial_score", F.size("evaluations").alias("n_evaluations"), F.size("final_valid_transitions").alias("n_valid"), F.col("search_statistics.cache_hits").alias("cache_hits"))


QUERIES = (
    path_layer_actions, path_from_actions, path_counts, path_digest_id, path_seeds, path_edits, path_levenshtein, path_canonical_parse, path_representable, path_round_trip, path_distance_triple,
    pair_extremes, pair_assignment, pair_figure_rows, beam_decode, beam_rerank, search_replay,
)

_P = "'[' || array_to_string({}, ',') || ']'"
_E = f"{_S}, p AS (SELECT DISTINCT ev.path AS path FROM (SELECT unnest(evaluations) AS ev FROM s))"
_N = "list_transform(range(0, 28), lambda l: len(list_filter(path, lambda y: y = l)))"
_CODE = "array_to_string(list_transform(path, lambda x: chr(x + 48)), '')"
_LABEL = f"""{_S}, obs AS (SELECT difficulty, unnest(coalesce(final_valid_transitions, [])) AS path, TRUE AS good FROM s WHERE split = 'train'
                    UNION ALL SELECT difficulty, unnest(coalesce(final_invalid_transitions, [])), FALSE FROM s WHERE split = 'train'),
    lab AS (SELECT difficulty, path, substr(sha256({_P.format('path')}), 1, 16) AS candidate_id, len(path) AS length, bool_or(good) AS correct FROM obs GROUP BY 1, 2),
    c AS (SELECT *, ('0x' || substr(candidate_id, 1, 7))::INTEGER AS evaluation_index, len(list_distinct(path)) AS n_layers FROM lab WHERE correct)"""
_BEAM = """
    e AS (SELECT vec_id::VARCHAR AS id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL),
    st AS (SELECT id, v, [0] || list_filter(range(1, 28), lambda i: 1 / (1 + exp(-3 * v[i + 1])) >= 0.5) || [28] AS starts FROM e),
    cu AS (SELECT id, v, list_sort(flatten(list_transform(range(1, len(starts)), lambda k: range(starts[k], starts[k + 1], 4)))) || [28] AS cuts FROM st),
    sg AS (SELECT id, v, n, cuts[n]::INTEGER AS a, (cuts[n + 1] - cuts[n])::INTEGER AS size FROM cu, range(1, 29) r(n) WHERE n < len(cuts)),
    op AS (SELECT id, n, a, size, o, l - greatest(v[a + 2], v[a + 18], v[a + 34]) - ln(exp(v[a + 2] - greatest(v[a + 2], v[a + 18], v[a + 34])) + exp(v[a + 18] - greatest(v[a + 2], v[a + 18], v[a + 34]))
                  + exp(v[a + 34] - greatest(v[a + 2], v[a + 18], v[a + 34]))) AS logp
           FROM (SELECT *, unnest([0, 1, 2]) AS o, unnest([v[a + 2], v[a + 18], v[a + 34]]) AS l FROM sg)),
    top AS (SELECT *, row_number() OVER (PARTITION BY id, n ORDER BY logp DESC, o) AS choice FROM op QUALIFY choice <= 2),
    bm AS (SELECT id, 0::BIGINT AS n, 0.0::DOUBLE AS score, []::INTEGER[] AS path, 0 AS length, 1::BIGINT AS place FROM e
           UNION ALL
           SELECT id, n, score, path, length, place FROM (
             SELECT top.id, top.n, bm.score + logp AS score, bm.path || CASE o WHEN 0 THEN []::INTEGER[] WHEN 1 THEN range(a, a + size)::INTEGER[] ELSE (range(a, a + size) || range(a, a + size))::INTEGER[] END AS path, bm.length + o * size AS length,
                    row_number() OVER (PARTITION BY top.id ORDER BY bm.score + logp DESC, bm.place, choice) AS place FROM bm JOIN top ON top.id = bm.id AND top.n = bm.n + 1) WHERE place <= 5),
    bs AS (SELECT bm.*, place::INTEGER AS rank FROM bm JOIN cu ON cu.id = bm.id AND bm.n = len(cuts) - 1)"""
SQL = {
    "beam_decode": f"WITH RECURSIVE {_BEAM} SELECT id AS sample_id, rank, round(score, 6) AS score, {_P.format('path')} AS path FROM bs",
    "beam_rerank": f"""WITH RECURSIVE {_BEAM} SELECT id AS sample_id, row_number() OVER (PARTITION BY id ORDER BY round(score - 0.1::DOUBLE * length, 9) DESC, rank)::INTEGER AS new_rank, rank, length::INTEGER AS length FROM bs QUALIFY new_rank <= 2""",
    "path_layer_actions": f"WITH {_E} SELECT {_P.format('path')} AS path, array_to_string(list_transform({_N}, lambda n: CASE n WHEN 0 THEN 'skip' WHEN 1 THEN 'keep' ELSE 'loop' END), ',') AS actions FROM p WHERE list_max({_N}) <= 2",
    "path_from_actions": f"WITH {_E} SELECT {_P.format('path')} AS path, {_P.format('list_sort(path)')} AS layer_path FROM p WHERE list_max({_N}) <= 2 AND len(path) > 0",
    "path_counts": f"WITH {_E} SELECT {_P.format('path')} AS path, array_to_string({_N}, ',') AS counts FROM p",
    "path_digest_id": f"SELECT candidate_id, substr(sha256({_P.format('path')}), 1, 16) AS computed_id FROM candidate",
    "path_seeds": "SELECT DISTINCT sample_id, ('0x' || substr(sha256('[42,\"' || sample_id || '\"]'), 1, 8))::BIGINT AS seed FROM manifest",
    "path_edits": f"""
        WITH cut AS (SELECT candidate_id, path, a, z FROM candidate, range(0, 40) r(a), range(1, 5) s(z) WHERE a + z <= len(path)),
          e AS (SELECT candidate_id, path, path[1:a] || path[a + z + 1:] AS p FROM cut UNION SELECT candidate_id, path, path[1:a + z] || path[a + 1:a + z] || path[a + z + 1:] FROM cut)
        SELECT DISTINCT candidate_id, {_P.format('p')} AS edited FROM e WHERE len(p) BETWEEN 1 AND 32 AND p <> path""",
    "path_levenshtein": f"""
        WITH {_S}, t AS (SELECT sample_id, (generate_subscripts(evaluations, 1) - 1)::INTEGER AS i, unnest(evaluations).path AS path FROM s), c AS (SELECT *, {_CODE} AS code FROM t)
        SELECT c.sample_id, c.i AS evaluation_index, o.i AS other_index, levenshtein(c.code, o.code)::INTEGER AS distance FROM c JOIN c o ON c.sample_id = o.sample_id AND c.i < o.i""",
    "path_distance_triple": f"""
        WITH RECURSIVE {_E}, {PARSE_SQL}, t AS (SELECT sample_id, (generate_subscripts(evaluations, 1) - 1)::INTEGER AS i, unnest(evaluations).path AS path FROM s),
          c AS (SELECT t.*, {_CODE} AS code, layer_ops FROM t JOIN parse USING (path))
        SELECT c.sample_id, c.i AS evaluation_index, o.i AS other_index, list_sum(list_transform(list_zip(c.layer_ops, o.layer_ops), lambda z: abs(z[1] - z[2])))::INTEGER AS operation_distance,
               levenshtein(c.code, o.code)::INTEGER AS edit_distance, abs(len(c.path) - len(o.path))::INTEGER AS length_difference FROM c JOIN c o ON c.sample_id = o.sample_id AND c.i < o.i""",
    "path_canonical_parse": f"""
        WITH RECURSIVE {_E}, {PARSE_SQL} SELECT {_P.format('p.path')} AS path, parse.path IS NOT NULL AS representable, {_P.format('seg_flip')} AS seg_flip, {_P.format('op_labels')} AS op_labels,
               {_P.format('layer_ops')} AS layer_ops FROM p LEFT JOIN parse USING (path)""",
    "path_representable": f"""
        WITH RECURSIVE {_E}, {PARSE_SQL} SELECT parse.path IS NOT NULL AS representable, len(list_filter(p.path, lambda x: x < 0 OR x > 27)) = 0 AND coalesce(list_max(list_transform(p.path, lambda x: len(list_filter(p.path, lambda y: y = x)))), 0) <= 2 AS in_vocabulary,
               count(*) AS n FROM p LEFT JOIN parse USING (path) GROUP BY 1, 2""",
    "path_round_trip": f"WITH RECURSIVE {_E}, {PARSE_SQL} SELECT {_P.format('path')} AS path, {_P.format('path')} AS decoded, list_sum(list_transform(list_zip(ops, sizes), lambda z: z[1] * z[2]))::INTEGER AS length FROM parse",
    "pair_extremes": f"""
        WITH {_LABEL}, lo AS (SELECT difficulty, candidate_id, length, row_number() OVER (PARTITION BY difficulty ORDER BY length, n_layers, evaluation_index, candidate_id) AS rank FROM c QUALIFY rank <= 5),
          hi AS (SELECT difficulty, candidate_id, length, row_number() OVER (PARTITION BY difficulty ORDER BY length DESC, n_layers DESC, evaluation_index DESC, candidate_id DESC) AS rank FROM c QUALIFY rank <= 5)
        SELECT difficulty, candidate_id, length::INTEGER AS length, 'simplest' AS role, rank::INTEGER AS rank FROM lo
        UNION ALL SELECT difficulty, candidate_id, length::INTEGER, 'most_complex', rank::INTEGER FROM hi WHERE (difficulty, candidate_id) NOT IN (SELECT (difficulty, candidate_id) FROM lo)""",
}
