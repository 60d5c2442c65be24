"""Registered queries of the search-record and trace operators, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.grammar import parsed
from ..operators import ingest, lookup, mining, records, traces, transfer
from ..runtime import table
from . import broken

_S = "s AS (SELECT * FROM search_record QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY written_at DESC, record_digest DESC) = 1)"
_M = "m AS (SELECT * FROM manifest QUALIFY row_number() OVER (PARTITION BY sample_id, global_index ORDER BY prepared_at DESC, source_query_id DESC) = 1)"
_V, _I = "coalesce(final_valid_transitions, [])", "coalesce(final_invalid_transitions, [])"
_FULL = "range(0, 28)::INTEGER[]"


def _search(spark, sf_dir, *columns):
    return records.search_records(spark, sf_dir, "sample_id", *columns)


def _manifest(spark, sf_dir, *columns):
    return ingest.latest_manifest(table(spark, sf_dir, "manifest"), "sample_id", *columns)


_SETS = ("final_valid_transitions", "final_invalid_transitions")


def record_summary(spark, sf_dir):
    return records.summary(_search(spark, sf_dir, "status", *_SETS), _manifest(spark, sf_dir).count())


def record_counts(spark, sf_dir):
    return records.value_counts(_search(spark, sf_dir, "split", "failure_reason"))


def record_missing(spark, sf_dir):
    return records.missing(_manifest(spark, sf_dir, "global_index", "split"), table(spark, sf_dir, "search_record")).select("sample_id", "global_index", "split")


def record_placement(spark, sf_dir):
    return records.misplaced(_search(spark, sf_dir, "global_index", "position"), 8, F.pmod("position", F.lit(8))).select("sample_id", "global_index", "position")


def record_source_mismatches(spark, sf_dir):
    return records.source_mismatches(broken.manifest(_manifest(spark, sf_dir, *records.MANIFEST_FIELDS)), _search(spark, sf_dir, *records.MANIFEST_FIELDS))


def record_violations(spark, sf_dir):
    return records.violations(_search(spark, sf_dir, "split", "status", "failure_reason", "initial_score", "evaluations", "search_statistics", *_SETS))


def record_transition_violations(spark, sf_dir):
    return records.transition_violations(broken.search_records(_search(spark, sf_dir, "evaluations", *_SETS)))


def record_incomplete(spark, sf_dir):
    return records.incomplete(_manifest(spark, sf_dir), _search(spark, sf_dir, "status"))


def record_merged(spark, sf_dir):
    m = records.merged(_search(spark, sf_dir, "status", "question", "gt_ans", "difficulty", "split", "global_index", "initial_score", *_SETS))
    return m.select("sample_id", "difficulty", "split", "global_index", "initial_score", F.size("final_valid_transitions").alias("n_valid"), F.size("final_invalid_transitions").alias("n_invalid"))


def universal_violations(spark, sf_dir):
    return records.universal_violations(broken.universal_records(table(spark, sf_dir, "universal_record")), table(spark, sf_dir, "candidate"))


_SIGNED = ["sample_id", "difficulty", "split", "global_index", "status"]


def record_checksums(spark, sf_dir):
    """Checksums attached to all records; then some records are changed (digit 0) or lose theirs (1)."""
    d = F.substring("sample_id", 1, 1)
    signed = records.checksummed(_search(spark, sf_dir, *_SIGNED[1:]), _SIGNED)
    changed = signed.withColumns({"status": F.when(d == "0", "changed").otherwise(F.col("status")), "record_digest": F.when(d != "1", F.col("record_digest"))})
    return records.digest_violations(changed, "sample_id", _SIGNED)


def record_digests(spark, sf_dir):
    return records.checksummed(_search(spark, sf_dir, *_SIGNED[1:]), _SIGNED).select("sample_id", "record_digest")


def record_configs(spark, sf_dir):
    return records.config_violations(broken.search_records(_search(spark, sf_dir, "config_id")), "config_id")


def run_validated(spark, sf_dir):
    """All rules over a broken run."""
    m = broken.manifest(_manifest(spark, sf_dir, *records.MANIFEST_FIELDS))
    s = broken.search_records(_search(spark, sf_dir, "question", "gt_ans", "difficulty", "split", "position", "global_index", "source_query_id", "config_id", "status", "failure_reason", "initial_score", "evaluations", "search_statistics", *_SETS))
    return records.validated(m, s, broken.universal_records(table(spark, sf_dir, "universal_record")), broken.candidates(table(spark, sf_dir, "candidate")))


def candidate_violations(spark, sf_dir):
    c = broken.candidates(table(spark, sf_dir, "candidate"))
    return mining.candidate_violations(c, parsed(c, records.DEPTH))


def examples_drop_original(spark, sf_dir):
    return records.original_path_flags(_search(spark, sf_dir, *_SETS))


def training_examples(spark, sf_dir):
    x = records.training_examples(_search(spark, sf_dir, "question", "gt_ans", "split", *_SETS).filter("split = 'train'"), anti_original=True)
    return x.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("path", "seg_flip", "op_labels")} | {"weight": F.round("weight", 9)})


def examples_soft_drop(spark, sf_dir):
    x = records.training_examples(_search(spark, sf_dir, "question", "gt_ans", "split", *_SETS).filter("split = 'train'"), drop_original=True, keep_probability=0.3)
    return x.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or("is_original_path").alias("kept"))


def example_weights(spark, sf_dir):
    x = records.training_examples(_search(spark, sf_dir, "question", "gt_ans", "split", *_SETS).filter("split = 'train'"))
    w = records.length_weights(x, F.substring("sample_id", 1, 1), 0.05)
    return w.select("batch", "sample_id", F.array_join(F.col("path").cast("array<string>"), ",").alias("path"), F.round("loss_weight", 6).alias("loss_weight"))


def loader_parity(spark, sf_dir):
    return records.loader_parity(_search(spark, sf_dir, "question", "gt_ans", "split", *_SETS))


def trace_order(spark, sf_dir):
    t = traces.evaluation_trace(_search(spark, sf_dir, "evaluations"))
    return t.select("sample_id", "evaluation_index", F.array_join(F.col("path").cast("array<string>"), ",").alias("path"), "score")


def trace_quota_stop(spark, sf_dir):
    q = traces.quota_stop(traces.evaluation_trace(_search(spark, sf_dir, "evaluations")), 2, 2)
    return q.filter("stop_index is not null")


def trace_time_budget(spark, sf_dir):
    return traces.time_budget(table(spark, sf_dir, "events"), "user_id", [F.col("ts"), F.col("event_id")], F.coalesce("value", F.lit(0.0)), 500.0).filter("stop_position is not null")


def trace_features(spark, sf_dir):
    f = traces.search_features(traces.evaluation_trace(_search(spark, sf_dir, "evaluations")))
    return f.select("sample_id", "evaluation_index", "score", F.array_join(F.col("counts").cast("array<string>"), ",").alias("counts"))


def _decoded(spark, sf_dir):
    """Stand-in for decoder output: three candidates drawn by hash for every searched sample."""
    c = table(spark, sf_dir, "candidate").select("path", (F.row_number().over(Window.orderBy("candidate_id")) - 1).cast("bigint").alias("drawn"))  # a frozen set of few rows
    n = max(c.count(), 1)
    ranks = _search(spark, sf_dir).select("sample_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("rank"))
    drawn = F.pmod(F.conv(F.substring(F.sha2(F.concat_ws("|", "sample_id", F.col("rank").cast("string")), 256), 1, 8), 16, 10).cast("bigint"), F.lit(n))
    return ranks.withColumn("drawn", drawn).join(c, "drawn").select("sample_id", "rank", "path")


def lookup_types(spark, sf_dir):
    out = lookup.looked_up(_decoded(spark, sf_dir), _search(spark, sf_dir, *_SETS))
    return out.groupBy("rank", "lookup_type").agg(F.count(F.lit(1)).alias("n"))


def cache_breakdown(spark, sf_dir):
    return lookup.cache_breakdown(lookup.sample_results(lookup.looked_up(_decoded(spark, sf_dir), _search(spark, sf_dir, *_SETS))))


def baseline_join(spark, sf_dir):
    return transfer.with_search_baseline(transfer.held_out(table(spark, sf_dir, "universal_record")), _search(spark, sf_dir, "initial_score")).groupBy("split", "agrees", F.col("search_score").isNull().alias("unmatched")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = (
    record_summary, record_counts, record_missing, record_placement, record_source_mismatches, record_violations, record_transition_violations, record_incomplete, record_merged,
    universal_violations, record_checksums, record_digests, record_configs, run_validated, candidate_violations, examples_drop_original, examples_soft_drop, training_examples, example_weights, loader_parity,
    trace_order, trace_quota_stop, trace_time_budget, trace_features, lookup_types, cache_breakdown, baseline_join,
)

_JOIN = "array_to_string({}, ',')"
_EV = "e AS (SELECT sample_id, unnest(evaluations) AS ev, generate_subscripts(evaluations, 1) - 1 AS evaluation_index FROM s)"
_DECODED = f"""{_S}, d AS (
    SELECT s.sample_id, c.path, final_valid_transitions AS v, final_invalid_transitions AS i, r.rank FROM s, range(1, 4) r(rank)
    JOIN (SELECT path, row_number() OVER (ORDER BY candidate_id) - 1 AS drawn FROM candidate) c ON c.drawn = ('0x' || substr(sha256(s.sample_id || '|' || r.rank), 1, 8))::BIGINT % (SELECT count(*) FROM candidate)),
  l AS (SELECT sample_id, rank, CASE WHEN len(path) = 0 THEN 'empty' WHEN list_contains(coalesce(v, []), path) THEN 'valid_cache' WHEN list_contains(coalesce(i, []), path) THEN 'invalid_cache' ELSE 'online' END AS lookup_type FROM d)"""
_EXAMPLES = f"""{_S}, t AS (SELECT sample_id, question, gt_ans, {_V} AS v FROM s WHERE split = 'train'),
    f AS (SELECT *, list_contains(v, {_FULL}) AS original, len(list_filter(v, lambda x: len(x) < 28)) > 0 AS shorter, unnest(v) AS path FROM t), p AS (SELECT DISTINCT path FROM f), {broken.PARSE_SQL},
    g AS (SELECT * FROM f QUALIFY len(v) <= 50 OR row_number() OVER (PARTITION BY sample_id ORDER BY sha256('42|' || sample_id || '|' || {_JOIN.format('path')})) <= 50),
    x AS (SELECT g.*, seg_flip, op_labels FROM g JOIN parse USING (path))"""
_RULES = {
    "bad_path": "len(list_filter(ev, lambda x: len(x.path) < 1 OR len(x.path) > 32 OR len(list_filter(x.path, lambda y: y < 0 OR y >= 28)) > 0)) > 0",
    "duplicate_path": "len(list_distinct(list_transform(ev, lambda x: x.path))) < len(ev)",
    "bad_score": "len(list_filter(ev, lambda x: NOT coalesce(x.score IN (0.0, 1.0), FALSE))) > 0",
    "baseline_mismatch": f"initial_score IS DISTINCT FROM list_filter(ev, lambda x: x.path = {_FULL})[1].score",
    "overlap": f"len(list_filter({_V}, lambda x: list_contains({_I}, x))) > 0",
    "unknown_status": "NOT coalesce(status IN ('complete', 'failed'), FALSE)",
    "evaluation_count": "search_statistics.unique_evaluations IS DISTINCT FROM len(ev)",
    "complete_without_baseline": "status = 'complete' AND NOT coalesce(initial_score IN (0.0, 1.0), FALSE)",
    "failed_without_reason": "status = 'failed' AND coalesce(failure_reason, '') = ''",
    "test_was_searched": f"split = 'test' AND len(list_filter(ev, lambda x: x.path <> {_FULL})) > 0",
}
SQL = {
    "record_summary": f"""
        WITH {_S}, {_M}, c AS (SELECT *, len({_V}) AS nv, len({_I}) AS ni, coalesce(list_sum(list_transform({_V}, lambda x: len(x))), 0) AS lv, coalesce(list_sum(list_transform({_I}, lambda x: len(x))), 0) AS li FROM s)
        SELECT (SELECT count(*) FROM m) AS total_questions, count(*) AS persisted_questions, count(*) FILTER (status = 'complete') AS completed_questions, count(*) FILTER (status = 'failed') AS failed_questions,
               count(*) FILTER (nv > 0) AS questions_with_valid_paths, count(*) FILTER (status = 'complete' AND nv = 0) AS complete_without_valid_paths,
               round(sum(nv) / greatest(count(*), 1), 6) AS mean_valid_paths, round(sum(ni) / greatest(count(*), 1), 6) AS mean_invalid_paths, round(sum(lv) / greatest(sum(nv), 1), 6) AS mean_valid_path_length,
               round(sum(li) / greatest(sum(ni), 1), 6) AS mean_invalid_path_length, round((sum(lv) + sum(li)) / greatest(sum(nv) + sum(ni), 1), 6) AS mean_path_length FROM c""",
    "record_counts": f"WITH {_S} SELECT 'split' AS kind, split AS value, count(*) AS n FROM s GROUP BY 2 UNION ALL SELECT 'failure_reason', failure_reason, count(*) FROM s WHERE failure_reason <> '' GROUP BY 2",
    "record_missing": f"WITH {_M} SELECT sample_id, global_index, split FROM m WHERE sample_id NOT IN (SELECT sample_id FROM search_record WHERE sample_id IS NOT NULL)",
    "record_placement": f"WITH {_S} SELECT sample_id, global_index, position FROM s WHERE global_index % 8 <> position % 8",
    "record_source_mismatches": f"""
        WITH {_S}, {_M}, {broken.MANIFEST_SQL}, j AS (SELECT s.sample_id, mb.sample_id IS NULL AS gone, {", ".join(f"s.{c} IS DISTINCT FROM mb.{c} AS d_{c}" for c in records.MANIFEST_FIELDS)} FROM s LEFT JOIN mb USING (sample_id))
        SELECT sample_id, 'sample_id' AS field FROM j WHERE gone """ + " ".join(f"UNION ALL SELECT sample_id, '{c}' FROM j WHERE NOT gone AND d_{c}" for c in records.MANIFEST_FIELDS),
    "record_violations": f"WITH {_S}, c AS (SELECT *, coalesce(evaluations, []) AS ev FROM s) " + " UNION ALL ".join(f"SELECT sample_id, '{r}' AS rule FROM c WHERE {w}" for r, w in _RULES.items()),
    "record_incomplete": f"WITH {_S}, {_M} SELECT (SELECT count(*) FROM m WHERE sample_id NOT IN (SELECT sample_id FROM s))::BIGINT AS missing, (SELECT count(*) FROM s WHERE status = 'failed')::BIGINT AS failed",
    "record_merged": f"WITH {_S} SELECT sample_id, difficulty, split, global_index, initial_score, len(final_valid_transitions)::INTEGER AS n_valid, len(final_invalid_transitions)::INTEGER AS n_invalid FROM s WHERE status = 'complete'",
    "universal_violations": f"""
        WITH {broken.UNIVERSAL_SQL}, k AS (SELECT sample_id, status, unnest(map_keys(scores)) AS candidate_id FROM ub),
          n AS (SELECT ub.sample_id, bool_or(ub.status = 'complete') AS complete, count(DISTINCT k.candidate_id) AS n FROM ub LEFT JOIN k ON ub.sample_id = k.sample_id AND k.candidate_id IN (SELECT candidate_id FROM candidate) GROUP BY 1)
        SELECT DISTINCT sample_id, rule FROM (
            SELECT sample_id, 'bad_split' AS rule FROM ub WHERE NOT coalesce(split IN ('validation', 'test'), FALSE)
            UNION ALL SELECT sample_id, 'unknown_status' FROM ub WHERE NOT coalesce(status IN ('complete', 'failed'), FALSE)
            UNION ALL SELECT sample_id, 'complete_without_baseline' FROM ub WHERE status = 'complete' AND NOT coalesce(baseline_score IN (0.0, 1.0), FALSE)
            UNION ALL SELECT sample_id, 'bad_score' FROM ub WHERE len(list_filter(map_values(scores), lambda x: NOT coalesce(x IN (0.0, 1.0), FALSE))) > 0
            UNION ALL SELECT sample_id, 'unknown_candidate' FROM k WHERE candidate_id NOT IN (SELECT candidate_id FROM candidate)
            UNION ALL SELECT sample_id, 'missing_candidate' FROM n WHERE complete AND n < (SELECT count(DISTINCT candidate_id) FROM candidate)
            UNION ALL SELECT sample_id, 'failed_without_reason' FROM ub WHERE status = 'failed' AND coalesce(failure_reason, '') = '')""",
    "record_checksums": f"WITH {_S} SELECT sample_id, CASE sample_id[1] WHEN '1' THEN 'no_digest' ELSE 'wrong_digest' END AS rule FROM s WHERE sample_id[1] = '1' OR sample_id[1] = '0' AND status <> 'changed'",
    "record_digests": f"""
        WITH {_S} SELECT sample_id, sha256('{{"difficulty":' || coalesce(difficulty::VARCHAR, 'null') || ',"global_index":' || coalesce(global_index::VARCHAR, 'null') || ',"sample_id":"' || sample_id || '","split":"' || split || '","status":"' || status || '"}}') AS record_digest FROM s""",
    "record_configs": f"WITH {_S}, {broken.SEARCH_SQL}, g AS (SELECT coalesce(config_id, '') AS value, count(*) AS n FROM sb GROUP BY 1) SELECT * FROM g WHERE value = '' OR (SELECT count(*) FROM g) > 1",
    "record_transition_violations": f"""
        WITH RECURSIVE {_S}, {broken.SEARCH_SQL}, ev AS (SELECT sample_id, unnest(evaluations) AS e FROM sb), p AS (SELECT DISTINCT e.path AS path FROM ev), {broken.PARSE_SQL},
          expected AS (SELECT sample_id, e.path AS path, CASE WHEN e.score = 1 THEN 'valid' ELSE 'invalid' END AS label FROM ev JOIN parse ON parse.path = e.path),
          stored AS (SELECT sample_id, unnest(coalesce(final_valid_transitions, [])) AS path, 'valid' AS label FROM sb UNION ALL SELECT sample_id, unnest(coalesce(final_invalid_transitions, [])), 'invalid' FROM sb)
        SELECT DISTINCT sample_id, label || '_missing' AS rule FROM (SELECT * FROM expected EXCEPT SELECT * FROM stored)
        UNION ALL SELECT DISTINCT sample_id, label || '_unexpected' FROM (SELECT * FROM stored EXCEPT SELECT * FROM expected)""",
    "candidate_violations": f"""
        WITH RECURSIVE {broken.CANDIDATE_SQL}, p AS (SELECT DISTINCT path FROM cb), {broken.PARSE_SQL}, d AS (SELECT path, count(*) AS n, min(candidate_id) AS candidate_id FROM cb GROUP BY 1)
        SELECT candidate_id, 'bad_path' AS rule FROM cb WHERE len(path) NOT BETWEEN 1 AND 32
        UNION ALL SELECT candidate_id, 'bad_id' FROM cb WHERE candidate_id <> substr(sha256('[' || {_JOIN.format('path')} || ']'), 1, 16)
        UNION ALL SELECT candidate_id, 'bad_length' FROM cb WHERE length IS DISTINCT FROM len(path)
        UNION ALL SELECT candidate_id, 'no_source' FROM cb WHERE coalesce(len(sources), 0) < 1
        UNION ALL SELECT candidate_id, 'not_representable' FROM cb WHERE path NOT IN (SELECT path FROM parse)
        UNION ALL SELECT candidate_id, 'duplicate_path' FROM d WHERE n > 1""",
    "training_examples": f"""
        WITH RECURSIVE {_EXAMPLES}
        SELECT sample_id, question, gt_ans AS gt, {_JOIN.format('path')} AS path, {_JOIN.format('seg_flip')} AS seg_flip, {_JOIN.format('op_labels')} AS op_labels, len(path)::INTEGER AS path_len, path = {_FULL} AS is_original_path,
               original AS original_path_is_valid, NOT original AS anti_original_active, shorter AND original AS trigger_shorter_valid, round(1.0::DOUBLE / count(*) OVER (PARTITION BY sample_id), 9) AS weight FROM x""",
    "examples_soft_drop": f"""
        WITH RECURSIVE {_EXAMPLES}
        SELECT sample_id, count(*) AS n, bool_or(path = {_FULL}) AS kept FROM x
        WHERE path <> {_FULL} OR NOT (shorter AND original) OR ('0x' || substr(sha256('keep|42|' || sample_id), 1, 13))::BIGINT < (0.3 * 4503599627370496)::BIGINT GROUP BY 1""",
    "example_weights": f"""
        WITH RECURSIVE {_EXAMPLES}, y AS (SELECT sample_id[1] AS batch, sample_id, path, exp(-0.05::DOUBLE * len(path)) AS w, 1.0::DOUBLE / count(*) OVER (PARTITION BY sample_id) AS weight FROM x),
          z AS (SELECT batch, avg(w) AS mw, avg(w * weight) AS mww FROM y GROUP BY 1)
        SELECT batch, sample_id, {_JOIN.format('path')} AS path, round(w / mw * weight / (mww / mw), 6) AS loss_weight FROM y JOIN z USING (batch)""",
    "loader_parity": f"WITH RECURSIVE {_EXAMPLES} SELECT (SELECT coalesce(sum(len({_V})), 0)::BIGINT FROM s WHERE split = 'train') AS expected, (SELECT count(*) FROM f JOIN parse USING (path)) AS loaded",
    "examples_drop_original": f"""
        WITH {_S}, c AS (SELECT sample_id, {_V} AS v FROM s), f AS (SELECT *, list_contains(v, {_FULL}) AS o, len(list_filter(v, lambda x: len(x) < 28)) > 0 AS h FROM c)
        SELECT sample_id, o AS has_original, h AS has_shorter, len(v)::INTEGER AS n_valid, CASE WHEN o AND h THEN len(list_filter(v, lambda x: x <> {_FULL})) ELSE len(v) END::INTEGER AS n_kept FROM f""",
    "trace_order": f"WITH {_S}, {_EV} SELECT sample_id, evaluation_index::INTEGER AS evaluation_index, {_JOIN.format('ev.path')} AS path, ev.score AS score FROM e",
    "trace_quota_stop": f"""
        WITH {_S}, {_EV}, r AS (SELECT sample_id, evaluation_index, count(*) FILTER (ev.score = 1) OVER w AS correct, count(*) FILTER (ev.score = 0) OVER w AS wrong FROM e
                                WINDOW w AS (PARTITION BY sample_id ORDER BY evaluation_index ROWS UNBOUNDED PRECEDING))
        SELECT sample_id, evaluation_index::INTEGER AS stop_index, correct, wrong FROM r WHERE evaluation_index > 0 AND evaluation_index % 2 = 0 AND least(correct, wrong) >= 2
        QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY evaluation_index) = 1""",
    "trace_time_budget": """
        WITH r AS (SELECT user_id, coalesce(value, 0) AS v, row_number() OVER w - 1 AS p, sum(coalesce(value, 0)) OVER (w ROWS UNBOUNDED PRECEDING) AS run FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
        SELECT user_id, count(*) AS n, round(sum(v), 6) AS used, min(p) FILTER (round(run, 6) >= 500)::INTEGER AS stop_position FROM r GROUP BY 1 HAVING min(p) FILTER (round(run, 6) >= 500) IS NOT NULL""",
    "trace_features": f"WITH {_S}, {_EV} SELECT sample_id, evaluation_index::INTEGER AS evaluation_index, ev.score AS score, array_to_string(list_transform(range(0, 28), lambda l: len(list_filter(ev.path, lambda y: y = l))), ',') AS counts FROM e",
    "lookup_types": f"WITH {_DECODED} SELECT rank::INTEGER AS rank, lookup_type, count(*) AS n FROM l GROUP BY 1, 2",
    "cache_breakdown": f"""
        WITH {_DECODED}, r AS (SELECT sample_id, bool_or(lookup_type = 'valid_cache') AS v, count(*) FILTER (lookup_type = 'online') AS o, count(*) FILTER (lookup_type = 'valid_cache') AS k FROM l GROUP BY 1)
        SELECT count(*) AS samples, count(*) FILTER (v) AS correct_found, round(count(*) FILTER (v) / greatest(count(*), 1), 6) AS correct_found_rate, count(*) FILTER (v) AS via_valid, 0::BIGINT AS via_online, 0::BIGINT AS via_both,
               count(*) FILTER (v) AS valid_only, 0::BIGINT AS online_only, coalesce(sum(k) FILTER (v), 0)::BIGINT AS valid_path_hits, coalesce(sum(o) FILTER (v), 0)::BIGINT AS online_paths FROM r""",
    "baseline_join": f"""
        WITH {_S}, u AS (SELECT * FROM universal_record WHERE status = 'complete' QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY record_digest) = 1)
        SELECT u.split, u.baseline_score IS NOT DISTINCT FROM s.initial_score AS agrees, s.initial_score IS NULL AS unmatched, count(*) AS n FROM u LEFT JOIN s USING (sample_id) GROUP BY 1, 2, 3""",
}
