"""Registered queries of answer extraction, judging and prompts, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import judge, prompts
from ..runtime import table


def _answers(spark, sf_dir):
    return table(spark, sf_dir, "raw_question").filter("gt_ans is not null").select("raw_id", "query", "query_id", "gt_ans")


def judge_extract_boxed(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(F.col("text").contains("oxed")).select("doc_id", judge.extract_boxed(F.col("text")).alias("answer"))


def judge_boxed_solution(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", judge.boxed_solution(F.col("text")).alias("answer")).filter("answer is not null")


def judge_extract(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", judge.extract_answer(F.col("text")).alias("answer"))


def judge_norm(spark, sf_dir):
    return _answers(spark, sf_dir).select("raw_id", judge.normalize(F.col("gt_ans")).alias("answer"))


def _versions(spark, sf_dir):
    """Answers of the copies of one question against its least row: the reference and what another copy says."""
    a = _answers(spark, sf_dir).filter("query <> ''")
    first = a.groupBy("query").agg(F.min_by("gt_ans", "raw_id").alias("ref"))
    return a.join(first, "query").select("raw_id", "ref", F.col("gt_ans").alias("pred"), "query")


def judge_equal(spark, sf_dir):
    return judge.judged(_versions(spark, sf_dir), "ref", "pred", ["raw_id"], query="query")


def judge_bag_equal(spark, sf_dir):
    return judge.judged(_versions(spark, sf_dir), "ref", "pred", ["raw_id"], tolerance=1e-8)


def judge_numeric_equal(spark, sf_dir):
    v = _versions(spark, sf_dir).select("raw_id", F.col("ref").try_cast("double").alias("r"), F.col("pred").try_cast("double").alias("p")).filter("r is not null and p is not null")
    return v.select("raw_id", judge.numeric_equal(F.col("r"), F.col("p")).alias("equal"), judge.tolerant_equal(F.col("r"), F.col("p")).alias("equal_within"))


def judge_datetime(spark, sf_dir):
    d = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd")
    o = table(spark, sf_dir, "orders").select("o_orderkey", d.alias("d"), F.pmod("o_orderkey", F.lit(4)).alias("k"))
    y, m, day = (F.split("d", "-")[i] for i in range(3))
    text = F.when(F.col("k") == 0, F.col("d")).when(F.col("k") == 1, F.concat_ws("/", day, m, y)).when(F.col("k") == 2, F.concat_ws("/", y, m, day)).otherwise(F.concat(F.col("d"), F.lit(" 7:05")))
    return o.select("o_orderkey", judge.date_time(text).alias("canonical"))


def judge_predicates(spark, sf_dir):
    q = table(spark, sf_dir, "raw_question").filter("query is not null")
    return q.select("raw_id", judge.asks_for_set(F.col("query")).alias("asks_for_set"), judge.has_non_ascii(F.col("query")).alias("non_ascii"), F.coalesce(judge.bool_word(F.col("query")).cast("string"), F.lit("none")).alias("bool_word"))


def judge_format_gate(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text is not null")
    return d.groupBy(F.coalesce(judge.format_gate(F.col("text")).cast("string"), F.lit("judge")).alias("gate")).agg(F.count(F.lit(1)).alias("n"))


_SHOT = ("What is 1 + 1?", "2")
_MODELS = ("Qwen/Qwen3-8B", "Qwen/Qwen1.5-MoE-A2.7B-Chat", "Qwen/Qwen2.5-3B-Instruct", "meta-llama/Llama-3.2-3B-Instruct")


def prompt_render(spark, sf_dir):
    q = table(spark, sf_dir, "heldout_item").filter("text is not null")
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("template"), prompts.render(F.col("text"), t, [_SHOT]).alias("prompt")) for k, t in prompts.TEMPLATES.items())))
    return q.select("item_id", each.alias("x")).select("item_id", "x.*")


def prompt_chat(spark, sf_dir):
    q = table(spark, sf_dir, "heldout_item").filter("text is not null").select("item_id", "text", F.explode(F.array(*map(F.lit, _MODELS))).alias("model"))
    return q.select("item_id", "model", prompts.model_family(F.col("model")).alias("family"), prompts.model_depth(F.col("model")).alias("depth"), prompts.chat(F.col("model"), F.col("text")).alias("prompt"))


def prompt_thinking_split(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    tokens = F.when(F.col("event_id") % 3 == 0, F.array(F.lit(5), F.lit(prompts.THINK_END), F.lit(7), F.lit(9))).otherwise(F.array(F.lit(5), F.lit(6), (F.col("event_id") % 2 + 1).cast("int")))
    s = prompts.thinking_split(tokens, F.col("event_id") % 2 == 0, 3, [2])
    return e.select("event_id", s.alias("s")).select("event_id", "s.*")


QUERIES = (
    judge_extract_boxed, judge_boxed_solution, judge_extract, judge_norm, judge_equal, judge_bag_equal, judge_numeric_equal, judge_datetime, judge_predicates, judge_format_gate, prompt_render, prompt_chat, prompt_thinking_split,
)

_V = """a AS (SELECT raw_id, query, gt_ans FROM raw_question WHERE gt_ans IS NOT NULL AND query <> ''), f AS (SELECT query, arg_min(gt_ans, raw_id) AS ref FROM a GROUP BY 1),
    v AS (SELECT raw_id, try_cast(ref AS DOUBLE) AS r, try_cast(gt_ans AS DOUBLE) AS p FROM a JOIN f USING (query) WHERE r IS NOT NULL AND p IS NOT NULL)"""
_q = lambda x: "'" + x.replace("'", "''") + "'"
_DEPTH = """ch AS (SELECT doc_id, unnest(string_split(tail, '')) AS c, generate_subscripts(string_split(tail, ''), 1) AS i FROM t WHERE starts_with(tail, '{{')),
    de AS (SELECT doc_id, i, CASE WHEN c = '{{' {esc} THEN 1 WHEN c = '}}' {esc} THEN -1 ELSE 0 END AS d FROM ch),
    su AS (SELECT *, sum(d) OVER (PARTITION BY doc_id ORDER BY i) AS deep FROM de), ends AS (SELECT doc_id, min(i) AS z FROM su WHERE d <> 0 AND deep = 0 GROUP BY 1)"""
_NEAR = "abs({a} - p) <= greatest({t} * greatest(abs({a}), abs(p)), 1e-8)"
_PCT = "(({x} > 0 AND {x} < 1) OR ({x} > 1 AND {x} < 100))"
SQL = {
    "judge_numeric_equal": f"""WITH {_V} SELECT raw_id, {_NEAR.format(a='r', t='1e-9')} OR ({_PCT.format(x='p')} AND (({_PCT.format(x='r / 100')} AND {_NEAR.format(a='(r / 100)', t='1e-3')})
        OR ({_PCT.format(x='r * 100')} AND {_NEAR.format(a='(r * 100)', t='1e-3')}))) AS equal, least(abs(r / 100 - p), abs(r - p), abs(r * 100 - p)) <= 1e-8 * 1.01 AS equal_within FROM v""",
    "judge_datetime": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || CASE WHEN o_orderkey % 4 = 3 THEN ' 07:05:00' ELSE '' END AS canonical FROM orders",
    "judge_predicates": """
        SELECT raw_id, contains(query, 'ind the') OR (contains(query, 'all') AND contains(query, 'separate')) AS asks_for_set, strlen(query) <> length(query) AS non_ascii,
               CASE WHEN q LIKE '%yes%' OR q LIKE '%true%' THEN 'true' WHEN q LIKE '%no%' OR q LIKE '%false%' THEN 'false' ELSE 'none' END AS bool_word
        FROM (SELECT raw_id, query, replace(lower(query), 'noindent', '') AS q FROM raw_question WHERE query IS NOT NULL)""",
    "judge_format_gate": "SELECT CASE WHEN contains(text, 'oxed{') THEN 'judge' ELSE '0.0' END AS gate, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "prompt_render": " UNION ALL ".join(
        f"SELECT item_id, {_q(k)} AS template, {_q(t['system'])} || {_q(t['before_query'] + _SHOT[0] + t['after_query'] + t['before_answer'] + t['hint'] + _SHOT[1] + t['between'])} "
        f"|| rtrim({_q(t['before_query'])} || text || {_q(t['after_query'] + t['before_answer'] + t['hint'])}, ' ') AS prompt FROM heldout_item WHERE text IS NOT NULL"
        for k, t in prompts.TEMPLATES.items()
    ),
    "prompt_chat": """
        WITH m(model, family, depth, pre, post) AS (VALUES
            ('Qwen/Qwen3-8B', 'qwen3', 36, '<|im_start|>user' || chr(10), '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || '<think>' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10)),
            ('Qwen/Qwen1.5-MoE-A2.7B-Chat', 'qwen1.5-moe', 24, '<|im_start|>system' || chr(10) || 'You are a helpful assistant.<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10), '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)),
            ('Qwen/Qwen2.5-3B-Instruct', 'qwen2.5', 36, '<|im_start|>system' || chr(10) || 'You are a helpful assistant.<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10), '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)),
            ('meta-llama/Llama-3.2-3B-Instruct', NULL, 28, '', ''))
        SELECT item_id, model, family, depth::INTEGER AS depth, pre || text || post AS prompt FROM heldout_item, m WHERE text IS NOT NULL""",
    "judge_extract_boxed": f"""
        WITH t AS (SELECT doc_id, string_split(text, 'oxed')[-1] AS tail FROM documents WHERE contains(text, 'oxed')), {_DEPTH.format(esc="AND coalesce(lag(c) OVER (PARTITION BY doc_id ORDER BY i), '') <> chr(92)")}
        SELECT t.doc_id, CASE WHEN NOT starts_with(tail, '{{') THEN regexp_replace(split_part(tail, '$', 1), '^\\s+|\\s+$', '', 'g') WHEN z IS NULL THEN substr(tail, 2) ELSE substr(tail, 2, z - 2) END AS answer FROM t LEFT JOIN ends USING (doc_id)""",
    "judge_boxed_solution": f"""
        WITH t AS (SELECT doc_id, substr(string_split(text, chr(92) || 'boxed')[-1], 1) AS tail FROM documents WHERE contains(text, chr(92) || 'boxed')), {_DEPTH.format(esc="")}
        SELECT t.doc_id, substr(tail, 2, z - 2) AS answer FROM t JOIN ends USING (doc_id) WHERE starts_with(tail, '{{')""",
    "prompt_thinking_split": """
        SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 1 WHEN event_id % 2 = 0 THEN 3 ELSE 0 END::INTEGER AS thinking_tokens, CASE WHEN event_id % 3 = 0 THEN 2 WHEN event_id % 2 = 0 THEN 0 ELSE 3 END::INTEGER AS answer_tokens,
               CASE WHEN event_id % 3 = 0 THEN 'complete' WHEN event_id % 2 = 0 THEN 'missing_end_marker' ELSE 'disabled' END AS status,
               event_id % 3 <> 0 AND event_id % 2 = 1 AS ended, NOT (event_id % 3 <> 0 AND event_id % 2 = 1) AS hit_limit FROM events""",
}
