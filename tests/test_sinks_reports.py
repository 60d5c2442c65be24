import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.functions import naming, prompts
from pathloom.operators import reports
from pathloom.sources import arrays, datasets, readers, sinks


def test_write_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", [1, 2]), (2, "b", None)], "id int, d string, xs array<int>")
    path = str(tmp_path / "t")
    assert sinks.write_once(df, path, ["d"]) and not sinks.write_once(df.orderBy(F.desc("id")), path, ["d"])
    with pytest.raises(ValueError, match="other rows"):
        sinks.write_once(df.limit(1), path, ["d"])
    sinks.write_csv(df, str(tmp_path / "c"), ["xs", "id"])
    assert {tuple(r) for r in spark.read.option("header", "true").option("escape", '"').csv(str(tmp_path / "c")).collect()} == {(None, "2"), ("[1,2]", "1")}
    sinks.write_json_lines(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    assert sinks.markdown_table(df.select("id", F.lit("a|b\nc").alias("t"))).splitlines()[2] == "| 1 | a\\|b c |"
    with pytest.raises(ValueError):
        sinks.markdown_table(df, 1)


def test_text_stays_inside(tmp_path):
    sinks.write_text(str(tmp_path / "s.md"), "x", str(tmp_path))
    assert (tmp_path / "s.md").read_text() == "x"
    with pytest.raises(ValueError):
        sinks.write_text(str(tmp_path / ".." / "s.md"), "x", str(tmp_path))


def test_resume_and_quarantine(spark, tmp_path):
    work = spark.createDataFrame([(i,) for i in range(10)], "k int")
    path = str(tmp_path / "done")
    assert sinks.resume(work.filter("k < 4"), path, "k", lambda d: d.withColumn("v", F.col("k") * 2)) == 4
    assert sinks.resume(work, path, "k", lambda d: d.withColumn("v", F.col("k") * 2)) == 6
    assert sinks.resume(work, path, "k", lambda d: d.withColumn("v", F.col("k") * 2)) == 0
    assert spark.read.parquet(path).count() == 10
    lines = spark.createDataFrame([('{"a":1}',), ("{",)], "value string")
    sinks.quarantine(readers.checked_lines(lines, "value", []), str(tmp_path / "g"), str(tmp_path / "b"))
    assert [r.error for r in spark.read.parquet(str(tmp_path / "b")).collect()] == ["damaged"]


def test_datasets_share_a_schema(spark):
    math = spark.createDataFrame([("We add", r"so \boxed{3}", "Level ?", "Number Theory"), ("P", r"\boxed{4}", "Level 5", "Algebra")], "problem string, solution string, level string, type string")
    gsm = spark.createDataFrame([("q", "steps\n#### 12")], "question string, answer string")
    oly = spark.createDataFrame([("Q", "Numerical", False, None, ["1"], "0.1", "Algebra")], "question string, answer_type string, is_multiple_answer boolean, unit string, final_answer array<string>, error string, subfield string")
    got = datasets.load({"math/test;level=[2,5]": math, "gsm8k/test": gsm, "olympiadbench/en": oly}, {"gsm8k/test": 4}).collect()
    assert [(r.dataset, r.ref_ans, r.level) for r in got] == [("math/test", "3", "2"), ("math/test", "4", "5"), ("gsm8k/test", "12", None), ("olympiadbench/en", "1", None)]
    assert got[0].domain == "NumberTheory" and got[2].max_n_trials == 4 and got[3].abs_tol == 0.1 and got[3].query.endswith("\nQ")
    with pytest.raises(ValueError):
        datasets.load({"other": gsm})


def test_contest_prompt(spark):
    df = spark.createDataFrame([("Numerical,Interval", True, "cm"), ("Tuple", False, "")], "k string, m boolean, u string")
    a, b = [r.x for r in df.select(prompts.contest_prompt(F.col("k"), F.col("m"), F.col("u")).alias("x")).collect()]
    assert "in order being a numerical value, an interval. " in a and "commas}(unit)." in a and "unit of the answer" in a
    assert "should be" not in b and b.endswith("give the result explicitly.")


def test_names_and_rates(spark):
    assert [naming.short_number(x) for x in (0.25, 1, 0, -3, "x", 0.1234)] == ["0.25", "1", "0", "0", "0", "0.123"]
    assert naming.run_name({"nan_guard": True, "nan_lr_backoff": 0.5, "max_paths_per_sample": 50, "beam_size": 5}, evaluation=True) == "_ng_bk0.5_beam5_mpps50"
    s = spark.createDataFrame([(i,) for i in (0, 5, 10, 60, 110, 200)], "s int")
    rate = lambda kind: [round(r.x, 4) for r in s.select(naming.learning_rate_factor(F.col("s"), 110, 10, kind).alias("x")).collect()]
    assert rate("linear") == [0, 0.5, 1, 0.5, 0, 0] and rate("cosine") == [0, 0.5, 1, 0.5, 0, 0] and rate("none") == [0, 0.5, 1, 1, 1, 1]


def test_thinking_report(spark):
    sel = spark.createDataFrame([("f", 1, "a", [0, 1], True), ("f", 1, "b", [0], False), ("g", 1, "c", [1], True), ("g", 1, "d", [1, 1], False)], "figure string, pair_index int, candidate_id string, path array<int>, correct boolean")
    src = spark.createDataFrame([("a", [0, 1], True), ("b", [0, 0], False), ("c", [1], False)], "candidate_id string, path array<int>, correct boolean")
    assert {tuple(r) for r in reports.selection_errors(sel.union(sel.filter("candidate_id = 'a'")), src).collect()} == {("a", "reused"), ("b", "other_path"), ("c", "other_label"), ("d", "unknown")}
    res = spark.createDataFrame([("a", "wrong", "3", "complete", 5, 2, 7, False), ("b", "correct", "4", "complete", 5, 2, 7, False), ("c", "truncated", "", "missing_end_marker", 9, 0, 9, True)], "candidate_id string, outcome string, extracted_answer string, status string, thinking_tokens int, answer_tokens int, generated_tokens int, hit_token_limit boolean")
    s = reports.thinking_summary(reports.thinking_table(sel, res)).first().asDict()
    assert s == {"correct": 1, "wrong": 1, "truncated": 1, "pending": 1, "correct_to_correct": 0, "correct_to_wrong": 1, "wrong_to_correct": 1, "wrong_to_wrong": 0}


def test_layerwise_overlap(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 5))
    rows = [(p, s, f"s{i:02d}", (x[i] * (1 if p == "baseline" or s == 0 else rng.normal(size=5))).tolist()) for p in ("baseline", "other") for s in (0, 1) for i in range(40)]
    df = spark.createDataFrame(rows, "program_id string, slot int, sample_id string, vec array<double>")
    got = {(r.program_id, r.slot, r.base_slot): r.overlap for r in reports.layerwise_overlap(reports.slot_neighbours(df, 5, 30), 5).collect()}
    assert got["baseline", 0, 0] == got["baseline", 1, 0] == got["other", 0, 1] == 1.0 and got["other", 1, 0] < 0.9


def test_archives_are_read_by_member(spark, tmp_path):
    x = np.arange(24, dtype=np.float32).reshape(4, 3, 2)
    np.savez_compressed(tmp_path / "a.npz", sample_ids=np.array(["s0", "s1", "s2", "s3"]), pooled=x, other=np.zeros(7))
    (tmp_path / "sub").mkdir()
    np.savez_compressed(tmp_path / "sub" / "b.npz", sample_ids=np.array(["t0"]), pooled=np.ones((1, 3, 2)))
    ids = arrays.read_npz(spark, str(tmp_path), "sample_ids")
    assert ids.columns == ["file", "position", "sample_ids"] and {r.sample_ids for r in ids.collect()} == {"s0", "s1", "s2", "s3", "t0"}
    rows = {r.sample_ids: r.pooled for r in arrays.read_npz(spark, str(tmp_path), "sample_ids", ["pooled"]).collect()}
    assert rows["s2"] == x[2].ravel().tolist() and rows["t0"] == [1.0] * 6
    order = spark.createDataFrame([("t0", 0), ("s3", 1), ("none", 2)], "sample_ids string, place int")
    assert [r.sample_ids for r in arrays.read_npz(spark, str(tmp_path), "sample_ids", ["pooled"], order).orderBy("place").collect()] == ["t0", "s3"]
    with pytest.raises(Exception, match="7 rows for 4 samples"):
        arrays.read_npz(spark, str(tmp_path), "sample_ids", ["other"]).collect()
    (tmp_path / "empty").mkdir()
    assert arrays.read_npz(spark, str(tmp_path / "empty"), "sample_ids").count() == 0


def test_chat_turns(spark):
    df = spark.createDataFrame([("Qwen3-8B",), ("qwen1_5-moe-a2.7b-chat",), ("Qwen2.5-3B-Instruct",), ("Qwen2.5-3B",), ("other",), (None,)], "name string")
    rows = df.select("name", prompts.model_family(F.col("name")).alias("f"), prompts.model_depth(F.col("name")).alias("d"), prompts.chat(F.col("name"), F.lit("q")).alias("c")).collect()
    assert [(r.f, r.d) for r in rows] == [("qwen3", 36), ("qwen1.5-moe", 24), ("qwen2.5", 36), (None, 36), (None, None), (None, None)]
    assert rows[0].c == "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\n<think>\n\n</think>\n\n"
    assert rows[2].c.startswith("<|im_start|>system\nYou are a helpful assistant.<|im_end|>\n") and rows[2].c.endswith("assistant\n") and rows[3].c == rows[4].c == "q"
