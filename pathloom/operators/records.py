"""Search records: latest delivery, summaries, integrity rules, merging, training examples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grammar import parsed
from ..functions.keys import digest_column
from ..functions.paths import drop_full_path, full_path, has_path, has_shorter
from ..runtime import table
from .ranking import first_by

DEPTH = 28
MAX_LENGTH = int(DEPTH * 1.15)
MANIFEST_FIELDS = ("question", "gt_ans", "difficulty", "split", "position", "global_index", "source_query_id")
_NO_PATHS = "array<array<int>>"


def latest_records(search_record: DataFrame, *columns: str) -> DataFrame:
    """One row per sample, the last written, with ``columns`` (all if none are named)."""
    return first_by(search_record, ["sample_id"], F.struct("written_at", "record_digest"), last=True, keep=list(columns) or None)


def _paths(column: str) -> Column:
    return F.coalesce(F.col(column), F.array().cast(_NO_PATHS))


def summary(records: DataFrame, total: Column | int) -> DataFrame:
    """One row of counts and means over records; means of nothing are 0. ``total`` is the number of manifest records."""
    valid, invalid = _paths("final_valid_transitions"), _paths("final_invalid_transitions")
    length = lambda p: F.aggregate(p, F.lit(0).cast("bigint"), lambda acc, x: acc + F.size(x))
    n = F.count(F.lit(1))
    s = records.agg(
        n.alias("persisted_questions"), F.count_if(F.col("status") == "complete").alias("completed_questions"), F.count_if(F.col("status") == "failed").alias("failed_questions"),
        F.count_if(F.size(valid) > 0).alias("questions_with_valid_paths"), F.count_if((F.col("status") == "complete") & (F.size(valid) == 0)).alias("complete_without_valid_paths"),
        F.coalesce(F.sum(F.size(valid)), F.lit(0)).alias("v"), F.coalesce(F.sum(F.size(invalid)), F.lit(0)).alias("i"), F.coalesce(F.sum(length(valid)), F.lit(0)).alias("vl"), F.coalesce(F.sum(length(invalid)), F.lit(0)).alias("il"),
    )
    mean = lambda a, b: F.round(F.col(a) / F.greatest(F.col(b), F.lit(1)), 6)
    return s.withColumns({"all": F.col("v") + F.col("i"), "all_length": F.col("vl") + F.col("il")}).select(
        F.lit(total).cast("bigint").alias("total_questions") if isinstance(total, int) else total.alias("total_questions"),
        "persisted_questions", "completed_questions", "failed_questions", "questions_with_valid_paths", "complete_without_valid_paths",
        mean("v", "persisted_questions").alias("mean_valid_paths"), mean("i", "persisted_questions").alias("mean_invalid_paths"),
        mean("vl", "v").alias("mean_valid_path_length"), mean("il", "i").alias("mean_invalid_path_length"), mean("all_length", "all").alias("mean_path_length"),
    )


def value_counts(records: DataFrame) -> DataFrame:
    """(kind, value, n): records per split and per failure reason."""
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("split", "failure_reason")])
    flat = records.select(F.explode(pairs).alias("p")).select("p.kind", "p.value").filter("kind = 'split' or value <> ''")
    return flat.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))


def missing(manifest: DataFrame, records: DataFrame) -> DataFrame:
    """Manifest records without a search record: the work still to do."""
    return manifest.join(records.select("sample_id").distinct(), "sample_id", "left_anti")


def misplaced(records: DataFrame, world: int, rank: Column) -> DataFrame:
    """Records that lie in another shard than global_index modulo ``world``."""
    return records.filter(F.pmod(F.col("global_index"), F.lit(world)) != rank)


def source_mismatches(manifest: DataFrame, records: DataFrame) -> DataFrame:
    """(sample_id, field): records that differ from their manifest row, null-safe, or have none (field "sample_id")."""
    m = manifest.select("sample_id", *[F.col(c).alias(f"m_{c}") for c in MANIFEST_FIELDS], F.lit(True).alias("known"))
    joined = records.join(m, "sample_id", "left")
    wrong = [F.when(F.col("known").isNull(), "sample_id"), *[F.when(F.col("known") & ~F.col(c).eqNullSafe(F.col(f"m_{c}")), c) for c in MANIFEST_FIELDS]]
    return joined.select("sample_id", F.explode(F.array_compact(F.array(*wrong))).alias("field"))


def violations(records: DataFrame, depth: int = DEPTH, max_length: int = MAX_LENGTH) -> DataFrame:
    """(sample_id, rule): rules of a search record that need no grammar; one row per broken rule."""
    ev = F.coalesce(F.col("evaluations"), F.array().cast("array<struct<path:array<int>,score:double>>"))
    keys = F.transform(ev, lambda e: e["path"])
    valid, invalid = _paths("final_valid_transitions"), _paths("final_invalid_transitions")
    bad_path = F.exists(ev, lambda e: F.coalesce((F.size(e["path"]) < 1) | (F.size(e["path"]) > max_length) | F.exists(e["path"], lambda x: (x < 0) | (x >= depth)), F.lit(True)))
    rules = {
        "bad_path": bad_path,
        "duplicate_path": F.size(F.array_distinct(keys)) < F.size(keys),
        "bad_score": F.exists(ev, lambda e: ~F.coalesce(e["score"].isin(0.0, 1.0), F.lit(False))),
        "baseline_mismatch": ~F.col("initial_score").eqNullSafe(F.try_element_at(F.transform(F.filter(ev, lambda e: e["path"] == full_path(depth)), lambda e: e["score"]), F.lit(1))),
        "overlap": F.arrays_overlap(valid, invalid),
        "unknown_status": ~F.coalesce(F.col("status").isin("complete", "failed"), F.lit(False)),
        "evaluation_count": ~F.col("search_statistics.unique_evaluations").eqNullSafe(F.size(ev)),
        "complete_without_baseline": (F.col("status") == "complete") & ~F.coalesce(F.col("initial_score").isin(0.0, 1.0), F.lit(False)),
        "failed_without_reason": (F.col("status") == "failed") & (F.coalesce(F.col("failure_reason"), F.lit("")) == ""),
        "test_was_searched": (F.col("split") == "test") & F.exists(keys, lambda p: p != full_path(depth)),
    }
    return records.select("sample_id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in rules.items()]))).alias("rule"))


def transition_violations(records: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(sample_id, rule): valid or invalid paths that are not exactly the representable ones scored 1 or 0.

    The grammar runs on distinct paths only.
    """
    scored = records.select("sample_id", F.explode("evaluations").alias("e")).select("sample_id", F.col("e.path").alias("path"), F.col("e.score").alias("score"))
    known = parsed(scored, depth).filter("representable").select("path")
    expected = scored.join(known, "path").select("sample_id", "path", (F.col("score") == 1.0).alias("label"))
    lists = records.select("sample_id", F.explode(F.array(F.struct(F.lit(True).alias("label"), _paths("final_valid_transitions").alias("p")), F.struct(F.lit(False).alias("label"), _paths("final_invalid_transitions").alias("p")))).alias("x"))
    stored = lists.select("sample_id", F.col("x.label").alias("label"), F.explode("x.p").alias("path"))
    side = lambda df, c: df.select("sample_id", "label", "path", F.lit(1).alias(c))
    both = side(expected, "e").join(side(stored, "s"), ["sample_id", "label", "path"], "full").filter("e is null or s is null")
    return both.select("sample_id", F.concat(F.when(F.col("label"), "valid").otherwise("invalid"), F.when(F.col("e").isNull(), "_unexpected").otherwise("_missing")).alias("rule")).distinct()


def universal_violations(records: DataFrame, candidates: DataFrame) -> DataFrame:
    """(sample_id, rule) of held-out records: split, status, scores in {0, 1}, exactly the candidate ids if complete, one evaluation config.

    Scores are matched with the candidates row by row, so neither side is bounded. A failed
    record may lack scores but have no other ids. Null ids are a broken rule of their own.
    """
    rules = {
        "no_id": F.col("sample_id").isNull(),
        "bad_split": ~F.coalesce(F.col("split").isin("validation", "test"), F.lit(False)),
        "unknown_status": ~F.coalesce(F.col("status").isin("complete", "failed"), F.lit(False)),
        "complete_without_baseline": (F.col("status") == "complete") & ~F.coalesce(F.col("baseline_score").isin(0.0, 1.0), F.lit(False)),
        "bad_score": F.exists(F.map_values("scores"), lambda x: ~F.coalesce(x.isin(0.0, 1.0), F.lit(False))),
        "failed_without_reason": (F.col("status") == "failed") & (F.coalesce(F.col("failure_reason"), F.lit("")) == ""),
    }
    own = records.select("sample_id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))).alias("rule"))
    frozen = candidates.filter("candidate_id is not null").select("candidate_id").distinct().withColumn("frozen", F.lit(True))
    expected = frozen.count()
    complete = F.col("status") == "complete"
    scored = records.select("sample_id", F.coalesce(complete, F.lit(False)).alias("complete"), F.explode_outer(F.map_keys("scores")).alias("candidate_id")).join(frozen, "candidate_id", "left")
    per = scored.groupBy("sample_id").agg(
        F.bool_or(F.col("candidate_id").isNotNull() & F.col("frozen").isNull()).alias("unknown"), F.bool_or("complete").alias("complete"), F.count_distinct(F.when(F.col("frozen"), F.col("candidate_id"))).alias("n")
    )
    named = F.array(F.when(F.col("unknown"), F.lit("unknown_candidate")), F.when(F.col("complete") & (F.col("n") < expected), F.lit("missing_candidate")))
    return own.union(per.select("sample_id", F.explode(F.array_compact(named)).alias("rule"))).distinct()


def config_violations(records: DataFrame, config: str) -> DataFrame:
    """(value, n): records per config where a run has several configs, or records without one; nothing if all share one."""
    per = records.groupBy(F.coalesce(F.col(config), F.lit("")).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    few = Window.partitionBy()  # configs of a run are few
    return per.withColumn("configs", F.count(F.lit(1)).over(few)).filter("configs > 1 or value = ''").drop("configs")


def checksummed(df: DataFrame, columns: list[str], out: str = "record_digest") -> DataFrame:
    """``df`` with the SHA-256 of the canonical JSON of ``columns`` (sorted names, ASCII, no blanks) in ``out``."""
    return df.withColumn(out, digest_column(columns))


def digest_violations(df: DataFrame, key: str, columns: list[str], digest: str = "record_digest") -> DataFrame:
    """(key, rule): rows whose stored digest is missing or isn't that of ``columns``."""
    rule = F.when(F.coalesce(F.col(digest), F.lit("")) == "", F.lit("no_digest")).when(F.col(digest) != digest_column(columns), F.lit("wrong_digest"))
    return df.select(key, rule.alias("rule")).filter("rule is not null")


def merged(records: DataFrame) -> DataFrame:
    """The merged sample rows of complete records, to be written partitioned by difficulty."""
    return records.filter("status = 'complete'").select("sample_id", "question", "gt_ans", "difficulty", "split", "global_index", "initial_score", "final_valid_transitions", "final_invalid_transitions")


def incomplete(manifest: DataFrame, records: DataFrame) -> DataFrame:
    """(missing, failed): must both be 0 before merging."""
    gone = missing(manifest, records).agg(F.count(F.lit(1)).alias("missing"))
    bad = records.agg(F.count_if(F.col("status") == "failed").alias("failed"))
    return gone.select("missing", F.lit(0).cast("bigint").alias("failed")).union(bad.select(F.lit(0).cast("bigint"), "failed")).agg(F.sum("missing").alias("missing"), F.sum("failed").alias("failed"))


def validated(manifest: DataFrame, records: DataFrame, universal: DataFrame, candidates: DataFrame, config: str = "config_id") -> DataFrame:
    """(stage, rule, n): every rule that the outputs of a run break, over all its stages; empty for a sound run.

    ``manifest`` and ``records`` have one row per sample. A missing or failed record, an open placement or a lost
    training path counts as a broken rule like any other.
    """
    from .ingest import manifest_violations
    from .mining import candidate_violations

    stage = lambda name, df: df.select(F.lit(name).alias("stage"), F.col("rule").cast("string").alias("rule"))
    each = [
        stage("manifest", manifest_violations(manifest)), stage("source", source_mismatches(manifest, records).withColumnRenamed("field", "rule")),
        stage("record", violations(records)), stage("transitions", transition_violations(records)), stage("config", config_violations(records, config).withColumn("rule", F.lit("configs"))),
        stage("universal", universal_violations(universal, candidates)), stage("candidate", candidate_violations(candidates, parsed(candidates, DEPTH))),
        stage("merge", missing(manifest, records).withColumn("rule", F.lit("missing"))), stage("merge", records.filter("status = 'failed'").withColumn("rule", F.lit("failed"))),
        stage("loader", loader_parity(records).filter("expected <> loaded").withColumn("rule", F.lit("lost_paths"))),
    ]
    return reduce(DataFrame.union, each).groupBy("stage", "rule").agg(F.count(F.lit(1)).alias("n"))


def original_path_flags(records: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(sample_id, has_original, has_shorter, n_valid, n_kept): valid paths before and after the full path is dropped in favour of shorter ones."""
    valid = _paths("final_valid_transitions")
    return records.select("sample_id", has_path(valid, depth).alias("has_original"), has_shorter(valid, depth).alias("has_shorter"), F.size(valid).alias("n_valid"), F.size(drop_full_path(valid, depth)).alias("n_kept"))


def kept_original(sample_id: Column, keep: float, seed: int) -> Column:
    """Whether the full path of a sample stays although shorter ones are valid: by its content hash, with probability ``keep``."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"keep|{seed}|"), sample_id), 256), 1, 13), 16, 10).cast("bigint") < F.lit(int(keep * 16**13))


def training_examples(records: DataFrame, depth: int = DEPTH, drop_original: bool = False, keep_probability: float = 0.0, reweight_original: bool = False, original_weight: float = 1.0, anti_original: bool = False, normalize: bool = True, max_paths: int = 50, seed: int = 42) -> DataFrame:
    """One example per valid, representable path of each sample, with labels, flags and weight.

    Above ``max_paths`` the paths with the least content hash are taken. With ``normalize`` the
    weights of a sample are divided by its number of examples. With ``drop_original`` the full path
    goes where shorter ones are valid, but for a share ``keep_probability`` of the samples.
    """
    valid = _paths("final_valid_transitions")
    trigger = has_path(valid, depth) & has_shorter(valid, depth)
    kept = valid
    if drop_original and not reweight_original:
        kept = F.when(kept_original(F.col("sample_id"), keep_probability, seed), valid).otherwise(drop_full_path(valid, depth))
    order = F.transform(kept, lambda p: F.struct(F.sha2(F.concat(F.lit(f"{seed}|"), F.col("sample_id"), F.lit("|"), F.array_join(p.cast("array<string>"), ",")), 256).alias("h"), p.alias("p")))
    picked = F.when(F.size(kept) > max_paths, F.transform(F.slice(F.array_sort(order), 1, max_paths), lambda x: x["p"])).otherwise(kept)
    flat = records.select("sample_id", "question", F.col("gt_ans").alias("gt"), trigger.alias("trigger_shorter_valid"), has_path(valid, depth).alias("original_path_is_valid"), F.explode(picked).alias("path"))
    known = parsed(flat, depth).filter("representable").select("path", "seg_flip", "op_labels")
    rows = flat.join(known, "path").withColumn("is_original_path", F.col("path") == full_path(depth))
    weight = F.when(F.lit(reweight_original) & F.col("trigger_shorter_valid") & F.col("is_original_path"), F.lit(float(original_weight))).otherwise(1.0)
    rows = rows.withColumn("weight", weight)
    if normalize:
        sizes = rows.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_examples"))
        rows = rows.join(sizes, "sample_id").withColumn("weight", F.col("weight") / F.col("n_examples"))
    return rows.select(
        "sample_id", "question", "gt", "path", "seg_flip", "op_labels", F.size("path").alias("path_len"), "is_original_path", "original_path_is_valid",
        (F.lit(anti_original) & ~F.col("original_path_is_valid")).alias("anti_original_active"), "trigger_shorter_valid", "weight",
    )


def capped_examples(examples: DataFrame, most: int, order: list[Column]) -> DataFrame:
    """The first ``most`` examples in ``order``: the cap is the feature."""
    return examples.orderBy(*order).limit(most)


def length_weights(examples: DataFrame, batch: Column, beta: float) -> DataFrame:
    """(batch, sample_id, path, loss_weight): exp(-beta * length), brought to mean 1 in the batch, times the example weight, brought to mean 1 again."""
    rows = examples.withColumn("batch", batch).withColumn("w", F.exp(-F.lit(beta) * F.col("path_len")))
    first = rows.groupBy("batch").agg(F.avg("w").alias("mean_w"), F.avg(F.col("w") * F.col("weight")).alias("mean_ww"))
    both = rows.join(first, "batch")
    value = (F.col("w") / F.col("mean_w")) * F.col("weight") / (F.col("mean_ww") / F.col("mean_w"))
    return both.select("batch", "sample_id", "path", value.alias("loss_weight"))


def loader_parity(records: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(expected, loaded): valid training paths and the examples made of them; must be equal."""
    train = records.filter("split = 'train'")
    expected = train.agg(F.coalesce(F.sum(F.size(_paths("final_valid_transitions"))), F.lit(0)).cast("bigint").alias("n"))
    loaded = training_examples(train, depth, max_paths=10**9).agg(F.count(F.lit(1)).alias("n"))
    both = expected.select("n", F.lit("e").alias("k")).union(loaded.select("n", F.lit("l")))
    return both.agg(F.max(F.when(F.col("k") == "e", F.col("n"))).alias("expected"), F.max(F.when(F.col("k") == "l", F.col("n"))).alias("loaded"))


def search_records(spark, sf_dir: str, *columns: str) -> DataFrame:
    """The latest search records of a data folder."""
    return latest_records(table(spark, sf_dir, "search_record"), *columns)

