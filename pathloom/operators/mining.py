"""Layer statistics, hypotheses and frozen candidate paths from training evidence only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import KEEP, LOOP, SKIP, actions_path, full_path, layer_actions, path_id
from ..runtime import written
from .records import DEPTH, MAX_LENGTH, _paths

SMOOTHING = 0.01
ALL = "all"


def observations(records: DataFrame) -> DataFrame:
    """(sample_id, difficulty, outcome, path, weight) of training records; each sample has weight 1 per outcome."""
    sides = F.array(*[F.struct(F.lit(o).alias("outcome"), _paths(c).alias("paths")) for o, c in (("valid", "final_valid_transitions"), ("invalid", "final_invalid_transitions"))])
    flat = records.filter("split = 'train'").select("sample_id", "difficulty", F.explode(sides).alias("s"))
    return flat.select("sample_id", "difficulty", F.col("s.outcome").alias("outcome"), F.explode("s.paths").alias("path"), (F.lit(1.0) / F.greatest(F.size("s.paths"), F.lit(1))).alias("weight"))


def layer_weights(records: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(grp, outcome, layer, action, weight): mass of each action per layer, by difficulty and over all.

    Paths outside the action vocabulary add nothing. The total is rolled up from the few rows
    by difficulty, so the data are exploded and combined once.
    """
    obs = observations(records).select("difficulty", "outcome", "weight", F.posexplode(layer_actions(F.col("path"), depth)).alias("layer", "action"))
    by = obs.groupBy(F.col("difficulty").cast("string").alias("grp"), "outcome", "layer", "action").agg(F.sum("weight").alias("weight"))
    total = by.groupBy(F.lit(ALL).alias("grp"), "outcome", "layer", "action").agg(F.sum("weight").alias("weight"))
    return by.union(total)


def layer_lift(weights: DataFrame, depth: int = DEPTH, smoothing: float = SMOOTHING) -> DataFrame:
    """Dense (grp, layer, action) table: weights, fractions and log propensity lift of valid over invalid."""
    cells = weights.select("grp").distinct().select("grp", F.explode(full_path(depth)).alias("layer")).select("grp", "layer", F.explode(F.array(*map(F.lit, (SKIP, KEEP, LOOP)))).alias("action"))
    side = lambda o: F.coalesce(F.max(F.when(F.col("outcome") == o, F.col("weight"))), F.lit(0.0)).alias(f"{o}_weight")
    wide = weights.groupBy("grp", "layer", "action").agg(side("valid"), side("invalid"))
    dense = cells.join(wide, ["grp", "layer", "action"], "left").na.fill(0.0, ["valid_weight", "invalid_weight"])
    w = Window.partitionBy("grp", "layer")
    share = lambda c: F.when(F.sum(c).over(w) > 0, F.col(c) / F.sum(c).over(w)).otherwise(0.0)
    out = dense.withColumns({"valid_fraction": share("valid_weight"), "invalid_fraction": share("invalid_weight")})
    return out.withColumn("log_propensity_lift", F.log((F.col("valid_fraction") + smoothing) / (F.col("invalid_fraction") + smoothing)))


def over_keep(lift: DataFrame) -> DataFrame:
    """(grp, layer, action, gain): lift of skip and loop over the lift of keep at the same layer."""
    w = Window.partitionBy("grp", "layer")
    keep = F.max(F.when(F.col("action") == KEEP, F.col("log_propensity_lift"))).over(w)
    return lift.withColumn("gain", F.col("log_propensity_lift") - keep).filter(F.col("action") != KEEP).select("grp", "layer", "action", "gain")


def hypotheses(lift: DataFrame) -> DataFrame:
    """(action, layer, worst, macro, all_train, by_difficulty, rank_within_action) of every single-layer edit."""
    g = over_keep(lift)
    own = F.col("grp") != ALL
    rows = g.groupBy("action", "layer").agg(
        F.min(F.when(own, F.col("gain"))).alias("worst"), F.avg(F.when(own, F.col("gain"))).alias("macro"), F.max(F.when(~own, F.col("gain"))).alias("all_train"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(own, F.struct("grp", "gain"))))).alias("by_difficulty"),
    )
    w = Window.partitionBy("action").orderBy(F.desc("worst"), F.desc("macro"), "layer")
    return rows.withColumn("rank_within_action", F.row_number().over(w))


def path_evidence(records: DataFrame) -> DataFrame:
    """(path, valid_support, observed_support, by_difficulty) of every observed training path."""
    obs = observations(records)
    per = obs.groupBy("path", "difficulty").agg(F.count_distinct(F.when(F.col("outcome") == "valid", F.col("sample_id"))).alias("v"), F.count_distinct("sample_id").alias("n"), F.count_if(F.col("outcome") == "valid").alias("k"))
    return per.groupBy("path").agg(F.sum("v").alias("valid_support"), F.sum("n").alias("observed_support"), F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("k") > 0, F.struct("difficulty", "k"))))).alias("by_difficulty"))


def exact_paths(evidence: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Edited paths with valid evidence and their accuracy; rank order is support, accuracy (both falling), length, path."""
    return evidence.filter((F.col("valid_support") > 0) & (F.col("path") != full_path(depth))).withColumn("accuracy", F.col("valid_support") / F.col("observed_support"))


def exact_order() -> list:
    return [F.desc("valid_support"), F.desc("accuracy"), F.size("path"), F.col("path")]


def consensus(lift: DataFrame, most_edits: int = 4, depth: int = DEPTH, max_length: int = MAX_LENGTH) -> DataFrame:
    """(grp, budget, path): for each group the 1..most_edits best positive layer edits together.

    Per layer the better of skip and loop counts (skip at a tie). Empty and over-long paths are dropped.
    """
    best = over_keep(lift).groupBy("grp", "layer").agg(F.max(F.struct("gain", "action")).alias("b")).filter("b.gain > 0")
    ranked = best.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct((-F.col("b.gain")).alias("loss"), F.col("layer").alias("layer"), F.col("b.action").alias("action")))).alias("edits"))
    each = ranked.select("grp", "edits", F.explode(F.sequence(F.lit(1), F.least(F.lit(most_edits), F.size("edits")))).alias("budget"))
    used = F.slice("edits", F.lit(1), F.col("budget"))
    actions = F.transform(full_path(depth), lambda i: F.coalesce(F.try_element_at(F.transform(F.filter(used, lambda e: e["layer"] == i), lambda e: e["action"]), F.lit(1)), F.lit(KEEP)))
    return each.select("grp", "budget", actions_path(actions).alias("path")).filter(F.col("path").isNotNull() & (F.size("path") <= max_length))


def single_layer(hyp: DataFrame, top: int, depth: int = DEPTH) -> DataFrame:
    """(action, layer, rank_within_action, path) of the best ``top`` single-layer edits per action."""
    actions = F.transform(full_path(depth), lambda i: F.when(i == F.col("layer"), F.col("action")).otherwise(KEEP))
    return hyp.filter(F.col("rank_within_action") <= top).select("action", "layer", "rank_within_action", actions_path(actions).alias("path"))


def candidates(records: DataFrame, max_candidates: int = 96, min_support: int = 2, most_edits: int = 4, top_layers: int = 28, smoothing: float = SMOOTHING, depth: int = DEPTH, max_length: int = MAX_LENGTH) -> DataFrame:
    """The frozen candidate set: single-layer edits, consensus edits, exact paths, by priority up to ``max_candidates``.

    Sources are listed in the order in which they were found. At most ``max_candidates``
    rows ever reach the driver.
    """
    if max_candidates < 2 * top_layers or top_layers > depth:
        raise ValueError("max_candidates must cover both single-layer edits of top_layers layers")
    lift = written(layer_lift(layer_weights(records, depth), depth, smoothing), "lift")
    evidence = written(path_evidence(records), "evidence")
    exact = exact_paths(evidence, depth)
    single = single_layer(hypotheses(lift), top_layers, depth).select("path", F.concat(F.lit("single_"), "action", F.lit("_layer_"), F.col("layer").cast("string")).alias("source"), F.struct(F.lit(0).alias("stage"), F.col("action").alias("a"), F.col("rank_within_action").alias("b")).alias("seq"))
    group = F.when(F.col("grp") == ALL, F.lit("~")).otherwise(F.col("grp"))
    edits = consensus(lift, most_edits, depth, max_length).select("path", F.concat(F.lit("consensus_"), "grp", F.lit("_top"), F.col("budget").cast("string")).alias("source"), F.struct(F.lit(1).alias("stage"), group.alias("a"), F.col("budget").alias("b")).alias("seq"))
    support = exact.filter(F.col("valid_support") >= min_support).select("path", F.lit("exact_train_support").alias("source"), F.struct(F.lit(2).alias("stage"), F.lit("").alias("a"), F.lit(0).alias("b")).alias("seq"))
    pool = single.union(edits).union(support).filter("path is not null")
    short = max_candidates - pool.select("path").distinct().limit(max_candidates).count()
    if short > 0:
        new = exact.join(pool.select("path").distinct(), "path", "left_anti").orderBy(*exact_order()).limit(short).collect()
        order = F.struct((-F.col("valid_support")).alias("s"), (-F.col("accuracy")).alias("a"), F.size("path").alias("n"), F.col("path").alias("p"))
        upto = exact
        if len(new) == short:
            last = new[-1]
            upto = exact.filter(order <= F.struct(F.lit(-last.valid_support).cast("bigint").alias("s"), F.lit(-last.accuracy).alias("a"), F.lit(len(last.path)).alias("n"), F.array(*map(F.lit, last.path)).alias("p")))
        pool = pool.union(upto.select("path", F.lit("exact_train_fallback").alias("source"), F.struct(F.lit(3).alias("stage"), F.lit("").alias("a"), F.lit(0).alias("b")).alias("seq")))
    rows = pool.groupBy("path").agg(F.transform(F.array_sort(F.collect_set(F.struct("seq", "source"))), lambda x: x["source"]).alias("sources"))
    rows = rows.join(evidence, "path", "left").select(
        path_id(F.col("path")).alias("candidate_id"), "path", "sources", F.size("path").alias("length"), (F.size("path") / F.lit(depth)).alias("depth_ratio"),
        F.coalesce("valid_support", F.lit(0)).alias("train_valid_support"), F.coalesce("observed_support", F.lit(0)).alias("train_observed_support"),
        (F.col("valid_support") / F.col("observed_support")).alias("train_observed_accuracy"), F.coalesce("by_difficulty", F.create_map().cast("map<int,bigint>")).alias("train_valid_support_by_difficulty"),
    )
    has = lambda p: F.exists("sources", lambda s: s.startswith(p))
    rank = [F.desc("train_valid_support"), F.desc(F.when(F.coalesce(F.col("train_observed_accuracy"), F.lit(0.0)) == 0, -1.0).otherwise(F.col("train_observed_accuracy"))), "length", "candidate_id"]
    priority = F.when(has("single_"), 0).when(has("consensus_"), 1).otherwise(2)
    return rows.orderBy(priority, *rank).limit(max_candidates).orderBy(F.desc("train_valid_support"), "length", "candidate_id")


def heatmap(lift: DataFrame, action: str, depth: int = DEPTH) -> DataFrame:
    """One row per group, one column per layer: the fraction of valid paths with ``action`` there (figure data)."""
    return lift.filter(F.col("action") == action).groupBy("grp").pivot("layer", list(range(depth))).agg(F.max("valid_fraction"))


def candidate_violations(cands: DataFrame, representable: DataFrame, depth: int = DEPTH, max_length: int = MAX_LENGTH) -> DataFrame:
    """(candidate_id, rule): empty or over-long path, wrong id or length, no source, not representable, duplicate path."""
    rows = cands.join(representable.select("path", "representable"), "path", "left")
    rules = {
        "bad_path": (F.size("path") < 1) | (F.size("path") > max_length),
        "bad_id": F.col("candidate_id") != path_id(F.col("path")),
        "bad_length": ~F.col("length").eqNullSafe(F.size("path")),
        "no_source": F.coalesce(F.size("sources"), F.lit(0)) < 1,
        "not_representable": ~F.coalesce("representable", F.lit(False)),
    }
    broken = rows.select("candidate_id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))).alias("rule"))
    twins = cands.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("candidate_id").alias("candidate_id")).filter("n > 1").select("candidate_id", F.lit("duplicate_path").alias("rule"))
    return broken.union(twins)
