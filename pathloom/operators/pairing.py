"""Pairs of correct and wrong paths of one group: extremes, distances, one-to-one assignment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import edit_distance, operation_distance

#: Paths of one side of a group that one assignment may take; a group is a report, not a data set.
MOST = 2000


def extremes(rows: DataFrame, group: str, count: int) -> DataFrame:
    """The ``count`` simplest and ``count`` most complex correct paths of each group, disjoint.

    ``rows`` has (group, candidate_id, path, length, evaluation_index). Complexity is length,
    then different layers, then evaluation order; the simplest are taken first.
    """
    order = ["length", "n_layers", "evaluation_index", "candidate_id"]
    r = rows.withColumn("n_layers", F.size(F.array_distinct("path")))
    up = Window.partitionBy(group).orderBy(*order)
    down = Window.partitionBy(group).orderBy(*[F.desc(c) for c in order])
    low = r.withColumn("rank", F.row_number().over(up)).filter(F.col("rank") <= count).withColumn("role", F.lit("simplest"))
    high = r.withColumn("rank", F.row_number().over(down)).filter(F.col("rank") <= count)
    high = high.join(low.select(group, "candidate_id"), [group, "candidate_id"], "left_anti").withColumn("role", F.lit("most_complex"))
    return low.unionByName(high).drop("n_layers")


def distances(correct: DataFrame, wrong: DataFrame, group: str) -> DataFrame:
    """All correct x wrong pairs of a group with the distance triple (operations, edits, length).

    Both sides have (group, id, path, ops, evaluation_index). The correct ones are the selection of a report, the wrong ones may be many.
    """
    c = correct.select(group, F.col("candidate_id").alias("correct_id"), F.col("path").alias("cp"), F.col("ops").alias("co"))
    w = wrong.select(group, F.col("candidate_id").alias("wrong_id"), F.col("path").alias("wp"), F.col("ops").alias("wo"), F.col("evaluation_index").alias("tie"))
    return c.join(w, group).select(
        group, "correct_id", "wrong_id", operation_distance(F.col("co"), F.col("wo")).alias("operation_distance"),
        edit_distance(F.col("cp"), F.col("wp")).alias("edit_distance"), F.abs(F.size("cp") - F.size("wp")).alias("length_difference"), "tie",
    )


def assign(costs: list[list[int]]) -> list[int]:
    """Column of each row in a cheapest one-to-one assignment; needs at least as many columns as rows. Any integers.

    Rows are added one by one; each extends the matching along a shortest augmenting path in
    reduced costs (Dijkstra with potentials).
    """
    n, m = len(costs), len(costs[0]) if costs else 0
    if n > m:
        raise ValueError("more rows than columns")
    owner: list[int | None] = [None] * m
    price = [0] * m
    gain = [0] * n
    for start in range(n):
        far: list[int | None] = [None] * m
        via = [-1] * m
        fixed: set[int] = set()
        row, base, entry = start, 0, -1
        while True:
            for j in range(m):
                if j not in fixed:
                    d = base + costs[row][j] - gain[row] - price[j]
                    if far[j] is None or d < far[j]:
                        far[j], via[j] = d, entry
            entry = min((j for j in range(m) if j not in fixed), key=lambda j: far[j])
            fixed.add(entry)
            base = far[entry]
            if owner[entry] is None:
                break
            row = owner[entry]
        gain[start] += base
        for j in fixed:
            if j != entry:
                gain[owner[j]] += base - far[j]
                price[j] -= base - far[j]
        while entry != -1:
            previous = via[entry]
            owner[entry] = start if previous == -1 else owner[previous]
            entry = previous
    out = [-1] * n
    for j, i in enumerate(owner):
        if i is not None:
            out[i] = j
    return out


def folded(operation: np.ndarray, edit: np.ndarray, length: np.ndarray, tie: np.ndarray) -> list[list[int]]:
    """One integer per pair whose sums over any assignment order as the tuple (operation, edit, length, tie)."""
    n = operation.shape[0]
    out = [[int(x) for x in row] for row in np.broadcast_to(tie, operation.shape)]
    weight = 1
    bound = max((max(r) for r in out), default=0)
    for level in (length, edit, operation):
        weight = n * bound + 1
        out = [[int(level[i, j]) * weight + out[i][j] for j in range(operation.shape[1])] for i in range(n)]
        bound = max((max(r) for r in out), default=0)
    return out


def cheapest(pairs: DataFrame, group: str) -> DataFrame:
    """The pairs that a cheapest one-to-one pairing can need: per correct path as many wrong ones, cheapest first, as the group has correct paths.

    Of these one is always left over by the other correct paths, so no other can be cheaper.
    """
    count = pairs.select(group, "correct_id").distinct().groupBy(group).agg(F.count(F.lit(1)).alias("_rows"))
    w = Window.partitionBy(group, "correct_id").orderBy("operation_distance", "edit_distance", "length_difference", "tie", "wrong_id")
    first = pairs.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= MOST)
    return first.join(count, group).filter("_rank <= _rows").drop("_rank", "_rows")


def assigned(pairs: DataFrame, group: str) -> DataFrame:
    """The cheapest pairing of each group's correct paths with distinct wrong ones, by the distance triple then evaluation order.

    One group is one report of at most MOST paths a side, not counting wrong ones too far to be paired; larger ones are refused. A group
    with fewer wrong than correct paths has no one-to-one pairing and gives no rows.
    """
    schema = f"{group} int, correct_id string, wrong_id string, operation_distance int, edit_distance int, length_difference int"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["correct_id", "tie", "wrong_id"])
        rows, cols = list(dict.fromkeys(pdf["correct_id"])), list(dict.fromkeys(pdf.sort_values(["tie", "wrong_id"])["wrong_id"]))
        if max(len(rows), len(cols)) > MOST:
            raise ValueError(f"more than {MOST} paths in one group")
        if len(rows) > len(cols):
            return pd.DataFrame({c: pd.Series(dtype=t) for c, t in ((group, "int32"), ("correct_id", object), ("wrong_id", object), ("operation_distance", "int32"), ("edit_distance", "int32"), ("length_difference", "int32"))})
        wide = lambda c: pdf.pivot(index="correct_id", columns="wrong_id", values=c).loc[rows, cols].to_numpy()
        none = np.isnan(wide("tie").astype(float))  # pairs left out as too far
        op, ed, le = (np.where(none, 0, wide(c)).astype(int) for c in ("operation_distance", "edit_distance", "length_difference"))
        tie = np.nanmax(wide("tie").astype(float), axis=0).astype(int)
        costs = folded(op, ed, le, tie)
        never = len(rows) * max(map(max, costs)) + 1
        pick = assign([[never if none[i, j] else x for j, x in enumerate(row)] for i, row in enumerate(costs)])
        g = pdf[group].iloc[0]
        return pd.DataFrame([(g, rows[i], cols[j], op[i, j], ed[i, j], le[i, j]) for i, j in enumerate(pick)], columns=[group, "correct_id", "wrong_id", "operation_distance", "edit_distance", "length_difference"])

    return cheapest(pairs, group).groupBy(group).applyInPandas(run, schema)


def figure_rows(paired: DataFrame, group: str) -> DataFrame:
    """Two rows per pair, correct (C) then wrong (W), numbered by operation distance within the group."""
    w = Window.partitionBy(group).orderBy("operation_distance", "edit_distance", "correct_id")
    one = paired.withColumn("pair_index", F.row_number().over(w))
    both = F.array(F.struct(F.lit("C").alias("pair_role"), F.col("correct_id").alias("candidate_id")), F.struct(F.lit("W").alias("pair_role"), F.col("wrong_id").alias("candidate_id")))
    return one.select(group, "pair_index", "operation_distance", F.explode(both).alias("r")).select(group, "pair_index", "r.pair_role", "r.candidate_id", "operation_distance")
