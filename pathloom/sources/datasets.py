"""Question sets of several publishers under one schema: (dataset, query, ref_ans, level, domain, ...)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import judge, prompts
from .readers import filtered, parse_dataset, unified

COLUMNS = ["query", "ref_ans", "level", "domain", "source", "n_step", "abs_tol", "source_id"]


def _last(c: str, sep: str) -> Column:
    return F.element_at(F.split(c, sep), -1)


def _text(c: str) -> Column:
    return F.col(c).cast("string")


#: Which columns of each set become which common ones.
MAPPINGS: dict[str, Callable[[], dict[str, Column]]] = {
    "math": lambda: {"query": F.col("problem"), "ref_ans": judge.boxed_solution(F.col("solution")), "level": judge.level_number(F.col("level"), F.col("problem")).cast("string"), "domain": F.replace("type", F.lit(" "), F.lit(""))},
    "gsm8k": lambda: {"query": F.col("question"), "ref_ans": _last("answer", "\n#### ")},
    "gsm8k-fix": lambda: {"query": F.col("query"), "ref_ans": F.col("gt_ans"), "n_step": F.col("query_metadata.n_step")},
    "pooled-math": lambda: {"query": F.col("query"), "ref_ans": F.col("gt_ans")},
    "mwpbench": lambda: {"query": F.col("question"), "ref_ans": F.col("answer"), "source": _last("data_source", "\\."), "domain": _last("data_topic", "\\.")},
    "deepmind-mathematics": lambda: {"query": F.col("question"), "ref_ans": F.col("answer")},
    "olympiadbench": lambda: {
        "query": F.concat(prompts.contest_prompt(F.col("answer_type"), F.col("is_multiple_answer"), F.col("unit")), F.lit("\n"), F.col("question")),
        "ref_ans": F.get("final_answer", 0), "abs_tol": F.col("error").cast("double"), "domain": F.col("subfield"),
    },
    "theoremqa": lambda: {"query": F.col("Question"), "ref_ans": _text("Answer")},
    "odyssey-math": lambda: {"query": F.col("question"), "ref_ans": F.col("answer"), "domain": F.col("label"), "level": _text("level")},
    "aops": lambda: {"query": F.col("problem"), "ref_ans": F.col("answer"), "source_id": F.col("link")},
}


def load(parts: dict[str, DataFrame], most_trials: dict[str, int] | None = None, least_correct: dict[str, int] | None = None) -> DataFrame:
    """All sets under one schema. Keys are dataset specs: a set's name, optionally "/split", then filters.

    ``math/test;level=[4,5];sample=100`` takes the mapping of ``math`` and its filters.
    """
    out = None
    for spec, df in parts.items():
        name, filters = parse_dataset(spec)
        family = name.split("/")[0]
        if family not in MAPPINGS:
            raise ValueError(f"unknown dataset {name}")
        one = unified({name: (df, MAPPINGS[family]())}, COLUMNS)
        full = one.select("dataset", *[F.col(c) if c in one.columns else F.lit(None).cast("double" if c == "abs_tol" else "int" if c == "n_step" else "string").alias(c) for c in COLUMNS])
        full = filtered(full, {k: [str(x) for x in v] if k == "level" and isinstance(v, list) else str(v) if k == "level" else v for k, v in filters.items()}, "query")
        full = full.withColumns({"max_n_trials": F.lit((most_trials or {}).get(name, 1)), "min_n_corrects": F.lit((least_correct or {}).get(name, 0))})
        out = full if out is None else out.union(full)
    return out
