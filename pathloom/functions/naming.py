"""Names of outputs from hyper-parameters, and learning-rate schedules as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_number(x: float) -> str:
    """A number in [0, 1] with at most three decimals and no idle zeros."""
    try:
        v = min(1.0, max(0.0, float(x)))
    except (TypeError, ValueError):
        v = 0.0
    return f"{v:.3f}".rstrip("0").rstrip(".") or "0"


#: (option, condition, piece) in the order in which pieces stand in a name.
_STABILITY = (
    (lambda o: o.get("nan_guard"), lambda o: "ng"), (lambda o: (o.get("grad_clip_norm") or 0) > 0, lambda o: f"clip{short_number(o['grad_clip_norm'])}"), (lambda o: o.get("use_amp"), lambda o: "amp"),
    (lambda o: o.get("nan_guard") and 0 < (o.get("nan_lr_backoff") or 0) < 1, lambda o: f"bk{short_number(o['nan_lr_backoff'])}"), (lambda o: str(o.get("run_tag") or "").strip(), lambda o: f"tag{str(o['run_tag']).strip()}"),
)
_EVALUATION = (
    (lambda o: (o.get("len_penalty") or 0) > 0, lambda o: f"lpen{float(o['len_penalty'])}"), (lambda o: "top_k_ops" in o, lambda o: f"topkops{o['top_k_ops']}"), (lambda o: "beam_size" in o, lambda o: f"beam{o['beam_size']}"),
    (lambda o: o.get("drop_original") or (o.get("keep_original_prob") or 0) > 0, lambda o: "droporig" + (f"_keeporig{short_number(o['keep_original_prob'])}" if (o.get("keep_original_prob") or 0) > 0 else "")),
)
_TRAINING = (
    (lambda o: o.get("reweight_original"), lambda o: f"origw{short_number(o.get('original_path_weight', 1.0))}"), (lambda o: (o.get("anti_original_lambda") or 0) > 0, lambda o: f"antiorig{short_number(o['anti_original_lambda'])}"),
    (lambda o: o.get("per_sample_weight_normalize"), lambda o: "psnorm"), (lambda o: o.get("max_paths_per_sample") is not None, lambda o: f"mpps{int(o['max_paths_per_sample'])}"),
    (lambda o: str(o.get("lr_scheduler") or "none").lower() != "none", lambda o: f"sched{str(o['lr_scheduler']).lower()}"), (lambda o: (o.get("warmup_steps") or 0) > 0, lambda o: f"warmup{int(o['warmup_steps'])}"),
)


def _pieces(rules, options: dict) -> list[str]:
    return [piece(options) for wanted, piece in rules if wanted(options)]


def run_name(options: dict, evaluation: bool = False) -> str:
    """The suffix that tells runs with different options apart."""
    lead = [f"beta{options['length_beta']}"] if options.get("prefers_short") else []
    parts = _pieces(_STABILITY, options) + lead + (_pieces(_EVALUATION, options) if evaluation else []) + _pieces(_TRAINING, options)
    return "".join("_" + p for p in parts)


def learning_rate_factor(step: Column, total: int, warmup: int = 0, kind: str = "none") -> Column:
    """The factor of the base rate at a step: linear warm-up, then constant, linear or cosine decay."""
    s = step.cast("double")
    done = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (s - warmup) / max(1, total - warmup)))
    after = F.lit(1.0)
    if total > warmup and kind in ("linear", "cosine"):
        after = F.greatest(F.lit(0.0), 1.0 - done) if kind == "linear" else (1.0 + F.cos(done * math.pi)) * 0.5
    return F.when(s < warmup, s / max(1, warmup)).otherwise(after) if warmup > 0 else after


__all__ = ["learning_rate_factor", "run_name", "short_number"]
