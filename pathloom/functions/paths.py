"""The path algebra as native column expressions.

A path is an ``array<int>`` of executed layer numbers with repeats. Everything here stays in
the JVM; only the segment grammar (module ``grammar``) needs an Arrow function.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SKIP, KEEP, LOOP = "skip", "keep", "loop"


def full_path(depth: int) -> Column:
    """The unedited path 0..depth-1."""
    return F.sequence(F.lit(0), F.lit(depth - 1))


def layer_counts(path: Column, depth: int) -> Column:
    """How often each layer runs, by layer (X: executions per layer)."""
    return F.transform(full_path(depth), lambda i: F.size(F.filter(path, lambda x: x == i)))


def in_vocabulary(path: Column, depth: int) -> Column:
    """Every layer exists and runs at most twice; an empty path passes."""
    return F.forall(path, lambda x: (x >= 0) & (x < depth)) & F.forall(layer_counts(path, depth), lambda n: n <= 2)


def layer_actions(path: Column, depth: int) -> Column:
    """skip, keep or loop by layer; null outside the vocabulary."""
    name = lambda n: F.when(n == 0, SKIP).when(n == 1, KEEP).otherwise(LOOP)
    return F.when(in_vocabulary(path, depth), F.transform(layer_counts(path, depth), name))


def actions_path(actions: Column) -> Column:
    """The per-layer path of an action list; null if it would be empty."""
    times = lambda a: F.when(a == LOOP, 2).when(a == KEEP, 1).otherwise(0)
    out = F.flatten(F.transform(actions, lambda a, i: F.array_repeat(i, times(a))))
    return F.when(F.size(out) > 0, out)


def decode_actions(actions: Column) -> Column:
    """Path of (action, size, count) segments: keep copies a block, repeat copies it count + 1 times, skip passes it."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, a: Column) -> Column:
        block = F.when(a["size"] > 0, F.sequence(acc["at"], acc["at"] + a["size"] - 1)).otherwise(F.array().cast("array<int>"))
        copies = F.when(a["action"] == KEEP, 1).when(a["action"] == "repeat", a["count"] + 1).otherwise(0)
        return F.struct((acc["at"] + a["size"]).alias("at"), F.concat(acc["out"], F.flatten(F.array_repeat(block, copies))).alias("out"))

    return F.aggregate(actions, start, step, lambda acc: acc["out"])


def actions_length(actions: Column) -> Column:
    """Length of the path that ``decode_actions`` gives."""
    one = lambda a: F.when(a["action"] == KEEP, a["size"]).when(a["action"] == "repeat", (a["count"] + 1) * a["size"]).otherwise(0)
    return F.aggregate(actions, F.lit(0), lambda acc, a: acc + one(a))


def json_ints(path: Column) -> Column:
    """Canonical JSON of an int array, without blanks."""
    return F.concat(F.lit("["), F.array_join(path.cast("array<string>"), ","), F.lit("]"))


def path_id(path: Column, digits: int = 16) -> Column:
    """Content id of a path: first hex digits of the SHA-256 of its canonical JSON."""
    return F.substring(F.sha2(json_ints(path), 256), 1, digits)


def seeded_digest(seed: int, sample_id: Column) -> Column:
    """SHA-256 of the canonical JSON of [seed, id] for ids that need no escaping (hex, ASCII names)."""
    return F.sha2(F.concat(F.lit(f'[{seed},"'), sample_id, F.lit('"]')), 256)


def seed_number(seed: int, sample_id: Column, digits: int = 8) -> Column:
    """A reproducible random seed from the first hex digits of the digest."""
    return F.conv(F.substring(seeded_digest(seed, sample_id), 1, digits), 16, 10).cast("bigint")


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of two paths; layers are coded as one character each (below 127 - 48)."""
    code = lambda p: F.array_join(F.transform(p, lambda x: F.char(x + 48)), "")
    return F.levenshtein(code(a), code(b))


def operation_distance(a: Column, b: Column) -> Column:
    """Sum over layers: 2 between skip and a repetition, 1 between other different operations."""
    both = lambda x, y: F.when(x == y, 0).when((F.least(x, y) == 0) & (F.greatest(x, y) == 2), 2).otherwise(1)
    return F.aggregate(F.zip_with(a, b, both), F.lit(0), lambda acc, x: acc + x)


def local_edits(path: Column, max_block: int, max_copies: int, max_length: int) -> Column:
    """All paths one edit away: a block of at most ``max_block`` positions deleted, or copied up to ``max_copies`` times more.

    Distinct, sorted, without the path itself, without the empty path, none over ``max_length``.
    """
    n = F.size(path)
    cuts = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda s: F.transform(F.sequence(F.lit(1), F.least(F.lit(max_block), n - s)), lambda z: F.struct(s.alias("s"), z.alias("z")))))
    head = lambda e: F.slice(path, F.lit(1), e)
    tail = lambda e: F.slice(path, e + 1, F.greatest(n - e, F.lit(0)))
    dropped = F.transform(cuts, lambda c: F.concat(head(c["s"]), tail(c["s"] + c["z"])))
    copies = F.sequence(F.lit(1), F.lit(max_copies))
    copied = F.flatten(F.transform(cuts, lambda c: F.transform(copies, lambda k: F.concat(head(c["s"] + c["z"]), F.flatten(F.array_repeat(F.slice(path, c["s"] + 1, c["z"]), k)), tail(c["s"] + c["z"])))))
    all_ = F.concat(dropped, copied) if max_copies > 0 else dropped
    out = F.filter(F.array_distinct(all_), lambda p: (F.size(p) > 0) & (F.size(p) <= max_length) & (p != path))
    return F.when(n > 0, F.array_sort(out)).otherwise(F.array().cast("array<array<int>>"))


def has_path(paths: Column, depth: int) -> Column:
    """The full path is among ``paths``."""
    return F.coalesce(F.array_contains(paths, full_path(depth)), F.lit(False))


def has_shorter(paths: Column, depth: int) -> Column:
    """A path shorter than the full one is among ``paths``."""
    return F.coalesce(F.exists(paths, lambda p: F.size(p) < depth), F.lit(False))


def drop_full_path(paths: Column, depth: int) -> Column:
    """``paths`` without the full path, where a shorter one is there too."""
    return F.when(has_path(paths, depth) & has_shorter(paths, depth), F.filter(paths, lambda p: p != full_path(depth))).otherwise(paths)


def clamp01(x: Column, default: float = 1.0) -> Column:
    """A number cut to [0, 1]; anything that is no number becomes ``default``."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x.try_cast("double"), F.lit(float(default)))))
