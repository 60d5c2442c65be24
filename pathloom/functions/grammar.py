"""The canonical segmentation of a path, as an Arrow function on distinct paths.

A program cuts the layers left to right into segments of 1 to 4 layers, each skipped, kept
or run twice. Of all programs with the same path the canonical one has the fewest segments,
then the fewest skips, then the most repeats, then the larger segments earlier. That order is
a sum of per-segment costs followed by a comparison of sizes, so a shortest path over the
cells (layers done, path done) finds it: cells are visited from the end, each holding the
best key of its rest.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Operation codes and the label of positions inside a segment (fixed values).
SKIP, EXECUTE, REPEAT, IGNORED = 0, 1, 2, -100
MAX_SEGMENT = 4


def _runs(path: tuple[int, ...]) -> list[int]:
    """Length of the ascending run that starts at each position."""
    run = [1] * len(path)
    for i in range(len(path) - 2, -1, -1):
        if path[i + 1] == path[i] + 1:
            run[i] = run[i + 1] + 1
    return run


def _reach(path: tuple[int, ...], depth: int, max_segment: int) -> list[set[int]]:
    """Per number of layers done, the path positions that some program can have reached and go on from."""
    run, n = _runs(path), len(path)
    reach: list[set[int]] = [set() for _ in range(depth + 1)]
    reach[0].add(0)
    for layer in range(depth):
        for at in reach[layer]:
            fits = at < n and path[at] == layer
            for size in range(1, min(max_segment, depth - layer) + 1):
                for op, used in ((SKIP, 0), (EXECUTE, size), (REPEAT, 2 * size)):
                    if op != SKIP and not (fits and run[at] >= size):
                        continue
                    if op == REPEAT and not (at + used <= n and path[at + size] == layer and run[at + size] >= size):
                        continue
                    to = at + used
                    # what is left must start with a layer that is still to come
                    if to == n or path[to] >= layer + size:
                        reach[layer + size].add(to)
    return reach


@functools.lru_cache(maxsize=200_000)
def representable(path: tuple[int, ...], depth: int, max_segment: int = MAX_SEGMENT) -> bool:
    """Some program gives this path."""
    return len(path) <= 2 * depth and len(path) in _reach(path, depth, max_segment)[depth]


@functools.lru_cache(maxsize=100_000)
def segments(path: tuple[int, ...], depth: int, max_segment: int = MAX_SEGMENT) -> tuple[tuple[int, int, int], ...] | None:
    """Canonical (start, size, operation) of a path, or None if no program gives it."""
    n = len(path)
    if n > 2 * depth:
        return None
    run, reach = _runs(path), _reach(path, depth, max_segment)
    if n not in reach[depth]:
        return None
    best: list[dict[int, tuple]] = [{} for _ in range(depth + 1)]
    best[depth][n] = (0, 0, 0, (), ())
    for layer in range(depth - 1, -1, -1):
        for at in reach[layer]:
            fits = at < n and path[at] == layer
            for size in range(1, min(max_segment, depth - layer) + 1):
                for op, used in ((SKIP, 0), (EXECUTE, size), (REPEAT, 2 * size)):
                    rest = best[layer + size].get(at + used)
                    if rest is None or op != SKIP and not (fits and run[at] >= size):
                        continue
                    if op == REPEAT and not (path[at + size] == layer and run[at + size] >= size):
                        continue
                    k, skips, repeats, sizes, ops = rest
                    key = (k + 1, skips + (op == SKIP), repeats - (op == REPEAT), (-size, *sizes), (op, *ops))
                    if at not in best[layer] or key[:4] < best[layer][at][:4]:
                        best[layer][at] = key
    out, at = [], 0
    for size, op in zip(best[0][0][3], best[0][0][4], strict=True):
        out.append((at, -size, op))
        at -= size
    return tuple(out)


PARSED = "path array<int>, representable boolean, seg_flip array<int>, op_labels array<int>, layer_ops array<int>, segments array<struct<start:int,end:int,op:int>>"


def parsed(paths: DataFrame, depth: int, column: str = "path") -> DataFrame:
    """One row per distinct path of ``paths``: its segmentation in all forms, null where there is none.

    seg_flip marks segment starts but the first, op_labels has the operation at each start,
    layer_ops the operation of every layer. Null paths are left out; the empty path parses.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for p in batch.column(0).to_pylist():
                seg = segments(tuple(p), depth) if all(x is not None for x in p) else None
                if seg is None:
                    rows.append({"path": p, "representable": False})
                    continue
                flip, label, ops = [0] * depth, [IGNORED] * depth, []
                for start, size, op in seg:
                    flip[start], label[start] = int(start > 0), op
                    ops += [op] * size
                rows.append({"path": p, "representable": True, "seg_flip": flip, "op_labels": label, "layer_ops": ops, "segments": [{"start": a, "end": a + z, "op": o} for a, z, o in seg]})
            ints = pa.list_(pa.int32())
            types = {"path": ints, "representable": pa.bool_(), "seg_flip": ints, "op_labels": ints, "layer_ops": ints, "segments": pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("op", pa.int32())]))}
            yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], t) for c, t in types.items()], names=list(types))

    return paths.select(F.col(column).cast("array<int>").alias("path")).filter("path is not null").distinct().mapInArrow(run, PARSED)
