"""Compressed NumPy archives: one row per sample, matrices read only where they are asked for."""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a matrix that go into one batch.
ROWS = 1024


def read_npz(spark: SparkSession, path: str, ids: str, matrices: Sequence[str] = (), wanted: DataFrame | None = None) -> DataFrame:
    """(file, position, <ids>, <matrices> as array<double>): the rows of all ``.npz`` archives of a folder.

    Each archive is one task's row; of its members only ``ids`` and ``matrices`` are decompressed. A
    matrix whose first dimension isn't the number of ids is an error, higher dimensions are laid out
    in a row. With ``wanted``(<ids>, position_wanted) only those samples come out, with their place.
    """
    fs, root = FileSystem.from_uri(path)
    names = [(x.path[len(root) :].lstrip("/"),) for x in fs.get_file_info(FileSelector(root, recursive=True)) if x.is_file and x.base_name.endswith(".npz")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("file").to_pylist():
                own, base = FileSystem.from_uri(path)
                with own.open_input_file(f"{base}/{name}") as f, np.load(io.BytesIO(f.read()), allow_pickle=False) as archive:
                    key, values = archive[ids], {m: archive[m] for m in matrices}
                for m, x in values.items():
                    if len(x) != len(key):
                        raise ValueError(f"{name}: {m} has {len(x)} rows for {len(key)} samples")
                for lo in range(0, len(key), ROWS):
                    part = key[lo : lo + ROWS]
                    rows = [pa.array([name] * len(part)), pa.array(np.arange(lo, lo + len(part))), pa.array([str(k) for k in part])]
                    rows += [pa.array(list(x[lo : lo + ROWS].reshape(len(part), -1).astype(np.float64)), pa.list_(pa.float64())) for x in values.values()]
                    yield pa.RecordBatch.from_arrays(rows, names=["file", "position", ids, *matrices])

    files = spark.createDataFrame(names, "file string").repartition(max(1, min(len(names), 10_000)), "file")
    out = files.mapInArrow(run, f"file string, position bigint, `{ids}` string" + "".join(f", `{m}` array<double>" for m in matrices))
    return out if wanted is None else out.join(wanted.withColumn(ids, F.col(ids).cast("string")), ids)


__all__ = ["read_npz"]
