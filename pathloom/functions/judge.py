"""Answer functions as columns: native where Spark has the means, Arrow batches elsewhere."""

from __future__ import annotations

import signal
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import answers


def _text_udf(f: Callable[[str], object], kind: T.DataType) -> Callable[[Column], Column]:
    """A null-safe Arrow function of one text column."""
    return F.pandas_udf(lambda s: pd.Series([None if x is None else f(x) for x in s], dtype=object), kind)


extract_boxed = _text_udf(answers.extract_boxed, T.StringType())
boxed_solution = _text_udf(answers.boxed_solution, T.StringType())
raw_answer = _text_udf(answers.raw_answer, T.StringType())
normalize = _text_udf(answers.normalize, T.StringType())


def extract_answer(response: Column) -> Column:
    """The normalized answer of a response."""
    return normalize(raw_answer(response))


class _Late(Exception):
    pass


def _within(seconds: float, f: Callable[[], object]) -> object:
    """``f()`` or False if it fails or takes too long; the timer needs a main thread and is skipped elsewhere."""

    def late(*_):
        raise _Late

    try:
        old = signal.signal(signal.SIGALRM, late)
    except ValueError:
        old = None
    try:
        if old is not None:
            signal.setitimer(signal.ITIMER_REAL, seconds)
        return f()
    except Exception:
        return False
    finally:
        if old is not None:
            signal.setitimer(signal.ITIMER_REAL, 0)
            signal.signal(signal.SIGALRM, old)


def judged(df: DataFrame, ref: str, pred: str, keep: list[str], query: str | None = None, tolerance: float | None = None, seconds: float = 60.0) -> DataFrame:
    """``keep`` and ``correct``: the prediction equals the reference; failures and timeouts count as wrong.

    With ``query`` the question decides whether answers are compared as sets; with
    ``tolerance`` several answers are matched as a bag within that absolute tolerance.
    Null references give null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            asked = batch.column("__query").to_pylist()
            for r, p, q in zip(batch.column("__ref").to_pylist(), batch.column("__pred").to_pylist(), asked, strict=True):
                if tolerance is not None:
                    out.append(None if r is None else False if p is None else bool(_within(seconds, lambda r=r, p=p: answers.bag_equal(r, p, tolerance))))
                else:
                    got = None if r is None else _within(seconds, lambda r=r, p=p, q=q: answers.answers_equal(r, p, answers.asks_for_set(q or "")))
                    out.append(None if got is None else bool(got))
            n = batch.num_columns - 3
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(out, pa.bool_())], names=[*batch.schema.names[:n], "correct"])

    src = df.select(*keep, F.col(ref).cast("string").alias("__ref"), F.col(pred).cast("string").alias("__pred"), (F.col(query) if query else F.lit(None)).cast("string").alias("__query"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-3]) + ", correct boolean"
    return src.mapInArrow(run, schema)


def numeric_equal(ref: Column, pred: Column, rel: float = 1e-9, absolute: float = 1e-8, percent_rel: float = 1e-3) -> Column:
    """Numbers equal within tolerance or as percent forms of each other; native."""
    near = lambda a, b, r: F.abs(a - b) <= F.greatest(F.lit(r) * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))
    percent = lambda x: ((x > 0) & (x < 1)) | ((x > 1) & (x < 100))
    form = lambda x: percent(x) & near(x, pred, percent_rel)
    return near(ref, pred, rel) | (percent(pred) & (form(ref / 100) | form(ref * 100)))


def tolerant_equal(ref: Column, pred: Column, tolerance: float = 1e-8) -> Column:
    """Numbers equal within an absolute tolerance, also divided or multiplied by 100; native."""
    return F.least(*[F.abs(x - pred) for x in (ref / 100, ref, ref * 100)]) <= tolerance * 1.01


def date_time(text: Column) -> Column:
    """The canonical form of a date, a time or both; native. Day-first is tried before month-first."""
    t = F.trim(text)
    two = lambda x: F.lpad(x, 2, "0")
    day = F.coalesce(
        *[
            F.date_format(F.try_to_date(F.when(t.rlike(p), F.concat_ws("-", *[F.regexp_extract(t, p, i) if k == 4 else two(F.regexp_extract(t, p, i)) for i, k in order])), "yyyy-MM-dd"), "yyyy-MM-dd")
            for p, order in (
                (r"^(\d{4})-(\d{1,2})-(\d{1,2})(?: .*)?$", ((1, 4), (2, 2), (3, 2))),
                (r"^(0?[1-9]|[12]\d|3[01])/(0?[1-9]|1[0-2])/(\d{4})(?: .*)?$", ((3, 4), (2, 2), (1, 2))),
                (r"^(0?[1-9]|1[0-2])/(0?[1-9]|[12]\d|3[01])/(\d{4})(?: .*)?$", ((3, 4), (1, 2), (2, 2))),
                (r"^(\d{4})/(\d{1,2})/(\d{1,2})(?: .*)?$", ((1, 4), (2, 2), (3, 2))),
            )
        ]
    )
    clock = F.regexp_extract(t, r"(?:^| )([01]?\d|2[0-3]):([0-5]?\d)(?::([0-5]?\d))?$", 0)
    parts = F.split(F.trim(clock), ":")
    time = F.when(clock != "", F.concat_ws(":", two(parts[0]), two(parts[1]), two(F.coalesce(F.try_element_at(parts, F.lit(3)), F.lit("0")))))
    has_date, has_time = t.rlike("[/-]"), t.contains(":")
    return F.when(has_date & has_time, F.concat_ws(" ", F.when(time.isNotNull(), day), F.when(day.isNotNull(), time))).when(has_date, day).when(has_time, time)


def format_gate(answer: Column) -> Column:
    """0.0 where no box opens, so that nothing has to be judged; null where judging must decide."""
    return F.when(~F.coalesce(answer.contains("oxed{"), F.lit(False)), 0.0)


def asks_for_set(query: Column) -> Column:
    return query.contains("ind the") | (query.contains("all") & query.contains("separate"))


def has_non_ascii(text: Column) -> Column:
    return text.rlike("[^\\x00-\\x7F]")


def bool_word(text: Column) -> Column:
    """True for texts with "yes" or "true", else False with "no" or "false", else null."""
    t = F.replace(F.lower(text), F.lit("noindent"), F.lit(""))
    return F.when(t.contains("yes") | t.contains("true"), True).when(t.contains("no") | t.contains("false"), False)


def level_number(level: Column, problem: Column) -> Column:
    """The number at the end of a level name; "?" is 2 for problems that start with "We", else 1."""
    last = F.element_at(F.split(level, " "), -1)
    return F.when(last == "?", F.when(problem.startswith("We"), 2).otherwise(1)).otherwise(last.try_cast("int"))
