"""Dataflow combinators over DataFrames and Columns.

A failed step is a null value (with a ``control`` struct where the reason matters); a list is an array column.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Step = Callable[[Column], Column]
Transform = Callable[[DataFrame], DataFrame]


def compose(*steps: Transform) -> Transform:
    """Left to right."""
    return lambda df: reduce(lambda d, f: d.transform(f), steps, df)


def through(name: str, value: Column) -> Transform:
    return lambda df: df.withColumn(name, value)


def keep_if(cond: Column) -> Transform:
    """A null condition drops the row, as a false one does."""
    return lambda df: df.filter(cond)


def tap(observation: str, *aggregates: Column) -> Transform:
    """Passes rows on and observes aggregates of them."""
    return lambda df: df.observe(observation, *aggregates)


def tap_or_halt(value: Column, ok: Column, reason: Column) -> Column:
    """struct<value, control>: passes a value on that the look at it is content with; else, or if that look has no answer, the flow halts with the reason.  A null value has failed before and stays so."""
    fine = F.coalesce(ok, F.lit(False))
    return F.struct(F.when(fine, value).alias("value"), F.when(value.isNotNull() & ~fine, control(F.lit("halt"), reason)).alias("control"))


def progress(observation: str, every: int) -> Transform:
    """Passes rows on and observes how many there are, and how many times ``every``."""
    return tap(observation, F.count("*").alias("rows"), F.floor(F.count("*") / every).alias("steps"))


def tap_either(observation: str, control_col: str) -> Transform:
    """Passes rows on and observes both sides: how many have failed and how many have not."""
    failed = F.col(control_col).isNotNull()
    return tap(observation, F.count_if(failed).alias("failed"), F.count_if(~failed).alias("successful"))


def traced(namespace: str, **steps: Transform) -> Transform:
    """The named steps in turn, each observed as ``namespace/step`` with the rows that leave it; namespaces nest by their names."""
    return compose(*(f for name, step in steps.items() for f in (step, tap(f"{namespace}/{name}", F.count("*").alias("rows")))))


def with_control(value: Column, reason: Column, halt: bool = True) -> Column:
    """struct<value, control>: a null value has a control, ``halt`` or ``continue``, with the reason."""
    failed = control(F.lit("halt" if halt else "continue"), reason)
    return F.struct(value.alias("value"), F.when(value.isNull(), failed).alias("control"))


def for_each_until_halt(items: Column, step: Callable[[Column], Column]) -> Column:
    """struct<values, control> of steps that give struct<value, control>: what continues is dropped, the first that halts ends it and is the whole's control."""
    done = F.transform(items, step)
    halts = F.transform(done, lambda x: F.coalesce(x["control"]["code"] == "halt", F.lit(False)))
    at = F.array_position(halts, True).cast("int")
    upto = F.when(at > 0, F.slice(done, F.lit(1), at - 1)).otherwise(done)
    values = F.transform(F.filter(upto, lambda x: x["control"].isNull()), lambda x: x["value"])
    return F.struct(values.alias("values"), F.get(done, F.when(at > 0, at - 1))["control"].alias("control"))


def first_or_halt(value: Column, *steps: Callable[[Column], Column]) -> Column:
    """struct<value, control>: the first step that succeeds, unless one before it halts; the last control if none succeeds."""
    tried = [f(value) for f in steps]
    out = tried[-1]
    for one in reversed(tried[:-1]):
        out = F.when(one["control"].isNull() | (one["control"]["code"] == "halt"), one).otherwise(out)
    return out


def map_env(**columns: Column) -> Transform:
    """The next stage's columns from this one's."""
    return lambda df: df.select(*(c.alias(n) for n, c in columns.items()))


def for_each_do(items: Column, step: Step) -> Column:
    """The step's results in order; failures are dropped, and the whole never fails."""
    return F.filter(F.transform(items, step), lambda x: x.isNotNull())


def collect_fanout(value: Column, *steps: Step) -> Column:
    """The successful results of all steps on one value, in order."""
    return F.array_compact(F.array(*(f(value) for f in steps)))


def take_while_success(value: Column, *checks: Step) -> Column:
    """The value itself if every check on it succeeds (is neither null nor false), else null."""
    done = lambda r: F.coalesce(r.cast("string") != "false", F.lit(False))
    return F.when(reduce(lambda a, b: a & b, (done(f(value)) for f in checks), F.lit(True)), value)


def each_or_else(value: Column, *steps: Step) -> Column:
    """The first step that succeeds; null if none does or there is none."""
    return F.coalesce(*(f(value) for f in steps)) if steps else F.lit(None)


def first_success(attempts: list[tuple[Column, Column]]) -> Column:
    """The value of the first attempt (condition, value) whose condition holds."""
    out = F.lit(None)
    for cond, value in reversed(attempts):
        out = F.when(cond, value).otherwise(out)
    return out


def control(code: Column, message: Column) -> Column:
    return F.struct(code.alias("code"), message.alias("msg"))


def through_left(control_col: str, replacement: Column) -> Transform:
    """Replaces the control of failed rows only."""
    return lambda df: df.withColumn(control_col, F.when(F.col(control_col).isNotNull(), replacement))


def separate_results(df: DataFrame, control_col: str) -> tuple[DataFrame, DataFrame]:
    """(failed, successful) rows."""
    return df.filter(F.col(control_col).isNotNull()), df.filter(F.col(control_col).isNull())


def generator(spark: SparkSession, name: str, make: Callable[..., Iterable], kind: str) -> Callable:
    """Registers a step that yields many values for one as a table function, for SQL (``FROM t, LATERAL name(t.x)``) and for ``each_generated``.

    ``make`` gets the arguments and yields values of type ``kind``.  It gives rows (pos, value, control); what it raises ends the values of that
    row with one of its own, whose control halts with the reason.
    """

    class Generator:
        def eval(self, *args: object) -> Iterator[tuple]:
            pos = 0
            try:
                for pos, v in enumerate(make(*args), 1):  # noqa: B020
                    yield pos - 1, v, None
            except Exception as e:  # noqa: BLE001  a user's function may raise anything; it is the row's result
                yield pos, None, ("halt", str(e))

    made = F.udtf(Generator, returnType=f"pos int, value {kind}, control struct<code:string,msg:string>")
    spark.udtf.register(name, made)
    return made


def each_generated(df: DataFrame, made: Callable, *columns: str) -> DataFrame:
    """``df`` with a row for each value that a ``generator`` yields for its columns, and pos, value, control."""
    return df.lateralJoin(made(*(F.col(c).outer() for c in columns)))
