"""Arrow functions that are made when they are first used, as their types need a session."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache, wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


#: Rows that are Python values at once, and bytes of them (a single row may have more).
ROWS, BYTES = 512, 1 << 20


def _cuts(columns: tuple[pa.Array, ...]) -> Iterator[tuple[int, int]]:
    """Slices of a batch of at most ROWS rows and about BYTES."""
    n = len(columns[0])
    step = max(1, min(ROWS, n * BYTES // max(1, sum(c.nbytes for c in columns))))
    todo = [(lo, min(lo + step, n)) for lo in range(0, n, step)][::-1]
    while todo:
        lo, hi = todo.pop()
        if hi - lo > 1 and sum(c.slice(lo, hi - lo).nbytes for c in columns) > 2 * BYTES:
            todo += [((lo + hi) // 2, hi), (lo, (lo + hi) // 2)]
        else:
            yield lo, hi


def _sliced(f: Callable[..., list], kind: pa.DataType, columns: tuple[pa.Array, ...]) -> pa.Array:
    """What f makes of lists of Python values, slice after slice. Values of a struct are tuples."""
    names = [x.name for x in kind] if pa.types.is_struct(kind) else None
    made = []
    for lo, hi in _cuts(columns):
        values = f(*[c.slice(lo, hi - lo).to_pylist() for c in columns])
        if names is None:
            made.append(pa.array(values, kind))
        else:
            made.append(pa.StructArray.from_arrays([pa.array([v[i] for v in values], kind[i].type) for i in range(len(names))], names=names))
    return made[0] if len(made) == 1 else pa.concat_arrays(made) if made else pa.array([], kind)


def arrow(ddl: str) -> Callable[[Callable[..., list]], Callable[..., Column]]:
    """An Arrow UDF with this return type, of a function that takes lists of Python values and returns a list. A worker has a batch in
    Arrow's form and only a slice of it as Python values, so its memory depends on neither the table nor the length of its texts (but for the longest)."""

    def decorate(f: Callable[..., list]) -> Callable[..., Column]:
        def make() -> Callable[..., Column]:
            kind = to_arrow_type(T._parse_datatype_string(ddl))

            def run(*columns: pa.Array) -> pa.Array:
                return _sliced(f, kind, columns)

            return F.arrow_udf(run, ddl)

        made = cache(make)

        @wraps(f)
        def call(*columns: Column | str) -> Column:
            return made()(*columns)

        call.plain = f  # the function itself, for tests
        return call

    return decorate


def add_column(df: DataFrame, name: str, ddl: str, f: Callable[..., list], *inputs: str) -> DataFrame:
    """df with a column that f makes of lists of Python values, slices of an Arrow batch at a time. A step of its own in the plan:
    what is computed from it later is not computed again inside its arguments."""
    kind = T._parse_datatype_string(ddl)
    schema = T.StructType([*[x for x in df.schema.fields if x.name != name], T.StructField(name, kind)])
    others = [x.name for x in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow_type = to_arrow_type(kind)
        for batch in batches:
            for lo, hi in _cuts(tuple(batch.columns)):
                part = batch.slice(lo, hi - lo)
                made = f(*[part.column(c).to_pylist() for c in inputs])
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in others], pa.array(made, arrow_type)], names=[*others, name])

    return df.mapInArrow(run, schema)
