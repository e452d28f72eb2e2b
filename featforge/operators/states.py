"""Aggregates written in Python as a mergeable state, for what built-in aggregates can't express.

A primitive is four functions: ``zero()`` makes an empty state, ``update(state, values)`` takes in a list of values and
returns the state, ``merge(state, state)`` joins two, and ``finish(state)`` gives the result. Every task folds its own rows into
one state a key; the states of a key meet first within shares of the tasks and then once more, so neither the rows nor all the
states of a hot key are gathered: a task holds one state at a time.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DataType, DoubleType, FloatType, IntegerType, StructField, StructType

from featforge.functions.numeric import col

#: Keys whose states a task holds before it sends them on.
MAX_KEYS = 20_000
#: Shares of the tasks within which the states of a key meet first.
SHARES = 16
NAN = float("nan")


@dataclass(frozen=True)
class StatePrimitive:
    """A registered state: the types of columns it takes, the type of its result, and its functions."""

    in_types: tuple[type[DataType], ...]
    out_type: DataType
    zero: Callable[[], Any]
    update: Callable[[Any, list], Any]
    merge: Callable[[Any, Any], Any]
    finish: Callable[[Any], Any]


def _groups(keys: pa.RecordBatch) -> tuple[list[tuple], list[np.ndarray]]:
    """Distinct keys of a batch in order of appearance, and the rows of each."""
    code = np.zeros(keys.num_rows, np.int64)
    for column in keys.columns:
        # Nulls, and NaN as equal to itself, get codes of their own.
        own = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
        code = np.unique(code * (int(own.max()) + 1) + own, return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    edges = np.flatnonzero(np.diff(code[order])) + 1
    rows = np.split(order, edges)
    first = keys.take(pa.array([r[0] for r in rows]))
    return list(zip(*[c.to_pylist() for c in first.columns])), rows


def _merged(rows: DataFrame, keys: list[str], primitives: list[StatePrimitive], schema: StructType, finish: bool) -> DataFrame:
    """One row for each run of equal keys of sorted rows (keys, share, states), with its states merged or finished."""
    code = cloudpickle.dumps(primitives)
    names, n = schema.fieldNames(), len(keys)
    by = [*keys] if finish else [*keys, "_share"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = cloudpickle.loads(code)
        arrow = pa.schema([pa.field(f.name, t) for f, t in zip(schema.fields, _arrow_types(schema))])
        current, states, out = None, None, []

        def flush():
            last = [p.finish(s) if finish else pickle.dumps(s) for p, s in zip(made, states)]
            out.append((*current[:n], *([] if finish else [current[n]]), *last))

        def sent():
            columns = list(zip(*out)) or [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type, from_pandas=False) for c, f in zip(columns, arrow)], schema=arrow)

        for batch in batches:
            labels = list(zip(*[batch.column(batch.schema.names.index(k)).to_pylist() for k in by]))
            parts = [batch.column(batch.schema.names.index(f"_s{i}")) for i in range(len(made))]
            for row, label in enumerate(labels):
                new = [pickle.loads(p[row].as_py()) for p in parts]
                same = current is not None and all(a == b or (a != a and b != b) for a, b in zip(label, current))
                if same:
                    states = [p.merge(a, b) for p, a, b in zip(made, states, new)]
                    continue
                if current is not None:
                    flush()
                current, states = label, new
                if len(out) >= 10_000:
                    yield sent()
                    out.clear()
        if current is not None:
            flush()
        yield sent()

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_columns = [col(k) for k in by]
    return rows.repartition(parts, *by_columns).sortWithinPartitions(*by_columns).mapInArrow(run, schema)


def _arrow_types(schema: StructType) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_schema
    return [f.type for f in to_arrow_schema(schema)]


def aggregate_states(df: DataFrame, keys: str | Sequence[str], outputs: Mapping[str, tuple[str, StatePrimitive]]) -> DataFrame:
    """A row for each key with ``outputs``: name -> (column, primitive).

    Null keys are a group, as in ``groupBy``. States see nulls as None. An empty table gives no rows; names of outputs must differ from the keys.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    columns = [c for c, _ in outputs.values()]
    primitives = [p for _, p in outputs.values()]
    if clash := set(outputs) & set(keys):
        raise ValueError(f"outputs {sorted(clash)} have the name of a key")
    # As in groupBy, 0.0 and -0.0 are one key.
    plain = lambda k: col(k) + F.lit(0.0).cast(df.schema[k].dataType) if isinstance(df.schema[k].dataType, (DoubleType, FloatType)) else col(k)
    rows = df.select(*[plain(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[col(c).alias(f"_v{i}") for i, c in enumerate(columns)])
    inner = [f"_k{i}" for i in range(len(keys))]
    key_fields = [StructField(k, rows.schema[k].dataType) for k in inner]
    partial = StructType([*key_fields, StructField("_share", IntegerType()), *[StructField(f"_s{i}", BinaryType()) for i in range(len(columns))]])
    code = cloudpickle.dumps(primitives)
    n = len(keys)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        made = cloudpickle.loads(code)
        share = TaskContext.get().partitionId() % SHARES
        arrow = pa.schema([pa.field(f.name, t) for f, t in zip(partial.fields, _arrow_types(partial))])
        held: dict[tuple, list] = {}

        def sent():
            labels = list(zip(*held)) or [[]] * n
            states = list(zip(*[[pickle.dumps(s) for s in states] for states in held.values()])) or [[]] * len(made)
            columns = [*labels, [share] * len(held), *states]
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type, from_pandas=False) for c, f in zip(columns, arrow)], schema=arrow)

        for batch in batches:
            if not batch.num_rows:
                continue
            found, members = _groups(pa.RecordBatch.from_arrays(batch.columns[:n], batch.schema.names[:n]))
            order = pa.array(np.concatenate(members))
            values = [c.take(order).to_pylist() for c in batch.columns[n:]]
            low = 0
            for label, rows_ in zip(found, members):
                high = low + len(rows_)
                label = tuple(NAN if v != v else v for v in label)  # one NaN, which is found again in the dictionary
                states = held.get(label)
                if states is None:
                    states = held[label] = [p.zero() for p in made]
                for i, p in enumerate(made):
                    states[i] = p.update(states[i], values[i][low:high])
                low = high
            if len(held) >= MAX_KEYS:
                yield sent()
                held.clear()
        yield sent()

    states = rows.mapInArrow(fold, partial)
    states = _merged(states, inner, primitives, partial, finish=False)
    final = StructType([*key_fields, *[StructField(f"_v{i}", p.out_type) for i, p in enumerate(primitives)]])
    out = _merged(states, inner, primitives, final, finish=True)
    return out.select(*[F.col(a).alias(k) for a, k in zip(inner, keys)], *[F.col(f"_v{i}").alias(name) for i, name in enumerate(outputs)])
