"""User aggregates with partial states: a group never has to fit into a worker.

A `Partial` is written over whole Arrow columns: `update` turns rows into one state for each group among them, `merge` turns
states into one for each group, `finish` turns states into results. Tasks update and merge as they read and hand on one
state a group (or several, where its states take more than `HELD_BYTES`); states are shuffled by key and sorted, and merged as
they stream by, one batch at a time. So memory is bounded on both sides, and a hot key costs a state from each task.
An array state is shuffled without the zeros at its ends: where most groups have few rows, most of it is zeros.

`merge` must not depend on order or grouping; sums of floating-point numbers do, in their last digits.

Defined cases: a null key is a group of its own, as in SQL; keys may be of any Arrow type that Spark has but for maps.
What nulls among inputs mean is up to the `Partial`; those below ignore them, and give null where nothing is left.
An empty table has no groups. Without keys the whole table is one group, of which an empty table has none either. Extra
columns are not read. An input must not have the name of a key or begin with `__state`.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Groups that a task holds before it hands their states on, and bytes of their states (array states count whole).
HELD, HELD_BYTES = 100_000, 32 << 20

#: Types of states, and the Arrow types that Spark takes for them.
KINDS = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "array<bigint>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}

States = dict[str, np.ndarray]


class Partial:
    """state: name -> type, one of KINDS, of each column of a state; result: Spark type. In numpy, an array state has a second
    axis; all its rows have the same length."""

    state: dict[str, str]
    result: str  # the Arrow type that finish gives must be that of this

    def update(self, columns: list[pa.Array], group: np.ndarray, n: int) -> States:
        """States of the n groups; group: the number of each row's group."""
        raise NotImplementedError

    def merge(self, states: States, group: np.ndarray, n: int) -> States:
        """One state for each of n groups; by default, sums."""
        return {name: _sums(x, group, n) for name, x in states.items()}

    def finish(self, states: States) -> pa.Array:
        raise NotImplementedError


def _sums(x: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, *x.shape[1:]), x.dtype)
    np.add.at(out, group, x)
    return out


def _numbered(keys: list[pa.Array], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The group of each row, and the first row of each group."""
    code = np.zeros(rows, np.int64)
    for k in keys:
        own = pc.dictionary_encode(k, null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
        # after each key the codes are numbered again, so their product can't overflow
        _, code = np.unique(code * (own.max(initial=0) + 1) + own, return_inverse=True)
    _, first, group = np.unique(code, return_index=True, return_inverse=True)
    return group, first


def _to_numpy(column: pa.Array) -> np.ndarray:
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return column.to_numpy(zero_copy_only=False)


def _trimmed(column: pa.Array) -> pa.Array:
    """Lists of one length as lists of that length, the number of zeros in front, and what is left without zeros at the ends."""
    x = _to_numpy(column)
    there = np.ascontiguousarray(x).view(np.int64) != 0  # bits, so a negative zero is kept
    any_ = there.any(axis=1) if x.shape[1] else np.zeros(len(x), bool)
    first, stop = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    first[any_], stop[any_] = there[any_].argmax(axis=1), x.shape[1] - there[any_][:, ::-1].argmax(axis=1)
    ends = np.concatenate([[0], np.cumsum(stop - first + 2)])
    out = np.empty(ends[-1], x.dtype)
    out[ends[:-1]], out[ends[:-1] + 1] = x.shape[1], first
    at, left = np.arange(x.shape[1]), np.ones(ends[-1], bool)
    left[ends[:-1]] = left[ends[:-1] + 1] = False
    out[left] = x[(at >= first[:, None]) & (at < stop[:, None])]
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(out, column.type.value_type))


def _restored(column: pa.Array) -> pa.Array:
    """The lists that `_trimmed` was given."""
    values, sizes = column.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    width = int(values[0]) if len(values) else 0
    out, row = np.zeros((len(sizes), width), values.dtype), np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(values)) - starts[row]  # in the list
    left = at >= 2
    out[row[left], values[starts + 1].astype(np.int64)[row[left]] + at[left] - 2] = values[left]
    return _lists(out, column.type.value_type)


def _arrays(table: pa.Table, n_keys: int, change) -> pa.Table:
    """table with `change` done to its array states."""
    columns = [c.combine_chunks() for c in table.columns]
    return pa.table([c if i < n_keys or not pa.types.is_list(c.type) else change(c) for i, c in enumerate(columns)], table.column_names)


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel(), kind))


def _to_arrow(x: np.ndarray, kind: str) -> pa.Array:
    if x.ndim == 1:
        return pa.array(x, KINDS[kind])
    return _lists(x, KINDS[kind].value_type)


def _table(keys: list[pa.Array], first: np.ndarray, states: States, agg: Partial) -> pa.Table:
    """The keys of rows `first` with their states."""
    at = pa.array(first)
    columns = [*(k.take(at) for k in keys), *(_to_arrow(states[name], kind) for name, kind in agg.state.items())]
    return pa.table(columns, [f"k{i}" for i in range(len(keys))] + list(agg.state))


def _merged(held: list[pa.Table], n_keys: int, agg: Partial) -> pa.Table:
    """One state for each key of tables of keys and states."""
    columns = [c.combine_chunks() for c in pa.concat_tables(held).columns]
    group, first = _numbered(columns[:n_keys], len(columns[-1]))
    done = agg.merge({name: _to_numpy(c) for name, c in zip(agg.state, columns[n_keys:])}, group, len(first))
    return _table(columns[:n_keys], first, done, agg)


def _updates(n_keys: int, agg: Partial):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []  # the merged states so far, and those of single batches
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, inputs = batch.columns[:n_keys], batch.columns[n_keys:]
            group, first = _numbered(keys, batch.num_rows)
            held.append(_table(keys, first, agg.update(inputs, group, len(first)), agg))
            rows, size = sum(t.num_rows for t in held), sum(t.nbytes for t in held)
            if len(held) > 1 and (rows > 2 * held[0].num_rows or rows > HELD or size > HELD_BYTES):  # each state is merged a few times, not once a batch
                held = [_merged(held, n_keys, agg)]
            if held[0].num_rows > HELD or 2 * held[0].nbytes > HELD_BYTES:
                yield from handed_on(_merged(held, n_keys, agg))
                held = []
        if held:
            yield from handed_on(_merged(held, n_keys, agg))

    def handed_on(table: pa.Table) -> Iterator[pa.RecordBatch]:
        for at in range(0, table.num_rows, 10_000):
            yield from _arrays(table.slice(at, 10_000), n_keys, _trimmed).to_batches()

    return run


def _finishes(n_keys: int, agg: Partial):
    """Over states sorted by key: all keys of a batch but its last are complete."""

    def finished(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if table.num_rows:
            columns = [c.combine_chunks() for c in table.columns]
            result = agg.finish({name: _to_numpy(c) for name, c in zip(agg.state, columns[n_keys:])})
            yield from pa.table([*columns[:n_keys], result], [*table.column_names[:n_keys], "result"]).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            if batch.num_rows:
                new = pa.Table.from_batches([batch]).rename_columns([f"k{i}" for i in range(n_keys)] + list(agg.state))
                new = _arrays(new, n_keys, _restored)
                all_ = _merged([*held, new], n_keys, agg)
                last = _equal(all_.select(range(n_keys)), new.slice(new.num_rows - 1).select(range(n_keys)), all_.num_rows)
                yield from finished(all_.filter(pa.array(~last)))
                held = [all_.filter(pa.array(last))]
        for table in held:
            yield from finished(table)

    return run


def _equal(keys: pa.Table, row: pa.Table, n: int) -> np.ndarray:
    """Which of the n rows of keys are the given one; nulls are equal to each other."""
    out = np.ones(n, bool)
    for a, b in zip(keys.columns, row.columns):
        code = pc.dictionary_encode(pa.chunked_array([*a.chunks, *b.chunks]).combine_chunks(), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        out &= code[:-1] == code[-1]
    return out


def aggregate(df: DataFrame, keys: Sequence[str], inputs: Sequence[str], agg: Partial, name: str) -> DataFrame:
    """keys and the aggregate of inputs, a row for each group."""
    fields = [df.schema[k] for k in keys]
    states = T.StructType([*fields, *(T.StructField(f"__state_{s}", T.DataType.fromDDL(kind)) for s, kind in agg.state.items())])
    out = T.StructType([*fields, T.StructField(name, T.DataType.fromDDL(agg.result))])
    part = df.select(*keys, *inputs).mapInArrow(_named(_updates(len(keys), agg), states.names), states)
    dealt = part.repartition(*keys).sortWithinPartitions(*keys) if keys else part.coalesce(1)
    return dealt.mapInArrow(_named(_finishes(len(keys), agg), out.names), out)


def _named(run, names: list[str]):
    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, names)

    return renamed


def _given(column: pa.Array, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values that aren't null, as doubles, and their groups."""
    there = column.is_valid().to_numpy(zero_copy_only=False)
    return column.drop_null().to_numpy(zero_copy_only=False).astype(np.float64), group[there]


class GeometricMean(Partial):
    """exp(mean(log(1 + x)))."""

    state = {"n": "bigint", "logs": "double"}
    result = "double"

    def update(self, columns: list[pa.Array], group: np.ndarray, n: int) -> States:
        x, group = _given(columns[0], group)
        return {"n": np.bincount(group, minlength=n).astype(np.int64), "logs": np.bincount(group, np.log1p(x), n)}

    def finish(self, states: States) -> pa.Array:
        n = states["n"]
        return pa.array(np.exp(states["logs"] / np.maximum(n, 1)), mask=n == 0)


class MiddleMagnitude(Partial):
    """The least m for which at least half of the values are below 2^m: a quantile of a histogram of fixed size."""

    state = {"counts": "array<bigint>"}
    result = "int"
    SIZE = 64

    def update(self, columns: list[pa.Array], group: np.ndarray, n: int) -> States:
        x, group = _given(columns[0], group)
        bucket = np.clip(np.frexp(np.maximum(x, 0))[1], 0, self.SIZE - 1)
        return {"counts": np.bincount(group * self.SIZE + bucket, minlength=n * self.SIZE).reshape(n, self.SIZE).astype(np.int64)}

    def finish(self, states: States) -> pa.Array:
        upto = np.cumsum(states["counts"].reshape(-1, self.SIZE), axis=1)
        return pa.array(np.argmax(2 * upto >= upto[:, -1:], axis=1).astype(np.int32), mask=upto[:, -1] == 0)
