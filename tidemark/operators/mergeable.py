"""Aggregates whose author gives a partial state, how two states merge, and what comes of the last one.

A state is bytes. Rows are taken in Arrow batches, a state a group and task
leaves the task, states are merged over salted groups and then over the salts,
so a group of any size is neither gathered nor one task's rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: States of a group that are merged by one task of the first level, are those of so many tasks' remainders.
SALTS = 32
#: States that a task holds before it sends them on, and their bytes.
HELD = 50_000
HELD_BYTES = 1 << 28


@dataclass(frozen=True)
class Mergeable:
    """partial: a batch of the columns to a state; merge: two states to one, in any order; finish: a state to a row in the types of schema.

    The others do the same for many groups at a time, where groups are small; where they are not given, the groups are gone through one by one.
    partials: a batch and its rows' group numbers (none left out) to a state a group; merges: states and where each group of them begins to a state a group; finishes: states to columns.
    """

    columns: tuple[str, ...]
    partial: Callable[[pa.RecordBatch], bytes]
    merge: Callable[[bytes, bytes], bytes]
    finish: Callable[[bytes], tuple]
    schema: str
    partials: Callable[[pa.RecordBatch, np.ndarray], pa.Array] | None = None
    merges: Callable[[pa.Array, np.ndarray], pa.Array] | None = None
    finishes: Callable[[pa.Array], list[pa.Array]] | None = None

    def states(self, batch: pa.RecordBatch, codes: np.ndarray) -> pa.Array:
        if self.partials:
            return self.partials(batch, codes)
        order = np.argsort(codes, kind="stable")
        parts = np.split(order, np.flatnonzero(np.diff(codes[order])) + 1)
        return pa.array([self.partial(batch.take(pa.array(rows))) for rows in parts], pa.binary())

    def together(self, states: pa.Array, begins: np.ndarray) -> pa.Array:
        if self.merges:
            return self.merges(states, begins)
        each, ends = states.to_pylist(), [*begins[1:].tolist(), len(states)]
        return pa.array([reduce(self.merge, each[i:j]) for i, j in zip(begins.tolist(), ends, strict=True)], pa.binary())

    def results(self, states: pa.Array, types: list[pa.DataType]) -> list[pa.Array]:
        if self.finishes:
            return self.finishes(states)
        rows = [self.finish(x) for x in states.to_pylist()]
        return [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]


def _codes(batch: pa.RecordBatch, group: list[str]) -> np.ndarray:
    """Each row's group as a number from 0 on, none left out."""
    codes = np.zeros(batch.num_rows, np.int64)
    for g in group:
        column = batch.column(g).dictionary_encode(null_encoding="encode")
        codes = codes * len(column.dictionary) + np.asarray(column.indices)
        codes = np.unique(codes, return_inverse=True)[1]
    return codes


def _begins(codes: np.ndarray) -> np.ndarray:
    """Where a row's group is not that of the row before."""
    return np.flatnonzero(np.diff(codes, prepend=-1))


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Batches on end as one; more than 2 GB of states in it are an error."""
    return batches[0] if len(batches) == 1 else pa.RecordBatch.from_arrays([pa.concat_arrays([b.column(i) for b in batches]) for i in range(batches[0].num_columns)], schema=batches[0].schema)


def merged(df: DataFrame, group: list[str], how: Mergeable, salts: int = SALTS, held: int = HELD) -> DataFrame:
    """group and what finish gives, a row a group; nulls are a group."""
    picked = df.select(*group, *[c for c in how.columns if c not in group])
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema if f.name in group]
    types = {f.name: f.dataType for f in picked.schema}

    def lines(keys: pa.RecordBatch, rows: np.ndarray, states: pa.Array, names: list[str]) -> pa.RecordBatch:
        """A row a state, with the names' values in rows."""
        return pa.RecordBatch.from_arrays([*(keys.column(g).take(pa.array(rows)) for g in names), states], names=[*names, "_state"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt, kept = TaskContext.get().partitionId() % salts, []

        def salted(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(batch.column(g) for g in group), pa.array(np.full(batch.num_rows, salt, np.int32)), batch.column("_state")], names=[*group, "_salt", "_state"])

        for batch in batches:
            if batch.num_rows:
                codes = _codes(batch, group)
                kept.append(lines(batch, np.unique(codes, return_index=True)[1], how.states(batch.select(list(how.columns)), codes), group))
            if sum(x.num_rows for x in kept) > held or sum(x.nbytes for x in kept) > HELD_BYTES:
                one = _one(kept)
                codes = _codes(one, group)
                order = np.argsort(codes, kind="stable")
                begins = _begins(codes[order])
                kept = [lines(one, order[begins], how.together(one.column("_state").take(pa.array(order)), begins), group)]
                if 2 * kept[0].num_rows > held or 2 * kept[0].nbytes > HELD_BYTES:
                    yield salted(kept[0])
                    kept = []
        for x in kept:
            yield salted(x)

    def again(names: list[str]):
        """States of rows in order of names: each run of the same values becomes one."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last: list[pa.RecordBatch] = []  # of the last values, which may go on
            for batch in batches:
                if not batch.num_rows:
                    continue
                one = _one([*last, batch])
                begins = _begins(_codes(one, names))
                done = lines(one, begins, how.together(one.column("_state"), begins), names)
                last = [_one([done.slice(done.num_rows - 1)])]
                if done.num_rows > 1:
                    yield done.slice(0, done.num_rows - 1)
            yield from last

        return run

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        for batch in batches:
            made = how.results(batch.column("_state"), [to_arrow_type(f.dataType) for f in out.fields])
            yield pa.RecordBatch.from_arrays([*(batch.column(g) for g in group), *made], names=[*group, *out.names])

    from pyspark.sql.types import StructType

    out = StructType.fromDDL(how.schema)
    head = ", ".join(kinds)
    if missing := [g for g in group if g not in types]:
        raise ValueError(f"no such column: {', '.join(missing)}")
    # one zero a group, as where Spark groups
    picked = picked.withColumns({g: (F.col(f"`{g}`") + F.lit(0.0)).cast(types[g]) for g in group if types[g].simpleString() in ("float", "double")})
    ordered = lambda df, names: df.repartition(*names).sortWithinPartitions(*names)
    states = picked.mapInArrow(partial, f"{head}, _salt int, _state binary")
    some = ordered(states, [*group, "_salt"]).mapInArrow(again([*group, "_salt"]), f"{head}, _salt int, _state binary")
    one = ordered(some.drop("_salt"), group).mapInArrow(again(group), f"{head}, _state binary")
    return one.mapInArrow(last, f"{head}, {how.schema}")


def _matrix(states: pa.Array, width: int) -> np.ndarray:
    """States of so many numbers each, a row each."""
    _, at, data = states.buffers()
    begin = int(np.frombuffer(at, np.int32)[states.offset]) if len(states) else 0
    return np.frombuffer(data, np.int64, len(states) * width, begin).reshape(-1, width) if len(states) else np.zeros((0, width), np.int64)


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of numbers as states."""
    at = np.arange(len(rows) + 1, dtype=np.int32) * (8 * rows.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(rows, np.int64))])


def histogram(measure: str, low: float, width: float, bins: int) -> Mergeable:
    """Counts of a number by bins of equal width; values below and above go to the first and the last bin, nulls are counted apart."""
    size = bins + 1

    def partials(batch: pa.RecordBatch, codes: np.ndarray) -> pa.Array:
        column = batch.column(measure)
        null = np.asarray(column.is_null())
        at = np.full(len(column), bins, np.int64)
        at[~null] = np.clip(np.floor((np.asarray(column.drop_null().cast(pa.float64())) - low) / width), 0, bins - 1).astype(np.int64)
        n = int(codes.max()) + 1
        return _binary(np.bincount(codes * size + at, minlength=n * size).reshape(n, size))

    def finishes(states: pa.Array) -> list[pa.Array]:
        return [pa.ListArray.from_arrays(pa.array(np.arange(len(states) + 1, dtype=np.int32) * size), pa.array(_matrix(states, size).ravel()))]

    add = lambda x, y: (np.frombuffer(x, np.int64) + np.frombuffer(y, np.int64)).tobytes()
    return Mergeable(
        (measure,), lambda batch: partials(batch, np.zeros(batch.num_rows, np.int64))[0].as_py(), add, lambda x: (np.frombuffer(x, np.int64).tolist(),), "counts array<bigint>",
        partials, lambda states, begins: _binary(np.add.reduceat(_matrix(states, size), begins, axis=0)), finishes,
    )


def distribution_drift(expected: DataFrame, actual: DataFrame, group: list[str], how: Mergeable) -> DataFrame:
    """Groups with the total variation distance of the two sides' histograms (0 to 1; 1 where a side has none): group, n_expected, n_actual, distance."""
    side = lambda df, s: merged(df, group, how).select(*[F.col(g).alias(f"_{s}_{g}") for g in group], F.col("counts").alias(s))
    same = reduce(lambda x, g: x & F.col(f"_e_{g}").eqNullSafe(F.col(f"_a_{g}")), group, F.lit(True))
    both = side(expected, "e").join(side(actual, "a"), same, "full_outer")
    total = lambda c: F.coalesce(F.aggregate(c, F.lit(0).cast("bigint"), lambda x, y: x + y), F.lit(0))
    counted = both.select(*[F.coalesce(f"_e_{g}", f"_a_{g}").alias(g) for g in group], "e", "a", total(F.col("e")).alias("n_expected"), total(F.col("a")).alias("n_actual"))
    apart = F.aggregate(F.zip_with("e", "a", lambda x, y: F.abs(x * F.col("n_actual") - y * F.col("n_expected")).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"), lambda x, y: (x + y).cast("decimal(38,0)"))
    distance = apart.cast("double") / (2.0 * F.col("n_expected") * F.col("n_actual"))
    return counted.select(*group, "n_expected", "n_actual", F.when((F.col("n_expected") == 0) | (F.col("n_actual") == 0), 1.0).otherwise(distance).alias("distance"))
