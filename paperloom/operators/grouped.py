"""Python on the rows of a key, many keys to a batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def map_groups(df: DataFrame, keys: list[str], run, added: str) -> DataFrame:
    """keys and the columns of `added` for each row that run(rows) gives, where rows are a key's rows as dicts.

    The rows of a key are gathered by the JVM and whole batches of keys go to Python: a call per key costs
    microseconds, where a data frame per key costs milliseconds. A key's rows must fit a task (pages and tasks are
    bounded by their limits).
    """
    packed = dealt(df, keys).groupBy(*keys).agg(F.collect_list(F.struct(*[c for c in df.columns if c not in keys])).alias("_rows"))
    return map_rows(packed, keys, lambda rows: (out for row in rows for out in run(row["_rows"])), added)


def dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """df by its keys in as many parts as the session's shuffles have.

    A number that is given isn't lowered where the rows are few bytes: work on a key costs far more than its bytes say.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


#: Rows of a part of a table whose rows are sorted and joined by key.
PART_ROWS = 50_000


def dealt_by_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """df by its keys in as many parts as its rows need, so that what a task sorts doesn't grow with the table.

    Windows, groups and joins by these keys that follow stay in these parts. The rows are counted first, which for a
    Parquet table reads footers only.
    """
    return df.repartition(max(1, -(-df.count() // PART_ROWS)), *keys)


#: Bytes of a batch that goes to Python: a lower value than the session's is left alone.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20
#: Rows whose Python values are alive at once, or one key's.
SLICE = 1 << 16
#: Packed rows that are turned into Python values at once.
PIECE = 64


def small_batches(spark) -> None:
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH)) > BATCH_BYTES:
        spark.conf.set(BATCH, BATCH_BYTES)


def map_columns(df: DataFrame, keys: list[str], run, added: str) -> DataFrame:
    """As map_groups for keys of many small rows: run(columns) gets a key's values as one list a column, in no order.

    Lists of plain values cost a tenth of a dict a row; a few keys at a time are turned into Python values.
    """
    rest = [c for c in df.columns if c not in keys]
    packed = df.groupBy(*keys).agg(F.collect_list(F.struct(*rest)).alias("_rows"))
    schema = StructType([*[df.schema[k] for k in keys], *StructType.fromDDL(added)])
    arrow = to_arrow_schema(schema)

    def go(batches):
        for batch in batches:
            lists = batch.column(len(keys))
            offsets = lists.offsets.to_pylist()
            i = 0
            while i < batch.num_rows:
                j = i + 1
                while j < batch.num_rows and offsets[j + 1] - offsets[i] <= SLICE:
                    j += 1
                values = lists.values.slice(offsets[i], offsets[j] - offsets[i])
                columns = [values.field(k).to_pylist() for k in range(len(rest))]
                made, sizes = [], []
                for k in range(i, j):
                    rows = list(run([c[offsets[k] - offsets[i] : offsets[k + 1] - offsets[i]] for c in columns]))
                    made += rows
                    sizes.append(len(rows))
                at = pa.array([k for k, n in zip(range(i, j), sizes) for _ in range(n)], pa.int32())
                new = zip(*made) if made else [()] * (len(arrow) - len(keys))
                yield pa.RecordBatch.from_arrays([*[batch.column(n).take(at) for n in range(len(keys))], *[pa.array(x, f.type) for x, f in zip(new, list(arrow)[len(keys) :])]], schema=arrow)
                i = j

    small_batches(df.sparkSession)
    return packed.mapInArrow(go, schema)


def map_rows(df: DataFrame, keys: list[str], run, added: str) -> DataFrame:
    """keys and the columns of `added` for each tuple that run([row]) gives, for each row as a dict, whole batches to Python."""
    schema = StructType([*[df.schema[k] for k in keys], *StructType.fromDDL(added)])
    arrow = to_arrow_schema(schema)

    def go(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE):
                columns: list[list] = [[] for _ in arrow]
                for row in batch.slice(at, PIECE).to_pylist():
                    for out in run([row]):
                        for i, k in enumerate(keys):
                            columns[i].append(row[k])
                        for i, value in enumerate(out, len(keys)):
                            columns[i].append(value)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, arrow)], schema=arrow)

    small_batches(df.sparkSession)
    return df.mapInArrow(go, schema)


def map_values(df: DataFrame, keys: list[str], run, added: str) -> DataFrame:
    """keys and the columns of `added` for the values of the one other column, many rows at once.

    run(values) takes the values of a batch in order and gives, for as many of them at a time as it likes, their number and
    the columns: first each row's place among those values, then `added`.
    """
    schema = StructType([*[df.schema[k] for k in keys], *StructType.fromDDL(added)])
    arrow, value = to_arrow_schema(schema), next(i for i, c in enumerate(df.columns) if c not in keys)
    places = [df.columns.index(k) for k in keys]

    def go(batches):
        for batch in batches:
            start = 0
            for count, (at, *new) in run(x.as_py() for x in batch.column(value)):
                own = [batch.column(n).take(pa.array(at + start, pa.int32())) for n in places]
                yield pa.RecordBatch.from_arrays([*own, *[pa.array(x, f.type) for x, f in zip(new, list(arrow)[len(keys) :])]], schema=arrow)
                start += count

    small_batches(df.sparkSession)
    return df.mapInArrow(go, schema)


def least_linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member that each of the members 0 to n - 1 is linked with by the pairs (a, b), itself if with none."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        # what a label was made of by now counts for all that have it
        np.minimum.at(new, label, new)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def linked(df: DataFrame, members: str, pairs: tuple[str, str], added: str) -> DataFrame:
    """df with `added`, array<int>: for each place of the array `members` the least place that it is linked with.

    pairs: the two columns of places that are linked. All rows of a batch are spread at once, by columns; other columns
    pass as they are.
    """
    schema = StructType([*df.schema.fields, *StructType.fromDDL(f"{added} array<int>")])
    arrow, at = to_arrow_schema(schema), [df.columns.index(c) for c in (members, *pairs)]

    def go(batches):
        for batch in batches:
            begins = [batch.column(k).offsets.to_numpy() for k in at]
            size, links = np.diff(begins[0]), np.diff(begins[1])
            first = np.cumsum(size) - size
            own = np.repeat(first, links)
            a, b = (batch.column(k).flatten().to_numpy(zero_copy_only=False) + own for k in at[1:])
            label = least_linked(int(size.sum()), a, b) - np.repeat(first, size)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(label, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists.cast(arrow.field(added).type)], schema=arrow)

    small_batches(df.sparkSession)
    return df.mapInArrow(go, schema)
