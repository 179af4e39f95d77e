"""The N best rows of every group, by merging sorted runs.

Map side, each task cuts its rows into *runs*: rows ordered by (group, score descending, ties), of
which a run keeps the first N of a group, since no later row can be among the N best overall. A
group that holds a third of all rows therefore sends at most N rows a run. The runs are then stored
by bucket of the group's hash in the shuffle, and each bucket is merged with a tree of losers that,
after N outputs of a group, seeks every run to its next group.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUN_ROWS = 250_000
BUCKETS = 64
_FIRST, _SECOND, _THIRD = "t0", "t1", "t2"


class LoserTree:
    """A tournament over ``runs`` (lists of keys, each ascending): inner nodes keep the loser, the root the winner."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs = runs
        self.at = [0] * len(runs)
        size = 1
        while size < len(runs):
            size *= 2
        self.size = size
        self.head: list[tuple | None] = [run[0] if run else None for run in runs] + [None] * (size - len(runs))
        self.losers = [0] * size
        winners = [0] * size + list(range(size))
        for node in range(size - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        self.winner = winners[1] if size > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        return y is None or (x is not None and x <= y)

    def top(self) -> tuple | None:
        return self.head[self.winner]

    def move(self, run: int, to: int) -> None:
        """Sets the winning run to position ``to`` and plays its path again."""
        self.at[run] = to
        self.head[run] = self.runs[run][to] if to < len(self.runs[run]) else None
        node, winner = (run + self.size) // 2, run
        while node:
            other = self.losers[node]
            if not self._before(winner, other):
                self.losers[node], winner = winner, other
            node //= 2
        self.winner = winner


def merge_runs(runs: list[list[tuple]], n: int) -> list[tuple]:
    """The first ``n`` distinct keys of each group (the key's first field) over all ``runs``."""
    tree, out, group, taken, last = LoserTree(runs), [], None, 0, None
    while (key := tree.top()) is not None:
        run = tree.winner
        if taken and key[0] == group:
            if taken >= n:
                # seek: no key of this group is wanted any more, in this run
                rows = runs[run]
                tree.move(run, bisect_left(rows, (group + "\0",), tree.at[run]))
                continue
        else:
            group, taken = key[0], 0
        if key != last:
            out.append(key)
            last, taken = key, taken + 1
        tree.move(run, tree.at[run] + 1)
    return out


def _keep_first(table: pa.Table, n: int) -> pa.Table:
    """``table`` sorted, without repeated rows, and cut to ``n`` rows a group."""
    table = table.take(pc.sort_indices(table, [("g", "ascending"), ("s", "descending"), (_FIRST, "ascending"), (_SECOND, "ascending"), (_THIRD, "ascending")])).combine_chunks()
    rows = table.num_rows
    if rows < 2:
        return table

    def changes(name: str) -> pa.Array:
        column = table[name]
        return pc.not_equal(column.slice(1).combine_chunks(), column.slice(0, rows - 1).combine_chunks())

    new_group = changes("g")
    new_row = new_group
    for name in ("s", _FIRST, _SECOND, _THIRD):
        new_row = pc.or_(new_row, changes(name))
    fresh = np.concatenate([[True], new_row.to_numpy(zero_copy_only=False)])
    starts = np.concatenate([[True], new_group.to_numpy(zero_copy_only=False)])[fresh]
    table = table.filter(pa.array(fresh))
    places = np.arange(len(starts))
    rank = places - np.maximum.accumulate(np.where(starts, places, 0))
    return table.filter(pa.array(rank < n))


def _make_runs(n: int, run_rows: int):
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        partition, number, held, rows = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            run = _keep_first(pa.Table.from_batches(held), n)
            run = run.append_column("run", pa.array([(partition << 24) + number] * run.num_rows, pa.int64()))
            yield from run.to_batches(max_chunksize=65_536)

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= run_rows:
                yield from flush()
                held, rows, number = [], 0, number + 1
        if rows:
            yield from flush()

    return runs


def _merge_buckets(n: int):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["g", "s", _FIRST, _SECOND, _THIRD]
        schema = None
        bucket, run, runs = None, None, []

        def done() -> pa.RecordBatch:
            keys = merge_runs(runs, n)
            columns = [[k[0] for k in keys], [-k[1] for k in keys]] + [[k[i] for k in keys] for i in (2, 3, 4)]
            return pa.RecordBatch.from_arrays([pa.array(v, schema.field(x).type) for v, x in zip(columns, names)], names)

        for batch in batches:
            schema = batch.schema
            g, s, a, b, c = (batch.column(x).to_pylist() for x in names)
            for row_bucket, row_run, key in zip(batch.column("bucket").to_pylist(), batch.column("run").to_pylist(), zip(g, [-x for x in s], a, b, c)):
                if row_bucket != bucket:
                    if runs:
                        yield done()
                    bucket, run, runs = row_bucket, None, []
                if row_run != run:
                    run = row_run
                    runs.append([])
                runs[-1].append(key)
        if runs:
            yield done()

    return merge


def top_n_per_group(df: DataFrame, group: Column, score: str, ties: list[str], n: int, run_rows: int = RUN_ROWS) -> DataFrame:
    """The ``n`` rows of each ``group`` with the highest ``score``; equal scores in ascending code-point order of ``ties``.

    ``group`` gives a string, ``score`` is a whole number, ``ties`` names one to three string columns.
    Returns ``group_key``, the score and the ties under their own names.

    Defined cases: a row with null group, score or tie is left out. Rows equal in group, score and
    ties count once. An empty string is a group like any other. A group of fewer than ``n`` rows
    comes out whole. An empty table gives an empty result. Other columns of ``df`` are never read.
    """
    if not 1 <= len(ties) <= 3:
        raise ValueError("one to three tie columns")
    if n < 1:
        raise ValueError("n must be at least 1")
    padded = [F.col(t).cast("string") for t in ties] + [F.lit("")] * (3 - len(ties))
    rows = df.select(group.cast("string").alias("g"), F.col(score).cast("long").alias("s"), *(c.alias(x) for c, x in zip(padded, (_FIRST, _SECOND, _THIRD))))
    rows = rows.where(" and ".join(f"{x} is not null" for x in ("g", "s", _FIRST, _SECOND, _THIRD)))
    layout = f"g string, s long, {_FIRST} string, {_SECOND} string, {_THIRD} string"
    runs = rows.mapInArrow(_make_runs(n, run_rows), layout + ", run long")
    # the bucket's bits differ from those that choose the partition, so each partition has all buckets
    bucketed = runs.withColumn("bucket", F.pmod(F.xxhash64("g"), F.lit(BUCKETS)).cast("int")).repartition("g")
    stored = bucketed.sortWithinPartitions("bucket", "run", "g", F.desc("s"), _FIRST, _SECOND, _THIRD)
    merged = stored.mapInArrow(_merge_buckets(n), layout)
    return merged.select(F.col("g").alias("group_key"), F.col("s").alias(score), *(F.col(x).alias(t) for x, t in zip((_FIRST, _SECOND, _THIRD), ties)))
