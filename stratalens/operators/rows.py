"""Row order: first rows, contiguous numbers, batches, repeatable shuffles."""

from __future__ import annotations

import math
import zlib
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from stratalens.session import save_shared


#: So many first rows a task may hold.
FEW = 10_000


def first_n(df: DataFrame, order: Sequence[str], n: int, strict: bool = False, few: int = FEW) -> DataFrame:
    """The first ``n`` rows by ``order``; ``strict`` fails when the table is shorter.

    Up to ``few`` rows are kept and merged by the tasks. For more, the keys
    alone are numbered over many tasks, which gives the n-th key, and a filter
    on it takes the rows where they are: no task holds more than its share.
    Of rows with the n-th key as many are taken as are missing.
    """
    if strict and df.select(*order).limit(n).count() < n:
        raise ValueError(f"fewer than {n} rows")
    if n <= few:
        return df.orderBy(*order).limit(n)
    row = free_name(df, "_row")
    numbered = enumerate_rows(df.select(*order), order, name=row)
    found = numbered.where(F.col(row) == n - 1).first()
    if found is None:
        return df
    last = [F.lit(found[name]).cast(df.schema[name].dataType) for name in order]
    same = [F.col(name).eqNullSafe(value) for name, value in zip(order, last)]
    before, equal = F.lit(False), F.lit(True)
    for name, value, own in zip(order, last, same):
        less = F.col(name).isNull() & value.isNotNull() | F.coalesce(F.col(name) < value, F.lit(False))  # NULLs come first
        before, equal = before | (equal & less), equal & own
    missing = n - df.where(before).count()
    return df.where(before).unionByName(df.where(equal).limit(missing))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (Spark compares names without case)."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def enumerate_rows(
    df: DataFrame, order: Sequence[str], within: Sequence[str] = (), name: str = "row_idx"
) -> DataFrame:
    """Contiguous numbers from 0 by ``order``, restarting for every ``within`` key.

    ``within`` and ``order`` together must be unique. Rows are range-partitioned
    and sorted, so a hot key spreads over many tasks. The placed rows are stored
    once, because a range shuffle computed twice may cut elsewhere; then only
    the row count of each partition (and key) is summed up and joined back.
    Pass narrow rows: project to the keys and join wide columns afterwards.
    """
    keys = [*within, *order]
    slot, part, first, size = (free_name(df, own) for own in ("_slot", "_part", "_first", "_rows"))
    placed = save_shared(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn(slot, F.monotonically_increasing_id()),
        "placed",
    ).withColumn(part, F.shiftright(slot, 33))
    spans = placed.groupBy(*within, part).agg(F.min(slot).alias(first), F.count("*").alias(size))
    # One row per partition and key: the window holds at most as many rows per key as there are partitions.
    earlier = (
        Window.partitionBy(*(within or [F.lit(0)]))
        .orderBy(part)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    shift = (F.coalesce(F.sum(size).over(earlier), F.lit(0)) - F.col(first)).alias("_shift")
    shifts = spans.select(*[F.col(key).alias(f"_r{i}") for i, key in enumerate([*within, part])], shift)
    if not within:
        shifts = F.broadcast(shifts)  # at most one row per range partition
    same = [placed[key].eqNullSafe(shifts[f"_r{i}"]) for i, key in enumerate([*within, part])]
    return placed.join(shifts, reduce(lambda a, b: a & b, same)).select(
        *[placed[column] for column in df.columns], (placed[slot] + shifts["_shift"]).alias(name)
    )


def assign_batches(
    keys: DataFrame, order: Sequence[str], batch_size: int, full_only: bool = False
) -> DataFrame:
    """``keys`` with ``row_idx`` and ``batch_id``; ``full_only`` drops a short last batch."""
    numbered = enumerate_rows(keys, order)
    if full_only:
        total = numbered.count()  # of the stored table, not of the input again
        numbered = numbered.where(F.col("row_idx") < total - total % batch_size)
    return numbered.withColumn("batch_id", F.floor(F.col("row_idx") / batch_size))


def shuffle_key(key: Column, seed: int) -> Column:
    """A repeatable pseudo-random sort key: the same whichever task computes it."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def shuffle_rows(df: DataFrame, key: str, seed: int) -> DataFrame:
    """All rows in a repeatable random order."""
    return df.orderBy(shuffle_key(F.col(key), seed), key)


@dataclass(frozen=True)
class Permutation:
    """A pseudo-random order of the numbers 0 to ``n`` - 1 for each epoch, known at every place without sorting.

    A number is a pair of coordinates below ``left`` and ``right``, whose product is ``n``
    or a little more. Four rounds add to each coordinate a hash of the
    other one (a Feistel network), so the order can be followed both ways. A
    number that leaves the range goes through the network again until it is
    back (cycle walking); fewer than ``left`` numbers lie outside.
    """

    n: int
    seed: int = 0

    #: Fixed: rounds, and the factors, mask and shift of the hash, whose products fit a long.
    ROUNDS = 4
    FACTORS = (1103515245, 1540483477)
    MASK = (1 << 31) - 1
    SHIFT = 11

    @property
    def left(self) -> int:
        return max(math.isqrt(max(self.n - 1, 0)) + 1, 1)

    @property
    def right(self) -> int:
        return max(-(-self.n // self.left), 1)

    def keys(self, epoch: int) -> list[int]:
        """A key for each half round."""
        return [zlib.crc32(f"{self.seed}:{epoch}:{k}".encode()) & self.MASK for k in range(2 * self.ROUNDS)]

    def _hash(self, x, key):
        """Of a number or of a column."""
        if isinstance(x, Column):
            mask, halve = (lambda v: v.bitwiseAND(F.lit(self.MASK).cast("long"))), (lambda v: F.shiftright(v, self.SHIFT))
        else:
            mask, halve = (lambda v: v & self.MASK), (lambda v: v >> self.SHIFT)
        first, second = self.FACTORS
        return mask(halve(mask(mask(x + key) * first)) * second)

    def _once(self, number: int, keys: list[int]) -> int:
        x, y = divmod(number, self.right)
        for k in range(0, len(keys), 2):
            x = (x + self._hash(y, keys[k])) % self.left
            y = (y + self._hash(x, keys[k + 1])) % self.right
        return x * self.right + y

    def place_of(self, row: int, epoch: int) -> int:
        """Where a row stands in an epoch."""
        keys, number = self.keys(epoch), self._once(row, self.keys(epoch))
        while number >= self.n:
            number = self._once(number, keys)
        return number

    def row_at(self, place: int, epoch: int) -> int:
        """The row at a place of an epoch's order."""
        keys, number = self.keys(epoch), place
        while True:
            x, y = divmod(number, self.right)
            for k in range(len(keys) - 2, -1, -2):
                y = (y - self._hash(x, keys[k + 1])) % self.right
                x = (x - self._hash(y, keys[k])) % self.left
            number = x * self.right + y
            if number < self.n:
                return number

    def with_places(self, numbered: DataFrame, epoch: int, row: str = "row_idx", name: str = "place") -> DataFrame:
        """``numbered`` (every number from 0 below ``n`` at most once) with its place in the epoch; no shuffle.

        Numbers that leave the range meet a table of where they come back,
        which has fewer rows than the square root of ``n`` and one.
        """
        keys, after = self.keys(epoch), free_name(numbered, "_after")
        pairs = [F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in zip(keys[::2], keys[1::2])]
        start = F.struct(F.expr(f"`{row}` div {self.right}").alias("x"), (F.col(row).cast("long") % self.right).alias("y"))

        def half_rounds(s: Column, key: Column) -> Column:
            x = (s["x"] + self._hash(s["y"], key["a"])) % self.left
            return F.struct(x.alias("x"), ((s["y"] + self._hash(x, key["b"])) % self.right).alias("y"))

        found = F.aggregate(F.array(*pairs), start, half_rounds, lambda s: s["x"] * self.right + s["y"])
        moved = numbered.withColumn(after, found)
        outside = []
        for number in range(self.n, self.left * self.right) if self.n else ():
            place = self._once(number, keys)
            while place >= self.n and place != number:
                place = self._once(place, keys)
            if place != number:  # else no row leads to it
                outside.append((number, place))
        if not outside:
            return moved.withColumnRenamed(after, name)
        back = numbered.sparkSession.createDataFrame(outside, f"{after} long, _back long")
        moved = moved.join(F.broadcast(back), after, "left")
        return moved.select(*numbered.columns, F.coalesce("_back", after).alias(name))
