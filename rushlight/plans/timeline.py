"""Ordered operators that stay distributed when one key holds most of the rows.

A plain window sends every row of a key to one task. ``Timeline.measure`` counts the largest
key first. While it fits, the plain window is used: one shuffle on the key. Beyond that the
order axis is cut at approximate row quantiles of the whole table, so no (key, block) group
is larger than its share of the table whatever the key skew, and each operator carries what
it needs over the block borders:

* ``number``   local row number plus the row count of the earlier blocks;
* ``rolling``  blocks by row number, with the frame's border rows copied to the next block;
* ``running``  local prefix combined with the totals of the earlier blocks.

The per-block tables have one row per key and block: rows / ``block_rows`` of the whole table at most.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rushlight.plans.sizing import key_sizes, rows_per_task


def axis_number(df: DataFrame, name: str) -> Column:
    """The order axis as a double, only used to place rows into blocks."""
    kind = df.schema[name].dataType.typeName()
    if kind in ("timestamp_ntz", "timestamp", "date"):
        return F.col(name).cast("timestamp").cast("double")
    return F.col(name).cast("double")


def join_keyed(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys where a null key is a key of its own."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(renamed, same, "left").drop(*[f"_right_{k}" for k in keys])


@dataclass(frozen=True)
class Timeline:
    keys: tuple[str, ...]
    axis: str
    ties: tuple[str, ...] = ()
    descending: bool = False
    splits: tuple[float, ...] = ()
    block_rows: int = 4_000_000

    @classmethod
    def measure(
        cls,
        df: DataFrame,
        keys: list[str],
        axis: str,
        ties: list[str] | None = None,
        descending: bool = False,
        limit: int | None = None,
    ) -> Timeline:
        limit = limit or rows_per_task(df.sparkSession)
        biggest, total = key_sizes(df, keys)
        splits: list[float] = []
        if biggest > limit:
            blocks = -(-total // limit)
            cuts = [i / blocks for i in range(1, blocks)]
            found = df.select(axis_number(df, axis).alias("x")).approxQuantile("x", cuts, 0.25 / blocks)
            splits = sorted({float(v) for v in found})
        return cls(tuple(keys), axis, tuple(ties or ()), descending, tuple(splits), limit)

    @property
    def fits(self) -> bool:
        """Every key was measured to fit one task."""
        return not self.splits

    def tied(self, *ties: str) -> Timeline:
        """Same blocks with other tie breakers, for subsets and unions of the measured rows."""
        return replace(self, ties=ties)

    def reversed(self) -> Timeline:
        """Same blocks, walked backwards along the axis; ties keep their own order."""
        return replace(self, descending=not self.descending)

    # -- ordering ---------------------------------------------------------------------
    def _order(self) -> list[Column]:
        head = F.col(self.axis).desc() if self.descending else F.col(self.axis).asc()
        return [head, *[F.col(t).asc() for t in self.ties]]

    def window(self, *extra: str):
        return Window.partitionBy(*self.keys, *extra).orderBy(*self._order())

    def _blocked(self, df: DataFrame) -> DataFrame:
        cut = Bucketizer(
            splits=[-float("inf"), *self.splits, float("inf")],
            inputCol="_axis",
            outputCol="_cut",
            handleInvalid="keep",
        )
        placed = cut.transform(df.withColumn("_axis", axis_number(df, self.axis)))
        block = F.col("_cut").cast("int")
        return placed.withColumn("_block", -block if self.descending else block).drop("_axis", "_cut")

    def _earlier(self):
        return (
            Window.partitionBy(*self.keys)
            .orderBy("_block")
            .rowsBetween(Window.unboundedPreceding, -1)
        )

    def _rejoin(self, left: DataFrame, blocks: DataFrame) -> DataFrame:
        return join_keyed(left, blocks, [*self.keys, "_block"])

    # -- operators --------------------------------------------------------------------
    def number(self, df: DataFrame, name: str = "rn") -> DataFrame:
        """Exact 1-based row number of every row within its key."""
        if not self.splits:
            return df.withColumn(name, F.row_number().over(self.window()).cast("long"))
        blocked = self._blocked(df)
        sizes = blocked.groupBy(*self.keys, "_block").agg(F.count(F.lit(1)).alias("_size"))
        offsets = sizes.select(
            *self.keys, "_block", F.coalesce(F.sum("_size").over(self._earlier()), F.lit(0)).alias("_offset")
        )
        local = blocked.withColumn("_local", F.row_number().over(self.window("_block")))
        return (
            self._rejoin(local, offsets)
            .withColumn(name, (F.col("_local") + F.col("_offset")).cast("long"))
            .drop("_local", "_offset", "_block")
        )

    def rolling(
        self, df: DataFrame, before: int, after: int, build: Callable[..., dict[str, Column]]
    ) -> DataFrame:
        """Add columns computed over a row frame.

        ``build(ordered, framed)`` receives the ordered window (for lag and lead within the
        frame's reach) and the framed one, and returns the new columns by name.
        """
        if not self.splits:
            ordered = self.window()
            made = build(ordered, ordered.rowsBetween(-before, after))
            return df.select("*", *[c.alias(n) for n, c in made.items()])
        size = max(self.block_rows, before + after + 1)
        numbered = self.number(df, "_rn")
        home = F.floor((F.col("_rn") - 1) / size)
        place = (F.col("_rn") - 1) % size
        parts = F.array_compact(
            F.array(home, F.when(place >= size - before, home + 1), F.when(place < after, home - 1))
        )
        spread = numbered.withColumn("_home", home).withColumn("_part", F.explode(parts))
        ordered = Window.partitionBy(*self.keys, "_part").orderBy("_rn")
        made = build(ordered, ordered.rowsBetween(-before, after))
        return (
            spread.select("*", *[c.alias(n) for n, c in made.items()])
            .filter(F.col("_part") == F.col("_home"))
            .drop("_home", "_part", "_rn")
        )

    def running(self, df: DataFrame, made: dict[str, tuple[str, Column]]) -> DataFrame:
        """Add inclusive running ``sum``, ``count``, ``min``, ``max`` or ``last`` (ignoring NULL)."""
        plain = {
            "sum": F.sum,
            "count": F.count,
            "min": F.min,
            "max": F.max,
            "last": lambda c: F.last(c, ignorenulls=True),
        }
        if not self.splits:
            upto = self.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
            return df.select("*", *[plain[kind](expr).over(upto).alias(n) for n, (kind, expr) in made.items()])

        blocked = self._blocked(df)
        upto = self.window("_block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        local = blocked.select(
            "*", *[plain[kind](expr).over(upto).alias(f"_in_{n}") for n, (kind, expr) in made.items()]
        )
        # the last non-null value of a block is the one whose position is greatest
        place = F.struct(
            (-F.col("_pos") if self.descending else F.col("_pos")).alias("p"),
            *[F.col(t).alias(f"t{i}") for i, t in enumerate(self.ties)],
        )
        blocked = blocked.withColumn("_pos", F.col(self.axis) if not self.descending else axis_number(df, self.axis))
        totals = blocked.groupBy(*self.keys, "_block").agg(
            *[
                (
                    F.max(F.when(expr.isNotNull(), F.struct(place.alias("k"), expr.alias("v")))).getField("v")
                    if kind == "last"
                    else plain[kind](expr)
                ).alias(f"_all_{n}")
                for n, (kind, expr) in made.items()
            ]
        )
        fold = dict(plain, count=F.sum)
        carried = totals.select(
            *self.keys,
            "_block",
            *[fold[kind](F.col(f"_all_{n}")).over(self._earlier()).alias(f"_to_{n}") for n, (kind, _) in made.items()],
        )
        joined = self._rejoin(local, carried)

        def merged(n: str, kind: str) -> Column:
            inside, before = F.col(f"_in_{n}"), F.col(f"_to_{n}")
            if kind in ("sum", "count"):
                return F.coalesce(inside + before, inside, before)
            if kind == "min":
                return F.least(inside, before)
            if kind == "max":
                return F.greatest(inside, before)
            return F.coalesce(inside, before)

        return joined.select(*df.columns, *[merged(n, kind).alias(n) for n, (kind, _) in made.items()])

    def islands(self, df: DataFrame, value: Column, name: str = "island") -> DataFrame:
        """Number the maximal runs of equal ``value`` along the timeline (gaps and islands)."""
        stepped = self.rolling(
            df.withColumn("_v", value),
            1,
            0,
            lambda ordered, framed: {
                "_step": F.when(
                    (F.row_number().over(ordered) > 1) & F.lag("_v").over(ordered).eqNullSafe(F.col("_v")), 0
                ).otherwise(1)
            },
        )
        return self.running(stepped, {name: ("sum", F.col("_step"))}).drop("_v", "_step")
