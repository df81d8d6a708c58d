"""Joins that send rows out at once and correct them: a row without its partner goes out with nulls, and again when the partner comes.

The inputs and the result are keyed tables. A micro-batch merges its rows into the inputs, finds the rows whose key or
whose partners it touched, joins only these anew, and merges them into the result, whose changelog says what changed.
After every batch the result equals the join of all rows so far.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater import sinks


@dataclass(frozen=True)
class Side:
    """Partners by ``on``, columns that both sides have; of several with one key the latest by ``order``. ``how``: left, or inner."""

    on: list[str]
    order: list[str]
    how: str = "left"


@dataclass(frozen=True)
class UpdatingJoin:
    """Rows with one key, ``keys``, latest by ``order``, with their partners of each side, under the folder ``root``.

    No column but those of ``on`` may be both a row's and a side's. A ``deleted`` column (boolean) of rows or of a side
    removes what it keys: a row, or a partner. A row whose inner partner is missing is not part of the result.
    """

    root: str
    keys: list[str]
    order: list[str]
    sides: dict[str, Side] = field(default_factory=dict)
    parts: int = sinks.keyed.PARTS
    deleted: str = "deleted"

    def result(self, spark: SparkSession) -> DataFrame | None:
        """The result as it is now; None before its first row."""
        return sinks.read_keyed(spark, f"{self.root}/result")

    def changes(self, spark: SparkSession, after: int = -1) -> DataFrame | None:
        """What changed in the result, as rows with ``row_kind`` and ``commit``."""
        return sinks.read_changes(spark, f"{self.root}/result", after)

    def apply(self, rows: DataFrame, batch_id: int, **sides: DataFrame) -> None:
        """One micro-batch: new rows, and new partners by the name of their side. Run again with the same number, it changes nothing more."""
        spark = rows.sparkSession
        self._merge(rows, "rows", self.keys, self.order, batch_id)
        for name, side in self.sides.items():
            if name in sides:
                self._merge(sides[name], name, side.on, side.order, batch_id)
        held = sinks.read_keyed(spark, f"{self.root}/rows")
        marked, marks = held, []
        for n, (keys, batch) in enumerate([(self.keys, rows), *((s.on, sides[name]) for name, s in self.sides.items() if name in sides)]):
            seen = batch.select(*[F.col(k).alias(f"_k{n}_{i}") for i, k in enumerate(keys)]).distinct().withColumn(f"_m{n}", F.lit(True))
            marked = _join(marked, seen, [(k, f"_k{n}_{i}") for i, k in enumerate(keys)], "left")
            marks.append(F.coalesce(f"_m{n}", F.lit(False)))
        hit = marks[0]
        for m in marks[1:]:
            hit = hit | m
        touched = marked.filter(hit).select(*held.columns)
        joined = touched
        for n, (name, side) in enumerate(self.sides.items()):
            partners = sinks.read_keyed(spark, f"{self.root}/{name}")
            if partners is None:
                raise ValueError(f"the first batch must have rows, or an empty table, of the side {name}")
            partners = partners.select(*[F.col(k).alias(f"_p{n}_{i}") for i, k in enumerate(side.on)], *[c for c in partners.columns if c not in side.on])
            joined = _join(joined, partners, [(k, f"_p{n}_{i}") for i, k in enumerate(side.on)], side.how)
        # Keys that the batch touched and that have no row now: removed, or without an inner partner.
        keys = touched.select(*self.keys).unionByName(rows.select(*self.keys)).distinct().select(*[F.col(k).alias(f"_t{i}") for i, k in enumerate(self.keys)])
        found = _join(keys, joined.withColumn("_found", F.lit(True)), [(k, f"_t{i}") for i, k in enumerate(self.keys)], "left", drop=False)
        out = found.select(*[F.col(f"_t{i}").alias(k) for i, k in enumerate(self.keys)], *[c for c in joined.columns if c not in self.keys], F.col("_found").isNull().alias("_missing"))
        sinks.upsert(out, f"{self.root}/result", self.keys, [], "_missing", batch_id, parts=self.parts)

    def _merge(self, rows: DataFrame, name: str, keys: list[str], order: list[str], batch_id: int) -> None:
        sinks.create_table(rows.sparkSession, f"{self.root}/{name}", rows.drop(self.deleted).schema, self.parts)
        sinks.upsert(rows, f"{self.root}/{name}", keys, order, self.deleted if self.deleted in rows.columns else None, batch_id, parts=self.parts)


def _join(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], how: str, drop: bool = True) -> DataFrame:
    """A join by null-safe equality of differently named columns; the right's key columns go."""
    on = None
    for a, b in pairs:
        one = F.col(a).eqNullSafe(F.col(b))
        on = one if on is None else on & one
    return left.join(right, on, how).drop(*([b for _, b in pairs] if drop else []))
