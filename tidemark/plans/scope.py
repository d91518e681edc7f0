"""Which rows an evaluation covers: typed predicates that Spark pushes to the source, with an identity that travels with results."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREDICATES = ("equals", "not_equals", "in", "range", "time_range", "is_null", "not_null")


@dataclass(frozen=True)
class Predicate:
    kind: str
    field: str
    values: tuple[str, ...] = ()

    def column(self, df: DataFrame) -> Column:
        """The predicate over df; literals are cast to the field's type, and one that does not fit is an error."""
        if self.kind not in PREDICATES:
            raise ValueError(f"no predicate {self.kind!r}")
        c, kind = F.col(self.field), df.schema[self.field].dataType
        typed = [F.lit(v).cast(kind) for v in self.values]
        if self.kind in ("range", "time_range"):
            low, high = df.sparkSession.range(1).select(*[F.lit(v).cast(kind).alias(n) for n, v in zip("lh", self.values)]).first()
            if low > high:
                raise ValueError(f"{self.field}: the range's bounds are reversed")
            return c.between(*typed)
        return {"equals": lambda: c == typed[0], "not_equals": lambda: c != typed[0], "in": lambda: c.isin(*typed), "is_null": c.isNull, "not_null": c.isNotNull}[self.kind]()


@dataclass(frozen=True)
class Scope:
    scope_id: str = "full"
    predicates: tuple[Predicate, ...] = ()

    def digest(self) -> str:
        said = sorted(json.dumps([p.kind, p.field, sorted(p.values) if p.kind == "in" else p.values]) for p in self.predicates)
        return hashlib.sha256(json.dumps([self.scope_id, said]).encode()).hexdigest()

    def apply(self, df: DataFrame) -> DataFrame:
        for p in self.predicates:
            df = df.where(p.column(df))
        return df
