"""A typed stream of rows: a lazy DataFrame with its kind, order and what caps left out."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("symbols", "sites", "files", "records", "text")
#: text carries bytes and ends a pipeline.
TERMINAL = "text"


@dataclass(frozen=True)
class EvidenceFrame:
    df: DataFrame
    kind: str
    order: tuple[Column, ...] = ()
    group: str | None = None
    omitted: tuple[DataFrame, ...] = field(default=())
    note: str = ""

    def with_rows(self, df: DataFrame, **changes) -> EvidenceFrame:
        return replace(self, df=df, **changes)

    def left_out(self) -> int:
        """Rows that caps dropped, counted exactly when asked for."""
        return sum(d.agg(F.sum("n")).first()[0] or 0 for d in self.omitted)

    def ordered(self) -> DataFrame:
        return self.df.orderBy(*self.order) if self.order else self.df

    def public(self) -> DataFrame:
        """Without the columns that begin with an underscore."""
        return self.df.select(*[f"`{c}`" for c in self.df.columns if not c.startswith("_")])

    def census(self) -> DataFrame:
        """(group, n) of the current rows, once they are grouped."""
        return self.df.groupBy(F.col(self.group).cast("string").alias("group")).agg(F.count(F.lit(1)).alias("n"))

    def render(self, cap: int = 100) -> str:
        """The first rows as text, with the count of those not shown."""
        public = [c for c in self.df.columns if not c.startswith("_")]
        rows = self.ordered().select(*public).limit(cap).collect()
        total = self.df.count()
        head = "\t".join(public)
        body = ["\t".join("" if v is None else str(v) for v in r) for r in rows]
        gone = total - len(rows) + self.left_out()
        return "\n".join([head, *body, *([f"({gone} more rows: raise the cap or narrow the query)"] if gone else [])])
