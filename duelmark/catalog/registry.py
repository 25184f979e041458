"""Registry of named queries over the given tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from duelmark.catalog.fixtures import CTES, Tables
from duelmark.session import configure


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None
    round_cols: tuple[str, ...]
    digits: int

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build(Tables(configure(spark), sf_dir))
        # the nudge keeps exact ties on one side although sums differ in their last bits;
        # +0.0 turns -0.0 into 0.0
        return df.withColumns({c: F.round(F.col(c).cast("double") + F.lit(self.nudge), self.digits) + F.lit(0.0)
                               for c in self.round_cols})

    @property
    def nudge(self) -> float:
        return 10.0 ** -(self.digits + 3)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        body = self.sql.strip()
        if self.round_cols:
            fixed = ", ".join(f"round(CAST({c} AS DOUBLE) + {self.nudge}, {self.digits}) + 0.0 AS {c}" for c in self.round_cols)
            body = f"SELECT * REPLACE ({fixed}) FROM (\n{body}\n) AS q"
        return with_ctes(body)


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None, floats: str = "", digits: int = 6):
    """Register a query; ``floats`` lists double columns rounded on both sides."""
    def add(build):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, build, sql, tuple(floats.split()), digits)
        return build
    return add


def with_ctes(body: str) -> str:
    """Prefix the shared views that the statement uses, in dependency order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for cte, sql in CTES.items():
            if "{" + cte + "}" in text and cte not in needed:
                visit(sql)
                needed.append(cte)

    visit(body)

    def plain(text: str) -> str:
        for cte in CTES:
            text = text.replace("{" + cte + "}", cte)
        return text

    views = ",\n".join(f"{cte} AS ({plain(CTES[cte]).strip()})" for cte in needed)
    text = plain(body)
    if not views:
        return text
    # a statement with its own views continues the list
    return f"WITH {views},\n{text[5:]}" if text[:5].upper() == "WITH " else f"WITH {views}\n{text}"
