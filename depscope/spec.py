"""Dependencies X1, ..., Xk -> Y as values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

#: Joins the left-hand columns in a text; no column name may contain it.
LHS_JOIN = "|"


@dataclass(frozen=True)
class FDSpec:
    """A candidate dependency. ``fd_id`` names it in results; by default it is its text."""

    lhs: tuple[str, ...]
    rhs: str
    name: str = ""

    def __post_init__(self):
        object.__setattr__(self, "lhs", tuple(self.lhs))
        if not self.lhs:
            raise ValueError("a dependency needs a left-hand column")

    @property
    def fd_id(self) -> str:
        return self.name or str(self)

    def __str__(self) -> str:
        return f"{LHS_JOIN.join(self.lhs)} -> {self.rhs}"

    @classmethod
    def parse(cls, lhs: str, rhs: str) -> FDSpec:
        """From a left-hand side written as ``a|b|c``."""
        return cls(tuple(c.strip() for c in lhs.split(LHS_JOIN)), rhs.strip())

    def check(self, df: DataFrame) -> None:
        """Raise ValueError if a column is missing."""
        missing = [c for c in (*self.lhs, self.rhs) if c not in df.columns]
        if missing:
            raise ValueError(f"{self}: no column {', '.join(missing)}; there are {', '.join(df.columns)}")
