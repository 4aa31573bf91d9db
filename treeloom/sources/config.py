"""Cost models, aliases and tokenising strategy: small JSON files, read on the driver."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class CostModel:
    """Prices of edit operations. The two relabel prices fall back to ``relabel``."""

    insert: float = 1
    delete: float = 1
    relabel: float = 1
    relabel_structure: float | None = None
    relabel_content: float | None = None

    @classmethod
    def of(cls, costs: dict | CostModel | None) -> CostModel:
        """From a mapping; unknown keys such as comments are left aside."""
        if isinstance(costs, CostModel):
            return costs
        return cls(**{k: v for k, v in (costs or {}).items() if k in cls.__dataclass_fields__})

    def relabel_prices(self, algorithm: str) -> tuple[float, float]:
        """What a relabel costs: leaf to leaf, and otherwise."""
        if algorithm == "chawathe":
            return self.relabel, self.relabel
        return tuple(self.relabel if x is None else x for x in (self.relabel_content, self.relabel_structure))

    def shown(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if v is not None}


UNIT = CostModel()


def read_json(spark: SparkSession, path: str, default: dict | None = None) -> dict:
    """A small JSON object at any path that Spark reads; the default if there is none."""
    try:
        text = spark.read.text(path, wholetext=True).first()
    except Exception as e:
        if default is None or "PATH_NOT_FOUND" not in str(e):
            raise
        return default
    return json.loads(text[0]) if text else dict(default or {})


def load_costs(spark: SparkSession, path: str) -> CostModel:
    return CostModel.of(read_json(spark, path, {}))


def load_aliases(spark: SparkSession, path: str) -> dict[str, str]:
    return read_json(spark, path, {})


def load_strategy(spark: SparkSession, path: str) -> str:
    return read_json(spark, path, {}).get("strategy", "single_node")
