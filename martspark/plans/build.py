"""The warehouse build: raw, intermediate and mart tables written once, each from the layer below.

Tables are external: their files lie below the given path, and the catalog knows
them by layer and name. Questions read the tables and plan no fact table again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from martspark.plans import intermediate, marts, staging
from martspark.sources import tables, warehouse
from martspark.sources.tables import Tables


@dataclass(frozen=True)
class Warehouse:
    """A finished build. ``suffix`` keeps the schemas of several builds in one catalog apart."""

    spark: SparkSession
    path: str
    suffix: str

    def name(self, layer: str, table: str) -> str:
        return f"{layer}{self.suffix}.{table}"

    def table(self, layer: str, table: str) -> DataFrame:
        return self.spark.table(self.name(layer, table))

    def listed(self, layer: str, part: str = "") -> list[str]:
        return sorted(warehouse.tables_like(self.spark, f"{layer}{self.suffix}", part))


def build(t: Tables, path: str, suffix: str = "") -> Warehouse:
    """Write all layers of the tables behind ``t`` below ``path``."""
    spark = t.spark
    done = Warehouse(spark, path, suffix)
    warehouse.create_schemas(spark, tuple(f"{layer}{suffix}" for layer in ("raw", "intermediate", "mart")))

    def write(df: DataFrame, layer: str, name: str) -> DataFrame:
        return warehouse.materialise(df, f"{layer}{suffix}", name, f"{path}/{layer}/{name}")

    transactions = write(tables.transactions(t), "raw", "transactions")
    sales = write(tables.sales(t), "raw", "sales")
    staged, staged_sales = staging.transactions(transactions), staging.sales(sales)
    daily = write(intermediate.daily_store_sales(staged_sales), "intermediate", "daily_store_sales")
    write(marts.daily_demand(daily), "mart", "daily_demand")
    write(marts.executive_kpis(staged), "mart", "executive_kpis")
    write(marts.product_performance(staged), "mart", "product_performance")
    write(marts.store_dimension(staged_sales, daily), "mart", "dim_stores")
    return done
