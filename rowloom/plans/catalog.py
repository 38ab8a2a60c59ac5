"""Tables, their total orders and their relations, by name."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Catalog:
    """Where programs find buffers. order: the columns of a table's total order, unique; relations: (child, parent) to pairs of columns."""

    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)
    order: dict[str, tuple[str, ...]] = field(default_factory=dict)
    relations: dict[tuple[str, str], tuple[tuple[str, str], ...]] = field(default_factory=dict)
    buffers: dict[str, str] = field(default_factory=dict)
    temps: set[str] = field(default_factory=set)

    def key(self, name: str) -> str:
        """The table that a name or buffer stands for."""
        return self.buffers.get(name.lower(), name.lower())

    def replace(self, name: str, df: DataFrame) -> None:
        """What a table holds from now on: a changed table is a new plan, nothing is written."""
        self.tables[self.key(name)] = df

    def table(self, name: str) -> DataFrame:
        key = self.buffers.get(name.lower(), name.lower())
        if key in self.tables:
            return self.tables[key]
        return self.spark.table(key)

    def order_of(self, name: str) -> tuple[str, ...]:
        """The declared order, else all columns: Spark tables have no order of their own."""
        key = self.buffers.get(name.lower(), name.lower())
        return self.order.get(key) or tuple(c for c, t in self.table(name).dtypes if not t.startswith("map"))

    def define_buffer(self, name: str, table: str) -> None:
        """A second name for a table."""
        self.buffers[name.lower()] = self.buffers.get(table.lower(), table.lower())

    def keys(self, child: str, parent: str) -> tuple[tuple[str, str], ...]:
        """Pairs (child column, parent column) of OF: a declared relation either way round, else shared column names."""
        c, p = (self.buffers.get(x.lower(), x.lower()) for x in (child, parent))
        if (c, p) in self.relations:
            return self.relations[c, p]
        if (p, c) in self.relations:
            return tuple((b, a) for a, b in self.relations[p, c])
        shared = [x for x in self.table(child).columns if x in set(self.table(parent).columns)]
        if not shared:
            raise LookupError(f"no relation between {child} and {parent}")
        return tuple((x, x) for x in shared)


#: Orders and relations of the star schema that the registered queries run on.
STAR_ORDER = {
    "region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",), "orders": ("o_orderkey",),
    "events": ("event_id",), "documents": ("doc_id",), "embeddings": ("vec_id",), "pages": ("page_id",), "benchmark": ("item_id",), "conversations": ("conv_id", "turn"), "labels": ("doc_id",),
}
STAR_RELATIONS = {
    ("nation", "region"): (("n_regionkey", "r_regionkey"),), ("customer", "nation"): (("c_nationkey", "n_nationkey"),), ("supplier", "nation"): (("s_nationkey", "n_nationkey"),),
    ("orders", "customer"): (("o_custkey", "c_custkey"),), ("lineitem", "orders"): (("l_orderkey", "o_orderkey"),), ("lineitem", "part"): (("l_partkey", "p_partkey"),),
    ("lineitem", "supplier"): (("l_suppkey", "s_suppkey"),), ("labels", "documents"): (("doc_id", "doc_id"),),
}


class _Lazy(dict):
    """Tables of a folder, read when first named."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__()
        self.spark, self.path = spark, path

    def __contains__(self, name) -> bool:
        return dict.__contains__(self, name) or name in STAR_ORDER or name == "lineitem"

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self.spark.read.parquet(f"{self.path}/{name}.parquet")
        return dict.__getitem__(self, name)


def star(spark: SparkSession, path: str) -> Catalog:
    """The catalog of a folder of the star schema's Parquet tables."""
    return Catalog(spark, _Lazy(spark, os.fspath(path)), dict(STAR_ORDER), dict(STAR_RELATIONS))
