"""Named tables with the metadata the operators need.

A *collection* of the original model is a ``DataFrame`` bound to a name,
plus:

* ``order_key`` - the columns that stand in for insertion order (Spark has
  no row order; order-sensitive operators take this key and fail clearly
  without it),
* ``id_col`` - the record key column (``id`` in the original model),
* ``relations`` - foreign keys ``{field: (target_table, is_array)}``,
* ``unique`` - columns that no two rows share, if known (the groups of an aggregate).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

# The test tables' keys (see FIXTURES.md section 7).  The
# lineitem order key needs four columns to be unique.
TEST_TABLE_KEYS = {
    "region": (("r_regionkey",), "r_regionkey"),
    "nation": (("n_nationkey",), "n_nationkey"),
    "customer": (("c_custkey",), "c_custkey"),
    "supplier": (("s_suppkey",), "s_suppkey"),
    "part": (("p_partkey",), "p_partkey"),
    "orders": (("o_orderkey",), "o_orderkey"),
    "lineitem": (("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"), None),
    "events": (("event_id",), "event_id"),
    "documents": (("doc_id",), "doc_id"),
    "labels": (("doc_id",), "doc_id"),
    "conversations": (("conv_id", "turn"), None),
    "pages": (("page_id",), "page_id"),
    "benchmark": (("item_id",), "item_id"),
    "embeddings": (("vec_id",), "vec_id"),
}

# Foreign keys between the test tables.
TEST_TABLE_RELATIONS = {
    "nation": {"n_regionkey": ("region", False)},
    "customer": {"c_nationkey": ("nation", False)},
    "supplier": {"s_nationkey": ("nation", False)},
    "orders": {"o_custkey": ("customer", False)},
    "lineitem": {"l_orderkey": ("orders", False), "l_partkey": ("part", False),
                 "l_suppkey": ("supplier", False)},
    "labels": {"doc_id": ("documents", False)},
}

TEST_TABLES = tuple(TEST_TABLE_KEYS)


class CatalogError(ValueError):
    pass


def links(schema: dict) -> dict[str, tuple[str, bool]]:
    """Relations that a JSON Schema names: field -> (table, whether it is an array of keys)."""
    out = {}
    for name, spec in (schema.get("properties") or {}).items():
        items = spec.get("items") if isinstance(spec.get("items"), dict) else {}
        if spec.get("x-link-to"):
            out[name] = (spec["x-link-to"], False)
        elif items.get("x-link-to"):
            out[name] = (items["x-link-to"], True)
    return out


@dataclass
class TableInfo:
    name: str
    df: DataFrame
    order_key: tuple = ()
    id_col: str | None = None
    relations: dict = field(default_factory=dict)
    schema: dict | None = None  # JSON Schema of the rows
    unique: tuple = ()

    def with_df(self, df: DataFrame, **kw) -> "TableInfo":
        cols = set(df.columns)
        order_key = kw.pop("order_key", self.order_key)
        if order_key and not all(_top(c) in cols for c in _key_names(order_key)):
            order_key = ()
        id_col = kw.pop("id_col", self.id_col)
        if id_col and id_col not in cols:
            id_col = None
        rel = {k: v for k, v in kw.pop("relations", self.relations).items() if k in cols}
        schema = kw.pop("schema", self.schema if kw.get("name", self.name) == self.name else None)
        return TableInfo(kw.pop("name", self.name), df, tuple(order_key), id_col, rel, schema)


def _key_names(order_key):
    for k in order_key:
        yield k["field"] if isinstance(k, dict) else k


def _top(name: str) -> str:
    return name


class Catalog:
    """``name -> TableInfo``; duplicate registration is an error."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._tables: dict[str, TableInfo] = {}

    # -- registration -----------------------------------------------------
    def register(self, name: str, df: DataFrame, order_key=(), id_col=None,
                 relations=None, replace: bool = False, schema: dict | None = None) -> TableInfo:
        """``schema`` is a JSON Schema of the rows; without given ``relations`` its
        ``x-link-to`` keywords (of a field, or of an array's items) are the relations."""
        if name in self._tables and not replace:
            raise CatalogError(f"Collection {name!r} already exists")
        if isinstance(order_key, str):
            order_key = (order_key,)
        if id_col is None and "id" in df.columns:
            id_col = "id"
        if relations is None and schema:
            relations = links(schema)
        info = TableInfo(name, df, tuple(order_key), id_col, dict(relations or {}), schema)
        self._tables[name] = info
        return info

    def schema_of(self, name: str) -> dict | None:
        """The JSON Schema a table was registered with."""
        return self.info(name).schema

    def insert(self, name: str, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Append ``rows`` to a registered table: those its schema rejects, and keys that are there
        already, come back with their ``error`` (see ``operators/tables.py``); the table then holds the others."""
        from ..operators.tables import insert, split_valid

        info = self.info(name)
        good, bad = split_valid(rows, info.schema, prefix="data") if info.schema else (rows, None)
        grown, twice = insert(info.df, good, info.id_col, info.order_key)
        self._tables[name] = info.with_df(grown, name=name)
        if bad is None:
            return grown, twice
        kept = [c for c in twice.columns if c in bad.columns or c in ("error", "reason")]
        return grown, bad.drop("errors").unionByName(twice.select(*kept), allowMissingColumns=True)

    def put(self, info: TableInfo) -> None:
        self._tables[info.name] = info

    def has(self, name: str) -> bool:
        return name in self._tables

    def names(self) -> list[str]:
        return list(self._tables)

    def info(self, name: str) -> TableInfo:
        try:
            return self._tables[name]
        except KeyError:
            raise CatalogError(f"Collection {name!r} not found") from None

    def get(self, name: str) -> DataFrame:
        return self.info(name).df

    def drop(self, name: str) -> None:
        self._tables.pop(name, None)

    def drop_prefixed(self, *prefixes: str) -> list[str]:
        gone = [n for n in self._tables if n.startswith(prefixes)]
        for n in gone:
            del self._tables[n]
        return gone

    def reverse_relations(self, target: str) -> dict[str, tuple[str, str, bool]]:
        """Virtual fields on ``target`` named after the referencing tables.

        ``{referencing_table: (referencing_table, fk_field, is_array)}``;
        self references are skipped and the last foreign key wins when a table
        has two to the same target (as in the original model).
        """
        out = {}
        for name, info in self._tables.items():
            if name == target:
                continue
            for fk, (tgt, is_array) in info.relations.items():
                if tgt == target:
                    out[name] = (name, fk, is_array)
        return out

    # -- sources ------------------------------------------------------------
    def load_parquet_dir(self, sf_dir: str, names=TEST_TABLES) -> "Catalog":
        for n in names:
            keys, id_col = TEST_TABLE_KEYS.get(n, ((), None))
            df = self.spark.read.parquet(f"{sf_dir}/{n}.parquet")
            self.register(n, df, order_key=keys, id_col=id_col,
                          relations=TEST_TABLE_RELATIONS.get(n, {}), replace=True)
        return self


def test_catalog(spark: SparkSession, sf_dir: str, names=TEST_TABLES) -> Catalog:
    return Catalog(spark).load_parquet_dir(sf_dir, names)
