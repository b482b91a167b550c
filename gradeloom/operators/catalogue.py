"""The tables' keys, references and enumerations as data, and what follows from them: links, parents, children, owners."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import navigate


@dataclass(frozen=True)
class Table:
    key: tuple[str, ...]
    foreign: dict[str, tuple[str, str]] = field(default_factory=dict)
    enums: dict[str, tuple[str, ...]] = field(default_factory=dict)
    about: str = ""


#: The given tables.
TABLES = {
    "region": Table(("r_regionkey",), about="parts of the world"),
    "nation": Table(("n_nationkey",), {"n_regionkey": ("region", "r_regionkey")}, about="countries"),
    "customer": Table(("c_custkey",), {"c_nationkey": ("nation", "n_nationkey")}, about="documents"),
    "supplier": Table(("s_suppkey",), {"s_nationkey": ("nation", "n_nationkey")}, about="exam forms"),
    "part": Table(("p_partkey",), about="requirements"),
    "orders": Table(("o_orderkey",), {"o_custkey": ("customer", "c_custkey")}, {"o_orderstatus": ("F", "O", "P")}, "tasks"),
    "lineitem": Table(("l_orderkey", "l_linenumber"), {"l_orderkey": ("orders", "o_orderkey"), "l_partkey": ("part", "p_partkey"), "l_suppkey": ("supplier", "s_suppkey")}, {"l_returnflag": ("A", "N", "R"), "l_linestatus": ("F", "O")}, "versions of a task"),
}


def rows(spark: SparkSession) -> DataFrame:
    """table, column, role (key, foreign or enum), target of the catalogue."""
    out = []
    for name, table in TABLES.items():
        out += [(name, c, "key", None) for c in table.key]
        out += [(name, c, "foreign", f"{to}.{of}") for c, (to, of) in table.foreign.items()]
        out += [(name, c, "enum", ",".join(values)) for c, values in table.enums.items()]
    return spark.createDataFrame(out, "table string, column string, role string, target string")


def explained(columns: DataFrame) -> DataFrame:
    """columns (table, column) with what the catalogue says of them."""
    spark = columns.sparkSession
    about = spark.createDataFrame([(n, t.about) for n, t in TABLES.items()], "table string, about string")
    roles = rows(spark).groupBy("table", "column").agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"))
    return columns.join(roles, ["table", "column"], "left").join(about, "table", "left").withColumn("roles", F.coalesce("roles", F.lit("")))


def enum_values(check: Column) -> Column:
    """The values a check constraint lists; a range check has none."""
    values = F.regexp_extract_all(check, F.lit("'([^']*)'"), F.lit(1))
    return F.when(check.rlike(r"[<>]=?\s*'?\d|BETWEEN"), F.array().cast("array<string>")).otherwise(values)


def with_links(df: DataFrame, name: str) -> DataFrame:
    """df with link, the row's own address, and parents, the addresses its references point to."""
    table = TABLES[name]
    own = F.concat_ws("/", F.lit(name), *[F.col(k).cast("string") for k in table.key])
    parents = F.filter(F.array(*[F.when(F.col(c).isNotNull(), F.concat_ws("/", F.lit(to), F.col(c).cast("string"))) for c, (to, _) in table.foreign.items()], F.lit(None).cast("string")), lambda x: x.isNotNull())
    return df.withColumn("link", own).withColumn("parents", parents)


def references_to(name: str) -> list[tuple[str, str]]:
    """(table, column) of all references to a table."""
    return [(other, c) for other, t in TABLES.items() for c, (to, _) in t.foreign.items() if to == name]


def children(tables: dict[str, DataFrame], name: str, most: int = 8) -> DataFrame:
    """table, parent, n_children, preview: of each row of a table that others refer to, for each reference."""
    out = None
    for other, column in references_to(name):
        keys = list(TABLES[other].key)
        one = navigate.children_preview(tables[other].withColumn("_shown", F.concat_ws("/", *[F.col(k).cast("string") for k in keys])), column, keys, "_shown", most)
        one = one.where(F.col(column).isNotNull()).select(F.lit(other).alias("table"), F.col(column).cast("string").alias("parent"), "n_children", "preview")
        out = one if out is None else out.unionByName(one)
    return out


def path_to(name: str, owner: str) -> list[tuple[str, str, str]] | None:
    """The references (column, table, key) from a table to its owner, the shortest way."""
    todo: list[tuple[str, list[tuple[str, str, str]]]] = [(name, [])]
    seen = {name}
    while todo:
        at, path = todo.pop(0)
        if at == owner:
            return path
        for column, (to, key) in TABLES[at].foreign.items():
            if to not in seen:
                seen.add(to)
                todo.append((to, [*path, (column, to, key)]))
    return None


def owned(tables: dict[str, DataFrame], name: str, owner: str) -> DataFrame:
    """A table's rows with _owner, the key of the owner they belong to."""
    path = path_to(name, owner)
    if path is None:
        raise ValueError(f"{name} belongs to no {owner}")
    df, last = tables[name], F.col(TABLES[name].key[0])
    for column, to, key in path[:-1]:
        df = df.join(tables[to], F.col(column) == F.col(key))
        last = F.col(key)
    if path:
        last = F.col(path[-1][0])
    return df.withColumn("_owner", last)


def cell(value: Column, kind: str, most: int = 80) -> Column:
    """A value as a table shows it: NULL, true or false, JSON, ISO dates, clipped texts."""
    text = F.to_json(value) if kind.startswith(("struct", "array", "map")) else F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss") if kind.startswith("timestamp") else value.cast("string")
    return F.coalesce(F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text), F.lit("NULL"))


def cell_kind(value: Column, name: str, column: str, kind: str) -> Column:
    """How a cell is shown: null, parent, json, status or plain."""
    table = TABLES[name]
    shown = "parent" if column in table.foreign else "json" if kind.startswith(("struct", "array", "map")) else "status" if column in table.enums else "plain"
    return F.when(value.isNull(), "null").otherwise(shown)


def summary(*columns: str) -> Column:
    """column=value of all that isn't null, joined by a middle dot."""
    return F.concat_ws(" · ", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in columns])


def untouched(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """column, untouched, total: how many rows still have the value that a column begins with; one pass for all."""
    counts = df.agg(F.count(F.lit(1)).alias("_total"), *[F.count_if(c).alias(n) for n, c in conditions.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("column"), F.col(n).alias("untouched"), F.col("_total").alias("total")) for n in conditions])).alias("x")).select("x.*")


def migration_status(applied: DataFrame, files: DataFrame) -> DataFrame:
    """version, state of both tables (version, hash): applied, missing (not applied yet), changed (after it was applied), gone."""
    a, f = applied.select("version", F.col("hash").alias("_a")), files.select("version", F.col("hash").alias("_f"))
    state = F.when(F.col("_a").isNull(), "missing").when(F.col("_f").isNull(), "gone").when(F.col("_a") != F.col("_f"), "changed").otherwise("applied")
    return a.join(f, "version", "full").select("version", state.alias("state"))
