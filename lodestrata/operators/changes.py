"""Changes of keyed tables: journals with undo, deletion of what loses its support, archives with new ids, rescans of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _row(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, F.struct(*[c for c in df.columns if c not in keys]).alias("_row"))


def journal(before: DataFrame, after: DataFrame, keys: list[str], run: int) -> DataFrame:
    """(keys, run, old, new): what a run changed in a table; old is null for a row that it added, new for one that it removed."""
    both = _row(before, keys).withColumnRenamed("_row", "old").join(_row(after, keys).withColumnRenamed("_row", "new"), keys, "full_outer")
    return both.where(~F.col("old").eqNullSafe(F.col("new"))).select(*keys, F.lit(run).cast("long").alias("run"), "old", "new")


def conflicts(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose row is no longer what the last of the runs in ``changes`` left: undoing would lose a later change."""
    last = changes.groupBy(*keys).agg(F.max_by(F.struct("new"), "run").alias("l"))
    return last.join(_row(table, keys), keys, "left").where(~F.col("l.new").eqNullSafe(F.col("_row"))).select(*keys)


def undo(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """The table before the runs in ``changes``; runs may overlap, and each key goes back to what it was before the first.

    Raises if a row has changed since, for instance by a later run that is not among them.
    """
    if conflicts(table, changes, keys).limit(1).count():
        raise ValueError("rows have changed since; undo the later runs with these")
    fields = [c for c in table.columns if c not in keys]
    first = changes.groupBy(*keys).agg(F.min_by(F.struct("old"), "run").alias("f"))
    back = first.where("f.old is not null").select(*keys, *[F.col(f"f.old.{c}").alias(c) for c in fields])
    return table.join(first.select(*keys), keys, "left_anti").unionByName(back.select(table.columns))


def delete_documents(edges: DataFrame, provenance: DataFrame, gone: DataFrame, keys: list[str], doc: str = "doc_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, provenance, tombstones) after documents are deleted.

    ``provenance`` has a row for each edge and document that supports it. Support from deleted documents
    goes; an edge that had some and has none left goes with it; one that never had any stays.
    ``support`` of an edge is set to the rows left. Edges that no deleted document supports are not
    counted anew.
    """
    out = gone.select(doc).distinct()
    touched = provenance.join(out, doc, "left_semi").select(*keys).distinct()
    left = provenance.join(out, doc, "left_anti")
    n = left.join(touched, keys, "left_semi").groupBy(*keys).agg(F.count("*").alias("_n"))
    kept = edges.join(touched, keys, "left_anti").unionByName(edges.join(n, keys).withColumn("support", F.col("_n")).drop("_n"))
    return kept, left, out.withColumn("deleted", F.lit(True))


def remapped(tables: dict[str, DataFrame], owned: dict[str, str], references: dict[str, list[tuple[str, str]]], salt: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables with ids of their own for another owner, and the map (table, old, new).

    ``owned`` names each table's id column; ``references`` lists, by table, (column, table it points
    to). New ids are hashes of table, old id and salt, so importing twice gives the same ids. A
    reference to a row that the archive lacks becomes null.
    """
    maps = {n: tables[n].select(F.col(c).alias("old")).where("old is not null").distinct().withColumn("new", F.sha2(F.concat_ws("|", F.lit(n), F.col("old").cast("string"), F.lit(salt)), 256).substr(1, 32)) for n, c in owned.items()}
    out = {}
    for name, df in tables.items():
        columns, x = df.columns, df
        for column, target in [*([(owned[name], name)] if name in owned else []), *references.get(name, [])]:
            m = maps[target].withColumnsRenamed({"old": column, "new": "_new"})
            x = x.join(m, column, "left").drop(column).withColumnRenamed("_new", column)
        out[name] = x.select(columns)
    every = [m.select(F.lit(n).alias("table"), F.col("old").cast("string").alias("old"), "new") for n, m in maps.items()]
    joined = every[0]
    for m in every[1:]:
        joined = joined.unionByName(m)
    return out, joined


def rescan(files: DataFrame, known: DataFrame) -> DataFrame:
    """(path, hash, state): files against the last scan by path and content: new, changed, unchanged or gone."""
    x = files.select("path", "hash").join(known.select("path", F.col("hash").alias("was")), "path", "full_outer")
    state = F.when(F.col("was").isNull(), "new").when(F.col("hash").isNull(), "gone").when(F.col("hash") == F.col("was"), "unchanged").otherwise("changed")
    return x.select("path", F.coalesce("hash", "was").alias("hash"), state.alias("state"))
