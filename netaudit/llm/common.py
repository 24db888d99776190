"""Helpers shared by the training-data operators: shared scratch tables, joins of hot groups, components, table access."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of the query contracts: the space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A group is hot beyond one part in so many of all rows; so there are never more hot groups than this, and they may be broadcast.
HOT_PART = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where it is unset the
    warehouse on a cluster and a temporary folder in local mode."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or (sc._jsc.sc().getCheckpointDir().getOrElse(None) if sc._jsc.sc().getCheckpointDir().isDefined() else None)
    if not found:
        found = tempfile.mkdtemp(prefix="spark-") if sc.master.startswith("local[") or sc.master == "local" else spark.conf.get("spark.sql.warehouse.dir") + "/_scratch"
        sc.setCheckpointDir(found)
    return found


#: Where a run collects the paths of all tables that are written for it, if one wants that; see written().
_collected: list[list[str]] = []


@contextmanager
def written() -> Iterator[list[str]]:
    """The paths of the tables that are written meanwhile, so that the caller can delete those that nobody reads any more."""
    _collected.append([])
    try:
        yield _collected[-1]
    finally:
        _collected.pop()


def delete(spark: SparkSession, paths: list[str]) -> None:
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Tables in the shared folder that an operator writes for itself. The lineage ends at each, a lost executor costs nothing that was
    written, and later plans see real file sizes. drop() deletes one when its last reader is done, and close() all but those to stay."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{shared_dir(self.spark)}/table-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        for paths in _collected:
            paths.append(path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        delete(self.spark, [self.paths.pop(id(t))[0] for t in tables])

    def close(self, *stay: DataFrame) -> None:
        self.drop(*[t for _, t in list(self.paths.values()) if all(t is not s for s in stay)])


def materialize(df: DataFrame) -> DataFrame:
    """A written table that stays until the owner of the shared folder clears it."""
    return Scratch(df.sparkSession).write(df)


def quoted(names: list[str]) -> list[str]:
    """Column names of any characters, as select() and struct() take them."""
    return ["`" + c.replace("`", "``") + "`" for c in names]


def free(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores before it as it takes to differ from every column of df, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str) -> DataFrame:
    """Inner join of rows with groups, one row a key (never null), of which `size` is the number of rows. Groups of more than a part of all rows
    (HOT_PART) are fewer than that number, so they are broadcast, and their rows go on under salts; the others meet by a join on the key.
    Columns of groups other than the keys follow those of rows; their names differ from those."""
    least = (groups.agg(F.sum(size)).first()[0] or 0) / HOT_PART
    hot, cold, salt = free(rows, "_hot", "_cold", "_salt")
    rest = F.struct(*[c for c in groups.columns if c not in keys])
    met = rows.join(F.broadcast(groups.where(F.col(size) > least).select(*keys, rest.alias(hot))), keys, "left")
    met = met.withColumn(salt, F.when(F.col(hot).isNull(), 0).otherwise(1 + F.monotonically_increasing_id() % 1023).cast("int"))
    met = met.join(groups.where(F.col(size) <= least).select(*keys, F.lit(0).alias(salt), rest.alias(cold)), [*keys, salt], "left")
    got = F.coalesce(hot, cold)
    return met.where(got.isNotNull()).select(*quoted(rows.columns), *[got[c].alias(c) for c in groups.columns if c not in keys])


def row_hashes(id_col: str, text: Column) -> list[Column]:
    """r1 and r2, 128 bits that tell rows apart by id and text."""
    return [F.xxhash64(F.col(id_col), text).alias("r1"), F.xxhash64(F.lit(1), text, F.col(id_col)).alias("r2")]


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else. lower() is the fast way where a text is pure ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Connected components of edges(a, b), two columns of one comparable type, as (node, comp); comp is the
    smallest node reachable. Nodes without an edge don't appear.

    Alternates large-star and small-star steps, so the number of rounds grows with the logarithm of the longest path;
    each round is two aggregations with map-side minima and two joins, and ends in a written table. It ends when a round
    leaves the edges as they were, told by their number and two 64-bit exclusive-ors of their hashes. The last table is the scratch's."""
    mark = lambda e: tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a", F.lit(1)))).first())
    scratch = scratch or Scratch(edges.sparkSession)
    cur = scratch.write(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = mark(cur)
    while True:
        both = cur.select("a", "b").union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: every larger neighbour of a moves to the smallest node around a
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: the smaller neighbours of a, and a itself, move to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        new = scratch.write(small)
        scratch.drop(cur)
        after = mark(new)
        same, before, cur = after == before, after, new
        if same:
            return cur.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(cur.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
