"""Shared helpers: input normalisation, lineage cuts on shared storage, connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: ``spark.checkpoint.dir``. Where it is unset, a temporary one in local mode and an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="lexiloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that a lost executor never recomputes what stands above."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexiloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def join_hot(rows: DataFrame, table: DataFrame, keys: list[str], n: str) -> DataFrame:
    """``rows`` joined with ``table``, which has each of its keys once and the number ``n`` of their rows.

    Keys with over a thousandth of all those rows, of which there are under a thousand, are
    broadcast, so that no task gets all rows of a frequent key; the others are shuffled.
    Both sides are read several times: write them first.
    """
    total = table.agg(F.sum(n)).first()[0] or 0
    hot, cold = table.where(F.col(n) * 1000 > total), table.where(F.col(n) * 1000 <= total)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(rest.join(cold, keys))


def forget(df: DataFrame) -> None:
    """Delete the files of a :func:`materialise` result that no later plan reads."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


_SQL = {pa.int64(): "long", pa.float64(): "double", pa.string(): "string", pa.bool_(): "boolean"}


def from_texts(docs: DataFrame, kept: list[str], made: dict[str, pa.DataType], work: Callable[[], Callable[[str | None], Iterable]], rows: int = 1_000) -> DataFrame:
    """One row per input row: columns ``kept`` (longs, booleans or strings) as they are, and those ``made`` of its text.

    ``work()`` is called once a task and gives the function of a text that returns the
    values of a row. Kept columns never leave Arrow, so that long ids beside nulls stay as they are.
    """
    types = dict(docs.select(*kept).dtypes)
    ddl = [f"`{k}` {types[k]}" for k in kept] + [f"`{n}` {_SQL.get(t) or _nested(t)}" for n, t in made.items()]

    def run(batches):
        of = work()
        for whole in batches:
            for b in (whole.slice(i, rows) for i in range(0, whole.num_rows, rows)):
                values = [tuple(of(t.as_py())) for t in b.column("text")]
                columns = [pa.array([v[k] for v in values], t) for k, t in enumerate(made.values())]
                yield pa.RecordBatch.from_arrays([b.column(k) for k in kept] + columns, names=[*kept, *made])

    return docs.select(*kept, "text").mapInArrow(run, ", ".join(ddl))


def _nested(t: pa.DataType) -> str:
    if pa.types.is_list(t):
        return f"array<{_SQL.get(t.value_type) or _nested(t.value_type)}>"
    return "struct<" + ", ".join(f"{f.name}: {_SQL[f.type]}" for f in t) + ">"


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def lower_ascii(column: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def training_rows(doc_id: str = "doc_id") -> Column:
    """True for rows that may be learnt from: crc32 of the id as text isn't a multiple of 5."""
    return F.crc32(F.col(doc_id).cast("string")) % 5 != 0


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Edges (a, b) of longs to (node, component), the component being its smallest node.

    Alternates the large-star and small-star steps until the edge set no longer changes.
    Every step is an aggregation and an equi-join on a node; each round is written to the
    shared folder. Self-loops, repeated edges and an empty edge set are fine.
    """
    e = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    seen = None
    for _ in range(max_rounds):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = materialise(small, "cc")
        state = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        forget(e)
        e = new
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not converge")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
