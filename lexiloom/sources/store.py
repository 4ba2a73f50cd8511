"""Tables on disk: JSON lines, parts, the lexicon with its meta row, benchmark releases."""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lexicon import Lexicon, provenance_counts
from ..schemas import DECLARATION, PAIR, PREDICTION, TASK

#: Raise it when what a build gives changes; indexes of another version are stale.
VERSION = 3
TABLES = ("rows", "idf", "postings", "norms", "translations")
_SCHEMAS = {"declarations": DECLARATION, "pairs": PAIR, "tasks": TASK, "predictions": PREDICTION}


def read_lines(spark: SparkSession, path: str, kind: str, skip_malformed: bool = False) -> DataFrame:
    """JSON lines of a known kind (declarations, pairs, tasks, predictions); a malformed line fails the read unless it may be skipped."""
    return spark.read.schema(_SCHEMAS[kind]).option("mode", "DROPMALFORMED" if skip_malformed else "FAILFAST").json(path)


def write_lines(rows: DataFrame, path: str) -> int:
    rows.write.mode("overwrite").json(path)
    return rows.sparkSession.read.text(path).count()


def combine(parts: list[DataFrame]) -> DataFrame:
    """All rows of all parts, repeats kept; columns that a part lacks are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def work_folder(spark: SparkSession) -> str:
    """A folder for tables of this session that every executor sees: in ``spark.checkpoint.dir``; a temporary one in local mode where that is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if spark.sparkContext.applicationId not in _folders:
            _folders[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="lexiloom-")
            atexit.register(shutil.rmtree, _folders[spark.sparkContext.applicationId], True)
        path = _folders[spark.sparkContext.applicationId]
    return f"{path.rstrip('/')}/{spark.sparkContext.applicationId}"


_folders: dict[str, str] = {}


def once(spark: SparkSession, key: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table of this session, written when it is first asked for."""
    path = f"{work_folder(spark)}/{hashlib.md5(key.encode()).hexdigest()}"
    if not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def settled(rows: DataFrame) -> DataFrame:
    """``rows`` written to the session's folder and read back: what reads them several times neither works them out anew nor carries their plan along."""
    path = f"{work_folder(rows.sparkSession)}/{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def ground_truth(spark: SparkSession, folder: str, file: str = "environment.jsonl") -> DataFrame | None:
    """(name, module) of an elaborated dump, malformed lines left out; None if there is none."""
    path = f"{folder.rstrip('/')}/{file}"
    if not exists(spark, path):
        return None
    return spark.read.schema("name string, module string").option("mode", "DROPMALFORMED").json(path).where("name is not null")


def save(lexicon: Lexicon, path: str, truth_size: int = 0, outcomes: DataFrame | None = None, held: DataFrame | None = None, unlearned: DataFrame | None = None) -> Lexicon:
    """Write all tables and the meta row, postings by field, and read them back."""
    spark = lexicon.rows.sparkSession
    for t in TABLES:
        w = getattr(lexicon, t).write.mode("overwrite")
        (w.partitionBy("field") if t == "postings" else w).parquet(f"{path}/{t}")
    for name, rows in (("holdout", held), ("unlearned", unlearned)):
        if rows is not None:
            rows.drop("tokens").write.mode("overwrite").json(f"{path}/{name}")
    done = load(spark, path)
    as_map = lambda d, k: d.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(k, "n")))).alias("m")).first()["m"]
    meta = {
        "n_decls": done.rows.count(), "n_holdout": held.count() if held is not None else 0, "n_pmi_holdout": unlearned.count() if unlearned is not None else 0,
        "n_tokens": done.idf.count(), "n_trans_words": done.translations.select("word").distinct().count(), "provenance": as_map(provenance_counts(done.rows), "provenance"),
        "to_additive": as_map(outcomes, "outcome") if outcomes is not None else {}, "ground_truth_decls": truth_size, "index_version": VERSION,
    }
    schema = "n_decls long, n_holdout long, n_pmi_holdout long, n_tokens long, n_trans_words long, provenance map<string,long>, to_additive map<string,long>, ground_truth_decls long, index_version int"
    spark.createDataFrame([tuple(meta.values())], schema).coalesce(1).write.mode("overwrite").json(f"{path}/meta")
    return done


def load(spark: SparkSession, path: str) -> Lexicon:
    return Lexicon(**{t: spark.read.parquet(f"{path}/{t}") for t in TABLES})


def is_stale(has_index, has_meta, version, truth_decls, truth_size):
    """Whether an index must be built anew, as a condition on columns: none, without meta, of another version, or built with another truth."""
    return ~has_index | ~has_meta | (F.coalesce(version, F.lit(1)) != VERSION) | ((truth_size > 0) & (F.coalesce(truth_decls, F.lit(0)) != truth_size))


def needs_build(spark: SparkSession, path: str, truth_size: int = 0) -> bool:
    if not exists(spark, f"{path}/rows") or not exists(spark, f"{path}/meta"):
        return True
    m = spark.read.schema("index_version int, ground_truth_decls long").json(f"{path}/meta")
    return m.select(is_stale(F.lit(True), F.lit(True), F.col("index_version"), F.col("ground_truth_decls"), F.lit(truth_size)).alias("s")).first()["s"]


def release(tasks: DataFrame, path: str) -> DataFrame:
    """Write benchmark tasks as JSON lines, and a card of their numbers; gives (arm, n)."""
    tasks.write.mode("overwrite").json(f"{path}/tasks")
    counts = tasks.sparkSession.read.schema(TASK).json(f"{path}/tasks").groupBy("arm").agg(F.count("*").alias("n"))
    card = counts.select(F.format_string("%s: %d tasks; score with lexiloom.operators.calibrate.score_predictions", "arm", "n").alias("value"))
    card.coalesce(1).write.mode("overwrite").text(f"{path}/card")
    return counts
