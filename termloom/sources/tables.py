"""Where tables come from and go: word lists, logs, cases, memories, traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termloom.operators.memory import OBSERVATION, Memory

CASE = (
    "id string, category string, description string, asr string, formatted string, expected string, expect_intervention boolean, "
    "rationale string, observations array<struct<kind:string,before:string,after:string,canonical:string,text:string,applied:string,"
    "reverted_to:string,entry_kind:string,context:string,status:string>>, skip_seed boolean, expect_status map<string,string>, known_hard boolean"
)
MEMORY_TABLES = ("entries", "surfaces", "keys", "context")


def common_words(spark: SparkSession, path: str) -> DataFrame:
    """A word list: a word a line, blanks and # comments skipped."""
    lines = spark.read.text(path).select(F.lower(F.trim("value")).alias("word"))
    return lines.where("word <> '' and not startswith(word, '#')").distinct()


def observations(spark: SparkSession, path: str, scope: str = "") -> DataFrame:
    """The ``observations`` array of a JSON document, or a file of one observation a line with a ``seq``."""
    fields = [f for f in T.StructType.fromDDL(OBSERVATION).fields if f.name not in ("scope", "seq")]
    inner = T.ArrayType(T.StructType(fields))
    doc = spark.read.schema(T.StructType([T.StructField("observations", inner)])).json(path, multiLine=True)
    rows = doc.select(F.posexplode("observations").alias("seq", "o")).select(F.lit(scope).alias("scope"), (F.col("seq") + 1).cast("long").alias("seq"), "o.*")
    return rows.select([f.name for f in T.StructType.fromDDL(OBSERVATION).fields])


def observation_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(OBSERVATION).json(path)


def append_observations(rows: DataFrame, path: str) -> None:
    """The log only grows."""
    rows.write.mode("append").json(path)


def cases(spark: SparkSession, pattern: str) -> DataFrame:
    """Labelled cases from JSON files that hold arrays."""
    return spark.read.schema(CASE).json(pattern, multiLine=True)


def case_log(cases_: DataFrame, seed: DataFrame) -> DataFrame:
    """Each case's own history: the seed unless it is skipped, then the case's observations; the case id is the scope."""
    columns = [f.name for f in T.StructType.fromDDL(OBSERVATION).fields]
    seeded = cases_.where(~F.coalesce("skip_seed", F.lit(False))).select(F.col("id").alias("case"))
    start = seed.agg(F.coalesce(F.max("seq"), F.lit(0))).scalar()
    told = seed.agg(F.collect_list(F.struct(*[c for c in columns if c != "scope"]))).scalar()  # the seed is a fixed file
    from_seed = seeded.select(F.col("case").alias("scope"), F.explode(told).alias("o")).select("scope", "o.*")
    own = cases_.select(F.col("id").alias("scope"), start.alias("last"), F.posexplode("observations").alias("at", "o"))
    own = own.select("scope", (F.col("last") + F.col("at") + 1).cast("long").alias("seq"), "o.*")
    return from_seed.select(columns).unionByName(own.select(columns))


def write_memory(memory: Memory, path: str) -> None:
    for name in MEMORY_TABLES:
        getattr(memory, name).write.mode("overwrite").parquet(f"{path}/{name}")


def read_memory(spark: SparkSession, path: str) -> Memory:
    return Memory(*(spark.read.parquet(f"{path}/{name}") for name in MEMORY_TABLES), stored=True)


def remove_memory(spark: SparkSession, path: str) -> None:
    for name in MEMORY_TABLES:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def append_trace(decisions: DataFrame, path: str) -> None:
    decisions.write.mode("append").parquet(path)


def write_results(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
