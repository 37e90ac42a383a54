"""python -m termloom: fold a log, resolve utterances, look at a memory.

    fold LOG MEMORY            observations (a JSON line each) to memory tables
    resolve MEMORY IN OUT      utterances (scope, utt_id, asr, formatted; JSON lines) to rewritten text and decisions
    reindex MEMORY             recompute the phonetic keys
    status MEMORY              rows of each table
    reset MEMORY               drop the tables
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from termloom.operators import memory, resolve, trace
from termloom.sources import tables

UTTERANCE = "scope string, utt_id long, asr string, formatted string"
ARGUMENTS = {"fold": 2, "resolve": 3, "reindex": 1, "status": 1, "reset": 1}


def main(arguments: list[str]) -> int:
    command, *rest = arguments or [""]
    if ARGUMENTS.get(command) != len(rest):
        print(__doc__, file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("termloom").getOrCreate()
    if command == "fold":
        tables.write_memory(memory.fold(tables.observation_lines(spark, rest[0])), rest[1])
    elif command == "resolve":
        said = spark.read.schema(UTTERANCE).json(rest[1])
        tables.write_results(resolve.resolve(said, tables.read_memory(spark, rest[0])), rest[2])
    elif command == "reindex":
        memory.phonetic_keys(tables.read_memory(spark, rest[0]).surfaces).write.mode("overwrite").parquet(f"{rest[0]}/keys")
    elif command == "status":
        held = tables.read_memory(spark, rest[0])
        trace.table_stats({name: getattr(held, name) for name in tables.MEMORY_TABLES}).show(truncate=False)
    else:
        tables.remove_memory(spark, rest[0])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
