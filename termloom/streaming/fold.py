"""The fold as a stream: observations in, the state of touched entries out.

Usage observations touch every entry that sounds like one of their words, so a stream is keyed
by (scope, sound): an entry's events all carry the sound of its name.  Corrections, additions
and reverts know their sound, and so do manual overrides; a usage is copied to each of its words'
sounds.  The state of a sound is its entries' counters and their heaviest context terms.  A deleted
entry comes out once more, with the status ``deleted``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.functions import phonetics, text
from termloom.operators.memory import CONTEXT_TERMS, PINNED_CONFIDENCE, PROMOTION, SUPPRESSION, checked

OUT = "scope string, entry_id long, canonical string, kind string, status string, confidence double, protected boolean, confirmations long, contradictions long, context string"


def keyed(observations: DataFrame) -> DataFrame:
    """(scope, sound, seq, effect, name, kind, status, terms) of valid observations; ``terms`` have their own sounds."""
    log = checked(observations).where("problem is null")
    name = F.when(F.col("kind") == "correction", F.col("after")).when(F.col("kind") == "revert", F.col("applied")).otherwise(F.col("canonical"))
    said = F.when(F.col("kind") == "usage", F.col("text")).when(F.col("kind") == "correction", F.coalesce("context", F.lit(""))).otherwise(F.lit(""))
    words = F.transform(text.content_words(said), lambda w: F.struct(w.alias("term"), phonetics.strict(w).alias("sound")))
    effect = F.when(F.col("kind") == "correction", "confirm").when(F.col("kind") == "dictionary_add", "add").when(F.col("kind") == "usage", "use").otherwise(F.col("kind"))
    rows = log.select("scope", "seq", effect.alias("effect"), name.alias("name"), F.col("entry_kind").alias("kind"), "status", words.alias("terms"))
    sounds = F.when(F.col("effect") == "use", F.array_distinct(F.transform("terms", lambda t: t["sound"]))).otherwise(F.array(phonetics.strict(F.col("name"))))
    return rows.withColumn("sound", F.explode(sounds)).where((F.col("effect") != "use") | (F.col("sound") != ""))


def step(entries: dict[str, dict], events: pd.DataFrame, sound: str) -> list[dict]:
    """Fold events, in the order of ``seq``, into entries by lower-case name; the entries touched, deleted ones too."""
    touched = {}
    for e in events.sort_values("seq").itertuples(index=False):
        key = (e.name or "").lower()
        if e.effect in ("confirm", "add"):
            fresh = {"id": int(e.seq), "canonical": e.name, "kind": e.kind, "yes": 0, "no": 0, "pinned": False, "judged": False, "forced": None, "context": {}}
            own = entries.setdefault(key, fresh)
            hit = [own]
            if e.effect == "add":
                own["yes"], own["pinned"] = max(own["yes"], PROMOTION), True
            else:
                own["yes"] += 1
        elif e.effect == "use":
            hit = list(entries.values())
            for own in hit:
                own["yes"] += 1
        else:
            hit = [entries[key]] if key in entries else []
            for own in hit:
                if e.effect == "revert":
                    own["no"] += 1
                elif e.effect == "delete":
                    own["forced"] = "deleted"
                    del entries[key]
                elif e.effect == "force":
                    own["forced"] = e.status
                    own["pinned"] = own["pinned"] and e.status != "suppressed"
                else:
                    own["pinned"] = e.effect == "pin"
        for own in hit:
            touched[own["id"]] = own
            if e.effect in ("force", "delete"):
                continue
            own["judged"], own["forced"] = own["pinned"], None
            held = own["context"]
            for t in e.terms if e.terms is not None else ():
                term, own_sound = (t["term"], t["sound"]) if isinstance(t, dict) else (t[0], t[1])
                if own_sound != sound:
                    held[term] = held.get(term, 0.0) + 1.0
            own["context"] = dict(sorted(held.items(), key=lambda x: (-x[1], x[0]))[:CONTEXT_TERMS])
    return [touched[k] for k in sorted(touched)]


def _row(scope: str, e: dict) -> tuple:
    confidence = (e["yes"] + 1.0) / (e["yes"] + e["no"] + 2.0)
    if e["judged"]:
        confidence, status = max(confidence, PINNED_CONFIDENCE), "active"
    else:
        status = "suppressed" if e["no"] >= SUPPRESSION else "active" if e["yes"] >= PROMOTION else "candidate"
    status = e["forced"] or status
    return scope, e["id"], e["canonical"], e["kind"], status, round(confidence, 4), e["pinned"], e["yes"], e["no"], json.dumps(e["context"], sort_keys=True)


def folded(observations: DataFrame) -> DataFrame:
    """A streaming (or batch) frame of observations to updates of the entries they touch."""
    columns = [c.split()[0] for c in OUT.split(", ")]

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        entries = json.loads(state.get[0]) if state.exists else {}
        events = pd.concat(list(frames))
        touched = step(entries, events, key[1])
        state.update((json.dumps(entries),))
        if touched:
            yield pd.DataFrame([_row(key[0], e) for e in touched], columns=columns)

    rows = keyed(observations).groupBy("scope", "sound")
    return rows.applyInPandasWithState(update, OUT, "entries string", "update", "NoTimeout")


def decision_compaction(path: str, keep: int):
    """A foreachBatch function: the trace is version ``epoch`` under ``path``, pruned to whole requests.

    A version is the one before with the batch's decisions, so a batch that is replayed writes its
    version again; versions before the last two are removed.
    """
    from termloom.operators.trace import compacted

    def version(epoch: int) -> str:
        return f"{path}/version={epoch}"

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        store = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        there = lambda e: store.exists(spark._jvm.org.apache.hadoop.fs.Path(version(e)))
        rows = spark.read.parquet(version(epoch - 1)).unionByName(batch) if there(epoch - 1) else batch
        compacted(rows, keep).write.mode("overwrite").parquet(version(epoch))
        if there(epoch - 2):
            store.delete(spark._jvm.org.apache.hadoop.fs.Path(version(epoch - 2)), True)

    return write
