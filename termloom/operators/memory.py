"""Learning: an observation log folded into a memory of terms.

Entries are named by the ``seq`` of the observation that made them, so no counter is shared and
the fold is a set of joins and aggregates.  Every table carries ``scope``, which keeps separate
histories (one user, one test case) apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions import phonetics, text
from termloom.storage import written

# Thresholds of the fold.
PROMOTION, SUPPRESSION, CONTEXT_TERMS, PINNED_CONFIDENCE = 2, 2, 25, 0.95
ENTRY_KINDS = ("person", "product", "term", "acronym")
KINDS = ("correction", "dictionary_add", "usage", "revert")
#: Manual overrides, as observations of their own.
CONTROLS = ("pin", "unpin", "force", "delete")
STATUSES = ("candidate", "active", "suppressed")
OBSERVATION = (
    "scope string, seq long, kind string, before string, after string, canonical string, text string, "
    "applied string, reverted_to string, entry_kind string, context string, status string"
)


@dataclass
class Memory:
    """The folded tables: what resolving needs."""

    entries: DataFrame  # scope, entry_id, canonical, kind, status, confidence, protected, confirmations, contradictions
    surfaces: DataFrame  # scope, entry_id, surface, origin, count
    keys: DataFrame  # scope, entry_id, key, algo
    context: DataFrame  # scope, entry_id, term, weight

    stored: bool = False

    def written(self) -> Memory:
        """The same tables, each computed once; Spark then knows their sizes."""
        if self.stored:
            return self
        tables = {name: written(getattr(self, name), name) for name in ("entries", "surfaces", "keys", "context")}
        return Memory(**tables, stored=True)


def _filled(c: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(c), F.lit("")), "^\\s+|\\s+$", "")


def checked(observations: DataFrame) -> DataFrame:
    """Add ``problem``: why an observation is rejected, null if it is not.  Words are trimmed, kinds default to term.

    ``status`` is only for forced ones; a log without that column forces none.
    """
    needs = {"correction": ("before", "after"), "dictionary_add": ("canonical",), "usage": ("text",), "revert": ("applied",)}
    needs |= {c: ("canonical",) for c in CONTROLS}
    kind = F.coalesce(F.nullif(_filled("entry_kind"), F.lit("")), F.lit("term"))
    out = observations.withColumns({c: _filled(c) for c in ("before", "after", "canonical", "text", "applied")} | {"entry_kind": kind})
    problem = F.when(~F.coalesce(F.col("kind"), F.lit("")).isin(*needs), F.concat(F.lit("unknown kind: "), F.coalesce("kind", F.lit("none"))))
    for name, words in needs.items():
        for word in words:
            problem = problem.when((F.col("kind") == name) & (F.col(word) == ""), F.lit(f"{word} is empty"))
    problem = problem.when(F.col("kind").isin("correction", "dictionary_add") & ~F.col("entry_kind").isin(*ENTRY_KINDS), F.concat(F.lit("unknown entry kind: "), F.col("entry_kind")))
    status = F.coalesce("status", F.lit("none")) if "status" in observations.columns else F.lit("none")
    problem = problem.when((F.col("kind") == "force") & ~status.isin(*STATUSES), F.concat(F.lit("unknown status: "), status))
    return out.withColumn("problem", problem)


def evidence(events: DataFrame) -> DataFrame:
    """Fold (scope, entry, seq, effect) into counts, confidence and status.

    Effects: confirm and add make the entry if it is new; use confirms and revert contradicts one
    that exists; apply counts applications.  An add lifts the confirmations to the promotion
    threshold, so with u confirmations after the first add and c in all they are max(c, 2 + u).
    """
    born = events.groupBy("scope", "entry").agg(
        F.min(F.when(F.col("effect").isin("confirm", "add"), F.col("seq"))).alias("entry_id"),
        F.min(F.when(F.col("effect") == "add", F.col("seq"))).alias("first_add"),
    ).where("entry_id is not null")
    seen = events.join(born, ["scope", "entry"]).where("seq >= entry_id")
    plus = F.col("effect").isin("confirm", "use")
    counts = seen.groupBy("scope", "entry", "entry_id", "first_add").agg(
        F.count(F.when(plus, 1)).alias("c"),
        F.count(F.when(plus & (F.col("seq") > F.col("first_add")), 1)).alias("u"),
        F.count(F.when(F.col("effect") == "revert", 1)).alias("contradictions"),
        F.count(F.when(F.col("effect") == "apply", 1)).alias("applications"),
        F.min("seq").alias("first_seq"),
        F.max("seq").alias("last_seq"),
    )
    pinned = F.col("first_add").isNotNull()
    counts = counts.withColumns({"protected": pinned, "confirmations": F.when(pinned, F.greatest("c", F.col("u") + PROMOTION)).otherwise(F.col("c"))})
    return _judged(counts).drop("c", "u", "first_add")


def _judged(counts: DataFrame) -> DataFrame:
    rate = (F.col("confirmations") + 1.0) / (F.col("confirmations") + F.col("contradictions") + 2.0)
    status = (
        F.when(F.col("protected"), "active")
        .when(F.col("contradictions") >= SUPPRESSION, "suppressed")
        .when(F.col("confirmations") >= PROMOTION, "active")
        .otherwise("candidate")
    )
    sure = F.when(F.col("protected"), F.greatest(rate, F.lit(PINNED_CONFIDENCE))).otherwise(rate)
    return counts.withColumns({"confidence": F.bround(sure, 4), "status": status})


def _named(observations: DataFrame) -> DataFrame:
    """Creating observations with the entry's name in lower case; a deletion takes those before it."""
    made = observations.where(F.col("kind").isin("correction", "dictionary_add"))
    name = F.when(F.col("kind") == "correction", F.col("after")).otherwise(F.col("canonical"))
    made = made.withColumn("name", name).withColumn("entry", F.lower("name"))
    gone = observations.where("kind = 'delete'").groupBy("scope", F.lower("canonical").alias("entry")).agg(F.max("seq").alias("_gone"))
    return made.join(gone, ["scope", "entry"], "left").where("_gone is null or seq > _gone").drop("_gone")


def _born(named: DataFrame) -> DataFrame:
    first = named.groupBy("scope", "entry").agg(F.min(F.struct("seq", "name", "entry_kind")).alias("f"))
    return first.select("scope", "entry", F.col("f.seq").alias("entry_id"), F.col("f.name").alias("canonical"), F.col("f.entry_kind").alias("entry_kind"))


def _spoken(observations: DataFrame) -> DataFrame:
    """(scope, seq, kind, term, weight, sound): how often each content word is in a usage's text or a correction's context.

    Each distinct word's sound is made once, and the rows are written.
    """
    told = observations.where("kind = 'usage' or kind = 'correction' and context is not null")
    said = F.when(F.col("kind") == "usage", F.col("text")).otherwise(F.col("context"))
    words = told.select("scope", "seq", "kind", F.explode(text.content_words(said)).alias("term"))
    words = written(words.groupBy("scope", "seq", "kind", "term").agg(F.count(F.lit(1)).cast("double").alias("weight")), "spoken")
    sounds = words.select("term").distinct().withColumn("sound", phonetics.strict(F.col("term")))
    return written(words.join(sounds, "term"), "spoken-sounds")


def _usages(spoken: DataFrame, born: DataFrame) -> DataFrame:
    """Usage observations joined to the entries that existed and that they mention, on the sound."""
    sound = born.withColumn("sound", phonetics.strict(F.col("canonical"))).where("sound <> ''")
    said = spoken.where("kind = 'usage'").select("scope", "seq", "sound").distinct()
    return said.join(sound, ["scope", "sound"]).where("seq > entry_id").select("scope", "entry", "entry_id", "seq", "sound")


def mined(events: DataFrame, spoken: DataFrame) -> DataFrame:
    """(scope, entry_id, seq, terms): content words of the observations of (scope, entry_id, seq, sound) that do not sound like the entry.

    An observation's words travel in one row, however many entries it mentions.
    """
    own = spoken.groupBy("scope", "seq").agg(F.collect_list(F.struct("term", "weight", "sound")).alias("words"))
    other = F.transform(F.filter("words", lambda w: w["sound"] != F.col("sound")), lambda w: F.struct(w["term"].alias("term"), w["weight"].alias("weight")))
    return events.join(own, ["scope", "seq"]).select("scope", "entry_id", "seq", other.alias("terms"))


def strongest(terms: DataFrame, keep: int = CONTEXT_TERMS) -> DataFrame:
    """The ``keep`` heaviest terms of each entry, ties by term.

    Equal to pruning after every observation while an entry has met no more than ``keep`` terms.
    """
    sums = terms.groupBy("scope", "entry_id", "term").agg(F.sum("weight").alias("weight"))
    order = Window.partitionBy("scope", "entry_id").orderBy(F.desc("weight"), F.asc("term"))
    return sums.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= keep).drop("_rank")


def pruned_in_turn(terms: DataFrame, keep: int = CONTEXT_TERMS) -> DataFrame:
    """As ``strongest``, but pruned after every observation, so that evicted terms start anew."""
    return _pruned(terms.select("scope", "entry_id", "seq", F.array(F.struct("term", "weight")).alias("terms")), keep)


def _pruned(packed: DataFrame, keep: int = CONTEXT_TERMS) -> DataFrame:
    """``pruned_in_turn`` of (scope, entry_id, seq, terms), sorted while an observation's terms are one row.

    The order matters, so an entry's observations are folded by one task, as they come from the
    sort; its state is ``keep`` terms and one observation's words.
    """
    columns = ["scope", "entry_id", "term", "weight"]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, {}  # at: scope, entry_id, seq

        def pruned() -> dict[str, float]:
            return dict(sorted(held.items(), key=lambda x: (-x[1], x[0]))[:keep])

        for rows in batches:
            done = []
            for scope, entry, seq, term, weight in zip(*(rows[c] for c in ("scope", "entry_id", "seq", "term", "weight"))):
                if (scope, entry, seq) != at:
                    held = pruned()
                    if at is not None and (scope, entry) != at[:2]:
                        done += [(*at[:2], *x) for x in held.items()]
                        held = {}
                    at = scope, entry, seq
                held[term] = held.get(term, 0.0) + weight
            if done:
                yield pd.DataFrame(done, columns=columns)
        if at is not None:
            yield pd.DataFrame([(*at[:2], *x) for x in pruned().items()], columns=columns)

    ordered = packed.repartition("scope", "entry_id").sortWithinPartitions("scope", "entry_id", "seq")
    return ordered.select("scope", "entry_id", "seq", F.inline("terms")).mapInPandas(fold, "scope string, entry_id long, term string, weight double")


def surface_counts(rows: DataFrame) -> DataFrame:
    """(scope, entry_id, seq, step, surface, origin) to one row per surface: first origin, number of times."""
    return rows.groupBy("scope", "entry_id", "surface").agg(
        F.min(F.struct("seq", "step", "origin"))["origin"].alias("origin"), F.count(F.lit(1)).alias("count")
    )


def phonetic_keys(surfaces: DataFrame, metaphone: bool = True) -> DataFrame:
    """Distinct (scope, entry_id, key, algo) of all surfaces."""
    words = surfaces.select("scope", "entry_id", phonetics.words_of(F.col("surface")).alias("words"))
    last = None
    if metaphone:
        words = words.withColumn("m", phonetics.metaphones(F.transform("words", phonetics.normalize)))
        last = F.col("m")
    return words.select("scope", "entry_id", F.inline(phonetics.keys_of_words(F.col("words"), last))).distinct()


def fold(observations: DataFrame, metaphone: bool = True, exact_context: bool = True) -> Memory:
    """The memory after a log; rejected observations leave no trace.

    Without ``exact_context`` context terms are summed and pruned once, which differs for entries
    that meet more than CONTEXT_TERMS terms.
    """
    log = written(checked(observations).where("problem is null").drop("problem"), "log")
    named = written(_named(log), "named")
    born = written(_born(named), "born")
    spoken = _spoken(log)
    uses = written(_usages(spoken, born), "uses")
    effects = named.select("scope", "entry", "seq", F.when(F.col("kind") == "correction", "confirm").otherwise("add").alias("effect"))
    effects = effects.unionByName(uses.select("scope", "entry", "seq", F.lit("use").alias("effect")))
    effects = effects.unionByName(log.where("kind = 'revert'").select("scope", F.lower("applied").alias("entry"), "seq", F.lit("revert").alias("effect")))
    entries = evidence(effects).join(born.select("scope", "entry", "canonical", F.col("entry_kind").alias("kind")), ["scope", "entry"])
    entries = _controlled(entries, log, named)

    at = named.join(born.select("scope", "entry", "entry_id"), ["scope", "entry"])
    made = born.select("scope", "entry_id", F.col("entry_id").alias("seq"), F.lit(0).alias("step"), F.col("canonical").alias("surface"), F.lit("canonical").alias("origin"))
    own = at.select("scope", "entry_id", "seq", F.lit(1).alias("step"), F.col("name").alias("surface"), F.lit("canonical").alias("origin"))
    heard = at.where("kind = 'correction'").select("scope", "entry_id", "seq", F.lit(2).alias("step"), F.col("before").alias("surface"), F.lit("observed").alias("origin"))
    surfaces = surface_counts(made.unionByName(own).unionByName(heard))

    told = at.where("kind = 'correction' and context is not null").select("scope", "entry_id", "seq", phonetics.strict(F.col("after")).alias("sound"))
    terms = mined(told.unionByName(uses.select("scope", "entry_id", "seq", "sound")), spoken)
    context = _pruned(terms) if exact_context else strongest(terms.select("scope", "entry_id", F.inline("terms")))
    return Memory(entries.drop("entry"), surfaces, phonetic_keys(surfaces, metaphone), context)


def _controlled(entries: DataFrame, log: DataFrame, named: DataFrame) -> DataFrame:
    """Manual overrides: adds, pins, unpins and forced suppressions switch the protection in turn.

    A forced status stands until the entry is judged again, by evidence, a pin or an unpin; its
    confidence stays as it was judged last.
    """
    told = log.where(F.col("kind").isin("pin", "unpin", "force")).select("scope", F.lower("canonical").alias("entry"), "seq", "kind", "status")
    adds = named.where("kind = 'dictionary_add'").select("scope", "entry", "seq", F.lit("pin").alias("kind"), F.lit(None).cast("string").alias("status"))
    when = told.unionByName(adds).join(entries.select("scope", "entry", "entry_id", "last_seq"), ["scope", "entry"]).where("seq >= entry_id")
    hushed = (F.col("kind") == "force") & (F.col("status") == "suppressed")
    switched = when.groupBy("scope", "entry").agg(
        F.max(F.when(F.col("kind") != "force", F.struct("seq", (F.col("kind") == "pin").alias("on")))).alias("pin"),
        F.max(F.when(F.col("kind") == "force", F.struct("seq", "status"))).alias("force"),
        F.max(F.when(hushed & (F.col("seq") <= F.col("last_seq")), F.col("seq"))).alias("hushed_before"),
        F.max(F.when(hushed, F.col("seq"))).alias("hushed"),
    )
    joined = entries.join(switched, ["scope", "entry"], "left")
    never = F.lit(-1)
    on = F.coalesce(F.col("pin.on") & (F.col("pin.seq") > F.coalesce("hushed_before", never)), F.lit(False))
    judged = _judged(joined.withColumn("protected", on))
    at = F.greatest("last_seq", F.coalesce("pin.seq", never))
    judged = judged.withColumn("status", F.when(F.col("force.seq") > at, F.col("force.status")).otherwise(F.col("status")))
    return judged.withColumn("protected", F.col("protected") & (F.coalesce("hushed", never) <= at)).drop("pin", "force", "hushed_before", "hushed")


def applied(entries: DataFrame, decisions: DataFrame) -> DataFrame:
    """Entries with ``applications``, the applied decisions that name them; it changes no confidence."""
    counts = decisions.where("action = 'apply'").groupBy("scope", "entry_id").agg(F.count(F.lit(1)).alias("_n"))
    joined = entries.join(counts, ["scope", "entry_id"], "left")
    return joined.withColumn("applications", F.coalesce("applications", F.lit(0)) + F.coalesce("_n", F.lit(0))).drop("_n")


def state(memory: Memory, shown: int | None = 12) -> DataFrame:
    """Each entry with its surfaces, keys and ``shown`` strongest context terms (None: all), by canonical."""
    surfaces = memory.surfaces.groupBy("scope", "entry_id").agg(F.array_sort(F.collect_list(F.struct("origin", "surface", "count"))).alias("surfaces"))
    keys = memory.keys.groupBy("scope", "entry_id").agg(F.array_sort(F.collect_list(F.struct("algo", "key"))).alias("phonetic_keys"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "term")))
    first = order if shown is None else F.slice(order, 1, shown)
    context = memory.context.groupBy("scope", "entry_id").agg(F.transform(first, lambda t: F.struct(t["term"].alias("term"), (-t["w"]).alias("weight"))).alias("context_terms"))
    out = memory.entries
    for side in (surfaces, keys, context):
        out = out.join(side, ["scope", "entry_id"], "left")
    return out.orderBy("scope", "canonical")
