"""Tokens, protected ranges, rewriting: text functions on code-point offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What counts as a word, a possessive ending, a protected stretch and a content word.
WORD = "[A-Za-zऀ-ॿ][A-Za-zऀ-ॿ'’-]*"
SUFFIX = "(['’]s|['’])$"
# Inline code, URLs, e-mail addresses, handles, bare domains.
PROTECTED = (
    "`[^`]*`",
    "(?iU)\\b(?:https?://|www\\.)\\S+",
    "(?U)[\\w.+-]+@[\\w-]+\\.[\\w.-]+",
    "(?U)(?<!\\w)@[\\w.-]+",
    "(?iU)\\b[\\w-]+\\.(?:com|ai|org|net|io|dev|co|in)\\b\\S*",
)
# Words that carry no context.
STOPWORDS = (
    "a an and are as at be been but by can did do does for from had has have he her him his how i if in into is it its me my of on or our out "
    "she so than that the their them then there these they this to up us was we were what when where which who will with you your am no not all any"
).split()
CONTENT_WORD = "[A-Za-z][A-Za-z'’-]*"


def chosen(asr: Column, formatted: Column) -> Column:
    """The formatted text if it has more than blanks, else the raw one."""
    return F.when(F.regexp_replace(F.coalesce(formatted, F.lit("")), "(?U)\\s+", "") != "", formatted).otherwise(F.coalesce(asr, F.lit("")))


def matches(text: Column, pattern: str) -> Column:
    """(text, start, end) of all matches: each begins where the gaps and matches before it end."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    kind = "array<struct<text:string,start:int,end:int>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + F.length(p["g"])
        end = begin + F.length(p["m"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(p["m"].alias("text"), begin.alias("start"), end.alias("end")))).alias("out"))

    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def token_rows(rows: DataFrame, key: list[str], column: str = "text") -> DataFrame:
    """(key..., pos, start, end, stem): the tokens of each row, their places by a running sum of lengths."""
    found = F.regexp_extract_all(column, F.lit(WORD), F.lit(0))
    pairs = rows.select(*key, F.posexplode(F.arrays_zip(F.split(column, WORD, -1).alias("gap"), found.alias("word"))).alias("pos", "p")).where("p.word is not null")
    before = Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    sizes = F.length("p.gap") + F.length("p.word")
    pairs = pairs.select(*key, "pos", F.sum(sizes).over(before).cast("int").alias("end"), F.col("p.word").alias("word"))
    pairs = pairs.withColumn("stem", F.regexp_replace("word", SUFFIX, "")).where("stem <> ''")
    return pairs.select(*key, "pos", (F.col("end") - F.length("word")).alias("start"), "end", "stem")


def tokens(text: Column) -> Column:
    """Array of (text, start, end, stem, suffix); a possessive ending is the suffix."""

    def cut(m: Column) -> Column:
        suffix = F.regexp_extract(m["text"], SUFFIX, 1)
        stem = F.substr(m["text"], F.lit(1), F.length(m["text"]) - F.length(suffix))
        return F.struct(m["text"].alias("text"), m["start"].alias("start"), m["end"].alias("end"), stem.alias("stem"), suffix.alias("suffix"))

    return F.filter(F.transform(matches(text, WORD), cut), lambda t: t["stem"] != "")


def protected(text: Column) -> Column:
    """Sorted (start, end) of stretches that are never rewritten."""
    none = F.array().cast("array<struct<start:int,end:int>>")
    places = lambda p: F.transform(matches(text, p), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))
    needs = dict(zip(PROTECTED, "`.@@."))  # no match without this character, but for addresses
    marked = lambda p: F.contains(text, F.lit(needs[p])) | F.contains(text, F.lit("://"))
    return F.array_sort(F.concat(*[F.when(marked(p), places(p)).otherwise(none) for p in PROTECTED]))


def overlaps(start: Column, end: Column, ranges: Column) -> Column:
    """Whether a half-open range meets any of ``ranges``."""
    return F.exists(ranges, lambda r: (start < r["end"]) & (end > r["start"]))


def rendered(stem: Column, canonical: Column, kind: Column) -> Column:
    """How a term is written in place of a stem: shouting stays shouting, acronyms keep their case."""
    shouted = (F.length(stem) > 1) & (F.upper(stem) == stem) & (F.lower(stem) != stem)
    return F.when(kind == "acronym", canonical).when(shouted, F.upper(canonical)).otherwise(canonical)


def suffix_after(span: Column, stem: Column) -> Column:
    return F.when(F.startswith(span, stem), F.substr(span, F.length(stem) + 1, F.length(span))).otherwise(F.lit(""))


def applied(text: Column, edits: Column) -> Column:
    """Splice (start, end, replacement) edits, the last first."""
    ordered = F.reverse(F.array_sort(edits))
    return F.aggregate(ordered, text, lambda t, e: F.concat(F.substr(t, F.lit(1), e["start"]), e["replacement"], F.substr(t, e["end"] + 1, F.length(t))))


def content_words(text: Column) -> Column:
    """Lower-case ASCII words of three letters or more that are no stopwords; trailing s and quotes go."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({CONTENT_WORD})"), F.lit(1))
    cut = F.transform(found, lambda w: F.regexp_replace(F.regexp_replace(F.lower(w), "['’s]+$", ""), "^['’-]+|['’-]+$", ""))
    return F.filter(cut, lambda w: (F.length(w) >= 3) & ~w.isin(STOPWORDS))


def spans(words: Column, longest: int = 3) -> Column:
    """All runs of ``longest`` to one consecutive tokens, longer first: (ord, first, n, start, end, stem)."""
    size = F.size(words)

    def runs(n: int) -> Column:
        def run(i: Column) -> Column:
            part = F.slice(words, i + 1, n)
            return F.struct(
                F.lit(n).alias("n"),
                i.alias("first"),
                F.element_at(part, 1)["start"].alias("start"),
                F.element_at(part, -1)["end"].alias("end"),
                F.array_join(F.transform(part, lambda t: t["stem"]), " ").alias("stem"),
            )

        return F.when(size >= n, F.transform(F.sequence(F.lit(0), size - n), run)).otherwise(F.array().cast("array<struct<n:int,first:int,start:int,end:int,stem:string>>"))

    return F.concat(*[runs(n) for n in range(longest, 0, -1)])
