"""Phonetic keys and text functions against pinned values."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from termloom.functions import phonetics, text


def column(spark, values, *exprs):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, w string").orderBy("i").select("i", *exprs)
    return [tuple(r)[1:] for r in sorted(rows.collect())]


STRICT = {
    "service": "servise", "city": "sity", "nice": "nise", "price": "prise", "circle": "sirkle", "music": "musik", "picnic": "piknik",
    "cat": "kat", "code": "kode", "doctor": "doktor", "chandni": "candni", "aakash": "akas", "feel": "fil", "off": "of", "three": "tri",
    "where": "vere", "!!!": "", "": "", "mixx": "miksks", "चाय": "cay", "कृष्ण": "krisna", "राम": "ram", "सर्विस": "sarvis",
}


def test_strict(spark):
    assert [r[0] for r in column(spark, STRICT, phonetics.strict(F.col("w")))] == list(STRICT.values())


def test_loose_and_fuzzy(spark):
    got = column(spark, ["service", "vishal", "bishal", "wishaal", "सर्विस", "sarah"], phonetics.loose(F.col("w")), phonetics.fuzzy(F.col("w")))
    assert got == [("srvs", "srbs"), ("vsl", "bsl"), ("bsl", "bsl"), ("vsl", "bsl"), ("srvs", "srbs"), ("srh", "srh")]


def test_script_and_ignored_letters(spark):
    words = ["ज़", "सत्य", "कमल", "abcकमल", "कमला", "दिल्ली"]
    assert [r[0] for r in column(spark, words, phonetics.normalize(F.col("w")))] == ["j", "satya", "kamal", "kamal", "kamalaa", "dillii"]


def test_keys_join_words_without_separator(spark):
    words = phonetics.words_of(F.col("w"))
    got = column(spark, ["Nice  City", "!!"], phonetics.keys_of_words(words, phonetics.metaphones(F.transform(words, phonetics.normalize))).alias("k"))
    assert [(k.algo, k.key) for k in got[0][0]] == [("indic", "nisesity"), ("indic_loose", "nssty"), ("indic_fuzzy", "nssty"), ("metaphone", "NSST")]
    assert got[1][0] == []


@pytest.mark.parametrize("word, key", [("aakash", "KX"), ("amithya", "AM0Y"), ("knight", "NT"), ("phone", "FN"), ("thumb", "0M"), ("which", "WX"), ("school", "SKL"), ("edge", "EJ"), ("nation", "NXN"), ("xerox", "SRKS"), ("", "")])
def test_metaphone(word, key):
    assert phonetics.metaphone_text(word) == key


def test_jaro_winkler_agrees_with_duckdb():
    words = ["amritia", "amriti", "amritya", "kave", "kavi", "martha", "marhta", "dixon", "dicksonx", "a", "ab", "zzz", ""]
    for a in words:
        for b in words:
            if a and b:
                want = duckdb.execute("select jaro_winkler_similarity(?, ?)", [a, b]).fetchall()[0][0]
                assert phonetics.jaro_winkler_text(a, b) == pytest.approx(want, abs=1e-12)


def test_similarity_rounds_and_guards(spark):
    rows = spark.createDataFrame([("kavi", "kavi"), ("", "kavi"), ("kavi", "cave")], "a string, b string")
    s = phonetics.similarity(phonetics.strict(F.col("a")), phonetics.strict(F.col("b")), phonetics.normalize(F.col("a")), phonetics.normalize(F.col("b")))
    assert [r[0] for r in rows.select(s).collect()] == [1.0, 0.0, 0.8292]


def test_tokens(spark):
    got = column(spark, ["It's Asha's co-op; हूँ। x1", "", None, "'s -a"], text.tokens(F.col("w")).alias("t"))
    assert [(t.text, t.start, t.end, t.stem, t.suffix) for t in got[0][0]] == [
        ("It's", 0, 4, "It", "'s"), ("Asha's", 5, 11, "Asha", "'s"), ("co-op", 12, 17, "co-op", ""), ("हूँ।", 19, 23, "हूँ।", ""), ("x", 24, 25, "x", ""),
    ]
    assert got[1][0] == [] and [t.stem for t in got[3][0]] == ["s", "a"]


def test_protected(spark):
    line = "mail a.b@c.de or @me see https://x.y/z and `code` at foo.com/x"
    got = column(spark, [line, "plain"], text.protected(F.col("w")).alias("r"))
    parts = {line[r.start : r.end] for r in got[0][0]}
    assert {"a.b@c.de", "@me", "https://x.y/z", "`code`", "foo.com/x"} <= parts
    assert got[1][0] == []


def test_rewriting(spark):
    rows = spark.createDataFrame([("ASHA", "Usha", "person"), ("asha", "Usha", "person"), ("iitm", "IITM", "acronym"), ("A", "Usha", "term")], "s string, c string, k string")
    assert [r[0] for r in rows.select(text.rendered(F.col("s"), F.col("c"), F.col("k"))).collect()] == ["USHA", "Usha", "IITM", "Usha"]
    edits = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(r).alias("replacement")) for a, b, r in ((4, 7, "X"), (0, 1, "long"))])
    assert spark.range(1).select(text.applied(F.lit("a bcdef g"), edits)).first()[0] == "long bcX g"


def test_content_words(spark):
    got = column(spark, ["The voices' Maaras this does what's café", ""], text.content_words(F.col("w")).alias("c"))
    assert got[0][0] == ["voice", "maara", "thi", "doe", "caf"] and got[1][0] == []


def test_spans_longest_first(spark):
    got = column(spark, ["one two. three"], text.spans(text.tokens(F.col("w"))).alias("s"))
    assert [s.stem for s in got[0][0]] == ["one two three", "one two", "two three", "one", "two", "three"]


def test_jaro_winkler_of_many_pairs_is_that_of_each():
    rng = random.Random(7)
    made = ["", "a", "ab", "martha", "marhta", "é", "a\xff", "x" * 64, "x" * 65, "ab" * 40, "\x00", "\x01a"]
    made += ["".join(rng.choice("abcd" if k % 2 else "abcdefghijklmnop") for _ in range(rng.randrange(70 if k % 5 == 0 else 22))) for k in range(150)]
    values = pa.array([None, *made, *[m[:-1] + "q" for m in made]])[1:]  # with an offset
    i, j = (x.ravel() for x in np.indices((len(values), len(values))))
    got, texts = phonetics.jaro_winkler_pairs(values, values[::1], i, j), values.to_pylist()
    assert got.tolist() == [phonetics.jaro_winkler_text(texts[x], texts[y]) for x, y in zip(i, j)]
    nulls = pa.array([None, "ab"])
    assert phonetics.jaro_winkler_pairs(nulls, nulls, np.array([0, 0, 1]), np.array([0, 1, 1])).tolist() == [0.0, 0.0, 1.0]
