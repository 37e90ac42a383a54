"""Phonetic keys as Spark expressions.

Keys over-generate on purpose: they choose candidates, scoring decides.  Everything but
Metaphone and Jaro-Winkler is made of built-in functions; those two are Arrow UDFs, to be
applied to distinct inputs.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letter groups and the sound each stands for, tried in this order.
GROUPS = {
    "chh": "c", "aa": "a", "ee": "i", "ii": "i", "oo": "u", "uu": "u", "ch": "c", "sh": "s", "zh": "s",
    "th": "t", "dh": "d", "bh": "b", "gh": "g", "jh": "j", "kh": "k", "ph": "f", "ck": "k", "wh": "v",
}
# Single letters that stand for another sound; c is k or, before e, i, y, s.
SINGLES = {"w": "v", "z": "j", "q": "k", "x": "ks"}
# Devanagari letters and their Latin spelling.
CONSONANTS = {
    "क": "k", "ख": "kh", "ग": "g", "घ": "gh", "ङ": "n", "च": "ch", "छ": "chh", "ज": "j", "झ": "jh", "ञ": "n",
    "ट": "t", "ठ": "th", "ड": "d", "ढ": "dh", "ण": "n", "त": "t", "थ": "th", "द": "d", "ध": "dh", "न": "n",
    "प": "p", "फ": "ph", "ब": "b", "भ": "bh", "म": "m", "य": "y", "र": "r", "ल": "l", "व": "v", "ळ": "l",
    "श": "sh", "ष": "sh", "स": "s", "ह": "h",
}
VOWELS = {"अ": "a", "आ": "aa", "इ": "i", "ई": "ii", "उ": "u", "ऊ": "uu", "ए": "e", "ऐ": "ai", "ओ": "o", "औ": "au", "ऋ": "ri", "ॲ": "a", "ऑ": "o"}
VOWEL_SIGNS = {"ा": "aa", "ि": "i", "ी": "ii", "ु": "u", "ू": "uu", "े": "e", "ै": "ai", "ो": "o", "ौ": "au", "ृ": "ri", "ॉ": "o", "ॅ": "a"}
SIGNS = {"ं": "n", "ँ": "n", "ः": "h"}
VIRAMA = "्"

#: Key kinds in the order in which they are made, and their rank when several hit.
ALGORITHMS = ("indic", "indic_loose", "indic_fuzzy", "metaphone")
ROUTE_RANK = {"indic": 0, "metaphone": 1, "indic_loose": 2, "indic_fuzzy": 3}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def _members(*tables: dict[str, str]) -> str:
    return "".join(k for t in tables for k in t)


def transliterate(word: Column) -> Column:
    """Devanagari to Latin: inherent vowels, and none at the end of a word unless a conjunct closes it."""
    c, v, m, s = _members(CONSONANTS), _members(VOWELS), _members(VOWEL_SIGNS), _members(SIGNS)
    units = F.regexp_extract_all(word, F.lit(f"([{c}][{VIRAMA}{m}]?|[{v}{s}])"), F.lit(1))

    def spell(unit: Column) -> Column:
        base, mark = F.substring(unit, 1, 1), F.substring(unit, 2, 1)
        vowel = F.when(mark == "", F.lit("a")).when(mark == VIRAMA, F.lit("")).otherwise(_lookup(VOWEL_SIGNS, mark))
        return F.coalesce(F.concat(_lookup(CONSONANTS, base), vowel), _lookup(VOWELS | SIGNS, base))

    latin = F.array_join(F.transform(units, spell), "")
    closed = word.rlike(f"(?<![{c}]{VIRAMA})[{c}](?![{VIRAMA}{m}])[^{c}{v}{s}]*$")
    return F.when(closed, F.substr(latin, F.lit(1), F.length(latin) - 1)).otherwise(latin)


def normalize(word: Column) -> Column:
    """Lower-case a-z only; a word with Devanagari is transliterated as a whole, its Latin letters dropped."""
    latin = F.when(word.rlike("[ऀ-ॿ]"), transliterate(word)).otherwise(word)
    return F.regexp_replace(F.lower(latin), "[^a-z]", "")


def sounds(normalized: Column) -> Column:
    """Letter groups to sounds, left to right.

    No group has c but at its front, so a c before e, i or y is a unit of its own; it is marked
    first, and no unit needs to see the next one.
    """
    marked = F.regexp_replace(normalized, "c(?=[eiy])", "C")
    units = F.regexp_extract_all(marked, F.lit("(" + "|".join(GROUPS) + "|[a-zC])"), F.lit(1))
    table = GROUPS | SINGLES | {"c": "k", "C": "s"}
    return F.array_join(F.transform(units, lambda unit: F.coalesce(_lookup(table, unit), unit)), "")


def strict_of(normalized: Column) -> Column:
    joined = F.regexp_replace(F.regexp_replace(sounds(normalized), "iya", "ia"), "ya", "ia")
    return F.regexp_replace(joined, "(.)\\1+", "$1")


def strict(word: Column) -> Column:
    """The sound of a word; spellings of one sound share it."""
    return strict_of(normalize(word))


def loose_of(strict_key: Column) -> Column:
    return F.concat(F.substring(strict_key, 1, 1), F.regexp_replace(F.substring(strict_key, 2, 1 << 30), "[aeiou]", ""))


def loose(word: Column) -> Column:
    """First sound and later consonants."""
    return loose_of(strict(word))


def fuzzy_of(loose_key: Column) -> Column:
    return F.translate(loose_key, "vw", "bb")


def fuzzy(word: Column) -> Column:
    """The loose key with v and b as one."""
    return fuzzy_of(loose(word))


def keys_of_words(words: Column, metaphones: Column | None = None) -> Column:
    """Keys of an array of words, each kind joined without a separator: array of (key, algo)."""
    stricts = F.transform(words, strict)
    pairs = [("indic", stricts), ("indic_loose", F.transform(stricts, loose_of)), ("indic_fuzzy", F.transform(stricts, lambda s: fuzzy_of(loose_of(s))))]
    if metaphones is not None:
        pairs.append(("metaphone", metaphones))
    made = F.array(*[F.struct(F.array_join(keys, "").alias("key"), F.lit(name).alias("algo")) for name, keys in pairs])
    return F.filter(made, lambda p: p["key"] != "")


def words_of(surface: Column) -> Column:
    """Blank-separated words."""
    return F.filter(F.split(F.coalesce(surface, F.lit("")), "\\s+"), lambda w: w != "")


def route_rank(algo: Column) -> Column:
    return reduce(lambda c, x: c.when(algo == x[0], x[1]), ROUTE_RANK.items(), F.when(F.lit(False), 0))


_FRONT, _VOWEL = set("eiy"), set("aeiou")


def metaphone_text(word: str) -> str:
    """The published Metaphone rules; of a doubled letter other than c only the second is looked at."""
    for drop in ("kn", "gn", "pn", "wr", "ae"):
        if word.startswith(drop):
            word = word[1:]
            break
    if word.startswith("x"):
        word = "s" + word[1:]
    elif word.startswith("wh"):
        word = "w" + word[2:]
    out: list[str] = []
    i, n = 0, len(word)
    while i < n:
        c, after, third = word[i], word[i + 1 : i + 2], word[i + 2 : i + 3]
        before = word[i - 1] if i else ""
        if c == after and c != "c":
            pass
        elif c in _VOWEL:
            if i == 0:
                out.append(c)
        elif c == "b":
            if not (before == "m" and not after):
                out.append("b")
        elif c == "c":
            if after == "i" and third == "a" or after == "h":
                out.append("k" if after == "h" and before == "s" else "x")
                i += 1
            elif after and after in _FRONT:
                if before != "s":
                    out.append("s")
                i += 1
            else:
                out.append("k")
        elif c == "d":
            if after == "g" and third and third in _FRONT:
                out.append("j")
                i += 2
            else:
                out.append("t")
        elif c == "g":
            if after == "h" and third and third not in _VOWEL:
                i += 1
            elif after == "n" and (not third or word[i + 2 :] == "ed"):
                pass
            elif after and after in _FRONT and before != "g":
                out.append("j")
            else:
                out.append("k")
        elif c == "h":
            if (i == 0 or after and after in _VOWEL) and before not in set("csptg") or not before:
                out.append("h")
        elif c == "k":
            if before != "c":
                out.append("k")
        elif c == "p":
            if after == "h":
                out.append("f")
                i += 1
            else:
                out.append("p")
        elif c == "q":
            out.append("k")
        elif c == "s":
            if after == "h":
                out.append("x")
                i += 1
            elif after == "i" and third and third in "oa":
                out.append("x")
                i += 2
            else:
                out.append("s")
        elif c == "t":
            if after == "i" and third and third in "oa":
                out.append("x")
            elif after == "h":
                out.append("0")
                i += 1
            elif not (after == "c" and third == "h"):
                out.append("t")
        elif c == "v":
            out.append("f")
        elif c in "wy":
            if after and after in _VOWEL:
                out.append(c)
        elif c == "x":
            out.append("ks")
        elif c == "z":
            out.append("s")
        else:
            out.append(c)
        i += 1
    return "".join(out).upper()


@F.pandas_udf(T.ArrayType(T.StringType()))
def metaphones(words: pd.Series) -> pd.Series:
    """Metaphone of each normalized word of an array."""
    return words.map(lambda own: None if own is None else [metaphone_text(w) for w in own])


def jaro_winkler_text(a: str, b: str) -> float:
    """Jaro similarity; above 0.7, a bonus of a tenth of the rest for each of up to four equal first letters."""
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, mine = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                mine.append(x)
                break
    if not mine:
        return 0.0
    theirs = [y for y, t in zip(b, taken) if t]
    half = sum(x != y for x, y in zip(mine, theirs)) // 2
    m = len(mine)
    jaro = (m / len(a) + m / len(b) + (m - half) / m) / 3
    if jaro <= 0.7:
        return jaro
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


#: Letters of the longest strings that are compared many at once, and pairs of strings at once.
WIDEST, PAIRS = 64, 1 << 13
#: Row i, column r: the places of a string that are within r of i, as bits.
WINDOWS = np.array([[sum(1 << j for j in range(max(0, i - r), min(WIDEST, i + r + 1))) for r in range(WIDEST // 2)] for i in range(WIDEST)], np.uint64)


def _spelt(values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of an array without nulls, where each string starts, and how long it is."""
    ends = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
    letters = np.frombuffer(values.buffers()[2] or b"", np.uint8)
    return (letters if len(letters) else np.zeros(1, np.uint8)), ends[:-1].astype(np.int64), np.diff(ends)


def _columns(letters: np.ndarray, start: np.ndarray, length: np.ndarray, beyond: int) -> np.ndarray:
    """Letter k of every string in row k, ``beyond`` after its end."""
    rows = [np.where(k < length, letters[np.minimum(start + k, len(letters) - 1)], np.uint8(beyond)) for k in range(max(4, int(length.max())))]
    return np.array(rows, np.uint8)


def _jaro_winkler_block(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """As ``jaro_winkler_text``, of strings in columns; the places of b that equal a letter of a are the bits of a word."""
    n, one = len(la), np.uint64(1)
    reach = np.maximum(0, np.maximum(la, lb) // 2 - 1)
    equal, same = np.zeros((len(a), n), np.uint64), np.empty(n, bool)
    for i, letter in enumerate(a):
        lanes = equal[i].view(np.uint8).reshape(n, 8)
        for first in range(0, len(b), 8):
            bits = np.zeros(n, np.uint8)
            for t, other in enumerate(b[first : first + 8]):
                np.equal(letter, other, out=same)
                bits |= same.view(np.uint8) << np.uint8(t)
            lanes[:, first // 8] = bits
    taken, met = np.zeros(n, np.uint64), np.zeros((len(a), n), bool)
    for i in range(len(a)):
        free = equal[i] & WINDOWS[i][reach] & ~taken
        low = free & (~free + one)
        taken |= low
        met[i] = low != 0
    m, left, crossed = met.sum(axis=0), taken.copy(), np.zeros(n, np.int64)
    for i in range(len(a)):
        low = np.where(met[i], left & (~left + one), np.uint64(0))
        crossed += met[i] & (equal[i] & low == 0)
        left ^= low
    some = np.maximum(m, 1)
    jaro = (m / np.maximum(la, 1) + m / np.maximum(lb, 1) + (m - crossed // 2) / some) / 3
    alike, prefix = np.ones(n, bool), np.zeros(n, np.int64)
    for x, y in zip(a[:4], b[:4]):
        alike &= x == y
        prefix += alike
    return np.where(m == 0, 0.0, np.where(jaro > 0.7, jaro + prefix * 0.1 * (1 - jaro), jaro))


def jaro_winkler_pairs(a: pa.Array, b: pa.Array, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``jaro_winkler_text`` of a[i] and b[j], nulls as empty: pairs of like lengths together, long and other than ASCII strings one by one."""
    a, b = (pc.fill_null(x.cast(pa.string()), "") for x in (a, b))
    out = np.zeros(len(i))
    (letters, start, length), (letters_b, start_b, length_b) = _spelt(a), _spelt(b)
    plain, plain_b = (pc.string_is_ascii(x).to_numpy(zero_copy_only=False) & (n <= WIDEST) for x, n in ((a, length), (b, length_b)))
    able = plain[i] & plain_b[j]
    for k in np.flatnonzero(~able):
        out[k] = jaro_winkler_text(a[i[k]].as_py(), b[j[k]].as_py())
    able = np.flatnonzero(able & (length[i] > 0) & (length_b[j] > 0))
    able = able[np.argsort(np.maximum(length[i[able]], length_b[j[able]]), kind="stable")]
    for at in range(0, len(able), PAIRS):
        part = able[at : at + PAIRS]
        x, y = i[part], j[part]
        own, other = _columns(letters, start[x], length[x], 254), _columns(letters_b, start_b[y], length_b[y], 255)
        out[part] = _jaro_winkler_block(own, other, length[x].astype(np.int64), length_b[y].astype(np.int64))
    return out


@F.arrow_udf(T.DoubleType())
def jaro_winkler(a: pa.Array, b: pa.Array) -> pa.Array:
    """Jaro-Winkler similarity of two strings."""
    each = np.arange(len(a))
    return pa.array(jaro_winkler_pairs(a, b, each, each))


def similarity(strict_a: Column, strict_b: Column, normal_a: Column, normal_b: Column) -> Column:
    """Three parts the sound, one part the spelling, to four places; 0 without a sound."""
    score = F.bround(0.75 * jaro_winkler(strict_a, strict_b) + 0.25 * jaro_winkler(normal_a, normal_b), 4)
    return F.when((strict_a == "") | (strict_b == ""), F.lit(0.0)).otherwise(score)


@F.arrow_udf(T.DoubleType())
def _best(sound: pa.Array, plain: pa.Array, heard: pa.Array) -> pa.Array:
    """The best unrounded ``similarity`` to any (plain, sound) of an array; null without any."""
    others, own = heard.flatten(), pc.list_parent_indices(heard).to_numpy().astype(np.int64)
    sounds, plains = others.field("sound"), others.field("plain")
    there = np.flatnonzero((sound.is_valid().to_numpy(zero_copy_only=False) & plain.is_valid().to_numpy(zero_copy_only=False))[own])
    own = own[there]
    made = 0.75 * jaro_winkler_pairs(sound, sounds, own, there) + 0.25 * jaro_winkler_pairs(plain, plains, own, there)
    silent = [pc.equal(pc.fill_null(x, ""), "").to_numpy(zero_copy_only=False) for x in (sound, sounds)]
    made[silent[0][own] | silent[1][there]] = 0.0
    best = np.full(len(sound), -1.0)
    np.maximum.at(best, own, made)
    return pa.array(best, mask=best < 0)


def best_similarity(sound: Column, plain: Column, heard: Column) -> Column:
    """The best ``similarity`` to any (plain, sound) of an array."""
    return F.bround(_best(sound, plain, heard), 4)
