"""Operators against brute force or a round trip, on the awkward table, on none and on one row."""

import base64
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from termloom.llm import interleave, lempelziv, mixing, ordering, packing, repeats, runlength, sharding, simhash, suffixes, topk, warc
from termloom.llm.components import components

from .helpers import awkward, documents, empty, rows_of, words

PAGES = "page_id long, url string, html string"


# ------------------------------------------------------------------ shared parts


def test_positions_and_sums(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, 3, 3, 3, rng.randrange(9)]), rng.randrange(5)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, k int, n long")
    got = {r.id: (r.pos, r.upto) for r in ordering.positions(df, [F.col("k"), F.col("id")], "n").collect()}
    total = 0
    for pos, (i, _, n) in enumerate(sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))):
        total += n
        assert got[i] == (pos, total)
    assert ordering.positions(df.limit(0), [F.col("id")], "n").count() == 0


def test_components(spark):
    edges = [(5, 4), (4, 3), (9, 10), (10, 11), (11, 9), (7, 7), (3, 1), (20, 1), *((100 + i, 101 + i) for i in range(40)), *((300, 301 + i) for i in range(50))]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    want = {}
    for a, b in edges:
        if a != b:
            want.setdefault(a, a), want.setdefault(b, b)
    for _ in range(100):
        for a, b in edges:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ------------------------------------------------------------------ 1 WARC


def brute_warc(rows):
    first = {}
    for i, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(html or "", i)
    return first


def test_warc_round_trip(spark):
    rows = [(3, "http://a/1", "x" * 5000), (1, None, None), (2, "http://b/\r\nX: y", ""), (9, "ué", "é\U0001f600\r\n\r\nWARC/1.1\r\n"), (7, "u", "x" * 5000), (8, "v", "x" * 5000), (5, "w", "x" * 300_000), (None, "n", "lonely")]
    pages = spark.createDataFrame(rows, PAGES).withColumns({"file": F.lit(1), "digest": F.lit("x")}).repartition(3)
    got = warc.read(warc.archive(pages), payload=True).collect()
    first = brute_warc(rows)
    text = {i: (h or "").encode() for i, _, h in rows}
    assert len(got) == len(rows)
    for r in got:
        payload = text[r.page_id]
        own = first[payload.decode()] == r.page_id
        assert (r.payload_bytes, r.payload_digest) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if own else ("revisit", first[payload.decode()]))
        assert r.payload == (payload if own else None)


def test_warc_repeated_rows_thresholds_and_nothing(spark):
    twice = spark.createDataFrame([(1, "a", "same"), (1, "a", "same"), (2, "b", "same")], PAGES)
    assert Counter(r.record_type for r in warc.read(warc.archive(twice)).collect()) == {"response": 1, "revisit": 2}
    assert Counter(r.record_type for r in warc.read(warc.archive(twice, least_bytes=5)).collect()) == {"response": 3}
    assert warc.read(warc.archive(twice.limit(0))).count() == 0


def test_warc_members_stand_alone(tmp_path):
    import io

    raw = io.BytesIO()
    parts = [b"".join(warc.record(i, "u", b"p%d" % i * 1000, warc.digest(b"p%d" % i * 1000))) for i in range(1500)]
    # two gzip streams in one file, as some tools write them
    raw.write(zlib.compress(b"".join(parts[:700]), wbits=31) + zlib.compress(b"".join(parts[700:]), wbits=31))
    raw.seek(0)
    out, index = io.BytesIO(), io.BytesIO()
    ranges = warc.normalise_file(raw, out, index, {})
    assert [r[0] for r in ranges] == [512, 512, 476]
    import json

    for k, line in enumerate(index.getvalue().splitlines()):
        e = json.loads(line)
        got = warc.member(out.getvalue()[e["offset"] : e["offset"] + e["length"]])
        assert (got["page_id"], got["payload"]) == (k, b"p%d" % k * 1000)
    with pytest.raises(ValueError):
        warc.normalise_file(io.BytesIO(zlib.compress(parts[0][:200], wbits=31)), io.BytesIO(), io.BytesIO(), {})


# ------------------------------------------------------------------ 2 SimHash


def slow_fingerprint(text, shingle):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + shingle]).encode(), 42) for i in range(max(1, len(w) - shingle + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, linked):
    """(doc_id, fingerprint) rows to the smallest doc_id reachable."""
    label = list(range(len(prints)))
    for _ in range(len(prints)):
        changed = False
        for i, (_, a) in enumerate(prints):
            for j, (_, b) in enumerate(prints[:i]):
                if label[i] != label[j] and linked(a, b):
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
        if not changed:
            break
    ids = defaultdict(list)
    for k, (d, _) in zip(label, prints):
        ids[k].append(d)
    return [(d, f, min((x for x in ids[k] if x is not None), default=None)) for k, (d, f) in zip(label, prints)]


def test_simhash_narrow(spark):
    rng = random.Random(2)
    base = words(rng, 200).split()
    near = [(100 + i, " ".join(base[:i] + ["changed"] + base[i + 1 :])) for i in range(25)]
    short = [(200 + i, " ".join(rng.sample(["a", "b", "c"], 3))) for i in range(20)]
    docs = awkward(spark, near + short)
    rows = [(r.doc_id, slow_fingerprint(r.text, 3)) for r in docs.collect()]
    got = simhash.near_duplicates(docs, shingle=3, radius=2)
    got = [(d, int(f, 16), c) for d, f, c in rows_of(got, "doc_id", simhash.as_hex(F.col("fp")), "component_id")]
    want = brute_components(rows, lambda a, b: (a ^ b).bit_count() <= 2)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert simhash.near_duplicates(empty(spark), 3, radius=2).count() == 0


@pytest.mark.parametrize("radius", [2, 4])
def test_simhash_tiles_lose_nothing(spark, radius):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for f in list(fps):
        for _ in range(4):
            fps.add(f ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 2 * radius + 2))))
    fps |= {0, (1 << 64) - 1, 1, 3, (1 << 63)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = dict(tuple(r) for r in components(simhash.links(df, radius)).collect())
    want = brute_components([(f, f % (1 << 64)) for f in signed], lambda a, b: (a ^ b).bit_count() <= radius)
    linked = Counter(c for _, _, c in want)
    assert got == {d: c for d, _, c in want if linked[c] > 1}


def test_compare_forest_is_whole():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 20, 300, dtype=np.uint64)
    for same in (True, False):
        b = a if same else rng.integers(0, 1 << 20, 250, dtype=np.uint64)
        ask = lambda i, j: (i + j) % 3 > 0
        for confirm in (None, ask):
            u, v = simhash.compare(a, b, 5, confirm, same)
            shift = 0 if same else len(a)
            label = np.arange(shift + len(b))
            i, j = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= 5)
            if same:
                i, j = i[i < j], j[i < j]
            if confirm:
                good = confirm(i, j)
                i, j = i[good], j[good]
            for _ in range(400):
                least = np.minimum(label[i], label[j + shift])
                np.minimum.at(label, i, least)
                np.minimum.at(label, j + shift, least)
            got = np.arange(len(label))
            got[u] = v
            if confirm is None or not same:
                assert np.array_equal(got, label)
            if not same:  # known links: only what is new comes out, and both together make the whole
                known = np.arange(shift + len(b))
                known[4 : len(a) : 4] = 0
                u, v = simhash.compare(a, b, 5, confirm, False, joined=known)
                assert np.array_equal(known[u], u)
                both = simhash.Forest(known.copy())
                both.add(u, v)
                whole = simhash.Forest(known.copy())
                whole.add(i, j + shift)
                assert np.array_equal(both.label, whole.label)


def test_simhash_similarity(spark):
    """Links at a shingle similarity of 0.8: clear copies are found, clear strangers left."""
    rng = random.Random(6)
    rows, want = [], {}
    for k in range(40):
        base = words(rng, 400, 3000).split()
        rows.append((1000 + k, " ".join(base)))
        if k % 2:
            other = list(base)
            for at in rng.sample(range(400), 4):  # a similarity of about 0.9
                other[at] = "new"
            rows.append((2000 + k, " ".join(other)))
            want[2000 + k] = 1000 + k
    rows += [(3000 + i, " ".join(rows[0][1].split()[:200] + words(rng, 200, 3000).split())) for i in range(5)]  # a third
    docs = documents(spark, rows)
    found = simhash.near_duplicates(docs, shingle=5, similarity=0.8)
    got = {r.doc_id: r.component_id for r in found.collect()}
    assert got == {d: want.get(d, d) for d, _ in rows}
    kept = simhash.representatives(docs, found)
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in rows} - set(want)
    assert kept.columns == docs.columns
    wide = simhash.near_duplicates(awkward(spark), 5, 0.8)
    assert wide.count() == awkward(spark).count() and simhash.near_duplicates(empty(spark), 5, 0.8).count() == 0


def test_simhash_similarity_at_the_limit(spark):
    """Pairs planted on both sides of 0.8 against the Jaccard similarity of their sets."""
    rng = random.Random(8)
    fresh = (f"x{i}" for i in itertools.count())
    rows, n = [], 0
    for size, changed, many in ((94, 6, 150), (99, 6, 40), (102, 7, 100), (104, 11, 40), (409, 41, 30), (409, 42, 30)):
        for _ in range(many):  # a run of changed words changes four shingles more
            base = [next(fresh) for _ in range(size)]
            at, n = rng.randrange(4, size - changed - 4), n + 1
            rows += [(2 * n, " ".join(base)), (2 * n + 1, " ".join(base[:at] + [next(fresh) for _ in range(changed)] + base[at + changed :]))]
    for size in (5, 6, 8, 9, 12):  # a word more, from one shingle on
        for _ in range(10):
            base, n = [next(fresh) for _ in range(size + 1)], n + 1
            rows += [(2 * n, " ".join(base[:-1])), (2 * n + 1, " ".join(base))]
    for _ in range(10):  # lines that repeat count once
        a, b, n = f"{words(rng, 30, 9000)} ", f"{words(rng, 30, 9000)} ", n + 1
        rows += [(2 * n, a * 9 + b + a), (2 * n + 1, a * 2 + b * 7 + a)]
    rows += [(0, ""), (1, "  ")]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(documents(spark, rows), 5, 0.8).collect()}
    sets = {d: {tuple(w[i : i + 5]) for w in [t.split()] for i in range(max(1, len(w) - 4))} for d, t in rows}
    near = {d: len(sets[d] & sets[d + 1]) / len(sets[d] | sets[d + 1]) >= 0.8 for d in sets if d % 2 == 0}
    assert 250 < sum(near.values()) < len(near) - 150
    assert got == {d: d - d % 2 if near[d - d % 2] else d for d in sets}


@pytest.mark.parametrize("rows_of_a_tile", [16, 1 << 14])
def test_simhash_groups_over_many_tiles(spark, monkeypatch, rows_of_a_tile):
    """Chains of near copies, whose links lie within tiles and across them."""
    monkeypatch.setattr(simhash, "FILE", rows_of_a_tile)
    rng = random.Random(9)
    fresh = (f"x{i}" for i in itertools.count())
    texts = {}
    for group in range(8):
        now = [next(fresh) for _ in range(200)]
        for step in range(20):  # neighbours are alike, the ends of a chain are not
            texts[100 * group + step] = " ".join(now)
            at = rng.randrange(4, 180)
            now = now[:at] + [next(fresh) for _ in range(9)] + now[at + 9 :]
    sets = {d: {tuple(w[i : i + 5]) for w in [t.split()] for i in range(len(w) - 4)} for d, t in texts.items()}
    want = brute_components([(d, d) for d in texts], lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(documents(spark, list(texts.items())), 5, 0.8).collect()}
    assert got == {d: c for d, _, c in want}
    assert len(set(got.values())) < len(got) / 4


def test_strangers_in_size_are_not_compared():
    """Rows in order of size meet only those that a similarity of 0.8 allows, and lose no link that it allows."""
    rng = np.random.default_rng(4)
    size = np.sort(np.exp(rng.uniform(0, 8, 3000)).astype(np.int64))
    at, to = size[:, None], size[None, :]
    may = np.minimum(at, to) >= 0.8 * np.maximum(at, to)
    for first, end in ((0, 40), (900, 964), (2990, 3000)):
        asked = np.zeros(may.shape, bool)

        def confirm(i, j, first=first):
            asked[i + first, j] = True
            return np.zeros(len(i), bool)

        def window(a, b, first=first):
            return np.searchsorted(simhash.most(size, 0.8), size[first + a]), np.searchsorted(size, simhash.most(size[first + b - 1], 0.8), "right")

        assert not len(simhash.compare(np.zeros(end - first, np.uint64), np.zeros(len(size), np.uint64), 0, confirm, joined=np.arange(end - first + len(size)), window=window)[0])
        assert asked[first:end][may[first:end]].all() and asked.sum() < 0.3 * (end - first) * len(size)
    for a, b in zip(*(x[may & (at <= to)] for x in np.broadcast_arrays(at, to))):
        assert simhash._step(b, 0.8) <= simhash._step(simhash.most(a, 0.8), 0.8)


# ------------------------------------------------------------------ 3 interleaved media


def test_interleaved_payloads(spark):
    docs = awkward(spark, [(30, "x" * 64), (31, "y" * 65), (32, "y")])
    stored = interleave.store(docs)
    parsed = interleave.parse(stored.select("doc_id", "n_bytes", "html"))
    got = interleave.resolve(parsed, interleave.describe(stored)).where("kind = 'media'").collect()
    want = []
    for r in docs.collect():
        raw = (r.text or "").encode()
        full = raw + bytes(-len(raw) % 64) if raw else bytes(64)
        media = b"P5\n64 %d\n255\n" % (len(full) // 64) + full
        want.append((r.doc_id, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]), len(media), hashlib.sha256(media).hexdigest(), f"{len(raw)} bytes"))
    have = [(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.caption) for r in got]
    assert sorted(have, key=repr) == sorted(want, key=repr)
    assert len({(r.payload_sha256, r.feature) for r in got}) == len({r.payload_sha256 for r in got})
    assert interleave.describe(interleave.store(empty(spark))).count() == 0


def test_sequences():
    html = "<html><title>T</title><script>no()</script><p>One <b>two</b><img src='a' alt='A'>three</p><figure><img src=b><img src=c><figcaption>both &amp; more</figcaption></figure><figure><figcaption>early</figcaption><video src=d></video></figure><img>end"
    got = [(x["pos"], x["kind"], x["text"] or x["ref"], x["caption"]) for x in interleave.sequence(html)]
    assert got == [(0, "text", "T", None), (1, "text", "One two", None), (2, "media", "a", "A"), (3, "text", "three", None), (4, "media", "b", "both & more"), (5, "media", "c", "both & more"), (6, "media", "d", "early"), (7, "text", "end", None)]
    assert interleave.sequence(None) == [] and interleave.sequence("") == [] and interleave.sequence("<figure><figcaption>alone") != []


def test_resolve_keeps_places(spark):
    pages = spark.createDataFrame([(1, "<img src='sha256:" + "0" * 64 + "'><p>x</p><img src=http://x/y>"), (2, None)], "page_id long, html string")
    known = spark.createDataFrame([("0" * 64, 7)], "digest string, payload_bytes long")
    got = interleave.resolve(interleave.parse(pages), known)
    assert rows_of(got, "page_id", "pos", "kind", "payload_bytes") == [(1, 0, "media", 7), (1, 1, "text", None), (1, 2, "media", None)]


# ------------------------------------------------------------------ 5 mixing


def brute_targets(sizes, weights, cap=3):
    total, full = sum(sizes.values()), set()
    while True:
        rest = Fraction(total - sum(cap * sizes[s] for s in full))
        free = sum(weights[s] for s in sizes if s not in full) or 1
        over = {s for s in sizes if s not in full and rest * weights[s] / free > cap * sizes[s]}
        if not over:
            return {s: Fraction(cap * sizes[s]) if s in full else rest * weights[s] / free for s in sizes}
        full |= over


def test_mixing(spark):
    rng = random.Random(8)
    rows = [(i, words(rng, rng.randrange(0, 60)), "en", rng.choice(["a", "b", "b", "b", "c", None, "é", "Z"])) for i in range(400)] + [(999, "one", "en", "tiny")]
    docs = awkward(spark).drop("n_chars").unionByName(documents(spark, rows).drop("n_chars"), allowMissingColumns=True)
    got = mixing.mix(docs)
    assert {"copies", "rate", "size"} <= set(got.columns) and len(got.columns) == len(set(got.columns))
    again = rows_of(mixing.mix(docs.repartition(5)), "doc_id", "text", "size", "copies")
    assert rows_of(got, "doc_id", "text", "size", "copies") == again
    sizes = Counter()
    for r in docs.collect():
        sizes[r.source] += len(re.findall("[^\x20\x09-\x0d]+", r.text or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = brute_targets(sizes, {s: i % 3 + 1 for i, s in enumerate(order)})
    taken = Counter()
    for r in got.collect():
        assert r.target == pytest.approx(float(want[r.source])) and r.source_size == sizes[r.source]
        rate = want[r.source] / sizes[r.source] if sizes[r.source] else 0
        assert int(rate) <= r.copies <= int(rate) + (rate != int(rate)) and r.copies <= 3
        taken[r.source] += r.size * r.copies
    assert taken["b"] == pytest.approx(float(want["b"]), rel=0.25)
    assert mixing.emit(got).count() == sum(r.copies for r in got.collect())
    assert mixing.mix(empty(spark)).count() == 0
    assert {r.copies for r in mixing.mix(documents(spark, [(1, None), (2, "")])).collect()} == {0}


def test_mixing_of_rows_without_ids(spark):
    """Rows of a null id draw each for themselves, be their texts equal or not."""
    for text in (lambda i: f"w{i} x", lambda i: "one two"):
        docs = documents(spark, [(None, text(i), "en", "a") for i in range(600)] + [(i, "x " * 10, "en", "b") for i in range(1, 300)])
        got = mixing.mix(docs)
        a = got.where("source = 'a'").agg(F.sum(F.col("size") * F.col("copies")), F.max("target")).first()
        assert a[0] == pytest.approx(a[1], rel=0.1)
        assert rows_of(got, "doc_id", "text", "copies") == rows_of(mixing.mix(docs.repartition(7)), "doc_id", "text", "copies")


def test_representatives_of_repeated_ids(spark):
    rng = random.Random(3)
    a, b = words(rng, 80, 5000), words(rng, 80, 5000)
    rows = [(1, a), (1, a), (1, b), (2, a + " end"), (None, b), (None, None), (None, "")]
    docs = documents(spark, rows)
    kept = simhash.representatives(docs, simhash.near_duplicates(docs, shingle=5, similarity=0.8))
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted([(1, a), (1, b), (0, "")])


# ------------------------------------------------------------------ 6, 8 repeated windows


def brute_removed(units, window):
    """Masks of units that a repeated window covers, by row."""
    seen = Counter(tuple(u[i : i + window]) for u in units for i in range(len(u) - window + 1))
    masks = []
    for u in units:
        mask = bytearray(len(u))
        for i in range(len(u) - window + 1):
            if seen[tuple(u[i : i + window])] > 1:
                mask[i : i + window] = b"\x01" * window
        masks.append(bytes(mask))
    return masks


def repetitive(seed):
    rng = random.Random(seed)
    passages = [words(rng, rng.randrange(8, 40), 50) for _ in range(6)]
    return [(500 + i, " ".join(rng.choice([rng.choice(passages), words(rng, rng.randrange(1, 25), 50)]) for _ in range(rng.randrange(1, 9)))) for i in range(80)]


@pytest.mark.parametrize("hot", [1, 256])
def test_run_length_removal(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    docs = awkward(spark, repetitive(1))
    rows = docs.collect()
    units = [(r.text or "").encode() for r in rows]
    want = []
    for r, u, m in zip(rows, units, brute_removed(units, 40)):
        kept = bytes(b for b, x in zip(u, m) if not x)
        want.append((r.doc_id, len(u), sum(m), len(re.findall(b"\x01+", m)), hashlib.sha256(kept).hexdigest()))
    got = runlength.deduplicate(docs, 40)
    assert rows_of(got, *got.columns) == sorted(want, key=repr)
    assert runlength.deduplicate(empty(spark), 40).count() == 0


@pytest.mark.parametrize("hot", [1, 256])
def test_lempel_ziv_removal(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    docs = awkward(spark, repetitive(2))
    rows = docs.collect()
    units = [(r.text or "").encode().split() for r in rows]
    want = []
    for r, u, m in zip(rows, units, brute_removed(units, 7)):
        kept = b" ".join(w for w, x in zip(u, m) if not x)
        want.append((r.doc_id, len(u), sum(m), hashlib.sha256(kept).hexdigest()))
    got = lempelziv.deduplicate(docs, 7)
    assert rows_of(got, *got.columns) == sorted(want, key=repr)
    assert lempelziv.deduplicate(empty(spark), 7).count() == 0


def same_crc(size=60):
    """Two different texts of equal length and CRC-32: the second ends in the four bytes that mend its checksum."""
    base, other = "a" * size + "####", "b" * size
    table = [0] * 256
    for n in range(256):
        c = n
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table[n] = c
    have, want, tail = zlib.crc32(other.encode()) ^ 0xFFFFFFFF, zlib.crc32(base.encode()) ^ 0xFFFFFFFF, []
    for _ in range(4):
        n = next(i for i in range(256) if table[i] >> 24 == want >> 24)
        want = (want ^ table[n]) << 8 & 0xFFFFFFFF | n
    for n in range(4):
        tail.append((want >> 8 * n & 0xFF) ^ (have >> 8 * n & 0xFF))
    return base.encode(), other.encode() + bytes(tail)


@pytest.mark.parametrize("find, window", [(runlength.deduplicate, 10), (lempelziv.deduplicate, 3)])
def test_rows_without_ids_are_told_apart(spark, find, window):
    rng = random.Random(9)
    a, b = words(rng, 30, 9), words(rng, 30, 9000)
    docs = documents(spark, [(None, a), (None, b), (None, a + " x"), (0, b), (None, "a"), (None, a), (None, a)])
    units = [r.text.encode() if find is runlength.deduplicate else r.text.encode().split() for r in docs.collect()]
    want = sorted((len(u), sum(m)) for u, m in zip(units, brute_removed(units, window)))
    assert sorted((r[1], r.n_removed) for r in find(docs, window).collect()) == want
    one, two = same_crc()
    assert zlib.crc32(one) == zlib.crc32(two) and one != two
    raw = spark.createDataFrame([(None, bytearray(one)), (None, bytearray(two)), (None, bytearray(one[:30]))], "doc_id long, text binary")
    if find is runlength.deduplicate:
        masks = brute_removed([one, two, one[:30]], window)
        assert sorted(r.n_removed for r in find(raw, window).collect()) == sorted(map(sum, masks))


def test_words_whose_rolling_hashes_are_equal(spark):
    """Thue-Morse words collide in every polynomial hash modulo 2^64; they are different words."""
    tm = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    rest = " ".join(f"w{i}" for i in range(34))
    docs = documents(spark, [(1, f"{rest} {tm}"), (2, rest + " " + tm.translate(str.maketrans("ab", "ba")))])
    assert [r.n_removed for r in lempelziv.deduplicate(docs, 35).collect()] == [0, 0]
    assert [r.n_removed for r in lempelziv.deduplicate(docs, 34).collect()] == [34, 34]


def test_anchors_cover_every_window_once(monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 700)
    rng = random.Random(5)
    units = runlength._units(30)
    texts = [bytes(rng.choice(b"abc ") for _ in range(n)) for n in (0, 29, 30, 31, 500, 4000)] + [b"a" * 900]
    windows, content_of = defaultdict(int), {}
    for part, text, offset, start, length in repeats._pieces(texts, units):
        piece, first, count, anchor = repeats.anchors(units.values(part), start, length, 30, units.gram)
        content = repeats.contents(part, first, first + count + 29)
        for p, f, c, h in zip(piece, first, count, map(tuple, content.tolist())):
            t, s = int(text[p]), int(f - start[p] + offset[p])
            for k in range(c):
                windows[t, s + k] += 1
            cut = texts[t][s : s + c + 29]
            assert content_of.setdefault(h, cut) == cut
    assert windows == {(t, s): 1 for t, x in enumerate(texts) for s in range(len(x) - 29)}


def test_suffix_blocks_and_statistics():
    rng = random.Random(7)
    for _ in range(25):
        parts = [np.array([rng.randrange(3) for _ in range(rng.randrange(1, 40))]) for _ in range(rng.randrange(1, 8))]
        every = [(p, i) for p, x in enumerate(parts) for i in range(len(x))]
        longest = {}
        for p, i in every:
            best = 0
            for q, j in every:
                if (p, i) != (q, j):
                    n = 0
                    while i + n < len(parts[p]) and j + n < len(parts[q]) and parts[p][i + n] == parts[q][j + n]:
                        n += 1
                    best = max(best, n)
            longest[p, i] = best
        index, reference = runlength.RunLengthIndex(parts), lempelziv.Reference(parts)
        stats = index.statistics()
        assert len(index) <= index.size
        for p, i in every:
            at = index.starts[p] + i
            assert stats[at] == reference.longest(np.array([at]))[0] == longest[p, i]
        for window in (1, 3, 6):
            for finder in (runlength.repeated_starts, lempelziv.repeated_starts):
                got = finder(parts, window)
                assert [x.tolist() for x in got] == [[i for i in range(len(x)) if longest[p, i] >= window] for p, x in enumerate(parts)]


def test_merged_marks():
    got = repeats.merged([2, 1, 1, 0, 2], [5, 0, 3, 4, 0], [9, 3, 6, 8, 4])
    assert [x.tolist() for x in got] == [[0, 1, 2, 2], [4, 0, 0, 5], [8, 6, 4, 9]]
    assert isinstance(suffixes.Block([np.array([1])]).order, np.ndarray)


# ------------------------------------------------------------------ 7 sharding


def brute_capacity(sizes, shards):
    def fits(c):
        n, used = 1, 0
        for s in sizes:
            if s > c:
                return False
            if used + s > c:
                n, used = n + 1, 0
            used += s
        return n <= shards

    lo, hi = 1, sum(sizes)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if fits(mid) else (mid + 1, hi)
    return lo


@pytest.mark.parametrize("shards, buckets", [(40, 1 << 16), (3, 4), (1, 8), (7, 16)])
def test_sharding(spark, monkeypatch, shards, buckets):
    monkeypatch.setattr(sharding, "BUCKETS", buckets)
    rng = random.Random(9)
    docs = awkward(spark, [(600 + i, words(rng, rng.randrange(0, 80), 9)) for i in range(200)] + [(900 + i, "hot text") for i in range(120)])
    rows = docs.collect()
    got = sharding.shard(docs, shards).collect()
    assert len(got) == len(rows)
    size = lambda t: len((t or "").encode()) + 16
    groups = defaultdict(list)
    for r in rows:
        groups[r.text].append(r.doc_id)
    key = lambda t: (min((d for d in groups[t] if d is not None), default=None) is not None, min((d for d in groups[t] if d is not None), default=0), b"" if t is None else hashlib.sha256(t.encode()).digest())
    sizes = [size(t) * len(groups[t]) for t in sorted(groups, key=key)]
    load = Counter()
    for r in got:
        load[r.shard] += r.size
    assert max(load.values()) == brute_capacity(sizes, shards) and max(load) < shards
    for s in load:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    crc = {r.text_crc32 for r in got}
    assert crc == {None if r.text is None else zlib.crc32(r.text.encode()) for r in rows}
    at = defaultdict(set)
    for r in got:
        at[r.size, r.text_crc32].add(r.shard)
    assert all(len(v) == 1 for v in at.values())
    assert sharding.shard(empty(spark), shards).count() == 0


# ------------------------------------------------------------------ 9 top-k


def test_topk(spark):
    rng = random.Random(10)
    rows = [(i, [rng.gauss(0, 1) * (1 + i % 4) for _ in range(6)]) for i in range(600)]
    rows += [(i, rows[3][1]) for i in range(700, 720)]  # ties
    rows += [(800, None), (850, [1.0, None]), (900, [float("nan")]), (950, [float("inf"), 1.0]), (1000, []), (1050, [5.0]), (None, [1.0] * 6), (50, [0.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("block", F.lit(2))
    valid = [(i, [int(np.floor(np.float64(np.float32(x)) * 256)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    pad = lambda v: v + [0] * (6 - len(v))
    want = []
    for n, (q, a) in enumerate(valid):
        if q % 50 == 0:
            scores = sorted((-sum(x * y for x, y in zip(pad(a), pad(b))), i) for m, (i, b) in enumerate(valid) if m != n)
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:5])]
    got = topk.top_k(df, F.col("vec_id") % 50 == 0)
    assert rows_of(got, "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert rows_of(topk.top_k(few, F.col("vec_id") == 0), "query_id", "rank", "vec_id", "score") == [(0, 1, 1, 256 * 512)]
    assert topk.top_k(few.limit(0), F.col("vec_id") == 0).count() == 0


def test_topk_beyond_exact_doubles(spark):
    rng = random.Random(6)
    big = float(2**27 + 1)
    vectors = [[big / 256 + rng.randrange(9) / 256, rng.randrange(-99, 99) / 256, rng.randrange(2**20) / 256] for _ in range(60)] + [[2.0**55, 1.0, 1.0], [2.0**55, 1.0, 2.0]]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    whole = [[int(x * 256 // 1) for x in v] for v in vectors]
    want = []
    for q in range(0, len(whole), 10):
        scores = [(min((1 << 63) - 1, sum(a * b for a, b in zip(whole[q], c))), i) for i, c in enumerate(whole) if i != q]
        want += [(q, k + 1, i, s) for k, (s, i) in enumerate(sorted(scores, key=lambda x: (-x[0], x[1]))[:5])]
    assert rows_of(topk.top_k(frame, F.col("vec_id") % 10 == 0), "query_id", "rank", "vec_id", "score") == sorted(want)


def test_blocks_of_queries_and_candidates(monkeypatch):
    rng = np.random.default_rng(3)
    c = np.sort(rng.integers(-50, 50, (900, 8)), axis=0).astype(float)
    q, ids = rng.integers(-50, 50, (40, 8)).astype(float), np.arange(900)
    turn = np.linalg.qr(rng.normal(size=(8, 8)))[0]
    i, j, s = topk.meet(q, np.full(40, -1), c, ids, ids, np.full(40, -np.inf), turn, 3, 5)
    for k in range(40):
        full = sorted((-x, n) for n, x in enumerate(c @ q[k]))[:5]
        assert [(-s_, j_) for s_, j_ in zip(s[i == k], j[i == k])] == full


# ------------------------------------------------------------------ 10 packing


def path():
    public = pytest.importorskip("public_tokenizers")
    return public.path("word_bpe_49k.json")


def test_pieces_and_places(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path())
    docs = awkward(spark, [(70, "It's DON'T <|endoftext|> İΣ café́ " * 3), (71, " non break\x85x")])
    got = packing.pack(packing.pieces(docs, path(), 64), 64).collect()
    want = Counter()
    for r in docs.collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1]
        for at in range(0, len(ids), 64):
            want[r.doc_id, at // 64, at, len(ids[at : at + 64]), zlib.crc32(np.array(ids[at : at + 64], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        end = 0
        for at, n in sorted(own):
            assert at == end
            end += n
        assert end <= 64
    assert packing.pack(packing.pieces(empty(spark), path())).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_covers_all_and_is_tight(seed):
    rng = random.Random(seed)
    lengths = Counter(min(256, int(rng.expovariate(1 / rng.choice([10, 60, 200]))) + 1) for _ in range(3000))
    lines = packing.plan(lengths, 256)
    used = Counter()
    for pattern, n in lines:
        assert sum(pattern) <= 256 and n > 0
        for x in pattern:
            used[x] += n
    assert used == lengths
    least = -(-sum(k * v for k, v in lengths.items()) // 256)
    assert sum(n for _, n in lines) <= least * 1.02 + 1
    assert packing.plan({}, 256) == []


def test_plan_finds_complements():
    assert sorted(packing.plan({200: 2, 56: 2}, 256)) == [((200, 56), 2)]
    assert packing.plan({100: 1, 90: 1, 66: 1}, 256) == [((100, 90, 66), 1)]
    assert packing.plan({100: 1, 80: 1, 46: 1, 30: 1}, 256) == [((100, 80, 46, 30), 1)]


@pytest.mark.parametrize("name", ["op1_warc", "op5_mixing", "op7_sharding", "op8_substring", "op9_topk"])
def test_sql_of_queries(spark, name):
    from termloom.llm import queries

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    want = con.sql(queries.SQL[name]).df()
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.001").toPandas()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    plain = lambda d: sorted(repr([None if x != x or x is None else x for x in row]) for row in d[columns].astype(object).where(d[columns].notna(), None).values.tolist())
    assert plain(got) == plain(want)


def test_native_plans(spark, capsys):
    """Mixing and sharding stay in DataFrame functions."""
    from termloom.llm import queries

    for name in ("op5_mixing", "op7_sharding"):
        queries.QUERIES[name](spark, "/root/testdata/sf0.001").explain()
        plan = capsys.readouterr().out
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "Cartesian" not in plan
