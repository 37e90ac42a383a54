"""Language identification by a linear-chain conditional random field over words.

A word's score for a language sums weights of its affixes, its character bigrams and trigrams
and its place in the languages' lexicons; learned transitions tie neighbouring words.  The model
is fitted by maximum likelihood on code-switched sequences dealt from labelled documents; its
marginals come from forward-backward.  A document's language is the one with the most marginal
mass over its words, the score that mass over the number of words.

The fit uses a bounded sample: about ``sample`` documents of each label (``rows`` in all, but one
of each label), drawn by a hash of the doc_id in one pass, with all their words.  The lexicon of
a label is its ``LEXICON`` most frequent words in the sample.  Any number of labels can be
learned; the model and its cost grow with it.  Prediction reads all words of all texts and
neither doc_id nor any other column.

Chains of any length are labelled as wholes: long ones are walked in pieces of ``CHAIN`` words,
all at once, and the messages of forward-backward are carried over the cuts, so that the cuts
change no marginal.

Edge cases: a null text, one without letters, or any text if nothing is labelled, is ``und``
with score 0; words without letters are passed over; ties go to the first label by code point;
repeated rows are rows of their own and get equal answers; an empty table gives an empty result;
null labels teach nothing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import owned

UNKNOWN = "und"
BUCKETS = 1 << 15
#: Bytes of words that a task keeps with their scores; the group of texts that reaches it is the last one kept.
CACHE = 64 << 20
#: Words of a chain that are walked one after the other.
CHAIN = 1 << 13
#: Characters of text that are labelled together.
GROUP = 4 << 20
LEXICON = 500
SEQUENCE, BATCH, EPOCHS, RATE = 32, 64, 6, 0.3


def _mix(kind: int, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    h = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (c.astype(np.uint64) * np.uint64(0x165667B19E3779F9))
    h = (h + np.uint64(kind)) * np.uint64(0xFF51AFD7ED558CCD)
    return ((h >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int64)


def features(words: list[str], lexicon: dict[str, tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, feature, value) of hashed affix and n-gram features and of lexicon flags."""
    n = len(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    text = np.frombuffer(("\x02" + "\x03\x02".join(words) + "\x03").encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(lengths + 2)  # a word and its two marks
    starts = ends - lengths - 2
    owner = np.repeat(np.arange(n), lengths + 2)
    zero = np.zeros(1, np.uint32)
    last = np.arange(len(text)) == np.repeat(ends - 1, lengths + 2)
    two = np.flatnonzero(~last)
    three = two[~last[np.minimum(two + 1, len(text) - 1)]]
    padded = np.concatenate([text, zero, zero])
    bigrams = _mix(1, padded[two], padded[two + 1], zero)
    trigrams = _mix(2, padded[three], padded[three + 1], padded[three + 2])
    parts = [(owner[two], bigrams, 4.0 / (lengths[owner[two]] + 1)), (owner[three], trigrams, 4.0 / np.maximum(lengths[owner[three]], 1))]
    every = np.arange(n)
    for k in (1, 2, 3):
        fits = lengths >= k
        w, s, e = every[fits], starts[fits] + 1, ends[fits] - 1
        head = [padded[s + i] if i < k else np.zeros(len(w), np.uint32) for i in range(3)]
        tail = [padded[e - 1 - i] if i < k else np.zeros(len(w), np.uint32) for i in range(3)]
        parts += [(w, _mix(10 + k, *head), np.ones(len(w))), (w, _mix(20 + k, *tail), np.ones(len(w)))]
    own = [lexicon.get(w, ()) for w in words]
    sizes = np.fromiter(map(len, own), np.int64, n)
    parts.append((np.repeat(every, sizes), BUCKETS + np.fromiter((k for x in own for k in x), np.int64, int(sizes.sum())), np.ones(int(sizes.sum()))))
    return tuple(np.concatenate(x) for x in zip(*parts))


@dataclass
class Model:
    """Weights by feature and label, transitions and first-word scores, all in logarithms."""

    labels: list[str]
    weights: np.ndarray
    moves: np.ndarray
    first: np.ndarray
    lexicon: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def scores(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.labels)))
        word, feature, value = features(words, self.lexicon)
        for k in range(len(self.labels)):
            out[:, k] = np.bincount(word, value * self.weights[feature, k], len(words))
        return out


def normal(word: str) -> str:
    return word.lower().strip(".,;:!?()[]{}\"'«»|…-")


def has_letter(word: str) -> bool:
    return any(map(str.isalpha, word))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


def marginals(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray, first: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None) -> np.ndarray:
    """Posterior label probabilities by forward-backward, all chains in step.

    ``scores`` has the chains' words in time order: first all first words, longest chain first,
    and so on; ``lengths`` falls.  ``before`` and ``after`` are the messages into each chain, if
    it is a piece of a longer one: from its left in place of ``first``, and from its right.
    """
    steps = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")  # chains longer than t
    at = np.concatenate([[0], np.cumsum(active)])
    emit = np.exp(scores - scores.max(axis=1, keepdims=True))
    move = np.exp(moves - moves.max())
    enter = np.exp(first - first.max()) if before is None else before
    forward = np.empty_like(emit)
    for t in range(steps):
        n, here = active[t], slice(at[t], at[t + 1])
        a = emit[here] * (enter if t == 0 else forward[at[t - 1] : at[t - 1] + n] @ move)
        forward[here] = a / a.sum(axis=1, keepdims=True)
    back = np.ones((len(lengths), len(first))) if after is None else after.copy()
    for t in range(steps - 1, -1, -1):
        n, here = active[t], slice(at[t], at[t + 1])
        b = back[:n]
        post = forward[here] * b
        forward[here] = post / post.sum(axis=1, keepdims=True)
        if t:
            b = (emit[here] * b) @ move.T
            back[:n] = b / b.sum(axis=1, keepdims=True)
    return forward


def carried(pieces: list[np.ndarray], moves: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The messages into each piece of one chain, from its left and from its right.

    A piece acts on messages as a matrix, the product over its words; the pieces' matrices are
    made in step, and only their products are taken one after the other.
    """
    size, move = len(first), np.exp(moves - moves.max())
    acts = np.repeat(np.eye(size)[None], len(pieces), axis=0)
    lengths = np.array([len(p) for p in pieces])
    for t in range(int(lengths.max())):
        live = np.flatnonzero(lengths > t)
        score = np.stack([pieces[k][t] for k in live])
        acts[live] = (acts[live] if t == 0 else acts[live] @ move) * np.exp(score - score.max(axis=1, keepdims=True))[:, None, :]
        acts[live] /= acts[live].max(axis=(1, 2), keepdims=True)
    left, right = np.empty((len(pieces), size)), np.ones((len(pieces), size))
    left[0] = np.exp(first - first.max())
    for k in range(1, len(pieces)):
        left[k] = _unit(_unit(left[k - 1] @ acts[k - 1]) @ move)
    for k in range(len(pieces) - 1, 0, -1):
        right[k - 1] = _unit(move @ (acts[k] @ right[k]))
    return left, right


def _grams(docs: list[tuple[str, list[str]]], labels: list[str], seed: int = 7) -> tuple[list[str], np.ndarray, np.ndarray, dict[str, tuple[int, ...]]]:
    """Words, code-switched sequences of word numbers with their labels, and the lexicon."""
    counts = {x: Counter() for x in labels}
    for label, words in docs:
        counts[label].update(words)
    lexicon: dict[str, tuple[int, ...]] = {}
    for k, label in enumerate(labels):
        for word, _ in sorted(counts[label].items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            lexicon[word] = (*lexicon.get(word, ()), k)
    words = sorted(set().union(*counts.values()))
    number = {w: i for i, w in enumerate(words)}
    rng = np.random.default_rng(seed)
    pieces: dict[int, list[np.ndarray]] = {k: [] for k in range(len(labels))}
    place = {label: k for k, label in enumerate(labels)}
    for label, doc in docs:
        ids, at = np.array([number[w] for w in doc], np.int64), 0
        while at < len(ids):
            step = int(rng.integers(4, 2 * SEQUENCE))
            pieces[place[label]].append(ids[at : at + step])
            at += step
    flow = [(k, p) for k, own in pieces.items() for p in own]
    # each label has a like share of the words, so that none is preferred for its number
    most = max(sum(map(len, own)) for own in pieces.values())
    for k, own in pieces.items():
        have = sum(map(len, own))
        while own and have < most:
            p = own[int(rng.integers(len(own)))]
            flow.append((k, p))
            have += len(p)
    flow = [flow[i] for i in rng.permutation(len(flow))]
    ids = np.concatenate([p for _, p in flow])
    gold = np.concatenate([np.full(len(p), k) for k, p in flow])
    cut = len(ids) // SEQUENCE * SEQUENCE
    if not cut:  # less than one sequence: repeat it
        ids, gold = np.resize(ids, SEQUENCE), np.resize(gold, SEQUENCE)
        cut = SEQUENCE
    return words, ids[:cut].reshape(-1, SEQUENCE), gold[:cut].reshape(-1, SEQUENCE), lexicon


def fit(docs: list[tuple[str, list[str]]]) -> Model:
    """Maximum likelihood by AdaGrad; expectations come from forward-backward.  Deterministic."""
    labels = sorted({label for label, words in docs if words})
    size = len(labels)
    words, ids, gold, lexicon = _grams([d for d in docs if d[1]], labels)
    model = Model(labels, np.zeros((BUCKETS + size, size)), np.zeros((size, size)), np.zeros(size), lexicon)
    word, feature, value = features(words, lexicon)
    order = np.argsort(word, kind="stable")
    word, feature, value = word[order], feature[order], value[order]
    ends = np.searchsorted(word, np.arange(len(words) + 1))
    squares = [np.full_like(x, 1e-2) for x in (model.weights, model.moves, model.first)]
    rng = np.random.default_rng(11)
    for _ in range(EPOCHS):
        turn = rng.permutation(len(ids))
        for at in range(0, len(turn), BATCH):
            x, y = ids[turn[at : at + BATCH]].T.ravel(), gold[turn[at : at + BATCH]].T  # time first
            used, back = np.unique(x, return_inverse=True)
            spans = ends[used + 1] - ends[used]
            take = np.repeat(ends[used] - np.concatenate([[0], np.cumsum(spans)[:-1]]), spans) + np.arange(spans.sum())
            own, f, v = np.repeat(np.arange(len(used)), spans), feature[take], value[take]
            score = np.stack([np.bincount(own, v * model.weights[f, k], len(used)) for k in range(size)], axis=1)
            n = y.shape[1]
            post = marginals(score[back], np.full(n, SEQUENCE), model.moves, model.first)
            miss = -post
            miss[np.arange(len(x)), y.ravel()] += 1
            per = np.stack([np.bincount(back, miss[:, k], len(used)) for k in range(size)], axis=1)
            grads = [np.stack([np.bincount(f, v * per[own, k], BUCKETS + size) for k in range(size)], axis=1), np.zeros((size, size)), miss[:n].sum(axis=0)]
            np.add.at(grads[1], (y[:-1].ravel(), y[1:].ravel()), 1)
            grads[1] -= _expected(score[back], post, n, model)
            for p, s, g in zip((model.weights, model.moves, model.first), squares, grads):
                s += g * g
                p += RATE * g / np.sqrt(s)
    model.weights = model.weights.astype(np.float32)
    return model


def _expected(scores: np.ndarray, post: np.ndarray, n: int, model: Model) -> np.ndarray:
    """Expected transitions, from the pairwise marginals of each neighbouring pair."""
    move, size = np.exp(model.moves - model.moves.max()), len(model.labels)
    emit = np.exp(scores - scores.max(axis=1, keepdims=True)).reshape(SEQUENCE, n, size)
    post = post.reshape(SEQUENCE, n, size)
    alpha, total = np.empty((SEQUENCE, n, size)), np.zeros((size, size))
    alpha[0] = emit[0] * np.exp(model.first - model.first.max())
    alpha[0] /= alpha[0].sum(axis=1, keepdims=True)
    for t in range(1, SEQUENCE):
        alpha[t] = emit[t] * (alpha[t - 1] @ move)
        alpha[t] /= alpha[t].sum(axis=1, keepdims=True)
    beta = np.ones((n, size))
    for t in range(SEQUENCE - 1, 0, -1):
        right = emit[t] * beta
        joint = alpha[t - 1][:, :, None] * move[None] * right[:, None, :]
        total += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        beta = right @ move.T
        beta /= beta.sum(axis=1, keepdims=True)
    return total


def train(docs: DataFrame, learn: Column, sample: int = 160, rows: int = 16_000) -> Model | None:
    """Fit on a bounded sample of the rows that ``learn`` allows; None if nothing is labelled.

    The bound on what reaches the driver, whatever the input: about ``sample`` documents of each
    label, ``rows`` in all, but one of each label.
    """
    known = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    each = max(1, min(sample, rows // len(counts)))
    # a threshold on the hash draws the sample in one pass, without a shuffle
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, each / n))])
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")), F.lit(1 << 40)) / float(1 << 40)
    drawn = known.where(place < share[F.col("lang")]).select("lang", "text")

    def cut(batches):
        for batch in batches:
            words = [[w for w in map(normal, text.split()) if has_letter(w)] for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string()))], names=["lang", "words"])

    got = sorted({(r["lang"], tuple(r["words"])) for r in drawn.mapInArrow(cut, "lang string, words array<string>").collect()})
    docs_ = [(lang, list(words)) for lang, words in got if words]
    return fit(docs_) if docs_ else None


class _Rows(dict):
    """Rows of words in the table of scores; -1 for words without letters."""

    def __init__(self):
        super().__init__()
        self.rare: dict[str, int] = {}

    def __missing__(self, word: str) -> int:
        return self.rare[word]


class Labeller:
    """Labels texts with a model; the scores of the first words met are kept, CACHE bytes of them."""

    def __init__(self, model: Model):
        self.model, self.known, self.kept = model, _Rows(), np.zeros((0, len(model.labels)))
        self.size = 0

    def scored(self, texts: list[str | None]) -> list[np.ndarray]:
        """Scores of each text's words that have letters, new words scored together."""
        split = [(t or "").split() for t in texts]
        known, table = self.known, self.kept
        missing = sorted(set().union(*split).difference(known))
        if missing:
            lettered = [w for w in missing if has_letter(w)]
            parts = [self.model.scores(list(map(normal, lettered[i : i + 20_000]))) for i in range(0, len(lettered), 20_000)]
            table = np.concatenate([table, *parts])
            known.rare = dict.fromkeys(missing, -1) | dict(zip(lettered, range(len(self.kept), len(table))))
            if self.size < CACHE:
                self.size += sum(map(len, missing)) + len(missing) * 200 + 8 * (table.size - self.kept.size)
                known.update(known.rare)
                self.kept = table
        out = []
        for words in split:
            rows = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
            out.append(table[rows[rows >= 0]])
        known.rare = {}
        return out

    def posteriors(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """Marginals of every word, from the texts' scores."""
        chains, enter, leave = [], [], []
        for i, s in enumerate(texts):
            pieces = [s[a : a + CHAIN] for a in range(0, len(s), CHAIN)]
            if pieces:
                left, right = carried(pieces, self.model.moves, self.model.first) if len(pieces) > 1 else (self._start(), np.ones((1, s.shape[1])))
                chains += [(i, p) for p in pieces]
                enter.append(left)
                leave.append(right)
        out: list[list[np.ndarray]] = [[] for _ in texts]
        order = sorted(range(len(chains)), key=lambda k: -len(chains[k][1]))
        lengths = np.array([len(chains[k][1]) for k in order], np.int64)
        flat = np.concatenate([chains[k][1] for k in order]) if order else np.zeros((0, len(self.model.labels)))
        begin = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(order) else lengths
        time = np.arange(len(flat)) - np.repeat(begin, lengths)
        by_time = np.argsort(time, kind="stable")
        post = np.empty_like(flat)
        if order:
            messages = (np.concatenate(x)[order] for x in (enter, leave))
            post[by_time] = marginals(flat[by_time], lengths, self.model.moves, self.model.first, *messages)
        got = dict(zip(order, np.split(post, begin[1:]) if len(order) else []))
        for k, (i, _) in enumerate(chains):
            out[i].append(got[k])
        return [np.concatenate(x) if x else np.zeros((0, len(self.model.labels))) for x in out]

    def _start(self) -> np.ndarray:
        return np.exp(self.model.first - self.model.first.max())[None]

    def label(self, texts: list[str | None]) -> Iterator[tuple[str, float]]:
        """(language, score) of each text."""
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text or "")
            if size > GROUP:
                yield from self._answers(self.scored(held))
                held, size = [], 0
        yield from self._answers(self.scored(held))

    def _answers(self, held: list[np.ndarray]) -> Iterator[tuple[str, float]]:
        for post in self.posteriors(held):
            if not len(post):
                yield UNKNOWN, 0.0
                continue
            mass = post.sum(axis=0) / len(post)
            k = int(mass.argmax())
            yield self.model.labels[k], min(1.0, max(0.0, float(mass[k])))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with lang_pred and score, every column kept; earlier columns of these names are replaced."""
    docs = docs.drop("lang_pred", "score")
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    names, schema = docs.columns, T.StructType(list(docs.schema)).add("lang_pred", "string").add("score", "double")
    text = names.index("text")

    def run(batches):
        labeller = Labeller(model)
        for batch in batches:
            got = list(labeller.label(batch.column(text).to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*names, "lang_pred", "score"])

    return docs.mapInArrow(owned(run), schema)


def label_words(texts: list[str | None], model: Model) -> list[list[tuple[str, str, float]]]:
    """(word, language, marginal) of every word with letters, for code-switched texts."""
    labeller = Labeller(model)
    out = []
    for text, post in zip(texts, labeller.posteriors(labeller.scored(texts))):
        words = [w for w in (text or "").split() if has_letter(w)]
        out.append([(w, model.labels[int(p.argmax())], float(p.max())) for w, p in zip(words, post)])
    return out


def held_out(doc_id: Column) -> Column:
    """Whether crc32(doc_id as text) mod 3 is 1; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))
