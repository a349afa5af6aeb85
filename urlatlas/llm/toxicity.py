"""Toxic spans by a linear-chain conditional random field, aggregated to document scores.

Fitting looks at a bounded sample of labelled documents (``SAMPLE_DOCS``),
at all of their texts and in the same way however many there are:

1. Word features (the lower-cased word and its prefixes) that occur in many
   different contexts in toxic documents, at a rate per word far above that
   in clean ones, label the sample's tokens; a greedy cover adds weaker
   features for toxic documents that have none of those.
2. A two-label chain (clean, toxic) is trained on those tokens, a chain per
   text: emission weights of the word, its prefixes and suffix and of its
   neighbours, and transition weights. Tasks take gradient steps over the
   documents of their shard (exact forward-backward), and the shards' weights
   are averaged.
3. A logistic curve turns a document's marginals (how many toxic tokens are
   expected, how sure the surest is, their share, and how many different
   words are toxic) into its score. It is fitted on what chains say of texts
   that they have not seen: every fold of the sample is judged by the chain of
   the other folds. The chain in use is that of all.

Scoring reads every token of every document in Arrow batches, one chain a
text from its first word to its last; only the text is an input. The texts of
a batch are worked on together: numpy finds their words, Arrow numbers them,
distinct words are looked up once, and a step of forward-backward is taken in
all chains at once.
"""

from __future__ import annotations

import functools
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urlatlas.llm.common import fresh, kept, stage, text_of, work_dir

#: Labelled documents the model is fitted on at most, chosen by a hash of their ids.
SAMPLE_DOCS = 16_000
#: Contexts that make a feature of toxic texts significant without further evidence.
STRONG = 6
#: How often more a feature that clean texts have too must occur in toxic ones, word for word.
RATE = 15.0
#: Parts of the sample that the chains of the others judge for the curve; by text, so that copies are in one.
FOLDS = 3
#: Shards that chains are trained in, passes over a shard's documents, and words of a gradient step.
SHARDS, PASSES, STEP = 4, 3, 8192
#: Step sizes of own-word, neighbour and transition weights, and their decay.
RATES, DECAY = (0.3, 0.05, 0.1), 1e-3
#: Hashed weights of each kind of feature.
SLOTS = 1 << 18
THRESHOLD = 0.7
#: Contexts that a task holds before it hands them on.
HELD = 100_000
#: Code points of texts that are worked on together, about; a text is never cut.
RUN = 1 << 20
#: Chains that are stepped through together at least; where fewer are that long, they go on word by word.
BREADTH = 32
#: Bytes of a word at most for its slots to be found together with those of others.
SHORT = 64

WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[str]:
    """Features of a lower-cased word that labels are learned for."""
    return [f"w={word}", *(f"{k}={word[:k]}" for k in (3, 4, 5, 6) if len(word) > k)]


#: CRC-32 of the texts before a word in its features, to go on from.
_WHOLE, _SUFFIX, *_PREFIX = (zlib.crc32(t) for t in (b"w=", b"s=", b"3=", b"4=", b"5=", b"6="))
_LENGTH = [zlib.crc32(f"l={n}".encode()) % SLOTS for n in range(13)]


def slots(word: str) -> list[int]:
    """Weight slots of a word's own features: those of ``word_features``, its suffix and its length."""
    crc, n = zlib.crc32, len(word)
    out = [crc(word.encode("utf-8"), _WHOLE) % SLOTS, crc(word[-3:].encode("utf-8"), _SUFFIX) % SLOTS, _LENGTH[min(n, 12)]]
    out += [crc(word[:k].encode("utf-8"), before) % SLOTS for k, before in zip(range(3, n), _PREFIX)]
    return out


#: Slots of a word's own features at most, and a word as a neighbour.
OWN = 7


def neighbour(word: str) -> int:
    return zlib.crc32(word.encode("utf-8")) % SLOTS


#: CRC-32 of a byte, and of zeros after each kind of beginning (those of ``slots``, then none): a CRC from
#: any beginning is one from register 0, exclusive-or that of as many zeros from that beginning.
_BYTE = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], dtype=np.uint32)
_ZEROS = np.array([[zlib.crc32(bytes(n), before) for n in range(SHORT + 1)] for before in (_WHOLE, _SUFFIX, *_PREFIX, 0)], dtype=np.uint32)


def many_slots(words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """``slots`` of many words ``(n, OWN)``, filled up with ``SLOTS``, and their slots as neighbours ``(n,)``."""
    own, near = np.full((len(words), OWN), SLOTS, dtype=np.int32), np.zeros(len(words), dtype=np.int32)
    if not len(words):
        return own, near
    _, offsets, data = words.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[words.offset:words.offset + len(words) + 1]
    data = np.frombuffer(data, dtype=np.uint8)[:offsets[-1]]
    size = np.diff(offsets)
    for i in np.flatnonzero(size > SHORT).tolist():
        found = slots(word := words[i].as_py())
        own[i, :len(found)], near[i] = found, neighbour(word)
    some = np.argsort(np.minimum(size, SHORT + 1).astype(np.uint8), kind="stable")[::-1]
    some = some[size[some] <= SHORT]  # longer ones first
    first, size = offsets[some], size[some]
    column = np.arange(len(some))
    begins = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # of every letter
    letter = np.searchsorted(begins, offsets)
    letter, n = letter[some], np.diff(letter)[some]

    def reach(k: int | np.ndarray) -> np.ndarray:
        """Bytes of a word's first ``k`` letters."""
        return np.where(k < n, begins[np.minimum(letter + k, len(begins) - 1)] - first, size)

    state = np.zeros((SHORT + 1, len(some)), dtype=np.uint32)  # registers after each byte
    for j, c in enumerate(np.searchsorted(-size, -np.arange(SHORT)).tolist()):  # words of more than j bytes
        state[j + 1, :c] = _BYTE[(state[j, :c] ^ data[first[:c] + j]) & 255] ^ (state[j, :c] >> 8)
    at = reach(np.maximum(n - 3, 0))
    suffix, left = np.zeros(len(some), dtype=np.uint32), size - at
    for j in range(int(left.max(initial=0))):
        b = data[np.minimum(first + at + j, len(data) - 1)]
        suffix = np.where(j < left, _BYTE[(suffix ^ b) & 255] ^ (suffix >> 8), suffix)
    whole = state[size, column]
    own[some, 0] = (whole ^ _ZEROS[0, size]) % SLOTS
    own[some, 1] = (suffix ^ _ZEROS[1, left]) % SLOTS
    own[some, 2] = np.array(_LENGTH)[np.minimum(n, 12)]
    for i in range(len(_PREFIX)):
        upto = reach(3 + i)
        own[some, 3 + i] = np.where(n > 3 + i, (state[upto, column] ^ _ZEROS[2 + i, upto]) % SLOTS, SLOTS)
    near[some] = (whole ^ _ZEROS[-1, size]) % SLOTS
    return own, near


#: Letters whose lower case depends on the others of a word, or is more than one letter: capital sigma, dotted I.
_ODD = (0x3A3, 0x130)


@functools.cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Whether a code point is part of words, and its lower case (``_ODD`` ones stay)."""
    lower = np.arange(0x110000, dtype=np.uint32)
    every = lower.tobytes().decode("utf-32-le", "surrogatepass")
    found = np.zeros(len(every), dtype=bool)
    for m in WORD.finditer(every):
        found[m.start():m.end()] = True
    for c in np.flatnonzero(found).tolist():
        if c not in _ODD:
            lower[c] = ord(every[c].lower())
    return found, lower


class Words(NamedTuple):
    """Words of some texts one after the other.

    ``distinct`` are the different lower-cased ones, in the order in which
    they are met (but for ``_ODD`` letters), ``number`` says which each word
    is, ``ends`` where texts begin and end among the words, ``start`` and
    ``end`` are code points in the text.
    """
    distinct: pa.LargeStringArray
    number: np.ndarray
    ends: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def names(self) -> list[str]:
        return self.distinct.to_numpy(zero_copy_only=False).tolist()


def _strings(letters: np.ndarray, ends: np.ndarray) -> pa.LargeStringArray:
    """Words that end before ``ends`` in the code points ``letters``."""
    raw = letters.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    begins = np.append(np.flatnonzero((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80), len(raw))
    offsets = np.concatenate([[0], begins[ends]]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(raw))


def cut(texts: list[str]) -> Words:
    """What ``WORD`` finds in each text, in the order of the texts."""
    found, lower = _letters()
    points = np.frombuffer("\n".join(texts).encode("utf-32-le"), dtype="<u4")
    inside = found[points]
    start, end = np.flatnonzero(np.diff(inside, prepend=False, append=False)).reshape(-1, 2).T
    before = np.cumsum([0, *(len(t) + 1 for t in texts)])
    ends = np.searchsorted(start, before)
    letters = lower[points[inside]]
    letters = letters.astype(np.min_scalar_type(letters.max(initial=0)))  # as few bytes as they take
    offsets = letters.itemsize * np.cumsum(np.concatenate([[0], end - start]))
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    coded = coded.dictionary_encode()
    number = coded.indices.to_numpy()
    _, offsets, data = coded.dictionary.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[:len(coded.dictionary) + 1] // letters.itemsize
    different = np.frombuffer(data, dtype=letters.dtype)[:offsets[-1]]
    distinct = _strings(different, offsets[1:])
    if np.isin(different, _ODD).any():
        again: dict[str, int] = {}
        number = np.array([again.setdefault(w.lower(), len(again)) for w in distinct.to_pylist()])[number]
        distinct = pa.array(list(again), pa.large_string())
    shift = np.repeat(before[:-1], np.diff(ends))
    return Words(distinct, number, ends, start - shift, end - shift)


def runs(texts: list[str]) -> Iterator[list[str]]:
    """The texts in runs of about ``RUN`` code points."""
    run, held = [], 0
    for text in texts:
        run.append(text)
        held += len(text)
        if held >= RUN:
            yield run
            run, held = [], 0
    if run:
        yield run


class Model(NamedTuple):
    """Own-word weights, neighbour weights (before, after), transitions, start, and the score curve."""
    own: np.ndarray
    around: np.ndarray
    trans: np.ndarray
    curve: np.ndarray


def messages(emission: np.ndarray, trans: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over chains of toxic-label scores (clean scores are 0), in odds of toxic.

    The i-th chain stands from ``ends[i]`` to ``ends[i + 1]``. Returns the
    odds that each score stands for, the forward messages (they hold the
    word's own odds) and the backward messages; a word's marginal odds are the
    product of the last two. The sums are exact from the first word to the
    last; odds stay finite, since a word's own are kept in e**±50.

    Chains go from the longest to the shortest, and one operation takes a step
    in all that are that long; past the steps that ``BREADTH`` of them have,
    the longest go on word by word.
    """
    odds = np.exp(np.clip(emission, -50, 50))
    (stay, enter), (leave, remain) = np.exp(np.clip(trans, -30, 30)).tolist()
    ahead, back = odds.copy(), np.ones(len(odds))
    size = np.diff(ends)
    order = np.argsort(-size, kind="stable")
    steps = int(size[order[BREADTH - 1]]) if len(size) >= BREADTH else 0
    rest = [(int(ends[i]) + steps, int(ends[i + 1])) for i in order[:BREADTH] if size[i] > steps]
    for a, z in rest:
        b = 1.0
        x = odds[a:z].tolist() if steps else odds[a + 1:z].tolist()
        found = [b]
        found += [b := (leave + v * b * remain) / (stay + v * b * enter) for v in reversed(x)]
        back[z - len(found):z] = found[::-1]
    if steps:
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        step = np.arange(len(odds)) - np.repeat(ends[:-1], size)
        some = np.flatnonzero(step < steps)
        count = len(size) - np.searchsorted(size[order[::-1]], np.arange(steps), side="right")
        first = np.cumsum([0, *count])
        place = first[step[some]] + np.repeat(rank, size)[some]  # step by step, chains by rank
        own, f, b = np.empty(len(some)), np.empty(len(some)), np.empty(len(some))
        own[place] = f[place] = odds[some]
        b[place] = back[some]
        first, count = first.tolist(), count.tolist()
        for t in range(1, steps):
            last, here = f[first[t - 1]:first[t - 1] + count[t]], slice(first[t], first[t + 1])
            f[here] = own[here] * (enter + last * remain) / (stay + last * leave)
        for t in range(steps - 1, 0, -1):
            here = slice(first[t], first[t + 1])
            both = own[here] * b[here]
            b[first[t - 1]:first[t - 1] + count[t]] = (leave + both * remain) / (stay + both * enter)
        ahead[some], back[some] = f[place], b[place]
    for a, z in rest:
        x = odds[a:z].tolist()
        f, x = (float(ahead[a - 1]), x) if steps else (x[0], x[1:])
        ahead[z - len(x):z] = [f := v * (enter + f * remain) / (stay + f * leave) for v in x]
    return odds, ahead, back


def joined(ends: np.ndarray) -> np.ndarray:
    """Places of the words that have one before them in their chain."""
    goes_on = np.ones(ends[-1] + 1, dtype=bool)
    goes_on[ends] = False
    return np.flatnonzero(goes_on)


def marginals(emission: np.ndarray, trans: np.ndarray, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Toxic marginal of every word of some chains (of one without ``ends``), and the pair marginals summed over places ``(2, 2)``."""
    ends = np.array([0, len(emission)]) if ends is None else ends
    odds, ahead, back = messages(emission, trans, ends)
    later = joined(ends)
    before, after = ahead[later - 1], odds[later] * back[later]
    (stay, enter), (leave, remain) = np.exp(np.clip(trans, -30, 30)).tolist()
    pair = np.stack([np.full(len(later), stay), enter * after, before * leave, before * remain * after])
    return 1 - 1 / (1 + ahead * back), (pair / pair.sum(axis=0)).sum(axis=1).reshape(2, 2)


class Lookup:
    """Emission of words under a model."""

    def __init__(self, model: Model):
        self.model = model
        self.own = np.append(model.own, 0.0)

    def emission(self, words: Words) -> np.ndarray:
        """Toxic-label score of every word of the texts: its own, and what its neighbours in its text say."""
        own, near = many_slots(words.distinct)
        number, (before, after) = words.number, self.model.around[:, near]
        own = [self.own[own[:, k]] for k in range(OWN)]
        score = (own[0] + functools.reduce(np.add, own[1:]))[number]
        later = joined(words.ends)
        score[later] += before[number[later - 1]]
        score[later - 1] += after[number[later]]
        return score


def lookup(sent) -> Lookup:
    """The worker's look-up for a broadcast ``(name, *model)``, kept until another model comes."""
    name, *model = sent.value
    return kept(("lookup", name), lambda: Lookup(Model(*model)))


def evidence(p: np.ndarray, different: int) -> tuple[float, float, float, float]:
    """What a document's curve looks at: expected toxic words (log), the surest one, their share, different ones (log)."""
    if not len(p):
        return 0.0, 0.0, 0.0, 0.0
    total = p.sum()
    return float(np.log1p(total)), float(p.max()), float(min(1.0, 20 * (total / len(p)))), float(np.log1p(different))


def judge(texts: list[str], look: Lookup) -> Iterator[tuple[tuple[float, float, float, float], list[tuple[int, int]]]]:
    """Each text's ``evidence`` and the code point ranges of its toxic words, one chain a text."""
    for run in runs(texts):
        words = cut(run)
        _, ahead, back = messages(look.emission(words), look.model.trans, words.ends)
        p = 1 - 1 / (1 + ahead * back)
        toxic = np.flatnonzero(p >= 0.5)
        ends, cuts = words.ends.tolist(), np.searchsorted(toxic, words.ends).tolist()
        spans = list(zip(words.start[toxic].tolist(), words.end[toxic].tolist()))
        number = words.number[toxic].tolist()
        for a, b, c, d in zip(ends, ends[1:], cuts, cuts[1:]):
            yield evidence(p[a:b], len(set(number[c:d]))), spans[c:d]


def cover(found: list[list[str]], least: int = 3) -> set[str]:
    """Greedy cover of documents by their features.

    The next feature is the one in most documents not yet explained (of
    equals whole words, then the longest); it needs ``least`` of them.
    """
    where: dict[str, set[int]] = {}
    for k, features in enumerate(found):
        for f in features:
            where.setdefault(f, set()).add(k)
    chosen = set()
    while where:
        best = max(where, key=lambda f: (len(where[f]), f.startswith("w="), len(f), f))
        if len(where[best]) < least:
            break
        chosen.add(best)
        explained = where.pop(best)
        where = {f: rest for f, ks in where.items() if (rest := ks - explained)}
    return chosen


class Vocabulary:
    """Numbers of lower-cased words, with the slots of their own features and as neighbours."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.own = np.zeros((0, OWN), dtype=np.int32)
        self.near = np.zeros(0, dtype=np.int32)

    def numbers(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Word numbers of each text; new words are numbered as they come."""
        for run in runs(texts):
            words, known = cut(run), len(self.number)
            found = np.array([self.number.setdefault(w, len(self.number)) for w in words.names()], dtype=np.int32)
            own, near = many_slots(words.distinct.filter(pa.array(found >= known)))
            self.own, self.near = np.concatenate([self.own, own]), np.concatenate([self.near, near])
            flat = found[words.number]
            yield from (flat[a:b] for a, b in zip(words.ends, words.ends[1:]))

    def marked(self, sets: list[frozenset[str]]) -> list[np.ndarray]:
        """For each set of features, whether a word has one of them."""
        marked = [np.zeros(len(self.number), dtype=bool) for _ in sets]
        every = frozenset().union(*sets)
        for i, word in enumerate(self.number):
            features = word_features(word)
            if not every.isdisjoint(features):
                for found, some in zip(marked, sets):
                    found[i] = not some.isdisjoint(features)
        return marked


def _numbered(values: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Different ones of some numbers below ``most``, in order, and which of them each is."""
    met = np.zeros(most, dtype=bool)
    met[values] = True
    different = np.flatnonzero(met)
    which = np.empty(most, dtype=np.int64)
    which[different] = np.arange(len(different))
    return different, which[values]


class Learner:
    """Gradient steps (AdaGrad) on the log likelihood of labelled chains."""

    def __init__(self, words: Vocabulary, marked: np.ndarray):
        self.words = words
        self.marked = marked
        self.weights = [np.zeros(SLOTS + 1), np.zeros(2 * SLOTS), np.zeros(4)]  # own, before and after, transitions
        self.squares = [np.zeros_like(w) for w in self.weights]

    def learn(self, chains: list[tuple[np.ndarray, bool]]) -> None:
        """A pass over ``(word numbers, label)``, a step whenever ``STEP`` words are full."""
        waiting, size = [], 0
        for chain in chains:
            if len(chain[0]):
                waiting.append(chain)
                size += len(chain[0])
            if size >= STEP:
                self.step(waiting)
                waiting, size = [], 0
        if waiting:
            self.step(waiting)

    def step(self, chains: list[tuple[np.ndarray, bool]]) -> None:
        """One step over some texts; words that mark toxic texts are toxic in those alone."""
        own, around, flat_trans = self.weights
        trans = flat_trans.reshape(2, 2)
        used, at = _numbered(np.concatenate([ids for ids, _ in chains]), len(self.words.near))
        flat, near, marked = self.words.own[used], self.words.near[used], self.marked[used]
        word, before, after = own[flat].sum(axis=1), around[near], around[SLOTS + near]
        size = [len(ids) for ids, _ in chains]
        ends = np.cumsum([0, *size])
        later = joined(ends)
        score = word[at]
        score[later] += before[at[later - 1]]
        score[later - 1] += after[at[later]]
        p, pair = marginals(score, trans, ends)
        gold = marked[at] & np.repeat([label for _, label in chains], size)
        err = gold - p
        change = np.bincount(2 * gold[later - 1] + gold[later], minlength=4).reshape(2, 2) - pair
        left, right = np.zeros(len(at)), np.zeros(len(at))
        left[later - 1] = err[later]  # what a word says of the next one, and of the one before
        right[later] = err[later - 1]
        n = len(used)
        by_word, left, right = (np.bincount(at, x, n) for x in (err, left, right))
        own_slots, own_of = _numbered(flat.ravel(), SLOTS + 1)
        near_slots, near_of = _numbered(near, SLOTS)
        self._move(0, own_slots, np.bincount(own_of, np.repeat(by_word, flat.shape[1])))
        self._move(1, near_slots, np.bincount(near_of, left))
        self._move(1, SLOTS + near_slots, np.bincount(near_of, right))
        self._move(2, np.arange(4), change.ravel())
        own[SLOTS] = 0.0

    def _move(self, kind: int, where: np.ndarray, grad: np.ndarray) -> None:
        w, squares = self.weights[kind], self.squares[kind]
        grad = grad - DECAY * w[where]
        squares[where] = sums = squares[where] + grad * grad
        w[where] += RATES[kind] * grad / (np.sqrt(sums) + 1e-6)


def fit_curve(seen: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Logistic weights (of the evidence, then a constant) by Newton steps with a small penalty."""
    x = np.concatenate([seen, np.ones((len(seen), 1))], axis=1)
    w = np.zeros(x.shape[1])
    if not len(seen):
        return w
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
        grad = x.T @ (labels - p) - 0.05 * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _sample(docs: DataFrame, labels: DataFrame, train: Column, id_col: str, text_col: str, label_col: str,
            most: int, folder: str) -> DataFrame:
    """``(label, text, fold, h, shard)`` of at most ``most`` labelled documents that ``train`` (a condition on ``doc_id``) allows."""
    known = (labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label"))
             .where(F.col("label").isNotNull() & F.col("doc_id").isNotNull()).where(train)
             .groupBy("doc_id").agg(F.max("label").alias("label")))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # at most ``most`` rows travel to all tasks
    texts = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")  # of repeated ids one text, by hash
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(one)
    key = F.xxhash64(F.lit("shard"), "text")
    return stage(found.select("label", "t.text", F.pmod(F.xxhash64("t.text"), F.lit(FOLDS)).cast("int").alias("fold"))
                 .withColumn("h", key).withColumn("shard", F.pmod("h", F.lit(SHARDS)).cast("int"))
                 .repartitionByRange(SHARDS, "shard").sortWithinPartitions("shard", "h", "label"), folder, "sample")


def _contexts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(feature, context, fold)``, distinct among some texts; a context is a word's two neighbours, a fold a bit."""
    def batch(found: set) -> pa.RecordBatch:
        features, contexts, folds = zip(*found) if found else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(features, pa.string()), pa.array(contexts, pa.int64()), pa.array(folds, pa.int32())],
                                          names=["f", "context", "bit"])

    for b in it:
        found = set()
        for text, fold in zip(b.column(0), b.column(1).to_pylist()):
            if len(found) >= HELD:
                yield batch(found)
                found = set()
            words = ["", *(w.lower() for w in WORD.findall(text.as_py())), ""]
            for before, word, after in zip(words, words[1:], words[2:]):
                context = zlib.crc32(f"{before} {after}".encode("utf-8"))
                found.update((f, context, 1 << fold) for f in word_features(word))
        yield batch(found)


def _features(it: Iterator[pa.RecordBatch], wanted: frozenset[str]) -> Iterator[pa.RecordBatch]:
    """The ``wanted`` word features of each text, with its fold."""
    for b in it:
        found = []
        for text in b.column(0):
            own = {f for w in {w.lower() for w in WORD.findall(text.as_py())} for f in word_features(w)}
            found.append(sorted(own & wanted))
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string())), b.column(1)], names=["features", "fold"])


def _occurrences(it: Iterator[pa.RecordBatch], wanted: frozenset[str]) -> Iterator[pa.RecordBatch]:
    """``(f, fold, n)``: how often the ``wanted`` word features occur; the empty feature stands for every word."""
    for b in it:
        words: dict[int, Counter] = {}
        for text, fold in zip(b.column(0), b.column(1).to_pylist()):
            words.setdefault(fold, Counter()).update(w.lower() for w in WORD.findall(text.as_py()))
        rows = []
        for fold, counts in words.items():
            found = Counter({"": counts.total()})
            for word, n in counts.items():
                for f in wanted.intersection(word_features(word)):
                    found[f] += n
            rows += [(f, fold, n) for f, n in found.items()]
        f, fold, n = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(f, pa.string()), pa.array(fold, pa.int32()), pa.array(n, pa.int64())],
                                         names=["f", "fold", "n"])


def _learn(it: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """``(variant, place, weight)``: the weights that each shard's documents moved, for every set of features.

    A task holds its shards' words as numbers (the sample bounds them).
    """
    words, shards = Vocabulary(), {}
    for b in it:
        labels, texts, folds, of = (b.column(k).to_pylist() for k in range(4))
        for label, ids, fold, shard in zip(labels, words.numbers(texts), folds, of):
            shards.setdefault(shard, []).append((ids, bool(label), fold))
    marked = words.marked(sent.value)
    for chains in shards.values():
        for variant, toxic in enumerate(sent.value):
            if not toxic:
                continue
            learner = Learner(words, marked[variant])
            own = [(ids, label) for ids, label, fold in chains if fold != variant - 1]
            for _ in range(PASSES):
                learner.learn(own)
            flat = np.concatenate([learner.weights[0][:SLOTS], *learner.weights[1:]])
            moved = np.nonzero(np.concatenate([learner.squares[0][:SLOTS], *learner.squares[1:]]))[0].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(moved), variant, dtype=np.int32)), pa.array(moved),
                                              pa.array(flat[moved])], names=["variant", "place", "weight"])


def _evidence(it: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    look = lookup(sent)
    for b in it:
        seen = [found for found, _ in judge(b.column(1).to_pylist(), look)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([list(x) for x in seen], pa.list_(pa.float64()))],
                                         names=["label", "seen"])


def _toxic_features(sample: DataFrame, folder: str) -> list[frozenset[str]]:
    """Features that mark toxic words, from the whole sample and from it without each fold.

    Support is the number of different contexts in toxic texts, so copies of
    a text give its words one vote; clean texts count once each. A feature
    with ``STRONG`` contexts counts if clean texts never have it, or if its
    rate per word, less two standard deviations, is ``RATE`` times theirs:
    how often a word occurs at all must not matter. One of the latter alone
    says little: how many do is learned by the curve. What is collected here
    is bounded by the sample's texts. Toxic texts without a feature are
    covered by weaker ones that clean texts never have.
    """
    toxic, clean = (sample.where(F.col("label") == label).select("text", "fold") for label in (1, 0))
    kept = [(1 << FOLDS) - 1, *((1 << FOLDS) - 1 - (1 << k) for k in range(FOLDS))]  # folds of each variant, as bits
    contexts = toxic.mapInArrow(_contexts, "f string, context long, bit int").groupBy("f", "context").agg(F.bit_or("bit").alias("bits"))
    contexts = stage(contexts.groupBy("f").agg(*(F.count_if(F.col("bits").bitwiseAND(m) != 0).alias(f"v{v}") for v, m in enumerate(kept))),
                     folder, "contexts")
    columns = [f"v{v}" for v in range(len(kept))]
    toxic_words = contexts.where(F.col("f").startswith("w=")).agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in columns)).first()
    support = {r["f"]: r[1:] for r in contexts.where("v0 >= 3").select("f", *columns).collect()}
    wanted = frozenset(support)
    met = clean.distinct().mapInArrow(lambda it: _occurrences(it, wanted), "f string, fold int, n long").groupBy("f").agg(*(
        F.sum(F.when(F.lit(m).bitwiseAND(F.expr("shiftleft(1, fold)")) != 0, F.col("n")).otherwise(0)) for m in kept))
    against = {r["f"]: r[1:] for r in met.collect()}  # those wanted, and the total
    none = (0,) * len(kept)
    clean_words = against.get("", none)
    pure, strong = [], []
    for v in range(len(kept)):
        held = {f: n[v] for f, n in support.items() if n[v] >= 3}
        pure.append({f for f in held if not against.get(f, none)[v]})
        often = {f for f, n in held.items()
                 if (n - 2 * n ** 0.5) * clean_words[v] >= RATE * (against.get(f, none)[v] + 1) * toxic_words[v]}
        strong.append({f for f in pure[v] | often if held[f] >= STRONG})
    useful = frozenset().union(*pure, *strong)
    found = toxic.mapInArrow(lambda it: _features(it, useful), "features array<string>, fold int").collect()
    return [frozenset(strong[v] | cover([[f for f in r["features"] if f in pure[v]] for r in found
                                         if m >> r["fold"] & 1 and strong[v].isdisjoint(r["features"])]))
            for v, m in enumerate(kept)]


def train_chains(sample: DataFrame, toxic: list[frozenset[str]], folder: str) -> list[Model]:
    """Chains from ``sample`` for each set of features (the first of all folds, then without each), without a curve.

    A weight is the average over the shards whose documents moved it. Shards
    go by a hash of the text and are read in its order, so runs agree.
    """
    sent = sample.sparkSession.sparkContext.broadcast(toxic)
    moved = sample.select("label", "text", "fold", "shard").mapInArrow(lambda it: _learn(it, sent), "variant int, place int, weight double")
    mean = stage(moved.groupBy("variant", "place").agg(F.avg("weight").alias("weight")), folder, "weights")
    models = []
    for variant in range(len(toxic)):
        found = mean.where(F.col("variant") == variant).select("place", "weight").toArrow()  # a row per weight
        flat = np.zeros(3 * SLOTS + 4)
        flat[found.column("place").to_numpy()] = found.column("weight").to_numpy()
        own, before, after, trans = np.split(flat, [SLOTS, 2 * SLOTS, 3 * SLOTS])
        models.append(Model(own, np.stack([before, after]), trans.reshape(2, 2), np.zeros(5)))
    return models


def send(model: Model, spark: SparkSession):
    """A broadcast of a model under a name of its own."""
    return spark.sparkContext.broadcast((uuid.uuid4().hex, *model))


def fit(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", sample_docs: int = SAMPLE_DOCS) -> Model:
    """A model from the labelled documents that ``train`` allows (a condition on ``doc_id``).

    Null labels and ids are left out; of contradicting labels of an id the
    toxic one counts. Without toxic examples every text scores alike.
    """
    folder = work_dir(docs.sparkSession)
    sample = _sample(docs, labels, train, id_col, text_col, label_col, sample_docs, folder)
    model, *without = train_chains(sample, _toxic_features(sample, folder), folder)
    seen = []
    for k, blind in enumerate(without):
        sent = send(blind, docs.sparkSession)
        judged = sample.where(F.col("fold") == k).select("label", "text")
        seen += judged.mapInArrow(lambda it: _evidence(it, sent), "label int, seen array<double>").collect()
    seen.sort(key=lambda r: (r["label"], r["seen"]))
    curve = fit_curve(np.array([r["seen"] for r in seen]).reshape(-1, 4), np.array([r["label"] for r in seen], dtype=float))
    return model._replace(curve=curve)


SCORED = "struct<score: double, spans: array<struct<start: int, end: int>>>"
ARROW_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _score(texts: pa.Array, look: Lookup) -> pa.Array:
    rows = []
    for found, spans in judge([t or "" for t in texts.to_pylist()], look):
        x = float(np.dot((*found, 1.0), look.model.curve))
        rows.append({"score": 1 / (1 + np.exp(-min(60.0, max(-60.0, x)))), "spans": [{"start": a, "end": b} for a, b in spans]})
    return pa.array(rows, pa.struct([("score", pa.float64()), ("spans", ARROW_SPANS)]))


def toxicity(model: Model, spark: SparkSession) -> Callable[[Column], Column]:
    """A function of a text column giving ``(score, spans)``: 0 to 1, and the code point ranges of toxic words.

    Null texts count as empty; a text without words has the score of one
    without toxic words.
    """
    sent = send(model, spark)

    def score(texts: pa.Array) -> pa.Array:
        return _score(texts, lookup(sent))

    score.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(score, SCORED)


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, columns as they came."""
    scored, = fresh(docs, "_scored")
    judged = docs.withColumn(scored, toxicity(model, docs.sparkSession)(text_of(text_col)))
    return judged.where(F.col(scored)["score"] < threshold).drop(scored)
