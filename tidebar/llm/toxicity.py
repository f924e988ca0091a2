"""Toxicity by a factorization machine over hashed terms.

The score of a text is a bias, a weight for each distinct term, and for each pair of terms the dot product of their
factors, so that two terms can mean more together than their weights add up to. Texts become hashed terms on the
executors; the machine is fitted in one task on a sample of labelled rows whose size is a parameter, and goes to the
scoring tasks as a broadcast of at most ``2**bits`` weights and factors.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import share_of_hash, sole_caches

SAMPLE_ROWS = 16_384  # labelled rows to fit on: about the bound of what the fitting task gets
BITS = 18
LEAST_ROWS, LEAST_SHARE = 3, 1 / 512  # terms in fewer than these rows have no weight; in a smaller share only if they lean by RARE
RARE = 6.0  # standard deviations, less half a row
WEIGHED, PAIRED = 3.0, 3.0  # standard deviations a term leans from chance to have a weight of its own, and to form pairs
TOGETHER, MET = 6.0, 8  # deviations that a pair leans beyond the likelier of its terms, and marked rows that it is in, to be a pair of its own
PAIR_TERMS = 1 << 13  # terms among which pairs are looked for: those in most marked rows of the sample
PULL = 0.7  # length along its own direction that the terms of such a pair start with
COMMON_SHARE = 1 / 20  # terms in more rows than this count less, down to nothing for one that is everywhere
STEMS = (4, 5)  # first letters of a word that are terms as well, for inflected and compound words
FACTORS = 8
EPOCHS = 12
CACHED_WORDS = 1 << 19
_WORD = re.compile(r"[^\W\d_]+")
MODEL = "term int, value float, weight float, factors array<float>"


class Terms(dict):
    """Words to the hashed terms they bring (the word and its stems), with a bounded memory."""

    def __init__(self, bits: int):
        super().__init__()
        self.mask = (1 << bits) - 1

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHED_WORDS:
            self.clear()
        names = [word, *(f"{n} {word[:n]}" for n in STEMS if len(word) > n)]
        self[word] = terms = tuple(zlib.crc32(x.encode("utf-8", "surrogatepass")) & self.mask for x in names)
        return terms

    def of(self, text: str | None) -> list[int]:
        """The distinct terms of a whole text."""
        return sorted(set(chain.from_iterable(map(self.__getitem__, set(_WORD.findall(text.lower())))))) if text else []


@lru_cache(maxsize=2)
def _terms(bits: int) -> Terms:
    return Terms(bits)


def _featurise(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    terms = _terms(bits)
    for batch in batches:
        found = pa.array([terms.of(t.as_py()) for t in batch.column("text")], pa.list_(pa.int32()))
        yield pa.record_batch([batch.column("label"), found], names=["label", "terms"])


class Machine:
    """Factorization machine of order two for a binary label."""

    def __init__(self, size: int, factors: int = FACTORS, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.bias = np.zeros(1)
        self.weight = np.zeros(size)
        self.alone = np.ones(size)  # 0 where a term has no weight of its own
        self.factors = draw.normal(0, 0.02, (size, factors))

    def pull(self, pairs: np.ndarray, seed: int = 5) -> None:
        """Start the terms of each pair along a direction that they share; a term that has one already passes it on."""
        draw, given = np.random.default_rng(seed), set()
        for a, b in pairs.tolist():
            new = [t for t in (a, b) if t not in given]
            old = [t for t in (a, b) if t in given]
            if not new:
                continue
            step = draw.normal(size=self.factors.shape[1])
            step = self.factors[old[0]].copy() if old else PULL * step / np.linalg.norm(step)
            for t in new:
                self.factors[t] = step
            given.update(new)

    def margins(self, term: np.ndarray, value: np.ndarray, starts: np.ndarray):
        """Score before the logistic of each row; ``starts`` are the first entries of the rows, none of them empty."""
        scaled = self.factors[term] * value[:, None]
        total = np.add.reduceat(scaled, starts, axis=0)
        pairs = 0.5 * (np.square(total) - np.add.reduceat(np.square(scaled), starts, axis=0)).sum(axis=1)
        return self.bias[0] + np.add.reduceat(self.weight[term] * value, starts) + pairs, scaled, total

    def fit(self, label: np.ndarray, term: np.ndarray, value: np.ndarray, ptr: np.ndarray, epochs: int = EPOCHS,
            batch: int = 128, rate: float = 0.08, decay: float = 1e-3, seed: int = 11) -> None:
        """Adaptive gradient steps on the logistic loss with weight decay, in small random batches."""
        draw, rows = np.random.default_rng(seed), np.flatnonzero(np.diff(ptr) > 0)
        seen = [np.full_like(x, 1e-6) for x in (self.bias, self.weight, self.factors)]
        for _ in range(epochs):
            draw.shuffle(rows)
            for lo in range(0, len(rows), batch):
                some = rows[lo:lo + batch]
                n = ptr[some + 1] - ptr[some]
                starts = np.cumsum(n) - n
                at = np.repeat(ptr[some] - starts, n) + np.arange(n.sum())
                t, x = term[at], value[at]
                margin, scaled, total = self.margins(t, x, starts)
                miss = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - label[some]
                each = np.repeat(miss, n)
                near, inverse = np.unique(t, return_inverse=True)
                linear = self.alone[near] * np.bincount(inverse, each * x) / len(some) + decay * self.weight[near]
                cross = (np.repeat(total, n, axis=0) - scaled) * (each * x)[:, None]
                slope = np.stack([np.bincount(inverse, cross[:, f]) for f in range(cross.shape[1])], axis=1) / len(some) + decay * self.factors[near]
                for place, gradient, past, held in (
                    (near, linear, seen[1], self.weight), (near, slope, seen[2], self.factors), (np.zeros(1, int), np.array([miss.mean()]), seen[0], self.bias),
                ):
                    past[place] += np.square(gradient)
                    held[place] -= rate * gradient / np.sqrt(past[place])


def leaning_pairs(label: np.ndarray, flat: np.ndarray, sizes: np.ndarray, usable: np.ndarray) -> np.ndarray:
    """Pairs of terms that are marked far more often together than the likelier of them is, strongest first.

    Each term is a bit set of its rows, so a pair costs a few words of bits: first over marked rows only, which leaves few pairs.
    """
    marked = np.flatnonzero(label > 0)
    row = np.repeat(np.arange(len(sizes)), sizes)
    new = np.full(len(label), -1)
    new[marked] = np.arange(len(marked))
    seen = new[row] >= 0
    often = np.bincount(flat[seen], minlength=len(usable))
    terms = np.flatnonzero(usable & (often >= MET))
    terms = np.sort(terms[np.argsort(-often[terms], kind="stable")[:PAIR_TERMS]])
    if len(terms) < 2:
        return np.empty((0, 2), np.int64)
    place = np.full(len(usable), -1)
    place[terms] = np.arange(len(terms))

    def bits(of: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        table = np.zeros((len(terms), -(-n // 64)), np.uint64)
        np.bitwise_or.at(table, (place[of], at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
        return table

    known = place[flat] >= 0
    few, whole = bits(flat[known & seen], new[row[known & seen]], len(marked)), bits(flat[known], row[known], len(label))
    rate = (often[terms] + 0.5) / (np.bitwise_count(whole).sum(axis=1) + 1.0)
    out, strength = [], []
    for i in range(len(terms) - 1):
        met = np.bitwise_count(few[i] & few[i + 1:]).sum(axis=1)
        j = i + 1 + np.flatnonzero(met >= MET)
        if len(j):
            both = np.bitwise_count(whole[i] & whole[j]).sum(axis=1)
            r = np.minimum(np.maximum(rate[i], rate[j]), 0.999)
            lean = (met[j - i - 1] - 0.5 - both * r) / np.sqrt(both * r * (1 - r))
            j, lean = j[lean >= TOGETHER], lean[lean >= TOGETHER]
            out += [(terms[i], terms[x]) for x in j]
            strength += lean.tolist()
    order = np.argsort(-np.array(strength), kind="stable")
    return np.array(out, np.int64).reshape(-1, 2)[order]


def _fit(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    label, terms = [], []
    for batch in batches:
        label += batch.column("label").to_pylist()
        terms += [np.array(t.as_py(), np.int64) for t in batch.column("terms")]
    if not label:
        return
    order = sorted(range(len(label)), key=lambda i: (label[i], terms[i].tobytes()))  # the same for any partitioning
    label, terms = np.array([label[i] for i in order], float), [terms[i] for i in order]
    flat = np.concatenate(terms)
    rows = np.bincount(flat, minlength=1 << bits)
    active = rows >= LEAST_ROWS
    value = np.where(active, np.minimum(np.log(len(label) / np.maximum(rows, 1)) / -np.log(COMMON_SHARE), 1), 0)
    share = np.clip(label.mean(), 1e-4, 1 - 1e-4)
    marked = np.bincount(flat, np.repeat(label, [len(t) for t in terms]), minlength=1 << bits)
    lean = np.abs(marked - rows * share) / np.sqrt(np.maximum(rows, 1) * share * (1 - share))
    sure = lean - 0.5 / np.sqrt(np.maximum(rows, 1) * share * (1 - share)) >= RARE
    usable = active & (value > 0)
    active = usable & np.where(rows >= LEAST_SHARE * len(label), lean >= PAIRED, sure)
    pairs = leaning_pairs(label, flat, np.array([len(t) for t in terms]), usable)
    active[pairs.ravel()] = True  # terms that say nothing apart have no weight, but factors
    kept = active[flat]
    ptr = np.concatenate([[0], np.cumsum([int(active[t].sum()) for t in terms])])
    machine = Machine(1 << bits)
    machine.alone = (lean >= WEIGHED).astype(float)
    machine.bias[0] = np.log(share / (1 - share))
    machine.pull(pairs)
    machine.fit(label, flat[kept], value[flat[kept]], ptr)
    at = np.flatnonzero(active)
    yield pa.record_batch(
        [
            pa.array([-1, *at], pa.int32()), pa.array([1.0, *value[at]], pa.float32()),
            pa.array([machine.bias[0], *machine.weight[at]], pa.float32()),
            pa.array([[], *machine.factors[at].tolist()], pa.list_(pa.float32())),
        ],
        names=["term", "value", "weight", "factors"],
    )


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_rows: int = SAMPLE_ROWS, bits: int = BITS):
    """Fit on about ``sample_rows`` of the labelled rows, chosen by a hash of their id; None if there are none.

    Null ids and labels are left out; of conflicting labels of one document the higher counts.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("double").alias("label"))
    share = min(1.0, sample_rows / max(known.count(), 1))
    known = known.where(share_of_hash(F.xxhash64("doc_id"), share))
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # sample_rows rows
    found = rows.select("label", "text").mapInArrow(lambda it: sole_caches(_featurise(it, bits), _terms(bits)), "label double, terms array<int>")
    model = found.repartition(1).mapInArrow(lambda it: _fit(it, bits), MODEL).toArrow()  # 2**bits rows at most
    if not model.num_rows:
        return None
    term = model["term"].to_numpy()
    machine, value = Machine(1 << bits), np.zeros(1 << bits)
    machine.factors[:] = 0
    machine.bias[0] = model["weight"].to_numpy()[term == -1][0]
    inside = term >= 0
    value[term[inside]] = model["value"].to_numpy()[inside]
    machine.weight[term[inside]] = model["weight"].to_numpy()[inside]
    if inside.any():
        machine.factors[term[inside]] = np.array([f for f in model["factors"].to_pylist() if f])
    machine.weight, machine.factors = machine.weight.astype(np.float32), machine.factors.astype(np.float32)
    return machine, value.astype(np.float32)


def _score(batches: Iterator[pa.RecordBatch], model, bits: int) -> Iterator[pa.RecordBatch]:
    terms = _terms(bits)
    for batch in batches:
        scores = []
        for text in batch.column("text"):
            if model is None:
                scores.append(0.0)
                continue
            machine, value = model
            term = np.array(terms.of(text.as_py()), np.int64)
            term = term[value[term] > 0] if len(term) else term
            margin = machine.margins(term, value[term], np.zeros(1, int))[0][0] if len(term) else machine.bias[0]
            scores.append(float(1 / (1 + np.exp(-np.clip(margin, -30, 30)))))
        yield pa.record_batch([batch.column("row"), pa.array(scores, pa.float64())], names=["row", "score"])


def score(docs: DataFrame, model, text: str = "text", bits: int = BITS, threshold: float = 0.5) -> DataFrame:
    """Add ``score`` (0 to 1, higher: likelier toxic) and ``predicted`` to every row; only ``text`` is looked at.

    Null and empty texts, and texts without a known term, get the score of the bias. Without a model every score is 0. Rows
    are independent, so null or repeated ids do no harm; existing columns of the two names are replaced.
    """
    others = [c for c in docs.columns if c not in {"score", "predicted"}]
    rows = docs.select(F.struct(F.lit(0).alias("__row"), *others).alias("row"), F.col(text).cast("string").alias("text"))
    row, shared = rows.schema["row"].dataType.simpleString(), docs.sparkSession.sparkContext.broadcast(model)
    out = rows.mapInArrow(lambda it: sole_caches(_score(it, shared.value, bits), _terms(bits)), f"row {row}, score double").select("row.*", "score").drop("__row")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out(doc_id: Column) -> Column:
    """The fifth of the documents that labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))
