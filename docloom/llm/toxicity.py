"""Toxicity by weak supervision: voters, a generative label model, a linear classifier.

*Voters.* Each is a pattern with a threshold: the share of a text's words that are one
word, that begin with the same letters or that stand in a general list of insults, or a
statistic such as shouting. Patterns and thresholds come from labelled rows; a voter
fires for toxic or for clean.

*Label model.* The votes of a text depend on its unknown class, and on each other: given
the class, every voter may also depend on one other, chosen as the maximum spanning
tree of their conditional mutual information. So two voters that always fire together
do not count twice. Accuracies and dependences are estimated by expectation
maximisation, over labelled rows, whose class is known, and unlabelled ones.

*Classifier.* Logistic regression over all hashed words, word beginnings and
statistics is fitted to the posterior of the label model, so it also learns from
words that no voter looks at. It scores a text in one pass, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm import common as C
from docloom.llm.pointer_terms import LETTERS

#: Rows of each class, and rows without a label, that models are fitted on at most; chosen by a hash of their ids.
LABELLED_ROWS = 2000
UNLABELLED_ROWS = 2000
WORD_BUCKETS = 1 << 18
#: Bytes of the beginnings of words that are inputs.
BEGINNINGS = (4, 6, 8)
VOTERS = 64
#: Rows of the scarcer class in which a voter must fire.
SUPPORT = 3
ROUNDS = 12
STEPS = 800
BATCH = 128
RATE = 0.05
DECAY = 1e-4
#: One of so many rows of the sample must have an input of the classifier.
COMMON = 500
SEED = 11
#: A text is predicted to be toxic from this score on.
CUT = 0.3

#: General insults of some European languages (fixed values).
INSULTS = (
    "idiot idiots moron morons stupid dumb fool loser losers trash garbage scum filth pathetic worthless "
    "disgusting clown jerk creep freak bastard bitch asshole crap shit fuck fucking hate ugly retard "
    "idioten dumm blöd arschloch scheisse scheiße trottel depp abschaum widerlich hure mistkerl "
    "crétin imbécile débile connard salaud salope merde ordure minable dégoûtant pute abruti "
    "idiota estúpido imbécil tonto basura escoria mierda puta cabrón gilipollas patético asqueroso"
).split()
_INSULTS = {w.encode() for w in INSULTS}
STATISTICS = ("insults", "shouting", "marks", "repeated", "short")
WIDTH = WORD_BUCKETS + len(STATISTICS)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, input and value of all inputs that are not 0, by ascending row.

    Values of words and beginnings are square roots of their share of the text's words.
    """
    n = len(texts)
    off, buf = C.utf8(texts)
    words = C.words_of(texts, LETTERS, lower=True)
    known = max(1, len(words.distinct))
    cell, times = np.unique(words.row * np.int64(known) + words.code, return_counts=True)
    at, code = cell // known, cell % known
    binary = words.distinct.cast(pa.binary()).to_pylist()
    kinds = [np.fromiter((C.xxh64_intdigest(w) for w in binary), np.uint64, len(binary))]
    for size in BEGINNINGS:
        kinds.append(
            np.fromiter((C.xxh64_intdigest(w[:size], size) if len(w) > size else 0 for w in binary), np.uint64, len(binary))
        )
    insult = np.fromiter((w in _INSULTS for w in binary), bool, len(binary))
    rows, names, values = [], [], []
    count = np.maximum(words.count, 1)
    for kind in kinds:
        mine = kind[code]
        some = mine != 0
        one, place = np.unique(
            at[some] * np.int64(WORD_BUCKETS) + (mine[some] % np.uint64(WORD_BUCKETS)).astype(np.int64), return_inverse=True
        )
        rows.append(one // WORD_BUCKETS)
        names.append(one % WORD_BUCKETS)
        values.append(np.sqrt(np.bincount(place, times[some], len(one)) / count[rows[-1]]))

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags)))
        return total[off[1:]] - total[off[:-1]]

    upper, lower = per_text((buf >= 65) & (buf <= 90)), per_text((buf >= 97) & (buf <= 122))
    same = np.zeros(len(words.row), bool)
    same[1:] = (words.code[1:] == words.code[:-1]) & (words.row[1:] == words.row[:-1])
    shares = (
        np.bincount(at, times * insult[code], n) / count,
        upper / np.maximum(upper + lower, 1),
        per_text((buf == 33) | (buf == 63)) / np.maximum(np.diff(off), 1),
        np.bincount(words.row[same], minlength=n) / count,
        words.count < 20,
    )
    for k, share in enumerate(shares):
        have = np.flatnonzero(share)
        rows.append(have)
        names.append(np.full(len(have), WORD_BUCKETS + k))
        values.append(np.sqrt(share[have]))
    row, name, value = (np.concatenate(x) for x in (rows, names, values))
    order = np.argsort(row, kind="stable")
    return row[order].astype(np.int64), name[order].astype(np.int64), value[order].astype(np.float32)


@dataclass
class Sample:
    """Inputs of the rows that models are fitted on; label: 1, 0 or -1 (none)."""

    cut: np.ndarray  # where each row begins, and the end of the last one
    name: np.ndarray
    value: np.ndarray
    label: np.ndarray

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.label)), np.diff(self.cut))


@dataclass
class Voter:
    name: int
    least: float  # fires if the input is at least this, or, for clean, below it
    toxic: bool


def propose(sample: Sample, voters: int = VOTERS) -> list[Voter]:
    """The inputs and thresholds that tell the labelled rows' classes apart best, each input once."""
    row = sample.row()
    labelled = sample.label[row] >= 0
    name, value, toxic = sample.name[labelled], sample.value[labelled], sample.label[row[labelled]]
    total = np.array([(sample.label == 0).sum(), (sample.label == 1).sum()], float)
    if not total.all():
        return []
    # By input, the largest values first: each place is a threshold.
    order = np.lexsort((-value, name))
    name, value, toxic = name[order], value[order], toxic[order]
    first = np.flatnonzero(np.concatenate(([True], name[1:] != name[:-1])))
    begin = np.repeat(first, np.diff(first, append=len(name)))
    ones = np.cumsum(toxic)
    hits = ones - (ones[begin] - toxic[begin])
    fired = np.arange(len(name)) - begin + 1
    last = np.ones(len(name), bool)  # equal values fire together
    last[:-1] = (name[1:] != name[:-1]) | (value[1:] != value[:-1])
    a, b = hits / total[1], (fired - hits) / total[0]
    share = (a * total[1] + b * total[0]) / total.sum()
    phi = (a - b) * np.sqrt(total[0] * total[1]) / total.sum() / np.sqrt(np.maximum(share * (1 - share), 1e-12))
    phi[~last | (hits < SUPPORT)] = -1
    best = np.maximum.reduceat(phi, first)
    place = np.array([i + np.argmax(phi[i:j]) for i, j in zip(first, np.append(first[1:], len(name)))])
    chosen = place[np.lexsort((name[place], -best))[: voters]]
    found = [Voter(int(name[i]), float(value[i]), True) for i in chosen if phi[i] > 0]
    # The strongest ones also vote for clean where they do not fire at all.
    return found + [Voter(v.name, v.least, False) for v in found[: max(1, voters // 8)]]


def votes(sample: Sample, voters: list[Voter]) -> np.ndarray:
    """Which voters fire for which rows."""
    fires = np.zeros((len(sample.label), len(voters)), bool)
    row = sample.row()
    for j, v in enumerate(voters):
        mine = sample.name == v.name
        over = np.zeros(len(sample.label), bool)
        over[row[mine]] = sample.value[mine] >= v.least - 1e-9
        fires[:, j] = over == v.toxic
    return fires


@dataclass
class LabelModel:
    prior: float
    parent: np.ndarray  # of each voter, -1: none
    fires: np.ndarray  # [voter, class, vote of the parent]: probability to fire
    dependence: np.ndarray  # conditional mutual information with the parent, in nats

    def accuracy(self, votes: np.ndarray, posterior: np.ndarray, toxic: np.ndarray) -> np.ndarray:
        """Share of each voter's votes that are right, as the posterior has it."""
        right = np.where(toxic, posterior @ votes, (1 - posterior) @ votes)
        return right / np.maximum(votes.sum(0), 1)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of toxic for each row of votes."""
        n, m = votes.shape
        above = np.zeros((n, m), np.int64)
        known = self.parent >= 0
        above[:, known] = votes[:, self.parent[known]]
        log = np.zeros((n, 2))
        for y in (0, 1):
            p = self.fires[np.arange(m), y, above]
            log[:, y] = np.log(np.where(votes, p, 1 - p)).sum(1)
        log[:, 1] += np.log(self.prior)
        log[:, 0] += np.log(1 - self.prior)
        return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))


def _tree(votes: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parent of each voter in the maximum spanning tree of mutual information given the class."""
    m = votes.shape[1]
    info = np.zeros((m, m))
    total = weight.sum()
    v = votes.astype(float)
    for y in (0, 1):
        w = weight[:, y]
        size = w.sum() + 2
        both = (v * w[:, None]).T @ v + 0.5
        one = (v * w[:, None]).sum(0) + 1
        cells = {
            (1, 1): both,
            (1, 0): one[:, None] - both,
            (0, 1): one[None, :] - both,
            (0, 0): size - one[:, None] - one[None, :] + both,
        }
        for (a, b), c in cells.items():
            pa_ = one[:, None] if a else size - one[:, None]
            pb_ = one[None, :] if b else size - one[None, :]
            c = np.maximum(c, 1e-9)
            info += size / (total + 4) * c / size * np.log(c * size / (pa_ * pb_))
    parent, strength = np.full(m, -1), np.zeros(m)
    reach, through = info[0].copy() if m else np.zeros(0), np.zeros(m, np.int64)
    left = np.ones(m, bool)
    left[:1] = False
    while left.any():
        j = int(np.flatnonzero(left)[np.argmax(reach[left])])
        parent[j], strength[j], left[j] = through[j], reach[j], False
        better = left & (info[j] > reach)
        reach[better], through[better] = info[j][better], j
    return parent, strength


def label_model(votes: np.ndarray, label: np.ndarray, rounds: int = ROUNDS) -> LabelModel:
    """Estimate by expectation maximisation; rows of known class (0, 1) keep it, the others (-1) do not have one."""
    n, m = votes.shape
    known = label >= 0
    weight = np.zeros((n, 2))
    weight[known, label[known]] = 1
    prior = (weight[:, 1].sum() + 1) / (known.sum() + 2)
    model = LabelModel(prior, np.full(m, -1), np.full((m, 2, 2), 0.5), np.zeros(m))
    for turn in range(rounds):
        if turn % 4 == 0:
            parent, strength = _tree(votes, weight)
        fires = np.empty((m, 2, 2))
        for j in range(m):
            above = votes[:, parent[j]] if parent[j] >= 0 else np.zeros(n, bool)
            for y in (0, 1):
                alone = (weight[votes[:, j], y].sum() + 0.5) / (weight[:, y].sum() + 1)
                for a in (0, 1):
                    mine = weight[above == bool(a), y]
                    hit = weight[(above == bool(a)) & votes[:, j], y].sum()
                    fires[j, y, a] = (hit + 2 * alone) / (mine.sum() + 2)
        model = LabelModel(prior, parent, np.clip(fires, 1e-4, 1 - 1e-4), strength)
        guess = model.posterior(votes)
        weight[~known] = np.stack([1 - guess, guess], 1)[~known]
        if (~known).any() and known.any():
            prior = (weight[:, 1].sum() + 1) / (n + 2)
    return model


@dataclass
class Classifier:
    bias: float
    weights: np.ndarray

    def score(self, cut: np.ndarray, name: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Score of each row; ``cut``: where rows begin, and the end."""
        total = np.concatenate(([0.0], np.cumsum(self.weights[name] * value)))
        return 1 / (1 + np.exp(-np.clip(self.bias + total[cut[1:]] - total[cut[:-1]], -30, 30)))


def fit(sample: Sample, target: np.ndarray) -> Classifier:
    """Logistic regression on soft targets with Adam; the same rows give the same model.

    Only inputs of at least one in ``COMMON`` rows get a weight: rarer ones name rows, not classes.
    """
    random = np.random.default_rng(SEED)
    often = np.bincount(sample.name, minlength=WIDTH) >= max(2, len(target) / COMMON)
    held = often[sample.name]
    cut = np.concatenate(([0], np.cumsum(held)))[sample.cut]
    sample = Sample(cut, sample.name[held], sample.value[held], sample.label)
    weights, bias = np.zeros(WIDTH), 0.0
    mean, square = np.zeros(WIDTH + 1), np.zeros(WIDTH + 1)
    n, step = len(target), 0
    size = np.diff(sample.cut)
    while n and step < STEPS:
        order = random.permutation(n)
        for begin in range(0, n, BATCH):
            mine = order[begin : begin + BATCH]
            each = C.spans(sample.cut[mine], size[mine])
            cut = np.concatenate(([0], np.cumsum(size[mine])))
            name, value = sample.name[each], sample.value[each]
            off = (Classifier(bias, weights).score(cut, name, value) - target[mine]) / len(mine)
            used, place = np.unique(name, return_inverse=True)
            grad = np.bincount(place, np.repeat(off, size[mine]) * value, len(used)) + DECAY * weights[used]
            where, grad = np.append(used, WIDTH), np.append(grad, off.sum())
            step += 1
            mean[where] = 0.9 * mean[where] + 0.1 * grad
            square[where] = 0.999 * square[where] + 0.001 * grad * grad
            move = RATE * mean[where] / (1 - 0.9**step) / (np.sqrt(square[where] / (1 - 0.999**step)) + 1e-8)
            weights[used] -= move[:-1]
            bias -= move[-1]
    return Classifier(float(bias), weights)


def learn(sample: Sample) -> Classifier:
    """Voters, label model and classifier of a sample; without labels of both classes every score is 0.5."""
    voters = propose(sample)
    if not voters:
        return Classifier(0.0, np.zeros(WIDTH))
    fired = votes(sample, voters)
    return fit(sample, label_model(fired, sample.label).posterior(fired))


def held_out(key: str = "doc_id") -> Column:
    """Rows that take no part in fitting."""
    return F.crc32(F.col(key).cast("string")) % 4 == 2


def _inputs(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    row, name, value = features(part.column("_text"))
    return np.searchsorted(row, np.arange(part.num_rows + 1)), name, value


def sample(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
    labelled_rows: int = LABELLED_ROWS, unlabelled_rows: int = UNLABELLED_ROWS,
) -> Sample:
    """Inputs of at most ``labelled_rows`` documents of each class and ``unlabelled_rows`` without a label.

    Of rows that share a key the least text counts; of several labels of a key the largest.
    """
    C.small_batches(docs.sparkSession)
    order = [F.xxhash64("_id"), F.col("_id")]
    marked = (
        labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key))
        .groupBy(F.col(key).alias("_id"))
        .agg((F.max(label) > 0).cast("int").alias("_label"))
    )
    chosen = [marked.where(F.col("_label") == y).orderBy(*order).limit(labelled_rows) for y in (0, 1)]
    texts = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    some = texts.where(F.col("_id").isNotNull() & ~held_out("_id")).select("_id").distinct()
    some = some.orderBy(*order).limit(unlabelled_rows)
    bare = some.join(marked, "_id", "left").where("_label is null").select("_id", F.lit(-1).alias("_label"))
    # At most 2 * labelled_rows + unlabelled_rows narrow rows.
    wanted = F.broadcast(chosen[0].union(chosen[1]).union(bare))
    # Rows of a key are folded before they move.
    held = texts.join(wanted, "_id").groupBy("_id", "_label").agg(F.min("_text").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.steps(batch, "_text"):
                cut, name, value = _inputs(part)
                offsets = pa.array(cut.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("_id"),
                        part.column("_label"),
                        pa.ListArray.from_arrays(offsets, pa.array(name.astype(np.int32))),
                        pa.ListArray.from_arrays(offsets, pa.array(value)),
                    ],
                    names=["_id", "_label", "names", "values"],
                )

    schema = T.StructType(
        [
            texts.schema["_id"],
            T.StructField("_label", T.IntegerType()),
            T.StructField("names", T.ArrayType(T.IntegerType())),
            T.StructField("values", T.ArrayType(T.FloatType())),
        ]
    )
    got = held.mapInArrow(run, schema).toArrow().sort_by("_id").combine_chunks()
    names, values, marks = (got.column(c) for c in ("names", "values", "_label"))
    size = names.combine_chunks().value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = [np.concatenate([c.flatten().to_numpy() for c in x.chunks] or [np.zeros(0)]) for x in (names, values)]
    return Sample(
        np.concatenate(([0], np.cumsum(size))).astype(np.int64), flat[0].astype(np.int64), flat[1], marks.to_numpy()
    )


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Classifier:
    """Fit voters, label model and classifier on a bounded sample (see ``sample``)."""
    return learn(sample(docs, labels, key, text, label))


def score(docs: DataFrame, classifier: Classifier, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and ``score`` (0 to 1, higher: more likely toxic) of every row.

    Whole texts are read; null and empty ones are scored like a text without words. Null
    and repeated keys are scored like any other, an empty table gives no rows. Further
    columns are not read: neither labels nor language or source can reach a score.
    """
    C.small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(classifier)
    schema = T.StructType([docs.schema[key], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.steps(batch, "_text"):
                got = held.value.score(*_inputs(part))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got)], names=schema.names)

    return docs.select(key, F.col(text).alias("_text")).mapInArrow(run, schema)
