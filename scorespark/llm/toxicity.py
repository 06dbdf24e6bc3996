"""Toxicity by a weighted grammar of clauses: composed finite-state transducers over word classes.

A text's words fall into classes: insults (words) and threats (sequences of
ordinary words), both learned from labels, words of intent, second-person and
other targets, negations, words of reported speech, and the rest. Small
transducers read a clause's classes: one emits an insult's weight, one a
threat's, more after a word of intent, one raises either next to a target, one
lowers it after a negation, one lowers it in reported speech. Their composition is one automaton whose path weight is
the clause's score, so a word counts by the clause it stands in. A logistic
curve, fitted on the same labels, turns the sum over clauses into a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import partial

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorespark.llm.common import claim, refuse_columns, stage

WORD = re.compile(r"[^\W\d_]+")
OTHER, INSULT, TARGET, NEGATION, REPORT, INTENT, THREAT = range(7)
_KINDS = range(7)
_PAIRS = 1 << 16  # (feature, group) pairs that a task holds
_GRAM = 4  # words of a threat at most
# fixed values: short closed-class words of English, German, French and Spanish
CLASSES = {
    TARGET: "you your yours yourself he she they them him her his their "
            "du dich dir dein deine ihr euch sie tu te toi ton ta vous votre il elle ils "
            "usted ustedes tú ti tus su sus ellos ellas",
    NEGATION: "not no never nor neither without hardly nicht kein keine nie niemals ohne "
              "ne pas jamais sans aucun nunca jamás ni sin tampoco",
    REPORT: "said says say wrote writes called calls told asked quoted reported claimed allegedly "
            "sagte sagt schrieb nannte behauptete dit disait écrit appelait dijo dice escribió llamó",
}
CLASSES[INTENT] = ("will shall would going gonna must want werde werden wird will wollen soll vais va vont allons veux "
                   "voy va vamos van quiero")
_CLASS_OF = {w: c for c, words in CLASSES.items() for w in words.split()}
_CLAUSE_END = re.compile(r"[.!?;:\n]")


# ---- transducers ----------------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Transducer:
    """A deterministic weighted transducer over word classes: (state, class) -> (state, factor of an attack's weight)."""

    start: int
    moves: dict[tuple[int, int], tuple[int, float]]

    def __mul__(self, other: Transducer) -> Transducer:
        """Composition: both read the same classes, and their factors multiply."""
        names = {(self.start, other.start): 0}
        moves, todo = {}, [(self.start, other.start)]
        while todo:
            a, b = todo.pop()
            for c in _KINDS:
                (x, f), (y, g) = self.moves[a, c], other.moves[b, c]
                if (x, y) not in names:
                    names[x, y] = len(names)
                    todo.append((x, y))
                moves[names[a, b], c] = names[x, y], f * g
        return Transducer(0, moves)

    def run(self, steps: Iterable[tuple[int, float]]) -> float:
        """The score of one clause's (class, weight) pairs; only a state is held."""
        state, total = self.start, 0.0
        for c, w in steps:
            state, factor = self.moves[state, c]
            if c in (INSULT, THREAT):
                total += w * factor
        return total


def _weigh(kind: int, after: int | None = None, factor: float = 1.0) -> Transducer:
    """Attacks of one ``kind`` have their weight, and ``factor`` times it once a word of class ``after`` stood in the clause."""
    return Transducer(0, {(s, c): ((1 if c == after else s), factor if s and c == kind else 1.0)
                          for s in range(2) for c in _KINDS})


def _countdown(trigger: int, length: int, factor: float) -> Transducer:
    """Attacks within ``length`` words after a ``trigger`` word are weighted by ``factor``; a threat's end is no word."""
    moves = {}
    for s in range(length + 1):
        for c in _KINDS:
            moves[s, c] = (length if c == trigger else s if c == THREAT else max(0, s - 1)), (factor if s > 0 else 1.0)
    return Transducer(0, moves)


def _rest_of_clause(trigger: int, factor: float) -> Transducer:
    return Transducer(0, {(s, c): ((1 if c == trigger else s), factor if s else 1.0) for s in range(2) for c in _KINDS})


def grammar(target: float = 1.5, negated: float = 0.5, reported: float = 0.7, intended: float = 1.5) -> Transducer:
    """Insult, threat, target, negation and reported-speech transducers composed into one."""
    insult, threat = _weigh(INSULT), _weigh(THREAT, after=INTENT, factor=intended)
    return insult * threat * _countdown(TARGET, 4, target) * _countdown(NEGATION, 3, negated) * _rest_of_clause(REPORT, reported)


# ---- lexicon --------------------------------------------------------------------------------------------------------

def _features(text: str) -> set[str]:
    """Words (ending in '$') and their beginnings of 4 letters or more."""
    out = set()
    for w in set(WORD.findall(text.lower())):
        if len(w) >= 3:
            out.add(w + "$")
            out.update(w[:k] for k in range(4, min(len(w), 9)))
    return out


def _sequences(text: str) -> set[str]:
    """Runs of 2 to _GRAM words inside a clause."""
    out = set()
    for clause in _CLAUSE_END.split(text.lower()):
        w = WORD.findall(clause)
        out.update(" ".join(w[i:i + k]) for k in range(2, _GRAM + 1) for i in range(len(w) - k + 1))
    return out


def _group(text: str) -> int:
    """The least word hash: near copies nearly always agree in it."""
    return min((xxhash.xxh3_64_intdigest(w) & (2**62 - 1) for w in text.lower().split()), default=0)


def _close_group(text: str) -> int:
    """A hash of the four least word hashes: texts that only share a sentence seldom agree in it."""
    least = sorted(xxhash.xxh3_64_intdigest(w) for w in set(text.lower().split()))[:4]
    return xxhash.xxh3_64_intdigest(repr(least)) & (2**62 - 1)


def _pair_rows(pairs: set[tuple[str, int]]) -> pa.RecordBatch:
    f, g = zip(*pairs) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(f, pa.string()), pa.array(g, pa.int64())], names=["f", "g"])


def _count(batches: Iterator[pa.RecordBatch], only: frozenset | None, features=_features,
           missed: Model | None = None) -> Iterator[pa.RecordBatch]:
    """(feature, group) pairs of the batch's texts, some more than once; of those alone in which ``missed`` finds no attack, if given."""
    claim(__name__)
    scorer = _Scorer(missed) if missed else None
    for batch in batches:
        pairs = set()
        for text in batch.column(0):
            t = text.as_py() or ""
            if scorer and scorer.raw(t):
                continue
            found = features(t)
            g = _group(t) if features is _features else _close_group(t)
            pairs.update((f, g) for f in (found if only is None else found & only))
            if len(pairs) > _PAIRS:
                yield _pair_rows(pairs)
                pairs = set()
        yield _pair_rows(pairs)


def _choose(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int, min_groups: int,
            purity: float) -> dict[str, float]:
    """Beginnings and words that (nearly) only toxic texts hold, each stem in its longest form of equal support."""
    good = {}
    for f, n in toxic.items():
        # share of toxic texts among holders if both kinds were equally frequent, with one clean holder assumed
        share = (n / n_toxic) / (n / n_toxic + (clean.get(f, 0) + 1) / n_clean)
        if n >= min_groups and share >= purity:
            good[f] = math.log(share / (1 - share))
    out: dict[str, float] = {}
    for f in sorted(good, key=lambda x: (len(x), x)):
        if any(f.startswith(k) for k in out if not k.endswith("$")):
            continue
        longer = [x for x in good if x.startswith(f) and x != f]
        if any(toxic[x] >= 0.8 * toxic[f] and good[x] > good[f] + 1 for x in longer):
            continue  # a longer form is much purer; it and its siblings come later
        # the longest form, up to the whole word, that loses next to no support
        f = max([f, *(x for x in longer if toxic[x] >= 0.98 * toxic[f])], key=lambda x: (len(x), x))
        out[f] = good[f]
    return out


def _inner(f: str) -> list[str]:
    w = f.split()
    return [" ".join(w[i:i + k]) for k in range(2, len(w)) for i in range(len(w) - k + 1)]


def _choose_sequences(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int, purity: float) -> dict[str, float]:
    """Sequences that (nearly) only toxic texts hold, also as counted in the sample, each in a longer form of like support."""
    good = {}
    for f, n in toxic.items():
        seen = clean.get(f, 0)
        share = (n / n_toxic) / (n / n_toxic + (seen + 1) / n_clean)
        if share >= purity and n >= purity * (n + seen):
            good[f] = math.log(share / (1 - share))
    covered = {x for f in good for x in _inner(f) if toxic[f] >= 0.9 * toxic.get(x, 0)}
    out: dict[str, float] = {}
    for f in sorted(good, key=lambda x: (x.count(" "), x)):
        if f not in covered and not any(x in out for x in _inner(f)):
            out[f] = good[f]
    return out


@dataclass(frozen=True)
class Model:
    """Insult stems and threats with weights, the curve's two numbers, and the threshold of a prediction."""

    lexicon: dict[str, float]
    intercept: float
    slope: float
    threshold: float = 0.3
    threats: dict[str, float] = field(default_factory=dict)


class _Scorer:
    """A model compiled in a worker."""

    def __init__(self, model: Model):
        self.model, self.fst, self.find = model, grammar(), ahocorasick.Automaton()
        for f, w in model.lexicon.items():
            self.find.add_word(f.rstrip("$"), (len(f.rstrip("$")), f.endswith("$"), w))
        for f in model.threats:  # a clause is read for threats where the longest word of one stands
            cue = max(f.split(), key=len)
            if cue + "$" not in model.lexicon and cue not in model.lexicon:
                self.find.add_word(cue, (len(cue), True, 0.0))
        if model.lexicon or model.threats:
            self.find.make_automaton()

    def raw(self, text: str | None) -> float:
        """The sum of the clause scores of a whole text."""
        if not text or not (self.model.lexicon or self.model.threats):
            return 0.0
        low, attacks = text.lower(), {}
        for end, (size, whole, weight) in self.find.iter(low):
            start = end - size + 1
            if start and low[start - 1].isalpha() or whole and low[end + 1:end + 2].isalpha():
                continue
            attacks[start] = max(weight, attacks.get(start, 0.0))
        total, done = 0.0, 0
        for at in sorted(attacks):
            if at < done:
                continue
            # a clause is read whole, from the last clause end to the next
            for m in _CLAUSE_END.finditer(low, done, at):
                done = m.end()
            first, stop = done, _CLAUSE_END.search(low, at)
            done = stop.end() if stop else len(low)
            total += self.fst.run(self._steps(low, first, done, attacks))
        return total

    def _steps(self, low: str, first: int, end: int, attacks: dict[int, float]) -> Iterator[tuple[int, float]]:
        """A clause's words, and after the last word of a threat the threat."""
        threats, last = self.model.threats, deque(maxlen=_GRAM)
        for m in WORD.finditer(low, first, end):
            hit = attacks.get(m.start())
            yield (INSULT, hit) if hit else (_CLASS_OF.get(m[0], OTHER), 0.0)
            if threats:
                last.append(m[0])
                words = list(last)
                found = max((threats.get(" ".join(words[i:]), 0.0) for i in range(len(words) - 1)), default=0.0)
                if found:
                    yield THREAT, found
                    last.clear()

    def score(self, text: str | None) -> float:
        z = self.model.intercept + self.model.slope * math.log1p(self.raw(text))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def _raw_rows(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """(rounded feature, label, rows) of the batch."""
    claim(__name__)
    scorer = _Scorer(model)
    for batch in batches:
        n = Counter((round(math.log1p(scorer.raw(t.as_py())), 2), y.as_py()) for t, y in zip(*batch.columns))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in n], pa.float64()), pa.array([k[1] for k in n], pa.int64()),
                                          pa.array(list(n.values()), pa.int64())], names=["x", "y", "n"])


def _curve(rows: list[tuple[float, int, int]], ridge: float = 1.0) -> tuple[float, float]:
    """Logistic regression on one feature with a small ridge, by Newton steps."""
    x, y, n = (np.array(c, float) for c in zip(*rows))
    design, beta = np.column_stack([np.ones_like(x), x]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (n * (y - p)) - ridge * beta
        step = np.linalg.solve((design.T * (n * p * (1 - p))) @ design + ridge * np.eye(2), grad)
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def held_out(id_col) -> F.Column:
    """Rows that no model may learn from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        max_rows: int = 30_000, min_groups: int = 6, purity: float = 0.9, threshold: float = 0.3) -> Model:
    """A model from the labelled rows that are not held out.

    The training sample is bounded: about ``max_rows`` rows, those of the
    smallest id hashes, so the lexicon and the driver's share are bounded too.
    A stem's support is counted in groups of near copies, not in texts; threats
    are sequences of 2 to 4 words of toxic texts without a stem. Rows
    with a null id, label or text are not learned from. Without toxic or clean
    rows the lexicon is empty and the curve gives the share of toxic rows.
    """
    truth = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).select(
        F.col(id_col).alias("i"), F.col(label_col).cast("long").alias("y"))
    rows = truth.count()
    if rows > max_rows:
        truth = truth.where(F.pmod(F.xxhash64("i"), F.lit(1 << 62)) < (max_rows << 62) // rows)
    truth = truth.groupBy("i").agg(F.max("y").alias("y"))  # an id that is labelled both ways counts as toxic
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t is not null")
    sample = stage(texts.join(F.broadcast(truth), "i").select("t", "y"), "toxicity-sample")  # max_rows bounds both

    def counts(y: int, only: frozenset | None, least: int, **how) -> dict[str, int]:
        pairs = sample.where(F.col("y") == y).select("t").mapInArrow(partial(_count, only=only, **how), "f string, g long")
        return {f: n for f, n in pairs.groupBy("f").agg(F.countDistinct("g").alias("n")).where(F.col("n") >= least).collect()}

    n = dict(sample.groupBy("y").count().collect())
    lexicon: dict[str, float] = {}
    threats: dict[str, float] = {}
    if n.get(1) and n.get(0):
        toxic = counts(1, None, min_groups)  # bounded by the sample
        lexicon = _choose(toxic, counts(0, frozenset(toxic), 1), n[1], n[0], min_groups, purity)
        # threats are learned where no insult tells a toxic text
        insults = Model(lexicon, 0.0, 1.0, threshold)
        toxic = counts(1, None, min_groups, features=_sequences, missed=insults)
        if toxic:
            threats = _choose_sequences(toxic, counts(0, frozenset(toxic), 1, features=_sequences), n[1], n[0], purity)
    model = Model(lexicon, 0.0, 1.0, threshold, threats)
    seen = sample.select("t", "y").mapInArrow(partial(_raw_rows, model=model), "x double, y long, n long")
    seen = seen.groupBy("x", "y").agg(F.sum("n")).collect()  # a row for each hundredth of the feature
    intercept, slope = _curve([(r[0], r[1], r[2]) for r in seen]) if seen else (-2.0, 1.0)
    return Model(lexicon, intercept, slope, threshold, threats)


def _score_rows(batches: Iterator[pa.RecordBatch], model: Model, text_at: int) -> Iterator[pa.RecordBatch]:
    claim(__name__)
    scorer = _Scorer(model)
    for batch in batches:
        scores = pa.array([scorer.score(t.as_py()) for t in batch.column(text_at)], pa.float64())
        yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, "_score"])


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns and ``_score``, 0 to 1, higher for likelier toxic texts.

    Map-only; whole texts. Null and empty texts score the curve's intercept,
    repeated rows score alike, an empty table stays empty. An input column
    ``_score`` is a ``ValueError``.
    """
    refuse_columns(docs, "_score")
    schema = ", ".join([*(f"`{c}` {t}" for c, t in docs.dtypes), "_score double"])
    return docs.mapInArrow(partial(_score_rows, model=model, text_at=docs.columns.index(text_col)), schema)
