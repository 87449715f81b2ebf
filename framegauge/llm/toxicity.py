"""Toxicity by a learned lexicon, Levenshtein automata and context windows.

The lexicon holds whole words and stems that mark toxic documents of the labelled
sample.  It stands in a trie; the Levenshtein automata of all its terms, run over that
trie, are one nondeterministic machine whose places are (trie node, edits so far).
The machine is determinised as words arrive, so that a word costs one step per
character until no term is near any more.

Each hit stands in a window of words: *quoted* (between paired quotation marks), *clustered*
(another hit nearby) or *plain*.  The weights of hits, summed by this context and by
whether the term was misspelled, are the features of a logistic model, which thus
learns how much a quotation or a misspelling counts.

Only the text is an input of a score.  The sample of labelled rows is bounded by
``max_per_class``; a term needs a fixed number of documents and a likelihood ratio, so
that rare words count as soon as they tell the classes apart.  Null and empty texts have no hit; a sample without both classes gives every
text its rate of toxic rows (0 where it is empty).  Labels that are null are left
out, a document with several labels is toxic if one says so, repeated documents are
scored alike, and other columns are ignored or passed through.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framegauge.llm.workers import ENTRY_BYTES, STORE_BYTES, drop_state, slices, worker_state
from framegauge.storage import pinned

MAX_PER_CLASS = 15_000
MAX_TERMS = 500  # with all that pass the test the automaton outgrows its store
STEMS = range(3, 13)  # lengths of stems that may become terms
LEAST_DOCUMENTS = 3
LEAST_GAIN = 10.0  # log likelihood ratio by which a term tells the classes apart
LEAST_LOG_ODDS = 0.4  # of toxic to other documents among those with the term
WINDOW = 5
QUOTE_WORDS = 40  # longest quotation
THRESHOLD = 0.3
MAX_STATES = 50_000

_EDGES = ".,;:!?|\"'`()[]{}<>“”„«»‘’…*_-"
_OPENING = ('"', "“", "„", "«", "»", "”")
_CLOSING = ('"', "”", "“", "»", "«")
_AFTER_QUOTE = ".,;:!?)]}"


class Term(NamedTuple):
    text: str
    is_stem: bool
    weight: float
    fuzzy_weight: float


class Model(NamedTuple):
    terms: tuple[Term, ...]
    coefficients: tuple[float, ...]


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 8 else 2


class TermMatcher:
    """The determinised product of all Levenshtein automata and the lexicon trie."""

    def __init__(self, terms: Iterable[tuple[str, bool]]) -> None:
        self._children: list[dict[str, int]] = [{}]
        self._allowed = [-1]
        self._stems: dict[int, int] = {}
        self._words: dict[int, int] = {}
        self._limits: list[int] = []
        for number, (text, is_stem) in enumerate(terms):
            limit = edits_allowed(text)
            self._limits.append(limit)
            node = 0
            self._allowed[0] = max(self._allowed[0], limit)
            for char in text:
                following = self._children[node].get(char)
                if following is None:
                    following = self._children[node][char] = len(self._children)
                    self._children.append({})
                    self._allowed.append(-1)
                node = following
                self._allowed[node] = max(self._allowed[node], limit)
            (self._stems if is_stem else self._words)[node] = number
        self._reset()

    def _reset(self) -> None:
        self._numbers: dict[tuple, int] = {}
        self._states: list[tuple] = []
        self._steps: list[dict[str, int]] = []
        self._stem_hits: list[tuple[int, int] | None] = []
        self._word_hits: list[tuple[int, int] | None] = []
        self._start = self._number({0: 0})

    def _number(self, places: dict[int, int]) -> int:
        """The state of a set of places, with letters of terms that the word lacks."""
        waiting = list(places.items())
        while waiting:
            node, edits = waiting.pop()
            for child in self._children[node].values():
                if edits + 1 <= self._allowed[child] and edits + 1 < places.get(child, 99):
                    places[child] = edits + 1
                    waiting.append((child, edits + 1))
        key = tuple(sorted(places.items()))
        number = self._numbers.get(key)
        if number is None:
            number = self._numbers[key] = len(self._states)
            self._states.append(key)
            self._steps.append({})
            self._stem_hits.append(self._best(key, self._stems))
            self._word_hits.append(self._best(key, self._words))
        return number

    def _best(self, places: tuple, ends: dict[int, int]) -> tuple[int, int] | None:
        hits = [(e, ends[n]) for n, e in places if n in ends and e <= self._limits[ends[n]]]
        return min(hits, default=None)

    def _step(self, state: int, char: str) -> int:
        following: dict[int, int] = {}

        def reach(node: int, edits: int) -> None:
            if edits <= self._allowed[node] and edits < following.get(node, 99):
                following[node] = edits

        for node, edits in self._states[state]:
            reach(node, edits + 1)  # a letter too many
            for letter, child in self._children[node].items():
                reach(child, edits + (letter != char))
        number = self._number(following) if following else -1
        self._steps[state][char] = number
        return number

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, term number) of the nearest term, or None."""
        if len(self._states) > MAX_STATES:
            self._reset()
        state, best = self._start, self._stem_hits[self._start]
        for char in word:
            known = self._steps[state].get(char)
            state = self._step(state, char) if known is None else known
            if state < 0:
                return best
            hit = self._stem_hits[state]
            if hit is not None and (best is None or hit < best):
                best = hit
        hit = self._word_hits[state]
        return hit if hit is not None and (best is None or hit < best) else best


class _Scanner:
    """Hits of a lexicon in texts, with the verdict of each word kept."""

    def __init__(self, terms: tuple[tuple[str, bool], ...]) -> None:
        self._matcher = TermMatcher(terms) if terms else None
        self._hits: dict[str, tuple[int, int]] = {}
        self._hit_words: set[str] = set()
        self._clean: set[str] = set()
        self._bytes = 0

    def hits(self, text: str | None) -> list[tuple[int, int, str]]:
        """(edits, term number, context) of each hit."""
        if self._matcher is None or not text:
            return []
        words = text.lower().split()
        distinct = set(words)
        new = (distinct - self._clean) - self._hit_words
        for word in new:
            hit = self._matcher.match(word.strip(_EDGES))
            if hit is None:
                self._clean.add(word)
            else:
                self._hits[word] = hit
                self._hit_words.add(word)
        found = distinct & self._hit_words
        result = self._placed(words, found) if found else []
        self._bytes += sum(map(len, new)) + ENTRY_BYTES * len(new)
        if self._bytes > STORE_BYTES:
            self._bytes = 0
            self._clean.clear()
            self._hits.clear()
            self._hit_words.clear()
        return result

    def _placed(self, words: list[str], found: set[str]) -> list[tuple[int, int, str]]:
        places = [at for at, word in enumerate(words) if word in found]
        quoted = _quoted(words, places)
        result = []
        for k, at in enumerate(places):
            near = (k and at - places[k - 1] <= WINDOW) or (
                k + 1 < len(places) and places[k + 1] - at <= WINDOW
            )
            context = "quoted" if at in quoted else "clustered" if near else "plain"
            result.append((*self._hits[words[at]], context))
        return result


def _quoted(words: list[str], places: list[int]) -> set[int]:
    """The places between an opening mark and the next closing one, at most ``QUOTE_WORDS`` words on.

    A mark opens at the start of a word and closes at the end of one, so inches and marks
    without a partner quote nothing.
    """
    found = set()
    for place in places:
        first = place
        while not words[first].lstrip("([{")[:1] in _OPENING:
            first -= 1
            # A closing mark before the word ends the search: what stands there is over.
            if first < 0 or place - first >= QUOTE_WORDS or words[first].rstrip(_AFTER_QUOTE)[-1:] in _CLOSING:
                break
        else:
            last = place
            while last < len(words) and last - first < QUOTE_WORDS:
                if words[last].rstrip(_AFTER_QUOTE)[-1:] in _CLOSING and len(words[last]) > 1:
                    found.add(place)
                    break
                last += 1
    return found


def _scanner(terms: tuple[tuple[str, bool], ...]) -> _Scanner:
    return worker_state(("toxicity", terms), lambda: _Scanner(terms))


_CONTEXTS = ("plain", "quoted", "clustered")


def features(hits: list[tuple[int, int, str]], terms: tuple[Term, ...]) -> list[float]:
    """One, then the summed weights by context, of exact and of misspelled hits."""
    sums = [0.0] * 6
    for edits, number, context in hits:
        weight = terms[number].fuzzy_weight if edits else terms[number].weight
        sums[_CONTEXTS.index(context) + (3 if edits else 0)] += max(weight, 0.0)
    return [1.0, *map(math.log1p, sums)]


def score_texts(texts: Iterable[str | None], model: Model) -> list[float]:
    scanner = _scanner(tuple((t.text, t.is_stem) for t in model.terms))
    scores = []
    for text in texts:
        values = features(scanner.hits(text), model.terms)
        logit = sum(c * v for c, v in zip(model.coefficients, values))
        scores.append(1 / (1 + math.exp(-max(-40.0, min(40.0, logit)))))
    return scores


# --- learning ----------------------------------------------------------------


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    may_learn: Column,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "toxic",
    max_per_class: int = MAX_PER_CLASS,
) -> DataFrame:
    """``text``, ``toxic`` of about ``max_per_class`` labelled documents of each class.

    ``may_learn`` is a condition on the label table.
    """
    known = (
        labels.where(may_learn & F.col(label_column).isNotNull() & F.col(id_column).isNotNull())
        .groupBy(F.col(id_column).alias("id"))
        .agg(F.max(label_column).cast("int").alias("toxic"))
    )
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0.0)
    for toxic, n in counts.items():
        share = F.when(F.col("toxic") == toxic, F.lit(min(1.0, max_per_class / n))).otherwise(share)
    drawn = F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share * 1_000_000
    # The bound on the sample is a bound on the broadcast: some 30,000 narrow rows.
    chosen = F.broadcast(known.where(drawn))
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return pinned(rows.join(chosen, "id").select("text", "toxic"))


def _stems_of(text: str | None) -> set[str]:
    stems: set[str] = set()
    for word in {w.strip(_EDGES) for w in (text or "").lower().split()}:
        if len(word) >= STEMS.start:
            stems.update(word[:n] for n in STEMS if n <= len(word))
            stems.add(word + "$")
    return stems


def _count_stems(
    batches: Iterator[pa.RecordBatch], among: frozenset[str] | None
) -> Iterator[pa.RecordBatch]:
    drop_state()
    counts: Counter[str] = Counter()

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_pydict(
            {"stem": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())}
        )
        counts.clear()
        return batch

    for batch in slices(batches):
        for text in batch.column(0).to_pylist():
            stems = _stems_of(text)
            counts.update(stems if among is None else stems & among)
            if len(counts) > 200_000:
                yield flush()
    yield flush()


def _stem_counts(texts: DataFrame, among: frozenset[str] | None, least: int) -> dict[str, int]:
    counted = texts.mapInArrow(partial(_count_stems, among=among), "stem string, n long")
    total = counted.groupBy("stem").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return {r.stem: r.n for r in total.collect()}


def _gain(toxic: int, clean: int, all_toxic: int, all_clean: int) -> float:
    """How much the term tells about the class (a likelihood ratio)."""
    rows = toxic + clean, all_toxic + all_clean - toxic - clean
    total, gain = all_toxic + all_clean, 0.0
    for n, row, column in (
        (toxic, rows[0], all_toxic),
        (clean, rows[0], all_clean),
        (all_toxic - toxic, rows[1], all_toxic),
        (all_clean - clean, rows[1], all_clean),
    ):
        if n:
            gain += n * math.log(n * total / (row * column))
    return gain


def _weight(toxic: int, clean: int, all_toxic: int, all_clean: int) -> float:
    return math.log((toxic + 0.5) / (all_toxic + 1)) - math.log((clean + 0.5) / (all_clean + 1))


def choose_terms(
    toxic: dict[str, int], clean: dict[str, int], all_toxic: int, all_clean: int
) -> list[tuple[str, bool, float]]:
    """(text, is a stem, weight): the most telling terms.

    A chosen stem covers all that begins with it.  A whole word covers just itself, so it
    stands beside longer terms.  A stem that chosen terms begin with must tell the classes
    apart by the documents which those leave over.
    """
    prior = math.log((all_toxic + 1) / (all_clean + 1))
    ranked = []
    for stem, n in toxic.items():
        weight = _weight(n, clean.get(stem, 0), all_toxic, all_clean)
        if weight + prior >= LEAST_LOG_ODDS:
            gain = _gain(n, clean.get(stem, 0), all_toxic, all_clean)
            if gain >= LEAST_GAIN:
                ranked.append((-gain, -len(stem), stem, weight))
    chosen: list[tuple[str, bool, float]] = []
    stems: set[str] = set()
    covered: dict[str, tuple[int, int]] = {}  # toxic and other documents, by beginning
    for _, _, stem, weight in sorted(ranked):
        text, is_stem = stem.removesuffix("$"), not stem.endswith("$")
        beginnings = [text[:n] for n in range(1, len(text) + 1)]
        if not stems.isdisjoint(beginnings):
            continue
        left = toxic[stem], clean.get(stem, 0)
        if is_stem and text in covered:
            left = tuple(max(n - known, 0) for n, known in zip(left, covered[text]))
            if (
                _weight(*left, all_toxic, all_clean) + prior < LEAST_LOG_ODDS
                or _gain(*left, all_toxic, all_clean) < LEAST_GAIN
            ):
                continue
        for beginning in beginnings:
            known = covered.get(beginning, (0, 0))
            covered[beginning] = known[0] + left[0], known[1] + left[1]
        if is_stem:
            stems.add(text)
        chosen.append((text, is_stem, weight))
        if len(chosen) == MAX_TERMS:
            break
    return chosen


def _least_documents(all_toxic: int, all_clean: int) -> int:
    """The fewest toxic documents with which a term without others reaches ``LEAST_GAIN``."""
    counts = range(LEAST_DOCUMENTS, all_toxic + 1)
    return next((n for n in counts if _gain(n, 0, all_toxic, all_clean) >= LEAST_GAIN), all_toxic + 1)


def _hit_rows(batches: Iterator[pa.RecordBatch], terms: tuple[tuple[str, bool], ...]) -> Iterator[pa.RecordBatch]:
    """The hits of each text of the sample, packed as numbers."""
    scanner = _scanner(terms)
    for batch in slices(batches):
        found = [
            [(number * 3 + e) * 3 + _CONTEXTS.index(c) for e, number, c in scanner.hits(text)]
            for text in batch.column(0).to_pylist()
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column(1), pa.array(found, pa.list_(pa.int32()))], ["toxic", "hits"]
        )


def fit(sample: DataFrame) -> Model:
    """Lexicon and logistic model of a bounded sample with ``text`` and ``toxic``."""
    totals = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    all_toxic, all_clean = totals.get(1, 0), sum(n for t, n in totals.items() if t != 1)
    if not all_toxic or not all_clean:
        rate = 0.0 if not all_toxic else 1.0
        return Model((), (40.0 * (2 * rate - 1), *[0.0] * 6))
    least = _least_documents(all_toxic, all_clean)
    toxic = _stem_counts(sample.where("toxic = 1").select("text"), None, least)
    clean = _stem_counts(sample.where("toxic <> 1").select("text"), frozenset(toxic), 1)
    chosen = choose_terms(toxic, clean, all_toxic, all_clean)
    names = tuple((text, is_stem) for text, is_stem, _ in chosen)
    rows = sample.select("text", "toxic").mapInArrow(
        partial(_hit_rows, terms=names), "toxic int, hits array<int>"
    )
    collected = rows.collect()  # one short row per text of the bounded sample
    targets = np.array([r.toxic == 1 for r in collected], dtype=np.float64)
    hits = [[(h // 3 % 3, h // 9, _CONTEXTS[h % 3]) for h in r.hits] for r in collected]
    fuzzy = [[0, 0] for _ in chosen]
    for target, own in zip(targets, hits):
        for number in {number for edits, number, _ in own if edits}:
            fuzzy[number][int(target)] += 1
    terms = tuple(
        Term(text, is_stem, weight, _weight(f[1], f[0], all_toxic, all_clean) if sum(f) else weight / 2)
        for (text, is_stem, weight), f in zip(chosen, fuzzy)
    )
    table = np.array([features(own, terms) for own in hits])
    return Model(terms, tuple(_coefficients(table, targets).tolist()))


def _coefficients(table: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Logistic coefficients, none below zero but the constant.

    A context that the sample lacks counts half of the plain one.
    """
    used = np.ones(table.shape[1], dtype=bool)
    while True:
        found = np.zeros(table.shape[1])
        found[used] = _logistic(table[:, used], targets)
        negative = (found < 0) & (np.arange(len(found)) > 0)
        if not negative.any():
            break
        used &= ~negative
    for at in range(1, len(found)):
        if not table[:, at].any():
            found[at] = found[1 + 3 * (at > 3)] / 2
    return found


def _logistic(table: np.ndarray, targets: np.ndarray, penalty: float = 0.1) -> np.ndarray:
    """Newton's method for a logistic model with a ridge on all but the constant."""
    ridge = np.diag([1e-6, *[penalty] * (table.shape[1] - 1)])
    coefficients = np.zeros(table.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(table @ coefficients, -40, 40)))
        slope = table.T @ (targets - p) - ridge @ coefficients
        curve = (table * (p * (1 - p))[:, None]).T @ table + ridge + 1e-9 * np.eye(len(ridge))
        step = np.linalg.solve(curve, slope)
        coefficients += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return coefficients


# --- scoring -----------------------------------------------------------------


def score_documents(
    docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``id``, ``score`` (0 to 1) of every document."""
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(partial(_score_batches, model=model), f"id {kind}, score double")


def _score_batches(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        scores = score_texts(batch.column(1).to_pylist(), model)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["id", "score"])


def keep_clean(docs: DataFrame, model: Model, text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, whose score is below ``threshold``."""
    place = docs.columns.index(text_column)
    return docs.mapInArrow(partial(_keep_batches, model=model, place=place, threshold=threshold), docs.schema)


def _keep_batches(
    batches: Iterator[pa.RecordBatch], model: Model, place: int, threshold: float
) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        scores = pa.array(score_texts(batch.column(place).to_pylist(), model), pa.float64())
        yield batch.filter(pc.less(scores, threshold))
