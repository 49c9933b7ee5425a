"""Toxicity: a learned lexicon in a trie, met by Levenshtein automata, and context-window features of the hits."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajspark.llm.common import cut, small_batches

#: Labelled rows a classifier is fitted on, terms of the lexicon, and words on either side of a hit.
ROWS, TERMS, WINDOW = 8000, 400, 5
#: Lengths of word beginnings that may become terms (stems), and of words for one and two edits.
STEMS, ONE_EDIT, TWO_EDITS = range(4, 9), 5, 9
#: A term is this much (as a logarithm) more frequent in toxic texts. Any such term may be misspelled, whatever the size of the table.
TRUSTED = math.log(8.0)
#: Texts that a term's own ratio counts for where its misspellings are judged.
PRIOR = 5
FEATURES = ["log_words", "hits", "weight", "weight_share", "top_weight", "distinct", "near_hits", "misspelled", "quoted", "addressed", "stem_hits", "stem_share"]
#: What the model sees: misspellings are too rare in labelled texts for a weight of their own, and the weights of the hits tell them apart already.
MODELLED = [i for i, f in enumerate(FEATURES) if f != "misspelled"]
# Marks around a word, quotation marks, and words that address someone or report speech.
MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "“”„‘’«»…–—¡¿"
QUOTES = "\"“”„«»"
ADDRESS = frozenset("you your youre yours u du dich dir ihr tu toi te vous votre tú ti vosotros usted".split())
REPORT = frozenset("said says quote quoted wrote called sagte schrieb nannte dit écrit dijo escribió".split())


class Automaton:
    """The union of the Levenshtein automata of all terms, as one lazy deterministic walk over their trie.

    A state is a set of (trie node, edits). A letter follows the trie, stands for another letter, or is one too many (an edit each); a
    missing letter is an edit without a letter. States and steps are kept as they are met, so a word costs one look-up a letter and most
    words leave the trie after a few. Stems match without edits and with any ending.
    """

    def __init__(self, terms: dict[str, float]):
        self.weights = list(terms.values())
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[tuple[int, int] | None] = [None]  # term and edits allowed
        self.stems: list[int | None] = [None]
        self.reach = [0]  # most edits allowed below a node
        for i, term in enumerate(terms):
            stem, node = term.endswith("*"), 0
            edits = 0 if stem else 2 if len(term) >= TWO_EDITS else 1 if len(term) >= ONE_EDIT else 0
            for c in term.rstrip("*"):
                self.reach[node] = max(self.reach[node], edits)
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                    self.stems.append(None)
                    self.reach.append(0)
                node = self.children[node][c]
            self.reach[node] = max(self.reach[node], edits)
            if stem:
                self.stems[node] = i
            else:
                self.ends[node] = (i, edits)
        self.reset()

    def reset(self) -> None:
        self.known: dict[frozenset, int] = {}
        self.steps: list[dict[str, int]] = []
        self.sets: list[frozenset] = []
        self.results: list[tuple[tuple[int, int] | None, int | None]] = []
        self.words: dict[str, tuple[int, int] | None] = {}
        self.start = self._state({(0, 0)})

    def _state(self, items: set[tuple[int, int]]) -> int:
        least: dict[int, int] = {}
        todo = sorted(items, key=lambda x: x[1])
        while todo:
            node, e = todo.pop()
            if e > self.reach[node] or least.get(node, 99) <= e:
                continue
            least[node] = e
            todo += [(child, e + 1) for child in self.children[node].values()]
        key = frozenset(least.items())
        if key not in self.known:
            self.known[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            ends = [(e, self.ends[n][0]) for n, e in key if self.ends[n] is not None and e <= self.ends[n][1]]
            stems = [self.stems[n] for n, e in key if e == 0 and self.stems[n] is not None]
            best = min(ends, key=lambda x: (x[0], -self.weights[x[1]])) if ends else None
            self.results.append(((best[1], best[0]) if best else None, max(stems, key=lambda i: self.weights[i]) if stems else None))
        return self.known[key]

    def step(self, state: int, c: str) -> int:
        out: set[tuple[int, int]] = set()
        for node, e in self.sets[state]:
            for letter, child in self.children[node].items():
                out.add((child, e + (letter != c)))
            out.add((node, e + 1))
        to = self._state(out)
        self.steps[state][c] = to
        return to

    def match(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of the best match of a word: the better of an exact term and a stem, before a misspelled one."""
        if len(self.words) > 50_000 or len(self.sets) > 10_000:
            self.reset()
        state, stem = self.start, None
        for c in word:
            to = self.steps[state].get(c)
            state = self.step(state, c) if to is None else to
            if not self.sets[state]:
                break
            if self.results[state][1] is not None:
                stem = self.results[state][1]
        end = self.results[state][0] if self.sets[state] else None
        found = end if stem is None or end and end[1] == 0 and self.weights[end[0]] >= self.weights[stem] else (stem, 0)
        self.words[word] = found
        return found


@lru_cache(maxsize=2)
def automaton(terms: tuple[tuple[str, float], ...]) -> Automaton:
    return Automaton(dict(terms))


class Spelling(NamedTuple):
    """Words that are no misspelling although they look like one, and the weights of (term, edits) where they are not the term's own."""

    ordinary: frozenset[str] = frozenset()
    weights: dict[tuple[int, int], float] = {}


def features(text: str | None, machine: Automaton, stems: frozenset[int], spelling: Spelling = Spelling()) -> list[float]:
    raw = (text or "").split()
    n = len(raw)
    hits: list[tuple[int, int, int]] = []
    known = machine.words
    for i, w in enumerate(raw):
        w = w.lower().strip(MARKS)
        got = known[w] if w in known else machine.match(w)
        known = machine.words
        if got is not None and not (got[1] and (w in spelling.ordinary or spelling.weights.get(got, TRUSTED) < TRUSTED)):
            hits.append((i, *got))
    weight = top = quoted = addressed = near = wrong = stem_hits = 0.0
    last = -10**9
    for i, term, edits in hits:
        w = spelling.weights.get((term, edits), machine.weights[term])
        around = raw[max(0, i - WINDOW):i + WINDOW + 1]
        before, after = raw[max(0, i - WINDOW):i], raw[i:i + WINDOW + 1]
        opens, closes = any(x[0] in QUOTES for x in [*before, raw[i]]), any(x[-1] in QUOTES or x.rstrip(".,;:!?")[-1:] in QUOTES for x in after if x)
        if (opens and closes) or any(x.lower().strip(MARKS) in REPORT for x in before):
            quoted += 1
            continue
        addressed += any(x.lower().strip(MARKS) in ADDRESS for x in around)
        weight, top = weight + w, max(top, w)
        near += i - last <= 2 * WINDOW
        wrong += edits > 0
        stem_hits += term in stems
        last = i
    k = len(hits) - quoted
    words = max(n, 1)
    return [math.log1p(n), math.log1p(k), math.log1p(weight), math.log1p(100 * weight / words), top, float(len({t for _, t, _ in hits})), math.log1p(near), math.log1p(wrong),
            math.log1p(quoted), math.log1p(addressed), math.log1p(stem_hits), math.log1p(100 * stem_hits / words)]


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, toxic, occurrences, at most 5 so that one repetitive text does not make a term) of every text; the empty term counts its words."""
    for b in batches:
        for text, toxic in zip(b.column("text"), b.column("toxic").to_pylist()):
            counts: dict[str, int] = {"": 0}
            for w in (text.as_py() or "").lower().split():
                w = w.strip(MARKS)
                counts[""] += 1
                if len(w) >= 4:
                    counts[w] = counts.get(w, 0) + 1
                    for k in STEMS:
                        if k < len(w):
                            counts[w[:k] + "*"] = counts.get(w[:k] + "*", 0) + 1
            yield pa.record_batch([pa.array(list(counts), pa.string()), pa.array([toxic] * len(counts), pa.int32()), pa.array([n if not t else min(n, 5) for t, n in counts.items()], pa.int64())], ["term", "toxic", "n"])


def lexicon(sample: DataFrame, terms: int = TERMS) -> dict[str, float]:
    """Terms that are much more frequent in toxic texts, with the logarithm of how much more; counted over all texts of the sample.

    A term is in four toxic texts and 2% of them or more and eight times as frequent there, counts smoothed. A stem is left out where one longer term has
    most of its occurrences, and so is a longer stem that a chosen one covers with about the same ratio. At most ``terms`` are chosen, by support and ratio, and
    whole words that their stems cover come with them, as only whole words are met misspelled.
    """
    counts = sample.mapInArrow(_terms, "term string, toxic int, n long").groupBy("term").agg(
        F.sum(F.col("toxic").cast("long")).alias("docs"), F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("q"))
    counts = cut(counts.where("term = '' or docs >= 4"))
    total = counts.where("term = ''").first()
    if total is None or not total.p or not total.q:
        return {}
    ratio = F.log((F.col("p") + 0.5) / F.lit(total.p + 1.0)) - F.log((F.col("q") + 0.5) / F.lit(total.q + 1.0))
    found = counts.where("term <> ''").withColumn("r", ratio).where((F.col("r") >= TRUSTED) & (F.col("docs") >= 0.02 * total.docs)).orderBy(F.desc(F.col("docs") * F.col("r")), "term").limit(4 * terms).collect()
    ratios, support = {r.term: round(float(r.r), 6) for r in found}, {r.term: r.p for r in found}

    def heads(term: str) -> list[str]:
        return [s for k in STEMS if k <= len(term.rstrip("*")) and (s := term[:k] + "*") in ratios and s != term]

    told = {s for t in ratios for s in heads(t) if support[t] >= 0.8 * support[s]}  # a longer term says the same
    kept = [r.term for r in found if r.term not in told]
    stems = {t for t in kept if t.endswith("*")}
    covered = {t for t in kept if any(s in stems and ratios[t] <= ratios[s] + 0.7 for s in heads(t))}
    chosen = set([t for t in kept if t not in covered][:terms])
    words = {t for t in covered if not t.endswith("*") and not chosen.isdisjoint(heads(t))}
    return {t: ratios[t] for t in sorted(chosen | words)}


def _forms(terms: tuple[tuple[str, float], ...]):
    """(form, term, edits, toxic) of every text: its distinct words that match a term with edits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(terms)
        for b in batches:
            for text, toxic in zip(b.column("text"), b.column("toxic").to_pylist()):
                words = {w.strip(MARKS) for w in (text.as_py() or "").lower().split()}
                forms = [(w, *got) for w in words if (got := machine.match(w)) is not None and got[1]]
                yield pa.record_batch([pa.array([f[0] for f in forms], pa.string()), *[pa.array([f[k] for f in forms], pa.int32()) for k in (1, 2)], pa.array([toxic] * len(forms), pa.int32())], ["form", "term", "edits", "toxic"])
    return run


def misspellings(sample: DataFrame, terms: tuple[tuple[str, float], ...]) -> tuple[Spelling, Spelling, Spelling]:
    """What the sample's texts tell of words that match with edits: for texts without a label, and for clean and toxic ones of the sample.

    A word that clean texts have is ordinary unless toxic ones have it eight times as often. The other forms of a term are counted per number of
    edits; their logarithmic ratio starts from the term's own, which counts as much as PRIOR texts, and never exceeds it. The last two leave
    out the text itself, so that the model meets words as it will in other texts.
    """
    total = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = total.get(1, 0) + 1, total.get(0, 0) + 1
    counts = sample.mapInArrow(_forms(terms), "form string, term int, edits int, toxic int").groupBy("form", "term", "edits").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("q")).collect()

    def common(own_p: int, own_q: int) -> frozenset[str]:
        return frozenset(r.form for r in counts if r.q > own_q and math.log((max(r.p - own_p, 0) + 0.5) / toxic) - math.log((r.q - own_q + 0.5) / clean) < TRUSTED)

    words, in_clean, in_toxic = common(0, 0), common(0, 1), common(1, 0)
    seen: dict[tuple[int, int], list[int]] = {}
    for r in counts:
        both = seen.setdefault((r.term, r.edits), [0, 0])
        both[0] += r.p * (r.form not in in_toxic)
        both[1] += r.q * (r.form not in in_clean)
    weights = {}
    for (term, edits), (p, q) in seen.items():
        w = terms[term][1]
        share = toxic * math.exp(w) / (toxic * math.exp(w) + clean)
        weights[term, edits] = min(w, math.log((p + PRIOR * share) / toxic) - math.log((q + PRIOR * (1 - share)) / clean))
    return Spelling(words, weights), Spelling(in_clean, weights), Spelling(in_toxic, weights)


def _feature_rows(terms: tuple[tuple[str, float], ...], spelling: Spelling, by_label: tuple[Spelling, Spelling] | None = None):
    stems = frozenset(i for i, (t, _) in enumerate(terms) if t.endswith("*"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(terms)
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                part = b.slice(lo, 200)
                known = [by_label[k] for k in part.column("toxic").to_pylist()] if by_label else [spelling] * part.num_rows
                rows = [features(t.as_py(), machine, stems, k) for t, k in zip(part.column("text"), known)]
                keep = [c for c in part.schema.names if c != "text"]
                yield pa.record_batch([*[part.column(c) for c in keep], pa.array(rows, pa.list_(pa.float64()))], [*keep, "x"])
    return run


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, scale and weights (the last is the intercept) by ridge-regularised Newton steps."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS, terms: int = TERMS):
    """Lexicon and classifier from at most ``rows`` labelled rows (chosen by hash of doc_id) whose crc32(doc_id as text) mod 5 is not 0."""
    small_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)")
    known = known.where(F.crc32(F.col("_id").cast("string")) % 5 != 0).groupBy("_id").agg(F.max("toxic").alias("toxic"))
    known = cut(known.orderBy(F.xxhash64("_id"), "_id").limit(rows))  # bounded by rows, so it can be broadcast
    sample = cut(docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known), F.col("doc_id") == F.col("_id")).select("text", "toxic"))
    chosen = tuple(lexicon(sample, terms).items())
    spelling, *by_label = misspellings(sample, chosen) if chosen else [Spelling()] * 3
    table = sample.mapInArrow(_feature_rows(chosen, spelling, tuple(by_label)), "toxic int, x array<double>").collect() if chosen else []
    y = np.array([r.toxic for r in table], float)
    if not len(y) or y.min() == y.max():
        return (), spelling, None
    return chosen, spelling, fit_logistic(np.array([r.x for r in table])[:, MODELLED], y)


def _scores(x: np.ndarray, model) -> np.ndarray:
    mean, scale, w = model
    return 1 / (1 + np.exp(-np.clip((x[:, MODELLED] - mean) / scale @ w[:-1] + w[-1], -30, 30)))


def _scored_rows(terms: tuple[tuple[str, float], ...], spelling: Spelling, model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _feature_rows(terms, spelling)(batches):
            x = np.array(b.column("x").to_pylist()).reshape(b.num_rows, len(FEATURES))
            yield pa.record_batch([b.column("doc_id"), pa.array(_scores(x, model)), pa.array(np.rint(np.expm1(x[:, 1])).astype(np.int64))], ["doc_id", "score", "hits"])
    return run


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = ROWS, terms: int = TERMS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted and hits (terms met outside quotations).

    Words are matched with a learned lexicon: whole terms with up to two misspellings by their length, stems as beginnings. A hit counts by
    its context of five words either way: in quotation marks or after a word of reporting it is a quotation and only counted apart, else it
    adds to sums and shares of weight. A logistic model turns these into a score.

    Learned from ``labels`` (doc_id, toxic) of rows that are not held out: at most ``rows`` of them. Null and empty texts have no words and
    get the score of a text without hits. Rows without doc_id are scored and count as held out. Without labels of both classes every score
    is 0. Repeated rows are scored alike; extra columns are ignored.
    """
    chosen, spelling, model = fit(docs, labels, rows, terms)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True)).alias("held_out")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if model is None:
        return plain.select("doc_id", held, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.lit(0).cast("long").alias("hits"))
    scored = plain.mapInArrow(_scored_rows(chosen, spelling, model), "doc_id long, score double, hits long")
    return scored.select("doc_id", held, "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "hits")


def without_toxic(docs: DataFrame, labels: DataFrame, rows: int = ROWS, terms: int = TERMS) -> DataFrame:
    """The rows of ``docs`` whose score is below 0.5, with all their columns; without labels of both classes all of them."""
    chosen, spelling, model = fit(docs, labels, rows, terms)
    if model is None:
        return docs
    stems = frozenset(i for i, (t, _) in enumerate(chosen) if t.endswith("*"))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        machine = automaton(chosen)
        return pd.Series(_scores(np.array([features(t, machine, stems, spelling) for t in texts]).reshape(len(texts), len(FEATURES)), model))

    return docs.where(score(F.col("text").cast("string")) < 0.5)
