"""Toxicity scores: a learnt lexicon in a trie, met with Levenshtein automata, and hits read in context.

The lexicon holds whole words and stems (word beginnings of 3 to 8 characters) that the toxic
documents of a bounded labelled sample use, outside quotations, far more often than the others do. All terms stand in one
trie. ``Automaton`` runs the Levenshtein automata of all terms at once over that trie: a state is the
set of (node, errors) still possible, and states are made as words need them, so that a word costs a
table lookup per character. Whole words of 5 or more characters may hold one error, of 9 or more
two; stems have to match exactly.

A hit is worth its term's log-odds, less for each error. In a window of words around it, quotation
marks on both sides or words of reporting speech make it a quotation (worth half), words of address
make it abuse (worth a quarter more). A logistic fit on other rows of the sample turns a document's
sum, its largest hit and their density into a probability.

Edge cases: null and empty texts score as texts without hits; texts of any length are read whole; a
null doc_id is kept, its held_out is null; repeated rows get the same score each; of terms that a word
may be, the weightiest counts; extra columns are ignored (score() hands them on); an empty table gives an empty result; without labels of
both kinds every score is the share of label 1, or 0 without labels.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm import labelled, scratch
from inkwell.llm.batches import held_out, slices, texts

THRESHOLD = 0.5
MIN_TOXIC = 4
MIN_ODDS = 3.0
STEMS = range(3, 9)
WINDOW = 6
CACHE = 400_000
EDGES = "\"'“”‘’«»„‹›.,;:!?()[]{}<>*_-–—…#$%&|~`"
#: A short quotation: what stands in it says nothing about the document that quotes it.
QUOTATION = re.compile(r"[\"“„«‹][^\"“„«‹”»›\n]{1,80}[\"”»›]")
OPENING, CLOSING = frozenset("\"“„«‹‘"), frozenset("\"”“»›’")

# Words of reporting speech and of direct address.
REPORTING = frozenset("said says say saying called calls quote quoted quotes wrote writes term word words phrase asked told reported dit disait écrit mot mots sagte schrieb wort dijo escribió palabra".split())
ADDRESS = frozenset("you your you're u ur yourself du dich dein dir tu te toi ton vous tú ti usted vos".split())


def norm(word: str) -> str:
    return word.strip(EDGES).lower()


def allowed(term: str) -> int:
    """Errors that a whole word may hold."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Automaton:
    """The Levenshtein automata of all terms over their trie; states are sets of (node, errors), made when needed."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.word: list[tuple[str, float] | None] = [None]
        self.stem: list[float | None] = [None]
        self.errors = [0]  # that any whole word below a node allows
        for term, weight in words.items():
            self.word[self._add(term, allowed(term))] = (term, weight)
        for term, weight in stems.items():
            self.stem[self._add(term, 0)] = weight
        self.start = self._state({(0, 0)})
        self.next: dict[tuple[int, str], int] = {}

    def _add(self, term: str, errors: int) -> int:
        node = 0
        self.errors[0] = max(self.errors[0], errors)
        for c in term:
            if c not in self.children[node]:
                self.children[node][c] = len(self.children)
                self.children.append({})
                self.word.append(None)
                self.stem.append(None)
                self.errors.append(0)
            node = self.children[node][c]
            self.errors[node] = max(self.errors[node], errors)
        return node

    _ids: dict[frozenset, int]

    def _state(self, found: set[tuple[int, int]]) -> int:
        """The number of a state; characters of a term that the text leaves out are errors of their own."""
        best: dict[int, int] = {}
        todo = list(found)
        while todo:
            node, e = todo.pop()
            if e > self.errors[node] or best.get(node, 99) <= e:
                continue
            best[node] = e
            todo += [(child, e + 1) for child in self.children[node].values()]
        key = frozenset(best.items())
        if not hasattr(self, "_ids"):
            self._ids, self.sets, self.value, self.exact = {}, [], [], []
        if key not in self._ids:
            self._ids[key] = len(self.sets)
            self.sets.append(key)
            hits = [(self.word[n][1] * 0.8**e) for n, e in key if self.word[n] and e <= allowed(self.word[n][0])]
            self.value.append(max(hits, default=0.0))
            self.exact.append(max((self.stem[n] for n, e in key if e == 0 and self.stem[n]), default=0.0))
        return self._ids[key]

    def _step(self, state: int, c: str) -> int:
        out = set()
        for node, e in self.sets[state]:
            out.add((node, e + 1))
            for x, child in self.children[node].items():
                out.add((child, e if x == c else e + 1))
        return self._state(out)

    def weight(self, word: str) -> float:
        """The most that a term is worth which the word is, nearly is, or begins with; 0 for none."""
        state, best = self.start, 0.0
        for c in word:
            to = self.next.get((state, c))
            if to is None:
                if len(self.sets) > CACHE:
                    del self._ids
                    self.next.clear()
                    return self.weight_again(word)
                to = self.next[state, c] = self._step(state, c)
            state = to
            if not self.sets[state]:
                return best
            best = max(best, self.exact[state])
        return max(best, self.value[state])

    def weight_again(self, word: str) -> float:
        self.start = self._state({(0, 0)})
        return self.weight(word)


def learn_terms(sample: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Whole words and stems with their log-odds, from (text, y).

    The sample is bounded, and so is the lexicon: all terms count that MIN_TOXIC of its documents hold.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[tuple[str, int]] = Counter()
        for b in slices(batches):
            for text, y in zip(texts(b["text"]), b["y"].to_pylist(), strict=True):
                words = {norm(w) for w in set(QUOTATION.sub(" ", text).split())}
                words.discard("")
                found = {w + "$" for w in words if len(w) >= 3}
                found.update(w[:n] for w in words for n in STEMS if len(w) > n)
                seen.update((t, y) for t in found)
            if len(seen) > CACHE:
                yield out(seen)
                seen.clear()
        yield out(seen)

    def out(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([t for t, _ in seen], pa.string()), pa.array([n if y else 0 for (_, y), n in seen.items()], pa.int64()), pa.array([0 if y else n for (_, y), n in seen.items()], pa.int64())], ["term", "toxic", "clean"])

    totals = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    if len(totals) < 2:
        return {}, {}
    counted = sample.mapInArrow(count, "term string, toxic bigint, clean bigint").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = F.log((F.col("toxic") + 0.25) / (totals[1] + 0.5)) - F.log((F.col("clean") + 0.25) / (totals[0] + 0.5))
    rows = counted.where((F.col("toxic") >= MIN_TOXIC) & (odds >= MIN_ODDS)).select("term", "toxic", odds.alias("odds")).collect()
    weights = {r["term"]: (r["odds"], r["toxic"]) for r in rows}
    words, stems = {}, {}
    for term, (weight, toxic) in sorted(weights.items(), key=lambda x: len(x[0])):
        if term.endswith("$"):
            words[term[:-1]] = weight
        # A stem says more than the stem that it begins with only if it's clearly purer.
        elif all(weights[term[:n]][0] < weight - 0.7 for n in range(3, len(term)) if term[:n] in weights):
            stems[term] = weight
    # A stem that only one word makes up is that word, which may hold errors then.
    for stem in [s for s in stems if any(w.startswith(s) and weights[w + "$"][1] >= 0.9 * weights[s][1] for w in words)]:
        del stems[stem]
    return words, stems


class Scorer:
    """Scores whole texts; words already looked up are kept in a bounded table."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], fit: np.ndarray) -> None:
        self.words, self.stems, self.fit = words, stems, fit
        self.automaton: Automaton | None = None
        self.table: dict[str, float] = {}

    def __getstate__(self) -> dict:
        return {"words": self.words, "stems": self.stems, "fit": self.fit, "automaton": None, "table": {}}

    def hits(self, text: str) -> list[tuple[int, str, float, str]]:
        """(word number, word, worth, context) of each hit; context is quoted, abuse or plain."""
        if self.automaton is None:
            self.automaton = Automaton(self.words, self.stems)
        split, table = text.split(), self.table
        found = set()
        for w in set(split):
            weight = table.get(w)
            if weight is None:
                if len(table) > CACHE:
                    table.clear()
                weight = table[w] = self.automaton.weight(norm(w))
            if weight:
                found.add(w)
        out = []
        for i, w in enumerate(split if found else ()):
            if w in found:
                context = self.context(split, i)
                out.append((i, w, table[w] if w in table else self.automaton.weight(norm(w)), context))
        return out

    @staticmethod
    def context(split: list[str], i: int) -> str:
        before, after = split[max(0, i - WINDOW) : i], split[i + 1 : i + 1 + WINDOW]
        opened = any(w[0] in OPENING for w in [*before, split[i]]) and not any(w[-1] in CLOSING for w in before)
        closed = any(w.rstrip(".,;:!?")[-1:] in CLOSING and w.rstrip(".,;:!?") for w in [split[i], *after])
        near = {norm(w) for w in [*before, *after]}
        if (opened and closed) or near & REPORTING:
            return "quoted"
        return "abuse" if near & ADDRESS else "plain"

    def features(self, text: str) -> list[float]:
        worth = [w * {"quoted": 0.5, "plain": 1.0, "abuse": 1.25}[c] for _, _, w, c in self.hits(text)]
        total = sum(worth)
        return [1.0, float(np.log1p(total)), max(worth, default=0.0), float(np.log1p(100 * total / (20 + len(text.split())))) if worth else 0.0]

    def score(self, given: list[str]) -> np.ndarray:
        x = np.array([self.features(t) for t in given], np.float64).reshape(-1, 4)
        return 1 / (1 + np.exp(-np.clip(x @ self.fit, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 60) -> np.ndarray:
    """Weights of a logistic fit by Newton steps; the constant isn't shrunk. More hits never make a text less toxic."""
    free = list(range(x.shape[1]))
    while True:
        w, xf = np.zeros(len(free)), x[:, free]
        penalty = ridge * np.diag([0.0 if i == 0 else 1.0 for i in free])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(xf @ w, -30, 30)))
            step = np.linalg.solve(xf.T @ (xf * (p * (1 - p) + 1e-9)[:, None]) + penalty + 1e-6 * np.eye(len(free)), xf.T @ (y - p) - penalty @ w)
            w = w + np.clip(step, -4, 4)
        low = [i for i, v in zip(free, w, strict=True) if i and v < 0]
        if not low:
            out = np.zeros(x.shape[1])
            out[free] = w
            return out
        free = [i for i in free if i not in low]


def fit(sample: DataFrame) -> Scorer:
    """Terms from parts 0 and 1 of the sample, the logistic fit from parts 2 and 3."""
    words, stems = learn_terms(sample.where("part < 2"))
    scorer = Scorer(words, stems, np.zeros(4))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([scorer.features(t) for t in texts(b["text"])], pa.list_(pa.float64())), b["y"]], ["x", "y"])

    rows = sample.where("part >= 2").mapInArrow(measure, "x array<double>, y int").collect()
    y = np.array([r["y"] for r in rows], np.float64)
    if len(set(y.tolist())) < 2:
        share = min(max(float(y.mean()) if len(y) else 0.0, 1e-9), 1 - 1e-9)
        scorer.fit = np.array([np.log(share / (1 - share)), 0.0, 0.0, 0.0])
    else:
        scorer.fit = logistic(np.array([r["x"] for r in rows]), y)
    return scorer


def score(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """docs with ``toxicity`` and ``toxic_hits`` (word number:word:context of each hit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            given = texts(b["text"])
            hits = [[f"{i}:{w}:{c}" for i, w, _, c in scorer.hits(t)] for t in given]
            yield b.append_column("toxicity", pa.array(scorer.score(given), pa.float64())).append_column("toxic_hits", pa.array(hits, pa.list_(pa.string())))

    plain = docs.drop("toxicity", "toxic_hits")
    return plain.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema), "toxicity double", "toxic_hits array<string>"]))


def query(spark, sf_dir: str) -> DataFrame:
    """op9: all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    sample = labelled.sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "toxic")
    scorer = fit(sample)
    scratch.drop(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            scores = scorer.score(texts(b["text"]))
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array([held_out(i) for i in b["doc_id"].to_pylist()], pa.bool_()), pa.array(scores, pa.float64()), pa.array((scores >= THRESHOLD).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    return docs.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")
