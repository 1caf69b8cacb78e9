"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lowers case, replaces letters of other scripts that look like Latin ones, reads
digits and signs inside words as the letters they stand for, and merges ``l`` with
``i`` because ``1`` stands for both. A lexicon entry is a word or the first letters of
words; its weight is the log-odds of the documents it occurs in. A match inside an
exception phrase does not count. The weights of a text's matches are summed and divided
by a power of its number of words; a logistic curve makes a probability of that.

Entries, exceptions, the power and the curve are learned from at most ``MAX_TOXIC``
toxic and ``MAX_CLEAN`` other labelled documents of the training fold, chosen by a hash
of their id. Pattern counts are aggregated by Spark; those with the evidence of an entry reach
the driver, and the sample bounds their number. Scoring is one narrow pass over all documents.

Defined results: a null text counts as empty and gets the score of a text without a
match. Rows with a null id are scored and in no fold. Ids with contradictory labels are
not learned from. Without toxic documents to learn from nothing matches. An empty table
gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fanweave.llm.labels import clear_labels, hash_sample, platt, sampled_texts, sigmoid
from fanweave.llm.rows import small_batches
from fanweave.llm.words import text_slices
from fanweave.session import stage

MAX_TOXIC = 6_000
MAX_CLEAN = 10_000
#: distinct patterns that a task counts before it hands them on
KEPT_PATTERNS = 200_000
#: an entry's least log-odds, and the least number of toxic documents it is seen in
LEAST_WEIGHT = 3.0
LEAST_DOCS = 4
STEM_LETTERS = (4, 5, 6, 7, 8)
#: contexts seen in so many clean documents and in no toxic one are exceptions
EXCEPTION_DOCS = 3
POWERS = (0.125, 0.25, 0.5, 1.0)
FLAG = 0.3
#: bytes of texts whose contexts a task holds at once
FITTED_BYTES = 1 << 17

# fixed values: letters that look like Latin ones
CYRILLIC = dict(zip("авекмнорстухісјѕԁԛԝ", "abekmhopctyxicjsdqw"))
GREEK = dict(zip("αβεικνορτυχ", "abeiknoptux"))
#: fixed values: signs that stand for letters inside a word
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g",
         "@": "a", "$": "s", "!": "i", "|": "i", "l": "i"}
PUNCTUATION = "\"#%&'()*+,-./:;<=>?[\\]^_`{}~¡¿«»„“”‘’…–—"


def _fold_table() -> dict[int, str]:
    table = {ord(k): v for k, v in (CYRILLIC | GREEK).items()}
    table |= {0xFF01 + n: chr(0x21 + n).lower() for n in range(94)}  # full-width forms
    table |= {ord(c): " " for c in PUNCTUATION}
    table |= {c: "" for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}  # invisible
    return table | {ord("l"): "i"}


_FOLD = _fold_table()
_SIGNS = str.maketrans(SIGNS)
_SIGN = re.compile(r"[0-9@$!|]")
#: the same folding for texts whose characters all are bytes of Latin-1
_FOLD_BYTES = bytes(
    ord((chr(b).lower().translate(_FOLD) or chr(b)).encode("latin-1", "replace")) for b in range(256)
)
_DROPPED_BYTES = bytes(b for b in range(256) if _FOLD.get(b) == "")


def _read_signs(word: str) -> str:
    word = word.rstrip("!|")
    return word.translate(_SIGNS) if any(c.isalpha() for c in word) else word


def folded(text: str) -> str:
    """The text's folded words, each after one space, and a space at the end."""
    try:
        out = text.encode("latin-1").translate(_FOLD_BYTES, _DROPPED_BYTES).decode("latin-1")
    except UnicodeEncodeError:
        out = text.lower().translate(_FOLD)
    words = out.split()
    if _SIGN.search(out):
        words = [_read_signs(w) if _SIGN.search(w) else w for w in words]
        words = [w for w in words if w]
    return f" {' '.join(words)} "


@dataclass
class ToxicityModel:
    """``entries``: folded text after a space, with a space behind it if it is a whole word."""

    entries: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    power: float = 1.0
    slope: float = 0.0
    shift: float = 0.0

    def matcher(self) -> ahocorasick.Automaton | None:
        if not self.entries:
            return None
        auto = ahocorasick.Automaton()
        for text in self.exceptions:
            auto.add_word(text, (len(text), None))
        for text, weight in self.entries.items():
            auto.add_word(text, (len(text), weight))
        auto.make_automaton()
        return auto

    def score(self, totals: np.ndarray, words: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * totals / np.maximum(words, 1) ** self.power + self.shift)

    def scorer(self) -> Callable[[pa.Array], np.ndarray]:
        """A function from texts to scores, which holds the automaton."""
        auto = self.matcher()

        def run(texts: pa.Array) -> np.ndarray:
            totals, words = np.zeros(len(texts)), np.zeros(len(texts))
            for i, value in enumerate(texts):
                line = folded(value.as_py() or "")
                words[i] = line.count(" ") - 1
                totals[i] = sum(matches(auto, line).values())
            return self.score(totals, words)

        return run


def matches(auto: ahocorasick.Automaton | None, text: str) -> dict[int, float]:
    """Weight by the start of each matched word of a folded text; exceptions left out."""
    best: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (length, weight) in auto.iter(text) if auto else ():
        start = end - length + 1
        if weight is None:
            spared.append((start, end))
        elif weight > best.get(start, 0.0):
            best[start] = weight
    if spared and best:
        # both lists by start: how far the exceptions that began so far reach
        spared.sort()
        reach, at = -1, 0
        for start in sorted(best):
            while at < len(spared) and spared[at][0] <= start:
                reach = max(reach, spared[at][1])
                at += 1
            if start < reach:
                del best[start]
    return best


def _patterns(text: str) -> set[str]:
    words = set(text.split())
    out = {f" {w} " for w in words if len(w) > 2}
    for n in STEM_LETTERS:
        out |= {f" {w[:n]}" for w in words if len(w) > n}
    return out


def _pattern_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of both kinds by pattern, summed over as many as ``KEPT_PATTERNS`` at once."""

    def summed(seen: tuple[Counter, Counter]) -> pa.RecordBatch:
        names = list(seen[0].keys() | seen[1].keys())
        return pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([seen[1][n] for n in names], pa.int64()),
             pa.array([seen[0][n] for n in names], pa.int64())],
            ["pattern", "toxic", "clean"],
        )

    seen = (Counter(), Counter())
    for batch in batches:
        for y, text in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist()):
            seen[y].update(_patterns(folded(text or "")))
            if len(seen[0]) + len(seen[1]) > KEPT_PATTERNS:
                yield summed(seen)
                seen = (Counter(), Counter())
    yield summed(seen)


def choose_entries(rows: Iterable[tuple[str, float]]) -> dict[str, float]:
    """The patterns, strongest first; one that a shorter, as strong one covers is left out."""
    chosen: dict[str, float] = {}
    for pattern, weight in sorted(rows, key=lambda r: (len(r[0].rstrip()), r[0])):
        stems = (pattern[:n + 1] for n in STEM_LETTERS if n + 1 < len(pattern.rstrip()) + 1)
        if not any(chosen.get(s, 0.0) >= weight - 0.5 for s in stems if s != pattern):
            chosen[pattern] = weight
    return dict(sorted(chosen.items(), key=lambda e: (-e[1], e[0])))


def _contexts(text: str, start: int) -> list[str]:
    """The matched word with the word before it, and with the word after it."""
    end = text.index(" ", start + 1)
    out = []
    if start > 0:
        out.append(text[text.rindex(" ", 0, start): end + 1])
    if end + 1 < len(text):
        out.append(text[start: text.index(" ", end + 1) + 1])
    return out


def _fitting_rows(model: ToxicityModel):
    """Per document its label, sum of weights, number of words and match contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = model.matcher()
        for batch in batches:
            # where most words match, the contexts are many times the texts
            for begin, end in text_slices(batch.column("text"), FITTED_BYTES):
                part, rows = batch.slice(begin, end - begin), []
                for y, text in zip(part.column("y").to_pylist(), part.column("text").to_pylist()):
                    line = folded(text or "")
                    found = matches(auto, line)
                    near = sorted({c for s in found for c in _contexts(line, s)})
                    rows.append((y, sum(found.values()), line.count(" ") - 1, near))
                y, total, words, near = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(y, pa.int32()), pa.array(total, pa.float64()),
                     pa.array(words, pa.int64()), pa.array(near, pa.list_(pa.string()))],
                    ["y", "total", "words", "near"],
                )

    return run


def _learn_exceptions(rows: DataFrame) -> tuple[str, ...]:
    """All phrases with the evidence; the labelled sample bounds their number."""
    near = rows.filter("size(near) > 0").select("y", F.explode("near").alias("phrase"))
    counts = near.groupBy("phrase").agg(
        F.sum(F.col("y").cast("long")).alias("toxic"), F.sum(1 - F.col("y")).alias("clean")
    )
    found = counts.filter((F.col("toxic") == 0) & (F.col("clean") >= EXCEPTION_DOCS))
    return tuple(sorted(r["phrase"] for r in found.select("phrase").collect()))


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, training: Column, id: str = "doc_id",
    text: str = "text", label: str = "toxic", exceptions: tuple[str, ...] = (),
    max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN,
) -> ToxicityModel:
    """Learn from the labelled rows for which ``training`` (over the label table) holds.

    ``exceptions``: further phrases whose words never count.
    """
    known = clear_labels(labels.filter(training), id, label)
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    wanted = hash_sample(known.filter("y = 1"), max_toxic).unionByName(
        hash_sample(known.filter("y = 0"), max_clean)
    )
    texts = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    # the sample's size is bounded by the two parameters
    sample = stage(sampled_texts(texts, wanted), "toxicity-sample")
    used = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    if not used.get(1):
        return ToxicityModel()
    n_toxic, n_clean = used[1], used.get(0, 0)
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log(
        (F.col("clean") + 0.5) / (n_clean + 1)
    )
    candidates = (
        small_batches(sample).mapInArrow(_pattern_counts, "pattern string, toxic long, clean long")
        .groupBy("pattern").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .filter(F.col("toxic") >= min(LEAST_DOCS, max(1, n_toxic // 4)))
        .withColumn("weight", odds)
    )
    least = min(LEAST_WEIGHT, np.log((n_clean + 1) / 2)) if n_clean else 0.0
    strong = candidates.filter(F.col("weight") >= float(least))
    rows = strong.select("pattern", "weight").collect()
    model = ToxicityModel(choose_entries((r["pattern"], r["weight"]) for r in rows))
    schema = "y int, total double, words long, near array<string>"
    learned = _learn_exceptions(sample.mapInArrow(_fitting_rows(model), schema))
    model.exceptions = tuple(dict.fromkeys([*map(folded, exceptions), *learned]))
    fitting = sample.mapInArrow(_fitting_rows(model), schema).select("y", "total", "words")
    fit = fitting.toPandas().sort_values(["y", "total", "words"])
    y = fit["y"].to_numpy(np.float64)
    weight = np.where(y == 1, sizes[1] / n_toxic, sizes.get(0, 0) / max(1, n_clean))
    best = np.inf
    for power in POWERS:
        x = fit["total"].to_numpy() / np.maximum(fit["words"].to_numpy(), 1) ** power
        slope, shift = platt(x, y, weight)
        p = np.clip(sigmoid(slope * x + shift), 1e-9, 1 - 1e-9)
        loss = float(-(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum())
        if loss < best:
            best, model.power, model.slope, model.shift = loss, power, slope, shift
    return model


def score_toxicity(
    docs: DataFrame, model: ToxicityModel, text: str = "text", score: str = "score"
) -> DataFrame:
    """All columns of ``docs`` and the score; an existing column of that name is replaced."""
    kept = [c for c in docs.columns if c.lower() != score.lower()]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = model.scorer()
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(scores(batch.column(text)))],
                [*kept, score],
            )

    return small_batches(docs).mapInArrow(run, schema)
