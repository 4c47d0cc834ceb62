"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation estimates their accuracies.

A first pass over the whole texts gives each document its counts and its votes. Documents with equal votes are alike
to the model, so it needs no more than the number of documents per vote pattern (3 to the power of the rules at most,
whatever the size of the corpus). Expectation-maximisation on these counts gives each rule's rates of voting good,
voting bad and abstaining among good and among bad documents, and each pattern's posterior probability of quality.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmint.llm.common import cut, texts, tidied

SYMBOLS = b"#*$%&|<>"
RUNS = re.compile(rb"[#*$%&|<>]+")
CLOSERS = (b".", b"!", b"?", b":", b";", b'"', "…".encode(), "»".encode(), "”".encode())
WINDOW = 8
STRETCH = 100

#: Name, and the bounds: the measure at or below the first is voted good, at or above the second bad, else abstain.
RULES = {
    "symbols": (0.05, 0.35),  # characters of SYMBOLS per word
    "marked": (0.02, 0.25),  # runs of such characters per word
    "repeats": (0.05, 0.25),  # share of words in repeated windows
    "dup_lines": (0.02, 0.30),  # share of lines that repeat an earlier one
    "shouting": (0.05, 0.30),  # share of words in capitals, of more than one letter
    "bangs": (0.05, 0.25),  # share of words that end in ! or ?
    "open_ends": (0.30, 0.95),  # share of lines of 4 words and more that end without closing punctuation
    "variety": (0.55, 0.80),  # share of words that occur before in their stretch of STRETCH words, over the whole text
    "stutter": (0.02, 0.25),  # share of words equal to the word before
    "word_length": (0.35, 0.70),  # distance of the log mean word length from that of ordinary prose
}


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of WINDOW words that occur twice or more in the text, first occurrences included.

    Windows get exact ranks by doubling: pairs of words, then of pairs, then of fours.
    """
    n = len(words)
    if n <= WINDOW:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=n)
    if len(seen) == n:
        return 0
    step = 1
    while step < WINDOW:
        pairs = ids[:-step] * (int(ids.max()) + 1) + ids[step:]
        _, ids, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        if counts.max(initial=0) < 2:
            return 0
        step *= 2
    found = np.flatnonzero(counts[ids] > 1)
    cover = np.zeros(n + 1, dtype=np.int64)
    np.add.at(cover, found, 1)
    np.add.at(cover, found + WINDOW, -1)
    return int((np.cumsum(cover)[:n] > 0).sum())


def measures(text: str | None) -> tuple[int, int, int, int, int, list[float | None]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and a measure (None: abstain) for each rule."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at exactly space and \x09-\x0D
    n = len(words)
    chars = len(text) - sum(map(raw.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    symbols = sum(raw.count(bytes([c])) for c in SYMBOLS)
    lines, long_lines, open_ends, dup, seen = 0, 0, 0, 0, set()
    for line in raw.split(b"\n"):
        kept = line.strip(b" \t\n\x0b\x0c\r")
        if not kept:
            continue
        lines += 1
        if line in seen:
            dup += 1
        seen.add(line)
        if kept.count(b" ") >= 3:
            long_lines += 1
            open_ends += not kept.endswith(CLOSERS)
    repeat = repeated_words(words)
    if not n:
        return 0, chars, symbols, dup, repeat, [None] * len(RULES)
    shouting = sum(map(bytes.isupper, (w for w in words if len(w) > 2)))
    bangs = raw.count(b"! ") + raw.count(b"? ") + raw.count(b"!\n") + raw.count(b"?\n") + raw.endswith((b"!", b"?"))
    variety = 1 - sum(len(set(words[k : k + STRETCH])) for k in range(0, n, STRETCH)) / n
    return (
        n, chars, symbols, dup, repeat,
        [
            symbols / n,
            len(RUNS.findall(raw)) / n if symbols else 0.0,
            repeat / n if n > WINDOW else None,
            dup / lines if lines > 1 else None,
            shouting / n,
            bangs / n,
            open_ends / long_lines if long_lines else None,
            variety,
            sum(map(bytes.__eq__, words, words[1:])) / n,
            abs(math.log(chars / n / 5.5)),
        ],
    )


def vote(values: list[float | None]) -> str:
    """A character for each rule: g good, b bad, - abstains."""
    return "".join("-" if v is None else "g" if v <= good else "b" if v >= bad else "-" for v, (good, bad) in zip(values, RULES.values()))


@dataclass
class Model:
    """What expectation-maximisation gives: the share of good documents, rates[class][rule][vote], posteriors by pattern."""

    prior: float
    rates: np.ndarray
    posterior: dict[str, float] = field(default_factory=dict)

    def score(self, pattern: str) -> float:
        votes = np.array(["gb-".index(c) for c in pattern])
        at = np.arange(len(votes))
        good = math.log(self.prior) + np.log(self.rates[0, at, votes]).sum()
        bad = math.log(1 - self.prior) + np.log(self.rates[1, at, votes]).sum()
        return float(1 / (1 + math.exp(min(700.0, bad - good))))


#: Belief before any document is seen: the share of good ones, and of a rule's votes (good, bad, abstain) among good and
#: among bad documents.
GOOD = 0.9
BELIEF = np.array([[0.90, 0.002, 0.098], [0.65, 0.25, 0.10]])


def fit(patterns: dict[str, int], rounds: int = 200, belief: float = 100.0) -> Model:
    """Rates and posteriors from the number of documents per vote pattern.

    It starts from BELIEF about every rule, which counts as `belief` documents of each class, however many there are:
    it decides in a small corpus and is outweighed in a large one. A rule never ends up voting bad more often among good documents than among bad ones.
    """
    keys = sorted(patterns)
    if not keys:
        return Model(0.5, np.full((2, len(RULES), 3), 1 / 3))
    n = np.array([patterns[k] for k in keys], dtype=float)
    votes = np.array([["gb-".index(c) for c in k] for k in keys])
    one_hot = np.stack([votes == v for v in range(3)], axis=2).astype(float)
    start = Model(GOOD, np.repeat(BELIEF[:, None, :], len(RULES), axis=1))
    good = np.array([start.score(k) for k in keys])
    for _ in range(rounds):
        prior = float(((n * good).sum() + belief * GOOD) / (n.sum() + belief))
        rates = np.stack([np.einsum("p,prv->rv", n * q, one_hot) + belief * b for q, b in zip((good, 1 - good), BELIEF)])
        rates /= rates.sum(axis=2, keepdims=True)
        turned = rates[0, :, 1] > rates[1, :, 1]
        rates[:, turned] = rates[:, turned].mean(axis=0)
        model = Model(prior, rates)
        new = np.array([model.score(k) for k in keys])
        done = np.abs(new - good).max() < 1e-6
        good = new
        if done:
            break
    model.posterior = dict(zip(keys, good.tolist()))
    return model


MEASURES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, votes string"


def _arrays(column) -> dict:
    got = [measures(t.as_py()) for t in column]
    out = {name: pa.array([g[i] for g in got], pa.int64()) for i, name in enumerate(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))}
    out["votes"] = pa.array([vote(g[5]) for g in got], pa.string())
    return out


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(parts):
        for part in parts:
            yield pa.RecordBatch.from_pydict({"doc_id": part.column(0)} | _arrays(part.column(1)))

    return texts(docs, id_col, text_col).mapInArrow(tidied(run), MEASURES)


def model_of(rows: DataFrame) -> Model:
    """Of rows with votes and counts that pass the base rule; the driver gets one count per pattern."""
    return fit({r.votes: r.n for r in rows.where(~failed()).groupBy("votes").agg(F.count("*").alias("n")).collect()})


def failed():
    """The base rule: too short, or too much of it repeats."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judged(rows: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """rows with base_failed, quality and kept. The posteriors of the vote patterns (3^10 short rows at most) are broadcast."""
    known = rows.sparkSession.createDataFrame(list(model.posterior.items()), "votes string, quality double")
    rows = rows.withColumn("base_failed", failed()).join(F.broadcast(known), "votes", "left").withColumn("quality", F.coalesce("quality", F.lit(0.0)))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def score_documents(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its counts, base_failed, kept, and then its votes and the posterior quality.

    The model is fitted to all documents that pass the base rule; a vote pattern that only others have scores 0.

    A null or empty text has no words: it fails the base rule, and all rules abstain. Rows that repeat count, and are
    returned, as often as they come; a null id stays null; other columns are left out.
    """
    rows = cut(measured(docs, id_col, text_col))
    out = judged(rows, model_of(rows), threshold)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "votes", "quality")


def keep_documents(docs: DataFrame, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that pass the base rule and the model.

    The votes are taken in two narrow passes over the texts (one to count patterns, one to decide), so that nothing
    is joined and no row moves.
    """
    model = model_of(measured(docs.select(F.lit(0).alias("doc_id"), F.col(f"`{text_col}`").alias("text"))))
    posterior = dict(model.posterior)
    at = docs.columns.index(text_col)

    def run(parts):
        for part in parts:
            keep = []
            for t in part.column(at):
                n, _, _, _, repeat, values = measures(t.as_py())
                keep.append(n >= 20 and 100 * repeat <= 30 * n and posterior.get(vote(values), 0.0) >= threshold)
            yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(tidied(run), docs.schema)


def op9(docs: DataFrame) -> DataFrame:
    return score_documents(docs)
