"""Quality rules as weak supervision.

Each rule votes + (good), - (bad) or 0 (abstains) on a document. Expectation-maximisation over the counts of vote patterns
estimates how often each rule votes each way on good and on bad documents; a document is kept when its posterior
probability of being good reaches a threshold. At most 3^rules pattern counts go to the driver, whatever the input.

Null and empty texts have no words, all rules abstain on them and the base test rejects them. Texts of any length are read
whole. Equal texts get equal votes. An empty table gives an empty one. Extra columns pass through `score` untouched,
whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readmill.llm.common import map_batches, utf8, window_hashes, word_hashes, written

_SPACE = b" \t\n\x0b\x0c\r"
_CONTINUED = bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_UPPER, _LETTERS = bytes(range(65, 91)), bytes(range(65, 91)) + bytes(range(97, 123))

BASE = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long")]

_NEVER = lambda m: False
#: Name: (bad where, good where); elsewhere the rule abstains. The ratios are those of `measures`. Most rules can only condemn.
RULES = {
    "repetition": (lambda m: m["repeat"] > 0.3, _NEVER),
    "symbols": (lambda m: m["symbols"] > 0.1, _NEVER),
    "duplicate_lines": (lambda m: m["dup_lines"] > 0.3, _NEVER),
    "word_length": (lambda m: m["length"] < 2.5 or m["length"] > 14, _NEVER),
    "capitals": (lambda m: m["capitals"] > 0.4, _NEVER),
    "shouting": (lambda m: m["doubled"] > 0.1, _NEVER),
    "vocabulary": (lambda m: m["words"] >= 50 and m["distinct"] < 0.15, lambda m: m["distinct"] > 0.4),
    "sentences": (lambda m: m["words"] >= 50 and m["ends"] < 0.002, lambda m: 0.02 <= m["ends"] <= 0.3),
    "punctuation": (lambda m: m["marks"] > 0.12, lambda m: m["marks"] < 0.06),
}


def covered(starts: np.ndarray, window: int, n: int) -> np.ndarray:
    """Which of n places lie in a window that starts at one of the marked places."""
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(starts)
    edge[at] += 1
    np.subtract.at(edge, np.minimum(at + window, n), 1)
    return np.cumsum(edge[:n]) > 0


def measures(text: bytes) -> tuple[list[int], str]:
    """The base counts and the rules' votes."""
    words = text.split()
    n = len(words)
    n_symbols = len(text) - len(text.translate(None, _SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    n_dup = len(lines) - len(set(lines))
    n_repeat = 0
    if n > 8:
        hashes = window_hashes(word_hashes(text), 8)
        ordered = np.sort(hashes)
        if (ordered[1:] == ordered[:-1]).any():
            _, back, count = np.unique(hashes, return_inverse=True, return_counts=True)
            n_repeat = int(covered(count[back] > 1, 8, n).sum())
    chars = len(text.translate(None, _SPACE + _CONTINUED))
    base = [n, chars, n_symbols, n_dup, n_repeat]
    if not n:
        return base, "0" * len(RULES)
    letters = len(text) - len(text.translate(None, _LETTERS))
    m = {
        "words": n, "lines": len(lines), "repeat": n_repeat / n, "symbols": n_symbols / n, "dup_lines": n_dup / max(1, len(lines)), "length": chars / n,
        "capitals": (len(text) - len(text.translate(None, _UPPER))) / max(1, letters), "distinct": len(set(words)) / n**0.9,
        "ends": (text.count(b". ") + text.count(b".\n") + text.count(b"? ") + text.count(b"! ") + text.endswith((b".", b"?", b"!"))) / n, "doubled": text.count(b"!!") / n,
        "marks": (len(text) - len(text.translate(None, _MARKS))) / chars,
    }
    return base, "".join("-" if bad(m) else "+" if good(m) else "0" for bad, good in RULES.values())


def score(docs: DataFrame, keep: list[str], prefix: str = "") -> DataFrame:
    """The columns `keep` of docs, the base counts, base_failed and votes; `prefix` goes before the names of the new columns."""
    names = [prefix + x for x, _ in BASE] + [prefix + "votes"]
    columns = [f"`{c}`" for c in dict.fromkeys([*keep, "text"])]
    src = docs.select(*columns)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[f"`{c}`" for c in keep]).schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [measures(t) for t in utf8(batch, "text")]
            counts = [pa.array([g[0][k] for g in got], pa.int64()) for k in range(len(BASE))]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + counts + [pa.array([g[1] for g in got], pa.string())], names=[*keep, *names])

    out = map_batches(src, run, ", ".join([*fields, *(f"`{prefix}{c}` {t}" for c, t in BASE), f"`{prefix}votes` string"]))
    n, again = F.col(f"`{prefix}n_words`"), F.col(f"`{prefix}n_repeat_words`")
    return out.withColumn(f"{prefix}base_failed", (n < 20) | (100 * again > 30 * n))


@dataclass
class LabelModel:
    """P(good), and P(vote | class) of each rule as arrays [rule, class bad/good, vote -/0/+]."""

    prior: float
    votes: np.ndarray

    def log_odds(self, votes: str = "votes") -> Column:
        odds = F.lit(float(np.log(self.prior) - np.log1p(-self.prior)))
        ratio = np.log(self.votes[:, 1]) - np.log(self.votes[:, 0])
        for k, (bad, none, good) in enumerate(ratio.tolist()):
            vote = F.substring(F.col(f"`{votes}`"), k + 1, 1)
            odds = odds + F.when(vote == "-", bad).when(vote == "+", good).otherwise(none)
        return odds

    def posterior(self, votes: str = "votes") -> Column:
        return 1 / (1 + F.exp(-self.log_odds(votes)))


def fit(patterns: dict[str, int], rounds: int = 200, weight: float = 0.02) -> LabelModel:
    """EM over vote patterns and their counts. The prior belief, worth `weight` of the votes, is that rules seldom condemn a good document and seldom praise a bad one."""
    r = len(RULES)
    total = sum(patterns.values())
    n = np.array(list(patterns.values()), float)
    index = np.array([["-0+".index(c) for c in p] for p in patterns], int).reshape(len(n), r)
    belief = np.array([[0.3, 0.6, 0.1], [0.02, 0.38, 0.6]]) * (10 + weight * total)
    prior, votes = 0.8, np.repeat(belief[None] / belief.sum(1, keepdims=True), r, 0)
    for _ in range(rounds):
        loglik = [np.log(votes[np.arange(r), c, index]).sum(1) if len(n) else np.zeros(0) for c in (0, 1)]
        good = 1 / (1 + np.exp(np.clip(loglik[0] - loglik[1] + np.log1p(-prior) - np.log(prior), -500, 500)))
        before, prior = prior, float((good @ n + 8) / (total + 10))
        for c, share in enumerate((1 - good, good)):
            for v in range(3):
                votes[:, c, v] = belief[c, v] + ((index == v) * (share * n)[:, None]).sum(0)
        votes /= votes.sum(2, keepdims=True)
        if abs(before - prior) < 1e-9:
            break
    return LabelModel(prior, votes)


def fit_votes(scored: DataFrame, votes: str = "votes", words: str = "n_words") -> LabelModel:
    """Fitted on the vote patterns of all documents that have words."""
    counts = scored.where(F.col(f"`{words}`") > 0).groupBy(F.col(f"`{votes}`").alias("votes")).count().collect()
    return fit(dict(sorted((r["votes"], r["count"]) for r in counts)))


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, votes and posterior of each document."""
    scored = written(score(docs, ["doc_id"]), "quality")
    p = fit_votes(scored).posterior()
    return scored.withColumn("posterior", p).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    prefix = "_q_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    model = fit_votes(score(docs, []))
    good = ~F.col(f"`{prefix}base_failed`") & (model.posterior(f"{prefix}votes") >= threshold)
    return score(docs, docs.columns, prefix).where(good).select(*[f"`{c}`" for c in docs.columns])
