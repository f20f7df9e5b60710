"""Quality rules as a learned decision list.

Every text gives counts (``TEXT_STATS``); ratios of these counts are what the rules
look at. From labelled documents sequential covering learns which texts are low in
quality: a rule is grown by adding the threshold condition with the highest
information gain until it covers no good text, then pruned from its end by its
precision on documents that did not grow it; what it covers is taken away and the
next rule is learned from the rest. A rule stays only if it is precise enough on the
pruning part, so good documents are left alone. The list is given to Spark as one
ordered conditional expression over the counts.

Base rules come first: texts of fewer than 50 words, or of which more than half of
the words stand in repeated three-word windows, fail whatever the list says.

Whole texts are counted; the labelled documents that the list is learned from are
at most ``LABELLED`` (by the hash of their doc_id), of which only numbers reach the
driver. Documents with a null doc_id, without a label of 0 or 1, or with labels that
contradict each other teach nothing; without both labels the list is empty and the
base rules decide alone. Null and empty texts have no words and fail the base
rules. Repeated rows keep their own rows, other columns are not read, and an empty
table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LABELLED = 20_000  # labelled documents that the list is learned from, at most
LEAST_WORDS = 50
REPEATED_PERCENT = 50
PRECISION = 0.95  # of a rule on the pruning part, at least
LEAST_COVER = 3  # low-quality documents of the pruning part that a rule must cover
MAX_RULES, MAX_CONDITIONS = 24, 4
PRUNE_EVERY = 3  # every third labelled document prunes

# Counts of a text: words (runs without ASCII white space), their code points,
# symbols, lines with a word that equal an earlier line, words in repeated
# three-word windows, distinct words, lines with a word, capitals A-Z and stops.
TEXT_STATS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_distinct", "n_lines", "n_capitals", "n_stops",
]
SYMBOLS, STOPS = b"#*$%&|<>", b".!?"
SPACES = b" \t\n\x0b\x0c\r"
CAPITALS = bytes(range(65, 91))
# What the rules look at: a count, or a count for each of another.
RATIOS = [
    ("n_words", None), ("word_chars", "n_words"), ("n_symbols", "n_words"), ("n_dup_lines", "n_lines"),
    ("n_repeat_words", "n_words"), ("n_distinct", "n_words"), ("n_words", "n_lines"),
    ("n_capitals", "n_words"), ("n_stops", "n_words"),
]


def _repeated(words: list[bytes]) -> tuple[int, int]:
    """(words in three-word windows found twice or more, distinct words)."""
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), "i8", len(words))
    if len(ids) < 4 or len(names) == len(ids):
        return 0, len(names)
    pairs = ids[:-1] * len(names) + ids[1:]
    # Pairs are renumbered first: three word numbers in one may not fit.
    pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * len(names) + ids[2:]
    _, which, n = np.unique(windows, return_inverse=True, return_counts=True)
    found = n[which] > 1
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[k : k + len(found)] |= found
    return int(covered.sum()), len(names)


def text_counts(text: str | None) -> tuple[int, ...]:
    """The counts of ``TEXT_STATS`` of one whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return 0, 0, len(raw) - len(raw.translate(None, SYMBOLS)), 0, 0, 0, 0, 0, 0
    size = len(raw)
    solid = raw.translate(None, SPACES)
    lines = [line for line in raw.split(b"\n") if line and not line.isspace()]
    repeated, distinct = _repeated(words)
    return (
        len(words),
        len(text) - (size - len(solid)),  # white space is one byte a code point
        size - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        distinct,
        len(lines),
        size - len(raw.translate(None, CAPITALS)),
        size - len(raw.translate(None, STOPS)),
    )


@F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in TEXT_STATS]))
def text_stats(texts: pd.Series) -> pd.DataFrame:
    rows = np.array([text_counts(t) for t in texts], "i8").reshape(len(texts), len(TEXT_STATS))
    return pd.DataFrame(rows, columns=TEXT_STATS)


def base_failed(stats: str) -> Column:
    n = F.col(f"{stats}.n_words")
    return (n < LEAST_WORDS) | (F.col(f"{stats}.n_repeat_words") * 100 > n * REPEATED_PERCENT)


# ---------------------------------------------------------------------------
# Sequential covering
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Condition:
    ratio: int  # index into RATIOS
    above: bool
    bound: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return x[:, self.ratio] > self.bound if self.above else x[:, self.ratio] <= self.bound

    def column(self, stats: str) -> Column:
        value = ratio_column(self.ratio, stats)
        return value > F.lit(self.bound) if self.above else value <= F.lit(self.bound)


def ratio_column(ratio: int, stats: str) -> Column:
    over, under = RATIOS[ratio]
    value = F.col(f"{stats}.{over}").cast("double")
    return value if under is None else value / F.greatest(F.col(f"{stats}.{under}"), F.lit(1)).cast("double")


def ratios(counts: np.ndarray) -> np.ndarray:
    """Rows of counts to rows of ratios, as Spark works them out."""
    at = {c: i for i, c in enumerate(TEXT_STATS)}
    out = np.empty((len(counts), len(RATIOS)))
    for k, (over, under) in enumerate(RATIOS):
        out[:, k] = counts[:, at[over]]
        if under is not None:
            out[:, k] /= np.maximum(counts[:, at[under]], 1)
    return out


def best_condition(x: np.ndarray, bad: np.ndarray) -> Condition | None:
    """The condition of highest gain over all ratios, directions and bounds; a
    bound lies half way between two neighbouring values. Ties: the first ratio,
    'at most' before 'above', the least bound."""
    p0, n0 = int(bad.sum()), int((~bad).sum())
    best, gain = None, 1e-9
    before = np.log2(p0 / (p0 + n0)) if p0 else 0.0
    for k in range(x.shape[1]):
        order = np.argsort(x[:, k], kind="stable")
        value = x[order, k]
        cuts = np.flatnonzero(value[1:] > value[:-1])
        if not len(cuts):
            continue
        p_low = np.cumsum(bad[order])[cuts].astype("f8")
        n_low = cuts + 1.0 - p_low
        for above, p, n in ((False, p_low, n_low), (True, p0 - p_low, n0 - n_low)):
            with np.errstate(divide="ignore", invalid="ignore"):
                now = np.where(p > 0, p * (np.log2(p / (p + n)) - before), -1.0)
            i = int(now.argmax())
            if now[i] > gain:
                low, high = value[cuts[i]], value[cuts[i] + 1]
                middle = low + (high - low) / 2
                best, gain = Condition(k, above, float(middle if low <= middle < high else low)), now[i]
    return best


def grow(x: np.ndarray, bad: np.ndarray) -> list[Condition]:
    rule: list[Condition] = []
    while bad.any() and not bad.all() and len(rule) < MAX_CONDITIONS:
        more = best_condition(x, bad)
        if more is None:
            break
        rule.append(more)
        keep = more.holds(x)
        x, bad = x[keep], bad[keep]
    return rule


def covered_by(rule: list[Condition], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def prune(rule: list[Condition], x: np.ndarray, bad: np.ndarray) -> tuple[list[Condition], int, int]:
    """The beginning of the rule with the best (p - n) / (p + n) on the pruning
    part, the shortest of equals, with its p and n there."""
    best = (rule, 0, 0)
    worth = -2.0
    for size in range(1, len(rule) + 1):
        hit = covered_by(rule[:size], x)
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        now = (p - n) / (p + n) if p + n else -1.0
        if now > worth:
            best, worth = (rule[:size], p, n), now
    return best


def learn(counts: np.ndarray, bad: np.ndarray) -> list[list[Condition]]:
    """Rules, in order, for rows of counts and whether each is low in quality."""
    x = ratios(np.asarray(counts, "f8").reshape(-1, len(TEXT_STATS)))
    bad = np.asarray(bad, bool)
    pruning = np.arange(len(x)) % PRUNE_EVERY == PRUNE_EVERY - 1
    gx, gbad, px, pbad = x[~pruning], bad[~pruning], x[pruning], bad[pruning]
    rules: list[list[Condition]] = []
    while len(rules) < MAX_RULES and gbad.any():
        rule = grow(gx, gbad)
        if not rule:
            break
        rule, p, n = prune(rule, px, pbad)
        if p < LEAST_COVER or p < PRECISION * (p + n):
            break
        rules.append(rule)
        gx, gbad = (a[~covered_by(rule, gx)] for a in (gx, gbad))
        px, pbad = (a[~covered_by(rule, px)] for a in (px, pbad))
    return rules


def rule_number(rules: list[list[Condition]], stats: str) -> Column:
    """The list as one conditional expression: the number (from 1) of the first rule
    that holds, 0 if none does."""
    out = None
    for number, rule in enumerate(rules, 1):
        holds = rule[0].column(stats)
        for c in rule[1:]:
            holds = holds & c.column(stats)
        out = F.when(holds, number) if out is None else out.when(holds, number)
    return F.lit(0) if out is None else out.otherwise(0)


def labelled_counts(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """(counts, low in quality) of the documents that pass the base rules among at
    most ``limit`` labelled ones, in the order of a hash: a rerun learns from the
    same ones. The chosen ids are broadcast (``limit`` rows at most), so no text is
    moved; the counts are worked out for their documents only."""
    sure = (
        labels.select(F.col("doc_id").alias("__id"), F.col("quality").alias("__q"))
        .where("__id IS NOT NULL AND __q IN (0, 1)")
        .groupBy("__id")
        .agg(F.min("__q").alias("__q"), F.max("__q").alias("__most"))
        .where("__q = __most")
    )
    chosen = sure.orderBy(F.xxhash64("__id"), "__id").limit(limit)
    rows = (
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))
        .select("__id", "__q", text_stats("text").alias("s"))
        .orderBy(F.xxhash64("__id"), "__id", "s")
        .limit(limit)
        .select("s.*", "__q")
        .toPandas()
    )
    counts = rows[TEXT_STATS].to_numpy("i8").reshape(-1, len(TEXT_STATS))
    n, repeated = counts[:, TEXT_STATS.index("n_words")], counts[:, TEXT_STATS.index("n_repeat_words")]
    passes = (n >= LEAST_WORDS) & (100 * repeated <= REPEATED_PERCENT * n)
    return counts[passes], (rows["__q"] == 0).to_numpy(bool)[passes]


def quality_rules(docs: DataFrame, labels: DataFrame) -> list[list[Condition]]:
    return learn(*labelled_counts(docs, labels))


def describe(rules: list[list[Condition]]) -> list[str]:
    """The rules for a reader."""
    out = []
    for rule in rules:
        parts = []
        for c in rule:
            over, under = RATIOS[c.ratio]
            parts.append(f"{over if under is None else f'{over} / {under}'} {'>' if c.above else '<='} {c.bound:.6g}")
        out.append(" and ".join(parts))
    return out


def quality_report(docs: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """Per row: doc_id, the counts, base_failed, kept (false if the base rules fail
    or a rule of the list holds) and rule, the number of that rule (0: none)."""
    counted = docs.select("doc_id", text_stats("text").alias("s"))
    judged = counted.select("doc_id", "s", base_failed("s").alias("base_failed"), rule_number(rules, "s").alias("rule"))
    return judged.select(
        "doc_id", "s.*", "base_failed", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), "rule"
    )


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn the list from ``labels`` and judge every document by it."""
    return quality_report(docs, quality_rules(docs, labels))
