"""Language identification by a bidirectional gated recurrent network on bytes.

Two gated recurrent units read the UTF-8 bytes of a text, one from either end;
their states at a position give a softmax over the languages there, and a
document's probabilities are the mean over all its positions. The network is
trained in numpy by backpropagation through time with every position of a window
labelled with its document's language.

Texts are read whole, in windows of ``WINDOW`` bytes with the states at rest at
a window's ends, so that documents of any length cost their length and many
windows are computed at once.

Training uses a bounded sample: for each language about ``DOCS_PER_LANG`` labelled
training documents chosen by a hash, from each ``SNIPPETS`` snippets.

Null texts and texts without a letter are ``und`` with score 0; so is everything
if there is no labelled row. Repeated rows get repeated results; an empty table
gives no rows; only doc_id, text and lang are read, lang for training only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ownergraph.llm.common import free_name

DOCS_PER_LANG = 400  # training documents per language, on average; twice that at most
SNIPPETS, SNIPPET = 4, 64  # snippets per document, and their characters
UNITS = 8
WINDOW = 128
STEPS, BATCH, RATE = 350, 256, 0.015
UNKNOWN = "und"
LEAST_SCORE = 0.35  # below, no language is taken as found


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place, by the tanh that numpy has in vector form."""
    np.multiply(x, 0.5, out=x)
    np.tanh(x, out=x)
    np.multiply(x, 0.5, out=x)
    return np.add(x, 0.5, out=x)


@dataclass
class Network:
    """Weights: per direction a row of gate inputs per byte value, the recurrent
    matrix; the output layer. Gates stand in the order update, reset, new."""

    langs: list[str]
    bytes_in: np.ndarray  # 2 x 256 x 3U
    recur: np.ndarray  # 2 x U x 3U
    out: np.ndarray  # 2U x L
    bias: np.ndarray  # L

    def weights(self) -> list[np.ndarray]:
        return [self.bytes_in, self.recur, self.out, self.bias]

    def states(self, x: np.ndarray, on: np.ndarray | None, keep: list | None = None) -> np.ndarray:
        """T x B x 2U states for bytes ``x`` (T x B); ``on``: 1 where there is a
        byte. ``keep`` gets what backpropagation needs, per direction and step."""
        steps, batch = x.shape
        u = self.out.shape[0] // 2
        all_states = np.empty((steps, batch, 2 * u), np.float32)
        for way in (0, 1):
            h = np.zeros((batch, u), np.float32)
            table, recur = self.bytes_in[way], self.recur[way]
            for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
                a = table.take(x[t], axis=0)
                hu = h @ recur
                a[:, : 2 * u] += hu[:, : 2 * u]
                gates = _sigmoid(a[:, : 2 * u])
                update, reset, own = gates[:, :u], gates[:, u:], hu[:, 2 * u :]
                new = a[:, 2 * u :] + reset * own
                np.tanh(new, out=new)
                before = h
                h = new + update * (before - new)
                if on is not None:
                    h *= on[t][:, None]
                if keep is not None:
                    keep.append((way, t, before, update, reset, new, own))
                all_states[t, :, way * u : way * u + u] = h
        return all_states

    def probabilities(self, states: np.ndarray) -> np.ndarray:
        p = states @ self.out
        p += self.bias
        p -= p.max(-1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(-1, keepdims=True)
        return p

    def gradients(self, x: np.ndarray, on: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss per position and its gradients."""
        keep: list = []
        u = self.out.shape[0] // 2
        states = self.states(x, on, keep)
        p = self.probabilities(states)
        n = max(1.0, float(on.sum()))
        at = np.arange(len(y))
        loss = -float((np.log(p[:, at, y] + 1e-9) * on).sum()) / n
        p[:, at, y] -= 1
        p *= on[:, :, None] / n
        d_out = np.tensordot(states, p, ((0, 1), (0, 1)))
        d_bias = p.sum((0, 1))
        d_states = p @ self.out.T
        d_in, d_recur = np.zeros_like(self.bytes_in), np.zeros_like(self.recur)
        carry = np.zeros((2, len(y), u), np.float32)
        for way, t, before, update, reset, new, own in reversed(keep):
            d = (d_states[t, :, way * u : way * u + u] + carry[way]) * on[t][:, None]
            d_new = d * (1 - update) * (1 - new * new)
            d_update = d * (before - new) * update * (1 - update)
            d_reset = d_new * own * reset * (1 - reset)
            np.add.at(d_in[way], x[t], np.concatenate([d_update, d_reset, d_new], 1))
            d_hu = np.concatenate([d_update, d_reset, d_new * reset], 1)
            d_recur[way] += before.T @ d_hu
            carry[way] = d * update + d_hu @ self.recur[way].T
        return loss, [d_in, d_recur, d_out, d_bias]

    def read(self, texts: list[bytes]) -> np.ndarray:
        """Pooled probabilities of every text (rows of zeros for empty ones)."""
        total = np.zeros((len(texts), len(self.langs)))
        lengths = np.array([len(t) for t in texts])
        whole = lengths // WINDOW
        flat = np.frombuffer(b"".join(texts), "u1")
        start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        owner = np.repeat(np.arange(len(texts)), whole)
        first = start[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(whole) - whole, whole)) * WINDOW
        grid = np.arange(WINDOW)[:, None]
        for i in range(0, len(owner), 2048):
            p = self.probabilities(self.states(flat[first[i : i + 2048] + grid], None)).sum(0)
            np.add.at(total, owner[i : i + 2048], p)
        # The last windows, shorter ones together.
        rest = lengths % WINDOW
        owner = np.flatnonzero(rest)
        owner = owner[np.argsort(rest[owner], kind="stable")]
        for i in range(0, len(owner), 512):
            own = owner[i : i + 512]
            grid = np.arange(rest[own].max())[:, None]
            on = grid < rest[own]
            at = np.where(on, start[own] + whole[own] * WINDOW + grid, 0)
            p = self.probabilities(self.states(flat[at], on.astype(np.float32))) * on[:, :, None]
            total[own] += p.sum(0)
        return total / np.maximum(lengths, 1)[:, None]


def train(samples: list[tuple[bytes, str]], units: int = UNITS, steps: int = STEPS, seed: int = 5) -> Network | None:
    """Train on (snippet, language) pairs with Adam; languages are drawn equally
    often."""
    samples = [(s, lang) for s, lang in samples if s]
    langs = sorted({lang for _, lang in samples})
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    scale = 1 / np.sqrt(units)
    net = Network(
        langs,
        rng.normal(0, 0.3, (2, 256, 3 * units)).astype("f4"),
        rng.uniform(-scale, scale, (2, units, 3 * units)).astype("f4"),
        rng.uniform(-scale, scale, (2 * units, len(langs))).astype("f4"),
        np.zeros(len(langs), "f4"),
    )
    longest = max(len(s) for s, _ in samples)
    x = np.zeros((longest, len(samples)), "u1")
    on = np.zeros((longest, len(samples)), "f4")
    for i, (s, _) in enumerate(samples):
        x[: len(s), i] = np.frombuffer(s, "u1")
        on[: len(s), i] = 1
    y = np.array([langs.index(lang) for _, lang in samples])
    by_lang = [np.flatnonzero(y == k) for k in range(len(langs))]
    first = [np.zeros_like(w) for w in net.weights()]
    second = [np.zeros_like(w) for w in net.weights()]
    for step in range(1, steps + 1):
        take = np.concatenate([rng.choice(rows, max(1, BATCH // len(langs))) for rows in by_lang])
        _, grads = net.gradients(x[:, take], on[:, take], y[take])
        size = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = RATE * (1 - 0.9 * step / steps)
        for w, g, a, b in zip(net.weights(), grads, first, second):
            g = g * min(1.0, 1.0 / (size + 1e-9))
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            w -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)).astype("f4")
    return net


def held_out(doc_id: Column, of: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % of == fold, F.lit(False))


def training_sample(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG) -> list[tuple[bytes, str]]:
    """Snippets of a bounded hash sample of the labelled rows outside the fold.
    The counts per language value are the only thing counted before."""
    labelled = docs.select("doc_id", "text", "lang").where(
        F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))
    )
    counts = labelled.groupBy("lang").count().collect()
    if not counts:
        return []
    rates = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, docs_per_lang / r["count"])) for r in counts], "lang string, rate double")
    drawn = (
        # A row per language value.
        labelled.join(F.broadcast(rates), "lang")
        .where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.col("rate") * (1 << 20))
        .limit(2 * docs_per_lang * len(counts))
    )
    at = [1 + F.pmod(F.xxhash64("doc_id", F.lit(i)), F.greatest(F.length("text") - SNIPPET, F.lit(1))) for i in range(SNIPPETS)]
    rows = drawn.select("lang", F.array(*[F.substr("text", a.cast("int"), F.lit(SNIPPET)) for a in at]).alias("parts")).collect()
    return sorted((p.encode("utf-8", "replace"), r["lang"]) for r in rows for p in r["parts"])


def language(text: Column, net: Network | None) -> Column:
    """Struct column (lang_pred, score) of whole texts."""

    @F.pandas_udf(T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    def label(texts: pd.Series) -> pd.DataFrame:
        known = [i for i, t in enumerate(texts) if t and net is not None and any(c.isalpha() for c in t)]
        lang, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        if known:
            p = net.read([texts.iloc[i].encode("utf-8", "replace") for i in known])
            best = p.argmax(1)
            lang[known] = np.array(net.langs, object)[best]
            score[known] = np.clip(p[np.arange(len(best)), best], 0, 1)
        return pd.DataFrame({"lang_pred": lang, "score": score})

    return label(F.coalesce(text, F.lit("")))


def language_id(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score. No shuffle of texts."""
    net = train(training_sample(docs))
    return docs.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), language(F.col("text"), net).alias("__p")
    ).select("doc_id", "held_out", "__p.lang_pred", "__p.score")


def in_known_language(docs: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """The documents in which a language is found, columns unchanged: not ``und``,
    and a score of at least ``least_score`` (so a text in two languages stays)."""
    net = train(training_sample(docs))
    found = free_name(docs, "found")
    p = F.col(found)
    return (
        docs.withColumn(found, language(F.col("text"), net))
        .where((p["lang_pred"] != UNKNOWN) & (p["score"] >= least_score))
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )
