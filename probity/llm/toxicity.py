"""Toxicity by a bidirectional gated recurrent network with attention pooling.

Input. A word is its hashed embedding beside the mean of its hashed character
3- to 5-gram embeddings, A-Z lower-cased, marks at its end left off. Two gated
recurrent layers read a window of 32 words forwards and backwards; attention over
their joint states gives one vector and a logit. A document is the highest logit
of its windows, which begin every 24 words and at its last 32, so all of it is
read; a shorter text is repeated to fill one window. A logistic line fitted on
documents turns logits into scores.

Training, in numpy on the driver: at most `max_toxic` and `max_clean` labelled
documents (the smallest hashes of doc_id), with all their windows. Labels are of
documents, so windows are chosen: first by the log odds of the rarest features, then by the network itself, which is trained
anew on toxic documents' likeliest windows and on clean ones' likeliest and
random windows. Classes are weighed by all labels' counts, not by the sample's.

Edge cases. Null, empty and blank texts get the share of toxic labels; drop_toxic
keeps them. Labels
that are null, of null doc_ids or of no document teach nothing; of several labels
for one document the largest counts. Without toxic or clean labels all scores are
the share (0 without labels). Null doc_id: held out. Repeated rows are scored
alike. Empty table: no rows. Of other columns none is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probity.llm import encoding

WINDOW, STRIDE = 32, 24
WORD_ROWS, GRAM_ROWS, DIM, HIDDEN, ATTEND = 1 << 14, 1 << 15, 8, 8, 8
CACHE_WORDS = 60_000
LEAST_DOCS = 4  # of the sample, to learn a feature
_MIX = np.uint64(0x9E3779B97F4A7C15)


def starts(n: int) -> range | list[int]:
    """First words of a document's windows."""
    return [*range(0, n - WINDOW, STRIDE), n - WINDOW] if n > WINDOW else [0] * (n > 0)


def windows_of(texts: list[bytes | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Different words, [window, place] of them, and each window's text."""
    vocabulary: dict[bytes, int] = {}
    flat, first, doc, n = [], [], [], 0
    for i, text in enumerate(texts):
        words = words_of(text)
        if 0 < len(words) < WINDOW:
            words = (words * WINDOW)[:WINDOW]
        flat.append(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words], np.int32))
        first += [n + s for s in starts(len(words))]
        doc += [i] * (len(first) - len(doc))
        n += len(words)
    index = np.concatenate([*flat, np.zeros(0, np.int32)])[np.array(first, np.int64)[:, None] + np.arange(WINDOW)]
    return list(vocabulary), index, np.array(doc, np.int64)


def words_of(text: bytes | None) -> list[bytes]:
    return [w.rstrip(b".,;:!?") or w for w in (text or b"").lower().split()]


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word's row of the word table; all words' n-gram rows, and where each word's begin."""
    data = np.frombuffer(b"".join(b"^" + w + b"$" for w in words), np.uint8).astype(np.uint64)
    size = np.array([len(w) + 2 for w in words], np.int64)
    begin = np.cumsum(size) - size
    left = np.repeat(begin + size, size) - np.arange(len(data))  # bytes to the word's end
    grams, owner = [], []
    which = np.repeat(np.arange(len(words)), size)
    code = np.zeros(len(data), np.uint64)
    total = np.zeros(len(data), np.uint64)
    for n in range(1, 6):
        shifted = np.zeros(len(data), np.uint64)
        shifted[: max(0, len(data) - n + 1)] = data[n - 1 :]  # a single short word has fewer bytes than n
        code = (code + shifted + np.uint64(n)) * _MIX
        code ^= code >> np.uint64(29)
        if n >= 3:
            ok = left >= n
            grams.append(code[ok] >> np.uint64(40))
            owner.append(which[ok])
    total = (data + np.uint64(7)) * _MIX ** (np.arange(len(data)).astype(np.uint64) - np.repeat(begin, size).astype(np.uint64) + np.uint64(1))
    word = (np.add.reduceat(total, begin) * _MIX >> np.uint64(45)).astype(np.int64) % WORD_ROWS
    grams, owner = np.concatenate(grams).astype(np.int64) % GRAM_ROWS, np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return word, grams[order], np.searchsorted(owner[order], np.arange(len(words)))


@dataclass(frozen=True)
class Net:
    """Parameters. Gates of a layer lie side by side: update, reset, candidate."""

    p: dict[str, np.ndarray]
    slope: float = 1.0
    shift: float = 0.0
    share: float = 0.0

    @staticmethod
    def new(seed: int) -> Net:
        r = np.random.default_rng(seed)
        n = lambda *shape: r.normal(0, 1 / np.sqrt(shape[0]), shape)
        p = {"word": r.normal(0, 0.1, (WORD_ROWS, DIM)), "gram": r.normal(0, 0.1, (GRAM_ROWS, DIM))}
        for d in "fb":
            p |= {f"w{d}": n(2 * DIM, 3 * HIDDEN), f"u{d}": n(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN)}
        p |= {"att": n(2 * HIDDEN, ATTEND), "ask": n(ATTEND), "out": n(2 * HIDDEN), "bias": np.zeros(1)}
        return Net({k: v.astype(np.float32) for k, v in p.items()})

    def inputs(self, words: list[bytes]) -> tuple[np.ndarray, tuple]:
        word, grams, at = features(words)
        count = np.diff(np.append(at, len(grams)))
        chars = np.add.reduceat(self.p["gram"][grams], at, axis=0) / count[:, None].astype(np.float32)
        return np.concatenate([self.p["word"][word], chars], axis=1), (word, grams, count)


def _gates(g: np.ndarray, h: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Update, reset, candidate, and the candidate's part of h @ u."""
    s = h @ u
    zr = 0.5 + 0.5 * np.tanh(0.5 * (g[:, : 2 * HIDDEN] + s[:, : 2 * HIDDEN]))
    z, r, part = zr[:, :HIDDEN], zr[:, HIDDEN:], s[:, 2 * HIDDEN :]
    return z, r, np.tanh(g[:, 2 * HIDDEN :] + r * part), part


def _states(table: np.ndarray, index: np.ndarray, u: np.ndarray, back: bool, keep: list | None = None) -> np.ndarray:
    """[step, window, unit] states of one layer; keep gets what the gradient needs."""
    h = np.zeros((len(index), HIDDEN), np.float32)
    out = np.empty((index.shape[1], *h.shape), np.float32)
    for t in range(index.shape[1])[:: -1 if back else 1]:
        z, r, n, part = _gates(table[index[:, t]], h, u)
        if keep is not None:
            keep.append((t, h, z, r, n, part))
        h = n + z * (h - n)
        out[t] = h
    return out


def _pool(net: Net, states: np.ndarray) -> tuple[np.ndarray, ...]:
    e = np.tanh(states @ net.p["att"])
    a = np.exp(e @ net.p["ask"])
    a /= a.sum(0)
    pooled = (a[:, :, None] * states).sum(0)
    return pooled @ net.p["out"] + net.p["bias"], e, a, pooled


def logits(net: Net, tables: tuple[np.ndarray, np.ndarray], index: np.ndarray) -> np.ndarray:
    """Of windows, given the layers' input tables (a row for each word)."""
    out = []
    for at in range(0, len(index), 2048):
        part = index[at : at + 2048]
        both = [_states(t, part, net.p[f"u{d}"], d == "b") for d, t in zip("fb", tables, strict=True)]
        out.append(_pool(net, np.concatenate(both, axis=2))[0])
    return np.concatenate(out) if out else np.zeros(0, np.float32)


def tables_of(net: Net, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    x = np.concatenate([net.inputs(words[at : at + 20_000])[0] for at in range(0, len(words), 20_000)])
    return x @ net.p["wf"] + net.p["cf"], x @ net.p["wb"] + net.p["cb"]


def gradients(net: Net, words: list[bytes], index: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Of the weighted log loss of windows, back through time."""
    x, (word, grams, count) = net.inputs(words)
    p, b = net.p, len(index)
    grad = {k: np.zeros_like(v) for k, v in p.items()}
    kept: dict[str, list] = {"f": [], "b": []}
    states = np.concatenate([_states(x @ p[f"w{d}"] + p[f"c{d}"], index, p[f"u{d}"], d == "b", kept[d]) for d in "fb"], axis=2)
    logit, e, a, pooled = _pool(net, states)
    d_logit = ((1 / (1 + np.exp(-logit)) - y) * weight / weight.sum()).astype(np.float32)
    grad["out"], grad["bias"] = pooled.T @ d_logit, d_logit.sum(keepdims=True)
    d_pooled = d_logit[:, None] * p["out"]
    d_a = (states * d_pooled).sum(2)
    d_score = a * (d_a - (a * d_a).sum(0))
    grad["ask"] = (e * d_score[:, :, None]).sum((0, 1))
    d_e = d_score[:, :, None] * p["ask"] * (1 - e * e)
    grad["att"] = np.einsum("tbi,tbj->ij", states, d_e)
    d_states = a[:, :, None] * d_pooled + d_e @ p["att"].T
    d_x = np.zeros_like(x)
    for k, d in enumerate("fb"):
        d_table = np.zeros((len(x), 3 * HIDDEN), np.float32)
        d_h = np.zeros((b, HIDDEN), np.float32)
        for t, h, z, r, n, part in reversed(kept[d]):
            d_h = d_h + d_states[t, :, k * HIDDEN : (k + 1) * HIDDEN]
            d_n = d_h * (1 - z) * (1 - n * n)
            d_z, d_r = d_h * (h - n) * z * (1 - z), d_n * part * r * (1 - r)
            d_s = np.concatenate([d_z, d_r, d_n * r], axis=1)
            grad[f"u{d}"] += h.T @ d_s
            np.add.at(d_table, index[:, t], np.concatenate([d_z, d_r, d_n], axis=1))
            d_h = d_h * z + d_s @ p[f"u{d}"].T
        grad[f"w{d}"], grad[f"c{d}"] = x.T @ d_table, d_table.sum(0)
        d_x += d_table @ p[f"w{d}"].T
    np.add.at(grad["word"], word, d_x[:, :DIM])
    np.add.at(grad["gram"], grams, np.repeat(d_x[:, DIM:] / count[:, None].astype(np.float32), count, axis=0))
    return grad


def _log_odds(words: list[bytes], index: np.ndarray, doc: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A first score for windows: the largest log odds of a word's features. And
    which rows of the two tables enough documents hold."""
    held = [np.zeros((2, size)) for size in (WORD_ROWS, GRAM_ROWS)]  # clean and toxic documents with the feature
    bounds = np.searchsorted(doc, np.arange(len(toxic) + 1))
    for i, y in enumerate(toxic):
        own = np.unique(index[bounds[i] : bounds[i + 1]])
        if len(own):
            word, grams, _ = features([words[w] for w in own])
            held[0][int(y), np.unique(word)] += 1
            held[1][int(y), np.unique(grams)] += 1
    odds = [np.log((n[1] + 0.2) / (toxic.sum() + 1)) - np.log((n[0] + 0.2) / ((~toxic).sum() + 1)) for n in held]
    best = np.empty(len(words))
    for at in range(0, len(words), 20_000):
        word, grams, first = features(words[at : at + 20_000])
        best[at : at + 20_000] = odds[0][word] + np.maximum.reduceat(odds[1][grams], first)
    return best[index].max(1), held[0].sum(0) >= LEAST_DOCS, held[1].sum(0) >= LEAST_DOCS


def train(words: list[bytes], index: np.ndarray, doc: np.ndarray, toxic: np.ndarray, share: float, rounds: int = 4, steps: int = 60, batch: int = 384, rate: float = 0.02, seed: int = 42) -> Net:
    """From windows, index [window, place] of words, in the order of their documents doc, which toxic labels."""
    r = np.random.default_rng(seed)
    net = replace(Net.new(seed), share=share)
    if not len(index) or not toxic.any() or toxic.all():
        return replace(net, slope=0.0, shift=float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    weight = np.where(toxic, share / toxic.sum(), (1 - share) / (~toxic).sum())
    scores, words_kept, grams_kept = _log_odds(words, index, doc, toxic)
    net.p["word"][~words_kept] = 0  # else the words of a single document stand for its label
    net.p["gram"][~grams_kept] = 0
    m, v = ({k: np.zeros_like(x) for k, x in net.p.items()} for _ in range(2))
    bounds = np.searchsorted(doc, np.arange(len(toxic) + 1))
    full = np.flatnonzero(np.diff(bounds))
    step = 0
    for _ in range(rounds):
        best = np.array([bounds[i] + scores[bounds[i] : bounds[i + 1]].argmax() for i in full])
        yes, hard = best[toxic[full]], best[~toxic[full]]
        every = np.flatnonzero(~toxic[doc])
        for _ in range(steps):
            rows = np.concatenate([r.choice(yes, batch // 3), r.choice(hard, batch // 3), r.choice(every, batch // 3)])
            own, local = np.unique(index[rows], return_inverse=True)
            y = toxic[doc[rows]].astype(np.float32)
            grad = gradients(net, [words[i] for i in own], local.reshape(len(rows), WINDOW), y, np.ones(len(rows), np.float32))
            grad["word"][~words_kept] = 0
            grad["gram"][~grams_kept] = 0
            step += 1
            for k, g in grad.items():
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                net.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        scores = logits(net, tables_of(net, words), index)
    top = np.array([scores[bounds[i] : bounds[i + 1]].max() for i in full], np.float64)
    y, w = toxic[full].astype(np.float64), weight[full] / weight[full].sum()
    slope, shift = 1.0, 0.0
    for _ in range(200):  # the line from highest logits to document scores, by damped Newton steps
        q = 1 / (1 + np.exp(-np.clip(slope * top + shift, -30, 30)))
        g, h = w * (q - y), w * q * (1 - q) + 1e-6 * w
        a = np.array([[(h * top * top).sum() + 1e-3, (h * top).sum()], [(h * top).sum(), h.sum() + 1e-6]])
        move = np.linalg.solve(a, [(g * top).sum() + 1e-3 * slope, g.sum()])
        slope, shift = slope - 0.5 * move[0], shift - 0.5 * move[1]
    return replace(net, slope=float(slope), shift=float(shift))


class Scorer(dict):
    """Word -> row of the layers' input tables, kept by a task."""

    def __init__(self, net: Net) -> None:
        super().__init__()
        self.net, self.new = net, []
        self.rows = [np.empty((2 * CACHE_WORDS, 3 * HIDDEN), np.float32) for _ in "fb"]

    def __missing__(self, word: bytes) -> int:
        row = self[word] = len(self)
        self.new.append(word)
        return row

    def _table(self) -> tuple[np.ndarray, np.ndarray]:
        if self.new:
            lo, hi = len(self) - len(self.new), len(self)
            if hi > len(self.rows[0]):
                self.rows = [np.concatenate([t, np.empty((hi, t.shape[1]), np.float32)]) for t in self.rows]
            for t, part in zip(self.rows, tables_of(self.net, self.new), strict=True):
                t[lo:hi] = part
            self.new = []
        return self.rows[0], self.rows[1]

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        if len(self) > CACHE_WORDS:
            self.clear()
        flat: list[bytes] = []
        first, owner, n = [], [], 0
        for i, text in enumerate(texts):
            own = words_of(text)
            if 0 < len(own) < WINDOW:
                own = (own * WINDOW)[:WINDOW]
            begin = starts(len(own))
            first += [n + s for s in begin]
            owner += [i] * len(begin)
            flat += own
            n += len(own)
        out = np.full(len(texts), self.net.share)
        if flat:
            rows = np.fromiter(map(self.__getitem__, flat), np.int64, n)
            index = rows[np.array(first)[:, None] + np.arange(WINDOW)]
            own = logits(self.net, self._table(), index).astype(np.float64)
            top = np.full(len(texts), -np.inf)
            np.maximum.at(top, owner, own)
            seen = np.isfinite(top)
            out[seen] = 1 / (1 + np.exp(-np.clip(self.net.slope * top[seen] + self.net.shift, -500, 500)))
        return out


def fold(doc_id: Column) -> Column:
    """crc32 of doc_id as text, modulo 5."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, max_toxic: int = 1500, max_clean: int = 3000, seed: int = 42) -> Net:
    """A network from labels (doc_id, toxic) of docs (doc_id, text); learn is a
    condition on doc_id that rows to learn from must meet."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    known = known.where(learn) if learn is not None else known
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    pick = lambda y, n: known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(n)
    chosen = pick(1, max_toxic).union(pick(0, max_clean))  # a bounded number of rows
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id")
    got = rows.orderBy("doc_id", F.xxhash64("text")).select("text", "toxic").toArrow()
    toxic = np.array(got["toxic"].to_pylist(), bool)
    return train(*windows_of(got["text"].to_pylist()), toxic, share, seed=seed)


def score(docs: DataFrame, net: Net) -> DataFrame:
    """Per row of docs: doc_id, node (hash of doc_id and text), score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(net)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                scores = scorer.score(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("node"), pa.array(scores)], names=["doc_id", "node", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.select("doc_id", F.xxhash64("doc_id", "text").alias("node"), "text").mapInArrow(run, "doc_id long, node long, score double")


def drop_toxic(docs: DataFrame, net: Net, threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose score is below threshold, and those without words. Same columns."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding.forget()
        scorer = Scorer(net)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                text = part.column(names.index("text")).cast(pa.binary()).to_pylist()
                keep = [not words_of(t) for t in text] | (scorer.score(text) < threshold)
                yield part.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
