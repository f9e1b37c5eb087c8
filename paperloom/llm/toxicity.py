"""Toxicity by a bidirectional gated recurrent network (operator 8), trained in numpy.

A word's input is the sum of a hashed word vector and of hashed vectors of its
character n-grams. Two gated recurrent layers read a window of words in both
directions, attention pools their states, and one unit scores the window. A text
is scored over all its overlapping windows; the worst window counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.batches import END, fresh, normalised, slices, utf8

WINDOW = 32  # words
STRIDE = 16
SIZE = 8  # of inputs and of each direction's state
ATTEND = 4
WORD_BITS = 15
CHAR_BITS = 16
ORDERS = (3, 4, 5)  # character n-grams, with the signs that bound the word
STEP_BYTES = 1 << 20
LANES = 1_024  # windows run at once
EPOCHS = 6  # at least; small samples get as many as STEPS batches take
STEPS = 900
BATCH = 96
RATE = 0.07
DROP = 0.5  # of the word and n-gram vectors, in training
SAMPLE = (2_000, 4_000)  # toxic and other labelled documents that training takes at most
SAMPLE_CHARS = 4_000  # longer documents are not trained on
CLIP = 5.0
SHRINK = 10  # texts of no evidence that each word and n-gram is given
COMMON = 3  # texts that a word or n-gram must occur in to have a vector
POWER = np.uint64(0x9E3779B97F4A7C15)
THRESHOLD = 0.3


# --- words --------------------------------------------------------------------


@dataclass
class Words:
    """Words of a batch: the distinct ones with their hashes, and which one stands where."""

    row: np.ndarray  # text of each word, ascending
    which: np.ndarray  # distinct word of each word
    word: np.ndarray  # hash of each distinct word
    grams: np.ndarray  # buckets of the distinct words' n-grams
    owner: np.ndarray  # distinct word of each n-gram, ascending


def words_of(raw: np.ndarray, off: np.ndarray) -> Words:
    codes, _, row, _ = normalised(raw, off)
    inside = (codes != 32) & (codes != END)
    edge = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
    start, end = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
    if not len(start):
        none = np.zeros(0, np.int64)
        return Words(none, none, none.astype(np.uint64), none, none)
    size = end - start
    power = np.cumprod(np.full(int(size.max()) + 2, POWER, np.uint64))
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    h = np.add.reduceat(codes[inside].astype(np.uint64) * power[at], np.cumsum(size) - size)
    word, first, which = np.unique(h, return_index=True, return_inverse=True)
    grams, owner = [], []
    begin, length = start[first], size[first] + 2  # with a space on both sides
    place = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    who = np.repeat(np.arange(len(word)), length)
    source = np.clip(np.repeat(begin, length) + place - 1, 0, len(codes) - 1)
    last = np.repeat(length, length)
    sign = np.where((place == 0) | (place == last - 1), np.uint64(32), codes[source]).astype(np.uint64)
    for order in ORDERS:
        ok = np.flatnonzero(place + order <= last)
        g = np.full(len(ok), order, np.uint64)
        for k in range(order):
            g = g * POWER + sign[ok + k]
        grams.append(bucket(g, CHAR_BITS).astype(np.int32))
        owner.append(who[ok].astype(np.int32))
    grams, owner = np.concatenate(grams), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return Words(row[start].astype(np.int32), which.reshape(-1).astype(np.int32), word, grams[order], owner[order])


def joined(texts: list[str]) -> Words:
    """The words of many texts, read some texts at a time."""
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    parts, at = [], 0
    for b in slices(batch, "text", STEP_BYTES):
        w = words_of(*utf8(b.column("text")))
        parts.append(Words(w.row + at, w.which, w.word, w.grams, w.owner))
        at += b.num_rows
    if not parts:
        return words_of(*utf8(pa.array([], pa.string())))
    begin = np.cumsum([0, *(len(p.word) for p in parts)])
    word, first, back = np.unique(np.concatenate([p.word for p in parts]), return_index=True, return_inverse=True)
    back = back.reshape(-1).astype(np.int32)
    kept = np.zeros(begin[-1], bool)
    kept[first] = True
    grams, owner = [], []
    for p, lo in zip(parts, begin[:-1].tolist(), strict=True):
        ok = kept[lo + p.owner]
        grams.append(p.grams[ok])
        owner.append(back[lo + p.owner[ok]])
    grams, owner = np.concatenate(grams), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    which = np.concatenate([back[lo + p.which] for p, lo in zip(parts, begin[:-1].tolist(), strict=True)])
    return Words(np.concatenate([p.row for p in parts]), which, word, grams[order], owner[order])


def bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return ((h * POWER) >> np.uint64(64 - bits)).astype(np.int64)


def windows(row: np.ndarray, n: int, size: int = WINDOW, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first, count): overlapping windows of each text; the last ends with the text."""
    length = np.bincount(row, minlength=n)
    begin = np.cumsum(length) - length
    number = np.where(length > 0, 1 + np.maximum(-(-(length - size) // stride), 0), 0)
    text = np.repeat(np.arange(n), number)
    k = np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)
    offset = np.minimum(k * stride, np.maximum(length[text] - size, 0))
    return text, begin[text] + offset, np.minimum(length[text], size)


# --- network ------------------------------------------------------------------


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


Net = dict[str, np.ndarray]


def new_net(seed: int = 7) -> Net:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    net = {"word": draw(1 << WORD_BITS, SIZE, scale=0.02), "char": draw(1 << CHAR_BITS, SIZE, scale=0.02)}
    for way in ("f", "b"):
        net["W" + way] = draw(SIZE, 3 * SIZE, scale=0.4)
        net["U" + way] = draw(SIZE, 3 * SIZE, scale=0.25)
        net["c" + way] = np.zeros(3 * SIZE, np.float32)
    net |= {"A": draw(2 * SIZE, ATTEND, scale=0.3), "a": np.zeros(ATTEND, np.float32), "v": draw(ATTEND, scale=0.5)}
    net |= {"o": draw(2 * SIZE, scale=0.3), "d": np.zeros(1, np.float32)}
    return net


def inputs(net: Net, w: Words, kept_word: np.ndarray | None = None, kept_gram: np.ndarray | None = None) -> np.ndarray:
    """Input vectors of the distinct words; the kept parts are scaled weights in training."""
    x = net["word"][bucket(w.word, WORD_BITS)]
    if kept_word is not None:
        x *= kept_word[:, None]
    if len(w.owner):
        first = np.flatnonzero(np.diff(w.owner, prepend=-1))
        count = np.diff(np.append(first, len(w.owner)))
        chars = net["char"][w.grams]
        if kept_gram is not None:
            chars *= kept_gram[:, None]
        sums = np.add.reduceat(chars, first, axis=0)
        x[w.owner[first]] += sums / np.sqrt(count)[:, None].astype(np.float32)
    return x


def gates(net: Net, way: str, x: np.ndarray) -> np.ndarray:
    """Input part of the gates; one more row, for no word, that keeps the state as it is."""
    p = np.zeros((len(x) + 1, 3 * SIZE), np.float32)
    p[:-1] = x @ net["W" + way] + net["c" + way]
    p[-1, SIZE : 2 * SIZE] = 60.0
    return p


def run_layer(net: Net, way: str, p: np.ndarray, index: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States of one direction, (windows, steps, SIZE)."""
    m, steps = index.shape
    u = net["U" + way]
    out = np.empty((m, steps, SIZE), np.float32)
    h = np.zeros((m, SIZE), np.float32)
    for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
        x, hu = p[index[:, t]], h @ u
        rz = sigmoid(x[:, : 2 * SIZE] + hu[:, : 2 * SIZE])
        r, z = rz[:, :SIZE], rz[:, SIZE:]
        n = np.tanh(x[:, 2 * SIZE :] + r * hu[:, 2 * SIZE :])
        if keep is not None:
            keep.append((t, h, r, z, n, hu[:, 2 * SIZE :]))
        h = n + z * (h - n)
        out[:, t] = h
    return out


def pooled(net: Net, states: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, ...]:
    """(logit, attention, tanh part, pooled state) of windows."""
    k = np.tanh(states @ net["A"] + net["a"])
    e = np.where(real, k @ net["v"], -np.inf)
    e = np.exp(e - e.max(axis=1, keepdims=True))
    alpha = e / e.sum(axis=1, keepdims=True)
    s = np.einsum("mt,mtk->mk", alpha, states)
    return s @ net["o"] + net["d"][0], alpha, k, s


def index_of(which: np.ndarray, first: np.ndarray, count: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray]:
    steps = np.arange(WINDOW)
    real = steps < count[:, None]
    at = np.where(real, first[:, None] + steps, 0)
    return np.where(real, which[at] if len(which) else 0, none), real


def window_logits(net: Net, w: Words, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    out = np.empty(len(first), np.float32)
    x = inputs(net, w)
    pf, pb = gates(net, "f", x), gates(net, "b", x)
    for lo in range(0, len(first), LANES):
        on = slice(lo, lo + LANES)
        index, real = index_of(w.which, first[on], count[on], len(x))
        states = np.concatenate([run_layer(net, "f", pf, index), run_layer(net, "b", pb, index)], axis=2)
        out[on] = pooled(net, states, real)[0]
    return out


def back_layer(net: Net, way: str, index: np.ndarray, kept: list, grad: np.ndarray, g: Net, rows: int) -> np.ndarray:
    """Gradients of one direction through time: into U, and those of the gate inputs by distinct word."""
    u, un = net["U" + way], net["U" + way][:, 2 * SIZE :]
    dh = np.zeros_like(grad[:, 0])
    gates_grad = np.empty((*index.shape, 3 * SIZE), np.float32)
    for t, h, r, z, n, hun in reversed(kept):
        dh = dh + grad[:, t]
        dn = dh * (1 - z) * (1 - n * n)
        dz = dh * (h - n) * z * (1 - z)
        dr = dn * hun * r * (1 - r)
        dx = np.concatenate([dr, dz, dn], axis=1)
        gates_grad[:, t] = dx
        drz = dx[:, : 2 * SIZE]
        g["U" + way][:, : 2 * SIZE] += h.T @ drz
        g["U" + way][:, 2 * SIZE :] += h.T @ (dn * r)
        dh = dh * z + drz @ u[:, : 2 * SIZE].T + (dn * r) @ un.T
    return summed(index.reshape(-1), gates_grad.reshape(-1, 3 * SIZE), rows)


def summed(at: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    """Sum of the values of each row."""
    out = np.zeros((rows, values.shape[1]), np.float32)
    order = np.argsort(at, kind="stable")
    first = np.flatnonzero(np.diff(at[order], prepend=-1))
    if len(first):
        out[at[order][first]] = np.add.reduceat(values[order], first, axis=0)
    return out


def gradients(
    net: Net, w: Words, first: np.ndarray, count: np.ndarray, target: np.ndarray, weight: np.ndarray,
    kept_word: np.ndarray, kept_gram: np.ndarray,
) -> tuple[Net, np.ndarray]:
    """Gradients of the weighted log loss of windows; those of inputs per distinct word."""
    x = inputs(net, w, kept_word, kept_gram)
    index, real = index_of(w.which, first, count, len(x))
    p = {way: gates(net, way, x) for way in "fb"}
    kept: dict[str, list] = {"f": [], "b": []}
    states = np.concatenate([run_layer(net, way, p[way], index, kept[way]) for way in "fb"], axis=2)
    logit, alpha, k, s = pooled(net, states, real)
    d = ((sigmoid(logit) - target) * weight / weight.sum()).astype(np.float32)
    g = {n: np.zeros_like(v) for n, v in net.items() if n not in ("word", "char")}
    g["o"], g["d"] = s.T @ d, np.array([d.sum()], np.float32)
    ds = d[:, None] * net["o"]
    dalpha = np.einsum("mk,mtk->mt", ds, states)
    de = alpha * (dalpha - (alpha * dalpha).sum(1, keepdims=True))
    g["v"] = np.einsum("mt,mtk->k", de, k)
    dk = de[:, :, None] * net["v"] * (1 - k * k)
    g["A"], g["a"] = np.einsum("mtk,mtj->kj", states, dk), dk.sum((0, 1))
    dstates = alpha[:, :, None] * ds[:, None, :] + dk @ net["A"].T
    dx = np.zeros_like(x)
    for i, way in enumerate("fb"):
        gp = back_layer(net, way, index, kept[way], dstates[:, :, i * SIZE : (i + 1) * SIZE], g, len(p[way]))
        g["W" + way], g["c" + way] = x.T @ gp[:-1], gp[:-1].sum(0)
        dx += gp[:-1] @ net["W" + way].T
    return g, dx


@dataclass
class Model:
    net: Net
    prior: float  # score of a text without words


def log_odds(pos: np.ndarray, neg: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(odds, common): shrunk log odds to occur in toxic texts, from numbers of texts.

    Buckets of fewer than COMMON texts say nothing.
    """
    odds = np.log((pos + 0.5) / (label.sum() + 1)) - np.log((neg + 0.5) / ((1 - label).sum() + 1))
    common = pos + neg >= COMMON
    return np.where(common, odds * (pos + neg) / (pos + neg + SHRINK), 0), common


def text_counts(w: Words, label: np.ndarray, texts: int = 200) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """[toxic, other] numbers of texts that hold each word bucket, and each n-gram bucket; some texts at a time."""
    word = [np.zeros(1 << WORD_BITS, np.int64) for _ in range(2)]
    char = [np.zeros(1 << CHAR_BITS, np.int64) for _ in range(2)]
    many = np.bincount(w.owner, minlength=len(w.word))
    start = np.cumsum(many) - many
    for lo in range(0, len(label), texts):
        a, z = np.searchsorted(w.row, (lo, lo + texts))
        own = np.unique((w.row[a:z].astype(np.int64) - lo) * len(w.word) + w.which[a:z])
        text, which = own // max(len(w.word), 1), own % max(len(w.word), 1)
        n = many[which]
        each = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[which], n)
        for out, key, at in ((word, bucket(w.word[which], WORD_BITS), text), (char, w.grams[each].astype(np.int64), np.repeat(text, n))):
            pair = np.unique(at * len(out[0]) + key)
            bad = label[lo + pair // len(out[0])] > 0
            for side, on in zip(out, (bad, ~bad), strict=True):
                side += np.bincount(pair[on] % len(side), minlength=len(side))
    return word, char


def train(texts: list[str], label: np.ndarray, rate: float, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Fit the network on whole labelled texts; ``rate`` is the share of toxic texts it is used on.

    A toxic text is toxic somewhere: of each text the window that scores highest
    is trained on, and of other texts one more at random. One coordinate of the
    vectors begins as the log odds of words and n-grams.
    """
    net = new_net(seed)
    label = np.asarray(label, np.float64)
    prior = float(np.clip(rate, 1e-4, 1 - 1e-4))
    w = joined(texts)
    text, first, count = windows(w.row, len(texts))
    if not len(text) or label.min() == label.max():
        net["d"][:] = np.log(prior / (1 - prior))
        net["o"][:] = 0
        return Model(net, prior)
    word_texts, char_texts = text_counts(w, label)
    by_word, common_word = log_odds(*word_texts, label)
    by_char, common_gram = log_odds(*char_texts, label)
    # Rare words and n-grams would only be learnt by heart: their vectors are zero and stay so.
    for name, odds, common in (("word", by_word, common_word), ("char", by_char, common_gram)):
        net[name][~common] = 0
        net[name][:, 0] += odds / 4
    rng = np.random.default_rng(seed)
    has = np.unique(text)
    weight = np.where(label > 0, 0.5 / label.sum(), 0.5 / (1 - label).sum()) * len(label)
    slow = {n: np.full(v.shape, 1e-3, np.float32) for n, v in net.items()}
    epochs = max(epochs, -(-STEPS * BATCH // (len(has) + int((label[has] == 0).sum()))))
    for epoch in range(epochs):
        if epoch % 2 == 0:  # the worst windows, as the network sees them now
            logit = window_logits(net, w, first, count)
            best = np.lexsort((-logit, text))[np.searchsorted(text, has)]
        spare = np.searchsorted(text, has) + (rng.random(len(has)) * np.bincount(text, minlength=len(texts))[has]).astype(np.int64)
        chosen = np.concatenate([best, spare[label[text[spare]] == 0]])
        chosen = rng.permutation(chosen)
        for lo in range(0, len(chosen), BATCH):
            at = chosen[lo : lo + BATCH]
            part, f, c = part_of(w, first[at], count[at])
            # A word is often seen by its n-grams only, and the other way round.
            kept_word = common_word[bucket(part.word, WORD_BITS)] * keep(rng, len(part.word))
            kept_gram = common_gram[part.grams] * keep(rng, len(part.grams))
            g, dx = gradients(net, part, f, c, label[text[at]], weight[text[at]], kept_word, kept_gram)
            rate_now = RATE * (1 - epoch / (epochs + 1))
            step(net, slow, g, rate_now)
            step_rows(net, slow, "word", bucket(part.word, WORD_BITS), dx * kept_word[:, None], rate_now)
            share = (kept_gram / np.sqrt(np.bincount(part.owner, minlength=len(part.word)).clip(1))[part.owner]).astype(np.float32)
            step_rows(net, slow, "char", part.grams, dx[part.owner] * share[:, None], rate_now)
    # Trained on balanced classes: shift to the share of toxic texts in use.
    net["d"] += np.float32(np.log(prior / (1 - prior)))
    return Model(net, prior)


def keep(rng: np.random.Generator, n: int) -> np.ndarray:
    return (rng.random(n) >= DROP).astype(np.float32) / np.float32(1 - DROP)


def part_of(w: Words, first: np.ndarray, count: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray]:
    """The words of a few windows as a batch of their own."""
    at = np.repeat(first, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    used, which = np.unique(w.which[at], return_inverse=True)
    lo, hi = np.searchsorted(w.owner, used), np.searchsorted(w.owner, used, "right")
    n = hi - lo
    grams = np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    part = Words(np.zeros(len(at), np.int64), which.reshape(-1), w.word[used], w.grams[grams], np.repeat(np.arange(len(used)), n))
    return part, np.cumsum(count) - count, count


def step(net: Net, slow: Net, g: Net, rate: float) -> None:
    norm = np.sqrt(sum(float((v**2).sum()) for v in g.values()))
    for n, v in g.items():
        v = v * min(1.0, CLIP / (norm + 1e-9))
        slow[n] += v * v
        net[n] -= rate * v / np.sqrt(slow[n])


def step_rows(net: Net, slow: Net, name: str, at: np.ndarray, grad: np.ndarray, rate: float) -> None:
    rows, back = np.unique(at, return_inverse=True)
    g = summed(back.reshape(-1), grad, len(rows))
    slow[name][rows] += g * g
    net[name][rows] -= rate * g / np.sqrt(slow[name][rows])


def scores(raw: np.ndarray, off: np.ndarray, m: Model) -> np.ndarray:
    """Score of each text: its worst window; the prior for a text without words."""
    n = len(off) - 1
    w = words_of(raw, off)
    text, first, count = windows(w.row, n)
    out = np.full(n, m.prior)
    if len(text):
        p = 1 / (1 + np.exp(-window_logits(m.net, w, first, count).astype(np.float64)))
        begin = np.flatnonzero(np.diff(text, prepend=-1))
        out[text[begin]] = np.maximum.reduceat(p, begin)
    return out


# --- jobs ---------------------------------------------------------------------


def fit(docs: DataFrame, labels: DataFrame, learn: Column, sample: tuple[int, int] = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Train on a bounded sample of labelled documents.

    ``learn`` selects label rows by doc_id. At most ``sample`` toxic and other
    documents, those whose ids hash least, of at most ``sample_chars`` characters
    each reach the driver. An id labelled more than once is toxic if one label says so;
    null ids, labels and texts teach nothing.
    """
    ok = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & learn)
    each = ok.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rate = each.agg(F.avg((F.col("toxic") > 0).cast("double"))).first()[0]
    least = [F.xxhash64("doc_id"), F.col("doc_id")]
    bad = each.filter("toxic > 0").orderBy(*least).limit(sample[0])
    good = each.filter("toxic <= 0").orderBy(*least).limit(sample[1])
    # The sample's size is fixed by its two limits, so it may be broadcast.
    chosen = F.broadcast(bad.unionByName(good))
    rows = docs.select("doc_id", "text").filter(F.col("text").isNotNull() & (F.length("text") <= sample_chars)).join(chosen, "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    got = sorted((r["doc_id"], r["text"], r["toxic"]) for r in rows.collect())
    return train([t for _, t, _ in got], np.array([int(y > 0) for *_, y in got]), rate if rate is not None else 0.0)


def scored(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """All columns of ``docs`` and ``out`` (0 to 1), over all windows of the whole text.

    Null and empty texts, and texts without letters or digits, get the share of
    toxic labels as their score. Repeated rows stay repeated; a column named as
    ``out`` is replaced.
    """
    keep = [c for c in docs.columns if c != out]
    at = f"k{keep.index(text)}"
    inner = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, at, STEP_BYTES):
                score = scores(*utf8(b.column(at)), shared.value)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score)], names=[*b.schema.names, "score"])

    fields = ", ".join(f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    got = inner.mapInArrow(run, f"{fields}, score double")
    return got.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("score").alias(out))


def without_toxic(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, unchanged. Texts without words stay."""
    name = fresh(docs, "_score")
    got = scored(docs, model, text, name)
    wordless = ~F.coalesce(F.col(text), F.lit("")).rlike(r"[\p{L}\p{N}]")
    return got.filter((F.col(name) < threshold) | wordless).select(*[F.col(f"`{c}`") for c in docs.columns])
