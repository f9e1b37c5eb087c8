"""Language identification by error-correcting output codes (operator 5).

Each language has a codeword. One binary classifier per code bit scores character
n-grams; a text gets the language whose codeword loses least, every bit weighted
by how well its classifier separates the training counts. Two codewords with
nearly the same loss make the text ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.batches import END, normalised, slices, utf8

ORDERS = (1, 2, 3)
BUCKETS = 1 << 14  # hashed n-grams of one order
SMOOTH = 0.5
AMBIGUOUS = 0.1  # share of the better loss that the runner-up must be worse by
STEP_BYTES = 1 << 20
MULTIPLIER = np.uint32(2654435769)  # 2^32 over the golden ratio


def buckets(codes: np.ndarray, order: int) -> np.ndarray:
    """Bucket of the n-gram at each place; BUCKETS where it would leave its text."""
    n = len(codes)
    h = np.zeros(n, np.uint32)
    whole = np.ones(n, bool)
    for k in range(order):
        part = np.full(n, END, np.uint32)
        part[: n - k] = codes[k:]
        h = h * MULTIPLIER + part
        whole &= part != END
    h = ((h * MULTIPLIER) >> np.uint32(18)).astype(np.int32)  # the top 14 bits
    h[~whole] = BUCKETS
    return h


def codewords(n: int, seed: int = 1) -> np.ndarray:
    """n rows of +1 and -1. Up to 5 languages: every split once; beyond: random rows far apart."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        splits = [[1, *(1 if s >> i & 1 else -1 for i in range(n - 1))] for s in range(2 ** (n - 1) - 1)]
        return np.array(splits, float).T
    rng = np.random.default_rng(seed)
    bits = int(np.ceil(10 * np.log2(n)))
    best, far = None, -1
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], (n, bits))
        code = code[:, np.abs(code.sum(0)) < n]  # a bit must split the languages
        least = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
        if least > far:
            best, far = code, least
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: list[np.ndarray]  # per order: (BUCKETS + 1) x bits, the last row 0
    bit_weight: np.ndarray


def ngram_counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, counts): n-gram bucket counts of all texts of a language.

    One row per language and task leaves the tasks, however long the texts are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for whole in batches:
            for b in slices(whole, "text", STEP_BYTES):
                codes, _, row, _ = normalised(*utf8(b.column("text")), letters_only=True)
                names = b.column("lang").dictionary_encode()
                own = names.indices.to_numpy()[row]
                for i, name in enumerate(names.dictionary.to_pylist()):
                    part = codes[own == i]
                    got = [np.bincount(buckets(part, o), minlength=BUCKETS + 1)[:BUCKETS] for o in ORDERS]
                    sums[name] = sums.get(name, 0) + np.concatenate(got)
        if sums:
            rows = [v.astype(np.int64) for v in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array(rows, pa.list_(pa.int64()))], names=["lang", "part"])

    def add(batches: pa.Table) -> pa.Table:
        total = sum(np.array(x.values) for x in batches.column("part"))
        return pa.table({"lang": [batches.column("lang")[0].as_py()], "counts": pa.array([total], pa.list_(pa.int64()))})

    parts = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).mapInArrow(run, "lang string, part array<long>")
    return parts.groupBy("lang").applyInArrow(add, "lang string, counts array<long>")


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Binary classifiers from the n-gram counts of all labelled texts.

    A bit's classifier weighs an n-gram by the log ratio of its shares on the two
    sides of the bit. The driver receives one count vector per language. Rows
    with a null language or text take no part.
    """
    usable = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    got = sorted((r["lang"], np.array(r["counts"], float)) for r in ngram_counts(usable, text, lang).collect())
    names = [n for n, c in got if c.sum() > 0]
    share = []
    for _, c in got:
        if c.sum() > 0:  # every language weighs the same, whatever its size
            by_order = c.reshape(len(ORDERS), BUCKETS)
            share.append((by_order + SMOOTH) / (by_order + SMOOTH).sum(1, keepdims=True))
    code = codewords(len(names))
    weights, apart = [], np.zeros(code.shape[1])
    for o in range(len(ORDERS)):
        w = np.zeros((BUCKETS + 1, code.shape[1]), np.float32)
        for b in range(code.shape[1]):
            if (code[:, b] > 0).all() or not names:
                continue
            sides = [np.mean([s[o] for s, bit in zip(share, code[:, b], strict=True) if bit == side], axis=0) for side in (1, -1)]
            w[:BUCKETS, b] = np.log(sides[0] / sides[1])
            # The least margin of a language from the bit's boundary.
            apart[b] += min(abs(float(s[o] @ w[:BUCKETS, b])) for s in share)
        weights.append(w)
    return Model(names, code, weights, apart / apart.sum() if apart.sum() else np.ones_like(apart))


def scores(raw: np.ndarray, off: np.ndarray, m: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, score, ambiguous) of back-to-back texts."""
    n = len(off) - 1
    codes, _, row, first = normalised(raw, off, letters_only=True)
    letters = np.bincount(row[(codes != END) & (codes != 32)], minlength=n)
    margin = np.zeros((n, m.code.shape[1]))
    for o, w in zip(ORDERS, m.weights, strict=True):
        h = buckets(codes, o)
        sums = np.add.reduceat(w[h], first, axis=0) if n else np.zeros((0, w.shape[1]))
        count = np.bincount(row[h < BUCKETS], minlength=n)
        margin += sums / np.maximum(count, 1)[:, None]
    if not m.languages:
        return ["und"] * n, np.zeros(n), np.zeros(n, bool)
    # Exponential loss of each bit against each codeword.
    loss = np.exp(-np.clip(margin[:, None, :] * m.code[None], -30, 30)) @ m.bit_weight
    order = np.argsort(loss, axis=1, kind="stable")
    best = order[:, 0]
    least = loss[np.arange(n), best]
    share = (1 / loss) ** 2
    score = share[np.arange(n), best] / share.sum(1)
    close = np.zeros(n, bool)
    if len(m.languages) > 1:
        close = loss[np.arange(n), order[:, 1]] < least * (1 + AMBIGUOUS)
    none = letters == 0
    names = ["und" if none[i] else m.languages[b] for i, b in enumerate(best.tolist())]
    return names, np.where(none, 0.0, score), close | none


def identified(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns but the text, and lang_pred, score (0 to 1), ambiguous.

    Null texts and texts without letters are ``und`` with score 0, ambiguous.
    Without any labelled language every text is. Repeated rows stay repeated.
    """
    keep = [c for c in docs.columns if c not in (text, "lang_pred", "score", "ambiguous")]
    inner = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [*(f"k{i}" for i in range(len(keep))), "lang_pred", "score", "ambiguous"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", STEP_BYTES):
                lang, score, close = scores(*utf8(b.column("text")), shared.value)
                yield pa.RecordBatch.from_arrays(
                    [*b.columns[:-1], pa.array(lang, pa.string()), pa.array(score), pa.array(close)], names=names
                )

    fields = [f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)]
    out = inner.mapInArrow(run, ", ".join([*fields, "lang_pred string, score double, ambiguous boolean"]))
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score", "ambiguous")


def held_out(bucket: Column, which: int) -> Column:
    """Whether a row's bucket is the held-out one; a null id is not, and teaches nothing either."""
    return F.coalesce(bucket == which, F.lit(False))
