"""Language identification by nearest centroids of normalised TF-IDF n-gram vectors.

Vectors count hashed byte trigrams of the lower-cased letters of whole texts,
damped, weighted by inverse document frequency and normalised. Each language has
several centroids, clustered by cosine. A text takes the language of the centroid
with the highest cosine; one that is too far from it is marked as rejected. How
far is too far depends on its length, since cosines grow with it.
The model is fitted on a bounded sample of labelled rows (``per_language``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, steps, text_bytes

UNKNOWN = "und"
SIZE = 4096
#: Texts in a vectorised step at most.
STEP_TEXTS = 1024
#: ASCII letters in lower case, other ASCII as blanks, further bytes as they are.
FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256)], np.uint8)


def counts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of trigram counts for each value."""
    n = len(at) - 1
    out = np.zeros((n, SIZE), np.float32)
    if len(data) < 3:
        return out
    c = FOLD[data].astype(np.uint32)
    gram = (c[:-2] << np.uint32(16)) | (c[1:-1] << np.uint32(8)) | c[2:]
    place = ((gram * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)
    size = np.diff(at)
    row = np.repeat(np.arange(n), size)[: len(gram)]
    good = np.ones(len(gram), bool)
    last = at[1:][size > 0]
    for back in (1, 2):  # trigrams stay within their value
        where = last - back
        good[where[(where >= 0) & (where < len(gram))]] = False
    good &= ~((c[:-2] == 32) & (c[1:-1] == 32))
    out += np.bincount(row[good] * SIZE + place[good], minlength=n * SIZE).reshape(n, SIZE)
    return out


#: Classes of length: powers of two of different trigrams, so that one word many times is short.
LENGTHS = SIZE.bit_length()
#: Texts that a median, or a language's own bound, needs.
ENOUGH = 20


def length_class(tf: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum((tf > 0).sum(axis=1), 1)).astype(np.int64)


def usual_cosines(length: np.ndarray, cosine: np.ndarray) -> np.ndarray:
    """The median cosine of each class of length.

    Classes with few texts count with the longer ones. Below the shortest, cosines
    shrink with the root of the length; above the longest they stay.
    """
    at, median, begin = [], [], 0
    kinds = np.unique(length)
    for j, k in enumerate(kinds):
        own = (length >= kinds[begin]) & (length <= k)
        if own.sum() >= ENOUGH or (j == len(kinds) - 1 and not at):
            at.append(float(length[own].mean()))
            median.append(float(np.median(cosine[own])))
            begin = j + 1
    every = np.arange(LENGTHS)
    out = np.interp(every, at, np.maximum.accumulate(median))
    return out * np.minimum(1, 2.0 ** ((every - at[0]) / 2))


@dataclass
class Model:
    """``weights``: inverse document frequencies; a row of ``centroids`` for each entry of ``language``.

    ``least``: the share of the usual cosine of a text's length that a centroid accepts at least.
    """

    languages: list[str]
    weights: np.ndarray
    centroids: np.ndarray
    language: np.ndarray
    least: np.ndarray
    usual: np.ndarray

    def vectors(self, tf: np.ndarray) -> np.ndarray:
        v = np.log1p(tf) * self.weights
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)

    def nearest(self, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid and its cosine; the first centroid with 0 for empty vectors."""
        cosine = np.clip(self.vectors(tf) @ self.centroids.T, 0, 1)
        best = cosine.argmax(axis=1)
        return best, cosine[np.arange(len(best)), best]

    def far(self, tf: np.ndarray, best: np.ndarray, cosine: np.ndarray) -> np.ndarray:
        """Whether a text is too far from its nearest centroid to be of its language."""
        return cosine < self.least[best] * self.usual[length_class(tf)]


def clustered(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Up to ``k`` unit centroids of unit vectors, from the most central one and then the farthest ones."""
    mean = v.mean(axis=0)
    chosen = [int((v @ mean).argmax())]
    while len(chosen) < min(k, len(v)):
        chosen.append(int((v @ v[chosen].T).max(axis=1).argmin()))
    centroids = v[chosen]
    for _ in range(rounds):
        own = (v @ centroids.T).argmax(axis=1)
        groups = [v[own == j].mean(axis=0) for j in range(len(centroids)) if (own == j).any()]
        centroids = np.array([g / max(np.linalg.norm(g), 1e-12) for g in groups], np.float32)
    return centroids


def fit(labelled: DataFrame, clusters: int = 4, per_language: int = 400, tolerance: float = 0.4) -> Model | None:
    """Fit on up to ``per_language`` rows of each language, those with the smallest hashes of id and text; None without labelled rows.

    That bounds the sample, which comes to the driver, by the number of languages;
    every distinct label counts as one, so labels must be a vocabulary of fixed size.
    Cosines of held-out texts, each half of the sample against centroids of the other,
    are divided by the usual ones of their length. Such shares are accepted down to
    ``tolerance`` times the lowest hundredth of all, and languages with few rows down to
    ``tolerance`` times their own least one.
    """
    rows = labelled.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    rows = rows.withColumn("hash", F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("sample")), 32))
    seen = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("hash").alias("least")).collect()
    known = {r["lang"]: r["n"] for r in seen}
    if not known:
        return None
    # Of 2^32 hashes as many as leave some more rows than wanted, one at least; then the smallest ones.
    share = {r["lang"]: max(r["least"], int((per_language + 8 * per_language**0.5) / r["n"] * (1 << 32))) for r in seen}
    drawn = rows.where(F.col("hash") <= F.create_map(*[F.lit(x) for kv in share.items() for x in kv])[F.col("lang")])
    drawn = drawn.withColumn("hash", F.xxhash64("hash", "text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("hash"))
    chosen = drawn.withColumn("place", place).where(F.col("place") <= per_language)

    def features(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            raw, at = text_bytes(part.column(0))
            lang = part.column(1)
            for i, j in steps(at):
                for a in range(i, j, STEP_TEXTS):
                    b = min(a + STEP_TEXTS, j)
                    tf = counts(raw[at[a] : at[b]], at[a : b + 1] - at[a])
                    some = [np.flatnonzero(x) for x in tf]
                    sparse = [[p.astype(np.uint16).tobytes() for p in some], [x[p].tobytes() for x, p in zip(tf, some, strict=True)]]
                    yield from batches([(lang.slice(a, b - a), *(pa.array(x, pa.binary()) for x in sparse))], ["lang", "place", "n"])

    # Six bytes for each different trigram of a row of the sample: some kilobytes, 24 at most.
    got = chosen.select("text", "lang").mapInArrow(features, "lang string, place binary, n binary").collect()
    if not got:
        return None
    by_language: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    texts_with = np.zeros(SIZE, np.int64)
    for r in got:
        place = np.frombuffer(r["place"], np.uint16)
        texts_with[place] += 1
        by_language.setdefault(r["lang"], []).append((place, np.frombuffer(r["n"], np.float32)))
    model = Model(sorted(by_language, key=lambda x: (-known[x], x)), np.log((1 + len(got)) / (1 + texts_with)).astype(np.float32) + 1, *[np.zeros(0)] * 4)
    centroids, language, held = [], [], []
    for k, name in enumerate(model.languages):
        tf = np.zeros((len(by_language[name]), SIZE), np.float32)  # one language at a time
        for row, (place, n) in zip(tf, by_language.pop(name), strict=True):
            row[place] = n
        v, length = model.vectors(tf), length_class(tf)
        place = np.flatnonzero(np.linalg.norm(v, axis=1) > 0)
        own = v[place]
        halves = [own[::2], own[1::2]]
        if len(own) > 1:
            for h in (0, 1):
                held.append((k, length[place[h::2]], (halves[h] @ clustered(halves[1 - h], clusters).T).max(axis=1)))
        if not len(own):
            own = np.zeros((1, SIZE), np.float32)
        c = clustered(own, clusters)
        centroids.append(c)
        language += [k] * len(c)
    model.centroids, model.language = np.concatenate(centroids), np.array(language)
    least, model.usual = np.zeros(len(model.languages)), np.ones(LENGTHS)
    if held:
        of, length, cosine = np.concatenate([np.full(len(x), k) for k, x, _ in held]), *(np.concatenate([h[i] for h in held]) for i in (1, 2))
        model.usual = usual_cosines(length, cosine)
        share = cosine / np.maximum(model.usual[length], 1e-9)
        least[:] = tolerance * float(np.quantile(share, 0.01))
        for k in np.unique(of):
            if (of == k).sum() < ENOUGH:
                least[k] = min(least[k], tolerance * float(share[of == k].min()))
    model.least = least[model.language]
    return model


def _predict(model: Model | None):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            raw, at = text_bytes(part.column(0))
            texts = part.column(0)
            for i, j in steps(at):
                for a in range(i, j, STEP_TEXTS):
                    b = min(a + STEP_TEXTS, j)
                    data, near = raw[at[a] : at[b]], at[a : b + 1] - at[a]
                    plain = np.concatenate([[0], np.cumsum((FOLD[data] > 96) & (data < 128))])
                    letters = plain[near[1:]] > plain[near[:-1]]
                    for k in np.flatnonzero(~letters):
                        letters[k] = any(map(str.isalpha, texts[a + int(k)].as_py() or ""))  # category L
                    if model is None:
                        letters[:] = False
                        lang, score, far = [UNKNOWN] * (b - a), np.zeros(b - a), ~letters
                    else:
                        tf = counts(data, near)
                        best, cosine = model.nearest(tf)
                        score = np.where(letters, cosine, 0).astype(float)
                        far = ~letters | model.far(tf, best, cosine)
                        lang = [model.languages[model.language[c]] if ok else UNKNOWN for c, ok in zip(best, letters, strict=True)]
                    keep = [part.column(c).slice(a, b - a) for c in range(1, part.num_columns)]
                    yield from batches([(*keep, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(far, pa.bool_()))], [*part.schema.names[1:], "lang_pred", "score", "rejected"])

    return run


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from: a fifth, by the CRC-32 of doc_id as text."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, rejected)`` of every row of ``docs``.

    A null text, one without a letter, or any text under no model is ``und`` with
    score 0 and rejected. Texts with letters always get a learned language, those
    without any trigram the most frequent one with score 0. Other columns are ignored.
    """
    return docs.select("text", "doc_id", held_out(F.col("doc_id")).alias("held_out")).mapInArrow(
        _predict(model), "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"
    )


def accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` without rows that the model rejects; without a model all stay that have a letter. All columns are kept."""
    if model is None:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    fields = docs.schema.names
    inner = [f"c{k}" for k in range(len(fields))]  # whatever the names, none clashes
    types = ", ".join(f"{n} {docs.schema[f].dataType.simpleString()}" for n, f in zip(inner, fields, strict=True))
    judged = docs.select("text", *[F.col(f"`{f}`").alias(n) for n, f in zip(inner, fields, strict=True)]).mapInArrow(
        _predict(model), f"{types}, lang_pred string, score double, rejected boolean"
    )
    return judged.where("not rejected").select(*[F.col(n).alias(f) for n, f in zip(inner, fields, strict=True)])
