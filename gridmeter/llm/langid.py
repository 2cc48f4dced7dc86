"""Language identification: nearest of several clustered centroids per language, by cosine of TF-IDF n-gram vectors.

Nulls and texts without a letter get `und`, score 0 and are rejected. Empty tables give empty tables; without a single
training row every document is `und`. Equal cosines go to the language that sorts first. Very long texts are one vector
like any other. Repeated rows are predicted alike. Extra columns of the input are left out of the result of `identify`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
DIMS = 4096
#: Centroids per language, and labelled documents per language that they are clustered from (in expectation).
CLUSTERS, SAMPLE = 3, 600
#: A text is rejected when its cosine is under this share of what the least typical hundredth of its length class has.
SLACK = 0.5
#: Texts under 2**6 letters are never too far away: their cosines say little.
SHORT = 6
ROUNDS = 12
BUCKETS = 24
_PRIMES = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)
_LETTER: np.ndarray | None = None


@dataclass
class Model:
    langs: list[str]
    centroids: np.ndarray  # (languages x clusters, DIMS), rows of length 1
    owner: np.ndarray  # index into langs for each centroid
    idf: np.ndarray
    floor: np.ndarray  # lowest accepted cosine for each class of lengths


def _letters(codes: np.ndarray) -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _LETTER[codes]


def counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed counts of n-grams of 1 to 3 letters, words being set off by a blank; and the number of letters of each text."""
    lowered = [f" {t.lower()} " for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in lowered])
    letter = _letters(codes)
    keep = letter | np.concatenate(([True], letter[:-1]))  # a run of other characters counts as one blank
    codes, doc, letter = np.where(letter, codes, np.uint32(32))[keep], doc[keep], letter[keep]
    out = np.zeros(len(texts) * DIMS, dtype=np.int64)
    gram = np.zeros(len(codes), dtype=np.uint32)
    for n in range(3):
        if len(codes) <= n:
            break
        size = len(codes) - n
        gram = gram[:size] * np.uint32(31) + codes[n:] * _PRIMES[n] + np.uint32(n)
        mixed = (gram ^ (gram >> np.uint32(15))) * _PRIMES[2]
        slot = (mixed >> np.uint32(20)).astype(np.int64)
        inside = doc[:size] == doc[n:]
        if n == 0:
            inside = letter
        out += np.bincount((doc[:size] * DIMS + slot)[inside], minlength=len(out))
    return out.reshape(len(texts), DIMS), np.bincount(doc[letter], minlength=len(texts))


def vectors(hits: np.ndarray, idf: np.ndarray) -> np.ndarray:
    out = np.log1p(hits.astype(np.float32)) * idf
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.where(norm > 0, norm, 1)


def parts(texts: list[str], rows: int = 128, chars: int = 1 << 20) -> Iterator[list[str]]:
    """Runs of texts whose counts fit in a few MB."""
    part: list[str] = []
    size = 0
    for text in texts:
        if part and (len(part) >= rows or size + len(text) > chars):
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


def length_class(letters: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(letters, 1)).astype(np.int64), BUCKETS - 1)


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", seed: int = 7, sample: int = SAMPLE) -> Model:
    """Document frequencies over all labelled rows; centroids from a sample of at most about `sample` rows per language."""
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(F.lit(seed), F.col(text)).alias("draw"))
    rows = rows.filter(F.col("lang").isNotNull() & has_letter(F.col("text")))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = np.zeros(DIMS, dtype=np.int64), 0
        for batch in batches:
            for part in parts(batch.column(0).to_pylist()):
                seen += (counts(part)[0] > 0).sum(axis=0)
                total += len(part)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIMS)), pa.array(np.concatenate(([total], seen)))], ["slot", "n"])

    found = rows.select("text").mapInArrow(frequencies, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(DIMS + 1, dtype=np.float64)
    for row in found:
        df[row.slot + 1] = row.n
    idf = (np.log((1 + df[0]) / (1 + df[1:])) + 1).astype(np.float32)

    per_lang = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not per_lang:
        return Model([], np.zeros((0, DIMS), np.float32), np.zeros(0, np.int64), idf, np.zeros(BUCKETS))
    share = F.create_map(*[F.lit(x) for k, n in sorted(per_lang.items()) for x in (k, min(1.0, sample / n))])
    drawn = rows.filter(F.pmod("draw", F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * (1 << 30))

    def cluster(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["draw", "text"])
        hits = [counts(p) for p in parts(group["text"].tolist())]
        x, letters = np.concatenate([vectors(h, idf) for h, _ in hits]), np.concatenate([n for _, n in hits])
        centers = spherical_means(x, CLUSTERS)
        near = (x @ centers.T).max(axis=1)
        low = np.full(BUCKETS, np.nan)
        for bucket in np.unique(length_class(letters)):
            low[bucket] = np.quantile(near[length_class(letters) == bucket], 0.01)
        return pd.DataFrame({"lang": [group["lang"].iloc[0]], "centers": [centers.astype(np.float64).ravel().tolist()], "low": [low.tolist()]})

    fitted = drawn.groupBy("lang").applyInPandas(cluster, "lang string, centers array<double>, low array<double>").collect()
    fitted = sorted(fitted, key=lambda r: r["lang"])
    centers = [np.array(r["centers"], dtype=np.float32).reshape(-1, DIMS) for r in fitted]
    low = np.array([[np.nan if v is None else v for v in r["low"]] for r in fitted], dtype=np.float64)
    floor = np.where(np.isnan(low).all(axis=0), np.inf, np.nan_to_num(low, nan=np.inf).min(axis=0))
    # A class that no sample fell in takes the floor of the next shorter one; below the shortest, half of that one's.
    known = floor[np.isfinite(floor)]
    for bucket in range(BUCKETS):
        if not np.isfinite(floor[bucket]):
            floor[bucket] = floor[bucket - 1] if bucket else known[0] / 2
    owner = np.repeat(np.arange(len(fitted)), [len(c) for c in centers])
    floor[:SHORT] = 0.0
    return Model([r["lang"] for r in fitted], np.concatenate(centers), owner, idf, floor * SLACK)


def spherical_means(x: np.ndarray, k: int) -> np.ndarray:
    """Centroids of length 1; seeded by the row nearest to the mean, then by rows farthest from those chosen."""
    mean = x.mean(axis=0)
    chosen = [int((x @ mean).argmax())]
    while len(chosen) < min(k, len(x)):
        chosen.append(int((x @ x[chosen].T).max(axis=1).argmin()))
    centers = x[chosen]
    for _ in range(ROUNDS):
        label = (x @ centers.T).argmax(axis=1)
        sums = np.stack([x[label == i].sum(axis=0) if (label == i).any() else centers[i] for i in range(len(centers))])
        centers = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centers.astype(np.float32)


def predict(texts: list[str], model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, cosine and rejection of texts that hold a letter."""
    langs, scores, rejected = [], [], []
    for part in parts(texts):
        hits, letters = counts(part)
        cosine = vectors(hits, model.idf) @ model.centroids.T
        best = cosine.argmax(axis=1)
        near = np.clip(cosine[np.arange(len(part)), best].astype(np.float64), 0, 1)
        langs += [model.langs[i] for i in model.owner[best]]
        scores.append(near)
        rejected.append(near < model.floor[length_class(letters)])
    return langs, np.concatenate(scores) if scores else np.zeros(0), np.concatenate(rejected) if rejected else np.zeros(0, bool)


def identify(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` with lang_pred, score and rejected. Only the text is looked at."""
    rows = docs.select(*[F.col(c) for c in keep], F.col(text).alias("_text"), has_letter(F.col(text)).alias("_letter"))
    out = rows.select(*keep).schema
    for name, kind in (("lang_pred", "string"), ("score", "double"), ("rejected", "boolean")):
        out = out.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            where = np.flatnonzero(batch.column(len(keep) + 1).to_numpy(zero_copy_only=False))
            lang, score, rejected = np.full(n, UNKNOWN, dtype=object), np.zeros(n), np.ones(n, dtype=bool)
            if len(where) and model.langs:
                lang[where], score[where], rejected[where] = predict(batch.column(len(keep)).take(pa.array(where)).to_pylist(), model)
            cols = [batch.column(i) for i in range(len(keep))] + [pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays(cols, [*keep, "lang_pred", "score", "rejected"])

    return rows.mapInArrow(run, out)
