"""Language identification by nearest centroid.

A text is the vector of its hashed character n-grams (2 and 3 bytes of its
lower-cased UTF-8 form, with all between letters taken as one space), each counted as 1 + ln(count), weighted by inverse
document frequency and scaled to length one. Each language has several
centroids, found by spherical k-means over its own training texts, so that a
language of many styles isn't squeezed into one mean. A text is of the language
of the nearest centroid by cosine, and is rejected if even that is farther than
hardly any text of its language with about as many n-grams is: whole texts and
excerpts of the training texts, short ones too, give a floor for each band of
counts.

Document frequencies come from all training documents. The centroids are fitted
on at most SAMPLE documents a language, those with the least hash of their id.

Defined results: a null text, or one without a letter, is `und` with score 0
and rejected; documents with a null language teach nothing; without training
documents every text is `und`; of centroids that are equally near the first by
language and hash decides; very long texts are counted whole, in pieces of a
megabyte; repeated rows get equal results; an empty table gives no rows. A
column of docs that has the name of a new one is replaced by it; others stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import fresh, stash

DIMENSIONS = 8192
CENTROIDS = 4
SAMPLE = 400
"""Documents a language that the centroids are fitted on."""

MAX_LANGUAGES = 10_000
"""More languages are an error: their centroids are held on the driver and in every task. None is dropped."""

REJECT_QUANTILE, REJECT_SHARE = 0.01, 0.75
"""A text is rejected if its cosine is below this share of this quantile of its language's sampled texts and excerpts with about as many n-grams."""

EXCERPTS = (6, 12, 24, 48, 96, 192, 384)
"""Letters and other characters of the excerpts."""

MIN_GRAMS, MIN_SAMPLES, BANDS = 4, 20, 40
"""A text of fewer different n-grams is rejected only if it shares none; a band of fewer samples has the floor of the next lower one."""

UNKNOWN = "und"
_MULTIPLIER = np.uint32(2654435761)
_SHIFT = np.uint32(32 - DIMENSIONS.bit_length() + 1)
CHUNK = 128
_SPACES = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))


def counts(text: str) -> np.ndarray:
    """How often each hashed bucket of 2- and 3-byte n-grams occurs in one text."""
    letters = b" ".join(text.lower().encode().translate(_SPACES).split())
    raw = np.frombuffer(b" %b " % letters, dtype=np.uint8)
    total = np.zeros(DIMENSIONS, dtype=np.int64)
    for at in range(0, max(1, len(raw) - 2), 1 << 20):
        part = raw[at : at + (1 << 20) + 2].astype(np.uint32)
        two = part[:-1] << np.uint32(8) | part[1:]
        three = two[:-1] << np.uint32(8) | part[2:]
        total += np.bincount(three * _MULTIPLIER >> _SHIFT, minlength=DIMENSIONS)
        total += np.bincount((two[: len(three) or 1] + np.uint32(1 << 24)) * _MULTIPLIER >> _SHIFT, minlength=DIMENSIONS)
    return total


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    """Unit vectors, one row a text."""
    own = np.stack([counts(t) for t in texts]).astype(np.float32)
    own = np.where(own > 0, 1 + np.log(np.maximum(own, 1)), 0) * idf
    return own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-12)


def band(grams: np.ndarray) -> np.ndarray:
    """The band of each number of different n-grams: two for each doubling."""
    return np.minimum(np.floor(2 * np.log2(np.maximum(grams, 1))), BANDS - 1).astype(int)


def excerpts(text: str, draw: int) -> list[str]:
    """A piece of each length that the text has, at a place told by draw."""
    return [text[at : at + n] for n in EXCERPTS if n < len(text) for at in [draw % (len(text) - n)]]


def floors(grams: np.ndarray, cosines: np.ndarray) -> np.ndarray:
    """The least cosine of each band that isn't rejected."""
    out, now, bands = np.full(BANDS, 1e-9), 1e-9, band(grams)
    for i in range(int(band(np.array([MIN_GRAMS]))[0]), BANDS):
        own = cosines[(bands == i) & (grams >= MIN_GRAMS)]
        if len(own) >= MIN_SAMPLES:
            now = max(1e-9, float(np.quantile(own, REJECT_QUANTILE)) * REJECT_SHARE)
        out[i] = now
    return out


def cluster(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means, started at points far from each other; at most k unit centroids."""
    chosen = [0]
    nearest = points @ points[0]
    while len(chosen) < min(k, len(points)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, points @ points[chosen[-1]])
    middle = points[chosen]
    for _ in range(rounds):
        owner = (points @ middle.T).argmax(axis=1)
        sums = np.stack([points[owner == i].sum(axis=0) for i in range(len(middle)) if (owner == i).any()])
        middle = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return middle


@dataclass
class Model:
    idf: np.ndarray
    names: list[str]
    """The language of each centroid."""
    centroids: np.ndarray
    floors: np.ndarray
    """The cosine below which a text nearest to the centroid is rejected, by band of its number of different n-grams."""


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", k: int = CENTROIDS, sample: int = SAMPLE) -> Model:
    """The model of the languages of docs; docs are all for training."""
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(doc_id).cast("string"), text).alias("draw"))

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIMENSIONS, dtype=np.int64), 0
        for batch in batches:
            for t in batch.column(0):
                total += counts(t.as_py()) > 0
                n += 1
        buckets = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, buckets]), pa.array(np.r_[n, total[buckets]])], ["bucket", "n"])

    # One row a bucket: at most DIMENSIONS + 1 come to the driver.
    df = {r["bucket"]: r["n"] for r in rows.select("text").mapInArrow(seen, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    n = df.pop(-1, 0)
    idf = np.zeros(DIMENSIONS, dtype=np.float32)
    for bucket, own in df.items():
        idf[bucket] = np.log((1 + n) / (1 + own)) + 1

    least = Window.partitionBy("lang").orderBy("draw")
    drawn = rows.select("lang", "draw").withColumn("place", F.row_number().over(least)).filter(F.col("place") <= sample)
    limits = stash(drawn.groupBy("lang").agg(F.max("draw").alias("upto")), "draws")
    if limits.count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    training = rows.join(F.broadcast(limits), "lang").filter(F.col("draw") <= F.col("upto"))

    def middles(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("draw").head(sample)  # repeated rows could be more
        points = np.concatenate([vectors(list(own["text"].iloc[i : i + CHUNK]), idf) for i in range(0, len(own), CHUNK)])
        middle = cluster(points, k)
        grams, cosines = [(points > 0).sum(axis=1)], [(points @ middle.T).max(axis=1)]
        short = [x for t, draw in zip(own["text"], own["draw"], strict=True) for x in excerpts(t, int(draw)) if any(map(str.isalpha, x))]
        for i in range(0, len(short), CHUNK):
            some = vectors(short[i : i + CHUNK], idf)
            grams.append((some > 0).sum(axis=1))
            cosines.append((some @ middle.T).max(axis=1))
        floor = floors(np.concatenate(grams), np.concatenate(cosines)).tolist()
        return pd.DataFrame({"lang": own["lang"].iloc[0], "floor": [floor] * len(middle), "centroid": [m.astype(float).tolist() for m in middle]})

    fitted = training.groupBy("lang").applyInPandas(middles, "lang string, floor array<double>, centroid array<double>").orderBy("lang", F.xxhash64("centroid")).collect()
    return Model(idf, [r["lang"] for r in fitted], np.array([r["centroid"] for r in fitted], dtype=np.float32).reshape(-1, DIMENSIONS), np.array([r["floor"] for r in fitted]).reshape(-1, BANDS))


def identify(docs: DataFrame, model: Model, text: str = "text", prefix: str = "lang_") -> DataFrame:
    """docs with <prefix>pred, <prefix>score (cosine of the nearest centroid) and <prefix>rejected."""
    own = f"struct<{prefix}pred: string, {prefix}score: double, {prefix}rejected: boolean>"
    names, least = np.array(model.names, dtype=object), model.floors
    shared = docs.sparkSession.sparkContext.broadcast((model.idf, model.centroids))

    @F.pandas_udf(own)
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        idf, centroids = shared.value
        for batch in batches:
            pred, score, rejected = np.full(len(batch), UNKNOWN, dtype=object), np.zeros(len(batch)), np.ones(len(batch), dtype=bool)
            real = np.flatnonzero(batch.notna().to_numpy()) if len(names) else np.zeros(0, dtype=int)
            for at in range(0, len(real), CHUNK):
                some = real[at : at + CHUNK]
                own = vectors(list(batch.iloc[some]), idf)
                cosine = own @ centroids.T
                best = cosine.argmax(axis=1)
                pred[some], score[some] = names[best], np.clip(cosine.max(axis=1), 0, 1)
                grams = (own > 0).sum(axis=1)
                rejected[some] = score[some] < np.where(grams >= MIN_GRAMS, least[best, band(grams)], 1e-9)
            yield pd.DataFrame({f"{prefix}pred": pred, f"{prefix}score": score, f"{prefix}rejected": rejected})

    has_letter: Column = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    kept, found = [F.col(f"`{c}`") for c in docs.columns if c not in {f"{prefix}pred", f"{prefix}score", f"{prefix}rejected"}], fresh(docs.columns, "nearest")
    return docs.withColumn(found, nearest(F.when(has_letter, F.col(text)))).select(*kept, f"{found}.*")


def known(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs without those that the model rejects."""
    prefix = fresh([c.removesuffix("rejected").removesuffix("score").removesuffix("pred") for c in docs.columns], "lang_")
    return identify(docs, model, text, prefix).filter(~F.col(f"{prefix}rejected")).select(*(F.col(f"`{c}`") for c in docs.columns))
