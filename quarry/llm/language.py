"""Language identification by nearest centroid (operator 7).

Texts become L2-normalised TF-IDF vectors of hashed byte n-grams (two and three
bytes). Each language has several centroids, found by spherical k-means; the language
of the most similar centroid is the prediction, and a text further from every centroid
than nearly all training texts is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quarry.llm.common import chunks

DIMS = 4096
#: Training texts at most, over all languages: the bound of the sample that is fitted on.
MAX_SAMPLE = 4000
CENTROIDS = 4
#: Rejected below this part of the similarity that all but QUANTILE of the training texts reach.
REJECT_PART, QUANTILE = 0.5, 0.001
UNKNOWN = "und"

#: ASCII characters that aren't letters become spaces.
_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def grams(text: str) -> np.ndarray:
    """Buckets of a text's n-grams, one for each place; lower-case, white space runs as one."""
    raw = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_LETTERS).split()) + b" "
    b = np.frombuffer(raw, dtype=np.uint8).astype(np.uint32)
    two = b[:-1] * np.uint32(0x9E3779B1) + b[1:] * np.uint32(0x85EBCA77)
    three = (two[:-1] ^ (two[:-1] >> np.uint32(15))) + b[2:] * np.uint32(0xC2B2AE3D) + np.uint32(0x27D4EB2F)
    both = np.concatenate([two, three])
    return ((both ^ (both >> np.uint32(13))) * np.uint32(0x9E3779B1)) >> np.uint32(32 - (DIMS - 1).bit_length())


def counts(texts: list[str | None]) -> np.ndarray:
    out = np.zeros((len(texts), DIMS), dtype=np.float32)
    for row, text in zip(out, texts, strict=True):
        if text:
            row[:] = np.bincount(grams(text), minlength=DIMS)
    return out


def normalised(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]  # of each centroid
    reject: float

    def vectors(self, texts: list[str | None]) -> np.ndarray:
        return normalised(np.log1p(counts(texts)) * self.idf)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, similarities from 0 to 1, and whether the text is rejected."""
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
        near = self.vectors(texts) @ self.centroids.T
        best = near.argmax(axis=1)
        top = np.clip(near[np.arange(len(texts)), best].astype(float), 0, 1)
        known = np.array([bool(t) and any(map(str.isalpha, t)) for t in texts], dtype=bool)
        langs = [self.langs[k] if ok else UNKNOWN for k, ok in zip(best, known, strict=True)]
        return langs, np.where(known, top, 0.0), ~known | (top < self.reject)


def clustered(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from seeds each furthest from those before."""
    seeds = [int((x @ normalised(x.mean(axis=0))).argmax())]
    while len(seeds) < min(k, len(x)):
        far = (x @ x[seeds].T).max(axis=1)
        if far.min() > 1 - 1e-6:
            break
        seeds.append(int(far.argmin()))
    centres = x[seeds]
    for _ in range(rounds):
        nearest = (x @ centres.T).argmax(axis=1)
        centres = np.stack([normalised(x[nearest == c].mean(axis=0)) if (nearest == c).any() else centres[c] for c in range(len(centres))])
    return centres


def fit(texts: list[str], langs: list[str], k: int = CENTROIDS) -> Model:
    """A model of labelled texts. Texts without a letter teach nothing."""
    kept = [(t, lang) for t, lang in zip(texts, langs, strict=True) if t and lang is not None and any(map(str.isalpha, t))]
    if not kept:
        return Model(np.ones(DIMS, np.float32), np.zeros((0, DIMS), np.float32), [], 0.0)
    tf = counts([t for t, _ in kept])
    idf = (np.log((1 + len(tf)) / (1 + (tf > 0).sum(axis=0))) + 1).astype(np.float32)
    x, of = normalised(np.log1p(tf) * idf), np.array([lang for _, lang in kept])
    names, centres = [], []
    for lang in sorted(set(of)):
        found = clustered(x[of == lang], k)
        centres.append(found)
        names += [str(lang)] * len(found)
    centres = np.concatenate(centres).astype(np.float32)
    reach = np.quantile((x @ centres.T).max(axis=1), QUANTILE)
    return Model(idf, centres, names, float(reach) * REJECT_PART)


def sampled(labelled: DataFrame, most: int = MAX_SAMPLE) -> DataFrame:
    """At most ``most`` rows of ``labelled`` (doc_id, text, lang): of each language the
    first by a hash of id and text, an equal share each, so that no order of rows or
    partitions matters. Of more than ``most`` languages the most frequent are learned."""
    kept = labelled.filter("lang is not null and text is not null").select("doc_id", "text", "lang")
    there = kept.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most)
    share = max(1, most // max(1, there.count()))
    # a part of the rows by hash, twice the share on average, before they are ordered
    key = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))
    some = kept.join(F.broadcast(there), "lang").withColumn("key", key).filter(F.col("key") <= (1 << 40) * F.least(F.lit(1.0), (2 * share + 64) / F.col("n")))
    place = F.row_number().over(W.partitionBy("lang").orderBy("key", "doc_id", "text"))
    return some.withColumn("place", place).filter(F.col("place") <= share).select("doc_id", "text", "lang")


def trained(labelled: DataFrame, most: int = MAX_SAMPLE) -> Model:
    """Fit on a bounded sample of labelled rows (doc_id, text, lang)."""
    rows = sampled(labelled.select("doc_id", "text", "lang"), most).collect()
    rows.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"]))
    return fit([r["text"] for r in rows], [r["lang"] for r in rows])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, lang_score and lang_rejected, read from whole texts.

    lang_pred is a learned language, or ``und`` where the text is null or has no
    letter; those score 0 and are rejected, as are texts whose similarity to every
    centroid is under the model's threshold. Equal similarities go to the first
    centroid, languages in order. A model that learned nothing answers ``und``. Given
    columns of the three names are replaced; repeated rows stay; an empty table gives
    an empty result."""
    docs = docs.drop("lang_pred", "lang_score", "lang_rejected")
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded: DIMS x CENTROIDS x languages
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    names = docs.columns
    at = names.index("text")

    def each(batches):
        for batch in chunks(batches, 256):
            langs, scores, rejected = held.value.predict(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores), pa.array(rejected)], [*names, "lang_pred", "lang_score", "lang_rejected"])

    return docs.mapInArrow(each, f"{fields}, lang_pred string, lang_score double, lang_rejected boolean")
