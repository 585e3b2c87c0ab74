"""Language identification by the nearest of several centroids per language.

A text is a vector of hashed byte n-grams (A-Z lower-cased, other ASCII than letters one space), weighted by TF-IDF and
scaled to length one.  Document frequencies come from all training rows that have a letter.  A language's centroids come
from spherical k-means over a bounded sample of its rows.  A text goes to the centroid of highest cosine.  Short texts lie
farther from any centroid than long ones, so a centroid has a limit for each length: a share of a low quantile of the
cosines that pieces of that length, cut from its sampled rows, have to it.  A text below the limit is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import making_room
from .kernels import mix, slices, text_buffers

DIMS = 4096
ORDERS = (2, 3)
UNKNOWN = "und"
MOST_CENTROIDS = 2000
BANDS = 14  # of lengths: powers of two of the count of n-grams
LOW, SHARE, LEAST_PIECES = 0.02, 0.7, 30

_CLASS = np.full(256, 32, np.uint8)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)


def counts(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, matrix of n-gram counts) over a string column, at most 128 rows or about 1 MB at a time."""
    data, at = text_buffers(column)
    for low, high in slices(at, 1 << 20):
        for first in range(low, high, 128):
            last = min(first + 128, high)
            n = last - first
            size = np.diff(at[first : last + 1])
            # each text stands between two spaces
            place = np.repeat(np.arange(n) * 2 + 1, size) + np.arange(int(size.sum()))
            code = np.full(int(size.sum()) + 2 * n, 32, np.uint64)
            code[place] = _CLASS[data[at[first] : at[last]]]
            row = np.repeat(np.arange(n), size + 2)
            space = code == 32
            keep = np.r_[True, ~(space[1:] & space[:-1] & (row[1:] == row[:-1]))]
            code, row = code[keep], row[keep]
            out = np.zeros(n * DIMS, np.float32)
            for k in ORDERS:
                if len(code) < k:
                    continue
                m = len(code) - k + 1
                gram = np.full(m, k, np.uint64)
                for i in range(k):
                    gram = (gram << np.uint64(8)) | code[i : i + m]
                inside = row[:m] == row[k - 1 :]
                slot = (mix(gram[inside]) >> np.uint64(52)).astype(np.int64)
                out += np.bincount(row[:m][inside] * DIMS + slot, minlength=n * DIMS).astype(np.float32)
            yield first, out.reshape(n, DIMS)


def vectors(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(tf) * idf
    length = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.maximum(length, 1e-12)


def kmeans(x: np.ndarray, k: int, rounds: int = 15) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids and each row's cosine to its own; starts from rows that lie far apart, but passes over the farthest twentieth."""
    picked = [x.mean(0)]
    best = x @ picked[0]
    while len(picked) < min(k, len(x)):
        far = int(np.argsort(best, kind="stable")[len(x) // 20])
        picked.append(x[far])
        best = np.maximum(best, x @ x[far])
    c = np.array(picked)
    c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        new = np.array([x[own == j].sum(0) if (own == j).any() else c[j] for j in range(len(c))])
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
        if np.allclose(new, c, atol=1e-5):
            break
        c = new
    return c.astype(np.float32), (x @ c.T).max(1)


def band(tf: np.ndarray) -> np.ndarray:
    """The length band of each row of counts."""
    return np.minimum(np.log2(np.maximum(tf.sum(1), 1)).astype(int), BANDS - 1)


def limits(texts: list[str], c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The least cosine (centroid, band), from middle pieces of ``texts``; a band with few pieces takes all centroids' or the next shorter one's."""
    own, at, cosine = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0)]
    for size in [1 << k for k in range(1, BANDS)] + [None]:
        cut = texts if size is None else [t[(len(t) - size) // 2 :][:size] for t in texts if len(t) > size]
        for _, tf in counts(pa.array(cut, pa.string())):
            tf = tf[tf.any(1)]
            near = vectors(tf, idf) @ c.T
            own.append(near.argmax(1))
            at.append(band(tf))
            cosine.append(near.max(1) if len(near) else np.zeros(0))
    own, at, cosine = np.concatenate(own), np.concatenate(at), np.concatenate(cosine)
    least = np.zeros((len(c), BANDS), np.float32)
    for b in range(BANDS):
        for j in range(len(c)):
            here = cosine[(at == b) & (own == j)]
            if len(here) < LEAST_PIECES:
                here = cosine[at == b]
            least[j, b] = SHARE * np.quantile(here, LOW) if len(here) >= LEAST_PIECES else least[j, b - 1] if b else 0
    return least


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # a row each
    owner: np.ndarray  # the language's place, by centroid
    least: np.ndarray  # the cosine below which a text is rejected, by centroid and length band


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """How many of ``texts`` (text) there are and how many hold each n-gram slot; each task sends one row a slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(DIMS, np.int64), 0
        for b in batches:
            for _, tf in counts(b.column(0)):
                seen += (tf > 0).sum(0)
                n += len(tf)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIMS)), pa.array(np.r_[n, seen])], ["slot", "n"])

    rows = texts.mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(DIMS + 1, np.int64)
    for r in rows:
        out[r.slot + 1] = r.n
    return int(out[0]), out[1:]


def fit(rows: DataFrame, per_language: int = 600, clusters: int = 4) -> Model:
    """Learns from ``rows`` (id, text, lang); rows with a null lang or a text without a letter are passed over.

    Counts cover all rows.  The centroids of a language come from about ``per_language`` of its distinct rows, those with
    the smallest hashes of id and text (the bound of the sample).  Repeated rows count once, so a language with fewer
    distinct rows than that has them all, and none can be left without a sample.  The model holds ``clusters`` centroids a
    language, fewer where there are more than ``MOST_CENTROIDS`` in all, but one at least: 16 KB a centroid.
    """
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("id", "text", F.col("lang").cast("string").alias("lang"))
    draw = F.xxhash64("id", "text")
    # one row a language: the labels of a corpus, not its documents
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.approx_count_distinct(draw, 0.02).alias("n")).collect()}
    if not sizes:
        return Model([], np.ones(DIMS, np.float32), np.zeros((0, DIMS), np.float32), np.zeros(0, int), np.zeros((0, BANDS)))
    n, df = document_frequencies(rows.select("text"))
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    names = sorted(sizes)
    clusters = max(1, min(clusters, MOST_CENTROIDS // len(names)))
    rates = rows.sparkSession.createDataFrame([(k, float(min(1.0, per_language / max(1, sizes[k])))) for k in names], "lang string, rate double")
    unit = (draw.cast("double") / 2.0**64) + 0.5
    sample = rows.join(F.broadcast(rates), "lang").where(unit <= F.col("rate")).dropDuplicates(["id", "text", "lang"]).select("lang", "text")

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("text")
        x = np.concatenate([vectors(tf, idf) for _, tf in counts(pa.array(pdf["text"], pa.string()))])
        c, _ = kmeans(x, clusters)
        c = c[np.unique((x @ c.T).argmax(1))]
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "k": range(len(c)), "v": list(c), "least": list(limits(pdf["text"].tolist(), c, idf))})

    got = sorted(sample.groupBy("lang").applyInPandas(group, "lang string, k int, v array<float>, least array<float>").collect(), key=lambda r: (r.lang, r.k))
    return Model(names, idf, np.array([r.v for r in got], np.float32), np.array([names.index(r.lang) for r in got]), np.array([r.least for r in got], np.float32).reshape(-1, BANDS))


def _no_letter(text: str | None) -> bool:
    return text is None or not any(map(str.isalpha, text))


def predicted(docs: DataFrame, model: Model, text_col: str = "text", lang: str = "lang_pred", score: str = "score", rejected: str = "rejected") -> DataFrame:
    """``docs`` with lang_pred, score (cosine, 0 to 1) and rejected.

    A null text and one without a letter are ``und`` with score 0 and rejected, as is every text if nothing was learned.
    Else lang_pred is the nearest language even where ``rejected`` is true.  Ties go to the language that sorts first.
    A column of ``docs`` that has one of these names comes out with an underscore behind it.
    """
    place = [c.lower() for c in docs.columns].index(text_col.lower())
    docs = making_room(docs, lang, score, rejected)
    schema = ", ".join(f"`{c}` {kind}" for c, kind in docs.dtypes) + f", `{lang}` string, `{score}` double, `{rejected}` boolean"
    names = [*docs.columns, lang, score, rejected]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(place)
            which, best, far = np.zeros(len(column), int), np.zeros(len(column)), np.ones(len(column), bool)
            data, at = text_buffers(column)
            ascii_letter = np.zeros(256, bool)
            ascii_letter[[*range(65, 91), *range(97, 123)]] = True
            if len(model.centroids):
                for first, tf in counts(column):
                    cosine = vectors(tf, model.idf) @ model.centroids.T
                    top = cosine.argmax(1)
                    rows_ = np.arange(len(top))
                    which[first : first + len(top)] = model.owner[top]
                    best[first : first + len(top)] = cosine[rows_, top]
                    far[first : first + len(top)] = cosine[rows_, top] < model.least[top, band(tf)]
            sums = np.r_[0, np.cumsum(ascii_letter[data[at[0] : at[-1]]])]
            plain = sums[at[1:] - at[0]] > sums[at[:-1] - at[0]]
            known = [bool(len(model.centroids)) and (bool(p) or not _no_letter(column[i].as_py())) for i, p in enumerate(plain)]
            yield pa.RecordBatch.from_arrays(
                [
                    *b.columns,
                    pa.array([model.languages[w] if ok else UNKNOWN for w, ok in zip(which, known, strict=True)], pa.string()),
                    pa.array(np.where(known, np.clip(best, 0, 1), 0.0)),
                    pa.array(far | ~np.array(known, bool)),
                ],
                names,
            )

    return docs.mapInArrow(run, schema)


def identified(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` with the columns of ``predicted``, by a model learned from the rows where ``learn`` holds; lang and id are no inputs of a prediction."""
    model = fit(docs.where(learn).select(docs[id_col].alias("id"), docs[text_col].alias("text"), docs[lang_col].alias("lang")))
    return predicted(docs, model, text_col)
