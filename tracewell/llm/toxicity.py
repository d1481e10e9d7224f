"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary text and one on toxic text. Toxic text is ordinary
for its most part, and what is toxic in it is a small part of what a dictionary would learn, so the toxic one
is trained on stretches of toxic texts that hold what leans to toxic text: strings of ``PIECE`` bytes in
far more toxic documents than ordinary ones, by a smoothed ratio and its certainty. An ordinary document that
quotes such a string, or a wrong label, lowers the ratio and no more. How long the
dictionary gets follows from the number of such strings.

A window of a text is compressed with the ordinary dictionary, and with the toxic one set after it; the bytes
saved are its gain. A text's mean gain and the shares of its windows that reach each of two
thresholds go into a logistic curve, which gives the score. Gains for the calibration come from
toxic dictionaries that have not seen the document: the sample is dealt into ``FOLDS`` folds for that.

The fit uses a bounded sample of labelled rows: at most ``most_toxic`` and
``most_ordinary`` documents, chosen by a hash of their ids, and of each a stretch of at
most ``stretch`` characters at a place given by that hash; all windows of these are used. Scoring reads every text whole.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import Column, DataFrame, functions as F

WORDS_A_WINDOW, ORDINARY_BYTES = 8, 32768
PIECE, RATIO, SURE = 6, 6.0, 4.0
BYTES_A_PIECE, LEAST_BYTES, MOST_BYTES = 3, 256, 32768  # of the toxic dictionary
HEADER = 600  # entropy tables at the head of a trained dictionary; only its content is used
THRESHOLDS = (2, 3)
FOLDS = 4


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    mean: tuple[float, ...]
    spread: tuple[float, ...]
    weights: tuple[float, ...]


def windows(text: str | None) -> list[bytes]:
    """Runs of ``WORDS_A_WINDOW`` lower-cased words, one empty window for a text without any."""
    w = (text or "").lower().encode("utf-8", "surrogatepass").split()
    return [b" ".join(w[i : i + WORDS_A_WINDOW]) for i in range(0, len(w), WORDS_A_WINDOW)] or [b""]


def _compressor(content: bytes) -> zs.ZstdCompressor:
    params = zs.ZstdCompressionParameters.from_level(
        3, source_size=100, dict_size=len(content), min_match=6, strategy=zs.STRATEGY_GREEDY, hash_log=17, chain_log=17,
        window_log=17, write_checksum=False, write_content_size=False, write_dict_id=False,
    )
    if not content:
        return zs.ZstdCompressor(compression_params=params)
    d = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=params)
    return zs.ZstdCompressor(compression_params=params, dict_data=d)


def _trained(samples: list[bytes], size: int, header: int, **how) -> bytes:
    """The content of a dictionary; the samples themselves where there are too few to train on."""
    try:
        content = zs.train_dictionary(size + header, samples, **how).as_bytes()[header:]
    except (zs.ZstdError, ValueError):
        content = b""
    return content or b" ".join(dict.fromkeys(samples))[-size:]


def _pair(ordinary: bytes, toxic: bytes):
    return _compressor(ordinary), _compressor(ordinary + toxic)


def features(text: str | None, pair) -> list[float]:
    """What the gains of a text's windows come to."""
    plain, both = (x.compress for x in pair)
    g = np.array([len(plain(w)) - len(both(w)) for w in windows(text)], float)
    return [g.mean(), *[(g >= t).mean() for t in THRESHOLDS]]


def _strings(text: bytes) -> np.ndarray:
    """Each run of ``PIECE`` bytes as a number."""
    a = np.frombuffer(text, np.uint8).astype(np.int64)
    n = max(0, len(a) - PIECE + 1)
    h = np.zeros(n, np.int64)
    for i in range(PIECE):
        h = h << 8 | a[i : i + n]
    return h


def document_counts(texts: list[bytes], strings: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """For each group of texts and each of some sorted strings, in how many of them it is."""
    out = np.zeros((groups, len(strings)), np.int32)
    for t, g in zip(texts, group) if len(strings) else ():
        h = np.unique(_strings(t))
        at = np.minimum(np.searchsorted(strings, h), len(strings) - 1)
        out[g, at[strings[at] == h]] += 1
    return out


def leaning(n: np.ndarray, docs: int, other: np.ndarray, other_docs: int) -> np.ndarray:
    """Which strings lean to the first texts, by the ratio of the shares of documents that have them, and its standard error."""
    ratio = np.log((n + 0.5) / (docs + 1)) - np.log((other + 0.5) / (other_docs + 1))
    return (ratio > np.log(RATIO)) & (ratio > SURE * np.sqrt(1 / (n + 0.5) + 1 / (other + 0.5)))


def _stretches(text: bytes, strings: np.ndarray) -> bytes:
    """The parts of a text, from white space to white space, that hold one of some strings."""
    h = _strings(text)
    at = np.minimum(np.searchsorted(strings, h), len(strings) - 1)
    hit = np.concatenate([[0], np.cumsum(np.convolve(strings[at] == h, np.ones(PIECE, int)) > 0)]) if len(h) else np.zeros(len(text) + 1, int)
    gap = np.flatnonzero(np.isin(np.frombuffer(text, np.uint8), (9, 10, 11, 12, 13, 32)))
    starts, ends = np.append(0, gap + 1), np.append(gap, len(text))
    found = hit[ends] > hit[starts]
    return b" ".join([b"", *(text[a:b] for a, b in zip(starts[found], ends[found])), b""])


def toxic_dictionary(toxic: list[bytes], strings: np.ndarray) -> bytes:
    """Trained on the stretches of toxic texts that hold one of some strings."""
    samples = [x for x in (_stretches(t, strings) for t in toxic) if len(x) > PIECE] if len(strings) else []
    return _trained(samples, min(MOST_BYTES, max(LEAST_BYTES, BYTES_A_PIECE * len(strings))), 200, d=8, k=32)


def _logistic(a: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> np.ndarray:
    a = np.c_[a, np.ones(len(a))]
    b = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        grad = a.T @ (p - y) + ridge * np.r_[b[:-1], 0]
        b -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(b)), grad)
    return b


def fit(texts: list[str], toxic: list[int]) -> Model:
    """The model of labelled texts; without both classes it scores the share of toxic ones."""
    bad = [t for t, y in zip(texts, toxic) if y]
    good = [t for t, y in zip(texts, toxic) if not y]
    if not bad or not good:
        share = len(bad) / len(texts) if texts else 0.0
        odds = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
        n = len(THRESHOLDS) + 1
        return Model(b"", b"", (0.0,) * n, (1.0,) * n, (0.0,) * n + (odds,))
    ordinary = _trained([w for t in good for w in windows(t)], ORDINARY_BYTES, HEADER)
    y = np.array(toxic, bool)
    low = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    fold = np.array([zlib.crc32(t) % FOLDS for t in low])  # copies fall into one fold
    strings = np.unique(np.concatenate([np.unique(_strings(t)) for t, z in zip(low, y) if z]))
    counts = document_counts(low, strings, 2 * fold + y, 2 * FOLDS).reshape(FOLDS, 2, -1)
    docs = np.bincount(2 * fold + y, minlength=2 * FOLDS).reshape(FOLDS, 2)

    def without(f: int | None) -> bytes:
        """The toxic dictionary of the other folds."""
        rest = [g for g in range(FOLDS) if g != f]
        n, all_ = counts[rest].sum(0), docs[rest].sum(0)
        own = strings[leaning(n[1], all_[1], n[0], all_[0])]
        return toxic_dictionary([t for t, z, g in zip(low, y, fold) if z and g != f], own)

    a = np.zeros((len(texts), len(THRESHOLDS) + 1))
    for f in range(FOLDS):
        pair = _pair(ordinary, without(f))
        for k in np.flatnonzero(fold == f):
            a[k] = features(texts[k], pair)
    mean, spread = a.mean(0), a.std(0) + 1e-9
    weights = _logistic((a - mean) / spread, y.astype(float))
    return Model(ordinary, without(None), tuple(mean), tuple(spread), tuple(weights))


def score(text: str | None, model: Model, pair) -> float:
    a = (np.array(features(text, pair)) - model.mean) / model.spread
    return float(1 / (1 + np.exp(-np.clip(a @ model.weights[:-1] + model.weights[-1], -30, 30))))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """The fold that no model learns from; a null id is in it."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(True))


def learn(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    most_toxic: int = 2000, most_ordinary: int = 8000, stretch: int = 8000,
) -> Model:
    """Fit on the rows outside the held-out fold; an id labelled twice counts as toxic if it ever is.

    Null labels and null ids are left out, null texts are empty; of an id's several texts the first in
    order counts. Without labels every score is the same.
    """
    marks = labels.filter(~held_out(F.col(id_col)) & F.col(label_col).isNotNull()).groupBy(id_col)
    marks = marks.agg((F.max(label_col) > 0).cast("int").alias("y"))
    # the first rows by hash, of each class: a bounded sample that is the same in every run
    order = [F.xxhash64(F.col(id_col).cast("string")), F.col(id_col)]
    chosen = marks.filter("y = 1").orderBy(*order).limit(most_toxic).unionByName(
        marks.filter("y = 0").orderBy(*order).limit(most_ordinary)
    )
    room = F.greatest(F.length("text") - F.lit(stretch) + 1, F.lit(1))
    rows = (
        docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .join(chosen, id_col)
        .groupBy(id_col).agg(F.min("text").alias("text"), F.max("y").alias("y"))
        .select(id_col, "y", F.expr("text").substr((F.pmod(F.xxhash64(F.col(id_col).cast("string")), room) + 1).cast("int"), F.lit(stretch)).alias("text"))
        .toArrow()
        .sort_by(id_col)
    )
    return fit(rows.column("text").to_pylist(), rows.column("y").to_pylist())


def _scorer(model: Model, id_type: str):
    def run(batches):
        pair = _pair(model.ordinary, model.toxic)
        for b in batches:
            s = np.array([score(t.as_py(), model, pair) for t in b.column(1)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], ["id", "score"])

    return run, f"id {id_type}, score double"


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, held_out, score, predicted)`` for every row of ``docs``, without a shuffle.

    The score depends on the text alone, and all of it counts, however long. Null and empty texts are
    one empty window, so they have all the same score. Ids may repeat or be null (a null id is held
    out), rows that repeat are scored alike. An empty table gives no rows; other columns are not looked at.
    """
    run, schema = _scorer(model, docs.schema[id_col].dataType.simpleString())
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    return out.select(
        F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op7_toxicity(spark, sf_dir):
    """The toxicity of every document, learnt from the labels outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model)
