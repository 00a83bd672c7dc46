"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence gets a logistic score from hashed words and word beginnings;
noisy-or joins them: a document is toxic unless every sentence is clean. The sentence weights are fitted to the
documents' labels through that noisy-or, so that the fitted sentences tell where the offence is. A sentence counts by
what it exceeds a learned floor by, so that many neutral ones do not add up to an offence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.common import dropped, extended, flat_bytes, lower_ascii, runs, slices, span_hashes, stored

#: Hashed features; the fitted weights are this many 4-byte floats, whatever the input.
BUCKETS = 1 << 20
#: Labelled documents of each class that the fit takes at most.
TRAIN_PER_CLASS = 4000
#: Bytes of a word's beginning that are features beside the whole word.
BEGINNINGS = (4, 5, 6)
#: What all sentences under the floor can give a document together.
REST = 0.1

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[0x0A, 0x0D, *b".!?"]] = True


def sentences(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows end to end: sentence starts, sentence ends, each sentence's row, word starts, word ends."""
    starts, ends = runs(~_STOP[data], off)
    rows = np.searchsorted(off, starts, side="right") - 1
    w0, w1 = runs(_LETTER[data], off)
    return starts, ends, rows, w0, w1


def features(data: np.ndarray, w0: np.ndarray, w1: np.ndarray) -> np.ndarray:
    """Feature numbers, a row for each word; beginnings that a word is too short for repeat the word."""
    low = lower_ascii(data)
    out = [span_hashes(low, w0, w1)]
    for n in BEGINNINGS:
        out.append(np.where(w1 - w0 > n, span_hashes(low, w0, np.minimum(w0 + n, w1)) * np.uint64(2 * n + 1), out[0]))
    return (np.stack(out, axis=1) & np.uint64(BUCKETS - 1)).astype(np.int32)


def _rise(z: np.ndarray, floor: float) -> np.ndarray:
    """log of how much less likely a sentence is clean than one at the floor; 0 at the floor and below."""
    return np.minimum(0.0, np.logaddexp(0, floor) - np.logaddexp(0, z))


def selected(seen: np.ndarray, size: np.ndarray, surely: float = 2.5) -> np.ndarray:
    """Log odds of each feature, 0 unless toxic documents hold it more often by ``surely`` standard errors.

    seen: for clean and toxic documents, how many hold each feature; size: how many documents there are of each.
    """
    size = size[:, None] + 1
    odds = np.log((seen + 0.5) / (size - seen + 0.5))
    odds = odds[1] - odds[0]
    return np.where((odds > surely * np.sqrt((1 / (seen + 0.5)).sum(axis=0))) & (seen.sum(axis=0) >= 3), odds, 0.0)


def fit(start: np.ndarray, label: np.ndarray, per_doc: np.ndarray, sent: np.ndarray, feat: np.ndarray, *, rounds: int = 60, rate: float = 0.1, shrink: float = 1e-4, quiet: float = 0.999) -> tuple[np.ndarray, float, float]:
    """Weights of the features, bias and floor.

    start: the weights to begin with; label and number of sentences of each document; sentence and feature of each
    occurrence. A sentence counts by how far it rises over one without features, so that neutral ones never add up. The
    floor is then set so high that of the clean documents' sentences a share of ``quiet`` lies under it, -1 at most.
    """
    w, bias = start.copy(), -4.0
    n = int(per_doc.sum())
    if not len(w) or not n or not 0 < label.sum() < len(label):
        return w, bias, bias
    per_doc, label = per_doc[per_doc > 0], label[per_doc > 0].astype(np.float64)
    doc_start = np.concatenate(([0], np.cumsum(per_doc)[:-1]))
    doc_of = np.repeat(np.arange(len(per_doc)), per_doc)
    m, v, b, mb, vb = np.zeros(len(w)), np.zeros(len(w)), bias, 0.0, 0.0
    balance = np.where(label == 1, 0.5 / max(1, label.sum()), 0.5 / max(1, (1 - label).sum()))
    for t in range(1, rounds + 1):
        z = np.clip(b + np.bincount(sent, weights=w[feat], minlength=n), -30, 30)
        clean = np.exp(np.add.reduceat(_rise(z, b), doc_start))
        toxic = np.maximum(1 - clean, 1e-3)
        pull = balance * np.where(label == 1, -clean / toxic, 1.0)
        above = z > b
        p = above / (1 + np.exp(-z))
        g = pull[doc_of] * p
        gw = np.bincount(feat, weights=g[sent], minlength=len(w)) + shrink * w / len(w) ** 0.5
        gb = (pull[doc_of] * (p - above / (1 + np.exp(-b)))).sum()
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-5)
        b = min(-1.0, b - rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-5))
    z = b + np.bincount(sent, weights=w[feat], minlength=n)
    return w, float(b), float(min(-1.0, max(b, np.quantile(z[label[doc_of] == 0], quiet))))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = TRAIN_PER_CLASS) -> tuple[np.ndarray, float, float]:
    """The fitted weights, bias and floor.

    At most ``per_class`` documents of each label are used, those first by a hash of the id: a bounded sample.
    Rows with a null id or label do not count; of a document with several labels the highest counts. Without labels
    every text scores low. What the driver holds are the sample's counts by feature and its sentences' selected features.
    """
    one = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).dropna().groupBy("_id").agg((F.max("_label") > 0).cast("int").alias("_label"))
    clean, toxic = (one.filter(F.col("_label") == value).orderBy(F.xxhash64("_id"), "_id").limit(per_class) for value in (0, 1))
    held = clean.unionByName(toxic)
    sample = stored(docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(F.broadcast(held), "_id").select("_label", "_text"))
    width = 1 + len(BEGINNINGS)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Of each slice: labels, sentences of each text, sentence of each word, text of each word, word features."""
        for batch in batches:
            for part in slices(batch, "_text"):
                data, off = flat_bytes(part.column("_text"))
                s0, _, rows, w0, w1 = sentences(data, off)
                yield part.column("_label").to_numpy(), np.bincount(rows, minlength=part.num_rows), np.searchsorted(s0, w0, side="right") - 1, np.searchsorted(off, w0, side="right") - 1, features(data, w0, w1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for label, _, _, row, f in parts(batches):
            pairs = np.unique(np.repeat(row, width) * np.int64(BUCKETS) + f.reshape(-1))
            keys, n = np.unique(label[pairs // BUCKETS].astype(np.int64) * BUCKETS + pairs % BUCKETS, return_counts=True)
            keys, n = np.concatenate((keys, [-1, -2])), np.concatenate((n, [(label == 0).sum(), (label == 1).sum()]))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n, pa.int64())], names=["key", "n"])

    counts = sample.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter("n > 2 or key < 0").toArrow()  # without pandas, which would stay in the driver's memory
    key, n = counts.column("key").to_numpy(), counts.column("n").to_numpy()
    real = key >= 0
    # only features that are there take up memory
    there, at = np.unique(key[real] % BUCKETS, return_inverse=True)
    seen = np.zeros((2, len(there)))
    seen[key[real] // BUCKETS, at] = n[real]
    odds = selected(seen, np.array([n[key == -1].sum(), n[key == -2].sum()], dtype=np.float64))
    used, odds = there[odds != 0], odds[odds != 0]
    number = np.full(BUCKETS, -1, dtype=np.int32)
    number[used] = np.arange(len(used))
    del counts, key, n, real, there, at, seen
    shared = docs.sparkSession.sparkContext.broadcast(number)

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each slice: labels, sentences of each text, and sentence and feature of each selected occurrence."""
        for label, per_doc, sent, _, f in parts(batches):
            own = shared.value[f.reshape(-1)]
            at = np.repeat(sent, width)[own >= 0]
            yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.int32).tobytes()], pa.binary()) for x in (label, per_doc, at, own[own >= 0])], names=["label", "per_doc", "sent", "feat"])

    rows = sample.mapInArrow(bags, "label binary, per_doc binary, sent binary, feat binary").toLocalIterator()
    got = [[np.frombuffer(x, np.int32) for x in r] for r in rows]
    dropped(sample)
    before = np.cumsum([0, *(int(x[1].sum()) for x in got)])
    label, per_doc, sent, feat = (np.concatenate([np.zeros(0, np.int32), *(x[k] + (b if k == 2 else 0) for x, b in zip(got, before, strict=False))]) for k in range(4))
    del got
    w, bias, floor = fit(0.5 * odds, label, per_doc, sent, feat)
    weights = np.zeros(BUCKETS, dtype=np.float32)
    weights[used] = w
    return weights, bias, floor


def score(docs: DataFrame, model: tuple[np.ndarray, float, float], *, text_col: str = "text", spans: bool = True) -> DataFrame:
    """``docs`` with score, and, if ``spans``, offending: start, end (characters) and score of sentences at 0.5 or more.

    Sentences count by what they exceed the model's floor by; what lies under it adds up to REST at most, so length alone
    never makes a text toxic. A null or empty text has no sentence and scores 0. Repeated rows stay; columns of docs so named are replaced.
    """
    names = ["score", "offending"] if spans else ["score"]
    kept = docs.drop(*names)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = extended(kept.schema, "score double" + ", offending array<struct<start:bigint,end:bigint,score:double>>" * spans)
    struct = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias, floor = shared.value
        for batch in batches:
            for part in slices(batch, text_col):
                data, off = flat_bytes(part.column(text_col))
                s0, s1, rows, w0, w1 = sentences(data, off)
                z = np.full(len(s0), bias)
                if len(w0):
                    z += np.bincount(np.searchsorted(s0, w0, side="right") - 1, weights=weights[features(data, w0, w1)].sum(axis=1), minlength=len(s0))
                z = np.clip(z, -30, 30)
                p = 1 / (1 + np.exp(-z))
                clean = np.bincount(rows, weights=_rise(z, floor), minlength=part.num_rows)
                # what lies under the floor adds up to REST at most
                rest = np.bincount(rows, weights=1 / (1 + np.exp(-np.minimum(z, floor))), minlength=part.num_rows)
                clean += np.log1p(REST * np.expm1(-rest / REST))
                columns = [*part.columns, pa.array(-np.expm1(clean))]
                if spans:
                    bad = np.flatnonzero(p >= 0.5)
                    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                    out: list[list] = [[] for _ in range(part.num_rows)]
                    for i in bad:
                        row = rows[i]
                        out[row].append({"start": chars[s0[i]] - chars[off[row]], "end": chars[s1[i]] - chars[off[row]], "score": p[i]})
                    columns.append(pa.array(out, struct))
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, *names])

    return kept.mapInArrow(run, schema)


def detect(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, train_on, **names) -> DataFrame:
    """``docs`` scored by a model of the labelled rows for which ``train_on``, a condition on the id column, holds."""
    return score(docs, train(docs, labels.filter(train_on), **names))
