"""Language identification as a mixture of languages.

Letter trigrams, hashed, are counted for each language over all labelled training texts. A document is a mixture of
languages: expectation-maximisation estimates its proportions from the trigrams' likelihoods. Languages are taken
out, the weakest first, while the penalised likelihood (half a logarithm of the trigrams a language) does not
fall; what remains is the document's language set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import extended, flat_bytes, lower_ascii, mix64, slices

#: Hashed trigrams; a language's model is this many 4-byte floats.
BUCKETS = 1 << 16
UNDETERMINED = "und"

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(97, 123), *range(128, 256)]] = True


def trigrams(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every trigram with a letter; white space, digits and marks count as one blank each."""
    data, off = flat_bytes(text)
    low = lower_ascii(data)
    low = np.where(_LETTER[low], low, np.uint8(32))
    n = np.diff(off)
    row = np.repeat(np.arange(len(n), dtype=np.int32), n + 2)
    padded = np.full(len(row), 32, dtype=np.uint8)
    padded[np.arange(len(low)) + 2 * np.repeat(np.arange(len(n)), n) + 1] = low
    x = padded.astype(np.uint32)
    if len(x) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    code = (x[:-2] << 16) | (x[1:-1] << 8) | x[2:]
    good = (row[:-2] == row[2:]) & (code != 0x202020)
    code = code[good]
    bucket = ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)
    return bucket, row[:-2][good]


def learn(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages, sorted, and their trigram probabilities, from all rows with a text and a language.

    Each task adds up what it reads; what reaches the driver is BUCKETS counts a language at most.
    """
    known = docs.select(F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang")).dropna()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "_text"):
                bucket, row = trigrams(part.column("_text"))
                langs = part.column("_lang").dictionary_encode()
                code = langs.indices.to_numpy(zero_copy_only=False)
                sums = np.bincount(code[row] * BUCKETS + bucket, minlength=len(langs.dictionary) * BUCKETS)
                for i, lang in enumerate(langs.dictionary.to_pylist()):
                    totals[lang] = totals.get(lang, 0) + sums[i * BUCKETS : (i + 1) * BUCKETS]
        for lang, sums in totals.items():
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) or 1)), pa.array(at if len(at) else [0], pa.int32()), pa.array(sums[at] if len(at) else [0], pa.int64())], names=["lang", "bucket", "n"])

    rows = known.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(rows["lang"].unique().tolist())
    counts = np.zeros((len(langs), BUCKETS))
    counts[rows["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(dtype=int), rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return langs, ((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)).astype(np.float32)


def _mixture(p: list[np.ndarray], n: np.ndarray, starts: np.ndarray, row: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions after some rounds of expectation-maximisation, and the log likelihood before the last."""
    total = np.add.reduceat(n, starts)
    likely = None
    for _ in range(rounds):
        parts = [p[k] * share[k][row] for k in range(len(p))]
        whole = parts[0].copy()
        for x in parts[1:]:
            whole += x
        np.maximum(whole, 1e-30, out=whole)
        scale = n / whole
        likely = np.add.reduceat(n * np.log(whole), starts)
        share = np.stack([np.add.reduceat(x * scale, starts) / total for x in parts])
    return share, likely


def proportions(text: pa.Array, model: np.ndarray, *, rounds: int = 6, penalty: float = 0.5) -> np.ndarray:
    """A row for each text: the proportion of each language; zeros where there is no trigram."""
    out = np.zeros((len(text), len(model)))
    bucket, row = trigrams(text)
    if not len(bucket) or not len(model):
        return out
    key, n = np.unique(row.astype(np.int64) * BUCKETS + bucket, return_counts=True)
    n, rows = n.astype(np.float32), key // BUCKETS
    starts = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
    docs, row = rows[starts], np.repeat(np.arange(len(starts)), np.diff(np.concatenate((starts, [len(rows)]))))
    p = [m[key % BUCKETS] for m in model]
    share = np.full((len(model), len(starts)), 1 / len(model), dtype=np.float32)
    share, best = _mixture(p, n, starts, row, share.astype(np.float32), rounds)
    charge = penalty * np.log(np.maximum(np.add.reduceat(n, starts), 2))
    best = best - charge * ((share > 0).sum(axis=0) - 1)
    active = np.ones(len(starts), dtype=bool)  # documents whose set may still shrink
    final = share
    for _ in range(len(model) - 1):
        left = np.flatnonzero(active & ((final > 0).sum(axis=0) > 1))
        if not len(left):
            break
        weakest = np.where(final > 0, final, np.inf).argmin(axis=0)
        less = final[:, left].copy()
        less[weakest[left], np.arange(len(left))] = 0
        less /= less.sum(axis=0)
        pick = np.zeros(len(starts), dtype=bool)
        pick[left] = True
        inside = pick[row]
        at = np.cumsum(pick) - 1
        sub = at[row[inside]]
        sub_starts = np.flatnonzero(np.concatenate(([True], sub[1:] != sub[:-1])))
        got, likely = _mixture([x[inside] for x in p], n[inside], sub_starts, sub, less.astype(np.float32), 2)
        likely = likely - charge[left] * ((got > 0).sum(axis=0) - 1)
        better = likely >= best[left]
        final[:, left[better]] = got[:, better]
        best[left[better]] = likely[better]
        active[left[~better]] = False
    out[docs] = final.T
    return out


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], *, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (its proportion) and langs, the proportions of the language set by language.

    A null text, one without a letter, and any text if the model knows no language are ``und``, score 0.
    Ties go to the first language by name. Repeated rows stay; columns of docs so named are replaced.
    """
    names = ["lang_pred", "score", "langs"]
    kept = docs.drop(*names)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = extended(kept.schema, "lang_pred string, score double, langs map<string,double>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, probabilities = shared.value
        for batch in batches:
            for part in slices(batch, text_col):
                text = part.column(text_col)
                found = proportions(text, probabilities)
                pred, score, sets = [], [], []
                for t, share in zip(text, found, strict=True):
                    t = t.as_py()
                    if not langs or t is None or not any(map(str.isalpha, t)) or not share.any():
                        pred.append(UNDETERMINED)
                        score.append(0.0)
                        sets.append([])
                        continue
                    k = int(share.argmax())
                    pred.append(langs[k])
                    score.append(min(1.0, float(share[k])))
                    sets.append([(langs[i], float(share[i])) for i in np.flatnonzero(share)])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.map_(pa.string(), pa.float64()))], names=[*part.schema.names, *names])

    return kept.mapInArrow(run, schema)
