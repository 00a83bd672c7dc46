"""BPE encoding and decoding by tree concatenation.

A text is a row of unsplit pieces: the vocabulary's own splitter never joins across white space, so each piece is encoded
alone, and words that come again are looked up. Every piece is a binary tree of leaves of a few bytes, whose halves are
encoded and joined. Up to LEAF_BYTES a task does that by itself; of longer pieces Spark encodes stretches of that length
as separate rows, each such a tree, and joins two neighbours a round.
At a join a window of tokens on both sides is encoded again, growing until its first token agrees with the
one before it and its last with the one after it: a sequence whose every adjacent pair of tokens is what
the merges make of that pair's own text is what they make of the whole.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import extended, fresh, slices, stored

#: Unsplit characters that one task encodes at once, and those of a leaf of its tree.
LEAF_BYTES, TWIG = 4096, 16
#: Distinct words whose ids a task remembers.
MEMORY_WORDS = 250_000


def check(vocabulary: str) -> None:
    """Refuses what the codec would not carry out as the library does."""
    spec = json.loads(vocabulary)
    model, added = spec["model"], spec.get("added_tokens") or []
    wrong = [name for name in ("unk_token", "continuing_subword_prefix", "dropout", "byte_fallback", "ignore_merges", "fuse_unk") if model.get(name)]
    wrong += [f"added token {x['content']} {name}" for x in added for name in ("single_word", "lstrip", "rstrip", "normalized") if x.get(name)]
    wrong += [name for name in ("decoder",) if spec.get(name)]
    if model.get("type", "BPE") != "BPE" or not spec.get("pre_tokenizer"):
        wrong.append("a model other than BPE, or no splitter")
    if wrong:
        raise ValueError(f"a vocabulary with {', '.join(wrong)} is not supported")


class Codec:
    """A vocabulary file of the tokenizers library, with the parts that trees need."""

    def __init__(self, vocabulary: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models

        check(vocabulary)
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(vocabulary)
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.special_bytes = [x.encode() for x in self.special]
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.names = {i: t for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.last = models.BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=self.suffix or None)
        self.inner = models.BPE(vocab=model["vocab"], merges=merges)
        self.known: dict[bytes, bytes] = {}
        # what ids decode to, each with the blank that follows it
        shown = [self.names.get(i, "").encode() + b" " for i in range(max(self.names) + 1)]
        self.shown, self.shown_at = np.frombuffer(b"".join(shown), dtype=np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in shown])))

    def words(self, words: list[bytes]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers of each word without white space."""
        known = self.known
        new = list({w for w in words if w not in known})  # those of many texts at once
        if new:
            if len(known) + len(new) > MEMORY_WORDS:
                known.clear()
                new = list(set(words))
            for w, pieces in self.split(new):
                ids = [i for piece, i in pieces for i in ([i] if i >= 0 else self.leaf(piece, True) if len(piece) <= TWIG else self.tree(piece))]
                known[w] = struct.pack(f"<{len(ids)}I", *ids)
        return [known[w] for w in words]

    def split(self, words: list[bytes]) -> Iterator[tuple[bytes, Iterable[tuple[str, int]]]]:
        """Each word with its pieces. The splitter takes the plain ones as one text: it never joins across white space, which they have none of."""
        plain = [w for w in words if not any(x in w for x in self.special_bytes)]
        done = set()
        # apart, as the length of other letters may change; a group where one does goes word by word
        for group in ([w for w in plain if w.isascii()], [w for w in plain if not w.isascii()]):
            texts = [w.decode() for w in group]
            text = " ".join(texts)
            normal = self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text
            ends = np.cumsum([len(w) + 1 for w in texts])
            if not group or len(text.split()) != len(group) or len(normal) != len(text) or any(normal[k - 1] != " " for k in ends[:-1].tolist()):
                continue
            of: list[list[tuple[str, int]]] = [[] for _ in group]
            found = self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)
            for (piece, _), k in zip(found, np.searchsorted(ends, [at[0] for _, at in found], side="right").tolist(), strict=True):
                of[k].append((piece, -1))
            yield from zip(group, of, strict=True)
            done.update(group)
        for w in words:
            if w not in done:
                yield w, self.pieces(w.decode())

    def decoded(self, ids: list[bytes]) -> list[bytes]:
        """What each row of ids decodes to: their names with blanks between."""
        flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int64)
        at, size = self.shown_at[flat], np.diff(self.shown_at)[flat]
        to = np.concatenate(([0], np.cumsum(size)))
        data = self.shown[np.repeat(at - to[:-1], size) + np.arange(to[-1])].tobytes()
        bounds = to[np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids])))].tolist()
        return [data[a : max(a, b - 1)] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def pieces(self, text: str) -> Iterator[tuple[str, int]]:
        """The splitter's pieces in the byte alphabet, with -1, or a special token's text and id."""
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                yield part, self.special[part]
            elif part:
                normal = self.tokenizer.normalizer.normalize_str(part) if self.tokenizer.normalizer else part
                for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal):
                    yield piece, -1

    def leaf(self, piece: str, last: bool) -> list[int]:
        return [t.id for t in (self.last if last else self.inner).tokenize(piece)]

    def text(self, ids: list[int], last: bool) -> str:
        s = "".join(map(self.names.__getitem__, ids))
        return s[: len(s) - len(self.suffix)] if last and self.suffix else s

    def join(self, left: list[int], right: list[int], last: bool) -> list[int]:
        """What the merges make of both sides' text; ``last``: the right side ends the piece."""
        if not left or not right:
            return left + right
        k = 1
        while True:
            a, b = max(0, len(left) - k), min(len(right), k)
            end = last and b == len(right)
            window = self.leaf(self.text(left[a:], False) + self.text(right[:b], end), end)
            ok_left = a == 0 or self._pair(left[a - 1], window[0], end and len(window) == 1)
            ok_right = b == len(right) or self._pair(window[-1], right[b], last and b + 1 == len(right))
            if ok_left and ok_right:
                return left[:a] + window + right[b:]
            k *= 2

    def _pair(self, x: int, y: int, last: bool) -> bool:
        return self.leaf(self.text([x], False) + self.text([y], last), last) == [x, y]

    def tree(self, piece: str, last: bool = True, twig: int = TWIG) -> list[int]:
        """A piece, or a stretch of one that is not its ``last``, as a tree within one process."""
        if len(piece) <= twig:
            return self.leaf(piece, last)
        half = len(piece) // 2
        return self.join(self.tree(piece[:half], False, twig), self.tree(piece[half:], last, twig), last)


def read_vocabulary(path: str) -> str:
    """A vocabulary file; it lies on the driver, which sends it along."""
    with open(path, encoding="utf-8") as f:
        return f.read()


_CODECS: dict[str, Codec] = {}


def codec(shared) -> Codec:
    if shared.value not in _CODECS:
        _CODECS[shared.value] = Codec(shared.value)
    return _CODECS[shared.value]


def encode_decode(docs: DataFrame, vocabulary: str, *, text_col: str = "text", leaf: int = LEAF_BYTES, digests: bool = False) -> DataFrame:
    """``docs`` with n_tokens, ids (little-endian unsigned 32-bit) and decoded, what the ids decode to.

    vocabulary: what ``read_vocabulary`` returns; a fixed file of at most a few MB, broadcast. A null text is
    empty; repeated rows stay as they are; columns of docs named like a result are replaced. ``digests``: SHA-256 of
    both in hexadecimal, ids_sha256 and decoded_sha256, in place of the columns themselves.
    """
    check(vocabulary)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)
    names = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["n_tokens", "ids", "decoded"]
    kept = docs.drop(*names)
    given = kept.columns
    schema = extended(kept.schema, f"n_tokens long, {names[1]} {'string' if digests else 'binary'}, {names[2]} string")
    text = F.coalesce(F.col(text_col), F.lit(""))
    # only texts of that length are searched
    long = (F.char_length(text) >= leaf) & text.rlike(rf"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]{{{leaf}}}")
    row, parts_of = fresh(given, "_row"), fresh(given, "_ids")

    def finish(table: pa.Table | pa.RecordBatch, counts, ids, decoded) -> pa.RecordBatch:
        if digests:
            ids, decoded = [hashlib.sha256(x).hexdigest() for x in ids], [hashlib.sha256(x).hexdigest() for x in decoded]
        else:
            decoded = [x.decode() for x in decoded]
        return pa.RecordBatch.from_arrays([*table.columns, pa.array(counts, pa.int64()), pa.array(ids, pa.string() if digests else pa.binary()), pa.array(decoded, pa.string())], names=[*table.schema.names, *names])

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared)
        for batch in batches:
            for part in slices(batch, text_col):
                texts = [(text or "").encode().split() for text in part.column(text_col).to_pylist()]
                found = iter(c.words([w for text in texts for w in text]))
                ids = [b"".join(islice(found, len(text))) for text in texts]
                yield finish(part, [len(x) // 4 for x in ids], ids, c.decoded(ids))
        c.known.clear()  # the worker goes on to other tasks

    rest = kept.filter(~long).mapInArrow(short, schema)
    keyed = stored(kept.filter(long).withColumn(row, F.monotonically_increasing_id()))
    if keyed.isEmpty():
        return rest
    import pandas as pd  # for long texts only: it would stay in the driver's memory

    text_of = keyed.select(F.col(row).alias("_row"), F.col(text_col).alias("_text"))

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(shared)
        for frame in frames:
            for row, text in zip(frame["_row"], frame["_text"], strict=True):
                out = []
                for part, (piece, known) in enumerate(c.pieces(text)):
                    n = max(1, -(-len(piece) // leaf))
                    if known >= 0:
                        out.append((row, part, 0, 1, None, np.array([known], "<u4").tobytes()))
                    else:
                        out += [(row, part, i, n, piece[i * leaf : (i + 1) * leaf], None) for i in range(n)]
                    if len(out) >= 2000:
                        yield pd.DataFrame(out, columns=["_row", "part", "node", "nodes", "piece", "ids"])
                        out = []
                if out:
                    yield pd.DataFrame(out, columns=["_row", "part", "node", "nodes", "piece", "ids"])

    def leaves(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(shared)
        for frame in frames:
            frame["ids"] = [i if p is None else np.array(c.tree(p, k + 1 == n, min(TWIG, leaf)), "<u4").tobytes() for p, k, n, i in zip(frame["piece"], frame["node"], frame["nodes"], frame["ids"], strict=True)]
            yield frame.drop(columns="piece")

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("node")
        head = frame.iloc[0]
        sides = [np.frombuffer(x, "<u4").tolist() for x in frame["ids"]]
        ids = codec(shared).join(sides[0], sides[1], head["node"] + 2 >= head["nodes"]) if len(sides) == 2 else sides[0]
        return pd.DataFrame([(head["_row"], head["part"], head["node"] // 2, -(-head["nodes"] // 2), np.array(ids, "<u4").tobytes())], columns=["_row", "part", "node", "nodes", "ids"])

    node = "_row long, part long, node long, nodes long, "
    tree = stored(text_of.mapInPandas(split, node + "piece string, ids binary").repartition("_row", "part", "node").mapInPandas(leaves, node + "ids binary"))
    done = tree.filter("nodes = 1")
    for _ in range(max(0, int(tree.agg(F.max("nodes")).first()[0] or 1) - 1).bit_length()):
        tree = stored(tree.filter("nodes > 1").groupBy("_row", "part", F.expr("node div 2").alias("_pair")).applyInPandas(lambda f: merge(f), node + "ids binary"))
        done = done.unionByName(tree.filter("nodes = 1"))
    gathered = done.groupBy(F.col("_row").alias(row)).agg(F.expr("transform(array_sort(collect_list(struct(part, ids))), x -> x.ids)").alias(parts_of))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared)
        for batch in batches:
            ids = [b"".join(x or []) for x in batch.column(parts_of).to_pylist()]
            decoded = [" ".join(map(c.names.__getitem__, np.frombuffer(x, "<u4").tolist())).encode() for x in ids]
            yield finish(batch.select(given), [len(x) // 4 for x in ids], ids, decoded)

    return rest.unionByName(keyed.join(gathered, row, "left").drop(row).mapInArrow(decode, schema))


def decode_ids(ids: DataFrame, vocabulary: str, *, ids_col: str = "ids") -> DataFrame:
    """``ids`` with a column decoded: the text of little-endian unsigned 32-bit ids; null ids: the empty text."""
    shared = ids.sparkSession.sparkContext.broadcast(vocabulary)
    kept = ids.drop("decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared)
        for batch in batches:
            texts = [c.tokenizer.decode(np.frombuffer(x or b"", "<u4").tolist(), skip_special_tokens=False) for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return kept.mapInArrow(run, extended(kept.schema, "decoded string"))
