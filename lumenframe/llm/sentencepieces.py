"""SentencePiece encoding and decoding by vectorised merge rounds.

The texts of a slice are one array of code points. It is cut wherever no piece of the model holds the two characters
beside each other: no merge crosses such a place, so that the stretches between are words of their own, and equal
words are encoded once. The symbols of all words lie in one flat array. A round looks up the rank of each pair, takes the
least of each word, joins all its pairs of that rank at once, from the left and without overlaps, and compacts the
array; words without a pair leave it. Joining at once is what a queue does one by one as long as no new pair comes
before those that are left; a word where one would is finished by such a queue.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lumenframe.llm.common import extended, flat_bytes, slices

SPACE = "▁"
#: Text bytes that are encoded at once.
SLICE_BYTES = 4 << 20
_NONE = np.int32(2**31 - 1)


def read_model(path: str) -> bytes:
    """A model file; it lies on the driver, which sends it along."""
    with open(path, "rb") as f:
        return f.read()


class Codec:
    """A BPE model of the sentencepiece library as arrays; a model that needs more than they hold is refused."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.check(model)
        n = sp.get_piece_size()
        self.n = n
        names = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i))]
        if any(sp.is_unused(i) for i in range(n)):
            raise ValueError("a model with unused pieces is not supported")
        self.byte_id = np.zeros(256, dtype=np.int32)
        self.byte_of = np.full(n, -1, dtype=np.int32)
        for i in range(n):
            if sp.is_byte(i):
                self.byte_id[int(names[i][3:5], 16)] = i
                self.byte_of[i] = int(names[i][3:5], 16)
        # a symbol is a piece's id, or n + code point of a character that is no piece
        self.symbol = np.arange(0x110000, dtype=np.int64) + n
        of = {names[i]: i for i in plain}
        for p, i in of.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        whole = [p for p in of if len(p) > 1]
        score = np.array([sp.get_score(of[p]) for p in whole])
        _, rank = np.unique(-score, return_inverse=True)
        self.width = np.int64(n + 0x110000)
        rows = []
        for p, r in zip(whole, rank.tolist(), strict=True):
            for k in range(1, len(p)):
                a, b = (of.get(x, self.symbol[ord(x)] if len(x) == 1 else -1) for x in (p[:k], p[k:]))
                if a >= 0 and b >= 0:
                    rows.append((int(a) * int(self.width) + int(b), r, of[p]))
        rows.sort()
        self.pairs = np.array([x[0] for x in rows] or [-1], dtype=np.int64)
        self.ranks = np.array([x[1] for x in rows] or [_NONE], dtype=np.int32)
        self.merged = np.array([x[2] for x in rows] or [0], dtype=np.int32)
        # characters of pieces by number, 0 for all others, and which may stand beside each other
        letters = sorted({c for p in whole for c in p})
        self.letter = np.zeros(0x110000, dtype=np.int16 if len(letters) < 1 << 15 else np.int32)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.beside = np.zeros((len(letters) + 1, len(letters) + 1), dtype=bool)
        beside = {(a, b) for p in whole for a, b in zip(p, p[1:], strict=False)}
        for a, b in beside:
            self.beside[self.letter[ord(a)], self.letter[ord(b)]] = True
        # what ids decode to: bytes of all ids end to end
        unknown = sp.decode([sp.unk_id()]) if sp.unk_id() >= 0 else ""
        shown = [bytes([self.byte_of[i]]) if self.byte_of[i] >= 0 else b"" if sp.is_control(i) else unknown.encode() if sp.is_unknown(i) else names[i].replace(SPACE, " ").encode() for i in range(n)]
        self.special = np.array([sp.is_control(i) or sp.is_unknown(i) for i in range(n)])
        self.spaced = np.array([names[i].startswith(SPACE) and not self.special[i] for i in range(n)])
        self.shown = np.frombuffer(b"".join(shown), dtype=np.uint8)
        self.shown_at = np.concatenate(([0], np.cumsum([len(x) for x in shown])))
        self.decimal = [str(i) for i in range(n)]

    @staticmethod
    def check(model: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2 as proto

        m = proto.ModelProto()
        m.ParseFromString(model)
        normal, trainer = m.normalizer_spec, m.trainer_spec
        if trainer.model_type != proto.TrainerSpec.BPE or not trainer.byte_fallback or trainer.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with byte fallback and white space as prefix are supported")
        if normal.precompiled_charsmap or normal.remove_extra_whitespaces or not normal.add_dummy_prefix or not normal.escape_whitespaces:
            raise ValueError("only models that leave texts as they are, but for a leading space, are supported")
        if any(p.type == proto.ModelProto.SentencePiece.USER_DEFINED for p in m.pieces):
            raise ValueError("user-defined pieces are not supported")

    def look_up(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank of each pair, _NONE if it is none, and its place in ``merged``."""
        key = a * self.width + b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], _NONE), at

    def words(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte offsets of the words of rows (their ends last), and how many words come before each row and after the last."""
        if not len(data):
            return np.zeros(1, np.int64), np.zeros(len(off), np.int64)
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype="<u4")
        begin = np.flatnonzero((data & 0xC0) != 0x80)
        kind = self.letter[points]
        cut = np.ones(len(points), dtype=bool)
        cut[1:] = ~self.beside[kind[:-1], kind[1:]]
        first = np.searchsorted(begin, off)
        cut[first[first < len(points)]] = True
        at = begin[cut]
        return np.concatenate((at, [len(data)])), np.searchsorted(at, off)

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words end to end, and where each word's begin and the last's end."""
        data, off = flat_bytes(words)
        n = len(words)
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype="<u4")
        sizes = np.diff(np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[off])
        sym, of = self.symbol[points], np.repeat(np.arange(n), sizes)
        done_sym, done_of = [], []
        rank, at = self._pair_ranks(sym, of)
        while len(sym):
            start = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            least = np.minimum.reduceat(rank, start)
            size = np.diff(np.concatenate((start, [len(sym)])))
            live = np.repeat(least != _NONE, size)
            if not live.all():
                done_sym.append(sym[~live])
                done_of.append(of[~live])
                sym, of, rank, at = sym[live], of[live], rank[live], at[live]
                size, least = size[least != _NONE], least[least != _NONE]
                if not len(sym):
                    break
            hit = rank == np.repeat(least, size)
            # of neighbouring hits every other one, from the left
            place = np.flatnonzero(hit)
            run = np.maximum.accumulate(np.where(np.concatenate(([True], np.diff(place) > 1)), np.arange(len(place)), 0))
            left = place[(np.arange(len(place)) - run) % 2 == 0]
            new_sym = sym.copy()
            new_sym[left] = self.merged[at[left]]
            keep = np.ones(len(sym), dtype=bool)
            keep[left + 1] = False
            new_sym, new_of, new_rank, new_at = new_sym[keep], of[keep], rank[keep], at[keep]
            moved = left - np.arange(len(left))  # the joined symbols' places now
            self._renew(new_sym, new_of, new_rank, new_at, moved)
            # a new pair that would come before hits that are left
            word = new_of[moved]
            many = np.concatenate((word[1:] == word[:-1], [False])) | np.concatenate(([False], word[1:] == word[:-1]))
            if many.any():
                before = np.maximum(moved - 1, 0)
                r = rank[left]
                early = many & ((new_rank[moved] <= r) | ((moved > 0) & (new_of[before] == word) & (new_rank[before] <= r)))
                if early.any():
                    odd = np.unique(word[early])
                    is_odd = np.isin(of, odd)
                    cuts = np.flatnonzero(np.diff(of[is_odd])) + 1
                    for w, s in zip(odd.tolist(), np.split(sym[is_odd], cuts), strict=True):
                        ids = self.queue(s.tolist())
                        done_sym.append(np.array(ids, dtype=np.int64))
                        done_of.append(np.full(len(ids), w))
                    rest = ~np.isin(new_of, odd)
                    new_sym, new_of, new_rank, new_at = new_sym[rest], new_of[rest], new_rank[rest], new_at[rest]
            sym, of, rank, at = new_sym, new_of, new_rank, new_at
        sym = np.concatenate(done_sym) if done_sym else np.zeros(0, np.int64)
        of = np.concatenate(done_of) if done_of else np.zeros(0, np.int64)
        order = np.argsort(of, kind="stable")
        return self._bytes_for_rest(sym[order], of[order], n)

    def _pair_ranks(self, sym: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, at = np.full(len(sym), _NONE, dtype=np.int32), np.zeros(len(sym), dtype=np.int64)
        inner = np.flatnonzero(of[1:] == of[:-1])
        rank[inner], at[inner] = self.look_up(sym[inner], sym[inner + 1])
        return rank, at

    def _renew(self, sym: np.ndarray, of: np.ndarray, rank: np.ndarray, at: np.ndarray, moved: np.ndarray) -> None:
        """The pairs on both sides of the symbols at ``moved``, in place."""
        flags = np.zeros(len(sym) + 1, dtype=bool)  # the last is for what stands before the first
        flags[moved] = flags[moved - 1] = True
        changed = np.flatnonzero(flags[:-1])
        last = changed == len(sym) - 1
        rank[changed[last]] = _NONE
        changed = changed[~last]
        inside = of[changed] == of[changed + 1]
        rank[changed[~inside]] = _NONE
        changed = changed[inside]
        rank[changed], at[changed] = self.look_up(sym[changed], sym[changed + 1])

    def queue(self, sym: list[int]) -> list[int]:
        """One word, one merge at a time: the least rank first, of these the leftmost."""
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        pairs = self.pairs_dict()
        heap = [(pairs[k][0], i, sym[i], sym[i + 1]) for i in range(n - 1) if (k := (sym[i], sym[i + 1])) in pairs]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or sym[i] != a or sym[j] != b:
                continue
            sym[i] = pairs[a, b][1]
            alive[j] = False
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (k := (sym[x], sym[y])) in pairs:
                    heapq.heappush(heap, (pairs[k][0], x, *k))
        return [s for s, live in zip(sym, alive, strict=True) if live]

    def pairs_dict(self) -> dict[tuple[int, int], tuple[int, int]]:
        if not hasattr(self, "_pairs_dict"):
            w = int(self.width)
            self._pairs_dict = {(k // w, k % w): (r, m) for k, r, m in zip(self.pairs.tolist(), self.ranks.tolist(), self.merged.tolist(), strict=True)}
        return self._pairs_dict

    def _bytes_for_rest(self, sym: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbols that are no pieces as the ids of their bytes."""
        other = sym >= self.n
        if other.any():
            points = (sym[other] - self.n).astype("<u4")
            raw = np.frombuffer(points.tobytes().decode("utf-32-le").encode(), dtype=np.uint8)
            lengths = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
            times = np.ones(len(sym), dtype=np.int64)
            times[other] = lengths
            expanded = np.repeat(other, times)
            sym, of = np.repeat(sym, times), np.repeat(of, times)
            sym[expanded] = self.byte_id[raw]
        return sym.astype(np.int32), np.concatenate(([0], np.cumsum(np.bincount(of, minlength=n)))).astype(np.int64)

    def decode(self, ids: list[int]) -> str:
        """Any ids: controls show nothing, bytes that are no UTF-8 the replacement character each, and a leading space goes."""
        out, run, first = [], bytearray(), True

        def flush() -> None:
            while run:
                for k in range(1, 5):
                    try:
                        out.append(bytes(run[:k]).decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    k = 1
                    out.append("�")
                del run[:k]

        for i in ids:
            if self.byte_of[i] >= 0:
                run.append(self.byte_of[i])
                continue
            flush()
            piece = self.shown[self.shown_at[i] : self.shown_at[i + 1]].tobytes().decode()
            if first and not out and self.spaced[i]:
                piece, first = piece[1:], False
            if piece:
                out.append(piece)
        flush()
        return "".join(out)


def take(data: np.ndarray, off: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows' stretches of data end to end, and the offsets of these."""
    size = (off[1:] - off[:-1])[rows]
    to = np.concatenate(([0], np.cumsum(size)))
    return data[np.repeat(off[rows] - to[:-1], size) + np.arange(to[-1])], to


_CODECS: dict[bytes, Codec] = {}


def codec(shared) -> Codec:
    key = hashlib.sha256(shared.value).digest()
    if key not in _CODECS:
        _CODECS[key] = Codec(shared.value)
    return _CODECS[key]


def encode_texts(c: Codec, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all texts end to end with the rows' offsets, and the bytes that they decode to with theirs; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    empty = np.asarray(pc.equal(pc.binary_length(texts), 0))
    marked = pc.replace_substring(texts, " ", SPACE)
    prefix = pa.array(np.where(empty, "", SPACE).tolist(), pa.large_string())
    data, off = flat_bytes(pc.binary_join_element_wise(prefix, marked, pa.scalar("", pa.large_string())))
    bounds, before = c.words(data, off)
    words = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
    which = np.asarray(words.indices).astype(np.int64)
    ids, at = c.encode_words(words.dictionary)
    shown, shown_at = take(c.shown, c.shown_at, ids)
    all_ids, word_ends = take(ids, at, which)
    all_shown, shown_ends = take(shown, shown_at[at], which)
    return all_ids, word_ends[before], all_shown, shown_ends[before]


def encode_decode(docs: DataFrame, model: bytes, *, text_col: str = "text", digests: bool = False) -> DataFrame:
    """``docs`` with n_tokens, ids (little-endian unsigned 32-bit) and decoded, what the ids decode to.

    model: what ``read_model`` returns; a fixed file of at most a few MB, broadcast. No begin or end ids. A null or empty
    text has no ids; repeated rows stay as they are; columns of docs named like a result are replaced. ``digests``: SHA-256
    in hexadecimal, of decimal ids joined by commas and of the decoded text, in place of the columns themselves.
    """
    Codec.check(model)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["n_tokens", "ids", "decoded"]
    kept = docs.drop(*names)
    kind = "string" if digests else "binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared)
        for batch in batches:
            for part in slices(batch, text_col, SLICE_BYTES):
                ids, at, shown, shown_at = encode_texts(c, part.column(text_col))
                n = part.num_rows
                out_ids, out_shown = [], []
                for k in range(n):
                    own, text = ids[at[k] : at[k + 1]], shown[shown_at[k] : shown_at[k + 1]].tobytes()
                    text = text[1:] if text[:1] == b" " else text
                    out_ids.append(hashlib.sha256(",".join(map(c.decimal.__getitem__, own.tolist())).encode()).hexdigest() if digests else own.astype("<u4").tobytes())
                    out_shown.append(hashlib.sha256(text).hexdigest() if digests else text.decode())
                columns = [pa.array(np.diff(at), pa.int64()), pa.array(out_ids, pa.string() if digests else pa.binary()), pa.array(out_shown, pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*part.schema.names, *names])

    return kept.mapInArrow(run, extended(kept.schema, f"n_tokens long, {names[1]} {kind}, {names[2]} string"))


def decode_ids(ids: DataFrame, model: bytes, *, ids_col: str = "ids") -> DataFrame:
    """``ids`` with a column decoded: the text of little-endian unsigned 32-bit ids; null ids: the empty text."""
    shared = ids.sparkSession.sparkContext.broadcast(model)
    kept = ids.drop("decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared)
        for batch in batches:
            texts = [c.decode(np.frombuffer(x or b"", "<u4").tolist()) for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return kept.mapInArrow(run, extended(kept.schema, "decoded string"))
