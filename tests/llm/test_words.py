"""The operators on pieces, phrases and words (11 to 13) against plain versions and the library."""

import itertools
import os
import random
import re
import sys
import zlib
from collections import Counter, defaultdict

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_llm import SF, got, none, odd, odd_rows, rows, want  # noqa: F401

from lumenframe.llm import phrases, queries, sentencepieces, variants


@pytest.fixture(scope="session")
def model():
    import public_tokenizers

    return sentencepieces.read_model(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="session")
def library(model):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def pieces(library, given):
    for i, text in given:
        ids = library.encode(text or "")
        yield i, len(ids), brute.sha(",".join(map(str, ids))), brute.sha(library.decode(ids))


def test_op11(spark, rows, odd, odd_rows, none, model, library):
    columns = "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"
    assert got(queries.op11_sentencepiece(spark, SF), *columns) == want(pieces(library, rows))
    assert got(sentencepieces.encode_decode(odd, model, digests=True), *columns) == want(pieces(library, odd_rows))
    clash = odd.withColumn("ids", F.lit("mine")).withColumn("_row", F.lit("r"))
    out = sentencepieces.encode_decode(clash, model)
    assert out.columns == [c for c in clash.columns if c != "ids"] + ["n_tokens", "ids", "decoded"]
    assert out.filter("_row = 'r' and score is not null").count() == odd.count()
    again = sentencepieces.decode_ids(out.select("ids", F.col("decoded").alias("was")), model)
    assert again.filter("not decoded <=> was").count() == 0
    assert sentencepieces.encode_decode(none, model).count() == 0
    assert sentencepieces.decode_ids(spark.createDataFrame([(None,)], "ids binary"), model).first()["decoded"] == ""


def test_op11_rounds(model, library):
    """Texts of pieces, of runs of spaces and letters, and of characters that are no pieces, as the library has them; ids of any kind decode alike."""
    c = sentencepieces.Codec(model)
    draw = random.Random(11)
    names = [library.id_to_piece(i).replace("▁", " ") for i in range(c.n)]
    texts = ["".join(draw.choice(names) for _ in range(draw.randint(0, 30))) for _ in range(2000)]
    texts += ["".join(draw.choice("ab cdeERN  ▁\n\t.,01é日本😀tion\x00") for _ in range(draw.randint(0, 60))) for _ in range(2000)]
    texts += ["", " ", None, "▁", " " * 16, " " * 17, " " * 1000 + "x", "a" * 5000, "日" * 300, "\U0010ffff" * 50]
    ids, at, shown, shown_at = sentencepieces.encode_texts(c, pa.array(texts))
    for k, text in enumerate(texts):
        own, known = ids[at[k] : at[k + 1]].tolist(), library.encode(text or "")
        assert own == known
        assert c.decode(own) == library.decode(known) == shown[shown_at[k] : shown_at[k + 1]].tobytes().decode().removeprefix(" ")
    for _ in range(5000):
        any_ids = [draw.choice([draw.randint(0, 300), draw.randint(0, c.n - 1), 3 + draw.choice([0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 32])]) for _ in range(draw.randint(0, 8))]
        assert c.decode(any_ids) == library.decode(any_ids)


def test_op11_ties(model):
    """Where joining at once would depart from one merge at a time, a queue takes over."""
    c = sentencepieces.Codec(model)
    for n in range(1, 70):
        word = "▁" * n
        at_once, _ = c.encode_words(pa.array([word.encode()], pa.large_binary()))
        one_by_one = c.queue([int(c.symbol[ord(x)]) for x in word])
        assert at_once.tolist() == one_by_one
    assert np.all(np.diff(c.pairs) > 0)


def test_op11_refuses(model):
    """A model that does more than these arrays hold is refused, not encoded wrongly."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    for change in (lambda m: setattr(m.normalizer_spec, "remove_extra_whitespaces", True), lambda m: setattr(m.trainer_spec, "byte_fallback", False), lambda m: setattr(m.trainer_spec, "model_type", proto.TrainerSpec.UNIGRAM)):
        m = proto.ModelProto()
        m.ParseFromString(model)
        change(m)
        with pytest.raises(ValueError):
            sentencepieces.Codec.check(m.SerializeToString())


def collocations(given, depth=3, least=10, share=50, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) of rows (lang, text)."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in given:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", brute.low(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, depth + 1):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    for lang, counts in f.items():
        good = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        gone = {p[i : i + m] for p, a in good.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * a >= share * good[p[i : i + m]]}
        rows = []
        for p, a in good.items():
            if p not in gone:
                score, _, left, right = min((1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            yield lang, rank, p.decode(), -a, left, right, n[lang], -score


PHRASES = "lang", "rank", "phrase", "a", "l", "r", "n", "score"


def test_op12(spark, odd, odd_rows, none, duck):
    import pyarrow.parquet as pq

    t = pq.read_table(f"{SF}/documents.parquet")
    given = list(zip(t.column("lang").to_pylist(), t.column("text").to_pylist(), strict=True))
    found = got(queries.op12_collocations(spark, SF), *PHRASES)
    assert len(found) > 100 and found == want(collocations(given))
    cursor = duck.execute(phrases.ORACLE_SQL)
    names = [d[0] for d in cursor.description]
    assert found == want(tuple(r[names.index(c)] for c in PHRASES) for r in cursor.fetchall())
    clash = odd.select("*", F.when(F.col("id") % 2 == 0, "xx").alias("lang"), F.lit("p").alias("phrase"), F.lit(1).alias("f"), F.lit(2).alias("words"), F.lit("h").alias("h"))
    own = [(r["lang"], r["text"]) for r in clash.select("lang", "text").collect()]
    for depth, least, share, top in ((3, 2, 50, 2000), (4, 3, 80, 5), (2, 1, 50, 2000), (5, 2, 100, 2000)):
        assert got(phrases.collocations(clash, depth=depth, least=least, part_of=share, top=top), *PHRASES) == want(collocations(own, depth, least, share, top))
    assert phrases.collocations(none.withColumn("lang", F.lit("x"))).count() == 0


def test_op12_shards(spark, monkeypatch):
    """Many small shards, few bits and ties at the list's end change nothing."""
    monkeypatch.setattr(phrases, "SHARD_BYTES", 200)
    monkeypatch.setattr(phrases, "FILTER_BITS", 64)
    draw = random.Random(12)
    words = ["a", "b", "ä", "c\u00a0d", "E", "f"]
    given = [(draw.choice(["x", None, "und", ""]), draw.choice(["", " "]) + "".join(draw.choice(words) + draw.choice([" ", "  ", "\t", ". ", "\n", "!?", " "]) for _ in range(draw.randint(0, 60)))) for _ in range(300)]
    docs = spark.createDataFrame(given, "lang string, text string").repartition(5)
    for top in (7, 2000):
        assert got(phrases.collocations(docs, least=4, top=top), *PHRASES) == want(collocations(given, 3, 4, 50, top))


def test_op12_first_pass_leaves_no_shuffle(spark, monkeypatch):
    """When the second pass begins, what the first one shuffled is gone."""
    blocks = lambda: {str(f) for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if ".data" in str(f)}
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(4).select("text", "lang")
    seen, real = [], phrases.stored
    monkeypatch.setattr(phrases, "stored", lambda df: (seen.append(blocks()), real(df))[1])
    before = blocks()
    phrases.phrase_counts(docs)
    assert len(seen) == 1 and not seen[0] - before


def test_op12_large_counts(spark):
    """Products beyond 64 bits stay exact."""
    rows = [(10**14 + k, 10**14 + 3 * k + 1, 10**14 + 7 * k) for k in range(50)]
    df = spark.createDataFrame(rows, "a long, l long, r long")
    assert got(df.select(phrases.score().alias("s"), "a"), "a", "s") == want((a, 1000000 * a * a // (x * y)) for a, x, y in rows)


def test_bidirectional_index():
    """Intervals of both directions agree with plain counts of all phrases, and extensions with what stands beside them."""
    rng = np.random.default_rng(12)
    for symbols, size in ((3, 50), (40, 400), (1 << 17, 300)):
        seq = rng.integers(0, symbols, size) if symbols < 1000 else rng.choice([0, 1, 2, symbols - 1], size)
        seq = np.concatenate(([0], seq, [0])).astype(np.int64)
        known = [Counter(tuple(seq[i : i + m].tolist()) for i in range(len(seq) - m + 1) if (seq[i : i + m] > 0).all()) for m in range(1, 6)]
        for m, (phrase, count) in enumerate(phrases.BiIndex(seq, 5, symbols).phrases()):
            assert dict(zip(map(tuple, phrase.tolist()), count.tolist(), strict=True)) == known[m]


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variant_rows(n, times=5):
    """(word, form, root, n, n_near, form_n) of counted words."""
    beside = defaultdict(list)
    for a, b in itertools.combinations(n, 2):
        if near(a, b):
            beside[a].append(b)
            beside[b].append(a)
    form = {}
    for w in n:
        best = min(beside[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        yield w, form[w], root, n[w], len(beside[w]), n[form[w]] if form[w] else None


def words_of(given, damage=199, letters=6, least=5):
    n = Counter()
    for i, text in given:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = brute.low(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if damage and h % damage == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if c >= least and len(w) >= letters}


WORDS = "word", "form", "root", "n", "n_near", "form_n"


def test_op13(spark, rows, odd, odd_rows, none):
    found = got(queries.op13_variants(spark, SF), *WORDS)
    assert found == want(variant_rows(words_of(rows))) and any(r[1] for r in found)
    clash = odd.select("*", F.lit("w").alias("word"), F.lit("k").alias("key"), F.lit(7).alias("n"), F.lit("r").alias("root"))
    for damage, letters, least in ((199, 6, 5), (3, 4, 1), (None, 6, 1), (2, 7, 2)):
        assert got(variants.spelling_variants(clash, damage=damage, letters=letters, least=least), *WORDS) == want(variant_rows(words_of(odd_rows, damage, letters, least)))
    assert variants.spelling_variants(none).count() == 0


def test_op13_pairs(spark):
    """All pairs one edit apart are found, whatever the dictionary: words over few letters, with frequent grams of every length, ties and long chains of forms."""
    draw = random.Random(13)
    n = {}
    for _ in range(700):
        w = "".join(draw.choice("abé") for _ in range(draw.randint(6, 9)))
        n[w] = draw.choice([5, 5, 25, 26, 125, 700, 5000, 40000])
    for w in list(n)[:200]:
        k = draw.randrange(len(w))
        for v in (w[:k] + w[k + 1 :], w[:k] + "z" + w[k + 1 :], w[:k] + "z" + w[k:], w + "a", "b" + w):
            if len(v) >= 6:
                n.setdefault(v, draw.choice([5, 6, 30, 30]))
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    frequent, _ = variants.frequent_grams(words, 4)
    assert {2, 3, 4} == {len(g) for g in frequent}  # grams of every length are extended
    assert got(variants.group_variants(words), *WORDS) == want(variant_rows(n))


def test_op13_bounds(spark):
    """The dictionary stays within its bound; each word's two grams don't overlap; checksums are crc32 for runs of any length."""
    words = spark.createDataFrame([("".join(c), 5) for c in itertools.islice(itertools.product("abcdefgh", repeat=6), 3000)], "word string, n long")
    frequent, threshold = variants.frequent_grams(words, 4, most=40)
    assert 0 < len(frequent) <= 40 and threshold > 16
    for word in ("abcdef", "aaaaaa", "abcdefgh" * 3):
        grams = variants.decompose(word, frequent, 4)
        a, b = variants.cheapest(grams, frequent, threshold)
        assert a + len(grams[a]) <= b and all(word[p : p + len(g)] == g for p, g in enumerate(grams))
    draw = random.Random(1)
    parts = [bytes(draw.randrange(256) for _ in range(draw.choice([0, 1, 5, 63, 64, 65, 300]))) for _ in range(200)]
    end = np.cumsum([len(p) for p in parts])
    before = np.array([zlib.crc32(str(k).encode()) for k in range(200)], np.uint32)
    out = variants.checksums(np.frombuffer(b"".join(parts), np.uint8), end - [len(p) for p in parts], end, before)
    assert out.tolist() == [zlib.crc32(p, int(b)) for p, b in zip(parts, before, strict=True)]
    with pytest.raises(ValueError):
        variants.near_pairs(words, letters=3)
