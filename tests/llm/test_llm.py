"""Every numbered operator and the pipeline against plain versions, on the smallest tables and on odd rows."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumenframe.llm import bpe, decontamination, embeddings, graph, jaccard, kneser_ney, language, lines, pii, queries, simhash, suffixes, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, score int, n_words string, _text string, id int, bucket int, base string, source string"


@pytest.fixture(scope="session")
def odd_rows():
    """(id, text): null ids and texts, empty and long texts, ties, repeated rows, personal data, item passages."""



    item = next(t for t in pq.read_table(f"{SF}/benchmark.parquet").column("text").to_pylist() if len(t.split()) > 15)
    line = "A line of some length that is quite certain to be seen again later on."
    long = " ".join(f"word{k % 977} tail{k % 13}" for k in range(12000))
    rows = [
        (None, "a row without an id\n" + line),
        (None, None),
        (1, None),
        (2, ""),
        (3, " \n\t \n"),
        (4, line),
        (5, "before\n" + line + "\nafter"),
        (5, "before\n" + line + "\nafter"),
        (6, line.upper()),
        (7, long),
        (8, long + " and one more end"),
        (9, "x" * 9000 + " y"),
        (10, item),
        (11, "Words that precede. " + item.upper() + " Words that follow."),
        (12, "Mail a.b@c.org, a@b.c_d@e.f and +49 (30) 1234-5678; 10.0.0.1 or 1.2.3.4.5.6.7.8, 999.1.1.1; card 4111 1111 1111 1111."),
        (13, "Zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich \U0001f600     end"),
        (14, "one\ntwo\nthree three three three\nfour four four four four\nfive five five five five five"),
        (15, "zero\none\ntwo\nthree three three three\nfour four four four four\nfive five five five five five\none\ntwo"),
        (16, "ab" * 200),
        (17, "ab" * 150 + "c"),
        (18, "1" * 5000 + "." + "2" * 5000 + "@" + "-" * 100),
        (19, "<|endoftext|> stands here, " + "<|startoftext|>" * 3 + "q" * 5000),
        (20, "one"),
        (21, "one"),
        (22, "\n".join(["short"] * 40)),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame([(i, t, k, "n", "t", k % 2, 3, None, None) for k, (i, t) in enumerate(odd_rows)], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def rows():
    """(id, text) of the smallest documents table."""



    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"])
    return list(zip(t.column(0).to_pylist(), t.column(1).to_pylist()))


def crc(i, n):
    import zlib

    return zlib.crc32(("" if i is None else str(i)).encode()) % n


def got(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def want(rows):
    return sorted(rows, key=repr)


def vocabulary():
    import public_tokenizers

    return bpe.read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))


def close(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x[:-2] == y[:-2]
        assert x[-2:] == pytest.approx(y[-2:], rel=1e-6, abs=1e-6)


def test_op1(spark, rows):
    model = brute.KneserNey([t for i, t in rows if crc(i, 5) != 1])
    found = got(queries.op1_lm_scoring(spark, SF), "doc_id", "held_out", "train_tokens", "n_tokens", "n_known", "base_score", "score")
    close(found, want((i, crc(i, 5) == 1, model.n, *model.score(t)) for i, t in rows))


def test_op1_odd(spark, odd, odd_rows, none):
    model = brute.KneserNey([t for _, t in odd_rows])
    found = got(kneser_ney.held_out(odd, F.lit(True)), "doc_id", "n_tokens", "n_known", "base_score", "score")
    close(found, want((i, *model.score(t)) for i, t in odd_rows))
    assert kneser_ney.held_out(none, F.lit(True)).count() == 0
    assert {r["score"] for r in kneser_ney.score(odd, kneser_ney.train(none)).collect()} == {0.0}


def test_op1_other_order(spark):
    """Known words in an order of their own, after texts that repeat another: never far below single words."""
    words = [f"w{k}" for k in range(26)]
    texts = [" ".join(words)] * 40
    others = [" ".join(words[::-1] * 10), " ".join(words[::2] * 30), " ".join(words), "", "w3 w3 unknown"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts + others)], "doc_id long, text string")
    model, found = brute.KneserNey(texts), {r["doc_id"]: r for r in kneser_ney.held_out(docs, F.col("doc_id") < 40).collect()}
    for k, t in enumerate(others, 40):
        *_, base, plain = model.score(t)
        r = found[k]
        assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(max(plain, base - 6) + np.log10(1 + 10 ** -abs(plain - base + 6)), abs=1e-5)
        assert r["score"] > r["base_score"] - 6.001
    assert model.score(others[0])[-1] < model.score(others[0])[-2] - 100


def test_op2(spark, odd, none):
    found = queries.op2_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert len(found) == 200 and found["score"].between(0, 1).all()
    held = found[found["held_out"] & found["lang"].notna() & (found["lang_pred"] != "und")]
    assert (held["lang"] == held["lang_pred"]).mean() >= 0.9
    model = language.learn(spark.createDataFrame([("the cat and the dog", "en"), ("der Hund und die Katze", "de"), (None, "fr"), ("le chien", None)], "text string, lang string"))
    assert model[0] == ["de", "en"]
    assert {r["lang_pred"] for r in language.identify(odd.filter("text is null or doc_id in (2, 3)"), model).collect()} == {"und"}
    assert language.identify(odd, model).count() == odd.count()
    assert language.identify(none, language.learn(none.withColumn("lang", F.lit("x")))).count() == 0
    assert {r[0] for r in language.identify(odd, ([], model[1][:0])).select("lang_pred").collect()} == {"und"}
    both = language.identify(spark.createDataFrame([("the cat and the dog der Hund und die Katze",)], "text string"), model).first()
    assert set(both["langs"]) == {"de", "en"}


def line_results(rows):
    for (i, t), gone in zip(rows, brute.line_dedup(rows), strict=True):
        given = t.split("\n") if t is not None else []
        yield i, len(given), len(gone), brute.sha("\n".join(x for k, x in enumerate(given) if k not in gone))


def test_op3(spark, rows, odd, odd_rows, none, duck):
    columns = "doc_id", "n_lines", "n_removed", "kept_sha256"
    found = got(queries.op3_line_dedup(spark, SF), *columns)
    assert found == want(line_results(rows))
    assert found == want(duck.sql(f"SELECT {', '.join(columns)} FROM ({lines.ORACLE_SQL})").fetchall())
    out = lines.dedup_lines(odd).withColumn("kept_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    assert got(out, *columns) == want(line_results(odd_rows))
    assert out.columns[: len(odd.columns)] == odd.columns
    assert lines.dedup_lines(none).count() == 0


def test_op3_blank_lines(spark):
    """Runs in which no 50 consecutive lines hold 50 characters."""
    head, foot = "h" * 30, "f" * 30
    given = [
        (1, "one\n" + head + "\n" * 61 + foot + "\nend"),
        (2, "two\n" + head + "\n" * 61 + foot + "\nlast"),
        (3, head + "\n" * 60 + foot),
        (4, "\n\n".join("123456789" * 7)),
        (5, "x\n" + "\n\n".join("123456789" * 7) + "\n" * 80),
        (6, "\n" * 200),
        (7, "\n" * 70 + "l" * 60 + "\n" * 70),
        (8, "y" + "\n" * 75 + "l" * 60 + "\n" * 65 + "z"),
    ]
    out = lines.dedup_lines(spark.createDataFrame(given, "doc_id long, text string")).withColumn("kept_sha256", F.sha2("text", 256))
    assert got(out, "doc_id", "n_lines", "n_removed", "kept_sha256") == want(line_results(given))


def test_op3_hot_line(spark):
    """A line in a third of all rows, rows of one id with different texts, long repeated runs, ids that are texts."""
    rng = np.random.default_rng(13)
    word = lambda n: "".join(chr(97 + x) for x in rng.integers(0, 26, n))
    hot, run = word(60), [word(int(n)) for n in rng.integers(1, 30, 150)]
    given = [(k, "\n".join(([hot] if k % 3 == 0 else []) + [word(20), "", word(5)] + (run[k % 40 : k % 40 + 3 * k] if k % 7 == 0 else []) + [word(9)])) for k in range(120)]
    given += [(5, "\n".join([word(8), hot, *run])), (5, "\n".join([word(8), hot, *run])), (6, "\n".join([hot, hot, word(3), *run[10:], *run[:20]])), (None, hot), (None, None)]
    want_rows = want(line_results(given))
    for kind in ("long", "string"):
        rows = given if kind == "long" else [(None if i is None else f"{i:05d}", t) for i, t in given]
        out = lines.dedup_lines(spark.createDataFrame(rows, f"doc_id {kind}, text string")).withColumn("kept_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
        assert got(out.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id", "n_lines", "n_removed", "kept_sha256") == want_rows


def test_op4(spark):
    e = pq.read_table(f"{SF}/embeddings.parquet").to_pydict()
    vectors = list(zip(e["vec_id"], e["embedding"], e["label"], strict=True))
    nan, one = float("nan"), [1.0] + [0.0] * 63
    more = [(None, one, 3), (9000, one, 3), (9001, [x * 1e30 for x in one], 3), (9002, one, None), (9003, None, 3), (9004, [], 3), (9005, [0.0] * 64, 3), (9006, [nan] * 64, 3), (9007, [None, *one[1:]], 3), (9008, one[:5], 3), (9009, [float("inf"), *one[1:]], 3), (9001, one, 3), (9010, [1.0, 0.395] + [0.0] * 62, 3), (9011, [1.0, 0.396] + [0.0] * 62, 3)]
    for table in (vectors, vectors + more):
        df = spark.createDataFrame(table, "vec_id long, embedding array<double>, label int").repartition(4)
        units = []
        for _, v, label in table:
            good = label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
            units.append(np.array(v, dtype=float) / max(abs(x) for x in v) if good else None)
        units = [None if u is None else u / np.linalg.norm(u) for u in units]
        links = [(a, b) for a in range(len(table)) for b in range(a) if units[a] is not None and units[b] is not None and table[a][2] == table[b][2] and len(units[a]) == len(units[b]) and units[a] @ units[b] >= 0.93]
        count = np.bincount(np.array(links, dtype=int).reshape(-1), minlength=len(table))
        ids = [r[0] for r in table]
        of = brute.named(ids, brute.components(len(table), links))
        expected = want((i, int(n), c, i is not None and i == c) for i, n, c in zip(ids, count, of, strict=True))
        assert got(embeddings.near_duplicates(df), "vec_id", "n_links", "component_id", "kept") == expected
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_op4_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6, 16))[rng.integers(0, 6, 400)] + rng.normal(size=(400, 16)) * rng.choice([0.05, 0.3], (400, 1))
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = (u @ u.T >= 0.93) & ~np.eye(400, dtype=bool)
    of = brute.named(range(400), brute.components(400, np.argwhere(hit).tolist()))
    assert got(embeddings.near_duplicates(df, exact=True), "vec_id", "n_links", "component_id") == want((k, int(hit[k].sum()), of[k]) for k in range(400))


def test_op4_probes(spark, monkeypatch):
    """A vector visits a bounded number of cells, at least nine tenths of the links are found, each counted on both sides."""
    monkeypatch.setattr(embeddings, "BLOCK", 32)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 32))[rng.integers(0, 300, 2000)] + rng.normal(size=(2000, 32)) * rng.choice([0.1, 0.3], (2000, 1))
    df = spark.createDataFrame([(k, v.tolist(), k % 2) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = (u @ u.T >= 0.93) & ~np.eye(2000, dtype=bool) & (np.arange(2000)[:, None] % 2 == np.arange(2000)[None] % 2)
    found = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(df).collect()}
    n = np.array([found[k] for k in range(2000)])
    assert (n <= hit.sum(axis=1)).all() and n.sum() % 2 == 0 and n.sum() >= 0.9 * hit.sum() > 0
    centres = embeddings.spherical_kmeans(u, 64)
    assert max(len(c) for c in embeddings.visits(u, centres, (1 - 0.93**2) ** 0.5, embeddings.PROBES)[2]) <= embeddings.PROBES
    exact = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(df, exact=True).collect()}
    assert [exact[k] for k in range(2000)] == hit.sum(axis=1).tolist()


def test_op5(spark, rows, odd, odd_rows, none, monkeypatch):
    columns = "n_words", "n_hit", "n_items", "items_sha256", "contaminated"
    b = pq.read_table(f"{SF}/benchmark.parquet").to_pydict()
    items = list(zip(b["item_id"], b["text"], strict=True))
    assert got(queries.op5_decontamination(spark, SF), "doc_id", *columns) == want((i, *x) for (i, _), x in zip(rows, brute.contamination([t for _, t in rows], items), strict=True))
    items += [(None, "words that follow"), (901, "that"), (901, None), (902, ""), (903, "that"), (904, "ab ab")]
    table = spark.createDataFrame(items, "item_id long, text string")
    expected = want((i, *x) for (i, _), x in zip(odd_rows, brute.contamination([t for _, t in odd_rows], items), strict=True))
    for size in (decontamination.BLOCK_BYTES, 2000):  # at once, and in several blocks
        monkeypatch.setattr(decontamination, "BLOCK_BYTES", size)
        out = decontamination.decontaminate(odd, table).withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256))
        assert got(out, "doc_id", *columns) == expected
        # columns of names that the operator uses stay as they are, but for its results
        clash = odd.select("*", *[F.lit(f"my {c}").alias(c) for c in ("_hits", "_found", "_row", "items")])
        out = decontamination.decontaminate(clash, table).withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256))
        assert got(out, "doc_id", *columns) == expected
        assert {(r["_hits"], r["_found"], r["_row"]) for r in out.collect()} == {("my _hits", "my _found", "my _row")}
    assert decontamination.decontaminate(none, table).count() == 0
    assert {r["n_hit"] for r in decontamination.decontaminate(odd, table.limit(0)).collect()} == {0}


def test_op5_many_blocks(spark, monkeypatch):
    """A benchmark of 200 blocks: one pass of the texts each, one plan node in each plan, and the same rows as at once."""
    rng = np.random.default_rng(5)
    items = [(f"i{k}", " ".join(f"q{x}" for x in rng.integers(0, 60, int(rng.integers(1, 16))))) for k in range(300)]
    given = [(k, " ".join(f"q{x}" for x in rng.integers(0, 60, 40)) + (" " + items[k][1] if k % 3 == 0 else "")) for k in range(60)]
    docs, table = spark.createDataFrame(given, "doc_id long, text string").repartition(2), spark.createDataFrame(items, "item_id string, text string")
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 110)
    plans, real = [], decontamination.stored
    monkeypatch.setattr(decontamination, "stored", lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")), real(df))[1])
    out = decontamination.decontaminate(docs, table)
    assert len(plans) > 150 and max(plans) == 1 and out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    columns = "n_words", "n_hit", "n_items", "items_sha256", "contaminated"
    out = out.withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256))
    assert got(out, "doc_id", *columns) == want((i, *x) for (i, _), x in zip(given, brute.contamination([t for _, t in given], items), strict=True))


def encoded(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(vocabulary())
    t.no_truncation()
    t.no_padding()
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        yield i, len(ids), brute.sha(np.array(ids, "<u4").tobytes()), brute.sha(t.decode(ids, skip_special_tokens=False))


def test_op6(spark, rows, odd, odd_rows, none):
    columns = "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"
    assert got(queries.op6_bpe(spark, SF), *columns) == want(encoded(rows))
    assert got(bpe.encode_decode(odd, vocabulary(), digests=True), *columns) == want(encoded(odd_rows))
    out = bpe.encode_decode(odd, vocabulary(), leaf=7)
    assert got(out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")), *columns) == want(encoded(odd_rows))
    again = bpe.decode_ids(out.select("ids", F.col("decoded").alias("was")), vocabulary())
    assert again.filter("not decoded <=> was").count() == 0
    assert bpe.encode_decode(none, vocabulary()).count() == 0
    clash = odd.withColumn("_row", F.lit("r")).withColumn("_ids", F.lit("i"))
    out = bpe.encode_decode(clash, vocabulary(), digests=True)
    assert out.columns[: len(clash.columns)] == clash.columns and out.filter("_row = 'r' and _ids = 'i'").count() == odd.count()
    assert got(out, *columns) == want(encoded(odd_rows))


def test_op6_refuses(spark):
    """A vocabulary that asks for more than trees of merges carry out is an error, not another result."""
    import json

    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for change in (lambda s: s.update(decoder={"type": "BPEDecoder", "suffix": "</w>"}), lambda s: s["added_tokens"][0].update(normalized=True), lambda s: s["added_tokens"][1].update(single_word=True), lambda s: s["model"].update(byte_fallback=True), lambda s: s["model"].update(ignore_merges=True), lambda s: s["model"].update(type="WordPiece"), lambda s: s["model"].update(dropout=0.1)):
        spec = json.loads(vocabulary())
        change(spec)
        with pytest.raises(ValueError, match="not supported"):
            bpe.encode_decode(docs, json.dumps(spec))


def test_op6_long_pieces(spark):
    """Pieces of many lengths go through trees of leaves of a few bytes, in one task and over several."""
    rng = np.random.default_rng(6)
    letters = "etaoinshrdlu-äß0123456789'.,<|>"
    given = [(k, " ".join("".join(rng.choice(list(letters[: 5 + k % 26]), int(n))) for n in rng.integers(1, 400, 6))) for k in range(60)]
    given.append((99, "".join(rng.choice(list("abcdefgh"), 30_000))))
    docs = spark.createDataFrame(given, "doc_id long, text string")
    for leaf in (50, bpe.LEAF_BYTES):
        assert got(bpe.encode_decode(docs, vocabulary(), digests=True, leaf=leaf), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want(encoded(given))
    c = bpe.Codec(vocabulary())
    for _, text in given[:20]:
        for word in text.split():
            ids = c.tokenizer.encode(word, add_special_tokens=False).ids
            for twig in (1, 3, 16):
                assert [i for piece, known in c.pieces(word) for i in ([known] if known >= 0 else c.tree(piece, True, twig))] == ids


def test_op7(spark, rows, odd, odd_rows, none):
    for out, given in ((queries.op7_simhash(spark, SF), rows), (simhash.near_duplicates(odd).withColumn("fingerprint", simhash.hexadecimal("fingerprint")), odd_rows)):
        prints, of = brute.simhash(given)
        assert got(out, "doc_id", "fingerprint", "component_id") == want((i, f"{f:016x}", c) for (i, _), f, c in zip(given, prints, of, strict=True))
    assert simhash.near_duplicates(none).count() == 0


def test_op7_shards(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 64)
    rng = np.random.default_rng(7)
    x = np.repeat(rng.integers(-(1 << 63), 1 << 63, 300, dtype=np.int64), 4)
    x ^= np.int64(1) << rng.integers(0, 63, len(x)) ^ np.int64(1) << rng.integers(0, 63, len(x))
    x = np.unique(x)
    found = dict(got(simhash.link(spark.createDataFrame([(int(v),) for v in x], "fingerprint long")), "node", "root"))
    near = np.bitwise_count(x.view(np.uint64)[:, None] ^ x.view(np.uint64)[None]) <= 2
    roots = brute.components(len(x), np.argwhere(np.triu(near, 1)).tolist())
    of = brute.named(x.tolist(), roots)
    assert [found.get(v, v) for v in x.tolist()] == of


def test_pipeline_near_copies(spark, monkeypatch):
    """The near-dedup stage against all pairs of five-word sets, on copies with edited words and a passage that many hold."""
    rng = np.random.default_rng(5)
    texts = []
    for _ in range(30):
        words = [f"w{x}" for x in rng.integers(0, 5000, 200)] + [f"common{k}" for k in range(int(rng.integers(0, 60)))]
        for edits in (0, 1, 2, 3, 4, 5, 8):
            copy = list(words)
            for k in rng.integers(0, len(copy), edits):
                copy[k] = "edited"
            texts.append(" ".join(copy))
    given = [(k, t) for k, t in enumerate([*texts, None, "", "two words", "Two words", "three other words"])]

    of = brute.similar(given)
    docs = spark.createDataFrame(given, "doc_id long, text string").repartition(3)
    assert got(corpus_pipeline.drop_near_duplicates(spark, docs, SF), "doc_id") == want((k,) for k, c in enumerate(of) if k == c)
    monkeypatch.setattr("lumenframe.llm.jaccard.SAMPLE", 1)
    assert got(corpus_pipeline.drop_near_duplicates(spark, docs, SF), "doc_id") == want((k,) for k, c in enumerate(of) if k == c)


def test_near_copies_without_hub(spark):
    """A large group whose copies are around 0.8 alike, some linked through others only, and sizes that differ."""
    rng = np.random.default_rng(11)
    base = [f"b{k}" for k in range(150)]
    given = []
    for k in range(250):
        copy = [f"e{k}x{m}" if rng.random() < 0.012 * (k % 4) else w for m, w in enumerate(base[: int(rng.integers(110, 151))])]
        given.append((k, " ".join(copy)))
    of = brute.similar(given)
    assert len(set(of)) > 10
    docs = spark.createDataFrame(given, "doc_id long, text string").repartition(4)
    for reach in (0, 3):
        assert got(jaccard.near_duplicates(docs, reach=reach), "doc_id", "component_id") == want((k, c) for k, c in enumerate(of))


def test_near_copies_keep_shared_places_only(spark, monkeypatch):
    """Sets that are ordered anew, as a passage is hot, make no rows of shingles that no other has."""
    monkeypatch.setattr(jaccard, "SAMPLE", 1)
    made, real = [], jaccard._places
    monkeypatch.setattr(jaccard, "_places", lambda *a: (made.append(real(*a)), made.append(made[0].count()), made[0])[2])
    given = [(k, " ".join([f"b{x}" for x in range(100)] + [f"o{k}x{x}" for x in range(45)])) for k in range(150)]
    given.append((150, given[7][1].replace("b50", "changed")))
    found = got(jaccard.near_duplicates(spark.createDataFrame(given, "doc_id long, text string").repartition(4), reach=0), "doc_id", "component_id")
    assert found == want((k, 7 if k == 150 else k) for k, _ in given)
    assert 0 < made[1] < 150 * 29 / 3, made[1]


def test_near_copies_leave_texts_where_they_lie(spark, monkeypatch):
    """Sets are made again from texts that no join has dealt out."""
    plans, real = [], jaccard.shingle_sets
    monkeypatch.setattr(jaccard, "shingle_sets", lambda docs, **k: (plans.append(docs._jdf.queryExecution().executedPlan().toString()), real(docs, **k))[1])
    given = [(k, " ".join(f"w{k // 2}x{x}" if x != 9 * (k % 2) else "edited" for x in range(150))) for k in range(12)]
    found = got(jaccard.near_duplicates(spark.createDataFrame(given, "doc_id long, text string")), "doc_id", "component_id")
    assert found == want((k, k - k % 2) for k, _ in given)
    assert len(plans) > 1 and not any("Join" in p for p in plans), plans


def test_near_copies_and_boilerplate(spark, monkeypatch):
    """Texts that share most of their words, but too few to link, meet in no more pairs than there are texts; those that link do."""
    monkeypatch.setattr(jaccard, "SAMPLE", 1)  # the shared passage is not in the sample
    made, real = [], jaccard._similar
    monkeypatch.setattr(jaccard, "_similar", lambda pairs, *a: (made.append(pairs.count()), real(pairs, *a))[1])
    for n in (150, 400):
        made.clear()
        given = [(k, " ".join([f"b{x}" for x in range(100)] + [f"o{k}x{x}" for x in range(45 if k % 10 else 8)])) for k in range(n)]
        given += [(n + k, given[k][1].replace("b50", "changed")) for k in range(0, 60, 7)]
        docs = spark.createDataFrame(given, "doc_id long, text string").repartition(4)
        for told in (jaccard.TOLD, 5):  # hot shingles as a list, and too many for one
            monkeypatch.setattr(jaccard, "TOLD", told)
            made.clear()
            assert got(jaccard.near_duplicates(docs), "doc_id", "component_id") == want(zip([i for i, _ in given], brute.similar(given), strict=True))
            assert sum(made) < 4 * n
        monkeypatch.setattr(jaccard, "TOLD", 1 << 22)


def test_pipeline_repeated_ids(spark):
    """One row of each group stays, also where rows share an id or have none."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    given = [(1, a), (5, b), (5, a), (5, b), (None, c), (None, c), (7, c), (None, None), (None, "only words without an id here")]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(given)], "doc_id long, text string, _own int").repartition(3)
    out = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert out.columns == docs.columns
    assert got(out, "doc_id", "text") == want([(1, a), (5, b), (7, c), (None, None), (None, "only words without an id here")])


def test_op8(spark, rows, odd, odd_rows, none):
    columns = "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"
    for out, given in ((queries.op8_suffix_dedup(spark, SF), rows), (suffixes.removals(odd), odd_rows)):
        assert got(out, *columns) == want((i, *x) for (i, _), x in zip(given, brute.suffix_dedup(given), strict=True))
    assert suffixes.removals(none).count() == 0


def test_op8_long_runs(spark):
    """Rules of dashes beside a longer periodic stretch that only the first pass sees with them."""
    rng = np.random.default_rng(8)
    word = lambda n: "".join(chr(97 + x) for x in rng.integers(0, 26, n))
    shared = [word(80) for _ in range(60)]
    given = [(k, "-" * (90 + 5 * k) + "".join(word(60) + s for s in shared)) for k in range(12)] + [(99, "x" * 400)]
    out = suffixes.removals(spark.createDataFrame(given, "doc_id long, text string").coalesce(1))
    columns = "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"
    assert got(out, *columns) == want((i, *x) for (i, _), x in zip(given, brute.suffix_dedup(given), strict=True))


def test_op8_rows_of_one_id(spark):
    """Rows of one id are cut each by its own spans; a passage that very many rows hold; ids that are texts."""
    rng = np.random.default_rng(18)
    word = lambda n: "".join(chr(97 + x) for x in rng.integers(0, 26, n))
    a, b, c, licence = word(300), word(200), word(400), word(120)
    given = [(1, a), (2, a[:150] + b), (2, c), (2, c), (3, c[100:300])] + [(k, word(60) + licence + word(60)) for k in range(10, 700)]
    columns = "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"
    out = suffixes.removals(spark.createDataFrame(given, "doc_id long, text string"))
    assert got(out, *columns) == want((i, *x) for (i, _), x in zip(given, brute.suffix_dedup(given), strict=True))
    named = [(f"n{i:04d}", t) for i, t in given[:40]]
    out = suffixes.removals(spark.createDataFrame(named, "doc_id string, text string"))
    assert got(out, *columns) == want((i, *x) for (i, _), x in zip(named, brute.suffix_dedup([(i, t) for i, t in given[:40]]), strict=True))


def test_op9(spark, rows, odd, odd_rows, none):
    def check(out, given):
        for r, (i, t) in zip(sorted(out.collect(), key=lambda r: (brute.order(r["doc_id"]), r["was"] or "")), sorted(given, key=lambda x: (brute.order(x[0]), x[1] or "")), strict=True):
            base, spans = ([(x["kind"], x["start"], x["end"]) for x in r[c]] for c in ("base", "spans"))
            assert (i, base) == (r["doc_id"], brute.private(t))
            assert set(base) <= set(spans) and spans == sorted(spans, key=lambda x: (pii.KINDS.index(x[0]), *x[1:]))

    check(pii.find_pii(spark.createDataFrame([(i, t, t) for i, t in rows], "doc_id long, was string, text string")), rows)
    check(pii.find_pii(odd.withColumn("was", F.col("text"))), odd_rows)
    assert pii.find_pii(none).count() == 0
    digest = {i: brute.sha(",".join(f"{k}:{a}:{b}" for k, a, b in brute.private(t))) for i, t in rows}
    found = queries.op9_pii(spark, SF)
    assert dict(got(found, "doc_id", "base_sha256")) == digest
    assert got(found.agg(F.sum("n_email"), F.sum("n_ip"), F.sum("n_card"), F.sum("n_phone")), 0, 1, 2, 3) == [tuple(sum(k == x for _, t in rows for x, _, _ in brute.private(t)) for k in ("email", "ip", "card", "phone"))]


def test_op9_added_spans(spark):
    """Spans beyond the base: nine tenths of the planted ones are accepted, and nine tenths of those accepted are planted."""
    rng = np.random.default_rng(9)
    pick = lambda letters, n: "".join(rng.choice(list(letters), n))
    low, up, num = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "0123456789"

    def card():
        body = "4" + pick(num, 14)
        whole = next(body + x for x in num if brute.luhn(body + x))
        return f"{whole[:4]} {whole[4:8]} {whole[8:12]} {whole[12:]}"

    private = [
        lambda: ("email", f"{pick(low, 6)} (at) {pick(low, 7)} (dot) com"),
        lambda: ("email", f"{pick(low, 5)}.{pick(low, 4)} [at] {pick(low, 7)}.org"),
        lambda: ("ip", "2001:db8:" + ":".join(pick("0123456789abcdef", 4) for _ in range(5)) + ":8a2e"),
        lambda: ("secret", "AKIA" + pick(up, 15) + "7"),
        lambda: ("secret", "7" + pick("0123456789abcdef", 30) + "f"),
        lambda: ("phone", f"({rng.integers(200, 999)}) 555-{pick(num, 4)}"),
        lambda: ("card", card()),
    ]
    harmless = [
        lambda: f"at {rng.integers(10, 24)}:{rng.integers(10, 60)}:{rng.integers(10, 60)} sharp",
        lambda: "00:1A:2B:3C:4D:" + pick("0123456789ABCDEF", 2),
        lambda: "SECTION2" + pick("ABCDEFGHIJKLM", 10),
        lambda: "look at page.Then",
        lambda: "4" + pick(num, 3) + " " + " ".join(pick(num, 4) for _ in range(2)) + " 1",
        lambda: "p" + pick("aeiou", 3) + "12345678901234567",
    ]
    given, planted = [], set()
    for k in range(400):
        text = f"Some words before number {k} and "
        if k % 2:
            kind, span = private[k // 2 % len(private)]()
            # cards follow other digits, which keeps them out of the base
            text += "12 " if kind == "card" else ""
            planted.add((k, kind, len(text), len(text) + len(span)))
            text += span
        else:
            text += harmless[k // 2 % len(harmless)]()
        given.append((k, text + " with more words after it."))
    rows = pii.find_pii(spark.createDataFrame(given, "doc_id long, text string")).collect()
    base = {(r["doc_id"], x["kind"], x["start"], x["end"]) for r in rows for x in r["base"]}
    added = {(r["doc_id"], x["kind"], x["start"], x["end"]) for r in rows for x in r["spans"]} - base
    planted -= base
    print("recall", len(added & planted) / len(planted), "precision", len(added & planted) / len(added), sorted(added - planted)[:5], sorted(planted - added)[:5])
    assert len(added & planted) >= 0.9 * len(planted) and len(added & planted) >= 0.9 * len(added)
    assert all(brute.luhn(given[k][1][a:b]) for k, kind, a, b in added if kind == "card")


def test_op10(spark, odd, none):
    sf = "/root/testdata/sf0.01"
    found = queries.op10_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id").toPandas()
    held = found[found["held_out"]]
    assert (held["toxic"] == held["predicted"]).mean() >= 0.9
    bad, good = held[held["toxic"] == 1]["score"].to_numpy(), held[held["toxic"] == 0]["score"].to_numpy()
    assert (bad[:, None] > good[None]).mean() >= 0.9
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    out = toxicity.detect(spark, odd, labels, train_on=F.lit(True))
    assert out.count() == odd.count() and out.filter("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.detect(spark, none, labels.limit(0), train_on=F.lit(True)).count() == 0
    texts = [("You awful creep. The weather is fine.", 1), ("The weather is fine. We go out.", 0), ("A quiet day. What an awful creep!", 1), ("A quiet day. We stay in.", 0)] * 20
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(texts)], "doc_id long, text string")
    found = toxicity.detect(spark, docs, spark.createDataFrame([(k, y) for k, (_, y) in enumerate(texts)], "doc_id long, toxic int"), train_on=F.lit(True)).orderBy("doc_id").collect()
    assert [int(r["score"] >= 0.5) for r in found] == [y for _, y in texts]
    assert {t[x["start"] : x["end"]].strip() for (t, _), r in zip(texts, found, strict=True) for x in r["offending"]} == {"You awful creep", "What an awful creep"}


def test_op10_length(spark):
    """A text of many sentences without offence stays clean; one offending sentence among them is found."""
    texts = [("You awful creep. The weather is fine.", 1), ("The weather is fine. We go out.", 0), ("A quiet day. What an awful creep!", 1), ("A quiet day. We stay in.", 0)] * 20
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(texts)], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(k, y) for k, (_, y) in enumerate(texts)], "doc_id long, toxic int"))
    clean = "The harbour was calm and nobody spoke. " * 5000
    found = toxicity.score(spark.createDataFrame([(clean,), (clean * 4,), (clean + "What an awful creep!",)], "text string"), model).collect()
    assert [r["score"] >= 0.5 for r in found] == [False, False, True]
    assert [len(r["offending"]) for r in found] == [0, 0, 1]
    big = toxicity.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    assert toxicity.score(spark.createDataFrame([(clean,), ("!".join(f"word{k} other{k % 7}" for k in range(5000)),)], "text string"), big).filter("score >= 0.5").count() == 0


def test_components(spark):
    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(400, 460)] + [(500, k) for k in range(501, 560)]
    found = dict(got(graph.components(spark.createDataFrame([*links, (None, 3)], "a long, b long")), "node", "root"))
    of = brute.named(range(600), brute.components(600, links))
    assert all(found.get(k, k) == of[k] for k in range(600))


def test_pipeline(spark, rows):
    scored = toxicity.detect(spark, spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"), train_on=F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0)
    clean = {r["doc_id"] for r in scored.filter("score < 0.5").select("doc_id").collect()}
    docs = [(i, t) for i, t in rows if i in clean]
    left = []
    for (i, t), gone in zip(docs, brute.line_dedup(docs), strict=True):
        text = t if not gone else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
        if not gone or text:
            left.append((i, text))
    of = brute.similar(left)
    left = [x for x, c in zip(left, of, strict=True) if x[0] == c]
    b = pq.read_table(f"{SF}/benchmark.parquet").to_pydict()
    hit = brute.contamination([t for _, t in left], list(zip(b["item_id"], b["text"], strict=True)))
    left = [x for x, h in zip(left, hit, strict=True) if not h[-1]]
    assert got(corpus_pipeline.run(spark, SF), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want(encoded(left))


def test_pipeline_odd(spark, tmp_path, odd):
    odd.withColumn("lang", F.lit("en")).withColumn("n_chars", F.length("text").cast("long")).drop("source").withColumn("source", F.lit("s")).write.parquet(f"{tmp_path}/documents.parquet")
    for table in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 5


def test_pipeline_columns(spark, odd, odd_rows):
    """Each stage returns the columns of its rows with the values they had, whatever their names."""
    names = ["score", "offending", "n_lines", "n_removed", "n_words", "n_hit", "n_items", "items", "spans", "contaminated", "_hits", "_found", "_own", "given", "component_id", "id", "doc", "key", "_row"]
    base = odd.select("doc_id", "text", F.monotonically_increasing_id().alias("was"))
    docs = base.select("doc_id", "text", "was", *[F.concat(F.lit(f"{c} of "), F.col("was").cast("string")).alias(c) for c in names], F.lit(7).cast("short").alias("n_chars"))
    rows = {r["was"]: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.dtypes == docs.dtypes, name
        kept = out.collect()
        assert len({r["was"] for r in kept}) == len(kept) > 3
        for r in kept:
            assert all(r[c] == rows[r["was"]][c] for c in ["doc_id", *names]), name
            assert r["n_chars"] == 7 or name == "line dedup"
    out = corpus_pipeline.encode(spark, docs, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() == len(odd_rows)
