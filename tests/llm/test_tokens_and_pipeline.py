import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tombolo.llm import bpe, langid, packing, queries, token_counts

SF = "/root/testdata/sf0.001"
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, piece string"
ODD = [None, "", " \n\t ", "a", "A<|endoftext|>b", "<|startoftext|>", "ΣΑΣ İstanbul ſ K é é", "日本語のテキスト 한국어", "🙂🙃 👩‍👩‍👧", "x" * 3000, "don't I'LL we've 12345 3.14!!!", " 　nbsp​", "\x00\x01 control", "the the the " * 2000]


def frame(spark):
    words = ["alpha", "the", "Über", "naïve", "x9", "!!", "zzzqqq", "\n"]
    rng = random.Random(2)
    rows = [*ODD, *[" ".join(rng.choice(words) for _ in range(rng.randrange(200))) for _ in range(60)], ODD[4]]
    return spark.createDataFrame([(i, t, "en", "clash") for i, t in enumerate(rows)], SCHEMA).repartition(3), rows


def test_bpe_equals_the_library(spark):
    docs, rows = frame(spark)
    real = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    t = Tokenizer.from_file(WORD)
    for table, texts in ((docs, dict(enumerate(rows))), (real, {r["doc_id"]: r["text"] for r in real.collect()})):
        for r in bpe.encode_decode(table, WORD).collect():
            ids = t.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
            assert r["ids"] == ids, texts[r["doc_id"]]
            assert r["decoded"] == t.decode(ids, skip_special_tokens=False)


def test_bpe_takes_every_code_point_and_combining_marks_as_the_library_does():
    t, coder, rng = Tokenizer.from_file(WORD), bpe.WordBPE(WORD), random.Random(8)

    def words(text):
        text = t.normalizer.normalize_str(text)
        return [text[a:b] for _, (a, b) in t.pre_tokenizer.pre_tokenize_str(text)]

    # planes that Unicode has given letters to so far, one code point at a time, and a sample of all others
    for c in [*range(0xD800), *range(0xE000, 0x20000), *range(0x20000, 0x110000, 97)]:
        assert coder.words(f"a{chr(c)}b {chr(c)}") == words(f"a{chr(c)}b {chr(c)}"), hex(c)
    marks = [*range(0x300, 0x370), *range(0x610, 0x61B), *range(0x6D6, 0x6EE), *range(0x890, 0x900), *range(0x1100, 0x1200), 0x93C, 0x9BE, 0x9D7, 0x110BA, 0x16D67, 0x3099]
    texts = ["".join(chr(rng.choice(marks) if rng.random() < 0.5 else rng.choice((97, 101, 0xE9, 0x415, 0x627, 0xAC00, 0x995, 0x212A, 0x3A3, 32, 33))) for _ in range(12)) for _ in range(20_000)]
    for text, got, ids in zip(texts, coder.encode(texts), t.encode_batch(texts, add_special_tokens=False), strict=True):
        assert got == (" ".join(map(str, ids.ids)), t.decode(ids.ids, skip_special_tokens=False)), ascii(text)


def test_bpe_of_a_word_of_many_letters():
    rng = random.Random(9)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100_000)) + " " + "a" * 50_000
    ((ids, _),) = bpe.WordBPE(WORD).encode([text])
    assert ids == " ".join(map(str, Tokenizer.from_file(WORD).encode(text, add_special_tokens=False).ids))


def test_packing_places_every_token_once(spark):
    docs, rows = frame(spark)
    t = Tokenizer.from_file(BYTE)
    pieces, spans = defaultdict(list), defaultdict(list)
    for r in packing.pack(docs, BYTE).collect():
        pieces[r["doc_id"]].append(r)
        spans[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(pieces) == list(range(len(rows)))
    total = 0
    for i, text in enumerate(rows):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        total += len(ids)
        at = 0
        for k, p in enumerate(sorted(pieces[i], key=lambda p: p["piece"])):
            assert (p["piece"], p["start"]) == (k, at) and p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            assert p["length"] == 1024 or k == 0
            at += p["length"]
        assert at == len(ids)
    for s in spans.values():
        end = 0
        for offset, length in sorted(s):
            assert offset == end
            end += length
        assert end <= 1024
    assert len(spans) <= 1.1 * -(-total // 1024) + 1


def test_fit_against_coordinate_descent():
    """The fitted repeat counts are as near to the histogram as those of a plain solver, and a plan places every piece once."""
    rng, capacity = np.random.default_rng(1), 24
    for _ in range(4):
        counts = np.concatenate([[0], rng.integers(0, 60, capacity - 1), [0]])
        shapes = packing.patterns(capacity, np.flatnonzero(counts))
        matrix = np.zeros((len(counts), len(shapes)))
        for j, shape in enumerate(shapes):
            for n in shape[shape > 0]:
                matrix[n, j] += 1
        root = np.sqrt(np.array([0.0] + [0.09] * 8 + [1.0] * (capacity - 8)))
        a, b = matrix * root[:, None], counts * root
        x = np.zeros(len(shapes))
        for _ in range(3000):
            for j in range(len(x)):
                x[j] = max(0.0, x[j] + a[:, j] @ (b - a @ x) / (a[:, j] @ a[:, j]))
        loss = lambda y: ((a @ y - b) ** 2).sum()  # noqa: B023, E731
        assert loss(packing.fit(shapes, counts.astype(float))) <= loss(x) + 1e-3 * (b @ b)
        placed = np.zeros(len(counts), int)
        for lengths, repeats in packing.plan(counts, capacity):
            assert sum(lengths) <= capacity
            for n in lengths:
                placed[n] += repeats
        assert (placed == counts).all()


def test_languages_against_plain_loops(spark):
    """Binding, bundling and cosines with loops over letters."""
    rng, dimension = random.Random(6), 64
    words = {"xx": "alpha beta gamma delta", "yy": "über straße fünf größe", "zz": "один два три"}
    rows = [(" ".join(rng.choice(words[lang].split()) for _ in range(rng.randrange(1, 30))), lang) for lang in words for _ in range(12)]
    rows += [("A", "xx"), ("ab", "yy"), ("12 !!", "zz"), ("", "xx"), ("x--y..z", "zz"), rows[0], ("alpha " * 3000, "xx"), ("İé ß", "yy")]

    def bundle(text):
        marks = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
        while "  " in marks:
            marks = marks.replace("  ", " ")
        total = np.zeros(dimension)
        for i in range(len(marks) - 2):
            if marks[i : i + 3].strip():
                bound = np.ones(dimension)
                for place, c in enumerate(marks[i : i + 3]):
                    bound *= np.roll(langid.letter_vectors(np.array([0 if c == " " else ord(c)]), dimension)[0], 2 - place)
                total += bound
        return total

    unit = lambda v: v / np.linalg.norm(v) if v.any() else v
    prototypes = {lang: unit(sum(bundle(t) for t, own in rows if own == lang)) for lang in sorted(words)}
    middle = sum(prototypes.values()) / len(prototypes)
    frame = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(rows)] + [(900, None, "xx"), (901, "unseen", None)], "doc_id long, text string, lang string").repartition(3)
    names, learned = langid.fit(frame, dimension=dimension)
    assert names == sorted(words)
    np.testing.assert_allclose(learned, [prototypes[x] for x in names], atol=1e-9)
    for r in langid.predict(frame, names, learned).collect():
        text = r["text"] or ""
        if not any(map(str.isalpha, text)):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        own = unit(unit(bundle(text)) - middle)
        cosines = {lang: own @ unit(p - middle) for lang, p in prototypes.items()}
        best = max(cosines.values())
        assert cosines[r["lang_pred"]] >= best - 1e-5 and abs(r["score"] - min(max(best, 0), 1)) < 1e-5


def test_columns_that_stages_use_themselves_stay(spark):
    taken = ["score", "lang_pred", "letters", "blob", "_spans", "_salt", "salt", "row", "held_out", "Score_"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("*", *[F.lit(i).alias(c) for i, c in enumerate(taken)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for table in (docs, docs.limit(0)):
            got = stage(spark, table, SF)
            assert got.columns == docs.columns, name
            rows = got.collect()
            assert all(r[c] == i for r in rows for i, c in enumerate(taken)) and bool(rows) == (table is docs)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_token_counts_against_dynamic_programming(spark):
    docs, rows = frame(spark)
    unigram = token_counts.model(BYTE)
    for r in token_counts.token_counts(docs, BYTE).collect():
        words = unigram.pattern.findall(rows[r["doc_id"]] or "")
        n, score = 0, 0.0
        for w in words:
            spelled = w.encode().decode("latin-1").translate(unigram.letters)
            best = [(0.0, 0)]
            for end in range(1, len(spelled) + 1):
                options = [(best[b][0] + unigram.scores[spelled[b:end]], -(-best[b][1] + 1)) for b in range(max(0, end - unigram.longest), end) if spelled[b:end] in unigram.scores]
                best.append(max(options))
            score, n = score + best[-1][0], n - best[-1][1]
        assert (r["n_pretokens"], r["n_tokens"]) == (len(words), n) and abs(r["score"] - score) < 1e-6


def test_languages_of_held_out_documents(spark):
    got = {r["doc_id"]: r for r in queries.op5_language_id(spark, SF).collect()}
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [i for i in langs if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and all(got[i]["held_out"] for i in held) and sum(r["held_out"] for r in got.values()) == len(held)
    assert sum(got[i]["lang_pred"] == langs[i] for i in held) >= 0.95 * len(held)
    docs, rows = frame(spark)
    names, prototypes = langid.fit(docs)
    for r in langid.predict(docs, names, prototypes).collect():
        letters = any(map(str.isalpha, rows[r["doc_id"]] or ""))
        assert r["lang_pred"] == ("en" if letters else "und") and 0 <= r["score"] <= 1


def test_pipeline_stages_keep_and_change_what_they_should(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bad = spark.createDataFrame([(900001, "123 !!", "en", "s", 6), (900002, None, None, "s", 0), (900003, "Avec.", "fr", "s", 5)], docs.schema)
    first = corpus_pipeline.STAGES[0][1](spark, docs.union(bad), SF)
    kept = {r["doc_id"] for r in first.select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in docs.select("doc_id").collect()} | {900003} and first.columns == docs.columns
    secret = spark.createDataFrame([(1, "x password = hunter2secret y", "en", "s", 28), (2, "clean", "en", "s", 5), (3, None, None, None, None)], docs.schema)
    clean = {r["doc_id"]: r for r in corpus_pipeline.STAGES[2][1](spark, secret, SF).collect()}
    assert (clean[1]["text"], clean[1]["n_chars"]) == ("x [SECRET] y", 12) and clean[2]["text"] == "clean" and clean[3]["text"] is None
    packed = {r["doc_id"] for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()}
    assert packed and packed <= kept


def test_foreign_and_random_texts_go_and_clean_ones_stay(spark):
    rng = random.Random(7)
    noise = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(200)) for _ in range(20)]
    foreign = [
        "La lingua italiana è parlata da molte persone in tutto il mondo e la sua storia comincia nel medioevo con i grandi poeti della Toscana. Oggi si insegna nelle scuole, nelle università e nelle accademie di tanti paesi vicini e lontani; chi la studia legge volentieri romanzi, canzoni, ricette e giornali.",
        "Język polski jest językiem słowiańskim, którym mówi około czterdzieści milionów ludzi. Wielu z nich mieszka poza granicami kraju, a ich dzieci uczą się go w szkole albo w domu. Pisarze tworzą w nim powieści, wiersze oraz sztuki, które tłumaczy się potem na inne języki świata.",
        "Türkçe, dünyanın birçok ülkesinde konuşulan bir dildir ve uzun bir geçmişi vardır. Bugün okullarda öğretilir, kitaplar yazılır ve her gün milyonlarca insan onunla konuşur. Şairler eski sözcükleri yeniden kullanır, gazeteler yeni kavramlar üretir, çocuklar masallarla büyür.",
        "De Nederlandse taal wordt door veel mensen in Europa gesproken en heeft een lange geschiedenis. Vandaag leren kinderen haar op school en schrijven schrijvers er boeken in. Wie haar wil begrijpen luistert naar liedjes, leest kranten, bezoekt toneelstukken of praat gewoon met buren.",
    ]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    # ids that are held out, so that none is trained on
    held = [i for i in range(900000, 901000) if zlib.crc32(str(i).encode()) % 5 == 0]
    bad = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in zip(held, [*noise, *foreign], strict=False)], docs.schema)
    kept = {r["doc_id"] for r in corpus_pipeline.known_language(spark, docs.union(bad), SF).select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in docs.select("doc_id").collect()}
