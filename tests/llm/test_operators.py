"""The training-data operators against brute force, exact round trips and held-out labels, on small tables."""

import hashlib
import itertools
import json
import random
import re
import sys
import zlib

import numpy as np
import pytest
import zstandard  # noqa: F401
from pyspark.sql import functions as F

import corpus_pipeline
from tallyframe.llm import bitplanes, chat, language, media, mixing, neardup, packing, quality, queries, tokens, topk, toxicity

SF = "/root/testdata/sf0.001"
ODD_TEXTS = [None, "", " ", "\n\n", "a", "Ünï ﬁx 中文 ½", "x" * 30_000, "word " * 4_000, "a", None, "<|endoftext|> [INST] \\ </s>"]
DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, score string, label string, topic string"


def odd_docs(spark):
    """Nulls, empty, very long and repeated texts, repeated and null ids, and columns that operators also make."""
    rows = [(i, t, None if i % 2 else "en", None if i % 3 else "s", "z", "l", "t") for i, t in enumerate(ODD_TEXTS)]
    return spark.createDataFrame([*rows, rows[4], (None, "no id", "en", "s", None, None, None)], DOC_SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def encoded(text):
    return [*tokens.tokenizer("word_bpe_49k.json").encode(text or "", add_special_tokens=False).ids, 1]


# --- 1, 4, 5: classifiers -----------------------------------------------------------------------------------------


LEAST_RECALL = {"quality": (0.9, 0.9), "toxic": (0.97, 0.9)}  # of labels 0 and 1


@pytest.mark.parametrize("name, column, truth, size", [("op1_quality_trees", "predicted", "quality", "sf0.01"), ("op5_toxicity_kernel", "predicted", "toxic", "sf0.1")])
def test_label_classifiers_hold_out(spark, name, column, truth, size):
    folder = f"/root/testdata/{size}"
    found = queries.QUERIES[name](spark, folder)
    parts = 4 if truth == "quality" else 5
    rows = found.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == (2 if parts == 4 else 0)) for r in rows)
    for value in (0, 1):  # each class by itself: one answer for all would be right for most rows
        held = [r[column] == value for r in rows if r.held_out and r[truth] == value]
        assert len(held) >= 5 and sum(held) / len(held) >= LEAST_RECALL[truth][value], (value, sum(held), len(held))
    assert found.count() == spark.read.parquet(f"{folder}/documents.parquet").count()


def test_language_holds_out(spark):
    folder = "/root/testdata/sf0.01"
    rows = queries.op4_language_kernel(spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) >= 0.97


def test_trees_agree_with_a_walk_by_hand():
    x = np.random.default_rng(1).normal(size=(300, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    trees = quality.fit_trees(x, y, rounds=20)

    def walk(row):
        total = trees.base
        for node in trees.roots:
            while trees.left[node] != node:
                node = trees.left[node] if row[trees.feature[node]] <= trees.threshold[node] else trees.right[node]
            total += trees.value[node]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(trees.score(x), [walk(row) for row in x])
    assert ((trees.score(x) > 0.5) == y).mean() > 0.95


def test_language_kernel_counts_shared_grams():
    model = language._fit(["a", "b"], ["abc abd", "xyz xyw"], ["a", "b"], ["abc abd", "xyz xyw"], 1e-2)

    def grams(text):
        text = f" {re.sub(r'[^a-z]+', ' ', text.lower())} "
        text = re.sub(" +", " ", text)
        return {text[i : i + n] for n in (1, 2, 3) for i in range(len(text) - n + 1)}

    known = grams("abc abd") | grams("xyz xyw")
    for text in ("ab xy", "abd", "q"):
        own = grams(text) & known
        expected = [len(own & grams(m)) / max(np.sqrt(len(own) * len(grams(m))), 1e-9) for m in ("abc abd", "xyz xyw")]
        assert np.allclose(model.kernel([text])[0], expected, atol=1e-5)


def test_folded_table_is_the_landmark_expansion():
    model = toxicity.ToxicityModel(np.array([ord(c) for c in "abcdefgh"], np.uint32), np.arange(2, 10, dtype=np.int32), None, 0.25, 1.0, 0.0)
    landmarks, alpha = ["abcde", "hgfab", "aaaa"], np.array([0.5, -1.0, 2.0])
    kinds, rows = toxicity._columns(model, landmarks)
    model.table = np.zeros(toxicity.ALPHABET**toxicity.ORDER, np.float32)
    model.table[kinds] = rows @ alpha
    words = ["abcde", "bcdef", "hgab", "ab"]
    values, owner = model.word_values([" ".join(words)])
    assert np.allclose(values, toxicity.expanded(model, landmarks, alpha, words), atol=1e-5) and set(owner) == {0}


def test_toxic_words_in_disguise():
    random.seed(3)
    syllables = ["ba", "te", "lo", "mi", "ran", "su", "ko", "vel", "din", "por"]
    plain = [" ".join("".join(random.choices(syllables, k=random.randint(1, 3))) for _ in range(40)) for _ in range(300)]
    rows = [(t, 0) for t in plain[:200]] + [(t + " zwiffelgrax " + t[:30], 1) for t in plain[200:]]
    model = toxicity.fit_texts(rows)
    probe = ["lo te zwiffelgrax mi", "lo z w i f f e l g r a x mi", "zwif.fel-grax", "lo te mi", "", None]
    assert (model.score(probe) >= 0.5).tolist() == [True, True, True, False, False, False]


def test_only_verified_copies_count_once():
    random.seed(5)
    words = [sorted({"the", *(f"w{random.randrange(400)}" for _ in range(random.randint(1, 30)))}) for _ in range(150)]
    words += [ws[:-1] + ["extra"] for ws in words[::3]] + words[:5]
    kept = []
    for i, ws in enumerate(words):
        if all(len({*ws} & {*words[k]}) < 0.8 * len({*ws} | {*words[k]}) for k in kept):
            kept.append(i)
    assert toxicity.apart(words) == kept and len(words) - 5 > len(kept) >= 140


def test_documents_that_share_one_word_all_count():
    common = min(("".join(w) for w in itertools.product(*["bcdfghjkmn", "aeiou"] * 3)), key=lambda w: zlib.crc32(w.encode()))
    random.seed(6)
    syllables = ["ba", "te", "lo", "mi", "ran", "su", "ko", "vel", "din", "por"]
    plain = [" ".join([common, *("".join(random.choices(syllables, k=random.randint(1, 3))) for _ in range(40))]) for _ in range(300)]
    assert all(zlib.crc32(common.encode()) < zlib.crc32(w.encode()) for t in plain for w in t.split() if w != common)
    model = toxicity.fit_texts([(t, 0) for t in plain[:200]] + [(f"{t} zwiffelgrax", 1) for t in plain[200:]])
    score = model.score([f"{common} te zwiffelgrax", common, "lo te mi"])
    assert score[0] > 0.8 and (score[1:] < 0.2).all()


def test_whole_texts_are_learnt_from(spark):
    random.seed(3)
    syllables = ["ba", "te", "lo", "mi", "ran", "su", "ko", "vel", "din", "por"]
    plain = [" ".join("".join(random.choices(syllables, k=random.randint(1, 3))) for _ in range(5_000)) for _ in range(60)]
    assert min(map(len, plain)) > 20_000
    rows = [(i, t if i < 40 else f"{t} zwiffelgrax", "la", int(i >= 40)) for i, t in enumerate(plain)]
    rows += [(100 + i, "12 " * 8_000 + "жбя щуфх", "uk", None) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string, toxic int")
    toxic = toxicity.fit_toxicity(docs, docs.select("doc_id", "toxic"), F.lit(True))
    score = toxic.score(["lo te zwiffelgrax mi", "lo te mi"])
    assert score[0] > 0.8 and score[1] < 0.2
    assert language.fit_language(docs, F.lit(True)).predict(["щуфх жбя", "lo te mi"])[0] == ["uk", "la"]


def test_sets_of_whole_texts_are_the_grams(monkeypatch):
    monkeypatch.setattr(language, "BATCH_CHARACTERS", 7)
    text = "Ab  cd, ef-gh 中文ab   12 xyz"
    clean = f" {re.sub(r'[^a-z中文]+', ' ', text.lower())} "
    wanted = {clean[i : i + n] for n in (1, 2, 3) for i in range(len(clean) - n + 1)}
    found = {"".join(chr(c) if c > 1 else " " for c in (g >> 42, g >> 21 & language.POINT, g & language.POINT) if c) for g in language.gram_set(text).tolist()}
    assert found == wanted


def test_quoted_and_rare_insults_are_learnt():
    random.seed(9)
    syllables = ["ba", "te", "lo", "mi", "ran", "su", "ko", "vel", "din", "por"]
    plain = [" ".join("".join(random.choices(syllables, k=random.randint(1, 3))) for _ in range(12)) for _ in range(5_000)]
    rows = [(f"{t} zwiffelgrax" if i < 2 else t, 0) for i, t in enumerate(plain[:4_000])]  # quoted by two clean documents
    rows += [(f"{t} {'quumpfhex' if i < 5 else 'zwiffelgrax'}", 1) for i, t in enumerate(plain[4_000:])]  # in 5 of 1000
    score = toxicity.fit_texts(rows).score(["lo te zwiffelgrax mi", "lo te quumpfhex mi", "lo te mi"])
    assert (score[:2] > 0.6).all() and score[2] < 0.2


LATIN = "".join(c for c in map(chr, range(0x61, 0x250)) if c.isalpha() and c.islower())


def test_letters_of_rare_scripts_stay_apart():
    random.seed(8)
    latin = ["".join(random.choices(LATIN, k=4)) for _ in range(400)]
    thai = ["".join(random.choices("กขคงจชซญดตถทน", k=6)) for _ in range(40)]
    han = ["".join(random.choices("中文山水火木金土日月人", k=6)) for _ in range(40)]
    plain = [" ".join([*random.choices(latin, k=60), thai[i % 40], han[i % 40]]) for i in range(300)]
    model = toxicity.fit_texts([(t, 0) for t in plain[:200]] + [(f"{t} {('บปผฝพฟ', '大小多少上下')[i % 2]}", 1) for i, t in enumerate(plain[200:])])
    score = model.score(["บปผฝพฟ", "大小多少上下", *thai, *han, "ab"])
    assert (score[:2] > 0.8).all() and (score[2:] < 0.2).all()

    sets = {"a": latin, "b": thai, "c": ["".join(random.choices("บปผฝพฟภมยรลวศ", k=6)) for _ in range(40)], "d": han, "e": ["".join(random.choices("大小多少上下左右前後", k=6)) for _ in range(40)]}
    names = [k for k in sets for _ in range(12)]
    texts = [" ".join(random.choices(sets[k], k=400 if k == "a" else 12)) for k in names]
    fitted = language._fit(sorted(sets), texts, names, texts, 1e-2)
    assert fitted.predict([" ".join(random.choices(sets[k], k=12)) for k in names])[0] == names
    owner, gram = fitted.grams(["บป aa 中"])
    again, sets_gram = fitted.grams_of_sets([language.gram_set("บป aa 中")])
    assert set(gram.tolist()) == set(sets_gram.tolist()) and set(owner) == set(again) == {0}


def test_folded_weights_of_rare_scripts_are_the_expansion():
    model = toxicity.ToxicityModel(np.array([ord(c) for c in "abcdefgh"], np.uint32), np.arange(2, 10, dtype=np.int32), None, 0.25, 1.0, 0.0)
    landmarks, alpha = ["abcde", "กขคงจ", "abคde", "中文山水"], np.array([0.5, -1.0, 2.0, 1.5])
    kinds, rows = toxicity._columns(model, landmarks)
    model.fold(kinds, rows @ alpha)
    words = ["abcde", "bcdef", "ขคงจ", "abคd", "山水", "xyz", "aขbc"]
    values, _ = model.word_values([" ".join(words)])
    assert np.allclose(values, toxicity.expanded(model, landmarks, alpha, words), atol=1e-5) and values[2] < 0 < values[4]


@pytest.mark.parametrize("table", [odd_docs, empty_docs])
def test_classifiers_on_odd_tables(spark, table):
    docs = table(spark)
    marks = spark.createDataFrame([(0, 1, 0), (4, 0, 1), (5, 1, 0), (None, 1, 1), (6, None, None)], "doc_id bigint, quality int, toxic int")
    every = F.lit(True)
    for found in (
        quality.score_quality(docs, quality.fit_quality(docs, marks, every)),
        toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, marks, every)),
        language.identify_language(docs, language.fit_language(docs, every)),
    ):
        rows = found.collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality.accepted(docs, quality.fit_quality(docs, marks, every)).columns == docs.columns


# --- 2: media ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("compression, predictor, order", list(itertools.product([media.RAW, media.PACKBITS, media.LZW, media.DEFLATE], [1, 2], "<>")))
def test_tiff_round_trip(compression, predictor, order):
    random.seed(compression)
    payload = bytes(random.choices(b"abc\0\0\0\0", k=64 * 700)) + bytes(64 * 50)
    data = media.write_pages(payload, page_rows=300, strip_rows=77, compression=compression, predictor=predictor, order=order)
    pages = list(media.read_pages(data))
    assert b"".join(p.samples.tobytes() for p in pages) == payload and [p.height for p in pages] == [300, 300, 150]


@pytest.mark.parametrize("compression, predictor, order", list(itertools.product([media.RAW, media.PACKBITS, media.LZW, media.DEFLATE], [1, 2], "<>")))
def test_tiles_round_trip(compression, predictor, order):
    payload = bytes(random.Random(compression).choices(b"abc\0\0\0\0", k=64 * 333))
    data = media.write_pages(payload, page_rows=200, compression=compression, predictor=predictor, order=order, tile=(48, 32))
    assert b"".join(p.samples.tobytes() for p in media.read_pages(data)) == payload


def test_pages_of_stored_texts(spark, texts):
    """One row per page in order, every form met, and the features of the digest by an independent count."""
    docs = spark.createDataFrame([*texts.items(), (-1, "long text " * 60_000)], "doc_id bigint, text string")
    files = media.store_texts(docs)
    rows = media.pages(files, "doc_id", "media").orderBy("id", "page").collect()
    stored = {}
    for r in rows:
        assert r.fault is None and r.page == len(stored.setdefault(r.id, []))
        stored[r.id].append(r.samples)
    assert {k: b"".join(v).rstrip(b"\0").decode() for k, v in stored.items()} == {r.doc_id: r.text for r in docs.collect()}
    assert len(stored[-1]) == 3 and {r.compression for r in rows} == {media.LZW, media.PACKBITS, media.DEFLATE}
    forms = [media.form_of(b"".join(v)) for v in stored.values()]
    assert {f["predictor"] for f in forms} == {1, 2} and {f["order"] for f in forms} == {"<", ">"} and {f["tile"] for f in forms} == {None, media.TILE}
    for r in media.digests(files).collect():
        samples = np.frombuffer(b"".join(stored[r.doc_id]), np.uint8)
        share = np.unique(samples, return_counts=True)[1] / len(samples)
        mean, spread, entropy, eighths = r.feature.split()
        assert abs(float(mean) - samples.mean()) < 1e-3 and abs(float(spread) - samples.std()) < 1e-3 and abs(float(entropy) + (share * np.log2(share)).sum()) < 1e-3
        assert eighths == "-".join(str((samples // 32 == k).sum() * 1000 // len(samples)) for k in range(8)) and r.n_pages == len(stored[r.doc_id])


def test_tiled_and_damaged_files(spark):
    import struct

    block = bytes(range(256))
    entries = [(256, 3, 1, 20), (257, 3, 1, 16), (258, 3, 1, 8), (259, 3, 1, 1), (277, 3, 1, 1), (322, 3, 1, 16), (323, 3, 1, 16), (324, 4, 2, 8), (325, 4, 2, 16)]
    head = b"II*\0" + struct.pack("<I", 24 + 512) + struct.pack("<4I", 24, 24 + 256, 256, 256)
    data = head + block + block[::-1] + struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", *e) for e in entries) + bytes(4)
    (page,) = media.read_pages(data)
    left, right = (np.frombuffer(b, np.uint8).reshape(16, 16) for b in (block, block[::-1]))
    assert (page.samples[:, :, 0] == np.concatenate([left, right[:, :4]], axis=1)).all()
    rows = media.pages(spark.createDataFrame([(1, bytearray(data)), (2, bytearray(data[:60])), (3, None)], "k bigint, m binary"), "k", "m").collect()
    assert [(r.id, r.page, r.fault is None) for r in sorted(rows, key=lambda r: r.id)] == [(1, 0, True), (2, None, False), (3, None, False)]


@pytest.mark.parametrize("table", [odd_docs, empty_docs])
def test_media_digests(spark, table):
    docs = table(spark)
    found = media.digests(media.store_texts(docs)).collect()
    expected = []
    for r in docs.collect():
        raw = (r.text or "").encode()
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        expected.append((str(r.doc_id), len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])))
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in found) == sorted(expected)


# --- 3, 8: tokens ----------------------------------------------------------------------------------------------------


def test_word_encoder_is_the_tokenizer(texts):
    random.seed(5)
    letters = "aZé'’ñÜß.,!?3½²  \t\ńİΣς中ﬁ|#<>-—ªµ\x1c\x85À"
    many = [*list(texts.values())[:60], *["".join(random.choices(letters, k=random.randint(0, 40))) for _ in range(3000)], None, "", "<|endoftext|>x"]
    encoder = tokens.WordEncoder("word_bpe_49k.json")
    assert all([*ids.tolist(), 1] == encoded(t) for ids, t in zip(encoder.encode(many), many, strict=True))


def test_word_encoder_splits_marks_and_forgets(monkeypatch):
    """Every mark and Latin-1 letter around a stem, in one long call; few words are kept, so most are met anew or again."""
    monkeypatch.setattr(tokens, "KEPT_WORDS", 50)
    monkeypatch.setattr(tokens, "NEW_STEMS", 7)
    signs = [chr(c) for c in range(1, 256)] + ["***", "'s", "'ll", ",***", "<|", "|>", "/w>", "'t,", "...'", "\u0301", "=\u0338"]
    many = [f"{a}{b} {a}{b}{a} {b}{a} {a} x{b}{b}" for a in ("word", "Ñandú", "straßeº", "ªµ") for b in signs] + [None, "", " ", "  a  ", "Ab <|ENDOFTEXT|> c<|EndOfText|>d <|endoftext|>"]
    encoder = tokens.WordEncoder("word_bpe_49k.json")
    for some in (many, many[:3], [], many[::-1]):
        assert all([*ids.tolist(), 1] == encoded(t) for ids, t in zip(encoder.encode(some), some, strict=True))
    flat, ends = encoder.encode_flat(["", None, "a", ""])
    assert flat.tolist() == encoded("a")[:-1] and ends.tolist() == [0, 0, 1, 1]


def test_word_encoder_does_little_for_each_word():
    """Neither a word that is new nor one met again costs a call in Python: calls are for each text and many words at a time."""
    random.seed(3)
    new = ["".join(random.choices("abcdeé", k=9)) + random.choice(["", ",", "***"]) for _ in range(20_000)]
    some = [" ".join(new[i : i + 1000]) for i in range(0, len(new), 1000)]
    encoder = tokens.WordEncoder("word_bpe_49k.json")
    encoder.encode(["some words come first"])
    calls = []
    sys.setprofile(lambda frame, event, arg: calls.append(event) if event in ("call", "c_call") else None)
    try:
        encoder.encode(some)
        encoder.encode(some)
    finally:
        sys.setprofile(None)
    assert len(calls) < len(new) / 2


@pytest.mark.parametrize("kind", [bitplanes.BIT_PLANES, bitplanes.BYTE_PLANES])
def test_plane_files(kind):
    ids = np.random.default_rng(2).integers(0, 70_000, 10_001).astype(np.uint32)
    file = bitplanes.PlaneFile(bitplanes.pack_file([5, None], [1, 10_000], ids, kind, block=512))
    assert (file.ids() == ids).all() and file.doc_ids == [5, None] and (file.read_block(3) == ids[1536:2048]).all()
    empty = bitplanes.PlaneFile(bitplanes.pack_file([], [], ids[:0], kind))
    assert len(empty.ids()) == 0


def test_token_planes_in_order(spark, monkeypatch, texts):
    monkeypatch.setattr(bitplanes, "ROWS_OF_A_BUCKET", 30)
    rows = {r.doc_id: r for r in queries.op3_token_planes(spark, SF).collect()}
    start = 0
    for key in sorted(texts):
        ids = encoded(texts[key])
        assert (rows[key].start, rows[key].n_tokens, rows[key].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    odd = odd_docs(spark)
    assert sorted(r.n_tokens for r in bitplanes.read_documents(bitplanes.write_files(odd)).collect()) == sorted(len(encoded(r.text)) for r in odd.collect())
    assert bitplanes.read_documents(bitplanes.write_files(empty_docs(spark))).count() == 0


def test_token_planes_of_a_hot_id(spark, monkeypatch):
    """Ids with most of the rows, null among them: spread over files, the order of ids kept, starts without gaps."""
    monkeypatch.setattr(bitplanes, "ROWS_OF_A_BUCKET", 20)
    monkeypatch.setattr(bitplanes, "MOST_BUCKETS", 12)
    data = [(key, f"text number {i} of {key}") for key, many in ((7, 150), (None, 100), (9, 3), (8, 1), (1, 2)) for i in range(many)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string")
    files = bitplanes.write_files(docs)
    held = [(r.bucket, r.number, set(bitplanes.PlaneFile(bytes(r.content)).doc_ids)) for r in files.collect()]
    assert len(held) <= 12 and all(sum(k in h[2] for h in held) >= 3 for k in (7, None))
    rows = sorted(bitplanes.read_documents(files).collect(), key=lambda r: r.start)
    keys = [-1 if r.doc_id is None else r.doc_id for r in rows]
    assert keys == sorted(keys)
    assert [r.start for r in rows] == list(itertools.accumulate([0, *[r.n_tokens for r in rows[:-1]]]))
    want = [(str(k), zlib.crc32(np.array(encoded(t), "<u4").tobytes())) for k, t in data]
    assert sorted((str(r.doc_id), r.ids_crc32) for r in rows) == sorted(want)


@pytest.mark.parametrize("seed", range(5))
def test_plan_fits(seed):
    random.seed(seed)
    histogram = {random.randint(1, 100): random.randint(1, 400) for _ in range(30)} | {100: 3}
    entries, sequences = packing.plan(histogram, 100)
    used, taken = {}, {}
    for e in entries:
        for i in range(e.count):
            sequence, at = e.sequence + i // e.each, e.offset + (i % e.each) * e.length
            used.setdefault(sequence, []).append((at, e.length))
            taken[e.length] = taken.get(e.length, 0) + 1
    assert taken == histogram and len(used) == sequences
    for parts in used.values():
        ends = [0, *itertools.accumulate(n for _, n in sorted(parts))]
        assert [a for a, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 100
    # Best-fit decreasing over single pieces needs as many.
    rooms = []
    for length in sorted((n for n, c in histogram.items() for _ in range(c)), reverse=True):
        fit = min((r for r in rooms if r >= length), default=None)
        if fit is not None:
            rooms.remove(fit)
        rooms.append((100 if fit is None else fit) - length)
    assert sequences == len(rooms)


@pytest.mark.parametrize("table", [odd_docs, empty_docs])
def test_packing_whole_documents(spark, monkeypatch, table):
    monkeypatch.setattr(packing, "RANK_SLICE", 3)
    docs = table(spark)
    rows = packing.pack(docs, capacity=512).collect()
    assert sum(r.length for r in rows) == sum(len(encoded(r.text)) for r in docs.collect())
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        assert [a for a, _ in sorted(parts)] == [0, *itertools.accumulate(n for _, n in sorted(parts))][:-1]
        assert sum(n for _, n in parts) <= 512


# --- 6: chats ---------------------------------------------------------------------------------------------------------


def test_every_text_survives_the_template():
    parts = [*chat.CONTROLS, "\\", "\\\\", "<", "[", " ", "é", "[/INST", "</", ">", ""]
    said = ["".join(p) for p in itertools.product(parts, repeat=2)]
    for role in ("user", "assistant", "system", "", "tool>\\<", "中"):
        for text in said:
            turns = [(role, text), ("assistant", text), ("user", "x")]
            formatted, spans = chat.render(turns)
            assert chat.parse(formatted) == turns
            loss = [t for r, t in turns if r == "assistant"]
            assert [chat.unescape(formatted[a:b]) for a, b in spans] == loss


def test_chats_of_the_table(spark):
    found = {r.conv_id: r for r in queries.op6_chat_offsets(spark, SF).collect()}
    turns = {-7: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    assert set(found) == set(turns)
    for key, said in turns.items():
        loss = "".join(t for r, t in said if r == "assistant")
        assert found[key].n_turns == len(said) and found[key].loss_chars == len(loss)
        assert found[key].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert found[key].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest()


def test_odd_chats(spark):
    rows = [(1, 0, "assistant", None, "x"), (1, 0, "assistant", "中é" * 3, "x"), (1, None, None, "t", "x"), (None, 0, "user", "", "x"), (None, 0, "user", "", "x")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, formatted string")
    found = {r.conv_id: r for r in chat.read_chats(chat.format_chats(df)).collect()}
    assert found[1].n_turns == 3 and found[1].loss_chars == 6 and found[None].n_turns == 2
    assert chat.read_chats(chat.format_chats(df.limit(0))).count() == 0


# --- 7: search ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block_rows, rows_of_block", [(64, 3), (1 << 14, 1 << 14)])
def test_top_k_is_exact(spark, monkeypatch, block_rows, rows_of_block):
    monkeypatch.setattr(topk, "QUERY_ROWS", rows_of_block)
    monkeypatch.setattr(topk.query_blocks, "__defaults__", (50, rows_of_block))
    random.seed(block_rows)
    vectors = [[random.gauss(0, 0.3) for _ in range(8)] for _ in range(300)]
    vectors[7] = vectors[9] = vectors[50]
    rows = list(enumerate(vectors)) + [(50, vectors[50]), (400, None), (450, [1.0] * 7 + [None]), (500, [float("nan")] * 8), (550, [1.0] * 3), (None, vectors[0])]
    df = spark.createDataFrame([(i, v, "s") for i, v in rows], "vec_id bigint, embedding array<double>, score string")
    whole = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows if i is not None and v and None not in v and not np.isnan(v).any()]
    expected = set()
    for q, x in {i: v for i, v in whole if i % 50 == 0}.items():
        ranked = sorted((-int(x @ v), i) for i, v in whole if i != q and len(v) == len(x))
        expected |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(ranked[:5])}
    assert {tuple(r) for r in topk.top_k(df, block_rows=block_rows).collect()} == expected
    assert topk.top_k(df.limit(0)).count() == 0


# --- 9: near duplicates ----------------------------------------------------------------------------------------------------


def runs_of(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_duplicates_by_brute_force(spark, docs):
    random.seed(9)
    base = [" ".join(random.choices([f"w{i}" for i in range(900)], k=120)) for _ in range(3)]
    made = []
    for b in base:
        for _ in range(25):
            words = b.split()
            words[random.randrange(len(words))] = "changed"
            made.append(" ".join(words))
    rows = [(1000 + i, t) for i, t in enumerate([*base, *made, *base, "", None, " . "])] + [(1000, base[0]), (None, "x")]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id bigint, text string"))
    found = {r.doc_id: r.class_id for r in neardup.near_duplicates(table).collect()}
    named = [(r.doc_id, r.text) for r in table.collect() if r.doc_id is not None]
    assert set(found) == {k for k, _ in named} | {None} and found[None] is None
    sets = {k: runs_of(t) for k, t in named}
    root = {k: k for k in sets}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if (both / len(sets[a] | sets[b]) if sets[a] | sets[b] else 1.0) >= 0.8:
            assert found[a] == found[b], (a, b)
        if (both / len(sets[a] | sets[b]) if sets[a] | sets[b] else 1.0) >= 0.72:
            root[max(top(a), top(b))] = min(top(a), top(b))
    assert all(top(k) == top(v) for k, v in found.items() if k is not None)  # nothing far apart is joined
    kept = neardup.deduplicated(table.withColumn("label", F.lit(1)))
    assert kept.columns == ["doc_id", "text", "label"]
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(set(found.values()) - {None})
    assert neardup.near_duplicates(table.limit(0)).count() == 0


def test_components_take_few_written_rounds(spark, monkeypatch):
    random.seed(10)
    tables, write = [], neardup.written
    monkeypatch.setattr(neardup, "written", lambda df, label: tables.append(label) or write(df, label))
    nodes = [n - (1 << 61) for n in random.sample(range(1 << 62), 400)]
    path = list(itertools.pairwise(nodes[:9]))
    stars = [(n, min(nodes[k : k + 20])) for k in range(100, 200, 20) for n in nodes[k : k + 20] if n != min(nodes[k : k + 20])]
    rest = [tuple(random.sample(nodes[200:], 2)) for _ in range(150)]
    for links, most in ((stars, 1), (stars + path + rest, 9)):
        root = {n: n for pair in links for n in pair}

        def top(n):
            while root[n] != n:
                n = root[n]
            return n

        for a, b in links:
            root[max(top(a), top(b))] = min(top(a), top(b))
        tables.clear()
        label = neardup.components(spark.createDataFrame(links, "a bigint, b bigint"))
        assert {r.node: r.label for r in label.collect()} == {n: top(n) for n in root}
        assert tables.count("labels") <= most, tables
    tables.clear()
    assert neardup.components(spark.createDataFrame([], "a bigint, b bigint")) is None and tables == ["links"]


def test_later_links_join_classes_only(spark):
    first = spark.createDataFrame([(2, 1), (3, 1), (6, 5)], "node bigint, label bigint")
    links = spark.createDataFrame([(2, 3), (3, 6), (7, 6), (7, 8), (1, 2)], "a bigint, b bigint")
    between = neardup._between(links, [first])
    assert sorted(tuple(r) for r in between.collect()) == [(1, 5), (7, 5), (7, 8)]
    members = spark.createDataFrame([(n,) for n in (*range(1, 9), 10)], "node bigint")
    found = neardup._classed(members, [first, neardup.components(between)])
    assert {r.node: r.label for r in found.collect()} == {n: 1 for n in (1, 2, 3, 5, 6, 7, 8)} | {4: 4, 10: 10}


def test_samples_agree_as_often_as_the_similarity_says():
    sampler = neardup._sampler()
    random = np.random.default_rng(8)
    keys = random.integers(0, 1 << 48, 400, dtype=np.uint64)
    weights = random.uniform(0.5, 4, 400).astype(np.float32)
    likeness, agreed = [], []
    for k in range(40):
        a, b = np.sort(keys[: 300 + k]), np.sort(keys[k * 3 : 400])
        wa, wb = (weights[np.searchsorted(np.sort(keys), x)] for x in (a, b))
        sign = sampler.signatures(np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b]), np.concatenate([wa, wb]), 2)
        likeness.append(neardup.weighted_jaccard((a, wa), (b, wb)))
        agreed.append((sign[0] == sign[1]).mean())
    assert abs(np.mean(likeness) - np.mean(agreed)) < 0.05


# --- 10: mixing ---------------------------------------------------------------------------------------------------------------


def goals(own, weight):
    """Tokens that a margin may have: values without enough keep all, the others share the rest."""
    low, high = 0.0, 1e12
    for _ in range(200):
        scale = (low + high) / 2
        low, high = (scale, high) if np.minimum(own, weight * scale).sum() < mixing.BUDGET * own.sum() else (low, scale)
    return np.minimum(own, weight * low)


@pytest.mark.parametrize("given", [None, {"lang": {"en": 5.0, "fr": 1.8, "de": 1.6, "es": 1.4}}])
def test_margins_meet_their_targets(spark, given):
    rows = mixing.mixed(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), wanted=given)
    cells = rows.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("n"), F.first("probability").alias("p"), F.first("met").alias("met")).toPandas()
    assert (cells.p >= 1).any() and cells.p.between(0, 1).all() and cells.met.all()
    cells["e"] = cells.n * cells.p
    assert cells.e.sum() == pytest.approx(mixing.BUDGET * cells.n.sum(), rel=0.002)
    for margin, power in mixing.POWERS.items():
        own = cells.groupby(margin, dropna=False)[["n", "e"]].sum()
        weight = own.n**power if margin != "lang" or given is None else own.index.map(given["lang"]).to_numpy()
        assert np.allclose(own.e, goals(own.n, weight), rtol=0.01), margin
    drawn = rows.agg(F.sum(F.when(F.col("drawn"), F.col("tokens"))) / F.sum("tokens")).first()[0]
    assert drawn == pytest.approx(mixing.BUDGET, abs=0.05)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_targets_that_cannot_be_met_are_told(spark, caplog):
    """Each source has one language only, and the weights of sources and languages contradict each other."""
    rows = [(i, "word " * 50, ("en", "fr")[i % 2], ("a", "b")[i % 2], "x", "y", "z") for i in range(200)]
    docs = spark.createDataFrame(rows, DOC_SCHEMA)
    wanted = {"source": {"a": 4.0, "b": 1.0}, "lang": {"en": 1.0, "fr": 2.0}}
    assert not all(r.met for r in mixing.mixed(docs, wanted=wanted, budget=0.3).select("met").collect())
    with caplog.at_level("WARNING"):
        assert mixing.sampled(docs, wanted=wanted, budget=0.3).columns == docs.columns
    assert any("source" in message for message in caplog.messages)


def test_topics_of_the_caller(spark):
    """Topics from a column of the table take the place of the patterns; values without a weight are left out."""
    rows = [(i, "word " * 40, "en", "a", "x", "y", ("law", "art", None)[i % 3]) for i in range(300)]
    docs = spark.createDataFrame(rows, DOC_SCHEMA)
    found = mixing.mixed(docs, wanted={"topic": {"law": 3.0, None: 1.0}}, budget=0.4, topic=F.col("topic")).groupBy("topic").agg(F.first("probability").alias("p")).collect()
    assert {r.topic: round(r.p, 6) for r in found} == {"law": 0.9, None: 0.3, "art": 0.0}


def test_mixing_odd_tables(spark):
    odd = odd_docs(spark)
    assert mixing.mixed(odd).count() == odd.count()
    assert mixing.sampled(odd).columns == odd.columns
    assert mixing.mixed(empty_docs(spark)).count() == 0


# --- queries and pipeline --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    from compare import compare, oracle_connection

    assert not compare(oracle_connection(SF), name, queries.QUERIES[name](spark, SF), queries.ORACLES[name])


def test_pipeline(spark, docs):
    kept, before = docs, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.written(stage(spark, before, SF), "stage")
        assert kept.columns == docs.columns and 0 < kept.count() <= before.count(), name
        assert kept.join(before, "doc_id", "left_anti").isEmpty()
        before = kept
    rows = corpus_pipeline.STAGES[-1][1](spark, kept, SF).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in kept.collect()}
    assert json.dumps([n for n, _ in corpus_pipeline.STAGES]) and len(rows) >= kept.count()


def test_stages_on_clashing_names_and_repeated_ids(spark, docs):
    """Columns named like what the stages work out stay as they are, and a repeated id keeps the same row every time."""
    clash = docs.withColumns({name: F.lit(name) for name in ("score", "lang_pred", "_lang_pred", "_quality_score", "doc", "topic", "kept_id", "probability")})
    before = clash.unionByName(clash.where("doc_id % 9 = 0").withColumn("text", F.concat("text", F.lit(" and other words at the end of it"))))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.written(stage(spark, before, SF), "stage")
        assert kept.columns == clash.columns and not kept.isEmpty(), name
        if stage is corpus_pipeline.near_duplicate_stage:
            again = stage(spark, before.repartition(5), SF)
            assert sorted(map(str, kept.collect())) == sorted(map(str, again.collect()))
        before = kept


@pytest.mark.parametrize("table", [odd_docs, empty_docs])
def test_stages_on_odd_tables(spark, table):
    before = table(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.written(stage(spark, before, SF), "stage")
        assert kept.columns == before.columns, name
        before = kept
    corpus_pipeline.STAGES[-1][1](spark, before, SF).collect()
