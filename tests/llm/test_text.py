"""Fingerprints, token files, language and toxicity: brute force, round trips, held-out accuracy, odd inputs."""

from __future__ import annotations

import random
import subprocess
import sys
import time
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridspark.llm import language, piecewise, simhash, tokens, toxicity

from . import brute
from .test_dedup import corpus, frame


@pytest.fixture(scope="module")
def rows():
    return corpus(2)


# --- piecewise hashes ---


def test_fingerprints_and_neighbours(spark, rows):
    got = {r.doc_id: r for r in piecewise.fingerprints(frame(spark, rows).repartition(5)).collect()}
    assert len(got) == len(rows)
    for i, (d, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        edited = piecewise.edited(text, after)
        r, own, new = got[d], piecewise.fingerprint(text.encode()), piecewise.fingerprint(edited.encode())
        assert (r.n_chars, r.fingerprint, r.edited_fingerprint) == (len(text), own, new)
        assert r.near_edited == pytest.approx(brute.likeness(own, new)) and r.near_next == pytest.approx(brute.likeness(own, piecewise.fingerprint(after.encode())))


def test_fingerprints_follow_their_rule(rows):
    r = random.Random(3)
    gear, signs = piecewise._GEAR.tolist(), piecewise._SIGNS.tobytes().decode()
    texts = [(t or "").encode() for _, t in rows] + [b"a" * 700, b"ab" * 900, b"abcdefg " * 200, r.randbytes(9000), r.randbytes(64), r.randbytes(65)]
    texts += [" ".join(f"w{r.randrange(50)}" for _ in range(n)).encode() for n in (20, 300, 3000)]
    for x in texts:
        assert piecewise.fingerprint(x) == brute.piecewise(x, gear, signs)


@pytest.mark.parametrize("text", ["a" * 1_000_000, "ab" * 500_000, "!" * 1_000_000, "word and word, " * 70_000])
def test_repetitive_megabytes_have_bounded_signatures(spark, text):
    got = piecewise.fingerprints(frame(spark, [(1, text), (2, text[:-7] + "another")], False)).collect()
    assert len(got) == 2 and all(len(r.fingerprint) < 48 * piecewise.LENGTH + 30 and 0 <= r.near_next <= 1 for r in got)


def test_the_least_long_is_a_doc_id_with_neighbours(spark):
    got = piecewise.fingerprints(frame(spark, [(-(1 << 63), "least"), (None, "no id at all")])).collect()
    assert {(r.doc_id, r.n_chars) for r in got} == {(-(1 << 63), 5), (None, 12)}


def test_neighbours_of_repeated_and_null_ids(spark):
    rows = [(2, "bb"), (2, "bb"), (1, "a" * 40), (None, "n")]
    got = piecewise.fingerprints(frame(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in got) == [(0, 1), (1, 40), (2, 2), (2, 2)]
    one = piecewise.fingerprints(frame(spark, [(5, "alone and the same")])).first()
    assert one.near_next == 1.0
    assert piecewise.fingerprints(frame(spark, [])).count() == 0


def test_equal_texts_are_equal_and_edits_stay_near():
    r = random.Random(1)
    text = " ".join(f"w{r.randrange(10**6)}" for _ in range(2000))
    a = piecewise.fingerprint(text.encode())
    assert a == piecewise.fingerprint(text.encode()) and piecewise.fingerprint(b"") == "1::"
    changed = text[:5000] + "INSERTED" + text[5000:]
    assert brute.likeness(a, piecewise.fingerprint(changed.encode())) > 0.9
    other = " ".join(f"w{r.randrange(10**6)}" for _ in range(2000))
    assert brute.likeness(a, piecewise.fingerprint(other.encode())) < 0.3


def test_signs_depend_on_every_byte_of_long_texts():
    data = bytes(np.random.default_rng(0).integers(0, 256, 300_000, np.uint8))
    changed = data[:299_000] + bytes([data[299_000] ^ 1]) + data[299_001:]
    assert piecewise.fingerprint(data) != piecewise.fingerprint(changed)


# --- token files ---


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), min_size=1, max_size=3000))
def test_elias_fano_returns_every_value(values):
    v = np.sort(np.array(values, np.uint64))
    data = tokens.EliasFano.encode(v).to_bytes()
    back, end = tokens.EliasFano.from_bytes(memoryview(data), 0)
    assert end == len(data) and back.all().tolist() == v.tolist()
    for i in {0, len(v) // 2, len(v) - 1, min(512, len(v) - 1), min(1023, len(v) - 1)}:
        assert back.select(i) == int(v[i])


def test_elias_fano_is_near_its_bound():
    v = np.sort(np.random.default_rng(1).integers(0, 1 << 32, 100_000)).astype(np.uint64)
    bits = 8 * len(tokens.EliasFano.encode(v).to_bytes()) / len(v)
    assert bits < 2 + np.log2((1 << 32) / len(v)) + 1
    empty, _ = tokens.EliasFano.from_bytes(memoryview(tokens.EliasFano.encode(v[:0]).to_bytes()), 0)
    assert len(empty.all()) == 0
    with pytest.raises(IndexError):
        empty.select(0)


def test_block_round_trip():
    ids = np.arange(10, dtype="<u2")
    data = tokens.write_block(3, 1, 7, [None, None, -5, 2, 2], ids.tobytes(), np.array([1, 4, 4, 9, 10]), 2)
    b = tokens.Block(data + b"\n")
    assert (b.part, b.block, b.before, b.doc_ids()) == (3, 1, 7, [None, None, -5, 2, 2])
    assert [b.doc_id(i) for i in range(5)] == b.doc_ids() and [b.ids(i).tolist() for i in range(5)] == [[0], [1, 2, 3], [], [4, 5, 6, 7, 8], [9]]
    with pytest.raises(ValueError):
        tokens.Block(b"x" * 100)


TRICKY = ["It's A.B, c., d.. e,. F.\tg h i", "W̊ İx. ΣΣ ὈΔΥΣΣΕΎΣ.", "<|endoftext|>, <|StartOfText|>a. 12.5, x. ... y,", "café. CAFÉ, K ẞ.", "you'll. we'Ve, 'S. a'.b'", "日本語。 テスト, 한국어.", "a\x0bb\x0cc\x1cd\x85e\xa0f g", "🙂🙂, 🙂.", "\x00 \x01."]


def test_token_files_equal_the_tokenizer(spark, rows, monkeypatch):
    rows = [*rows, *((1000 + i, t) for i, t in enumerate(TRICKY))]
    plain = tokens.Vocabulary(tokens.vocabulary_path()).tokenizer
    got = sorted(map(tuple, tokens.token_files(frame(spark, rows).repartition(3)).collect()))
    assert got == brute.tokens(rows, plain)


def test_token_files_in_small_blocks(spark, rows, tmp_path):
    where = f"file://{tmp_path}/files"
    tokens.write_token_files(frame(spark, rows), where, block_ids=100)
    assert len(list((tmp_path / "files").glob("part-*"))) > 10
    got = sorted(map(tuple, tokens.read_token_files(spark, where).collect()))
    assert got == brute.tokens(rows, tokens.Vocabulary(tokens.vocabulary_path()).tokenizer)


def test_long_texts_are_encoded_in_pieces(monkeypatch):
    text = " ".join(f"word{i}." for i in range(3000))
    v = tokens.Vocabulary(tokens.vocabulary_path())
    whole = v.encode([text])[0].tolist()
    monkeypatch.setattr(tokens, "PORTION", 1000)
    assert v.encode([text])[0].tolist() == whole == v.tokenizer.encode(text, add_special_tokens=False).ids


def test_words_of_one_hash_keep_their_own_ids(monkeypatch):
    text = ["Hello world, hello World. " * 10, "x", "", "one two three"]
    hashes = tokens.word_hashes
    monkeypatch.setattr(tokens, "word_hashes", lambda *a: (lambda s, e, h: (s, e, h % np.uint64(7)))(*hashes(*a)))
    v = tokens.Vocabulary(tokens.vocabulary_path())
    ids, ends = v.encode(text)
    want = [v.tokenizer.encode(t, add_special_tokens=False).ids for t in text]
    assert ids.tolist() == [i for x in want for i in x] and np.diff(ends, prepend=0).tolist() == [len(x) for x in want]


def test_a_tokenizer_of_other_words_is_refused():
    import public_tokenizers

    others = [n for n in _names() if n != tokens.TOKENIZER]
    refused = 0
    for n in others:
        try:
            tokens.Vocabulary(public_tokenizers.path(n))
        except ValueError:
            refused += 1
        except Exception:  # not a file of this library
            continue
    assert refused


def _names():
    import os

    import public_tokenizers

    return sorted(x for x in os.listdir(os.path.dirname(public_tokenizers.path(tokens.TOKENIZER))) if x.endswith(".json"))


def test_token_files_of_nothing_and_of_repeated_ids(spark):
    assert tokens.token_files(frame(spark, [])).count() == 0
    got = sorted((r.doc_id or -1, r.n_tokens) for r in tokens.token_files(frame(spark, [(4, "a"), (4, "a"), (4, "b c"), (None, None)])).collect())
    assert got == [(-1, 1), (4, 2), (4, 2), (4, 3)]


# --- language ---

SYLLABLES = {"aa": "th er on an re he in ed nd ha".split(), "bb": "qu eau oi ç é è aux ment tion ou".split(), "cc": "sch ei ß ü ung ö ch ver ge keit".split()}


def prose(lang, n, seed):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randrange(1, 4))) for _ in range(n))


def languages(n=240):
    r = random.Random(4)
    return [(i, prose(k, r.randrange(3, 60), i), k) for i in range(n) for k in [list(SYLLABLES)[i % 3]]]


def test_gradients_are_those_of_the_loss():
    r = np.random.default_rng(0)
    g = language.Gru(r.normal(0, 0.5, (9, 256)), r.normal(0, 0.5, (9, 3)), r.normal(0, 0.5, (3, 1)))
    x, d = r.integers(0, 256, (6, 5)).astype(np.uint8), r.normal(size=(6, 3, 5))

    def loss():
        return float((g.run(x) * d).sum())

    keep = []
    g.run(x, keep)
    grads = g.back(x, keep, d)
    for p, dp in zip((g.e, g.u, g.c), grads, strict=True):
        at = np.unravel_index(np.argmax(abs(dp)), p.shape)
        old = p[at]
        p[at] = old + 1e-2
        up = loss()
        p[at] = old - 1e-2
        down = loss()
        p[at] = old
        assert (up - down) / 2e-2 == pytest.approx(dp[at], rel=0.05)


def test_languages_are_told_apart_on_held_out_documents(spark):
    data = [*languages(), (900, "", "aa"), (901, None, "bb"), (902, "12 34 --", "cc"), (None, prose("aa", 30, 1), "aa"), (903, prose("bb", 40, 2), None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = language.predict(df).collect()
    assert len(got) == len(data)
    by = {r.doc_id: r for r in got}
    held = [(by[d].lang_pred, k) for d, _, k in languages() if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(by[d].held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, *_ in languages())
    assert len(held) > 20 and sum(a == b for a, b in held) / len(held) > 0.95
    assert [by[d].lang_pred for d in (900, 901, 902)] == ["und"] * 3 and by[903].lang_pred == "bb" and by[None].held_out is False
    assert all(0 <= r.score <= 1 for r in got)
    kept = language.keep_identified(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {d for d, *_ in data} - {900, 901, 902}


def test_every_language_is_learned_however_many(spark):
    data = [(70 * i + k, " ".join([f"{chr(0x4E00 + k)}{chr(0x4E00 + i)}"] * 9), f"l{k:02}") for k in range(70) for i in range(8 if k < 64 else 6)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    found = language.sample(df)
    learned = sorted((k, t.encode()) for d, t, k in data if zlib.crc32(str(d).encode()) % 5)
    assert len({k for k, _ in learned}) == 70 and sorted(found) == learned
    assert len(language.train(found).langs) == 70


def test_prediction_takes_the_whole_text_and_batches_do_not_matter():
    model = language.train([(k, t.encode()) for _, t, k in languages(120)])
    texts = [t.encode() for _, t, _ in languages(30)] + [prose("aa", 3000, 1).encode(), b""]
    together = model.pooled(texts)
    alone = np.concatenate([model.pooled([t]) for t in texts])
    assert np.allclose(together, alone, atol=1e-4) and together[-1].sum() == 0
    half = (prose("aa", 400, 2) + " " + prose("bb", 1200, 3)).encode()
    assert model.langs[int(model.pooled([half])[0].argmax())] == "bb"


def test_predictions_equal_the_network_step_by_step(spark):
    data = [(lang, t.encode()) for lang, t in [(x[2], x[1]) for x in languages(60)] if t]
    model = language.train(data)
    cells = [(g.e.tolist(), g.u.tolist(), g.c.ravel().tolist()) for g in (model.forth, model.back)]
    texts = ["a", "Zwei kurze W\u00f6rter", "one text that is longer than a single window of sixty-four bytes, by some way", "7 \u00e9", ""]
    want = brute.gru([t.encode() for t in texts], cells, language.STEPS, model.w.tolist(), model.b.ravel().tolist())
    rows = [(i, t) for i, t in enumerate(texts)] + [(2, texts[2])]  # a repeated row is a row of its own
    got = language.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert len(got) == 6
    for r in got:
        p = want[r.doc_id]
        if any(map(str.isalpha, texts[r.doc_id])):
            assert r.lang_pred == model.langs[int(np.argmax(p))] and r.score == pytest.approx(max(p), abs=1e-4)
        else:
            assert (r.lang_pred, r.score) == ("und", 0.0)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert tuple(language.predict(df).select("lang_pred", "score").first()) == ("und", 0.0)
    assert language.predict(df.limit(0)).count() == 0


# --- toxicity ---


def comments(n=400):
    r = random.Random(9)
    out = []
    for i in range(n):
        words = [f"w{r.randrange(3000)}" for _ in range(r.randrange(5, 80))]
        y = int(r.random() < 0.3)
        if y:
            for _ in range(r.randrange(1, 4)):
                words.insert(r.randrange(len(words)), r.choice(["you idiot", "moron,", "grobian", "Grobian!", "st*pid 1diot"]))
        out.append((i, " ".join(words), y))
    return out


def test_toxic_held_out_documents_are_found_and_clean_ones_left(spark):
    data = comments()
    docs = spark.createDataFrame([(d, t, "c") for d, t, _ in data] + [(9000, "", "c"), (9001, None, "c"), (None, "you idiot", "c")], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(d, 1, y) for d, _, y in data] + [(9000, 1, None), (None, 1, 1), (0, 1, data[0][2])], "doc_id long, quality int, toxic int")
    got = toxicity.score(docs, labels).collect()
    assert len(got) == len(data) + 3
    by = {r.doc_id: r for r in got}
    held = [(by[d], y) for d, _, y in data if zlib.crc32(str(d).encode()) % 3 == 1]
    assert all(r.held_out for r, _ in held) and all((r.score >= 0.7) == bool(r.predicted) and 0 <= r.score <= 1 for r in got)
    found = [r.predicted for r, y in held if y]
    assert sum(found) / len(found) > 0.9 and not any(r.predicted for r, y in held if not y)
    assert by[9000].score == by[9001].score < 0.7


def test_scores_equal_the_trees_node_by_node(spark):
    data = comments(240)
    texts, labels = [toxicity.summary(t) for _, t, _ in data], [y for *_, y in data]
    for x, (_, t, _) in zip(texts, data, strict=True):
        x.marks = toxicity._marks(t)
    model = toxicity.train(texts, labels)
    odd = ["", "You YOU idiot! st*pid 1diot", "a.b 9x x9 --x-- _a_ !!! c3po", "\u00c9t\u00e9 grobiane Grobian, you? 12:30", "grobian " * 50]
    rows = [(i, t) for i, (_, t, _) in enumerate(data[:40])] + [(100 + i, t) for i, t in enumerate(odd)] + [(100, ""), (999, None)]
    trees = [(t.feature.tolist(), t.cut.tolist(), t.leaf.tolist()) for t in model.trees]
    knots = tuple(x.tolist() for x in model.knots)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), none, model).collect()
    by = {i: t or "" for i, t in rows}
    assert len(got) == len(rows)
    for r in got:
        x = brute.toxic_features(by[r.doc_id], model.learned.words, model.learned.stems, set(toxicity.INSULTS), set(toxicity.YOU), toxicity.LOOKS_LIKE)
        assert toxicity.features(by[r.doc_id], model.learned) == pytest.approx(x, abs=1e-9)
        assert r.score == pytest.approx(min(1.0, max(0.0, brute.boosted(x, model.start, trees, knots))), abs=1e-9)
        assert r.predicted == int(r.score >= 0.7)


def test_calibration_is_of_labels_and_pools():
    r = np.random.default_rng(4)
    raw = r.normal(size=2000)
    y = (r.random(2000) < 1 / (1 + np.exp(-2 * raw))).astype(float)
    xs, ys, w = toxicity.pools(raw, y, np.ones(2000))
    assert w.sum() == 2000 and w.min() >= 1 and (np.diff(xs) > 0).all() and (w * ys).sum() == pytest.approx(y.sum())
    got = np.interp(raw, *toxicity.isotonic(xs, ys, w))
    assert np.abs(got - 1 / (1 + np.exp(-2 * raw))).mean() < 0.08
    assert [x.tolist() for x in toxicity.pools(np.array([1.0, 1.0]), np.array([0.0, 1.0]), np.ones(2))] == [[1.0], [0.5], [2.0]]


@pytest.mark.parametrize("text", ["a" + "8" * 1_000_000, "a" + "!" * 1_000_000 + "a", "!" * 1_000_000, "you " * 250_000])
def test_long_words_take_linear_time(text):
    began = time.perf_counter()
    toxicity.features(text, toxicity.Lexicon({"grob": 3.0}, {"grob": 2.0}))
    assert time.perf_counter() - began < 5


def test_long_texts_are_learned_as_a_whole(spark):
    r = random.Random(2)
    calm = lambda n: " ".join(f"w{r.randrange(3000)}" for _ in range(n))
    data = [(i, calm(5000) + ("" if i % 3 else " grobian you"), int(i % 3 == 0)) for i in range(180)]
    docs = spark.createDataFrame([(d, t) for d, t, _ in data], "doc_id long, text string")
    texts, labels, _ = toxicity.sample(docs, spark.createDataFrame([(d, y) for d, _, y in data], "doc_id long, toxic int"))
    known = [x for x in data if zlib.crc32(str(x[0]).encode()) % 3 != 1]
    assert all(len(t) > 20_000 for _, t, _ in known) and labels == [y for *_, y in known]
    lexicon = toxicity.learn_lexicon(texts, np.array(labels))
    assert "grobian" in lexicon.words
    for text, (_, t, y) in zip(texts, known, strict=True):
        assert toxicity.features(text, lexicon) == toxicity.features(t, lexicon) and (toxicity.features(text, lexicon)[9] > 0) == bool(y)


def test_isotonic_is_the_least_squares_monotone_fit():
    x, y = np.array([1.0, 2, 3, 4, 5, 5]), np.array([0.0, 1, 0, 1, 0, 1])
    knots = toxicity.isotonic(x, y, np.ones(6))
    assert np.interp(x, *knots).tolist() == pytest.approx([0, 0.5, 0.5, 2 / 3, 2 / 3, 2 / 3])


def test_features_are_finite_for_odd_texts():
    for t in ["", " ", "\x00", "a" * 100_000, "you " * 5000, "!?!?", "é" * 10, "idiot"]:
        assert np.isfinite(toxicity.features(t, toxicity.Lexicon({"grob": 3.0}, {"grob": 2.0}))).all()


def test_without_both_classes_scores_are_zero(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(docs, labels).first().score == 0.0
    assert toxicity.score(docs.limit(0), labels).count() == 0


# --- memory of Python workers ---


def random_model(langs: int = 12) -> language.Model:
    rng = np.random.default_rng(3)
    f32 = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
    gru = lambda: language.Gru(f32(24, 256), f32(24, 8), f32(8, 1))
    return language.Model([f"l{i}" for i in range(langs)], gru(), gru(), f32(langs, 16), f32(langs, 1))


def test_large_batches_are_kept_in_parts():
    ids = list(range(2500))
    texts = [None if i % 7 == 0 else "12 34" if i % 5 == 0 else f"text {i} of some words" for i in ids]
    batch = pa.RecordBatch.from_pydict({"doc_id": ids, "text": texts, "more": ids})
    got = list(language._keep(random_model(), 0.0)(iter([batch])))
    assert [i for b in got for i in b.column("doc_id").to_pylist()] == [i for i in ids if i % 7 and i % 5]
    assert all(b.schema == batch.schema for b in got) and max(b.num_rows for b in got) <= language.ROWS


def test_the_sample_starts_no_workers_of_plain_rows(spark, monkeypatch):
    docs = spark.range(200).selectExpr("id as doc_id", "concat('text ', id) as text", "if(id % 2 = 0, 'aa', 'bb') as lang")

    def refuse(*_, **__):
        raise AssertionError("rows of Python objects go through workers of their own")

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", refuse)
    got = language.sample(docs)
    assert sorted(text.decode() for _, text in got) == sorted(f"text {i}" for i in range(200) if zlib.crc32(str(i).encode()) % 5)
    assert {lang for lang, _ in got} == {"aa", "bb"}


HELD = """
import re, sys
sys.path.insert(0, sys.argv[1])
import pyarrow as pa
from tests.llm.test_text import language, random_model
from gridspark.llm.workers import lean

def held():
    return sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

def batches():
    yield pa.RecordBatch.from_pydict({"doc_id": list(range(4000)), "text": [f"text {i} of some words " * 200 for i in range(4000)]})

plain = language._keep(random_model(), 0.0)
for task in (lean(plain), plain, lean(plain)):  # the first loads what stays
    for b in task(batches()):
        del b
    print(held())
"""


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
def test_a_worker_gives_back_what_its_task_freed():
    run = subprocess.run([sys.executable, "-c", HELD, str(Path(__file__).resolve().parents[2])], capture_output=True, text=True, check=True)
    first, plain, again = map(float, run.stdout.split())
    assert again < first + 10 < plain


def test_words_are_compared_over_the_borders_of_parts(monkeypatch):
    monkeypatch.setattr(tokens, "COMPARED", 5)
    for words in ([], [b"a"], [b"abcdefgh", b"ij", b"k", b"lmnopqrs", b"", b"t"], [b"abcde"] * 4):
        raw, size = np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words], np.int64)
        at = np.cumsum(size) - size
        assert tokens._spelt_alike(raw, at, size, raw.copy(), at, size)
        for i in range(len(raw)):
            other = raw.copy()
            other[i] += 1
            assert not tokens._spelt_alike(raw, at, size, other, at, size)


def test_every_task_of_the_pipeline_is_lean(spark, monkeypatch):
    seen = []
    plain = type(spark.range(0)).mapInArrow
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda self, f, *a, **b: seen.append(f) or plain(self, f, *a, **b))
    docs = spark.createDataFrame([(1, "one two three four five", "aa"), (2, "six seven eight nine ten", "bb")], "doc_id long, text string, lang string")
    language.keep_identified(docs)
    simhash.deduplicate(docs)
    tokens.token_files(docs)
    assert len(seen) == 5 and all(hasattr(f, "__wrapped__") for f in seen)
