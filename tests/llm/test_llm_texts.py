"""Token files, packing, secrets, scores and line rules against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from faultline.llm import language, linecleaning, packing, secrets, sharding, tokenfiles, toxicity
from faultline.llm.tokens import Bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
OWN = Bpe(PATH)

DOCS = [
    (1, "Thion and the erst, blean!  Two  spaces\n\nand lines.\n"),
    (2, None),
    (3, ""),
    (4, "word " * 3000),
    (4, "word " * 3000),
    (None, "no id here"),
    (5, "<|endoftext|> inside a text"),
    (6, " lead and trail "),
    (7, "tab\tand hard space, émigré 漢字 🙂 it's 123"),
]


def ids_of(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "\n", "\t", " ", " ", "a", "Bc", "'s", "é", "1", "...", "漢", "x y"])).map("".join))
def test_ids_equal_the_library(text):
    assert np.frombuffer(OWN.encode(text), "<u4").tolist() == ids_of(text)[:-1]


@settings(max_examples=100, deadline=None)
@given(st.text())
def test_ids_of_any_text(text):
    text = text.encode("utf-8", "ignore").decode()
    assert np.frombuffer(OWN.encode(text), "<u4").tolist() == ids_of(text)[:-1]


def check_pieces(rows, docs, sequence):
    """Every id in exactly one piece, windows gapless and within their size."""
    left = sorted((str(d), len(ids_of(t)), crc(ids_of(t))) for d, t in docs)
    by_doc, by_window = {}, {}
    for r in rows:
        by_doc.setdefault((str(r.doc_id), r.doc_tokens), []).append((r.start, r.length, r.ids_crc32))
        by_window.setdefault(sequence(r), []).append((r.offset, r.length))
    assert sum(r.length for r in rows) == sum(n for _, n, _ in left)
    for doc_id, text in docs:
        ids = ids_of(text)
        pieces = by_doc[(str(doc_id), len(ids))]
        for start, length, check in pieces:
            assert crc(ids[start : start + length]) == check
        times = sum((str(d), len(ids_of(t))) == (str(doc_id), len(ids)) for d, t in docs)
        starts = sorted(p[:2] for p in pieces)
        assert len({s for s, _ in starts}) * times == len(starts)
        assert sum(n for _, n in set(starts)) == len(ids)
    for placed in by_window.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 1024


def test_packing_keeps_every_id(spark, documents):
    draw = random.Random(2)
    docs = DOCS + [(100 + i, "ab " * draw.randrange(1, 900)) for i in range(120)]
    frame = documents(docs).repartition(6)
    for limit in (1, 3, 128):
        got = packing.pack(frame, PATH, open_windows=limit).collect()
        check_pieces(got, docs, lambda r: r.sequence_id)
    kept = packing.pack(frame, PATH, keep_ids=True)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in kept.collect())
    windows = len({r.sequence_id for r in got})
    assert windows <= 1.2 * sum(len(ids_of(t)) for _, t in docs) / 1024 + 1
    assert packing.pack(documents([]), PATH).count() == 0


def test_leftovers_merge_in_rounds(spark, documents, monkeypatch):
    monkeypatch.setattr(packing, "FAN_IN", 2)
    docs = [(i, "ab " * (i % 50 + 1)) for i in range(300)]
    got = packing.pack(documents(docs).repartition(32), PATH, open_windows=2).collect()
    check_pieces(got, docs, lambda r: r.sequence_id)
    total = sum(len(ids_of(t)) for _, t in docs)
    assert len({r.sequence_id for r in got}) <= total // 1024 + 3


def test_open_windows_place_best_fit_and_emit_the_fullest():
    windows = packing.OpenWindows(10, 2, 0)
    assert windows.place("a", 6) == [] and windows.place("b", 7) == []
    assert windows.place("c", 3) == [(1, [(0, "b"), (7, "c")])]
    assert windows.place("d", 8) == []
    assert windows.place("e", 5) == [(2, [(0, "d")])]
    assert sorted(w for w, _ in windows.rest()) == [0, 3]


def test_token_files_round_trip(spark, documents):
    for layout in (tokenfiles.Layout(), tokenfiles.Layout(chunk=3000), tokenfiles.Layout(vocabulary=1 << 20)):
        got = tokenfiles.write_and_read(spark, documents(DOCS), PATH, layout).collect()
        check_pieces(got, DOCS, lambda r: (r.file, r.row))
    assert tokenfiles.write_and_read(spark, documents([]), PATH).count() == 0


def test_vocabulary_of_the_file_and_ids_that_do_not_fit(spark, documents, tmp_path):
    assert tokenfiles.Layout().of(PATH).vocabulary == LIBRARY.get_vocab_size() == 50_257
    assert tokenfiles.Layout(vocabulary=70_000).ids == "<u4" and tokenfiles.Layout(size=70_000).positions == "<u4"
    ids = np.array([5, 60_000], "<u4").tobytes()
    with pytest.raises(ValueError, match="60000"):
        tokenfiles._write([(1, 0, ids, 2)], str(tmp_path), tokenfiles.Layout(vocabulary=50_257))
    wide = np.array([69_999, 4464], "<u4").tobytes()
    layout = tokenfiles.Layout(vocabulary=70_000)
    told = tokenfiles._write([(1, 0, wide, 2)], str(tmp_path), layout)
    _, got = tokenfiles.PackedFile(told[0][4], layout).segment(0, 0)
    assert got.tolist() == [69_999, 4464]
    pieces = spark.createDataFrame([(*told[0][:-1], 123)], tokenfiles.PIECES)
    with pytest.raises(Exception, match="not those that were written"):
        tokenfiles.read_packed(pieces, layout).collect()


@given(st.lists(st.integers(1, 32), max_size=60))
def test_best_fit_decreasing(lengths):
    placed = tokenfiles.best_fit_decreasing(lengths, 32)
    free, expected = [], []
    for piece in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [f for f in free if f >= lengths[piece]]
        if fits:
            free.remove(min(fits))
            free.append(min(fits) - lengths[piece])
        else:
            free.append(32 - lengths[piece])
        expected.append(min(fits, default=32))
    ordered = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    assert [32 - placed[i][1] for i in ordered] == expected
    used = {}
    for i, (row, offset) in enumerate(placed):
        places = used.setdefault(row, set())
        mine = set(range(offset, offset + lengths[i]))
        assert not places & mine and max(mine) < 32
        places |= mine


# --- secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")


def base_spans(text):
    spans = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    spans += [(m.start(), 1, "access", m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, "hex", m.end()) for m in HEX.finditer(text) if len(m[0]) >= 16]
    return spans


def entropy_spans(text, rule):
    spans = []
    for m in re.finditer(rule.pattern, text):
        word = m[0]
        if any(re.search(p, word, re.A) for p in rule.allowed):
            continue
        limit = next(t for p, t in rule.classes if re.search(p, word, re.A))
        hot = []
        for i in range(len(word) - rule.window + 1):
            window = word[i : i + rule.window]
            shares = [window.count(c) / rule.window for c in set(window)]
            if -sum(s * math.log2(s) for s in shares) > limit:
                hot.append(i)
        if hot:
            spans.append((m.start() + hot[0], 3, "entropy", m.start() + hot[-1] + rule.window))
    return spans


def secret_texts():
    draw = random.Random(4)
    some = lambda alphabet, n: "".join(draw.choice(alphabet) for _ in range(n))
    full = secrets.ALPHABET
    texts = [None, "", "token=secret=abcdefghijklmnop", "token=password: abcdefghijklmnop", 'éé API_KEY" = \'Abc123+/=_.-xyz.',
             "AKIAAKIA" + "X" * 14 + " AKIA123", "x" * 70, "0123456789abcdef" * 3, "a/b/c/d/e/some/longer/path/to/things here",
             "passwd : " + some(full, 40), "ſecret=abcdefghijklmnop", "deadbeefdeadbeef", "f" * 15 + " " + "F" * 16,
             "123e4567-e89b-12d3-a456-426614174000 example" + some(full, 30)]
    for _ in range(60):
        parts = [draw.choice(["the", "Token:", "secret = ", "AKIA" + some("AB12", draw.randrange(20)), some("0123456789abcdef", draw.randrange(40)),
                              some(full, draw.randrange(60)), some("abcdefghij", 30), "ünï", "\n"]) for _ in range(8)]
        texts.append(draw.choice(["", " "]).join(parts))
    return texts


def test_secrets_equal_brute_force(spark, documents):
    rule, rows = secrets.EntropyRule(), list(enumerate(secret_texts()))
    got = secrets.find_secrets(documents(rows), rule).select("row.doc_id", "base", "spans").collect()
    seen = 0
    for r in got:
        text = rows[r.doc_id][1] or ""
        base = sorted(base_spans(text))
        assert [tuple(s) for s in r.base] == base
        assert [tuple(s) for s in r.spans] == sorted(base + entropy_spans(text, rule))
        seen += len(r.spans) > len(r.base)
    assert seen > 10


def test_redaction(spark, documents):
    key = "f0ddae3b09ae356cbefecdd3232fa5489bb400d6"
    rows = [(1, f'é token = "{key}" end'), (2, "clean"), (3, None), (4, ""), (1, f'é token = "{key}" end'), (5, key + " and " + key)]
    docs = documents([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars long")
    got = secrets.redact(docs)
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    assert sorted(((r.doc_id, r.text, r.n_chars) for r in got.collect()), key=str) == sorted(
        [(1, 'é [SECRET]" end', 15)] * 2 + [(2, "clean", 5), (3, None, 0), (4, "", 0), (5, "[SECRET] and [SECRET]", 21)], key=str
    )
    assert secrets.redact(documents([])).count() == 0


def masked(text, rule):
    out, at = [], 0
    for start, _, _, end in sorted(base_spans(text) + entropy_spans(text, rule)):
        if start >= at:
            out += [text[at:start], "[SECRET]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


@pytest.mark.parametrize("step, block", [(2, 3), (256, 4096)])
def test_redaction_equals_brute_force(spark, documents, monkeypatch, step, block):
    monkeypatch.setattr(secrets, "STEP", step)
    monkeypatch.setattr(secrets, "BLOCK", block)
    rows, rule = list(enumerate(secret_texts())), secrets.EntropyRule()
    got = {r.doc_id: r.text for r in secrets.redact(documents(rows), rule=rule).collect()}
    assert got == {i: None if t is None else masked(t, rule) for i, t in rows}


def test_many_secrets_in_one_text(spark, documents):
    """Time grows with the matches, not with their square."""
    n = 100_000
    text = "".join(f"{i:017x}\U0001f600é" for i in range(n))
    found = secrets.find_secrets(documents([(1, text)])).select(
        F.size("base").alias("n"), F.element_at("base", -1).alias("last")
    ).first()
    assert (found.n, found.last.start, found.last.end) == (n, 19 * n - 19, 19 * n - 2)
    assert secrets.redact(documents([(1, text)])).first().text == "[SECRET]\U0001f600é" * n


# --- toxicity

WORDS = ["then", "ander", "blean", "oush", "thion", "erst", "inghe", "whth", "orle", "sten"]


def labelled(n=1500, seed=6):
    draw, rows = random.Random(seed), []
    for i in range(n):
        words, toxic = [draw.choice(WORDS) + draw.choice("abcd") for _ in range(draw.randrange(5, 60))], i % 4 == 0
        if toxic:
            for _ in range(2):
                words.insert(draw.randrange(len(words)), draw.choice(["Idiot,", "moron", "scum!"]))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_toxicity_separates_unseen_documents(spark, documents):
    rows = labelled()
    odd = [(None, "you idiot", 1), (9001, None, 0), (9002, "", 1), (9003, "idiot " * 20_000, 1), (7, rows[7][1], 0)]
    docs = documents([r[:2] for r in rows + odd])
    labels = spark.createDataFrame([(r[0], r[2], 1) for r in rows] + [(5, None, 1), (None, 1, 1)], "doc_id long, toxic int, quality int")
    got = toxicity.toxicity(docs, docs, labels).select("row.doc_id", "row.text", "score").collect()
    assert len(got) == len(rows) + len(odd)
    truth = {r[0]: r[2] for r in rows}
    unseen = [r for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(unseen) > 200
    assert sum((r.score >= 0.5) == truth[r.doc_id] for r in unseen) > 0.95 * len(unseen)
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in got if not r.text} == {min(r.score for r in got if not r.text)}
    kept = toxicity.drop_toxic(docs, docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.score < 0.5 for r in got)


def test_held_out_labels_change_nothing(spark, documents):
    rows = labelled(400)
    docs = documents([r[:2] for r in rows])
    flip = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, _, y in rows]
    weights = [
        toxicity.train(docs, spark.createDataFrame(pairs, "doc_id long, toxic int"))
        for pairs in ([(r[0], r[2]) for r in rows], flip)
    ]
    assert weights[0] == weights[1] and len(weights[0]) > 3


def test_no_labels_and_no_documents(spark, documents):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    docs = documents([(1, "some words"), (2, None)])
    assert [r.score for r in toxicity.toxicity(docs, docs, labels).collect()] == [0.5, 0.5]
    assert toxicity.toxicity(docs.limit(0), docs, labels).count() == 0


def test_learner_equals_the_plain_recurrence():
    spec = toxicity.Ftrl(slots=64, l1=0.3, l2=0.1)
    learner, draw = toxicity.Learner(spec), random.Random(1)
    z, n = [0.0] * 65, [0.0] * 65

    def weight(i):
        l1 = 0 if i == 64 else spec.l1
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((spec.beta + math.sqrt(n[i])) / spec.alpha + spec.l2)

    for _ in range(200):
        slots, label = [draw.randrange(64) for _ in range(6)], draw.randrange(2)
        learner.learn(np.array(slots), label)
        at = [*sorted(set(slots)), 64]
        w = {i: weight(i) for i in at}
        g = 1 / (1 + math.exp(-sum(w.values()))) - label
        for i in at:
            sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / spec.alpha
            z[i] += g - sigma * w[i]
            n[i] += g * g
    assert np.allclose(learner.z, z) and np.allclose(learner.n, n)


# --- language


def slow_bits(text, counts, langs, order):
    """Code length by walking the contexts of every byte."""
    body, totals = language.plain(text), []
    for lang in langs:
        bits = 0.0
        for i in range(1, len(body)):
            k = min(order, i)
            while k >= 0:
                seen = counts.get((lang, body[i - k : i]))
                if seen:
                    total, distinct = sum(seen.values()), len(seen)
                    if body[i] in seen:
                        bits -= math.log2(seen[body[i]] / (total + distinct))
                        break
                    bits -= math.log2(distinct / (total + distinct))
                k -= 1
            else:
                bits += 8
        totals.append(bits)
    return totals


def language_rows():
    draw = random.Random(9)
    alphabets = {"aa": ["the", "and", "thion", "where"], "bb": ["der", "und", "schön", "über"], "cc": ["año", "qué", "los", "ción"]}
    rows = []
    for i in range(300):
        lang = draw.choice(list(alphabets))
        rows.append((i, " ".join(draw.choice(alphabets[lang]) for _ in range(draw.randrange(2, 30))), lang))
    return rows


def test_code_lengths_are_exact(spark, documents):
    rows, spec = language_rows(), language.Ppm(rare_from=9)
    docs = documents([*rows, (301, "Zeichen", None), (None, "the and", "cc")], "doc_id long, text string, lang string")
    counts = {}
    for i, text, lang in rows:
        if zlib.crc32(str(i).encode()) % 5:
            body = language.plain(text)
            for at in range(1, len(body)):
                for k in range(min(spec.order, at) + 1):
                    seen = counts.setdefault((lang, body[at - k : at]), {})
                    seen[body[at]] = seen.get(body[at], 0) + 1
    model = language.train(docs, spec)
    assert model.langs == ["aa", "bb", "cc"]
    lookup = language.Table(model)
    for text in ["the und", "quéé ñ 12 zzz 漢字", "x", "der schöner los and", rows[0][1] * 40]:
        assert np.allclose(language.code_lengths(text, lookup), slow_bits(text, counts, model.langs, spec.order), rtol=1e-5)


def test_long_texts_in_steps(spark, documents, monkeypatch):
    model = language.train(documents(language_rows(), "doc_id long, text string, lang string"))
    lookup, text = language.Table(model), "the und año " * 50
    whole = language.code_lengths(text, lookup)
    monkeypatch.setattr(language, "AT_ONCE", 7)
    assert np.allclose(language.code_lengths(text, lookup), whole)


def test_languages_of_unseen_documents(spark, documents):
    rows = language_rows()
    odd = [(400, None, "aa"), (401, "", None), (402, "12 !?", "bb"), (403, "und der", None), (3, rows[3][1], rows[3][2])]
    docs = documents(rows + odd, "doc_id long, text string, lang string")
    got = language.identify(docs, docs).select("row.doc_id", "row.text", "row.lang", "lang_pred", "score").collect()
    assert len(got) == len(rows) + len(odd)
    unseen = [r for r in got if r.doc_id < 300 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(r.lang_pred == r.lang for r in unseen)
    assert {r.lang_pred for r in got if r.doc_id in (400, 401, 402)} == {"und"}
    assert next(r.lang_pred for r in got if r.doc_id == 403) == "bb"
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.identify(docs, unlabelled).collect()} == {"und"}
    assert language.identify(docs.limit(0), docs).count() == 0


# --- line cleaning


def repeated(words):
    windows = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)}
    return len(covered)


def test_base_counts(spark, documents):
    draw, texts = random.Random(7), [None, "", " \n ", "a b a b a b a", "one two three", "x y z x y z\nx y z", "é#* é\x0bé\x0cé"]
    for _ in range(60):
        texts.append("".join(draw.choice(["a ", "b ", "cc\n", "\n", "d#\t", "é ", "the end. "]) for _ in range(draw.randrange(120))))
    rows = list(enumerate(texts))
    for r in linecleaning.clean_lines(documents(rows)).drop("cleaned").select("row.doc_id", "*").collect():
        text = texts[r.doc_id] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert r.n_words == len(words) and r.word_chars == sum(map(len, words))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in text)
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.n_repeat_words == repeated(words)
        assert r.base_failed == (len(words) < 50 or 100 * repeated(words) > 50 * len(words))
        assert not (r.base_failed and r.kept)


def test_lines_that_go(spark, documents):
    good = " ".join(f"word{i}" for i in range(60)) + "."
    lines = {"Home | About us | Contact": 0, "home": 0, "© no": 0, "All rights reserved by nobody at all in here.": 0, "12:30 --- 44": 0,
             "WOW!! YES!! NOW!! ###": 0, "Some title": 0, "He came home.": 1, "": 1, "Home is where we live now and then.": 1, "Really?": 1}
    rows = [(1, good + "\n" + "\n".join(lines)), (2, good), (3, "All rights reserved. " * 30 + good.upper()[:20] + "\n" + good)]
    rows.append((4, "\n".join(f"Accept cookies {i} " + " ".join(f"w{i}{j}" for j in range(20)) for i in range(9)) + "\n" + good))
    got = {r.doc_id: r for r in linecleaning.clean_lines(documents(rows)).select("row.doc_id", "cleaned", "kept").collect()}
    assert got[1].cleaned == good + "\n" + "\n".join(x for x, stays in lines.items() if stays) and got[1].kept
    assert got[2].cleaned == good and got[2].kept
    assert got[4].cleaned == good and not got[4].kept
    assert linecleaning.clean_lines(documents([])).count() == 0


# --- sharding


def test_shards(spark, documents):
    rows = [(i, "t" * (i % 7)) for i in range(2000)] + [(5, "same")] * 37 + [(None, None), (None, "x"), (7, None)]
    docs = documents(rows)
    got = sharding.shard_rows(docs, buckets=16).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == sorted(
        (i is None, i or 0, len(t or "") + 1, zlib.crc32((t or "").encode())) for i, t in rows
    )
    for shard in range(8):
        mine = sorted(r.slot for r in got if r.shard == shard)
        assert mine == list(range(len(mine))) and 180 < len(mine) < 330
    assert {(r.doc_id, r.shard) for r in got} == {(r.doc_id, r.shard) for r in sharding.shard_rows(docs.repartition(5)).collect()}
    assert len({(r.doc_id, r.shard) for r in got}) == 2001
    moved = [r for r in got if r.grown_shard != r.shard]
    assert {r.grown_shard for r in moved} == {8} and 150 < len(moved) < 330
    assert sharding.shard_rows(documents([])).count() == 0


def test_weights_and_long_runs(spark, documents, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 10)
    rows = [(i, "") for i in range(3000)] + [(1, "")] * 105
    got = sharding.shard_rows(documents(rows), weights=(1.0, 3.0), buckets=4).collect()
    heavy = len({r.doc_id for r in got if r.shard == 1})
    assert 2150 < heavy < 2350
    for shard in range(2):
        mine = sorted(r.slot for r in got if r.shard == shard)
        assert mine == list(range(len(mine)))


@pytest.mark.parametrize("text", ["x" * 300_000, "a b " * 60_000, "\n" * 100_000])
def test_very_long_texts(spark, documents, text):
    docs = documents([(1, text)])
    assert linecleaning.clean_lines(docs).count() == 1
    assert len(secrets.find_secrets(docs).collect()) == 1


def test_line_rules_hold_at_any_length(spark, documents):
    rules = linecleaning.LineRules()
    menu, url = "home | about us | Contact  " * 40, "see https://example.org/" + "x" * 500
    good = "a longer line of plain words that stays as it is"
    failing = ["Home", "home>about/faq", menu, menu * 200, "about us", url, "three short words", "lorem ipsum and so on and on."]
    staying = [good, menu + "and more", "about them all as we see fit", "Done.", "one two three four five", "x" * 5000 + "."]
    rows = [(i, f"{good}\n{line}\n") for i, line in enumerate([*failing, *staying])]
    got = {r["row"].doc_id: r.cleaned for r in linecleaning.clean_lines(documents(rows), rules).collect()}
    for i, line in enumerate(failing):
        assert got[i] == f"{good}\n", line
    for i, line in enumerate(staying, len(failing)):
        assert got[i] == f"{good}\n{line}\n", line


def test_digests_are_stored_before_their_join(spark, monkeypatch):
    """So that the join has a shuffle of its own, which Spark can split."""
    from faultline.llm import warc

    stored = []
    monkeypatch.setattr(warc, "materialise", lambda frame: stored.append(frame.columns) or frame)
    page = "x" * 200
    pages = spark.createDataFrame([(i, f"http://a.b/{i}", page) for i in range(9)], "page_id long, url string, html string")
    got = warc.with_revisits(pages).collect()
    assert stored == [["digest", "first"]]
    assert sorted(r.refers_to is None for r in got) == [False] * 8 + [True]
