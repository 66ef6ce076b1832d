"""Byte-level BPE, filter audit and collocations against the library and brute force."""

import base64
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from faultline.llm import bytebpe, collocations, filteraudit

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = {base64.b64decode(w): int(r) for w, r in map(bytes.split, open(PATH, "rb"))}
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
VOCABULARY = bytebpe.Vocabulary(PATH)
ENCODER = bytebpe.Encoder(VOCABULARY)

PARTS = [" ", "  ", "\n", "\t", " ", "\x1c", "\x85", "'s", "'ll", "a", "Bc", "é", "՘", "1", "²", "...", "漢", "🙂", "<|endoftext|>"]


def encoded(texts):
    return ENCODER.encode(pa.array(texts, pa.string())).to_pylist()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS)).map("".join))
def test_ids_equal_the_library(text):
    assert encoded([text]) == [LIBRARY.encode_ordinary(text)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(), max_size=4))
def test_ids_of_any_text(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert encoded(texts) == [LIBRARY.encode_ordinary(t) for t in texts]


def test_every_word_has_its_own_slot():
    words = list(RANKS)
    whole = bytebpe.PerfectHash(words)
    assert sorted(whole.find(words)) == list(range(len(words)))
    strangers = [w + b"\x00\x00" for w in words[:5000]]
    assert set(whole.find(strangers)) == {-1}
    assert bytebpe.PerfectHash([]).find([b"x"]) == [-1]
    with pytest.raises(ValueError):
        bytebpe.PerfectHash([b"a", b"a"])


def test_merges_are_the_plain_loop():
    def plain(word):
        parts = [bytes([b]) for b in word]
        while True:
            ranked = [(RANKS.get(a + b), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            ranked = [r for r in ranked if r[0] is not None]
            if not ranked:
                return [RANKS[p] for p in parts]
            _, i = min(ranked)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    draw = random.Random(5)
    for _ in range(500):
        word = bytes(draw.choice(b"thening aeiou\xc3\xa9") for _ in range(draw.randrange(1, 40)))
        assert ENCODER.merge(word) == plain(word)


def test_remembered_merges_change_nothing(monkeypatch):
    monkeypatch.setattr(bytebpe, "REMEMBERED", 2)
    monkeypatch.setattr(bytebpe, "AT_ONCE", 10)
    texts = ["qzxv wvvxq qzxv", "zzqj", "", None, "qzxv " * 50] * 2
    assert encoded(texts) == [LIBRARY.encode_ordinary(t or "") for t in texts]


def test_encode_and_decode_rows(spark, documents):
    long = "naïve " * 60_000 + "x" * 300_000
    docs = [(1, "a b"), (2, None), (3, ""), (1, "a b"), (None, "no id"), (4, long), (5, "՘ wide 漢")]
    got = bytebpe.decode(bytebpe.encode(documents(docs), VOCABULARY), VOCABULARY).collect()
    assert sorted((str(r["row"].doc_id), r.ids, bytes(r.decoded)) for r in got) == sorted(
        (str(d), LIBRARY.encode_ordinary(t or ""), (t or "").encode()) for d, t in docs
    )
    assert bytebpe.encode(documents([]), VOCABULARY).count() == 0


def test_unknown_ids_are_refused():
    decoder = bytebpe.Decoder(PATH)
    assert decoder.decode(pa.array([[1, 2], [], None], pa.list_(pa.int32()))).to_pylist()[1:] == [b"", b""]
    with pytest.raises((ValueError, IndexError)):
        decoder.decode(pa.array([[60_000]], pa.list_(pa.int32())))


# --- Filter audit --------------------------------------------------------------


def audit_by_hand(docs, labels):
    def words(text):
        return [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]

    least = {}
    for doc_id, text, _ in docs:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    fails = []
    for doc_id, text, source in docs:
        t = text or ""
        w = words(t)
        failed = {
            "A": len(w) < 50,
            "B": 100 * len(set(w)) < 65 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": doc_id is not None and least[t] < doc_id,
        }
        good = any(q == 1 for d, q, _ in labels if d == doc_id and d is not None)
        toxic = any(x == 1 for d, _, x in labels if d == doc_id and d is not None)
        fails.append((source or "", {f for f, bad in failed.items() if bad}, good, toxic))
    out = []
    for part in {p for p, *_ in fails}:
        mine = [f for f in fails if f[0] == part]
        shapley, rows = Counter(), []
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                before = set(order[: step - 1])
                gone = [x for x in mine if not x[1] & before and f in x[1]]
                rows.append(
                    (
                        part, "".join(order), step,
                        sum(not x[1] & (before | {f}) for x in mine), len(gone),
                        sum(bool(x[1] & before) and f in x[1] for x in mine),
                        sum(x[1] == {f} for x in mine),
                        sum(x[2] for x in gone), sum(x[3] for x in gone), f,
                    )
                )
                shapley[f] += len(gone)
        out += [(*r[:-1], shapley[r[-1]]) for r in rows]
    return sorted(out)


def some_audited():
    draw = random.Random(8)
    varied = [" ".join(f"w{draw.randrange(90)}" for _ in range(draw.randrange(30, 130))) for _ in range(30)]
    texts = varied + varied[:20] + ["", None, "ONE BIG SHOUT", "cash $ now", " \t\n", "same " * 60, "é " * 80]
    docs = [(i, t, draw.choice(["a", "b", "", None])) for i, t in enumerate(texts * 2)]
    docs += [(0, texts[0], "a"), (0, texts[3], "b"), (None, texts[1], "a"), (None, "lone", None), (-4, texts[2], "b")]
    draw.shuffle(docs)
    labels = [(i, draw.choice([0, 1, None]), draw.choice([0, 1, None])) for i in range(0, 120, 2)] + [(2, 1, 1), (None, 1, 1)]
    return docs, labels


@pytest.mark.parametrize("cells, most", [(16, 1 << 14), (1, 1)])
def test_audit_is_the_brute_force(spark, documents, monkeypatch, cells, most):
    if most == 1:  # a sketch of 64 cells, in which nearly every text looks like a repeat
        monkeypatch.setattr(filteraudit, "SEGMENT_BITS", 6)
    docs, labels = some_audited()
    rules = filteraudit.AuditRules(cells=cells, most_segments=most)
    frame = documents(docs, "doc_id long, text string, source string").withColumnRenamed("key", "mask")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filteraudit.audit(frame.repartition(5), known, rules=rules)
    assert sorted(map(tuple, got.collect())) == audit_by_hand(docs, labels)


def test_audit_of_nothing_and_of_long_texts(spark, documents):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    columns = "doc_id long, text string, source string"
    assert filteraudit.audit(documents([], columns), labels).count() == 0
    long = " ".join(map(str, range(200_000)))
    docs = [(1, long, "a"), (2, long, "a"), (3, long + " ", "a")]
    got = {(r.filter_order, r.step): r for r in filteraudit.audit(documents(docs, columns), labels).collect()}
    assert got["ABCDE", 5].kept == 2 and got["ABCDE", 5].removed == 1 and got["EABCD", 1].shapley == 120


def test_unique_texts_are_cleared(spark):
    rules = filteraudit.AuditRules()
    keys = spark.createDataFrame([(hash(("k", i)) % (1 << 62),) for i in range(4000)] + [(7,), (7,)], "key long")
    sketch = filteraudit.merged_sketch(keys, rules, 4)
    left = [r.key for r in filteraudit.possible_repeats(keys, sketch, rules, 4).collect()]
    assert left.count(7) == 2 and len(left) < 200


# --- Collocations --------------------------------------------------------------


def collocations_by_hand(docs, spec):
    f, n = defaultdict(Counter), Counter()
    for text, lang in docs:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang or "und" if lang != "" else ""] += len(w)
            for size in range(1, spec.longest + 1):
                for i in range(len(w) - size + 1):
                    f[lang or "und" if lang != "" else ""][tuple(w[i : i + size])] += 1
    out = []
    for lang, counts in f.items():
        kept = []
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= spec.least}
        for p, a in candidates.items():
            cuts = [
                (spec.scale * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]])
                for k in range(1, len(p))
            ]
            score, _, left, right = min(cuts)
            longer = [
                b for q, b in candidates.items()
                if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))
            ]
            if not any(100 * b >= spec.absorbed * a for b in longer):
                kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[: spec.top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def some_phrases():
    draw = random.Random(4)
    words = ["new", "york", "city", "of", "the", "a", "état", "x-1", "漢"]
    docs = []
    for i in range(120):
        parts = [draw.choice(words) for _ in range(draw.randrange(0, 120))]
        text = "".join(p + draw.choice([" ", " ", " ", "  ", "\t", ". ", ", ", "\n", " ; ; ", "!"]) for p in parts)
        docs.append((text if i % 3 else text.title(), draw.choice(["en", "de", None, "und", ""])))
    docs += docs[:30] * 3 + [(None, "en"), ("", "de"), (".,;", "xx"), ("one", "en"), ("same " * 400, "en")]
    docs += [("the new york city. " * 40, "en"), ("a b a b " * 30, "de"), ("Ä ä ÀB " * 40, "fr")]
    return docs


@pytest.mark.parametrize(
    "spec",
    [
        collocations.Phrases(least=5),
        collocations.Phrases(least=3, one_in=2, most=5, filter_bits=1 << 10, top=7),
        collocations.Phrases(least=30, one_in=1),
    ],
)
def test_collocations_are_the_brute_force(spark, documents, spec):
    docs = some_phrases()
    frame = documents([(i, t, g) for i, (t, g) in enumerate(docs)], "doc_id long, text string, lang string")
    got = collocations.collocations(frame.withColumnRenamed("n", "f").repartition(4), spec)
    assert sorted(map(tuple, got.collect())) == collocations_by_hand(docs, spec)


def test_chunks_overlap_by_three_and_own_each_token_once():
    spec = collocations.Phrases(one_in=4, most=50)
    draw = random.Random(1)
    text = " ".join(str(draw.randrange(30)) for _ in range(3000))
    rows = collocations.parse([text, None, ".", text], pa.array(["en"] * 4), spec).to_pylist()
    half = len(rows) // 2
    assert rows[:half] == rows[half:]
    tokens = []
    for row in rows[:half]:
        chunk = row["chunk"].split(" ")
        tokens += chunk[: row["owned"]]
        assert len(chunk) in (row["owned"], row["owned"] + 3)
    assert " ".join(tokens) == text
    # Where the text is the same again, so are the chunks, after the first trigger.
    moved = collocations.parse(["other words before " + text], pa.array(["en"]), spec).to_pylist()
    assert len({r["chunk"] for r in moved} - {r["chunk"] for r in rows}) <= 2


def test_collocations_of_nothing_and_of_long_texts(spark, documents):
    columns = "doc_id long, text string, lang string"
    assert collocations.collocations(documents([], columns)).count() == 0
    assert collocations.collocations(documents([(1, None, None)], columns)).count() == 0
    got = collocations.collocations(documents([(1, "deep blue sea " * 200_000, "en")], columns)).collect()
    assert [(r.rank, r.phrase, r.a, r.n) for r in got][0] == (1, "blue sea deep blue", 199_999, 600_000)


def test_products_past_64_bits(spark, monkeypatch):
    big = 4 * 10**18
    counts = [("en", "a", 1, big), ("en", "b", 1, big), ("en", "a b", 2, big // 2)]
    frame = spark.createDataFrame([(w, p, s, f) for w, p, s, f in counts], "lang string, phrase string, size int, f long")
    words = spark.createDataFrame([("en", 2 * big)], "lang string, n long")
    monkeypatch.setattr(collocations, "chunk_table", lambda docs, spec: docs)
    monkeypatch.setattr(collocations, "phrase_counts", lambda chunks, spec: (frame, words))
    row = collocations.collocations(frame).first()
    assert (row.score, row.a, row.l, row.r) == (500_000, big // 2, big, big)


