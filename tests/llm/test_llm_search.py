"""Near copies, components, decontamination and the capture index against brute force."""

import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from faultline.llm import decontamination, files, simhash, warc
from faultline.llm.components import connected_components


def plain_fingerprint(text, words):
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    shingles = [b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def smallest_reachable(nodes, linked):
    group = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            least = min(group[a], group[b])
            if group[a] != least or group[b] != least:
                group[a] = group[b] = least
                changed = True
    return group


def some_texts():
    draw = random.Random(3)
    base = [" ".join(draw.choice("abcdefgh") * 3 + str(draw.randrange(40)) for _ in range(n)) for n in (400, 60, 9)]
    texts = list(base)
    for text in base:
        words = text.split(" ")
        for _ in range(25):
            copy = list(words)
            for _ in range(draw.randrange(1, 4)):
                copy[draw.randrange(len(copy))] = "z" + str(draw.randrange(9))
            texts.append(" ".join(copy))
    return texts + [None, "", " \t", "ONE", "one", "one two", "ÉCOLE école", base[0].upper(), base[1]]


def test_fingerprint_is_the_definition():
    for text in some_texts():
        raw = None if text is None else text.encode()
        assert int(simhash.fingerprint(raw, 3)[0]) == plain_fingerprint(text, 3)
        assert int(simhash.fingerprint(raw, 5, 3)[0]) == plain_fingerprint(text, 5)


def test_long_text_in_steps(monkeypatch):
    text = " ".join(map(str, range(500))).encode()
    whole = simhash.fingerprint(text, 3, 2)
    monkeypatch.setattr(simhash, "HASHES_AT_ONCE", 7)
    assert (simhash.fingerprint(text, 3, 2) == whole).all()


@pytest.mark.parametrize("radius, parts", [(2, 3), (5, 4), (3, 2)])
def test_groups_are_those_of_all_pairs(spark, documents, radius, parts):
    texts = some_texts()
    rows = [(i, t) for i, t in enumerate(texts)] + [(2, texts[2]), (None, texts[1]), (None, "alone by itself")]
    spec = simhash.SimHash(radius=radius, parts=parts)
    got = simhash.near_duplicates(documents(rows), spec).collect()
    prints = {t: plain_fingerprint(t, 3) for _, t in rows}
    distinct = set(prints.values())
    linked = [(a, b) for a, b in combinations(distinct, 2) if (a ^ b).bit_count() <= radius]
    assert linked
    group = smallest_reachable(distinct, linked)
    least = {}
    for i, t in rows:
        if i is not None:
            g = group[prints[t]]
            least[g] = min(i, least.get(g, i))
    expected = sorted((i, f"{prints[t]:016x}", least.get(group[prints[t]])) for i, t in rows if i is not None)
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got if r.doc_id is not None) == expected
    lost = {r.fingerprint: r.component_id for r in got if r.doc_id is None}
    assert lost[f"{plain_fingerprint('alone by itself', 3):016x}"] is None


def test_no_link_counts_as_met_before_by_other_bits(spark, monkeypatch):
    draw = random.Random(11)
    prints = []
    for _ in range(300):
        one = draw.getrandbits(64)
        a, b = draw.sample(range(64), 2)
        prints += [one, one ^ (1 << a) ^ (1 << b)]
    signed = [(i, i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)]
    made = spark.createDataFrame(signed, "doc_id long, text_hash long, f0 long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, spec: made)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(made, simhash.SimHash()).collect()}
    assert got == {i: i - i % 2 for i in range(600)}


def test_thresholds_add_up_and_find_every_pair(spark):
    draw = np.random.default_rng(5)
    spec = simhash.SimHash(radius=6, parts=5)
    centre = draw.integers(0, 2, 64)
    bits = np.stack([centre ^ (draw.random(64) < 0.08) for _ in range(300)]).astype(np.uint8)
    lanes = np.packbits(bits, axis=1).view(">u8").astype(np.uint64).view(np.int64)[:, 0]
    frame = spark.createDataFrame([(int(x),) for x in lanes], "f0 long").distinct()
    plan = simhash.plan_parts(frame, spec)
    assert sorted(b for p in plan.parts for b in p) == list(range(64))
    chosen = simhash.allocate(bits, plan, spec)
    assert (chosen.sum(axis=1) == spec.radius - spec.parts + 1).all()
    apart = (bits[:, None, :] != bits[None, :, :])
    for a, b in zip(*np.nonzero(apart.sum(axis=2) <= spec.radius), strict=True):
        assert any(apart[a, b, p].sum() <= t for p, t in zip(plan.parts, chosen[a], strict=True))


def test_one_of_each_group_stays(spark, documents):
    long = " ".join(f"w{i}" for i in range(300))
    near = long.replace("w150", "other")
    rows = [(5, long), (3, near), (3, near), (9, long), (7, "something else entirely here now"), (None, None), (8, "")]
    spec = simhash.SimHash(words=5, lanes=4, radius=19, parts=20, accept=44)
    kept = simhash.keep_one(documents(rows), spec)
    assert kept.columns[:2] == ["doc_id", "text"] and "row" in kept.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(3, near), (7, rows[4][1]), (8, "")]


def test_empty_table(spark, documents):
    empty = documents([])
    assert simhash.near_duplicates(empty, simhash.SimHash()).count() == 0
    assert simhash.keep_one(empty, simhash.SimHash()).count() == 0


def test_components_of_chains_and_hubs(spark):
    draw = random.Random(1)
    edges = [(f"{i:04}", f"{i + 1:04}") for i in range(60)]
    edges += [("5000", f"{6000 + i}") for i in range(50)] + [("7001", "7001"), ("6003", "5000")]
    draw.shuffle(edges)
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    expected = smallest_reachable(nodes, [e for e in edges if e[0] != e[1]])
    got = connected_components(spark.createDataFrame(edges, "a string, b string"))
    assert {r.node: r.component for r in got.collect()} == expected
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


# --- decontamination


def least_edits(pattern, text):
    """Edits of the best stretch of the text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        made = [i]
        for j, t in enumerate(text, 1):
            made.append(min(row[j - 1] + (p != t), row[j] + 1, made[j - 1] + 1))
        row = made
    return min(row)


def edited(text, edits, draw):
    text = list(text)
    for _ in range(edits):
        at = draw.randrange(len(text))
        draw.choice([lambda: text.__setitem__(at, "#"), lambda: text.pop(at), lambda: text.insert(at, "q")])()
    return "".join(text)


def test_search_equals_the_full_table():
    draw = random.Random(8)
    words = ["the", "and", "with", "thion", "erst", "blean", "oush", "ander"]
    sentence = lambda n: " ".join(draw.choice(words) for _ in range(n))
    items = [(i, sentence(n)) for i, n in enumerate([6, 12, 30, 45, 20])] + [(7, "tiny"), (8, "")]
    spec = decontamination.Passages()
    index = decontamination.Index(items, spec)
    found = missed = 0
    for trial in range(80):
        text = sentence(draw.randrange(40))
        if trial % 4:
            item = draw.choice(items[:5])[1]
            text = text + " " + edited(item, draw.randrange(9), draw) + " " + sentence(draw.randrange(30))
        body = decontamination.normalised(text)
        expected = {
            p for p, (_, _, part) in enumerate(index.parts) if least_edits(part, body) <= index.budget[p]
        }
        hits = index.search(body)
        assert {h[0] for h in hits} == expected
        for part, edits, start, end in hits:
            assert least_edits(index.parts[part][2], body[start:end]) <= edits <= index.budget[part]
        found, missed = found + len(expected), missed + (not expected)
    assert found > 50 and missed > 5


def test_documents_with_passages_go(spark, documents):
    item = "Thion and the erst blean ousher, with ander inghe to the thonder oushed and atren blest here now today."
    bench = spark.createDataFrame([(1, item), (2, None), (3, "x"), (None, "y" * 40)], "item_id long, text string")
    typo = "before " + item.upper().replace("ERST", "ERRST") + " after"
    rows = [(1, typo), (2, "clean words only"), (3, None), (4, ""), (1, typo), (None, "a " + item), (5, "z" + "y" * 40)]
    got = decontamination.contaminations(documents(rows), bench).collect()
    assert sorted(((r.doc_id, r.item_id, r.edits > 0) for r in got), key=str) == sorted(
        [(1, 1, True), (1, 1, True), (None, 1, False), (5, None, False)], key=str
    )
    kept = decontamination.drop_contaminated(documents(rows), bench)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]
    small = decontamination.Passages(block=50)
    assert sorted(r.doc_id for r in decontamination.drop_contaminated(documents(rows), bench, small).collect()) == [2, 3, 4]
    assert decontamination.contaminations(documents(rows), bench, small).count() == 4
    none = bench.limit(0)
    assert decontamination.contaminations(documents(rows), none).count() == 0
    assert decontamination.drop_contaminated(documents(rows), none).count() == len(rows)
    assert decontamination.contaminations(documents([]), bench).count() == 0


# --- archives


PAGES = "page_id long, url string, html string, digest string, capture string"


def test_pages_come_back_from_the_archives(spark, monkeypatch):
    big, other = "<p>grüße</p>" * 20, "<html>" + "x" * 5000
    rows = [
        (4, "http://user@B.example.com:80/a?q=1#top", big),
        (2, "http://b.example.com/a?q=1", big),
        (9, None, big),
        (3, "https://a.org", None),
        (5, "not a url", ""),
        (6, "http://a.org/x y", "<p>short</p>"),
        (7, "http://a.org/x y", "<p>short</p>"),
        (-1, "http://a.org/z", other),
        (None, "http://a.org/z", other),
        (8, "http://a.org/r", "r" * 100),
        (8, "http://a.org/r", "r" * 100),
        (None, "", "n" * 99),
    ]
    pages = spark.createDataFrame([(*r, "d", "c") for r in rows], PAGES).repartition(3)
    got = warc.archive_and_read(spark, pages).collect()
    assert len(got) == len(rows)
    import hashlib

    expected = []
    for page_id, _, html in rows:
        raw = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        first = min(same) if len(raw) >= 100 and same else page_id
        kind = "response" if first == page_id else "revisit"
        expected.append((page_id, len(raw), hashlib.sha256(raw).hexdigest(), kind, None if kind == "response" else first))
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(expected, key=key)
    assert {bytes(r.payload) for r in got if r.payload} == {(h or "").encode() for _, _, h in rows} - {b""}
    assert warc.archive_and_read(spark, pages.limit(0)).count() == 0


def test_index_blocks_and_misses(spark, tmp_path, monkeypatch):
    from faultline.session import scratch_path

    folder = scratch_path(spark, "index")
    rows = [(f"com,a)/{i // 3:05}", f"f{i % 4}", i, 10) for i in range(9000)]
    captures = spark.createDataFrame(rows, warc.CAPTURES)
    bounds = warc.build_index(captures, folder)
    assert [b[0] for b in bounds] == sorted(b[0] for b in bounds)
    wanted = spark.createDataFrame([(f"com,a)/{i:05}",) for i in range(0, 3100, 7)] + [("",), ("zz",)], "capture string")
    got = warc.look_up(wanted, bounds).collect()
    keys = {r.capture for r in wanted.collect()}
    assert sorted(tuple(r) for r in got) == sorted(r for r in rows if r[0] in keys)
    directory = warc.Lookup(bounds).directories[bounds[0][3]]
    assert len(directory[0]) >= 1


def test_reversed_host(spark):
    cases = {
        "http://www.Example.com/a/b?x=1#f": "com,example,www)/a/b?x=1",
        "//h.org:8080": "org,h)/",
        "mailto:x": "mailto:x",
        None: "",
    }
    frame = spark.createDataFrame([(u,) for u in cases], "url string")
    got = frame.select("url", warc.reversed_host(F.col("url")).alias("k")).collect()
    assert {r.url: r.k for r in got} == cases


def test_reader_keeps_few_files(tmp_path):
    reader = files.Reader()
    for i in range(files.KEPT + 4):
        with files.create(str(tmp_path / "deep" / f"{i}")) as out:
            out.write(b"abc%d" % i)
    for i in range(files.KEPT + 4):
        assert reader.read(str(tmp_path / "deep" / f"{i}"), 2, 2) == b"c%d" % (i % 10 if i < 10 else 1)
    assert len(reader.open) == files.KEPT


# --- near copies of the pipeline


def pair_at(similarity, draw, total=200):
    """Two texts of about ``total`` five-word shingles each with this similarity, by exact counts."""
    from faultline.llm import nearcopies

    words = [f"w{draw.randrange(10**6)}" for _ in range(total + 4)]
    copy, order = list(words), draw.sample(range(len(words)), len(words))
    one = nearcopies.shingles(" ".join(words).encode(), 5)
    for at in order:
        before, copy[at] = copy[at], f"x{draw.randrange(10**6)}"
        if nearcopies.jaccard(one, nearcopies.shingles(" ".join(copy).encode(), 5)) < similarity:
            copy[at] = before
    return " ".join(words), " ".join(copy)


def test_isolated_pairs_are_judged_by_their_shingles(spark, documents):
    from corpus_pipeline import NEAR_COPIES
    from faultline.llm import nearcopies

    draw, rows, expected = random.Random(2), [], set()
    for n in range(400):
        wanted = draw.uniform(0.80, 0.85) if n % 2 else draw.uniform(0.60, 0.75)
        left, right = pair_at(wanted, draw, 100)
        rows += [(2 * n, left), (2 * n + 1, right)]
        a, b = ({tuple(t.split()[i : i + 5]) for i in range(100)} for t in (left, right))
        expected |= {2 * n} | ({2 * n + 1} if len(a & b) / len(a | b) < 0.8 else set())
    # A line said a thousand times is one shingle set, not a thousand.
    line, own = "again and again and again ", [" ".join(f"{c}{i}" for i in range(60)) for c in "pq"]
    rows += [(9000, line * 500 + own[0]), (9001, line * 500 + own[1]), (9002, line * 3 + own[0])]
    rows += [(9003, None), (9004, " "), (9005, "only four words here"), (9006, "ONLY four words  here")]
    expected |= {9000, 9001, 9003, 9005}
    kept = nearcopies.keep_one(documents(rows), NEAR_COPIES)
    assert {r.doc_id for r in kept.collect()} == expected
    assert nearcopies.keep_one(documents([]), NEAR_COPIES).count() == 0


def test_parts_of_each_lane_meet_every_pair_within_the_radius(spark):
    from faultline.llm import nearcopies

    draw, spec = np.random.default_rng(7), nearcopies.NearCopies(lanes=2)
    # Half of the rows share most bits, so that their values are frequent and thresholds differ.
    bits = draw.integers(0, 2, (600, 128))
    bits[:300] = bits[0] ^ (draw.random((300, 128)) < 0.02)
    raw = [(bytearray(np.packbits(row)),) for row in bits]
    frame = spark.createDataFrame(raw, "lanes binary").repartition(3)
    plans = simhash.plan_groups(frame, spec.search, spec.lanes, nearcopies.lane_bits)
    thresholds = set()
    for lane, plan in enumerate(plans):
        here = bits[:, 64 * lane : 64 * lane + 64].astype(np.uint8)
        assert sorted(b for p in plan.parts for b in p) == list(range(64))
        chosen = simhash.allocate(here, plan, spec.search)
        assert (chosen.sum(axis=1) == spec.radius - spec.parts + 1).all()
        thresholds |= set(chosen.ravel().tolist())
        keys, places, kinds = nearcopies.part_values(here, plan, lane, spec)
        assert set((keys >> 48).tolist()) == {lane * spec.parts + i for i in range(spec.parts)}
        probed, held = ([set() for _ in here] for _ in range(2))
        for key, place, kind in zip(keys.tolist(), places.tolist(), kinds.tolist(), strict=True):
            if kind & nearcopies.PROBES:
                probed[place].add(key)
            if kind & nearcopies.INDEXED:
                held[place].add(key)
        apart = (here[:, None, :] != here[None, :, :]).sum(axis=2)
        near = list(zip(*np.nonzero(apart <= spec.radius), strict=True))
        assert len(near) > 2000 and all(probed[a] & held[b] for a, b in near)
    assert len(thresholds) > 1


def test_lanes_are_the_majority_of_the_shingles(monkeypatch):
    from faultline.llm import nearcopies

    text = " ".join(map(str, range(40))).encode()
    found = nearcopies.shingles(text, 5)
    whole = nearcopies.sketch(found, 9)
    assert (whole == simhash.fingerprint(text, 5, 9)).all()
    monkeypatch.setattr(nearcopies, "HASHES_AT_ONCE", 7)
    assert (nearcopies.sketch(found, 9) == whole).all()
    assert not nearcopies.sketch(found[:0], 9).any()


def test_sets_of_few_shingles_meet_by_one_fewer(spark, documents):
    from corpus_pipeline import NEAR_COPIES
    from faultline.llm import nearcopies

    rows, expected = [], set()
    for n in range(120):
        words = [f"{n}v{i}" for i in range(8 + n % 4)]
        rows += [(2 * n, " ".join(words)), (2 * n + 1, " ".join([*words, "more"]))]
        expected.add(2 * n)
    # Three of four shingles are too few, also of repeated rows.
    rows += [(900, "a b c d e f g"), (901, "a b c d e f g h"), (901, "a b c d e f g h")]
    expected |= {900, 901}
    kept = nearcopies.keep_one(documents(rows), NEAR_COPIES)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(expected)


def test_excerpts_are_found_at_every_offset():
    draw = random.Random(4)
    item = " ".join("".join(draw.choice("abcdefghij") for _ in range(draw.randrange(2, 9))) for _ in range(60))
    spec = decontamination.Passages()
    index = decontamination.Index([(1, item)], spec)
    length = spec.segment + spec.step - 1
    assert length <= 80
    for at in range(len(item) - length + 1):
        assert index.search(b"zz yy xx " + item[at : at + length].encode() + b" ww vv uu"), at
    # One word of up to seven letters is another one, wherever it stands, in an item of 15 words.
    words = item.split(" ")[:15]
    words[-1] += "z" * (90 - len(" ".join(words)))
    short = decontamination.Index([(1, " ".join(words))], spec)
    for place, word in enumerate(words[:-1]):
        if len(word) <= 7:
            text = " ".join([*words[:place], "Q" * len(word), *words[place + 1 :]])
            assert short.search(decontamination.normalised("some words " + text + " more")), place


def test_found_rows_are_stored_before_the_next_block(spark, documents, monkeypatch):
    events, blocks, stored = [], decontamination._blocks, decontamination.materialise

    def fetched(*given):
        for block in blocks(*given):
            events.append("block")
            yield block

    monkeypatch.setattr(decontamination, "_blocks", fetched)
    monkeypatch.setattr(decontamination, "materialise", lambda f: (events.append("stored"), stored(f))[1])
    bench = spark.createDataFrame([(i, f"item number {i} " + "abcdefgh " * i) for i in range(1, 4)], "item_id long, text string")
    got = decontamination.contaminations(documents([(1, "item number 2 " + "abcdefgh " * 2)]), bench, decontamination.Passages(block=30))
    assert events == ["block", "stored"] * 3 and 2 in {r.item_id for r in got.collect()}
