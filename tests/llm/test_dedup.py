import hashlib
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from siltstone.llm import exact, line_dedup, minhash, queries, suffix_dedup
from siltstone.llm.components import components
from siltstone.llm.shingles import shingle_sets

from .conftest import CLASHING, hostile_rows, words


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


# ---------------------------------------------------------------- exact


@pytest.mark.parametrize("hot_keys", [1, 10_000])  # no key is hot, each key is
@pytest.mark.parametrize("digest, small", [("all", 0), ("survivors", 1000), ("survivors", 0)])
def test_exact_groups(hostile, digest, small, hot_keys, monkeypatch):
    monkeypatch.setattr(exact, "HOT_KEYS", hot_keys)
    got = sorted(exact.exact_groups(hostile, digest=digest, small=small).collect(), key=repr)
    groups = defaultdict(list)
    for k, t in hostile_rows():
        groups[t or ""].append(k)
    expected = []
    for text, ids in groups.items():
        keep = max((k for k in ids if k is not None), default=None)
        for k in ids:
            read = digest == "all" or len(ids) > 1 or next((r.text_sha256 for r in got if r.doc_id == k), None)
            expected.append((k, keep, len(ids), k == keep, sha(text) if read else None))
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)


def test_exact_filter_keeps_columns_and_one_of_each(hostile):
    kept = exact.deduplicate(hostile)
    assert kept.columns == hostile.columns
    texts = [r.text or "" for r in kept.collect()]
    assert sorted(texts) == sorted({t or "" for _, t in hostile_rows()})


def test_exact_filter_reserves_no_names(spark):
    rows = [(1, "a", 5, "x", 1, "s", 7), (2, "a", 6, "y", 2, "t", 8), (3, "b", 7, None, 3, "u", 9), (3, "b", 7, None, 3, "u", 9), (None, "b", 0, "z", 4, "v", 0)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, gone_id int, gone_sha string, __siltstone_id int, `_OWN_0` string, _own_1 int")
    kept = exact.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect())) == sorted([rows[1], rows[2]])


def test_levels_group_only_survivors(spark, tmp_path):
    """Of texts of one length with one prefix, and of texts alone at a level."""
    head = "p" * 64
    texts = ["one", "two", "three", head + "a", head + "b", head + "a", "q" * 64 + "a", "alone by length"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size, r.text_sha256 is None) for r in exact.exact_groups(docs, digest="survivors").collect()}
    assert got == {
        0: (0, 1, True), 1: (1, 1, True), 2: (2, 1, True), 3: (5, 2, False), 4: (4, 1, False), 5: (5, 2, False),
        6: (6, 1, True), 7: (7, 1, True),
    }


def test_exact_of_an_empty_table(empty):
    assert exact.exact_groups(empty).collect() == [] and exact.deduplicate(empty).collect() == []


# ---------------------------------------------------------------- near


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_near(rows):
    sets = {k: shingles(t) for k, t in rows if k is not None}
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in sets}


def test_shingle_sets_match_words():
    rng = random.Random(1)
    texts = ["", None, " \x0b\x0c", "A b", "a B\tc\nD\re", "é É x y z w q", *(words(rng, n) for n in (3, 5, 6, 200))]
    for text, found in zip(texts, shingle_sets(texts)):
        assert len(found) == len(shingles(text))


def test_words_that_a_polynomial_hash_confuses(spark):
    """A Thue-Morse word and its complement are equal under any polynomial modulo a power of two."""
    word = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    other = word.translate({97: 98, 98: 97})
    rows = [(1, word), (2, other), (3, f"{word} x {other} y z"), (4, f"{other} x {word} y z"), (5, f"{word} {other}")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {k: (1, k) for k in range(1, 6)}
    for n in (7, 8, 9, 63, 64, 65, 200):
        assert len(shingle_sets([f"{word[:n]} {other[:n]}"], 1)[0]) == 2


def test_near_duplicates(hostile):
    expected = brute_near(hostile_rows())
    for blocks in ({}, {"block_sets": 2}):  # large buckets as pairs of blocks
        for r in minhash.near_duplicates(hostile, **blocks).collect():
            if r.doc_id is None:
                assert (r.component_id, r.kept) == (None, False)
            else:
                n, component = expected[r.doc_id]
                assert (r.n_shingles, r.component_id, r.kept) == (n, component, component == r.doc_id)


def test_near_copies_of_one_text_that_only_meet_through_it(spark):
    """The base is not the least id: buckets must be searched whole."""
    rng = random.Random(4)
    base = words(rng, 200).split()
    rows = [(999, " ".join(base))]
    for k in range(60):
        own = list(base)
        for place in rng.sample(range(len(own)), 4):
            own[place] = words(rng, 2).replace(" ", "")
        rows.append((k, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute_near(rows)
    for r in minhash.near_duplicates(docs, block_sets=7).collect():
        assert r.component_id == expected[r.doc_id][1]


def test_near_filter_keeps_columns(hostile):
    kept = minhash.deduplicate(hostile)
    assert kept.columns == hostile.columns
    expected = brute_near(hostile_rows())
    ids = {r.doc_id for r in kept.collect()}
    assert ids == {None} | {k for k, (_, c) in expected.items() if c == k}


def test_near_of_an_empty_table(empty):
    assert minhash.near_duplicates(empty).collect() == []


def test_components_of_chains_and_stars(spark):
    links = [(k + 1, k) for k in range(0, 60)] + [(200 + k, 100) for k in range(50)] + [(7, 7), (300, 301), (301, 300)]
    found = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {k: 0 for k in range(1, 61)} | {200 + k: 100 for k in range(50)} | {301: 300}


def test_unfinished_components_fail(spark):
    links = spark.createDataFrame([(k + 1, k) for k in range(300)], "a long, b long")
    with pytest.raises(RuntimeError):
        components(links, max_rounds=2)


# ---------------------------------------------------------------- repeated byte strings


def brute_repeats(rows, window):
    docs = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    first, out = {}, []
    for k, t in docs:
        raw = (t or "").encode()
        rank = float("inf") if k is None else k
        for p in range(len(raw) - window + 1):
            s = raw[p : p + window]
            first[s] = min(first.get(s, rank), rank)
    for k, t in docs:
        raw, rank = (t or "").encode(), float("inf") if k is None else k
        gone = bytearray(len(raw))
        for p in range(len(raw) - window + 1):
            if first[raw[p : p + window]] < rank:
                gone[p : p + window] = b"\1" * window
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((k, len(raw), sum(gone), spans, sha(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [1, 4096])
def test_repeats(hostile, hot):
    got = suffix_dedup.remove_repeats(hostile, block_bytes=3000, bucket_bytes=5000, hot_blocks=hot)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_repeats(hostile_rows(), 50)


def test_repeats_of_an_empty_table(empty):
    assert suffix_dedup.remove_repeats(empty).collect() == []


def test_a_string_in_every_block(spark):
    """Hot strings go by themselves, bucket lists are merged in groups of blocks; the result is the same."""
    rng = random.Random(6)
    common = words(rng, 20)
    rows = [(k, words(rng, 10) + "\n" + common + "\n" + words(rng, 10 + k % 3)) for k in range(40)] + [(None, common)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for hot in (3, 4096):
        got = suffix_dedup.remove_repeats(docs, block_bytes=300, bucket_bytes=800, hot_blocks=hot)
        assert sorted(map(tuple, got.collect()), key=repr) == brute_repeats(rows, 50)


def test_blocks_grow_with_the_input():
    assert suffix_dedup.sizes(1 << 30, 2 << 20, 4 << 20) == (2 << 20, 256)
    block, buckets = suffix_dedup.sizes(100 << 40, 2 << 20, 4 << 20)
    assert block <= 64 << 20 and buckets <= block / 14 * 1.01


def test_anchors_own_each_string_once():
    rng = np.random.default_rng(2)
    text = rng.integers(97, 100, 5000).astype(np.uint8)
    ends = np.array([0, 1200, 1230, 1300, 5000])
    place, first, last = suffix_dedup.anchors(text, ends, 50, 24)
    owned = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last)])
    inside = [p for s, e in zip([0, 0, 1200, 1230, 1300], ends) for p in range(s, e - 49)]
    assert owned.tolist() == inside
    assert all(b - 24 >= p - 50 and a <= p <= b + 26 for p, a, b in zip(place, first, last))


# ---------------------------------------------------------------- lines


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_distance_and_segments():
    rng = random.Random(3)
    plan = line_dedup._Plan(4)
    for _ in range(3000):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(0, 14)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "c"])
        b = "".join(b)
        distance = edit_distance(a, b)
        for edits in (1, 2, 3):
            assert line_dedup.within(a, b, edits) == (distance <= edits)
        short, long = sorted((a, b), key=len)
        if len(short) >= 4 and distance <= len(short) // 4:
            index, _ = plan.grams(short)
            own, others = plan.grams(long)
            assert set(index.tolist()) & {*own.tolist(), *others.tolist()}


def line_rows():
    rng = random.Random(8)
    common = [words(rng, 9) for _ in range(6)]
    rows = [(None, common[0]), (None, None), (0, None), (1, ""), (2, "\n\n"), (3, common[0]), (4, " " + common[0] + " ")]
    for k in range(10, 40):
        lines = []
        for line in rng.sample(common, 3):
            edited = list(line)
            for _ in range(rng.randint(0, 3)):
                edited[rng.randrange(len(edited))] = rng.choice("xyz")
            lines.append("".join(edited))
        rows.append((k, "\n".join([*lines, "short", words(rng, 8), "", lines[0]])))
    return rows


def brute_lines(rows, grow=16):
    docs = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    first = {}
    for d, (_, t) in enumerate(docs):
        for i, line in enumerate((t or "").split("\n")):
            if line.strip():
                first.setdefault(line.strip(), (d, i))
    allowed = lambda x, y: min(len(x), len(y)) // grow
    close = lambda x, y: abs(len(x) - len(y)) <= allowed(x, y) and edit_distance(x, y) <= allowed(x, y)
    linked = {x: [y for y in first if y != x and close(x, y)] for x in first}
    out = []
    for d, (k, t) in enumerate(docs):
        lines = repeats = near = links = 0
        kept = []
        for i, line in enumerate((t or "").split("\n")):
            x = line.strip()
            if not x:
                kept.append(line)
                continue
            lines += 1
            if first[x] != (d, i):
                repeats += 1
                continue
            links += len(linked[x])
            if any(first[y] < (d, i) for y in linked[x]):
                near += 1
            else:
                kept.append(line)
        out.append((k, lines, repeats, near, links, sha("\n".join(kept))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("task_lines", [2, 1024])
def test_lines(spark, task_lines):
    rows = line_rows()
    docs = spark.createDataFrame([(k, t, *[None] * 10) for k, t in rows], f"doc_id long, text string, {CLASHING}").repartition(3)
    got = line_dedup.deduplicate_lines(docs, block_bytes=400, bucket_bytes=500, task_lines=task_lines)
    expected = brute_lines(rows)
    assert sum(r[3] for r in expected) > 5
    assert sorted(map(tuple, got.collect()), key=repr) == expected


def long_line_rows():
    """Lines of 12 to 300 characters and copies with up to a little over one edit for 16 characters, or replaced words."""
    rng = random.Random(21)
    rows = []
    for k in range(12):
        line = list(words(rng, [5, 7, 8, 9, 10, 16, 18, 20, 22, 50, 3, 4][k]))
        for copy in range(4):
            edited = list(line)
            for _ in range(rng.randint(0, len(line) // 16 + 1)):
                at = rng.randrange(len(edited))
                edited[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "yz"])
            if copy == 3:
                at = rng.randrange(len(edited))
                edited[at : at + 4] = "other"
            rows.append((4 * k + copy, "".join(edited) + "\n" + "ab " * (20 + k)))
    return rows


def test_edits_grow_with_the_line(spark, monkeypatch):
    rows = long_line_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    got = sorted(map(tuple, queries.op5_line_dedup(spark, "").collect()), key=repr)
    expected = brute_lines(rows)
    assert got == expected and sum(r[3] for r in expected) > 12


def test_long_distances():
    rng = random.Random(5)
    for _ in range(400):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(1, 60)))
        b = "".join(rng.choice(["", "c", x, x, x, x, x + "a"]) for x in a)
        distance = edit_distance(a, b)
        for edits in (4, 6, 9, 15):
            assert line_dedup.within(a, b, edits) == (distance <= edits)
            assert line_dedup.may_be_within(a, b, edits) or distance > edits


def test_lines_send_few_keys():
    rng = random.Random(12)
    lines = sorted((words(rng, rng.randint(4, 120)) for _ in range(200)), key=len)
    keys = [line_dedup._Plan(16).grams(line) for line in lines]
    assert sum(len(own) + len(others) for own, others in keys) < 0.75 * sum(map(len, lines))


def test_only_pieces_rarer_than_their_neighbours_are_keys():
    """All pieces counted once: 0.31 keys a character of these lines."""
    rng = random.Random(12)
    vocabulary = words(rng, 800).split()
    lines = sorted((" ".join(rng.choice(vocabulary) for _ in range(rng.randint(12, 120))) for _ in range(300)), key=len)
    plan = line_dedup._Plan(16, line_dedup._learn(*line_dedup._count_pieces(["\n".join(lines)])))
    assert len(plan.keys(lines)[0]) < 0.28 * sum(map(len, lines))


def test_near_lines_share_a_key_even_with_few_pieces_rarer_than_their_neighbours():
    rng = random.Random(18)
    plan, odd, met = line_dedup._Plan(16), 0, 0
    for _ in range(1500):
        n, part = rng.randint(64, 300), "".join(rng.choice("abcd") for _ in range(rng.randint(1, 40)))
        a = "".join(rng.choice("abcdefgh ") for _ in range(n)) if rng.random() < 0.5 else (part * n)[:n]
        b = list(a)
        step = rng.choice([15, 16, 17])
        for at in range(rng.randint(0, 16), n, step) if rng.random() < 0.7 else rng.sample(range(n), n // 16):
            b[at : at + 1] = rng.choice(["", "x", "y", "xy", b[at : at + 1]])
        b = "".join(b)
        if a == b or not line_dedup.within(a, b, min(len(a), len(b)) // 16):
            continue
        met += 1
        odd += sum(plan.chosen([x], 10, 1, 1)[3].any() for x in (a, b))
        line, _, hashed, _ = plan.keys(sorted((a, b), key=len))
        assert set(hashed[line == 0].tolist()) & set(hashed[line == 1].tolist())
    assert met > 200 and odd > 50


def test_distances_in_step(monkeypatch):
    rng = random.Random(6)
    pairs = []
    for k in range(1500):
        a = "".join(rng.choice("abc\u00e9\U0001f600" if k % 9 == 0 else "abc\u00e9") for _ in range(rng.randint(1, rng.choice([20, 80, 300, 700]))))
        edits = rng.choice([0, 1, 3, 31, 33, len(a) // 16, len(a) // 16 + 1])
        b = list(a)
        for _ in range(rng.randint(0, edits * 4 // 3 + 1)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "xy"])
        pairs.append((a, "".join(b), edits))
    expected = [line_dedup.within(*p) for p in pairs]
    assert line_dedup.within_all(pairs).tolist() == expected and 300 < sum(expected) < 1400
    monkeypatch.setattr(line_dedup, "BAND_WORDS", 5000)  # many letters
    assert line_dedup.within_all(pairs).tolist() == expected


def test_many_edits_go_in_step(monkeypatch):
    """A word holds the diagonals of 62 edits, since what leaves the last one must come back to it."""
    rng = random.Random(14)
    pairs, expected = [], []
    for _ in range(150):
        a = "".join(rng.choice("abcdefgh") for _ in range(rng.randint(70, 140)))
        b = list(a)
        for _ in range(rng.randint(20, 90)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "a", "bc"])
        moved = rng.randint(0, 40) if rng.random() < 0.3 else 0
        b = "".join(b[moved:]) + a[:moved]
        distance = edit_distance(a, b)
        for edits in (distance - 1, distance, rng.randint(32, 62)):
            if abs(len(a) - len(b)) <= edits <= 62:
                pairs.append((a, b, edits))
                expected.append(distance <= edits)
    monkeypatch.setattr(line_dedup, "_columns", None)
    assert line_dedup.within_all(pairs).tolist() == expected and 100 < sum(expected) < len(expected) - 100


def test_pairs_pack_well():
    """By planes of bytes they take much less than as they are."""
    rng = np.random.default_rng(16)
    pairs = np.empty(4000, line_dedup._PAIR)
    pairs["line"], pairs["other"] = np.sort(rng.integers(0, 6000, 4000)), rng.integers(0, 6000, 4000)
    pairs["block"] = rng.integers(0, 32, 4000) << 32 | rng.integers(0, 13, 4000)
    raw = line_dedup._pack_pairs(pairs)
    assert (line_dedup._unpack_pairs(raw) == pairs).all() and len(raw) < 0.75 * len(line_dedup._pack(pairs.tobytes()))
    assert len(line_dedup._unpack_pairs(line_dedup._pack_pairs(pairs[:0]))) == 0


def test_counts_of_neighbours_rule_out_lines_of_the_same_letters():
    rng = random.Random(15)
    lines = ["".join(rng.choice("abcd efgh") for _ in range(rng.randint(16, 700))) for _ in range(40)]
    others = []
    for line in lines:
        near = list(line)
        for _ in range(len(line) // 16):
            at = rng.randint(0, len(near))
            near[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "é"])
        others.append("".join(near))
    turned = ["".join(rng.sample(line, len(line))) for line in lines]
    one, two = line_dedup._Neighbours(lines), line_dedup._Neighbours(others + turned)
    at = np.arange(40)
    close = np.array([edit_distance(a, b) <= min(len(a), len(b)) // 16 for a, b in zip(lines, others)])
    assert one.fit(at, two, at, 16)[close].all() and close.sum() > 20
    assert one.fit(at, two, at + 40, 16).sum() < 4


def test_pairs_of_a_block_are_decided_a_few_at_a_time(monkeypatch):
    """However many pairs two blocks have, only so many wait with their lines."""
    rng = random.Random(17)
    base = words(rng, 30)
    rows = [(k, "\n".join(f"{base} {n}{k}" for n in "abcdefgh")) for k in range(12)]
    made = line_dedup._Lines(np.arange(12), [text for _, text in rows])
    raw = [text.encode() for _, text in rows]
    n = len(made.lines)
    row = pa.table({
        "block": [1], "ids": [np.arange(12).tobytes()], "lengths": [np.array([len(x) for x in raw]).tobytes()],
        "text": [line_dedup._pack(b"".join(raw))],
    })
    of, other = (x.ravel().astype("<i4") for x in np.meshgrid(np.arange(n), np.arange(n)))
    pairs = np.empty(n * n, line_dedup._PAIR)
    pairs["line"], pairs["other"], pairs["block"] = of, other, 2
    answers = pa.table({"block": [1], "list": [line_dedup._pack_pairs(pairs[np.argsort(of, kind="stable")])]})
    sent = line_dedup._send_lines(row, answers)
    counts, real = [], line_dedup.within_all
    monkeypatch.setattr(line_dedup, "within_all", lambda tried: counts.append(len(tried)) or real(tried))
    whole = line_dedup._join(16)(row, sent)
    assert sum(counts) == n * n == 96 * 96
    counts.clear()
    monkeypatch.setattr(line_dedup, "TRIED", 500)
    keys = [("block", "ascending"), ("entry", "ascending")]
    assert line_dedup._join(16)(row, sent).sort_by(keys) == whole.sort_by(keys)
    assert sum(counts) == n * n and max(counts) < 1000


def test_a_piece_that_lines_repeat(spark):
    rng = random.Random(13)
    spam = ["And " * 60 + words(rng, 3) + " And" * rng.randint(0, 6) for _ in range(40)]
    rows = [(k, "\n".join([line, "".join("x" if rng.random() < 0.03 else c for c in line)])) for k, line in enumerate(spam)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = line_dedup.deduplicate_lines(docs, block_bytes=4000)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_lines(rows)


def test_lines_of_hostile_rows_and_of_none(hostile, empty):
    assert line_dedup.deduplicate_lines(hostile).count() == len(hostile_rows())
    assert line_dedup.deduplicate_lines(empty).collect() == []
    kept = line_dedup.deduplicate_lines(hostile, texts=True)
    assert {r.doc_id: r.kept_sha256 for r in kept.collect()}[3] == ""
