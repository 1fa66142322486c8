import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siltstone.llm import packing, token_ids, tokens

from .conftest import hostile_rows


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokens.vocabulary_path())


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab é.,'!\n\t \x1c1x<|endoftext|>", max_size=40))
def test_encoder_equals_library(text):
    coder = tokens.encoder(tokens.vocabulary_path())
    assert coder.encode([text]) == [coder.whole(text)]


def test_words_at_line_ends_are_cached_once():
    """Each word is known for itself, not for the word that begins the next line."""
    coder = tokens.Encoder(tokens.vocabulary_path())
    words = [a + b for a in ("ka", "lo", "mi", "ter", "an") for b in ("so", "ri", "é", "mu", "el")]
    text = " ".join(f"{a}.\n{b}" for a in words for b in words)
    before = [len(x) for x in vars(coder).values() if isinstance(x, dict)]
    assert coder.encode([text, "\n" + text, " " + text, text + "\n"]) == [coder.whole(x) for x in (text, "\n" + text, " " + text, text + "\n")]
    assert sum(len(x) for x in vars(coder).values() if isinstance(x, dict)) - sum(before) <= 4 * len(words)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_a_million_words_stay_cached_if_asked_for():
    path = tokens.vocabulary_path()
    coder = tokens.encoder(path, cache_words=1_350_000)
    coder.known.update((str(k), b"") for k in range(1_200_000))
    coder.encode(["once"])
    assert len(coder.known) > 1_200_000
    tokens.encoder(path).encode(["once"])
    assert len(coder.known) < 1000


def test_levels_round_trip_and_random_access():
    rng = np.random.default_rng(0)
    for top in (1, 200, 300, 70_000, 1 << 32):
        ids = rng.integers(0, top, 3000, dtype=np.uint64).astype(np.uint32)
        levels, bitmaps, ranks = token_ids.encode_levels(ids)
        assert (token_ids.decode_levels(levels, bitmaps) == ids).all()
        for i in rng.integers(0, len(ids), 200).tolist():
            assert token_ids.access(levels, bitmaps, ranks, i) == ids[i]


def test_token_ids_of_hostile_rows(hostile, library):
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_ids.digest(hostile, segment_tokens=500).collect())
    rows = sorted(hostile_rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at, expected = 0, []
    for key, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        expected.append((at, key, len(ids), crc(ids)))
        at += len(ids)
    assert got == expected


def test_rows_without_ids_fill_several_ranges(spark, library):
    """Two thirds of all rows have no id and one text: they share no single task, and each keeps its place."""
    from siltstone.llm.common import in_order

    rows = [(None, "the same text") for _ in range(4000)] + [(k, f"text {k}") for k in range(2000)]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = in_order(docs).rdd.glom().map(len).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(sizes) < 2000
    got = sorted(tuple(r) for r in token_ids.digest(docs, id_col="id").select("start", "n_tokens").collect())
    assert len(got) == 6000 and all(a + n == b for (a, n), (b, _) in zip(got, got[1:]))


def test_token_ids_of_an_empty_table(empty):
    assert token_ids.digest(empty).collect() == []


def test_random_access_in_files(spark, hostile, library, tmp_path):
    path = str(tmp_path / "ids")
    token_ids.write(hostile, path, tokens.vocabulary_path())
    segments = token_ids.open_segments(spark, path)
    first = segments.orderBy("part", "segment").first()
    whole = token_ids.decode_levels(first.levels, first.bitmaps)
    places = [0, len(whole) // 2, len(whole) - 1]
    assert token_ids.tokens_at(segments, first.part, first.segment, places) == whole[places].tolist()


def check_pieces(pieces, documents):
    """documents: list of (id, ids with their end)."""
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    spans = {}
    for key, own in by_doc.items():
        spans[key] = sorted((p.start, p.length, p.ids_crc32, p.doc_tokens) for p in own)
    for key in {k for k, _ in documents}:
        texts = [ids for k, ids in documents if k == key]
        assert sum(s[1] for s in spans[key]) == sum(map(len, texts))
        if len(texts) == 1:
            at = 0
            for start, length, check, total in spans[key]:
                assert (start, total, check) == (at, len(texts[0]), crc(texts[0][at : at + length]))
                at += length
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == np.cumsum([0] + [p.length for p in own])[:-1].tolist()
        assert sum(p.length for p in own) <= 2048


def test_packing_of_hostile_rows(hostile, library):
    pieces = packing.pack(hostile, block_tokens=30_000).collect()
    check_pieces(pieces, [(k, library.encode(t or "", add_special_tokens=False).ids + [1]) for k, t in hostile_rows()])
    lengths = {}
    for p in pieces:
        lengths[p.sequence_id] = lengths.get(p.sequence_id, 0) + p.length
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in lengths.values())
    assert padding <= 8 * 2048  # a last window for each range of documents


def test_packing_of_an_empty_table(empty):
    assert packing.pack(empty).collect() == []


def brute_cost(places, price, size):
    best = [0] + [None] * (len(places) - 1)
    for j in range(1, len(places)):
        for i in range(j):
            length = places[j] - places[i]
            if length <= size:
                pad = 0 if length & (length - 1) == 0 else size - length
                cost = best[i] + pad + price[j]
                best[j] = cost if best[j] is None else min(best[j], cost)
    return best[-1]


def test_windows_have_least_cost():
    rng = np.random.default_rng(5)
    for _ in range(200):
        gaps = rng.integers(1, 9, rng.integers(1, 30))
        places = np.concatenate(([0], np.cumsum(gaps)))
        kinds = rng.integers(0, 3, len(places))
        price = np.array([0, 2, 8])[kinds]
        price[-1] = 0
        windows = packing.cut(places, kinds, 16, (0, 2, 8))
        cost, at = 0, 0
        for end in windows:
            length = end - at
            pad = 0 if length & (length - 1) == 0 else 16 - length
            cost += pad + price[np.searchsorted(places, end)]
            at = end
        assert windows[-1] == places[-1] and cost == brute_cost(places.tolist(), price.tolist(), 16)
