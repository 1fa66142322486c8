import io
import random
import tarfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltstone.functions import names
from siltstone.functions.rolling import GEAR, gear, windows
from siltstone.operators import asof, chunking, codec, features, fingerprint, methods, similarity, store, tar
from siltstone.plans.storage import BATCH_BYTES

MASK = (1 << 64) - 1


def data(n, seed=0, alphabet=256):
    return np.random.default_rng(seed).integers(0, alphabet, n).astype(np.uint8).tobytes()


# ---------------------------------------------------------------- hashes and chunkers


def test_gear_and_windows_equal_the_scalar_loops():
    raw, h = data(500), 0
    for b, got in zip(raw, gear(raw).tolist()):
        h = (h << 1) + int(GEAR[b]) & MASK
        assert got == h
    for width in (1, 7, 48, 64):
        found = windows(np.frombuffer(raw, np.uint8), 257, width)
        for i in (0, 100, len(raw) - width):
            value = 0
            for b in raw[i : i + width]:
                value = value * 257 + b & MASK
            assert int(found[i]) == value


def scalar_fastcdc(raw, least, average, most, normalized):
    strict, loose = chunking.fastcdc_masks(average, 1, normalized)
    out, at = [], 0
    while at < len(raw):
        end = min(at + most, len(raw))
        h = 0
        for i, b in enumerate(raw):  # the hash goes on over cuts: only 64 bytes count
            h = (h << 1) + int(GEAR[b]) & MASK
            size = i + 1 - at
            if size > least and size <= most and h & (strict if size <= average else loose) == 0:
                end = i + 1
                break
        out.append(end)
        at = end
    return out


@pytest.mark.parametrize("normalized", [True, False])
def test_fastcdc_equals_the_scalar_loop(normalized):
    raw = data(12_000, 3)
    assert chunking.fastcdc_cuts(raw, 64, 256, 1024, normalized) == scalar_fastcdc(raw, 64, 256, 1024, normalized)


@pytest.mark.parametrize("raw", [b"", b"a", data(256), data(257), b"\0" * 65_536, data(50_000)])
def test_cuts_cover_the_input(raw):
    for ends, least, most in (
        (chunking.fastcdc_cuts(raw, 256, 1024, 4096), 256, 4096),
        (chunking.gear_cuts(raw, 10), 0, len(raw)),
    ):
        sizes = np.diff([0, *ends])
        assert sum(sizes) == len(raw) and all(least < s <= most for s in sizes[:-1])


def test_a_byte_in_front_moves_few_cuts():
    raw = data(200_000, 5)
    pieces = lambda x, ends: {x[a:b] for a, b in zip([0, *ends], ends)}
    cdc = pieces(raw, chunking.fastcdc_cuts(raw, 256, 1024, 4096))
    moved = pieces(b"x" + raw, chunking.fastcdc_cuts(b"x" + raw, 256, 1024, 4096))
    assert len(cdc & moved) > 0.95 * len(cdc)
    fixed = lambda x: {x[i : i + 1024] for i in range(0, len(x), 1024)}
    assert not fixed(raw) & fixed(b"x" + raw)


def test_fixed_chunks_of_edges(spark):
    rows = [(0, b""), (1, b"a"), (2, b"x" * 512), (3, b"y" * 513), (4, None)]
    df = spark.createDataFrame(rows, "version long, content binary")
    got = chunking.chunk(df, "content", "fixed", size=512).collect()
    assert sorted((r.version, r.seq, r.offset, r.chunk_size) for r in got) == [(1, 0, 0, 1), (2, 0, 0, 512), (3, 0, 0, 512), (3, 1, 512, 1)]


# ---------------------------------------------------------------- features


def test_features_equal_the_scalar_definitions():
    raw = data(3000, 7, 64)
    hashes = gear(raw).tolist()
    sample = [h for h in hashes if h >> 60 == 0]
    expected = [max((h * int(a) + int(b)) & MASK for h in sample) for a, b in zip(features._MULTIPLIERS, features._OFFSETS)]
    assert [x & MASK for x in features.odess(raw, 4)] == expected
    rolled = [int(x) for x in windows(np.frombuffer(raw, np.uint8), 257, 64)[:-1]]
    a, b = int(features._MULTIPLIERS[3]), int(features._OFFSETS[3])
    assert features.n_transform(raw)[3] == max(rolled, key=lambda h: (h * a + b) & 0xFFFFFFFF) & 0xFFFFFFFF
    assert features.odess(b"") is None and features.n_transform(b"a" * 64) is None and features.finesse(b"abc") is None


def test_near_copies_share_super_features(spark):
    raw = data(8000, 9, 80)
    near = raw[:4000] + b"edit" + raw[4000:]
    rows = [(0, raw), (1, near), (2, data(8000, 10, 80)), (3, b"")]
    chunks = spark.createDataFrame(rows, "chunk_id long, chunk binary")
    for kind in ("odess", "n_transform", "finesse", "palantir"):
        sfs = features.super_features(features.with_features(chunks, kind), kind)
        found = {(r.chunk_id, r.base_id) for r in similarity.oldest_match(sfs.where("tier < 3")).collect()}
        assert (2, 0) not in found and (3, 0) not in found, kind
        if kind != "finesse":  # its parts shift with the edit
            assert (1, 0) in found, kind


# ---------------------------------------------------------------- lookups and leaders


def test_latest_before_over_ranges(spark):
    rng = random.Random(2)
    rows = [(i, rng.randint(0, 3), rng.choice([None, i])) for i in rng.sample(range(20_000), 800)]
    df = spark.createDataFrame(rows, "id long, k int, v long")
    last, expected = {}, {}
    for i, k, v in sorted(rows):
        expected[i] = last.get(k)
        last[k] = v if v is not None else last.get(k)
    assert {r.id: r.got for r in asof.latest_before(df, ["k"], "id", F.col("v"), "got", 1000).collect()} == expected


def sequential_leaders(rows):
    by_chunk, registered, out = {}, set(), {}
    for chunk, sf in rows:
        by_chunk.setdefault(chunk, set()).add(sf)
    for chunk in sorted(by_chunk):
        out[chunk] = not by_chunk[chunk] & registered
        if out[chunk]:
            registered |= by_chunk[chunk]
    return out


def test_leaders_equal_the_sequential_scan(spark):
    rng = random.Random(6)
    cases = [[(0, 1), (1, 1), (1, 2), (2, 2)], [(k, s) for k in range(12) for s in (k, k + 1)]]
    cases.append([(rng.randrange(120), rng.randrange(60)) for _ in range(260)])
    for rows in cases:
        found = methods.leaders(spark.createDataFrame(rows, "chunk_id long, sf long"))
        assert {r.chunk_id: r.is_base for r in found.collect()} == sequential_leaders(rows)


def test_age_limits(spark):
    rows = [(v * 10 + t, v, t, 0, f"s{t}") for v in (0, 2, 3, 8, 9) for t in (1, 2, 3)]
    sfs = spark.createDataFrame(rows, "chunk_id long, version long, tier int, sf_pos int, sf string")
    found = {r.chunk_id: r.base_id for r in similarity.tiered_match(sfs, similarity.AGES).collect()}
    assert found == {21: 1, 22: 2, 23: 3, 31: 21, 32: 22, 33: 23, 81: 31, 82: 32, 91: 81, 92: 82, 93: 83}


def test_position_match(spark):
    events = [(0, 0, 0, True), (0, 1, 1, True), (1, 0, 0, False), (1, 1, 2, True), (1, 2, 1, False), (1, 3, 3, True), (1, 4, 4, True)]
    got = similarity.position_match(spark.createDataFrame(events, "version long, seq long, chunk_id long, is_new boolean"))
    # Guesses 1, 2 and 3 of the new chunks 2, 3 and 4 are not below the newest id less one.
    assert got.collect() == []
    later = [(v, s, c + 10 * (n and v > 0), n) for v, s, c, n in events]
    got = similarity.position_match(spark.createDataFrame(later, "version long, seq long, chunk_id long, is_new boolean"))
    assert sorted(map(tuple, got.collect())) == [(1, 1, 12, 1), (1, 3, 13, 2), (1, 4, 14, 3)]


# ---------------------------------------------------------------- codecs, methods, restore


def test_codecs_invert():
    base, noise = data(5000, 1, 90), data(3000, 2)
    target = base[:2500] + b"changed" + base[2500:]
    delta = codec.delta_encode(target, base)
    assert codec.delta_decode(delta, base) == target and len(delta) < 200
    for how in codec.LOCAL:
        assert codec.compress(noise, how) == ("raw", noise) and codec.compress(b"", how) == ("raw", b"")
        text = b"some words, again and again. " * 100
        kind, payload = codec.compress(text, how)
        assert kind == how and len(payload) < len(text) and codec.decompress(kind, payload, len(text)) == text
    # A large chunk sees all of its base, whatever lies in front.
    large = data(200_000, 5)
    moved = large[150_000:] + large[:150_000]
    assert len(codec.delta_encode(moved, large)) < 300 and codec.delta_decode(codec.delta_encode(moved, large), large) == moved
    for small in (b"", b"x"):
        assert codec.delta_decode(codec.delta_encode(noise, small), small) == noise and codec.delta_decode(codec.delta_encode(small, noise), noise) == small


def version_rows():
    base = data(30_000, 4, 60)
    out = []
    for v in range(6):
        at = 3000 * v
        out.append((v, base[:at] + bytes([v]) * 30 + base[at:]))
    return out + [(6, b""), (7, data(4000, 8)), (8, base)]


@pytest.mark.parametrize("method", ["dedup", "n_transform", "finesse", "odess", "palantir", "hybrid"])
def test_every_method_restores_and_keeps_depth_one(spark, method):
    rows = version_rows()
    content = spark.createDataFrame(rows, "version long, content binary")
    chunks = fingerprint.with_fingerprint(chunking.chunk(content, "content", "fastcdc", least=256, average=1024, most=4096))
    chunks = chunks.withColumn("name_hash", F.col("seq")).cache()
    index = fingerprint.chunk_index(chunks, "chunk", "name_hash").cache()
    stored = methods.reduce(index, method).cache()
    assert stored.count() == index.count()
    bases = {r.chunk_id for r in stored.where("base_chunk_id is null").collect()}
    deltas = stored.where("base_chunk_id is not null").collect()
    assert all(r.base_chunk_id in bases and r.save_size < r.chunk_size for r in deltas)
    if method not in ("dedup",):
        assert deltas, method
    recipe = fingerprint.recipes(chunks, index)
    whole = {r.version: bytes(r.content) for r in store.restore(recipe, stored, content).collect()}
    assert whole == dict(rows)
    pieces = {}
    for r in sorted(store.restore_pieces(recipe, stored, 5000).collect(), key=lambda r: r.piece):
        pieces[r.version] = pieces.get(r.version, b"") + bytes(r.content)
        assert len(r.content) < 5000 + 4096
    assert pieces == {v: c for v, c in rows if c}


def test_filters(spark):
    df = spark.createDataFrame([(100, 30), (100, 60), (100, 120)], "size long, saved long")
    ask = lambda accept: [r[0] for r in df.select(accept(F.col("size"), F.col("saved"))).collect()]
    assert ask(methods.fixed_filter(1)) == [True, True, False]
    assert ask(methods.fixed_filter(3)) == [True, False, False]
    figures = [(100, 50, 10, 5, 2, 0.5), (100, 50, 10, 5, 2, 0.0), (0, 0, 0, 0, 0, 1.0), (100, 50, 0, 0, 3, 1.0)]
    df = spark.createDataFrame(figures, "a long, b long, c long, d long, e long, beta double")
    least = methods.adaptive_least(*(F.col(c) for c in ("a", "b", "c", "d", "e", "beta")))
    assert [r[0] for r in df.select(least).collect()] == [4.0, 2.0, None, None]  # 2 + (10 / 5) * (5 // 2) * 0.5


def test_running_ratio_of_bases(spark):
    """A delta must beat what the bases before it have shrunk by."""
    rows = [(0, 400, "aa", None), (1, 300, None, b"x" * 100), (2, 800, "bbbb", None), (3, 300, None, b"x" * 100)]
    df = spark.createDataFrame(rows, "chunk_id long, chunk_size long, p string, delta binary")
    coded = df.select("chunk_id", "chunk_size", "delta", F.struct(F.encode(F.repeat("p", 50), "UTF-8").alias("payload")).alias("local"))
    got = {r.chunk_id: r.least for r in methods._with_running_ratio(coded).collect()}
    assert got == {0: methods.BASE_RATIO, 1: 4.0, 2: 4.0, 3: 4.0}


def sequential_next_fit(sizes, capacity):
    out, number, fill = [], -1, capacity + 1
    for s in sizes:
        if fill + s > capacity:
            number, fill = number + 1, 0
        out.append((number, fill))
        fill += s
    return out


@pytest.mark.parametrize("capacity", [50, 1000, 10**6])
def test_next_fit_equals_the_sequential_fold(spark, capacity):
    rng = random.Random(capacity)
    sizes = [rng.choice([0, 1, 5, 60, rng.randint(1, 90)]) for _ in range(700)]
    df = spark.createDataFrame(list(enumerate(sizes)), "id long, n long").repartition(5)
    got = sorted((r.id, r.container_id, r.container_offset) for r in store.next_fit(df, "id", "n", capacity).collect())
    assert [g[1:] for g in got] == sequential_next_fit(sizes, capacity)


def test_containers_and_lookup(spark, tmp_path):
    rows = [(i, "base_raw", None, 10, 10, "raw", bytes([i]) * 10) for i in range(30)]
    schema = "chunk_id long, store_kind string, base_chunk_id long, chunk_size long, save_size long, codec string, payload binary"
    store.write_containers(spark.createDataFrame(rows, schema), str(tmp_path / "c"), 64)
    back = spark.read.parquet(str(tmp_path / "c"))
    assert back.groupBy("container_id").agg(F.sum("save_size").alias("n")).where("n > 64").count() == 0
    assert {r.chunk_id: bytes(r.chunk) for r in store.read_chunks(back).collect()} == {i: bytes([i]) * 10 for i in range(30)}


def test_order_numbers(spark):
    df = spark.createDataFrame([(i * 7 % 101, i) for i in range(101)], "k long, v long").repartition(6)
    assert sorted((r.k, r.no) for r in fingerprint.with_order_number(df, "k", name="no").collect()) == [(i, i) for i in range(101)]


# ---------------------------------------------------------------- archives and names


def archive(format):
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w", format=format) as out:
        for name, body in [("v1/a/b.c", data(700)), ("v1/empty", b""), ("v1/" + "long/" * 40 + "n.txt", data(1500, 2)), ("v1/big", data(9000, 3)), ("v1/z", b"z")]:
            info = tarfile.TarInfo(name)
            info.size = len(body)
            out.addfile(info, io.BytesIO(body))
        folder = tarfile.TarInfo("v1/dir")
        folder.type = tarfile.DIRTYPE
        out.addfile(folder)
    return buffer.getvalue()


@pytest.mark.parametrize("format", [tarfile.USTAR_FORMAT, tarfile.GNU_FORMAT, tarfile.PAX_FORMAT])
def test_archives_cut_move_and_restore(spark, format):
    raw = archive(format)
    assert tar.restore_migrated(tar.migrate(raw)) == raw
    assert b"".join(raw[a : a + n] for _, a, n in tar.tar_cuts(raw, 4096, 256, 1024, 4096)) == raw
    grouped = tar.grouped_headers(raw, 2, big=4096, least=256, average=1024, most=4096)
    assert sorted(p for _, parts in grouped for p in parts) == sorted((a, n) for _, a, n in tar.tar_cuts(raw, 4096, 256, 1024, 4096))
    df = spark.createDataFrame([(0, raw), (1, b""), (2, b"no archive")], "version long, content binary")
    for headers in (None, 1, 3, 16):
        chunks = tar.chunk_archives(df, headers=headers, big=4096, least=256, average=1024, most=4096)
        assert {r.version: bytes(r.content) for r in tar.restore_archives(chunks).collect()} == {0: raw, 2: b"no archive"}


def test_archives_are_rewritten_in_place(spark):
    raw = archive(tarfile.GNU_FORMAT)
    rows = [(0, raw, "a"), (1, None, "b"), (2, raw, None)]
    df = spark.createDataFrame(rows, "version long, content binary, other string")
    moved = tar.rewrite(df, tar.migrate)
    assert {(r.version, r.content, r.other) for r in moved.collect()} == {(v, c and tar.migrate(c), o) for v, c, o in rows}
    assert {tuple(r) for r in tar.rewrite(moved, tar.restore_migrated).collect()} == set(rows)
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    many = spark.range(0, 3 * (BATCH_BYTES // len(raw)), 1, 1).select(F.lit(raw).alias("content"))
    size = lambda batches: (b.slice(0, 1).set_column(0, "content", pa.array([b.nbytes.to_bytes(8, "big")], pa.binary())) for b in batches)
    got = tar.rewrite(many, tar.migrate).mapInArrow(size, "content binary").collect()
    assert max(int.from_bytes(r.content, "big") for r in got) <= BATCH_BYTES + 64 * len(raw)


def test_name_functions(spark):
    rows = [("v1/a/b.c",), ("noslash",), ("v1/a",), ("v1/a/b/c/d",), ("x/",), ("",)]
    df = spark.createDataFrame(rows, "n string")
    n = F.col("n")
    got = df.select("n", names.without_first(n).alias("rest"), names.directory_key(n).alias("key"), names.name_hash(n).alias("h")).collect()
    found = {r.n: (r.rest, r.key) for r in got}
    assert found == {
        "v1/a/b.c": ("a/b.c", "/a"), "noslash": ("noslash", ""), "v1/a": ("a", ""), "v1/a/b/c/d": ("a/b/c/d", "/a/b"),
        "x/": ("", ""), "": ("", ""),
    }
    for r in got:
        h = 0
        for b in r.n.encode()[:101]:
            h = (h * 1099511628211 + b) & MASK
        assert r.h == f"{h:016x}"


def test_natural_order(spark):
    given = ["f10", "F3", "f2", "f2a", "a", "f02"]
    df = spark.createDataFrame([(x,) for x in given], "n string")
    assert [r.n for r in df.orderBy(names.natural_key(F.col("n")), "n").collect()] == ["a", "f02", "f2", "f2a", "F3", "f10"]
