"""The engine's queries over the test tables, with their DuckDB equivalents beside them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import feature_queries  # noqa: F401
from .functions import names
from .operators import chunking, fingerprint, methods, similarity, store, tar
from .plans import analysis, metrics
from .plans.storage import save, shared_dir
from .registry import ORACLE_SQL, QUERIES, query  # noqa: F401
from .registry import table as _table
from .streaming import ingest



# ---------------------------------------------------------------- chunks and fingerprints

SIZE = 512


def _content(spark, d):
    return _table(spark, d, "documents").select(F.col("doc_id").alias("version"), "lang", "source", chunking.utf8("text").alias("content"))


def _chunks(spark, d, size: int = SIZE):
    return fingerprint.with_fingerprint(chunking.fixed(_content(spark, d), "content", size))


def _narrow(spark, d):
    return _chunks(spark, d).drop("chunk")


_F = """WITH b AS (SELECT doc_id AS version, lang, source, encode(coalesce(text, '')) AS content FROM documents),
 c AS (SELECT version, lang, source, i AS seq, i * 512 AS "offset", unhex(substr(hex(content), (i * 1024 + 1)::BIGINT, 1024)) AS chunk
       FROM (SELECT *, unnest(range(0, ((octet_length(content) + 511) // 512)::BIGINT)) AS i FROM b)),
 f AS (SELECT version, lang, source, seq, "offset", octet_length(chunk)::BIGINT AS chunk_size, sha256(chunk) AS fp FROM c),
 u AS (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY version, seq) AS nth FROM f),
 x AS (SELECT fp, version, seq, chunk_size, row_number() OVER (ORDER BY version, seq) - 1 AS chunk_id FROM u WHERE nth = 1)
"""


@query(_F + """SELECT count(*) AS logical_chunks, count(*) FILTER (nth = 1) AS unique_chunks, sum(chunk_size)::BIGINT AS logical_bytes,
 (sum(chunk_size) FILTER (nth = 1))::BIGINT AS unique_bytes, round(sum(chunk_size) / (sum(chunk_size) FILTER (nth = 1)), 6) AS dedup_ratio FROM u""")
def dedup_report(spark, d):
    """Logical and unique chunks and bytes of all documents, and their ratio."""
    per_fp = _narrow(spark, d).groupBy("fp").agg(F.count("*").alias("n"), F.sum("chunk_size").alias("bytes"), F.min("chunk_size").alias("one"))
    logical, unique = F.sum("bytes"), F.sum("one")
    return per_fp.agg(
        F.sum("n").alias("logical_chunks"), F.count("*").alias("unique_chunks"), logical.alias("logical_bytes"),
        unique.alias("unique_bytes"), F.round(logical / unique, 6).alias("dedup_ratio"),
    )


@query(_F + 'SELECT version, seq, "offset", chunk_size, fp FROM f')
def fixed_chunks(spark, d):
    return _chunks(spark, d).select("version", "seq", "offset", "chunk_size", "fp")


@query(_F + "SELECT chunk_id, fp, version, seq, chunk_size FROM x")
def unique_chunks(spark, d):
    return fingerprint.chunk_index(_narrow(spark, d)).select("chunk_id", "fp", "version", "seq", "chunk_size")


@query(_F + "SELECT f.version, f.seq, x.chunk_id FROM f JOIN x ON f.fp = x.fp")
def recipe(spark, d):
    chunks = _narrow(spark, d)
    return fingerprint.recipes(chunks, fingerprint.chunk_index(chunks))


@query(_F + "SELECT f.version, f.seq, x.chunk_id, x.version AS first_version, x.chunk_size FROM f JOIN x ON f.fp = x.fp")
def chunk_metadata(spark, d):
    """Metadata of the chunk behind every recipe entry."""
    chunks = _narrow(spark, d)
    index = fingerprint.chunk_index(chunks)
    looked = index.select("chunk_id", F.col("version").alias("first_version"), "chunk_size")
    return fingerprint.recipes(chunks, index).join(looked, "chunk_id").select("version", "seq", "chunk_id", "first_version", "chunk_size")


@query(_F + """SELECT source, count(*) AS chunks, count(*) FILTER (nth > 1) AS duplicates, sum(chunk_size)::BIGINT AS bytes,
 coalesce(sum(chunk_size) FILTER (nth > 1), 0)::BIGINT AS duplicate_bytes FROM u GROUP BY source""")
def dup_by_source(spark, d):
    chunks = _narrow(spark, d)
    first = fingerprint.first_occurrences(chunks).select("fp", F.col("version").alias("v"), F.col("seq").alias("s"))
    again = (F.col("version") != F.col("v")) | (F.col("seq") != F.col("s"))
    return chunks.join(first, "fp").groupBy("source").agg(
        F.count("*").alias("chunks"), F.count_if(again).alias("duplicates"), F.sum("chunk_size").alias("bytes"),
        F.coalesce(F.sum(F.when(again, F.col("chunk_size"))), F.lit(0)).alias("duplicate_bytes"),
    )


@query(_F + "SELECT fp, count(DISTINCT lang) AS langs, count(*) AS n FROM f GROUP BY fp HAVING count(DISTINCT lang) > 1")
def cross_lang_shared(spark, d):
    per = _narrow(spark, d).groupBy("fp", "lang").count()
    return per.groupBy("fp").agg(F.count("*").alias("langs"), F.sum("count").alias("n")).where("langs > 1")


@query(_F + """, k AS (SELECT DISTINCT fp FROM f WHERE lang = 'en'), n AS (SELECT * FROM f WHERE lang <> 'en')
 SELECT 'new' AS what, count(*) AS chunks, coalesce(sum(chunk_size), 0)::BIGINT AS bytes FROM n WHERE fp NOT IN (SELECT fp FROM k)
 UNION ALL SELECT 'known', count(*), coalesce(sum(chunk_size), 0)::BIGINT FROM n WHERE fp IN (SELECT fp FROM k)""")
def new_vs_known(spark, d):
    """Chunks of the other languages that the English versions lack or have."""
    chunks = _narrow(spark, d)
    new, known = fingerprint.new_and_known(chunks.where("lang != 'en'"), chunks.where("lang = 'en'"))
    total = lambda df, what: df.agg(F.lit(what).alias("what"), F.count("*").alias("chunks"), F.coalesce(F.sum("chunk_size"), F.lit(0)).alias("bytes"))
    return total(new, "new").unionAll(total(known, "known"))


@query("SELECT doc_id AS version, sha256(encode(coalesce(text, ''))) AS sha, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes FROM documents")
def restore_sha(spark, d):
    """Versions rebuilt from recipe and containers of the plain dedup method."""
    return _restored(spark, d, _chunks(spark, d), "dedup")


def _restored(spark, d, chunks, method: str, **options) -> DataFrame:
    chunks = save(spark, chunks, "chunks")
    index = fingerprint.chunk_index(chunks, "chunk", *(["name_hash"] if method == "hybrid" else []))
    index = save(spark, index, "chunk-index")
    stored = save(spark, methods.reduce(index, method, **options), "stored")
    return _digest(store.restore(fingerprint.recipes(chunks, index), stored, _content(spark, d)))


def _digest(whole: DataFrame) -> DataFrame:
    return whole.select("version", F.sha2("content", 256).alias("sha"), F.octet_length("content").cast("long").alias("n_bytes"))


_SHA = ORACLE_SQL["restore_sha"]
_SIZES = {"least": 256, "average": 1024, "most": 4096}


def _cdc(spark, d, how: str = "fastcdc", **sizes):
    return fingerprint.with_fingerprint(chunking.chunk(_content(spark, d), "content", how, **(sizes or _SIZES)))


def _roundtrip(spark, d, chunks):
    return _digest(store.whole(chunks, _content(spark, d)))


@query(_SHA)
def fastcdc_roundtrip(spark, d):
    return _roundtrip(spark, d, _cdc(spark, d))


@query(_SHA)
def fastcdc_loose_roundtrip(spark, d):
    """One mask at all sizes."""
    return _roundtrip(spark, d, _cdc(spark, d, **_SIZES, normalized=False))


@query(_SHA)
def gearcdc_roundtrip(spark, d):
    return _roundtrip(spark, d, _cdc(spark, d, "gear", mask_bits=10))


for _method in ("n_transform", "finesse", "odess", "palantir"):

    def _run(spark, d, method=_method):
        return _restored(spark, d, _cdc(spark, d), method)

    _run.__name__ = f"{_method}_restore_sha"
    query(_SHA)(_run)


@query(_SHA)
def odess_first_seen_restore_sha(spark, d):
    """Every unique chunk registers its super-features: one pass, another set of bases."""
    return _restored(spark, d, _cdc(spark, d), "odess", exact=False)


@query(_SHA)
def hybrid_restore_sha(spark, d):
    """Names here are source and place: a chunk's predecessor is what the source had there last."""
    chunks = _cdc(spark, d).withColumn("name_hash", F.xxhash64("source", "seq"))
    return _restored(spark, d, chunks, "hybrid", accept=methods.fixed_filter(2))


@query(_SHA)
def locality_restore_sha(spark, d):
    chunks = save(spark, _cdc(spark, d), "chunks")
    index = save(spark, fingerprint.chunk_index(chunks, "chunk"), "chunk-index")
    stored = save(spark, methods.reduce(index, "locality", positions=_positions(chunks, index)), "stored")
    return _digest(store.restore(fingerprint.recipes(chunks, index), stored, _content(spark, d)))


def _positions(chunks, index):
    return similarity.position_match(_order_events(chunks, index)).groupBy("chunk_id").agg(F.min("guess").alias("guess"))


@query(_SHA)
def deflate_restore_sha(spark, d):
    """The other local codec."""
    return _restored(spark, d, _chunks(spark, d), "dedup", local="deflate")


@query(_SHA)
def pieces_restore_sha(spark, d):
    """Versions rebuilt in pieces of 4 KiB or a chunk more, as those beyond a cell's size are, and put together here."""
    chunks = save(spark, _chunks(spark, d), "chunks")
    index = save(spark, fingerprint.chunk_index(chunks, "chunk"), "chunk-index")
    stored = save(spark, methods.reduce(index, "dedup"), "stored")
    pieces = store.restore_pieces(fingerprint.recipes(chunks, index), stored, 4096)
    return _digest(store.whole(pieces.select("version", F.col("piece").alias("seq"), F.col("content").alias("chunk")), _content(spark, d)))


@query(_SHA)
def containers_restore_sha(spark, d):
    """Versions rebuilt from container files, read as a restore reads them: what is asked for and its bases."""
    chunks = save(spark, _cdc(spark, d), "chunks")
    index = save(spark, fingerprint.chunk_index(chunks, "chunk"), "chunk-index")
    path = f"{shared_dir(spark)}/containers-{uuid.uuid4().hex}"
    store.write_containers(save(spark, methods.reduce(index, "odess"), "stored"), path, 65536)
    recipes = fingerprint.recipes(chunks, index)
    return _digest(store.restore(recipes, store.read_containers(spark, path, recipes), _content(spark, d)))


@query(_F + """SELECT count(*) AS logical_chunks, count(*) FILTER (nth = 1) AS unique_chunks, count(*) FILTER (nth = 1) AS base_chunks, 0::BIGINT AS delta_chunks,
 sum(chunk_size)::BIGINT AS logical_bytes, coalesce(sum(chunk_size) FILTER (nth > 1), 0)::BIGINT AS dedup_saved,
 round(sum(chunk_size) / (sum(chunk_size) FILTER (nth = 1)), 6) AS dedup_ratio FROM u""")
def dedup_run_counts(spark, d):
    """The figures of a run that do not depend on a codec, from the stored chunks and the recipe of the plain dedup method."""
    events = _run_events(spark, _chunks(spark, d), "dedup")
    counted = metrics.counts(events).select("logical_chunks", "unique_chunks", "base_chunks", "delta_chunks", "logical_bytes")
    return counted.crossJoin(metrics.stages(events).select("dedup_saved", "dedup_ratio"))


@query(_F + """SELECT version, count(*) AS chunks, sum(chunk_size)::BIGINT AS logical_bytes, (sum(sum(chunk_size)) OVER (ORDER BY version))::BIGINT AS total_logical FROM u GROUP BY version""")
def odess_run_versions(spark, d):
    """Each version of a run with deltas, from what the method stored."""
    return metrics.per_version(_run_events(spark, _chunks(spark, d), "odess")).select("version", "chunks", "logical_bytes", "total_logical")


def _run_events(spark, chunks, method: str):
    """The chunk log of a run: every logical chunk with how its unique chunk was stored."""
    chunks = save(spark, chunks, "chunks")
    index = save(spark, fingerprint.chunk_index(chunks, "chunk"), "chunk-index")
    stored = save(spark, methods.reduce(index, method), "stored")
    order = _order_events(chunks, index).select("version", "seq", "chunk_id", F.col("is_new").alias("is_first"))
    return order.join(stored.select("chunk_id", "store_kind", "chunk_size", "save_size"), "chunk_id").withColumn("kind", F.lit("file"))


@query()
def method_report(spark, d):
    """Stored chunks and bytes of all seven methods on the same chunks."""
    chunks = save(spark, _cdc(spark, d).withColumn("name_hash", F.xxhash64("source", "seq")), "chunks")
    index = save(spark, fingerprint.chunk_index(chunks, "chunk", "name_hash"), "chunk-index")
    out = None
    for method in methods.METHODS:
        options = {"positions": _positions(chunks, index)} if method == "locality" else {}
        stored = methods.reduce(index, method, **options)
        part = stored.groupBy("store_kind").agg(F.count("*").alias("n"), F.sum("chunk_size").alias("original"), F.sum("save_size").alias("stored"))
        part = part.select(F.lit(method).alias("method"), "*")
        out = part if out is None else out.unionAll(part)
    return out


@query(f"""WITH RECURSIVE s AS (SELECT doc_id AS id, octet_length(encode(coalesce(text, '')))::BIGINT AS n, row_number() OVER (ORDER BY doc_id) AS k FROM documents),
 w AS (SELECT k, id, n, 0::BIGINT AS c, 0::BIGINT AS o FROM s WHERE k = 1 UNION ALL
  SELECT s.k, s.id, s.n, CASE WHEN w.o + w.n + s.n > 65536 THEN w.c + 1 ELSE w.c END, CASE WHEN w.o + w.n + s.n > 65536 THEN 0 ELSE w.o + w.n END FROM w JOIN s ON s.k = w.k + 1)
 SELECT id AS chunk_id, n AS save_size, c AS container_id, o AS container_offset FROM w""")
def container_packing(spark, d):
    sizes = _content(spark, d).select(F.col("version").alias("chunk_id"), F.octet_length("content").cast("long").alias("save_size"))
    return store.next_fit(sizes, "chunk_id", "save_size", 65536)


@query(_F + "SELECT fp, chunk_size FROM x")
def stream_unique_chunks(spark, d):
    """Streaming ingest of all documents: the unique chunks in the sink."""
    return ingest.drain(ingest.unique_chunks(ingest.read_documents(spark, d), SIZE), "unique-chunks")


# ---------------------------------------------------------------- positions and names


def _order_events(chunks, index):
    own = index.select("fp", "chunk_id", F.col("version").alias("v"), F.col("seq").alias("s"))
    is_new = (F.col("version") == F.col("v")) & (F.col("seq") == F.col("s"))
    return chunks.select("version", "seq", "fp").join(own, "fp").select("version", "seq", "chunk_id", is_new.alias("is_new"))


@query(_F + """, e AS (SELECT u.version, u.seq, x.chunk_id, u.nth = 1 AS is_new FROM u JOIN x ON u.fp = x.fp),
 g AS (SELECT *, last_value(CASE WHEN NOT is_new THEN chunk_id END IGNORE NULLS) OVER w AS l,
   last_value(CASE WHEN NOT is_new THEN seq END IGNORE NULLS) OVER w AS a FROM e
   WINDOW w AS (PARTITION BY version ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
 SELECT version, seq, chunk_id, l + seq - a AS guess FROM g WHERE is_new AND version > 0 AND l IS NOT NULL AND l + seq - a < chunk_id - 1""")
def locality_candidate(spark, d):
    chunks = _narrow(spark, d)
    return similarity.position_match(_order_events(chunks, fingerprint.chunk_index(chunks)))


_PATH = "regexp_replace(url, '^[a-z]+://', '')"


def _pages(spark, d):
    path = F.regexp_replace("url", "^[a-z]+://", "")
    return _table(spark, d, "pages").select("page_id", path.alias("path"))


@query(f"""WITH p AS (SELECT page_id, {_PATH} AS path FROM pages), n AS (SELECT page_id, regexp_replace(path, '^[^/]*/', '') AS name FROM p),
 h AS (SELECT page_id, name, list_transform(string_split(name[1:101], ''), lambda c: ord(c)::HUGEINT) AS codes FROM n)
 SELECT page_id, name, lower(lpad(printf('%x', (v >> 32)::BIGINT), 8, '0') || lpad(printf('%x', (v & 4294967295)::BIGINT), 8, '0')) AS name_hash FROM (
  SELECT page_id, name, list_reduce(list_prepend(0::HUGEINT, codes), lambda h, c: (h * 1099511628211 + c) % 18446744073709551616) AS v FROM h)""")
def name_hash(spark, d):
    """Names without their first component, hashed; names here are ASCII."""
    named = _pages(spark, d).select("page_id", names.without_first(F.col("path")).alias("name"))
    return named.select("page_id", "name", names.name_hash(F.col("name")).alias("name_hash"))


@query(f"""WITH n AS (SELECT page_id, list_transform(string_split({_PATH}, ''), lambda c: ord(c)::BIGINT) AS codes FROM pages)
 SELECT page_id, list_reduce(list_prepend(0::BIGINT, codes), lambda h, c: (h * 31 + c) % 65536) AS short_hash FROM n""")
def short_name_hash(spark, d):
    return _pages(spark, d).select("page_id", names.name_hash_16(F.col("path")).alias("short_hash"))


@query(f"""WITH p AS (SELECT page_id, {_PATH} AS path FROM pages), t AS (SELECT page_id, path, regexp_extract(path, '(/.*)$', 1) AS tail FROM p),
 s AS (SELECT *, length(tail) - length(replace(tail, '/', '')) AS n, string_split(tail, '/') AS parts FROM t)
 SELECT page_id, path, CASE WHEN n - 1 > 2 THEN array_to_string(parts[1:n - 1], '/') WHEN n > 0 THEN array_to_string(parts[1:n], '/') ELSE '' END AS dir_key FROM s""")
def dir_key(spark, d):
    return _pages(spark, d).select("page_id", "path", names.directory_key(F.col("path")).alias("dir_key"))


@query(f"""WITH p AS (SELECT page_id, {_PATH} AS path FROM pages), k AS (SELECT page_id, path, array_to_string(list_transform(regexp_extract_all(upper(path), '([0-9]+|[^0-9]+)', 1),
  lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN lpad(length(regexp_replace(x, '^0+([0-9])', '\\1'))::VARCHAR, 4, '0') || regexp_replace(x, '^0+([0-9])', '\\1') ELSE x END), '') AS key FROM p)
 SELECT page_id, path, key, row_number() OVER (ORDER BY key, page_id) - 1 AS position FROM k""")
def natural_order(spark, d):
    """All members with their place in natural order."""
    keyed = _pages(spark, d).withColumn("key", names.natural_key(F.col("path")))
    return fingerprint.with_order_number(keyed, "key", "page_id", name="position").select("page_id", "path", "key", "position")


_LONG_HASH = """list_reduce(list_prepend(0::HUGEINT, list_transform(string_split(name, ''), lambda c: ord(c)::HUGEINT)), lambda h, c: (h * 1099511628211 + c) % 18446744073709551616)"""


@query(f"""WITH n AS (SELECT page_id, regexp_replace(repeat({_PATH} || '/', 8), '^[^/]*/', '') AS name FROM pages), h AS (SELECT page_id, length(name) AS n, {_LONG_HASH} AS v FROM n),
 r AS (SELECT *, (v + 18446744073709551615) % 18446744073709551616 AS u FROM h)
 SELECT page_id, n::BIGINT AS n, lpad(printf('%x', (u >> 32)::BIGINT), 8, '0') || lpad(printf('%x', (u & 4294967295)::BIGINT), 8, '0') AS record_hash,
  lpad(printf('%x', (v >> 32)::BIGINT), 8, '0') || lpad(printf('%x', (v & 4294967295)::BIGINT), 8, '0') AS member_hash FROM r""")
def long_name_hash(spark, d):
    """Names of several hundred characters in a record of their own: the record's hash and the member's."""
    record = F.rpad(F.repeat(F.concat("path", F.lit("/")), 8), 1024, "\0")
    named = _pages(spark, d).select("page_id", names.long_name(F.encode(record, "UTF-8")).alias("name"))
    record_hash, member_hash = names.long_name_hashes(F.col("name"))
    return named.select("page_id", F.length("name").cast("long").alias("n"), record_hash.alias("record_hash"), member_hash.alias("member_hash"))


@query(f"""WITH p AS (SELECT page_id, regexp_extract({_PATH}, '^[^/]*', 0) AS host FROM pages)
 SELECT page_id AS chunk_id, b AS base_id FROM (SELECT page_id, lag(page_id) OVER (PARTITION BY host ORDER BY page_id) AS b FROM p) WHERE b IS NOT NULL AND page_id > 0""")
def name_base_asof(spark, d):
    """For each page the latest earlier one of its host."""
    pages = _pages(spark, d).select(
        F.col("page_id").alias("chunk_id"), F.col("page_id").alias("version"), F.regexp_extract("path", "^[^/]*", 0).alias("name_hash")
    )
    return similarity.name_match(pages)


@query("""WITH n AS (SELECT conv_id AS key, max(turn) AS turn, count(*) AS n FROM conversations WHERE turn > 2 GROUP BY conv_id), o AS (SELECT conv_id AS key, min(turn) AS turn, count(*) AS n FROM conversations GROUP BY conv_id)
 SELECT * FROM n WHERE key % 7 <> 0 UNION ALL SELECT * FROM o WHERE key NOT IN (SELECT key FROM n) AND key % 7 <> 0""")
def feature_records(spark, d):
    """A table of records in which newer ones take the place of older ones, and some are deleted."""
    turns = _table(spark, d, "conversations").select(F.col("conv_id").alias("key"), "turn")
    old = turns.groupBy("key").agg(F.min("turn").alias("turn"), F.count("*").alias("n"))
    new = turns.where("turn > 2").groupBy("key").agg(F.max("turn").alias("turn"), F.count("*").alias("n"))
    return similarity.delete_records(similarity.put_records(old, new), old.where("key % 7 = 0"))


# ---------------------------------------------------------------- figures over a chunk log


def _events(spark, d):
    """``lineitem`` as a chunk log."""
    n = F.col("l_linenumber")
    return _table(spark, d, "lineitem").select(
        (F.col("l_suppkey") % 50).alias("version"),
        (F.col("l_orderkey") * 8 + n).alias("chunk_id"),
        F.when(n % 3 == 0, "header").when(n % 3 == 1, "file").otherwise("cdc").alias("kind"),
        F.when(F.col("l_returnflag") == "A", "delta_feature").when(F.col("l_returnflag") == "R", "delta_name").otherwise("base_lz").alias("store_kind"),
        (F.floor("l_extendedprice") + 64).alias("chunk_size"),
        (F.floor("l_quantity") * 20 + 1).alias("save_size"),
        (F.col("l_partkey") % 3 != 0).alias("is_first"),
        "l_partkey",
    )


_E = """WITH e AS (SELECT l_suppkey % 50 AS version, l_orderkey * 8 + l_linenumber AS chunk_id, l_partkey,
 CASE l_linenumber % 3 WHEN 0 THEN 'header' WHEN 1 THEN 'file' ELSE 'cdc' END AS kind,
 CASE l_returnflag WHEN 'A' THEN 'delta_feature' WHEN 'R' THEN 'delta_name' ELSE 'base_lz' END AS store_kind,
 floor(l_extendedprice)::BIGINT + 64 AS chunk_size, floor(l_quantity)::BIGINT * 20 + 1 AS save_size, l_partkey % 3 <> 0 AS f FROM lineitem),
 v AS (SELECT *, f AND store_kind LIKE 'base%' AS b, f AND store_kind LIKE 'delta%' AS dl FROM e) """


@query(_E + """SELECT count(*) AS logical_chunks, count(*) FILTER (f) AS unique_chunks, count(*) FILTER (b) AS base_chunks, count(*) FILTER (dl) AS delta_chunks,
 sum(chunk_size)::BIGINT AS logical_bytes, (sum(save_size) FILTER (f))::BIGINT AS stored_bytes, (sum(save_size) FILTER (b))::BIGINT AS base_bytes, (sum(save_size) FILTER (dl))::BIGINT AS delta_bytes,
 round(sum(chunk_size) / sum(save_size) FILTER (f), 6) AS ocr, round(sum(chunk_size) / (sum(save_size) FILTER (f) + 32 * count(*)), 6) AS ocr_with_recipe,
 round(count(*) FILTER (dl) / count(*) FILTER (f), 6) AS dcc, round(sum(chunk_size) FILTER (dl) / sum(save_size) FILTER (dl), 6) AS dcr,
 round(avg(chunk_size / save_size) FILTER (dl), 6) AS dce, round(avg(1 - save_size / chunk_size) FILTER (dl), 6) AS dce2, round(avg(chunk_size / save_size) FILTER (b), 6) AS base_ratio FROM v""")
def reduction_counts(spark, d):
    return metrics.counts(_events(spark, d))


@query(_E + """SELECT round((sum(chunk_size) - sum(chunk_size) FILTER (f AND kind = 'header')) / (sum(save_size) FILTER (f) - sum(save_size) FILTER (f AND kind = 'header')), 6) AS ocr_without_headers FROM v""")
def ocr_without_headers(spark, d):
    return metrics.ocr_without_headers(_events(spark, d))


@query(_E + "SELECT kind, count(*) AS n, sum(chunk_size)::BIGINT AS original, sum(save_size)::BIGINT AS stored, sum(chunk_size - save_size)::BIGINT AS saved FROM v WHERE f GROUP BY kind")
def breakdown_kind(spark, d):
    return metrics.by_kind(_events(spark, d))


@query(_E + """SELECT kind = 'header' AS is_header, store_kind LIKE 'delta%' AS is_delta, count(*) AS logical_n, sum(chunk_size)::BIGINT AS logical_bytes,
 count(*) FILTER (f) AS unique_n, coalesce(sum(save_size) FILTER (f), 0)::BIGINT AS unique_bytes FROM v GROUP BY 1, 2""")
def header_crosstab(spark, d):
    return metrics.header_crosstab(_events(spark, d))


@query(_E + """, s AS (SELECT sum(chunk_size)::BIGINT AS logical, coalesce(sum(chunk_size) FILTER (NOT f), 0)::BIGINT AS dedup_saved,
 coalesce(sum(chunk_size - save_size) FILTER (dl), 0)::BIGINT AS delta_saved, coalesce(sum(chunk_size - save_size) FILTER (b), 0)::BIGINT AS local_saved,
 coalesce(sum(chunk_size - save_size) FILTER (f AND store_kind = 'delta_feature'), 0)::BIGINT AS feature_saved FROM v)
 SELECT *, round(logical / (logical - dedup_saved), 6) AS dedup_ratio, round(logical / (logical - dedup_saved - delta_saved), 6) AS delta_ratio,
 round(logical / (logical - dedup_saved - delta_saved - local_saved), 6) AS local_ratio FROM s""")
def stage_ratios(spark, d):
    return metrics.stages(_events(spark, d))


@query(_E + """SELECT 120 * count(*) FILTER (f) + 160 * count(*) FILTER (b) AS index_bytes, 112 * count(*) FILTER (f) + 48 * count(*) FILTER (b) + 12 * count(DISTINCT l_partkey) FILTER (f) AS name_index_bytes,
 32 * count(*) AS recipe_bytes, 3 * count(*) FILTER (b) AS sf_entries FROM v""")
def overhead_model(spark, d):
    return metrics.overhead(_events(spark, d), hybrid=True, names="l_partkey")


@query(_E + """, p AS (SELECT version, count(*) AS chunks, sum(chunk_size)::BIGINT AS logical_bytes, coalesce(sum(save_size) FILTER (f), 0)::BIGINT AS stored_bytes FROM v GROUP BY version)
 SELECT *, (sum(logical_bytes) OVER w)::BIGINT AS total_logical, (sum(stored_bytes) OVER w)::BIGINT AS total_stored, round((sum(logical_bytes) OVER w) / (sum(stored_bytes) OVER w), 6) AS ocr
 FROM p WINDOW w AS (ORDER BY version ROWS UNBOUNDED PRECEDING)""")
def cumulative_ocr(spark, d):
    return metrics.per_version(_events(spark, d))


@query(ORACLE_SQL["reduction_counts"].replace("SELECT count(*) AS logical_chunks", ", m AS (SELECT count(*) AS logical_chunks", 1) + """)
 SELECT metric, value FROM (SELECT unnest(map_entries(MAP {""" + ", ".join(f"'{c}': {c}::DOUBLE" for c in metrics.COUNTS) + """})) AS e FROM m), LATERAL (SELECT e.key AS metric, e.value AS value)""")
def tidy_metrics(spark, d):
    """All figures of a log, one a row."""
    return metrics.tidy(metrics.counts(_events(spark, d)))


@query(_E + """, o AS (SELECT version, count(*) FILTER (b) AS bases, coalesce(sum(chunk_size) FILTER (b), 0) AS base_in, coalesce(sum(save_size) FILTER (b), 0) AS base_out,
  count(*) FILTER (dl) AS deltas, coalesce(sum(chunk_size // save_size) FILTER (dl), 0) AS gains FROM v GROUP BY version),
 r AS (SELECT version, sum(bases) OVER w AS bases, sum(base_in) OVER w AS base_in, sum(base_out) OVER w AS base_out, sum(deltas) OVER w AS deltas, sum(gains) OVER w AS gains
  FROM o WINDOW w AS (ORDER BY version ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 l AS (SELECT beta, version, CASE WHEN bases > 0 AND deltas > 0 AND base_out > 0 THEN base_in::DOUBLE / base_out::DOUBLE + gains::DOUBLE / deltas::DOUBLE * floor(deltas::DOUBLE / bases::DOUBLE) * beta END AS least
  FROM r CROSS JOIN (SELECT unnest([0.0, 0.01, 0.1, 0.5, 1.0])::DOUBLE AS beta))
 SELECT beta, version, count(*) AS named, count(*) FILTER (least IS NULL OR chunk_size // save_size >= least) AS accepted FROM v JOIN l USING (version)
 WHERE f AND store_kind = 'delta_name' GROUP BY beta, version""")
def adaptive_filter_sweep(spark, d):
    """Name deltas that the adaptive filter accepts, for several weights of the future loss."""
    return methods.adaptive_sweep(_events(spark, d), analysis.sweep(spark, beta=[0.0, 0.01, 0.1, 0.5, 1.0]))


@query(_E + """SELECT threshold, count(*) AS named, count(*) FILTER (chunk_size // save_size >= threshold) AS accepted FROM v CROSS JOIN (SELECT unnest(range(0, 21)) AS threshold)
 WHERE f AND store_kind = 'delta_name' GROUP BY threshold""")
def fixed_filter_sweep(spark, d):
    return methods.fixed_sweep(_events(spark, d), analysis.sweep(spark, threshold=list(range(21))))


@query(_E + """SELECT round(sum(chunk_size / save_size), 4) AS total, count(*) AS n, floor(avg(chunk_size / save_size) * 100) / 100 AS mean FROM v WHERE chunk_id % 5 NOT IN (0, 1)""")
def delta_ratio_avg(spark, d):
    dump = _events(spark, d).select((F.col("chunk_id") % 5).cast("string").alias("delta_flag"), F.col("chunk_size").cast("string"), F.col("save_size").cast("string"))
    return analysis.delta_ratio(dump).withColumn("mean", F.col("mean").cast("double"))


# ---------------------------------------------------------------- run logs


def _log(spark, d):
    """``orders`` as a commit log: size, time in milliseconds, object bytes."""
    size = F.floor(F.col("o_totalprice") * 1000)
    return _table(spark, d, "orders").select(
        "o_orderkey", F.col("o_orderpriority").alias("dataset"), F.col("o_orderstatus").alias("depth"), size.alias("size"),
        (F.col("o_orderkey") % 977 + 1).alias("ms"), F.floor(size / 7).alias("objects"),
    )


_O = """WITH o AS (SELECT o_orderkey, o_orderpriority AS dataset, o_orderstatus AS depth, floor(o_totalprice * 1000)::BIGINT AS size, o_orderkey % 977 + 1 AS ms FROM orders),
 l AS (SELECT *, size // 7 AS objects, ((size * 100 // 1024) // 1024) * 1000 // ms AS r100 FROM o) """


@query(_O + "SELECT o_orderkey, size, size - objects AS metadata, r100 / 100 AS mib_s FROM l")
def throughput_trunc(spark, d):
    log = _log(spark, d)
    rate = analysis.rate_mib(F.col("size"), F.col("ms").cast("decimal(20,3)") / F.lit(1000))
    return log.select("o_orderkey", "size", (F.col("size") - F.col("objects")).alias("metadata"), rate.cast("double").alias("mib_s"))


@query(_O + """SELECT dataset, sum(size)::BIGINT AS logical, sum(objects)::BIGINT AS objects, (sum(size)::HUGEINT * 10000 // sum(objects)) / 10000 AS ocr, sum(ms)::BIGINT AS ms FROM l GROUP BY dataset""")
def run_summary(spark, d):
    sums = _log(spark, d).groupBy("dataset").agg(F.sum("size").alias("logical"), F.sum("objects").alias("objects"), F.sum("ms").alias("ms"))
    return sums.select("dataset", "logical", "objects", analysis.ratio4(F.col("logical"), F.col("objects")).cast("double").alias("ocr"), "ms")


@query(_O + """SELECT dataset, depth, count(*) AS n, round(avg(ms), 4) AS mean, round(sqrt(greatest(avg(ms * ms) - avg(ms) * avg(ms), 0)), 4) AS sd,
 round(1.96 * sqrt(greatest(avg(ms * ms) - avg(ms) * avg(ms), 0)) / sqrt(count(*)), 4) AS ci95 FROM l GROUP BY ALL""")
def ci_normal(spark, d):
    return analysis.normal_interval(_log(spark, d), ["dataset", "depth"], "ms")


@query(_O + """SELECT dataset, count(*) AS runs, sum(size)::BIGINT AS bytes, round(sum(ms / 1000.0), 6)::DOUBLE AS seconds, round((sum(size) / 1048576.0) / sum(ms / 1000.0), 4)::DOUBLE AS mib_s,
 round(avg(size / 1048576.0 / (ms / 1000.0)), 4)::DOUBLE AS mean_mib_s FROM l GROUP BY dataset""")
def restore_throughput(spark, d):
    """MiB a second of all restores of a data set together, and the mean of the single ones."""
    return metrics.throughput(_log(spark, d).withColumn("s", F.col("ms") / F.lit(1000.0)), ["dataset"], "size", "s")


@query(_O + """SELECT o_orderkey AS version, md5(o_orderkey::VARCHAR) AS commit_hash, size, ms / 1000 AS seconds, r100 / 100 AS mib_s FROM l""")
def restore_log(spark, d):
    """A restore log's rows: version, hash, bytes, seconds, MiB a second cut to two decimals."""
    seconds = F.col("ms").cast("decimal(20,3)") / F.lit(1000)
    return _log(spark, d).select(
        F.col("o_orderkey").alias("version"), F.md5(F.col("o_orderkey").cast("string")).alias("commit_hash"), "size",
        (F.col("ms") / F.lit(1000.0)).alias("seconds"), analysis.rate_mib(F.col("size"), seconds).cast("double").alias("mib_s"),
    )


_V = "(n - 1)::DOUBLE"
_T975 = f"(1.959963984540054 + 2.3722712338 / {_V} + 2.8224986167 / ({_V} * {_V}) + 2.5558497259 / ({_V} * {_V} * {_V}) + 1.589534 / ({_V} * {_V} * {_V} * {_V}))"
_STUDENT = _O + f""", g AS (SELECT dataset, depth, count(*) AS n, avg(ms) AS m, stddev_samp(ms) AS sd FROM l GROUP BY ALL),
 st AS (SELECT dataset, depth, n, round(m, 4) AS mean, round(CASE WHEN n < 2 THEN 0 ELSE {_T975} * sd / sqrt(n) END, 4) AS half_width FROM g) """


@query(_STUDENT + "SELECT * FROM st")
def ci_student(spark, d):
    return analysis.student_interval(_log(spark, d), ["dataset", "depth"], "ms")


@query(_STUDENT + """SELECT w.dataset, w.depth, n, mean, half_width FROM (SELECT * FROM (SELECT unnest(['1-URGENT', '2-HIGH', 'none']) AS dataset) a
 CROSS JOIN (SELECT unnest(['F', 'O']) AS depth) b) w LEFT JOIN st ON st.dataset = w.dataset AND st.depth = w.depth""")
def interval_report(spark, d):
    """Means of wanted groups, one of which the log lacks."""
    wanted = analysis.sweep(spark, dataset=["1-URGENT", "2-HIGH", "none"], depth=["F", "O"])
    return analysis.interval_report(_log(spark, d), wanted, ["dataset", "depth"], "ms")


@query("""SELECT ts::VARCHAR AS day, max(CASE WHEN event_type = 'click' THEN n END) AS click, max(CASE WHEN event_type = 'view' THEN n END) AS "view",
 max(CASE WHEN event_type = 'purchase' THEN n END) AS purchase FROM (SELECT ts::DATE AS ts, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY 1""")
def pivot_counts(spark, d):
    counts = _table(spark, d, "events").groupBy(F.to_date("ts").cast("string").alias("day"), "event_type").agg(F.count("*").alias("n"))
    return analysis.pivot(counts, "day", "event_type", ["click", "view", "purchase"], "n")


@query("""SELECT event_id, first_purchase, first_value FROM (SELECT event_id, event_type,
 first_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER w AS first_purchase,
 first_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER w AS first_value
 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) WHERE event_type = 'click'""")
def first_following(spark, d):
    """For each click the user's next purchase."""
    bought = F.col("event_type") == "purchase"
    values = {"first_purchase": F.when(bought, F.col("event_id")), "first_value": F.when(bought, F.col("value"))}
    events = _table(spark, d, "events")
    return analysis.first_following(events, ["user_id"], "event_id", F.col("event_type") == "click", values).select("event_id", *values)


@query("""SELECT conv_id, string_agg(v, ',' ORDER BY turn) AS line FROM (SELECT conv_id, turn, regexp_extract(text, '^(\\w+)', 1) AS v FROM conversations) WHERE v <> '' GROUP BY conv_id""")
def metric_lines(spark, d):
    """The first word of each turn, in order, in one line a conversation."""
    return analysis.metric_lines(_table(spark, d, "conversations"), "text", r"^(\w+)", ["conv_id"], "turn").select("conv_id", "line")


@query("SELECT a.a AS headers, b.b AS threshold FROM (SELECT unnest([1, 2, 4, 8, 16, 32]) AS a) a CROSS JOIN (SELECT unnest(range(0, 21)) AS b) b")
def parameter_sweep(spark, d):
    return analysis.sweep(spark, headers=[1, 2, 4, 8, 16, 32], threshold=list(range(21)))


@query("SELECT text FROM benchmark UNION ALL SELECT text FROM conversations")
def union_runs(spark, d):
    """Rows of two logs, one after the other, repeats and all."""
    from .sources.files import union_logs

    return union_logs(_table(spark, d, "benchmark").select("text"), _table(spark, d, "conversations").select("text"))


# ---------------------------------------------------------------- archives


def _archives(spark, d):
    named = _content(spark, d).withColumn("name", F.concat(F.lit("v"), F.col("version").cast("string"), F.lit("/"), "source", F.lit("/"), "lang", F.lit(".txt")))
    return tar.pack_archives(named, "name", "content")


@query("""SELECT doc_id AS version, source || '/' || lang || '.txt' AS name, octet_length(encode(coalesce(text, '')))::BIGINT AS size, 'file' AS flag,
 ((octet_length(encode(coalesce(text, ''))) + 511) // 512 * 512)::BIGINT AS padded, '/' || source AS dir_key FROM documents""")
def archive_members(spark, d):
    """Header fields of each document's archive, read by column functions."""
    head = _archives(spark, d).select("version", F.substring("content", 1, 512).alias("h"))
    h = F.col("h")
    full = names.member_name(h)
    return head.select(
        "version", names.without_first(full).alias("name"), names.octal_size(h).alias("size"), names.type_flag(h).alias("flag"),
        names.pad_to_block(names.octal_size(h)).alias("padded"), names.directory_key(full).alias("dir_key"),
    )


_ARCHIVE = """SELECT doc_id AS version, count(*) AS same FROM documents GROUP BY doc_id"""


@query(_ARCHIVE)
def archive_restore(spark, d):
    """Archives cut by members with grouped headers and big members cut by content, then rebuilt: equal ones."""
    archives = save(spark, _archives(spark, d), "archives")
    chunks = tar.chunk_archives(archives, headers=tar.HEADERS, big=2048, least=256, average=1024, most=4096)
    return _equal(archives, tar.restore_archives(chunks))


@query(_ARCHIVE)
def migrated_restore(spark, d):
    """Archives rewritten with headers last and back."""
    archives = save(spark, _archives(spark, d), "archives")
    return _equal(archives, tar.rewrite(tar.rewrite(archives, tar.migrate), tar.restore_migrated))


#: Documents of a multi-member archive.
MEMBERS = 40


def _big_archives(spark, d):
    """Archives of forty documents each, one member a document."""
    name = F.concat(F.lit("v/"), F.col("version").cast("string"), F.lit(".txt"))
    grouped = _content(spark, d).select(F.floor(F.col("version") / MEMBERS).alias("version"), F.col("version").alias("place"), name.alias("name"), "content")
    return save(spark, tar.pack_archives(grouped, "name", "content", "place"), "archives")


_MEMBERS_SQL = f"""WITH m AS (SELECT doc_id // {MEMBERS} AS version, doc_id, encode(coalesce(text, '')) AS body, row_number() OVER (PARTITION BY doc_id // {MEMBERS} ORDER BY doc_id) - 1 AS k FROM documents),
 p AS (SELECT *, octet_length(body)::BIGINT AS n, ((octet_length(body) + 511) // 512 * 512)::BIGINT AS padded FROM m),
 e AS (SELECT version, count(*) AS members, (sum(512 + padded) + 1024 + 10239) // 10240 * 10240 - sum(512 + padded) AS tail FROM p GROUP BY version) """


@query(_MEMBERS_SQL + """, c AS (SELECT version, k, 0 AS o, 'header' AS kind, 512::BIGINT AS chunk_size FROM p UNION ALL SELECT version, k, 1, 'file', padded FROM p WHERE n > 0
  UNION ALL SELECT version, members, 2, 'tail', tail FROM e)
 SELECT version, row_number() OVER (PARTITION BY version ORDER BY k, o) - 1 AS seq, kind, chunk_size::BIGINT AS chunk_size FROM c""")
def archive_member_chunks(spark, d):
    """Archives of many members cut into headers and payloads."""
    return chunking.chunk(_big_archives(spark, d), "content", "tar").select("version", "seq", "kind", "chunk_size")


@query(_MEMBERS_SQL + """, c AS (SELECT version, k // 16 AS g, k, 'file' AS kind, padded AS chunk_size FROM p WHERE n > 0
  UNION ALL SELECT version, k // 16, 1000000, 'header', 512 * count(*) FROM p GROUP BY ALL UNION ALL SELECT version, 1000000, 0, 'tail', tail FROM e)
 SELECT version, row_number() OVER (PARTITION BY version ORDER BY g, k) - 1 AS seq, kind, chunk_size::BIGINT AS chunk_size FROM c""")
def archive_grouped_headers(spark, d):
    """The same with up to sixteen headers in a chunk behind the payloads they describe."""
    return chunking.chunk(_big_archives(spark, d), "content", "tar_headers").select("version", "seq", "kind", "chunk_size")


@query(_MEMBERS_SQL + """SELECT version, 8 + sum(padded)::BIGINT + 512 * any_value(members) + any_value(tail)::BIGINT AS n_bytes, sum(padded)::BIGINT AS payload_bytes,
 sha256(unhex(string_agg(hex(body) || repeat('00', (padded - n)::BIGINT), '' ORDER BY k))) AS payload_sha FROM p JOIN e USING (version) GROUP BY version""")
def migrated_payload(spark, d):
    """Archives rewritten with all payloads in front: their length, and what the payloads are."""
    moved = tar.rewrite(_big_archives(spark, d), tar.migrate).select("version", F.col("content").alias("c"))
    n = _little_endian(F.substring("c", 1, 8))
    payload = F.substring(F.col("c"), F.lit(9), n.cast("int"))
    return moved.select("version", F.octet_length("c").cast("long").alias("n_bytes"), n.alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha"))


def _little_endian(field):
    digits = [F.substring(F.hex(field), 2 * k + 1, 2) for k in reversed(range(8))]
    return F.conv(F.concat(*digits), 16, 10).cast("long")


_WHOLE_ARCHIVES = f"SELECT DISTINCT doc_id // {MEMBERS} AS version, 1::BIGINT AS same FROM documents"


def _archives_restored(spark, d, how: str, **sizes):
    """Archives cut by ``how``, stored with deltas, restored and compared."""
    archives = _big_archives(spark, d)
    chunks = save(spark, fingerprint.with_fingerprint(chunking.chunk(archives, "content", how, **sizes)), "chunks")
    index = save(spark, fingerprint.chunk_index(chunks, "chunk"), "chunk-index")
    stored = save(spark, methods.reduce(index, "odess"), "stored")
    recipe = fingerprint.recipes(chunks, index)
    if how in chunking.REWRITTEN:
        whole = store.restore(recipe, stored)
        return _equal(archives, tar.rewrite(whole, tar.restore_migrated))
    placed = chunks.select("version", "seq", "parts").join(recipe, ["version", "seq"]).join(store.read_chunks(stored), "chunk_id")
    return _equal(archives, tar.restore_archives(placed))


for _how, _options in (
    ("tar", {}), ("tar_headers", {"headers": 16, "big": 4096, **_SIZES}), ("mtar", _SIZES), ("mtar_gear", {"mask_bits": 10}), ("mtar_fastcdc", _SIZES),
):

    def _run_archives(spark, d, how=_how, options=_options):
        return _archives_restored(spark, d, how, **options)

    query(_WHOLE_ARCHIVES, f"{_how}_delta_restore")(_run_archives)


def _equal(a, b):
    other = b.select("version", F.sha2("content", 256).alias("sha"))
    same = a.select("version", F.sha2("content", 256).alias("own")).join(other, "version").where("own = sha")
    return same.groupBy("version").agg(F.count("*").alias("same"))
