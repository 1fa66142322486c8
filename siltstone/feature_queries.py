"""Queries over resemblance features and content-defined cuts, and the SQL that computes the same from the bytes.

The SQL hashes every place of every text with the same constants, by doubling a
window, in unsigned 128-bit arithmetic.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions.rolling import GEAR
from .operators import asof, chunking, features, methods, similarity
from .plans.storage import save
from .registry import query, table

_WORD = 1 << 64

_BYTES = """b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
 y AS (SELECT doc_id, q, length(x) // 2 AS n, substr(x, (2 * q + 1)::BIGINT, 512) AS piece FROM (SELECT *, unnest(range(0, (length(x) // 2)::BIGINT, 256)) AS q FROM b)),
 v AS (SELECT doc_id, q + i AS i, n, ('0x' || substr(piece, (2 * i + 1)::BIGINT, 2))::INT AS byte FROM (SELECT *, unnest(range(0, least(256, n - q)::BIGINT)) AS i FROM y))"""


def _doubled(first: str, base: int, width: int, modulus: int, kind: str) -> str:
    """Tables ``first``_2, _4, ... up to ``width``: the window sum that ends at each place, from that of half the width."""
    steps, last, span = [], first, 1
    while span < width:
        factor = pow(base, span, modulus)
        before = f"coalesce(lag(h, {span}) OVER (PARTITION BY doc_id ORDER BY i), 0)"
        steps.append(f"{first}_{2 * span} AS (SELECT doc_id, i, n, (h + {factor}::{kind} * {before}) % {modulus}::{kind} AS h FROM {last})")
        last, span = f"{first}_{2 * span}", 2 * span
    return ", ".join(steps)


#: The gear hash of every place: table g_64 (doc_id, i, n, h).
_GEAR = f"""{_BYTES}, t(byte, value) AS (VALUES {", ".join(f"({i}, {int(x)}::UHUGEINT)" for i, x in enumerate(GEAR))}),
 g AS (SELECT doc_id, i, n, value AS h FROM v JOIN t USING (byte)), {_doubled("g", 2, 64, _WORD, "UHUGEINT")}"""

_MAPS = [(int(a), int(b)) for a, b in zip(features._MULTIPLIERS, features._OFFSETS)]


def _signed(x: str) -> str:
    return f"CASE WHEN {x} >= {_WORD >> 1}::UHUGEINT THEN ({x}::HUGEINT - {_WORD}::HUGEINT)::BIGINT ELSE {x}::BIGINT END"


#: Twelve features a text as columns f0 to f11, for each kind: table ft.
_FEATURES = {
    "odess": f"""{_GEAR}, tops AS (SELECT doc_id, {", ".join(f"max((h * {a}::UHUGEINT + {b}::UHUGEINT) % {_WORD}::UHUGEINT) AS m{j}" for j, (a, b) in enumerate(_MAPS))}
  FROM g_64 WHERE h < {1 << 57}::UHUGEINT GROUP BY doc_id),
 ft AS (SELECT doc_id AS chunk_id, {", ".join(f"{_signed(f'm{j}')} AS f{j}" for j in range(12))} FROM tops)""",
    # Only the low 32 bits of these hashes count anywhere, so all is done modulo 2**32.
    "n_transform": f"""{_BYTES}, p AS (SELECT doc_id, i, n, byte::UBIGINT AS h FROM v), {_doubled("p", 257, 64, 1 << 32, "UBIGINT")},
 ft AS (SELECT doc_id AS chunk_id, {", ".join(f"arg_max(h, (h * {a % (1 << 32)}::UBIGINT + {b % (1 << 32)}::UBIGINT) % 4294967296::UBIGINT)::BIGINT AS f{j}" for j, (a, b) in enumerate(_MAPS))}
  FROM p_64 WHERE i >= 63 AND i < n - 1 GROUP BY doc_id)""",
    "finesse": f"""{_BYTES}, p AS (SELECT doc_id, i, n, byte::BIGINT AS h FROM v), {_doubled("p", features.PART_BASE, 16, features.PART_MODULUS, "BIGINT")},
 p32 AS (SELECT *, (h + {pow(features.PART_BASE, 16, features.PART_MODULUS)} * coalesce(lag(h, 16) OVER (PARTITION BY doc_id ORDER BY i), 0)) % {features.PART_MODULUS} AS h32 FROM p_16),
 p48 AS (SELECT doc_id, i, n, (h + {pow(features.PART_BASE, 16, features.PART_MODULUS)} * coalesce(lag(h32, 16) OVER (PARTITION BY doc_id ORDER BY i), 0)) % {features.PART_MODULUS} AS h FROM p32),
 parts AS (SELECT doc_id, least(i // (n // 12), 11) AS k, max(h) FILTER (i - 47 >= least(i // (n // 12), 11) * (n // 12)) AS top FROM p48 WHERE n >= 12 GROUP BY ALL),
 ft AS (SELECT doc_id AS chunk_id, {", ".join(f"coalesce(max(top) FILTER (k = {j}), 0)::BIGINT AS f{j}" for j in range(12))} FROM parts GROUP BY doc_id HAVING max(top) > 0)""",
}


def _hash_sql(parts: list[str]) -> str:
    return f"""('0x' || substr(md5({" || ',' || ".join(parts)}), 1, 15))::BIGINT"""


def _groups(kind: str) -> list[tuple[int, int, str]]:
    """(tier, place, SQL) of the super-features of a kind."""
    if kind == "palantir":
        return [(t, i, _hash_sql([f"f{i * size + k}" for k in range(size)])) for t, n, size in features.TIERS for i in range(n)]
    if kind == "odess":
        return [(1, i, _hash_sql([f"f{4 * i + k}" for k in range(4)])) for i in range(3)]
    if kind == "n_transform":
        return [(1, i, _hash_sql([f"f{3 * k + i}" for k in range(4)])) for i in range(3)]
    return [(1, i, _hash_sql([f"list_sort([f{3 * g}, f{3 * g + 1}, f{3 * g + 2}])[{i + 1}]" for g in range(4)])) for i in range(3)]


def _sf_sql(kind: str) -> str:
    found = _FEATURES["odess" if kind == "palantir" else kind]
    parts = [f"SELECT chunk_id, chunk_id // 50 AS version, {t} AS tier, {i} AS sf_pos, {sql} AS sf FROM ft" for t, i, sql in _groups(kind)]
    return f"{found}, sf AS MATERIALIZED ({' UNION ALL '.join(parts)}) "


def _index(spark, d):
    """Each text as a chunk of its own, fifty to a version."""
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.floor(F.col("doc_id") / 50).alias("version"), chunking.utf8("text").alias("chunk")
    )


def _sfs(spark, d, kind: str = "palantir"):
    found = features.super_features(features.with_features(_index(spark, d), kind).select("chunk_id", "features"), kind)
    rows = found.select("chunk_id", F.floor(F.col("chunk_id") / 50).alias("version"), "tier", "sf_pos", "sf")
    return save(spark, rows, "sfs")


def _register_features(kind: str) -> None:
    @query(f"WITH {_FEATURES[kind]} SELECT chunk_id, k AS place, [{', '.join(f'f{j}' for j in range(12))}][k + 1] AS feature FROM ft, (SELECT unnest(range(12)) AS k)", f"{kind}_features")
    def run(spark, d):
        found = features.with_features(_index(spark, d), kind)
        return found.select("chunk_id", F.posexplode("features").alias("place", "feature"))


for _kind in _FEATURES:
    _register_features(_kind)


def _register_super_features(kind: str) -> None:
    @query(f"WITH {_sf_sql(kind)} SELECT chunk_id, tier, sf_pos, sf FROM sf", f"{kind}_super_features")
    def run(spark, d):
        return features.super_features(features.with_features(_index(spark, d), kind).select("chunk_id", "features"), kind)


for _kind in ("odess", "n_transform", "finesse"):
    _register_super_features(_kind)


def _matches_sql(kind: str) -> str:
    """The scan in id order: who is a base, by a list of the super-features of all bases so far; then each delta's base."""
    key = {"odess": "sf::VARCHAR", "palantir": "tier || ':' || sf"}.get(kind, "sf_pos || ':' || sf")
    scan = f"""l AS MATERIALIZED (SELECT chunk_id, keys, row_number() OVER (ORDER BY chunk_id) AS k FROM (SELECT chunk_id, list(DISTINCT {key}) AS keys FROM sf GROUP BY chunk_id)),
 w AS (SELECT 0::BIGINT AS k, -1::BIGINT AS chunk_id, false AS is_base, []::VARCHAR[] AS known UNION ALL
  SELECT l.k, l.chunk_id, NOT list_has_any(w.known, l.keys), CASE WHEN list_has_any(w.known, l.keys) THEN w.known ELSE list_concat(w.known, l.keys) END FROM w JOIN l ON l.k = w.k + 1),
 sb AS MATERIALIZED (SELECT sf.* FROM sf JOIN (SELECT chunk_id FROM w WHERE is_base) USING (chunk_id))"""
    if kind == "odess":
        found = "SELECT s.chunk_id, s.tier, s.sf_pos, b.base_id FROM sf s JOIN (SELECT sf, min(chunk_id) AS base_id FROM sb GROUP BY sf) b ON s.sf = b.sf AND b.base_id < s.chunk_id"
    else:
        same = "s.tier = b.tier" if kind == "palantir" else "s.sf_pos = b.sf_pos"
        found = f"""SELECT s.chunk_id, s.tier, s.sf_pos, max(b.chunk_id) AS base_id, max(s.version) - arg_max(b.version, b.chunk_id) AS age
   FROM sf s JOIN sb b ON s.sf = b.sf AND {same} AND b.chunk_id < s.chunk_id GROUP BY ALL"""
    young = "WHERE tier = 1 OR tier = 2 AND age <= 5 OR tier = 3 AND age <= 2" if kind == "palantir" else ""
    return f"""WITH RECURSIVE {_sf_sql(kind)}, {scan}, found AS ({found})
 SELECT chunk_id, base_id FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY tier, sf_pos, base_id) AS r FROM found {young}) WHERE r = 1"""


def _register_matches(kind: str) -> None:
    @query(_matches_sql(kind), f"{kind}_matches")
    def run(spark, d):
        """Which texts are deltas, and against what, as a scan in order decides: a delta registers nothing."""
        kind_, lookup = methods.METHODS[kind]
        return methods.feature_matches(_index(spark, d), kind_, lookup, ages=similarity.AGES if kind == "palantir" else None)


for _kind in ("odess", "n_transform", "finesse", "palantir"):
    _register_matches(_kind)


# ---------------------------------------------------------------- lookups

_SF = f"WITH {_sf_sql('palantir')}"


@query(_SF + "SELECT chunk_id, version, tier, sf_pos, sf FROM sf")
def sf_tiers(spark, d):
    return _sfs(spark, d)


@query(_SF + "SELECT sf, count(DISTINCT chunk_id) AS n_chunks FROM sf WHERE tier = 1 GROUP BY sf HAVING count(DISTINCT chunk_id) > 1")
def similar_record_count(spark, d):
    return similarity.similar_counts(_sfs(spark, d).where("tier = 1"))


@query(_SF + "SELECT DISTINCT chunk_id FROM sf WHERE tier = 1 AND sf IN (SELECT sf FROM sf WHERE tier = 1 GROUP BY sf HAVING count(DISTINCT chunk_id) > 1)")
def similar_chunks(spark, d):
    return similarity.similar_chunks(_sfs(spark, d).where("tier = 1"))


@query(_SF + """SELECT chunk_id, base_id FROM (SELECT chunk_id, o AS base_id, row_number() OVER (PARTITION BY chunk_id ORDER BY sf_pos) AS r FROM
 (SELECT chunk_id, sf_pos, min(chunk_id) OVER (PARTITION BY sf) AS o FROM sf WHERE tier = 1) WHERE o < chunk_id) WHERE r = 1""")
def oldest_lookup(spark, d):
    return similarity.oldest_match(_sfs(spark, d).where("tier = 1"))


_NEWEST = """SELECT chunk_id, base_id FROM (SELECT chunk_id, o AS base_id, row_number() OVER (PARTITION BY chunk_id ORDER BY sf_pos) AS r FROM
 (SELECT chunk_id, sf_pos, lag(chunk_id) OVER (PARTITION BY sf_pos, sf ORDER BY chunk_id) AS o FROM sf WHERE tier = 1) WHERE o IS NOT NULL) WHERE r = 1"""


@query(_SF + _NEWEST)
def newest_lookup(spark, d):
    return similarity.newest_match(_sfs(spark, d).where("tier = 1"))


def _tier_sql(condition: str) -> str:
    return _SF + f"""SELECT chunk_id, tier, base_id FROM (SELECT chunk_id, tier, o AS base_id, row_number() OVER (PARTITION BY chunk_id ORDER BY tier, sf_pos, o) AS r FROM
 (SELECT *, lag(chunk_id) OVER w AS o, lag(version) OVER w AS ov FROM (SELECT DISTINCT chunk_id, version, tier, min(sf_pos) AS sf_pos, sf FROM sf GROUP BY ALL)
  WINDOW w AS (PARTITION BY tier, sf ORDER BY chunk_id)) WHERE o IS NOT NULL {condition}) WHERE r = 1"""


@query(_tier_sql(""))
def tiered_lookup(spark, d):
    return similarity.tiered_match(_sfs(spark, d))


@query(_tier_sql("AND (tier = 1 OR tier = 2 AND version - ov <= 5 OR tier = 3 AND version - ov <= 2)"))
def aged_lookup(spark, d):
    return similarity.tiered_match(_sfs(spark, d), similarity.AGES)


@query(_SF + """, fx AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS chunk_id FROM documents),
 oc AS (SELECT DISTINCT fx.doc_id AS ord, fx.chunk_id, sf.version, tier, min(sf_pos) AS sf_pos, sf FROM sf JOIN fx ON sf.chunk_id = fx.doc_id GROUP BY ALL)
 SELECT chunk_id, tier, base_id FROM (SELECT chunk_id, tier, o AS base_id, row_number() OVER (PARTITION BY chunk_id ORDER BY tier, sf_pos, o) AS r FROM
 (SELECT *, lag(chunk_id) OVER w AS o, lag(version) OVER w AS ov FROM oc WINDOW w AS (PARTITION BY tier, sf ORDER BY ord))
 WHERE o IS NOT NULL AND ord = chunk_id AND (tier = 1 OR tier = 2 AND version - ov <= 5 OR tier = 3 AND version - ov <= 2)) WHERE r = 1""")
def refreshed_lookup(spark, d):
    """Aged lookup where a duplicate refreshes the super-features of what it repeats."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("ord"), F.sha2(chunking.utf8("text"), 256).alias("fp"))
    firsts = docs.groupBy("fp").agg(F.min("ord").alias("chunk_id"))
    owners = docs.join(firsts, "fp").select("ord", "chunk_id")
    sfs = _sfs(spark, d).withColumnRenamed("chunk_id", "ord").join(owners, "ord")
    return similarity.tiered_match(sfs, similarity.AGES, "ord", F.col("ord") == F.col("chunk_id"))


_NAMES = """nm AS (SELECT doc_id AS chunk_id, lag(doc_id) OVER (PARTITION BY source, lang, n_chars // 100 ORDER BY doc_id) AS base_id FROM documents)"""


@query(_SF + f""", {_NAMES}, fm AS ({_NEWEST}), n2 AS (SELECT * FROM nm WHERE base_id IS NOT NULL)
 SELECT CASE WHEN n2.base_id IS NULL THEN 'only_feature' WHEN fm.base_id IS NULL THEN 'only_name' WHEN n2.base_id = fm.base_id THEN 'same' ELSE 'different' END AS "case",
 count(*) AS n FROM fm FULL JOIN n2 ON fm.chunk_id = n2.chunk_id GROUP BY 1""")
def motivation_cases(spark, d):
    docs = table(spark, d, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.lit(1).alias("version"),
        F.concat_ws("/", "source", "lang", F.floor(F.col("n_chars") / 100).cast("string")).alias("name_hash"),
    )
    return similarity.motivation_cases(similarity.newest_match(_sfs(spark, d).where("tier = 1")), similarity.name_match(docs))


@query(f"""WITH {_NAMES} SELECT a.chunk_id, coalesce(b.base_id, a.base_id) AS base_id FROM nm a LEFT JOIN nm b ON a.base_id = b.chunk_id WHERE a.base_id IS NOT NULL""")
def resolved_bases(spark, d):
    """A match that matched something itself is replaced by that."""
    docs = table(spark, d, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.concat_ws("/", "source", "lang", F.floor(F.col("n_chars") / 100).cast("string")).alias("name")
    )
    found = asof.latest_before(docs, ["name"], "chunk_id", F.col("chunk_id"), "base_chunk_id")
    matches = found.where("base_chunk_id is not null").select("chunk_id", F.col("base_chunk_id").alias("base_id"))
    return similarity.resolved(matches, found)


# ---------------------------------------------------------------- cuts

_SIZES = {"least": 256, "average": 1024, "most": 4096}


def _cuts_sql(normalized: bool) -> str:
    """Cuts one after the other from the lists of candidate places."""
    strict, loose = (m.bit_count() for m in chunking.fastcdc_masks(_SIZES["average"], 1, normalized))
    least, average, most = _SIZES.values()
    zero = lambda k: f"h % {1 << 63}::UHUGEINT < {1 << 63 - k}::UHUGEINT"
    return f"""WITH RECURSIVE {_GEAR},
 c AS MATERIALIZED (SELECT doc_id, any_value(n) AS n, coalesce(list(i + 1) FILTER ({zero(strict)}), []) AS st, coalesce(list(i + 1) FILTER ({zero(loose)}), []) AS lo FROM g_64 GROUP BY doc_id),
 w AS (SELECT doc_id AS version, -1::BIGINT AS seq, 0::BIGINT AS start, 0::BIGINT AS stop FROM c UNION ALL
  SELECT version, seq + 1, stop, CASE WHEN n - stop <= {least} THEN n ELSE coalesce(
    list_min(list_filter(st, lambda x: x > stop + {least} AND x <= least(stop + {average}, n))),
    list_min(list_filter(lo, lambda x: x > greatest(least(stop + {average}, n), stop + {least}) AND x <= least(stop + {most}, n))), least(stop + {most}, n)) END
  FROM w JOIN c ON c.doc_id = w.version WHERE stop < n)
 SELECT version, seq, start AS "offset", stop - start AS chunk_size FROM w WHERE seq >= 0"""


def _content(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("version"), chunking.utf8("text").alias("content"))


@query(_cuts_sql(True))
def fastcdc_cuts(spark, d):
    return chunking.chunk(_content(spark, d), "content", "fastcdc", **_SIZES).select("version", "seq", "offset", "chunk_size")


@query(_cuts_sql(False))
def fastcdc_loose_cuts(spark, d):
    """One mask at all sizes."""
    found = chunking.chunk(_content(spark, d), "content", "fastcdc", **_SIZES, normalized=False)
    return found.select("version", "seq", "offset", "chunk_size")


@query(f"""WITH {_GEAR}, e AS (SELECT doc_id, i + 1 AS stop FROM g_64 WHERE h % {1 << 63}::UHUGEINT < {1 << 53}::UHUGEINT UNION SELECT doc_id, n FROM g_64),
 s AS (SELECT doc_id AS version, row_number() OVER w - 1 AS seq, coalesce(lag(stop) OVER w, 0) AS "offset", stop FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY stop))
 SELECT version, seq, "offset", stop - "offset" AS chunk_size FROM s""")
def gear_cuts(spark, d):
    return chunking.chunk(_content(spark, d), "content", "gear", mask_bits=10).select("version", "seq", "offset", "chunk_size")
