"""Operator 4: exact duplicates by progressive refinement, DataFrame functions only.

Level 1 groups rows by byte length, level 2 the rows that share one by the hash
of a prefix, level 3 the rows that share both by the SHA-256 of the whole text.
A row alone at a level is done there: each level groups only what the one before
left. Texts are read in one scan that writes lengths, prefix hashes and, where
every row's hash is reported, whole hashes to the shared folder; the levels work
on that narrow table, and no text is ever shuffled.

A key that holds a large share of the rows is joined by broadcast: fewer than
``HOT_KEYS`` keys can each hold more than one row in ``HOT_KEYS``, whatever the
table, so that side is bounded, its rows stay where they are and the next level
counts them by a partial aggregate. All other keys are joined by a shuffle in
which none holds more than that share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

PREFIX_BYTES = 64
#: Keys with more than one row in so many are joined by broadcast; there are fewer such keys than this.
HOT_KEYS = 10_000
#: Survivors of level 2 that are broadcast to hash only their rows; with more, all rows are hashed in the scan.
SMALL = 1_000_000
KEYS = ["size", "prefix"]


def _raw(text_col: str, normalise):
    text = F.coalesce(F.col(text_col), F.lit(""))
    if normalise is not None:
        text = F.coalesce(normalise(text), F.lit(""))
    return F.encode(text, "UTF-8")


def _repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with more than one row, and their number of rows ``n``."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def _those(rows: DataFrame, found: DataFrame, keys: list[str], total: int) -> DataFrame:
    """``rows`` with a key of ``found``."""
    hot = found.where(F.col("n") * HOT_KEYS > total).select(*keys)
    cold = found.where(F.col("n") * HOT_KEYS <= total).select(*keys)
    return rows.join(F.broadcast(hot), keys, "left_semi").unionByName(rows.join(cold, keys, "left_semi"))


def _others(rows: DataFrame, found: DataFrame, keys: list[str], total: int) -> DataFrame:
    """``rows`` without a key of ``found``."""
    hot = found.where(F.col("n") * HOT_KEYS > total).select(*keys)
    cold = found.where(F.col("n") * HOT_KEYS <= total).select(*keys)
    return rows.join(F.broadcast(hot), keys, "left_anti").join(cold, keys, "left_anti")


def _groups(survivors: DataFrame) -> DataFrame:
    """(sha, top, n) of the texts that several rows have."""
    groups = survivors.groupBy(*KEYS, "sha").agg(F.max("doc_id").alias("top"), F.count("*").alias("n"))
    return groups.where("n > 1").select("sha", "top", "n")


def _with(rows: DataFrame, groups: DataFrame, total: int) -> DataFrame:
    """``rows`` with top and n of their text's group, null for those that are alone."""
    is_hot = F.col("n") * HOT_KEYS > total
    hot = groups.where(is_hot).select("sha", F.col("top").alias("hot_top"), F.col("n").alias("hot_n"))
    # Rows of hot groups need no other one: their key only deals them evenly.
    own = F.when(F.col("hot_n").isNull(), F.col("sha")).otherwise(F.concat(F.lit("-"), F.xxhash64("doc_id").cast("string")))
    cold = groups.where(~is_hot).withColumnRenamed("sha", "own")
    joined = rows.join(F.broadcast(hot), "sha", "left").withColumn("own", own).join(cold, "own", "left")
    return joined.withColumns({"top": F.coalesce("top", "hot_top"), "n": F.coalesce("n", "hot_n")}).drop("own", "hot_top", "hot_n")


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise=None,
    prefix_bytes: int = PREFIX_BYTES,
    digest: str = "all",
    small: int = SMALL,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    ``normalise`` maps the text column before it is compared. Null text is empty;
    all empty texts are one group. Of a group the largest id stays; a null id
    ranks below all others, and a group of null ids only keeps them all. Rows that
    repeat both id and text are all marked like their id. An empty table gives no
    rows. Other columns are not looked at. With ``digest="survivors"``
    ``text_sha256`` is null for rows that level 2 leaves alone; such rows are not
    read whole as long as the survivors' keys number at most ``small``.
    """
    if digest not in ("all", "survivors"):
        raise ValueError("digest is 'all' or 'survivors'")
    spark = docs.sparkSession
    raw = _raw(text_col, normalise)
    keys = [F.octet_length(raw).alias("size"), F.xxhash64(F.substring(raw, 1, prefix_bytes)).alias("prefix")]
    scan = docs.select(F.col(id_col).cast("long").alias("doc_id"), *keys, F.sha2(raw, 256).alias("sha"))
    narrow = common.save(spark, scan if digest == "all" else scan.drop("sha"), "text-keys")
    total = narrow.count()
    lengths = common.save(spark, _repeated(narrow, ["size"]), "lengths")
    prefixes = common.save(spark, _repeated(_those(narrow, lengths, ["size"], total), KEYS), "prefixes")
    if digest == "all":
        groups = _groups(_those(narrow, prefixes, KEYS, total))
        found = _with(narrow, groups, total)
    else:
        if prefixes.count() <= small:
            own = scan.join(F.broadcast(prefixes.select(*KEYS)), KEYS, "left_semi")
        else:
            own = _those(common.save(spark, scan, "text-keys"), prefixes, KEYS, total)
        own = common.save(spark, own.select("doc_id", *KEYS, "sha"), "survivors")
        alone = _others(narrow, prefixes, KEYS, total).select("doc_id")
        found = _with(own, _groups(own), total).unionByName(alone, allowMissingColumns=True)
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("top"))
    return found.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they were.

    Rows that repeat both id and text, null ids included, leave one of them. No
    column name is reserved. Only survivors of level 2 are hashed, and once more the
    rows whose id is to go, since other rows may have that id.
    """
    spark = docs.sparkSession
    marked = common.save(spark, exact_groups(docs, id_col, text_col, digest="survivors"), "exact-groups")
    grouped = marked.where("group_size > 1")
    own_id, own_sha, its_id, its_sha, null_sha = common.free_names(docs, 5)
    sha = F.sha2(_raw(text_col, None), 256)
    keyed = docs.withColumn(own_id, F.col(id_col).cast("long"))
    keyed = keyed.withColumn(own_sha, F.when(F.col(own_id).isNull(), sha))

    def rows_of(found: DataFrame, how: str, left: DataFrame) -> DataFrame:
        """A join by id, and by text where the id is null; only then is the text hashed, so ids that do not meet cost nothing."""
        found = found.select(F.col("doc_id").alias(its_id), F.col("text_sha256").alias(its_sha)).distinct()
        found = found.withColumn(null_sha, F.when(F.col(its_id).isNull(), F.col(its_sha)))
        same = F.col(own_id).eqNullSafe(F.col(its_id)) & F.col(own_sha).eqNullSafe(F.col(null_sha))
        # Spelled so that it is looked at for rows of one id only, not made a key of all rows.
        same &= F.least(sha, F.col(its_sha)) == F.greatest(sha, F.col(its_sha))
        return left.join(found, same, how)

    left = rows_of(grouped.where("not kept"), "left_anti", keyed)
    repeats = grouped.where("kept").groupBy("doc_id", "text_sha256").count().where("count > 1")
    if not repeats.isEmpty():
        once = rows_of(repeats, "left_semi", left).withColumn(own_sha, sha).dropDuplicates([own_id, own_sha])
        left = rows_of(repeats, "left_anti", left).unionByName(once)
    return left.drop(own_id, own_sha)
