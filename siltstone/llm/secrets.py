"""Operator 9: secrets, and weak candidates linked across their parts. DataFrame functions only.

Three base kinds (assignment, access identifier, hex run) stand by themselves.
A bare secret or an endpoint is weak: alone it proves nothing. The interval
join widens each access identifier by ``scope`` code points to either side,
deals the widened intervals and all spans into all buckets of that width that
they touch, and joins them by text and bucket. Weak spans that overlap a base
span are left out; of the others a bare secret is reported when it lies in the
scope of an identifier, and an endpoint when a bare secret lies in that scope
too. Each bucket holds what fits into one scope of one text, however long it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

# The base patterns and least lengths.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_LEAST = 12

#: Weak kinds: runs of just 40 characters, as secret keys have them, and hosts of endpoints.
BARE = r"[A-Za-z0-9+/]{40,}"
BARE_LENGTH = 40
ENDPOINT = r"https?://[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?::[0-9]+)?"
SCOPE = 512

KINDS = ("assign", "access", "hex", "secret", "endpoint")


#: Matches whose spans are gathered together before they are put to the others.
RUN = 256
_SPANS = "array<struct<start:int,end:int,kind:int>>"


def _spans(text: Column, pattern: str, kind: str, value: Column | None = None, least: int = 0, most: int = 1 << 30) -> Column:
    """Spans of all matches, leftmost and non-overlapping, as array<struct<start,end,kind>> in code points.

    The pieces between the matches give the starts: running lengths of pieces and
    matches. Appending to an array copies it, so spans are gathered in runs of
    ``RUN`` matches and the runs in an array of their own: a text of n matches
    costs n * RUN + (n / RUN) ** 2 copies. Texts without a match skip it all.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = hits if value is None else value
    parts = F.arrays_zip(hits.alias("hit"), values.alias("value"), F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)).alias("gap"))
    order = F.lit(KINDS.index(kind))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        one = F.array(F.struct(start.alias("start"), end.alias("end"), order.alias("kind")))
        out = F.when(F.length(x["value"]).between(least, most), F.concat(state["out"], one)).otherwise(state["out"])
        return F.struct(end.alias("at"), out.alias("out"))

    def run(state: Column, parts_of_run: Column) -> Column:
        empty = F.struct(state["at"].alias("at"), F.array().cast(_SPANS).alias("out"))
        done = F.aggregate(parts_of_run, empty, step)
        # A fold over an array of one: its result is worked out once, though used twice.
        return F.aggregate(
            F.array(done), state,
            lambda old, new: F.struct(new["at"].alias("at"), F.concat(old["runs"], F.array(new["out"])).alias("runs")),
        )

    first = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPANS}>").alias("runs"))

    def gather(p: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.greatest(F.size(p) - 1, F.lit(0)), F.lit(RUN)), lambda k: F.slice(p, k + 1, RUN))
        return F.flatten(F.aggregate(cut, first, run, lambda s: s["runs"]))

    # Within the array of one the parts are a value, not an expression that each run would work out again.
    found = F.get(F.transform(F.array(parts), gather), F.lit(0))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(_SPANS))


def _joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    ordered = F.array_sort(
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    )
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(ordered, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """Per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Null text is empty and has no spans (``spans`` is the empty string). Null and
    repeated ids each give their row. An empty table gives no rows. Other columns
    are not looked at.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("t"))
    t = F.col("t")
    base = rows.select("doc_id", *_base(t), _key(t).alias("text_key"))
    weak_of = _linked(rows.where(t.contains("AKIA")), scope)
    whole = base.join(weak_of, "text_key", "left").withColumn("base", F.concat("assign", "access", "hex"))
    weak = F.coalesce("weak", F.array().cast(_SPANS))
    return whole.select(
        "doc_id",
        F.size("assign").cast("long").alias("n_assign"),
        F.size("access").cast("long").alias("n_access"),
        F.size("hex").cast("long").alias("n_hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.concat("base", weak)).alias("spans"),
    )


def _key(t: Column) -> Column:
    """The text's hash where an identifier may be; other texts only need to be dealt evenly."""
    return F.when(t.contains("AKIA"), F.sha2(t, 256)).otherwise(F.concat(F.lit("-"), F.xxhash64("doc_id").cast("string")))


def _base(t: Column) -> list[Column]:
    return [
        _spans(t, ASSIGN, "assign", F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(2)), ASSIGN_LEAST).alias("assign"),
        _spans(t, ACCESS, "access").alias("access"),
        _spans(t, HEX, "hex").alias("hex"),
    ]


def _linked(rows: DataFrame, scope: int) -> DataFrame:
    """Weak spans with complementary parts in scope: text_key, weak (one row for each text that has any).

    Spans become rows, so a text with very many costs in proportion; a bucket of a
    text holds what fits into ``scope`` code points.
    """
    t = F.col("t")
    bare = _spans(t, BARE, "secret", least=BARE_LENGTH, most=BARE_LENGTH)
    parts = rows.select(_key(t).alias("text_key"), *_base(t), F.concat(bare, _spans(t, ENDPOINT, "endpoint")).alias("weak"))
    parts = parts.where((F.size("access") > 0) & (F.size("weak") > 0)).dropDuplicates(["text_key"])
    spans = parts.select("text_key", F.inline(F.concat("assign", "access", "hex", "weak")))
    spans = common.save(rows.sparkSession, spans, "spans")
    span = ["start", "end", "kind"]
    is_weak = F.col("kind") >= KINDS.index("secret")

    def dealt(found: DataFrame, low: Column, high: Column) -> DataFrame:
        return found.withColumn("bucket", F.explode(F.sequence(F.floor(low / scope), F.floor(high / scope))))

    weak = dealt(spans.where(is_weak), F.col("start"), F.col("end") - 1)
    base = dealt(spans.where(~is_weak), F.col("start"), F.col("end") - 1).select("text_key", "bucket", F.struct("start", "end").alias("b"))
    overlap = (F.col("b.start") < F.col("end")) & (F.col("b.end") > F.col("start"))
    covered = weak.join(base, ["text_key", "bucket"]).where(overlap).select("text_key", *span).distinct()
    weak = weak.join(covered, ["text_key", *span], "left_anti")

    low, high = F.col("start") - scope, F.col("end") + scope
    anchors = dealt(spans.where(F.col("kind") == KINDS.index("access")), low, high).select(
        "text_key", "bucket", F.col("start").alias("anchor"), low.alias("low"), high.alias("high")
    )
    near = anchors.join(weak, ["text_key", "bucket"]).where((F.col("start") < F.col("high")) & (F.col("end") > F.col("low")))
    near = near.select("text_key", "anchor", *span).distinct()
    # A bare secret completes its identifier; an endpoint counts where a secret does.
    complete = near.where(F.col("kind") == KINDS.index("secret")).select("text_key", "anchor").distinct()
    linked = near.join(complete, ["text_key", "anchor"], "left_semi").select("text_key", F.struct(*span).alias("w"))
    return linked.groupBy("text_key").agg(F.collect_set("w").alias("weak"))
