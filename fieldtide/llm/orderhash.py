"""Order MinHash fingerprints, likeness under edits. DataFrame functions only; one row at a time, nothing is exploded.

A text is cut into tokens (words, long ones in pieces of eight characters); a k-mer is ``k`` tokens in a row, and a k-mer
that occurs again is numbered, so that repeats count. A hash deals the numbered k-mers to buckets. Each bucket keeps the
``least`` smallest, puts them back into text order and hashes that tuple: an edit that moves text around changes the
order, and so the signature, where a set-based sketch sees no difference. Likeness is the share of equal buckets among those
that either text fills.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

TOKEN = r"[^\x20\x09-\x0D]{1,8}"
_PLACE = 26  # bits for a k-mer's place in its text
_HASH = 32
_BUCKET = 5  # bits: 32 buckets


def _array(items: Column) -> Column:
    return F.coalesce(items, F.array().cast("array<bigint>"))


def add_signature(df: DataFrame, text: str, to: str, k: int = 2, least: int = 2) -> DataFrame:
    """``df`` with the signature of ``text`` in ``to``: an array of bucket << 16 | code, by bucket.

    A text without tokens has an empty signature; one with fewer than ``k`` tokens is a single k-mer.
    """
    low = lambda bits: F.lit((1 << bits) - 1)
    shift, unsigned = F.shiftright, F.shiftrightunsigned
    at = lambda name, i: F.get(F.col(name), i)
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    rows = df.withColumn("_w", F.regexp_extract_all(F.col(text), F.lit(f"({TOKEN})"), F.lit(1)))
    grams = F.when(F.size("_w") > 0, F.greatest(F.size("_w") - (k - 1), F.lit(1))).otherwise(0)
    gram = lambda i: F.xxhash64(*(at("_w", i + j) for j in range(k)))
    rows = rows.withColumn("_s", F.sort_array(F.transform(upto(grams), lambda i: F.shiftleft(gram(i), _PLACE).bitwiseOR(i.cast("bigint")))))
    rows = rows.drop("_w")
    first = lambda i: (i == 0) | (shift(at("_s", i), _PLACE) != shift(at("_s", i - 1), _PLACE))
    rows = rows.withColumn("_r", F.filter(upto(F.size("_s")), first))
    run = lambda start, j: F.sequence(F.lit(0), F.coalesce(at("_r", j + 1), F.size("_s")) - start - 1)
    rows = rows.withColumn("_o", F.flatten(F.transform("_r", run)))
    # zip_with: a column that a lambda names only once would be computed again for every element.
    numbered = lambda x, o: F.struct(F.xxhash64(shift(x, _PLACE), o).alias("h"), x.bitwiseAND(low(_PLACE)).alias("p"))
    rows = rows.withColumn("_e", F.zip_with("_s", "_o", numbered)).drop("_s", "_r", "_o")
    dealt = lambda e: F.shiftleft(e["h"].bitwiseAND(low(_BUCKET)), _HASH + _PLACE).bitwiseOR(
        F.shiftleft(unsigned(e["h"], 64 - _HASH), _PLACE)).bitwiseOR(e["p"])
    rows = rows.withColumn("_t", F.sort_array(F.transform("_e", dealt))).drop("_e")
    bucket = lambda x: shift(x, _HASH + _PLACE)
    rows = rows.withColumn("_k", F.filter("_t", lambda x, i: (i < least) | (bucket(at("_t", i - least)) != bucket(x)))).drop("_t")
    in_order = lambda x: F.shiftleft(bucket(x), _HASH + _PLACE).bitwiseOR(
        F.shiftleft(x.bitwiseAND(low(_PLACE)), _HASH)).bitwiseOR(shift(x, _PLACE).bitwiseAND(low(_HASH)))
    rows = rows.withColumn("_k", F.sort_array(F.transform("_k", in_order)))
    # Only the last of a bucket's k-mers names the tuple.
    same = lambda i, j: F.when(bucket(at("_k", i - j)) == bucket(at("_k", i)), at("_k", i - j).bitwiseAND(low(_HASH)))
    name = lambda x, i: F.shiftleft(bucket(x), 16).bitwiseOR(
        F.xxhash64(*(F.coalesce(F.when(i >= j, same(i, j)), F.lit(-1)) for j in range(least - 1, -1, -1))).bitwiseAND(low(16)))
    last = lambda i: F.coalesce(bucket(at("_k", i + 1)) != bucket(at("_k", i)), F.lit(True))
    named = F.transform(F.filter(upto(F.size("_k")), last), lambda i: name(at("_k", i), i))
    return rows.withColumn(to, named).drop("_k")


def as_text(signature: Column) -> Column:
    """Six hex digits per bucket."""
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x)), 6, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of buckets that agree, of those that either text fills; 1 for two texts without tokens."""
    buckets = lambda s: F.transform(s, lambda x: F.shiftright(x, 16))
    filled = F.size(F.array_union(buckets(a), buckets(b)))
    return F.when(filled == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / filled)


def with_next(docs: DataFrame, columns: list[str], add: Callable[[DataFrame], DataFrame], doc_id: str = "doc_id", tie: str = "_tie",
              parts: int | None = None) -> DataFrame:
    """``add(docs)``, which adds columns to rows, with ``next_<column>`` of the next row by descending ``doc_id`` (nulls last, then ``tie``); the first row
    follows the last.

    Rows are dealt to ranges of ids, so no window holds more than a range; only the first row of each range passes
    between ranges.
    """
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = docs.select(F.percentile_approx(doc_id, [k / parts for k in range(1, parts)] or [0.5], 10 * parts).alias("q")).first()["q"] or []
    edges = F.array(*(F.lit(e) for e in sorted(set(edges)))) if edges else F.array().cast("array<bigint>")
    part = F.when(F.col(doc_id).isNull(), F.size(edges) + 1).otherwise(F.size(F.filter(edges, lambda e: F.col(doc_id) <= e)))
    rows = add(docs).withColumn("_part", part)
    order = [F.col(doc_id).desc_nulls_last(), F.col(tie)]
    inside = W.partitionBy("_part").orderBy(*order)
    shown = F.struct(*columns)
    rows = rows.withColumns({"_next": F.lead(shown).over(inside), "_row": F.row_number().over(inside)})
    # As many rows as ranges, of light columns: which row starts each range, and which range follows.
    light = docs.select(part.alias("_part"), F.col(doc_id).alias("_id"), F.col(tie).alias("_of"))
    least = F.min(F.struct(F.col("_id").isNull().alias("n"), (-F.col("_id").cast("decimal(38,0)")).alias("d"), F.col("_of").alias("t"))).alias("m")
    starts = light.groupBy("_part").agg(least)
    by_part = W.orderBy("_part")
    before = F.coalesce(F.lag("_part").over(by_part), F.max("_part").over(W.partitionBy()))
    starts = starts.select(before.alias("_from"), F.col("_part").alias("_to"), (-F.col("m.d")).cast("bigint").alias("_id"), F.col("m.t").alias("_of"))
    here = F.col(doc_id).cast("bigint").eqNullSafe(F.col("_id")) & (F.col(tie) == F.col("_of"))
    heads = add(docs.join(F.broadcast(starts), here)).groupBy("_from").agg(F.first(shown).alias("_head"))
    out = rows.join(heads, rows["_part"] == heads["_from"], "left")
    following = F.coalesce("_next", "_head")
    kept = [c for c in rows.columns if c not in ("_part", "_next", "_row")]
    return out.select(*(rows[c] for c in kept), *(following[c].alias(f"next_{c}") for c in columns))


def edited(text: Column, after: Column, share: int = 3) -> Column:
    """``text`` with its last 1/``share`` of code points replaced by the first as many of ``after``."""
    cut = F.floor(F.length(text) / share).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - cut), F.substring(after, F.lit(1), cut))
