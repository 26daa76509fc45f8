"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

Source ``s`` with share ``p_s`` of all characters and target weight ``w_s`` is to be
seen ``w_s / p_s`` times on average.  Each document draws its number of copies from a
Poisson distribution with that mean: a hash of (seed, key) gives a number in [0, 1),
and the distribution function is inverted.  A document is exploded by its count, and
all copies are dealt out by another hash and sorted by it: a global shuffle that is
the same however the input is partitioned.

Shares are sums over all rows, pre-aggregated before their small shuffle.  Per source
there is one array with the distribution function, computed once; the table of arrays
is broadcast only if there are at most ``MAX_BROADCAST`` sources, else joined with a
salt, so that a source with a third of all rows is no hot key.

Defined results: a null source is a source of its own; a null text counts no
characters; a null key has its own fixed draw; rows with the same key draw the same
count; with no characters at all every rate is 1; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

SEED = 17
EXPONENT = 0.5
#: Numbers in all sources' distributions (8 bytes each) up to which they are broadcast.
MAX_BROADCAST = 1 << 20
SALTS = 64
#: Hash digits that make up the number in [0, 1): 13 hexadecimal digits, 52 bits.
HEX = 13


def unit(*parts: Column) -> Column:
    """A hash of the parts as a number in [0, 1) with 52 bits."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, HEX), 16, 10).cast("long") / F.lit(float(16**HEX))


def rates(docs: DataFrame, source: str = "source", text: str = "text", weights: dict | None = None, exponent: float = EXPONENT) -> DataFrame:
    """(source, rate): target weight over present share.  Without ``weights`` the
    weight is the share to the power ``exponent``."""
    size = docs.groupBy(F.col(f"`{source}`").alias("source")).agg(F.coalesce(F.sum(F.length(F.col(f"`{text}`"))), F.lit(0)).cast("double").alias("chars"))
    if weights is None:
        size = size.withColumn("weight", F.when(F.col("chars") > 0, F.pow("chars", F.lit(float(exponent)))).otherwise(F.lit(0.0)))
    else:
        known = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (str(k), float(v))]) if weights else F.create_map().cast("map<string,double>")
        size = size.withColumn("weight", F.coalesce(known[F.col("source").cast("string")], F.lit(0.0)))
    size = stage(size, "sizes")
    total = size.agg(F.sum("chars").alias("all_chars"), F.sum("weight").alias("all_weight"))  # one row
    joined = size.join(F.broadcast(total))
    rate = F.when(F.col("all_chars") * F.col("all_weight") <= 0, F.lit(1.0)).when(F.col("chars") <= 0, F.lit(0.0)).otherwise(F.col("weight") / F.col("all_weight") * F.col("all_chars") / F.col("chars"))
    return joined.select("source", rate.alias("rate"))


def length_of(rate: Column) -> Column:
    """Terms of the distribution that are held."""
    return F.ceil(rate + 12 * F.sqrt(rate) + 40) + 1


def distribution(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... far into the tail, as an array.  Terms are taken
    as exp(k ln(rate) - rate - ln(k!)), so that no rate is too large."""
    last = (length_of(rate) - 1).cast("int")
    step = F.aggregate(
        F.sequence(F.lit(0), last),
        F.struct(F.lit(0.0).alias("f"), F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("out")),
        lambda a, k: F.struct(
            (a["f"] + F.when(k > 0, F.log(F.greatest(k, F.lit(1)).cast("double"))).otherwise(0.0)).alias("f"),
            (a["sum"] + F.exp(k * F.log(rate) - rate - (a["f"] + F.when(k > 0, F.log(F.greatest(k, F.lit(1)).cast("double"))).otherwise(0.0)))).alias("sum"),
            F.array_append(a["out"], a["sum"] + F.exp(k * F.log(rate) - rate - (a["f"] + F.when(k > 0, F.log(F.greatest(k, F.lit(1)).cast("double"))).otherwise(0.0)))).alias("out"),
        ),
        lambda a: a["out"],
    )
    return F.when(rate > 0, step).otherwise(F.array(F.lit(1.0)))


def mix_sources(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: dict | None = None, seed: int = SEED, with_copy: bool = False) -> DataFrame:
    """Every row as often as its draw says, in a random order; ``with_copy`` adds
    ``copy`` (0, 1, ...) and ``shuffle_key``."""
    table = stage(rates(docs, source, text, weights), "rates")  # one row a source; else its scan would run twice
    size = table.agg(F.sum(F.when(F.col("rate") > 0, length_of(F.col("rate"))).otherwise(1))).first()[0] or 0
    table = table.select("source", distribution(F.col("rate")).alias("cdf"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{source}`").alias("of"), F.col(f"`{key}`").alias("id"))
    if size <= MAX_BROADCAST:
        drawn = packed.join(F.broadcast(table), F.col("of").eqNullSafe(F.col("source")))
    else:
        salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        packed = packed.withColumn("salt_of", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
        drawn = packed.join(salted, F.col("of").eqNullSafe(F.col("source")) & (F.col("salt_of") == F.col("salt")))
    u = unit(F.lit(seed), F.col("id"))
    drawn = drawn.withColumn("n", F.size(F.filter("cdf", lambda c: c <= u))).filter("n > 0")
    copies = drawn.select("row", "id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("copy"))
    copies = copies.withColumn("shuffle_key", unit(F.lit(seed + 1), F.col("id"), F.col("copy")))
    dealt = copies.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
    return dealt.select("row.*", "copy", "shuffle_key") if with_copy else dealt.select("row.*")


#: mix_sources(documents, with_copy=True), in DuckDB SQL.
SQL = """
WITH s AS (SELECT source, coalesce(sum(length(text)), 0)::DOUBLE AS chars FROM documents GROUP BY source),
w AS (SELECT *, CASE WHEN chars > 0 THEN pow(chars, 0.5) ELSE 0 END AS weight FROM s),
t AS (SELECT sum(chars) AS all_chars, sum(weight) AS all_weight FROM w),
r AS (SELECT source, CASE WHEN all_chars * all_weight <= 0 THEN 1.0 WHEN chars <= 0 THEN 0.0 ELSE weight / all_weight * all_chars / chars END AS rate FROM w, t),
k AS (SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 40)::BIGINT + 1)) AS k FROM r),
c AS (SELECT source, k, sum(CASE WHEN rate > 0 THEN exp(k * ln(rate) - rate - lgamma(k + 1)) WHEN k = 0 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY source ORDER BY k) AS cdf FROM k),
d AS (SELECT *, ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '-')), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM documents),
n AS (SELECT d.doc_id, d.u, count(*) FILTER (WHERE c.cdf <= d.u) AS n FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source GROUP BY d.doc_id, d.u),
e AS (SELECT doc_id, unnest(range(0, n)) AS copy FROM n)
SELECT documents.*, e.copy::INTEGER AS copy, ('0x' || substr(md5('18:' || coalesce(e.doc_id::VARCHAR, '-') || ':' || e.copy), 1, 13))::BIGINT / 4503599627370496.0 AS shuffle_key
FROM e JOIN documents ON documents.doc_id = e.doc_id
"""
