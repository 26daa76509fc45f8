"""Near-duplicate lines across all documents, by a deletion-neighbourhood join, in
DataFrame functions only.

The unit of editing is the word: two lines are near if one word substituted, added or
left out makes them equal (edit distance 1 over words), which must be at most one word
in ``MIN_WORDS``; shorter lines are duplicates only if equal.  Lines are compared by
their words, so white space does not matter.  A line goes if an *earlier* line of the
corpus equals it or is near it; earlier means a smaller key, then a smaller digest of the
text (for rows that repeat a key), then a smaller line number.

1.  Equal lines meet by a hash of their words: one row per distinct line, with its
    earliest place.
2.  A distinct line can only have a near partner if it shares its first or its last half
    with another one (one edit cannot touch both).  Lines that share neither are done.
3.  The others emit their deletion neighbourhood: a hash for each word left out, and one
    for the whole (polynomial hashes to two prime moduli, from running sums over the
    line's words, so a line of n words costs n steps and not n * n).  Equal hashes are joined twice: variants that left out the same
    position (substitution; within such a group every pair is within the bound, so the
    earliest member alone decides), and variants with whole lines (addition, omission).
4.  The partner found is verified word by word before a line goes.

No group is ever collected: each is reduced to its earliest member by a pre-aggregated
minimum and joined back, so a line, frame or boilerplate that holds a third of all rows
is no hot task and gives no pairs.  Texts are shuffled once for the lines of step 3 and
once for the result, keyed by document.

Defined results: a null text stays null and has no lines; a null key sorts last; rows
that repeat a key are told apart by their texts; rows that repeat both are one document and
get one result; lines without words stay; a document that had words and lost all its lines goes (``dedup_lines``); extra columns
are kept; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, unstage, words_of

MIN_WORDS = 8
#: (prime modulus below 2^31, base) of the two polynomial hashes.
MODULI = ((2147483647, 1103515245), (2147483629, 1664525))
#: Bits of a line's word count that powers cover.
POWER_BITS = 30
LAST = 9223372036854775807


def line_words(line: Column) -> Column:
    """words_of, with a plain split for lines that have single spaces only."""
    odd = (line == "") | line.startswith(" ") | line.endswith(" ")
    for c in ("  ", "\t", "\r", "\x0b", "\x0c", "\n"):
        odd = odd | F.contains(line, F.lit(c))
    return F.when(odd, words_of(line)).otherwise(F.split(line, " ", -1))


def _power(base: int, p: int, i: Column) -> Column:
    """base ^ i mod p, by the digits of i to the base of 1024."""
    out = F.lit(1).cast("long")
    for k in range(0, POWER_BITS, 10):
        step = pow(base, 1 << k, p)
        powers = F.array(*[F.lit(pow(step, d, p)).cast("long") for d in range(1024)])
        digit = F.shiftright(i, k).bitwiseAND(F.lit(1023))
        out = out * F.get(powers, digit) % F.lit(p) if k else F.get(powers, digit)
    return out


def _document(key: str, text: str) -> list[Column]:
    """o and d: the key (null last) and 60 bits of the text's digest."""
    t = F.col(f"`{text}`")
    return [F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(LAST)).alias("o"), F.conv(F.substring(F.md5(t.cast("binary")), 1, 15), 16, 10).cast("long").alias("d")]


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """o, d (the document), no (line number), words, for lines with words."""
    whole = docs.select(*_document(key, text), F.col(f"`{text}`").alias("t"))  # below the generator: once a document
    rows = whole.select("o", "d", F.posexplode(F.split("t", "\n", -1)).alias("no", "line"))
    return rows.select("o", "d", "no", line_words(F.col("line")).alias("words")).filter(F.size("words") > 0)


def _halves(words: Column, n: Column) -> Column:
    """Hashes of the halves by which lines of ``n`` words can meet lines of ``n - 1``,
    ``n`` and ``n + 1`` words."""
    out = []
    for more in (0, 1):
        m = n + more
        cut = F.floor(m / 2).cast("int")
        out.append(F.xxhash64(F.lit("first"), m, F.slice(words, F.lit(1), cut)))
        out.append(F.xxhash64(F.lit("last"), m, F.slice(words, n - (m - cut) + 1, m - cut)))
    return F.array(*out)


def distinct_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per distinct line: h1, h2 (128-bit hash of the words), first place, n
    (words), halves (empty for lines too short for an edit)."""
    lines = _lines(docs, key, text)
    n = F.size("words")
    rows = lines.select(
        F.xxhash64("words").alias("h1"), F.xxhash64(F.lit(1), F.col("words"), F.lit(2)).alias("h2"), F.struct("o", "d", "no").alias("place"), n.alias("n"),
        F.when(n >= MIN_WORDS, _halves(F.col("words"), n)).alias("halves"),
    )
    return rows.groupBy("h1", "h2").agg(F.min("place").alias("place"), F.max("n").alias("n"), F.max("halves").alias("halves"))


def _near(docs: DataFrame, distinct: DataFrame, key: str, text: str) -> DataFrame:
    """(o, d, no) of first occurrences that have an earlier near line.  Staged."""
    long = distinct.filter("halves is not null")
    halves = long.select("place", F.explode("halves").alias("half"))
    met = halves.groupBy("half").agg(F.count("*").alias("c")).filter("c > 1").select("half")
    places = halves.join(met, "half", "left_semi").select("place").distinct()
    wanted = stage(places.groupBy(F.col("place.o").alias("o"), F.col("place.d").alias("d")).agg(F.collect_list("place.no").alias("nos")), "wanted")  # a document's own lines
    texts = docs.select(*_document(key, text), F.col(f"`{text}`").alias("t"))
    # The lines that meet, once each (rows may repeat), with their words.
    lines = texts.join(wanted.hint("merge"), ["o", "d"]).select("o", "d", F.split("t", "\n", -1).alias("lines"), "nos")
    lines = lines.select("o", "d", F.explode(F.transform("nos", lambda i: F.struct(i.alias("no"), F.get("lines", i).alias("line")))).alias("x")).select("o", "d", "x.no", "x.line")
    lines = lines.select(F.struct("o", "d", "no").alias("place"), line_words(F.col("line")).alias("w")).filter(F.size("w") >= MIN_WORDS)
    lines = stage(lines.groupBy(F.xxhash64("w").alias("h1"), F.xxhash64(F.lit(1), F.col("w"), F.lit(2)).alias("h2")).agg(F.min_by("w", "place").alias("w"), F.min("place").alias("place")).select("place", "w"), "near-lines")
    unstage(wanted)

    variants = stage(_variants(lines), "variants")

    # Substitution: the earliest line that left out the same place with the same rest.
    first = variants.groupBy("v1", "v2", "i").agg(F.min("place").alias("early"), F.count("*").alias("c")).filter("c > 1")
    pairs = variants.join(first, ["v1", "v2", "i"]).filter(F.col("early") < F.col("place")).select("place", "early")
    # Addition and omission: a variant that equals a whole line, either of them earlier.
    whole = variants.filter("i = 1").select(F.col("t1").alias("v1"), F.col("t2").alias("v2"), F.col("place").alias("short"))
    one = variants.select("v1", "v2", "place").join(whole, ["v1", "v2"])
    longer = one.filter(F.col("short") < F.col("place")).select("place", F.col("short").alias("early"))
    shorter = one.groupBy("short").agg(F.min("place").alias("early")).filter(F.col("early") < F.col("short")).select(F.col("short").alias("place"), "early")
    found = pairs.unionByName(longer).unionByName(shorter).distinct()

    # Verification over words, against the lines themselves.
    a = lines.select("place", F.col("w").alias("a"))
    b = lines.select(F.col("place").alias("early"), F.col("w").alias("b"))
    sure = found.join(a, "place").join(b, "early").filter(within_one(F.col("a"), F.col("b")))
    out = stage(sure.select("place.o", "place.d", "place.no").distinct(), "near")
    unstage(lines)
    unstage(variants)
    return out


def _variants(lines: DataFrame) -> DataFrame:
    """(place, i, v1, v2, t1, t2): the hashes of each line without its word i, and of the
    whole line."""
    words = lines.select("place", F.posexplode(F.transform("w", lambda x: F.xxhash64(x))).alias("k", "h"))
    terms = [(F.pmod(F.col("h"), F.lit(p)) * _power(base, p, F.col("k")) % F.lit(p)).alias(f"x{j}") for j, (p, base) in enumerate(MODULI)]
    rows = words.select("place", (F.col("k") + 1).alias("i"), *terms)
    line = Window.partitionBy("place")
    upto = line.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.select("place", "i", *[c for j in range(2) for c in (F.col(f"x{j}"), F.sum(f"x{j}").over(upto).alias(f"s{j}"), F.sum(f"x{j}").over(line).alias(f"t{j}"))])
    out = []
    for j, (p, base) in enumerate(MODULI):
        x, s, t = F.col(f"x{j}"), F.col(f"s{j}"), F.col(f"t{j}")
        # What follows the word moves one place to the left.
        out.append(((s - x) % p + (t - s) % p * F.lit(pow(base, -1, p)) % p) % p)
    return sums.select("place", "i", *[v.alias(f"v{j + 1}") for j, v in enumerate(out)], *[(F.col(f"t{j}") % p).alias(f"t{j + 1}") for j, (p, _) in enumerate(MODULI)])


def within_one(a: Column, b: Column) -> Column:
    """Edit distance over words at most 1: what follows the common start must agree
    after one word of either or both is left out."""
    n, m = F.size(a), F.size(b)
    both = F.arrays_zip(a.alias("x"), b.alias("y"))
    at = F.coalesce(F.array_position(F.transform(both, lambda z: ~z["x"].eqNullSafe(z["y"])), True), F.lit(0)).cast("int")
    rest = lambda w, k, size: F.slice(w, k, F.greatest(size - k + 1, F.lit(0)))
    return (F.abs(n - m) <= 1) & (
        (at == 0)
        | ((n == m) & (rest(a, at + 1, n) == rest(b, at + 1, m)))
        | ((n == m + 1) & (rest(a, at + 1, n) == rest(b, at, m)))
        | ((m == n + 1) & (rest(a, at, n) == rest(b, at + 1, m)))
    )


def dedup_table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row, packed as ``row``, with its text after the removal and the counts."""
    distinct = stage(distinct_lines(docs, key, text), "lines")
    near = _near(docs, distinct, key, text)
    # The lines that stay are the first occurrences without an earlier near line: fewer
    # rows than the lines that go would need, and already known without the texts.
    first = distinct.select("place.o", "place.d", "place.no").join(near, ["o", "d", "no"], "left_anti")
    kept = stage(first.groupBy("o", "d").agg(F.collect_list("no").alias("stay")), "kept")
    unstage(distinct)
    unstage(near)
    t = F.col(f"`{text}`")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), t.alias("t"), *_document(key, text))
    rows = rows.join(kept.hint("merge"), ["o", "d"], "left").select("row", "t", F.coalesce("stay", F.array().cast("array<int>")).alias("stay"), F.split("t", "\n", -1).alias("lines"))
    worded = F.transform("lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.withColumn("worded", worded)
    blank = F.filter(F.transform("worded", lambda x, i: F.when(~x, i)), lambda i: i.isNotNull())
    keep = F.filter(F.array_sort(F.array_union(F.col("stay"), blank)), lambda i: i < F.size("lines"))
    rows = rows.withColumn("left", F.transform(keep, lambda i: F.get("lines", i)))
    n = F.size(F.filter("worded", lambda x: x))
    gone = F.size("lines") - F.size("left")
    return rows.select(
        "row", F.when(F.col("t").isNotNull(), F.array_join("left", "\n")).alias("text"),
        F.when(F.col("t").isNotNull(), n).otherwise(0).cast("long").alias("n_lines"), F.when(F.col("t").isNotNull(), gone).otherwise(0).cast("long").alias("n_dropped"),
    )


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with the lines that stay; those that lost all their lines go."""
    out = dedup_table(docs, key, text).filter((F.col("n_dropped") < F.col("n_lines")) | (F.col("n_lines") == 0))
    return out.select(*[F.col("text").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


#: dedup_table(documents) as (doc_id, n_lines, n_dropped, text), in DuckDB SQL.
SQL = r"""
WITH b AS (SELECT row_number() OVER () AS rid, doc_id, text, coalesce(doc_id, 9223372036854775807) AS o, ('0x' || substr(md5(text), 1, 15))::BIGINT AS d FROM documents),
l AS (SELECT rid, o, d, u.no AS no, u.line AS line, list_filter(regexp_split_to_array(u.line, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM (SELECT rid, o, d, unnest([{'no': i, 'line': string_split(text, chr(10))[i + 1]} FOR i IN range(0, len(string_split(text, chr(10))))]) AS u FROM b)),
f AS (SELECT array_to_string(w, ' ') AS s, any_value(w) AS w, min({'o': o, 'd': d, 'no': no}) AS p FROM l WHERE len(w) > 0 GROUP BY 1),
v AS (SELECT p, u.i AS i, u.v AS v FROM (SELECT p, unnest([{'i': k, 'v': array_to_string(w[1:k - 1], ' ') || chr(10) || array_to_string(w[k + 1:], ' ')} FOR k IN range(1, len(w) + 1)]) AS u FROM f WHERE len(w) >= 8)),
m AS (SELECT v, min(p) AS early FROM v GROUP BY v HAVING count(*) > 1),
a AS (SELECT v.p FROM v JOIN m USING (v) WHERE m.early < v.p),
x AS (SELECT p, u AS s FROM (SELECT p, unnest([array_to_string(w[1:k - 1] || w[k + 1:], ' ') FOR k IN range(1, len(w) + 1)]) AS u FROM f WHERE len(w) > 8)),
y AS (SELECT CASE WHEN x.p < f.p THEN f.p ELSE x.p END AS p FROM x JOIN f ON x.s = f.s),
g AS (SELECT p FROM a UNION SELECT p FROM y),
k AS (SELECT p.o AS o, p.d AS d, p.no AS no FROM f WHERE p NOT IN (SELECT p FROM g)),
r AS (SELECT l.rid, l.no, l.line, len(l.w) > 0 AS worded, (len(l.w) = 0 OR k.o IS NOT NULL) AS stays FROM l LEFT JOIN k ON l.o = k.o AND l.d = k.d AND l.no = k.no),
t AS (SELECT rid, count(*) FILTER (WHERE worded) AS n, count(*) FILTER (WHERE NOT stays) AS gone, coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (WHERE stays), '') AS left_ FROM r GROUP BY rid)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_lines, coalesce(gone, 0)::BIGINT AS n_dropped, left_ AS text FROM b LEFT JOIN t USING (rid)
"""
