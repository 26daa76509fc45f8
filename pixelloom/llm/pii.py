r"""Personal data by candidate gradient boosting, in DataFrame functions only.

High-recall generators propose spans, which may overlap: e-mail addresses, IPv4
addresses, card numbers and phone numbers by the fixed patterns, and looser forms of
them (spelled-out addresses, numbers grouped like phone or account numbers).  The
fixed patterns' valid matches are *base* spans and always stay.  Looser candidates
become spans of kind ``other`` if boosted trees over format and context features score
them above a threshold that was calibrated on held-out candidates.

Spark's regular expression functions give matches without positions; positions come
from the lengths of the matches and of the pieces between them (``split`` by the same
pattern), all in code points.  The patterns are written with possessive quantifiers
and anchors so that they take linear time on any text and no recursion in Java.

The trees are fitted on the driver on at most ``max_labelled`` candidates of a sample and
a fixed set of synthetic ones.  There are no hand-labelled spans.  A candidate of the base
patterns counts as positive if the fixed validators accept it (octets, Luhn, digit counts,
address form) and as negative otherwise; loose forms outside base spans, on which the
trees decide, are labelled by the synthetic texts alone (``synthetic``), and the threshold
is calibrated on those.  The features leave the validators out: they describe lengths,
separators, neighbours and context words.  The pass itself is narrow: nothing is shuffled, and memory is bounded by the
longest text.

Defined results: a null text counts as empty; repeated rows give repeated results; a
null key is passed through; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import GBT, calibrated_threshold, halves
from .common import text_or_empty

#: Fixed patterns (kind, Java pattern).  ``\G`` lets a match begin where the last one ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Looser candidates: a spelled-out address, or digits in groups.
LOOSE = r"(?<![\w.+-])(?:[A-Za-z0-9._%+-]{1,64}\x20?[\[(]\x20?at\x20?[\])]\x20?[A-Za-z0-9-]{1,64}(?:\x20?(?:\.|[\[(]\x20?dot\x20?[\])])\x20?[A-Za-z0-9-]{1,64}){1,8}|\(?[0-9]{2,4}\)?(?:[\x20./-]{1,2}[0-9]{2,6}){1,6})(?![\w@])"
KINDS = ("email", "ip", "card", "phone")
CONTEXT = 24
CONTEXT_WORDS = r"(?i)\b(?:tel|phone|call|fax|mobile|contact|mail|e-mail|email|address|ssn|account|iban|card|id|reach|write|dial|whatsapp|telefon|correo|courriel)\b"
MAX_LABELLED, MAX_DOCUMENTS = 20_000, 20_000
PRECISION = 0.995
#: Synthetic loose candidates, trees and their depth.
SYNTHETIC, TREES, DEPTH = 2400, 16, 3


def matches(text: Column, pattern: str, wanted: str | None = None) -> Column:
    """All matches as an array of (s, e, m): start, end (exclusive), text.  ``wanted``: a
    character without which there is no match, tested first."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int,m:string>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        s = a["at"] + F.length(x["p"])
        e = s + F.length(x["m"])
        return F.struct(e.alias("at"), F.array_append(a["out"], F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m"))).alias("out"))

    pairs = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda p, m: F.struct(p.alias("p"), m.alias("m")))
    spans = F.aggregate(pairs, zero, step, lambda a: a["out"])
    empty = F.array().cast("array<struct<s:int,e:int,m:string>>")
    some = F.contains(text, F.lit(wanted)) if wanted else text.rlike(r"[0-9]|[\[(]\x20?at\x20?[\])]" if pattern == LOOSE else "[0-9]")
    return F.when(some, spans).otherwise(empty)


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """The check digit test over a string of digits."""
    d = F.reverse(F.transform(F.split(number, ""), lambda c: c.try_cast("int")))
    d = F.filter(d, lambda c: c.isNotNull())
    s = F.aggregate(F.transform(d, lambda c, i: F.when(i % 2 == 0, c).when(c < 5, 2 * c).otherwise(2 * c - 9)), F.lit(0), lambda a, c: a + c)
    return s % 10 == 0


def valid_ip(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))


def base_spans(text: Column) -> dict[str, Column]:
    n = lambda x: F.length(digits(x["m"]))
    return {
        "email": matches(text, EMAIL, "@"),
        "ip": F.filter(matches(text, IP, "."), lambda x: valid_ip(x["m"])),
        "card": F.filter(matches(text, CARD), lambda x: n(x).between(13, 19) & F.when(n(x) <= 19, luhn(digits(x["m"]))).otherwise(False)),
        "phone": F.filter(matches(text, PHONE, "+"), lambda x: n(x).between(9, 15)),
    }


def candidate_features(text: Column, x: Column) -> list[Column]:
    """Format and context of a candidate; none tells a validator's answer."""
    m = x["m"]
    before = F.substr(text, F.greatest(x["s"] - (CONTEXT - 1), F.lit(1)), F.least(x["s"], F.lit(CONTEXT)))
    after = F.substr(text, x["e"] + 1, F.lit(CONTEXT))
    n = F.length(m)
    count = lambda c: (n - F.length(F.replace(m, F.lit(c), F.lit("")))) * 1.0
    one = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return [
        n * 1.0, F.length(digits(m)) * 1.0, F.length(digits(m)) / n, count("-"), count("."), count(" "), count("("), count("/"), count("@"),
        one(m.startswith("+")), one(m.rlike(r"(?i)\bat\b")), F.size(F.split(m, r"[^0-9]+", -1)) * 1.0,
        one(before.rlike(CONTEXT_WORDS)), one(after.rlike(CONTEXT_WORDS)), one(before.rlike(r"[\w.]$")), one(after.rlike(r"^[\w%]")), one(before.rlike(r"(?i)(?:version|v|no|page|vol|\$|€)\W*$")),
    ]


def synthetic(n: int = SYNTHETIC, seed: int = 7) -> tuple[list[str], list[int]]:
    """Short texts with one loose candidate each, and whether it is personal: spelled-out
    addresses, phone numbers without '+' and account numbers against dates, versions,
    prices, ranges and rows of figures, with and without context words on both sides."""
    r = random.Random(seed)
    d = lambda k: str(r.randint(1, 9)) + "".join(str(r.randint(0, 9)) for _ in range(k - 1))
    name = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 9)))
    filler = lambda: " ".join(name() for _ in range(r.randint(2, 5)))
    day, month, year = lambda: f"{r.randint(10, 28)}", lambda: f"{r.randint(1, 12):02d}", lambda: str(r.randint(1900, 2030))
    at, dot = lambda: r.choice((" (at) ", "(at)", " [at] ", "[at]")), lambda: r.choice((" (dot) ", "(dot)", " [dot] ", "[dot]", "."))
    who = lambda: r.choice((name(), f"{name()}.{name()}", f"{name()}{d(2)}"))
    said = ("tel", "phone", "call", "fax", "mobile", "contact", "dial", "whatsapp", "reach me")
    owned = ("account", "iban", "card", "id", "ssn")
    address = (lambda: f"{who()}{at()}{name()}{dot()}{r.choice(('com', 'org', 'net', 'de', 'fr'))}",)
    phone = (
        lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"{d(3)}.{d(3)}.{d(4)}", lambda: f"({d(3)}) {d(3)} {d(4)}",
    )
    dialled = (*phone, lambda: f"{d(3)} {d(3)} {d(4)}", lambda: f"0{d(2)} {d(4)} {d(4)}", lambda: f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", lambda: f"0{d(3)}/{d(6)}")
    account = (lambda: f"{d(4)} {d(4)} {d(4)}", lambda: f"{d(4)}-{d(4)}-{d(4)}", lambda: f"{d(3)}-{d(2)}-{d(4)}", lambda: f"{d(2)} {d(4)} {d(4)}")
    other = (
        lambda: f"{year()}-{month()}-{day()}", lambda: f"{day()}.{month()}.{year()}", lambda: f"{day()}/{month()}/{year()}", lambda: f"{day()}/{month()}/{d(2)}", lambda: f"{year()}-{year()}",
        lambda: f"{d(3)}-{d(3)}", lambda: f"{d(2)}.{d(2)}", lambda: f"{d(2)}.{d(2)}.{d(2)}", lambda: f"{d(2)} {d(2)} {d(2)} {d(2)}", lambda: f"{d(2)} 000 000", lambda: f"{d(3)} 000",
    )
    # Years in a row look like an account number, but for the context.
    years = (lambda: f"{year()} {year()} {year()}",)
    groups = (
        (1, address, ("",)), (1, address, ("mail", "email", "contact", "write")), (1, phone, ("",)), (1, dialled, said), (1, account, owned),
        (0, (*other, *years), ("",)), (0, (*other, *years), ("version", "page", "no", "vol", "$")), (0, other, (*said, *owned)),
    )
    texts, labels = [], []
    for i in range(n):
        y, forms, words = groups[i % len(groups)]
        word = r.choice(words)
        before = r.choice(("", filler() + " ")) if not word else f"{filler()} {word}{r.choice((' ', ': ', ' is '))}"
        texts.append(f"{before}{r.choice(forms)()}{r.choice(('', ' ' + filler(), ', ' + filler(), '.'))}")
        labels.append(y)
    return texts, labels


def fit(docs: DataFrame, text: str = "text", max_labelled: int = MAX_LABELLED, precision: float = PRECISION, key: str = "doc_id", max_documents: int = MAX_DOCUMENTS) -> tuple[GBT, float]:
    """Trees and threshold from the synthetic loose candidates and at most ``max_labelled``
    candidates of the base patterns and the looser one: those with the least hashes, of about
    ``max_documents`` documents drawn by a hash of key and text, in any partitioning.  A candidate of the table that overlaps no base span
    but has a loose form has no label there, so it is not trained on."""
    t = text_or_empty(F.col(f"`{text}`"))
    labelled = []
    valid = base_spans(F.col("t"))
    raw = {"email": (EMAIL, "@"), "ip": (IP, "."), "card": (CARD, None), "phone": (PHONE, "+")}

    def label(found: Column, accepted: Column) -> Column:
        return F.transform(found, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), F.exists(accepted, lambda v: (v["s"] <= x["s"]) & (v["e"] >= x["e"])).cast("int").alias("y")))

    for kind, (pattern, wanted) in raw.items():
        labelled.append(label(matches(F.col("t"), pattern, wanted), valid[kind]))
    labelled.append(label(matches(F.col("t"), LOOSE), F.concat(*valid.values())))
    share = min(1.0, max_documents / max(1, docs.count()))
    drawn = docs.filter(F.pmod(F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`"), F.lit(3)), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = drawn.select(t.alias("t")).filter(F.col("t").rlike("[0-9@]"))
    rows = rows.select("t", matches(F.col("t"), LOOSE).alias("loose"), F.concat(*labelled).alias("all"))
    free = lambda c: F.exists("loose", lambda v: (v["s"] < c["e"]) & (c["s"] < v["e"]))
    rows = rows.select("t", F.explode(F.filter("all", lambda c: (c["y"] == 1) | ~free(c))).alias("c"))
    rows = rows.select(_features(F.col("c")), F.col("c.y").alias("y"), F.xxhash64("c.m", "c.s", "t").alias("h"))
    rows = rows.orderBy("h", "x", "y").limit(max_labelled).collect()

    texts, labels = synthetic()
    made = docs.sparkSession.range(1).select(F.posexplode(F.split(F.lit("\n".join(texts)), "\n")).alias("i", "t"))
    made = made.select("i", "t", F.explode(matches(F.col("t"), LOOSE)).alias("c")).select("i", _features(F.col("c"))).orderBy("i").collect()

    xs = np.array([r["x"] for r in [*rows, *made]], float)
    y = np.array([r["y"] for r in rows] + [labels[r["i"]] for r in made], float)
    train = halves(np.concatenate([np.array([r["h"] for r in rows], np.int64).view(np.uint64) >> np.uint64(8), np.array([r["i"] for r in made], np.uint64)]))
    gbt = GBT(trees=TREES, depth=DEPTH).fit(xs[train], y[train])
    # The model decides on loose candidates only, so the threshold is theirs.
    held = ~train & (np.arange(len(y)) >= len(rows))
    return gbt, calibrated_threshold(gbt.margin(xs[held]), y[held], precision)


def _features(c: Column) -> Column:
    return F.array(*[f.cast("double") for f in candidate_features(F.col("t"), c)]).alias("x")


def personal_data(docs: DataFrame, model: tuple[GBT, float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, counts of base spans, digest of the base spans, all spans."""
    gbt, threshold = model
    t = F.col("t")
    base = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), text_or_empty(F.col(f"`{text}`")).alias("t"))
    found = base_spans(t)
    base = base.select("doc_id", "t", *[found[k].alias(k) for k in KINDS], matches(t, LOOSE).alias("loose"))
    known = F.concat(*[F.col(k) for k in KINDS])
    if gbt.nodes and threshold < float("inf"):
        free = F.filter("loose", lambda x: ~F.exists(known, lambda v: (v["s"] < x["e"]) & (x["s"] < v["e"])))
        # The features are bound to an array once per candidate, and the trees read them there.
        scored = F.transform(free, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.array(*[f.cast("double") for f in candidate_features(t, x)]).alias("x")))
        other = F.filter(scored, lambda c: gbt.column([F.get(c["x"], F.lit(j)) for j in range(17)]) >= F.lit(threshold))
    else:
        other = F.filter("loose", lambda x: F.lit(False))
    base = base.select("doc_id", *KINDS, F.transform(other, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))).alias("other"))

    def names(kind: str) -> Column:
        return F.transform(F.col(kind), lambda x: F.concat(F.lit(kind + ":"), x["s"], F.lit(":"), x["e"]))

    ours = F.concat(*[names(k) for k in KINDS])
    return base.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.size("other").cast("long").alias("n_other"),
        F.sha2(F.array_join(ours, ","), 256).alias("base_sha256"), F.array_join(F.concat(ours, names("other")), ",").alias("spans"),
    )
