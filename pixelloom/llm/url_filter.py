"""URL filter: a rule list first, gradient-boosted trees on lexical features after it.

A rule is (action, host, path).  It fits its host and all subdomains if the url's path
starts with the rule's path; among the rules that fit, the one whose ``host + path`` is
longest wins.  Urls without a rule are judged by trees over lexical features: lengths,
depth, digit ratio, entropy, parameter count and suffix statistics (how often labelled urls
with the same two or three last labels of the host are bad, smoothed).

The trees are fitted on the driver on at most ``max_labelled`` labelled urls (a
documented bound) that the caller gives.  A url's own label never enters its suffix
statistics: rows to train on get them from the other folds, rows held out from the rows
trained on.  ``labelled_by_terms`` labels a table's urls by a fixed list of host terms for
use where no labelled urls exist; the trees do not see the terms.  Everything else is one
narrow pass.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule
and the verdict of the model on those features; repeated rows give repeated results;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import GBT, calibrated_threshold, halves

#: (action, host, path): fixed values.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Host terms of unwanted sites: fixed values.
TERMS = ("casino", "pills", "spam", "adult", "bets", "ads", "porn", "xxx", "viagra", "lottery", "payday", "warez", "track")
MAX_LABELLED = 20_000
PRECISION = 0.98
#: What the trees see, in this order.
FEATURES = ("length", "host_length", "path_length", "depth", "digit_ratio", "entropy", "parameters", "host_labels", "name_length", "vowel_ratio", "suffix_2", "suffix_3")
#: Pseudo-count of the prior in suffix statistics, and folds that hide a row's own label.
SMOOTHING, FOLDS = 4, 5


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    at = url.find("://") if url else -1
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((i for i in (rest.find("/"), rest.find("?"), rest.find("#")) if i >= 0), default=len(rest))
    host, rest = rest[:end], rest[end:]
    end = min((i for i in (rest.find("?"), rest.find("#")) if i >= 0), default=len(rest))
    return host.translate(_LOWER), rest[:end]


_LOWER = {c: c + 32 for c in range(65, 91)}


class Matcher:
    """Rules by host; a url looks up each suffix of its host's labels."""

    def __init__(self, rules):
        self.by_host: dict[str, list[tuple[str, str]]] = {}
        for action, host, path in rules:
            self.by_host.setdefault(host, []).append((path, action))

    def __call__(self, host: str, path: str) -> tuple[str | None, str | None]:
        best = None
        at = 0
        while True:
            suffix = host[at:]
            for p, action in self.by_host.get(suffix, ()) if suffix else ():
                if path.startswith(p) and (best is None or len(suffix) + len(p) > len(best[0])):
                    best = (suffix + p, action)
            at = host.find(".", at) + 1
            if at == 0:
                return best or (None, None)


def suffixes_of(host: str) -> tuple[str, str]:
    labels = host.split(".")
    return ".".join(labels[-2:]), ".".join(labels[-3:])


class Suffixes:
    """Smoothed share of bad urls by the two and three last labels of the host."""

    def __init__(self, hosts, y):
        self.prior = float(np.mean(y)) if len(y) else 0.0
        self.sums: dict[str, list[float]] = {}
        for h, v in zip(hosts, y):
            for x in set(suffixes_of(h)):
                s = self.sums.setdefault(x, [0.0, 0.0])
                s[0], s[1] = s[0] + v, s[1] + 1

    def __call__(self, host: str) -> tuple[float, float]:
        out = []
        for x in suffixes_of(host):
            a, n = self.sums.get(x, (0.0, 0.0))
            out.append((a + SMOOTHING * self.prior) / (n + SMOOTHING))
        return out[0], out[1]


def features(url: str | None, host: str, path: str, suffixes: Suffixes) -> list[float]:
    url = url or ""
    n = max(1, len(url))
    counts = np.unique(np.frombuffer(url.encode("utf-8", "replace"), np.uint8), return_counts=True)[1] if url else np.ones(1)
    p = counts / counts.sum()
    query = url.partition("?")[2]
    labels = host.split(".")
    names = labels[:-2] if len(labels) > 2 else labels[:1]
    longest = max(names, key=len) if names else ""
    return [
        len(url), len(host), len(path), path.count("/"), sum(c.isdigit() for c in url) / n, float(-(p * np.log2(p)).sum()),
        query.count("=") if query else 0, host.count("."), len(longest), sum(c in "aeiou" for c in longest) / max(1, len(longest)), *suffixes(host),
    ]


@dataclass
class UrlModel:
    """``held_out``: accuracy, precision and recall on the rows not trained on; ``splits``:
    how many of the trees' splits use a feature."""

    gbt: GBT
    threshold: float
    suffixes: Suffixes
    held_out: dict[str, float]
    splits: dict[str, int]

    def block(self, urls: list[str | None], split: list[tuple[str, str]]) -> np.ndarray:
        x = np.array([features(u, h, p, self.suffixes) for u, (h, p) in zip(urls, split)], float).reshape(-1, len(FEATURES))
        return self.gbt.margin(x) >= self.threshold


def labelled_by_terms(pages: DataFrame, url: str = "url", terms=TERMS) -> DataFrame:
    """(url, bad): bad if a label of the host has one of the terms as a word."""
    host = F.lower(F.regexp_extract(F.col(f"`{url}`"), r"://([^/?#]*)", 1))
    return pages.select(F.col(f"`{url}`").alias("url"), host.rlike(r"(^|[.-])(" + "|".join(terms) + r")([.-]|$)").cast("int").alias("bad")).filter("url is not null")


def fit(labelled: DataFrame, max_labelled: int = MAX_LABELLED, precision: float = PRECISION) -> UrlModel:
    """Fit on the ``max_labelled`` distinct urls of (url, bad) with the least hashes."""
    rows = labelled.groupBy("url").agg(F.max("bad").alias("bad")).orderBy(F.xxhash64("url"), "url").limit(max_labelled).collect()
    urls, y = [r["url"] for r in rows], np.array([r["bad"] for r in rows], float)
    split = [split_url(u) for u in urls]
    hosts = [h for h, _ in split]
    place = np.array([xxhash.xxh32_intdigest(u.encode("utf-8", "replace")) for u in urls], np.int64)
    train = halves(place)
    fold = np.where(train, place % FOLDS, FOLDS)
    x = np.zeros((len(urls), len(FEATURES)))
    for k in range(FOLDS + 1):
        seen = np.flatnonzero(train & (fold != k))
        known = Suffixes([hosts[i] for i in seen], y[seen])
        for i in np.flatnonzero(fold == k):
            x[i] = features(urls[i], *split[i], known)
    gbt = GBT(trees=40, depth=4).fit(x[train], y[train])
    margin, truth = gbt.margin(x[~train]), y[~train] == 1
    threshold = calibrated_threshold(margin, y[~train], precision)
    bad = margin >= threshold
    share = lambda a, b: float(a.sum() / b.sum()) if b.any() else 1.0
    held_out = {"accuracy": float((bad == truth).mean()) if len(truth) else 1.0, "precision": share(bad & truth, bad), "recall": share(bad & truth, truth)}
    return UrlModel(gbt, threshold, Suffixes([hosts[i] for i in np.flatnonzero(train)], y[train]), held_out, _splits(gbt))


def _splits(gbt: GBT) -> dict[str, int]:
    out = dict.fromkeys(FEATURES, 0)
    todo = list(gbt.nodes)
    while todo:
        node = todo.pop()
        if node.left is not None:
            out[FEATURES[node.feature]] += 1
            todo += [node.left, node.right]
    return out


def filter_urls(pages: DataFrame, model: UrlModel, rules=RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule (null if none fits), verdict (allow or block)."""
    shared = pages.sparkSession.sparkContext.broadcast((Matcher(rules), model))  # bounded by the rule list and max_labelled

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        match, judge = shared.value
        for frame in frames:
            urls = [u if isinstance(u, str) else None for u in frame["url"]]
            split = [split_url(u) for u in urls]
            ruled = [match(h, p) for h, p in split]
            block = judge.block(urls, split)
            verdict = [a or ("block" if b else "allow") for (_, a), b in zip(ruled, block)]
            yield pd.DataFrame({"page_id": frame["page_id"], "host": [h for h, _ in split], "path": [p for _, p in split], "rule": pd.Series([r for r, _ in ruled], dtype=object), "verdict": verdict})

    rows = pages.select(F.col(f"`{key}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"))
    return rows.mapInPandas(run, "page_id long, host string, path string, rule string, verdict string")
