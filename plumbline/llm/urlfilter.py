"""URL filtering: host and path rules, and for all other URLs the ratio of two character language models.

The models are Markov models of variable order: the longest context that training met predicts the next byte, and its
counts are smoothed with the shorter contexts' predictions (Witten-Bell). One is trained on URLs that the rules allow,
the other on those they block. A URL's score is the difference of the two log-likelihoods divided by its length; the
limit above which a URL is allowed is calibrated on labelled URLs that were left out of training.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import binary_list

ORDER = 5


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty for null or without ://."""
    found = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits (of equally long ones the first given), or null. A rule is host/path."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):  # the last that fits stays
        name, _, start = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + start))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


class MarkovModel:
    """Counts of the bytes that follow each context of up to ORDER bytes, smoothed down to the empty context."""

    def __init__(self, urls: list[bytes], order: int = ORDER):
        self.order = order
        self.follow: dict[bytes, Counter] = {}
        for url in urls:
            text = b"\x02" + url + b"\x03"
            for i in range(1, len(text)):
                for k in range(min(order, i) + 1):
                    self.follow.setdefault(text[i - k : i], Counter())[text[i]] += 1
        self.sums = {c: (sum(n.values()), len(n)) for c, n in self.follow.items()}

    def log_probability(self, context: bytes, byte: int, memo: dict) -> float:
        key = (context, byte)
        if key not in memo:
            p = 1 / 256
            for k in range(len(context) + 1):
                suffix = context[len(context) - k :]
                if suffix not in self.sums:
                    break
                total, kinds = self.sums[suffix]
                p = (self.follow[suffix][byte] + kinds * p) / (total + kinds)
            if len(memo) > 500_000:
                memo.clear()
            memo[key] = math.log(p)
        return memo[key]


@dataclass
class UrlModel:
    accepted: MarkovModel
    rejected: MarkovModel
    limit: float = 0.0

    def __post_init__(self):
        self.memos = ({}, {})

    def score(self, url: bytes) -> float:
        """The difference of the log-likelihoods a byte; 0 for an empty URL."""
        text, n, total = b"\x02" + url + b"\x03", self.accepted.order, 0.0
        for i in range(1, len(text)):
            context = text[max(0, i - n) : i]
            total += self.accepted.log_probability(context, text[i], self.memos[0]) - self.rejected.log_probability(context, text[i], self.memos[1])
        return total / max(1, len(url))


def fit(urls: list[bytes], allowed: list[bool]) -> UrlModel:
    """Train on four fifths of the labelled URLs; calibrate the limit to the fewest balanced errors on the rest."""
    held = [i for i in range(len(urls)) if i % 5 == 4]
    rest = [i for i in range(len(urls)) if i % 5 != 4]
    model = UrlModel(MarkovModel([urls[i] for i in rest if allowed[i]]), MarkovModel([urls[i] for i in rest if not allowed[i]]))
    good = np.sort([model.score(urls[i]) for i in held if allowed[i]])
    bad = np.sort([model.score(urls[i]) for i in held if not allowed[i]])
    if len(good) and len(bad):
        every = np.unique(np.concatenate([good, bad]))
        limits = np.concatenate([[every[0] - 1], (every[1:] + every[:-1]) / 2])
        errors = np.searchsorted(good, limits) / len(good) + 1 - np.searchsorted(bad, limits) / len(bad)
        best = np.flatnonzero(errors == errors.min())
        model.limit = float(limits[best[len(best) // 2]])
    return model


def judge(pages: DataFrame, rules: list[tuple[str, str]], id_column: str = "page_id", url: str = "url", sample_rows: int = 10_000) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of each row.

    rules are (host/path, allow or block). A rule fits its host and all subdomains where the path begins with the
    rule's; the longest wins and gives the verdict. Without a rule the models do: score above the calibrated limit is
    allow, and score is null where a rule decides. The models learn from at most sample_rows different URLs of each
    verdict that rules decide, those with the smallest hashes; others are left out before they are ordered. A null or empty URL has empty host and path and score 0. If rules
    decide for no URL of one kind, that model is empty and still defined. Other columns are not read; repeated rows are
    judged one by one.
    """
    text = pages[url].cast("string")
    split = pages.select(pages[id_column].alias("page_id"), text.alias("url"), host(text).alias("host"), path(text).alias("path"))
    ruled = split.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    verdicts = F.create_map(*[F.lit(x) for r in rules for x in r])
    known = ruled.withColumn("decided", verdicts[F.col("rule")] if rules else F.lit(None).cast("string"))
    sample = []
    for verdict in ("allow", "block"):
        urls = known.where(F.col("decided") == verdict).select("url", F.xxhash64("url").alias("h"))
        kinds = urls.agg(F.approx_count_distinct("url", 0.02)).first()[0]  # twice the error's margin is left
        share = min(1_000_000, math.ceil(1e6 * (1.1 * sample_rows + 500) / max(1, kinds)))
        chosen = urls.where(F.pmod("h", F.lit(1_000_000)) < share).distinct().orderBy("h", "url").limit(sample_rows).collect()
        sample += [(r["h"], r["url"].encode(), verdict == "allow") for r in chosen]
    sample.sort()
    shared = pages.sparkSession.sparkContext.broadcast(fit([s[1] for s in sample], [s[2] for s in sample]))
    schema = ruled.drop("url").schema.add("verdict", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            decided = batch.column(5).to_pylist()
            scores = [None if d else model.score(u or b"") for d, u in zip(decided, binary_list(batch.column(1)))]
            verdict = [d or ("allow" if s > model.limit else "block") for d, s in zip(decided, scores)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(batch.column(i) for i in (2, 3, 4)), pa.array(verdict, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return known.mapInArrow(run, schema)
