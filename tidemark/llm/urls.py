"""URL verdicts: host rules first, else logistic regression on hashed character n-grams."""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty for null or no ``://``."""
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule (host, path) that fits, as its index; null if none does.

    A rule fits its host and all subdomains where the path starts with the rule's. Rules
    are part of the job's settings, so their number is small; ties in length go to the
    first one stated.
    """
    order = sorted(range(len(rules)), key=lambda i: -len(rules[i][0] + rules[i][1]))

    def fits(rule: tuple[str, str]) -> Column:
        own = (host == rule[0]) | host.endswith("." + rule[0])
        return own & path.startswith(rule[1])

    return reduce(lambda rest, i: F.when(fits(rules[i]), F.lit(i)).otherwise(rest), reversed(order), F.lit(None).cast("int"))


def grams(host: str, path: str, bits: int, sizes: Sequence[int] = (3, 4, 5)) -> np.ndarray:
    """Distinct hashed n-grams; host and path have their own, with marks at both ends."""
    found = set()
    for kind, part in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in sizes:
            found.update(kind + part[i : i + n] for i in range(max(1, len(part) - n + 1)))
    return np.unique(np.fromiter((zlib.crc32(g.encode()) & ((1 << bits) - 1) for g in found), np.int64, len(found)))


def fit(labelled: Sequence[tuple[str, str, int]], bits: int = 16, rounds: int = 300, rate: float = 0.5, l2: float = 1e-3) -> np.ndarray:
    """Weights (the last is the bias) from a small table of (host, path, 1 for block).

    Full-batch gradient steps on the log loss, each row's indicators scaled to length 1
    and classes weighed alike; deterministic. An empty table gives zero weights.
    """
    weights = np.zeros((1 << bits) + 1)
    if not labelled:
        return weights
    rows = [grams(h, p, bits) for h, p, _ in labelled]
    y = np.array([v for _, _, v in labelled], float)
    share = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    which = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    index = np.concatenate(rows)
    value = np.repeat([len(r) ** -0.5 for r in rows], [len(r) for r in rows])
    for _ in range(rounds):
        margin = np.bincount(which, weights[index] * value, len(rows)) + weights[-1]
        error = share * (1 / (1 + np.exp(-margin)) - y)
        step = np.bincount(index, error[which] * value, len(weights))
        step[-1] = error.sum()
        weights -= rate * 20 * (step + l2 * weights / len(rows))
    return weights


def labelled_rows(table: DataFrame, limit: int = 20_000) -> list[tuple[str, str, int]]:
    """(host, path, label) of a labelled table (url, label), at most *limit* rows by url hash.

    Rows without a label are left out.
    """
    url = F.col("url")
    rows = table.filter("label is not null").select(host_of(url).alias("h"), path_of(url).alias("p"), F.col("label").cast("int").alias("y"), F.xxhash64("url").alias("o"))
    return [(r.h, r.p, r.y) for r in rows.orderBy("o", "h", "p", "y").limit(limit).collect()]


def judge(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]],
    labelled: Sequence[tuple[str, str, int]],
    bits: int = 16,
    threshold: float = 0.5,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """Verdict of every url: that of the longest fitting rule, else the model's.

    A null url, or one without ``://``, has an empty host and path and is judged by the
    model. Null ids, repeated and tied rows are judged one by one; other columns are not
    read, so their names cannot clash; an empty table gives none. Row-wise, no shuffle;
    the broadcast weights have a fixed size of ``2 ** bits`` numbers.
    """
    weights = pages.sparkSession.sparkContext.broadcast(fit(labelled, bits).astype(np.float32))

    @F.pandas_udf("double")
    def score(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        w = weights.value
        out = np.empty(len(hosts))
        for i, (h, p) in enumerate(zip(hosts, paths)):
            g = grams(h, p, bits)
            out[i] = 1 / (1 + np.exp(-(float(w[g].sum()) * len(g) ** -0.5 + float(w[-1]))))
        return pd.Series(out)

    parts = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    matched = parts.withColumn("_i", matching_rule(F.col("host"), F.col("path"), [r[:2] for r in rules])).withColumn("score", score("host", "path"))
    names = F.array(*[F.lit(h + p) for h, p, _ in rules]) if rules else F.array().cast("array<string>")
    verdicts = F.array(*[F.lit(v) for _, _, v in rules]) if rules else F.array().cast("array<string>")
    own = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return matched.select(
        "page_id", "host", "path",
        F.when(F.col("_i").isNotNull(), F.get(names, F.col("_i"))).alias("rule"),
        F.when(F.col("_i").isNotNull(), F.get(verdicts, F.col("_i"))).otherwise(own).alias("verdict"),
        "score",
    )
