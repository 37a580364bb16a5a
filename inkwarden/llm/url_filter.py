"""URL filter: host and path rules first, then the likelihood ratio of two character models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, ASCII_UPPER, looked_up, settle

#: Fixed values: (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Host words that mark a URL as an example of what is not wanted; the character models generalise from these examples.
SEEDS = ["adult", "ads", "bets", "casino", "escort", "gambling", "lottery", "payday", "pills", "poker", "porn", "replica", "spam", "torrent", "viagra", "warez", "xxx"]


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or where there is no `://`."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), ASCII_UPPER, ASCII_LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls where none fits."""
    name = verdict = None
    for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict = (F.when(fits, h + p), F.when(fits, v)) if name is None else (name.when(fits, h + p), verdict.when(fits, v))
    return name, verdict


def grams_of(text: Column, order: int) -> Column:
    """Each character of `text` after the `order` characters before it, for those that lack some U+0002."""
    padded = F.concat(F.lit("\x02" * order), text)
    places = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text)))
    return F.transform(places, lambda i: F.substring(padded, i, F.lit(order + 1)))


def char_models(grams: DataFrame, order: int, strength: float) -> DataFrame:
    """(gram, n, gain) of every different gram of `grams` (gram, counted, rejected).

    gain is log p_accepted - log p_rejected of the gram's last character after the others, by exact counts of the `counted`
    rows of each class. Each order's estimate is smoothed towards that of the next shorter context, down to 1/256. The
    table grows with the input. n is how often the gram occurs. Counts are combined map-side; a gram meets as many longer
    ones as there are characters, so none of the joins here has a hot key.
    """
    of = lambda rejected: F.sum(F.when(F.col("counted") & (F.col("rejected") == rejected), 1).otherwise(0))
    counts = settle(grams.groupBy("gram").agg(of(False).alias("acc"), of(True).alias("rej"), F.count(F.lit(1)).alias("n")), "url-grams")
    levels = [counts.select("gram", "acc", "rej")]
    for k in range(order, 0, -1):
        levels.append(levels[-1].groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.sum("acc").alias("acc"), F.sum("rej").alias("rej")))
    model = None
    for k, level in enumerate(reversed(levels)):
        level = level.withColumn("context", F.substring("gram", 1, k))
        level = level.join(level.groupBy("context").agg(F.sum("acc").alias("of_acc"), F.sum("rej").alias("of_rej")), "context")
        if model is not None:
            level = level.withColumn("shorter", F.substring("gram", 2, k)).join(model.select(F.col("gram").alias("shorter"), "p_acc", "p_rej"), "shorter")
        below = lambda c: F.lit(1 / 256) if k == 0 else F.col(c)
        p = lambda c: ((F.col(c) + strength * below(f"p_{c}")) / (F.col(f"of_{c}") + strength)).alias(f"p_{c}")
        model = settle(level.select("gram", p("acc"), p("rej")), f"url-model-{k}")
    return settle(model.select("gram", F.log(F.col("p_acc") / F.col("p_rej")).alias("gain")).join(counts.select("gram", "n"), "gram"), "url-model")


def threshold(held_out: DataFrame, bins: int = 400, span: float = 4.0) -> float:
    """The score under which URLs are blocked: the middle of the cuts with the best mean of both classes' accuracies."""
    bin_of = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col("score") + span) * (bins / (2 * span))).cast("int")))
    counts = np.zeros((2, bins))
    for r in held_out.groupBy(bin_of.alias("bin"), F.col("rejected").cast("int").alias("k")).count().collect():  # 2 * bins rows at most
        counts[r.k, r.bin] = r["count"]
    if not counts.sum(1).all():
        return -float("inf")
    share = counts / counts.sum(1, keepdims=True)
    under = np.concatenate([np.zeros((2, 1)), np.cumsum(share, 1)], 1)
    gain = under[1] - under[0]
    best = np.flatnonzero(gain >= gain.max() - 1e-9)
    return float((best[0] + best[-1]) / 2 * (2 * span / bins) - span)


def url_verdicts(pages: DataFrame, rules=RULES, seeds=SEEDS, order: int = 4, strength: float = 30.0) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every row.

    The longest rule whose host is the URL's or a parent of it, and whose path begins the URL's, decides. Other URLs are
    judged by two smoothed variable-order character models of host and path: one fitted on the URLs whose host has one of
    `seeds` as a whole label part, one on the rest; three quarters of the URLs (by hash) are counted, the other quarter sets the
    cut of `score`, the length-normalised log-likelihood difference. Rules play no part in the fitting. Where a class has no
    example, nothing is blocked by the models.

    Counts are exact and as many as the URLs have grams. Each URL's grams look up their gain, so no task or driver holds the
    model: Spark broadcasts it while its file is under the broadcast threshold, else joins; hot grams are dealt out.
    Null urls have empty host and path, score 0 and are allowed unless the cut lies above 0. Repeated rows, null ids
    included, get equal results. Extra columns are ignored. No rows in, no rows out.
    """
    url = F.col("url").cast("string")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path")).withColumn("text", F.concat("host", "path"))
    rejected = F.arrays_overlap(F.split("host", "[^a-z0-9]+"), F.array(*[F.lit(s) for s in seeds]))
    held = F.pmod(F.crc32("text"), F.lit(4)) == 0
    rows = settle(rows.select(F.monotonically_increasing_id().alias("row"), "page_id", "host", "path", "text", rejected.alias("rejected"), held.alias("held")), "urls")
    grams = rows.select("row", (~F.col("held")).alias("counted"), "rejected", F.explode(grams_of(F.col("text"), order)).alias("gram"))
    gains = looked_up(grams.select("row", "gram"), char_models(grams, order, strength), ["gram"], ["row"])
    judged = rows.drop("text").join(gains.groupBy("row").agg(F.round(F.avg("gain"), 9).alias("score")), "row", "left").fillna(0.0, ["score"])
    judged = settle(judged, "url-scores")
    cut = threshold(judged.filter(F.col("held") & (F.concat("host", "path") != "")))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    by_model = F.when(F.col("score") < F.lit(cut), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_model).alias("verdict"), "score")
