"""URL filters: rules by host and path, and for the rest a ratio of two character Markov models.

The models are of variable order: each probability leans on the longest context seen in training and is smoothed towards
the next shorter one. Counts live in a fixed number of hashed slots, so the model that is sent to the tasks has a
proven size, and URLs are scored where they lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .text import ascii_lower, fresh, without

#: Longest context, weight of the shorter context, symbols assumed below all contexts, slots for counts.
ORDER, PRIOR, SYMBOLS, SLOTS = 4, 2.0, 128, 1 << 18
#: One labelled URL in so many sets the threshold and is not counted.
HELD_OUT = 5
#: Scores are calibrated on a grid of this step and half-width.
STEP, REACH = 0.01, 20.0
_START, _END = "\x02", "\x03"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """``(rule, verdict)`` of the longest fitting rule, or nulls; ``rules``: (verdict, host, path), fitting subdomains too."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _positions(df: DataFrame, url: str, at: str) -> DataFrame:
    """A row for each character of the URL without its scheme, and for its end; ``at``: all of the text up to there that counts."""
    rest = ascii_lower(F.regexp_replace(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://", ""))
    padded = F.concat(F.lit(_START * ORDER), rest, F.lit(_END))
    ends = F.sequence(F.lit(1), F.length(padded) - ORDER)
    return df.withColumn(at, F.explode(F.transform(ends, lambda i: F.substring(padded, i, F.lit(ORDER + 1)))))


def _slots(at: Column) -> list[Column]:
    """Slots of the character with its 0 to ORDER characters before it, then of these contexts alone."""
    parts = [(k, F.substring(at, ORDER + 1 - k, k + 1)) for k in range(ORDER + 1)] + [(-1 - k, F.substring(at, ORDER + 1 - k, k)) for k in range(ORDER + 1)]
    return [F.pmod(F.xxhash64(F.lit(kind), part), F.lit(SLOTS)).cast("int") for kind, part in parts]


def counted(urls: DataFrame, url: str = "url", accepted: str = "accepted") -> DataFrame:
    """``(slot, n_accept, n_reject)`` over all characters of all labelled URLs; at most SLOTS rows, combined before the shuffle."""
    rows = _positions(urls.select(F.col(url).alias("u"), F.col(accepted).cast("int").alias("good")), "u", "at")
    slots = rows.select("good", F.explode(F.array(*_slots(F.col("at")))).alias("slot"))
    return slots.groupBy("slot").agg(F.sum("good").alias("n_accept"), F.sum(1 - F.col("good")).alias("n_reject"))


def scored(urls: DataFrame, model: DataFrame, url: str = "url", score: str = "score") -> DataFrame:
    """``urls`` with the mean over characters of log p_accept - log p_reject.

    The model is broadcast: it has at most SLOTS rows of three numbers. Rows are told apart by a number that lives within
    this plan; what is shuffled is one row of sums for each URL, not its characters.
    """
    row, text, at = fresh(urls, "row", "text", "at")
    df = _positions(urls.withColumn(row, F.monotonically_increasing_id()).withColumn(text, F.col(url)), text, at).drop(text)
    names = [f"{at}_{k}" for k in range(2 * ORDER + 2)]
    df = df.withColumns(dict(zip(names, _slots(F.col(at))))).drop(at)
    for name in names:
        side = model.select(F.col("slot").alias(f"{name}_s"), F.col("n_accept").alias(f"{name}_a"), F.col("n_reject").alias(f"{name}_r"))
        df = df.join(F.broadcast(side), F.col(name) == F.col(f"{name}_s"), "left").drop(name, f"{name}_s")
    chance = {}
    for kind in "ar":
        p = F.lit(1.0 / SYMBOLS)
        for k in range(ORDER + 1):
            n, of = (F.coalesce(F.col(f"{names[j]}_{kind}"), F.lit(0)) for j in (k, ORDER + 1 + k))
            p = (F.least(n, of) + PRIOR * p) / (of + PRIOR)
        chance[kind] = p
    df = df.select(row, *urls.columns, F.log(chance["a"] / chance["r"]).alias(at))
    return df.groupBy(row, *urls.columns).agg(F.avg(at).alias(score)).drop(row)


def threshold(judged: DataFrame) -> float:
    """Of held-out ``(score, accepted)`` rows: the grid point with most of both classes on their side (nearest to 0 of equals).

    0 where a class has no held-out row. Counts of each grid point are gathered first, so the window has a fixed size.
    """
    bins = int(2 * REACH / STEP)
    bin_ = F.least(F.greatest(F.floor((F.col("score") + REACH) / STEP), F.lit(0)), F.lit(bins)).cast("int")
    sums = judged.groupBy(bin_.alias("bin")).agg(F.sum(F.col("accepted").cast("int")).alias("a"), F.sum(1 - F.col("accepted").cast("int")).alias("r"))
    sums.createOrReplaceTempView("url_calibration")
    best = judged.sparkSession.sql(f"""
        WITH t AS (SELECT bin, a, r, sum(a) OVER () AS na, sum(r) OVER () AS nr FROM url_calibration),
        c AS (SELECT bin, coalesce(sum(r) OVER w, 0) / nr - coalesce(sum(a) OVER w, 0) / na AS gain
              FROM t WHERE na > 0 AND nr > 0
              WINDOW w AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        SELECT bin * {STEP} - {REACH} AS cut FROM c ORDER BY gain DESC, abs(bin * {STEP} - {REACH}), bin LIMIT 1""").first()
    return float(best.cut) if best else 0.0


def judged(pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, score and verdict (``allow`` or ``block``); columns of these names are replaced.

    URLs that a rule decides are the accepted and rejected examples of the models, less the held-out ones that
    set the threshold; all others are allowed if their score reaches it. A null URL is an empty text; repeated rows
    are judged alike; with examples of one kind only, the threshold is 0.
    """
    pages = without(pages, ["host", "path", "rule", "score", "verdict"], url)
    (fit,) = fresh(pages, "fit")
    df = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    df = df.withColumn(fit, rule_of(F.col("host"), F.col("path"), rules))
    df = df.withColumns({"rule": F.col(fit)["rule"], fit: F.col(fit)["verdict"]})
    held = F.crc32(F.coalesce(F.col(url), F.lit("")).cast("binary")) % HELD_OUT == 0
    known = df.filter(F.col(fit).isNotNull()).select(F.col(url).alias("url"), (F.col(fit) == "allow").alias("accepted"), held.alias("held"))
    model = cut_lineage(counted(known.filter("not held")), "url-model")
    cut = threshold(cut_lineage(scored(known.filter("held"), model).select("score", "accepted"), "url-held-out"))
    out = scored(df, model, url)
    return out.withColumn("verdict", F.coalesce(F.col(fit), F.when(F.col("score") >= cut, "allow").otherwise("block"))).drop(fit)
