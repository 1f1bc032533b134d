"""URL filters with a character language-model ratio.

Host rules decide first: the longest rule whose domain is the host or a parent of it and whose path the
url's path starts with. What no rule decides is judged by two variable-order Markov
models over characters, one of accepted and one of rejected urls. A character's
probability after its context is the Witten-Bell mixture of the longest context seen and
all shorter ones, down to a uniform start. The score is the difference of the log-likelihoods divided by the number of
characters; a url is blocked when its score is below a threshold calibrated on the accepted
urls, of which a given share may fall below it.

Both models are counted over all urls that rules (or seed terms) decide. Counting,
mixing and scoring are joins and sums over character windows: counts are summed in the tasks
that read the urls, and a window's log ratio is looked up by a join. Only a table of counted size is
broadcast. Equal urls are scored once, so a url that fills a third of the rows is one row.

Defined cases: null urls and urls without ``://`` have empty host and path, no rule, and score 0; score 0 is
what an empty text gets, and such urls are allowed. Without accepted or without rejected urls nothing is
learnt: all is allowed. Repeated rows are judged alike.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowmill.llm.graph import small_enough
from flowmill.session import save_and_reload

ORDER = 5  # longest window: four characters of context and one
ALPHABET = 1 << 16  # of the uniform start
BROADCAST_ROWS = 500_000
START = "\u0002"

#: (domain, path prefix, verdict)
RULES = (
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"),
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(rest, upper, upper.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def with_rule(urls: DataFrame, rules=RULES) -> DataFrame:
    """Adds rule and rule_verdict: of the longest fitting rule, else null."""
    chosen = F.lit(None).cast("string")
    verdict = F.lit(None).cast("string")
    # Longest first; of equally long ones the one with the longer domain.
    for domain, path, what in sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0])), reverse=True):
        host = F.col("host")
        fits = ((host == domain) | host.endswith("." + domain)) & F.col("path").startswith(path)
        chosen = F.when(chosen.isNull() & fits, F.lit(domain + path)).otherwise(chosen)
        verdict = F.when(verdict.isNull() & fits, F.lit(what)).otherwise(verdict)
    return urls.withColumns({"rule": chosen, "rule_verdict": verdict})


def _windows(urls: DataFrame, *keep: str) -> DataFrame:
    """One row for each character: the ORDER characters that end with it."""
    padded = F.concat(F.lit(START * (ORDER - 1)), F.col("text"))
    at = F.explode(F.sequence(F.lit(1), F.length("text")))
    rows = urls.filter(F.length("text") > 0).select(*keep, padded.alias("p"), at.alias("i"))
    return rows.select(*keep, F.substring(F.col("p"), F.col("i"), F.lit(ORDER)).alias("gram"))


def log_ratios(texts: DataFrame) -> DataFrame:
    """(gram, ratio) from (text, accepted, n): log P_accepted - log P_rejected of a window's last character.

    Windows only seen in one model, and all of ``texts``, are in; others are looked up by
    their longest known ending, see :func:`scored`.
    """
    grams = _windows(texts, "accepted", "n").groupBy("gram").agg(
        F.sum(F.when(F.col("accepted"), F.col("n")).otherwise(0)).alias("yes"),
        F.sum(F.when(~F.col("accepted"), F.col("n")).otherwise(0)).alias("no"))
    level = save_and_reload(grams, "grams")
    # Counts of all endings of a window: each level is the sum of the longer one.
    levels = {ORDER: level}
    for size in range(ORDER - 1, 0, -1):
        level = level.groupBy(F.expr("substring(gram, 2)").alias("gram")).agg(
            F.sum("yes").alias("yes"), F.sum("no").alias("no"))
        levels[size] = level
    known = None
    for size in range(1, ORDER + 1):
        context = F.substring("gram", 1, size - 1).alias("context")
        rows = levels[size].withColumn("context", context)
        sums = rows.groupBy("context").agg(*[F.sum(c).alias(f"{c}_all") for c in ("yes", "no")], *[
            F.sum((F.col(c) > 0).cast("bigint")).alias(f"{c}_kinds") for c in ("yes", "no")])
        rows = rows.join(small_enough(sums, BROADCAST_ROWS), "context")
        if known is None:
            rows = rows.withColumns({f"{c}_below": F.lit(1.0 / ALPHABET) for c in ("yes", "no")})
        else:
            below = known.select(F.col("gram").alias("ending"), *[F.col(f"{c}_p").alias(f"{c}_below") for c in ("yes", "no")])
            rows = rows.withColumn("ending", F.expr("substring(gram, 2)")).join(
                small_enough(below, BROADCAST_ROWS), "ending")
        for c in ("yes", "no"):
            # Witten-Bell: as much weight for the shorter context as the context has kinds of followers.
            seen = (F.col(c) + F.col(f"{c}_kinds") * F.col(f"{c}_below")) / (F.col(f"{c}_all") + F.col(f"{c}_kinds"))
            rows = rows.withColumn(f"{c}_p", F.when(F.col(f"{c}_all") > 0, seen).otherwise(F.col(f"{c}_below")))
        known = rows.select("gram", "yes_p", "no_p")
        known = save_and_reload(known, "grams")
    return known.select("gram", (F.ln("yes_p") - F.ln("no_p")).alias("ratio"))


def scored(texts: DataFrame, ratios: DataFrame) -> DataFrame:
    """(text, score): the mean log ratio of a text's windows; a window never counted has ratio 0."""
    rows = _windows(texts.select("text").distinct(), "text")
    found = rows.join(small_enough(ratios, BROADCAST_ROWS), "gram", "left")
    return found.groupBy("text").agg(
        (F.sum(F.coalesce(F.round(F.col("ratio") * F.lit(1e9)).cast("bigint"), F.lit(0)))
         / F.lit(1e9) / F.count(F.lit(1))).alias("score"))


def judge_urls(
    urls: DataFrame, *, url_col: str = "url", keep: tuple[str, ...] = ("page_id",), rules=RULES,
    seed_terms: tuple[str, ...] = (), background: bool = True, wrongly_blocked: float = 0.002, folds: int = 1,
) -> DataFrame:
    """``keep``, host, path, rule, verdict and score (null where a rule decides).

    ``seed_terms`` in a host add rejected examples to learn from; the rules' verdicts stand.
    With ``background``, urls that nothing decides count as accepted examples: most are, and the
    accepted model then knows their domains, which no rule may name.
    The threshold is the ``wrongly_blocked`` quantile of the accepted urls' scores.
    With more than one of ``folds``, hosts are dealt to folds and a url is scored by models that have learnt
    nothing from its fold but seeded hosts, so no url trains its own acceptance; the threshold is then
    the quantile of the urls that a rule allows, if there are any, which are held out alike.
    """
    rows = urls.select(*keep, host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rows = with_rule(rows, rules).withColumn("text", F.concat("host", "path"))
    rows = save_and_reload(rows, "urls")
    seeded = F.lit(False)
    for term in seed_terms:
        seeded = seeded | F.col("host").contains(term)
    label = F.when(seeded, False).when(F.col("rule_verdict").isNotNull(), F.col("rule_verdict") == "allow")
    label = label.otherwise(F.lit(True)) if background else label
    rows = rows.withColumn("fold", F.pmod(F.xxhash64("host"), F.lit(folds)))
    allowed = F.coalesce(F.col("rule_verdict") == "allow", F.lit(False))
    learnt = rows.withColumns({"accepted": label, "seeded": seeded, "allowed": allowed}).filter(
        "accepted is not null and length(text) > 0").groupBy("text", "fold", "accepted", "seeded", "allowed").agg(
        F.count(F.lit(1)).alias("n"))
    learnt = save_and_reload(learnt, "learnt")
    # Windows of the urls to judge are counted with weight 0, so that every window has a ratio.
    asked = rows.select("text", "fold").distinct().select(
        "text", F.lit(True).alias("accepted"), F.lit(0).cast("bigint").alias("n"), "fold")
    kinds = learnt.agg(F.count_distinct("accepted")).first()[0]
    parts = []
    for fold in range(folds):
        own = F.col("fold") == fold
        train = learnt.filter(F.col("seeded") | ~own) if folds > 1 else learnt
        texts = train.select("text", "accepted", "n").unionByName(asked.filter(own).drop("fold"))
        parts.append(scored(rows.filter(own), log_ratios(texts)))
    scores = save_and_reload(reduce(DataFrame.unionByName, parts), "scores")
    good = learnt.filter("accepted")
    if folds > 1 and not good.filter("allowed").isEmpty():
        good = good.filter("allowed")
    good = good.join(scores, "text")
    # Exact quantile by counting scores in steps of 1e-6.
    steps = good.groupBy(F.floor(F.col("score") * 1e6).alias("step")).agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.orderBy("step"))
    every = F.sum("n").over(Window.partitionBy(F.lit(0)))
    cut = steps.withColumns({"upto": upto, "every": every}).filter(
        F.col("upto") > F.lit(wrongly_blocked) * F.col("every")).agg(F.min("step")).first()[0]
    low = cut / 1e6 if cut is not None and kinds == 2 else float("-inf")
    judged = rows.join(scores, "text", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    by_model = F.when((F.col("score") < low) & (F.col("text") != ""), "block").otherwise("allow")
    return judged.select(
        *keep, "host", "path", "rule", F.coalesce("rule_verdict", by_model).alias("verdict"),
        F.when(F.col("rule").isNull(), F.col("score")).alias("score"))
