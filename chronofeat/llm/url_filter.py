"""URL filter: rules first, else logistic regression on hashed character n-grams of host and path.

Everything is a DataFrame or SQL function. The model is fitted by full-batch gradient descent
inside one SQL aggregate over the small labelled table, and is applied as an array of weights.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hash buckets, n-gram sizes, rows of the labelled table at most, passes, step, ridge penalty.
BUCKETS, GRAMS, MAX_LABELLED, PASSES, STEP, RIDGE = 4096, (3, 4), 5000, 120, 4.0, 0.0005

#: Rules (verdict, host, path); each fits its host and all subdomains, if the path starts with its own.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))

#: The small labelled URL table: a line of label (1 to block) and url each.
LABELLED = Path(__file__).with_name("labelled_urls.txt")


def labelled_urls(spark: SparkSession, path: str | Path = LABELLED) -> DataFrame:
    """(url, label) of a labelled URL file; the one given here holds ordinary sites of many kinds and unwanted ones, none of them a host of the tables."""
    rows = [line.split(" ", 1) for line in Path(path).read_text(encoding="utf-8").splitlines() if line]
    return spark.createDataFrame([(url, int(label)) for label, url in rows], "url string, label int")


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://` or for null."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; empty without `://` or for null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, as host and path together; null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1], r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule = F.when(fits, rule_host + rule_path).otherwise(rule)
        verdict = F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def grams_of(host: Column, path: Column) -> Column:
    """Distinct hash buckets of the n-grams of `^host$path`, of host and path apart."""
    def of(s: Column, n: int) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.char_length(s) - (n - 1), F.lit(1)))
        return F.transform(at, lambda i: F.pmod(F.xxhash64(F.substr(s, i, F.lit(n))), F.lit(BUCKETS)).cast("int"))

    parts = [of(F.concat(F.lit(mark), part, F.lit(mark)), n) for mark, part in (("^", host), ("$", path)) for n in GRAMS]
    return F.array_distinct(F.concat(*parts))


def fit(labelled: DataFrame, *, url: str = "url", label: str = "label") -> list[float]:
    """Weights of BUCKETS buckets and, last, the intercept. Rows without a url or label teach nothing.

    The table is small by contract: more than MAX_LABELLED rows are an error. An empty table gives
    weights 0. Full-batch descent starts from 0, so equal tables give equal weights.
    """
    rows = labelled.where(F.col(url).isNotNull() & F.col(label).isNotNull()).select(host_of(F.col(url)).alias("h"), path_of(F.col(url)).alias("p"), F.col(label).cast("double").alias("y"))
    rows = rows.select("y", F.concat(grams_of(F.col("h"), F.col("p")), F.array(F.lit(BUCKETS))).alias("grams"))
    if (n := rows.select("y").limit(MAX_LABELLED + 1).count()) > MAX_LABELLED:
        raise ValueError(f"the labelled table has more than {MAX_LABELLED} rows")
    if not n:
        return [0.0] * (BUCKETS + 1)
    one = rows.agg(F.sort_array(F.collect_list(F.struct("y", "grams"))).alias("rows"))
    # for each bucket, the rows that hold it
    held = one.select(F.posexplode("rows").alias("i", "row")).select("i", F.explode("row.grams").alias("b")).groupBy("b").agg(F.sort_array(F.collect_list("i")).alias("at"))
    held = held.agg(F.map_from_entries(F.collect_list(F.struct("b", "at"))).alias("held"))
    every = one.crossJoin(held).select("rows", F.transform(F.sequence(F.lit(0), F.lit(BUCKETS)), lambda b: F.coalesce(F.element_at("held", b.cast("int")), F.array().cast("array<int>"))).alias("held"))
    step = f"""aggregate(sequence(1, {PASSES}), transform(held, h -> CAST(0 AS DOUBLE)), (w, pass) ->
        aggregate(array(transform(rows, r -> r.y - 1 / (1 + exp(-aggregate(r.grams, CAST(0 AS DOUBLE), (t, b) -> t + w[b]) / 8)))),
            w, (v, errors) -> transform(held, (h, b) ->
                v[b] + {STEP} * (aggregate(h, CAST(0 AS DOUBLE), (t, i) -> t + errors[i]) / size(rows) - {RIDGE} * v[b]))))"""
    return [float(x) for x in every.select(F.expr(step).alias("w")).first()["w"]]


def block_probability(grams: Column, weights: list[float]) -> Column:
    """The model's probability that a url is to block."""
    w = F.lit([round(x, 9) for x in weights[:-1]])
    total = F.aggregate(grams, F.lit(weights[-1]), lambda t, b: t + F.get(w, b))
    return 1 / (1 + F.exp(-total / 8))


def judge(pages: DataFrame, weights: list[float], *, key: str = "page_id", url: str = "url", threshold: float = 0.5) -> DataFrame:
    """Per row of pages (key, host, path, rule, verdict, score): the longest rule's verdict, else the model's.

    A null url, or one without `://`, has an empty host and path, fits no rule and is judged by the
    model. Repeated rows get equal results; an empty table an empty one. Other columns are not
    looked at. The score is the model's probability to block, also where a rule decides.
    """
    rows = pages.select(F.col(key).alias("key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rule, ruled = rule_of(F.col("host"), F.col("path"))
    score = block_probability(grams_of(F.col("host"), F.col("path")), weights)
    rows = rows.select("key", "host", "path", rule.alias("rule"), ruled.alias("ruled"), score.alias("score"))
    verdict = F.coalesce("ruled", F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return rows.select(F.col("key").alias(key), "host", "path", "rule", verdict.alias("verdict"), "score")
