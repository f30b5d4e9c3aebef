"""Host-level quality rules: failures by host, shrunk by an empirical beta prior."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let, materialize, words_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A host goes when its failure rate is above LEAST_RATE and its odds are above FACTOR times
#: those of the prior's mean, by the posterior's lower bound of DEVIATIONS deviations.
LEAST_RATE, FACTOR, DEVIATIONS = 0.2, 2.0, 2.0
#: Bounds of the prior's weight, in documents.
PRIOR_WEIGHT = (1.0, 1.0e6)


def _covered(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more.

    Windows are sorted by (hash, place), so equal ones are neighbours: no pair of windows
    is compared and a text of n words costs n log n.
    """

    def places(grams: Column) -> Column:
        marked = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        twice = let(marked, lambda s: F.filter(
            s, lambda x, i: F.coalesce(x["g"] == F.get(s, i - 1)["g"], F.lit(False)) | F.coalesce(x["g"] == F.get(s, i + 1)["g"], F.lit(False))
        ))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    grams = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))
    return F.when(F.size(words) < 4, 0).otherwise(
        let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), 0).otherwise(places(g)))
    )


def document_rules(documents: DataFrame, host: Column | None = None) -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    One pass without a shuffle over whole texts. A null or empty text has no words and
    fails; a null host is a host of its own. Repeated rows stay; other columns are dropped.
    """
    host = F.col("source") if host is None else host
    text = F.coalesce(F.col("text"), F.lit(""))

    def measures(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            _covered(words).cast("long").alias("n_repeat_words"),
        )

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    out = documents.select(
        "doc_id", host.cast("string").alias("host"),
        let(words_of(F.col("text")), measures).alias("m"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    return out.select(
        "doc_id", "host", "m.n_words", "m.word_chars", "n_symbols", "n_dup_lines", "m.n_repeat_words",
        ((F.col("m.n_words") < MIN_WORDS) | (100 * F.col("m.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("m.n_words"))).alias("base_failed"),
    )


def host_verdicts(rules: DataFrame, least_rate: float = LEAST_RATE, factor: float = FACTOR) -> DataFrame:
    """host, host_docs, host_failed, host_rate (shrunk), host_low (its lower bound), host_bad; a row per host.

    The prior is a beta fitted by moments to all hosts' rates, weighted by their documents:
    mean m and weight m(1-m)/v-1 within PRIOR_WEIGHT (the upper bound where the rates don't
    vary). A host's posterior is the beta of that prior and its documents; it is bad when the
    posterior's mean less DEVIATIONS standard deviations is above least_rate and above the
    rate whose odds are `factor` times those of m. So a host with few documents, or one no worse than the others, isn't. One row of moments goes to the driver. Without documents there are no hosts.
    """
    hosts = materialize(
        rules.groupBy("host").agg(F.count("*").alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failed")),
        "hosts",
    )
    n, f, q = hosts.agg(
        F.sum("host_docs"), F.sum("host_failed"), F.sum(F.col("host_failed") * F.col("host_failed") / F.col("host_docs"))
    ).first()
    mean = f / n if n else 0.0
    spread = max(0.0, q / n - mean * mean) if n else 0.0
    low, high = PRIOR_WEIGHT
    weight = min(high, max(low, mean * (1 - mean) / spread - 1)) if spread > 1e-12 else high
    rate = (F.col("host_failed") + F.lit(mean * weight)) / (F.col("host_docs") + F.lit(weight))
    low = rate - DEVIATIONS * F.sqrt(rate * (1 - rate) / (F.col("host_docs") + F.lit(weight + 1)))
    return hosts.select("*", F.round(rate, 9).alias("host_rate"), F.round(low, 9).alias("host_low"), (low > max(least_rate, factor * mean / (1 + (factor - 1) * mean))).alias("host_bad"))


def quality_rules(documents: DataFrame, host: Column | None = None, least_rate: float = LEAST_RATE, factor: float = FACTOR) -> DataFrame:
    """document_rules with its host's figures and kept = neither rule nor host failed.

    The measured rows (some tens of bytes each) are written once and read twice, so texts
    are scanned once. The table of hosts is on disk when the join is planned: Spark
    broadcasts it where its size allows and otherwise sorts and splits hot hosts.
    """
    rules = materialize(document_rules(documents, host), "rules")
    hosts = host_verdicts(rules, least_rate, factor).withColumnRenamed("host", "h")
    joined = rules.join(hosts, F.coalesce(rules["host"], F.lit("\0")) == F.coalesce(hosts["h"], F.lit("\0")), "left")
    return joined.drop("h").withColumn("kept", ~F.col("base_failed") & ~F.col("host_bad"))
