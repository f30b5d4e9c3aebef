"""Mixing sources to target weights down a tree of domains, languages and sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

LEVELS = ("domain", "lang", "source")
#: Share of all tokens that the mixture takes, and times that a document may be taken.
BUDGET_PERCENT, MAX_EPOCHS = 80, 2
SEED = 17
#: Weights by level and value; others weigh 1.
WEIGHTS = {"domain": {"d0": 5, "d1": 3, "d2": 2}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}, "source": {}}
#: Leading hex digits of the order hash that part a leaf's documents.
DIGITS = 3


def domain_of(source: Column) -> Column:
    """The default domain: the number that ends the source's name, modulo 3; d0 without one."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1)
    return F.concat(F.lit("d"), F.coalesce(F.nullif(number, F.lit("")).cast("int"), F.lit(0)) % 3)


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    out = F.lit(1)
    for value, weight in weights.get(level, {}).items():
        out = F.when(F.col(level) == value, weight).otherwise(out)
    return out.cast("decimal(18,0)")


def _fill(nodes: DataFrame, parents: list[str], key: str) -> DataFrame:
    """Share each parent's budget among its children by weight, none above its capacity.

    Children in order of capacity per weight are full as long as a fair share of what is
    left would fill them; the rest share what then is left. So what a short child can't
    take goes to its siblings, and as a parent's capacity is its children's sum, a parent is
    short only when all of them are: then its siblings take over, one level up. All in
    integers; a share is rounded down.
    """
    w = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    before = w.orderBy(F.col("cap").cast("double") / F.col("w").cast("double"), key).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("decimal(20,0)")
    left = (F.col("budget") - F.coalesce(F.sum("cap").over(before), zero)).cast("decimal(20,0)")
    heavy = (F.sum("w").over(w) - F.coalesce(F.sum("w").over(before), F.lit(0).cast("decimal(18,0)"))).cast("decimal(18,0)")
    nodes = nodes.withColumns({"_left": left, "_heavy": heavy})
    nodes = nodes.withColumn("_full", F.col("cap") * F.col("_heavy") <= F.col("_left") * F.col("w"))
    some = {c: F.max(F.when(~F.col("_full"), F.col(c))).over(w) for c in ("_left", "_heavy")}
    nodes = nodes.withColumns({"_share_left": some["_left"], "_share_heavy": some["_heavy"]})
    share = F.expr("cast((_share_left * w) div _share_heavy as decimal(20,0))")
    return nodes.withColumn("given", F.when(F.col("_full"), F.col("cap")).otherwise(share)).drop("_left", "_heavy", "_full", "_share_left", "_share_heavy")


def leaf_targets(leaves: DataFrame, total: Column | int, weights: dict[str, dict[str, int]] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """leaves (LEVELS, tokens) with target: the tokens that each takes of the budget `total`."""
    plan, budget = None, None
    for depth, level in enumerate(LEVELS):
        keys = list(LEVELS[: depth + 1])
        nodes = leaves.groupBy(*keys).agg((F.sum("tokens") * max_epochs).cast("decimal(20,0)").alias("cap")).withColumn("w", _weight(level, weights))
        if plan is None:
            nodes = nodes.withColumn("budget", F.lit(total).cast("decimal(20,0)"))
        else:
            nodes = nodes.join(plan, keys[:-1])
        plan = _fill(nodes, keys[:-1], level).select(*keys, F.col("given").alias("budget"))
    return leaves.join(plan.withColumn("target", F.col("budget").cast("long")).drop("budget"), list(LEVELS))


def mix_documents(
    documents: DataFrame, domain: Column | None = None, weights: dict[str, dict[str, int]] = WEIGHTS,
    budget_percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS, seed: int = SEED,
) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, copies: how often the mixture takes each document.

    A token is four bytes of UTF-8, begun ones included. Each leaf takes whole epochs of its
    documents and then, from the next epoch's order by a hash of seed, epoch and doc_id, the
    longest prefix that its target still holds. Prefixes are found in two steps, by sums of
    parts of the order and then within the one part that the target cuts, so no task holds
    a leaf. Leaf tables are small aggregates and on disk when joined: Spark broadcasts them
    where their size allows and otherwise splits hot leaves.

    Null keys count as empty strings. Null and empty texts have no tokens: they are taken as
    often as their leaf's epochs, and in a prefix wherever it reaches them. Rows that share
    a doc_id are counted apart. An empty table gives an empty result. Other columns are
    dropped.
    """
    domain = domain_of(F.col("source")) if domain is None else domain
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    rows = materialize(
        documents.select("doc_id", *(F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in zip(LEVELS, (domain, F.col("lang"), F.col("source")))), F.floor((size + 3) / 4).cast("long").alias("n_tokens")),
        "mix-rows",
    )
    leaves = materialize(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), "leaves")
    everything = leaves.agg(F.sum("tokens")).first()[0] or 0
    plan = leaf_targets(leaves, everything * budget_percent // 100, weights, max_epochs)
    whole = F.when(F.col("tokens") > 0, F.expr("target div tokens")).otherwise(F.lit(max_epochs)).cast("long")
    plan = plan.withColumn("epochs", whole).withColumn("rest", F.col("target") - F.col("epochs") * F.col("tokens"))
    plan = materialize(plan.select(*LEVELS, "epochs", "rest"), "mix-plan")
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), F.col("doc_id").cast("string")))
    ordered = rows.join(plan, list(LEVELS)).withColumn("_order", order).withColumn("_part", F.substring("_order", 1, DIGITS))
    sums = ordered.groupBy(*LEVELS, "rest", "_part").agg(F.sum("n_tokens").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("_part"))
    cut = sums.withColumn("_upto", upto).where(F.col("_upto") > F.col("rest")).groupBy(*LEVELS).agg(
        F.min("_part").alias("_cut"), F.min_by(F.col("rest") - F.col("_upto") + F.col("n"), "_part").alias("_room")
    )
    cut = materialize(cut, "mix-cuts")
    placed = ordered.join(cut, list(LEVELS), "left")
    columns, again = ["doc_id", *LEVELS, "n_tokens"], F.col("epochs") < max_epochs
    clear = placed.where(F.col("_cut").isNull() | (F.col("_part") != F.col("_cut")))
    clear = clear.select(*columns, (F.col("epochs") + F.when((F.col("_part") < F.col("_cut")) & again, 1).otherwise(0)).alias("copies"))
    inside = placed.where(F.col("_part") == F.col("_cut"))
    run = F.sum("n_tokens").over(Window.partitionBy(*LEVELS).orderBy("_order", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0))
    inside = inside.withColumn("_run", run).select(*columns, (F.col("epochs") + F.when((F.col("_run") <= F.col("_room")) & again, 1).otherwise(0)).alias("copies"))
    return clear.unionByName(inside).select(*columns, F.col("copies").cast("long").alias("copies"))


def oracle(budget_percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS, seed: int = SEED, weights: dict[str, dict[str, int]] = WEIGHTS) -> str:
    """The same in DuckDB's SQL, with one plain window per leaf."""

    def weight(level: str) -> str:
        cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.get(level, {}).items())
        return f"(CASE {level} {cases} ELSE 1 END)::HUGEINT" if cases else "1::HUGEINT"

    parts, above = [], ""
    for depth, level in enumerate(LEVELS):
        keys = ", ".join(LEVELS[: depth + 1])
        parent = ", ".join(LEVELS[:depth])
        source = f"JOIN f{depth - 1} USING ({parent})" if depth else f"CROSS JOIN (SELECT sum(n_tokens)::HUGEINT * {budget_percent} // 100 AS given FROM docs)"
        by = f"PARTITION BY {parent}" if depth else ""
        parts.append(f"""n{depth} AS (
  SELECT {keys}, cap, {weight(level)} AS w, given AS budget
  FROM (SELECT {keys}, sum(n_tokens)::HUGEINT * {max_epochs} AS cap FROM docs GROUP BY {keys}) {source}
), s{depth} AS (
  SELECT *, budget - coalesce(sum(cap) OVER b, 0) AS room, sum(w) OVER ({by}) - coalesce(sum(w) OVER b, 0) AS heavy
  FROM n{depth} WINDOW b AS ({by} ORDER BY cap::DOUBLE / w::DOUBLE, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), g{depth} AS (SELECT *, cap * heavy <= room * w AS full_up FROM s{depth}),
f{depth} AS (
  SELECT {keys}, CASE WHEN full_up THEN cap ELSE (max(room) FILTER (NOT full_up) OVER ({by})) * w // (max(heavy) FILTER (NOT full_up) OVER ({by})) END AS given FROM g{depth}
)""")
        above = f"f{depth}"
    keys = ", ".join(LEVELS)
    return f"""
WITH docs AS (
  SELECT doc_id, 'd' || (coalesce(TRY_CAST(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) AS INTEGER), 0) % 3) AS domain,
         coalesce(lang, '') AS lang, coalesce(source, '') AS source, (coalesce(strlen(text), 0) + 3) // 4 AS n_tokens
  FROM documents
), {", ".join(parts)}, leaf AS (
  SELECT {keys}, tokens, given, CASE WHEN tokens > 0 THEN given // tokens ELSE {max_epochs} END AS epochs
  FROM {above} JOIN (SELECT {keys}, sum(n_tokens)::HUGEINT AS tokens FROM docs GROUP BY {keys}) USING ({keys})
), ordered AS (
  SELECT docs.*, epochs, given - epochs * tokens AS rest, md5('{seed}:' || epochs || ':' || doc_id) AS o FROM docs JOIN leaf USING ({keys})
)
SELECT doc_id, domain, lang, source, n_tokens::BIGINT AS n_tokens,
       (epochs + CASE WHEN rest >= 0 AND sum(n_tokens) OVER (PARTITION BY {keys} ORDER BY o, doc_id, n_tokens ROWS UNBOUNDED PRECEDING) <= rest
                       AND epochs < {max_epochs} THEN 1 ELSE 0 END)::BIGINT AS copies
FROM ordered
"""
