"""Mixing sources to target weights by hierarchical budgeting.

The tree is domain, language, source. A token budget is dealt from the root down: among
siblings by weight, none beyond what its subtree can give (tokens times the most epochs); what
one cannot take goes to its siblings by weight, and only what a whole subtree cannot take goes
to that subtree's siblings. All amounts are integers. A leaf with T tokens and budget A gives
A div T whole epochs, and of the next epoch the documents whose running token count, in that
epoch's seeded order, stays within the rest.

Only numbers move. A row's place in the order is a hash of its id; token sums of buckets of that
hash (its leading hex digits, as many as the leaf's size asks for) tell in which bucket the
budget ends, and the rows of that one bucket are sorted for the last place that is taken. The
whole rows then compare their own places with their leaf's last one: texts are read twice and
neither shuffled nor sorted, whatever a leaf holds.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import documents, free_name, salt_of, written

DOMAINS = {"web": 50, "reference": 30, "forum": 20}
LANGUAGES = {"en": 40, "de": 20, "fr": 20, "es": 20}
#: Weight of a domain or language that is not listed, and of every source.
OTHER = 10
SOURCE = 1
SHARE_PERCENT = 80
EPOCHS = 2
SEED = 17
#: A leaf's order is cut into buckets of about so many rows or fewer, by leading hex digits.
BUCKET_ROWS = 4096
#: The plan (a row a leaf) is broadcast up to so many leaves; beyond them leaves are salted.
BROADCAST_LEAVES = 20_000
SALTS = 64
_LEAF = ["domain", "language", "origin"]


def domain_of(source: Column) -> Column:
    """The domain of a source by the number its name ends with: web, forum or reference in
    turn, other without a number."""
    number = F.regexp_extract(source, "([0-9]{1,9})$", 1)
    return F.when(number == "", "other").when(number.cast("long") % 3 == 0, "web").when(number.cast("long") % 3 == 1, "forum").otherwise("reference")


def token_count(text: Column) -> Column:
    """Runs of characters other than white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _weight(name: Column, weights: dict[str, int], other: int) -> Column:
    out = F.lit(other)
    for key, w in weights.items():
        out = F.when(name == key, w).otherwise(out)
    return out.cast("long")


def _dealt(children: DataFrame, parent: list[str], child: str) -> DataFrame:
    """children(parent..., child, weight, most, budget of the parent) with their share. A child
    is full if its weight's part of what is left would reach its most; children are tried in
    the order of most / weight."""
    order = Window.partitionBy(*parent).orderBy(F.col("most") / F.col("weight"), child)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*parent)
    zero = F.lit(0).cast("long")
    rows = children.withColumn("w_all", F.sum("weight").over(every)).withColumn("w_before", F.coalesce(F.sum("weight").over(before), zero)).withColumn("m_before", F.coalesce(F.sum("most").over(before), zero))
    rows = rows.withColumn("full", F.expr("most * (w_all - w_before) <= (budget - m_before) * weight"))
    taken = F.sum(F.when(F.col("full"), F.col("most")).otherwise(zero)).over(every)
    weight = F.sum(F.when(F.col("full"), F.col("weight")).otherwise(zero)).over(every)
    rows = rows.withColumn("m_full", taken).withColumn("w_full", weight)
    return rows.withColumn("share", F.expr("CASE WHEN full THEN most ELSE ((budget - m_full) * weight) div (w_all - w_full) END"))


@dataclass(frozen=True)
class Targets:
    """The weights of the tree's nodes: by domain, by language, and by source; `other` for
    domains and languages that are not named, `source` for such sources."""

    domains: dict[str, int] = field(default_factory=lambda: dict(DOMAINS))
    languages: dict[str, int] = field(default_factory=lambda: dict(LANGUAGES))
    sources: dict[str, int] = field(default_factory=dict)
    other: int = OTHER
    source: int = SOURCE


def budgets(leaves: DataFrame, percent: int, epochs: int, targets: Targets | None = None) -> DataFrame:
    """leaves(domain, language, origin, tokens) with their budget (tokens)."""
    targets = targets or Targets()
    most = (F.col("tokens") * epochs).alias("most")
    leaves = leaves.where("tokens > 0").select(*_LEAF, "tokens", most)
    total = (leaves.agg(F.sum("tokens")).first()[0] or 0) * percent // 100
    top = leaves.groupBy("domain").agg(F.sum("most").alias("most")).withColumn("weight", _weight(F.col("domain"), targets.domains, targets.other)).withColumn("root", F.lit(0))
    top = _dealt(top.withColumn("budget", F.lit(total).cast("long")), ["root"], "domain").select("domain", F.col("share").alias("budget"))
    middle = leaves.groupBy("domain", "language").agg(F.sum("most").alias("most")).withColumn("weight", _weight(F.col("language"), targets.languages, targets.other))
    middle = _dealt(middle.join(top, "domain"), ["domain"], "language").select("domain", "language", F.col("share").alias("budget"))
    lowest = leaves.withColumn("weight", _weight(F.col("origin"), targets.sources, targets.source)).join(middle, ["domain", "language"])
    return _dealt(lowest, ["domain", "language"], "origin").select(*_LEAF, "tokens", F.col("share").alias("budget"))


def _planned(rows: DataFrame, plan: DataFrame, few: bool, seed: int, prefix: str = "") -> DataFrame:
    """rows with the plan of their leaf, their spot in its order and the spot's bucket; all
    names, the plan's too, begin with the prefix."""
    at = lambda c: f"{prefix}{c}"
    plan, leaf = plan.select(*[F.col(c).alias(at(c)) for c in plan.columns]), [at(c) for c in _LEAF]
    if few:
        rows = rows.join(F.broadcast(plan), leaf)
    else:
        salted = rows.withColumn(at("salt"), salt_of(SALTS, at("unit"), at("print")))
        rows = salted.join(plan.withColumn(at("salt"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*leaf, at("salt")])
    spot = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(at("whole")).cast("string"), F.col(at("unit"))).cast("binary"))
    return rows.withColumn(at("spot"), spot).withColumn(at("bucket"), F.substring(at("spot"), F.lit(1), F.col(at("digits"))))


def mixed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", percent: int = SHARE_PERCENT, epochs: int = EPOCHS, seed: int = SEED, prefix: str = "mix_", targets: Targets | None = None, domain: Callable[[Column], Column] = domain_of) -> DataFrame:
    """The selected rows of df, each once, with mix_domain, mix_tokens, mix_copies (epochs in
    which it is taken), mix_leaf_tokens and mix_leaf_budget.

    Null languages and sources form leaves of their own, named unknown. Rows without tokens
    (empty or null texts) are never selected. Rows that repeat an id with other texts are rows
    of their own, next to each other in the order (by a hash of the text). Rows equal in id and
    text are taken together: in the last epoch all of them or none. Rows with a null id are
    ordered by a hash of their texts. An empty table gives an empty result. All columns of df pass through as they are; if one of them begins with the prefix,
    underscores are put before the prefix until none does. `targets` are the weights of the
    tree, `domain` makes the domain from a source's name.
    """
    prefix = free_name(df, prefix)
    at = lambda c: f"{prefix}{c}"
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    text = F.col(text_col).cast("string")
    unit = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("|"), F.xxhash64(text).cast("string")))
    rows = df.withColumns({at("domain"): domain(named(source_col)), at("language"): named(lang_col), at("origin"): named(source_col), at("tokens"): token_count(text), at("unit"): unit, at("print"): F.xxhash64(text)}).where(F.col(at("tokens")) > 0)
    narrow = written(rows.select(*[F.col(at(c)).alias(c) for c in (*_LEAF, "tokens", "unit", "print")]), "narrow")
    leaves = written(narrow.groupBy(*_LEAF).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")), "leaves")
    few = leaves.count() <= BROADCAST_LEAVES

    plan = budgets(leaves, percent, epochs, targets).join(leaves.select(*_LEAF, "rows"), _LEAF)
    digits = F.greatest(F.lit(1), F.ceil(F.log(16.0, F.col("rows") / BUCKET_ROWS))).cast("int")
    plan = written(plan.select(*_LEAF, F.col("tokens").alias("leaf_tokens"), F.col("budget").alias("leaf_budget"), F.expr("budget div tokens").alias("whole"), F.expr("budget % tokens").alias("rest"), digits.alias("digits")), "plan")
    # In a leaf's order of spots one bucket holds the end of the budget; only its rows are sorted.
    sums = _planned(narrow, plan, few, seed).groupBy(*_LEAF, "rest", "bucket").agg(F.sum("tokens").alias("sum"))
    ahead = Window.partitionBy(*_LEAF).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = sums.withColumn("base", F.coalesce(F.sum("sum").over(ahead), F.lit(0).cast("long"))).where("base <= rest AND rest < base + sum")
    plan = written(plan.join(ends.select(*_LEAF, F.col("bucket").alias("end"), "base"), _LEAF), "ends")
    units = _planned(narrow, plan, few, seed).where("bucket = end").groupBy(*_LEAF, "base", "rest", "spot", "unit", "print").agg(F.sum("tokens").alias("sum"))
    upto = Window.partitionBy(*_LEAF).orderBy("spot", "unit", "print").rowsBetween(Window.unboundedPreceding, 0)
    last = units.withColumn("reach", F.col("base") + F.sum("sum").over(upto)).where("reach <= rest").groupBy(*_LEAF).agg(F.max(F.struct("spot", "unit", "print")).alias("last"))
    plan = written(plan.join(last, _LEAF, "left").drop("base", "rest"), "cuts")

    placed = _planned(rows, plan, few, seed, prefix)
    spot = F.struct(F.col(at("spot")).alias("spot"), F.col(at("unit")).alias("unit"), F.col(at("print")).alias("print"))
    taken = (F.col(at("bucket")) < F.col(at("end"))) | F.coalesce(spot <= F.col(at("last")), F.lit(False))
    placed = placed.withColumn(at("copies"), F.col(at("whole")) + taken.cast("long")).where(F.col(at("copies")) > 0)
    return placed.select(*df.columns, *[at(c) for c in ("domain", "tokens", "copies", "leaf_tokens", "leaf_budget")])


def epochs_of(df: DataFrame, **options) -> DataFrame:
    """The selected rows of df, each as often as epochs take it, with the columns of df only."""
    prefix = free_name(df, "mix_")
    rows = mixed(df, prefix=prefix, **options)
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col(f"{prefix}copies")))
    return rows.withColumn(f"{prefix}epoch", times).select(*df.columns)


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    out = mixed(documents(spark, sf_dir))
    return out.select("doc_id", F.col("mix_domain").alias("domain"), "lang", "source", F.col("mix_tokens").alias("n_tokens"), F.col("mix_copies").alias("copies"), F.col("mix_leaf_tokens").alias("leaf_tokens"), F.col("mix_leaf_budget").alias("leaf_budget"))


def _case(name: str, weights: dict[str, int]) -> str:
    return f"CASE {name} " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in weights.items()) + f" ELSE {OTHER} END"


def _sql_dealt(source: str, parent: str, child: str) -> str:
    return f"""(SELECT *, CASE WHEN is_full THEN most ELSE ((budget - m_full) * weight) // (w_all - w_full) END AS share FROM (
  SELECT *, sum(CASE WHEN is_full THEN most ELSE 0 END) OVER (PARTITION BY {parent})::BIGINT AS m_full,
            sum(CASE WHEN is_full THEN weight ELSE 0 END) OVER (PARTITION BY {parent})::BIGINT AS w_full FROM (
    SELECT *, most * (w_all - w_before) <= (budget - m_before) * weight AS is_full FROM (
      SELECT *, sum(weight) OVER (PARTITION BY {parent})::BIGINT AS w_all,
        coalesce(sum(weight) OVER o, 0)::BIGINT AS w_before, coalesce(sum(most) OVER o, 0)::BIGINT AS m_before
      FROM {source}
      WINDOW o AS (PARTITION BY {parent} ORDER BY most / weight, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))))"""


SQL = f"""
WITH d AS (
  SELECT doc_id, lang, source, coalesce(lang, 'unknown') AS language, coalesce(source, 'unknown') AS origin,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens,
    regexp_extract(coalesce(source, 'unknown'), '([0-9]{{1,9}})$', 1) AS number FROM documents),
e AS (SELECT *, CASE WHEN number = '' THEN 'other' WHEN number::BIGINT % 3 = 0 THEN 'web' WHEN number::BIGINT % 3 = 1 THEN 'forum' ELSE 'reference' END AS domain
  FROM d WHERE n_tokens > 0),
leaves AS (SELECT domain, language, origin, sum(n_tokens)::BIGINT AS tokens, sum(n_tokens)::BIGINT * {EPOCHS} AS most FROM e GROUP BY ALL),
a AS (SELECT domain, sum(most)::BIGINT AS most, ({_case("domain", DOMAINS)})::BIGINT AS weight, 0 AS root,
  (SELECT (sum(tokens)::BIGINT * {SHARE_PERCENT}) // 100 FROM leaves) AS budget FROM leaves GROUP BY domain),
a2 AS (SELECT domain, share FROM {_sql_dealt("a", "root", "domain")}),
b AS (SELECT l.domain, language, sum(most)::BIGINT AS most, ({_case("language", LANGUAGES)})::BIGINT AS weight, any_value(a2.share) AS budget
  FROM leaves l JOIN a2 ON l.domain = a2.domain GROUP BY l.domain, language),
b2 AS (SELECT domain, language, share FROM {_sql_dealt("b", "domain", "language")}),
c AS (SELECT l.*, {SOURCE}::BIGINT AS weight, b2.share AS budget FROM leaves l JOIN b2 ON l.domain = b2.domain AND l.language = b2.language),
plan AS (SELECT domain, language, origin, tokens, share FROM {_sql_dealt("c", "domain, language", "origin")}),
f AS (SELECT doc_id, e.domain, lang, source, n_tokens, plan.tokens AS leaf_tokens, plan.share AS leaf_budget, share // tokens AS whole, share % tokens AS rest,
    sum(n_tokens) OVER (PARTITION BY e.domain, e.language, e.origin ORDER BY md5('{SEED}|' || (share // tokens)::VARCHAR || '|' || doc_id::VARCHAR), doc_id) AS reach
  FROM e JOIN plan ON e.domain = plan.domain AND e.language = plan.language AND e.origin = plan.origin)
SELECT doc_id, domain, lang, source, n_tokens, (whole + CASE WHEN reach <= rest THEN 1 ELSE 0 END)::BIGINT AS copies, leaf_tokens, leaf_budget
FROM f WHERE whole + CASE WHEN reach <= rest THEN 1 ELSE 0 END > 0
"""
