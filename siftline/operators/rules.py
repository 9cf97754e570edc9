"""Rule scan: every message against an ordered set of weighted patterns, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.needles import candidates, needles
from siftline.functions.text import FLAGS, or_empty

THRESHOLD, MATCH_CHARS = 0.2, 200

#: A rule: field, pattern, category, confidence, reason.
Rule = tuple[str, str, str, float, str]


def rule_list(rules: DataFrame) -> list[Rule]:
    """A rule table as an ordered list; rules are written by people, so their number is bounded, but that is checked."""
    rows = rules.orderBy("rule_ord").select("field", "pattern", "category", "confidence", "reason").limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("more than 100,000 rules")
    return [tuple(r) for r in rows]


def categories(rules: list[Rule], taxonomy: list[str] = ()) -> list[str]:
    """The order in which categories win ties: those of the taxonomy, then others as rules bring them in."""
    return list(dict.fromkeys([*taxonomy, *(r[2] for r in rules)]))


def rule_counts(spark: SparkSession, rules: list[Rule], taxonomy: list[str] = ()) -> DataFrame:
    names = categories(rules, taxonomy)
    return spark.createDataFrame([(c, sum(r[2] == c for r in rules)) for c in names], "category string, rules long")


def matches(rules: list[Rule], fields: dict[str, Column], likely: dict[int, Column]) -> Column:
    """The rules that a row matches, in their order, with the text that matched. Each rule reads its own field alone; patterns are
    literals of the plan, so each is compiled once a task. likely: a condition without which the rule of that number can't match;
    only under it is the pattern run."""
    def hit(k: int, f: str, p: str, c: str, w: float, why: str) -> Column:
        text, pattern = or_empty(fields[f]), F.lit(FLAGS + p)
        found = F.substring(F.regexp_extract(text, FLAGS + p, 0), 1, MATCH_CHARS)
        fits = F.regexp_like(text, pattern)
        return F.when(likely[k] & fits if k in likely else fits, F.struct(F.lit(c).alias("category"), F.lit(float(w)).alias("confidence"), F.lit(why).alias("reason"), found.alias("text")))

    return F.filter(F.array(*(hit(k, *r) for k, r in enumerate(rules))), lambda m: m.isNotNull())


def best_category(found: Column, names: list[str], threshold: float = THRESHOLD) -> Column:
    """category, confidence: the sum of a category's confidences, capped at 1; of equal ones the earliest; under the threshold no
    category, but the confidence. Confidences are added in the order of the rules, and rounded after the comparison."""
    def score(k: int, name: str) -> Column:
        own = F.filter(found, lambda m: m["category"] == name)
        total = F.aggregate(own, F.lit(0.0), lambda a, m: a + m["confidence"])
        return F.struct(F.least(total, F.lit(1.0)).alias("s"), F.lit(-k).alias("o"), F.lit(name).alias("c"))

    scores = F.array(*(score(k, c) for k, c in enumerate(names)))
    top = F.array_max(scores)
    return F.when(F.size(found) == 0, F.struct(F.lit("").alias("category"), F.lit(0.0).alias("confidence"))).otherwise(F.struct(F.when(top["s"] >= threshold, top["c"]).otherwise("").alias("category"), F.bround(top["s"], 3).alias("confidence")))


def classify(messages: DataFrame, rules: list[Rule], taxonomy: list[str] = (), threshold: float = THRESHOLD, chars: int | None = None) -> DataFrame:
    """messages with rule_category, rule_confidence and rule_matches; chars bounds the text that patterns see, None for none."""
    if not rules:
        empty = "array<struct<category: string, confidence: double, reason: string, text: string>>"
        return messages.withColumns({"rule_category": F.lit(""), "rule_confidence": F.lit(0.0), "rule_matches": F.array().cast(empty)})
    used = sorted({r[0] for r in rules})
    fields = {f: F.col(f) if chars is None else F.substring(F.col(f), 1, chars) for f in used}
    needed = {k: n for k, r in enumerate(rules) if (n := needles(r[1]))}
    own = {f: {k: n for k, n in needed.items() if rules[k][0] == f} for f in used}
    found = messages.withColumns({f"_likely_{f}": candidates(messages.sparkSession, fields[f], n) for f, n in own.items() if n})
    likely = {k: F.array_contains(f"_likely_{rules[k][0]}", F.lit(k)) for k in needed}
    found = found.withColumn("rule_matches", matches(rules, fields, likely)).drop(*(f"_likely_{f}" for f in used))
    top = best_category(F.col("rule_matches"), categories(rules, taxonomy), threshold)
    return found.withColumn("_top", top).withColumns({"rule_category": F.col("_top.category"), "rule_confidence": F.col("_top.confidence")}).drop("_top")
