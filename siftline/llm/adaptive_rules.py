"""Quality rules whose thresholds come from mergeable quantile sketches per language and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftline.llm.common import SPACE_CLASS, join_hot, stash

#: Base rule: least words, and largest share of repeated words in percent.
MIN_WORDS, MAX_REPEAT = 50, 50
#: A threshold is the upper decile plus REACH times the distance between the deciles, drawn towards that of the language as if the
#: group had PRIOR more documents; beyond it a document may have EVENTS chance events.
REACH, PRIOR, EVENTS = 10, 200, 3
#: Metrics: what is counted, of how many, and how many of them one chance event counts (two equal 3-word windows are six words).
METRICS = {"symbols": ("n_symbols", "word_chars", 1), "repeats": ("n_repeat_words", "n_words", 6), "dup_lines": ("n_dup_lines", "n_lines", 1), "caps": ("n_caps", "n_words", 1)}

_WORDS = rf"filter(split(coalesce(text, ''), r'[{SPACE_CLASS}]+'), x -> x <> '')"
_LINES = rf"filter(split(coalesce(text, ''), r'\n', -1), x -> x rlike r'[^{SPACE_CLASS}]')"
#: Places of all 3-word windows with a hash, sorted by it, so that equal windows stand side by side; then those with an equal
#: neighbour, in text order; each adds the words that the one before it has not covered.
_REPEATS = """
aggregate(
  array_sort(transform(
    element_at(transform(array(array_sort(transform(sequence(1, size(w) - 2), i -> struct(xxhash64(w[i - 1], w[i], w[i + 1]) AS h, i)))),
      s -> filter(s, (x, k) -> (k > 0 AND s[greatest(k - 1, 0)].h = x.h) OR (k < size(s) - 1 AND s[least(k + 1, size(s) - 1)].h = x.h))), 1),
    x -> x.i)),
  struct(0L AS c, -2 AS last), (a, i) -> struct(a.c + least(3, i - a.last) AS c, i AS last), a -> a.c)
"""


def text_metrics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and counts (long) over the whole text; a null text has none.

    n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words are as the base rules define them; n_lines counts lines with a
    word and n_caps words without a small letter that have a capital. Equal windows are found by a 64-bit hash within a document.
    """
    w = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "lang", "source",
        F.expr(f"""element_at(transform(array({_WORDS}), w -> struct(
            CAST(size(w) AS BIGINT) AS n_words,
            aggregate(w, 0L, (a, x) -> a + char_length(x)) AS word_chars,
            CAST(size(filter(w, x -> x = upper(x) AND x <> lower(x))) AS BIGINT) AS n_caps,
            CASE WHEN size(w) < 3 THEN 0L ELSE {_REPEATS} END AS n_repeat_words)), 1)""").alias("m"),
        F.expr(f"element_at(transform(array({_LINES}), l -> struct(CAST(size(l) AS BIGINT) AS n_lines, CAST(size(l) - size(array_distinct(l)) AS BIGINT) AS n_dup_lines)), 1)").alias("l"),
        F.expr("CAST(regexp_count(coalesce(text, ''), '[#*$%&|<>]') AS BIGINT)").alias("n_symbols"),
    )
    return w.select("doc_id", "lang", "source", "m.*", "l.*", "n_symbols")


def with_base_rule(metrics: DataFrame) -> DataFrame:
    return metrics.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words")))


#: Each metric in whole thousandths, 0 to 1000: the bins of the sketches.
BINS = {k: f"coalesce(1000 * {n} DIV nullif({of}, 0), 0)" for k, (n, of, _) in METRICS.items()}


def sketches(metrics: DataFrame) -> DataFrame:
    """lang, source, metric, bin, n: one fixed-resolution quantile sketch per language, source and metric, from rows that pass the
    base rule. A sketch has at most 1001 bins, whatever it covers, and two are merged by adding their counts."""
    pairs = F.array(*(F.struct(F.lit(k).alias("metric"), F.expr(v).cast("int").alias("bin")) for k, v in BINS.items()))
    rows = metrics.where("NOT base_failed").select("lang", "source", F.explode(pairs).alias("p")).select("lang", "source", "p.*")
    return rows.groupBy("lang", "source", "metric", "bin").agg(F.count("*").alias("n"))


def thresholds(sketch: DataFrame, by: list[str]) -> DataFrame:
    """by..., n_docs and a threshold per metric (t_<metric>, at most 1000), of the sketches merged to the groups of `by`; a decile is
    the smallest bin that has a tenth, or nine tenths, of the documents at or under it."""
    merged = sketch.groupBy(*by, "metric", "bin").agg(F.sum("n").alias("n"))
    upto, whole = Window.partitionBy(*by, "metric").orderBy("bin"), Window.partitionBy(*by, "metric")
    c = merged.select(*by, "metric", "bin", F.sum("n").over(upto).alias("c"), F.sum("n").over(whole).alias("n"))
    low, high = (F.min(F.when(F.col("c") * 10 >= k * F.col("n"), F.col("bin"))) for k in (1, 9))
    q = c.groupBy(*by, "metric").agg(F.max("n").alias("n_docs"), low.alias("low"), high.alias("high"))
    q = q.withColumn("t", F.least(F.lit(1000), F.col("high") + REACH * (F.col("high") - F.col("low"))).cast("long"))
    return q.groupBy(*by).agg(F.max("n_docs").alias("n_docs"), *(F.max(F.when(F.col("metric") == k, F.col("t"))).alias(f"t_{k}") for k in METRICS))


def drawn(own: str, n: str, wider: str) -> Column:
    """A group's threshold, drawn towards the wider group's: their mean by the group's documents and PRIOR."""
    return F.expr(f"(coalesce({n}, 0) * coalesce({own}, 0) + {PRIOR} * {wider}) DIV (coalesce({n}, 0) + {PRIOR})")


def group_thresholds(m: DataFrame) -> DataFrame:
    """_group, _rows and a threshold per metric, for each language and source of m (see apply_rules())."""
    s = stash(sketches(m), "rule-sketches")
    own, of_lang = thresholds(s, ["lang", "source"]), thresholds(s, ["lang"])
    every = thresholds(s.withColumn("_all", F.lit(1)), ["_all"]).first()
    of_lang = of_lang.select(F.col("lang").alias("_lang"), *(drawn(f"t_{k}", "n_docs", str(every[f"t_{k}"] if every else 0)).alias(f"l_{k}") for k in METRICS))
    rows = m.groupBy("lang", "source", "_group").agg(F.count("*").alias("_rows"))
    same = rows["lang"].eqNullSafe(own["lang"]) & rows["source"].eqNullSafe(own["source"])
    table = rows.join(own, same, "left").select(rows["lang"], "_group", "_rows", "n_docs", *(f"t_{k}" for k in METRICS))
    table = table.join(of_lang, table["lang"].eqNullSafe(of_lang["_lang"]), "left")
    wider = {k: f"coalesce(l_{k}, {every[f't_{k}'] if every else 0})" for k in METRICS}
    return stash(table.select("_group", "_rows", *(drawn(f"t_{k}", "n_docs", wider[k]).alias(f"t_{k}") for k in METRICS)), "rule-thresholds")


def apply_rules(docs: DataFrame) -> DataFrame:
    """One row per document: its counts, base_failed and kept, which is false if base_failed or if a metric is above the
    threshold of its language and source.

    Thresholds come from the sketches alone: the upper decile and REACH times the distance between the deciles, drawn towards the
    threshold of the language over all sources, and that towards the one of all documents, the more the smaller a group is. A
    document fails if it has more than the threshold's share and EVENTS chance events, so a short text does not fail by one
    symbol. Null languages and sources are groups like others, null or empty texts fail the base rule, rows that repeat a doc_id
    are judged one by one, no rows give none, and other columns are ignored.
    """
    group = F.to_json(F.struct("lang", "source"))
    m = stash(with_base_rule(text_metrics(docs)).withColumn("_group", group), "rule-metrics")
    judged = join_hot(m, group_thresholds(m), "_group", "_rows", how="inner")
    above = F.lit(False)
    for k, (n, of, each) in METRICS.items():
        above = above | F.expr(f"1000 * {n} > t_{k} * {of} + {1000 * EVENTS * each}")
    return judged.withColumn("kept", ~F.col("base_failed") & ~above).drop("_group", "_rows")
