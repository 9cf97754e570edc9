"""Batch labelling by a pluggable labeller, its prompts, retries and statistics."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions.text import or_empty, parse_label_reply, prompt

LABEL_SCHEMA = "record_id string, reply string, error string, cost double"

#: A labeller takes prompts and returns (reply, input tokens, output tokens) for each; it may raise Busy to be asked again later.
Labeller = Callable[[list[str]], list[tuple[str, int, int]]]


class Busy(Exception):
    """The service asks to slow down."""


CLOSED = "Choose one of these categories for the message, or none: {categories}. Answer with JSON: category, confidence, reason.\nFrom: {from_name}\nSubject: {subject}\nText: {content}"
OPEN = "Name the kind of this message in a few words. Answer with JSON: category, confidence, reason.\nFrom: {from_name}\nSubject: {subject}\nText: {content}"


def build_prompts(rows: DataFrame, taxonomy: list[str] | None = None, chars: int = 500) -> DataFrame:
    """record_id, prompt: closed over a taxonomy, or open without one; the text is cut to its first chars."""
    fields = {"from_name": F.col("from_name"), "subject": F.col("subject"), "content": F.substring(or_empty(F.col("content")), 1, chars)}
    text = prompt(OPEN, **fields) if taxonomy is None else prompt(CLOSED, categories=F.lit(", ".join(taxonomy)), **fields)
    return rows.select("record_id", text.alias("prompt"))


def label_rows(prompts: DataFrame, make: Callable[[], Labeller], price_in: float = 0.0, price_out: float = 0.0, attempts: int = 3, wait: float = 1.0, size: int = 16) -> DataFrame:
    """record_id, reply, error, cost of each prompt: each partition makes a labeller of its own and asks it in small batches.

    A busy service is asked again after a growing wait, at most `attempts` times; then, and after any other failure, the rows of
    the batch have an empty reply and the error. A later success leaves no error behind.
    """

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        labeller = make()
        for pdf in batches:
            for a in range(0, len(pdf), size):
                part = pdf.iloc[a : a + size]
                got, error = [("", 0, 0)] * len(part), "busy"
                for k in range(attempts):
                    try:
                        got, error = labeller(part["prompt"].tolist()), ""
                        break
                    except Busy:
                        time.sleep(wait * 2**k)
                    except Exception as e:
                        error = f"{type(e).__name__}: {e}"
                        break
                yield pd.DataFrame({"record_id": part["record_id"], "reply": [g[0] for g in got], "error": error, "cost": [g[1] * price_in + g[2] * price_out for g in got]})

    return prompts.select("record_id", "prompt").mapInPandas(ask, LABEL_SCHEMA)


def parsed_labels(replies: DataFrame, taxonomy: list[str] | None = None) -> DataFrame:
    """record_id, llm_category, llm_confidence, llm_reason, error of replies; a reply that cannot be read is an error."""
    got = parse_label_reply(F.col("reply"), taxonomy)
    x = replies.withColumn("_p", got)
    error = F.when(or_empty(F.col("error")) != "", F.col("error")).when(F.col("_p").isNull(), "unreadable reply").otherwise("")
    return x.select("record_id", or_empty(F.col("_p.category")).alias("llm_category"), F.coalesce("_p.confidence", F.lit(0.0)).alias("llm_confidence"), or_empty(F.col("_p.reason")).alias("llm_reason"), error.alias("error"))


def label_stats(rows: DataFrame) -> DataFrame:
    """One row: total, errors, labelled, with_rule, agree of rows (llm_category, rule_category, error)."""
    ok = or_empty(F.col("error")) == ""
    llm, rule = or_empty(F.col("llm_category")), or_empty(F.col("rule_category"))
    return rows.agg(
        F.count("*").alias("total"), F.count_if(~ok).alias("errors"), F.count_if(ok & (llm != "")).alias("labelled"),
        F.count_if(ok & (rule != "")).alias("with_rule"), F.count_if(ok & (rule != "") & (llm == rule)).alias("agree"),
    )


def label_distribution(rows: DataFrame) -> DataFrame:
    """which, category, cnt: how often the labeller gave each category and, of those rows, the rule did."""
    good = rows.where((or_empty(F.col("error")) == "") & (or_empty(F.col("llm_category")) != ""))
    pairs = F.explode(F.array(F.struct(F.lit("llm").alias("which"), F.col("llm_category").alias("category")), F.struct(F.lit("rule").alias("which"), F.col("rule_category").alias("category"))))
    return good.select(pairs.alias("p")).select("p.*").where(or_empty(F.col("category")) != "").groupBy("which", "category").agg(F.count("*").alias("cnt"))


def first_disagreements(rows: DataFrame, limit: int = 20, order: str = "seq") -> DataFrame:
    """The first rows whose labeller and rule differ: record_id, subject (80 characters), rule, llm, llm_reason (100)."""
    bad = rows.where((or_empty(F.col("error")) == "") & (F.col("llm_category") != "") & (F.col("rule_category") != "") & (F.col("llm_category") != F.col("rule_category")))
    return bad.orderBy(order).limit(limit).select("record_id", F.substring("subject", 1, 80).alias("subject"), F.col("rule_category").alias("rule"), F.col("llm_category").alias("llm"), F.substring("llm_reason", 1, 100).alias("llm_reason"))


def total_cost(rows: DataFrame, price_in: float, price_out: float) -> DataFrame:
    """One row: the cost of all rows (tokens_in, tokens_out)."""
    return rows.agg(F.coalesce(F.sum(F.col("tokens_in") * price_in + F.col("tokens_out") * price_out), F.lit(0.0)).alias("cost"))


def http_labeller(url: str, model: str, key_env: str, style: str = "chat", timeout: float = 60.0) -> Callable[[], Labeller]:
    """Makes labellers that ask a service over HTTP, one request for each prompt: style "chat" (messages; the reply in choices) or
    "messages" (the reply in content). The key is read from the environment where the request is made; 429 and 5xx mean busy."""

    def make() -> Labeller:
        import json
        import os
        import urllib.error
        import urllib.request

        def one(prompt: str) -> tuple[str, int, int]:
            key = os.environ.get(key_env, "")
            auth = {"Authorization": f"Bearer {key}"} if style == "chat" else {"x-api-key": key}
            body = {"model": model, "max_tokens": 256, "temperature": 0, "messages": [{"role": "user", "content": prompt}]}
            request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **auth})
            try:
                with urllib.request.urlopen(request, timeout=timeout) as answer:
                    got = json.load(answer)
            except urllib.error.HTTPError as e:
                if e.code == 429 or e.code >= 500:
                    raise Busy from e
                raise
            used = got.get("usage", {})
            text = got["choices"][0]["message"]["content"] if style == "chat" else got["content"][0]["text"]
            return text, used.get("prompt_tokens", used.get("input_tokens", 0)), used.get("completion_tokens", used.get("output_tokens", 0))

        return lambda prompts: [one(p) for p in prompts]

    return make
