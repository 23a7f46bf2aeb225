"""The seam for language-model phases: a client is passed in, or the deterministic default.

A client is a function from prompts to texts; it runs on the executors, a bounded number of
partitions at a time. Prompts are redacted before they leave, budgets are checked before
calls, and a failed call leaves its placeholder instead of failing the job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import scrub, token_estimate

Client = Callable[[list[str]], list[str]]
CALL = "request_id long, phase string, text string, ok boolean, input_tokens long, output_chars long"


def echo_client(prompts: list[str]) -> list[str]:
    """The default: the first line of each prompt. It stands in for tests and dry runs."""
    return [p.split("\n", 1)[0][:180] for p in prompts]


def completed(requests: DataFrame, client: Client = echo_client, parallel: int = 4, budget_tokens: int | None = None) -> DataFrame:
    """One row per request (request_id, phase, prompt), answered by the client.

    With a budget, requests are taken in order of id until their estimated tokens reach it;
    the others are answered as not ok, at no cost.
    """
    prompt, _ = scrub(F.col("prompt"))
    clean = requests.select("request_id", "phase", prompt.alias("prompt")).withColumn("tokens", token_estimate(F.col("prompt")))
    if budget_tokens is None:
        allowed = clean.withColumn("allowed", F.lit(True))
    else:
        # Running sums over the requests of one phase: a run has few.
        upto = Window.partitionBy("phase").orderBy("request_id").rowsBetween(Window.unboundedPreceding, 0)
        allowed = clean.withColumn("allowed", F.sum("tokens").over(upto) <= budget_tokens)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = pdf[["request_id", "phase"]].assign(text="", ok=False, input_tokens=pdf["tokens"], output_chars=0)
            asked = pdf.index[pdf["allowed"]]
            try:
                answers = client(pdf.loc[asked, "prompt"].tolist())
            except Exception:  # noqa: BLE001  a provider may fail in any way; the rows say so
                answers = None
            if answers is not None:
                out.loc[asked, "text"] = answers
                out.loc[asked, "ok"] = [bool(a) for a in answers]
                out.loc[asked, "output_chars"] = [len(a) for a in answers]
            yield out

    return allowed.repartition(parallel).mapInPandas(run, CALL)


def with_placeholders(answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks without an answer get a placeholder from their own first words."""
    own = F.concat(F.lit("[not summarised] "), F.substring("text", 1, 180))
    met = chunks.join(answers.where("ok").select("request_id", F.col("text").alias("answer")), "request_id", "left")
    return met.select("request_id", F.coalesce("answer", own).alias("summary"), F.col("answer").isNull().alias("placeholder"))


def uncached(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests whose content key is not in the cache."""
    keyed = requests.withColumn("key", F.sha2(F.concat_ws("\u0000", "phase", "prompt"), 256))
    return keyed.join(cache.select("key"), "key", "left_anti")
