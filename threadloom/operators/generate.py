"""Answer generation behind one interface: providers take prompts in Arrow batches, failures fall back to a heuristic."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .render import heuristic_answer

#: A provider answers a list of prompts; it may raise.
Provider = Callable[[list[str]], list[str]]


def prompt(question: str = "question", context: str = "context") -> F.Column:
    return F.concat(F.lit("Answer the question from the context.\nContext:\n"), F.col(context), F.lit("\nQuestion: "), F.col(question), F.lit("\nAnswer:"))


def with_token_limit(call: Callable[..., list[str]], limit: int, names: tuple[str, str] = ("max_tokens", "max_completion_tokens")) -> Provider:
    """A call whose service knows only one of two names for its limit: the other is tried once the first is refused."""

    def provider(prompts: list[str]) -> list[str]:
        try:
            return call(prompts, **{names[0]: limit})
        except (TypeError, ValueError) as refused:
            if names[0] not in str(refused):
                raise
            return call(prompts, **{names[1]: limit})

    return provider


def with_retries(provider: Provider, attempts: int = 3, pause: float = 0.2) -> Provider:
    def again(prompts: list[str]) -> list[str]:
        for n in range(attempts):
            try:
                return provider(prompts)
            except Exception:
                if n + 1 == attempts:
                    raise
                time.sleep(pause * 2**n)
        raise AssertionError

    return again


def generate(prompts: DataFrame, provider: Provider, batch: int = 16, ident: str = "long") -> DataFrame:
    """qid, raw, failed: a batch that the provider cannot answer is marked, with the error as its raw text."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), batch):
                part = frame.iloc[i : i + batch]
                try:
                    raw, failed = provider(part.prompt.tolist()), False
                except Exception as e:  # recorded in the row, so one bad batch does not end the run
                    raw, failed = [f"[generation failed] {e}"] * len(part), True
                yield pd.DataFrame({"qid": part.qid, "raw": raw, "failed": failed})

    return prompts.select("qid", "prompt").mapInPandas(run, f"qid {ident}, raw string, failed boolean")


def answers(contexts: DataFrame, questions: DataFrame, units: DataFrame, provider: Provider | None = None) -> DataFrame:
    """Predictions: the provider's, post-processed, or the heuristic's where there is none or it failed.

    contexts: qid, context; units: qid, pos, text (for the heuristic).
    """
    plain = heuristic_answer(units, questions).select("qid", F.col("answer").alias("plain"))
    asked = questions.select("qid", F.col("text").alias("question"))
    if provider is None:
        return asked.join(plain, "qid", "left").select("qid", F.coalesce("plain", F.lit("")).alias("prediction"), F.lit(None).cast("string").alias("raw"))
    made = generate(contexts.join(asked, "qid").select("qid", prompt().alias("prompt")), provider)
    full = asked.join(made, "qid", "left").join(plain, "qid", "left")
    good = F.when(~F.coalesce("failed", F.lit(True)), T.post_process(F.col("raw"), F.col("question")))
    return full.select("qid", F.coalesce(good, "plain", F.lit("")).alias("prediction"), "raw")


def http_provider(url: str, model: str, limit: int = 64, timeout: float = 60.0) -> Provider:
    """A chat-completions service behind HTTP; one request a prompt, both names of its token limit tried."""
    import json
    from urllib import error, request

    def call(prompts: list[str], **limits: int) -> list[str]:
        out = []
        for text in prompts:
            body = json.dumps({"model": model, "temperature": 0, "messages": [{"role": "user", "content": text}], **limits}).encode()
            asked = request.Request(f"{url.rstrip('/')}/chat/completions", body, {"Content-Type": "application/json"})
            try:
                with request.urlopen(asked, timeout=timeout) as answer:
                    out.append(json.load(answer)["choices"][0]["message"]["content"] or "")
            except error.HTTPError as refused:
                raise ValueError(refused.read().decode("utf-8", "replace")) from refused
        return out

    return with_token_limit(call, limit)


def oracle(golds: DataFrame) -> DataFrame:
    return golds.select("qid", F.coalesce(F.get("golds", F.lit(0)), F.lit("")).alias("prediction"))
