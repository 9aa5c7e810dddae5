"""Training pairs as token ids through a chat tokenizer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.operators.dataset import IGNORED, model_prompt


def honours_thinking(tokenizer) -> bool:
    """Whether the chat template takes enable_thinking and renders something else for it."""
    said = [{"role": "user", "content": "Hi"}]
    plain = tokenizer.apply_chat_template(said, tokenize=False, add_generation_prompt=True)
    try:
        return tokenizer.apply_chat_template(said, tokenize=False, add_generation_prompt=True, enable_thinking=True) != plain
    except TypeError:
        return False


def tokenised(records: DataFrame, load: Callable[[], object], max_length: int = 4096) -> DataFrame:
    """records (prompt, trace) with pair: struct<input_ids, labels, reject>.

    load() gives a tokenizer with apply_chat_template() and encode(); it and the probe run once for each task, not for each
    row. Labels of the prompt's tokens are masked. A pair that doesn't fit has a reject reason and no ids: it is never
    cut, as the answer stands at its end. Null prompts or traces are rejected as 'missing'.
    """

    @F.pandas_udf("input_ids array<int>, labels array<int>, reject string")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        tokenizer = load()
        if not hasattr(tokenizer, "apply_chat_template"):
            raise ValueError("the tokenizer has no chat template")
        extra = {"enable_thinking": True} if honours_thinking(tokenizer) else {}

        def pair(prompt: str | None, trace: str | None) -> tuple:
            if prompt is None or trace is None:
                return None, None, "missing"
            asked = tokenizer.apply_chat_template([{"role": "user", "content": prompt}], tokenize=False, add_generation_prompt=True, **extra)
            n, ids = len(tokenizer.encode(asked, add_special_tokens=False)), list(tokenizer.encode(asked + trace, add_special_tokens=False))
            if n >= max_length:
                return None, None, "prompt_too_long"
            if len(ids) > max_length:
                return None, None, "total_too_long"
            return ids, [IGNORED] * n + ids[n:], None

        for prompts, traces in parts:
            yield pd.DataFrame([pair(p, t) for p, t in zip(prompts, traces, strict=True)], columns=["input_ids", "labels", "reject"], dtype=object)

    return records.withColumn("pair", run(model_prompt(F.col("prompt")), F.col("trace")))
