"""Chat prompts and token lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpline.operators.groups import with_aggregates


def prompts(messages: DataFrame, template: str = "<|{role}|>\n{text}\n", suffix: str = "<|assistant|>\n") -> DataFrame:
    """One prompt per conversation: its turns in order through the template, then the suffix that asks for an answer."""
    head, rest = template.split("{role}")
    middle, tail = rest.split("{text}")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"))))
    said = F.transform(turns, lambda m: F.concat(F.lit(head), m["role"], F.lit(middle), m["text"], F.lit(tail)))
    return messages.groupBy("conv_id").agg(F.concat(F.array_join(said, ""), F.lit(suffix)).alias("prompt"))


def without_prompt(output: Column, prompt: Column) -> Column:
    """What ``output`` has after as many places as ``prompt`` has; empty if there is nothing."""
    n = F.size(output) - F.size(prompt)
    return F.when(n > 0, F.slice(output, F.size(prompt) + 1, n)).otherwise(F.slice(output, 1, 0))


def padded(df: DataFrame, ids: str, group: str, pad: int = 0) -> DataFrame:
    """``ids`` filled up on the left to the longest of its group. The longest are partial maxima that meet the rows in a join; null stays null."""
    known = with_aggregates(df, group, _longest=F.max(F.size(ids)))
    return known.withColumn(ids, F.concat(F.array_repeat(F.lit(pad).cast("int"), F.col("_longest") - F.size(ids)), F.col(ids))).drop("_longest")
