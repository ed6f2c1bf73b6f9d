"""Named steps, and pipelines declared as lists of them: what a configuration names is looked up here.

A step is a function of a DataFrame and its options. Scorers and rerankers enter as columns or as functions of columns, so a step
stays a plan.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import rewritten_queries
from . import curation, ensemble

Step = Callable[..., DataFrame]

STEPS: dict[str, Step] = {}


def step(name: str) -> Callable[[Step], Step]:
    """Registers a step; a name that is taken is an error."""

    def add(f: Step) -> Step:
        if name in STEPS:
            raise ValueError(f"there is a step {name} already")
        STEPS[name] = f
        return f

    return add


def run_plan(df: DataFrame, plan: Sequence[tuple[str, Mapping]]) -> DataFrame:
    """The steps of a plan (name, options) in their order."""
    for name, options in plan:
        if name not in STEPS:
            raise KeyError(f"no step {name}; there are {', '.join(sorted(STEPS))}")
        df = STEPS[name](df, **options)
    return df


@step("retrieve")
def retrieve(df: DataFrame, *, by: str, score: str, tie: str, ret_topk: int) -> DataFrame:
    """The best so many of each question, with their rank from 1."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.col(score).desc(), tie))
    return df.withColumn("rank", place).where(F.col("rank") <= ret_topk)


@step("rerank")
def rerank(df: DataFrame, *, by: str, score: str, tie: str, retriever_score: str | None = None, length: str | None = None) -> DataFrame:
    """rank by a score: a retriever's is added if it is named, and a log-probability is divided by the length if that is."""
    total = F.col(score) / F.col(length) if length else F.col(score)
    total = total + F.col(retriever_score) if retriever_score else total
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(total.desc(), tie)))


@step("verify")
def verify(df: DataFrame, *, condition: str | Column) -> DataFrame:
    """Rows whose document has been verified."""
    return df.where(condition)


@step("project")
def project(df: DataFrame, *, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns)


@step("rewrite")
def rewrite(df: DataFrame, *, method: str, question: str, response: str, gold_ids: str, gold_texts: str) -> DataFrame:
    """A row for each query that a rewriting method makes; one without a query if it makes none."""
    return df.withColumn("query", F.explode_outer(rewritten_queries(method, F.col(question), F.col(response), F.col(gold_ids), F.col(gold_texts))))


@step("read")
def read(df: DataFrame, *, template: str, question: str, passages: str, top_k: int | None = None) -> DataFrame:
    """The prompt that a reader answers."""
    return curation.with_prompt(df, template, question=question, passages=passages, top_k=top_k)


@step("minimum_risk")
def minimum_risk(df: DataFrame, *, question: str, candidate: str, similarity: Callable[[Column, Column], Column]) -> DataFrame:
    """Of several sampled answers the one most like the others."""
    return ensemble.minimum_risk(df, question, candidate, similarity)
