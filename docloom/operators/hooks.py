"""Interfaces to models and other engines, with stand-ins that need none of them."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions.text import between_tags, overlap_share, word_set


class PairScorer(Protocol):
    """Logits of (query, text) pairs. A model implements it with an iterator ``pandas_udf``."""

    def logit(self, query: Column, text: Column) -> Column: ...


class LLM(Protocol):
    """Adds the replies to prompts: ``out``, from ``system`` and ``prompt`` columns. An external
    service implements it with ``mapInPandas`` and its own retries."""

    def generate(self, df: DataFrame, system: str, prompt: str, out: str) -> DataFrame: ...


class PageExtractor(Protocol):
    """``(path, content)`` to ``(doc_id, page, block_num, par_num, line_num, word_num, text, conf)``. One that knows pages and
    tables too has ``extract(content: bytes)`` instead, see ``sources.layout.extracted``."""

    def tokens(self, files: DataFrame) -> DataFrame: ...


class LexicalScorer:
    """Stand-in for a cross-encoder: eight times the share of the query's words in the text, less 4."""

    def logit(self, query: Column, text: Column) -> Column:
        return 8 * overlap_share(word_set(query), word_set(text)) - 4


class MockLLM:
    """Echoes the start of the context between its tags."""

    def answer(self, prompt: Column) -> Column:
        context = between_tags(prompt, "context")
        found = (context != "") & ~context.startswith("(No relevant context")
        text = F.when(found, F.concat(F.lit(X.MOCK_PREFIX), F.substring(context, 1, 500))).otherwise(X.NOT_FOUND)
        return F.concat(text, F.lit(X.MOCK_SUFFIX))

    def generate(self, df: DataFrame, system: str, prompt: str, out: str) -> DataFrame:
        return df.withColumn(out, self.answer(F.col(prompt)))


def mock_usage(prompt: Column, answer: Column) -> tuple[Column, Column]:
    """Input and output tokens of the mock: a quarter of the characters."""
    quarter = lambda c: F.floor(F.length(c) / 4).cast("long")
    return quarter(prompt), quarter(F.regexp_replace(answer, r" \[MockLLMClient\]$", ""))


def usage_fallback(counted: Column, text: Column) -> Column:
    """Tokens as counted, or else a quarter of the characters, at least 1."""
    return F.when(F.coalesce(counted, F.lit(0)) > 0, counted).otherwise(
        F.greatest(F.lit(1), F.floor(F.length(F.coalesce(text, F.lit(""))) / 4))
    ).cast("long")


__all__ = ["LLM", "LexicalScorer", "MockLLM", "PageExtractor", "PairScorer", "mock_usage", "usage_fallback"]
