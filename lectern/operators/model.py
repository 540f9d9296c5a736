"""The registry of models that answer; a real one is a pandas function over (question, context)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from .assemble import extract_answers

MODELS: dict[str, Callable[[DataFrame], DataFrame]] = {"extractive": extract_answers}


def register(name: str, answer: Callable[[DataFrame], DataFrame]) -> None:
    """answer: contexts(query_id, question, context) -> query_id, answer."""
    MODELS[name] = answer


def model(name: str = "extractive") -> Callable[[DataFrame], DataFrame]:
    if name not in MODELS:
        raise ValueError(f"model must be one of {sorted(MODELS)}")
    return MODELS[name]
