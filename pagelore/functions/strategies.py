"""Registries: strategies by name, open for additions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column

from . import chunking as C
from . import scoring as S
from . import urls as U

CHUNKERS: dict[str, Callable[[Column], Column]] = {
    "identity": C.identity_chunks, "regex": C.regex_chunks, "sentence": C.sentence_chunks, "paragraph": C.paragraph_chunks,
    "fixed": C.fixed_chunks, "words": lambda c: C.word_chunks()(c), "topic": C.topic_chunks, "hybrid": C.hybrid_chunks, "token": C.token_chunks}

URL_FILTERS: dict[str, Callable[..., Column]] = {
    "domain": U.domain_ok, "pattern": U.pattern_ok, "content_type": U.content_type_ok, "structure": U.structure_ok,
    "relevance": U.relevance_ok, "site_scope": U.site_scope_ok}

URL_SCORERS: dict[str, Callable[..., Column]] = {
    "keywords": S.keyword_score, "depth": S.depth_score, "domain": S.domain_score, "year": S.year_score}


def register(table: dict, name: str, fn: Callable) -> None:
    if name in table:
        raise ValueError(f"{name} is registered already")
    table[name] = fn
