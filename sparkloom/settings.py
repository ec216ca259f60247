"""Switches of retrieval (FLT15): which of the optional searches a deployment offers."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

#: Searches that are always there, and those that a switch adds (fixed values).
BASE = ["crawl_single_page", "smart_crawl_url", "get_available_sources", "perform_rag_query", "get_strategy_status"]
BY_SWITCH = {"agentic": ["search_code_examples"], "reranking": ["perform_rag_query_with_reranking"], "contextual": ["perform_contextual_rag_query"]}
#: Names of the variables that set the switches (fixed values).
VARIABLES = {"contextual": "USE_CONTEXTUAL_EMBEDDINGS", "agentic": "USE_AGENTIC_RAG", "reranking": "USE_RERANKING", "code_summaries": "USE_ENHANCED_CODE_SUMMARIES"}


@dataclass(frozen=True)
class Switches:
    contextual: bool = False
    agentic: bool = False
    reranking: bool = False
    code_summaries: bool = False

    def __post_init__(self) -> None:
        if self.code_summaries and not self.agentic:
            raise ValueError("code summaries need the code search")

    @classmethod
    def of(cls, values: Mapping[str, str]) -> Switches:
        """From a mapping of variables; true, 1, yes and on switch on, whatever their case."""
        return cls(**{name: values.get(v, "").strip().lower() in ("true", "1", "yes", "on") for name, v in VARIABLES.items()})

    def tools(self) -> list[str]:
        return BASE + [t for name, own in BY_SWITCH.items() if getattr(self, name) for t in own]
