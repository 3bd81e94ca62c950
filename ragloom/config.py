"""Parameters of the retrieval pipeline."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    parent_chars: int = 1000
    parent_overlap: int = 100
    child_chars: int = 300
    child_overlap: int = 30
    split_tokens: int = 300
    split_tokens_overlap: int = 30
    per_retriever: int = 20
    min_score: float = 0.0
    rrf_k: int = 60
    top_children: int = 8
    top_parents: int = 3
    tool_k: int = 5
    dims: int = 64
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    feedback: bool = False
    feedback_chunks: int = 5
    feedback_terms: int = 10
    feedback_weight: float = 0.3
    variants: int = 1
    rerank: bool = True
    router_enabled: bool = True
    llm_fallback: bool = True
    simple_max_chars: int = 15
    complex_min_chars: int = 60
    agentic: bool = True
    memory_main: int = 20
    memory_small: int = 10


DEFAULT = Config()


@dataclass(frozen=True)
class Assistant:
    """A declared assistant: its system text, how a user message is put (``{{message}}``), and what it may use."""

    system: str | None = None
    user: str = "{{message}}"
    memory: int | None = None
    memory_per_key: bool = True
    retrieval: bool = False
    tools: tuple[str, ...] = ()


#: Assistants by name: the chat entry's two, ones with a memory of their own per key (by a system text, and by a fixed request before
#: each message), and one whose memory all callers share. ``Engine.converse`` puts their prompts together.
ASSISTANTS = {
    "main": Assistant(memory=DEFAULT.memory_main, retrieval=True, tools=("book", "cancel", "available")),
    "agentic": Assistant(memory=DEFAULT.memory_main, tools=("search", "book", "cancel", "available", "files")),
    "separate": Assistant(system="You answer in one sentence. Today is {{current_date}}.", memory=DEFAULT.memory_small, tools=("add", "root")),
    "friend": Assistant(user="你是我的好朋友，请用粤语回答问题。{{message}}", memory=DEFAULT.memory_small),  # fixed value
    "shared": Assistant(memory=DEFAULT.memory_small, memory_per_key=False),
}
