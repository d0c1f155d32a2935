"""Named places where another implementation can stand: functions from columns or tables to the same, by kind and name.

What the engine has itself is registered here. What needs a model, a service or a file format that isn't at hand is named
with the columns it must give, and asking for it says what is missing. Nothing else in the engine depends on such a part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from tessera import constants as c
from tessera.functions import text as tx
from tessera.operators import evidence as evd
from tessera.operators import retrieval as r

#: What a part of each kind takes and gives.
CONTRACTS = {
    "tokenizer": "text column -> number of tokens", "language": "text column -> language column, share column", "embedder": "text column -> array<float> column", "retriever": "queries, documents -> item_id, doc_id, score, rank",
    "reranker": "ranking -> ranking", "vector_search": "queries, corpus, k -> query_id, id, score, rank", "generator": "context, queries -> item_id, answer, valid", "web_search": "queries -> item_id, title, url, snippet, published",
    "loader": "binary content column -> blocks", "transcriber": "binary content column -> cues (start, end, text)", "captioner": "binary content column -> text column", "ocr": "binary content column -> text column", "image_encoder": "binary content column -> array<float> column",
    "stage": "documents -> documents", "token_stream": "prompt column -> rows of text as they come",
}
#: Parts that aren't here, and why.
ABSENT = {
    ("embedder", "sentence-transformer"): "a model file", ("reranker", "cross-encoder"): "a model file", ("generator", "chat-completion"): "a network service", ("web_search", "encyclopedia"): "a network service", ("web_search", "html-search"): "a network service",
    ("web_search", "search-api"): "a network service", ("web_search", "custom-search"): "a network service", ("loader", "pdf"): "a PDF reader", ("loader", "pptx"): "an office reader", ("loader", "docx"): "an office reader", ("transcriber", "speech-int8"): "a model file",
    ("transcriber", "speech"): "a model file", ("transcriber", "hosted-captions"): "a network service", ("captioner", "image"): "a model file", ("ocr", "frames"): "an OCR engine", ("image_encoder", "image-text"): "a model file", ("token_stream", "served"): "a serving layer",
}

_PARTS: dict[tuple[str, str], Callable] = {}


def register(kind: str, name: str, part: Callable) -> None:
    if kind not in CONTRACTS:
        raise ValueError(f"no kind {kind}")
    _PARTS[kind, name] = part


def names(kind: str) -> list[str]:
    return sorted(n for k, n in _PARTS if k == kind)


def part(kind: str, name: str) -> Callable:
    """The part of that name; what isn't here is a LookupError that says what it would need."""
    if (kind, name) in _PARTS:
        return _PARTS[kind, name]
    need = ABSENT.get((kind, name))
    raise LookupError(f"{kind} {name} needs {need}; register one that maps {CONTRACTS.get(kind, '?')}" if need else f"no {kind} {name}: there are {', '.join(names(kind)) or 'none'}")


def fail_soft(kind: str, name: str, otherwise: Callable) -> Callable:
    """The part, or another where it isn't here: what a provider that is down amounts to."""
    try:
        return part(kind, name)
    except LookupError:
        return otherwise


register("tokenizer", "words", tx.chunk_tokens)
register("tokenizer", "context", tx.context_tokens)
register("language", "script", tx.script_language)
register("embedder", "hashing", r.hash_embedding)
register("embedder", "hashing-768", lambda text: r.hash_embedding(text, 768))
register("retriever", "bm25", r.bm25)
register("retriever", "set-cosine", r.set_cosine)
register("retriever", "hybrid", r.hybrid)
register("reranker", "identity", lambda ranking, k=c.TOP_K: ranking.where(F.col("rank") <= k))
register("vector_search", "exact", r.nearest)
register("generator", "extractive", lambda context, queries: evd.answers(evd.best_sentences(context, queries), queries=queries))
register("web_search", "disabled", lambda queries: queries.select("item_id", *(F.lit(None).cast("string").alias(x) for x in ("title", "url", "snippet", "published"))).limit(0))
register("stage", "identity", lambda docs: docs)
