"""Settings as frozen dataclasses, passed explicitly to the operators."""

from __future__ import annotations

from dataclasses import dataclass

# The separator lists, in order of preference.
DEFAULT_SEPARATORS = ("\n\n", "\n", ". ", "! ", "? ", " ")
MARKDOWN_SEPARATORS = (
    ". ", "! ", "? ", ".\n", "!\n", "?\n", "\n\n",
    "\n### ", "\n## ", "\n# ", "\n* ", "\n- ", "\n",
)
SEPARATOR_PROFILES = {"default": DEFAULT_SEPARATORS, "markdown": MARKDOWN_SEPARATORS}

# The declared file types and the embedding prompts.
SUPPORTED_TYPES = ("txt", "md", "pdf", "csv", "json")
PROMPT_PREFIXES = {"document": "search_document: ", "query": "search_query: "}


@dataclass(frozen=True)
class ChunkingConfig:
    chunk_size: int = 1000
    chunk_overlap: int = 200
    separators: tuple[str, ...] = DEFAULT_SEPARATORS
    unit: str = "chars"                 # "chars" (code points) or "bytes"
    remove_extra_whitespace: bool = True
    max_file_size_mb: float = 100
    min_extracted_bytes: int = 50
    drop_empty: bool = False            # also drop the one empty chunk of a blank document

    def __post_init__(self) -> None:
        if self.unit not in ("chars", "bytes"):
            raise ValueError("unit must be 'chars' or 'bytes'")
        if self.chunk_size < 1 or self.chunk_overlap < 0:
            raise ValueError("chunk_size must be positive and chunk_overlap not negative")

    @property
    def max_file_bytes(self) -> int:
        return int(self.max_file_size_mb * 1024 * 1024)


@dataclass(frozen=True)
class RetrievalConfig:
    metric: str = "inner_product"       # or "l2"
    max_context_chunks: int = 5
    similarity_threshold: float = 0.7
    max_tokens: int = 2048
    nlist: int = 100
    nprobe: int = 16
    # Most bytes of query vectors that are shipped to every Python worker.
    # Larger query sets are joined tile by tile instead.
    broadcast_bytes: int = 64 * 1024 * 1024


@dataclass(frozen=True)
class IngestConfig:
    path_buckets: int = 64              # of the document list, fixed for a folder
    compact_every: int = 16             # batches whose lists are merged at once


@dataclass(frozen=True)
class ExportConfig:
    include_metadata: bool = True
    include_timestamps: bool = True
    include_sources: bool = True


@dataclass(frozen=True)
class SessionConfig:
    max_sessions: int = 100
    max_session_age_days: int = 30


@dataclass(frozen=True)
class SavePolicy:
    """Which tables each operation writes (K7)."""

    on_document_add: bool = True
    on_chat_message: bool = False

    def tables(self, operation: str) -> tuple[str, ...]:
        if operation in ("manual_save", "close"):
            return ("metadata", "chat", "chunks", "index")
        if operation == "document_add":
            return ("metadata", "chunks") if self.on_document_add else ()
        if operation == "chat_message":
            return ("metadata", "chunks") if self.on_chat_message else ()
        raise ValueError(f"unknown operation {operation!r}")
