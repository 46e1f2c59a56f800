"""Settings of one run: chunking, retrieval depth and the names derived from them."""

from __future__ import annotations

from dataclasses import dataclass

# They have to equal the defaults users of the existing job run with.
RETRIEVAL_CHUNK_SIZE = 200
RETRIEVAL_CHUNK_OVERLAP = 20
RETRIEVAL_K = 3
EVALSET_CHUNK_SIZE = 350
EVALSET_CHUNK_OVERLAP = 10
EVALSET_K = 4
EMBED_MAX_BATCH = 150
TEXT_MAX_BATCH = 64
PAGE_ROWS = 5
REPLAY_LIMIT = 50
REPLAY_CONCURRENCY = 5
NO_QUESTION = "No question, skip this one"
NO_ANSWER = "No answer, skip this one"

# Dimension of the built-in hashing embedder; model embedders bring their own.
HASH_DIM = 64


@dataclass(frozen=True)
class RunConfig:
    """One retrieval set-up. ``size`` and ``overlap`` count tokens."""

    size: int = RETRIEVAL_CHUNK_SIZE
    overlap: int = RETRIEVAL_CHUNK_OVERLAP
    k: int = RETRIEVAL_K
    dim: int = HASH_DIM
    catalog: str = "spark_catalog"
    database_prefix: str = "manuals"

    def __post_init__(self) -> None:
        if not 0 <= self.overlap < self.size:
            raise ValueError("overlap must be at least 0 and below size")
        if self.k < 1:
            raise ValueError("k must be positive")

    @property
    def suffix(self) -> str:
        """Text that tells runs apart in table names."""
        return f"_chunk_{self.size}_op_{self.overlap}_k_{self.k}"

    @property
    def database(self) -> str:
        return self.database_prefix + self.suffix

    def table(self, name: str) -> str:
        """Full name of a table of this run."""
        return ".".join((self.catalog, self.database, name))
