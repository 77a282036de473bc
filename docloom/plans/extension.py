"""One registration adds a domain: chunker, encoder and prompt block."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column

from docloom import rules
from docloom.functions.domains import KNOWN
from docloom.functions.vectors import ENCODERS
from docloom.operators.chunking import CHUNKERS, Chunker, chunk_domain
from docloom.operators.render import BLOCKS, general_block


def register_domain(
    name: str,
    chunker: Chunker | None = None,
    encoder: Callable[[Column], Column] | None = None,
    block: Callable[[], Column] | None = None,
) -> None:
    """Make ``name`` a known domain; parts not given follow the general domain.

    For a built-in domain only the given parts are replaced.
    """
    if name not in KNOWN:
        KNOWN.append(name)
        CHUNKERS[name] = lambda docs, cap: chunk_domain(docs, "general", max_chunks=cap)
        BLOCKS[name] = general_block
    if chunker is not None:
        CHUNKERS[name] = chunker
    if encoder is not None:
        ENCODERS[name] = encoder
    if block is not None:
        BLOCKS[name] = block


def forget_domain(name: str) -> None:
    """Undo the registration of an added domain."""
    if name in KNOWN and name not in rules.DOMAINS:
        KNOWN.remove(name)
        for parts in (CHUNKERS, ENCODERS, BLOCKS):
            parts.pop(name, None)
