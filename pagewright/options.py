"""Options of an extraction."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pagewright.functions import rules


@dataclass(frozen=True)
class ExtractOptions:
    """content_digests, node_indexes: attributes of plain_content; preserve_important_links: keep links that lead on to the article;
    content_type: a type to echo instead of finding one; timeout: seconds for a page, None or 0 for none; max_buffer: characters of a page that are read, None
    for all; max_elements: pages with more are refused, 0 for no limit; extended_date: look for a date beyond JSON-LD."""

    content_digests: bool = False
    node_indexes: bool = False
    preserve_important_links: bool = False
    detect_content_type: bool = True
    content_type: int | None = None
    timeout: float | None = rules.TIMEOUT_S
    max_buffer: int | None = None
    max_elements: int = 0
    char_threshold: int = rules.CHAR_THRESHOLD
    kept_classes: tuple[str, ...] = rules.KEPT_CLASSES
    extended_date: bool = False

    def with_(self, **changes) -> ExtractOptions:
        return replace(self, **changes)
