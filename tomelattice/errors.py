"""Errors with the codes of the knowledge base's interfaces."""

from __future__ import annotations


class KnowledgeBaseError(Exception):
    """An error with a code and a level."""

    level = "ERROR"

    def __init__(self, code: str, message: str) -> None:
        super().__init__(f"{code}: {message}")
        self.code = code


class NavigationError(KnowledgeBaseError):
    """NAV_001 ... NAV_007."""


class StorageError(KnowledgeBaseError):
    """STORAGE_001 ... STORAGE_009."""


class PromptError(KnowledgeBaseError):
    """PROMPT_001 ... PROMPT_005."""


class DocumentError(KnowledgeBaseError):
    """A document that cannot be processed."""
