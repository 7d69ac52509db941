"""The one exception type of the package and its stable codes."""

from __future__ import annotations

CODES = (
    "INVALID_CONFIG",
    "CONFIG_READ_FAILED",
    "QUERY_EMPTY",
    "TOP_INVALID",
    "EMBEDDING_CONFIG_CHANGED",
    "EMBEDDING_COUNT_MISMATCH",
    "EMBEDDING_MISSING",
    "EMBEDDING_DIMENSION_MISMATCH",
    "EMBEDDING_SHAPE_INVALID",
    "EMBEDDING_VALUE_INVALID",
    "EMBEDDING_INPUT_INVALID",
    "EMBEDDING_FAILED",
    "MODEL_LOAD_FAILED",
    "SOURCE_NOT_FOUND",
    "INDEX_DATA_INVALID",
    "PROJECT_NOT_INITIALIZED",
)


class NavigationError(Exception):
    """An expected failure: ``code`` is for programs, the message for people."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code
