"""Errors of requests, by code."""

from __future__ import annotations

# fixed values
CODES = {
    "not_found", "member_not_found", "source_not_synced", "git_timeout", "invalid_cursor", "invalid_request", "source_invalid", "framework_not_available", "invalid_regex",
    "section_not_found", "path_not_found", "document_unreadable", "unknown_source", "invalid_ref", "sync_failed",
}


class QueryError(Exception):
    def __init__(self, code: str, message: str):
        assert code in CODES, code
        super().__init__(message)
        self.code = code
