"""Opaque page cursors, bound to the query's scope and to the revisions that it read."""

from __future__ import annotations

import base64
import json

from ..errors import QueryError

VERSION = 1
KINDS = ("lookup", "search", "search-text", "references", "lang-outline", "lang-search", "lang-doc")


def scope(*parts: object) -> str:
    """The arguments that a cursor is valid for; nulls become empty."""
    return json.dumps(["" if p is None else str(p) for p in parts], separators=(",", ":"), ensure_ascii=False)


def encode(kind: str, scope: str, offset: int, revisions: list[str]) -> str:
    data = {"Version": VERSION, "Kind": kind, "Scope": scope, "Offset": offset, "Revisions": revisions}
    return base64.urlsafe_b64encode(json.dumps(data, separators=(",", ":"), ensure_ascii=False).encode()).decode().rstrip("=")


def decode(token: str | None, kind: str, scope: str, revisions: list[str]) -> int:
    """The offset; 0 without a token. Whatever doesn't fit is one error."""
    if token is None:
        return 0
    try:
        data = json.loads(base64.urlsafe_b64decode(token + "=" * (-len(token) % 4)))
        fits = (data["Version"], data["Kind"], data["Scope"], data["Revisions"]) == (VERSION, kind, scope, revisions)
        if not fits or type(data["Offset"]) is not int or data["Offset"] < 0:
            raise ValueError("another query's cursor")
        return data["Offset"]
    except (ValueError, KeyError, TypeError) as e:
        raise QueryError("invalid_cursor", "the cursor does not belong to this query") from e
