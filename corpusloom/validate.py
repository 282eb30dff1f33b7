"""Request validation: plain driver-side checks, first error only, and the error envelope of responses."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable

from corpusloom.schema import FILE_TYPES

SOURCE_NAME = re.compile(r"^[\w\-.]+$")
PAGES = re.compile(r"^\d+(-\d+)?$")
#: File types that the table requests accept (fixed values); the library functions also take presentations.
TABLE_EXTENSIONS = (".docx", ".pdf", ".xls", ".xlsx")
EXPANSIONS = ("section", "chapter", "subsection", "page")


class InvalidRequest(ValueError):
    """A request that breaks a rule; ``field`` names the argument."""

    def __init__(self, message: str, field: str | None = None, suggestion: str | None = None) -> None:
        super().__init__(message)
        self.field, self.suggestion = field, suggestion

    def envelope(self) -> dict:
        out = {"error": str(self), "field": self.field, "suggestion": self.suggestion}
        return {k: v for k, v in out.items() if v is not None}


class NotFound(InvalidRequest):
    """A valid request for something that the index doesn't hold."""


Check = Callable[[object, str], object]


def text(least: int = 1, most: int | None = None, strip: bool = True) -> Check:
    def check(v: object, name: str) -> str:
        if not isinstance(v, str) or len(v.strip()) < least:
            raise InvalidRequest(f"{name} is required and cannot be empty", name)
        v = v.strip() if strip else v
        if most is not None and len(v) > most:
            raise InvalidRequest(f"{name} is too long ({len(v)} characters, at most {most})", name)
        return v

    return check


def number(least: int, most: int | None = None) -> Check:
    def check(v: object, name: str) -> int:
        if isinstance(v, bool) or not isinstance(v, int):
            raise InvalidRequest(f"{name} must be an integer", name)
        if v < least or (most is not None and v > most):
            raise InvalidRequest(f"{name} must be {'at least ' + str(least) if most is None else f'between {least} and {most}'}", name)
        return v

    return check


def flag(v: object, name: str) -> bool:
    if not isinstance(v, bool):
        raise InvalidRequest(f"{name} must be true or false", name)
    return v


def file_path(extensions: tuple[str, ...]) -> Check:
    def check(v: object, name: str) -> str:
        path = text()(v, name)
        ext = os.path.splitext(path)[1].lower()
        if ext not in extensions:
            raise InvalidRequest(f"unsupported file format '{ext}'", name, f"supported: {', '.join(sorted(extensions))}")
        return path

    return check


def source_name(v: object, name: str) -> str | None:
    if not isinstance(v, str) or not v.strip():
        return None
    v = v.strip()
    if not SOURCE_NAME.match(v):
        raise InvalidRequest(f"invalid {name} '{v}': only letters, numbers, hyphens, underscores and dots", name)
    return text(1, 100)(v, name)


def names(v: object, name: str) -> list[str] | None:
    if not isinstance(v, list):
        raise InvalidRequest(f"{name} must be a list", name)
    return [text()(x, f"{name}.{i}") for i, x in enumerate(v)] or None


def one_of(*values: str) -> Check:
    def check(v: object, name: str) -> str:
        if v not in values:
            raise InvalidRequest(f"{name} must be one of {', '.join(values)}", name)
        return v

    return check


def matching(pattern: re.Pattern, hint: str) -> Check:
    def check(v: object, name: str) -> str:
        v = text()(v, name)
        if not pattern.match(v):
            raise InvalidRequest(f"invalid {name} '{v}'", name, hint)
        return v

    return check


MISSING = object()
ANY_FILE = file_path(tuple(FILE_TYPES))
TABLE_FILE = file_path(TABLE_EXTENSIONS)
#: Arguments of each request: (check, default); ``MISSING`` marks a required one.
REQUESTS: dict[str, dict[str, tuple[Check, object]]] = {
    "doc_index": {"file_path": (ANY_FILE, MISSING), "source_name": (source_name, None)},
    "doc_search": {
        "query": (text(1, 10_000), MISSING), "sources": (names, None), "top_k": (number(1, 100), 5), "include_context": (flag, True),
        "expand_to_boundary": (one_of(*EXPANSIONS), None), "max_return_tokens": (number(100, 100_000), 4096), "include_siblings": (flag, False),
    },
    "doc_list": {},
    "doc_chunk": {"chunk_id": (matching(re.compile(r".*:.*", re.S), "chunk ids look like source:position"), MISSING), "neighbors": (number(0, 50), 0)},
    "read_document": {"file_path": (ANY_FILE, MISSING), "max_chars": (number(100, 10_000_000), 100_000), "include_metadata": (flag, True)},
    "list_tables": {"file_path": (TABLE_FILE, MISSING)},
    "extract_table": {"file_path": (TABLE_FILE, MISSING), "table_index": (number(0), MISSING), "max_rows": (number(1, 100_000), None), "include_headers": (flag, True)},
    "doc_toc": {"source_name": (text(), MISSING), "max_depth": (number(1, 4), 3)},
    "doc_get_content": {
        "source_name": (text(), MISSING), "boundary_id": (text(), None), "chapter": (text(), None), "section": (text(), None),
        "pages": (matching(PAGES, "use n or a-b"), None), "max_return_tokens": (number(100, 100_000), 8192), "include_children": (flag, True),
    },
}


def validate(request: str, arguments: dict) -> dict:
    """Checked arguments with defaults, without missing ones."""
    if request not in REQUESTS:
        raise InvalidRequest(f"unknown request: {request}")
    out = {}
    for name, (check, default) in REQUESTS[request].items():
        given = arguments.get(name)
        if given is None:
            if default is MISSING:
                raise InvalidRequest(f"{name} is required", name)
            value = default
        else:
            value = check(given, name)
        if value is not None:
            out[name] = value
    if request == "doc_get_content" and sum(k in out for k in ("boundary_id", "chapter", "section", "pages")) != 1:
        raise InvalidRequest("give exactly one locator", None, "one of boundary_id, chapter, section or pages")
    return out


def respond(call: Callable[[], dict]) -> str:
    """JSON text of a call's result, or of its error."""
    try:
        out = call()
    except InvalidRequest as bad:
        out = bad.envelope()
    except FileNotFoundError as bad:
        out = {"error": str(bad), "suggestion": "check the path"}
    except PermissionError as bad:
        out = {"error": f"permission denied: {bad}"}
    except Exception as bad:
        out = {"error": f"{type(bad).__name__}: {bad}"}
    return json.dumps(out, ensure_ascii=False, indent=2, default=str)
