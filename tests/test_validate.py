import json

import pytest

from corpusloom.validate import InvalidRequest, respond, validate


@pytest.mark.parametrize(
    ("request_name", "arguments", "field"),
    [
        ("doc_index", {}, "file_path"), ("doc_index", {"file_path": " "}, "file_path"), ("doc_index", {"file_path": "a.exe"}, "file_path"), ("doc_index", {"file_path": "a.md", "source_name": "a b"}, "source_name"),
        ("doc_index", {"file_path": "a.md", "source_name": "x" * 101}, "source_name"), ("doc_search", {"query": " "}, "query"), ("doc_search", {"query": "x" * 10001}, "query"), ("doc_search", {"query": "q", "top_k": 0}, "top_k"),
        ("doc_search", {"query": "q", "top_k": 101}, "top_k"), ("doc_search", {"query": "q", "expand_to_boundary": "word"}, "expand_to_boundary"), ("doc_search", {"query": "q", "max_return_tokens": 99}, "max_return_tokens"),
        ("doc_search", {"query": "q", "sources": ["a", " "]}, "sources.1"), ("doc_chunk", {"chunk_id": "x"}, "chunk_id"), ("doc_chunk", {"chunk_id": "x:1", "neighbors": 51}, "neighbors"), ("read_document", {"file_path": "a.md", "max_chars": 99}, "max_chars"),
        ("list_tables", {"file_path": "a.pptx"}, "file_path"), ("extract_table", {"file_path": "a.xlsx", "table_index": -1}, "table_index"), ("doc_toc", {"source_name": "s", "max_depth": 5}, "max_depth"),
        ("doc_get_content", {"source_name": "s"}, None), ("doc_get_content", {"source_name": "s", "chapter": "a", "pages": "1"}, None), ("doc_get_content", {"source_name": "s", "pages": "1-"}, "pages"), ("nothing", {}, None),
    ],
)
def test_rejected(request_name, arguments, field):
    with pytest.raises(InvalidRequest) as bad:
        validate(request_name, arguments)
    assert bad.value.field == field


def test_accepted():
    assert validate("doc_search", {"query": "  q ", "sources": []}) == {"query": "q", "top_k": 5, "include_context": True, "max_return_tokens": 4096, "include_siblings": False}
    assert validate("doc_index", {"file_path": "a.MD", "source_name": "  "}) == {"file_path": "a.MD"}
    assert validate("doc_get_content", {"source_name": "s", "pages": "2-4"})["max_return_tokens"] == 8192


def test_envelope():
    def fail():
        raise InvalidRequest("no", "f")

    assert json.loads(respond(fail)) == {"error": "no", "field": "f"} and json.loads(respond(lambda: {"a": 1})) == {"a": 1}
