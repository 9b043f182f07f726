"""Documents that add nothing are named with their reason."""

from tests.test_import_scan import EXPORT, record, write
from tracklore.plans.import_history import load_documents
from tracklore.sources import history_json
from tracklore.sources.warehouse import Warehouse


def test_reasons_and_counts(spark, tmp_path, monkeypatch):
    write(tmp_path, "good.json", EXPORT)
    write(tmp_path, "none.json", [])
    write(tmp_path, "bad[1].json", "[{")
    write(tmp_path, "more.json", "[] []")
    write(tmp_path, "empty.json", "")
    write(tmp_path, "object.json", '{"a": []}')
    write(tmp_path, "null.json", "null")
    (tmp_path / "latin.json").write_bytes(b'["\xe9"]')
    write(tmp_path, "large.json", [record()] * 200)
    monkeypatch.setattr(history_json, "MAX_DOCUMENT_BYTES", (tmp_path / "large.json").stat().st_size - 1)
    documents = history_json.read_documents(spark, str(tmp_path), "*.json")
    got = {r.file_name: r.skipped for r in history_json.skipped_documents(documents).collect()}
    assert got == {
        "bad[1].json": "not_json", "more.json": "not_json", "empty.json": "not_json", "object.json": "not_array",
        "null.json": "not_array", "latin.json": "not_utf8", "large.json": "too_large",
    }
    records = history_json.scan_history(documents)
    assert "skipped" not in records.columns and {r.file_name for r in records.collect()} == {"good.json"}
    counts = load_documents(Warehouse(spark, str(tmp_path / "w")), documents)
    assert counts["documents_skipped"] == 7 and counts["records_read"] == records.count() > counts["records_rejected"] > 0
    only = history_json.read_documents(spark, str(tmp_path / "large.json"))
    assert [r.skipped for r in history_json.skipped_documents(only).collect()] == ["too_large"]
