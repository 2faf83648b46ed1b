"""Archives of pages whose ids are texts."""

from plinth.llm import warc


def test_text_ids(spark, tmp_path):
    rows = [("b", "http://x/1", "same"), ("a", "http://x/2", "same"), ("c", None, None), (None, "u", "same"), ("d e", "u", "other")]
    path = f"file://{tmp_path}/w"
    warc.write_archives(spark.createDataFrame(rows, "page_id string, url string, html string"), path)
    got = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.resolve_payloads(warc.read_archives(spark, path, "string")).collect()}
    assert got == {"a": ("response", None, 4), "b": ("revisit", "a", 4), "c": ("response", None, 0), None: ("revisit", "a", 4), "d e": ("response", None, 5)}
