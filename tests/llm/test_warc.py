import hashlib

from corpuskit.llm import warc


def test_round_trip_and_revisits(spark, tmp_path):
    long = "<p>" + "ä" * 100 + "\r\n\r\nWARC/1.1\r\n</p>"
    rows = [(5, "http://a/\r\nx", long), (3, "http://b/", long), (9, None, long), (1, "u", "short"), (2, "v", "short"), (4, "w", None), (6, "x", ""), (3, "http://b/", long), (None, "n", long), (7, "y", long + "!")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'c' AS page", "0 AS payload")
    warc.write_archives(pages, str(tmp_path / "w"), archive_bytes=500)
    got = warc.read_archives(spark, str(tmp_path / "w")).collect()
    assert len(got) == len(rows)
    for r in got:
        html = next(h or "" for i, _, h in rows if i == r.page_id)
        assert r.payload_bytes == len(html.encode()) and r.payload_digest == hashlib.sha256(html.encode()).hexdigest()
        assert r.payload == (html.encode() if r.record_type == "response" else None)
    kinds = sorted((str(r.page_id), r.record_type, r.refers_to) for r in got)
    assert kinds == sorted(
        [("5", "revisit", 3), ("3", "response", None), ("9", "revisit", 3), ("1", "response", None), ("2", "response", None), ("4", "response", None), ("6", "response", None), ("3", "response", None), ("None", "revisit", 3), ("7", "response", None)],
        key=str,
    )


def test_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"))
    assert warc.read_archives(spark, str(tmp_path / "w")).count() == 0
