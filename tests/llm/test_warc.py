import hashlib
import re

import pytest
from pyspark.sql import functions as F
from seriesloom.llm import warc

SCHEMA = "page_id long, url string, html string, digest string"
SAME = "x" * 100
ROWS = [(5, "http://a", SAME, "clash"), (3, "http://b\r\nWARC/1.1", SAME, None), (9, None, SAME, None), (1, "u", "short", None), (2, "u", "short", None), (4, "u", None, None), (6, "u", "", None), (7, "u", "é\r\n\r\nWARC/1.1\r\n" * 20_000, None)]


def test_round_trip_equals_brute_force(spark):
    got = {r.page_id: r for r in warc.archived(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    assert len(got) == len(ROWS)
    for page_id, _, html, _ in ROWS:
        payload = (html or "").encode()
        first = min(p for p, _, h, _ in ROWS if (h or "").encode() == payload)
        refers = first if len(payload) >= 100 and first != page_id else None
        r = got[page_id]
        assert (r.payload_bytes, r.payload_digest, r.refers_to, r.record_type, r.intact) == (len(payload), hashlib.sha256(payload).hexdigest(), refers, "revisit" if refers else "response", True)


def test_chunks_carry_data_and_digests(spark):
    pages = spark.createDataFrame(ROWS, SCHEMA)
    chunks = warc.read_archives(warc.write_archives(warc.revisits(pages)), chunk=1000).filter("page_id = 7").orderBy("chunk_no").collect()
    whole = ROWS[-1][2].encode()
    assert len(chunks) == -(-len(whole) // 1000)
    seen = b""
    for c in chunks:
        seen += c.data
        assert (c.payload_bytes, c.payload_digest) == (len(seen), hashlib.sha256(seen).hexdigest())
    assert seen == whole and chunks[-1].last


def test_empty_and_null_ids(spark):
    assert warc.archived(spark.createDataFrame([], SCHEMA)).count() == 0
    got = warc.archived(spark.createDataFrame([(None, "u", SAME, None), (None, "u", SAME, None)], SCHEMA)).collect()
    assert [r.record_type for r in got] == ["response"] * 2
    got = warc.archived(spark.createDataFrame([(None, "u", SAME, None), (1, "u", SAME, None)], SCHEMA)).collect()
    assert sorted((r.page_id is None, r.refers_to) for r in got) == [(False, None), (True, 1)]


def test_revisits_name_the_record_of_their_response(spark):
    ids, refers = {}, {}
    for r in warc.write_archives(warc.revisits(spark.createDataFrame(ROWS, SCHEMA))).collect():
        for block in re.split(rb"(?:^|\r\n\r\n)WARC/1\.1\r\n", open(r.file, "rb").read()):
            lines = dict(x.split(": ", 1) for x in block.decode(errors="replace").split("\r\n") if x.startswith(("WARC-Type", "WARC-Record-ID", "WARC-Refers-To", "X-Page-Id")))
            if "WARC-Record-ID" in lines:
                ids[lines["WARC-Record-ID"]] = lines["WARC-Type"], int(lines["X-Page-Id"])
                if "WARC-Refers-To" in lines:
                    refers[int(lines["X-Page-Id"])] = lines["WARC-Refers-To"]
    assert len(ids) == len(ROWS) and {p: ids[x] for p, x in refers.items()} == {5: ("response", 3), 9: ("response", 3)}


def expected(rows):
    first, n = {}, {}
    for page_id, _, html, _ in rows:
        n[html] = n.get(html, 0) + 1
        first[html] = page_id if html not in first else min(x for x in (first[html], page_id) if x is not None) if (first[html], page_id) != (None, None) else None
    long = lambda h: len((h or "").encode()) >= 100
    return sorted((str(p), str(first[h] if long(h) and n[h] > 1 and first[h] is not None and p != first[h] else None)) for p, _, h, _ in rows)


@pytest.mark.parametrize("rows_of_lookup", [100_000, 3])
def test_revisits_equal_brute_force_by_any_join(spark, monkeypatch, rows_of_lookup):
    """A third of all rows hold one payload; ids repeat and are null; groups of many sizes."""
    monkeypatch.setattr("seriesloom.llm.common.BROADCAST_ROWS", rows_of_lookup)
    rows = [(None if i % 97 == 0 else i % 1500, "u", SAME if i % 3 == 0 else f"{i % 211:04d}" * (30 if i % 2 else 3), None) for i in range(2000)]
    out = warc.revisits(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.page_id), str(r.refers_to)) for r in out) == expected(rows)
    for r in out:
        assert (r.html is None) == (r.refers_to is not None) and (r.html is None or hashlib.sha256(r.html.encode()).hexdigest() == r.digest)


def test_bit_tables_that_say_yes_to_all_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(warc, "with_bit", lambda rows, bits, name, out: rows.withColumn(out, F.lit(True)))
    out = warc.revisits(spark.createDataFrame(ROWS, SCHEMA)).collect()
    assert sorted((str(r.page_id), str(r.refers_to)) for r in out) == expected(ROWS) and all(r.html is not None or r.refers_to for r in out if r.page_id != 4)
