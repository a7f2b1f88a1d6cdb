import hashlib
import zlib

from pyspark.sql import functions as F
from seriesloom.llm import media

SCHEMA = "doc_id long, text string, digest string"
ROWS = [(1, "a" * 64, "x"), (2, "a" * 65, None), (3, None, None), (4, "", None), (5, "é😀\n" * 5_000, None), (5, "é😀\n" * 5_000, None), (None, "x", None)]


def test_payloads_equal_brute_force(spark):
    got = media.media_columns(spark.createDataFrame(ROWS, SCHEMA)).collect()
    assert len(got) == len(ROWS)
    for doc_id, text, _ in ROWS:
        raw = (text or "").encode()
        size = max(64, -(-len(raw) // 64) * 64)
        payload = raw.ljust(size, b"\0")
        for r in [r for r in got if r.doc_id == doc_id]:
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), size, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
            assert r.media_sha256 == hashlib.sha256(media.encode(payload)).hexdigest() and r.media_bytes == len(media.encode(payload))
            assert r.caption == f"{size} samples"
    assert media.media_columns(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sequences_keep_order_and_captions(spark):
    html = '<p>one<img src="sha256:aa" alt="first"><script>no()</script> two</p><figure><figcaption>third &amp; last</figcaption></figure><figure><img src="sha256:bb"><figcaption>a <b>caption</b></figcaption></figure>tail'
    pages = spark.createDataFrame([(1, html, "clash"), (2, None, None), (3, "", None)], "id long, html string, items string")
    got = {r.id: r["items"] for r in media.sequences(pages).collect()}
    assert [(x.position, x.kind, x.text, x.digest, x.caption) for x in got[1]] == [
        (0, "text", "one", None, None),
        (1, "media", None, "aa", "first"),
        (2, "text", "two", None, None),
        (3, "media", None, "bb", "a caption"),
        (4, "text", "tail", None, None),
    ]
    assert got[2] == [] and got[3] == []


def test_join_by_digest_keeps_unresolved_references(spark):
    pages = spark.createDataFrame([(1, '<img src="sha256:aa"><img src="sha256:zz"><img src="http://x">')], "id long, html string")
    refs = media.references(media.sequences(pages), ["id"])
    store = spark.createDataFrame([("aa", b"1"), ("aa", b"1"), ("bb", b"2")], "digest string, stored binary")
    got = media.resolve(refs, store).orderBy("position").collect()
    assert [(r.position, r.digest, bytes(r.stored) if r.stored else None) for r in got] == [(0, "aa", b"1"), (1, "zz", None), (2, None, None)]
    assert media.resolve(refs.filter(F.lit(False)), store).count() == 0


def test_pages_keep_columns_of_any_name(spark):
    from odd_columns import as_rows, with_odd_columns

    pages = with_odd_columns(spark.createDataFrame([(1, "<p>one <img src='media:ab'> two"), (2, None), (3, "")], "page_id long, html string"), "page_id")
    out = media.sequences(pages)
    assert out.columns == [*pages.columns, "items"] and as_rows(out.drop("items")) == as_rows(pages)
    assert out.filter("size(items) = 0").count() == 2
    assert media.sequences(pages.limit(0)).count() == 0
