import gzip
import io

from concord.llm import warc

SCHEMA = "page_id long, url string, html string, archive string, sha string"


def expected(rows, least=0):
    first = {}
    for i, _, h in rows:
        first[h or ""] = max(first.get(h or "", -1), -1 if i is None else i)
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        again = len(p) >= least and first[h or ""] != (-1 if i is None else i)
        out.append((-1 if i is None else i, len(p), warc.digest(p), "revisit" if again else "response", first[h or ""] if again else -1))
    return sorted(out)


def result(df):
    return sorted((-1 if r.page_id is None else r.page_id, r.payload_bytes, r.payload_digest, r.record_type, -1 if r.refers_to is None else r.refers_to) for r in df.collect())


def test_round_trip(spark, monkeypatch):
    rows = [(n, f"http://x/{n}", ["<p>é</p>", None, "", "a\r\n\r\nWARC/1.1\r\n\r\n", f"own {n}", "x" * 300_000][n % 6]) for n in range(40)]
    rows += [(None, None, "<p>é</p>"), (7, "http://again", "a\r\nb"), (7, "http://again", "a\r\nb")]
    df = spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA)
    assert result(warc.read(warc.write(df))) == expected(rows)
    assert result(warc.read(warc.write(df, least_bytes=5))) == expected(rows, 5)
    assert warc.read(warc.write(df.limit(0))).count() == 0


def test_normaliser_takes_one_stream_or_many_and_indexes_each_record():
    raw = [warc.record(n, f"u{n}", b"payload %d" % n * n, None, False) for n in range(50)]
    for source in (gzip.compress(b"".join(raw)), b"".join(map(gzip.compress, raw))):
        content, index = warc.normalise(io.BytesIO(source))
        assert [gzip.decompress(content[a : a + b]) for a, b in index] == raw
        assert gzip.decompress(content) == b"".join(raw)
