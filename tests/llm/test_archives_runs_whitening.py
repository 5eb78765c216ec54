"""Web archives, periodic runs and whitening: round trips and brute force, through the queries and on awkward tables."""

import base64
import gzip
import hashlib
import random
import zlib

import numpy as np
import pytest
from oracle import assert_same
from pyspark.sql import functions as F

from sparkassay.llm import periodic, warc, whitening
from sparkassay.llm.queries import ORACLE, QUERIES

# -- archives ----------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, payload string, _id int, _first int, _digest string"
CLASH = ("c", 1, 2, "d")
HOSTILE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: 2\r\n\r\nab\r\n\r\n" * 3


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_archive_query_and_sql(spark, folder, duck):
    out = QUERIES["op11_warc_salvage"](spark, folder)
    assert_same(out, duck, ORACLE["op11_warc_salvage"])


def expected_pages(rows, least=0):
    out = []
    for page_id, _, html in rows:
        same = [i for i, _, h in rows if (h or "") == (html or "")]
        known = [i for i in same if i is not None]
        first = min(known) if known and len(same) > 1 else None
        n = len((html or "").encode())
        revisit = first is not None and first != page_id and n >= least
        out.append((page_id, n, sha(html), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 5])
def test_awkward_pages(spark, least):
    rows = [
        (3, "http://a", "<p>x</p>"), (1, "b c\r\nX: y", "<p>x</p>"), (2, None, None), (5, "u", ""), (None, "u", "<p>x</p>"),
        (7, "u", HOSTILE), (7, "u", HOSTILE), (None, None, "twice"), (None, None, "twice"), (-4, "ü", "é中" * 50_000), (9, "u", "\r\n\r\n"),
        (10, "u", "\x1f\x8b\x08\x00 WARC/1.1\r\n"),
    ]
    pages = spark.createDataFrame([(*r, *CLASH) for r in rows], PAGES).repartition(3)
    got = [tuple(r) for r in warc.round_trip(pages, least).collect()]
    assert sorted(got, key=repr) == expected_pages(rows, least)


def test_empty_pages_table(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).collect() == []


def test_archive_gives_payloads_back_and_gzip_reads_it(spark, tmp_path):
    rows = [(i, f"http://h/{i % 7}", f"<p>{i % 10}</p>" * (i % 10)) for i in range(200)]
    warc.write_archive(spark.createDataFrame([(*r, *CLASH) for r in rows], PAGES).repartition(4), str(tmp_path / "a"))
    archive = warc.read_archive(spark, str(tmp_path / "a"))
    assert archive.where("kind = 'gap'").count() == 0
    stored = {r.record_id: bytes(r.payload) for r in archive.where("record_type = 'response'").collect()}
    assert sorted(stored.values()) == sorted({(f"<p>{i}</p>" * i).encode() for i in range(10)})
    assert {r.refers_to for r in archive.where("record_type = 'revisit'").collect()} <= stored.keys()
    plain = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "a").glob("part-*"))
    assert plain.count(b"WARC/1.1\r\nWARC-Type") == 200


def _records(n, more=""):
    return [warc.record(i, None, f"http://h/{i}", (f"page {i} " * 200 + more).encode()) for i in range(n)]


def _ids(found):
    return [int(f.headers["warc-record-id"].split(":")[2]) for f in found if f.reason is None]


def _whole(data, found):
    """Records and gaps follow each other; between them stand only separators."""
    at = 0
    for f in found:
        if f.start < at:  # a further record of the same member
            continue
        assert data[at : f.start] == warc.SEPARATOR * ((f.start - at) // len(warc.SEPARATOR))
        at = f.end
    assert data[at:] in (b"", warc.SEPARATOR)


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_after_damage(packed):
    records = _records(8, HOSTILE if packed else "")
    parts = [warc.member(r) + warc.SEPARATOR if packed else r for r in records]
    starts = np.cumsum([0, *map(len, parts)])
    whole = b"".join(parts)
    assert _ids(warc.salvage(whole)) == list(range(8)) and not [f for f in warc.salvage(whole) if f.reason]
    spoiled = bytearray(whole)
    spoiled[starts[2] + len(parts[2]) // 2] ^= 0xFF  # a byte within a record
    spoiled[starts[5] + 1] ^= 0xFF  # the start of another
    found = list(warc.salvage(bytes(spoiled)))
    assert _ids(found) == [0, 1, 3, 4, 6, 7]
    gaps = [(f.start, f.reason) for f in found if f.reason]
    assert [g[0] for g in gaps] == [starts[2], starts[5]] and all(g[1] for g in gaps)
    _whole(bytes(spoiled), found)
    # cut off, bytes lost in the middle, junk before, between and after
    cut = whole[: starts[7] + 30]
    assert _ids(warc.salvage(cut)) == list(range(7)) and list(warc.salvage(cut))[-1].end == len(cut)
    lost = whole[: starts[3] + len(parts[3]) // 2] + whole[starts[4] + 20 :]
    assert _ids(warc.salvage(lost)) == [0, 1, 2, 5, 6, 7]
    junk = b"junk\x1f\x8b\x08 junk\n" + whole[: starts[4]] + b"\x1f\x8b\x08" * 40 + b"\nWARC/1.1\r\nbad\n" + whole[starts[4] :] + b"tail"
    found = list(warc.salvage(junk))
    assert _ids(found) == list(range(8)) and [f.end - f.start for f in found if f.reason] == [13, 135, 4]
    assert list(warc.salvage(b"")) == []


def test_members_of_several_records_and_mixed_files():
    records = _records(6)
    data = warc.member(records[0] + records[1]) + records[2] + warc.member(b"".join(records[3:5])) + records[5]
    assert _ids(warc.salvage(data)) == list(range(6))


def test_digests_are_checked():
    one = warc.record(1, None, None, b"payload")
    assert [f.reason for f in warc.salvage(one.replace(b"payload", b"payl0ad"))] == ["block digest differs"]
    longer = one.replace(b"Content-Length: 7\r\n\r\npayload", b"Content-Length: 7\r\n\r\npayloads")
    assert [f.reason for f in warc.salvage(longer)] == ["length does not fit"]


def test_records_inside_a_damaged_payload_are_no_records():
    data = bytearray(b"".join(_records(3, HOSTILE)))
    data[len(data) // 2 - 100] ^= 1
    found = list(warc.salvage(bytes(data)))
    assert _ids(found) == [0, 2] and [f.reason for f in found if f.reason] == ["block digest differs"]


def test_damaged_files_in_spark(spark, tmp_path):
    records = _records(3)
    (tmp_path / "a.bin").write_bytes(warc.member(records[0]) + b"???" + warc.member(records[1]))
    (tmp_path / "b.bin").write_bytes(records[2][:-9])
    archive = warc.read_archive(spark, str(tmp_path))
    gaps = {(r.path[-5:], r.offset, r.length) for r in warc.quarantined(archive).collect()}
    assert gaps == {("a.bin", len(warc.member(records[0])), 3), ("b.bin", 0, len(records[2]) - 9)}
    assert sorted(r.page_id for r in warc.page_records(archive).collect()) == [0, 1]


# -- runs --------------------------------------------------------------------------------------


def brute_runs(w):
    """Every lag, word by word; a stretch of a smaller period is not counted again."""
    out, seen = [], set()
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            run = (i, j - i + q)
            if run[1] >= max(6, 4 * q) and run not in seen:
                seen.add(run)
                out.append((*run, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    best = min(((-r[1], r[0], r[2]) for r in runs), default=None)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    head = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
    texts = "".join(f"{s},{length},{q}\n" for s, length, q in runs), " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *head, *(hashlib.sha256(t.encode()).hexdigest() for t in texts))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def random_words(draw):
    k, words = draw.choice([1, 2, 2, 3, 5, 20]), []
    while len(words) < draw.randint(0, 150):
        turn = [str(draw.randrange(k)) for _ in range(draw.randint(1, 14))]
        again = len(turn) * draw.randint(1, 7) - draw.randint(0, len(turn) - 1)
        words += (turn * 7)[:again] if draw.random() < 0.6 else turn
    return words


def test_runs_against_every_lag():
    draw = random.Random(5)
    texts = [random_words(draw) for _ in range(1500)]
    assert sum(len(brute_runs(t)) for t in texts) > 1000
    for t in texts:
        assert periodic.runs_of(t) == brute_runs(t)


def test_long_periods_and_edges():
    draw = random.Random(6)
    for period, length in [(64, 300), (100, 400), (100, 399), (257, 1030), (700, 2801)]:
        turn = [str(draw.randrange(10**9)) for _ in range(period)]
        words = ["a", "b"] + (turn * 5)[:length] + ["c"]
        assert periodic.runs_of(words) == ([(2, length, period)] if length >= 4 * period else [])
    assert periodic.runs_of(["x"] * 200_000) == [(0, 200_000, 1)]
    assert periodic.runs_of(["a", "a", "b", "b"] * 20_000) == [(0, 80_000, 4)]
    assert periodic.runs_of(["x"] * 5) == [] and periodic.runs_of(["x"] * 6) == [(0, 6, 1)]
    assert periodic.runs_of("a b a b a b a".split()) == [] and periodic.runs_of("a b a b a b a b".split()) == [(0, 8, 2)]


def test_segments_are_stable():
    draw = random.Random(7)
    for _ in range(200):
        words = np.array([int(w) for w in random_words(draw)] or [0])
        for start, end in periodic.segments(words):
            assert np.unique(words[start:end], return_counts=True)[1].min() >= 4


def test_runs_query(spark, folder):
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op12_periodic_runs"](spark, folder).select(*COLUMNS).collect()
    assert sorted(map(tuple, got)) == sorted(brute_row(r.doc_id, r.text) for r in rows)


def test_runs_of_awkward_documents(spark):
    draw = random.Random(8)
    texts = [None, "", " \t\n", "one", "a a a a a a a a a a a a", "x\x00 " * 8, "z " * 40_000, " a b" * 9]
    texts += [" ".join(random_words(draw)) for _ in range(120)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "one"), (6, "z " * 40_000), (None, "q q q q q q"), (None, None)]
    schema = "doc_id long, text string, runs string, n_words int, _b int, collapsed string, _r int"
    docs = spark.createDataFrame([(*r, "c", 1, 2, "d", 3) for r in rows], schema).repartition(3)
    texts = docs.select("doc_id", periodic.rewritten(F.col("doc_id"), F.col("text")).alias("text"), "runs", "_b")
    got = periodic.digests(periodic.find_runs(texts)).select(*COLUMNS).collect()
    key = lambda r: repr(r)
    long = {6}  # too long for the brute force unless it is one run
    short = [r for r in rows if r[0] not in long]
    assert sorted((tuple(r) for r in got if r.doc_id not in long), key=key) == sorted((brute_row(*r) for r in short), key=key)
    assert [(r.start, r.length, r.period) for r in got if r.doc_id in long] == [(0, 40_000, 1)] * 2
    assert periodic.digests(periodic.find_runs(docs.where("doc_id < 0"))).collect() == []
    real = periodic.find_runs(docs).where("doc_id = 5").first()
    assert (real.n_words, real.runs[0].asDict(), real.collapsed) == (8, {"start": 0, "length": 8, "period": 1}, "x\x00")


# -- whitening ---------------------------------------------------------------------------------


def expected_whitening(ids, vectors, components=32):
    x = np.floor(64 * np.asarray(vectors, np.float64)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    y = (n * x - sums) / n
    values, axes = np.linalg.eigh(y.T @ y / n)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(components, int((values > 1e-12 * values[0]).sum()))
    return x, n, ((n * x - sums) ** 2).sum(axis=1), y @ axes[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum(), k


def check_whitening(rows, ids, vectors):
    _, n, deviations, whitened, explained, k = expected_whitening(ids, vectors)
    assert len(rows) == len(ids) * k
    got = {(r.vec_id, r.component): r for r in rows}
    table = np.array([[got[i, c + 1].whitened for c in range(k)] for i in ids])
    signs = np.sign((table * whitened).sum(axis=0))
    assert np.abs(table - whitened * signs).max() < 1e-8
    for i, d in zip(ids, deviations, strict=True):
        assert got[i, 1].deviation == d and got[i, k].n == n
    assert np.allclose([got[ids[0], c + 1].explained for c in range(k)], explained, rtol=1e-10)
    errors = {r.identity_error for r in rows}
    assert len(errors) == 1 and 0 <= errors.pop() < 1e-9


def test_whitening_query(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()
    check_whitening(QUERIES["op13_whitening"](spark, folder).collect(), [r.vec_id for r in rows], [r.embedding for r in rows])


VECTORS = "vec_id long, embedding array<float>, _id int, x string, n long, component string"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, 1, "c", 2, "d") for i, v in rows], VECTORS).repartition(4)


def test_whitening_of_awkward_vectors(spark):
    draw = np.random.default_rng(3)
    good = [(i, [float(np.float32(e)) for e in draw.normal(size=6) * [9, 5, 3, 2, 1, 1]]) for i in range(300)]
    good += [(1000 + i, good[0][1]) for i in range(150)]  # a third of all rows are equal
    bad = [(1, None), (2, []), (3, [1.0, None] + [1.0] * 4), (4, [float("nan")] * 6), (5, [float("inf")] + [0.0] * 5), (6, [1.0, 2.0]), (None, None)]
    rows = whitening.whiten(vectors_of(spark, good + bad)).collect()
    check_whitening(rows, [i for i, _ in good], [v for _, v in good])


def test_whitening_without_spread(spark):
    assert whitening.whiten(vectors_of(spark, [])).collect() == []
    assert whitening.whiten(vectors_of(spark, [(1, None)])).collect() == []
    assert whitening.whiten(vectors_of(spark, [(1, [1.0, 2.0])])).collect() == []
    assert whitening.whiten(vectors_of(spark, [(i, [1.0, 2.0]) for i in range(9)])).collect() == []
    # rank one in three dimensions; a NULL id stays
    line = whitening.whiten(vectors_of(spark, [(None if i == 2 else i, [float(i), 0.0, 2.0 * i]) for i in range(5)])).collect()
    assert {r.component for r in line} == {1} and sorted(str(r.vec_id) for r in line) == ["0", "1", "3", "4", "None"]


def test_filter_certifies_close_eigenvalues(spark):
    """A flat spectrum: the wanted part ends inside a crowd of nearly equal eigenvalues."""
    draw = np.random.default_rng(4)
    x = draw.normal(size=(400, 40)) * np.linspace(1.1, 1.0, 40)
    blocks, dims = whitening.pack(vectors_of(spark, [(i, [float(e) for e in r]) for i, r in enumerate(x)]))
    n, sums = whitening._counted(blocks, dims)
    cov = whitening.Covariance(blocks, dims, n, sums)
    values, vectors, share = whitening.eigenpairs(cov, 8, width=10)
    whole = np.floor(64 * x.astype(np.float32).astype(np.float64)).astype(np.int64) + 1_000_000
    y = (n * whole - whole.sum(axis=0)) / n
    exact, axes = np.linalg.eigh(y.T @ y / n)
    assert share <= whitening.TOLERANCE * 10 and np.allclose(values, exact[::-1][:8], rtol=1e-12)
    assert np.abs(np.abs((vectors * axes[:, ::-1][:, :8]).sum(axis=0)) - 1).max() < 1e-10
    assert whitening.lower_bound(cov) <= exact[0] * 1.0001


def test_whitening_is_the_same_at_every_layout(spark):
    draw = np.random.default_rng(9)
    table = vectors_of(spark, [(i, [float(e) for e in draw.normal(size=12)]) for i in range(300)])
    one, many = (
        {(r.vec_id, r.component): (r.deviation, abs(r.whitened)) for r in whitening.whiten(table.repartition(p)).collect()} for p in (1, 7)
    )
    assert one.keys() == many.keys() and len(one) == 300 * 12
    assert all(one[k][0] == many[k][0] and abs(one[k][1] - many[k][1]) < 1e-8 for k in one)
