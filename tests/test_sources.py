"""Readers, catalogs, sessions and text helpers on hand-made inputs."""

import datetime
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sparkassay.functions import values as V
from sparkassay.functions.text import extract_json, metric_key
from sparkassay.operators import sampling
from sparkassay.operators.ranks import with_positions
from sparkassay.sources import catalog, files, jdbc, open_source
from sparkassay.sources.session import SessionTables


def test_flatten_documents(spark, tmp_path):
    document = {
        "name": "x",
        "a": {"b": [{"k": 1, "deep": [{"never": 1}]}, {"k": 2, "extra": "e"}], "n": 5},
        "scalars": [1, 2],
        "top": [{"k": 3}],
    }
    (tmp_path / "doc.json").write_text(json.dumps(document, indent=1))
    rows = files.read_json_rows(spark, str(tmp_path / "doc.json"), multiline=True)
    assert set(rows.columns) == {"k", "deep", "extra"}
    assert sorted(r["k"] for r in rows.collect()) == [1, 2, 3]
    with pytest.raises(ValueError, match="no list of objects"):
        files.flatten_documents(rows.select("k"))


def test_open_source(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,name,score\n1,a,0.5\n2,,1\n")
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "users.json").write_text('{"id": 1, "tags": {"x": 2}}\n{"id": 2, "late": true}\n')
    (tables := open_source(spark, "file", path=str(tmp_path / "t.csv")))
    assert tables["t.csv"].dtypes == [("id", "int"), ("name", "string"), ("score", "double")]
    users = open_source(spark, "documents", path=str(tmp_path / "c"))["users"]
    assert [r[0] for r in files.document_fields(users).collect()] == ["id", "late", "tags"]
    with pytest.raises(ValueError, match="unknown source kind"):
        open_source(spark, "ftp")
    with pytest.raises(ValueError, match="unsupported file type"):
        files.read_file(spark, "a.xlsx")
    assert files.read_file(spark, str(tmp_path / "t.csv"), ["score"]).columns == ["score"]


def test_jdbc_texts():
    assert jdbc.reader_options("jdbc:postgresql://h:1/db", user="u")["user"] == "u"
    for bad in ("jdbc:postgresql://host", "jdbc:postgresql://host/"):
        with pytest.raises(ValueError, match="database name"):
            jdbc.reader_options(bad)
    assert jdbc.sample_query('a"b', 25.7) == 'SELECT * FROM "a""b" ORDER BY RANDOM() LIMIT 25'
    assert jdbc.sample_query("t", 3).endswith("LIMIT 10")
    assert jdbc.sample_query("t", schema="s").startswith('SELECT * FROM "s"."t" ORDER BY')
    assert "'it''s'" in jdbc.stats_query("it's")


def test_serialised_values(spark):
    t = spark.createDataFrame(
        [(Decimal("1.50"), datetime.date(2024, 2, 3), datetime.datetime(2024, 2, 3, 4, 5, 6, 7), b"a\xffb")],
        "d decimal(10,2), day date, at timestamp_ntz, raw binary",
    )
    row = V.serialize_rows(t).first()
    assert tuple(row) == (1.5, "2024-02-03", "2024-02-03T04:05:06.000007", "ab")
    assert json.loads(V.rows_as_json(t, binary_as_base64=True).first()[0])["raw"] == "Yf9i"


def test_json_in_text(spark):
    texts = {
        '```json\n{"a": 1}\n```': '{"a":1}', "so ```\n[1, 2]\n``` ok": "[1,2]", 'well {"a": {"b": 2}} then': '{"a":{"b":2}}',
        " {\"a\": 3} ": '{"a":3}', "none": None, "{broken": None, "```json\nsee {\"z\": 1} here\n```": '{"z":1}',
    }
    t = spark.createDataFrame([(x,) for x in texts], "t string")
    assert [r[0] for r in t.select(F.to_json(extract_json(F.col("t")))).collect()] == list(texts.values())


def test_metric_key(spark):
    got = spark.range(1).select(metric_key(F.lit("  IoU (Intersection over Union) "))).first()[0]
    assert got == "iou_intersection_over_union"


def test_session(spark, tmp_path):
    sessions = SessionTables(spark, str(tmp_path / "s"))
    t = spark.createDataFrame([(i, (f"n{i}", i * 2)) for i in range(25)], "tId int, who struct<name:string,age:int>")
    sessions.save("s1", {"t": t, "u": t.limit(1)})
    assert sessions.names("s1") == ["t", "u"]
    assert sessions.table("s1", "t").columns == ["who.name", "who.age"]
    assert sessions.table("s1", "t", drop_primary_id=False).columns == ["tId", "who.name", "who.age"]
    assert sessions.column("s1", "t", "who.age").count() == 25
    assert set(sessions.tables("s1")) == {"t", "u"}
    page = sessions.page("s1", "t", ["tId"], page=3, page_size=10).collect()
    assert [r["tId"] for r in page] == [20, 21, 22, 23, 24]
    info = sessions.page_info("s1", "t", 3, 10).first()
    assert (info["status"], info["total_records"], info["total_pages"]) == ("success", 25, 3)
    gone = sessions.page_info("s1", "nothing").first()
    assert (gone["status"], gone["total_records"], gone["total_pages"]) == ("expired_or_not_found", 0, 0)
    with pytest.raises(ValueError, match="no table"):
        sessions.table("s1", "nothing")
    with pytest.raises(ValueError, match="at least 1"):
        sessions.page("s1", "t", ["tId"], page=0)
    sessions.save("s1", {"t": t.limit(3)}, ttl_seconds=-5)
    assert sessions.stored("s1", "t").count() == 0
    assert sessions.page_info("s1", "t").first()["status"] == "expired_or_not_found"


def test_deep_page_equals_front_page(spark):
    t = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k"), "id")
    front = sampling.paginate(t, ["k"], 40, 100).collect()
    deep = sampling.paginate(t, ["k"], 40, 100, block_rows=50).collect()
    assert sorted(front) == sorted(deep) and len(front) == 100


def test_positions_in_blocks(spark):
    t = spark.range(3000).select(F.when(F.col("id") < 2000, "hot").otherwise((F.col("id") % 5).cast("string")).alias("k"), "id")
    t = t.withColumn("k", F.when(F.col("id") % 100 != 0, F.col("k")))
    blocks = with_positions(t, ["id"], ["k"], size="n", window_rows=10)
    plain = with_positions(t, ["id"], ["k"], size="n")
    assert sorted(blocks.collect(), key=repr) == sorted(plain.collect(), key=repr)


def test_foreign_keys(spark):
    child = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "a"), (3, None)], "x int, y string")
    parent = spark.createDataFrame([(1, "a"), (3, "c")], "px bigint, py string")
    keys = [catalog.ForeignKey("c", ("x",), "p", ("px",)), catalog.ForeignKey("c", ("x", "y"), "p", ("px", "py"))]
    got = [(r["rows"], r["orphans"]) for r in catalog.foreign_key_check({"c": child, "p": parent}, keys).collect()]
    assert got == [(4, 1), (3, 1)]


def test_sample_fraction_is_exact(spark, tmp_path):
    spark.range(10_007).write.parquet(str(tmp_path / "ids"))
    ids = spark.read.parquet(str(tmp_path / "ids"))
    assert sampling.sample_fraction(ids, 0.1).count() == 1000
    assert sampling.sample_fraction(ids.limit(3), 0.1).count() == 1
    assert sampling.sample_rows(ids, 3).count() == 10


def test_samples_belong_to_the_rows(spark, tmp_path):
    t = spark.range(3000).select(F.col("id"), (F.col("id") % 7).alias("x"))
    samples = [sorted(sampling.sample_fraction(t.repartition(p), 0.05, 3).collect()) for p in (1, 6)]
    assert samples[0] == samples[1] and len(samples[0]) == 150
    assert samples[0] != sorted(sampling.sample_fraction(t, 0.05, 4).collect())
    assert sorted(sampling.sample_rows(t.repartition(5), 20, 3).collect()) == sorted(sampling.sample_rows(t, 20, 3).collect())
    # larger than what is fetched at once, and a table of mostly equal rows
    hot = spark.range(90_000).select(F.when(F.col("id") % 3 > 0, F.lit(-1)).otherwise(F.col("id")).alias("x"))
    hot.write.parquet(str(tmp_path / "hot"))
    hot = spark.read.parquet(str(tmp_path / "hot"))
    assert [sampling.sample_fraction(hot, p, 3).count() for p in (0.1, 0.5, 0.9)] == [9000, 45_000, 81_000]
    assert sampling.sample_fraction(t.limit(0)).count() == 0
    assert {k: v.count() for k, v in sampling.sample_tables({"t": t, "hot": hot}, 0.01, keys={"t": ["id"]}).items()} == {"t": 30, "hot": 900}


def test_page_directory(spark):
    rows = spark.range(2000).select((F.col("id") * 7919 % 2003).alias("k"), F.col("id").alias("a.b"))
    pages = sampling.PageDirectory(rows, ["k"], block_rows=300)
    expected = sorted(r.k for r in rows.collect())
    for page in (1, 3, 20, 21):
        got = sorted(pages.page(page, 100).collect(), key=lambda r: r.row_no)
        assert [r.k for r in got] == expected[(page - 1) * 100 : page * 100]
        assert all((r.total_records, r.total_pages) == (2000, 20) for r in got)
    assert sampling.paginate(rows.limit(0), ["k"], 1, 10).count() == 0


def test_json_that_is_no_document(spark, tmp_path):
    (tmp_path / "bad.json").write_text("{ this is\n not json\n")
    with pytest.raises(ValueError, match="multiline"):
        open_source(spark, "file", path=str(tmp_path / "bad.json"))
    (tmp_path / "one.json").write_text('{"list": [\n  {"a": 1},\n  {"a": 2}\n]\n}\n'.replace('{"a"', '{\n"a"'))
    assert sorted(r.a for r in open_source(spark, "file", path=str(tmp_path / "one.json"))["one.json"].collect()) == [1, 2]


def test_size_of_many_files_beside_another_table(spark, tmp_path):
    folder = str(tmp_path / "mixed")
    # a file for each row: a file without rows is none of the table's
    spark.range(0, 120, numPartitions=120).write.parquet(folder)
    own = spark.read.parquet(folder)
    spark.range(100_000).coalesce(1).write.mode("append").parquet(folder)
    files = sorted((p.stat().st_size for p in (tmp_path / "mixed").glob("*.parquet")), reverse=True)
    assert catalog.size_of(own).first().size_bytes == sum(files[1:])


def test_json_document_over_several_lines(spark, tmp_path):
    path = tmp_path / "one.json"
    path.write_text('[\n  {"a": 1,\n   "b": "x"},\n  {"a": 2, "b": "y"}\n]\n')
    table = open_source(spark, "file", path=str(path), multiline=True)["one.json"]
    assert sorted((r.a, r.b) for r in table.collect()) == [(1, "x"), (2, "y")]


def test_session_names_stay_inside_and_empty_tables_live(spark, tmp_path):
    store = SessionTables(spark, str(tmp_path / "sessions"))
    store.save("../a/b", {"t/../u": spark.range(0)})
    assert store.names("../a/b") == ["t/../u"]
    assert [p.name for p in tmp_path.iterdir()] == ["sessions"]
    row = store.page_info("../a/b", "t/../u").first()
    assert (row.status, row.total_records) == ("success", 0)
    store.save("s", {"old": spark.range(3)}, ttl_seconds=-1)
    assert store.page_info("s", "old").first().status == "expired_or_not_found"


def test_deep_page_keeps_nulls(spark):
    rows = spark.range(200).selectExpr("IF(id % 10 = 0, NULL, id % 7) AS k", "id")
    near = sampling.paginate(rows, ["k", "id"], 1, 40).collect()
    deep = sampling.paginate(rows, ["k", "id"], 1, 40, block_rows=10).collect()
    assert sorted(r.row_no for r in deep) == list(range(1, 41))
    assert sorted(near, key=lambda r: r.row_no) == sorted(deep, key=lambda r: r.row_no)


def test_small_blocks_are_bounded(spark):
    """Each block costs the driver a task's report, so their number does not follow the rows."""
    rows = spark.range(3000).select((F.col("id") * 7 % 3000).alias("k"))
    pages = sampling.PageDirectory(rows, ["k"], block_rows=5)
    assert len(pages.sizes) <= 200 and pages.total == 3000
    for page in (1, 38, 75):
        assert [(r.k, r.row_no) for r in pages.page(page, 40).collect()] == [(i, i + 1) for i in range(40 * (page - 1), 40 * page)]
