"""Scan, sample, session and sink queries and the SQL that answers the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkassay.functions import values as V
from sparkassay.functions.text import extract_json
from sparkassay.operators import sampling
from sparkassay.operators.ranks import new_folder
from sparkassay.sources import catalog, files
from sparkassay.sources.session import SessionTables
from sparkassay.workload.tables import labelled_documents, rounded, table

NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def scan_csv(spark, folder):
    path = f"{new_folder(spark, 'scan')}.csv"
    table(spark, folder, "customer").write.option("header", True).csv(path)
    return files.read_file(spark, path)


def _nested_lines(spark, folder):
    """A document per line item: objects in objects, two lists of objects with unlike keys, a list
    of scalars, and a list inside a list's element."""
    lines = table(spark, folder, "lineitem")
    shipped = F.array(
        F.struct(F.col("l_partkey").alias("part"), F.col("l_quantity").alias("quantity")),
        F.struct(F.col("l_suppkey").alias("part"), F.col("l_tax").alias("quantity")),
    )
    billed = F.array(
        F.struct(
            F.col("l_linenumber").alias("line"),
            F.col("l_extendedprice").alias("price"),
            F.array("l_discount", "l_tax").alias("rates"),
        )
    )
    return lines.select(
        F.struct("l_orderkey", F.struct(shipped.alias("shipped")).alias("inner"), billed.alias("billed")).alias("order"),
        F.array("l_returnflag", "l_linestatus").alias("tags"),
    )


def scan_json_flatten(spark, folder):
    path = f"{new_folder(spark, 'scan')}.json"
    _nested_lines(spark, folder).write.json(path)
    rows = files.read_file(spark, path)
    return rows.select("part", "quantity", "line", "price", F.array_join(F.col("rates").cast("array<string>"), "|").alias("rates"))


def scan_parquet(spark, folder):
    (orders,) = files.open_file(spark, f"{folder}/orders.parquet").values()
    return orders


def read_projected(spark, folder):
    return files.read_file(spark, f"{folder}/supplier.parquet", ["s_suppkey", "s_acctbal"])


def schema_of_table(spark, folder):
    return files.table_schema(labelled_documents(spark, folder))


def filter_keys_sink(spark, folder):
    path = files.write_filtered(table(spark, folder, "part"), " p_size, p_partkey ,absent,p_brand")
    return files.read_json(spark, path)


def document_fields(spark, folder):
    """Top-level keys of the JSON texts, some of which hold a further one."""
    props = F.when(
        F.col("user_id") % 10 == 3, F.concat(F.lit('{"extra": {"deep": 1}, '), F.substring("props", 2, 1000))
    ).otherwise(F.col("props"))
    return files.document_fields(table(spark, folder, "events").select(props.alias("props")), "props")


def sample_random_rows(spark, folder):
    return sampling.sample_rows(table(spark, folder, "orders"), 25.0, key=["o_orderkey"])


def sample_fraction(spark, folder):
    return sampling.sample_fraction(table(spark, folder, "orders"), 0.1, key=["o_orderkey"])


def sample_tables(spark, folder):
    """A twentieth of three tables; events are named by two columns."""
    keys = {"customer": ["c_custkey"], "events": ["user_id", "event_id"], "documents": ["doc_id"]}
    samples = sampling.sample_tables({n: table(spark, folder, n) for n in keys}, 0.05, 7, keys)
    named = [samples[n].select(F.lit(n).alias("table_name"), F.concat_ws("/", *k).alias("named")) for n, k in keys.items()]
    return named[0].unionAll(named[1]).unionAll(named[2])


def sample_head(spark, folder):
    return sampling.sample_head(table(spark, folder, "orders"), 10, ["o_orderkey"])


def paginate(spark, folder):
    return sampling.paginate(table(spark, folder, "orders"), ["o_orderkey"], page=3, page_size=25)


def paginate_deep(spark, folder):
    """A page across blocks, far from both ends."""
    return sampling.paginate(
        table(spark, folder, "orders"), ["o_totalprice", "o_orderkey"], page=97, page_size=25, block_rows=5000
    )


def paginate_ends(spark, folder):
    """First and last page and one behind it, from one directory; a third of the order keys are missing."""
    orders = table(spark, folder, "orders").withColumn("o_custkey", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_custkey")))
    pages = sampling.PageDirectory(orders, ["o_custkey", "o_orderkey"], block_rows=1000)
    last = -(-pages.total // 40)
    out = pages.page(1, 40).unionAll(pages.page(last, 40)).unionAll(pages.page(last + 1, 40))
    return out.select("o_custkey", "o_orderkey", "row_no", "total_records", "total_pages")


def list_tables(spark, folder):
    return catalog.list_tables(spark, folder).select("table_name", "files")


FOREIGN_KEYS = (
    catalog.ForeignKey("lineitem", ("l_orderkey",), "orders", ("o_orderkey",)),
    catalog.ForeignKey("orders", ("o_custkey",), "customer", ("c_custkey",)),
    catalog.ForeignKey("nation", ("n_regionkey",), "region", ("r_regionkey",)),
    catalog.ForeignKey("documents", ("doc_id",), "labels", ("doc_id",)),
)


def table_metadata(spark, folder):
    tables = {n: table(spark, folder, n) for n in NAMES}
    return catalog.table_metadata(tables, FOREIGN_KEYS).select(
        "table_name",
        F.size("columns").alias("columns"),
        F.array_join(F.transform("columns", lambda c: c["name"]), ",").alias("names"),
        F.size("foreign_keys").alias("foreign_keys"),
        "row_count",
        (F.col("size_bytes") > 0).alias("has_size"),
    )


def dataset_size(spark, folder):
    return catalog.dataset_size(catalog.table_metadata({n: table(spark, folder, n) for n in NAMES}))


def table_sizes(spark, folder):
    return catalog.table_metadata({n: table(spark, folder, n) for n in NAMES}).select("table_name", "row_count", "size_bytes")


def scan_json_document(spark, folder):
    """Documents over many lines, one a file, that hold up to fifty suppliers each; read without saying so."""
    path = f"{new_folder(spark, 'scan')}.json"
    suppliers = table(spark, folder, "supplier").withColumn("shelf", F.floor(F.col("s_suppkey") / 50))
    rows = F.collect_list(F.struct("s_suppkey", "s_name", "s_acctbal")).alias("suppliers")
    documents = suppliers.groupBy("shelf").agg(rows).select("shelf", F.to_json(F.struct("suppliers"), {"pretty": "true"}).alias("value"))
    documents.write.partitionBy("shelf").text(path)
    return files.read_file(spark, path)


def foreign_key_check(spark, folder):
    return catalog.foreign_key_check({n: table(spark, folder, n) for n in NAMES}, FOREIGN_KEYS)


def flatten_struct(spark, folder):
    nested = table(spark, folder, "orders").select(
        "o_orderkey",
        F.struct(
            F.col("o_orderstatus").alias("status"),
            F.struct(F.col("o_totalprice").alias("total"), F.array("o_custkey").alias("customers")).alias("money"),
        ).alias("order"),
    )
    flat = V.flatten_struct(nested)
    return flat.withColumn("order.money.customers", F.col("`order.money.customers`")[0])


def serialize_rows(spark, folder):
    typed = table(spark, folder, "orders").select(
        "o_orderkey",
        F.col("o_totalprice").cast("decimal(12,2)").alias("total"),
        F.col("o_orderkey").cast("decimal(12,0)").alias("whole"),
        F.col("o_orderdate").alias("at"),
        F.col("o_orderdate").cast("date").alias("day"),
        F.encode("o_orderpriority", "UTF-8").alias("raw"),
    )
    return V.serialize_rows(typed)


def rows_as_json(spark, folder):
    typed = table(spark, folder, "orders").select(
        "o_orderkey", F.col("o_orderdate").cast("date").alias("day"), F.encode("o_orderstatus", "UTF-8").alias("raw")
    )
    return V.rows_as_json(typed, binary_as_base64=True)


def extract_json_text(spark, folder):
    """Answers around the props of every event: fenced, bare, padded with hard spaces, and none."""
    fence = F.lit("```")
    props = F.col("props")
    text = (
        F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("Sure:\n"), fence, F.lit("json\n"), props, F.lit("\n"), fence))
        .when(F.col("event_id") % 5 == 1, F.concat(F.lit("The answer is "), props, F.lit(" as asked.")))
        .when(F.col("event_id") % 5 == 2, F.concat(F.lit("  "), props, F.lit(" ")))
        .when(F.col("event_id") % 5 == 3, F.concat(F.lit("no answer for "), F.col("event_type")))
        .otherwise(F.concat(fence, F.lit("\nlist: ["), props, F.lit("]\n"), fence))
    )
    found = table(spark, folder, "events").select("event_id", extract_json(text).alias("found"))
    return found.select(
        "event_id",
        F.to_json("found").alias("json"),
        F.coalesce(F.try_variant_get("found", "$.k", "bigint"), F.try_variant_get("found", "$[0].k", "bigint")).alias("k"),
    )


def session_roundtrip(spark, folder):
    """Saved and read back: a live session gives its rows, an expired one none."""
    sessions = SessionTables(spark, new_folder(spark, "sessions"))
    orders = table(spark, folder, "orders")
    sessions.save("live", {"orders": orders})
    sessions.save("gone", {"orders": orders}, ttl_seconds=-1)
    rows = sessions.stored("live", "orders").withColumn("session", F.lit("live"))
    return rows.unionByName(sessions.stored("gone", "orders").withColumn("session", F.lit("gone"))).select(
        "session", "o_orderkey", "o_orderstatus", "o_totalprice"
    )


def _saved_customers(spark, folder):
    sessions = SessionTables(spark, new_folder(spark, "sessions"))
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("customerId"),
        F.struct(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")).alias("account"),
        "c_mktsegment",
    )
    sessions.save("s1", {"customer": customers})
    return sessions


def session_table(spark, folder):
    return _saved_customers(spark, folder).table("s1", "customer")


def session_column(spark, folder):
    return _saved_customers(spark, folder).column("s1", "customer", "account.balance")


def session_page(spark, folder):
    page = _saved_customers(spark, folder).page("s1", "customer", ["customerId"], page=4, page_size=20)
    return page.select("customerId", "c_mktsegment", "row_no", "total_records", "total_pages")


QUERIES = {
    "scan_csv": scan_csv,
    "scan_json_flatten": scan_json_flatten,
    "scan_parquet": scan_parquet,
    "read_projected": read_projected,
    "schema_of_table": schema_of_table,
    "filter_keys_sink": filter_keys_sink,
    "document_fields": document_fields,
    "sample_random_rows": sample_random_rows,
    "sample_fraction": sample_fraction,
    "sample_tables": sample_tables,
    "sample_head": sample_head,
    "paginate": paginate,
    "paginate_deep": paginate_deep,
    "paginate_ends": paginate_ends,
    "list_tables": list_tables,
    "table_metadata": table_metadata,
    "dataset_size": dataset_size,
    "table_sizes": table_sizes,
    "scan_json_document": scan_json_document,
    "foreign_key_check": foreign_key_check,
    "flatten_struct": flatten_struct,
    "serialize_rows": serialize_rows,
    "rows_as_json": rows_as_json,
    "extract_json_text": extract_json_text,
    "session_roundtrip": session_roundtrip,
    "session_table": session_table,
    "session_column": session_column,
    "session_page": session_page,
}

COLUMNS = {
    "region": "r_regionkey r_name",
    "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax "
    "l_returnflag l_linestatus l_shipdate",
    "events": "event_id ts user_id event_type value props",
    "documents": "doc_id text lang source n_chars",
    "embeddings": "vec_id embedding label",
    "pages": "page_id url html",
    "benchmark": "item_id text",
    "labels": "doc_id quality toxic",
    "conversations": "conv_id turn role text",
}
_KEYS = {"lineitem": 1, "orders": 1, "nation": 1, "documents": 1}
_DOCUMENT_COLUMNS = (
    ("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint"),
    ("quality", "int"), ("toxic", "int"),
)


def _page(order: str, page: int, size: int) -> str:
    return f"""
        SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, row_no,
               total_records, CAST(ceil(total_records / {size}) AS BIGINT) AS total_pages
        FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS row_no, count(*) OVER () AS total_records FROM orders)
        WHERE row_no > {(page - 1) * size} AND row_no <= {page * size}"""


def _drawn(name: str, key: str, limit: str, seed: int) -> str:
    """Rows of the smallest draws."""
    return f"SELECT * FROM {name} ORDER BY md5('{seed}|' || {key}) LIMIT ({limit})"


_TENTH = "SELECT greatest(1, CAST(floor(count(*) * 0.1::DOUBLE) AS BIGINT)) FROM orders"


def _sampled(name: str, key: str, named: str) -> str:
    size = f"SELECT greatest(1, CAST(floor(count(*) * 0.05::DOUBLE) AS BIGINT)) FROM {name}"
    return f"SELECT '{name}' AS table_name, {named} AS named FROM ({_drawn(name, key, size, 7)})"


#: Where the given tables lie for SQL, which has no other way to a file's size.
SQL_FOLDER = "/root/testdata/sf0.01"


def _bytes(name: str) -> str:
    return f"(SELECT CAST(sum(size) AS BIGINT) FROM read_blob('{SQL_FOLDER}/{name}.parquet'))"


def _orphans(k: catalog.ForeignKey) -> str:
    (c,), (p,) = k.columns, k.ref_columns
    return (
        f"SELECT '{k.table}({c}) -> {k.ref_table}({p})' AS key, count(*) AS rows, "
        f"count(*) FILTER (NOT EXISTS (SELECT 1 FROM {k.ref_table} r WHERE r.{p} = a.{c})) AS orphans FROM {k.table} a"
    )


ORACLE = {
    "scan_csv": "SELECT * REPLACE (CAST(c_custkey AS INTEGER) AS c_custkey) FROM customer",
    "scan_json_flatten": """
        SELECT l_partkey AS part, l_quantity AS quantity, NULL AS line, NULL AS price, NULL AS rates FROM lineitem
        UNION ALL SELECT l_suppkey, l_tax, NULL, NULL, NULL FROM lineitem
        UNION ALL SELECT NULL, NULL, CAST(l_linenumber AS BIGINT), l_extendedprice, l_discount || '|' || l_tax FROM lineitem""",
    "scan_parquet": "SELECT * FROM orders",
    "read_projected": "SELECT s_suppkey, s_acctbal FROM supplier",
    "schema_of_table": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{t}' AS data_type, {i} AS ordinal, count({c}) AS present "
        "FROM (SELECT d.*, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
        for i, (c, t) in enumerate(_DOCUMENT_COLUMNS)
    ),
    "filter_keys_sink": "SELECT CAST(p_size AS BIGINT) AS p_size, p_partkey, p_brand FROM part",
    "document_fields": """
        SELECT DISTINCT unnest(json_keys(CASE WHEN user_id % 10 = 3
          THEN '{"extra": {"deep": 1}, ' || substring(props, 2) ELSE props END)) AS field FROM events""",
    "sample_random_rows": _drawn("orders", "o_orderkey", "SELECT 25", 42),
    "sample_fraction": _drawn("orders", "o_orderkey", _TENTH, 42),
    "sample_tables": " UNION ALL ".join((
        _sampled("customer", "c_custkey", "CAST(c_custkey AS VARCHAR)"),
        _sampled("events", "user_id || '|' || event_id", "user_id || '/' || event_id"),
        _sampled("documents", "doc_id", "CAST(doc_id AS VARCHAR)"),
    )),
    "paginate_ends": """
        WITH o AS (SELECT CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END AS o_custkey, o_orderkey FROM orders),
             n AS (SELECT *, row_number() OVER (ORDER BY o_custkey NULLS FIRST, o_orderkey) AS row_no, count(*) OVER () AS total_records FROM o)
        SELECT *, CAST(ceil(total_records / 40) AS BIGINT) AS total_pages FROM n
        WHERE row_no <= 40 OR row_no > (ceil(total_records / 40) - 1) * 40""",
    "sample_head": "SELECT * FROM orders ORDER BY o_orderkey LIMIT 10",
    "paginate": _page("o_orderkey", 3, 25),
    "paginate_deep": _page("o_totalprice, o_orderkey", 97, 25),
    "list_tables": " UNION ALL ".join(f"SELECT '{n}' AS table_name, CAST(1 AS BIGINT) AS files" for n in NAMES),
    "table_metadata": " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, {len(c.split())} AS columns, '{','.join(c.split())}' AS names, "
        f"{_KEYS.get(n, 0)} AS foreign_keys, count(*) AS row_count, true AS has_size FROM {n}"
        for n, c in COLUMNS.items()
    ),
    "dataset_size": "SELECT count(*) AS tables, CAST(sum(n) AS BIGINT) AS row_count, CAST(sum(b) AS BIGINT) AS size_bytes FROM ("
    + " UNION ALL ".join(f"SELECT count(*) AS n, {_bytes(n)} AS b FROM {n}" for n in NAMES)
    + ")",
    "table_sizes": " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, count(*) AS row_count, {_bytes(n)} AS size_bytes FROM {n}" for n in NAMES
    ),
    "scan_json_document": "SELECT s_suppkey, s_name, s_acctbal FROM supplier",
    "foreign_key_check": " UNION ALL ".join(_orphans(k) for k in FOREIGN_KEYS),
    "flatten_struct": 'SELECT o_orderkey, o_orderstatus AS "order.status", o_totalprice AS "order.money.total", '
    'o_custkey AS "order.money.customers" FROM orders',
    "serialize_rows": """
        SELECT o_orderkey, o_totalprice AS total, o_orderkey AS whole,
               strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS at, strftime(o_orderdate, '%Y-%m-%d') AS day,
               o_orderpriority AS raw FROM orders""",
    "rows_as_json": """
        SELECT '{"o_orderkey":' || o_orderkey || ',"day":"' || strftime(o_orderdate, '%Y-%m-%d') || '","raw":"'
               || base64(encode(o_orderstatus)) || '"}' AS json FROM orders""",
    "extract_json_text": """
        SELECT event_id,
               CASE event_id % 5 WHEN 3 THEN NULL WHEN 4 THEN '[' || replace(props, ' ', '') || ']'
                 ELSE replace(props, ' ', '') END AS json,
               CASE WHEN event_id % 5 <> 3 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events""",
    "session_roundtrip": "SELECT 'live' AS session, o_orderkey, o_orderstatus, o_totalprice FROM orders",
    "session_table": 'SELECT c_name AS "account.name", c_acctbal AS "account.balance", c_mktsegment FROM customer',
    "session_column": 'SELECT c_acctbal AS "account.balance" FROM customer',
    "session_page": """
        SELECT c_custkey AS "customerId", c_mktsegment, row_no, total_records,
               CAST(ceil(total_records / 20) AS BIGINT) AS total_pages
        FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) AS row_no, count(*) OVER () AS total_records FROM customer)
        WHERE row_no > 60 AND row_no <= 80""",
}
