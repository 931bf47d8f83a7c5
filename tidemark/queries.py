"""The registered queries of the table library, each with DuckDB SQL written independently (plain joins, no hashes).

A query gets one copy of each table; where it needs a second side, it derives it: rows with key % 10 = 3 are missing, rows with
key % 7 = 0 have another value, and rows with key % 50 = 0 exist a second time under another key.
"""

from __future__ import annotations

import datetime
import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import canonical, staging, text
from .functions.canonical import cell
from .operators import apply, diff, digests, mask, project, stored, verify
from .operators.mask import MaskRule
from .operators.project import Filter
from .plans import report, runs, schema
from .plans import sql as free_sql
from .plans.report import TableSelection
from .sources import databases, readers, writers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# Two sides of one table -----------------------------------------------------------------------------------------------------

FAR = 1_000_000_000
CHANGES = {"customer": ("c_custkey", "c_acctbal"), "orders": ("o_orderkey", "o_totalprice"), "part": ("p_partkey", "p_retailprice"), "events": ("event_id", "value"), "supplier": ("s_suppkey", "s_acctbal")}
COLUMNS = {
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment", "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice", "events": "event_id ts user_id event_type value props", "supplier": "s_suppkey s_name s_nationkey s_acctbal",
}


def drifted(df: DataFrame, key: str, value: str) -> DataFrame:
    k = F.col(key)
    base = df.where(k % 10 != 3).withColumn(value, F.when(k % 7 == 0, F.col(value) + 1).otherwise(F.col(value)))
    return base.unionByName(df.where(k % 50 == 0).withColumn(key, k + FAR))


def sides(spark: SparkSession, d: str, name: str) -> tuple[DataFrame, DataFrame, list[str]]:
    source = table(spark, d, name)
    return source, drifted(source, *CHANGES[name]), [CHANGES[name][0]]


def drift_sql(name: str) -> str:
    key, value = CHANGES[name]
    cols = COLUMNS[name].split()
    base = ", ".join(f"CASE WHEN {key} % 7 = 0 THEN {c} + 1 ELSE {c} END AS {c}" if c == value else c for c in cols)
    far = ", ".join(f"{c} + {FAR} AS {c}" if c == key else c for c in cols)
    return f"(SELECT {base} FROM {name} WHERE {key} % 10 <> 3 UNION ALL SELECT {far} FROM {name} WHERE {key} % 50 = 0)"


def classes_sql(name: str, source: str | None = None, target: str | None = None) -> str:
    """key, change_type of every key, by plain comparison of columns."""
    key = CHANGES[name][0]
    rest = [c for c in COLUMNS[name].split() if c != key]
    differ = " OR ".join(f"s.{c} IS DISTINCT FROM t.{c}" for c in rest)
    return (f"(SELECT coalesce(s.{key}, t.{key}) AS {key}, CASE WHEN t.{key} IS NULL THEN 'insert' WHEN s.{key} IS NULL THEN 'delete' WHEN {differ} THEN 'update' ELSE 'same' END AS change_type "
            f"FROM {source or name} s FULL OUTER JOIN {target or drift_sql(name)} t ON s.{key} = t.{key})")  # fmt: skip


SUMMARY = "count(*) FILTER (change_type = 'insert') AS inserted, count(*) FILTER (change_type = 'update') AS updated, count(*) FILTER (change_type = 'delete') AS deleted, count(*) FILTER (change_type = 'same') AS same"


# Scans, keys, pages ---------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders")
def scan_project(spark, d):
    return readers.scan(spark, f"{d}/orders.parquet", ["o_orderkey", "o_totalprice"])


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def jdbc_round_trip(spark, d):
    """Written in batches, read by key ranges. The database is the one that the session names in spark.tidemark.jdbc.url; where it names none, one
    inside this process, which executors of a cluster don't see."""
    url = spark.conf.get("spark.tidemark.jdbc.url", f"jdbc:derby:memory:t{uuid.uuid4().hex};create=true")
    driver = {"driver": spark.conf.get("spark.tidemark.jdbc.driver", "org.apache.derby.iapi.jdbc.AutoloadedDriver")}
    name = f"customer_{uuid.uuid4().hex[:8]}"
    types = {"createTableColumnTypes": "c_name varchar(64), c_mktsegment varchar(32)"}
    writers.write_jdbc(table(spark, d, "customer"), url, name, partitions=4, properties=driver | types)
    return readers.jdbc(spark, url, name, "c_custkey", 4, driver)


@query(f"""SELECT * FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT * FROM {drift_sql('customer')} WHERE c_custkey % 2 = 1""")
def jdbc_apply_changes(spark, d):
    """A stored table gets only its changed rows (those of even keys, and deletes), in one transaction, and is read by ranges of a key of text and
    numbers. The database is that of jdbc_round_trip."""
    url = spark.conf.get("spark.tidemark.jdbc.url", f"jdbc:derby:memory:t{uuid.uuid4().hex};create=true")
    driver = {"driver": spark.conf.get("spark.tidemark.jdbc.driver", "org.apache.derby.iapi.jdbc.AutoloadedDriver")}
    name = f"customer_{uuid.uuid4().hex[:8]}"
    types = {"createTableColumnTypes": "c_name varchar(64), c_mktsegment varchar(32)"}
    source, target, keys = sides(spark, d, "customer")
    writers.write_jdbc(target, url, name, partitions=4, properties=driver | types)
    stored = readers.jdbc(spark, url, name, keys, 4, driver)
    kinds = staging.snapshot(diff.row_diff(source, stored, keys))
    upserts = source.join(kinds.where("change_type <> 'delete' AND c_custkey % 2 = 0"), keys, "left_semi")
    databases.apply_changes(url, name, keys, upserts, kinds.where("change_type = 'delete'"), partitions=4, properties=driver)
    return readers.jdbc(spark, url, name, ["c_mktsegment", "c_custkey"], 4, driver)


@query(f"SELECT {SUMMARY} FROM {classes_sql('supplier')}")
def jdbc_read_moment(spark, d):
    """A comparison with a database table as of one moment, read by ranges of a key of text and numbers. The database is that of jdbc_round_trip."""
    url = spark.conf.get("spark.tidemark.jdbc.url", f"jdbc:derby:memory:t{uuid.uuid4().hex};create=true")
    driver = {"driver": spark.conf.get("spark.tidemark.jdbc.driver", "org.apache.derby.iapi.jdbc.AutoloadedDriver")}
    name = f"supplier_{uuid.uuid4().hex[:8]}"
    source, target, keys = sides(spark, d, "supplier")
    writers.write_jdbc(target, url, name, partitions=4, properties=driver | {"createTableColumnTypes": "s_name varchar(64)"})
    return diff.summary(source, databases.read_moment(spark, url, name, ["s_name", "s_suppkey"], 4, driver), keys)


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE (l_orderkey, l_linenumber) > (100, 2) ORDER BY l_orderkey, l_linenumber, l_quantity LIMIT 500")
def keyset_page(spark, d):
    return project.keyset_page(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), ["l_orderkey", "l_linenumber", "l_quantity"], [100, 2, 1e9], 500)


@query("""WITH b AS (SELECT min(conv_id) + (max(conv_id) - min(conv_id)) // 4 AS low, min(conv_id) + 3 * (max(conv_id) - min(conv_id)) // 4 AS high FROM conversations)
SELECT c.* FROM conversations c, b WHERE (conv_id > low OR conv_id = low AND turn > 1) AND (conv_id < high OR conv_id = high AND turn <= 2)""")
def key_range(spark, d):
    """The middle half of the keys, so that the range grows with the table."""
    c = table(spark, d, "conversations")
    low, high = c.agg(F.min("conv_id"), F.max("conv_id")).first()
    return project.key_range(c, ["conv_id", "turn"], [low + (high - low) // 4, 1], [low + 3 * (high - low) // 4, 2])


@query("SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def key_lookup(spark, d):
    wanted = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return project.key_lookup(table(spark, d, "orders"), ["o_custkey"], wanted)


@query("SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_nationkey::VARCHAR AS c_nationkey, c_mktsegment FROM customer")
def import_csv(spark, d):
    path = staging.shared_folder(spark)
    writers.export_csv(table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), path)
    return readers.import_csv(spark, path)


@query("SELECT event_id::VARCHAR AS event_id, event_type, props FROM events")
def import_json(spark, d):
    path = staging.shared_folder(spark)
    writers.export_json(table(spark, d, "events").select("event_id", "event_type", "props"), path)
    return readers.import_json(spark, path, lines=True)


@query("SELECT c_custkey::VARCHAR AS c_custkey, c_name || chr(10) || '\"' || c_mktsegment || '\",' AS note FROM customer")
def import_csv_line_breaks(spark, d):
    """Every record has line breaks, quotes and commas in a field; the files are read by many tasks all the same."""
    path = staging.shared_folder(spark)
    note = F.concat("c_name", F.lit("\n\""), "c_mktsegment", F.lit('",'))
    writers.export_csv(table(spark, d, "customer").select("c_custkey", note.alias("note")), path)
    return readers.import_csv(spark, path)


@query("SELECT event_id::VARCHAR AS event_id, event_type, props FROM events")
def import_json_array(spark, d):
    """Arrays of objects with braces and quotes in their texts; a file is one array."""
    path = staging.shared_folder(spark)
    writers.export_json_arrays(table(spark, d, "events").select(F.col("event_id").cast("string"), "event_type", "props"), path)
    return readers.import_json(spark, path)


@query("SELECT p_partkey, p_name, p_brand, p_size::BIGINT AS p_size, p_retailprice, p_size > 25 AS large, TIMESTAMP '2024-01-01 00:00:00' + to_days(p_size::INTEGER) AS made FROM part")
def import_infer_types(spark, d):
    made = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.col("p_size"))
    rows = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice", (F.col("p_size") > 25).alias("large"), made.alias("made"))
    return readers.import_new(writers.as_text(rows))


@query(f"SELECT {SUMMARY} FROM {classes_sql('supplier')}")
def snapshot_reuse(spark, d):
    source, target, keys = sides(spark, d, "supplier")
    return diff.summary(staging.snapshot(source), staging.snapshot(target), keys)


@query("SELECT c_nationkey, to_json(list(c_custkey ORDER BY c_custkey))::VARCHAR AS ids FROM customer GROUP BY c_nationkey")
def nested_as_text(spark, d):
    rows = table(spark, d, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list("c_custkey")).alias("ids"))
    return readers.nested_as_text(rows)


# Projections and filters ----------------------------------------------------------------------------------------------------


@query("SELECT c_custkey AS id, c_name AS full_name, c_acctbal FROM customer")
def project_column_map(spark, d):
    return project.mapped(table(spark, d, "customer"), ["id", "full_name", "c_acctbal", "c_mktsegment"], {"c_custkey": "id", "c_name": "full_name"}, ["c_mktsegment"])


@query("SELECT p_partkey, p_name, p_size FROM part")
def copy_skip_generated(spark, d):
    return project.without_generated(table(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_retailprice"), ["P_RETAILPRICE"])


def _filtered(name: str, *filters: Filter):
    return lambda spark, d: project.filtered(table(spark, d, name), filters)


FILTERS = {
    "filter_compare": ("orders", [Filter("o_totalprice", ">=", "1000"), Filter("o_orderstatus", "<>", "F"), Filter("o_orderdate", "<", "1997-01-01")], "o_totalprice >= 1000 AND o_orderstatus <> 'F' AND o_orderdate < TIMESTAMP '1997-01-01'"),
    "filter_like": ("part", [Filter("p_type", "like", "ANDARD"), Filter("p_name", "like", "%a%")], "contains(p_type, 'ANDARD') AND p_name LIKE '%a%'"),
    "filter_not_like": ("part", [Filter("p_name", "not_like", "e")], "NOT contains(p_name, 'e')"),
    "filter_in": ("orders", [Filter("o_orderpriority", "in", ["1-URGENT", "2-HIGH"])], "o_orderpriority IN ('1-URGENT', '2-HIGH')"),
    "filter_not_in": ("orders", [Filter("o_orderpriority", "not_in", ["1-URGENT", "2-HIGH"])], "o_orderpriority NOT IN ('1-URGENT', '2-HIGH') OR o_orderpriority IS NULL"),
    "filter_combined": ("customer", [Filter("c_acctbal", ">", 0), Filter("c_mktsegment", "like", "BUILD"), Filter("c_nationkey", "in", [1, 2, 3])], "c_acctbal > 0 AND contains(c_mktsegment, 'BUILD') AND c_nationkey IN (1, 2, 3)"),
}
for _name, (_table, _filters, _sql) in FILTERS.items():
    QUERIES[_name] = _filtered(_table, *_filters)
    SQL[_name] = f"SELECT * FROM {_table} WHERE {_sql}"


@query("SELECT doc_id, lang, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL AND lang IS NOT NULL")
def filter_nulls(spark, d):
    """Documents that nobody has labelled."""
    rows = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return project.filtered(rows, [Filter("quality", "is_null"), Filter("lang", "is_not_null")])


@query("SELECT * FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000 AND o_orderstatus = 'O'")
def where_fragment(spark, d):
    return project.where_fragment(table(spark, d, "orders"), "o_totalprice BETWEEN 1000 AND 50000 AND o_orderstatus = 'O'")


@query("SELECT * FROM customer WHERE contains(lower(c_custkey::VARCHAR), '17') OR contains(lower(c_name), '17') OR contains(lower(c_nationkey::VARCHAR), '17') OR contains(lower(c_mktsegment), '17')")
def quick_filter(spark, d):
    rows = project.quick_filter(table(spark, d, "customer").drop("c_acctbal"), "17")
    return rows.join(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_custkey")


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id % 2 = 0 END AS flag, CASE WHEN event_id % 4 <> 1 THEN event_id END AS n, ts FROM events""")
def coerce_values(spark, d):
    e = table(spark, d, "events")
    flag = F.when(F.col("event_id") % 3 == 0, F.when(F.col("event_id") % 2 == 0, "TRUE").otherwise("0")).otherwise("maybe")
    n = F.when(F.col("event_id") % 4 == 1, "n/a").otherwise(F.concat(F.lit(" "), F.col("event_id").cast("string")))
    raw = e.select("event_id", flag.alias("flag"), n.alias("n"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"))
    return canonical.as_types(raw, T.StructType([T.StructField("flag", T.BooleanType()), T.StructField("n", T.LongType()), T.StructField("ts", T.TimestampNTZType())]))


# Order, limits, counts ------------------------------------------------------------------------------------------------------


@query("SELECT * FROM orders ORDER BY o_orderkey LIMIT 200")
def order_default_pk(spark, d):
    return project.page(table(spark, d, "orders"), ["o_orderkey"])


@query("SELECT * FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 100 OFFSET 50")
def page_rows(spark, d):
    return project.page(table(spark, d, "orders"), ["o_orderkey"], [("o_totalprice", True)], 100, 50, [Filter("o_orderstatus", "=", "O")])


@query("SELECT count(*) AS total FROM orders WHERE o_orderstatus = 'O'")
def page_total(spark, d):
    return project.page_total(table(spark, d, "orders"), [Filter("o_orderstatus", "=", "O")])


@query("SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id)")
def sort_nulls_last(spark, d):
    rows = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return project.sorted_nulls_last(rows, "quality", True)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1000")
def capped_query(spark, d):
    return free_sql.run(spark, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey", {"orders": table(spark, d, "orders")}, 1000).rows


@query("SELECT * FROM part ORDER BY p_partkey LIMIT 300")
def export_top_n(spark, d):
    return project.top_rows(table(spark, d, "part"), ["p_partkey"], 300)


@query("SELECT count(*) AS rows FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.05")
def count_where(spark, d):
    return project.count_where(table(spark, d, "lineitem"), "l_returnflag = 'R' AND l_discount > 0.05D")


@query("SELECT max(o_orderkey) AS max_key, max(o_orderkey) + 1 AS next_id FROM orders")
def key_high_water(spark, d):
    return project.high_water(table(spark, d, "orders"), "o_orderkey")


NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query(" UNION ALL ".join(f"SELECT '{n}' AS \"table\", count(*) AS rows FROM {n}" for n in NAMES))
def table_inventory(spark, d):
    return report.inventory({n: table(spark, d, n) for n in NAMES})


# Differences ----------------------------------------------------------------------------------------------------------------


@query(f"SELECT {SUMMARY} FROM {classes_sql('customer')}")
def diff_summary(spark, d):
    return diff.summary(*sides(spark, d, "customer"))


@query(f"SELECT * FROM {classes_sql('orders')} WHERE change_type <> 'same'")
def row_diff(spark, d):
    return diff.row_diff(*sides(spark, d, "orders"))


@query(f"SELECT s.* FROM part s WHERE s.p_partkey NOT IN (SELECT p_partkey FROM {drift_sql('part')})")
def diff_inserted(spark, d):
    return diff.inserted(*sides(spark, d, "part"))


@query(f"SELECT s.* FROM part s JOIN {classes_sql('part')} c USING (p_partkey) WHERE change_type = 'update'")
def diff_updated(spark, d):
    return diff.updated(*sides(spark, d, "part"))


@query(f"SELECT t.* FROM {drift_sql('events')} t WHERE t.event_id NOT IN (SELECT event_id FROM events)")
def diff_deleted(spark, d):
    return diff.deleted(*sides(spark, d, "events"))


@query(f"SELECT * FROM {classes_sql('orders')} WHERE change_type <> 'same'")
def range_diff(spark, d):
    """By digests of key ranges, those of the target saved before."""
    source, target, keys = sides(spark, d, "orders")
    path = staging.shared_folder(spark)
    digests.save(target, path, keys, 64)
    return digests.range_diff(source, target, keys, path)


@query("SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'insert' ELSE 'update' END AS change_type FROM events WHERE event_id % 11 = 0 OR event_id % 4 = 1")
def diff_uncastable(spark, d):
    """Texts that are no numbers on one side, nulls on the other: they differ."""
    e = table(spark, d, "events")
    target = e.where("event_id % 11 <> 0").select("event_id", F.when(F.col("event_id") % 4 != 1, F.col("user_id")).alias("user_id"), "event_type")
    text_ = F.when(F.col("event_id") % 4 == 1, "n/a").otherwise(F.col("user_id").cast("string"))
    return diff.row_diff(e.select(F.col("event_id").cast("string").alias("event_id"), text_.alias("user_id"), "event_type"), target, ["event_id"])


W = 100
WINDOW_SOURCE = "(SELECT * FROM customer WHERE c_custkey % 60 <> 1)"
PLACED = f"""(WITH c AS (SELECT * FROM {classes_sql('customer', WINDOW_SOURCE)}), n AS (SELECT count(*) AS total FROM c WHERE change_type <> 'delete'),
p AS (SELECT c.*, total, count(*) FILTER (change_type <> 'delete') OVER (ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c, n),
q AS (SELECT *, change_type = 'delete' AND before = total AS is_tail FROM p)
SELECT c_custkey, change_type, is_tail, CASE WHEN is_tail THEN (total + {W - 1}) // {W} + (row_number() OVER (PARTITION BY is_tail ORDER BY c_custkey) - 1) // {W} ELSE before // {W} END AS chunk FROM q)"""


def _windowed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, list[str]]:
    source, target, keys = sides(spark, d, "customer")
    return source.where("c_custkey % 60 <> 1"), target, keys


@query(f"SELECT count(DISTINCT chunk) AS windows, count(DISTINCT CASE WHEN change_type <> 'same' THEN chunk END) AS diff_windows FROM {PLACED}")
def diff_windows(spark, d):
    return diff.window_counts(diff.windows(*_windowed(spark, d), W))


@query(f"""SELECT f.c_custkey, f.change_type, f.chunk, s.c_name AS source_c_name, s.c_acctbal AS source_c_acctbal, t.c_name AS target_c_name, t.c_acctbal AS target_c_acctbal
FROM (SELECT * FROM {PLACED} WHERE change_type <> 'same' AND NOT is_tail ORDER BY chunk, change_type = 'delete', c_custkey LIMIT 20) f
LEFT JOIN {WINDOW_SOURCE} s USING (c_custkey) LEFT JOIN {drift_sql('customer')} t ON f.c_custkey = t.c_custkey""")
def diff_samples(spark, d):
    found = diff.samples(*_windowed(spark, d), W, 20)
    return found.select("c_custkey", "change_type", "chunk", "source_c_name", "source_c_acctbal", "target_c_name", "target_c_acctbal")


@query(f"""SELECT f.p_partkey, f.change_type, s.p_name AS source_p_name, s.p_retailprice AS source_p_retailprice, t.p_name AS target_p_name, t.p_retailprice AS target_p_retailprice
FROM (SELECT * FROM {classes_sql('part')} WHERE change_type = 'update' ORDER BY p_partkey LIMIT 50 OFFSET 10) f LEFT JOIN part s USING (p_partkey) LEFT JOIN {drift_sql('part')} t ON f.p_partkey = t.p_partkey""")
def diff_rows_page(spark, d):
    return diff.diff_page(*sides(spark, d, "part"), "update", 50, 10).select("p_partkey", "change_type", "source_p_name", "source_p_retailprice", "target_p_name", "target_p_retailprice")


@query(f"""SELECT s.o_orderkey, 'o_totalprice' AS "column", t.o_totalprice::VARCHAR AS old_value, s.o_totalprice::VARCHAR AS new_value FROM orders s JOIN {drift_sql('orders')} t USING (o_orderkey) WHERE s.o_totalprice <> t.o_totalprice""")
def diff_cells(spark, d):
    return diff.changed_cells(*sides(spark, d, "orders"))


@query("SELECT DISTINCT 'T_' || upper(p_brand) AS \"table\" FROM part WHERE lower(p_brand) NOT IN (SELECT lower(p_brand) FROM part WHERE p_size < 2)")
def extra_tables(spark, d):
    part = table(spark, d, "part")
    return diff.extra_tables(part.where("p_size < 2").select(F.concat(F.lit("t_"), F.lower("p_brand")).alias("table")), part.select(F.concat(F.lit("T_"), F.upper("p_brand")).alias("table")).distinct())


LINES = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
LINE_TARGET = "(SELECT * FROM lineitem WHERE l_orderkey % 10 <> 3 UNION ALL SELECT * FROM lineitem WHERE l_orderkey % 50 = 0)"


@query(f"""SELECT {LINES}, greatest(coalesce(a.n, 0) - coalesce(b.n, 0), 0) AS only_source, greatest(coalesce(b.n, 0) - coalesce(a.n, 0), 0) AS only_target
FROM (SELECT {LINES}, count(*) AS n FROM lineitem GROUP BY ALL) a FULL OUTER JOIN (SELECT {LINES}, count(*) AS n FROM {LINE_TARGET} GROUP BY ALL) b USING ({LINES}) WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def multiset_diff(spark, d):
    lines = table(spark, d, "lineitem")
    target = lines.where("l_orderkey % 10 <> 3").unionByName(lines.where("l_orderkey % 50 = 0"))
    return diff.multiset_diff(lines, target)


@query(f"""SELECT change_type, row_number() OVER (PARTITION BY change_type ORDER BY o_orderkey)::INTEGER AS position, o_orderkey::VARCHAR || chr(31) AS pk_key, count(*) OVER (PARTITION BY change_type) > 100 AS truncated
FROM {classes_sql('orders')} WHERE change_type <> 'same' QUALIFY row_number() OVER (PARTITION BY change_type ORDER BY o_orderkey) <= 100""")
def diff_keys(spark, d):
    return diff.diff_keys(*sides(spark, d, "orders"), 100)


@query(f"SELECT {SUMMARY} FROM {classes_sql('orders', '(SELECT * FROM orders WHERE o_totalprice > 20000)')}")
def diff_where(spark, d):
    source, target, keys = sides(spark, d, "orders")
    return diff.summary(project.where_fragment(source, "o_totalprice > 20000"), target, keys)


@query(f"""SELECT {SUMMARY} FROM (SELECT CASE WHEN t.id IS NULL THEN 'insert' WHEN s.c_custkey IS NULL THEN 'delete' WHEN s.c_name IS DISTINCT FROM t.full_name THEN 'update' ELSE 'same' END AS change_type
FROM customer s FULL OUTER JOIN (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN c_name || '*' ELSE c_name END AS full_name FROM {drift_sql('customer')}) t ON s.c_custkey = t.id)""")
def diff_mapped(spark, d):
    source, target, _ = sides(spark, d, "customer")
    target = target.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 4 == 0, F.concat("c_name", F.lit("*"))).otherwise(F.col("c_name")).alias("full_name"))
    return diff.summary(project.mapped(source, target.columns, {"c_custkey": "id", "c_name": "full_name"}, ["c_acctbal"]), target, ["id"])


@query(f"SELECT {SUMMARY} FROM (SELECT CASE WHEN c_custkey % 10 = 3 THEN 'insert' WHEN c_custkey % 7 = 0 THEN 'update' ELSE 'same' END AS change_type FROM customer UNION ALL SELECT 'delete' FROM customer WHERE c_custkey % 50 = 0)")
def diff_masked(spark, d):
    source, target, keys = sides(spark, d, "customer")
    rules = [MaskRule("c_name", "random_letters", 6), MaskRule("c_mkt*", "fixed", "X")]
    # the target holds masked rows; the source is masked again, with the same result
    return diff.summary(mask.masked(source, keys, rules), mask.masked(target, keys, rules), keys)


@query(f"SELECT {SUMMARY} FROM {classes_sql('orders')} WHERE o_orderkey > 5000")
def diff_resume(spark, d):
    source, target, keys = sides(spark, d, "orders")
    return diff.summary(diff.resumed(source, keys, [5000]), diff.resumed(target, keys, [5000]), keys)


# Keys and hashes ------------------------------------------------------------------------------------------------------------


def cell_sql(c: str, kind: str) -> str:
    body = {"s": f"'s:' || {c}", "n": f"{c}::VARCHAR", "t": f"strftime({c}, '%Y-%m-%dT%H:%M:%S.%f')", "b": f"CASE WHEN {c} THEN '1' ELSE '0' END"}[kind]
    return f"coalesce({body}, chr(1) || 'NULL')"


CUSTOMER_CELLS = (("c_acctbal", "n"), ("c_custkey", "n"), ("c_mktsegment", "s"), ("c_name", "s"), ("c_nationkey", "n"))
ORDER_CELLS = (("o_custkey", "n"), ("o_orderdate", "t"), ("o_orderkey", "n"), ("o_orderpriority", "s"), ("o_orderstatus", "s"), ("o_totalprice", "n"))


@query("SELECT o_orderkey, " + ", ".join(f"{cell_sql(c, k)} AS t_{c}" for c, k in ORDER_CELLS) + ", regexp_replace(regexp_replace((o_totalprice::DECIMAL(15, 4))::VARCHAR, '0+$', ''), '[.]$', '') AS t_price FROM orders")
def canonical_values(spark, d):
    o = table(spark, d, "orders").withColumn("price", F.col("o_totalprice").cast("decimal(15,4)"))
    return o.select("o_orderkey", *[cell(F.col(c), o.schema[c].dataType).alias(f"t_{c}") for c, _ in ORDER_CELLS], cell(F.col("price"), o.schema["price"].dataType).alias("t_price"))


@query("SELECT c_custkey, upper(sha256(" + " || ".join(f"'{c}=' || {cell_sql(c, k)} || chr(30)" for c, k in CUSTOMER_CELLS) + ")) AS row_hash FROM customer")
def row_hash(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", canonical.row_hash(c, c.columns).alias("row_hash"))


KEY_SQL = "conv_id::VARCHAR || chr(31) || turn::VARCHAR || chr(31) || coalesce('s:' || role, chr(1) || 'NULL') || chr(31)"


@query(f"SELECT conv_id, turn, {KEY_SQL} AS pk_key FROM conversations")
def key_encode(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", canonical.key_text(c, ["conv_id", "turn", "role"]).alias("pk_key"))


@query("SELECT conv_id, turn, role FROM conversations")
def key_decode(spark, d):
    c = table(spark, d, "conversations")
    text_ = c.select(canonical.key_text(c, ["conv_id", "turn", "role"]).alias("k"))
    return text_.select(*canonical.key_values(F.col("k"), {n: c.schema[n].dataType for n in ("conv_id", "turn", "role")}))


@query("SELECT count(*) AS same, 0::BIGINT AS other FROM orders")
def cross_type_equal(spark, d):
    """Numbers, times and decimals as text on one side, typed on the other."""
    o = table(spark, d, "orders").select("o_orderkey", F.round("o_totalprice", 2).cast("decimal(15,2)").alias("price"), "o_orderdate", (F.col("o_orderstatus") == "F").alias("done"))
    texts = o.select(F.col("o_orderkey").cast("string"), F.col("price").cast("decimal(18,5)").cast("string").alias("price"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("o_orderdate"), F.when(F.col("done"), "True").otherwise("0").alias("done"))
    s = diff.summary(canonical.as_types(texts, o.schema), o, ["o_orderkey"])
    return s.select("same", (F.col("inserted") + F.col("updated") + F.col("deleted")).alias("other"))


# Copies and merges ----------------------------------------------------------------------------------------------------------

LOW, HIGH = "p_partkey % 3 = 0", "p_partkey % 3 <> 0"


@query("SELECT * FROM part")
def copy_error(spark, d):
    p = table(spark, d, "part")
    return apply.copied(p.where(LOW), p.where(HIGH), ["p_partkey"], "error")


@query(f"SELECT * FROM part WHERE {LOW}")
def copy_truncate(spark, d):
    p = table(spark, d, "part")
    return apply.copied(p.where(LOW), p.where(HIGH), ["p_partkey"], "truncate")


@query(f"SELECT * FROM {drift_sql('part')} UNION ALL SELECT * FROM part WHERE p_partkey % 10 = 3")
def copy_skip_existing(spark, d):
    source, target, keys = sides(spark, d, "part")
    return apply.copied(source, target, keys, "skip_existing")


@query("SELECT c_custkey::INTEGER AS C_CUSTKEY, c_acctbal::VARCHAR AS C_ACCTBAL, NULL::VARCHAR AS NOTE FROM customer")
def copy_data_only(spark, d):
    """The target's definition stays: names in its case, its types, its columns."""
    c = table(spark, d, "customer")
    target = c.limit(0).select(F.col("c_custkey").cast("int").alias("C_CUSTKEY"), F.col("c_acctbal").cast("string").alias("C_ACCTBAL"), F.lit(None).cast("string").alias("NOTE"))
    return apply.copied(c, target, ["C_CUSTKEY"], "truncate")


@query(f"SELECT * FROM orders UNION ALL SELECT * FROM {drift_sql('orders')} WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def apply_upsert(spark, d):
    return apply.merged(*sides(spark, d, "orders"))


@query("SELECT * FROM orders")
def apply_mirror(spark, d):
    return apply.merged(*sides(spark, d, "orders"), delete_extra=True)


@query(f"""SELECT coalesce(s.p_partkey, t.p_partkey) AS p_partkey, CASE WHEN s.p_partkey IS NOT NULL THEN s.p_retailprice ELSE t.p_retailprice END AS p_retailprice, t.p_name AS p_name, t.note AS note
FROM part s FULL OUTER JOIN (SELECT p_partkey, p_retailprice, p_name, 'n' || p_size::VARCHAR AS note FROM {drift_sql('part')}) t ON s.p_partkey = t.p_partkey""")
def apply_partial_columns(spark, d):
    source, target, keys = sides(spark, d, "part")
    target = target.select("p_partkey", "p_retailprice", "p_name", F.concat(F.lit("n"), F.col("p_size").cast("string")).alias("note"))
    return apply.merged(source.select("p_partkey", "p_retailprice"), target, keys)


def _edits(spark: SparkSession, d: str) -> tuple[DataFrame, list[str], DataFrame, DataFrame, DataFrame]:
    s = table(spark, d, "supplier")
    inserts = s.where("s_suppkey % 5 = 0").withColumn("s_suppkey", F.col("s_suppkey") + FAR)
    updates = s.where("s_suppkey % 3 = 0").select("s_suppkey", F.lit("renamed").alias("s_name"), F.lit(None).cast("double").alias("s_acctbal"), F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit("s_name"))).otherwise(F.array(F.lit("s_name"), F.lit("s_acctbal"))).alias("_set"))
    return s, ["s_suppkey"], inserts, updates, s.where("s_suppkey % 4 = 0").select("s_suppkey")


@query(f"""SELECT s_suppkey, CASE WHEN s_suppkey < {FAR} AND s_suppkey % 3 = 0 THEN 'renamed' ELSE s_name END AS s_name, s_nationkey, CASE WHEN s_suppkey < {FAR} AND s_suppkey % 6 = 3 THEN NULL ELSE s_acctbal END AS s_acctbal
FROM (SELECT * FROM supplier UNION ALL SELECT s_suppkey + {FAR}, s_name, s_nationkey, s_acctbal FROM supplier WHERE s_suppkey % 5 = 0) WHERE s_suppkey >= {FAR} OR s_suppkey % 4 <> 0""")
def apply_change_set(spark, d):
    target, keys, inserts, updates, deletes = _edits(spark, d)
    return apply.change_set(target, keys, inserts, updates, deletes)


@query("SELECT count(*) FILTER (s_suppkey % 5 = 0) AS inserted, count(*) FILTER (s_suppkey % 3 = 0) AS updated, count(*) FILTER (s_suppkey % 4 = 0) AS deleted FROM supplier")
def change_set_counts(spark, d):
    return apply.change_set_counts(*_edits(spark, d))


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier UNION ALL SELECT s_suppkey + 1000000000, s_name, s_nationkey, NULL FROM supplier")
def import_into_existing(spark, d):
    s = table(spark, d, "supplier")
    rows = s.select((F.col("s_suppkey") + FAR).cast("string").alias("S_SUPPKEY"), F.col("s_name").alias("S_Name"), F.col("s_nationkey").cast("string").alias("s_nationkey"), F.lit("7").alias("s_acctbal"), F.lit("?").alias("unknown"))
    return readers.import_into(rows, s, ["s_acctbal"])[0]


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders")
def import_new_table(spark, d):
    path = staging.shared_folder(spark)
    writers.export_csv(table(spark, d, "orders").drop("o_orderpriority"), path)
    return staging.snapshot(readers.import_new(readers.import_csv(spark, path)))


@query("SELECT * FROM orders")
def copy_resume(spark, d):
    o = table(spark, d, "orders")
    return apply.resumed_copy(o, o.where("o_orderkey <= 7000"), ["o_orderkey"], [7000])


@query("SELECT * FROM orders WHERE o_orderkey % 2 = 0")
def truncate_table(spark, d):
    """A table that is emptied and then filled with other rows."""
    o = table(spark, d, "orders")
    return apply.copied(o.where("o_orderkey % 2 = 0"), apply.truncated(o), ["o_orderkey"])


MERGED = f"(SELECT * FROM orders UNION ALL SELECT * FROM {drift_sql('orders')} WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders))"


@query(f"""SELECT o_orderpriority, count(*) AS rows, sum(o_orderkey)::BIGINT AS keys, round(sum(o_totalprice), 2) AS total FROM {MERGED} GROUP BY o_orderpriority""")
def apply_changed_partitions(spark, d):
    """A stored table, partitioned by priority, after a merge that rewrites only the partitions with a change."""
    source, target, keys = sides(spark, d, "orders")
    path = staging.shared_folder(spark)
    target.repartition("o_orderpriority").write.partitionBy("o_orderpriority").parquet(path)
    apply.merge_into_path(source, path, keys, ["o_orderpriority"])
    rows = spark.read.parquet(path).groupBy("o_orderpriority")
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.sum("o_orderkey").alias("keys"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(f"SELECT * FROM {MERGED}")
def stored_upsert(spark, d):
    """A stored table after a merge that writes only the files with a change."""
    source, target, keys = sides(spark, d, "orders")
    path = staging.shared_folder(spark)
    stored.create(target, path, keys)
    stored.merge(source, path)
    return stored.read(spark, path)


@query("SELECT * FROM orders")
def stored_mirror(spark, d):
    source, target, keys = sides(spark, d, "orders")
    path = staging.shared_folder(spark)
    stored.create(target, path, keys)
    stored.merge(source, path, delete_extra=True)
    return stored.read(spark, path)


@query(SQL["apply_change_set"])
def stored_change_set(spark, d):
    """Three change sets beside the base of a stored table, merged by key when it is read."""
    target, keys, inserts, updates, deletes = _edits(spark, d)
    path = staging.shared_folder(spark)
    stored.create(target, path, keys)
    stored.apply_changes(spark, path, inserts=inserts)
    stored.apply_changes(spark, path, updates=updates)
    stored.apply_changes(spark, path, deletes=deletes)
    return stored.read(spark, path)


SELECTED = {"customer": TableSelection(["c_custkey"]), "part": TableSelection(["p_partkey"], delete_extra=True, verify="full"), "supplier": TableSelection(["s_suppkey"], where="s_acctbal > 0"), "events": TableSelection(), "missing": TableSelection(["id"])}


def _many(spark: SparkSession, d: str) -> tuple[dict, dict]:
    both = {n: sides(spark, d, n) for n in ("customer", "part", "supplier")}
    sources = {n: s for n, (s, _, _) in both.items()} | {"events": table(spark, d, "events"), "missing": table(spark, d, "region")}
    return sources, {n: t for n, (_, t, _) in both.items()} | {"events": sources["events"]}


def _compare_sql(name: str, source: str | None = None) -> str:
    return f"SELECT '{name}' AS \"table\", count(*) FILTER (change_type <> 'delete') AS source_rows, count(*) FILTER (change_type <> 'insert') AS target_rows, count(*) FILTER (change_type = 'insert') AS inserted, count(*) FILTER (change_type = 'update') AS updated, count(*) FILTER (change_type = 'delete') AS deleted, 0::BIGINT AS structure_changes, NULL::VARCHAR AS error FROM {classes_sql(name, source)}"


POSITIVE = "(SELECT * FROM supplier WHERE s_acctbal > 0)"


@query(" UNION ALL ".join([_compare_sql("customer"), _compare_sql("part"), _compare_sql("supplier", POSITIVE),
    "SELECT 'events', count(*), count(*), 0, 0, 0, 0, 'the table has no key; compare it as a multiset' FROM events", "SELECT 'missing', count(*), 0, count(*), 0, 0, 1, 'the target has no such table' FROM region"]))
def compare_tables(spark, d):
    return report.compare_tables(spark, *_many(spark, d), SELECTED)


def _sync_sql(name: str, total: str, source: str | None = None) -> str:
    return f"SELECT '{name}' AS \"table\", 'row_diff' AS method, count(*) FILTER (change_type = 'insert') AS inserted, count(*) FILTER (change_type = 'update') AS updated, count(*) FILTER (change_type = 'delete') AS deleted, {total} AS rows, {'true' if name == 'part' else 'count(*) FILTER (change_type = ' + chr(39) + 'delete' + chr(39) + ') = 0'} AS verified FROM {classes_sql(name, source)}"


@query(" UNION ALL ".join([_sync_sql("customer", "count(*)"), _sync_sql("part", "count(*) FILTER (change_type <> 'delete')"), _sync_sql("supplier", "count(*)", POSITIVE), "SELECT 'missing', 'row_diff', 0, 0, 0, 0, NULL"]))
def sync_tables_report(spark, d):
    chosen = {n: s for n, s in SELECTED.items() if n != "events"}
    return report.sync_tables(spark, *_many(spark, d), chosen)[1].drop("error")


@query(f"""SELECT count(*)::BIGINT AS tables, count(*) FILTER (error IS NOT NULL) AS failed, sum(target_rows)::BIGINT AS rows, 'PartiallyFailed' AS status FROM ({SQL['compare_tables']})""")
def run_status(spark, d):
    return report.run_status(compare_tables(spark, d).withColumn("rows", F.col("target_rows")))


@query("SELECT o_orderkey AS run_id, o_orderstatus AS status, o_orderpriority AS kind, o_orderdate AS started FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100 OFFSET 20")
def run_history(spark, d):
    runs = table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("kind"), F.col("o_orderdate").alias("started"))
    return report.run_history(runs, status="F", limit=100, offset=20)


@query(f"""SELECT f.o_orderkey, f.change_type, s.o_totalprice AS source_o_totalprice, t.o_totalprice AS target_o_totalprice FROM (SELECT * FROM {classes_sql('orders')} WHERE change_type = 'update' ORDER BY o_orderkey LIMIT 100 OFFSET 30) f
LEFT JOIN orders s USING (o_orderkey) LEFT JOIN {drift_sql('orders')} t ON f.o_orderkey = t.o_orderkey""")
def saved_diff_page(spark, d):
    """A page of a saved comparison: nothing is compared again."""
    source, target, keys = sides(spark, d, "orders")
    store = staging.shared_folder(spark)
    found = staging.snapshot(diff.row_diff(source, target, keys))
    told = report.compare_tables(spark, {"orders": source}, {"orders": target}, {"orders": TableSelection(keys)})
    run = runs.save_run(spark, store, "compare", told, BEGAN, differences={"orders": (found, keys)})
    page = runs.saved_page(spark, store, run, "orders", source, target, keys, "update", 100, 30)
    return page.select("o_orderkey", "change_type", "source_o_totalprice", "target_o_totalprice")


BEGAN = datetime.datetime(2024, 1, 1)


@query(f"SELECT kind, profile, status, tables, failed, rows FROM (SELECT 'sync' AS kind, 'a' AS profile, 'Completed' AS status, 1::BIGINT AS tables, 0::BIGINT AS failed, count(*) AS rows, 1 AS n FROM customer UNION ALL SELECT 'compare', 'a', r.status, r.tables, r.failed, r.rows, 2 FROM ({SQL['run_status']}) r) ORDER BY n DESC")
def saved_run_history(spark, d):
    """Runs saved by a sync and a comparison, newest first; runs of other profiles aren't asked for."""
    store = staging.shared_folder(spark)
    source, target, keys = sides(spark, d, "customer")
    _, told = report.sync_tables(spark, {"customer": source}, {"customer": target}, {"customer": TableSelection(keys, delete_extra=True)})
    runs.save_run(spark, store, "sync", told, BEGAN, "a")
    runs.save_run(spark, store, "compare", compare_tables(spark, d), BEGAN + datetime.timedelta(hours=1), "a")
    runs.save_run(spark, store, "sync", told, BEGAN, "b")
    return report.run_history(runs.runs(spark, store), profile="a").select("kind", "profile", "status", "tables", "failed", "rows")


@query("SELECT * FROM orders")
def copy_resumable(spark, d):
    """A copy by key ranges that stops and goes on where it stopped."""
    path = staging.shared_folder(spark)
    o = table(spark, d, "orders")
    runs.resumable_copy(o, path, ["o_orderkey"], 6, most=2)
    runs.resumable_copy(o, path, ["o_orderkey"], 6)
    return runs.finished(spark, path)


# Checks ---------------------------------------------------------------------------------------------------------------------


@query(f"SELECT s AS source_rows, t AS target_rows, s = t AS equal FROM (SELECT count(*) AS s FROM orders WHERE o_totalprice > 20000), (SELECT count(*) AS t FROM {drift_sql('orders')})")
def verify_counts(spark, d):
    source, target, _ = sides(spark, d, "orders")
    return verify.counts(source, target, "o_totalprice > 20000")


@query(f"SELECT {SUMMARY}, count(*) FILTER (change_type <> 'same') = 0 AS passed FROM {classes_sql('orders')} WHERE o_orderkey <= (SELECT max(o_orderkey) FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 2000))")
def verify_sample(spark, d):
    return verify.sample(*sides(spark, d, "orders"), 2000)


REPAIRED = "CASE WHEN o_orderkey % 2 = 0 AND change_type IN ('insert', 'update') THEN 'same' ELSE change_type END"


@query(f"SELECT {SUMMARY}, count(*) FILTER (change_type <> 'same') = 0 AS passed FROM (SELECT {REPAIRED} AS change_type FROM {classes_sql('orders')})")
def verify_full(spark, d):
    """The check of a sync that took even keys only: it finds what the odd ones still lack."""
    source, target, keys = sides(spark, d, "orders")
    return verify.full(source, staging.snapshot(apply.merged(source.where("o_orderkey % 2 = 0"), target, keys)), keys)


# Masks ----------------------------------------------------------------------------------------------------------------------


def digits_sql(column: str, salt: str = "") -> str:
    return f"('0x' || substr(md5('0|' || c_custkey::VARCHAR || chr(31) || '|{column}{salt}'), 1, 8))::BIGINT"


def letters_sql(column: str, n: int) -> str:
    return " || ".join(f"chr((97 + {digits_sql(column, f'|{k}')} % 26)::INTEGER)" for k in range(n))


MASKS = {
    "mask_rules": ([MaskRule("C_NAME", "fixed", "n"), MaskRule("c_n*", "fixed", "7"), MaskRule("*ent", "null"), MaskRule("c_acct", "null")], {"c_name": "'n'", "c_nationkey": "7::INTEGER", "c_mktsegment": "NULL::VARCHAR"}),
    "mask_null": ([MaskRule("c_acctbal", "null")], {"c_acctbal": "NULL::DOUBLE"}),
    "mask_fixed": ([MaskRule("c_name", "fixed", "hidden"), MaskRule("c_acctbal", "fixed", 0)], {"c_name": "'hidden'", "c_acctbal": "0::DOUBLE"}),
    "mask_random_int": ([MaskRule("c_nationkey", "random_int", 25)], {"c_nationkey": f"({digits_sql('c_nationkey')} % 25)::INTEGER"}),
    "mask_random_letters": ([MaskRule("c_name", "random_letters", 5)], {"c_name": letters_sql("c_name", 5)}),
    "mask_random_date": ([MaskRule("c_mktsegment", "random_date")], {"c_mktsegment": f"(DATE '2024-01-01' - ({digits_sql('c_mktsegment')} % 3650)::INTEGER)::VARCHAR"}),
    "mask_sql_expr": ([MaskRule("c_name", "sql_expr", "concat(substr(c_name, 1, 3), '***')"), MaskRule("c_acctbal", "sql_expr", "floor(c_acctbal / 100) * 100")], {"c_name": "substr(c_name, 1, 3) || '***'", "c_acctbal": "floor(c_acctbal / 100) * 100"}),
}
for _name, (_rules, _new) in MASKS.items():
    QUERIES[_name] = (lambda rules: lambda spark, d: mask.masked(table(spark, d, "customer"), ["c_custkey"], rules))(_rules)
    SQL[_name] = "SELECT " + ", ".join(f"{_new[c]} AS {c}" if c in _new else c for c in COLUMNS["customer"].split()) + " FROM customer"


# Exports --------------------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey::VARCHAR AS o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') AS o_orderdate, CASE WHEN o_orderstatus = 'F' THEN 'true' ELSE 'false' END AS done, CASE WHEN o_orderkey % 5 = 0 THEN 'a, \"b\"' || chr(10) || 'c' END AS note FROM orders")
def export_csv(spark, d):
    note = F.when(F.col("o_orderkey") % 5 == 0, 'a, "b"\nc')
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderdate", (F.col("o_orderstatus") == "F").alias("done"), note.alias("note"))
    path = staging.shared_folder(spark)
    writers.export_csv(rows, path, ["o_orderkey"])
    return readers.import_csv(spark, path)


@query("SELECT event_id, user_id, event_type, value, ts FROM events")
def export_json(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type", "value", "ts")
    path = staging.shared_folder(spark)
    writers.export_json(rows, path, ["event_id"])
    return spark.read.schema(rows.schema).json(path)


@query("""SELECT 'INSERT INTO part ("p_partkey", "p_name", "p_size", "large", "note") VALUES (' || p_partkey::VARCHAR || ', ''' || replace(p_name, '''', '''''') || ''', ' || p_size::VARCHAR || ', ' || CASE WHEN p_size > 25 THEN 'TRUE' ELSE 'FALSE' END || ', ' || CASE WHEN p_partkey % 2 = 0 THEN 'NULL' ELSE '''it''''s''' END || ');' AS sql FROM part""")
def export_insert_sql(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_name", "p_size", (F.col("p_size") > 25).alias("large"), F.when(F.col("p_partkey") % 2 == 1, "it's").alias("note"))
    path = staging.shared_folder(spark)
    writers.export_insert_sql(rows, path, "part", ["p_partkey"])
    return spark.read.text(path).withColumnRenamed("value", "sql")


@query("SELECT 'customer' AS \"table\", count(*) AS rows FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier")
def export_many(spark, d):
    found = writers.export_many({n: table(spark, d, n) for n in ("customer", "supplier")}, staging.shared_folder(spark))
    return report.inventory({n: readers.import_csv(spark, p) for n, p in found.items()})


@query("SELECT '| ' || c_custkey::VARCHAR || ' | ' || c_name || ' | ' || CASE WHEN c_custkey % 2 = 0 THEN 'NULL' ELSE 'a\\|b' END || ' |' AS line FROM customer")
def export_markdown(spark, d):
    return writers.markdown_rows(table(spark, d, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 2 == 1, "a|b").alias("x")))


@query("SELECT p_size::VARCHAR AS value FROM part")
def column_text(spark, d):
    return writers.column_text(table(spark, d, "part"), "p_size")


ELEMENT = "CASE WHEN x IS NULL THEN 'NULL' WHEN x = '' OR upper(x) = 'NULL' OR regexp_matches(x, '[\\\\\"{},\\s]') THEN '\"' || replace(replace(x, '\\', '\\\\'), '\"', '\\\"') || '\"' ELSE x END"


@query(f"SELECT p_partkey, '{{' || array_to_string(list_transform([p_type, p_brand, '', 'null', NULL, 'q\"' || p_size::VARCHAR], lambda x: {ELEMENT}), ',') || '}}' AS items FROM part")
def array_to_pg_text(spark, d):
    items = F.array("p_type", "p_brand", F.lit(""), F.lit("null"), F.lit(None).cast("string"), F.concat(F.lit('q"'), F.col("p_size").cast("string")))
    return table(spark, d, "part").select("p_partkey", text.array_text(items, T.ArrayType(T.StringType())).alias("items"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '{' || c_nationkey::VARCHAR || ',' || c_mktsegment || ',\"a b\"}' ELSE c_name END AS items FROM customer")
def json_array_to_pg_text(spark, d):
    raw = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("["), F.col("c_nationkey").cast("string"), F.lit(',"'), F.col("c_mktsegment"), F.lit('","a b"]'))).otherwise(F.col("c_name"))
    return table(spark, d, "customer").select("c_custkey", text.json_array_text(raw).alias("items"))


# Schemas: a catalogue of many tables, derived from part (ten columns a table) ----------------------------------------------------

NATIVE = ("integer", "bigint", "numeric(10,2)", "character varying(40)", "text", "timestamp with time zone", "_text", "money", "uuid", "hstore")
CANONICAL = (("Int32", None, None, None), ("Int64", None, None, None), ("Decimal", None, 10, 2), ("VarChar", 40, None, None), ("Text", None, None, None), ("DateTimeOffset", None, None, None), ("Json", None, None, None), ("Decimal", None, 19, 4), ("Guid", None, None, None), ("Unknown", None, None, None))
MYSQL = ("int", "bigint", "decimal(10,2)", "varchar(40)", "text", "datetime", "json", "decimal(19,4)", "char(36)", "text")
WARNED = {5: "the time zone is lost", 9: "unknown type, kept as text"}


def catalogue(spark: SparkSession, d: str) -> DataFrame:
    p, k = table(spark, d, "part"), F.col("p_partkey")
    return p.select(F.concat(F.lit("t"), F.floor(k / 10).cast("string")).alias("table"), F.concat(F.lit("c"), (k % 10).cast("string")).alias("column"), (k % 10).cast("int").alias("position"),
                    F.element_at(F.array(*map(F.lit, NATIVE)), (F.col("p_size") % 10 + 1).cast("int")).alias("native_type"), (F.col("p_size") % 2 == 0).alias("nullable"), (k % 10 == 0).alias("is_key"), k.alias("k"))


def later(before: DataFrame) -> DataFrame:
    """Column 3 is renamed in even tables, column 4 dropped in every third, column 5 has another type in every fifth, column 1 joins the key in every seventh."""
    t = F.floor(F.col("k") / 10)
    at = F.col("position")
    return (before.where(~((at == 4) & (t % 3 == 0))).withColumn("column", F.when((at == 3) & (t % 2 == 0), F.concat(F.lit("r"), F.col("column"))).otherwise(F.col("column")))
            .withColumn("native_type", F.when((at == 5) & (t % 5 == 0), F.concat("native_type", F.lit(" array"))).otherwise(F.col("native_type"))).withColumn("is_key", F.col("is_key") | ((at == 1) & (t % 7 == 0))))


def _case(values, cast: str) -> str:
    return "CASE p_size % 10 " + " ".join(f"WHEN {i} THEN {'NULL' if v is None else repr(v)}" for i, v in enumerate(values)) + f" END::{cast}"


CATALOGUE = "SELECT 't' || (p_partkey // 10)::VARCHAR AS \"table\", 'c' || (p_partkey % 10)::VARCHAR AS \"column\", p_partkey // 10 AS t, p_partkey % 10 AS place, p_size FROM part"


@query(f"SELECT \"table\", \"column\", {_case([c[0] for c in CANONICAL], 'VARCHAR')} AS canonical, {_case([c[1] for c in CANONICAL], 'INTEGER')} AS c_length, {_case([c[2] for c in CANONICAL], 'INTEGER')} AS c_precision, {_case([c[3] for c in CANONICAL], 'INTEGER')} AS c_scale FROM ({CATALOGUE})")
def types_to_canonical(spark, d):
    return schema.to_canonical(catalogue(spark, d), "postgresql").select("table", "column", "canonical", "c_length", "c_precision", "c_scale")


@query(f"SELECT \"table\", \"column\", {_case(MYSQL, 'VARCHAR')} AS target_type, {_case([WARNED.get(i, '') for i in range(10)], 'VARCHAR')} AS warnings FROM ({CATALOGUE})")
def types_to_target(spark, d):
    found = schema.to_target(schema.to_canonical(catalogue(spark, d), "postgresql"), "mysql")
    return found.select("table", "column", "target_type", F.array_join("warnings", "; ").alias("warnings"))


#: Types of each dialect, what they mean (with length, precision and scale), and how the next dialect of the list writes them (fixed values).
DIALECT_TYPES = {
    "postgresql": (
        ("numeric(70,40)", "Decimal", None, 70, 40, "decimal(65,30)"), ("character varying(20000)", "VarChar", 20000, None, None, "text"),
        ("int4[]", "Json", None, None, None, "json"), ("timestamp with time zone", "DateTimeOffset", None, None, None, "datetime"),
        ("uuid", "Guid", None, None, None, "char(36)"),
    ),
    "mysql": (
        ("tinyint(1)", "Boolean", None, None, None, "tinyint(1)"), ("enum('a','b')", "VarChar", 255, None, None, "varchar(255)"),
        ("decimal(12,3)", "Decimal", None, 12, 3, "decimal(12,3)"), ("mediumint", "Int32", None, None, None, "int"),
        ("longblob", "Binary", None, None, None, "longblob"),
    ),
    "mariadb": (
        ("geometry", "Unknown", None, None, None, "TEXT"), ("varchar(30)", "VarChar", 30, None, None, "VARCHAR(30)"),
        ("double", "Double", None, None, None, "REAL"), ("json", "Json", None, None, None, "TEXT"), ("datetime", "DateTime", None, None, None, "DATETIME"),
    ),
    "sqlite": (
        ("VARCHAR(50)", "VarChar", 50, None, None, "nvarchar(50)"), ("", "Binary", None, None, None, "varbinary(max)"),
        ("DECIMAL(10,2)", "Decimal", None, 10, 2, "decimal(10,2)"), ("BIGINT", "Int64", None, None, None, "bigint"),
        ("BOOLEAN", "Boolean", None, None, None, "bit"),
    ),
    "sqlserver": (
        ("nvarchar(max)", "Text", None, None, None, "String"), ("money", "Decimal", None, 19, 4, "decimal(19,4)"),
        ("datetimeoffset", "DateTimeOffset", None, None, None, "DateTime"), ("uniqueidentifier", "Guid", None, None, None, "UUID"),
        ("bit", "Boolean", None, None, None, "UInt8"),
    ),
    "clickhouse": (
        ("UInt64", "Decimal", None, 20, 0, "decimal(20,0)"), ("Int8", "Int16", None, None, None, "SMALLINT"),
        ("IPv4", "VarChar", 45, None, None, "VARCHAR(45)"), ("Float32", "Single", None, None, None, "FLOAT"),
        ("Array(String)", "Json", None, None, None, "JSON"),
    ),
    "duckdb": (
        ("hugeint", "Decimal", None, 38, 0, "decimal(38,0)"), ("struct(a int)", "Json", None, None, None, "CLOB"),
        ("timestamptz", "DateTimeOffset", None, None, None, "TIMESTAMP(6) WITH TIME ZONE"), ("usmallint", "Int32", None, None, None, "INTEGER"),
        ("varchar", "VarChar", None, None, None, "VARCHAR2(255)"),
    ),
    "dm8": (
        ("DATE", "DateTime", None, None, None, "timestamp without time zone"), ("NUMBER", "Decimal", None, None, None, "numeric"),
        ("VARCHAR2(100)", "VarChar", 100, None, None, "character varying(100)"), ("CLOB", "Text", None, None, None, "text"),
        ("BINARY_FLOAT", "Single", None, None, None, "real"),
    ),
    "kingbasees": (
        ("money", "Decimal", None, 19, 4, "numeric(19,4)"), ("bpchar(3)", "Char", 3, None, None, "character(3)"),
        ("bool", "Boolean", None, None, None, "boolean"), ("bytea", "Binary", None, None, None, "bytea"),
        ("time with time zone", "Time", None, None, None, "time without time zone"),
    ),
    "opengauss": (
        ("int8", "Int64", None, None, None, "bigint"), ("citext", "Text", None, None, None, "text"), ("xml", "Xml", None, None, None, "xml"),
        ("float4", "Single", None, None, None, "real"), ("jsonb", "Json", None, None, None, "jsonb"),
    ),
}
MAPPED = ("native_type", "canonical", "c_length", "c_precision", "c_scale", "target_type")


def _dialect_sql(dialect: str) -> str:
    def case(k: int) -> str:
        found = [t[k] for t in DIALECT_TYPES[dialect]]
        shown = ["NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'" for v in found]
        kind = "INTEGER" if MAPPED[k].startswith("c_") else "VARCHAR"
        return "CASE p_size % 5 " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(shown)) + f" END::{kind} AS {MAPPED[k]}"

    return f"SELECT '{dialect}' AS dialect, p_partkey AS k, " + ", ".join(map(case, range(len(MAPPED)))) + " FROM part"


@query(" UNION ALL ".join(map(_dialect_sql, DIALECT_TYPES)))
def types_all_dialects(spark, d):
    """A catalogue of each of the ten dialects, written for the next of them."""
    names, out = list(DIALECT_TYPES), []
    for dialect, target in zip(names, [*names[1:], names[0]]):
        native = F.element_at(F.array(*[F.lit(t[0]) for t in DIALECT_TYPES[dialect]]), (F.col("p_size") % 5 + 1).cast("int"))
        columns = table(spark, d, "part").select(F.lit(dialect).alias("dialect"), F.col("p_partkey").alias("k"), native.alias("native_type"))
        out.append(schema.to_target(schema.to_canonical(columns, dialect), target).select("dialect", "k", *MAPPED))
    return functools.reduce(DataFrame.unionByName, out)


@query(f"""SELECT "table", 'c0' AS "column", 'a random mask makes other keys of it' AS message FROM ({CATALOGUE}) WHERE place = 0
UNION ALL SELECT "table", 'rc*', 'no column matches this rule' FROM ({CATALOGUE}) GROUP BY "table", t HAVING NOT bool_or(place = 3 AND t % 2 = 0)
UNION ALL SELECT "table", '*1', 'no column matches this rule' FROM ({CATALOGUE}) GROUP BY "table" HAVING NOT bool_or(place = 1)
UNION ALL SELECT "table", 'C*', 'no column matches this rule' FROM ({CATALOGUE}) GROUP BY "table", t HAVING NOT bool_or(NOT (place = 3 AND t % 2 = 0) AND NOT (place = 4 AND t % 3 = 0))""")
def mask_issues(spark, d):
    """Random masks on key columns and rules without a column, for the tables of a whole catalogue; the key column c1 has an earlier rule."""
    rules = [MaskRule("*1", "null"), MaskRule("rc*", "fixed", "x"), MaskRule("C*", "random_int")]
    return mask.catalogue_issues(later(catalogue(spark, d)), rules)


RENAMED, DROPPED, RETYPED = "place = 3 AND t % 2 = 0", "place = 4 AND t % 3 = 0", "place = 5 AND t % 5 = 0"
COLUMN_CHANGES = f"""SELECT "table", 'r' || "column" AS "column", 'added' AS change FROM ({CATALOGUE}) WHERE {RENAMED} UNION ALL SELECT "table", "column", 'dropped' FROM ({CATALOGUE}) WHERE ({RENAMED}) OR ({DROPPED})
UNION ALL SELECT "table", "column", 'altered' FROM ({CATALOGUE}) WHERE {RETYPED}"""


@query(COLUMN_CHANGES)
def schema_diff_columns(spark, d):
    before = catalogue(spark, d)
    return schema.diff_columns(before, later(before))


def indexes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("p_partkey")
    before = table(spark, d, "part").select(F.concat(F.lit("t"), F.floor(k / 10).cast("string")).alias("table"), F.concat(F.lit("ix_"), k.cast("string")).alias("index"), F.array(F.lit("a"), F.concat(F.lit("c"), k.cast("string"))).alias("columns"), (k % 2 == 0).alias("unique"), F.lit("BTREE").alias("method"), F.lit(None).cast("string").alias("predicate"), k.alias("k"))
    after = before.where("k % 11 <> 0").withColumn("index", F.upper("index")).withColumn("method", F.lit("btree")).withColumn("unique", F.when(F.col("k") % 13 == 0, ~F.col("unique")).otherwise(F.col("unique")))
    return before, after


@query("""SELECT 't' || (p_partkey // 10)::VARCHAR AS "table", CASE WHEN p_partkey % 11 = 0 THEN 'ix_' ELSE 'IX_' END || p_partkey::VARCHAR AS "index", unnest(CASE WHEN p_partkey % 11 = 0 THEN ['dropped'] ELSE ['dropped', 'added'] END) AS change FROM part WHERE p_partkey % 11 = 0 OR p_partkey % 13 = 0""")
def schema_diff_indexes(spark, d):
    return schema.diff_indexes(*indexes(spark, d))


@query("""SELECT 't' || (p_partkey // 10)::VARCHAR AS "table", 'fk_' || p_partkey::VARCHAR AS fk, unnest(CASE WHEN p_partkey % 17 = 0 THEN ['added'] ELSE ['dropped', 'added'] END) AS change FROM part WHERE p_partkey % 17 = 0 OR p_partkey % 5 = 0""")
def schema_diff_fks(spark, d):
    return schema.diff_fks(*foreign_keys(spark, d))


def foreign_keys(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("p_partkey")
    after = table(spark, d, "part").select(F.concat(F.lit("t"), F.floor(k / 10).cast("string")).alias("table"), F.concat(F.lit("fk_"), k.cast("string")).alias("fk"), F.array(F.lit("a")).alias("columns"), F.lit("other").alias("ref_table"), F.array(F.lit("id")).alias("ref_columns"), F.when(k % 5 == 0, "CASCADE").otherwise("").alias("on_delete"), F.lit(None).cast("string").alias("on_update"), k.alias("k"))
    before = after.where("k % 17 <> 0").withColumn("on_delete", F.lit("NO ACTION")).withColumn("ref_table", F.lit('"OTHER"'))
    return before, after


@query(f"SELECT \"table\", 'c0' AS key_before, 'c0,c1' AS key_after FROM ({CATALOGUE}) GROUP BY \"table\", t HAVING t % 7 = 0 AND bool_or(place = 1) AND bool_or(place = 0) UNION ALL SELECT \"table\", '', 'c1' FROM ({CATALOGUE}) GROUP BY \"table\", t HAVING t % 7 = 0 AND bool_or(place = 1) AND NOT bool_or(place = 0)")
def schema_diff_pk(spark, d):
    before = catalogue(spark, d)
    return schema.diff_pk(before, later(before))


@query(f"SELECT \"table\", \"column\" AS old, 'r' || \"column\" AS new, 'high' AS confidence FROM ({CATALOGUE}) WHERE {RENAMED}")
def schema_renames(spark, d):
    before = catalogue(spark, d)
    return schema.renames(before, later(before))


@query(f"""SELECT "table", "column" AS object, CASE change WHEN 'added' THEN 'add_column' WHEN 'dropped' THEN 'drop_column' ELSE 'alter_column' END AS kind, change <> 'added' AS destructive FROM ({COLUMN_CHANGES})
UNION ALL SELECT "table", key_after, 'change_key', false FROM ({SQL['schema_diff_pk']})""")
def schema_changes(spark, d):
    before = catalogue(spark, d)
    return schema.changes(before, later(before))


@query(f"""WITH w AS (SELECT "table", t, place, "column" FROM ({CATALOGUE})), k AS (SELECT DISTINCT "table", t FROM w)
SELECT "table", "column" AS object, 'alter_column' AS kind, true AS destructive FROM w WHERE place = 0 AND t % 4 <> 0 UNION ALL
SELECT "table", "table", 'drop_table', true FROM k WHERE t % 4 = 0 UNION ALL SELECT 'n' || "table", 'n' || "table", 'create_table', false FROM k WHERE t % 4 = 0 UNION ALL
SELECT "table", "index", CASE change WHEN 'added' THEN 'add_index' ELSE 'drop_index' END, false FROM ({SQL['schema_diff_indexes']}) WHERE substr("table", 2)::INTEGER % 4 <> 0 UNION ALL
SELECT "table", fk, CASE change WHEN 'added' THEN 'add_foreign_key' ELSE 'drop_foreign_key' END, false FROM ({SQL['schema_diff_fks']}) WHERE substr("table", 2)::INTEGER % 4 <> 0""")
def schema_change_list(spark, d):
    """Columns of other lengths, whole tables, indexes and foreign keys: a fourth of the tables has another name, each first column is longer."""
    before = catalogue(spark, d).withColumn("length", F.lit(10)).drop("is_key")
    t = F.col("table").substr(F.lit(2), F.lit(9)).cast("int")
    after = before.withColumn("length", F.when(F.col("column") == "c0", 20).otherwise(10)).withColumn("table", F.when(t % 4 == 0, F.concat(F.lit("n"), "table")).otherwise(F.col("table")))
    return schema.changes(before, after, indexes(spark, d), foreign_keys(spark, d), tables=True)


@query(f"SELECT \"table\", \"column\", 'warning' AS level, CASE p_size % 10 WHEN 5 THEN 'the time zone is lost' ELSE 'unknown type, kept as text' END AS message FROM ({CATALOGUE}) WHERE p_size % 10 IN (5, 9)")
def conversion_issues(spark, d):
    return schema.conversion_issues(catalogue(spark, d), "postgresql", "mysql")


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '9' || c_name ELSE 'a b' END AS name FROM customer WHERE c_custkey % 2 = 0")
def invalid_identifiers(spark, d):
    k = F.col("c_custkey")
    names = table(spark, d, "customer").select("c_custkey", F.when(k % 4 == 0, F.concat(F.lit("9"), "c_name")).when(k % 2 == 0, "a b").otherwise("ok_1").alias("name"))
    return schema.invalid_identifiers(names, "name")


@query("SELECT c_custkey::INTEGER AS id, c_name, c_acctbal::VARCHAR AS c_acctbal, NULL::DATE AS since, c_nationkey, c_mktsegment FROM customer")
def conform_schema(spark, d):
    c = table(spark, d, "customer")
    target = c.limit(0).select(F.col("c_custkey").cast("int").alias("id"), "c_name", F.col("c_acctbal").cast("string").alias("c_acctbal"), F.lit(None).cast("date").alias("since"))
    return schema.conform(c, target, {"c_custkey": "id"})[0]


# Free SQL -------------------------------------------------------------------------------------------------------------------

JOIN_AGG = "SELECT n_name, o_orderstatus, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, o_orderstatus"
WINDOWED = "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders"
ROLLED = "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)"


@query(JOIN_AGG)
def sql_join_agg(spark, d):
    return free_sql.query(spark, JOIN_AGG, {n: table(spark, d, n) for n in ("orders", "customer", "nation")})


@query(WINDOWED)
def sql_window(spark, d):
    return free_sql.query(spark, WINDOWED, {"orders": table(spark, d, "orders")})


@query(ROLLED)
def sql_rollup(spark, d):
    return free_sql.query(spark, ROLLED, {"lineitem": table(spark, d, "lineitem")})


@query("SELECT event_type, count(*) AS n FROM events WHERE value > 10 GROUP BY event_type")
def sql_read_only(spark, d):
    sql = "-- counts\n(SELECT event_type, count(*) AS n FROM events WHERE value > :least GROUP BY event_type)"
    return free_sql.query(spark, sql, {"events": table(spark, d, "events")}, {"least": 10}, read_only=True)
