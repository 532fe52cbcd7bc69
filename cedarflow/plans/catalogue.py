"""Registered queries of the relational toolkit and their DuckDB SQL.

Sums of doubles are made of exact decimals in both, so that their order does not
matter.
"""

from __future__ import annotations

import io
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cedarflow.errors import EngineError
from cedarflow.functions import predicate
from cedarflow.operators import relational as ops
from cedarflow.plans import estimates
from cedarflow.plans.statistics import Statistics
from cedarflow.sources import catalog, delimited, tables

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

PARTSUPP_SQL = """(SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, CAST(max(l_quantity) AS INT) AS ps_availqty,
  min(l_extendedprice) / 100.0 AS ps_supplycost FROM lineitem GROUP BY l_partkey, l_suppkey)"""
DEC4 = "CAST(SUM(CAST({} AS DECIMAL(18,4))) AS DOUBLE)"
DEC = "CAST(SUM(CAST({} AS DECIMAL(18,2))) AS DOUBLE)"


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partsupp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relation that the test tables lack, derived from lineitem."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("ps_partkey"), F.col("l_suppkey").alias("ps_suppkey")).agg(
        F.max("l_quantity").cast("int").alias("ps_availqty"), (F.min("l_extendedprice") / F.lit(100.0)).alias("ps_supplycost")
    )


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares, else in the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("SELECT r_regionkey, r_name FROM region")
def scan_heap(spark, d):
    return table(spark, d, "region")


@query("SELECT * FROM nation")
def scan_nation(spark, d):
    return table(spark, d, "nation")


@query("SELECT r_regionkey, r_name FROM region WHERE r_name = 'EUROPE'")
def filter_eq_string(spark, d):
    return ops.select(table(spark, d, "region"), "(r_name = 'EUROPE')")


@query("SELECT * FROM nation WHERE n_regionkey = 3 AND n_nationkey > 10")
def filter_and_range(spark, d):
    return ops.select(table(spark, d, "nation"), "(n_regionkey = 3) AND (n_nationkey > 10)")


@query("SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND (l_discount < 0.04 OR l_linestatus = 'F')")
def filter_or_cnf(spark, d):
    return ops.project(ops.select(table(spark, d, "lineitem"), "(l_returnflag = 'R') AND (l_discount < 0.04 OR l_linestatus = 'F')"), ["l_orderkey", "l_partkey", "l_suppkey"])


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_partkey > l_suppkey")
def filter_attr_attr(spark, d):
    return ops.project(ops.select(table(spark, d, "lineitem"), "(l_partkey > l_suppkey)"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier WHERE 50 > s_suppkey")
def filter_lit_left(spark, d):
    return ops.select(table(spark, d, "supplier"), "(50 > s_suppkey)")


@query("SELECT CAST(1 AS INT) AS one, s_suppkey FROM supplier WHERE 1 < 2")
def filter_lit_lit(spark, d):
    df = ops.select(table(spark, d, "supplier"), "(1 < 2)")
    return df.select(F.lit(1).alias("one"), "s_suppkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate > TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1996-02-01'")
def filter_date_string(spark, d):
    return ops.project(ops.select(table(spark, d, "lineitem"), "(l_shipdate > '1996-01-01') AND (l_shipdate < '1996-02-01')"), ["l_orderkey", "l_linenumber"])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O' AND o_totalprice > 1015.68 AND o_totalprice < 200000")
def filter_five_conjuncts(spark, d):
    return ops.project(ops.select(table(spark, d, "orders"), "(o_orderpriority = '1-URGENT') AND (o_orderstatus = 'O') AND (o_totalprice > 1015.68) AND (o_totalprice < 200000)"), ["o_orderkey", "o_totalprice"])


@query("SELECT s_suppkey, s_name FROM supplier")
def select_all_identity(spark, d):
    return ops.project(ops.select(ops.select(table(spark, d, "supplier"), "(s_suppkey = s_suppkey)"), "(s_suppkey)"), [0, 1])


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000.0")
def select_pipe(spark, d):
    return ops.select(ops.project(table(spark, d, "customer"), ["c_custkey", "c_acctbal"]), "(c_acctbal > 5000.0)")


@query("SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_retailprice > 905 AND p_retailprice < 910")
def project_cols(spark, d):
    return ops.project(ops.select(table(spark, d, "part"), "(p_retailprice > 905) AND (p_retailprice < 910)"), ["p_partkey", "p_name", "p_retailprice"])


@query(f"SELECT {DEC4.format('s_acctbal + (s_acctbal * 1.05)')} AS sum FROM (SELECT CAST(s_acctbal AS DOUBLE) AS s_acctbal FROM supplier)".replace("1.05", "CAST(1.05 AS DOUBLE)"))
def sum_expr(spark, d):
    return ops.sum_of(table(spark, d, "supplier"), "(s_acctbal + (s_acctbal * 1.05))", scale=4)


@query("SELECT CAST(SUM(l_linenumber) AS BIGINT) AS sum FROM lineitem")
def sum_int(spark, d):
    return ops.sum_of(table(spark, d, "lineitem"), "(l_linenumber)")


@query("SELECT CAST(SUM(l_linenumber) AS BIGINT) AS sum FROM lineitem WHERE l_partkey < 0")
def sum_empty(spark, d):
    return ops.sum_of(ops.select(table(spark, d, "lineitem"), "(l_partkey < 0)"), "(l_linenumber)")


@query("SELECT o_orderkey, CAST(o_custkey // 7 AS BIGINT) AS v, CAST(-(o_custkey // 7) AS BIGINT) AS w FROM orders")
def expr_int_div(spark, d):
    df = ops.compute(ops.compute(table(spark, d, "orders"), "v", "(o_custkey / 7)"), "w", "- (o_custkey / 7)")
    return ops.project(df, ["o_orderkey", "v", "w"])


@query("SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS DOUBLE) + (l_quantity * 2) AS v FROM lineitem")
def expr_mixed(spark, d):
    return ops.project(ops.compute(table(spark, d, "lineitem"), "v", "(l_linenumber + (l_quantity * 2))"), ["l_orderkey", "l_linenumber", "v"])


@query("SELECT s_suppkey, -(s_acctbal + 1.0) AS v FROM supplier")
def expr_unary_minus(spark, d):
    return ops.project(ops.compute(table(spark, d, "supplier"), "v", "- s_acctbal + 1.0"), ["s_suppkey", "v"])


@query("SELECT l_orderkey, l_linenumber, l_quantity - (l_discount - l_tax) AS v FROM lineitem")
def expr_right_assoc(spark, d):
    return ops.project(ops.compute(table(spark, d, "lineitem"), "v", "l_quantity - l_discount - l_tax"), ["l_orderkey", "l_linenumber", "v"])


@query("SELECT l_orderkey, l_linenumber, l_quantity * l_discount - l_tax AS v FROM lineitem")
def expr_standard_precedence(spark, d):
    return ops.project(ops.compute(table(spark, d, "lineitem"), "v", "l_quantity * l_discount - l_tax", "standard"), ["l_orderkey", "l_linenumber", "v"])


@query(f"SELECT {DEC4.format('ps_supplycost')} AS sum FROM supplier JOIN {PARTSUPP_SQL} ps ON s_suppkey = ps_suppkey")
def join_equi_sum(spark, d):
    return ops.sum_of(ops.join(table(spark, d, "supplier"), partsupp(spark, d), "(s_suppkey = ps_suppkey)"), "(ps_supplycost)", scale=4)


@query(f"SELECT ps_partkey, ps_suppkey, l_orderkey, l_linenumber FROM {PARTSUPP_SQL} ps JOIN lineitem ON ps_partkey = l_partkey AND ps_suppkey = l_suppkey")
def join_multi_key(spark, d):
    joined = ops.join(partsupp(spark, d), table(spark, d, "lineitem"), "(ps_partkey = l_partkey) AND (ps_suppkey = l_suppkey)")
    return ops.project(joined, ["ps_partkey", "ps_suppkey", "l_orderkey", "l_linenumber"])


@query("SELECT s_suppkey, l_orderkey, l_linenumber FROM supplier JOIN lineitem ON s_suppkey = l_suppkey AND l_extendedprice > s_acctbal")
def join_equi_residual(spark, d):
    return ops.project(ops.join(table(spark, d, "supplier"), table(spark, d, "lineitem"), "(s_suppkey = l_suppkey) AND (l_extendedprice > s_acctbal)"), ["s_suppkey", "l_orderkey", "l_linenumber"])


@query("SELECT s_suppkey, c_custkey, s_nationkey, c_nationkey FROM supplier JOIN customer ON s_nationkey = c_nationkey")
def join_many_to_many(spark, d):
    return ops.project(ops.join(table(spark, d, "supplier"), table(spark, d, "customer"), "(s_nationkey = c_nationkey)"), ["s_suppkey", "c_custkey", "s_nationkey", "c_nationkey"])


@query("SELECT s_suppkey, n_nationkey FROM supplier JOIN nation ON s_suppkey < 4 AND s_suppkey > n_nationkey")
def join_theta_nl(spark, d):
    return ops.project(ops.join(table(spark, d, "supplier"), table(spark, d, "nation"), "(s_suppkey < 4) AND (s_suppkey > n_nationkey)"), ["s_suppkey", "n_nationkey"])


@query(f"SELECT {DEC4.format('ps_supplycost')} AS sum FROM part JOIN {PARTSUPP_SQL} ps ON p_partkey = ps_partkey JOIN supplier ON s_suppkey = ps_suppkey WHERE s_acctbal > 2500.0")
def join_three_way_sum(spark, d):
    # the filtered relation first: it cuts the large one before it meets the third
    two = ops.join(ops.select(table(spark, d, "supplier"), "(s_acctbal > 2500.0)"), partsupp(spark, d), "(s_suppkey = ps_suppkey)")
    return ops.sum_of(ops.join(table(spark, d, "part"), two, "(p_partkey = ps_partkey)"), "(ps_supplycost)", scale=4)


@query("""SELECT n1.n_nationkey AS n1_n_nationkey, n1.n_name AS n1_n_name, n1.n_regionkey AS n1_n_regionkey,
  n2.n_nationkey AS n2_n_nationkey, n2.n_name AS n2_n_name, n2.n_regionkey AS n2_n_regionkey
  FROM nation n1 JOIN nation n2 ON n1.n_regionkey = n2.n_regionkey""")
def join_self_alias(spark, d):
    nation = table(spark, d, "nation")
    return ops.join(nation, nation, "(n1.n_regionkey = n2.n_regionkey)", "n1", "n2")


@query(f"SELECT {DEC4.format('ps_supplycost')} AS sum, s_nationkey FROM supplier JOIN {PARTSUPP_SQL} ps ON s_suppkey = ps_suppkey GROUP BY s_nationkey")
def group_sum(spark, d):
    joined = ops.join(table(spark, d, "supplier"), partsupp(spark, d), "(s_suppkey = ps_suppkey)")
    return ops.group_sum(joined, "(s_nationkey)", "(ps_supplycost)", scale=4)


@query(f"SELECT {DEC.format('l_extendedprice')} AS sum, l_returnflag, l_linestatus FROM lineitem GROUP BY l_returnflag, l_linestatus")
def group_sum_multi(spark, d):
    return ops.group_sum(table(spark, d, "lineitem"), "(l_returnflag) AND (l_linestatus)", "(l_extendedprice)", scale=2)


@query(f"SELECT DISTINCT ps_suppkey FROM {PARTSUPP_SQL} ps WHERE ps_supplycost < 100.11")
def distinct_one(spark, d):
    return ops.distinct(ops.project(ops.select(partsupp(spark, d), "(ps_supplycost < 100.11)"), ["ps_suppkey"]))


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_all(spark, d):
    return ops.distinct(ops.project(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"]))


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_name")
def sort_single(spark, d):
    return ops.sort(ops.project(table(spark, d, "customer"), ["c_custkey", "c_name"]), "(c_name)")


@query("SELECT l_shipdate, l_extendedprice, l_quantity FROM lineitem ORDER BY 1, 2, 3")
def sort_multi(spark, d):
    return ops.sort(ops.project(table(spark, d, "lineitem"), ["l_shipdate", "l_extendedprice", "l_quantity"]), "(l_shipdate) AND (l_extendedprice) AND (l_quantity)")


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def sorted_merge(spark, d):
    supplier = table(spark, d, "supplier")
    t = tables.create(spark, scratch(spark, "sorted"), supplier.schema, "sorted", "(s_suppkey)")
    t.append(supplier.filter("s_suppkey % 2 = 1"))
    t.merge()
    t.append(supplier.filter("s_suppkey % 2 = 0"))
    return t.scan()


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey = 10 AND o_totalprice > 1000.0")
def sorted_keyed_scan(spark, d):
    orders = ops.project(table(spark, d, "orders"), ["o_orderkey", "o_custkey", "o_totalprice"])
    t = tables.create(spark, scratch(spark, "sorted"), orders.schema, "sorted", "(o_custkey) AND (o_orderkey)")
    t.append(orders)
    return t.lookup("(o_custkey = 10) AND (o_totalprice > 1000.0)")


@query("SELECT c_custkey, c_name, c_nationkey FROM customer")
def heap_load_append(spark, d):
    customer = ops.project(table(spark, d, "customer"), ["c_custkey", "c_name", "c_nationkey"])
    t = tables.create(spark, scratch(spark, "heap"), customer.schema)
    t.append(customer.filter("c_custkey < 700"))
    t.append(customer.filter("c_custkey >= 700"))
    return tables.open_table(spark, t.path).scan()


@query("SELECT 'n_nationkey:[' || n_nationkey || '], n_name:[' || n_name || '], n_regionkey:[' || n_regionkey || ']' AS line FROM nation")
def write_out_text(spark, d):
    return ops.format_rows(table(spark, d, "nation"))


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 100.5 AND (c_custkey < 50 OR c_custkey = 77)")
def heap_filtered_scan(spark, d):
    customer = ops.project(table(spark, d, "customer"), ["c_custkey", "c_acctbal"])
    t = tables.create(spark, scratch(spark, "heap"), customer.schema)
    t.append(customer)
    return t.scan("(c_acctbal > 100.5) AND (c_custkey < 50 OR c_custkey = 77)")


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier ORDER BY s_acctbal, s_suppkey")
def sort_write(spark, d):
    path = scratch(spark, "sorted")
    ops.save_sorted(ops.project(table(spark, d, "supplier"), ["s_suppkey", "s_name", "s_acctbal"]), "(s_acctbal) AND (s_suppkey)", path)
    return spark.read.parquet(path)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def tbl_round_trip(spark, d):
    nation, path = table(spark, d, "nation"), scratch(spark, "tbl")
    delimited.write_tbl(nation, path)
    return delimited.read_tbl(spark, path, nation.schema)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey = 3 AND n_name > 'NATION_1'")
def tbl_filter(spark, d):
    nation, path = table(spark, d, "nation"), scratch(spark, "tbl")
    delimited.write_tbl(nation, path)
    return tables.filter_file(spark, path, nation.schema, "(n_regionkey = 3) AND (n_name > 'NATION_1')")


@query("SELECT CAST(7 AS INT) AS k, CAST(2.5 AS DOUBLE) AS d, 'seven' AS s")
def compose_record(spark, d):
    schema = catalog.schema_of([("k", "Int"), ("d", "Double"), ("s", "String")])
    return catalog.rows_of(spark, schema, ["7|2.5|seven|"])


@query("SELECT s_suppkey, l_orderkey, l_linenumber FROM supplier JOIN lineitem ON s_suppkey = l_suppkey AND s_suppkey = 3")
def join_literal_clause(spark, d):
    return ops.project(ops.join(table(spark, d, "supplier"), table(spark, d, "lineitem"), "(s_suppkey = l_suppkey) AND (s_suppkey = 3)"), ["s_suppkey", "l_orderkey", "l_linenumber"])


@query("SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT n_regionkey) AS BIGINT) AS n_regions FROM nation")
def stats_from_table(spark, d):
    stats = Statistics()
    stats.add_frame("nation", table(spark, d, "nation"))
    group = stats.groups["nation"]
    return spark.sql(f"SELECT CAST({group.rows} AS BIGINT) AS n_rows, CAST({group.distinct['nation.n_regionkey']} AS BIGINT) AS n_regions")


def _estimate(name: str):
    def run(spark, d):
        return spark.sql(f"SELECT CAST({estimates.run(name)} AS BIGINT) AS estimate")

    return run


CATALOG = """BEGIN
nation
nation.tbl
n_nationkey Int
n_name String
n_regionkey Int
END
BEGIN
supplier
supplier.tbl
s_suppkey Int
s_name String
s_nationkey Int
s_acctbal Double
END
"""


def put_text(spark: SparkSession, name: str, text: str) -> str:
    """A text stored in the shared folder, as one file of a new folder."""
    path = scratch(spark, name)
    spark.createDataFrame([(text.rstrip("\n"),)], "line string").coalesce(1).write.text(path)
    return path


def put_tbl(df: DataFrame, name: str) -> str:
    path = scratch(df.sparkSession, name)
    delimited.write_tbl(df, path)
    return path


def refused(action, *errors: type[Exception]) -> bool:
    try:
        action()
    except errors:
        return True
    return False


def values(spark: SparkSession, schema: str, *rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


@query("""SELECT * FROM (VALUES ('nation', 'nation.tbl', 'n_nationkey', 'int', CAST(1 AS BIGINT)), ('nation', 'nation.tbl', 'n_name', 'string', 2), ('nation', 'nation.tbl', 'n_regionkey', 'int', 3),
  ('supplier', 'supplier.tbl', 's_suppkey', 'int', 1), ('supplier', 'supplier.tbl', 's_name', 'string', 2), ('supplier', 'supplier.tbl', 's_nationkey', 'int', 3), ('supplier', 'supplier.tbl', 's_acctbal', 'double', 4))
  t(relation, file, attribute, kind, position)""")
def catalog_read(spark, d):
    found = catalog.load_catalog(put_text(spark, "catalog", CATALOG), spark)
    rows = [(r.name, r.file, f.name, f.dataType.simpleString(), i) for r in found.values() for i, f in enumerate(r.schema.fields, 1)]
    return values(spark, "relation string, file string, attribute string, kind string, position long", *rows)


@query("SELECT CAST(c_custkey AS INT) AS c_custkey, c_name, c_acctbal FROM customer")
def heap_bulk_load(spark, d):
    customer = table(spark, d, "customer").select(F.col("c_custkey").cast("int").alias("c_custkey"), "c_name", "c_acctbal")
    t = tables.create(spark, scratch(spark, "heap"), customer.schema)
    t.load(put_tbl(customer, "tbl"))
    return t.scan()


@query("SELECT CAST(r_regionkey AS INT) AS r_regionkey, r_name FROM region UNION ALL SELECT * FROM (VALUES (CAST(90 AS INT), 'NEW'), (91, 'NEWER'))")
def heap_add_rows(spark, d):
    region = table(spark, d, "region").select(F.col("r_regionkey").cast("int").alias("r_regionkey"), "r_name")
    t = tables.create(spark, scratch(spark, "heap"), region.schema)
    t.append(region)
    t.add([(90, "NEW"), (91, "NEWER")])
    return t.scan()


@query("SELECT s_suppkey, s_name, CAST(row_number() OVER (ORDER BY s_suppkey) AS BIGINT) AS position FROM supplier")
def sorted_close_reopen(spark, d):
    supplier = ops.project(table(spark, d, "supplier"), ["s_suppkey", "s_name"])
    t = tables.create(spark, scratch(spark, "sorted"), supplier.schema, "sorted", "(s_suppkey)")
    t.append(ops.sort(supplier, "(s_name)"))
    t.close()
    return in_order(tables.open_table(spark, t.path).scan())


def in_order(df: DataFrame) -> DataFrame:
    """The rows with their numbers in the order they come in."""
    path = scratch(df.sparkSession, "ordered")
    df.write.parquet(path)
    return ops.stored_positions(df.sparkSession, path)


@query("SELECT s_suppkey, s_acctbal, CAST(row_number() OVER (ORDER BY s_suppkey) AS BIGINT) AS position FROM supplier")
def sorted_runs_scan(spark, d):
    supplier = ops.project(table(spark, d, "supplier"), ["s_suppkey", "s_acctbal"])
    t = tables.create(spark, scratch(spark, "sorted"), supplier.schema, "sorted", "(s_suppkey)")
    for k in range(3):
        t.append(supplier.filter(F.col("s_suppkey") % 3 == k))
        t.merge()
    t.compact()
    t.vacuum()
    return in_order(t.scan())


@query("SELECT * FROM (VALUES ('both', 'o_custkey,o_orderkey'), ('first', 'o_custkey'), ('none', ''), ('range', '')) t(name, prefix)")
def sorted_query_order(spark, d):
    orders = ops.project(table(spark, d, "orders"), ["o_orderkey", "o_custkey", "o_totalprice"])
    t = tables.create(spark, scratch(spark, "sorted"), orders.schema, "sorted", "(o_custkey) AND (o_orderkey)")
    cases = {"both": "(o_orderkey = 3) AND (o_custkey = 10)", "first": "(o_custkey = 10) AND (o_totalprice > 5.0)", "none": "(o_orderkey = 3)", "range": "(o_custkey > 10)"}
    return values(spark, "name string, prefix string", *[(n, ",".join(t.key_prefix(c))) for n, c in cases.items()])


@query("SELECT 's_suppkey:[' || s_suppkey || '], s_name:[' || s_name || ']' AS line FROM supplier")
def write_out_file(spark, d):
    path = scratch(spark, "text")
    ops.write_out(ops.project(table(spark, d, "supplier"), ["s_suppkey", "s_name"]), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("SELECT 'n_nationkey: [' || n_nationkey || '], n_name: [' || n_name || '], n_regionkey: [' || n_regionkey || ']' AS line, count(*) OVER () AS printed FROM nation")
def print_rows_text(spark, d):
    to = io.StringIO()
    n = ops.print_rows(table(spark, d, "nation"), to)
    return values(spark, "line string, printed long", *[(line, n) for line in to.getvalue().splitlines()])


@query("SELECT CAST(s_suppkey AS INT) AS s_suppkey, s_name, s_acctbal FROM supplier WHERE s_acctbal > 1000.0 AND s_nationkey > 3")
def settings_handle(spark, d):
    supplier = table(spark, d, "supplier")
    files = scratch(spark, "files")
    delimited.write_tbl(supplier.select("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), f"{files}/supplier.tbl")
    settings = tables.read_settings(put_text(spark, "settings", f"{put_text(spark, 'catalog', CATALOG)}\n\n{files}/\n"), spark)
    own = tables.handle(settings, "supplier", spark)
    df = own.read(spark)
    return ops.project(df.filter(own.predicate(df, "(s_acctbal > 1000.0) AND (s_nationkey > 3)")), ["s_suppkey", "s_name", "s_acctbal"])


@query("SELECT * FROM (VALUES ('ambiguous', TRUE), ('grammar', TRUE), ('number and text', TRUE), ('strict', TRUE), ('unknown', TRUE), ('fits', FALSE)) t(name, refused)")
def typed_errors(spark, d):
    nation, customer = table(spark, d, "nation"), table(spark, d, "customer")
    cases = {
        "ambiguous": lambda: ops.join(nation, nation, "(n_nationkey = n_nationkey)"),
        "grammar": lambda: ops.select(nation, "(n_name = )"),
        "number and text": lambda: ops.select(nation, "(n_name = 5)"),
        "strict": lambda: ops.select(customer, "(c_acctbal > 5)", strict=True),
        "unknown": lambda: ops.select(nation, "(n_nothing = 5)"),
        "fits": lambda: ops.select(customer, "(c_acctbal > 5)"),
    }
    return values(spark, "name string, refused boolean", *[(n, refused(f, EngineError)) for n, f in cases.items()])


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 100.0")
def filter_strict(spark, d):
    return ops.project(ops.select(table(spark, d, "customer"), "(c_acctbal > 100.0)", strict=True), ["c_custkey"])


@query("""SELECT * FROM (VALUES ('cnf', '(a = 1 OR b < ''x'') AND (c > 2.5)'), ('condition', 'a = 1'), ('order', '2 keys: 2 Int, 1 String'),
  ('tree', 'Condition(left=Operand(kind=''Name'', value=''a''), op=''='', right=Operand(kind=''Int'', value=''1''))')) t(name, text)""")
def print_forms(spark, d):
    found = predicate.parse("(a = 1 OR b < 'x') AND (c > 2.5)")
    first = found.clauses[0][0]
    order = ops.order_text(table(spark, d, "nation").select(F.lit(1.0).alias("x"), "n_name", F.col("n_nationkey").cast("int").alias("n_nationkey")), "(n_nationkey) AND (n_name)")
    return values(spark, "name string, text string", ("cnf", str(found)), ("condition", str(first)), ("order", order), ("tree", repr(first)))


@query("SELECT s_suppkey, s_nationkey, s_acctbal, s_name, CAST(row_number() OVER (ORDER BY s_suppkey, s_nationkey, s_acctbal, s_name) AS BIGINT) AS position FROM supplier")
def sort_all_columns(spark, d):
    supplier = ops.project(table(spark, d, "supplier"), ["s_name", "s_acctbal", "s_suppkey", "s_nationkey"])
    return in_order(ops.sort(supplier, ops.all_column_order(supplier)))


@query("SELECT c_name, c_custkey, CAST(row_number() OVER (ORDER BY c_name) AS BIGINT) AS position FROM customer")
def sort_single_order(spark, d):
    return in_order(ops.sort(ops.project(table(spark, d, "customer"), ["c_name", "c_custkey"]), "(c_name)"))


@query("SELECT l_shipdate, l_extendedprice, l_quantity, CAST(row_number() OVER (ORDER BY l_shipdate, l_extendedprice, l_quantity) AS BIGINT) AS position FROM lineitem")
def sort_multi_order(spark, d):
    return in_order(ops.sort(ops.project(table(spark, d, "lineitem"), ["l_shipdate", "l_extendedprice", "l_quantity"]), "(l_shipdate) AND (l_extendedprice) AND (l_quantity)"))


@query("SELECT s_suppkey, s_acctbal, CAST(row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS BIGINT) AS position FROM supplier")
def sort_write_order(spark, d):
    path = scratch(spark, "sorted")
    ops.save_sorted(ops.project(table(spark, d, "supplier"), ["s_suppkey", "s_acctbal"]), "(s_acctbal) AND (s_suppkey)", path)
    return ops.stored_positions(spark, path)


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem")
def row_count(spark, d):
    df = table(spark, d, "lineitem")
    return values(spark, "n long, total long", (df.count(), ops.sum_of(df, "(l_linenumber)").first()["sum"]))


@query("SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'o_custkey', CAST(2 AS BIGINT)), (2, 'o_orderkey', 2)) t(position, key, n_keys)")
def order_persistence(spark, d):
    orders = ops.project(table(spark, d, "orders"), ["o_orderkey", "o_custkey"])
    t = tables.create(spark, scratch(spark, "sorted"), orders.schema, "sorted", "(o_custkey) AND (o_orderkey)")
    keys = tables.open_table(spark, t.path).keys
    return values(spark, "position long, key string, n_keys long", *[(i, k, len(keys)) for i, k in enumerate(keys, 1)])


@query("SELECT * FROM (VALUES ('copied', CAST(266666 AS BIGINT)), ('json', 266666), ('renamed', 266666), ('text', 266666)) t(form, estimate)")
def stats_write_read(spark, d):
    stats, step = estimates.start(["supplier", "partsupp"], []), "(s_suppkey = ps_suppkey)"
    rels = ["supplier", "partsupp"]
    with tempfile.TemporaryDirectory() as folder:  # a few lines that only the driver reads
        stats.write(f"{folder}/json")
        stats.write_text(f"{folder}/text")
        forms = {"copied": stats.copy(), "json": Statistics.read(f"{folder}/json"), "text": Statistics.read(f"{folder}/text")}
    rows = []
    for name, s in forms.items():
        s.apply(step, rels)
        rows.append((name, s.estimate("(s_suppkey>1000)", rels)))
    other = estimates.start(["supplier", "partsupp"], [("s", "supplier")])
    other.apply("(s.s_suppkey = ps_suppkey)", ["s", "partsupp"])
    return values(spark, "form string, estimate long", *rows, ("renamed", other.estimate("(s.s_suppkey>1000)", ["s", "partsupp"])))


@query("SELECT * FROM (VALUES ('part of a group', TRUE), ('relation not named', TRUE), ('whole group', FALSE), ('without qualifier', FALSE)) t(name, refused)")
def stats_constraint(spark, d):
    stats = estimates.start(["supplier", "partsupp", "nation"], [])
    stats.apply("(s_suppkey = ps_suppkey)", ["supplier", "partsupp"])
    cases = {
        "part of a group": lambda: stats.estimate("(s_suppkey = 3)", ["supplier"]),
        "relation not named": lambda: stats.estimate("(nation.n_nationkey = 3)", ["supplier", "partsupp"]),
        "whole group": lambda: stats.estimate("(s_suppkey = 3)", ["supplier", "partsupp"]),
        "without qualifier": lambda: stats.estimate("(x.n_nationkey = 3)", ["nation"]),
    }
    return values(spark, "name string, refused boolean", *[(n, refused(f, EngineError)) for n, f in cases.items()])


for _name, (*_, _expected) in estimates.CASES.items():
    QUERIES[_name] = _estimate(_name)
    ORACLES[_name] = f"SELECT CAST({_expected} AS BIGINT) AS estimate"
