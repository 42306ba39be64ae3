"""Registered queries of the table engine, each with its SQL. Carriers are the driver's tables; operation logs are derived from `events`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import coerce, hlc
from .operators import digest, lattice, rga, sync
from .plans.query import Query
from .plans.schema import Column as SchemaColumn
from .plans.schema import Index, TableSchema
from .sources.folder import workspace
from .streaming import feed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def registered(sql: str):
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return put


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Tables as the engine sees them: a key and typed columns.

ORDERS = TableSchema("orders", (SchemaColumn("o_orderkey", "int"), SchemaColumn("o_custkey", "int"), SchemaColumn("o_orderstatus"), SchemaColumn("o_totalprice", "float"), SchemaColumn("o_orderpriority")), (Index("status_cust", ("o_orderstatus", "o_custkey")), Index("priority", ("o_orderpriority",)), Index("price", ("o_totalprice",))))
LINES = TableSchema("lineitem", (SchemaColumn("l_orderkey", "int"), SchemaColumn("l_linenumber", "int"), SchemaColumn("l_quantity", "float"), SchemaColumn("quantity_int", "int"), SchemaColumn("l_returnflag"), SchemaColumn("l_shipdate", "timestamp")))
EVENTS = TableSchema("events", (SchemaColumn("user_id", "int"), SchemaColumn("event_type"), SchemaColumn("value", "float"), SchemaColumn("ts", "timestamp"), SchemaColumn("note")))


def _orders(spark: SparkSession, sf_dir: str) -> Query:
    d = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pk"), "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return Query(d, ORDERS)


def _lines(spark: SparkSession, sf_dir: str) -> Query:
    d = _table(spark, sf_dir, "lineitem")
    return Query(d.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pk"), "l_orderkey", "l_linenumber", "l_quantity", F.col("l_quantity").cast("bigint").alias("quantity_int"), "l_returnflag", F.col("l_shipdate").cast("timestamp").alias("l_shipdate")), LINES)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


# Predicates.

_ORDER_SQL = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE "


def _picked(q: Query) -> DataFrame:
    return q.find().select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@registered(_ORDER_SQL + "o_orderstatus = 'F'")
def filter_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _picked(_orders(spark, sf_dir).where("o_orderstatus", "=", "F"))


@registered(_ORDER_SQL + "o_orderstatus <> 'F'")
def filter_ne(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _picked(_orders(spark, sf_dir).where("o_orderstatus", "!=", "F"))


@registered(_ORDER_SQL + "o_totalprice > 200000.5")
def filter_gt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _picked(_orders(spark, sf_dir).where("o_totalprice", ">", "200000.5"))


@registered(_ORDER_SQL + "o_custkey >= 100")
def filter_gte(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _picked(_orders(spark, sf_dir).where("o_custkey", ">=", 100))


@registered(_ORDER_SQL + "o_orderpriority < '3'")
def filter_lt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _picked(_orders(spark, sf_dir).where("o_orderpriority", "<", "3"))


@registered(_ORDER_SQL + "o_totalprice <= 50000")
def filter_lte(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _picked(_orders(spark, sf_dir).where("o_totalprice", "<=", 50000))


@registered(_ORDER_SQL + "o_custkey IN (3, 7, 11, 13)")
def filter_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _picked(_orders(spark, sf_dir).where("o_custkey", "IN", ["3", 7, 11.9, 13]))


@registered(_ORDER_SQL + "false")
def filter_in_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _picked(_orders(spark, sf_dir).where("o_custkey", "IN", []))


@registered(_ORDER_SQL + "o_custkey > 20 AND o_custkey > 50 AND o_custkey < 90 AND o_orderstatus = 'O'")
def filter_repeated_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _picked(_orders(spark, sf_dir).where("o_custkey", ">", 20).and_("o_custkey", ">", 50).and_("o_custkey", "<", 90).and_("o_orderstatus", "=", "O"))


@registered("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 30 AND l_shipdate < TIMESTAMP '1997-01-01'")
def filter_and_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _lines(spark, sf_dir).where("l_returnflag", "=", "R").and_("l_quantity", ">=", 30).and_("l_shipdate", "<", "1997-01-01T00:00:00Z")
    return q.find().select("l_orderkey", "l_linenumber", "l_quantity")


@registered("SELECT event_id, user_id FROM events WHERE ts >= (SELECT min(ts) + INTERVAL 1 DAY FROM events) AND event_type <> 'click'")
def filter_ts_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir).withColumn("pk", F.col("event_id"))
    start = events.agg(F.date_format(F.min("ts") + F.expr("INTERVAL 1 DAY"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).first()[0]
    return Query(events, EVENTS).where("ts", ">=", start).and_("event_type", "!=", "click").find().select("event_id", "user_id")


@registered("SELECT event_id, event_type FROM events WHERE event_id % 3 <> 0 AND event_type <> 'view'")
def filter_missing_ne(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir).withColumn("pk", F.col("event_id")).withColumn("note", F.when(F.col("event_id") % 3 != 0, F.col("event_type")))
    return Query(events, EVENTS).where("note", "!=", "view").find().select("event_id", F.col("note").alias("event_type"))


@registered("SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS quantity FROM lineitem WHERE CAST(l_quantity AS BIGINT) > 20")
def int_literal_trunc(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _lines(spark, sf_dir).where("quantity_int", ">", 20.7)
    return q.find().select("l_orderkey", "l_linenumber", F.col("quantity_int").alias("quantity"))


@registered("SELECT CAST(o_orderkey AS VARCHAR) AS pk, o_orderkey FROM orders WHERE CAST(o_orderkey AS VARCHAR) >= '5' AND o_orderkey % 10 = 5")
def contains_and_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("pk"), "o_orderkey", F.array((F.col("o_orderkey") % 10).cast("string")).alias("digits"))
    schema = TableSchema("orders", (SchemaColumn("pk"), SchemaColumn("digits", crdt="orset")))
    return Query(d, schema).where("pk", ">=", "5").contains("digits", "5").find().select("pk", "o_orderkey")


# Order and paging.


@registered("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 20 OFFSET 5")
def page_pk_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).ordered("index").order_by(None, True).offset(5).limit(20).find().select("o_orderkey", "o_totalprice")


@registered("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O' AND o_custkey < 500 ORDER BY length(o_orderstatus), o_orderstatus, o_custkey, o_orderkey LIMIT 25 OFFSET 3")
def page_index_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _orders(spark, sf_dir).ordered("index").where("o_orderstatus", "=", "O").and_("o_custkey", "<", 500)
    return q.offset(3).limit(25).find().select("o_orderkey", "o_custkey", "o_orderstatus")


@registered("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority > '1' ORDER BY strlen(o_orderpriority) DESC, o_orderpriority DESC, o_orderkey DESC LIMIT 30")
def page_shortlex(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _orders(spark, sf_dir).ordered("index").where("o_orderpriority", ">", "1").order_by("o_orderpriority", True)
    return q.limit(30).find().select("o_orderkey", "o_orderpriority")


@registered("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15")
def page_column_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).order_by("o_totalprice", True).limit(15).find().select("o_orderkey", "o_totalprice")


@registered("SELECT n_nationkey, n_name FROM nation")
def limit_zero_unlimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "nation").withColumn("pk", F.col("n_nationkey"))
    return Query(d, TableSchema("nation")).limit(0).offset(-1).find().select("n_nationkey", "n_name")


# Types.

@registered("""
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 1700000000000000000 + o_orderkey * 1000 WHEN o_orderkey % 4 = 1 THEN 1700000000000000 + o_orderkey
  WHEN o_orderkey % 4 = 2 THEN 1700000000000 + o_orderkey ELSE 1700000000 + o_orderkey END AS epoch,
  CASE WHEN o_orderkey % 4 = 0 THEN 1700000000000000 + o_orderkey WHEN o_orderkey % 4 = 1 THEN 1700000000000000 + o_orderkey
  WHEN o_orderkey % 4 = 2 THEN (1700000000000 + o_orderkey) * 1000 ELSE (1700000000 + o_orderkey) * 1000000 END AS micros
FROM orders
""")
def epoch_units_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    epoch = F.when(k % 4 == 0, k * 1000 + 1_700_000_000_000_000_000).when(k % 4 == 1, k + 1_700_000_000_000_000).when(k % 4 == 2, k + 1_700_000_000_000).otherwise(k + 1_700_000_000)
    d = _table(spark, sf_dir, "orders").select("o_orderkey", epoch.alias("epoch"))
    return d.select("o_orderkey", "epoch", F.unix_micros(coerce.epoch_like(F.col("epoch"))).alias("micros"))


@registered("""
SELECT event_id, CASE WHEN regexp_full_match(s, '[+-]?[0-9]+') THEN CAST(s AS BIGINT) END AS as_int,
  CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN false END AS as_bool, CAST(trunc(value) AS BIGINT) AS cut
FROM (SELECT event_id, value, CASE event_id % 3 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN ' ' || event_id ELSE event_id || '.5' END AS s FROM events)
""")
def coerce_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = _events(spark, sf_dir), F.col("event_id")
    text = F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 1, F.concat(F.lit(" "), k)).otherwise(F.concat(k, F.lit(".5")))
    flag = F.element_at(F.array(*(F.lit(x) for x in ("True", "f", "yes", "2"))), (k % 4 + 1).cast("int"))
    return e.select("event_id", coerce.int_like(text, "string").alias("as_int"), coerce.bool_like(flag, "string").alias("as_bool"), coerce.int_like(F.col("value"), "double").alias("cut"))


@registered("SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS int_text, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(o_orderdate) % 1000000 = 0 THEN '' ELSE '.' || rtrim(lpad(CAST(epoch_us(o_orderdate) % 1000000 AS VARCHAR), 6, '0'), '0') END || 'Z' AS ts_text FROM orders ")
def stored_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "orders").withColumn("at", F.col("o_orderdate").cast("timestamp"))
    text = lambda c, kind: F.decode(coerce.stored(F.col(c), kind), "utf-8")
    return d.select("o_orderkey", text("o_orderkey", "int").alias("int_text"), text("at", "timestamp").alias("ts_text"))


@registered("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE '.' || rtrim(lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0'), '0') END || 'Z' AS text, epoch_us(ts) AS micros FROM events")
def stored_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timestamps with parts of a second as their column stores them, and read back."""
    stored = coerce.stored(F.col("ts"), "timestamp")
    return _events(spark, sf_dir).select("event_id", F.decode(stored, "utf-8").alias("text"), F.unix_micros(coerce.loaded(stored, "timestamp")).alias("micros"))


# Operation logs.

_OPS = "SELECT *, CAST(user_id AS VARCHAR) AS pk, event_id % 3 AS replica, (epoch_us(ts) // 1000) * 65536 + (event_id & 65535) AS hlc FROM events"
_DAYS = "SELECT *, CAST(user_id AS VARCHAR) AS pk, (epoch_us(date_trunc('day', ts)) // 1000) * 65536 AS hlc FROM events"


def ops(spark: SparkSession, sf_dir: str, coarse: bool = False) -> DataFrame:
    """A write for each event: to the row of its user, by one of three replicas. coarse: stamped by the day alone, so that ties are many."""
    e = _events(spark, sf_dir)
    stamp = hlc.of_timestamp(F.date_trunc("day", "ts"), F.lit(0)) if coarse else hlc.of_timestamp(F.col("ts"), F.col("event_id"))
    return e.select("event_id", F.col("user_id").cast("string").alias("pk"), F.lit("event_type").alias("col"), (F.col("event_id") % 3).alias("replica"), stamp.alias("hlc"), "event_type", "value", "user_id")


def _lww(o: DataFrame) -> DataFrame:
    return o.select("pk", "col", F.col("hlc").alias("ts"), F.encode("event_type", "utf-8").alias("value"))


def _text(c: str = "value") -> Column:
    return F.decode(c, "utf-8").alias(c)


_LWW_SQL = "SELECT pk, hlc AS ts, event_type AS value FROM (SELECT *, row_number() OVER (PARTITION BY pk ORDER BY hlc DESC, event_type) AS r FROM ({ops})) WHERE r = 1"


@registered(f"SELECT pk, value FROM ({_LWW_SQL.format(ops=_OPS)}) WHERE value <> 'view' ORDER BY pk LIMIT 50 OFFSET 2")
def lww_filtered_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: a log of writes merged to the last of each row, decoded, filtered and paged."""
    rows = lattice.wide_lww(lattice.merge_lww(_lww(ops(spark, sf_dir))), {"event_type": "string"})
    schema = TableSchema("users", (SchemaColumn("event_type"),))
    found = Query(rows, schema).where("event_type", "!=", "view").order_by(None).offset(2).limit(50).find()
    return found.select("pk", F.col("event_type").alias("value"))


@registered(_LWW_SQL.format(ops=_OPS))
def lww_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.merge_lww(_lww(ops(spark, sf_dir))).select("pk", "ts", _text())


@registered(_LWW_SQL.format(ops=_DAYS))
def lww_tie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.merge_lww(_lww(ops(spark, sf_dir, True))).select("pk", "ts", _text())


def _counters(o: DataFrame) -> DataFrame:
    """Running sums of each replica: an atom for each write, of which the last has the greatest."""
    by = F.coalesce(F.floor("value"), F.lit(0)).cast("long")
    w = W.partitionBy("pk", "replica").orderBy("event_id").rowsBetween(W.unboundedPreceding, 0)
    up, down = F.when(F.col("event_id") % 4 != 0, by).otherwise(0), F.when(F.col("event_id") % 4 == 0, by).otherwise(0)
    return o.select("pk", "col", F.col("replica").cast("string").alias("node"), F.sum(up).over(w).alias("inc"), F.sum(down).over(w).alias("dec"))


_COUNTER_SQL = f"SELECT pk, CAST(replica AS VARCHAR) AS node, CAST(sum(CASE WHEN event_id % 4 <> 0 THEN coalesce(floor(value), 0) ELSE 0 END) AS BIGINT) AS inc, CAST(sum(CASE WHEN event_id % 4 = 0 THEN coalesce(floor(value), 0) ELSE 0 END) AS BIGINT) AS dec FROM ({_OPS}) GROUP BY ALL"


@registered(_COUNTER_SQL)
def counter_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.merge_counter(_counters(ops(spark, sf_dir))).drop("col")


@registered(f"SELECT pk, CAST(sum(inc) - sum(dec) AS BIGINT) AS value FROM ({_COUNTER_SQL}) GROUP BY pk")
def counter_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.counter_value(lattice.merge_counter(_counters(ops(spark, sf_dir)))).drop("col")


def _tags(o: DataFrame) -> DataFrame:
    return o.select("pk", "col", F.encode("event_type", "utf-8").alias("elem"), F.col("event_id").cast("string").alias("tag"))


def _dead(o: DataFrame) -> DataFrame:
    return o.where("event_id % 5 = 0").select("pk", "col", F.col("event_id").cast("string").alias("tag"), F.col("hlc").alias("ts"))


@registered("SELECT CAST(user_id AS VARCHAR) AS pk, CAST(event_id AS VARCHAR) AS tag, event_type AS elem FROM events WHERE event_id % 5 <> 0")
def orset_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = ops(spark, sf_dir)
    return lattice.merge_orset(_tags(o), _dead(o)).select("pk", "tag", _text("elem"))


@registered("SELECT DISTINCT CAST(user_id AS VARCHAR) AS pk, event_type AS elem FROM events WHERE event_id % 5 <> 0")
def orset_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = ops(spark, sf_dir)
    return lattice.orset_elements(lattice.merge_orset(_tags(o), _dead(o))).select("pk", _text("elem"))


@registered("SELECT CAST(user_id AS VARCHAR) AS pk, bool_or(event_type = 'click') AS contains FROM events WHERE event_id % 5 <> 0 GROUP BY 1")
def orset_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = ops(spark, sf_dir)
    return lattice.orset_contains(lattice.merge_orset(_tags(o), _dead(o)), F.encode(F.lit("click"), "utf-8")).drop("col")


_VERTEX_SQL = """
SELECT CAST(o_custkey AS VARCHAR) AS pk, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS id, (o_orderkey * 7919) % 101 AS ts,
  o_orderkey % 6 = 0 AS deleted, CASE WHEN o_orderkey % 6 = 0 THEN o_orderkey % 4 ELSE 0 END AS deleted_at, o_orderkey
FROM orders
"""


def _vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list for each customer: its orders, each put after the one at a third of its place, so that trees have some depth."""
    k, place = F.col("o_orderkey"), F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    d = _table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("pk"), F.lit("orders").alias("col"), place.cast("long").alias("id"), F.encode(k.cast("string"), "utf-8").alias("value"), (k * 7919 % 101).alias("ts"), (k % 6 == 0).alias("deleted"), F.when(k % 6 == 0, k % 4).otherwise(0).alias("deleted_at"))
    return d.withColumn("origin", F.floor(F.col("id") / 3).cast("long"))


def _replicated(v: DataFrame) -> DataFrame:
    """The lists as three replicas have them: one knows all vertices, one nothing of deletions, one deleted some at other times."""
    return lattice.union([v, v.where("id % 2 = 0").withColumns({"deleted": F.lit(False), "deleted_at": F.lit(0).cast("long")}), v.where("id % 3 = 0").withColumn("deleted_at", F.when(F.col("deleted"), F.col("id") % 3 + 2).otherwise(0).cast("long"))])


@registered(f"""
WITH v AS ({_VERTEX_SQL})
SELECT pk, id, deleted, CASE WHEN NOT deleted THEN 0 WHEN id % 3 = 0 AND deleted_at > 0 THEN least(deleted_at, 2) WHEN id % 3 = 0 THEN 2 ELSE deleted_at END AS deleted_at FROM v
""")
def rga_merge_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.merge_rga(_replicated(_vertices(spark, sf_dir))).select("pk", "id", "deleted", "deleted_at")


_PATH_SQL = f"""
WITH RECURSIVE v AS ({_VERTEX_SQL}),
walk AS (
  SELECT pk, id, deleted, o_orderkey, printf('%03d%06d', 999 - ts, 999999 - id) AS path FROM v WHERE id // 3 = 0
  UNION ALL SELECT v.pk, v.id, v.deleted, v.o_orderkey, walk.path || printf('%03d%06d', 999 - v.ts, 999999 - v.id) FROM v JOIN walk ON v.pk = walk.pk AND v.id // 3 = walk.id AND v.id // 3 > 0
)
"""


@registered(_PATH_SQL + "SELECT pk, row_number() OVER (PARTITION BY pk ORDER BY path) - 1 AS pos, id, deleted FROM walk")
def rga_linearize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rga.linearize(_vertices(spark, sf_dir), head=0).select("pk", "pos", "id", "deleted")


@registered(_PATH_SQL + "SELECT pk, row_number() OVER (PARTITION BY pk ORDER BY path) - 1 AS idx, CAST(o_orderkey AS VARCHAR) AS value FROM walk WHERE NOT deleted")
def rga_live_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rga.live(rga.linearize(_vertices(spark, sf_dir), head=0)).select("pk", "idx", _text())


@registered(_PATH_SQL + "SELECT pk, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY path) AS list FROM walk WHERE NOT deleted GROUP BY pk")
def rga_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = rga.values(rga.linearize(_vertices(spark, sf_dir), head=0))
    return v.select("pk", F.array_join(F.transform("values", lambda x: F.decode(x, "utf-8")), ",").alias("list"))


@registered("""
SELECT pk, path, hash, size FROM (
  SELECT source AS pk, 'docs/' || doc_id || '.txt' AS path, sha256(text) AS hash, strlen(text) AS size,
    row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, '{"path":"docs/' || doc_id || '.txt","hash":"' || sha256(text) || '","size":' || strlen(text) || '}') AS r FROM documents
) WHERE r = 1
""")
def file_lww(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    files = d.select(F.col("source").alias("pk"), F.lit("file").alias("col"), F.col("n_chars").alias("ts"), F.concat(F.lit("docs/"), "doc_id", F.lit(".txt")).alias("path"), F.sha2("text", 256).alias("hash"), F.octet_length("text").cast("long").alias("size"))
    return lattice.merge_file(files).select("pk", "path", "hash", "size")


@registered("""
WITH f AS (SELECT 'docs/' || doc_id AS path, n_chars AS size, CASE WHEN n_chars <= 2048 THEN 1 ELSE greatest(1, CAST(ceil(n_chars / 512.0) AS BIGINT)) END AS chunks FROM documents)
SELECT path, chunk, chunks, chunk * 512 AS "offset", CASE WHEN chunks = 1 THEN size ELSE least(512, size - chunk * 512) END AS length FROM (SELECT *, unnest(generate_series(0, chunks - 1)) AS chunk FROM f)
""")
def file_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    files = d.select(F.concat(F.lit("docs/"), "doc_id").alias("path"), F.col("n_chars").alias("size"), F.lit("").alias("hash"))
    return sync.chunk_plan(files, 2048, 512).drop("hash")


@registered("SELECT source AS path, CAST(max(n_chars) AS BIGINT) AS size FROM documents GROUP BY source")
def file_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    same = d.groupBy("source").agg(F.max("n_chars").alias("size"))
    files = d.join(same, "source").select(F.col("source").alias("path"), F.lit("h").alias("hash"), "size")
    return sync.file_metadata(files).select("path", "size")


@registered("SELECT doc_id, substr(hex(encode(text)), 21, 40) AS part FROM documents WHERE strlen(text) > 10")
def file_read_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.files import read_at

    d = _table(spark, sf_dir, "documents")
    files = d.select(F.col("doc_id").alias("path"), F.encode("text", "utf-8").alias("content"), F.octet_length("text").alias("size"))
    return read_at(files, 10, 20).select(F.col("path").alias("doc_id"), F.hex("bytes").alias("part"))


def _cells(o: DataFrame) -> DataFrame:
    """Three columns of each row: the event's type, its value as text, and its number's last digit."""
    cell = lambda c, v: F.struct(F.lit(c).alias("col"), F.encode(v, "utf-8").alias("value"))
    return o.select("pk", F.col("hlc").alias("ts"), F.explode(F.array(cell("type", F.col("event_type")), cell("digit", (F.col("event_id") % 10).cast("string")), cell("replica", F.col("replica").cast("string")))).alias("c"), "replica").select("pk", "c.col", "ts", "c.value", "replica")


_CELL_SQL = f"""
cells AS (SELECT pk, hlc, replica, 'type' AS col, event_type AS value FROM ({_OPS}) UNION ALL SELECT pk, hlc, replica, 'digit', CAST(event_id % 10 AS VARCHAR) FROM ({_OPS}) UNION ALL SELECT pk, hlc, replica, 'replica', CAST(replica AS VARCHAR) FROM ({_OPS})),
merged AS (SELECT pk, col, hlc AS ts, value FROM (SELECT *, row_number() OVER (PARTITION BY pk, col ORDER BY hlc DESC, value) AS r FROM cells) WHERE r = 1)
"""


@registered(f"WITH {_CELL_SQL} SELECT pk, max(value) FILTER (col = 'type') AS type, CAST(max(value) FILTER (col = 'digit') AS BIGINT) AS digit, max(value) FILTER (col = 'replica') AS replica FROM merged GROUP BY pk")
def row_merge_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = lattice.merge_lww(_cells(ops(spark, sf_dir)).drop("replica"))
    return lattice.wide_lww(merged, {"type": "string", "digit": "int", "replica": "string"})


@registered(f"WITH {_CELL_SQL} SELECT pk, col, ts, value FROM merged WHERE col IN ('type', 'digit')")
def delta_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.delta(lattice.merge_lww(_cells(ops(spark, sf_dir)).drop("replica")), ["type", "digit"]).select("pk", "col", "ts", _text())


@registered(f"WITH {_CELL_SQL} SELECT pk, col, ts, value FROM merged")
def full_sync_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three replicas that merge pairwise, the second twice: as one merge of all writes."""
    cells = _cells(ops(spark, sf_dir))
    a, b, c = ({"lww": lattice.merge_lww(cells.where(F.col("replica") == i).drop("replica"))} for i in range(3))
    return sync.full_sync(sync.full_sync(sync.full_sync(a, b), c), b)["lww"].select("pk", "col", "ts", _text())


@registered(f"WITH o AS ({_OPS}), safe AS (SELECT (epoch_us(min(ts)) // 1000 + 3 * 86400000) * 65536 AS s FROM events) SELECT pk, CAST(event_id AS VARCHAR) AS tag, event_id % 5 = 0 AS dead FROM o, safe WHERE NOT (event_id % 5 = 0 AND hlc < s)")
def gc_orset(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = ops(spark, sf_dir)
    start = o.agg(F.min(hlc.physical(F.col("hlc")))).first()[0]
    tags, dead = lattice.gc_orset(_tags(o), _dead(o), (start + 3 * 86_400_000) << 16)
    left = tags.join(dead.withColumn("dead", F.lit(True)), ["pk", "col", "tag"], "left")
    return left.select("pk", "tag", F.coalesce("dead", F.lit(False)).alias("dead"))


@registered(f"WITH v AS ({_VERTEX_SQL}) SELECT pk, id FROM v WHERE NOT (deleted AND deleted_at > 0 AND deleted_at < 3 AND NOT EXISTS (SELECT 1 FROM v AS c WHERE c.pk = v.pk AND c.id // 3 = v.id))")
def gc_rga_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.gc_rga(_vertices(spark, sf_dir), 3).select("pk", "id")


_PEERS = "SELECT CAST(user_id AS VARCHAR) AS peer, max(epoch_us(ts) // 1000) AS millis, max((epoch_us(ts) // 1000) * 65536) AS clock, max(event_id) % 3 AS gc_floor FROM events GROUP BY user_id"


def _peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    millis = F.unix_millis("ts")
    return _events(spark, sf_dir).groupBy(F.col("user_id").cast("string").alias("peer")).agg(F.max(millis).alias("millis"), F.max(hlc.pack(millis, F.lit(0))).alias("clock"), (F.max("event_id") % 3).alias("gc_floor"))


@registered(f"SELECT peer, CASE WHEN gc_floor = 1 THEN 'pass' WHEN gc_floor > 1 THEN 'full_sync' ELSE 'block' END AS action FROM ({_PEERS})")
def gc_floor_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _peers(spark, sf_dir).select("peer", sync.floor_gate(F.col("gc_floor"), F.lit(1)).alias("action"))


@registered(f"SELECT (min(clock) >> 16 << 16) - (CAST(30000 AS BIGINT) << 16) AS safe_ts FROM ({_PEERS})")
def safe_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.safe_timestamp(_peers(spark, sf_dir), 1 << 62)


@registered(f"WITH p AS ({_PEERS}), n AS (SELECT max(millis) AS top FROM p) SELECT peer, top - millis < 60000 AS online, CASE WHEN top - millis >= 60000 OR greatest(top - millis, 0) > 5000 THEN 'full_sync' ELSE 'clock_update' END AS rejoin FROM p, n")
def rejoin_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    beats = _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("peer"), F.unix_millis("ts").alias("millis"), hlc.pack(F.unix_millis("ts"), F.lit(0)).alias("clock"), F.lit(0).alias("gc_floor"))
    top = beats.agg(F.max("millis")).first()[0]
    return sync.heartbeats(beats, top, top << 16).select("peer", "online", "rejoin")


# Clocks.


@registered(f"SELECT event_id, hlc FROM ({_OPS})")
def hlc_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops(spark, sf_dir).select("event_id", "hlc")


@registered(f"SELECT event_id, hlc >> 16 AS physical, hlc & 65535 AS logical FROM ({_OPS})")
def hlc_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops(spark, sf_dir).select("event_id", hlc.physical(F.col("hlc")).alias("physical"), hlc.logical(F.col("hlc")).alias("logical"))


@registered(f"SELECT event_id, (greatest((hlc >> 16) - event_id * 1000000000, 0) << 16) | (hlc & 65535) AS less, (((hlc >> 16) + 30000) << 16) | (hlc & 65535) AS more FROM ({_OPS})")
def hlc_sub_physical(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("hlc")
    return ops(spark, sf_dir).select("event_id", hlc.sub_physical(c, F.col("event_id") * 1_000_000_000).alias("less"), hlc.add_physical(c, 30_000).alias("more"))


@registered(f"WITH o AS ({_OPS}), n AS (SELECT max(hlc) AS top FROM o) SELECT event_id, (top >> 16) - (hlc >> 16) > 86400000 AS stale, CASE WHEN top > hlc THEN 1 ELSE 0 END AS cmp FROM o, n")
def hlc_is_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = ops(spark, sf_dir)
    top = F.lit(o.agg(F.max("hlc")).first()[0])
    return o.select("event_id", hlc.is_stale(top, F.col("hlc"), 86_400_000).alias("stale"), hlc.compare(top, F.col("hlc")).alias("cmp"))


# Digests.

_ROW_SQL = "SELECT md5(CAST(o_orderkey AS VARCHAR)) AS key, sha256(o_orderstatus || '|' || o_custkey || '|' || o_orderpriority) AS digest, o_orderkey FROM orders"
_LEAF_SQL = f"SELECT 4 AS level, substring(key, 1, 4) AS prefix, sha256(unhex(string_agg('00' || key || digest, '' ORDER BY key))) AS hash FROM ({_ROW_SQL}) GROUP BY 2"


def _up(below: str) -> str:
    return f"SELECT level - 1 AS level, substring(prefix, 1, length(prefix) - 1) AS prefix, sha256(unhex(string_agg('01' || hex(substring(prefix, length(prefix), 1)) || hash, '' ORDER BY prefix))) AS hash FROM ({below}) GROUP BY 1, 2"


_LEVELS = [_LEAF_SQL]
for _ in range(4):
    _LEVELS.append(_up(_LEVELS[-1]))


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "orders")
    return d.select(F.md5(F.col("o_orderkey").cast("string")).alias("key"), F.sha2(F.concat_ws("|", "o_orderstatus", "o_custkey", "o_orderpriority"), 256).alias("digest"), "o_orderkey")


@registered("SELECT CAST(user_id AS VARCHAR) AS pk, sha256(string_agg(DISTINCT '[\"' || event_type || '\",\"' || (event_id % 7) || '\"]', chr(10) ORDER BY '[\"' || event_type || '\",\"' || (event_id % 7) || '\"]')) AS digest FROM events GROUP BY user_id")
def row_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    atoms = _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("pk"), "event_type", (F.col("event_id") % 7).alias("d"))
    return digest.row_digests(atoms, ["event_type", "d"])


@registered(_LEAF_SQL)
def merkle_leaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.leaves(_hashed(spark, sf_dir))


@registered(" UNION ALL ".join(f"SELECT * FROM ({x})" for x in _LEVELS))
def merkle_internal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.stored_tree(_hashed(spark, sf_dir), workspace(spark))


@registered(f"SELECT hash FROM ({_LEVELS[4]})")
def merkle_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.stored_tree(_hashed(spark, sf_dir), workspace(spark)).where("level = 0").select("hash")


def _changed(rows: DataFrame) -> DataFrame:
    """As another replica has them: without some rows, and with some others changed."""
    return rows.where("o_orderkey % 97 <> 0").withColumn("digest", F.when(F.col("o_orderkey") % 89 == 0, F.sha2("digest", 256)).otherwise(F.col("digest")))


@registered(f"SELECT key, digest FROM ({_ROW_SQL}) WHERE o_orderkey % 97 = 0 OR o_orderkey % 89 = 0")
def merkle_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    mine = _hashed(spark, sf_dir)
    theirs = _changed(mine)
    at = workspace(spark)
    differing = digest.tree_diff(digest.stored_tree(mine, at), digest.stored_tree(theirs, at))
    return digest.rows_to_send(mine.select("key", "digest"), theirs.select("key", "digest"), differing)


@registered(f"SELECT key, digest FROM ({_ROW_SQL}) WHERE o_orderkey % 97 = 0 OR o_orderkey % 89 = 0")
def digest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    mine = _hashed(spark, sf_dir)
    return digest.digest_diff(mine.select("key", "digest"), _changed(mine).select("key", "digest"))


@registered(" UNION ALL ".join(f"SELECT * FROM ({x})" for x in _LEVELS))
def merkle_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree of changed rows, brought to that of the true ones by way of the touched leaves."""
    mine = _hashed(spark, sf_dir)
    touched = mine.where("o_orderkey % 97 = 0 or o_orderkey % 89 = 0").select("key")
    at = workspace(spark)
    return digest.refreshed(digest.stored_tree(_changed(mine), at), mine, touched, at)


# Feeds.


@registered("SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS pk FROM events WHERE event_id > 500 AND event_type IN ('click', 'purchase')")
def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    log = e.select(F.col("event_id").alias("seq"), F.lit("users").alias("tbl"), F.col("user_id").cast("string").alias("pk"), F.col("event_type").alias("col"), F.lit("lww").alias("kind"), F.lit("a").alias("source"))
    return feed.since(feed.changes(log, ["users"], ["click", "purchase"]), 500).select("seq", "pk")


@registered("SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS pk FROM events WHERE event_id % 3 = 1 ORDER BY event_id DESC LIMIT 1")
def change_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    log = e.select(F.col("event_id").alias("seq"), F.lit("users").alias("tbl"), F.col("user_id").cast("string").alias("pk"), F.lit(None).cast("string").alias("col"), F.lit("lww").alias("kind"), (F.col("event_id") % 3).cast("string").alias("source"))
    return feed.since(feed.changes(log, local_only=True, replica="1"), 0, latest_only=True).select("seq", "pk")
