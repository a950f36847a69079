"""Operations on lists, maps and strings, branches and bounded loops."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import canvas as V

from .base import query, table


def turns(spark, d):
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", F.length("text").cast("long").alias("n"))))
    return table(spark, d, "conversations").groupBy("conv_id").agg(rows.alias("l"))


LISTS = "l AS (SELECT conv_id, list({'turn': turn, 'role': role, 'n': length(text)} ORDER BY turn) AS l FROM conversations GROUP BY conv_id)"


@query(
    "list_operations",
    f"""WITH {LISTS} SELECT conv_id, l[1].role AS nth, l[len(l)].role AS last, len(l[1:2]) AS head, l[greatest(len(l) - 1, 1)].turn AS tail_first, len(list_filter(l, lambda x: x.role = 'user')) AS users,
 list_max(list_transform(l, lambda x: x.n)) AS longest FROM l""",
)
def list_operations(spark, d):
    rows = turns(spark, d)
    users = V.where(F.col("l"), "role", "=", "user")
    by_size = V.ordered(F.col("l"), [("n", True)])
    return rows.select(
        "conv_id", V.nth(F.col("l"), 1)["role"].alias("nth"), V.nth(F.col("l"), -1)["role"].alias("last"), F.size(V.head(F.col("l"), 2)).cast("long").alias("head"),
        V.tail(F.col("l"), 2)[0]["turn"].alias("tail_first"), F.size(users).cast("long").alias("users"), by_size[0]["n"].alias("longest"),
    )


@query(
    "list_sort",
    f"WITH {LISTS} SELECT conv_id, array_to_string(list_transform(list_sort(list_transform(l, lambda x: {{'role': x.role, 'n': -x.n, 'turn': x.turn}})), lambda x: x.turn), ',') AS turns FROM l",
)
def list_sort(spark, d):
    """By role, then longest first, then turn."""
    out = V.ordered(F.col("l"), [("role", False), ("n", True), ("turn", False)])
    return turns(spark, d).select("conv_id", F.array_join(F.transform(out, lambda x: x["turn"].cast("string")), ",").alias("turns"))


@query(
    "data_operations",
    """SELECT c_custkey, c_name AS full_name, upper(c_mktsegment) AS segment, CAST(c_nationkey AS VARCHAR) AS nation, 2 AS kept FROM customer""",
)
def data_operations(spark, d):
    m = F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment"), F.lit("x"), F.lit(""))
    m = V.combine(V.rename_keys(V.remove_empty(m), {"name": "full_name"}), F.create_map(F.lit("nation"), F.col("c_nationkey").cast("string")))
    m = V.append_or_update(m, {"segment": F.upper("c_mktsegment")})
    kept = V.select_keys(m, ["full_name", "nation"])
    return table(spark, d, "customer").select("c_custkey", m["full_name"].alias("full_name"), m["segment"].alias("segment"), m["nation"].alias("nation"), F.size(kept).cast("long").alias("kept"))


@query("string_transform", "SELECT p_partkey, len(string_split_regex(p_name || ',,' || p_type, '[ ,]')) AS parts, replace(p_name, ' ', '+') || '++' || replace(p_type, ' ', '+') AS merged FROM part")
def string_transform(spark, d):
    """Split at blanks and commas, empty parts kept, and joined again by the first delimiter given."""
    text = F.concat("p_name", F.lit(",,"), "p_type")
    parts = V.split_all(text, ["+", " ", ","])
    return table(spark, d, "part").select("p_partkey", F.size(parts).cast("long").alias("parts"), V.merge_all(parts, ["+", " ", ","]).alias("merged"))


@query("branch", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'large' WHEN o_orderstatus = 'F' THEN 'done' ELSE 'other' END AS branch, coalesce(nullif(nullif(o_orderstatus, 'O'), 'P'), o_orderpriority) AS first FROM orders")
def branch(spark, d):
    """The first branch whose condition holds, and the first value that is not empty."""
    found = V.switch([(F.col("o_totalprice") > 200000, "large"), (F.col("o_orderstatus") == "F", "done")], "other")
    open_ = F.when(F.col("o_orderstatus").isin("O", "P"), "").otherwise(F.col("o_orderstatus"))
    return table(spark, d, "orders").select("o_orderkey", found.alias("branch"), V.first_filled(open_, F.col("o_orderpriority")).alias("first"))


@query("bounded_loop", "SELECT n_nationkey, CAST(CASE WHEN n_nationkey = 0 THEN 0 ELSE n_nationkey * power(2, ceil(log2(100.0 / n_nationkey))) END AS BIGINT) AS value FROM nation")
def bounded_loop(spark, d):
    """Doubled until it reaches 100, at most 16 times."""
    value = V.repeat_until(F.col("n_nationkey").cast("long"), lambda x: x * 2, lambda x: x >= 100, 16)
    return table(spark, d, "nation").select("n_nationkey", value.alias("value"))


@query("sheet_concat", "SELECT n_name AS name, n_regionkey AS region, NULL::DOUBLE AS balance FROM nation UNION ALL SELECT s_name, NULL, s_acctbal FROM supplier")
def sheet_concat(spark, d):
    """Two sheets below each other; a column that one lacks is null there."""
    a = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    b = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return a.unionByName(b, allowMissingColumns=True)
