"""Queries of the imputation, standardization, deduplication and join operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkclean.functions.keys import composite_key
from sparkclean.operators import dedup, fuzzy, impute, merge, standardize
from sparkclean.plans.cleaning import CleaningPlan, Step
from sparkclean.sources.scratch import scratch_path
from sparkclean.sources.snapshots import Snapshots
from workload.tables import dirty, dirty_sql, table

EVENTS = dirty_sql("dirty_events")

# --- imputation ---------------------------------------------------------------------------------


def _imputed(spark, sf, strategies, keep, **options):
    options.setdefault("drop_threshold", 1.0)
    return impute.handle_missing_values(dirty(spark, sf, "dirty_events"), strategies, **options).df.select(*keep)


def drop_sparse_columns(spark, sf):
    return impute.drop_sparse_columns(dirty(spark, sf, "dirty_events"))


DROP_SPARSE_SQL = f"SELECT event_id, ts, user_id, value, event_type FROM {EVENTS} t"


def impute_mean(spark, sf):
    out = _imputed(spark, sf, {"value": "mean"}, ["event_id", "value"])
    return out.withColumn("value", F.round("value", 6))


MEAN_SQL = f"""
    SELECT event_id, round(coalesce(value, (SELECT avg(value) FROM {EVENTS} u)), 6) AS value FROM {EVENTS} t"""


def impute_median(spark, sf):
    return _imputed(spark, sf, {"value": "median"}, ["event_id", "value"])


MEDIAN_SQL = f"""
    SELECT event_id, coalesce(value, (SELECT quantile_cont(value, 0.5) FROM {EVENTS} u)) AS value FROM {EVENTS} t"""


def impute_mode(spark, sf):
    return _imputed(spark, sf, {"event_type": "mode", "props": "mode"}, ["event_id", "event_type", "props"])


def _mode_sql(c: str) -> str:
    return (f"(SELECT {c} FROM {EVENTS} u WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)")


MODE_SQL = f"""
    SELECT event_id, coalesce(event_type, {_mode_sql('event_type')}) AS event_type,
           coalesce(props, {_mode_sql('props')}) AS props FROM {EVENTS} t"""


def impute_ffill(spark, sf):
    return _imputed(spark, sf, {"value": "ffill", "event_type": "ffill"}, ["event_id", "user_id", "value", "event_type"],
                    order_by="event_id", partition_by="user_id")


FFILL_SQL = f"""
    SELECT event_id, user_id, last_value(value IGNORE NULLS) OVER w AS value,
           last_value(event_type IGNORE NULLS) OVER w AS event_type
    FROM {EVENTS} t WINDOW w AS (PARTITION BY user_id ORDER BY event_id
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


def impute_ffill_global(spark, sf):
    """Over the whole table, by ranges of the order column instead of one window."""
    return _imputed(spark, sf, {"value": "ffill", "props": "ffill"}, ["event_id", "value", "props"],
                    order_by="ts", max_group_rows=0)


FFILL_GLOBAL_SQL = f"""
    SELECT event_id, last_value(value IGNORE NULLS) OVER w AS value, last_value(props IGNORE NULLS) OVER w AS props
    FROM {EVENTS} t WINDOW w AS (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


def impute_bfill(spark, sf):
    """Backwards within users, with every user's rows cut into ranges."""
    return _imputed(spark, sf, {"value": "bfill"}, ["event_id", "user_id", "value"],
                    order_by="event_id", partition_by="user_id", max_group_rows=0)


BFILL_SQL = f"""
    SELECT event_id, user_id, first_value(value IGNORE NULLS) OVER w AS value
    FROM {EVENTS} t WINDOW w AS (PARTITION BY user_id ORDER BY event_id
                                 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"""


def impute_drop_row(spark, sf):
    return _imputed(spark, sf, {"value": "drop_row", "event_type": "drop_row"}, ["event_id", "value", "event_type"])


DROP_ROW_SQL = f"""
    SELECT event_id, value, event_type FROM {EVENTS} t WHERE value IS NOT NULL AND event_type IS NOT NULL"""


def impute_constant(spark, sf):
    return _imputed(spark, sf, {"value": "constant", "event_type": "constant"}, ["event_id", "value", "event_type"],
                    constant_fill_values={"value": -1.0, "event_type": "unknown"})


CONSTANT_SQL = f"""
    SELECT event_id, coalesce(value, -1.0) AS value, coalesce(event_type, 'unknown') AS event_type FROM {EVENTS} t"""

CHAIN = {"event_type": "drop_row", "value": "median"}


def impute_chain(spark, sf):
    """The median sees only the rows that the dropping before it left; the sparse column goes first."""
    df = dirty(spark, sf, "dirty_events")
    return impute.handle_missing_values(df, CHAIN, drop_threshold=0.5).df


CHAIN_SQL = f"""
    WITH t AS (SELECT event_id, ts, user_id, value, event_type FROM {EVENTS} x WHERE event_type IS NOT NULL)
    SELECT event_id, ts, user_id, coalesce(value, (SELECT quantile_cont(value, 0.5) FROM t)) AS value, event_type
    FROM t"""


def impute_report(spark, sf):
    result = impute.handle_missing_values(
        dirty(spark, sf, "dirty_events"), {"value": "ffill", "event_type": "mode", "props": "constant"},
        constant_fill_values={"props": "{}"}, drop_threshold=1.0, order_by="event_id", partition_by="user_id")
    return impute.impute_report(result)


IMPUTE_REPORT_SQL = f"""
    WITH f AS (SELECT last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id
                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM {EVENTS} t),
    n AS (SELECT count(*) - count(value) AS v, count(*) - count(event_type) AS e, count(*) - count(props) AS p
          FROM {EVENTS} t),
    a AS (SELECT count(*) - count(value) AS v FROM f)
    SELECT 'value' AS name, 'ffill' AS strategy, n.v AS cells_targeted, a.v AS nulls_after, n.v - a.v AS cells_modified
    FROM n, a
    UNION ALL SELECT 'event_type', 'mode', e, 0, e FROM n
    UNION ALL SELECT 'props', 'constant', p, 0, p FROM n"""

# --- standardization ----------------------------------------------------------------------------


def snake_case_headers(spark, sf):
    df = table(spark, sf, "customer").toDF("Customer Key", "CustomerName", "nation-key", " Acct  Bal ($)", "MKTSegment")
    return standardize.rename_headers(df)[0]


SNAKE_SQL = """
    SELECT c_custkey AS customer_key, c_name AS customer_name, c_nationkey AS nation_key, c_acctbal AS acct_bal,
           c_mktsegment AS mktsegment FROM customer"""


def _only(**on):
    return {"normalize_headers": False, "parse_dates": False, "parse_currency": False, "parse_numerics": False, **on}


def date_override(spark, sf):
    """Text in one known format; low priority orders hold no date."""
    text = F.when(F.col("o_orderpriority") == "5-LOW", "pending").otherwise(F.date_format("o_orderdate", "dd.MM.yyyy"))
    df = table(spark, sf, "orders").select("o_orderkey", text.alias("ordered"))
    out = standardize.standardize_formats(df, column_overrides={"ordered": "%d.%m.%Y"}, **_only()).df
    return out.withColumn("ordered", F.col("ordered").cast("timestamp_ntz"))


DATE_OVERRIDE_SQL = """
    SELECT o_orderkey, try_strptime(text, '%d.%m.%Y') AS ordered
    FROM (SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'pending'
                                  ELSE strftime(o_orderdate, '%d.%m.%Y') END AS text FROM orders)"""


_LOOSE = ["%-m/%-d/%Y", "%-m/%-d/%y", "%A, %B %-d, %Y"]


def date_override_loose(spark, sf):
    """Text without leading zeros, with years of two digits and with names of days, each in its own column."""
    day = F.col("o_orderdate")
    texts = [F.date_format(day, "M/d/yyyy"), F.date_format(day, "M/d/yy"), F.date_format(day, "EEEE, MMMM d, yyyy")]
    df = table(spark, sf, "orders").select("o_orderkey", *[t.alias(f"d{k}") for k, t in enumerate(texts)])
    out = standardize.standardize_formats(
        df, column_overrides={"d0": "%m/%d/%Y", "d1": "%m/%d/%y", "d2": "%A, %B %d, %Y"}, **_only()).df
    return out.select("o_orderkey", *[F.col(f"d{k}").cast("timestamp_ntz").alias(f"d{k}") for k in range(3)])


LOOSE_SQL = f"""
    SELECT o_orderkey, {', '.join(f"strptime(strftime(o_orderdate, '{f}'), '{f.replace('-', '')}') AS d{k}" for k, f in enumerate(_LOOSE))}
    FROM orders"""

# Formats as Spark writes them, and as the checking engine does; the order's number tells which one its date has.
_WIDE = [("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'", "%Y-%m-%dT%H:%M:%S.%fZ"), ("yyyy-MM-dd'T'HH:mm:ss'+00:00'", "%Y-%m-%dT%H:%M:%S+00:00"),
         ("MM/dd/yyyy hh:mm a", "%m/%d/%Y %I:%M %p"), ("dd-MMM-yyyy", "%d-%b-%Y"), ("MM/dd/yy", "%m/%d/%y"),
         ("yyyy-MM-dd HH:mm:ss.SSSSSSSSS", "%Y-%m-%d %H:%M:%S.%n"), ("EEEE, MMMM d, yyyy", "%A, %B %-d, %Y"), ("d MMM yyyy", "%-d %b %Y")]


def parse_dates_wide(spark, sf):
    """Eight ways to write a date in one column, months in lower case among them."""
    which, day = F.pmod("o_orderkey", F.lit(len(_WIDE))), F.col("o_orderdate")
    text = F.lit(None).cast("string")
    for k, (fmt, _) in enumerate(_WIDE):
        text = F.when(which == k, F.lower(F.date_format(day, fmt)) if k == 7 else F.date_format(day, fmt)).otherwise(text)
    df = table(spark, sf, "orders").select("o_orderkey", text.alias("ordered"))
    out = standardize.standardize_formats(df, **_only(parse_dates=True)).df
    return out.withColumn("ordered", F.col("ordered").cast("timestamp_ntz"))


WIDE_SQL = f"""
    SELECT o_orderkey, CASE o_orderkey % {len(_WIDE)} {' '.join(
        f"WHEN {k} THEN strptime(strftime(o_orderdate, '{f}'), '{f.replace('-d', 'd')}')" for k, (_, f) in enumerate(_WIDE))} END AS ordered
    FROM orders"""


def impute_mean_time(spark, sf):
    """The mean date stands in for the dates of open orders."""
    orders = table(spark, sf, "orders").selectExpr("o_orderkey", "CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END AS ordered")
    out = impute.handle_missing_values(orders, {"ordered": "mean"}, drop_threshold=1.0).df
    return out.select("o_orderkey", F.date_trunc("second", "ordered").cast("timestamp_ntz").alias("ordered"))


MEAN_TIME_SQL = """
    SELECT o_orderkey, date_trunc('second', coalesce(CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END,
           (SELECT make_timestamp(CAST(floor(avg(epoch_us(o_orderdate))) AS BIGINT)) FROM orders WHERE o_orderstatus <> 'O'))) AS ordered
    FROM orders"""


def parse_currency(spark, sf):
    """Prices as $1,234.50; low priority orders have no price yet."""
    price = F.concat(F.lit("$ "), F.format_number("o_totalprice", 2))
    text = F.when(F.col("o_orderpriority") == "5-LOW", "to be set").otherwise(price)
    df = table(spark, sf, "orders").select("o_orderkey", text.alias("price"))
    return standardize.standardize_formats(df, **_only(parse_currency=True)).df


CURRENCY_SQL = """
    SELECT o_orderkey, CASE WHEN o_orderpriority <> '5-LOW' THEN round(o_totalprice, 2) END AS price FROM orders"""


def coerce_numeric(spark, sf):
    """Four columns of number text: whole numbers, a few words, too many words, fractions."""
    negative = F.col("c_acctbal") < 0
    few = F.when(negative, "n/a").otherwise(F.col("c_custkey").cast("string"))
    many = F.when(F.col("c_mktsegment").isin("MACHINERY", "FURNITURE"), "n/a").otherwise(F.col("c_custkey").cast("string"))
    df = table(spark, sf, "customer").select(
        F.col("c_nationkey").cast("string").alias("whole"), few.alias("few_words"), many.alias("many_words"),
        F.concat(F.lit(" "), F.col("c_acctbal").cast("string"), F.lit(" ")).alias("fraction"))
    return standardize.standardize_formats(df, **_only(parse_numerics=True)).df


COERCE_SQL = """
    SELECT CAST(c_nationkey AS BIGINT) AS whole, CASE WHEN c_acctbal >= 0 THEN c_custkey END AS few_words,
           CASE WHEN c_mktsegment IN ('MACHINERY', 'FURNITURE') THEN 'n/a' ELSE CAST(c_custkey AS VARCHAR) END
               AS many_words,
           c_acctbal AS fraction FROM customer"""


def parse_dates(spark, sf):
    """Dates written in four ways, and one column with too few dates to convert."""
    day = F.col("o_orderdate")
    mixed = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.date_format(day, "MM/dd/yyyy"))
        .when(F.col("o_orderpriority") == "2-HIGH", F.date_format(day, "MMM d, yyyy"))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.date_format(day, "yyyy-MM-dd HH:mm:ss"))
        .when((F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "P"), F.lit("someday"))
        .otherwise(F.date_format(day, "yyyy-MM-dd")))
    few = F.when(F.col("o_orderstatus") == "P", F.date_format(day, "yyyy-MM-dd")).otherwise("none")
    df = table(spark, sf, "orders").select("o_orderkey", mixed.alias("ordered"), few.alias("remark"))
    out = standardize.standardize_formats(df, **_only(parse_dates=True)).df
    return out.withColumn("ordered", F.col("ordered").cast("timestamp_ntz"))


DATES_SQL = """
    SELECT o_orderkey, CASE WHEN NOT (o_orderpriority = '5-LOW' AND o_orderstatus = 'P') THEN o_orderdate END AS ordered,
           CASE WHEN o_orderstatus = 'P' THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'none' END AS remark
    FROM orders"""


def standardize_report(spark, sf):
    price = F.concat(F.lit("$"), F.format_number("o_totalprice", 2))
    text = F.when(F.col("o_orderpriority") == "5-LOW", "to be set").otherwise(price)
    df = table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("CustKey"), text.alias("Total Price"),
        F.date_format("o_orderdate", "MM/dd/yyyy").alias("order_date"), F.col("o_orderstatus").alias("status"))
    return standardize.standardize_report(standardize.standardize_formats(df))


STANDARDIZE_REPORT_SQL = """
    WITH n AS (SELECT count(*) AS total, count(*) FILTER (o_orderpriority <> '5-LOW') AS priced FROM orders)
    SELECT 'CustKey' AS name, CAST(1 AS INTEGER) AS change_no, 'now named cust_key' AS change
    UNION ALL SELECT 'Total Price', 1, 'now named total_price'
    UNION ALL SELECT 'cust_key', 1, total || ' texts read as numbers' FROM n
    UNION ALL SELECT 'total_price', 1, priced || ' amounts of money read as numbers' FROM n
    UNION ALL SELECT 'order_date', 1, total || ' texts read as times' FROM n"""

# --- deduplication ------------------------------------------------------------------------------


def dedup_exact(spark, sf):
    return dedup.drop_exact_duplicates(dirty(spark, sf, "line_shapes"))


DEDUP_EXACT_SQL = f"SELECT DISTINCT * FROM {dirty_sql('line_shapes')} t"

VISITS = ["event_id", "user_id", "event_type"]


def dedup_keep_first(spark, sf):
    return dedup.drop_exact_duplicates(dirty(spark, sf, "dirty_events").select(*VISITS), "event_id", "first")


def dedup_keep_last(spark, sf):
    return dedup.drop_exact_duplicates(dirty(spark, sf, "dirty_events").select(*VISITS), "event_id", "last")


def _keep_sql(direction: str) -> str:
    return f"""
    SELECT event_id, user_id, event_type
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id {direction}) AS rn
          FROM {EVENTS} t) WHERE rn = 1"""


def dedup_report(spark, sf):
    return dedup.dedup_report(dedup.deduplicate_dataset(dirty(spark, sf, "line_shapes")))


DEDUP_REPORT_SQL = f"""
    WITH t AS (SELECT * FROM {dirty_sql('line_shapes')} x),
    n AS (SELECT (SELECT count(*) FROM t) AS a, (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS b)
    SELECT a AS rows_before, b AS rows_after, a - b AS exact_removed, CAST(0 AS BIGINT) AS fuzzy_removed,
           a - b AS rows_removed, CAST(1.0 AS DOUBLE) AS confidence FROM n"""


def fuzzy_key(spark, sf):
    df = dirty(spark, sf, "dirty_events")
    return df.select("event_id", composite_key(df, ["event_type", "user_id", "value"]).alias("key"))


FUZZY_KEY_SQL = f"""
    SELECT event_id, coalesce(event_type, '') || ' | ' || coalesce(CAST(user_id AS VARCHAR), '') || ' | ' ||
           coalesce(CAST(value AS VARCHAR), '') AS key FROM {EVENTS} t"""


def fuzzy_pairs_jw(spark, sf):
    out = fuzzy.fuzzy_pairs(table(spark, sf, "supplier"), ["s_name"], 0.97, "jaro_winkler")
    return out.withColumn("score", F.round("score", 4))


FUZZY_JW_SQL = """
    SELECT a.s_name AS key_a, b.s_name AS key_b, round(100 * jaro_winkler_similarity(a.s_name, b.s_name), 4) AS score
    FROM (SELECT DISTINCT s_name FROM supplier) a JOIN (SELECT DISTINCT s_name FROM supplier) b ON a.s_name < b.s_name
    WHERE jaro_winkler_similarity(a.s_name, b.s_name) >= 0.97"""


def fuzzy_pairs_subset(spark, sf):
    """At a threshold of 1 the token-set score asks for one word set to hold the other."""
    documents = table(spark, sf, "documents").select(F.col("source").alias("words")).union(
        table(spark, sf, "documents").select(F.concat_ws(" ", "lang", "source"))).union(
        table(spark, sf, "customer").select(F.concat_ws(" ", "c_mktsegment", "c_name")))
    out = fuzzy.fuzzy_pairs(documents, ["words"], 1.0, "token_set_ratio")
    return out


SUBSET_SQL = """
    WITH w AS (SELECT source AS words FROM documents UNION ALL SELECT lang || ' ' || source FROM documents
               UNION ALL SELECT c_mktsegment || ' ' || c_name FROM customer),
    k AS (SELECT DISTINCT array_to_string(list_sort(list_distinct(string_split(words, ' '))), ' ') AS key FROM w)
    SELECT a.key AS key_a, b.key AS key_b, CAST(100 AS DOUBLE) AS score FROM k a JOIN k b ON a.key < b.key
    WHERE list_has_all(string_split(a.key, ' '), string_split(b.key, ' '))
       OR list_has_all(string_split(b.key, ' '), string_split(a.key, ' '))"""


def _lcs_sql(x: str, y: str) -> str:
    """Length of the longest common subsequence of two texts: one row of the usual table after the other."""
    return f"""list_reduce(string_split({x}, ''), lambda prev, ch: list_reduce(range(1, length({y}) + 1), lambda line, j:
               list_append(line, CASE WHEN substr({y}, CAST(j AS INTEGER), 1) = ch THEN prev[j] + 1
                                      ELSE greatest(prev[j + 1], line[j]) END), [CAST(0 AS BIGINT)]),
               list_transform(range(0, length({y}) + 1), lambda i: CAST(0 AS BIGINT)))[-1]"""


def _words_sql(*columns: str) -> str:
    words = " || ' ' || ".join(columns)
    return f"list_sort(list_distinct(string_split({words}, ' ')))"


def _token_links_sql(keys: str, extra: str = "true") -> str:
    """Pairs of keys (sorted distinct words) with their token-set score. `extra` may leave out pairs that can't reach it."""
    return f"""
    w AS (SELECT key, string_split(key, ' ') AS words FROM {keys}),
    p AS (SELECT a.key AS key_a, b.key AS key_b, list_filter(a.words, lambda t: list_contains(b.words, t)) AS shared,
                 array_to_string(list_filter(a.words, lambda t: NOT list_contains(b.words, t)), ' ') AS x,
                 array_to_string(list_filter(b.words, lambda t: NOT list_contains(a.words, t)), ' ') AS y
          FROM w a JOIN w b ON a.key < b.key),
    q AS (SELECT *, length(array_to_string(shared, ' ')) AS base, least(len(shared), 1) AS gap FROM p WHERE {extra}),
    r AS (SELECT *, CASE WHEN x = '' OR y = '' THEN 0 ELSE {_lcs_sql('x', 'y')} END AS same FROM q),
    links AS MATERIALIZED (SELECT key_a, key_b, CASE WHEN gap = 1 AND (x = '' OR y = '') THEN 100.0 ELSE greatest(
                  100.0 * (2 * (base + gap) + 2 * same) / (2 * (base + gap) + length(x) + length(y)),
                  CASE WHEN gap = 1 THEN 200.0 * base / (2 * base + gap + least(length(x), length(y))) ELSE 0 END) END AS score
              FROM r)"""


def fuzzy_pairs_token(spark, sf):
    out = fuzzy.fuzzy_pairs(table(spark, sf, "part"), ["p_name", "p_type"], 0.85, "token_set_ratio")
    return out.withColumn("score", F.round("score", 4))


PART_KEYS = f"(SELECT DISTINCT array_to_string({_words_sql('p_name', 'p_type')}, ' ') AS key FROM part)"
TOKEN_SQL = f"""
    WITH {_token_links_sql(PART_KEYS)}
    SELECT key_a, key_b, CAST(round(score, 4) AS DOUBLE) AS score FROM links WHERE score >= 85 - 1e-9"""


def fuzzy_pairs_partial(spark, sf):
    out = fuzzy.fuzzy_pairs(table(spark, sf, "part"), ["p_name"], 0.7, "partial_ratio")
    return out.withColumn("score", F.round("score", 4))


PARTIAL_SQL = f"""
    WITH k AS (SELECT DISTINCT p_name AS key FROM part),
    p AS (SELECT a.key AS key_a, b.key AS key_b, a.key AS s, b.key AS l FROM k a JOIN k b ON a.key < b.key AND length(a.key) <= length(b.key)
          UNION ALL
          SELECT a.key, b.key, b.key, a.key FROM k a JOIN k b ON a.key < b.key AND length(a.key) >= length(b.key)),
    starts AS (SELECT *, unnest(range(1 - length(s), length(l))) AS pos FROM p),
    windows AS (SELECT DISTINCT key_a, key_b, s, substr(l, CAST(greatest(pos, 0) + 1 AS INTEGER), CAST(pos + length(s) - greatest(pos, 0) AS INTEGER)) AS w
                FROM starts),
    scores AS (SELECT key_a, key_b, max(200.0 * {_lcs_sql('s', 'w')} / (length(s) + length(w))) AS score FROM windows GROUP BY ALL)
    SELECT key_a, key_b, CAST(round(score, 4) AS DOUBLE) AS score FROM scores WHERE score >= 70 - 1e-9"""


def fuzzy_pairs_wratio(spark, sf):
    return fuzzy.fuzzy_pairs(table(spark, sf, "part"), ["p_name"], 0.86, "wratio")


def _greedy_sql(threshold: float) -> str:
    """Keys left by the scan in the order of n (1, 2, ...): a kept key removes every later one that it is linked to.

    Reads the tables k (key, n) and links (key_a, key_b, score).
    """
    return f"""
    near AS MATERIALIZED (SELECT k.n, list(o.n) AS earlier FROM k
             JOIN (SELECT key_a AS x, key_b AS y FROM links WHERE score >= {100 * threshold} - 1e-9
                   UNION ALL SELECT key_b, key_a FROM links WHERE score >= {100 * threshold} - 1e-9) l ON l.x = k.key
             JOIN k o ON o.key = l.y AND o.n < k.n GROUP BY k.n),
    scan AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS kept
             UNION ALL
             SELECT scan.n + 1, CASE WHEN list_has_any(scan.kept, coalesce(near.earlier, [])) THEN scan.kept
                                     ELSE list_append(scan.kept, scan.n + 1) END
             FROM scan LEFT JOIN near ON near.n = scan.n + 1 WHERE scan.n < (SELECT count(*) FROM k)),
    left_over AS (SELECT unnest(kept) AS n FROM (SELECT kept FROM scan ORDER BY n DESC LIMIT 1))"""


def dedup_fuzzy(spark, sf):
    return dedup.deduplicate_dataset(
        table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), exact_dedup=False, fuzzy_dedup=True,
        fuzzy_columns=["c_name", "c_mktsegment"], fuzzy_threshold=0.95, order_by="c_custkey").df


# A pair without a common word needs nearly all letters in common; letters are counted before the costly comparison.
_LETTERS = """(gap = 1 OR 200.0 * list_sum(list_transform(list_distinct(string_split(x, '')), lambda c:
               least(length(x) - length(replace(x, c, '')), length(y) - length(replace(y, c, '')))))
               / (length(x) + length(y)) >= 95 - 1e-9)"""
DEDUP_FUZZY_SQL = f"""
    WITH RECURSIVE rows AS (SELECT *, array_to_string({_words_sql('c_name', 'c_mktsegment')}, ' ') AS key FROM customer),
    k AS MATERIALIZED (SELECT key, row_number() OVER (ORDER BY min(c_custkey)) AS n, min(c_custkey) AS c_custkey FROM rows GROUP BY key),
    {_token_links_sql('k', _LETTERS)}, {_greedy_sql(0.95)}
    SELECT c_custkey, c_name, c_mktsegment FROM left_over JOIN k USING (n) JOIN customer USING (c_custkey)"""


def dedup_fuzzy_last(spark, sf):
    return dedup.deduplicate_dataset(
        table(spark, sf, "part").select("p_partkey", "p_name", "p_type"), exact_dedup=False, fuzzy_dedup=True,
        fuzzy_columns=["p_name", "p_type"], fuzzy_threshold=0.8, order_by="p_partkey", dedup_keep="last").df


DEDUP_LAST_SQL = f"""
    WITH RECURSIVE rows AS (SELECT *, array_to_string({_words_sql('p_name', 'p_type')}, ' ') AS key FROM part),
    k AS MATERIALIZED (SELECT key, row_number() OVER (ORDER BY max(p_partkey) DESC) AS n, max(p_partkey) AS p_partkey FROM rows GROUP BY key),
    {_token_links_sql('k')}, {_greedy_sql(0.8)}
    SELECT p_partkey, p_name, p_type FROM left_over JOIN k USING (n) JOIN part USING (p_partkey)"""


def _near_names(spark, sf, keep):
    return dedup.deduplicate_dataset(
        table(spark, sf, "supplier").select("s_suppkey", "s_name"), exact_dedup=False, fuzzy_dedup=True, fuzzy_columns=["s_name"],
        fuzzy_threshold=0.97, fuzzy_algorithm="jaro_winkler", order_by="s_suppkey", dedup_keep=keep)


def dedup_fuzzy_jw(spark, sf):
    return _near_names(spark, sf, "first").df


def dedup_report_fuzzy(spark, sf):
    return dedup.dedup_report(_near_names(spark, sf, "last"))


def _near_names_sql(pick: str, direction: str) -> str:
    return f"""
    k AS MATERIALIZED (SELECT s_name AS key, row_number() OVER (ORDER BY {pick}(s_suppkey) {direction}) AS n, {pick}(s_suppkey) AS s_suppkey
          FROM supplier GROUP BY s_name),
    links AS (SELECT a.key AS key_a, b.key AS key_b, 100 * jaro_winkler_similarity(a.key, b.key) AS score
              FROM k a JOIN k b ON a.key < b.key), {_greedy_sql(0.97)}"""


DEDUP_JW_SQL = f"""
    WITH RECURSIVE {_near_names_sql('min', 'ASC')}
    SELECT s_suppkey, s_name FROM left_over JOIN k USING (n) JOIN supplier USING (s_suppkey)"""
REPORT_FUZZY_SQL = f"""
    WITH RECURSIVE {_near_names_sql('max', 'DESC')},
    c AS (SELECT (SELECT count(*) FROM supplier) AS a, (SELECT count(*) FROM left_over) AS b)
    SELECT a AS rows_before, b AS rows_after, CAST(0 AS BIGINT) AS exact_removed, a - b AS fuzzy_removed, a - b AS rows_removed,
           CAST(0.85 AS DOUBLE) AS confidence FROM c"""


# --- joins --------------------------------------------------------------------------------------


def _sides(spark, sf):
    """Documents and their labels (which cover part of them); English documents have lost their key."""
    left = table(spark, sf, "documents").selectExpr(
        "CASE WHEN lang = 'en' AND source = 'src1' THEN NULL ELSE doc_id END AS doc_id", "lang", "source", "n_chars")
    right = table(spark, sf, "labels").selectExpr(
        "CASE WHEN quality = 0 AND toxic = 1 THEN NULL ELSE doc_id END AS doc_id", "quality", "toxic AS source")
    return left, right


_LEFT = """(SELECT CASE WHEN lang = 'en' AND source = 'src1' THEN NULL ELSE doc_id END AS doc_id, lang, source,
                   n_chars FROM documents)"""
_RIGHT = """(SELECT CASE WHEN quality = 0 AND toxic = 1 THEN NULL ELSE doc_id END AS doc_id, quality,
                    toxic AS source FROM labels)"""


def _merge(how):
    def run(spark, sf):
        left, right = _sides(spark, sf)
        return merge.merge_datasets(left, right, "doc_id", how).df
    return run


def _merge_sql(how: str) -> str:
    return f"""
    SELECT coalesce(l.doc_id, r.doc_id) AS doc_id, l.lang, l.source, l.n_chars, r.quality, r.source AS source_right
    FROM {_LEFT} l {how.upper()} JOIN {_RIGHT} r ON l.doc_id IS NOT DISTINCT FROM r.doc_id"""


def merge_suffix(spark, sf):
    """Orders with customers; a right-hand column name that is already taken gets the next free suffix."""
    left = table(spark, sf, "orders").selectExpr(
        "o_custkey AS custkey", "o_orderkey", "o_totalprice AS amount", "o_orderstatus AS amount_right")
    right = table(spark, sf, "customer").selectExpr("c_custkey AS custkey", "c_acctbal AS amount", "c_name")
    return merge.merge_datasets(left, right, "custkey", "inner").df


SUFFIX_SQL = """
    SELECT o_custkey AS custkey, o_orderkey, o_totalprice AS amount, o_orderstatus AS amount_right,
           c_acctbal AS amount_right2, c_name
    FROM orders JOIN customer ON o_custkey = c_custkey"""


def merge_hot_key(spark, sf):
    """Events with totals per event type, one of which has another name there: a few keys hold all rows."""
    events = dirty(spark, sf, "dirty_events")
    kind = F.expr("CASE WHEN event_type = 'click' THEN 'tap' ELSE event_type END").alias("event_type")
    totals = events.groupBy(kind).agg(F.count("value").alias("known_values"))
    return merge.merge_datasets(events.select("event_type", "event_id"), totals, "event_type", "outer", hot_key_rows=1000).df


HOT_SQL = f"""
    WITH r AS (SELECT CASE WHEN event_type = 'click' THEN 'tap' ELSE event_type END AS event_type, count(value) AS known_values
               FROM {EVENTS} t GROUP BY 1)
    SELECT coalesce(l.event_type, r.event_type) AS event_type, event_id, known_values
    FROM {EVENTS} l FULL JOIN r ON l.event_type IS NOT DISTINCT FROM r.event_type"""


def join_key_duplicates(spark, sf):
    return merge.join_key_duplicates(*_sides(spark, sf), "doc_id")


KEY_DUPLICATES_SQL = f"""
    SELECT (SELECT CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM {_LEFT} l GROUP BY doc_id))
               AS left_duplicates,
           (SELECT CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM {_RIGHT} r GROUP BY doc_id))
               AS right_duplicates"""


def match_stats(spark, sf):
    return merge.match_stats(*_sides(spark, sf), "doc_id")


MATCH_SQL = f"""
    WITH l AS (SELECT DISTINCT doc_id FROM {_LEFT} x WHERE doc_id IS NOT NULL),
    r AS (SELECT DISTINCT doc_id FROM {_RIGHT} x WHERE doc_id IS NOT NULL),
    n AS (SELECT (SELECT count(*) FROM l) AS a, (SELECT count(*) FROM r) AS b,
                 (SELECT count(*) FROM l JOIN r USING (doc_id)) AS m)
    SELECT m AS matched, a - m AS left_unmatched, b - m AS right_unmatched, round(m / greatest(a, 1), 4) AS match_rate
    FROM n"""

# --- a whole plan -------------------------------------------------------------------------------


def cleaning_plan(spark, sf):
    """Standardize, fill, remove copies and join a lookup table; every step is written once and read back."""
    orders = table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("Cust Key"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.concat(F.lit("$"), F.format_number("o_totalprice", 2))).alias("Price"),
        F.date_format("o_orderdate", "MM/dd/yyyy").alias("OrderDate"),
        F.expr("NULLIF(o_orderstatus, 'P')").alias("Status"))
    copies = orders.union(orders.where("Status = 'F'"))
    customers = table(spark, sf, "customer").selectExpr(
        "CASE WHEN c_mktsegment = 'MACHINERY' THEN -c_custkey ELSE c_custkey END AS cust_key", "c_mktsegment AS segment")
    plan = CleaningPlan([
        Step("standardize_formats"),
        Step("handle_missing_values", {"strategy_config": {"status": "mode", "price": "median"}}),
        Step("deduplicate_dataset"),
        Step("merge_datasets", {"right": customers, "join_key": "cust_key", "join_type": "left"}),
    ])
    done = plan.run(copies, Snapshots(spark, scratch_path(spark, "plan")))
    if done.error:
        raise done.error
    return done.df.withColumns({"order_date": F.col("order_date").cast("timestamp_ntz"), "price": F.round("price", 3)})


PLAN_SQL = """
    WITH o AS (SELECT o_custkey AS cust_key,
                      CASE WHEN o_orderpriority <> '5-LOW' THEN round(o_totalprice, 2) END AS price,
                      o_orderdate AS order_date, NULLIF(o_orderstatus, 'P') AS status FROM orders),
    u AS (SELECT * FROM o UNION ALL SELECT * FROM o WHERE status = 'F'),
    f AS (SELECT DISTINCT cust_key, coalesce(price, (SELECT quantile_cont(price, 0.5) FROM u)) AS price, order_date,
                 coalesce(status, (SELECT status FROM u WHERE status IS NOT NULL GROUP BY status
                                   ORDER BY count(*) DESC, status LIMIT 1)) AS status FROM u)
    SELECT cust_key, round(price, 3) AS price, order_date, status, c_mktsegment AS segment
    FROM f LEFT JOIN customer ON CASE WHEN c_mktsegment = 'MACHINERY' THEN -c_custkey ELSE c_custkey END = cust_key"""

QUERIES = {
    "drop_sparse_columns": (drop_sparse_columns, DROP_SPARSE_SQL),
    "impute_mean": (impute_mean, MEAN_SQL),
    "impute_median": (impute_median, MEDIAN_SQL),
    "impute_mode": (impute_mode, MODE_SQL),
    "impute_ffill": (impute_ffill, FFILL_SQL),
    "impute_ffill_global": (impute_ffill_global, FFILL_GLOBAL_SQL),
    "impute_bfill": (impute_bfill, BFILL_SQL),
    "impute_drop_row": (impute_drop_row, DROP_ROW_SQL),
    "impute_constant": (impute_constant, CONSTANT_SQL),
    "impute_chain": (impute_chain, CHAIN_SQL),
    "impute_report": (impute_report, IMPUTE_REPORT_SQL),
    "snake_case_headers": (snake_case_headers, SNAKE_SQL),
    "date_override": (date_override, DATE_OVERRIDE_SQL),
    "date_override_loose": (date_override_loose, LOOSE_SQL),
    "parse_dates_wide": (parse_dates_wide, WIDE_SQL),
    "impute_mean_time": (impute_mean_time, MEAN_TIME_SQL),
    "parse_currency": (parse_currency, CURRENCY_SQL),
    "coerce_numeric": (coerce_numeric, COERCE_SQL),
    "parse_dates": (parse_dates, DATES_SQL),
    "standardize_report": (standardize_report, STANDARDIZE_REPORT_SQL),
    "dedup_exact": (dedup_exact, DEDUP_EXACT_SQL),
    "dedup_keep_first": (dedup_keep_first, _keep_sql("ASC")),
    "dedup_keep_last": (dedup_keep_last, _keep_sql("DESC")),
    "dedup_report": (dedup_report, DEDUP_REPORT_SQL),
    "fuzzy_key": (fuzzy_key, FUZZY_KEY_SQL),
    "fuzzy_pairs_jw": (fuzzy_pairs_jw, FUZZY_JW_SQL),
    "fuzzy_pairs_subset": (fuzzy_pairs_subset, SUBSET_SQL),
    "fuzzy_pairs_token": (fuzzy_pairs_token, TOKEN_SQL),
    "fuzzy_pairs_partial": (fuzzy_pairs_partial, PARTIAL_SQL),
    "fuzzy_pairs_wratio": (fuzzy_pairs_wratio, None),
    "dedup_fuzzy": (dedup_fuzzy, DEDUP_FUZZY_SQL),
    "dedup_fuzzy_jw": (dedup_fuzzy_jw, DEDUP_JW_SQL),
    "dedup_report_fuzzy": (dedup_report_fuzzy, REPORT_FUZZY_SQL),
    "dedup_fuzzy_last": (dedup_fuzzy_last, DEDUP_LAST_SQL),
    "merge_left": (_merge("left"), _merge_sql("left")),
    "merge_right": (_merge("right"), _merge_sql("right")),
    "merge_inner": (_merge("inner"), _merge_sql("inner")),
    "merge_outer": (_merge("outer"), _merge_sql("full")),
    "merge_suffix": (merge_suffix, SUFFIX_SQL),
    "merge_hot_key": (merge_hot_key, HOT_SQL),
    "join_key_duplicates": (join_key_duplicates, KEY_DUPLICATES_SQL),
    "match_stats": (match_stats, MATCH_SQL),
    "cleaning_plan": (cleaning_plan, PLAN_SQL),
}
