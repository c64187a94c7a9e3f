"""Quality and search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillworks.operators import quality, search
from tillworks.registry.base import BOTH, GOLD, RAW_ITEMS, RAW_RECEIPTS, RECEIPTS, clean_receipts, flat, query, ts
from tillworks.registry.gold import gold_table
from tillworks.sources import warehouse as wh

_COLS = "transaction_id, store_id, store_name, customer_id, transaction_ts, total_cents, tender_type, card_last4"
_COLS_SQL = _COLS.replace("transaction_ts", f"{ts('transaction_ts')} AS transaction_ts")
_NAMES = _COLS.split(", ")


@query("dq_receipts", f"""WITH {RAW_RECEIPTS}
SELECT {_COLS_SQL} FROM raw_receipts
WHERE transaction_id IS NOT NULL AND store_id IS NOT NULL AND transaction_ts IS NOT NULL AND total_cents >= 0""")
def q_dq_receipts(spark, folder):
    return flat(quality.gate(wh.raw_receipts(spark, folder), quality.RECEIPT_RULES).select(*_NAMES))


@query("dq_items", f"""WITH {RAW_ITEMS}
SELECT transaction_id, item_seq, sku, quantity, extended_cents FROM raw_items
WHERE transaction_id IS NOT NULL AND sku IS NOT NULL AND quantity > 0 AND extended_cents >= 0""")
def q_dq_items(spark, folder):
    good = quality.gate(wh.raw_items(spark, folder), quality.ITEM_RULES)
    return flat(good.select("transaction_id", "item_seq", "sku", "quantity", "extended_cents"))


_REPORT_SQL = """WITH checks AS (
  SELECT count(*) AS n, count(*) FILTER (WHERE l_partkey IS NULL) AS b1, count(*) FILTER (WHERE NOT coalesce(l_quantity > 10, FALSE)) AS b2,
         count(*) FILTER (WHERE NOT coalesce(l_discount < 0.05, FALSE)) AS b3 FROM lineitem)
SELECT 'has_part' AS rule, n - b1 AS passed, b1 AS dropped, 0::BIGINT AS warned FROM checks
UNION ALL SELECT 'bulk_quantity', n - b2, b2, 0 FROM checks
UNION ALL SELECT 'small_discount', n - b3, 0, b3 FROM checks"""


@query("dq_report", _REPORT_SQL)
def q_dq_report(spark, folder):
    rules = (
        quality.Rule("has_part", "l_partkey IS NOT NULL"), quality.Rule("bulk_quantity", "l_quantity > 10"),
        quality.Rule("small_discount", "l_discount < 0.05", drops=False),
    )
    return quality.dq_report(wh.table(spark, folder, "lineitem"), rules)


@query("validate_receipt", f"""WITH {BOTH},
sums AS (SELECT transaction_id, CAST(sum(extended_cents) AS BIGINT) AS subtotal_cents, CAST(sum(extended_cents) // 11 AS BIGINT) AS tax_cents FROM items GROUP BY 1)
SELECT transaction_id, concat_ws('|',
         CASE WHEN abs(s.subtotal_cents + s.tax_cents - r.total_cents) > 5 THEN 'total differs' END,
         CASE WHEN tender_type NOT IN ('CREDIT', 'DEBIT', 'CASH', 'EBT', 'CHECK', 'GIFT') THEN 'unknown tender' END) AS reasons
FROM receipts r JOIN sums s USING (transaction_id)""")
def q_validate_receipt(spark, folder):
    from tillworks.operators.dedup import dedup_items

    lines = dedup_items(wh.raw_items(spark, folder, with_product=False))
    sums = lines.groupBy("transaction_id").agg(F.sum("extended_cents").alias("subtotal_cents")).withColumn(
        "tax_cents", F.expr("subtotal_cents div 11")
    )
    headers = clean_receipts(spark, folder).drop("subtotal_cents", "tax_cents").join(sums, "transaction_id")
    return flat(quality.validate_receipt(headers).select("transaction_id", "reasons"))


@query("validate_items", f"""WITH {RAW_ITEMS}
SELECT count(*) AS lines, count(*) FILTER (WHERE sku IS NULL) AS rejected FROM raw_items""")
def q_validate_items(spark, folder):
    checked = quality.validate_items(wh.raw_items(spark, folder))
    return checked.agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.size("reasons") > 0).alias("rejected"))


@query("request_bounds", f"""WITH {GOLD}
SELECT transaction_id, CASE WHEN subtotal_cents * 40 > 1000000000 THEN 'subtotal_cents range' ELSE '' END AS reasons FROM gold""")
def q_request_bounds(spark, folder):
    requests = gold_table(spark, folder).withColumns({
        "subtotal_cents": F.col("subtotal_cents") * 40, "items": F.col("items_detail"),
    })
    return flat(quality.request_bounds(requests).select("transaction_id", "reasons"))


def _searched(name: str, criteria: search.Criteria, where: str) -> None:
    @query(name, f"""WITH {RECEIPTS}
SELECT {_COLS_SQL} FROM (SELECT * FROM receipts WHERE {where}
  ORDER BY transaction_ts DESC, transaction_id LIMIT {criteria.limit} OFFSET {criteria.offset})""")
    def run(spark, folder):
        return flat(search.fuzzy_search(wh.raw_receipts(spark, folder), criteria).select(*_NAMES))


_searched(
    "fuzzy_search",
    search.Criteria(store_name="nation_1", date_from="1996-01-01", date_to="1999-12-31", amount_min="1000", amount_max="250000", limit=100, offset=10),
    "store_name ILIKE '%nation_1%' AND transaction_ts >= TIMESTAMP '1996-01-01' AND transaction_ts <= TIMESTAMP '1999-12-31' + INTERVAL 1 DAY "
    "AND total_cents BETWEEN 100000 AND 25000000",
)
_searched("fuzzy_store", search.Criteria(store_name="TION_2", limit=1000), "store_name ILIKE '%tion_2%'")
_searched(
    "fuzzy_dates", search.Criteria(store_id=3, date_from="1997-03-01", date_to="1998-03-01", limit=1000),
    "store_id = 3 AND transaction_ts >= TIMESTAMP '1997-03-01' AND transaction_ts <= TIMESTAMP '1998-03-02'",
)
_searched(
    "fuzzy_amount_range", search.Criteria(amount_min="4.35", amount_max="20000.99", limit=1000),
    "total_cents BETWEEN 435 AND 2000099",
)
_searched(
    "fuzzy_amount_single", search.Criteria(amount_max="150000", limit=1000), "total_cents BETWEEN 13500000 AND 16500000",
)
_searched("fuzzy_card", search.Criteria(card_last4="0101", limit=1000), "card_last4 = '0101'")

_REQUESTS_SQL = """requests AS (
  SELECT c_custkey AS request_id,
         CASE c_mktsegment WHEN 'AUTOMOBILE' THEN c_custkey END AS customer_id,
         CASE c_mktsegment WHEN 'MACHINERY' THEN c_nationkey END AS store_id,
         CASE c_mktsegment WHEN 'BUILDING' THEN lower(substr(n_name, 3)) END AS store_name,
         CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')
              THEN strftime(DATE '1996-01-01' + CAST(c_custkey % 1500 AS INTEGER), '%Y-%m-%d') END AS date_from,
         CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY')
              THEN strftime(DATE '1996-03-01' + CAST(c_custkey % 1500 AS INTEGER), '%Y-%m-%d') END AS date_to,
         CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'FURNITURE') THEN CAST(c_acctbal * 40 AS DECIMAL(20, 2)) END AS amount_min,
         CASE WHEN c_mktsegment = 'FURNITURE' THEN CAST(c_acctbal * 41 AS DECIMAL(20, 2)) END AS amount_max,
         CASE c_mktsegment WHEN 'HOUSEHOLD' THEN lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') END AS card_last4,
         20 AS lim, 2 AS off
  FROM customer JOIN nation ON n_nationkey = c_nationkey)
"""


def search_requests(spark, folder):
    """One search per customer; the market segment decides which criteria it gives."""
    seg, key = F.col("c_mktsegment"), F.col("c_custkey")
    shift = (key % 1500).cast("int")

    def day(start):
        return F.date_format(F.date_add(F.lit(start).cast("date"), shift), "yyyy-MM-dd")

    return wh.table(spark, folder, "customer").join(
        wh.stores(spark, folder), F.col("c_nationkey") == F.col("store_id")
    ).select(
        key.alias("request_id"),
        F.when(seg == "AUTOMOBILE", key).alias("customer_id"),
        F.when(seg == "MACHINERY", F.col("c_nationkey")).alias("store_id"),
        F.when(seg == "BUILDING", F.lower(F.expr("substr(store_name, 3)"))).alias("store_name"),
        F.when(seg.isin("BUILDING", "MACHINERY", "HOUSEHOLD"), day("1996-01-01")).alias("date_from"),
        F.when(seg.isin("BUILDING", "MACHINERY"), day("1996-03-01")).alias("date_to"),
        F.when(seg.isin("AUTOMOBILE", "FURNITURE"), (F.col("c_acctbal") * 40).cast("decimal(20,2)")).alias("amount_min"),
        F.when(seg == "FURNITURE", (F.col("c_acctbal") * 41).cast("decimal(20,2)")).alias("amount_max"),
        F.when(seg == "HOUSEHOLD", F.lpad((key % 10000).cast("string"), 4, "0")).alias("card_last4"),
        F.lit(20).alias("limit"), F.lit(2).alias("offset"),
    )


_PROBLEM_SQL = """CASE WHEN amount_min < 0 THEN 'amount_min_negative' WHEN amount_min > 10000000 THEN 'amount_min_too_large'
  WHEN amount_max < 0 THEN 'amount_max_negative' WHEN amount_max > 10000000 THEN 'amount_max_too_large'
  WHEN amount_min > amount_max THEN 'amounts_crossed'
  WHEN coalesce(CAST(customer_id AS VARCHAR), CAST(store_id AS VARCHAR), store_name, card_last4, CAST(amount_min AS VARCHAR),
                CAST(amount_max AS VARCHAR)) IS NULL
    THEN CASE WHEN date_from IS NULL AND date_to IS NULL THEN 'no_criterion' ELSE 'dates_alone_too_broad' END END"""


@query("search_guard", f"WITH {_REQUESTS_SQL} SELECT request_id, {_PROBLEM_SQL} AS problem FROM requests")
def q_search_guard(spark, folder):
    return search.search_guard(search_requests(spark, folder)).select("request_id", "problem")


@query("bulk_fuzzy_search", f"""WITH {RECEIPTS}, {_REQUESTS_SQL},
asked AS (SELECT *, CAST(floor(amount_min * 100) AS BIGINT) AS lo, CAST(floor(amount_max * 100) AS BIGINT) AS hi,
                 CAST(floor(coalesce(amount_min, amount_max) * 100) AS BIGINT) AS one FROM requests WHERE ({_PROBLEM_SQL}) IS NULL),
hits AS (
  SELECT q.request_id, off, lim, r.*,
         row_number() OVER (PARTITION BY request_id ORDER BY transaction_ts DESC, transaction_id) AS position
  FROM asked q JOIN receipts r ON (q.customer_id IS NULL OR q.customer_id = r.customer_id)
   AND (q.store_id IS NULL OR q.store_id = r.store_id)
   AND (q.store_name IS NULL OR q.store_id IS NOT NULL OR r.store_name ILIKE '%' || q.store_name || '%')
   AND (q.card_last4 IS NULL OR q.card_last4 = r.card_last4)
   AND (q.date_from IS NULL OR r.transaction_ts >= CAST(q.date_from AS TIMESTAMP))
   AND (q.date_to IS NULL OR r.transaction_ts <= CAST(q.date_to AS TIMESTAMP) + INTERVAL 1 DAY)
   AND (one IS NULL OR r.total_cents BETWEEN CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN lo ELSE greatest(0, one - one // 10) END
                                         AND CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN hi ELSE one + one // 10 END))
SELECT request_id, position, {_COLS_SQL} FROM hits WHERE position > off AND position <= off + lim""")
def q_bulk_fuzzy_search(spark, folder):
    receipts = clean_receipts(spark, folder).select(*_NAMES)
    span = wh.raw_receipts(spark, folder).agg(F.min("transaction_ts"), F.max("transaction_ts")).first()
    found = search.bulk_fuzzy_search(search_requests(spark, folder), receipts, wh.stores(spark, folder), span)
    return flat(found.withColumn("position", F.col("position").cast("bigint")))


@query("select_fields", f"WITH {RECEIPTS} SELECT transaction_id, total_cents, store_name FROM receipts")
def q_select_fields(spark, folder):
    return search.select_fields(clean_receipts(spark, folder), "transaction_id, total_cents,store_name, nonsense")


@query("card_window_lookup", f"""WITH {RECEIPTS}
SELECT a.transaction_id AS lookup_id, b.transaction_id, b.total_cents, {ts('b.transaction_ts')} AS transaction_ts
FROM receipts a JOIN receipts b ON a.card_last4 = b.card_last4 AND a.store_id = b.store_id
 AND b.transaction_ts BETWEEN a.transaction_ts - INTERVAL 1 DAY AND a.transaction_ts + INTERVAL 1 DAY""")
def q_card_window_lookup(spark, folder):
    receipts = clean_receipts(spark, folder)
    lookups = search.with_card(receipts).select(
        F.col("transaction_id").alias("lookup_id"), "card_last4", "store_id", F.col("transaction_ts").alias("around")
    )
    found = search.card_window_lookup(receipts, lookups)
    return flat(found.select("lookup_id", "transaction_id", "total_cents", "transaction_ts"))


_GRAMS = """list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''),
   lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"""


@query("trigram_match", f"""WITH named AS (
  SELECT p_partkey, p_name, {_GRAMS.format('p_name')} AS a, {_GRAMS.format("'smal widgt'")} AS b FROM part)
SELECT p_partkey, p_name, similarity FROM (
  SELECT p_partkey, p_name, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS similarity FROM named)
WHERE similarity >= 0.3""")
def q_trigram_match(spark, folder):
    parts = wh.table(spark, folder, "part").select("p_partkey", "p_name")
    return search.trigram_match(parts, "p_name", "smal widgt").withColumn("similarity", F.round("similarity", 6))


_TYPED_SQL = f"""typed AS (SELECT DISTINCT 'Natoin ' || replace(lower(n_name), 'nation_', '') AS pattern FROM nation),
names AS (SELECT DISTINCT n_name AS store_name FROM nation),
alike AS (
  SELECT pattern, store_name, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) AS similarity
  FROM (SELECT *, {_GRAMS.format('pattern')} AS a, {_GRAMS.format('store_name')} AS b FROM typed, names))"""


def typed_names(spark, folder):
    """Each store's name as a hurried hand types it."""
    name = F.regexp_replace(F.lower("store_name"), "nation_", "")
    return wh.stores(spark, folder).select(F.concat(F.lit("Natoin "), name).alias("pattern")).distinct()


@query("trigram_store_match", f"""WITH {RECEIPTS}, {_TYPED_SQL}
SELECT pattern, a.store_name, round(similarity, 6) AS similarity, count(transaction_id) AS receipts
FROM alike a LEFT JOIN receipts r ON r.store_name = a.store_name WHERE similarity >= 0.3 GROUP BY 1, 2, 3""")
def q_trigram_store_match(spark, folder):
    """Misspelt names against an index of the distinct store names, with how many receipts each store found has."""
    index = search.trigram_index(wh.stores(spark, folder), "store_name")
    alike = search.similar_names(typed_names(spark, folder), index)
    held = clean_receipts(spark, folder).groupBy("store_name").agg(F.count("transaction_id").alias("receipts"))
    found = alike.withColumnRenamed("name", "store_name").join(held, "store_name", "left")
    return found.select("pattern", "store_name", F.round("similarity", 6).alias("similarity"), F.coalesce("receipts", F.lit(0)).alias("receipts"))


_searched(
    "fuzzy_store_like", search.Criteria(store_like="Natoin 7", date_from="1996-01-01", limit=1000),
    f"store_name IN (WITH names AS (SELECT DISTINCT n_name AS store_name FROM nation) SELECT store_name FROM "
    f"(SELECT store_name, {_GRAMS.format('store_name')} AS a, {_GRAMS.format(chr(39) + 'Natoin 7' + chr(39))} AS b FROM names) "
    "WHERE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) >= 0.3) AND transaction_ts >= TIMESTAMP '1996-01-01'",
)


@query("bulk_store_like", f"""WITH {RECEIPTS}, {_TYPED_SQL}
SELECT pattern AS request_id, position, transaction_id, store_name, total_cents FROM (
  SELECT pattern, r.*, row_number() OVER (PARTITION BY pattern ORDER BY transaction_ts DESC, transaction_id) AS position
  FROM alike a JOIN receipts r ON r.store_name = a.store_name WHERE similarity >= 0.3)
WHERE position <= 30""")
def q_bulk_store_like(spark, folder):
    """Every misspelt name as a search of its own, in one job."""
    empty = {n: F.lit(None).cast("string") for n in ("customer_id", "store_id", "store_name", "card_last4", "date_from", "date_to", "amount_min", "amount_max")}
    requests = typed_names(spark, folder).withColumnRenamed("pattern", "store_like").withColumns({
        "request_id": F.col("store_like"), **empty, "limit": F.lit(30), "offset": F.lit(0)})
    span = wh.raw_receipts(spark, folder).agg(F.min("transaction_ts"), F.max("transaction_ts")).first()
    found = search.bulk_fuzzy_search(requests, clean_receipts(spark, folder), wh.stores(spark, folder), span)
    return found.select("request_id", F.col("position").cast("bigint").alias("position"), "transaction_id", "store_name", "total_cents")


@query("partial_scan_card", f"WITH {RECEIPTS} SELECT {_COLS_SQL} FROM receipts WHERE card_last4 IS NOT NULL")
def q_partial_scan_card(spark, folder):
    return flat(search.with_card(clean_receipts(spark, folder)).select(*_NAMES))


@query("capped_result", """SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 50""")
def q_capped_result(spark, folder):
    rows = wh.table(spark, folder, "customer").orderBy(F.desc("c_acctbal"), "c_custkey")
    return search.capped_result(rows.select("c_custkey", "c_acctbal"))
