"""Masks, redaction, audit, throttling, back-fill and text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillworks.functions import receipt_text as rt
from tillworks.functions.receipt_text import item_summary
from tillworks.operators import audit, backfill, governance, search
from tillworks.plans import batch, migration, silver
from tillworks.registry.base import GOLD, ITEMS, RECEIPTS, clean_items, clean_receipts, flat, query, ts
from tillworks.registry.gold import gold_table
from tillworks.session import run_folder
from tillworks.sources import warehouse as wh

_EMAILS = """emails AS (SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN substr(c_mktsegment, 1, 1) ELSE lower(c_name) END
  || '@' || lower(c_mktsegment) || '.example' AS email, '4000-1234-' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS card,
  c_acctbal FROM customer)
"""


def contacts(spark, folder):
    seg = F.col("c_mktsegment")
    local = F.when(seg == "BUILDING", F.substring(seg, 1, 1)).otherwise(F.lower("c_name"))
    return wh.table(spark, folder, "customer").select(
        "c_custkey", F.concat(local, F.lit("@"), F.lower(seg), F.lit(".example")).alias("email"),
        F.concat(F.lit("4000-1234-"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("card"), "c_acctbal",
    )


@query("card_last4", f"WITH {_EMAILS} SELECT c_custkey, right(replace(card, '-', ''), 4) AS card_last4 FROM emails")
def q_card_last4(spark, folder):
    return contacts(spark, folder).select("c_custkey", governance.card_last4("card").alias("card_last4"))


@query("mask_card", f"WITH {_EMAILS} SELECT c_custkey, '****' || right(card, 4) AS card FROM emails")
def q_mask_card(spark, folder):
    return contacts(spark, folder).select("c_custkey", governance.mask_card("card").alias("card"))


@query("mask_email", f"""WITH {_EMAILS} SELECT c_custkey, CASE WHEN length(split_part(email, '@', 1)) >= 2
  THEN substr(email, 1, 2) || '***@' || split_part(email, '@', 2) ELSE '***@' || split_part(email, '@', 2) END AS email FROM emails""")
def q_mask_email(spark, folder):
    return contacts(spark, folder).select("c_custkey", governance.mask_email("email", {governance.SUPERVISOR}).alias("email"))


@query("mask_fraud", """SELECT c_custkey, c_acctbal AS for_supervisor, CAST(NULL AS DOUBLE) AS for_rep, c_acctbal AS for_fraud_team FROM customer""")
def q_mask_fraud(spark, folder):
    return contacts(spark, folder).select(
        "c_custkey", governance.mask_fraud("c_acctbal", {governance.SUPERVISOR}).alias("for_supervisor"),
        governance.mask_fraud("c_acctbal", {governance.REP}).alias("for_rep"),
        governance.mask_fraud("c_acctbal", {governance.FRAUD}, fraud_team_only=True).alias("for_fraud_team"),
    )


@query("secured_view", f"WITH {_EMAILS} SELECT c_custkey, CAST(NULL AS VARCHAR) AS email, '****' || right(card, 4) AS card, CAST(NULL AS DOUBLE) AS c_acctbal FROM emails")
def q_secured_view(spark, folder):
    return governance.secured_view(contacts(spark, folder), {governance.REP}, cards=["card"], emails=["email"], fraud=["c_acctbal"])


_LOG = """access AS (
  SELECT event_id, 'rep' || user_id AS email, ts,
         CASE event_type WHEN 'click' THEN '/receipt/' || event_id WHEN 'view' THEN '/search/fuzzy' WHEN 'purchase' THEN '/cs/context/' || user_id
              WHEN 'signup' THEN '/assets/app.js' ELSE '/health' END AS path, props, value FROM events),
audit AS (
  SELECT CAST(event_id AS VARCHAR) AS audit_id, email AS rep_email,
         CASE WHEN path = '/search/fuzzy' THEN 'fuzzy_search' WHEN path LIKE '/receipt/%' THEN 'lookup' WHEN path LIKE '/cs/context/%' THEN 'context_lookup' ELSE 'unknown' END AS action,
         CASE WHEN path LIKE '/cs/context/%' THEN 'customer' WHEN path LIKE '/receipt/%' OR path LIKE '/search/%' THEN 'receipt' ELSE 'unknown' END AS resource_type,
         CASE WHEN path <> '/search/fuzzy' THEN split_part(path, '/', -1) END AS resource_id,
         '{"k":1,"body":{"email":"***REDACTED***","value":' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || '}}' AS query_params, ts AS created_at
  FROM access WHERE path <> '/health' AND path NOT LIKE '/assets/%')
"""


def access_log(spark, folder, events=None):
    """Every event read as a request by a rep."""
    events = wh.table(spark, folder, "events") if events is None else events
    kind, number = F.col("event_type"), F.col("event_id").cast("string")
    path = (
        F.when(kind == "click", F.concat(F.lit("/receipt/"), number)).when(kind == "view", "/search/fuzzy")
        .when(kind == "purchase", F.concat(F.lit("/cs/context/"), F.col("user_id").cast("string")))
        .when(kind == "signup", "/assets/app.js").otherwise("/health")
    )
    return events.select(
        F.col("event_id").alias("request_id"), path.alias("path"),
        F.concat(F.lit("rep"), F.col("user_id").cast("string")).alias("email"), F.lit('{"k":1}').alias("params"),
        F.concat(F.lit('{"email": "a@b", "value": '), F.floor("value").cast("string"), F.lit("}")).alias("body"),
        F.lit(1).alias("result_count"), F.lit(None).cast("string").alias("ip_address"), F.lit("test").alias("user_agent"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )


_AUDIT_NAMES = ["audit_id", "rep_email", "action", "resource_type", "resource_id", "query_params", "created_at"]
_AUDIT_SQL = f"audit_id, rep_email, action, resource_type, resource_id, query_params, {ts('created_at')} AS created_at"


@query("audit_rows", f"WITH {_LOG} SELECT {_AUDIT_SQL} FROM audit")
def q_audit_rows(spark, folder):
    return flat(audit.audit_rows(access_log(spark, folder)).select(*_AUDIT_NAMES))


@query("classify_route", f"""WITH {_LOG} SELECT event_id, CASE WHEN path = '/search/fuzzy' THEN 'fuzzy_search' WHEN path LIKE '/receipt/%' THEN 'lookup'
  WHEN path LIKE '/cs/context/%' THEN 'context_lookup' ELSE 'unknown' END AS action,
  CASE WHEN path LIKE '/cs/context/%' THEN 'customer' WHEN path LIKE '/receipt/%' OR path LIKE '/search/%' THEN 'receipt' ELSE 'unknown' END AS resource_type FROM access""")
def q_classify_route(spark, folder):
    return access_log(spark, folder).withColumn("r", audit.classify_route("path")).select(
        F.col("request_id").alias("event_id"), "r.action", "r.resource_type"
    )


@query("resource_id", """SELECT page_id, CASE WHEN url LIKE 'http%' THEN list_last(string_split(trim(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/'), '/')) END AS resource_id
FROM pages WHERE len(string_split(trim(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/'), '/')) >= 2""")
def q_resource_id(spark, folder):
    paths = wh.table(spark, folder, "pages").select("page_id", F.regexp_extract("url", "^https?://[^/?#]*([^?#]*)", 1).alias("path"))
    return paths.select("page_id", audit.resource_id("path").alias("resource_id")).filter(F.col("resource_id").isNotNull())


@query("skip_path", f"WITH {_LOG} SELECT event_id, path = '/health' OR path LIKE '/assets/%' AS skipped FROM access")
def q_skip_path(spark, folder):
    return access_log(spark, folder).select(F.col("request_id").alias("event_id"), audit.skip_path("path").alias("skipped"))


@query("audit_filter", f"""WITH {_LOG} SELECT audit_id, action, resource_id FROM audit WHERE action = 'lookup' AND created_at >= TIMESTAMP '2024-01-05'
  AND created_at <= TIMESTAMP '2024-01-20' ORDER BY created_at DESC, audit_id LIMIT 100""")
def q_audit_filter(spark, folder):
    log = audit.audit_rows(access_log(spark, folder))
    return search.audit_filter(log, action="lookup", date_from="2024-01-05", date_to="2024-01-20").select("audit_id", "action", "resource_id")


@query("row_filter", f"WITH {_LOG} SELECT audit_id, rep_email FROM audit WHERE rep_email = 'rep7'")
def q_row_filter(spark, folder):
    log = audit.audit_rows(access_log(spark, folder))
    return governance.audit_rows_for(log, "rep7", {governance.REP}).select("audit_id", "rep_email")


@query("access_history_filter", f"""WITH {RECEIPTS}, {_LOG}
SELECT transaction_id, total_cents FROM receipts WHERE CAST(transaction_id AS VARCHAR) IN (SELECT resource_id FROM audit WHERE rep_email = 'rep7' AND resource_id IS NOT NULL)""")
def q_access_history_filter(spark, folder):
    log = audit.audit_rows(access_log(spark, folder))
    seen = governance.access_history_filter(clean_receipts(spark, folder), log, "rep7", {governance.REP})
    return seen.select("transaction_id", "total_cents")


_REDACTED = """SELECT c_custkey, '{"customer_id":' || c_custkey || ',"Name":"***REDACTED***","profile":{"segment":"' || c_mktsegment ||
  '","phones":[{"phone":"***REDACTED***","kind":"home"}]}}' AS payload FROM customer"""


def _payload():
    return F.struct(
        F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("Name"),
        F.struct(
            F.col("c_mktsegment").alias("segment"),
            F.array(F.struct(F.col("c_name").alias("phone"), F.lit("home").alias("kind"))).alias("phones"),
        ).alias("profile"),
    )


@query("redact_json", _REDACTED)
def q_redact_json(spark, folder):
    texts = wh.table(spark, folder, "customer").select("c_custkey", F.to_json(_payload()).alias("payload"))
    return texts.select("c_custkey", governance.redact_json("payload").alias("payload"))


@query("redact_struct", _REDACTED)
def q_redact_struct(spark, folder):
    rows = wh.table(spark, folder, "customer").select("c_custkey", _payload().alias("payload"))
    kind = rows.schema["payload"].dataType
    return rows.select("c_custkey", F.to_json(governance.redact_struct(F.col("payload"), kind)).alias("payload"))


@query("scrub_debug_text", r"""SELECT conv_id, turn, regexp_replace(regexp_replace(text, '\n\s*\n\s*\n+', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM conversations""")
def q_scrub_debug_text(spark, folder):
    leaked = F.concat("text", F.lit('\n{"rows": [1, 2]}\n\n\nsql_query returned: {"count": 3}\n\n\n\nRaw search results: nothing'))
    return wh.table(spark, folder, "conversations").select("conv_id", "turn", rt.scrub_debug_text(leaked).alias("text"))


@query("embed_text", f"SELECT p_partkey, p_name || ' | ' || CASE WHEN p_size > 25 THEN p_type ELSE '' END AS text FROM part")
def q_embed_text(spark, folder):
    return wh.table(spark, folder, "part").select(
        "p_partkey", rt.embed_text("p_name", F.when(F.col("p_size") > 25, F.col("p_type"))).alias("text")
    )


@query("cents_to_dollars", f"WITH {RECEIPTS} SELECT transaction_id, format('${{:,.2f}}', total_cents / 100.0) AS total FROM receipts")
def q_cents_to_dollars(spark, folder):
    return clean_receipts(spark, folder).select("transaction_id", rt.cents_to_dollars("total_cents").alias("total"))


@query("split_summary", f"""WITH {GOLD}, parts AS (SELECT transaction_id, string_split(item_summary, ',') AS names FROM gold WHERE item_summary IS NOT NULL)
SELECT transaction_id, CAST(i AS INTEGER) AS line_number, trim(names[i]) AS item_name FROM parts, LATERAL (SELECT unnest(range(1, len(names) + 1)) AS i)""")
def q_split_summary(spark, folder):
    named = gold_table(spark, folder).select("transaction_id", F.posexplode(rt.split_summary("item_summary")).alias("at", "item_name"))
    return named.select("transaction_id", (F.col("at") + 1).alias("line_number"), "item_name")


@query("parse_items_detail", f"""SELECT event_id, 'Unknown Item:' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || ':1.0' AS items FROM events WHERE event_type <> 'error'
UNION ALL SELECT event_id, '' FROM events WHERE event_type = 'error'""")
def q_parse_items_detail(spark, folder):
    from tillworks.operators.lookup import parse_items_detail

    text = F.when(F.col("event_type") == "error", F.col("props").substr(2, 3)).otherwise(
        F.concat(F.lit('[{"total": '), F.floor("value").cast("string"), F.lit("}]"))
    )
    rows = wh.table(spark, folder, "events").select("event_id", parse_items_detail(text).alias("items"))
    shown = F.transform("items", lambda i: F.concat_ws(":", i["name"], i["price_cents"], i["quantity"]))
    return rows.select("event_id", F.array_join(shown, "|").alias("items"))


_KEYWORDS = """keywords AS (SELECT kw AS keyword, min(p_partkey) AS priority FROM (SELECT p_partkey, split_part(p_name, ' ', 2) AS kw FROM part) GROUP BY 1),
catalog AS (SELECT keyword, priority, 'SKU-' || priority AS sku, keyword AS name, CAST(500 + 100 * length(keyword) AS BIGINT) AS price_cents FROM keywords)
"""


def keyword_catalog(spark, folder):
    """Products named by the nouns of the part names."""
    nouns = wh.table(spark, folder, "part").select("p_partkey", F.split("p_name", " ")[1].alias("keyword"))
    listed = nouns.groupBy("keyword").agg(F.min("p_partkey").alias("priority"))
    return listed.select(
        "keyword", "priority", F.concat(F.lit("SKU-"), "priority").alias("sku"), F.col("keyword").alias("name"),
        F.lit("Own").alias("brand"), F.lit("L1").alias("category_l1"), F.lit("L2").alias("category_l2"),
        (500 + 100 * F.length("keyword")).cast("bigint").alias("price_cents"),
    )


@query("keyword_product_match", f"""WITH {ITEMS}, {_KEYWORDS}, matched AS (
  SELECT product_desc, arg_min(sku, priority) AS sku FROM (SELECT DISTINCT product_desc FROM items) JOIN catalog c ON contains(product_desc, c.keyword) GROUP BY 1)
SELECT transaction_id, item_seq, product_desc, coalesce(m.sku, 'SKU-9999') AS matched_sku FROM items LEFT JOIN matched m USING (product_desc)""")
def q_keyword_product_match(spark, folder):
    matched = backfill.keyword_product_match(
        clean_items(spark, folder).select("transaction_id", "item_seq", "product_desc"), "product_desc", keyword_catalog(spark, folder)
    )
    return matched.select("transaction_id", "item_seq", "product_desc", F.col("product.sku").alias("matched_sku"))


_REBUILT = f"""{GOLD}, {_KEYWORDS},
named AS (SELECT transaction_id, subtotal_cents, len(names) AS n, i, trim(names[i]) AS item_name
          FROM (SELECT transaction_id, subtotal_cents, string_split(item_summary, ',') AS names FROM gold WHERE item_summary <> ''),
               LATERAL (SELECT unnest(range(1, len(names) + 1)) AS i)),
matched AS (SELECT item_name, arg_min(sku, priority) AS sku, arg_min(price_cents, priority) AS price, arg_min(name, priority) AS name
            FROM (SELECT DISTINCT item_name FROM named) JOIN catalog c ON contains(lower(item_name), c.keyword) GROUP BY 1),
priced AS (SELECT n.*, coalesce(sku, 'SKU-9999') AS sku, coalesce(price, 599) AS price, coalesce(name, trim(n.item_name)) AS product_name,
                  sum(coalesce(price, 599)) OVER (PARTITION BY transaction_id ORDER BY i) AS upto
           FROM named n LEFT JOIN matched m ON m.item_name = n.item_name),
split AS (SELECT *, CASE WHEN i = 1 THEN subtotal_cents ELSE greatest(subtotal_cents - (upto - price), 100) END AS before FROM priced)
SELECT transaction_id, CAST(i AS INTEGER) AS line_number, sku, product_name,
       CAST(CASE WHEN i = n THEN before ELSE least(price, before - 100) END AS BIGINT) AS line_total_cents FROM split"""


@query("rebuild_line_items", f"WITH {_REBUILT}")
def q_rebuild_line_items(spark, folder):
    receipts = silver.receipt_headers(clean_receipts(spark, folder), clean_items(spark, folder))
    summed = receipts.select("transaction_id", "subtotal_cents", item_summary("first_names", "item_count").alias("item_summary"))
    lines = backfill.rebuild_line_items(summed, keyword_catalog(spark, folder))
    return lines.select("transaction_id", "line_number", "sku", "product_name", "line_total_cents")


@query("allocate_line_prices", f"""WITH {ITEMS},
priced AS (SELECT transaction_id, item_seq, unit_price_cents AS price, 300000 AS subtotal, sum(unit_price_cents) OVER (PARTITION BY transaction_id ORDER BY item_seq) AS upto,
                  row_number() OVER (PARTITION BY transaction_id ORDER BY item_seq) AS i, count(*) OVER (PARTITION BY transaction_id) AS n FROM items)
SELECT transaction_id, string_agg(CASE WHEN i = n THEN b ELSE least(price, b - 100) END, '|' ORDER BY i) AS given
FROM (SELECT *, CAST(CASE WHEN i = 1 THEN subtotal ELSE greatest(subtotal - (upto - price), 100) END AS BIGINT) AS b FROM priced) GROUP BY 1""")
def q_allocate_line_prices(spark, folder):
    return allocated(clean_items(spark, folder))


def allocated(items):
    lines = backfill.allocate_receipt_lines(items, "unit_price_cents", F.lit(300000), [F.asc_nulls_last("item_seq")])
    given = F.sort_array(F.collect_list(F.struct("position", "given")))
    return lines.groupBy("transaction_id").agg(F.array_join(F.transform(given, lambda g: g["given"].cast("string")), "|").alias("given"))


@query("migrate_backup_to_bronze", f"""WITH {RECEIPTS}
SELECT transaction_id, CASE WHEN card_last4 IS NULL THEN 'CASH' ELSE 'CREDIT' END AS tender_type, total_cents // 10 AS tax_cents,
       total_cents - total_cents // 10 AS subtotal_cents, total_cents, card_last4,
       'evt-' || substr(sha256(transaction_id || '|' || {ts('ingested_ts')}), 1, 12) AS event_id,
       '{{"transaction_id":' || transaction_id || ',"store_name":"' || store_name || '","total_cents":' || total_cents ||
       ',"timestamp":"' || strftime(transaction_ts, '%Y-%m-%dT%H:%M:%S.000Z') || '","source":"backup_migration"}}' AS raw_payload FROM receipts""")
def q_migrate_backup(spark, folder):
    moved = backfill.migrate_backup_to_bronze(backup_rows(spark, folder))
    return moved.select("transaction_id", "tender_type", "tax_cents", "subtotal_cents", "total_cents", "card_last4", "event_id", "raw_payload")


def backup_rows(spark, folder):
    return clean_receipts(spark, folder).select(
        "transaction_id", "customer_id", "store_name", F.col("transaction_ts").alias("purchase_timestamp"), "total_cents",
        F.col("card_last4").alias("last4_card"), F.col("ingested_ts").alias("created_at"),
    )


@query("migrate_job", f"""WITH {RECEIPTS}
SELECT transaction_id, CASE WHEN card_last4 IS NULL THEN 'CASH' ELSE 'CREDIT' END AS tender_type, total_cents // 10 AS tax_cents,
       total_cents, 'evt-' || substr(sha256(transaction_id || '|' || {ts('ingested_ts')}), 1, 12) AS event_id, TRUE AS matches FROM receipts""")
def q_migrate_job(spark, folder):
    """The whole migration in ranges, with a manifest whose counts all agree."""
    root = run_folder(spark, "migration")
    source = batch.stored(backup_rows(spark, folder), f"{root}/backup")
    schema = backfill.migrate_backup_to_bronze(source).schema
    migration.migrate_job(source, root, schema, ranges=4)
    rows = migration.migrated(spark, root, schema).select("transaction_id", "tender_type", "tax_cents", "total_cents", "event_id")
    matches = migration.finished(spark, root).agg(F.bool_and(F.col("matches") & (F.col("moved_rows") == F.col("stored_rows")))).first()[0]
    return rows.withColumn("matches", F.lit(matches))


_SESSIONS = f"""WITH flagged AS (
  SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 6 HOURS THEN 1 ELSE 0 END AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
numbered AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM flagged)
SELECT user_id, {ts('min(ts)')} AS started_at, {ts('max(ts)')} AS last_active_at, count(*) AS events FROM numbered GROUP BY user_id, s"""


@query("session_activity", _SESSIONS)
def q_session_activity(spark, folder):
    return flat(audit.session_activity(wh.table(spark, folder, "events"), gap_minutes=360))


# One token every three hours and room for three, so that the sparse test events do get refused.
THROTTLE = {"rate": 1 / 10800, "burst": 3}

_THROTTLE_SQL = """WITH RECURSIVE r AS (
  SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
walk AS (
  SELECT user_id, event_id, t, n, CAST(3 * 10800000000 - 10800000000 AS BIGINT) AS credit, FALSE AS refused FROM r WHERE n = 1
  UNION ALL
  SELECT r.user_id, r.event_id, r.t, r.n,
         CASE WHEN least(32400000000, credit + r.t - w.t) >= 10800000000 THEN least(32400000000, credit + r.t - w.t) - 10800000000
              ELSE least(32400000000, credit + r.t - w.t) END,
         least(32400000000, credit + r.t - w.t) < 10800000000
  FROM walk w JOIN r ON r.user_id = w.user_id AND r.n = w.n + 1)
SELECT user_id, event_id FROM walk WHERE refused"""


@query("throttle_violations", _THROTTLE_SQL)
def q_throttle_violations(spark, folder):
    refused = audit.throttle_violations(wh.table(spark, folder, "events"), "user_id", "ts", "event_id", **THROTTLE)
    return refused.select("user_id", "event_id")


@query("raw_payload", """SELECT o_orderkey, '{"transaction_id":' || o_orderkey || ',"status":"' || o_orderstatus || '"}' AS raw_payload FROM orders""")
def q_raw_payload(spark, folder):
    return wh.table(spark, folder, "orders").select("o_orderkey", F.to_json(F.struct(
        F.col("o_orderkey").alias("transaction_id"), F.col("o_orderstatus").alias("status"))).alias("raw_payload"))
