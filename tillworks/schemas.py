"""Declared schemas. Nothing is inferred; money is whole cents in BIGINT."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I, _TS, _B = T.StringType(), T.LongType(), T.IntegerType(), T.TimestampType(), T.BooleanType()
QUANTITY = T.DecimalType(10, 3)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


EVENT_ITEM = _struct(
    upc=_S, sku=_S, product_desc=_S, quantity=QUANTITY, unit_price_cents=_L,
    extended_cents=_L, discount_cents=_L, department_code=_S,
)

RECEIPT_EVENT = _struct(
    transaction_id=_S, store_id=_S, store_name=_S, pos_terminal_id=_S, cashier_id=_S, customer_id=_S,
    transaction_ts=_TS, subtotal_cents=_L, tax_cents=_L, total_cents=_L, tender_type=_S, card_last4=_S,
    items=T.ArrayType(EVENT_ITEM),
)

RAW_RECEIPTS = _struct(
    event_id=_S, transaction_id=_S, store_id=_S, store_name=_S, pos_terminal_id=_S, cashier_id=_S,
    customer_id=_S, transaction_ts=_TS, subtotal_cents=_L, tax_cents=_L, total_cents=_L, tender_type=_S,
    card_last4=_S, raw_payload=_S, ingested_ts=_TS,
)

RAW_ITEMS = _struct(
    event_id=_S, transaction_id=_S, item_seq=_I, upc=_S, sku=_S, product_desc=_S, quantity=QUANTITY,
    unit_price_cents=_L, extended_cents=_L, discount_cents=_L, department_code=_S, ingested_ts=_TS,
)

LINE_ITEMS = _struct(
    transaction_id=_S, line_number=_I, sku=_S, product_name=_S, brand=_S, category_l1=_S, category_l2=_S,
    quantity=QUANTITY, unit_price_cents=_L, line_total_cents=_L, discount_cents=_L, is_taxable=_B,
    weight_lb=QUANTITY,
)

PRODUCT_EMBEDDINGS = _struct(sku=_S, product_name=_S, search_text=_S, embedding=T.ArrayType(T.FloatType()))

AUDIT_LOG = _struct(
    audit_id=_S, rep_id=_S, rep_email=_S, rep_role=_S, action=_S, resource_type=_S, resource_id=_S,
    query_params=_S, result_count=_I, ip_address=_S, user_agent=_S, created_at=_TS,
)

DELIVERY_LOG = _struct(
    delivery_id=_S, transaction_id=_S, customer_id=_S, delivery_method=_S, delivery_target=_S,
    delivered_by_rep=_S, status=_S, created_at=_TS,
)

AGENT_STATE = _struct(
    agent_id=_S, customer_id=_S, state_key=_S, state_value=_S, updated_at=_TS,
)

AGENT_MEMORY = _struct(
    memory_id=_S, customer_id=_S, agent_id=_S, role=_S, content=_S, metadata=_S, created_at=_TS,
)

USER_SESSIONS = _struct(session_id=_S, customer_id=_S, started_at=_TS, last_active_at=_TS, session_data=_S)

SEARCH_CACHE = _struct(
    query_hash=_S, query_text=_S, result_json=_S, hit_count=_I, created_at=_TS, expires_at=_TS,
)

BACKUP_RECEIPTS = _struct(
    transaction_id=_S, customer_id=_S, store_name=_S, purchase_timestamp=_TS, total_cents=_I,
    item_summary=_S, last4_card=_S, created_at=_TS,
)

ITEMS_DETAIL_JSON = T.ArrayType(_struct(line=_I, item=_S, qty=T.DoubleType(), price=_L, total=_L))
