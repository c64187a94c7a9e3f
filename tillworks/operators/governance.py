"""Row filters, column masks, access history and redaction."""

from __future__ import annotations

import json
from collections.abc import Collection, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Roles, the redaction mark and the key names that hold personal data.
SUPERVISOR, FRAUD, REP = "supervisor", "fraud_team", "cs_rep"
REDACTED = "***REDACTED***"
PII_KEYS = frozenset((
    "password", "token", "secret", "api_key", "access_token", "refresh_token",
    "customer_name", "customer_email", "email", "phone", "phone_number",
    "address", "street", "city", "state", "zip", "postal_code",
    "ssn", "social_security", "tax_id", "driver_license",
    "card_last4", "card_number", "cvv", "account_number", "routing_number",
    "name", "first_name", "last_name", "full_name", "date_of_birth", "dob",
))


def card_last4(card: Column | str) -> Column:
    """The last four digits in a text, NULL where it has fewer."""
    digits = F.regexp_replace(F.col(card) if isinstance(card, str) else card, "[^0-9]", "")
    return F.when(F.length(digits) >= 4, F.substring(digits, -4, 4))


def mask_card(card: Column | str) -> Column:
    col = F.col(card) if isinstance(card, str) else card
    return F.when(col.isNull(), F.lit(None).cast("string")).when(
        F.length(col) >= 4, F.concat(F.lit("****"), F.substring(col, -4, 4))
    ).otherwise(F.lit("****"))


def mask_email(email: Column | str, roles: Collection[str]) -> Column:
    """In full for the fraud team, two letters and the domain for supervisors, NULL for others.

    An address too short to keep two letters keeps none.
    """
    col = F.col(email) if isinstance(email, str) else email
    if FRAUD in roles:
        return col
    if SUPERVISOR not in roles:
        return F.lit(None).cast("string")
    long_enough = "^(.{2}).*(@.*)$"
    return F.when(col.rlike(long_enough), F.regexp_replace(col, long_enough, "$1***$2")).otherwise(
        F.regexp_replace(col, "^[^@]*", "***")
    )


def mask_fraud(value: Column | str, roles: Collection[str], fraud_team_only: bool = False) -> Column:
    col = F.col(value) if isinstance(value, str) else value
    allowed = {FRAUD} if fraud_team_only else {FRAUD, SUPERVISOR}
    return col if allowed & set(roles) else F.when(F.lit(False), col)


def audit_rows_for(log: DataFrame, principal: str, roles: Collection[str]) -> DataFrame:
    """Supervisors and fraud team see all audit rows, a rep the own ones, anyone else none."""
    if {SUPERVISOR, FRAUD} & set(roles):
        return log
    if REP in roles:
        return log.filter(F.col("rep_email") == principal)
    return log.filter(F.lit(False))


def receipts_for(receipts: DataFrame, roles: Collection[str]) -> DataFrame:
    return receipts if {REP, SUPERVISOR, FRAUD} & set(roles) else receipts.filter(F.lit(False))


def access_history_filter(
    receipts: DataFrame, log: DataFrame, principal: str, roles: Collection[str]
) -> DataFrame:
    """Supervisors and fraud team see every receipt, others those they looked up before."""
    if {SUPERVISOR, FRAUD} & set(roles):
        return receipts
    kind = receipts.schema["transaction_id"].dataType
    seen = log.filter((F.col("rep_email") == principal) & F.col("resource_id").isNotNull()).select(
        F.expr(f"try_cast(resource_id AS {kind.simpleString()})").alias("_seen")
    )
    return receipts.join(seen, F.col("transaction_id") == F.col("_seen"), "left_semi")


def secured_view(
    df: DataFrame, roles: Collection[str], cards: Collection[str] = (), emails: Collection[str] = (),
    fraud: Collection[str] = (),
) -> DataFrame:
    """The table with its card, email and fraud columns masked for the given roles."""
    masked = {c: mask_card(c) for c in cards}
    masked |= {c: mask_email(c, roles) for c in emails}
    masked |= {c: mask_fraud(c, roles) for c in fraud}
    return df.withColumns(masked) if masked else df


def redact_struct(col: Column, kind: T.DataType) -> Column:
    """Redacts personal keys of a column with a declared nested type; stays inside Spark."""
    if isinstance(kind, T.StructType):
        fields = [
            (F.when(col[f.name].isNotNull(), F.lit(REDACTED)) if f.name.lower() in PII_KEYS
             else redact_struct(col[f.name], f.dataType)).alias(f.name)
            for f in kind.fields
        ]
        return F.when(col.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType)):
        return F.transform(col, lambda item: redact_struct(item, kind.elementType))
    return col


def _redact(value: object) -> object:
    if isinstance(value, dict):
        return {k: REDACTED if k.lower() in PII_KEYS else _redact(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_redact(v) for v in value]
    return value


def _redact_text(text: str | None) -> str | None:
    try:
        return json.dumps(_redact(json.loads(text)), separators=(",", ":"), ensure_ascii=False) if text else None
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def redact_json(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Redacts personal keys at any depth of JSON text of any shape; text that is not JSON gives NULL."""
    for batch in texts:
        yield batch.map(_redact_text)
