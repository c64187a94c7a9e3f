"""Receipt text and calendar columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def month_key(ts: Column | str) -> Column:
    return F.date_format(_col(ts), "yyyy-MM")


def week_key(ts: Column | str, iso: bool = False) -> Column:
    """Year, `-W` and the ISO week. The default pairs the calendar year with the ISO week; `iso` uses the ISO year."""
    day = _col(ts)
    year = F.extract(F.lit("YEAROFWEEK"), day) if iso else F.year(day)
    return F.concat(
        F.lpad(year.cast("string"), 4, "0"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0")
    )


def product_key(upc: Column | str = "upc", sku: Column | str = "sku") -> Column:
    return F.coalesce(_col(upc).cast("string"), _col(sku).cast("string"))


def quantity_label(quantity: Column, desc: Column) -> Column:
    """`2x Oat Milk` where the quantity is not one, else the plain name; the quantity rounds half to even."""
    prefix = F.concat(F.bround(quantity, 0).cast("bigint").cast("string"), F.lit("x "))
    return F.concat(F.when(quantity != 1, prefix).otherwise(F.lit("")), desc)


def item_summary(
    names: Column | str, count: Column | str, top: int = 3, more: str = " + {n} more"
) -> Column:
    """The first `top` names joined by a comma, then how many more; `names` is in receipt order."""
    listed, n = _col(names), F.coalesce(_col(count), F.lit(0))
    head = F.array_join(F.slice(listed, 1, top), ", ")
    before, after = more.split("{n}")
    return F.when(n <= top, head).otherwise(
        F.concat(head, F.lit(before), (n - top).cast("string"), F.lit(after))
    )


def summary_top5(names: Column | str, count: Column | str) -> Column:
    return item_summary(names, count, top=5, more=", +{n} more")


def embed_text(desc: Column | str, department: Column | str) -> Column:
    """Description and department for embedding; a missing department leaves the separator in place."""
    return F.concat_ws(" | ", _col(desc), F.coalesce(_col(department), F.lit("")))


def cents_to_dollars(amount: Column | str) -> Column:
    """`$1,234.56`, or `N/A` without an amount; exact, since whole cents become a decimal."""
    value = _col(amount).cast("decimal(20,2)") / F.lit(100).cast("decimal(3,0)")
    text = F.format_number(F.abs(value).cast("decimal(20,2)"), 2)
    sign = F.when(_col(amount) < 0, F.lit("$-")).otherwise(F.lit("$"))
    return F.when(_col(amount).isNull(), F.lit("N/A")).otherwise(F.concat(sign, text))


def dollars_to_cents(amount: Column | str) -> Column:
    """Dollars to cents cut to whole cents, by decimal so that 4.35 gives 435."""
    return F.floor(_col(amount).cast("decimal(20,6)") * 100).cast("bigint")


def split_summary(summary: Column | str) -> Column:
    """Names in a comma list, trimmed, in order."""
    return F.transform(F.split(_col(summary), ","), lambda name: F.trim(name))


def has_department(departments: Column | str, wanted: list[str]) -> Column:
    return F.arrays_overlap(_col(departments), F.array(*(F.lit(w) for w in wanted)))


def scrub_debug_text(text: Column | str) -> Column:
    """Remove tool output from an answer, collapse runs of blank lines and trim."""
    cleaned = _col(text)
    for pattern in DEBUG_PATTERNS:
        cleaned = F.regexp_replace(cleaned, pattern, "")
    cleaned = F.regexp_replace(cleaned, r"\n\s*\n\s*\n+", "\n\n")
    return F.regexp_replace(cleaned, r"^\s+|\s+$", "")


# The patterns of leaked tool output.
DEBUG_PATTERNS = (
    r"Raw search results:[\s\S]*?(?=\n\n|\z)",
    r"(?m)semantic_search returned:\s*\{[\s\S]*?\}\s*(?=\n|$)",
    r"(?m)sql_query returned:\s*\{[\s\S]*?\}\s*(?=\n|$)",
    r"(?m)\{\s*\"matches\"[\s\S]*?\}\s*(?=\n|$)",
    r"(?m)\{\s*\"rows\"[\s\S]*?\}\s*(?=\n|$)",
)
