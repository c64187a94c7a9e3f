"""Receipt search by several optional criteria, one search or a table of searches."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillworks.functions.receipt_text import dollars_to_cents
from tillworks.operators.dedup import top_per_key
from tillworks.operators.substring import contains_pairs, longest_literal
from tillworks.session import release_folder, run_folder

MAX_DOLLARS = 10_000_000
MAX_LIMIT = 1000
_TEXT = ("customer_id", "store_id", "store_name", "store_like", "card_last4", "date_from", "date_to")
#: Trigram similarity from which a store's name counts as the one meant.
LIKE = 0.3


@dataclass(frozen=True)
class Criteria:
    """What to search for; amounts in dollars, dates as ISO text, None where not asked.

    Of the three ways to name a store the most exact counts: id, then part of the name, then a name that may be misspelt.
    """

    customer_id: str | int | None = None
    store_id: str | int | None = None
    store_name: str | None = None
    store_like: str | None = None
    date_from: str | None = None
    date_to: str | None = None
    amount_min: float | str | None = None
    amount_max: float | str | None = None
    card_last4: str | None = None
    limit: int = 25
    offset: int = 0

    def normal(self) -> "Criteria":
        blanks = {f.name: None for f in fields(self) if getattr(self, f.name) == ""}
        return replace(self, **blanks)

    def check(self) -> "Criteria":
        """The criteria with blanks read as absent; raises on anything out of bounds or too broad."""
        c = self.normal()
        problem = c.problem()
        if problem is not None:
            raise ValueError(problem)
        return c

    def problem(self) -> str | None:
        """The code of the first rule these criteria break, by `search_guard` over a table of this one search."""
        spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        given = {f.name: getattr(self, f.name) for f in fields(self)}
        row = [F.lit(v if v is None or n in ("limit", "offset") else str(v)).alias(n) for n, v in given.items()]
        return search_guard(spark.sql("SELECT 1 AS request_id").select("request_id", *row)).first()["problem"]


def amount_bounds(low: Column, high: Column) -> tuple[Column, Column]:
    """Bounds in cents. Two bounds are a range; a single one means ten per cent either way, from zero up."""
    low_cents, high_cents = dollars_to_cents(low), dollars_to_cents(high)
    only = F.coalesce(low_cents, high_cents)
    margin = F.floor(only / 10).cast("bigint")
    both = low.isNotNull() & high.isNotNull()
    lower = F.when(both, low_cents).when(only.isNotNull(), F.greatest(F.lit(0).cast("bigint"), only - margin))
    upper = F.when(both, high_cents).otherwise(only + margin)
    return lower, upper


def predicate(c: Criteria) -> Column:
    """One condition over the receipt columns; comparisons are kept plain so that they reach the scan."""
    parts: list[Column] = []
    if c.customer_id is not None:
        parts.append(F.col("customer_id") == F.lit(c.customer_id))
    if c.store_id is not None:
        parts.append(F.col("store_id") == F.lit(c.store_id))
    elif c.store_name is not None:
        parts.append(F.col("store_name").ilike(f"%{c.store_name}%"))
    elif c.store_like is not None:
        parts.append(F.col("_like"))
    if c.date_from is not None:
        parts.append(F.col("transaction_ts") >= F.lit(c.date_from).cast("timestamp"))
    if c.date_to is not None:
        parts.append(F.col("transaction_ts") <= F.lit(c.date_to).cast("timestamp") + F.expr("INTERVAL 1 DAY"))
    if c.amount_min is not None or c.amount_max is not None:
        def amount(v: float | str | None) -> Column:
            return F.lit(None if v is None else str(v)).cast("decimal(20,6)")

        lower, upper = amount_bounds(amount(c.amount_min), amount(c.amount_max))
        parts.append(F.col("total_cents").between(lower, upper))
    if c.card_last4 is not None:
        parts.append(F.col("card_last4") == F.lit(c.card_last4))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole & part
    return whole


def newest_first() -> list[Column]:
    return [F.desc("transaction_ts"), F.asc("transaction_id")]


def fuzzy_search(receipts: DataFrame, criteria: Criteria, stores: DataFrame | None = None) -> DataFrame:
    """The newest receipts that meet all criteria. A name that may be misspelt is compared with the distinct store names, of
    `stores` where given, and the receipts of those that resemble it are taken."""
    c = criteria.check()
    columns = receipts.columns
    if c.store_like is not None and c.store_id is None and c.store_name is None:
        names = (receipts if stores is None else stores).select("store_name").distinct()
        alike = trigram_match(names, "store_name", c.store_like, LIKE).select("store_name", F.lit(True).alias("_like"))
        receipts = receipts.join(alike, "store_name")
    found = receipts.filter(predicate(c)).select(*columns).orderBy(*newest_first())
    return (found.offset(c.offset) if c.offset else found).limit(c.limit)


def _day(name: str) -> Column:
    return F.expr(f"try_cast({name} AS timestamp)")


def _amount(name: str) -> Column:
    return F.expr(f"try_cast({name} AS decimal(20,6))")


def _rules() -> list[tuple[str, Column]]:
    """What a search must not do, most basic first: the code and the condition over its columns. Single and bulk search go by
    this one table."""
    amounts, days = ("amount_min", "amount_max"), ("date_from", "date_to")
    specific = F.coalesce(*(F.col(n).cast("string") for n in (
        "customer_id", "store_id", "store_name", "store_like", "card_last4", "amount_min", "amount_max")))
    dated = F.col("date_from").isNotNull() | F.col("date_to").isNotNull()
    return [
        *((f"{n}_unreadable", F.col(n).isNotNull() & _amount(n).isNull()) for n in amounts),
        *((f"{n}_{code}", test) for n in amounts for code, test in (("negative", _amount(n) < 0), ("too_large", _amount(n) > MAX_DOLLARS))),
        ("amounts_crossed", _amount("amount_min") > _amount("amount_max")),
        ("limit_out_of_range", ~F.col("limit").between(1, MAX_LIMIT)),
        ("offset_negative", F.col("offset") < 0),
        ("card_not_four_digits", ~F.col("card_last4").rlike("^[0-9]{4}$")),
        *((f"{n}_unreadable", F.col(n).isNotNull() & _day(n).isNull()) for n in days),
        ("store_like_without_letters", F.size(trigrams(F.col("store_like"))) == 0),
        ("no_criterion", specific.isNull() & ~dated),
        ("dates_alone_too_broad", specific.isNull() & dated),
    ]


def search_guard(requests: DataFrame) -> DataFrame:
    """Reads blanks as absent, fills in limit and offset, and adds `problem`: the code of the first rule a search breaks,
    NULL for a good one. A search that is refused never stops the others."""
    if "store_like" not in requests.columns:
        requests = requests.withColumn("store_like", F.lit(None).cast("string"))
    blank = {
        name: F.when(F.col(name).cast("string") == "", None).otherwise(F.col(name)) for name in (*_TEXT, "amount_min", "amount_max")
    }
    r = requests.withColumns({
        **blank, "limit": F.coalesce("limit", F.lit(Criteria.limit)), "offset": F.coalesce("offset", F.lit(Criteria.offset)),
    })
    return r.withColumn("problem", F.coalesce(*(F.when(test, F.lit(code)) for code, test in _rules())))


_RATIO = 1.05


def _amount_band(amount: Column) -> Column:
    """A coarse logarithmic band; non-decreasing in the amount, so a range maps to a run of bands."""
    return F.floor(F.log(F.greatest(amount, F.lit(1)).cast("double")) / F.log(F.lit(_RATIO))).cast("int")


def _matches(like: bool) -> Column:
    """Every criterion a request gives has to hold; `q_` columns are the request's. `like` tells whether any is left whose store
    name may be misspelt; the comparison costs the whole join its generated code."""
    def given(name: str, test: Column) -> Column:
        return F.col(f"q_{name}").isNull() | test

    whole = (
        given("customer_id", F.col("q_customer_id") == F.col("customer_id"))
        & given("store_id", F.col("q_store_id") == F.col("store_id"))
        & given("card_last4", F.col("q_card_last4") == F.col("card_last4"))
        & given("from", F.col("transaction_ts") >= F.col("q_from"))
        & given("to", F.col("transaction_ts") <= F.col("q_to"))
        & given("low", F.col("total_cents").between(F.col("q_low"), F.col("q_high")))
        & given("store_name", _name_matches("store_name", "q_store_name"))
    )
    return whole & given("store_like", trigram_similarity(F.col("store_name"), F.col("q_store_like")) >= LIKE) if like else whole


def _name_matches(name: str, pattern: str) -> Column:
    return F.expr(f"{name} ILIKE concat('%', {pattern}, '%')")


def _stores_named(names: DataFrame, patterns: DataFrame) -> DataFrame:
    """Store names each pattern matches; wildcards in a pattern keep their meaning."""
    keyed = patterns.withColumn("piece", longest_literal(F.col("pattern")))
    lowered = names.select(F.col("store_name").alias("matched_name")).withColumn("lowered", F.lower("matched_name"))
    pairs = contains_pairs(lowered, "lowered", keyed, "piece")
    return pairs.filter(_name_matches("matched_name", "pattern")).select("pattern", "matched_name")


_MONTHLY = ("store", "name", "amount")
_SALTS = 64
#: In place of the month for receipts without a time, which only requests without dates meet.
_NO_MONTH = "none"


def _month(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM")


def _asked(requests: DataFrame) -> DataFrame:
    """Good requests under `q_` names, each with the one way it is answered."""
    low, high = amount_bounds(F.col("amount_min").cast("decimal(20,6)"), F.col("amount_max").cast("decimal(20,6)"))
    good = search_guard(requests).filter(F.col("problem").isNull())
    asked = good.select(
        "request_id",
        F.col("customer_id").alias("q_customer_id"),
        F.col("store_id").alias("q_store_id"),
        F.when(F.col("store_id").isNull(), F.col("store_name")).alias("q_store_name"),
        F.when(F.col("store_id").isNull() & F.col("store_name").isNull(), F.col("store_like")).alias("q_store_like"),
        F.col("card_last4").alias("q_card_last4"),
        _day("date_from").alias("q_from"), (_day("date_to") + F.expr("INTERVAL 1 DAY")).alias("q_to"),
        low.alias("q_low"), high.alias("q_high"),
        F.col("offset").alias("q_offset"), (F.col("offset") + F.col("limit")).alias("q_end"),
    )
    way = (
        F.when(F.col("q_customer_id").isNotNull(), "customer").when(F.col("q_card_last4").isNotNull(), "card")
        .when(F.col("q_store_id").isNotNull(), "store").when(F.col("q_store_name").isNotNull() | F.col("q_store_like").isNotNull(), "name")
        .otherwise("amount")
    )
    return asked.withColumn("way", way)


def _request_keys(asked: DataFrame, names: DataFrame, ways: list[str], first: object, last: object) -> DataFrame:
    """Each request with the keys under which its receipts are found. Broad ways go month by month, open ends being those
    of the receipts."""
    low, high = (F.lit(x).cast("timestamp") for x in (first, last))
    start, end = F.greatest(F.coalesce("q_from", low), low), F.least(F.coalesce("q_to", high), high)
    months = F.when(start <= end, F.transform(
        F.sequence(F.trunc(start, "month"), F.trunc(end, "month"), F.expr("INTERVAL 1 MONTH")), _month
    )).otherwise(F.array().cast("array<string>"))
    untimed = F.when(F.col("q_from").isNull() & F.col("q_to").isNull(), F.array(F.lit(_NO_MONTH)))
    months = F.concat(F.coalesce(months, F.array().cast("array<string>")), F.coalesce(untimed, F.array().cast("array<string>")))
    whens = F.when(F.col("way").isin(*_MONTHLY), months).otherwise(F.array(F.lit("")))
    kind = F.col("way")
    if "name" in ways:
        named = asked.filter(kind == "name")
        patterns = named.filter("q_store_name IS NOT NULL").select(F.col("q_store_name").alias("pattern")).distinct()
        typed = named.filter("q_store_like IS NOT NULL").select(F.col("q_store_like").alias("pattern")).distinct()
        stores = (_stores_named(names, patterns).withColumn("_typed", F.lit(False))
                  .unionByName(similar_names(typed, trigram_index(names, "store_name"), LIKE)
                               .select("pattern", F.col("name").alias("matched_name"), F.lit(True).alias("_typed"))))
        rest = asked.filter(kind != "name").withColumn("matched_name", F.lit(None).cast("string"))
        resolved = (named.withColumns({"pattern": F.coalesce("q_store_name", "q_store_like"), "_typed": F.col("q_store_name").isNull()})
                    .join(stores, ["pattern", "_typed"]).drop("pattern", "_typed"))
        asked = rest.unionByName(resolved.withColumns({n: F.lit(None).cast("string") for n in ("q_store_name", "q_store_like")}))
    else:
        asked = asked.withColumn("matched_name", F.lit(None).cast("string"))
    bands = F.sequence(_amount_band(F.col("q_low")), _amount_band(F.col("q_high")))
    value = (
        F.when(kind == "customer", F.array(F.col("q_customer_id").cast("string")))
        .when(kind == "card", F.array("q_card_last4")).when(kind == "store", F.array(F.col("q_store_id").cast("string")))
        .when(kind == "name", F.array("matched_name"))
        .otherwise(F.transform(bands, lambda b: b.cast("string")))
    )
    keyed = asked.withColumn("_value", F.explode(value)).withColumn("_when", F.explode(whens))
    return keyed.withColumn("_key", F.concat_ws("|", "way", "_value", "_when")).drop("way", "_value", "_when", "matched_name")


def _receipt_keys(receipts: DataFrame, ways: list[str]) -> DataFrame:
    """Each receipt once per way in use."""
    values = {
        "customer": F.col("customer_id").cast("string"), "card": F.col("card_last4"),
        "store": F.col("store_id").cast("string"), "name": F.col("store_name"),
        "amount": _amount_band(F.col("total_cents")).cast("string"),
    }
    month = F.coalesce(_month(F.col("transaction_ts")), F.lit(_NO_MONTH))
    keys = [
        F.when(values[w].isNotNull(), F.concat_ws("|", F.lit(w), values[w], month if w in _MONTHLY else F.lit("")))
        for w in ways
    ]
    return receipts.withColumn("_key", F.explode(F.filter(F.array(*keys), lambda k: k.isNotNull())))


#: Receipts up to about this number are searched at once, more of them after growing samples.
FIRST_SAMPLE = 50_000
_GROWTH = 8
_COARSEST = _GROWTH**5


def _sample(receipts: DataFrame, one_in: int) -> DataFrame:
    """One transaction in so many, always the same ones; the test goes down to the scan."""
    return receipts.filter(F.pmod(F.xxhash64("transaction_id"), F.lit(one_in)) == 0)


def _sample_steps(receipts: DataFrame, first: int) -> list[int]:
    """One transaction in how many each sample holds, the smallest sample first; empty where the receipts are few."""
    about = _sample(receipts, _GROWTH**2).select("transaction_id").count() * _GROWTH**2
    one_in = 1
    while one_in < _COARSEST and about > first * one_in:
        one_in *= _GROWTH
    return [_GROWTH**k for k in range(5, 0, -1) if _GROWTH**k <= one_in]


def _not_older() -> Column:
    """Whether a receipt is the last row of its request's page as found so far (`q_last_ts`, `q_last_id`), or newer."""
    at, key = F.col("transaction_ts"), F.col("transaction_id")
    tied = (at == F.col("q_last_ts")) & (key.isNull() | F.coalesce(key <= F.col("q_last_id"), F.lit(False)))
    return F.col("q_last_ts").isNull() | F.coalesce((at > F.col("q_last_ts")) | tied, F.lit(False))


def _with_last(asked: DataFrame, last: DataFrame) -> DataFrame:
    """Requests that need not look further back than the last row of a page already found."""
    known = last.withColumnRenamed("request_id", "_request")
    near = asked.join(known, F.col("request_id").eqNullSafe(F.col("_request")), "left").drop("_request")
    return near.withColumn("q_from", F.greatest("q_from", "q_last_ts"))


def bulk_fuzzy_search(
    requests: DataFrame, receipts: DataFrame, stores: DataFrame | None = None, span: tuple[object, object] | None = None,
    first_sample: int = FIRST_SAMPLE,
) -> DataFrame:
    """Every request answered as by `fuzzy_search`: its newest `limit` receipts after `offset`, ranked.

    Each request goes one way, by the most selective criterion it gives: customer, card, store, store
    name or amount, the last three month by month. All ways share one join on equal keys over a single
    pass of the receipts, with the remaining criteria inside its condition. Names meet stores through
    shared substrings, misspelt ones through shared trigrams, and amounts through logarithmic bands. The
    matches of a request are cut in each task at the last row of the longest ordinary page before they are
    shuffled; pages deeper than that threshold go apart, ranked in salted parts first, each cut at its own
    last row, so neither a hot store nor one deep page sends its matches to one place. `stores` (store
    names) and `span` (a first and last time that cover all receipts) may be given, each to spare a pass
    over the receipts. Refused requests give no rows.

    Where receipts are many, requests of ordinary pages first search samples of them, each _GROWTH times the one before, from about
    `first_sample` receipts on: the last row of a full page found in a sample is one that the true page does not reach behind,
    so the next search begins there. However many receipts match, a request then meets a few times its page at each step.
    """
    asked = _asked(requests)
    pages = asked.groupBy("way").agg(F.max("q_end").alias("end"), F.bool_or(F.col("q_store_like").isNotNull()).alias("like")).collect()
    ways = sorted(r["way"] for r in pages) or ["customer"]
    if span is None:
        span = receipts.agg(F.min("transaction_ts"), F.max("transaction_ts")).first()
    like = any(r["like"] for r in pages if r["way"] != "name")  # by name they are resolved to stores beforehand
    names = (stores if stores is not None else receipts).select("store_name").distinct()
    ordinary = int(receipts.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")) - 1
    deepest = max((r["end"] for r in pages), default=0)
    page = min(deepest, ordinary) or 1
    folder = None

    def hits(asked: DataFrame, receipts: DataFrame) -> DataFrame:
        keyed = _request_keys(asked, names, ways, *span)
        found = _receipt_keys(receipts, ways).join(keyed, "_key").filter(_matches(like))
        return found if folder is None else found.filter(_not_older())

    def known(asked: DataFrame) -> DataFrame:
        return asked if folder is None else _with_last(asked, receipts.sparkSession.read.parquet(folder))

    # the deepest page asked under an id, should several requests share it
    ends = asked.groupBy("request_id").agg(F.max("q_end").alias("q_end"))
    shallow = ends.filter(F.col("q_end") <= ordinary).withColumnRenamed("request_id", "_request")
    for one_in in _sample_steps(receipts, first_sample) if pages else []:
        again = asked.drop("q_end").join(shallow, F.col("request_id").eqNullSafe(F.col("_request"))).drop("_request")
        met = hits(known(again), _sample(receipts, one_in)).select("request_id", "q_end", "transaction_ts", "transaction_id")
        full = top_per_key(met, ["request_id"], newest_first(), page, "_at").filter(F.col("_at") == F.col("q_end"))
        last = full.select("request_id", F.col("transaction_ts").alias("q_last_ts"), F.col("transaction_id").alias("q_last_id"))
        # every sample holds the ones before, so a page once full stays full
        before, folder = folder, run_folder(receipts.sparkSession, "pages")
        last.write.parquet(folder)
        if before is not None:
            release_folder(receipts.sparkSession, before)
    found = hits(known(asked), receipts).select("request_id", "q_offset", "q_end", *receipts.columns)
    ranked = top_per_key(found.filter(F.col("q_end") <= ordinary) if deepest > ordinary else found, ["request_id"], newest_first(), page, "position")
    if deepest > ordinary:
        salt = F.pmod(F.xxhash64("transaction_id"), F.lit(_SALTS))
        deep = found.filter(F.col("q_end") > ordinary).withColumn("_salt", salt)
        part = Window.partitionBy("request_id", "_salt").orderBy(*newest_first())
        cut = deep.withColumn("_at", F.row_number().over(part)).filter(F.col("_at") <= F.col("q_end")).drop("_salt", "_at")
        whole = Window.partitionBy("request_id").orderBy(*newest_first())
        ranked = ranked.unionByName(cut.withColumn("position", F.row_number().over(whole)))
    return ranked.filter((F.col("position") > F.col("q_offset")) & (F.col("position") <= F.col("q_end"))).select(
        "request_id", "position", *receipts.columns
    )


def select_fields(df: DataFrame, wanted: str | None) -> DataFrame:
    """The columns named in a comma list, in table order; unknown names are ignored, a blank list keeps all."""
    names = {part.strip() for part in (wanted or "").split(",") if part.strip()}
    return df.select(*(f"`{c}`" for c in df.columns if c in names)) if names else df


def without_line_items(df: DataFrame) -> DataFrame:
    return df.drop("line_items")


def capped_result(df: DataFrame, rows: int = 50) -> DataFrame:
    return df.limit(rows)


def with_card(receipts: DataFrame) -> DataFrame:
    """Receipts paid by card, the rows a card search can meet."""
    return receipts.filter(F.col("card_last4").isNotNull())


def card_window_lookup(receipts: DataFrame, lookups: DataFrame, days: int = 1) -> DataFrame:
    """Receipts on a card at a store within `days` of a time, for every row of `lookups`.

    `lookups` holds lookup_id, card_last4, store_id and around. The day is part of the join key, so a
    hot card or store spreads over its days.
    """
    near = lookups.select(
        "lookup_id", F.col("card_last4").alias("_card"), F.col("store_id").alias("_store"), "around",
        F.explode(F.sequence(F.date_sub(F.to_date("around"), days), F.date_add(F.to_date("around"), days))).alias("_day"),
    )
    span = F.expr(f"INTERVAL {int(days)} DAY")
    dated = with_card(receipts).withColumn("_date", F.to_date("transaction_ts"))
    return near.join(
        dated,
        (F.col("_card") == F.col("card_last4")) & (F.col("_store") == F.col("store_id")) & (F.col("_day") == F.col("_date"))
        & F.col("transaction_ts").between(F.col("around") - span, F.col("around") + span),
    ).drop("_card", "_store", "_day", "_date")


def trigrams(text: Column) -> Column:
    """Three-letter pieces of each word, padded with two blanks before and one after, in lower case."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def grams(word: Column) -> Column:
        padded = F.concat(F.lit("  "), word, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.length(word) + 1), lambda i: F.substring(padded, i, F.lit(3)))

    return F.array_distinct(F.flatten(F.transform(words, grams)))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared over all trigrams; 0 where neither text has any."""
    return _overlap(trigrams(a), trigrams(b))


def _overlap(left: Column, right: Column) -> Column:
    shared = F.size(F.array_intersect(left, right))
    union = F.size(left) + F.size(right) - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def trigram_index(texts: DataFrame, column: str) -> DataFrame:
    """Posting rows of the distinct texts: gram, how many texts hold it, name, its number of grams and the gram's place among
    them, rarest first. Worth storing where texts are many."""
    names = texts.select(F.col(column).alias("name")).distinct().withColumn("grams", trigrams(F.col("name")))
    each = names.select("name", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    counts = each.groupBy("gram").agg(F.count(F.lit(1)).alias("held_by"))
    rarest = Window.partitionBy("name").orderBy("held_by", "gram")
    return each.join(counts, "gram").select("gram", "held_by", "name", "n", F.row_number().over(rarest).alias("place"))


def similar_names(patterns: DataFrame, index: DataFrame, threshold: float = LIKE) -> DataFrame:
    """pattern, name, similarity: the indexed names that resemble each distinct `pattern` despite typing errors.

    Of texts with a and b grams that are similar enough, b lies between threshold * a and a / threshold, and one of the rarest
    a - ceil(threshold * a) + 1 grams of each is among those they share; so only rare grams are joined, and only names of a
    fitting length. Grams that no name holds are the rarest of all. The pairs that meet are then compared by all their grams.
    """
    asked = patterns.select("pattern").distinct().withColumn("grams", trigrams(F.col("pattern"))).filter(F.size("grams") > 0)
    each = asked.select("pattern", F.size("grams").alias("a"), F.explode("grams").alias("gram"))
    known = index.select("gram", "held_by").distinct()
    rarest = Window.partitionBy("pattern").orderBy("held_by", "gram")
    ranked = (each.join(known, "gram", "left").withColumn("held_by", F.coalesce("held_by", F.lit(0)))
              .withColumn("at", F.row_number().over(rarest)))

    def among_rare(at: str, n: str) -> Column:
        return F.col(at) <= F.col(n) - F.ceil(F.col(n) * threshold - 1e-9) + 1

    fits = (F.col("n") >= F.col("a") * threshold - 1e-9) & (F.col("n") * threshold <= F.col("a") + 1e-9)
    met = (ranked.filter((F.col("held_by") > 0) & among_rare("at", "a")).drop("held_by")
           .join(index.filter(among_rare("place", "n")).drop("held_by"), "gram").filter(fits).select("pattern", "name").distinct())
    scored = met.withColumn("similarity", trigram_similarity(F.col("pattern"), F.col("name")))
    return scored.filter(F.col("similarity") >= threshold)


def trigram_match(df: DataFrame, column: str, text: str, threshold: float = 0.3) -> DataFrame:
    """Rows whose text resembles `text` despite typing errors, with their `similarity`."""
    wanted = df.sparkSession.range(1).select(trigrams(F.lit(text))).first()[0]
    known = F.lit(wanted) if wanted else F.array().cast("array<string>")
    scored = df.withColumn("similarity", _overlap(trigrams(F.col(column)), known))
    return scored.filter(F.col("similarity") >= threshold)


def audit_filter(
    log: DataFrame, rep: str | None = None, action: str | None = None, resource_type: str | None = None,
    date_from: str | None = None, date_to: str | None = None, limit: int = 100,
) -> DataFrame:
    """Newest audit rows meeting the filters given; the upper date is a point in time, not a whole day."""
    for name, value in (("rep_email", rep), ("action", action), ("resource_type", resource_type)):
        if value:
            log = log.filter(F.col(name) == value)
    if date_from:
        log = log.filter(F.col("created_at") >= F.lit(date_from).cast("timestamp"))
    if date_to:
        log = log.filter(F.col("created_at") <= F.lit(date_to).cast("timestamp"))
    return log.orderBy(F.desc("created_at"), F.asc("audit_id")).limit(limit)
