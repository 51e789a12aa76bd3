"""What a piece costs, and how it is scored."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from stallwise.schemas import DISCOUNT_TYPES, MAX_DISCOUNT

DAY_MICROS = 86_400_000_000.0


def half_up(c: Column) -> Column:
    return F.floor(c + F.lit(0.5))


def less_percent(amount: Column, percent: Column) -> Column:
    """``amount`` reduced by a percentage (never above the cap), to whole rupees."""
    capped = F.least(F.lit(MAX_DISCOUNT), percent)
    return half_up(amount * (F.lit(1.0) - capped / F.lit(100.0)))


def _amount(c: Column) -> Column:
    return F.greatest(F.lit(0).cast("bigint"), F.coalesce(c.cast("bigint"), F.lit(0)))


def final_price(listed: Column, discount_type: Column, value: Column, store: Column) -> Column:
    """What is left of a list price. A piece's own discount, if above zero, rules out the store's offer."""
    reduced = (
        F.when((value > 0) & (discount_type == "percent"), less_percent(listed, value))
        .when(
            (value > 0) & (discount_type == "amount"),
            F.greatest(less_percent(listed, F.lit(MAX_DISCOUNT)), listed - value),
        )
        .when(store > 0, less_percent(listed, store))
        .otherwise(listed)
    )
    return F.greatest(F.lit(0), F.least(listed, reduced))


def discount_percent(listed: Column, final: Column) -> Column:
    """Percentage on the badge, 0 if nothing is taken off."""
    badge = half_up((F.lit(1.0) - final / listed) * F.lit(100.0))
    return F.when((listed > 0) & (final < listed), badge).otherwise(F.lit(0).cast("bigint"))


def discount_source(discount_type: Column, value: Column, store: Column) -> Column:
    own = (value > 0) & discount_type.isin(*DISCOUNT_TYPES)
    return F.when(own, "product").when(store > 0, "store").otherwise("none")


def with_pricing(df: DataFrame, store_percent: Column | int = 0) -> DataFrame:
    """Attach list price, final price, badge percentage and the discount's source to rows with
    price, discount_type and discount_value.

    The columns are added in steps, so that each is worked out once per row.
    """
    store = store_percent if isinstance(store_percent, Column) else F.lit(store_percent)
    kind, value, offer = F.col("discount_type"), F.col("_value"), F.col("_store")
    listed, final = F.col("list_price"), F.col("final_price")
    steps = df.withColumns(
        {"list_price": _amount(F.col("price")), "_value": _amount(F.col("discount_value")), "_store": store}
    ).withColumns(
        {"final_price": final_price(listed, kind, value, offer), "discount_source": discount_source(kind, value, offer)}
    )
    return steps.withColumn("discount_percent", discount_percent(listed, final)).drop("_value", "_store")


def moment(at: datetime | str | Column) -> Column:
    return at if isinstance(at, Column) else F.lit(at).cast("timestamp")


def log_damped(n: Column) -> Column:
    return F.ln(F.lit(1) + n)


def bayes_rating(total: Column, votes: Column) -> Column:
    """Average rating drawn towards 4.0, as if five such votes had been cast already."""
    return (total + F.lit(20.0)) / (votes + F.lit(5.0))


def freshness(created_at: Column, as_of: datetime | str | Column) -> Column:
    """30 points for a new piece, falling to none over 45 days."""
    days = (F.unix_micros(moment(as_of)) - F.unix_micros(created_at)) / F.lit(DAY_MICROS)
    return F.lit(30.0) * F.greatest(F.lit(0.0), F.lit(1.0) - days / F.lit(45.0))


def rank_score(as_of: datetime | str | Column) -> Column:
    """Score of the recommended order, from a product row's counters; rounded so that ties are ties."""
    # The weights of the score.
    score = (
        F.col("boost") * F.lit(100.0)
        + F.lit(15.0) * log_damped(F.col("order_count"))
        + F.lit(1.5) * log_damped(F.col("views"))
        + F.lit(8.0) * bayes_rating(F.col("rating_sum"), F.col("rating_count"))
        + freshness(F.col("created_at"), as_of)
        - F.when(F.col("stock") <= 0, F.lit(250.0)).otherwise(F.lit(0.0))
    )
    return F.round(score, 6)


def mean_rating(total: Column, votes: Column) -> Column:
    return total / F.greatest(votes, F.lit(1))


def avg_rating(total: Column, votes: Column) -> Column:
    return F.round(mean_rating(total, votes), 1)


def tile_flag(stock: Column, discount_percent: Column, boost: Column) -> Column:
    """The one badge of a catalogue tile; empty when there is none."""
    # The texts of the badges.
    return (
        F.when(stock <= 0, F.lit("Sold — ask us"))
        .when(discount_percent > 0, F.concat(discount_percent.cast("string"), F.lit("% off")))
        .when(boost > 0, F.lit("Featured"))
        .otherwise(F.lit(""))
    )
