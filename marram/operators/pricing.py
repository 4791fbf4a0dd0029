"""Fee policies, quotes, processor fees and splits, in integer kobo."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marram.functions.constants import FEE_POLICIES
from marram.functions.money import apply_bps, clamp_kobo, int_div, round_to_step
from marram.functions.text import col
from marram.schemas import FEE_POLICY


def default_fee_policies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FEE_POLICIES, FEE_POLICY)


def policy_problem(p: Column | str = "policy") -> Column:
    """Why a policy can't be used; null if it can."""
    p = col(p)
    return (
        F.when((p["rate_bps"] < 0) | (p["rate_bps"] > 5_000), "rate out of range")
        .when(p["min_fee_kobo"] < 0, "least fee is negative")
        .when(p["max_fee_kobo"] < p["min_fee_kobo"], "greatest fee is below the least")
        .when((p["vat_rate_bps"] < 0) | (p["vat_rate_bps"] > 2_500), "VAT out of range")
    )


def resolve_fee_policy(rows: DataFrame, policies: DataFrame, partner_col: str | None = "partner_id", state_col: str | None = "state") -> DataFrame:
    """rows with policy, a struct: the partner's, else the state's, else the global one; null if none fits.

    The policy table holds one row for each scope and subject, the first by id; it is broadcast while it is as small as
    tables of terms are, which the planner decides by its size."""
    names = policies.columns
    one = policies.groupBy("scope", "subject_id").agg(F.min_by(F.struct(*names), "id").alias("policy"))
    out = rows
    scopes = [("PARTNER", partner_col), ("STATE", state_col), ("GLOBAL", None)]
    for scope, on in scopes:
        mine = one.where(F.col("scope") == scope)
        name = f"policy_{scope.lower()}"
        if scope == "GLOBAL":
            least = mine.agg(F.min_by("policy", F.col("policy.id")).alias(name))
            out = out.crossJoin(F.broadcast(least))  # one row
        elif on is None:
            out = out.withColumn(name, F.lit(None).cast(one.schema["policy"].dataType))
        else:
            key = f"_{scope.lower()}_subject"
            side = mine.select(F.col("subject_id").alias(key), F.col("policy").alias(name))
            out = out.join(side, F.col(on).cast("string") == F.col(key), "left").drop(key)
    return out.withColumn("policy", F.coalesce("policy_partner", "policy_state", "policy_global")).drop("policy_partner", "policy_state", "policy_global")


def best_discount(nights: Column | str, rules: list[tuple[str, int, int]]) -> Column:
    """Of rules (label, least nights, bps), the greatest discount that the stay is long enough for; the first of equals."""
    best = F.lit(None).cast("struct<label:string,bps:int>")
    for _, (label, least, bps) in sorted(enumerate(rules), key=lambda r: (r[1][2], -r[0])):
        best = F.when(col(nights) >= least, F.struct(F.lit(label).alias("label"), F.lit(bps).alias("bps"))).otherwise(best)
    return best


def compute_quotes(
    stays: DataFrame, rate_col: str = "nightly_rate_kobo", extra_guests: str | None = None, extra_fee: str | None = None, cleaning_fee: str | None = None, discount_bps: str | None = None,
) -> DataFrame:
    """stays (with nights, a rate and a policy) with a quote's columns and problem: why a stay can't be priced, else null.

    Missing extras count as 0. The fee is the rate of room less discount plus add-ons, within its bounds, rounded to the
    policy's step; VAT is on the fee, rounded likewise. Each step is a projection of its own, so that what it uses twice is
    computed once."""
    zero, p = F.lit(0).cast("long"), F.col("policy")
    part = lambda c: zero if c is None else F.coalesce(F.col(c).cast("long"), zero)
    n, guests, each = F.col("nights").cast("long"), part(extra_guests), part(extra_fee)
    base = F.col("room_kobo") - F.col("discount_kobo") + F.col("addon_kobo")
    floor = F.greatest(p["min_fee_kobo"], F.coalesce(p["min_nightly_fee_kobo"], zero) * n)
    steps = [
        {"room_kobo": F.col(rate_col).cast("long") * n, "addon_kobo": F.when((guests > 0) & (each > 0), each * guests * n).otherwise(zero), "cleaning_kobo": F.greatest(part(cleaning_fee), zero)},
        {"discount_kobo": apply_bps("room_kobo", part(discount_bps))},
        {"partner_net_kobo": base + F.col("cleaning_kobo"), "fee_kobo": apply_bps(base, p["rate_bps"])},
        {"fee_kobo": clamp_kobo("fee_kobo", floor, p["max_fee_kobo"])},
        {"fee_kobo": round_to_step("fee_kobo", p["rounding_step_kobo"])},
        {"vat_kobo": apply_bps("fee_kobo", p["vat_rate_bps"])},
        {"vat_kobo": round_to_step("vat_kobo", p["rounding_step_kobo"])},
        {"platform_net_kobo": F.col("fee_kobo") + F.col("vat_kobo"), "total_kobo": F.col("partner_net_kobo") + F.col("fee_kobo") + F.col("vat_kobo"), "policy_id": p["id"]},
    ]
    quoted = stays
    for step in steps:
        quoted = quoted.withColumns(step)
    problem = F.coalesce(
        F.when(p.isNull(), "no fee policy"), policy_problem(), F.when(F.coalesce(F.col(rate_col), F.lit(0)) <= 0, "rate must be positive"),
        F.when(F.coalesce(F.col("nights"), F.lit(0)) <= 0, "check-out must be after check-in"), F.when(F.col("partner_net_kobo") <= 0, "partner net must be positive"),
        F.when(F.col("partner_net_kobo") + F.col("platform_net_kobo") != F.col("total_kobo"), "parts don't make the total"),
    )
    return quoted.withColumn("problem", problem)


def quote_lines(quotes: DataFrame, keys: list[str]) -> DataFrame:
    """A quote's lines, (keys, position, line, kind, amount_kobo): up to six, those that are zero left out but for room and fee."""
    lines = [
        ("room", "ROOM", F.col("room_kobo"), True), ("extra_guests", "ADDON", F.col("addon_kobo"), False), ("los_discount", "DISCOUNT", -F.col("discount_kobo"), False),
        ("cleaning_fee", "PASSTHROUGH", F.col("cleaning_kobo"), False), ("service_fee", "FEE", F.col("fee_kobo"), True), ("service_fee_vat", "TAX", F.col("vat_kobo"), False),
    ]
    array = F.filter(F.array(*[F.struct(F.lit(k).alias("line"), F.lit(kind).alias("kind"), a.alias("amount_kobo"), F.lit(always).alias("always")) for k, kind, a, always in lines]), lambda x: x["always"] | (x["amount_kobo"] != 0))
    return quotes.select(*keys, F.posexplode(array).alias("position", "x")).select(*keys, "position", "x.line", "x.kind", "x.amount_kobo")


def processor_fee(amount: Column | str, rate_bps: int, flat_kobo: int, cap_kobo: int | None) -> Column:
    """A payment processor's fee: rate and flat part, capped; 0 for an amount that isn't positive."""
    fee = clamp_kobo(apply_bps(amount, F.lit(rate_bps)) + flat_kobo, F.lit(0).cast("long"), F.lit(cap_kobo).cast("long"))
    return F.when(col(amount) <= 0, F.lit(0).cast("long")).otherwise(fee)


def compute_splits(quotes: DataFrame, rate_bps: int, flat_kobo: int, cap_kobo: int | None, bearer: str = "platform", withholding: int = 0) -> DataFrame:
    """quotes with processor_fee_kobo, partner_share_kobo, platform_share_kobo, the partner's percentage and split_problem.

    bearer pays the processor: 'partner' or 'platform'."""
    gross = F.col("partner_net_kobo") - withholding
    split = quotes.withColumn("processor_fee_kobo", processor_fee("total_kobo", rate_bps, flat_kobo, cap_kobo))
    split = split.withColumn("partner_share_kobo", gross - F.col("processor_fee_kobo") if bearer == "partner" else gross)
    split = split.withColumn("platform_share_kobo", F.col("total_kobo") - F.col("partner_share_kobo") - F.col("processor_fee_kobo"))
    problem = F.when(gross <= 0, "partner share is not positive").when(F.col("partner_share_kobo") <= 0, "partner share can't cover the processor").when(F.col("platform_share_kobo") <= 0, "service fee can't cover the processor")
    return split.withColumns({"partner_percent": split_percent("partner_share_kobo", "total_kobo"), "split_problem": problem})


def split_percent(part: Column | str, total: Column | str) -> Column:
    """Whole percents of the total, rounded down; the other side gets the rest. Null for a total that isn't positive."""
    return F.when(col(total) > 0, int_div(col(part) * 100, F.nullif(col(total), F.lit(0))))


def ledger_balance(legs: DataFrame, quotes: DataFrame, key: str = "booking_id") -> DataFrame:
    """Sum of a booking's legs against its total: (key, legs_kobo, total_kobo, balanced)."""
    sums = legs.groupBy(key).agg(F.sum("amount_kobo").alias("legs_kobo"))
    return quotes.select(key, "total_kobo").join(sums, key, "left").withColumn("legs_kobo", F.coalesce("legs_kobo", F.lit(0))).withColumn("balanced", F.col("legs_kobo") == F.col("total_kobo"))
