"""Work on top of the entities: strict channel filters, samples, submissions, suppression (PRJ-19, JOIN-28, WIN-23..25, SET-06, SET-07, ST-14..22)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.contacts import confirmed_form, suitable_mailbox
from ..functions.review import operational


def contactable(channels: DataFrame, candidates: DataFrame, overlay: DataFrame, banned: list[str]) -> DataFrame:
    """Channels of verified, eligible candidates with operational evidence, a fit mailbox or a confirmed form, and no open chain flag (PRJ-19)."""
    fit = F.when(F.col("channel_type") == "CONTACT_FORM", confirmed_form(F.col("evidence"))).otherwise(suitable_mailbox(F.col("email"), banned))
    good = candidates.where((F.col("verification_status") == "VERIFIED") & (F.col("geo_eligibility_status") == "ELIGIBLE") & operational(F.col("evidence_json")))
    flagged = overlay.where(~F.coalesce("chain_location_concern", F.lit("")).isin("", "NO_STRUCTURED_SIGNAL", "PRESERVED_EXISTING_COHORT"))
    rows = channels.where(fit & (F.coalesce("review_status", F.lit("PENDING")) != "REJECTED"))
    return rows.join(good, "candidate_id", "left_semi").join(flagged, "candidate_id", "left_anti")


def mixed_sample(rows: DataFrame, legs: list[Column], key: str, score: str, limit: int) -> DataFrame:
    """At most limit rows, one a key, legs in order and by score inside (WIN-23, WIN-24). Only `limit` rows a leg are ranked together."""
    leg = F.lit(None).cast("int")
    for k, cond in reversed(list(enumerate(legs))):
        leg = F.when(cond, k).otherwise(leg)
    best = rows.withColumn("leg", leg).where("leg IS NOT NULL")
    best = best.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("leg", F.desc(score), key))).where("_n = 1").drop("_n")
    return best.orderBy("leg", F.desc(score), key).limit(limit)


def recheck_sample(rows: DataFrame, groups: dict[str, Column], order: str, each: int) -> DataFrame:
    """The first `each` rows of every named group (WIN-25)."""
    out = None
    for name, cond in groups.items():
        part = rows.where(cond).orderBy(order).limit(each).withColumn("sample", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def registry(new: DataFrame, existing: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """new upserted over existing: columns in keep stay as they are once they say something (SET-07, ST-21)."""
    old = existing.select(key, *(F.col(c).alias(f"_{c}") for c in keep))
    merged = new.join(old, key, "left")
    merged = merged.select(*(F.coalesce(f"_{c}", c).alias(c) if c in keep else F.col(c) for c in new.columns))
    return merged.unionByName(existing.join(new, key, "left_anti"), allowMissingColumns=True)


def accepted_submissions(submissions: DataFrame, invitations: DataFrame) -> DataFrame:
    """submissions with outcome: unknown token, expired, not delivered, repeated, conflicting or accepted (ST-08, ST-22).

    submissions: token_hash, response_hash, submitted_at; invitations: token_hash, expires_at, delivered."""
    joined = submissions.join(invitations.select("token_hash", "expires_at", "delivered"), "token_hash", "left")
    open_ = F.col("delivered") & (F.col("submitted_at") <= F.col("expires_at"))
    first = Window.partitionBy("token_hash", F.coalesce(open_, F.lit(False))).orderBy("submitted_at", "response_hash")
    numbered = joined.withColumn("_n", F.row_number().over(first)).withColumn("_first", F.first("response_hash").over(first))
    outcome = (
        F.when(F.col("delivered").isNull(), "UNKNOWN_REFERENCE").when(F.col("submitted_at") > F.col("expires_at"), "EXPIRED").when(~F.col("delivered"), "NOT_DELIVERED")
        .when(F.col("_n") == 1, "ACCEPTED").when(F.col("response_hash") == F.col("_first"), "DUPLICATE").otherwise("NEEDS_REVIEW")
    )
    return numbered.select(*submissions.columns, outcome.alias("outcome"))


def suppressed(drafts: DataFrame, suppressions: DataFrame, replies: DataFrame) -> DataFrame:
    """drafts that nothing suppresses: neither the list nor an unsubscribing or withdrawing reply (ST-14, ST-16)."""
    out = replies.where(F.col("reply_class").isin("UNSUBSCRIBE", "DECLINE")).select(F.lower(F.trim("email")).alias("_e"))
    gone = suppressions.select(F.lower(F.trim("email")).alias("_e")).unionByName(out).distinct()
    return drafts.join(gone, F.lower(F.trim("recipient")) == F.col("_e"), "left_anti")
