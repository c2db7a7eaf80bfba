"""The append-only review log: its rules, its replay to states and resolutions, and checks of what was applied.

A log row: sequence, event_id, action (activate, supersede, retract), review_id, target_review_id, decision, decided_at,
members (array of source_code, record_id, fingerprint). Reviews own their members alone, so the last event of a member
decides about it, and replay needs no order between members.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MEMBER = ["source_code", "record_id"]


def members(log: DataFrame) -> DataFrame:
    return log.select("sequence", "event_id", "action", "review_id", "decision", F.explode("members").alias("m")).select("sequence", "event_id", "action", "review_id", "decision", "m.source_code", "m.record_id", "m.fingerprint")


def member_events(log: DataFrame) -> DataFrame:
    """What happens to each member: it is claimed by a review, or let go by a retraction of the review that held it."""
    claimed = members(log.filter(F.col("action").isin("activate", "supersede")))
    held = claimed.select(F.col("review_id").alias("target_review_id"), *MEMBER, "fingerprint").distinct()
    freed = log.filter("action = 'retract'").select("sequence", "event_id", "action", "review_id", "decision", "target_review_id").join(held, "target_review_id").select(*claimed.columns)
    return claimed.unionByName(freed)


def review_states(log: DataFrame) -> DataFrame:
    """Each review's state: active, superseded or retracted, by the event that closed it, if any."""
    opened = log.filter(F.col("action").isin("activate", "supersede")).select("review_id", "decision", F.col("sequence").alias("opened_at"))
    closed = log.filter(F.col("action").isin("supersede", "retract")).groupBy(F.col("target_review_id").alias("review_id")).agg(F.min_by("action", "sequence").alias("_by"))
    return opened.join(closed, "review_id", "left").select("review_id", "decision", "opened_at", F.when(F.col("_by") == "supersede", "superseded").when(F.col("_by") == "retract", "retracted").otherwise("active").alias("state"))


def resolutions(log: DataFrame) -> DataFrame:
    """The review that holds each member after the last event, with its decision; members let go have none."""
    last = member_events(log).groupBy(*MEMBER).agg(F.max_by(F.struct("action", "review_id", "decision", "fingerprint"), "sequence").alias("e"))
    return last.filter("e.action <> 'retract'").select(*MEMBER, "e.review_id", "e.decision", "e.fingerprint")


def as_of(log: DataFrame, cutoff) -> DataFrame:
    """The log as it was decided up to a moment."""
    return log.filter(F.col("decided_at") <= F.lit(cutoff))


def projection(records: DataFrame, log: DataFrame) -> DataFrame:
    """Adds is_anomaly: whether an active resolution leaves the record out of training."""
    out = resolutions(log).filter("decision = 'exclude_from_train'").select(*MEMBER, F.lit(True).alias("_x"))
    return records.join(out, MEMBER, "left").withColumn("is_anomaly", F.col("_x").isNotNull()).drop("_x")


def projection_mismatches(stored: DataFrame, log: DataFrame) -> DataFrame:
    """Records whose stored is_anomaly is not the replayed one, and resolutions of records that are not there."""
    want = resolutions(log).filter("decision = 'exclude_from_train'").select(*MEMBER, F.lit(True).alias("expected"))
    both = stored.select(*MEMBER, F.col("is_anomaly").alias("found")).join(want, MEMBER, "full_outer")
    return both.filter(~F.coalesce("expected", F.lit(False)).eqNullSafe(F.col("found"))).select(*MEMBER, F.coalesce("expected", F.lit(False)).alias("expected"), "found")


def violations(log: DataFrame, sources: list[str]) -> DataFrame:
    """sequence and violation for each broken rule. An empty result is a sound log.

    A target that no earlier event opened is unknown, and nothing further is said of it; one that was opened and closed
    before is not active.
    """
    told = lambda df, name: df.select("sequence", F.lit(name).alias("violation"))
    prior = log.select((F.col("sequence") + 1).alias("sequence"), F.col("decided_at").alias("_before")).dropDuplicates(["sequence"])
    linked = log.join(prior, "sequence", "left")
    m = members(log)
    opened = log.filter(F.col("action").isin("activate", "supersede")).select(F.col("review_id").alias("_review"), F.col("sequence").alias("_opened"), F.col("members").alias("_members"))
    closed = log.filter(F.col("action").isin("supersede", "retract")).select(F.col("target_review_id").alias("_review"), F.col("sequence").alias("_closed"))
    closing = log.filter(F.col("action").isin("supersede", "retract"))
    known = closing.join(opened, (F.col("target_review_id") == F.col("_review")) & (F.col("_opened") < F.col("sequence")), "left")
    stale = known.filter("_review is not null").drop("_review", "_opened", "_members").join(closed, (F.col("target_review_id") == F.col("_review")) & (F.col("_closed") < F.col("sequence")))
    keys = lambda c: F.array_sort(F.transform(c, lambda x: F.struct(x["source_code"], x["record_id"], x["fingerprint"])))
    before = Window.partitionBy(*MEMBER).orderBy("sequence")
    each = member_events(log).dropDuplicates(["sequence", *MEMBER]).withColumn("_last", F.lag("action").over(before))
    parts = [
        told(linked.filter(F.col("_before").isNull() & (F.col("sequence") != 1)), "sequence_gap"),
        told(log.groupBy("sequence").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "sequence_repeated"),
        told(log.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("event_id"))).filter("_n > 1"), "event_id_repeated"),
        told(log.filter(~F.coalesce(F.col("action").isin("activate", "supersede", "retract"), F.lit(False))), "unknown_action"),
        told(m.filter(~F.coalesce(F.col("source_code").isin(sources), F.lit(False))), "unknown_source"),
        told(m.groupBy("sequence", *MEMBER).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "member_repeated"),
        told(log.filter("action <> 'retract'").withColumn("_k", F.row_number().over(Window.partitionBy("review_id").orderBy("sequence"))).filter("_k > 1"), "review_id_reused"),
        told(known.filter("_review is null"), "target_unknown"),
        told(stale, "target_not_active"),
        told(known.filter((F.col("action") == "supersede") & F.col("_review").isNotNull() & (keys(F.col("members")) != keys(F.col("_members")))), "supersede_changes_members"),
        told(each.filter("action = 'activate' and _last in ('activate', 'supersede')"), "overlapping_ownership"),
        told(linked.filter("decided_at < _before"), "decided_at_decreases"),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts).distinct()


def log_hash(log: DataFrame) -> DataFrame:
    """Each event with a hash of its whole payload."""
    return log.withColumn("payload_sha256", F.sha2(F.to_json(F.struct(*sorted(log.columns)), {"ignoreNullFields": "false"}), 256))


def payload_drift(log: DataFrame, applied: DataFrame) -> DataFrame:
    """Applied events whose payload is no longer that of the log. applied: event_id, payload_sha256."""
    now = log_hash(log).select("event_id", F.col("payload_sha256").alias("_now"))
    return applied.join(now, "event_id", "left").filter(~F.col("payload_sha256").eqNullSafe(F.col("_now"))).select("event_id")


def verify(log: DataFrame, applied_events: DataFrame, states: DataFrame, resolved: DataFrame, records: DataFrame) -> DataFrame:
    """What was applied against what the log says, layer by layer: layer, subject, problem. records: source_code, record_id, fingerprint, is_anomaly."""

    def differ(layer: str, want: DataFrame, have: DataFrame, key: list[str], value: str) -> DataFrame:
        both = want.select(*key, F.col(value).alias("_w"), F.lit(True).alias("_iw")).join(have.select(*key, F.col(value).alias("_h"), F.lit(True).alias("_ih")), key, "full_outer")
        why = F.when(F.col("_ih").isNull(), "missing").when(F.col("_iw").isNull(), "unexpected").when(~F.col("_w").eqNullSafe(F.col("_h")), "differs")
        return both.select(F.lit(layer).alias("layer"), F.concat_ws("|", *[F.col(k).cast("string") for k in key]).alias("subject"), why.alias("problem")).filter("problem is not null")

    own = resolutions(log)
    prints = own.join(records.select(*MEMBER, F.col("fingerprint").alias("_now")), MEMBER, "left").filter(~F.col("fingerprint").eqNullSafe(F.col("_now")))
    want_flag = projection(records.drop("is_anomaly"), log)
    return reduce(
        lambda a, b: a.unionByName(b),
        [
            differ("events", log_hash(log), applied_events, ["event_id"], "payload_sha256"),
            differ("decisions", review_states(log), states, ["review_id"], "state"),
            differ("resolutions", own, resolved, MEMBER, "review_id"),
            differ("projection", want_flag, records, MEMBER, "is_anomaly"),
            prints.select(F.lit("fingerprints").alias("layer"), F.concat_ws("|", "source_code", F.col("record_id").cast("string")).alias("subject"), F.lit("differs").alias("problem")),
        ],
    )


def consumer_gate(problems: DataFrame, last_sync_ok: bool, same_file: bool) -> DataFrame:
    """One row: whether consumers may read, and why not."""
    out = problems.agg(F.count(F.lit(1)).alias("n_problems"))
    return out.withColumn("open", (F.col("n_problems") == 0) & F.lit(last_sync_ok) & F.lit(same_file))
