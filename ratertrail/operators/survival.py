"""How long a labelled entity survives along its revisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ratertrail.functions.ordering import BAND, group_ordinal, join_null_safe, time_band
from ratertrail.functions.scalar import elapsed_days, flag_negative

# Causes of death in order of precedence, and the mark of a censored row.
UNREADABLE = "path_unreadable_at_revision"
GONE = "entity_not_found"
FAILS = "condition_no_longer_holds"
CENSORED = "right_censored_at_last_observed_revision"


def revision_ordinal(history: DataFrame, entity: Sequence[str], ts: str, ties: Sequence[str], start: int = 0) -> DataFrame:
    """Number the revisions of each entity from its label (0) on."""
    return group_ordinal(history, entity, [ts, *ties], time_band(ts), "ordinal", start)


def death_cause(readable: str, alive: str, holds: str) -> Column:
    """Why a revision ends the walk, null when it does not; an unknown condition does not end it."""
    return (
        F.when(~F.coalesce(F.col(readable), F.lit(False)), UNREADABLE)
        .when(~F.coalesce(F.col(alive), F.lit(False)), GONE)
        .when(~F.coalesce(F.col(holds), F.lit(True)), FAILS)
    )


def _baseline_reason(readable: Column, alive: Column, holds: Column, require_condition: bool) -> Column:
    """Why a label is no starting point, null when it is one."""
    reason = F.when(~readable, "path_unreadable_at_labelled_commit").when(~alive, "entity_not_found_at_labelled_commit")
    return reason.when(~holds, "condition_not_met_at_labelled_commit") if require_condition else reason


def _outcome(df: DataFrame, keep: Sequence[str], label_pos: str, label_ts: str) -> DataFrame:
    """Turn label position, first death and last revision (structs ``ordinal, ts, commit[, cause]``) into the result columns.

    Rows with a ``failure_reason`` keep it and get no results.
    """
    died = F.col("__death").isNotNull()
    end = lambda field: F.when(died, F.col(f"__death.{field}")).otherwise(F.col(f"__last.{field}"))
    days = elapsed_days(F.col(label_ts), end("ts"))
    out = df.select(
        *keep,
        "failure_reason",
        (F.col("__last.ordinal") - F.col(label_pos)).cast("long").alias("n_revisions_observed"),
        (end("ordinal") - F.col(label_pos)).cast("long").alias("persistence_revisions"),
        days.alias("persistence_days"),
        flag_negative(days).alias("days_anomalous_negative"),
        (~died).alias("censored"),
        F.when(died, F.col("__death.cause")).otherwise(CENSORED).alias("death_reason"),
        F.col(label_ts).alias("labelled_commit_date"),
        end("commit").alias("death_commit"),
        end("ts").alias("death_commit_date"),
        F.col("__last.commit").alias("last_observed_commit"),
        F.col("__last.ts").alias("last_observed_commit_date"),
    )
    results = out.columns[len(keep) + 1 :]
    return out.withColumns({c: F.when(F.col("failure_reason").isNull(), F.col(c)) for c in results})


def persistence_walk(
    history: DataFrame,
    entity: Sequence[str],
    ordinal: str,
    ts: str,
    readable: str,
    alive: str,
    holds: str,
    commit: str,
    require_baseline_condition: bool = False,
) -> DataFrame:
    """One row per entity from its numbered history, revision 0 being the label.

    The first later revision that is unreadable, lacks the entity or fails the condition ends
    the walk; without one the entity is censored at its last revision. ``failure_reason`` is
    set, and the other results null, when revision 0 itself is unreadable or lacks the entity.
    A single aggregation: deaths are minima, so hot entities combine before the shuffle.
    """
    at = F.struct(F.col(ordinal).alias("ordinal"), F.col(ts).alias("ts"), F.col(commit).cast("string").alias("commit"))
    cause = death_cause(readable, alive, holds)
    dead = F.when((F.col(ordinal) > 0) & cause.isNotNull(), at.withField("cause", cause))
    baseline = [F.coalesce(F.col(readable), F.lit(False)), F.coalesce(F.col(alive), F.lit(False))]
    folded = history.groupBy(*entity).agg(
        F.min(dead).alias("__death"),
        F.max(at).alias("__last"),
        F.min(F.when(F.col(ordinal) == 0, F.col(ts))).alias("__label_ts"),
        F.bool_or((F.col(ordinal) == 0) & baseline[0]).alias("__readable"),
        F.bool_or((F.col(ordinal) == 0) & baseline[1]).alias("__alive"),
        F.bool_or((F.col(ordinal) == 0) & F.coalesce(F.col(holds), F.lit(False))).alias("__holds"),
    )
    reason = _baseline_reason(F.col("__readable"), F.col("__alive"), F.col("__holds"), require_baseline_condition)
    return _outcome(folded.withColumns({"failure_reason": reason, "__zero": F.lit(0)}), entity, "__zero", "__label_ts")


def persistence_from_labels(
    events: DataFrame,
    entity: Sequence[str],
    ts: str,
    ties: Sequence[str],
    is_label: Column,
    readable: str,
    alive: str,
    holds: str,
    commit: str,
    keep: Sequence[str] = (),
    require_baseline_condition: bool = False,
) -> DataFrame:
    """The same walk from every label point of a history that several labels share.

    Each event learns the first death after it from a reverse running minimum: no label is
    joined to its later revisions, so the work stays linear in the events. Bands of the clock
    split hot entities, as in ``functions.ordering``.
    """
    entity = list(entity)
    numbered = group_ordinal(events, entity, [ts, *ties], time_band(ts), "ordinal")
    at = F.struct("ordinal", F.col(ts).alias("ts"), F.col(commit).cast("string").alias("commit"))
    cause = death_cause(readable, alive, holds)
    marked = numbered.withColumns({"__at": at, "__dead": F.when(cause.isNotNull(), at.withField("cause", cause)), BAND: time_band(ts)})
    per_band = marked.groupBy(*entity, BAND).agg(F.min("__dead").alias("__band_dead"), F.max("__at").alias("__band_last"))
    later = W.partitionBy(*entity).orderBy(F.desc(BAND)).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*entity).orderBy(BAND).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ahead = per_band.select(
        *entity, BAND, F.min("__band_dead").over(later).alias("__later_dead"), F.max("__band_last").over(whole).alias("__last")
    )
    inside = W.partitionBy(*entity, BAND).orderBy(F.desc("ordinal")).rowsBetween(W.unboundedPreceding, -1)
    local = marked.withColumn("__local_dead", F.min("__dead").over(inside)).filter(is_label)
    known = [F.coalesce(F.col(readable), F.lit(False)), F.coalesce(F.col(alive), F.lit(False)), F.coalesce(F.col(holds), F.lit(False))]
    joined = join_null_safe(local, ahead, [*entity, BAND]).withColumns({
        "__death": F.coalesce("__local_dead", "__later_dead"),
        "failure_reason": _baseline_reason(*known, require_baseline_condition),
    })
    return _outcome(joined, [*entity, *keep], "ordinal", ts)
