"""The registered queries: every operator over the whole supplied tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..config import EngineConfig, fixture_config
from ..functions.expressions import (
    blend, canonical_json, canonical_number, compress_z, day_of_week, epoch_micros, excess_score,
    hour_of_day, midnight_text, risk_tier, split_of, stepup_passed, unpacked,
)
from ..operators import audit, decisions, explain, features, feeds, forest, ledgers, peers, sessions, stats
from ..operators.lookup import attach
from ..session import materialize, tune
from ..sources import events as source, logs
from . import policy, risk_model

SNAPSHOT = "2024-01-16 00:00:00"
SEARCH_TERM = "stepup"
TWO_FEATURES = ["data_volume_mb", "after_hours_ratio"]


class Inputs:
    """The supplied tables in the engine's shapes; all lazy."""

    def __init__(self, spark: SparkSession, sf_dir: str, cfg: EngineConfig | None = None):
        self.spark, self.sf_dir = tune(spark), sf_dir
        self.cfg = cfg or fixture_config()

    @cached_property
    def events(self) -> DataFrame:
        return source.read_events(self.spark, self.sf_dir)

    @cached_property
    def activity(self) -> DataFrame:
        return source.activity(self.events)

    @cached_property
    def directory(self) -> DataFrame:
        return source.directory(self.spark, self.sf_dir)

    @cached_property
    def answers(self) -> DataFrame:
        return source.answers(self.events, self.directory, self.cfg)

    @cached_property
    def entitlements(self) -> DataFrame:
        return source.entitlements(self.directory)

    @cached_property
    def user_days(self) -> DataFrame:
        return sessions.fold_cells(sessions.activity_cells(self.activity))

    @cached_property
    def features(self) -> DataFrame:
        return features.feature_matrix(self.activity, self.directory, self.answers, self.cfg)

    @cached_property
    def kept_features(self) -> DataFrame:
        return materialize(self.features, "features")

    @cached_property
    def peaks(self) -> DataFrame:
        """User-days with their greatest value, role, label and split."""
        days = sessions.attach_roles(source.day_peaks(self.events), self.directory)
        return sessions.attach_labels(days, self.answers).withColumn("split", split_of("day", self.cfg))

    def proxy_score(self, rows: DataFrame, value: str) -> Column:
        """A score that plain SQL can repeat: the excess of one column over its training
        baseline."""
        fit = stats.robust_baseline(rows.where("split = 'train'"), F.col(value)).first()
        score = excess_score(F.col(value), F.lit(fit["baseline"]), F.lit(fit["scale"]), self.cfg.peer_k)
        return F.round(score, 6)

    @cached_property
    def scored(self) -> DataFrame:
        rows = self.peaks.withColumn("risk_score", self.proxy_score(self.peaks, "max_value"))
        return (rows.withColumn("isolation_forest_score", F.col("risk_score"))
                .withColumn("peer_group_score", F.col("risk_score"))
                .withColumn("risk_tier", risk_tier(F.col("risk_score"), self.cfg)).drop("max_value"))

    @cached_property
    def volume_scored(self) -> DataFrame:
        """Scored by data volume, so that labels and scores do not coincide."""
        days = sessions.attach_roles(features.volumes(self.user_days), self.directory)
        days = sessions.attach_labels(days, self.answers).withColumn("split", split_of("day", self.cfg))
        days = materialize(days.select("user_id", "day", "role", "split", "is_malicious", "data_volume_mb"), "volumes")
        return days.withColumn("risk_score", self.proxy_score(days, "data_volume_mb"))

    @cached_property
    def volume_held_out(self) -> DataFrame:
        return self.volume_scored.where("split = 'test'")

    @cached_property
    def decisions(self) -> DataFrame:
        return decisions.decide(self.scored, self.cfg)

    @cached_property
    def decision_events(self) -> DataFrame:
        return decisions.decision_events(self.decisions, self.entitlements, self.cfg)

    @cached_property
    def chained(self) -> DataFrame:
        return audit.build_chains(audit.with_chain(self.decision_events, self.cfg), ["user_id", "step_no"])

    @cached_property
    def kept_chain(self) -> DataFrame:
        """Written once: a drill reads the chain several times, and no fold is repeated."""
        return materialize(self.chained, "chained")

    # ---- ledgers
    @cached_property
    def attempts(self) -> DataFrame:
        return source.redeem_attempts(self.events, self.cfg)

    @cached_property
    def revokes(self) -> DataFrame:
        return source.single_revokes(self.events, self.cfg)

    @cached_property
    def states(self) -> DataFrame:
        return ledgers.lease_states(source.lease_grants(self.events), self.attempts, self.revokes,
                                    source.bulk_revokes(self.events), self.cfg)

    @cached_property
    def resumes(self) -> DataFrame:
        return ledgers.resume_outcomes(source.quarantine_events(self.events),
                                       source.resume_requests(self.events), self.cfg)

    @cached_property
    def quarantines(self) -> DataFrame:
        return ledgers.quarantine_ledger(source.quarantine_events(self.events), self.resumes, self.directory)


def shown(df: DataFrame, digits: int = 6) -> DataFrame:
    """Plain result types: whole numbers as bigint, days as text, instants as microseconds,
    flags as 0/1, doubles rounded (and never -0)."""
    cells = []
    for name, kind in df.dtypes:
        col = F.col(name)
        if kind in ("int", "smallint", "tinyint", "boolean"):
            col = col.cast("int").cast("bigint")
        elif kind == "date":
            col = F.date_format(col, "yyyy-MM-dd")
        elif kind == "timestamp_ntz":
            col = epoch_micros(name)
        elif kind in ("double", "float"):
            col = F.round(col, digits) + F.lit(0.0)
        cells.append(col.alias(name))
    return df.select(*cells)


Query = Callable[[Inputs], DataFrame]
QUERIES: dict[str, Query] = {}


def query(digits: int = 6):
    def register(fn: Query) -> Query:
        QUERIES["q_" + fn.__name__] = lambda x: shown(fn(x), digits)
        return fn

    return register


# ---- sessions ------------------------------------------------------------------------------
@query()
def activity_union(x):
    rows = logs.unify_logs(source.logs(x.events))
    return rows.withColumns({"hour": hour_of_day("ts"), "dow": day_of_week("day")})


@query()
def activity_single_pass(x):
    return x.activity


@query()
def user_days(x):
    return sessions.user_day_spine(x.activity)


@query()
def session_duration(x):
    return sessions.session_durations(x.activity)


@query()
def hosts_used(x):
    return sessions.distinct_items(x.activity, "pc", "n_pcs_used")


@query()
def devices_used(x):
    return sessions.distinct_items(x.activity, "device_id", "n_device_connects")


@query()
def file_stats(x):
    return x.user_days.select("user_id", "day", "n_file_events", "file_volume_mb", "export_volume_mb")


@query()
def http_stats(x):
    return x.user_days.select("user_id", "day", "n_http_events", "http_export_mb")


@query()
def email_stats(x):
    return x.user_days.select("user_id", "day", "n_email_events", "email_volume_mb", "email_external_count")


@query()
def sequences(x):
    return sessions.token_sequences(x.activity, x.cfg)


@query()
def hour_histogram(x):
    return sessions.hour_histogram(x.activity)


@query()
def after_hours(x):
    return sessions.hour_histogram(x.activity).select(
        "user_id", "day", sessions.after_hours(x.cfg).alias("after_hours_ratio"))


@query()
def user_day(x):
    table = sessions.user_day_table(logs.unify_logs(source.logs(x.events)), x.directory, x.answers)
    return table.drop(*sessions.HOURS, "removable_mb")


@query()
def labels(x):
    days = sessions.user_day_spine(x.activity)
    return sessions.attach_labels(days, x.answers)


# ---- features ------------------------------------------------------------------------------
@query()
def volumes(x):
    return features.volumes(x.user_days).select("user_id", "day", "data_volume_mb", "export_volume_mb")


@query()
def entropy(x):
    hours = x.activity.select("user_id", "day", hour_of_day("ts").alias("hour"))
    return features.entropy_of(hours, ["user_id", "day"], "hour")


@query()
def hour_entropy_7d(x):
    return features.rolling_entropies(x.user_days, x.cfg).select("user_id", "day", "hour_entropy_7d")


@query()
def dow_entropy_30d(x):
    return features.rolling_entropies(x.user_days, x.cfg).select("user_id", "day", "dow_entropy_30d")


@query()
def new_flags(x):
    cells = sessions.activity_cells(x.activity)
    return features.new_item_days(cells, sessions.user_day_spine(x.activity), x.cfg)


@query()
def bigrams(x):
    counts = features.bigram_counts(features.session_bigrams(x.activity, x.cfg), x.cfg)
    return counts.withColumnRenamed("count", "n")


def _rarity(x, kind):
    pairs = features.session_bigrams(x.activity, x.cfg)
    rarity = features.bigram_rarity(pairs, features.bigram_counts(pairs, x.cfg))
    name = f"{kind}_bigram_rarity"
    days = sessions.user_day_spine(x.activity).join(rarity, ["user_id", "day"], "left")
    return days.select("user_id", "day", F.coalesce(name, F.lit(0.0)).alias(name))


@query()
def url_rarity(x):
    return _rarity(x, "url")


@query()
def file_rarity(x):
    return _rarity(x, "file")


@query()
def feature_matrix(x):
    return x.features


# ---- statistics and models -----------------------------------------------------------------
@query()
def robust_baseline(x):
    train = x.peaks.where("split = 'train'")
    return stats.robust_baseline(train, F.col("max_value"), ["role"])


@query(4)
def excess_by_role(x):
    fit = stats.robust_baseline(x.peaks.where("split = 'train'"), F.col("max_value"), ["role"])
    rows = attach(x.peaks, fit.select("role", "baseline", "scale"), ["role"])
    return rows.select("user_id", "day", "role", excess_score(
        F.col("max_value"), F.col("baseline"), F.col("scale"), x.cfg.peer_k).alias("score"))


@query(4)
def scaler(x):
    feats, names = x.kept_features, list(x.cfg.features)
    params = stats.scaler_fit(feats.where("split = 'train'"), names).first()
    return feats.select("user_id", "day", *stats.standardised(names, params))


@query(4)
def role_stats(x):
    feats, names = x.kept_features, list(x.cfg.features)
    train = feats.where("split = 'train'")
    roles = stats.group_moments(train, names, ["role"])
    label = F.array(*[F.lit(n) for n in names])
    return (roles.select("role", "n", F.posexplode("mean").alias("i", "mean"), "std")
            .select("role", "n", F.get(label, F.col("i")).alias("feature"), "mean",
                    F.get("std", F.col("i")).alias("std")))


@query(4)
def role_cov(x):
    names = list(x.cfg.features)
    d = len(names)
    roles = stats.group_moments(x.kept_features.where("split = 'train'"), names, ["role"])
    label = F.array(*[F.lit(n) for n in names])
    cells = roles.select("role", F.posexplode("cov").alias("at", "cov"))
    row, column = F.floor(F.col("at") / d).cast("int"), (F.col("at") % d).cast("int")
    return (cells.where(row <= column)
            .select("role", F.get(label, row).alias("feature_a"), F.get(label, column).alias("feature_b"), "cov"))


@query(4)
def mahalanobis_2d(x):
    feats = x.kept_features
    roles = peers.role_moments(feats.where("split = 'train'"), TWO_FEATURES, x.cfg)
    return peers.with_distance(feats, TWO_FEATURES, roles).select("user_id", "day", "peer_distance")


@query(4)
def peer_score(x):
    feats, names = x.kept_features, list(x.cfg.features)
    model = materialize(peers.fit_peers(feats.where("split = 'train'"), names, x.cfg, keep=materialize), "peers")
    return peers.peer_score(feats, names, model, x.cfg).select("user_id", "day", "peer_distance", "peer_group_score")


@query(4)
def forest_score(x):
    feats, names = x.kept_features, list(x.cfg.features)
    train = feats.where("split = 'train'")
    params = stats.scaler_fit(train, names).first()
    scaled = train.select("user_id", "day", *stats.standardised(names, params))
    nodes = forest.fit_forest(scaled, names, ["user_id", "day"], params["n"], x.cfg).toPandas()
    raw = forest.forest_score(nodes, stats.standardised(names, params), min(x.cfg.tree_rows, params["n"]), x.spark)
    rows = materialize(feats.select("user_id", "day", "split", raw.alias("raw")), "raw")
    fit = stats.robust_baseline(rows.where("split = 'train'"), F.col("raw")).first()
    score = excess_score(F.col("raw"), F.lit(fit["baseline"]), F.lit(fit["scale"]), x.cfg.forest_k)
    return rows.select("user_id", "day", "raw", score.alias("isolation_forest_score"))


@query(4)
def ensemble(x):
    by_role = excess_by_role(x).select("user_id", "day", F.col("score").alias("peer"))
    both = x.scored.select("user_id", "day", F.col("risk_score").alias("forest")).join(by_role, ["user_id", "day"])
    return both.select("user_id", "day", blend(F.col("forest"), F.col("peer"), x.cfg).alias("risk_score"))


@query()
def tiers(x):
    return x.scored.select("user_id", "day", "risk_score", "risk_tier")


@query(4)
def compressed_z(x):
    fit = x.peaks.where("split = 'train'").groupBy("role").agg(
        F.avg("max_value").alias("m"), F.stddev_pop("max_value").alias("s"))
    z = (F.col("max_value") - F.col("m")) / F.col("s")
    return attach(x.peaks, fit, ["role"]).select("user_id", "day", compress_z(z, 1.5).alias("z"))


@query()
def contributions(x):
    feats, names = x.kept_features, list(x.cfg.features)
    roles = peers.role_moments(feats.where("split = 'train'"), names, x.cfg)
    full = explain.explain(feats, names, roles, x.cfg, count=len(names))
    return unpacked(full, ["user_id", "day"], F.col("top_features"), "place")


def _detect(x):
    return risk_model.run_detection(x.activity, x.directory, x.answers, x.cfg)["scored"]


@query(4)
def scored(x):
    return _detect(x).withColumn("top_features", F.to_json("top_features"))


@query(4)
def detection_report(x):
    return risk_model.evaluate(materialize(_detect(x), "scored"))


# ---- evaluation ----------------------------------------------------------------------------
@query()
def role_counts(x):
    return stats.count_by(x.directory, "role")


@query()
def split_counts(x):
    return stats.count_by(x.peaks, "split", "is_malicious")


@query()
def tier_counts(x):
    return stats.tier_counts(x.scored, x.cfg)


@query()
def action_counts(x):
    return stats.count_by(x.decisions, "action")


@query()
def fpr(x):
    return stats.false_positive_rates(x.scored)


@query()
def score_curve(x):
    return stats.score_curve(x.volume_held_out)


@query()
def roc_auc(x):
    return stats.curve_metrics(stats.score_curve(x.volume_held_out)).select("roc_auc")


@query()
def avg_precision(x):
    return stats.curve_metrics(stats.score_curve(x.volume_held_out)).select("pr_auc")


@query()
def topk_recall(x):
    return stats.topk_report(x.volume_held_out)


@query()
def eval_report(x):
    return stats.evaluation_report(x.volume_held_out)


# ---- feeds ---------------------------------------------------------------------------------
SCORED = ["user_id", "day", "role", "split", "risk_score", "risk_tier", "is_malicious"]


@query()
def feed(x):
    return feeds.session_feed(x.decisions.where("split = 'test'"))


@query()
def high_risk(x):
    return feeds.high_risk(x.scored).select(*SCORED)


@query()
def held_out(x):
    return feeds.held_out(x.scored).select(*SCORED)


@query()
def top_sessions(x):
    return feeds.top_sessions(x.scored.where("split = 'test'")).select(*SCORED)


@query()
def labelled_sessions(x):
    return feeds.labelled_sessions(x.scored).select(*SCORED, "scenario_id")


@query()
def drilldown(x):
    feats, names = x.kept_features, list(x.cfg.features)
    roles = peers.role_moments(feats.where("split = 'train'"), names, x.cfg)
    explained = explain.explain(feats, names, roles, x.cfg).select("user_id", "day", "top_features")
    chosen = x.scored.where("split = 'test'").where(F.col("risk_tier").isin(*feeds.FEED_TIERS))
    return feeds.drilldown(chosen.join(explained, ["user_id", "day"]))


# ---- decisions and ledgers -----------------------------------------------------------------
@query()
def stepup(x):
    days = sessions.user_day_spine(x.activity)
    return days.withColumn("passed", stepup_passed(F.col("user_id"), F.col("day"), x.cfg))


@query()
def decision_table(x):
    return x.decisions.select("user_id", "role", "day", "risk_tier", "risk_score", "action", "stepup_required",
                              "stepup_passed", "quarantined", "notes")


@query()
def decision_events(x):
    return x.decision_events


@query()
def lease_grants(x):
    return decisions.lease_grants(x.decisions, x.entitlements, x.cfg)


@query()
def lease_outcomes(x):
    return ledgers.redeem_outcomes(x.attempts, x.states).withColumnRenamed("at", "at_us")


@query()
def single_revokes(x):
    return ledgers.revoke_outcomes(x.revokes, x.states).withColumnRenamed("at", "at_us")


@query()
def bulk_revoke(x):
    return ledgers.bulk_revoked_leases(x.states)


@query()
def live_leases(x):
    return ledgers.live_leases(x.states, F.lit(SNAPSHOT).cast("timestamp_ntz"))


@query()
def resume_requests(x):
    return x.resumes.withColumnRenamed("at", "at_us")


@query()
def resume_events(x):
    return ledgers.resume_events(x.resumes, x.directory, x.entitlements, x.cfg)


@query()
def quarantine_ledger(x):
    return x.quarantines


@query()
def active_quarantines(x):
    return ledgers.active_quarantines(x.quarantines)


@query()
def first_quarantines(x):
    return decisions.first_quarantines(x.decisions.where("split = 'test'"))


@query()
def quarantine_precision(x):
    held = x.decisions.where("split = 'test'")
    return decisions.quarantine_precision(held, held)


@query()
def policy_run(x):
    held = materialize(_detect(x).where("split = 'test'"), "held-out")
    return policy.run_policy(held, x.entitlements, x.cfg, source.resume_requests(x.events))["events"]


def _policy(x):
    return policy.run_policy(x.scored, x.entitlements, x.cfg, source.resume_requests(x.events))


@query()
def policy_quarantines(x):
    return _policy(x)["intervals"]


@query()
def policy_locks(x):
    return _policy(x)["decisions"].select("user_id", "day", "action", "locked", "locked_since")


def _ledger_events(x):
    return ledgers.ledger_events(source.lease_grants(x.events), x.attempts, x.revokes, source.bulk_revokes(x.events), x.states,
                                 x.directory, x.entitlements)


@query()
def ledger_events(x):
    return _ledger_events(x).withColumnRenamed("at", "at_us")


@query()
def ledger_chain(x):
    return audit.build_chains(audit.with_chain(_ledger_events(x), x.cfg), ["at", "ord"])


# ---- audit ---------------------------------------------------------------------------------
@query()
def canonical_rows(x):
    text = canonical_json(user=F.col("user_id").cast("string"), role=F.col("role"), date=midnight_text(F.col("day")),
                          risk_score=canonical_number(F.col("risk_score")), scenario_id=F.col("scenario_id"))
    return x.scored.select("user_id", "day", text.alias("payload"))


@query()
def audit_seq(x):
    return audit.number_entries(x.decision_events, x.cfg).select("chain_id", "seq", "user_id", "day", "step_no", "event_type")


@query()
def hash_chain(x):
    return x.chained


@query()
def chain_heads(x):
    return audit.chain_the_heads(audit.chain_heads(x.kept_chain))


@query()
def verify(x):
    return audit.verify(x.chained)


@query()
def verify_summary(x):
    return audit.verify_summary(audit.verify(x.chained))


def _drill(x, kind):
    return audit.verify(audit.tamper(x.kept_chain, kind), "pos").where("NOT ok").select("chain_id", "seq", "error")


@query()
def tamper_edit(x):
    return _drill(x, "edit")


@query()
def tamper_delete(x):
    return _drill(x, "delete")


@query()
def tamper_reorder(x):
    return _drill(x, "reorder")


@query()
def tamper_insert(x):
    return _drill(x, "insert")


@query()
def tail_cut(x):
    kept = x.kept_chain
    last = kept.groupBy("chain_id").agg(F.max("seq").alias("last"))
    cut = kept.join(last, "chain_id").where("seq < last").drop("last")
    return audit.verify_heads(cut, audit.chain_heads(kept))


@query()
def audit_search(x):
    return audit.search(x.chained, SEARCH_TERM)


@query()
def audit_latest(x):
    return audit.search(x.chained)


@query()
def audit_pick(x):
    return audit.pick_entry(x.chained)
