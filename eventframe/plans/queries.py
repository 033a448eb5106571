"""

Every query takes ``(spark, sf_dir)``, reads the driver tables through the fixture event view (or
``events`` / ``embeddings`` directly) and returns a DataFrame whose column names match the oracle SQL
in :mod:`eventframe.plans.oracle_sql`.
"""

from __future__ import annotations

from functools import reduce
from typing import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventframe.constants import CANDIDATE_K, EVENT_COLUMNS, LABEL_NAMES, MAX_JETS, MIN_BIN_COUNT, X_DIM
from eventframe.functions.scalar import hash_int, is_finite
from eventframe.operators.binning import assign_mass_bins, collect_edges, fit_mass_bins
from eventframe.operators.binning import edge_histogram as edge_histogram_op
from eventframe.operators.binning import equal_freq_edges as equal_freq_edges_op
from eventframe.operators.filters import gather, window_closed_f32, window_half_open
from eventframe.operators.pairs import PAIR_FEATURES, pairs_long, with_event_cartesian
from eventframe.operators.sampling import balanced_sample as balanced_sample_op
from eventframe.operators.sampling import balanced_steps as balanced_steps_op
from eventframe.operators.sampling import class_pool_sizes, independent_batches
from eventframe.operators.sampling import sample_exact_n as sample_exact_n_op
from eventframe.operators.sampling import write_batches
from eventframe.operators.scaling import apply_scaler, fit_masked_scaler, scaled_array, scaler_params
from eventframe.operators.splits import assign_folds, class_counts, file_row_index, global_ids, row_index
from eventframe.operators.tokens import build_tokens, ensure_event_columns, normalise_events
from eventframe.operators.losses import batch_mean, cross_entropy
from eventframe.operators.metrics import (
    accuracy,
    auc_ovr,
    confusion_matrix,
    pearson_guarded,
    roc_points,
    roc_trapezoid,
    score_bin_edges,
    score_bin_mass_hist,
    score_bins,
    top_quantile_purity,
    with_prediction,
)
from eventframe.plans.evaluate import (
    epoch_evaluation,
    evaluation_report,
    fixture_logits,
    score_from_logits,
    with_split_gid,
)
from eventframe.operators.history import (
    best_epoch,
    drop_heavy,
    early_stopping,
    epoch_means,
    history_from_events,
    lambda_schedule,
    truncate_at_stop,
)
from eventframe.plans.curation import curate, write_curated
from eventframe.plans.finalize import rounded
from eventframe.plans.scoring import event_tensors, masked_sum_predict_fn, score_events, score_table, softmax_head_predict_fn
from eventframe.plans.training import (
    balanced_weights,
    fit_classifier,
    fit_mass_probe,
    predict_proba,
    score_equations,
    token_features,
)
from eventframe.session import scratch_dir, written
from eventframe.sources.artifacts import (
    HISTORY_SCHEMA,
    commit_history,
    read_bins,
    read_committed_history,
    read_history,
    read_metrics,
    read_scaler,
    write_bins,
    write_history,
    write_metrics,
    write_parquet,
    write_scaler,
)
from eventframe.plans.prepare import events_from_tables, split_events, split_tokens
from eventframe.sources.event_view import event_view
from eventframe.sources.parquet import label_and_union, missing_paths, read_labelled_sources

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _split(spark, sf_dir) -> DataFrame:
    """Prepared events."""
    return split_events(events_from_tables(spark, sf_dir))


def _tokens(spark, sf_dir) -> DataFrame:
    return split_tokens(_split(spark, sf_dir))


# ---------------------------------------------------------------- filters, sources
@query
def mass_window_half_open(spark, sf_dir):
    ev = window_half_open(event_view(spark, sf_dir))
    return rounded(ev.select("event_id", "y", "dimuon_mass"))


@query
def mass_window_closed_f32(spark, sf_dir):
    ev = window_closed_f32(event_view(spark, sf_dir))
    return rounded(ev.select("event_id", "y", "dimuon_mass"))


@query
def labelled_union(spark, sf_dir):
    # one pass builds the events for all classes: three views in one union share the cores, so each task holds a multiple
    ev = written(event_view(spark, sf_dir).select("event_id", "y", "dimuon_mass"), "events")
    frames = {name: ev.where(F.col("y") == i).drop("y") for i, name in enumerate(LABEL_NAMES)}
    out = label_and_union(frames)
    return rounded(out.select("event_id", "y", "source", "dimuon_mass"))


@query
def null_nan_normalise(spark, sf_dir):
    ev = normalise_events(event_view(spark, sf_dir))
    row = ev.agg(*[F.sum(F.isnan(c).cast("long")).alias(c) for c in EVENT_COLUMNS])
    arr = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_missing")) for c in EVENT_COLUMNS])
    return row.select(F.inline(arr))


# ---------------------------------------------------------------- index, folds, splits
@query
def fold_split_counts(spark, sf_dir):
    return _split(spark, sf_dir).groupBy("y", "split").agg(F.count(F.lit(1)).alias("n"))


@query
def fold_rows(spark, sf_dir):
    w = window_closed_f32(events_from_tables(spark, sf_dir))
    return assign_folds(row_index(w, "_ord", ("y",))).select("event_id", "y", "idx", "fold")


@query
def class_counts_q(spark, sf_dir):
    return class_counts(window_closed_f32(event_view(spark, sf_dir)))


@query
def global_ids_q(spark, sf_dir):
    w = row_index(window_closed_f32(events_from_tables(spark, sf_dir)), "_ord", ("y",))
    return global_ids(w).select("event_id", "y", "gid")


# ---------------------------------------------------------------- tokens
@query
def tokens_long(spark, sf_dir):
    t = _tokens(spark, sf_dir)
    return rounded(
        t.select("event_id", "tok", "type", "valid", "pt", "eta", "phi", "mass",
                 *[F.col("x")[i].alias(f"x{i}") for i in range(X_DIM)])
    )


@query
def token_mask_counts(spark, sf_dir):
    t = _tokens(spark, sf_dir)
    return t.groupBy("tok", "type").agg(
        F.count(F.when(F.col("valid") == 1, 1)).alias("n_valid"),
        F.count(F.when(F.col("valid") == 0, 1)).alias("n_pad"),
    )


@query
def jet_validity(spark, sf_dir):
    ev = build_tokens(window_closed_f32(events_from_tables(spark, sf_dir)))
    nj = F.col("njets_nominal").cast("int")
    aggs = []
    for j in range(1, MAX_JETS + 1):
        p = [F.col(f"jet{j}_{f}_nominal") for f in ("pt", "eta", "phi", "mass", "qgl")]
        gate, fin = nj >= j, is_finite(*p[:4])
        aggs += [
            F.count(F.when(gate, 1)).alias(f"g{j}"),
            F.count(F.when(fin, 1)).alias(f"f{j}"),
            F.count(F.when(F.col("tokens")[2 + j]["valid"] == 1, 1)).alias(f"v{j}"),
            F.count(F.when((F.col("tokens")[2 + j]["valid"] == 1) & is_finite(p[4]), 1)).alias(f"q{j}"),
        ]
    row = ev.agg(*aggs)
    arr = F.array(*[
        F.struct(F.lit(j).alias("jet"), F.col(f"g{j}").alias("n_gate"), F.col(f"f{j}").alias("n_finite"),
                 F.col(f"v{j}").alias("n_valid"), F.col(f"q{j}").alias("n_qgl"))
        for j in range(1, MAX_JETS + 1)
    ])
    return row.select(F.inline(arr))


@query
def absent_jets(spark, sf_dir):
    """Events without the columns of jets 3 and 4; those are padding then."""
    ev = window_closed_f32(events_from_tables(spark, sf_dir))
    ev = build_tokens(ensure_event_columns(ev.drop(*[c for c in ev.columns if c.startswith(("jet3_", "jet4_"))])))
    t = ev.select(F.posexplode("tokens").alias("tok", "t")).where("tok >= 3")
    return t.groupBy((F.col("tok") - 2).alias("jet")).agg(F.sum(F.col("t.valid").cast("long")).alias("n_valid"), F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- scaling (A1-A3)
def train_scaler(spark, sf_dir) -> DataFrame:
    return scaler_of(_split(spark, sf_dir))


def scaler_of(split: DataFrame) -> DataFrame:
    """The scaler fitted to the training rows of prepared events."""
    return fit_masked_scaler(split_tokens(split.where(F.col("split") == "train")))


@query
def masked_scaler(spark, sf_dir):
    return rounded(train_scaler(spark, sf_dir))


@query
def scaled_features(spark, sf_dir):
    sp = written(_split(spark, sf_dir), "split")  # read twice: fit, then apply
    mean, std = scaler_params(scaler_of(sp))
    t = apply_scaler(split_tokens(sp), mean, std, out="xs")
    return rounded(t.select("event_id", "tok", "valid", *[F.col("xs")[i].alias(f"xs{i}") for i in range(X_DIM)]))


# registry names that differ from the Python function names
QUERIES["class_counts"] = QUERIES.pop("class_counts_q")
QUERIES["global_ids"] = QUERIES.pop("global_ids_q")


# ---------------------------------------------------------------- sampling
SEED = 42


def _train_pool(spark, sf_dir) -> DataFrame:
    # read by several actions (pool sizes, then draws): write only the columns the callers use
    sp = _split(spark, sf_dir).where(F.col("split") == "train")
    return written(sp.select("event_id", "y", "idx", "dimuon_mass"), "pool")


@query
def sample_exact_n(spark, sf_dir):
    ev = window_half_open(event_view(spark, sf_dir))
    return sample_exact_n_op(ev, 1000, SEED, ("y",)).select("event_id", "y")


@query
def sample_short_source(spark, sf_dir):
    ev = window_half_open(event_view(spark, sf_dir))
    return sample_exact_n_op(ev, 2250, SEED, ("y",)).select("event_id", "y")


@query
def pool_sizes(spark, sf_dir):
    """Rows to draw from by class; a class without any is an error."""
    return class_pool_sizes(_train_pool(spark, sf_dir))


def _batch_cols(df):
    return df.select("step", "y", "draw", "event_id", "shuffle_key")


@query
def balanced_sample(spark, sf_dir):
    return _batch_cols(balanced_sample_op(_train_pool(spark, sf_dir), SEED))


@query
def balanced_with_replacement(spark, sf_dir):
    pool = _train_pool(spark, sf_dir)
    k = int(class_pool_sizes(pool).agg(F.max("n")).first()[0])
    return _batch_cols(balanced_sample_op(pool, SEED, k=k))


@query
def balanced_steps(spark, sf_dir):
    return _batch_cols(balanced_steps_op(_train_pool(spark, sf_dir), 768, SEED))


@query
def independent_steps(spark, sf_dir):
    """Independent draws for each step, written as files in batch order and read back in file order."""
    path = scratch_dir(spark, "batches")
    write_batches(independent_batches(_train_pool(spark, sf_dir), 768, SEED).select("step", "pos", "y", "draw", "event_id"), path)
    back = spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("r"))
    place = F.row_number().over(Window.partitionBy("step").orderBy("f", "r")) - 1  # 768 rows a step
    return back.select("step", place.cast("long").alias("pos"), "y", "draw", "event_id")


@query
def gather_rows(spark, sf_dir):
    ev = row_index(window_closed_f32(events_from_tables(spark, sf_dir)), "_ord", ("y",))
    # n_y positions per class drawn with replacement (a bootstrap resample); draw ids come from one
    # spark.range over all classes, split by the (3-row) class offsets, so no join builds them
    sizes = sorted((r["y"], r["n"]) for r in class_pool_sizes(ev).collect())
    offs, acc = [], 0
    for y, n in sizes:
        offs.append((y, acc, n))
        acc += n
    ids = spark.range(acc)
    yexpr = F.lit(offs[0][0])
    oexpr = F.lit(0).cast("long")
    nexpr = F.lit(offs[0][2]).cast("long")
    for y, o, n in offs[1:]:
        yexpr = F.when(F.col("id") >= o, F.lit(y)).otherwise(yexpr)
        oexpr = F.when(F.col("id") >= o, F.lit(o).cast("long")).otherwise(oexpr)
        nexpr = F.when(F.col("id") >= o, F.lit(n).cast("long")).otherwise(nexpr)
    d = ids.select(yexpr.alias("y"), (F.col("id") - oexpr).alias("d"), nexpr.alias("n"))
    draws = d.select("y", "d", F.pmod(hash_int(F.lit(7), F.col("y"), F.col("d")), F.col("n")).alias("idx"))
    return gather(ev.select("y", "idx", "event_id"), draws).select("y", "d", "idx", "event_id")


# ---------------------------------------------------------------- binning
def _train_masses(spark, sf_dir) -> DataFrame:
    return _masses(_train_pool(spark, sf_dir))


def _masses(pool: DataFrame) -> DataFrame:
    # the original keeps training masses as float32 and widens them to float64 for binning
    return pool.select(
        "event_id", "y", F.col("dimuon_mass").cast("float").cast("double").alias("mass"), "dimuon_mass"
    )


@query
def equal_freq_edges(spark, sf_dir):
    return rounded(equal_freq_edges_op(_train_masses(spark, sf_dir)))


@query
def edge_histogram(spark, sf_dir):
    m = _train_masses(spark, sf_dir)
    return edge_histogram_op(m, collect_edges(equal_freq_edges_op(m)))


def _chosen(spark, sf_dir, candidates, min_count=None):
    m = _train_masses(spark, sf_dir)
    k, edges = fit_mass_bins(m, candidate_k=candidates, min_bin_count=MIN_BIN_COUNT if min_count is None else min_count)
    return m, k, edges


def _edges_df(spark, k, edges):
    arr = F.array(*[F.struct(F.lit(k).alias("K"), F.lit(b).alias("b"), F.lit(e).alias("edge"))
                    for b, e in enumerate(edges)])
    return spark.range(1).select(F.inline(arr))


@query
def choose_k(spark, sf_dir):
    _, k, edges = _chosen(spark, sf_dir, CANDIDATE_K)
    return rounded(_edges_df(spark, k, edges))


@query
def choose_k_fallback(spark, sf_dir):
    n_train = _train_masses(spark, sf_dir).count()
    _, k, edges = _chosen(spark, sf_dir, [1] + list(CANDIDATE_K), min_count=n_train)
    return rounded(_edges_df(spark, k, edges))


@query
def mass_bin_assign(spark, sf_dir):
    m, k, edges = _chosen(spark, sf_dir, CANDIDATE_K)
    return assign_mass_bins(m, edges, col="dimuon_mass").select("event_id", "y", "mass_bin")


# ---------------------------------------------------------------- pair features
def _pairs(spark, sf_dir, valid_keys_only=False) -> DataFrame:
    ev = with_event_cartesian(_split(spark, sf_dir))
    return pairs_long(ev, keep=("event_id",), valid_keys_only=valid_keys_only)


@query
def pair_features(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    return rounded(p.select("event_id", "i", "j", "valid_i", "valid_j", *PAIR_FEATURES))


@query
def pair_mass_jets(spark, sf_dir):
    p = _pairs(spark, sf_dir).where((F.col("i") >= 3) & (F.col("j") >= 3))
    p = p.where((F.col("valid_i") == 1) & (F.col("valid_j") == 1))
    return rounded(p.select("event_id", "i", "j", "mij"))


@query
def pair_valid_keys(spark, sf_dir):
    p = _pairs(spark, sf_dir, valid_keys_only=True)
    return p.groupBy("i", "j").agg(
        F.count(F.lit(1)).alias("n_valid_key"),
        F.count(F.when(F.col("valid_i") == 1, 1)).alias("n_both"),
    )


# ---------------------------------------------------------------- scores, losses, metrics
def _scored(spark, sf_dir, split: str = "test") -> DataFrame:
    sp = _split(spark, sf_dir).where(F.col("split") == split)
    sp = sp.select("event_id", "y", "idx", F.col("dimuon_mass").alias("mass"), "MET_phi",
                   fixture_logits().alias("z"))
    # the scored table is read by several metrics/actions: keep this narrow table, not the events
    return written(score_from_logits(sp), "scored")


@query
def softmax_argmax(spark, sf_dir):
    s = with_prediction(_scored(spark, sf_dir))
    return rounded(s.select("event_id", *[F.col("p")[c].alias(f"p{c}") for c in range(3)], "pred"))


@query
def cross_entropy_q(spark, sf_dir):
    s = _scored(spark, sf_dir)
    return rounded(s.select("event_id", "y", cross_entropy("z", "y", 3).alias("ce")))


@query
def batch_mean_loss(spark, sf_dir):
    s = with_split_gid(_scored(spark, sf_dir, "val"), "val").withColumn("ce", cross_entropy("z", "y", 3))
    return rounded(batch_mean(s, "ce", "gid"))


@query
def batch_mean_small(spark, sf_dir):
    """Many batches, the last one short."""
    s = with_split_gid(_scored(spark, sf_dir, "val"), "val").withColumn("ce", cross_entropy("z", "y", 3))
    return rounded(batch_mean(s, "ce", "gid", batch=100))


@query
def mass_bin_cross_entropy(spark, sf_dir):
    _, k, edges = _chosen(spark, sf_dir, CANDIDATE_K)
    tr = _scored(spark, sf_dir, "train")  # every train row is in the mass window already
    tr = assign_mass_bins(tr.withColumn("dimuon_mass", F.col("mass")), edges)
    adv = F.array(*[F.sin(F.lit(float(i + 1)) * F.col("MET_phi")) for i in range(k)])
    tr = tr.select(cross_entropy("z", "y", 3).alias("ce_cls"), cross_entropy(adv, "mass_bin", k).alias("ce_adv"))
    out = tr.agg(F.count(F.lit(1)).alias("n"), F.avg("ce_cls").alias("loss_cls"), F.avg("ce_adv").alias("loss_adv"))
    return rounded(out.select(
        F.lit(k).alias("K"), "n", "loss_cls", "loss_adv", (F.col("loss_cls") + F.col("loss_adv")).alias("loss"),
        F.ln(F.lit(float(k))).alias("chance")))


@query
def accuracy_q(spark, sf_dir):
    return rounded(accuracy(with_prediction(_scored(spark, sf_dir))))


@query
def confusion_matrix_q(spark, sf_dir):
    return confusion_matrix(with_prediction(_scored(spark, sf_dir)))


@query
def auc_ovr_q(spark, sf_dir):
    return rounded(auc_ovr(_scored(spark, sf_dir)))


@query
def auc_degenerate(spark, sf_dir):
    return rounded(auc_ovr(_scored(spark, sf_dir).where(F.col("y") != 1)))


@query
def auc_ties(spark, sf_dir):
    """Scores of two digits, hence many ties."""
    s = _scored(spark, sf_dir)
    return rounded(auc_ovr(s.withColumn("p", F.transform("p", lambda x: F.round(x, 2)))))


@query
def roc_points_q(spark, sf_dir):
    return rounded(roc_points(_scored(spark, sf_dir)))


@query
def roc_trapezoid_q(spark, sf_dir):
    return rounded(roc_trapezoid(_scored(spark, sf_dir)))


@query
def top_decile_purity(spark, sf_dir):
    return rounded(top_quantile_purity(_scored(spark, sf_dir), cls=1))


def _dy(spark, sf_dir) -> DataFrame:
    s = _scored(spark, sf_dir).where(F.col("y") == 2)
    return s.select((F.lit(1.0) - F.col("p")[2]).alias("s"), "mass")


@query
def pearson_guarded_q(spark, sf_dir):
    return rounded(pearson_guarded(_dy(spark, sf_dir)))


@query
def score_bins_q(spark, sf_dir):
    dy = _dy(spark, sf_dir)
    return rounded(score_bins(dy, score_bin_edges(dy)))


@query
def score_bin_mass_hist_q(spark, sf_dir):
    dy = _dy(spark, sf_dir)
    return score_bin_mass_hist(dy, score_bin_edges(dy))


@query
def eval_report(spark, sf_dir):
    return rounded(evaluation_report(spark, _scored(spark, sf_dir)))


EPOCHS = [0, 1, 2, 3, 4]


@query
def epoch_eval(spark, sf_dir):
    s = with_split_gid(_scored(spark, sf_dir, "val"), "val")
    ep = F.explode(F.array(*[F.lit(e) for e in EPOCHS])).alias("epoch")
    s = s.select("*", ep)
    z = F.array(F.col("z")[0], F.col("z")[1] * (F.lit(1.0) + F.lit(0.2) * F.col("epoch")), F.col("z")[2])
    s = score_from_logits(s.withColumn("z", z))
    return rounded(epoch_evaluation(s))


for _n in ["cross_entropy", "accuracy", "confusion_matrix", "auc_ovr", "roc_points", "roc_trapezoid",
           "pearson_guarded", "score_bins", "score_bin_mass_hist"]:
    QUERIES[_n] = QUERIES.pop(_n + "_q")


# ---------------------------------------------------------------- run history
def _history(spark, sf_dir) -> DataFrame:
    return history_from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


@query
def early_stopping_q(spark, sf_dir):
    return rounded(early_stopping(_history(spark, sf_dir)))


@query
def early_stopping_nan(spark, sf_dir):
    """Error events stand for steps whose loss is NaN."""
    h = _history(spark, sf_dir)
    loss = F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("loss"))
    out = early_stopping(h.withColumn("loss", loss))
    return rounded(out.withColumn("best_loss", F.nanvl("best_loss", F.lit(None).cast("double"))))


@query
def best_epoch_q(spark, sf_dir):
    return rounded(best_epoch(_history(spark, sf_dir)))


@query
def lambda_schedule_q(spark, sf_dir):
    e = _history(spark, sf_dir).select("epoch").distinct()
    return rounded(e.select("epoch", lambda_schedule("epoch").alias("lambda_grl")))


def _step_epochs(spark, sf_dir) -> DataFrame:
    h = _history(spark, sf_dir)
    h = h.withColumn("epoch", F.floor(F.col("epoch") / 4).cast("long"))
    # the fixture has one number per step; the adversary's loss stands for a quarter of it
    return h.withColumns({"loss_cls": F.col("loss") * 0.75, "loss_adv": F.col("loss") * 0.25})


LOSSES = ("loss", "loss_cls", "loss_adv")


@query
def epoch_means_q(spark, sf_dir):
    m = epoch_means(_step_epochs(spark, sf_dir), ["run", "epoch"], LOSSES, ok=F.col("event_type") != "error")
    return rounded(m)


@query
def stop_truncation(spark, sf_dir):
    h = _history(spark, sf_dir)
    kept = truncate_at_stop(h, early_stopping(h))
    return kept.groupBy("run").agg(F.count(F.lit(1)).alias("n_kept"), F.max("epoch").alias("last_epoch"))


def _history_records(spark, sf_dir) -> DataFrame:
    st = _step_epochs(spark, sf_dir)
    tr = epoch_means(st, ["run", "epoch"], LOSSES, ok=F.col("event_type") != "error").select(
        F.col("run").cast("string").alias("run_id"), F.lit("train").alias("part"), "epoch", *LOSSES, "steps",
        lambda_schedule("epoch").alias("lambda_grl"))
    # a validation summary carries raw labels, which the history leaves out
    va = st.groupBy("run", "epoch").agg(F.max("loss").alias("loss"), F.collect_set("event_type").alias("y_true"))
    va = drop_heavy(va).select(F.col("run").cast("string").alias("run_id"), F.lit("val").alias("part"), "epoch", "loss")
    return tr.unionByName(va, allowMissingColumns=True)


@query
def history_table(spark, sf_dir):
    path = scratch_dir(spark, "history")
    write_history(_history_records(spark, sf_dir), path, mode="overwrite")
    back = read_history(spark, path)
    return rounded(back.select("run_id", "part", "epoch", *LOSSES, "steps", "lambda_grl"))


@query
def history_replayed(spark, sf_dir):
    """A stream of history records that delivers every other epoch twice, first with other losses."""
    rec, path, inbox = _history_records(spark, sf_dir), scratch_dir(spark, "history"), scratch_dir(spark, "history-in")
    early = rec.where("epoch % 2 = 0").withColumn("loss", F.col("loss") + 1)
    for records in (early, rec):
        write_history(records, inbox)
        commit_history(spark.readStream.schema(HISTORY_SCHEMA).json(inbox), path)
    return rounded(read_committed_history(spark, path).select("run_id", "part", "epoch", *LOSSES, "steps", "lambda_grl"))


# ---------------------------------------------------------------- artefact round trips
@query
def scaler_roundtrip(spark, sf_dir):
    path = scratch_dir(spark, "x_scaler")
    write_scaler(train_scaler(spark, sf_dir), path)
    return rounded(read_scaler(spark, path))


@query
def bins_roundtrip(spark, sf_dir):
    _, k, edges = _chosen(spark, sf_dir, CANDIDATE_K)
    path = scratch_dir(spark, "mass_bins")
    write_bins(k, edges, spark, path)
    return rounded(read_bins(spark, path).select(F.col("K").cast("int").alias("K"), F.col("b").cast("int").alias("b"),
                                                 "edge"))


@query
def empty_sink(spark, sf_dir):
    ev = window_half_open(event_view(spark, sf_dir), window=(1000.0, 1010.0))
    path = scratch_dir(spark, "empty")
    write_parquet(ev.select("event_id", "y", "dimuon_mass"), path)
    return rounded(spark.read.parquet(path))


@query
def metrics_sink(spark, sf_dir):
    rep = evaluation_report(spark, _scored(spark, sf_dir))
    path = scratch_dir(spark, "test_metrics")
    write_metrics(rep, path)
    return rounded(read_metrics(spark, path).select(*rep.columns))


# ---------------------------------------------------------------- scoring and training (M1, M4, M5)
@query
def batch_score(spark, sf_dir):
    emb = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    s = score_table(emb, "embedding", softmax_head_predict_fn(3), input_dim=64)
    return rounded(s.select("vec_id", *[F.col("p")[c].alias(f"p{c}") for c in range(3)]))


@query
def event_score(spark, sf_dir):
    """The test split on features, kinematics and mask, scaled by the scaler that training wrote."""
    path = scratch_dir(spark, "x_scaler")
    sp = written(_split(spark, sf_dir), "split")
    write_scaler(scaler_of(sp), path)
    mean, std = scaler_params(read_scaler(spark, path))
    ev = build_tokens(sp.where(F.col("split") == "test"))
    s = score_events(event_tensors(ev, mean, std), masked_sum_predict_fn(3))
    return rounded(s.select("event_id", "y", "dimuon_mass", *[F.col("p")[c].alias(f"p{c}") for c in range(3)]))


def _features(sp: DataFrame) -> DataFrame:
    """The scaled feature vector of every event of a written split with its label, split and mass: built once, written,
    read again."""
    mean, std = scaler_params(scaler_of(sp))
    # transform keeps a single reference to the tokens and small compiled code, unlike 112 separate elements
    ev = build_tokens(sp).withColumn("tokens", F.transform("tokens", lambda t: F.struct(scaled_array(t["x"], mean, std).alias("x"))))
    ev = token_features(ev).select("event_id", "y", "split", "dimuon_mass", "features")
    return written(ev, "features")


def _train_rows(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    ev = _features(written(_split(spark, sf_dir), "split"))
    return ev, balanced_weights(ev.where(F.col("split") == "train"))


@query
def train_lr(spark, sf_dir):
    ev, train = _train_rows(spark, sf_dir)
    te = predict_proba(fit_classifier(train), ev.where(F.col("split") == "test"))
    out = with_prediction(te).select("event_id", "y", "pred", *[F.col("p")[c].alias(f"p{c}") for c in range(3)])
    return rounded(out)


def _met(equations: DataFrame) -> DataFrame:
    """The equations of the optimum: what the rows ask for, and whether the fit meets it."""
    return rounded(equations.select("class", "feature", "observed", (F.abs("residual") < 1e-4).alias("met")))


@query
def train_optimum(spark, sf_dir):
    _, train = _train_rows(spark, sf_dir)
    return _met(score_equations(fit_classifier(train), train, weight_col="w"))


def _probe_rows(spark, sf_dir):
    sp = written(_split(spark, sf_dir), "split")  # read for the edges and for the features
    k, edges = fit_mass_bins(_masses(sp.where(F.col("split") == "train")), candidate_k=CANDIDATE_K, min_bin_count=MIN_BIN_COUNT)
    return k, assign_mass_bins(_features(sp), edges)


@query
def mass_leakage_probe(spark, sf_dir):
    k, ev = _probe_rows(spark, sf_dir)
    model = fit_mass_probe(ev.where(F.col("split") == "train"))
    va = predict_proba(model, ev.where(F.col("split") == "val"))
    ce = -F.ln(F.greatest(F.element_at("p", F.col("mass_bin") + 1), F.lit(1e-15)))
    out = va.agg(F.count(F.lit(1)).alias("n"), F.avg(ce).alias("loss_adv"),
                 F.avg((F.array_position("p", F.array_max("p")) - 1 == F.col("mass_bin")).cast("double")).alias("accuracy"))
    return rounded(out.select(F.lit(k).alias("K"), "n", "loss_adv", F.ln(F.lit(float(k))).alias("chance"), "accuracy"))


@query
def probe_optimum(spark, sf_dir):
    train = _probe_rows(spark, sf_dir)[1].where(F.col("split") == "train")
    return _met(score_equations(fit_mass_probe(train), train, "mass_bin"))


for _n in ["early_stopping", "best_epoch", "lambda_schedule", "epoch_means"]:
    QUERIES[_n] = QUERIES.pop(_n + "_q")


# ---------------------------------------------------------------- curation job (S6 over the fixture)
@query
def curation_job(spark, sf_dir):
    ev = event_view(spark, sf_dir).withColumn("_ord", F.col("event_id"))
    names = F.array(*[F.lit(n) for n in LABEL_NAMES])
    ev = ev.withColumn("source", names[F.col("y")])
    cur = curate(ev.select("event_id", "y", "source", "dimuon_mass", "_ord"), n_keep=1000, seed=SEED)
    path = scratch_dir(spark, "curated")
    write_curated(spark, cur, LABEL_NAMES, path)
    back = spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("r"))
    place = F.row_number().over(Window.partitionBy("source").orderBy("f", "r")) - 1  # at most 1000 rows a source
    return rounded(back.select("event_id", "y", "source", "dimuon_mass", place.cast("long").alias("pos")))


# ---------------------------------------------------------------- file scan (S1, S3, S4, R1, R2 over files)
@query
def file_rows(spark, sf_dir):
    """Files in list order, one of them twice: scan -> window -> position per class -> fold."""
    p = f"{sf_dir}/lineitem.parquet"
    ev = read_labelled_sources(spark, {"ggH": [p, p], "VBF": [p]}, columns=["l_orderkey", "l_linenumber", "l_quantity"])
    ev = window_half_open(ev, "l_quantity", (10.0, 40.0))
    return assign_folds(file_row_index(ev)).select("y", "file_ord", "row_index", "idx", "fold")


@query
def checked_inputs(spark, sf_dir):
    """S3: every requested file, whether it is missing, and its rows by source."""
    names = {"ggH": ["lineitem", "absent_a"], "VBF": ["orders"], "DY": ["absent_b", "events"]}
    path = lambda n: f"{sf_dir}/{n}.parquet"
    gone = set(missing_paths(spark, [path(n) for own in names.values() for n in own]))
    asked = [(source, n, path(n) in gone) for source, own in names.items() for n in own]
    grid = F.array(*[F.struct(F.lit(s).alias("source"), F.lit(n).alias("name"), F.lit(m).alias("missing")) for s, n, m in asked])
    there = [n for _, n, m in asked if not m]
    rows = [spark.read.parquet(path(n)).select(F.lit(n).alias("name")) for n in there]
    counts = reduce(DataFrame.unionByName, rows).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return spark.range(1).select(F.inline(grid)).join(counts, "name", "left").select("source", "name", "missing", F.coalesce("n", F.lit(0)).alias("n"))
