"""Training-log analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from echoloom.catalog import fixtures as fx
from echoloom.operators import runs as ops
from echoloom.operators.spread import by_widths

PATIENCE, DELTA = 10, 0.5


def logging_window_mean(spark, sf):
    return ops.logging_window_mean(fx.runs(spark, sf), 10).withColumn("loss", F.round("loss", 6))


def latest_metrics(spark, sf):
    return ops.latest_metrics(fx.runs(spark, sf), "m", "event_id")


def best_checkpoint(spark, sf):
    return ops.best_checkpoint(fx.runs(spark, sf))


def early_stopping(spark, sf):
    return ops.early_stopping(fx.runs(spark, sf), "m", PATIENCE, DELTA)


def early_stopping_minimize(spark, sf):
    return ops.early_stopping(fx.runs(spark, sf), "m", 3, -DELTA, minimize=True)


def _batches(spark, sf):
    events = fx.table(spark, sf, "events").select("event_id", "value")
    return ops.batch_assign(events, "event_id", 8, by_widths("event_id", 100_000))


def batch_assign(spark, sf):
    return _batches(spark, sf).select("event_id", "batch")


def mean_of_batch_means(spark, sf):
    return ops.mean_of_batch_means(_batches(spark, sf), "value").withColumn("eval_loss", F.round("eval_loss", 6))


QUERIES = {
    "logging_window_mean": logging_window_mean, "latest_metrics": latest_metrics,
    "best_checkpoint": best_checkpoint, "early_stopping": early_stopping,
    "early_stopping_minimize": early_stopping_minimize, "batch_assign": batch_assign,
    "mean_of_batch_means": mean_of_batch_means,
}

_BATCHES = "select event_id, value, (row_number() over (order by event_id) - 1) // 8 as batch from events"


def _fold(patience: int, better: str) -> str:
    """The early-stop rule step by step; ``better`` compares m with b, the best so far or m."""
    return fx.sql("select run_id, best, best_step, stop_step from fold join last on fold.run_id = last.run "
                  "and (stop_step is not null or step = last.step_) order by all", "f_runs", recursive=True,
                  last="select run_id as run, max(step) as step_ from f_runs group by run_id",
                  fold=f"""
select run_id, 0::bigint as step, null::double as best, null::bigint as best_step, 0::bigint as counter,
  null::bigint as stop_step from f_runs where step = 1
union all
select run_id, step, case when up then m else b end, case when up then step else bs end,
  case when up then 0 when counter < {patience} then counter + 1 else counter end,
  case when not up and counter >= {patience} then step end
from (select *, {better} as up from (
  select f.run_id, r.step, r.m, f.counter, case when coalesce(f.best, 0) = 0 then r.m else f.best end as b,
    case when coalesce(f.best, 0) = 0 then r.step else f.best_step end as bs
  from fold f join f_runs r on r.run_id = f.run_id and r.step = f.step + 1 where f.stop_step is null))""")


ORACLE = {
    "logging_window_mean": fx.sql("""
select run_id, max(step) as step, round(sum(m) / 10, 6) as loss from f_runs
group by run_id, (step - 1) // 10 having max(step) % 10 = 0""", "f_runs"),
    "latest_metrics": fx.sql("""
select run_id, max(step) as step, arg_max(m, step) as m, arg_max(event_id, step) as event_id from f_runs
group by run_id""", "f_runs"),
    "best_checkpoint": fx.sql("""
select run_id, step, m as best from (
  select *, row_number() over (partition by run_id order by m desc, step) as n from f_runs) where n = 1""", "f_runs"),
    "early_stopping": _fold(PATIENCE, f"m - b > {DELTA}"),
    "early_stopping_minimize": _fold(3, f"case when b <> 0 then m - b < {-DELTA} else m - b > {-DELTA} end"),
    "batch_assign": fx.sql("select event_id, batch from batches", batches=_BATCHES),
    "mean_of_batch_means": fx.sql("""
select round(avg(m), 6) as eval_loss, count(*) as batches from (select avg(value) as m from batches group by batch)""",
                                  batches=_BATCHES),
}
