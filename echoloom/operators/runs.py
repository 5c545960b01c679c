"""Analytics over training logs: one row per run and step."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echoloom.operators.spread import blocked_rank, bounded, by_width
from echoloom.session import materialize


def logging_window_mean(df: DataFrame, every: int, value: str = "m") -> DataFrame:
    """Mean of each complete stretch of ``every`` steps, reported at its last step.

    The difference of running sums at the reporting steps is the sum of the
    stretch, so this is a grouped mean: no window over a run is needed.
    """
    stretch = F.floor((F.col("step") - 1) / F.lit(every))
    return (
        df.groupBy("run_id", stretch.alias("_stretch"))
        .agg(F.max("step").alias("step"), (F.sum(value) / F.lit(every)).alias("loss"))
        .where(F.col("step") % every == 0).drop("_stretch")
    )


def latest_metrics(df: DataFrame, *metrics: str) -> DataFrame:
    """Each metric at the last step of its run."""
    return df.groupBy("run_id").agg(F.max("step").alias("step"),
                                    *[F.max_by(m, "step").alias(m) for m in metrics])


def best_checkpoint(df: DataFrame, value: str = "m", minimize: bool = False) -> DataFrame:
    """Best value of each run and the first step that reached it (no early stop, delta 0)."""
    signed = F.col(value) if minimize else -F.col(value)
    first = F.min(F.struct(signed.alias("signed"), F.col("step").alias("step"), F.col(value).alias("best")))
    return df.groupBy("run_id").agg(first.alias("_b")).select("run_id", "_b.step", "_b.best")


def batch_assign(df: DataFrame, order: str, batch_size: int, block: Column | list[Column]) -> DataFrame:
    """Add ``batch``: consecutive groups of ``batch_size`` rows in ``order``."""
    return (blocked_rank(df, [], [order], "_rank", block)
            .withColumn("batch", F.floor((F.col("_rank") - 1) / F.lit(batch_size))).drop("_rank"))


def mean_of_batch_means(df: DataFrame, value: str) -> DataFrame:
    """Mean over ``batch`` of the mean in each batch."""
    return (df.groupBy("batch").agg(F.avg(value).alias("_mean"))
            .agg(F.avg("_mean").alias("eval_loss"), F.count("*").alias("batches")))


STATE = "struct<best:double,best_step:bigint,counter:bigint,stop:bigint,up:boolean>"
# Rows folded at once, and summaries put together at once.
WIDTH, GROUP = 4096, 64


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _state(best: Column, best_step: Column, counter: Column, stop: Column, up: Column) -> Column:
    fields = {"best": best, "best_step": best_step, "counter": counter, "stop": stop, "up": up}
    return F.struct(*[c.alias(n) for n, c in fields.items()]).cast(STATE)


def _unset() -> Column:
    return _state(F.lit(None), F.lit(None), F.lit(0), F.lit(None), F.lit(False))


def _from_row(x: Column) -> Column:
    """The state right after a row that improved."""
    return _state(x["m"], x["step"], F.lit(0), F.lit(None), F.lit(False))


class _Rule:
    """The early-stop rule as expressions; a best of 0 counts as unset."""

    def __init__(self, delta: float, minimize: bool, patience: int | None):
        self.delta, self.minimize, self.patience = delta, minimize, patience

    def step(self, s: Column, x: Column) -> Column:
        """The state after one more row; ``up`` says whether the row improved."""
        unset = F.coalesce(s["best"], F.lit(0.0)) == 0
        held = _let(F.struct(F.when(unset, x["m"]).otherwise(s["best"]).alias("best"),
                             F.when(unset, x["step"]).otherwise(s["best_step"]).alias("best_step")),
                    lambda b: self._judged(s, x, b))
        return F.when(s["stop"].isNotNull(), s).otherwise(held)

    def _judged(self, s: Column, x: Column, b: Column) -> Column:
        gap = x["m"] - b["best"]
        better = gap > self.delta
        if self.minimize:
            better = F.when(b["best"] != 0, gap < self.delta).otherwise(better)
        none, no = F.lit(None), F.lit(False)
        idle = _state(b["best"], b["best_step"], F.lit(0), none, no)
        if self.patience is not None:
            idle = F.when(s["counter"] < self.patience, _state(
                b["best"], b["best_step"], s["counter"] + 1, none, no)).otherwise(
                _state(b["best"], b["best_step"], s["counter"], x["step"], no))
        return F.when(F.coalesce(better, no), _state(x["m"], x["step"], F.lit(0), none, F.lit(True))).otherwise(idle)

    def fold(self, rows: Column, start: Column) -> Column:
        return F.aggregate(rows, start, self.step)

    def enter(self, s: Column, head: Column) -> Column:
        """The state after a block: its first rows one by one, up to one that improves, and from there its exit."""
        def go(acc: Column, x: Column) -> Column:
            after = _let(self.step(acc["s"], x), lambda t: F.struct(
                F.when(t["up"], x["exit"]).otherwise(t).alias("s"), (t["up"] | t["stop"].isNotNull()).alias("done")))
            return F.when(acc["done"], acc).otherwise(after)

        start = F.struct(s.alias("s"), s["stop"].isNotNull().alias("done"))
        return F.aggregate(head, start, go, lambda acc: acc["s"])


def _heads(rule: _Rule, blocks: DataFrame) -> DataFrame:
    """Summaries of ordered blocks ``l``: the rows an entering state can look at, each with the state it would lead to.

    A block that holds more rows than ``patience`` either improves in its first ``patience + 1`` rows or ends the run
    there; from an improvement on, nothing depends on what entered. Without patience every row is kept.
    """
    n = F.size("l")
    kept = n if rule.patience is None else F.least(n, F.lit(rule.patience + 1))
    first = F.transform(F.sequence(F.lit(1), kept), lambda i: _let(F.element_at("l", i), lambda x: F.struct(
        x["step"].alias("step"), x["m"].alias("m"),
        rule.fold(F.slice("l", i + 1, F.greatest(n - i, F.lit(0))), _from_row(x)).alias("exit"))))
    return blocks.select("run_id", "block", first.alias("head"))


def _compose(rule: _Rule, heads: DataFrame) -> DataFrame:
    """Each ``GROUP`` consecutive summaries as one: the first one's rows, their exits led through the others.

    All blocks but a run's last hold more rows than ``patience``, so no state passes the first one untouched.
    """
    listed = F.sort_array(F.collect_list(F.struct("block", "head")))
    grouped = heads.groupBy("run_id", F.floor(F.col("block") / F.lit(GROUP)).alias("block")).agg(listed.alias("b"))
    rest = F.slice("b", 2, F.size("b"))
    head = F.transform(F.get("b", F.lit(0))["head"], lambda x: F.struct(
        x["step"].alias("step"), x["m"].alias("m"),
        F.aggregate(rest, x["exit"], lambda s, block: rule.enter(s, block["head"])).alias("exit")))
    return grouped.select("run_id", "block", head.alias("head"))


def early_stopping(df: DataFrame, value: str = "m", patience: int | None = 10, delta: float = 0.0,
                   minimize: bool = False, width: int = WIDTH) -> DataFrame:
    """``run_id, best, best_step, stop_step`` of each run; ``patience`` None never stops.

    At each step, in order: an unset or zero best value takes the step's value;
    a value better by more than ``delta`` becomes the best and clears the
    counter; otherwise the counter grows, and beyond ``patience`` the run stops.

    The fold is an expression over the sorted rows of a run. A run of more than
    ``width`` rows is cut into blocks of that many, which are summarised apart;
    a summary has at most ``patience + 1`` rows, however often the run improves,
    and summaries are put together level by level, ``GROUP`` at a time, so no
    task sees more than that of a run. Without patience a state may pass many
    blocks, so a run is not cut but folded whole. ``step`` is a unique integer
    per run.
    """
    rule = _Rule(delta, minimize, patience)
    rows = df.select("run_id", F.col("step").cast("bigint").alias("step"), F.col(value).cast("double").alias("m"))
    width = max(width, 0 if patience is None else patience + 1)
    listed = F.sort_array(F.collect_list(F.struct("step", "m"))).alias("l")

    def result(runs: DataFrame, state: Column) -> DataFrame:
        return runs.select("run_id", state.alias("s")).select(
            "run_id", "s.best", "s.best_step", F.col("s.stop").alias("stop_step"))

    def whole(some: DataFrame) -> DataFrame:
        return result(some.groupBy("run_id").agg(listed), rule.fold(F.col("l"), _unset()))

    if patience is None:
        return whole(rows)
    hot = materialize(rows.groupBy(F.col("run_id").alias("_hot")).agg(F.count("*").alias("_n"))
                      .where(F.col("_n") > width), "hot-runs")
    longest = hot.agg(F.count("*").alias("runs"), F.max("_n").alias("n")).first()
    if not longest.runs:
        return whole(rows)
    keys = bounded(hot.select("_hot"), longest.runs)
    same = F.col("run_id").eqNullSafe(F.col("_hot"))
    ranked = blocked_rank(rows.join(keys, same, "left_semi"), ["run_id"], ["step"], "_rank", by_width("step", width))
    blocks = ranked.withColumn("block", F.floor((F.col("_rank") - 1) / F.lit(width))).groupBy("run_id", "block").agg(
        listed)
    heads, last = materialize(_heads(rule, blocks), "run-heads"), (longest.n - 1) // width
    while last:
        heads, last = materialize(_compose(rule, heads), "run-heads"), last // GROUP
    return whole(rows.join(keys, same, "left_anti")).unionByName(result(heads, rule.enter(_unset(), F.col("head"))))
