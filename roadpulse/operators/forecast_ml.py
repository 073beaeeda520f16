"""Lane forecasts several steps ahead with Spark ML, from a lane's own history and its neighbourhood.

Three estimators share one feature vector: a linear regression for the count, a binomial logistic regression for the
congestion probability and a multinomial one for the level. Every step has weights of its own for the whole history
(step x history interactions, as sparse vectors), as what a lane will do next depends on how it got where it is.

The regression minimises squared errors; a count that is to be near on average lies nearer to the last value and to a whole
number of vehicles. How much is chosen on rows with known outcomes (``tune_count``).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import Interaction, OneHotEncoder, VectorAssembler, VectorSizeHint
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from roadpulse.config import Episode, ForecastWindow
from roadpulse.operators.episodes import decode_forecast, episodes
from roadpulse.operators.features import FEATURES, recent_times
from roadpulse.operators.graph import neighbour_means
from roadpulse.operators.quality import forecast_metrics
from roadpulse.plans.slices import SLICE, drop_copies, overlap

MEASURED = ("vehicle_count", "avg_speed_kmh", "stopped_ratio", "congestion_score")
CYCLES = tuple(c for c in FEATURES if c not in MEASURED)
PARTS = ("count", "prob", "level")
LEVELS_CODED = 3
RULE = "last_at int, unit double, share double, whole boolean"


def _with_history(dense: DataFrame, edges: DataFrame, window: ForecastWindow, ahead: int) -> DataFrame:
    """Feature vector of every (node, time) with a full history, plus the targets of the next ``ahead`` steps.

    The history looks ``t_in - 1`` steps back and the targets ``t_out`` ahead, so a node's series is cut into slices
    that overlap by that much.
    """
    around = neighbour_means(dense, edges, list(MEASURED), window.hops)
    hops = [f"{c}_hop{h}" for h in range(1, window.hops + 1) for c in MEASURED]
    back = window.t_in - 1
    placed = overlap(around, F.col("t_idx"), 20 * (window.t_in + window.t_out), before=back, after=ahead)
    order = W.partitionBy("node", SLICE).orderBy("t_idx")
    own = F.collect_list(F.array(*MEASURED)).over(order.rowsBetween(-back, 0))
    target = F.collect_list(F.struct("vehicle_count", "congestion_prob", "congestion_level_idx"))
    framed = placed.withColumns(
        {
            "_own": own,
            "_next": target.over(order.rowsBetween(1, ahead)) if ahead else F.array(),
        }
    )
    neighbours = F.array(*[F.coalesce(c, F.lit(0.0)) for c in hops])
    level = F.array(*[(F.col("congestion_level_idx") == i).cast("double") for i in range(LEVELS_CODED)])
    vector = F.concat(F.flatten("_own"), neighbours, F.array(*CYCLES), level)
    return drop_copies(framed.filter(F.size("_own") == window.t_in)).select(
        "node", "t_idx", "window_start", array_to_vector(vector).alias("history"), "_next"
    )


def training_table(dense: DataFrame, edges: DataFrame, window: ForecastWindow = ForecastWindow()) -> DataFrame:
    """L1: one row per (node, start, step) with the features at the start and the targets of that step."""
    samples = _with_history(dense, edges, window, window.t_out).filter(F.size("_next") == window.t_out)
    steps = samples.select("node", "t_idx", "window_start", "history", F.posexplode("_next").alias("step", "target"))
    return steps.select(
        "node",
        F.col("t_idx").alias("start"),
        "window_start",
        "step",
        "history",
        F.col("target.vehicle_count").alias("count"),
        F.col("target.congestion_prob").alias("prob"),
        F.col("target.congestion_level_idx").cast("double").alias("level"),
    )


def split(
    table: DataFrame, seed: int = 42, validation: float = 0.15, test: float = 0.10
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """L3: by a hash of the sample's start, so all rows of a sample fall on the same side in every run."""
    share = F.pmod(F.xxhash64(F.lit(seed), F.col("start")), F.lit(10_000)) / 10_000
    return (
        table.filter(share >= validation + test),
        table.filter((share >= test) & (share < validation + test)),
        table.filter(share < test),
    )


def split_by_time(
    table: DataFrame, validation: float = 0.15, test: float = 0.10, gap: int = 0
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """L3: oldest samples for training, newest for the test.

    Neighbouring samples overlap, so a random split tests on steps it has trained on. ``gap`` leaves out that many
    starts (``t_in + t_out``) before each border.
    """
    bounds = table.agg(F.max("start").alias("last")).scalar()
    first_val, first_test = bounds * (1 - validation - test), bounds * (1 - test)
    start = F.col("start")
    return (
        table.filter(start < first_val - gap),
        table.filter((start >= first_val) & (start < first_test - gap)),
        table.filter(start >= first_test),
    )


@dataclass(frozen=True)
class CountRule:
    """How a count follows from the regression and from the last value: a share of the one, the rest of the other, and
    whether it is a whole number of vehicles. ``last_at`` is the place of the last count in the history, ``unit`` one vehicle."""

    last_at: int
    unit: float
    share: float = 1.0
    whole: bool = False

    def column(self, predicted: Column, history: Column) -> Column:
        mixed = self.share * predicted + (1 - self.share) * F.get(history, F.lit(self.last_at))
        return F.greatest(F.round(mixed / self.unit) * self.unit if self.whole else mixed, F.lit(0.0))


#: The rules that ``tune_count`` chooses from.
SHARES, WHOLE = (0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0), (False, True)


@dataclass
class Forecaster:
    """L2: the three fitted pipelines, and how counts follow from the first."""

    count: PipelineModel
    prob: PipelineModel
    level: PipelineModel
    rule: CountRule

    def transform(self, rows: DataFrame) -> DataFrame:
        """Add ``count_norm``, ``congestion_prob`` and ``level_scores`` to rows with ``history`` and ``step``."""
        made = ("features", "step_code", "named", "by_step")
        scored = self.count.transform(rows).drop(*made)
        scored = self.prob.transform(scored).drop(*made)
        scored = self.level.transform(scored)
        return scored.withColumns(
            {
                "count_norm": self.rule.column(F.col("count_out"), vector_to_array("history")),
                "congestion_prob": F.get(vector_to_array("prob_out"), F.lit(1)),
                "level_scores": vector_to_array("level_out"),
            }
        ).drop(*made, *[f"{p}_{x}" for p in PARTS for x in ("out", "raw", "pick")])


def tune_count(count: PipelineModel, rows: DataFrame, window: ForecastWindow) -> CountRule:
    """The rule with the least mean absolute error on ``rows``, among those whose squared error is below repeating the last value's."""
    plain = CountRule(len(MEASURED) * (window.t_in - 1), 1.0 / window.vehicle_count_max)
    rules = [replace(plain, share=share, whole=whole) for share in SHARES for whole in WHOLE]
    scored = count.transform(rows).select("count_out", vector_to_array("history").alias("history"), "count")
    off = [rule.column(F.col("count_out"), F.col("history")) - F.col("count") for rule in (replace(plain, share=0.0), *rules)]
    row = scored.agg(*[f(F.abs(x)).alias(f"{n}{i}") for i, x in enumerate(off) for n, f in (("a", F.avg), ("s", lambda e: F.avg(e * e)))]).first()
    if row["a0"] is None:
        return plain
    sound = [i for i in range(1, len(off)) if row[f"s{i}"] < row["s0"]]
    return rules[min(sound, key=lambda i: row[f"a{i}"]) - 1] if sound else plain


def _stages(window: ForecastWindow) -> list:
    code = OneHotEncoder(inputCols=["step"], outputCols=["step_code"], dropLast=window.t_out > 1, handleInvalid="keep")
    size = len(MEASURED) * (window.t_in + window.hops) + len(CYCLES) + LEVELS_CODED
    hint = VectorSizeHint(inputCol="history", size=size, handleInvalid="optimistic")
    named = VectorAssembler(inputCols=["history"], outputCol="named")  # interactions need attributes
    by_step = Interaction(inputCols=["step_code", "named"], outputCol="by_step")
    return [code, hint, named, by_step, VectorAssembler(inputCols=["named", "step_code", "by_step"], outputCol="features")]


def _estimators(reg: float, iterations: int) -> dict:
    logistic = {"maxIter": iterations, "regParam": reg}
    return {
        "count": LinearRegression(
            labelCol="count", predictionCol="count_out", maxIter=iterations, regParam=reg, solver="l-bfgs"
        ),
        "prob": LogisticRegression(
            labelCol="outcome", weightCol="weight", family="binomial", probabilityCol="prob_out",
            rawPredictionCol="prob_raw", predictionCol="prob_pick", **logistic,
        ),
        "level": LogisticRegression(
            labelCol="level", family="multinomial", probabilityCol="level_out", rawPredictionCol="level_raw",
            predictionCol="level_pick", **logistic,
        ),
    }


def _outcomes(table: DataFrame) -> DataFrame:
    """A target probability p is p parts of a congested and 1 - p parts of a free outcome."""
    sides = F.array(
        F.struct(F.lit(1.0).alias("outcome"), F.col("prob").alias("weight")),
        F.struct(F.lit(0.0).alias("outcome"), (1 - F.col("prob")).alias("weight")),
    )
    return table.withColumn("_side", F.explode(sides)).select("*", "_side.*").drop("_side").filter("weight > 0")


def fit_forecaster(
    table: DataFrame, window: ForecastWindow = ForecastWindow(), reg: float = 1e-3, iterations: int = 25
) -> Forecaster:
    """L2."""
    fits = {}
    for part, estimator in _estimators(reg, iterations).items():
        rows = _outcomes(table) if part == "prob" else table
        fits[part] = Pipeline(stages=[*_stages(window), estimator]).fit(rows)
    return Forecaster(**fits, rule=tune_count(fits["count"], table, window))


def select_model(
    train: DataFrame,
    validation: DataFrame,
    window: ForecastWindow = ForecastWindow(),
    regs: tuple[float, ...] = (1e-4, 1e-2),
    iterations: int = 25,
) -> Forecaster:
    """L4: per target, the regularisation with the lowest loss on the given validation rows (see ``split_by_time``), and the
    rule for counts that does best on them."""
    evaluators = {
        "count": RegressionEvaluator(labelCol="count", predictionCol="count_out", metricName="mse"),
        "prob": MulticlassClassificationEvaluator(
            labelCol="outcome", weightCol="weight", probabilityCol="prob_out", predictionCol="prob_pick",
            metricName="logLoss",
        ),
        "level": MulticlassClassificationEvaluator(
            labelCol="level", probabilityCol="level_out", predictionCol="level_pick", metricName="logLoss"
        ),
    }
    fits = {}
    for part in PARTS:
        rows, held = (_outcomes(t) if part == "prob" else t for t in (train, validation))
        tried = []
        for reg in regs:
            model = Pipeline(stages=[*_stages(window), _estimators(reg, iterations)[part]]).fit(rows)
            tried.append((evaluators[part].evaluate(model.transform(held)), model))
        fits[part] = min(tried, key=lambda x: x[0])[1]
    return Forecaster(**fits, rule=tune_count(fits["count"], validation, window))


def persistence(table: DataFrame, window: ForecastWindow = ForecastWindow()) -> DataFrame:
    """The errors of repeating each lane's last count and level, which a forecast has to beat."""
    history = vector_to_array("history")
    last = len(MEASURED) * (window.t_in - 1)
    coded = F.slice(history, F.size(history) - LEVELS_CODED + 1, F.lit(LEVELS_CODED))
    pairs = table.withColumns({"_history": history, "_coded": coded}).select(
        F.get("_history", F.lit(last)).alias("pred_count"),
        "count",
        F.get("_history", F.lit(last + len(MEASURED) - 1)).alias("pred_prob"),
        "prob",
        (F.array_position("_coded", F.lit(1.0)) - 1).cast("double").alias("pred_level"),
        "level",
    )
    return forecast_metrics(pairs)


def evaluate(model: Forecaster, table: DataFrame) -> DataFrame:
    """Errors and accuracies on held-out rows."""
    best = F.array_position("level_scores", F.array_max("level_scores")) - 1
    pairs = model.transform(table).select(
        F.col("count_norm").alias("pred_count"),
        "count",
        F.col("congestion_prob").alias("pred_prob"),
        "prob",
        best.cast("double").alias("pred_level"),
        "level",
    )
    return forecast_metrics(pairs)


def predict_lanes(
    model: Forecaster,
    dense: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
    window: ForecastWindow = ForecastWindow(),
) -> DataFrame:
    """Forecast of every lane from the newest ``t_in`` steps; no rows when there are fewer."""
    recent = dense.join(recent_times(dense, window.t_in), "window_start", "left_semi")
    newest = _with_history(recent, edges, window, 0)
    steps = newest.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(window.t_out - 1))))
    located = model.transform(steps).join(nodes, "node").withColumnRenamed("window_start", "origin")
    return decode_forecast(located, window.vehicle_count_max, window.step_seconds)


def predict_episodes(forecast: DataFrame, config: Episode = Episode()) -> DataFrame:
    """The congestion episodes of a forecast."""
    return episodes(forecast, config)


def save_model(model: Forecaster, path: str) -> None:
    """L7."""
    for part in PARTS:
        getattr(model, part).write().overwrite().save(f"{path}/{part}")
    rule = model.rule
    row = [(rule.last_at, rule.unit, rule.share, rule.whole)]
    SparkSession.active().createDataFrame(row, RULE).coalesce(1).write.mode("overwrite").json(f"{path}/rule")


def load_model(path: str) -> Forecaster:
    """L7."""
    rule = CountRule(*SparkSession.active().read.schema(RULE).json(f"{path}/rule").first())
    return Forecaster(**{part: PipelineModel.load(f"{path}/{part}") for part in PARTS}, rule=rule)
