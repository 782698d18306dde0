"""Train two conversion models, compare them on the held-out part, keep the better one."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adfathom.operators.evaluation import confusion_metrics, pr_curve, ranking_metrics, roc_curve
from adfathom.operators.features import (
    CATEGORICAL_FEATURES,
    FEATURES,
    LEAKAGE,
    NUMERIC_FEATURES,
    TARGET,
    Preparation,
    feature_table,
    fit_preparation,
)
from adfathom.operators.splits import SEED, TEST_SHARE, class_distribution, with_split
from adfathom.schema import EngineError, NotFound
from adfathom.sources.files import path_exists
from adfathom.staging import dealt, stage

LOGISTIC = "LogisticRegression"
FOREST = "RandomForest"

# Texts kept with a model.
TARGET_DEFINITION = "converted = 1 if purchases > 0 else 0"
MODEL_TYPE = "Mid-campaign optimisation model"
QUESTION = "Will an active advertising segment generate at least one approved conversion?"
SCOPE_NOTE = (
    "This is a mid-campaign optimisation model because impressions, clicks, and spend become "
    "available while the campaign is active. It is not a pre-launch prediction model."
)
SPLIT_NOTE = (
    "The dataset contains no campaign dates, so a time-based split is not possible. "
    "The current stratified split is for MVP evaluation only."
)

#: Most rows in a part of the training rows. It sizes the plan and has no part in any result but the forest's draws.
PART_ROWS = 1_000_000

METRIC_COLUMNS = ["accuracy", "precision", "recall", "f1_score", "roc_auc", "average_precision"]
CONFUSION_COLUMNS = ["true_negatives", "false_positives", "false_negatives", "true_positives"]


@dataclass(frozen=True)
class ForestSize:
    """Tree count and depth. Spark grows trees level by level and allows depth up to 30; every
    level doubles what the driver holds per tree, so the default stays moderate.
    """

    trees: int = 100
    depth: int = 10


@dataclass
class ModelResult:
    name: str
    model: PipelineModel
    scored_test: DataFrame
    metrics: dict[str, float]

    def roc_curve(self) -> DataFrame:
        return roc_curve(self.scored_test)

    def pr_curve(self) -> DataFrame:
        return pr_curve(self.scored_test)


@dataclass
class TrainingResult:
    """Results best first, and the facts about the run that are kept with the winner."""

    results: list[ModelResult]
    metadata: dict
    split: DataFrame
    settings: dict = field(default_factory=dict)

    @property
    def selected(self) -> ModelResult:
        return self.results[0]

    def leaderboard(self) -> DataFrame:
        """One row per model, best first."""
        spark = self.split.sparkSession
        rows = [
            (i, r.name, *[float(r.metrics[m]) for m in METRIC_COLUMNS], *[int(r.metrics[c]) for c in CONFUSION_COLUMNS])
            for i, r in enumerate(self.results, 1)
        ]
        schema = "place int, model_name string, "
        schema += ", ".join(f"{m} double" for m in METRIC_COLUMNS)
        schema += ", " + ", ".join(f"{c} bigint" for c in CONFUSION_COLUMNS)
        return spark.createDataFrame(rows, schema)


def prepare_model_data(df: DataFrame, seed: int = SEED) -> tuple[DataFrame, dict]:
    """Features, target and split of a table, with a description of how they were made."""
    table, plan = with_split(feature_table(df), seed)
    return table, {
        "model_type": MODEL_TYPE,
        "prediction_question": QUESTION,
        "target_column": TARGET,
        "approved_features": FEATURES,
        "prohibited_leakage_features": LEAKAGE,
        "train_fraction": 1 - TEST_SHARE,
        "test_fraction": TEST_SHARE,
        "random_state": seed,
        "stratified": plan.stratified,
        "class_distribution": distribution(table),
        "notes": [
            SCOPE_NOTE,
            SPLIT_NOTE,
            "No final model is trained by this feature-engineering preparation step.",
        ],
    }


def distribution(table: DataFrame) -> dict[str, dict[str, int]]:
    """Class counts per part as plain numbers; at most six rows reach the driver."""
    found: dict[str, dict[str, int]] = {"total": {}, "train": {}, "test": {}}
    for row in class_distribution(table).orderBy("label").collect():
        found[row["part"]][str(row["label"])] = row["n"]
    return found


def preparation_stages(fitted: Preparation) -> list:
    """Numeric block first, then the categories one-hot; a level unseen in training is all zeros."""
    indexed = [f"index_{c}" for c in CATEGORICAL_FEATURES]
    hot = [f"hot_{c}" for c in CATEGORICAL_FEATURES]
    return [
        SQLTransformer(statement=fitted.statement()),
        StringIndexer(
            inputCols=[f"filled_{c}" for c in CATEGORICAL_FEATURES],
            outputCols=indexed,
            handleInvalid="keep",
            stringOrderType="alphabetAsc",
        ),
        OneHotEncoder(inputCols=indexed, outputCols=hot, dropLast=True, handleInvalid="keep"),
        VectorAssembler(
            inputCols=[f"scaled_{c}" for c in NUMERIC_FEATURES] + hot, outputCol="model_input"
        ),
    ]


def classifier(name: str, train_rows: int, seed: int, forest: ForestSize):
    shared = dict(featuresCol="model_input", labelCol=TARGET, weightCol="class_weight")
    if name == LOGISTIC:
        # Balanced weights add up to the row count, so this penalty equals C = 1.
        return LogisticRegression(
            regParam=1.0 / train_rows,
            elasticNetParam=0.0,
            standardization=False,
            maxIter=1000,
            tol=1e-9,
            **shared,
        )
    return RandomForestClassifier(
        numTrees=forest.trees,
        maxDepth=forest.depth,
        featureSubsetStrategy="sqrt",
        seed=seed,
        maxMemoryInMB=1024,
        # each row's node of each tree is kept from level to level instead of found anew from the root; with a
        # level a pass, the lineage is too short to be worth a checkpoint of them
        cacheNodeIds=True,
        checkpointInterval=-1,
        **shared,
    )


def even_parts(inputs: DataFrame, rows: int) -> DataFrame:
    """`inputs` in as many even parts as tasks run at once, or more where a part would pass PART_ROWS.

    Every level of the forest sends the counts of all its nodes once from each part, and waits for the last part.
    """
    tasks = inputs.sparkSession.sparkContext.defaultParallelism
    return inputs.repartition(max(tasks, -(-rows // PART_ROWS)))


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add conversion_probability and predicted_class (1 above one half) to a table.

    Every input column is kept; a feature table is built where `df` is not one yet.
    """
    kept = df.columns
    table = df if f"f_{FEATURES[0]}" in kept else feature_table(df)
    scored = model.transform(table)
    probability = vector_to_array("probability")[1]
    kept = [c for c in kept if not c.startswith("f_")]
    wanted = [F.col(c) for c in kept if c not in (TARGET, "class_weight")]
    return scored.select(*wanted, F.col(TARGET), probability.alias("conversion_probability")).withColumn(
        "predicted_class", (F.col("conversion_probability") > 0.5).cast("int")
    )


def predictions(model: PipelineModel, df: DataFrame) -> DataFrame:
    """The score of every row of the current table beside what really happened."""
    scored = score(model, df)
    return scored.select(
        F.coalesce("ad_id", F.lit(0).cast("bigint")).alias("ad_id"),
        "campaign_id",
        "age",
        "gender",
        "interest",
        "impressions",
        "clicks",
        "spend",
        F.col(TARGET).alias("actual_converted"),
        "conversion_probability",
        "predicted_class",
    )


def evaluate(scored_test: DataFrame) -> dict[str, float]:
    """All metrics of a scored table; one small row from each of two jobs."""
    counts = confusion_metrics(scored_test).head().asDict()
    return counts | ranking_metrics(scored_test).head().asDict()


def balanced_weight(counts: dict[int, int]) -> Column:
    """Rows over (classes times rows of the own class)."""
    total = sum(counts.values())
    weight = F.lit(0.0)
    for label, n in counts.items():
        weight = F.when(F.col(TARGET) == label, F.lit(total / (len(counts) * n))).otherwise(weight)
    return weight


def train_and_compare(
    df: DataFrame,
    *,
    seed: int = SEED,
    forest: ForestSize = ForestSize(),
    models: tuple[str, ...] = (LOGISTIC, FOREST),
) -> TrainingResult:
    """Fit each model on the same training part and rank them on the same held-out part.

    The better average precision wins, then F1, then ROC AUC.
    """
    numbered = df if "_row" in df.columns else df.withColumn("_row", F.monotonically_increasing_id())
    # Written once: the split, both fits and all scoring read the same rows and row numbers.
    table, description = prepare_model_data(stage(dealt(numbered), "training-rows"), seed)
    table = stage(table, "training-split")
    train, test = table.filter(F.col("split") == "train"), table.filter(F.col("split") == "test")
    parts = description["class_distribution"]
    counts = {int(label): n for label, n in parts["train"].items()}
    if len(counts) < 2:
        raise EngineError("Training needs both converting and non-converting rows.")
    train_rows = sum(counts.values())
    fitted = fit_preparation(train)
    weighted = train.withColumn("class_weight", balanced_weight(counts))

    preparation = Pipeline(stages=preparation_stages(fitted)).fit(weighted)
    inputs = preparation.transform(weighted).select("model_input", TARGET, "class_weight")
    inputs = even_parts(inputs, train_rows).persist(StorageLevel.MEMORY_AND_DISK)
    results = []
    try:
        for name in models:
            fit = classifier(name, train_rows, seed, forest).fit(inputs)
            model = PipelineModel(stages=[*preparation.stages, fit])
            scored = stage(score(model, test.drop("split", "_row")), f"scored-test-{name}")
            results.append(ModelResult(name, model, scored, evaluate(scored)))
    finally:
        inputs.unpersist()
    results.sort(
        key=lambda r: tuple(r.metrics[m] for m in ("average_precision", "f1_score", "roc_auc")),
        reverse=True,
    )
    best = results[0]
    metadata = {
        "selected_model_name": best.name,
        "training_timestamp": datetime.now(timezone.utc).isoformat(),
        "dataset_row_count": sum(parts["total"].values()),
        "training_row_count": train_rows,
        "testing_row_count": sum(parts["test"].values()),
        "target_definition": TARGET_DEFINITION,
        "approved_features": FEATURES,
        "excluded_leakage_features": LEAKAGE,
        "class_distribution": parts,
        "evaluation_metrics": best.metrics,
        "random_state": seed,
        "dataset_limitations": [SCOPE_NOTE, SPLIT_NOTE],
    }
    return TrainingResult(results, metadata, table)


def input_names(model: PipelineModel) -> list[str]:
    """What each place of the model input stands for: the numbers, then each level of each category."""
    index = next(s for s in model.stages if isinstance(s, StringIndexerModel))
    levels = zip(CATEGORICAL_FEATURES, index.labelsArray, strict=True)
    # the index keeps one more level, for values that training has not seen
    return [*NUMERIC_FEATURES, *(f"{c}_{level}" for c, labels in levels for level in [*labels, "__unknown"])]


def feature_importance(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Features by importance: coefficient size and sign, or impurity share without direction.

    `df` only supplies the session; no row of it is read.
    """
    spark = df.sparkSession
    names = input_names(model)
    fit = model.stages[-1]
    if hasattr(fit, "coefficients"):
        values = [(abs(float(c)), "positive" if c > 0 else "negative") for c in fit.coefficients.toArray()]
    else:
        values = [(float(v), None) for v in fit.featureImportances.toArray()]
    rows = [(n, v, d) for n, (v, d) in zip(names, values, strict=True)]
    table = spark.createDataFrame(rows, "feature string, importance double, direction string")
    return table.orderBy(F.desc("importance"), "feature")


def logistic_gradient(model: PipelineModel, train: DataFrame) -> DataFrame:
    """How far a logistic fit is from the optimum: the gradient of its penalised mean loss, one aggregate over `train`.

    A row for each input and one for the intercept, with the rows and the total class weight behind them. All
    components are zero at the solution.
    """
    fit = model.stages[-1]
    counts = {r[TARGET]: r["count"] for r in train.groupBy(TARGET).count().collect()}
    weight = balanced_weight(counts)
    pull = weight * (vector_to_array("probability")[1] - F.col(TARGET))
    names = [*input_names(model), "intercept"]
    places = vector_to_array("model_input")
    sums = model.transform(train).select(weight.alias("weight"), pull.alias("pull"), places.alias("x")).agg(
        F.count("*").alias("n_rows"),
        F.sum("weight").alias("total_weight"),
        *(F.sum(F.col("pull") * F.col("x")[i]).alias(f"g{i}") for i in range(len(names) - 1)),
        F.sum("pull").alias(f"g{len(names) - 1}"),
    )
    # the intercept carries no penalty
    penalty = [*fit.coefficients.toArray().tolist(), 0.0]
    parts = [
        F.struct(F.lit(name).alias("feature"), ((F.col(f"g{i}") + F.lit(w)) / F.col("n_rows")).alias("gradient"))
        for i, (name, w) in enumerate(zip(names, penalty, strict=True))
    ]
    return sums.select("n_rows", "total_weight", F.inline(F.array(*parts)))


def top_features(importance: DataFrame, limit: int = 15) -> DataFrame:
    return importance.orderBy(F.desc("importance"), "feature").limit(limit)


class ModelStore:
    """The winning model and its description below one folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.model_path = f"{folder.rstrip('/')}/model"
        self.metadata_path = f"{folder.rstrip('/')}/metadata"
        self.split_path = f"{folder.rstrip('/')}/held-out"

    def save(self, result: TrainingResult) -> None:
        result.selected.model.write().overwrite().save(self.model_path)
        # The held-out rows stay with the model, so a later back-test never sees training rows.
        result.selected.scored_test.write.mode("overwrite").parquet(self.split_path)
        text = self.spark.createDataFrame([(json.dumps(result.metadata),)], "value string")
        text.coalesce(1).write.mode("overwrite").text(self.metadata_path)

    def load(self) -> PipelineModel:
        try:
            return PipelineModel.load(self.model_path)
        except Exception as missing:
            if path_exists(self.spark, self.model_path):
                raise
            raise NotFound("No model has been trained yet.") from missing

    def metadata(self) -> dict | None:
        if not path_exists(self.spark, self.metadata_path):
            return None
        return json.loads(self.spark.read.text(self.metadata_path).head()["value"])

    def held_out(self) -> DataFrame:
        if not path_exists(self.spark, self.split_path):
            raise NotFound("No model has been trained yet.")
        return self.spark.read.parquet(self.split_path)

    def status(self) -> dict:
        kept = self.metadata()
        fields = ["selected_model_name", "training_timestamp", "dataset_row_count", "target_definition"]
        return {"model_exists": kept is not None} | {f: (kept or {}).get(f) for f in fields}
