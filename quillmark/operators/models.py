"""Model stages. Scorers and text generators are injected; what surrounds them is here, and a feature verifier that trains on Spark."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .calibrate import best_threshold, threshold_sweep
from .pool import FEATURES


#: Fixed value: the weight of squared coefficients of standardised features.
PENALTY = 1e-3


def _penalty(examples: DataFrame) -> float:
    """PENALTY for examples that stand for several. Spark divides squared deviations by the sum of weights less sum of squares / sum,
    which is another number once rows are put together; this undoes it, so that the optimum is that of the rows apart."""
    w, k = F.when(F.col("label") == 1, F.col("pos_weight")).otherwise(1.0), F.col("times")
    r = examples.agg(F.sum(w * k).alias("w"), F.sum(w * w * k).alias("apart"), F.sum(w * k * w * k).alias("together")).first()
    apart, together = r["w"] - r["apart"] / r["w"] if r["w"] else 0.0, r["w"] - r["together"] / r["w"] if r["w"] else 0.0
    return PENALTY * together / apart if apart > 0 and together > 0 else PENALTY


def train_verifier(examples: DataFrame, kind: str = "logistic", features=FEATURES, seed: int = 42, max_iter: int = 50) -> PipelineModel:
    """A verifier over pool features: logistic regression with weighted positives, or one hidden layer, which takes no weights. Examples
    with a column ``times`` stand for so many."""
    weight = F.when(F.col("label") == 1, F.col("pos_weight")).otherwise(1.0)
    if "times" in examples.columns:
        if kind != "logistic":
            raise ValueError("only the logistic verifier takes examples that stand for several")
        weight = weight * F.col("times")
    penalty = _penalty(examples) if "times" in examples.columns else PENALTY
    x = examples.select(*features, "label", weight.alias("_w")).persist()  # every iteration reads it
    gather = VectorAssembler(inputCols=list(features), outputCol="_phi")
    if kind == "logistic":
        model = LogisticRegression(featuresCol="_phi", labelCol="label", weightCol="_w", regParam=penalty, maxIter=max_iter)
    else:
        model = MultilayerPerceptronClassifier(featuresCol="_phi", labelCol="label", layers=[len(features), 16, 2], seed=seed, maxIter=max_iter)
    try:
        return Pipeline(stages=[gather, model]).fit(x)
    finally:
        x.unpersist()


def apply_verifier(model: PipelineModel, pool: DataFrame) -> DataFrame:
    """note_id, code, score; a row of the pool with a column ``times`` is scored once and comes so often."""
    scored = model.transform(pool).withColumn("score", vector_to_array("probability")[1])
    if "times" in pool.columns:
        scored = scored.select("note_id", "code", "score", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return scored.select("note_id", "code", "score")


def select_model(models: list[PipelineModel], pool: DataFrame, gold: DataFrame) -> tuple[PipelineModel, float, float]:
    """The model with the best validation F1 at its best threshold: model, threshold, F1. The first of equals."""
    best = None
    for m in models:
        ranking = apply_verifier(m, pool).withColumn("pos", F.lit(1))
        r = best_threshold(threshold_sweep(gold, ranking)).first()
        if best is None or (r["f1"] or 0) > best[2]:
            best = (m, r["thr"], r["f1"] or 0.0)
    return best


def batch_map(df: DataFrame, schema: str, make: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]) -> DataFrame:
    """Rows through a model that each task makes once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in batches:
            yield model(b)

    return df.mapInPandas(run, schema)


def chat(notes: DataFrame, prompt: str, make_client: Callable[[], Callable[[str, str], str]], text: str = "note_text") -> DataFrame:
    """note_id, response. A call that fails leaves an empty response, never a lost note."""

    def make():
        client = make_client()

        def one(t: str) -> str:
            try:
                return client(prompt, t)
            except Exception:  # noqa: BLE001 - any failure of a remote call counts as no answer
                return ""

        return lambda b: pd.DataFrame({"note_id": b["note_id"], "response": [one(t) for t in b[text]]})

    return batch_map(notes.select("note_id", text), "note_id string, response string", make)


class Echo:
    """A client for tests: answers with the codes it is given."""

    def __init__(self, codes: list[str]):
        self.codes = codes

    def __call__(self, prompt: str, text: str) -> str:
        return "Sure. " + json.dumps({"selected": self.codes})


def fit_prompt(target: str, exemplars: list[str], candidates: list[str], budget: int, count: Callable[[str], int] = lambda s: len(s.split()), min_candidates: int = 10, min_exemplars: int = 1, min_exemplar: int = 100, min_target: int = 600) -> tuple[str, list[str], list[str]]:
    """Trim to a token budget: exemplars from the end down to ``min_exemplars``, then candidates down to ``min_candidates``, then
    exemplars' length by 0.7 down to ``min_exemplar`` tokens, then the target's by 0.7 down to ``min_target``."""
    total = lambda: count(target) + sum(map(count, exemplars)) + sum(map(count, candidates))
    cut = lambda s, n: " ".join(s.split()[:n])
    while total() > budget and len(exemplars) > min_exemplars:
        exemplars = exemplars[:-1]
    while total() > budget and len(candidates) > min_candidates:
        candidates = candidates[:-1]
    while total() > budget and exemplars and max(map(count, exemplars)) > min_exemplar:
        exemplars = [cut(e, max(min_exemplar, int(count(e) * 0.7))) for e in exemplars]
    while total() > budget and count(target) > min_target:
        target = cut(target, max(min_target, int(count(target) * 0.7)))
    return target, exemplars, candidates


def sft_examples(notes: DataFrame, gold: DataFrame, bins_order: DataFrame) -> DataFrame:
    """note_id, prompt, completion: gold codes as JSON in the order of training frequency. bins_order: code, rank."""
    order = gold.join(bins_order.select("code", "rank"), "code", "left")
    codes = order.groupBy("note_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "code"))), lambda x: x["code"]).alias("selected"))
    return notes.join(codes, "note_id").select("note_id", F.col("note_text").alias("prompt"), F.to_json(F.struct("selected")).alias("completion"))


def label_vocabulary(gold: DataFrame, min_count: int = 5) -> DataFrame:
    return gold.groupBy("code").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def linear_label_classifier(train: DataFrame, gold: DataFrame, codes: list[str], text: str = "note_text", features: int = 1 << 14) -> dict:
    """One logistic model per code over hashed TF-IDF; the stand-in for a label-attention network. ``codes`` is a bounded list."""
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer

    pipe = Pipeline(stages=[RegexTokenizer(inputCol=text, outputCol="_t", pattern=r"\W+"), HashingTF(inputCol="_t", outputCol="_h", numFeatures=features), IDF(inputCol="_h", outputCol="_x")]).fit(train)
    x = pipe.transform(train).select("note_id", "_x")
    out = {}
    for c in codes:
        y = gold.where(F.col("code") == c).select("note_id", F.lit(1).alias("label"))
        out[c] = LogisticRegression(featuresCol="_x", labelCol="label", maxIter=20, regParam=1e-2).fit(x.join(y, "note_id", "left").na.fill(0, ["label"]))
    return {"features": pipe, "models": out}


def multi_hot(gold: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """note_id, ones: places of a note's codes in the vocabulary, by code from 0. The sparse form of the label matrix; the vocabulary is a code list."""
    from pyspark.sql.window import Window

    at = vocabulary.select("code", (F.row_number().over(Window.orderBy("code")) - 1).alias("at"))
    return gold.join(at, "code").groupBy("note_id").agg(F.sort_array(F.collect_set("at")).alias("ones"))


def merge_lists(lists, most: int):
    """Lists one after the other as one: first appearances, at most ``most``."""
    return F.slice(F.array_distinct(F.flatten(lists)), 1, most)
