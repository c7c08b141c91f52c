"""Training and prediction with Spark ML."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .model import Band, FeatureUnsupported, ProcessParameterInvalid
from .operators.cube import Cube


def fit_class_random_forest(
    predictors: DataFrame, target: DataFrame, features: Sequence[str], label: str, key: str = "feature_index", num_trees: int = 100,
    max_variables: int | str | None = None, seed: int | None = None,
) -> PipelineModel:
    """A random forest (gini, depth 4, 32 bins) of predictors joined with integer labels by key.

    max_variables is accepted for compatibility and does not change the model. Rows with a NULL predictor are left out.
    """
    if num_trees < 1:
        raise ProcessParameterInvalid("num_trees must be positive")
    missing = [f for f in features if f not in predictors.columns]
    if missing or label not in target.columns:
        raise ProcessParameterInvalid(f"no column {', '.join(missing or [label])}")
    rows = predictors.select(key, *features).join(target.select(key, F.col(label).cast("double").alias("label")), key).dropna()
    forest = RandomForestClassifier(numTrees=num_trees, maxDepth=4, maxBins=32, impurity="gini", featureSubsetStrategy="auto", seed=seed, labelCol="label")
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), forest]).fit(rows)


def fit_class_catboost(*_, **__):
    raise FeatureUnsupported("there is no such library here; use fit_class_random_forest")


def predict_class(cube: Cube, model: PipelineModel, target_band: str = "prediction", by_position: bool = False) -> Cube:
    """Per-cell prediction; cells with a NULL band get no-data. Bands are named as the model's predictors, or with by_position
    stand in their order, as a reducer's data do."""
    wanted = model.stages[0].getInputCols()
    if by_position and list(wanted) != cube.bands:
        if len(wanted) != len(cube.bands):
            raise ProcessParameterInvalid(f"the model reads {len(wanted)} bands, the cube has {len(cube.bands)}")
        cube = cube.select({n: F.col(b) for n, b in zip(wanted, cube.bands, strict=True)})
    if missing := [c for c in wanted if c not in cube.bands]:
        raise ProcessParameterInvalid(f"the cube lacks {', '.join(missing)}")
    whole = cube.df.dropna(subset=list(wanted))
    done = model.transform(whole).select(*cube.keys, F.col("prediction").alias(target_band))
    out = cube.df.select(*cube.keys).join(done, cube.keys, "left")
    return Cube(out, replace(cube.meta, bands=(Band(target_band),)))


def save_model(model: PipelineModel, path: str) -> dict:
    """Write a model; returns its description."""
    model.write().save(path)
    forest = model.stages[-1]
    return {"type": "ml-model", "architecture": "random-forest", "inputs": model.stages[0].getInputCols(), "trees": forest.getNumTrees, "classes": forest.numClasses, "href": path}


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def predict_onnx(cube: Cube, model: bytes, target_bands: Sequence[str]) -> Cube:
    """Run an ONNX model of one (rows, bands) float input and one (rows, targets) output on every cell."""
    bands, targets = cube.bands, list(target_bands)

    def run(batches):
        import onnxruntime

        session = onnxruntime.InferenceSession(model, providers=["CPUExecutionProvider"])
        name = session.get_inputs()[0].name
        for pdf in batches:
            got = np.asarray(session.run(None, {name: pdf[bands].to_numpy(np.float32)})[0]).reshape(len(pdf), len(targets))
            yield pd.concat([pdf[cube.keys], pd.DataFrame(got.astype(float), columns=targets, index=pdf.index)], axis=1)

    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cube.df.schema if f.name in cube.keys)
    done = cube.df.mapInPandas(run, keys + "".join(f", `{b}` double" for b in targets))
    return Cube(done, replace(cube.meta, bands=tuple(Band(b) for b in targets)))
