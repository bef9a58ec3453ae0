"""Named featurizers and the compute-once extraction of features."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from gleaner.functions import text, vectors
from gleaner.sources.store import FeatureStore

# The names of the known pretrained image networks.
PRETRAINED_MODELS = (
    "CLIP_ViTL_14@336",
    "CLIP_ViTL_14",
    "CLIP_ViTB_16",
    "CLIP_ViTB_32",
    "CLIP_ResNet50x64",
    "CLIP_ResNet50x16",
    "CLIP_ResNet50x4",
    "CLIP_ResNet50x1",
    "CLIP_ResNet101",
    "DINO_ResNet50",
    "DINO_ViTS_8",
    "DINO_ViTB_8",
    "ConvNext_XL_Imagenet21k",
    "ConvNext_XL_384_Imagenet21k_ft_1k",
    "ConvNext_L_Imagenet21k",
    "ConvNext_L_384_Imagenet21k_ft_1k",
    "EffNet_L2_NS_475",
    "EffNet_B7_NS_600",
    "EffNetV2_L_480_Imagenet21k_ft_1k",
    "EffNetV2_S_384_Imagenet21k_ft_1k",
    "BEiT_L_16_512",
    "BEiT_L_16_384",
    "BEiT_L_16_224",
    "DeiT3_L_16_384_Imagenet21k_ft_1k",
    "DeiT3_H_14_224_Imagenet21k_ft_1k",
    "DeiT3_L_16_224_Imagenet21k_ft_1k",
)

# The feature sets offered by number of networks, in concatenation order.
FEATURE_SET_PRESETS = {
    1: ("CLIP_ViTL_14@336",),
    2: ("CLIP_ViTL_14@336", "ConvNext_XL_Imagenet21k"),
    4: ("CLIP_ViTL_14@336", "CLIP_ResNet50x64", "CLIP_ViTL_14", "ConvNext_XL_Imagenet21k"),
    7: (
        "DINO_ViTS_8",
        "DINO_ViTB_8",
        "CLIP_ViTL_14@336",
        "CLIP_ResNet50x64",
        "CLIP_ViTL_14",
        "ConvNext_XL_Imagenet21k",
        "BEiT_L_16_384",
    ),
}


@dataclass(frozen=True)
class Featurizer:
    """How to turn item columns into a vector column.

    ``columns`` are the item columns it reads; ``build`` maps them to the vector column.
    """

    columns: tuple[str, ...]
    build: Callable[..., Column]


_registry: dict[str, Featurizer] = {
    "letters27": Featurizer(("text",), text.letters27),
    "shape8": Featurizer(("text", "n_chars"), text.shape8),
    "identity": Featurizer(("embedding",), vectors.as_doubles),
}


def register_expression(name: str, columns: Sequence[str], build: Callable[..., Column]) -> None:
    """Register a featurizer made of Spark expressions."""
    _registry[name] = Featurizer(tuple(columns), build)


def register_batch_model(
    name: str,
    column: str,
    make_predict_fn: Callable[[], Callable[[np.ndarray], np.ndarray]],
    batch_size: int = 64,
) -> None:
    """Register a network: ``make_predict_fn()`` loads it once per Python worker and
    returns a function from a batch of inputs to an ``[n, width]`` array."""

    def build(inputs: Column | str) -> Column:
        predict = predict_batch_udf(
            make_predict_fn, return_type=ArrayType(DoubleType()), batch_size=batch_size
        )
        return predict(inputs)

    _registry[name] = Featurizer((column,), build)


def register_slice(name: str, column: str, start: int, width: int) -> None:
    """Register a slice of a precomputed vector (``start`` counts from 1)."""
    register_expression(
        name, [column], lambda vec: F.slice(vectors.as_doubles(vec), start, width)
    )


def featurizer(name: str) -> Featurizer:
    """Look a featurizer up by name."""
    if name in _registry:
        return _registry[name]
    if name in PRETRAINED_MODELS:
        raise KeyError(f"{name} is a pretrained network: pass it to register_batch_model first")
    raise KeyError(f"unknown featurizer {name!r}; known: {sorted(_registry)}")


def feature_set_preset(n_sets: int) -> tuple[str, ...]:
    """Models of the preset with ``n_sets`` feature sets, in concatenation order."""
    if n_sets not in FEATURE_SET_PRESETS:
        raise ValueError(f"no preset with {n_sets} feature sets: {sorted(FEATURE_SET_PRESETS)}")
    return FEATURE_SET_PRESETS[n_sets]


def feature_column(name: str) -> Column:
    """The vector column of a registered featurizer over its own item columns."""
    entry = featurizer(name)
    return entry.build(*entry.columns)


def featurize(items: DataFrame, model: str) -> DataFrame:
    """``features(sample_id, model, vec)`` of every item for one model."""
    return items.select(
        "sample_id", F.lit(model).alias("model"), feature_column(model).alias("vec")
    )


def extract_features(items: DataFrame, models: Sequence[str], store: FeatureStore) -> None:
    """Bring the store up to date: only missing (item, model) pairs are computed."""
    for model in models:
        featurizer(model)
    for model in models:
        store.append(featurize(store.pending(items, model), model))
