"""Settings of detectors and tone maps: typed, immutable, checked when made. They hold options only, as no detection,
description or tone mapping of pixels belongs to them. `with_(field=value)` gives a changed copy; `configured` makes the
settings of each row from its columns."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from typing import ClassVar, Self

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Settings:
    #: The least value of each bounded field.
    _LEAST: ClassVar[dict[str, float]] = {}

    def __post_init__(self) -> None:
        for name, low in self._LEAST.items():
            if getattr(self, name) < low:
                raise ValueError(f"{type(self).__name__}.{name} is at least {low}")

    def with_(self, **changes: object) -> Self:
        return replace(self, **changes)

    @property
    def default_name(self) -> str:
        return f"Feature2D.{getattr(self, '_NAME', type(self).__name__)}"

    def options(self) -> dict[str, object]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


@dataclass(frozen=True)
class AKAZE(Settings):
    descriptor_type: int = 5
    descriptor_size: int = 0
    descriptor_channels: int = 3
    threshold: float = 0.001
    octaves: int = 4
    octave_layers: int = 4
    diffusivity: int = 1
    _LEAST: ClassVar[dict[str, float]] = {"descriptor_size": 0, "descriptor_channels": 1, "octaves": 1, "octave_layers": 1}


@dataclass(frozen=True)
class KAZE(Settings):
    extended: bool = False
    upright: bool = False
    threshold: float = 0.001
    octaves: int = 4
    octave_layers: int = 4
    diffusivity: int = 1
    _LEAST: ClassVar[dict[str, float]] = {"octaves": 1, "octave_layers": 1}


@dataclass(frozen=True)
class MSER(Settings):
    delta: int = 5
    min_area: int = 60
    max_area: int = 14400
    pass_2_only: bool = False


@dataclass(frozen=True)
class ORB(Settings):
    max_features: int = 500
    scale_factor: float = 1.2
    levels: int = 8
    edge_threshold: int = 31
    first_level: int = 0
    wta_k: int = 2
    score_type: int = 0
    patch_size: int = 31
    fast_threshold: int = 20
    _LEAST: ClassVar[dict[str, float]] = {"first_level": 0}


@dataclass(frozen=True)
class Agast(Settings):
    _NAME: ClassVar[str] = "AgastFeatureDetector"
    threshold: int = 10
    nonmax_suppression: bool = True
    kind: int = 3


@dataclass(frozen=True)
class Fast(Settings):
    _NAME: ClassVar[str] = "FastFeatureDetector"
    threshold: int = 10
    nonmax_suppression: bool = True
    kind: int = 2


@dataclass(frozen=True)
class GoodFeatures(Settings):
    _NAME: ClassVar[str] = "GFTTDetector"
    max_features: int = 1000
    quality_level: float = 0.01
    min_distance: float = 1.0
    block_size: int = 3
    harris_detector: bool = False
    k: float = 0.04


@dataclass(frozen=True)
class Clahe(Settings):
    clip_limit: float = 40.0
    tiles: tuple[int, int] = (8, 8)

    def apply(self, planes):
        from gridloom.operators.kernels import clahe

        return clahe(planes, self.clip_limit, self.tiles)


@dataclass(frozen=True)
class Tonemap(Settings):
    gamma: float = 1.0


@dataclass(frozen=True)
class TonemapDrago(Tonemap):
    saturation: float = 1.0
    bias: float = 0.85


@dataclass(frozen=True)
class TonemapMantiuk(Tonemap):
    scale: float = 0.7
    saturation: float = 1.0


@dataclass(frozen=True)
class TonemapReinhard(Tonemap):
    intensity: float = 0.0
    light_adaptation: float = 1.0
    color_adaptation: float = 0.0


def configured(rows: DataFrame, made: type[Settings], name: str = "settings", **changes: Column) -> DataFrame:
    """rows with a struct of `made`'s options: each row's own value where `changes` names a column and that isn't null,
    else the default. A value under its least stops the job, as it would where the settings are made one by one."""
    default, options = made(), []
    if unknown := set(changes) - set(default.options()):
        raise ValueError(f"{made.__name__} has no {', '.join(sorted(unknown))}")
    for field, first in default.options().items():
        kind = "array<int>" if isinstance(first, tuple) else {bool: "boolean", int: "int", float: "double"}[type(first)]
        value = F.array(*[F.lit(v) for v in first]) if isinstance(first, tuple) else F.lit(first)
        if field in changes:
            value = F.coalesce(changes[field].cast(kind), value)
        if field in made._LEAST:
            low = made._LEAST[field]
            value = F.when(value < low, F.raise_error(F.lit(f"{made.__name__}.{field} is at least {low}")).cast(kind)).otherwise(value)
        options.append(value.cast(kind).alias(field))
    return rows.withColumn(name, F.struct(*options))


def get_log_level(spark) -> str:
    """The level of the driver's root logger."""
    return spark._jvm.org.apache.logging.log4j.LogManager.getRootLogger().getLevel().toString()


def set_log_level(spark, level: str) -> str:
    """Set the level and give the one before."""
    before = get_log_level(spark)
    spark.sparkContext.setLogLevel(level)
    return before
