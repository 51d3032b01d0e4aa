"""Dataset configuration: channels, tasks and cohort definitions.

A dataset is described by a dict (or a YAML file with the same keys); nothing else in the package
knows channel names by heart.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import types as T

SAMPLING_RATE = 50.0

# The three sensors and six axes of the motion log, in file order.
SENSORS = {"Head": "head", "LeftHand": "left_hand", "RightHand": "right_hand"}
AXES = ["pos_x", "pos_y", "pos_z", "rot_x", "rot_y", "rot_z"]
CHANNELS = [f"{prefix}_{axis}" for prefix in SENSORS.values() for axis in AXES]
RAW_NAMES = {
    f"{prefix}_{axis}": f"{letter}{axis[:3].title()}{axis[-1].upper()}"
    for letter, prefix in zip("HLR", SENSORS.values())
    for axis in AXES
}

# Functional angle pairs (3 sensors) and anatomical pairs (8 sensors).
FUNCTIONAL_PAIRS = {
    "left_reach": ("Head", "LeftHand"),
    "right_reach": ("Head", "RightHand"),
    "bilateral": ("LeftHand", "RightHand"),
}
ANATOMICAL_PAIRS = {
    "spine_flexion": ("Back", "Head"),
    "shoulder_left": ("Back", "LeftHand"),
    "shoulder_right": ("Back", "RightHand"),
    "hip_left": ("Back", "LeftHip"),
    "hip_right": ("Back", "RightHip"),
    "knee_left": ("LeftHip", "LeftKnee"),
    "knee_right": ("RightHip", "RightKnee"),
}

RECORDING = ["subject_id", "task"]


def rotation_channels(channels: list[str]) -> list[str]:
    return [c for c in channels if "rot" in c]


@dataclass(frozen=True)
class DatasetConfig:
    name: str
    sampling_rate: float
    channels: list[str]
    tasks: dict[int, str]
    paradigms: dict[int, dict]
    timestamp_column: str = "TimeElapsed"
    metadata_file: str | None = None
    exclude_subjects: dict[str, list[str]] = field(default_factory=dict)

    def frame_schema(self) -> T.StructType:
        lead = [
            T.StructField("subject_id", T.StringType()),
            T.StructField("task", T.IntegerType()),
            T.StructField("grp", T.StringType()),
            T.StructField("frame_idx", T.LongType()),
            T.StructField("t_s", T.DoubleType()),
        ]
        return T.StructType(lead + [T.StructField(c, T.DoubleType()) for c in self.channels])

    def paradigm(self, paradigm_id: int) -> dict:
        if paradigm_id not in self.paradigms:
            raise ValueError(f"unknown paradigm {paradigm_id}; have {sorted(self.paradigms)}")
        return self.paradigms[paradigm_id]

    def paradigm_type(self, paradigm_id: int) -> str:
        """'multilabel' when the definition lists label filters, else 'binary'."""
        spec = self.paradigm(paradigm_id)
        return "multilabel" if "labels" in spec or spec.get("type") == "multilabel" else "binary"


def dataset_config(source: str | Path | dict) -> DatasetConfig:
    """Read a config dict or YAML file; task and paradigm keys become ints."""
    if not isinstance(source, dict):
        import yaml

        source = yaml.safe_load(Path(source).read_text(encoding="utf-8"))
    return DatasetConfig(
        name=source["name"],
        sampling_rate=float(source.get("sampling_rate", SAMPLING_RATE)),
        channels=list(source["channels"]),
        tasks={int(k): v for k, v in source["tasks"].items()},
        paradigms={int(k): v for k, v in source["paradigms"].items()},
        timestamp_column=source.get("timestamp_column", "TimeElapsed"),
        metadata_file=source.get("metadata_file"),
        exclude_subjects={k: list(v or []) for k, v in (source.get("exclude_subjects") or {}).items()},
    )


# The reshape methods and the ones a hidden-state model cannot take.
RESHAPE_METHODS = ["truncate", "pad", "sliding_window", "variable_length", "phase_shift", "dtw"]
HMM_FORBIDDEN = ["dtw", "pad"]


def check_method(model: str, method: str, source_rate: float, target_rate: float | None) -> list[str]:
    """Validate a (model, method) choice; returns the ordered transform names to run."""
    if method not in RESHAPE_METHODS:
        raise ValueError(f"unknown reshape method {method!r}")
    if model in ("hmm", "hsmm") and method in HMM_FORBIDDEN:
        raise ValueError(f"{method!r} cannot feed a hidden-state model")
    resample = target_rate is not None and target_rate < source_rate
    return (["resample"] if resample else []) + [method]
