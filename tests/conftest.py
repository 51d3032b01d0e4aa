import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from kinelake.session import local_session

    return local_session(4, 4, "4g")


@pytest.fixture(scope="session")
def make_series(spark):
    """Recordings with random-walk channels: {(subject, task): length}."""
    import numpy as np
    import pandas as pd

    def build(lengths, channels=("x", "y"), seed=0, smooth=True):
        rng = np.random.default_rng(seed)
        parts = []
        for (s, t), n in lengths.items():
            d = {"subject_id": s, "task": t, "frame_idx": np.arange(n, dtype="int64")}
            for c in channels:
                v = rng.normal(size=n)
                d[c] = np.cumsum(v) if smooth else v
            parts.append(pd.DataFrame(d))
        pdf = pd.concat(parts, ignore_index=True)
        df = spark.createDataFrame(pdf.sample(frac=1.0, random_state=1).astype({"task": "int32"}))
        return df.repartition(3), pdf

    return build
