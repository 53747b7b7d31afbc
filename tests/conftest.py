import os
import sys

import numpy as np
import pandas as pd
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools"), os.path.join(ROOT, "tests")]

from helpers import SCHEMA, storm  # noqa: E402

from driftline.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests", shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def frames():
    rng = np.random.default_rng(20240615)
    single = storm(rng, "SINGLE", "NA", (12, -60), (0.45, -0.70), wobble=0)
    multi = pd.concat([storm(rng, "A", "NA", (12, -60), (0.4, -0.6)),
                       storm(rng, "B", "WP", (15, 130), (0.5, -0.4), begin="2019-09-01"),
                       storm(rng, "C", "NI", (10, 85), (0.3, 0.2), begin="2019-10-01")])
    dateline = storm(rng, "D", "WP", (18, 175), (0.40, 1.20))
    gapped = storm(rng, "G", "WP", (14, 140), (0.4, -0.5)).drop(index=range(10, 14))
    gapped["SEGMENT_ID"] = np.where(np.arange(len(gapped)) < 10, "G_S01", "G_S02")
    return {"single": single, "multi": multi, "dateline": dateline, "gapped": gapped,
            "clean": pd.concat([multi, dateline])}


@pytest.fixture(scope="session")
def tables(spark, frames):
    return {k: spark.createDataFrame(v, SCHEMA) for k, v in frames.items()}
