import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cuelake.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(os.environ.get("CORES", "8"), "tests", **{"spark.sql.shuffle.partitions": "4"})
    session.sparkContext.setLogLevel("ERROR")
    return session


def rows(df, *order):
    """Collected rows as tuples, sorted by the named columns (all by default)."""
    found = [tuple(r) for r in df.collect()]
    names = df.columns
    keys = [names.index(c) for c in order] if order else range(len(names))
    return sorted(found, key=lambda r: [repr(r[k]) if r[k] is None else r[k] for k in keys])


CUE_SCHEMA = "video_id STRING, cue_idx INT, start_ms LONG, dur_ms LONG, text STRING"


def cue_table(spark, videos):
    """{video: [(start s, dur s, text)]} -> cues."""
    data = [
        (v, i, int(round(s * 1000)), int(round(d * 1000)), t)
        for v, cues in videos.items() for i, (s, d, t) in enumerate(cues)
    ]
    return spark.createDataFrame(data, CUE_SCHEMA)
