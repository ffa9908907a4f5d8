import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from shoebox.schemas import FOLDERS, MEDIA, timestamp  # noqa: E402
from shoebox.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", "local[8]",
        {
            "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoint")),
            # tiny inputs: interpreting is quicker than compiling every plan
            "spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture
def now():
    return timestamp("2024-07-01 00:00:00")


@pytest.fixture
def make(spark):
    """Build catalogue rows from short dicts."""
    import datetime as dt

    stamp = dt.datetime(2024, 1, 1)

    class Make:
        def folders(self, rows):
            blank = {
                "parent_id": None, "recursive": True, "scan_complete": False, "exclude": [], "include": [],
                "thumbnail_cache_mode": None, "thumbnail_cache_folder": None, "thumbnail_cache_fallback": "disable",
                "created_at": stamp,
            }
            return spark.createDataFrame([tuple({**blank, **r}[n] for n in FOLDERS.names) for r in rows], FOLDERS)

        def media(self, rows):
            blank = {
                "folder_id": 1, "content_hash": "hash", "width": None, "height": None, "format": "png", "file_size": 1,
                "modified_at": stamp, "created_at": stamp, "is_present": True, "missing_since": None,
            }
            full = []
            for r in rows:
                r = {**blank, **r}
                r.setdefault("absolute_path", "/r/" + r.get("relative_path", ""))
                r.setdefault("relative_path", r["absolute_path"][3:])
                full.append(tuple(r[n] for n in MEDIA.names))
            return spark.createDataFrame(full, MEDIA)

    return Make()
