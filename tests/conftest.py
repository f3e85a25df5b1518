import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tillbook.session import build_session

    session = build_session("tests", "local[8]", 8, shared=f"file://{tmp_path_factory.mktemp('shared')}")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def lib(spark):
    from tillbook.sources import star

    return star.library(spark, SF)
