import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from compare import session

    return session(4)


@pytest.fixture(scope="session")
def tables(spark):
    from baitline.plans.session import prepare
    from baitline.plans.views import Tables

    return Tables(prepare(spark), "/root/testdata/sf0.001")
