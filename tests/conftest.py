import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from riskframe.session import checkpoint_dir, get_spark, ship_package
    s = get_spark("local[4]", 4, app_name="riskframe-tests",
                  extra={"spark.sql.adaptive.coalescePartitions.enabled": "true"})
    checkpoint_dir(s)
    ship_package(s)
    yield s
    s.stop()
