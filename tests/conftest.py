import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"  # for the workers


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def image(spark):
    """Builds a raster of one image from an array [..., y, x]."""
    import numpy as np

    from gridloom.plans.engine import to_frame
    from gridloom.raster import DIMS, ID, Raster

    def build(array, image_id: int = 0):
        a = np.asarray(array, float)
        frame = to_frame(a, DIMS[: a.ndim])
        frame.insert(0, ID, image_id)
        kinds = ", ".join([f"{ID} long", *(f"{d} int" for d in DIMS[: a.ndim]), "v double"])
        return Raster(spark.createDataFrame(frame, kinds), a.shape[::-1])

    return build


@pytest.fixture(scope="session")
def array():
    """The array of a raster of one image."""
    from gridloom.plans.engine import to_array

    return lambda r: to_array(r.df.toPandas(), r.dims, r.sizes, r.value)
