import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from leadforge.session import apply_defaults

    s = (SparkSession.builder.master("local[4]").appName("leadforge-tests")
         .config("spark.sql.shuffle.partitions", "4")
         .config("spark.driver.memory", "4g")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="leadforge-test-ckpt-"))
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    apply_defaults(s)
    yield s
    s.stop()


def one(spark, col, **values):
    """Evaluate a Column expression over a single literal row."""
    from pyspark.sql import functions as F
    cols = [F.lit(v).cast("string").alias(k) if not isinstance(v, dict)
            else F.create_map(*[F.lit(x) for kv in v.items() for x in kv]).alias(k) for k, v in values.items()]
    return spark.range(1).select(*cols).select(col.alias("out")).first()["out"]
