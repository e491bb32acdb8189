from leadforge.session import DEFAULTS, apply_defaults, checkpoint_dir, scratch_path


def test_existing_settings_are_kept(spark):
    before = spark.conf.get("spark.checkpoint.dir")
    assert checkpoint_dir(spark) == before  # read from the session, never replaced
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    apply_defaults(spark)
    assert spark.conf.get("spark.checkpoint.dir") == before
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
    assert all(spark.conf.get(k) not in (None, "") for k in DEFAULTS)


def test_scratch_paths_live_under_the_checkpoint_folder(spark):
    a, b = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert a != b and a.startswith(spark.conf.get("spark.checkpoint.dir").rstrip("/") + "/x-")
