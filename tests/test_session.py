from logloom.session import RUNTIME_CONF, configure, shared_folder, spread


def test_runtime_options_can_be_set_on_a_running_session(spark):
    assert all(spark.conf.isModifiable(key) for key in RUNTIME_CONF)
    assert configure(spark) is spark and all(spark.conf.get(k) == v for k, v in RUNTIME_CONF.items())


def test_shared_folders_are_new_and_below_the_named_one(spark):
    a, b = shared_folder(spark, "x"), shared_folder(spark, "x")
    assert a != b and a.startswith(spark.conf.get("spark.checkpoint.dir"))


def test_spread_only_widens(spark):
    cores = spark.sparkContext.defaultParallelism
    assert spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == cores
    wide = spark.range(0, 100, 1, cores * 2)
    assert spread(wide) is wide
