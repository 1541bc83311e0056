"""What the driver holds after an operator's run."""

from __future__ import annotations

import gc
import time

from sentrilake.llm.scratch import Scratch


def test_a_run_gives_back_what_the_driver_held(spark):
    jvm = spark.sparkContext._jvm
    with Scratch(spark) as scratch:
        assert scratch.cut(spark.range(5).toDF("n")).count() == 5
        held = jvm.java.util.ArrayList()
        reference = jvm.java.lang.ref.WeakReference(held)
        del held
        gc.collect()
        time.sleep(2)  # a thread of the gateway lets go of it
    assert reference.get() is None
