"""Bytes that a run shuffles."""


def shuffled(spark, run) -> int:
    context = spark.sparkContext
    jvm, sc = context._jvm, context._jsc.sc()

    def total() -> int:
        sc.listenerBus().waitUntilEmpty()
        stages = sc.statusStore().stageList(None, False, False, context._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = total()
    run()
    return total() - before
