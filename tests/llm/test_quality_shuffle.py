"""What the pipeline's quality stage moves: labels and metrics, no texts, however many labels there are."""

import random

import pytest

pytest.importorskip("public_tokenizers")

from atelier.llm import quality  # noqa: E402
from atelier.llm.common import setting  # noqa: E402


def shuffled(spark):
    """Bytes that all stages of the session have written to the shuffle so far."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_labelled_texts_stay_where_they_are(spark):
    r = random.Random(3)
    rows = [(i, " ".join(f"{r.getrandbits(40):x}" for _ in range(4000)), "en") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 40_000, 2)] + [(None, 1)], "doc_id long, quality int")
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "64k", "10485760"):  # the labels are too many for a broadcast
        before = shuffled(spark)
        kept = quality.keep_good(docs, labels)
        assert {x.doc_id for x in kept.collect()} == set(range(200))
    assert shuffled(spark) - before < sum(len(t) for _, t, _ in rows) / 10
