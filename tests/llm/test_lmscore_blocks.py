"""op6's bigrams lie in files by block, so that each block reads its own bigrams only."""

from __future__ import annotations

import random
from pathlib import Path

from atelier.llm import lmscore


def test_bigrams_lie_in_files_of_their_block(spark, monkeypatch):
    r = random.Random(3)
    rows = [(i, " ".join(f"w{r.randrange(40)}" for _ in range(60))) for i in range(50)] + [(50, None), (51, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    of = {}
    for x in lmscore.bigrams(docs).collect():
        assert 0 <= x.block < lmscore.BLOCKS and of.setdefault((x.a, x.b), x.block) == x.block
    assert set(of.values()) == set(range(lmscore.BLOCKS))
    seen = []
    monkeypatch.setattr(lmscore, "discard", lambda _, *frames: seen.extend(f for df in frames for f in df.inputFiles()))
    lmscore.score(docs).collect()
    folders = {Path(f).parent.name for f in seen if "/bigrams-" in f}
    assert folders == {f"block={k}" for k in range(lmscore.BLOCKS)}
