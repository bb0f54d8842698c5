"""What near-dedup leaves on disk while it runs: its shuffle files go with the step that made them."""

import os
import random

from lodespark.llm import near_dedup


def shuffled(spark) -> int:
    """Bytes of shuffle files."""
    at = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return sum(os.path.getsize(os.path.join(here, f)) for x in at for here, _, files in os.walk(x.getPath()) for f in files if f.startswith("shuffle_") and f.endswith(".data"))


def test_shuffle_files_go_with_their_step(spark):
    rnd = random.Random(2)
    texts = [" ".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=60)) for _ in range(300)]
    texts += [t + " end" for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    docs.count()
    before = shuffled(spark)
    found = near_dedup.near_duplicates(docs)
    left = shuffled(spark) - before
    assert found.where("kept").count() == 300
    assert left < 1 << 20, left
