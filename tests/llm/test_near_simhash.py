"""The SimHash step of the pipeline's near-dedup stage."""

import numpy as np
from foliant.llm import near_dedup, simhash
from pyspark.sql import functions as F


def test_stage_links_by_simhash_where_no_band_is_shared(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(40):  # the last word of 300 differs: similarity 0.993
        words = [f"w{int(x)}" for x in rng.integers(0, 10**6, 300)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:-1], "other"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    keyed = near_dedup._keyed(docs, "doc_id", "text")
    prints = near_dedup.materialize(near_dedup._prints(keyed), "prints")
    found = {r["id"]: r for r in prints.collect()}
    assert all(found[d]["fp"] == simhash.fingerprint(t.encode(), near_dedup.SHINGLE) for d, t in rows)

    bits = lambda a, b: ((found[a]["fp"] ^ found[b]["fp"]) % 2**64).bit_count()
    near = {frozenset((found[2 * i]["node"], found[2 * i + 1]["node"])) for i in range(40) if bits(2 * i, 2 * i + 1) <= simhash.RADIUS}
    alone = near_dedup.materialize(prints.withColumn("bands", F.array("id")), "alone")
    linked = lambda made: {frozenset(r) for r in near_dedup._pairs(keyed, made, near_dedup.LEAST).collect()}
    assert len(near) > 30 and linked(alone) == near
    # texts of one component of fingerprints are links only if their shingles say so
    pairs = {frozenset((found[2 * i]["node"], found[2 * i + 1]["node"])) for i in range(40)}
    assert linked(near_dedup.materialize(alone.withColumn("fp", F.lit(0).cast("long")), "equal")) == pairs
