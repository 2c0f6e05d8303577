"""The features that the toxicity chain gathers are those that tell classes apart best."""

import random

from tessera.llm import toxicity


def test_the_furthest_features_are_gathered(spark):
    rng = random.Random(0)
    rows = []
    for i in range(600):
        bad = i % 3 == 0
        words = [f"w{rng.randrange(60)}" for _ in range(30)] + (["terrible"] if bad else ["lovely"])
        rows.append((i, " ".join(words), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, insult int")
    fitted = [toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "insult"), ["insult"], toxicity.Settings(most_codes=n)) for n in (8, 1 << 20)]  # the two words and their beginnings
    few, every = ({w for x in c.links for w in x.words} for c in fitted)
    assert {"terrible", "lovely"} <= few <= every and len(few) <= 8
