"""Chunk places, extracted answers and approximate search against plain versions."""

import random

from pyspark.sql import functions as F

from millwright.operators import chunking as ch
from millwright.operators import trust as tr
from millwright.operators import vectors as vec


def test_places_are_those_of_a_plain_search(spark):
    rnd = random.Random(3)
    words = ["pump", "वाल्व", "leak", "é", "seal", "P-1"]
    texts = [" ".join(" ".join(rnd.choices(words, k=rnd.randrange(1, 9))) + rnd.choice([".", "!", "।"]) for _ in range(n)) for n in (1, 5, 60, 200)]
    texts.append(texts[1] + "  " + texts[1] + "\n" + texts[1])
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for overlap in (0, 10):
        for row in df.select("text", ch.sentence_chunks(F.col("text"), 80, overlap).alias("c")).collect():
            offset = 0
            for c in row["c"]:
                at = row["text"].find(c["text"], offset)
                offset, at = (offset, offset) if at < 0 else (at + len(c["text"]), at)
                assert (c["char_start"], c["char_end"]) == (at, at + len(c["text"]))


def test_answers_score_sentences_in_their_chunk(spark):
    rnd = random.Random(4)
    pool = [f"{' '.join(rnd.choices(['pump', 'seal', 'leak', 'valve', 'oil'], k=3))} {i}." for i in range(12)]
    rows = [(f"q{q}", rank, " ".join(rnd.choices(pool, k=9)), "f") for q in range(8) for rank in range(1, 7)]
    asked = {f"q{q}": rnd.choice(["Is the pump seal safe", "oil", "leak of valve"]) for q in range(8)}
    retrieved = spark.createDataFrame(rows, "question_id string, rank int, text string, filename string")
    found = tr.extractive_answer(spark.createDataFrame(list(asked.items()), "question_id string, question string"), retrieved, most_chars=None)
    for row in found.collect():
        want = {w for w in asked[row["question_id"]].lower().split() if len(w) > 2}
        best = {}
        for _, rank, text, _ in sorted(r for r in rows if r[0] == row["question_id"] and r[1] <= 5):
            for place, s in enumerate(x + "." for x in text.rstrip(".").split(". ")):
                best.setdefault(s, (-len(want & set(s.lower().rstrip(".").split())), rank, place))
        chosen = sorted(best, key=best.get)[:4]
        assert row["answer"].startswith("Based on f: " + " ".join(chosen) + "\n\n")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan[plan.index("Generate"):]  # the question's words come to the chunk before it is split


def test_approximate_search_sends_no_query_to_its_lists_one_by_one(spark):
    rnd = random.Random(6)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(8)]) for i in range(300)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = vec.vector_topk_approx(vectors, vectors, 3, rows_per_cell=20)
    split = vec.vector_topk_approx(vectors, vectors, 3, rows_per_cell=20, broadcast_bytes=300_000)
    assert "CoGroup" not in whole._jdf.queryExecution().optimizedPlan().toString()
    in_order = [sorted(map(tuple, d.select("query_id", "rank", "id", "distance").collect())) for d in (whole, split)]
    assert in_order[0] == in_order[1] and len(in_order[0]) == 900
    # with every list probed the search is exact
    exact = sorted(map(tuple, vec.vector_topk(vectors, vectors, 3).select("query_id", "rank", "id", "distance").collect()))
    every = vec.vector_topk_approx(vectors, vectors, 3, lists=5, probes=5, broadcast_bytes=300_000)
    assert sorted(map(tuple, every.select("query_id", "rank", "id", "distance").collect())) == exact
