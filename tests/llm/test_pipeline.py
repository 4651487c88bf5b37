"""Every stage of the corpus pipeline against plain versions of its operator."""

from collections import Counter

from test_decontaminate import plain as plain_contamination
from test_linededup import plain as plain_lines
from test_minhash import plain_roots
from test_simhash import plain_fingerprint, plain_groups

import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_stages_one_after_another(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    frames = {}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / str(number)))
        frames[name] = (docs, spark.read.parquet(str(tmp_path / str(number))))
        docs = frames[name][1]
        if number < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == frames[name][0].columns

    before, after = frames["quality classifier"]
    labels = {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = {r.doc_id for r in after.collect()}
    assert set(rows_of(after)) <= set(rows_of(before))
    clean, poor = ([i in kept for i, r in labels.items() if r.quality == q and r.toxic <= 1 - q] for q in (1, 0))
    assert sum(clean) >= 0.97 * len(clean) and sum(poor) <= 0.2 * len(poor)

    before, after = ({r.doc_id: r for r in x.collect()} for x in frames["line dedup"])
    ids = sorted(before)
    for i, (_, _, text, _) in zip(ids, plain_lines([before[i].text for i in ids], 10)):
        assert (after[i].text, after[i].n_chars, after[i].source) == (text, len(text), before[i].source)

    before, after = (sorted(x.collect()) for x in frames["SimHash near-dedup"])
    ids = [r.doc_id for r in before]
    links = [(ids[n], ids[root]) for n, root in enumerate(plain_groups([plain_fingerprint(r.text) for r in before]))]
    links += plain_roots({r.doc_id: r.text for r in before}, 5).items()
    least = {i: i for i in ids}
    while any(least[a] != least[b] for a, b in links):
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    assert after == [r for r in before if least[r.doc_id] == r.doc_id]

    before, after = (sorted(x.collect()) for x in frames["benchmark decontamination"])
    items = [tuple(r)[:2] for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    hits = plain_contamination([(r.doc_id, r.text) for r in before], items)
    assert after == [r for r, (_, hit, _, _) in zip(before, hits) if not hit]

    before, after = (x.collect() for x in frames["best-fit packing"])
    total, used = Counter(), Counter()
    for r in after:
        total[r.doc_id] += r.length
        used[r.bin_id] += r.length
        assert r.bin_offset + r.length <= r.bin_size
    assert total == Counter({r.doc_id: len((r.text or "").encode().split()) + 1 for r in before})
    assert all(used[r.bin_id] <= r.bin_size for r in after)


def test_run_equals_its_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
    got = corpus_pipeline.run(spark, FOLDER)
    assert got.columns == docs.columns and Counter(rows_of(got)) == Counter(rows_of(docs))
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "line dedup", "SimHash near-dedup", "benchmark decontamination", "best-fit packing"]


def test_stages_survive_empty_and_odd_documents(spark, tmp_path):
    layout = "doc_id long, text string, lang string, source string, n_chars long, lines string, target int, digest string"
    odd = [(None, None, None, None, None, "l", 1, "d"), (1, "", "en", "s", 0, "l", 1, "d"), (1, "", "en", "s", 0, "l", 1, "d"),
           (2, "long " * 50_000, None, "s", 5, None, None, None)]
    for part, rows in enumerate((odd, [])):
        docs = spark.createDataFrame(rows, layout)
        for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = str(tmp_path / f"{part}-{number}")
            stage(spark, docs, FOLDER).write.parquet(out)
            docs = spark.read.schema(docs.schema).parquet(out) if number < 4 else spark.read.parquet(out)
        assert docs.count() >= (0 if not rows else 1)
