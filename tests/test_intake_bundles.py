"""Intake files hold many documents each and give them back unchanged."""

from pathlib import Path

from millwright.plans import streaming as st
from millwright.streaming import jobs


def test_files_are_fewer_than_documents(spark, tmp_path):
    texts = ["", "two\nlines\r\n", 'quotes " and \\ \t', "नमस्ते \x1e", "\n\n", None]
    rows = [(f"DOC-{i}", texts[i % len(texts)]) for i in range(250)]
    st.bundled_files(spark.createDataFrame(rows, "id string, text string").coalesce(1), str(tmp_path / "files"))
    assert len(list(Path(tmp_path / "files").glob("part-*"))) == 3
    files = jobs.arriving_files(spark, str(tmp_path / "files"))
    got = []
    run = files.writeStream.foreachBatch(lambda batch, _: got.extend(map(tuple, st.bundled_documents(batch).collect())))
    run.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(got) == sorted((key, text or "") for key, text in rows)
