from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millwright.functions import dates, scoring
from millwright.functions import text as tx
from millwright.functions.common import exact_round, whole_days
from millwright.operators import chunking as ch
from millwright.sources import files as fl


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("r")).first()["r"]


def test_exact_round_is_binary_half_even(spark):
    values = [2.675, 10.155, 0.125, 0.375, 1.005, 2.5, 1e-9, 123456.785]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(exact_round(F.col("v")).alias("r")).collect()
    assert [r["r"] for r in rows] == [round(v, 2) for v in values]


def test_whole_days_is_elapsed_time(spark):
    df = spark.sql("select timestamp'2024-01-01 23:00:00' a, timestamp'2024-01-02 01:00:00' b")
    assert df.select(whole_days(F.col("b"), F.col("a")).alias("d"), whole_days(F.col("a"), F.col("b")).alias("e")).first() == (0, -1)


@pytest.mark.parametrize(
    "text, strict, wide",
    [
        ("Pump P-201 feeds V-101A and p-202; P-201 again", ["P-201", "V-101A"], ["P-201", "V-101A", "P-202"]),
        ("XXXX-99 TK-12345 éP-101 P-101é P-1012B", ["P-1012B"], ["XXXX-99", "TK-12345", "P-1012B"]),
        ("", [], []),
    ],
)
def test_tags(spark, text, strict, wide):
    assert one(spark, text, tx.strict_tags) == strict
    assert one(spark, text, tx.wide_tags) == wide


def test_sentences_and_language(spark):
    assert one(spark, "One. Two?  Three! पहला। दूसरा", lambda c: tx.sentences(c)) == ["One.", "Two?", "Three!", "पहला। दूसरा"]
    assert one(spark, "पहला। दूसरा", lambda c: tx.sentences(c, tx.CHUNK_SENTENCE_ENDS)) == ["पहला।", "दूसरा"]
    assert one(spark, "पंप P-201 में रिसाव", tx.language) == "hi"
    assert one(spark, "", tx.language) == "en"


def test_clean_text(spark):
    assert one(spark, "  a\x00b \r\n\n\n\n\t c   d e ", tx.clean_text) == "ab\n\nc d\ne"


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Last reviewed: 2022-01-01", datetime(2022, 1, 1)),
        ("Revision date 5/3/2024", datetime(2024, 3, 5)),
        ("reviewed 25/12/2023", datetime(2023, 12, 25)),
        ("reviewed 12/25/2023", datetime(2023, 12, 25)),
        ("Validated 05/03/24", datetime(2024, 3, 5)),
        ("review date: Jan 2024", datetime(2024, 1, 1)),
        ("review date: sept 2024", None),
        ("rev 2021", datetime(2021, 1, 1)),
        ("Last reviewed soon. reviewed sept 2024, later reviewed 2020-02-02", None),
        ("no date here", None),
    ],
)
def test_review_dates(spark, text, expected):
    assert one(spark, text, lambda c: dates.stated_review_date(c).cast("timestamp_ntz")) == expected


def test_chat_message_is_cut_at_a_sentence(spark):
    long = ("**Bold** start. " + "word " * 150 + "end. ") + "tail " * 300
    out = one(spark, long, tx.chat_message)
    assert out.startswith("*Bold* start.") and out.endswith("end.\n[Reply FULL for complete answer]")


def test_verdict_fields(spark):
    text = "status: [COMPLIANT]\nFINDINGS: a\nb\nRECOMMENDATION:"
    assert one(spark, text, lambda c: tx.labeled_field(c, "STATUS", "x")) == "COMPLIANT"
    assert one(spark, text, lambda c: tx.labeled_field(c, "FINDINGS", "x")) == "a\nb"
    assert one(spark, text, lambda c: tx.labeled_field(c, "RECOMMENDATION", "none")) == "none"


def test_upload_rules(spark):
    verdict = lambda name, size: spark.createDataFrame([(name, size)], "n string, s long").select(
        tx.upload_verdict(F.col("n"), F.col("s")).alias("r")).first()["r"]
    assert verdict("plan.PDF", 10) == ""
    assert verdict("a.pdf", 51 * 1024 * 1024) == "File exceeds maximum size of 50 MB"
    assert verdict(".pdf", 1) == "Unsupported file type: unknown"
    assert one(spark, "dir/a b#é.pdf", tx.secure_filename) == "a_bé.pdf"
    assert one(spark, "###", tx.secure_filename) == "upload.bin"


def test_answer_risk(spark):
    df = spark.createDataFrame([(39, 90, True), (59, 90, True), (84, 90, True), (90, 96, True), (90, 49, True), (90, 96, False)], "f int, c int, s boolean")
    risks = [r[0] for r in df.select(scoring.answer_risk(F.col("f"), F.col("c"), F.col("s"))).collect()]
    assert risks == ["Critical", "High", "Moderate", "Low", "Critical", "Critical"]


# ---- chunks: an independent packing loop over a few texts --------------------
def pack(sentences, size, overlap):
    packs, current = [], ""
    for s in sentences:
        if current and len(current) + 1 + len(s) > size:
            packs.append(current)
            tail = current[-overlap:].strip() if overlap else ""
            current = f"{tail} {s}" if tail else s
        else:
            current = f"{current} {s}" if current else s
    return packs + ([current] if current else [])


@pytest.mark.parametrize("size, overlap", [(30, 8), (30, 0), (12, 50)])
def test_sentence_chunks(spark, size, overlap):
    parts = ["First point made.", "Second one here!", "A third that is quite a lot longer than the size.", "End?"]
    chunks = one(spark, "  ".join(parts), lambda c: ch.sentence_chunks(c, size, overlap))
    assert [c["text"] for c in chunks] == pack(parts, size, overlap)
    assert chunks[0]["char_start"] == 0 and chunks[0]["char_end"] == len(chunks[0]["text"])


def test_offsets_of_literal_and_broken_packs(spark):
    chunks = one(spark, "Alpha one.  Beta two. Gamma three.", lambda c: ch.sentence_chunks(c, 12, 4))
    assert [(c["text"], c["char_start"], c["char_end"]) for c in chunks] == [
        ("Alpha one.", 0, 10), ("one. Beta two.", 10, 24), ("two. Gamma three.", 17, 34),
    ]


def test_sections_drop_the_preamble_and_repeat_headings(spark):
    text = "Preamble goes away.\n# Scope\nPumps are covered here. More on pumps.\nSAFETY NOTES: Wear gloves."
    chunks = one(spark, text, lambda c: ch.section_chunks(c, 30, 0))
    assert [c["text"] for c in chunks] == [
        "# Scope\nPumps are covered here.", "# Scope\nMore on pumps.", "SAFETY NOTES: Wear gloves.",
    ]
    assert chunks[1]["char_start"] == text.index("More on pumps.")


def test_single_section_keeps_the_whole_text(spark):
    chunks = one(spark, "Intro stays.\n# Only\nBody text.", lambda c: ch.section_chunks(c))
    assert len(chunks) == 1 and chunks[0]["text"].startswith("Intro stays.") and chunks[0]["section_header"] is None


def test_tiny_chunks_are_dropped(spark):
    assert one(spark, "Too short.", lambda c: ch.smart_chunks(c)) == []


def test_mail_and_containers(spark, tmp_path):
    import zipfile

    (tmp_path / "a.eml").write_bytes(b"From: x@y.z\r\nTo: q@y.z\r\nSubject: Shift\r\nContent-Type: text/plain\r\n\r\nPump P-201  leaks.\r\n")
    with zipfile.ZipFile(tmp_path / "b.bin", "w") as z:
        z.writestr("word/document.xml", "<x/>")
    with zipfile.ZipFile(tmp_path / "c.xlsx", "w") as z:
        z.writestr("other.txt", "x")
    (tmp_path / "d.pdf").write_bytes(b"plain words")
    (tmp_path / "e.txt").write_bytes("caf\xe9".encode("latin-1"))
    files = fl.read_files(spark, str(tmp_path)).withColumn("name", F.substring_index("name", "/", -1))
    found = {r["name"]: (r["format"], r["mismatch"]) for r in fl.detect_formats(files).collect()}
    assert found == {"a.eml": ("eml", False), "b.bin": ("docx", False), "c.xlsx": ("xlsx", False), "d.pdf": ("txt", True), "e.txt": ("txt", False)}
    mail = fl.email_text(files.where("name = 'a.eml'")).first()
    assert mail["text"] == "From: x@y.z\nTo: q@y.z\nSubject: Shift\nDate:\nPump P-201 leaks."
    decoded = files.where("name = 'e.txt'").select(fl.decode_text(F.col("content")).alias("d")).first()["d"]
    assert (decoded["text"], decoded["encoding"]) == ("café", "latin-1")


def test_zip_members_are_read_from_the_directory(spark):
    import io
    import zipfile

    def packed(*names, comment=b"", lead=b"", compression=zipfile.ZIP_DEFLATED):
        data = io.BytesIO()
        data.write(lead)
        with zipfile.ZipFile(data, "w", compression) as z:
            for name in names:
                z.writestr(name, "word/document.xml xl/workbook.xml " * 20)
            z.comment = comment
        return data.getvalue()

    word = packed("[Content_Types].xml", "word/document.xml")
    many = packed(*(f"media/{i:05d}-{'x' * 60}.png" for i in range(2000)), "xl/workbook.xml")  # a directory beyond the last 64 KB
    cases = {
        "a.bin": (word, "docx"), "b.bin": (many, "xlsx"), "c.docx": (packed("xl/workbook.xml"), "xlsx"),
        "d.bin": (packed("word/document.xml", comment=b"\xff" * 65535), "docx"),
        "e.bin": (packed("word/document.xml", lead=b"PK\x03\x04 some other bytes \xfe"), "docx"),
        "f.bin": (packed("x/word/document.xml", "word/document.xml.rels", compression=zipfile.ZIP_STORED), "unknown"),
        "g.docx": (packed("other.txt"), "docx"), "h.xlsx": (word[:-10], "xlsx"), "i.bin": (word[:40], "unknown"), "j.bin": (b"PK\x03\x04", "unknown"),
        "k.bin": (b"PK\x05\x06" + bytes(18), "unknown"), "l.bin": (b"PK\x03\x04" + b"PK\x05\x06" + b"\xff" * 18, "unknown"),
    }
    files = spark.createDataFrame([(n, bytearray(c)) for n, (c, _) in cases.items()], "name string, content binary")
    plan = fl.detect_formats(files)
    assert {r["name"]: r["format"] for r in plan.collect()} == {n: f for n, (_, f) in cases.items()}
    assert "InPandas" not in plan._jdf.queryExecution().executedPlan().toString()


def test_valid_tags_are_those_with_a_normal_form_that_is_one(spark):
    cores = ["P-100", "p-100a", "XV-1234B", "ABCD-100", "P-12", "P-12345", "P-100AB", "\u017f-100", "P-\u0661\u0662\u0663", "P 100", "", "-100", "\u00df-100"]
    around = ["", " ", "\n", "\r\n", "\u2028", "\u3000\t", "\u200b", "\x85", "x"]
    values = [a + c + b for c in cores for a in around for b in around] + [None]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    rows = df.select("v", tx.valid_tag(F.col("v")).alias("got"), tx.normal_tag(F.col("v")).rlike(tx.TAG_EXACT).alias("expected")).collect()
    assert not [r for r in rows if r["got"] != r["expected"]]
    assert sum(bool(r["got"]) for r in rows) > 300 and "btrim" not in df.select(tx.valid_tag(F.col("v")))._jdf.queryExecution().toString()
