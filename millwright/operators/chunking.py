"""Sentence- and section-aware chunks.

A document is chunked inside its own row by higher-order functions, so chunking
needs no shuffle and no Python worker; only the finished chunks are exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millwright.functions.common import BLANKS, let, strip, unnest
from millwright.functions.text import CHUNK_SENTENCE_ENDS, sentences
from millwright.session import cut_lineage

CHUNKS = "array<struct<text:string,char_start:int,char_end:int>>"
PAGES_PER_BLOCK = 256
SECTIONED = "array<struct<text:string,char_start:int,char_end:int,section_header:string>>"

# Fixed value: a markdown heading, a numbered heading or an upper-case label at a line start.
SECTION_HEADER = rf"(?md)^(#{{1,3}}|\p{{Nd}}+\.\p{{Nd}}*|[A-Z][A-Z{BLANKS}]{{3,}}:)[{BLANKS}]"
_MARK = "\x01\x02\x01"
_LINE = "^([^\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]*)"


def _find(needle: Column, text: Column, offset: Column) -> Column:
    """0-based position of the needle at or after the offset, -1 when absent.

    Absence is the common case and ``contains`` settles it several times faster.
    """
    rest = F.substring(text, offset + 1, F.length(text))
    return F.when(F.contains(rest, needle), F.call_function("locate", needle, text, offset + 1) - 1).otherwise(-1)


def _find_ahead(needle: Column, rest: Column) -> Column:
    """0-based position of the needle in what is left of a text, -1 when absent."""
    return F.when(F.contains(rest, needle), F.call_function("locate", needle, rest) - 1).otherwise(-1)


def _rest_from(rest: Column, place: Column) -> Column:
    return F.substring(rest, place + 1, F.lit(2147483647))


def sentence_chunks(text: Column, size: int = 800, overlap: int = 100, offsets: bool = True) -> Column:
    """Greedy packs of sentences of already stripped ``text`` with their offsets (null unless asked for).

    Looking a pack up reads what is left of the text after the last one found, which is carried along, so that nothing
    ahead of it is counted again; packing alone reads the text once.

    A pack is closed when the next sentence would take it past ``size``; the next
    one starts with the last ``overlap`` characters of the closed one.  A single
    longer sentence stays whole.  A pack that is no literal part of the text (its
    overlap breaks it) is placed at the running offset.
    """
    return let(text, lambda body: _sentence_chunks(body, size, overlap, offsets))


def _sentence_chunks(text: Column, size: int, overlap: int, offsets: bool) -> Column:
    # what is left of the text is carried only where packs are looked up
    start = F.struct(
        F.lit("").alias("pack"), F.lit(0).alias("offset"), (text if offsets else F.lit("")).alias("rest"), F.array().cast(CHUNKS).alias("done")
    )

    def located(state: Column, body) -> Column:
        """``body(found)`` with the pack's place in what is left, or -1, looked up once."""
        if not offsets:
            return body(F.lit(-1))
        return let(_find_ahead(state["pack"], state["rest"]), body)

    def placed(state: Column, found: Column) -> Column:
        if not offsets:
            nowhere = F.lit(None).cast("int")
            return F.struct(state["pack"].alias("text"), nowhere.alias("char_start"), nowhere.alias("char_end"))
        at = (state["offset"] + F.greatest(found, F.lit(0))).cast("int")
        return F.struct(
            state["pack"].alias("text"), at.alias("char_start"), (at + F.length(state["pack"])).alias("char_end")
        )

    def closed(state: Column, sentence: Column) -> Column:
        tail = strip(F.right(state["pack"], F.lit(overlap))) if overlap > 0 else F.lit("")
        return located(
            state,
            lambda found: F.struct(
                F.concat(F.when(tail == "", "").otherwise(F.concat(tail, F.lit(" "))), sentence).alias("pack"),
                F.when(found < 0, state["offset"]).otherwise(state["offset"] + found + F.length(state["pack"])).cast("int").alias("offset"),
                F.when(found < 0, state["rest"]).otherwise(_rest_from(state["rest"], found + F.length(state["pack"]))).alias("rest"),
                F.array_append(state["done"], placed(state, found)).alias("done"),
            ),
        )

    def grown(state: Column, sentence: Column) -> Column:
        return F.struct(
            F.when(state["pack"] == "", sentence).otherwise(F.concat_ws(" ", state["pack"], sentence)).alias("pack"),
            state["offset"].alias("offset"),
            state["rest"].alias("rest"),
            state["done"].alias("done"),
        )

    def step(state: Column, sentence: Column) -> Column:
        full = (state["pack"] != "") & (F.length(state["pack"]) + 1 + F.length(sentence) > size)
        return F.when(full, closed(state, sentence)).otherwise(grown(state, sentence))

    def finish(state: Column) -> Column:
        return F.when(state["pack"] == "", state["done"]).otherwise(
            located(state, lambda found: F.array_append(state["done"], placed(state, found)))
        )

    return F.aggregate(sentences(text, CHUNK_SENTENCE_ENDS), start, step, finish)


def _sections(text: Column) -> Column:
    """Heading and body of every section; text ahead of the first heading is left out."""
    parts = F.split(F.regexp_replace(text, SECTION_HEADER, _MARK + "$0"), _MARK)
    bodies = F.transform(F.slice(parts, F.lit(2), F.size(parts)), strip)
    return F.transform(
        bodies, lambda body: F.struct(strip(F.regexp_extract(body, _LINE, 1)).alias("header"), body.alias("body"))
    )


def _without_first(text: Column, needle: Column) -> Column:
    return let(
        _find(needle, text, F.lit(0)),
        lambda at: F.when(at < 0, text).otherwise(
            F.concat(F.substring(text, F.lit(1), at), F.substring(text, at + F.length(needle) + 1, F.length(text)))
        ),
    )


def section_chunks(text: Column, size: int = 800, overlap: int = 100, offsets: bool = True) -> Column:
    """Chunks of each section of stripped ``text``, headed by the section's first line.

    With fewer than two sections the whole text is packed without headings.
    """
    return let(text, lambda body: _section_chunks(body, size, overlap, offsets))


def _section_chunks(text: Column, size: int, overlap: int, offsets: bool) -> Column:

    def of_section(section: Column) -> Column:
        return F.transform(
            sentence_chunks(section["body"], size, overlap, offsets=False),
            lambda c: F.struct(
                section["header"].alias("header"),
                F.when((section["header"] != "") & ~F.startswith(c["text"], section["header"]),
                       F.concat(section["header"], F.lit("\n"), c["text"])).otherwise(c["text"]).alias("text"),
            ),
        )

    def place(state: Column, chunk: Column) -> Column:
        bare = strip(_without_first(chunk["text"], F.concat(chunk["header"], F.lit("\n"))))
        return let(bare, lambda plain: let(where(state, chunk, plain), lambda at: noted(state, chunk, plain, at)))

    def where(state: Column, chunk: Column, plain: Column) -> Column:
        """The place in what is left of the text."""
        def or_header(direct: Column) -> Column:
            by_header = F.greatest(_find_ahead(chunk["header"], state["rest"]), F.lit(0))
            return F.when(direct >= 0, direct).otherwise(by_header).cast("int")

        return let(_find_ahead(plain, state["rest"]), or_header)

    def noted(state: Column, chunk: Column, plain: Column, place: Column) -> Column:
        at, past = (state["offset"] + place).cast("int"), (place + F.length(plain)).cast("int")
        end = (state["offset"] + past).cast("int")
        return F.struct(
            end.alias("offset"),
            _rest_from(state["rest"], past).alias("rest"),
            F.array_append(
                state["done"],
                F.struct(chunk["text"].alias("text"), at.alias("char_start"), end.alias("char_end"),
                         chunk["header"].alias("section_header")),
            ).alias("done"),
        )

    def by_section(sections: Column) -> Column:
        start = F.struct(F.lit(0).alias("offset"), text.alias("rest"), F.array().cast(SECTIONED).alias("done"))
        packed = F.flatten(F.transform(sections, of_section))
        nowhere = F.lit(None).cast("int")
        found = F.aggregate(packed, start, place, lambda s: s["done"]) if offsets else F.transform(
            packed,
            lambda c: F.struct(c["text"].alias("text"), nowhere.alias("char_start"), nowhere.alias("char_end"), c["header"].alias("section_header")),
        )
        return F.when(F.size(sections) >= 2, found).otherwise(_plain(text, size, overlap, offsets))

    return let(_sections(text), by_section)


def _plain(text: Column, size: int, overlap: int, offsets: bool) -> Column:
    return F.transform(
        sentence_chunks(text, size, overlap, offsets),
        lambda c: F.struct(
            c["text"].alias("text"), c["char_start"].alias("char_start"), c["char_end"].alias("char_end"),
            F.lit(None).cast("string").alias("section_header"),
        ),
    )


def smart_chunks(text: Column, size: int = 800, overlap: int = 100, shortest: int = 50, offsets: bool = True) -> Column:
    """Section chunks where the raw text has a heading, sentence chunks elsewhere; tiny ones dropped."""
    chunks = let(
        F.struct(text.rlike(SECTION_HEADER).alias("headed"), strip(text).alias("body")),
        lambda doc: F.when(doc["headed"], section_chunks(doc["body"], size, overlap, offsets)).otherwise(
            _plain(doc["body"], size, overlap, offsets)
        ),
    )
    return F.filter(chunks, lambda c: F.length(strip(c["text"])) >= shortest)


def chunk_id(document_id: Column, chunk_index: Column) -> Column:
    """Same document and position, same id: writing a document again replaces its chunks."""
    return F.sha2(F.concat_ws("|", document_id, chunk_index.cast("string")).cast("binary"), 256)


def explode_chunks(documents: DataFrame, chunks: Column, document_id: str = "document_id") -> DataFrame:
    """One row per chunk, numbered from 0 within its row of ``documents``."""
    kept = [c for c in documents.columns if c != document_id]
    arrays = documents.withColumn("_chunks", chunks)
    exploded = unnest(
        arrays, [F.col(document_id).alias("document_id"), *kept, F.size("_chunks").alias("total_chunks")],
        F.col("_chunks"), "_chunk", "chunk_index",
    )
    return exploded.select("document_id", *kept, "chunk_index", "total_chunks", "_chunk.*")


def document_chunks(documents: DataFrame, size: int = 800, overlap: int = 100, offsets: bool = True) -> DataFrame:
    """Chunks of ``documents(document_id, text)``; without ``offsets`` they are not looked up in the text."""
    rows = documents.select("document_id", F.col("text").alias("_text"))
    return explode_chunks(rows, smart_chunks(F.col("_text"), size, overlap, offsets=offsets)).drop("_text").withColumn(
        "chunk_id", chunk_id(F.col("document_id"), F.col("chunk_index"))
    )


def paged_chunks(pages: DataFrame, size: int = 800, overlap: int = 100) -> DataFrame:
    """Chunks of ``pages(document_id, page_number, text)`` numbered across a document's pages.

    Pages are counted in blocks, so that a document of very many pages is
    numbered by many tasks; only block totals are summed per document.
    """
    per_page = cut_lineage(
        pages.select("document_id", "page_number", smart_chunks(F.col("text"), size, overlap).alias("chunks"))
    ).withColumns({"n": F.size("chunks"), "block": F.floor(F.col("page_number") / PAGES_PER_BLOCK)})
    blocks = per_page.groupBy("document_id", "block").agg(F.sum("n").alias("n"))
    by_block = W.partitionBy("document_id").orderBy("block")
    starts = blocks.select(
        "document_id", "block", (F.sum("n").over(by_block) - F.col("n")).alias("start"),
        F.sum("n").over(W.partitionBy("document_id")).alias("total_chunks"),
    )
    by_page = W.partitionBy("document_id", "block").orderBy("page_number")
    numbered = per_page.join(starts, ["document_id", "block"]).withColumn(
        "before", F.col("start") + F.sum("n").over(by_page) - F.col("n")
    )
    spread = unnest(numbered, ["document_id", "page_number", "before", "total_chunks"], F.col("chunks"), "chunk", "i")
    return spread.select(
        "document_id", "page_number", (F.col("before") + F.col("i")).cast("long").alias("chunk_index"), "total_chunks", "chunk.*"
    )


def with_context(chunks: DataFrame, document_name: Column, metadata: Column | None = None) -> DataFrame:
    """Name the document in the chunk's text and metadata."""
    own = metadata if metadata is not None else F.create_map().cast("map<string,string>")
    added = F.create_map(
        F.lit("doc_name"), document_name, F.lit("filename"), document_name,
        F.lit("doc_id"), F.col("document_id"), F.lit("document_id"), F.col("document_id"),
    )
    return chunks.withColumn("metadata", F.map_concat(own, added)).withColumn(
        "text", F.concat(F.lit("Document: "), document_name, F.lit("\n"), F.col("text"))
    )
