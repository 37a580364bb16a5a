"""Chunking of long documents and of retrieval sources, and lossless reassembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.recognizers import REGISTRY
from .detect import detect

CHUNK_SIZE, OVERLAP = 10_000, 500
RETRIEVAL_CHARS, RETRIEVAL_OVERLAP = 2048, 256
BOUNDARY = {"sentence": r"[.!?]+\s+", "paragraph": r"\n\s*\n"}
_RANGES = "array<struct<start:int,end:int>>"


def fixed_cores(n: Column, size: int, overlap: int) -> Column:
    """Closed form of fixed-size chunks of a text of n > size characters: cores [i*step, min(i*step + size, n))."""
    step = max(1, size - overlap)
    last = F.ceil((n - size) / F.lit(step)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct((i * step).cast("int").alias("start"), F.least(i * step + size, n).cast("int").alias("end")))


def boundary_ends(text: Column, kind: str) -> Column:
    """Ends of segments: the end of each boundary match, and the text's end."""
    hits, gaps = F.regexp_extract_all(text, F.lit(BOUNDARY[kind]), F.lit(0)), F.split(text, BOUNDARY[kind], -1)
    lengths = F.filter(F.zip_with(gaps, hits, lambda g, h: F.length(g) + F.length(h)), lambda x: x.isNotNull())
    none = F.array().cast("array<int>")
    ends = F.aggregate(lengths, F.struct(F.lit(0).alias("at"), none.alias("out")), lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"] + x)).alias("out")), lambda a: a["out"])
    return F.array_distinct(F.concat(ends, F.array(F.length(text))))


def merged_cores(ends: Column, size: int) -> Column:
    """Segments grown into chunks while the chunk stays within `size`; a first segment is always taken, however long."""
    start = F.struct(F.lit(0).alias("from"), F.lit(0).alias("to"), F.array().cast(_RANGES).alias("out"))

    def step(a, e):
        close = (e - a["from"] > size) & (a["to"] > a["from"])
        return F.when(close, F.struct(a["to"].alias("from"), e.alias("to"), F.concat(a["out"], F.array(F.struct(a["from"].alias("start"), a["to"].alias("end")))).alias("out"))).otherwise(F.struct(a["from"].alias("from"), e.alias("to"), a["out"].alias("out")))

    return F.aggregate(ends, start, step, lambda a: F.concat(a["out"], F.array(F.struct(a["from"].alias("start"), a["to"].alias("end")))))


def chunks(docs: DataFrame, strategy: str = "sentence", size: int = CHUNK_SIZE, overlap: int = OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per chunk: id, chunk_index, text, core_start, core_end, start_char, end_char, overlap_start, overlap_end.

    Cores of sentence and paragraph chunks tile the text; the stated overlap is added on the inner sides. Null and empty texts
    have no chunk; a text of at most `size` characters is one.
    """
    text, n = F.col(text_col), F.length(text_col)
    one = F.array(F.struct(F.lit(0).alias("start"), n.alias("end")))
    cores = fixed_cores(n, size, overlap) if strategy == "fixed" else merged_cores(boundary_ends(text, strategy), size)
    rows = docs.filter(n > 0).select(id_col, text_col, F.posexplode(F.when(n <= size, one).otherwise(cores)).alias("chunk_index", "c"), n.alias("__n"))
    rows = rows.select("*", F.col("c.start").alias("core_start"), F.col("c.end").alias("core_end"))
    first, last = F.col("chunk_index") == 0, F.col("core_end") >= F.col("__n")
    start = F.when(first, F.col("core_start")).otherwise(F.greatest(F.lit(0), F.col("core_start") - overlap))
    end = F.when(last, F.col("core_end")).otherwise(F.least(F.col("__n"), F.col("core_end") + overlap))
    rows = rows.withColumn("start_char", start).withColumn("end_char", end)
    return rows.select(
        id_col, "chunk_index", F.substring(text, F.col("start_char") + 1, F.col("end_char") - F.col("start_char")).alias("text"), "core_start", "core_end", "start_char", "end_char",
        (F.col("core_start") - F.col("start_char")).alias("overlap_start"), (F.col("end_char") - F.col("core_end")).alias("overlap_end"),
    )


def segments(docs: DataFrame, strategy: str, size: int = CHUNK_SIZE, overlap: int = OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, segment, start, end) before merging."""
    text, n = F.col(text_col), F.length(text_col)
    if strategy == "fixed":
        at = F.transform(F.sequence(F.lit(0), n - 1, F.lit(max(1, size - overlap))), lambda i: F.struct(i.alias("start"), F.least(i + size, n).alias("end")))
        return docs.filter(n > 0).select(id_col, F.posexplode(at).alias("segment", "s")).select(id_col, "segment", "s.*")
    ends = docs.filter(n > 0).select(id_col, boundary_ends(text, strategy).alias("e"))
    pairs = F.transform("e", lambda x, i: F.struct(F.when(i == 0, 0).otherwise(F.element_at("e", i)).alias("start"), x.alias("end")))
    return ends.select(id_col, F.posexplode(pairs).alias("segment", "s")).select(id_col, "segment", "s.*")


def reassemble(parts: DataFrame, id_col: str = "doc_id", order_col: str = "chunk_index", text_col: str = "text", joiner: str = "") -> DataFrame:
    """One text per document from its parts in order."""
    return parts.groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order_col, text_col))), lambda x: x[text_col]), joiner).alias(text_col))


def core_text() -> Column:
    """A chunk's text without its overlaps."""
    return F.substring(F.col("text"), F.col("overlap_start") + 1, F.col("core_end") - F.col("core_start"))


def safe_cut(types: list[str]) -> str:
    """What no match of the types' patterns holds: white space, or, where a pattern allows single blanks, other white space and two blanks."""
    return r"[\t\n\x0B\f\r]|  " if any(" " in REGISTRY[t].pattern for t in types) else r"[ \t\n\x0B\f\r]"


def detect_in_chunks(docs: DataFrame, types: list[str], size: int = CHUNK_SIZE, overlap: int = OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans found chunk by chunk, with offsets in the document: those that detection on the whole text finds.

    Chunks tile the text. Each edge is moved on, by at most `overlap` characters, behind the first place that no match can reach
    across (`safe_cut`), so no value is cut and none is seen twice; an edge without such a place is left out and its chunk is longer.
    """
    text, n, step = F.col(text_col), F.length(text_col), max(1, size - overlap)

    def edge(i):
        window = F.substring(text, i * step + 1, F.lit(max(1, overlap)))
        return F.transform(F.array(window), lambda w: (i * step + F.length(F.split(w, safe_cut(types), 2)[0]) + 1).cast("int"))[0]

    within = lambda e, i: (e <= (i + 1) * step + max(1, overlap)) & (e < n)
    edges = F.filter(F.transform(F.sequence(F.lit(1), F.ceil(n / F.lit(step)).cast("int")), edge), within)
    rows = docs.filter(n > 0).select(id_col, text_col, F.when(n <= size, F.array().cast("array<int>")).otherwise(edges).alias("__edges"), n.alias("__n"))
    tiles = F.zip_with(F.concat(F.array(F.lit(0)), "__edges"), F.concat("__edges", F.array("__n")), lambda a, b: F.struct(a.alias("start"), b.alias("end")))
    rows = rows.select(id_col, text_col, F.explode(tiles).alias("c"))
    found = detect(rows.select(F.struct(id_col, "c.start").alias("__id"), F.substring(text, F.col("c.start") + 1, F.col("c.end") - F.col("c.start")).alias("text")), types, id_col="__id")
    shifted = lambda c: (F.col(c) + F.col("__id.start")).alias(c)
    return found.select(F.col(f"__id.{id_col}").alias(id_col), "entity_type", "value", shifted("start"), shifted("end"), "confidence")


def sentences(text: Column) -> Column:
    """Split after ., ! or ? where white space follows; stripped text, blanks left out."""
    return F.filter(F.split(F.regexp_replace(F.regexp_replace(text, r"^\s+", ""), r"\s+$", ""), r"(?<=[.!?])\s+", -1), lambda s: F.length(F.trim(s)) > 0)


def retrieval_ranges(lengths: Column, size: int, overlap: int) -> Column:
    """Ranges (first, last) of sentence indices: packed while their lengths stay within `size`; a new chunk begins with the
    closing sentences of the last one whose lengths stay within `overlap`."""

    def kept(to):
        back = F.reverse(F.slice(lengths, F.lit(1), to))
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("chars"), F.lit(True).alias("on"))
        step = lambda a, x: F.when(a["on"] & (a["chars"] + x <= overlap), F.struct((a["n"] + 1).alias("n"), (a["chars"] + x).alias("chars"), F.lit(True).alias("on"))).otherwise(F.struct(a["n"].alias("n"), a["chars"].alias("chars"), F.lit(False).alias("on")))
        return lambda first: F.aggregate(F.slice(back, F.lit(1), F.greatest(F.lit(1), to - first)), start, step)

    init = F.struct(F.lit(0).alias("first"), F.lit(0).alias("chars"), F.array().cast("array<struct<first:int,last:int>>").alias("out"))

    def step(a, i):
        n = F.element_at(lengths, i + 1)
        k = kept(i)(a["first"])
        close = (a["chars"] + n > size) & (i > a["first"])
        closed = F.concat(a["out"], F.array(F.struct(a["first"].alias("first"), (i - 1).alias("last"))))
        return F.when(close, F.struct((i - k["n"]).alias("first"), (n + k["chars"]).alias("chars"), closed.alias("out"))).otherwise(F.struct(a["first"].alias("first"), (a["chars"] + n).alias("chars"), a["out"].alias("out")))

    last = F.size(lengths) - 1
    return F.aggregate(F.sequence(F.lit(0), last), init, step, lambda a: F.concat(a["out"], F.array(F.struct(a["first"].alias("first"), last.alias("last")))))


def retrieval_chunks(docs: DataFrame, size: int = RETRIEVAL_CHARS, overlap: int = RETRIEVAL_OVERLAP, id_col: str = "doc_id", name_col: str | None = None, text_col: str = "text") -> DataFrame:
    """Sentence-packed chunks for retrieval: chunk_id, source_id, source_name, chunk_index, text, estimated_tokens."""
    rows = docs.select(F.col(id_col).alias("source_id"), (F.col(name_col) if name_col else F.col(id_col).cast("string")).alias("source_name"), sentences(F.col(text_col)).alias("s"))
    rows = rows.filter(F.size("s") > 0).withColumn("len", F.transform("s", lambda x: F.length(x)))
    rows = rows.select("source_id", "source_name", "s", F.posexplode(retrieval_ranges(F.col("len"), size, overlap)).alias("chunk_index", "r"))
    text = F.array_join(F.slice("s", F.col("r.first") + 1, F.col("r.last") - F.col("r.first") + 1), " ")
    rows = rows.select("source_id", "source_name", "chunk_index", text.alias("text"))
    return rows.select(chunk_id(F.col("source_id"), F.col("chunk_index"), F.col("text")).alias("chunk_id"), "source_id", "source_name", "chunk_index", "text", estimated_tokens(F.col("text")).alias("estimated_tokens"))


def chunk_id(source: Column, index: Column, text: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", source.cast("string"), index.cast("string"), F.substring(text, 1, 64)), 256), 1, 16)


def estimated_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))
