"""Line deduplication within one edit by a deletion-neighbourhood join, in built-in functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .common import free_names, row_tag, settle

STEP = 2**31
#: Deletions are spelt out in blocks of at most so many characters.
BLOCK_CHARS = 128
#: Fixed value: what is trimmed from both ends of a line before it is compared.
TRIMMED = " \t\r\x0b\f"


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(place, tag, content, h) of each line with a character left after trimming.

    place is one decimal that sorts by document, then line; a null id sorts last. tag tells rows with equal ids apart.
    """
    text = F.col(text_col).cast("string")
    trimmed = F.transform(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(TRIMMED)))  # before the explode, so that each line is trimmed once
    rows = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(2**63 - 1)).alias("doc"), row_tag(text).alias("tag"), trimmed.alias("lines"))  # the tag too is made once a row, not once a line
    split = rows.select("doc", "tag", F.posexplode("lines").alias("line_no", "content"))
    place = (F.col("doc").cast("decimal(19,0)") * F.lit(STEP).cast("decimal(10,0)") + F.col("line_no").cast("decimal(10,0)")).cast("decimal(38,0)")
    return split.filter("content <> ''").select(place.alias("place"), "tag", "content").withColumn("h", F.xxhash64("content"))


def block_keys(content: Column, n: Column, blocks: int) -> list[tuple[Column, int, Column]]:
    """(key, longer, mid) for the line of `n` characters without each of its blocks.

    Two lines within one edit, the shorter of `size` characters, agree outside one of the `blocks` equal parts of those
    `size` characters when the part before it is counted from the left and the part after it from the right. So a line of n
    characters has keys as the shorter (size n) and as the longer (size n - 1) of a pair; mid is the part left out.
    """
    out = []
    for longer in (0, 1):
        size = n - longer
        for j in range(blocks):
            left, right = F.floor(size * j / blocks).cast("int"), size - F.floor(size * (j + 1) / blocks).cast("int")
            parts = ([F.substring(content, F.lit(1), left)] if j else []) + ([F.substring(content, n - right + 1, right)] if j + 1 < blocks else [])
            out.append((F.xxhash64(size, F.lit(j), *parts), longer, F.substring(content, left + 1, n - left - right)))
    return out


def shared_keys(rows: DataFrame) -> DataFrame:
    """Keys that at least two different lines have."""
    return rows.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).filter("lo <> hi").select("key")


def suspects_of(lines: DataFrame) -> DataFrame:
    """(content, h, first) of the lines that agree with a different line on one of two halves: all that can be one edit apart."""
    sized = lines.select("h", "content", F.length("content").alias("n"))
    keys = F.array(*[key for key, _, _ in block_keys(F.col("content"), F.col("n"), 2)])
    keyed = settle(sized.select("h", keys.alias("keys")).select("h", F.explode("keys").alias("key")), "line-keys")
    near = settle(keyed.join(shared_keys(keyed), "key").select("h").distinct(), "line-suspects", narrow=True)
    return settle(lines.join(near, "h", "left_semi").groupBy("h", "content").agg(F.min("place").alias("first")), "lines")


def one_edit_apart(a: Column, b: Column, long: int = 256) -> Column:
    """Whether two different lines are one edit apart: Levenshtein's distance, or for long lines the first difference, found by halving, and the rest."""
    n = F.least(F.length(a), F.length(b))

    def halve(s, _):
        middle = F.floor((s["lo"] + s["hi"] + 1) / 2).cast("int")
        same = F.substring(a, F.lit(1), middle) == F.substring(b, F.lit(1), middle)
        return F.struct(F.when(same, middle).otherwise(s["lo"]).alias("lo"), F.when(same, s["hi"]).otherwise(middle - 1).alias("hi"))

    rest = lambda x, p: F.substring(x, p + 1, F.length(x))
    p = F.aggregate(F.sequence(F.lit(1), F.ceil(F.log2(n + 1)).cast("int") + 1), F.struct(F.lit(0).alias("lo"), n.alias("hi")), halve, lambda s: s["lo"])
    difference = F.length(a) - F.length(b)
    apart = let(p, lambda p: F.when(difference == 0, rest(a, p + 1) == rest(b, p + 1)).when(difference == 1, rest(a, p + 1) == rest(b, p)).when(difference == -1, rest(a, p) == rest(b, p + 1)).otherwise(F.lit(False)))
    return F.when(n <= long, F.levenshtein(a, b, 1) == 1).otherwise(apart)


def near_lines(suspects: DataFrame, blocks: int = 8) -> DataFrame:
    """(first, near): for a distinct line, the earliest line before it within one edit; both by their first places.

    Each suspect emits hashed variants: its deletions of one character, tagged with the position, meet other lines of the same
    length (equal variants then differ in that one character only); and its deletions without a position meet the line they
    equal, which emits itself. Deletions are spelt out only inside a block outside of which another line agrees.
    In a group of equal variants only the earliest line is passed on, so groups give no pairs. Edit distance is then verified.
    """
    keys = [F.struct(key.alias("key"), F.lit(longer).alias("longer"), mid.alias("mid")) for key, longer, mid in block_keys(F.col("content"), F.col("n"), blocks)]
    keyed = suspects.withColumn("n", F.length("content")).select("h", "first", F.explode(F.array(*keys)).alias("k")).select("h", "first", "k.key", "k.longer", "k.mid")
    keyed = keyed.join(shared_keys(keyed), "key")
    size, short = math.ceil((suspects.agg(F.max(F.length("content"))).first()[0] or 0) / blocks) + 1, [keyed]
    if size > BLOCK_CHARS:
        short, long = [keyed.filter(F.length("mid") <= BLOCK_CHARS)], settle(keyed.filter(F.length("mid") > BLOCK_CHARS), "line-blocks")
    while size > BLOCK_CHARS:  # only where the longest line asks for it: blocks that two lines share outside of are cut again
        parts = [F.struct(F.xxhash64("key", key).alias("key"), F.lit(longer).alias("longer"), mid.alias("mid")) for key, longer, mid in block_keys(F.col("mid"), F.length("mid"), blocks)]
        again = long.select("h", "first", F.col("longer").alias("kind"), F.explode(F.array(*parts)).alias("k")).filter("k.longer = kind").select("h", "first", "k.key", "k.longer", "k.mid")
        again = settle(again, "line-blocks")
        again = settle(again.join(shared_keys(again), "key").select("h", "first", "key", "longer", "mid"), "line-blocks")
        short.append(again.filter(F.length("mid") <= BLOCK_CHARS))
        long, size = again.filter(F.length("mid") > BLOCK_CHARS), math.ceil(size / blocks) + 1
    keyed = short[0].select("h", "first", "key", "longer", "mid")
    for part in short[1:]:
        keyed = keyed.unionByName(part)
    mid, n = F.col("mid"), F.length("mid")
    cut = lambda i: F.concat(F.substring(mid, F.lit(1), i - 1), F.substring(mid, i + 1, n))
    positions = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    deletions = F.array_distinct(F.transform(positions, lambda i: F.xxhash64("key", F.lit(0), cut(i))))
    tagged = F.transform(positions, lambda i: F.xxhash64("key", i, cut(i)))
    itself = F.array(F.xxhash64("key", F.lit(0), mid))
    variants = keyed.select(
        "h", "first", F.explode(F.when(F.col("longer") == 1, F.transform(deletions, lambda v: F.struct(v.alias("v"), F.lit(2).alias("role")))).otherwise(
            F.concat(F.transform(tagged, lambda v: F.struct(v.alias("v"), F.lit(0).alias("role"))), F.transform(itself, lambda v: F.struct(v.alias("v"), F.lit(1).alias("role"))))
        )).alias("x"),
    ).select("h", "first", "x.v", "x.role")
    of = lambda r: F.min(F.when(F.col("role") == r, F.col("first")))
    groups = variants.groupBy("v").agg(of(0).alias("same"), of(1).alias("shorter"), of(2).alias("longer"), F.min("h").alias("lo"), F.max("h").alias("hi")).filter("lo <> hi").drop("lo", "hi")
    partner = F.when(F.col("role") == 0, F.col("same")).when(F.col("role") == 1, F.col("longer")).otherwise(F.col("shorter"))
    found = variants.join(groups, "v").select("first", partner.alias("near")).filter("near < first").distinct()
    texts = suspects.select("first", "content")
    both = found.join(texts, "first").join(texts.select(F.col("first").alias("near"), F.col("content").alias("other")), "near")
    return both.filter(one_edit_apart(F.col("content"), F.col("other"))).groupBy("first").agg(F.min("near").alias("near"))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 1) -> DataFrame:
    """Lines to remove: doc_id, line_no (from 0), keep_doc_id, keep_line_no, edits.

    Lines end at line feeds and are compared trimmed; empty ones never count. A line is removed when a line before it, by
    (doc_id, line_no), is equal to it (edits 0) or, both having `min_chars` characters or more, within one insertion, deletion
    or substitution of a character (edits 1); keep_* names the earliest such line. Whether that line is itself removed plays no part.

    Null and empty texts have no lines to compare; a null id sorts last and is returned as null. Rows with one id have lines of
    their own; of those, equal lines with the same number are equally early. Extra columns are ignored. No rows in, no rows out.
    """
    return _repeats(docs, id_col, text_col, min_chars).drop("tag")


def _repeats(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    lines = lines_of(docs, id_col, text_col)
    near = near_lines(suspects_of(lines.drop("tag").filter(F.length("content") >= min_chars)))
    narrow = lines.select("place", "tag", F.unhex(F.md5("content")).alias("digest"))
    firsts = narrow.groupBy("digest").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    repeated = settle(firsts.join(near, "first", "left").filter("n > 1 or near is not null").select("digest", "first", "near"), "line-firsts")
    hit = narrow.join(repeated, "digest").filter("place > first or near is not null")
    keep = F.least("first", F.coalesce("near", "first"))
    line = lambda p: F.pmod(p, F.lit(STEP).cast("decimal(38,0)")).cast("int")
    doc = lambda p: F.nullif(((p - F.pmod(p, F.lit(STEP).cast("decimal(38,0)"))) / F.lit(STEP).cast("decimal(10,0)")).cast("bigint"), F.lit(2**63 - 1))
    p = F.col("place")
    return hit.select(p, "tag", keep.alias("keep"), F.when(F.col("near") < F.col("first"), 1).otherwise(0).alias("edits")).select(
        doc(p).alias("doc_id"), "tag", line(p).alias("line_no"), doc(F.col("keep")).alias("keep_doc_id"), line(F.col("keep")).alias("keep_line_no"), "edits"
    )


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 1) -> DataFrame:
    """`docs` without the lines of `repeated_lines`; a row that had lines and has none left with a character in it goes.

    A row loses its own lines only: removed lines are gathered by id and text, so rows that share an id, or have none, do not
    share a fate, and no group is larger than one text. The work on a row grows with its lines, not with their square. Null and empty
    texts stay as they are. All columns stay, whatever their names. No rows in, no rows out.
    """
    key, tag, gone = free_names(docs, "line_doc", "line_tag", "removed_lines")
    removed = _repeats(docs, id_col, text_col, min_chars)
    by_row = removed.groupBy(F.col("doc_id").alias(key), F.col("tag").alias(tag)).agg(F.sort_array(F.collect_set("line_no")).alias(gone))

    def flags(numbers):  # for each line up to the last removed one, whether it goes
        gap = lambda x, i: x - F.when(i > 0, F.get(numbers, i - 1) + 1).otherwise(0)
        return F.flatten(F.transform(numbers, lambda x, i: F.concat(F.array_repeat(F.lit(False), gap(x, i)), F.array(F.lit(True)))))

    text = F.col(text_col)
    rest = let(F.col(gone), lambda numbers: F.array_join(F.zip_with(F.split(text, "\n", -1), flags(numbers), lambda x, out: F.when(F.coalesce(out, F.lit(False)), F.lit(None)).otherwise(x)), "\n"))
    on = F.col(id_col).cast("bigint").eqNullSafe(F.col(key)) & (row_tag(text) == F.col(tag))
    cut = docs.join(by_row, on, "left").withColumn(key, F.when(F.col(gone).isNull(), text).otherwise(rest))
    return cut.filter(F.col(gone).isNull() | (F.btrim(F.col(key), F.lit(TRIMMED + "\n")) != "")).select(*[F.col(key).alias(c) if c == text_col else F.col(c) for c in docs.columns])
