"""Token counts from a tokenizer compiled to a finite-state transducer, with chunk maps that compose in any grouping."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PATTERN, default_path, load_vocabulary
from .common import whole

_SPLIT = regex.compile(PATTERN)
#: A place where every run of the splitter starts anew: a blank after a character that is not white space.
_SYNC = re.compile(r"(?<=\S)[ \n]")


class Transducer:
    """Deterministic transducer over the bytes of a pre-token; the sum of its transitions' outputs is the token count.

    A sequence of tokens is what byte-pair merging gives exactly when each neighbouring pair is (merging the pair's
    bytes gives the pair back). So after i bytes the count is one more than at the start k of the one token that ends at i,
    fits its predecessor at k, and is in the vocabulary. A state holds every k from which a longer token may still come: the
    token's trie node, the token that ended at k, and how many tokens lie between. A transition's output is the change of
    the count, which is negative where tokens merge.

    States are made when first reached and kept up to `most_states`; past that the tables start anew. Nothing is approximated.
    """

    def __init__(self, path: str, most_states: int = 200_000, most_words: int = 400_000):
        self.ranks, self.special = load_vocabulary(path)
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.child: dict[int, int] = {}
        self.token_at: dict[int, int] = {}
        nodes = 1
        for token, i in self.ranks.items():
            node = 0
            for byte in token:
                key = node << 8 | byte
                if key not in self.child:
                    self.child[key] = nodes
                    nodes += 1
                node = self.child[key]
            self.token_at[node] = i
        self.inner = {key >> 8 for key in self.child}
        self.fits: dict[tuple[int, int], bool] = {}
        self.most_states, self.most_words = most_states, most_words
        self.specials = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.forget()

    def forget(self) -> None:
        self.states: dict[tuple, int] = {}
        self.of: list[tuple] = []
        self.moves: dict[int, int] = {}
        self.words: dict[str, int] = {}
        self.fits.clear()
        self.start = self.number(((0, -1, 0),))

    def number(self, state: tuple) -> int:
        n = self.states.setdefault(state, len(self.of))
        if n == len(self.of):
            self.of.append(state)
        return n

    def merged(self, piece: bytes) -> list[bytes]:
        """Byte-pair merging by rank, the leftmost of equal ranks first."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, left: int, right: int) -> bool:
        if left < 0:
            return True
        known = self.fits.get((left, right))
        if known is None:
            a, b = self.bytes_of[left], self.bytes_of[right]
            known = self.fits[left, right] = self.merged(a + b) == [a, b]
        return known

    def compile(self, state: int, byte: int) -> int:
        """Make the transition; its code is (next state, output + 2**15)."""
        grown = [(node, before, behind) for n, before, behind in self.of[state] if (node := self.child.get(n << 8 | byte)) is not None]
        token, change = next((t, 1 - behind) for node, before, behind in grown if (t := self.token_at.get(node)) is not None and self.may_follow(before, t))
        new = self.number((*[(node, before, behind + change) for node, before, behind in grown if node in self.inner], (0, token, 0)))
        code = self.moves[state << 8 | byte] = new << 16 | (change + (1 << 15))
        return code

    def run(self, word: str) -> int:
        """Tokens of one pre-token."""
        state, moves, total = self.start, self.moves, 0
        data = word.encode("utf-8")
        for byte in data:
            code = moves.get(state << 8 | byte)
            if code is None:
                code = self.compile(state, byte)
            state = code >> 16
            total += (code & 0xFFFF) - (1 << 15)
        return total

    def count(self, text: str) -> int:
        """Tokens of a text as the tokenizers library counts them by default: each special string in it is one token."""
        if self.specials is not None and self.specials.search(text):
            return sum(map(self.count, self.specials.split(text))) + len(self.specials.findall(text))
        words, total = self.words, 0
        for w in _SPLIT.findall(text):
            n = words.get(w)
            if n is None:
                n = self.run(w)
                if len(w) <= 64:
                    words[w] = n
            total += n
        if len(words) > self.most_words:
            words.clear()
        if len(self.of) > self.most_states:
            self.forget()
        return total


@dataclass
class ChunkMap:
    """What a chunk does to any state it may be entered in: finish the entering word with `head`, add `count`, leave in `tail`.

    At a place of _SYNC the splitter's state is the same whatever came before, so all entry states meet there. A chunk
    without one (`count` None) only lengthens the entering word by `head`.
    """

    head: str
    count: int | None
    tail: str

    def then(self, other: ChunkMap, fst: Transducer) -> ChunkMap:
        """The map of this chunk and the next; grouping does not matter."""
        if self.count is None:
            return ChunkMap(self.head + other.head, other.count, other.tail)
        if other.count is None:
            return ChunkMap(self.head, self.count, self.tail + other.head)
        return ChunkMap(self.head, self.count + fst.count(self.tail + other.head) + other.count, other.tail)

    def total(self, fst: Transducer) -> int:
        """Tokens when entered at the start of a text and left at its end."""
        return fst.count(self.head) + (0 if self.count is None else self.count + fst.count(self.tail))


def map_of(chunk: str, fst: Transducer) -> ChunkMap:
    first = _SYNC.search(chunk)
    if first is None:
        return ChunkMap(chunk, None, "")
    last = max(chunk.rfind(" "), chunk.rfind("\n"))
    while last > first.start() and chunk[last - 1].isspace():
        last = max(chunk.rfind(" ", 0, last), chunk.rfind("\n", 0, last))
    last = max(last, first.start())
    return ChunkMap(chunk[: first.start()], fst.count(chunk[first.start() : last]), chunk[last:])


def scan(maps: list[ChunkMap], fst: Transducer) -> ChunkMap:
    """All maps in order as one, by pairwise rounds as in a parallel prefix scan."""
    while len(maps) > 1:
        maps = [maps[i].then(maps[i + 1], fst) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    return maps[0] if maps else ChunkMap("", None, "")


_COMPILED: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """One transducer for each worker process and tokenizer; it is compiled while it runs."""
    if path not in _COMPILED:
        _COMPILED[path] = Transducer(path)
    return _COMPILED[path]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = 1024, chunk: int = 1 << 16) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row.

    Texts of up to `chunk` characters are counted whole. Longer ones are cut into chunks that any task may map; the maps
    (a few words and a number each) meet by row and are composed there. Null and empty texts have 0 bytes and tokens.
    Repeated rows and null ids are returned as they are. Extra columns are ignored. No rows in, no rows out.
    """
    path = path or default_path()
    text = F.col("text")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), whole(F.col(text_col)).alias("text"))

    def short(batches):
        for batch in batches:
            fst = transducer(path)
            n = [map_of(t, fst).total(fst) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    def mapped(batches):
        for batch in batches:
            fst = transducer(path)
            maps = [map_of(t, fst) for t in batch.column(4).to_pylist()]
            columns = [pa.array([m.head for m in maps], pa.string()), pa.array([m.count for m in maps], pa.int64()), pa.array([m.tail for m in maps], pa.string())]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(4)], *columns], names=["row", "doc_id", "n_bytes", "k", "head", "count", "tail"])

    def composed(batches):
        for batch in batches:
            fst = transducer(path)
            n = [scan([ChunkMap(m["head"], m["count"], m["tail"]) for m in maps], fst).total(fst) for maps in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    n_bytes = F.octet_length("text").cast("bigint").alias("n_bytes")
    out = "doc_id bigint, n_bytes bigint, n_tokens bigint"
    whole_rows = rows.filter(F.length("text") <= chunk).select("doc_id", n_bytes, "text").mapInArrow(short, out)
    starts = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / chunk).cast("int"))
    numbered = rows.filter(F.length("text") > chunk).select(F.monotonically_increasing_id().alias("row"), "doc_id", n_bytes, "text")
    cut = numbered.select("row", "doc_id", "n_bytes", F.posexplode(F.transform(starts, lambda k: F.substring(text, k * chunk + 1, F.lit(chunk)))).alias("k", "chunk"))
    maps = cut.mapInArrow(mapped, "row bigint, doc_id bigint, n_bytes bigint, k int, head string, count bigint, tail string")
    by_row = maps.groupBy("row", "doc_id", "n_bytes").agg(F.array_sort(F.collect_list(F.struct("k", "head", "count", "tail"))).alias("maps"))
    long_rows = by_row.select("doc_id", "n_bytes", "maps").mapInArrow(composed, out)
    return whole_rows.unionByName(long_rows).withColumn("over_limit", F.col("n_tokens") > limit)
