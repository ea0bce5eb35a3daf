"""SentencePiece encoding as a relational lattice over distinct words.

Texts are cut where no piece crosses (before a run of spaces, around a line
break, between any two characters that stand side by side in no piece), and each
distinct word is encoded once: its substrings up to the
longest piece are exploded and joined to the piece table, a character outside
the table is an edge of its own, the edges are grouped by word, and a fold over
the word's places finds the path of the highest score (Viterbi), earlier starts
first among equals. A character off the table becomes its bytes' pieces.

The encoded words go to the documents in a broadcast of sorted hash arrays, the
commonest if all take more than ``max_bytes``. The others, which few texts have,
go through the same lattice where they stand (``Pieces.lattice``), all those of a slice at once: the texts
are not shuffled, however many words there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casesignal.llm.common import arrow_map, arrow_schema, texts_of, to_batch
from casesignal.session import stored

MARK = "▁"
#: Words beyond this go through the same recurrence row by row: a fold appends
#: to arrays, which costs the square of a word's length.
LONG = 64
WORDS_A_TASK = 50_000
#: Words of so many slices or more are equally common.
OFTEN = 4_096
#: Bytes of text encoded at a time.
SLICE = 1 << 20
#: Characters looked at in one go when texts are cut.
WINDOW = 1 << 18


@dataclass(frozen=True, eq=False)
class Pieces:
    """The pieces of a model with byte fallback: scores and ids."""

    ids: dict[str, int]
    scores: dict[str, float]
    byte_ids: tuple[int, ...]
    texts: tuple[bytes, ...]
    longest: int
    unknown: float
    #: Code points that pieces hold beside others, sorted; which of them, by
    #: their places here from 1 on, stand before which in a piece.
    chars: np.ndarray
    beside: np.ndarray

    @cached_property
    def _place(self) -> np.ndarray:
        """Place in ``chars`` by code point; 0 for the others and all beyond the last."""
        out = np.zeros(int(self.chars[-1]) + 2, dtype=np.int32)
        out[self.chars] = np.arange(1, len(self.chars) + 1)
        return out

    def word_ids(self, word: str) -> list[int]:
        """The recurrence of the fold, place by place."""
        best, back = [0.0], [(0, -1)]
        for end in range(1, len(word) + 1):
            top = None
            for start in range(max(0, end - self.longest), end):
                s = word[start:end]
                score = self.scores.get(s, self.unknown if end - start == 1 else None)
                if score is not None and (top is None or best[start] + score > top[0]):
                    top = (best[start] + score, start, self.ids.get(s, -1))
            best.append(top[0])
            back.append(top[1:])
        out, at = [], len(word)
        while at:
            start, i = back[at]
            out += [i] if i >= 0 else [self.byte_ids[b] for b in reversed(word[start:at].encode("utf-8", "surrogatepass"))]
            at = start
        return out[::-1]

    def cut(self, texts: list[bytes]) -> tuple[pa.StringArray, np.ndarray]:
        """The words of all texts in a row, and their number in each text."""
        marked = [(MARK + t.decode("utf-8", "replace")).replace(" ", MARK) if t else "" for t in texts]
        whole = "".join(marked)
        code = np.frombuffer(whole.encode("utf-32-le"), dtype=np.uint32)
        first, width = np.ones(len(code), dtype=bool), np.ones(len(code), dtype=np.int8)
        for lo in range(0, len(code), WINDOW):
            run = code[lo : lo + WINDOW + 1]
            place = self._place[np.minimum(run, len(self._place) - 1)]
            first[lo + 1 : lo + len(run)] = ~self.beside[place[:-1], place[1:]]
            for beyond in (0x80, 0x800, 0x10000):
                width[lo : lo + WINDOW] += run[:WINDOW] >= beyond
        ends = np.cumsum([len(t) for t in marked], dtype=np.int64)
        first[ends[:-1][ends[:-1] < len(code)]] = True
        at = np.flatnonzero(first)
        size = np.add.reduceat(width, at, dtype=np.int64) if len(at) else np.zeros(0, dtype=np.int64)
        offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        words = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(whole.encode()))
        return words, np.diff(np.searchsorted(at, ends), prepend=0)

    @cached_property
    def _trie(self) -> tuple[np.ndarray, ...]:
        """Characters of all pieces; then, by state * characters + character, the next state; id and score of each state."""
        chars = {c: i for i, c in enumerate(sorted({c for p in self.ids for c in p}))}
        steps: dict[int, int] = {}
        found, scores = [-1], [0.0]
        for p, i in self.ids.items():
            state = 0
            for c in p:
                key = state * len(chars) + chars[c]
                if key not in steps:
                    steps[key] = len(found)
                    found.append(-1)
                    scores.append(0.0)
                state = steps[key]
            found[state], scores[state] = i, self.scores[p]
        keys = np.array(sorted(steps), dtype=np.int64)
        return np.array([ord(c) for c in chars], dtype=np.uint32), keys, np.array([steps[k] for k in keys.tolist()]), np.array(found), np.array(scores)

    def lattice(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some words in a row and their number for each: all edges by the piece table, then a fold by end."""
        if any(len(w) > LONG for w in words):
            plain = [self.word_ids(w) if len(w) > LONG else None for w in words]
            lengths, ids = self.lattice([w for w in words if len(w) <= LONG])
            short = iter(np.split(ids, np.cumsum(lengths)[:-1]) if len(lengths) else [])
            out = [np.array(p, dtype=np.int64) if p is not None else next(short) for p in plain]
            return np.array([len(o) for o in out], dtype=np.int64), np.concatenate(out)
        chars, keys, following, found, scores = self._trie
        size = np.array([len(w) for w in words], dtype=np.int64)
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        if not len(code):
            return size, np.zeros(0, dtype=np.int64)
        word, ends = np.repeat(np.arange(len(words)), size), np.cumsum(size)
        place = np.minimum(np.searchsorted(chars, code), len(chars) - 1)
        known = chars[place] == code
        live, state, edges = np.arange(len(code)), np.zeros(len(code), dtype=np.int64), []
        bare = np.ones(len(code), dtype=bool)
        for step in range(self.longest):
            on = live + step < ends[word[live]]
            live, state = live[on], state[on]
            on = known[live + step]
            live, state = live[on], state[on]
            key = state * len(chars) + place[live + step]
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            on = keys[at] == key
            live, state = live[on], following[at[on]]
            piece = np.flatnonzero(found[state] >= 0)
            edges.append((live[piece], np.full(len(piece), step + 1), found[state[piece]], scores[state[piece]]))
            if step == 0:
                bare[live[piece]] = False
        alone = np.flatnonzero(bare)
        edges.append((alone, np.ones(len(alone), dtype=np.int64), np.full(len(alone), -1), np.full(len(alone), self.unknown)))
        start, length, ids, score = (np.concatenate(e) for e in zip(*edges, strict=True))
        # A word has one place more than characters.
        begin = start + word[start]
        end = begin + length
        reach = start + length - (ends - size)[word[start]]
        order = np.lexsort((start, reach))
        best, back = np.full(len(code) + len(words), -np.inf), np.full(len(code) + len(words), -1)
        first = ends - size + np.arange(len(words))
        best[first] = 0
        edge = np.flatnonzero(np.diff(reach[order], prepend=0, append=-1))
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            own = order[lo:hi]
            way, to = best[begin[own]] + score[own], end[own]
            new = np.diff(to, prepend=-1) != 0
            top = np.maximum.reduceat(way, np.flatnonzero(new))
            group = np.cumsum(new) - 1
            equal = np.flatnonzero(way == top[group])
            # The earliest start among equals.
            equal = equal[np.unique(group[equal], return_index=True)[1]]
            best[to[new]], back[to[new]] = top, own[equal]
        used = np.zeros(len(back), dtype=bool)
        at = (first + size)[size > 0]
        while len(at):
            used[at] = True
            at = begin[back[at]]
            at = at[back[at] >= 0]
        path = back[used]
        number = ids[path]
        wide = np.where(number >= 0, 1, 0)
        spelled = {int(i): [self.byte_ids[b] for b in chr(int(code[start[path[i]]])).encode("utf-8", "surrogatepass")] for i in np.flatnonzero(number < 0)}
        for i, own in spelled.items():
            wide[i] = len(own)
        out, firsts = np.repeat(number, wide), np.cumsum(wide) - wide
        for i, own in spelled.items():
            out[firsts[i] : firsts[i] + len(own)] = own
        return np.bincount(word[start[path]], weights=wide, minlength=len(words)).astype(np.int64), out

    def words(self, text: str) -> list[str]:
        return self.cut([text.encode("utf-8", "replace")])[0].to_pylist()

    def decode(self, ids) -> bytes:
        """The text of some ids; spaces for the mark, none for the first."""
        return b"".join([self.texts[i] for i in ids]).replace(MARK.encode(), b" ")[1:]


@lru_cache(maxsize=2)
def load_pieces(model: bytes) -> Pieces:
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(model)
    ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
    scores = {p.piece: p.score for p in proto.pieces if p.type == 1}
    bytes_ = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
    texts = [bytes([int(p.piece[3:5], 16)]) if p.type == 6 else p.piece.encode() if p.type == 1 else b"" for p in proto.pieces]
    if len(bytes_) != 256 or any(MARK in p.lstrip(MARK) for p in ids):
        raise ValueError("needs byte pieces, and no space after other characters in a piece")
    pairs = sorted({(ord(a), ord(b)) for p in ids for a, b in pairwise(p)} | {(ord(MARK), ord(MARK))})
    chars = np.unique(np.array(pairs))
    beside = np.zeros((len(chars) + 1, len(chars) + 1), dtype=bool)
    beside[tuple(np.searchsorted(chars, np.array(pairs).T) + 1)] = True
    return Pieces(ids, scores, tuple(bytes_[b] for b in range(256)), tuple(texts), max(map(len, ids)), min(scores.values()) - 10, chars, beside)


def word_hash(words: pa.StringArray) -> np.ndarray:
    """XXH64 as Spark's function gives it."""
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w, 42) for w in words.view(pa.binary()).to_numpy(zero_copy_only=False)], dtype=np.uint64).view(np.int64)


def distinct_words(docs: DataFrame, model: bytes, text_col: str = "text") -> DataFrame:
    """``w``: the words of all texts, each once; ``n``: how many slices of texts have it."""
    sent = docs.sparkSession.sparkContext.broadcast(load_pieces(model))

    def of(batch: pa.RecordBatch) -> dict[str, object]:
        own = sent.value
        found = [own.cut(texts_of(part.column(0)))[0].unique() for part in _slices(batch, 0)]
        return {"w": pa.concat_arrays(found).unique()}

    return arrow_map(docs.select(F.col(text_col)), of, "w string").groupBy("w").agg(F.count(F.lit(1)).alias("n"))


def commonest(words: DataFrame, max_bytes: int) -> DataFrame:
    """The words of the highest ``n`` whose ids take ``max_bytes`` at most; all if they do."""
    n = F.least("n", F.lit(OFTEN))
    size = F.sum(F.lit(20) + 2 * F.octet_length("w"))
    least, total = 1, 0
    for r in sorted(words.groupBy(n.alias("n")).agg(size.alias("size")).collect(), key=lambda r: -r["n"]):
        total += r["size"]
        if total > max_bytes:
            least = r["n"] + 1
            break
    return words.where(n >= least)


# An edge in one number: end, start, and the id + 1, or _BARE + code point.
_END, _START, _BARE = 48, 40, 1 << 32


def _best_path(edges: Column) -> Column:
    """Ids along the best path through ``edges``: k, start, end, score.

    The fold goes by end and keeps the best score and edge of each place; the
    walk back follows the edges' starts.
    """

    zero = F.struct(F.array(F.lit(0.0)).alias("scores"), F.array(F.lit(0).cast("long")).alias("edges"))

    def step(acc: Column, x: Column) -> Column:
        way = F.get(acc["scores"], x["start"]) + x["score"]

        def last(held: str, new: Column) -> Column:
            return F.concat(F.slice(acc[held], F.lit(1), x["end"]), F.array(new)).alias(held)

        on = F.struct(F.array_append(acc["scores"], way).alias("scores"), F.array_append(acc["edges"], x["k"]).alias("edges"))
        better = F.struct(last("scores", way), last("edges", x["k"]))
        return F.when(x["end"] >= F.size(acc["scores"]), on).when(way > F.get(acc["scores"], x["end"]), better).otherwise(acc)

    def start(k: Column) -> Column:
        return F.shiftright(k, _START).cast("int").bitwiseAND(F.lit(255))

    none = F.array().cast("array<bigint>").alias("ids")

    def back(done: Column) -> Column:
        """From the last place along the edges' starts; at 0 nothing changes."""
        from_end = F.struct((F.size(done["edges"]) - 1).alias("at"), none)

        def walk(acc: Column, _: Column) -> Column:
            k = F.get(done["edges"], acc["at"])
            code = k.bitwiseAND(F.lit((1 << _START) - 1)) - 1
            return F.when(acc["at"] > 0, F.struct(start(k).alias("at"), F.array_append(acc["ids"], code).alias("ids"))).otherwise(acc)

        return F.reverse(F.aggregate(done["edges"], from_end, walk, lambda acc: acc["ids"]))

    return F.aggregate(F.sort_array(edges), zero, step, back)


@lru_cache(maxsize=2)
def needed_pieces(pieces: Pieces) -> tuple[str, ...]:
    """Pieces that can lie on a best path: no cut of them scores more.

    Any path with another piece gets better with that piece cut up, so leaving
    them out of the lattice changes no result and keeps it small.
    """
    out: dict[str, float] = {}
    for p in sorted(pieces.scores, key=len):
        best = [0.0] + [float("-inf")] * len(p)
        for end in range(1, len(p) + 1):
            for start in range(end):
                score = out.get(p[start:end])
                if score is not None and best[start] + score > best[end]:
                    best[end] = best[start] + score
        if best[-1] <= pieces.scores[p]:
            out[p] = pieces.scores[p]
    return tuple(out)


def piece_table(spark: SparkSession, pieces: Pieces) -> DataFrame:
    """``piece``, ``id``, ``score``: a row for each piece that a best path can use."""
    names = list(needed_pieces(pieces))
    rows = pa.table({"piece": names, "id": pa.array([pieces.ids[p] for p in names], pa.int32()), "score": [pieces.scores[p] for p in names]})
    return spark.createDataFrame(rows, "piece string, id int, score double")


def encode_words(words: DataFrame, model: bytes) -> DataFrame:
    """``h`` and ``ids`` of each distinct word of at most LONG characters.

    A character that the piece table lacks is _BARE - 1 plus its code point.
    """
    spark, pieces = words.sparkSession, load_pieces(model)
    words = words.where(F.length("w") <= LONG).withColumn("n", F.length("w"))
    starts = words.select("h", "w", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("start"))
    sizes = F.sequence(F.lit(1), F.least(F.lit(pieces.longest), F.col("n") - F.col("start")))
    parts = starts.select("h", "w", "start", F.explode(sizes).alias("size"))
    parts = parts.select("h", "start", "size", F.substring("w", F.col("start") + 1, F.col("size")).alias("piece"))
    # The table has a row for each piece of the model at most.
    found = parts.join(F.broadcast(piece_table(spark, pieces)), "piece", "left").where("id IS NOT NULL OR size = 1")
    code = F.coalesce(F.col("id").cast("long") + 1, F.ascii("piece").cast("long") + _BARE)
    place = F.shiftleft((F.col("start") + F.col("size")).cast("long"), _END) + F.shiftleft(F.col("start").cast("long"), _START)
    edge = F.struct((place + code).alias("k"), "start", (F.col("start") + F.col("size")).alias("end"), F.coalesce("score", F.lit(pieces.unknown)).alias("score"))
    return found.groupBy("h").agg(F.collect_list(edge).alias("edges")).select("h", _best_path(F.col("edges")).alias("ids"))


def _spell(ids: list[int], pieces: Pieces) -> list[int]:
    """``ids`` with the bytes of characters off the table."""
    out = []
    for i in ids:
        out += [i] if i < _BARE - 1 else [pieces.byte_ids[b] for b in chr(i - _BARE + 1).encode("utf-8", "surrogatepass")]
    return out


def word_table(docs: DataFrame, model: bytes, text_col: str = "text", max_bytes: int = 128 << 20) -> DataFrame:
    """``h`` (XXH64 of the word), ``ids`` of the distinct words of the texts, the commonest if all take over ``max_bytes``."""
    spark = docs.sparkSession
    words = stored(distinct_words(docs, model, text_col).withColumn("h", F.xxhash64("w")), "words")
    words = commonest(words, max_bytes)
    n = max(1, -(-words.count() // WORDS_A_TASK))
    short = encode_words(words.repartition(n, "h"), model)
    sent = spark.sparkContext.broadcast(load_pieces(model))

    def spelled(batch: pa.RecordBatch) -> dict[str, object]:
        ids = batch.column(1)
        if len(ids.flatten()) and ids.flatten().to_numpy(zero_copy_only=False).max() >= _BARE - 1:
            return {"h": batch.column(0), "ids": [_spell(x, sent.value) for x in ids.to_pylist()]}
        return {"h": batch.column(0), "ids": ids.cast(pa.list_(pa.int32()))}

    def plain(batch: pa.RecordBatch) -> dict[str, object]:
        own = sent.value
        return {"h": batch.column(0), "ids": [own.word_ids(w) for w in batch.column(1).to_pylist()]}

    short = arrow_map(short, spelled, "h bigint, ids array<int>")
    long = arrow_map(words.where(F.length("w") > LONG).select("h", "w"), plain, "h bigint, ids array<int>")
    return stored(short.unionByName(long), "word-ids")


class WordIds:
    """Sorted hashes of words; word i's ids are ids[starts[i]:starts[i + 1]]."""

    def __init__(self, hashes: np.ndarray, lengths: np.ndarray, ids: np.ndarray):
        order = np.argsort(hashes, kind="stable")
        first = (np.cumsum(lengths, dtype=np.int64) - lengths)[order]
        sizes = lengths[order].astype(np.int64)
        ends = np.cumsum(sizes)
        self.hashes = hashes[order]
        self.starts = np.concatenate([[0], ends]).astype(np.uint32)
        self.ids = np.empty_like(ids)
        # In runs of words: the places of all ids at once would take four times the ids.
        for lo in range(0, len(order), WORDS_A_TASK):
            own, end = sizes[lo : lo + WORDS_A_TASK], ends[lo : lo + WORDS_A_TASK]
            at = np.arange(end[0] - own[0], end[-1])
            self.ids[at] = ids[np.repeat(first[lo : lo + WORDS_A_TASK] - (end - own), own) + at]

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each word, and whether it is there."""
        if not len(self.hashes):
            return np.zeros(len(hashes), dtype=np.int64), np.zeros(len(hashes), dtype=bool)
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return place, self.hashes[place] == hashes


def _packed(table: DataFrame) -> WordIds:
    """The word table in arrays."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = b.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int32)
            ids = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.uint16)
            cells = [b.column(0).to_numpy(zero_copy_only=False).tobytes(), lengths.tobytes(), ids.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cells], names=["h", "n", "ids"])

    rows = table.select("h", "ids").mapInArrow(pack, "h binary, n binary, ids binary").toArrow()
    part = lambda name, kind: np.concatenate([np.frombuffer(x.as_buffer(), dtype=kind) for x in rows.column(name)] or [np.zeros(0, kind)])
    return WordIds(part("h", np.int64), part("n", np.int32), part("ids", np.uint16))


_ENCODED = T.StructType(
    [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded_sha256", T.StringType())]
)


def encode(docs: DataFrame, model: bytes, *, text_col: str = "text", max_bytes: int = 128 << 20) -> DataFrame:
    """``docs`` with ``pieces`` struct: n_tokens, ids, decoded_sha256.

    All columns stay; one of that name is replaced. A null or empty text has no
    tokens. Decoding the ids gives the text back (a mark in the text comes back
    as a space); decoded_sha256 is the hash of what they decode to.
    """
    spark = docs.sparkSession
    docs = docs.drop("pieces")
    names = docs.columns
    at = names.index(text_col)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    packed = _packed(word_table(docs, model, text_col, max_bytes))
    schema = T.StructType([*rows.schema.fields, T.StructField("pieces", _ENCODED)])
    sent = spark.sparkContext.broadcast((load_pieces(model), packed))

    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = sent.value
        for batch in batches:
            for part in _slices(batch, 0, at):
                texts = texts_of(part.column(0).field(at))
                yield to_batch({"row": part.column(0), "pieces": _encode_texts(own, known, texts)}, target)

    return rows.mapInArrow(run, schema).select("row.*", "pieces")


def _slices(batch: pa.RecordBatch, *path: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with SLICE bytes of text or a little more."""
    column = batch.column(path[0])
    for i in path[1:]:
        column = column.field(i)
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    run = (np.cumsum(sizes) - sizes) // SLICE
    edges = [*np.flatnonzero(np.diff(run, prepend=-1)).tolist(), len(sizes)]
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        yield batch.slice(lo, hi - lo)


def _encode_texts(own: Pieces, known: WordIds, texts: list[bytes]) -> pa.StructArray:
    words, lengths = own.cut(texts)
    coded = words.dictionary_encode()
    place, there = known.places(word_hash(coded.dictionary))
    first, size = np.zeros(len(place), dtype=np.int64), np.zeros(len(place), dtype=np.int64)
    first[there] = known.starts[place[there]]
    size[there] = known.starts[place[there] + 1] - first[there]
    # Ids of the words that are not in the table follow the table's.
    lengths_here, ids_here = own.lattice(coded.dictionary.filter(pa.array(~there)).to_pylist()) if not there.all() else (size[:0], size[:0])
    first[~there], size[~there] = len(known.ids) + np.cumsum(lengths_here) - lengths_here, lengths_here
    each = coded.indices.to_numpy(zero_copy_only=False)
    first, size = first[each], size[each]
    ends = np.cumsum(size)
    at = np.repeat(first - (ends - size), size) + np.arange(int(size.sum()))
    held = at < len(known.ids)
    ids = np.empty(len(at), dtype=np.int64)
    ids[held], ids[~held] = known.ids[at[held]], ids_here[at[~held] - len(known.ids)]
    edges = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)]
    return _result(own, ids, edges)


def _result(own: Pieces, ids: np.ndarray, edges: np.ndarray) -> pa.StructArray:
    texts = [hashlib.sha256(t).hexdigest() for t in _decoded(own, ids, edges)]
    lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids.astype(np.int32)))
    return pa.StructArray.from_arrays([pa.array(np.diff(edges)), lists, pa.array(texts)], names=["n_tokens", "ids", "decoded_sha256"])


def _decoded(own: Pieces, ids: np.ndarray, edges: np.ndarray) -> Iterator[bytes]:
    """Texts of ``ids[edges[i]:edges[i + 1]]``: the pieces' bytes put in a row."""
    sizes = np.array([len(t) for t in own.texts], dtype=np.int64)
    flat = np.frombuffer(b"".join(own.texts), dtype=np.uint8)
    size = sizes[ids]
    ends = np.concatenate([[0], np.cumsum(size)])
    first = (np.cumsum(sizes) - sizes)[ids] - ends[:-1]
    data = flat[np.repeat(first, size) + np.arange(ends[-1])].tobytes()
    mark, cut = MARK.encode(), ends[edges].tolist()
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        yield data[a:b].replace(mark, b" ")[1:]


def decode(encoded: DataFrame, model: bytes, *, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids; null ids give an empty text."""
    sent = encoded.sparkSession.sparkContext.broadcast(model)
    encoded = encoded.drop(out_col)
    rows = encoded.select(F.struct(*[F.col(f"`{c}`") for c in encoded.columns]).alias("row"), F.col(ids_col).alias("ids"))

    def of(batch: pa.RecordBatch) -> dict[str, object]:
        own = load_pieces(sent.value)
        return {"row": batch.column(0), out_col: [own.decode(x or []).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]}

    schema = T.StructType([rows.schema["row"], T.StructField(out_col, T.StringType())])
    return arrow_map(rows, of, schema).select("row.*", out_col)
