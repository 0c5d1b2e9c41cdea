"""Byte-level BPE encoding and decoding.

Spark's regular expressions cut a text into the matches of the vocabulary's pattern (words). In Arrow batches the distinct words of
a batch are merged, all words of one length together: a word is a row of ids, and until no pair of a row has a rank, a step merges each row's
leftmost pair of lowest rank and asks for the ranks of the two new pairs only. Words of more than ``LONG_BYTES`` bytes are merged one by
one over a heap of their pairs. The ranks are a table of pair keys in which every key stands at one of two places, so that a look-up costs two probes
at most; it travels with the tasks. Nothing is shuffled or counted over the corpus, and a task holds ``SLAB_WORDS`` words or one text.

``folded`` is the same by Spark's higher-order functions over literal tables: about fifty times the work a word, so it only checks ``encode``.

Decoding joins the ids' byte pieces. The rank file is a parameter, read once on the driver.

Defined results: a null or empty text has no ids, and null or no ids decode to no bytes; an id outside the ranks (or a null one) is an
error; very long texts and words are encoded whole; ties of rank go to the left; repeated rows each come back; an
empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import heapq
import json
import math
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from provenant.llm import common as C

LONG_BYTES = 200
# Words that a task takes at once (a longer text is taken whole), and rows of equal lengths that are merged at once.
SLAB_WORDS = 1 << 20
MERGED_ROWS = 1 << 14
MEMO_WORDS = 1 << 17
# The literals are megabytes: the plan's text, which Spark keeps for every execution, ends after so many characters.
PLAN_TEXT = 1 << 20
MEMO_BYTES = 64
_SIDE = 1 << 16
_NO_MARK = "\uFFFD"


def read_ranks(path: str | None = None) -> dict[bytes, int]:
    """Byte strings and their ranks; without a path the public vocabulary's."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as file:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, file)}


def word_pattern(pattern: str | None = None) -> str:
    """The pattern for Spark's regular expressions, in which white space is Unicode's only by name."""
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    return pattern.replace(r"\s", r"\p{IsWhite_Space}").replace(r"\S", r"\P{IsWhite_Space}")


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _prime(least: int) -> int:
    n = least | 1
    while any(n % d == 0 for d in range(3, math.isqrt(n) + 1, 2)):
        n += 2
    return n


class TwoPlaces:
    """A table of whole-number keys in which a key stands at its remainder by one of two primes."""

    def __init__(self, keys: list[int], values: list):
        least = max(23 * len(keys) // 10, 99)
        for tenths in range(9, 30):
            if self._placed(keys, values, _prime(least), _prime(least * tenths // 10)):
                return
        raise ValueError("the keys cannot be placed")

    def _placed(self, keys, values, first: int, second: int) -> bool:
        self.first, self.second = first, second
        held: list = [None] * (max(first, second))
        for entry in zip(keys, values, strict=True):
            at = entry[0] % first
            for _ in range(200):
                entry, held[at] = held[at], entry
                if entry is None:
                    break
                at = entry[0] % second if at == entry[0] % first else entry[0] % first
            else:
                return False
        self.held = held
        return True

    def keys(self) -> list[int]:
        return [-1 if e is None else e[0] for e in self.held]

    def values(self, empty) -> list:
        return [empty if e is None else e[1] for e in self.held]

    def places(self, key: Column) -> tuple[Column, Column]:
        return (key % self.first).cast("int"), (key % self.second).cast("int")



def _whole_numbers(values: list[int], kind: str) -> Column:
    """A literal array: its text is parsed once, when the plan is optimised."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


class Ranks:
    """The literals that hold the ranks, and the folds over them."""

    def __init__(self, ranks: dict[bytes, int]):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("every byte needs a rank")
        if max(ranks.values()) + 1 >= 0xD800 or len(set(ranks.values())) != len(ranks) or min(ranks.values()) < 0:
            raise ValueError("ranks must be distinct and below 55295")
        pairs = {}
        for piece, rank in ranks.items():
            found = False
            for cut in range(1, len(piece)):
                a, b = ranks.get(piece[:cut]), ranks.get(piece[cut:])
                if a is not None and b is not None:
                    pairs[a * _SIDE + b] = rank
                    found = True
            if len(piece) > 1 and not found:
                raise ValueError("a piece is no pair of two others")
        self.ranks = ranks
        self.pairs = TwoPlaces(list(pairs), list(pairs.values()))
        self.size = max(ranks.values()) + 1

    def literal(self) -> Column:
        """All tables of the folds as one literal, to be bound once a row."""
        marks = [chr(rank + 1) for rank in self.pairs.values(0)]
        return F.struct(_whole_numbers(self.pairs.keys(), "long").alias("keys"), F.split(F.lit("".join(marks)), "").alias("rank_marks"),
                        _whole_numbers([self.ranks[bytes([b])] for b in range(256)], "int").alias("bytes"),
                        F.split(F.lit("".join(chr(i + 1) for i in range(self.size))), "").alias("marks"))

    @staticmethod
    def _bytes(word: Column, t: Column) -> Column:
        return F.transform(F.split(F.decode(word.cast("binary"), "ISO-8859-1"), ""), lambda c: F.get(t["bytes"], F.ascii(c)))

    def _keys(self, ids: Column) -> Column:
        n = F.size(ids) - 1
        return F.zip_with(F.slice(ids, F.lit(1), n), F.slice(ids, F.lit(2), n), lambda a, b: a.cast("long") * _SIDE + b)

    def _rank_mark(self, key: Column, t: Column) -> Column:
        """The character of a pair's rank."""
        one, two = self.pairs.places(key)
        return F.when(F.get(t["keys"], one) == key, F.get(t["rank_marks"], one)).when(F.get(t["keys"], two) == key, F.get(t["rank_marks"], two)).otherwise(F.lit(_NO_MARK))

    def short(self, word: Column, t: Column) -> Column:
        """A word's ids, a character (the id's successor) each: one merge a step. The state is two strings: a character an id, between two that have no
        rank, and a character a pair's rank."""
        def step(state, _):
            def merged(low):
                def at(i):
                    s, r, own = state["s"], state["r"], F.ascii(low).cast("long")
                    left = F.ascii(F.substring(s, i - 1, F.lit(1))) * F.lit(_SIDE).cast("long") + own - (_SIDE + 1)
                    right = own * _SIDE + F.ascii(F.substring(s, i + 2, F.lit(1))) - (_SIDE + 1)
                    new = F.concat(_let(left, lambda k: self._rank_mark(k, t)), _let(right, lambda k: self._rank_mark(k, t)))
                    return F.struct(F.overlay(s, low, i, F.lit(2)).alias("s"), F.overlay(r, new, i - 1, F.lit(3)).alias("r"))
                return F.when(low == _NO_MARK, F.struct(state["s"].alias("s"), F.lit("").alias("r"))).otherwise(_let(F.position(low, state["r"]), at))
            return F.when(state["r"] == "", state).otherwise(_let(F.array_min(F.split(state["r"], "")), merged))

        def fold(ids):
            marks = F.array_join(F.transform(ids, lambda i: F.get(t["marks"], i)), "")
            ranks = F.array_join(F.transform(self._keys(ids), lambda k: self._rank_mark(k, t)), "")
            start = F.struct(F.concat(F.lit(_NO_MARK), marks, F.lit(_NO_MARK)).alias("s"), F.concat(F.lit(_NO_MARK), ranks, F.lit(_NO_MARK)).alias("r"))
            done = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(ids) - 1, F.lit(1))), start, step)["s"]
            return F.substring(done, F.lit(2), F.length(done) - 2)

        return _let(self._bytes(word, t), fold)

    def long(self, word: Column, t: Column) -> Column:
        """The same, all places of the lowest pair a step."""
        def step(state, _):
            def pairs(marks):
                n = F.size(marks) - 1
                keys = F.zip_with(F.slice(marks, F.lit(1), n), F.slice(marks, F.lit(2), n), lambda a, b: (F.ascii(a) - 1).cast("long") * _SIDE + F.ascii(b) - 1)

                def lowest(ranks):
                    def merged(low):
                        at = F.array_position(ranks, low).cast("int")
                        pair = F.concat(F.get(marks, at - 1), F.get(marks, at))
                        going = F.struct(F.replace(state["s"], pair, low).alias("s"), F.lit(False).alias("done"))
                        return F.when(F.coalesce(low, F.lit(_NO_MARK)) == _NO_MARK, F.struct(state["s"].alias("s"), F.lit(True).alias("done"))).otherwise(going)
                    return _let(F.array_min(ranks), merged)
                return _let(F.transform(keys, lambda k: self._rank_mark(k, t)), lowest)
            return F.when(state["done"], state).otherwise(_let(F.split(state["s"], ""), pairs))

        marks = F.array_join(F.transform(self._bytes(word, t), lambda i: F.get(t["marks"], i)), "")
        done = F.aggregate(F.sequence(F.lit(1), F.octet_length(word)), F.struct(marks.alias("s"), F.lit(False).alias("done")), step)["s"]
        return done

    def word_marks(self, word: Column, t: Column) -> Column:
        return F.when(F.octet_length(word) > LONG_BYTES, self.long(word, t)).otherwise(self.short(word, t))


def _ids(marks: Column) -> Column:
    return F.transform(F.filter(F.split(marks, ""), lambda c: c != ""), lambda c: F.ascii(c) - 1)


def _words(text: str, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(pattern), F.lit(0))


def frequent_words(docs: DataFrame, pattern: str, text: str = "text", most: int = MEMO_WORDS) -> DataFrame:
    """(word) of at most ``most`` words: all that are counted as often as some count or oftener."""
    words = docs.select(F.explode(_words(text, pattern)).alias("word")).where(F.octet_length("word") <= MEMO_BYTES)
    counts = C.written(words.groupBy("word").count().where("count > 1").withColumn("step", F.floor(F.log2("count") * 8).cast("int")), "words")
    left, least = most, None
    for row in counts.groupBy("step").count().orderBy(F.desc("step")).collect():  # at most 8 * 63 rows
        if row["count"] > left:
            break
        left, least = left - row["count"], row["step"]
    return counts.where(F.lit(False) if least is None else F.col("step") >= least).select("word")


class Merges:
    """The merges of words in numpy: the tables of :class:`Ranks` as arrays."""

    def __init__(self, own: Ranks):
        self.first, self.second = own.pairs.first, own.pairs.second
        self.keys, self.found = np.array(own.pairs.keys(), dtype=np.int64), np.array(own.pairs.values(0), dtype=np.int64)
        self.none, self.rows = own.size, MERGED_ROWS
        self.bytes = np.array([own.ranks[bytes([b])] for b in range(256)], dtype=np.int64)

    @cached_property
    def pairs(self) -> dict[int, int]:
        return dict(zip(self.keys.tolist(), self.found.tolist(), strict=True))

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs; ``none`` without one."""
        key = left * _SIDE + right
        one, two = key % self.first, key % self.second
        return np.where(self.keys[one] == key, self.found[one], np.where(self.keys[two] == key, self.found[two], self.none))

    def equal(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, their ids) of words of equal lengths, as they come to have no pair left."""
        rows = np.arange(len(ids))
        ranks = self.ranks(ids[:, :-1], ids[:, 1:])
        while ids.shape[1] > 1:
            at = ranks.argmin(axis=1)
            low = ranks[np.arange(len(ranks)), at]
            going = low < self.none
            if not going.all():
                yield rows[~going], ids[~going]
                rows, ids, ranks, at, low = rows[going], ids[going], ranks[going], at[going], low[going]
            if not len(rows):
                return
            every, width = np.arange(len(rows)), ids.shape[1] - 1
            places = np.arange(width)
            ids = np.take_along_axis(ids, places + (places > at[:, None]), axis=1)
            ids[every, at] = low
            ranks = np.take_along_axis(ranks, places[:-1] + (places[:-1] >= at[:, None]), axis=1)
            some = np.flatnonzero(at > 0)
            ranks[some, at[some] - 1] = self.ranks(ids[some, at[some] - 1], low[some])
            some = np.flatnonzero(at < width - 1)
            ranks[some, at[some]] = self.ranks(low[some], ids[some, at[some] + 1])
        yield rows, ids

    def long(self, ids: np.ndarray) -> np.ndarray:
        """A long word's ids: its pairs in a heap, by rank and place."""
        n = len(ids)
        held, after, before = ids.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank, at, at + 1) for at, rank in enumerate(self.ranks(ids[:-1], ids[1:]).tolist()) if rank < self.none]
        heapq.heapify(heap)
        made = self.pairs
        now = {(at, nxt): rank for rank, at, nxt in heap}

        def offer(at, nxt):
            rank = made.get(held[at] * _SIDE + held[nxt], self.none)
            now[at, nxt] = rank
            if rank < self.none:
                heapq.heappush(heap, (rank, at, nxt))

        while heap:
            rank, at, nxt = heapq.heappop(heap)
            if held[at] < 0 or nxt >= n or held[nxt] < 0 or after[at] != nxt or now[at, nxt] != rank:
                continue
            held[at], held[nxt] = rank, -1
            after[at] = after[nxt]
            if after[at] < n:
                before[after[at]] = at
                offer(at, after[at])
            if before[at] >= 0:
                offer(before[at], at)
        return np.array([i for i in held if i >= 0], dtype=np.int64)

    def merged(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all words in one array, and each word's start and number there."""
        data, at = C.text_bytes(words)
        sizes = np.diff(at)
        starts, counts, parts, total = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64), [], 0

        def put(rows, ids):
            nonlocal total
            starts[rows], counts[rows] = total + np.arange(len(rows)) * ids.shape[1], ids.shape[1]
            parts.append(ids.astype(np.int32).ravel())
            total += ids.size

        order = np.argsort(sizes, kind="stable")
        bounds = np.flatnonzero(np.diff(sizes[order], prepend=-1, append=-1))
        for low, high in zip(bounds[:-1], bounds[1:], strict=True):
            size = int(sizes[order[low]])
            for a in range(low, high if size else low, self.rows):
                rows = order[a:min(a + self.rows, high)]
                if size > LONG_BYTES:
                    for row in rows:
                        put(np.array([row]), self.long(self.bytes[data[at[row]:at[row + 1]]])[None])
                    continue
                for done, ids in self.equal(self.bytes[data[at[rows][:, None] + np.arange(size)]]):
                    put(rows[done], ids)
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32), starts, counts

    def ids(self, words: pa.Array) -> pa.Array:
        """The ids of each list of words."""
        cuts = words.offsets.to_numpy().astype(np.int64)
        coded = words.flatten().dictionary_encode()
        flat, starts, counts = self.merged(coded.dictionary)
        word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        many = counts[word]
        ends = np.concatenate(([0], np.cumsum(many)))
        out = flat[np.arange(ends[-1]) + np.repeat(starts[word] - ends[:-1], many)]
        return pa.ListArray.from_arrays(pa.array(ends[cuts - cuts[0]], pa.int32()), pa.array(out, pa.int32()))


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of every whole text."""
    C.ship_package(docs.sparkSession)
    settings, name = docs.sparkSession.conf, "spark.sql.maxPlanStringLength"
    longest = str(settings.get(name))
    if longest.isdigit() and int(longest) > PLAN_TEXT:
        settings.set(name, PLAN_TEXT)
    merges, most = Merges(Ranks(ranks)), SLAB_WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts, first = batch.column(1).offsets.to_numpy().astype(np.int64), 0
            while first < batch.num_rows:
                last = max(first + 1, int(np.searchsorted(cuts, cuts[first] + most, side="right")) - 1)
                rows = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([rows.column(0), merges.ids(rows.column(1))], names=["doc_id", "ids"])
                first = last

    cut = docs.select(F.col(doc_id).alias("doc_id"), _words(text, word_pattern(pattern)).alias("words"))
    return cut.mapInArrow(run, StructType([StructField("doc_id", cut.schema["doc_id"].dataType), StructField("ids", ArrayType(IntegerType()))]))


def folded(docs: DataFrame, ranks: dict[bytes, int], pattern: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The same as ``encode`` by higher-order functions: the most frequent words (at most ``MEMO_WORDS``, chosen by their count) are folded once and a
    literal, all others are folded where they stand."""
    pattern = word_pattern(pattern)
    own = Ranks(ranks)
    settings, name = docs.sparkSession.conf, "spark.sql.maxPlanStringLength"
    longest = str(settings.get(name))
    if longest.isdigit() and int(longest) > PLAN_TEXT:
        settings.set(name, PLAN_TEXT)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    known = frequent_words(docs, pattern).select("word", _let(own.literal(), lambda t: own.word_marks(F.col("word"), t)).alias("marks")).toPandas()
    sums = [zlib.crc32(word.encode()) for word in known["word"]]
    # Of words that share a sum one is remembered; the others are folded where they stand.
    chosen = dict(zip(sums, zip(known["word"], known["marks"], strict=True), strict=True))
    memo = TwoPlaces(list(chosen), list(chosen.values()))
    tables = F.struct(own.literal().alias("t"), *(F.from_json(F.lit(json.dumps([None if e is None else e[1][k] for e in memo.held], ensure_ascii=False)), "array<string>").alias(name)
                                                  for k, name in enumerate(("words", "marks"))))
    del known, chosen, sums

    def one(word, t):
        def remembered(key):
            first, second = memo.places(key)
            return F.when(F.get(t["words"], first) == word, F.get(t["marks"], first)).when(F.get(t["words"], second) == word, F.get(t["marks"], second)) \
                .otherwise(own.word_marks(word, t["t"]))
        return _let(F.crc32(word.cast("binary")), remembered)

    marks = _let(tables, lambda t: F.array_join(F.transform(_words("text", pattern), lambda w: one(w, t)), ""))
    return docs.select("doc_id", _ids(marks).alias("ids"))


def spelt(ids: Column, names: list[str]) -> Column:
    """The binary of ids' names (hexadecimal digits) joined."""
    def each(t):
        return F.transform(F.coalesce(ids, F.array().cast("array<int>")), lambda i: F.coalesce(F.get(t, i), F.raise_error(F.lit("an id outside the vocabulary"))))
    return F.unhex(F.array_join(_let(F.split(F.lit(",".join(names)), ","), each), ""))


def decoded(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes of an array of ids."""
    names = [""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        names[rank] = piece.hex()
    if not all(names):
        raise ValueError("the ranks have gaps")
    return spelt(ids, names)


def little_endian(ids: Column, size: int) -> Column:
    """Ids below ``size`` as unsigned numbers of 32 bits, lowest byte first."""
    return spelt(ids, [i.to_bytes(4, "little").hex() for i in range(size)])


def decode(tokens: DataFrame, ranks: dict[bytes, int], doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, data): the bytes of every row's ids."""
    return tokens.select(F.col(doc_id).alias("doc_id"), decoded(F.col(ids), ranks).alias("data"))


def digests(docs: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document."""
    tokens = encode(docs, ranks)
    size = max(ranks.values()) + 1
    return tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(little_endian(F.col("ids"), size), 256).alias("ids_sha256"),
                         F.sha2(decoded(F.col("ids"), ranks), 256).alias("decoded_sha256"))
