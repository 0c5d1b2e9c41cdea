"""SentencePiece encoding and decoding by a batched numpy Viterbi.

Texts become code points with ``▁`` for spaces and one dummy prefix. If no piece has ``▁`` after
another character, a piece never spans two ``▁``-led words, so the distinct words of a slab
are segmented once. Words of equal length advance together, one position at a time: the hashes
of all substrings that end there probe the sorted piece keys, every hit is scored, and the
vectorised maximum stores the backpointer (start and piece).

* Unigram models: a hit scores its start's best score plus the piece's.
* BPE models: a prefix has one encoding, and a piece may end it if the merges of (last piece
  of the rest, piece) leave exactly these two. A hit scores 0 if so, else minus infinity.
  Whether a pair stands is found by merging its text once and kept in a bounded table. This is
  exactly the merge order's result, in time linear in the word.

Characters without a piece become their UTF-8 byte pieces, or the unknown id without byte fallback.

The model file is a parameter: its bytes are read once on the driver and travel with the task;
nothing opens a local path on an executor.

Defined results: a null or empty text has no tokens and decodes to the empty text; null ids
decode to the empty text; a literal ``▁`` decodes to a space, as the format has it; very
long texts and words are encoded whole; extra columns are ignored; repeated rows come back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.llm import common as C

SPACE_MARK = "▁"
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
_PAIR_SLOTS = 1 << 21
# Words whose ids a worker remembers, and ids it keeps for them before it starts anew: bounds of memory only.
_WORD_SLOTS = 1 << 20
_WORD_IDS = 1 << 23
_MARK = 0x2581
_U = np.uint64
_loaded: dict[int, "Pieces"] = {}


def read_model(path: str = MODEL_FILE) -> bytes:
    with open(path, "rb") as file:
        return file.read()


class Pieces:
    """The pieces of a model: sorted keys, scores and bytes."""

    def __init__(self, model: bytes):
        import sentencepiece

        source = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = source.get_piece_size()
        self.names = [source.id_to_piece(i) for i in range(size)]
        self.scores = np.array([source.get_score(i) for i in range(size)])
        self.unknown = source.unk_id()
        control = [source.is_control(i) or source.is_unused(i) or source.is_unknown(i) for i in range(size)]
        is_byte = [source.is_byte(i) for i in range(size)]
        self.bytes_of = {int(self.names[i][3:5], 16): i for i in range(size) if is_byte[i]}
        plain = [i for i in range(size) if not control[i] and not is_byte[i]]
        if any(SPACE_MARK in self.names[i].lstrip(SPACE_MARK) for i in plain):
            raise ValueError("a piece spans two words; this model cannot be segmented by words")
        self.ids = {self.names[i]: i for i in plain}
        self.longest = max(len(self.names[i]) for i in plain)
        # A BPE model's scores are its merge ranks: whole numbers.
        self.by_merges = bool(np.all(self.scores[plain] == np.round(self.scores[plain])))
        raw = [b"" if control[i] else bytes([int(self.names[i][3:5], 16)]) if is_byte[i] else self.names[i].replace(SPACE_MARK, " ").encode() for i in range(size)]
        self.raw = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.raw_at = np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64)
        self.base = _U(0x9E3779B97F4A7C15 | 1)
        self.powers = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(self.longest, self.base, dtype=np.uint64))))
        keys = np.array([self._key(self.names[i]) for i in plain], dtype=np.uint64)
        order = np.argsort(keys)
        self.keys, self.key_ids = keys[order], np.array(plain, dtype=np.int64)[order]
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two pieces share a key")
        self.seen = np.zeros(1 << 22, dtype=bool)
        self.seen[(keys >> _U(42)).astype(np.int64)] = True
        self.pair_keys = np.full(_PAIR_SLOTS, -1, dtype=np.int64)
        self.pair_good = np.zeros(_PAIR_SLOTS, dtype=bool)
        self._forget()

    def _key(self, name: str) -> int:
        value = 0
        for c in name:
            value = (value * int(self.base) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return int(C.mix(np.array([value], dtype=np.uint64))[0])

    def merged(self, text: str) -> list[str]:
        """The merge order's result on a short text."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.scores[i] > best):
                    best, at = self.scores[i], k
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stands(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging left + right leaves these two pieces; -1 is a word's start, -2 an unknown character."""
        size = len(self.names)
        left = np.where(left == -2, -1, left)
        keys = (left + 1) * size + right
        slots = (C.mix(keys.astype(np.uint64)) & _U(_PAIR_SLOTS - 1)).astype(np.int64)
        known = self.pair_keys[slots] == keys
        good = self.pair_good[slots] & known
        if not known.all():
            new, back = np.unique(keys[~known], return_inverse=True)
            found = np.empty(len(new), dtype=bool)
            for n, key in enumerate(new.tolist()):
                a, b = divmod(key, size)
                want = [self.names[b]] if a == 0 else [self.names[a - 1], self.names[b]]
                found[n] = self.merged("".join(want)) == want
            at = (C.mix(new.astype(np.uint64)) & _U(_PAIR_SLOTS - 1)).astype(np.int64)
            self.pair_keys[at] = new
            self.pair_good[at] = found
            # Two new pairs may share a slot: what stands there must be one of them, whole.
            self.pair_good[at] = found[np.searchsorted(new, self.pair_keys[at])]
            good[~known] = found[back]
        return good

    def segment(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids (-2 - code point for an unknown character) and counts for words of one length, a row each."""
        n, length = points.shape
        sums = np.zeros((n, length + 1), dtype=np.uint64)
        for i in range(length):
            sums[:, i + 1] = sums[:, i] * self.base + points[:, i] + _U(1)
        score = np.full((n, length + 1), -np.inf)
        score[:, 0] = 0
        last = np.full((n, length + 1), -1, dtype=np.int64)
        back = np.zeros((n, length + 1), dtype=np.int64)
        for i in range(1, length + 1):
            most = min(i, self.longest)
            from_ = np.arange(i - 1, i - 1 - most, -1)
            keys = C.mix(sums[:, i, None] - sums[:, from_] * self.powers[1:most + 1])
            row, step = np.nonzero(self.seen[(keys >> _U(42)).astype(np.int64)])
            keys = keys[row, step]
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = self.keys[at] == keys
            row, step, ids = row[hit], step[hit], self.key_ids[at[hit]]
            start = i - 1 - step
            gain = np.where(self.stands(last[row, start], ids), 0.0, -np.inf) if self.by_merges else self.scores[ids]
            options = np.full((n, most), -np.inf)
            options[row, step] = score[row, start] + gain
            pieces = np.full((n, most), -2, dtype=np.int64)
            pieces[row, step] = ids
            choice = np.argmax(options, axis=1)
            everyone = np.arange(n)
            best = options[everyone, choice]
            none = best == -np.inf
            score[:, i] = np.where(none, score[:, i - 1] + (0.0 if self.by_merges else self.scores.min() - 10.0), best)
            last[:, i] = np.where(none, -2, pieces[everyone, choice])
            back[:, i] = np.where(none, i - 1, i - 1 - choice)
        out = np.zeros((n, length), dtype=np.int64)
        counts = np.zeros(n, dtype=np.int64)
        at = np.full(n, length, dtype=np.int64)
        rows = np.arange(n)
        while len(rows):
            here, ids = at[rows], last[rows, at[rows]]
            unknown = ids == -2
            ids = np.where(unknown, -2 - points[rows, here - 1].astype(np.int64), ids)
            out[rows, counts[rows]] = ids
            counts[rows] += 1
            at[rows] = back[rows, here]
            rows = rows[at[rows] > 0]
        column = np.arange(length)
        taken = column < counts[:, None]
        source = np.where(taken, counts[:, None] - 1 - column, 0)
        return np.take_along_axis(out, source, axis=1)[taken], counts

    def spell(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Replace unknown characters by their byte pieces (or the unknown id)."""
        odd = np.flatnonzero(ids < -1)
        if not len(odd):
            return ids, counts
        owner = np.repeat(np.arange(len(counts)), counts)
        points, back = np.unique(-2 - ids[odd], return_inverse=True)
        spelt = [[self.bytes_of[b] for b in chr(p).encode("utf-8", "surrogatepass")] if self.bytes_of else [self.unknown] for p in points.tolist()]
        many = np.ones(len(ids), dtype=np.int64)
        many[odd] = np.array([len(x) for x in spelt])[back]
        out = np.repeat(ids, many)
        at = np.cumsum(many) - many
        for length in {len(x) for x in spelt}:
            table = np.array([x if len(x) == length else [0] * length for x in spelt])
            chosen = odd[many[odd] == length]
            for k in range(length):
                out[at[chosen] + k] = table[back[many[odd] == length], k]
        return out, np.bincount(np.repeat(owner, many), minlength=len(counts)).astype(np.int64)

    def _forget(self) -> None:
        self.word_keys = np.zeros(_WORD_SLOTS, dtype=np.uint64)
        self.word_begin = np.zeros(_WORD_SLOTS, dtype=np.int64)
        self.word_count = np.full(_WORD_SLOTS, -1, dtype=np.int64)
        self.known_ids = np.zeros(_WORD_IDS, dtype=np.int32)
        self.known = 0

    def _segmented(self, points: np.ndarray, starts: np.ndarray, lengths: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of distinct words stand in known_ids; words not yet known are segmented by length."""
        if self.known > _WORD_IDS // 2:
            self._forget()
        slots = (C.mix(keys) & _U(_WORD_SLOTS - 1)).astype(np.int64)
        had = (self.word_keys[slots] == keys) & (self.word_count[slots] >= 0)
        begin, counts = self.word_begin[slots], self.word_count[slots]
        new = np.flatnonzero(~had)
        if not len(new):
            return begin, counts
        order = new[np.argsort(lengths[new], kind="stable")]
        for group in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
            length = int(lengths[group[0]])
            step = max(1, (1 << 18) // length)
            for low in range(0, len(group), step):
                some = group[low:low + step]
                ids, many = self.spell(*self.segment(points[starts[some][:, None] + np.arange(length)].astype(np.uint64)))
                if self.known + len(ids) > len(self.known_ids):
                    self.known_ids = np.concatenate((self.known_ids, np.zeros(max(len(ids), len(self.known_ids)), dtype=np.int32)))
                self.known_ids[self.known:self.known + len(ids)] = ids
                begin[some] = self.known + np.cumsum(many) - many
                counts[some] = many
                self.known += len(ids)
        # Of new words that share a slot the last is remembered.
        at, last = np.unique(slots[new][::-1], return_index=True)
        kept = new[::-1][last]
        self.word_keys[at], self.word_begin[at], self.word_count[at] = keys[kept], begin[kept], counts[kept]
        return begin, counts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the n + 1 bounds of the texts' tokens."""
        joined = np.frombuffer("".join([" " + t if t else "" for t in texts]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        sizes = np.array([len(t) + 1 if t else 0 for t in texts], dtype=np.int64)
        ends = np.concatenate(([0], np.cumsum(sizes)))
        if not ends[-1]:
            return np.zeros(0, dtype=np.int64), ends
        points = np.where(joined == 0x20, np.uint32(_MARK), joined)
        mark = points == _MARK
        first = mark.copy()
        first[1:] &= ~mark[:-1]
        first[ends[:-1][sizes > 0]] = True
        starts = np.flatnonzero(first)
        stops = np.append(starts[1:], len(points))
        keys = C.span_hashes(points, starts, stops) ^ (stops - starts).astype(np.uint64)
        _, one, word = np.unique(keys, return_index=True, return_inverse=True)
        begin, counts = self._segmented(points, starts[one], (stops - starts)[one], keys[one])
        each = counts[word]
        total = np.concatenate(([0], np.cumsum(each)))
        source = np.arange(total[-1]) + np.repeat(begin[word] - total[:-1], each)
        return self.known_ids[source].astype(np.int64), total[np.searchsorted(starts, ends)]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The texts of segments of ids: bytes of the pieces, without the dummy prefix; bad bytes are replaced."""
        sizes = (self.raw_at[1:] - self.raw_at[:-1])[ids]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        data = self.raw[np.arange(ends[-1]) + np.repeat(self.raw_at[:-1][ids] - ends[:-1], sizes)].tobytes()
        cuts = ends[bounds].tolist()
        return [data[a + (data[a:a + 1] == b" "):b].decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def pieces(model: bytes) -> Pieces:
    """The model's pieces, built once for each Python worker."""
    key = hash(model)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Pieces(model)
    return _loaded[key]


def _lists(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))


def encode(docs: DataFrame, model: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, n_tokens, round_trip): the token ids of whole texts, and whether their decoding is the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)
        for whole in batches:
            for batch in C.slabs(whole, "text", C.WIDE_SLAB_BYTES):
                texts = [t or "" for t in batch.column(1).to_pylist()]
                ids, bounds = own.encode(texts)
                back = own.decode(ids, bounds)
                same = [a == b or a == b.replace(SPACE_MARK, " ") for a, b in zip(back, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), _lists(ids, bounds), pa.array(np.diff(bounds), pa.int32()), pa.array(same)],
                                                 names=["doc_id", "ids", "n_tokens", "round_trip"])

    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return docs.mapInArrow(run, "doc_id long, ids array<int>, n_tokens int, round_trip boolean")


def decode(tokens: DataFrame, model: bytes, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, text): the texts of token ids; ids outside the vocabulary are an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)
        for whole in batches:
            for low in range(0, whole.num_rows, 500):
                batch = whole.slice(low, 500)
                many = batch.column(1).fill_null([]) if batch.column(1).null_count else batch.column(1)
                bounds = np.concatenate(([0], np.cumsum(many.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
                texts = own.decode(many.flatten().to_numpy(zero_copy_only=False).astype(np.int64), bounds)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    tokens = tokens.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).alias("ids"))
    return tokens.mapInArrow(run, "doc_id long, text string")
