"""Byte-level BPE by a monoid tree reduction.

An encoding of ``a + b`` is put together from those of ``a`` and ``b``: only tokens
near the seam can change. ``join`` re-encodes a window around the seam and widens
the side whose outermost token changed. A token sequence is the BPE encoding of its
bytes exactly if every neighbouring pair is the encoding of that pair; the pairs
outside the window were so before, those inside are so because the window was
encoded, and the two pairs at its rim are the old ones as soon as the outermost
tokens are the old ones. So the result is exact, ``join`` is associative, and a
piece of any length is encoded by halves. Decoding is the concatenation of the
tokens' bytes, a monoid as well.

Texts are cut where the pre-token pattern always cuts (see ``cut``), so the parts
of a text are joined by plain concatenation, and a task encodes each different part
once as long as it stays in a bounded cache. The leaves of the trees, halves of at
most LEAF bytes, are encoded for all new parts of a slice at once, in numpy.

Cases: a null text is an empty one (no ids, empty bytes); repeated rows and ids
give repeated rows; an empty table gives an empty one; columns other than the
named text column are carried as they are (columns called ``ids`` or
``decoded`` too, see ``encode``).
"""

from __future__ import annotations

import base64
import heapq
import re
from array import array
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneledger.llm.text import batches_of, new_name

# White space as the pattern's \s sees it.
SPACE = "\t-\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
# A space before anything but white space always begins a pre-token.
_CUT = re.compile(f" (?=[^{SPACE}])")
CACHED_PARTS = 250_000
CACHED_WINDOWS = 300_000
LEAF = 16
NEVER = 1 << 40


def cut(text: str) -> list[str]:
    """Parts of a text; all but the first stand for a space and themselves. No
    pre-token crosses from one part to the next: a run of white space before
    something else gives up its last character, and if that is a space it opens the
    next pre-token."""
    return _CUT.split(text)


def load_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a rank file: lines of a base64 token and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


def _text(token: bytes) -> str | None:
    try:
        return token.decode()
    except UnicodeDecodeError:
        return None


class Encoder:
    """Encodes and decodes by one table of ranks; ``pattern`` cuts a text into pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.pre_tokens = regex.compile(pattern).findall
        self.leaves = Leaves(ranks)
        self.vocabulary = pa.array([self.bytes_of.get(rank, b"") for rank in range(max(self.bytes_of) + 1)], pa.binary())
        # Pieces that are one token, and of these the parts that are a space and a word.
        self.whole = {text: rank.to_bytes(4, "little") for token, rank in ranks.items() if (text := _text(token))}
        self.spaced = {text[1:]: ids for text, ids in self.whole.items() if text[0] == " " and text[1:].isalpha()}
        self._windows: dict[bytes, tuple[int, ...]] = {}

    def merge(self, data: bytes) -> tuple[int, ...]:
        """Tokens of a window: always merge the neighbours of lowest rank, the first
        among equals, until none has a rank."""
        ranks, n = self.ranks, len(data)
        ends, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank, at, at + 2) for at in range(n - 1) if (rank := ranks.get(data[at:at + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, at, end = heapq.heappop(heap)
            if ends[at] < 0 or ends[at] == n or ends[ends[at]] != end:
                continue  # one of the two has been merged meanwhile
            gone = ends[at]
            ends[at], ends[gone] = end, -1
            if end < n:
                before[end] = at
                if (rank := ranks.get(data[at:ends[end]])) is not None:
                    heapq.heappush(heap, (rank, at, ends[end]))
            if (left := before[at]) >= 0 and (rank := ranks.get(data[left:end])) is not None:
                heapq.heappush(heap, (rank, left, end))
        tokens, at = [], 0
        while at < n:
            tokens.append(ranks[data[at:ends[at]]])
            at = ends[at]
        return tuple(tokens)

    def window(self, data: bytes) -> tuple[int, ...]:
        if len(data) > 2 * LEAF:
            return self.merge(data)
        found = self._windows.get(data)
        if found is None:
            found = self._windows[data] = self.merge(data)
        return found

    def prepare(self, pieces: Iterable[bytes]) -> None:
        """Encode the leaves of the pieces' trees at once."""
        leaves, stack = set(), list(pieces)
        while stack:
            piece = stack.pop()
            if piece in self.ranks or piece in self._windows:
                continue
            if len(piece) <= LEAF:
                leaves.add(piece)
            else:
                half = len(piece) // 2
                stack += piece[:half], piece[half:]
        leaves.discard(b"")
        todo = list(leaves)
        if todo:
            self._windows.update(zip(todo, self.leaves.encode(todo)))

    def forget(self, most: int = CACHED_WINDOWS) -> None:
        """Keep the memory of windows bounded."""
        if len(self._windows) > most:
            self._windows.clear()

    def join(self, a: tuple[int, ...], b: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of the concatenation, from the encodings of its halves."""
        if not a or not b:
            return a or b
        left = right = 1
        while True:
            left, right = min(left, len(a)), min(right, len(b))
            tokens = self.window(self.decode(a[-left:] + b[:right]))
            firm_left = left == len(a) or tokens[0] == a[-left]
            firm_right = right == len(b) or tokens[-1] == b[right - 1]
            if firm_left and firm_right:
                return a[:-left] + tokens + b[right:]
            left, right = left * (1 if firm_left else 2), right * (1 if firm_right else 2)

    def encode(self, piece: bytes) -> tuple[int, ...]:
        """The encoding of one pre-token, by halves down to short leaves."""
        rank = self.ranks.get(piece)
        if rank is not None:
            return (rank,)
        if len(piece) <= LEAF:
            return self.window(piece)
        half = len(piece) // 2
        return self.join(self.encode(piece[:half]), self.encode(piece[half:]))

    def packed(self, pieces: list[str]) -> list[bytes]:
        """The ids of many pieces that have no rank, as little-endian int32: those that are
        one leaf are cut from the array of all."""
        data = list(map(str.encode, pieces))
        long = [at for at, piece in enumerate(data) if len(piece) > LEAF]
        self.prepare(data[at] for at in long)
        tokens, ends = self.leaves.flat([piece if len(piece) <= LEAF else b"" for piece in data])
        ids, cuts = tokens.astype("<i4").tobytes(), (4 * ends).tolist()
        out = [ids[first:last] for first, last in zip([0, *cuts], cuts)]
        for at in long:
            out[at] = array("i", self.encode(data[at])).tobytes()
        return out

    def encode_text(self, text: str) -> tuple[int, ...]:
        return tuple(token for piece in self.pre_tokens(text) for token in self.encode(piece.encode()))

    def decode(self, ids: Sequence[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode_rows(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The bytes of the ids of each row, which begin at ``offsets``: the bytes of all
        tokens in a row, cut."""
        _, ends, data = self.vocabulary.take(pa.array(ids)).buffers()
        cuts = np.frombuffer(ends, np.int32)[offsets] if len(ids) else np.zeros(len(offsets), np.int32)
        return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(cuts), data if len(ids) else pa.py_buffer(b"")])


class Leaves:
    """Encodes many short pieces at once: each round merges, in every piece that can
    still merge, the neighbours of lowest rank, the first among equals."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.single = np.array([ranks[bytes([k])] for k in range(256)], np.int64)
        pairs = sorted(
            (ranks[token[:at]] << 32 | ranks[token[at:]], rank) for token, rank in ranks.items()
            for at in range(1, len(token)) if token[:at] in ranks and token[at:] in ranks)
        self.pairs = np.array([pair for pair, _ in pairs] + [np.iinfo(np.int64).max])
        self.merged = np.array([rank for _, rank in pairs] + [NEVER])
        self.of_bytes = self.rank(self.single[:, None], self.single[None, :])

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of two neighbours put together, NEVER if they have none."""
        key = left << 32 | right
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, self.merged[at], NEVER)

    def encode(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        tokens, ends = self.flat(pieces)
        tokens, ends = tokens.tolist(), ends.tolist()
        return [tuple(tokens[start:end]) for start, end in zip([0, *ends], ends)]

    def flat(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all pieces, one after the other, and where each piece ends."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data = np.frombuffer(b"".join(pieces), np.uint8)
        if not len(data):
            return np.zeros(0, np.int64), lengths
        tokens = self.single[data]
        piece = np.repeat(np.arange(len(pieces)), lengths)
        ranks = np.full(len(tokens), NEVER)
        ranks[:-1] = np.where(piece[1:] == piece[:-1], self.of_bytes[data[:-1], data[1:]], NEVER)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(tokens):
            starts = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
            best = np.minimum.reduceat(ranks, starts)
            counts = np.diff(np.append(starts, len(tokens)))
            merging = best < NEVER
            here = np.repeat(merging, counts)
            done.append((piece[~here], tokens[~here]))
            tokens, piece, ranks = tokens[here], piece[here], ranks[here]
            counts, best = counts[merging], best[merging]
            if not len(tokens):
                break
            lowest = np.flatnonzero(ranks == np.repeat(best, counts))
            lowest = lowest[np.concatenate([[True], piece[lowest[1:]] != piece[lowest[:-1]]])]
            tokens[lowest] = best
            left = np.ones(len(tokens), bool)
            left[lowest + 1] = False
            places = np.cumsum(left)[lowest] - 1
            tokens, piece = tokens[left], piece[left]
            ranks = ranks[left]
            for at in (places, places[places > 0] - 1):
                inside = at[at + 1 < len(tokens)]
                ranks[at] = NEVER
                same = inside[piece[inside] == piece[inside + 1]]
                ranks[same] = self.rank(tokens[same], tokens[same + 1])
        piece = np.concatenate([p for p, _ in done])
        tokens = np.concatenate([t for _, t in done])[np.argsort(piece, kind="stable")]
        return tokens, np.cumsum(np.bincount(piece, minlength=len(pieces)))


class Parts:
    """Parts of texts -> their ids as little-endian int32, for the parts of the texts at
    hand; ``decoded``: whether the bytes decoded from them are wanted."""

    def __init__(self, encoder: Encoder, decoded: bool = True) -> None:
        self.encoder, self.decoded = encoder, decoded
        self._firsts: dict[str, bytes] = {}
        self._others = encoder.spaced.copy()

    def add(self, texts: list[list[str]]) -> None:
        """Encode what is not known yet, the leaves of all pieces at once."""
        if len(self._others) + len(self._firsts) >= CACHED_PARTS:
            self._firsts, self._others = {}, self.encoder.spaced.copy()
        others: set[str] = set()
        for parts in texts:
            others.update(parts[1:])
        firsts = {parts[0] for parts in texts}
        pre_tokens, whole = self.encoder.pre_tokens, self.encoder.whole
        for known, prefix, parts in ((self._firsts, "", firsts), (self._others, " ", others)):
            new = parts.difference(known)
            words = [part for part in new if part.isalpha()]  # a piece each
            known.update(zip(words, self.encoder.packed([prefix + word for word in words])))
            mixed = [part for part in new if not part.isalpha()]
            cuts = [pre_tokens(prefix + part) for part in mixed]
            pieces = list({piece for cut in cuts for piece in cut}.difference(whole))
            found = whole | dict(zip(pieces, self.encoder.packed(pieces)))
            known.update(zip(mixed, [b"".join([found[piece] for piece in cut]) for cut in cuts]))
        self.encoder.forget()

    def ids(self, parts: list[str]) -> bytes:
        """A text's ids: those of its parts, concatenated."""
        return self._firsts[parts[0]] + b"".join(map(self._others.__getitem__, parts[1:]))

    def encoded(self, parts: list[str]) -> tuple[bytes, bytes]:
        """A text's ids and its bytes again."""
        return self._pair(self.ids(parts))

    @property
    def firsts(self) -> dict[str, tuple[bytes, bytes]]:
        return {part: self._pair(ids) for part, ids in self._firsts.items()}

    @property
    def others(self) -> dict[str, tuple[bytes, bytes]]:
        return {part: self._pair(ids) for part, ids in self._others.items()}

    def _pair(self, ids: bytes) -> tuple[bytes, bytes]:
        return ids, self.encoder.decode(np.frombuffer(ids, "<i4").tolist()) if self.decoded else b""


_encoders: dict[tuple, Encoder] = {}


def _encoder(shared, pattern: str) -> Encoder:
    """The tables of this worker, made once. Nothing else outlives a task."""
    data = shared.value
    key = (len(data), hash(data), pattern)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(load_ranks(data), pattern)
    return _encoders[key]


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", decoded: bool = True) -> DataFrame:
    """``docs`` with ``ids`` (array of int) and, if wanted, ``decoded`` (binary, from the ids),
    the last columns; a name that ``docs`` has already gets underscores until it is new.

    The rank file is read by the driver and broadcast; its size is the size of the
    vocabulary, whatever the corpus.
    """
    batches_of(docs.sparkSession)
    with open(ranks_path, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    kinds = {"ids": T.ArrayType(T.IntegerType(), False), **({"decoded": T.BinaryType()} if decoded else {})}
    added = [T.StructField(new_name(docs.columns, name), kind) for name, kind in kinds.items()]
    schema = T.StructType([*docs.schema.fields, *added])
    at, own = docs.columns.index(text), [field.name for field in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared, pattern)
        known = Parts(encoder, decoded)
        for batch in batches:
            for rows in slices(batch, at):
                texts = [cut(value or "") for value in rows.column(at).to_pylist()]
                known.add(texts)
                found = [known.ids(parts) for parts in texts]
                flat = np.frombuffer(b"".join(found), "<i4")
                offsets = np.cumsum([0, *(len(ids) // 4 for ids in found)])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))
                again = [encoder.decode_rows(flat, offsets)] if decoded else []
                yield pa.RecordBatch.from_arrays([*rows.columns, lists, *again], [*rows.schema.names, *own])
        # The worker lives on, and so would what it has learnt of these texts.
        encoder.forget(0)
        pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: int, bytes_: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in slices whose texts have about so many bytes, at least a row each."""
    if not batch.num_rows:
        return
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    first = 0
    while first < batch.num_rows:
        before = sizes[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(sizes, before + bytes_, "right")))
        yield batch.slice(first, last - first)
        first = last


def digests(encoded: DataFrame) -> DataFrame:
    """Per row ``doc_id, n_tokens, ids_sha256, decoded_sha256`` of an encoded table."""
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
