"""SentencePiece encoding and decoding by a batched Viterbi search in numpy.

A text becomes a blank and the text, every blank written as U+2581, and is cut where a blank follows another character
and around other white space, which no piece crosses. Distinct units of equal length advance together, one character a
step: hashes of all substrings probe the sorted keys of the pieces, the best score of each position is a maximum over
piece lengths, and what reached it is kept for the way back. Of equally good ways the longer last piece wins.

A character without a piece is written as its UTF-8 bytes, so decoding returns every text as it was. U+2581 itself,
which stands for a blank, is written as bytes too.

Scores are the model's own when it is a unigram model. The pieces of a merge model are only ranked by when they were
merged; each then scores the logarithm of its share by Zipf's law. The result is the likeliest segmentation into those
pieces, which is not always the one that merging would reach.

Defined results: null and empty texts have no tokens and decode to the empty text. Equal texts have equal tokens. All
columns of the input stay, except those of the same names as the new ones, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelworks.llm.words import BATCH_BYTES, WHITE, bytes_of, hashed, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = 0x2581
# A code that no character has, for one that must not match any piece.
NEVER = 0xFFFFFFFF
# Characters (lanes times length) that advance together, and columns that are probed at a time.
LANES = 200_000
COLUMNS = 4096
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_PROBE_BITS = np.uint64(44)


class Pieces(NamedTuple):
    keys: np.ndarray  # sorted hashes of pieces
    ids: np.ndarray  # their ids
    scores: np.ndarray  # their scores
    longest: int
    unknown: float  # score of a character without a piece
    of_byte: np.ndarray  # id of each byte's piece
    bytes: np.ndarray  # what ids decode to, joined
    offsets: np.ndarray
    likely: np.ndarray  # whether a key begins with these bits


def _step(hashes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return hashes * _FACTOR + codes + np.uint64(1)


def _key(hashes: np.ndarray, length: int) -> np.ndarray:
    h = hashes * np.uint64(0xD6E8FEB86659FD93) + np.uint64(length)
    return h ^ (h >> np.uint64(29))


def load_pieces(path: str = MODEL) -> Pieces:
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    kind = sentencepiece_model_pb2.ModelProto.SentencePiece
    normal = [i for i, p in enumerate(model.pieces) if p.type == kind.NORMAL]
    scores = np.array([model.pieces[i].score for i in normal], float)
    if model.trainer_spec.model_type == model.trainer_spec.BPE:
        rank = np.minimum(-scores, len(normal)) + 1
        scores = -np.log(rank) - np.log((1 / rank).sum())
    keys = []
    for i in normal:
        h = np.zeros(1, np.uint64)
        codes = np.frombuffer(model.pieces[i].piece.encode("utf-32-le"), np.uint32).astype(np.uint64)
        for c in codes:
            h = _step(h, c)
        keys.append(_key(h, len(codes))[0])
    order = np.argsort(np.array(keys, np.uint64))
    keys = np.array(keys, np.uint64)[order]
    if len(np.unique(keys)) != len(keys):
        raise ValueError("two pieces have the same key")
    likely = np.zeros(1 << (64 - int(_PROBE_BITS)), bool)
    likely[(keys >> _PROBE_BITS).astype(np.int64)] = True
    of_byte = np.full(256, -1)
    decoded = [b""] * len(model.pieces)
    for i, p in enumerate(model.pieces):
        if p.type == kind.BYTE:
            of_byte[int(p.piece[3:5], 16)] = i
            decoded[i] = bytes([int(p.piece[3:5], 16)])
        elif p.type == kind.NORMAL:
            decoded[i] = p.piece.replace(chr(BLANK), " ").encode()
    if (of_byte < 0).any():
        raise ValueError("the model has no pieces for single bytes")
    return Pieces(
        keys,
        np.array(normal)[order],
        scores[order],
        max(len(model.pieces[i].piece) for i in normal),
        float(scores.min()) - 10.0,
        of_byte,
        np.frombuffer(b"".join(decoded), np.uint8),
        np.cumsum([0, *map(len, decoded)]),
        likely,
    )


def _probe(pieces: Pieces, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place among the pieces, and score, of each key; the score of a key that is none is -inf."""
    at = np.full(keys.shape, -1)
    scores = np.full(keys.shape, -np.inf)
    some = np.nonzero(pieces.likely[(keys >> _PROBE_BITS).astype(np.int64)])
    place = np.minimum(np.searchsorted(pieces.keys, keys[some]), len(pieces.keys) - 1)
    hit = pieces.keys[place] == keys[some]
    some = tuple(axis[hit] for axis in some)
    at[some], scores[some] = place[hit], pieces.scores[place[hit]]
    return at, scores


def _best_ways(pieces: Pieces, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ``codes`` (lane, position): length and place of the last piece of the best way to each position."""
    lanes, length = codes.shape
    best = np.full((lanes, length + 1), -np.inf)
    best[:, 0] = 0
    back = np.ones((lanes, length + 1), np.uint8)
    piece = np.full((lanes, length + 1), -1, np.int32)
    for begin in range(0, length, COLUMNS):
        # All substrings that end in these columns.
        low, high = max(0, begin - pieces.longest + 1), min(length, begin + COLUMNS)
        window = codes[:, low:high]
        h = np.zeros(window.shape, np.uint64)
        found = []
        for k in range(1, min(pieces.longest, high - low) + 1):
            h = _step(h[:, : window.shape[1] - k + 1], window[:, k - 1 :])
            found.append(_probe(pieces, _key(h, k)))
        for end in range(begin + 1, high + 1):
            most = min(len(found), end - low)
            # Longest first: the first of equal maxima is taken.
            sizes = range(most, 0, -1)
            at = np.stack([found[k - 1][0][:, end - k - low] for k in sizes], 1)
            own = np.stack([found[k - 1][1][:, end - k - low] for k in sizes], 1)
            own[:, -1] = np.where(at[:, -1] < 0, pieces.unknown, own[:, -1])
            own += np.stack([best[:, end - k] for k in sizes], 1)
            top = own.argmax(1)
            rows = np.arange(lanes)
            best[:, end], back[:, end], piece[:, end] = own[rows, top], most - top, at[rows, top]
    return back, piece


def _utf8(codes: np.ndarray) -> list[bytes]:
    return [chr(BLANK if c == NEVER else c).encode("utf-8", "surrogatepass") for c in codes]


def unit_tokens(pieces: Pieces, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all units joined, and where each unit's begin."""
    texts = [u.decode("utf-8", "replace") for u in units]
    lengths = np.array([len(t) for t in texts])
    order = np.argsort(lengths, kind="stable")
    owners, places, tokens = [], [], []
    line = np.frombuffer("".join(texts[i] for i in order).encode("utf-32-le"), np.uint32).astype(np.uint64)
    line = np.where(line == BLANK, np.uint64(NEVER), np.where(line == 32, np.uint64(BLANK), line))
    begins = np.cumsum(lengths[order]) - lengths[order]
    at = 0
    while at < len(order):
        length = lengths[order[at]]
        same = int(np.searchsorted(lengths[order], length, side="right"))
        to = min(same, at + max(1, LANES // length))
        codes = line[begins[at] : begins[at] + (to - at) * length].reshape(to - at, length)
        back, piece = _best_ways(pieces, codes)
        rows, ends = np.arange(to - at), np.full(to - at, length)
        while len(rows):
            found = piece[rows, ends]
            ends = ends - back[rows, ends]
            owners.append(order[at + rows])
            places.append(ends * 4)
            # An unknown character is held as its negative code for now.
            tokens.append(np.where(found >= 0, pieces.ids[found], -1 - codes[rows, ends].astype(np.int64)))
            rows, ends = rows[ends > 0], ends[ends > 0]
        at = to
    owner, place, token = np.concatenate(owners), np.concatenate(places), np.concatenate(tokens)
    odd = np.flatnonzero(token < 0)
    if len(odd):
        as_bytes = _utf8(-1 - token[odd])
        n = np.array([len(b) for b in as_bytes])
        spread = np.repeat(odd, n)
        inside = np.arange(len(spread)) - np.repeat(np.cumsum(n) - n, n)
        more = pieces.of_byte[np.frombuffer(b"".join(as_bytes), np.uint8)]
        keep = token >= 0
        owner = np.concatenate([owner[keep], owner[spread]])
        place = np.concatenate([place[keep], place[spread] + inside])
        token = np.concatenate([token[keep], more])
    sequence = np.lexsort((place, owner))
    return token[sequence].astype(np.int32), np.searchsorted(owner[sequence], np.arange(len(units) + 1))


def tokens_of(pieces: Pieces, texts: pa.Array) -> pa.ListArray:
    """Token ids of each text. Each distinct unit is searched once."""
    data, offsets = bytes_of(texts)
    filled = np.diff(offsets) > 0
    data = np.insert(data, offsets[:-1][filled], 32)
    offsets = offsets + np.concatenate([[0], np.cumsum(filled)])
    blank, other = data == 32, WHITE[data] & (data != 32)
    cut = other.copy()
    cut[1:] |= other[:-1] | (blank[1:] & ~blank[:-1])
    cut[offsets[:-1][filled]] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(data))
    if not len(starts):
        return pa.ListArray.from_arrays(np.zeros(len(texts) + 1, np.int32), pa.array([], pa.int32()))
    _, first, inverse = np.unique(hashed(data, starts, ends), return_index=True, return_inverse=True)
    whole = data.tobytes()
    found, begins = unit_tokens(pieces, [whole[a:b] for a, b in zip(starts[first], ends[first])])
    n = np.diff(begins)[inverse]
    upto = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat(begins[inverse] - upto[:-1], n) + np.arange(upto[-1])
    bounds = upto[np.searchsorted(starts, offsets)]
    return pa.ListArray.from_arrays(bounds.astype(np.int32), found[at])


def texts_of(pieces: Pieces, tokens: pa.ListArray) -> pa.Array:
    """The text of each token list; bytes that are no UTF-8 become U+FFFD."""
    tokens = tokens.fill_null([]) if tokens.null_count else tokens
    ids = tokens.flatten().to_numpy()
    n = np.diff(pieces.offsets)[ids]
    upto = np.concatenate([[0], np.cumsum(n)])
    data = pieces.bytes[np.repeat(pieces.offsets[ids] - upto[:-1], n) + np.arange(upto[-1])]
    bounds = tokens.offsets.to_numpy()
    bounds = upto[bounds - bounds[0]]
    # The blank before the text goes.
    first = bounds[:-1][np.diff(bounds) > 0]
    first = first[data[first] == 32]
    gone = np.zeros(len(data) + 1, np.int64)
    gone[first + 1] = 1
    data, bounds = np.delete(data, first), bounds - np.cumsum(gone)[bounds]
    out = pa.Array.from_buffers(
        pa.large_binary(), len(tokens), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)]
    )
    try:
        return out.cast(pa.large_string())
    except pa.ArrowInvalid:
        return pa.array([b.decode("utf-8", "replace") for b in out.to_pylist()], pa.large_string())


def _added(df: DataFrame, new: dict[str, str], run, without: str | None = None) -> DataFrame:
    kept = [c for c in df.columns if c not in new and c != without]
    source = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in kept]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, *columns in run(batch):
                yield pa.record_batch([*[part.column(c) for c in kept], *columns], names=[*kept, *new])

    return df.mapInArrow(each, ", ".join([*source, *[f"`{name}` {kind}" for name, kind in new.items()]]))


def encode(
    docs: DataFrame, path: str = MODEL, text: str = "text", tokens: str = "tokens", most: int = BATCH_BYTES
) -> DataFrame:
    """``docs`` with the token ids of their texts, about ``most`` bytes at a time. The model is read on the driver alone."""
    held = docs.sparkSession.sparkContext.broadcast(load_pieces(path))

    def run(batch: pa.RecordBatch):
        for part in slices(batch, text, most):
            yield part, tokens_of(held.value, part.column(text))

    return _added(docs, {tokens: "array<int>"}, run)


def decode(df: DataFrame, path: str = MODEL, tokens: str = "tokens", decoded: str = "decoded") -> DataFrame:
    """``df`` with the texts of its token ids."""
    held = df.sparkSession.sparkContext.broadcast(load_pieces(path))

    def run(batch: pa.RecordBatch):
        for at in range(0, len(batch), 500):
            part = batch.slice(at, 500)
            yield part, texts_of(held.value, part.column(tokens)).cast(pa.string())

    return _added(df, {decoded: "string"}, run)


def encode_checked(
    docs: DataFrame,
    path: str = MODEL,
    text: str = "text",
    tokens: str = "tokens",
    lossless: str = "lossless",
    most: int = BATCH_BYTES,
) -> DataFrame:
    """``docs`` with token ids in place of their texts, and whether they decode to the text (an empty one for null).

    Encoded and decoded by one Python worker of a task, where ``encode`` and ``decode`` in a row take two at a time, and
    send all texts and tokens from the first to the second through the executor.
    """
    held = docs.sparkSession.sparkContext.broadcast(load_pieces(path))

    def run(batch: pa.RecordBatch):
        for part in slices(batch, text, most):
            texts = part.column(text).cast(pa.large_string())
            found = tokens_of(held.value, texts)
            yield part, found, pc.equal(texts_of(held.value, found), pc.fill_null(texts, ""))

    return _added(docs, {tokens: "array<int>", lossless: "boolean"}, run, without=text)
