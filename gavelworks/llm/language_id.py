"""Language of whole texts by a bidirectional gated recurrent network over bytes.

The network reads a word's bytes (A-Z lower-cased) forwards and backwards and labels every position with a probability
for each language. A text's probabilities are the mean over all positions of all its words. The state begins anew at
white space, so equal words get equal labels and each distinct word of a task is run once; a run of more than ``LONGEST``
bytes without white space is read in pieces of that length.

Training is backpropagation through time in numpy, on words of about ``SAMPLE`` texts of each language, at most
``WORDS`` words of each, taken evenly over the whole text.

Defined results: a null text, one without a letter, and every text when there is nothing to learn from have the language
``und`` and score 0. Of equally likely languages the first in order is taken. Rows that repeat get equal results. An
empty table gives an empty result. Only the three named columns are read, the language only for training.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelworks.llm.words import slices, words_of

SAMPLE = 300
WORDS = 120
LONGEST = 32
HIDDEN = 12
# Distinct words whose labels a task remembers.
REMEMBERED = 400_000
# Words that run through the network together.
LANES = 16_384
_HASH_SPACE = 1 << 30

Model = dict[str, np.ndarray]


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _gru(x: np.ndarray, lengths: np.ndarray, u: np.ndarray, keep: list | None = None) -> list[np.ndarray]:
    """States after each step, for inputs ``x`` (step, lane, 3 * hidden) already through the input weights.

    Columns are update gate, reset gate and candidate. Lanes past their length
    keep their state.
    """
    h = np.zeros((x.shape[1], HIDDEN), x.dtype)
    out = []
    for t in range(len(x)):
        gates = _sigmoid(x[t, :, : 2 * HIDDEN] + h @ u[:, : 2 * HIDDEN])
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        reset = r * h
        c = np.tanh(x[t, :, 2 * HIDDEN :] + reset @ u[:, 2 * HIDDEN :])
        live = (t < lengths)[:, None]
        new = np.where(live, h + z * (c - h), h)
        if keep is not None:
            keep.append((h, z, r, c, reset, live))
        h = new
        out.append(h)
    return out


def _turned(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each lane's first ``length`` steps in reverse order."""
    steps = np.arange(len(codes))[:, None]
    at = np.where(steps < lengths, lengths - 1 - steps, steps)
    return np.take_along_axis(codes, at, 0)


def _forward(model: Model, codes: np.ndarray, lengths: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Probabilities (step, lane, language) of every position."""
    back = _turned(codes, lengths)
    kept = {"f": [], "b": []} if keep is not None else {"f": None, "b": None}
    ahead = np.stack(_gru(model["wf"][codes], lengths, model["uf"], kept["f"]))
    behind = np.stack(_gru(model["wb"][back], lengths, model["ub"], kept["b"]))
    order = np.broadcast_to(_turned(np.arange(len(codes))[:, None] + 0 * codes, lengths)[:, :, None], behind.shape)
    both = np.concatenate([ahead, np.take_along_axis(behind, order, 0)], 2)
    logits = both @ model["v"] + model["b"]
    logits -= logits.max(2, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(2, keepdims=True)
    if keep is not None:
        keep.update(kept, back=back, order=order, both=both)
    return p


def _gru_slopes(kept: list, slopes: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slopes of the inputs (step, lane, 3 * hidden) and of ``u``, through time."""
    dx = np.zeros((len(kept), slopes.shape[1], 3 * HIDDEN), slopes.dtype)
    du = np.zeros_like(u)
    dh = np.zeros(slopes.shape[1:], slopes.dtype)
    for t in range(len(kept) - 1, -1, -1):
        h, z, r, c, reset, live = kept[t]
        total = dh + slopes[t]
        used = np.where(live, total, 0)
        dc = used * z * (1 - c * c)
        dz = used * (c - h) * z * (1 - z)
        dreset = dc @ u[:, 2 * HIDDEN :].T
        dr = dreset * h * r * (1 - r)
        gates = np.concatenate([dz, dr], 1)
        dx[t] = np.concatenate([gates, dc], 1)
        du[:, : 2 * HIDDEN] += h.T @ gates
        du[:, 2 * HIDDEN :] += reset.T @ dc
        dh = np.where(live, total * (1 - z) + dreset * r, total) + gates @ u[:, : 2 * HIDDEN].T
    return dx, du


def _slopes(model: Model, codes: np.ndarray, lengths: np.ndarray, goal: np.ndarray) -> Model:
    """Slopes of the mean cross entropy over all positions."""
    keep: dict = {}
    p = _forward(model, codes, lengths, keep)
    live = (np.arange(len(codes))[:, None] < lengths)[:, :, None]
    p[:, np.arange(len(goal)), goal] -= 1
    d = np.where(live, p, 0) / lengths.sum()
    both = keep["both"]
    out = {"v": np.einsum("tlh,tlk->hk", both, d), "b": d.sum((0, 1))}
    d = d @ model["v"].T
    behind = np.take_along_axis(d[:, :, HIDDEN:], keep["order"], 0)
    for side, seen, slope in (("f", codes, d[:, :, :HIDDEN]), ("b", keep["back"], behind)):
        dx, out["u" + side] = _gru_slopes(keep[side], slope, model["u" + side])
        dw = np.zeros_like(model["w" + side])
        np.add.at(dw, seen, dx)
        out["w" + side] = dw
    return out


def _packed(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of words of at most ``LONGEST`` bytes as (step, lane), and their lengths."""
    lengths = np.array([len(w) for w in words])
    line = np.frombuffer(b"".join(words), np.uint8)
    codes = np.zeros((int(lengths.max()), len(words)), np.int64)
    begins = np.cumsum(lengths) - lengths
    lane = np.repeat(np.arange(len(words)), lengths)
    codes[np.arange(len(line)) - begins[lane], lane] = line
    return codes, lengths


def train(words: list[bytes], goals: np.ndarray, languages: int, steps: int = 900, lanes: int = 256) -> Model:
    """Adam on batches of words of similar length."""
    rng = np.random.default_rng(5)
    draw = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
    model = {
        "wf": draw(256, 3 * HIDDEN),
        "wb": draw(256, 3 * HIDDEN),
        "uf": draw(HIDDEN, 3 * HIDDEN),
        "ub": draw(HIDDEN, 3 * HIDDEN),
        "v": draw(2 * HIDDEN, languages),
        "b": np.zeros(languages, np.float32),
    }
    order = np.argsort([len(w) for w in words], kind="stable")
    first = {k: np.zeros_like(w) for k, w in model.items()}
    second = {k: np.zeros_like(w) for k, w in model.items()}
    for t in range(1, steps + 1):
        at = order[rng.integers(0, max(1, len(words) - 4 * lanes)) :][: 4 * lanes]
        at = rng.choice(at, min(lanes, len(at)), replace=False)
        codes, lengths = _packed([words[i] for i in at])
        rate = 0.02 * (1 - t / (steps + 1))
        for k, slope in _slopes(model, codes, lengths, goals[at]).items():
            first[k] = 0.9 * first[k] + 0.1 * slope
            second[k] = 0.99 * second[k] + 0.01 * slope * slope
            model[k] -= rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-7)
    return model


def word_totals(model: Model, words: list[bytes]) -> np.ndarray:
    """Per word, the sum over its positions of each language's probability, in single precision."""
    pieces = [w[i : i + LONGEST] for w in words for i in range(0, len(w), LONGEST)]
    owner = np.repeat(np.arange(len(words)), [-(-len(w) // LONGEST) for w in words])
    totals = np.zeros((len(words), len(model["b"])), np.float32)
    order = np.argsort([len(p) for p in pieces], kind="stable")
    for at in range(0, len(order), LANES):
        some = order[at : at + LANES]
        codes, lengths = _packed([pieces[i] for i in some])
        p = _forward(model, codes, lengths)
        p[np.arange(len(codes))[:, None] >= lengths] = 0
        np.add.at(totals, owner[some], p.sum(0))
    return totals


def _sampled_words(docs: DataFrame, languages: DataFrame) -> pa.Table:
    """``lang, word`` of the sampled texts: at most ``WORDS`` of each, evenly spaced."""
    limit = F.lit(0)
    for row in languages.collect():  # one row for each language
        limit = F.when(F.col("lang") == row["lang"], min(_HASH_SPACE, _HASH_SPACE * SAMPLE // row["n"])).otherwise(limit)
    chosen = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(_HASH_SPACE)) < limit).select("lang", "text")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = words_of(part.column("text"))
                data = words.data.tobytes()
                names, out = [], []
                for i, lang in enumerate(part.column("lang").to_pylist()):
                    a, b = words.bounds[i], words.bounds[i + 1]
                    for j in np.unique(np.linspace(a, b - 1, min(WORDS, b - a)).astype(int)) if b > a else []:
                        names.append(lang)
                        out.append(data[words.starts[j] : words.ends[j]][:LONGEST])
                yield pa.record_batch([pa.array(names, pa.string()), pa.array(out, pa.binary())], names=["lang", "word"])

    return chosen.mapInArrow(take, "lang string, word binary").toArrow().sort_by([("lang", "ascending"), ("word", "ascending")])


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score``; the fifth of the ids that is held out is not learnt from."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id")) != 0))
    sample = _sampled_words(known, known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    names = sorted(set(sample["lang"].to_pylist()))
    goals = np.searchsorted(names, sample["lang"].to_pylist()) if names else np.zeros(0, int)
    model = train(sample["word"].to_pylist(), goals, len(names)) if len(names) > 1 else None
    held = docs.sparkSession.sparkContext.broadcast((names, model))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, model = held.value
        keys = np.zeros(0, np.uint64)
        values = np.zeros((0, len(names)), np.float32)
        for batch in batches:
            for part in slices(batch, "text"):
                words = words_of(part.column("text"))
                distinct, first, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
                fresh = ~np.isin(distinct, keys, assume_unique=True)
                if fresh.any() and model is not None:
                    data = words.data.tobytes()
                    at = first[fresh]
                    found = word_totals(model, [data[a:b] for a, b in zip(words.starts[at], words.ends[at])])
                    if len(keys) > REMEMBERED:
                        mine = np.isin(keys, distinct, assume_unique=True)
                        keys, values = keys[mine], values[mine]
                    keys, values = np.concatenate([keys, distinct[fresh]]), np.concatenate([values, found])
                    order = np.argsort(keys)
                    keys, values = keys[order], values[order]
                total = np.zeros((len(part), len(names)))
                lengths = words.ends - words.starts
                counts = np.diff(words.bounds)
                row = np.repeat(np.arange(len(part)), counts)
                if model is not None and len(row):
                    per_word = values[np.searchsorted(keys, distinct)][inverse]
                    for k in range(len(names)):
                        total[:, k] = np.bincount(row, per_word[:, k], minlength=len(part))
                positions = np.bincount(row, lengths, minlength=len(part))
                total /= np.maximum(positions, 1)[:, None]
                if len(names) == 1:
                    total[:] = 1.0
                sure = part.column("letters").to_numpy(zero_copy_only=False) & bool(names)
                best = total.argmax(1) if names else np.zeros(len(part), int)
                lang = [names[b] if s else "und" for b, s in zip(best, sure)]
                score = np.where(sure, total.max(1), 0.0) if names else np.zeros(len(part))
                columns = [part.column("doc_id"), pa.array(lang, pa.string()), pa.array(np.minimum(score, 1.0))]
                yield pa.record_batch(columns, names=["doc_id", "lang_pred", "score"])

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text", letters).mapInArrow(label, f"doc_id {id_type}, lang_pred string, score double")
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")
