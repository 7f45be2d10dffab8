"""Token counts by a tokenizer compiled into a finite-state transducer.

A vocabulary of merges over bytes gives every word one list of tokens. Two facts make it a transducer: the tokens of a
beginning of a word are a list of their own, and a list is the right one when each pair of neighbours is, that is, when
merging the two tokens' bytes gives just these two. So the last token of a word's first ``i + 1`` bytes is the one that ends
there and stands right behind the last token of what it leaves. A state keeps what that needs: the longest end of the read
bytes that begins some token, and for each place in it the last token and how many tokens there were. There are finitely
many such states; those that texts reach are compiled, each transition with the change in the number of tokens, which may
be negative where tokens fuse. The last byte of a word is a symbol of its own and leads back to the first state.

All words of many texts are one stream of symbols, cut into chunks of ``CHUNK``. A chunk's state map sends the state at its
start to the state at its end and to a count; behind the chunk's first word end it is constant. Chunks advance together, a
symbol a step: first everything behind the first word ends, then what lies before them from the states that the scan
composes from the chunks to the left. Chunks inside one long word start from a guess; the scan runs again for those whose
start turned out otherwise, until every chunk starts where its left neighbour ends, which proves all of them.

Normalisation and words are those of the vocabulary's file: special strings first, then NFC and lower case by character,
then contractions, runs of letters, single digits and runs of other characters. A file that asks for anything else is
refused. Character classes are those of Python's Unicode tables.

Null and empty texts have no tokens. Each row is counted by itself, so repeated rows have equal counts; all columns stay but
one named ``n_tokens``, which is replaced; no rows give none. A text is counted in parts of about ``BATCH_BYTES`` bytes, cut
before a blank; only a longer run without blanks is held whole.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gavelworks.llm.words import slices
from gavelworks.session import spread

VOCABULARY = "word_bpe_49k.json"
CHUNK = 64
BATCH_BYTES = 1_000_000
# Tables are made anew when they have grown beyond this, before the next texts.
TABLE_BYTES = 128 << 20
END = "</w>"
ROOT = 0
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
# White space of Unicode, as the pattern's \s has it (fixed values).
_SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# What the file has to ask for (fixed values).
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def letters_of_bytes() -> list[str]:
    """How the vocabulary spells each byte: printable ones as they are, others by the next free code points."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    spelled = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [spelled[b] for b in range(256)]


def _classes() -> np.ndarray:
    kinds = {"L": _LETTER, "N": _NUMBER}
    out = np.array([kinds.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)], np.uint8)
    out[_SPACES] = _SPACE
    return out


class Transducer:
    """States and transitions as far as texts have asked for them."""

    def __init__(self, file: str):
        spec = json.loads(file)
        model, normalizer, pre = spec["model"], spec["normalizer"], spec["pre_tokenizer"]["pretokenizers"]
        asked = (
            [n["type"] for n in normalizer["normalizers"]],
            [p["type"] for p in pre],
            pre[0]["pattern"]["Regex"],
            model["type"],
            model["end_of_word_suffix"],
        )
        if asked != (_NORMALIZERS, ["Split", "ByteLevel"], _PATTERN, "BPE", END):
            raise ValueError("not a vocabulary of lower-case words with ends")
        added = spec["added_tokens"]
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("special tokens must stand for their exact strings")
        self.specials = re.compile("|".join(re.escape(t["content"]) for t in added)) if added else None
        self.tokens = set(model["vocab"])
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(model["merges"])}
        self.letters = letters_of_bytes()
        if not all(c in self.tokens and c + END in self.tokens for c in self.letters):
            raise ValueError("every byte needs a token, with and without a word end")
        self.begins = {""}
        for token in self.tokens:
            bare = token.removesuffix(END)
            self.begins.update(bare[:i] for i in range(1, len(bare)))
        self.classes = _classes()
        self.stays: dict[tuple[str, str], bool] = {}
        self.forget()

    # -------------------------------------------------------------- compiling

    def forget(self) -> None:
        """Only the first state, with no transitions. Pairs known to stay are kept up to a bound."""
        if len(self.stays) > 1 << 20:
            self.stays.clear()
        self.column = np.full(512, -1, np.int64)  # of each symbol that texts have used
        self.used: list[int] = []
        self.states: list[tuple] = [("", (None,), (0,))]
        self.number = {self.states[0]: ROOT}
        self.next = np.full((1024, 128), -1, np.int32)
        self.emits = np.zeros((1024, 128), np.int16)

    def _grow(self, axis: int) -> None:
        shape = list(self.next.shape)
        shape[axis] *= 2
        for name, blank in (("next", -1), ("emits", 0)):
            old = getattr(self, name)
            new = np.full(shape, blank, old.dtype)
            new[: old.shape[0], : old.shape[1]] = old
            setattr(self, name, new)

    def merged(self, symbols: list[str]) -> list[str]:
        """The tokens of a word by its merges, the best rank first and the leftmost of equal ones."""
        symbols = list(symbols)
        while len(symbols) > 1:
            rank, at = min((self.ranks.get(pair, 1 << 60), i) for i, pair in enumerate(zip(symbols, symbols[1:])))
            if rank == 1 << 60:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def _symbols(self, token: str) -> list[str]:
        bare = token.removesuffix(END)
        out = list(bare)
        if bare != token:
            out[-1] += END
        return out

    def right_behind(self, before: str | None, token: str) -> bool:
        """Whether the two tokens stay what they are side by side; alone, for a token that begins the word."""
        key = (before or "", token)
        if key not in self.stays:
            if before is None:
                self.stays[key] = self.merged(self._symbols(token)) == [token]
            else:
                self.stays[key] = self.merged([*before, *self._symbols(token)]) == [before, token]
        return self.stays[key]

    def compile(self, state: int, symbol: int) -> None:
        """The transition of a state by a byte, or by a word's last byte from 256 on."""
        end, lasts, counts = self.states[state]
        letter = self.letters[symbol & 255]
        mark = END if symbol > 255 else ""
        for k in range(len(end) + 1):
            token = end[k:] + letter + mark
            if token in self.tokens and self.right_behind(lasts[k], token):
                break
        else:
            raise AssertionError(f"no token ends {end + letter + mark!r}")
        change = counts[k] + 1
        if mark:
            to = ROOT
        else:
            longer = end + letter
            cut = next(i for i in range(len(longer) + 1) if longer[i:] in self.begins)
            key = (longer[cut:], (*lasts, token)[cut:], tuple(c - change for c in (*counts, change))[cut:])
            to = self.number.get(key, -1)
            if to < 0:
                to = self.number[key] = len(self.states)
                self.states.append(key)
                if to == len(self.next):
                    self._grow(0)
        at = self.column[symbol]
        self.next[state, at], self.emits[state, at] = to, change

    # -------------------------------------------------------------- reading

    def columns(self, symbols: np.ndarray) -> np.ndarray:
        """Symbols as columns of the tables; column 0 is no symbol, where a chunk's state stays."""
        present = np.zeros(513, bool)
        present[symbols] = True
        for s in np.flatnonzero(present[:512] & (self.column < 0)):
            self.used.append(int(s))
            self.column[s] = len(self.used)
            if len(self.used) == self.next.shape[1]:
                self._grow(1)
        return np.concatenate([self.column, [0]])[symbols]

    def step(self, states: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and emitted counts, compiling what is missing."""
        to = self.next[states, columns]
        if (to < 0).any():
            missing = np.flatnonzero(to < 0)
            for key in np.unique(states[missing] * 1024 + columns[missing]).tolist():
                self.compile(key >> 10, self.used[(key & 1023) - 1])
            to = self.next[states, columns]
        return to.astype(np.int64), self.emits[states, columns]

    def run(self, columns: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The chunks (one a column of the array) from the given states: states at the end, and what each symbol emits."""
        emitted, states = np.zeros(columns.shape, np.int16), states.copy()
        for i, row in enumerate(columns):
            lanes = np.flatnonzero(row)
            if len(lanes):
                states[lanes], emitted[i, lanes] = self.step(states[lanes], row[lanes])
        return states, emitted

    def emitted(self, symbols: np.ndarray) -> np.ndarray:
        """What each symbol of a stream emits; the stream begins at the first state."""
        if self.next.nbytes + self.emits.nbytes > TABLE_BYTES:
            self.forget()
        n = len(symbols)
        if not n:
            return np.zeros(0, np.int64)
        chunks = -(-n // CHUNK)
        stream = np.full(chunks * CHUNK, 512)
        stream[:n] = symbols
        columns = self.columns(stream).reshape(chunks, CHUNK).T.copy()
        last = ((stream > 255) & (stream < 512)).reshape(chunks, CHUNK).T
        # Behind a chunk's first word end its map is constant.
        head = np.where(last.any(0), last.argmax(0) + 1, CHUNK)
        behind = np.arange(CHUNK)[:, None] >= head
        ends, out = self.run(np.where(behind, columns, 0), np.zeros(chunks, np.int64))
        heads = np.where(behind, 0, columns)
        constant = head < CHUNK
        constant |= last[-1]
        begins = np.concatenate([[ROOT], np.where(constant, ends, ROOT)[:-1]])
        again = np.arange(chunks)
        while len(again):
            reached, more = self.run(heads[:, again], begins[again])
            out[:, again] = np.where(behind[:, again], out[:, again], more)
            right = again[~constant[again]] + 1
            found = reached[~constant[again]]
            inner = right < chunks
            right, found = right[inner], found[inner]
            changed = begins[right] != found
            begins[right] = found
            again = right[changed]
        return out.T.reshape(-1)[:n].astype(np.int64)

    def symbols(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The words of a normalised text as symbols, and the place of each symbol's character."""
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        if not len(codes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        kind = np.concatenate([[_SPACE], self.classes[codes], [_SPACE] * 3])
        code = np.concatenate([[0], codes, [0, 0, 0]])
        here, before = kind[1:-3], kind[:-4]
        starts = (here != _SPACE) & ((here != before) | (here == _NUMBER))
        # 's 't 'm 'd, 're 've 'll: the apostrophe alone between others, and its letters begin no word.
        quote = (code[1:-3] == 0x27) & starts & (kind[2:-2] == _LETTER)
        second, third = code[2:-2], code[3:-1]
        short = quote & np.isin(second, [ord(c) for c in "stmd"])
        long = quote & (
            ((second == ord("r")) & (third == ord("e")))
            | ((second == ord("v")) & (third == ord("e")))
            | ((second == ord("l")) & (third == ord("l")))
        )
        for which, length in ((short, 1), (long, 2)):
            at = np.flatnonzero(which)
            starts[at + 1] = False
            after = at + length + 1
            after = after[after < len(starts)]
            starts[after[here[after] == _LETTER]] = True
        ends = (here != _SPACE) & np.concatenate([starts[1:] | (here[1:] == _SPACE), [True]])
        data = np.frombuffer(text.encode(), np.uint8)
        first = (data & 0xC0) != 0x80
        char = np.cumsum(first) - 1
        final = np.concatenate([first[1:], [True]]) & ends[char]
        kept = here[char] != _SPACE
        return (data + 256 * final.astype(np.int64))[kept], char[kept]

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        out = np.zeros(len(texts), np.int64)
        parts, rows = [], []
        for row, text in enumerate(texts):
            plain = [text]
            if self.specials is not None and "<" in text:
                plain = self.specials.split(text)
                out[row] += len(plain) - 1
            for part in plain:
                if part:
                    # Lower case is by character: no final sigma.
                    parts.append(unicodedata.normalize("NFC", part).replace("Σ", "σ").lower())
                    rows.append(row)
        if parts:
            symbols, char = self.symbols("\n".join(parts))
            offsets = np.cumsum([0, *[len(p) + 1 for p in parts]])
            row = np.array(rows)[np.searchsorted(offsets, char, side="right") - 1]
            out += np.bincount(row, self.emitted(symbols), len(texts)).astype(np.int64)
        return out.tolist()


_HERE: dict[int, Transducer] = {}


def _transducer(file) -> Transducer:
    """One for each Python worker and vocabulary; what it has compiled serves later tasks too."""
    key = hash(file.value)
    if key not in _HERE:
        _HERE.clear()
        _HERE[key] = Transducer(file.value)
    return _HERE[key]


def _parts(text: str, most: int) -> list[str]:
    """A long text cut before blanks, where no word, special string or composition goes on."""
    if len(text) <= most:
        return [text]
    out, at = [], 0
    while len(text) - at > most:
        blank = text.find(" ", at + most)
        line = text.find("\n", at + most, blank if blank >= 0 else len(text))
        cut = line if line >= 0 else blank
        if cut < 0:
            break
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


def count_tokens(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """The rows with ``n_tokens``, the number of tokens of their text by the vocabulary file at ``path``."""
    with open(path or public_path(VOCABULARY), encoding="utf-8") as f:
        file = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: a few megabytes
    docs = docs.drop("n_tokens")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _transducer(file)
        for batch in batches:
            for part in slices(batch, text, BATCH_BYTES):
                texts = [t or "" for t in part.column(text).to_pylist()]
                if len(texts) == 1:
                    n = [sum(counter.count([p])[0] for p in _parts(texts[0], BATCH_BYTES))]
                else:
                    n = counter.count(texts)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(n, pa.int64())], names=[*part.schema.names, "n_tokens"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return spread(docs).mapInArrow(count, f"{kept}, n_tokens long")
