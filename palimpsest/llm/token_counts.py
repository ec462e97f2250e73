"""Token counts by finite-state transduction.

The tokenizer file is compiled into deterministic transducers, and texts run through them in lanes: a
stream is cut into chunks of equal length that advance together, one table lookup a character.

1. Pre-tokenisation. A machine of five states reads character classes. A chunk's effect is a map of states to
   states; the maps form a small monoid, so a chunk's map is one element, found by one lookup a character, and the
   maps of all chunks compose in a parallel prefix scan. With its entry state known, a second pass marks where
   pre-tokens begin.
2. Merging. The pieces' bytes run through a transducer whose transitions carry the change in the number of tokens.
   Its states are what the merges can still see of a piece: the bytes that some token may yet continue, and the
   last token at each of those places. States and transitions are compiled when first met and kept in a dense
   table. A piece's last byte resets the state, so a chunk's map is constant behind its first piece end; only the
   bytes before that end depend on the entry state, and they are run when the scan has found it.

Defined results: a null text counts as empty and has no token; special strings inside a text count as one token
each, as the library has them; a null id stays null; repeated rows give repeated rows; an empty table gives an
empty one; a text of any length is taken whole, in lanes; further columns are dropped.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .shared import id_and_text
from .vocab import byte_alphabet, read

#: Characters that run at once, bytes in a lane, states kept before the table is started afresh.
BLOCK, LANE, STATES = 1 << 21, 256, 1 << 17

# Classes of characters: white space, letter, number, other, and an apostrophe that begins a contraction of two or three characters.
W, L, N, O, A2, A3 = range(6)
# States of the pre-tokeniser: between pieces, in letters, in others, one and two characters left of a contraction.
FREE, LETTERS, OTHERS, ONE, TWO = range(5)


def next_state(state: int, c: int) -> tuple[int, bool]:
    """The state after a character of a class, and whether a piece begins at that character."""
    if state == TWO:
        return ONE, False
    if state == ONE:
        return FREE, False
    if state == LETTERS and c == L:
        return LETTERS, False
    if state == OTHERS and c in (O, A2, A3):
        return OTHERS, False
    return {W: (FREE, False), L: (LETTERS, True), N: (FREE, True), O: (OTHERS, True), A2: (ONE, True), A3: (TWO, True)}[c]


@lru_cache(maxsize=1)
def pre_tokenizer() -> tuple[np.ndarray, ...]:
    """next and begins by state and class; the monoid: element after a class, product, and state by element."""
    step = np.array([[next_state(s, c)[0] for c in range(6)] for s in range(5)], dtype=np.uint8)
    begins = np.array([[next_state(s, c)[1] for c in range(6)] for s in range(5)], dtype=bool)
    elements = [tuple(range(5))]
    index = {elements[0]: 0}
    for e in elements:  # grows while it is walked
        for c in range(6):
            f = tuple(int(step[s, c]) for s in e)
            if f not in index:
                index[f] = len(elements)
                elements.append(f)
    after = np.array([[index[tuple(int(step[s, c]) for s in e)] for c in range(6)] for e in elements], dtype=np.uint8)
    product = np.array([[index[tuple(b[s] for s in a)] for b in elements] for a in elements], dtype=np.uint8)
    return step, begins, after, product, np.array(elements, dtype=np.uint8)


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class by code point, apostrophes as other."""
    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "" for c in range(0x110000))
    out = np.full(0x110000, O, dtype=np.uint8)
    for pattern, c in ((r"\p{White_Space}+", W), (r"\p{L}+", L), (r"\p{N}+", N)):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = c
    return out


def piece_starts(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a pre-token begins at each character, and whether it is white space."""
    step, begins, after, product, elements = pre_tokenizer()
    c = classes()[codes]
    (quote,) = (codes == 0x27).nonzero()
    if len(quote):
        padded = np.concatenate([codes, np.zeros(2, codes.dtype)])
        one, two = padded[quote + 1], padded[quote + 2]
        c[quote[np.isin(one, [ord(x) for x in "stmd"])]] = A2
        for a, b in ("re", "ve", "ll"):
            c[quote[(one == ord(a)) & (two == ord(b))]] = A3
    n, width = len(c), 256
    lanes = -(-n // width)
    grid = np.full((lanes, width), W, dtype=np.uint8)
    grid.ravel()[:n] = c
    columns = np.ascontiguousarray(grid.T)
    element = np.zeros(lanes, dtype=np.uint8)
    for k in range(width):
        element = after[element, columns[k]]
    shift = 1
    while shift < lanes:  # inclusive prefix scan of the chunks' maps
        element[shift:] = product[element[:-shift], element[shift:]]
        shift *= 2
    state = np.full(lanes, FREE, dtype=np.uint8)
    state[1:] = elements[element[:-1], FREE]
    marks = np.empty((width, lanes), dtype=bool)
    for k in range(width):
        marks[k] = begins[state, columns[k]]
        state = step[state, columns[k]]
    return np.ascontiguousarray(marks.T).ravel()[:n], c == W


class Merges:
    """The merging transducer of a vocabulary whose pieces end in a suffix (or in nothing)."""

    def __init__(self, model: dict):
        alphabet = byte_alphabet()
        self.symbol = {b: c for c, b in alphabet.items()}
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab = model["vocab"]
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): k for k, m in enumerate(model["merges"])}
        plain = [t for t in self.vocab if not (self.suffix and t.endswith(self.suffix))]
        self.longest = max(map(len, plain), default=1)
        stems = {t[: -len(self.suffix)] if self.suffix and t.endswith(self.suffix) else t for t in self.vocab}
        self.prefixes = {t[:k] for t in stems for k in range(1, len(t))}  # what some token may continue
        self.longest = max(map(len, stems), default=1)
        self.agree: dict[tuple[str, str], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.states: dict[tuple, int] = {("", ()): 0}
        self.of: list[tuple] = [("", ())]
        self.column = np.full(256, -1, dtype=np.int32)
        self.columns = 0
        self.next = np.full((1024, 32), -1, dtype=np.int32)
        self.delta = np.zeros((1024, 32), dtype=np.int16)
        self.final = np.full((1024, 32), np.iinfo(np.int16).min, dtype=np.int16)

    def merge(self, symbols: list[str]) -> list[str]:
        """Plain merging: the pair of the least rank first, the leftmost of its places."""
        while len(symbols) > 1:
            best = min(((self.rank.get(p, 1 << 40), k) for k, p in enumerate(zip(symbols, symbols[1:], strict=False))), default=(1 << 40, 0))
            if best[0] == 1 << 40:
                break
            k = best[1]
            symbols = [*symbols[:k], symbols[k] + symbols[k + 1], *symbols[k + 2 :]]
        return symbols

    def apart(self, token: str) -> list[str]:
        if self.suffix and token.endswith(self.suffix):
            stem = token[: -len(self.suffix)]
            return [*stem[:-1], stem[-1] + self.suffix]
        return list(token)

    def whole(self, token: str) -> bool:
        return self.fits("", token)

    def fits(self, before: str, token: str) -> bool:
        """Whether the two stay two tokens (or the one stays one) when their characters are merged afresh."""
        found = self.agree.get((before, token))
        if found is None:
            found = self.merge([*self.apart(before), *self.apart(token)]) == [x for x in (before, token) if x]
            if len(self.agree) > 1 << 20:
                self.agree.clear()
            self.agree[before, token] = found
        return found

    def last(self, state: tuple, char: str, suffix: str) -> tuple[str, int]:
        """The last token once a character follows, and the number of tokens relative to the state's.

        A state is the visible bytes and, for each place from before the first of them to after the last, the token
        that ends there (or "" at the piece's start) with the number of tokens so far relative to the latest place.
        """
        seen, places = state
        for k in range(min(len(seen), self.longest - 1), -1, -1):  # k characters of what is seen join the new one
            token = seen[len(seen) - k :] + char + suffix
            before, count = places[len(places) - 1 - k] if places else ("", 0)
            if token in self.vocab and self.fits(before, token):
                return token, count + 1
        raise ValueError(f"no token for {char!r}")

    def follow(self, s: int, byte: int) -> None:
        """Compiles the transition of a state by a byte that doesn't end the piece."""
        state = self.of[s]
        seen, places = state
        char = self.symbol[byte]
        token, change = self.last(state, char, "")
        chars = seen + char
        held = [*(places or [("", 0)]), (token, change)]
        keep = 0
        for k in range(min(len(chars), self.longest - 1), 0, -1):  # the longest suffix that some token continues
            if chars[-k:] in self.prefixes:
                keep = k
                break
        chars, held = chars[len(chars) - keep :], held[len(held) - 1 - keep :]
        new = (chars, tuple((t, n - change) for t, n in held))
        at = self.states.get(new)
        if at is None:
            at = len(self.of)
            self.states[new] = at
            self.of.append(new)
            if at >= len(self.next):
                self.next = np.concatenate([self.next, np.full_like(self.next, -1)])
                self.delta = np.concatenate([self.delta, np.zeros_like(self.delta)])
                self.final = np.concatenate([self.final, np.full_like(self.final, np.iinfo(np.int16).min)])
        self.next[s, self.column[byte]] = at
        self.delta[s, self.column[byte]] = change

    def finish(self, s: int, byte: int) -> None:
        """Compiles what the last byte of a piece adds."""
        self.final[s, self.column[byte]] = self.last(self.of[s], self.symbol[byte], self.suffix)[1]

    def add_columns(self, data: np.ndarray) -> None:
        for byte in np.unique(data).tolist():
            if self.column[byte] < 0:
                self.column[byte] = self.columns
                self.columns += 1
                if self.columns > self.next.shape[1]:
                    self.next = np.concatenate([self.next, np.full_like(self.next, -1)], axis=1)
                    self.delta = np.concatenate([self.delta, np.zeros_like(self.delta)], axis=1)
                    self.final = np.concatenate([self.final, np.full_like(self.final, np.iinfo(np.int16).min)], axis=1)

    def advance(self, state: np.ndarray, byte: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of all lanes: their next states and the change in their token counts."""
        col = self.column[byte]
        to = self.next[state, col]
        change = self.delta[state, col].astype(np.int32)
        if ends.any():
            (e,) = ends.nonzero()
            done = self.final[state[e], col[e]]
            (new,) = (done == np.iinfo(np.int16).min).nonzero()
            if len(new):
                for s, b in {(int(state[e[k]]), int(byte[e[k]])) for k in new}:
                    self.finish(s, b)
                done = self.final[state[e], col[e]]
            to[e], change[e] = 0, done
        (new,) = (to < 0).nonzero()
        if len(new):
            for s, b in {(int(state[k]), int(byte[k])) for k in new}:
                self.follow(s, b)
            to[new] = self.next[state[new], col[new]]
            change[new] = self.delta[state[new], col[new]]
        return to, change

    def counts(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The change in the number of tokens at each byte of a stream of pieces, of which ``ends`` marks the last bytes."""
        if len(self.of) > STATES:
            self.reset()
        self.add_columns(data)
        n = len(data)
        lanes = -(-n // LANE)
        grid = np.zeros((lanes, LANE), dtype=np.uint8)
        grid.ravel()[:n] = data
        stop = np.zeros((lanes, LANE), dtype=bool)
        stop.ravel()[:n] = ends
        stop.ravel()[n:] = True  # padding: pieces of one byte, cut off below
        grid.ravel()[n:] = data[0] if n else 0
        has = stop.any(axis=1)
        head = np.where(has, stop.argmax(axis=1) + 1, LANE)  # bytes that depend on the entry state
        head[0] = 0
        grid_t, stop_t = np.ascontiguousarray(grid.T), np.ascontiguousarray(stop.T)
        out = np.zeros((LANE, lanes), dtype=np.int32)
        leaving = np.zeros(lanes, dtype=np.int32)
        for k in range(LANE):
            (run,) = (head <= k).nonzero()
            if len(run):
                leaving[run], out[k, run] = self.advance(leaving[run], grid_t[k, run], stop_t[k, run])
        # heads: lanes behind one whose leaving state is known; a lane without a piece end passes its state on
        (todo,) = (head > 0).nonzero()
        known = has.copy()
        known[0] = True
        while len(todo):
            now = todo[known[todo - 1]]
            state, length = leaving[now - 1].copy(), head[now]
            for k in range(int(length.max())):
                (run,) = (length > k).nonzero()
                state[run], out[k, now[run]] = self.advance(state[run], grid_t[k, now[run]], stop_t[k, now[run]])
            whole = ~has[now]
            leaving[now[whole]] = state[whole]
            known[now] = True
            todo = np.setdiff1d(todo, now, assume_unique=True)
        return np.ascontiguousarray(out.T).ravel()[:n]


class Counter:
    """Counts the tokens of texts by a tokenizer file whose steps are these; others are refused."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        parts = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        split = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0].get("pattern", {}).get("Regex")
        if parts != ["NFC", "Replace", "Lowercase"] or split != r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+":
            raise ValueError("this kind of tokenizer file has no compiled pre-tokeniser")
        self.merges = Merges(spec["model"])
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.marks = special

    def normal(self, text: str) -> tuple[str, int]:
        """The normalised text, and how many special strings were taken out of it."""
        taken = 0
        if self.special and any(m in text for m in self.marks):
            text, taken = self.special.subn("\n", text)  # white space parts what stands on either side
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower case without regard to context
        return text.lower(), taken

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        out = np.zeros(len(texts), dtype=np.int64)
        block: list[str] = []
        first = size = 0
        for k, text in enumerate(texts):
            text, out[k] = self.normal(text)
            block.append(text)
            size += len(text) + 1
            if size >= BLOCK:
                out[first : k + 1] += self._block(block)
                block, first, size = [], k + 1, 0
        if block:
            out[first:] += self._block(block)
        return out

    def _block(self, texts: list[str]) -> np.ndarray:
        whole = "\n".join(texts) + "\n"
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        starts, white = piece_starts(codes)
        owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
        boundary = np.empty(len(codes), dtype=bool)  # the next character begins another piece or is white space
        boundary[:-1] = starts[1:] | white[1:]
        boundary[-1] = True
        inside = ~white
        wide = np.ones(len(codes), dtype=np.int8)
        for limit in (0x80, 0x800, 0x10000):
            wide += codes >= limit
        width = wide[inside]
        data = np.frombuffer(whole.encode(), dtype=np.uint8)[np.repeat(inside, wide)]
        if not len(data):
            return np.zeros(len(texts), dtype=np.int64)
        ends = np.zeros(len(data), dtype=bool)
        last = np.cumsum(width, dtype=np.int64) - 1
        ends[last] = boundary[inside]
        counts = self.merges.counts(data, ends)
        return np.bincount(np.repeat(owner[inside], width), counts, len(texts)).astype(np.int64)


@lru_cache(maxsize=2)
def counter(data: bytes) -> Counter:
    return Counter(data)


class Count:
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def __init__(self, data: bytes):
        self.data = data

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(self.data)
        for batch in batches:
            texts = batch.column("text")
            n_bytes = np.asarray([len(t.as_buffer()) if t.as_buffer() is not None else 0 for t in texts], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_bytes), pa.array(c.count(texts.to_pylist()))], schema=self.schema)


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every whole text."""
    return id_and_text(docs, id_col, text_col).mapInArrow(Count(read(tokenizer_path)), "doc_id long, n_bytes long, n_tokens long")
