"""Token counts by a deterministic transducer compiled from a piece model (BPE with byte fallback).

**States.** After reading a prefix, what the rest can still depend on is, for each suffix that may yet grow into a longer
piece: which piece ended where that suffix begins, and how many tokens lay before it. A state is that list in relative numbers.
Reading a character extends each suffix; exactly one of the extended suffixes is a piece that may follow the piece before it
(two pieces may stand side by side if merging their joined text gives back those two), and it becomes the last piece.
Its number of tokens, against the number before, annotates the transition. States and transitions are compiled when first met.

**Blanks.** Pieces of several blanks hold nothing else, and all of them merge after every other piece. A run of blanks is
thus counted by its length alone, but for its last blank, which may become part of the word that follows: the state after a run
offers both. As no piece goes on from a word into a blank, reading a blank after a word leads to one state, whatever came
before. Characters that no piece holds cost their UTF-8 bytes and lead to the start state.

**Chunks.** A text is cut into chunks of about ``CHUNK`` characters, at blanks where there are some. Each chunk has a map
from the state in which it is entered to the state in which it is left and the tokens emitted between. All chunks step
together as lanes of numpy arrays, one character a step. A lane enters in the state that its cut implies; where there is
no blank, in the state that a few characters before the cut lead to. The maps are then composed by a parallel prefix scan;
a chunk that is entered in another state than the one it was run from gets its map's value for that state, until none is left.
"""

from __future__ import annotations

import functools
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, texts_of

BLANK = "▁"
CHUNK = 256
#: Characters read before a cut without a blank, to guess the state there.
LEAD = 24
#: Cells of the transition table above which compilation starts anew.
MOST_CELLS = 24_000_000


class PieceModel:
    """Pieces and scores of a model file: merges take the highest score, then the leftmost."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        normal, user = 1, 4
        spec, norm = proto.trainer_spec, proto.normalizer_spec
        if spec.model_type != 2 or not spec.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or any(p.type == user for p in proto.pieces):
            raise ValueError("a BPE model with byte fallback, no normalisation and no user-defined pieces is needed")
        self.prefix = norm.add_dummy_prefix
        self.score = {p.piece: p.score for p in proto.pieces if p.type == normal}
        if any(BLANK in p.lstrip(BLANK) for p in self.score):
            raise ValueError("a piece goes on from a word into a blank")
        self.words = {p for p in self.score if p.strip(BLANK) or p == BLANK}
        self.starts = {p[:k] for p in self.words for k in range(1, len(p))}
        self.chars = {c for p in self.score for c in p}

    def merge(self, text: str) -> list[str]:
        """The pieces of ``text`` by the definition, best score first; a plain form for short texts."""
        parts: list[str | None] = list(text)
        after, before = [*range(1, len(parts)), -1], [-1, *range(len(parts) - 1)]
        heap: list = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (s := self.score.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-s, i, parts[i], parts[j], j))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, i, a, b, j = heapq.heappop(heap)
            if parts[i] != a or parts[j] != b or after[i] != j:
                continue
            parts[i], parts[j] = a + b, None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [p for p in parts if p is not None]


class Transducer:
    """``step``: state and symbol -> next state * 64 + tokens + 32, or -1 where not yet compiled."""

    START = 0
    PERIOD = 16

    def __init__(self, model: PieceModel):
        self.model = model
        self.beside: dict[tuple[str, str], bool] = {}
        f = [len(model.merge(BLANK * m)) for m in range(4 * self.PERIOD + 1)]
        if any(f[m + self.PERIOD] - f[m] != f[self.PERIOD] for m in range(3 * self.PERIOD)):
            raise ValueError("counts of blank runs do not repeat as expected")
        self.run = f
        #: Symbols 1 to 4: characters of so many bytes that no piece holds; 5: blank; others are given out as met.
        self.symbol = np.zeros(0x110000, np.uint16)
        cp = np.arange(0x110000)
        self.unknown = (1 + (cp > 0x7F) + (cp > 0x7FF) + (cp > 0xFFFF)).astype(np.uint16)
        self.known = np.zeros(0x110000, bool)
        self.known[[ord(c) for c in model.chars]] = True
        self._anew()

    def _anew(self) -> None:
        self.symbol = np.where(self.known, 0, self.unknown).astype(np.uint16)
        self.symbol[[ord(" "), ord(BLANK)]] = 5
        self.char_of = {5: BLANK}
        self.columns = 6
        self.keys: list[tuple] = []
        self.index: dict[tuple, int] = {}
        self.step = np.full((1024, 128), -1, np.int32)
        self._state((0, ((0, "", "", 0),)))

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        out = self.symbol[codes]
        if len(new := np.unique(codes[out == 0])):
            for c in new.tolist():
                self.symbol[c] = self.columns
                self.char_of[self.columns] = chr(c)
                self.columns += 1
            if self.columns > self.step.shape[1]:
                wide = np.full((self.step.shape[0], 1 << (self.columns - 1).bit_length()), -1, np.int32)
                wide[:, : self.step.shape[1]] = self.step
                self.step = wide
            out = self.symbol[codes]
        return out

    def _state(self, key: tuple) -> int:
        if (i := self.index.get(key)) is None:
            i = self.index[key] = len(self.keys)
            self.keys.append(key)
            if i >= len(self.step):
                self.step = np.concatenate([self.step, np.full_like(self.step, -1)])
        return i

    def may_follow(self, left: str, right: str) -> bool:
        """Whether the two pieces stand side by side after merging their joined text; "" is a place that no piece spans."""
        if not left:
            return True
        if (ok := self.beside.get((left, right))) is None:
            if len(self.beside) > 400_000:
                self.beside.clear()
            ok = self.beside[left, right] = self.model.merge(left + right) == [left, right]
        return ok

    def compile(self, state: int, symbol: int) -> None:
        """A state is (blanks before, modulo the period; ((length, suffix, piece that ended before the suffix, tokens before it relative to now), ...))."""
        blanks, entries = self.keys[state]
        if symbol <= 4:
            self._set(state, symbol, self.START, symbol)
            return
        char = self.char_of[symbol]
        if char == BLANK:
            now = blanks + 1
            emitted = self.run[now] - self.run[blanks]
            held = ((1, BLANK, "", self.run[now - 1] - self.run[now]), (0, "", BLANK, 0))
            self._set(state, symbol, self._state(((now - 1) % self.PERIOD + 1, held)), emitted)
            return
        last, count, grown = None, 0, []
        for length, suffix, before, tokens in entries:
            word = suffix + char
            if last is None and word in self.model.words and self.may_follow(before, word):
                last, count = word, tokens + 1
            if word in self.model.starts:
                grown.append((length + 1, word, before, tokens))
        if last is None:  # a character that pieces hold but that is none itself: it costs its bytes
            self._set(state, symbol, self.START, len(char.encode()))
            return
        held = (*((n, w, b, t - count) for n, w, b, t in grown), (0, "", last, 0))
        self._set(state, symbol, self._state((0, held)), count)

    def _set(self, state: int, symbol: int, to: int, tokens: int) -> None:
        self.step[state, symbol] = to * 64 + tokens + 32

    def run_lanes(self, symbols: np.ndarray, begin: np.ndarray, end: np.ndarray, enter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state left, tokens) of each lane: ``symbols[begin:end]`` entered in ``enter``."""
        order = np.argsort(begin - end, kind="stable")
        place, size, state = begin[order], (end - begin)[order], enter[order].astype(np.int64)
        tokens = np.zeros(len(order), np.int64)
        active = len(order) - np.searchsorted(size[::-1], np.arange(size[0] if len(size) else 0), side="right")
        for i, n in enumerate(active.tolist()):
            s, sym = state[:n], symbols[place[:n] + i]
            got = self.step[s, sym]
            while (missing := np.flatnonzero(got < 0)).size:
                for a, b in set(zip(s[missing].tolist(), sym[missing].tolist(), strict=True)):
                    self.compile(a, b)
                got = self.step[s, sym]
            state[:n] = got >> 6
            tokens[:n] += (got & 63) - 32
        out_state, out_tokens = np.empty_like(state), np.empty_like(tokens)
        out_state[order], out_tokens[order] = state, tokens
        return out_state, out_tokens

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        if self.step.size > MOST_CELLS:
            self._anew()
        shown = [(" " + t if self.model.prefix else t) if t else "" for t in texts]
        codes = np.frombuffer("".join(shown).encode("utf-32-le", "surrogatepass"), np.uint32)
        stops = np.cumsum([len(t) for t in shown])
        starts = stops - [len(t) for t in shown]
        total = np.zeros(len(texts), np.int64)
        if not len(codes):
            return total
        symbols = self.symbols(codes)
        # cuts: the first blank after a word at or behind each stride, else the stride itself
        blank = symbols == 5
        sync = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
        text_of, begin, sure = [], [], []
        for i, (a, z) in enumerate(zip(starts.tolist(), stops.tolist(), strict=True)):
            if a == z:
                continue
            stride = np.arange(a + CHUNK, z, CHUNK)
            near = np.searchsorted(sync, stride)
            at = sync[np.minimum(near, max(len(sync) - 1, 0))] if len(sync) else np.full(len(stride), -1)
            good = (near < len(sync)) & (at < np.minimum(stride + CHUNK, z))
            cut = np.where(good, at, stride)
            cut, first = np.unique(cut, return_index=True)
            begin.append(np.concatenate([[a], cut]))
            sure.append(np.concatenate([[True], good[first]]))
            text_of.append(np.full(len(cut) + 1, i))
        begin, sure, text_of = np.concatenate(begin), np.concatenate(sure), np.concatenate(text_of)
        end = np.concatenate([begin[1:], stops[-1:]])
        # A blank after a word, or a text's begin, leads on as from the start state; elsewhere a guess.
        enter = np.zeros(len(begin), np.int64)
        if len(guess := np.flatnonzero(~sure)):
            enter[guess] = self.run_lanes(symbols, np.maximum(begin[guess] - LEAD, begin[guess - 1]), begin[guess], np.zeros(len(guess), np.int64))[0]
        left, tokens = self.run_lanes(symbols, begin, end, enter)
        while True:
            joined, done = compose_maps(enter, left, tokens, sure, text_of)
            if done[ends := np.append(np.flatnonzero(np.diff(text_of)), len(text_of) - 1)].all():
                break
            # chunks whose map isn't known yet at the state in which the chunk before is left
            wrong = np.flatnonzero(~sure & (np.concatenate([[0], left[:-1]]) != enter))
            enter[wrong] = left[wrong - 1]
            left[wrong], tokens[wrong] = self.run_lanes(symbols, begin[wrong], end[wrong], enter[wrong])
        total[text_of[ends]] = joined[ends]
        return total


def compose_maps(enter, left, tokens, sure, text_of) -> tuple[np.ndarray, np.ndarray]:
    """(tokens from the text's begin to the end of each chunk, whether that is defined): an inclusive prefix scan.

    A chunk's map is known at one state (``enter``), and at every state where the cut is ``sure``. Maps of neighbouring ranges
    of chunks compose where the first is left in a state at which the second is known. Each of log2(n) rounds doubles the ranges.
    """
    n = len(enter)
    leave, count, ok = left.copy(), tokens.copy(), np.ones(n, bool)
    known_at, anywhere, head = enter.copy(), sure.copy(), np.concatenate([[True], text_of[1:] != text_of[:-1]])
    gap = 1
    while gap < n:
        b, a = np.flatnonzero(~head), None
        b = b[b >= gap]
        if not len(b):
            break
        a = b - gap
        fits = ok[a] & ok[b] & (anywhere[b] | (leave[a] == known_at[b]))
        new = count[a] + count[b], known_at[a], anywhere[a], head[a]
        ok[b], (count[b], known_at[b], anywhere[b], head[b]) = fits, new
        gap *= 2
    return count, ok


@functools.lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    """One for each Python worker."""
    return Transducer(PieceModel(path))


def count_tokens(docs: DataFrame, path: str, *, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of ``docs``.

    Row by row, without a shuffle. A null text counts as empty (0 bytes, 0 tokens); repeated rows stay repeated, an
    empty table gives an empty result. Only doc_id and text are read, so other columns can't clash.
    """

    def run(batches):
        counter = transducer(path)
        for b in slices(batches, 1024, 3_000_000):
            texts = texts_of(b, "text")
            n = counter.count(texts)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
