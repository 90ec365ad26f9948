"""Token counts by a compiled finite-state tokenizer.

A byte-pair vocabulary with scores (SentencePiece BPE with byte fallback) is read as a deterministic
transducer. A state says what the rest of a text can depend on: the longest suffix that still starts
a piece, the last token of the tokenisation at each place where such a piece could start, and the
number of tokens there against the number here. Each transition carries the change in the number of
emitted tokens, so the sum along a path is the token count. Transitions are compiled when first met.

The step uses a property of byte-pair merges: a row of tokens is the tokenisation of its text if and
only if every pair of neighbours is, taken alone, the tokenisation of its two tokens' text. So the
last token of a prefix is the one piece that ends it and gets on with the last token before it.

A cut is a mark of white space that follows another character: no piece goes across it (checked on
compiling), so the state after it is the same whatever came before. Words between cuts are counted
once per distinct word of a batch and summed by index.

Longer texts are chunks of CHUNK_CHARS characters. The map of a chunk (``ChunkMap``) leads from each
entry state to (exit state, tokens). Its entry states are those that the LOOK_BACK characters before
the chunk can lead to: one if they have a cut, else those of a run from each of the last places where
a token could start. Maps compose associatively; a chunk's map is made without the chunks before it.
A text of more than ``long_bytes`` bytes is dealt to tasks chunk by chunk, and its maps are composed
in a scan of three rounds of SCAN maps each (SCAN ** 3 chunks are above the longest text that Spark
holds). If a composed map lacks the start state, as no run from those places led to the true entry
state, the text is counted again from left to right. Both ways give the library's number.

Nulls count as empty; an empty text has no tokens. Repeated rows are counted each; a long text that
many rows hold is counted once. Other columns are kept as they are. An empty table gives no rows.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.llm.common import settle, ship, slices, together

SPACE = "▁"
#: Characters of one chunk; longer texts become several chunk maps.
CHUNK_CHARS = 1 << 16
#: Characters before a chunk from which its entry states follow.
LOOK_BACK = 64
#: UTF-8 bytes beyond which the chunks of a text are dealt to tasks, and maps composed by one of them.
LONG_BYTES, SCAN = 1 << 22, 64
#: Bytes of texts whose words are split at a time.
STEP_BYTES = 1 << 22
#: Characters of a word, in classes, and different characters, up to which words go on side by side.
MATRIX_CHARS, COLUMNS = (8, 14, 32), 192
#: Words that a worker remembers; the memory is emptied when it is full.
MEMORY = 200_000
#: Compiled states that a worker keeps between texts; beyond them compiling starts anew.
STATES = 200_000
_START = ("", (None,), (0,))
_NEVER = float("-inf")
#: A move holds the next state, and the change of the count, which is above -_OFFSET, in its last bits.
_BITS = 10
_MASK, _OFFSET = (1 << _BITS) - 1, 1 << _BITS - 1


class Compiled:
    """The transducer of one vocabulary: ``pieces`` maps piece to score; higher scores merge first."""

    def __init__(self, pieces: dict[str, float], dummy_prefix: bool = True):
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece has white space after another character; texts can't be cut at words")
        self.pieces = pieces
        self.dummy_prefix = dummy_prefix
        self.chars = {c for p in pieces for c in p}
        self.starts: dict[str, float] = {}  # first parts of longer pieces, with the best of their scores
        for p, score in pieces.items():
            for k in range(1, len(p)):
                self.starts[p[:k]] = max(self.starts.get(p[:k], _NEVER), score)
        self.longest = max(map(len, pieces), default=1)
        if self.longest > _OFFSET // 2:
            raise ValueError("a piece is too long")
        self.same = {p: p for p in pieces}  # one string object for each piece
        self.columns = np.zeros(0x110000, np.uint8)  # of characters, as they are met; 0: none
        self.characters = [""]
        self.memory: dict[str, int] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.histories: dict[str, list[tuple[float, str, str]]] = {}
        self.suffixes: dict[str, tuple] = {}
        self.alike: dict[tuple[str, str], str | None] = {}
        self.open: dict[str, list[tuple[float, float, str]]] = {}
        self.classes: dict[tuple, str] = {}
        self.forget()

    def forget(self) -> None:
        """Back to the start state alone, which is number 0."""
        self.pairs.clear()
        self.histories.clear()
        self.alike.clear()
        self.open.clear()
        self.classes.clear()
        self.suffixes.clear()
        self.states: list[tuple] = [_START]
        self.numbers: dict[tuple, int] = {_START: 0}
        #: a move is the next state with the change of the count: by state and character, and for whole
        #: arrays by state and column of a character
        self.moves: dict[int, int] = {}
        self.table = MoveTable()
        self.counted: dict[tuple, tuple] = {}

    def forget_if_full(self) -> None:
        if len(self.states) > STATES:
            self.forget()

    def number(self, state: tuple) -> int:
        found = self.numbers.get(state)
        if found is None:
            found = self.numbers[state] = len(self.states)
            self.states.append(state)
        return found

    @classmethod
    def from_sentencepiece(cls, path: str) -> Compiled:
        """Reads a SentencePiece BPE model without normalisation, with byte fallback."""
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("not a BPE model with byte fallback and plain texts")
        if any(p.type in (4, 5) for p in model.pieces):
            raise ValueError("user-defined or unused pieces aren't supported")
        return cls({p.piece: p.score for p in model.pieces if p.type == 1}, norm.add_dummy_prefix)

    # ------------------------------------------------------------ compiling

    def merged(self, text: str) -> list[str]:
        """The tokenisation by its definition: the best-scored adjacent pair merges, leftmost on ties."""
        score = self.pieces.get
        parts = list(text)
        scores = [score(a + b, _NEVER) for a, b in zip(parts, parts[1:], strict=False)]
        while scores and (best := max(scores)) != _NEVER:
            i = scores.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i:
                scores[i - 1] = score(parts[i - 1] + parts[i], _NEVER)
            if i < len(scores):
                scores[i] = score(parts[i] + parts[i + 1], _NEVER)
        return parts

    def history(self, token: str) -> list[tuple[float, str, str]]:
        """(score of the next merge, last part, first part) after each merge of a token taken alone."""
        found = self.histories.get(token)
        if found is None:
            score = self.pieces.get
            parts = list(token)
            scores = [score(a + b, _NEVER) for a, b in zip(parts, parts[1:], strict=False)]
            found = []
            while True:
                best = max(scores, default=_NEVER)
                found.append((best, parts[-1], parts[0]))
                if best == _NEVER:
                    break
                i = scores.index(best)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                del scores[i]
                if i:
                    scores[i - 1] = score(parts[i - 1] + parts[i], _NEVER)
                if i < len(scores):
                    scores[i] = score(parts[i] + parts[i + 1], _NEVER)
            if len(parts) > 1:
                found.append((_NEVER, "", ""))  # no token: its parts never become one
            self.histories[token] = found
        return found

    def agree(self, left: str | None, right: str) -> bool:
        """Do the two tokens stay as they are side by side?  None: nothing to the left.

        Each merges as it does alone until their meeting parts are the best pair, leftmost on ties.
        """
        if not left:
            return self.history(right)[-1][1] == right
        key = (left, right)
        found = self.pairs.get(key)
        if found is None:
            score = self.pieces.get
            ours, theirs = self.history(left), self.history(right)
            i = j = 0
            found = ours[-1][1] == left and theirs[-1][1] == right
            while found:
                x, last, _ = ours[i]
                y, _, first = theirs[j]
                across = score(last + first, _NEVER)
                if across > x and across >= y:
                    found = False
                elif x == y == _NEVER:
                    break
                elif x >= y:
                    i += 1
                else:
                    j += 1
            self.pairs[key] = found
        return found

    def compile_move(self, number: int, char: str) -> int:
        """The move from a state at a character."""
        to, delta = self._move(self.states[number], char)
        found = self.moves[number << 21 | ord(char)] = self.number(to) << _BITS | delta + _OFFSET
        return found

    def _fill(self, keys: np.ndarray) -> None:
        """Compiles the moves of the table that are missing; a key is state * COLUMNS + column."""
        keys = np.unique(keys)
        found = []
        for key in keys.tolist():
            number, column = divmod(key, COLUMNS)
            to, delta = self._move(self.states[number], self.characters[column])
            found.append(self.number(to) << _BITS | delta + _OFFSET)
        self.table.add(keys, np.array(found, np.int32))

    def _grown(self, grown: str) -> tuple[list[tuple[int, str, bool]], str, list[tuple[int, str]]]:
        """What follows from the suffix alone: tokens that may end here (length, token, whether a piece), the
        suffix that is kept, and those of its places that can be returned to, with what has been read since."""
        found = self.suffixes.get(grown)
        if found is None:
            tokens = [(d, self.same[grown[-d:]], True) for d in range(len(grown), 0, -1) if grown[-d:] in self.same]
            if not tokens or tokens[-1][0] > 1:
                tokens.append((1, grown[-1], False))
            keep = len(grown)
            while keep and grown[-keep:] not in self.starts:
                keep -= 1
            kept = grown[len(grown) - keep :]
            places = [(d, kept[-d:]) for d in range(1, keep + 1) if kept[-d:] in self.starts]
            found = self.suffixes[grown] = (tokens, kept, places)
        return found

    def opened(self, token: str) -> list[tuple[float, float, str]]:
        """(worst merge before, score of the next merge, last part) of a token's history where any piece at all that
        continues the part is better than the next merge; what follows the token can't matter in the rest."""
        found = self.open.get(token)
        if found is None:
            worst, found = float("inf"), []
            for following, last, _ in self.history(token):
                if self.starts.get(last, _NEVER) > following:
                    found.append((worst, following, last))
                worst = min(worst, following)
            self.open[token] = found
        return found

    def like(self, left: str | None, begun: str) -> str | None:
        """One token for all that agree with the same pieces among those that begin with ``begun``.

        Of what a token has been while it merged only those parts count that could merge across before
        the token's own next merge: some piece continues them with ``begun``, a first part of it or
        more, and is better than that merge. Which parts these are, when they came (after the worst
        merge before) and what they waited for (the next merge) say all; without any it is as nothing.
        """
        if not left:
            return None
        key = (left, begun)
        found = self.alike.get(key, "")
        if found == "":
            score, seen = self.pieces.get, []
            for part in self.opened(left):
                _, following, last = part
                best = self.starts.get(last + begun, _NEVER)
                for k in range(1, len(begun) + 1):
                    if best > following:
                        break
                    best = score(last + begun[:k], _NEVER)
                if best > following:
                    seen.append(part)
            found = self.alike[key] = self.classes.setdefault((begun, *seen), left) if seen else None
        return found

    def _move(self, state: tuple, char: str) -> tuple[tuple, int]:
        suffix, last, counts = state
        if char not in self.chars:  # no piece has it: bytes of its own, and nothing merges across it
            return _START, len(char.encode())
        tokens, kept, places = self._grown(suffix + char)
        # last[d] is the last token d characters back (index 0: here), counts[d] its count against here
        for d, token, whole in tokens:
            if self.agree(last[d - 1], token):
                break
        else:
            raise AssertionError(f"no token ends {suffix + char!r}")
        delta = counts[d - 1] + (1 if whole else len(token.encode()))
        # places that can't be returned to are all alike, and so are tokens that the rest can't tell apart
        alike, new_last, new_counts = self.alike, [None] * (len(kept) + 1), [0] * (len(kept) + 1)
        if whole:
            new_last[0] = self.like(token, "")
        for at, begun in places:
            x = last[at - 1]
            if x:
                y = alike.get((x, begun), "")
                new_last[at] = self.like(x, begun) if y == "" else y
            else:
                new_last[at] = x
            new_counts[at] = counts[at - 1] - delta
        counted = tuple(new_counts)
        return (kept, tuple(new_last), self.counted.setdefault(counted, counted)), delta

    # ------------------------------------------------------------ running

    def run(self, number: int, text: str) -> tuple[int, int]:
        """(state, tokens) after a text, from a state."""
        moves, total = self.moves, 0
        for char in text:
            move = moves.get(number << 21 | ord(char))
            if move is None:
                move = self.compile_move(number, char)
            number = move >> _BITS
            total += move & _MASK
        return number, total - _OFFSET * len(text)

    def word(self, text: str) -> int:
        """Tokens of a stretch that starts at a cut."""
        got = self.memory.get(text)
        if got is None:
            if len(self.memory) >= MEMORY:
                self.memory.clear()
            got = self.memory[text] = self.run(0, text)[1]
        return got

    def entries(self, before: str, whole: bool) -> set[int]:
        """States that a text may be in after ``before``, its last characters or (``whole``) all of them."""
        cut = max((m.start() for m in _CUT.finditer(before)), default=None)
        if cut is not None:
            return {self.run(0, before[cut:])[0]}
        if whole:
            return {self.run(0, before)[0]}
        return {self.run(0, before[k:])[0] for k in range(self.longest + 1)}

    def chunk(self, text: str, entries: set[int]) -> ChunkMap:
        """The map of a chunk of escaped text, over ``entries``."""
        head, *words = _CUT.split(text)
        live: dict[int, list[list]] = {e: [[self.states[e], 0]] for e in entries}
        for k in range(0, len(head), LOOK_BACK):  # states that have met go on as one
            met: dict[int, list[list]] = {}
            for number, origins in live.items():
                to, n = self.run(number, head[k : k + LOOK_BACK])
                for origin in origins:
                    origin[1] += n
                met.setdefault(to, []).extend(origins)
            live = met
        if not words:
            return ChunkMap({state: (self.states[number], n) for number, origins in live.items() for state, n in origins})
        last, rest = self.run(0, words[-1])
        rest += sum(map(self.word, words[:-1]))
        return ChunkMap({state: (self.states[last], n + rest) for origins in live.values() for state, n in origins})

    def escaped(self, text: str) -> str:
        return SPACE * self.dummy_prefix + text.replace(" ", SPACE)

    def chunks(self, text: str) -> Iterator[tuple[str, bool, str]]:
        """(characters before, whether those are all, characters) of each chunk of a text as it is given."""
        text = self.escaped(text)
        for k in range(0, len(text), CHUNK_CHARS):
            yield text[max(0, k - LOOK_BACK) : k], k <= LOOK_BACK, text[k : k + CHUNK_CHARS]

    def count(self, text: str) -> int:
        """Tokens of a text as the library gives them, without added tokens."""
        if not text:
            return 0
        self.forget_if_full()
        if len(text) <= CHUNK_CHARS:
            return sum(map(self.word, _CUT.split(self.escaped(text))))
        found = scanned([self.chunk(part, self.entries(before, whole)) for before, whole, part in self.chunks(text)]).moves.get(_START)
        return found[1] if found else self.run(0, self.escaped(text))[1]

    def words(self, words: pa.Array) -> np.ndarray:
        """Tokens of each of some distinct words that stand after one space: all go on a character at a time."""
        out = np.zeros(len(words), np.int64)
        size = pc.utf8_length(words).to_numpy(zero_copy_only=False)
        start, first = self.run(0, SPACE)
        least = -1
        for width in MATRIX_CHARS:
            some = np.flatnonzero((size > least) & (size <= width))
            some = some[np.argsort(-size[some], kind="stable")]
            total, bare = self._matrix(words.take(pa.array(some)), size[some], width, start)
            out[some] = total + first
            for i in some[bare].tolist():  # a character without a column
                out[i] = first + self.run(start, words[i].as_py())[1]
            least = width
        for i in np.flatnonzero(size > least).tolist():
            out[i] = first + self.run(start, words[i].as_py())[1]
        return out

    def _matrix(self, words: pa.Array, size: np.ndarray, width: int, start: int) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of words, longest first, from a state, and flags of those with a character that has no column."""
        some = words.to_numpy(zero_copy_only=False).astype(f"U{width}").view(np.uint32).reshape(len(words), width)
        columns = self.columns[some]
        if len(self.characters) < COLUMNS and ((columns != 0).sum(1) < size).any():
            self._meet(some)
            columns = self.columns[some]
        columns = np.ascontiguousarray(columns.T)
        state, total, bare = np.full(len(size), start), np.zeros(len(size), np.int64), np.zeros(len(size), bool)
        for k in range(size[0] if len(size) else 0):
            live = np.searchsorted(-size, -k)  # those that are longer
            column = columns[k, :live]
            keys = state[:live] * COLUMNS + column
            move = self.table.get(keys)
            if not move.all():
                missing = keys[(move == 0) & (column > 0)]
                if len(missing):
                    self._fill(missing)
                    move = self.table.get(keys)
                bare[:live] |= column == 0
            state[:live] = move >> _BITS
            total[:live] += (move & _MASK) - _OFFSET
        return total, bare

    def _meet(self, characters: np.ndarray) -> None:
        """Gives columns to new characters while there are any."""
        for code in np.unique(characters).tolist():
            if code and not self.columns[code] and len(self.characters) < COLUMNS:
                self.columns[code] = len(self.characters)
                self.characters.append(chr(code))

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text; nulls count as empty."""
        return self.divided(texts, None)[0]

    def divided(self, texts: pa.Array, capacity: int | None) -> tuple[np.ndarray, dict[int, list[tuple[int, int, int]]]]:
        """Tokens of each text and, by its number, the ``parts`` of each that has more than ``capacity``."""
        texts = texts.fill_null("")
        plain = self.plain(texts)
        out = np.zeros(len(texts), np.int64)
        parts: dict[int, list[tuple[int, int, int]]] = {}
        if plain.any():
            self.forget_if_full()
            words = pc.split_pattern(texts.filter(pa.array(plain)), " ")
            flat = words.flatten().dictionary_encode()
            index = flat.indices.to_numpy(zero_copy_only=False)
            each = self.words(flat.dictionary)[index]
            at = words.offsets.to_numpy() - words.offsets[0].as_py()
            out[plain] = np.add.reduceat(each, at[:-1])
            long = np.flatnonzero(plain & (out > capacity)) if capacity else []
            if len(long):
                size = pc.utf8_length(flat.dictionary).to_numpy(zero_copy_only=False).astype(np.int64)[index]
                row = np.cumsum(plain) - 1
                for i in long.tolist():
                    a, b = at[row[i]], at[row[i] + 1]
                    found = _filled(each[a:b], size[a:b], capacity)
                    if found:
                        parts[i] = found
        for i in np.flatnonzero(~plain).tolist():
            out[i] = self.count(texts[i].as_py())
        if capacity:
            for i in np.flatnonzero(out > capacity).tolist():
                if i not in parts:
                    parts[i] = self.parts(texts[i].as_py(), capacity)
        return out, parts

    def plain(self, texts: pa.Array) -> np.ndarray:
        """Texts of one chunk whose spaces stand alone, so that each is a cut, the prefix too."""
        if not self.dummy_prefix:
            return np.zeros(len(texts), bool)
        odd = pc.or_(pc.match_substring(texts, "  "), pc.or_(pc.match_substring(texts, SPACE), pc.starts_with(texts, " ")))
        odd = pc.or_(odd, pc.greater(pc.binary_length(texts), CHUNK_CHARS))
        odd = pc.or_(odd, pc.equal(pc.binary_length(texts), 0))
        return ~odd.to_numpy(zero_copy_only=False)

    def parts(self, text: str, capacity: int) -> list[tuple[int, int, int]]:
        """(start, end, tokens) of parts of a text, in characters, each of ``capacity`` tokens at most.

        Parts end at spaces, which are in no part if the vocabulary adds one before a text; so each
        part taken alone has the tokens that it has in the text. Only a word of more tokens than
        ``capacity`` is divided, and its parts have the tokens that they have alone.
        """
        if not text:
            return [(0, 0, 0)]
        self.forget_if_full()
        shift = int(self.dummy_prefix)
        escaped = self.escaped(text)
        cuts = [m.start() for m in _CUT.finditer(escaped)]
        at = [0, *(c for c in cuts if text[c - shift] == " " and c < len(escaped) - 1), len(escaped)]
        out: list[tuple[int, int, int]] = []
        first, total = 0, 0  # of the part that is open, in the escaped text
        for a, b in zip(at, at[1:], strict=False):
            n = sum(map(self.word, _CUT.split(escaped[a:b])))
            if total + n > capacity:
                if a > first:
                    out.append((first, a - shift, total))
                first, total = a, 0
            if n > capacity:
                *done, (a, b, n) = self._divided(text[a:b - shift] if shift else escaped[a:b], capacity)
                out += [(first + x, first + y, k) for x, y, k in done]
                first, total = first + a, 0
            total += n
        out.append((first, len(text), total))
        return out

    def _divided(self, word: str, capacity: int) -> list[tuple[int, int, int]]:
        """The same for one word: the longest prefix that fits, again and again."""
        out, at = [], 0
        while at < len(word):
            number, n = self.run(0, SPACE * self.dummy_prefix)
            best = (at + 1, None)
            for k in range(at, len(word)):
                number, delta = self.run(number, SPACE if word[k] == " " else word[k])
                n += delta
                if n <= capacity:
                    best = (k + 1, n)
                elif n > capacity + 2 * self.longest:
                    break
            if best[1] is None:
                raise ValueError("a character has more tokens than the capacity")
            out.append((at, *best))
            at = best[0]
        return out


def _filled(tokens: np.ndarray, characters: np.ndarray, capacity: int) -> list[tuple[int, int, int]] | None:
    """(start, end, tokens) of parts of as many words as fit; None if a word doesn't, or the last is empty."""
    if not characters[-1] or tokens.max() > capacity:
        return None
    total = np.concatenate([[0], np.cumsum(tokens)])
    place = np.concatenate([[0], np.cumsum(characters + 1)])
    out, at = [], 0
    while at < len(tokens):
        end = int(np.searchsorted(total, total[at] + capacity, side="right")) - 1
        out.append((int(place[at]), int(place[end]) - 1, int(total[end] - total[at])))
        at = end
    return out


class MoveTable:
    """Positive numbers by key, for arrays of keys: open addressing in two arrays."""

    def __init__(self, log_size: int = 12):
        self.log_size, self.n = log_size, 0
        self.keys = np.full(1 << log_size, -1)
        self.values = np.zeros(1 << log_size, np.int32)

    def _places(self, keys: np.ndarray) -> np.ndarray:
        """Where each key is, or the free place where it would go."""
        mask = (1 << self.log_size) - 1
        place = (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.log_size)).astype(np.int64)
        there = self.keys[place]
        todo = np.flatnonzero((there != keys) & (there >= 0))
        while len(todo):
            place[todo] = (place[todo] + 1) & mask
            there = self.keys[place[todo]]
            todo = todo[(there != keys[todo]) & (there >= 0)]
        return place

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of the keys; 0 for a key that isn't there."""
        return self.values[self._places(keys)]

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds distinct keys that aren't there."""
        if (self.n + len(keys)) * 2 > len(self.keys):
            held = self.keys >= 0
            old, self.__dict__ = (self.keys[held], self.values[held]), MoveTable((4 * (self.n + len(keys))).bit_length()).__dict__
            self.add(*old)
        self.n += len(keys)
        while len(keys):  # of several that want one free place the last gets it
            place = self._places(keys)
            self.keys[place] = keys
            got = self.keys[place] == keys
            self.values[place[got]] = values[got]
            keys, values = keys[~got], values[~got]


_CUT = re.compile(f"(?<=[^{SPACE}])(?={SPACE})")


class ChunkMap:
    """Entry state -> (exit state, tokens) of a chunk."""

    __slots__ = ("moves",)

    def __init__(self, moves: dict[tuple, tuple[tuple, int]]):
        self.moves = moves

    def compose(self, later: ChunkMap) -> ChunkMap:
        """This map, then ``later``, for the entry states whose exit ``later`` knows."""
        return ChunkMap({e: (later.moves[x][0], n + later.moves[x][1]) for e, (x, n) in self.moves.items() if x in later.moves})


def scanned(maps: list[ChunkMap]) -> ChunkMap:
    """All of them in a row, composed as a balanced tree."""
    while len(maps) > 1:
        maps = [maps[i].compose(maps[i + 1]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    return maps[0]


def machine(path: str) -> Compiled:
    """The transducer for a model file, one per worker while tasks of this kind follow each other."""
    kept = settle("token_counts")
    if path not in kept:
        kept[path] = Compiled.from_sentencepiece(path)
    return kept[path]


def counter(path: str) -> Callable[[str | None], int]:
    tokens = machine(path)
    return lambda text: tokens.count(text or "")


def count_tokens(docs: DataFrame, model_path: str, text: str = "text", out: str = "n_tokens", long_bytes: int = LONG_BYTES) -> DataFrame:
    """``docs`` without its text, with the number of tokens of each whole text as column ``out``.

    ``model_path`` must be readable on every executor. A column of the name ``out`` is replaced. Texts
    of more than ``long_bytes`` bytes are counted chunk by chunk, by many tasks.
    """
    ship(docs.sparkSession)
    rest = [c for c in docs.columns if c not in (text, out)]
    plain = [f"c{i}" for i in range(len(rest))]  # whatever the columns are called
    rows = docs.select(F.col(f"`{text}`").alias("text"), *[F.col(f"`{c}`").alias(p) for c, p in zip(rest, plain, strict=True)])
    is_long = F.coalesce(F.octet_length("text"), F.lit(0)) > long_bytes

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = machine(model_path)
        for texts in slices(together(batches, STEP_BYTES), limit=2 * STEP_BYTES, keep=True):  # a run is a little more
            counts = tokens.counts(texts.column("text"))
            yield pa.RecordBatch.from_arrays([*(texts.column(p) for p in plain), pa.array(counts, pa.int64())], names=[*plain, "n"])

    def recounted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = None
        for batch in batches:
            known = batch.column(batch.num_columns - 1).to_pylist()
            tokens = tokens or (machine(model_path) if None in known else None)
            counts = [tokens.count(t.as_py()) if n is None else n for t, n in zip(batch.column(0), known, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:-1], pa.array(counts, pa.int64())], names=[*plain, "n"])

    schema = rows.drop("text").schema.add("n", "long")
    named = rows.where(is_long).withColumn("th", F.sha2("text", 256))
    found = _long_counts(named.groupBy("th").agg(F.first("text").alias("text")), model_path)
    joined = named.join(found, "th", "left").select("text", *plain, "n")
    counted = rows.where(~is_long).mapInArrow(per_batch, schema).unionByName(joined.mapInArrow(recounted, schema))
    return counted.select(*[F.col(p).alias(c) for p, c in zip(plain, rest, strict=True)], F.col("n").alias(out))


def _long_counts(texts: DataFrame, model_path: str) -> DataFrame:
    """th, n of texts (th, text): chunks dealt to tasks, their maps composed in rounds of SCAN; n is null
    where the composed map doesn't know the start state."""

    def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = None
        for batch in batches:
            tokens = tokens or machine(model_path)
            for th, text in zip(batch.column(0), batch.column(1), strict=True):
                for k, (before, whole, part) in enumerate(tokens.chunks(text.as_py())):
                    yield pa.RecordBatch.from_pydict({"th": [th], "k": [k], "before": [before], "whole": [whole], "part": [part]})

    def map_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = None
        for batch in batches:
            tokens = tokens or machine(model_path)
            maps = []
            for before, whole, part in zip(*[batch.column(i).to_pylist() for i in (2, 3, 4)], strict=True):
                tokens.forget_if_full()
                maps.append(pickle.dumps(tokens.chunk(part, tokens.entries(before, whole)).moves))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(maps, pa.binary())], names=["th", "k", "map"])

    def compose(table: pa.Table) -> pa.Table:
        table = table.sort_by("k")
        whole = scanned([ChunkMap(pickle.loads(m)) for m in table["map"].to_pylist()])
        return pa.table({"th": table["th"][:1], "k": [table["k"][0].as_py() // SCAN], "map": pa.array([pickle.dumps(whole.moves)], pa.binary())})

    def tokens_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pickle.loads(m).get(_START) for m in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f and f[1] for f in found], pa.int64())], names=["th", "n"])

    chunks = texts.mapInArrow(divide, "th string, k long, before string, whole boolean, part string").repartition("th", "k")
    maps = chunks.mapInArrow(map_of, "th string, k long, map binary")
    for _ in range(3):
        maps = maps.groupBy("th", F.floor(F.col("k") / SCAN).alias("group")).applyInArrow(compose, "th string, k long, map binary")
    return maps.select("th", "map").mapInArrow(tokens_of, "th string, n long")
