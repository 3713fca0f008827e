"""Token counts from a compiled finite-state tokenizer.

Two deterministic transducers stand for a byte-level BPE tokenizer. The splitter reads
classes of characters and puts out the boundaries of pieces. Its input is cut into chunks;
a chunk becomes a map from the state on entry to the state on exit, the maps compose by a
parallel prefix scan, and every chunk then runs from the state it is entered in. The pair
transducer reads the bytes of one piece. Its state is the longest suffix read that begins
some token, with the last token of the BPE encoding before each place in it where a token
may still have begun; a transition carries the number of tokens by which the encoding grows (it can be
negative), so a piece's tokens are the sum along its path. States are made when they are
first reached.

That the last token of a prefix is determined by these: token sequences whose neighbours
would never have merged across their border are BPE encodings, and there is one for each
string. So of the tokens that end at a byte one alone fits the encoding before it.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Classes of characters. The letters that close a contraction after an apostrophe have their own.
LETTER, CLOSES, OPENS_E, L, E, NUMBER, BLANK, SPACE, QUOTE, OTHER = range(10)
CLASSES = 10
_CONTRACTIONS = {"s": CLOSES, "t": CLOSES, "m": CLOSES, "d": CLOSES, "r": OPENS_E, "v": OPENS_E, "l": L, "e": E}
# States of the splitter: what the open piece is.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, ONE_BLANK, ONE_SPACE, RUN_BLANK, RUN_SPACE, QUOTED, QUOTED_E, QUOTED_L, CONTRACTED = range(12)
STATES = 12
HERE, BEFORE = 1, 2  # a piece starts at this character; at the one before it


def _splitter_step(state: int, c: int) -> tuple[int, int]:
    """Next state and boundaries for a character of class ``c``."""
    if c in (BLANK, SPACE):
        if state in (ONE_BLANK, ONE_SPACE, RUN_BLANK, RUN_SPACE):
            return (RUN_BLANK if c == BLANK else RUN_SPACE), 0
        late = BEFORE if state in (QUOTED_E, QUOTED_L) else 0
        return (ONE_BLANK if c == BLANK else ONE_SPACE), HERE | late
    into = IN_NUMBERS if c == NUMBER else IN_OTHER if c in (QUOTE, OTHER) else IN_LETTERS
    start = QUOTED if c == QUOTE else into
    if state == ONE_BLANK:  # the blank belongs to what follows
        return into, 0
    if state == RUN_BLANK:
        return into, BEFORE
    if state == ONE_SPACE:
        return start, HERE
    if state == RUN_SPACE:
        return start, HERE | BEFORE
    if state == QUOTED:
        if c == CLOSES:
            return CONTRACTED, 0
        if c in (OPENS_E, L):
            return (QUOTED_E if c == OPENS_E else QUOTED_L), 0
        return (IN_OTHER, 0) if into == IN_OTHER else (into, HERE)
    if state in (QUOTED_E, QUOTED_L):
        if c == (E if state == QUOTED_E else L):
            return CONTRACTED, 0
        return (IN_LETTERS, BEFORE) if into == IN_LETTERS else (start, HERE | BEFORE)
    if state == into:
        return into, 0
    return start, HERE


def compile_splitter() -> tuple[np.ndarray, np.ndarray]:
    """Tables (next state, boundaries) at state * 2 * CLASSES + symbol; symbols from CLASSES on are the first of a text."""
    step, out = np.zeros((STATES, 2 * CLASSES), np.uint8), np.zeros((STATES, 2 * CLASSES), np.uint8)
    for s in range(STATES):
        for c in range(CLASSES):
            step[s, c], out[s, c] = _splitter_step(s, c)
            step[s, CLASSES + c] = _splitter_step(FRESH, c)[0]
            out[s, CLASSES + c] = HERE | (BEFORE if s in (QUOTED_E, QUOTED_L) else 0)
    return step.ravel(), out.ravel()


STEP, OUT = compile_splitter()
_END = CLASSES + OTHER  # any first character of a text ends the one before


def compose(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """State maps (one column each) of `first` and `then`, one after the other."""
    return np.take_along_axis(then, first, axis=0)


def scan(maps: np.ndarray) -> np.ndarray:
    """Column j of the result is the map of columns 0 to j: a prefix scan in a logarithm of steps."""
    maps, reach = maps.copy(), 1
    while reach < maps.shape[1]:
        maps[:, reach:] = compose(maps[:, :-reach], maps[:, reach:])
        reach *= 2
    return maps


def chunk_maps(chunks: np.ndarray) -> np.ndarray:
    """The state map of every chunk; `chunks` has a column for each and a row for each place in it."""
    state = np.repeat(np.arange(STATES, dtype=np.intp)[:, None], chunks.shape[1], 1)
    for i, symbols in enumerate(chunks):
        state = STEP[state * (2 * CLASSES) + symbols].astype(np.intp)
        if i % 8 == 3 and len(state) > 1 and (state == state[0]).all():
            state = state[:1]  # every state has led to the same one
    return np.repeat(state, STATES, 0) if len(state) == 1 else state


def boundaries(symbols: np.ndarray, ends: bool = True, chunk: int = 256, most: int = 4096) -> np.ndarray:
    """Places where pieces start. `ends`: the text is over; else what the next character would decide stays open."""
    n = len(symbols)
    lanes = max(1, min(most, n // chunk))
    rows = -(-(n + 1) // lanes)
    padded = np.full(lanes * rows, _END, np.uint8)
    padded[:n] = symbols
    chunks = np.ascontiguousarray(padded.reshape(lanes, rows).T).astype(np.intp)
    entered = np.full(lanes, FRESH, np.intp)
    if lanes > 1:
        entered[1:] = scan(chunk_maps(chunks))[FRESH, :-1]
    found = np.empty((rows, lanes), np.uint8)
    state = entered
    for i, row in enumerate(chunks):
        at = state * (2 * CLASSES) + row
        found[i] = OUT[at]
        state = STEP[at].astype(np.intp)
    flags = found.T.ravel()
    here = (flags[:n] & HERE).astype(bool)
    late = (flags[1 : n + 1] & BEFORE).astype(bool)
    if not ends:
        late[n - 1 :] = False
    return np.flatnonzero(here | late)


_MORE = 1 << 15
_NO_TOKEN = (-1 << 16) | _MORE


class PairTransducer:
    """Byte-level BPE as a transducer over bytes with emitted-token counts, built from the merges in their order."""

    def __init__(self, tokens: list[bytes], merges: list[tuple[int, int, int]], bound: int = 200_000) -> None:
        self.bound = bound
        never = len(merges)
        self.rank = {(a, b): r for r, (a, b, _) in enumerate(merges)}
        made = {t: (r, a, b) for r, (a, b, t) in enumerate(merges)}
        born = lambda t: made[t][0] if t in made else -1
        # Tokens that stand at a token's edge while it is being made: (token, made by merge, used up by merge).
        self.left: list[tuple] = [()] * len(tokens)
        self.right: list[tuple] = [()] * len(tokens)
        whole = [False] * len(tokens)
        for t in sorted(range(len(tokens)), key=born):
            if t not in made:
                self.left[t] = self.right[t] = ((t, -1, never),)
                whole[t] = len(tokens[t]) == 1
                continue
            r, a, b = made[t]
            if r <= born(a) or r <= born(b):
                raise ValueError("a merge comes before the merge of its part")
            top = ((t, r, never),)
            used = lambda edge, r=r: tuple((x, s, min(e, r)) for x, s, e in edge)
            self.left[t], self.right[t] = top + used(self.left[a]), top + used(self.right[b])
            whole[t] = whole[a] and whole[b] and self._apart(self.right[a], self.left[b], r)
        self.children: list[dict[int, int]] = [{}]
        self.depth, ends = [0], {}
        for t, s in enumerate(tokens):
            if whole[t]:
                node = 0
                for c in s:
                    if c not in self.children[node]:
                        self.children[node][c] = len(self.children)
                        self.children.append({})
                        self.depth.append(self.depth[node] + 1)
                    node = self.children[node][c]
                ends[node] = (t, len(s))
        self.fail, self.suffixes = [0] * len(self.children), [()] * len(self.children)
        layer = list(self.children[0].values())
        for node in layer:
            self.suffixes[node] = (ends[node],) if node in ends else ()
        while layer:
            below = []
            for node in layer:
                for c, child in self.children[node].items():
                    self.fail[child] = self._follow(self.fail[node], c)
                    own = (ends[child],) if child in ends else ()
                    self.suffixes[child] = own + self.suffixes[self.fail[child]]
                    below.append(child)
            layer = below
        self.starts: dict[int, tuple[int, ...]] = {0: (0,)}
        self.edges: dict[int, tuple] = {}
        self._forget()

    def _forget(self) -> None:
        self.states, self.ids, self.next, self.pairs = [], {}, {}, {}
        self._id((0, _NO_TOKEN))

    def _id(self, state: tuple) -> int:
        got = self.ids.get(state)
        if got is None:
            got = self.ids[state] = len(self.states)
            self.states.append(state)
        return got

    def _starts(self, node: int) -> tuple[int, ...]:
        """How long ago a token may have begun that is still open: the lengths of the suffixes that begin some token."""
        got = self.starts.get(node)
        if got is None:
            got = self.starts[node] = (self.depth[node], *self._starts(self.fail[node]))
        return got

    def _follow(self, node: int, c: int) -> int:
        while True:
            to = self.children[node].get(c)
            if to is not None:
                return to
            if not node:
                return 0
            node = self.fail[node]

    def _edge(self, node: int, c: int) -> tuple[int, list, list]:
        """Where byte `c` leads, the tokens that end there with the place before them, and the places that stay open."""
        to = self._follow(node, c)
        place = {d: k + 1 for k, d in enumerate(self._starts(node))}
        got = self.edges[node << 8 | c] = (to, [(t, place[n - 1]) for t, n in self.suffixes[to]], [place[d - 1] for d in self._starts(to)[:-1]])
        return got

    def _apart(self, right: tuple, left: tuple, before: int) -> bool:
        """No merge earlier than `before` joins the two sides. Of equal merges the one further left comes first."""
        for x, made_x, used_x in right:
            for y, made_y, used_y in left:
                r = self.rank.get((x, y))
                if r is not None and r < before and made_x < r < used_x and made_y < r <= used_y:
                    return False
        return True

    def apart(self, a: int, b: int) -> bool:
        got = self.pairs.get(a << 32 | b)
        if got is None:
            got = self.pairs[a << 32 | b] = self._apart(self.right[a], self.left[b], len(self.rank))
        return got

    def transition(self, state: int, c: int) -> tuple[int, int]:
        """Next state and emitted tokens.

        A state has its node and, for each of `_starts`, the last token before that place, in the bits
        from 16 on, and by how many tokens the encoding up to there is longer than the whole, as MORE and that.
        """
        held = self.states[state]
        node = held[0]
        to, ends, kept = self.edges.get(node << 8 | c) or self._edge(node, c)
        for token, k in ends:
            last = held[k]
            if last < 0 or self.apart(last >> 16, token):
                break
        else:
            raise ValueError("no token ends at this byte")
        emitted = (last & 0xFFFF) - _MORE + 1
        return self._id((to, *[held[k] - emitted for k in kept], token << 16 | _MORE)), emitted

    def count(self, piece: bytes) -> int:
        total = state = 0
        known = self.next
        for c in piece:
            at = state << 8 | c
            got = known.get(at)
            if got is None:
                if len(self.states) >= self.bound:
                    held = self.states[state]
                    self._forget()
                    state, known = self._id(held), self.next
                    at = state << 8 | c
                got = known[at] = self.transition(state, c)
            state, emitted = got
            total += emitted
        return total


class Pieces(dict):
    """Tokens of a piece; short pieces are remembered up to a bound."""

    def __init__(self, pairs: PairTransducer, bound: int = 400_000) -> None:
        self.pairs, self.bound = pairs, bound

    def __missing__(self, piece: str) -> int:
        n = self.pairs.count(piece.encode())
        if len(piece) <= 24:
            if len(self) >= self.bound:
                self.clear()
            self[piece] = n
        return n


class Compiled:
    """A byte-level BPE vocabulary file as transducers; travels as the file and a table of classes, is compiled once a process."""

    def __init__(self, vocabulary: bytes, classes: np.ndarray) -> None:
        check(json.loads(vocabulary))
        self.packed = zlib.compress(vocabulary), zlib.compress(classes.tobytes())
        self.pieces: Pieces | None = None

    def __getstate__(self) -> dict:
        return {"packed": self.packed, "pieces": None}

    def open(self) -> None:
        if self.pieces is None:
            spec, self.classes = json.loads(zlib.decompress(self.packed[0])), np.frombuffer(zlib.decompress(self.packed[1]), np.uint8)
            ids, spell = spec["model"]["vocab"], spelling()
            size = max(ids.values()) + 1
            tokens = [b""] * size
            for t, i in ids.items():
                tokens[i] = bytes(spell[x] for x in t)
            merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
            special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
            self.special = re.compile("|".join(map(re.escape, special))) if special else None
            self.pieces = Pieces(PairTransducer(tokens, [(ids[a], ids[b], ids[a + b]) for a, b in merges]))

    def symbols(self, text: str) -> np.ndarray:
        return self.classes[np.frombuffer(text.encode("utf-32-le"), np.uint32)]

    def count(self, texts: list[str | None], block: int = 1 << 20) -> np.ndarray:
        """Tokens of each text. Short texts share a block of characters, a long text takes several."""
        self.open()
        totals = np.zeros(len(texts), np.int64)
        held: list[tuple[int, str]] = []
        size = 0
        for i, text in enumerate(texts):
            if not text:
                continue
            parts = [text]
            if self.special is not None and (found := self.special.findall(text)):
                totals[i] += len(found)
                parts = [p for p in self.special.split(text) if p]
            for part in parts:
                if len(part) > block:
                    totals[i] += self._long(part, block)
                    continue
                if size + len(part) > block:
                    self._short(held, totals)
                    held, size = [], 0
                held.append((i, part))
                size += len(part)
        self._short(held, totals)
        return totals

    def _short(self, held: list[tuple[int, str]], totals: np.ndarray) -> None:
        if not held:
            return
        text = "".join(p for _, p in held)
        firsts = np.cumsum([0] + [len(p) for _, p in held[:-1]])
        symbols = self.symbols(text)
        symbols[firsts] += CLASSES
        at = boundaries(symbols)
        counts = self._tokens(text, at, len(text))
        whose = np.array([i for i, _ in held])[np.searchsorted(firsts, at, "right") - 1]
        np.add.at(totals, whose, counts)

    def _tokens(self, text: str, at: np.ndarray, end: int) -> np.ndarray:
        cuts = [*at.tolist(), end]
        return np.fromiter(map(self.pieces.__getitem__, map(text.__getitem__, map(slice, cuts, cuts[1:]))), np.int64, len(at))

    def _long(self, text: str, block: int) -> int:
        """Block by block; the piece that is open at the end of a block starts the next one."""
        total, start, size = 0, 0, block
        while start < len(text):
            part = text[start : start + size]
            symbols = self.symbols(part)
            symbols[0] += CLASSES
            over = start + size >= len(text)
            at = boundaries(symbols, over)
            if over:
                return total + int(self._tokens(part, at, len(part)).sum())
            if len(at) == 1:
                size *= 2  # one piece so far
                continue
            total += int(self._tokens(part, at[:-1], int(at[-1])).sum())
            start, size = start + int(at[-1]), block
        return total


def check(spec: dict) -> None:
    """Only vocabularies whose rules the transducers have."""
    model, split = spec["model"], spec["pre_tokenizer"] or {}
    plain = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False}
    odd = [k for k, v in plain.items() if (model.get(k) or None) != (v or None)]
    if odd or spec["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        raise ValueError(f"not a plain byte-level BPE vocabulary: {odd}")
    if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that take in their surroundings")


def spelling() -> dict[str, int]:
    """How byte-level vocabularies write a byte: printable ones as they are, the others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=2)
def compiled(path: str) -> Compiled:
    """The vocabulary file at `path`, read on the driver."""
    from tokenizers import Tokenizer

    with open(path, "rb") as f:
        vocabulary = f.read()
    check(json.loads(vocabulary))
    return Compiled(vocabulary, character_classes(Tokenizer.from_str(vocabulary.decode()).pre_tokenizer.pre_tokenize_str))


def character_classes(split, block: int = 1 << 14) -> np.ndarray:
    """The class of every code point. Unicode data differ between versions, so each guess is asked of the library's own splitter."""
    table = np.full(0x110000, OTHER, np.uint8)
    lead = {LETTER: "x", NUMBER: "1", OTHER: "!"}

    def joined(chars: str, kind: int) -> bool:
        return len(split(lead[kind] + chars)) == 1

    for low in range(0, 0x110000, block):
        chars = [chr(c) for c in range(low, low + block) if not 0xD800 <= c < 0xE000 and c != 10]
        kinds: dict[int, list[str]] = {LETTER: [], NUMBER: [], OTHER: []}
        for c in chars:
            kinds[{"L": LETTER, "N": NUMBER}.get(unicodedata.category(c)[0], OTHER)].append(c)
        for kind, members in kinds.items():
            if not members:
                continue
            table[[ord(c) for c in members]] = kind
            # All of one class are one piece; else somebody is of another class.
            if not joined("".join(members), kind):
                for c in members:
                    table[ord(c)] = next((k for k in (kind, LETTER, NUMBER, OTHER) if joined(c, k)), SPACE)
    table[10], table[32], table[ord("'")] = SPACE, BLANK, QUOTE
    for c, kind in _CONTRACTIONS.items():
        table[ord(c)] = kind
    return table


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than `limit` tokens) of every row of `docs`.

    Tokens are those of the vocabulary at `path` without begin, end or added special tokens;
    a special token's string inside a text is that one token.

    - a null text counts as the empty one: no bytes, no tokens;
    - rows are independent: repeated rows and null ids each give their row, other columns are ignored;
    - an empty table gives an empty result;
    - a text of any length is read block by block. One run without a border (a million equal
      letters) is held whole while it is read.

    The vocabulary file and its class table are the only broadcast: a few MB, whatever the tables.
    """
    model = docs.sparkSession.sparkContext.broadcast(compiled(path))

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.value.count([t if isinstance(t, str) else None for t in texts]), dtype="int64")

    count.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.pandas_udf(count, "long")(text).alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)
