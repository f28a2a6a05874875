"""Operator 1: byte-pair encoding and decoding with a compiled token automaton.

The merges are compiled, in their order, into one deterministic automaton over tokens that
accepts exactly the canonical token sequences. It starts as a single state that loops on all
256 byte arcs. The gadget of merge ``u v -> w`` forks the state entered by ``u`` into a copy
without the ``v`` arc, sends all ``u`` arcs to the copy, and gives every state with a ``u``
arc a ``w`` arc to where ``v`` used to lead. So a state is its parent, the arc it lost and the
merge that made it, and an arc's existence follows from those three tables; cells of the
(state, token) table are filled when first used, as 50,000 squared of them would not fit.

A pre-split word is encoded by following its arcs through the table, longest label first: each
prefix has exactly one accepted token sequence, so a place is left for good once its arcs fail.
The distinct words of a batch follow their arcs together, one arc of each word at a time.
Decoding emits the arcs' labels, the byte strings of the tokens.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField

from vigilog.llm.common import PLACE, cut_at_blanks, extend, hex_digest, kept, lists_of, utf8

#: The byte-level pre-split rule of this tokenizer family.
PRE_SPLIT = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Below this code point the rule's character classes are the same in all Unicode versions.
SETTLED = "՘"
#: A blank between white space, or at the end after it: there pieces can't be cut apart.
_BLANK_RUN = regex.compile(r"\s (?:\s|$)")
#: Words of ASCII letters with at most one mark, which is a word of its own after letters.
_LETTERS = "[A-Za-z]+[.,;:!?]?"
#: Pieces of settled characters that don't begin with white space: behind blanks they stay apart.
_SETTLED_PIECE = (r"^[^\t-\r\x1c-\x20\x{85}\x{a0}\x{558}-\x{10FFFF}][^\x{558}-\x{10FFFF}]*$")
#: Cells of a table before it is emptied; results don't change.
CELLS = 500_000
#: Words that are left to be encoded one by one.
FEW = 100
#: Larger batches than elsewhere: each distinct piece of a batch is looked up once.
BATCH_BYTES = 16 << 20


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1
    characters stand for themselves, the other bytes for code points from 256 on."""
    own = [b for b in range(256)
           if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Numbers:
    """Numbers by key, both not negative, for many keys at a time, in slots by hash."""

    def __init__(self, bits: int):
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        self.used = 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(PLACE)) >> self.shift).view(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where there is none."""
        slots = self._slots(keys)
        there = self.keys[slots]
        out = np.where(there == keys, self.values[slots], np.int32(-1))
        left = np.flatnonzero((there != keys) & (there >= 0))
        while len(left):
            slots[left] = at = (slots[left] + 1) & self.mask
            there = self.keys[at]
            hit = there == keys[left]
            out[left[hit]] = self.values[at[hit]]
            left = left[~hit & (there >= 0)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds distinct keys that are not there, fewer than there are slots."""
        slots, left = self._slots(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slots[left]] < 0]
            self.keys[slots[free]] = keys[free]
            done = self.keys[slots[left]] == keys[left]
            self.values[slots[left[done]]] = values[left[done]]
            left = left[~done]
            slots[left] = (slots[left] + 1) & self.mask
        self.used += len(keys)

    def clear(self) -> None:
        self.keys.fill(-1)
        self.used = 0


class TokenAutomaton:
    """Deterministic automaton over tokens, compiled from merges in priority order.

    `vocabulary` maps byte strings to ids, `merges` lists pairs of byte strings.
    """

    def __init__(self, vocabulary: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.vocabulary = vocabulary
        self.labels = {i: b for b, i in vocabulary.items()}
        #: The id of every label, and -1 for what only begins one.
        self.begun = {label[:k]: -1 for label in vocabulary for k in range(1, len(label))} | vocabulary
        self.size = max(self.labels, default=0) + 1
        self.parent, self.lost, self.born = [-1], [-1], [-1]
        self.target = {i: 0 for b, i in vocabulary.items() if len(b) == 1}
        self.left: dict[int, int] = {}
        self.merged_at: dict[int, int] = {}
        self.cells: dict[int, bool] = {}
        for rank, (a, b) in enumerate(merges):
            self._add_gadget(rank, vocabulary[a], vocabulary[b], vocabulary[a + b])
        self.cells.clear()
        self._spell()

    def _spell(self) -> None:
        """Tables of labels and targets for `encode_many`."""
        begun = sorted(self.begun, key=len)
        node = {b"": 0} | {label: i for i, label in enumerate(begun, 1)}
        above = [node[label[:-1]] for label in begun]
        edges = np.array([a * 257 + label[-1] for a, label in zip(above, begun)], np.int64)
        self.next_node = Numbers((4 * len(begun) + 256).bit_length())
        self.next_node.put(edges, np.arange(1, len(begun) + 1))
        #: By node its longest label; by token, or -1 for none, the next shorter label it begins with.
        best = [-1]
        self.shorter = np.full(self.size + 1, -1, np.int32)
        for label, a in zip(begun, above):
            token = self.begun[label]
            if token >= 0:
                self.shorter[token] = best[a]
            best.append(token if token >= 0 else best[a])
        self.best = np.array(best, np.int32)
        self.length, self.leads = np.zeros(self.size + 1, np.int64), np.zeros(self.size + 1, np.int32)
        for label, i in self.vocabulary.items():
            self.length[i] = len(label)
        for token, state in self.target.items():
            self.leads[token] = state
        self.arcs = Numbers((2 * CELLS).bit_length())

    def _add_gadget(self, rank: int, u: int, v: int, w: int) -> None:
        if w in self.target:
            raise ValueError("two merges make the same token")
        if u not in self.target or v not in self.target:
            raise ValueError("a merge uses a token that no earlier merge makes")
        entered = self.target[u]
        if not self._has_arc(entered, v, rank):
            return                      # u v never meet: w stays without arcs
        self.target[w] = self.target[v]
        self.left[w], self.merged_at[w] = u, rank
        self.target[u] = len(self.parent)
        self.parent.append(entered)
        self.lost.append(v)
        self.born.append(rank)

    def _has_arc(self, state: int, token: int, now: int) -> bool:
        """Whether `state` has an arc for `token` once the gadgets up to `now` are in."""
        while True:
            since = self.merged_at.get(token, -1)
            while self.born[state] > since:
                if self.lost[state] == token:
                    return False
                state = self.parent[state]
            if since < 0:
                return True             # the first state has all byte arcs
            token = self.left[token]    # the arc was added where the left part had one

    def step(self, state: int, token: int) -> bool:
        """Whether the arc exists; it leads to `target[token]`."""
        key = state * self.size + token
        found = self.cells.get(key)
        if found is None:
            if len(self.cells) >= CELLS:
                self.cells.clear()
            found = token in self.target and self._has_arc(state, token, len(self.born))
            self.cells[key] = found
        return found

    def encode(self, word: bytes) -> tuple[int, ...]:
        """Token ids along the only accepted path that spells the word.

        Whatever accepted path reaches a place, it is the same one, so a place from which
        the search came back is never tried again.
        """
        n, begun, target, cells, size = (
            len(word), self.begun.get, self.target, self.cells, self.size)
        place, state, path, trials, dead = 0, 0, [], [], set()
        while place < n:
            arcs = []
            for end in range(place + 1, n + 1):
                token = begun(word[place:end])
                if token is None:
                    break
                if token >= 0:
                    arcs.append((token, end))
            while True:
                if arcs:
                    token, end = arcs.pop()
                    if end in dead:
                        continue
                    found = cells.get(state * size + token)
                    if found or found is None and self.step(state, token):
                        trials.append((place, state, arcs))
                        path.append(token)
                        place, state = end, target[token]
                        break
                elif trials:
                    dead.add(place)
                    place, state, arcs = trials.pop()
                    path.pop()
                else:
                    raise ValueError("a byte is not in the vocabulary")
        return tuple(path)

    def _steps(self, states: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """`step` of many states and tokens."""
        keys = states.astype(np.int64) * self.size + tokens
        found = self.arcs.get(keys)
        lacking = np.flatnonzero(found < 0)
        if len(lacking):
            new, at = np.unique(keys[lacking], return_inverse=True)
            now = len(self.born)
            made = np.array([token in self.target and self._has_arc(state, token, now) for state, token
                             in (divmod(k, self.size) for k in new.tolist())], np.int32)
            found[lacking] = made[at]
            if self.arcs.used + len(new) > CELLS:
                self.arcs.clear()
            self.arcs.put(new[:CELLS], made[:CELLS])
        return found > 0

    def _longest(self, symbols: np.ndarray) -> np.ndarray:
        """The longest label that begins at each place of words with 256 behind each; -1 if none does."""
        out = np.full(len(symbols), -1, np.int32)
        places, nodes, k = np.arange(len(symbols)), np.zeros(len(symbols), np.int64), 0
        while len(places):
            nodes = self.next_node.get(nodes * 257 + symbols[places + k])
            there = nodes > 0
            places, nodes, k = places[there], nodes[there].astype(np.int64), k + 1
            out[places] = self.best[nodes]
        return out

    def encode_many(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """`encode` of many words, whose bytes lie one after another: all ids, and where each word's begin.

        In each round every word tries an arc, after it has gone back over its last one if no arc is left.
        The arc into a place is kept by place, as there is one accepted path to it.
        """
        n = len(bounds) - 1
        symbols = np.full(len(data) + n, 256, np.int64)     # 256 stands behind each word
        symbols[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(bounds))] = data
        start, stop = bounds[:-1] + np.arange(n), bounds[1:] + np.arange(n)
        longest = self._longest(symbols)
        last, dead = np.full(len(symbols), -1, np.int32), np.zeros(len(symbols), bool)
        on_path, ended = np.zeros(len(symbols), bool), []
        word = np.flatnonzero(start < stop)
        place, state = start[word], np.zeros(len(word), np.int32)
        token = longest[place]
        while len(word) > FEW:
            back = np.flatnonzero(token < 0)
            if len(back):
                at = place[back]
                over = last[at]
                if (over < 0).any():
                    raise ValueError("a byte is not in the vocabulary")
                dead[at] = True
                at = at - self.length[over]
                place[back], state[back], token[back] = at, self.leads[last[at]], self.shorter[over]
            end = place + self.length[token]
            on = np.flatnonzero((token >= 0) & ~dead[end])
            on = on[self._steps(state[on], token[on])]
            to = end[on]
            last[to] = token[on]
            token = self.shorter[token]
            place[on], state[on], token[on] = to, self.leads[last[to]], longest[to]
            done = np.zeros(len(word), bool)
            done[on] = symbols[to] == 256
            if done.any():
                ended.append(place[done])
                word, place, state, token = (x[~done] for x in (word, place, state, token))
        for i in word.tolist():
            at = start[i]
            for t in self.encode(symbols[at:stop[i]].astype(np.uint8).tobytes()):
                at += self.length[t]
                last[at], on_path[at] = t, True
        at = np.concatenate([*ended, np.zeros(0, np.int64)])
        while len(at):
            on_path[at] = True
            at = at - self.length[last[at]]
            at = at[last[at] >= 0]
        return last[on_path].astype(np.uint32), np.concatenate([[0], np.cumsum(on_path)[stop]])


class ByteCodec:
    """Whole-text encoder and decoder of a byte-level vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = byte_letters()
        raw = lambda token: bytes(byte_of[c] for c in token)
        vocabulary = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.automaton = TokenAutomaton(vocabulary, [(raw(a), raw(b)) for a, b in merges])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(
            self.special, key=len, reverse=True))) + ")") if self.special else None
        #: Splits words with characters that newer Unicode versions have classed.
        self.pre_split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        n = 1 + max([*self.automaton.labels, *self.special.values()])
        label = [self.automaton.labels.get(i, b"") for i in range(n)]
        for content, i in self.special.items():
            label[i] = bytes(byte_of[c] for c in content)
        self.label = pa.array(label, pa.large_binary())
        self.decimal = pa.array([b"%d," % i for i in range(n)], pa.large_binary())
        #: Whether letters and one mark may form a special token, so that every piece has to be searched.
        self.spelled = any(re.fullmatch(f"({_LETTERS})?|[.,;:!?]", c.strip(" ")) for c in self.special)

    def _words(self, text: str) -> list[str]:
        """A text's words and special tokens."""
        if self.cut is None or self.cut.search(text) is None:
            return self._plain(text)
        return [w for part in self.cut.split(text)
                for w in ([part] if part in self.special else self._plain(part))]

    def _plain(self, text: str) -> list[str]:
        if not text or max(text) < SETTLED:
            return PRE_SPLIT.findall(text)
        return [text[a:b] for _, (a, b) in self.pre_split(text)]

    def _kinds(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where pieces are letters with at most one mark, settled in other ways, or neither."""
        match = lambda rule: np.asarray(pc.match_substring_regex(pieces, rule))
        letters = match(f"^{_LETTERS}$") & (not self.spelled)
        settled = match(_SETTLED_PIECE) & ~letters
        for content in self.special:
            settled &= ~np.asarray(pc.match_substring(pieces, content.strip(" ")))
        return tuple(map(np.flatnonzero, (letters, settled, ~letters & ~settled)))

    def _cut_up(self, pieces: pa.Array, heads: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """All words of pieces, each behind a blank, and of heads: the words, the order in which they are
        to be read, where each piece or head then begins, and which piece or head it is."""
        letters, settled, rest = self._kinds(pieces)
        words = lambda found: pa.array(found, pa.large_string())
        alone = pieces.take(pa.array(letters))
        body = pc.ascii_rtrim(alone, ".,;:!?")
        marked = np.asarray(pc.not_equal(alone, body))
        blank, nothing = (pa.scalar(x, pa.large_string()) for x in (" ", ""))
        parts = [pc.binary_join_element_wise(blank, body, nothing),
                 pc.utf8_slice_codeunits(alone.filter(pa.array(marked)), -1)]
        behind = np.cumsum(1 + marked)                      # a mark is read after its letters
        order = np.empty(len(alone) + marked.sum(), np.int64)
        order[behind - 1 - marked] = np.arange(len(alone))
        order[behind[marked] - 1] = len(alone) + np.arange(marked.sum())
        # Blanks cut the others apart as they do in a text: such a word begins a piece.
        parts.append(words(PRE_SPLIT.findall("".join([" " + p for p in pieces.take(pa.array(settled)).to_pylist()]))))
        first = np.flatnonzero(np.asarray(pc.starts_with(parts[-1], " ")))
        each = [self._words(" " + p) for p in pieces.take(pa.array(rest)).to_pylist()]
        each += map(self._words, heads)
        parts.append(words([w for found in each for w in found]))
        sizes = np.concatenate([1 + marked, np.diff(np.append(first, len(parts[2]))),
                                np.array(list(map(len, each)), np.int64)])
        order = np.concatenate([order, np.arange(len(order), sum(map(len, parts)))])
        return (pa.concat_arrays(parts), order, np.concatenate([[0], np.cumsum(sizes)]),
                np.concatenate([letters, settled, rest, len(pieces) + np.arange(len(heads))]))

    def _ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words and special tokens, and where each one's begin; equal ones are encoded once."""
        coded = words.dictionary_encode()
        codes, distinct = np.asarray(coded.indices).astype(np.int64), coded.dictionary
        _, offsets, data = distinct.buffers()
        bounds = np.frombuffer(offsets, np.int64, len(distinct) + 1, 8 * distinct.offset)
        data = np.frombuffer(data or b"", np.uint8)[bounds[0]:bounds[-1]]
        ids, ends = self.automaton.encode_many(data, bounds - bounds[0])
        for content, i in self.special.items():
            at = distinct.index(content).as_py()
            if at >= 0:
                codes[codes == at] = len(ends) - 1
                ids, ends = np.append(ids, np.uint32(i)), np.append(ends, len(ids) + 1)
        return lists_of(ids, ends, codes)

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts, one after another, and where each text's ids begin and end.

        No word reaches over a blank unless white space is on both its sides, so elsewhere
        a text is cut there. A null text counts as empty.
        """
        uncut = [bool(t and _BLANK_RUN.search(t)) for t in texts]
        pieces, codes, bounds = cut_at_blanks(["" if u else t for t, u in zip(texts, uncut)])
        heads = [t if u else (t or "").split(" ", 1)[0] for t, u in zip(texts, uncut)]
        codes[bounds[:-1]] = len(pieces) + np.arange(len(heads))
        words, order, begins, which = self._cut_up(pieces, heads)
        ids, ends = self._ids(words.take(pa.array(order)))
        number = np.empty(len(which), np.int64)
        number[which] = np.arange(len(which))
        flat, upto = lists_of(ids, ends[begins], number[codes])
        return flat, upto[bounds]

    def encode(self, text: str | None) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def decode_batch(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The labels of each text's ids, joined."""
        return joined(self.label, ids, bounds)

    def decode(self, ids: list[int] | None) -> str:
        """Text of the ids' labels; bytes that are no UTF-8 become replacement characters."""
        ids = np.array(ids or [], np.uint32)
        return self.decode_batch(ids, np.array([0, len(ids)]))[0].decode("utf-8", "replace")

    def decimals(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The decimal ids of each text, joined by commas."""
        return [x[:-1] for x in joined(self.decimal, ids, bounds)]


def joined(labels: pa.Array, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    taken = labels.take(pa.array(ids))
    offsets = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1)[bounds].tolist()
    data = memoryview(taken.buffers()[2] or b"")
    return [bytes(data[a:b]) for a, b in zip(offsets, offsets[1:])]


def codec(path: str) -> ByteCodec:
    """One compiled codec per worker process, as compiling takes a second, which every task would pay;
    a worker that turns to a pass without one lets it go."""
    return kept(("byte codec", path), lambda: ByteCodec(path))


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids",
           keep: list[str] | None = None, exact: str | None = None) -> DataFrame:
    """Adds the token ids of each whole text as array<int>.

    `exact` names a further column that tells whether decoding the ids gives the text back; it
    is made in the same pass, so that a task has one worker with one codec.

    Null and empty texts give an empty array; equal texts give equal arrays; an `ids` column
    of the input gives way. `path` is a tokenizer file present on every node. No shuffle.
    """
    def build():
        c = codec(path)

        def work(texts: list) -> list:
            flat, bounds = c.encode_batch(texts)
            out = [pa.ListArray.from_arrays(bounds.astype(np.int32),
                                            pa.array(flat.astype(np.int32)))]
            if exact:
                out.append([raw == utf8(t) for raw, t in zip(
                    c.decode_batch(flat, bounds), texts, strict=True)])
            return out

        return work

    fields = [StructField(ids, ArrayType(IntegerType(), False))]
    if exact:
        fields.append(StructField(exact, BooleanType()))
    return extend(df, text, fields, build, keep, BATCH_BYTES, uses_kept=True)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded",
           keep: list[str] | None = None) -> DataFrame:
    """Adds the text of each id array; null and empty arrays give an empty text."""
    def build():
        c = codec(path)
        return lambda rows: [[c.decode(r) for r in rows]]

    return extend(df, ids, [StructField(text, StringType())], build, keep, uses_kept=True)


def round_trip(df: DataFrame, path: str, text: str = "text",
               keep: list[str] | None = None) -> DataFrame:
    """Encodes, decodes what was encoded, and keeps the digests of both.

    Adds n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256, in
    one pass: the ids, several times the size of the input, never leave the Python worker.
    """
    def build():
        c = codec(path)

        def work(texts: list) -> list:
            ids, bounds = c.encode_batch(texts)
            return [np.diff(bounds), [hex_digest(x) for x in c.decimals(ids, bounds)],
                    [hex_digest(x.decode("utf-8", "replace").encode())
                     for x in c.decode_batch(ids, bounds)]]

        return work

    return extend(df, text, [StructField("n_tokens", LongType()),
                             StructField("ids_sha256", StringType()),
                             StructField("decoded_sha256", StringType())], build, keep, BATCH_BYTES,
                  uses_kept=True)
