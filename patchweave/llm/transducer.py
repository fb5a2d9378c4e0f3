"""Token counts of a byte-level BPE tokenizer by finite-state transduction.

Within a pre-token, a deterministic transducer reads bytes; each transition carries the change in the number of tokens
that the input so far comes to. A state holds, for every suffix that could still grow into a vocabulary entry, its trie
node, the last token before it, and the tokens counted up to there relative to now. That is a finite set, and states
are made as they are met. The last token of a prefix is the one vocabulary suffix that is compatible with the token
before it (two tokens are compatible if merging their joined bytes gives the two back), so one step needs no look back.

A text is cut into chunks. A chunk maps the state in which it is entered to the state in which it is left, and a
count. Pre-tokens always break where a space follows another character, so all entering states meet at the first such
place: the map is kept as the part before it (head), the count between the first and last such place, and the state at
the end (tail, the pending pre-token text). Maps compose associatively, and a parallel prefix scan composes them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from patchweave.llm.common import map_arrow, pick

#: Characters of a chunk.
CHUNK = 1 << 16
#: Entries after which a worker forgets its memo of pre-tokens, and transitions after which it forgets states.
MEMO, TRANSITIONS = 400_000, 800_000

# The pre-token pattern of this tokenizer family, with white space as Unicode defines it.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
SYNC = r"(?<=\P{White_Space})\p{White_Space}"


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of byte-level vocabularies: visible Latin-1 bytes stand for themselves, others from U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in visible}
    for n, b in enumerate(b for b in range(256) if b not in visible):
        out[chr(256 + n)] = b
    return out


class BpeTransducer:
    """Lazily determinised transducer of one vocabulary; ``count`` runs it over the bytes of one pre-token."""

    def __init__(self, spec: dict):
        back = byte_alphabet()
        raw = lambda t: bytes(back[c] for c in t)
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items() if all(c in back for c in t)}
        self.rank = {}
        for n, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.rank[raw(a), raw(b)] = n
        # Trie over the entries that BPE can produce: node -> byte -> node, and the entry that ends at a node.
        self.children: list[dict[int, int]] = [{}]
        self.entry: list[bytes | None] = [None]
        for t in self.ids:
            if len(t) > 1 and self.merge(t) != [t]:
                continue
            at = 0
            for b in t:
                nxt = self.children[at].get(b)
                if nxt is None:
                    nxt = self.children[at][b] = len(self.children)
                    self.children.append({})
                    self.entry.append(None)
                at = nxt
            self.entry[at] = t
        self.compatible: dict[tuple[bytes, bytes], bool] = {}
        self.forget()

    def forget(self) -> None:
        #: A state is (last token, ((trie node, token before, count relative to now), ...)).
        self.number: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.step: dict[int, tuple[int, int]] = {}
        self.start = self._numbered((b"", ()))

    def _numbered(self, state: tuple) -> int:
        n = self.number.get(state)
        if n is None:
            n = self.number[state] = len(self.states)
            self.states.append(state)
        return n

    def merge(self, word: bytes) -> list[bytes]:
        """Plain BPE of a short byte string: the reference for compatibility of two tokens."""
        parts = [word[i : i + 1] for i in range(len(word))]
        rank = self.rank
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: rank.get((parts[i], parts[i + 1]), 1 << 60))
            pair = (parts[best], parts[best + 1])
            if pair not in rank:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def fits(self, a: bytes, b: bytes) -> bool:
        ok = self.compatible.get((a, b))
        if ok is None:
            if len(self.compatible) > MEMO:
                self.compatible.clear()
            ok = self.compatible[a, b] = self.merge(a + b) == [a, b]
        return ok

    def transition(self, state: int, byte: int) -> tuple[int, int]:
        """(next state, change in the number of tokens), compiled when first taken."""
        last, live = self.states[state]
        moved = []
        for node, before, n in (*live, (0, last, 0)):
            nxt = self.children[node].get(byte)
            if nxt is not None:
                moved.append((nxt, before, n))
        for node, before, n in moved:  # the longest suffix comes first
            t = self.entry[node]
            if t is not None and (not before or self.fits(before, t)):
                token, delta = t, n + 1
                break
        kept = tuple((node, before, n - delta) for node, before, n in moved if self.children[node])
        return self._numbered((token, kept)), delta

    def count(self, word: bytes) -> int:
        step, state, total = self.step, self.start, 0
        for b in word:
            key = state << 8 | b
            to = step.get(key)
            if to is None:
                to = step[key] = self.transition(state, b)
            state = to[0]
            total += to[1]
        return total


@dataclass(frozen=True)
class ChunkMap:
    """State map of a chunk: head (up to the first certain break), tokens to the last one, tail after it.

    ``whole`` says that there was no certain break: the chunk is all head.
    """

    head: str
    tokens: int = 0
    tail: str = ""
    whole: bool = False


class TokenCounter:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.transducer = BpeTransducer(spec)
        self.pieces = regex.compile(PRE_TOKEN).findall
        self.first_sync = regex.compile(SYNC).search
        self.last_sync = regex.compile("(?r)" + SYNC).search
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        transducer = self.transducer

        class Memo(dict):
            def __missing__(self, piece: str) -> int:
                if len(self) >= MEMO:
                    self.clear()
                if len(transducer.step) > TRANSITIONS:
                    transducer.forget()
                n = self[piece] = transducer.count(piece.encode("utf-8"))
                return n

        self.tokens_of = Memo().__getitem__

    def plain(self, text: str) -> int:
        """Tokens of a text whose two ends are breaks."""
        return sum(map(self.tokens_of, self.pieces(text)))

    def chunk_map(self, chunk: str) -> ChunkMap:
        a = self.first_sync(chunk)
        if a is None:
            return ChunkMap(chunk, whole=True)
        z = self.last_sync(chunk)
        return ChunkMap(chunk[: a.start()], self.plain(chunk[a.start() : z.start()]), chunk[z.start() :])

    def compose(self, left: ChunkMap, right: ChunkMap) -> ChunkMap:
        """The map of both chunks, one after the other. Associative."""
        if left.whole and right.whole:
            joined = left.head + right.head
            edge = self.first_sync(joined, max(len(left.head) - 1, 0), len(left.head) + 1) if left.head and right.head else None
            if edge is None:
                return ChunkMap(joined, whole=True)
            return ChunkMap(left.head, 0, right.head)
        if left.whole or right.whole:
            part = left.head + right.head if left.whole else left.tail + right.head
            at = len(left.head) if left.whole else len(left.tail)
            edge = self.first_sync(part, max(at - 1, 0), at + 1) if 0 < at < len(part) else None
            if left.whole:
                if edge is None:
                    return ChunkMap(part, right.tokens, right.tail)
                return ChunkMap(left.head, self.plain(right.head) + right.tokens, right.tail)
            if edge is None:
                return ChunkMap(left.head, left.tokens, part)
            return ChunkMap(left.head, left.tokens + self.plain(left.tail), right.head)
        return ChunkMap(left.head, left.tokens + self.plain(left.tail + right.head) + right.tokens, right.tail)

    def scan(self, maps: list[ChunkMap]) -> list[ChunkMap]:
        """Inclusive prefix scan by recursive doubling over pairs: every level's compositions are independent."""
        if len(maps) < 2:
            return maps
        pairs = self.scan([self.compose(maps[i], maps[i + 1]) for i in range(0, len(maps) - 1, 2)])
        return [maps[0] if i == 0 else pairs[i // 2] if i % 2 else self.compose(pairs[i // 2 - 1], maps[i]) for i in range(len(maps))]

    def segment(self, text: str, chunk: int = CHUNK) -> int:
        if len(text) <= chunk:
            return self.plain(text)
        total = self.scan([self.chunk_map(text[i : i + chunk]) for i in range(0, len(text), chunk)])[-1]
        return self.plain(total.head) + (0 if total.whole else total.tokens + self.plain(total.tail))

    def count(self, text: str, chunk: int = CHUNK) -> int:
        """Tokens of a text as the library counts them; strings of special tokens are one token each."""
        if self.special is None or "<" not in text:
            return self.segment(text, chunk)
        parts = self.special.split(text)
        return sum(self.segment(p, chunk) for p in parts) + len(parts) - 1


_counters: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    """One compiled counter a process and vocabulary."""
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, path: str, limit: int = 512, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row; whole texts, no added tokens.

    A null text counts as empty: 0 tokens. Repeated rows and null ids pass through; extra columns are ignored; an empty
    table gives no rows. ``path`` is the vocabulary file as executors see it.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = [c.count(t, chunk) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode("utf-8")) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return pick(docs, doc_id="long", text="string").transform(map_arrow, counted, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
