"""Token-ID output with Re-Pair grammar compression.

Documents are tokenised, put in ascending doc_id order by range partitions, and packed into blocks of whole documents.
In each block frequent pairs of neighbouring ids are replaced by nonterminals, round after round, until no pair is
frequent; where places overlap, the more frequent pair is replaced first. A block stores its rules with their expansion
lengths, the remaining sequence, and for each document where it starts in that sequence, so any document is decoded
alone. No rule spans two documents. Blocks are rows of a Parquet table in the shared folder.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from codecs import charmap_decode
from collections.abc import Callable, Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchweave.llm.common import gathered, map_arrow, pick, stage
from patchweave.llm.transducer import byte_alphabet

END_ID = 2
#: Ids of a block; a block closes with the document that reaches it.
BLOCK_IDS = 1 << 20
#: How often a pair must occur to be frequent: a rule costs two ids and its length, so rarer pairs gain little.
LEAST = 8
#: Pairs with this share of the round's highest count are replaced together; lower ones wait for later rounds.
SHARE = 1 / 64
#: Words that a worker remembers.
MEMO = 1_200_000
#: Texts, and bytes of them, that are encoded together.
TEXTS, TEXT_BYTES = 4096, 16 << 20

#: Marks after a word, up to a space or the end; no apostrophe, as "'s" is a token.
_STOP = r"([a-z\x{DF}-\x{F6}\x{F8}-\x{FF}])([!-&(-/:-@\[-`{-~]+)([ \n]|$)"
#: Marks of special tokens, and the letters whose lower case depends on their place or is longer.
_ODD = "<\\||\u03a3|\u0130"


#: The vocabulary's stand-in of each byte; the space parts words.
_BYTES = "".join(c for _, c in sorted((b, " " if b == 32 else c) for c, b in byte_alphabet().items()))


class Encoder:
    """Ids as the tokenizers library gives them, with a memo of words.

    The tokenizer never joins what spaces or line feeds part, so a text's ids are its words' ids in turn. It folds
    case, and marks between a letter and a space or the end are tokens of their own, so "Word. " is looked up as "word"
    and ".".
    Of words not met before, those of lower-case letters are one pre-token each and go to the library's model at once;
    the others go through the whole library many at a time, parted by a mark whose id no other word can bring. Texts
    that may hold strings of special tokens go to the library whole.

    ``memo`` numbers the words; the ids of word i are ``ids[stop[i]:stop[i + 1]]``.
    """

    MARK = "\x07"

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.forget()
        mark = self.library.encode(self.MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        model = json.loads(self.library.to_str())["model"]
        suffix = model.get("end_of_word_suffix")
        self.last = np.zeros(self.library.get_vocab_size(), bool)  # ids that end a word
        for token, i in model["vocab"].items():
            self.last[i] = bool(suffix) and token.endswith(suffix)

    def forget(self) -> None:
        self.memo: dict[str, int] = {"": 0}
        self.ids, self.stop = np.zeros(0, "<u4"), np.zeros(2, np.int32)

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        """Number plain words, distinct and new, with their ids by the library."""
        done, ids, size = [], [self.ids], [np.diff(self.stop)]
        simple = [w for w in words if w.isalpha() and w.islower() and (w.isascii() or is_normalized("NFC", w))]
        if simple:
            tokenize, found, stop = self.library.model.tokenize, array("I"), []
            for w in charmap_decode(" ".join(simple).encode(), "strict", _BYTES)[0].split(" "):
                found.extend([t.id for t in tokenize(w)])
                stop.append(len(found))
            found, stop = np.array(found, "<u4"), np.array(stop)
            # Else it is not a vocabulary with word ends: the library's whole way below.
            if np.array_equal(np.flatnonzero(self.last[found]) + 1, stop):
                done += simple
                ids.append(found)
                size.append(np.diff(stop, prepend=0))
                simple = set(simple)
                words = [w for w in words if w not in simple]
        for w in words if self.mark is None else [w for w in words if self.MARK in w]:
            done.append(w)
            ids.append(np.frombuffer(self.whole(w), "<u4"))
            size.append(np.array([len(ids[-1])]))
        plain = [w for w in words if self.MARK not in w] if self.mark is not None else []
        for i in range(0, len(plain), 4096):
            part = plain[i : i + 4096]
            joined = f" {self.MARK} ".join(part)
            found = np.array(self.library.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            cut = np.flatnonzero(found == self.mark)
            done += part
            ids.append(np.delete(found, cut))
            size.append(np.diff(cut, prepend=-1, append=len(found)) - 1)
        self.memo.update(zip(done, range(len(self.memo), len(self.memo) + len(done)), strict=True))
        self.ids, size = np.concatenate(ids), np.concatenate(size)
        self.stop = np.concatenate(([0], np.cumsum(size))).astype(np.int32)

    def encode_all(self, texts: pa.Array) -> list[np.ndarray]:
        """Unsigned 32-bit ids of each text (null: none). Words are folded, split and numbered by Arrow's kernels."""
        if len(self.memo) > MEMO:
            self.forget()
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(odd), "", texts)
        words = pc.split_pattern(pc.replace_substring(pc.replace_substring_regex(pc.utf8_lower(plain), _STOP, r"\1 \2\3"), "\n", " "), " ")
        first = words.offsets.to_numpy() - words.offsets[0].as_py()
        numbered = words.flatten().dictionary_encode()
        del plain, words
        distinct, at = numbered.dictionary.to_numpy(zero_copy_only=False).tolist(), numbered.indices.to_numpy()
        known = list(map(self.memo.get, distinct))
        new = [i for i, k in enumerate(known) if k is None]
        self._learn([distinct[i] for i in new])
        for i in new:
            known[i] = self.memo[distinct[i]]
        del distinct, new
        known = np.array(known, np.int32)
        start = self.stop[known]
        n = (self.stop[known + 1] - start)[at]
        stop = np.zeros(len(n) + 1, np.int32)  # a batch has fewer than 2**31 ids
        np.cumsum(n, out=stop[1:])
        source = np.repeat(start[at] - stop[:-1], n)
        del numbered, at, n
        source += np.arange(len(source), dtype=np.int32)
        flat = self.ids[source]
        bound = stop[first].tolist()
        out = [flat[a:b] for a, b in zip(bound, bound[1:], strict=False)]
        for i in np.flatnonzero(odd).tolist():
            out[i] = np.frombuffer(self.whole(texts[i].as_py()), "<u4")
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def frequent_pairs(left: np.ndarray, right: np.ndarray, least: int, at: np.ndarray | None = None, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, Callable]:
    """(pairs that occur ``least`` times, two or more, as left << 32 | right, their counts, the places of the pairs of some indices, one pair after the other).

    ``at`` names the places (default: from 0), ``skip`` marks those left out. Pair and place are sorted as one number if
    they fit 64 bits together.
    """
    n = len(left)
    if n < least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), lambda chosen: np.zeros(0, np.int32)
    symbol, low = max(int(left.max()), int(right.max())).bit_length(), n.bit_length()
    fits = 2 * symbol + low <= 64
    if not fits:
        symbol, low = 32, 0
    key = left.astype(np.uint64)
    key <<= np.uint64(symbol)
    key |= right
    if fits:
        key <<= np.uint64(low)
        key |= np.arange(n, dtype=np.uint64)
        if skip is not None:
            key[skip] = np.iinfo(np.uint64).max  # behind all others
            n -= int(np.count_nonzero(skip))
        key.sort()
        key = key[:n]
        pair = key >> np.uint64(low)
    else:
        order = np.flatnonzero(~skip) if skip is not None else np.arange(n)
        order = order[np.argsort(key[order], kind="stable")]
        pair = key[order]
    # Where the pair at least - 1 places on is the same; each frequent pair has one such stretch, and the next begins later.
    hit = np.zeros(max(len(pair) - least + 1, 0) + 2, bool)
    np.equal(pair[least - 1 :], pair[: max(len(pair) - least + 1, 0)], out=hit[1:-1])
    start = np.flatnonzero(hit[1:] > hit[:-1])
    times = np.flatnonzero(hit[1:] < hit[:-1]) + (least - 1) - start
    pairs = pair[start].astype(np.int64)

    def places(chosen: np.ndarray) -> np.ndarray:
        many = times[chosen]
        i = np.repeat(start[chosen] - np.cumsum(many) + many, many)
        i += np.arange(len(i))
        found = (key[i] & np.uint64((1 << low) - 1)).astype(np.int32) if fits else order[i].astype(np.int32)
        return found if at is None else at[found]

    return pairs >> symbol << 32 | pairs & ((1 << symbol) - 1), times, places


def compress(ids: np.ndarray, ends: np.ndarray, base: int, least: int = LEAST, share: float = SHARE):
    """Re-Pair: (sequence, rules as rows of left and right, expansion length of each rule, index in the sequence of each document's end).

    ``ends`` marks the last id of each document, which starts no pair; ``base`` is the first nonterminal. In each round
    the pairs that occur ``least`` times, and ``share`` of the highest count, are ranked by count, equal ones at random;
    a place is replaced if no place that overlaps it has a better rank, in a run of one pair every other place. Rounds
    end when no pair occurs ``least`` times (4 or more, so that the best pair is always replaced twice).

    While rounds replace much, the sequence is closed up after each and counted whole. Then symbols are linked to their
    neighbours, and only pairs that were frequent or have a new symbol are counted, as no others can be frequent.
    """
    seq, end = ids.astype(np.uint32), ends.copy()
    rules: list[np.ndarray] = []
    size = np.ones(0, np.int64)
    length_of = lambda s: np.where(s < base, 1, size[np.maximum(s - base, 0)] if len(size) else 1)
    none = np.iinfo(np.int32).max
    place = np.full(len(seq) + 1, none, np.int32)  # the last one stands for what is beyond both ends
    linked = False
    while len(seq) > 1:
        if linked:
            pairs, times, places_of = frequent_pairs(seq[places], seq[after[places]], least, at=places)
        else:
            pairs, times, places_of = frequent_pairs(seq[:-1], seq[1:], least, skip=end[:-1])
        if not len(times):
            break
        often = np.flatnonzero(times >= max(least, int(times.max()) * share))
        chance = pairs[often].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)
        rank = np.empty(len(often), np.int32)
        rank[np.lexsort((chance, -times[often]))] = np.arange(len(often))
        at = places_of(often)
        place[at] = np.repeat(rank, times[often])
        at.sort()
        mine = place[at]
        left, right = (before[at], after[at]) if linked else (at - 1, at + 1)
        wins = (place[left] >= mine) & (place[right] >= mine)
        same = np.flatnonzero((left[1:] == at[:-1]) & (mine[1:] == mine[:-1])) + 1  # places in a run, but its first
        i = np.arange(len(same))
        wins[same[(i - np.maximum.accumulate(np.where(np.diff(same, prepend=-1) == 1, 0, i))) % 2 == 0]] = False
        place[at] = none
        at, mine = at[wins], mine[wins]
        gains = np.bincount(mine, minlength=len(often)) > 1
        number = (np.cumsum(gains) - 1).astype(np.int32)
        if not gains.all():
            at, mine = at[gains[mine]], mine[gains[mine]]
        gone = after[at] if linked else at + 1
        example = np.zeros(len(often), np.int64)
        example[mine] = np.arange(len(at))
        example = example[gains]
        pair = np.stack([seq[at[example]], seq[gone[example]]], 1).astype(np.int64)
        new = length_of(pair[:, 0]) + length_of(pair[:, 1])
        if linked:
            place[at] = place[gone] = 0  # touched
            still = places_of(np.arange(len(times)))
            still = still[(place[still] == none) & (place[after[still]] == none)]
            place[at] = place[gone] = none
        seq[at] = (base + len(size) + number[mine]).astype(np.uint32)
        end[at] = end[gone]
        rules.append(pair)
        size = np.concatenate([size, new])
        if linked:
            alive[gone] = False
            right = after[gone]
            after[at] = right
            before[right] = at
            left = before[at]
            places = np.unique(np.concatenate([still, at, left[left >= 0]]))
            places = places[~end[places]]
            continue
        keep = np.ones(len(seq), bool)
        keep[gone] = False
        seq, end = seq[keep], end[keep]
        n = len(seq)
        place = place[: n + 1]
        if len(at) < n // 32:
            linked, alive = True, np.ones(n, bool)
            after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
            places = np.flatnonzero(~end[:-1]).astype(np.int32)
    if linked:
        seq, end = seq[alive], end[alive]
    return seq, np.concatenate(rules) if rules else np.zeros((0, 2), np.int64), size, np.flatnonzero(end)


class Grammar:
    """Rules of a block, ready to expand any stretch of its sequence."""

    def __init__(self, rules: np.ndarray, lengths: np.ndarray, base: int):
        self.base = base
        self.lengths = lengths
        self.offset = np.concatenate(([0], np.cumsum(lengths)))
        # One table of all symbols: terminals stand for themselves, expansions follow.
        self.table = np.concatenate([np.arange(base, dtype=np.uint32), np.zeros(int(self.offset[-1]), np.uint32)])
        self.start = np.concatenate([np.arange(base), base + self.offset[:-1]])
        self.size = np.concatenate([np.ones(base, np.int64), lengths])
        needs = np.maximum.accumulate(rules.max(1, initial=0)) - base
        done = 0
        while done < len(rules):  # a rule only uses earlier ones: all that use rules done are expanded together
            ready = int(np.searchsorted(needs, done))
            self.table[base + self.offset[done] : base + self.offset[ready]] = self.expand(rules[done:ready].ravel())
            done = ready

    def expand(self, seq: np.ndarray) -> np.ndarray:
        n = self.size[seq]
        stop = np.cumsum(n)
        at = np.repeat(self.start[seq] - stop + n, n)
        at += np.arange(len(at))
        return self.table[at]


def planes(seq: np.ndarray) -> bytes:
    """The low 16 bits of all symbols, then the high 16 bits if any symbol has some; equal bytes lie together."""
    low = (seq & 0xFFFF).astype("<u2").tobytes()
    return low + (seq >> 16).astype("<u2").tobytes() if len(seq) and int(seq.max()) >> 16 else low


def unplaned(stored: bytes, n: int) -> np.ndarray:
    """The n symbols that ``planes`` stored."""
    seq = np.frombuffer(stored, "<u2", n).astype(np.int64)
    return seq | np.frombuffer(stored, "<u2", n, 2 * n).astype(np.int64) << 16 if len(stored) > 2 * n else seq


BLOCKS = "part int, block int, before long, n_ids long, base int, doc_ids binary, no_id binary, doc_stop binary, doc_len binary, rules binary, rule_len binary, seq binary"


def _pack(part: int, block: int, before: int, docs: list, ids: list[np.ndarray], base: int) -> pa.RecordBatch:
    flat = np.concatenate(ids)
    doc_len = np.array([len(x) for x in ids], np.int64)
    ends = np.zeros(len(flat), bool)
    ends[np.cumsum(doc_len) - 1] = True
    seq, rules, lengths, stops = compress(flat, ends, base)
    values = [
        part, block, before, len(flat), base, np.array([d or 0 for d in docs], "<i8").tobytes(), np.array([d is None for d in docs], bool).tobytes(),
        (stops + 1).astype("<u4").tobytes(), doc_len.astype("<u4").tobytes(), rules.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), planes(seq),
    ]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 7]
    names = [c.split(" ")[0] for c in BLOCKS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)


def write_blocks(docs: DataFrame, path: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Tokenise ``docs`` and write the blocks; returns them as read back. Null ids come first, ties by text."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        base = enc.library.get_vocab_size()
        end = np.uint32(end_id)
        part = TaskContext.get().partitionId()
        block = before = held = 0
        docs_, ids = [], []
        for b in gathered(batches, TEXTS, TEXT_BYTES):
            for doc_id, x in zip(b.column(0).to_pylist(), enc.encode_all(b.column(1)), strict=True):
                docs_.append(doc_id)
                ids.append(np.append(x, end))
                held += len(x) + 1
                if held >= block_ids:
                    yield _pack(part, block, before, docs_, ids, base)
                    block, before, held, docs_, ids = block + 1, before + held, 0, [], []
        if docs_:
            yield _pack(part, block, before, docs_, ids, base)

    ordered = pick(docs, doc_id="long", text="string").repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return stage(ordered.transform(map_arrow, packed, BLOCKS), "token-blocks")


def _grammar(row: dict) -> tuple[Grammar, np.ndarray]:
    rules = np.frombuffer(row["rules"], "<u4").astype(np.int64).reshape(-1, 2)
    return Grammar(rules, np.frombuffer(row["rule_len"], "<u4").astype(np.int64), row["base"]), unplaned(row["seq"], int(np.frombuffer(row["doc_stop"], "<u4")[-1]))


def decode_one(row: dict, i: int) -> np.ndarray:
    """Ids of the i-th document of a stored block alone."""
    grammar, seq = _grammar(row)
    stop = np.frombuffer(row["doc_stop"], "<u4")
    return grammar.expand(seq[int(stop[i - 1]) if i else 0 : int(stop[i])])


def decode(row: dict) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of every document of a stored block, expanded together."""
    grammar, seq = _grammar(row)
    ids = grammar.expand(seq)
    stop = np.cumsum(np.frombuffer(row["doc_len"], "<u4").astype(np.int64))
    at = 0
    for d, none, z in zip(np.frombuffer(row["doc_ids"], "<i8").tolist(), np.frombuffer(row["no_id"], bool).tolist(), stop.tolist(), strict=True):
        yield None if none else d, ids[at:z]
        at = z


def read_documents(blocks: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document, from the stored blocks.

    ``start`` counts the ids of all documents before: those of earlier range partitions, earlier blocks, and earlier
    documents of the block. Partitions are few, so their running sum takes one small window.
    """
    names = ["doc_id", "part", "at", "n_tokens", "ids_crc32", "ids"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                at, out = row["before"], []
                for doc_id, ids in decode(row):
                    out.append((doc_id, row["part"], at, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4")), ids.tolist() if with_ids else None))
                    at += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    docs = blocks.transform(map_arrow, read, "doc_id long, part int, at long, n_tokens long, ids_crc32 long, ids array<long>")
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("base", F.sum("n").over(Window.orderBy("part")) - F.col("n"))
    out = docs.join(F.broadcast(parts.select("part", "base")), "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "ids")
    return out if with_ids else out.drop("ids")


def token_output(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """Write and read back: doc_id, start, n_tokens, ids_crc32 for every row of ``docs``.

    A null or empty text has the end id alone. Rows without an id come first; rows of one id are ordered by text, and
    equal rows may swap. An empty table gives no rows. Extra columns are ignored. A block holds whole documents, so
    memory grows with the longest text. ``path`` is the vocabulary file as executors see it.
    """
    return read_documents(write_blocks(docs, path, end_id))
