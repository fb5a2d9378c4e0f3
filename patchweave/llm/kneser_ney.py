"""Quality classifier: interpolated modified Kneser-Ney 6-gram model of trusted text over its real characters.

Counts of trusted text are summed in each task, dealt by n-gram, and joined shard by shard, order by order, into
smoothed probabilities and back-off weights. The model grows with the trusted text; documents are scored against it in
blocks of bounded size. Below the single character stands a 4-gram model over 64 character classes, so that characters
never seen have a probability too. A document's perplexity is compared with a threshold of its language, which is set
on trusted documents that were held out of the model.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchweave.llm.common import map_arrow, pick, stage, wrapped

ORDER, BITS = 4, 6
SYMBOLS = 1 << BITS
#: Order of the model of real characters, and what stands before a text: no character.
CHARS, START = 6, "\U0010ffff"
#: N-grams and contexts of the model of characters that are broadcast together (12 bytes each); more take more passes.
MODEL_ENTRIES = 4_000_000
#: One of so many trusted documents, by the hash of its text, is held out of the model; thresholds are set on those.
FOLDS = 5
#: A language's threshold is that of these quantiles of its held-out documents' perplexities that parts them best from bad ones.
#: None is below 0.98, so that few good documents are lost.
QUANTILES = (0.98, 0.985, 0.99, 0.995, 1.0)
#: Languages with fewer held-out documents than this use the threshold of all languages.
LEAST_TRUSTED = 20
#: Trusted ids (8 bytes each) up to which they are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Characters that are counted or scored together, and blocks whose counts are summed together.
BLOCK, BLOCKS = 1 << 19, 6
#: Windows whose costs a worker remembers (12 bytes each); beyond that it starts anew.
MEMO = 1_500_000


@lru_cache(maxsize=1)
def symbol_table() -> np.ndarray:
    """Class of each code point. 0 is the start of a text, 1 white space, 2-27 a-z, 28 a capital, 29 a digit.

    30-45 are ASCII punctuation and symbols (by code modulo 16), 46-63 are all other characters (by code modulo 18).
    """
    code = np.arange(0x110000)
    out = 46 + code % 18
    out[:128] = 30 + code[:128] % 16
    for c in [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]:
        out[c] = 1
    out[ord("a") : ord("z") + 1] = 2 + np.arange(26)
    out[ord("0") : ord("9") + 1] = 29
    out[ord("A") : ord("Z") + 1] = 28
    for c in range(0xC0, 0x500):  # capitals of Latin, Greek and Cyrillic
        if chr(c).isupper():
            out[c] = 28
    return out.astype(np.uint8)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the 4-grams that end at each character of each text, and the texts' lengths in characters."""
    lengths = np.array([len(t) for t in texts], np.int64)
    pad = "\0" * (ORDER - 1)
    joined = np.frombuffer((pad + pad.join(texts)).encode("utf-32-le", "surrogatepass"), np.uint32)
    s = symbol_table()[joined].astype(np.uint32)
    start = np.cumsum(lengths + ORDER - 1) - lengths  # of each text's characters
    for k in range(1, ORDER):
        s[start - k] = 0
    code = s[ORDER - 1 :].copy()
    for k in range(1, ORDER):
        code |= s[ORDER - 1 - k : len(s) - k] << np.uint32(BITS * k)
    inside = np.ones(len(code), bool)
    gaps = (start[1:, None] - np.arange(ORDER - 1, 0, -1)[None, :] - (ORDER - 1)).ravel()
    inside[gaps] = False
    return code[inside], lengths


def _blocks(texts: Iterable[str]) -> Iterator[list[str]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= BLOCK:
            yield held
            held, size = [], 0
    if held:
        yield held


def gram_counts(trusted: DataFrame) -> DataFrame:
    """(gram, c): occurrences of each 4-gram in ``trusted`` (text). Each task sends its sums."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def summed() -> tuple[np.ndarray, np.ndarray]:
            codes, where = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return codes, np.bincount(where, np.concatenate([c for _, c in held]), len(codes)).astype(np.int64)

        for part in _blocks(t for b in batches for t in b.column(0).to_pylist() if t):
            held.append(np.unique(grams(part)[0], return_counts=True))
            if len(held) > BLOCKS:
                held = [summed()]
        if held:
            at, total = summed()
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(total)], ["gram", "c"])

    return trusted.select("text").transform(map_arrow, count, "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c"))


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more, from the counts of counts."""
    n = {r.c: r.n for r in counts.where("c <= 4").groupBy("c").agg(F.count("*").alias("n")).collect()}
    n1, n2, n3, n4 = (n.get(k, 0) for k in (1, 2, 3, 4))
    if not n1 or not n2:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    ds = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * (n4 / n3) if n3 else 1.0)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), ds, strict=True))


def smoothed(counts: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """For orders 1 to 4: (gram, p) of seen n-grams and (context, g), the weight that is left to the order below.

    Orders below the highest count the distinct characters before an n-gram. Every join is on the n-gram or its
    context, so shards of the count tables meet and nothing is gathered.
    """
    levels = {ORDER: counts}
    for n in range(ORDER - 1, 0, -1):
        levels[n] = levels[n + 1].groupBy((F.col("gram") % (1 << (BITS * n))).alias("gram")).agg(F.count("*").alias("c"))
    out: list[tuple[DataFrame, DataFrame]] = []
    lower = None
    for n in range(1, ORDER + 1):
        t = stage(levels[n], f"counts-{n}")
        d1, d2, d3 = discounts(t)
        d = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        t = t.withColumn("context", F.shiftright("gram", BITS)).withColumn("d", d)
        contexts = t.groupBy("context").agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("g"))
        own = t.join(contexts, "context").withColumn("own", (F.col("c") - F.col("d")) / F.col("total"))
        if lower is None:
            p = own.select("gram", (F.col("own") + F.col("g") / SYMBOLS).alias("p"))
        else:
            rest = lower.select(F.col("gram").alias("suffix"), F.col("p").alias("q"))
            p = own.withColumn("suffix", F.col("gram") % (1 << (BITS * (n - 1)))).join(rest, "suffix").select("gram", (F.col("own") + F.col("g") * F.col("q")).alias("p"))
        lower = stage(p, f"smoothed-{n}")
        out.append((lower, contexts.select("context", "g")))
    return out


def _array(df: DataFrame, key: str, value: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and their values."""
    t = df.select(F.col(key).cast("int"), F.col(value).cast("float")).toArrow()
    keys, values = t.column(0).to_numpy(), t.column(1).to_numpy()
    by = np.argsort(keys)
    return keys[by], values[by]


def model_of(counts: DataFrame) -> list[tuple[tuple, tuple]]:
    """Seen probabilities and weights of each order as arrays: at most 64**4 and 64**3 entries of 8 bytes."""
    return [(_array(p, "gram", "p"), _array(g, "context", "g")) for p, g in smoothed(counts)]


def class_probabilities(code: np.ndarray, model: list[tuple[tuple, tuple]]) -> np.ndarray:
    """Probability of the last class of each 4-gram code after the other three."""
    p = np.full(len(code), 1 / SYMBOLS)
    for n, (seen, weights) in enumerate(model, 1):
        mine = (code & ((1 << (BITS * n)) - 1)).astype(np.int32)
        known, weight = _find(weights, mine >> BITS)
        p = np.where(known, weight * p, p)
        known, own = _find(seen, mine)
        p = np.where(known, own, p)
    return np.maximum(p, 1e-12)


def windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the CHARS-gram that ends at each character, one row each, and the texts' lengths. No NUL is left."""
    lengths = np.array([len(t) for t in texts], np.int64)
    pad = START * (CHARS - 1)
    c = np.frombuffer((pad + pad.join(texts) + START * CHARS).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    c[c == 0] = 0xFFFD
    at = np.arange(lengths.sum()) + np.repeat((CHARS - 1) * np.arange(len(texts)), lengths)
    return np.lib.stride_tricks.sliding_window_view(c, CHARS)[at], lengths


def keys_of(codes: np.ndarray) -> np.ndarray:
    """64-bit keys of rows of up to CHARS code points; equal rows have equal keys, up to three characters exactly so."""
    pack = lambda part: sum((part[:, i].astype(np.uint64) << np.uint64(21 * (part.shape[1] - 1 - i)) for i in range(part.shape[1])), np.zeros(len(part), np.uint64))
    low, high = pack(codes[:, -3:]), pack(codes[:, :-3])
    if codes.shape[1] <= 3:
        return low
    high = (high ^ (high >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = low ^ high ^ (high >> np.uint64(29))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def distinct_windows(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys of the distinct rows, a row that has each, which of them each row is), by hashing instead of sorting."""
    found = pa.array(keys_of(w).view(np.int64)).dictionary_encode()
    which = found.indices.to_numpy()
    keys = found.dictionary.to_numpy().view(np.uint64)
    row = np.empty(len(keys), np.int64)
    row[which] = np.arange(len(which))
    return keys, row, which


def char_counts(trusted: DataFrame) -> DataFrame:
    """(gram, c): occurrences in ``trusted`` (text) of each string of CHARS real characters. Each task sends its sums."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def summed() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            keys, first, where = np.unique(np.concatenate([k for k, _, _ in held]), return_index=True, return_inverse=True)
            return keys, np.concatenate([w for _, w, _ in held])[first], np.bincount(where, np.concatenate([c for _, _, c in held]), len(keys)).astype(np.int64)

        for part in _blocks(t for b in batches for t in b.column(0).to_pylist() if t):
            w, _ = windows(part)
            k, row, which = distinct_windows(w)
            held.append((k, w[row], np.bincount(which, minlength=len(k))))
            if len(held) > BLOCKS:
                held = [summed()]
        if not held:
            return
        keys, codes, total = summed()
        for i in range(0, len(keys), 1 << 17):
            text = np.ascontiguousarray(codes[i : i + (1 << 17)]).view(f"<U{CHARS}").ravel().tolist()
            yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()), pa.array(total[i : i + (1 << 17)])], ["gram", "c"])

    return trusted.select("text").transform(map_arrow, count, "gram string, c long").groupBy("gram").agg(F.sum("c").alias("c"))


def smoothed_chars(counts: DataFrame) -> DataFrame:
    """(kind, n, gram, v) of the model of real characters, as shards.

    Kind 'a': the interpolated probability of a seen n-gram, less what the class model adds. Kind 'g': the product of
    a context's left-over weight and those of all its shorter contexts; that of the longest seen context is the class
    model's share.
    """
    levels = {CHARS: stage(counts, f"char-counts-{CHARS}")}
    for n in range(CHARS - 1, 0, -1):
        levels[n] = stage(levels[n + 1].groupBy(F.substring("gram", 2, n).alias("gram")).agg(F.count("*").alias("c")), f"char-counts-{n}")
    rows, a, g = None, None, None
    for n in range(1, CHARS + 1):
        d1, d2, d3 = discounts(levels[n])
        d = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        t = levels[n].withColumn("context", F.substring("gram", 1, n - 1)).withColumn("d", d)
        contexts = t.groupBy("context").agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("left"))
        own = t.join(contexts, "context").withColumn("v", (F.col("c") - F.col("d")) / F.col("total"))
        if n == 1:
            a, g = own.select("gram", "v"), contexts.select(F.col("context").alias("gram"), F.col("left").alias("v"))
        else:
            below = a.select(F.col("gram").alias("suffix"), F.col("v").alias("q"))
            weight = g.select(F.col("gram").alias("suffix"), F.col("v").alias("q"))
            a = own.withColumn("suffix", F.substring("gram", 2, n - 1)).join(below, "suffix").select("gram", (F.col("v") + F.col("left") * F.col("q")).alias("v"))
            g = contexts.withColumn("suffix", F.substring("context", 2, n - 2)).join(weight, "suffix").select(F.col("context").alias("gram"), (F.col("left") * F.col("q")).alias("v"))
        a, g = stage(a, f"char-p-{n}"), stage(g, f"char-weights-{n}")
        both = a.select(F.lit("a").alias("kind"), F.lit(n).alias("n"), "gram", "v").unionByName(g.select(F.lit("g").alias("kind"), F.lit(n - 1).alias("n"), "gram", "v"))
        rows = both if rows is None else rows.unionByName(both)
    # the character before the predicted one decides the block; what has none goes to every block
    before = F.when(F.col("kind") == "g", F.substring("gram", -1, 1)).otherwise(F.substring("gram", -2, 1))
    return rows.withColumn("before", F.when((F.col("n") > 0) & ((F.col("kind") == "g") | (F.col("n") > 1)), before))


def model_blocks(model: DataFrame, entries: int | None = None) -> list[set[str]]:
    """Sets of preceding characters whose shards are broadcast together: about ``entries`` n-grams each."""
    blocks, held, most = [set()], 0, entries or MODEL_ENTRIES
    for r in model.where("before is not null").groupBy("before").agg(F.count("*").alias("n")).orderBy("before").collect():
        if held and held + r.n > most:
            blocks.append(set())
            held = 0
        blocks[-1].add(r.before)
        held += r.n
    return blocks


def _keyed(model: DataFrame) -> dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]:
    """Sorted keys and values of each kind and order of a block; the keys are made by the tasks."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams_, n = b.column(2).to_pylist(), b.column(1).to_numpy()
            out = np.zeros(len(n), np.uint64)
            for k in range(1, CHARS + 1):
                at = np.flatnonzero(n == k)
                if len(at):
                    out[at] = keys_of(np.frombuffer("".join(grams_[i] for i in at).encode("utf-32-le"), np.uint32).reshape(-1, k))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out.view(np.int64)), pa.array(b.column(3).to_numpy().astype(np.float32))], ["seen", "n", "k", "v"])

    t = model.select((F.col("kind") == "a").alias("seen"), F.col("n").cast("byte").alias("n"), "gram", "v").transform(map_arrow, keys, "seen boolean, n byte, k long, v float").toArrow()
    kind, n = t.column(0).to_numpy(), t.column(1).to_numpy()
    k, v, out = t.column(2).to_numpy().view(np.uint64), t.column(3).to_numpy(), {}
    for name, mine in (("a", kind), ("g", ~kind)):
        for order in range(CHARS + 1):
            at = np.flatnonzero(mine & (n == order))
            at = at[np.argsort(k[at])]
            out[name, order] = k[at], v[at]
    return out


def _find(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    held, value = table
    if not len(held):
        return np.zeros(len(keys), bool), np.zeros(len(keys))
    at = np.minimum(np.searchsorted(held, keys), len(held) - 1)
    return held[at] == keys, value[at].astype(np.float64)


def char_costs(w: np.ndarray, model: dict, classes: list[tuple[tuple, tuple]]) -> np.ndarray:
    """Negative natural log probability of the last character of each row of code points after the others.

    Below the single character stands the 4-gram model of classes, which a class's characters share evenly.
    """
    s = np.where(w == ord(START), 0, symbol_table()[w]).astype(np.uint32)
    code = sum(s[:, CHARS - 1 - k] << np.uint32(BITS * k) for k in range(ORDER))
    floor = class_probabilities(code, classes) / np.maximum(np.bincount(symbol_table(), minlength=SYMBOLS), 1)[s[:, -1]]
    empty = model["g", 0][1]
    below = np.full(len(w), float(empty[0]) if len(empty) else 1.0)  # the product of weights of the longest seen context so far
    p = np.zeros(len(w))
    for n in range(1, CHARS + 1):
        if n > 1:
            seen, weight = _find(model["g", n - 1], keys_of(w[:, CHARS - n : -1]))
            p = np.where(seen, p * (weight / below), p)
            below = np.where(seen, weight, below)
        seen, own = _find(model["a", n], keys_of(w[:, CHARS - n :]))
        p = np.where(seen, own, p)
    return -np.log(np.maximum(p + below * floor, 1e-30))


#: Sorted keys of windows that a worker has met, and their costs, by the name of the model and its block.
_costs: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}


def remembered_costs(name: tuple[str, int], keys: np.ndarray, cost_of) -> np.ndarray:
    """Costs of distinct keys; ``cost_of`` is asked for those (by their index) that the worker has not met."""
    if name not in _costs or len(_costs[name][0]) > MEMO:
        _costs.clear()
        _costs[name] = np.zeros(0, np.uint64), np.zeros(0, np.float32)
    held, value = _costs[name]
    by = np.argsort(keys)
    place = np.searchsorted(held, keys[by])
    known = held[np.minimum(place, len(held) - 1)] == keys[by] if len(held) else np.zeros(len(keys), bool)
    out = np.empty(len(keys), np.float32)
    out[by[known]] = value[place[known]]
    new = by[~known]
    if len(new):
        out[new] = cost_of(new)
        _costs[name] = np.insert(held, place[~known], keys[new]), np.insert(value, place[~known], out[new])
    return out


def perplexities(docs: DataFrame, counts: DataFrame, chars: DataFrame) -> DataFrame:
    """doc_id, lang, th, n_symbols, perplexity a character of every row; null for a null or empty text.

    The class model is broadcast whole. The model of characters, which grows with the trusted text, is broadcast in
    blocks by the character before the predicted one; each pass sums the losses that its block decides.
    """
    spark, name = docs.sparkSession, uuid.uuid4().hex
    shared = spark.sparkContext.broadcast(model_of(counts))
    model = stage(smoothed_chars(chars), "char-model")
    blocks = model_blocks(model)
    base = pick(docs, doc_id="long", lang="string", text="string").select(F.monotonically_increasing_id().alias("row"), "doc_id", "lang", F.xxhash64("text").alias("th"), "text")
    parts = None
    for i, mine in enumerate(blocks):
        part = model if len(blocks) == 1 else model.where(F.col("before").isNull() | F.col("before").isin(sorted(mine)))
        block = spark.sparkContext.broadcast(_keyed(part))
        known = spark.sparkContext.broadcast(None if len(blocks) == 1 else np.array(sorted(ord(c) for b in blocks for c in b), np.uint32))
        own = np.array(sorted(map(ord, mine)), np.uint32)

        def score(batches: Iterator[pa.RecordBatch], i=i, block=block, known=known, own=own) -> Iterator[pa.RecordBatch]:
            for b in batches:
                n, loss = [], []
                for texts in _blocks(t or "" for t in b.column(4).to_pylist()):
                    w, lengths = windows(texts)
                    keys, row, where = distinct_windows(w)

                    def cost_of(new: np.ndarray, w=w, row=row) -> np.ndarray:
                        seen = w[row[new]]
                        cost = char_costs(seen, block.value, shared.value)
                        if known.value is not None:  # characters that no n-gram has before its last one belong to the first block
                            before = seen[:, -2]
                            cost[~(np.isin(before, own) | ((i == 0) & ~np.isin(before, known.value)))] = 0
                        return cost

                    cost = remembered_costs((name, i), keys, cost_of).astype(np.float64)
                    run = np.concatenate(([0.0], np.cumsum(cost[where])))
                    stop = np.cumsum(lengths)
                    n.append(lengths)
                    loss.append(run[stop] - run[stop - lengths])
                n, loss = (np.concatenate(x) if x else np.zeros(0) for x in (n, loss))
                yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(n.astype(np.int64)), pa.array(loss.astype(np.float64))], ["row", "doc_id", "lang", "th", "n_symbols", "loss"])

        found = base.transform(map_arrow, score, "row long, doc_id long, lang string, th long, n_symbols long, loss double")
        parts = found if parts is None else parts.unionByName(found)
    if len(blocks) > 1:
        parts = parts.groupBy("row", "doc_id", "lang", "th", "n_symbols").agg(F.sum("loss").alias("loss"))
    return parts.select("doc_id", "lang", "th", "n_symbols", F.when(F.col("n_symbols") > 0, F.round(F.exp(F.col("loss") / F.col("n_symbols")), 6)).alias("perplexity"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids labelled 1 in quality (in any of an id's rows) and not toxic in any."""
    marks = pick(labels, doc_id="long", quality="int", toxic="int").where("doc_id is not null")
    return marks.groupBy("doc_id").agg(F.max("quality").alias("q"), F.coalesce(F.max("toxic"), F.lit(0)).alias("x")).where("q = 1 and x = 0").select("doc_id")


def judged_ids(labels: DataFrame, quality: int) -> DataFrame:
    """Ids whose quality is ``quality``, toxic or not: 1 if any of an id's rows has it, else 0."""
    marks = pick(labels, doc_id="long", quality="int").where("doc_id is not null")
    return marks.groupBy("doc_id").agg(F.max("quality").alias("q")).where(F.col("q") == quality).select("doc_id")


def thresholds(good: DataFrame, bad: DataFrame) -> DataFrame:
    """(overall, lang, n, threshold) from held-out good and from bad perplexities (lang, perplexity).

    Of the quantiles of the good ones that is taken which keeps most of them less the share of bad ones that it keeps,
    the highest if there are several; so a few junk rows among the good ones, which lift the upper quantiles, lose to
    the bad rows that those let in. One row is for all languages together.
    """
    twice = F.explode(F.array(F.struct(F.lit(False).alias("overall"), "lang"), F.struct(F.lit(True).alias("overall"), F.lit(None).cast("string").alias("lang")))).alias("k")
    good, bad = (x.where("perplexity is not null").select(twice, "perplexity").select("k.*", "perplexity") for x in (good, bad))
    cuts = good.groupBy("overall", "lang").agg(F.percentile_approx("perplexity", F.array(*map(F.lit, QUANTILES)), F.lit(10_000)).alias("t"), F.count("*").alias("n"))
    cuts = cuts.select("overall", "lang", "n", F.explode(F.arrays_zip("t", F.array(*map(F.lit, QUANTILES)).alias("q"))).alias("c")).select("overall", "lang", "n", "c.t", "c.q").alias("c")
    b = bad.alias("b")
    mine = (F.col("b.overall") == F.col("c.overall")) & F.col("b.lang").eqNullSafe(F.col("c.lang"))
    let_in = F.coalesce(F.avg((F.col("b.perplexity") <= F.col("c.t")).cast("double")), F.lit(0.0))
    best = cuts.join(b, mine, "left").groupBy("c.overall", "c.lang", "c.n", "c.t", "c.q").agg(let_in.alias("x"))
    return best.groupBy("overall", "lang", "n").agg(F.max(F.struct(F.round(F.col("q") - F.col("x"), 9), "q", "t"))["t"].alias("threshold"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, th (text hash), n_symbols, perplexity, threshold, keep for every row of ``docs``.

    Trusted text is that of documents labelled good and not toxic. A fifth of the documents labelled good, toxic or
    not, sets the thresholds and trains nothing. A document stays if its perplexity is at most its language's threshold. A null language is a language of its own;
    one with few held-out documents goes by those of all; with none at all the threshold is null and everything stays.
    Null and empty texts have no perplexity and do not stay. Repeated rows count each and are judged alike; texts are
    scored whole; extra columns are ignored.
    """
    ids = [stage(x, "ids") for x in (trusted_ids(labels), judged_ids(labels, 1), judged_ids(labels, 0))]
    known, good, bad = (F.broadcast(x) if x.count() <= BROADCAST_IDS else x for x in ids)
    fold = lambda th: F.pmod(th, F.lit(FOLDS))
    trusted = pick(docs, doc_id="long", text="string").join(known, "doc_id", "left_semi").where(fold(F.xxhash64("text")) > 0)
    scored = stage(perplexities(docs, stage(gram_counts(trusted), "gram-counts"), char_counts(trusted)), "perplexities")
    t = stage(thresholds(scored.join(good, "doc_id", "left_semi").where(fold(F.col("th")) == 0), scored.join(bad, "doc_id", "left_semi")), "thresholds")
    overall = t.where("overall").agg(F.max("threshold").alias("all_langs"))
    own = t.where(~F.col("overall") & (F.col("n") >= LEAST_TRUSTED)).select("lang", F.col("threshold").alias("own"))
    s, t = scored.alias("s"), own.alias("t")
    return (
        s.join(t, F.col("s.lang").eqNullSafe(F.col("t.lang")), "left")
        .crossJoin(F.broadcast(overall))  # one row
        .select("s.doc_id", "s.lang", "s.th", "n_symbols", "perplexity", F.coalesce("own", "all_langs").alias("threshold"))
        .withColumn("keep", (F.col("n_symbols") > 0) & (F.col("threshold").isNull() | (F.col("perplexity") <= F.col("threshold"))))
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps."""
    bad = classify(docs, labels).where(~F.col("keep")).select("doc_id", "th").distinct()
    mine = wrapped(docs).withColumn("hash", F.xxhash64("text")).alias("m")
    return mine.join(bad.alias("b"), F.col("m.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("m.hash") == F.col("b.th")), "left_anti").select("row.*")
