"""Chosen-path join against brute force over all pairs of shingle sets."""

import random
import re

import pytest

from patchweave.llm import chosen_path as cp


def shingle_set(text):
    words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if inter and 5 * inter >= 4 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: (least[find(i)], links[i]) for i, (d, _) in enumerate(rows)}


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgé") for _ in range(r.randint(1, 6)))
    common = [word() for _ in range(40)]
    bases = [[word() for _ in range(r.randint(1, 150))] for _ in range(60)]
    rows = []
    for b in bases:
        for _ in range(r.choice([1, 1, 2, 5])):
            w = list(b)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = word()
            if r.random() < 0.3:
                w += common
            rows.append(" ".join(w) if r.random() < 0.8 else ". ".join(w).upper())
    hot = [word() for _ in range(120)]
    for _ in range(120):
        w = list(hot)
        for _ in range(r.randint(0, 2)):
            w[r.randrange(len(w))] = word()
        rows.append(" ".join(w))
    rows += [rows[3]] * 20 + ["", "...", "one", "one", "ONE!", None, "a b c d", "a b c d e"]
    r.shuffle(rows)
    return [(i * 7, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed,brute_size,block", [(1, 2048, 1024), (2, 30, 1024), (3, 2048, 40)])
def test_against_brute_force(spark, monkeypatch, seed, brute_size, block):
    monkeypatch.setattr(cp, "BRUTE", brute_size)
    monkeypatch.setattr(cp, "SHIFTS", 8)
    monkeypatch.setattr(cp, "BLOCK", block)
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("sid", cp.F.lit("clash")).repartition(4)
    got = {r.doc_id: (r.class_id, r.n_links) for r in cp.similar(docs).collect()}
    want = brute(rows)
    wrong = {k: (got.get(k), want[k]) for k in want if got.get(k) != want[k]}
    assert len(got) == len(rows)
    assert not wrong, (len(wrong), list(wrong.items())[:5])
    kept = {r.doc_id for r in cp.one_of_each(docs).select("doc_id").collect()}
    assert kept == {c for c, _ in want.values()}


def test_empty_table_and_null_ids(spark):
    assert cp.similar(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    t = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(None, t), (5, t + " x"), (5, t + " x"), (9, None), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in cp.similar(docs).collect()), key=str)
    assert got == sorted([(None, 5, 2), (5, 5, 2), (5, 5, 2), (9, 9, 0), (None, None, 0)], key=str)
