"""Collocations, shards and the filter audit against plain versions on small tables, odd rows and hot groups."""

import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from sparkvane.llm import collocations, filter_audit, shards


def plain_phrases(rows):
    """What collocations() must return, from (lang, text) rows."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = tuple(re.findall("[^ \t]+", piece))
            n[lang or "und"] += len(w)
            f.update((lang or "und", w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    cands = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= 30}
    inside = {}
    for (lang, p), a in cands.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                inside[lang, p[i : i + k]] = max(a, inside.get((lang, p[i : i + k]), 0))
    out = {}
    for (lang, p), a in cands.items():
        if 100 * inside.get((lang, p), 0) >= 80 * a:
            continue
        score, k = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, r + 1, p.decode(), -a, left, right, n[lang], -s) for lang, all_ in out.items() for r, (s, a, p, left, right) in enumerate(sorted(all_)[:2000]))


def test_collocations(spark, docs, odd_rows, monkeypatch):
    rnd = random.Random(1)
    vocab = ["Alpha", "beta", "gamma", "δέλτα", "epsilon", "zeta x", "o'clock", "<b>", "\x00", "ß", "É", "e"]
    texts = ["".join(rnd.choice(vocab) + rnd.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]) for _ in range(rnd.randint(0, 300))) for _ in range(60)]
    texts += ["the quick brown fox jumps" for _ in range(400)] + ["the quick brown"] * 95
    rows = [(k, t) for k, t in enumerate(texts)]
    made = docs(rows, lang=None).unionByName(docs(rows[:40], lang="en")).unionByName(docs(odd_rows, lang="en")).unionByName(docs([(1, "und " * 200)], lang="und"))
    want = plain_phrases([(None, t) for _, t in rows] + [("en", t) for _, t in rows[:40] + odd_rows] + [("und", "und " * 200)])
    assert len(want) > 100
    assert sorted(map(tuple, collocations.collocations(made).collect())) == want
    # Small slices and cells that hold several words change nothing; the fewest bits admit all.
    monkeypatch.setattr(collocations, "SLICE", 5000)
    assert sorted(map(tuple, collocations.collocations(made).collect())) == want
    assert [r["rank"] for r in collocations.collocations(made, first=2).where("lang = 'en'").orderBy("rank").collect()] == [1, 2]
    assert collocations.collocations(docs([])).count() == 0
    assert collocations.collocations(docs([(1, None), (2, "")])).count() == 0


def test_crowded_cells_lose_nothing():
    rnd = random.Random(2)
    texts = pa.array([" ".join(rnd.choice("abcdefgh") * rnd.randint(1, 2) for _ in range(3000))], pa.string())
    w = collocations.Words(texts, pa.array([None], pa.string()))
    everything = np.full((1 << collocations.FILTER_BITS) // 8, 255, np.uint8)
    levels = list(collocations.trie(w, everything))
    words = [x.decode() for x in w.words.to_pylist()]
    flat = texts[0].as_py().split(" ")
    for k, (_, path, counts) in enumerate(levels, 1):
        got = {tuple(words[p[i]] for p in path): int(c) for i, c in enumerate(counts)}
        assert got == Counter(tuple(flat[i : i + k]) for i in range(len(flat) - k + 1))
        assert list(got) == sorted(got)


def plain_shards(rows, n):
    """The capacity and the size of each shard, from (doc_id, text) rows."""
    groups = {}
    for i, t in rows:
        g = groups.setdefault(t or "", [[], 0])
        g[0].append(i)
        g[1] += len((t or "").encode()) + 8
    order = sorted(groups, key=lambda t: ((0, 0) if all(i is None for i in groups[t][0]) else (1, min(i for i in groups[t][0] if i is not None))))
    sizes = [groups[t][1] for t in order]

    def fits(c):
        used, have = 1, 0
        for s in sizes:
            if s > c:
                return False
            used, have = (used, have + s) if have + s <= c else (used + 1, s)
        return used <= n

    return min(c for c in range(max(sizes), sum(sizes) + 1) if fits(c)), order


@pytest.mark.parametrize(("n", "cells", "hot"), [(24, 1 << 16, 0), (24, 32, 0), (5, 64, 0), (3, 32, 200), (24, 32, 200), (7, 2048, 1)])
def test_shards(spark, docs, n, cells, hot):
    rnd = random.Random(n + cells)
    rows = [(k * 3, f"{k}" + "x" * rnd.choice([rnd.randint(0, 40), rnd.randint(0, 900)]) + rnd.choice("äb") * 3) for k in range(300)]
    rows += [(rnd.randint(0, 299) * 3 + 1, "a copy of one text " * 5) for _ in range(hot)] + [(None, None), (None, ""), (11, ""), (11, ""), (901, "last")]
    rnd.shuffle(rows)
    want, order = plain_shards(rows, n)
    got = shards.assign(docs(rows), n, ("text",), cells).collect()
    assert sorted((str(r.doc_id), r.text or "") for r in got) == sorted((str(i), t or "") for i, t in rows)
    sizes, by_text = Counter(), {}
    for r in got:
        assert r["size"] == len((r.text or "").encode()) + 8 and 0 <= r.shard < n
        sizes[r.shard] += r["size"]
        by_text.setdefault(r.text or "", set()).add(r.shard)
    assert max(sizes.values()) <= want
    assert all(len(s) == 1 for s in by_text.values())  # equal texts stay together
    along = [min(by_text[t]) for t in order]
    assert along == sorted(along)  # shards are contiguous stretches
    for s in sizes:
        own = sorted((r for r in got if r.shard == s), key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        ids = [-1 if r.doc_id is None else r.doc_id for r in own]
        assert ids == sorted(ids)
    if not hot:
        assert max(sizes.values()) - min(sizes.values()) <= 2 * 1000


def test_shards_of_few_rows(spark, docs, odd_rows, tmp_path):
    assert shards.assign(docs([])).count() == 0
    one = shards.assign(docs([(1, "a")])).collect()
    assert len(one) == 1 and one[0].slot == 0
    back = shards.write_shards(docs(odd_rows), str(tmp_path / "s"))
    assert sorted((str(r.doc_id), str(r.text)) for r in back.collect()) == sorted((str(i), str(t)) for i, t in odd_rows)
    assert zlib.crc32(b"") == 0  # what the query gives for null texts


def plain_audit(rows, labels):
    """What audit() must return, from (doc_id, text, part) rows and (doc_id, quality, toxic) labels."""
    smallest = {}
    for i, t, _ in rows:
        if i is not None:
            smallest[t or ""] = min(i, smallest.get(t or "", i))
    docs = []
    for i, t, part in rows:
        t = t or ""
        w = re.findall("[^ \t-\r]+", t)
        fail = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > smallest[t]}
        own = [x for x in labels if x[0] == i and i is not None]
        docs.append((part or "", {f for f in fail if fail[f]}, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out = {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        total = Counter()
        for order in map("".join, permutations("ABCDE")):
            gone = [False] * len(own)
            for k, f in enumerate(order):
                here = [not g and f in d[1] for g, d in zip(gone, own, strict=True)]
                redundant = sum(g and f in d[1] for g, d in zip(gone, own, strict=True))
                gone = [a or b for a, b in zip(gone, here, strict=True)]
                total[f] += sum(here)
                out[part, order, k + 1] = [gone.count(False), sum(here), redundant, sum(d[1] == {f} for d in own), sum(h and d[2] for h, d in zip(here, own, strict=True)), sum(h and d[3] for h, d in zip(here, own, strict=True)), f]
        for (p, _, _), v in out.items():
            if p == part:
                v[6] = total[v[6]]
    return sorted((*k, *v) for k, v in out.items())


def test_filter_audit(spark, docs, odd_rows):
    rnd = random.Random(4)
    long = [" ".join(rnd.choice(["word", "Other", "thing", "w%d" % rnd.randint(0, 300)]) for _ in range(rnd.randint(150, 260))) for _ in range(12)]
    long += [" ".join(f"w{k}" for k in range(250)) + m for m in ("", " #", " AAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAA")]
    rows = [(k, rnd.choice(long), rnd.choice(["en", "de", None])) for k in range(150)]
    rows += [(200 + k, "the very same text", "en") for k in range(300)] + [(450, "the very same text", "en")] * 3 + [(None, "the very same text", "")] * 4
    rows += [(i, t, "odd") for i, t in odd_rows]
    labels = [(k, k % 2, k % 3 == 0) for k in range(0, 400, 2)] + [(4, 1, 1), (4, 0, 0), (450, 1, None), (None, 1, 1), (7, None, 1)]
    made = None
    for part in {r[2] for r in rows}:
        own = docs([(i, t) for i, t, p in rows if p == part], lang=part)
        made = own if made is None else made.unionByName(own)
    said = spark.createDataFrame([(i, q, None if t is None else int(t), "x") for i, q, t in labels], "doc_id long, quality int, toxic int, part string")
    want = plain_audit(rows, labels)
    for parts in ("1", "4", "37"):  # runs of copies that cross no, some and many boundaries
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = filter_audit.audit(filter_audit.cells(filter_audit.masks(made), said)).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert sorted(map(tuple, got)) == want
    assert filter_audit.audit(filter_audit.cells(filter_audit.masks(docs([])), said)).count() == 0
    assert filter_audit.audit(filter_audit.cells(filter_audit.masks(docs([(1, None)], lang=None)), said.limit(0)), ["ABCDE"]).count() == 5
