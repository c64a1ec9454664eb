"""Exact dedup, Merkle manifest and periodic runs against plain versions."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from factweave.llm import exact_dedup, merkle, period_runs

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, t string, sha string, h string, row long, g long, i long, n long, d string, grp string, key string, leaf string, probe string, runs string, `a b` string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def frame(spark, rows):
    """Rows (doc_id, text, lang, source) with clashing extra columns."""
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), *["q"] * 4, 1, 2, 3, 4, *["q"] * 7) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(2)
    long_text = " ".join(rng.choice("alpha beta gamma delta".split()) for _ in range(30_000))
    rows = [(1, None, None, None), (2, "", "en", "a"), (None, "Same Text", "en", None), (None, "same text", None, "b"), (3, "  \n\n ", "de", "b"), (4, long_text, "en", "a"),
            (5, "ÄÖ É Words", "de", "a"), (6, "äö é words", "de", "a"), (7, "SAME TEXT", "en", "b"), (8, "x", "é", "b"), (9, "y", "z", None), (-3, "z", "", "b")]
    return rows + [(10, "a b a b a b a b a b", "en", "a")] * 3


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.mark.parametrize(("keep", "bits"), [("smallest", 0), ("largest", 1), ("smallest", 32)])
def test_exact_dedup(spark, odd_rows, keep, bits):
    """With hashes of 128 bits, of 4 and of none, so that different texts share one: the same groups."""
    rng = random.Random(4)
    rows = odd_rows + [(100 + k, rng.choice("ab") * rng.randint(1, 3), "en", "a") for k in range(40)]
    got = exact_dedup.mark(frame(spark, rows), keep=keep, content_hash=lambda s: F.substring(s, 1, bits)).collect()
    assert sorted((str(r.doc_id), r.text_sha256) for r in got) == sorted((str(r[0]), sha(lower(r[1]))) for r in rows)
    groups = {}
    for r in rows:
        groups.setdefault(sha(lower(r[1])), []).append(r[0])
    for r in got:
        ids = groups[r.text_sha256]
        known = [x for x in ids if x is not None]
        assert r.group_size == len(ids)
        assert r.keep_id == ((min if keep == "smallest" else max)(known) if known else None)
        assert not r.kept or r.doc_id == r.keep_id
    assert sum(r.kept for r in got) == len(groups)
    assert exact_dedup.mark(frame(spark, rows).limit(0)).count() == 0


def plain_manifest(rows):
    """Leaves, trees, proofs and folds with lists."""
    said = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, more=0: sha("".join(map(said, (r[0], r[3], r[2], None if r[1] is None else len(r[1]) + more, r[1]))))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][k:k + 2])) for k in range(0, len(levels[-1]), 2)])
        return levels

    def path(levels, k):
        out = []
        for nodes in levels[:-1]:
            other = k ^ 1
            out.append(None if other >= len(nodes) else (other < k, nodes[other]))
            k >>= 1
        return out

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    inside = [sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in langs]
    trees = [tree([leaf(r) for r in own]) for own in inside]
    outer = tree([t[-1][0] for t in trees])
    out = []
    for at, (own, inner) in enumerate(zip(inside, trees, strict=True)):
        for k, r in enumerate(own):
            steps = path(inner, k) + path(outer, at)
            node = leaf(r, 1) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else leaf(r)
            for step in steps:
                node = sha(node) if step is None else sha(step[1] + node) if step[0] else sha(node + step[1])
            out.append((str(r[0]), leaf(r), inner[-1][0], outer[-1][0], sha("".join(x[1] for x in steps if x)), node, str(node == outer[-1][0])))
    return sorted(out)


@pytest.mark.parametrize("levels", [2, 9])
def test_merkle(spark, odd_rows, levels):
    """Superblocks of 4 and 512 leaves, so that trees take several stages or one."""
    rng = random.Random(6)
    rows = odd_rows + [(100 + k, "t" * rng.randint(0, 4), rng.choice(["en", "fr", None]), rng.choice(["a", None])) for k in range(60)]
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    got = merkle.manifest(frame(spark, rows), probed={"n_chars": changed}, levels=levels)
    assert sorted(tuple(map(str, r)) for r in got.collect()) == plain_manifest(rows)
    if levels == 2:
        assert merkle.manifest(frame(spark, rows).where("false")).count() == 0
        alone = merkle.manifest(frame(spark, rows[:1])).first()
        assert (alone.leaf, alone.proof_sha256, alone.verified) == (alone.root, sha(""), True)


def plain_runs(words):
    """All stretches with a period, by every period."""
    out = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i > start and i + q - start >= max(6, 4 * q):
                out.setdefault((start, i + q - start), q)
            i += i == start
    return sorted((s, n, q) for (s, n), q in out.items())


def test_runs_brute():
    rng = random.Random(3)
    found = 0
    for _ in range(150):
        docs = []
        for _ in range(rng.randint(1, 8)):
            words = [b"%d" % rng.randrange(rng.choice((1, 2, 3, 20))) for _ in range(rng.choice((0, 1, 5, 6, 7, 30, 80, 200)))]
            if rng.random() < 0.6:
                unit = [b"%d" % rng.randrange(3) for _ in range(rng.randint(1, 9))] * rng.randint(3, 9)
                at = rng.randint(0, len(words))
                words[at:at] = unit * rng.choice((1, 1, 4))
            docs.append(words)
        for words, runs in zip(docs, period_runs.runs_of(docs), strict=True):
            assert [tuple(r) for r in runs.tolist()] == plain_runs(words)
            found += len(runs)
    assert found > 300


def test_grammar_extensions():
    """Common extensions to the right and to the left, at all pairs of places."""
    rng = random.Random(9)
    for k in (1, 2, 4):
        inner = [rng.randrange(k) for _ in range(40)] + [0] * 12 + [0, 1, 2] * 6
        words = period_runs.np.array([90, *inner, 91])
        grammar = period_runs.Grammar(words)
        mirror = grammar.mirrored()
        pairs = [(a, b) for a in range(1, len(inner)) for b in range(a + 1, len(inner) + 1)]
        one, other = (period_runs.np.array(x) for x in zip(*pairs, strict=True))
        ahead, behind = grammar.common(one, other), mirror.common(len(words) - one, len(words) - other)
        for (a, b), right, left in zip(pairs, ahead, behind, strict=True):
            n = 0
            while words[a + n] == words[b + n]:
                n += 1
            m = 0
            while a - m - 1 >= 0 and words[a - m - 1] == words[b - m - 1]:
                m += 1
            assert (right, left) == (n, m)


def test_runs_query(spark, odd_rows, tmp_path):
    """The whole query, planted repetitions included, against lists."""
    rng = random.Random(7)
    rows = odd_rows + [(k, " ".join(rng.choice("ab ab abc".split(" ")) for _ in range(rng.randint(0, 60))) + rng.choice(["", "\x0b\n \tz z"]), "en", "a") for k in range(100, 260)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = period_runs.QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()
    want = []
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")
        h = zlib.crc32(str(r[0]).encode()) if r[0] is not None else 1
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = plain_runs(words)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None,) * 3
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        want.append((r[0], len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert period_runs.find_runs(frame(spark, rows).where("false")).count() == 0


def test_short_masks_miss_nothing():
    """Every pattern of places that may differ leaves one mask of the length whole."""
    from itertools import combinations
    from math import ceil

    from factweave.llm import decontaminate

    for n in range(1, decontaminate.WINDOW):
        allowed = n - ceil(0.8 * n - 1e-9)
        masks = decontaminate.short_masks(n)
        assert all(len(m) == n and "1" in m for m in masks)
        for changed in combinations(range(n), allowed):
            assert any(all(m[k] == "0" for k in changed) for m in masks)


def test_short_items_and_hot_seeds(spark):
    """Items of 3 to 12 tokens at the limit of what may differ and beyond it; an item of equal tokens in a document of equal tokens."""
    from math import ceil

    from factweave.llm import decontaminate

    rng = random.Random(12)
    items, docs, want = [], [], {}
    for n in range(3, 13):
        words = [f"w{n}x{k}" for k in range(n)]
        items.append((n, " ".join(words)))
        allowed = n - ceil(0.8 * n - 1e-9)
        for extra in (0, 1):
            for turn in range(6):
                changed = set(rng.sample(range(n), min(n, allowed + extra)))
                said = ["before", "it", *[("other" if k in changed else w) for k, w in enumerate(words)], "after"]
                docs.append((len(docs), " ".join(said)))
                want[len(docs) - 1] = not extra
    items.append((99, "zero " * 3000))
    docs += [(1000, "zero " * 4000), (1001, "zero " * 12), (1002, "zero " * 9 + "one zero zero " + "two " * 5)]
    want |= {1000: True, 1001: True, 1002: True}
    bench = spark.createDataFrame(items, "item_id int, text string")
    got = {r.doc_id: r.contaminated for r in decontaminate.flag_documents(spark.createDataFrame(docs, "doc_id int, text string"), bench).collect()}
    assert got == want
