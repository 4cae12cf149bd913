"""The manifest against a tree built in memory, node by node."""

import hashlib
import random
import zlib

import pytest

from metrikon.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k : k + 16]) for k in range(0, len(out[-1]), 16)])
    return out


def path(tree, i):
    """(left, right) siblings from a leaf to the tree's root."""
    out = []
    for nodes in tree[:-1]:
        first = i // 16 * 16
        out.append((nodes[first:i], nodes[i + 1 : first + 16]))
        i //= 16
    return out


def brute(rows):
    order = lambda r: (r[0] is not None, r[0] or 0, leaf(r))
    names = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    groups = [sorted((r for r in rows if r[1] == s), key=order) for s in names]
    trees = [levels([leaf(r) for r in g]) for g in groups]
    top = levels([t[-1][0] for t in trees])
    out = []
    for k, (g, t) in enumerate(zip(groups, trees, strict=True)):
        for i, r in enumerate(g):
            steps = path(t, i) + path(top, k)
            d = t[0][i]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                d = leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            for a, b in steps:
                d = h(*a, d, *b)
            out.append((r[0], t[0][i], t[-1][0], top[-1][0], h(*(x for a, b in steps for x in a + b)), d, d == top[-1][0]))
    return out


def rows_of(n, sources, seed=3):
    r = random.Random(seed)
    words = ["Alpha", "beta", "ÉÄ", "ß", "x\ty", ""]
    return [(i * 7 % n - n // 3, r.choice(sources), r.choice(["en", None, ""]), r.choice([None, 3, -1]), r.choice([None, " ".join(r.choices(words, k=4))])) for i in range(n)]


CASES = {
    "empty": [],
    "one": [(5, "a", "en", 1, "Text")],
    "null": [(None, None, None, None, None)] * 2 + [(None, None, "en", 1, "B"), (None, "", "en", 1, "B")],
    "sixteen": rows_of(16, ["a"]),
    "seventeen": rows_of(17, ["a"]),
    "hot": rows_of(700, ["hot"] * 20 + ["b", None, "é", "z"]),
    "sources": rows_of(300, [f"s{i}" for i in range(280)]),
    "twice": rows_of(40, ["a", "b"]) * 2,
}


@pytest.mark.parametrize(("case", "depth"), [*((c, 1) for c in CASES), ("hot", 2), ("hot", merkle.DEPTH), ("sources", merkle.DEPTH)])
def test_against_a_tree_in_memory(spark, case, depth):
    rows = CASES[case]
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree string, i int, digest string")
    got = merkle.manifest(df, depth)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(rows), key=key)


def test_queue_delivers_in_label_order():
    digests = [h(str(i)).encode() for i in range(77)]
    nodes = merkle.forward(digests, merkle.height(77))
    assert [[x.decode() for x in level] for level in nodes] == levels([d.decode() for d in digests])
    places = [j for j, _ in merkle.backward(nodes, None)]
    assert places == list(range(76, -1, -1))


def test_tampering_is_found(spark):
    rows = rows_of(200, ["a", "b"])
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    hit = {r[0] for r in rows if r[4] and zlib.crc32(str(r[0]).encode()) % 5 == 0 and any("A" <= c <= "Z" for c in r[4])}
    assert hit and {r.doc_id for r in merkle.manifest(df).where("NOT verified").collect()} == hit
