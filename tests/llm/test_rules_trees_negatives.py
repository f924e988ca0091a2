"""URL rules, Merkle manifests and hard negatives against brute force, with nulls, ties, long texts and clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebar.llm import blocks, hard_negatives, merkle, queries, url_filter

SF = "/root/testdata/sf0.001"


@pytest.fixture
def small_blocks(monkeypatch):
    """Few rows a block, so that groups and stacks reach over many of them."""
    real = blocks.in_blocks
    narrow = lambda df, *order, rows=0: real(df, *order, rows=5)
    monkeypatch.setattr(blocks, "in_blocks", narrow)
    monkeypatch.setattr(url_filter, "in_blocks", narrow)


# Places in an order


def test_numbered(spark, small_blocks):
    r = random.Random(3)
    rows = [("hot" if r.random() < 0.7 else r.choice("abc"), r.choice([None, *range(40)])) for _ in range(300)]
    got = blocks.numbered(spark.createDataFrame(rows, "g string, v int"), "g", "v").collect()
    for g in {x[0] for x in rows}:
        want = sorted((v for k, v in rows if k == g), key=lambda v: (v is not None, v or 0))
        mine = sorted((x for x in got if x.g == g), key=lambda x: x["at"])
        assert [x["at"] for x in mine] == list(range(len(want))) and [x.v for x in mine] == want and {x.total for x in mine} == {len(want)}


# URL rules


def plain_verdict(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    ends = [i for i, c in enumerate(rest) if c in "/?#"]
    host, after = (rest[:ends[0]], rest[ends[0]:]) if ends else (rest, "")
    path = after[:min([i for i, c in enumerate(after) if c in "?#"], default=len(after))]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h + p), len(h), h + p, a) for (h, p), a in rules.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else default


URLS = [
    None, "", "no scheme", "://", "http://", "HTTP://Example.ORG/es/1", "https://www.example.org/es/", "https://example.org/esx", "https://example.org/en/1",
    "https://a.b.example.org/en/19?x=/es/#y", "http://org", "http://org/", "http://notexample.org/es/", "http://example.com/de/a", "http://x.com/fr/?q=://z",
    "http://com/de/", "http://example.net/de/", "http://example.org?/es/", "http://example.org#/es/", "ftp://user@example.org/es/", "http://example.org:80/es/",
    "http://ÄÖ.example.org/es/ü", "http://.org/", "http://a..org/x\ny", "http://" + "a." * 500 + "org/" + "p/" * 3000, "http://example.org/\U0010ffff\U0010ffff",
]


@pytest.mark.parametrize("many", [False, True])
def test_url_filter(spark, small_blocks, many):
    r = random.Random(11)
    listed = [*queries.URL_RULES, ("example.org", "/es/", "allow"), ("EXAMPLE.org", "/es/1", "allow"), ("a.b.example.org", None, "allow"), (None, "/", "block"),
              ("", "/", "block"), ("b/c", "/", "block"), ("net", "/", "maybe"), ("com", "/de/a", "allow"), ("example.com", "/de/", "allow")]
    urls = URLS + URLS[5:9]
    if many:
        host = lambda: ".".join(r.choice("abc") for _ in range(r.randint(1, 3)))
        path = lambda: "/" + "".join(r.choice("xy/") for _ in range(r.randint(0, 5)))
        listed = [(host(), path(), r.choice(["allow", "block"])) for _ in range(150)]
        urls = ["http://" + host() + path() + r.choice(["", "?x", "#y"]) for _ in range(400)]
    rules = {}
    for h, p, a in listed:
        h = h.lower() if h else h
        if h and "/" not in h and a in ("allow", "block"):
            rules[h, p or ""] = max(a, rules.get((h, p or ""), ""))
    pages = spark.createDataFrame([(i, u, "mine", "x", "y") for i, u in enumerate(urls)], "page_id long, url string, rule string, row string, labels string").repartition(3)
    got = url_filter.judge(pages, spark.createDataFrame(listed, "host string, path string, action string")).collect()
    assert sorted(x.page_id for x in got) == list(range(len(urls)))
    for x in got:
        want = plain_verdict(urls[x.page_id], rules)
        # Of fitting rules with one length and one host length only one can fit.
        assert (x.host, x.path, x["rule"], x.verdict) == want and x["row"] == "x" and x.labels == "y"


def test_url_filter_without_rows_or_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, action string")
    assert url_filter.judge(pages.limit(0), rules).collect() == []
    (x,) = url_filter.judge(pages, rules.limit(0), default="block").collect()
    assert (x.host, x["rule"], x.verdict) == ("a.org", None, "block")


def test_url_filter_is_native(spark):
    plan = queries.op11_url_filter(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


# Merkle manifest


def sha(text):
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def plain_leaf(*fields):
    return sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def plain_tree(leaves, fanout):
    """Root, and (left, right) a level for each leaf."""
    paths, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for k, i in enumerate(at):
            run = level[i // fanout * fanout:][:fanout]
            paths[k].append(("".join(run[:i % fanout]), "".join(run[i % fanout + 1:])))
        level, at = [sha("".join(level[i:i + fanout])) for i in range(0, len(level), fanout)], [i // fanout for i in at]
    return level[0], paths


def plain_manifest(rows, fanout=3):
    """(doc_id, leaf, subroot, root, proof) of rows (doc_id, source, lang, n_chars, text), in the order of trees."""
    trees = {}
    for row in rows:
        trees.setdefault(row[1], []).append((row[0], plain_leaf(*row)))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for leaves in trees.values():
        leaves.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    low = {s: plain_tree([h for _, h in trees[s]], fanout) for s in names}
    root, high = plain_tree([low[s][0] for s in names], fanout)
    return [(i, h, low[s][0], root, p + high[k]) for k, s in enumerate(names) for (i, h), p in zip(trees[s], low[s][1])]


def made(r, n):
    text = [None, "", "a\nb\n", "\n", "é日🙂", "x" * 70_000]
    return [(r.choice([None, i, i, i, i // 2]), "hot" if r.random() < 0.5 else r.choice([None, "", "=", "a", "b", "é", "Z"]), r.choice([None, "en"]),
             r.choice([None, -5, 0, 12]), r.choice(text)) for i in range(n)]


@pytest.mark.parametrize("n,fanout", [(1, 3), (2, 3), (3, 3), (4, 3), (260, 3), (90, 2), (70, 7), (40, 50)])
def test_merkle(spark, small_blocks, n, fanout):
    rows = made(random.Random(n), n)
    rows += rows[:n // 9]  # repeated rows
    docs = spark.createDataFrame([(*x, "r", "p") for x in rows], "doc_id long, source string, lang string, n_chars long, text string, row string, proof string").repartition(3)
    found = merkle.manifest(docs, merkle.leaf(*map(F.col, queries.FIELDS)), fanout=fanout)
    assert found.columns == ["doc_id", "source", "lang", "n_chars", "row", "leaf", "subroot", "root", "proof"]
    got = found.withColumns({"again": merkle.fold(F.col("leaf"), F.col("proof")), "d": merkle.proof_digest(F.col("proof"))}).collect()
    shape = lambda x: (str(x[0]), x[1], x[2], x[3], x[4])
    mine = [(x.doc_id, x.leaf, x.subroot, x.root, [(p.left, p.right) for p in x.proof]) for x in got]
    assert sorted(map(shape, mine)) == sorted(map(shape, plain_manifest(rows, fanout)))
    assert all(x.again == x.root and x.d == sha("".join(a + b for a, b in ((p.left, p.right) for p in x.proof))) and x["row"] == "r" for x in got)


def test_merkle_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    assert merkle.manifest(docs, merkle.leaf(*map(F.col, queries.FIELDS))).collect() == []


def test_merkle_query_finds_tampering(spark, tmp_path):
    rows = [x for x in made(random.Random(5), 120)]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_merkle_manifest(spark, str(tmp_path)).collect()
    held = {}
    for x in rows:
        gone = x[0] is not None and zlib.crc32(str(x[0]).encode()) % 2 == 0 and x[4] is not None
        held.setdefault((x[0], plain_leaf(*x)), plain_leaf(*x[:4], x[4].replace("\n", "") if gone else x[4]))
    want = []
    for i, h, sub, root, proof in plain_manifest(rows):
        folded = held[i, h]
        for left, right in proof:
            folded = sha(left + folded + right)
        want.append((str(i), h, sub, root, sha("".join(a + b for a, b in proof)), folded, folded == root))
    assert sorted((str(x[0]), *x[1:]) for x in got) == sorted(want)
    assert {x.verified for x in got} == {True, False}


# Hard negatives


@pytest.mark.parametrize("size", [0, 1, 150, 40_000, 1 << 27, 1 << 40])
@pytest.mark.parametrize("d", [0, 1, 3, 64])
def test_packed_scores(size, d):
    r = random.Random(size + d)
    size = min(size, math.isqrt((1 << 62) // max(d, 1)))  # scores have to fit
    a, c = ([[r.randint(-size, size) for _ in range(d)] for _ in range(n)] for n in (5, 23))
    got = hard_negatives.packed_scores(np.array(a, np.int64).reshape(5, d), np.array(c, np.int64).reshape(23, d))
    assert got.tolist() == [[sum(x * y for x, y in zip(p, q)) for q in c] for p in a]


def plain_negatives(rows):
    """Rows (id, vector, label) to (anchor, positive, rank, negative, scores)."""
    fit = [(k, i, [math.floor(256 * float(np.float32(x))) for x in v], label) for k, (i, v, label) in enumerate(rows)
           if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    order = lambda x: (-x[0], x[1] is None, x[1] or 0, x[2])
    out = []
    for k, i, q, label in fit:
        if i is None or i % 100:
            continue
        others = [(score(q, p), j, m, lab) for m, j, p, lab in fit if m != k and len(p) == len(q)]
        for ps, j, *_ in sorted((x for x in others if x[3] == label), key=order)[:5]:
            found = sorted((x for x in others if x[3] != label and 80 * ps <= 100 * x[0] <= 100 * ps), key=order)[:5]
            out += [(i, j, n, x[1], ps, x[0]) for n, x in enumerate(found, 1)]
    return out


@pytest.mark.parametrize("scale,d", [(0.3, 8), (0.02, 3), (5e4, 8), (3e6, 5)])
def test_hard_negatives(spark, monkeypatch, scale, d):
    monkeypatch.setattr(hard_negatives, "ANCHORS", 7)
    monkeypatch.setattr(hard_negatives, "CANDIDATES", 16)
    monkeypatch.setattr(hard_negatives, "AT_ONCE", 3)
    r = random.Random(d)
    vector = lambda: [r.gauss(0.5 * scale, scale) for _ in range(d)]
    shared, rows = vector(), []
    for i in range(400):
        v = shared if r.random() < 0.2 else vector()  # many ties
        rows.append((r.choice([i * 25, i]), v, 1 if r.random() < 0.5 else r.choice([0, 2, None])))
    rows += [(None, vector(), 1), (100, None, 1), (200, [None] * d, 1), (300, [float("nan")] * d, 0), (400, [float("inf")] * d, 0), (500, [], 1), (600, [], 1), (700, [], 2),
             (800, [1.0], 1), *rows[:3]]
    table = spark.createDataFrame([(*x, "s", "b") for x in rows], "vec_id long, embedding array<float>, label int, score string, block string").repartition(3)
    got = hard_negatives.mine(table, F.col("vec_id") % 100 == 0).collect()
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(map(tuple, got), key=key) == sorted(plain_negatives(rows), key=key) and got


def test_hard_negatives_of_nothing(spark):
    table = spark.createDataFrame([(1, [0.5], 1), (2, [0.5], 2)], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.mine(table, F.col("vec_id") % 100 == 0).collect() == []
    assert hard_negatives.mine(table.limit(0), F.col("vec_id") % 100 == 0).collect() == []
    with pytest.raises(Exception, match="too large"):
        hard_negatives.mine(spark.createDataFrame([(100, [1e30], 1)], table.schema), F.col("vec_id") % 100 == 0).collect()
