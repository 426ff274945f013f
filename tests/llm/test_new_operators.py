"""Vectors and conversations against brute force: nulls, ties, repeated rows, large groups, empty tables, extra columns."""

import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from queuelens.llm import conversation_repair, near_vectors, vector_codes

VECTORS = "vec_id long, embedding array<double>, label int, node long, component string"


def with_tables(spark, folder, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


# vector codes


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """Every distance by Python's integers."""
    kept = [(i, label, [int(np.floor(256 * float(x))) for x in v]) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    size = -(-max(len(v) for _, _, v in kept) // parts)
    kept = [(i, label, v + [0] * (parts * size - len(v))) for i, label, v in kept]
    cut = lambda v, p: v[p * size : (p + 1) * size]
    books = [[cut(v, p) for _, _, v in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]] for p in range(parts)]

    def near(v, p):
        d = [sum((a - b) ** 2 for a, b in zip(cut(v, p), e, strict=True)) for e in books[p]]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        new = []
        for p in range(parts):
            mine = defaultdict(list)
            for _, _, v in kept:
                mine[near(v, p)[0]].append(cut(v, p))
            new.append([[sum(c) // len(c) for c in zip(*mine[e], strict=True)] if e in mine else old for e, old in enumerate(books[p])])
        books = new
    out = [(i, label, [near(v, p) for p in range(parts)]) for i, label, v in kept]
    total = defaultdict(int)
    for _, label, found in out:
        total[label] += sum(d for _, d in found)
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{e:02x}" for e, _ in found), sum(d for _, d in found), total[label], sha) for i, label, found in out), key=str)


def vector_rows(n, seed=1, width=32):
    rng = np.random.default_rng(seed)
    rows = [(i * 3, [float(np.float32(x)) for x in rng.normal(size=width)], None if i % 5 == 0 else i % 3) for i in range(n)]
    odd = [None, [None, *[1.0] * (width - 1)], [float("nan")] * width, [float("inf")] * width, [0.0] * width, [], [1.5], [-0.001953125] * width]
    return rows + [(1000 + i, v, 1) for i, v in enumerate(odd)] + rows[:3] + [(None, [0.25] * width, None)]


def test_vector_codes_against_every_distance(spark, tmp_path):
    rows = vector_rows(150)
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], VECTORS).repartition(5)
    got = vector_codes.query(spark, with_tables(spark, tmp_path, embeddings=df)).collect()
    assert sorted((tuple(r[:5]) for r in got), key=str) == plain_codes(rows)


def test_vector_codes_of_huge_components_ties_and_few_rows(spark):
    rows = [(i, [v] * 16, None) for i, v in enumerate((1e30, -1e30, 3e9, 3e9, 0.0))]
    ints = vector_codes.integer_vectors(spark.createDataFrame([(*r, 7, "x") for r in rows], VECTORS), 256, "vec_id", "embedding", "label")
    codes, books = vector_codes.compress(ints)
    found = {r.id: (r.codes, r.error) for r in codes.collect()}
    assert books.shape == (16, 5, 1) and found[2] == found[3] == ([2] * 16, 0)  # equal entries: the lower index
    assert [found[i] for i in (0, 1, 4)] == [([0] * 16, 0), ([1] * 16, 0), ([4] * 16, 0)]
    one = vector_codes.decoded(codes, books).where("id = 4").first()
    assert one.vector == pytest.approx([0.5 / 256] * 16)


def test_vector_codes_of_an_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], VECTORS)
    assert vector_codes.query(spark, with_tables(spark, tmp_path, embeddings=empty)).count() == 0


# near vectors


def plain_links(rows, threshold=0.95):
    ok = [i for i, (key, v) in enumerate(rows) if key is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    width = max(len(rows[i][1]) for i in ok)
    u = np.array([rows[i][1] + [0.0] * (width - len(rows[i][1])) for i in ok])
    u /= np.abs(u).max(axis=1, keepdims=True)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= threshold
    np.fill_diagonal(near, False)
    low = np.array([rows[i][0] for i in ok])
    while True:
        new = np.minimum(low, np.where(near, low[None, :], low.max() + 1).min(axis=1))
        if (new == low).all():
            break
        low = new
    out = [[key, 0, key] for key, _ in rows]
    for i, n, c in zip(ok, near.sum(axis=1).tolist(), low.tolist(), strict=True):
        out[i] = [rows[i][0], n, c]
    return sorted(map(tuple, out), key=str)


def clustered(rng, width, size, spread):
    base = rng.normal(size=width)
    base /= np.linalg.norm(base)
    return base + rng.normal(size=(size, width)) * spread / np.sqrt(width)


def near_rows(seed=5, width=24, n=1500):
    rng = np.random.default_rng(seed)
    parts = [rng.normal(size=(n, width)), *(clustered(rng, width, 2, 0.15) for _ in range(80)), clustered(rng, width, 900, 0.12), clustered(rng, width, 700, 0.3), clustered(rng, width, 30, 0.25)]
    v = np.concatenate(parts) * rng.choice([1e-3, 1.0, 1e5], size=(sum(map(len, parts)), 1))
    rows = [(int(i), x.tolist()) for i, x in zip(rng.permutation(len(v)), v, strict=True)]
    odd = [None, [], [0.0] * width, [None] * width, [float("nan")] + [1.0] * (width - 1), [float("-inf")] * width, [1e300] * width, [1e-300] * width]
    return rows + [(100_000 + i, x) for i, x in enumerate(odd)] + [(None, rows[0][1])] + rows[-3:]


def test_near_vectors_against_all_pairs(spark, tmp_path):
    rows = near_rows()
    df = spark.createDataFrame([(i, v, 1, 7, "x") for i, v in rows], VECTORS).repartition(6)
    got = near_vectors.query(spark, with_tables(spark, tmp_path, embeddings=df)).collect()
    want = plain_links(rows)
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == want
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)


def test_near_vectors_of_equal_vectors_and_of_an_empty_table(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0, 3.0], 1, 7, "x") for i in range(700)], VECTORS)
    got, recall = near_vectors.near_vectors(df)
    assert recall == 1 and {(r.n_links, r.component_id) for r in got.collect()} == {(699, 0)}
    for v in ([], [(None, None, 1, 7, "x"), (3, [0.0], 1, 7, "x")]):
        got, _ = near_vectors.near_vectors(spark.createDataFrame(v, VECTORS))
        assert sorted(tuple(r) for r in got.collect() if r.id) == [(3, 0, 3)] * (len(v) // 2)


def test_descent_links_what_no_table_met(spark):
    """Chains of vectors, each within reach of the next: with one table only, neighbours of neighbours join components."""
    rng = np.random.default_rng(3)
    rows = []
    for c in range(40):
        a, b = np.linalg.qr(rng.normal(size=(16, 2)))[0].T
        rows += [(c * 100 + k, (np.cos(k * 0.16) * a + np.sin(k * 0.16) * b).tolist()) for k in range(12)]
    got, recall = near_vectors.near_vectors(spark.createDataFrame([(i, v, 1, 7, "x") for i, v in rows], VECTORS).repartition(3))
    assert recall == 1 and sorted((tuple(r) for r in got.collect()), key=str) == plain_links(rows)


def test_tables_are_added_until_the_audit_is_content(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "BLOCK", 8)
    monkeypatch.setattr(near_vectors, "MISSED", 0.6)
    rng = np.random.default_rng(11)
    v = np.concatenate([clustered(rng, 12, 2, 0.2) for _ in range(300)])
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    got, recall = near_vectors.near_vectors(spark.createDataFrame([(*r, 1, 7, "x") for r in rows], VECTORS), recall=0.95)
    true = sum(n for _, n, _ in plain_links(rows))
    assert recall >= 0.95 and abs(sum(r.n_links for r in got.collect()) / true - recall) < 0.02


# conversations

SPACES = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        conv_s, turn_s, role, text = (" " if x is None else str(x) for x in (conv, turn, role, text))
        code = zlib.crc32(f"{conv_s}:{turn_s}".encode()) % 20
        text = "" if code == 1 else "".join(c for c in text if c not in ".!?") if code == 2 else text
        out += [(conv, turn, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    return out


def plain_repair(rows, insert=5):
    """Every sequence of edits that can be best, tried one after the other."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    seen, faults = set(), []
    for _, _, role, text in rows:
        bare = text.strip(SPACES)
        faults.append(1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0)
        seen.add((role, text))
    roles = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(roles))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    full = {"u": "user", "a": "assistant"}
    best = [(2 * len(rows), "D" * len(rows), [])]

    def go(i, last, cost, audit, said, inserts):
        if cost > best[0][0]:
            return
        if i == len(rows) and last in ("", "a"):
            best[0] = min(best[0], (cost, audit, said))
        if inserts < 2:
            for c in follows[last]:
                if c != "s":
                    go(i, c, cost + insert, audit + "I", [*said, f"{full[c]}:"], inserts + 1)
        if i == len(rows):
            return
        _, _, role, text = rows[i]
        more = 5 * (faults[i] == 3)
        if faults[i] in (0, 3):
            if roles[i] and roles[i] in follows[last]:
                go(i + 1, roles[i], cost + more, audit + "K", [*said, f"{role}:{text}"], 0)
            for c in follows[last]:
                if c != "s":
                    go(i + 1, c, cost + 1 + more, audit + "R", [*said, f"{full[c]}:{text}"], 0)
        go(i + 1, last, cost + 2, audit + "D", said, 0)

    go(0, "", 0, "", [], 0)
    cost, audit, said = best[0]
    return (gaps, *(faults.count(f) for f in (1, 2, 3)), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())


def conversation_rows(seed=2, n=400):
    rng = random.Random(seed)
    texts = ("Hello.", "a b", "", " \t", "Yes!", "Why?\n", "é \xa0", "fin.  ", "x\x00y.")
    rows = []
    for conv in [None, *range(n)]:
        k = rng.choice((1, 2, 4, 6, 7))
        for turn in range(k):
            role = rng.choice(("user", "assistant", "user", "assistant", "system", None, "", "tool", "User")) if rng.random() < 0.5 else ("user", "assistant")[turn % 2]
            rows.append((conv, None if rng.random() < 0.05 else turn * rng.choice((1, 1, 1, 3)), role, None if rng.random() < 0.03 else rng.choice(texts)))
            if rng.random() < 0.05:
                rows.append(rows[-1])
    return rows


def as_table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, pos int, audit string").repartition(5)


@pytest.mark.parametrize("block", [2, 4, 1 << 12])
def test_conversations_against_every_edit(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(conversation_repair, "BLOCK", block)
    rows = conversation_rows()
    got = {r.conv_id: tuple(r)[1:] for r in conversation_repair.query(spark, with_tables(spark, tmp_path, conversations=as_table(spark, rows))).collect()}
    after = defaultdict(list)
    for r in plain_damage(rows):
        after[r[0]].append(r)
    want = {c: plain_repair(after[c]) for c in {r[0] for r in rows}}
    assert got == want
    assert len({c for c, x in want.items() if x[6] == ""}) and any("R" in x[6] for x in want.values())


def test_layers_with_cheap_inserts(monkeypatch):
    """At a cost of 5 a delete is always cheaper than an insert; at a cost of 1 or 2 it isn't."""
    inserted = 0
    for cost in (1, 2, 3):
        monkeypatch.setattr(conversation_repair, "INSERT", cost)
        rng = random.Random(cost)
        for _ in range(300):
            rows = [(1, t, rng.choice(("user", "assistant", "system", "x")), rng.choice(("a.", "b.", "c!", "", "open"))) for t in range(rng.randrange(6))]
            layer, seen = conversation_repair.closed([(0, ""), None, None, None]), set()
            for _, _, role, text in rows:
                fault = 1 if not text else 2 if (role, text) in seen else 3 if text == "open" else 0
                layer = conversation_repair.stepped(layer, role[0], fault)
                seen.add((role, text))
            found = min(x for s, x in enumerate(layer) if x and s in conversation_repair.ENDS)
            assert found == plain_repair(rows, cost)[5:7]
            inserted += "I" in found[1]
    assert inserted > 50


def test_one_long_conversation_lies_over_many_pieces(spark, monkeypatch):
    monkeypatch.setattr(conversation_repair, "BLOCK", 64)
    rng = random.Random(4)
    rows = [(7, t, rng.choice(("user", "assistant")), f"{rng.random()}{rng.choice('.!? ')}") for t in range(3000)] + [(8, 0, "user", "q."), (8, 1, "assistant", "y" * 300_000 + ".")]
    mended, report = conversation_repair.repair(conversation_repair.in_order(as_table(spark, rows)))
    report = {r.conv_id: r for r in report.collect()}
    layer = conversation_repair.closed([(0, ""), None, None, None])
    for _, _, role, text in rows[:3000]:
        layer = conversation_repair.stepped(layer, role[0], 0 if text[-1] in ".!?" else 3)
    assert (report[7].cost, report[7].audit) == min(x for s, x in enumerate(layer) if x and s in conversation_repair.ENDS)
    said = mended.where("conv_id = 7").orderBy("pos", "nth").collect()
    assert "".join(r.edit for r in said) == report[7].audit.replace("D", "") and "".join(r.role[0] for r in said) == "ua" * (len(said) // 2)
    assert [(r.edit, len(r.text)) for r in mended.where("conv_id = 8").orderBy("pos", "nth").collect()] == [("K", 2), ("K", 300_001)]
    assert mended.where("conv_id = 7").select((F.col("pos") / 64).cast("int")).distinct().count() > 20


def test_conversations_of_an_empty_table(spark, tmp_path):
    assert conversation_repair.query(spark, with_tables(spark, tmp_path, conversations=as_table(spark, []))).count() == 0
