"""Collocations, whitening and toxicity against brute force and held-out labels, and on empty and awkward tables."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from cohortlens.llm import collocations, textgrid, toxicity, whitening

SF = "/root/testdata/sf0.001"


def brute_collocations(rows, top, least):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", "".join(x.lower() if "A" <= x <= "Z" else x for x in text or "")):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i:i + m])) for m in range(1, 6) for i in range(len(w) - m + 1))
    found = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= least}
    inside = {(lang, p[i:i + m]) for (lang, p), v in found.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if v >= found[lang, p[i:i + m]]}
    out = defaultdict(list)
    for (lang, p), a in found.items():
        if (lang, p) not in inside:
            score, _, l, r = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            out[lang].append((-score, -a, " ".join(p).encode(), l, r))
    return sorted((lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1))


def random_texts(seed):
    rng = np.random.default_rng(seed)
    parts = ["a", "b", "Ä b", "c d e f g h", "x", "x x", "b\tc", "q  r", "ä", "r s. t", "日本 語"]
    rows = []
    for i in range(120):
        text = "".join(str(rng.choice(parts)) + str(rng.choice([" ", " ", " ", "\t", ". ", "\n", "\x0b", "!", ""])) for _ in range(int(rng.integers(0, 40))))
        rows.append((["en", "de", None, "und", "fr"][min(int(rng.integers(0, 9)), 4)], text))
    return rows + [("en", None), (None, ""), ("xx", "only. single. words."), ("en", " ".join(["lang"] * 3000))]


@pytest.mark.parametrize(("top", "least", "width", "chunk"), [(2000, 5, 1 << 17, 1 << 16), (3, 12, 12, 7)])
def test_collocations_equal_brute_force(make, monkeypatch, top, least, width, chunk):
    monkeypatch.setattr(collocations, "CHUNK", chunk)
    rows = random_texts(top)
    got = collocations.collocations(make("lang string, text string", rows), top, least, width)
    assert sorted(tuple(r) for r in got.collect()) == brute_collocations(rows, top, least)


def test_collocations_of_awkward_tables(make, docs):
    assert collocations.collocations(make("lang string, text string", [])).collect() == []
    rows = [(r["lang"], r["text"]) for r in docs.collect()]
    got = collocations.collocations(docs, 50, 2, 1 << 17)
    assert sorted(tuple(r) for r in got.collect()) == brute_collocations(rows, 50, 2)


def reference_whitening(v, k=8):
    x = np.floor(v.astype(np.float64) * 1024).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    c = x - s / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return n, [sum(int(t) ** 2 for t in row) for row in (n * x - s).tolist()], c @ u / np.sqrt(e), e / (np.square(c).sum() / n)


def test_whitening_equals_a_dense_decomposition(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = {(r["vec_id"], r["component"]): r for r in whitening.whiten(table).collect()}
    data = table.orderBy("vec_id").toPandas()
    n, deviation, w, explained = reference_whitening(np.stack(data["embedding"].to_list()))
    assert len(rows) == 8 * n
    for j in range(8):
        got = np.array([rows[i, j + 1]["whitened"] for i in data["vec_id"]])
        assert min(np.abs(got - w[:, j]).max(), np.abs(got + w[:, j]).max()) < 1e-9
        assert abs(rows[data["vec_id"][0], j + 1]["explained"] / explained[j] - 1) < 1e-10
    assert [rows[i, 1]["deviation"] for i in data["vec_id"]] == deviation
    assert {r["n"] for r in rows.values()} == {n} and len({r["identity_error"] for r in rows.values()}) == 1
    assert rows[data["vec_id"][0], 1]["identity_error"] < 1e-10


def test_whitening_of_awkward_tables(make):
    schema = "vec_id long, embedding array<float>, x int, n string"
    assert whitening.whiten(make(schema, [])).collect() == []
    rows = [(1, [1.0, 2.0], 0, "a"), (1, [1.0, 2.0], 0, "a"), (None, [3.0, -1.0], 0, None), (4, None, 1, "b"), (5, [], 1, "b"), (6, [None, 1.0], 1, "b"),
            (7, [float("nan"), 1.0], 1, "b"), (8, [float("inf"), 1.0], 1, "b"), (9, [1.0, 2.0, 3.0], 1, "b"), (10, [0.5, 0.25], 2, "c")]
    got = whitening.whiten(make(schema, rows)).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in got) == [(0, 1), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2), (10, 1), (10, 2)]
    assert {r["n"] for r in got} == {4} and max(r["identity_error"] for r in got) < 1e-9
    same = whitening.whiten(make(schema, [(i, [1.0, 2.0, 3.0], 0, "") for i in range(3)])).collect()
    assert len(same) == 9 and all(r["whitened"] is None and r["deviation"] == 0 and r["identity_error"] == 0 for r in same)
    one = whitening.whiten(make(schema, [(i, [float(i), 1.0, 2.0], 0, "") for i in range(3)])).collect()
    assert {r["component"] for r in one if r["whitened"] is not None} == {1}


def test_deviation_is_exact_beyond_64_bits():
    x = np.array([[2 ** 40, 5]])
    assert whitening._deviation(x, 10 ** 4, np.array([7, 3])) == [(10 ** 4 * 2 ** 40 - 7) ** 2 + (10 ** 4 * 5 - 3) ** 2]


@pytest.mark.parametrize(("d", "space"), [(3, 96), (40, 96), (150, 32), (300, 40)])
def test_jacobi_davidson_restarts_and_locks(d, space):
    rng = np.random.default_rng(d)
    b = rng.standard_normal((d, d)) * np.linspace(1, 3, d)
    a = b.T @ b
    e, u = whitening.jacobi_davidson(lambda q: a @ q, d, space=space)
    want = np.linalg.eigvalsh(a)[::-1][:8]
    assert np.allclose(e[:8], want, rtol=1e-12) and np.linalg.norm(a @ u - u * e, axis=0).max() < 1e-12 * want[0]


def test_equal_eigenvalues_are_all_found():
    a = np.diag(np.r_[np.full(11, 5.0), np.ones(120)])
    e, u = whitening.jacobi_davidson(lambda q: a @ q, 131, space=32)
    assert np.allclose(e[:8], 5) and np.allclose(u.T @ u, np.eye(u.shape[1]), atol=1e-12)


def test_toxicity_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = toxicity.toxicity(spark.read.parquet(f"{folder}/documents.parquet").where("lang = 'en'"), labels)
    rows = got.where("held_out").join(labels.select("doc_id", "toxic"), "doc_id").collect()
    hit = [r["predicted"] for r in rows if r["toxic"] == 1]
    clean = [r["predicted"] for r in rows if r["toxic"] == 0]
    assert len(hit) > 30 and np.mean(hit) > 0.85 and np.mean(clean) < 0.02
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)


def test_toxicity_of_awkward_tables(make, docs):
    labels = make("doc_id long, quality int, toxic int, text int", [(1, 1, 1, 0), (2, 1, 0, 0), (3, 1, None, 0), (6, 0, 0, 0), (8, 0, 1, 0), (8, 0, 0, 0), (None, 1, 1, 0), (9, 1, 7, 0)])
    got = toxicity.toxicity(docs, labels).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r["doc_id"]) for r in docs.collect())
    assert all(0 <= r["score"] <= 1 for r in got) and [r["held_out"] for r in got if r["doc_id"] is None] == [False]
    assert all(r["score"] == 0 for r in toxicity.toxicity(docs, labels.where("toxic = 0")).collect())
    assert toxicity.toxicity(docs.limit(0), labels).collect() == []


def test_windows_hold_every_word_once():
    texts = ["", "a", "  b c " * 40, "x" * 500 + " y", None, "Ä\nö " * 30]
    for block in textgrid.blocks(pa.array(texts)):
        doc, start, end = toxicity.windows(block)
        data, parts = toxicity._laid(block, start, end)
        words = [[] for _ in texts]
        for d, (o, n) in zip(doc.tolist(), parts.astype(int).tolist()):
            words[d] += data[o:o + n].split()
        assert words == [(t or "").lower().encode().split() for t in texts] or words == [[w.replace(b"\xc3\xa4", "Ä".encode()) for w in (t or "").lower().encode().split()] for t in texts]


def test_copied_passages_are_no_wording():
    rng = np.random.default_rng(0)
    word = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(400)]
    passage = " ".join(f"zzz{i}qqq" for i in range(10))
    texts, toxic = [], []
    for i in range(300):
        t = [str(w) for w in rng.choice(word, 60)]
        if i % 3 == 0:
            t[5], t[33] = "nastyword", "nastyword"
            t.append(passage)
        texts.append(" ".join(t))
        toxic.append(int(i % 3 == 0))
    found = b"".join(toxicity.wording(texts, np.array(toxic)))
    assert b"nasty" in found and b"qqq" not in found
