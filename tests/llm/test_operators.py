"""The operators against brute force, held-out accuracy and exact round trips, and on empty and awkward tables."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from cohortlens.llm import boosting, crf, decontaminate, html_extract, langid, licenses, ngram_join, packing, preference, substring_dedup, textgrid
from cohortlens.llm.catalog import table

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(frame):
    return [tuple(r) for r in frame.collect()]


def test_words_are_those_of_the_pattern():
    texts = ["", "Éa  bé\n\tC", " x ", "ab", "日本 語"]
    block = next(textgrid.blocks(pa.array(texts)))
    w = textgrid.words(block)
    got = [[block.data[a:b].tobytes().decode() for a, b in zip(w.start[i:j], w.end[i:j])] for i, j in zip(w.first[:-1], w.first[1:])]
    assert got == [WORD.findall(t) for t in texts]
    assert len(set(w.hash.tolist())) == len({x for t in texts for x in WORD.findall(t)})


def test_blocks_keep_every_text():
    texts = ["a" * n for n in (0, 5, 2_000_000, 3, 0)] + [None]
    parts = [b.text(i).decode() for b in textgrid.blocks(pa.array(texts, pa.string())) for i in range(b.hi - b.lo)]
    assert parts == [t or "" for t in texts]


def shingles(text, k=5):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset([tuple(w)]) if 0 < len(w) < k else frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1))


def brute_components(texts, num=80, den=100):
    sets = {d: shingles(t) for d, t in texts.items()}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_ngram_join_is_exact_on_edited_copies(make):
    rng = np.random.default_rng(5)
    texts, n = {}, 0
    for size in (1, 3, 4, 5, 6, 7, 8, 9, 12, 15, 20, 30, 45, 70, 120):
        base = [f"b{size}_{i}" for i in range(size)]
        for edits in (0, 0, 0, 1, 1, 1, 2, 2, 3):
            words = list(base)
            for _ in range(edits):
                if not words:
                    break
                i = int(rng.integers(len(words)))
                words[i:i + 1] = [[f"e{n}"], [], [words[i], f"e{n}"]][int(rng.integers(3))]
            texts[n] = " ".join(words)
            n += 1
    texts |= {n: None, n + 1: "", n + 2: " \n"}
    got = ngram_join.ngram_join(make("doc_id long, text string", list(texts.items())))
    assert {r[0]: r[1:] for r in rows_of(got)} == brute_components(texts)


def test_ngram_join_on_documents(spark):
    docs = table(spark, SF, "documents")
    texts = dict(rows_of(docs.select("doc_id", "text")))
    assert {r[0]: r[1:] for r in rows_of(ngram_join.ngram_join(docs))} == brute_components(texts)


def test_segments_leave_room_for_every_probe():
    for b in range(20):
        top = ngram_join.BANDS[b + 1] - 1
        assert ngram_join.segments(b, 80, 100) > ngram_join.allowed(top + top * 100 // 80, 80, 100)


def test_sets_in_too_few_segments_are_compared_with_the_band(make, monkeypatch):
    """With one segment for all, no set has units enough beyond small sizes: the rest takes the exact way."""
    monkeypatch.setattr(ngram_join, "segments", lambda band, num, den: 1)
    base = [f"w{i}" for i in range(60)]
    texts = {1: " ".join(base), 2: " ".join([*base[:58], "x", "y"]), 3: " ".join([*base[:40], *[f"z{i}" for i in range(20)]])}
    got = ngram_join.ngram_join(make("doc_id long, text string", list(texts.items())))
    assert {r[0]: r[1:] for r in rows_of(got)} == brute_components(texts)


def test_near_copies_under_the_threshold_are_not_listed(make, monkeypatch):
    """Each text has four words of its own in a common base, some share theirs: few of all pairs are worth a comparison."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(200)]
    texts: dict[int, str] = {}
    for n in range(240):
        words = list(base)
        for i in rng.choice(200, 4, replace=False):
            words[i] = f"e{n}_{i}"
        texts[n] = " ".join(words)
    texts |= {300 + n: texts[n].replace("w7 ", "neu ") for n in range(5)}
    listed, link = [], ngram_join.link
    monkeypatch.setattr(ngram_join, "link", lambda pairs, *rest: listed.append(pairs.count()) or link(pairs, *rest))
    got = ngram_join.ngram_join(make("doc_id long, text string", list(texts.items())))
    assert {r[0]: r[1:] for r in rows_of(got)} == brute_components(texts)
    assert listed[1] < 8_000  # 24,248 without sketches


def test_sketches_differ_in_no_more_bits_than_the_sets():
    rng = np.random.default_rng(4)
    for n in (3, 140, 2000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        for cut in (0, n // 10, n // 2):
            b = np.unique(np.concatenate((a[cut:], rng.integers(0, 1 << 63, cut).astype(np.uint64))))
            bits = sum(int(x).bit_count() for x in (ngram_join.sketch(a) ^ ngram_join.sketch(b)).view(np.uint64))
            assert bits <= len(np.setxor1d(a, b)) and (cut == 0) == (bits == 0)


def test_language_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    out = langid.identify(docs, langid.train(docs.where(~langid.held_out()))).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    got = rows_of(out.select("lang", "lang_pred", "score"))
    assert sum(a == b for a, b, _ in got) / len(got) > 0.98
    assert all(0 <= s <= 1 for *_, s in got)
    assert all(r[1] == (zlib.crc32(str(r[0]).encode()) % 3 == 1) for r in rows_of(out.select("doc_id", "held_out")))


def test_a_small_capacity_drops_no_ngram(make):
    """With 1,000 codes in the tasks the rest is joined: the scores are those of the whole model."""
    rows = duckdb.sql(f"select doc_id, text, lang from '{SF}/documents.parquet' where length(text) < 3000 order by doc_id limit 120").fetchall()
    docs = make("doc_id long, text string, lang string", [*rows, (900, None, "en"), (901, "", "de"), (902, "123", "en"), (None, "ganz neue Wörter", None), (rows[0][0], *rows[0][1:])])
    got = [sorted(rows_of(langid.identify(docs, langid.train(docs, capacity=n))), key=str) for n in (1 << 20, 1_000)]
    assert [r[:3] for r in got[0]] == [r[:3] for r in got[1]] and len(got[0]) == len(rows) + 5
    assert np.allclose([[*r[3:]] for r in got[0]], [[*r[3:]] for r in got[1]], rtol=1e-3, atol=1e-4)


def test_kneser_ney_probabilities_sum_to_one():
    code, of = langid.grams(x := langid.lexicon(["abab aba bab abba ba"]))
    codes, n = langid._add(None, code, np.bincount(x.word, minlength=len(x.length))[of])
    model = langid.assemble({"xx": (codes, n)})
    context = np.uint64(int(codes[0]) >> 12 << 12)
    every = model.logs(context | np.arange(4096, dtype=np.uint64))[:, 0]
    assert abs(np.exp(every.astype(float)).sum() - 1) < 1e-3


def test_quality_classifier_held_out(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    got = rows_of(crf.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").select("predicted", "quality"))
    assert sum(a == b for a, b in got) / len(got) > 0.98


def test_forward_backward_is_brute_force():
    rng = np.random.default_rng(1)
    emit, pairs = rng.normal(size=(9, 2)), rng.normal(size=(2, 2))
    at, size = np.array([0, 4, 5]), np.array([4, 1, 4])
    got, _ = crf.forward_backward(emit, pairs, at, size)
    for a, n in zip(at, size, strict=True):
        weight = np.zeros((n, 2))
        for path in np.ndindex(*[2] * n):
            w = np.exp(sum(emit[a + i, y] for i, y in enumerate(path)) + sum(pairs[x, y] for x, y in zip(path, path[1:])))
            for i, y in enumerate(path):
                weight[i, y] += w
        assert np.allclose(got[a:a + n], weight / weight.sum(axis=1, keepdims=True))


def test_statistics_are_those_of_the_rules(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    out = {r["doc_id"]: r for r in boosting.quality_rules(docs, labels).collect()}
    for doc_id, text in rows_of(docs.select("doc_id", "text")):
        w = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        grams = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
        r = out[doc_id]
        assert tuple(r[1:6]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        assert not (r["base_failed"] and r["kept"])


def test_trees_are_monotonic_and_learn():
    rng = np.random.default_rng(2)
    x = rng.random((3000, 3))
    y = ((x[:, 0] < 0.5) ^ (rng.random(3000) < 0.1)).astype(float)
    forest = boosting.fit(x, y, np.array([-1, 0, 0]))
    assert ((forest.score(x) > 0.5) == y).mean() > 0.85
    grid = np.column_stack([np.linspace(0, 1, 200), np.full(200, 0.3), np.full(200, 0.7)])
    assert (np.diff(forest.score(grid)) <= 1e-12).all()


def check_packing(out, ids, length=2048):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for doc, start, n, crc, total, seq, offset in out:
        pieces[doc].append((start, n, crc, total))
        sequences[seq].append((offset, n))
    for doc, tokens in ids.items():
        at = 0
        for start, n, crc, total in sorted(pieces[doc]):
            assert (start, total) == (at, len(tokens)) and zlib.crc32(tokens[start:start + n].tobytes()) == crc
            at += n
        assert at == len(tokens)
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
    return {s: sum(n for _, n in p) for s, p in sequences.items()}


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    docs = table(spark, SF, "documents")
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: np.array([*t.encode(x, add_special_tokens=False).ids, 1], dtype="<u4") for d, x in rows_of(docs.select("doc_id", "text"))}
    sizes = check_packing(rows_of(packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))), ids)
    padding = sum(2048 - n for n in sizes.values() if n & (n - 1))
    assert padding <= 0.01 * sum(sizes.values())


def test_windows_hold_the_target_mixture():
    p = packing.plan([70_000, 20_000, 10_000], [0.5, 0.3, 0.2], 1000)
    served = np.array([p.served(w) for w in range(p.windows + 1)])
    assert (served[-1] == [70_000, 20_000, 10_000]).all() and (np.diff(served, axis=0) >= 0).all() and (np.diff(served.sum(axis=1)) <= 1000).all()
    assert abs(served[40] - 40 * np.array([500, 300, 200])).max() <= 1  # no drift: deficits are carried


def test_last_window_ends_in_powers_of_two():
    assert packing.places(5000, 2048, True) == [(0, 2048), (2048, 4096), (4096, 4608), (4608, 4864), (4864, 4992), (4992, 5000)]
    assert packing.places(0, 2048, True) == []


@pytest.mark.parametrize("body, text", [
    ("<nav><ul><li><a href='/a'>A</a></li></ul></nav><article><h1>Title &amp; more</h1><p><b>One\n two.<br>Three</p><p>Four.</article><footer>&copy; x</footer>", "Title & more\nOne two. Three\nFour."),
    ("<header><p>Site name</p></header><main><p>A long enough text of the main part, with ten words or more in it.</p><aside>side</aside>"
     "<div class='comments'><p>I like it, and I say so in a comment of many words here.</p></div></main>", "A long enough text of the main part, with ten words or more in it."),
    ("<script>var a='<p>no</p>'</script><div class=\"cookie-notice\">We use cookies</div><article><p>Yes.<!-- no --></p><form><p>Your mail</p></form><p>Cut <a href=\"x", "Yes.\nCut"),
    ("", ""), ("plain", ""), (None, "")])
def test_html(body, text):
    assert html_extract.main_text(body) == text


LONG = "A long enough text of the main part, with ten words or more in it."


@pytest.mark.parametrize("body", [
    "<article><svg/><p>{}</p></article>", "<article><svg><title>i</title><text>no</text><path/></svg><p>{}</p></article>", "<article><svg><path><p>{}</article>",
    "<body><form id='aspnetForm'><nav><a href='/'>x</a></nav><div id='content'><p>{}</p></div></form></body>", "<body><title>t</title><form><p>{}</p></form>",
    "<form>Your mail, please: <input></form><article><p>{}</p></article>", "<article><p>{}</p><form><label>Mail</label><p>Your mail</p></form></article>",
    "<div class='container with-sidebar'><article><p>{}</p></article></div>", "<article><div class='form-content'><p>{}</p></div></article>",
    "<div class='layout-sidebar-right'><article><p>{}</p></article><div class='sidebar'><article>A teaser that is long enough to count as a text.</article></div></div>",
    "<div hidden><main>Nothing that anybody sees, in ten words or more than that.</main></div><main><p>{}</p></main>",
    "<article><p>{}</p></article><section class='comments'><article>I like it, and I say so in a comment of many words.</article></section>"])
def test_wrappers_and_drawings_drop_nothing(body):
    assert html_extract.main_text(body.format(LONG)) == LONG


def test_fitted_weights_serve_pages_without_structure(spark, make):
    """What is learnt from pages that say where their article is holds for one that does not."""
    pages = table(spark, SF, "pages")
    weights = html_extract.fit(pages)
    assert np.isfinite(weights).all() and weights[5] < 0 < weights[3]
    got = [r["text"] for r in html_extract.extract(make("page_id long, url string, html string", [(
        1, "u", f"<div><ul><li><a href='/'>Home</a></li><li><a href='/b'>Next page</a></li></ul></div><div><p>{LONG}</p><p>{LONG}</p></div>")]), weights).collect()]
    assert got == [f"{LONG}\n{LONG}"]
    whole = {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()}
    assert whole == {r["page_id"]: html_extract.main_text(r["html"]) for r in pages.collect()}


def test_awkward_pages(make):
    deep = "<div>" * 20_000 + "</span>" * 20_000 + "<article>" + f"<p>{LONG}" * 2_000
    rows = [(1, "u", deep, "x", 1), (None, None, "<article>Text.", "x", 2), (3, "u", None, "x", 3), (3, "u", "", "x", 3), (3, "u", "", "x", 3), (4, "u", "<p", None, None)]
    out = html_extract.extract(make("page_id long, url string, html string, text string, n_chars int", rows)).collect()
    assert out[0].asDict().keys() == {"page_id", "url", "text", "n_chars"}
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in out) == [(0, 5), (1, 2_000 * len(LONG) + 1_999), (3, 0), (3, 0), (3, 0), (4, 0)]


def test_min_cut_is_optimal():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n = int(rng.integers(1, 9))
        scores = rng.normal(size=n).round(2).tolist()
        ties = [(i, j, round(float(rng.random()), 2)) for i in range(n) for j in range(i) if rng.random() < 0.5]

        def cost(label):
            return sum(max(s, 0) if not x else max(-s, 0) for s, x in zip(scores, label, strict=True)) + sum(c for i, j, c in ties if label[i] != label[j])

        assert abs(cost(html_extract.min_cut(scores, ties)) - min(cost(x) for x in np.ndindex(*[2] * n))) < 1e-6


def test_preferences_round_trip(spark, make):
    turns = [(1, 0, "user", "q"), (1, 1, "assistant", "long answer"), (2, 0, "user", "q"), (2, 1, "assistant", "no"), (3, 0, "user", "alone"), (3, 1, "assistant", "x"),
             (4, 0, "user", "nobody answers"), (5, 0, None, None), (5, 1, "assistant", None), (1, 1, "assistant", "long answer"), (6, 0, "user", "alone"),
             (6, 1, "assistant", "x"), (None, 0, "user", "q")]
    rows = preference.preferences(make("conv_id long, turn int, role string, text string, kind string, prompt string", [(*t, "a", "b") for t in turns])).collect()
    out = {(r["kind"], r["chosen_id"]): r for r in rows}
    assert set(out) == {("pair", 1), ("single", 3), ("copy", 3), ("single", 4), ("single", 5)} and len(rows) == 5
    pair, copy = out["pair", 1], out["copy", 3]
    assert pair["rejected_id"] == 2 and pair["prompt_turns"] == 1 and pair["prompt"] == "<|user|>\nq<|end|>\n"
    assert [tuple(x) for x in pair["chosen"]] == [("<|assistant|>\n", False), ("long answer<|end|>\n", True)]
    assert [tuple(x) for x in pair["rejected"]] == [("<|assistant|>\n", False), ("no<|end|>\n", True)]
    assert copy["rejected_id"] == 6 and copy["prompt"] is None and copy["chosen"] is None
    assert out["single", 3]["prompt"] == "<|user|>\nalone<|end|>\n" and out["single", 3]["rejected"] is None
    assert out["single", 4]["chosen"] == [] and out["single", 5]["prompt"] == "<||>\n<|end|>\n"
    whole = preference.gather(table(spark, SF, "conversations"))
    made = preference.preferences(table(spark, SF, "conversations")).where("kind <> 'copy'").join(
        whole.select(whole.conv_id.alias("chosen_id"), preference.render(whole.turns).alias("all")), "chosen_id").collect()
    assert made
    for r in made:
        assert r["prompt"] + "".join(x["text"] for x in r["chosen"]) == r["all"]


def test_rivals_by_brute_force(spark, make, tmp_path):
    """Trees of conversations: each meets the best of those that share most turns with it. The SQL says the same."""
    rng = np.random.default_rng(21)
    convs = {i: tuple(("user", "assistant")[d % 2] + ":" + "abc"[rng.integers(3)] * int(rng.integers(1, 3)) for d in range(rng.integers(1, 6))) for i in range(160)}
    convs |= {500 + i: ("user:hot", f"assistant:{'y' * (i % 9)}", *(["user:more"] if i % 2 else [])) for i in range(60)}
    ones: dict = {}
    for i, c in sorted(convs.items()):
        ones.setdefault(c, i)
    said = {i: sum(len(t) - 10 for t in c if t.startswith("assistant")) for c, i in ones.items()}

    def common(a, b):
        return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

    want = {("copy", ones[c], i) for i, c in convs.items() if ones[c] != i}
    for c, i in ones.items():
        depth = max(common(c, o) for o in ones if o != c)
        group = sorted((-said[j], j) for o, j in ones.items() if common(c, o) >= depth)
        want.add(("pair", group[0][1], group[1][1] if group[0][1] == i else i) if depth else ("single", i, None))
    frame = make("conv_id long, turn long, role string, text string", [(i, k, *t.split(":")) for i, c in convs.items() for k, t in enumerate(c)])
    made = preference.texts(preference.preferences(frame)).toPandas()
    assert {(r.kind, r.chosen_id, None if r.kind == "single" else int(r.rejected_id)) for r in made.itertuples()} == want and len(made) == len(want)
    assert all(r.prompt_turns == common(convs[r.chosen_id], convs[int(r.rejected_id)]) for r in made.itertuples() if r.kind == "pair")
    frame.write.parquet(str(tmp_path / "c"))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c/*.parquet'")
    cols = list(made.columns)

    def rows(data):
        return sorted(tuple("" if v is None or v != v else str(int(v)) if isinstance(v, float) else str(v) for v in row) for row in data)

    assert rows(made.itertuples(index=False)) == rows(db.sql(f"SELECT {', '.join(cols)} FROM ({preference.oracle()})").fetchall())


def test_licences_by_brute_force(spark, make):
    tpl = {n: Counter(zip(w, w[1:])) for n, t in licenses.TEMPLATES.items() for w in [licenses.normal(t)]}
    mit = licenses.TEMPLATES["MIT"]
    texts = {1: mit, 2: mit.replace(" ", "\n", 30), 3: "x\nReleased under the MIT licence\ny", 4: "Released  under the MIT License!!", 5: "nothing", 6: None, 7: "",
             8: mit + " more words of something else" * 20, 9: "All rights reserved.\nLicensed under CC BY 4.0"}
    got = {r["doc_id"]: r for r in licenses.scan(make("doc_id long, text string", list(texts.items()))).collect()}
    for d, t in texts.items():
        units = dict(enumerate((t or "").split("\n"))) | ({-1: t} if t and "\n" in t else {})
        best = []
        for line, u in units.items():
            w = licenses.normal(u.replace("\n", " "))
            bag = Counter(zip(w, w[1:]))
            for n, b in tpl.items():
                dice = 2 * sum((bag & b).values()) / (sum(bag.values()) + sum(b.values()))
                if dice >= 0.8:
                    best.append((-dice, line, n))
        e = min(best) if best else (None, None, None)
        assert (got[d]["license"], got[d]["line"]) == (e[2], e[1]) and got[d]["n_units"] == len({x[1] for x in best})
        assert got[d]["dice"] == (-e[0] if best else None)


def test_leaks_are_found_and_others_left(make):
    rng = np.random.default_rng(4)
    vocabulary = [f"v{i}" for i in range(3000)]
    items = {i: " ".join(rng.choice(vocabulary, 40)) for i in range(12)}
    filler = [" ".join(rng.choice(vocabulary, 200)) for _ in range(60)]

    def edited(text):
        words = text.split()
        for at in (7, 19, 30):
            words[at] = "changed"
        del words[25]
        return " ".join(words)

    docs = {i: f for i, f in enumerate(filler)}
    leaks = {(100 + i, i) for i in range(12)} | {(200 + i, i) for i in range(12)}
    docs |= {100 + i: filler[i] + " " + items[i].upper() + "! " + filler[i + 1] for i in range(12)}
    docs |= {200 + i: filler[i + 20] + "\n" + edited(items[i]) + "\n" + filler[i + 30] for i in range(12)}
    docs |= {300: " ".join(items[0].split()[:6]), 301: None, 302: ""}
    out = decontaminate.contaminated(make("doc_id long, text string", list(docs.items())), make("item_id long, text string", [*items.items(), (50, None), (51, "")]))
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in out.collect()}
    assert set(got) == leaks and all(got[d, i] == 1 for d, i in leaks if d < 200) and all(got[d, i] < 1 for d, i in leaks if d >= 200)


def test_copies_with_many_changed_words_are_found(make):
    rng = np.random.default_rng(9)
    vocabulary = [f"v{i}" for i in range(3000)]
    items = {i: " ".join(rng.choice(vocabulary, 38)) for i in range(6)}
    filler = [" ".join(rng.choice(vocabulary, 200)) for _ in range(20)]

    def edited(text, every):
        return " ".join(f"x{n}" if n % every == every - 1 else word for n, word in enumerate(text.split()))

    def around(text, n):
        return filler[n] + " " + text + " " + filler[n + 1]

    docs = {100 * every + i: around(edited(items[i], every), i + every) for every in (4, 5, 6) for i in items}
    docs |= {1000 + 10 * n + i: around(items[i], n) for n in range(3) for i in (0, 1, 2)}  # verbatim copies of some items only
    docs |= {2000 + i: f for i, f in enumerate(filler)}
    expected = {(100 * every + i, i) for every in (4, 5, 6) for i in items} | {(1000 + 10 * n + i, i) for n in range(3) for i in (0, 1, 2)}
    found = decontaminate.contaminated(make("doc_id long, text string", list(docs.items())), make("item_id string, text string", [(f"item {i}", x) for i, x in items.items()]))
    got = {(r["doc_id"], int(r["item_id"][5:])): r["score"] for r in found.collect()}
    assert set(got) == expected
    for d, i in expected:
        changed = 38 // (d // 100) if d < 1000 else 0
        # an alignment need not end with changed words
        assert got[d, i] >= (2 * (38 - changed) - changed) / 76 > 0.5


def test_smith_waterman_by_brute_force():
    rng = np.random.default_rng(6)
    pairs = [(rng.integers(0, 5, 8).astype(np.uint64) * 4, rng.integers(0, 5, int(n)).astype(np.uint64) * 4) for n in rng.integers(1, 15, 20)]
    got, _ = decontaminate.align([a for a, _ in pairs], [b for _, b in pairs])
    for (a, b), score in zip(pairs, got, strict=True):
        h = np.zeros((len(a) + 1, len(b) + 1))
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert score == h.max()


def test_every_repeated_passage_is_found(spark, make):
    rng = np.random.default_rng(7)
    text = lambda n: " ".join(f"t{x}" for x in rng.integers(0, 1 << 30, n))
    passages = [text(n) for n in (51, 60, 90)]
    docs = {i: f"{text(40)} {passages[i % 3]} {text(30)}" for i in range(30)} | {i: text(150) for i in range(30, 50)} | {60: None, 61: "", 62: "short", 63: f"{passages[0][:80]} {text(60)}"}
    frame = make("doc_id long, text string, lang string", [(d, t, "x") for d, t in docs.items()])
    out = rows_of(substring_dedup.repeated_passages(frame))
    assert {r[0] for r in out} == set(range(3, 30)) and all(r[3] < r[0] for r in out)
    for doc, start, n, origin, ostart, _ in out:
        assert docs[doc].split()[start:start + n] == docs[origin].split()[ostart:ostart + n]
    assert {r[5] for r in out} == {0, 1, 2}
    left = {r["doc_id"]: r["text"] for r in substring_dedup.remove_repeats(frame).collect()}
    assert set(left) == set(docs) and all(left[d] == docs[d] for d in [0, 1, 2, *range(30, 50), 60, 61, 62, 63])
    assert all(passages[d % 3] not in left[d] and left[d].split()[:40] == docs[d].split()[:40] for d in range(3, 30))


def test_edited_passages_by_brute_force(make):
    """Passages of 50 to 120 words with one to three edits in other text: all with a Jaccard similarity of 0.8 are found."""
    rng = np.random.default_rng(12)
    fresh = lambda n: [f"t{x}" for x in rng.integers(0, 1 << 40, n)]
    docs, near, far = {}, {}, []
    for pair in range(150):
        n = int(rng.integers(50, 121))
        first = fresh(n)
        second = list(first)
        for at in sorted(rng.choice(np.arange(5, n - 5), int(rng.integers(1, 4)), replace=False).tolist(), reverse=True):
            second[at:at + 1] = [fresh(1), [], [second[at], *fresh(1)]][rng.integers(0, 3)]
        a, b = ({tuple(words[i:i + 5]) for i in range(len(words) - 4)} for words in (first, second))
        docs[2 * pair], docs[2 * pair + 1] = (" ".join(fresh(60) + words + fresh(60)) for words in (first, second))
        if len(a & b) >= 0.8 * len(a | b) and len(second) >= 50:
            near[2 * pair + 1] = len(second)
        else:
            far.append((2 * pair + 1, first, second))
    assert len(near) > 50 and len(far) > 20
    found = rows_of(substring_dedup.repeated_passages(make("doc_id long, text string", list(docs.items()))))
    got = {r[0]: r for r in found}
    assert {d: (r[1], r[2], r[3], r[4]) for d, r in got.items() if d in near} == {d: (60, n, d - 1, 60) for d, n in near.items()}
    for d, *_ in far:  # a part of the passage may be near enough
        if d in got:
            _, start, n, origin, ostart, _ = got[d]
            part = docs[d].split()[start:start + n]
            assert n >= 50 and any(len(a & b) >= 0.8 * len(a | b) for m in range(n - 30, n + 31) for a, b in [tuple(
                {tuple(words[i:i + 5]) for i in range(len(words) - 4)} for words in (part, docs[origin].split()[ostart:ostart + m]))])


def test_a_later_place_in_the_earliest_document_is_found(make):
    """Every window of the passage stands in the first document before, in pieces too short to count."""
    rng = np.random.default_rng(13)
    fresh = lambda n: [f"t{x}" for x in rng.integers(0, 1 << 40, n)]
    passage = fresh(64)
    docs = {1: fresh(20) + passage[:40] + fresh(30) + passage[24:] + fresh(30) + passage + fresh(20), 2: fresh(30) + passage + fresh(30), 3: fresh(90)}
    got = rows_of(substring_dedup.repeated_passages(make("doc_id long, text string", [(d, " ".join(w)) for d, w in docs.items()])))
    assert got and {(r[0], r[1], r[2], r[3], r[4]) for r in got} == {(2, 30, 64, 1, 160)}


def test_passages_behind_a_shared_phrase(spark, make):
    """Every document holds a phrase too short to count; some hold it inside longer passages, found only beyond the first."""
    rng = np.random.default_rng(11)
    text = lambda n: " ".join(f"t{x}" for x in rng.integers(0, 1 << 30, n))
    phrase, sides = text(30), [(text(20), text(0)), (text(0), text(20)), (text(10), text(10)), (text(70), text(0))]
    docs = {i: f"{text(60)} {phrase} {text(60)}" for i in range(200)}
    for i in range(40, 48):
        left, right = sides[i % 4]
        docs[i] = f"{text(60)} {left} {phrase} {right} {text(60)}"
    docs[100] = f"{text(5)} {docs[101]}"  # a copy that comes first
    docs[150] = docs[151] = docs[102]
    out = rows_of(substring_dedup.repeated_passages(make("doc_id long, text string, lang string", [(d, t, "x") for d, t in docs.items()])))
    assert {r[0] for r in out} == {44, 45, 46, 47, 101, 150, 151}
    assert {(r[0], r[3]) for r in out} == {(44, 40), (45, 41), (46, 42), (47, 43), (101, 100), (150, 102), (151, 102)}
    for doc, start, n, origin, ostart, _ in out:
        assert n >= 50 and docs[doc].split()[start:start + n] == docs[origin].split()[ostart:ostart + n]


def test_a_phrase_said_over_and_over_is_one_row_of_a_document(make, monkeypatch):
    """The second step joins a row for each document and surroundings, however often the document repeats them."""
    rng = np.random.default_rng(14)
    fresh = lambda n: [f"t{x}" for x in rng.integers(0, 1 << 40, n)]
    phrase, more, tables = fresh(40), fresh(20), {}
    docs = {i: [w for _ in range(20) for w in phrase + fresh(30)] + (phrase + more if i in (7, 9) else []) + fresh(30) for i in range(12)}
    written = substring_dedup.materialise
    monkeypatch.setattr(substring_dedup, "materialise", lambda frame, tag: tables.setdefault(tag, []).append(written(frame, tag)) or tables[tag][-1])
    got = rows_of(substring_dedup.repeated_passages(make("doc_id long, text string", [(d, " ".join(w)) for d, w in docs.items()])))
    assert {r[:5] for r in got} == {(9, 1400, 60, 7, 1400)}
    first, second = tables["passages"]
    opened = first.where("words = 0").join(tables["unclear"][0], "key", "left_semi")
    assert 0 < opened.count() == opened.select("key", "id").distinct().count()
    assert second.where("words = 0").isEmpty()


def test_a_second_occurrence_in_the_same_document_is_found(spark, make):
    rng = np.random.default_rng(12)
    text = lambda n: " ".join(f"t{x}" for x in rng.integers(0, 1 << 30, n))
    p = text(55)
    docs = {1: f"{text(30)} {p} {text(30)}", 2: f"{text(200)} {p} {text(300)} {p} {text(10)}"}
    out = rows_of(substring_dedup.repeated_passages(make("doc_id long, text string", list(docs.items()))))
    assert {r[:5] for r in out} == {(2, 200, 55, 1, 30), (2, 555, 55, 1, 30)}


def test_awkward_rows(spark, make, docs):
    labels = make("doc_id long, quality int, toxic int", [(1, 1, 0), (5, 0, 0), (None, 1, 0), (2, None, None)])
    n = docs.count()
    assert langid.identify(docs, langid.train(docs)).count() == n
    assert langid.identify(docs, None).where("lang_pred = 'und' and score = 0").count() == n
    assert ngram_join.ngram_join(docs).count() == n
    by = {r[0]: r[2] for r in rows_of(ngram_join.ngram_join(docs))}
    assert by[2] == 1 and by[3] == 1 and by[4] == 4 and by[5] == 5
    assert {r[0] for r in rows_of(ngram_join.keep_first(docs).select("doc_id"))} == {None, 1, 4, 5, 6, 7, 8, 9, 10}
    scores = crf.quality_scores(docs, labels)
    assert scores.count() == n and scores.where("doc_id in (4, 5, 7)").where("score = 0").count() == 3
    assert crf.keep_good(docs, labels).columns == docs.columns
    assert boosting.quality_rules(docs, labels).count() == n and boosting.quality_rules(docs, labels).where("doc_id in (4, 5)").where("base_failed and not kept").count() == 2
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    assert pieces.where("doc_id = 4").collect()[0][1:5] == (0, 1, zlib.crc32(b"\1\0\0\0"), 1) and pieces.where("doc_id = 8").count() == 2
    assert licenses.scan(docs).count() == n
    items = make("item_id long, text string", [(1, "zwei Worte"), (1, "zwei Worte"), (2, None)])
    assert {r[0] for r in rows_of(decontaminate.contaminated(docs, items))} == {8}
    assert decontaminate.drop_contaminated(docs, items).count() == n - 2
    found = rows_of(substring_dedup.repeated_passages(docs))
    assert {r[0] for r in found} >= {2, 3, 6, 10}
    assert substring_dedup.remove_repeats(docs).count() == n


def test_empty_tables(spark, make, docs):
    none, labels, items = docs.where("false"), make("doc_id long, quality int", []), make("item_id long, text string", [])
    pages, turns = make("page_id long, url string, html string", []), make("conv_id long, turn int, role string, text string", [])
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    for frame in (langid.identify(none, langid.train(none)), ngram_join.ngram_join(none), crf.quality_scores(none, labels), boosting.quality_rules(none, labels),
                  packing.pack(none, vocabulary), html_extract.extract(pages), preference.preferences(turns), licenses.scan(none),
                  decontaminate.contaminated(none, items), decontaminate.contaminated(docs, items), substring_dedup.repeated_passages(none), substring_dedup.remove_repeats(none)):
        assert frame.count() == 0
    assert crf.quality_scores(docs, labels).where("doc_id = 1 and predicted = 1").count() == 1


def test_pipeline(spark):
    import corpus_pipeline

    docs, frames = table(spark, SF, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        frames[name] = [r.asDict() for r in out.collect()]
        if name != "packing":
            assert out.columns == docs.columns
            docs = spark.createDataFrame([tuple(r.values()) for r in frames[name]], docs.schema)
    good, near, cut, clean = ({r["doc_id"]: r["text"] for r in frames[n]} for n, _ in corpus_pipeline.STAGES[:-1])
    groups = brute_components(good)
    assert set(near) == {d for d, (_, c) in groups.items() if c == d}
    assert set(cut) == set(near) and set(clean) <= set(cut)
    windows = defaultdict(set)
    for d, t in cut.items():
        w = WORD.findall(t)
        for i in range(len(w) - 50):
            windows[tuple(w[i:i + 51])].add(d)
    assert not [k for k, v in windows.items() if len(v) > 1]
    assert {r["doc_id"] for r in frames["packing"]} == set(clean)
