import random

import numpy as np
import pytest

from panelforge.llm import leakage
from panelforge.llm.leakage import bodies, find_leaks, prefix_of, windows_of
from panelforge.llm.reading import fold, page_stream, reading_order

DOCS = "doc_id long, text string, line_x array<int>, line_y array<int>, item_id string, words int"
ITEMS = "item_id long, suite string, lang string, text string, doc_id int"
SYL = ["ba", "ke", "lo", "mi", "ru", "sta", "vor", "wen", "zil", "gra", "ho", "tin", "pel", "dam", "fri", "que", "nos", "lar", "chy", "mu"]


def words(rng, n):
    return ["".join(rng.choice(SYL) for _ in range(rng.randint(1, 3))) for _ in range(n)]


def lay(lines, columns=1, y0=100):
    per = -(-len(lines) // columns)
    rows = [(t, 100 + 600 * (i // per), y0 + 30 * (i % per)) for i, t in enumerate(lines)]
    rows.sort(key=lambda r: (r[2], r[1]))
    return "\n".join(r[0] for r in rows), [r[1] for r in rows], [r[2] for r in rows]


def wrap(ws, width, rng):
    text, lines, line = " ".join(ws), [], ""
    for w in text.split(" "):
        if len(line) + len(w) > width:
            cut = rng.randint(1, len(w)) if len(w) > 3 else 0
            lines.append(line + (w[:cut] + rng.choice(["-", "=", "¬", ""]) if cut else ""))
            line = w[cut:] + " "
        else:
            line += w + " "
    return [*lines, line]


def noisy(text, rng, share):
    swap = {"e": "c", "o": "0", "l": "1", "i": "l", "a": "u", "s": "5", "h": "b"}
    return "".join(swap[c] if c in swap and rng.random() < share else c for c in text)


@pytest.fixture(scope="module")
def case():
    rng = random.Random(4)
    shared = "Read the passage below and then answer the question."
    items = {k: words(rng, 90) for k in range(8)}
    texts = {k: (shared + " " if k < 4 else "") + " ".join(w).capitalize() + "." for k, w in items.items()}
    docs, want = [], set()

    def page(d, body, width=34, columns=2, share=0.0, advert=None):
        lines = wrap(body, width, rng)
        if advert:
            lines[len(lines) // 2 : len(lines) // 2] = advert
        t, x, y = lay([noisy(s, rng, share) for s in lines], columns)
        docs.append((d, t, x, y, "clash", 3))

    filler = lambda n: words(rng, n)
    page(1, filler(60) + items[0][10:45] + filler(60), share=0.3)
    page(2, filler(40) + items[1][:70] + filler(20), advert=["SOAP! SOAP!", "Sold everywhere by the makers", "2d. and 5s."])
    page(3, filler(100) + items[2][30:49] + filler(50))  # 19 words
    page(4, filler(50) + rng.sample(items[3], 60) + filler(50))  # another order
    page(5, shared.split() + filler(80))  # the instruction alone
    replaced = list(items[5][20:60])
    for k in (5, 16, 27, 38):
        replaced[k] = filler(1)[0]
    page(6, filler(30) + replaced + filler(30), columns=3, width=20)
    page(7, filler(300))
    want = {(1, 0), (2, 1), (6, 5)}
    docs += [(8, None, None, None, "", 1), (9, "", [], [], "", 1), (None, "x", [1], [1], "", 1), (10, " ".join(items[6]), None, [1, 2], "", 1), (11, " ".join(filler(400_000) + items[7][:40]), [1], [1], "", 1)]
    want |= {(10, 6), (11, 7)}
    return docs, texts, want


def frames(spark, docs, texts):
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame([(k, "s", "en", t, 1) for k, t in texts.items()] + [(None, "s", "en", "x", 1), (99, "s", "en", None, 1), (98, "s", "en", "", 1), (97, "s", "en", "too short", 1)], ITEMS)


def test_planted(spark, case):
    docs, texts, want = case
    d, i = frames(spark, docs, texts)
    got = find_leaks(d, i)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    assert find_leaks(d.union(d), i.union(i)).count() == 2 * len(want)


def test_both_ways_of_joining(spark, case, monkeypatch):
    docs, texts, want = case
    few = find_leaks(*frames(spark, docs, texts))
    monkeypatch.setattr(leakage, "SENT_SHINGLES", 10)
    many = find_leaks(*frames(spark, docs, texts))
    assert {(r.doc_id, r.item_id) for r in many.collect()} == want
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))


def test_small_tables_lose_nothing(spark, case, monkeypatch):
    docs, texts, want = case
    monkeypatch.setattr(leakage, "MOST_SLOTS", 15)
    for most in (1_000_000, 10):
        monkeypatch.setattr(leakage, "SENT_SHINGLES", most)
        assert {(r.doc_id, r.item_id) for r in find_leaks(*frames(spark, docs, texts)).collect()} == want


def test_prefix_bound():
    """A page that shares SHARED of a window's shingles, whichever, has NEEDED of its prefix; the rarest are kept."""
    rng = np.random.default_rng(2)
    ends = np.cumsum(rng.integers(2, 9, 60))
    n = int(ends[-1]) - leakage.SHINGLE + 1
    frequency = rng.integers(0, 1000, n)
    kept = np.zeros(n, dtype=bool)
    kept[prefix_of(ends, rng.integers(-(2**62), 2**62, n), frequency)] = True
    assert 0.5 < kept.mean() < 0.9 and frequency[kept].mean() < 0.8 * frequency[~kept].mean()
    for first, end in zip(*windows_of(ends), strict=True):
        assert (~kept[first:end]).sum() <= int(leakage.SHARED * (end - first)) - leakage.NEEDED


def test_items_that_share_text_are_found(spark, monkeypatch):
    rng = random.Random(11)
    say = lambda ws: " ".join(ws).capitalize() + "."
    same, passage = words(rng, 60), [words(rng, 15) for _ in range(5)]
    first, second = (" ".join(map(say, passage)) + " " + say(words(rng, 8)) for _ in range(2))
    ask = say(words(rng, 30))
    texts = {1: say(same), 2: say(same), 3: first, 4: second, 5: ask + " " + say(words(rng, 50)), 6: "Short line here. " + say(words(rng, 50))}
    texts |= {k: ask + " " + say(words(rng, 50)) for k in range(10, 40)}
    page = lambda d, body: (d, " ".join(words(rng, 50) + body + words(rng, 50)), [1], [1], "", 1)
    docs = [page(1, same), page(2, sum(passage, [])[:40]), page(3, ask.split())]
    for most in (1_000_000, 300):  # an instruction is one by all items, whichever way they are joined
        monkeypatch.setattr(leakage, "SENT_SHINGLES", most)
        got = find_leaks(*frames(spark, docs, texts)).collect()
        assert {(r.doc_id, r.item_id) for r in got} == {(1, 1), (1, 2), (2, 3), (2, 4)} and len(got) == 4


def test_empty(spark, case):
    docs, texts, _ = case
    d, i = frames(spark, docs, texts)
    assert find_leaks(d.limit(0), i).count() == 0 and find_leaks(d, i.limit(0)).count() == 0


def test_reading():
    assert list(reading_order(np.array([900, 100, 905, 110]), np.array([10, 12, 40, 44]))) == [1, 3, 0, 2]
    assert fold("Heſmoor—HESMOOR!") == fold("hesmoorhesmoor") and fold("Tür") == fold("tur") and fold("ﬁre") == fold("fire")
    assert page_stream("b\na", [900, 100], [1, 2]) == fold("ab") and page_stream("b\na", [900], [1]) == fold("ba") and page_stream(None, None, None) == b""
    assert bodies(["Do this now please. Alpha.", "Do this now please. Beta.", "Gamma."]) == ["Alpha.", "Beta.", "Gamma."]
