import re

from pyspark.sql import functions as F

from panelforge.llm import quality
from panelforge.llm.quality import fold, pieces, text_quality

DOCS = "doc_id long, text string, lang string, words string, line string, lines int"
COMMON = ["the", "of", "was", "by", "and", "to", "a", "had", "were", "in", "der", "die"]
PROSE = "The tower, being narrow and southern,\nwas described by Corimond for 215\nshillings. The expense of the meadow\nwas put at 3 crowns by the widow\nand the trustees had returned to it.\n"
TABLE = "Orsley   nine   three   two   won\nZanorick   three   one   six   drawn\nAbangood   nil   even   three   lost\n"
LISTED = "• Library at Peleton.\n1. Theatre at Vesaford.\nh) Orchard at Fositon.\n"
JUNK = "prin» tel| 1 1~ 9>\nba# 8§ 2' 0| tra> 1]\n"


def run(spark, texts):
    d = spark.createDataFrame([(i, t, None, "x", "y", 1) for i, t in enumerate(texts)], DOCS)
    w = spark.createDataFrame([("en", x) for x in COMMON] + [(None, None), ("en", "the"), ("de", "Der")], "lang string, word string")
    return {r.doc_id: r for r in text_quality(d, w).collect()}


def test_verdicts_and_ratios(spark):
    texts = [PROSE, TABLE, LISTED * 3, JUNK, PROSE + TABLE, PROSE + TABLE * 5, "", None, " \n\t\n", PROSE.replace("e", "c").replace("a", "u"), "eht rewot saw debircsed yb eht\nfo eht wodaem dna eht\n" * 3]
    got = run(spark, texts)
    assert [got[i].verdict for i in range(len(texts))] == ["prose", "not_prose", "not_prose", "not_prose", "prose", "not_prose", "blank", "blank", "blank", "prose", "not_prose"]
    words = re.findall(r"\w+", PROSE)
    visible = len(re.sub(r"\s", "", PROSE))
    r = got[0]
    assert r.n_words == len(words) and r.n_lines == 5
    assert abs(r.mean_word_length - sum(map(len, words)) / len(words)) < 1e-12
    assert abs(r.symbol_ratio - (visible - sum(map(len, words))) / visible) < 1e-12
    assert abs(r.common_share - sum(w.lower() in COMMON for w in words) / len(words)) < 1e-12
    assert r.punctuated_share == 0.2
    assert got[6].n_words == 0 and got[6].common_share is None


def test_pieces_give_what_whole_texts_give(spark, monkeypatch):
    text = "\n".join("word " * (k % 23) + "x" * (k % 7) + ("   the of" if k % 5 == 0 else "") for k in range(400)) + "\n\nlast"
    texts = [text, PROSE * 3, TABLE * 5, LISTED * 3, JUNK * 3, PROSE.replace("\n", " ") * 3, "", None, "x" * 900]
    whole = run(spark, texts)
    for size in (7, 33, 200):
        monkeypatch.setattr(quality, "CHUNK", size)
        cut = spark.createDataFrame([(t,) for t in texts if t], "t string").select("t", pieces(F.col("t")).alias("p")).collect()
        assert all("".join(r.p) == r.t for r in cut if "\n" not in r.t)
        assert run(spark, texts) == whole


def test_long_text_repeats_and_empty(spark):
    got = run(spark, [PROSE * 4000, "x" * 300_000])
    assert got[0].n_lines == 20_000 and got[0].verdict == "prose" and got[1].n_words == 1
    d = spark.createDataFrame([(1, PROSE, "", "", "", 1), (1, PROSE, "", "", "", 1), (None, PROSE, "", "", "", 1)], DOCS)
    w = spark.createDataFrame([], "lang string, word string")
    assert [r.n_lines for r in text_quality(d, w).collect()] == [10]
    assert text_quality(d.limit(0), w).count() == 0


def test_word_lists_of_any_length(spark, monkeypatch):
    texts = [PROSE, TABLE, LISTED, JUNK, PROSE + TABLE * 5, "", None, "eht rewot saw debircsed yb eht\n", PROSE, PROSE]
    few = run(spark, texts)
    monkeypatch.setattr(quality, "MOST_WORDS", 3)
    assert run(spark, texts) == few
    monkeypatch.setattr(quality, "CHUNK", 20)
    assert run(spark, texts) == few


def test_fold():
    assert fold("The") == fold("Thc") == fold("thé,") and fold("war") != fold("der")
