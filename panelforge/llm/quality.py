"""Per-document text statistics, and which documents are natural prose.

A text is cut into lines, the lines of long texts are spread over all tasks, and
a long line is cut at white space. Each piece gives counts that add up, and what
it is joined to (the gap before it, the mark at its end) corrects them at its
edges. Counts of pieces are summed to lines, those of lines to documents: partly
where they are, then once more by key. Ratios and the verdict come from sums alone.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a text from which its lines are spread over tasks, and of a piece of a line.
CHUNK = 32_768
#: Frequent words up to which they are literals of the plan; beyond, tokens meet them in a join.
MOST_WORDS = 20_000

#: Characters a scanner takes for one another; each class is folded to its first character.
CONFUSED = ("eoc06", "ilt1fj", "aun", "hb", "s5ſ", "vy")
#: Frequent words that stand in lists and tables as well as in sentences.
LISTED = ("and", "at", "by", "und", "et", "in", "im", "of", "from")
#: Removed from the ends of words before they are compared.
MARKS = ".,;:!?'\"()-"

#: What an entry of a list or a row of a table looks like: gaps between columns, rules, leaders, bullets.
GAP = r"(?<=\S) {2,}(?=\S)"
RULED = r"\|"
LEADERS = r"[.·,]{4,}|(?:[.·] ?){5,}"
BULLET = r"^\s*(?:[0-9lI]{1,3}[.)]|[a-z]\)|[*•\-–—·]) +\S"
#: A token that is a number; it is no misread word.
NUMBER = r"(?<!\S)[\d.,/]++(?!\S)"
#: Characters that prose is made of.
ORDINARY = r"""[\p{L}\p{N}\s.,;:!?'"()/·—¬\xad=-]+"""
#: A token with a digit; begins at a token's start only and never backtracks, so a line of any length is scanned once.
FIGURE = r"(?<!\S)[^\s\d]*+\d\S*+"
MARKED = "|".join((RULED, LEADERS))

#: Share of a sentence's words that are frequent words, at the least.
COMMON_SHARE = 0.3


def _folding() -> tuple[str, str]:
    """From and to for ``translate``: accents dropped, confusable characters joined, marks removed."""
    joined = {ch: cls[0] for cls in CONFUSED for ch in cls}
    table = {ch: to for ch, to in joined.items() if ch != to}
    for code in range(0xC0, 0x180):
        ch = chr(code).lower()
        base = unicodedata.normalize("NFD", ch)[0]
        if base != ch:
            table[ch] = joined.get(base, base)
    return "".join(table) + MARKS, "".join(table.values())


FROM, TO = _folding()
_TABLE = str.maketrans(FROM[: len(TO)], TO, FROM[len(TO) :])


def fold(word: str) -> str:
    """A word as compared: lower case, without accents and marks, confusable letters joined."""
    return word.lower().translate(_TABLE)


def pieces(line: Column, size: int | None = None) -> Column:
    """A line in pieces of at most ``size`` characters that begin at its start or at white space; a longer token stays whole."""
    size = size or CHUNK
    cut = F.regexp_extract_all(line, F.lit(rf"(?s)(.{{1,{size}}}(?=\s|$)|\s*\S+)"), 1)
    return F.when(F.length(line) <= size, F.array(line)).otherwise(cut)


def lines_of(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``doc_id, doc, line_no, piece_no, line``: the lines of short texts, and the pieces of the lines of long ones, spread over tasks before they are looked at.

    ``doc`` numbers the rows of the table. A null text has one empty line. The
    table is scanned for each of the two; a scan splits no text of the other kind.
    """
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("doc")).where("doc_id is not null")
    long = F.length("text") > CHUNK
    cut = lambda df: df.select("doc_id", "doc", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    short = cut(docs.where(~long)).select("doc_id", "doc", "line_no", F.lit(0).alias("piece_no"), "line")
    spread_lines = cut(docs.where(long)).repartition("doc", "line_no")
    return short, spread_lines.select("doc_id", "doc", "line_no", F.posexplode(pieces(F.col("line"))).alias("piece_no", "line"))


def _words(common_words: DataFrame) -> DataFrame:
    return common_words.select(F.lower("word").alias("word")).where("word is not null and word <> ''").distinct()


def _in(words: Iterable[str]):
    words = sorted(words)
    return lambda w: w.isin(words) if words else F.lit(False)


def telling_words(words: Iterable[str]) -> tuple[set[str], set[str]]:
    """Of frequent words, as compared, those that speak for a sentence, and how they look in a mirror."""
    words = set(words)
    telling = {fold(w) for w in words} - {fold(w) for w in LISTED}
    telling = {w for w in telling if len(w) >= 2} | ({"a"} if "a" in words else set())
    return telling, {w[::-1] for w in telling} - telling


#: Counts that add up over the pieces of a line.
ADDED = ("n_words", "word_chars", "n_common", "visible", "letters", "odd", "gaps", "n_tokens", "n_figures", "forward", "backward")


def _tokens(line: Column) -> tuple[Column, Column]:
    """Words as counted, and tokens as compared."""
    return F.regexp_extract_all(F.lower(line), F.lit(r"([\p{L}\p{N}]+)"), 1), F.split(F.translate(F.regexp_replace(F.lower(line), NUMBER, " "), FROM, TO), r"\s+")


def piece_counts(lines: DataFrame, words: DataFrame) -> DataFrame:
    """The counts of each piece of :func:`lines_of`, and ``first`` and ``last`` marks that belong to a line's ends."""
    line = F.col("line")
    known = words.limit(MOST_WORDS + 1).collect()
    few = len(known) <= MOST_WORDS
    spoken, compared = _tokens(line)
    if few:
        common = {r["word"] for r in known}
        telling, mirrored = telling_words(common)
        counted = lines.withColumn("words", spoken).withColumn("tokens", compared)
        found = [F.size(F.filter(c, _in(among))).alias(n) for c, among, n in (("words", common, "n_common"), ("tokens", telling, "forward"), ("tokens", mirrored, "backward"))]
    else:
        counted = _met(lines, words).withColumn("words", spoken)
        found = ["n_common", "forward", "backward"]
    return counted.select(
        "doc_id",
        "doc",
        "line_no",
        "piece_no",
        F.length(F.regexp_replace(line, r"\s+", "")).alias("visible"),
        F.length(F.regexp_replace(line, r"[^\p{L}]+", "")).alias("letters"),
        F.length(F.regexp_replace(line, ORDINARY, "")).alias("odd"),
        F.size("words").alias("n_words"),
        F.aggregate("words", F.lit(0), lambda a, w: a + F.length(w)).alias("word_chars"),
        *found,
        (F.regexp_count(line, F.lit(GAP)) + ((F.col("piece_no") > 0) & line.rlike(r"^ {2,}\S")).cast("int")).alias("gaps"),
        F.regexp_count(line, F.lit(r"\S+")).alias("n_tokens"),
        F.regexp_count(line, F.lit(FIGURE)).alias("n_figures"),
        line.rlike(r"""[.!?]["'»)]*\s*$""").alias("ends"),
        ((F.col("piece_no") == 0) & line.rlike(BULLET)).alias("bullet"),
        line.rlike(MARKED).alias("marked"),
        (F.upper(line) == line).alias("upper"),
        (F.lower(line) != line).alias("cased"),
    )


def _met(lines: DataFrame, words: DataFrame) -> DataFrame:
    """``lines`` with ``n_common``, ``forward`` and ``backward`` counted by joins of tokens, for word lists of any length."""
    key = ["doc", "line_no", "piece_no"]

    def folded(batches):
        for pdf in batches:
            yield pdf.assign(token=[fold(w) for w in pdf["word"]])

    compared = words.mapInPandas(folded, "word string, token string")
    telling = compared.where(~F.col("token").isin([fold(w) for w in LISTED]) & ((F.length("token") >= 2) | (F.col("word") == "a"))).select("token").distinct()
    mirrored = telling.select(F.reverse("token").alias("token")).subtract(telling)
    marks = words.select(F.col("word").alias("token"), F.lit("n_common").alias("what")).unionByName(telling.withColumn("what", F.lit("forward"))).unionByName(mirrored.withColumn("what", F.lit("backward")))
    spoken, looked = _tokens(F.col("line"))
    each = F.explode(F.concat(F.transform(spoken, lambda w: F.struct(w.alias("token"), F.lit(True).alias("spoken"))), F.transform(looked, lambda w: F.struct(w.alias("token"), F.lit(False).alias("spoken")))))
    tokens = lines.select(*key, each.alias("t")).select(*key, "t.token", "t.spoken").groupBy(*key, "token", "spoken").agg(F.count("*").alias("k"))
    met = tokens.join(marks, "token").where(F.col("spoken") == (F.col("what") == "n_common"))
    sums = met.groupBy(*key).agg(*[F.coalesce(F.sum(F.when(F.col("what") == n, F.col("k"))), F.lit(0)).cast("int").alias(n) for n in ("n_common", "forward", "backward")])
    return lines.join(sums, key, "left").fillna(0, ["n_common", "forward", "backward"])


def joined_pieces(counted: DataFrame) -> DataFrame:
    """The counts of whole lines from those of their pieces."""
    return counted.groupBy("doc_id", "doc", "line_no").agg(
        *[F.sum(c).alias(c) for c in ADDED], F.max_by("ends", F.when(F.col("visible") > 0, F.col("piece_no"))).alias("ends"), F.max("bullet").alias("bullet"), F.max("marked").alias("marked"), F.min("upper").alias("upper"), F.max("cased").alias("cased")
    )


def line_counts(lines: DataFrame) -> DataFrame:
    """What each line is, from its counts; every column but ``doc_id`` adds up over lines."""
    seen = F.col("visible") > 0
    entry = F.col("bullet") | F.col("marked") | (F.col("gaps") >= 2)
    kind = (
        F.when(entry & (F.col("forward") <= 1), "entry")
        .when(F.col("upper") & F.col("cased") & (F.col("letters") >= 0.7 * F.col("visible")), "heading")
        .when((F.col("n_figures") >= 3) & (F.col("n_figures") >= 0.4 * F.col("n_tokens")), "entry")
        .when((F.col("odd") > 0.08 * F.col("visible")) | (F.col("letters") < 0.4 * F.col("visible")), "junk")
        .when(F.col("backward") > F.col("forward"), "junk")
        .when(F.col("forward") > 0, "told")
        .otherwise("open")
    )
    marked = lines.withColumn("kind", F.when(seen, kind).otherwise("blank"))
    is_kind = lambda k: (F.col("kind") == k).cast("int")
    return marked.select(
        "doc_id",
        seen.cast("int").alias("lines"),
        "n_words",
        "word_chars",
        "n_common",
        "visible",
        F.coalesce("ends", F.lit(False)).cast("int").alias("ends"),
        is_kind("heading").alias("headings"),
        is_kind("told").alias("told"),
        is_kind("open").alias("open"),
        "forward",
        "backward",
        F.when(F.col("kind").isin("told", "open"), F.col("n_tokens")).otherwise(0).alias("free_tokens"),
    )


def text_quality(documents: DataFrame, common_words: DataFrame, limit: float = 0.5) -> DataFrame:
    """One row of statistics per document, with a verdict.

    ``n_words`` (runs of letters and digits), ``mean_word_length``,
    ``symbol_ratio`` (visible characters that are neither letter nor digit),
    ``punctuated_share`` (of non-empty lines, those ending a sentence),
    ``common_share`` (of words, those among the frequent words of any language;
    a page's language label is not trusted), ``n_lines`` and ``unprosed_share``:
    the share of lines that are entries of lists, rows of tables or junk. Lines
    that look like entries or junk count by themselves, lines in capitals (headings,
    advertisements) never; of the other lines, those without a frequent word count as far as there are more of them than
    sentences of that length would have. A page with more frequent words spelled
    backwards than forwards cannot be read and has no prose. ``verdict`` is ``prose``, ``not_prose``
    (``unprosed_share`` above ``limit``) or ``blank``.

    Words are compared with confusable letters joined, so misread prose stays
    prose. Null, empty and blank texts: zero counts, null ratios, ``blank``.
    Repeated ids are added together as if one text; null ids are left out. Texts
    are read whole and once; a word is never cut. ``common_words`` is counted when
    this is called (an action): up to ``MOST_WORDS`` are literals, more are joined.
    """
    words = _words(common_words)
    short, long = lines_of(documents)
    counted = line_counts(piece_counts(short, words)).unionByName(line_counts(joined_pieces(piece_counts(long, words))))
    sums = counted.groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in counted.columns if c != "doc_id"])
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    free = F.col("told") + F.col("open")
    expected = 1 - F.pow(F.lit(1 - COMMON_SHARE), F.col("free_tokens") / F.greatest(free, F.lit(1)))
    prose = F.when(free > 0, F.least(free.cast("double"), F.col("told") / expected)).otherwise(0.0)
    prose = F.when(F.col("backward") > F.col("forward"), 0.0).otherwise(prose + F.col("headings"))
    told = sums.select(
        "doc_id",
        "n_words",
        share("word_chars", "n_words").alias("mean_word_length"),
        F.when(F.col("visible") > 0, (F.col("visible") - F.col("word_chars")) / F.col("visible")).alias("symbol_ratio"),
        share("ends", "lines").alias("punctuated_share"),
        share("n_common", "n_words").alias("common_share"),
        F.col("lines").alias("n_lines"),
        F.when(F.col("lines") > 0, (F.col("lines") - prose) / F.col("lines")).alias("unprosed_share"),
    )
    verdict = F.when(F.col("n_lines") == 0, "blank").when(F.col("unprosed_share") > limit, "not_prose").otherwise("prose")
    return told.withColumn("verdict", verdict)
