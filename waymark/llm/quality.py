"""Quality rules, line first, in DataFrame functions only.

Every line is judged on its punctuation, on whether it is a navigation bar and on whether it is boilerplate; the lines that fail are removed,
and a document is rejected if what is left holds too little of its words. A few counts over the whole text decide beforehand.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space between words, a word's character, and the characters that count as symbols.
SPACE, MARK, SYMBOLS = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]", "#*$%&|<>"
#: How a line of prose ends, and what it holds at least if its end was cut off.
ENDS, HOLDS = r"[.!?…:;。！？][\"'”’»)\]]*[\x20\x09-\x0D]*$", r"[.,;:!?。，、；：！？]"
SHORT_LINE = 8
#: A line with so many of these in a hundred words isn't prose: marks without meaning, separators of a menu.
SYMBOL_SHARE, SHOUT_SHARE, BAR_SHARE = 20, 20, 20
BAR = r"[\x20\x09-\x0D](?:[|>»·•/])(?:[\x20\x09-\x0D]|$)"
BOILERPLATE = (
    r"(?i)(all rights reserved|\(c\) *(19|20)\d\d|©|copyright (\(c\)|©|(19|20)\d\d)|licensed under|released under the|spdx-license-identifier"
    r"|cookie (policy|settings|consent)|(accept|use|uses) (all )?cookies|privacy policy|terms of (use|service)|enable javascript|javascript is (disabled|required)"
    r"|lorem ipsum|subscribe to our|sign up for our|log ?in to|click here|share (this|on)|back to top|skip to (main )?content|powered by"
    r"|alle rechte vorbehalten|datenschutzerkl[äÄ]rung|nutzungsbedingungen|cookie-einstellungen|zum inhalt springen"
    r"|tous droits r[éÉ]serv[éÉ]s|politique de confidentialit[éÉ]|mentions l[éÉ]gales|conditions d['’]utilisation|aller au contenu|haut de page"
    r"|todos los derechos reservados|pol[íÍ]tica de privacidad|aviso legal|t[éÉ]rminos de uso|ir al contenido|volver arriba)"
)
#: In lower case, what a text holds at least if any of its lines holds such a phrase; only then are the lines looked at.
STEMS = (
    "rights reserved", "(c)", "©", "copyright", "licensed under", "released under", "spdx-license", "cookie", "privacy policy", "terms of", "javascript", "lorem ipsum", "subscribe to", "sign up for", "log in to", "login to",
    "click here", "share ", "back to top", "skip to", "powered by", "rechte vorbehalten", "datenschutz", "nutzungsbedingungen", "inhalt springen", "tous droits", "politique de", "mentions l", "conditions d", "aller au contenu",
    "haut de page", "derechos reservados", "de privacidad", "aviso legal", "minos de uso", "ir al contenido", "volver arriba",
)
#: A boilerplate phrase condemns a line of up to so many words; in a longer one it is an aside.
BOILERPLATE_WORDS = 40
KEPT_SHARE = 50


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(MARK + "+")).cast("long")


def n_of(text: Column, characters: str) -> Column:
    """How many characters of the text are among these."""
    return (F.char_length(text) - F.char_length(F.translate(text, characters, ""))).cast("long")


def counted(text: Column) -> Column:
    """The lines of a text that hold a word, each with its number of words, which every rule needs."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("x"), n_words(x).alias("n"))), lambda s: s["n"] > 0)


def phrases(text: Column) -> Column:
    """True for a text that may hold a boilerplate phrase."""
    low = F.lower(text)
    return reduce(Column.__or__, [F.contains(low, F.lit(x)) for x in STEMS])


def passes(symbols: Column, shouts: Column, bars: Column, boilers: Column) -> Callable[[Column], Column]:
    """A rule for the counted lines of a text with these signs in it: true if none of the line rules fails. What the whole text has no sign of isn't looked for in its lines."""

    def rule(s: Column) -> Column:
        line, words = s["x"], s["n"]
        prose = F.rlike(line, F.lit(ENDS)) | ((words >= SHORT_LINE) & F.rlike(line, F.lit(HOLDS)))
        marked = symbols & (100 * n_of(line, SYMBOLS) > SYMBOL_SHARE * words)
        shouting = shouts & (100 * F.regexp_count(line, F.lit("!!")) > SHOUT_SHARE * words)
        barred = bars & (100 * F.regexp_count(line, F.lit(BAR)) > BAR_SHARE * words)
        boiler = boilers & (words <= BOILERPLATE_WORDS) & F.rlike(line, F.lit(BOILERPLATE))
        return prose & ~marked & ~shouting & ~barred & ~boiler

    return rule


def windows_of(words: Column) -> Column:
    """The windows of three words as (64-bit hash, place), sorted, so that equal ones are neighbours. All inside the row: no shuffle."""
    windows = F.when(F.size(words) >= 3, F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i"))))
    return F.sort_array(F.coalesce(windows, F.array().cast("array<struct<h:bigint,i:int>>")))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept_words (those of the lines that pass) and kept.

    A null text has no words; it and any text of under 50 words fail. A row's columns of these names are replaced; other extra columns stay.
    """
    made = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept_words", "kept")
    base = [F.col(f"`{c}`") for c in docs.columns if c not in made]
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    row = docs.select(F.struct(*base).alias("row"), whole.alias("t"))
    row = row.select("row", "t", F.filter(F.split("t", SPACE), lambda w: w != "").alias("w"), counted(F.col("t")).alias("l"), F.rlike("t", F.lit("[#*$%&|<>]")).alias("symbols"), F.contains("t", F.lit("!!")).alias("shouts"), F.rlike("t", F.lit("[|>»·•/]")).alias("bars"), phrases(F.col("t")).alias("boilers"))
    row = row.select("row", "t", "w", "l", "symbols", "shouts", "bars", "boilers", windows_of(F.col("w")).alias("s"))
    twice = F.filter("s", lambda x, j: F.coalesce(F.get("s", j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("s", j + 1)["h"] == x["h"], F.lit(False)))
    row = row.select("row", "t", "w", "l", "symbols", "shouts", "bars", "boilers", F.sort_array(F.transform(twice, lambda x: x["i"])).alias("p"))
    steps = F.transform("p", lambda p, j: F.least(F.coalesce(F.get("p", j + 1) - p, F.lit(3)), F.lit(3)))
    row = row.select(
        "row",
        F.size("w").cast("long").alias("n_words"),
        F.aggregate("w", F.lit(0).cast("long"), lambda n, w: n + F.char_length(w)).alias("word_chars"),
        n_of(F.col("t"), SYMBOLS).alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l.x"))).cast("long").alias("n_dup_lines"),
        F.aggregate(steps, F.lit(0).cast("long"), lambda n, x: n + x).alias("n_repeat_words"),
        F.aggregate(F.filter("l", passes(F.col("symbols"), F.col("shouts"), F.col("bars"), F.col("boilers"))), F.lit(0).cast("long"), lambda n, x: n + x["n"]).alias("kept_words"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return row.select("row.*", *made[:5], failed.alias("base_failed"), "kept_words", (~failed & (100 * F.col("kept_words") >= KEPT_SHARE * F.col("n_words"))).alias("kept"))


def clean(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that are kept, each with its failing lines and its empty ones removed. Columns stay, whatever their names; a null or empty text isn't kept.

    The row number keeps the filter above the counts: pushed below, it would copy their expressions into each other and count a text many times over.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("doc"), F.col(f"`{text}`").cast("string").alias("text"))
    kept = measured(rows).withColumn("nth", F.monotonically_increasing_id()).where("kept and nth >= 0")
    left = F.array_join(F.transform(F.filter(counted(F.col("text")), passes(*[F.lit(True)] * 4)), lambda s: s["x"]), "\n")
    return kept.select(*[(left if c == text else F.col(f"doc.c{i}")).alias(c) for i, c in enumerate(docs.columns)])


def oracle() -> str:
    """The query in DuckDB's SQL."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    count = lambda x, p: f"len(regexp_extract_all({x}, {q(p)}))"
    symbols = lambda x: f"(length({x}) - length(translate({x}, {q(SYMBOLS)}, '')))"
    words = count("x", MARK + "+")
    passing = (
        f"(regexp_matches(x, {q(ENDS)}) or ({words} >= {SHORT_LINE} and regexp_matches(x, {q(HOLDS)}))) and 100 * {symbols('x')} <= {SYMBOL_SHARE} * {words}"
        f" and 100 * {count('x', '!!')} <= {SHOUT_SHARE} * {words} and 100 * {count('x', BAR)} <= {BAR_SHARE} * {words}"
        f" and not ({words} <= {BOILERPLATE_WORDS} and regexp_matches(x, {q(BOILERPLATE)}))"
    )
    return f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
w as (select r, regexp_extract_all(t, {q(MARK + "+")}) as w from d),
g as (select r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as s from (select r, w, unnest(generate_series(1, len(w) - 2)) as i from w)),
p as (select r, i from (select r, i, count(*) over (partition by r, s) as n from g) where n > 1),
n as (select r, count(distinct i + k) as n from p, (select unnest([0, 1, 2]) as k) group by r),
l as (select r, x from (select r, unnest(string_split(t, chr(10))) as x from d) where regexp_matches(x, {q(MARK)})),
m as (select r, count(*) - count(distinct x) as dups, sum(case when {passing} then {words} else 0 end) as kept from l group by r),
b as (select d.doc_id, len(w.w) as n_words, coalesce(list_sum(list_transform(w.w, lambda x: length(x))), 0) as word_chars, {symbols("d.t")} as n_symbols, coalesce(m.dups, 0) as n_dup_lines,
  coalesce(n.n, 0) as n_repeat_words, coalesce(m.kept, 0) as kept_words from d join w using (r) left join n using (r) left join m using (r))
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines,
  cast(n_repeat_words as bigint) as n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and 100 * kept_words >= {KEPT_SHARE} * n_words as kept
from b"""
