"""Column functions for place labels, and the split of route metadata from them.

All are built-in expressions. The pattern flags make white space, word borders and letter case those of Unicode and a line end a line feed only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLAGS = "(?iuUd)"
PAREN = FLAGS + r"\(\s*VIA\b([^)]*)\)?"
LEADING_DASH = FLAGS + r"^\s*VIA\b(.+?)\s*-\s*(.+)$"
LEADING_TOKEN = FLAGS + r"^\s*VIA\s+(\S+)\s+(.+)$"
TRAILING = FLAGS + r"^(.*?)\s+VIA\s+(.+)$"
EDGE = " ,&-"


def paren_clauses(label: Column) -> Column:
    """The clauses of every `(VIA ...)`, closed or not."""
    return F.regexp_extract_all(label, F.lit(PAREN), 1)


def without_paren(label: Column) -> Column:
    return F.regexp_replace(label, PAREN, " ")


def matched(label: Column, pattern: str, group: int) -> Column:
    """A group of the pattern, null where it doesn't match."""
    return F.when(F.rlike(label, F.lit(pattern)), F.regexp_extract(label, pattern, group))


def join_clauses(clauses: Column) -> Column:
    """The clauses without blanks and separators at their ends, the empty ones left out, as one list; null if there is none. A hop inside a clause counts as an entry."""
    joined = F.array_join(F.filter(F.transform(clauses, lambda c: F.btrim(c, F.lit(EDGE))), lambda c: c != ""), ", ")
    return F.regexp_replace(F.nullif(joined, F.lit("")), FLAGS + r"\s+VIA\s+", ", ")


def split_via(df: DataFrame, label: str, place: str = "place", via: str = "via") -> DataFrame:
    """df with the place and the via list of a label; via is null where the label has none.

    Bracketed clauses go first; then a leading clause, up to the first dash or else of one word; then a trailing one. Each step works on what the last left.
    A null label gives nulls.
    """
    df = df.withColumns({"_a": paren_clauses(F.col(label)), "_s": without_paren(F.col(label))})
    dash = F.rlike("_s", F.lit(LEADING_DASH))
    lead = F.when(dash, F.regexp_extract("_s", LEADING_DASH, 1)).otherwise(matched(F.col("_s"), LEADING_TOKEN, 1))
    rest = F.when(dash, F.regexp_extract("_s", LEADING_DASH, 2)).otherwise(F.coalesce(matched(F.col("_s"), LEADING_TOKEN, 2), F.col("_s")))
    df = df.withColumns({"_b": lead, "_r": rest})
    trail = matched(F.col("_r"), TRAILING, 2)
    clauses = F.concat("_a", F.array_compact(F.array(F.col("_b"), trail)))
    return df.withColumns({place: F.coalesce(matched(F.col("_r"), TRAILING, 1), F.col("_r")), via: join_clauses(clauses)}).drop("_a", "_s", "_b", "_r")


def tidy(label: Column) -> Column:
    """Upper case, no apostrophes, single blanks, even spacing about brackets, commas, ampersands and slashes; what is left open at the end is cut."""
    s = F.regexp_replace(F.upper(label), "[’']", "")
    for pattern, to in ((r"\s*\(\s*", " ("), (r"\s*\)", ")"), (r"\s*,\s*", ", "), (r"\s*&\s*", " & "), (r"\s*/\s*", "/"), (r"\s+", " ")):
        s = F.regexp_replace(s, "(?U)" + pattern, to)
    s = F.trim(F.regexp_replace(F.btrim(s, F.lit(EDGE + "(")), r"\(\s*\)", ""))
    unclosed = F.length(s) - F.length(F.replace(s, F.lit("("))) > F.length(s) - F.length(F.replace(s, F.lit(")")))
    s = F.when(unclosed, F.trim(F.regexp_replace(s, r"\([^(]*$", ""))).otherwise(s)
    return F.btrim(F.regexp_replace(s, r"(?U)\s+", " "), F.lit(EDGE))


def station_words(place: Column) -> Column:
    """RAILWAY STATION is a STATION, then STATIONS are one."""
    s = F.regexp_replace(place, FLAGS + r"\bRAILWAY\s+STATION\b", "STATION")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"(?U)\bSTATIONS\b", "STATION"), r"(?U)\s+", " "))


def canonical_key(place: Column) -> Column:
    """The letters A-Z and digits of a place, in their order."""
    return F.regexp_replace(F.upper(place), "[^A-Z0-9]", "")


def title_case(name: Column) -> Column:
    """Words with a capital, but for acronyms: all-capital words of up to three letters and words with a digit stay. A leading `N_` stays."""
    prefix, rest = F.regexp_extract(name, r"^(\d+_)?", 0), F.regexp_replace(name, r"^\d+_", "")
    kept = lambda w: (F.rlike(w, F.lit(r"^[A-Z]{1,3}$"))) | F.rlike(w, F.lit(r"\d"))
    word = lambda w: F.when(kept(w), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.greatest(F.length(w), F.lit(0))))))
    return F.concat(prefix, F.array_join(F.transform(F.split(rest, " "), word), " "))


def prefix_number(name: Column) -> Column:
    return F.regexp_extract(name, r"^(\d+)_(.*)$", 1).try_cast("long")


def prefix_base(name: Column) -> Column:
    return F.coalesce(matched(name, r"^(\d+)_(.*)$", 2), name)


def is_compound(name: Column) -> Column:
    """Two places in one label: only flagged, never split."""
    return F.rlike(name, F.lit(r"\S\s*[&/]\s*\S|\S-\S|\S\s*,\s*\S"))


def is_malformed(name: Column) -> Column:
    """Blanks at the ends or doubled, or a via clause left open."""
    return F.rlike(name, F.lit(r"^\s|\s$|\s\s")) | F.rlike(name, F.lit(FLAGS + r"\(\s*VIA\b[^)]*$"))


def is_time(value: Column) -> Column:
    """H:MM:SS, the hours unbounded by the day."""
    return F.rlike(value, F.lit(r"^\d{1,2}:[0-5]\d:[0-5]\d$"))


def seconds(value: Column) -> Column:
    """A feed's time in seconds since its day began, past 24 hours too; null if it is malformed."""
    p = F.split(value, ":")
    return F.when(is_time(value), F.get(p, F.lit(0)).try_cast("int") * 3600 + F.get(p, F.lit(1)).try_cast("int") * 60 + F.get(p, F.lit(2)).try_cast("int"))
