"""Text normalisers as Column functions (survey F1-F16)."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Endings that mark a legal form, as single tokens and as they are written.
LEGAL_TOKENS = ("inc", "llc", "corp", "corporation", "co", "company", "ltd", "lp", "llp", "pllc")
LEGAL_WRITTEN = ("inc", "inc.", "llc", "l.l.c.", "corp", "corp.", "corporation", "co", "co.", "company", "ltd", "ltd.", "lp", "l.p.", "llp", "l.l.p.", "pllc", "pllc.")
# Words dropped anywhere in a company name.
COMPANY_STOPWORDS = (
    "inc", "inc.", "corp", "corp.", "corporation", "co", "co.", "company", "companies",
    "llc", "lp", "llp", "plc", "ltd", "ltd.", "holdings", "holding", "group", "partners",
    "partner", "ventures", "capital", "fund", "trust", "series", "class", "common", "preferred",
)
# Vote words and their labels.
VOTE_LABELS = {
    "aye": "Aye", "yes": "Aye", "y": "Aye", "no": "No", "nay": "No", "abstain": "Abstain",
    "abstained": "Abstain", "recuse": "Recused", "recused": "Recused", "absent": "Absent", "present": "Present",
}

Text = Column | str


def _c(x: Text) -> Column:
    return F.col(x) if isinstance(x, str) else x


def blank_to_null(x: Text) -> Column:
    return F.when(F.length(F.trim(_c(x))) > 0, _c(x))


def null_to_blank(x: Text) -> Column:
    return F.coalesce(_c(x), F.lit(""))


def collapse(x: Text) -> Column:
    """every stretch of Unicode white space becomes one blank; none at the ends."""
    return F.trim(F.regexp_replace(null_to_blank(x), r"(?U)\s+", " "))


def alnum_key(x: Text) -> Column:
    """lower case, anything but a-z and 0-9 becomes a blank."""
    return F.trim(F.regexp_replace(F.lower(collapse(x)), "[^a-z0-9]+", " "))


def search_key(x: Text) -> Column:
    """as F2, with an ampersand read as the word "and"."""
    spoken = F.replace(F.lower(null_to_blank(x)), F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(spoken, "[^a-z0-9]+", " "))


def company_key(x: Text) -> Column:
    """F3 without legal forms at the end."""
    endings = "|".join(LEGAL_TOKENS)
    return F.trim(F.regexp_replace(search_key(x), rf"(?:(?:^| )(?:{endings}))+$", ""))


def company_core(x: Text) -> Column:
    """F3 without stop words anywhere."""
    words = F.filter(F.split(search_key(x), " "), lambda w: ~w.isin(*COMPANY_STOPWORDS) & (w != ""))
    return F.array_join(words, " ")


def person_token(x: Text) -> Column:
    """collapsed, with hard blanks as blanks."""
    return collapse(F.translate(null_to_blank(x), " ", " "))


def person_letters(x: Text) -> Column:
    """letters only, glyph references such as (cid:3) removed."""
    plain = F.regexp_replace(F.lower(null_to_blank(x)), r"\(cid:\d+\)", "")
    return F.trim(F.regexp_replace(plain, "[^a-z]+", " "))


def person_key(x: Text) -> Column:
    """collapsed and lower-case."""
    return F.lower(collapse(x))


def person_canonical(x: Text) -> Column:
    """lower case, keeping full stop, hyphen and apostrophe inside names."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(person_token(x)), r"[^a-z.'\- ]+", " "), " +", " "))


def last_name(x: Text) -> Column:
    """the last token, empty for an empty name."""
    return F.coalesce(F.element_at(F.split(_c(x), " "), -1), F.lit(""))


def name_variants(x: Text) -> Column:
    """F8: the name as it is and in lower case, the last name, first and last, and "last, first", each once."""
    name = collapse(x)
    parts = F.split(name, " ")
    first, last = F.element_at(parts, 1), F.element_at(parts, -1)
    more = F.array(name, F.lower(name), last, F.concat_ws(" ", first, last), F.concat_ws(", ", last, first))
    return F.when(name == "", F.array().cast("array<string>")).when(F.size(parts) == 1, F.array_distinct(F.array(name, F.lower(name)))).otherwise(F.array_distinct(more))


def contains_name(text: Text, name: Text) -> Column:
    """F8: any variant of the name stands in the text, whatever the case."""
    low = F.lower(null_to_blank(text))
    return F.exists(name_variants(name), lambda v: low.contains(F.lower(v)))


def vote_label(x: Text) -> Column:
    """the label of a vote word, alone or followed by a blank; the text itself otherwise."""
    low = F.lower(collapse(x))
    out = collapse(x)
    for word, label in reversed(VOTE_LABELS.items()):
        out = F.when((low == word) | low.startswith(word + " "), label).otherwise(out)
    return out


def likely_vote_line(x: Text) -> Column:
    """F10"""
    return F.lower(null_to_blank(x)).rlike("aye|no|abstain|absent|recused")


def split_names(x: Text) -> Column:
    """names of a list; counts in parentheses and the word "none" are no names."""
    flat = F.replace(F.regexp_replace(null_to_blank(x), r"\(\d+\)", ""), F.lit(" and "), F.lit(", "))
    trimmed = F.transform(F.split(flat, ","), lambda p: strip_signs(p, r" ,.;"))
    return F.filter(trimmed, lambda p: (p != "") & (F.lower(p) != "none"))


def strip_signs(x: Text, signs: str) -> Column:
    """Removes the given signs and white space at both ends."""
    listed = "".join("\\" + s for s in signs)
    return F.regexp_replace(F.regexp_replace(_c(x), rf"^[\s{listed}]+", ""), rf"[\s{listed}]+$", "")


def split_companies(x: Text) -> Column:
    """parts between commas; a legal form goes back to the part before it."""
    parts = F.filter(F.transform(F.split(null_to_blank(x), ","), lambda p: F.trim(p)), lambda p: p != "")
    whole = F.lit(None).cast("array<string>")

    def add(done: Column, part: Column) -> Column:
        n = F.size(done)
        joined = F.concat(F.slice(done, F.lit(1), n - 1), F.array(F.concat_ws(", ", F.element_at(done, -1), part)))
        return F.when((n > 0) & F.lower(part).isin(*LEGAL_WRITTEN), joined).otherwise(F.concat(done, F.array(part)))

    return F.coalesce(F.aggregate(parts, F.array().cast("array<string>"), add), whole)


def tidy_lines(x: Text) -> Column:
    """F16: line feeds only, at most two in a row, single blanks."""
    lines = F.regexp_replace(F.replace(null_to_blank(x), F.lit("\r"), F.lit("\n")), r"\n{3,}", "\n\n")
    return F.regexp_replace(lines, r"[ \t]+", " ")


def first_nonblank(columns: Iterable[Text]) -> Column:
    """the first of the columns with more than white space, else empty."""
    return F.coalesce(*(F.trim(blank_to_null(c)) for c in columns), F.lit(""))


def hinted_value(columns: list[str]) -> Column:
    """the value of the column whose name holds the longest hint, among those with a value."""
    # Hints in column names, and prefixes of columns to skip.
    hints = ("entity_name", "raw_value", "issuer", "company", "business entity", "investment", "source of income", "source", "asset", "stock", "security", "lender")
    skipped = ("owner_", "filer_", "matched_", "meeting_", "matter_", "politician_")
    ranked = []
    for i, name in enumerate(columns):
        low = name.lower()
        score = max((len(h) for h in hints if h in low), default=0)
        if score and not low.startswith(skipped):
            ranked.append((-score, low != "entity_name", i, name))
    some = [F.when(F.col(f"`{n}`").cast("string") != "", F.col(f"`{n}`").cast("string")) for *_, n in sorted(ranked)]
    return F.coalesce(*some, F.lit(""))


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def ordered_distinct(values: Text, separator: str) -> Column:
    """Distinct values in order of first appearance, joined."""
    return F.array_join(F.array_distinct(_c(values)), separator)
