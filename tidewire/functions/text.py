"""Titles, similarities, digits, replacement characters, grounding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire import values

#: White space as a browser's engine sees it.
SPACE = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def any_of(conditions: list[Column]) -> Column:
    """Disjunction; false for none."""
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def normalize_title(title: Column) -> Column:
    """Bracketed labels, white space and punctuation go; lower case."""
    out = F.regexp_replace(F.coalesce(title, F.lit("")), r"【[^】]*】", "")
    out = F.regexp_replace(out, r"\[[^\]]*\]", "")
    out = F.regexp_replace(out, SPACE, "")
    out = F.regexp_replace(out, r"[|｜·—～~\-，。；：、！？“”‘’《》〈〉「」『』()（）\[\]{}<>/.,;:!?\"']", "")
    return F.lower(out)


def dedupable(normalized: Column) -> Column:
    """Long enough to be compared as a whole."""
    return F.length(normalized) >= 8


def normalize_event(name: Column) -> Column:
    """Lower case without white space and punctuation; symbols stay."""
    return F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[\s\x{3000}\p{P}]", "")


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring code points."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1))), lambda i: F.substr(text, i, F.lit(2))))


def dice(a: Column, b: Column) -> Column:
    """Dice similarity of bigram sets; below two code points equality."""
    x, y = bigrams(a), bigrams(b)
    return F.when((F.length(a) < 2) | (F.length(b) < 2), (a == b).cast("double")).otherwise(2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y)))


def numbers(text: Column) -> Column:
    """Sorted distinct runs of digits."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"[0-9]+"), F.lit(0))))


def digits_conflict(a: Column, b: Column) -> Column:
    """Both have numbers, and not the same ones."""
    x, y = numbers(a), numbers(b)
    return (F.size(x) > 0) & (F.size(y) > 0) & (x != y)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def replaced_ratio(text: Column) -> Column:
    """Share of U+FFFD; 0 for empty texts."""
    bad = F.length(text) - F.length(F.replace(text, F.lit("�"), F.lit("")))
    return F.coalesce(bad / F.nullif(F.length(text), F.lit(0)), F.lit(0.0))


def replaced_percent(text: Column) -> Column:
    """Percentage of U+FFFD; 100 for empty or missing texts."""
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(100.0)).otherwise(replaced_ratio(text) * 100)


def squash(text: Column) -> Column:
    """Without white space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def verify_quote(quote: Column, content: Column) -> Column:
    """The quote without quotation marks if it is 8 to 120 long and stands in the content, else empty."""
    bare = F.regexp_replace(F.trim(F.coalesce(quote, F.lit(""))), '^["“”「『]+|["“”」』]+$', "")
    ok = F.length(bare).between(8, 120) & (F.instr(squash(content), squash(bare)) > 0)
    return F.when(ok, bare).otherwise("")


def key_points(points: Column) -> Column:
    """At most four, of at most 80 code points, without blanks."""
    return F.slice(F.transform(F.filter(points, lambda p: F.trim(p) != ""), lambda p: F.substring(F.trim(p), 1, 80)), 1, 4)


def hard_tokens(text: Column, stopwords: list[str]) -> Column:
    """Numbers, quoted names and proper nouns of two or more code points."""
    number = F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9.])[0-9][0-9,]*(?:\.[0-9]+)?(?:\s*(?:%|billion|million|GB|TB|ms))?"), F.lit(0))
    quoted = F.regexp_extract_all(text, F.lit("[「『“《〈]([^」』”》〉]{2,30})[」』”》〉]"), F.lit(1))
    nouns = F.filter(F.regexp_extract_all(text, F.lit(r"[A-Za-z][A-Za-z0-9]*(?:[-_.][A-Za-z0-9]+)*"), F.lit(0)), lambda w: w.rlike("[A-Z]") & ~F.upper(w).isin(stopwords))
    return F.array_distinct(F.filter(F.transform(F.concat(number, quoted, nouns), lambda t: F.lower(F.regexp_replace(t, r"\s", ""))), lambda t: F.length(t) >= 2))


def grounded(assertion: Column, body: Column, stopwords: list[str]) -> Column:
    """Every hard token of the assertion stands in the body."""
    seen = F.lower(squash(body))
    # the body is bound outside the inner lambda, so that it is squashed once and not for each token
    return F.transform(F.array(seen), lambda b: F.forall(hard_tokens(assertion, stopwords), lambda t: F.instr(b, t) > 0))[0]


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"^{SPACE}+|{SPACE}+$", "")


def readable(text: Column) -> Column:
    """The lines that are neither blank nor short navigation."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), strip)
    return F.array_join(F.filter(lines, lambda x: (x != "") & ~((F.length(x) <= values.NAVIGATION_LINE) & x.rlike(values.NAVIGATION))), "\n")


def is_shell(text: Column, least: int = values.LEAST_MATERIAL) -> Column:
    """A page shell: blank, an HTTP error text, a strong marker anywhere, a weak one on a short line, or too little to read.

    Each of them decides alone.
    """
    whole = F.coalesce(text, F.lit(""))
    strong = any_of([F.contains(whole, F.lit(m)) for m in values.SHELL_STRONG])
    weak = F.exists(F.split(whole, "\n"), lambda x: (F.length(strip(x)) <= values.SHELL_LINE) & any_of([F.contains(x, F.lit(m)) for m in values.SHELL_WEAK]))
    return (strip(whole) == "") | any_of([whole.rlike(p) for p in values.SHELL_PATTERNS]) | strong | weak | (F.length(readable(whole)) < least)


def pick_material(content: Column, snippet: Column, title: Column, least: int = values.LEAST_MATERIAL) -> Column:
    """(from, text) of what a summary may be made of: the content, else a snippet that does not just stand for the title.

    A snippet stands for the title if it equals it, or if it is short and one of them holds the other.
    """
    fits = lambda c: (F.length(c) >= least) & ~is_shell(c, least)
    bare, name = strip(snippet), strip(title)
    holds = F.contains(bare, name) | F.contains(name, bare)
    placeholder = (bare == name) | (name != "") & (F.length(bare) < values.TRUSTED_SNIPPET) & holds
    whole = lambda kind, c: F.struct(F.lit(kind).alias("from"), c.alias("text"))
    return F.when(fits(content), whole("content", content)).when(fits(bare) & ~placeholder, whole("snippet", bare))


def is_incident(title: Column, snippet: Column, source: Column) -> Column:
    """A trigger, and an organisation as a word or a source that only reports such things."""
    text = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(snippet, F.lit("")))
    escape = lambda w: "".join("\\" + c if c in ".*+?^${}()|[]\\-" else c for c in w)
    trigger = text.rlike("(?i)" + "|".join(map(escape, values.INCIDENT_TRIGGERS)))
    org = text.rlike("(?i)(?<![A-Za-z0-9_])(" + "|".join(map(escape, values.INCIDENT_ORGS)) + ")(?![A-Za-z0-9_])")
    return trigger & (org | F.coalesce(source.isin(values.INCIDENT_SOURCES), F.lit(False)))


def is_roundup(title: Column, snippet: Column, official: Column) -> Column:
    """Several events in one piece: separators or a column's name in the title, and something to split."""
    marks = F.length(title) - F.length(F.regexp_replace(title, "[；;｜|]", ""))
    named = title.rlike(values.ROUNDUP_COLUMN) & (F.length(title) >= 12)
    return ~official & (F.length(F.trim(snippet)) >= 200) & (((marks >= 1) & (F.length(title) >= 20)) | named)


def service_failure(reason: Column) -> Column:
    """The reason names a failure of the model service; case-sensitive."""
    return any_of([F.contains(F.coalesce(reason, F.lit("")), F.lit(p)) for p in values.SERVICE_FAILURES])


def reason_class(reason: Column) -> Column:
    """quality or fetch."""
    return F.when(F.coalesce(reason, F.lit("")).rlike(values.QUALITY_REASON), "quality").otherwise("fetch")


def intro(text: Column) -> Column:
    """Without quotation marks; null below 40; above 180 cut behind the last sentence that ends in 40 to 180."""
    bare = F.regexp_replace(F.trim(text), '^["“”「]+|["“”」]+$', "")
    cut = F.regexp_extract(bare, "(?s)^(.{39,179}[。！？])", 1)
    return F.when(F.length(bare) < 40, F.lit(None)).when(F.length(bare) <= 180, bare).otherwise(F.when(cut != "", cut).otherwise(F.substring(bare, 1, 180)))


def first_sentence(text: Column, most: int = 60) -> Column:
    """Up to the first full stop."""
    return F.substring(F.split(text, "[。！.!]")[0], 1, most)


def subjects(title: Column, roster: dict[str, list[str]] | None = None) -> Column:
    """Names of the roster whose patterns stand in the title; none recognised is an abstention."""
    border = lambda p: p.replace(r"\b", "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))")
    known = (roster or values.SUBJECTS).items()
    found = F.array(*[F.when(title.rlike("(?i)" + "|".join(map(border, patterns))), name) for name, patterns in known])
    return F.filter(found, lambda x: x.isNotNull())


def same_story(a: Column, b: Column) -> Column:
    """A proposed pair stands unless both titles have subjects and share none, or their numbers conflict."""
    x, y = subjects(a), subjects(b)
    return ~((F.size(x) > 0) & (F.size(y) > 0) & ~F.arrays_overlap(x, y)) & ~digits_conflict(a, b)
