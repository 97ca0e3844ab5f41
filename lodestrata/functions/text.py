"""Text functions as column expressions: tokens, shingles, normal forms, splits, scrubs, scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Separator characters, content-word stop words, query stop words.
SEPARATORS = "|-:+_=*~.–—─━"
CONTENT_STOP_WORDS = (
    "and are but for from have into not the that this with you your their there then than was were will would could should about which"
).split()
QUERY_STOP_WORDS = "a an and are as at be by do for from how in is it its of on or that the this to was what when where which who why with".split()


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_separator_only(text: Column | str) -> Column:
    """Blank, or nothing but separator characters and spaces; null counts as blank."""
    t = F.coalesce(as_column(text), F.lit(""))
    return (F.trim(t) == "") | t.rlike(r"^[\s|\-:+_=*~.–—─━]*$")


def words(text: Column | str) -> Column:
    """Lower-case ASCII words of a letter and letters or digits, in order."""
    return F.regexp_extract_all(F.lower(as_column(text)), F.lit("[a-z][a-z0-9]*"), 0)


def content_words(text: Column | str) -> Column:
    """Letter-led words of three characters or more, outer quotes and dashes stripped, stop words dropped."""
    found = F.regexp_extract_all(F.lower(as_column(text)), F.lit("[a-z][a-z0-9_'-]{2,}"), 0)
    bare = F.transform(found, lambda w: F.regexp_replace(w, "^['_-]+|['_-]+$", ""))
    return F.filter(bare, lambda w: (w != "") & ~w.isin(CONTENT_STOP_WORDS))


def shingles(tokens: Column, k: int) -> Column:
    """Distinct k-grams joined by a space; fewer tokens than k give none."""
    def of(w):
        made = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, k), " "))
        return F.when(F.size(w) >= k, F.array_distinct(made)).otherwise(F.array().cast("array<string>"))

    return F.transform(F.array(tokens), of)[0]  # bound once, not evaluated anew for each place


def shingle_hashes(tokens: Column, k: int) -> Column:
    """64-bit hashes of the k-grams, one for each place; fewer tokens than k give none."""

    def of(h):
        made = F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - k, F.lit(0))), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))
        return F.when(F.size(h) >= k, made).otherwise(F.array().cast("array<bigint>"))

    return F.transform(F.array(F.transform(tokens, lambda w: F.xxhash64(w))), of)[0]  # bound once


def ngram_terms(tokens: Column, most: int = 3, cap: int = 12, stop: tuple = tuple(QUERY_STOP_WORDS)) -> Column:
    """N-grams from the longest, none that begins or ends with a stop word, distinct, at most ``cap``."""
    def grams(n):
        made = F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.slice(tokens, i, n))
        good = F.filter(made, lambda g: ~g[0].isin(*stop) & ~F.element_at(g, -1).isin(*stop))
        return F.when(F.size(tokens) >= n, F.transform(good, lambda g: F.array_join(g, " "))).otherwise(F.array().cast("array<string>"))

    return F.slice(F.array_distinct(F.concat(*[grams(n) for n in range(most, 0, -1)])), 1, cap)


def query_terms(text: Column | str) -> Column:
    return F.array_distinct(F.filter(words(text), lambda w: ~w.isin(QUERY_STOP_WORDS)))


def squash(name: Column | str) -> Column:
    return F.regexp_replace(F.lower(as_column(name)), r"[\s_\-]+", "")


def snake(name: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(as_column(name))), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def slug(name: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(as_column(name))), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def alias_variants(name: Column | str, cap: int = 5) -> Column:
    """Sorted distinct lower-case spellings with blanks as _ or -, and - or _ as blanks, other than the lower-cased name itself."""
    n = F.lower(F.trim(F.regexp_replace(as_column(name), r"\s+", " ")))
    made = F.array(F.replace(n, F.lit(" "), F.lit("_")), F.replace(n, F.lit(" "), F.lit("-")), F.replace(n, F.lit("-"), F.lit(" ")), F.replace(n, F.lit("_"), F.lit(" ")))
    return F.slice(F.array_sort(F.filter(F.array_distinct(made), lambda x: (x != n) & (x != ""))), 1, cap)


# Markup patterns and what replaces them, in order.
SCRUB = (
    (r"(?s)<!--.*?-->", " "),
    (r"(?is)<script\b.*?</script>", " "),
    (r"(?is)<style\b.*?</style>", " "),
    (r"<[^>]+>", " "),
    (r"!\[[^\]]*\]\([^)]*\)", " "),
    (r"\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"&nbsp;", " "),
    (r"&amp;", "&"),
    (r"&lt;", "<"),
    (r"&gt;", ">"),
    (r"[ \t]+", " "),
)


def scrub_markup(text: Column | str) -> Column:
    """Comments, scripts, styles, tags, images, links and entities out; runs of blanks and lines collapsed."""
    t = reduce(lambda c, p: F.regexp_replace(c, *p), SCRUB, as_column(text))
    return F.trim(F.regexp_replace(F.regexp_replace(t, " *\n *", "\n"), "\n{2,}", "\n"))


def sentences(text: Column | str) -> Column:
    """Lines first, then a cut after . ! or ? and blanks; heading lines (#) and empty pieces dropped."""
    lines = F.filter(F.split(as_column(text), "\n"), lambda x: ~F.ltrim(x).startswith("#"))
    cut = F.transform(lines, lambda x: F.split(F.regexp_replace(x, r"([.!?])\s+", "$1␞"), "␞"))
    return F.filter(F.transform(F.flatten(cut), lambda s: F.trim(s)), lambda s: s != "")


# What a heading of each kind begins with, and what it is as a whole.
HEADING_BEGINS = {
    "bibliography": ("bibliography", "bibliographies", "works cited", "work cited", "citation", "citations", "further reading", "reference", "references"),
    "toc": ("contents", "table of contents", "list of figures", "list of tables", "list of illustrations", "list of abbreviations"),
    "index": ("index", "subject index", "name index"),
    "appendix": ("appendix", "appendices"),
    "front_matter": (
        "copyright", "colophon", "imprint", "preface", "foreword", "prologue", "dedication", "epigraph", "acknowledgment", "acknowledgments", "acknowledgement", "acknowledgements",
        "about the author", "about the authors", "about the editor", "about the editors", "about the contributor", "about the contributors",
        "about author", "about authors", "about editor", "about editors", "about contributor", "about contributors",
    ),
    "back_matter": (
        "glossary", "errata", "endnote", "endnotes", "epilogue", "afterword", "postscript", "coda", "code bundle", "color images", "colour images", "colored images", "coloured images",
        "download the example", "download the code", "download the color", "download the colour", "why subscribe", "share your thoughts", "leave a review", "get in touch",
    ),
}
HEADING_IS = {"back_matter": ("note", "notes")}
#: Headings that begin like a kind but are of none.
HEADING_NOT = ("reference to", "references to")
NOISY_KINDS = ("toc", "bibliography", "index", "appendix", "front_matter", "back_matter", "links")
SUMMARY_KINDS = ("body", "table")


def plain_heading(heading: Column) -> Column:
    """Lower case, single blanks, without ``[]{...}`` or ``{...}`` anchors before it and ``{...}`` attributes behind it."""
    bare = F.regexp_replace(F.regexp_replace(heading, r"^\s*(\[\])?\{[^}]*\}", ""), r"\{[^}]*\}\s*$", "")
    return F.lower(F.trim(F.regexp_replace(bare, r"\s+", " ")))


def heading_kind(path: Column) -> Column:
    """Kind by the first heading of a path that is not empty: its words begin with, or are, one of a kind's phrases; body without a match."""
    first = F.get(F.filter(F.transform(path, plain_heading), lambda h: h != ""), F.lit(0))
    words = F.concat(F.trim(F.regexp_replace(first, r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    begins = lambda phrases: F.exists(F.array(*[F.lit(f"{p} ") for p in phrases]), lambda p: F.startswith(words, p))
    out = F.lit("body")
    for kind, phrases in reversed(HEADING_BEGINS.items()):
        out = F.when(begins(phrases), kind).otherwise(out)
    for kind, phrases in HEADING_IS.items():
        out = F.when(F.trim(words).isin(*phrases), kind).otherwise(out)
    chat = F.startswith(words, F.lit("join our ")) | F.startswith(words, F.lit("join the "))
    out = F.when(chat & F.contains(F.substring(words, 1, 60), F.lit(" discord ")), "back_matter").otherwise(out)
    return F.when(first.isNull() | begins(HEADING_NOT), "body").otherwise(out)


def content_kind(text: Column | str) -> Column:
    """Kind by the share of lines that look like a contents list, references, links or a table."""
    lines = F.filter(F.split(as_column(text), "\n"), lambda x: F.trim(x) != "")
    share = lambda p: F.size(F.filter(lines, lambda x: x.rlike(p))) / F.size(lines)
    return (
        F.when(F.size(lines) == 0, "body")
        .when(share(r"\.{3,}\s*[0-9]+\s*$") >= 0.4, "toc")
        .when(share(r"^\s*\[[0-9]+\]|\([12][0-9]{3}\)") >= 0.5, "bibliography")
        .when(share(r"https?://") >= 0.6, "links")
        .when(share(r"\|.*\|") >= 0.6, "table")
        .otherwise("body")
    )


def combined_kind(path: Column, text: Column | str) -> Column:
    """The heading decides where it says more than body, else the content."""
    h = heading_kind(path)
    return F.when(h != "body", h).otherwise(content_kind(text))


def is_noisy(kind: Column | str) -> Column:
    return F.coalesce(as_column(kind), F.lit("body")).isin(*NOISY_KINDS)


def skips_extraction(kind: Column | str) -> Column:
    return F.coalesce(as_column(kind), F.lit("body")).isin(*NOISY_KINDS, "code")


def needs_summary(kind: Column | str) -> Column:
    return F.coalesce(as_column(kind), F.lit("body")).isin(*SUMMARY_KINDS)


def is_active(status: Column | str) -> Column:
    return F.coalesce(as_column(status), F.lit("active")) == "active"


def is_report_name(name: Column | str) -> Column:
    """Base names of the pipeline's own reports."""
    return F.regexp_extract(as_column(name), "[^/]+$", 0).rlike(r"(?i)^.*(_receipt|_report|handoff|_audit)[^/]*\.(md|json)$")


def padded(text: Column | str) -> Column:
    """Lower-case runs of letters and digits between single blanks, with a blank at either end: whole words can be looked up."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(as_column(text)), "[^a-z0-9]+", " ")), F.lit(" "))


def scanned(hay: Column | str, heading: Column | str) -> Column:
    """What ``lexical_score`` asks of a row: struct(flat, low, head)."""
    return F.struct(padded(hay).alias("flat"), F.lower(as_column(hay)).alias("low"), padded(heading).alias("head"))


def lexical_score(terms: Column, scan: Column, phrase: Column, held: Column | None = None) -> Column:
    """0 without a whole-word hit, else min(.98, .45 + .35 coverage + .18 phrase + .12 heading), 4 places; ``scan`` is a ``scanned`` row, ``held`` the number of its terms where that is known."""
    hit = lambda c: F.size(F.filter(terms, lambda t: F.contains(c, F.concat(F.lit(" "), t, F.lit(" ")))))
    n = hit(scan["flat"]) if held is None else held
    raw = 0.45 + 0.35 * n / F.greatest(F.size(terms), F.lit(1)) + F.when(F.contains(scan["low"], F.lower(F.trim(phrase))), 0.18).otherwise(0.0) + F.when(hit(scan["head"]) > 0, 0.12).otherwise(0.0)
    return F.when(n > 0, F.round(F.least(F.lit(0.98), raw), 4)).otherwise(0.0)


def fnv1a31(text: Column | str) -> Column:
    """FNV-1a of the UTF-8 bytes, 31 bits: the sparse index's token id."""
    data = F.encode(as_column(text), "UTF-8")
    codes = F.transform(F.sequence(F.lit(1), F.octet_length(data)), lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("long"))
    h = F.aggregate(codes, F.lit(2166136261).cast("long"), lambda a, c: (a.bitwiseXOR(c) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.when(F.octet_length(data) > 0, h.bitwiseAND(F.lit(0x7FFFFFFF))).otherwise(F.lit(2166136261 & 0x7FFFFFFF))


def intent(text: Column | str) -> Column:
    """Query mode by marker words: enumeration, comparison, definition, procedure or lookup."""
    t = F.concat(F.lit(" "), F.lower(as_column(text)), F.lit(" "))
    return (
        F.when(t.rlike(r" (list|enumerate|all the|which ones) "), "enumeration")
        .when(t.rlike(r" (compare|versus|vs|difference between) "), "comparison")
        .when(t.rlike(r" (what is|what are|define|meaning of) "), "definition")
        .when(t.rlike(r" (how to|how do|steps) "), "procedure")
        .otherwise("lookup")
    )


def token_count(text: Column | str) -> Column:
    """Words between blanks: the deterministic stand-in for a model's token count."""
    t = F.trim(F.regexp_replace(F.coalesce(as_column(text), F.lit("")), r"\s+", " "))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " "))).cast("long")


def name_in_text(name: Column, text: Column) -> Column:
    """Token-bounded containment, or containment without separators for names of five characters or more."""
    pad = lambda c: F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")), F.lit(" "))
    tight = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    return pad(text).contains(pad(name)) | ((F.length(tight(name)) >= 5) & tight(text).contains(tight(name)))


def inject_headers(text: Column | str) -> Column:
    """Lines like ``3. Title`` or ``3.1 Title`` become # and ## headings; decimal values do not."""
    def one(x):
        return (
            F.when(x.rlike(r"^[0-9]+\.[0-9]+ [A-Z][a-z]"), F.concat(F.lit("## "), x))
            .when(x.rlike(r"^[0-9]+\. [A-Z][a-z]"), F.concat(F.lit("# "), x))
            .otherwise(x)
        )

    return F.array_join(F.transform(F.split(as_column(text), "\n"), one), "\n")
