"""Scalar text functions, all as built-in column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that never name a subject.
STOPWORDS = "a an the is are was were be been being to of in on at for with by from as this that these those it its we our you and or but not no".split()

# Ordered rules that replace what varies in an error text.
ERROR_RULES = (
    (r"\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?", "<TS>"),
    (r"\b\d{2}:\d{2}:\d{2}(?:[.,]\d+)?\b", "<TIME>"),
    (r"/(?:private/)?(?:tmp|var/folders)/[^\s:,)\"']*", "<TMP>"),
    (r"(?i)\bC:\\\\(?:Users|Windows)\\\\Temp\\\\[^\s:,)\"']*", "<TMP>"),
    (r"(?:/[\w.\-+@]+){2,}/([\w.\-+@]+)", "<PATH>/$1"),
    (r"(?i)\b[A-Z]:\\\\(?:[\w.\-+@]+\\\\)+([\w.\-+@]+)", "<PATH>/$1"),
    (r"\b0x[0-9a-fA-F]{4,}\b", "<ADDR>"),
    (r"\b[0-9a-f]{32,64}\b", "<HASH>"),
    (r"\b[0-9a-f]{7,12}\b(?=\s|$|[).,])", "<SHORTHASH>"),
    (r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "<UUID>"),
    (r"\b[0-7][0-9A-HJKMNP-TV-Z]{25}\b", "<ULID>"),
    (r"(?i)\bline\s+\d+", "line <N>"),
    (r":\d+:\d+\b", ":<N>:<N>"),
    (r"(?i)\b(?:pid|process)\s*[:=]?\s*\d+", "pid <N>"),
    (r"(?i)\bport\s*[:=]?\s*\d{2,5}", "port <N>"),
    (r"\b(?:127\.0\.0\.1|localhost|0\.0\.0\.0):\d{2,5}\b", "<HOSTPORT>"),
    (r"\b\d+(?:\.\d+)?\s*(?:ms|s|sec|secs|seconds|m|min|mins|h|hrs)\b", "<DUR>"),
    (r"\b\d+(?:\.\d+)?\s*(?:B|KB|MB|GB|KiB|MiB|GiB)\b", "<SIZE>"),
    (r"\b\d{2,}\b", "<N>"),
    (r"\s+", " "),
)


#: Word characters, digits and white space of all scripts.
UNICODE = "(?U)"
# Lines without identity, lines that declare an error, lines that mention one, and the length of a fingerprint.
NOISE_LINE = r"^\s*(?:\.{3}|=+|-+|\*+|#+|\[\s*\]|Traceback \(most recent call last\):?)\s*$"
STRONG_ERROR = (
    r"^(?:E\s+)?(?:(?i:\[?[a-z_.]{0,64}(?:error|exception|panic|fault)\w{0,64}\]?)\s*(?:\[[^\]]{0,256}\])?\s*:"
    r"|(?i:fatal|panic|abort|segmentation fault)\b|[A-Z][a-z0-9]{0,64}(?:[A-Z][a-z0-9]{0,64}){1,32}\s*:)"
)
WEAK_ERROR = r"(?i)\b(?:error|exception|failed|failure|assert|fatal|panic|cannot|unable|refused|denied|timeout|not found|no such)\b"
FINGERPRINT_CHARS = 400
#: Lower-case letters with marks (Latin, Greek, Cyrillic) and the letters without.
MARKED = "".join(c for c in map(chr, (*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000))) if c == c.lower() and len(unicodedata.normalize("NFD", c)) > 1)
PLAIN = "".join(unicodedata.normalize("NFD", c)[0] for c in MARKED)
# Words that no query term is, and the bounds of a query.
QUERY_STOPWORDS = "a an the is are was were be been to of in on at for with by from this that these those it its and or not near".split()
QUERY_CHARS, QUERY_TERMS, TERM_CHARS = 4096, 32, 64


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_error(text: Column | str) -> Column:
    """The shape of an error text: what varies between runs becomes a placeholder."""
    out = _col(text)
    for pattern, to in ERROR_RULES:
        out = F.regexp_replace(out, UNICODE + pattern, to)
    return F.lower(F.trim(out))


def normalize_command(text: Column | str) -> Column:
    """Temporary paths and white space made equal; flags and case stay."""
    return F.trim(F.regexp_replace(F.regexp_replace(_col(text), r"/(?:private/)?(?:tmp|var/folders)/[^\s]*", "<TMP>"), r"\s+", " "))


def failure_signature(command: Column | str, kind: Column | str, error: Column | str | None = None) -> Column:
    err = F.lit("") if error is None else normalize_error(error)
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit("cmd="), normalize_command(command), F.lit("\nkind="), _col(kind), F.lit("\nerr="), err), 256))


def subject_key(text: Column | str, terms: int = 8) -> Column:
    """The first distinct terms, sorted: lower case, no stopwords, short words only if there are no others."""
    words = F.filter(F.regexp_extract_all(F.lower(_col(text)), F.lit("[a-z0-9]+"), 0), lambda w: ~w.isin(STOPWORDS))
    # One-element arrays name the words and the long words, so that neither is made twice.
    chosen = F.transform(F.array(words), lambda every: F.transform(F.array(F.filter(every, lambda w: F.length(w) > 2)), lambda some: F.when(F.size(some) > 0, some).otherwise(every))[0])[0]
    return F.array_join(F.slice(F.array_sort(F.array_distinct(F.slice(chosen, 1, 3 * terms))), 1, terms), " ")


def without_accents(text: Column) -> Column:
    """Latin letters without their marks."""
    return F.regexp_replace(F.translate(text, MARKED, PLAIN), r"\p{M}+", "")


def index_tokens(text: Column | str) -> Column:
    """Runs of letters and digits, lower case, without accents."""
    return F.regexp_extract_all(without_accents(F.lower(_col(text))), F.lit(r"[\p{L}\p{N}]+"), 0)


def query_terms(text: Column | str) -> Column:
    """Search terms of a text by anyone: nothing of a query language survives."""
    terms = F.regexp_extract_all(F.substring(_col(text), 1, QUERY_CHARS), F.lit(r"[A-Za-z0-9][A-Za-z0-9._\-/:+]*"), 0)
    terms = F.transform(terms, lambda t: F.substring(t, 1, TERM_CHARS))
    return F.slice(F.filter(terms, lambda t: ~F.lower(t).isin(QUERY_STOPWORDS)), 1, QUERY_TERMS)


def fingerprint(error: Column | str) -> Column:
    """The line that tells an error best: one that declares it, else one that mentions it, else the first."""
    lines = F.filter(F.transform(F.split(_col(error), r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(UNICODE + NOISE_LINE))

    def first(pattern: str) -> Column:
        return F.get(F.filter(lines, lambda x: x.rlike(UNICODE + pattern)), F.lit(0))

    return F.coalesce(F.substring(F.coalesce(first(STRONG_ERROR), first(WEAK_ERROR), F.get(lines, F.lit(0))), 1, FINGERPRINT_CHARS), F.lit(""))


def sentence(text: Column) -> Column:
    """A fragment with an end, so that more sentences can follow."""
    t = F.trim(text)
    return F.when((t == "") | t.rlike(r"[.!?:;]$"), t).otherwise(F.concat(t, F.lit(".")))


def gotcha_text(command: Column, kind: Column, excerpt: Column, branch: Column) -> Column:
    """What failed, where and how, in sentences."""
    head = F.concat_ws(" ", F.concat(F.lit("`"), F.trim(command), F.lit("` failed")), F.when(kind != "", F.concat(F.lit("("), kind, F.lit(")"))), F.when(branch != "", F.concat(F.lit("on branch "), branch)))
    first = sentence(fingerprint(excerpt))
    return F.concat(head, F.lit("."), F.when(first != "", F.concat(F.lit(" "), first)).otherwise(F.lit("")))


def repeated_text(text: Column, occurrences: Column) -> Column:
    """A failure's text after so many failures: each repeat has added its sentence."""
    more = F.when(occurrences >= 2, F.transform(F.sequence(F.lit(2), occurrences.cast("int")), lambda n: F.concat(F.lit("This has now failed "), F.when(n == 2, "twice").otherwise(F.concat(n.cast("string"), F.lit(" times"))), F.lit("."))))
    return F.when(occurrences >= 2, F.substring(F.concat_ws(" ", sentence(text), F.array_join(more, " ")), 1, 8192)).otherwise(text)


def resolution_summary(command: Column, failed: Column, note: Column, commit: Column, when: Column, branch: Column) -> Column:
    """What resolved a failure, in one clause."""
    c = F.coalesce(F.trim(command), F.lit(""))
    head = F.when((c != "") & (normalize_command(c) != normalize_command(failed)), c).when(c != "", "the same command passed").otherwise(F.coalesce(F.trim(note), F.lit("")))
    at = F.when(commit != "", F.substring(commit, 1, 12))
    landed = F.concat(F.lit("work landed"), F.when(branch != "", F.concat(F.lit(" on "), branch)).otherwise(F.lit("")), F.lit(" as commit "), at)
    return (
        F.when(head == "", F.coalesce(landed, F.lit("")))
        .when(at.isNotNull(), F.concat(head, F.lit(" after commit "), at))
        .when(when != "", F.concat(head, F.lit(", recorded "), when))
        .otherwise(head)
    )


def provenance_line(verification: Column, command: Column, review: Column, landed: Column, commit: Column, occurrences: Column) -> Column:
    """Evidence of a record in one line."""
    named = F.coalesce(command, F.lit("")) != ""
    ran = F.when(verification == "passed", F.when(named, F.concat(F.lit("verified by `"), command, F.lit("`"))).otherwise(F.lit("verification passed"))).when(
        verification == "failed", F.when(named, F.concat(F.lit("failed `"), command, F.lit("`"))).otherwise(F.lit("verification failed"))
    )
    seen = F.when(review == "approved", "approved in independent review").when(review == "rejected", "rejected in review")
    sha = F.coalesce(F.substring(commit, 1, 12), F.lit(""))
    came = F.when(landed, F.when(sha != "", F.concat(F.lit("landed in "), sha)).otherwise(F.lit("landed in history")))
    return F.concat_ws("; ", ran, seen, came, F.when(occurrences > 1, F.concat(F.lit("seen "), occurrences.cast("string"), F.lit(" times"))))


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits, joined and framed by spaces, so that whole words can be looked for."""
    return F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0), " "), F.lit(" "))


def one_line(text: Column, limit: int) -> Column:
    t = F.trim(F.regexp_replace(text, UNICODE + r"\s+", " "))
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit - 1), F.lit("\u2026"))).otherwise(t)


def trust_label(state: Column) -> Column:
    return (
        F.when(state == "integrated", "VERIFIED+LANDED").when(state == "quarantined", "QUARANTINED/UNTRUSTED").otherwise(F.upper(state))
    )


def tokens_estimate(text: Column) -> Column:
    """About so many tokens: four characters each, rounded up."""
    return F.ceil(F.length(text) / 4)
