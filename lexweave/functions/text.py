"""Text helpers as Column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it and the four separators of ASCII, spelt out for engines that differ in ``\\s``.
SPACE = r"\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without leading and trailing Unicode whitespace."""
    return F.regexp_replace(col(c), rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def normalize_ws(c: Column | str) -> Column:
    """One newline form, runs of blanks as one space, at most one empty line in a row, stripped."""
    x = F.regexp_replace(col(c), r"\r\n?", "\n")
    x = F.regexp_replace(x, r"[ \t]+", " ")
    return strip(F.regexp_replace(x, r"\n{3,}", "\n\n"))


def collapse_ws(c: Column | str) -> Column:
    """``normalize_ws`` after cutting blanks at each line's end."""
    return normalize_ws(F.regexp_replace(F.regexp_replace(col(c), r"\r\n?", "\n"), r"[ \t]+(?=\n|\z)", ""))


def search_tokens(c: Column | str) -> Column:
    """Lower-cased search tokens: single CJK ideographs, Latin words, digit runs."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit(r"[一-鿿]|[a-zA-Z]+|[0-9]+"), F.lit(0))


def canonical_key(c: Column | str) -> Column:
    """An id without surrounding whitespace, in lower case."""
    return F.lower(strip(c))


def words_only(c: Column | str) -> Column:
    """Without page marks and every character that is no letter, digit or underscore (C20)."""
    x = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"—[\s]*[0-9]+[\s]*—", "")
    return F.regexp_replace(x, r"[^\p{L}\p{M}\p{N}_]", "")


def sentences(c: Column | str) -> Column:
    """Non-empty word-only parts between sentence marks."""
    return F.filter(F.transform(F.split(col(c), r"[。；;：:!！？?]"), words_only), lambda s: s != "")


def normalize_date(c: Column | str) -> Column:
    """``YYYY-MM-DD`` of the first date in one of four forms, null where the month or day is out of range."""
    x = strip(c)
    forms = (r"^(\d{4})年(\d{1,2})月(\d{1,2})日", r"^(\d{4})-(\d{1,2})-(\d{1,2})", r"^(\d{4})/(\d{1,2})/(\d{1,2})", r"^(\d{4})\.(\d{1,2})\.(\d{1,2})")
    out = F.lit(None).cast("string")
    for form in reversed(forms):
        y, m, d = (F.regexp_extract(x, form, k) for k in (1, 2, 3))
        month, day = m.try_cast("int"), d.try_cast("int")
        most = F.when(month == 2, 29).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
        date = F.when(month.between(1, 12) & (day >= 1) & (day <= most), F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")))
        out = F.when(x.rlike(form), date).otherwise(out)
    return out


def normalize_document_number(c: Column | str) -> Column:
    """Without whitespace, long dashes as hyphens."""
    return F.translate(F.regexp_replace(col(c), rf"[{SPACE}]+", ""), "—－–", "---")


def chunk_id(sha: Column, document_id: Column, index: Column, start: Column, end: Column) -> Column:
    """Deterministic 32-digit id of a chunk."""
    return F.substring(F.sha2(F.concat_ws("|", F.lit("CMCV1"), sha, document_id, index.cast("string"), start.cast("string"), end.cast("string")), 256), 1, 32)


def parent_id(identity: Column, index: Column, path: Column) -> Column:
    """Deterministic id of a parent section (C11)."""
    return F.sha2(F.concat_ws("|", identity, index.cast("string"), F.array_join(path, "|")), 256)


def document_identity(document_id: Column, suffix: Column, sha: Column) -> Column:
    """Logical id, format suffix and content hash of one document version."""
    return F.concat(document_id, suffix, F.lit("@sha256:"), sha)


def cache_key(question: Column) -> Column:
    """Stable short key of a question (C14)."""
    return F.substring(F.sha1(strip(question)), 1, 16)


def micros(c: Column | str) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, whatever the session's zone."""
    x = col(c).cast("timestamp_ntz")
    seconds = F.hour(x) * 3600 + F.minute(x) * 60
    return (F.unix_date(x.cast("date")).cast("long") * 86400 + seconds.cast("long")) * 1000000 + (F.date_part(F.lit("SECOND"), x) * 1000000).cast("long")


def markdown_table(headers: Column, rows: Column) -> Column:
    """A Markdown table of an array of headers and an array of rows of strings."""
    cell = lambda x: F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), r"\|", r"\\|"), "\n", "<br>")
    line = lambda xs: F.concat(F.lit("| "), F.array_join(F.transform(xs, cell), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(headers, lambda h: F.repeat(F.lit("-"), F.greatest(F.lit(3), F.length(cell(h))))), " | "), F.lit(" |"))
    return F.array_join(F.concat(F.array(line(headers), rule), F.transform(rows, line)), "\n")


def numeric_cell(c: Column | str) -> Column:
    """Whether a table cell is a number, with thousands marks, percent, currency or unit."""
    x = F.translate(strip(c), "０１２３４５６７８９．，％", "0123456789.,%")
    return x.rlike(r"^[¥￥$€]?\s*[-+]?(\d{1,3}(,\d{3})+|\d+)(\.\d+)?\s*(%|元|万元|亿元|万|亿|人|个|件|项|年|月|日|天)?$")
