"""Text functions as Spark columns; all run in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as trimmed from Markdown fragments (Unicode).
_TRIM = r"(?U)^\s+|\s+$"

#: Words that topic terms leave out (those of fewer than four letters are never terms).
TOPIC_STOPWORDS = (
    "with this that from they will have been more when what your which their said each into also used some there then "
    "than very just only over after before about like does would could should same both"
).split()


def let(value: Column, body) -> Column:
    """body(value) with `value` computed once a row: inside a lambda, an expression of the row that the
    optimizer has put in would be computed again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, _TRIM, "")


def _accents() -> tuple[str, str]:
    """Accented Latin letters (U+00C0 to U+024F) that decompose to one base letter and marks."""
    letters, bases = [], []
    for code in range(0xC0, 0x250):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and parts[0].isascii():
            letters.append(chr(code))
            bases.append(parts[0])
    return "".join(letters), "".join(bases)


ACCENTED, UNACCENTED = _accents()


def search_tokens(text: Column) -> Column:
    """Full-text tokens: lower case, accents removed, runs of letters and digits."""
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), ACCENTED, UNACCENTED)
    return F.regexp_extract_all(plain, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def plain_token(word: str) -> list[str]:
    """The same tokens of a query word, on the driver."""
    table = str.maketrans(ACCENTED, UNACCENTED)
    out, now = [], ""
    for ch in word.lower().translate(table) + " ":
        if unicodedata.category(ch)[0] in "LN":
            now += ch
        elif now:
            out.append(now)
            now = ""
    return out


def topic_tokens(text: Column) -> Column:
    """Topic terms: runs of letters of the lower-cased text, of at least four bytes, no stop word."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{L}+"), F.lit(0))
    return F.filter(runs, lambda w: (F.octet_length(w) >= 4) & ~w.isin(TOPIC_STOPWORDS))


def counted(tokens: Column) -> Column:
    """How often each token stands in a row's array, as (term, n): a sort of the row, nothing is shuffled."""

    def runs(t: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (F.get(t, i) != F.get(t, i - 1)))
        return let(starts, lambda s: F.transform(s, lambda i, k: F.struct(F.get(t, i).alias("term"), (F.coalesce(F.get(s, k + 1), F.size(t)) - i).cast("long").alias("n"))))

    none = F.expr("cast(array() as array<struct<term: string, n: bigint>>)")
    return let(F.sort_array(tokens), lambda t: F.when(F.size(t) > 0, runs(t)).otherwise(none))


def query_terms(text: str) -> list[str]:
    """Lower-cased words of a query, split at white space."""
    return text.lower().split()


def token_estimate(text: Column) -> Column:
    """A quarter of the bytes, rounded up."""
    return F.floor((F.octet_length(text) + 3) / 4).cast("int")


def checksum(content: Column) -> Column:
    return F.sha2(content, 256)


def first_bytes(text: Column, n: int) -> Column:
    """At most n bytes of UTF-8; a character that the cut would split is left out."""
    data = F.encode(text, "UTF-8")
    cuts = [F.substring(data, 1, n - i).cast("string") for i in range(4)]
    return F.when(F.octet_length(text) <= n, text).otherwise(F.coalesce(*(F.when(F.is_valid_utf8(c), c) for c in cuts)))


def path_group(path: Column) -> Column:
    """The first directory, or `root`."""
    return F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1)).otherwise("root")


def title_from_filename(path: Column) -> Column:
    """Base name without extension; - and _ become blanks; first letters upper case, the rest as is."""
    base = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    words = F.filter(F.split(F.translate(base, "-_", "  "), r"(?U)\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), " ")


def normal_path(path: Column) -> Column:
    """Lexically clean path: no `.`, no empty segments, `..` resolved as far as segments go."""
    rooted = path.startswith("/")
    parts = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))

    def fold(stack: Column, segment: Column) -> Column:
        top = F.try_element_at(stack, F.lit(-1))
        pops = (segment == "..") & top.isNotNull() & (top != "..")
        dropped = (segment == "..") & top.isNull() & rooted
        return F.when(pops, F.slice(stack, F.lit(1), F.size(stack) - 1)).when(dropped, stack).otherwise(F.concat(stack, F.array(segment)))

    joined = F.array_join(F.aggregate(parts, F.expr("cast(array() as array<string>)"), fold), "/")
    return F.when(rooted, F.concat(F.lit("/"), joined)).when(joined == "", ".").otherwise(joined)


def resolved_link(path: Column, link: Column) -> Column:
    """A link relative to the file that holds it, as a path from the root; kept as it is where it
    resolves to the root itself."""
    folder = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    to = normal_path(F.concat_ws("/", F.when(folder != "", folder), link))
    return F.when(to == ".", link).otherwise(to)


def days_ago(now: int, seconds: Column) -> Column:
    """Whole days, towards zero."""
    return ((F.lit(now) - seconds) / 86400).cast("long")


def namespace_of(path: Column, namespaces: dict[str, list[str]], default: str = "") -> Column:
    """By configured path prefixes, the longest first; else the default."""
    pairs = sorted(((p.strip("/"), ns) for ns, ps in namespaces.items() for p in ps), key=lambda x: (-len(x[0]), x))
    out = F.lit(default)
    for prefix, ns in reversed(pairs):
        fits = F.lit(True) if prefix in ("", ".") else (path == prefix) | path.startswith(prefix + "/")
        out = F.when(fits, ns).otherwise(out)
    return out


def readable_size(n: int) -> str:
    for unit, size in (("GB", 1 << 30), ("MB", 1 << 20), ("KB", 1 << 10)):
        if n >= size:
            return f"{n / size:.1f} {unit}"
    return f"{n} B"
