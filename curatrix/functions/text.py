"""Text, label, date and URL expressions; all stay inside the JVM.

White space in these rules is Unicode white space and the byte-order mark. Missing means null or empty: ``or_else`` is
the fallback used wherever a record offers alternatives.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"(?U)[\s\x{FEFF}]+"
CJK = r"[\x{3400}-\x{9fff}]"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def or_else(*values: Column | str) -> Column:
    """The first value that is neither null nor an empty string."""
    return F.coalesce(*[F.nullif(col(v), F.lit("")) for v in values])


def squeeze(x: Column | str) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(col(x), _SPACE, " "))


def missing_as_null(x: Column | str) -> Column:
    """Null for empty texts and for the words that stand for nothing."""
    y = squeeze(x)
    return F.when(~F.lower(y).isin("", "null", "undefined"), y)


def normal_name(x: Column | str) -> Column:
    """Key of a dimension by name."""
    return F.lower(F.trim(col(x)))


def slug(x: Column | str) -> Column:
    """Lower-case letters and digits, all else as single dashes inside."""
    return F.regexp_replace(F.regexp_replace(F.lower(col(x)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def slug_or_digest(x: Column | str, fallback: Column | str) -> Column:
    """The slug, or where nothing is left of it a digest of the fallback."""
    return F.coalesce(F.nullif(slug(x), F.lit("")), F.substring(F.sha1(col(fallback)), 1, 10))


def split_labels(x: Column | str, separators: str = r"[,，;；|、]") -> Column:
    """Labels of a list in one text: trimmed, none empty, each once, in order."""
    parts = F.transform(F.split(F.coalesce(col(x), F.lit("")), separators), squeeze)
    return F.array_distinct(F.filter(parts, lambda t: t != ""))


def distinct_clean(values: Column | str, limit: int | None = None) -> Column:
    """Array of texts squeezed, none empty, each once in order, at most ``limit``."""
    out = F.array_distinct(F.filter(F.transform(col(values), squeeze), lambda t: t.isNotNull() & (t != "")))
    return F.slice(out, 1, limit) if limit else out


def strip_html(x: Column | str) -> Column:
    """Visible text: scripts, styles, comments and tags out, the five basic entities back, white space squeezed."""
    y = F.regexp_replace(col(x), r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", " ")
    y = F.regexp_replace(y, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        y = F.replace(y, F.lit(entity), F.lit(char))
    return squeeze(y)


def first_match(x: Column | str, pattern: str, group: int = 1) -> Column:
    return F.coalesce(F.regexp_extract(col(x), pattern, group), F.lit(""))


def link_texts(html: Column | str) -> Column:
    """Texts of the anchors, each once."""
    return distinct_clean(F.transform(F.regexp_extract_all(col(html), F.lit(r"(?is)<a\b[^>]*>(.*?)</a>"), F.lit(1)), strip_html))


def link_targets(html: Column | str) -> Column:
    return F.regexp_extract_all(col(html), F.lit(r'(?i)<a\b[^>]*\bhref="([^"]*)"'), F.lit(1))


def attributes(tag: Column | str) -> Column:
    """Map of the quoted attributes of one tag; of a repeated one the first counts."""
    pairs = F.regexp_extract_all(col(tag), F.lit(r'([A-Za-z_:][-A-Za-z0-9_:.]*)\s*=\s*"[^"]*"'), F.lit(0))
    names = F.transform(pairs, lambda p: F.lower(F.regexp_extract(p, r"^([^=\s]+)", 1)))
    both = F.transform(pairs, lambda p: F.struct(F.lower(F.regexp_extract(p, r"^([^=\s]+)", 1)).alias("n"), F.regexp_extract(p, r'"([^"]*)"', 1).alias("v")))
    return F.map_from_entries(F.filter(both, lambda e, i: F.array_position(names, e["n"]) == i + 1))


def host(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))


def last_segment(url: Column | str) -> Column:
    """Last part of the path."""
    path = F.regexp_extract(col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.coalesce(F.element_at(F.when(F.size(parts) > 0, parts), -1), F.lit(""))


def safe_url(url: Column | str) -> Column:
    """Without credentials, query and fragment."""
    return F.regexp_replace(F.regexp_replace(col(url), r"[?#].*$", ""), r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/@]*@", "$1")


def title_and_year(x: Column | str) -> tuple[Column, Column]:
    """``Title (1889)`` as title and year."""
    return F.trim(F.regexp_replace(col(x), r"\s*\(([0-9]{3,4})[^)]*\)\s*$", "")), F.regexp_extract(col(x), r"\(([0-9]{3,4})[^)]*\)\s*$", 1).try_cast("int")


def years(x: Column | str, low: int = 1200, high: int = 2099) -> Column:
    """All stand-alone years of a text within bounds."""
    found = F.transform(F.regexp_extract_all(col(x), F.lit(r"(?<![0-9])([0-9]{4})(?![0-9])"), F.lit(1)), lambda y: y.cast("int"))
    return F.filter(found, lambda y: y.between(low, high))


def decade(year: Column) -> Column:
    """``period-1880s``; null where there is no year."""
    return F.concat(F.lit("period-"), (F.floor(year / 10) * 10).cast("string"), F.lit("s"))


def earliest_decade(x: Column | str) -> Column:
    """The decade of the smallest year in the text."""
    return decade(F.array_min(years(x)))


def first_year(*fields: Column | str) -> Column:
    """The first year from 1000 to 2099 of the first field that has one."""
    return F.coalesce(*[F.element_at(F.when(F.size(y) > 0, y), 1) for y in (years(f, 1000, 2099) for f in fields)])


def dimension(term_id: Column | str) -> Column:
    """The prefix of a term id names its dimension."""
    return F.when(F.instr(col(term_id), "-") > 0, F.substring_index(col(term_id), "-", 1)).otherwise("unknown")


def stable_bucket(identifier: Column | str, buckets: int = 10_000, prefix: str = "fnv1a-v1:") -> Column:
    """FNV-1a over the characters of prefix and id, modulo the number of buckets. Offset basis and prime are fixed
    values of the hash."""
    s = F.concat(F.lit(prefix), col(identifier))
    codes = F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.ascii(F.substr(s, i, F.lit(1))).cast("long"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619)).bitwiseAND(F.lit(4294967295))) % F.lit(buckets)


def unlock_rate(unlocked: Column, active: Column) -> Column:
    """``x.xx%`` of active users; 0.00% where there are none."""
    share = F.when(active > 0, F.least(unlocked, active) * F.lit(100.0) / active).otherwise(0.0)
    return F.format_string("%.2f%%", share)


def sentences(x: Column | str) -> Column:
    """Sentences with their closing mark."""
    return F.filter(F.transform(F.split(col(x), r"(?<=[.!?。！？])\s*"), F.trim), lambda s: s != "")


def redacted(x: Column | str) -> Column:
    """Values behind secret-looking keys and query parameters masked."""
    return F.regexp_replace(col(x), r"(?i)\b(token|secret|password|api_?key|authorization)(\s*[:=]\s*)(\"[^\"]*\"|[^\s&,;\"]+)", "$1$2[redacted]")


#: Words of a licence's name, address or note that restrict use, and that free it.
RESTRICTED = r"all rights reserved|copyrighted|non[^\r\n]?commercial|no derivatives|(?:^|[^0-9a-z_])n[cd](?:$|[^0-9a-z_])"
FREE = r"public domain|(?:^|[^0-9a-z_])pd[-_ ]|cc0|creative commons[^\r\n]*(?:by|zero)|creativecommons\.org/(?:licenses/by|publicdomain)"


def licence_status(*parts: Column | str) -> Column:
    """blocked, open or unknown by the licence's name, address and note; restrictions win."""
    y = F.lower(F.concat_ws(" ", *[F.coalesce(col(x), F.lit("")) for x in parts]))
    return F.when(y.rlike(RESTRICTED), "blocked").when(y.rlike(FREE), "open").otherwise("unknown")


#: Fixed value: characters that matching ignores.
SEPARATORS = r"[·\s\-_\u3000,，.。'’\"“”()（）:：/\\\[\]【】《》<>]"


def search_text(x: Column | str) -> Column:
    """For matching: lower case, separators and brackets out."""
    return F.regexp_replace(F.lower(F.trim(col(x))), SEPARATORS, "")


def latin_prefixes(x: Column | str, longest: int = 12) -> Column:
    """For an index: of each Latin word its beginnings of 1 to ``longest`` letters, and itself."""
    words = F.regexp_extract_all(F.lower(col(x)), F.lit("[0-9a-z]+"), F.lit(0))
    return F.flatten(F.transform(words, lambda w: F.concat(F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.length(w))), lambda i: F.substr(w, F.lit(1), i)), F.array(w))))


def cjk_grams(x: Column | str, widest: int = 3) -> Column:
    """For an index: all pieces of 1 to ``widest`` characters of runs of Chinese characters."""
    runs = F.regexp_extract_all(col(x), F.lit(CJK + "+"), F.lit(0))

    def of_width(w: Column, n: int) -> Column:
        return F.when(F.length(w) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: F.substr(w, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(runs, lambda w: F.flatten(F.array(*[of_width(w, n) for n in range(1, widest + 1)]))))


def index_terms(*fields: Column | str, limit: int = 900) -> Column:
    """Index terms of the fields in order, each once, the first ``limit``."""
    parts = [f(F.coalesce(col(x), F.lit(""))) for x in fields for f in (cjk_grams, latin_prefixes)]
    return F.slice(F.array_distinct(F.flatten(F.array(*parts))), 1, limit)


def query_terms(x: Column | str, limit: int = 24) -> Column:
    """Terms of a query: Latin words; Chinese runs of up to 3 characters, longer ones as pieces of 3."""
    y = F.lower(col(x))
    runs = F.regexp_extract_all(y, F.lit(CJK + "+"), F.lit(0))
    pieces = F.flatten(F.transform(runs, lambda w: F.when(F.length(w) <= 3, F.array(w)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 2, F.lit(1))), lambda i: F.substr(w, i, F.lit(3))))))
    words = F.regexp_extract_all(y, F.lit("[0-9a-z]+"), F.lit(0))
    return F.slice(F.array_distinct(F.concat(pieces, words)), 1, limit)


def similarity(a: Column | str, b: Column | str) -> Column:
    """1 less the edit distance over the longer length, four decimals; 0 where both are empty."""
    longest = F.greatest(F.length(col(a)), F.length(col(b)))
    return F.when(longest > 0, F.round(1 - F.levenshtein(col(a), col(b)) / longest, 4)).otherwise(0.0)


#: Fixed value: nationalities that a creator's name may carry.
NATIONALITIES = "italian|french|dutch|flemish|american|spanish|german|austrian|english|british|japanese|russian"


def folded(x: Column | str) -> Column:
    """Without diacritics. Texts of ASCII alone stay in the JVM."""
    from curatrix.functions.unicode import without_diacritics

    y = col(x)
    return F.when(y.rlike(r"[^\x00-\x7F]"), without_diacritics(y)).otherwise(y)


def plain_artist(x: Column | str) -> Column:
    """A creator's name for comparing: no diacritics, brackets, nationalities, years or punctuation, in lower case."""
    y = F.regexp_replace(folded(x), r"\([^)]*\)", " ")
    y = F.regexp_replace(y, rf"(?i)\b(?:{NATIONALITIES})\b", " ")
    y = F.regexp_replace(y, r"\b[0-9]{3,4}\s*[-–]\s*[0-9]{0,4}\b", " ")
    return F.lower(F.trim(F.regexp_replace(y, "[^A-Za-z0-9]+", " ")))


def dedupe_title(x: Column | str) -> Column:
    """A title without diacritics, brackets, English articles and punctuation."""
    y = F.regexp_replace(F.lower(folded(x)), r"\([^)]*\)", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(y, r"\b(the|a|an)\b", " "), "[^a-z0-9]+", " "))


def dedupe_artist(x: Column | str) -> Column:
    """A name of one line without years; a Chinese name with its Latin form in brackets counts as that form."""
    y = col(x)
    latin = F.filter(F.regexp_extract_all(y, F.lit("[（(]([^）)]+)[）)]"), F.lit(1)), lambda p: p.rlike("[A-Za-z]{2}"))
    name = F.when(y.rlike(CJK) & (F.size(latin) > 0), F.element_at(F.when(F.size(latin) > 0, latin), 1)).otherwise(F.regexp_extract(y, r"^[^\r\n]*", 0))
    name = F.regexp_replace(name, r"(?s)[，,]\s*[0-9]{3,4}.*$", "")
    return plain_artist(F.regexp_replace(name, r"\b[0-9]{3,4}\s*[-–—]\s*[0-9]{0,4}\b", ""))


def dedupe_key(title: Column | str, artist: Column | str) -> Column:
    """Artist and title joined; empty where either is."""
    a, t = dedupe_artist(artist), dedupe_title(title)
    return F.when((a != "") & (t != ""), F.concat_ws("|", a, t)).otherwise("")


def fingerprint(*parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(col(p).cast("string"), F.lit("")) for p in parts]), 256)


def document_id(*parts: Column | str) -> Column:
    """Key of a per-user document: its parts under a separator that none can hold, digested to 48 digits."""
    return F.substring(F.sha2(F.concat_ws("\u0000", *[col(p).cast("string") for p in parts]), 256), 1, 48)


def same_set(a: Column | str, b: Column | str) -> Column:
    """Whether two arrays hold the same values, in any order and number."""
    return F.array_sort(F.array_distinct(col(a))).eqNullSafe(F.array_sort(F.array_distinct(col(b))))


def relation_role(x: Column | str) -> Column:
    """What a creator's text says of the relation to the work."""
    y = F.lower(F.trim(col(x)))
    rules = (("after ", "after"), ("workshop of |studio of ", "workshop"), ("circle of ", "circle"), ("follower of ", "follower"), ("attributed to ", "attributed"), ("school of ", "school"), ("unknown|anonymous", "unknown"))
    out = None
    for pattern, role in rules:
        out = F.when(y.rlike(f"^(?:{pattern})"), role) if out is None else out.when(y.rlike(f"^(?:{pattern})"), role)
    return out.otherwise("creator")
