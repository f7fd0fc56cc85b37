"""Text columns: clean-up, hashes, title tokens, URL canonical form, timestamps."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# They decide hashes, tokens and keys, so they must equal the published behaviour.
TRACKING_PARAMS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term", "fbclid", "gclid", "ref",
)
PUBLISHER_ENTITIES = ("ap", "associated press", "bloomberg", "morning bid", "reuters")
BROAD_ENTITIES = (
    "euro", "euro (eur)", "federal reserve", "global markets", "investors", "japanese yen",
    "japanese yen (jpy)", "markets", "tech giants", "united states", "us dollar", "us dollar (usd)",
)
TITLE_STOPWORDS = (
    "after", "again", "amid", "annual", "brief", "could", "exclusive", "from", "have", "into",
    "market", "markets", "more", "over", "plan", "plans", "report", "reports", "says", "source",
    "than", "that", "their", "with",
    "bloomberg", "reuters", "cnbc", "nikkei", "nytimes",
    "trong", "triệu", "đồng", "nghìn", "ngày", "được", "không", "những", "người", "cũng", "việc",
    "theo", "tăng", "giảm", "thấp", "nhất", "cùng", "trên", "dưới", "trước", "khoảng", "nước",
    "tiếp", "tục",
)
SUFFIX_PATTERN = r"\s*[-|–—]\s*(reuters|ap|associated press|bloomberg(?:\.com)?|bloomberg news|financial times|ft\.com|cnbc|cnn|the wall street journal|wsj|the new york times|new york times|nytimes|the economist|nikkei asia|nikkei|business live)\s*$"

# RFC 3986 appendix B; groups 2 scheme, 4 authority, 5 path, 7 query.
URL_PATTERN = r"^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?"

# Unicode blanks as an explicit class, which matches faster than a Unicode-aware \\s.
BLANKS = "\\s\\x1C-\\x1F\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
# Characters outside this set may change under NFKC; rows without any of them never leave the JVM.
NFKC_SAFE = (
    "\\x00-\\x7F\\u00C0-\\u0131\\u0134-\\u013E\\u0141-\\u0148\\u014A-\\u017E"
    "\\u01A0\\u01A1\\u01AF\\u01B0\\u1EA0-\\u1EF9\\u2013\\u2014\\u2018\\u2019\\u201C\\u201D\\u20AC"
)
# The same as patterns. The part before && is a test of one or two ranges that most characters fail; a class of many ranges is slow.
BLANK = f"[[\\x00-\\x20\\x85-\\u3000]&&[{BLANKS}]]"
UNSAFE = f"[[^\\x00-\\x7F]&&[^{NFKC_SAFE}]]"


def _each(values: pa.Array, clean: Callable[[str], str]) -> pa.Array:
    """``clean`` of every value that is there; one text at a time is a Python string, the rest stays in Arrow."""
    made = pa.array((None if v is None else clean(v) for v in (value.as_py() for value in values)), pa.string())
    pa.default_memory_pool().release_unused()
    return made


def _unescaped(value: str) -> str:
    return unicodedata.normalize("NFKC", html.unescape(value))


@F.arrow_udf(T.StringType())
def _unescape_once(values: pa.Array) -> pa.Array:
    return _each(values, _unescaped)


@F.arrow_udf(T.StringType())
def _unescape_thrice(values: pa.Array) -> pa.Array:
    return _each(values, lambda v: _unescaped(html.unescape(html.unescape(v))))


def literals(values: Sequence[str]) -> Column:
    """A constant array column."""
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def unescape_nfkc(c: Column, *, passes: int = 1) -> Column:
    """HTML-unescape and NFKC; only rows that can change are sent to Python."""
    # plain ASCII is told by its byte length, before any pattern runs
    touched = (F.contains(c, F.lit("&")) & c.rlike("&[#a-zA-Z]")) | (
        (F.length(c) != F.octet_length(c)) & c.rlike(UNSAFE))
    convert = _unescape_once if passes == 1 else _unescape_thrice
    return F.coalesce(convert(F.when(touched, c)), c)


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, f"{BLANK}+", " "))


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", " ")


def normalize_text(c: Column) -> Column:
    """Unescape, NFKC, drop tags, squeeze blanks; null becomes the empty string."""
    return F.coalesce(squeeze(strip_tags(unescape_nfkc(c))), F.lit(""))


def clean_feed_text(c: Column) -> Column:
    """Feed variant: up to three unescape passes, script and style bodies removed."""
    text = F.regexp_replace(unescape_nfkc(c, passes=3), r"(?is)<(script|style).*?</\1>", " ")
    return F.coalesce(squeeze(strip_tags(text)), F.lit(""))


def casefold(c: Column) -> Column:
    """Lower case plus the two full foldings that news text meets."""
    return F.replace(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def folded_hash(normalized: Column) -> Column:
    return F.sha2(casefold(normalized), 256)


def _url_part(url: Column, group: int) -> Column:
    return F.regexp_extract(F.trim(url), URL_PATTERN, group)


def url_scheme(url: Column) -> Column:
    return F.lower(_url_part(url, 2))


def url_host(url: Column) -> Column:
    return F.lower(_url_part(url, 4))


def url_path(url: Column) -> Column:
    return _url_part(url, 5)


def url_query(url: Column) -> Column:
    return _url_part(url, 7)


def _decode(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), c)


def _encode(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_url(url: Column, tracking_params: Sequence[str] = TRACKING_PARAMS) -> Column:
    """Scheme and host lowered, tracking parameters dropped, the rest sorted, no fragment."""
    pieces = F.filter(F.split(url_query(url), "&"), lambda p: p != "")
    pairs = F.transform(
        pieces,
        lambda p: F.struct(
            _decode(F.substring_index(p, "=", 1)).alias("k"),
            F.when(F.contains(p, F.lit("=")), _decode(F.regexp_replace(p, "^[^=]*=", "")))
            .otherwise(F.lit("")).alias("v"),
        ),
    )
    kept = F.array_sort(F.filter(pairs, lambda p: ~F.array_contains(literals(tracking_params), F.lower(p["k"]))))
    query = F.array_join(F.transform(kept, lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"]))), "&")
    host, path = url_host(url), url_path(url)
    return F.concat(
        F.coalesce(F.nullif(url_scheme(url), F.lit("")), F.lit("https")), F.lit("://"), host,
        F.when(path == "", F.lit("/")).otherwise(path),
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")),
    )


def page_key(url: Column) -> Column:
    """Scheme, host and path without the trailing slash: the identity of a source page."""
    path = F.regexp_replace(url_path(url), "/+$", "")
    return F.concat(url_scheme(url), F.lit("://"), url_host(url), F.when(path == "", F.lit("/")).otherwise(path))


def parse_datetime(c: Column) -> Column:
    """ISO (with Z or an offset) or RFC 2822 text to UTC wall time; null when neither parses."""
    text = F.regexp_replace(F.trim(c), r"^[A-Za-z]{3},\s*", "")
    iso = F.regexp_replace(F.regexp_replace(text, r"^(\d{4}-\d{2}-\d{2})[ T]", "$1 "), "Z$", "+00:00")
    zone = F.regexp_extract(iso, r"([+-]\d{2}:?\d{2})$", 1)
    iso_wall = F.regexp_replace(iso, r"\s*[+-]\d{2}:?\d{2}$", "")
    is_iso = text.rlike(r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?\s*(Z|[+-]\d{2}:?\d{2})?$")
    rfc = F.regexp_replace(text, r"\s+(GMT|UTC|UT|Z)$", " +0000")
    rfc_zone = F.regexp_extract(rfc, r"([+-]\d{4})$", 1)
    rfc_wall = F.regexp_replace(rfc, r"\s*[+-]\d{4}$", "")
    is_rfc = text.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}(:\d{2})?\s*([+-]\d{4}|GMT|UTC|UT|Z)?$")
    wall = F.when(is_iso, iso_wall.try_cast("timestamp_ntz"))
    rfc_ts = F.coalesce(
        F.try_to_timestamp(rfc_wall, F.lit("d MMM yyyy HH:mm:ss")), F.try_to_timestamp(rfc_wall, F.lit("d MMM yyyy HH:mm")),
    ).cast("timestamp_ntz")
    return F.when(is_iso, _shift(wall, zone)).when(is_rfc, _shift(rfc_ts, rfc_zone))


def _shift(wall: Column, zone: Column) -> Column:
    digits = F.regexp_replace(zone, "[^0-9]", "")
    minutes = F.when(zone == "", F.lit(0)).otherwise(
        F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int"))
    signed = F.when(F.startswith(zone, F.lit("-")), -minutes).otherwise(minutes)
    return wall - F.make_dt_interval(F.lit(0), F.lit(0), signed)


def clean_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(title, "(?iu)" + SUFFIX_PATTERN, ""))


def title_tokens(title: Column) -> Column:
    """Distinct topical tokens of a title, sorted."""
    words = F.regexp_extract_all(casefold(clean_title(title)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    long_words = F.filter(words, lambda w: F.length(w) > 3)
    return F.array_sort(F.array_except(F.array_distinct(long_words), literals(TITLE_STOPWORDS)))


def folded_set(values: Column) -> Column:
    """Case-folded distinct non-empty values, sorted."""
    return F.array_sort(F.array_distinct(
        F.transform(F.filter(values, lambda v: v.isNotNull() & (v != "")), casefold)))


def specific_entities(values: Column) -> Column:
    return F.array_except(folded_set(values), literals(PUBLISHER_ENTITIES + BROAD_ENTITIES))


def broad_entities(values: Column) -> Column:
    return F.array_intersect(folded_set(values), literals(BROAD_ENTITIES))


def word_tokens(text: Column) -> Column:
    """Distinct maximal runs of word characters of case-folded text."""
    return F.array_distinct(F.regexp_extract_all(casefold(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))


def whole_token_pattern(term: Column) -> Column:
    """Pattern for a case-folded term not touching other word characters."""
    return F.concat(F.lit(r"(?<![\p{L}\p{N}_])"),
                    F.regexp_replace(term, r"([^\p{L}\p{N}_])", r"\\$1"), F.lit(r"(?![\p{L}\p{N}_])"))


def contains_any(text: Column, patterns: Sequence[str]) -> Column:
    """Case-insensitive substring test against a configured list."""
    hit = F.lit(False)
    folded = casefold(F.coalesce(text, F.lit("")))
    for pattern in patterns:
        if pattern:
            hit = hit | F.contains(folded, F.lit(pattern.lower()))
    return hit
