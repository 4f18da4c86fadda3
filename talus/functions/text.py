"""Text functions as columns; no Python runs in them, but in `fnv32_of`."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\t\n\x0B\f\r ]+"
# Accented letters and their plain forms.
ACCENTED = "ÀÁÂÃÄÅàáâãäåÈÉÊËèéêëÌÍÎÏìíîïÒÓÔÕÖòóôõöÙÚÛÜùúûüÑñÇç"
PLAIN = "AAAAAAaaaaaaEEEEeeeeIIIIiiiiOOOOOoooooUUUUuuuuNnCc"
# Named character references that text extraction decodes, the ampersand's last.
ENTITIES = (
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&ndash;", "–"), ("&mdash;", "—"), ("&hellip;", "…"),
    ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&ldquo;", "“"), ("&rdquo;", "”"), ("&bull;", "•"), ("&middot;", "·"), ("&copy;", "©"), ("&reg;", "®"), ("&trade;", "™"),
    ("&laquo;", "«"), ("&raquo;", "»"), ("&times;", "×"), ("&deg;", "°"), ("&euro;", "€"), ("&pound;", "£"), ("&sect;", "§"), ("&amp;", "&"),
)
#: What first tells of a failure in an output.
FAILURE = r"(?i)error|fail|panic|exception|fatal|warn"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def token_estimate(text: Column, chars_per_token: float = 4.0) -> Column:
    """Bytes outside white space plus the number of fields, over the rate; cut, at least 1; 0 for the empty text."""
    packed = F.regexp_replace(text, SPACE, "")
    fields = F.size(F.filter(F.split(text, SPACE), lambda w: w != ""))
    n = ((F.octet_length(packed) + fields) * (1.0 / chars_per_token)).cast("int")
    return F.when(text == "", 0).otherwise(F.greatest(n, F.lit(1)))


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def fit_lossless(text: Column) -> Column:
    """The text without repeats of whole lines; the first of each stays in place."""
    return F.array_join(F.array_distinct(lines(text)), "\n")


def html_to_text(html: Column) -> Column:
    """Scripts, styles and comments out, block tags to line ends, other tags to spaces, character
    references decoded, spaces collapsed."""
    out = F.regexp_replace(html, r"(?is)<(script|style|noscript|template)[^>]*>.*?</(script|style|noscript|template)>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|header|footer|title)[^>]*>", "\n")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    numbers = F.array_distinct(F.regexp_extract_all(out, F.lit(r"&#(x?[0-9a-fA-F]{1,6});"), F.lit(1)))
    code = lambda n: F.when(n.startswith("x"), F.conv(F.substr(n, F.lit(2)), 16, 10)).otherwise(F.regexp_extract(n, "^[0-9]+$", 0)).cast("int")
    char = lambda n: F.decode(F.unhex(F.lpad(F.hex(code(n)), 8, "0")), "UTF-32")
    valid = lambda n: code(n).between(1, 0xD7FF) | code(n).between(0xE000, 0x10FFFF)
    out = F.aggregate(F.filter(numbers, valid), out, lambda t, n: F.replace(t, F.concat(F.lit("&#"), n, F.lit(";")), char(n)))
    for name, char_ in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char_))
    out = F.regexp_replace(out, r"[ \t\r]+", " ")
    return F.regexp_replace(F.regexp_replace(out, r" ?\n[ \n]*", "\n"), r"^[ \n]+|[ \n]+$", "")


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def identifier_segments(name: Column) -> Column:
    """Lower-case segments of an identifier: at case changes, digits and separators;
    2 to 32 characters, not all digits, without repeats, at most 12."""
    cut = F.regexp_replace(name, r"([\p{Ll}\p{Nd}])(\p{Lu})", "$1 $2")
    cut = F.regexp_replace(cut, r"(\p{Lu})(\p{Lu}\p{Ll})", "$1 $2")
    words = F.array_distinct(F.split(F.lower(F.regexp_replace(cut, r"[^\p{L}\p{Nd}]+", " ")), " +"))
    return F.slice(F.filter(words, lambda w: F.length(w).between(2, 32) & ~w.rlike("^[0-9]+$")), 1, 12)


def strip_diacritics(text: Column) -> Column:
    return F.lower(F.translate(text, ACCENTED, PLAIN))


def query_words(text: Column) -> Column:
    """The distinct words of a question, cut at case changes too, plain and in lower case."""
    cut = F.regexp_replace(text, r"([\p{Ll}\p{Nd}])(\p{Lu})", "$1 $2")
    cut = F.regexp_replace(cut, r"(\p{Lu})(\p{Lu}\p{Ll})", "$1 $2")
    return F.array_distinct(F.filter(F.split(strip_diacritics(F.regexp_replace(cut, r"[^\p{L}\p{Nd}]+", " ")), " +"), lambda w: w != ""))


def plural_variants(word: Column) -> Column:
    """The word and its singular forms: -xes, -shes, -sses, -zzes lose two letters; -ches, -ses, -zes,
    -oes two or one; other -s, but not -ss, one. Four letters at least stay."""
    two, one = F.left(word, F.length(word) - 2), F.left(word, F.length(word) - 1)
    n = F.length(word)
    none = F.expr("cast(array() as array<string>)")
    if2, if1 = F.when(n >= 6, F.array(two)).otherwise(none), F.when(n >= 5, F.array(one)).otherwise(none)
    more = F.when(word.rlike("(xes|shes|sses|zzes)$"), if2).when(word.rlike("(ches|ses|zes|oes)$"), F.concat(if2, if1)).when(word.rlike("[^s]s$"), if1).otherwise(none)
    return F.array_distinct(F.concat(F.array(word), more))


def first_failure(text: Column) -> Column:
    """The first line that tells of a failure, else null."""
    return F.try_element_at(F.filter(lines(text), lambda x: x.rlike(FAILURE)), F.lit(1))


def fnv32(text: Column) -> Column:
    """FNV-1a over UTF-8 bytes."""
    codes = F.transform(F.split(F.hex(F.encode(text, "utf-8")), "(?<=\\G..)"), lambda x: F.conv(x, 16, 10).cast("long"))
    codes = F.filter(codes, lambda x: x.isNotNull())
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, b: ((h.bitwiseXOR(b)) * 16777619).bitwiseAND(4294967295))


def fnv32_of(texts: pa.Array) -> np.ndarray:
    """The same of an Arrow array of texts without nulls, all at once; long texts one by one."""
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    wide = pa.types.is_large_string(texts.type)
    ends = np.frombuffer(texts.buffers()[1] or b"\0" * 8, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    start, size = ends[:-1], np.diff(ends)
    out = np.full(len(texts), 2166136261, np.uint64)
    live = np.flatnonzero((size > 0) & (size <= 256))
    k = 0
    while len(live):
        out[live] = ((out[live] ^ data[start[live] + k]) * np.uint64(16777619)) & np.uint64(4294967295)
        k += 1
        live = live[size[live] > k]
    for j in np.flatnonzero(size > 256):
        h = 2166136261
        for b in data[start[j] : start[j] + size[j]].tobytes():
            h = ((h ^ b) * 16777619) & 4294967295
        out[j] = h
    return out
