"""Column functions for subtitle and document text: mark-up, white space, character sets, tokens and numbers.

Classes are spelled out since Java's \\w, \\d and \\s are ASCII: words are letters, numbers and _, digits Nd.
All of them are null for null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"\p{L}\p{N}_"
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
WAVE = "〜"
NUM = "<num>"
#: Digits, and digits raised, lowered, circled, bracketed or with a full stop.
DIGIT = r"\p{Nd}\x{2070}\x{B9}\x{B2}\x{B3}\x{2074}-\x{2079}\x{2080}-\x{2089}\x{2460}-\x{2473}\x{24EA}\x{24F5}-\x{24FD}\x{24FF}\x{2776}-\x{277F}\x{2474}-\x{249B}\x{1F100}"
LETTERS = rf"[{WORD}&&[^{DIGIT}]]"
#: ASCII that begins no token goes first and Latin letters apart: Java tests each range of the long classes in turn.
TOKEN = rf"(?![\x00-&(-,./:-@\[-\x5E`{{-\x7F])(?:(?:[a-zA-Z_]++|[{WAVE}{WORD}&&[^{DIGIT}]]++)++|['\-]|[{DIGIT}]++)"
HAS_DIGIT = rf"[0-9]|(?![\x00-\x7F])[{DIGIT}]"

_HAN = r"\x{2E80}-\x{2FD5}\x{F900}-\x{FA6A}\x{4E00}-\x{9FCB}\x{3400}-\x{4DB5}"
_WIDE = r"\x{FF01}-\x{FF5E}\x{3000}-\x{303F}"
CHARSETS = {
    "en": r"\x20-\x7E",
    "latin": r"\x20-\x7E\x{300}-\x{30F}\x{A0}-\x{24F}",
    "zh": rf"\x20{_HAN}{_WIDE}",
    "ja": rf"\x20{_HAN}{_WIDE}\x{{30A0}}-\x{{30FF}}\x{{3041}}-\x{{3096}}\x{{3280}}-\x{{337F}}\x{{3220}}-\x{{3243}}\x{{31F0}}-\x{{31FF}}\x{{FF5F}}-\x{{FF9F}}",
}


def tilde_map(text: Column) -> Column:
    """Full-width tilde becomes the wave dash."""
    return F.translate(text, "～", WAVE)


def normalize_space(text: Column) -> Column:
    return F.regexp_replace(text, SPACE + "+", " ")


def newline_conversion(text: Column) -> Column:
    """A single line feed becomes a blank, a run of two or more one line feed."""
    return F.regexp_replace(F.regexp_replace(text, r"(?<!\n)\n(?!\n)", " "), r"\n{2,}", "\n")


_STAMP = r"(?:\d{2,}:)?\d{2}:\d{2}\.\d{3}"


def strip_cue_tags(text: Column) -> Column:
    """Class, voice, language and time tags of cues go; their content stays."""
    return F.regexp_replace(text, rf"<[bciu](?:\.[^\s&<>.]*)*>|<{_STAMP}>|<(?:lang|v)(?:\.[^\s&<>.]*)*[ \t][^<>]+>|</(?:lang|[bcivu])>", "")


def strip_ruby(text: Column) -> Column:
    """The base text of ruby stays; readings and their brackets go, inside ruby or out.

    Pieces outside <ruby> lose whole <rp> and <rt> elements. Inside, elements without nested tags and <rb> tags go.
    """
    body = lambda m: F.regexp_replace(m, r"<r(?:p>[^<]*</rp|t(?: [^>]+)?>[^<]*</rt)>|</?rb>", "")
    pieces = F.split(F.regexp_replace(text, r"(<ruby(?: [^>]+)?>.*?</ruby>)", "\u0001$1\u0001"), "\u0001")
    inner = lambda p: body(F.regexp_extract(p, r"^<ruby(?: [^>]+)?>(.*?)</ruby>$", 1))
    outer = lambda p: F.regexp_replace(p, r"<rp(?: [^>]+)?>.*?</rp>|<rt(?: [^>]+)?>.*?</rt>", "")
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(r"^<ruby(?: [^>]+)?>.*</ruby>$"), inner(p)).otherwise(outer(p))), "")


def decode_entities(text: Column) -> Column:
    """The six entities of cues; the ampersand comes last so that nothing is decoded twice."""
    for name, to in (("lt", "<"), ("gt", ">"), ("nbsp", " "), ("lrm", "‎"), ("rlm", "‏"), ("amp", "&")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(to))
    return text


INVALID_TAG = r"</?(?:font|FONT|[biu])>|<(?:font|FONT|[biu]) [^>]*>|\[br\]"


def count_invalid_tags(text: Column) -> Column:
    return F.regexp_count(text, F.lit(INVALID_TAG))


def strip_invalid_tags(text: Column) -> Column:
    return F.regexp_replace(text, INVALID_TAG, "")


def markup_to_text(text: Column) -> Column:
    return decode_entities(strip_ruby(strip_cue_tags(text)))


def chars_in(text: Column, charset: str) -> Column:
    """Number of characters of the language's set."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[{CHARSETS.get(charset, CHARSETS['latin'])}]+", ""))


def tokens(text: Column) -> Column:
    """Runs of letters, single ' or -, and each run of digits as <num>; the rest is left out."""
    return F.transform(matches(text), as_token)


def matches(text: Column) -> Column:
    """The tokens as they stand, digits too; with as_token on the exploded rows, which runs compiled there, the same as tokens."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def as_token(t: Column) -> Column:
    return F.when((t >= "A") & (t < "{"), t).when(t.rlike(rf"^[{DIGIT}]"), F.lit(NUM)).otherwise(t)  # most start with a Latin letter


def replace_numbers(toks: Column) -> Column:
    """Digit runs within tokens become <num>; a <num> right after another is dropped, also across tokens. Empty tokens stay and part numbers."""
    mark = "\u0001"
    pieces = F.flatten(F.transform(toks, lambda t: F.when(~t.rlike(HAS_DIGIT), F.array(t)).otherwise(
        F.filter(F.split(F.regexp_replace(t, rf"[{DIGIT}]+", f"{mark}{NUM}{mark}"), mark), lambda p: p != ""))))
    # zipped with itself one place on; a literal <num> piece can't arise otherwise, since < is no digit
    before = F.concat(F.array(F.lit("")), F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))))
    once = F.zip_with(pieces, before, lambda p, q: F.when((p == NUM) & (q == NUM), F.lit(None)).otherwise(p))
    return F.filter(F.when(F.size(pieces) > 0, once).otherwise(pieces), lambda p: p.isNotNull())


def replace_tagged_numbers(toks: Column) -> Column:
    """The same for an array of struct(token, pos): pieces keep the token's part of speech, <num> gets NUM."""
    mark = "\u0001"
    pieces = F.flatten(F.transform(toks, lambda t: F.transform(F.when(~t["token"].rlike(HAS_DIGIT), F.array(t["token"])).otherwise(  # most hold none
        F.filter(F.split(F.regexp_replace(t["token"], rf"[{DIGIT}]+", f"{mark}{NUM}{mark}"), mark), lambda p: p != "")),
        lambda p: F.struct(p.alias("token"), F.when(p == NUM, F.lit("NUM")).otherwise(t["pos"]).alias("pos")))))
    before = F.concat(F.array(F.lit("")), F.transform(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: p["token"]))
    once = F.zip_with(pieces, before, lambda p, q: F.when(~((p["token"] == NUM) & (q == NUM)), p))
    some = F.array_join(toks.getField("token"), " ").rlike(f"{HAS_DIGIT}|{NUM}")  # else all stay as they are
    return F.when(some, F.filter(F.when(F.size(pieces) > 0, once).otherwise(pieces), lambda p: p.isNotNull())).otherwise(toks)


def is_word(token: Column) -> Column:
    """Relaxed word filter: no digit, and at least one word character or brace."""
    return ~token.rlike(r"\p{Nd}") & token.rlike(rf"[{WORD}{{}}]")


def split_words(text: Column) -> Column:
    """Pre-tokenised text: split at white space, without empty ends."""
    return F.filter(F.split(text, SPACE + "+"), lambda t: t != "")


def lookup_split(text: Column) -> Column:
    """Split at runs of other than word characters, or digits; empty tokens stay."""
    return F.split(text, rf"(?:[^{WORD}]|\p{{Nd}})+")


def cue_prefix(text: Column) -> Column:
    """The first words of a cue, at most 16 characters; null without words."""
    got = F.regexp_extract(text, rf"[{WORD}]{{1,6}}[^{WORD}]{{1,2}}[{WORD}]{{1,6}}|[{WORD}]+", 0)
    return F.when(got != "", F.substring(got, 1, 16))
