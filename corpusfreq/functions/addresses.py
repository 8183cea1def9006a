"""Web and mail addresses, handles, censored words and sound descriptions in subtitles.

One alternation finds them, in this order of preference: [ __ ], bracketed descriptions, web, mail, handle. Repetitions are possessive or bounded, so
that Java's matcher doesn't recurse over long texts.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusfreq.functions.text import WORD

_CJ = r"\x{3041}-\x{3096}\x{30A0}-\x{30FF}\x{31F0}-\x{31FF}\x{3220}-\x{3243}\x{3280}-\x{337F}\x{2E80}-\x{2FD5}\x{3400}-\x{4DB5}\x{4E00}-\x{9FCB}\x{F900}-\x{FA6A}"
#: Country domains by first letter.
_COUNTRIES = "a[c-gilmorstuz] b[ad-hnortwyz] c[acdfhilmnoruxyz] d[ekoz] e[cegstu] f[ijmr] g[aeghlqrst] h[knru] i[delmnoqrst] j[mop] k[eghirwyz] l[abiktuvy] m[adegklmnorstuvxyz] n[acfgilopuz] om p[aefhklmstwy] qa r[eosuw] s[acdeghiknotuvxy] t[chjkmnortvwz] u[agksyz] v[cegn] ws z[amw]"
_LONG = ["com", "net", "org", "info", "edu", "gov", "mil", "dev", "tech", "store", "shop", "site", "pro", "club", "online", "biz", "xyz"]


def _countries() -> list[str]:
    """Two-letter domains from the compact form."""
    out = []
    for item in re.findall(r"[a-z]\[[^\]]+\]|[a-z]{2}", _COUNTRIES):
        if "[" not in item:
            out.append(item)
            continue
        head, body = item[0], item[2:-1].replace(" ", "")
        body = re.sub(r"(.)-(.)", lambda m: "".join(map(chr, range(ord(m[1]), ord(m[2]) + 1))), body)
        out += [head + c for c in body]
    return out


_LOWER = _LONG + _countries()
TLD = (
    rf"(?:(?:{'|'.join(_LOWER)}|{'|'.join(x.upper() for x in _LOWER)})(?![A-Za-z])"
    rf"|(?:日本|コム|公司|网络|台湾|台灣|香港|澳门|澳門|新加坡|中国|中國)(?![{_CJ}]))"
)
HOST = rf"(?!-)(?:[\p{{L}}\p{{N}}\-&&[^{_CJ}]]++|[{_CJ}]++)(?<!-)"
DOMAIN = rf"(?:{HOST}\.){{1,64}}{TLD}"
_IN_PATH = rf"[{WORD}/*@&=+$#~\-]|%[0-9a-fA-F]{{2}}"
PATH = rf"/(?:{_IN_PATH}|[.!?,;:]++(?={_IN_PATH}))*+"
CENSORED = r"\[ __ \]"
DESCRIBED = rf"\[(?=[^\[\]]*[{WORD}♪～])[^\[\].?!．。？！]+\]|【(?=[^【】]*[{WORD}♪～])[^【】.?!．。？！]+】"
WEB = rf"(?:https?://{DOMAIN}(?::[0-9]+)?|{DOMAIN})(?:{PATH})?"
MAIL = rf"[a-zA-Z0-9_.+\-]+@{DOMAIN}"
HANDLE = r"@[a-zA-Z0-9_.]*[a-zA-Z0-9_]"
ANY = f"{CENSORED}|{DESCRIBED}|{WEB}|{MAIL}|{HANDLE}"
#: Texts without a bracket, @ or full stop before a domain hold nothing to find and go past the long expression.
GATE = rf"[@\[【]|\.(?=[a-zA-Z日コ公网台香澳新中]){TLD}"
#: Mail addresses of .com domains wherever they stand, also within other addresses and before more letters. A search begins where a run of its characters does, or where the last match ended.
COM_MAIL = r"(?:(?<![a-zA-Z0-9_.+\-])|\G)[a-zA-Z0-9_.+\-]++@(?:(?!-)[\p{L}\p{N}\-]++(?<!-)\.){1,1000}com"


def found(text: Column) -> Column:
    """All matches of a text, in order."""
    return F.when(text.rlike(GATE), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def com_mails(text: Column) -> Column:
    """All mail addresses of .com domains, in order."""
    return F.when(F.contains(text, F.lit("@")), F.regexp_extract_all(text, F.lit(COM_MAIL), F.lit(0))).otherwise(F.array().cast("array<string>"))


def kind(match: Column) -> Column:
    """Name of a match's kind: censored, cc_desc, web, email or handle."""
    return (F.when(match == "[ __ ]", "censored").when(match.rlike(r"^[\[【]"), "cc_desc").when(match.startswith("@"), "handle")
            .when(F.contains(match, F.lit("@")) & ~F.contains(match, F.lit("/")), "email").otherwise("web"))  # a web address has @ in its path only


def as_token(match: Column) -> Column:
    """What stands for a match among the tokens: kept text with blanks as _ and square brackets, or <kind>."""
    return F.when(kind(match).isin("censored", "cc_desc"), F.translate(match, "\t\n\r 【】", "____[]")).otherwise(F.concat(F.lit("<"), kind(match), F.lit(">")))


POS = {"censored": "CENSORED", "cc_desc": "CCDESC", "web": "WEB", "email": "EMAIL", "handle": "HANDLE"}


def mask(text: Column) -> Column:
    """The text with each match replaced by its token between blanks; the rest unchanged."""
    parts = F.split(F.regexp_replace(text, f"({ANY})", "\u0001$1\u0001"), "\u0001")
    return F.when(text.rlike(GATE), F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.concat(F.lit(" "), as_token(p), F.lit(" "))).otherwise(p)), "")).otherwise(text)


def tokens_with_addresses(text: Column, tokenizer) -> Column:
    """Tokens of the text between matches by `tokenizer` (column to array), matches as single tokens in their places."""
    parts = F.split(F.regexp_replace(text, f"({ANY})", "\u0001$1\u0001"), "\u0001")
    return F.when(text.rlike(GATE), F.flatten(F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.array(as_token(p))).otherwise(tokenizer(p))))).otherwise(tokenizer(text))
