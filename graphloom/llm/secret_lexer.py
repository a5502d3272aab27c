"""Lexical tokens of code and prompts, and the kind of each token.

A token's kind and shape depend on its text only, so they are computed once per distinct text; context enters in
``secret_crf`` through the kinds and words around a token.
"""

from __future__ import annotations

import base64
import binascii
import math
from collections import Counter
from functools import lru_cache

import regex

# White space between tokens is skipped; a key block is one token with all its lines, however its literals are joined.
_BLOCKS = (
    r"-----BEGIN (?P<head>[A-Z0-9 ]+)-----(?:(?!-----)[^\0])*+-----END (?P=head)-----"
    r"|-----BEGIN [A-Z0-9 ]+-----(?:[A-Za-z0-9+/=\s]|\\[nrt])*"
)
# A quoted literal without white space, with digits and marks; it is one token if ``whole_literal`` says so.
_LITERALS = r"(?P<quote>[\"'`])(?<![^\s=:(\[,{+?>][\"'`])(?P<literal>(?=[^\s\"'`]*[^\s\"'`\w])(?=[^\s\"'`]*\d|[^\s\"'`]*\\)(?:\\[^\s]|(?!(?P=quote))[^\s\\]){6,200})(?=(?P=quote))"
_PLAIN = (
    r"\n|://"
    r"|[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)*\.[A-Za-z0-9_-]{20,}"  # dotted tokens
    r"|[A-Za-z0-9+/_-]{14,}==(?![\w=])|[A-Za-z0-9+/_-]{14,}=(?![\w\"'`$<{(\[=])"  # base64 with its padding
    r"|(?=[A-Za-z+/]*\d)(?=[A-Z0-9+/]*[a-z])(?=[a-z0-9+/]*[A-Z])[A-Za-z0-9+/]{14,}=(?=[\"'`])"
    r"|[\p{L}\p{N}_](?:[\p{L}\p{N}_]|[-+/.!#$%^&*~](?=[-\p{L}\p{N}_+/.!#$%^&*~])|[!#$%^&*~+](?=[\"'`]))*"
    r"|\*{3,}[\w*-]*"
    r"|[^\s]"
)
TOKEN, _PARTS = regex.compile(f"{_BLOCKS}|{_LITERALS}|{_PLAIN}"), regex.compile(_PLAIN)
# Marks by which a literal is more than one value: addresses, templates, pairs, lists, calls, paths, mail addresses and patterns.
_STRUCTURE = regex.compile(
    r"://|[{}<>;,]|\$\(|=(?=[^=])|:(?!$)|^\.{0,2}/|^[A-Za-z]:\\|^[\w.+-]+@[\w-]+(?:\.[\w-]+)+$|^@?[\w.-]+(?:/[\w.@-]+)+$"
    r"|[A-Za-z_$.]{3,}\(|\(\?|(?<!\\)\\[dwsbpDWSBnrtux]|\[\^|\w-\w\]|^\^|%[sd]|&\w+="
)

# Subwords that name credentials, things that look like them, and places they are taken from.
SECRET_WORDS = frozenset(
    "password passwd pass pwd pw passphrase passwort kennwort passe contraseña clave secret secrets token key keys apikey api auth authorization "
    "bearer basic credential credentials cred creds pem login signing private access license pat jwt otp pin salt cookie session".split()
)
STRONG_WORDS = frozenset("password passwd pwd pw pass passphrase passwort kennwort passe contraseña secret bearer credentials credential authorization apikey pem".split())
#: Words that name a secret also at the end of a longer one, as in PGPASSWORD.
STRONG_ENDS = ("password", "passwd", "passphrase", "passwort", "pwd")
PUBLIC_WORDS = frozenset(
    "sha sha1 sha224 sha256 sha384 sha512 md5 crc hash checksum integrity digest etag commit pinned trace traceid spanid uuid guid rev revision "
    "fingerprint public publickey base64 image png svg rsa ed25519 ssh version baseline build blob tree ref nonce request span".split()
)
REFERENCE_WORDS = frozenset("env environ getenv vault ref secretref arn ssm keyring kms placeholder example sample dummy show lookup config settings param".split())
FILLER = regex.compile(r"(?i)^(?:x+|\*+|\.+|0+|1+|(?:x+[-_])+x+|(?:your|insert|enter|replace|change|fill|put|add|some|example|sample|dummy|fake|test|placeholder|redacted|masked|hidden|todo|tbd|none|null|undefined|changeme|foo|bar)(?:[-_. ]?(?:\w+))*)$")
FILLER_WORDS = frozenset("your insert replace changeme change placeholder example sample dummy fake redacted masked hidden here todo enter".split())
PREFIXES = regex.compile(
    r"^(?:AKIA|ASIA|AIza|ghp_|gho_|ghs_|ghu_|ghr_|github_pat_|glpat-|npm_|pypi-|sk-|pk-|rk_|sk_|pk_|xox[abprs]-|SG\.|hf_|dop_v1_|shpat_|tok_|hvs\.|ya29\.|eyJ|EAAC|key-|whsec_|lin_|dckr_pat_|sq0|AGE-)"
)
GENERIC_PREFIX = regex.compile(r"^[A-Za-z]{2,6}[-_.](?:(?:prod|live|test|dev|svc|proj|int)[-_])?(?=[A-Za-z0-9]{16,})")
KEY_ID = regex.compile(r"^(?:AKIA|ASIA)[A-Z0-9]{2,16}$")
GROUPS = regex.compile(r"^[A-Z0-9]{4,}(?:-[A-Z0-9]{4,})+$|^[A-Z0-9]{16,}$")
UUID = regex.compile(r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
HEX = regex.compile(r"^(?:[0-9a-f]+|[0-9A-F]+)$")
NUMBER = regex.compile(r"^[0-9][0-9_.,]*(?:[a-zA-Z%]{1,3})?$")
VERSIONS = regex.compile(r"^v?\d+(?:\.\d+)+(?:[-+][\w.]+)?$")
IDENTIFIER = regex.compile(r"^[\p{L}_$][\p{L}_$]*[0-9]{0,3}$")
WORD_PASS = regex.compile(r"^[\p{L}]{3,}[-_.!#$%^&*~+]?[\p{L}]{2,}[0-9]{1,6}[!#$%^&*~+]?$|^[\p{L}]{3,}[-_.!#$%^&*~+][\p{L}]{2,}[-_.!#$%^&*~+]?[0-9]{1,6}$")
CHOSEN = regex.compile(r"^\p{L}{2,}(?:[-_.!#$%^&*~+]\p{L}{2,}[0-9]{2,6}|[0-9]{3,6}[!#$%^&*~+]|[0-9]{4,6})$|^\p{Ll}{3,}\p{Lu}{3,}[0-9]{2,6}$")
HYPHENATED = regex.compile(r"^[\p{Ll}]+(?:-[\p{Ll}]+){2,}$")
HOST = regex.compile(r"^(?:[\w-]+\.)+(?:[a-z]{2,10})(?:/.*)?$")
SUBWORD = regex.compile(r"\p{Lu}+(?!\p{Ll})|\p{Lu}?\p{Ll}+|\d+")

KINDS = (
    "newline quote open close assign separator operator slashes at dollar masked number version word secret_word strong_word public_word reference_word "
    "identifier dotted path host filler uuid hex_short hex_mid hex_md5 hex_sha1 hex_sha256 hex_other known generic_prefix jwt userinfo64 base64_pad base64 random_long random_mid random_special "
    "word_digits hyphenated constant pem_private pem_public other"
).split()
KIND = {k: i for i, k in enumerate(KINDS)}
#: Kinds that can begin or be a secret: every token that is a literal of its own and not a mark, number or plain keyword.
CANDIDATES = frozenset(
    KIND[k]
    for k in "hex_short hex_mid hex_md5 hex_sha1 hex_sha256 hex_other known generic_prefix jwt userinfo64 base64_pad base64 random_long random_mid random_special word_digits hyphenated pem_private uuid identifier dotted path constant".split()
)
_MARKS = {"\n": "newline", "://": "slashes", "@": "at", "$": "dollar"} | dict.fromkeys("\"'`«»“”„", "quote") | dict.fromkeys("([{<", "open") | dict.fromkeys(")]}>", "close") | dict.fromkeys("=:", "assign") | dict.fromkeys(",;", "separator")


def subwords(text: str) -> list[str]:
    return [w.lower() for w in SUBWORD.findall(text)]


def entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values())


def class_changes(text: str) -> int:
    """How often the character class (lower, upper, digit, other) changes; a capital before small letters is no change."""
    last, n = "", 0
    for c in text:
        k = "l" if c.islower() else "u" if c.isupper() else "d" if c.isdigit() else "o"
        if last and k != last and not (last == "u" and k == "l"):
            n += 1
        last = k
    return n


# A line of a key block that describes it, as "Proc-Type: 4,ENCRYPTED"; line ends may be escaped.
_BLOCK_HEADER = regex.compile(r"(?:^|\n|\\n|[\"'`])[^\S\n]*[A-Z][A-Za-z-]+: [^\n\\\"'`]*")
_BLOCK_RUN = regex.compile(r"(?:\\[nrt])+|(?P<run>[A-Za-z0-9+/=]+)|[^\s]")


def key_material(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """The runs of key material of a key block, between its BEGIN and END marks: line ends (also escaped) and lines that
    describe it are left out, and where it is joined from literals, so is what stands between them."""
    head = text.index("-----", start + 10) + 5
    tail = text.rfind("-----END", head, end)
    stop = tail if tail >= 0 else end
    described = [m.span() for m in _BLOCK_HEADER.finditer(text, head, stop)]
    out, opened, within = [], None, True
    for m in _BLOCK_RUN.finditer(text, head, stop):
        if m["run"] is None:
            c = m.group()
            if c in "\"'`" and opened in (None, c):
                opened, within = c, not within
        elif within and not any(lo <= m.start() < hi for lo, hi in described):
            out.append(m.span())
    return out


def _userinfo(text: str) -> bool:
    if len(text) < 12:
        return False
    try:
        plain = base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return False
    return b":" in plain[1:-1] and all(32 < b < 127 for b in plain)


def kind_of(t: str) -> str:
    """The lexical kind of a token."""
    if len(t) <= 3 and t in _MARKS:
        return _MARKS[t]
    if t.startswith("-----BEGIN"):
        return "pem_private" if "PRIVATE" in t[: t.find("-----", 10)] and sum(hi - lo for lo, hi in key_material(t, 0, len(t))) >= 20 else "pem_public"
    if len(t) == 1 and not t.isalnum():
        return "operator"
    if "***" in t or "•••" in t or "..." in t:
        return "masked"
    if NUMBER.match(t) and not (len(t) >= 16 and t.isdigit()):
        return "version" if VERSIONS.match(t) else "number"
    if VERSIONS.match(t):
        return "version"
    if FILLER.match(t) and (len(t) < 12 or not PREFIXES.match(t)) and class_changes(regex.sub(r"[-_. ]", "", t)) <= 2:
        low = subwords(t)
        if len(low) > 1 or t.lower() in FILLER_WORDS or regex.match(r"(?i)^(.)\1{3,}$", t):
            return "filler"
    if UUID.match(t):
        return "uuid"
    n = len(t)
    if t.startswith("eyJ") and t.count(".") >= 1 and n > 40:
        return "jwt"
    has_digit = any(c.isdigit() for c in t)
    lower, upper = any(c.islower() for c in t), any(c.isupper() for c in t)
    if HEX.match(t) and has_digit and n >= 8:
        return {32: "hex_md5", 40: "hex_sha1", 64: "hex_sha256"}.get(n, "hex_short" if n < 16 else "hex_mid" if n < 40 else "hex_other")
    if n >= 10 and PREFIXES.match(t) and (has_digit or class_changes(t) > 2):
        return "known"
    if KEY_ID.match(t):
        return "known"
    if n >= 14 and GROUPS.match(t) and sum(c.isdigit() for c in t) >= 2:
        return "random_long"
    if n >= 20 and GENERIC_PREFIX.match(t) and has_digit and class_changes(t) >= 4:
        return "generic_prefix"
    if has_digit or upper:
        if _userinfo(t):
            return "userinfo64"
    if n >= 14 and t.endswith("=") and class_changes(t) >= 3:
        return "base64_pad"
    if not has_digit and HYPHENATED.match(t):
        return "hyphenated"
    low = subwords(t)
    words = set(low)
    if any(w.endswith(STRONG_ENDS) for w in low):
        words.add("password")
    simple = IDENTIFIER.match(t) or regex.match(r"^[\p{L}_$][\w$]*(?:[-.][\p{L}_$][\w$]*)*$", t)
    changes = class_changes(t)
    if n >= 8 and CHOSEN.match(t) and not t.isupper() and not words & PUBLIC_WORDS:
        return "word_digits"
    known_words = words & SECRET_WORDS or words & PUBLIC_WORDS or words & REFERENCE_WORDS
    if simple and known_words and changes <= 6 and not (has_digit and n > 24):
        if words & REFERENCE_WORDS:
            return "reference_word"
        if words & STRONG_WORDS:
            return "strong_word"
        if words & PUBLIC_WORDS:
            return "public_word"
        return "secret_word"
    if WORD_PASS.match(t) and (changes >= 2 or upper) and n >= 8:
        return "word_digits"
    letters = sum(c.isalpha() for c in t)
    mean_word = letters / max(1, len(low) - sum(w.isdigit() for w in low))
    if n >= 8 and has_digit and (changes >= 4 or (changes >= 3 and mean_word < 3.5)) and mean_word < 4.2:
        if any(c in "!#$%^&*~" for c in t):
            return "random_special"
        if "/" in t or "+" in t:
            return "base64" if n >= 20 else "random_mid"
        return "random_long" if n >= 20 else "random_mid"
    if n >= 8 and changes >= 3 and mean_word < 4.2 and sum(c.isdigit() for c in t) >= 3 and regex.search(r"\d\p{L}", t):
        return "random_mid"
    if n >= 20 and not has_digit and lower and upper and changes >= 6 and mean_word < 3:
        return "random_long"
    if any(c in "!#$%^&*~" for c in t[1:]) and n >= 8 and letters:
        return "random_special"
    if has_digit and n >= 8 and lower and upper and changes >= 2 and not simple:
        return "random_mid"
    if "/" in t:
        return "path"
    if HOST.match(t):
        return "host" if n < 60 else "dotted"
    if "." in t:
        return "dotted"
    if t.isupper() and n > 2:
        return "constant"
    if IDENTIFIER.match(t) and not has_digit and (t.islower() or t[1:].islower()) and "_" not in t:
        return "word"
    if simple:
        return "identifier"
    if t.isalnum() and has_digit and n >= 8:
        return "random_mid"
    return "other"


@lru_cache(maxsize=1 << 14)
def whole_literal(t: str) -> bool:
    """Whether a quoted literal is one value: letters, digits and marks in turn without structure, and not a name, flag
    or reference behind its leading marks."""
    if _STRUCTURE.search(t) or class_changes(t) < 3 or not any(map(str.isalpha, t)):
        return False
    core = t.lstrip("$@#%.!*-")
    return not regex.fullmatch(r"[\w.-]+", core) or KIND[kind_of(core)] in _VALUES


#: Kinds that no name or flag has.
_VALUES = CANDIDATES - {KIND[k] for k in ("identifier", "dotted", "path", "constant", "hyphenated", "uuid")}


def lex(text: str) -> tuple[list[str], list[int]]:
    """Tokens of a text and the character position of each."""
    tokens, at = [], []
    for m in TOKEN.finditer(text):
        literal = m["literal"]
        if literal is None:
            tokens.append(m.group())
            at.append(m.start())
            continue
        tokens.append(m["quote"])
        at.append(m.start())
        if whole_literal(literal):
            tokens.append(literal)
            at.append(m.start("literal"))
        else:
            for part in _PARTS.finditer(text, m.start("literal"), m.end("literal")):
                tokens.append(part.group())
                at.append(part.start())
    return tokens, at
