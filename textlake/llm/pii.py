"""Personal data by anchor expansion.

An Aho-Corasick automaton runs once over a text and finds the anchors: at-signs,
plus signs, digits, schemes and identifier cues.  A deterministic local parser
expands each anchor to the longest span its kind allows and validates it; text
without anchors is never looked at again.

Kinds
* ``email``    at-sign with a local part before it and a dotted domain after it;
* ``ip``       four dotted numbers of at most 255;
* ``card``     14 to 19 digits, single blanks or hyphens between them, Luhn-valid;
* ``phone``    plus sign and 10 to 15 digits;
* ``address``  a web address that carries a user name, or a mail address after ``mailto:``
               with its scheme;
* ``account``  the value after an identifier cue (``iban``, ``account no``, ``passport``,
               ``password``, ``token``, ...): at least 6 letters and digits, 4 of them digits;
               after a password, secret, token or key cue and a mark (``:``, ``=``) any
               value up to a blank, quote, comma or semicolon.

The first four are found exactly as leftmost non-overlapping matches, per kind, of

    email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
    ip     [0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)
    card   [0-9]([\\x20-]?[0-9])+
    phone  \\+[0-9][\\x20().0-9-]+[0-9]

would be (a match that fails its validation is dropped, and its characters are
used up).  Spans are (kind, start, end) in code points, end exclusive, sorted by
start, then by the order above; spans of different kinds may overlap.

Defined results: null and empty texts have no spans; repeated rows get equal
results; ``redact`` keeps null texts, all other columns and the row order.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.llm.common import free_name

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "address", "account")

#: Identifier cues (lower case), fixed values.
CUES = ("iban", "account", "acct", "passport", "ssn", "social security", "tax id", "user id", "customer id",
        "password", "passwd", "api key", "api_key", "apikey", "secret", "token")
#: Cues whose values need no digits after a mark.
SECRETS = frozenset(("password", "passwd", "api key", "api_key", "apikey", "secret", "token"))
SCHEMES = ("http://", "https://", "ftp://", "mailto:")

_DIGITS = frozenset("0123456789")
_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
_LOCAL = _ALNUM | frozenset("._%+-")
_LABEL = _ALNUM | frozenset("-")
_PHONE = _DIGITS | frozenset(" ().-")
_VALUE = _ALNUM | frozenset("-_")

Span = tuple[str, int, int]


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for s in ("@", "+", *sorted(_DIGITS)):
        a.add_word(s, ("digit" if s in _DIGITS else s, 1))
    for s in SCHEMES:
        a.add_word(s, ("scheme", len(s)))
    for s in CUES:
        a.add_word(s, ("cue", len(s)))
    a.make_automaton()
    return a


_anchors = _automaton()
_FOLD = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def _domain(text: str, at: int) -> int:
    """End of a dotted domain that begins at ``at``; -1 without two labels."""
    end, labels, i, n = -1, 0, at, len(text)
    while True:
        j = i
        while j < n and text[j] in _LABEL:
            j += 1
        if j == i:
            break
        labels += 1
        end = j
        if j < n and text[j] == ".":
            i = j + 1
        else:
            break
    return end if labels >= 2 else -1


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _emails(text: str, signs: list[int]) -> list[Span]:
    found, free = [], 0
    for at in signs:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start == at:
            continue
        end = _domain(text, at + 1)
        if end > 0:
            found.append(("email", start, end))
            free = end
    return found


def _runs(digits: list[int]) -> list[tuple[int, int]]:
    """Longest runs of digits from the positions of all digits."""
    runs: list[tuple[int, int]] = []
    for i in digits:
        if runs and runs[-1][1] == i:
            runs[-1] = (runs[-1][0], i + 1)
        else:
            runs.append((i, i + 1))
    return runs


def _chains(text: str, runs: list[tuple[int, int]], between: str):
    """Runs of digits joined by single characters of ``between``."""
    chain: list[tuple[int, int]] = []
    for r in runs:
        if chain and r[0] == chain[-1][1] + 1 and text[chain[-1][1]] in between:
            chain.append(r)
        else:
            if chain:
                yield chain
            chain = [r]
    if chain:
        yield chain


def _ips(text: str, runs) -> list[Span]:
    found = []
    for chain in _chains(text, runs, "."):
        for k in range(0, len(chain) - 3, 4):
            four = chain[k:k + 4]
            if all(int(text[a:b].lstrip("0")[:4] or "0") <= 255 for a, b in four):
                found.append(("ip", four[0][0], four[3][1]))
    return found


def _cards(text: str, runs) -> list[Span]:
    found = []
    for chain in _chains(text, runs, " -"):
        if 14 <= sum(b - a for a, b in chain) <= 19 and _luhn("".join(text[a:b] for a, b in chain)):
            found.append(("card", chain[0][0], chain[-1][1]))
    return found


def _phones(text: str, signs: list[int]) -> list[Span]:
    found, n = [], len(text)
    for at in signs:
        if at + 1 >= n or text[at + 1] not in _DIGITS:
            continue
        j = at + 2
        while j < n and text[j] in _PHONE:
            j += 1
        while j > at + 3 and text[j - 1] not in _DIGITS:
            j -= 1
        # at least one character of the class between the first and the last digit
        if j > at + 3 and text[j - 1] in _DIGITS:
            if 10 <= sum(c in _DIGITS for c in text[at:j]) <= 15:
                found.append(("phone", at, j))
    return found


def _addresses(text: str, schemes: list[tuple[int, int]]) -> list[Span]:
    """``schemes``: (start, end) of each scheme."""
    found, n = [], len(text)
    for start, at in schemes:
        end = at
        while end < n and not text[end].isspace() and text[end] not in "<>\"'":
            end += 1
        while end > at and text[end - 1] in ".,;:!?)]}":
            end -= 1
        authority = text[at:end].replace("?", "/").replace("#", "/").split("/", 1)[0]
        user, sign, host = authority.rpartition("@")
        if sign and user and host[:1] in _ALNUM:
            found.append(("address", start, end))
    return found


def _accounts(text: str, folded: str, cues: list[tuple[int, int]]) -> list[Span]:
    """``cues``: (start, end) of each cue; the span is that of the value."""
    found, n, free = [], len(text), 0
    for start, i in cues:
        if (start and folded[start - 1] in _ALNUM) or (i < n and folded[i] in _ALNUM):
            continue
        mark, secret, cue_end = False, False, i
        while i < n and text[i] in " :=#\"'.":
            mark |= text[i] in ":=#"
            secret |= text[i] in ":=" and folded[start:cue_end] in SECRETS
            i += 1
        value = i
        for word in ("number", "no", "nr", "id", "is"):
            if folded.startswith(word, i) and not (i + len(word) < n and folded[i + len(word)] in _ALNUM):
                i += len(word)
                mark = True
                while i < n and text[i] in " :=#\"'.":
                    i += 1
                break
        j, digits, size = i, 0, 0
        while j < n and (text[j] in _VALUE or (text[j] == " " and mark and j + 1 < n and text[j + 1] in _DIGITS
                                               and j > i and text[j - 1] in _DIGITS)):
            digits += text[j] in _DIGITS
            size += text[j] in _ALNUM
            j += 1
        while j > i and text[j - 1] not in _ALNUM:
            j -= 1
        if secret and not (size >= 6 and digits >= 4):
            # the value as it stands: any length, any characters up to its end
            i = j = value
            while j < n and not text[j].isspace() and text[j] not in "\"',;<>":
                j += 1
            while j > i and text[j - 1] in ".:!?)]}":
                j -= 1
            if j > i and i >= free:
                found.append(("account", i, j))
                free = j
        elif size >= 6 and digits >= 4 and i >= free:
            found.append(("account", i, j))
            free = j
    return found


def find(text: str) -> list[Span]:
    """All spans of a text, sorted by start, then kind."""
    folded = text.translate(_FOLD)
    at_signs: list[int] = []
    pluses: list[int] = []
    digits: list[int] = []
    schemes: list[tuple[int, int]] = []
    cues: list[tuple[int, int]] = []
    for last, (what, length) in _anchors.iter(folded):
        if what == "digit":
            digits.append(last)
        elif what == "@":
            at_signs.append(last)
        elif what == "+":
            pluses.append(last)
        elif what == "scheme":
            schemes.append((last - length + 1, last + 1))
        else:
            cues.append((last - length + 1, last + 1))
    found: list[Span] = []
    if at_signs:
        found += _emails(text, at_signs)
    if digits:
        runs = _runs(digits)
        found += _ips(text, runs) + _cards(text, runs)
        found += _phones(text, pluses) if pluses else []
    if cues:
        found += _accounts(text, folded, cues)
    if schemes and at_signs:
        found += _addresses(text, schemes)
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def spans(docs: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """``docs`` with an array of (kind, start, end) for each text; no shuffle."""

    @F.arrow_udf("array<struct<kind:string,start:long,end:long>>")
    def judge(t: pa.Array) -> pa.Array:
        return pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in find(x)] for x in t.to_pylist()], _SPANS)

    return docs.withColumn(out, judge(F.coalesce(F.col(text), F.lit(""))))


def redact_text(text: str, mark: str = "<{}>") -> str:
    """The text with a mark such as ``<EMAIL>`` for every span; overlapping
    spans become one mark, named by the first of them."""
    parts, at = [], 0
    for kind, a, b in find(text):
        if a < at:
            if b > at:
                at = b
            continue
        parts += [text[at:a], mark.format(kind.upper())]
        at = b
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame, text: str = "text", length: str | None = None) -> DataFrame:
    """``docs`` with every span replaced by a mark; ``length``: a column that
    holds the text's length and is set anew where the text changed."""
    new = free_name(docs, "_clean")

    @F.arrow_udf("string")
    def clean(t: pa.Array) -> pa.Array:
        return pa.array([None if x is None else redact_text(x) for x in t.to_pylist()], pa.string())

    out = docs.withColumn(new, clean(F.col(text)))
    columns = {text: F.col(new)}
    if length and length in docs.columns:
        columns[length] = (F.when(F.col(new).eqNullSafe(F.col(text)), F.col(length))
                           .otherwise(F.length(new)).cast(docs.schema[length].dataType))
    return out.withColumns(columns).drop(new)


def listed(found: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def digest(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with counts of the base kinds, a hash of the base spans and all spans."""
    found = free_name(docs, "_pii")
    kinds = {f"n_{k}": pa.int64() for k in BASE_KINDS}
    kind = pa.struct([*kinds.items(), ("base_sha256", pa.string()), ("spans", pa.string())])

    @F.arrow_udf("struct<" + ",".join(f"{n}:long" for n in kinds) + ",base_sha256:string,spans:string>")
    def judge(t: pa.Array) -> pa.Array:
        out = []
        for x in t.to_pylist():
            got = find(x)
            base = [s for s in got if s[0] in BASE_KINDS]
            out.append({f"n_{k}": sum(s[0] == k for s in base) for k in BASE_KINDS}
                       | {"base_sha256": hashlib.sha256(listed(base).encode()).hexdigest(), "spans": listed(got)})
        return pa.array(out, kind)

    frame = docs.withColumn(found, judge(F.coalesce(F.col(text), F.lit(""))))
    return frame.withColumns({n: F.col(found)[n] for n in [*kinds, "base_sha256", "spans"]}).drop(found)
