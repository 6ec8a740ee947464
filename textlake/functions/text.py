"""Column -> Column text functions (STR-01..09, STR-15, FLT-01, FLT-06).

Everything here is a built-in Spark expression (regexp_replace,
regexp_extract_all, higher-order array functions), so it runs inside
whole-stage codegen with no Python in the hot path.  The regular
expressions only use constructs that Java regex and RE2 (DuckDB, the
oracle) read the same way: explicit Unicode classes instead of ``\\w``,
explicit whitespace sets instead of ``\\s``/``\\S``, no look-around; but for
``KEPT_SENTENCE_RE``, ``KEPT_WORDS_RE`` and ``GLUE_RE``, which the oracle doesn't use.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's behaviour)
# ---------------------------------------------------------------------------
# Python's string.punctuation plus the extra marks the cleaners add.
PUNCT_ASCII = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
PUNCT_SENTENCE = PUNCT_ASCII + "’““‘_"
PUNCT_NAME = PUNCT_SENTENCE + "..."
# Whitespace set of the word-vector library's reader (blank, \n \r \t \v \f \0).
WS_CHARS = " \n\r\t\x0b\x0c\x00"
EOS = "</s>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
# ---------------------------------------------------------------------------

W = r"[\p{L}\p{N}_]"              # a word character in both engines
NONWS = r"[^ \t\n\r\f\x0B]"        # a non-blank character in both engines

# Social-media tokenizer: URL | @handle | #tag | emoticon | word with inner
# ' or - | ellipsis | any other non-blank character.
TOKEN_RE = (
    r"https?://" + NONWS + r"+"
    + r"|@" + W + r"+"
    + r"|#" + W + r"+"
    + r"|[:;=][\-']?[()DPp]"
    + r"|" + W + r"+(?:['\-]" + W + r"+)*"
    + r"|\.\.\.+"
    + r"|" + NONWS
)
WORD_RE = W + r"+(?:['\-]" + W + r"+)*"
LINK_RE = r"http" + NONWS + r"+"
CTRL_RE = r"[\n\r\t]"
REPOST_RE = r"(?s)^.*?RT (@" + W + r"+|" + W + r"+):? "
CAP_TAIL_RE = r"[A-Z][\p{L}\p{N}_\-.]*$"   # token ends in a capitalised run
CAP_HEAD_RE = r"^[A-Z]"
KEEP_TOKEN_RE = r"^." + W + r"+$"          # process_text keep rule
# The same rules over a whole text, for Java alone: a kept token is group 1, anything else (dropped tokens,
# blanks) is no group, so that one replacement by "$1 " puts the kept tokens in a row without an array.
# Plain words with a blank behind each are taken up to 32 at a time, as the time goes with the matches.
KEPT_SENTENCE_RE = (
    r"((?:[\p{L}\p{N}]" + W + r"*+ ){1,32}+|https?://" + NONWS + r"++|[@#]" + W + r"++|[:;=][\-']?[()DPp]"
    + r"|" + W + r"{2,}+(?:['\-]" + W + r"++)*+|[\p{L}\p{N}](?:['\-]" + W + r"++)*+|_(?:['\-]" + W + r"++)++|\.\.\.++"
    + r"|[^ \t\n\r\f\x0B!-/:-@\[-`{-~’“‘])|[!-/:-@\[-`{-~’“‘]?[ \t\n\r\f\x0B]++|[!-/:-@\[-`{-~’“‘]"
)
KEPT_WORDS_RE = (
    r"https?://" + NONWS + r"++|((?:(?!http)" + W + r"{2,}+ ){1,32}+|[@#]" + W + r"++|[:;=][DPp]|(?!http)" + W + r"{2,}+(?!['\-]" + W + r"))"
    + r"|[:;=][\-']?[()DPp]|" + W + r"++(?:['\-]" + W + r"++)*+|\.\.\.++|[^\p{L}\p{N}_@#:;=.]"
    + r"|[ \t\n\r\f\x0B]++|[@#:;=.]"
)
GLUE_RE = r"([A-Z][\p{L}\p{N}_\-.]*+) (?=[A-Z])"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` as a lambda variable.

    Helpers below read their input array several times (sizes, shifted
    slices); given an expression instead of a column, Spark would evaluate
    it again for each read.  Binding it through a one-element ``transform``
    makes every read a variable look-up."""
    return F.get(F.transform(F.array(value), body), 0)


def sql_lit(s: str) -> str:
    """A SQL string literal (quotes doubled) for the oracle side."""
    return "'" + s.replace("'", "''") + "'"


def tokens(col: Column) -> Column:
    """Social tokenizer: array of tokens in order."""
    return F.regexp_extract_all(col, F.lit(TOKEN_RE), 0)


def words(col: Column) -> Column:
    """Word tokens only (letters, digits, inner ' or -)."""
    return F.regexp_extract_all(col, F.lit(WORD_RE), 0)


def drop_punct(arr: Column, punct: str = PUNCT_SENTENCE) -> Column:
    """Drop tokens that are a substring of the punctuation string."""
    return F.filter(arr, lambda t: F.instr(F.lit(punct), t) == 0)


def in_a_row(col: Column, kept: str) -> Column:
    """The tokens that ``kept`` captures, joined by blanks: the text is read once, no array is made."""
    return F.trim(F.regexp_replace(F.regexp_replace(col, kept, "$1 "), "  +", " "))


def strip_links(col: Column) -> Column:
    return F.regexp_replace(col, LINK_RE, "")


def strip_ctrl(col: Column) -> Column:
    """Drop newline / carriage return / tab, putting no blank in."""
    return F.regexp_replace(col, CTRL_RE, "")


def cut_repost(col: Column) -> Column:
    """Drop everything through the first ``RT name:`` mark."""
    return F.regexp_replace(col, REPOST_RE, "")


def clean_name(col: Column) -> Column:
    """STR-01: links, control chars and repost mark out; punctuation tokens out."""
    t = cut_repost(strip_ctrl(strip_links(F.coalesce(col, F.lit("")))))
    return F.array_join(drop_punct(tokens(t), PUNCT_NAME), " ")


def glue_capitals(col: Column) -> Column:
    """Join runs of capitalised words with '-' ("Monero Dark" -> "Monero-Dark").

    The blank between two
    blank-separated pieces becomes '-' when the left piece ends in a
    capitalised run ``[A-Z][word.-]*`` and the right piece starts with A-Z: one
    replacement over the text, as the blank itself is what a match ends with.
    """
    return F.regexp_replace(col, GLUE_RE, "$1-")


def clean_sentence(col: Column) -> Column:
    """STR-02: as clean_name, plus capitalised runs glued by '-'."""
    t = cut_repost(strip_ctrl(strip_links(F.coalesce(col, F.lit("")))))
    return in_a_row(glue_capitals(t), KEPT_SENTENCE_RE)


def process_text(col: Column) -> Column:
    """STR-03: tokens of 2+ chars, all but the first word chars, not 'http...'."""
    return in_a_row(col, KEPT_WORDS_RE)


def ngrams(arr: Column, n: int, sep: str = " ") -> Column:
    """Consecutive n-grams of a token array, each joined by ``sep``: a zip
    of n shifted slices (the array is evaluated n times per row, never once
    per element)."""
    if n == 1:
        return arr

    def body(a):
        m = F.greatest(F.size(a) - n + 1, F.lit(0))
        z = F.arrays_zip(*[F.slice(a, k + 1, m) for k in range(n)])
        return F.transform(z, lambda s: F.concat_ws(sep, *[s[str(k)] for k in range(n)]))
    return let(arr, body)


def get_tokens(col: Column, n: int = 1, token_func=None) -> Column:
    """STR-04: digits and apostrophes out, tokenize, n-grams ('a b' for n=2).
    ``token_func`` (UDF-03): another Column -> Column tokenizer, a built-in
    expression or a pandas UDF."""
    t = F.regexp_replace(F.coalesce(col, F.lit("")), "[0-9']", "")
    return ngrams((token_func or tokens)(t), n)


def tokenize_ws(col: Column, eos_at_end: bool = True) -> Column:
    """STR-05: whitespace tokenizer of the word-vector library.

    Blank, \\n \\r \\t \\v \\f \\0 separate tokens; every newline is the
    end-of-sentence token ``</s>``.  ``eos_at_end`` adds the one a line read
    from a file ends with.
    """
    t = F.regexp_replace(col, "\n", " " + EOS + " ")
    if eos_at_end:
        t = F.concat(t, F.lit(" " + EOS))
    return F.filter(F.split(t, "[ \t\r\u000b\f\u0000]+", -1), lambda x: x != "")


def ascii_lower(col: Column) -> Column:
    """Byte-wise ``tr '[:upper:]' '[:lower:]'``: only A-Z change."""
    return F.translate(col, UPPER, LOWER)


def squeeze_blanks(col: Column) -> Column:
    return F.regexp_replace(col, " +", " ")


def normalize_review(col: Column, prefix: str = "__label__") -> Column:
    """STR-06: review normalizer of the classification scripts."""
    t = ascii_lower(col)
    t = F.concat(F.lit(prefix), F.replace(t, F.lit("\n"), F.lit("\n" + prefix)))
    for pat, rep in [("'", " ' "), ('"', ""), (".", " . "), ("<br />", " "),
                     (",", " , "), ("(", " ( "), (")", " ) "), ("!", " ! "),
                     ("?", " ? "), (";", " "), (":", " ")]:
        t = F.replace(t, F.lit(pat), F.lit(rep))
    return squeeze_blanks(t)


# The encyclopaedia normalizer's replacements, in order.
WIKI_REPLACEMENTS = [
    ("’", "'"), ("′", "'"), ("''", " "), ("'", " ' "),
    ("“", '"'), ("”", '"'), ('"', ' " '), (".", " . "),
    ("<br />", " "), (", ", " , "), ("(", " ( "), (")", " ) "),
    ("!", " ! "), ("?", " ? "), (";", " "), (":", " "), ("-", " - "),
    ("=", " "), ("*", " "), ("|", " "), ("«", " "),
]


def normalize_wiki(col: Column) -> Column:
    """STR-07: quotes unified, punctuation padded, digits -> blank."""
    t = col
    for pat, rep in WIKI_REPLACEMENTS:
        t = F.replace(t, F.lit(pat), F.lit(rep))
    return F.translate(t, "0123456789", " " * 10)


def normalize_crude(col: Column, published: bool = False) -> Column:
    """STR-09: separate punctuation and lower-case (A-Z only).

    ``published=True`` keeps the printed command's basic-regex reading, where
    the parentheses are literal and the replacement is the text `` 1 ``.
    """
    if published:
        t = F.regexp_replace(col, r"\([.!?,'/()]\)", " 1 ")
    else:
        t = F.regexp_replace(col, r"([.!?,'/()])", " $1 ")
    return ascii_lower(t)


def min_tokens_mask(col: Column, n: int = 1) -> Column:
    """FLT-06: keep lines with more than ``n`` fields (blanks and tabs between)."""
    return F.size(F.filter(F.split(col, "[ \t]+", -1), lambda x: x != "")) > n


def keyword_flag(col: Column, word: str) -> Column:
    """FLT-01: case-insensitive regex search of ``word`` in the text."""
    return F.lower(col).rlike(word.lower())


def join_sentences(arr: Column, sep: str = " ") -> Column:
    """STR-15."""
    return F.array_join(arr, sep)


# ---------------------------------------------------------------------------
# STR-08 markup stripper.  The original filter reads its input in records
# that end at '>' and applies the substitutions to each record, so we split
# the same way and run the chain over the record array.
# The substitution chain, in order ((?i) = case-insensitive).
# ---------------------------------------------------------------------------
MARKUP_CHAIN = [
    (r"<[^\n]*>", ""),
    (r"&amp;", "&"),
    (r"&lt;", "<"),
    (r"&gt;", ">"),
    (r"<ref[^<]*</ref>", ""),
    (r"<[^>]*>", ""),
    (r"\[http:[^\] ]*", "["),
    (r"(?i)\|thumb", ""),
    (r"(?i)\|left", ""),
    (r"(?i)\|right", ""),
    (r"(?i)\|[0-9]+px", ""),
    (r"(?i)\[\[image:[^\[\]]*\|", ""),
    (r"(?i)\[\[category:([^|\]]*)[^\]]*\]\]", "[[$1]]"),
    (r"\[\[[a-z\-]*:[^\]]*\]\]", ""),
    (r"\[\[[^|\]]*\|", "[["),
    (r"\{\{[^}]*\}\}", ""),
    (r"\{[^}]*\}", ""),
    (r"\[", ""),
    (r"\]", ""),
    (r"&[^;]*;", " "),
]
DIGIT_WORDS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]
RECORD_RE = r"[^>]*>|[^>]+$"


def _strip_record(r: Column, spell_digits: bool) -> Column:
    for pat, rep in MARKUP_CHAIN:
        r = F.regexp_replace(r, pat, rep)
    r = F.concat(F.lit(" "), r, F.lit(" "))
    if spell_digits:
        r = ascii_lower(r)
        for d, w in enumerate(DIGIT_WORDS):
            r = F.replace(r, F.lit(str(d)), F.lit(f" {w} "))
        r = F.regexp_replace(r, "[^a-z]+", " ")
    # drop the final character (the blank put in above)
    return F.substring(r, F.lit(1), F.length(r) - 1)


REGION_OPEN = "<text "           # fixed values: the marks of a dump's text region and of a redirect page
REGION_CLOSE = "</text>"
REDIRECT_RE = "(?i)#redirect"


def region_records(recs: Column) -> Column:
    """The records inside a dump's text regions.

    A record with the opening mark starts a region, one with the closing mark is the last of it, one
    with a redirect mark ends it and is dropped itself (also where it holds the opening mark).  As both
    ends leave the state shut, the records are cut behind every end, and each piece keeps what follows
    its first opening mark: linear in the text, with no state copied from record to record."""
    def ends(r):
        return r.contains(REGION_CLOSE) | r.rlike(REDIRECT_RE)

    def inside(piece):
        first = F.array_position(F.transform(piece, lambda r: r.contains(REGION_OPEN)), True)
        kept = F.slice(piece, F.greatest(first, F.lit(1)).cast("int"), F.size(piece))
        return F.when(first == 0, F.array().cast("array<string>")).otherwise(
            F.filter(kept, lambda r: ~r.rlike(REDIRECT_RE)))

    def cut(recs):
        at = F.filter(F.transform(recs, lambda r, i: F.when(ends(r), i + 1)), lambda i: i.isNotNull())
        pieces = let(at, lambda a: F.arrays_zip(F.concat(F.array(F.lit(0)), a), F.concat(a, F.array(F.size(recs)))))
        return F.flatten(F.transform(pieces, lambda b: let(
            F.slice(recs, b["0"] + 1, b["1"] - b["0"]), inside)))
    return let(recs, cut)


def strip_markup(col: Column, spell_digits: bool = False, region: bool = False) -> Column:
    """STR-08: visible text of wiki / HTML markup, record by record.  With ``region`` only the text
    regions of a dump count (``<text ...>`` to ``</text>``) and redirect pages give nothing; a text
    without a region gives the empty string.  Null stays null."""
    recs = F.regexp_extract_all(col, F.lit(RECORD_RE), 0)
    if region:
        recs = region_records(recs)
    return F.array_join(F.transform(recs, lambda r: _strip_record(r, spell_digits)), "")
