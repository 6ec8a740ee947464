"""DuckDB SQL expressions equal to the Spark text functions (oracle side).

They share the regex constants of ``textlake.functions.text`` so both
engines run the same patterns.
"""

from __future__ import annotations

from textlake.functions import text as T
from textlake.functions import hashing as H

q = T.sql_lit


def tokens(x):
    return f"regexp_extract_all({x}, {q(T.TOKEN_RE)})"


def words(x):
    return f"regexp_extract_all({x}, {q(T.WORD_RE)})"


def drop_punct(a, punct):
    return f"list_filter({a}, lambda tk: instr({q(punct)}, tk) = 0)"


def strip(x):
    x = f"regexp_replace(coalesce({x}, ''), {q(T.LINK_RE)}, '', 'g')"
    x = f"regexp_replace({x}, {q(T.CTRL_RE)}, '', 'g')"
    return f"regexp_replace({x}, {q(T.REPOST_RE)}, '')"


def clean_name(x):
    return f"array_to_string({drop_punct(tokens(strip(x)), T.PUNCT_NAME)}, ' ')"


def glue(x):
    parts = f"string_split({x}, ' ')"
    return (f"array_to_string(list_transform(list_zip({parts}, list_concat(({parts})[2:], [NULL::VARCHAR])), "
            f"lambda gz: gz[1] || CASE WHEN gz[2] IS NULL THEN '' "
            f"WHEN regexp_matches(gz[1], {q(T.CAP_TAIL_RE)}) AND regexp_matches(gz[2], {q(T.CAP_HEAD_RE)}) "
            f"THEN '-' ELSE ' ' END), '')")


def clean_sentence(x):
    return f"array_to_string({drop_punct(tokens(glue(strip(x))), T.PUNCT_SENTENCE)}, ' ')"


def process_text(x):
    return (f"array_to_string(list_filter({tokens(x)}, lambda pt: regexp_full_match(pt, {q('.' + T.W + '+')}) "
            f"AND NOT starts_with(pt, 'http')), ' ')")


def ngrams(arr, n):
    if n == 1:
        return arr
    m = f"greatest(len({arr}) - {n} + 1, 0)"
    zs = ", ".join(f"list_slice({arr}, {k + 1}, {k} + {m})" for k in range(n))
    parts = ", ".join(f"nz[{k + 1}]" for k in range(n))
    return f"list_transform(list_zip({zs}), lambda nz: concat_ws(' ', {parts}))"


def get_tokens(x, n):
    return ngrams(tokens(f"regexp_replace(coalesce({x}, ''), '[0-9'']', '', 'g')"), n)


def tokenize_ws(x, eos=True):
    t = f"replace({x}, chr(10), ' </s> ')"
    if eos:
        t = f"({t} || ' </s>')"
    return f"list_filter(regexp_split_to_array({t}, '[ \\t\\r\\x0B\\f\\x00]+'), lambda wz: wz <> '')"


def ascii_lower(x):
    return f"translate({x}, '{T.UPPER}', '{T.LOWER}')"


def normalize_review(x, prefix="__label__"):
    t = ascii_lower(x)
    t = f"({q(prefix)} || replace({t}, chr(10), chr(10) || {q(prefix)}))"
    for pat, rep in [("'", " ' "), ('"', ""), (".", " . "), ("<br />", " "), (",", " , "), ("(", " ( "),
                     (")", " ) "), ("!", " ! "), ("?", " ? "), (";", " "), (":", " ")]:
        t = f"replace({t}, {q(pat)}, {q(rep)})"
    return f"regexp_replace({t}, ' +', ' ', 'g')"


def normalize_wiki(x):
    t = x
    for pat, rep in T.WIKI_REPLACEMENTS:
        t = f"replace({t}, {q(pat)}, {q(rep)})"
    return f"translate({t}, '0123456789', '          ')"


def normalize_crude(x, published=False):
    if published:
        t = f"regexp_replace({x}, {q(r'\([.!?,' + chr(39) + r'/()]\)')}, ' 1 ', 'g')"
    else:
        t = f"regexp_replace({x}, {q(r'([.!?,' + chr(39) + r'/()])')}, ' \\1 ', 'g')"
    return ascii_lower(t)


def strip_record(r, spell=False):
    for pat, rep in T.MARKUP_CHAIN:
        rep = rep.replace("$1", "\\1")
        r = f"regexp_replace({r}, {q(pat)}, {q(rep)}, 'g')"
    r = f"(' ' || {r} || ' ')"
    if spell:
        r = ascii_lower(r)
        for d, w in enumerate(T.DIGIT_WORDS):
            r = f"replace({r}, '{d}', ' {w} ')"
        r = f"regexp_replace({r}, '[^a-z]+', ' ', 'g')"
    return f"substring({r}, 1, length({r}) - 1)"


def strip_markup(x, spell=False):
    body = strip_record("mr", spell)
    return f"array_to_string(list_transform(regexp_extract_all({x}, {q(T.RECORD_RE)}), lambda mr: {body}), '')"


def utf8_bytes(x):
    hx = f"hex(encode({x}))"
    return f"list_transform(range(0, strlen({x})), lambda bk: ('0x' || substring({hx}, 2 * bk + 1, 2))::BIGINT)"


def fnv1a(x):
    return (f"list_reduce({utf8_bytes(x)}, lambda fh, fb: (xor(fh, CASE WHEN fb >= 128 THEN fb + {H.SIGN_EXT} "
            f"ELSE fb END) * {H.FNV_PRIME}) & {H.MASK32}, CAST({H.FNV_OFFSET} AS BIGINT))")


def char_ngrams(w, minn, maxn):
    ww = f"('<' || {w} || '>')"
    return (f"list_filter(flatten(list_transform(range(0, length({ww})), lambda ci: list_transform("
            f"range({minn}, least({maxn}, length({ww}) - ci) + 1), lambda cn: struct_pack(g := substring({ww}, ci + 1, cn), "
            f"n := cn, i := ci)))), lambda cs: NOT (cs.n = 1 AND (cs.i = 0 OR cs.i + 1 = length({ww}))))")


def char_ngram_strings(w, minn, maxn):
    return f"list_transform({char_ngrams(w, minn, maxn)}, lambda cz: cz.g)"
