"""Text as columns: folding, tokens, names, token estimates, citations.

All of it stays in the JVM.  Null in, null out, unless a docstring says otherwise.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerscope import fixed_values as V


def _plain_form(letter: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKD", letter) if not unicodedata.combining(x))


def _ranges(points: list[int]) -> str:
    """Code points as the inside of a character class."""
    runs: list[list[int]] = []
    for p in points:
        if runs and p == runs[-1][1] + 1:
            runs[-1][1] = p
        else:
            runs.append([p, p])
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs)


#: Hangul syllables, which decompose by arithmetic, and surrogates, which are no letters.
_SYLLABLES, _SURROGATES = range(0xAC00, 0xD7A4), range(0xD800, 0xE000)


@functools.cache
def _folds() -> tuple[str, str, str, list[str], list[str]]:
    """Letters that decompose to one plain letter with those letters, marks that vanish, and letters that become several with those."""
    forms = {c: d for p in range(0x80, sys.maxunicode + 1) if p not in _SYLLABLES and p not in _SURROGATES and (d := _plain_form(c := chr(p))) != c}
    one = [c for c, d in forms.items() if len(d) == 1]
    several = [c for c, d in forms.items() if len(d) > 1]
    return "".join(one), "".join(forms[c] for c in one), "".join(c for c, d in forms.items() if not d), several, [forms[c] for c in several]


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def computed(value: Column) -> Column:
    """``value`` as a column of a select that filters aren't pushed through: they would compute it again, and once for each condition."""
    return F.explode(F.array(value))


def _unjoined(text: Column) -> Column:
    """Each syllable as its two or three parts."""
    point = lambda n: F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")

    def parts(c: Column) -> Column:
        n = F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 10).cast("int") - 0xAC00
        tail = n % 28
        return F.concat(point(F.floor(n / 588) + 0x1100), point(F.floor(n % 588 / 28) + 0x1161), F.when(tail > 0, point(tail + 0x11A7)).otherwise(""))

    found = F.array_distinct(F.regexp_extract_all(text, F.lit("[\\x{ac00}-\\x{d7a3}]"), 0))
    return F.aggregate(found, text, lambda t, c: F.replace(t, c, parts(c)))


def fold(text: Column) -> Column:
    """Letters in their plain form: without accents, ligatures and wide or raised forms taken apart.

    One letter for one or none is a translation; letters that become several are
    looked up among the different ones that a text has, and once for each.  A
    class of many ranges costs each character that it is tried on all of them.
    """
    one, plain, marks, several, forms = _folds()
    letters, told = F.split(F.lit("\x1f".join(several)), "\x1f"), F.split(F.lit("\x1f".join(forms)), "\x1f")
    ascii_only = lambda t: t.isNull() | (F.octet_length(t) == F.length(t))
    strange = lambda t: F.array_join(F.array_distinct(F.split(F.regexp_replace(t, r"[\x00-\x7f]+", ""), "")), "")
    found = lambda t: F.regexp_extract_all(strange(t), F.lit(f"[{_ranges([ord(c) for c in several])}]"), 0)
    apart = lambda text: F.aggregate(found(text), text, lambda t, c: F.replace(t, c, F.get(told, (F.array_position(letters, c) - 1).cast("int"))))
    bare = lambda t: F.when(ascii_only(t), t).otherwise(F.translate(t, one + marks, plain))
    return once(text, lambda x: once(bare(x), lambda t: F.when(ascii_only(t), t).otherwise(_unjoined(apart(t)))))


#: What Unicode calls white space.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def stripped(text: Column) -> Column:
    """Without white space at both ends, which is all that is looked at."""
    return F.btrim(text, F.lit(SPACE))


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def _references() -> dict[str, str]:
    """Named character references of one letter or sign, from the standard library's table."""
    return {name: sign for name, sign in html5.items() if name.endswith(";") and name != "amp;"}


def unescaped(text: Column) -> Column:
    """Character references, named and numbered, as what they stand for; ``&amp;`` comes last, so nothing is decoded twice."""
    known = _references()
    names, signs = (F.split(F.lit("\x1f".join(x)), "\x1f") for x in (known, known.values()))  # two constants
    point = lambda digits, base: F.decode(F.unhex(F.lpad(F.conv(digits, base, 16), 8, "0")), "UTF-32")

    def sign(ref: Column) -> Column:
        number, hexadecimal = F.regexp_extract(ref, "^#([0-9]{1,7});$", 1), F.regexp_extract(ref, "(?i)^#x([0-9a-f]{1,6});$", 1)
        value = F.when(number != "", number.cast("long")).when(hexadecimal != "", F.conv(hexadecimal, 16, 10).cast("long"))
        good = value.between(1, 0xD7FF) | value.between(0xE000, 0x10FFFF)
        return F.when(good & (number != ""), point(number, 10)).when(good, point(hexadecimal, 16)).otherwise(F.get(signs, (F.array_position(names, ref) - 1).cast("int")))

    found = F.array_distinct(F.regexp_extract_all(text, F.lit("&(#?[a-zA-Z0-9]{1,40};)"), 1))
    decoded = F.aggregate(found, text, lambda t, ref: F.replace(t, F.concat(F.lit("&"), ref), F.coalesce(sign(ref), F.concat(F.lit("&"), ref))))
    return F.replace(F.when(F.contains(text, F.lit("&")), decoded).otherwise(text), F.lit("&amp;"), F.lit("&"))


def contains_any(text: Column, words) -> Column:
    """Whether any of ``words`` is a substring."""
    found = F.lit(False)
    for word in words:
        found = found | text.contains(word)
    return found


def tokens(text: Column) -> Column:
    """Technical tokens without stopwords, then the parts of compound ones."""
    telling = lambda t: ~t.isin(*V.STOPWORDS)
    parts = lambda kept: F.flatten(F.transform(F.filter(kept, lambda t: t.rlike("[-_./]")), lambda t: F.filter(F.split(t, "[-_./]"), lambda p: (p != "") & telling(p))))
    return once(F.filter(F.regexp_extract_all(fold(F.lower(text)), F.lit(V.TOKEN), 0), telling), lambda kept: F.concat(kept, parts(kept)))


def normal_name(name: Column) -> Column:
    """A name's key: folded, without punctuation and trailing legal forms; the lower-case name where nothing is left."""
    plain = F.trim(F.regexp_replace(fold(F.lower(name)), r"[^\p{L}\p{N}]+", " "))
    short = F.trim(F.regexp_replace(plain, rf"(?:(?:^| )(?:{'|'.join(V.LEGAL_SUFFIXES)})|(?<=\w) s a)+$", ""))
    return once(short, lambda s: F.when(s != "", s).otherwise(F.lower(F.trim(name))))


def normal_site(site: Column) -> Column:
    """A site's key: without scheme, ``www.`` and closing slashes; null where nothing is left."""
    bare = F.regexp_replace(F.lower(F.trim(site)), "^https://", "")
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, "^http://", ""), r"^www\.", ""), "/+$", "")
    return F.when(bare != "", bare)


def token_estimate(text: Column) -> Column:
    """The larger of characters / 4 and words x 1.3, rounded up; 0 for blank text."""

    def estimate(bare: Column) -> Column:
        words = F.size(F.split(bare, r"(?U)\s+"))
        most = F.greatest(F.ceil(F.length(bare) / F.lit(4.0)), F.ceil(words * F.lit(V.TOKENS_PER_WORD)))
        return F.when(bare == "", F.lit(0)).otherwise(most).cast("long")

    return once(stripped(text), estimate)


def citations(answer: Column) -> Column:
    """Distinct numbers in ``[n]`` marks, in order of appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(V.CITATION), 1), lambda n: n.cast("int")))


def unsupported_sentences(answer: Column) -> Column:
    """Sentences long enough to claim something that carry no mark and open no list or heading."""
    sentences = F.transform(F.split(F.trim(answer), r"(?<=[.!?])(?U)\s+"), F.trim)
    return F.filter(sentences, lambda s: (F.length(s) >= V.CLAIM_CHARS) & ~s.rlike("^[#*-]") & ~s.rlike(V.CITATION))


def category(text: Column) -> Column:
    """Product category of a folded lower-case text: the first whose word occurs."""

    def first(t: Column) -> Column:
        found = F.lit(None).cast("string")
        for name, words in reversed(V.CATEGORY_WORDS):
            found = F.when(contains_any(t, words), name).otherwise(found)
        return F.coalesce(found, F.lit(V.UNKNOWN))

    return once(text, first)


def provider_key(text: Column, provider: Column) -> Column:
    """Key of the price table: null for own models, else the first named, else unknown for users of outside models."""

    def first(t: Column) -> Column:
        found = F.when(provider.isin("api_externa", "open_weights_hospedado"), V.UNKNOWN)
        for name, words in reversed(V.PROVIDER_WORDS):
            found = F.when(contains_any(t, words), name).otherwise(found)
        return found

    return F.when(F.coalesce(provider, F.lit("")).isin("self_hosted", "modelo_proprio"), F.lit(None).cast("string")).otherwise(once(text, first))


def tech_mentions(text: Column) -> Column:
    """Terms of the vocabulary that the text has as whole words."""
    low = F.lower(text)
    return F.filter(F.array(*map(F.lit, V.TECH_TERMS)), lambda t: F.rlike(low, F.concat(F.lit(r"(?U)(?<![\w-])\Q"), t, F.lit(r"\E(?![\w-])"))))


def excerpt_hash(url: Column, excerpt: Column) -> Column:
    """Identity of a piece of evidence."""
    return F.substring(F.sha2(F.concat_ws("|", url, excerpt), 256), 1, 16)


def chunk_id(url: Column, text: Column) -> Column:
    """Identity of a chunk."""
    return F.substring(F.sha2(F.concat_ws("|", url, text), 256), 1, 24)


def uuid5(namespace: str, name: Column) -> Column:
    """Version 5 UUID of ``name`` in a namespace given as hexadecimal digits."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "utf-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    whole = F.concat(F.substring(digest, 1, 12), F.lit("5"), F.substring(digest, 14, 3), variant, F.substring(digest, 18, 15))
    return F.concat_ws("-", *(F.substring(whole, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def fingerprint(model: Column, temperature: Column, params: Column, messages: Column) -> Column:
    """Identity of a call to a model: its name, temperature, parameters (a map of written values) by name, and messages (role, content) in order."""
    said = F.array_join(F.transform(F.array_sort(F.map_entries(params)), lambda p: F.concat(p["key"], F.lit("="), p["value"], F.lit(";"))), "")
    spoken = F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit("\x00"), m["content"], F.lit("\x01"))), "")
    return F.sha2(F.concat(model, F.format_string("|%.4f|", temperature.cast("double")), F.coalesce(said, F.lit("")), spoken), 256)


def enforced(answer: Column, n_chunks: Column) -> Column:
    """``answer``, if it cites only the chunks that there are and leaves no claim without citation; else an error."""
    invalid = F.filter(citations(answer), lambda i: (i < 1) | (i > n_chunks))
    bare = unsupported_sentences(answer)
    wrong = F.when(F.size(invalid) > 0, F.format_string("cites %s of %s chunks", F.array_join(invalid.cast("array<string>"), ", "), n_chunks)).when(F.size(bare) > 0, F.format_string("%s claims without citation: %s", F.size(bare), F.substring(F.get(bare, F.lit(0)), 1, 120)))
    return F.when(wrong.isNull(), answer).otherwise(F.raise_error(wrong).cast("string"))


def literal(excerpt: Column, source: Column) -> Column:
    """``excerpt`` squeezed and cut, if it is long enough and stands in its source word for word, whatever the case; else an error."""
    clean = F.substring(squeeze(excerpt), 1, V.EXCERPT_MOST)
    wrong = F.when(F.length(clean) < V.EXCERPT_LEAST, F.concat(F.lit("excerpt too short: "), clean)).when(source.isNotNull() & ~F.contains(F.lower(squeeze(source)), F.lower(clean)), F.lit("excerpt not in its source"))
    return F.when(wrong.isNull(), clean).otherwise(F.raise_error(wrong).cast("string"))
