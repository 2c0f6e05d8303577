"""Text functions as Spark expressions."""

from __future__ import annotations

import functools
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed


def n_tokens(c: Column) -> Column:
    """A quarter of the characters, 1 at least."""
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("int")


def first_tokens(c: Column, n: Column | int) -> Column:
    return F.substring(c, F.lit(1), F.lit(4) * (n if isinstance(n, Column) else F.lit(n)))


def terms(c: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda t: t != "")


def each(df: DataFrame, keep: list, values: Column, name: str) -> DataFrame:
    """``keep`` and a row for each of ``values``, none of which is null. Beside a plain explode Spark filters by the array's size
    where the rows come from, and so works the array out twice; an outer one has no such filter."""
    return df.select(*keep, F.explode_outer(values).alias(name)).where(F.col(name).isNotNull())


def camel_parts(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2"))


def identifiers(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(fixed.IDENTIFIER), F.lit(0))


def table_lookup(tokens: Column, table: dict[str, list[str]], keep=lambda w: True, low: bool = False) -> Column:
    """For each token in turn the words that a fixed table has for it."""
    pairs = [x for k, ws in table.items() for x in (F.lit(k), F.array(*[F.lit(w.lower() if low else w) for w in ws if keep(w)]))]
    mapped = F.create_map(*pairs)
    return F.flatten(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(mapped, t), F.array().cast("array<string>"))))


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def expand(query: Column) -> Column:
    """The query, then dictionary words of its words and the parts of its identifiers, each once."""
    parts = F.filter(F.transform(identifiers(query), lambda i: F.when(camel_parts(i) != F.lower(i), camel_parts(i))), lambda p: p.isNotNull())
    more = F.array_distinct(F.concat(table_lookup(words(F.lower(query)), fixed.EXPANSIONS), parts))
    return F.when(F.size(more) > 0, F.concat(query, F.lit(" "), F.array_join(more, " "))).otherwise(query)


def query_terms(query: Column, most: int = fixed.TERMS) -> Column:
    """Search terms: identifiers as they are, their parts, plain words that aren't stop
    words, synonyms of one word; without any, all words. Each once, ``most`` at most."""
    found = identifiers(query)
    parts = F.flatten(F.transform(found, lambda i: F.split(camel_parts(i), " ")))
    bare = F.regexp_replace(query, "[^a-zA-Z0-9_]", " ")
    plain = F.transform(F.filter(words(bare), lambda w: (~F.lower(w).isin(fixed.STOP_WORDS)) & (F.length(w) > 2)), F.lower)
    every = F.array_distinct(F.concat(found, parts, plain, table_lookup(plain, fixed.SYNONYMS, lambda w: " " not in w, low=True)))
    return F.slice(F.when(F.size(every) > 0, every).otherwise(words(F.regexp_replace(query, "[^a-zA-Z0-9 ]", " "))), 1, most)


def file_type(path: Column) -> Column:
    """By the first part of the path with a hint in it, else by the file's name."""
    parts = F.split(F.lower(F.regexp_replace(path, r"\\", "/")), "/")

    def of(part: Column) -> Column:
        out = None
        for hint, kind in fixed.TYPE_HINTS:
            out = F.when(part.contains(hint), kind) if out is None else out.when(part.contains(hint), kind)
        return out

    hinted = F.get(F.filter(F.transform(parts, of), lambda x: x.isNotNull()), 0)
    return F.coalesce(hinted, F.when(F.element_at(parts, -1).startswith("use"), "HOOK").otherwise("UTIL"))


def language(path: Column) -> Column:
    ext = F.when(path.contains("."), F.element_at(F.split(path, r"\."), -1)).otherwise("js")
    out = F.when(ext == "ts", fixed.LANGUAGES["ts"])
    for k, v in fixed.LANGUAGES.items():
        out = out.when(ext == k, v)
    return out.otherwise(ext)


def symbols(name: Column, text: Column) -> Column:
    """Name, hook calls, tags and camel-case calls, each once, without noise words."""
    take = lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(1))
    calls = F.filter(take(fixed.CAMEL_CALL), lambda t: F.substring(t, F.lit(2), F.length(t)).rlike("[A-Z]"))
    every = F.concat(F.when(name.isNotNull(), F.array(name)).otherwise(F.array().cast("array<string>")), take(fixed.HOOK_CALL), take(fixed.JSX_TAG), calls)
    return F.array_distinct(F.filter(every, lambda t: (F.length(t) >= fixed.MIN_SYMBOL) & ~t.isin(fixed.NOISE)))


def summary(kind: Column, name: Column, text: Column) -> Column:
    line = F.substring(F.get(F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), "\n"), 0), 1, 80)
    return F.concat(kind, F.lit(" `"), F.coalesce(name, F.lit("")), F.lit("` — "), line)


def count_matches(c: Column, patterns: Iterable[str], ignore_case: bool = False) -> Column:
    """How many of the patterns occur."""
    out = F.lit(0)
    for p in patterns:
        out = out + F.when(c.rlike(("(?i)" if ignore_case else "") + p), 1).otherwise(0)
    return out


def id_of(*parts: Column) -> Column:
    return F.sha1(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def valid_text(content: Column) -> Column:
    return F.make_valid_utf8(content.cast("string"))


#: Endings and what they become, by step, the first that matches first.
_STEP_2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
_ENDS_2, _ENDS_3 = tuple(_STEP_2), tuple(_STEP_3)


def _shape(w: str) -> str:
    """c or v for each letter; y is a vowel after a consonant. A beginning's shape is the beginning of the shape."""
    out, last = [], "v"
    for c in w:
        last = "v" if c in "aeiou" or c == "y" and last == "c" and out else "c"
        out.append(last)
    return "".join(out)


@functools.lru_cache(maxsize=1 << 17)
def porter(word: str) -> str:
    """Porter's stemmer (1980)."""
    if len(word) <= 2:
        return word
    w = word
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: len(w) - len(end)] + new
            break
    shape = _shape(w)
    if w.endswith("eed"):
        w = w[:-1] if shape[:-3].count("vc") > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and "v" in shape[: -len(end)]:
                w = w[: -len(end)]
                own = shape[: len(w)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and own[-1] == "c" and w[-1] not in "lsz":
                    w = w[:-1]
                elif own.count("vc") == 1 and len(w) > 2 and own.endswith("cvc") and w[-1] not in "wxy":
                    w += "e"
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table, ends in ((_STEP_2, _ENDS_2), (_STEP_3, _ENDS_3)):
        if w.endswith(ends):
            end = next(e for e in ends if w.endswith(e))
            if _shape(w[: -len(end)]).count("vc") > 0:
                w = w[: -len(end)] + table[end]
    if w.endswith(_STEP_4):
        end = next(e for e in _STEP_4 if w.endswith(e))
        stem = w[: -len(end)]
        if (end != "ion" or stem.endswith(("s", "t"))) and _shape(stem).count("vc") > 1:
            w = stem
    if w.endswith("e"):
        own = _shape(w[:-1])
        n = own.count("vc")
        if n > 1 or n == 1 and not (len(own) > 2 and own.endswith("cvc") and w[-2] not in "wxy"):
            w = w[:-1]
    if w.endswith("ll") and _shape(w[:-1]).count("vc") > 1:
        w = w[:-1]
    return w


def stems():
    """A function of a list of terms: their stems. Each distinct term is stemmed once a batch."""

    @F.arrow_udf("array<string>")
    def stem(lists: pa.Array) -> pa.Array:
        coded = lists.flatten().dictionary_encode()
        found = pa.array([porter(w) if w else w for w in coded.dictionary.to_pylist()], pa.string())
        offsets = pa.array([0, *pc.cumulative_sum(pc.fill_null(pc.list_value_length(lists), 0)).to_pylist()], pa.int32())
        return pa.ListArray.from_arrays(offsets, found.take(coded.indices))

    return stem


def counted_stems(c: Column, stemmer=porter) -> Column:
    """How many terms (``terms``) a text has, and its stems (without ``stemmer`` the terms) with their counts. Texts go to Python as strings, with a space
    between terms, and only distinct stems come back: lists of all terms would be gone through one by one, several times."""

    @F.arrow_udf("struct<n:bigint,terms:array<struct<term:string,w:int>>>")
    def count(texts: pa.Array) -> pa.Array:
        lists = pc.split_pattern(texts, " ")
        coded = lists.flatten().dictionary_encode()
        stem = (pa.array([stemmer(w) if w else w for w in coded.dictionary.to_pylist()], pa.string()) if stemmer else coded.dictionary).dictionary_encode()
        code, row = np.asarray(stem.indices)[np.asarray(coded.indices)], np.repeat(np.arange(len(texts)), np.asarray(pc.list_value_length(lists)))
        some = np.asarray(pc.not_equal(stem.dictionary, "").to_numpy(zero_copy_only=False), bool)[code]
        code, row = code[some], row[some]
        keys, w = np.unique(row * max(1, len(stem.dictionary)) + code, return_counts=True)
        ends = np.searchsorted(keys, np.arange(len(texts) + 1) * max(1, len(stem.dictionary)))
        found = pa.StructArray.from_arrays([stem.dictionary.take(pa.array(keys % max(1, len(stem.dictionary)))), pa.array(w, pa.int32())], ["term", "w"])
        return pa.StructArray.from_arrays([pa.array(np.bincount(row, minlength=len(texts)), pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)], ["n", "terms"])

    return count(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))
