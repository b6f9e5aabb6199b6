"""English stemming by the published Snowball rules, and the analyzer that uses it."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, functions as F

# Irregular words, words that stay, and words that stop after the first step, as published.
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl",
}
UNCHANGED = ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")
STOP_AFTER_1A = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
# Suffixes of the second, third and fourth step and what they become.
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate",
    "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous",
    "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
#: Regions: after the first consonant that follows a vowel, or after one of three prefixes.
REGION = "^(?:gener|commun|arsen|.*?[aeiouy][^aeiouy])"
SHORT_SYLLABLE = "(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$"


def suffixes(words: object) -> str:
    """A pattern of the longest of these suffixes."""
    return f"(?:{'|'.join(sorted(words, key=lambda s: (-len(s), s)))})$"


_PATTERNS = {name: re.compile(suffixes(words), re.S) for name, words in (("1a", ("sses", "ied", "ies", "us", "ss", "s")), ("1b", ("eedly", "ingly", "edly", "eed", "ing", "ed")), ("2", STEP_2), ("3", STEP_3), ("4", STEP_4))}
_REGION, _SHORT = re.compile(REGION, re.S), re.compile(SHORT_SYLLABLE, re.S)
_VOWEL = re.compile("[aeiouy]")


def _region(word: str, start: int) -> int:
    found = _REGION.match(word) if start == 0 else re.match("^.*?[aeiouy][^aeiouy]", word[start:], re.S)
    return start + found.end() if found else len(word)


def _cut(word: str, step: str) -> tuple[str, str]:
    found = _PATTERNS[step].search(word)
    return (word[: found.start()], found[0]) if found else (word, "")


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters stay."""
    if len(word) <= 2 or word in UNCHANGED:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    word = re.sub("([aeiouy])y", r"\1Y", re.sub("^y", "Y", word.removeprefix("'")))
    r1 = _region(word, 0)
    r2 = _region(word, r1)
    for ending in ("'s'", "'s", "'"):
        if word.endswith(ending):
            word = word[: -len(ending)]
            break
    head, tail = _cut(word, "1a")
    if tail == "sses":
        word = head + "ss"
    elif tail in ("ied", "ies"):
        word = head + ("i" if len(head) > 1 else "ie")
    elif tail == "s" and _VOWEL.search(head[:-1]):
        word = head
    if word in STOP_AFTER_1A:
        return word
    head, tail = _cut(word, "1b")
    if tail.startswith("eed"):
        word = head + "ee" if len(head) >= r1 else word
    elif tail and _VOWEL.search(head):
        word = head
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")):
            word = word[:-1]
        elif r1 >= len(word) and _SHORT.search(word):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"
    head, tail = _cut(word, "2")
    if tail and len(head) >= r1 and (tail != "ogi" or head.endswith("l")) and (tail != "li" or head.endswith(tuple("cdeghkmnrt"))):
        word = head + STEP_2[tail]
    head, tail = _cut(word, "3")
    if tail and len(head) >= (r2 if tail == "ative" else r1):
        word = head + STEP_3[tail]
    head, tail = _cut(word, "4")
    if tail and len(head) >= r2 and (tail != "ion" or head.endswith(("s", "t"))):
        word = head
    head = word[:-1]
    if word.endswith("e") and (len(head) >= r2 or (len(head) >= r1 and not _SHORT.search(head))):
        word = head
    elif word.endswith("ll") and len(head) >= r2:
        word = head
    return word.replace("Y", "y")


def stems(words: Column) -> Column:
    """Stems of an array of words.  Each distinct word of a batch is stemmed once: a batch's words are dictionary-encoded."""

    @F.arrow_udf("array<string>")
    def work(lists: pa.Array) -> pa.Array:
        coded = lists.flatten().dictionary_encode()
        known = pa.array([stem(w) for w in coded.dictionary.to_pylist()], pa.string())
        ends = pa.compute.fill_null(pa.compute.list_value_length(lists), 0)
        offsets = pa.concat_arrays([pa.array([0], pa.int32()), pa.compute.cumulative_sum(ends).cast(pa.int32())])
        return pa.ListArray.from_arrays(offsets, known.take(coded.indices), mask=lists.is_null())

    return work(words)


def stemmed_tokens(text: Column, stop_words: tuple[str, ...]) -> Column:
    """The second analyzer: lower case, runs of letters and digits, stems, then stop words off."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.filter(stems(words), lambda w: ~w.isin(*stop_words))


def _case(values: dict[str, str]) -> str:
    return "CASE s " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in values.items()) + " END"


def _listed(words: object) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _step(name: str, source: str, pattern: str, result: str) -> str:
    """A CTE of one step: ``s`` is the suffix found, ``h`` what stands before it."""
    return (
        f"{name} AS (SELECT w, r1, r2, done, CASE WHEN done THEN x ELSE {result} END AS x FROM "
        f"(SELECT *, regexp_extract(x, '{pattern}') AS s, left(x, length(x) - length(regexp_extract(x, '{pattern}'))) AS h FROM {source}))"
    )


def stem_sql(source: str) -> str:
    """CTEs of ``stemmed(w, stem)`` for the words ``w`` of the table ``source``, in DuckDB: the same rules as patterns on columns."""
    undouble = (
        f"CASE WHEN regexp_matches(h, '(at|bl|iz)$') THEN h || 'e' WHEN regexp_matches(h, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN left(h, length(h) - 1) "
        f"WHEN r1 >= length(h) AND regexp_matches(h, '{SHORT_SYLLABLE}') THEN h || 'e' ELSE h END"
    )
    irregular = "CASE w " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in IRREGULAR.items()) + " ELSE w END"
    return ", ".join(
        [
            rf"marked AS (SELECT w, regexp_replace(regexp_replace(w, '^y', 'Y'), '([aeiouy])y', '\1Y', 'g') AS x FROM {source})",
            f"first_region AS (SELECT w, x, CASE WHEN regexp_matches(x, '{REGION}') THEN length(regexp_extract(x, '{REGION}')) ELSE length(x) END AS r1 FROM marked)",
            "second_region AS (SELECT w, x, r1, CASE WHEN regexp_matches(substr(x, r1 + 1), '^.*?[aeiouy][^aeiouy]') THEN r1 + length(regexp_extract(substr(x, r1 + 1), '^.*?[aeiouy][^aeiouy]')) "
            f"ELSE length(x) END AS r2, length(w) <= 2 OR w IN {_listed(UNCHANGED)} OR w IN {_listed(IRREGULAR)} AS done FROM first_region)",
            f"s0 AS (SELECT w, r1, r2, done, CASE WHEN done THEN {irregular} ELSE x END AS x FROM second_region)",
            _step("s1a", "s0", suffixes(("sses", "ied", "ies", "us", "ss", "s")), "CASE WHEN s = 'sses' THEN h || 'ss' WHEN s IN ('ied', 'ies') THEN h || CASE WHEN length(h) > 1 THEN 'i' ELSE 'ie' END WHEN s = 's' AND regexp_matches(h, '[aeiouy].') THEN h ELSE x END"),
            f"s1x AS (SELECT w, r1, r2, done OR x IN {_listed(STOP_AFTER_1A)} AS done, x FROM s1a)",
            _step("s1b", "s1x", suffixes(("eedly", "ingly", "edly", "eed", "ing", "ed")), f"CASE WHEN s IN ('eed', 'eedly') THEN CASE WHEN length(h) >= r1 THEN h || 'ee' ELSE x END WHEN s <> '' AND regexp_matches(h, '[aeiouy]') THEN {undouble} ELSE x END"),
            _step("s1c", "s1b", "[yY]$", "CASE WHEN s <> '' AND regexp_matches(h, '.[^aeiouy]$') THEN h || 'i' ELSE x END"),
            _step("s2", "s1c", suffixes(STEP_2), f"CASE WHEN s <> '' AND length(h) >= r1 AND (s <> 'ogi' OR regexp_matches(h, 'l$')) AND (s <> 'li' OR regexp_matches(h, '[cdeghkmnrt]$')) THEN h || {_case(STEP_2)} ELSE x END"),
            _step("s3", "s2", suffixes(STEP_3), f"CASE WHEN s <> '' AND length(h) >= CASE WHEN s = 'ative' THEN r2 ELSE r1 END THEN h || {_case(STEP_3)} ELSE x END"),
            _step("s4", "s3", suffixes(STEP_4), "CASE WHEN s <> '' AND length(h) >= r2 AND (s <> 'ion' OR regexp_matches(h, '[st]$')) THEN h ELSE x END"),
            _step("s5", "s4", "(?:e|l)$", f"CASE WHEN s = 'e' AND (length(h) >= r2 OR (length(h) >= r1 AND NOT regexp_matches(h, '{SHORT_SYLLABLE}'))) THEN h WHEN s = 'l' AND length(h) >= r2 AND regexp_matches(h, 'l$') THEN h ELSE x END"),
            "stemmed AS (SELECT w, CASE WHEN done THEN x ELSE replace(x, 'Y', 'y') END AS stem FROM s5)",
        ]
    )
