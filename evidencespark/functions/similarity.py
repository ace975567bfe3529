"""Similarity and three-valued matching of texts, titles, roles, sectors and actions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import ACTIONS, ROLE_SYNONYMS, SECTORS
from .fuzzy import indel_ratio, partial_ratio, token_set_ratio  # noqa: F401
from .text import gender_neutral, normalize_text, strip_accents, synonym_form, words


def tokens(c: Column) -> Column:
    """Distinct upper-case words without accents."""
    return F.array_distinct(words(F.regexp_replace(F.upper(strip_accents(F.coalesce(c, F.lit("")))), r"(?U)[^\w\s]", " ")))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets in arrays; 0 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def token_jaccard(a: Column, b: Column) -> Column:
    return jaccard(tokens(a), tokens(b))


def word_overlap(a: Column, b: Column) -> Column:
    """Shared words by the larger number of words."""
    x, y = tokens(a), tokens(b)
    most = F.greatest(F.size(x), F.size(y))
    return F.when(most == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / most)


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """0 to 1: one less the edit distance by the longer length."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def sorted_words(c: Column) -> Column:
    """Words without accents, in lower case and in order."""
    return F.concat_ws(" ", F.array_sort(words(F.lower(strip_accents(c)))))


def token_sort_ratio(a: Column, b: Column) -> Column:
    """0 to 1: indel ratio of the words in order."""
    return indel_ratio(sorted_words(a), sorted_words(b))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use names it."""
    return F.get(F.transform(F.array(value), use), 0)


def _contained(a: Column, b: Column) -> Column:
    """Either contains the other; blank texts contain nothing."""
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


def _padded(c: Column) -> Column:
    return F.concat(F.lit(" "), c, F.lit(" "))


def synonym_groups(role: Column, as_coded: bool = False) -> Column:
    """Numbers of the groups of synonyms that a role belongs to: by containment as whole words (or any substring, as_coded)."""
    table = F.array(*(F.struct(F.lit(i).alias("group"), F.lit(s if as_coded else f" {s} ").alias("word")) for i, group in enumerate(ROLE_SYNONYMS) for s in group))

    def hits(form: Column) -> Column:
        found = F.filter(table, lambda t: (F.lit(as_coded) | (F.trim(form) != "")) & (F.contains(form, t["word"]) | F.contains(t["word"], form)))
        return F.array_distinct(F.transform(found, lambda t: t["group"]))

    return bound(synonym_form(role) if as_coded else _padded(synonym_form(role)), hits)


def synonym_members(role: Column, share: float = 0.6) -> Column:
    """Synonyms of which a role has at least the share of words."""
    every = F.array(*(F.lit(s) for group in ROLE_SYNONYMS for s in group))
    return bound(words(synonym_form(role)), lambda own: F.filter(every, lambda s: F.size(F.array_intersect(own, F.split(s, " "))) >= share * F.size(F.split(s, " "))))


def same_synonym_group(a: Column, b: Column, as_coded: bool = False) -> Column:
    return F.arrays_overlap(synonym_groups(a, as_coded), synonym_groups(b, as_coded)) | F.arrays_overlap(synonym_members(a), synonym_members(b))


def match_title(title: Column, accepted: Column) -> Column:
    """Nothing demanded: true. No title: false. Else equality apart from gender."""
    own = gender_neutral(title)
    return F.when(F.coalesce(F.size(accepted), F.lit(0)) <= 0, F.lit(True)).when(title.isNull(), F.lit(False)).otherwise(F.coalesce(F.exists(accepted, lambda x: gender_neutral(x) == own), F.lit(False)))


def match_role(role: Column, accepted: Column) -> Column:
    """Nothing demanded: true. No role: false. Else equality or containment of normalised forms, or a group of synonyms in common."""
    mine = F.struct(normalize_text(role).alias("form"), synonym_groups(role).alias("groups"))
    close = bound(mine, lambda m: F.exists(accepted, lambda x: bound(normalize_text(x), lambda n: (n == m["form"]) | _contained(n, m["form"])) | F.arrays_overlap(synonym_groups(x), m["groups"])))
    return F.when(F.coalesce(F.size(accepted), F.lit(0)) <= 0, F.lit(True)).when(role.isNull(), F.lit(False)).otherwise(F.coalesce(close, F.lit(False)))


def _first_key(c: Column, table: dict[str, tuple[str, ...]], as_coded: bool) -> Column:
    """The first key, in order, one of whose words is in the text: as whole words, or (as_coded) as any substring of normalised forms."""
    plain = lambda s: f" {s.replace('.', ' ').strip()} "
    rules = F.array(*(F.struct(F.lit(k).alias("key"), (normalize_text(F.lit(s)) if as_coded else F.lit(plain(s))).alias("word")) for k, group in table.items() for s in group))
    text = normalize_text(c) if as_coded else _padded(synonym_form(c))
    return bound(text, lambda t: F.get(F.filter(rules, lambda r: F.contains(t, r["word"])), 0)["key"])


def infer_sector(c: Column, as_coded: bool = False) -> Column:
    return _first_key(c, SECTORS, as_coded)


def infer_action(c: Column, as_coded: bool = False) -> Column:
    return _first_key(c, ACTIONS, as_coded)


def _three_valued(value: Column, wanted: Column, infer: Callable[[Column], Column]) -> Column:
    both = F.struct(normalize_text(value).alias("v"), normalize_text(wanted).alias("w"), infer(value).alias("i"), infer(wanted).alias("j"))
    known = bound(both, lambda b: F.when(_contained(b["v"], b["w"]), F.lit(True)).otherwise(b["i"] == b["j"]))
    return F.when(F.trim(F.coalesce(wanted, F.lit(""))) == "", F.lit(True)).when(F.trim(F.coalesce(value, F.lit(""))) == "", F.lit(None).cast("boolean")).otherwise(known)


def find_sector(c: Column) -> Column:
    """The sector that a text names by its own name, else the one inferred."""
    names = F.array(*(F.lit(k) for k in SECTORS))
    return F.coalesce(bound(normalize_text(c), lambda t: F.get(F.filter(names, lambda k: k == t), 0)), infer_sector(c))


def match_sector(value: Column, wanted: Column) -> Column:
    """True, false, or null where a sector is not known."""
    return _three_valued(value, wanted, find_sector)


def match_action(value: Column, wanted: Column) -> Column:
    """As match_sector; any action will do where the demand says that it does not matter."""
    return F.when(F.contains(normalize_text(wanted), F.lit("no importa")), F.lit(True)).otherwise(_three_valued(value, wanted, infer_action))
