"""Merging rows of several sources with provenance, and group-guarded filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import shuffled


def merge_by_precedence(text: DataFrame, structured: DataFrame, keys: list[str], prefer: list[str], fill: list[str]) -> DataFrame:
    """Full outer join of two sources on keys. prefer: columns where the structured value wins unless null or empty; fill: columns
    where the text's wins. source: both, text or structured."""
    kinds = dict(text.dtypes)

    def given(c: Column, name: str) -> Column:
        return F.when(F.size(c) > 0, c) if kinds[name].startswith("array") else c

    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    both = text.withColumn("__a", F.lit(1)).alias("a").join(structured.withColumn("__b", F.lit(1)).alias("b"), on, "full")
    columns = [F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys]
    columns += [F.coalesce(given(F.col(f"b.{c}"), c), F.col(f"a.{c}")).alias(c) for c in prefer]
    columns += [F.coalesce(given(F.col(f"a.{c}"), c), F.col(f"b.{c}")).alias(c) for c in fill]
    source = F.when(F.col("a.__a").isNotNull() & F.col("b.__b").isNotNull(), "both").when(F.col("a.__a").isNotNull(), "text").otherwise("structured")
    return both.select(*columns, source.alias("source"))


def append_new_only(base: DataFrame, more: DataFrame, number: str, name: str) -> DataFrame:
    """base and those rows of more of which neither the number nor the lower-case name is in base."""
    new = more.join(base.select(number).where(F.col(number).isNotNull()).distinct(), number, "left_anti")
    names = base.select(F.lower(name).alias("__name")).distinct()
    new = new.withColumn("__name", F.lower(name)).join(names, "__name", "left_anti").drop("__name")
    return base.unionByName(new.select(*base.columns))


def missing_numbers(seen: DataFrame, covered: DataFrame, keys: list[str]) -> DataFrame:
    return seen.select(*keys).distinct().join(covered.select(*keys).distinct(), keys, "left_anti")


def skeleton_rows(base: DataFrame, extra: DataFrame, key: str | list[str], value: str) -> DataFrame:
    """base with the value of extra by key, and rows of key and value alone for keys that only extra has. Null keys are equal."""
    keys = [key] if isinstance(key, str) else key
    same = reduce(lambda a, b: a & b, (F.col(f"b.{k}").eqNullSafe(F.col(f"e.{k}")) for k in keys))
    kept, given = base.drop(value), extra.select(*keys, value)
    joined = kept.alias("b").join(shuffled(given).alias("e"), same, "left").select("b.*", f"e.{value}")
    only = given.alias("e").join(shuffled(base.select(*keys).distinct()).alias("b"), same, "left_anti")
    return joined.unionByName(only, allowMissingColumns=True)


def guarded_drop(df: DataFrame, group: list[str], guard: Column, drop: Column) -> DataFrame:
    """In groups where guard holds for any row, rows with drop go."""
    there = F.max(F.when(guard, 1).otherwise(0)).over(Window.partitionBy(*group))
    return df.withColumn("__there", there).where((F.col("__there") == 0) | ~F.coalesce(drop, F.lit(False))).drop("__there")


def drop_support_roles(df: DataFrame, doc: str, role: str) -> DataFrame:
    low = F.lower(role)
    return guarded_drop(df, [doc], F.contains(low, F.lit("especialista")), F.contains(low, F.lit("asistente")))


def dedupe_keep_first(df: DataFrame, key: list[Column], valid: Column, order: list[Column]) -> DataFrame:
    """The first row of each key; rows whose key is not valid all stay."""
    names = [f"__k{i}" for i in range(len(key))]
    tagged = df.withColumns(dict(zip(names, key))).withColumn("__valid", F.coalesce(valid, F.lit(False)))
    first = tagged.where("__valid").withColumn("__n", F.row_number().over(Window.partitionBy(*names).orderBy(*order))).where("__n = 1").drop("__n")
    return first.unionByName(tagged.where("not __valid")).drop(*names, "__valid")


def merge_duplicates(df: DataFrame, key: list[str], longest: list[str] = (), largest: list[str] = (), lists: list[str] = (), trusted: str | None = None) -> DataFrame:
    """One row a key: the longest text, the largest number, the longest list (ties to the smaller value); values of trusted rows,
    where they have one, come before all others."""

    def best(c: str, size: Column) -> Column:
        pick = lambda cond: F.max_by(F.when(cond, F.col(c)), F.when(cond & F.col(c).isNotNull(), F.struct(size, F.hash(c))))
        return F.coalesce(pick(F.col(trusted)), pick(F.lit(True))) if trusted else pick(F.lit(True))

    out = [best(c, F.length(c)).alias(c) for c in longest] + [best(c, F.col(c).cast("double")).alias(c) for c in largest] + [best(c, F.size(c)).alias(c) for c in lists]
    return df.groupBy(*key).agg(*out, F.count(F.lit(1)).alias("n_merged"))


def copied_signatures(df: DataFrame, group: list[str], signature: list[Column], row: str) -> DataFrame:
    """Groups of two or more rows with equal signatures: group, signature, n, first (the least row)."""
    return df.groupBy(*group, F.concat_ws("|", *signature).alias("signature")).agg(F.count(F.lit(1)).alias("n"), F.min(row).alias("first")).where("n >= 2")


def longer_source_wins(rows: DataFrame, keys: list[str], source: str) -> DataFrame:
    """The rows of the source that has more of them for a key; ties to the first source by name."""
    counts = rows.groupBy(*keys, source).agg(F.count(F.lit(1)).alias("__n"))
    order = Window.partitionBy(*keys).orderBy(F.desc("__n"), source)
    best = counts.withColumn("__r", F.row_number().over(order)).where("__r = 1").select(*keys, source)
    return rows.join(best, [*keys, source], "left_semi")


def synthesize_if_empty(parents: DataFrame, children: DataFrame, key: str, made: dict[str, Column]) -> DataFrame:
    """children, and for each parent without any one row made from its own columns."""
    lone = parents.join(children.select(key).distinct(), key, "left_anti").select(key, *(v.alias(k) for k, v in made.items()))
    return children.select(key, *made).unionByName(lone)


def accept_source(rows: DataFrame, doc: str, source: str, expected: str, titles: str, roles: str) -> DataFrame:
    """Per document and source: rows, share with titles and roles, accepted (at least 80 % of the expected rows and 70 % of either)."""
    share = lambda c: F.avg((F.size(c) > 0).cast("double"))
    out = rows.groupBy(doc, source).agg(F.count(F.lit(1)).alias("rows"), F.max(expected).alias("expected"), share(titles).alias("with_titles"), share(roles).alias("with_roles"))
    return out.withColumn("accepted", (F.col("rows") >= 0.8 * F.col("expected")) & (F.greatest("with_titles", "with_roles") >= 0.7))


def first_accepted_source(rows: DataFrame, accepted: DataFrame, doc: str, source: str, order: list[str]) -> DataFrame:
    """Rows of the first source, in order, that is accepted for a document."""
    rank = F.array_position(F.array(*(F.lit(s) for s in order)), F.col(source))
    best = accepted.where("accepted").groupBy(doc).agg(F.min_by(source, rank).alias(source))
    return rows.join(best, [doc, source], "left_semi")


def attach_generic(df: DataFrame, own: str, generic: DataFrame, group: str, value: str) -> DataFrame:
    """Rows without a value of their own get the group's generic one."""
    return df.join(generic.select(group, F.col(value).alias("__generic")), group, "left").withColumn(own, F.coalesce(own, "__generic")).drop("__generic")


def union_ignoring_case(a: Column, b: Column) -> Column:
    """Values of a, then those of b that differ from all of them by more than case."""
    from ..functions.text import distinct_ignoring_case

    return distinct_ignoring_case(F.concat(F.coalesce(a, F.array()), F.coalesce(b, F.array())))
