"""Where the rows of a requirement table begin in a text: lines that name a role, numbers next to a role's words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fuzzy import indel_ratio
from ..functions.text import strip_accents
from ..rules import ROLE_CATALOGUE
from ..shared import shuffled, stored
from .assign import similar_candidates

ANCHOR_RATIO, ANCHOR_CHARS = 92.0, (8, 200)
SHORT_WORD = 3
#: Blanks and bars that may lie between a number and a word, and the numbers that rows have.
NUMBER_GAP, NUMBERS = 30, (1, 30)


def catalogue(spark: SparkSession, roles: tuple[str, ...] = ROLE_CATALOGUE) -> DataFrame:
    return spark.createDataFrame(list(enumerate(roles)), "position int, role string")


def upper_plain(c: Column) -> Column:
    """Capitals, no accents, single blanks."""
    return F.trim(F.regexp_replace(F.upper(strip_accents(F.coalesce(c, F.lit("")))), r"\s+", " "))


def row_anchors(lines: DataFrame, roles: DataFrame, text: str, ratio: float = ANCHOR_RATIO) -> DataFrame:
    """lines with anchor: of the roles (position, role) whose token-set ratio with the line is at least ratio, the best; of equal ones the
    longest, then the first. Lines of under 8 or over 200 letters have none. Distinct lines meet roles in two indexes: by shared words,
    where words of up to SHORT_WORD letters count only if they make up the most of a line or role (else they can't reach the ratio), and by
    rare letters, for lines that are a role but for a few of them. Only lines and roles of about one length are compared letter by letter."""
    if ratio < 80:
        raise ValueError("the indexes leave out no role only for ratios of 80 or more")
    own = lines.select(upper_plain(F.col(text)).alias("line")).where(F.length("line").between(*ANCHOR_CHARS)).distinct()
    parts = lambda c: F.array_sort(F.array_distinct(F.filter(F.split(c, " "), lambda w: w != "")))
    share = ratio / (200 - ratio)  # the shared words' letters by those of the shorter side, at the ratio
    mostly_short = lambda words, whole: F.length(F.array_join(F.filter(words, lambda w: F.length(w) <= SHORT_WORD), " ")) >= share * F.length(whole)

    def side(df: DataFrame, c: str, *keep: str) -> DataFrame:
        out = df.withColumn("words", parts(F.col(c))).withColumn("whole", F.array_join("words", " "))
        return out.withColumn("short", mostly_short(F.col("words"), F.col("whole"))).select(c, *keep, "words", "whole", "short")

    left = stored(side(own, "line"), "anchor-lines")
    right = stored(side(roles.withColumn("name", upper_plain(F.col("role"))), "name", "position", "role"), "anchor-roles")
    by_word = lambda df, c: df.select(c, "short", F.explode("words").alias("word"))
    x, y = by_word(left, "line").withColumnRenamed("short", "x_short"), by_word(right, "name").withColumnRenamed("short", "y_short").distinct()
    long = F.length("word") > SHORT_WORD
    shared = x.where(long).join(y.where(long), "word").select("line", "name")
    shared = shared.unionByName(x.where(~long & F.col("x_short")).join(y.where(~long), "word").select("line", "name"))
    shared = shared.unionByName(x.where(~long & ~F.col("x_short")).join(y.where(~long & F.col("y_short")), "word").select("line", "name"))
    shortest, longest = right.agg(F.min(F.length("whole")), F.max(F.length("whole"))).first()
    alike = left.where(F.length("whole").between((shortest or 0) * share - 1, (longest or 0) / share + 1))  # other lines are no role but for a few letters
    close = similar_candidates(alike.select(F.lit(0).alias("g"), "whole"), right.select(F.lit(0).alias("g"), F.col("whole").alias("other")), "g", "whole", "other", ratio / 100, 1)
    close = close.join(left.select("line", "whole"), "whole").join(right.select("name", F.col("whole").alias("other")), "other").select("line", "name")
    pairs = shared.unionByName(close).distinct()
    both = pairs.join(left.select("line", F.col("words").alias("a"), F.col("whole").alias("a_whole")), "line").join(right.select("name", "position", "role", F.col("words").alias("b"), F.col("whole").alias("b_whole")), "name")
    met = F.array_join(F.array_sort(F.array_intersect("a", "b")), " ")
    rest = lambda c, d: F.trim(F.concat_ws(" ", "met", F.array_join(F.array_sort(F.array_except(c, d)), " ")))
    both = both.withColumn("met", met)
    n, least = F.length("met"), F.least(F.length("a_whole"), F.length("b_whole"))
    sure = F.when(n > 0, 200 * n / (n + least)).otherwise(0.0)
    possible = 200 * least / (F.length("a_whole") + F.length("b_whole"))
    both = both.withColumns({"sure": sure, "possible": possible}).where((F.col("sure") >= ratio) | (F.col("possible") >= ratio))
    open_ = (F.col("possible") > F.col("sure")) & (F.col("possible") >= ratio)
    scored = both.withColumn("score", F.greatest("sure", 100 * indel_ratio(F.when(open_, rest("b", "a")).otherwise(F.lit("x")), F.when(open_, rest("a", "b")).otherwise(F.lit("y")))))
    scored = scored.where(F.round("score", 9) >= ratio)
    best = scored.groupBy("line").agg(F.max_by("role", F.struct(F.round("score", 9), F.length("role"), -F.col("position"))).alias("anchor"))
    return lines.withColumn("__line", upper_plain(F.col(text))).join(best.withColumnRenamed("line", "__line"), "__line", "left").drop("__line")


_GAP = rf"[\s|]{{0,{NUMBER_GAP}}}+"
#: A number with the letters beside it or beyond a gap, on to the next number if that follows in the same way.
_SURROUNDINGS = rf"(?<!\p{{L}})(?:\p{{L}}++{_GAP})?\d++(?:{_GAP}(?:\p{{L}}++{_GAP})?\d++)*+(?:{_GAP}\p{{L}}++)?"


def number_surroundings(texts: DataFrame, doc: str, text: str) -> DataFrame:
    """doc, near: what of a text, in capitals, stands next to its numbers: the letters beside them or beyond one gap of at most NUMBER_GAP
    blanks and bars. What lies between is one mark. One pass over a text; nothing else of it is moved."""
    found = F.regexp_extract_all(F.upper(F.coalesce(F.col(text), F.lit(""))), F.lit(_SURROUNDINGS), F.lit(0))
    return texts.select(doc, F.array_join(found, "\x01").alias("near"))


def infer_row_numbers(rows: DataFrame, texts: DataFrame, doc: str, role: str, text: str) -> DataFrame:
    """rows with inferred: the number from 1 to 30 next to the role's last but one distinctive word (four capitals or more) in the document's
    text, the first in its order; else that next to its last one; null if there is none. Words are looked up among those next to numbers, as
    beginnings and ends of runs of letters, and only those found there search the surroundings of the document's numbers."""
    distinctive = F.regexp_extract_all(F.upper(F.coalesce(F.col("__role"), F.lit(""))), F.lit(r"(?U)\b([A-ZÁÉÍÓÚÑ]{4,})\b"), F.lit(1))
    roles = rows.select(F.col(doc).alias("__doc"), F.col(role).alias("__role")).distinct()
    last = F.slice("w", F.greatest(F.size("w") - 1, F.lit(1)), 2)
    asked = roles.withColumn("w", distinctive).select("__doc", "__role", F.posexplode(last).alias("k", "word"))
    near = stored(number_surroundings(texts, doc, text).withColumnRenamed(doc, "__d"), "number-surroundings")
    letters = near.select("__d", F.explode(F.array_distinct(F.regexp_extract_all("near", F.lit(r"(\p{L}{4,})"), F.lit(1)))).alias("run"))
    ends = F.flatten(F.transform(F.sequence(F.lit(4), F.length("run")), lambda n: F.array(F.left("run", n), F.right("run", n))))
    known = letters.select("__d", F.explode(ends).alias("__w")).distinct()
    met = asked.join(shuffled(known), F.col("__doc").eqNullSafe(F.col("__d")) & (F.col("word") == F.col("__w")), "left_semi")
    pattern = F.concat(F.lit(rf"(?:(\d{{1,2}})[\s|]{{0,{NUMBER_GAP}}}"), "word", F.lit("|"), "word", F.lit(rf"[\s|]{{0,{NUMBER_GAP}}}(\d{{1,2}}))"))
    hits = F.arrays_zip(*(F.regexp_extract_all("near", pattern, F.lit(i)).alias(n) for i, n in ((1, "a"), (2, "b"))))
    found = met.join(shuffled(near), F.col("__doc").eqNullSafe(F.col("__d"))).withColumn("hits", F.transform(hits, lambda h: F.coalesce(F.nullif(h["a"], F.lit("")), h["b"]).try_cast("int")))
    found = found.withColumn("number", F.get(F.filter("hits", lambda n: n.between(*NUMBERS)), 0)).where("number is not null")
    found = found.groupBy("__doc", "__role").agg(F.min_by("number", "k").alias("inferred"))
    out = rows.alias("r").join(shuffled(found).alias("f"), F.col(f"r.{doc}").eqNullSafe(F.col("f.__doc")) & F.col(f"r.{role}").eqNullSafe(F.col("f.__role")), "left")
    return out.select("r.*", "inferred")
