"""Works registry: certificates linked to works, persons verified, progress read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import bound, jaccard, tokens
from ..functions.text import strip_accents, words
from ..rules import LINK_LEAD, LINK_SCORE, NAME_JACCARD, NO_PLACES, WORK_KINDS, WORK_STOP_WORDS
from ..shared import shuffled, stored
from .assign import contained_texts


#: A work's start counts by how near it is within these days before the certificate.
LINK_DAYS = 3650
#: Numbers of days before and after all others.
NEVER, ALWAYS = -(2**40), 2**40


def link_score(name: Column, entity: Column, days: Column) -> Column:
    """50 x Jaccard of names, 30 less 3 a year between the work's start and the certificate (-10 if the work starts later), 20 x Jaccard of entities."""
    near = F.when(days.isNull(), 0.0).when(days < 0, -10.0).when(days <= LINK_DAYS, F.greatest(F.lit(0.0), 30 - days / 365 * 3)).otherwise(0.0)
    return 50 * name + near + 20 * entity


def candidate_pairs(left: DataFrame, right: DataFrame, a: str, b: str, left_words: str, right_words: str, level: int = 1, weight: str | None = None) -> DataFrame:
    """Pairs of a row of left with rows of right, by a level from specific to generic: 1, those that hold both its key words, its two
    words that the fewest rows of right hold (ties by the word; a row with one word known to right has that alone); 2, those that hold
    any two of its words; 3, those that hold any. Counts are over all rows of right; a word is the equality key, the rest is tested on
    the pairs. weight: how many rows a row of right stands for."""
    held = right.select(b, right_words, *([weight] if weight else []), F.explode(right_words).alias("word"))
    counts = held.groupBy("word").agg(F.sum(weight if weight else F.lit(1)).alias("n"))
    own = left.select(a, F.explode(left_words).alias("word")).join(shuffled(counts), "word")
    own = own.withColumn("__r", F.row_number().over(Window.partitionBy(a).orderBy("n", "word")))
    if level == 1:
        keys = own.where("__r <= 2").groupBy(a).agg(F.min_by("word", "__r").alias("word"), F.max_by("word", "__r").alias("__second"))
        return keys.join(shuffled(held), "word").where(F.array_contains(right_words, F.col("__second"))).select(a, b)
    if level == 2:  # of two shared words one is not the last, the most frequent
        own = own.withColumn("__last", F.max("__r").over(Window.partitionBy(a))).where("__r < __last")
    pairs = own.select(a, "word").join(shuffled(held.select(b, "word")), "word").select(a, b).distinct()
    if level == 2:
        both = pairs.join(shuffled(left.select(a, left_words)), a).join(shuffled(right.select(b, right_words)), b)
        pairs = both.where(F.size(F.array_intersect(left_words, right_words)) >= 2).select(a, b)
    return pairs


def nearest_starts(asked: DataFrame, classes: DataFrame, work: str) -> DataFrame:
    """asked: entity, __v, __day (a day's number, ALWAYS for none), each once; classes: __v, w_entity, start, work, __many. For each asked row and
    each score of entities among the works of its class, all that link_score can tell apart: the two latest starts up to the day (first, second, each
    with its __d, least work and number of works), the least and the number of the works without one in the 10 years up to it (__aged, __n) and, in
    __open, of those that start later. A class's starts are put in order once and days run past them, so no day meets each work."""
    pair, number = ["entity", "__v"], F.coalesce(F.unix_date("start").cast("long"), F.lit(NEVER))
    met = asked.select(*pair).distinct().withColumn("c_entity", tokens(F.col("entity"))).join(shuffled(classes), "__v")
    met = met.select(*pair, jaccard(F.col("c_entity"), F.col("w_entity")).alias("__entity"), number.alias("__d"), work, "__many")
    group = [*pair, "__entity"]
    own = stored(met.groupBy(*group, "__d").agg(F.min(work).alias("__w"), F.sum("__many").alias("__m")), "work-starts")
    kinds = own.select(*group).distinct()
    nothing = own.schema["__w"].dataType
    dated = own.where(F.col("__d") > NEVER).unionByName(kinds.select(*group, F.lit(NEVER).alias("__d"), F.lit(None).cast(nothing).alias("__w"), F.lit(None).cast("long").alias("__m")))
    order, after, start = Window.partitionBy(*group).orderBy("__d"), Window.partitionBy(*group).orderBy(F.desc("__d")).rowsBetween(Window.unboundedPreceding, -1), F.struct("__d", "__w", "__m")
    state = F.struct(start.alias("first"), F.lag(start).over(order).alias("second"), F.min("__w").over(after).alias("later"), F.sum("__m").over(after).alias("n"))
    opened = dated.select(*group, "__d", state.alias("__open"), F.lit(False).alias("__asked"))
    aged = own.select(*group, F.when(F.col("__d") > NEVER, F.col("__d") + LINK_DAYS).otherwise(NEVER).alias("__d"), F.col("__w").alias("__aged"), F.col("__m").alias("__n"), F.lit(False).alias("__asked"))
    days = asked.join(shuffled(kinds), pair).select(*group, F.col("__day").alias("__d"), F.lit(True).alias("__asked"))
    line = opened.unionByName(aged, allowMissingColumns=True).unionByName(days, allowMissingColumns=True)
    past = Window.partitionBy(*group).orderBy("__d", "__asked").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = {"__open": F.last("__open", ignorenulls=True).over(past), "__aged": F.min("__aged").over(past), "__n": F.sum("__n").over(past)}
    return line.withColumns(seen).where("__asked").select(*group, F.col("__d").alias("__day"), "__open", "__aged", "__n")


def link_works(certificates: DataFrame, works: DataFrame, certificate: str, work: str, levels: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """certificates: certificate, name, entity, day; works: work, name, entity, start. Of the works of the first level of candidate_pairs
    at which one reaches LINK_SCORE, the best: certificate, work, score, ambiguous (the next is less than LINK_LEAD behind)."""
    # Certificates of the same rows (one, as a rule) are compared once. Works of the same words are a class: names meet classes, and of a class only
    # those works that can be the best or the next on a day meet its certificates. The first of works of one class, entity and start stands for all.
    row = F.struct(F.coalesce("name", F.lit("")).alias("name"), F.coalesce("entity", F.lit("")).alias("entity"), "day")
    held = stored(certificates.groupBy(certificate).agg(F.array_sort(F.collect_list(row)).alias("__rows")), "certificates")
    asked = stored(held.select("__rows").distinct().withColumn("__c", F.monotonically_increasing_id()), "certificate-rows")
    left = asked.select("__c", F.transform("__rows", lambda r: r["name"]).alias("__names"), F.explode("__rows").alias("r"))
    left = left.select("__c", "__names", "r.name", "r.entity", F.coalesce(F.unix_date("r.day").cast("long"), F.lit(ALWAYS)).alias("__day"))
    alike = works.groupBy("name", "entity", "start").agg(F.min(work).alias(work), F.count(F.lit(1)).alias("__many"))
    alike = alike.select(work, "__many", "start", F.array_sort(tokens(F.col("name"))).alias("w_words"), F.array_sort(tokens(F.col("entity"))).alias("w_entity"))
    alike = stored(alike.groupBy("w_words", "w_entity", "start").agg(F.min(work).alias(work), F.sum("__many").alias("__many")), "work-words")
    classes = stored(alike.groupBy("w_words").agg(F.sum("__many").alias("__many")).withColumn("__v", F.monotonically_increasing_id()), "work-classes")
    w = stored(alike.join(shuffled(classes.select("__v", "w_words")), "w_words").select("__v", "w_entity", "start", work, "__many"), "works")
    order = Window.partitionBy("__c").orderBy(F.desc("score"), work)
    out = None
    for level in levels:
        own = stored(left.select("__names").distinct().withColumn("__words", F.array_sort(F.flatten(F.transform("__names", tokens)))), "name-lists")
        sets = stored(own.select("__words").distinct().withColumn("__s", F.monotonically_increasing_id()), "word-sets")
        pairs = candidate_pairs(sets, classes, "__s", "__v", "__words", "w_words", level, "__many")
        pairs = sets.join(shuffled(pairs), "__s").join(shuffled(classes.select("__v", "w_words")), "__v")
        names = own.select("__names", "__words", F.explode(F.array_distinct("__names")).alias("name")).withColumn("c_words", tokens(F.col("name")))
        names = names.join(shuffled(pairs), "__words").select("__names", "name", "__v", jaccard(F.col("c_words"), F.col("w_words")).alias("__name"))
        met = stored(left.join(shuffled(names), ["__names", "name"]).select("__c", "entity", "__day", "__v", "__name"), "link-classes")
        near = nearest_starts(met.select("entity", "__v", "__day").distinct(), w, work)
        scored = met.join(shuffled(near), ["entity", "__v", "__day"])

        def choice(number: Column, many: Column, days: Column) -> Column:
            return F.when(number.isNotNull(), F.struct((-F.round(link_score(F.col("__name"), F.col("__entity"), days), 6)).alias("less"), number.alias("work"), many.alias("many")))

        dated = [F.when(F.col("__day") - s["__d"] < LINK_DAYS, choice(s["__w"], s["__m"], F.col("__day") - s["__d"])) for s in (F.col("__open.first"), F.col("__open.second"))]
        choices = F.array(*dated, choice(F.col("__aged"), F.col("__n"), F.lit(None).cast("long")), choice(F.col("__open.later"), F.col("__open.n"), F.lit(-1)))
        scored = scored.select("__c", F.sort_array(F.array_compact(choices)).alias("b"))
        first, second = F.get("b", 0), F.get("b", 1)
        scored = scored.select("__c", first["work"].alias(work), (-first["less"]).alias("score"), F.when(first["many"] > 1, -first["less"]).otherwise(-second["less"]).alias("second"))
        ranked = scored.withColumns({"rank": F.row_number().over(order), "next": F.greatest("second", F.lead("score").over(order))})
        found = ranked.where((F.col("rank") == 1) & (F.col("score") >= LINK_SCORE)).select("__c", work, "score", F.coalesce(F.col("score") - F.col("next") < LINK_LEAD, F.lit(False)).alias("ambiguous"))
        found = stored(found, "links")
        out = found if out is None else out.unionByName(found)
        left = left.join(shuffled(found.select("__c")), "__c", "left_anti")
    linked = asked.join(shuffled(out), "__c").drop("__c")
    return held.join(shuffled(linked), "__rows").select(certificate, work, "score", "ambiguous")


def key_words(name: Column) -> Column:
    """Capitals without accents of three letters or more, generic words left out."""
    plain = F.regexp_replace(strip_accents(F.upper(F.coalesce(name, F.lit("")))), r"[^A-Z0-9\s]", " ")
    return F.filter(words(plain), lambda w: (F.length(w) > 2) & ~w.isin(*WORK_STOP_WORDS))


def phrase_keys(name: Column) -> Column:
    """Up to four phrases to look a work up by, from specific to generic: kind and two places, three places, five key words, kind and place."""

    def keys(k: Column) -> Column:
        kinds = F.filter(k, lambda w: w.isin(*WORK_KINDS))
        places = F.filter(k, lambda w: ~w.isin(*WORK_KINDS, *NO_PLACES))
        phrase = lambda *parts: F.array_join(F.concat(*parts), " ")
        both = (F.size(kinds) > 0) & (F.size(places) > 0)
        found = (
            F.when(both, phrase(F.slice(kinds, 1, 1), F.slice(places, 1, 2))), F.when(F.size(places) > 0, phrase(F.slice(places, 1, 3))),
            F.when(F.size(k) > 0, phrase(F.slice(k, 1, 5))), F.when(both, phrase(F.slice(kinds, 1, 1), F.slice(places, 1, 1))),
        )
        return F.array_distinct(F.array_compact(F.array(*found)))

    return bound(key_words(name), keys)


def link_works_by_phrase(certificates: DataFrame, works: DataFrame, certificate: str, work: str) -> DataFrame:
    """certificates: certificate, name, entity, day; works: work, name, entity, start. A certificate's candidates are the works whose key words,
    as one text, hold its first phrase that any work holds; of these the best by link_score, if it reaches LINK_SCORE: certificate, level
    (of the phrase, from 1), candidates, work, score, ambiguous (the next is less than LINK_LEAD behind). Phrases are looked up among
    distinct names by their rarest letters, and certificates of one name, entity and day are linked once."""
    c = certificates.select(certificate, "name", "entity", "day")
    asked = c.select("name", "entity", "day").distinct()
    names = stored(asked.select("name").distinct().select("name", F.posexplode(phrase_keys(F.col("name"))).alias("pos", "key")), "link-keys")
    registry = stored(works.select(work, tokens(F.col("name")).alias("w_words"), tokens(F.col("entity")).alias("w_entity"), "start", F.array_join(key_words(F.col("name")), " ").alias("hay")), "link-works")
    held = contained_texts(names.select(F.lit(0).alias("g"), "key"), registry.select(F.lit(0).alias("g"), F.col("hay").alias("key")), "g", "key").select(F.col("needle").alias("key"), "hay")
    held = stored(held, "link-held")
    first = names.join(shuffled(held.select("key").distinct()), "key").groupBy("name").agg(F.min("pos").alias("pos"), F.min_by("key", "pos").alias("key"))
    # Names are compared once, by words made once for a name; days and entities come after.
    first = stored(first.withColumn("c_words", tokens(F.col("name"))), "link-first")
    met = first.join(shuffled(held), "key").join(shuffled(registry), "hay")
    met = met.select("name", "pos", work, "start", "w_entity", jaccard(F.col("c_words"), F.col("w_words")).alias("__name"))
    pairs = asked.withColumn("c_entity", tokens(F.col("entity"))).join(shuffled(met), "name")
    score = link_score(F.col("__name"), jaccard(F.col("c_entity"), F.col("w_entity")), F.datediff("day", "start"))
    scored = pairs.select("name", "entity", "day", (F.col("pos") + 1).alias("level"), work, F.round(score, 6).alias("score"))
    own = Window.partitionBy("name", "entity", "day")
    order = own.orderBy(F.desc("score"), work)
    ranked = scored.withColumns({"rank": F.row_number().over(order), "next": F.lead("score").over(order), "candidates": F.count(F.lit(1)).over(own)})
    best = ranked.where((F.col("rank") == 1) & (F.col("score") >= LINK_SCORE)).withColumn("ambiguous", F.coalesce(F.col("score") - F.col("next") < LINK_LEAD, F.lit(False)))
    same = F.col("c.name").eqNullSafe(F.col("b.name")) & F.col("c.entity").eqNullSafe(F.col("b.entity")) & F.col("c.day").eqNullSafe(F.col("b.day"))
    return c.alias("c").join(shuffled(best).alias("b"), same).select(f"c.{certificate}", "level", "candidates", f"b.{work}", "score", "ambiguous")


def top_candidates(scored: DataFrame, key: str, score: str, other: str, k: int = 10) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), other))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def verify_person(certificates: DataFrame, people: DataFrame, work: str, certificate: str) -> DataFrame:
    """certificates: certificate, work, name, start, end; people: work, person, p_start, p_end. The registered person with the most similar name
    among all of the work: name_score, matched (at least NAME_JACCARD), period_ok (intervals meet; an open end is the certificate's)."""
    # Words are made once for a name, not for each pair: distinct names and persons of a work are compared, certificates take the scores.
    ours, theirs = (stored(df.select(work, c).distinct().withColumn(w, tokens(F.col(c))), "names") for df, c, w in ((certificates, "name", "__a"), (people, "person", "__b")))
    alike = ours.join(theirs, work).select(F.col(work).alias("__w"), F.col("name").alias("__n"), F.col("person").alias("__p"), jaccard(F.col("__a"), F.col("__b")).alias("__score"))
    met = people.alias("p").join(shuffled(alike).alias("s"), (F.col(f"p.{work}") == F.col("__w")) & F.col("person").eqNullSafe(F.col("__p"))).select("p.*", "__n", "__score")
    both = certificates.alias("c").join(shuffled(met).alias("m"), (F.col(f"c.{work}") == F.col(f"m.{work}")) & F.col("c.name").eqNullSafe(F.col("__n")), "left").select("c.*", "person", "p_start", "p_end", "__score")
    score = F.coalesce("__score", F.lit(0.0))
    meets = (F.col("start") <= F.coalesce("p_end", "end")) & (F.col("p_start") <= F.col("end"))
    best = F.max_by(F.struct("person", meets.alias("meets"), score.alias("score")), F.struct(score, F.coalesce(meets, F.lit(False)), "person"))
    out = both.groupBy(certificate).agg(best.alias("b"))
    matched = F.col("b.score") >= NAME_JACCARD
    return out.select(certificate, F.col("b.person").alias("person"), F.round("b.score", 6).alias("name_score"), matched.alias("matched"), F.when(matched, F.col("b.meets")).alias("period_ok"))


def latest_progress(progress: DataFrame, work: str, month: str, columns: list[str]) -> DataFrame:
    """The latest non-null value of each column, each by itself."""
    return progress.groupBy(work).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(month))).alias(c) for c in columns))


def stoppage_summary(periods: DataFrame, key: str, days: str) -> DataFrame:
    return periods.groupBy(key).agg(F.count(F.lit(1)).alias("stops"), F.sum(days).alias("stopped_days"))


def nest_children(works: DataFrame, children: dict[str, DataFrame], key: str) -> DataFrame:
    """works with one array of structs per kind of child."""
    out = works
    for name, child in children.items():
        rows = child.groupBy(key).agg(F.collect_list(F.struct(*(c for c in child.columns if c != key))).alias(name))
        out = out.join(rows, key, "left").withColumn(name, F.coalesce(name, F.array()))
    return out


def progress_table(months: DataFrame, stopped: str, attachments: str) -> DataFrame:
    """Month rows with the number of their attachments and a mark where work stood still."""
    count = F.greatest(F.coalesce(F.size(attachments), F.lit(0)), F.lit(0))
    return months.withColumn(attachments, count).withColumn("mark", F.when(F.col(stopped), "stopped").otherwise(""))
